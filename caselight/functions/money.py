"""Money and dates in text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Patterns of amounts, of lines that begin with a date, and of months.
AMOUNT = r"\b(?:\d{1,2}(?:,\d{2})*,\d{3}\.\d{2}|\d{1,3}(?:,\d{3})*\.\d{2}|\d+\.\d{2})\b"
DATED_LINE = r"^\s*(?:\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4}|\d{1,2}\s+[A-Za-z]{3,4}\s+\d{2,4})"
MONTH = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"


def amounts(text: Column) -> Column:
    """All amounts with two decimals, Western or lakh grouping."""
    return F.transform(F.regexp_extract_all(text, F.lit(AMOUNT), F.lit(0)), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("decimal(18,2)"))


def parsed_amount(c: Column) -> Column:
    """An amount with currency signs, grouping, and brackets or a minus for negatives; null if it is none."""
    plain = F.regexp_replace(c, r"[₹$€£\s]", "")
    bracket = plain.rlike(r"^\(.*\)$")
    inner = F.when(bracket, F.regexp_replace(plain, r"^\(|\)$", "")).otherwise(plain)
    minus = inner.rlike("^-|-$")
    value = F.replace(F.when(minus, F.regexp_replace(inner, "^-+|-+$", "")).otherwise(inner), F.lit(","), F.lit("")).try_cast("decimal(18,2)")
    return F.when(bracket | minus, -value).otherwise(value)


def real_date(year: Column, month: Column, day: Column) -> Column:
    """The date, or null if there is none or its year is outside 1900 to 2100."""
    d = F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    return F.when(F.year(d).between(1900, 2100), d)


def dates(text: Column) -> Column:
    """array<struct(raw, date, format)>: all dates of four notations; those that do not exist are INVALID."""

    def named(pattern: str, day: int, month: int, label: str) -> Column:
        def read(x: Column) -> Column:
            key = F.lower(F.substring(F.regexp_extract(x, pattern, month), 1, 3))
            place = F.array_position(F.array(*[F.lit(m) for m in ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")]), key)
            d = real_date(F.regexp_extract(x, pattern, 3), place.cast("string"), F.regexp_extract(x, pattern, day))
            return F.struct(x.alias("raw"), d.alias("date"), F.when(d.isNotNull(), label).otherwise("INVALID").alias("format"))

        return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), read)

    slash, iso = r"\b(\d{1,2})[/-](\d{1,2})[/-](\d{4})\b", r"\b(\d{4})-(\d{2})-(\d{2})\b"

    def read_slash(x: Column) -> Column:
        a, b, y = (F.regexp_extract(x, slash, g) for g in (1, 2, 3))
        first, second = real_date(y, b, a), real_date(y, a, b)
        return F.struct(x.alias("raw"), F.coalesce(first, second).alias("date"), F.when(first.isNotNull(), "DD/MM/YYYY").when(second.isNotNull(), "MM/DD/YYYY").otherwise("INVALID").alias("format"))

    def read_iso(x: Column) -> Column:
        d = real_date(*(F.regexp_extract(x, iso, g) for g in (1, 2, 3)))
        return F.struct(x.alias("raw"), d.alias("date"), F.when(d.isNotNull(), "YYYY-MM-DD").otherwise("INVALID").alias("format"))

    every = [F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), f) for p, f in ((slash, read_slash), (iso, read_iso))]
    every.append(named(rf"(?i)\b({MONTH})\s+(\d{{1,2}}),?\s+(\d{{4}})\b", 2, 1, "Month DD, YYYY"))
    every.append(named(rf"(?i)\b(\d{{1,2}})\s+({MONTH})\s+(\d{{4}})\b", 1, 2, "DD Month YYYY"))
    return F.concat(*every)
