"""Entities of a document's text, as expressions over the whole text. Absent entities are null.

Fixed values: all patterns in this module, as they decide what counts as an entity.
"""

from __future__ import annotations


from pyspark.sql import Column, functions as F

from .text import first_match, squeeze, strip, valid_name

#: The tables of the Verhoeff check digit, generated from the dihedral group of order 10 and its permutation.
VERHOEFF_STEP = [1, 5, 7, 6, 2, 8, 3, 0, 9, 4]


def _verhoeff_tables() -> tuple[list[int], list[int]]:
    def times(a: int, b: int) -> int:
        if a < 5:
            return (a + b) % 5 if b < 5 else 5 + (a + b) % 5
        return 5 + (a - b) % 5 if b < 5 else (a - b) % 5

    perm = [list(range(10))]
    while len(perm) < 8:
        perm.append([perm[-1][d] for d in VERHOEFF_STEP])
    return [times(a, b) for a in range(10) for b in range(10)], [d for row in perm for d in row]


def birth_date(text: Column) -> Column:
    full = F.regexp_replace(first_match(text, r"\b\d{2}[/.-]\d{2}[/.-]\d{4}\b"), "[.-]", "/")
    year = first_match(text, r"(?i)(?:yob|year\s+of\s+birth|जन्म\s+का\s+वर्ष|जन्म\s+तिथि)[:\s]*(\d{4})", 1)
    return F.coalesce(full, F.concat(F.lit("01/01/"), year))


def valid_birth_date(date: Column) -> Column:
    """dd/MM/yyyy of a real date from 1900 to 2028, else null."""
    whole = F.regexp_extract(strip(date), r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$", 0)
    day, month, year = (F.regexp_extract(whole, r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})$", g) for g in (1, 2, 3))
    real = F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")
    return F.when(F.year(real).between(1900, 2028), F.date_format(real, "dd/MM/yyyy"))


def gender(text: Column) -> Column:
    return F.when(text.rlike(r"(?i)\bfemale\b|स्त्री"), "Female").when(text.rlike(r"(?i)\bmale\b|पुरुष|मर्द"), "Male").when(text.rlike(r"(?i)\btransgender\b|तीसरा लिंग"), "Transgender")


def normal_gender(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low.contains("female") | (low == "f"), "Female").when(low.contains("male") | (low == "m"), "Male").when(low.contains("trans") | low.contains("tg"), "Transgender")


def pan_candidate(text: Column) -> Column:
    return first_match(text, r"(?i)\b[A-Z0-9]{10}\b")


def corrected_pan(c: Column) -> Column:
    """Letters that a reader took for digits put right by place, and the other way round; null unless it is a PAN then."""
    plain = F.upper(F.regexp_replace(c, "[^A-Za-z0-9]", ""))
    ten = F.when(F.length(plain) == 10, plain).otherwise(F.regexp_extract(plain, "[A-Z0-9]{10}", 0))
    fixed = F.concat(F.translate(F.substring(ten, 1, 5), "01582", "OISBZ"), F.translate(F.substring(ten, 6, 4), "OISBZGT", "0158267"), F.translate(F.substring(ten, 10, 1), "01582", "OISBZ"))
    return F.when(fixed.rlike("^[A-Z]{5}[0-9]{4}[A-Z]$"), fixed)


def aadhaar_candidate(text: Column) -> Column:
    return F.coalesce(first_match(text, r"\b\d{4}[\s-]\d{4}[\s-]\d{4}\b"), first_match(text, r"\b\d{12}\b"))


def verhoeff_ok(number: Column) -> Column:
    """Whether the 12 digits in a text pass the Verhoeff check."""
    times, perm = ([F.lit(x) for x in t] for t in _verhoeff_tables())
    digits = F.regexp_replace(number, r"\D", "")
    table, perms = F.array(*times), F.array(*perm)
    state = F.lit(0)
    for i in range(12):
        d = F.try_cast(F.substring(digits, 12 - i, 1), "int") if hasattr(F, "try_cast") else F.substring(digits, 12 - i, 1).try_cast("int")
        state = F.try_element_at(table, state * 10 + F.try_element_at(perms, F.lit((i % 8) * 10 + 1) + d) + 1)
    return F.when(F.length(digits) == 12, F.coalesce(state == 0, F.lit(False))).otherwise(F.lit(False))


def valid_aadhaar(c: Column) -> Column:
    d = F.regexp_replace(c, r"\D", "")
    return F.when(verhoeff_ok(c), F.concat_ws(" ", F.substring(d, 1, 4), F.substring(d, 5, 4), F.substring(d, 9, 4)))


def account_number(text: Column) -> Column:
    found = F.regexp_replace(first_match(text, r"(?i)(?:account\s+number|ac\s+no|a/c\s+no)[:\s]+([0-9-]{9,18})", 1), "[^0-9-]", "")
    return F.when(F.length(found).between(9, 18), found)


def phone(text: Column) -> Column:
    last = F.right(F.regexp_replace(first_match(text, r"\b(?:\+91|0)?[6789]\d{9}\b"), r"\D", ""), F.lit(10))
    return F.when(last.rlike("^[6-9]"), F.concat(F.lit("+91 "), last))


def email(text: Column) -> Column:
    found = first_match(text, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b")
    return F.when(found.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"), F.lower(found))


def labelled_name(text: Column) -> Column:
    return strip(first_match(text, r"(?i)(?:name|employee\s+name|customer\s+name)[:\s]+([A-Z\s.]{3,30})", 1))


def salary(text: Column) -> Column:
    found = F.replace(first_match(text, r"(?i)(?:net\s+pay|gross\s+salary|net\s+salary)[:\s]+(?:rs\.?|inr)?\s*([\d,.]+)", 1), F.lit(","), F.lit(""))
    value = found.try_cast("decimal(18,2)")
    return F.when(value > 0, value)


def employer(text: Column) -> Column:
    return valid_name(strip(first_match(text, r"(?i)(?:employer|company|organization)[:\s]+([A-Z\s&]{3,40})", 1)), employer=True)


def property_id(text: Column) -> Column:
    return F.upper(strip(first_match(text, r"(?i)(?:property\s+id|survey\s+no|khasra\s+no)[:\s]+([A-Z0-9/-]{3,20})", 1)))


def property_owner(text: Column) -> Column:
    return valid_name(strip(first_match(text, r"(?i)(?:owner|title\s+holder)[:\s]+([A-Z\s.]{3,30})", 1)))


def lines_of(text: Column) -> Column:
    """Trimmed lines that are not blank."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


ADDRESS_MARK = r"(?i)\b(?:address|c/o|s/o|d/o|w/o)\b\s*[:/]?\s*|पता\s*[:/]?\s*"
ADDRESS_END = r"\b\d{4}\s\d{4}\s\d{4}\b|(?i:unique|authority|government|signature|www\.)"


def address(text: Column) -> Column:
    """The rest of the first marked line and up to four lines after it, until a blank line, an id or a stop word; over 10 characters."""
    lines = F.transform(F.split(text, "\n"), strip)
    at = F.array_position(F.transform(lines, lambda x: x.rlike(ADDRESS_MARK)), True)
    after = F.slice(lines, F.greatest(at, F.lit(1)).cast("int") + 1, 4)
    ends = F.array_position(F.transform(after, lambda x: (x == "") | x.rlike(ADDRESS_END)), True)
    kept = F.when(ends > 0, F.slice(after, F.lit(1), (ends - 1).cast("int"))).otherwise(after)
    first = strip(F.regexp_replace(F.try_element_at(lines, at.cast("int")), ADDRESS_MARK, ""))
    whole = F.when(at > 0, squeeze(F.concat_ws(" ", first, F.array_join(kept, " "))))
    return F.when(F.length(whole) > 10, whole)


def pan_names(text: Column) -> Column:
    """struct(name, father): the first two groups of lines with usable words, above the first date or PAN."""
    lines = lines_of(text)
    stop = F.array_position(F.transform(lines, lambda x: x.rlike(r"\b\d{2}[/.-]\d{2}[/.-]\d{4}\b|\b[A-Z]{5}[0-9]{4}[A-Z]\b")), True)
    above = F.when(stop > 0, F.slice(lines, F.lit(1), (stop - 1).cast("int"))).otherwise(lines)

    def usable(line: Column) -> Column:
        words = F.split(squeeze(F.regexp_replace(line, r"[^A-Za-z\s]", "")), " ")
        return F.array_join(F.filter(words, lambda w: ~F.upper(w).isin(NAME_STOPS) & (F.length(w) >= 3)), " ")

    joined = F.array_join(F.transform(above, usable), "|")
    groups = F.filter(F.transform(F.split(joined, r"\|\|+"), lambda g: F.trim(F.regexp_replace(g, r"\|", " "))), lambda g: g != "")
    return F.struct(valid_name(F.try_element_at(groups, F.lit(1))).alias("name"), valid_name(F.try_element_at(groups, F.lit(2))).alias("father"))


#: Words on identity cards that no name has.
NAME_STOPS = ["INCOME", "TAX", "DEPARTMENT", "GOVT", "INDIA", "GOVERNMENT", "PERMANENT", "ACCOUNT", "NUMBER", "CARD", "SIGNATURE", "NAME", "FATHER", "FATHERS"]


def aadhaar_name(text: Column) -> Column:
    """The nearest usable line above the birth date's, else what follows ``name``."""
    lines = lines_of(text)
    at = F.array_position(F.transform(lines, lambda x: x.rlike(r"(?i)dob|yob|year of birth|birth|\b\d{2}[/.-]\d{2}[/.-]\d{4}\b")), True)
    above = F.reverse(F.slice(lines, F.lit(1), F.greatest(at - 1, F.lit(0)).cast("int")))
    good = F.filter(above, lambda x: x.rlike(r"^[A-Za-z\s.]+$") & valid_name(x).isNotNull() & ~x.rlike("(?i)government|india|unique|authority"))
    return valid_name(F.coalesce(F.try_element_at(good, F.lit(1)), labelled_name(text)))


def father_name(text: Column) -> Column:
    """Capitals within two lines after a line that names the father."""
    lines = lines_of(text)
    at = F.array_position(F.transform(lines, lambda x: x.rlike(r"(?i)father'?s\s+name|पिता\s*का\s*नाम")), True)
    after = F.when(at > 0, F.slice(lines, (at + 1).cast("int"), 2))
    return F.try_element_at(F.filter(after, lambda x: x.rlike(r"^[A-Z\s.]+$") & (F.length(F.replace(x, F.lit(" "), F.lit(""))) >= 3) & ~x.rlike("GOVT|INDIA|INCOME|TAX|DEPARTMENT")), F.lit(1))
