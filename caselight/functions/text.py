"""String functions: trimming, first matches, and the normal forms of names, addresses and employers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Abbreviations of addresses and of company forms with their long forms.
ADDRESS_WORDS = {"st": "street", "rd": "road", "apt": "apartment", "flt": "flat", "blvd": "boulevard", "sq": "square"}
EMPLOYER_WORDS = {"pvt": "private", "ltd": "limited", "corp": "corporation", "inc": "incorporated"}
TITLES = r"\b(mr|ms|mrs|dr|adv|prof)\b\.?"
#: Words that are no part of a person's or an employer's name.
NOT_NAMES = ["INCOME", "TAX", "DEPARTMENT", "GOVT", "INDIA", "CARD", "SIGNATURE", "ACCOUNT", "PERMANENT", "NUMBER", "PHOTO", "FATHER", "MOTHER", "INCOMETAX", "DEPT", "PRINT", "DIGITAL", "SECURITY", "AUTHENTIC", "VERIFIED", "GOVERNMENT", "UNIQUE", "AUTHORITY", "UNION", "REGISTRATION", "MALE", "FEMALE", "SIGN", "HOLDER", "DEPARTMENTOF", "OF", "GOVERNMENTOFINDIA"]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normal_name(c: Column) -> Column:
    """Lower case, no titles, letters only, single blanks."""
    return squeeze(F.regexp_replace(F.regexp_replace(F.lower(c), TITLES, ""), r"[^a-z\s]", " "))


def normal_words(c: Column, words: dict[str, str]) -> Column:
    """Lower case without punctuation, each word replaced by its long form."""
    plain = squeeze(F.regexp_replace(F.lower(c), r"[^a-z0-9\s]", " "))
    table = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return F.array_join(F.transform(F.split(plain, " "), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def valid_name(c: Column, employer: bool = False) -> Column:
    """Letters, blanks and dots (and & for employers) without words that name no one; upper case; at least 3 letters."""
    kept = squeeze(F.regexp_replace(c, r"[^A-Za-z\s.&]" if employer else r"[^A-Za-z\s.]", ""))
    words = F.filter(F.split(kept, " "), lambda w: ~F.upper(w).isin(NOT_NAMES) & (w != ""))
    name = F.upper(F.array_join(words, " "))
    return F.when(F.length(F.replace(name, F.lit(" "), F.lit(""))) >= 3, name)
