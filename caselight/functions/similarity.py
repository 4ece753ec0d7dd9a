"""String similarities that Spark has no expression for, as vectorised functions over columns of pairs.

Use them on distinct pairs: operators deduplicate pairs before and join the scores back.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, SparkSession, functions as F

from .text import ADDRESS_WORDS, EMPLOYER_WORDS, normal_name  # noqa: F401


def jaro_winkler_of(a: str | None, b: str | None) -> float:
    """Jaro similarity, raised for a common beginning of up to 4 letters where it is over 0.7; empty operands give 0."""
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach, used, matched = max(0, max(len(a), len(b)) // 2 - 1), [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                matched.append(c)
                break
    if not matched:
        return 0.0
    other = [c for c, u in zip(b, used) if u]
    m, swaps = len(matched), sum(x != y for x, y in zip(matched, other)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    common = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + common * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


#: Characters of the shorter text that fit a machine word, and of the longer one up to which pairs are taken all at once.
WORD, LONG = 64, 512


def _codes(texts: list[str], width: int) -> np.ndarray:
    return np.array(texts, f"<U{width}").view(np.uint32).reshape(len(texts), width)


def _common_length(short: str, long: str) -> int:
    """As ``common_lengths`` for one pair of any length, in integers of as many bits as the shorter has characters."""
    at: dict[str, int] = {}
    for k, c in enumerate(short):
        at[c] = at.get(c, 0) | 1 << k
    full = open_ = (1 << len(short)) - 1
    for c in long:
        hit = open_ & at.get(c, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & full
    return len(short) - open_.bit_count()


def common_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """The length of the longest common subsequence of each pair.

    A row of the usual table is held as bits, one for each character of the shorter text, a zero where the length grows; the
    next row is a sum and a difference of words (Hyyro 2004). All pairs of a batch go on at once, a character at a time.
    """
    short, long = zip(*((x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b))) if len(a) else ((), ())
    out = np.zeros(len(short), np.int64)
    sizes = np.array([len(x) for x in short], np.int64), np.array([len(x) for x in long], np.int64)
    fits = (sizes[0] <= WORD) & (sizes[1] <= LONG)
    for k in np.flatnonzero(~fits):
        out[k] = _common_length(short[k], long[k])
    at = np.flatnonzero(fits & (sizes[0] > 0))
    if not len(at):
        return out
    wide, tall = int(sizes[0][at].max()), int(sizes[1][at].max())
    x, y = _codes([short[k] for k in at], wide), _codes([long[k] for k in at], tall)
    inside, places = np.arange(wide) < sizes[0][at][:, None], np.uint64(1) << np.arange(wide, dtype=np.uint64)
    rows = np.full(len(at), ~np.uint64(0))
    for k in range(tall):
        same = (x == y[:, k : k + 1]) & inside & (k < sizes[1][at])[:, None]
        hit = rows & np.where(same, places, np.uint64(0)).sum(1, dtype=np.uint64)
        rows = (rows + hit) | (rows - hit)
    out[at] = np.bitwise_count(~rows)
    return out


def indel_ratios(a: list[str | None], b: list[str | None]) -> np.ndarray:
    """Twice the longest common subsequence over the sum of lengths, of each pair; 0 where either is empty."""
    x, y = ([v if isinstance(v, str) else "" for v in side] for side in (a, b))
    total = np.array([len(p) + len(q) for p, q in zip(x, y)], np.int64)
    return 2 * common_lengths(x, y) / np.maximum(total, 1)


def token_set_ratios(a: list[str | None], b: list[str | None]) -> np.ndarray:
    """The best indel ratio among the common tokens and these with either side's own, of each pair; containment gives 1."""
    first, second, fixed = [], [], {}
    for k, (p, q) in enumerate(zip(a, b)):
        x, y = (set(v.split()) if isinstance(v, str) else set() for v in (p, q))
        both, one, two = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
        if not x or not y or (both and (not one or not two)):
            fixed[k] = float(bool(both))
        left, right = f"{both} {one}".strip(), f"{both} {two}".strip()
        first += [left, both, both]
        second += [right, left, right]
    best = indel_ratios(first, second).reshape(-1, 3).max(1)
    best[list(fixed)] = list(fixed.values())
    return best


def indel_ratio_of(a: str | None, b: str | None) -> float:
    return float(indel_ratios([a], [b])[0])


def token_set_ratio_of(a: str | None, b: str | None) -> float:
    return float(token_set_ratios([a], [b])[0])


def jaro_winklers(a: list[str | None], b: list[str | None]) -> list[float]:
    return [jaro_winkler_of(x, y) for x, y in zip(a, b)]


def _pairwise(f) -> object:
    """A function of two columns by one of two lists."""

    @F.pandas_udf("double")
    def scores(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(f(a.tolist(), b.tolist()), dtype="float64")

    return scores


def jaro_winkler(a: Column, b: Column) -> Column:
    return _pairwise(jaro_winklers)(a, b)


def indel_ratio(a: Column, b: Column) -> Column:
    return _pairwise(indel_ratios)(a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    return _pairwise(token_set_ratios)(a, b)


def register(spark: SparkSession) -> None:
    """The similarities as SQL functions."""
    for name, f in (("jaro_winkler", jaro_winklers), ("indel_ratio", indel_ratios), ("token_set_ratio", token_set_ratios)):
        spark.udf.register(name, _pairwise(f))


def abbreviation(short: Column, full: Column, surnames: Column) -> Column:
    """0.96 if the first word of ``short`` is the initial of ``full``'s and the surnames' similarity is 0.95 or more, else 0."""
    s, f = F.split(F.trim(short), r"\s+"), F.split(F.trim(full), r"\s+")
    ok = (F.size(s) >= 2) & (F.size(f) >= 2) & s[0].rlike(r"^.\.?$") & (F.substring(s[0], 1, 1) == F.substring(f[0], 1, 1)) & (surnames >= 0.95)
    return F.when(ok, 0.96).otherwise(0.0)


def last_word(c: Column) -> Column:
    return F.try_element_at(F.split(F.trim(c), r"\s+"), F.lit(-1))
