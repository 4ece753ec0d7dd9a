"""Small tables with every awkward row: nulls, empty and long texts, ties, repeats, clashing column names."""

from __future__ import annotations

import random

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, digest string, keys int, block long, p double, ids string, key string, place int, label string, mix_domain string, quality_p double, toxic_score double"


def words(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(n))


def document_rows() -> list[tuple]:
    base = words(1, 120)
    near = " ".join("changed" if k == 60 else w for k, w in enumerate(base.split()))
    texts = [
        (1, base, "en", "src0"), (2, base, "en", "src0"), (3, near, "de", "src1"), (4, None, "en", "src1"), (5, "", None, "src2"), (6, "   ", "fr", None), (7, "one", "en", "src0"), (8, "two words", "en", "src3"),
        (9, words(2, 30_000), "en", "src0"), (10, "a  b   c\n\nd \t e", "es", "src0"), (11, base.upper(), "en", "src5"), (12, "x<|endoftext|>y <|endoftext|> z", "en", "src0"), (13, "日本 語 — ’quoted’ é ñ ß", "ja", "src0"),
        (14, "y" * 5000, "en", "src0"), (None, base, "en", "src0"), (None, None, None, None), (15, words(3, 40), "en", "src7"), (15, words(3, 40), "en", "src7"), (15, words(4, 40), "en", "src7"), (16, "two words", "en", "src3"),
    ]
    return [(*t, None if t[1] is None else len(t[1]), "x", 1, 2, 0.5, "i", "k", 3, "l", "m", 0.1, 0.2) for t in texts]


def documents(spark):
    return spark.createDataFrame(document_rows(), DOCUMENTS)


def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)
