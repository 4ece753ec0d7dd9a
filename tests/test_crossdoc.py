"""Documents of a case held against each other, where a case is cut into blocks, against plain loops."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from caselight.functions import similarity as S
from caselight.operators import crossdoc as D


def longest(a: str, b: str) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b):
            left, row[j + 1] = row[j + 1], left + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_subsequences_of_any_length():
    rng = random.Random(1)
    text = lambda sizes: "".join(rng.choice("abcé\0𝒳") for _ in range(rng.choice(sizes)))
    pairs = [(text([0, 1, 3, 20, 63, 64, 65, 100, 600]), text([0, 1, 3, 20, 64, 65, 300])) for _ in range(200)]
    a, b = map(list, zip(*pairs))
    assert S.common_lengths(a, b).tolist() == [longest(*p) for p in pairs]
    assert S.indel_ratios([None, "", float("nan")], ["a", "", "a"]).tolist() == [0, 0, 0]
    assert S.token_set_ratios(["a b", None, "", "a b"], ["b a", "q", None, "a c"]).tolist() == pytest.approx([1, 0, 0, 2 * 2 / 6])
    assert not len(S.common_lengths([], [])) and not len(S.token_set_ratios([], []))


NAMES = ["AMIT SHARMA", "AMIT GUPTA", "A. SHARMA", "RAHUL MEHTA", None, "12", "12"]


def documents(spark, n: int = 90):
    """Most documents in one case; repeated places, names, and rows without a case."""
    rng = random.Random(3)
    rows = [(k % 70, 1 if k % 3 else rng.choice([2, 3, None]), rng.choice([k, k % 5, None]), rng.choice(NAMES)) for k in range(n)]
    return spark.createDataFrame(rows, "doc_id long, case_id long, seq long, name string"), rows


def wanted(rows):
    return [(a, b) for a in rows for b in rows if a[1] is not None and a[1] == b[1] and None not in (a[2], b[2], a[3], b[3]) and a[2] < b[2]]


@pytest.mark.parametrize("block", [7, 2_000])
def test_all_pairs_of_a_case_meet_once(spark, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK", block)
    docs, rows = documents(spark)
    want = wanted(rows)
    found = D.pairs_in_case(docs, ["name"]).select("case_id", "doc_a", "doc_b", "name_a", "name_b")
    assert Counter(map(tuple, found.collect())) == Counter((a[1], a[0], b[0], a[3], b[3]) for a, b in want)
    values = [tuple(r) for r in D.pairs_of_values(docs, "name").collect()]
    assert len(values) == len(set(values)) and set(values) == {(a[1], a[3], b[3]) for a, b in want}
    scores = {(r.name_a, r.name_b): r.similarity for r in D.name_scores(D.pairs_in_case(docs, ["name"])).collect()}
    found = Counter((r.case_id, r.doc_a, r.doc_b, r.score) for r in D.name_mismatches(docs).collect())
    assert found and found == Counter((a[1], a[0], b[0], round(scores[a[3], b[3]], 6)) for a, b in want if scores[a[3], b[3]] < D.NAMES_DIFFER)


def test_employers_of_a_case(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 7)
    docs, rows = documents(spark)
    found = Counter((r.case_id, r.doc_a, r.doc_b) for r in D.employer_mismatches(docs.withColumnRenamed("name", "employer")).collect())
    score = lambda a, b: S.token_set_ratio_of(a.lower().replace(".", ""), b.lower().replace(".", ""))
    assert found == Counter((a[1], a[0], b[0]) for a, b in wanted(rows) if score(a[3], b[3]) < D.EMPLOYERS_DIFFER)


def test_a_large_case_is_spread(spark):
    """50,000 documents of one case and one name: names meet, not the documents, and cells stay small."""
    docs = spark.range(50_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("case_id"), F.col("id").alias("seq"), F.lit("AMIT SHARMA").alias("name"))
    assert D.name_mismatches(docs).count() == 0
    assert D.pairs_of_values(docs, "name").count() == 1
    cells = D.in_blocks(docs, ["doc_id", "seq"]).groupBy("lo", "hi").agg(F.count("*").alias("n")).agg(F.max("n"), F.count("*")).first()
    assert cells[0] < 3 * D.BLOCK and cells[1] == 25 * 26 // 2


def test_no_documents(spark):
    none = documents(spark)[0].limit(0)
    assert D.name_mismatches(none).count() == D.pairs_in_case(none, ["name"]).count() == 0
