"""Similar cases: searches among all candidates, against brute force."""

from __future__ import annotations

import random
from decimal import Decimal as D

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from caselight.operators import similar as M


def cases(spark, n: int = 60):
    rng = random.Random(4)
    some = lambda values: rng.choice([*values, None])
    rows = [(k, some([D(10), D(69), D(70), D("92.5")]), some([D(60), D(95)]), some([D(40), D(100)]), some(["None", "Canva"]), some([1, 2, 3]), some([True, False]), some(["A", "B", "C"])) for k in range(n)]
    return spark.createDataFrame(rows, "case_id long, " + M.VECTOR)


def test_completed_cases_and_the_repository_are_searched(spark, monkeypatch):
    monkeypatch.setattr(M, "STEP", 7)
    all_cases = cases(spark)
    done, kept = all_cases.where("case_id % 3 > 0").select("case_id"), all_cases.where("case_id % 4 = 0")
    refs = M.candidates(spark, all_cases, done, kept).cache()
    assert {r.source: r.n for r in refs.groupBy("source").agg(F.count("*").alias("n")).collect()} == {0: 6, 1: 40, 2: 15}
    assert not refs.where("source = 1 AND is_fraud <> (trust_score < 70)").count()
    columns = [c for c in all_cases.columns if c != "case_id"]
    pairs = M.prefixed(all_cases, "a_").join(M.prefixed(refs, "b_"), F.col("a_case_id").cast("string") != F.col("b_ref_id"))
    scored = pairs.select("a_case_id", "b_ref_id", "b_source", "b_is_fraud", M.similarity("a_", "b_", columns).alias("s")).where("s >= 60").collect()
    want = set()
    for case in range(60):
        for label in (False, True):
            best = sorted((-r.s, r.b_source, r.b_ref_id) for r in scored if r.a_case_id == case and r.b_is_fraud == label)[:2]
            want |= {(case, ref, label, -s, k) for k, (s, _, ref) in enumerate(best, 1)}
    got = {tuple(r) for r in M.nearest(all_cases, refs).collect()}
    assert got == want and any(not r[1].startswith("ref-") for r in got)


def test_cases_of_other_or_no_context_are_neighbours(spark, monkeypatch):
    monkeypatch.setattr(M, "STEP", 7)
    monkeypatch.setattr(M, "PAIR_CELL", 13)
    some = cases(spark)
    columns = [c for c in some.columns if c != "case_id"]
    pairs = M.prefixed(some, "a_").join(M.prefixed(some, "b_"), F.col("a_case_id") < F.col("b_case_id"))
    want = {tuple(r) for r in pairs.select("a_case_id", "b_case_id", M.similarity("a_", "b_", columns).alias("s")).collect()}
    for least in (60, 99):
        assert {tuple(r) for r in M.neighbours(some, least).collect()} == {r for r in want if r[2] >= least}
    twins = spark.createDataFrame([(k, D(50), D(90), D(80), "iText", 1, True, c) for k, c in enumerate(["A", "B", None])], some.schema)
    assert M.neighbours(twins, 99).count() == 3
    assert M.neighbours(twins, 99, "context").count() == 0


def test_few_cases_leave_cells_empty(spark):
    one = cases(spark, 1)
    refs = M.candidates(spark, one, one, one)
    assert {r[1][:4] for r in M.nearest(one, refs).collect()} == {"ref-"}
    assert M.nearest(one.limit(0), refs).count() == M.neighbours(one).count() == 0


def test_differences_as_texts(spark):
    a = spark.createDataFrame([(1, D(90), D(80), D(100), "None", 1, True, "A"), (2, None, D(95), D(40), "None", 3, None, "A")], "case_id long, " + M.VECTOR)
    b = spark.createDataFrame([(D("74.9"), D(95), D(85), "None", 1, False, "A")], M.VECTOR)
    both = M.prefixed(a, "a_").join(M.prefixed(b, "b_"))
    found = {r[0]: r[1:] for r in both.select("a_case_id", M.difference_texts("a_", "b_", b.columns), M.differences("a_", "b_", b.columns), M.similarity("a_", "b_", b.columns)).collect()}
    assert found[1][0] == ["Trust Score varies by 15.1 points.", "Salary Consistency discrepancy: case has True, target reference has False."] and found[1][1] == ["trust_score", "salary_consistency"]
    assert found[2][0] == ["Metadata Score varies by 45.0 points.", "Revision Count varies by 2.0 points."]
    # No tool on either side is no tool in common: 100 less 6.04, 1.5, 2.25 and 10, and 10 for the context.
    assert found[1][2] == D("90.2")


def wide_cases(spark, n: int, seed: int):
    """Cases with all features, some missing, of any value; scores also beyond their span."""
    rng = random.Random(seed)
    some = lambda *values: rng.choice([*values, None])
    row = lambda k: (k, some(rng.uniform(-5, 110), rng.uniform(60, 80), float("nan")), some(rng.uniform(0, 100)), some(rng.uniform(0, 100), 80.0), some("None", "Canva", "iText", f"own {k % 7}"), some("None", "GIMP"),
                     some(1, 2, 9), some(True, False), some(rng.random(), 1.0), some(rng.random()), some("A", "B", f"C{k % 20}"))
    return spark.createDataFrame([row(k) for k in range(n)], "case_id long, trust_score double, ocr_confidence double, metadata_score double, pdf_producer string, editing_software string, revision_count int, salary_consistency boolean, identity_similarity double, employer_consistency double, context string")


def test_bounds_of_leaves_hold_for_every_pair(spark):
    names, rows = M.plain_features(wide_cases(spark, 150, 1), ["case_id"])
    # Seven leaves at random, so that they are mixed in every feature.
    sides = [rows.withColumn("leaf", F.pmod(F.xxhash64("case_id", F.lit(k)), F.lit(7)).cast("int") * (k + 1)) for k in (0, 1)]
    p, q = (M.leaves(d, names) for d in sides)
    M.ranked(p, q, names)
    for some in (slice(0, 3), slice(3, 7)):
        low, high = M.between(p, q, names, some)
        a, b = (d.toArrow() for d in sides)
        score = M.tenths(*M.arrays(a, b))
        of = [[list(s["leaf"]).index(c) for c in t["leaf"].to_pylist()] for s, t in ((p, a), (q, b))]
        for i, one in enumerate(of[0]):
            if some.start <= one < some.stop:
                for j, two in enumerate(of[1]):
                    assert low[one - some.start, two] <= score[i, j] <= high[one - some.start, two]


def test_search_and_pairs_over_split_regions(spark, monkeypatch):
    for name, value in (("STEP", 5), ("CELL", 9), ("PAIR_CELL", 9), ("REGIONS", (2, 3))):
        monkeypatch.setattr(M, name, value)
    cases = wide_cases(spark, 70, 2).cache()
    refs = cases.withColumnRenamed("case_id", "ref_id").withColumn("source", F.col("ref_id") % 2).withColumn("is_fraud", F.col("trust_score") < 60)
    names, rows = M.plain_features(cases, ["case_id"])
    table = rows.orderBy("case_id").toArrow()
    score = M.tenths(*M.arrays(table, table))
    fraud = {int(r.ref_id): bool(r.is_fraud) for r in refs.collect()}
    for k, least in ((2, 60), (3, 0)):
        want = set()
        for a in range(70):
            for label in (False, True):
                best = sorted((-int(score[a, b]), b % 2, str(b)) for b in range(70) if b != a and fraud[b] == label and score[a, b] >= 10 * least)[:k]
                want |= {(a, ref, label, D(-s) / 10, n) for n, (s, _, ref) in enumerate(best, 1)}
        *_, cells, _ = M.search(cases, refs, k, least)
        assert cells.number > 4 and cells.rows.max() > 1 and cells.columns.max() > 1 and cells.compared <= cells.all
        assert {tuple(r) for r in M.nearest(cases, refs, k, least).collect()} == want
    for least in (60, 85):
        found = [tuple(r) for r in M.neighbours(cases, least).collect()]
        assert len(found) == len(set(found))
        assert set(found) == {(a, b, D(int(score[a, b])) / 10) for a in range(70) for b in range(a + 1, 70) if score[a, b] >= 10 * least}


def test_leaves_that_cannot_match_do_not_meet(spark):
    cases = spark.range(2000).selectExpr("id AS case_id", "CAST(id % 100 AS DECIMAL(9,1)) AS trust_score", "CAST(id * 7 % 20 AS DECIMAL(9,1)) AS metadata_score", "id % 2 = 0 AS salary_consistency", "CAST(id % 4 AS STRING) AS context")
    *_, cells, _ = M.search(cases, cases.withColumnRenamed("case_id", "ref_id").withColumn("source", F.lit(1)).withColumn("is_fraud", F.col("trust_score") < 70), 2, 60)
    assert cells.compared < 0.5 * cells.all


def test_more_references_than_the_head_holds(spark, monkeypatch):
    cases = wide_cases(spark, 90, 5).cache()
    refs = cases.withColumnRenamed("case_id", "ref_id").withColumn("source", F.col("ref_id") % 2).withColumn("is_fraud", F.col("trust_score") < 60)
    refs = refs.union(refs.where("ref_id < 9")).cache()  # some twice
    want = {k: sorted(map(tuple, M.nearest(cases, refs, k, least).collect()), key=str) for k, least in ((2, 60), (3, 0))}
    for name, value in (("STEP", 5), ("HEAD", 20), ("CELL", 4)):
        monkeypatch.setattr(M, name, value)
    # Two leaves only, so that each holds far more than the first that go to the head.
    monkeypatch.setattr(M, "leaf", lambda columns: F.coalesce(F.col("salary_consistency").cast("int"), F.lit(0)))
    for k, least in ((2, 60), (3, 0)):
        assert sorted(map(tuple, M.nearest(cases, refs, k, least).collect()), key=str) == want[k]
    names, own, asked, known = M.sides(cases, refs, 2)
    head, after, rest = M.head_of(known, names, 4, 4)
    assert head.num_rows and set(after) and head.num_rows + rest.count() == known.count()


def test_rows_that_have_their_best_are_compared_no_more(monkeypatch):
    n, counted = 4000, []
    a = pa.table({"vector": [str(k) for k in range(600)], "leaf": pa.array([0] * 600, pa.int32()), "trust_score": [float(k % 100) for k in range(600)]})
    b = pa.table({"ref_id": [f"{k:05}" for k in range(n)], "source": pa.array([1] * n, pa.int32()), "is_fraud": [False] * n, "leaf": pa.array([0] * n, pa.int32()), "trust_score": [float(k * 7 % 100) for k in range(n)]})
    summary = {"leaf": np.array([0]), "min_trust_score": np.array([0.0]), "max_trust_score": np.array([99.0])}
    near = M.Near(*({**summary, "n": np.array([m]), "count_trust_score": np.array([m])} for m in (600, n)), ["trust_score"])
    exact = M.tenths
    monkeypatch.setattr(M, "tenths", lambda x, y: counted.append(len(x["trust_score"]) * len(y["trust_score"])) or exact(x, y))
    found = M.best_of(a, b, near, {0: [600, 600]}, 4)
    assert sum(counted) <= 600 * 2 * M.STEP  # all 4,000 were compared before, as later ones may be as much alike
    score = exact(*M.arrays(a, b))
    want = {(str(i), f"{j:05}", int(score[i, j])) for i in range(600) for j in np.lexsort((np.arange(n), -score[i]))[:4]}
    assert {(r["vector"], r["ref_id"], r["tenths"]) for r in found.to_pylist()} == want


def test_rows_are_sent_to_few_cells(spark, monkeypatch):
    """Each row goes to as many cells as the other side has of a bounded size, and only to those of its own value."""
    some = spark.range(3000).selectExpr("id AS case_id", "CAST(id % 100 AS DECIMAL(9,1)) AS trust_score", "CAST(id % 5 AS STRING) AS context")
    sent, yielded = [], []
    pairs = M.Cells.pairs

    def watched(self, rows, key, work, schema):
        sent.append((self.rows * self.columns).sum())
        yielded.append(work)
        return pairs(self, rows, key, work, schema)

    monkeypatch.setattr(M.Cells, "pairs", watched)
    assert M.neighbours(some, 99, "context").count() == M.neighbours(some, 99).where("case_id % 5 = other_id % 5").count()
    assert max(sent) <= 16  # 3 in each direction for every 1,000 rows of a region before
    names, rows = M.plain_features(some, ["case_id"])
    table = rows.withColumn("leaf", M.leaf(names)).withColumn("_within", F.lit("x")).toArrow()
    batches = [b.num_rows for b in yielded[0](table, table)]
    assert sum(batches) and max(batches) <= M.STEP**2  # all pairs of a cell were one table before
