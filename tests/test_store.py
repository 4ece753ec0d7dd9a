"""The store of cases: what commits do, and what is left if they die."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from caselight.functions.folders import shared_folder
from caselight.operators import curation as C
from caselight.sources.store import CaseStore, Change, Overtaken

FINDINGS = "case_id long, name string"
AT = "2024-05-06 07:08:09"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def findings(spark, *found):
    return spark.createDataFrame(list(found), FINDINGS)


@pytest.fixture
def store(spark):
    out = CaseStore.create(spark, shared_folder(spark, "store"), {"findings": findings(spark).schema}, buckets=3)
    out.commit(Change("findings", add=findings(spark, (1, "a"), (1, "a"), (2, "b"), (None, "n"))))
    return out


def test_append_and_replace(spark, store):
    store.commit(Change("findings", add=findings(spark, (3, "c"))))
    for _ in range(2):  # again gives the same
        store.commit(Change("findings", findings(spark, (1, "x"), (9, "x"), (None, "x")), findings(spark, (1, "new"))))
        assert rows(store.read("findings")) == sorted([(1, "new"), (2, "b"), (3, "c"), (None, "n")], key=str)
    assert rows(store.read("findings", version=1)) == sorted([(1, "a"), (1, "a"), (2, "b"), (None, "n")], key=str)
    assert store.clean() > 0 and rows(store.read("findings")) == sorted([(1, "new"), (2, "b"), (3, "c"), (None, "n")], key=str)
    assert store.clean() == 0


def test_what_is_staged_is_not_seen(spark, store):
    before = rows(store.read("findings"))
    store.stage(Change("findings", findings(spark, (2, "x"))))  # and the job dies here
    assert rows(CaseStore(spark, store.folder).read("findings")) == before and store.version() == 1


def test_a_write_that_fails_leaves_all_as_it_was(spark, store):
    before = rows(store.read("findings"))
    bad = findings(spark, (7, "y")).withColumn("name", F.raise_error(F.lit("broken")).cast("string"))
    with pytest.raises(Exception, match="broken"):
        store.commit(Change("findings", findings(spark, (1, "x"))), Change("findings", add=bad))
    assert rows(store.read("findings")) == before


def test_only_one_of_two_writers_publishes(spark, store):
    first, second = (store.stage(Change("findings", add=findings(spark, (k, "w")))) for k in (5, 6))
    store.publish(second)
    with pytest.raises(Overtaken):
        store.publish(first)
    with pytest.raises(Overtaken):
        store._write(2, {})
    assert (6, "w") in rows(store.read("findings")) and (5, "w") not in rows(store.read("findings"))


def test_buckets_that_lose_all_rows(spark, store):
    store.commit(Change("findings", findings(spark, (1, ""), (2, ""))))
    assert rows(store.read("findings")) == [(None, "n")]
    store.commit(Change("findings", add=findings(spark)))
    assert rows(store.read("findings")) == [(None, "n")]


def test_untouched_buckets_keep_their_files(spark, store):
    before = store.state()["tables"]["findings"]
    store.commit(Change("findings", findings(spark, (2, ""))))
    after = store.state()["tables"]["findings"]
    assert sum(after.get(b) != runs for b, runs in before.items()) == 1


@pytest.fixture
def cases(spark):
    tables = {
        "cases": spark.createDataFrame([(1, "COMPLETED", "Loan", None, 90.0, False), (2, "COMPLETED", "Loan", "T", 40.0, True), (3, "PENDING", "KYC", "U", 99.0, None), (4, "COMPLETED", "Loan", "", None, None)], "case_id long, status string, context string, title string, trust_score double, is_baseline boolean").withColumn("updated_at", F.lit("2024-01-01").cast("timestamp")),
        "documents": spark.createDataFrame([(1, 10), (1, 11), (2, 20), (3, 30)], "case_id long, doc_id long"),
        "findings": findings(spark, (1, "a"), (2, "b"), (3, "c")),
        "evidence": findings(spark, (1, "e"), (3, "f")),
        "events": spark.createDataFrame([], "case_id long, ts timestamp, event_type string, message string"),
        "repository": spark.createDataFrame([], "case_id long, title string, case_context string, approved_at timestamp, ocr double, document_count long"),
    }
    out = CaseStore.create(spark, shared_folder(spark, "store"), {n: t.schema for n, t in tables.items()}, buckets=2)
    out.commit(*(Change(n, add=t) for n, t in tables.items()))
    return out


def features(spark):
    return spark.createDataFrame([(k, k * 10.0) for k in range(1, 5)], "case_id long, ocr double")


def ids(spark, *numbers):
    return spark.createDataFrame([(n,) for n in numbers], "case_id long")


def told(store):
    return [(r.case_id, r.event_type) for r in store.read("events").orderBy("case_id", "event_type").collect()]


def test_approve(spark, cases):
    for _ in range(2):
        cases.commit(*C.approved(cases, ids(spark, 1, 3, 77), features(spark), AT))
    assert [(r.case_id, r.title, r.ocr, r.document_count) for r in cases.read("repository").collect()] == [(1, "Investigation: Loan", 10.0, 2)]
    assert told(cases) == [(1, "REFERENCE_APPROVED")] * 2


def test_toggle(spark, cases):
    cases.commit(*C.toggled(cases, ids(spark, 1, 2, 3, 4), features(spark), AT))
    assert {(r.case_id, r.is_baseline) for r in cases.read("cases").collect()} == {(1, True), (2, False), (3, None), (4, True)}
    assert {r.case_id for r in cases.read("repository").collect()} == {1, 4}
    assert told(cases) == [(1, "REFERENCE_APPROVED"), (2, "REFERENCE_REMOVED"), (4, "REFERENCE_APPROVED")]
    cases.commit(*C.toggled(cases, ids(spark, 1), features(spark), AT))
    assert {r.case_id for r in cases.read("repository").collect()} == {4}


def test_promote(spark, cases):
    cases.commit(*C.promoted(cases, features(spark), AT))
    assert {r.case_id for r in cases.read("repository").collect()} == {1} == {c for c, _ in told(cases)}
    assert {r.case_id for r in cases.read("cases").where("is_baseline").collect()} == {1, 2} and cases.read("cases").count() == 4


def test_delete_leaves_no_orphans(spark, cases):
    cases.commit(*C.approved(cases, ids(spark, 1), features(spark), AT))
    cases.commit(*C.deleted(cases, ids(spark, 1, 3)))
    assert all({r.case_id for r in cases.read(t).collect()} <= {2, 4} for t in ("cases", "documents", "findings", "evidence", "events"))
    assert {r.case_id for r in cases.read("repository").collect()} == {1}  # approved, but no baseline: its entry stays


def test_analysed_again(spark, cases):
    new, proof = findings(spark, (1, "z"), (2, "not asked for")), findings(spark, (1, "p"))
    for _ in range(2):
        cases.commit(*C.analysed_again(cases, new, proof, ids(spark, 1, 3), AT))
    assert rows(cases.read("findings")) == [(1, "z"), (2, "b")] and rows(cases.read("evidence")) == [(1, "p")]
    assert told(cases) == [(1, "ANALYSIS_RESTARTED")] * 2 + [(3, "ANALYSIS_RESTARTED")] * 2
