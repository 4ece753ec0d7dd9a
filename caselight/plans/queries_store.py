"""Queries on a store of cases: appends, analyses run again, approvals, baselines, deletions, promotions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.folders import shared_folder
from ..operators import curation as C
from ..sources.store import CaseStore, Change
from .registry import register

AT = "2024-01-02 03:04:05"
REPOSITORY = "case_id long, title string, case_context string, approved_at timestamp, trust_score decimal(9,1), pdf_producer string, context string, document_count long"


def _tables(t) -> dict[str, DataFrame]:
    cases = t.cases.select("case_id", "owner_id", F.col("created_at").alias("updated_at"), "status", "context", "title", "trust_score", "is_baseline")
    return {
        "cases": cases,
        "documents": t.kyc.select("case_id", "doc_id", "name", "pan"),
        "findings": t.findings,
        "evidence": t.evidence,
        "events": t.case_events.select("case_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", F.col("status").alias("message")),
    }


def _features(t) -> DataFrame:
    return t.features.select("case_id", "trust_score", "pdf_producer", "context")


def _store(t, only: tuple[str, ...] = ()) -> CaseStore:
    """A store with all rows of the tables, committed at once."""
    tables = {n: rows for n, rows in _tables(t).items() if not only or n in only}
    empty = t.spark.createDataFrame([], REPOSITORY)
    store = CaseStore.create(t.spark, shared_folder(t.spark, "case-store"), {n: rows.schema for n, rows in {**tables, "repository": empty}.items()}, buckets=8)
    store.commit(*(Change(n, add=rows) for n, rows in tables.items()))
    return store


def _appended(t) -> DataFrame:
    """S12: findings appended in two commits."""
    store = CaseStore.create(t.spark, shared_folder(t.spark, "case-store"), {"findings": t.findings.schema})
    store.commit(Change("findings", add=t.findings.where("seq <= 2")))
    store.commit(Change("findings", add=t.findings.where("seq > 2")))
    return store.read("findings")


register("s12_append_findings", _appended, "SELECT case_id, severity, layer_source, name, seq FROM <findings>")


def _again(t) -> CaseStore:
    """S13: pending cases analysed again, twice; now only what is worse than LOW is found."""
    store = _store(t)
    ids, worse = t.cases.where("status = 'PENDING'").select("case_id"), t.findings.where("severity <> 'LOW'")
    for _ in range(2):
        store.commit(*C.analysed_again(store, worse, t.evidence.where("page = 1"), ids, AT))
    return store


_PENDING = "SELECT case_id FROM <cases> WHERE status = 'PENDING'"
register("s13_rerun_findings", lambda t: _again(t).read("findings"), f"SELECT case_id, severity, layer_source, name, seq FROM <findings> WHERE severity <> 'LOW' OR case_id NOT IN ({_PENDING})")
register("s13_rerun_events", lambda t: _again(t).read("events").groupBy("event_type", "message").agg(F.count("*").alias("n"), F.countDistinct("case_id").alias("cases")),
         f"""SELECT event_type, message, count(*) AS n, count(DISTINCT case_id) AS cases FROM (SELECT case_id, event_type, status AS message FROM <case_events>
 UNION ALL SELECT p.case_id, 'ANALYSIS_RESTARTED', 'Investigation analysis has been restarted.' FROM ({_PENDING}) p, range(2)) GROUP BY 1, 2""")

_ENTRY = "SELECT c.case_id, coalesce(nullif(title, ''), 'Investigation: ' || c.context) AS title, c.context AS case_context, CAST(created_at AS TIMESTAMP) AS approved_at, f.trust_score, f.pdf_producer, f.context, (SELECT count(*) FROM <kyc> d WHERE d.case_id = c.case_id) AS document_count FROM <cases> c JOIN <features> f ON c.case_id = f.case_id WHERE c.status = 'COMPLETED'"


def _approved(t) -> DataFrame:
    store = _store(t)
    store.commit(*C.approved(store, t.cases.select("case_id"), _features(t), AT))
    return store.read("repository")


def _toggled(t) -> DataFrame:
    """All cases toggled, after all were approved: what was a baseline leaves the repository."""
    store = _store(t)
    for step in (C.approved, C.toggled):
        store.commit(*step(store, t.cases.select("case_id"), _features(t), AT))
    kept = store.read("repository").select("case_id", "document_count")
    events = store.read("events").where("ts = '2024-01-02 03:04:05'").groupBy("case_id").agg(F.array_sort(F.collect_list("event_type")).alias("told"))
    return store.read("cases").select("case_id", "is_baseline").join(kept, "case_id", "left").join(events, "case_id", "left")


def _deleted(t) -> DataFrame:
    """Rows left in each table after all pending and completed cases are deleted."""
    store = _store(t)
    store.commit(*C.approved(store, t.cases.select("case_id"), _features(t), AT))
    store.commit(*C.deleted(store, t.cases.where("status <> 'PROCESSING'").select("case_id")))
    names = ("cases", "documents", "findings", "evidence", "events", "repository")
    parts = [store.read(n).groupBy(F.lit(n).alias("name")).agg(F.count("*").alias("n"), F.sum("case_id").cast("long").alias("total")) for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _promoted(t) -> DataFrame:
    store = _store(t)
    store.commit(*C.promoted(store, _features(t), AT))
    told = store.read("events").where("event_type = 'AUTO_BASELINE_PROMOTED'").select("case_id", F.lit(True).alias("told"))
    rows = store.read("cases").where("is_baseline").select("case_id", "trust_score")
    return rows.join(told, "case_id", "left").join(store.read("repository").select("case_id", "document_count", "title"), "case_id", "left")


register("k8_approve_cases", _approved, _ENTRY)
register("k8_toggle_baseline", _toggled, f"""WITH e AS ({_ENTRY}) SELECT c.case_id, CASE WHEN status = 'COMPLETED' THEN NOT is_baseline ELSE is_baseline END AS is_baseline, CASE WHEN NOT is_baseline THEN e.document_count END AS document_count,
 CASE WHEN status = 'COMPLETED' THEN CASE WHEN is_baseline THEN ['REFERENCE_APPROVED', 'REFERENCE_REMOVED'] ELSE ['REFERENCE_APPROVED', 'REFERENCE_APPROVED'] END END AS told FROM <cases> c LEFT JOIN e ON c.case_id = e.case_id""")
_LEFT = "case_id NOT IN (SELECT case_id FROM <cases> WHERE status <> 'PROCESSING')"
register("k8_delete_cascade", _deleted, " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n, CAST(sum(case_id) AS BIGINT) AS total FROM {rows} x WHERE {_LEFT} HAVING count(*) > 0" for n, rows in {"cases": "<cases>", "documents": "<kyc>", "findings": "<findings>", "evidence": "<evidence>"}.items())
         + f" UNION ALL SELECT 'events', count(*), CAST(sum(case_id) AS BIGINT) FROM <case_events> x WHERE {_LEFT} HAVING count(*) > 0 UNION ALL SELECT 'repository', count(*), CAST(sum(case_id) AS BIGINT) FROM ({_ENTRY}) x WHERE case_id NOT IN (SELECT case_id FROM <cases> WHERE is_baseline) HAVING count(*) > 0")
register("k9_promote", _promoted, f"""WITH e AS ({_ENTRY}) SELECT c.case_id, c.trust_score, CASE WHEN c.status = 'COMPLETED' AND c.trust_score >= 85 THEN true END AS told, CASE WHEN c.trust_score >= 85 THEN e.document_count END AS document_count, CASE WHEN c.trust_score >= 85 THEN e.title END AS title
 FROM <cases> c LEFT JOIN e ON c.case_id = e.case_id WHERE is_baseline OR (c.status = 'COMPLETED' AND c.trust_score >= 85)""")
