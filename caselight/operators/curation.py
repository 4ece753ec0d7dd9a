"""What users do to cases: analyse them again, approve them as references, toggle baselines, delete them, promote them.

Each operator returns the change set of a store with the tables cases, documents, findings, evidence, events and
repository; committed, all of its tables change together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.store import CaseStore, Change
from .cases import shown_title

CHILDREN = ("documents", "findings", "evidence", "events")
#: Kinds of events and what they say.
RESTARTED = ("ANALYSIS_RESTARTED", "Investigation analysis has been restarted.")
APPROVED = ("REFERENCE_APPROVED", "This case was manually approved and committed to the local forensic reference repository as a trusted baseline.")
ADDED = ("REFERENCE_APPROVED", "This case was committed to the local forensic reference repository as a trusted baseline.")
REMOVED = ("REFERENCE_REMOVED", "This case was removed from the local forensic reference repository.")
PROMOTED = ("AUTO_BASELINE_PROMOTED", "Case automatically registered to the Reference Database based on high trust score.")


def events_of(ids: DataFrame, event: tuple[str, str], at: Column | str) -> DataFrame:
    """(case_id, ts, event_type, message): one event for each case."""
    return ids.select("case_id", F.lit(at).cast("timestamp").alias("ts"), F.lit(event[0]).alias("event_type"), F.lit(event[1]).alias("message"))


def chosen(store: CaseStore, ids: DataFrame, completed: bool = True) -> DataFrame:
    """The rows of the cases named by ``ids`` (case_id); completed: only of those that are."""
    rows = store.read("cases").join(ids.select("case_id").distinct(), "case_id", "left_semi")
    return rows.where("status = 'COMPLETED'") if completed else rows


def reference_rows(cases: DataFrame, features: DataFrame, documents: DataFrame) -> DataFrame:
    """Entries of the repository: features, title, context, time of approval and number of documents of each case."""
    counts = documents.groupBy("case_id").agg(F.count("*").alias("document_count"))
    meta = cases.select("case_id", shown_title(F.col("title"), F.col("context")).alias("title"), F.col("context").alias("case_context"), F.col("updated_at").cast("timestamp").alias("approved_at"))
    return meta.join(features, "case_id").join(counts, "case_id", "left").withColumn("document_count", F.coalesce("document_count", F.lit(0)).cast("long"))


def analysed_again(store: CaseStore, findings: DataFrame, evidence: DataFrame, ids: DataFrame, at: Column | str) -> list[Change]:
    """The findings and evidence of the cases in ``ids`` replaced by those given (of other cases none are taken); events stay, with one more."""
    mine = lambda rows: rows.join(ids.select("case_id").distinct(), "case_id", "left_semi")
    known = chosen(store, ids, completed=False).select("case_id")
    return [Change("findings", ids, mine(findings)), Change("evidence", ids, mine(evidence)), Change("events", add=events_of(known, RESTARTED, at))]


def approved(store: CaseStore, ids: DataFrame, features: DataFrame, at: Column | str) -> list[Change]:
    """Completed cases of ``ids`` put into the repository, in place of older entries of theirs; others are left alone."""
    cases = chosen(store, ids)
    return [Change("repository", cases, reference_rows(cases, features, store.read("documents"))), Change("events", add=events_of(cases, APPROVED, at))]


def toggled(store: CaseStore, ids: DataFrame, features: DataFrame, at: Column | str) -> list[Change]:
    """Completed cases of ``ids`` made baselines, and in the repository, if they were not; taken out of both if they were."""
    cases = chosen(store, ids).withColumn("is_baseline", ~F.coalesce("is_baseline", F.lit(False)))
    new, old = cases.where("is_baseline"), cases.where("NOT is_baseline")
    events = events_of(new, ADDED, at).unionByName(events_of(old, REMOVED, at))
    return [Change("cases", cases, cases), Change("repository", cases, reference_rows(new, features, store.read("documents"))), Change("events", add=events)]


def promoted(store: CaseStore, features: DataFrame, at: Column | str, least: float = 85.0) -> list[Change]:
    """Completed cases of enough trust made baselines and put into the repository; of those in it the entry is renewed."""
    cases = store.read("cases").where((F.col("status") == "COMPLETED") & (F.col("trust_score") >= least)).withColumn("is_baseline", F.lit(True))
    return [Change("cases", cases, cases), Change("repository", cases, reference_rows(cases, features, store.read("documents"))), Change("events", add=events_of(cases, PROMOTED, at))]


def deleted(store: CaseStore, ids: DataFrame) -> list[Change]:
    """The cases of ``ids`` gone from all tables; from the repository only those that are baselines."""
    baselines = chosen(store, ids, completed=False).where("is_baseline")
    return [Change("repository", baselines), *(Change(t, ids) for t in ("cases", *CHILDREN))]
