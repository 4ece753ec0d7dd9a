"""Which detectors run over which documents: by the rules of a case's context, the type of a document, and its text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from ..functions.money import amounts
from . import detectors as D, statements as S
from .cases import rules_of

#: Detectors, the type of document that each is for (none: all), and the contexts that it is for (none: all with rules).
GATES = [
    ("bank_balance", "Bank Statement", None),
    ("payslip_math", "Payslip", None),
    ("lease_signals", None, ["mortgage underwriting", "tenant screening"]),
]


def gated(cases: DataFrame, documents: DataFrame) -> DataFrame:
    """(case_id, doc_id, text, detector): a row for each detector that a document is to be held against.

    cases (case_id, context), documents (case_id, doc_id, classification, text). A case whose context has no rules has
    no rows, nor has a document without text. Nulls: a document without a type passes no gate that asks for one.
    """
    ruled = cases.select("case_id", F.lower("context").alias("context"), F.explode(rules_of(F.col("context"))).alias("rule")).select("case_id", "context").distinct()
    docs = documents.where("text <> ''").join(ruled, "case_id")
    passed = []
    for name, kind, contexts in GATES:
        ok = F.lit(True)
        if kind:
            ok = ok & (F.col("classification") == kind)
        if contexts:
            ok = ok & F.col("context").isin(contexts)
        passed.append(F.when(ok, F.lit(name)))
    return docs.select("case_id", "doc_id", "text", F.explode(F.array_compact(F.array(*passed))).alias("detector"))


def bank_balance(docs: DataFrame) -> DataFrame:
    return S.balance_findings(S.statement_rows(docs))


def payslip_math(docs: DataFrame) -> DataFrame:
    return D.payslip_math(docs).where("mismatch").select("doc_id", F.lit("Altered Payslip Math").alias("name"), F.lit("HIGH").alias("severity"))


def lease_signals(docs: DataFrame, as_of: str | None = None) -> DataFrame:
    """Signals of the text, and that of amounts that do not add up, with their names and severities in the catalogue."""
    sequence = docs.select("doc_id", F.posexplode(amounts(F.col("text"))).alias("pos", "amount"))
    odd = S.triple_check(sequence).where("flagged").select("doc_id", F.lit("altered_bank_math").alias("signal"))
    found = D.lease_signals(docs, as_of).unionByName(odd)
    return found.join(F.broadcast(D.catalogue(docs.sparkSession)), "signal").select("doc_id", "name", "severity")  # 34 rows


def context_findings(cases: DataFrame, documents: DataFrame, as_of: str | None = None) -> DataFrame:
    """(case_id, doc_id, layer_source, name, severity) of all detectors, each over the documents that its gate lets through.

    doc_id tells a document. as_of: the day against which the age of documents is held; without it none is too old.
    """
    registry: dict[str, Callable[[DataFrame], DataFrame]] = {"bank_balance": bank_balance, "payslip_math": payslip_math, "lease_signals": lambda docs: lease_signals(docs, as_of)}
    through, out = gated(cases, documents), None
    for name, _, _ in GATES:
        found = registry[name](through.where(F.col("detector") == name))
        out = found if out is None else out.unionByName(found)
    named = documents.select("doc_id", "case_id")
    return out.join(named, "doc_id").select("case_id", "doc_id", F.lit("CONTEXT").alias("layer_source"), "name", "severity")
