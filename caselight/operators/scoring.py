"""Scores of cases from their findings, and what the scores lead to."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F

#: Points that a finding takes off, factors of where it comes from, and the most that a severity takes off.
DEDUCTIONS = {"CRITICAL": "50", "HIGH": "35", "MEDIUM": "17.5", "LOW": "7.5"}
FACTORS = {"FORENSIC": "1.0", "CROSS_DOC": "0.9", "CONTEXT": "0.8", "KNN": "0.5"}
CAPS = {"MEDIUM": 50, "LOW": 25}
BONUS = 5
APPROVE_FROM, RISK_BELOW = 85, 50


def _choose(c: Column, values: dict[str, str], other: str | None) -> Column:
    out = F.lit(Decimal(other)) if other is not None else F.lit(None)
    for k, v in values.items():
        out = F.when(c == k, F.lit(Decimal(v))).otherwise(out)
    return out.cast("decimal(9,2)")


def trust_scores(findings: DataFrame, expected: int | None = None, documents: DataFrame | None = None) -> DataFrame:
    """(case_id, trust_score): 100 less the weighted deductions, plus bonuses, within 0 and 100, half-even to one place.

    A finding of unknown severity is counted in ``unknown`` and takes nothing off. With ``documents`` (case_id,
    n_documents) and ``expected``, a case with enough documents gets a bonus. Sums are combined before the shuffle.
    """
    severity = F.upper("severity")
    points = _choose(severity, DEDUCTIONS, None) * _choose(F.col("layer_source"), FACTORS, "1.0")
    sums = {s: F.coalesce(F.sum(F.when(severity == s, points)), F.lit(Decimal(0))).cast("decimal(18,4)") for s in DEDUCTIONS}
    taken = sum((F.least(v, F.lit(Decimal(CAPS[s]))) if s in CAPS else v for s, v in sums.items()), F.lit(Decimal(0)))
    cross = F.count_if(F.col("layer_source") == "CROSS_DOC")
    bad = F.count_if((F.col("layer_source") == "CROSS_DOC") & severity.isin("HIGH", "MEDIUM"))
    clean = F.when((cross > 0) & (bad == 0), F.lit(BONUS)).otherwise(F.lit(0))
    rows = findings.groupBy("case_id").agg((F.lit(Decimal(100)) - taken + clean).alias("raw"), F.count_if(~severity.isin(*DEDUCTIONS)).alias("unknown"))
    raw = F.col("raw")
    if documents is not None and expected is not None:
        rows = rows.join(documents, "case_id", "left")
        raw = raw + F.when(F.col("n_documents") >= expected, F.lit(BONUS)).otherwise(F.lit(0))
    held = F.greatest(F.lit(Decimal(0)), F.least(F.lit(Decimal(100)), raw)).cast("decimal(18,4)")
    return rows.select("case_id", F.bround(held, 1).cast("decimal(9,1)").alias("trust_score"), "unknown")


def recommendation(score: Column, auto_approve: bool = True, approve_from: float = APPROVE_FROM) -> Column:
    return F.when(F.lit(auto_approve) & (score >= approve_from), "AUTO_APPROVE").when(score < RISK_BELOW, "HIGH_RISK_MANUAL_REVIEW").otherwise("MANUAL_REVIEW")


def confidence(ocr: Column, entity: Column, clarity: Column, missing: Column, poor: Column) -> Column:
    """0.4 OCR, 0.4 entities, 0.2 evidence, less 20 for missing documents and 10 for a poor image; within 0 and 100, half-even."""
    d = lambda x: F.lit(Decimal(x))
    raw = d("0.4") * ocr + d("0.4") * entity + d("0.2") * clarity - F.when(missing, d("20")).otherwise(d("0")) - F.when(poor, d("10")).otherwise(d("0"))
    return F.bround(F.greatest(d("0"), F.least(d("100"), raw)).cast("decimal(18,4)"), 1).cast("decimal(9,1)")


def ocr_quality(docs: DataFrame) -> DataFrame:
    """(case_id, ocr_quality, poor): documents without text count 0, scanned ones their confidence, others 100."""
    value = F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, 0).when(F.col("is_scanned"), F.col("ocr_confidence")).otherwise(100)
    return docs.groupBy("case_id").agg(F.avg(value).alias("ocr_quality"), F.bool_or(F.col("is_scanned") & (F.col("ocr_confidence") < 60)).alias("poor"))


def evidence_clarity(cases: DataFrame, evidence: DataFrame) -> DataFrame:
    """(case_id, clarity): mean confidence of a case's evidence in percent, 100 without any."""
    return cases.join(evidence.groupBy("case_id").agg(F.avg(F.col("confidence") * 100).alias("c")), "case_id", "left").select("case_id", F.coalesce("c", F.lit(100.0)).alias("clarity"))


def direct_risk(findings: DataFrame, key: str = "case_id") -> DataFrame:
    """(key, probability, status) of one document by its number of findings, 15 points each."""
    p = F.least(F.lit(100), F.col("n") * 15)
    return findings.groupBy(key).agg(F.count("*").alias("n")).select(key, p.alias("probability"), F.when(p <= 40, "LOW").when(p < 70, "MEDIUM").otherwise("HIGH").alias("status"))


#: The entities expected of each type; other types are expected to show a name.
EXPECTED = {
    "PAN": ["name", "dob", "pan"], "Aadhaar": ["name", "dob", "aadhaar"], "Payslip": ["name", "salary", "employer"], "Property Record": ["property_id", "property_owner"],
    "Bank Statement": ["account_number", "name"], "Utility Bill": ["address", "name"], "Lease Agreement": ["address", "name"],
}


def completeness(entities: DataFrame) -> DataFrame:
    """(case_id, completeness): mean share of expected entities that are present, in percent; an entity without a column is never present."""
    present = lambda k: F.col(k).isNotNull().cast("int") if k in entities.columns else F.lit(0)
    share = present("name").cast("double")
    for kind, keys in EXPECTED.items():
        share = F.when(F.col("classification") == kind, sum((present(k) for k in keys), F.lit(0)) / len(keys)).otherwise(share)
    return entities.groupBy("case_id").agg(F.avg(share * 100).alias("completeness"))


def finding_groups(findings: DataFrame) -> DataFrame:
    """Counts of kinds of findings per case and the sorted names of mismatches."""
    low = F.lower("name")
    return findings.groupBy("case_id").agg(
        F.count_if(low.contains("identity") | low.contains("name")).alias("identity"),
        F.count_if(low.rlike("math|balance|salary")).alias("financial"),
        F.count_if(F.col("layer_source") == "FORENSIC").alias("forensic"),
        F.array_sort(F.collect_set(F.when(low.contains("mismatch"), F.col("name")))).alias("mismatches"),
    )


def snapshot(cases: DataFrame, generated_at: str) -> DataFrame:
    """(case_id, line): the portfolio as lines of JSON: a head with totals (case_id null), then a line for each case.

    cases: case_id, title, context, status, trust_score, recommendation. Lines are for ``write.text``, so nothing holds
    the list whole; a completed case that is not approved automatically counts for manual review, one without a
    recommendation too.
    """
    done = F.col("status") == "COMPLETED"
    approved = F.coalesce(F.col("recommendation") == "AUTO_APPROVE", F.lit(False))
    totals = cases.agg(F.count("*").alias("total_investigations"), F.count_if(done).alias("completed"), F.count_if(done & approved).alias("auto_approved"), F.count_if(done & ~approved).alias("manual_review"))
    whole = {"ignoreNullFields": "false"}
    head = totals.select(F.lit(None).cast(cases.schema["case_id"].dataType).alias("case_id"), F.to_json(F.struct(F.lit(generated_at).alias("generated_at"), *totals.columns), whole).alias("line"))
    return head.unionByName(cases.select("case_id", F.to_json(F.struct(F.col("case_id").alias("id"), "title", "context", "status", "trust_score", "recommendation"), whole).alias("line")))


def portfolio(cases: DataFrame, today: str) -> DataFrame:
    """One row of figures over all cases; ``today`` as yyyy-MM-dd."""
    done = F.col("status") == "COMPLETED"
    t = F.col("trust_score")
    return cases.agg(
        F.count("*").alias("total"),
        F.count_if(F.to_date("created_at") == F.lit(today).cast("date")).alias("created_today"),
        F.count_if(done & (t >= 80)).alias("verified"),
        F.count_if(done & (t >= 50) & (t < 80)).alias("suspicious"),
        F.count_if(done & (t < 50)).alias("fraudulent"),
        F.round(F.avg(F.when(done, t.cast("double"))), 6).alias("mean_trust"),
    )
