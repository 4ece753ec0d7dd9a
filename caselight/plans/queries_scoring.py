"""Queries that score cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import entities as E
from ..operators import classify as C, scoring as S
from .registry import register

_POINTS = "CASE severity WHEN 'CRITICAL' THEN 50 WHEN 'HIGH' THEN 35 WHEN 'MEDIUM' THEN 17.5 ELSE 7.5 END * CASE layer_source WHEN 'FORENSIC' THEN 1.0 WHEN 'CROSS_DOC' THEN 0.9 WHEN 'CONTEXT' THEN 0.8 ELSE 0.5 END"


def _sum(s: str) -> str:
    return f"coalesce(sum(CASE WHEN severity = '{s}' THEN CAST({_POINTS} AS DECIMAL(18,4)) END), 0)"


SCORED = f"""SELECT case_id, CAST(round_even(greatest(0, least(100, CAST(100 - {_sum('CRITICAL')} - {_sum('HIGH')} - least({_sum('MEDIUM')}, 50) - least({_sum('LOW')}, 25)
 + CASE WHEN count(*) FILTER (layer_source = 'CROSS_DOC') > 0 AND count(*) FILTER (layer_source = 'CROSS_DOC' AND severity IN ('HIGH','MEDIUM')) = 0 THEN 5 ELSE 0 END AS DECIMAL(18,4)))), 1) AS DECIMAL(9,1)) AS trust_score, CAST(0 AS BIGINT) AS unknown FROM <findings> GROUP BY case_id"""


def scored(t):
    return S.trust_scores(t.findings)


register("a1_trust_score", scored, SCORED)
register("a2_recommendation", lambda t: scored(t).select("case_id", S.recommendation(F.col("trust_score")).alias("recommendation")), f"SELECT case_id, CASE WHEN trust_score >= 85 THEN 'AUTO_APPROVE' WHEN trust_score < 50 THEN 'HIGH_RISK_MANUAL_REVIEW' ELSE 'MANUAL_REVIEW' END AS recommendation FROM ({SCORED})")
register("a3_confidence", lambda t: t.features.select("case_id", S.confidence(F.col("ocr_confidence"), F.col("metadata_score"), F.col("trust_score"), F.col("case_id") % 5 == 0, F.col("case_id") % 7 == 0).alias("confidence")),
         "SELECT case_id, CAST(round_even(CAST(greatest(0, least(100, 0.4 * ocr_confidence + 0.4 * metadata_score + 0.2 * trust_score - CASE WHEN case_id % 5 = 0 THEN 20 ELSE 0 END - CASE WHEN case_id % 7 = 0 THEN 10 ELSE 0 END)) AS DECIMAL(18,4)), 1) AS DECIMAL(9,1)) AS confidence FROM <features>")


def _read(t):
    docs = t.kyc.withColumns({"is_scanned": F.col("doc_id") % 2 == 0, "ocr_confidence": (F.col("doc_id") * 37 % 101).cast("int"), "text": F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("text"))})
    return S.ocr_quality(docs)


_READ = "SELECT case_id, avg(CASE WHEN doc_id % 10 = 0 THEN 0 WHEN doc_id % 2 = 0 THEN doc_id * 37 % 101 ELSE 100 END) AS ocr_quality, bool_or(doc_id % 2 = 0 AND doc_id * 37 % 101 < 60) AS poor FROM <kyc> GROUP BY case_id"
register("a4_ocr_quality", lambda t: _read(t).select("case_id", "ocr_quality"), f"SELECT case_id, ocr_quality FROM ({_READ})")
register("a6_poor_image", lambda t: _read(t).select("case_id", "poor"), f"SELECT case_id, poor FROM ({_READ})")
register("a5_evidence_clarity", lambda t: S.evidence_clarity(t.orders.select(F.col("o_orderkey").alias("case_id")), t.findings.where("severity <> 'LOW'").select("case_id", F.when(F.col("seq") % 2 == 0, 0.95).otherwise(0.80).alias("confidence"))).select("case_id", F.round("clarity", 6).alias("clarity")),
         "SELECT o_orderkey AS case_id, round(coalesce(c, 100.0), 6) AS clarity FROM orders LEFT JOIN (SELECT case_id, avg(CAST(CASE WHEN seq % 2 = 0 THEN 0.95 ELSE 0.80 END AS DOUBLE) * 100) AS c FROM <findings> WHERE severity <> 'LOW' GROUP BY case_id) e ON o_orderkey = e.case_id")
register("a7_direct_risk", lambda t: S.direct_risk(t.findings), "SELECT case_id, least(100, n * 15) AS probability, CASE WHEN least(100, n * 15) <= 40 THEN 'LOW' WHEN least(100, n * 15) < 70 THEN 'MEDIUM' ELSE 'HIGH' END AS status FROM (SELECT case_id, count(*) AS n FROM <findings> GROUP BY case_id)")
_TODAY = "1995-01-01"
register("a10_portfolio", lambda t: S.portfolio(t.cases, _TODAY), f"""SELECT count(*) AS total, count(*) FILTER (CAST(created_at AS DATE) = DATE '{_TODAY}') AS created_today, count(*) FILTER (status = 'COMPLETED' AND trust_score >= 80) AS verified,
 count(*) FILTER (status = 'COMPLETED' AND trust_score >= 50 AND trust_score < 80) AS suspicious, count(*) FILTER (status = 'COMPLETED' AND trust_score < 50) AS fraudulent, round(avg(CASE WHEN status = 'COMPLETED' THEN trust_score END), 6) AS mean_trust FROM <cases>""")
register("a11_snapshot", lambda t: t.cases.agg(F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.count_if((F.col("status") == "COMPLETED") & (S.recommendation(F.col("trust_score")) == "AUTO_APPROVE")).alias("approved"), F.count_if((F.col("status") == "COMPLETED") & (S.recommendation(F.col("trust_score")) != "AUTO_APPROVE")).alias("manual")),
         "SELECT count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status = 'COMPLETED' AND trust_score >= 85) AS approved, count(*) FILTER (status = 'COMPLETED' AND (trust_score < 85 OR trust_score IS NULL)) AS manual FROM <cases>")
register("a17_finding_groups", lambda t: S.finding_groups(t.findings), """SELECT case_id, count(*) FILTER (contains(lower(name), 'identity') OR contains(lower(name), 'name')) AS identity, count(*) FILTER (regexp_matches(lower(name), 'math|balance|salary')) AS financial,
 count(*) FILTER (layer_source = 'FORENSIC') AS forensic, coalesce(list_sort(list_distinct(list(name) FILTER (contains(lower(name), 'mismatch')))), []) AS mismatches FROM <findings> GROUP BY case_id""")


def _complete(t):
    docs = C.classify(t.kyc).select("case_id", "classification", "name", E.valid_birth_date(E.birth_date(F.col("text"))).alias("dob"), E.corrected_pan(F.col("pan")).alias("pan"))
    return S.completeness(docs).select("case_id", F.round("completeness", 6).alias("completeness"))


register("e23_completeness", _complete, """SELECT case_id, round(avg((CASE WHEN name IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN year(try_strptime(dob, '%d/%m/%Y')) BETWEEN 1900 AND 2028 THEN 1 ELSE 0 END
  + CASE WHEN regexp_matches(translate(substr(pan,1,5),'01582','OISBZ') || translate(substr(pan,6,4),'OISBZGT','0158267') || translate(substr(pan,10,1),'01582','OISBZ'), '^[A-Z]{5}[0-9]{4}[A-Z]$') THEN 1 ELSE 0 END) / 3 * 100), 6) AS completeness
 FROM (SELECT *, regexp_extract(text, '\\d{2}/\\d{2}/\\d{4}') AS dob FROM <kyc>) GROUP BY case_id""")
_CLASSES = ["PAN", "Aadhaar", "Payslip", "Property Record", "Bank Statement", "Utility Bill", "Lease Agreement", "Insurance"]


def _all_classes(t):
    """Documents of all types; their texts show no names, birth dates, ids or salaries."""
    kind = F.element_at(F.array(*map(F.lit, _CLASSES)), (F.col("doc_id") % 8 + 1).cast("int"))
    docs = t.employers.select("case_id", kind.alias("classification"), F.lit(None).cast("string").alias("name"), "employer", "address", E.account_number(F.col("text")).alias("account_number"), E.property_id(F.col("text")).alias("property_id"), E.property_owner(F.col("text")).alias("property_owner"))
    return S.completeness(docs).select("case_id", F.round("completeness", 6).alias("completeness"))


register("e23_all_classes", _all_classes, "SELECT case_id, round(avg(CASE doc_id % 8 WHEN 2 THEN 100.0::DOUBLE / 3 WHEN 3 THEN 100 WHEN 4 THEN 50 WHEN 5 THEN 50 WHEN 6 THEN 50 ELSE 0 END), 6) AS completeness FROM <employers> GROUP BY case_id")
