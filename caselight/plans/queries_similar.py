"""Queries of similar cases and of the reference repository."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import similar as M
from .registry import register

_REFS = "(VALUES " + ", ".join(f"('{i}', {f}, {a}::DECIMAL(9,1), {b}::DECIMAL(9,1), {c}::DECIMAL(9,1), '{p}', {r}, {s}, '{x}')" for i, f, a, b, c, p, r, s, x in M.BUILT_IN) + ") AS r(ref_id, is_fraud, trust_score, ocr_confidence, metadata_score, pdf_producer, revision_count, salary_consistency, context)"


def _score(a: str, b: str) -> str:
    part = lambda n, w, span: f"CAST(1 - abs({a}.{n} - {b}.{n}) / {span} AS DECIMAL(18,9)) * {w}"
    return f"""CAST(round_even(CAST(least(100, {part('trust_score', 40, '100')} + {part('ocr_confidence', 10, '100')} + {part('metadata_score', 15, '100')} + {part('revision_count', 5, f'greatest(1, {a}.revision_count, {b}.revision_count)')}
 + CASE WHEN {a}.salary_consistency = {b}.salary_consistency THEN 10 ELSE 0 END + 20 + CASE WHEN {a}.pdf_producer = {b}.pdf_producer AND {a}.pdf_producer <> 'None' THEN 5 ELSE 0 END + CASE WHEN {a}.context = {b}.context THEN 10 ELSE 0 END) AS DECIMAL(18,6)), 1) AS DECIMAL(9,1))"""


FOUND = f"SELECT f.case_id, ref_id, is_fraud, {_score('f', 'r')} AS similarity FROM <features> f, {_REFS}"
TOP = f"SELECT *, row_number() OVER (PARTITION BY case_id, is_fraud ORDER BY similarity DESC, ref_id) AS rank FROM ({FOUND}) WHERE similarity >= 60"


def _found(t):
    return M.matches(t.features, M.library(M.built_in(t.spark)))


register("k2_similarity", lambda t: M.matches(t.features, M.built_in(t.spark), 0), f"SELECT * FROM ({FOUND})")
_COLUMNS = ["trust_score", "ocr_confidence", "metadata_score", "revision_count", "salary_consistency"]


def _differences(t):
    joined = M.prefixed(t.features, "a_").join(F.broadcast(M.prefixed(M.built_in(t.spark).where("ref_id = 'ref-g1'"), "b_")))
    return joined.select(F.col("a_case_id").alias("case_id"), M.differences("a_", "b_", _COLUMNS).alias("differences"))


_DIFF = "[x FOR x IN [CASE WHEN abs(trust_score - 98) / 100 > 0.15 THEN 'trust_score' END, CASE WHEN abs(ocr_confidence - 95) / 100 > 0.15 THEN 'ocr_confidence' END, CASE WHEN abs(metadata_score - 100) / 100 > 0.15 THEN 'metadata_score' END, CASE WHEN (revision_count - 1) / greatest(1, revision_count) > 0.15 THEN 'revision_count' END, CASE WHEN NOT salary_consistency THEN 'salary_consistency' END] IF x IS NOT NULL]"
register("k2b_differences", _differences, f"SELECT case_id, {_DIFF} AS differences FROM <features>")


def _difference_texts(t):
    joined = M.prefixed(t.features, "a_").join(F.broadcast(M.prefixed(M.built_in(t.spark), "b_")))
    return joined.select(F.col("a_case_id").alias("case_id"), F.col("b_ref_id").alias("ref_id"), M.difference_texts("a_", "b_", _COLUMNS).alias("texts"))


def _varies(name: str, span: str) -> str:
    return f"CASE WHEN abs(f.{name} - r.{name}) / {span} > 0.15 THEN '{name.replace('_', ' ').title()} varies by ' || CAST(abs(f.{name} - r.{name}) AS DECIMAL(9,1)) || ' points.' END"


_TEXTS = ", ".join([_varies("trust_score", "100"), _varies("ocr_confidence", "100"), _varies("metadata_score", "100"), _varies("revision_count", "greatest(1, f.revision_count, r.revision_count)"),
                    "CASE WHEN f.salary_consistency <> r.salary_consistency THEN 'Salary Consistency discrepancy: case has ' || CASE WHEN f.salary_consistency THEN 'True' ELSE 'False' END || ', target reference has ' || CASE WHEN r.salary_consistency THEN 'True' ELSE 'False' END || '.' END"])
register("k2b_difference_texts", _difference_texts, f"SELECT case_id, ref_id, [x FOR x IN [{_TEXTS}] IF x IS NOT NULL] AS texts FROM <features> f, {_REFS}")
register("w5_rank_in_label", lambda t: M.top_matches(_found(t)), f"SELECT case_id, ref_id, is_fraud, similarity, CAST(rank AS INTEGER) AS rank FROM ({TOP}) WHERE rank <= 2")
register("k3_best_match", lambda t: M.best_match(M.top_matches(_found(t))), f"SELECT case_id, ref_id, is_fraud, similarity FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY similarity DESC, is_fraud, rank) AS n FROM ({TOP}) WHERE rank <= 2) WHERE n = 1")
register("k4_top_k", lambda t: M.top_matches(M.matches(t.features, M.built_in(t.spark), 0).withColumn("is_fraud", F.lit(False)), 3).select("case_id", "ref_id", "rank"), f"SELECT case_id, ref_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY similarity DESC, ref_id) AS INTEGER) AS rank FROM ({FOUND}) QUALIFY rank <= 3")
register("k5_fraud_neighbour", lambda t: M.best_match(M.top_matches(_found(t))).where("is_fraud").select("case_id", F.lit("KNN").alias("layer_source"), F.lit("LOW").alias("severity")), f"SELECT case_id, 'KNN' AS layer_source, 'LOW' AS severity FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY similarity DESC, is_fraud, rank) AS n FROM ({TOP}) WHERE rank <= 2) WHERE n = 1 AND is_fraud")
register("o5_candidates", lambda t: _found(t).select("case_id", "ref_id").distinct(), f"SELECT DISTINCT case_id, ref_id FROM ({FOUND}) WHERE similarity >= 60")
_PAST = "f.case_id IN (SELECT case_id FROM <cases> WHERE status = 'COMPLETED'"
_ALL = f"""(SELECT ref_id, 0 AS source, is_fraud, trust_score, ocr_confidence, metadata_score, pdf_producer, revision_count, salary_consistency, context FROM {_REFS}
 UNION ALL SELECT CAST(case_id AS STRING), 1, trust_score < 70, trust_score, ocr_confidence, metadata_score, pdf_producer, revision_count, salary_consistency, context FROM <features> f WHERE {_PAST})
 UNION ALL SELECT CAST(case_id AS STRING), 2, FALSE, trust_score, ocr_confidence, metadata_score, pdf_producer, revision_count, salary_consistency, context FROM <features> f WHERE {_PAST} AND is_baseline))"""
_TOP_ALL = f"SELECT case_id, ref_id, is_fraud, similarity, CAST(row_number() OVER (PARTITION BY case_id, is_fraud ORDER BY similarity DESC, source, ref_id) AS INTEGER) AS rank FROM (SELECT f.case_id, r.ref_id, r.source, r.is_fraud, {_score('f', 'r')} AS similarity FROM <features> f JOIN {_ALL} r ON CAST(f.case_id AS STRING) <> r.ref_id) WHERE similarity >= 60 QUALIFY rank <= 2"
_BEST_ALL = f"SELECT case_id, ref_id, is_fraud, similarity FROM ({_TOP_ALL}) QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY similarity DESC, is_fraud, rank) = 1"


def _nearest(t):
    """The search among built-in references, completed cases and the repository (completed baselines)."""
    done = t.cases.where("status = 'COMPLETED'")
    return M.nearest(t.features, M.candidates(t.spark, t.features, done, t.features.join(done.where("is_baseline").select("case_id"), "case_id", "left_semi")))


def _nearest_kept(t):
    """The three most alike of the repository (completed baselines) for every case, however little alike."""
    kept = t.features.join(t.cases.where("status = 'COMPLETED' AND is_baseline").select("case_id"), "case_id", "left_semi")
    refs = kept.withColumnRenamed("case_id", "ref_id").withColumn("source", F.lit(0)).withColumn("is_fraud", F.lit(False))
    return M.nearest(t.features, refs, 3, 0).select("case_id", "ref_id", "similarity", "rank")


register("k4_top_of_all", _nearest_kept, f"""SELECT f.case_id, CAST(r.case_id AS STRING) AS ref_id, {_score('f', 'r')} AS similarity, CAST(row_number() OVER (PARTITION BY f.case_id ORDER BY {_score('f', 'r')} DESC, CAST(r.case_id AS STRING)) AS INTEGER) AS rank
 FROM <features> f JOIN (SELECT * FROM <features> f WHERE {_PAST} AND is_baseline)) r ON f.case_id <> r.case_id QUALIFY rank <= 3""")
register("o5_found_of_all", lambda t: _nearest(t).select("case_id", "ref_id").distinct(), f"SELECT DISTINCT case_id, ref_id FROM ({_TOP_ALL})")
register("w5_rank_in_all", lambda t: _nearest(t), _TOP_ALL)
register("k3_best_of_all", lambda t: M.best_match(_nearest(t)), _BEST_ALL)
register("k5_fraud_of_all", lambda t: M.best_match(_nearest(t)).where("is_fraud").select("case_id", F.lit("KNN").alias("layer_source"), F.lit("LOW").alias("severity")), f"SELECT case_id, 'KNN' AS layer_source, 'LOW' AS severity FROM ({_BEST_ALL}) WHERE is_fraud")
_PAIR = f"SELECT f.case_id, g.case_id AS other_id, {_score('f', 'g')} AS similarity FROM <features> f JOIN <features> g ON f.context = g.context AND f.case_id < g.case_id"
register("x9_other_cases", lambda t: M.neighbours(t.features, 105 - 6, "context"), f"SELECT * FROM ({_PAIR}) WHERE similarity >= 99")
register("x9_all_cases", lambda t: M.neighbours(t.features), f"SELECT * FROM (SELECT f.case_id, g.case_id AS other_id, {_score('f', 'g')} AS similarity FROM <features> f JOIN <features> g ON f.case_id < g.case_id) WHERE similarity >= 60")


def _vectors(t):
    docs = t.kyc.select("case_id", "doc_id", "seq", F.when(F.col("doc_id") % 4 == 0, "Canva").when(F.col("doc_id") % 4 == 2, "iText").alias("producer"), (60 + F.col("doc_id") % 41).alias("ocr_confidence"))
    found = t.findings.withColumn("score", F.when(F.col("seq") % 2 == 0, F.col("seq") / F.lit(10.0)))
    return M.feature_vectors(docs, found)


register("k1_feature_vectors", _vectors, """WITH d AS (SELECT case_id, doc_id, seq, CASE doc_id % 4 WHEN 0 THEN 'Canva' WHEN 2 THEN 'iText' END AS producer, 60 + doc_id % 41 AS c FROM <kyc>),
 r AS (SELECT *, last_value(producer IGNORE NULLS) OVER (PARTITION BY case_id ORDER BY seq, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running FROM d),
 s AS (SELECT case_id, avg(c) AS ocr_confidence, count(*) FILTER (running = 'Canva') AS bad, arg_max(coalesce(running, 'None'), seq) AS pdf_producer FROM r GROUP BY 1),
 f AS (SELECT *, CASE WHEN seq % 2 = 0 THEN seq / 10.0 END AS score FROM <findings>),
 last AS (SELECT case_id, max(seq) FILTER (contains(lower(name), 'identity')) AS i, max(seq) FILTER (contains(lower(name), 'employer')) AS e, count(*) FILTER (layer_source = 'FORENSIC') AS forensic FROM f GROUP BY 1)
 SELECT s.case_id, ocr_confidence, CAST(greatest(0, 100 - 40 * bad - 20 * coalesce(forensic, 0)) AS INTEGER) AS metadata_score, pdf_producer, TRUE AS salary_consistency,
 CASE WHEN i IS NULL THEN 1.0 WHEN i % 2 = 0 THEN i / 10.0 ELSE 0.6 END AS identity_similarity, CASE WHEN e IS NULL THEN 1.0 WHEN e % 2 = 0 THEN e / 10.0 ELSE 0.5 END AS employer_consistency FROM s LEFT JOIN last ON s.case_id = last.case_id""")


def _halves(t):
    f = t.features
    return f.where("case_id % 3 <> 0"), f.where("case_id % 2 = 0").withColumn("context", F.lit("NEW"))


register("k6_upsert", lambda t: M.upsert(*_halves(t)).select("case_id", "context"), "SELECT case_id, CASE WHEN case_id % 2 = 0 THEN 'NEW' ELSE context END AS context FROM <features> WHERE case_id % 2 = 0 OR case_id % 3 <> 0")
register("o6_remove", lambda t: M.remove(t.features, t.features.where("case_id % 5 = 0")).select("case_id"), "SELECT case_id FROM <features> WHERE case_id % 5 <> 0")
register("k7_reindex", lambda t: M.upsert(t.features.where("case_id % 2 = 0"), t.features.join(t.cases.where("status = 'COMPLETED' AND is_baseline").select("case_id"), "case_id", "left_semi")).select("case_id"), "SELECT case_id FROM <features> WHERE case_id % 2 = 0 OR case_id IN (SELECT case_id FROM <cases> WHERE status = 'COMPLETED' AND is_baseline)")
register("k8_delete_cases", lambda t: M.delete_case({"findings": t.findings}, t.cases.where("context = 'Loan Approval'"))["findings"].groupBy("severity").agg(F.count("*").alias("n")), "SELECT severity, count(*) AS n FROM <findings> WHERE case_id NOT IN (SELECT case_id FROM <cases> WHERE context = 'Loan Approval') GROUP BY 1")
register("k9_auto_promotion", lambda t: t.cases.where("status = 'COMPLETED' AND trust_score >= 85").select("case_id", "trust_score"), "SELECT case_id, trust_score FROM <cases> WHERE status = 'COMPLETED' AND trust_score >= 85")
