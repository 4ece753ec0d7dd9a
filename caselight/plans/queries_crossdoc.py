"""Queries across the documents of a case, and their similarities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import entities as E, similarity as S, text as X
from ..operators import crossdoc as D
from .queries_documents import valid_name_sql, words_sql
from .registry import register

_NORM = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '\\b(mr|ms|mrs|dr|adv|prof)\\b\\.?', '', 'g'), '[^a-z\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_PAIRS = "SELECT a.case_id, a.doc_id AS doc_a, b.doc_id AS doc_b, a.name AS name_a, b.name AS name_b FROM <kyc> a JOIN <kyc> b ON a.case_id = b.case_id AND a.seq < b.seq WHERE a.name IS NOT NULL AND b.name IS NOT NULL"
_JW = f"jaro_winkler_similarity({_NORM.format('name_a')}, {_NORM.format('name_b')})"
_SURNAMES = "jaro_winkler_similarity(list_last(string_split(name_a, ' ')), list_last(string_split(name_b, ' ')))"


def _abbr(s: str, f: str) -> str:
    return f"CASE WHEN len(string_split({s}, ' ')) >= 2 AND len(string_split({f}, ' ')) >= 2 AND regexp_matches(string_split({s}, ' ')[1], '^.\\.?$') AND substr({s},1,1) = substr({f},1,1) AND {_SURNAMES} >= 0.95 THEN 0.96 ELSE 0.0 END"


_N9 = f"CASE WHEN {_JW} < 0.92 THEN greatest({_JW}, {_abbr('name_a', 'name_b')}, {_abbr('name_b', 'name_a')}) ELSE {_JW} END"


def _name_pairs(t):
    return D.pairs_in_case(t.kyc, ["name"])


def _distinct(t):
    return _name_pairs(t).select("name_a", "name_b").distinct()


register("n4_jaro_winkler", lambda t: _distinct(t).select("name_a", "name_b", F.round(S.jaro_winkler(F.col("name_a"), F.col("name_b")), 6).alias("score")), f"SELECT DISTINCT name_a, name_b, round(jaro_winkler_similarity(name_a, name_b), 6) AS score FROM ({_PAIRS})")


def _ratio(a: str, b: str) -> str:
    """The indel ratio as SQL, for texts b of up to 61 characters: bits of b that the common subsequence leaves open."""
    hits = f"list_transform(string_split({a}, ''), lambda c: CAST(list_sum(list_transform(range(len({b})), lambda j: CASE WHEN substr({b}, j + 1, 1) = c THEN 1::BIGINT << j ELSE 0 END)) AS BIGINT))"
    left = f"list_reduce(list_concat([(1::BIGINT << len({b})) - 1], {hits}), lambda s, m: ((s + (s & m)) | (s - (s & m))) & ((1::BIGINT << len({b})) - 1))"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE 2.0::DOUBLE * (len({b}) - bit_count({left})) / (len({a}) + len({b})) END"


def _token_sets(pairs: str, x: str, y: str) -> str:
    """``pairs`` with ``score``, the token-set ratio of expressions x and y."""
    words = lambda v: f"list_distinct(list_filter(string_split({v}, ' '), lambda w: w <> ''))"
    only = lambda u, v, sign: f"array_to_string(list_sort(list_filter({u}, lambda w: {sign}list_contains({v}, w))), ' ')"
    return f"""SELECT *, CASE WHEN len(u) = 0 OR len(v) = 0 THEN 0.0 WHEN joint <> '' AND (one = '' OR two = '') THEN 1.0 ELSE greatest({_ratio('l', 'r')}, {_ratio('joint', 'l')}, {_ratio('joint', 'r')}) END AS score
 FROM (SELECT *, trim(joint || ' ' || one) AS l, trim(joint || ' ' || two) AS r FROM (SELECT *, {only('u', 'v', '')} AS joint, {only('u', 'v', 'NOT ')} AS one, {only('v', 'u', 'NOT ')} AS two FROM (SELECT *, {words(x)} AS u, {words(y)} AS v FROM ({pairs}))))"""


_EMPLOYERS = "SELECT a.case_id, a.doc_id AS doc_a, b.doc_id AS doc_b, a.employer AS employer_a, b.employer AS employer_b FROM <employers> a JOIN <employers> b ON a.case_id = b.case_id AND a.seq < b.seq"
register("n5_indel_ratio", lambda t: _distinct(t).select("name_a", "name_b", F.round(S.indel_ratio(F.col("name_a"), F.col("name_b")), 6).alias("score")), f"SELECT name_a, name_b, round({_ratio('name_a', 'name_b')}, 6) AS score FROM (SELECT DISTINCT name_a, name_b FROM ({_PAIRS}))")
register("n6_token_set_ratio", lambda t: D.pairs_in_case(t.employers, ["employer"]).select("employer_a", "employer_b").distinct().select("employer_a", "employer_b", F.round(S.token_set_ratio(F.lower("employer_a"), F.lower("employer_b")), 6).alias("score")),
         f"SELECT employer_a, employer_b, round(score, 6) AS score FROM ({_token_sets(f'SELECT DISTINCT employer_a, employer_b FROM ({_EMPLOYERS})', 'lower(employer_a)', 'lower(employer_b)')})")
register("n7_threshold_match", lambda t: _distinct(t).select("name_a", "name_b", (S.jaro_winkler(X.normal_name(F.col("name_a")), X.normal_name(F.col("name_b"))) >= D.MATCH).alias("is_match")), f"SELECT DISTINCT name_a, name_b, {_JW} >= 0.92 AS is_match FROM ({_PAIRS})")
register("n8_abbreviation", lambda t: _distinct(t).withColumn("s", S.jaro_winkler(S.last_word(F.col("name_a")), S.last_word(F.col("name_b")))).select("name_a", "name_b", S.abbreviation(F.col("name_a"), F.col("name_b"), F.col("s")).alias("score")), f"SELECT DISTINCT name_a, name_b, {_abbr('name_a', 'name_b')} AS score FROM ({_PAIRS})")
register("n9_name_similarity", lambda t: D.name_scores(_name_pairs(t)).select("name_a", "name_b", F.round("similarity", 6).alias("score")), f"SELECT DISTINCT name_a, name_b, round({_N9}, 6) AS score FROM ({_PAIRS})")
_FOUND = "'CROSS_DOC' AS layer_source, '{0}' AS name, '{1}' AS severity"
register("x1_name_mismatch", lambda t: D.name_mismatches(t.kyc), f"SELECT case_id, doc_a, doc_b, {_FOUND.format('Identity Name Mismatch', 'HIGH')}, round({_N9}, 6) AS score FROM ({_PAIRS}) WHERE {_N9} < 0.85")
_ALIKE = _token_sets(f"SELECT DISTINCT employer_a, employer_b FROM ({_EMPLOYERS})", words_sql("employer_a", X.EMPLOYER_WORDS), words_sql("employer_b", X.EMPLOYER_WORDS))
register("x2_employer_mismatch", lambda t: D.employer_mismatches(t.employers), f"SELECT case_id, doc_a, doc_b, {_FOUND.format('Employer Mismatch', 'MEDIUM')}, round(score, 6) AS score FROM ({_EMPLOYERS}) p JOIN ({_ALIKE}) s ON p.employer_a = s.employer_a AND p.employer_b = s.employer_b WHERE score < 0.75")
register("x3_id_mismatch", lambda t: D.id_mismatches(t.kyc), f"SELECT k.case_id, k.doc_id, n_ids, {_FOUND.format('PAN Identifier Mismatch', 'HIGH')} FROM <kyc> k JOIN (SELECT case_id, count(DISTINCT pan) AS n_ids FROM <kyc> GROUP BY case_id HAVING count(DISTINCT pan) > 1) m ON k.case_id = m.case_id")
_SALARY = "TRY_CAST(replace(nullif(regexp_extract(text, '(?i)(?:net\\s+pay|gross\\s+salary|net\\s+salary)[:\\s]+(?:rs\\.?|inr)?\\s*([\\d,.]+)', 1), ''), ',', '') AS DECIMAL(18,2))"
_TWO = f"SELECT case_id, max(CASE WHEN rn = 1 THEN salary END) AS first, max(CASE WHEN rn = 2 THEN salary END) AS second FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY doc_id) AS rn FROM (SELECT case_id, doc_id, {_SALARY} AS salary FROM <slips> WHERE doc_id % 3 = 0) WHERE salary > 0) WHERE rn <= 2 GROUP BY case_id"


def _slips(t):
    return t.slips.where("doc_id % 3 = 0").select("case_id", "doc_id", F.col("doc_id").alias("seq"), E.salary(F.col("text")).alias("salary"))


register("x4_income_mismatch", lambda t: D.pay_mismatches(_slips(t)), f"SELECT case_id, first, second, {_FOUND.format('Income Inconsistency', 'HIGH')} FROM ({_TWO}) WHERE abs(first - second) > 100")
register("w3_first_two", lambda t: D.first_two(_slips(t), "salary"), _TWO)
register("x5_enough_documents", lambda t: D.with_enough(t.findings, 3).select("case_id", "seq"), "SELECT case_id, seq FROM (SELECT *, count(*) OVER (PARTITION BY case_id) AS n FROM <findings>) WHERE n >= 3")
register("x5_all_documents", lambda t: D.with_enough(t.kyc, 2).select("case_id", "doc_id"), "SELECT case_id, doc_id FROM (SELECT *, count(*) OVER (PARTITION BY case_id) AS n FROM <kyc>) WHERE n >= 2")
register("x7_reconcile_names", lambda t: D.reconciled_names(t.kyc).select("doc_id", "name", "reconciled"), f"""WITH k AS (SELECT * FROM <kyc>),
 best AS (SELECT case_id, name AS best FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY length(name) DESC, seq, doc_id) AS rn FROM k WHERE name IS NOT NULL) WHERE rn = 1),
 j AS (SELECT doc_id, name, best, best AS name_a, name AS name_b FROM k LEFT JOIN best ON k.case_id = best.case_id)
 SELECT doc_id, name, CASE WHEN name IS NOT NULL AND {_N9} >= 0.85 THEN best ELSE name END AS reconciled FROM j""")


def _evidence(t):
    found = t.kyc.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.coalesce("name", F.lit("nobody"))).otherwise(F.lit("no such words")).alias("search"), F.lit("Name").alias("label"))
    places = t.kyc.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text")).withColumn("page", F.col("pos") + 1)
    return D.evidence(found, places)


register("x8_evidence", _evidence, """WITH f AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN coalesce(name, 'nobody') ELSE 'no such words' END AS search, 'Name' AS label FROM <kyc>),
 p AS (SELECT doc_id, CAST(i AS INTEGER) AS pos, ls[i + 1] AS line FROM (SELECT doc_id, string_split(text, CHR(10)) AS ls FROM <kyc>), unnest(range(len(ls))) AS u(i)),
 h AS (SELECT f.doc_id, search, min(pos) + 1 AS page FROM f JOIN p ON f.doc_id = p.doc_id AND contains(lower(line), lower(search)) GROUP BY 1, 2)
 SELECT f.doc_id, f.search, coalesce(page, 1) AS page, CASE WHEN page IS NOT NULL THEN 0.95 ELSE 0.8 END AS confidence, label || ': ' || f.search AS description FROM f LEFT JOIN h ON f.doc_id = h.doc_id AND f.search = h.search""")


def _by_document(t):
    return t.findings.withColumnRenamed("case_id", "doc_id").where("severity <> 'LOW'")


register("x10_document_status", lambda t: D.document_status(t.orders.select(F.col("o_orderkey").alias("doc_id")), _by_document(t)),
         "SELECT o_orderkey AS doc_id, CASE WHEN bad THEN 'FRAUD' WHEN bad IS NOT NULL THEN 'SUSPICIOUS' ELSE 'GENUINE' END AS status FROM orders LEFT JOIN (SELECT case_id, bool_or(severity IN ('HIGH','CRITICAL')) AS bad FROM <findings> WHERE severity <> 'LOW' GROUP BY case_id) w ON o_orderkey = w.case_id")
register("x12_merge_templates", lambda t: t.kyc.select("doc_id", "name", "pan").join(t.kyc.where("doc_id % 2 = 0").select("doc_id", F.lit("TEMPLATE").alias("name2"), F.lit("none").alias("pan2")), "doc_id", "left").select("doc_id", F.coalesce("name", "name2").alias("name"), F.coalesce("pan", "pan2").alias("pan")),
         "SELECT doc_id, coalesce(name, CASE WHEN doc_id % 2 = 0 THEN 'TEMPLATE' END) AS name, pan FROM <kyc>")
register("a16_distinct_counts", lambda t: t.kyc.groupBy("case_id").agg(F.countDistinct("pan").alias("pans"), F.countDistinct("name").alias("names")), "SELECT case_id, count(DISTINCT pan) AS pans, count(DISTINCT name) AS names FROM <kyc> GROUP BY case_id")
