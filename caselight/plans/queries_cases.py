"""Queries on cases: lists, contexts, timelines, reports, graphs, template texts, field terms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import entities as E
from ..functions.text import NOT_NAMES
from ..operators import cases as K, classify as C, fields, reports as R, scoring as S, similar as M
from ..streaming import flows
from .queries_documents import classified
from .queries_scoring import SCORED
from .queries_similar import _TOP_ALL as TOP_ALL, TOP, _nearest as nearest
from .registry import register

register("p1_case_page", lambda t: K.page_of(t.cases, 20, 10).select("case_id", "created_at"), "SELECT case_id, created_at FROM <cases> ORDER BY created_at DESC, case_id LIMIT 10 OFFSET 20")
register("o1_recent_cases", lambda t: K.page_of(t.cases, 0, 5).select("case_id", "created_at"), "SELECT case_id, created_at FROM <cases> ORDER BY created_at DESC, case_id LIMIT 5")
register("p2_case_lookup", lambda t: t.cases.where("case_id = 7").join(t.findings, "case_id", "left").select("case_id", "context", "severity", "seq"), "SELECT c.case_id, context, severity, seq FROM <cases> c LEFT JOIN <findings> f ON c.case_id = f.case_id WHERE c.case_id = 7")
register("p3_document_lookup", lambda t: t.kyc.where("case_id = 5 AND doc_id = 16").select("case_id", "doc_id", "pan"), "SELECT case_id, doc_id, pan FROM <kyc> WHERE case_id = 5 AND doc_id = 16")
register("p4_text_search", lambda t: K.matching(t.cases, "LOAN", "COMPLETED").select("case_id", "title"), "SELECT case_id, title FROM <cases> WHERE status = 'COMPLETED' AND (contains(lower(coalesce(title, '')), 'loan') OR contains(lower(context), 'loan') OR contains(CAST(case_id AS VARCHAR), 'loan'))")
_SUMMARY = "CASE WHEN event_id % 2 = 0 THEN '{\"error\":\"e' || CAST(event_id % 10 AS VARCHAR) || '\"}' ELSE '{}' END"
register("p5_failure_message", lambda t: t.table("events").select("event_id", F.when(F.col("event_type") == "error", F.get_json_object(F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"error":"e'), (F.col("event_id") % 10).cast("string"), F.lit('"}'))).otherwise("{}"), "$.error")).alias("message")),
         f"SELECT event_id, CASE WHEN event_type = 'error' THEN json_extract_string({_SUMMARY}, '$.error') END AS message FROM events")
register("p6_completed", lambda t: t.cases.where("status = 'COMPLETED'").groupBy("is_baseline").agg(F.count("*").alias("n")), "SELECT is_baseline, count(*) AS n FROM <cases> WHERE status = 'COMPLETED' GROUP BY 1")
register("p7_titles", lambda t: t.cases.select("case_id", K.shown_title(F.col("title"), F.col("context")).alias("title")), "SELECT case_id, coalesce(nullif(title, ''), 'Investigation: ' || context) AS title FROM <cases>")
register("p8_labels", lambda t: S.trust_scores(t.findings).select("case_id", K.label(S.recommendation(F.col("trust_score"))).alias("label")), f"SELECT case_id, CASE WHEN trust_score >= 85 THEN 'Auto Approved' WHEN trust_score < 50 THEN 'High Risk Manual Review' ELSE 'Manual Review' END AS label FROM ({SCORED})")
_RULES = "CASE replace(lower(context), ' ', '_') " + " ".join(f"WHEN '{k}' THEN [" + ", ".join(f"'{r}'" for r in v) + "]" for k, v in K.CONTEXT_RULES.items()) + " ELSE [] END"
register("p9_context_rules", lambda t: t.cases.select("case_id", K.rules_of(F.col("context")).alias("rules")), f"SELECT case_id, {_RULES} AS rules FROM <cases>")
register("p10_expected_documents", lambda t: t.cases.select("case_id", K.expected_documents(F.col("context")).alias("expected")), "SELECT case_id, CASE WHEN regexp_matches(lower(context), 'underwriting|mortgage|loan') THEN 3 ELSE 2 END AS expected FROM <cases>")


def _typed(t):
    return C.classify(t.slips).select(F.col("case_id"), "classification")


_TYPED = f"SELECT case_id, classification FROM ({classified('slips')})"
_CONTEXT = "CASE " + " ".join("WHEN bool_or(" + ("contains(lower(classification), 'insurance')" if types is None else "classification IN (" + ", ".join("'" + x.replace("'", "''") + "'" for x in types) + ")") + f") THEN '{name}'" for types, name in K.CONTEXT_SIGNS) + " ELSE 'Loan Approval' END"
register("c3_detect_context", lambda t: K.detected_context(_typed(t)), f"SELECT case_id, {_CONTEXT} AS context FROM ({_TYPED}) GROUP BY case_id")
register("c4_new_titles", lambda t: K.new_titles(t.cases, K.detected_context(_typed(t))), f"""WITH d AS (SELECT case_id, {_CONTEXT} AS found FROM ({_TYPED}) GROUP BY case_id), j AS (SELECT c.case_id, c.context AS old, title, CASE WHEN c.context = 'Automatic Detection' THEN coalesce(found, 'Loan Approval') ELSE c.context END AS context FROM <cases> c LEFT JOIN d ON c.case_id = d.case_id)
 SELECT case_id, context, CASE WHEN old = 'Automatic Detection' AND title = 'Investigation: Automatic Detection' THEN 'Investigation: ' || context ELSE title END AS title FROM j""")


def _events(t):
    return t.case_events


_LATEST = "SELECT case_id, ts, event_id, progress, status FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts DESC, event_id DESC) AS rn FROM <case_events>) WHERE rn = 1"
register("w4_latest_event", lambda t: K.latest_events(_events(t)), _LATEST)
_RANKED = "SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY rank, layer_source, name, seq) AS place FROM (SELECT *, CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 9 END AS rank FROM <findings>)"
register("o2_by_severity", lambda t: K.ranked_findings(t.findings).select("case_id", "severity", "name", "place"), f"SELECT case_id, severity, name, CAST(place AS INTEGER) AS place FROM ({_RANKED})")
register("o3_first_evidence", lambda t: K.first_evidence(t.findings), f"SELECT case_id, list(name ORDER BY place)[1:5] AS first, CAST(greatest(count(*) - 5, 0) AS INTEGER) AS more FROM ({_RANKED}) GROUP BY case_id")
register("s10_csv_rows", lambda t: K.csv_rows(t.cases, F.when(F.col("trust_score").isNotNull(), S.recommendation(F.col("trust_score")))), """SELECT case_id AS id, context, coalesce(nullif(title, ''), 'Untitled') AS title, status, CASE WHEN trust_score IS NULL OR trust_score = 0 THEN 'N/A' ELSE CAST(trust_score AS VARCHAR) END AS trust,
 CASE WHEN trust_score IS NULL THEN 'N/A' WHEN trust_score >= 85 THEN 'AUTO_APPROVE' WHEN trust_score < 50 THEN 'HIGH_RISK_MANUAL_REVIEW' ELSE 'MANUAL_REVIEW' END AS recommendation FROM <cases>""")
register("s11_snapshot_totals", lambda t: S.portfolio(t.cases, "1995-01-01").select("total", "verified", "mean_trust"), "SELECT count(*) AS total, count(*) FILTER (status = 'COMPLETED' AND trust_score >= 80) AS verified, round(avg(CASE WHEN status = 'COMPLETED' THEN trust_score END), 6) AS mean_trust FROM <cases>")
register("s13_replace_findings", lambda t: t.findings.join(t.cases.where("status = 'PENDING'").select("case_id"), "case_id", "left_anti").groupBy("layer_source").agg(F.count("*").alias("n")), "SELECT layer_source, count(*) AS n FROM <findings> WHERE case_id NOT IN (SELECT case_id FROM <cases> WHERE status = 'PENDING') GROUP BY 1")
register("x6_case_children", lambda t: t.cases.select("case_id", "context").join(t.findings.groupBy("case_id").agg(F.count("*").alias("n_findings")), "case_id", "left").join(t.kyc.groupBy("case_id").agg(F.count("*").alias("n_documents")), "case_id", "left"),
         "SELECT c.case_id, context, n_findings, n_documents FROM <cases> c LEFT JOIN (SELECT case_id, count(*) AS n_findings FROM <findings> GROUP BY 1) f ON c.case_id = f.case_id LEFT JOIN (SELECT case_id, count(*) AS n_documents FROM <kyc> GROUP BY 1) d ON c.case_id = d.case_id")
register("t1_summaries", lambda t: K.summaries(S.finding_groups(t.findings), S.trust_scores(t.findings), S.recommendation(F.col("trust_score"))), f"""WITH g AS (SELECT case_id, count(*) FILTER (contains(lower(name), 'identity') OR contains(lower(name), 'name')) AS i, count(*) FILTER (regexp_matches(lower(name), 'math|balance|salary')) AS f, count(*) FILTER (layer_source = 'FORENSIC') AS o FROM <findings> GROUP BY case_id)
 SELECT s.case_id, 'Trust score ' || CAST(trust_score AS VARCHAR) || '. Recommendation: ' || CASE WHEN trust_score >= 85 THEN 'Auto Approved' WHEN trust_score < 50 THEN 'High Risk Manual Review' ELSE 'Manual Review' END || '.' AS executive,
 CASE WHEN i + f + o = 0 THEN 'No findings.' ELSE 'Identity: ' || i || ', financial: ' || f || ', forensic: ' || o || '.' END AS risk FROM ({SCORED}) s JOIN g ON s.case_id = g.case_id""")


def _said(key: str, *values: str) -> str:
    """A fixed text as SQL, with SQL for its numbers."""
    parts = K.CASE_TEXTS[key].replace("%%", "%").replace("%d", "\0").replace("%s", "\0").split("\0")
    return "(" + " || ".join(x for p, v in zip(parts, [*values, None]) for x in ("'" + p.replace("'", "''") + "'", v) if x is not None) + ")"


def _part(kind: str) -> str:
    return f"CASE WHEN {kind} > 0 THEN {_said(kind, kind)} ELSE {_said(kind + '_none')} END"


_STEPS = "list_filter([" + ", ".join(f"CASE WHEN {k} > 0 THEN {_said('step_' + k)} END" for k in ("identity", "math", "forensic")) + "], lambda x: x IS NOT NULL)"
_CASE_TEXTS = f"""WITH f AS (SELECT case_id, count(*) AS n, count(*) FILTER (layer_source = 'CROSS_DOC' AND contains(lower(name), 'identity')) AS identity, count(*) FILTER (regexp_matches(lower(name), 'math|balance|salary')) AS math,
  count(*) FILTER (layer_source = 'FORENSIC') AS forensic, list(name ORDER BY seq, name) FILTER (contains(lower(name), 'mismatch')) AS odd FROM <findings> GROUP BY case_id),
 r AS (SELECT c.case_id, context, coalesce(n, 0) AS n, coalesce(identity, 0) AS identity, coalesce(math, 0) AS math, coalesce(forensic, 0) AS forensic, coalesce(odd, []) AS odd, CAST(coalesce(s.trust_score, 100) AS DECIMAL(9,1)) AS trust
  FROM <cases> c LEFT JOIN f ON c.case_id = f.case_id LEFT JOIN ({SCORED}) s ON c.case_id = s.case_id)
 SELECT case_id, CASE WHEN n > 0 THEN {_said('executive', 'n', 'trust')} ELSE {_said('executive_none')} END AS executive_summary, CASE WHEN n > 0 THEN {_said('hindi', 'trust')} ELSE {_said('hindi_none')} END AS executive_summary_hi,
  CASE WHEN n > 0 THEN {_said('risk', 'CAST(100 - trust AS DECIMAL(9,1))')} ELSE {_said('risk_none')} END AS risk_narrative,
  'Identity check: ' || {_part('identity')} || ' Math check: ' || {_part('math')} || ' Forensic check: ' || {_part('forensic')} AS evidence_analysis, CASE WHEN n > 0 THEN '15%' ELSE '0%' END AS false_positive_probability, odd AS contradictions,
  CASE WHEN n > 0 THEN [{_said('missing')}] ELSE [] END AS missing_evidence, CASE WHEN n > 0 THEN [{_said('question')}] ELSE [] END AS manual_review_questions,
  CASE WHEN len({_STEPS}) > 0 THEN {_STEPS} ELSE [{_said('step_none')}] END AS recommended_next_steps, 'Audit of applicant folder context ' || CHR(39) || coalesce(context, '') || CHR(39) || '. ' || {_part('identity')} AS forensic_story,
  CASE WHEN n > 0 THEN {_said('verify')} ELSE {_said('approve')} END AS final_recommendation FROM r"""

def _filed(t):
    """Documents as reports show them."""
    return t.kyc.select("case_id", "doc_id", F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".pdf")).alias("filename"), F.lit("PAN Card").alias("classification"), F.lit("pdf").alias("file_type"), "text", F.struct("name", "pan").alias("entities"), F.struct(F.col("seq").cast("int").alias("seq")).alias("metadata"))


def _proof(t):
    return t.evidence.withColumn("coordinates", F.struct((F.col("page") * 10).alias("x"), F.col("finding").cast("int").alias("y")))


def _reports(t, most: int = R.ITEMS):
    cases = t.cases.withColumn("recommendation", F.when(F.col("trust_score").isNotNull(), S.recommendation(F.col("trust_score"))))
    findings = t.findings.withColumn("description", F.concat_ws(" ", "name", F.lit("of"), "layer_source"))
    summaries = K.case_texts(t.cases, t.findings, S.trust_scores(t.findings)).select("case_id", F.struct("executive_summary", "final_recommendation").alias("summary"))
    matches = M.best_match(M.top_matches(M.matches(t.features, M.library(M.built_in(t.spark)))))
    return R.reports(cases, _filed(t), findings, _proof(t), _events(t).withColumn("message", F.col("status")), matches, summaries, most)


_FILED = "SELECT case_id, doc_id, 'doc-' || doc_id || '.pdf' AS filename, text, name, pan, CAST(seq AS INTEGER) AS seq FROM <kyc>"
_REPORTS = f"""WITH d AS ({_FILED}),
 dl AS (SELECT case_id, list({{'id': doc_id, 'filename': filename, 'classification': 'PAN Card', 'file_type': 'pdf', 'extracted_text': text, 'entities_json': {{'name': name, 'pan': pan}}, 'metadata_json': {{'seq': seq}}}} ORDER BY doc_id) AS documents FROM d GROUP BY 1),
 e AS (SELECT x.case_id, finding AS seq, list({{'document': filename, 'document_id': x.doc_id, 'page': page, 'text': extracted, 'description': description, 'coordinates': {{'x': page * 10, 'y': CAST(finding AS INTEGER)}}}} ORDER BY x.doc_id, page, extracted, description) AS evidence FROM <evidence> x LEFT JOIN d ON x.doc_id = d.doc_id GROUP BY 1, 2),
 f AS (SELECT x.case_id, list({{'id': x.seq, 'name': name, 'severity': severity, 'description': name || ' of ' || layer_source, 'layer_source': layer_source, 'evidence': coalesce(evidence, [])}} ORDER BY x.seq, name, severity, layer_source) AS findings FROM <findings> x LEFT JOIN e ON x.case_id = e.case_id AND x.seq = e.seq GROUP BY 1),
 v AS (SELECT case_id, list({{'timestamp': strftime(ts, '%Y-%m-%dT%H:%M:%S'), 'type': event_type, 'message': status}} ORDER BY ts, event_id) AS timeline FROM <case_events> GROUP BY 1),
 s AS (SELECT case_id, {{'executive_summary': executive_summary, 'final_recommendation': final_recommendation}} AS summary FROM ({_CASE_TEXTS})),
 m AS (SELECT case_id, {{'similarity_score': similarity, 'ref_id': ref_id, 'is_fraud': is_fraud}} AS alike FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY similarity DESC, is_fraud, rank) AS n FROM ({TOP}) WHERE rank <= 2) WHERE n = 1)
 SELECT c.case_id, 0 AS part, CAST(to_json({{'investigation_id': c.case_id, 'context': context, 'status': status, 'created_at': strftime(created_at, '%Y-%m-%dT%H:%M:%S'),
  'scores': {{'trust_score': trust_score, 'recommendation': CASE WHEN trust_score >= 85 THEN 'Auto Approved' WHEN trust_score < 50 THEN 'High Risk Manual Review' WHEN trust_score IS NOT NULL THEN 'Manual Review' END}},
  'ai_summary': summary, 'dataset_similarity': alike, 'documents': coalesce(documents, []), 'findings': coalesce(findings, []), 'timeline': coalesce(timeline, [])}}) AS VARCHAR) AS report
 FROM <cases> c LEFT JOIN dl ON c.case_id = dl.case_id LEFT JOIN f ON c.case_id = f.case_id LEFT JOIN v ON c.case_id = v.case_id LEFT JOIN s ON c.case_id = s.case_id LEFT JOIN m ON c.case_id = m.case_id"""
register("s9_case_reports", _reports, _REPORTS)
register("x6_evidence_chain", lambda t: R.evidence_chain(t.findings, t.evidence, _filed(t)), f"SELECT f.case_id, f.seq, f.name, severity, e.doc_id, filename, page, confidence, extracted, description FROM <findings> f LEFT JOIN <evidence> e ON f.case_id = e.case_id AND f.seq = e.finding LEFT JOIN ({_FILED}) d ON e.doc_id = d.doc_id")
register("x6_case_levels", lambda t: R.levels(t.cases, t.findings, t.evidence, t.kyc), """WITH e AS (SELECT case_id, finding AS seq, count(*) AS pieces, count(DISTINCT (doc_id, page)) AS pages, sum(confidence) AS total FROM <evidence> GROUP BY 1, 2),
 f AS (SELECT x.case_id, count(*) AS findings, CAST(min(CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 3 ELSE 9 END) AS INTEGER) AS worst, count(pieces) AS proven, CAST(sum(pieces) AS BIGINT) AS pieces, CAST(sum(pages) AS BIGINT) AS pages, sum(total) AS total FROM <findings> x LEFT JOIN e ON x.case_id = e.case_id AND x.seq = e.seq GROUP BY 1),
 d AS (SELECT case_id, count(*) AS documents FROM <kyc> GROUP BY 1)
 SELECT c.case_id, coalesce(documents, 0) AS documents, coalesce(findings, 0) AS findings, worst, coalesce(proven, 0) AS proven, coalesce(pieces, 0) AS pieces, coalesce(pages, 0) AS pages, round(CAST(total AS DOUBLE) / pieces, 6) AS confidence FROM <cases> c LEFT JOIN d ON c.case_id = d.case_id LEFT JOIN f ON c.case_id = f.case_id""")
register("t1_case_texts", lambda t: K.case_texts(t.cases, t.findings, S.trust_scores(t.findings)), _CASE_TEXTS)
_REPLIES = ['{"a": 1}', '```json\n{"a": 2}\n```', 'Here: {"a": 3} done', "none"]
register("t2_lenient_json", lambda t: t.orders.select("o_orderkey", F.get_json_object(K.lenient_json(F.element_at(F.array(*map(F.lit, _REPLIES)), (F.col("o_orderkey") % 4 + 1).cast("int"))), "$.a").cast("int").alias("a")), "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 END AS a FROM orders")
register("t3_prompts", lambda t: K.prompts(t.cases, t.findings), f"SELECT c.case_id, 'Context: ' || context || CHR(10) || 'Findings:' || coalesce(CHR(10) || lines, '') AS prompt FROM <cases> c LEFT JOIN (SELECT case_id, string_agg('- ' || severity || ' ' || name, CHR(10) ORDER BY place) AS lines FROM ({_RANKED}) GROUP BY 1) l ON c.case_id = l.case_id")
register("t4_bands", lambda t: t.cases.where("trust_score IS NOT NULL").select("case_id", K.report_band(F.col("trust_score")).alias("report"), K.list_band(F.col("trust_score")).alias("listed")), "SELECT case_id, CASE WHEN trust_score > 80 THEN 'LOW RISK' WHEN trust_score > 50 THEN 'MEDIUM RISK' ELSE 'HIGH RISK' END AS report, CASE WHEN trust_score >= 80 THEN 'verified' WHEN trust_score >= 50 THEN 'suspicious' ELSE 'fraudulent' END AS listed FROM <cases> WHERE trust_score IS NOT NULL")
_NODES = f"""WITH k AS (SELECT * FROM <kyc>), r AS ({_RANKED}), p AS (SELECT case_id, coalesce(arg_min(name, seq) FILTER (name IS NOT NULL), 'Applicant') AS label FROM k GROUP BY 1)
 SELECT case_id, 'applicant' AS node, 'Applicant' AS kind, label FROM p UNION ALL SELECT case_id, 'doc_' || doc_id, 'Document', 'Document ' || doc_id FROM k UNION ALL SELECT case_id, 'ent_' || doc_id || '_name', 'Entity', 'name: ' || name FROM k WHERE name IS NOT NULL UNION ALL SELECT case_id, 'ent_' || doc_id || '_pan', 'Entity', 'pan: ' || pan FROM k
 UNION ALL SELECT case_id, 'find_' || place, 'Finding', name FROM r UNION ALL SELECT case_id, 'evid_' || place, 'Evidence', layer_source FROM r UNION ALL SELECT case_id, 'recommendation', 'Recommendation', 'Recommendation' FROM p"""
_EDGES = f"""WITH k AS (SELECT * FROM <kyc>), r AS ({_RANKED}), d AS (SELECT case_id, min(doc_id) AS doc_id FROM k GROUP BY 1)
 SELECT case_id, 'applicant' AS source, 'doc_' || doc_id AS target, 'submitted' AS relation FROM k UNION ALL SELECT case_id, 'doc_' || doc_id, 'ent_' || doc_id || '_name', 'contains' FROM k WHERE name IS NOT NULL UNION ALL SELECT case_id, 'doc_' || doc_id, 'ent_' || doc_id || '_pan', 'contains' FROM k
 UNION ALL SELECT r.case_id, 'doc_' || doc_id, 'evid_' || place, 'contains_evidence' FROM r JOIN d ON r.case_id = d.case_id UNION ALL SELECT case_id, 'evid_' || place, 'find_' || place, 'supports' FROM r UNION ALL SELECT case_id, 'find_' || place, 'recommendation', 'leads_to' FROM r"""
register("g1_graph_nodes", lambda t: K.graph_nodes(t.kyc, t.findings), _NODES)
register("g1_graph_edges", lambda t: K.graph_edges(t.kyc, t.findings), _EDGES)
register("g2_graph_counts", lambda t: K.graph_edges(t.kyc, t.findings).groupBy("case_id", "relation").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources")), f"SELECT case_id, relation, count(*) AS n, count(DISTINCT source) AS sources FROM ({_EDGES}) GROUP BY 1, 2")
_SPACES = "trim(regexp_replace(regexp_replace({}, '{}', '', 'g'), '\\s+', ' ', 'g'))"
_LINES = "list_filter(list_transform(string_split({}, CHR(10)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
_DAY = "\\b\\d{2}[/.-]\\d{2}[/.-]\\d{4}\\b"


def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _valid(c: str) -> str:
    name = f"upper(array_to_string(list_filter(string_split({_SPACES.format(c, '[^A-Za-z\\s.]')}, ' '), lambda w: upper(w) NOT IN ({_in(NOT_NAMES)}) AND w <> ''), ' '))"
    return f"CASE WHEN length(replace({name}, ' ', '')) >= 3 THEN {name} END"


_USABLE = f"array_to_string(list_filter(string_split({_SPACES.format('x', '[^A-Za-z\\s]')}, ' '), lambda w: upper(w) NOT IN ({_in(E.NAME_STOPS)}) AND length(w) >= 3), ' ')"
register("e14_pan_names", lambda t: t.kyc.select("doc_id", E.pan_names(F.col("text")).alias("n")).select("doc_id", "n.name", "n.father"), f"""WITH l AS (SELECT doc_id, {_LINES.format('text')} AS lines FROM <kyc>),
 a AS (SELECT doc_id, lines, coalesce(list_position(list_transform(lines, lambda x: regexp_matches(x, '{_DAY}|\\b[A-Z]{{5}}[0-9]{{4}}[A-Z]\\b')), TRUE), 0) AS stop FROM l),
 j AS (SELECT doc_id, array_to_string(list_transform(CASE WHEN stop > 0 THEN lines[1:stop - 1] ELSE lines END, lambda x: {_USABLE}), '|') AS joined FROM a),
 g AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(joined, '\\|\\|+'), lambda x: trim(replace(x, '|', ' '))), lambda x: x <> '') AS parts FROM j)
 SELECT doc_id, {_valid('parts[1]')} AS name, {_valid('parts[2]')} AS father FROM g""")
register("e15_aadhaar_name", lambda t: t.kyc.select("doc_id", E.aadhaar_name(F.regexp_replace("text", "Name: ", "")).alias("name")), f"""WITH l AS (SELECT doc_id, body, {_LINES.format('body')} AS lines FROM (SELECT doc_id, replace(text, 'Name: ', '') AS body FROM <kyc>)),
 a AS (SELECT *, coalesce(list_position(list_transform(lines, lambda x: regexp_matches(x, '(?i)dob|yob|year of birth|birth|{_DAY}')), TRUE), 0) AS place FROM l),
 g AS (SELECT doc_id, body, list_filter(list_reverse(lines[1:place - 1]), lambda x: regexp_matches(x, '^[A-Za-z\\s.]+$') AND ({_valid('x')}) IS NOT NULL AND NOT regexp_matches(x, '(?i)government|india|unique|authority')) AS good FROM (SELECT doc_id, body, CASE WHEN place > 0 THEN lines ELSE [] END AS lines, place FROM a)),
 n AS (SELECT doc_id, coalesce(good[1], regexp_replace(nullif(regexp_extract(body, '(?i)(?:name|employee\\s+name|customer\\s+name)[:\\s]+([A-Z\\s.]{{3,30}})', 1), ''), '^\\s+|\\s+$', '', 'g')) AS line FROM g)
 SELECT doc_id, {_valid('line')} AS name FROM n""")
register("e16_father_name", lambda t: t.kyc.select("doc_id", E.father_name(F.concat(F.lit("Father's Name\n"), F.coalesce("name", F.lit("-")), F.lit("\n"), F.col("text"))).alias("father")), "SELECT doc_id, name AS father FROM <kyc>")
_NAME_RE = "\\b[A-Z][a-z]+(?: [A-Z][a-z]+){1,3}\\b"
_TERMS = "SELECT doc_id, term, arg_min(category, ord) AS category FROM (" + " UNION ALL ".join(f"SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '[À-ÿ]', '_', 'g'), '{p}')) AS term, {k} AS ord, '{c}' AS category FROM documents" for k, (c, p) in enumerate(fields.TERMS)) + ") WHERE category <> 'Name/Address' OR length(term) < 40 GROUP BY 1, 2"
register("e24_field_terms", lambda t: fields.field_terms(t.documents).groupBy("category").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs")), f"SELECT category, count(*) AS n, count(DISTINCT doc_id) AS docs FROM ({_TERMS}) GROUP BY 1")
register("e24_names", lambda t: fields.field_terms(t.documents.select("doc_id", "text")).where("category = 'Name/Address'").select("doc_id", "term"), f"SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '[À-ÿ]', '_', 'g'), '{_NAME_RE}')) AS term FROM documents) WHERE length(term) < 40")


def _runs(t):
    return fields.run_places(fields.field_terms(t.documents.select("doc_id", "text")), t.boxes)


_BARE = "regexp_replace({}, '^" + fields.MARKS + "+|" + fields.MARKS + "+$', '', 'g')"
_PLACES = f"""WITH w AS (SELECT doc_id, pos, {_BARE.format('word')} AS key, list({{'word': word, 'page': page, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}}) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS run FROM <boxes>),
 t AS (SELECT *, string_split(term, ' ') AS parts FROM ({_TERMS})),
 h AS (SELECT w.doc_id, term, category, pos, run[1:len(parts)] AS run FROM w JOIN t ON w.doc_id = t.doc_id AND w.key = {_BARE.format('t.parts[1]')} WHERE len(parts) <= 4 AND len(run) >= len(parts)),
 p AS (SELECT doc_id, term, category, pos, list_min(list_transform(run, lambda r: r.page)) AS page, list_min(list_transform(run, lambda r: r.x0)) AS x, list_min(list_transform(run, lambda r: r.y0)) AS y, list_max(list_transform(run, lambda r: r.x1)) AS x1, list_max(list_transform(run, lambda r: r.y1)) AS y1
  FROM h WHERE {_BARE.format("array_to_string(list_transform(run, lambda r: r.word), ' ')")} = term AND list_min(list_transform(run, lambda r: r.page)) = list_max(list_transform(run, lambda r: r.page))),
 q AS (SELECT * FROM p QUALIFY category <> 'Amount' OR row_number() OVER (PARTITION BY doc_id, category ORDER BY page, pos, term) <= 15)
 SELECT doc_id, term, category, page, x, y, x1 - x AS width, y1 - y AS height FROM q QUALIFY row_number() OVER (PARTITION BY doc_id, page, x, y ORDER BY category = 'Amount', pos, term) = 1"""
register("e25_term_places", _runs, _PLACES)
register("e26_regions", lambda t: fields.field_regions(_runs(t)), f"SELECT doc_id, page, x, y, width, height, 'high' AS severity, category AS signal_name, 'forensic_field' AS signal_id, term AS text FROM ({_PLACES})")
_WORD_PLACES = """WITH w AS (SELECT * FROM <words>), t AS (SELECT DISTINCT doc_id, word AS term, CASE WHEN length(word) >= 12 THEN 'Amount' ELSE 'Date' END AS category FROM w WHERE length(word) >= 9),
 h AS (SELECT t.doc_id, term, category, pos, page, x0 AS x, y0 AS y, row_number() OVER (PARTITION BY t.doc_id, category ORDER BY pos, term) AS rank FROM t JOIN w ON t.doc_id = w.doc_id AND t.term = w.word)
 SELECT doc_id, term, category, page, x, y FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page, x, y ORDER BY pos, term) AS again FROM h WHERE category <> 'Amount' OR rank <= 15) WHERE again = 1"""


def _all_places(t):
    """Terms of all words."""
    words = t.words
    terms = words.where("length(word) >= 9").select("doc_id", F.col("word").alias("term"), F.when(F.length("word") >= 12, "Amount").otherwise("Date").alias("category")).distinct()
    return fields.term_places(terms, words)


register("e25_all_places", _all_places, _WORD_PLACES)
register("e26_all_regions", lambda t: fields.regions(_all_places(t), t.spark.createDataFrame([("Amount", "HIGH", "Altered amount"), ("Date", "MEDIUM", "Altered date")], "category string, severity string, signal string")),
         f"SELECT doc_id, page, x, y, CASE category WHEN 'Amount' THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CASE category WHEN 'Amount' THEN 'Altered amount' ELSE 'Altered date' END AS signal, term AS text FROM ({_WORD_PLACES})")
register("r1_incremental_intake", lambda t: flows.intake_of(t.table("documents"), t.sf_dir).drop("arrived", "batch"), "SELECT sha256(text) AS content_key, min(doc_id) AS doc_id, CAST(length(text) AS INTEGER) AS n_chars FROM documents GROUP BY ALL")
register("r2_status_stream", lambda t: flows.status_of(t.sf_dir, t.spark), f"SELECT case_id, progress, status FROM ({_LATEST})")
register("r3_balance_stream", lambda t: flows.balances_of(t.rows), """SELECT doc_id, row_no, kind FROM (SELECT *, CASE WHEN prev IS NULL THEN NULL WHEN abs(prev - amount - balance) <= 0.5 THEN 'debit' WHEN abs(prev + amount - balance) <= 0.5 THEN 'credit' ELSE 'error' END AS kind FROM (SELECT *, lag(balance) OVER (PARTITION BY doc_id ORDER BY page, row_no) AS prev FROM <rows>))""")


def _recommended(t):
    return t.cases.withColumn("recommendation", F.when(F.col("trust_score").isNotNull(), S.recommendation(F.col("trust_score"))))


_RECOMMENDED = "SELECT *, CASE WHEN trust_score >= 85 THEN 'AUTO_APPROVE' WHEN trust_score < 50 THEN 'HIGH_RISK_MANUAL_REVIEW' WHEN trust_score IS NOT NULL THEN 'MANUAL_REVIEW' END AS recommendation FROM <cases>"
_NOW = "2024-01-02T03:04:05"
register("s11_snapshot", lambda t: S.snapshot(_recommended(t), _NOW), f"""WITH c AS ({_RECOMMENDED})
 SELECT NULL AS case_id, CAST(to_json({{generated_at: '{_NOW}', total_investigations: count(*), completed: count(*) FILTER (status = 'COMPLETED'), auto_approved: count(*) FILTER (status = 'COMPLETED' AND recommendation = 'AUTO_APPROVE'), manual_review: count(*) FILTER (status = 'COMPLETED' AND recommendation IS DISTINCT FROM 'AUTO_APPROVE')}}) AS VARCHAR) AS line FROM c
 UNION ALL SELECT case_id, CAST(to_json({{id: case_id, title: title, context: context, status: status, trust_score: trust_score, recommendation: recommendation}}) AS VARCHAR) FROM c""")
_ITEM = "SELECT '{0}' AS kind, CAST(to_json({{{1}}}) AS VARCHAR) AS item FROM <{2}> WHERE case_id = 7"


def _case_file(t):
    docs, found = t.kyc.select("case_id", "doc_id", "name", "pan", "text"), t.findings.select("case_id", "seq", "name", "severity", "layer_source")
    return R.case_file(7, t.cases.select("case_id", "context", "status", "title"), document=docs, finding=found, evidence=t.evidence.select("case_id", "finding", "doc_id", "page", "extracted"), event=t.case_events.select("case_id", "event_id", "event_type", "progress"))


register("p2_case_file", _case_file, " UNION ALL ".join(_ITEM.format(kind, ", ".join(f"{c}: {c}" for c in columns.split()), lens) for kind, columns, lens in [
    ("case", "case_id context status title", "cases"), ("document", "case_id doc_id name pan text", "kyc"), ("finding", "case_id seq name severity layer_source", "findings"), ("evidence", "case_id finding doc_id page extracted", "evidence"), ("event", "case_id event_id event_type progress", "case_events")]))


def _case_prompts(t):
    docs = t.kyc.select("case_id", "doc_id", F.concat(F.lit("doc-"), F.col("doc_id"), F.lit(".pdf")).alias("filename"), F.lit("PAN Card").alias("classification"), (60 + F.col("doc_id") % 41).alias("ocr_confidence"), F.when(F.col("doc_id") % 4 == 0, "Canva").alias("producer"), F.lit(None).cast("string").alias("creator"))
    findings = t.findings.withColumn("description", F.concat_ws(" ", "name", F.lit("of"), "layer_source"))
    return R.prompts(_recommended(t), docs, findings, t.evidence, nearest(t))


_T = R.PROMPT


def _headed(section: int, name: str, kind: str) -> str:
    return f"SELECT case_id, {section}, 0, 0, 0, 0, CHR(10) || '{_T[name]}' || CASE WHEN case_id IN (SELECT case_id FROM {kind}) THEN '' ELSE CHR(10) || '{_T['no ' + name]}' END FROM c"


register("t3_case_prompts", _case_prompts, f"""WITH c AS ({_RECOMMENDED}), d AS (SELECT *, 'doc-' || doc_id || '.pdf' AS filename FROM <kyc>), f AS (SELECT * FROM <findings>), e AS (SELECT * FROM <evidence>), m AS ({TOP_ALL}),
 lines(case_id, section, ord, below, place, page, line) AS (
 SELECT case_id, 0, 0, 0, 0, 0, '{_T['metrics']}' || CHR(10) || '- Case Context: ' || coalesce(context, 'None') || CHR(10) || '- Trust Score: ' || coalesce(CAST(trust_score AS VARCHAR), 'None') || '/100' || CHR(10) || '- Rule Engine Suggestion: ' || coalesce(recommendation, 'None') FROM c
 UNION ALL {_headed(1, 'documents', 'd')}
 UNION ALL SELECT case_id, 2, doc_id, 0, 0, 0, '- File: ' || filename || CHR(10) || '  Type: PAN Card' || CHR(10) || '  OCR Accuracy: ' || (60 + doc_id % 41) || '%' || CHR(10) || '  Producer: ' || CASE WHEN doc_id % 4 = 0 THEN 'Canva' ELSE 'None' END || CHR(10) || '  Creator/Editor: None' FROM d
 UNION ALL {_headed(3, 'findings', 'f')}
 UNION ALL SELECT case_id, 4, seq, 0, 0, 0, '- Finding Name: ' || name || CHR(10) || '  Severity: ' || severity || CHR(10) || '  Source: ' || layer_source || CHR(10) || '  Description: ' || name || ' of ' || layer_source || CHR(10) || '  Evidence Items:'
   || CASE WHEN EXISTS (SELECT 1 FROM e WHERE e.case_id = f.case_id AND e.finding = f.seq) THEN '' ELSE CHR(10) || '{_T['no evidence']}' END FROM f
 UNION ALL SELECT e.case_id, 4, finding, 1, e.doc_id, page, '  - Evidence in ' || coalesce(filename, 'None') || ' on page ' || page || ': ' || description || ' [Text: ' || CHR(39) || extracted || CHR(39) || ']' FROM e LEFT JOIN d ON e.doc_id = d.doc_id
 UNION ALL {_headed(5, 'matches', 'm')}
 UNION ALL SELECT case_id, 6, CAST(is_fraud AS INTEGER), rank, 0, 0, '  * ' || ref_id || ' (' || similarity || '% match) - Label: ' || CASE WHEN is_fraud THEN 'fraud' ELSE 'genuine' END FROM m)
 SELECT case_id, 0 AS part, string_agg(line, CHR(10) ORDER BY section, ord, below, place, page, line) AS prompt FROM lines WHERE case_id IN (SELECT case_id FROM c) GROUP BY case_id""")
