"""Queries of statement checks and detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import money
from ..operators import cases as K, classify as C, detectors as D, gating, scoring, statements as S
from .queries_documents import classified
from .registry import register

_W = "OVER (PARTITION BY doc_id ORDER BY page, row_no)"
CHECKED = f"""SELECT *, CASE WHEN prev IS NULL OR amount IS NULL THEN NULL WHEN abs(prev - amount - balance) <= 0.5 THEN 'debit' WHEN abs(prev + amount - balance) <= 0.5 THEN 'credit' ELSE 'error' END AS kind
 FROM (SELECT *, lag(balance) {_W} AS prev FROM <rows>)"""
CLOSING = f"""SELECT doc_id, CAST(opening + credit - debit AS DECIMAL(18,2)) AS expected, shown, CAST(abs(opening + credit - debit - shown) AS DECIMAL(18,2)) AS difference FROM (
 SELECT doc_id, count(*) AS n, arg_min(balance, row_no) AS opening, arg_max(balance, row_no) AS shown, coalesce(sum(CASE WHEN kind = 'credit' THEN amount END), 0) AS credit, coalesce(sum(CASE WHEN kind = 'debit' THEN amount END), 0) AS debit FROM ({CHECKED}) GROUP BY doc_id)
 WHERE n >= 2 AND NOT (credit = 0 AND debit = 0)"""
ERRORS = f"SELECT doc_id, CAST(count(*) AS INTEGER) AS n_errors, list_sort(list(row_no))[1:3] AS first_rows FROM ({CHECKED}) WHERE kind = 'error' GROUP BY doc_id"
register("w1_running_balance", lambda t: S.checked_rows(t.rows).select("doc_id", "row_no", "kind"), f"SELECT doc_id, row_no, kind FROM ({CHECKED})")
register("w1_balance_errors", lambda t: S.balance_errors(t.rows), ERRORS)
register("a15_closing_balance", lambda t: S.closing_check(t.rows), CLOSING)
register("d4_balance_findings", lambda t: S.balance_findings(t.rows), f"SELECT doc_id, 'Balance Calculation Error' AS name, 'CRITICAL' AS severity FROM ({ERRORS}) UNION ALL SELECT doc_id, 'Opening/Closing Balance Mismatch', 'HIGH' FROM ({CLOSING}) WHERE difference > 1")
_DIGIT = "CAST(nullif(regexp_extract(CAST(abs(amount) AS VARCHAR), '[1-9]'), '') AS INTEGER)"
register("a8b_digit_table", lambda t: S.digit_table(t.rows), "SELECT doc_id, " + ", ".join(f"count(*) FILTER ({_DIGIT} = {k}) AS digit_{k}" for k in range(1, 10)) + " FROM <rows> GROUP BY doc_id")
_STATS = f"SELECT *, n >= 20 AND ones < 0.05 AS benford_anomaly, whole > 0.4 AS round_anomaly FROM (SELECT doc_id, count(*) AS n, round(avg(CASE WHEN {_DIGIT} = 1 THEN 1.0 ELSE 0.0 END), 9) AS ones, round(avg(CASE WHEN amount % 1 = 0 THEN 1.0 ELSE 0.0 END), 9) AS whole FROM <rows> WHERE amount IS NOT NULL GROUP BY doc_id)"
register("a8_benford", lambda t: S.amount_statistics(t.rows).select("doc_id", "n", "ones", "benford_anomaly"), f"SELECT doc_id, n, ones, benford_anomaly FROM ({_STATS})")
register("a9_round_numbers", lambda t: S.amount_statistics(t.rows).select("doc_id", "whole", "round_anomaly"), f"SELECT doc_id, whole, round_anomaly FROM ({_STATS})")



def _rounded(t):
    return t.rows.withColumn("amount", F.when(F.col("doc_id") % 3 == 0, F.floor("amount")).otherwise(F.col("amount")).cast("decimal(18,2)"))


_ROUND_STATS = _STATS.replace("<rows>", "(SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN CAST(floor(amount) AS DECIMAL(18,2)) ELSE amount END AS amount) FROM <rows>)")
register("d6_statistic_findings", lambda t: S.statistic_findings(_rounded(t)), f"SELECT doc_id, 'Statistical Anomaly' AS name, 'MEDIUM' AS severity FROM ({_ROUND_STATS}) WHERE benford_anomaly UNION ALL SELECT doc_id, 'Round Number Anomaly', 'MEDIUM' FROM ({_ROUND_STATS}) WHERE round_anomaly")
_LINES = "SELECT doc_id, CAST(i AS INTEGER) AS row_no, ls[i + 1] AS line FROM (SELECT doc_id, string_split(text, CHR(10)) AS ls FROM <statements>), unnest(range(len(ls))) AS u(i)"
_AMOUNTS = f"regexp_extract_all(line, '{money.AMOUNT}')"
PARSED = f"SELECT doc_id, 1 AS page, row_no, CAST(replace(a[-2], ',', '') AS DECIMAL(18,2)) AS amount, CAST(replace(a[-1], ',', '') AS DECIMAL(18,2)) AS balance, trim(line) AS raw FROM (SELECT *, {_AMOUNTS} AS a FROM ({_LINES}) WHERE regexp_matches(line, '{money.DATED_LINE}')) WHERE len(a) > 0"
register("d3_statement_rows", lambda t: S.statement_rows(t.statements), PARSED)
_HEADS = [["Txn Date", "Particulars", "Debit Amount", "Balance"], ["Date", "Credits", "Closing Balance"], ["Notes"]]
register("d3b_find_column", lambda t: t.customer.select("c_custkey", D.find_column(F.element_at(F.array(*[F.array(*[F.lit(h) for h in hs]) for hs in _HEADS]), (F.col("c_custkey") % 3 + 1).cast("int")), ["balance", "debit"]).alias("place")), "SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 2 END AS place FROM customer")


def _sequence(t):
    return t.statements.select("doc_id", F.posexplode(money.amounts(F.col("text"))).alias("pos", "amount"))


_TRIPLE = f"""SELECT doc_id, checks, mismatches, checks >= 3 AND mismatches > checks * 0.5 AS flagged FROM (SELECT doc_id, count(*) AS n, count(*) FILTER (b > 0 AND c > 0) AS checks,
  count(*) FILTER (b > 0 AND c > 0 AND least(abs(a + b - c), abs(a - b - c), abs(b - a - c)) > 0.5) AS mismatches FROM (SELECT doc_id, a, lead(a, 1) OVER w AS b, lead(a, 2) OVER w AS c
   FROM (SELECT doc_id, i AS pos, CAST(replace(l[i + 1], ',', '') AS DECIMAL(18,2)) AS a FROM (SELECT doc_id, regexp_extract_all(text, '{money.AMOUNT}') AS l FROM <statements>), unnest(range(len(l))) AS u(i)) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) GROUP BY doc_id) WHERE n >= 5"""
register("w2_triple_check", lambda t: S.triple_check(_sequence(t)), _TRIPLE)
register("d16_altered_bank_math", lambda t: S.triple_check(_sequence(t)).where("flagged").select("doc_id", F.lit("altered_bank_math").alias("signal")), f"SELECT doc_id, 'altered_bank_math' AS signal FROM ({_TRIPLE}) WHERE flagged")
_NUM = "[:\\s\\-]*([0-9,]+\\.\\d{2}|[0-9,]+)"


def _val(words: str) -> str:
    return f"TRY_CAST(replace(nullif(regexp_extract(text, '(?i)(?:{words}){_NUM}', 1), ''), ',', '') AS DECIMAL(18,2))"


register("d5_payslip_math", lambda t: D.payslip_math(t.slips), f"SELECT *, abs(gross - deductions - net) > 2.0 AS mismatch FROM (SELECT doc_id, {_val('gross|basic|earnings')} AS gross, {_val('deduction|total deductions|deductions')} AS deductions, {_val('net|net\\s+pay|take\\s+home')} AS net FROM <slips>) WHERE gross IS NOT NULL AND deductions IS NOT NULL AND net IS NOT NULL")
_DATES = """SELECT doc_id, raw, coalesce(d1, d2) AS date, CASE WHEN d1 IS NOT NULL THEN 'DD/MM/YYYY' WHEN d2 IS NOT NULL THEN 'MM/DD/YYYY' ELSE 'INVALID' END AS format FROM (
 SELECT doc_id, raw, CAST(try_strptime(raw, '%d/%m/%Y') AS DATE) AS d1, CAST(try_strptime(raw, '%m/%d/%Y') AS DATE) AS d2 FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\\b\\d{1,2}[/-]\\d{1,2}[/-]\\d{4}\\b')) AS raw FROM <statements>))"""
register("d7_dates", lambda t: D.date_rows(t.statements), _DATES)
register("d8_date_findings", lambda t: D.date_findings(t.statements, "1997-06-01"), f"""WITH s AS (SELECT doc_id, bool_or(format = 'INVALID') AS bad, bool_or(date > DATE '1997-06-01') AS late, count(DISTINCT CASE WHEN format <> 'INVALID' THEN format END) AS n FROM ({_DATES}) GROUP BY doc_id)
 SELECT doc_id, 'Impossible Date' AS name, 'CRITICAL' AS severity FROM s WHERE bad UNION ALL SELECT doc_id, 'Future Date', 'HIGH' FROM s WHERE late UNION ALL SELECT doc_id, 'Mixed Date Formats', 'MEDIUM' FROM s WHERE n > 1""")
_EOF, _SIG = "len(regexp_extract_all(raw, '%%EOF'))", "regexp_matches(raw, '/Type\\s*/Sig')"
_OFFICIAL = "regexp_matches(lower(text), '" + "|".join(D.OFFICIAL) + "')"
register("d9_revisions", lambda t: D.revisions(t.raw), f"SELECT doc_id, 'Multiple PDF Revisions' AS name, 'HIGH' AS severity FROM <raw> WHERE {_EOF} > 1 UNION ALL SELECT doc_id, 'PDF Incremental Update Trace', 'MEDIUM' FROM <raw> WHERE regexp_matches(raw, '/Prev\\s+\\d+')")
register("d10_signatures", lambda t: D.signatures(t.raw), f"""SELECT doc_id, 'Incomplete Digital Signature' AS name, 'MEDIUM' AS severity FROM <raw> WHERE {_SIG} AND contains(raw, '/ByteRange') AND NOT regexp_matches(raw, '/Cert|/PKCS')
 UNION ALL SELECT doc_id, 'Missing Digital Signature', 'MEDIUM' FROM <raw> WHERE NOT {_SIG} AND {_OFFICIAL} UNION ALL SELECT doc_id, 'Signature Integrity Concern', 'HIGH' FROM <raw> WHERE {_EOF} > 2 AND {_SIG}""")


def _software(words: list[str]) -> str:
    return "SELECT doc_id, software FROM <raw>, unnest([" + ", ".join(f"'{w}'" for w in words) + "]) AS u(software) WHERE contains(lower(coalesce(producer, '')), software) OR contains(lower(coalesce(creator, '')), software)"


register("d11_editing_software", lambda t: D.software(t.raw), f"SELECT doc_id, software, 'Editing Software Signature' AS name, 'HIGH' AS severity FROM ({_software(D.SOFTWARE)})")
register("d12_metadata_dates", lambda t: D.date_mismatch(t.raw), "SELECT doc_id, 'Metadata Date Mismatch' AS name, 'MEDIUM' AS severity FROM <raw> WHERE created <> modified")
register("d13_typos", lambda t: D.typos(t.raw), "SELECT doc_id, typo, 'Template Spelling Anomaly' AS name, 'MEDIUM' AS severity FROM <raw>, unnest([" + ", ".join(f"'{w}'" for w in D.TYPOS) + "]) AS u(typo) WHERE regexp_matches(lower(text), '\\b' || typo || '\\b')")
register("d14_error_levels", lambda t: D.error_levels(t.images), "SELECT doc_id, 'Error Level Anomaly' AS name, 'HIGH' AS severity FROM <images> WHERE mean_diff > 3.0 OR std_diff > 4.5")
register("d15_image_software", lambda t: D.software(t.raw, D.IMAGE_SOFTWARE).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("software")), ", ").alias("software")), f"SELECT doc_id, string_agg(software, ', ' ORDER BY software) AS software FROM ({_software(D.IMAGE_SOFTWARE)}) GROUP BY doc_id")
_LOW = "lower(text)"
_RENTS = "list_transform(regexp_extract_all(lower(text), 'rent[:\\s]+[\\$£€]?\\s*(\\d{1,3}(?:,\\d{3})*(?:\\.\\d{2})?)', 1), lambda x: CAST(replace(x, ',', '') AS DOUBLE))"
for _id, _signal, _where in [
    ("d17_phantom_rent", "phantom_rental_income", f"regexp_matches({_LOW}, '{'|'.join(D.RENTAL)}') AND NOT regexp_matches({_LOW}, '{'|'.join(D.DEPOSITS)}')"),
    ("d18_inflated_rent", "inflated_market_rent", f"list_avg({_RENTS}) > 5000"),
    ("d19_account_seasoning", "sudden_account_seasoning", f"len(regexp_extract_all({_LOW}, 'deposit[:\\s]+[\\$£€]?\\s*([5-9]\\d{{3,}}|[1-9]\\d{{4,}})')) >= 2"),
    ("d20_missing_pages", "missing_statement_pages", "regexp_extract(lower(text), 'page\\s+(\\d+)\\s+of\\s+(\\d+)', 1) <> regexp_extract(lower(text), 'page\\s+(\\d+)\\s+of\\s+(\\d+)', 2)"),
    ("d22_p2p_deposits", "irregular_rent_deposits", f"regexp_matches({_LOW}, '{'|'.join(D.P2P)}')"),
]:
    register(_id, lambda t, s=_signal: D.lease_signals(t.slips).where(F.col("signal") == s), f"SELECT doc_id, '{_signal}' AS signal FROM <slips> WHERE {_where}")
register("d21_stale_documents", lambda t: t.statements.select("doc_id", D.oldest_date(F.col("text")).alias("oldest"), (F.datediff(F.lit("1998-08-02").cast("date"), D.oldest_date(F.col("text"))) > 90).alias("stale")),
         f"SELECT doc_id, min(date) AS oldest, date_diff('day', min(date), DATE '1998-08-02') > 90 AS stale FROM ({_DATES}) GROUP BY doc_id")
_CATALOGUE = "(VALUES " + ", ".join("('{}', '{}', '{}', {}, {})".format(k, n.replace("'", "''"), s.upper(), w, k in D.DETECTED) for k, n, s, w in D.SIGNALS) + ") AS c(signal, name, severity, weight, has_detector)"
register("x11_signal_lookup", lambda t: D.lease_signals(t.slips).join(F.broadcast(D.catalogue(t.spark)), "signal").groupBy("signal", "name", "severity", "weight").agg(F.count("*").alias("n")),
         f"SELECT c.signal, c.name, c.severity, c.weight, count(*) AS n FROM {_CATALOGUE} JOIN (" + " UNION ALL ".join(f"SELECT doc_id, '{s}' AS signal FROM <slips> WHERE {w}" for s, w in (
             ("phantom_rental_income", f"regexp_matches({_LOW}, '{'|'.join(D.RENTAL)}') AND NOT regexp_matches({_LOW}, '{'|'.join(D.DEPOSITS)}')"), ("inflated_market_rent", f"list_avg({_RENTS}) > 5000"), ("sudden_account_seasoning", f"len(regexp_extract_all({_LOW}, 'deposit[:\\s]+[\\$£€]?\\s*([5-9]\\d{{3,}}|[1-9]\\d{{4,}})')) >= 2"),
             ("missing_statement_pages", "regexp_extract(lower(text), 'page\\s+(\\d+)\\s+of\\s+(\\d+)', 1) <> regexp_extract(lower(text), 'page\\s+(\\d+)\\s+of\\s+(\\d+)', 2)"), ("irregular_rent_deposits", f"regexp_matches({_LOW}, '{'|'.join(D.P2P)}')"))) + ") f ON c.signal = f.signal GROUP BY ALL")
register("d23_catalogue_use", lambda t: D.catalogue(t.spark).join(D.lease_signals(t.slips).groupBy("signal").agg(F.count("*").alias("n")), "signal", "left").groupBy("severity", "has_detector").agg(F.count("*").alias("signals"), F.sum("weight").cast("long").alias("weight"), F.count_if(F.col("n") > 0).alias("seen")),
         f"SELECT severity, has_detector, count(*) AS signals, CAST(sum(weight) AS BIGINT) AS weight, count(*) FILTER (signal IN ('phantom_rental_income','inflated_market_rent','sudden_account_seasoning','missing_statement_pages','irregular_rent_deposits') AND (SELECT count(*) FROM orders) > 50) AS seen FROM {_CATALOGUE} GROUP BY 1, 2")
_BASE = "trim(string_split(string_split(lower(font), '-')[1], ',')[1])"
_FAM = f"SELECT doc_id, count(DISTINCT {_BASE}) AS n, bool_or(regexp_matches({_BASE}, '{'|'.join(D.CONSUMER_FONTS)}')) AS consumer, bool_or(regexp_matches({_BASE}, '{'|'.join(D.BANK_FONTS)}')) AS bank FROM <spans> GROUP BY doc_id"
register("a12_font_families", lambda t: D.font_findings(t.spans).where("name = 'Font Inconsistency'"), f"SELECT doc_id, 'Font Inconsistency' AS name, 'HIGH' AS severity FROM ({_FAM}) WHERE n > 4")
register("a13_mixed_fonts", lambda t: D.font_findings(t.spans).where("name = 'Mixed Font Origin'"), f"SELECT doc_id, 'Mixed Font Origin' AS name, 'HIGH' AS severity FROM ({_FAM}) WHERE consumer AND bank")
_ODD = "WITH k AS (SELECT doc_id, size + CASE WHEN page = 7 THEN 6 ELSE 0 END AS size, count(*) AS n FROM {rows} GROUP BY 1, 2), m AS (SELECT doc_id, arg_max(size, n * 1000 - size) AS main, sum(n) AS total FROM k GROUP BY doc_id) SELECT k.doc_id, size, n, main FROM k JOIN m ON k.doc_id = m.doc_id WHERE abs(size - main) > 2 AND n < total * 0.05"


def _odd(spans):
    return D.odd_sizes(spans.withColumn("size", F.col("size") + F.when(F.col("page") == 7, 6).otherwise(0)))


# Documents of hundreds of spans: all lines of a supplier.
register("a14_odd_sizes", lambda t: _odd(t.lineitem.select(F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page"), (8 + F.col("l_quantity").cast("int") % 5).alias("size"))), _ODD.replace("{rows}", "(SELECT l_suppkey AS doc_id, l_linenumber AS page, 8 + CAST(l_quantity AS INT) % 5 AS size FROM lineitem)"))
register("a14_all_sizes", lambda t: _odd(t.spans), _ODD.replace("{rows}", "<spans>"))


def _gated(t):
    """D24: payslip rule for payslips only, in cases whose context has rules."""
    cases = t.cases.select(F.col("case_id").alias("doc_id"), "context").where(F.col("context").isin("Loan Approval", "Mortgage Underwriting", "Tenant Screening"))
    docs = C.classify(t.slips).where("classification = 'Payslip'").join(cases, "doc_id", "left_semi")
    return D.payslip_math(docs).where("mismatch").select("doc_id", F.lit("Altered Payslip Math").alias("name"), F.lit("HIGH").alias("severity"))


register("d24_context_gate", _gated, f"""WITH c AS (SELECT doc_id, text FROM ({classified('slips')}) WHERE classification = 'Payslip' AND doc_id IN (SELECT case_id FROM <cases> WHERE context IN ('Loan Approval','Mortgage Underwriting','Tenant Screening')))
 SELECT doc_id, 'Altered Payslip Math' AS name, 'HIGH' AS severity FROM c WHERE abs({_val('gross|basic|earnings')} - {_val('deduction|total deductions|deductions')} - {_val('net|net\\s+pay|take\\s+home')}) > 2.0""")


def _files(t):
    """All documents of all cases: payslips and leases, and the statement of each account."""
    both = t.slips.select("case_id", "doc_id", "text").unionByName(t.statements.select(F.col("doc_id").alias("case_id"), (-F.col("doc_id")).alias("doc_id"), "text"))
    return C.classify(both).select("case_id", "doc_id", "text", "classification")


_GATED = f"""docs AS (SELECT case_id, doc_id, text, classification FROM ({classified('slips')}) UNION ALL SELECT doc_id, -doc_id, text, classification FROM ({classified('statements')})),
 g AS (SELECT d.*, lower(context) AS context FROM docs d JOIN <cases> c ON d.case_id = c.case_id WHERE text <> '' AND replace(lower(context), ' ', '_') IN ({', '.join(repr(k) for k in K.CONTEXT_RULES)})),
 b AS (SELECT -doc_id AS doc_id, page, row_no, amount, balance FROM ({PARSED}) WHERE -doc_id IN (SELECT doc_id FROM g WHERE classification = 'Bank Statement')),
 r AS (SELECT doc_id, case_id, text FROM g WHERE context IN ('mortgage underwriting', 'tenant screening'))"""
_SIGNALLED = " UNION ALL ".join(f"SELECT doc_id, '{s}' AS signal FROM r WHERE {w}" for s, w in (
    ("phantom_rental_income", f"regexp_matches({_LOW}, '{'|'.join(D.RENTAL)}') AND NOT regexp_matches({_LOW}, '{'|'.join(D.DEPOSITS)}')"),
    ("inflated_market_rent", f"list_avg({_RENTS}) > 5000"),
    ("sudden_account_seasoning", f"len(regexp_extract_all({_LOW}, 'deposit[:\\s]+[\\$£€]?\\s*([5-9]\\d{{3,}}|[1-9]\\d{{4,}})')) >= 2"),
    ("missing_statement_pages", "regexp_extract(lower(text), 'page\\s+(\\d+)\\s+of\\s+(\\d+)', 1) <> regexp_extract(lower(text), 'page\\s+(\\d+)\\s+of\\s+(\\d+)', 2)"),
    ("irregular_rent_deposits", f"regexp_matches({_LOW}, '{'|'.join(D.P2P)}')"),
    ("stale_documentation", "date_diff('day', list_min(list_transform(regexp_extract_all(text, '\\d{2}/\\d{2}/\\d{4}'), lambda x: CAST(strptime(x, '%d/%m/%Y') AS DATE))), DATE '1998-08-02') > 90"),
))
register("d24_context_findings", lambda t: gating.context_findings(t.cases, _files(t), "1998-08-02"), f"""WITH {_GATED},
 found AS (SELECT doc_id, 'Balance Calculation Error' AS name, 'CRITICAL' AS severity FROM ({ERRORS.replace('<rows>', 'b')}) UNION ALL SELECT doc_id, 'Opening/Closing Balance Mismatch', 'HIGH' FROM ({CLOSING.replace('<rows>', 'b')}) WHERE difference > 1
  UNION ALL SELECT doc_id, 'Altered Payslip Math', 'HIGH' FROM g WHERE classification = 'Payslip' AND abs({_val('gross|basic|earnings')} - {_val('deduction|total deductions|deductions')} - {_val('net|net\\s+pay|take\\s+home')}) > 2.0
  UNION ALL SELECT doc_id, name, severity FROM (SELECT * FROM ({_SIGNALLED}) UNION ALL SELECT doc_id, 'altered_bank_math' FROM ({_TRIPLE.replace('<statements>', 'r')}) WHERE flagged) x JOIN {_CATALOGUE} ON c.signal = x.signal)
 SELECT case_id, f.doc_id, 'CONTEXT' AS layer_source, name, severity FROM found f JOIN docs d ON f.doc_id = d.doc_id""")
register("d24_gates", lambda t: gating.gated(t.cases, _files(t)).groupBy("case_id", "detector").agg(F.count("*").alias("n")), f"""WITH {_GATED} SELECT case_id, detector, count(*) AS n FROM (SELECT case_id, 'bank_balance' AS detector FROM g WHERE classification = 'Bank Statement'
 UNION ALL SELECT case_id, 'payslip_math' FROM g WHERE classification = 'Payslip' UNION ALL SELECT case_id, 'lease_signals' FROM r) GROUP BY 1, 2""")


def layers(t, metadata: bool = True, crossdoc: bool = True):
    """D25: findings without the layers that are switched off."""
    found = t.findings
    if not metadata:
        found = found.where("layer_source <> 'FORENSIC'")
    return found if crossdoc else found.where("layer_source <> 'CROSS_DOC'")


register("d25_layer_switches", lambda t: scoring.direct_risk(layers(t, crossdoc=False)), "SELECT case_id, least(100, n * 15) AS probability, CASE WHEN least(100, n * 15) <= 40 THEN 'LOW' WHEN least(100, n * 15) < 70 THEN 'MEDIUM' ELSE 'HIGH' END AS status FROM (SELECT case_id, count(*) AS n FROM <findings> WHERE layer_source <> 'CROSS_DOC' GROUP BY case_id)")
register("o4_union_findings", lambda t: D.revisions(t.raw).unionByName(D.signatures(t.raw)).unionByName(D.date_mismatch(t.raw)).groupBy("name", "severity").agg(F.count("*").alias("n")),
         f"""SELECT name, severity, count(*) AS n FROM (SELECT 'Multiple PDF Revisions' AS name, 'HIGH' AS severity FROM <raw> WHERE {_EOF} > 1 UNION ALL SELECT 'PDF Incremental Update Trace', 'MEDIUM' FROM <raw> WHERE regexp_matches(raw, '/Prev\\s+\\d+')
 UNION ALL SELECT 'Incomplete Digital Signature', 'MEDIUM' FROM <raw> WHERE {_SIG} AND contains(raw, '/ByteRange') AND NOT regexp_matches(raw, '/Cert|/PKCS') UNION ALL SELECT 'Missing Digital Signature', 'MEDIUM' FROM <raw> WHERE NOT {_SIG} AND {_OFFICIAL}
 UNION ALL SELECT 'Signature Integrity Concern', 'HIGH' FROM <raw> WHERE {_EOF} > 2 AND {_SIG} UNION ALL SELECT 'Metadata Date Mismatch', 'MEDIUM' FROM <raw> WHERE created <> modified) GROUP BY 1, 2""")
