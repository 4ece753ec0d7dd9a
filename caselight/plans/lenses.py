"""Lenses: projections of the given tables that have the shape of case-file data, for Spark and for DuckDB.

The text is Spark SQL with table names in braces; ``duck`` turns it into DuckDB's dialect.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

_BALANCES = """SELECT o_custkey AS doc_id, o_orderkey AS k, CAST(o_orderdate AS DATE) AS txn_date, CAST(o_totalprice AS DECIMAL(18,2)) AS amount, row_number() OVER w AS row_no,
 SUM(CASE WHEN o_orderstatus = 'F' THEN -CAST(o_totalprice AS DECIMAL(18,2)) ELSE CAST(o_totalprice AS DECIMAL(18,2)) END)
   OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS bal
 FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"""

ROWS = f"""SELECT doc_id, 1 AS page, row_no, txn_date, amount, CAST(bal + CASE WHEN k % 97 = 0 THEN 100 ELSE 0 END AS DECIMAL(18,2)) AS balance FROM ({_BALANCES}) t"""

KYC = """SELECT doc_id, case_id, seq, name, pan, CONCAT('Income Tax Department', CHR(10), 'Name: ', COALESCE(name,''), CHR(10), 'DOB: ', dob, CHR(10), 'Permanent Account Number ', pan, CHR(10), 'Phone ', phone, CHR(10), 'Address: House ', CAST(doc_id AS STRING), ' Lake Road') AS text
FROM (SELECT c_custkey AS doc_id, CAST(FLOOR(c_custkey / 3) AS BIGINT) AS case_id, c_custkey % 3 AS seq,
  CASE c_custkey % 11 WHEN 0 THEN CONCAT(SUBSTR(f,1,1), '. ', s) WHEN 1 THEN CONCAT(f,' ',s,'A') WHEN 2 THEN CONCAT(f,' GUPTA') WHEN 3 THEN NULL ELSE CONCAT(f,' ',s) END AS name,
  CONCAT(SUBSTR(c_mktsegment,1,5), LPAD(CAST(CAST(FLOOR(c_custkey / 3) AS BIGINT) AS STRING),4,'0'), CASE WHEN c_custkey % 13 = 0 THEN 'X' ELSE 'K' END) AS pan,
  CONCAT(LPAD(CAST(1 + c_custkey % 31 AS STRING),2,'0'),'/',LPAD(CAST(1 + c_custkey % 12 AS STRING),2,'0'),'/', CAST(1950 + c_custkey % 60 AS STRING)) AS dob,
  CONCAT(CASE WHEN c_custkey % 5 = 0 THEN '5' ELSE '9' END, LPAD(CAST(c_custkey AS STRING),9,'0')) AS phone
  FROM (SELECT *, CASE CAST(FLOOR(c_custkey / 3) AS BIGINT) % 5 WHEN 0 THEN 'AMIT' WHEN 1 THEN 'PRIYA' WHEN 2 THEN 'RAHUL' WHEN 3 THEN 'SUNITA' ELSE 'VIKRAM' END AS f,
    CASE CAST(FLOOR(c_custkey / 3) AS BIGINT) % 4 WHEN 0 THEN 'SHARMA' WHEN 1 THEN 'VERMA' WHEN 2 THEN 'MEHTA' ELSE 'NAIR' END AS s FROM {customer}) c) t"""

FINDINGS = """SELECT l_orderkey AS case_id, CASE WHEN l_quantity = 50 THEN 'CRITICAL' WHEN l_returnflag = 'A' THEN 'HIGH' WHEN l_returnflag = 'R' THEN 'MEDIUM' ELSE 'LOW' END AS severity,
 CASE l_partkey % 4 WHEN 0 THEN 'FORENSIC' WHEN 1 THEN 'CROSS_DOC' WHEN 2 THEN 'CONTEXT' ELSE 'KNN' END AS layer_source,
 CASE l_partkey % 5 WHEN 0 THEN 'Identity Name Mismatch' WHEN 1 THEN 'Altered Payslip Math' WHEN 2 THEN 'Balance Calculation Error' WHEN 3 THEN 'Employer Mismatch' ELSE 'Editing Software Signature' END AS name,
 l_linenumber AS seq FROM {lineitem}"""

EVIDENCE = """SELECT l_orderkey AS case_id, l_linenumber AS finding, l_orderkey * 3 + l_linenumber % 3 AS doc_id, CAST(1 + l_partkey % 3 AS INT) AS page, CAST(l_discount AS DECIMAL(9,2)) AS confidence,
 CONCAT('part ', CAST(l_partkey AS STRING)) AS extracted, CONCAT('status ', l_linestatus) AS description FROM {lineitem} WHERE l_suppkey % 4 <> 0"""

CASE_EVENTS = """SELECT user_id AS case_id, event_id, ts, event_type, CASE event_type WHEN 'signup' THEN 5 WHEN 'view' THEN 30 WHEN 'click' THEN 60 WHEN 'purchase' THEN 100 ELSE 0 END AS progress,
 CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED' ELSE 'PROCESSING' END AS status FROM {events}"""

CASES = """SELECT o_orderkey AS case_id, o_custkey AS owner_id, o_orderdate AS created_at, CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'PROCESSING' ELSE 'PENDING' END AS status,
 CASE o_orderpriority WHEN '1-URGENT' THEN 'Loan Approval' WHEN '2-HIGH' THEN 'Mortgage Underwriting' WHEN '3-MEDIUM' THEN 'Tenant Screening' WHEN '5-LOW' THEN 'KYC / Onboarding' ELSE 'Automatic Detection' END AS context,
 CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 4 = 1 THEN 'Investigation: Automatic Detection' ELSE CONCAT('Case ', CAST(o_orderkey AS STRING)) END AS title,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderkey % 101 AS DECIMAL(9,1)) END AS trust_score, o_orderkey % 3 = 0 AS is_baseline FROM {orders}"""

FEATURES = """SELECT c_custkey AS case_id, CAST(c_custkey * 37 % 101 AS DECIMAL(9,1)) AS trust_score, CAST(60 + c_custkey % 41 AS DECIMAL(9,1)) AS ocr_confidence, CAST(100 - 20 * (c_custkey % 5) AS DECIMAL(9,1)) AS metadata_score,
 CASE c_custkey % 4 WHEN 0 THEN 'None' WHEN 1 THEN 'Canva' WHEN 2 THEN 'iText' ELSE 'Quartz' END AS pdf_producer, 1 + c_custkey % 3 AS revision_count, c_custkey % 2 = 0 AS salary_consistency, c_mktsegment AS context FROM {customer}"""

SPANS = """SELECT l_orderkey AS doc_id, l_linenumber AS page, CASE l_partkey % 7 WHEN 0 THEN 'Arial-Bold' WHEN 1 THEN 'Courier' WHEN 2 THEN 'Times,Italic' WHEN 3 THEN 'MICR' WHEN 4 THEN 'Helvetica' WHEN 5 THEN 'Calibri' ELSE 'OCR-B' END AS font,
 8 + CAST(l_quantity AS INT) % 5 AS size FROM {lineitem}"""

STATEMENTS = f"""SELECT doc_id, CONCAT('BANK STATEMENT', CHR(10), 'Opening Balance', CHR(10), LISTAGG(line, CHR(10)) WITHIN GROUP (ORDER BY row_no)) AS text
FROM (SELECT doc_id, row_no, CONCAT(SUBSTR(CAST(txn_date AS STRING),9,2),'/',SUBSTR(CAST(txn_date AS STRING),6,2),'/',SUBSTR(CAST(txn_date AS STRING),1,4), '  txn  ', CAST(amount AS STRING), '  ', CAST(CAST(balance + 50000000 AS DECIMAL(18,2)) AS STRING)) AS line FROM ({ROWS}) s) l GROUP BY doc_id"""

SLIPS = """SELECT o_orderkey AS doc_id, o_custkey AS case_id, CONCAT(CASE WHEN o_orderkey % 3 = 0 THEN 'Payslip' ELSE 'Lease Agreement' END, CHR(10), 'Gross: ', CAST(g AS STRING), CHR(10), 'Deductions: ', CAST(d AS STRING), CHR(10),
  'Net Pay: ', CAST(CAST(g - d + CASE WHEN o_orderkey % 10 = 0 THEN 5 ELSE 0 END AS DECIMAL(18,2)) AS STRING), CHR(10), CASE WHEN o_orderkey % 4 = 0 THEN 'Monthly rent: 6,500.00' ELSE 'rent: 900.00' END, CHR(10),
  CASE WHEN o_orderkey % 6 = 0 THEN 'deposit: 7000 deposit: 12000' ELSE 'paid by card' END, CHR(10), 'page 1 of ', CAST(1 + o_orderkey % 2 AS STRING), CASE WHEN o_orderkey % 7 = 0 THEN ' via Venmo' ELSE '' END) AS text
FROM (SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) AS g, CAST(o_orderkey % 1000 AS DECIMAL(18,2)) AS d FROM {orders}) t"""

RAW = """SELECT c_custkey AS doc_id, CONCAT('%PDF-1.7 ', CASE WHEN c_custkey % 5 = 0 THEN '/Type /Sig /ByteRange ' ELSE '' END, CASE WHEN c_custkey % 10 = 0 THEN '/Cert ' ELSE '' END, CASE WHEN c_custkey % 7 = 0 THEN '/Prev 116 ' ELSE '' END, REPEAT('%%EOF ', CAST(1 + c_custkey % 4 AS INT))) AS raw,
  CASE c_custkey % 6 WHEN 0 THEN 'Canva' WHEN 1 THEN 'Adobe Photoshop' WHEN 2 THEN 'Bank Core 4.1' WHEN 3 THEN NULL WHEN 4 THEN 'LibreOffice 7' ELSE 'iText' END AS producer,
  CASE c_custkey % 11 WHEN 0 THEN 'GIMP 2.10' WHEN 1 THEN 'Canva' WHEN 2 THEN NULL ELSE 'Writer' END AS creator,
  CASE WHEN c_custkey % 3 = 0 THEN 'bank statement' ELSE 'holiday card from unon bank' END AS text, CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE CAST(c_custkey % 9 AS STRING) END AS created, CAST(c_custkey % 9 + c_custkey % 2 AS STRING) AS modified FROM {customer}"""

WORDS = """SELECT doc_id, pos, w AS word, CASE WHEN (doc_id * 31 + pos) % 23 = 0 THEN -1 ELSE CAST((doc_id * 31 + pos * 17) % 101 AS INT) END AS conf,
 CAST(pos % 12 * 8 AS INT) AS x0, CAST(FLOOR(pos / 12) % 50 * 2 AS INT) AS y0, CAST(1 + FLOOR(pos / 600) AS INT) AS page FROM @WORDS@"""
_SPARK_WORDS = "(SELECT doc_id, posexplode(split(text, ' ')) AS (pos, w) FROM {documents}) t"
_DUCK_WORDS = "(SELECT doc_id, i AS pos, ws[i + 1] AS w FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM {documents}) d, unnest(range(len(ws))) AS u(i)) t"

BOXES = """SELECT doc_id, pos, w AS word, page, x0, y0, x0 + 7 AS x1, y0 + 2 AS y1 FROM (SELECT doc_id, pos, w, CAST(pos % 12 * 8 AS INT) AS x0, CAST(FLOOR(pos / 12) % 50 * 2 AS INT) AS y0, CAST(1 + FLOOR(pos / 600) AS INT) AS page FROM @BOXES@) b WHERE w <> ''"""
_SPARK_BOXES = "(SELECT doc_id, posexplode(split(text, '[ \n\t]+')) AS (pos, w) FROM {documents}) t"
_DUCK_BOXES = "(SELECT doc_id, i AS pos, ws[i + 1] AS w FROM (SELECT doc_id, regexp_split_to_array(text, '[ \n\t]+') AS ws FROM {documents}) d, unnest(range(len(ws))) AS u(i)) t"

IMAGES = """SELECT p_partkey AS doc_id, CAST(p_partkey % 50 AS DECIMAL(9,2)) * CAST(0.1 AS DECIMAL(3,1)) AS mean_diff, CAST(p_partkey % 70 AS DECIMAL(9,2)) * CAST(0.1 AS DECIMAL(3,1)) AS std_diff FROM {part}"""

EMPLOYERS = """SELECT c_custkey AS doc_id, CAST(FLOOR(c_custkey / 3) AS BIGINT) AS case_id, c_custkey % 3 AS seq, employer, address, CONCAT('Employer: ', UPPER(REPLACE(employer,'.','')), CHR(10), 'Account Number: ', LPAD(CAST(c_custkey * 7919 % 1000000000 AS STRING),9,'0'), CHR(10),
  'Survey No: AB/', CAST(c_custkey % 500 AS STRING), '-', CAST(100 + c_custkey % 7 AS STRING), CHR(10), 'Owner: RAHUL MEHTA', CHR(10)) AS text
FROM (SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'Hill Foods Corp' WHEN 1 THEN 'Lake Trading Private Limited' WHEN 2 THEN 'LAKE TRADING' ELSE 'Lake Trading Pvt. Ltd.' END AS employer,
  CONCAT(CAST(1 + c_custkey % 40 AS STRING), ' Lake Rd, Apt ', CAST(c_custkey % 9 AS STRING), ', Elm Sq') AS address FROM {customer}) t"""

LENSES = {k.lower(): v for k, v in list(globals().items()) if k.isupper() and isinstance(v, str)}


def duck(text: str) -> str:
    """A lens, or a query with lenses as ``<name>``, for DuckDB."""
    text = re.sub(r"<(\w+)>", lambda m: f"({LENSES[m[1]]})", text)
    text = text.replace("@WORDS@", _DUCK_WORDS).replace("@BOXES@", _DUCK_BOXES).replace("AS STRING", "AS VARCHAR")
    text = text.replace("LISTAGG(line, CHR(10)) WITHIN GROUP (ORDER BY row_no)", "string_agg(line, CHR(10) ORDER BY row_no)")
    return re.sub(r"\{([a-z]+)\}", r"\1", text)


class Tables:
    """The tables and lenses of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in LENSES:
            return self.table(name)
        text = LENSES[name].replace("@WORDS@", _SPARK_WORDS).replace("@BOXES@", _SPARK_BOXES)
        return self.spark.sql(text, **{t: self.table(t) for t in set(re.findall(r"\{(\w+)\}", text))})
