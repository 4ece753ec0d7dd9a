"""Queries on single documents: intake, classification, entities, normal forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import entities as E, money, similarity, text as X
from ..functions.folders import shared_folder
from ..operators import classify as C
from ..sources import intake
from .registry import register

TEXTS = {"slips": "slips", "statements": "statements", "kyc": "kyc"}


def _case(patterns: list[str]) -> str:
    return " + ".join(f"CAST(regexp_matches(text, '{p}') AS INTEGER)" for p in patterns)


_BEST = "list_max([" + ", ".join(f"{{'score': {_case(p)}, 'ord': {-k}, 'name': '{t}'}}" for k, (t, p) in enumerate(C.TYPES.items())) + "])"


def classified(lens: str) -> str:
    return f"SELECT *, CASE WHEN best.score > 0 THEN best.name ELSE 'Unknown' END AS classification FROM (SELECT *, {_BEST} AS best FROM <{lens}>)"


register("c1_classify", lambda t: C.classify(t.slips).select("doc_id", "classification"), f"SELECT doc_id, classification FROM ({classified('slips')})")
register("c2_type_scores", lambda t: C.type_scores(t.slips), " UNION ALL ".join(f"SELECT doc_id, '{k}' AS doc_type, {_case(p)} AS score FROM <slips>" for k, p in C.TYPES.items()))
_FILES = "SELECT doc_id, text, CASE doc_id % 5 WHEN 0 THEN 'PNG' WHEN 1 THEN 'pdf' ELSE 'docx' END AS file_type FROM documents"
register("c5_scanned", lambda t: C.scanned(t.documents.select("doc_id", "text", F.when(F.col("doc_id") % 5 == 0, "PNG").when(F.col("doc_id") % 5 == 1, "pdf").otherwise("docx").alias("file_type"))).select("doc_id", "is_scanned"),
         f"SELECT doc_id, lower(file_type) IN ('png','jpg','jpeg','bmp','tiff') OR length(trim(coalesce(text, ''), ' ')) < 30 AS is_scanned FROM ({_FILES})")


def _passes(t):
    base = C.classify(t.kyc).withColumns({"ocr_confidence": F.col("doc_id") % 101, "is_scanned": F.col("doc_id") % 2 == 0, "id_number": F.when(F.col("doc_id") % 3 != 0, F.col("pan"))})
    return base


_PASS = f"SELECT *, doc_id % 101 AS ocr_confidence, doc_id % 2 = 0 AS is_scanned, CASE WHEN doc_id % 3 <> 0 THEN pan END AS id_number FROM ({classified('kyc')})"
register("c6_second_pass", lambda t: C.second_pass_list(_passes(t)).select("doc_id", "classification"),
         f"SELECT doc_id, classification FROM ({_PASS}) WHERE is_scanned AND CASE WHEN classification IN ('PAN','Aadhaar') THEN id_number IS NULL ELSE ocr_confidence < 60 END")


def _merged(t):
    first = _passes(t)
    second = C.second_pass_list(first).select("doc_id", F.concat("text", F.when(F.col("doc_id") % 3 == 0, " again").otherwise("")).alias("text"), F.when(F.col("doc_id") % 4 == 0, F.col("pan")).alias("id_number"))
    return C.merge_passes(first, second).select("doc_id", "used_second", F.length("text").alias("length"))


register("c7_merge_passes", _merged, f"""WITH f AS ({_PASS}),
 s AS (SELECT doc_id, text || CASE WHEN doc_id % 3 = 0 THEN ' again' ELSE '' END AS text2, CASE WHEN doc_id % 4 = 0 THEN pan END AS id2 FROM f WHERE is_scanned AND CASE WHEN classification IN ('PAN','Aadhaar') THEN id_number IS NULL ELSE ocr_confidence < 60 END),
 j AS (SELECT f.*, text2, coalesce(length(text2) > 50 AND CASE WHEN classification IN ('PAN','Aadhaar') THEN id2 IS NOT NULL ELSE length(text2) > length(text) END, FALSE) AS used_second FROM f LEFT JOIN s USING (doc_id))
 SELECT doc_id, used_second, length(CASE WHEN used_second THEN text2 ELSE text END) AS length FROM j""")
register("c8_ocr_confidence", lambda t: C.ocr_confidence(t.words), "SELECT doc_id, coalesce(avg(CASE WHEN conf <> -1 THEN conf END), 100.0) AS ocr_confidence FROM <words> GROUP BY doc_id")

# Entities: (name, lens, expression, SQL expression)
_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')"


def rx(pattern: str, group: int = 0, column: str = "text") -> str:
    return f"nullif(regexp_extract({column}, '{pattern}', {group}), '')"


def strip_sql(x: str) -> str:
    return _STRIP.format(x)


def valid_name_sql(x: str, employer: bool = False) -> str:
    keep = "[^A-Za-z\\s.&]" if employer else "[^A-Za-z\\s.]"
    words = ", ".join(f"'{w}'" for w in X.NOT_NAMES)
    name = f"upper(array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace({x}, '{keep}', '', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: upper(w) NOT IN ({words}) AND w <> ''), ' '))"
    return f"CASE WHEN length(replace({name}, ' ', '')) >= 3 THEN {name} END"


_DOB = "regexp_replace(" + rx(r"\b\d{2}[/.-]\d{2}[/.-]\d{4}\b") + ", '[.-]', '/', 'g')"
_VALID_DOB = f"CASE WHEN year(try_strptime({_DOB}, '%d/%m/%Y')) BETWEEN 1900 AND 2028 THEN strftime(try_strptime({_DOB}, '%d/%m/%Y'), '%d/%m/%Y') END"
_PAN10 = rx("(?i)\\b[A-Z0-9]{10}\\b")
_P = f"upper({_PAN10})"
_FIXED = f"translate(substr({_P},1,5),'01582','OISBZ') || translate(substr({_P},6,4),'OISBZGT','0158267') || translate(substr({_P},10,1),'01582','OISBZ')"
_PHONE = "right(regexp_replace(" + rx("\\b(?:\\+91|0)?[6789]\\d{9}\\b") + ", '\\D', '', 'g'), 10)"
_MAIL = rx("\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}\\b")
_SAL = "TRY_CAST(replace(" + rx("(?i)(?:net\\s+pay|gross\\s+salary|net\\s+salary)[:\\s]+(?:rs\\.?|inr)?\\s*([\\d,.]+)", 1) + ", ',', '') AS DECIMAL(18,2))"
_ACC = rx("(?i)(?:account\\s+number|ac\\s+no|a/c\\s+no)[:\\s]+([0-9-]{9,18})", 1)
_LABEL = strip_sql(rx("(?i)(?:name|employee\\s+name|customer\\s+name)[:\\s]+([A-Z\\s.]{3,30})", 1))

for _id, _lens, _column, _sql in [
    ("e1_birth_date", "kyc", lambda: E.birth_date(F.col("text")), _DOB),
    ("e2_valid_birth_date", "kyc", lambda: E.valid_birth_date(E.birth_date(F.col("text"))), _VALID_DOB),
    ("e3_gender", "kyc", lambda: E.gender(F.concat("text", F.element_at(F.array(F.lit(" Male"), F.lit(" FEMALE"), F.lit(" transgender"), F.lit(" none")), (F.col("doc_id") % 4 + 1).cast("int")))),
     "CASE doc_id % 4 WHEN 1 THEN 'Female' WHEN 0 THEN 'Male' WHEN 2 THEN 'Transgender' END"),
    ("e4_normal_gender", "kyc", lambda: E.normal_gender(F.element_at(F.array(F.lit("m"), F.lit("F"), F.lit("Trans "), F.lit("x"), F.lit("female")), (F.col("doc_id") % 5 + 1).cast("int"))),
     "CASE doc_id % 5 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' WHEN 2 THEN 'Transgender' WHEN 4 THEN 'Female' END"),
    ("e5_pan_candidate", "kyc", lambda: E.pan_candidate(F.col("text")), _PAN10),
    ("e6_corrected_pan", "kyc", lambda: E.corrected_pan(E.pan_candidate(F.col("text"))), f"CASE WHEN regexp_matches({_FIXED}, '^[A-Z]{{5}}[0-9]{{4}}[A-Z]$') THEN {_FIXED} END"),
    ("e7_aadhaar_candidate", "employers", lambda: E.aadhaar_candidate(F.concat("text", F.lit(" 1234 5678 "), F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0"))), "'1234 5678 ' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0')"),
    ("e9_address", "kyc", lambda: E.address(F.col("text")), "'House ' || CAST(doc_id AS VARCHAR) || ' Lake Road'"),
    ("e10_account_number", "employers", lambda: E.account_number(F.col("text")), _ACC),
    ("e11_phone", "kyc", lambda: E.phone(F.col("text")), f"CASE WHEN regexp_matches({_PHONE}, '^[6-9]') THEN '+91 ' || {_PHONE} END"),
    ("e12_email", "documents", lambda: E.email(F.col("text")), f"CASE WHEN regexp_matches({_MAIL}, '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}$') THEN lower({_MAIL}) END"),
    ("e13_labelled_name", "kyc", lambda: E.labelled_name(F.col("text")), _LABEL),
    ("e17_valid_name", "kyc", lambda: X.valid_name(F.col("name")), valid_name_sql("name")),
    ("e18_salary", "slips", lambda: E.salary(F.col("text")), f"CASE WHEN {_SAL} > 0 THEN {_SAL} END"),
    ("e19_employer", "employers", lambda: E.employer(F.col("text")), valid_name_sql(strip_sql(rx("(?i)(?:employer|company|organization)[:\\s]+([A-Z\\s&]{3,40})", 1)), True)),
    ("e20_property_id", "employers", lambda: E.property_id(F.col("text")), "upper(" + strip_sql(rx("(?i)(?:property\\s+id|survey\\s+no|khasra\\s+no)[:\\s]+([A-Z0-9/-]{3,20})", 1)) + ")"),
    ("e21_property_owner", "employers", lambda: E.property_owner(F.col("text")), valid_name_sql(strip_sql(rx("(?i)(?:owner|title\\s+holder)[:\\s]+([A-Z\\s.]{3,30})", 1)))),
    ("n1_normal_name", "kyc", lambda: X.normal_name(F.col("name")), "trim(regexp_replace(regexp_replace(regexp_replace(lower(name), '\\b(mr|ms|mrs|dr|adv|prof)\\b\\.?', '', 'g'), '[^a-z\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"),
]:
    register(_id, lambda t, lens=_lens, column=_column: getattr(t, lens).select("doc_id", column().alias("value")), f"SELECT doc_id, {_sql} AS value FROM " + ("documents" if _lens == "documents" else f"<{_lens}>"))


def words_sql(column: str, words: dict[str, str]) -> str:
    case = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.items()) + " ELSE w END"
    return f"array_to_string(list_transform(string_split(trim(regexp_replace(regexp_replace(lower({column}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' '), lambda w: {case}), ' ')"


register("n2_normal_address", lambda t: t.employers.select("doc_id", X.normal_words(F.col("address"), X.ADDRESS_WORDS).alias("value")), f"SELECT doc_id, {words_sql('address', X.ADDRESS_WORDS)} AS value FROM <employers>")
register("n3_normal_employer", lambda t: t.employers.select("doc_id", X.normal_words(F.col("employer"), X.EMPLOYER_WORDS).alias("value")), f"SELECT doc_id, {words_sql('employer', X.EMPLOYER_WORDS)} AS value FROM <employers>")

_STEP = "[" + ", ".join(map(str, E._verhoeff_tables()[0])) + "]"
_PERM = "[" + ", ".join(map(str, E._verhoeff_tables()[1])) + "]"


def _numbered(t):
    number = F.lpad((F.col("doc_id") * 7919 + 100000000007).cast("string"), 12, "0")
    return t.employers.select("doc_id", E.verhoeff_ok(number).alias("ok"), E.valid_aadhaar(number).alias("value"))


register("e8_verhoeff", _numbered, f"""WITH n AS (SELECT doc_id, lpad(CAST(doc_id * 7919 + 100000000007 AS VARCHAR), 12, '0') AS d FROM <employers>),
 c AS (SELECT *, list_reduce(list_prepend(0, range(12)), lambda c, i: CAST({_STEP}[c * 10 + {_PERM}[(i % 8) * 10 + CAST(substr(d, CAST(12 - i AS INTEGER), 1) AS INTEGER) + 1] + 1] AS BIGINT)) = 0 AS ok FROM n)
 SELECT doc_id, ok, CASE WHEN ok THEN substr(d,1,4) || ' ' || substr(d,5,4) || ' ' || substr(d,9,4) END AS value FROM c""")


def _merged_entities(t):
    """E22: a second source's fields first; of names the one with more words; addresses over 10 characters."""
    own = t.kyc.select("doc_id", X.valid_name(F.col("name")).alias("name"), E.corrected_pan(F.col("pan")).alias("pan"), E.address(F.col("text")).alias("address"))
    other = t.kyc.where("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "ANIL KUMAR RAO").otherwise("RAO").alias("name2"), F.when(F.col("doc_id") % 6 == 0, "ABCDE1234F").alias("pan2"), F.lit("Hill 1").alias("address2"))
    j = own.join(other, "doc_id", "left")
    words = lambda c: F.coalesce(F.size(F.split(c, " ")), F.lit(0))
    name = F.when(F.col("name2").isNotNull() & (F.col("name").isNull() | (words(F.col("name2")) >= words(F.col("name")))), F.col("name2")).otherwise(F.col("name"))
    return j.select("doc_id", name.alias("name"), F.coalesce("pan2", "pan").alias("pan"), F.coalesce(F.when(F.length("address2") > 10, F.col("address2")), "address").alias("address"))


register("e22_merge_sources", _merged_entities, f"""WITH o AS (SELECT doc_id, {valid_name_sql('name')} AS name, {_FIXED.replace(_P, 'pan')} AS fixed, 'House ' || CAST(doc_id AS VARCHAR) || ' Lake Road' AS address FROM <kyc>),
 j AS (SELECT doc_id, name, CASE WHEN regexp_matches(fixed, '^[A-Z]{{5}}[0-9]{{4}}[A-Z]$') THEN fixed END AS pan, address, CASE WHEN doc_id % 4 = 0 THEN 'ANIL KUMAR RAO' WHEN doc_id % 2 = 0 THEN 'RAO' END AS name2, CASE WHEN doc_id % 6 = 0 THEN 'ABCDE1234F' END AS pan2 FROM o)
 SELECT doc_id, CASE WHEN name2 IS NOT NULL AND (name IS NULL OR len(string_split(name2, ' ')) >= len(string_split(name, ' '))) THEN name2 ELSE name END AS name, coalesce(pan2, pan) AS pan, address FROM j""")
register("d1_amounts", lambda t: t.slips.select("doc_id", F.posexplode(money.amounts(F.col("text"))).alias("pos", "amount")),
         f"SELECT doc_id, CAST(i AS INTEGER) AS pos, CAST(replace(a[i + 1], ',', '') AS DECIMAL(18,2)) AS amount FROM (SELECT doc_id, regexp_extract_all(text, '{money.AMOUNT}') AS a FROM <slips>), unnest(range(len(a))) AS u(i)")
_SIGNED = [("concat('(', value, ')')", "-1"), ("concat('$ ', value)", "1"), ("concat(value, '-')", "-1"), ("concat('x', value)", "NULL")]
register("d2_parse_amount", lambda t: t.orders.select("o_orderkey", money.parsed_amount(F.expr("CASE o_orderkey % 4 " + " ".join(f"WHEN {k} THEN {e.replace('value', 'format_string(chr(37) || chr(44) || chr(46) || chr(50) || chr(102), o_totalprice)')}" for k, (e, _) in enumerate(_SIGNED)) + " END")).alias("amount")),
         "SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(18,2)) * CASE o_orderkey % 4 " + " ".join(f"WHEN {k} THEN {s}" for k, (_, s) in enumerate(_SIGNED)) + " END AS amount FROM orders")

# Intake
register("s2_upload_filter", lambda t: intake.upload_filter(t.documents.select("doc_id", F.when(F.col("doc_id") % 4 == 0, "image/gif").when(F.col("doc_id") % 4 == 1, "application/pdf").otherwise("image/png").alias("mime"), (F.col("n_chars") * 4096).alias("size"))),
         "SELECT doc_id, reason IS NULL AS accepted, reason FROM (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'type' WHEN n_chars * 4096 > 20971520 THEN 'size' END AS reason FROM documents)")
register("s3_file_names", lambda t: t.pages.select("page_id", intake.safe_name(F.col("url")).alias("name")), "SELECT page_id, replace(replace(list_last(string_split(url, '/')), '..', ''), '\\', '') AS name FROM pages")
register("s5_content_key", lambda t: intake.first_by_content(t.documents.select("doc_id", "text", F.concat(F.lit("f"), (F.col("doc_id") % 2).cast("string")).alias("filename"))),
         "SELECT min(doc_id) AS doc_id, sha256(text || 'f' || CAST(doc_id % 2 AS VARCHAR)) AS content_key FROM documents GROUP BY 2")
register("s7_read_tables", lambda t: t.customer.select("c_custkey", "c_name", "c_nationkey"), "SELECT c_custkey, c_name, c_nationkey FROM customer")


def _word_files(t):
    """Raw files under names of several kinds, after the signatures of old and new text documents."""
    k = F.col("doc_id")
    path = F.concat(F.lit("in/"), k, F.when(k % 5 == 0, ".DOC").when(k % 5 == 1, ".docx").when(k % 5 == 2, ".docx.pdf").otherwise(".zip"))
    sign = F.when(k % 4 == 0, F.unhex(F.lit("D0CF11E0A1B11AE1"))).when(k % 4 < 3, F.unhex(F.lit("504B0304"))).otherwise(F.lit(b""))
    inner = F.when(k % 4 == 1, "word/document.xml").otherwise("xl/workbook.xml")
    return t.raw.select("doc_id", path.alias("path"), F.concat(sign, F.encode(F.concat(F.col("raw"), inner), "UTF-8")).alias("content"))


_WORD_FILES = """SELECT doc_id, 'in/' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.DOC' WHEN 1 THEN '.docx' WHEN 2 THEN '.docx.pdf' ELSE '.zip' END AS path,
 CASE doc_id % 4 WHEN 0 THEN 'D0CF11E0A1B11AE1' WHEN 3 THEN '' ELSE '504B0304' END || hex(encode(raw || CASE WHEN doc_id % 4 = 1 THEN 'word/document.xml' ELSE 'xl/workbook.xml' END)) AS content FROM <raw>"""
register("s1_may_be_read", lambda t: _word_files(t).select("doc_id", intake.may_be_read(F.col("path")).alias("taken")), f"SELECT doc_id, regexp_matches(lower(path), '\\.(pdf|png|jpg|jpeg|bmp|tiff)$') AS taken FROM ({_WORD_FILES})")
register("s4_word_files", lambda t: _word_files(t).select("doc_id", intake.is_word_file(F.col("path"), F.col("content")).alias("is_word")),
         f"SELECT doc_id, regexp_matches(lower(path), '\\.docx?$') OR starts_with(content, 'D0CF11E0A1B11AE1') OR (starts_with(content, '504B0304') AND contains(content, hex(encode('word/document.xml')))) AS is_word FROM ({_WORD_FILES})")


def _flushed(t):
    """The keys of all documents as a processed table, emptied: how many it held and holds."""
    path = shared_folder(t.spark, "processed")
    t.documents.select(intake.content_key(F.col("text"), F.lit("f")).alias("content_key")).distinct().write.parquet(path)
    flushed = intake.flush_processed(t.spark, path)
    return t.spark.read.schema("content_key string").parquet(path).agg(F.count("*").alias("left")).select(F.lit(flushed).cast("long").alias("flushed"), "left")


register("s6_flush", _flushed, "SELECT count(DISTINCT coalesce(text, chr(1))) AS flushed, 0 AS \"left\" FROM documents")
