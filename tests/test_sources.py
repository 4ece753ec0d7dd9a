"""Files, sinks and streams."""

from __future__ import annotations

import io
import json
import time
import zipfile

from pyspark.sql import functions as F

from caselight.operators import similar
from caselight.sources import intake
from caselight.streaming import flows
from pyspark.sql.types import StructType


def test_read_files(spark, tmp_path):
    for name in ("a.pdf", "b.PNG", "c.exe"):
        (tmp_path / name).write_bytes(b"x")
    names = {r.path.rpartition("/")[2] for r in intake.read_files(spark, str(tmp_path)).collect()}
    assert names == {"a.pdf", "b.PNG"}


def test_word_files(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", "<x/>")
    rows = [("a.docx", b""), ("b.bin", bytes.fromhex("D0CF11E0A1B11AE100")), ("c.bin", out.getvalue()), ("d.bin", b"PK\x03\x04 other"), ("e.pdf", b"%PDF")]
    df = spark.createDataFrame([(a, bytearray(b)) for a, b in rows], "path string, content binary")
    found = {r.path: r.w for r in df.select("path", intake.is_word_file(F.col("path"), F.col("content")).alias("w")).collect()}
    assert found == {"a.docx": True, "b.bin": True, "c.bin": True, "d.bin": False, "e.pdf": False}


def test_processed_table(spark, tmp_path):
    files = spark.createDataFrame([(1, "x", "f"), (2, "x", "f"), (3, "x", "g")], "doc_id long, text string, filename string")
    keyed = intake.first_by_content(files)
    assert sorted(r.doc_id for r in keyed.collect()) == [1, 3]
    path = str(tmp_path / "processed")
    keyed.where("doc_id = 1").write.parquet(path)
    assert [r.doc_id for r in intake.not_processed(keyed, spark.read.parquet(path)).collect()] == [3]
    assert intake.flush_processed(spark, path) == 1
    assert spark.read.parquet(path).count() == 0


def test_repository(spark, tmp_path):
    entry = {"features": {"trust_score": 91.5, "pdf_producer": "iText", "revision_count": 1, "salary_consistency": True}, "metadata": {"investigation_id": "i1", "title": "t", "context": "KYC"}}
    (tmp_path / "data.json").write_text(json.dumps([entry, entry | {"metadata": {"investigation_id": "i2"}}]))
    rows = similar.read_repository(spark, str(tmp_path / "data.json")).orderBy("metadata.investigation_id").collect()
    assert [r.metadata.investigation_id for r in rows] == ["i1", "i2"] and rows[0].features.trust_score == 91.5


def test_findings_append_by_layer(spark, tmp_path):
    df = spark.createDataFrame([(1, "KNN"), (2, "FORENSIC")], "case_id long, layer_source string")
    for _ in range(2):
        df.write.mode("append").partitionBy("layer_source").parquet(str(tmp_path / "findings"))
    assert spark.read.parquet(str(tmp_path / "findings")).where("layer_source = 'KNN'").count() == 2


CONTENT = "content_key string, n_chars int, arrived timestamp"


def arriving(spark, folder, *rows):
    spark.createDataFrame(list(rows), "text string, arrived string").coalesce(1).write.mode("append").parquet(folder)


def contents(spark, folder):
    return spark.readStream.schema("text string, arrived string").option("maxFilesPerTrigger", 1).parquet(folder)


def test_intake_over_batches(spark, tmp_path):
    docs, taken, state = (str(tmp_path / n) for n in ("docs", "taken", "state"))
    arriving(spark, docs, ("a", "2024-01-01"), ("b", "2024-01-01"), ("a", "2024-01-02"))
    arriving(spark, docs, ("a", "2024-01-02"), ("ccc", "2024-01-03"), (None, "2024-01-03"))
    for _ in range(2):  # a second run finds nothing new
        flows.take_in(contents(spark, docs), taken, state)
    arriving(spark, docs, ("b", "2024-01-04"), ("d", "2024-01-04"))  # files that overlap with earlier ones
    flows.take_in(contents(spark, docs), taken, state)
    rows = spark.read.schema(CONTENT).parquet(taken).collect()
    assert sorted((r.n_chars is None, r.n_chars) for r in rows) == [(False, 1), (False, 1), (False, 1), (False, 3), (True, None)] and len({r.content_key for r in rows}) == 5


def test_intake_names_the_first_document(spark, tmp_path):
    docs, taken, state = (str(tmp_path / n) for n in ("docs", "taken", "state"))
    schema, far = "doc_id long, text string, arrived string", (1 << 53) + 1
    for rows in ([(7, "a", "2024-01-01"), (3, "a", "2024-01-02"), (None, "a", "2024-01-01"), (far + 2, "b", "2024-01-01"), (far, "b", None), (None, "c", "2024-01-01"), (9, None, "2024-01-01")], [(1, "a", "2024-01-03"), (4, "dd", "2024-01-03")]):
        spark.createDataFrame(rows, schema).repartition(2).write.mode("append").parquet(docs)
        flows.take_in(spark.readStream.schema(schema).parquet(docs), taken, state)
    found = spark.read.schema("doc_id long, " + CONTENT).parquet(taken).select("doc_id", "n_chars", F.to_date("arrived").cast("string")).collect()
    flows.take_in(spark.readStream.schema(schema).parquet(docs), taken, state)  # finds nothing new
    assert spark.read.schema(CONTENT).parquet(taken).count() == len(found)
    assert sorted(map(tuple, found), key=str) == sorted([(3, 1, "2024-01-01"), (far, 1, "2024-01-01"), (None, 1, "2024-01-01"), (9, None, "2024-01-01"), (4, 2, "2024-01-03")], key=str)


def test_intake_of_documents_forgets_old_contents(spark, tmp_path):
    docs, taken, state = (str(tmp_path / n) for n in ("docs", "taken", "state"))
    for k, day in enumerate(("2024-01-01", "2024-03-01", "2024-03-02")):
        spark.createDataFrame([(k, "a", day)], "doc_id long, text string, arrived string").coalesce(1).write.mode("append").parquet(docs)
        flows.take_in(spark.readStream.schema("doc_id long, text string, arrived string").parquet(docs), taken, state)
    assert sorted(r.doc_id for r in spark.read.schema("doc_id long, " + CONTENT).parquet(taken).collect()) == [0, 2]


def test_intake_forgets_old_contents(spark, tmp_path):
    docs, taken, state = (str(tmp_path / n) for n in ("docs", "taken", "state"))
    for day in ("2024-01-01", "2024-03-01", "2024-03-02"):
        arriving(spark, docs, ("a", day))
        flows.take_in(contents(spark, docs), taken, state)
    days = sorted(str(r.arrived)[:10] for r in spark.read.schema(CONTENT).parquet(taken).collect())
    assert days == ["2024-01-01", "2024-03-02"]  # that of March 1 came before the watermark had passed


def test_intake_reads_no_table_of_what_was_taken(spark, tmp_path, capsys):
    arriving(spark, str(tmp_path / "docs"), ("a", "2024-01-01"))
    flows.new_contents(contents(spark, str(tmp_path / "docs"))).explain()
    plan = capsys.readouterr().out
    assert "DeduplicateWithinWatermark" in plan and "Join" not in plan and plan.count("StreamingRelation") == 1


def test_balances_in_any_order(spark, tmp_path):
    import random
    from datetime import date, timedelta
    from decimal import Decimal as D

    schema = StructType.fromJson(spark.createDataFrame([], "doc_id long, txn_date date, page int, row_no int, amount decimal(18,2), balance decimal(18,2)").schema.jsonValue())
    rng, rows, want = random.Random(4), [], {}
    for doc in range(6):
        balance, day = D(1000), date(2024, 1, 1)
        for k in range(25):
            amount, kind = D(rng.randint(1, 90)), rng.choice(["debit", "credit", "error"])
            before, balance = balance, balance + {"debit": -amount, "credit": amount, "error": 500}[kind]
            day += timedelta(rng.randint(0, 3))
            rows.append((doc, day, 1, k, amount, balance))
            want[doc, k] = kind if k else None
    rng.shuffle(rows)
    source, out, state = (str(tmp_path / n) for n in ("rows", "out", "state"))
    for k in range(0, len(rows), 40):
        spark.createDataFrame(rows[k : k + 40], schema).coalesce(1).write.mode("append").parquet(source)
        flows.check_stream(spark, source, schema, out, state, delay="400 days")
    flows.end_stream(spark, source, schema)
    flows.check_stream(spark, source, schema, out, state, delay="400 days")
    found = spark.read.schema(flows.CHECKED).parquet(out).where("doc_id IS NOT NULL").collect()
    assert len(found) == len(rows) and {(r.doc_id, r.row_no): r.kind for r in found} == want
    assert spark.conf.get(flows.STATE_STORE[0]) != flows.STATE_STORE[1]


def test_balances_are_let_go_as_the_watermark_passes(spark, tmp_path):
    from datetime import date
    from decimal import Decimal as D

    schema = spark.createDataFrame([], "doc_id long, txn_date date, page int, row_no int, amount decimal(18,2), balance decimal(18,2)").schema
    source, out, state = (str(tmp_path / n) for n in ("rows", "out", "state"))
    seen = []
    for k, (a, b) in enumerate([("0", "100"), ("10", "90"), ("5", "99")]):
        spark.createDataFrame([(1, date(2024, 1, 1 + 10 * k), 1, k, D(a), D(b))], schema).coalesce(1).write.mode("append").parquet(source)
        flows.check_stream(spark, source, schema, out, state)
        seen.append([(r.row_no, r.kind) for r in spark.read.schema(flows.CHECKED).parquet(out).orderBy("row_no").collect()])
    assert seen == [[], [(0, None)], [(0, None), (1, "debit")]]


def test_balances_are_checked_without_a_call_for_each_statement(spark, tmp_path):
    from datetime import date
    from decimal import Decimal as D

    fields = "doc_id long, txn_date date, page int, row_no int, amount decimal(18,2), balance decimal(18,2)"
    source, out, state = (str(tmp_path / n) for n in ("rows", "out", "state"))
    # 20,000 statements: calls of Python and of a state store for each of them take minutes.
    steps = "explode(array(named_struct('k', 0, 'd', date'2024-01-01', 'b', 100), named_struct('k', 1, 'd', date'2024-01-02', 'b', 90), named_struct('k', 2, 'd', date'2024-01-30', 'b', 99))) AS s"
    rows = spark.range(20_000).selectExpr("id", steps).selectExpr("id AS doc_id", "s.d AS txn_date", "1 AS page", "s.k AS row_no", "CAST(9 + s.k % 2 AS DECIMAL(18,2)) AS amount", "CAST(s.b AS DECIMAL(18,2)) AS balance")
    schema = spark.createDataFrame([], fields).schema
    rows.to(schema).write.parquet(source)
    began = time.time()
    flows.check_stream(spark, source, schema, out, state)
    # Too late, and in time: one row is dropped, another goes on from the balance of the batch before.
    spark.createDataFrame([(1, date(2024, 1, 29), 1, 3, D(1), D(1)), (2, date(2024, 1, 31), 1, 3, D(40), D(139)), (3, None, 1, 3, D(1), D(1))], schema).write.mode("append").parquet(source)
    flows.end_stream(spark, source, schema)
    flows.check_stream(spark, source, schema, out, state)
    assert time.time() - began < 60
    found = spark.read.schema(flows.CHECKED).parquet(out).where("doc_id IS NOT NULL")
    assert {(r.row_no, r.kind): r.n for r in found.groupBy("row_no", "kind").count().withColumnRenamed("count", "n").collect()} == {(0, None): 20_000, (1, "debit"): 20_000, (2, "credit"): 20_000, (3, "credit"): 1}
