"""Literal cases with results worked out by hand."""

from __future__ import annotations

from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from caselight.functions import entities as E, money, similarity as S
from caselight.operators import cases as K, classify as C, crossdoc, detectors, scoring, similar, statements


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def rows_of(spark, pairs):
    return spark.createDataFrame([(1, 1, k, D(a) if a else None, D(b)) for k, (a, b) in enumerate(pairs)], "doc_id long, page int, row_no int, amount decimal(18,2), balance decimal(18,2)")


def test_forged_statement(spark):
    rows = rows_of(spark, [("5000", "195000"), ("3000", "197600"), ("10000", "202600"), ("8000", "194600"), ("5000", "189600"), ("2000", "191600"), ("3817", "187783")])
    assert statements.balance_errors(rows).first().asDict() == {"doc_id": 1, "n_errors": 2, "first_rows": [1, 2]}
    closing = statements.closing_check(rows).first()
    assert (closing.expected, closing.shown, closing.difference) == (D("180183.00"), D("187783.00"), D("7600.00"))
    assert {r.name for r in statements.balance_findings(rows).collect()} == {"Balance Calculation Error", "Opening/Closing Balance Mismatch"}


@pytest.mark.parametrize(("balance", "kind"), [("90.50", "debit"), ("90.51", "error"), ("110.50", "credit"), ("110.51", "error")])
def test_tolerance(spark, balance, kind):
    rows = rows_of(spark, [(None, "100.00"), ("10.00", balance)])
    assert [r.kind for r in statements.checked_rows(rows).orderBy("row_no").collect()] == [None, kind]


@pytest.mark.parametrize(("ones", "n", "anomaly"), [(0, 19, False), (0, 20, True), (1, 20, False)])
def test_benford(spark, ones, n, anomaly):
    rows = rows_of(spark, [("1.50" if k < ones else "2.50", "0") for k in range(n)])
    assert statements.amount_statistics(rows).first().benford_anomaly is anomaly


@pytest.mark.parametrize(("whole", "anomaly"), [(4, False), (5, True)])
def test_round_numbers(spark, whole, anomaly):
    rows = rows_of(spark, [("7.00" if k < whole else "7.10", "0") for k in range(10)])
    assert statements.amount_statistics(rows).first().round_anomaly is anomaly


@pytest.mark.parametrize(
    ("found", "score"),
    [([("HIGH", "FORENSIC")], "65.0"), ([("HIGH", "CROSS_DOC")], "68.5"), ([("HIGH", "CONTEXT")], "72.0"), ([("HIGH", "KNN")], "82.5"), ([("MEDIUM", "CROSS_DOC")], "84.2"), ([("MEDIUM", "FORENSIC")] * 4, "50.0"), ([("LOW", "FORENSIC")] * 5, "75.0"), ([("odd", "FORENSIC")], "100.0")],
)
def test_trust(spark, found, score):
    df = spark.createDataFrame([(1, s, layer) for s, layer in found], "case_id long, severity string, layer_source string")
    assert scoring.trust_scores(df).first().trust_score == D(score)


def test_trust_bonus_for_documents(spark):
    df = spark.createDataFrame([(1, "HIGH", "FORENSIC")], "case_id long, severity string, layer_source string")
    docs = spark.createDataFrame([(1, 3)], "case_id long, n_documents int")
    assert scoring.trust_scores(df, 3, docs).first().trust_score == D("70.0")


@pytest.mark.parametrize(("score", "text"), [(85.0, "AUTO_APPROVE"), (84.9, "MANUAL_REVIEW"), (50.0, "MANUAL_REVIEW"), (49.9, "HIGH_RISK_MANUAL_REVIEW")])
def test_recommendation(spark, score, text):
    assert one(spark, scoring.recommendation(F.col("x")), x=score) == text


@pytest.mark.parametrize(("n", "p", "status"), [(2, 30, "LOW"), (3, 45, "MEDIUM"), (4, 60, "MEDIUM"), (5, 75, "HIGH"), (7, 100, "HIGH")])
def test_direct_risk(spark, n, p, status):
    row = scoring.direct_risk(spark.createDataFrame([(1,)] * n, "case_id long")).first()
    assert (row.probability, row.status) == (p, status)


@pytest.mark.parametrize(("net", "bad"), [("798", False), ("797.99", True)])
def test_payslip(spark, net, bad):
    df = spark.createDataFrame([(1, f"Gross: 1000\nDeductions: 200\nNet Pay: {net}")], "doc_id long, text string")
    assert detectors.payslip_math(df).first().mismatch is bad


def test_similarities():
    assert S.jaro_winkler_of("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert S.jaro_winkler_of("sharma", "sharme") == pytest.approx(0.933333, abs=1e-6)
    assert S.jaro_winkler_of("", "a") == S.jaro_winkler_of(None, "a") == 0
    assert S.indel_ratio_of("abcd", "abd") == pytest.approx(6 / 7)
    assert S.token_set_ratio_of("lake trading private", "trading lake") == 1.0
    assert S.token_set_ratio_of("", "x") == 0.0


@pytest.mark.parametrize(("a", "score"), [("R. Sharma", 0.96), ("S. Sharma", 0.0), ("Sharma", 0.0)])
def test_abbreviation(spark, a, score):
    assert one(spark, S.abbreviation(F.col("a"), F.col("b"), F.lit(1.0)), a=a, b="Rahul Sharma") == score


@pytest.mark.parametrize(("raw", "fixed"), [("ABCOE12O4F", "ABCOE1204F"), ("A8CDE1234F", "ABCDE1234F"), ("ABCDE123", None)])
def test_pan_correction(spark, raw, fixed):
    assert one(spark, E.corrected_pan(F.col("x")), x=raw) == fixed


def test_verhoeff(spark):
    def digit(head: str) -> str:
        return next(head + str(k) for k in range(10) if one(spark, E.verhoeff_ok(F.col("x")), x=head + str(k)))

    good = digit("23412341234")
    assert one(spark, E.valid_aadhaar(F.col("x")), x=good) == f"{good[:4]} {good[4:8]} {good[8:]}"
    assert not one(spark, E.verhoeff_ok(F.col("x")), x=good[1] + good[0] + good[2:])
    assert not one(spark, E.verhoeff_ok(F.col("x")), x="123")


@pytest.mark.parametrize(("text", "kind"), [("30/02/2024", "INVALID"), ("13/25/2024", "INVALID"), ("02/13/2024", "MM/DD/YYYY"), ("15/01/2024", "DD/MM/YYYY"), ("2024-01-15", "YYYY-MM-DD"), ("Jan 15, 2024", "Month DD, YYYY"), ("15 January 2024", "DD Month YYYY")])
def test_dates(spark, text, kind):
    assert [d["format"] for d in one(spark, money.dates(F.col("x")), x=text)] == [kind]


@pytest.mark.parametrize(("text", "value"), [("(1,234.50)", "-1234.50"), ("₹ 1,23,456.78", "123456.78"), ("500-", "-500.00"), ("n/a", None)])
def test_amounts(spark, text, value):
    assert one(spark, money.parsed_amount(F.col("x")), x=text) == (D(value) if value else None)


def test_classification_ties(spark):
    assert one(spark, C.document_type(F.col("x")), x="payslip and bank statement") == "Bank Statement"
    assert one(spark, C.document_type(F.col("x")), x="nothing") == "Unknown"


def test_card_lines(spark):
    pan = "INCOME TAX DEPARTMENT\nRAHUL SHARMA\n\nGOVT\nMOHAN SHARMA\n01/01/1990"
    assert one(spark, E.pan_names(F.col("x")), x=pan).asDict() == {"name": "RAHUL SHARMA", "father": "MOHAN SHARMA"}
    assert one(spark, E.aadhaar_name(F.col("x")), x="GOVERNMENT OF INDIA\nRahul Sharma\nDOB: 01/01/1990") == "RAHUL SHARMA"
    assert one(spark, E.father_name(F.col("x")), x="Father's Name\nMOHAN SHARMA") == "MOHAN SHARMA"


def test_missing_names_make_no_mismatch(spark):
    docs = spark.createDataFrame([(1, 1, 0, "AMIT SHARMA"), (2, 1, 1, None)], "doc_id long, case_id long, seq int, name string")
    assert crossdoc.name_mismatches(docs).count() == 0


def test_statement_lines(spark):
    docs = spark.createDataFrame([(1, "Opening 1.00\n01/02/2024 balance 100.00\n02/02/2024 pay 1,000.50 1,100.50\n03 Feb 2024 no amount")], "doc_id long, text string")
    rows = [(r.row_no, r.amount, r.balance) for r in statements.statement_rows(docs).orderBy("row_no").collect()]
    assert rows == [(1, None, D("100.00")), (2, D("1000.50"), D("1100.50"))]


def test_catalogue(spark):
    rows = detectors.catalogue(spark).collect()
    assert len(rows) == 34 and sum(r.has_detector for r in rows) == 8
    assert [sum(r.severity == s for r in rows) for s in ("HIGH", "MEDIUM", "LOW")] == [12, 11, 11]


def test_bands_and_json(spark):
    assert [one(spark, K.report_band(F.lit(x))) for x in (80, 80.1, 50)] == ["MEDIUM RISK", "LOW RISK", "HIGH RISK"]
    assert [one(spark, K.list_band(F.lit(x))) for x in (80, 50, 49)] == ["verified", "suspicious", "fraudulent"]
    assert one(spark, K.lenient_json(F.col("x")), x='say {"a": {"b": 1}} end') == '{"a": {"b": 1}}'


def test_library_limit(spark, monkeypatch):
    monkeypatch.setattr(similar, "LIBRARY_ROWS", 3)
    with pytest.raises(ValueError, match="neighbours"):
        similar.library(similar.built_in(spark))


def test_software_is_sought_in_producer_and_creator(spark):
    files = spark.createDataFrame([(1, "Adobe Photoshop", "Writer"), (2, None, "GIMP 2.10"), (3, "Canva", "canva"), (4, None, None), (5, "", "iText")], "doc_id long, producer string, creator string")
    assert sorted((r.doc_id, r.software) for r in detectors.software(files).collect()) == [(1, "photoshop"), (2, "gimp"), (3, "canva")]


def test_case_texts(spark):
    cases = spark.createDataFrame([(1, "Loan"), (2, None), (3, "Audit")], "case_id long, context string")
    findings = spark.createDataFrame(
        [(1, "Identity Name Mismatch", "CROSS_DOC", 2), (1, "Employer Mismatch", "CROSS_DOC", 1), (1, "Balance Error", "CONTEXT", 3), (3, None, "FORENSIC", 1)], "case_id long, name string, layer_source string, seq int"
    )
    scores = spark.createDataFrame([(1, 62.5)], "case_id long, trust_score double")
    got = {r.case_id: r for r in K.case_texts(cases, findings, scores).collect()}
    assert got[1].executive_summary == "Forensic analysis complete. Flagged 3 anomalies with Trust Score at 62.5%. Manual verification is recommended."
    assert got[1].risk_narrative.startswith("Risk rating calculated at 37.5% ")
    assert got[1].contradictions == ["Employer Mismatch", "Identity Name Mismatch"]
    assert got[1].recommended_next_steps == ["Verify ID numbers with government databases.", "Verify payslip basic pay matches deposits in bank statements."]
    assert "flagged 1 name mismatch" in got[1].evidence_analysis and "identified 1 calculation" in got[1].evidence_analysis and "62.5%" in got[1].executive_summary_hi
    assert got[2].final_recommendation == "Approve Case" and got[2].contradictions == [] and got[2].forensic_story.startswith("Audit of applicant folder context ''. Names")
    assert got[3].recommended_next_steps == ["Inspect file creator/producer metadata for Photoshop or Canva tags."] and "100.0%" in got[3].executive_summary
    assert case_none(spark, cases) == 0


def case_none(spark, cases):
    findings = spark.createDataFrame([], "case_id long, name string, layer_source string, seq int")
    return K.case_texts(cases.limit(0), findings, spark.createDataFrame([], "case_id long, trust_score double")).count()


def test_no_pattern_is_unknown(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a payslip"), (4, "payslip and aadhaar")], "doc_id long, text string")
    got = {r.doc_id: r.classification for r in C.classify(docs).collect()}
    assert got == {1: "Unknown", 2: "Unknown", 3: "Payslip", 4: "Payslip"}
    plan = C.classify(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == sum(map(len, C.TYPES.values()))
