"""Nested reports in parts, places of terms, gates of context rules."""

from __future__ import annotations

import json
import re

from caselight.operators import fields, gating, reports as R, scoring

CASES = "case_id long, context string, status string, created_at timestamp, trust_score double, recommendation string"


def tables(spark):
    from datetime import datetime

    day = datetime(2024, 1, 2, 3, 4, 5)
    return {
        "cases": spark.createDataFrame([(1, "Loan", "COMPLETED", day, 50.0, "MANUAL_REVIEW"), (2, None, None, None, None, None)], CASES),
        "documents": spark.createDataFrame([(1, d, f"f{d}", "Payslip", "pdf", f"text {d}", ("n",), ("m",)) for d in range(7)] + [(99, 50, "x", "x", "x", "x", None, None)], "case_id long, doc_id long, filename string, classification string, file_type string, text string, entities struct<name: string>, metadata struct<maker: string>"),
        "findings": spark.createDataFrame([(1, s, f"name {s}", "HIGH", "d", "CONTEXT") for s in range(5)], "case_id long, seq int, name string, severity string, description string, layer_source string"),
        "evidence": spark.createDataFrame([(1, 2, d % 8, d, 0.5, f"t{d}", "why", None) for d in range(10)], "case_id long, finding int, doc_id long, page int, confidence double, extracted string, description string, coordinates struct<x: int>"),
        "events": spark.createDataFrame([(1, e, day, "VIEW", None) for e in range(4)], "case_id long, event_id long, ts timestamp, event_type string, message string"),
        "matches": spark.createDataFrame([(1, "ref-g1", False, 90.0)], "case_id long, ref_id string, is_fraud boolean, similarity double"),
        "summaries": spark.createDataFrame([(1, ("all good",))], "case_id long, summary struct<executive: string>"),
    }


def read(spark, most):
    rows = R.reports(**tables(spark), most=most).collect()
    return {(r.case_id, r.part): json.loads(r.report) for r in rows}


def test_report_of_one_part(spark):
    found = read(spark, 100)
    assert sorted(found) == [(1, 0), (2, 0)]
    one, two = found[1, 0], found[2, 0]
    assert list(one) == list(two) == ["investigation_id", "context", "status", "created_at", "scores", "ai_summary", "dataset_similarity", "documents", "findings", "timeline"]
    assert two["documents"] == two["findings"] == two["timeline"] == [] and two["ai_summary"] is None and two["scores"] == {"trust_score": None, "recommendation": None}
    assert one["scores"]["recommendation"] == "Manual Review" and one["dataset_similarity"]["ref_id"] == "ref-g1" and [d["id"] for d in one["documents"]] == list(range(7))
    proof = one["findings"][2]["evidence"]
    assert [(p["document_id"], p["page"], p["document"]) for p in proof] == sorted((d % 8, d, f"f{d % 8}" if d % 8 < 7 else None) for d in range(10))
    assert [f["evidence"] for f in one["findings"] if f["id"] != 2] == [[]] * 4 and [e["type"] for e in one["timeline"]] == ["VIEW"] * 4


def test_parts_hold_little_and_lose_nothing(spark):
    found = read(spark, 3)
    whole = read(spark, 100)[1, 0]
    parts = [r for (c, _), r in sorted(found.items()) if c == 1]
    assert len(parts) > 3
    for name in ("documents", "timeline"):
        assert [x for p in parts for x in p[name]] == whole[name] and all(len(p[name]) <= 3 for p in parts)
    pieces = [(f["id"], e["page"]) for p in parts for f in p["findings"] for e in f["evidence"]]
    assert sorted(pieces) == sorted((2, d) for d in range(10)) and all(len(f["evidence"]) <= 3 for p in parts for f in p["findings"])
    assert {f["id"] for p in parts for f in p["findings"]} == set(range(5)) and all(sum(1 + len(f["evidence"]) for f in p["findings"]) <= 6 for p in parts)
    assert {p["context"] for p in parts} == {"Loan"}


def test_levels_and_chain(spark):
    t = tables(spark)
    rows = {r.case_id: r for r in R.levels(t["cases"], t["findings"], t["evidence"], t["documents"]).collect()}
    assert (rows[1].documents, rows[1].findings, rows[1].worst, rows[1].proven, rows[1].pieces, rows[1].pages, rows[1].confidence) == (7, 5, 1, 1, 10, 10, 0.5)
    assert (rows[2].documents, rows[2].findings, rows[2].worst, rows[2].confidence) == (0, 0, None, None)
    chain = R.evidence_chain(t["findings"], t["evidence"], t["documents"]).collect()
    assert len(chain) == 14 and sum(r.doc_id is None for r in chain) == 4 and sum(r.filename is None for r in chain) == 5


WORDS = "doc_id long, pos int, word string, page int, x0 int, y0 int, x1 int, y1 int"


def laid_out(spark, *texts, page=12):
    return spark.createDataFrame([(d, p, w, 1 + p // page, 10 * (p % 4), 5 * (p // 4), 10 * (p % 4) + 9, 5 * (p // 4) + 4) for d, t in enumerate(texts) for p, w in enumerate(t.split(" "))], WORDS)


def placed(spark, text, page=12):
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    return sorted((r.term, r.category, r.page, r.x, r.y, r.width, r.height) for r in fields.run_places(fields.field_terms(docs), laid_out(spark, text, page=page)).collect())


def test_terms_of_several_words(spark):
    text = "paid by (Anna Maria Lang), on Jan 5, 2024; card 1234 5678 9012 3456 of Anna, Maria again"
    assert placed(spark, text, page=100) == [
        ("1234 5678 9012 3456", "Account Number", 1, 0, 10, 39, 9),
        ("Anna Maria Lang", "Name/Address", 1, 0, 0, 39, 9),
        ("Jan 5, 2024", "Date", 1, 0, 5, 39, 9),
    ]


def test_no_run_over_two_pages_and_repeated_places(spark):
    assert placed(spark, "x y z Anna Lang and Anna Lang", page=4) == [("Anna Lang", "Name/Address", 2, 20, 5, 19, 4)]
    assert placed(spark, "nothing here") == []


def test_first_amounts_only(spark):
    text = " ".join(f"x ${k}.00" for k in range(40))
    found = placed(spark, text, page=1000)
    assert len(found) == 15 and {t for t, *_ in found} == {f"${k}.00" for k in range(15)}


def test_gates(spark):
    cases = spark.createDataFrame([(1, "Loan Approval"), (2, "Tenant Screening"), (3, "Unknown"), (4, None)], "case_id long, context string")
    slip = "Gross: 100.00\nDeductions: 10.00\nNet Pay: 50.00\nrent: 9,000.00 via venmo"
    bank = "01/01/2020 open 100.00\n02/01/2020 x 10.00 95.00"
    docs = spark.createDataFrame(
        [(c, 10 * c + k, kind, text) for c in (1, 2, 3, 4) for k, (kind, text) in enumerate([("Payslip", slip), ("Bank Statement", bank), ("Unknown", slip), ("Payslip", ""), ("Payslip", None), (None, slip)])],
        "case_id long, doc_id long, classification string, text string",
    )
    passed = {(r.doc_id, r.detector) for r in gating.gated(cases, docs).collect()}
    assert passed == {(10, "payslip_math"), (11, "bank_balance"), (20, "payslip_math"), (21, "bank_balance"), *((d, "lease_signals") for d in (20, 21, 22, 25))}
    found = {(r.case_id, r.doc_id, r.name) for r in gating.context_findings(cases, docs, "2024-01-01").collect()}
    assert {(1, 10, "Altered Payslip Math"), (1, 11, "Balance Calculation Error"), (2, 20, "Altered Payslip Math")} <= found
    assert {d for _, d, _ in found} == {10, 11, 20, 21, 22, 25} and {d for c, d, n in found if c == 1} == {10, 11}
    undated = {r.name for r in gating.context_findings(cases, docs).where("doc_id = 21").collect()}
    assert undated < {n for _, d, n in found if d == 21}  # only with a day to hold it against is a document too old


def test_completeness_of_absent_columns(spark):
    docs = spark.createDataFrame([(1, "Bank Statement", "n", "1"), (1, "Bank Statement", None, None), (2, "Payslip", "n", None), (3, "Other", "n", None), (4, "Lease Agreement", None, None)], "case_id long, classification string, name string, account_number string")
    assert {r.case_id: round(r.completeness, 3) for r in scoring.completeness(docs).collect()} == {1: 50.0, 2: 33.333, 3: 100.0, 4: 0.0}


def prompts(spark, most):
    t = tables(spark)
    docs = t["documents"].selectExpr("case_id", "doc_id", "filename", "classification", "90 AS ocr_confidence", "CAST(NULL AS string) AS producer", "'Writer' AS creator")
    found = R.prompts(t["cases"], docs, t["findings"], t["evidence"], t["matches"].selectExpr("*", "1 AS rank"), most)
    return {(r.case_id, r.part): r.prompt for r in found.collect()}


def test_prompts_name_all_that_a_case_holds(spark):
    found = prompts(spark, 100)
    assert sorted(found) == [(1, 0), (2, 0)]
    none = ["INVESTIGATION FORENSIC METRICS:", "- Case Context: None", "- Trust Score: None/100", "- Rule Engine Suggestion: None"]
    for name in ("documents", "findings", "matches"):
        none += ["", R.PROMPT[name], R.PROMPT["no " + name]]
    assert found[2, 0].split("\n") == none
    lines = found[1, 0].split("\n")
    assert [x for x in lines if x.startswith("- File")] == [f"- File: f{d}" for d in range(7)] and lines.count("  Producer: None") == 7
    assert [x[16:] for x in lines if x.startswith("- Finding")] == [f"name {k}" for k in range(5)] and lines.count(R.PROMPT["no evidence"]) == 4
    at = lines.index("- Finding Name: name 2")
    assert lines[at + 5 : at + 15] == [f"  - Evidence in {f'f{d % 8}' if d % 8 < 7 else None} on page {d}: why [Text: 't{d}']" for d in sorted(range(10), key=lambda d: (d % 8, d))]
    assert lines[-1] == "  * ref-g1 (90.0% match) - Label: genuine" and not any(R.PROMPT["no " + n] in lines for n in ("documents", "findings", "matches"))
    parts = prompts(spark, 4)
    assert len(parts) > 4 and "\n".join(p for (c, _), p in sorted(parts.items()) if c == 1) == found[1, 0]


def test_case_file(spark):
    t = tables(spark)
    found = [(r.kind, json.loads(r.item)) for r in R.case_file(1, t["cases"], finding=t["findings"], event=t["events"]).collect()]
    assert sorted(k for k, _ in found) == ["case"] + ["event"] * 4 + ["finding"] * 5 and all(item["case_id"] == 1 for _, item in found)
    assert sorted(item["seq"] for k, item in found if k == "finding") == list(range(5))
    assert not R.case_file(99, t["cases"], document=t["documents"]).count()


def test_snapshot(spark):
    rows = scoring.snapshot(tables(spark)["cases"].withColumnRenamed("created_at", "title"), "now").collect()
    lines = {r.case_id: json.loads(r.line) for r in rows}
    assert lines[None] == {"generated_at": "now", "total_investigations": 2, "completed": 1, "auto_approved": 0, "manual_review": 1}
    assert lines[2] == {"id": 2, "title": None, "context": None, "status": None, "trust_score": None, "recommendation": None} and lines[1]["trust_score"] == 50.0 and len(rows) == 3


def test_lists_of_reports_are_made_once(spark, capsys):
    """Every section is computed once, and is dealt out by case alone."""
    R.reports(**tables(spark)).explain()
    plan = capsys.readouterr().out
    assert len(re.findall(r"Window \[row_number", plan)) == 1  # evidence was laid out twice before
    assert not re.search(r"hashpartitioning\(case_id#\d+L?, (part|seq|finding)#", plan)  # and lists were dealt out by part, then by case again
    assert plan.count("Exchange hashpartitioning(case_id#") <= 7


def test_findings_of_one_number_have_all_their_evidence(spark):
    t = tables(spark)
    t["findings"] = t["findings"].union(t["findings"].where("seq = 2")).union(spark.createDataFrame([(1, None, "no number", "LOW", "d", "CONTEXT")], t["findings"].schema))
    t["evidence"] = t["evidence"].union(spark.createDataFrame([(1, None, 1, 1, 0.5, "x", "y", None), (2, 9, 1, 1, 0.5, "x", "y", None)], t["evidence"].schema))
    rows = [json.loads(r.report) for r in R.reports(**t, most=4).collect()]
    pieces = [(f["id"], e["page"]) for r in rows for f in r["findings"] for e in f["evidence"]]
    assert sorted(pieces) == sorted((2, d) for d in range(10) for _ in range(2))
    assert sorted(str(f["id"]) for r in rows for f in r["findings"]) == sorted(["0", "1", "3", "4", "None"] + ["2"] * 6)
