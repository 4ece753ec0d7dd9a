"""Operators on cases: lists, lookups, contexts, timelines, reports, graphs, template texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rules of each context.
CONTEXT_RULES = {
    "loan_approval": ["check_salary_consistency", "check_bank_balance", "check_employer_validity"],
    "mortgage_underwriting": ["check_property_ownership", "check_property_valuation", "check_long_term_income"],
    "kyc": ["check_identity_consistency", "check_address_validity", "check_document_authenticity"],
    "tenant_screening": ["check_rental_history", "check_income_to_rent_ratio"],
    "insurance_claims": ["check_claim_consistency", "check_policy_coverage"],
    "credit_assessment": ["check_debt_to_income", "check_credit_score_consistency"],
    "internal_audit": ["check_compliance_markers", "check_process_adherence"],
}
AUTO = "Automatic Detection"
#: Document types that tell a case's context; the first rule that holds decides.
CONTEXT_SIGNS = [
    (["Mortgage Statement", "Property Deed", "Title Deed"], "Mortgage Underwriting"),
    (["ID Card", "Passport", "Driver's License", "Utility Bill"], "KYC / Onboarding"),
    (None, "Insurance Claims"),
    (["Rental Agreement", "Lease", "Tenancy Agreement"], "Tenant Screening"),
    (["Audit Report", "Financial Statement", "Balance Sheet"], "Internal Audit"),
    (["Bank Statement", "Payslip"], "Loan Approval"),
]
RANKS = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3}


def page_of(cases: DataFrame, skip: int = 0, limit: int = 10) -> DataFrame:
    """Newest cases first; of equals the smaller id."""
    return cases.orderBy(F.col("created_at").desc(), "case_id").offset(skip).limit(limit)


def matching(cases: DataFrame, term: str, status: str = "ALL") -> DataFrame:
    """Cases of a status whose title, context or id has the term, whatever the case of letters."""
    low = term.lower()
    hit = F.lower(F.coalesce("title", F.lit(""))).contains(low) | F.lower("context").contains(low) | F.col("case_id").cast("string").contains(low)
    return cases.where(hit if status == "ALL" else hit & (F.col("status") == status))


def shown_title(title: Column, context: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.concat(F.lit("Investigation: "), context))


def label(recommendation: Column) -> Column:
    names = F.create_map(*[F.lit(x) for x in ("MANUAL_REVIEW", "Manual Review", "AUTO_APPROVE", "Auto Approved", "AUTO_REJECT", "Auto Rejected")])
    return F.coalesce(F.try_element_at(names, recommendation), F.initcap(F.replace(recommendation, F.lit("_"), F.lit(" "))))


def rules_of(context: Column) -> Column:
    table = F.create_map(*[x for k, v in CONTEXT_RULES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.try_element_at(table, F.replace(F.lower(context), F.lit(" "), F.lit("_"))), F.array().cast("array<string>"))


def expected_documents(context: Column) -> Column:
    return F.when(F.lower(context).rlike("underwriting|mortgage|loan"), 3).otherwise(2)


def detected_context(documents: DataFrame) -> DataFrame:
    """(case_id, context) by the types of a case's documents (case_id, classification)."""
    kind = F.col("classification")
    signs = [F.bool_or(F.lower(kind).contains("insurance") if types is None else kind.isin(types)).alias(f"s{k}") for k, (types, _) in enumerate(CONTEXT_SIGNS)]
    context = F.lit("Loan Approval")
    for k, (_, name) in reversed(list(enumerate(CONTEXT_SIGNS))):
        context = F.when(F.col(f"s{k}"), name).otherwise(context)
    return documents.groupBy("case_id").agg(*signs).select("case_id", context.alias("context"))


def new_titles(cases: DataFrame, detected: DataFrame) -> DataFrame:
    """(case_id, context, title): cases on automatic detection get the detected context, and its title where theirs was the placeholder."""
    joined = cases.join(detected.withColumnRenamed("context", "found"), "case_id", "left")
    auto = F.col("context") == AUTO
    context = F.when(auto, F.coalesce("found", F.lit("Loan Approval"))).otherwise(F.col("context"))
    title = F.when(auto & (F.col("title") == f"Investigation: {AUTO}"), F.concat(F.lit("Investigation: "), context)).otherwise(F.col("title"))
    return joined.select("case_id", context.alias("context"), title.alias("title"))


def latest_events(events: DataFrame) -> DataFrame:
    """The newest event of each case; of equals the larger id."""
    return events.groupBy("case_id").agg(F.max(F.struct("ts", "event_id", "progress", "status")).alias("e")).select("case_id", "e.ts", "e.event_id", "e.progress", "e.status")


def severity_rank(severity: Column) -> Column:
    out = F.lit(9)
    for k, r in RANKS.items():
        out = F.when(severity == k, r).otherwise(out)
    return out


def ranked_findings(findings: DataFrame) -> DataFrame:
    """(case_id, severity, rank, place): findings of a case from the worst on; of equals by source, name, seq."""
    rows = findings.withColumn("rank", severity_rank(F.col("severity")))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("case_id").orderBy("rank", "layer_source", "name", "seq")))


def first_evidence(findings: DataFrame, n: int = 5) -> DataFrame:
    """(case_id, first, more): the first n names in order of severity and how many there are beyond."""
    rows = ranked_findings(findings).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("place", "name"))).alias("all"))
    return rows.select("case_id", F.transform(F.slice("all", 1, n), lambda x: x["name"]).alias("first"), F.greatest(F.size("all") - n, F.lit(0)).alias("more"))


def csv_rows(cases: DataFrame, recommended: Column) -> DataFrame:
    """The list as it is exported."""
    t = F.col("trust_score")
    return cases.select(F.col("case_id").alias("id"), "context", F.coalesce(F.nullif("title", F.lit("")), F.lit("Untitled")).alias("title"), "status",
                        F.when(t.isNull() | (t == 0), "N/A").otherwise(t.cast("string")).alias("trust"), F.coalesce(recommended, F.lit("N/A")).alias("recommendation"))


def report_rows(cases: DataFrame, documents: DataFrame, findings: DataFrame, events: DataFrame) -> DataFrame:
    """(case_id, report): one JSON text per case with its documents, findings and timeline."""

    def children(rows: DataFrame, name: str, *columns: str) -> DataFrame:
        return rows.groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))

    joined = cases.join(children(documents, "documents", "doc_id", "name"), "case_id", "left").join(children(findings, "findings", "severity", "name", "layer_source", "seq"), "case_id", "left").join(children(events, "timeline", "ts", "event_type", "status"), "case_id", "left")
    return joined.select("case_id", F.to_json(F.struct("case_id", "context", "status", "trust_score", "documents", "findings", "timeline")).alias("report"))


def graph_nodes(documents: DataFrame, findings: DataFrame) -> DataFrame:
    """(case_id, node, kind, label) of applicants, documents, entities, findings, evidence and recommendations."""
    name = F.min_by("name", F.when(F.col("name").isNotNull(), F.struct("seq", "doc_id")))
    people = documents.groupBy("case_id").agg(F.coalesce(name, F.lit("Applicant")).alias("label")).select("case_id", F.lit("applicant").alias("node"), F.lit("Applicant").alias("kind"), "label")
    docs = documents.select("case_id", F.concat(F.lit("doc_"), F.col("doc_id")).alias("node"), F.lit("Document").alias("kind"), F.concat(F.lit("Document "), F.col("doc_id")).alias("label"))
    entities = documents.select("case_id", "doc_id", F.stack(F.lit(2), F.lit("name"), F.col("name"), F.lit("pan"), F.col("pan")).alias("field", "value")).where("value IS NOT NULL")
    fields = entities.select("case_id", F.concat_ws("_", F.lit("ent"), F.col("doc_id"), F.col("field")).alias("node"), F.lit("Entity").alias("kind"), F.concat(F.col("field"), F.lit(": "), F.col("value")).alias("label"))
    numbered = ranked_findings(findings)
    found = numbered.select("case_id", F.concat(F.lit("find_"), F.col("place")).alias("node"), F.lit("Finding").alias("kind"), F.col("name").alias("label"))
    proof = numbered.select("case_id", F.concat(F.lit("evid_"), F.col("place")).alias("node"), F.lit("Evidence").alias("kind"), F.col("layer_source").alias("label"))
    ends = people.select("case_id", F.lit("recommendation").alias("node"), F.lit("Recommendation").alias("kind"), F.lit("Recommendation").alias("label"))
    return people.unionByName(docs).unionByName(fields).unionByName(found).unionByName(proof).unionByName(ends)


def graph_edges(documents: DataFrame, findings: DataFrame) -> DataFrame:
    """(case_id, source, target, relation)."""

    def edge(rows: DataFrame, source: Column, target: Column, relation: str) -> DataFrame:
        return rows.select("case_id", source.alias("source"), target.alias("target"), F.lit(relation).alias("relation"))

    doc = F.concat(F.lit("doc_"), F.col("doc_id"))
    entities = documents.select("case_id", "doc_id", F.stack(F.lit(2), F.lit("name"), F.col("name"), F.lit("pan"), F.col("pan")).alias("field", "value")).where("value IS NOT NULL")
    numbered = ranked_findings(findings)
    find, evid = F.concat(F.lit("find_"), F.col("place")), F.concat(F.lit("evid_"), F.col("place"))
    first = documents.groupBy("case_id").agg(F.min("doc_id").alias("doc_id"))
    return (
        edge(documents, F.lit("applicant"), doc, "submitted")
        .unionByName(edge(entities, doc, F.concat_ws("_", F.lit("ent"), F.col("doc_id"), F.col("field")), "contains"))
        .unionByName(edge(numbered.join(first, "case_id"), doc, evid, "contains_evidence"))
        .unionByName(edge(numbered, evid, find, "supports"))
        .unionByName(edge(numbered, find, F.lit("recommendation"), "leads_to"))
    )


def summaries(groups: DataFrame, scores: DataFrame, recommendation: Column) -> DataFrame:
    """(case_id, executive, risk): the template texts of a case."""
    joined = scores.join(groups, "case_id", "left").na.fill(0, ["identity", "financial", "forensic"])
    executive = F.concat(F.lit("Trust score "), F.col("trust_score").cast("string"), F.lit(". Recommendation: "), label(recommendation), F.lit("."))
    risk = F.when(F.col("identity") + F.col("financial") + F.col("forensic") == 0, "No findings.").otherwise(F.format_string("Identity: %d, financial: %d, forensic: %d.", "identity", "financial", "forensic"))
    return joined.select("case_id", executive.alias("executive"), risk.alias("risk"))


#: The texts of a case's template summary; a number stands where %d or %s is.
CASE_TEXTS = {
    "executive": "Forensic analysis complete. Flagged %d anomalies with Trust Score at %s%%. Manual verification is recommended.",
    "executive_none": "All uploaded documents exhibit strong structural consistency with known genuine references. No significant metadata anomalies, OCR inconsistencies, cross-document mismatches, or forensic indicators were detected. The investigation is considered low risk.",
    "hindi": "फॉरेंसिक विश्लेषण पूरा हो गया है। ट्रस्ट स्कोर %s%% के साथ विसंगतियां पाई गईं। मैनुअल सत्यापन की सिफारिश की जाती है।",
    "hindi_none": "सभी अपलोड किए गए दस्तावेज़ ज्ञात वास्तविक संदर्भों के साथ मजबूत संरचनात्मक स्थिरता प्रदर्शित करते हैं। कोई महत्वपूर्ण मेटाडेटा विसंगतियां, ओसीआर विसंगतियां, क्रॉस-दस्तावेज़ बेमेल, या फॉरेंसिक संकेतक नहीं पाए गए। इस जांच को कम जोखिम वाला माना गया है।",
    "risk": "Risk rating calculated at %s%% based on severity deductions from forensic checkpoints.",
    "risk_none": "No structural, mathematical, or metadata anomalies detected. Document integrity is fully consistent with known authentic baselines.",
    "identity": "Identity verification flagged %d name mismatch signals. Fuzzy matching scores fell below threshold.",
    "identity_none": "Names extracted from Aadhaar and PAN were normalized before comparison. All identity fields matched successfully after OCR correction. No conflicting identity attributes were detected.",
    "math": "Financial math verification identified %d calculation warnings.",
    "math_none": "All salary entries, transaction lines, and running balances were mathematically reconciled. Calculations check out exactly against bank statement totals.",
    "forensic": "Forensic layer flagged %d metadata / tool signature inconsistencies.",
    "forensic_none": "Digital signatures, creator/producer metadata, and revision histories were audited. No signatures of editing software, compression modifications, or backdated timestamps were detected.",
    "step_identity": "Verify ID numbers with government databases.",
    "step_math": "Verify payslip basic pay matches deposits in bank statements.",
    "step_forensic": "Inspect file creator/producer metadata for Photoshop or Canva tags.",
    "step_none": "Conduct standard verification checklist.",
    "missing": "Net Banking PDF",
    "question": "Confirm salary transaction reference ID.",
    "verify": "Verify Original Documents",
    "approve": "Approve Case",
}


def case_texts(cases: DataFrame, findings: DataFrame, scores: DataFrame) -> DataFrame:
    """All texts of a case's summary, by counts of its findings; a case without findings or score has a trust of 100.

    Findings on identity are those across documents that name it, on sums those that name math, balance or salary, forensic
    ones those of that layer. Contradictions are the names of findings with a mismatch, by seq and name. Cases are kept as
    they are, repeated ones too; a null context is an empty text.
    """
    name = F.lower(F.coalesce("name", F.lit("")))
    counts = findings.groupBy("case_id").agg(
        F.count("*").alias("n"), F.count_if((F.col("layer_source") == "CROSS_DOC") & name.contains("identity")).alias("identity"), F.count_if(name.rlike("math|balance|salary")).alias("math"),
        F.count_if(F.col("layer_source") == "FORENSIC").alias("forensic"), F.array_sort(F.collect_list(F.when(name.contains("mismatch"), F.struct("seq", "name")))).alias("odd"),
    )
    rows = cases.select("case_id", "context").join(counts, "case_id", "left").join(scores.select("case_id", F.col("trust_score").cast("decimal(9,1)").alias("trust")), "case_id", "left")
    rows = rows.na.fill(0, ["n", "identity", "math", "forensic"]).withColumn("trust", F.coalesce("trust", F.lit(100).cast("decimal(9,1)")))
    some = F.col("n") > 0
    shown = lambda c: c.cast("decimal(9,1)").cast("string")

    def part(kind: str) -> Column:
        return F.when(F.col(kind) > 0, F.format_string(CASE_TEXTS[kind], kind)).otherwise(CASE_TEXTS[kind + "_none"])

    def either(kind: str, *values: Column) -> Column:
        return F.when(some, F.format_string(CASE_TEXTS[kind], *values)).otherwise(CASE_TEXTS[kind + "_none"])

    steps = F.array_compact(F.array(*[F.when(F.col(k) > 0, CASE_TEXTS["step_" + k]) for k in ("identity", "math", "forensic")]))
    listed = lambda key: F.when(some, F.array(F.lit(CASE_TEXTS[key]))).otherwise(F.array().cast("array<string>"))
    return rows.select(
        "case_id", either("executive", F.col("n"), shown(F.col("trust"))).alias("executive_summary"), either("hindi", shown(F.col("trust"))).alias("executive_summary_hi"),
        either("risk", shown(100 - F.col("trust"))).alias("risk_narrative"),
        F.concat(F.lit("Identity check: "), part("identity"), F.lit(" Math check: "), part("math"), F.lit(" Forensic check: "), part("forensic")).alias("evidence_analysis"),
        F.when(some, "15%").otherwise("0%").alias("false_positive_probability"),
        F.coalesce(F.transform("odd", lambda x: x["name"]), F.array().cast("array<string>")).alias("contradictions"),
        listed("missing").alias("missing_evidence"), listed("question").alias("manual_review_questions"),
        F.when(F.size(steps) > 0, steps).otherwise(F.array(F.lit(CASE_TEXTS["step_none"]))).alias("recommended_next_steps"),
        F.concat(F.lit("Audit of applicant folder context '"), F.coalesce("context", F.lit("")), F.lit("'. "), part("identity")).alias("forensic_story"),
        F.when(some, CASE_TEXTS["verify"]).otherwise(CASE_TEXTS["approve"]).alias("final_recommendation"),
    )


def lenient_json(reply: Column) -> Column:
    """The JSON object in a reply: without fences, from the first to the last brace."""
    plain = F.trim(F.regexp_replace(reply, r"(?m)^```(?:json)?\s*$", ""))
    return F.coalesce(F.when(F.try_parse_json(plain).isNotNull(), plain), F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit("")))


def prompts(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """(case_id, prompt): a case as text, findings from the worst on."""
    lines = ranked_findings(findings).groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("place", F.concat_ws(" ", F.lit("-"), F.col("severity"), F.col("name")).alias("line")))).alias("all"))
    return cases.join(lines, "case_id", "left").select("case_id", F.concat_ws("\n", F.concat(F.lit("Context: "), F.col("context")), F.lit("Findings:"), F.array_join(F.transform("all", lambda x: x["line"]), "\n")).alias("prompt"))


def report_band(score: Column) -> Column:
    return F.when(score > 80, "LOW RISK").when(score > 50, "MEDIUM RISK").otherwise("HIGH RISK")


def list_band(score: Column) -> Column:
    return F.when(score >= 80, "verified").when(score >= 50, "suspicious").otherwise("fraudulent")
