"""Case reports: findings with their evidence and its documents, nested, in parts of a bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .cases import label, severity_rank

#: Items (documents, findings, pieces of evidence, events) of each kind that one part of a report holds, about.
ITEMS = 10_000


def evidence_chain(findings: DataFrame, evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """(case_id, seq, name, severity, doc_id, filename, page, confidence, extracted, description): every finding with each piece of
    its evidence and the document that it lies in; findings without evidence and evidence of unknown documents stay."""
    proof = evidence.withColumnRenamed("finding", "seq").join(documents.select("doc_id", "filename").dropDuplicates(["doc_id"]), "doc_id", "left")
    return findings.select("case_id", "seq", "name", "severity").join(proof, ["case_id", "seq"], "left").select("case_id", "seq", "name", "severity", "doc_id", "filename", "page", "confidence", "extracted", "description")


def levels(cases: DataFrame, findings: DataFrame, evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """(case_id, documents, findings, worst, proven, pieces, pages, confidence): what a case holds at each level; proven: findings with evidence."""
    pieces = evidence.groupBy("case_id", F.col("finding").alias("seq")).agg(F.count("*").alias("pieces"), F.countDistinct("doc_id", "page").alias("pages"), F.sum("confidence").alias("confidence"))
    found = findings.join(pieces, ["case_id", "seq"], "left").groupBy("case_id").agg(
        F.count("*").alias("findings"), F.min(severity_rank(F.col("severity"))).alias("worst"), F.count("pieces").alias("proven"), F.sum("pieces").alias("pieces"), F.sum("pages").alias("pages"), F.sum("confidence").alias("total"),
    )
    docs = documents.groupBy("case_id").agg(F.count("*").alias("documents"))
    rows = cases.select("case_id").join(docs, "case_id", "left").join(found, "case_id", "left").na.fill(0, ["documents", "findings", "proven", "pieces", "pages"])
    return rows.select("case_id", "documents", "findings", "worst", "proven", "pieces", "pages", F.round((F.col("total") / F.col("pieces")).cast("double"), 6).alias("confidence"))


def case_file(case_id: object, cases: DataFrame, **children: DataFrame) -> DataFrame:
    """(kind, item): one case and the rows of its children, each as JSON; the id reaches every table's scan as a filter.

    The case itself is ``case``, its children have the names they are given by. A case that is not there has no rows.
    """

    def of(rows: DataFrame, kind: str) -> DataFrame:
        return rows.where(F.col("case_id") == F.lit(case_id)).select("case_id", F.lit(kind).alias("kind"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("item"))

    own = of(cases, "case")
    items = own
    for name, rows in children.items():
        items = items.unionByName(of(rows, name).join(own.select("case_id").distinct(), "case_id", "left_semi"))
    return items.select("kind", "item")


def in_parts(rows: DataFrame, order: list, weight: Column, most: int) -> DataFrame:
    """``rows`` with ``part``: in order, parts of a case begin when the weights before them reach ``most``. A window runs over a case, nothing holds it."""
    before = F.sum(weight).over(Window.partitionBy("case_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("part", F.floor(F.coalesce(before, F.lit(0)) / most).cast("int"))


def listed(rows: DataFrame, name: str, order: list[str], item: Column) -> DataFrame:
    """(case_id, part, name): the items of each part as an array in order."""
    found = rows.groupBy("case_id", "part").agg(F.array_sort(F.collect_list(F.struct(*order, item.alias("item")))).alias("all"))
    return found.select("case_id", "part", F.transform("all", lambda x: x["item"]).alias(name))


def reports(cases: DataFrame, documents: DataFrame, findings: DataFrame, evidence: DataFrame, events: DataFrame, matches: DataFrame, summaries: DataFrame, most: int = ITEMS) -> DataFrame:
    """(case_id, part, report): the report of every case as JSON, nested from the case to findings, evidence and documents.

    cases (case_id, context, status, created_at, trust_score, recommendation), documents (case_id, doc_id, filename,
    classification, file_type, text, entities, metadata), findings (case_id, seq, name, severity, description,
    layer_source), evidence (case_id, finding, doc_id, page, confidence, extracted, description, coordinates), events
    (case_id, event_id, ts, event_type, message), matches (case_id, ref_id, is_fraud, similarity) and summaries (case_id,
    summary). A case has one part, unless it has more than about ``most`` documents, findings and their evidence, or
    events; then the lists go on in further parts, all with the same head, so that no task holds more. A finding whose
    evidence is longer than that comes again with the rest. Every key is always there; missing lists are empty.
    """
    named = documents.select("doc_id", "filename").dropDuplicates(["doc_id"])
    proof = evidence.join(named, "doc_id", "left")
    piece = F.struct(F.col("filename").alias("document"), F.col("doc_id").alias("document_id"), "page", F.col("extracted").alias("text"), "description", "coordinates")
    place = F.row_number().over(Window.partitionBy("case_id", "finding").orderBy("doc_id", "page", "extracted", "description"))
    proof = proof.withColumn("place", place).withColumn("again", F.floor((F.col("place") - 1) / most).cast("int"))
    proof = proof.groupBy("case_id", F.col("finding").alias("seq"), "again").agg(F.array_sort(F.collect_list(F.struct("place", piece.alias("item")))).alias("all"))
    proof = proof.select("case_id", "seq", "again", F.transform("all", lambda x: x["item"]).alias("evidence"))
    found = findings.join(proof, ["case_id", "seq"], "left").withColumn("again", F.coalesce("again", F.lit(0)))
    order = ["seq", "name", "severity", "layer_source", "description", "again"]
    found = in_parts(found, order, 1 + F.coalesce(F.size("evidence"), F.lit(0)), most)
    empty = F.array().cast(proof.schema["evidence"].dataType)
    item = F.struct(F.col("seq").alias("id"), "name", "severity", "description", "layer_source", F.coalesce("evidence", empty).alias("evidence"))
    sections = [
        listed(in_parts(documents, ["doc_id"], F.lit(1), most), "documents", ["doc_id"], F.struct(F.col("doc_id").alias("id"), "filename", "classification", "file_type", F.col("text").alias("extracted_text"), F.col("entities").alias("entities_json"), F.col("metadata").alias("metadata_json"))),
        listed(found, "findings", order, item),
        listed(in_parts(events, ["ts", "event_id"], F.lit(1), most), "timeline", ["ts", "event_id"], F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("event_type").alias("type"), "message")),
    ]
    parts = cases.select("case_id", F.lit(0).alias("part"))
    for s in sections:
        parts = parts.unionByName(s.select("case_id", "part"))
    rows = parts.distinct()
    for s in sections:
        rows = rows.join(s, ["case_id", "part"], "left")
    alike = matches.select("case_id", F.struct(F.col("similarity").alias("similarity_score"), "ref_id", "is_fraud").alias("dataset_similarity"))
    head = cases.join(alike, "case_id", "left").join(summaries.select("case_id", F.col("summary").alias("ai_summary")), "case_id", "left")
    # A case that the others name but that is not there has no report.
    rows = head.join(rows, "case_id")
    body = F.struct(
        F.col("case_id").alias("investigation_id"), "context", "status", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), F.struct("trust_score", label(F.col("recommendation")).alias("recommendation")).alias("scores"), "ai_summary", "dataset_similarity",
        *(F.coalesce(n, F.array().cast(s.schema[n].dataType)).alias(n) for n, s in zip(("documents", "findings", "timeline"), sections)),
    )
    return rows.select("case_id", "part", F.to_json(body, {"ignoreNullFields": "false"}).alias("report"))


#: Headings and empty lists of a case's prompt.
PROMPT = {
    "metrics": "INVESTIGATION FORENSIC METRICS:", "documents": "DOCUMENT FILES & EXTRACTED METADATA:", "findings": "DETAILED FORENSIC FINDINGS & EVIDENCE ATTACHED:", "matches": "DATASET SIMILARITY & CASE-BASED REASONING (CBR) MATCHES:",
    "no documents": "No documents.", "no findings": "No findings detected.", "no evidence": "  - No specific coordinate evidence.", "no matches": "  No baseline matches.",
}


def prompts(cases: DataFrame, documents: DataFrame, findings: DataFrame, evidence: DataFrame, matches: DataFrame, most: int = ITEMS) -> DataFrame:
    """(case_id, part, prompt): the text on a case for a model that sums it up: figures, documents, findings with evidence, matches.

    cases (case_id, context, trust_score, recommendation), documents (case_id, doc_id, filename, classification,
    ocr_confidence, producer, creator), findings (case_id, seq, name, severity, description, layer_source), evidence
    (case_id, finding, doc_id, page, extracted, description), matches (case_id, ref_id, is_fraud, similarity, rank). One
    row of ``cases`` for each case. A text of over ``most`` entries goes on in further parts; what is missing reads
    None, and evidence of a finding that is not there is left out.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    text = lambda *parts: F.concat(*[shown(p[1:]) if p.startswith("@") else F.lit(p) for p in parts])
    sections = {1: "documents", 3: "findings", 5: "matches"}

    def entry(rows: DataFrame, section: int, line: Column, **order: Column | str) -> DataFrame:
        keys = [F.coalesce(F.expr(order[k]) if k in order else F.lit(0), F.lit(0)).cast("long").alias(k) for k in ("at", "below", "place", "page")]
        return rows.select("case_id", F.lit(section).alias("section"), *keys, line.alias("line"))

    pieces = evidence.groupBy("case_id", F.col("finding").alias("seq")).agg(F.count("*").alias("pieces"), F.countDistinct("doc_id", "page").alias("pages"), F.sum("confidence").alias("confidence"))
    found = findings.join(pieces, ["case_id", "seq"], "left").groupBy("case_id").agg(
        F.count("*").alias("findings"), F.min(severity_rank(F.col("severity"))).alias("worst"), F.count("pieces").alias("proven"), F.sum("pieces").alias("pieces"), F.sum("pages").alias("pages"), F.sum("confidence").alias("total"),
    )
    docs = documents.groupBy("case_id").agg(F.count("*").alias("documents"))
    rows = cases.select("case_id").join(docs, "case_id", "left").join(found, "case_id", "left").na.fill(0, ["documents", "findings", "proven", "pieces", "pages"])
    return rows.select("case_id", "documents", "findings", "worst", "proven", "pieces", "pages", F.round((F.col("total") / F.col("pieces")).cast("double"), 6).alias("confidence"))


def case_file(case_id: object, cases: DataFrame, **children: DataFrame) -> DataFrame:
    """(kind, item): one case and the rows of its children, each as JSON; the id reaches every table's scan as a filter.

    The case itself is ``case``, its children have the names they are given by. A case that is not there has no rows.
    """

    def of(rows: DataFrame, kind: str) -> DataFrame:
        return rows.where(F.col("case_id") == F.lit(case_id)).select("case_id", F.lit(kind).alias("kind"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("item"))

    own = of(cases, "case")
    items = own
    for name, rows in children.items():
        items = items.unionByName(of(rows, name).join(own.select("case_id").distinct(), "case_id", "left_semi"))
    return items.select("kind", "item")


def in_parts(rows: DataFrame, order: list, weight: Column, most: int) -> DataFrame:
    """``rows`` with ``part``: in order, parts of a case begin when the weights before them reach ``most``. A window runs over a case, nothing holds it."""
    before = F.sum(weight).over(Window.partitionBy("case_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("part", F.floor(F.coalesce(before, F.lit(0)) / most).cast("int"))


def reports(cases: DataFrame, documents: DataFrame, findings: DataFrame, evidence: DataFrame, events: DataFrame, matches: DataFrame, summaries: DataFrame, most: int = ITEMS) -> DataFrame:
    """(case_id, part, report): the report of every case as JSON, nested from the case to findings, evidence and documents.

    cases (case_id, context, status, created_at, trust_score, recommendation), documents (case_id, doc_id, filename,
    classification, file_type, text, entities, metadata), findings (case_id, seq, name, severity, description,
    layer_source), evidence (case_id, finding, doc_id, page, confidence, extracted, description, coordinates), events
    (case_id, event_id, ts, event_type, message), matches (case_id, ref_id, is_fraud, similarity) and summaries (case_id,
    summary). A case has one part, unless it has more than about ``most`` documents, findings and their evidence, or
    events; then the lists go on in further parts, all with the same head, so that no task holds more. A finding whose
    evidence is longer than that comes again with the rest. Every key is always there; missing lists are empty.
    """
    named = documents.select("doc_id", "filename").dropDuplicates(["doc_id"])
    piece = F.struct(F.col("filename").alias("document"), F.col("doc_id").alias("document_id"), "page", F.col("extracted").alias("text"), "description", "coordinates")
    # Evidence and findings are each dealt out by case once; all that follows keeps to that.
    proof = evidence.join(named, "doc_id", "left").where("case_id IS NOT NULL AND finding IS NOT NULL").repartition("case_id")
    place = F.row_number().over(Window.partitionBy("case_id", "finding").orderBy("doc_id", "page", "extracted", "description"))
    proof = proof.withColumn("place", place).withColumn("again", F.floor((F.col("place") - 1) / most).cast("int"))
    proof = proof.groupBy("case_id", F.col("finding").alias("seq"), "again").agg(F.array_sort(F.collect_list(F.struct("place", piece.alias("item")))).alias("all"))
    proof = proof.select("case_id", "seq", "again", F.transform("all", lambda x: x["item"]).alias("evidence"))
    found = findings.select("case_id", "seq", "name", "severity", "description", "layer_source", F.lit(True).alias("is_finding")).repartition("case_id")
    found = found.unionByName(proof.withColumn("is_finding", F.lit(False)), allowMissingColumns=True)
    # A finding comes once for each list of its evidence, which lies before it.
    found = found.withColumn("last", F.coalesce(F.max("again").over(Window.partitionBy("case_id", "seq")), F.lit(0)))
    found = found.withColumn("again", F.explode(F.when(F.col("is_finding"), F.sequence(F.lit(0), "last")).otherwise(F.array("again")))).drop("last")
    own = F.last("evidence", ignorenulls=True).over(Window.partitionBy("case_id", "seq", "again").orderBy("is_finding").rowsBetween(Window.unboundedPreceding, 0))
    found = found.withColumn("evidence", own).where("is_finding")
    order = ["seq", "name", "severity", "layer_source", "description", "again"]
    found = in_parts(found, order, 1 + F.coalesce(F.size("evidence"), F.lit(0)), most)
    empty = F.array().cast(proof.schema["evidence"].dataType)
    item = F.struct(F.col("seq").alias("id"), "name", "severity", "description", "layer_source", F.coalesce("evidence", empty).alias("evidence"))
    sections = {
        "documents": (in_parts(documents, ["doc_id"], F.lit(1), most), ["doc_id"], F.struct(F.col("doc_id").alias("id"), "filename", "classification", "file_type", F.col("text").alias("extracted_text"), F.col("entities").alias("entities_json"), F.col("metadata").alias("metadata_json"))),
        "findings": (found, order, item),
        "timeline": (in_parts(events, ["ts", "event_id"], F.lit(1), most), ["ts", "event_id"], F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("event_type").alias("type"), "message")),
    }
    # All lists of a part are made at once, of items that lie by case already: nothing is computed again to find out which
    # parts there are, and lists are not dealt out by part and then by case again.
    items = None
    for name, (rows, keys, one) in sections.items():
        some = rows.select("case_id", "part", F.struct(*keys, one.alias("item")).alias(name))
        items = some if items is None else items.unionByName(some, allowMissingColumns=True)
    rows = items.groupBy("case_id", "part").agg(*(F.transform(F.array_sort(F.collect_list(n)), lambda x: x["item"]).alias(n) for n in sections))
    types = {n: rows.schema[n].dataType for n in sections}
    alike = matches.select("case_id", F.struct(F.col("similarity").alias("similarity_score"), "ref_id", "is_fraud").alias("dataset_similarity"))
    head = cases.join(alike, "case_id", "left").join(summaries.select("case_id", F.col("summary").alias("ai_summary")), "case_id", "left")
    # A case that the others name but that is not there has no report.
    rows = head.join(rows, "case_id", "left").withColumn("part", F.coalesce("part", F.lit(0)))
    body = F.struct(
        F.col("case_id").alias("investigation_id"), "context", "status", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), F.struct("trust_score", label(F.col("recommendation")).alias("recommendation")).alias("scores"), "ai_summary", "dataset_similarity",
        *(F.coalesce(n, F.array().cast(types[n])).alias(n) for n in sections),
    )
    return rows.select("case_id", "part", F.to_json(body, {"ignoreNullFields": "false"}).alias("report"))


#: Headings and empty lists of a case's prompt.
PROMPT = {
    "metrics": "INVESTIGATION FORENSIC METRICS:", "documents": "DOCUMENT FILES & EXTRACTED METADATA:", "findings": "DETAILED FORENSIC FINDINGS & EVIDENCE ATTACHED:", "matches": "DATASET SIMILARITY & CASE-BASED REASONING (CBR) MATCHES:",
    "no documents": "No documents.", "no findings": "No findings detected.", "no evidence": "  - No specific coordinate evidence.", "no matches": "  No baseline matches.",
}


def prompts(cases: DataFrame, documents: DataFrame, findings: DataFrame, evidence: DataFrame, matches: DataFrame, most: int = ITEMS) -> DataFrame:
    """(case_id, part, prompt): the text on a case for a model that sums it up: figures, documents, findings with evidence, matches.

    cases (case_id, context, trust_score, recommendation), documents (case_id, doc_id, filename, classification,
    ocr_confidence, producer, creator), findings (case_id, seq, name, severity, description, layer_source), evidence
    (case_id, finding, doc_id, page, extracted, description), matches (case_id, ref_id, is_fraud, similarity, rank). One
    row of ``cases`` for each case. A text of over ``most`` entries goes on in further parts; what is missing reads
    None, and evidence of a finding that is not there is left out.
    """
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    text = lambda *parts: F.concat(*[shown(p[1:]) if p.startswith("@") else F.lit(p) for p in parts])
    sections = {1: "documents", 3: "findings", 5: "matches"}

    def entry(rows: DataFrame, section: int, line: Column, **order: Column | str) -> DataFrame:
        keys = [F.coalesce(F.expr(order[k]) if k in order else F.lit(0), F.lit(0)).cast("long").alias(k) for k in ("at", "below", "place", "page")]
        return rows.select("case_id", F.lit(section).alias("section"), *keys, line.alias("line"))

    def heading(section: int, name: str) -> DataFrame:
        return entry(heads, section, F.concat(F.lit("\n" + PROMPT[name]), F.when(F.col("n_" + name).isNull(), "\n" + PROMPT["no " + name]).otherwise("")))

    pieces = evidence.groupBy("case_id", F.col("finding").alias("seq")).agg(F.count("*").alias("pieces"))
    found = findings.join(pieces, ["case_id", "seq"], "left")
    bare = F.when(F.col("pieces").isNull(), "\n" + PROMPT["no evidence"]).otherwise("")
    proof = evidence.join(documents.select("doc_id", "filename").dropDuplicates(["doc_id"]), "doc_id", "left").join(findings.select("case_id", F.col("seq").alias("finding")).distinct(), ["case_id", "finding"], "left_semi")
    lines = [
        entry(cases, 0, text(PROMPT["metrics"] + "\n- Case Context: ", "@context", "\n- Trust Score: ", "@trust_score", "/100\n- Rule Engine Suggestion: ", "@recommendation")),
        entry(cases, 1, F.lit("\n" + PROMPT["documents"])),
        entry(documents, 2, text("- File: ", "@filename", "\n  Type: ", "@classification", "\n  OCR Accuracy: ", "@ocr_confidence", "%\n  Producer: ", "@producer", "\n  Creator/Editor: ", "@creator"), at="doc_id"),
        entry(cases, 3, F.lit("\n" + PROMPT["findings"])),
        entry(found, 4, F.concat(text("- Finding Name: ", "@name", "\n  Severity: ", "@severity", "\n  Source: ", "@layer_source", "\n  Description: ", "@description", "\n  Evidence Items:"), bare), at="seq"),
        entry(proof, 4, text("  - Evidence in ", "@filename", " on page ", "@page", ": ", "@description", " [Text: '", "@extracted", "']"), at="finding", below="1", place="doc_id", page="page"),
        entry(cases, 5, F.lit("\n" + PROMPT["matches"])),
        entry(matches, 6, F.concat(F.lit("  * "), shown("ref_id"), F.lit(" ("), shown("similarity"), F.lit("% match) - Label: "), F.when(F.col("is_fraud"), "fraud").otherwise("genuine")), at="int(is_fraud)", below="rank"),
    ]
    rows = lines[0]
    for one in lines[1:]:
        rows = rows.unionByName(one)
    order = ["section", "at", "below", "place", "page", "line"]
    rows = rows.join(cases.select("case_id").distinct(), "case_id", "left_semi")
    # A heading that no entry of its section follows.
    following = F.coalesce(F.lead("section").over(Window.partitionBy("case_id").orderBy(*order)), F.lit(0))
    for section, name in sections.items():
        rows = rows.withColumn(f"no_{name}", (F.col("section") == section) & (following != section + 1))
    rows = in_parts(rows, order, F.lit(1), most)
    for name in sections.values():
        rows = rows.withColumn("line", F.when(F.col(f"no_{name}"), F.concat("line", F.lit("\n" + PROMPT[f"no {name}"]))).otherwise(F.col("line")))
    grouped = rows.groupBy("case_id", "part").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("all"))
    return grouped.select("case_id", "part", F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("prompt"))
