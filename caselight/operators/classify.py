"""Document types by keyword patterns, scanned documents and second reading passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: Patterns of each document type; types in the order in which ties are decided.
TYPES = {
    "Bank Statement": [r"(?i)bank\s+statement", r"(?i)account\s+summary", r"(?i)account\s+statement", r"(?i)transaction\s+history", r"(?i)balance\s+as\s+of", r"(?i)deposits\s+and\s+credits", r"(?i)withdrawals\s+and\s+debits", r"(?i)opening\s+balance", r"(?i)closing\s+balance"],
    "Payslip": [r"(?i)payslip", r"(?i)salary\s+statement", r"(?i)earnings\s+and\s+deductions", r"(?i)pay\s+period", r"(?i)employee\s+id", r"(?i)net\s+pay"],
    "PAN": [r"(?i)permanent\s+account\s+number", r"(?i)income\s+tax\s+department", r"\b[A-Z]{5}[0-9]{4}[A-Z]{1}\b"],
    "Aadhaar": [r"(?i)aadhaar", r"(?i)unique\s+identification\s+authority", r"\b\d{4}\s\d{4}\s\d{4}\b"],
    "Utility Bill": [r"(?i)electricity\s+bill", r"(?i)water\s+bill", r"(?i)consumer\s+number", r"(?i)billing\s+period", r"(?i)previous\s+reading"],
    "Lease Agreement": [r"(?i)lease\s+agreement", r"(?i)rental\s+agreement", r"(?i)landlord", r"(?i)tenant", r"(?i)monthly\s+rent"],
    "Insurance Document": [r"(?i)insurance\s+policy", r"(?i)premium\s+amount", r"(?i)policy\s+number", r"(?i)sum\s+insured", r"(?i)coverage\s+period"],
}


def hits(text: Column, patterns: list[str]) -> Column:
    """How many of the patterns occur."""
    total = F.lit(0)
    for p in patterns:
        total = total + F.coalesce(text.rlike(p), F.lit(False)).cast("int")
    return total


def document_type(text: Column) -> Column:
    """The type most of whose patterns occur; Unknown stands behind every type that has any, before those that have none."""
    kinds = [F.struct(hits(text, p).alias("score"), F.lit(-k).alias("order"), F.lit(t).alias("name")) for k, (t, p) in enumerate(TYPES.items())]
    none = F.struct(F.lit(0).alias("score"), F.lit(1).alias("order"), F.lit("Unknown").alias("name"))
    return F.array_max(F.array(*kinds, none))["name"]  # named once, so that a plan holds each pattern once


def classify(docs: DataFrame) -> DataFrame:
    """``docs`` with ``classification``; no pattern or no text: Unknown."""
    return docs.withColumn("classification", document_type(F.col("text")))


def type_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, doc_type, score) for every document and type."""
    rows = F.array(*[F.struct(F.lit(t).alias("doc_type"), hits(F.col("text"), p).alias("score")) for t, p in TYPES.items()])
    return docs.select("doc_id", F.inline(rows))


def scanned(docs: DataFrame, images: tuple[str, ...] = ("png", "jpg", "jpeg", "bmp", "tiff")) -> DataFrame:
    """``docs`` (text, file_type) with ``is_scanned``: images, and files with under 30 characters of text."""
    return docs.withColumn("is_scanned", F.lower("file_type").isin(*images) | (F.length(F.trim(F.coalesce("text", F.lit("")))) < 30))


def second_pass_list(docs: DataFrame, retries: int = 3) -> DataFrame:
    """Scanned documents to read again: identity cards without an id, others read with a confidence under 60."""
    card = F.col("classification").isin("PAN", "Aadhaar")
    return docs.where(F.col("is_scanned") & F.lit(retries > 0) & F.when(card, F.col("id_number").isNull()).otherwise(F.col("ocr_confidence") < 60))


def merge_passes(first: DataFrame, second: DataFrame) -> DataFrame:
    """The second text where it is over 50 characters and brought the id of a card, or else is the longer one."""
    joined = first.join(second.select("doc_id", F.col("text").alias("text2"), F.col("id_number").alias("id2")), "doc_id", "left")
    card = F.col("classification").isin("PAN", "Aadhaar")
    better = (F.length("text2") > 50) & F.when(card, F.col("id2").isNotNull()).otherwise(F.length("text2") > F.length("text"))
    take = F.coalesce(better, F.lit(False))
    return joined.withColumn("used_second", take).withColumn("text", F.when(take, F.col("text2")).otherwise(F.col("text"))).drop("text2", "id2")


def ocr_confidence(words: DataFrame) -> DataFrame:
    """(doc_id, ocr_confidence): mean over words that have one; 100 if none has."""
    return words.groupBy("doc_id").agg(F.coalesce(F.avg(F.when(F.col("conf") != -1, F.col("conf"))), F.lit(100.0)).alias("ocr_confidence"))
