"""Documents of one case held against each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.similarity import abbreviation, jaro_winkler, last_word, token_set_ratio
from ..functions.text import EMPLOYER_WORDS, normal_name, normal_words

MATCH, NAMES_DIFFER, EMPLOYERS_DIFFER, PAY_DIFFERS = 0.92, 0.85, 0.75, 100


#: Rows of a case up to which they meet in one cell; a larger case is cut into blocks of about so many.
BLOCK = 2_000


def in_blocks(rows: DataFrame, keys: list[str], block: int | None = None) -> DataFrame:
    """``rows`` with ``block``, ``lo`` and ``hi``: once for each cell of two blocks of its case that a row takes part in.

    Every two blocks of a case meet in one cell, so no task holds a case, and pairs of a small one are in one cell only.
    """
    block = block or BLOCK
    large = rows.groupBy("case_id").agg(F.count("*").alias("n")).where(F.col("n") > block).select("case_id", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    cut = rows.join(large, "case_id", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    cut = cut.withColumn("block", F.pmod(F.xxhash64(*keys), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return cut.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("blocks", "other")


def met(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one cell that meet there: of its two blocks, one row of each."""
    joined = a.withColumnRenamed("block", "block_a").join(b.withColumnRenamed("block", "block_b"), ["case_id", "lo", "hi"])
    return joined.where((F.col("lo") == F.col("hi")) | (F.col("block_a") != F.col("block_b"))).drop("lo", "hi", "block_a", "block_b")


def _side(rows: DataFrame, columns: list[str], side: str, *others: str) -> DataFrame:
    return rows.select(*others, *[F.col(c).alias(f"{c.removesuffix('_id')}_{side}") for c in columns])


CELL = ("case_id", "block", "lo", "hi")


def pairs_in_case(docs: DataFrame, columns: list[str]) -> DataFrame:
    """(case_id, doc_a, doc_b, <column>_a, <column>_b): pairs of a case in the order of seq, of documents that have all columns."""
    own = in_blocks(docs.dropna(subset=columns).select("case_id", "seq", "doc_id", *columns), ["doc_id", "seq"])
    a, b = (_side(own, ["seq", "doc_id", *columns], side, *CELL) for side in "ab")
    return met(a, b).where("seq_a < seq_b").drop("seq_a", "seq_b")


def pairs_of_values(docs: DataFrame, column: str) -> DataFrame:
    """(case_id, <column>_a, <column>_b): the distinct values of the pairs of a case, without making those pairs."""
    values = docs.dropna(subset=[column]).groupBy("case_id", column).agg(F.min("seq").alias("first"), F.max("seq").alias("last"))
    own = in_blocks(values, [column])
    return met(_side(own, [column, "first"], "a", *CELL), _side(own, [column, "last"], "b", *CELL)).where("first_a < last_b").drop("first_a", "last_b")


def documents_of(values: DataFrame, docs: DataFrame, column: str) -> DataFrame:
    """Pairs of values of a case as pairs (doc_a, doc_b) of its documents in the order of seq."""
    own = docs.dropna(subset=[column])
    for side in "ab":
        values = values.join(_side(own, ["doc_id", "seq", column], side, "case_id"), ["case_id", f"{column}_{side}"])
    return values.where("seq_a < seq_b")


def name_scores(pairs: DataFrame) -> DataFrame:
    """(name_a, name_b, similarity) of distinct pairs: normal forms by Jaro-Winkler, and below a match abbreviations either way."""
    distinct = pairs.select("name_a", "name_b").distinct()
    scored = distinct.withColumn("jw", jaro_winkler(normal_name(F.col("name_a")), normal_name(F.col("name_b")))).withColumn("surnames", jaro_winkler(last_word(F.col("name_a")), last_word(F.col("name_b"))))
    short = F.greatest(abbreviation(F.col("name_a"), F.col("name_b"), F.col("surnames")), abbreviation(F.col("name_b"), F.col("name_a"), F.col("surnames")))
    return scored.select("name_a", "name_b", F.when(F.col("jw") < MATCH, F.greatest("jw", short)).otherwise(F.col("jw")).alias("similarity"))


def finding(name: str, severity: str) -> list[Column]:
    return [F.lit("CROSS_DOC").alias("layer_source"), F.lit(name).alias("name"), F.lit(severity).alias("severity")]


def name_mismatches(docs: DataFrame) -> DataFrame:
    """A finding for each pair of documents of a case whose names are too unlike."""
    pairs = pairs_of_values(docs, "name")
    unlike = pairs.join(name_scores(pairs), ["name_a", "name_b"]).where(F.col("similarity") < NAMES_DIFFER)
    return documents_of(unlike, docs, "name").select("case_id", "doc_a", "doc_b", *finding("Identity Name Mismatch", "HIGH"), F.round("similarity", 6).alias("score"))


def employer_mismatches(docs: DataFrame) -> DataFrame:
    """A finding for each pair of documents of a case whose employers are too unlike."""
    pairs = pairs_of_values(docs, "employer")
    score = token_set_ratio(normal_words(F.col("employer_a"), EMPLOYER_WORDS), normal_words(F.col("employer_b"), EMPLOYER_WORDS))
    scores = pairs.select("employer_a", "employer_b").distinct().withColumn("similarity", score)
    unlike = pairs.join(scores, ["employer_a", "employer_b"]).where(F.col("similarity") < EMPLOYERS_DIFFER)
    return documents_of(unlike, docs, "employer").select("case_id", "doc_a", "doc_b", *finding("Employer Mismatch", "MEDIUM"), F.round("similarity", 6).alias("score"))


def id_mismatches(docs: DataFrame) -> DataFrame:
    """A row per document of each case that shows more than one PAN."""
    many = docs.groupBy("case_id").agg(F.countDistinct("pan").alias("n_ids")).where("n_ids > 1")
    return docs.join(many, "case_id").select("case_id", "doc_id", "n_ids", *finding("PAN Identifier Mismatch", "HIGH"))


def first_two(docs: DataFrame, value: str) -> DataFrame:
    """(case_id, first, second) of the first two rows of a case that have a value, in the order of seq."""
    rank = F.row_number().over(Window.partitionBy("case_id").orderBy("seq", "doc_id"))
    two = docs.where(F.col(value).isNotNull()).withColumn("rank", rank).where("rank <= 2")
    return two.groupBy("case_id").agg(F.max(F.when(F.col("rank") == 1, F.col(value))).alias("first"), F.max(F.when(F.col("rank") == 2, F.col(value))).alias("second"))


def pay_mismatches(slips: DataFrame) -> DataFrame:
    return first_two(slips, "salary").where(F.abs(F.col("first") - F.col("second")) > PAY_DIFFERS).select("case_id", "first", "second", *finding("Income Inconsistency", "HIGH"))


def with_enough(docs: DataFrame, least: int = 2) -> DataFrame:
    """Documents of cases that have at least so many."""
    return docs.join(docs.groupBy("case_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("case_id"), "case_id", "left_semi")


def reconciled_names(docs: DataFrame) -> DataFrame:
    """``docs`` with ``reconciled``: names like enough to the longest of their case (of equals the first) become it."""
    best = docs.where("name IS NOT NULL").groupBy("case_id").agg(F.max_by("name", F.struct(F.length("name"), -F.col("seq"), -F.col("doc_id"))).alias("best"))
    joined = docs.join(best, "case_id", "left")
    scores = name_scores(joined.where("name IS NOT NULL AND best IS NOT NULL").select(F.col("best").alias("name_a"), F.col("name").alias("name_b")))
    scored = joined.join(scores, (F.col("best") == F.col("name_a")) & (F.col("name") == F.col("name_b")), "left").drop("name_a", "name_b")
    return scored.withColumn("reconciled", F.when(F.col("similarity") >= NAMES_DIFFER, F.col("best")).otherwise(F.col("name"))).drop("best", "similarity")


def evidence(findings: DataFrame, places: DataFrame) -> DataFrame:
    """Each finding's search text with the first place (doc_id, pos, page, text) that holds it: page 1 and 0.8 where there is none."""
    hit = findings.join(places, "doc_id", "left").where(F.col("text").isNull() | F.lower("text").contains(F.lower("search")))
    first = hit.where("text IS NOT NULL").groupBy("doc_id", "search").agg(F.min_by("page", "pos").alias("page"))
    joined = findings.join(first, ["doc_id", "search"], "left")
    found = F.col("page").isNotNull()
    return joined.select("doc_id", "search", F.coalesce("page", F.lit(1)).alias("page"), F.when(found, 0.95).otherwise(0.8).alias("confidence"), F.concat(F.col("label"), F.lit(": "), F.col("search")).alias("description"))


def document_status(docs: DataFrame, findings: DataFrame) -> DataFrame:
    """FRAUD with a HIGH or CRITICAL finding, SUSPICIOUS with any, else GENUINE."""
    worst = findings.groupBy("doc_id").agg(F.bool_or(F.col("severity").isin("HIGH", "CRITICAL")).alias("bad"))
    return docs.join(worst, "doc_id", "left").select("doc_id", F.when(F.col("bad"), "FRAUD").when(F.col("bad").isNotNull(), "SUSPICIOUS").otherwise("GENUINE").alias("status"))
