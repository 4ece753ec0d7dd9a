"""Field terms in texts and where they stand on the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.money import MONTH

#: Patterns of terms, the first that fits tells the category.
TERMS = [
    ("Account Number", r"\b\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}\b"),
    ("Account Number", r"\b\d{9,12}\b"),
    ("Date", rf"\b{MONTH}\s+\d{{1,2}},?\s+\d{{4}}\b"),
    ("Date", r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"),
    ("Amount", r"\$[\d,]+\.\d{2}"),
    ("Name/Address", r"\b[A-Z][a-z]+(?: [A-Z][a-z]+){1,3}\b"),
]


def field_terms(docs: DataFrame) -> DataFrame:
    """(doc_id, term, category): distinct terms, each with the first category that it fits; names under 40 characters."""

    def of_kind(order: int, category: str, pattern: str):
        return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(0)), lambda x: F.struct(x.alias("term"), F.lit(order).alias("order"), F.lit(category).alias("category")))

    found = [of_kind(k, c, p) for k, (c, p) in enumerate(TERMS)]
    rows = docs.select("doc_id", F.inline(F.concat(*found))).where((F.col("category") != "Name/Address") | (F.length("term") < 40))
    return rows.groupBy("doc_id", "term").agg(F.min_by("category", "order").alias("category"))


def term_places(terms: DataFrame, words: DataFrame, most_amounts: int = 15) -> DataFrame:
    """(doc_id, term, category, page, x, y): where terms of one word stand; the first places of amounts only; one per rounded place."""
    hits = terms.join(words, (terms["doc_id"] == words["doc_id"]) & (terms["term"] == words["word"])).select(terms["doc_id"], "term", "category", "pos", "page", F.round("x0").cast("int").alias("x"), F.round("y0").cast("int").alias("y"))
    first = hits.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "category").orderBy("pos", "term"))).where((F.col("category") != "Amount") | (F.col("rank") <= most_amounts))
    one = first.withColumn("again", F.row_number().over(Window.partitionBy("doc_id", "page", "x", "y").orderBy("pos", "term"))).where("again = 1")
    return one.select("doc_id", "term", "category", "page", "x", "y")


#: Words of the longest term that is looked for: names have up to four, as have account numbers in groups.
LONGEST = 4
#: Words of terms that are broadcast at most, so that the words of documents need not be shuffled; more are left to the planner.
BROADCAST_ROWS = 1_000_000
#: Marks that may stand before and after a term.
MARKS = "[.,;:!?\"()]"


def without_marks(text: Column) -> Column:
    return F.regexp_replace(text, f"^{MARKS}+|{MARKS}+$", "")


def run_places(terms: DataFrame, words: DataFrame, most_amounts: int = 15) -> DataFrame:
    """(doc_id, term, category, page, x, y, width, height): all places of terms (doc_id, term, category) of up to ``LONGEST`` words.

    words: (doc_id, pos, word, page, x0, y0, x1, y1), boxes in percent of the page. A term stands where a run of
    consecutive words of one page, without marks around it, is the term; its box unites those of the run. Words that no
    term of their document has go first; the others bring those after them along and meet the terms that begin with them. Of amounts the first places of a document
    count; of places that are equal when rounded the first stays, others before amounts. Nulls: words and terms that are
    null have no places. Positions count all words, without gaps.
    """
    parts = F.split("term", " ")
    wanted = terms.select("doc_id", "term", "category", without_marks(parts[0]).alias("key"), F.size(parts).alias("n")).where(F.col("n") <= LONGEST)
    tokens = terms.where(F.size(parts) <= LONGEST).select("doc_id", F.explode(F.transform(parts, without_marks)).alias("key")).distinct()
    if tokens.count() <= BROADCAST_ROWS:
        tokens = F.broadcast(tokens)
    # Only words that some term of their document has go any further.
    some = words.withColumn("key", without_marks(F.col("word"))).join(tokens, ["doc_id", "key"], "left_semi")
    after = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(0, LONGEST - 1)
    starts = some.select("doc_id", "pos", F.collect_list(F.struct("pos", "word", "page", "x0", "y0", "x1", "y1")).over(after).alias("run"), "key")
    run = F.slice("run", F.lit(1), F.col("n"))
    part = lambda name: F.transform("run", lambda w: w[name])
    hits = starts.join(wanted, ["doc_id", "key"]).where(F.size("run") >= F.col("n")).withColumn("run", run).where(F.array_max(part("pos")) == F.col("pos") + F.col("n") - 1)
    hits = hits.where((without_marks(F.array_join(part("word"), " ")) == F.col("term")) & (F.array_min(part("page")) == F.array_max(part("page"))))
    x, y = F.array_min(part("x0")), F.array_min(part("y0"))
    hits = hits.select("doc_id", "term", "category", "pos", F.array_min(part("page")).alias("page"), x.alias("x"), y.alias("y"), (F.array_max(part("x1")) - x).alias("width"), (F.array_max(part("y1")) - y).alias("height"))
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id", "category").orderBy("page", "pos", "term"))).where((F.col("category") != "Amount") | (F.col("rank") <= most_amounts))
    again = F.row_number().over(Window.partitionBy("doc_id", "page", F.round("x"), F.round("y")).orderBy(F.col("category") == "Amount", "pos", "term"))
    return ranked.withColumn("again", again).where("again = 1").drop("pos", "rank", "again")


def field_regions(places: DataFrame) -> DataFrame:
    """(doc_id, page, x, y, width, height, severity, signal_name, signal_id, text): every place, to be marked on its page."""
    return places.select("doc_id", "page", "x", "y", "width", "height", F.lit("high").alias("severity"), F.col("category").alias("signal_name"), F.lit("forensic_field").alias("signal_id"), F.col("term").alias("text"))


def regions(places: DataFrame, signals: DataFrame) -> DataFrame:
    """(doc_id, page, x, y, severity, signal, text): what to mark on a page."""
    return places.join(signals, "category").select("doc_id", "page", "x", "y", "severity", "signal", F.col("term").alias("text"))
