"""The corpus pipeline: reject poor documents, then toxic ones, keep one of each group of near copies, mix, pack.

Every stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept, and returns a DataFrame that is
written as Parquet and read again as the next stage's ``docs``. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caselight.llm.jaccard import Likeness, keep_first
from caselight.llm.mixing import Mix, chosen
from caselight.llm.packing import pack
from caselight.llm.quality import keep_quality
from caselight.llm.shared import materialise, read_table
from caselight.llm.toxicity import keep_clean

#: Near copies: five-word shingles, similarity of 0.8 or more.
NEAR = Likeness(words=5, num=80, den=100)
#: One epoch at most: a document comes once; budgets are shared out by the same weights as in the mixing query.
MIX = Mix(share=0.9, epochs=1)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier does not reject; nulls, ties and repeated rows as ``keep_quality`` says."""
    return keep_quality(docs, read_table(spark, sf_dir, "labels"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not toxic; nulls, ties and repeated rows as ``keep_clean`` says."""
    return keep_clean(docs, read_table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id stays; rows without text or doc_id all stay."""
    return keep_first(docs, NEAR)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of which the mixture takes anything; those without words go. Nulls, ties and repeated rows as ``chosen`` says."""
    return chosen(docs, MIX)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows in sequences; nulls, ties and repeated rows as ``pack`` says."""
    return pack(docs)


STAGES = [("quality classifier", quality), ("toxicity", toxicity), ("n-gram Jaccard join", near_copies), ("mixing sources to target weights", mixing), ("packing", packing)]

#: SQL can express neither the trained models nor the tokenizer; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        docs = out if k + 1 == len(STAGES) else materialise(out, f"pipeline-{k}")
    return docs
