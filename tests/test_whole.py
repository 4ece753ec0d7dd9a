"""Queries over all words and documents."""

from __future__ import annotations

from caselight.operators import detectors
from caselight.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"


def test_no_document_or_word_is_left_out(spark):
    assert QUERIES["x5_all_documents"].run(spark, DATA).where("doc_id % 5 = 0").count()
    assert QUERIES["a14_odd_sizes"].run(spark, DATA).columns == ["doc_id", "size", "n", "main"]


def test_odd_size_of_a_document_above_50(spark):
    spans = spark.createDataFrame([(77, 10.0)] * 30 + [(77, 16.0)] + [(127, 16.0)] * 30, "doc_id long, size double")
    assert [tuple(r) for r in detectors.odd_sizes(spans).collect()] == [(77, 16.0, 1, 10.0)]
