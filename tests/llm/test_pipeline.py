from __future__ import annotations

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
from caselight.llm.queries import QUERIES  # noqa: E402

from .test_jaccard import brute  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


def test_pipeline(spark, tmp_path, monkeypatch):
    from caselight.llm import toxicity

    monkeypatch.setattr(toxicity, "STEPS", 30)
    monkeypatch.setattr(toxicity, "SPELL_STEPS", 30)
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(pipeline.STAGES):
        out = stage(spark, docs, DATA)
        out.write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        if k + 1 < len(pipeline.STAGES):
            assert after.columns == columns and after.count() <= before
        if name == "n-gram Jaccard join":
            groups = {i: c for i, _, c in brute([(r.doc_id, r.text) for r in docs.collect()], pipeline.NEAR)}
            assert sorted(r.doc_id for r in after.collect()) == sorted({*groups.values()})
        docs, before = after, after.count()
    assert {"doc_id", "sequence_id", "offset"} <= set(docs.columns) and before
