from __future__ import annotations

import duckdb
import pytest

from caselight.llm import mixing as M

from .cases import documents, no_documents

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("mix", [M.Mix(), M.Mix(share=2.0), M.Mix(share=0.05, epochs=3), M.Mix(share=1.4, epochs=2, sources={"src0": 9}, langs={}), M.Mix(share=0.0)])
def test_against_sql(spark, mix):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    found = con.execute(M.oracle(mix))
    names = [d[0] for d in found.description]
    df = M.mix_tokens(spark.read.parquet(f"{DATA}/documents.parquet"), mix)
    assert sorted(tuple(r) for r in df.collect()) == sorted(tuple(r[names.index(c)] for c in df.columns) for r in found.fetchall())


def test_budget_is_kept_and_shortages_go_to_siblings(spark):
    rows = [(k, "w " * 10, "en", s) for k, s in enumerate(["src0"] * 2 + ["src4"] * 50 + ["src1"] * 100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    mix = M.Mix(domains={"domain0": 1, "domain1": 1}, langs={}, share=0.5, epochs=1)
    given = {r.source: r.n for r in M.mix_tokens(df, mix).groupBy("source").agg({"take_tokens": "sum"}).withColumnRenamed("sum(take_tokens)", "n").collect()}
    assert given == {"src0": 20, "src4": 360, "src1": 380}  # src0 has 20 only: its sibling takes the rest of their domain's half


def test_awkward_rows(spark):
    rows = M.mix_tokens(documents(spark), M.Mix(share=1.0, epochs=2)).collect()
    assert rows and {r.doc_id for r in rows}.isdisjoint({4, 5, 6})
    assert all(0 < r.take_tokens <= r.n_tokens for r in rows)
    assert M.mix_tokens(no_documents(spark)).count() == 0
    kept = M.chosen(documents(spark), M.Mix(share=1.0, epochs=1))
    assert kept.columns == documents(spark).columns and kept.count() > 0
    assert M.chosen(no_documents(spark), M.Mix()).count() == 0


def test_no_python_in_the_plan(spark):
    plan = M.mix_tokens(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
