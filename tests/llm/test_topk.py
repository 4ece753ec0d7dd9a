from __future__ import annotations

import math
import tracemalloc

import numpy as np
import pytest

from caselight.llm import topk

SCHEMA = "vec_id long, embedding array<float>, q string, norm string, block string, score string"


def brute(rows, asked, k):
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for i, q in good:
        if asked(i):
            scored = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in good if j != i)
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("block", [7, 1000])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    monkeypatch.setattr(topk, "HEAD_ROWS", 12)
    rng = np.random.default_rng(1)
    rows = [(k, (rng.standard_normal(6) * rng.choice([0.1, 1, 5])).tolist()) for k in range(60)]
    rows += [(100 + k, [0.5] * 6) for k in range(20)] + [(200, None), (201, [1.0, None]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (None, [1.0] * 6), (204, [0.0] * 6), (205, [1.0, 2.0]), (206, [])]
    df = spark.createDataFrame([(*r, "a", "b", "c", "d") for r in rows], SCHEMA)
    found = sorted(tuple(r) for r in topk.top_inner_products(df, df.where("vec_id % 5 = 0"), 4).collect())
    assert found == brute(rows, lambda i: i % 5 == 0, 4)


def test_few_and_none(spark):
    two = spark.createDataFrame([(0, [1.0], "", "", "", ""), (1, [2.0], "", "", "", "")], SCHEMA)
    assert [tuple(r) for r in topk.top_inner_products(two, two.where("vec_id = 0"), 10).collect()] == [(0, 1, 1, 1024 * 2048)]
    none = spark.createDataFrame([], SCHEMA)
    assert topk.top_inner_products(none, none, 10).count() == 0


def test_large_numbers_stay_exact(spark):
    df = spark.createDataFrame([(0, [2.0**20, 1.0]), (1, [2.0**20, 1.0]), (2, [2.0**20, 2.0])], "vec_id long, embedding array<double>")
    rows = topk.top_inner_products(df, df.where("vec_id = 0"), 2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in rows] == [(2, 2**60 + 2 * 2**20), (1, 2**60 + 2**20)]


def test_memory_is_bounded_where_bounds_leave_nothing_out():
    rng = np.random.default_rng(3)
    q, c = (np.floor(1024 * rng.standard_normal((n, 64))) for n in (512, 2048))
    c[1024:] = c[:1024]
    names, others = np.arange(512), np.arange(2048)[::-1] + 10_000
    tracemalloc.start()
    found = topk.search(q, names, np.full(512, -np.inf), c, others, np.eye(64), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # vectors of all pairs of a slice side by side: 268 MB a side
    score = (q @ c.T).astype(np.int64)
    want = [(i, int(others[j]), int(score[i, j])) for i in range(512) for j in np.lexsort((others, -score[i]))[:5]]
    assert sorted(found) == sorted(want)
    few = topk.search(2.0**14 * q[:40], names[:40], np.full(40, -np.inf), 2.0**14 * c, others, np.eye(64), 5)  # beyond the whole numbers of a double
    assert sorted(few) == sorted((i, j, s * 2**28) for i, j, s in want if i < 40)
