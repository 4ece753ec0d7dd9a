from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from caselight.llm import components as cc, jaccard as J, shingles as S, trie as T, winnow as W

from .cases import document_rows, documents, no_documents


def sets_of(rows, like):
    out = {}
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        n = len(w)
        out.setdefault(doc_id, []).append({tuple(w[k : k + like.words]) for k in range(n - like.words + 1)} if n >= like.words else ({tuple(w)} if w else set()))
    return out


def brute(rows, like):
    """(doc_id, n_shingles, component) of every row, by all pairs."""
    sets = sets_of(rows, like)
    ids = sorted(i for i in sets if i is not None)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and any(x and y and like.den * len(x & y) >= like.num * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted((i if i is not None else -1, len(s), find(i) if i is not None else -1) for i, ss in sets.items() for s in ss)


def found(df):
    return sorted((r.doc_id if r.doc_id is not None else -1, r.n_shingles, r.component_id if r.component_id is not None else -1) for r in df.collect())


def family(seed: int, copies: int, edits: int, n: int = 90) -> list[str]:
    rng = random.Random(seed)
    base = [f"w{rng.randint(0, 500)}" for _ in range(n)]
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(n)] = f"e{rng.randint(0, 10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("like", [J.Likeness(), J.Likeness(5, 80, 100), J.Likeness(3, 70, 100), J.Likeness(2, 1, 2)])
def test_against_all_pairs(spark, like, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 8)
    passage = " ".join(f"p{k}" for k in range(60))
    texts = [t for s in range(4) for t in family(s, 12, 5)] + [passage + " " + t for t in family(9, 6, 40, 40)] + [" ".join(f"s{k}" for k in range(m)) for m in range(1, 30)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(J.jaccard_groups(df, like)) == brute(rows, like)


def test_shards_of_many_blocks_and_groups(spark, monkeypatch):
    """Documents over few words, which all meet in a few shards of many blocks, but link in several groups."""
    monkeypatch.setattr(J, "BLOCK", 6)
    like = J.Likeness(1, 80, 100)
    rng = random.Random(4)
    rows = [(k, " ".join(rng.sample([f"p{n}" for n in range(26)], rng.randint(20, 22)))) for k in range(70)]
    across = []
    monkeypatch.setattr(J, "_across", lambda *a, of=J._across: across.append(of(*a)) or across[0])
    want = brute(rows, like)
    assert found(J.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), like)) == want
    groups = sorted(sum(c == g for *_, c in want) for g in {c for *_, c in want})
    assert across and len(groups) > 3 and groups[-1] > 6


def test_awkward_rows(spark):
    rows = [(r[0], r[1]) for r in document_rows()]
    assert found(J.jaccard_groups(documents(spark))) == brute(rows, J.Likeness())
    assert J.jaccard_groups(no_documents(spark)).count() == 0


def test_repeated_ids_carry_links(spark):
    """Rows of one doc_id with different texts, each like another document: all are one component."""
    a, b = (family(s, 1, 0, 60)[0].split() for s in (21, 22))
    near = lambda w: " ".join([*w[:-1], "other"])
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, near(a)), (3, near(b)), (4, " ".join(a[:30] + b[:30])), (5, " ".join(b)), (9, near(b)), (9, "something else altogether here")]
    want = brute(rows, J.Likeness())
    assert found(J.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"))) == want
    assert {c for i, _, c in want if i in (1, 2, 3, 5, 9)} == {1}


def test_keep_first(spark):
    """One row of each group of linked texts stays, whatever ids repeat; other columns keep names and values."""
    a, b = (" ".join(family(s, 1, 0, 60)[0].split()) for s in (21, 22))
    rows = [(1, a, "1a", 1), (5, a, "5a", 2), (5, b, "5b", 3), (9, b + " more", "9b", 4), (7, a, "7a", 5), (7, a, "7a", 5), (8, "alone and single here", "8", 6), (8, "alone and single here", "8", 6), (None, a, "n", 7), (10, "", "e", 8), (10, "", "e", 9), (11, None, "e", 10), (12, "one", "w", 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string, document long")
    out = J.keep_first(df)
    assert out.columns == df.columns
    assert sorted(map(str, (tuple(r) for r in out.collect()))) == sorted(map(str, [rows[0], rows[2], rows[6], *rows[8:]]))
    assert J.keep_first(df.limit(0)).count() == 0 and J.keep_first(documents(spark)).columns == documents(spark).columns


def test_exact_edges_of_the_threshold(spark):
    like = J.Likeness(1, 85, 100)
    base = [f"w{k}" for k in range(100)]
    rows = [(0, " ".join(base)), (1, " ".join(base[:85])), (2, " ".join(base[:84])), (3, " ".join(base[:92] + [f"x{k}" for k in range(8)])), (4, " ".join(base[:91] + [f"y{k}" for k in range(9)]))]
    for pair in ([0, 1], [0, 2], [0, 3], [0, 4]):
        some = [rows[k] for k in pair]
        assert found(J.jaccard_groups(spark.createDataFrame(some, "doc_id long, text string"), like)) == brute(some, like)


def test_shingle_sets():
    rng = random.Random(1)
    texts = [None, "", " ", "a", "a b", " a b c", "a b c d", "A B c D\x0be\x1cf", "日本 Éa b c d", "a a a a a a a a", "x" * 300 + " y", "x" * 300 + " z" + " w" * 5]
    texts += ["".join(rng.choice("ab \t\n\x0b\x0c\r\x1cé") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    for words in (1, 4, 5):
        elements, bounds = S.shingle_sets(pa.array(texts), words)
        hashes, sets = {}, {}
        for k, s in enumerate(ss[0] for ss in sets_of(list(enumerate(texts)), J.Likeness(words)).values()):
            got = elements[bounds[k] : bounds[k + 1]]
            assert len(got) == len(s) and (got[1:] > got[:-1]).all()
            assert hashes.setdefault(frozenset(s), got.tobytes()) == got.tobytes() and sets.setdefault(got.tobytes(), s) == s
        middle = S.shingle_sets(pa.array(texts).slice(5, 2), words)[0]
        assert np.array_equal(middle, elements[bounds[5] : bounds[7]])


@pytest.mark.parametrize("batch", [40, 1 << 20])
def test_lone_shingles(spark, monkeypatch, batch):
    monkeypatch.setattr(W, "BATCH_SHINGLES", batch)
    monkeypatch.setattr(W, "RANGE_BYTES", 1000)
    rows = [(r[0], r[1]) for r in document_rows()] + list(enumerate(family(3, 9, 6), 100))
    got = W.describe(spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id").sortWithinPartitions("doc_id", "text"), 4).collect()
    sets = sets_of([(k, t) for k, (_, t) in enumerate(rows)], J.Likeness())
    count = {}
    for (s,) in sets.values():
        for x in s:
            count[x] = count.get(x, 0) + 1
    want = sorted((rows[k][0] or -1, len(s), sum(count[x] == 1 for x in s)) for k, (s,) in sets.items())
    assert sorted((r.doc_id or -1, r.n_shingles, r.lone) for r in got) == want


def test_prefix_tree(monkeypatch):
    """The join of a shard links what all pairs link; subtrees are cut, and cut subtrees hold no link."""
    rng = np.random.default_rng(5)
    monkeypatch.setattr(T, "STEP", 7)
    monkeypatch.setattr(T, "PROBE_BYTES", 40_000)
    for like in (J.Likeness(), J.Likeness(4, 60, 100)):
        sets = [np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64)) for _ in range(60)]
        sets += [np.delete(s, rng.integers(0, len(s))) for s in sets if len(s) > 1]
        sizes = np.array([len(s) + int(rng.integers(0, 3)) for s in sets])
        linked = lambda x, y: like.den * len(np.intersect1d(sets[x], sets[y])) >= like.num * (sizes[x] + sizes[y] - len(np.intersect1d(sets[x], sets[y])))
        want = groups_of(range(len(sets)), [(x, y) for x in range(len(sets)) for y in range(x) if linked(x, y)])
        got = T.join(sets, sizes, like)
        assert all(linked(x, y) for x, y in got) and groups_of(range(len(sets)), got) == want
        leaf = np.arange(len(sets)) % 2 == 0
        got = T.join(sets, sizes, like, leaf=leaf, probe=~leaf)
        pairs = [(x, y) for x in range(0, len(sets), 2) for y in range(1, len(sets), 2) if linked(x, y)]
        assert set(got) <= set(pairs) and groups_of(range(len(sets)), got) == groups_of(range(len(sets)), pairs)


def groups_of(nodes, edges):
    label = {n: n for n in nodes}
    for x, y in edges:
        old, new = label[y], label[x]
        label = {n: new if c == old else c for n, c in label.items()}
    groups = {}
    for n, c in label.items():
        groups.setdefault(c, set()).add(n)
    return sorted(map(sorted, groups.values()))


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 9), (9, 8), (5, 5), (None, 3), (20, 30), (30, 20), *[(100 + k, 101 + k) for k in range(40)]]
    rows = {r.node: r.component for r in cc.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert rows == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, 10: 8, 20: 20, 30: 20, **{100 + k: 100 for k in range(41)}}
    assert cc.components(spark.createDataFrame([], "u long, v long")).count() == 0
