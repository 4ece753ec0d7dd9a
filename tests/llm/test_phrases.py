from __future__ import annotations

import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest

from caselight.llm import phrases
from caselight.llm.phrases import Mining

from .cases import DOCUMENTS, documents, no_documents, words


def brute(docs, mining):
    """All rows by plain counting."""
    counts, totals = Counter(), Counter()
    for d in docs:
        lang = "und" if d.lang is None else d.lang
        for piece in re.split("[.,;:!?\n-\r]", "".join(c.lower() if "A" <= c <= "Z" else c for c in d.text or "")):
            w = re.findall("[^ \t]+", piece)
            totals[lang] += len(w)
            counts.update((lang, tuple(w[i : i + k])) for k in range(1, mining.longest + 1) for i in range(len(w) - k + 1))
    out = {}
    for (lang, p), a in counts.items():
        if len(p) > 1 and a >= mining.least:
            cuts = [(Fraction(1000 * a * totals[lang], counts[lang, p[:k]] * counts[lang, p[k:]]).__floor__(), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out[lang, p] = (a, counts[lang, p[:k]], counts[lang, p[k:]], totals[lang], score)
    kept = {}
    for (lang, p), v in out.items():
        if not any(o == lang and len(q) > len(p) and x[0] >= v[0] and any(q[i : i + len(p)] == p for i in range(len(q))) for (o, q), x in out.items()):
            kept.setdefault(lang, []).append((-v[4], -v[0], " ".join(p).encode(), v))
    return {(lang, k, x[2].decode(), *x[3]) for lang, rows in kept.items() for k, x in enumerate(sorted(rows)[: mining.top], 1)}


def table(spark, rows):
    return spark.createDataFrame([(k, t, lang, "s", 1, "x", 1, 2, 0.5, "i", "k", 3, "l", "m", 0.1, 0.2) for k, (t, lang) in enumerate(rows)], DOCUMENTS)


def corpus(spark):
    rng = np.random.default_rng(3)
    vocabulary = [w for w in words(5, 60).split() if w] + ["É", "日", "Ñandú", "x\x00y", "\x1c"]
    fixed = ["New york city", "a a a a a a", "of the", "of the people"]
    rows = []
    for k in range(120):
        parts = [fixed[rng.integers(len(fixed))] if rng.random() < 0.3 else vocabulary[min(int(rng.exponential(8)), len(vocabulary) - 1)] for _ in range(rng.integers(0, 120))]
        text = "".join(p + [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r"][rng.integers(9)] for p in parts)
        rows.append((text, ["en", "de", None][k % 3 if k > 60 else 0]))
    return table(spark, rows)


@pytest.mark.parametrize(("least", "top"), [(20, 2000), (5, 7)])
def test_all_phrases(spark, monkeypatch, least, top):
    monkeypatch.setattr(phrases, "SLACK", 1)
    mining = Mining(least=least, top=top)
    docs = corpus(spark).repartition(3)
    found = [tuple(r) for r in phrases.mine_phrases(docs, mining).collect()]
    assert len(found) == len(set(found)) and set(found) == brute(docs.collect(), mining) and found


@pytest.mark.parametrize("held", [600_000, 40])
def test_a_task_adds_up_what_it_counts(spark, monkeypatch, held):
    monkeypatch.setattr(phrases, "HELD_ROWS", held)
    monkeypatch.setattr("caselight.llm.bpe.SLICE_ROWS", 2)
    sent = []
    frame = type(spark.range(0))
    through = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda df, f, schema, *more: through(df, f, schema, *more) if schema != phrases.COUNTED else sent.append(f) or through(df, f, schema, *more))
    mining, docs = Mining(least=5, top=50), corpus(spark).coalesce(1)
    assert {tuple(r) for r in phrases.mine_phrases(docs, mining).collect()} == brute(docs.collect(), mining)
    batch = pa.RecordBatch.from_pylist([{"text": r.text, "lang": r.lang} for r in docs.collect()], pa.schema([("text", pa.string()), ("lang", pa.string())]))
    rows = [(r["lang"], r["phrase"], r["words"]) for b in sent[0](iter([batch])) for r in b.to_pylist()]
    assert (len(rows) == len(set(rows))) == (held > 40) and len(set(rows)) > 100


def test_words_of_a_slice():
    batch = pa.RecordBatch.from_pylist([{"text": f"Ab{k} cd. É {k} " * (k % 7), "lang": "en"} for k in range(200)])
    for at in (0, 2, 100):
        some, alone = phrases.words_of(batch.slice(at, 5)), phrases.words_of(pa.RecordBatch.from_pylist(batch.slice(at, 5).to_pylist()))
        assert some.names.take(pa.array(some.code)).to_pylist() == alone.names.take(pa.array(alone.code)).to_pylist()


def test_awkward_rows(spark):
    mining = Mining(least=2)
    assert {tuple(r) for r in phrases.mine_phrases(documents(spark), mining).collect()} == brute(documents(spark).collect(), mining)
    assert phrases.mine_phrases(no_documents(spark)).count() == 0
    assert phrases.mine_phrases(table(spark, [(None, None), ("", "en"), (" . ", "en")])).count() == 0


def test_summaries_keep_what_is_frequent(monkeypatch):
    monkeypatch.setattr(phrases, "HELD", 64)
    rng, least = np.random.default_rng(2), 40
    stream = np.minimum(rng.zipf(1.3, 30_000), 1 << 20).astype(np.uint32)
    true = Counter(stream.tolist())
    summary = phrases.MisraGries(len(stream) // least + 1)
    for part in np.array_split(stream, 37):  # merged from summaries of parts, in any order
        summary.add(*np.unique(part, return_counts=True))
    assert {k for k, n in true.items() if n >= least} <= set(summary.reaching(least).tolist())
    assert 0 < summary.taken <= len(stream) / (summary.capacity + 1) < least and len(summary.keys) <= summary.capacity
    assert all(n <= true[k] <= n + summary.taken for k, n in zip(summary.keys.tolist(), summary.counts.tolist()))


def test_bitmap_has_all_keys(spark):
    keys = np.random.default_rng(4).integers(0, 1 << 36, 3000)
    found = phrases.marks(spark.createDataFrame([(int(k),) for k in keys], "key long"), 4).value
    h = keys.astype(np.uint64) << np.uint64(28)
    assert found.has(h).all() and found.has(h + np.uint64(1)).all()
    assert found.has(np.random.default_rng(5).integers(0, 1 << 63, 20_000).astype(np.uint64)).mean() < 0.06
