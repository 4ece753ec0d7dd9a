from __future__ import annotations

from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from caselight.llm import packing, tokens
from caselight.llm.bpe import Encoder, load_tokenizer, tokenizer_path

from .cases import documents, no_documents


def by_library(texts):
    return [e.ids for e in load_tokenizer(tokenizer_path()).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.fixture(scope="module")
def memo():
    return Encoder(tokenizer_path()), tokens.Counter(tokenizer_path(), tokens.whole_tokens(tokenizer_path()))


PARTS = st.sampled_from(["the", "Th", "xqz", "'s", "'LL", " ", "  ", "\n", "\t", ".", ",", "!!", "12", "½", "é", "日", "’", "<|endoftext|>", "<|", " ", "\x85", "a.b", "don't"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(PARTS, max_size=12).map("".join), max_size=5))
def test_memo_equals_library(memo, texts):
    ids, per = memo[0].encode(texts)
    want = by_library(texts)
    assert per.tolist() == [len(x) for x in want]
    assert ids.tolist() == [i for x in want for i in x]
    assert memo[1].count(texts).tolist() == per.tolist()


def test_memo_starts_anew(monkeypatch):
    from caselight.llm import bpe

    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 2)
    encoder = Encoder(tokenizer_path())
    for text in ("one two three four", "five six seven", "one two"):
        assert encoder.encode([text])[0].tolist() == by_library([text])[0]


def test_proven_tokens_encode_alone():
    proven = sorted(tokens.whole_tokens(tokenizer_path()))[::97]
    assert all(len(x) == 1 for x in by_library(proven))


def test_count_tokens(spark):
    rows = documents(spark).select("doc_id", "text").collect()
    want = sorted((r.doc_id or -1, len((r.text or "").encode()), len(x), len(x) > 1024) for r, x in zip(rows, by_library([r.text for r in rows])))
    found = tokens.count_tokens(documents(spark)).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in found) == want
    assert tokens.count_tokens(no_documents(spark)).count() == 0


def test_token_files(spark):
    rows = sorted(documents(spark).select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text is not None, r.text or ""))
    ids = [np.array([*x, 0], "<u4") for x in by_library([r.text for r in rows])]
    starts = np.cumsum([0, *map(len, ids)])
    want = [(r.doc_id, int(s), len(x), crc32(x.tobytes())) for r, s, x in zip(rows, starts, ids)]
    found = [tuple(r) for r in tokens.token_files(documents(spark)).orderBy("start").collect()]
    assert found == want
    assert tokens.token_files(no_documents(spark)).count() == 0


@pytest.mark.parametrize(("lengths", "capacity"), [([], 8), ([8], 8), ([3, 3, 3], 8), ([20, 1, 7, 7, 2], 8), ([5] * 50, 8), (list(range(1, 60)), 16)])
def test_plan_keeps_every_token_once(lengths, capacity):
    for least in (1, 2, capacity):
        seen = {}
        for b in packing.plan_group(lengths, capacity, least):
            assert 0 < sum(n for *_, n in b) <= capacity
            for doc, start, n in b:
                seen.setdefault(doc, []).extend(range(start, start + n))
        assert {d: sorted(x) for d, x in seen.items()} == {d: list(range(n)) for d, n in enumerate(lengths) if n}


def test_first_fit_decreasing_is_plain_first_fit():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 100, 300).tolist()
    bins, load = [], []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        k = next((k for k, x in enumerate(load) if x + sizes[i] <= 100), len(load))
        if k == len(load):
            bins.append([])
            load.append(0)
        bins[k].append(i)
        load[k] += sizes[i]
    assert packing.first_fit_decreasing(sizes, 100) == bins


def test_pack(spark):
    rows = documents(spark).select("doc_id", "text").collect()
    ids = {}
    for r, x in zip(rows, by_library([r.text for r in rows])):
        ids.setdefault(r.doc_id, []).append(np.array([*x, 0], "<u4"))
    found = packing.pack(documents(spark), group_docs=5).collect()
    assert sum(r.length for r in found) == sum(len(x) for xs in ids.values() for x in xs)
    for r in found:
        assert any(len(x) == r.doc_tokens and crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[r.doc_id])
    by = {}
    for r in found:
        by.setdefault(r.sequence_id, []).append(r)
    for pieces in by.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    assert packing.pack(no_documents(spark)).count() == 0
