"""Quality, toxicity and chat: held-out accuracy, gradients, and awkward rows."""

from __future__ import annotations

import itertools
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from caselight.llm import chat, jaccard, mixing, quality, toxicity as X

from .cases import documents, no_documents

LABELS = "doc_id long, quality int, toxic int, text string"


def labels(spark, rows=((1, 1, 0), (2, 1, 0), (3, 0, 1), (7, None, None), (None, 1, 1), (9, 1, 0), (11, 0, 1), (14, 0, 1), (999, 1, 1))):
    return spark.createDataFrame([(*r, "clash") for r in rows], LABELS)


@pytest.mark.parametrize("none", [False, True])
def test_quality_on_awkward_rows(spark, none):
    got = quality.score_quality(documents(spark), labels(spark, () if none else labels(spark).rdd.map(lambda r: tuple(r)[:3]).collect()))
    rows = got.collect()
    assert len(rows) == documents(spark).count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.score_quality(no_documents(spark), labels(spark)).count() == 0
    kept = quality.keep_quality(documents(spark), labels(spark))
    assert kept.columns == documents(spark).columns


def test_quality_held_out():
    rng = np.random.default_rng(1)
    good = [" ".join(rng.choice(["the", "house", "stands", "near", "a", "river."], 60)) for _ in range(300)]
    bad = [" ".join(w.upper() + "!!" for w in rng.choice(["the", "house", "stands", "near"], 60)) for _ in range(100)]
    x, y = np.array([quality.features(t) for t in good + bad]), np.repeat([1.0, 0.0], [300, 100])
    model = quality.fit(x[::2], y[::2])
    assert ((quality.predict(x[1::2], model) >= 0.5) == y[1::2]).mean() > 0.99


def plain_posteriors(rows):
    """Score of each (host, path, p), by plain sums over the other documents, and the priors."""
    logit = lambda p: np.log(p / (1 - p))
    mean = np.mean([p for *_, p in rows])
    hosts, paths = {}, {}
    for h, q, p in rows:
        hosts.setdefault(h, []).append(p)
        paths.setdefault((h, q), []).append(p)

    def strength(groups, centre):
        n = len(rows)
        spread = sum(len(g) * (np.mean(g) - centre(k)) ** 2 for k, g in groups.items()) / n
        return min(1e6, max(1.0, mean * (1 - mean) / max(spread - mean * (1 - mean) * len(groups) / n, 1e-6) - 1))

    own = strength(hosts, lambda k: mean)
    inner = strength(paths, lambda k: (sum(hosts[k[0]]) + own * mean) / (len(hosts[k[0]]) + own))
    out = []
    for h, q, p in rows:
        host = (sum(hosts[h]) - p + own * mean) / (len(hosts[h]) - 1 + own)
        path = (sum(paths[h, q]) - p + inner * host) / (len(paths[h, q]) - 1 + inner)
        out.append((h, q, p, host, path, 1 / (1 + np.exp(-(logit(p) + logit(path) - logit(mean))))))
    return sorted(out)


def test_posteriors_are_those_of_plain_sums(spark):
    """Sparse sites shrink to their parents, a document's own evidence counts once, and sites change decisions."""
    rng = np.random.default_rng(3)
    rows = [(f"h{h}", f"q{q}", float(np.clip(rng.normal(0.3 + 0.1 * h + 0.05 * q, 0.15), 0.01, 0.99))) for h in range(6) for q in range(3) for _ in range([1, 3, 40][(h + q) % 3])]
    rows += [("lone", "q", 0.2), ("h5", "new", 0.45)]
    judged = spark.createDataFrame(rows, "source string, lang string, p double")
    got = sorted((r.site_host, r.site_path, r.p, r.host_posterior, r.path_posterior, r.score) for r in quality._scored(judged, "p", quality._light(judged, "p")).collect())
    want = plain_posteriors(rows)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[2:] for r in got], [r[2:] for r in want])
    lone = next(r for r in want if r[0] == "lone")
    assert lone[5] == pytest.approx(lone[2])  # nothing is known of its site
    changed = [r for r in want if (r[2] >= 0.5) != (r[5] >= 0.5)]
    assert changed and any(r[:2] == ("h5", "new") and r[5] >= 0.5 for r in changed)


def test_stages_keep_values_of_clashing_columns(spark, monkeypatch):
    """Columns named as the operators' own keep their values; which rows stay does not depend on them."""
    monkeypatch.setattr(X, "STEPS", 6)
    monkeypatch.setattr(X, "SPELL_STEPS", 4)
    names = ["quality_p", "quality_host", "site_host", "site_path", "p", "row", "score", "path_n", "host_s", "toxic_score", "mix_domain", "mix_lang", "mix_source", "mix_tokens", "full", "cut", "tokens", "document", "digest", "first", "component"]
    plain = documents(spark).select("doc_id", "text", "lang", "source")
    clash = plain.select("*", *(F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))).alias(n) for n in names))
    for stage in (lambda d: quality.keep_quality(d, labels(spark)), lambda d: X.keep_clean(d, labels(spark)), lambda d: mixing.chosen(d, mixing.Mix(share=0.7, epochs=1)), jaccard.keep_first):
        rows, bare = stage(clash).collect(), stage(plain).collect()
        key = lambda r: (str(r.doc_id), str(r.text), str(r.lang), str(r.source))
        assert sorted(map(key, rows)) == sorted(map(key, bare)) and rows
        assert all(r[n] == n + ("-" if r.doc_id is None else str(r.doc_id)) for r in rows for n in names)
        assert stage(clash.limit(0)).count() == 0


def test_gradients():
    model = X.Model(1)
    model.p = {k: v.astype(float) for k, v in model.p.items()}
    words = ["", "abc", "de", "f", "zz"]
    model.vocabulary = {"abc": 3, "zz": 5}
    place, mask = X.padded([np.array([1, 2, 3]), np.array([4, 1]), np.array([], int)])
    args = model.codes(words), X.char_codes(words), place, mask.astype(float), np.array([1.0, 0, 1])
    g = model.gradients(*args)[1]
    at, d = g["words"]
    g["words"] = np.zeros_like(model.p["words"])
    np.add.at(g["words"], at, d)
    for k, d in g.items():
        spot = np.unravel_index(np.argmax(np.abs(d)), d.shape)
        old, losses = model.p[k][spot], []
        for e in (1e-5, -1e-5):
            model.p[k][spot] = old + e
            losses.append(model.gradients(*args)[0])
        model.p[k][spot] = old
        assert (losses[0] - losses[1]) / 2e-5 == pytest.approx(d[spot], abs=1e-4)


def test_windows_cover_and_overlap():
    for n in (0, 1, 31, 32, 33, 56, 57, 1000):
        spans = X.windows_of(n)
        assert {k for a, b in spans for k in range(a, b)} == set(range(n))
        assert all(b0 > a1 for (_, b0), (a1, _) in zip(spans, spans[1:]))


def test_toxicity_held_out():
    rng = np.random.default_rng(2)
    plain = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 8))) for _ in range(800)]
    texts, y = [], []
    for k in range(700):
        w = rng.choice(plain, rng.integers(1, 120)).tolist()
        if k % 4 == 0:
            for _ in range(3):
                w.insert(int(rng.integers(len(w) + 1)), "vilex" + str(rng.choice(plain))[:3])
        texts.append(" ".join(w))
        y.append(int(k % 4 == 0))
    cut = [[t.split()[a:b] for a, b in X.windows_of(len(t.split()))] for t in texts]
    y = np.array(y)
    scorer = X.Scorer(X.fit(cut[:500], y[:500]))
    hit = scorer.score(texts[500:]) >= X.THRESHOLD
    assert (hit == y[500:]).mean() > 0.95


def test_toxicity_on_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(X, "STEPS", 6)
    monkeypatch.setattr(X, "SPELL_STEPS", 4)
    for rows in (labels(spark), labels(spark, ()), labels(spark, ((1, 1, 1), (2, 1, 1)))):
        got = X.score_toxicity(documents(spark), rows).collect()
        assert len(got) == documents(spark).count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
        assert all(r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
        same = {}
        texts = {}
        for d in documents(spark).where("doc_id IN (1, 2)").collect():
            texts[d.doc_id] = d.text
        for r in got:
            if r.doc_id in texts:
                same.setdefault(texts[r.doc_id], set()).add(round(r.score, 6))
        assert all(len(s) == 1 for s in same.values())
    assert X.score_toxicity(no_documents(spark), labels(spark)).count() == 0
    assert X.keep_clean(documents(spark), labels(spark)).columns == documents(spark).columns


def test_toxicity_learns_from_whole_texts(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(X, "fit", lambda texts, toxic: seen.append((texts, toxic)))
    ids = [k for k in range(99) if crc32(str(k).encode()) % 3 != 1][:4]
    rows = [(k, " ".join(f"w{i}" for i in range(n))) for k, n in zip(ids, (30, 800, 1000, 5000))]
    X.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, n % 2) for n, k in enumerate(ids)], "doc_id long, toxic int"))
    assert [{w for x in t for w in x} for t in seen[0][0]] == [set(text.split()) for _, text in rows]


def test_all_characters_and_passages_are_read():
    assert X.words_of("Short einundzwanzigste") == ["short", "einundzwan", "dzwanzigst", "zwanzigste"]
    for text in ("a" * 10, "abcdefghijk", "".join(chr(97 + k % 26) for k in range(97)), "日本語" * 40):
        got = X.words_of(text)
        assert all(len(p) <= X.CHARS for p in got) and all(any(text[k : k + 6] in p for p in got) for k in range(len(text) - 5))
    assert not np.array_equal(X.char_codes(X.words_of("abcdefghijklm")), X.char_codes(X.words_of("abcdefghijxyz")))
    for n in (17, 33, 56, 1000):
        assert all(any(a <= k and k + 17 <= b for a, b in X.windows_of(n)) for k in range(n - 16))


TURNS = "conv_id long, turn long, role string, text string, block string, place string, recovered string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], TURNS)


def conversation(k: int, n: int, marked: bool = True):
    names = ["User: ", "Assistant: "] if marked else ["", ""]
    return [(k, i, ("user", "assistant")[i % 2], names[i % 2] + ("why so?" if i % 2 == 0 else "because " * 20)) for i in range(n)]


def test_roles_in_blocks_are_viterbi_paths(spark, monkeypatch):
    rows = [r for k in range(6) for r in conversation(k, 3 + 5 * k, k % 2 == 0)]
    df = turns(spark, rows)
    model = chat.fit(df)
    signed = chat.with_signs(df).orderBy("conv_id", "turn", "text").toPandas()
    want = [chat.ROLES[s] for _, g in signed.groupby("conv_id") for s in chat.viterbi(model, {k: g["sign_" + k].to_numpy() for k in chat.SIGNS})]
    for block in (1, 2, 3, 512):
        monkeypatch.setattr(chat, "BLOCK", block)
        assert [r.recovered for r in chat.recover_roles(df, model).orderBy("conv_id", "turn").collect()] == want
    assert want == [r[2] for r in rows]


def test_paths_are_best_of_all(spark):
    """Every path over a short conversation, scored step by step; none beats the recovered one."""
    rows = [(k, i, ("system", "user", "assistant", "tool")[(i * 7 + k) % 4], ("Tool: x", "why?", "because " * (3 * k + 1), "a\nb\nc")[(i + k) % 4]) for k in range(5) for i in range(k + 1)]
    df = turns(spark, rows)
    model = chat.fit(df)
    got = {}
    for r in chat.recover_roles(df, model).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append(chat.ROLES.index(r.recovered))
    for conv, group in chat.with_signs(df).orderBy("conv_id", "turn").toPandas().groupby("conv_id"):
        def score(path):
            total = model.start[path[0]] + sum(model.step[a, b] for a, b in zip(path, path[1:]))
            return total + sum(model.emit[k][state, min(v, chat.SIGNS[k] - 1)] for k in chat.SIGNS for state, v in zip(path, group["sign_" + k]))

        best = max(map(score, itertools.product(range(4), repeat=len(group))))
        assert score(got[conv]) == pytest.approx(best)


def test_transcripts_in_one_text_come_apart(spark):
    said = [r for k in range(4) for r in conversation(k, 8)]
    talk = "User: why so?\nAssistant: because it is\nso and\nso\nUser: why so?\nassistant : because"
    rows = [*said, (10, 0, None, talk), (10, 1, "user", "User: why so?"), (11, 0, None, talk), (11, 0, None, talk), (12, 0, "assistant", "Assistant: first\nAssistant: second"), (12, 1, "user", "the user: none\nof them, users: too")]
    got = chat.format_chats(turns(spark, rows)).orderBy("conv_id", "turn", "part").collect()
    of = lambda k: [(r.turn, r.part, r.recovered, r.rendered) for r in got if r.conv_id == k]
    want = [(0, 0, "user", "<|user|>\nwhy so?<|end|>\n"), (0, 1, "assistant", "<|assistant|>\nbecause it is\nso and\nso<|end|>\n"), (0, 2, "user", "<|user|>\nwhy so?<|end|>\n"), (0, 3, "assistant", "<|assistant|>\nbecause<|end|>\n")]
    assert of(10) == [*want, (1, 0, "user", "<|user|>\nwhy so?<|end|>\n")]
    assert of(11) == [w for w in want for _ in range(2)]
    assert of(12)[0] == (0, 0, "assistant", "<|assistant|>\nfirst\nAssistant: second<|end|>\n") and len(of(12)) == 2
    assert len([r for r in got if r.conv_id < 4]) == len(said)


def test_chat_on_awkward_rows(spark):
    rows = [(1, 0, "user", None), (1, 0, "user", None), (1, None, None, "### Assistant:\nhello"), (1, 5, "odd", ""), (2, 1, "system", "System: be kind " + "x " * 5000), (None, 1, "user", "lost"), *conversation(3, 6)]
    got = chat.format_chats(turns(spark, rows)).collect()
    assert len(got) == len(rows) - 1 and all(r.recovered in chat.ROLES for r in got)
    assert next(r for r in got if r.turn is None).rendered == "<|assistant|>\nhello<|end|>\n"
    assert {r.n_turns for r in got if r.conv_id == 1} == {4}
    assert chat.format_chats(turns(spark, [])).count() == 0


def test_score_by_plain_loops():
    """The forward pass of tasks against the equations of the network, one number at a time."""
    import math

    model = X.Model(3)
    model.vocabulary = {"abc": 5, "zz": 9}
    p = {k: v.astype(float) for k, v in model.p.items()}
    text = " ".join(["abc", "zz", "extraordinarily", "q"] * 13)

    def step(name, x, h):
        n = len(h)
        at = lambda g: [sum(x[i] * p[name + "w"][i, j] for i in range(len(x))) + p[name + "b"][j] + (sum(h[i] * p[name + "u"][i, j] for i in range(n)) if g else 0.0) for j in range(3 * n)]
        gates = [1 / (1 + math.exp(-v)) for v in at(True)[: 2 * n]]
        z, r = gates[:n], gates[n:]
        c = [math.tanh(at(False)[2 * n + j] + sum(r[i] * h[i] * p[name + "u"][i, 2 * n + j] for i in range(n))) for j in range(n)]
        return [h[j] + z[j] * (c[j] - h[j]) for j in range(n)]

    def run(name, xs, n):
        h, out = [0.0] * n, []
        for x in xs:
            h = step(name, x, h)
            out.append(h)
        return out

    def window(words):
        inputs = []
        for w in words:
            letters = [p["chars"][ord(c)] for c in w]
            inputs.append([*run("cf", letters, X.CHAR_STATE)[-1], *run("cb", letters[::-1], X.CHAR_STATE)[-1], *p["words"][model.vocabulary.get(w, 0)]])
        states = [a + b for a, b in zip(run("wf", inputs, X.WORD_STATE), run("wb", inputs[::-1], X.WORD_STATE)[::-1])]
        e = [sum(math.tanh(sum(s[i] * p["aw"][i, j] for i in range(len(s)))) * p["av"][j, 0] for j in range(X.ATTENTION)) for s in states]
        a = [math.exp(v) / sum(map(math.exp, e)) for v in e]
        return sum(a[t] * sum(states[t][i] * p["ow"][i, 0] for i in range(len(states[t]))) for t in range(len(states))) + p["ob"][0]

    words = X.words_of(text)
    logits = [window(words[a:b]) for a, b in X.windows_of(len(words))]
    assert len(logits) > 2
    assert X.Scorer(model).score([text])[0] == pytest.approx(1 / (1 + math.exp(-max(logits))), abs=1e-5)


def test_sample_is_bounded_in_bytes(spark, monkeypatch):
    taken = []
    monkeypatch.setattr(X, "fit", lambda texts, toxic: taken.append(sum(len(w) for t in texts for x in t for w in x)) or X.Model())
    docs = spark.createDataFrame([(k, "word " * 100) for k in range(40)] * 3, "doc_id long, text string")
    marks = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    X.train(docs, marks)
    monkeypatch.setattr(X, "SAMPLE_BYTES", 2600)
    X.train(docs, marks)
    assert taken[0] > 4 * taken[1] > 0
