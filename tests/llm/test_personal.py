from __future__ import annotations

import re
from hashlib import sha256
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from caselight.llm import personal
from caselight.llm.personal import Tagger, base_spans

from .cases import DOCUMENTS, documents, no_documents, words


def plain(text):
    """The patterns as they stand, each from left to right."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c in "0123456789"]
        if 14 <= len(d) <= 19 and sum(x if k % 2 == 0 else x * 2 - 9 * (x > 4) for k, x in enumerate(d[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return sorted(out)


PARTS = st.sampled_from(["a@b.c", "@", ".", "x", "a.b-c", "%+", "4111111111111111", "4111 1111-1111 1111", "+1 (814) 555-5574", "+", "1", "255", "256", "1.2.3.4", "0001.2.3.4", " ", "-", "(", "é", "٣", "\n"])


@settings(max_examples=600, deadline=None)
@given(st.lists(PARTS, max_size=14).map("".join))
def test_patterns(text):
    assert base_spans(text) == plain(text)


def test_long_runs_of_digits():
    assert base_spans("9" * 6000 + "." + "1.2.3") == [] and base_spans("0" * 5000 + "1.2.3.4") == [(0, 1, 5007)]


def test_gradients():
    rng, model = np.random.default_rng(1), Tagger(3, np.float64)
    codes, mask = personal.char_codes(["Ab 12@c.de", "x", "+1 (2) 3é"])
    codes, mask = codes[:11], mask[:11].astype(np.float64)
    y = rng.integers(0, personal.LABELS, codes.shape)
    g = model.gradients(codes, mask, y)[1]
    for name, value in model.p.items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in value.shape)
            if name == "chars":
                at = (codes[0, 0], at[1])
            old, sides = value[at], []
            for step in (1e-5, -1e-5):
                value[at] = old + step
                sides.append(model.gradients(codes, mask, y)[0])
            value[at] = old
            assert g[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=1e-4, abs=1e-7), name


def test_paths_against_all_paths(monkeypatch):
    monkeypatch.setattr(personal, "LABELS", 3)
    model, rng = Tagger(2, np.float64), np.random.default_rng(4)
    codes, mask = rng.integers(1, 99, (5, 3)), np.ones((5, 3))
    mask[3:, 1] = 0
    scores, labels = model.scores(codes, mask)[0], model.decode(codes, mask)[0]
    for row, n in enumerate((5, 3, 5)):
        def weight(path):
            return model.p["first"][path[0]] + sum(scores[t, row, p] for t, p in enumerate(path)) + sum(model.p["next"][a, b] for a, b in zip(path, path[1:]))

        paths = {p: weight(p) for p in product(range(3), repeat=n)}
        assert tuple(labels[:n, row]) == max(paths, key=paths.get)
        assert personal.log_sum(model.forward(scores, mask)[-1], 1)[row] == pytest.approx(np.log(sum(np.exp(list(paths.values())))))


def test_windows_joined_and_heaviest_kept():
    text = "mail anna.lang (at) mail7 dot example dot com now or 4111.1111.1111.1111 ok"
    a, b = text.index("anna"), text.index(" now")
    c, d = text.index("4111"), text.index(" ok")
    cut = [(a, 0, a + 20, 9.0), (a + 10, 0, b, 9.0), (c, 2, d, 5.0), (c, 3, d, 50.0), (c, 2, c + 9, 90.0)]
    assert personal.reconciled(text, cut, []) == [(a, 0, b), (c, 2, d)]
    assert personal.reconciled(text, cut, [(a - 2, 0, b + 1)]) == [(c, 2, d)]


def table(spark, texts):
    return spark.createDataFrame([(k, t, "en", "s", 1, "x", 1, 2, 0.5, "i", "k", 3, "l", "m", 0.1, 0.2) for k, t in enumerate(texts)], DOCUMENTS)


@pytest.fixture(scope="module")
def planted(spark):
    """Texts with personal data, half of them written in other ways, and the spans of the latter."""
    rng, texts, new = np.random.default_rng(8), [], []
    for k in range(240):
        digits = "".join(map(str, rng.integers(0, 10, 15)))
        card = "4" + digits[:14]
        card += next(c for c in "0123456789" if personal.luhn(card + c))
        own = [f"{words(k, 1)}{k}.x@mail{k % 10}.example.com", ".".join(map(str, rng.integers(1, 255, 4))), card, f"+1 ({digits[:3]}) 555-{digits[3:7]}"][k % 4]
        before, after = words(1000 + k, int(rng.integers(5, 150))), words(2000 + k, 30)
        kind = k % 4
        if k < 120:
            texts.append(f"{before} {own} {after}")
        elif k < 200:
            ahead, own, _ = personal.rewritten(kind, own, rng)
            texts.append(f"{before} {ahead}{own} {after}")
            new.append((k, kind, len(before) + 1 + len(ahead), len(before) + 1 + len(ahead) + len(own)))
        else:
            texts.append(f"{before} {personal.unlike(rng)} {after} token = \"{rng.bytes(12).hex()}\"")
    docs = table(spark, texts)
    return docs, texts, new, personal.fit(personal.sample_passages(docs))


def test_adds_what_patterns_miss(spark, planted):
    docs, texts, new, model = planted
    rows = {r.doc_id: r for r in personal.find_personal(docs, model).collect()}
    for k, text in enumerate(texts):
        base = plain(text)
        assert [rows[k][f"n_{kind}"] for kind in personal.KINDS] == [sum(x[1] == n for x in base) for n in range(4)]
        assert rows[k].base_sha256 == sha256(personal.written(base).encode()).hexdigest()
        assert set(personal.written(base).split(",")) - {""} <= set(rows[k].spans.split(","))
    missed = [x for x in new if not any(a == x[2] and b == x[3] for a, _, b in plain(texts[x[0]]))]
    caught = sum(personal.written([(a, kind, b)]) in rows[k].spans.split(",") for k, kind, a, b in missed)
    assert len(missed) > 50 and caught >= 0.8 * len(missed), (caught, len(missed))
    false = sum(len(rows[k].spans.split(",")) - (not rows[k].spans) - len(plain(texts[k])) for k in range(200, 240))
    assert false <= 1


MAIL = st.tuples(
    st.lists(st.sampled_from(["ann", "x.", " dot ", "b", "(.)", "w" * 130, "%+"]), min_size=1, max_size=4).map("".join),
    st.sampled_from([" at ", "(at)", "[ AT ]", "{at>", " @ ", "@", "\nat\t", "( @ )", " At "]),
    st.lists(st.sampled_from(["mail", "a-dot", "c", " ", " dot ", ".", "[dot]", "]", " " * 120 + "dOt ", "org", "q" * 99]), min_size=2, max_size=6).map("".join),
).map("".join)
NUMBER = st.lists(st.sampled_from(["1", "25", "+", "(", ") ", " ", "-", ".", " dot ", "[.]", " " * 150 + ".", "(dot)", "4111 1111/1111_1111"]), max_size=9).map("".join)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 40), MAIL | NUMBER, MAIL | NUMBER | st.just(""))
def test_windows_hold_all_that_keeps_the_rules(ahead, one, other):
    text = "so " * ahead + one + " ok, " + other
    starts, last = set(personal.window_starts(text)), max(0, -(-(len(text) - personal.WINDOW) // personal.STRIDE))
    borders = [k for k in range(len(text) + 1) if k in (0, len(text)) or text[k - 1].isalnum() != text[k].isalnum() or text[k] in "+("]
    for a, b in [(a, b) for a in borders for b in borders if a < b]:
        if any(personal.plain_form(kind, text[a:b]) for kind in range(4)):
            assert {k * personal.STRIDE for k in range(last + 1) if a - personal.WINDOW < k * personal.STRIDE < b} <= starts, (text, a, b)


@pytest.mark.parametrize("span", ["anna.lang (at) mailer.example.com", "anna.lang [at] mailer.example.com", "anna.lang at mailer.example.com", "anna.lang (at) mailer dOt com"])
def test_address_without_digit_or_spelt_dot_is_read(span):
    text = words(5, 60) + " " + span
    found = personal.window_starts(text)
    assert found and found[-1] + personal.WINDOW >= len(text) and found[0] <= len(text) - len(span)


def test_added_address_with_plain_dots(spark, planted):
    texts = [f"{words(k, 30)} write to anna.lang{at}mailer.example.com {words(k + 50, 9)}".translate(str.maketrans("", "", "0123456789")) for k, at in enumerate([" (at) ", "(at)", "[at]", " [at] "])]
    rows = personal.find_personal(table(spark, texts), planted[3]).collect()
    assert sum(f"email:{t.index('anna')}:{t.index('.com') + 4}" in rows[k].spans for k, t in enumerate(texts)), rows


def test_long_base_spans_hold_off_what_is_added():
    text = ".".join("1" * 40) + "x@mail.example.org or 2"
    base, b = base_spans(text), text.index(" or")
    assert len(base) > 8 and personal.reconciled(text, [(b - 12, 0, b, 9.0)], base) == []


def test_awkward_rows(spark, planted):
    rows = personal.find_personal(documents(spark), planted[3]).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r.doc_id) for r in documents(spark).collect())
    assert all(r.spans == "" and r.base_sha256 == sha256(b"").hexdigest() for r in rows if r.doc_id in (4, 5, 6))
    assert personal.find_personal(no_documents(spark)).count() == 0
    assert {r.spans for r in personal.find_personal(table(spark, ["no data here", "1 of 2"])).collect()} == {""}


def test_long_text_is_read_to_its_end(spark, planted):
    text = words(3, 40_000) + " write to zoe.k (at) mail3 [dot] example [dot] com soon, or a@b.example"
    found = personal.find_personal(table(spark, [text]), planted[3]).collect()[0].spans.split(",")
    assert found[-1] == f"email:{len(text) - 11}:{len(text)}" and len(found) == 2 and text[int(found[0].split(":")[1]) :].startswith("zoe.k")
