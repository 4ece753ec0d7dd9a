"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs, in numpy.

A word's input is a hashed embedding beside the end states of a bidirectional recurrence over its characters, so that
an unknown word is judged by how it is spelt. A window of words runs through a bidirectional recurrence; attention
weighs its states; the pooled state gives the window's log-odds. All overlapping windows of a whole text are scored,
and the text is as toxic as its worst window.

Labels mark texts, not windows: a toxic text is trained on the windows that the model itself finds worst (at first,
those with words that mark toxic texts), any other text on some of its windows, all of which are clean.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import free_name, materialise, text_batches, working_on

#: The model is fitted on at most this many labelled rows, each with its whole text.
SAMPLE_ROWS = 4000
#: And on at most this many bytes of their texts: rows beyond that are left out whole, in the order of their hashes.
SAMPLE_BYTES = 64 << 20
#: A window starts every ``STRIDE`` words, so a passage of up to WINDOW - STRIDE + 1 = 17 words is whole in one of them.
WINDOW, STRIDE = 32, 16
THRESHOLD = 0.7
#: A longer word is read in pieces of ``CHARS`` that start every ``PIECE`` characters.
PIECE = 5
CHARS, CHAR_KINDS, CHAR_DIM, CHAR_STATE = 10, 160, 8, 8
WORD_KINDS, WORD_DIM, WORD_STATE, ATTENTION = 8192, 8, 8, 8
WORDS = re.compile(r"\w+")
MEMO = 150_000
SPELL_STEPS, STEPS, BATCH, RATE = 160, 150, 128, 0.01
PLACES = 1024


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def words_of(text: str | None) -> list[str]:
    """Words in order; one of over ``CHARS`` characters as overlapping pieces that hold all of them."""
    found = WORDS.findall((text or "").lower())
    if max(map(len, found), default=0) <= CHARS:
        return found
    return [p for w in found for p in ((w,) if len(w) <= CHARS else (w[k : k + CHARS] for k in (*range(0, len(w) - CHARS, PIECE), len(w) - CHARS)))]


def windows_of(n: int) -> list[tuple[int, int]]:
    """Overlapping windows that cover n words; one empty window if there are none."""
    return [(0, n)] if n <= WINDOW else [*((s, s + WINDOW) for s in range(0, n - WINDOW, STRIDE)), (n - WINDOW, n)]


def char_codes(words: list[str]) -> np.ndarray:
    """Kinds of the characters of each word, which has ``CHARS`` at most; 0 pads."""
    points = np.array(words or [""], f"U{CHARS}").view(np.uint32).reshape(-1, CHARS)[: len(words)].astype(np.int64)
    return np.where(points < 128, points, 128 + points % 32)


class Recurrence:
    """A gated recurrent unit over (steps, rows, inputs); rows whose mask is 0 at a step keep their state."""

    def __init__(self, w: np.ndarray, u: np.ndarray, b: np.ndarray):
        self.w, self.u, self.b, self.size = w, u, b, u.shape[0]

    def run(self, projected: np.ndarray, mask: np.ndarray, keep: bool = False):
        """States after each step, from inputs already multiplied with ``w`` and biased; keep: also what ``back`` needs."""
        h, n, states, kept = np.zeros((projected.shape[1], self.size), projected.dtype), self.size, [], []
        for x, m in zip(projected, mask):
            gates = sigmoid(x[:, : 2 * n] + h @ self.u[:, : 2 * n])
            z, r = gates[:, :n], gates[:, n:]
            c = np.tanh(x[:, 2 * n :] + (r * h) @ self.u[:, 2 * n :])
            new = h + (m[:, None] * z) * (c - h)
            if keep:
                kept.append((h, z, r, c, m[:, None]))
            states.append(new)
            h = new
        return np.stack(states), kept

    def back(self, d_states: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
        """(gradient of the projected inputs, of u) from the gradient of all states."""
        n, dh, du, out = self.size, np.zeros_like(d_states[0]), np.zeros_like(self.u), []
        for d, (h, z, r, c, m) in zip(d_states[::-1], kept[::-1]):
            dh = dh + d
            dz, dc = dh * m * (c - h) * z * (1 - z), dh * m * z * (1 - c * c)
            drh = dc @ self.u[:, 2 * n :].T
            dr = drh * h * r * (1 - r)
            dg = np.concatenate([dz, dr], 1)
            du[:, : 2 * n] += h.T @ dg
            du[:, 2 * n :] += (r * h).T @ dc
            out.append(np.concatenate([dg, dc], 1))
            dh = dh * (1 - m * z) + drh * r + dg @ self.u[:, : 2 * n].T
        return np.stack(out[::-1]), du


class Model:
    """Parameters by name; ``score_words`` and ``score_windows`` are the forward pass that tasks run."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)

        def made(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)

        self.p = {"chars": made(CHAR_KINDS, CHAR_DIM) * 4, "words": made(WORD_KINDS, WORD_DIM)}
        for name, inputs, states in (("cf", CHAR_DIM, CHAR_STATE), ("cb", CHAR_DIM, CHAR_STATE), ("wf", 2 * CHAR_STATE + WORD_DIM, WORD_STATE), ("wb", 2 * CHAR_STATE + WORD_DIM, WORD_STATE)):
            self.p |= {name + "w": made(inputs, 3 * states), name + "u": made(states, 3 * states), name + "b": np.zeros(3 * states, np.float32)}
        self.p |= {"aw": made(2 * WORD_STATE, ATTENTION), "av": made(ATTENTION, 1), "ow": made(2 * WORD_STATE, 1), "ob": np.zeros(1, np.float32)}
        self.vocabulary: dict[str, int] = {}

    def codes(self, words: list[str]) -> np.ndarray:
        """Places in the vocabulary; 0 for words outside it."""
        return np.array([self.vocabulary.get(w, 0) for w in words], np.int64)

    def unit(self, name: str) -> Recurrence:
        return Recurrence(self.p[name + "w"], self.p[name + "u"], self.p[name + "b"])

    def spell(self, codes: np.ndarray, keep: bool = False):
        """Both end states over the characters of each word."""
        x = self.p["chars"][codes.T]
        mask = (codes.T > 0).astype(np.float32)
        ends, kept = [], []
        for name, turn in (("cf", slice(None)), ("cb", slice(None, None, -1))):
            unit = self.unit(name)
            states, k = unit.run((x @ unit.w + unit.b)[turn], mask[turn], keep)
            ends.append(states[-1])
            kept.append(k)
        return np.concatenate(ends, 1), (x, kept)

    def project(self, words: list[str]) -> np.ndarray:
        """What both recurrences of a window take in for each word."""
        inputs = np.concatenate([self.spell(char_codes(words))[0], self.p["words"][self.codes(words)]], 1)
        return np.concatenate([inputs @ self.p["wfw"] + self.p["wfb"], inputs @ self.p["wbw"] + self.p["wbb"]], 1)

    def read(self, projected: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Log-odds of windows (steps, rows, inputs of both directions)."""
        n = 3 * WORD_STATE
        forward, kf = self.unit("wf").run(projected[:, :, :n], mask, keep)
        backward, kb = self.unit("wb").run(projected[::-1, :, n:], mask[::-1], keep)
        states = np.concatenate([forward, backward[::-1]], 2)
        u = np.tanh(states @ self.p["aw"])
        e = (u @ self.p["av"])[:, :, 0] + (mask - 1) * 1e4
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = (a[:, :, None] * states).sum(0)
        return (pooled @ self.p["ow"] + self.p["ob"])[:, 0], (states, u, a, pooled, kf, kb)

    def gradients(self, codes: np.ndarray, chars: np.ndarray, place: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients for windows of words: ``place`` (steps, rows) points into the distinct words."""
        p, g = self.p, {}
        spelt, (cx, ck) = self.spell(chars, True)
        inputs = np.concatenate([spelt, p["words"][codes]], 1)
        projected = np.concatenate([inputs @ p["wfw"] + p["wfb"], inputs @ p["wbw"] + p["wbb"]], 1)
        logit, (states, u, a, pooled, kf, kb) = self.read(projected[place], mask, True)
        prob = sigmoid(logit)
        loss = float(-np.mean(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7)))
        d = ((prob - y) / len(y)).astype(np.float32)
        g["ow"], g["ob"] = pooled.T @ d[:, None], d.sum(keepdims=True)
        d_pooled = d[:, None] * p["ow"][:, 0]
        d_a = (states * d_pooled).sum(2)
        d_e = a * (d_a - (a * d_a).sum(0))
        d_u = d_e[:, :, None] * p["av"][:, 0] * (1 - u * u)
        flat = (-1, 2 * WORD_STATE)
        g["av"] = u.reshape(-1, ATTENTION).T @ d_e.reshape(-1, 1)
        g["aw"] = states.reshape(flat).T @ d_u.reshape(-1, ATTENTION)
        d_states = a[:, :, None] * d_pooled + d_u @ p["aw"].T
        df, g["wfu"] = self.unit("wf").back(d_states[:, :, :WORD_STATE], kf)
        db, g["wbu"] = self.unit("wb").back(d_states[::-1, :, WORD_STATE:], kb)
        d_projected = np.zeros_like(projected)
        np.add.at(d_projected, place.ravel(), np.concatenate([df, db[::-1]], 2).reshape(-1, projected.shape[1]))
        n, d_inputs = 3 * WORD_STATE, 0
        for name, part in (("wf", d_projected[:, :n]), ("wb", d_projected[:, n:])):
            g[name + "w"], g[name + "b"] = inputs.T @ part, part.sum(0)
            d_inputs = d_inputs + part @ p[name + "w"].T
        g["words"] = (codes, d_inputs[:, 2 * CHAR_STATE :])
        return loss, g | self.spell_back(chars, d_inputs, cx, ck)

    def spell_back(self, chars: np.ndarray, d_inputs: np.ndarray, cx: np.ndarray, ck: list) -> dict[str, np.ndarray]:
        """Gradients of what spells words, from those of both end states."""
        p, g, d_x = self.p, {}, 0
        for k, (name, turn) in enumerate((("cf", slice(None)), ("cb", slice(None, None, -1)))):
            ends = np.zeros((CHARS, len(chars), CHAR_STATE), np.float32)
            ends[-1] = d_inputs[:, k * CHAR_STATE : (k + 1) * CHAR_STATE]
            dp, g[name + "u"] = self.unit(name).back(ends, ck[k])
            dp = dp[turn]
            g[name + "w"], g[name + "b"] = cx.reshape(-1, CHAR_DIM).T @ dp.reshape(-1, dp.shape[2]), dp.sum((0, 1))
            d_x = d_x + dp @ p[name + "w"].T
        g["chars"] = np.zeros_like(p["chars"])
        np.add.at(g["chars"], chars.T.ravel(), d_x.reshape(-1, CHAR_DIM))
        return g

    def spelling_step(self, chars: np.ndarray, head: np.ndarray, target: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients for telling a word's mark from its spelling alone, and that of the head (states and a constant)."""
        ends, (cx, ck) = self.spell(chars, True)
        ones = np.concatenate([ends, np.ones((len(ends), 1), np.float32)], 1)
        d = ((ones @ head - target) / len(target)).astype(np.float32)
        return self.spell_back(chars, d[:, None] * head[:-1], cx, ck), ones.T @ d


class Steps:
    """Adam over a model's parameters; embeddings of words are touched only where they occur."""

    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.rate, self.t = rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def take(self, p: dict[str, np.ndarray], g: dict) -> None:
        self.t += 1
        scale = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, d in g.items():
            at = slice(None)
            if isinstance(d, tuple):
                at, where = np.unique(d[0], return_inverse=True)
                total = np.zeros((len(at), d[1].shape[1]), np.float32)
                np.add.at(total, where, d[1])
                d = total
            d = np.clip(d, -1, 1)
            self.m[k][at] = 0.9 * self.m[k][at] + 0.1 * d
            self.v[k][at] = 0.999 * self.v[k][at] + 0.001 * d * d
            p[k][at] -= scale * self.m[k][at] / (np.sqrt(self.v[k][at]) + 1e-8)


def marks(texts: list[list[list[str]]], toxic: np.ndarray) -> tuple[dict[str, float], Counter]:
    """How much more often a word, or what it begins with, occurs in toxic texts: log-odds, drawn to 0 for rare ones."""
    seen = [Counter(), Counter()]
    for t, y in zip(texts, toxic):
        words = {w for x in t for w in x}
        seen[int(y)].update(words | {w[:k] + "*" for w in words for k in (4, 5, 6) if len(w) > k})
    n = [max(1, int((toxic == v).sum())) for v in (0, 1)]

    def odds(x: str) -> float:
        return float(np.log((seen[1][x] + 1) / (n[1] + 2)) - np.log((seen[0][x] + n[0] / n[1]) / (n[0] + 2)))

    out = {}
    for w in {*seen[0], *seen[1]}:
        if not w.endswith("*"):
            out[w] = max([odds(w), *(odds(w[:k] + "*") for k in (4, 5, 6) if len(w) > k)])
    return out, seen[0] + seen[1]


def fit(texts: list[list[list[str]]], toxic: np.ndarray, seed: int = 5) -> Model:
    """A model from texts as lists of windows of words."""
    model, rng = Model(seed), np.random.default_rng(seed)
    if not len(toxic) or toxic.all() or not toxic.any():
        model.p["ow"][:] = 0
        model.p["ob"][:] = 4.0 if len(toxic) and toxic.all() else -4.0
        return model
    mark, seen = marks(texts, toxic)
    ranked = sorted(mark, key=lambda w: (-abs(mark[w]) * min(1.0, seen[w] / 3), -seen[w], w))[: WORD_KINDS - 1]
    model.vocabulary = {w: k + 1 for k, w in enumerate(ranked)}
    model.p["words"] *= 0.1
    model.p["words"][0] = 0
    model.p["words"][1 : len(ranked) + 1, 0] = [0.5 * mark[w] for w in ranked]
    index = {"": 0}
    places = [[np.array([index.setdefault(w, len(index)) for w in x], np.int64) for x in t] for t in texts]
    words = list(index)
    chars, codes = char_codes(words), model.codes(words)
    target = np.array([mark.get(w, 0.0) for w in words], np.float32)

    steps, head = Steps(model.p, RATE), np.zeros(2 * CHAR_STATE + 1, np.float32)
    high = np.argsort(-target, kind="stable")[: max(32, min(len(words) // 4, int((target > 2).sum())))]
    for _ in range(SPELL_STEPS):
        some = np.concatenate([rng.choice(high, 128), rng.integers(0, len(words), 384)])
        g, d_head = model.spelling_step(chars[some], head, target[some])
        steps.take(model.p, g)
        head -= 0.1 * d_head

    def tops(which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds and number of the worst window of each text."""
        projected = np.concatenate([model.project(words[k : k + PLACES]) for k in range(0, len(words), PLACES)])
        flat = [(i, k) for i in which for k in range(len(places[i]))]
        logits = []
        for at in range(0, len(flat), PLACES):
            place, mask = padded([places[i][k] for i, k in flat[at : at + PLACES]])
            logits.append(model.read(projected[place], mask)[0])
        logits, best = np.concatenate(logits), {}
        for (i, k), x in zip(flat, logits):
            if i not in best or x > best[i][0]:
                best[i] = (x, k)
        return np.array([best[i][0] for i in which]), np.array([best[i][1] for i in which])

    bad, good = np.flatnonzero(toxic == 1), np.flatnonzero(toxic == 0)
    worst = {i: max(range(len(places[i])), key=lambda k: sum(np.sort(target[np.unique(places[i][k])])[-2:])) for i in bad}
    steps, hard, half = Steps(model.p, RATE), good, BATCH // 2
    for t in range(STEPS):
        if t == STEPS // 2:
            worst = dict(zip(bad, tops(bad)[1]))
            steps.rate = RATE / 3
        if t == STEPS * 2 // 3:
            score, where = tops(good)
            hard = good[np.argsort(-score, kind="stable")[: max(half, len(good) // 20)]]
            at = dict(zip(good, where))
        chosen = [places[i][worst[i]] for i in rng.choice(bad, half)]
        for i in rng.choice(hard if t % 2 else good, BATCH - half):
            chosen.append(places[i][at[i] if t % 2 and hard is not good else rng.integers(len(places[i]))])
        place, mask = padded(chosen)
        own, place = np.unique(place, return_inverse=True)
        y = np.repeat([1.0, 0.0], [half, BATCH - half]).astype(np.float32)
        steps.take(model.p, model.gradients(codes[own], chars[own], place.reshape(WINDOW, -1), mask, y)[1])
    score = np.concatenate([tops(bad)[0], tops(good)[0]])
    model.p["ob"] -= np.float32(balance(score, np.repeat([1, 0], [len(bad), len(good)])))
    return model


def padded(windows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(places of words (steps, rows), mask); rows end in padding, an empty one has one pad to read."""
    place, mask = np.zeros((WINDOW, len(windows)), np.int64), np.zeros((WINDOW, len(windows)), np.float32)
    for k, w in enumerate(windows):
        place[: len(w), k] = w
        mask[: max(1, len(w)), k] = 1
    return place, mask


def balance(scores: np.ndarray, y: np.ndarray) -> float:
    """What to take off log-odds so that the threshold falls where it parts the training texts best, in the middle of the gap."""
    cut = np.log(THRESHOLD / (1 - THRESHOLD))
    order = np.argsort(scores)
    s, right = scores[order], np.concatenate([[0], np.cumsum(1 - 2 * y[order])])
    best = np.flatnonzero(right == right.max())
    k = int(best[len(best) // 2])
    low, high = s[max(0, k - 1)], s[min(len(s) - 1, k)]
    return float((low + high) / 2 - cut)


class Scorer:
    """Scores batches of texts; remembers what recurrences take in for words seen before, up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {"": 0}
        self.projected = np.zeros((PLACES, 6 * WORD_STATE), np.float32)
        self.projected[:1] = self.model.project([""])

    def learn(self, words: list[str]) -> None:
        first = len(self.index)
        self.index.update(zip(words, range(first, first + len(words))))
        while len(self.index) > len(self.projected):
            self.projected = np.concatenate([self.projected, np.zeros_like(self.projected)])
        for at in range(0, len(words), PLACES):
            some = words[at : at + PLACES]
            self.projected[first + at : first + at + len(some)] = self.model.project(some)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if len(self.index) > MEMO:
            self.clear()
        split = [words_of(t) for t in texts]
        if new := list({w for x in split for w in x if w not in self.index}):
            self.learn(new)
        places, starts, lengths, owner, base = [], [], [], [], 0
        for k, x in enumerate(split):
            places.append(np.fromiter(map(self.index.__getitem__, x), np.int64, len(x)))
            for a, b in windows_of(len(x)):
                starts.append(base + a)
                lengths.append(b - a)
                owner.append(k)
            base += len(x)
        flat = np.concatenate([*places, np.zeros(WINDOW, np.int64)])
        starts, lengths, out = np.array(starts), np.array(lengths), np.full(len(texts), -np.inf)
        for at in range(0, len(starts), PLACES):
            s, n = starts[at : at + PLACES], lengths[at : at + PLACES]
            steps = np.arange(WINDOW)[:, None]
            mask = (steps < np.maximum(n, 1)).astype(np.float32)
            place = np.where(steps < n, flat[np.minimum(s + steps, len(flat) - 1)], 0)
            logit = self.model.read(self.projected[place], mask)[0]
            np.maximum.at(out, np.array(owner[at : at + PLACES]), logit)
        return sigmoid(out)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> Model:
    """The model, from at most ``sample`` labelled rows outside the held-out third (crc32 of doc_id modulo 3 is 1)."""
    usable = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    some = usable.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).orderBy(F.xxhash64("doc_id"), "toxic").limit(sample)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, toxic, text in zip(*(batch.column(c) for c in ("doc_id", "toxic", "text"))):
                yield pa.RecordBatch.from_arrays([pa.array([doc_id.as_py()], pa.int64()), pa.array([toxic.as_py()], pa.int32()), pa.array([" ".join(words_of(text.as_py()))])], ["doc_id", "toxic", "words"])

    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id")  # at most ``sample`` rows
    # Of rows of one doc_id the smallest text counts, so that there are no more texts than labels.
    held = materialise(joined.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "toxicity-sample")
    sizes = held.select("doc_id", "toxic", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"), F.xxhash64("doc_id").alias("key")).collect()
    kept, total = [], 0
    for r in sorted(sizes, key=lambda r: (r.key, r.doc_id, r.toxic)):
        if total + r.n <= SAMPLE_BYTES:
            kept.append((r.doc_id, r.toxic))
            total += r.n
    if len(kept) < len(sizes):
        held = held.join(F.broadcast(docs.sparkSession.createDataFrame(kept, "doc_id long, toxic int")), ["doc_id", "toxic"], "left_semi")
    rows = sorted((r.doc_id, r.toxic, r.words) for r in held.mapInArrow(cut, "doc_id long, toxic int, words string").collect())
    pool: dict[str, str] = {}
    texts = [[pool.setdefault(w, w) for w in r[2].split()] for r in rows]  # equal words are one object
    return fit([[t[a:b] for a, b in windows_of(len(t))] for t in texts], np.array([r[1] for r in rows]))


def with_score(docs: DataFrame, model: Model, name: str) -> DataFrame:
    """``docs`` and, as ``name``, the score; all other columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_on()
        scorer = Scorer(shared.value)
        for big in batches:
            for at in range(0, big.num_rows, 512):
                batch = big.slice(at, 512)
                yield batch.append_column(name, pa.array(scorer.score(batch.column("text").to_pylist()), pa.float64()))

    return text_batches(docs).mapInArrow(judge, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; only its text decides the score.

    Nulls: a null text is empty and scored as an empty window; a null doc_id is not held out. Labels that are null
    are not learned from; without labels of both kinds all scores are near 0 (or 1, if all labels are 1). Empty
    tables: an empty result. Repeated rows: one result each. Long texts: every window counts. Ties: equal texts have
    equal scores up to rounding. Other columns are not read, whatever their names.
    """
    scored = with_score(docs.select("doc_id", "text"), train(docs, labels, sample), "toxic_score")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of ``docs`` that are not toxic, with their own columns and values.

    Nulls, ties, repeated rows, long texts and empty tables: as in ``score_toxicity``; a text without words is kept.
    Columns of any name keep their values.
    """
    name = free_name("toxic_score", docs.columns)
    return with_score(docs, train(docs, labels, sample), name).where(F.col(name) < THRESHOLD).select(*[F.col(f"`{c}`") for c in docs.columns])
