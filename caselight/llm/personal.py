"""Personal data: fixed patterns, and a character-level bidirectional LSTM with CRF transitions that adds what they miss.

The network is trained in numpy from labelled spans: what the patterns find in a bounded sample, also rewritten in
ways that they do not know ("name (at) host dot com", numbers without a plus sign). Overlapping windows are decoded by
Viterbi: all but those that share no character with any stretch where a span could keep the rule of its kind; a document's spans of all windows are joined where a border has cut them, held against a rule of their kind,
and the heaviest set of spans that do not overlap is kept. Spans of the patterns always stay.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import first_rows, text_batches, working_on
from .toxicity import Steps, sigmoid

KINDS = ("email", "ip", "card", "phone")
#: Fixed patterns.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")

#: Windows of ``WINDOW`` characters start every ``STRIDE``; a span of up to 49 characters is whole in one of them.
WINDOW, STRIDE = 96, 48
TRIGGER = re.compile("[0-9@]")
SPELT = re.compile(r"\bat\b(?=[^\n]{1,48}?\bdot\b)", re.IGNORECASE)
#: What may be personal data that the patterns miss: a passage with any is no example.
DOUBTFUL = re.compile(r"@|[0-9](?:[ ()./_-]{0,3}[0-9]){9,}|[0-9]{1,3}(?:\W{1,5}(?:dot\W{1,3})?[0-9]{1,3}){3}|" + SPELT.pattern, re.IGNORECASE)
#: The network is trained on at most this many passages of each kind, and of passages without, of ``PASSAGE`` characters.
SAMPLE, PASSAGE = 300, 192
KINDS_OF_CHAR, CHAR_DIM, STATE = 160, 12, 16
#: Where an added span can lie, by ``plain_form``: around an @ or a spelt "at" before a domain; numbers, with what may stand between.
DOT = r"\s*+(?:[\[({<]\s*+)?(?:\.|dot)(?:\s*+[\])}>])?+\s*+"
AT = re.compile(rf"(?:@|(?<=[\s\[({{<])at(?=[\s\])}}>]))\s*+(?:[\])}}>]\s*+)?[A-Za-z0-9-]++(?:(?:{DOT}|(?<=-dot)\s*+(?:[\])}}>]\s*+)?)[A-Za-z0-9-]++)++", re.IGNORECASE)
LOCAL_BACKWARDS = re.compile(r"[A-Za-z0-9._%+\-\s\[\](){}<>]*+")
NUMBERS = re.compile(rf"[+(]{{0,2}}[0-9]++(?:(?:[ ()./_-]{{0,3}}+|{DOT})[0-9]++)*+", re.IGNORECASE)
LABELS = 1 + 2 * len(KINDS)  # outside; first and further characters of each kind
STEPS, BATCH, RATE = 360, 48, 0.02
READ = 512
RESULT = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
PASSAGES = "kind int, key long, text string, spans string"


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2]) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def is_byte(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def digits_of(text: str) -> str:
    return "".join(DIGIT.findall(text))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Around each @: all that may stand before it, then the domain; as the pattern finds them from left to right."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (domain := DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            last = domain.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of all that the patterns find, in order."""
    found = [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(map(is_byte, m.group().split(".")))]
        found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(d := digits_of(m.group())) <= 19 and luhn(d)]
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m.group())) <= 15]
    return sorted(found)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def spans_of(text: str) -> list[tuple[int, int, int]]:
    return [(int(a), KINDS.index(k), int(b)) for k, a, b in (s.split(":") for s in text.split(",") if s)]


def doubtful(text: str, spans: list[tuple[int, int, int]]) -> bool:
    """Whether there may be personal data in ``text`` outside the spans."""
    for a, _, b in spans:
        text = text[:a] + "x" * (b - a) + text[b:]
    return DOUBTFUL.search(text) is not None


def char_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(kinds of the characters of windows, mask), steps first."""
    points = np.frombuffer("".join(t.ljust(WINDOW, "\0") for t in texts).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, WINDOW).astype(np.int64)
    lengths = np.array([len(t) for t in texts])
    return np.where(points < 128, points, 128 + points % 32).T, (np.arange(WINDOW)[:, None] < lengths).astype(np.float32)


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


class Cell:
    """One direction of the LSTM over (steps, rows); padded steps keep state."""

    def __init__(self, p: dict[str, np.ndarray], name: str):
        self.p, self.name, self.n = p, name, p[name + "u"].shape[0]

    def run(self, x: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        n, u, kept, out = self.n, self.p[self.name + "u"], [], []
        h = c = np.zeros((x.shape[1], n), x.dtype)
        for now, m in zip(x, mask[:, :, None]):
            g = now + h @ u
            s, t = sigmoid(g[:, : 3 * n]), np.tanh(g[:, 3 * n :])
            i, f, o = s[:, :n], s[:, n : 2 * n], s[:, 2 * n :]
            new = f * c + i * t
            th = np.tanh(new)
            if keep:
                kept.append((h, c, i, f, o, t, th, m))
            c, h = c + m * (new - c), h + m * (o * th - h)
            out.append(h)
        return np.stack(out), kept

    def back(self, d_out: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
        """(gradient of the inputs, of the recurrent weights)."""
        u = self.p[self.name + "u"]
        dh, dc, du, dx = np.zeros_like(d_out[0]), np.zeros_like(d_out[0]), np.zeros_like(u), []
        for d, (h, c, i, f, o, t, th, m) in zip(d_out[::-1], kept[::-1]):
            dh = dh + d
            dnew = m * (dc + dh * o * (1 - th * th))
            dg = np.concatenate([dnew * t * i * (1 - i), dnew * c * f * (1 - f), m * dh * th * o * (1 - o), dnew * i * (1 - t * t)], 1)
            du += h.T @ dg
            dx.append(dg)
            dc = dc * (1 - m) + dnew * f
            dh = dh * (1 - m) + dg @ u.T
        return np.stack(dx[::-1]), du


class Tagger:
    """Character embeddings, an LSTM in both directions, scores of labels, and a linear-chain CRF over them."""

    def __init__(self, seed: int = 7, dtype: type = np.float32):
        rng = np.random.default_rng(seed)

        def made(*shape: int) -> np.ndarray:
            return (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(dtype)

        self.p = {"chars": made(KINDS_OF_CHAR, CHAR_DIM) * dtype(4), "ow": made(2 * STATE, LABELS), "ob": np.zeros(LABELS, dtype), "next": made(LABELS, LABELS), "first": np.zeros(LABELS, dtype)}
        for name in "fb":
            self.p |= {name + "w": made(CHAR_DIM, 4 * STATE), name + "u": made(STATE, 4 * STATE), name + "b": np.zeros(4 * STATE, dtype)}

    def scores(self, codes: np.ndarray, mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        """Scores of the labels of each character."""
        p, states, kept = self.p, [], []
        for name, turn in (("f", slice(None)), ("b", slice(None, None, -1))):
            table = p["chars"] @ p[name + "w"] + p[name + "b"]
            out, k = Cell(p, name).run(table[codes[turn]], mask[turn], keep)
            states.append(out[turn])
            kept.append(k)
        both = np.concatenate(states, 2)
        return both @ p["ow"] + p["ob"], (both, kept)

    def forward(self, scores: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Log-sums of all paths up to each step."""
        alpha = [self.p["first"] + scores[0]]
        for s, m in zip(scores[1:], mask[1:, :, None]):
            alpha.append(np.where(m > 0, log_sum(alpha[-1][:, :, None] + self.p["next"], 1) + s, alpha[-1]))
        return np.stack(alpha)

    def gradients(self, codes: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the labels ``y`` (steps, rows), and its gradients."""
        p, rows = self.p, codes.shape[1]
        scores, (both, kept) = self.scores(codes, mask, True)
        alpha, one = self.forward(scores, mask), np.arange(rows)
        total = log_sum(alpha[-1], 1)
        beta = np.zeros_like(alpha)
        for t in range(len(scores) - 2, -1, -1):
            beta[t] = np.where(mask[t + 1][:, None] > 0, log_sum(p["next"] + (scores[t + 1] + beta[t + 1])[:, None, :], 2), beta[t + 1])
        d_scores = np.exp(alpha + beta - total[:, None]) * mask[:, :, None]
        d_first, d_next = d_scores[0].sum(0), np.zeros_like(p["next"])
        np.add.at(d_first, y[0], -1)
        gold = p["first"][y[0]] + scores[0, one, y[0]]
        for t in range(1, len(scores)):
            m = mask[t]
            pair = alpha[t - 1][:, :, None] + p["next"] + (scores[t] + beta[t])[:, None, :] - total[:, None, None]
            d_next += (np.exp(pair) * m[:, None, None]).sum(0)
            np.add.at(d_next, (y[t - 1], y[t]), -m)
            gold = gold + m * (p["next"][y[t - 1], y[t]] + scores[t, one, y[t]])
        for t in range(len(scores)):
            d_scores[t, one, y[t]] -= mask[t]
        d_scores = (d_scores / rows).astype(scores.dtype)
        flat = d_scores.reshape(-1, LABELS)
        g = {"first": d_first / rows, "next": d_next / rows, "ow": both.reshape(len(flat), -1).T @ flat, "ob": flat.sum(0)}
        d_both, g["chars"] = d_scores @ p["ow"].T, 0
        for k, (name, turn) in enumerate((("f", slice(None)), ("b", slice(None, None, -1)))):
            dx, g[name + "u"] = Cell(p, name).back(d_both[turn][:, :, k * STATE : (k + 1) * STATE], kept[k])
            dx = dx[turn]
            d_table = np.zeros((KINDS_OF_CHAR, 4 * STATE), dx.dtype)
            np.add.at(d_table, codes.ravel(), dx.reshape(-1, 4 * STATE))
            g[name + "w"], g[name + "b"] = p["chars"].T @ d_table, d_table.sum(0)
            g["chars"] = g["chars"] + d_table @ p[name + "w"].T
        return float((total - gold).mean()), g

    def decode(self, codes: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(labels of the best path, how far the score of each label is above that of none), steps first."""
        scores = self.scores(codes, mask)[0]
        best, came = self.p["first"] + scores[0], []
        for s, m in zip(scores[1:], mask[1:]):
            paths = best[:, :, None] + self.p["next"]
            came.append(np.where(m[:, None] > 0, paths.argmax(1), np.arange(LABELS)))
            best = np.where(m[:, None] > 0, paths.max(1) + s, best)
        rows, labels = np.arange(codes.shape[1]), [best.argmax(1)]
        for back in came[::-1]:
            labels.append(back[rows, labels[-1]])
        labels = np.stack(labels[::-1])
        return labels, np.take_along_axis(scores, labels[:, :, None], 2)[:, :, 0] - scores[:, :, 0]


def labels_of(length: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Labels of characters; of spans that overlap the earlier one counts."""
    y = np.zeros(length, np.int64)
    for a, k, b in spans:
        if not y[max(a, 0) : b].any():
            y[max(a, 0) : b] = 2 + 2 * k
            if 0 <= a < length:
                y[a] = 1 + 2 * k
    return y


def rewritten(kind: int, text: str, rng: np.random.Generator) -> tuple[str, str, str]:
    """(what stands before, a span of the kind written in a way that patterns may miss, what follows)."""

    def one(*ways: str) -> str:
        return ways[rng.integers(len(ways))]

    digits = digits_of(text)
    if kind == 0:
        dot = one(" dot ", "[dot]", "(dot)", ".", " (dot) ", " DOT ", " [dot] ")
        at = one(" at ", " (at) ", "[at]", "(at)", " AT ", " [at] ", "{at}", " @ ") if dot.strip() != "." else one(" (at) ", "[at]", "(at)", " [at] ", "{at}", " @ ")
        local, _, domain = text.partition("@")
        return "", local + at + domain.replace(".", dot), ""
    if kind == 1:
        return "", text.replace(".", one("[.]", "(.)", "[dot]", " dot ", " . ")), ""
    if kind == 2:
        if rng.random() < 0.4:
            return f"{rng.integers(1, 99999)} ", digits, ""
        return "", one(".", "/", "  ", " - ", "_").join(digits[k : k + 4] for k in range(0, len(digits), 4)), ""
    local = digits[-10:]
    a, b, c = local[:3], local[3:6], local[6:]
    return "", one(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"001 {a} {b} {c}", f"1-{a}-{b}-{c}", f"{a} {b} {c}", f"+1/{a}/{b}/{c}"), ""


def unlike(rng: np.random.Generator) -> str:
    """Numbers that are no personal data."""
    n = rng.integers(0, 10, 24)
    d = "".join(map(str, n))
    ways = (f"20{d[:2]}-0{1 + n[2] % 9}-1{d[3]}", f"{n[0]}{n[1]}:{n[2]}{n[3]}:{n[4]}{n[5]}", f"v{n[0]}.{n[1]}.{n[2]}", f"No. {d[:6]}", f"{n[0]},{d[1:4]},{d[4:7]}.{d[7:9]}", d[: 5 + n[0]], d[:20], f"978-3-16-{d[:6]}-{n[9]}", "0x" + rng.bytes(8).hex(), f"page {n[0]} of {d[:2]}")
    return ways[rng.integers(len(ways))]


def fit(passages: list[tuple[int, str, list[tuple[int, int, int]]]], seed: int = 7) -> Tagger:
    """A tagger from passages (kind, text, spans); of each kind as many are drawn."""
    rng, model = np.random.default_rng(seed), Tagger(seed)
    pools = [p for p in ([x for x in passages if x[0] == k] for k in range(len(KINDS) + 2)) if p]
    if not any(p[0][0] < len(KINDS) for p in pools):
        model.p["ob"][0] = 50
        return model
    steps = Steps(model.p, RATE)
    for t in range(STEPS):
        if t == STEPS * 2 // 3:
            steps.rate = RATE / 4
        texts, labels = [], []
        for k in range(BATCH):
            pool = pools[k % len(pools)]
            kind, text, spans = pool[rng.integers(len(pool))]
            if kind < len(KINDS) and rng.random() < 0.6:
                a, own, b = spans[min(range(len(spans)), key=lambda i: (spans[i][1] != kind, abs(spans[i][0] + spans[i][2] - len(text))))]
                if own == kind:
                    before, new, after = rewritten(kind, text[a:b], rng)
                    text, spans = text[:a] + before + new + after + text[b:], [(a + len(before), kind, a + len(before) + len(new))]
            elif kind >= len(KINDS) and rng.random() < 0.5:
                at, new = text.find(" ", len(text) // 2) + 1, unlike(rng)
                text, spans = text[:at] + new + " " + text[at:], [(a + (a >= at) * (len(new) + 1), own, b + (a >= at) * (len(new) + 1)) for a, own, b in spans]
            y = labels_of(len(text), spans)
            at = int(rng.integers(0, max(1, len(text) - WINDOW + 1)))
            texts.append(text[at : at + WINDOW])
            labels.append(np.pad(y[at : at + WINDOW], (0, max(0, WINDOW - len(y[at : at + WINDOW])))))
        steps.take(model.p, model.gradients(*char_codes(texts), np.stack(labels, 1))[1])
    return model


def plain_form(kind: int, text: str) -> str | None:
    """What an added span says, in the form of the patterns; None if it breaks the rule of its kind."""
    digits = digits_of(text)
    if kind < 2:
        text = re.sub(r"\s*[\[({<]?\s*(?:\.|\bdot\b)\s*[\])}>]?\s*", ".", text, flags=re.IGNORECASE)
        if kind:
            return text if IP.fullmatch(text) and all(map(is_byte, text.split("."))) else None
        text = re.sub(r"\s*[\[({<]\s*(?:@|at)\s*[\])}>]\s*|\s*@\s*|\s+at\s+", "@", text, flags=re.IGNORECASE)
        local, at, domain = text.partition("@")
        return text if at and local and LOCAL.issuperset(local) and DOMAIN.fullmatch(domain) and domain.rpartition(".")[2].isalpha() and len(domain.rpartition(".")[2]) > 1 else None
    if kind == 2:
        return digits if 14 <= len(digits) <= 19 and luhn(digits) and re.fullmatch(r"[0-9](?:[ ./_-]{0,3}[0-9])+", text) else None
    marks = len(re.findall("[^0-9]+", text))
    return "+" + digits if 10 <= len(digits) <= 15 and marks >= 2 and re.fullmatch(r"[+(]{0,2}[0-9](?:[ ()./-]{0,3}[0-9])+", text) else None


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of the text such that any span that keeps the rule of its kind (``plain_form``) lies in one of them."""
    last = 0
    for m in AT.finditer(text):  # the part before it as far back as its characters reach, or to the last one found
        yield m.start() - LOCAL_BACKWARDS.match(text[last : m.start()][::-1]).end(), m.end()
        last = m.start()
    for m in NUMBERS.finditer(text):
        yield m.span()


def window_starts(text: str) -> list[int]:
    """Starts of all windows that share a character with a region: what the network finds in others breaks every rule."""
    last = max(0, -(-(len(text) - WINDOW) // STRIDE))
    return sorted({k * STRIDE for a, b in regions(text) for k in range(max(0, (a - WINDOW) // STRIDE + 1), min(last, (b - 1) // STRIDE) + 1)})


def pieces(labels: np.ndarray, over: np.ndarray, length: int) -> Iterator[tuple[int, int, int, float]]:
    """(start, kind, end, weight) of the runs of labels of one window."""
    a = 0
    while a < length:
        if not labels[a]:
            a += 1
            continue
        kind, b = (labels[a] - 1) // 2, a + 1
        while b < length and labels[b] == 2 + 2 * kind:
            b += 1
        yield a, int(kind), b, float(over[a:b].sum())
        a = b


def reconciled(text: str, found: list[tuple[int, int, int, float]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What is added to the spans of the patterns: of all windows' spans, joined where windows overlap, those that keep the
    rule of their kind and overlap no other, as heavy as can be."""
    joined: dict[tuple[int, int, int], float] = {}
    for kind in range(len(KINDS)):
        run = None
        for a, k, b, weight in sorted(x for x in found if x[1] == kind):
            joined[a, kind, b] = max(weight, joined.get((a, kind, b), weight))
            if run and a <= run[1]:
                run = (run[0], max(run[1], b), run[2] + weight)
                joined[run[0], kind, run[1]] = max(run[2], joined.get((run[0], kind, run[1]), 0.0))
            else:
                run = (a, b, weight)
    starts, reached, rows = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max)), {}
    for (a, kind, b), weight in joined.items():
        for span in snapped(text, a, b):
            k = bisect_left(starts, span[1])
            if not (k and reached[k - 1] > span[0]) and plain_form(kind, text[span[0] : span[1]]):
                rows[span[0], kind, span[1]] = max(weight, rows.get((span[0], kind, span[1]), 0.0))
                break
    ordered = sorted(rows.items(), key=lambda x: (x[0][2], x[0][0], x[0][1]))
    ends, best, taken = [x[0][2] for x in ordered], [0.0], [()]
    for (a, kind, b), weight in ordered:
        k = bisect_left(ends, a + 1)
        if k < len(best) and best[k] + max(weight, 1e-6) > best[-1]:
            best.append(best[k] + max(weight, 1e-6))
            taken.append((taken[k], (a, kind, b)))
        else:
            best.append(best[-1])
            taken.append(taken[-1])
    out, chain = [], taken[-1]
    while chain:
        chain, span = chain
        out.append(span)
    return out[::-1]


def snapped(text: str, a: int, b: int) -> list[tuple[int, int]]:
    """Where a span may lie that was found from a to b: with the rest of words that its ends cut, as it is, or without some
    of its first and last words; the longest first."""
    while a < b and text[a] in " ,;:\n\t":
        a += 1
    while b > a and text[b - 1] in " ,;:.\n\t":
        b -= 1
    low, high = a, b
    while low > 0 and b - low < 2 * WINDOW and (text[low - 1].isalnum() or text[low - 1] in "._%+-("):
        low -= 1
    while high < len(text) and high - a < 2 * WINDOW and text[high].isalnum():
        high += 1
    blanks = [k for k in range(a + 1, b - 1) if text[k] == " "]
    starts, ends = {low, a, *(k + 1 for k in blanks[:16])}, {high, b, *blanks[-16:]}
    return sorted(((x, y) for x in starts for y in ends if x < y), key=lambda s: (s[0] - s[1], s))


def sample_passages(docs: DataFrame, each: int = SAMPLE) -> list[tuple[int, str, list[tuple[int, int, int]]]]:
    """At most ``each`` passages of every kind, of numbers that are none, and of prose: those with the smallest hashes of their texts, of all documents."""
    from xxhash import xxh3_64_intdigest

    def cut(text: str, spans: list[tuple[int, int, int]], kind: int, middle: int) -> tuple[int, int, str, str]:
        at = max(0, middle - PASSAGE // 2)
        part = text[at : at + PASSAGE]
        own = [(max(a - at, 0), k, min(b - at, len(part))) for a, k, b in spans if a < at + len(part) and b > at]
        return kind, xxh3_64_intdigest(part) >> 1, part, written(own)

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_on()
        held: list[dict[str, tuple]] = [{} for _ in range(len(KINDS) + 2)]
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if not text:
                    continue
                spans = base_spans(text)
                some = [cut(text, spans, k, (a + b) // 2) for a, k, b in spans]
                some.append(cut(text, spans, len(KINDS) + 1, len(text) // 2))
                at, place = 0, 0
                for m in TRIGGER.finditer(text):
                    while place < len(spans) and spans[place][2] <= m.start():
                        place += 1
                    if m.start() >= at and (place == len(spans) or m.start() < spans[place][0]):
                        some.append(cut(text, spans, len(KINDS), m.start()))
                        at = m.start() + PASSAGE
                for x in some:
                    if not doubtful(x[2], spans_of(x[3])):
                        held[x[0]][x[2]] = x
            for k, x in enumerate(held):
                if len(x) > 4 * each:
                    held[k] = {r[2]: r for r in sorted(x.values())[:each]}
        rows = [r for x in held for r in sorted(x.values())[:each]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int32(), pa.int64(), pa.string(), pa.string()))], ["kind", "key", "text", "spans"])

    found = text_batches(docs).select("text").mapInArrow(passages, PASSAGES).dropDuplicates(["kind", "text"])
    rows = first_rows(found, "kind", ["key", "text"], each).collect()
    return sorted((r.kind, r.text, spans_of(r.spans)) for r in rows)


def find_personal(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """``RESULT``: numbers and digest of the spans that the patterns find (``n_*``, ``base_sha256``), and all spans.

    Nulls: a null text is empty, a null doc_id stays. Repeated rows: one result each. Ties: of added spans that overlap
    and weigh the same the one that ends first stays. Long texts are read whole. Empty table: an empty result. Other
    columns are not read, so their names cannot clash. Without labelled spans the network adds nothing. Nothing is shuffled.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(sample_passages(docs)))  # of a fixed size

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_on()
        for big in batches:
            for at in range(0, big.num_rows, 128):
                batch = big.slice(at, 128)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                base = [base_spans(t) for t in texts]
                added = add(texts, base)
                counts = [[sum(k == kind for _, k, _ in b) for b in base] for kind in range(len(KINDS))]
                digests = [sha256(written(b).encode()).hexdigest() for b in base]
                spans = [written(sorted(b + more)) for b, more in zip(base, added)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests), pa.array(spans)], [c.split()[0] for c in RESULT.split(", ")])

    def add(texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
        places = [(k, s) for k, t in enumerate(texts) for s in window_starts(t)]
        found: list[list[tuple[int, int, int, float]]] = [[] for _ in texts]
        for at in range(0, len(places), READ):
            some = places[at : at + READ]
            codes, mask = char_codes([texts[k][s : s + WINDOW] for k, s in some])
            labels, over = shared.value.decode(codes, mask)
            for row in np.flatnonzero((labels * (mask > 0)).any(0)).tolist():
                k, s = some[row]
                found[k] += [(s + a, kind, s + b, w) for a, kind, b, w in pieces(labels[:, row], over[:, row], int(mask[:, row].sum()))]
        return [reconciled(t, f, b) if f else [] for t, f, b in zip(texts, found, base)]

    return text_batches(docs).mapInArrow(find, RESULT)
