"""Phrase collocations: frequent runs of words by Misra-Gries summaries, then exact counts and scores.

Runs of words are dealt into hash partitions. Tasks sum up what they read as summaries, a row per partition; a
partition's summaries are merged into one of more counters than its mass divided by the threshold, so that no run
that is frequent enough can lose its counter. What survives is marked in a bitmap of bounded size; a second pass over
the texts counts the marked runs exactly, by their words. Longer runs are looked at only where all their pairs survive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .bpe import slices
from .shared import broadcast_if_small, discard, first_rows, materialise, text_batches, working_on

NO_LANG = "und"
#: The capacity of a summary is this many times what the guarantee needs: errors are as many times smaller.
SLACK = 4
#: Counters that a task holds before it sends them, and counters a row.
HELD, ROW = 1_000_000, 4096
#: Rows of counted phrases that a task holds before it adds up equal ones; it sends them if more than half are left.
HELD_ROWS = 600_000
#: Bytes of text a hash partition, and the most bits that tell partitions.
PART_BYTES, PART_BITS = 32 << 20, (4, 16)
#: Bits of the bitmap for each survivor, and the most bits altogether (128 MiB).
MARKS, MARK_BITS = 32, (15, 30)
SUMMARY = "part int, kind int, mass long, keys binary, counts binary"
COUNTED = "lang string, phrase string, words int, f long"


@dataclass(frozen=True)
class Mining:
    """Fewest occurrences of a phrase, most words of one, phrases reported a language."""

    least: int = 100
    longest: int = 5
    top: int = 2000


@dataclass
class Words:
    """The words of some texts in order: number in ``names``, run (words of one piece are of one run) and language of each."""

    names: pa.Array
    code: np.ndarray
    run: np.ndarray
    lang: np.ndarray
    langs: list[str]


def words_of(batch: pa.RecordBatch) -> Words:
    """Pieces end at ``.,;:!?`` and line ends, words at spaces and tabs; A-Z are lower-cased."""
    text = pc.ascii_lower(pc.fill_null(batch.column("text"), "")).cast(pa.large_string())  # a slice that is cast first is read at wrong places
    text = pc.replace_substring_regex(pc.replace_substring(text, "\t", " "), "[.,;:!?\\x0A-\\x0D]", " \n ")
    lists = pc.split_pattern(text, " ")
    coded = lists.flatten().dictionary_encode()
    code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    owner = np.repeat(np.arange(len(text)), np.diff(lists.offsets.to_numpy()))
    places = {n: pc.index(names, pa.scalar(n, names.type)).as_py() for n in ("", "\n")}
    end = code == places["\n"]
    run = np.cumsum(end) + owner  # grows at the end of each piece and of each text
    word = ~end & (code != places[""])
    langs = pc.fill_null(batch.column("lang"), NO_LANG).dictionary_encode()
    return Words(names, code[word], run[word], langs.indices.to_numpy().astype(np.int64)[owner[word]], langs.dictionary.to_pylist())


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


def hashes(w: Words, sizes: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, hash of the run that starts at each word, whether it lies in one piece) for each of ``sizes``, in order."""
    from xxhash import xxh3_64_intdigest

    def of(names: list[str]) -> np.ndarray:
        return np.fromiter(map(xxh3_64_intdigest, names), np.uint64, len(names))

    own = of(w.names.to_pylist())[w.code]
    total, n = of(w.langs)[w.lang] if len(w.code) else own, len(w.code)
    for size in range(1, max(sizes) + 1):
        n = max(0, len(w.code) - size + 1)
        total = total[:n] * np.uint64(0x9FB21C651E98DF25) + own[size - 1 : size - 1 + n]
        if size in sizes:
            yield size, mixed(total ^ np.uint64(size)), w.run[:n] == w.run[size - 1 : size - 1 + n]


class Marks:
    """A bitmap of survivors: never misses one, and marks few others."""

    def __init__(self, bits: np.ndarray, shift: int):
        self.bits, self.shift = bits, np.uint64(shift)

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> self.shift
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with the sums of their counts."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k = k[order]
    starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return k[starts], np.add.reduceat(c[order], starts) if len(k) else c


class MisraGries:
    """A mergeable summary: of a stream of ``mass`` it misses at most ``taken`` <= mass / (capacity + 1) of any key's count."""

    def __init__(self, capacity: int):
        self.capacity, self.taken = capacity, 0
        self.keys, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        self.pending: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.pending.append((keys, counts))
        self.held += len(keys)
        if self.held > max(HELD, self.capacity):
            self.settle()

    def settle(self) -> None:
        self.keys, self.counts = merged([self.keys, *(k for k, _ in self.pending)], [self.counts, *(c for _, c in self.pending)])
        self.pending, self.held = [], 0
        if (over := len(self.keys) - self.capacity) > 0:
            cut = int(np.partition(self.counts, over - 1)[over - 1])  # the largest count that gets no counter
            left = self.counts > cut
            self.keys, self.counts, self.taken = self.keys[left], self.counts[left] - cut, self.taken + cut

    def reaching(self, least: int) -> np.ndarray:
        """All keys that may occur ``least`` times."""
        self.settle()
        return self.keys[self.counts + self.taken >= least]


def survivors(docs: DataFrame, sizes: tuple[int, ...], mining: Mining, bits: int, pairs: object = None) -> DataFrame:
    """(key): hashes, of ``bits + 32`` bits, of all runs of ``sizes`` words that may be frequent enough, and of few others.

    pairs: the broadcast marks of pairs; runs of which a pair is not marked are left out.
    """
    shift = np.uint64(32 - bits)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_on()
        held, mass, n = ([], []), np.zeros(1 << bits, np.int64), 0
        most = max(HELD, 64 << bits)  # so that a row has many counters however many partitions there are
        for big in batches:
            for batch in slices(big):
                for key, count in found(words_of(batch)):
                    held[0].append(key)
                    held[1].append(count)
                    n += len(key)
                if n > 2 * most:
                    keys, counts = merged(*held)
                    held, n = ([keys], [counts]), len(keys)
                if n > most:
                    yield from sent(*merged(*held), mass)
                    held, n = ([], []), 0
        if n:
            yield from sent(*merged(*held), mass)
        full = np.flatnonzero(mass)
        if len(full):
            none = pa.nulls(len(full), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.zeros(len(full), np.int32)), pa.array(mass[full]), none, none], ["part", "kind", "mass", "keys", "counts"])

    def found(w: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        marked = None
        if pairs is not None:
            marked = next(pairs.value.has(h) & whole for _, h, whole in hashes(w, (2,)))
        for size, h, whole in hashes(w, sizes):
            if marked is not None:
                for k in range(size - 1):
                    whole = whole & marked[k : k + len(whole)]
            keys, counts = np.unique(h[whole] >> shift, return_counts=True)
            yield keys, counts

    def sent(keys: np.ndarray, counts: np.ndarray, mass: np.ndarray) -> Iterator[pa.RecordBatch]:
        part = (keys >> np.uint64(32)).astype(np.int32)
        mass += np.bincount(part, counts, 1 << bits).astype(np.int64)
        edges = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        spans = [(s, min(s + ROW, b)) for a, b in zip(edges, edges[1:]) for s in range(a, b, ROW)]
        low, count = keys.astype("<u4"), counts.astype("<i8")
        for at in range(0, len(spans), 256):
            some = spans[at : at + 256]
            ones = np.ones(len(some), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(part[[a for a, _ in some]]), pa.array(ones), pa.array(ones.astype(np.int64) * 0), pa.array([low[a:b].tobytes() for a, b in some]), pa.array([count[a:b].tobytes() for a, b in some])], ["part", "kind", "mass", "keys", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_on()
        now, mass, summary = None, 0, None

        def ended() -> Iterator[pa.RecordBatch]:
            if summary is not None:
                yield pa.RecordBatch.from_arrays([pa.array((np.int64(now) << 32) + summary.reaching(mining.least).astype(np.int64))], ["key"])

        for batch in batches:
            for part, kind, more, keys, counts in zip(*(batch.column(c) for c in ("part", "kind", "mass", "keys", "counts"))):
                if part.as_py() != now:
                    yield from ended()
                    now, mass, summary = part.as_py(), 0, None
                if kind.as_py() == 0:  # the masses of a partition come before its summaries
                    mass += more.as_py()
                    continue
                summary = summary or MisraGries(SLACK * mass // mining.least + 1)
                summary.add(np.frombuffer(keys.as_buffer(), "<u4"), np.frombuffer(counts.as_buffer(), "<i8"))
        yield from ended()

    sums = text_batches(docs).mapInArrow(summarise, SUMMARY)
    return sums.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(merge, "key long")


def marks(keys: DataFrame, bits: int):
    """The broadcast bitmap of ``keys``, of at most 2 ** 30 bits."""
    size = min(bits + 32, MARK_BITS[1], max(MARK_BITS[0], int(MARKS * keys.count()).bit_length()))
    at = F.shiftright("key", bits + 32 - size) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()  # 4 KiB a bucket
    found = np.zeros((1 << size) // 8, np.uint8)
    for r in rows:
        here = np.frombuffer(r.bits, np.uint8)
        found[(r.bucket - 1) * len(here) : r.bucket * len(here)] = here
    return keys.sparkSession.sparkContext.broadcast(Marks(found, 64 - size))


def exact_counts(docs: DataFrame, mining: Mining, short: object, long: object) -> DataFrame:
    """``COUNTED``: all runs of words that occur often enough, counted by their words; the words of a language as its run of none."""
    sizes = tuple(range(1, mining.longest + 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_on()
        held, n = [], 0
        for big in batches:
            for batch in slices(big):
                for some in counted(words_of(batch)):
                    held.append(some)
                    n += some.num_rows
                if n > HELD_ROWS:
                    held = added_up(held)
                    n = sum(some.num_rows for some in held)
                if n > HELD_ROWS // 2 and len(held) == 1:
                    yield from pa.Table.from_batches(held).to_batches(ROW)
                    held, n = [], 0
        if held:
            yield from pa.Table.from_batches(added_up(held)).to_batches(ROW)

    def counted(w: Words) -> Iterator[pa.RecordBatch]:
        if not len(w.code):
            return
        total = np.bincount(w.lang, minlength=len(w.langs))
        yield rows([pa.array(w.langs), pa.array([""] * len(w.langs)), total], 0)
        pairs = None
        for size, h, whole in hashes(w, sizes):
            at = np.flatnonzero(whole & (short if size < 3 else long).value.has(h))
            if size == 2:
                pairs = np.zeros(len(whole) + 1, bool)
                pairs[at] = True
            for k in range(size - 1 if size > 2 else 0):
                at = at[pairs[at + k]]
            if len(at):
                yield rows(distinct(w, at, size), size)

    def added_up(held: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
        """One batch with a row for each phrase of a language."""
        table = pa.Table.from_batches(held).group_by(["lang", "phrase", "words"], use_threads=False).aggregate([("f", "sum")])
        return table.select(["lang", "phrase", "words", "f_sum"]).rename_columns(["lang", "phrase", "words", "f"]).combine_chunks().to_batches()

    def distinct(w: Words, at: np.ndarray, size: int) -> list:
        number = w.lang[at]
        for k in range(size):  # runs get equal numbers if their words are equal
            number = np.unique(number * len(w.names) + w.code[at + k], return_inverse=True)[1]
        _, first, counts = np.unique(number, return_index=True, return_counts=True)
        first = at[first]
        words = [w.names.take(pa.array(w.code[first + k])) for k in range(size)]
        return [pa.array(w.langs).take(pa.array(w.lang[first])), pc.binary_join_element_wise(*words, pa.scalar(" ", w.names.type)) if size > 1 else words[0], counts]

    def rows(columns: list, size: int) -> pa.RecordBatch:
        lang, phrase, counts = columns
        return pa.RecordBatch.from_arrays([lang.cast(pa.string()), phrase.cast(pa.string()), pa.array(np.full(len(counts), size, np.int32)), pa.array(counts.astype(np.int64))], ["lang", "phrase", "words", "f"])

    found = text_batches(docs).mapInArrow(count, COUNTED)
    return found.groupBy("lang", "phrase", "words").agg(F.sum("f").alias("f")).where((F.col("words") == 0) | (F.col("f") >= mining.least))


def scored(counts: DataFrame, mining: Mining) -> DataFrame:
    """(lang, phrase, words, a, l, r, n, score) of every candidate: the cut with the lowest score counts."""
    phrases = counts.where("words > 0").select("lang", "phrase", F.col("f").cast("decimal(19,0)").alias("f"))
    totals = broadcast_if_small(counts.where("words = 0").select("lang", F.col("f").cast("decimal(16,0)").alias("n")))
    word = F.split("phrase", " ")
    cuts = F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(k.alias("k"), F.array_join(F.slice(word, F.lit(1), k), " ").alias("head"), F.array_join(F.slice(word, k + 1, F.size(word)), " ").alias("tail")))
    rows = counts.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.inline(cuts))
    rows = rows.join(phrases.withColumnsRenamed({"phrase": "head", "f": "l"}), ["lang", "head"]).join(phrases.withColumnsRenamed({"phrase": "tail", "f": "r"}), ["lang", "tail"]).join(totals, "lang")
    score = F.expr("(CAST(1000 * CAST(a AS decimal(16,0)) AS decimal(19,0)) * n) div (l * r)")  # at most 10^35 over 10^38, exact
    best = rows.withColumn("score", score).groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r", "n")).alias("best"))
    return best.select("lang", "phrase", "words", "a", *(F.col(f"best.{c}").cast("long").alias(c) for c in ("l", "r", "n", "score")))


def not_inside(rows: DataFrame) -> DataFrame:
    """``rows`` without phrases that only occur inside a longer one. It is enough to look one word further: what lies between a
    phrase and a longer one of equal count has that count too."""
    word, at = F.split("phrase", " "), F.col("words") - 1
    inner = rows.where("words > 2").select("lang", "a", F.explode(F.array(F.array_join(F.slice(word, F.lit(1), at), " "), F.array_join(F.slice(word, F.lit(2), at), " "))).alias("phrase"))
    return rows.join(inner, ["lang", "phrase", "a"], "left_anti")


def mine_phrases(docs: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best collocations of each language.

    Nulls: a null text is empty, a null language is ``und``. Repeated rows count each. Ties: by count, then by phrase in
    byte order. Long texts are read whole; a run of words never leaves its piece. Empty table: an empty result.
    Other columns are not read, so their names cannot clash. Summaries hold hashes, which only adds candidates:
    counts that decide are by words.
    """
    docs = docs.select("text", "lang")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(PART_BITS[1], max(PART_BITS[0], (size // PART_BYTES).bit_length()))
    tables, found = [], []
    for sizes in ((1, 2), tuple(range(3, mining.longest + 1))):
        tables.append(materialise(survivors(docs, sizes, mining, bits, found[0] if found else None), "phrase-survivors"))
        found.append(marks(tables[-1], bits))
    counts = materialise(exact_counts(docs, mining, *found), "phrase-counts")
    for t in tables:
        discard(t)
    candidates = materialise(scored(counts, mining), "phrase-scores")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    return first_rows(not_inside(candidates), "lang", order, mining.top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ORACLE = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS HUGEINT) AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM w, range(1, 6) AS t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.k, c.phrase, c.a, c.cut, x.f AS l, y.f AS r, n.n, 1000 * c.a * n.n // (x.f * y.f) AS score
      FROM c JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.cut + 1:], ' ') JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM b WHERE NOT EXISTS (SELECT 1 FROM b z WHERE z.lang = b.lang AND z.k > b.k AND z.a >= b.a AND contains(' ' || z.phrase || ' ', ' ' || b.phrase || ' '))
QUALIFY rank <= 2000
"""
