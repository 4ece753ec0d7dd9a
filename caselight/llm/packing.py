"""Packing documents into fixed-length training sequences.

First-fit decreasing with a tournament tree of free bin space, on its own in each randomised group of
documents; then the emptiest bins of a group are cut up to fill what is left free in its fuller ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .bpe import encoder, load_tokenizer, slices, tokenizer_path
from .shared import text_batches, working_on

GROUP_DOCS = 2048
BIN_BITS = 24
#: Bytes of ids after which a group is packed in parts.
GROUP_BYTES = 64 << 20
#: Free space below this many tokens is left as padding, so that no document is cut into shreds.
LEAST_CUT = 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class TournamentTree:
    """Free space of bins in a row; finds the first bin with enough room by descending from the root."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.best = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        best, k = self.best, 1
        while k < self.leaves:
            k *= 2
            if best[k] < size:
                k += 1
        best[k] -= size
        found = k - self.leaves
        while k > 1:
            k //= 2
            top = max(best[2 * k], best[2 * k + 1])
            if best[k] == top:
                break
            best[k] = top
        return found


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins as lists of item numbers. Ties of size: by item number."""
    tree, bins = TournamentTree(len(sizes), capacity), []
    for item in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        k = tree.place(sizes[item])
        if k == len(bins):
            bins.append([])
        bins[k].append(item)
    return bins


def fill_up(bins: list[list[tuple[int, int, int]]], capacity: int, least: int) -> list[list[tuple[int, int, int]]]:
    """Cut pieces (document, start, length) of the emptiest bins into the free space of the fuller ones."""
    bins = sorted(bins, key=lambda b: -sum(p[2] for p in b))
    for k, filled in enumerate(bins):
        room = capacity - sum(p[2] for p in filled)
        while room >= least and k + 1 < len(bins):
            doc, start, length = bins[-1].pop()
            taken = min(length, room)
            filled.append((doc, start, taken))
            room -= taken
            if taken < length:
                bins[-1].append((doc, start + taken, length - taken))
            elif not bins[-1]:
                bins.pop()
    return bins


def plan_group(lengths: list[int], capacity: int, least: int = LEAST_CUT) -> list[list[tuple[int, int, int]]]:
    """Sequences of one group, as lists of pieces (document, start, length)."""
    pieces = [(d, s, min(capacity, n - s)) for d, n in enumerate(lengths) for s in range(0, n, capacity)]
    bins = [[pieces[i] for i in b] for b in first_fit_decreasing([p[2] for p in pieces], capacity)]
    return fill_up(bins, capacity, least)


def _groups(batches: Iterator[pa.RecordBatch], most_docs: int, most_bytes: int) -> Iterator[tuple[int, list, list]]:
    """(group, doc_ids, ids) of sorted rows; a group that is far larger than meant, as rows repeat, comes in parts."""
    now, names, ids, size = None, [], [], 0
    for batch in batches:
        for group, name, x in zip(batch.column("pack_group").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids")):
            if ids and (group != now or len(ids) >= most_docs or size >= most_bytes):
                yield now, names, ids
                names, ids, size = [], [], 0
            now = group
            names.append(name)
            ids.append(x.as_py())
            size += len(ids[-1])
    if ids:
        yield now, names, ids


def pack(docs: DataFrame, path: str | None = None, capacity: int = 1024, end_id: int = 0, seed: int = 7, group_docs: int = GROUP_DOCS) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset), one row per piece.

    Nulls: a null text is the end id alone; null doc_ids are kept, each row a document of its own, as repeated
    rows are. Empty table: no pieces. Ties of length: by the place in the group. Very long texts become full
    sequences and one remainder. Other columns are not read. A group has about ``group_docs`` documents
    whatever the table's size; groups are dealt by a hash of doc_id and text, so that a task that runs again deals
    them alike. Only rows that repeat both meet in one group; it is packed in parts of bounded rows and bytes.
    """
    path = path or tokenizer_path()
    kind = "<u2" if load_tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_on("ids")
        for big in batches:
            for batch in slices(big):
                ids, per = encoder(path).encode(batch.column("text"))
                flat = np.insert(ids, np.cumsum(per), end_id).astype(kind)
                ends = np.concatenate([[0], np.cumsum(per + 1)])
                held = pa.Array.from_buffers(pa.binary(), len(per), [None, pa.py_buffer((ends * flat.itemsize).astype(np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("place"), batch.column("pack_group"), held], ["doc_id", "place", "pack_group", "ids"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_on()
        last, base = None, 0
        for group, names, held in _groups(batches, 4 * group_docs, GROUP_BYTES):
            base = base if group == last else 0
            ids, rows = [np.frombuffer(b, kind) for b in held], []
            sequences = plan_group([len(x) for x in ids], capacity)
            for number, pieces in enumerate(sequences, base):
                offset = 0
                for doc, start, length in pieces:
                    check = crc32(ids[doc][start : start + length].astype("<u4").tobytes())
                    rows.append((names[doc], start, length, check, len(ids[doc]), (group << BIN_BITS) | number, offset))
                    offset += length
            last, base = group, base + len(sequences)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], [c.split()[0] for c in PIECES.split(", ")])

    groups = max(1, -(-docs.count() // group_docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("place", F.xxhash64("doc_id", "text", F.lit(seed))).withColumn("pack_group", F.pmod("place", F.lit(groups)))
    encoded = text_batches(rows).mapInArrow(encode, "doc_id long, place long, pack_group long, ids binary")
    return encoded.repartition("pack_group").sortWithinPartitions("pack_group", "place").mapInArrow(place, PIECES)
