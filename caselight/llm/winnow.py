"""Exact document frequencies of all shingles, as far as a join needs them: how many shingles of a document no other has.

A task packs the shingles of many documents by ranges of hashes: a row holds those of one batch of documents in one
range, four bytes a shingle and two for the document's place in the batch. The task of a range finds the shingles that
only one document has and answers each batch with their documents' places. A frequent shingle is a few bytes in many
batches, and ranges are sized from the data, so that no task holds more than a bounded part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .shared import materialise, runs, text_batches, working_on
from .shingles import U, shingle_sets

#: Text bytes a range of hashes stands for.
RANGE_BYTES = 8 << 20
#: Shingles and documents of a batch; places of documents have two bytes.
BATCH_SHINGLES, BATCH_DOCS = 1 << 19, 60_000
SLICE_ROWS, SLICE_BYTES = 512, 4 << 20
DEALT = "part int, batch binary, a binary, b binary, c binary, d binary"
DESCRIBED = "doc_id long, n_shingles long, digest binary, lone long"


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch with a ``text`` column in slices of bounded rows and text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        full = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right"))
        rows = max(1, min(SLICE_ROWS, full - at))
        yield batch.slice(at, rows)
        at += rows


def described_sets(batch: pa.RecordBatch, words: int) -> tuple[np.ndarray, np.ndarray, list[bytes | None]]:
    """Shingle sets of a slice, end to end, their bounds, and their digests (none for an empty set)."""
    import xxhash

    elements, bounds = shingle_sets(batch.column("text"), words)
    return elements, bounds, [xxhash.xxh3_128_digest(elements[a:b].tobytes()) if b > a else None for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def _packed(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    offsets = (bounds * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])


def _batch_rows(held: list[tuple], parts: int, number: int) -> Iterator[pa.RecordBatch]:
    import xxhash

    ids = pa.concat_arrays([ids for ids, *_ in held])
    sizes = np.concatenate([np.diff(bounds) for _, _, bounds, _ in held]).astype(np.int64)
    elements = np.concatenate([elements for _, elements, _, _ in held])
    digests = b"".join(d or bytes(16) for *_, some in held for d in some)
    numbers, missing = ids.fill_null(0).to_numpy().astype(np.int64).tobytes(), ids.is_null().to_numpy(zero_copy_only=False).tobytes()
    # named by what it holds, so that a task that runs again over rows in another order makes other batches
    name = xxhash.xxh3_128_digest(numbers + missing + digests) + TaskContext.get().partitionId().to_bytes(4) + number.to_bytes(4)
    part = ((elements >> U(32)) * U(parts) >> U(32)).astype(np.uint16 if parts <= 1 << 16 else np.uint32)
    order = np.argsort(part, kind="stable")
    bounds = np.searchsorted(part[order], np.arange(parts + 1))
    some = np.flatnonzero(np.diff(bounds))
    bounds = np.append(bounds[some], len(order))
    place = np.repeat(np.arange(len(sizes), dtype=np.uint16), sizes)
    none = pa.nulls(len(some), pa.binary())
    columns = [pa.array(some, pa.int32()), pa.array([name] * len(some), pa.binary()), _packed((elements & U(0xFFFFFFFF)).astype(np.uint32)[order], bounds), _packed(place[order], bounds), none, none]
    yield pa.RecordBatch.from_arrays(columns, ["part", "batch", "a", "b", "c", "d"])
    own = -1 - TaskContext.get().partitionId() % parts
    yield pa.RecordBatch.from_pylist([{"part": own, "batch": name, "a": numbers, "b": sizes.tobytes(), "c": digests, "d": missing}], schema=pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in ("batch", "a", "b", "c", "d"))]))


def describe(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, n_shingles, digest, lone) of every row: the size and digest of its shingle set, and how many of the
    shingles no other row has (never too many; too few only where a task ran again over rows in another order).

    Each batch's rows are told apart by their place, so rows must come in the same order when they are read again, as
    those of a table do; a checksum of the ids tells if they did not.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    check = F.count("*"), F.sum(F.xxhash64("doc_id") % 1_000_000_007)
    total, *before = docs.agg(F.sum(F.octet_length("text")), *check).first()
    parts = 1 + (total or 0) // RANGE_BYTES

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_on()
        held, shingles, rows, number = [], 0, 0, 0
        for batch in batches:
            for some in slices(batch):
                elements, bounds, digests = described_sets(some, words)
                held.append((some.column("doc_id"), elements, bounds, digests))
                shingles, rows = shingles + len(elements), rows + some.num_rows
                if shingles >= BATCH_SHINGLES or rows >= BATCH_DOCS:
                    yield from _batch_rows(held, parts, number)
                    held, shingles, rows, number = [], 0, 0, number + 1
        if held:
            yield from _batch_rows(held, parts, number)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_on()
        for (part,), rows in runs(batches, ("part",)):
            if part < 0:
                columns = [rows[c] for c in ("a", "b", "c", "d")]
            else:
                prints = np.concatenate([np.frombuffer(x, np.uint32) for x in rows["a"]])
                sorted_ = np.sort((prints.astype(U) << U(32)) | np.arange(len(prints), dtype=U))
                same = sorted_[1:] >> U(32) == sorted_[:-1] >> U(32)
                lone = np.zeros(len(prints), bool)
                lone[(sorted_ & U(0xFFFFFFFF))[~(np.append(same, False) | np.append(False, same))]] = True
                at, places, counts = 0, [], []
                for x in rows["b"]:
                    place = np.frombuffer(x, np.uint16)
                    places.append(place[lone[at : at + len(place)]].tobytes())
                    counts.append(np.int64(len(place)).tobytes())
                    at += len(place)
                columns = [places, counts, [None] * len(places), [None] * len(places)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in (rows["batch"], *columns)], ["batch", "a", "b", "c", "d"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches, ("batch",)):
            places, received, book = [], 0, None
            for a, b, c, d in zip(*(rows[x] for x in ("a", "b", "c", "d"))):
                if c is None:
                    places.append(np.frombuffer(a, np.uint16))
                    received += int(np.frombuffer(b, np.int64)[0])
                else:
                    book = a, b, c, d
            if book is None:  # its rows are in another batch
                continue
            sizes = np.frombuffer(book[1], np.int64)
            lone = np.bincount(np.concatenate(places), minlength=len(sizes)) if places and received == sizes.sum() else np.zeros(len(sizes), np.int64)
            digests = pa.array([book[2][k : k + 16] if n else None for k, n in zip(range(0, len(book[2]), 16), sizes)], pa.binary())
            ids = pa.array(np.frombuffer(book[0], np.int64), mask=np.frombuffer(book[3], bool))
            yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), digests, pa.array(lone.astype(np.int64))], ["doc_id", "n_shingles", "digest", "lone"])

    dealt = text_batches(docs).mapInArrow(deal, DEALT)
    found = dealt.repartition("part").sortWithinPartitions("part").mapInArrow(find, "batch binary, a binary, b binary, c binary, d binary")
    rows = materialise(found.repartition("batch").sortWithinPartitions("batch").mapInArrow(answer, DESCRIBED), "shingles")
    if tuple(rows.agg(*check).first()) != tuple(before):
        raise RuntimeError("rows of the input changed places while tasks ran again; write the input as a table first")
    return rows
