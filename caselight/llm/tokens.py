"""Token counts and token-id files.

Counting takes a short cut: a vocabulary string that the merges alone rebuild to one token is *proven*,
so that a pre-token equal to it counts one without any merging. Only other pre-tokens are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .bpe import JOINED, MEMO_ENTRIES, Memo, byte_letters, encoder, lettered, load_tokenizer, pre_token_pattern, pre_tokens_of, slices, spaced, split_index, sums, tokenizer_path, whole_only
from .shared import MEMOS, filesystem, materialise, shared_dir, text_batches, working_on


def whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings (as text) proven to encode alone as their own single token."""
    from tokenizers import Tokenizer, pre_tokenizers

    tokenizer = load_tokenizer(path)
    merger = Tokenizer(tokenizer.model)
    merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    back = {c: chr(b) for b, c in byte_letters().items()}
    proven = []
    for letters, number in tokenizer.get_vocab(with_added_tokens=False).items():
        if merger.encode(letters).ids == [number] and all(c in back for c in letters):
            try:
                text = "".join(back[c] for c in letters).encode("latin-1").decode()
            except UnicodeDecodeError:
                continue  # part of a character: no pre-token equals it
            if pre_token_pattern().fullmatch(text):
                proven.append(text)
    return frozenset(proven)


class Counter:
    """Counts tokens of texts; special strings count as the library has them by default."""

    def __init__(self, path: str, proven: frozenset[str]):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.proven = load_tokenizer(path), proven
        self.merger = Tokenizer(self.tokenizer.model)
        self.merger.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.pieces = Memo()
        self.rest: dict[str, int] = {}

    def whole(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self) -> None:
        """Counts of pending pieces: a proven pre-token is one token, the others are merged once."""
        pending = self.pieces.pending
        parts = list(map(pre_tokens_of, pending))
        proven, rest = self.proven, self.rest
        new = list({q for x in parts if x for q in x if q not in proven and q not in rest})
        for k in range(0, len(new), JOINED):
            some = new[k : k + JOINED]
            e = self.merger.encode(lettered("\t".join(some)), add_special_tokens=False)
            rest.update(zip(some, np.bincount(np.array(e.word_ids, np.int64), minlength=len(some)).tolist()))
        many = np.array([0 if x is None else sum(1 if q in proven else rest[q] for q in x) for x in parts], np.int64)
        odd = [k for k, x in enumerate(parts) if x is None]
        many[odd] = self.whole([spaced(pending[k]) for k in odd])
        self.pieces.fill(np.zeros(0, np.uint32), many)

    def count(self, texts: list[str | None]) -> np.ndarray:
        if self.pieces.full() or len(self.rest) > MEMO_ENTRIES:
            self.pieces, self.rest = Memo(), {}
        per = np.zeros(len(texts), np.int64)
        plain = [k for k, t in enumerate(texts) if t and not whole_only(t)]
        index, counts = split_index([texts[k] for k in plain], self.pieces)
        if self.pieces.pending:
            self._learn()
        per[plain] = sums(self.pieces.lengths[index], counts)
        known = set(plain)
        if apart := [k for k, t in enumerate(texts) if t and k not in known]:
            per[apart] = self.whole([texts[k] for k in apart])
        return per


_COUNTERS: dict[str, Counter] = {}
MEMOS["counts"] = _COUNTERS.clear


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document.

    Nulls: a null text is empty (0 bytes, 0 tokens); a null doc_id stays. Repeated rows: one result each.
    Empty table: an empty result. Other columns of ``docs`` are not read, so their names cannot clash.
    Long texts are split into pieces, never cut short. Nothing is shuffled.
    """
    path = path or tokenizer_path()
    proven = docs.sparkSession.sparkContext.broadcast(whole_tokens(path))  # at most the vocabulary

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_on("counts")
        if path not in _COUNTERS:
            _COUNTERS[path] = Counter(path, proven.value)
        for big in batches:
            for batch in slices(big):
                texts = batch.column("text").to_pylist()
                sizes = [len(t) if t and t.isascii() else len((t or "").encode()) for t in texts]
                counts = _COUNTERS[path].count(texts)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return text_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


MANIFEST = "part int, path string, n_docs long, n_tokens long, width int"
NULL_ID = -(2**63)


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 0) -> DataFrame:
    """Write the ids of all documents in ascending doc_id order as flat files; returns the manifest, a row per file.

    A file is flat little-endian unsigned integers (16 bits if the vocabulary allows, else 32). Beside it lie
    ``.offsets`` (n + 1 64-bit starts within the file) and ``.docs`` (64-bit doc_ids; the least value marks null).
    Each attempt of a task writes files of its own name; only those of the attempt that ended well are in the
    manifest. Nulls: null texts are the end id alone, null doc_ids come first. Ties of doc_id: by text.
    Empty table: an empty manifest.
    """
    path, spark = path or tokenizer_path(), docs.sparkSession
    width = 2 if load_tokenizer(path).get_vocab_size() <= 1 << 16 else 4

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_on("ids")
        task, fs, offsets, names, total = TaskContext.get(), None, [np.zeros(1, np.int64)], [], 0
        for big in batches:
            for batch in slices(big):
                if fs is None:
                    name = f"{folder}/ids-{task.partitionId():06d}-{task.taskAttemptId()}"
                    fs, local = filesystem(name)
                    fs.create_dir(local.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(local + ".bin")
                ids, per = encoder(path).encode(batch.column("text"))
                out.write(np.insert(ids, np.cumsum(per), end_id).astype(f"<u{width}").tobytes())
                offsets.append(total + np.cumsum(per + 1))
                total = int(offsets[-1][-1])
                names.append(batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False))
        if fs is None:
            return
        out.close()
        for end, parts in ((".offsets", offsets), (".docs", names)):
            with fs.open_output_stream(local + end) as side:
                side.write(np.concatenate(parts).astype("<i8").tobytes())
        yield pa.RecordBatch.from_pylist([{"part": task.partitionId(), "path": name, "n_docs": sum(map(len, names)), "n_tokens": total, "width": width}], pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())]))

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return materialise(text_batches(ordered).mapInArrow(write, MANIFEST), "token-manifest")


def mapped(name: str, dtype: str) -> np.ndarray:
    """A file as an array: memory-mapped on a mounted file system, else read."""
    from pyarrow import fs as pafs

    fs, local = filesystem(name)
    if not fs.get_file_info(local).size:
        return np.zeros(0, dtype)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(local, dtype, "r")
    with fs.open_input_file(local) as f:
        return np.frombuffer(f.read(), dtype)


def read_token_files(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files; start counts over all files in order.

    The base of each file is the prefix sum of the files before it, over the manifest (a row per file).
    """
    from pyspark.sql import Window

    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from zlib import crc32

        for batch in batches:
            for row in batch.to_pylist():
                ids, offsets, names = (mapped(row["path"] + end, kind) for end, kind in ((".bin", f"<u{row['width']}"), (".offsets", "<i8"), (".docs", "<i8")))
                for at in range(0, len(names), 4096):
                    some, ends = names[at : at + 4096], offsets[at : at + 4097]
                    checks = [crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends, ends[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some, pa.int64(), mask=some == NULL_ID), pa.array(ends[:-1] + row["base"]), pa.array(np.diff(ends)), pa.array(checks, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    files = max(1, manifest.count())
    return based.repartition(files).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, path: str | None = None, end_id: int = 0) -> DataFrame:
    """Write all documents as token-id files in the shared folder and read them back."""
    return read_token_files(write_token_files(docs, shared_dir(docs.sparkSession, "token-ids"), path, end_id))
