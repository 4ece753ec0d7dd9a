"""Media columns: payloads kept as 8-bit sound in ZIP archives, and a data source that reads them by byte range.

A payload is the text as UTF-8, padded with bytes 0 to a positive multiple of 64. Its stored form is a WAV file
(mono, 8-bit samples, one sample a byte) whose extra chunk ``ubyt`` holds the unpadded length. Members are deflated.
A member is told by its offset alone: a task takes the members whose local header begins in its byte ranges, and
reads each of them again by itself if that fails. The source gives whole payloads, in Arrow batches of bounded size;
digests and features are made from that column.
"""

from __future__ import annotations

import struct
import time
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import filesystem, shared_dir, text_batches, working_on

UNIT, RATE = 64, 8000
#: Bytes of a range, and ranges that are planned at most; of more bytes than that makes, several ranges share a partition.
RANGE_BYTES, PARTITIONS = 32 << 20, 100_000
BATCH_BYTES = 4 << 20
ATTEMPTS, PAUSE_S = 4, 0.2
ARCHIVES = "path string, n_members long, n_bytes long"
MEDIA = "doc_id long, n_bytes long, media binary"
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload_of(text: str | None) -> tuple[bytes, int]:
    """(padded payload, unpadded length)."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % UNIT or (0 if raw else UNIT)), len(raw)


def to_wav(payload: bytes, length: int) -> bytes:
    sound = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    extra = struct.pack("<4sIQ", b"ubyt", 8, length)
    body = b"WAVE" + sound + extra + struct.pack("<4sI", b"data", len(payload)) + payload
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def from_wav(media: bytes) -> tuple[bytes, int]:
    """(payload, unpadded length) of a stored form."""
    at, found = 12, {}
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        found[kind] = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    return found[b"data"], struct.unpack("<Q", found[b"ubyt"])[0]


def feature_of(payload: bytes) -> str:
    """Samples, mean level, power and zero crossings of the sound, in whole numbers."""
    wave = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((wave[1:] < 0) != (wave[:-1] < 0)))
    return f"samples={len(wave)};level={int(wave.sum())};power={int(wave @ wave)};peak={int(np.abs(wave).max())};crossings={crossings}"


def write_archives(docs: DataFrame, folder: str) -> str:
    """Write one archive per task below ``folder``; returns the folder of the list of archives (Parquet).

    Only archives of attempts that ended well are listed. Null texts are empty payloads; repeated rows are
    members of their own; an empty table gives an empty list.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, n, task = None, 0, TaskContext.get()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                if archive is None:
                    name = f"{folder}/archive-{task.partitionId():06d}-{task.taskAttemptId()}.zip"
                    fs, local = filesystem(name)
                    fs.create_dir(local.rpartition("/")[0], recursive=True)
                    out = fs.open_output_stream(local)
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=1)
                member = zipfile.ZipInfo(f"{n}/{'' if doc_id is None else doc_id}.wav")
                member.compress_type = zipfile.ZIP_DEFLATED
                archive.writestr(member, to_wav(*payload_of(text.as_py())))
                n += 1
        if archive is None:
            return
        archive.close()
        out.close()
        size = fs.get_file_info(local).size
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], ["path", "n_members", "n_bytes"])

    listed = f"{folder}/archives.parquet"
    text_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(write, ARCHIVES).write.parquet(listed)
    return listed


@dataclass
class Ranges(InputPartition):
    """Byte ranges (archive, start, end); those of one archive come one after another."""

    parts: list[tuple[str, int, int]]


class MediaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.listed, self.step = options["path"], int(options.get("range_bytes", RANGE_BYTES))
        self.most = int(options.get("partitions", PARTITIONS))

    def partitions(self) -> list[Ranges]:
        """Byte ranges of the listed archives, dealt into partitions of about as many bytes; members are not looked at here."""
        import pyarrow.dataset as ds

        fs, local = filesystem(self.listed)
        table = ds.dataset(local, filesystem=fs, format="parquet").to_table(columns=["path", "n_bytes"]).to_pylist() if fs.get_file_info(local).type.name != "NotFound" else []
        wanted = max(self.step, -(-sum(a["n_bytes"] for a in table) // self.most))
        out, held, size = [], [], 0
        for a in table:
            for at in range(0, a["n_bytes"], self.step):
                end = min(at + self.step, a["n_bytes"])
                if held and size + end - at > wanted:
                    out.append(Ranges(held))
                    held, size = [], 0
                held.append((a["path"], at, end))
                size += end - at
        return [*out, Ranges(held)]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        """Whole stored forms, in batches of about ``BATCH_BYTES`` (or one member)."""
        held, size = [], 0
        for path, members in groupby(partition.parts, lambda p: p[0]):
            fs, local = filesystem(path)
            spans = [(a, b) for _, a, b in members]
            with fs.open_input_file(local) as f, zipfile.ZipFile(f) as archive:  # its directory, once for all ranges of it
                found = [(m.header_offset, m.compress_size, m.CRC, m.filename) for m in archive.infolist() if any(a <= m.header_offset < b for a, b in spans)]
            reader = MemberReader(fs, local)
            for offset, packed, check, name in sorted(found):
                media = reader.read(offset, packed, check)
                doc_id = name.rpartition("/")[2].removesuffix(".wav")
                held.append((int(doc_id) if doc_id else None, from_wav(media)[1], media))
                size += len(media)
                if size >= BATCH_BYTES:
                    yield batch_of(held, MEDIA)
                    held, size = [], 0
            reader.close()
        if held:
            yield batch_of(held, MEDIA)


class MemberReader:
    """Reads members of one archive by offset; a failed or damaged read opens the archive anew and tries that member again."""

    def __init__(self, fs, local: str):
        self.fs, self.local, self.file = fs, local, None

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None

    def once(self, offset: int, packed: int, check: int) -> bytes:
        if self.file is None:
            self.file = self.fs.open_input_file(self.local)
        self.file.seek(offset)
        head = self.file.read(30)
        sign, method, name, extra = head[:4], *struct.unpack("<H", head[8:10]), *struct.unpack("<HH", head[26:30])
        if sign != b"PK\x03\x04":
            raise OSError(f"no member at {offset} of {self.local}")
        self.file.seek(offset + 30 + name + extra)
        body = self.file.read(packed)
        media = zlib.decompress(body, -15) if method == zipfile.ZIP_DEFLATED else body
        if zlib.crc32(media) != check:
            raise OSError(f"damaged member at {offset} of {self.local}")
        return media

    def read(self, offset: int, packed: int, check: int) -> bytes:
        for attempt in range(ATTEMPTS):
            try:
                return self.once(offset, packed, check)
            except (OSError, zlib.error, struct.error):
                self.close()
                if attempt + 1 == ATTEMPTS:
                    raise
                time.sleep(PAUSE_S * 2**attempt)
        raise AssertionError


def row_of(doc_id: int | None, media: bytes) -> tuple:
    payload, length = from_wav(media)
    return (doc_id, length, len(payload), sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), sha256(media).hexdigest(), feature_of(payload))


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    columns = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), columns)], [n for n, _ in columns])


class MediaArchiveSource(DataSource):
    """``spark.read.format("media_archive").load(listed)``: ``MEDIA``, the stored form of every payload."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return MEDIA

    def reader(self, schema) -> MediaReader:
        return MediaReader(dict(self.options))


def read_media(spark: SparkSession, listed: str) -> DataFrame:
    """``MEDIA`` of all archives in the list that ``write_archives`` has returned."""
    spark.dataSource.register(MediaArchiveSource)
    return spark.read.format("media_archive").load(listed)


def described(media: DataFrame) -> DataFrame:
    """``SCHEMA`` of stored forms (doc_id, media): digests and features of the payloads in them."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_on()
        for batch in batches:
            rows = [row_of(d, m.as_py()) for d, m in zip(batch.column("doc_id").to_pylist(), batch.column("media"))]
            if rows:
                yield batch_of(rows, SCHEMA)

    return text_batches(media.select("doc_id", "media")).mapInArrow(describe, SCHEMA)


def media_columns(docs: DataFrame) -> DataFrame:
    """Store every document's payload in archives of the shared folder, read them back through the data source, describe them.

    Returns ``SCHEMA``. Equal texts give equal values. Nulls: a null text is an empty payload (64 bytes 0), a null
    doc_id stays null. Repeated rows are members of their own and come back as often. Long texts are members like
    others, each a batch of its own. Empty table: an empty result. Other columns are not read, so their names cannot clash.
    """
    spark = docs.sparkSession
    return described(read_media(spark, write_archives(docs, shared_dir(spark, "media"))))
