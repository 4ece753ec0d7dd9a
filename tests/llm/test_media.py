from __future__ import annotations

import io
import os
import wave
import zipfile
from hashlib import sha256
from zlib import crc32

import pytest

from caselight.llm import media

from .cases import document_rows, documents, no_documents


@pytest.mark.parametrize("text", [None, "", "x", "é" * 32, "y" * 64, "z" * 65])
def test_round_trip(text):
    payload, n = media.payload_of(text)
    assert n == len((text or "").encode()) and len(payload) % 64 == 0 and len(payload) >= 64
    assert media.from_wav(media.to_wav(payload, n)) == (payload, n)


def test_media_columns(spark):
    want = []
    for doc_id, text, *_ in document_rows():
        raw = (text or "").encode()
        p = raw + bytes(-len(raw) % 64) or bytes(64)
        want.append((doc_id or -1, len(raw), len(p), sha256(p).hexdigest(), crc32(p[-64:])))
    rows = media.media_columns(documents(spark)).collect()
    assert sorted((r.doc_id or -1, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == sorted(want)
    equal = {r.payload_sha256: (r.media_bytes, r.media_sha256, r.feature) for r in rows if r.n_bytes > 10}
    assert all(equal[r.payload_sha256] == (r.media_bytes, r.media_sha256, r.feature) for r in rows if r.n_bytes > 10)
    assert media.media_columns(no_documents(spark)).count() == 0


def archive(folder) -> tuple[str, list]:
    path = os.path.join(folder, "a.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(40):
            z.writestr(f"{k}/{k}.wav", media.to_wav(*media.payload_of(f"text {k} " * (k + 1))))
    with zipfile.ZipFile(path) as z:
        return path, z.infolist()


def test_byte_ranges_cover_members_once(tmp_path):
    path, members = archive(tmp_path)
    size = os.path.getsize(path)
    reader = media.MediaReader({"path": "unused"})
    for step in (1, 100, 1000, size):
        if step == 1:
            continue
        ids = [r for at in range(0, size, step) for b in reader.read(media.Ranges([(path, at, min(at + step, size))])) for r in b.column("doc_id").to_pylist()]
        assert sorted(ids) == list(range(40))


def listed(spark, folder, archives):
    out = os.path.join(folder, "list.parquet")
    spark.createDataFrame([(p, 40, os.path.getsize(p)) for p in archives], media.ARCHIVES).coalesce(1).write.parquet(out)
    return out


def test_ranges_are_dealt_into_few_partitions(spark, tmp_path):
    archives = []
    for k in range(5):
        os.mkdir(tmp_path / str(k))
        archives.append(archive(tmp_path / str(k))[0])
    path, size = listed(spark, tmp_path, archives), os.path.getsize(archives[0])
    for options, least, most in (({}, 1, 1), ({"range_bytes": "1000"}, 5, 99), ({"range_bytes": "1000", "partitions": "3"}, 2, 4), ({"range_bytes": str(size), "partitions": "2"}, 2, 3)):
        reader = media.MediaReader({"path": path, **options})
        parts = reader.partitions()
        assert least <= len(parts) <= most
        rows = [(r["doc_id"], r["n_bytes"], r["media"]) for p in parts for b in reader.read(p) for r in b.to_pylist()]
        assert sorted(rows) == sorted((k, len(t), media.to_wav(*media.payload_of(t))) for k in range(40) for t in [f"text {k} " * (k + 1)] for _ in archives)


def test_payloads_pass_in_batches_of_bounded_size(tmp_path, monkeypatch):
    monkeypatch.setattr(media, "BATCH_BYTES", 2000)
    path, _ = archive(tmp_path)
    batches = list(media.MediaReader({"path": "unused"}).read(media.Ranges([(path, 0, os.path.getsize(path))])))
    sizes = [[len(m) for m in b.column("media").to_pylist()] for b in batches]
    assert len(batches) > 3 and all(sum(s) - s[-1] < 2000 for s in sizes)


def test_stored_forms_by_other_readers(spark, tmp_path):
    """Archives opened by zipfile, sounds by wave, features by plain loops."""
    stored = {}
    folder = f"{tmp_path}/media"
    path = media.write_archives(documents(spark), folder)
    for r in spark.read.parquet(path).collect():
        with zipfile.ZipFile(r.path) as z:
            stored |= {(r.path, n): z.read(n) for n in z.namelist()}
    want = []
    for (_, name), data in stored.items():
        with wave.open(io.BytesIO(data)) as w:
            assert (w.getnchannels(), w.getsampwidth()) == (1, 1)
            frames = w.readframes(w.getnframes())
        level, power, peak, crossings, before = 0, 0, 0, 0, None
        for b in frames:
            v = b - 128
            level, power, peak = level + v, power + v * v, max(peak, abs(v))
            crossings += before is not None and before != (v < 0)
            before = v < 0
        doc_id = name.partition("/")[2].removesuffix(".wav")
        want.append((int(doc_id or -1), len(data), sha256(data).hexdigest(), sha256(frames).hexdigest(), f"samples={len(frames)};level={level};power={power};peak={peak};crossings={crossings}"))
    rows = media.described(media.read_media(spark, path)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.media_bytes, r.media_sha256, r.payload_sha256, r.feature) for r in rows) == sorted(want)
    whole = media.read_media(spark, path)
    assert whole.columns == ["doc_id", "n_bytes", "media"] and sorted(bytes(r.media) for r in whole.collect()) == sorted(stored.values())


def test_a_failed_member_is_tried_again_by_offset(tmp_path, monkeypatch):
    path, members = archive(tmp_path)
    reader, once, failed = media.MemberReader(*media.filesystem(path)), media.MemberReader.once, set()

    def flaky(self, offset, packed, check):
        if offset not in failed:
            failed.add(offset)
            raise OSError("gone")
        return once(self, offset, packed, check)

    monkeypatch.setattr(media, "PAUSE_S", 0)
    monkeypatch.setattr(media.MemberReader, "once", flaky)
    assert all(media.from_wav(reader.read(m.header_offset, m.compress_size, m.CRC))[1] for m in members)
    monkeypatch.setattr(media.MemberReader, "once", once)
    with pytest.raises(OSError, match="damaged|no member"):
        reader.read(members[3].header_offset, members[3].compress_size, 1)
