import hashlib
import zipfile
import zlib

import pyarrow as pa
import pytest

from genosieve.llm import media as M


def test_round_trip(spark, odd, monkeypatch):
    folder, archives = M.write_archives(odd)
    assert archives.agg({"members": "sum"}).first()[0] == odd.count()
    for ranges in ("1000", "100000000"):  # the ranges do not change what is read
        rows = M.describe(M.read_archives(spark, folder, rangeBytes=ranges, batchBytes="500")).collect()
        found = {}
        for r in rows:
            found.setdefault((r.doc_id, r.payload_sha256), r)
        assert len(rows) == odd.count()
        for r in odd.collect():
            b = (r.text or "").encode()
            p = b + bytes(-len(b) % 64) if b else bytes(64)
            f = found[r.doc_id, hashlib.sha256(p).hexdigest()]
            assert (f.n_bytes, f.payload_bytes, f.tail_crc32, f.media_bytes) == (len(b), len(p), zlib.crc32(p[-64:]), len(p) + 44)
            assert f.media_sha256 == hashlib.sha256(M.to_wav(p)).hexdigest() and f.feature == M.feature(p)


def test_empty(spark, none):
    folder, _ = M.write_archives(none)
    assert M.read_archives(spark, folder).count() == 0


class Flaky:
    def __init__(self, path, failures):
        self.f, self.left, self.calls = pa.OSFile(str(path)), failures, []

    def read_at(self, n, at):
        self.calls.append(at)
        if self.left:
            self.left -= 1
            raise OSError("gone for a moment")
        return self.f.read_at(n, at)


def test_members_are_retried_alone(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(3):
            z.writestr(f"{k}.wav", M.to_wav(bytes([k]) * 64))
    infos = zipfile.ZipFile(tmp_path / "a.zip").infolist()
    f = Flaky(tmp_path / "a.zip", 2)
    assert M.from_wav(M.read_member(f, infos[1], wait=lambda s: None)) == b"\1" * 64
    assert set(f.calls[:3]) == {infos[1].header_offset}  # no other member was touched
    with pytest.raises(OSError):
        M.read_member(Flaky(tmp_path / "a.zip", 9), infos[1], wait=lambda s: None)


def test_damage_fails_or_is_told(spark, documents, tmp_path):
    folder, _ = M.write_archives(documents.limit(20).coalesce(1), path=f"file://{tmp_path}")
    path = next(tmp_path.glob("*.zip"))
    data, infos = bytearray(path.read_bytes()), zipfile.ZipFile(path).infolist()
    data[infos[3].header_offset + 60] ^= 0xFF
    path.write_bytes(data)
    rows = M.read_archives(spark, folder, mode="permissive").collect()
    assert len(rows) == 20 and sum(r.error is not None for r in rows) == 1
    with pytest.raises(Exception):
        M.read_archives(spark, folder).collect()


def test_a_range_reads_its_part_of_the_directory(spark, documents, monkeypatch, tmp_path):
    import pyarrow as pa
    import zipfile

    monkeypatch.setattr(M, "RANGE_BYTES", 1 << 14)
    folder, made = M.write_archives(documents.coalesce(1), path=f"file://{tmp_path}")
    path = next(tmp_path.glob("*.zip"))
    whole = sorted((m.header_offset, m.filename, m.CRC, m.comment) for m in zipfile.ZipFile(path).infolist())
    size, calls = path.stat().st_size, []
    with pa.OSFile(str(path)) as f:
        for step in (1 << 14, 1 << 15, 10_000):  # the last size has no table and falls back
            found = [(m.header_offset, m.filename, m.CRC, m.comment) for a in range(0, size, step) for m in M.members_between(f, a, min(a + step, size))]
            assert found == whole


def test_many_small_members(spark):
    """Archives are closed by their number of members; all come back once."""
    df = spark.range(1000).selectExpr("id as doc_id", "cast(id % 10 as string) as text").repartition(2)
    folder, archives = M.write_archives(df, archive_members=64)
    rows = archives.collect()
    assert sum(r.members for r in rows) == 1000 and max(r.members for r in rows) == 64 and len(rows) >= 16
    found = M.describe(M.read_archives(spark, folder)).collect()
    assert sorted(r.doc_id for r in found) == list(range(1000)) and {r.n_bytes for r in found} == {1}
