"""Media columns: payloads in archives, read back through a data source of byte ranges.

Archives are zip files of WAV members (8-bit mono samples), written by the tasks that hold the payloads and closed at a
bounded size and number of members. The data source knows archives by name and size only; it plans byte ranges over them. A task reads
its part of the archive's directory, takes the members whose headers lie in its range, opens each at its own offset and streams Arrow
batches of bounded bytes. A member that can't be read is tried again at its offset, alone; what its neighbours gave stays.

Defined results: a null or empty text is 64 zero bytes; very long texts are one member each;
repeated rows are members of their own, and so are rows with one id; extra columns are not touched; an empty table gives no
archives and no rows; a member that stays unreadable fails the task (``mode=failfast``) or comes as a row with an error.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import time
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from genosieve.llm.common import filesystem, work_dir, written

#: Bytes of payload after which a task starts its next archive.
ARCHIVE_BYTES = 256 << 20
#: Members after which it does, too: a task holds about 500 bytes of directory for each until an archive is closed.
ARCHIVE_MEMBERS = 100_000
#: Bytes of an archive that one reading task plans for.
RANGE_BYTES = 8 << 20
#: Bytes of media in an Arrow batch.
BATCH_BYTES = 4 << 20
ATTEMPTS = 4
RATE = 8000
PAD = 64


def pad(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % PAD or (PAD if not data else 0))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """8-bit mono WAV of an even number of samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples)) + samples


def from_wav(media: bytes) -> bytes:
    """The samples of an 8-bit mono WAV; chunks other than ``data`` are skipped."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV")
    at = 12
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"data":
            if at + 8 + size > len(media):
                raise ValueError("WAV is cut off")
            return media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("WAV has no data")


def feature(samples: bytes) -> str:
    """Length, mean, root mean square, zero crossings and a 16-step loudness outline, as one string."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    steps = [int(np.abs(p).sum()) // max(1, len(p)) for p in np.array_split(x, 16)]
    return f"ms={len(x) * 1000 // RATE};mean={int(x.sum() * 1000 // len(x))};rms={int(np.sqrt((x * x).sum() / len(x)) * 1000)};zc={crossings};env=" + "".join(f"{s:02x}" for s in steps)


def write_archives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, archive_bytes: int = ARCHIVE_BYTES, archive_members: int = ARCHIVE_MEMBERS) -> tuple[str, DataFrame]:
    """Stores each whole text as a WAV member; returns the folder and the archives (archive, members, bytes), computed."""
    spark = df.sparkSession
    folder = path or work_dir(spark, "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, where = filesystem(folder)
        done, out = [], None

        def start() -> tuple:
            name = f"{context.partitionId():06d}-{len(done):04d}.zip"
            sink = fs.open_output_stream(f"{where}/.{name}-{context.taskAttemptId()}")
            return name, sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED, compresslevel=1), [0, 0]

        def finish() -> None:
            name, sink, archive, (n, size) = out
            archive.comment = _range_table(archive.filelist)
            archive.close()
            sink.close()
            fs.move(f"{where}/.{name}-{context.taskAttemptId()}", f"{where}/{name}")
            done.append((name, n, size))

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                if out is None:
                    out = start()
                media = to_wav(pad(data))
                member = zipfile.ZipInfo(f"{out[3][0]:08d}.wav")
                member.compress_type = zipfile.ZIP_DEFLATED
                member.comment = json.dumps({"id": key, "n_bytes": len(data)}).encode()  # goes to the archive's directory
                out[2].writestr(member, media)
                out[3][0] += 1
                out[3][1] += len(media)
                if out[3][1] >= archive_bytes or out[3][0] >= archive_members:
                    finish()
                    out = None
        if out:
            finish()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["archive", "members", "bytes"])

    made = df.select(id_col, text_col).mapInArrow(run, "archive string, members bigint, bytes bigint")
    return folder, written(made, "archives")


@dataclass
class ByteRange(InputPartition):
    """Bytes of an archive; its members are those whose headers begin there."""

    path: str
    start: int
    stop: int


def _range_table(members: list[zipfile.ZipInfo]) -> bytes:
    """The archive's comment: where in its directory the members of each RANGE_BYTES begin, so that a range is read
    without the rest of the directory."""
    at, places = 0, []
    for m in members:
        places += [at] * (m.header_offset // RANGE_BYTES + 1 - len(places))
        at += 46 + len(m.filename.encode()) + len(m.comment)
    return json.dumps({"step": RANGE_BYTES, "at": [*places, at]}).encode()


def members_between(f, start: int, stop: int) -> list[zipfile.ZipInfo]:
    """The members whose headers begin in a range of bytes, in order. Of archives with a table of ranges that fits, only
    the range's part of the directory is read; of others the whole directory."""
    size = f.size()
    tail = f.read_at(min(size, 22 + 65_535), max(0, size - 22 - 65_535))
    end = tail.rfind(b"PK\5\6")
    try:
        length, first, n = *struct.unpack_from("<II", tail, end + 12), struct.unpack_from("<H", tail, end + 20)[0]
        table = json.loads(tail[end + 22 : end + 22 + n])
        step, at = table["step"], table["at"]
        if start % step or (stop % step and stop < first) or at[-1] != length:
            raise ValueError("ranges of another size")
    except (struct.error, ValueError, TypeError, KeyError, IndexError):  # not an archive of this module
        directory = zipfile.ZipFile(io.BufferedReader(_Seekable(f))).infolist()
        return sorted((m for m in directory if start <= m.header_offset < stop), key=lambda m: m.header_offset)
    a, b = (at[min(i, len(at) - 1)] for i in (start // step, -(-stop // step)))
    part, i, out = f.read_at(b - a, first + a), 0, []
    while i < len(part):
        sign, method, crc, packed, plain, names, extra, comment, offset = struct.unpack_from("<4s6xH4xIIIHHH8xI", part, i)
        if sign != b"PK\1\2":
            raise ValueError("the archive's directory is damaged")
        m = zipfile.ZipInfo(part[i + 46 : i + 46 + names].decode())
        m.compress_type, m.CRC, m.compress_size, m.file_size, m.header_offset = method, crc, packed, plain, offset
        m.comment = part[i + 46 + names + extra : i + 46 + names + extra + comment]
        out.append(m)
        i += 46 + names + extra + comment
    return out


def read_member(f, info: zipfile.ZipInfo, attempts: int = ATTEMPTS, wait: Callable[[float], None] = time.sleep) -> bytes:
    """One member by its offset, checked against its CRC and size; only this member is tried again on an error."""
    for k in range(attempts):
        try:
            head = f.read_at(30, info.header_offset)
            sign, names, extra = struct.unpack("<4s22xHH", head)
            if sign != b"PK\3\4":
                raise ValueError(f"no member at {info.header_offset}")
            raw = f.read_at(info.compress_size, info.header_offset + 30 + names + extra)
            data = zlib.decompress(raw, -15) if info.compress_type == zipfile.ZIP_DEFLATED else bytes(raw)
            if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
                raise ValueError(f"member at {info.header_offset} is damaged")
            return data
        except (OSError, ValueError, zlib.error, struct.error):
            if k + 1 == attempts:
                raise
            wait(0.05 * 2**k)
    raise AssertionError


class MediaReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.batch_bytes = int(options.get("batchbytes", BATCH_BYTES))
        self.permissive = options.get("mode", "failfast").lower() == "permissive"

    def partitions(self) -> list[InputPartition]:
        fs, where = pafs.FileSystem.from_uri(self.path)
        found = [x for x in fs.get_file_info(pafs.FileSelector(where)) if x.is_file and x.base_name.endswith(".zip") and x.base_name[0] != "."]
        out = [ByteRange(f"{self.path}/{x.base_name}", a, min(a + self.range_bytes, x.size)) for x in sorted(found, key=lambda x: x.base_name) for a in range(0, x.size, self.range_bytes)]
        return out or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("meta", pa.string()), ("media", pa.binary()), ("error", pa.string())])
        if not partition.path:
            return
        fs, where = pafs.FileSystem.from_uri(partition.path)
        rows, held = [], 0
        with fs.open_input_file(where) as f:
            for info in members_between(f, partition.start, partition.stop):
                media, error = None, None
                try:
                    media = read_member(f, info)
                except Exception as e:
                    if not self.permissive:
                        raise
                    error = f"{type(e).__name__}: {e}"
                rows.append((partition.path.rpartition("/")[2], info.header_offset, info.comment.decode(), media, error))
                held += len(media or b"")
                if held >= self.batch_bytes or len(rows) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


class _Seekable(io.RawIOBase):
    """A raw file for zipfile over an Arrow input file."""

    def __init__(self, f):
        self.f = f

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, at: int, whence: int = 0) -> int:
        return self.f.seek(at, whence)

    def tell(self) -> int:
        return self.f.tell()

    def readinto(self, b) -> int:
        data = self.f.read(len(b))
        b[: len(data)] = data
        return len(data)


class MediaSource(DataSource):
    """``format("media")``: options path, rangeBytes, batchBytes, mode (failfast or permissive)."""

    @classmethod
    def name(cls) -> str:
        return "media"

    def schema(self) -> str:
        return "archive string, offset bigint, meta string, media binary, error string"

    def reader(self, schema) -> DataSourceReader:
        return MediaReader({k.lower(): v for k, v in self.options.items()})


def read_archives(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """(archive, offset, meta, media, error) of every member below ``folder``."""
    spark.dataSource.register(MediaSource)
    return spark.read.format("media").options(**options).load(folder)


def describe(media: DataFrame, id_col: str = "doc_id", id_type: str = "bigint") -> DataFrame:
    """Digests and features of the payloads in ``media``; nulls where a member had an error. No shuffle."""
    kind = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32()}[id_type]
    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [kind, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for meta, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                m = json.loads(meta)
                if media is None:
                    rows.append((m["id"], m["n_bytes"], *[None] * 6))
                    continue
                p = from_wav(media)
                rows.append((m["id"], m["n_bytes"], len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-PAD:]), len(media), hashlib.sha256(media).hexdigest(), feature(p)))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names=names)

    ddl = f"`{id_col}` {id_type}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return media.select("meta", "media").mapInArrow(run, ddl)
