"""A data source for xz-compressed newline-JSON feeds, for which Spark has no codec.

An xz file ends with an index of its blocks, each of which can be decoded alone. Large files are cut into runs of blocks by that
index, so one file is many tasks; a file of one block is one task. A task owns the lines that start after its run's first byte,
up to and with one that starts where the next run does; it reads on into the next blocks to finish its last line, and leaves out
what it finds before its first line end (unless its run starts the file). So every line has one owner, wherever
blocks border. Several streams in one file and padding between them are read; other damage is an error.
"""

from __future__ import annotations

import json
import lzma
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

BATCH = 1000
#: Decoded bytes of a task's run of blocks; and compressed bytes up to which a file is one task, its index unread.
SPLIT_BYTES, SMALL_FILE = 128 << 20, 8 << 20
_CHUNK = 1 << 20


@dataclass
class Block:
    """A block of a file: its stream's header, where it lies, and its decoded bytes."""

    header: bytes
    offset: int
    size: int
    decoded: int


@dataclass
class Run(InputPartition):
    """Blocks of a file that a task owns, and those after them, into which its last line may reach; none: the whole file, whose index the task reads."""

    path: str
    own: list[Block] = field(default_factory=list)
    after: list[Block] = field(default_factory=list)
    first: bool = True


def _number(data: bytes, at: int) -> tuple[int, int]:
    """(value, place behind it) of a number in groups of seven bits."""
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        at, shift = at + 1, shift + 7
        if not data[at - 1] & 128:
            return value, at


def index(f: pa.NativeFile, size: int) -> list[Block]:
    """All blocks of a file in order, from the indexes at the ends of its streams."""
    found: list[Block] = []
    while size:
        if size >= 4 and f.read_at(4, size - 4) == b"\0\0\0\0":  # padding between streams
            size -= 4
            continue
        foot = f.read_at(12, size - 12) if size >= 32 else b""
        if foot[10:] != b"YZ":
            raise ValueError("not an xz file, or cut off")
        length = (int.from_bytes(foot[4:8], "little") + 1) * 4
        data = f.read_at(length, size - 12 - length)
        count, at = _number(data, 1)
        sizes = []
        for _ in range(count):
            unpadded, at = _number(data, at)
            decoded, at = _number(data, at)
            sizes.append((-(-unpadded // 4) * 4, decoded))
        place = size - 12 - length - sum(s for s, _ in sizes)
        header, own = f.read_at(12, place - 12), []
        for s, decoded in sizes:
            own.append(Block(header, place, s, decoded))
            place += s
        found = own + found
        size = own[0].offset - 12 if own else size - 24 - length
    return found


def runs(path: str, blocks: list[Block], split_bytes: int) -> list[Run]:
    """Blocks dealt to tasks of ``split_bytes`` decoded bytes, or one block. A run knows the blocks up to the end of the next
    ``split_bytes``; a line that reaches further is finished by reading the index again."""
    out, own, held = [], [], 0
    for b in blocks:
        if own and held + b.decoded > split_bytes:
            out.append(Run(path, own, first=not out))
            own, held = [], 0
        own.append(b)
        held += b.decoded
    if own:
        out.append(Run(path, own, first=not out))
    for a, b in zip(out, out[1:]):
        a.after = b.own
    return out


def _decoded(f: pa.NativeFile, blocks: Iterator[Block]) -> Iterator[tuple[Block, bytes]]:
    for b in blocks:
        decoder = lzma.LZMADecompressor(lzma.FORMAT_XZ)
        decoder.decompress(b.header)
        for at in range(0, b.size, _CHUNK):
            if data := decoder.decompress(f.read_at(min(_CHUNK, b.size - at), b.offset + at)):
                yield b, data


def lines(f: pa.NativeFile, run: Run, size: int) -> Iterator[bytes]:
    """The lines that a run owns."""

    def following() -> Iterator[Block]:
        yield from run.after
        last = (run.after or run.own)[-1].offset
        yield from (b for b in index(f, size) if b.offset > last)  # only a line longer than a run gets here

    rest, skipping = b"", not run.first
    for _, data in _decoded(f, iter(run.own)):
        *whole, rest = (rest + data).split(b"\n")
        if skipping and whole:
            whole, skipping = whole[1:], False
        yield from whole
        if skipping:
            rest = b""  # still the line before
    if skipping:
        return
    for _, data in _decoded(f, following()):
        head, found, _ = data.partition(b"\n")
        rest += head
        if found:
            yield rest
            return
    if rest:
        yield rest


class FeedReader(DataSourceReader):
    def __init__(self, path: str, schema, split_bytes: int, small_file: int):
        self.path, self.names = path if ":/" in path else f"file://{path}", [f.name for f in schema.fields]
        self.split_bytes, self.small_file = split_bytes, small_file

    def partitions(self) -> list[InputPartition]:
        fs, where = pafs.FileSystem.from_uri(self.path)
        scheme = self.path.partition("://")[0]
        info = fs.get_file_info(where)
        found = [info] if info.is_file else [x for x in fs.get_file_info(pafs.FileSelector(where)) if x.is_file and x.base_name.endswith(".xz")]
        out: list[InputPartition] = []
        for x in sorted(found, key=lambda x: x.path):
            if x.size <= self.small_file:
                out.append(Run(f"{scheme}://{x.path}"))
            else:
                with fs.open_input_file(x.path) as f:
                    out += runs(f"{scheme}://{x.path}", index(f, x.size), self.split_bytes)
        return out or [Run("")]

    def _lines(self, run: Run) -> Iterator[bytes]:
        fs, where = pafs.FileSystem.from_uri(run.path)
        with fs.open_input_file(where) as f:
            own = run if run.own else Run(run.path, index(f, f.size()))
            if own.own:
                yield from lines(f, own, f.size())

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        schema, rows = pa.schema([(n, pa.string()) for n in self.names]), []
        for line in self._lines(partition):
            if not line.strip():
                continue
            record = json.loads(line)
            rows.append([None if record.get(n) is None else str(record[n]) for n in self.names])
            if len(rows) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=schema)


class FeedSource(DataSource):
    """``format("xzjson")`` with an explicit schema of strings; options ``splitbytes`` and ``smallfile``."""

    @classmethod
    def name(cls) -> str:
        return "xzjson"

    def schema(self) -> str:
        raise ValueError("xzjson needs an explicit schema")

    def reader(self, schema) -> DataSourceReader:
        return FeedReader(self.options["path"], schema, int(self.options.get("splitbytes", SPLIT_BYTES)), int(self.options.get("smallfile", SMALL_FILE)))
