"""Token-id files in a word-aligned Simple-8b coding.

A 64-bit word is a four-bit selector and 60 data bits that hold as many ids of equal width as the selector says. Values
of more than 60 bits are escapes: their word holds an index into the block's list of raw values. A file is

    magic | blocks: words, escapes | document table (Arrow stream: id, n_tokens) | block table | trailer

with little-endian 64-bit numbers throughout. The block table has a row per block (byte offset, words, escapes, ids,
first document, documents), so readers decode any block alone and whole arrays at a time. A block is a run of whole
documents. Shards are ranges of ascending document id; ties are ordered by text, nulls come first.

Defined results: a null or empty text is the end id alone; a very long text is a block of its own;
repeated rows are stored one by one; an empty table gives no files and no rows; extra columns are not touched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from genosieve.llm import bpe
from genosieve.llm.common import filesystem, work_dir, written

END_ID = 0
#: A block is closed at the document that brings it to so many ids.
BLOCK_IDS = 32_768
#: Blocks that one reading task takes.
TASK_BLOCKS = 256
_MAGIC = int.from_bytes(b"S8BTOKEN", "little")
# Ids per word and their width, by selector; 15 is the escape.
_COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
_BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
_ESCAPE = 15
#: Selector by the bits of a value; one past the last says that it must escape.
_NARROWEST = np.searchsorted(_BITS, np.arange(66)).astype(np.uint8)
#: The same by value, for values below 2 ** 16.
_SMALL = _NARROWEST[np.frexp(np.arange(1 << 16, dtype=np.float64))[1]]
#: Values in a word and the bits of each, by selector.
_STEPS = np.array([*_COUNTS, 1, 1], np.int32)
_WIDTHS = np.array([*_BITS, 0, 0], np.int64)


def _selectors(v: np.ndarray) -> np.ndarray:
    """For every place the selector of the word that would start there: the one that takes the most values."""
    n = len(v)
    if v.max() <= 0xFFFF:
        kind = _SMALL[v.astype(np.intp)]
    else:
        width = np.frexp(v.astype(np.float64))[1]  # bits of a value; doubles are exact up to 53 bits
        if (wide := np.flatnonzero(width > 50)).size:
            width[wide] = np.frexp((v[wide] >> np.uint64(20)).astype(np.float64))[1] + 20
        kind = _NARROWEST[width]  # narrowest selector for a value alone
    sel = np.where(kind == len(_BITS), _ESCAPE, len(_BITS) - 1).astype(np.uint8)
    widest, have = np.concatenate([kind, np.zeros(_COUNTS[0], np.uint8)]), 1  # a last word may be padded
    for j in range(len(_BITS) - 2, -1, -1):  # more values of fewer bits; widest[i] is over the window that starts at i
        more = _COUNTS[j] - have
        widest, have = np.maximum(widest[: len(widest) - more], widest[more:]), _COUNTS[j]
        fits = widest[:n] <= j
        if not fits.any():
            break  # nor can a longer window of narrower values
        np.putmask(sel, fits, j)
    return sel


def _word_starts(steps: np.ndarray) -> np.ndarray:
    """The places met from 0 on by going ``steps`` each time: jumps of 16 words are walked, the words between are met by
    all jumps side by side."""
    n = len(steps)
    after = np.minimum(np.arange(n + 1, dtype=np.int32) + np.append(steps, np.int32(0)).astype(np.int32), n)
    jump = after
    for _ in range(4):
        jump = jump.take(jump)
    leaps, at, heads = memoryview(jump), 0, []
    while at < n:
        heads.append(at)
        at = leaps[at]
    rows = [np.array(heads, np.int32)]
    for _ in range(15):
        rows.append(after.take(rows[-1]))
    met = np.stack(rows, 1).ravel()
    return met[met < n].astype(np.int64)


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, escapes) of unsigned 64-bit values; each word takes as many values as fit."""
    v = np.asarray(values, np.uint64)
    n = len(v)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    sel = _selectors(v)
    pos = _word_starts(_STEPS[sel])
    chosen = sel[pos]
    held = np.diff(pos, append=n)  # values of a word; its last place is free if the block ends
    shift = (np.arange(n) - np.repeat(pos, held)) * np.repeat(_WIDTHS[chosen], held)
    words = np.bitwise_or.reduceat(v << shift.astype(np.uint64), pos) | (chosen.astype(np.uint64) << np.uint64(60))
    p = np.flatnonzero(chosen == _ESCAPE)
    words[p] = np.arange(len(p), dtype=np.uint64) | np.uint64(_ESCAPE << 60)
    return words, v[pos[p]]


def decode(words: np.ndarray, escapes: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` values of a block."""
    sel = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([*_COUNTS, 1, 1], np.int64)[sel]
    at = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint64)
    for j in range(len(_BITS)):
        if len(p := np.flatnonzero(sel == j)):
            to, word, mask = at[p], words[p], np.uint64((1 << _BITS[j]) - 1)
            for k in range(_COUNTS[j]):
                out[to + k] = (word >> np.uint64(k * _BITS[j])) & mask
    p = np.flatnonzero(sel == _ESCAPE)
    out[at[p]] = escapes[(words[p] & np.uint64((1 << 60) - 1)).astype(np.int64)]
    return out[:n]


class Writer:
    """Streams one shard."""

    def __init__(self, sink, id_type: pa.DataType):
        self.sink, self.id_type = sink, id_type
        self.offset = self.ids = 0
        self.blocks, self.keys, self.sizes, self.parts, self.held = [], [], [], [], 0
        self.first = 0
        self._put(np.array([_MAGIC], "<u8").tobytes())

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.offset += len(data)

    def add(self, key: object, ids: np.ndarray) -> None:
        self.keys.append(key)
        self.sizes.append(len(ids))
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= BLOCK_IDS:
            self.close_block()

    def close_block(self) -> None:
        if not self.parts:
            return
        words, escapes = encode(np.concatenate(self.parts))
        self.blocks.append((self.offset, len(words), len(escapes), self.held, self.first, len(self.keys) - self.first))
        self._put(words.astype("<u8").tobytes() + escapes.astype("<u8").tobytes())
        self.ids += self.held
        self.parts, self.held, self.first = [], 0, len(self.keys)

    def close(self) -> None:
        self.close_block()
        docs_at = self.offset
        schema = pa.schema([("id", self.id_type), ("n", pa.int64())])
        buffer = pa.BufferOutputStream()
        with pa.ipc.new_stream(buffer, schema) as out:
            out.write_batch(pa.record_batch([pa.array(self.keys, self.id_type), pa.array(self.sizes, pa.int64())], schema=schema))
        self._put(buffer.getvalue().to_pybytes())
        blocks_at = self.offset
        self._put(np.array(self.blocks, "<u8").tobytes())
        self._put(np.array([docs_at, blocks_at, len(self.blocks), _MAGIC], "<u8").tobytes())


def write(docs: DataFrame, tokenizer_path: str | None = None, end_id: int = END_ID, path: str | None = None, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Writes shards and returns their manifest (shard, path, n_docs, n_ids, n_blocks), already computed.

    Documents are ranged by id (one shuffle) and encoded where their shard is written. A shard gets its name only when
    it is whole, so a task that ran twice leaves the same file.
    """
    spark = docs.sparkSession
    folder = path or work_dir(spark, "tokens")
    tok = tokenizer_path or bpe.default_path()
    id_type = to_arrow_type(docs.schema[id_col].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        shard = context.partitionId()
        fs, where = filesystem(folder)
        final, temporary = f"{where}/shard-{shard:06d}.s8b", f"{where}/.shard-{shard:06d}-{context.taskAttemptId()}"
        out = None
        for key, ids in bpe.encoded(batches, tok, end_id):
            if out is None:
                sink = fs.open_output_stream(temporary)
                out = Writer(sink, id_type)
            out.add(key, ids)
        if out is None:
            return
        out.close()
        sink.close()
        fs.move(temporary, final)
        yield pa.record_batch([[shard], [f"{folder}/shard-{shard:06d}.s8b"], [len(out.keys)], [out.ids], [len(out.blocks)]], names=["shard", "path", "n_docs", "n_ids", "n_blocks"])

    ranged = docs.select(id_col, text_col).repartitionByRange(id_col).sortWithinPartitions(id_col, text_col)
    return written(ranged.mapInArrow(run, "shard bigint, path string, n_docs bigint, n_ids bigint, n_blocks bigint"), "token-manifest")


def read(spark: SparkSession, manifest: DataFrame, id_type: str = "bigint", with_ids: bool = False, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) of every stored document, from the files alone, in their order.

    The driver knows one row per shard; tasks take runs of blocks of it.
    """
    base, tasks = 0, []
    for r in manifest.orderBy("shard").toLocalIterator():
        tasks += [(r.path, base, b, min(b + TASK_BLOCKS, r.n_blocks)) for b in range(0, r.n_blocks, TASK_BLOCKS)]
        base += r.n_ids
    schema = f"`{id_col}` {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    if not tasks:
        return spark.createDataFrame([], schema)
    parts = spark.createDataFrame(spark.sparkContext.parallelize(tasks, min(len(tasks), 10_000)), "path string, base bigint, b0 bigint, b1 bigint")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                fs, where = filesystem(t["path"])
                with fs.open_input_file(where) as f:
                    docs, blocks = _tables(f)
                    start = t["base"] + int(blocks[: t["b0"], 3].sum())
                    for offset, n_words, n_escapes, n_ids, first, n_docs in blocks[t["b0"] : t["b1"]].tolist():
                        raw = np.frombuffer(f.read_at((n_words + n_escapes) * 8, offset), "<u8")
                        ids = decode(raw[:n_words], raw[n_words:], n_ids).astype("<u4")
                        part = docs.slice(first, n_docs)
                        sizes = part.column(1).to_numpy()
                        ends = np.cumsum(sizes)
                        crc = [zlib.crc32(ids[e - n : e]) for e, n in zip(ends.tolist(), sizes.tolist())]
                        columns = [part.column(0).combine_chunks(), pa.array(start + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())]
                        names = [id_col, "start", "n_tokens", "ids_crc32"]
                        if with_ids:
                            columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int64))))
                            names.append("ids")
                        yield pa.RecordBatch.from_arrays(columns, names=names)
                        start += n_ids

    return parts.mapInArrow(run, schema)


def _tables(f) -> tuple[pa.Table, np.ndarray]:
    """The document and the block table of an open shard."""
    size = f.size()
    docs_at, blocks_at, n, magic = np.frombuffer(f.read_at(32, size - 32), "<u8").tolist()
    if magic != _MAGIC:
        raise ValueError("not a token file, or one that was cut off")
    docs = pa.ipc.open_stream(f.read_at(blocks_at - docs_at, docs_at)).read_all()
    return docs, np.frombuffer(f.read_at(n * 48, blocks_at), "<u8").astype(np.int64).reshape(-1, 6)
