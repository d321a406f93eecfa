"""Removal of long repeated byte strings, by suffix sorting in shards.

Every byte that lies in a string of ``length`` bytes which also starts anywhere else in the corpus goes. Strings are judged
on the input as it is, so order and partitions do not matter.

A string is called a window here. Each window chooses an anchor among its pieces of ``GRAM`` bytes, the one of least hash
(the first such one), so equal windows have equal anchors at equal places. Windows in a row that choose the same anchor form a
context: they and nothing else of the document. So:

1. The texts are written with row numbers, and a pass lists contexts: anchor, place, and a 128-bit hash of the
   bytes. Equal contexts are counted before and after the shuffle, however frequent; all windows of a context found twice are
   repeated.
2. Of different contexts of one anchor, one of each kind is fetched. Anchors are dealt to shards. An anchor whose
   contexts exceed ``shard_bytes`` is split: windows with the anchor in their first and in their second half have longer bytes
   in common, which become the new anchors, and so on until a window is its own anchor. So no group outgrows a shard but by
   equal windows, which are counted and not gathered.
3. Each shard's contexts are one string, whose suffixes are sorted with their common prefixes (``induced``): windows with a
   common prefix of ``length`` bytes are repeated.
4. Repeated windows return to their rows as ranges, and the rows lose the bytes that these cover.

Hashes of 128 bits stand for the bytes of equal contexts (and, for split anchors, 64-bit hashes deal them, where a collision
only brings together what is then compared by bytes).

Defined results: null and empty texts have no bytes; texts shorter than ``length`` lose nothing; copies of a row (with the
same id or not) count as repeats of each other; matches never cross rows; a text of any length is whole, and runs of
equal contexts in it (periodic text) are one row of the list; columns that are not named are not touched; an empty table gives
an empty table. What is left of a text can break a character, so it is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from genosieve.llm import induced
from genosieve.llm.common import work_dir, written

LENGTH, GRAM = 400, 48
#: Contexts that a shard holds, and the tuples of its sort that stay in memory.
SHARD_BYTES, QUEUE_BYTES = 6 << 20, 48 << 20
#: Bytes of texts whose anchors are sought at once.
CHUNK = 1 << 19
_LOW = np.uint64((1 << 20) - 1)  # room for a place within a chunk and its neighbourhood
_BASE = 0x9E3779B97F4A7C15 | 1
_CONTEXT = "row bigint, start bigint, windows int, anchor int, times int, a bigint, c1 bigint, c2 bigint"
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if n not in _POWERS:
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        _POWERS.clear()
        _POWERS[n] = tuple(out)
    return _POWERS[n]


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of every ``gram`` bytes in a row."""
    up, down = _powers(max(2 * CHUNK, 1 << (len(data) + 1).bit_length()))
    reach = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=reach[1:])
    h = (reach[gram:] - reach[:-gram]) * down[: len(data) - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def choices(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(place of the anchor of every window of ``length`` bytes, hashes of all grams); ``data`` is shorter than 2^20."""
    h = gram_hashes(data, gram)
    w = length - gram + 1
    key = (h & ~_LOW) | np.arange(len(h), dtype=np.uint64)
    n = len(h) - w + 1
    blocks = np.full((-(-len(h) // w), w), ~np.uint64(0))
    blocks.reshape(-1)[: len(h)] = key
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(back[:n], ahead[w - 1 : w - 1 + n]) & _LOW).astype(np.int64), h


def contexts(rows: list[int], texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """The contexts of whole texts as columns; equal ones that follow each other are one, found ``times`` times."""
    out: dict[str, list] = {k: [] for k in ("row", "start", "windows", "anchor", "a", "digest")}
    for row, text in zip(rows, texts):
        for at in range(0, len(text) - length + 1, CHUNK):
            # windows that start in this chunk; their anchor's context may have begun in the chunk before
            data = np.frombuffer(text, np.uint8, min(len(text) - at, CHUNK + length - 1), at)
            place, h = choices(data, length, gram)
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            stop = np.append(first[1:], len(place))
            out["row"].append(np.full(len(first), row, np.int64))
            out["start"].append(first + at)
            out["windows"].append(stop - first)
            out["anchor"].append(place[first] - first)
            out["a"].append(h[place[first]].view(np.int64))
            view = memoryview(text)
            out["digest"] += [xxhash.xxh3_128_digest(view[at + i : at + j + length - 1]) for i, j in zip(first.tolist(), stop.tolist())]
    if not out["row"]:
        return {}
    c = {k: np.concatenate(v) for k, v in out.items() if k != "digest"}
    digest = np.frombuffer(b"".join(out["digest"]), "<i8").reshape(-1, 2)
    c["c1"], c["c2"] = digest[:, 0], digest[:, 1]
    same = np.zeros(len(digest), bool)
    same[1:] = (c["row"][1:] == c["row"][:-1]) & (c["start"][1:] == c["start"][:-1] + c["windows"][:-1])
    for k in ("windows", "a", "c1", "c2"):
        same[1:] &= c[k][1:] == c[k][:-1]
    head = np.flatnonzero(~same)
    c = {k: v[head] for k, v in c.items()}
    c["times"] = np.diff(head, append=len(same))
    return c


def _slices(batch: pa.RecordBatch, column: int, limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose values of a column have so many bytes, or one row."""
    size = np.array([len(x.as_buffer()) if x.is_valid else 0 for x in batch.column(column)], np.int64)
    reach, at = np.cumsum(size), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def list_contexts(store: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(row, start, windows, anchor, times, a, c1, c2) of a table (row, data)."""
    names = ["row", "start", "windows", "anchor", "times", "a", "c1", "c2"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 1):
                c = contexts(part.column(0).to_pylist(), part.column(1).to_pylist(), length, gram)
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array(c[k].astype(t.to_pandas_dtype()), t) for k, t in zip(names, types)], names=names)

    return store.where(F.octet_length("data") >= length).select("row", "data").mapInArrow(run, _CONTEXT)


def _fetch(store: DataFrame, needed: DataFrame, length: int) -> DataFrame:
    """(key, low, high, row, start, anchor, n, bytes) of needed contexts; a row's contexts are as many as its text allows."""
    wanted = needed.groupBy("row").agg(F.collect_list(F.struct("start", "windows", "anchor", "n", "a", "low", "high")).alias("wanted"))
    fields = [("key", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("row", pa.int64()), ("start", pa.int64()), ("anchor", pa.int32()), ("n", pa.int64()), ("bytes", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 1):
                rows = []
                for row, data, wanted in zip(*(part.column(i).to_pylist() for i in range(3))):
                    rows += [(w["a"], w["low"], w["high"], row, w["start"], w["anchor"], w["n"], data[w["start"] : w["start"] + w["windows"] + length - 1]) for w in wanted]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), fields)], names=[n for n, _ in fields])

    return store.where(F.octet_length("data") >= length).select("row", "data").join(wanted, "row").mapInArrow(run, "key bigint, low int, high int, row bigint, start bigint, anchor int, n bigint, bytes binary")


def _halves(contexts: DataFrame, length: int) -> DataFrame:
    """Contexts by longer anchors: the windows with the anchor in the first and in the second half of its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 7):
                rows = []
                for key, low, high, row, start, anchor, n, data in zip(*(c.to_pylist() for c in part.columns)):
                    middle = (low + high) // 2
                    for a, b in ((low, middle), (middle + 1, high)):
                        first, last = max(anchor - b, 0), min(anchor - a, len(data) - length)
                        if first <= last:
                            own = data[first : last + length]
                            place = anchor - first
                            core = xxhash.xxh3_64_digest(own[place - a : place + length - b], seed=(key ^ a * 1024 ^ b) & (1 << 64) - 1)
                            digest = np.frombuffer(xxhash.xxh3_128_digest(own), "<i8")
                            rows.append((int.from_bytes(core, "little", signed=True), a, b, row, start + first, place, n, own, int(digest[0]), int(digest[1])))
                cols = list(zip(*rows)) or [[]] * 10
                kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["key", "low", "high", "row", "start", "anchor", "n", "bytes", "c1", "c2"])

    return contexts.select("key", "low", "high", "row", "start", "anchor", "n", "bytes").mapInArrow(run, "key bigint, low int, high int, row bigint, start bigint, anchor int, n bigint, bytes binary, c1 bigint, c2 bigint")


def split_hot(contexts: DataFrame, length: int, shard_bytes: int) -> tuple[DataFrame, list[DataFrame]]:
    """(contexts whose keys have at most ``shard_bytes``, repeated ranges found on the way). A key that has more is split, at most
    nine times, since its places halve; its equal parts are counted and one of them stays."""
    cold, ranges = [], []
    while True:
        size = contexts.groupBy("key").agg(F.sum(F.octet_length("bytes")).alias("size"), F.count("*").alias("kinds"))
        hot = written(size.where((F.col("size") > shard_bytes) & (F.col("kinds") > 1)).select("key"), "hot")
        if hot.isEmpty():
            return _union([*cold, contexts]), ranges
        cold.append(contexts.join(hot, "key", "left_anti"))
        parts = written(_halves(contexts.join(hot, "key", "left_semi"), length), "halves")
        kinds = ["key", "low", "high", "c1", "c2"]
        counted = parts.groupBy(kinds).agg(F.sum("n").alias("total"), F.count("*").alias("found"), F.min(F.struct("row", "start", "anchor")).alias("one"))
        counted = written(counted, "kinds")
        again = counted.where("found > 1").select(*kinds)
        ranges.append(parts.where("n = 1").join(again, kinds, "left_semi").select("row", "start", (F.col("start") + F.octet_length("bytes") - length + 1).alias("stop")))
        one = counted.select("one.row", "one.start", *kinds, "total")
        contexts = parts.drop("n").join(one, ["row", "start", *kinds]).select("key", "low", "high", "row", "start", "anchor", F.col("total").alias("n"), "bytes")
        contexts = written(contexts, "split")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def sort_shards(contexts: DataFrame, length: int, shard_bytes: int, queue_bytes: int = QUEUE_BYTES, total: int | None = None) -> DataFrame:
    """(row, start, stop): ranges of windows that are repeated, of the contexts that stand for themselves alone. ``total`` is about
    how many bytes they have."""
    total = contexts.agg(F.sum(F.octet_length("bytes"))).first()[0] or 0 if total is None else total
    folder = work_dir(contexts.sparkSession, "suffixes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, starts, alone, parts = [], [], [], []
        for batch in batches:
            rows.append(batch.column(0).to_numpy())
            starts.append(batch.column(1).to_numpy())
            alone.append(batch.column(2).to_numpy() == 1)
            parts += [x.as_py() for x in batch.column(3)]
        if not parts:
            return
        rows, starts, alone = np.concatenate(rows), np.concatenate(starts), np.concatenate(alone)
        text = np.frombuffer(b"\xff".join(parts) + b"\xff", np.uint8)  # a byte that UTF-8 has not
        size = np.array([len(p) for p in parts], np.int64)
        del parts
        first = np.cumsum(size + 1) - size - 1
        hit = np.flatnonzero(induced.repeated(text, length, {"folder": folder, "limit": queue_bytes}))
        owner = np.searchsorted(first, hit, side="right") - 1
        keep = alone[owner] & (hit - first[owner] <= size[owner] - length)
        hit, owner = hit[keep], owner[keep]
        if len(hit):
            head = np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(owner) != 0)])
            at = np.flatnonzero(head)
            count, who = np.diff(at, append=len(hit)), owner[at]
            start = starts[who] + hit[at] - first[who]
            yield pa.RecordBatch.from_arrays([pa.array(rows[who]), pa.array(start), pa.array(start + count)], names=["row", "start", "stop"])

    shards = contexts.select("row", "start", "n", "bytes", "key").repartition(int(total // shard_bytes) + 1, "key").drop("key")
    return shards.mapInArrow(run, "row bigint, start bigint, stop bigint")


def covered(n: int, starts: list[int], stops: list[int], length: int) -> tuple[int, list[tuple[int, int]]]:
    """(runs of removed bytes, what is left as byte ranges) of a text of n bytes, from ranges of repeated windows."""
    runs, left, at = 0, [], 0
    end = -1
    for a, b in sorted(zip(starts, stops)):
        if a > end:
            runs += 1
            if a > at:
                left.append((at, a))
        end = max(end, b + length - 1)
        at = end
    if at < n:
        left.append((at, n))
    return runs, left


def remove(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, queue_bytes: int = QUEUE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept) of every row."""
    if not 0 < gram <= length < 1 << 17:
        raise ValueError("an anchor is a part of the string")
    store = written(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("data"), F.monotonically_increasing_id().alias("row")), "texts")
    found = written(list_contexts(store, length, gram), "contexts")
    kinds = found.groupBy("c1", "c2").agg(F.sum("times").alias("n"), *(F.first(c).alias(c) for c in ("a", "row", "start", "windows", "anchor")))
    kinds = written(kinds, "kinds")
    again = kinds.where("n > 1").select("c1", "c2")
    whole = found.select("c1", "c2", "row", "start", (F.col("start") + F.col("windows") * F.col("times")).alias("stop")).join(again, ["c1", "c2"], "left_semi").select("row", "start", "stop")
    shared = kinds.groupBy("a").agg(F.count("*").alias("kinds")).where("kinds > 1").select("a")
    needed = kinds.drop("c1", "c2").join(shared, "a", "left_semi").withColumns({"low": F.lit(0), "high": F.lit(length - gram), "size": F.col("windows").cast("long") + length - 1})
    needed = written(needed, "needed")
    total = needed.agg(F.sum("size")).first()[0] or 0
    hot = written(needed.groupBy("a").agg(F.sum("size").alias("size")).where(F.col("size") > shard_bytes).select("a"), "hot")
    ranges = [whole, sort_shards(_fetch(store, needed.join(hot, "a", "left_anti"), length), length, shard_bytes, queue_bytes, total)]
    if not hot.isEmpty():
        parts, found_on_the_way = split_hot(written(_fetch(store, needed.join(hot, "a", "left_semi"), length), "fetched"), length, shard_bytes)
        ranges += [*found_on_the_way, sort_shards(parts, length, shard_bytes, queue_bytes)]
    ranges = _union(ranges)
    marks = ranges.groupBy("row").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch, 1, 4 * CHUNK):
                rows = []
                for data, starts, stops in zip(*(part.column(i).to_pylist() for i in (1, 2, 3))):
                    runs, left = covered(len(data), starts or [], stops or [], length)
                    kept = b"".join(data[a:b] for a, b in left)
                    rows.append((len(data), len(data) - len(kept), runs, kept))
                cols = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=[id_col, "n_bytes", "n_removed", "n_spans", "kept"])

    joined = store.join(written(marks, "marks"), "row", "left").select(F.col("id").alias(id_col), "data", "starts", "stops")
    return joined.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
