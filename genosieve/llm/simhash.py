"""SimHash near-duplicates through a Gray-order hierarchical index.

Distinct fingerprints are sorted by Gray rank, so that neighbours share most bits, and cut into blocks of bounded size.
A block's index has levels of nodes; a node holds the bits that all fingerprints below it share and that no ancestor
holds yet. A query adds up differences from the top down and drops a whole group as soon as its sum exceeds the limit.
Blocks are joined with blocks: their own top patterns decide which pairs of blocks can hold a link at all.

Defined results: null texts count as empty; very long texts are hashed whole, in bounded pieces; extra columns, also ones
named like the operator's own, are not touched; no words give fingerprint 0, which links like any other; repeated rows and
null ids keep their rows (a component's id is its least non-null id); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from genosieve.llm.common import written
from genosieve.llm.components import components

MAX_DISTANCE = 2
#: Fingerprints in a block; a task holds two blocks and the nodes above them.
BLOCK = 65_536
#: Children of a node.
FANOUT = 8
#: Query-node tests held at a time.
FRONTIER = 1 << 20
_SEED = 42


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of the 3-word shingles of the lower-cased whole text; 0 if there are no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < 3:
        return digest(b" ".join(words), _SEED)
    h = np.fromiter((digest(b"%b %b %b" % t, _SEED) for t in zip(words, words[1:], words[2:])), np.uint64, len(words) - 2)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):  # long texts in bounded pieces
        bits = np.unpackbits(h[at : at + 4096].astype(">u8").view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each 64-bit code in the reflected Gray sequence."""
    r = codes.astype(np.uint64).copy()
    for s in (1, 2, 4, 8, 16, 32):
        r ^= r >> np.uint64(s)
    return r


class GrayIndex:
    """Levels of shared masked patterns over fingerprints in Gray order."""

    def __init__(self, codes: np.ndarray, fanout: int = FANOUT):
        codes = codes.astype(np.uint64)
        self.order = np.argsort(gray_rank(codes), kind="stable")
        ands = ors = codes[self.order]
        self.codes, self.fanout = ands, fanout
        up = [(ands, ors)]
        while len(ands) > 1:
            starts = np.arange(0, len(ands), fanout)
            ands, ors = np.bitwise_and.reduceat(ands, starts), np.bitwise_or.reduceat(ors, starts)
            up.append((ands, ors))
        self.levels = []  # from the root: (pattern, mask of the shared bits that no ancestor holds)
        above = np.zeros(1, np.uint64)
        for ands, ors in reversed(up):
            shared = ~(ands ^ ors)
            parent = np.arange(len(ands)) // fanout if self.levels else np.zeros(1, int)
            self.levels.append((ands, shared & ~above[parent]))
            above = shared

    def root(self) -> tuple[int, int]:
        """Pattern and mask of the bits that the whole block shares."""
        ands, mask = self.levels[0]
        return int(ands[0] & mask[0]), int(mask[0])

    def search(self, queries: np.ndarray, limit: int = MAX_DISTANCE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (query, code) of every pair within ``limit``, in pieces of bounded size."""
        queries = queries.astype(np.uint64)
        step = 256
        at = 0
        while at < len(queries):
            q = np.arange(at, min(at + step, len(queries)))
            at += len(q)
            node = np.zeros(len(q), np.int64)
            gone = np.zeros(len(q), np.uint8)
            most = len(q)
            for depth, (pattern, mask) in enumerate(self.levels):
                if depth:
                    kids = node[:, None] * self.fanout + np.arange(self.fanout)
                    real = kids < len(pattern)
                    q = np.repeat(q, self.fanout)[real.ravel()]
                    gone = np.repeat(gone, self.fanout)[real.ravel()]
                    node = kids.ravel()[real.ravel()]
                    most = max(most, len(q))
                gone = gone + np.bitwise_count((queries[q] ^ pattern[node]) & mask[node])
                near = gone <= limit
                q, node, gone = q[near], node[near], gone[near]
            if len(q):
                yield q, self.order[node]
            step = max(16, min(8192, step * 2 if most * 4 < FRONTIER else step // 2 if most > FRONTIER else step))


class Forest:
    """Union of pairs as they come; keeps one root per position."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(root, up := root[root]):
                root[:] = up


def links_between(a: np.ndarray, b: np.ndarray | None, limit: int = MAX_DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (member, root) of the links within ``a``, or between ``a`` and ``b``. It has fewer rows than
    fingerprints however large a group of near copies is, and joins exactly what the links join."""
    both = a if b is None else np.concatenate([a, b])
    forest, shift = Forest(len(both)), 0 if b is None else len(a)
    for q, c in GrayIndex(a if b is None else b).search(a, limit):
        other = q != c if b is None else slice(None)
        forest.add(q[other], c[other] + shift)
    moved = np.flatnonzero(forest.root != np.arange(len(both)))
    return both[moved], both[forest.root[moved]]


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, fp): fp holds the 64 bits as a signed long. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=[id_col, "fp"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fp bigint")


def _rank_column(fp: F.Column) -> F.Column:
    """Gray rank as a long whose signed order is the unsigned order of the rank."""
    r = fp
    for s in (1, 2, 4, 8, 16, 32):
        r = r.bitwiseXOR(F.shiftrightunsigned(r, s))
    return r.bitwiseXOR(F.lit(-(1 << 63)))


def link_forest(classes: DataFrame, limit: int = MAX_DISTANCE, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp`` whose components are those of all pairs within ``limit``.

    Blocks are ranges of Gray rank with near-equal counts. Only their bounds, patterns and the pairs of blocks that may
    hold links are known to the driver: one row per ``block`` fingerprints.
    """
    spark = classes.sparkSession
    n = classes.count()
    schema = "u bigint, v bigint"
    if n < 2:
        return spark.createDataFrame([], schema)
    ranked = classes.select("fp", _rank_column(F.col("fp")).alias("rank"))
    k = -(-n // block)
    # near-equal ranges of counts; the bounds are approximate percentiles, so any bounds give the same links
    bounds = sorted(set(ranked.agg(F.percentile_approx("rank", [i / k for i in range(1, k)], 10 * k + 1000)).first()[0])) if k > 1 else []
    at = F.lit(0)
    if bounds:
        cuts = F.array(*(F.lit(b) for b in bounds))
        at = F.size(F.filter(cuts, lambda c: c < F.col("rank"))) if len(bounds) < 64 else _bucket(F.col("rank"), bounds)
    blocked = written(ranked.withColumn("block", at.cast("int")).select("fp", "block"), "blocks")
    tops = blocked.groupBy("block").agg(F.bit_and("fp").alias("ands"), F.bit_or("fp").alias("ors")).collect()  # one row a block
    ids = np.array([r.block for r in tops])
    ands, ors = (np.array([r[c] for r in tops], np.int64).view(np.uint64) for c in ("ands", "ors"))
    shared = ~(ands ^ ors)
    pairs = []
    for i in range(len(tops)):  # prune pairs of whole blocks by the bits that both of them share
        j = np.flatnonzero((np.bitwise_count((ands[i] ^ ands) & shared[i] & shared) <= limit) & (ids >= ids[i]))
        pairs += [(int(ids[i]), int(ids[x])) for x in j]
    plan = spark.createDataFrame(pd.DataFrame(pairs, columns=["a", "b"]), "a int, b int")
    sides = plan.select(F.col("a").alias("block"), "a", "b").unionByName(plan.where("a != b").select(F.col("b").alias("block"), "a", "b"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        fp, own = pdf["fp"].to_numpy(np.int64).view(np.uint64), (pdf["block"] == pdf["a"]).to_numpy()
        same = pdf["a"].iat[0] == pdf["b"].iat[0]
        u, v = links_between(fp[own], None if same else fp[~own], limit)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return blocked.join(sides, "block").groupBy("a", "b").applyInPandas(run, schema)


def _bucket(rank: F.Column, bounds: list[int]) -> F.Column:
    """Number of bounds below the rank, by halving."""
    def half(lo: int, hi: int) -> F.Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(rank > F.lit(bounds[mid]), half(mid + 1, hi)).otherwise(half(lo, mid))

    return half(0, len(bounds))


def _classes(prints: DataFrame, limit: int, block: int, id_col: str) -> DataFrame:
    """(fp, root, component_id, n_same) of the distinct fingerprints; component_id is null if no document has an id."""
    classes = written(prints.groupBy("fp").agg(F.min(id_col).alias("first_id"), F.count("*").alias("n_same")), "classes")
    roots = components(link_forest(classes, limit, block))
    placed = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return placed.join(least, "root").select("fp", "root", "component_id", "n_same")


def near_duplicates(docs: DataFrame, limit: int = MAX_DISTANCE, block: int = BLOCK, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, fp, component_id, n_same): one row per input row; fingerprints within ``limit`` bits are linked."""
    prints = written(fingerprints(docs, text_col, id_col), "prints")
    return prints.join(_classes(prints, limit, block, id_col), "fp").select(id_col, "fp", "component_id", "n_same")


def keep_first(docs: DataFrame, limit: int = MAX_DISTANCE, block: int = BLOCK, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One document of each component stays, with all its columns: the one whose id is the component's; where several
    rows have that id, of those in the component the one with the least fingerprint (as a signed long), then the least
    text. Documents without an id stay only if no document of their component has one, and then one of them."""
    prints = written(fingerprints(docs, text_col, id_col), "prints")
    classes = written(_classes(prints, limit, block, id_col), "named")
    names = [F.col(f"`{c}`") for c in docs.columns]
    head, own, n_rows, row, root = (f"#{x}" + "#" * max(map(len, docs.columns)) for x in ("id", "own", "rows", "row", "root"))  # names that are free
    heads = prints.join(classes, "fp").where(F.col(id_col) == F.col("component_id")).groupBy("root").agg(F.min(id_col).alias(head), F.min("fp").alias(own))
    rows = prints.groupBy(F.col(id_col).alias(head)).agg(F.count("*").alias(n_rows))
    heads = written(heads.join(rows, head).select(head, own, n_rows), "heads")
    once = heads.where(F.col(n_rows) == 1).select(head)
    # sorted on both sides at every size: the heads grow with the documents and have no bound that a broadcast could rely on
    kept = docs.join(once.hint("merge"), docs[id_col] == F.col(head), "left_semi").select(*names)
    again = heads.where(F.col(n_rows) > 1).select(head, own)
    if not again.isEmpty():  # ids that several rows share: their texts tell which row it is
        shared = _with_fingerprint(docs.join(again, docs[id_col] == F.col(head), "left_semi").select(*names), text_col)
        met = shared.join(again, (shared[id_col] == F.col(head)) & (shared[shared.columns[-1]] == F.col(own)))
        one = met.groupBy(head, own).agg(F.min_by(F.struct(*(shared[c] for c in docs.columns)), F.coalesce(shared[text_col], F.lit(""))).alias(row))
        kept = kept.unionByName(one.select(*(F.col(row)[c].alias(c) for c in docs.columns)))
    nameless = _with_fingerprint(docs.where(F.col(id_col).isNull()), text_col)
    alone = classes.where("component_id is null").select(F.col("fp").alias(own), F.col("root").alias(root))
    rest = nameless.join(alone, nameless[nameless.columns[-1]] == F.col(own)).dropDuplicates([root])
    return kept.unionByName(rest.select(*(nameless[c] for c in docs.columns)))


def _with_fingerprint(docs: DataFrame, text_col: str) -> DataFrame:
    """All columns and, last, the fingerprint under a name that is free."""
    names = docs.columns
    at, name = names.index(text_col), "#fp" + "#" * max(map(len, names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t) for t in batch.column(at).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fp)], names=[*names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))
