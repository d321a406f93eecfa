"""Neighbour joining: the trees of many replicates of many groups at once, and of one large group by bounded search.

A replicate's distances follow from the group's features and the replicate's weights, so a task gets the features, which are
few, and not the distances, which are many: one matrix product gives them. Small groups of equal size join the trees of all their
replicates in step, over pairs as rows and trees as columns; large ones keep one matrix, changed in place, and look only at rows
whose bound allows the least value.

The pair with the least ``(m - 2) d(i, j) - (r(i) + r(j))`` is joined, of equal ones that with the smallest numbers; tips are 0 …
n - 1, a joined node is the next number, and the root is the last. Negative lengths are 0. Trees are numbered depth-first as
they are built, and carry the signatures of ``trees.clade_signatures``.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

#: Groups of more tips than this join one tree at a time; numbers of all matrices of smaller ones that a task holds.
IN_STEP, HELD = 64, 2_000_000
#: Numbers of the distances that are joined in one go, so that they stay near the processor.
CHUNK = 120_000
NODES = ("node_id", "parent_id", "name", "length", "is_tip")
PLACES = ("pre", "size", "n_tips", "sig1", "sig2")


def in_step(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parents, lengths) of the trees of distance matrices d[replicate]; -1 is the parent of a root."""
    k, n = d.shape[:2]
    if n == 1:
        return np.tile([1, -1], (k, 1)), np.zeros((k, 2))
    j, i = np.tril_indices(n, -1)
    parent, length = joined(np.ascontiguousarray(d[:, i, j].T, float), n)
    return parent.T, length.T


def joined(d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(parents, lengths) [node, tree] of the trees of distances d[pair, tree], pairs (0, 1), (0, 2), (1, 2), (0, 3), …; n > 1."""
    top = np.abs(d).max(initial=1.0)
    number = (n * n - 1).bit_length()  # bits of a pair's number
    # a join makes a distance 1.5 times as long at most and a bit finer, a criterion is up to 3 n distances
    if math.log2(top) + (n - 2) * math.log2(3) + math.log2(3 * n) + number <= 53 and (d == np.rint(d)).all():
        return _joined_whole(d, n, 2.0 ** (n - 2 + number), (1 << number) - 1)
    full = np.zeros((d.shape[1], n, n))
    j, i = np.tril_indices(n, -1)
    full[:, i, j] = full[:, j, i] = d.T
    parent, length = _joined_plain(full)
    return parent.T, length.T


@functools.cache
def _tables(m: int) -> tuple[np.ndarray, ...]:
    """Of m nodes: the pairs (i, j), i < j, and by pair that is joined: the nodes that stay, the pairs of i and of j with them, and
    the pairs among them."""
    j, i = np.tril_indices(m, -1)
    number = np.zeros((m, m), np.int64)
    number[i, j] = number[j, i] = np.arange(len(i))
    stay = np.array([[x for x in range(m) if x not in pair] for pair in zip(i.tolist(), j.tolist())], np.int64).T
    b, a = np.tril_indices(m - 2, -1)
    return i, j, stay, number[stay, i], number[stay, j], number[stay[a], stay[b]]


def _joined_whole(d: np.ndarray, n: int, scale: float, low_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """``joined`` for whole numbers so small that all sums are exact: a pair's criterion carries its number in the low bits, so
    that one minimum finds the first of the least pairs."""
    k = d.shape[1]
    each, d = np.arange(k), d * scale
    parent, length = np.full((2 * n - 1, k), -1), np.zeros((2 * n - 1, k))
    ids = np.repeat(np.arange(n)[:, None], k, axis=1)
    j, i = np.tril_indices(n, -1)
    r = np.zeros((n, k))
    for x in range(n):
        r[x] = d[(i == x) | (j == x)].sum(axis=0)
    for new in range(n, 2 * n - 2):
        m = len(r)
        i, j, stay, to_i, to_j, rest = _tables(m)
        at = np.arange(m)[:, None]
        q = d * (m - 2)
        q -= (r - at * m).take(i, axis=0)
        q -= (r - at).take(j, axis=0)
        a, b = np.divmod(q.min(axis=0).astype(np.int64) & low_bits, m)
        pair = b * (b - 1) // 2 + a
        dij, (ra, rb), (ia, ib) = d[pair, each], (r[a, each], r[b, each]), (ids[a, each], ids[b, each])
        la = dij / 2 + (ra - rb) / (2 * (m - 2))
        parent[ia, each] = parent[ib, each] = new
        length[ia, each], length[ib, each] = np.maximum(la, 0) / scale, np.maximum(dij - la, 0) / scale

        def of(table: np.ndarray, values: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
            index = table.take(pair, axis=1)
            index *= k
            index += each
            return values.reshape(-1).take(index, out=out, mode="clip")

        di, dj = of(to_i, d), of(to_j, d)
        u = di + dj
        u -= dij
        u /= 2
        rows, names, out = np.empty((m - 1, k)), np.empty((m - 1, k), np.int64), np.empty(((m - 1) * (m - 2) // 2, k))
        rows[:-1] = of(stay, r) - di - dj + u
        rows[-1] = u.sum(axis=0)
        names[:-1] = of(stay, ids)
        names[-1] = new
        of(rest, d, out[: len(rest)])
        out[len(rest) :] = u
        d, r, ids = out, rows, names
    for x in (0, 1):
        parent[ids[x], each] = 2 * n - 2
        length[ids[x], each] = np.maximum(d[0] / 2, 0) / scale
    return parent, length


def _joined_plain(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parents, lengths) [tree, node] for matrices d[tree] of any numbers."""
    k, n = d.shape[:2]
    each = np.arange(k)
    parent, length = np.full((k, 2 * n - 1), -1), np.zeros((k, 2 * n - 1))
    ids = np.tile(np.arange(n), (k, 1))
    for new in range(n, 2 * n - 2):
        m, r = d.shape[1], d.sum(axis=2)
        q = (m - 2) * d - (r[:, :, None] + r[:, None, :])
        q[:, np.arange(m), np.arange(m)] = np.inf
        i, j = np.divmod(q.reshape(k, -1).argmin(axis=1), m)
        dij = d[each, i, j]
        li = dij / 2 + (r[each, i] - r[each, j]) / (2 * (m - 2))
        a, b = ids[each, i], ids[each, j]
        parent[each, a] = parent[each, b] = new
        length[each, a], length[each, b] = np.maximum(li, 0), np.maximum(dij - li, 0)
        u = (d[each, i] + d[each, j] - dij[:, None]) / 2
        keep = np.ones((k, m), bool)
        keep[each, i] = keep[each, j] = False
        at = np.nonzero(keep)[1].reshape(k, m - 2)
        out = np.zeros((k, m - 1, m - 1))
        out[:, :-1, :-1] = d[each[:, None, None], at[:, :, None], at[:, None, :]]
        out[:, -1, :-1] = out[:, :-1, -1] = u[each[:, None], at]
        d, ids = out, np.concatenate([ids[each[:, None], at], np.full((k, 1), new)], axis=1)
    for at in (0, 1):
        parent[each, ids[:, at]] = 2 * n - 2
        length[each, ids[:, at]] = np.maximum(d[:, 0, 1] / 2, 0)
    return parent, length


def bounded(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(parents, lengths) of the tree of one matrix, which is used up.

    With s = r / (m - 2), a row's least value is known from the least ``d(i, j) - s(j)``. That of the last time the row was searched, or
    of a distance that came since, less what any s has grown since, is a bound; rows are searched by their bound until it
    exceeds the best value. The bounds allow for rounding, the values are compared exactly."""
    n = len(d)
    parent, length = np.full(2 * n - 1, -1), np.zeros(2 * n - 1)
    ids, r, m = np.arange(n), d.sum(axis=1), n
    np.fill_diagonal(d, np.inf)
    if n > 2:
        s = r / (n - 2)
        least, grown, now = (d - s[None]).min(axis=1), np.zeros(n), 0.0
    for new in range(n, 2 * n - 2):
        bound = (m - 2) * (least[:m] - (now - grown[:m])) - r[:m]
        bound -= 1e-9 * np.abs(bound)
        order, at, width, best, found = np.argsort(bound), 0, 2, np.inf, (n + n, n + n, 0, 0)
        while at < m and bound[order[at]] <= best:
            rows = order[at : at + width]
            rows = rows[bound[rows] <= best]
            own = d[rows, :m] * (m - 2)
            own -= r[rows, None] + r[None, :m]
            low = own.min(axis=1)
            least[rows], grown[rows] = (low + r[rows]) / (m - 2), now
            if low.min() <= best:
                if low.min() < best:
                    best, found = low.min(), (n + n, n + n, 0, 0)
                for x in np.flatnonzero(low == best):
                    row, cols = rows[x], np.flatnonzero(own[x] == best)
                    col = cols[ids[cols].argmin()]
                    found = min(found, (*sorted((ids[row], ids[col])), row, col))
            at, width = at + width, 2 * width
        a, b = found[:2]
        i, j = found[2:] if ids[found[2]] == a else found[:1:-1]
        dij = d[i, j]
        li = dij / 2 + (r[i] - r[j]) / (2 * (m - 2))
        parent[a] = parent[b] = new
        length[a], length[b] = max(li, 0.0), max(dij - li, 0.0)
        di, dj = d[i, :m].copy(), d[j, :m].copy()
        di[i] = dj[j] = 0.0
        u = (di + dj - dij) / 2
        r[:m] += u - di - dj
        u[i] = u[j] = 0.0
        r[i] = u.sum()
        u[i] = np.inf
        d[i, :m] = d[:m, i] = u
        ids[i] = new
        last = m - 1  # the last row takes the place that is free
        if j != last:
            d[j, :m] = d[last, :m]
            d[:m, j] = d[:m, last]
            d[j, j] = np.inf
            ids[j], r[j], least[j], u[j] = ids[last], r[last], least[last], u[last]
            i = j if i == last else i
            s[j] = s[last]
            grown[j] = grown[last]
        m = last
        if m < 3:
            continue
        t = r[:m] / (m - 2)
        others = np.arange(m) != i
        now += (t - s[:m])[others].max()
        s = t
        came = u[:m] - t[i] + (now - grown[:m])  # on the scale of the row's own time
        least[:m] = np.minimum(least[:m], came)
        least[i], grown[i] = (d[i, :m] - t).min(), now
    a, b = ids[:2]
    parent[a] = parent[b] = 2 * n - 2
    length[a] = length[b] = max(d[0, 1] / 2, 0.0)
    return parent, length


def places(parent: np.ndarray, n: int, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
    """(pre, size, n_tips, sig1, sig2) of trees whose children come before their parents; children by number."""
    k, total = parent.shape
    each = np.arange(k)
    size, tips = np.ones((k, total), np.int64), np.zeros((k, total), np.int64)
    sig = np.zeros((2, k, total), np.int64)
    tips[:, :n] = 1
    sig[:, :, :n] = hashes[:, None, :]
    for x in range(total - 1):
        p = parent[:, x]
        size[each, p] += size[:, x]
        tips[each, p] += tips[:, x]
        sig[:, each, p] ^= sig[:, :, x]
    pre, taken = np.zeros((k, total), np.int64), np.zeros((k, total), np.int64)
    # an elder child, of smaller number, comes first; parents have greater numbers than children, so from the root down
    first = np.full((k, total), -1)
    for x in range(total - 1):
        p = parent[:, x]
        known = first[each, p] >= 0
        pre[:, x] = np.where(known, taken[each, p], 0)  # nodes of the elder children, for now
        taken[each, p] += size[:, x]
        first[each, p] = x
    for x in range(total - 2, -1, -1):
        pre[:, x] += pre[each, parent[:, x]] + 1
    return pre, size, tips, sig[0], sig[1]


def distances(features: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Weighted symmetric differences [replicate, i, j] of rows of 0 and 1, by one product per replicate."""
    x = features.astype(float)
    both = (x[None] * weights[:, None, :]) @ x.T
    total = weights @ x.T
    d = total[:, :, None] + total[:, None, :] - 2 * both
    d[:, np.arange(len(x)), np.arange(len(x))] = 0.0
    return d


def bootstrap_trees(long: DataFrame, words: DataFrame, replicates: int, seed: int = 1, group: str = "lineage") -> DataFrame:
    """(group, replicate, node_id, parent_id, name, length, is_tip, pre, size, n_tips, sig1, sig2): a tree for every replicate of a
    group, whose weights are those of ``trees.bootstrap_weights``. long(group, variant_no, feature_no), words(group, feature_no).

    A group's features are one row, bounded by the limit on variants; its replicates are dealt to tasks in blocks."""
    n = words.groupBy(group).agg((F.max("feature_no") + 1).alias("n_words"))
    rows = long.groupBy(group).agg(F.collect_list("variant_no").alias("variants"), F.collect_list("feature_no").alias("features"), F.count_distinct("variant_no").alias("v")).join(n, group).where("v > 1")
    block = F.when(F.col("v") > IN_STEP, 1).otherwise(F.least(F.lit(replicates), F.greatest(F.lit(1), (HELD / (F.col("v") * F.col("v"))).cast("int"))))
    rows = rows.withColumn("block", block).withColumn("from", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.col("block"))))
    spark = long.sparkSession  # a task's work is in its trees, not in the bytes that it reads, so tasks are not merged by bytes
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    rows = rows.repartition(tasks, F.col(group), F.col("from"))
    draws = F.expr(f"transform(sequence(from, least(from + block, {replicates}) - 1), r -> transform(sequence(0, cast(n_words as int) - 1), d -> cast(pmod(xxhash64({seed}, `{group}`, cast(r as int), cast(d as int)), n_words) as int)))")
    kind = long.schema[group].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                key, variants, features, words_, start, drawn = (batch.column(i)[k] for i in range(6))
                labels, row = np.unique(variants.values.to_numpy(), return_inverse=True)
                used, column = np.unique(features.values.to_numpy(), return_inverse=True)
                x = np.zeros((len(labels), len(used)), bool)
                x[row, column] = True
                w = np.array([np.bincount(d.values.to_numpy(), minlength=words_.as_py()) for d in drawn.values], float)[:, used]
                names = [str(v) for v in labels.tolist()]
                hashes = np.array([[xxhash.xxh64_intdigest(name + tail, seed=42) for name in names] for tail in ("", "#")], np.uint64).view(np.int64)
                if len(labels) <= IN_STEP:
                    parent, length = in_step(distances(x, w))
                else:
                    found = [bounded(distances(x, w[i : i + 1])[0]) for i in range(len(w))]
                    parent, length = (np.stack([f[i] for f in found]) for i in (0, 1))
                yield _table(batch.schema.field(0).type, key, start.as_py(), names, parent, length, places(parent, len(names), hashes))

    schema = f"`{group}` {kind}, replicate int, node_id bigint, parent_id bigint, name string, length double, is_tip boolean, pre bigint, size bigint, n_tips bigint, sig1 bigint, sig2 bigint"
    return rows.select(group, "variants", "features", F.col("n_words").cast("int"), F.col("from").cast("int"), draws.alias("drawn")).mapInArrow(run, schema)


def _table(kind: pa.DataType, key: pa.Scalar, start: int, names: list[str], parent: np.ndarray, length: np.ndarray, found: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    k, total = parent.shape
    p, tip = parent.reshape(-1), np.tile(np.arange(total) < len(names), k)
    label = pa.array(names + [None] * (total - len(names)), pa.string()).take(pa.array(np.tile(np.arange(total), k)))
    cols = [
        pa.repeat(key, k * total).cast(kind), pa.array(np.repeat(np.arange(start, start + k, dtype=np.int32), total)), pa.array(np.tile(np.arange(total), k)), pa.array(p.astype(np.int64), mask=p < 0),
        label, pa.array(length.reshape(-1), mask=p < 0), pa.array(tip), *(pa.array(x.reshape(-1)) for x in found),
    ]
    return pa.RecordBatch.from_arrays(cols, names=["group", "replicate", *NODES, *PLACES])
