"""Small groups whole: all bootstrap trees of a group, their consensus and its bead plot in the task that has its variants.

A small group's trees are many rows (a node each) and what is made of them few, so they are not written: splits are counted as sets
of bits, and the consensus and the contracted tree are arrays over the nodes of many groups. Groups of equal size go
through together. A row is a group: (group, base, names, keys, …), ``base`` the hash of seed and group that draws go on
from, ``names`` numbers of its variants and ``keys`` their features. Groups of more than ``SMALL`` variants, or with more trees than a
task may hold, take the way over node tables (``joining``, ``trees``); results are the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from genosieve.operators import joining

#: Variants of a group whose sets are bits of a whole number, and the support that a split of the consensus has at least.
SMALL, CUTOFF = 62, 0.5


def is_small(v: Column, replicates: int) -> Column:
    return (v <= SMALL) & (v * v * replicates <= joining.HELD)


def rows_of(numbered: DataFrame, *more: str, seed: int = 1, group: str = "lineage") -> DataFrame:
    """(group, base, names, keys, more …, v): the numbered variants with features, a row per group, bounded by the limit on variants."""
    n = numbered.where((F.col("variant_key") != "") & F.col(group).isNotNull()).withColumn("v", F.struct("variant_no", "variant_key", *more))
    n = n.groupBy(group).agg(F.array_sort(F.collect_list("v")).alias("v"))
    return n.select(group, F.xxhash64(F.lit(seed), group).alias("base"), F.col("v.variant_no").alias("names"), F.col("v.variant_key").alias("keys"), *(F.col(f"v.{c}").alias(c) for c in more), F.size("v").cast("long").alias("v"))


@dataclass
class Group:
    """A group of a batch: its row there, and its variants (numbers, and features as 0 and 1 by name)."""

    batch: pa.RecordBatch
    row: int
    names: list[int]
    features: np.ndarray
    base: int
    start: int
    count: int
    at: int  # of its first variant in the batch's flat lists

    @property
    def key(self) -> pa.Scalar:
        return self.batch.column(0)[self.row]


def groups(batch: pa.RecordBatch, replicates: int) -> Iterator[Group]:
    """Groups of a batch; its columns start with (group, base, names, keys)."""
    base, names, keys = batch.column(1).to_numpy(), batch.column(2).flatten().to_pylist(), batch.column(3).flatten().to_pylist()
    ends = np.cumsum(batch.column(2).value_lengths().to_numpy()).tolist()
    for row, (start, end) in enumerate(zip([0, *ends], ends)):
        own = [[f for f in key.split(",") if f] for key in keys[start:end]]
        number = {f: x for x, f in enumerate(sorted({f for fs in own for f in fs}))}
        features = np.zeros((len(own), len(number)), bool)
        for x, fs in enumerate(own):
            features[x, [number[f] for f in fs]] = True
        yield Group(batch, row, names[start:end], features, int(base[row]), 0, replicates, start)


_P1, _P2, _P3, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


def hash_int(value: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of an int that goes on from a hash."""
    with np.errstate(over="ignore"):
        h = seed + _P5 + np.uint64(4)
        h = h ^ (value.astype(np.uint64) & np.uint64(0xFFFFFFFF)) * _P1
        h = (h << np.uint64(23) | h >> np.uint64(41)) * _P2 + _P3
        h = (h ^ h >> np.uint64(33)) * _P2
        h = (h ^ h >> np.uint64(29)) * _P3
        return h ^ h >> np.uint64(32)


def weights(base: int, words: int, start: int, count: int) -> np.ndarray:
    """Weights [replicate, feature] of ``trees.bootstrap_weights``."""
    r = hash_int(np.arange(start, start + count), np.array([base]).view(np.uint64))
    picked = np.mod(hash_int(np.arange(words)[None], r[:, None]).view(np.int64), words)
    picked += np.arange(count)[:, None] * words
    return np.bincount(picked.reshape(-1), minlength=count * words).reshape(count, words).astype(float)


def trees_of(own: list[Group]) -> tuple[np.ndarray, np.ndarray]:
    """(parents, lengths) [node, tree] of all replicates of groups of one size, one group after the other."""
    n = len(own[0].names)
    j, i = np.tril_indices(n, -1)
    d, at = np.empty((len(i), sum(g.count for g in own))), 0
    for g in own:
        np.matmul((g.features[i] ^ g.features[j]).astype(float), weights(g.base, g.features.shape[1], g.start, g.count).T, out=d[:, at : at + g.count])
        at += g.count
    return joining.joined(d, n)


def in_chunks(batches: Iterator[pa.RecordBatch], replicates: int, work: Callable[[list[Group]], pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``work`` on groups of one size, as many as have ``joining.CHUNK`` numbers."""
    held: dict[int, list[Group]] = {}
    for batch in batches:
        for g in groups(batch, replicates):
            n = len(g.names)
            own = held.setdefault(n, [])
            own.append(g)
            if len(own) * replicates * n * n >= 2 * joining.CHUNK:
                yield work(held.pop(n))
    for own in held.values():
        yield work(own)


@dataclass
class Consensus:
    """Nodes of the consensus trees of groups of one size, sorted by group and id (larger splits first, then by key); the first of a
    group is its root. Tip t is bit n - 1 - t, so keys of one length are in the order of falling sets."""

    n: int
    group: np.ndarray  # number in the list of groups
    sets: np.ndarray
    size: np.ndarray
    support: np.ndarray  # nan at tips
    length: np.ndarray
    parent: np.ndarray  # place of the parent among all nodes, -1 at roots

    def tips(self) -> np.ndarray:
        """[node, tip]: whether a tip lies below a node or is it."""
        return (self.sets[:, None] >> np.arange(self.n - 1, -1, -1)) & 1 > 0


def consensus(own: list[Group], replicates: int) -> Consensus:
    """As ``trees.consensus_trees`` of the groups' bootstrap trees, at a cutoff of one half."""
    n, parent, length = len(own[0].names), *trees_of(own)
    k = parent.shape[1]
    each, sets = np.arange(k), np.zeros(parent.shape, np.int64)
    sets[:n] = (1 << np.arange(n - 1, -1, -1))[:, None]
    for x in range(2 * n - 2):
        sets[parent[x], each] |= sets[x]
    tip_lengths = length[:n].reshape(n, len(own), replicates).sum(axis=2).T / replicates
    found = []
    for g in range(len(own)):
        part = slice(g * replicates, (g + 1) * replicates)
        s = sets[n:-1, part].reshape(-1)
        order = s.argsort(kind="stable")
        s = s[order]
        first = np.flatnonzero(np.r_[True, s[1:] != s[:-1]][: len(s)])
        times = np.diff(np.r_[first, len(s)])
        good = times >= CUTOFF * replicates
        kept, times = s[first[good]], times[good]
        total = np.add.reduceat(length[n:-1, part].reshape(-1)[order], first)[good] if len(first) else np.zeros(0)
        weak = np.flatnonzero(times <= (1 - CUTOFF) * replicates)
        if len(weak) > 1:  # of two that contradict each other the one with more tips, then the smaller key is kept
            w = [(int(kept[x]).bit_count(), int(kept[x]), x) for x in weak]
            lost = {x for a, p, x in w for b, q, _ in w if p & q not in (0, p, q) and (a, p) < (b, q)}
            kept, times, total = (np.delete(c, list(lost)) for c in (kept, times, total))
        found.append((kept, times / replicates, total / times))
    whole, tips = np.array([(1 << n) - 1]), sets[:n, 0]
    group = np.repeat(np.arange(len(own)), [len(f[0]) + 1 + n for f in found])
    allsets = np.concatenate([x for f in found for x in (whole, f[0], tips)])
    support = np.concatenate([x for f in found for x in (np.ones(1), f[1], np.full(n, np.nan))])
    lengths = np.concatenate([x for g, f in enumerate(found) for x in (np.zeros(1), f[2], tip_lengths[g])])
    size = ((allsets[:, None] >> np.arange(n)) & 1).sum(axis=1)
    order = np.lexsort((-allsets, -size, group))
    c = Consensus(n, group, *(x[order] for x in (allsets, size, support, lengths)), np.empty(0))
    # the nodes that hold a tip lie in each other: the last one before a node that holds its first tip is the parent
    holds = c.tips()
    last = np.maximum.accumulate(np.where(holds, np.arange(len(order))[:, None], -1), axis=0)
    c.parent = np.where(c.size == n, -1, np.vstack([np.full(n, -1), last[:-1]])[np.arange(len(order)), holds.argmax(axis=1)])
    return c


def bootstrap_consensus(rows: DataFrame, replicates: int, group: str = "lineage") -> DataFrame:
    """(group, key, support, length, size, parent) of the consensus of every group's bootstrap trees, as ``chain.consensus_of``; groups
    of one variant have none."""

    def work(own: list[Group]) -> pa.RecordBatch:
        c = consensus(own, replicates)
        names = [[str(x).rjust(4, "0")[:4] for x in g.names] for g in own]
        keys = [",".join([name for name, has in zip(names[g], below) if has]) for g, below in zip(c.group.tolist(), c.tips().tolist())]
        parents = [keys[p] if p >= 0 else None for p in c.parent.tolist()]
        of = pa.array([g.key.as_py() for g in own], pa.string()).take(pa.array(c.group))
        return pa.RecordBatch.from_arrays([of, pa.array(keys), pa.array(c.support, mask=np.isnan(c.support)), pa.array(c.length), pa.array(c.size.astype(np.int32)), pa.array(parents, pa.string())], names=["group", "key", "support", "length", "size", "parent"])

    few = rows.where("v > 1").select(F.col(group).cast("string"), "base", "names", "keys")
    return dealt(few).mapInArrow(lambda batches: in_chunks(batches, replicates, work), "group string, key string, support double, length double, size int, parent string")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows over the cluster's tasks: a task's work is in its trees, not in the bytes that it reads, so tasks are not merged by bytes."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), rows.columns[0])


def bootstrap_nodes(rows: DataFrame, replicates: int, group: str = "lineage") -> DataFrame:
    """(group, replicate, node_id, parent_id, name, length, is_tip) of all bootstrap trees."""
    kind = rows.schema[group].dataType.simpleString()

    def work(own: list[Group]) -> pa.RecordBatch:
        parent, length = (x.T.reshape(-1) for x in trees_of(own))
        n, k = len(own[0].names), len(own) * replicates
        total, root = 2 * n - 1, parent < 0
        node = np.tile(np.arange(total), k)
        label = np.minimum(node, n) + np.repeat(np.arange(len(own)) * (n + 1), replicates * total)
        names = pa.array([x for g in own for x in (*map(str, g.names), None)], pa.string())
        cols = [
            pa.array([g.key.as_py() for g in own], own[0].key.type).take(pa.array(np.repeat(np.arange(len(own)), replicates * total))), pa.array(np.tile(np.repeat(np.arange(replicates, dtype=np.int32), total), len(own))),
            pa.array(node), pa.array(parent, mask=root), names.take(pa.array(label)), pa.array(length, mask=root), pa.array(node < n),
        ]
        return pa.RecordBatch.from_arrays(cols, names=[group, "replicate", *joining.NODES])

    few = rows.where("v > 1").select(group, "base", "names", "keys")
    return dealt(few).mapInArrow(lambda batches: in_chunks(batches, replicates, work), f"`{group}` {kind}, replicate int, node_id bigint, parent_id bigint, name string, length double, is_tip boolean")


@dataclass
class Contracted:
    """Nodes that are left of a consensus, with their old places; ``home`` is the new place of every [group, tip]."""

    old: np.ndarray
    parent: np.ndarray
    length: np.ndarray
    is_tip: np.ndarray
    home: np.ndarray


def contracted(c: Consensus, min_length: float, passes: int) -> Contracted:
    """As ``trees.contract``, on all trees of a chunk at once."""
    tip = c.size == 1
    home = np.zeros((c.group[-1] + 1, c.n), np.int64)
    at = np.flatnonzero(tip)
    home[c.group[at], c.tips()[at].argmax(axis=1)] = at
    t = Contracted(np.arange(len(tip)), c.parent, c.length, tip, home)
    for _ in range(passes):
        root = t.parent < 0
        short = (t.length <= min_length) & ~root
        kids = np.bincount(t.parent[~root & ~(t.is_tip & short)], minlength=len(root))
        stays = ~short | (~t.is_tip & (kids == 0))
        up = np.where(root, np.arange(len(root)), t.parent)
        while (go := ~stays[up]).any():  # roots stay
            up[go] = up[up[go]]
        new = np.cumsum(stays) - 1
        homes = new[np.where(stays[t.home], t.home, up[t.home])]
        t = Contracted(t.old[stays], np.where(root, -1, new[up])[stays], t.length[stays], (t.is_tip | (kids == 0))[stays], homes)
    return t


BEADS = "node_id bigint, variant string, n bigint, pos int, parent string, length double, support double, keys array<string>"


def bead_nodes(rows: DataFrame, replicates: int, min_length: float, passes: int = 2, group: str = "lineage") -> DataFrame:
    """(group, node_id, variant, n, pos, parent, length, support, keys): the nodes of every group's bead plot with the edge to their parent
    (none at the root) and the keys of their variants, as ``trees.contract``, ``bead_names`` and ``bead_tree`` make them of the
    consensus. Besides what ``groups`` reads rows have n, the samples of a variant, and place and label of its first one in the
    group. A group of one variant is one node."""
    kind = rows.schema[group].dataType.simpleString()

    def work(own: list[Group]) -> pa.RecordBatch:
        if len(own[0].names) > 1:
            c = consensus(own, replicates)
            t = contracted(c, min_length, passes)
            roots = np.flatnonzero(c.parent < 0)
            of, parent = c.group[t.old], t.parent
            node, length, support = t.old - roots[of], t.length, c.support[t.old]
        else:
            of = np.arange(len(own))
            node, parent, length, support = np.zeros(len(own), np.int64), np.full(len(own), -1), np.full(len(own), np.nan), np.full(len(own), np.nan)
            t = Contracted(of, parent, length, np.ones(len(own), bool), of[:, None])
        depth, up = np.zeros(len(of), np.int64), parent.copy()
        while (below := up >= 0).any():
            depth += below
            up = np.where(below, parent[up], -1)
        keys, n, first, label = ([[] for _ in of], [0] * len(of), [None] * len(of), [None] * len(of))
        for g, places in zip(own, t.home.tolist()):
            own_keys, own_n, own_first, own_label = _own(g)
            for x, place in enumerate(places):
                keys[place].append(own_keys[x])
                n[place] += own_n[x]
                if first[place] is None or own_first[x] < first[place]:
                    first[place], label[place] = own_first[x], own_label[x]
        pos, edge, bare = [None] * len(of), [0] * len(own), [0] * len(own)
        for x in np.lexsort((node, depth, of)).tolist():
            g = of[x]
            if parent[x] >= 0:
                pos[x] = edge[g]
                edge[g] += 1
            if label[x] is None:
                label[x] = f"unsampled{bare[g]}"
                bare[g] += 1
        parents = [label[p] if p >= 0 else None for p in parent.tolist()]
        root = parent < 0
        cols = [
            pa.array([g.key.as_py() for g in own], own[0].key.type).take(pa.array(of)), pa.array(node), pa.array(label, pa.string()), pa.array(n, pa.int64()), pa.array(pos, pa.int32()),
            pa.array(parents, pa.string()), pa.array(length, mask=root), pa.array(support, mask=root | np.isnan(support)), pa.array(keys, pa.list_(pa.string())),
        ]
        return pa.RecordBatch.from_arrays(cols, names=[group, "node_id", "variant", "n", "pos", "parent", "length", "support", "keys"])

    some = rows.select(group, "base", "names", "keys", "n", "place", "label")
    return dealt(some).mapInArrow(lambda batches: in_chunks(batches, replicates, work), f"`{group}` {kind}, {BEADS}")


def _own(g: Group) -> tuple[list, ...]:
    """Keys, samples, and place and label of the first sample, of a group's variants."""
    return tuple(g.batch.column(c)[g.row].values.to_pylist() for c in (3, 4, 5, 6))
