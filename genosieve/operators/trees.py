"""Set distances, neighbour joining, and trees as node tables.

nodes: tree, node_id, parent_id (null at the root), name, length, is_tip. All operators work on many trees at once. What
recursion would do is done by pointer jumping over linear tables (``tours``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from genosieve.operators import joining, tours
from genosieve.sources.shared import cut

MIN_LENGTH = 0.5


def bootstrap_weights(features: DataFrame, replicates: int, seed: int = 1, group: str = "lineage") -> DataFrame:
    """features(group, feature_no from 0 without gaps) -> (group, replicate, feature_no, weight): as many draws with
    replacement as there are features, by a seeded hash of (group, replicate, draw)."""
    n = features.groupBy(group).agg((F.max("feature_no") + 1).alias("n"))
    draws = n.select(group, "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate")).select("*", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("draw"))
    pick = F.pmod(F.xxhash64(F.lit(seed), group, "replicate", "draw"), F.col("n")).cast("int")
    return draws.groupBy(group, "replicate", pick.alias("feature_no")).agg(F.count("*").alias("weight"))


def pairwise_distance(long: DataFrame, weights: DataFrame | None = None, group: str = "lineage", edge: int = 256) -> DataFrame:
    """(group, i, j, dist), i < j: total weight of the features that exactly one of two variants has, for all pairs of variants with
    features. With weights(group, replicate, feature_no, weight) also by replicate. long(group, variant_no, feature_no).

    A group's variants are blocks of ``edge`` numbers, and two blocks are a tile: its task gets the features of both, as often
    as a block meets others, and all weights of the group, and finds all replicates' distances by one matrix product each."""
    block = F.floor(F.col("variant_no") / edge).cast("int")
    blocks = long.groupBy(group, block.alias("block")).agg(F.collect_list("variant_no").alias("v"), F.collect_list("feature_no").alias("f"))
    blocks = cut(blocks)
    other = blocks.select(group, F.col("block").alias("block2"), F.col("v").alias("v2"), F.col("f").alias("f2"))
    tiles = blocks.join(other, group).where("block <= block2")
    if weights is None:
        w = [F.array().cast("array<int>").alias(c) for c in ("r", "wf", "w")]
    else:
        rows = weights.groupBy(group).agg(*(F.collect_list(F.col(c).cast("int")).alias(k) for c, k in (("replicate", "r"), ("feature_no", "wf"), ("weight", "w"))))
        tiles, w = tiles.join(rows, group), ["r", "wf", "w"]
    spark = long.sparkSession  # a task's work is in its pairs, not in the bytes that it reads, so tasks are not merged by bytes
    tiles = tiles.select(group, F.col("block") == F.col("block2"), "v", "f", "v2", "f2", *w).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    kind, with_replicates = long.schema[group].dataType.simpleString(), weights is not None

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                same = batch.column(1)[k].as_py()
                v, f, v2, f2, r, wf, w = (batch.column(c)[k].values.to_numpy() for c in range(2, 9))
                words, at = np.unique(np.concatenate([f, f2]), return_inverse=True)
                sides = []
                for names, columns in ((v, at[: len(f)]), (v2, at[len(f) :])):
                    labels, row = np.unique(names, return_inverse=True)
                    x = np.zeros((len(labels), len(words)))
                    x[row, columns] = 1
                    sides.append((labels, x))
                (li, xi), (lj, xj) = sides
                replicates, which = np.unique(r, return_inverse=True)
                if with_replicates:
                    weight, place = np.zeros((len(replicates), len(words))), np.minimum(np.searchsorted(words, wf), len(words) - 1)
                    used = words[place] == wf
                    weight[which[used], place[used]] = w[used]
                else:
                    replicates, weight = np.zeros(1, np.int64), np.ones((1, len(words)))
                i, j = np.triu_indices(len(li), 1) if same else map(np.ravel, np.indices((len(li), len(lj))))
                for replicate, own in zip(replicates, weight):
                    y = xi * own
                    d = y.sum(axis=1)[:, None] + (xj @ own)[None, :] - 2 * (y @ xj.T)
                    cols = [pa.repeat(batch.column(0)[k], len(i)), pa.array(li[i]), pa.array(lj[j]), pa.array(np.rint(d[i, j]).astype(np.int64))]
                    if with_replicates:
                        cols.insert(1, pa.array(np.full(len(i), replicate, np.int32)))
                    yield pa.RecordBatch.from_arrays(cols, names=names_out)

    names_out = [group, *(["replicate"] if with_replicates else []), "i", "j", "dist"]
    number = long.schema["variant_no"].dataType.simpleString()
    return tiles.mapInArrow(measure, f"`{group}` {kind}, {'replicate int, ' if with_replicates else ''}i {number}, j {number}, dist bigint")


def neighbor_joining(d: np.ndarray) -> list[tuple[int, int | None, float | None]]:
    """(node, parent, length) of the tree of a distance matrix; tips are 0 … n-1, the root is the last node; negative
    lengths are 0."""
    parents, lengths = (x[0] for x in joining.in_step(d[None])) if len(d) <= joining.IN_STEP else joining.bounded(d.astype(float))
    return [(k, None, None) if up < 0 else (k, int(up), float(x)) for k, (up, x) in enumerate(zip(parents, lengths))]


def nj_trees(distances: DataFrame, keys: list[str]) -> DataFrame:
    """Neighbour-joining trees, one per key: (keys, node_id, parent_id, name, length, is_tip). Rows sorted by key pass as a
    stream; one matrix at a time is held, whose size is bounded by the limit on variants."""
    kinds = ", ".join(f"`{k}` {distances.schema[k].dataType.simpleString()}" for k in keys)
    names = [*keys, "node_id", "parent_id", "name", "length", "is_tip"]

    def tree(key: tuple, i: np.ndarray, j: np.ndarray, dist: np.ndarray) -> list[tuple]:
        labels = np.unique(np.concatenate([i, j]))
        a, b = np.searchsorted(labels, i), np.searchsorted(labels, j)
        d = np.zeros((len(labels), len(labels)))
        d[a, b] = d[b, a] = dist
        return [(*key, node, parent, str(labels[node]) if node < len(labels) else None, length, node < len(labels)) for node, parent, length in neighbor_joining(d)]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key, rows, types = [], None, [], None

        def close() -> None:
            if held:
                rows.extend(tree(key, *(np.concatenate(c) for c in zip(*held))))
                held.clear()

        def flush() -> pa.RecordBatch:
            kinds = [*types, pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            types = [batch.schema.field(k).type for k in keys]
            own = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            i, j, dist = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("i", "j", "dist"))
            starts = [0, *(x for x in range(1, len(own)) if own[x] != own[x - 1]), len(own)]
            for a, b in zip(starts, starts[1:]):
                if own[a] != key:
                    close()
                    key = own[a]
                held.append((i[a:b], j[a:b], dist[a:b]))
            if len(rows) > 50_000:
                yield flush()
                rows.clear()
        close()
        if rows:
            yield flush()

    sorted_rows = distances.select(*keys, "i", "j", "dist").repartition(*keys).sortWithinPartitions(*keys)
    return sorted_rows.mapInArrow(build, f"{kinds}, node_id bigint, parent_id bigint, name string, length double, is_tip boolean")


def ancestors(nodes: DataFrame, max_rounds: int = 20) -> DataFrame:
    """(tree, node_id, anc, hops, dist, share): every node with itself and all its ancestors; dist is the length between
    them, share the product of 1 / children over the ancestors passed. Each round is cut, so plans stay short."""
    kids = nodes.where("parent_id is not null").groupBy("tree", "parent_id").agg(F.count("*").alias("kids"))
    own = nodes.select("tree", "node_id", F.col("node_id").alias("anc"), F.lit(0).alias("hops"), F.lit(0.0).alias("dist"), F.lit(1.0).alias("share"))
    step = nodes.where("parent_id is not null").join(kids, ["tree", "parent_id"]).select("tree", "node_id", F.col("parent_id").alias("anc"), F.lit(1).alias("hops"), F.coalesce("length", F.lit(0.0)).alias("dist"), (1.0 / F.col("kids")).alias("share"))
    found, jump = cut(own), cut(step)
    for _ in range(max_rounds):
        if jump.isEmpty():
            return found
        j = jump.select("tree", F.col("node_id").alias("anc"), F.col("anc").alias("anc2"), F.col("hops").alias("h2"), F.col("dist").alias("d2"), F.col("share").alias("s2"))
        longer = lambda a: a.join(j, ["tree", "anc"]).select("tree", "node_id", F.col("anc2").alias("anc"), (F.col("hops") + F.col("h2")).alias("hops"), (F.col("dist") + F.col("d2")).alias("dist"), (F.col("share") * F.col("s2")).alias("share"))
        found, jump = cut(found.unionByName(longer(found))), cut(longer(jump))
    raise ValueError("a tree is deeper than 2 ** max_rounds, or has a cycle")


def clades(nodes: DataFrame) -> DataFrame:
    """(tree, node_id, length, tips): sorted names of the tips below every inner node; as many rows meet as the lists have names."""
    t = cut(tours.tour(nodes).select("tree", "node_id", "pre", "size").join(nodes.select("tree", "node_id", "name", "length", "is_tip"), ["tree", "node_id"]))
    tips = t.where("is_tip").select("tree", "pre", "name")
    below = t.where("not is_tip").select("tree", "node_id", "length", F.explode(F.expr("sequence(pre, pre + size - 1)")).alias("pre")).join(tips, ["tree", "pre"])
    return below.groupBy("tree", "node_id").agg(F.first("length").alias("length"), F.array_sort(F.collect_list("name")).alias("tips"))


def clade_signatures(nodes: DataFrame) -> DataFrame:
    """(tree, node_id, pre, size, n_tips, sig1, sig2) of every node: 128 bits that stand for the set of tip names below it, the
    exclusive or of the tips' hashes, and their number."""
    tip = lambda c: F.when(F.col("is_tip"), c)
    xors = {"sig1": tip(F.xxhash64("name")), "sig2": tip(F.xxhash64(F.concat("name", F.lit("#"))))}
    return tours.tour(nodes, sums={"n_tips": tip(F.lit(1))}, xors=xors).select("tree", "node_id", "pre", "size", "n_tips", "sig1", "sig2")


def consensus(splits: DataFrame, tip_lengths: DataFrame, trees: DataFrame, cutoff: float = 0.5, group: str = "group") -> DataFrame:
    """(group, key, parent, support, length, size): splits seen in at least ``cutoff`` of a group's trees, and the tips.

    splits(group, tree, tips, length), tip_lengths(group, tree, name, length), trees(group, n). A split's parent is the
    smallest kept one that holds it. Of two that contradict each other (possible at a support of exactly one half) the
    one with higher support, then more tips, then the smaller key is kept.
    """
    key = F.array_join("tips", ",")
    s = splits.withColumn("key", key).groupBy(group, "key").agg(F.count_distinct("tree").alias("k"), F.avg(F.coalesce("length", F.lit(0.0))).alias("length"), F.first("tips").alias("tips"))
    s = s.join(trees, group).withColumns({"support": F.col("k") / F.col("n"), "size": F.size("tips")}).where(F.col("support") >= cutoff)
    return _assembled(cut(s), tip_lengths, trees, cutoff, group)


def consensus_trees(nodes: DataFrame, cutoff: float = 0.5, group: str = "group") -> DataFrame:
    """As ``consensus``, from the nodes of whole trees, numbered depth-first (group, tree, node_id, pre, size, n_tips, sig1, sig2,
    name, length, is_tip): splits are counted by signature, and only kept ones get their lists of tips, from one tree that
    has them."""
    trees = nodes.groupBy(group).agg(F.count_distinct("tree").alias("n"))
    n = nodes.select(group, "tree", "pre", "size", "n_tips", "sig1", "sig2", "name", F.coalesce("length", F.lit(0.0)).alias("length"), "is_tip")
    s = n.where("not is_tip and n_tips > 0").groupBy(group, "sig1", "sig2", F.col("n_tips").alias("size")).agg(F.count_distinct("tree").alias("k"), F.avg("length").alias("length"), F.min(F.struct("tree", "pre", F.col("size").alias("nodes"))).alias("one"))
    s = cut(s.join(trees, group).withColumn("support", F.col("k") / F.col("n")).where(F.col("support") >= cutoff))
    places = s.select(group, "sig1", "sig2", "size", "one.tree", F.explode(F.expr("sequence(one.pre, one.pre + one.nodes - 1)")).alias("pre"))
    lists = places.join(n.where("is_tip").select("tree", "pre", "name"), ["tree", "pre"]).groupBy(group, "sig1", "sig2", "size").agg(F.array_sort(F.collect_list("name")).alias("tips"))
    s = s.drop("one").join(lists, [group, "sig1", "sig2", "size"]).withColumn("key", F.array_join("tips", ",")).select(group, "key", "k", "length", "tips", "n", "support", F.col("size").cast("int").alias("size"))
    return _assembled(cut(s), n.where("is_tip").select(group, "tree", "name", "length"), trees, cutoff, group)


def _assembled(s: DataFrame, tip_lengths: DataFrame, trees: DataFrame, cutoff: float, group: str) -> DataFrame:
    """The consensus from counted splits (group, key, tips, length, support, size). Splits that are seen in more than
    1 - cutoff of the trees meet any other one in some tree and can't contradict it, so only the others are compared."""
    member = cut(s.select(group, "key", "size", "support", F.explode("tips").alias("tip")))
    weak = member.where(F.col("support") <= 1 - cutoff)
    other = weak.select(group, F.col("key").alias("key2"), F.col("size").alias("size2"), F.col("support").alias("support2"), "tip")
    meets = weak.join(other, [group, "tip"]).where("key != key2").groupBy(group, "key", "size", "support", "key2", "size2", "support2").agg(F.count("*").alias("both"))
    worse = (F.col("support") < F.col("support2")) | ((F.col("support") == F.col("support2")) & ((F.col("size") < F.col("size2")) | ((F.col("size") == F.col("size2")) & (F.col("key") > F.col("key2")))))
    lost = meets.where((F.col("both") < F.least("size", "size2")) & worse).select(group, "key").distinct()
    kept = s.join(lost, [group, "key"], "left_anti").select(group, "key", "support", "length", "size")
    tips = tip_lengths.groupBy(group, "name").agg(F.sum(F.coalesce("length", F.lit(0.0))).alias("total")).join(trees, group)
    tips = tips.select(group, F.col("name").alias("key"), F.lit(None).cast("double").alias("support"), (F.col("total") / F.col("n")).alias("length"), F.lit(1).alias("size"))
    nodes = cut(kept.unionByName(tips.join(kept.where("size = 1").select(group, "key"), [group, "key"], "left_anti")))
    # the kept splits that hold a tip lie in each other: the next larger one is the parent
    chain = member.join(lost, [group, "key"], "left_anti").select(group, "key", "size", "tip").unionByName(nodes.where("size = 1 and support is null").select(group, "key", "size", F.col("key").alias("tip")))
    up = chain.withColumn("parent", F.lead("key").over(Window.partitionBy(group, "tip").orderBy("size"))).groupBy(group, "key").agg(F.min("parent").alias("parent"))
    return nodes.join(up, [group, "key"], "left")


def contract(nodes: DataFrame, min_length: float = MIN_LENGTH, passes: int = 1) -> DataFrame:
    """Short tips leave the tree and name their parent; short inner nodes pass children and names up. An inner node that
    lost all its tips stays in this pass and is a tip in the next. Names are joined by bars: a node's own, then the others
    by node id."""
    for _ in range(passes):
        short = F.coalesce(F.col("length") <= min_length, F.lit(False)) & F.col("parent_id").isNotNull()
        flagged = nodes.withColumn("short", short)
        left = flagged.where("not (is_tip and short) and parent_id is not null").groupBy("tree", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("kids"))
        flagged = flagged.join(left, ["tree", "node_id"], "left").withColumn("kids", F.coalesce("kids", F.lit(0).cast("long")))
        stays = F.when(F.col("is_tip"), ~F.col("short")).otherwise(~F.col("short") | (F.col("kids") == 0))
        flagged = cut(flagged.withColumn("stays", stays))
        target = tours.up(flagged, F.col("stays")).where("anc is not null").select("tree", "node_id", F.col("anc").alias("target"))
        gone = flagged.where("not stays and name is not null").join(target, ["tree", "node_id"])
        merged = gone.groupBy("tree", F.col("target").alias("node_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "name"))), lambda x: x["name"]), "|").alias("more"))
        kept = flagged.where("stays").join(target, ["tree", "node_id"], "left").join(merged, ["tree", "node_id"], "left")
        name = F.when(F.col("name").isNull(), F.col("more")).when(F.col("more").isNull(), F.col("name")).otherwise(F.concat_ws("|", "name", "more"))
        nodes = cut(kept.select("tree", "node_id", F.col("target").alias("parent_id"), name.alias("name"), "length", (F.col("is_tip") | (F.col("kids") == 0)).alias("is_tip")))
    return nodes


def annotate(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(tree, node_id, n_labels, unsampled): node names split at bars, sample labels of each part counted."""
    parts = nodes.select("tree", "node_id", F.explode_outer(F.split("name", r"\|")).alias("name"))
    n = labels.groupBy("tree", "name").agg(F.count("*").alias("n"))
    return parts.join(n, ["tree", "name"], "left").groupBy("tree", "node_id").agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("n_labels"), F.bool_and(F.col("name").isNull()).alias("unsampled"))


def node_labels(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """(tree, node_id, name, label): the sample labels of every part of a node's name, one row each; a node without any
    is unsampled and has one row without a label. labels(tree, name, label)."""
    parts = nodes.select("tree", "node_id", F.explode_outer(F.split("name", r"\|")).alias("name"))
    found = parts.join(labels, ["tree", "name"])
    bare = nodes.join(found.select("tree", "node_id").distinct(), ["tree", "node_id"], "left_anti")
    return found.select("tree", "node_id", "name", "label").unionByName(bare.select("tree", "node_id", F.lit(None).cast("string").alias("name"), F.lit(None).cast(labels.schema["label"].dataType).alias("label")))


def bead_names(nodes: DataFrame, samples: DataFrame) -> DataFrame:
    """(tree, node_id, variant, n): a node is named after its first sample by date and accession; nodes without samples
    are ``unsampled0``, ``unsampled1``, … in level order. samples(tree, name, accession, coldate)."""
    parts = nodes.select("tree", "node_id", F.explode_outer(F.split("name", r"\|")).alias("name"))
    first = parts.join(samples, ["tree", "name"]).groupBy("tree", "node_id").agg(F.min_by(F.col("accession").cast("string"), F.struct("coldate", "accession")).alias("variant"), F.count("*").alias("n"))
    depth = tours.levels(nodes).select("tree", "node_id", "depth")
    named = nodes.select("tree", "node_id").join(depth, ["tree", "node_id"]).join(first, ["tree", "node_id"], "left")
    k = F.row_number().over(Window.partitionBy("tree", F.col("variant").isNull()).orderBy("depth", "node_id")) - 1
    return named.select("tree", "node_id", F.coalesce("variant", F.concat(F.lit("unsampled"), k.cast("string"))).alias("variant"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def bead_tree(nodes: DataFrame, names: DataFrame, supports: DataFrame) -> DataFrame:
    """(tree, pos, parent, child, dist, support): edges between named nodes in level order, lengths to two decimals.
    names(tree, node_id, variant), supports(tree, node_id, support)."""
    v = nodes.drop("name").join(names.select("tree", "node_id", F.col("variant").alias("name")), ["tree", "node_id"])
    e = bead_edges(v)
    child = v.select("tree", F.col("name").alias("child"), "node_id").join(supports.select("tree", "node_id", "support"), ["tree", "node_id"], "left").drop("node_id")
    return e.join(child, ["tree", "child"]).select("tree", "pos", "parent", "child", "dist", "support")


def consensus_nodes(found: DataFrame, group: str = "group") -> tuple[DataFrame, DataFrame]:
    """A consensus as a node table (tips named by their key, ids from the largest split down) and its supports."""
    ids = found.select(group, "key", (F.row_number().over(Window.partitionBy(group).orderBy(F.desc("size"), "key")) - 1).cast("long").alias("node_id"))
    up = ids.select(group, F.col("key").alias("parent"), F.col("node_id").alias("parent_id"))
    t = cut(found.join(ids, [group, "key"]).join(up, [group, "parent"], "left"))
    tip = F.col("size") == 1
    nodes = t.select(F.col(group).alias("tree"), "node_id", "parent_id", F.when(tip, F.col("key")).alias("name"), "length", tip.alias("is_tip"))
    return nodes, t.select(F.col(group).alias("tree"), "node_id", "support")


def bead_edges(nodes: DataFrame) -> DataFrame:
    """(tree, pos, parent, child, dist, depth): edges in level order, lengths to two decimals; the root has none."""
    depth = tours.levels(nodes).select("tree", "node_id", F.col("depth").cast("int").alias("depth"))
    p = nodes.select("tree", F.col("node_id").alias("parent_id"), F.col("name").alias("parent"))
    e = nodes.join(p, ["tree", "parent_id"]).join(depth, ["tree", "node_id"])
    pos = F.row_number().over(Window.partitionBy("tree").orderBy("depth", "node_id")) - 1
    return e.select("tree", pos.alias("pos"), "parent", F.col("name").alias("child"), F.round("length", 2).alias("dist"), "depth")


def clean_nexus(text: Column) -> Column:
    """Without the rooting mark and mutation comments."""
    return F.regexp_replace(F.regexp_replace(text, r"\[&[UR]\] *", ""), r"\[&[^\]]*mutations=[^\]]*\]", "")


def node_dates(text: Column) -> Column:
    """(name:length[date=…]) pairs of a dated tree as 'name=date' strings."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"([\w.]+:[0-9.eE+-]+\[&date=[0-9.]+)"), F.lit(1)), lambda s: F.concat(F.substring_index(s, ":", 1), F.lit("="), F.substring_index(s, "=", -1)))


def collapse_low_support(nodes: DataFrame, cutoff: float = 0.5) -> DataFrame:
    """Inner nodes below a support go (those without one stay); their children move to the nearest ancestor that stays, with the lengths passed."""
    weak = ~F.col("is_tip") & F.col("parent_id").isNotNull() & F.coalesce(F.col("support") < cutoff, F.lit(False))
    up = tours.up(nodes, ~weak).select("tree", "node_id", F.col("anc").alias("parent_id"), F.col("dist").alias("length"))
    return nodes.where(~weak).drop("parent_id", "length").join(up, ["tree", "node_id"], "left").select("tree", "node_id", "parent_id", "name", "support", "length", "is_tip")


def single_variant(samples: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, variant_key, n_samples, n_edges, infections): groups with one variant are one node without edges."""
    g = samples.groupBy(*groups).agg(F.min("variant_key").alias("variant_key"), F.max("variant_key").alias("#last"), F.count("*").alias("n_samples"))
    return g.where(F.col("variant_key") == F.col("#last")).select(*groups, "variant_key", "n_samples", F.lit(0).alias("n_edges"), F.lit(0.0).alias("infections"))


def tree_table(nodes: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """One row per node: parent label, children in order, length (root 0); with raw(name, raw_lineage) also that, null for
    names that it has not."""
    p = nodes.select("tree", F.col("node_id").alias("parent_id"), F.col("name").alias("parent_label"))
    c = nodes.where("parent_id is not null").groupBy("tree", F.col("parent_id").alias("node_id")).agg(F.array_sort(F.collect_list("node_id")).alias("children"))
    j = nodes.join(p, ["tree", "parent_id"], "left").join(c, ["tree", "node_id"], "left")
    j = j if raw is None else j.join(raw.select("name", "raw_lineage"), "name", "left")
    cols = ("tree", "node_id", "parent_id", "name", "parent_label", F.coalesce("children", F.array().cast("array<bigint>")).alias("children"), F.coalesce("length", F.lit(0.0)).alias("length"), "is_tip")
    return j.select(*cols, *(["raw_lineage"] if raw is not None else []))


def rect_layout(nodes: DataFrame) -> DataFrame:
    """(tree, node_id, x, y): x is the distance from the root; tips are numbered from the left (children by node id), an
    inner node lies at the mean of its children. A childless node that is no tip lies where the next tip would."""
    place = tours.tour(nodes, sums={"tips": F.col("is_tip").cast("int")}).select("tree", "node_id", F.col("before_tips").alias("#tip"))
    y = tours.mean_of_children(cut(nodes.join(place, ["tree", "node_id"])), F.col("#tip"))
    return tours.levels(nodes).select("tree", "node_id", "x").join(y, ["tree", "node_id"])


def suppress_single(nodes: DataFrame) -> DataFrame:
    """Inner nodes with one child are passed over, lengths summed; a root with one child goes, too."""
    kids = nodes.where("parent_id is not null").groupBy("tree", F.col("parent_id").alias("node_id")).agg(F.count("*").alias("kids"))
    flagged = cut(nodes.join(kids, ["tree", "node_id"], "left").withColumn("stays", F.col("is_tip") | F.coalesce(F.col("kids") > 1, F.lit(False))))
    target = tours.up(flagged, F.col("stays")).where("anc is not null").select("tree", "node_id", F.col("anc").alias("parent_id"), F.col("dist").alias("length"))
    return flagged.where("stays").select("tree", "node_id", "name", "is_tip").join(target, ["tree", "node_id"], "left").select("tree", "node_id", "parent_id", "name", "length", "is_tip")


def drop_outgroup(nodes: DataFrame, name: str = "reference") -> DataFrame:
    """Every tree rooted where the tip of that name joins it, and without that tip: edges on the path to the old root are
    turned round and keep their lengths. Trees without such a tip stay as they are."""
    out = nodes.where(F.col("is_tip") & (F.col("name") == name)).groupBy("tree").agg(F.min(F.struct("node_id", "parent_id")).alias("o")).select("tree", F.col("o.node_id").alias("out_id"), F.col("o.parent_id").alias("start"))
    starts = nodes.join(out.select("tree", F.col("start").alias("node_id"), F.lit(1).alias("start")), ["tree", "node_id"], "left")
    path = tours.tour(starts, sums={"holds": F.col("start")}).where("holds > 0").select("tree", "node_id", "depth")
    path = path.withColumn("hops", F.max("depth").over(Window.partitionBy("tree")) - F.col("depth")).drop("depth")
    path = cut(path.join(nodes.select("tree", "node_id", "length"), ["tree", "node_id"]))
    below = path.select("tree", (F.col("hops") + 1).alias("hops"), F.col("node_id").alias("turned"), F.col("length").alias("turned_length"))
    turn = path.select("tree", "node_id", "hops").join(below, ["tree", "hops"], "left").withColumn("on_path", F.lit(True)).drop("hops")
    left = nodes.join(out.select("tree", F.col("out_id").alias("node_id")), ["tree", "node_id"], "left_anti").join(turn, ["tree", "node_id"], "left")
    moved = left.select("tree", "node_id", F.when(F.col("on_path"), F.col("turned")).otherwise(F.col("parent_id")).alias("parent_id"), "name", F.when(F.col("on_path"), F.col("turned_length")).otherwise(F.col("length")).alias("length"), "is_tip")
    return suppress_single(cut(moved))


def renumber(nodes: DataFrame) -> DataFrame:
    """Node ids from 0 without gaps in their old order, parents with them, and the layout of the tree that is left:
    (tree, node_id, parent_id, name, length, is_tip, x, y)."""
    new = nodes.select("tree", "node_id", (F.row_number().over(Window.partitionBy("tree").orderBy("node_id")) - 1).cast("long").alias("new_id"))
    own = nodes.join(new, ["tree", "node_id"])
    up = new.select("tree", F.col("node_id").alias("parent_id"), F.col("new_id").alias("new_parent"))
    fresh = cut(own.join(up, ["tree", "parent_id"], "left").select("tree", F.col("new_id").alias("node_id"), F.col("new_parent").alias("parent_id"), "name", "length", "is_tip"))
    return fresh.join(rect_layout(fresh), ["tree", "node_id"])


def prune_before(nodes: DataFrame, dates: DataFrame, cutoff: Column) -> DataFrame:
    """Tips dated at or after a cutoff with their ancestors, single-child nodes passed over; a tree without such tips
    stays as it is. dates(tree, node_id, date). Ids are kept; lengths are summed over the nodes passed over."""
    good = nodes.where("is_tip").join(dates.where(F.col("date") >= cutoff).select("tree", "node_id"), ["tree", "node_id"], "left_semi").select("tree", "node_id")
    marked = nodes.join(good.withColumn("#good", F.lit(1)), ["tree", "node_id"], "left")
    live = tours.tour(marked, sums={"good": F.col("#good")}).where("good > 0").select("tree", "node_id")
    pruned = suppress_single(nodes.join(live, ["tree", "node_id"], "left_semi"))
    rest = nodes.join(good.select("tree").distinct(), "tree", "left_anti").select("tree", "node_id", "parent_id", "name", "length", "is_tip")
    return pruned.unionByName(rest)


def read_newick(trees: DataFrame, text: str = "newick") -> DataFrame:
    """trees(tree, newick) -> nodes, numbered from 0 in closing order. A label is a leaf's or stands after the bracket
    that closes its node; a parent is the next closing one that is one level up. All by windows over the tokens."""
    tokens = trees.select("tree", F.posexplode(F.regexp_extract_all(text, F.lit(r"(\(|\)[^(),:;]*(?::[^(),;]*)?|[^(),:;]+(?::[^(),;]*)?|:[^(),;]*)"), F.lit(1))).alias("i", "token"))
    w = Window.partitionBy("tree").orderBy("i")
    opened, closed = F.col("token") == "(", F.col("token").startswith(")")
    level = F.sum(F.when(opened, 1).when(closed, -1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    n = tokens.withColumn("level", level).where(~opened).withColumn("body", F.regexp_replace("token", r"^\)", "")).withColumn("is_tip", ~closed)
    n = n.withColumn("node_id", (F.row_number().over(w) - 1).cast("long"))
    label, length = F.substring_index("body", ":", 1), F.when(F.col("body").contains(":"), F.substring_index("body", ":", -1).try_cast("double"))
    # the parent closes one level up: of the nodes at that level the next one that is no tip
    inner = n.where("not is_tip").select("tree", (F.col("level") + 1).alias("level"), "i", F.col("node_id").alias("pid"))
    both = n.select("tree", "level", "i", "node_id", F.lit(None).cast("long").alias("pid")).unionByName(inner.select("tree", "level", "i", F.lit(None).cast("long").alias("node_id"), "pid"))
    nxt = F.last("pid", ignorenulls=True).over(Window.partitionBy("tree", "level").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1))
    parents = both.withColumn("parent_id", nxt).where("node_id is not null").select("tree", "node_id", "parent_id")
    return n.select("tree", "node_id", F.when(label != "", label).alias("name"), length.alias("length"), "is_tip").join(parents, ["tree", "node_id"])


def dated_labels(nodes: DataFrame, dates: DataFrame) -> DataFrame:
    """Names for writing: tips ``name|first date``, inner nodes their support. dates(tree, node_id, date)."""
    j = nodes.join(dates.select("tree", "node_id", "date"), ["tree", "node_id"], "left")
    return j.withColumn("name", F.when(F.col("is_tip"), F.concat_ws("|", "name", F.col("date").cast("string"))).otherwise(F.col("support").cast("string"))).drop("date")


def support_names(nodes: DataFrame) -> DataFrame:
    """Inner nodes without a name take their support as one and give it up; a support of 0 counts as none."""
    use = ~F.col("is_tip") & F.col("name").isNull() & (F.coalesce("support", F.lit(0.0)) != 0)
    return nodes.withColumns({"name": F.when(use, F.col("support").cast("string")).otherwise(F.col("name")), "support": F.when(~use, F.col("support"))})


def to_newick(nodes: DataFrame) -> DataFrame:
    """(tree, newick): children by node id. A tree is one text and so one group, walked depth-first without recursion, in
    proportion to its nodes whatever its depth. Nodes that no root reaches are an error."""
    label = F.concat(F.coalesce("name", F.lit("")), F.when(F.col("length").isNotNull(), F.concat(F.lit(":"), F.col("length").cast("string"))).otherwise(""))

    def write(t: pa.Table) -> pa.Table:
        ids, parents, labels = (t.column(c).to_pylist() for c in ("node_id", "parent_id", "label"))
        kids: dict[int | None, list[int]] = {}
        for k in sorted(range(len(ids)), key=ids.__getitem__):
            kids.setdefault(parents[k], []).append(k)
        out: list[str] = []
        stack: list[int | str] = []
        written = 0

        def push(level: list[int]) -> None:
            for at in range(len(level) - 1, -1, -1):
                stack.append(level[at])
                if at:
                    stack.append(",")

        push(kids.get(None, []))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
                continue
            written += 1
            if ids[x] in kids:
                out.append("(")
                stack.append(")" + labels[x])
                push(kids.pop(ids[x]))
            else:
                out.append(labels[x])
        if written != len(ids):
            raise ValueError(f"{len(ids) - written} nodes of a tree are not below a root")
        return pa.table({"tree": t.column("tree")[:1], "newick": pa.array(["".join(out) + ";"], pa.string())})

    kind = nodes.schema["tree"].dataType.simpleString()
    return nodes.select("tree", "node_id", "parent_id", label.alias("label")).groupBy("tree").applyInArrow(write, f"tree {kind}, newick string")


def reorder_edges(nodes: DataFrame, spans: DataFrame) -> DataFrame:
    """(tree, node_id, pos): depth-first order with children sorted by (span, first date, id).
    spans(tree, node_id, span, first_date)."""
    return tours.tour(nodes.join(spans, ["tree", "node_id"]), ["span", "first_date", "node_id"]).select("tree", "node_id", F.col("pre").alias("pos"))


def root_to_tip_fit(nodes: DataFrame, dates: DataFrame) -> DataFrame:
    """Least squares of the distance from the root over the date in days: (tree, n, slope, intercept)."""
    x = tours.levels(nodes).select("tree", "node_id", F.col("x").alias("d"))
    tips = nodes.where("is_tip").select("tree", "node_id").join(x, ["tree", "node_id"]).join(dates, ["tree", "node_id"]).withColumn("t", F.unix_date("date").cast("double"))
    return tips.groupBy("tree").agg(F.count("*").alias("n"), F.regr_slope("d", "t").alias("slope"), F.regr_intercept("d", "t").alias("intercept"))


def recent_distances(nodes: DataFrame, dates: DataFrame, q: float = 0.95, scale: float = 30_000.0, width: float = 1.0) -> DataFrame:
    """Histogram (tree, bin, n) of path distances between the tips later than a quantile of the dates. Two tips part at the
    ancestor below which their branches differ, so an ancestor's counts by distance are combined: all of them less those
    of one branch, each pair seen from both sides. Tips are never paired."""
    tips = nodes.where("is_tip").select("tree", "node_id").join(dates, ["tree", "node_id"]).withColumn("t", F.unix_date("date"))
    edge = tips.groupBy("tree").agg(F.percentile("t", q).alias("edge"))
    recent = tips.join(edge, "tree").where("t > edge").select("tree", "node_id")
    up = cut(ancestors(nodes).join(recent, ["tree", "node_id"]))
    branch = up.select("tree", "node_id", (F.col("hops") + 1).alias("hops"), F.col("anc").alias("branch"))
    parts = cut(up.where("hops > 0").join(branch, ["tree", "node_id", "hops"]).groupBy("tree", "anc", "branch", "dist").agg(F.count("*").alias("n")))

    def combined(counts: DataFrame, keys: list[str], sign: int) -> DataFrame:
        b = counts.select(*keys, F.col("dist").alias("dj"), F.col("n").alias("m"))
        bin_ = F.floor((F.col("dist") + F.col("dj")) * scale / width).cast("long").alias("bin")
        return counts.join(b, keys).groupBy("tree", bin_).agg((F.sum(F.col("n") * F.col("m")) * sign).alias("n"))

    whole = parts.groupBy("tree", "anc", "dist").agg(F.sum("n").alias("n"))
    both = combined(whole, ["tree", "anc"], 1).unionByName(combined(parts, ["tree", "anc", "branch"], -1))
    return both.groupBy("tree", "bin").agg(F.expr("sum(n) div 2").alias("n")).where("n > 0")
