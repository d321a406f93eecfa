"""The chain from samples to bead plots and to what is served of them, and its daily run.

Samples are encoded: lineage (text), accession, coldate, name, location, region, country, variant_key, n_features. All lineages
go through together; a lineage's trees are bounded by the limit on its variants. Small lineages pass whole through one task (``forests``), large
ones over node tables.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window, functions as F

from genosieve.functions import expressions as X
from genosieve.operators import aggregates as A, forests as H, joining as J, joins, sets as S, trees as T
from genosieve.sources.shared import cut, cut_counting, release

SAMPLE = ("accession", "coldate", "location", "name", "region", "country")
#: The columns of samples that bead plots are made of and hold.
ENCODED = ("lineage", "variant_key", *SAMPLE)


@dataclass
class BeadPlots:
    """nodes(lineage, node_id, variant, n), edges(lineage, pos, parent, child, dist, support), and every sample under its node:
    samples(lineage, variant, and the sample's columns). Unsampled nodes have n = 0."""

    nodes: DataFrame
    edges: DataFrame
    samples: DataFrame


def dictionary(samples: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """(variant features long: lineage, variant_no, feature_no; feature dictionary)."""
    return _features(*A.recode(A.variants(samples), limit))


def _features(numbered: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame]:
    long = numbered.select("lineage", "variant_no", F.explode(F.split("variant_key", ",")).alias("feature"))
    return long.join(words, ["lineage", "feature"]).select("lineage", "variant_no", "feature_no"), words


def _by_size(numbered: DataFrame, replicates: int, *more: str) -> tuple[DataFrame, DataFrame | None]:
    """Numbered variants as rows of small lineages (``forests``), and those of large ones, if there are any."""
    rows, n = cut_counting(H.rows_of(numbered, *more), large=~H.is_small(F.col("v"), replicates))
    release(numbered.sparkSession)
    if not n["large"]:
        return rows, None
    small = H.is_small(F.col("v"), replicates)
    back = rows.where(~small).select("lineage", F.explode(F.arrays_zip("names", "keys")).alias("v"))
    return rows.where(small), back.select("lineage", F.col("v.names").alias("variant_no"), F.col("v.keys").alias("variant_key"))


def _large_trees(numbered: DataFrame, replicates: int) -> DataFrame:
    return J.bootstrap_trees(*_features(numbered, A.dictionary(numbered)), replicates)


def bootstrap_trees(numbered: DataFrame, replicates: int) -> DataFrame:
    """(lineage, replicate, node_id, parent_id, name, length, is_tip): bootstrap trees of numbered variants (lineage, variant_no,
    variant_key)."""
    small, large = _by_size(numbered, replicates)
    found = H.bootstrap_nodes(small, replicates)
    return found if large is None else found.unionByName(_large_trees(large, replicates).select(*found.columns))


def consensus_trees(numbered: DataFrame, replicates: int) -> DataFrame:
    """``consensus_of`` the bootstrap trees of numbered variants; the trees of small lineages are not written."""
    small, large = _by_size(numbered, replicates)
    found = H.bootstrap_consensus(small, replicates)
    return found if large is None else found.unionByName(consensus_of(_large_trees(large, replicates)).select(*found.columns))


def consensus_of(found: DataFrame) -> DataFrame:
    """Consensus of the bootstrap trees of every lineage: (group, key, parent, support, length, size)."""
    n = found.withColumn("tree", F.concat_ws("#", "lineage", "replicate")).withColumn("name", F.lpad("name", 4, "0"))
    if "sig1" not in n.columns:  # trees that were not numbered as they were built
        n = cut(n)
        n = n.join(T.clade_signatures(n), ["tree", "node_id"])
    return T.consensus_trees(cut(n.withColumn("group", F.col("lineage").cast("string"))))


def bead_plots(encoded: DataFrame, limit: int, replicates: int) -> BeadPlots:
    """Bead plots of all lineages; the consensus tree is contracted twice, as the chain does. Samples without features, and
    variants beyond the limit, take no part. Who reads the plots' samples gives ``encoded`` as a written table: it is read again
    for them."""
    variants = A.variants(encoded, F.min(F.struct("coldate", "accession")).alias("first"))
    numbered = A.number_variants(variants, limit).where("variant_key != ''")
    place = F.row_number().over(Window.partitionBy("lineage").orderBy("first"))
    small, large = _by_size(numbered.withColumns({"place": place, "label": F.col("first.accession").cast("string")}), replicates, "n", "place", "label")
    made = H.bead_nodes(small, replicates, T.MIN_LENGTH)
    made = cut(made if large is None else made.unionByName(_large_beads(encoded, large, replicates).select(*made.columns)))
    release(encoded.sparkSession)
    edges = made.where("pos is not null").select("lineage", "pos", "parent", F.col("variant").alias("child"), F.round("length", 2).alias("dist"), "support")
    parts = made.select("lineage", "variant", F.explode("keys").alias("variant_key"))
    placed = encoded.join(parts, ["lineage", "variant_key"]).select("lineage", "variant", *SAMPLE)
    return BeadPlots(made.select("lineage", "node_id", "variant", "n"), edges, placed)


def _large_beads(encoded: DataFrame, numbered: DataFrame, replicates: int) -> DataFrame:
    """As ``forests.bead_nodes``, of large lineages, over node tables."""
    nodes, supports = T.consensus_nodes(consensus_of(_large_trees(numbered, replicates)))
    part = numbered.select("lineage", "variant_key", F.lpad(F.col("variant_no").cast("string"), 4, "0").alias("part"))
    named = cut(encoded.join(part, ["lineage", "variant_key"]).select(F.col("lineage").alias("tree"), F.col("part").alias("name"), "accession", "coldate"))
    final = cut(T.contract(nodes, passes=2))
    names = cut(T.bead_names(final, named))
    edges = cut(T.bead_tree(final, names, supports)).select(F.col("tree").alias("lineage"), F.col("child").alias("variant"), "pos", "parent", F.col("dist").alias("length"), "support")
    parts = final.select(F.col("tree").alias("lineage"), "node_id", F.explode(F.split("name", r"\|")).alias("part"))
    keys = parts.join(part, ["lineage", "part"]).groupBy("lineage", "node_id").agg(F.collect_list("variant_key").alias("keys"))
    return names.withColumnRenamed("tree", "lineage").join(edges, ["lineage", "variant"], "left").join(keys, ["lineage", "node_id"], "left")


def node_table(plots: BeadPlots) -> DataFrame:
    """One row per node with its edge: (lineage, node_id, variant, n, pos, parent, dist, support)."""
    own = plots.edges.select("lineage", F.col("child").alias("variant"), "pos", "parent", "dist", "support")
    return plots.nodes.join(own, ["lineage", "variant"], "left").select("lineage", "node_id", "variant", "n", "pos", "parent", "dist", "support")


def cluster_tables(plots: BeadPlots) -> dict[str, DataFrame]:
    """What is served of bead plots: variants with dates, labels and maps (unsampled ones span their lineage's dates), points per
    variant and date, edges with both ends' labels, and one summary per lineage."""
    s = plots.samples.withColumnRenamed("variant", "variant_key")
    names = plots.nodes.select("lineage", F.col("variant").alias("variant_key"))
    labels = s.groupBy("lineage", "variant_key").agg(F.min_by(X.short_label(F.col("name")), F.struct("coldate", "accession", "location", "name")).alias("label"))
    variants = cut(A.variant_summary(s, names).join(labels, ["lineage", "variant_key"], "left").withColumn("label", F.coalesce("label", "variant_key")))
    ends = variants.select("lineage", F.col("variant_key").alias("accession"), "label", "x1")
    return {"variants": variants, "points": A.points(s), "edges": joins.edge_table(plots.edges, ends, ["lineage"]), "clusters": cluster_summaries(plots)}


def cluster_summaries(plots: BeadPlots) -> DataFrame:
    """One summary per lineage of its bead plot; the samples are read for each of its parts, so they are written first."""
    s = cut(plots.samples.select("lineage", *(c for c in SAMPLE if c != "name")))
    extents = A.cluster_extents(plots.edges, s)
    counts = plots.nodes.groupBy("lineage").agg(F.count("*").alias("n_nodes"), F.sum("n").alias("n_samples"))
    return A.cluster_summary(s).join(extents, "lineage").join(counts, "lineage")


def daily_run(stored: BeadPlots | None, new: DataFrame, current: DataFrame, limit: int, replicates: int) -> tuple[DataFrame, BeadPlots]:
    """(lineages computed again, bead plots of all current lineages): the chain runs for lineages with new samples and for those
    that no stored plot has; plots of the others are carried over, those of lineages that are gone are dropped."""
    old = stored.nodes if stored else new.select("lineage").where("false")
    updated = cut(S.groups_to_update(new.where("variant_key != ''"), current.where("variant_key != ''"), old))
    own = bead_plots(current.join(updated, "lineage", "left_semi"), limit, replicates)
    if stored is None:
        return updated, own
    kept = lambda fresh, before: cut(fresh.unionByName(before.join(updated, "lineage", "left_anti").join(current.select("lineage").distinct(), "lineage", "left_semi")))
    return updated, BeadPlots(kept(own.nodes, stored.nodes), kept(own.edges, stored.edges), kept(own.samples, stored.samples))
