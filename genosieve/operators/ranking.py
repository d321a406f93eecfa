"""Ranks, orders and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from genosieve.operators import ranks


def representative(samples: DataFrame, order: list[Column], group: str = "lineage", earliest: bool = True) -> DataFrame:
    """The earliest (or latest) sample of each group by an order that is total. An aggregate, so no group is sorted."""
    key = F.struct(*order)
    pick = F.min_by if earliest else F.max_by
    return samples.groupBy(group).agg(pick(F.struct(*[c for c in samples.columns if c != group]), key).alias("s")).select(group, "s.*")


def with_reference(rows: DataFrame, reference: DataFrame) -> DataFrame:
    """A reference (or outgroup) row before the representatives: its missing columns are null, ``ord`` puts it first."""
    return reference.withColumn("ord", F.lit(0)).unionByName(rows.withColumn("ord", F.lit(1)), allowMissingColumns=True)


def newest_variants(variants: DataFrame, n: int, group: str = "lineage") -> DataFrame:
    first = ranks.first_ranked(variants, [F.desc("last_date"), F.desc("variant_key")], n, [group])
    return first.withColumn("rank", F.col("rank") + 1)


def variant_order(edges: DataFrame, group: str) -> DataFrame:
    """edges(group, pos, parent, child): y is the rank of a node's first appearance in the flattened edge list, from 1."""
    flat = edges.select(group, F.posexplode(F.array("parent", "child")).alias("k", "node"), "pos")
    first = flat.groupBy(group, "node").agg(F.min(F.col("pos") * 2 + F.col("k")).alias("at"))
    return ranks.ranked(first, [F.col("at")], [group], "y").select(group, "node", (F.col("y") + 1).alias("y"))


def name_variant(samples: DataFrame, group: str = "lineage") -> DataFrame:
    """A variant is named after its first sample by date, accession, location and name."""
    return samples.groupBy(group, "variant_key").agg(F.min_by("accession", F.struct("coldate", "accession", "location", "name")).alias("variant"))


def name_unsampled(nodes: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``unsampled{k}`` for nodes without a name, k in level order."""
    w = Window.partitionBy(group, F.col("name").isNull()).orderBy(*order)
    return nodes.withColumn("name", F.coalesce("name", F.concat(F.lit("unsampled"), (F.row_number().over(w) - 1).cast("string"))))


def rank_by(df: DataFrame, order: list[Column | str], name: str = "y", group: list[str] | None = None) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*(group or [])).orderBy(*order)) - 1)


def top_k(df: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def size_classes(variants: DataFrame, mincount: int, group: str = "lineage") -> DataFrame:
    n = variants.groupBy(group).agg(F.count("*").alias("n"))
    return n.withColumn("class", F.when(F.col("n") < mincount, "minor").otherwise("major")).orderBy(F.desc("n"), group)


def rank_hits(points: DataFrame, group: str = "cid") -> DataFrame:
    """Hits in cluster order descending, then y and x; the first and last one of each cluster."""
    place = F.struct("y", "x", "id")
    ends = points.groupBy(group).agg(F.min_by("id", place).alias("first_id"), F.max_by("id", place).alias("last_id")).withColumnRenamed(group, "#group")
    hits = ranks.ranked(points, [F.col("y"), F.col("x"), F.col("id")], [group], "hit")
    return hits.join(ends, F.col(group).eqNullSafe(F.col("#group"))).drop("#group").select(*points.columns, "hit", "first_id", "last_id")


def display_ids(lists: list[tuple[DataFrame, bool]], order: str) -> DataFrame:
    """Continuous ids over concatenated lists, each in order (or reversed); tables of tips, one row per group."""
    parts = [df.select(order, F.lit(i).alias("part"), F.row_number().over(Window.orderBy(F.desc(order) if back else F.asc(order))).alias("k")) for i, (df, back) in enumerate(lists)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("part", order, (F.row_number().over(Window.orderBy("part", "k")) - 1).alias("id"))


def autocomplete_keys(accessions: DataFrame, lineages: DataFrame, normalized: Column) -> DataFrame:
    """Both lists with their section and a normalised key, in order."""
    both = accessions.select(F.lit(0).alias("section"), "key").unionByName(lineages.select(F.lit(1).alias("section"), "key")).distinct()
    return both.withColumn("norm", normalized).orderBy("section", "key")
