"""Statistics of groups kept as count tables, so that an increment is merged and no group's samples are read again.

Every state is a table of counts with a sign: how many samples of a group have a date, a number of features, a feature, and
which points they make. Increments add counts, samples that leave or move take them back, and extremes are those of the
values whose count is above 0, so nothing has to be computed anew. A batch writes its own folder, dealt to buckets of groups;
statistics of some groups read their buckets only. ``compact`` sums a store into a new one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from genosieve.operators import aggregates as A

KEYS = {"days": ("coldate",), "sizes": ("n_features",), "features": A.FEATURE, "points": ("variant_key", "coldate", "accession", "name", "location", "region", "country")}


def deltas(samples: DataFrame, features: DataFrame, sign: int = 1, group: str = "lineage", key: str = "accession") -> dict[str, DataFrame]:
    """(group, keys, n) of each state for samples that come (1) or go (-1). Samples are encoded; features are long."""
    found = samples.select(key, group).join(features.select(key, *A.FEATURE), key)
    rows = {k: found if k == "features" else samples for k in KEYS}
    return {k: rows[k].groupBy(group, *keys).agg((F.count("*") * sign).alias("n")) for k, keys in KEYS.items()}


def _bucket(group: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(group)), F.lit(buckets)).cast("int").alias("_bucket")


def add(path: str, batch: str, come: tuple[DataFrame, DataFrame] | None = None, go: tuple[DataFrame, DataFrame] | None = None, group: str = "lineage", buckets: int = 64) -> None:
    """Stores the counts of (samples, features) that come and go with a batch. One that runs again overwrites its own folder."""
    parts = [deltas(*rows, sign, group) for rows, sign in ((come, 1), (go, -1)) if rows]
    for name, keys in KEYS.items():
        rows = parts[0][name] if len(parts) == 1 else parts[0][name].unionByName(parts[1][name]).groupBy(group, *keys).agg(F.sum("n").alias("n")).where("n <> 0")
        rows.select("*", _bucket(group, buckets)).write.mode("overwrite").partitionBy("_bucket").parquet(f"{path}/{name}/_batch={batch}")


def totals(spark: SparkSession, path: str, name: str, groups: DataFrame | None = None, group: str = "lineage", buckets: int = 64) -> DataFrame:
    """(group, keys, n) of a state over all batches, of all groups or some; those read the buckets of the groups alone."""
    rows = spark.read.option("mergeSchema", "false").parquet(f"{path}/{name}")
    if groups is not None:
        own = [r[0] for r in groups.select(_bucket(group, buckets)).distinct().collect()]  # bounded by the number of buckets
        wanted = groups.select(F.col(group).alias("#group")).distinct()
        rows = rows.where(F.col("_bucket").isin(own)).join(wanted, F.col(group).eqNullSafe(F.col("#group")), "left_semi")
    return rows.groupBy(group, *KEYS[name]).agg(F.sum("n").alias("n")).where("n <> 0")


def group_sizes(days: DataFrame, group: str = "lineage") -> DataFrame:
    return days.groupBy(group).agg(F.sum("n").alias("total"))


def frequencies(spark: SparkSession, path: str, groups: DataFrame | None = None, group: str = "lineage", buckets: int = 64) -> DataFrame:
    """(group, feature, n, freq), as ``aggregates.feature_frequencies``."""
    n = group_sizes(totals(spark, path, "days", groups, group, buckets), group)
    return totals(spark, path, "features", groups, group, buckets).join(n, group).select(group, *A.FEATURE, "n", (F.col("n") / F.col("total")).alias("freq"))


def stats(spark: SparkSession, path: str, name: Column, min_freq: float, groups: DataFrame | None = None, group: str = "lineage", buckets: int = 64) -> DataFrame:
    """(group, nsamples, lastcoldate, max_ndiffs, mean_ndiffs, mutations), as ``aggregates.lineage_stats``."""
    days = totals(spark, path, "days", groups, group, buckets).groupBy(group).agg(F.sum("n").alias("nsamples"), F.max("coldate").alias("lastcoldate"))
    sizes = totals(spark, path, "sizes", groups, group, buckets).groupBy(group).agg(F.max("n_features").alias("max_ndiffs"), (F.sum(F.col("n_features") * F.col("n")) / F.sum("n")).alias("mean_ndiffs"))
    common = frequencies(spark, path, groups, group, buckets).where(F.col("freq") >= min_freq)
    named = A.lineage_mutations(common, name, group).groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("mutation", "freq")))).alias("mutations"))
    sizes, named = (x.withColumnRenamed(group, "#of") for x in (sizes, named))
    out = days.join(sizes, F.col(group).eqNullSafe(F.col("#of"))).drop("#of").join(named, F.col(group).eqNullSafe(F.col("#of")), "left").drop("#of")
    return out.withColumn("mutations", F.coalesce("mutations", F.create_map().cast("map<string,double>")))


def global_stats(spark: SparkSession, path: str, group: str = "lineage") -> DataFrame:
    """As ``aggregates.global_stats``, from the days of all groups."""
    return totals(spark, path, "days", group=group).agg(F.max("coldate").alias("lastupdate"), F.sum("n").alias("noseqs"), F.count_distinct(group).alias("nlineages"))


def points(spark: SparkSession, path: str, groups: DataFrame | None = None, group: str = "lineage", buckets: int = 64) -> DataFrame:
    """As ``aggregates.points``, of the samples that are there."""
    return A.points(totals(spark, path, "points", groups, group, buckets).drop("n"), group)


def compact(spark: SparkSession, path: str, out_path: str, group: str = "lineage", buckets: int = 64) -> None:
    """A new store with one row per key; bucket by bucket, for the next batches to go on with."""
    for name in KEYS:
        rows = totals(spark, path, name, group=group).select("*", _bucket(group, buckets))
        rows.repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(f"{out_path}/{name}/_batch=base")
