"""Variants, common features, statistics and summaries of groups of samples."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from genosieve.functions import expressions as X
from genosieve.operators import ranks

FEATURE = ("typ", "pos", "alt")


def feature_keys(features: DataFrame, key: str = "accession") -> DataFrame:
    """(key, variant_key, n_features) of long features."""
    grouped = features.groupBy(key).agg(F.collect_list(F.struct(*FEATURE)).alias("f"))
    return grouped.select(key, X.variant_key(F.col("f")).alias("variant_key"), F.size("f").cast("long").alias("n_features"))


def encode_samples(samples: DataFrame, features: DataFrame, key: str = "accession") -> DataFrame:
    """Samples with variant_key and n_features; samples without features have the empty key."""
    joined = samples.join(feature_keys(features, key), key, "left")
    return joined.withColumns({"variant_key": F.coalesce("variant_key", F.lit("")), "n_features": F.coalesce("n_features", F.lit(0).cast("long"))})


def variants(samples: DataFrame, *more: Column, group: str = "lineage", date: str = "coldate") -> DataFrame:
    """Samples of a group with the same key are one variant; ``more`` are further aggregates."""
    return samples.groupBy(group, "variant_key").agg(F.count("*").alias("n"), F.min(date).alias("first_date"), F.max(date).alias("last_date"), *more)


def number_variants(v: DataFrame, limit: int, group: str = "lineage") -> DataFrame:
    """The first ``limit`` variants of a group, numbered from 0 by latest date, ties by key, both descending. Rows beyond the
    limit are dropped before they are shuffled."""
    return ranks.first_ranked(v, [F.desc("last_date"), F.desc("variant_key")], limit, [group], "variant_no")


def recode(v: DataFrame, limit: int, group: str = "lineage") -> tuple[DataFrame, DataFrame]:
    """(the first ``limit`` variants, numbered; (group, feature_no, feature) of their features)."""
    numbered = number_variants(v, limit, group)
    return numbered, dictionary(numbered, group)


def dictionary(numbered: DataFrame, group: str = "lineage") -> DataFrame:
    """(group, feature, feature_no) of the features of variants."""
    used = numbered.select(group, F.explode(F.split("variant_key", ",")).alias("feature")).where("feature != ''").distinct()
    return used.withColumn("feature_no", F.row_number().over(Window.partitionBy(group).orderBy("feature")) - 1)


def feature_frequencies(samples: DataFrame, features: DataFrame, group: str = "lineage", key: str = "accession") -> DataFrame:
    """(group, feature, n, freq): share of a group's samples that have a feature."""
    n = samples.groupBy(group).agg(F.count("*").alias("total"))
    found = samples.select(key, group).join(features, key).groupBy(group, *FEATURE).agg(F.count("*").alias("n"))
    return found.join(n, group).select(group, *FEATURE, "n", (F.col("n") / F.col("total")).alias("freq"))


def common_features(samples: DataFrame, features: DataFrame, group: str = "lineage", min_freq: float = 0.5) -> DataFrame:
    return feature_frequencies(samples, features, group).where(F.col("freq") >= min_freq)


def lineage_mutations(common: DataFrame, name: Column, group: str = "lineage") -> DataFrame:
    """(group, mutation, freq): features that have a name; of several with one name the largest share."""
    return common.select(group, name.alias("mutation"), "freq").where("mutation is not null").groupBy(group, "mutation").agg(F.max("freq").alias("freq"))


def lineage_stats(samples: DataFrame, mutations: DataFrame, residuals: DataFrame | None = None, raw: Column | None = None, group: str = "lineage", date: str = "coldate", infections: DataFrame | None = None) -> DataFrame:
    """One row per group: size, last date, most and mean features, residual (0 if absent), mutations, raw name, and the
    predicted infections where they are given (-1 if a group has none)."""
    base = samples.groupBy(group).agg(F.count("*").alias("nsamples"), F.max(date).alias("lastcoldate"), F.max("n_features").alias("max_ndiffs"), F.avg("n_features").alias("mean_ndiffs"))
    named = mutations.groupBy(group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("mutation", "freq")))).alias("mutations"))
    out = base.join(named, group, "left").withColumn("mutations", F.coalesce("mutations", F.create_map().cast("map<string,double>")))
    if residuals is not None:
        out = out.join(residuals, group, "left").withColumn("residual", F.coalesce("residual", F.lit(0.0)))
    if infections is not None:
        out = out.join(infections, group, "left").withColumn("infections", F.coalesce("infections", F.lit(-1.0)))
    return out if raw is None else out.withColumn("raw_lineage", raw)


def global_stats(samples: DataFrame, group: str = "lineage", date: str = "coldate") -> DataFrame:
    return samples.agg(F.max(date).alias("lastupdate"), F.count("*").alias("noseqs"), F.count_distinct(group).alias("nlineages"))


def shannon(counts: DataFrame, group: str, n: str = "n") -> DataFrame:
    """-sum p ln p per group, from one pass: ln N - sum(n ln n) / N."""
    total = F.sum(n)
    return counts.where(F.col(n) > 0).groupBy(group).agg((F.log(total) - F.sum(F.col(n) * F.log(n)) / total).alias("shannon"))


def nucleotide_diversity(frequencies: DataFrame, sizes: DataFrame, group: str = "lineage") -> DataFrame:
    """n / (n - 1) * sum over features of 2 p (1 - p): the mean number of differing features of two samples, without
    making pairs."""
    s = frequencies.groupBy(group).agg(F.sum(2 * F.col("freq") * (1 - F.col("freq"))).alias("s"))
    return sizes.where("n > 1").join(s, group, "left").select(group, (F.coalesce("s", F.lit(0.0)) * F.col("n") / (F.col("n") - 1)).alias("pi"))


def tree_summary(nodes: DataFrame, labels: DataFrame, group: str, frequencies: DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """Per tree: inner nodes without samples, tips, and Shannon's index over the tips' sample counts; with frequencies(group,
    freq) and sizes(group, n) also the sample size ``nvariants`` and the diversity ``pi``, null for a single sample.
    nodes(group, name, is_tip), labels(group, name, n)."""
    j = nodes.join(labels, [group, "name"], "left")
    base = j.groupBy(group).agg(F.count_if(~F.col("is_tip") & F.col("n").isNull()).alias("unsampled"), F.count_if(F.col("is_tip")).alias("ntips"))
    out = base.join(shannon(j.where("is_tip and n is not null"), group), group, "left")
    return out if frequencies is None else out.join(diversity_table(frequencies, sizes, group), group, "left")


def diversity_table(frequencies: DataFrame, sizes: DataFrame, group: str = "lineage") -> DataFrame:
    """(group, nvariants, pi): sample size and mean number of differing features."""
    return sizes.join(nucleotide_diversity(frequencies, sizes, group), group, "left").select(group, F.col("n").alias("nvariants"), "pi")


def merged_maps(index: DataFrame, per_map: int = 2000) -> DataFrame:
    """(part, m): an index (key, cid) as maps of about ``per_map`` keys, dealt by a hash of the key; of several ids of a key the
    least. So the whole map is many rows, whatever its size; a reader asks the part of its key."""
    parts = max(1, -(-index.count() // per_map))
    part = F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part")
    least = index.where("key is not null").groupBy("key").agg(F.min("cid").alias("cid"))
    return least.groupBy(part).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "cid")))).alias("m"))


def count_map(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """(keys, map value -> count, sorted by value)."""
    return df.groupBy(*keys, value).agg(F.count("*").alias("n")).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(value, "n")))).alias(name))


def merge_maps(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Sum of count maps per group."""
    return df.select(*keys, F.explode(col).alias("k", "v")).groupBy(*keys, "k").agg(F.sum("v").alias("n")).groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "n")))).alias(col))


def mode_first(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Commonest value per group; of equals the one that reached the top count first in ``order``. That is the one whose
    last row comes first, so counts and maxima say it and no group is sorted."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("n"), F.max(order).alias("last"))
    return counts.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("n")).alias("n"), "last")).alias(value))


def points(samples: DataFrame, group: str = "lineage", date: str = "coldate") -> DataFrame:
    """Per group, variant and date: count, accessions and labels in order, modal region, count maps."""
    keys = [group, "variant_key", date]
    base = samples.groupBy(*keys).agg(
        F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("accession", "name", "location"))), lambda x: x["accession"]).alias("accessions"),
        F.transform(F.array_sort(F.collect_list(F.struct("accession", "location"))), lambda x: x["location"]).alias("labels"),
    )
    mode = mode_first(samples, keys, "region", "accession").withColumnRenamed("region", "region1")
    countries, regions = count_map(samples, keys, "country", "countries"), count_map(samples, keys, "region", "regions")
    for other in (mode, regions, countries):
        base = base.join(other, keys)
    return base


def variant_summary(samples: DataFrame, nodes: DataFrame | None = None, group: str = "lineage", date: str = "coldate") -> DataFrame:
    """Per variant: first accession, dates, count, number of dates, unsampled. Unsampled nodes span the group's dates."""
    v = samples.groupBy(group, "variant_key").agg(F.min_by("accession", F.struct(date, "accession")).alias("accession"), F.min(date).alias("x1"), F.max(date).alias("x2"), F.count("*").alias("n"), F.count_distinct(date).alias("num_beads"))
    v = v.withColumn("unsampled", F.lit(False))
    if nodes is None:
        return v
    span = samples.groupBy(group).agg(F.min(date).alias("g1"), F.max(date).alias("g2"))
    out = nodes.join(v, [group, "variant_key"], "left").join(span, group, "left")
    lone = F.col("n").isNull()
    return out.select(group, "variant_key", "accession", F.coalesce("x1", "g1").alias("x1"), F.coalesce("x2", "g2").alias("x2"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("num_beads", F.lit(0)).alias("num_beads"), lone.alias("unsampled"))


def cluster_summary(samples: DataFrame, group: str = "lineage") -> DataFrame:
    """Per group: count maps, commonest region, and the distinct words of its locations as search text."""
    mode = mode_first(samples, [group], "region", "accession")
    words = samples.select(group, F.explode(F.split("location", " / ")).alias("w")).distinct().groupBy(group).agg(F.array_join(F.array_sort(F.collect_list("w")), " ").alias("searchtext"))
    return mode.join(words, group).join(count_map(samples, [group], "region", "regions"), group).join(count_map(samples, [group], "country", "countries"), group)


def variant_tables(samples: DataFrame, group: str = "lineage", date: str = "coldate") -> DataFrame:
    """Per variant: the label of its first sample, and its count maps of countries and regions."""
    keys = [group, "variant_key"]
    label = samples.groupBy(*keys).agg(F.min_by(X.short_label(F.col("name")), F.struct(date, "accession", "location", "name")).alias("label"))
    return label.join(count_map(samples, keys, "country", "countries"), keys).join(count_map(samples, keys, "region", "regions"), keys)


def first_label(samples: DataFrame, group: str = "lineage", date: str = "coldate") -> DataFrame:
    """Per group the label of its first sample, and the earliest and latest date."""
    return samples.groupBy(group).agg(F.min_by("name", F.struct(date, "accession", "name")).alias("label1"), F.min(date).alias("first_date"), F.max(date).alias("last_date"))


def tip_span(tips: DataFrame, year_days: float = 3.154e10 / 8.64e7) -> DataFrame:
    """Where a tip's bar begins and ends: its x less the years between its dates, and its x."""
    return tips.withColumns({"x1": F.col("x") - F.datediff("last_date", "first_date") / F.lit(year_days), "x2": F.col("x")})


def cluster_extents(edges: DataFrame, samples: DataFrame, group: str = "lineage", date: str = "coldate") -> DataFrame:
    """Per group the longest edge and the date span, null where there is none."""
    longest = edges.groupBy(group).agg(F.max("dist").alias("max_dist"))
    return samples.groupBy(group).agg(F.min(date).alias("min_date"), F.max(date).alias("max_date")).join(longest, group, "left")


def tip_stats(samples: DataFrame, rate: float = 0.0655342, origin: int = 18231, group: str = "lineage", date: str = "coldate") -> DataFrame:
    """Per group: dates, count, number of variants and the clock residual of its mean date."""
    day = F.unix_date(date)
    s = samples.groupBy(group).agg(F.min(date).alias("first_date"), F.max(date).alias("last_date"), F.count("*").alias("n"), F.count_distinct("variant_key").alias("varcount"), F.avg(day).alias("mean_day"), F.avg("n_features").alias("mean_diffs"))
    mean_date = F.date_add("first_date", F.round(F.col("mean_day") - F.unix_date("first_date")).cast("int"))
    return s.select(group, "first_date", "last_date", mean_date.alias("mcoldate"), "n", "varcount", "mean_diffs", (F.col("mean_diffs") - rate * (F.col("mean_day") - origin)).alias("residual"))


def clock_residuals(estimates: DataFrame, dates: DataFrame, key: str = "name") -> DataFrame:
    """(key, diff, zscore) of estimated against collected years. Fewer than two rows have no score."""
    d = estimates.join(dates, key).select(key, (F.col("estimate") - F.col("collected")).alias("diff"))
    s = d.agg(F.avg("diff").alias("m"), F.stddev_samp("diff").alias("sd"))
    return d.join(F.broadcast(s)).select(key, "diff", ((F.col("diff") - F.col("m")) / F.col("sd")).alias("zscore"))  # one row


def index_of(samples: DataFrame, key: str, group: str = "lineage") -> DataFrame:
    """(key, cid): the number of the group a key belongs to, groups numbered by name. Spark broadcasts the numbers if they
    are few."""
    cid = samples.select(group).distinct().withColumn("cid", F.row_number().over(Window.orderBy(group)) - 1)  # one row per group
    return samples.select(F.col(key).alias("key"), group).distinct().join(cid, group).select("key", "cid")


def latest_assignment(log: DataFrame, key: str = "accession") -> DataFrame:
    """Folds a key's assignments in entry order: one replaces the held one if its version is not older and its
    probability is higher. Sorted rows pass as a stream that holds one row, however long a key's log is."""
    names = [key, "entry_id", "version", "probability", "lineage"]

    def replaces(x: dict, held: dict) -> bool:
        if None in (x["version"], held["version"], x["probability"], held["probability"]) or x["version"] < held["version"]:
            return False
        p, q = x["probability"], held["probability"]
        return q == q and (p > q or p != p)  # NaN is above all numbers

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, schema = None, None
        for batch in batches:
            schema, done = batch.schema, []
            for x in batch.to_pylist():
                if held is None or held[key] != x[key]:
                    if held is not None:
                        done.append(held)
                    held = x
                elif replaces(x, held):
                    held = x
            yield pa.RecordBatch.from_pylist(done, schema=schema)
        if held is not None:
            yield pa.RecordBatch.from_pylist([held], schema=schema)

    rows = log.select(*names)
    return rows.repartition(key).sortWithinPartitions(*names).mapInArrow(fold, rows.schema)


def newest_first(rows: DataFrame, order: str) -> DataFrame:
    """Rows with ``nth``, the newest first, numbered from 0 over the whole table in ranges."""
    return ranks.ranked(rows, [F.desc(order)], name="nth")


def extents(tips: DataFrame) -> DataFrame:
    return tips.agg(F.min(F.log10("n")).alias("min_log_n"), F.max(F.log10("n")).alias("max_log_n"), F.min("last_date").alias("min_date"), F.max("last_date").alias("max_date"), F.min("residual").alias("min_residual"), F.max("residual").alias("max_residual"))


def display_ranges(tips: DataFrame) -> DataFrame:
    """Per display class the earliest projected root date (of the left-most tip) and the latest date."""
    root = F.date_sub("first_date", F.round(F.col("x") * 365.25).cast("int"))
    return tips.groupBy("class").agg(F.min_by(root, F.struct("x", "name")).alias("earliest"), F.max("last_date").alias("latest"))


def cumulative_samples(samples: DataFrame, date: str = "coldate") -> DataFrame:
    """Running number of samples by date; the running sum is over dates, whose number is small."""
    daily = samples.where(F.col(date).isNotNull()).groupBy(date).agg(F.count("*").alias("n"))
    return daily.select(date, F.sum("n").over(Window.orderBy(date).rowsBetween(Window.unboundedPreceding, 0)).alias("total"))
