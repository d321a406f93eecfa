"""Joins of samples with side tables, stored states and each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def attach(left: DataFrame, right: DataFrame, key: str, strict: bool = False, value: str | None = None) -> DataFrame:
    """Left join on a key; ``strict`` makes a missing match fail when the row is computed."""
    out = left.join(right, key, "left")
    if strict:
        col = value or next(c for c in right.columns if c != key)
        out = out.withColumn(col, F.when(F.col(col).isNull(), F.raise_error(F.concat(F.lit("no match for "), F.col(key).cast("string")))).otherwise(F.col(col)))
    return out


def attach_region(df: DataFrame, countries: DataFrame, country: str = "country") -> DataFrame:
    """countries(name, code, region): looked up by lower-cased name or three-letter code; location is ``region / country``
    or the country alone."""
    keys = countries.select(F.lower("name").alias("key"), "region").unionByName(countries.select(F.lower("code").alias("key"), "region"))
    keys = keys.groupBy("key").agg(F.min("region").alias("region"))
    out = df.withColumn("key", F.lower(country)).join(keys, "key", "left").drop("key")
    return out.withColumn("location", F.concat_ws(" / ", "region", country))


def curated_or_all(samples: DataFrame, designated: DataFrame, key: str, group: str = "lineage") -> DataFrame:
    """Per group its designated samples, or all of them if none is. The flags are aggregated per group and joined back,
    so that no group meets in one task."""
    flagged = samples.join(designated.select(key).distinct().withColumn("curated", F.lit(True)), key, "left").withColumn("curated", F.coalesce("curated", F.lit(False)))
    some = flagged.groupBy(group).agg(F.bool_or("curated").alias("some"))
    return flagged.join(some, group).where("curated or not some").drop("curated", "some")


def split_known(feed: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(feed rows whose key the cache lacks, cached rows of keys in the feed)."""
    return feed.join(cache.select(key), key, "left_anti"), cache.join(feed.select(key).distinct(), key, "left_semi")


def concordance(log: DataFrame, samples: DataFrame, agree: bool, key: str = "accession") -> DataFrame:
    """Samples whose latest assignment (by version, then entry) names the same lineage, or another one."""
    latest = log.groupBy(key).agg(F.max_by("lineage", F.struct("version", "entry_id")).alias("assigned"))
    same = F.col("assigned") == F.col("lineage")
    return samples.join(latest, key).where(same if agree else ~same)


def append_missing(old: DataFrame, new: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """The old rows and those new ones whose key is absent (null is absent), one row per new key: the least by ``order``, then by all
    columns."""
    rest = F.struct(*new.columns)
    missing = new.join(old.select(key), key, "left_anti").groupBy(F.col(key).alias("#key")).agg(F.min(F.struct(F.struct(*(order or [key])), rest.alias("row"))).alias("r"))
    return old.unionByName(missing.select("r.row.*"))


def detect_changes(incoming: DataFrame, stored: DataFrame, key: str, header: str, content: str) -> DataFrame:
    """(key, change): new, header, content or same."""
    s = stored.select(key, F.col(header).alias("old_header"), F.xxhash64(content).alias("old_hash"), F.lit(True).alias("there"))
    j = incoming.join(s, key, "left")
    change = F.when(F.col("there").isNull(), "new").when(~F.col(header).eqNullSafe(F.col("old_header")), "header").when(F.xxhash64(content) != F.col("old_hash"), "content").otherwise("same")
    return j.select(key, change.alias("change"))


def lookup(wanted: DataFrame, table: DataFrame, key: str, order: str) -> DataFrame:
    """Wanted keys with their rows in the wanted order; ``found`` tells misses."""
    return wanted.join(table.withColumn("found", F.lit(True)), key, "left").withColumn("found", F.coalesce("found", F.lit(False))).orderBy(order)


def category_split(samples: DataFrame, alias: DataFrame, group: str = "lineage", min_groups: int = 2) -> DataFrame:
    """Adds category: by the alias entry of the prefix before the first dot. alias(prefix, parents array). With fewer than
    ``min_groups`` XBB lineages these count as other recombinants; an unknown prefix is its own category."""
    j = samples.withColumn("prefix", F.substring_index(group, ".", 1)).join(alias, "prefix", "left")
    raw = (
        F.when(F.lower(group).isin("unassigned", ""), "non-recombinant").when((F.size("parents") > 1) & (F.col("prefix") != "XBB"), "recombinant").when(F.col("prefix") == "XBB", "xbb")
        .when(F.get("parents", F.lit(0)).startswith("XBB"), "xbb").when(F.col("parents").isNotNull(), "non-recombinant").otherwise("unknown")
    )
    j = j.withColumn("raw", raw)
    n = j.where("raw = 'xbb'").agg(F.count_distinct(group).alias("n_xbb"))
    few = (F.col("raw") == "xbb") & (F.col("n_xbb") < min_groups)
    return j.join(F.broadcast(n)).withColumn("category", F.when(few, "recombinant").otherwise(F.col("raw"))).drop("prefix", "parents", "raw", "n_xbb")  # one row


def map_tips(tips: DataFrame, clusters: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(tips widened by their cluster, clusters without a tip)."""
    return tips.join(clusters, key), clusters.join(tips.select(key), key, "left_anti")


def tips_by_class(tips: DataFrame, stats: DataFrame, key: str, display: Column) -> DataFrame:
    """Tips widened with their group's statistics and routed by display class; tips without statistics stay."""
    return tips.join(stats, key, "left").withColumn("class", display)


def region_map(df: DataFrame, order: str) -> DataFrame:
    """First region seen of each country."""
    return df.groupBy("country").agg(F.min_by("region", order).alias("region"))


def attach_phenotypes(mutations: DataFrame, annotations: DataFrame, key: str = "mutation") -> DataFrame:
    effects = annotations.groupBy(key).agg(F.array_sort(F.collect_set("effect")).alias("phenotypes"))
    j = mutations.join(effects, key, "left")
    return j.withColumns({"phenotypes": F.coalesce("phenotypes", F.array().cast("array<string>")), "frequency": F.round("frequency", 2)})


def edge_table(edges: DataFrame, variants: DataFrame, group: list[str] | None = None) -> DataFrame:
    """edges(parent, child, dist) with both ends' labels and the child's first date as x; edges with an unknown end go. Names are
    those of a group where there are several."""
    g = group or []
    p = variants.select(*g, F.col("accession").alias("parent"), F.col("label").alias("parent_label"), F.col("x1").alias("parent_x1"))
    c = variants.select(*g, F.col("accession").alias("child"), F.col("label").alias("child_label"), F.col("x1"))
    return edges.join(p, [*g, "parent"]).join(c, [*g, "child"])


def extend_parents(variants: DataFrame, edges: DataFrame) -> DataFrame:
    """Variants with parent and distance; a parent's span is stretched over its children's first dates."""
    first = variants.select(F.col("accession").alias("child"), F.col("x1").alias("c1"))
    reach = edges.join(first, "child").groupBy(F.col("parent").alias("accession")).agg(F.min("c1").alias("lo"), F.max("c1").alias("hi"))
    own = edges.select(F.col("child").alias("accession"), "parent", "dist")
    j = variants.join(reach, "accession", "left").join(own, "accession", "left")
    return j.withColumns({"x1": F.least("x1", "lo"), "x2": F.greatest("x2", "hi")}).drop("lo", "hi")


def fill(counts: DataFrame, keys: DataFrame, key: str, n: str = "n") -> DataFrame:
    return counts.join(keys, key, "right").withColumn(n, F.coalesce(n, F.lit(0).cast("long")))


def _same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equi-join in which null keys are equal; the keys come back once."""
    right = b.withColumnsRenamed({k: f"#{k}" for k in keys})
    return a.join(right, [a[k].eqNullSafe(right[f"#{k}"]) for k in keys], how).drop(*(f"#{k}" for k in keys))


def nearest_hit(ids: DataFrame, hits: DataFrame, group: list[str], id_col: str = "id", first: int | None = None, last: int | None = None, slices: int = 64) -> DataFrame:
    """For every id the nearest hit of its group (ties: the larger), the last at or before and the first at or after;
    only hits from ``first`` to ``last`` count.

    A group is cut into ranges of ids, each one window partition, so a hot group is many tasks; a range takes one hit
    over from the ranges before it and one from those after. Every window runs from its start to the current row.
    """
    if first is not None:
        hits = hits.where(F.col(id_col) >= first)
    if last is not None:
        hits = hits.where(F.col(id_col) <= last)
    both = ids.select(*group, id_col, F.lit(None).cast("long").alias("hit")).unionByName(hits.select(*group, id_col, F.col(id_col).cast("long").alias("hit")).distinct())
    span = both.groupBy(*group).agg(F.min(id_col).alias("#low"), F.max(id_col).alias("#high"))
    share = (F.col(id_col) - F.col("#low")).cast("double") / (F.col("#high") - F.col("#low") + 1)
    both = _same(both, span, group).withColumn("#slice", F.floor(share * slices)).drop("#low", "#high")
    edge = both.groupBy(*group, "#slice").agg(F.min("hit").alias("#least"), F.max("hit").alias("#most"))  # at most ``slices`` rows a group
    w = lambda *order: Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    carry = edge.select(*group, "#slice", F.last("#most", True).over(w("#slice")).alias("#before"), F.last("#least", True).over(w(F.desc("#slice"))).alias("#after"))
    rows = _same(both, carry, [*group, "#slice"])
    v = lambda order: Window.partitionBy(*group, "#slice").orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select(*group, id_col, "hit", F.coalesce(F.last("hit", True).over(v(F.asc(id_col))), "#before").alias("before"), F.coalesce(F.last("hit", True).over(v(F.desc(id_col))), "#after").alias("after"))
    closer = (F.col("after") - F.col(id_col)) <= (F.col(id_col) - F.col("before"))
    nearest = F.when(F.col("before").isNull() | closer, F.col("after")).otherwise(F.col("before"))
    return rows.where("hit is null").drop("hit").withColumn("nearest", nearest)


def segment_dates(segments: DataFrame, dates: DataFrame) -> DataFrame:
    """Segments with their node's date, null at nodes without one."""
    return segments.join(dates.select("node_id", "date"), "node_id", "left")


def tree_segments(nodes: DataFrame, rectangular: bool = True) -> DataFrame:
    """Line segments (x1, y1, x2, y2) from every node to its parent: one slanted, or one level and one upright."""
    p = nodes.select(F.col("node_id").alias("parent_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    j = nodes.join(p, "parent_id")

    def seg(a: str, b: str, c: str, d: str) -> Column:
        return F.struct(F.col(a).alias("x1"), F.col(b).alias("y1"), F.col(c).alias("x2"), F.col(d).alias("y2"))

    parts = [seg("px", "y", "x", "y"), seg("px", "py", "px", "y")] if rectangular else [seg("px", "py", "x", "y")]
    return j.select("node_id", F.posexplode(F.array(*parts)).alias("part", "s")).select("node_id", "part", "s.*")
