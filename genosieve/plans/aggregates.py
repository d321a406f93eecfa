"""Queries over variants, statistics and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from genosieve.operators import aggregates as A
from genosieve.plans import mapping as M
from genosieve.plans.filters import encoded
from genosieve.plans.registry import register

PRE = M.PRELUDE
_FREQ = ", sizes as (select lineage, count(*) as total from samples group by lineage), freq as (select lineage, typ, pos, alt, count(*) as n, count(*) / any_value(total) as freq from samples join features using (accession) join sizes using (lineage) group by lineage, typ, pos, alt)"
def feature_name() -> Column:
    return F.when(F.col("typ") != "R", F.concat_ws(":", F.lit("aa"), "typ", "pos"))

_POINTS = "lineage, variant_key, coldate"


@register(PRE + "select * from variants", dates="first_date last_date")
def a01_variants(spark: SparkSession, sf: str) -> DataFrame:
    return A.variants(encoded(spark, sf))


@register(PRE + ", num as (select *, row_number() over (partition by lineage order by last_date desc, variant_key desc) - 1 as variant_no from variants), used as (select distinct lineage, unnest(string_split(variant_key, ',')) as feature from num where variant_no < 50) select lineage, feature, row_number() over (partition by lineage order by feature) - 1 as feature_no from used where feature <> ''")
def a02_recode(spark: SparkSession, sf: str) -> DataFrame:
    return A.recode(A.variants(encoded(spark, sf)), 50)[1]


@register(PRE + _FREQ + " select lineage, typ, pos, alt, n, round(freq, 9) as freq from freq where freq >= 0.05")
def a03_common_features(spark: SparkSession, sf: str) -> DataFrame:
    return A.common_features(M.samples(spark, sf), M.features(spark, sf), min_freq=0.05).withColumn("freq", F.round("freq", 9))


@register(PRE + _FREQ + " select lineage, 'aa:' || typ || ':' || pos as mutation, round(max(freq), 9) as freq from freq where freq >= 0.05 and typ <> 'R' group by 1, 2")
def a04_lineage_mutations(spark: SparkSession, sf: str) -> DataFrame:
    common = A.common_features(M.samples(spark, sf), M.features(spark, sf), min_freq=0.05)
    return A.lineage_mutations(common, feature_name()).withColumn("freq", F.round("freq", 9))


A05_SQL = PRE + _FREQ + """, mut as (select lineage, count(distinct 'aa:' || typ || ':' || pos) as n_mutations from freq where freq >= 0.05 and typ <> 'R' group by lineage)
select lineage, count(*) as nsamples, max(coldate) as lastcoldate, max(n_features) as max_ndiffs, round(avg(n_features), 6) as mean_ndiffs, any_value(coalesce(n_mutations, 0)) as n_mutations, 0.0 as residual, substr(lineage, 3) as raw_lineage from encoded left join mut using (lineage) group by lineage"""


@register(A05_SQL, dates="lastcoldate")
def a05_lineage_stats(spark: SparkSession, sf: str) -> DataFrame:
    samples, features = encoded(spark, sf), M.features(spark, sf)
    mutations = A.lineage_mutations(A.common_features(samples, features, min_freq=0.05), feature_name())
    none = samples.select("lineage").where("false").withColumn("residual", F.lit(0.0))
    stats = A.lineage_stats(samples, mutations, none, F.expr("substring(lineage, 3)"))
    return stats.select("lineage", "nsamples", "lastcoldate", "max_ndiffs", F.round("mean_ndiffs", 6).alias("mean_ndiffs"), F.size("mutations").cast("long").alias("n_mutations"), "residual", "raw_lineage")


@register(PRE + "select max(coldate) as lastupdate, count(*) as noseqs, count(distinct lineage) as nlineages from samples", dates="lastupdate")
def a06_global_stats(spark: SparkSession, sf: str) -> DataFrame:
    return A.global_stats(M.samples(spark, sf))


@register(PRE + "select lineage, round(-sum(n / t * ln(n / t)), 6) as shannon from (select lineage, n, sum(n) over (partition by lineage) as t from variants) group by lineage")
def a07_shannon(spark: SparkSession, sf: str) -> DataFrame:
    return A.shannon(A.variants(encoded(spark, sf)), "lineage").withColumn("shannon", F.round("shannon", 6))


@register(PRE + _FREQ + " select lineage, round(sum(2 * freq * (1 - freq)) * any_value(total) / (any_value(total) - 1), 6) as pi from freq join sizes using (lineage) group by lineage")
def a08_nucleotide_diversity(spark: SparkSession, sf: str) -> DataFrame:
    samples = M.samples(spark, sf)
    freq = A.feature_frequencies(samples, M.features(spark, sf))
    return A.nucleotide_diversity(freq, samples.groupBy("lineage").agg(F.count("*").alias("n"))).withColumn("pi", F.round("pi", 6))


@register("""with nodes as (select n_regionkey as tree, n_name as name, true as is_tip from nation union all select r_regionkey, r_name, false from region), lab as (select n_regionkey as tree, n_name as name, count(*) as n from customer join nation on c_nationkey = n_nationkey where c_mktsegment <> 'MACHINERY' group by 1, 2),
j as (select * from nodes left join lab using (tree, name)) select tree, count_if(not is_tip and n is null) as unsampled, count_if(is_tip) as ntips, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 6) as shannon from j group by tree""")
def a09_tree_summary(spark: SparkSession, sf: str) -> DataFrame:
    n, r = M.table(spark, sf, "nation"), M.table(spark, sf, "region")
    nodes = n.select(F.col("n_regionkey").alias("tree"), F.col("n_name").alias("name"), F.lit(True).alias("is_tip")).unionByName(r.select(F.col("r_regionkey").alias("tree"), F.col("r_name").alias("name"), F.lit(False).alias("is_tip")))
    c = M.table(spark, sf, "customer").where("c_mktsegment != 'MACHINERY'")
    labels = c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("n_regionkey").alias("tree"), F.col("n_name").alias("name")).agg(F.count("*").alias("n"))
    return A.tree_summary(nodes, labels, "tree").withColumn("shannon", F.round("shannon", 6))


@register(PRE + f""", m as (select {_POINTS}, region, row_number() over (partition by {_POINTS}, region order by accession) as nth, accession from encoded),
mode as (select {_POINTS}, first(region order by nth desc, accession) as region1 from m group by {_POINTS}),
b as (select {_POINTS}, count(*) as n, string_agg(cast(accession as varchar), ',' order by accession) as accessions, string_agg(location, ',' order by accession, location) as labels, count(distinct region) as n_regions, count(distinct country) as n_countries from encoded group by {_POINTS}) select * from b join mode using ({_POINTS})""", dates="coldate")
def a10_points(spark: SparkSession, sf: str) -> DataFrame:
    p = A.points(encoded(spark, sf))
    return p.select("lineage", "variant_key", "coldate", "n", F.array_join(F.col("accessions").cast("array<string>"), ",").alias("accessions"), F.array_join("labels", ",").alias("labels"), F.size("regions").cast("long").alias("n_regions"), F.size("countries").cast("long").alias("n_countries"), "region1")


@register(PRE + """, v as (select lineage, variant_key, arg_min(accession, row(coldate, accession)) as accession, min(coldate) as x1, max(coldate) as x2, count(*) as n, count(distinct coldate) as num_beads from encoded group by 1, 2),
span as (select lineage, min(coldate) as g1, max(coldate) as g2 from encoded group by 1), nodes as (select lineage, variant_key from v union all select lineage, 'unsampled0' from span)
select lineage, variant_key, accession, coalesce(x1, g1) as x1, coalesce(x2, g2) as x2, coalesce(n, 0) as n, coalesce(num_beads, 0) as num_beads, n is null as unsampled from nodes left join v using (lineage, variant_key) join span using (lineage)""", dates="x1 x2")
def a11_variant_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = encoded(spark, sf)
    nodes = e.select("lineage", "variant_key").distinct().unionByName(e.select("lineage", F.lit("unsampled0").alias("variant_key")).distinct())
    return A.variant_summary(e, nodes)


@register(PRE + """, m as (select lineage, region, row_number() over (partition by lineage, region order by accession) as nth, accession from samples), mode as (select lineage, first(region order by nth desc, accession) as region from m group by lineage),
w as (select lineage, string_agg(w, ' ' order by w) as searchtext from (select distinct lineage, unnest(string_split(location, ' / ')) as w from samples) group by lineage), c as (select lineage, count(distinct country) as n_countries from samples group by lineage)
select * from mode join w using (lineage) join c using (lineage)""")
def a12_cluster_summary(spark: SparkSession, sf: str) -> DataFrame:
    return A.cluster_summary(M.samples(spark, sf)).select("lineage", "region", "searchtext", F.size("countries").cast("long").alias("n_countries"))


@register(PRE + "select segment, region as k, count(*) as n from samples group by 1, 2")
def a13_merge_tables(spark: SparkSession, sf: str) -> DataFrame:
    """Count maps per lineage and segment are merged per segment."""
    maps = A.count_map(M.samples(spark, sf), ["lineage", "segment"], "region", "regions")
    return A.merge_maps(maps, ["segment"], "regions").select("segment", F.explode("regions").alias("k", "n"))


@register(PRE + """select lineage, min(coldate) as first_date, max(coldate) as last_date, min(coldate) + cast(round(avg(datediff('day', date '1970-01-01', coldate)) - datediff('day', date '1970-01-01', min(coldate))) as int) as mcoldate, count(*) as n, count(distinct variant_key) as varcount,
round(avg(n_features), 6) as mean_diffs, round(avg(n_features) - 0.0655342 * (avg(datediff('day', date '1970-01-01', coldate)) - 18231), 6) as residual from encoded group by lineage""", dates="first_date last_date mcoldate")
def a14_tip_stats(spark: SparkSession, sf: str) -> DataFrame:
    return A.tip_stats(encoded(spark, sf)).withColumns({"mean_diffs": F.round("mean_diffs", 6), "residual": F.round("residual", 6)})


@register("""with d as (select o_orderkey as name, 1990 + o_totalprice / 50000 - (year(o_orderdate) + (dayofyear(o_orderdate) - 1) / 365.25) as diff from orders), s as (select avg(diff) as m, stddev_samp(diff) as sd from d) select name, round(diff, 6) as diff, round((diff - m) / sd, 6) as zscore from d, s""")
def a15_clock_residuals(spark: SparkSession, sf: str) -> DataFrame:
    from genosieve.functions import expressions as X

    o = M.table(spark, sf, "orders")
    estimates = o.select(F.col("o_orderkey").alias("name"), (1990 + F.col("o_totalprice") / 50000).alias("estimate"))
    found = A.clock_residuals(estimates, o.select(F.col("o_orderkey").alias("name"), X.year_fraction(F.to_date("o_orderdate")).alias("collected")))
    return found.select("name", F.round("diff", 6).alias("diff"), F.round("zscore", 6).alias("zscore"))


@register(PRE + "select accession as key, cid from samples join (select lineage, row_number() over (order by lineage) - 1 as cid from (select distinct lineage from samples)) using (lineage)")
def a16_index_accessions(spark: SparkSession, sf: str) -> DataFrame:
    return A.index_of(M.samples(spark, sf), "accession")


@register(PRE + "select count(*) as n_keys, sum(cid) as sum_ids from samples join (select lineage, row_number() over (order by lineage) - 1 as cid from (select distinct lineage from samples)) using (lineage)")
def a17_merged_maps(spark: SparkSession, sf: str) -> DataFrame:
    """All accessions in maps of bounded size."""
    maps = A.merged_maps(A.index_of(M.samples(spark, sf), "accession"))
    values = F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x)
    return maps.agg(F.sum(F.size("m").cast("long")).alias("n_keys"), F.sum(values).alias("sum_ids"))


@register(PRE + "select count(distinct lineage) as n_keys, sum(cid) as sum_ids from (select distinct lineage, dense_rank() over (order by lineage) - 1 as cid from samples)")
def a17_merged_map(spark: SparkSession, sf: str) -> DataFrame:
    """All key -> id rows of lineages in one map (one entry per lineage)."""
    ids = A.index_of(M.samples(spark, sf), "lineage")
    merged = ids.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "cid")))).alias("m"))
    return merged.select(F.size("m").cast("long").alias("n_keys"), F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("sum_ids"))


@register(PRE + """, t as (select lineage, count(*) as n, max(coldate) as last_date, avg(n_features) as residual from encoded group by lineage) select round(min(log10(n)), 9) as min_log_n, round(max(log10(n)), 9) as max_log_n, min(last_date) as min_date, max(last_date) as max_date, round(min(residual), 6) as min_residual, round(max(residual), 6) as max_residual from t""", dates="min_date max_date")
def a18_extents(spark: SparkSession, sf: str) -> DataFrame:
    t = encoded(spark, sf).groupBy("lineage").agg(F.count("*").alias("n"), F.max("coldate").alias("last_date"), F.avg("n_features").alias("residual"))
    e = A.extents(t)
    return e.select(*(F.round(c, 9 if "log" in c else 6).alias(c) if "date" not in c else c for c in e.columns))


def assignments(spark: SparkSession, sf: str) -> DataFrame:
    """Events as an assignment log: user as accession, type as lineage, value as probability, weeks as versions."""
    e = M.table(spark, sf, "events")
    return e.select(F.col("event_id").alias("entry_id"), F.col("user_id").alias("accession"), F.col("event_type").alias("lineage"), F.col("value").alias("probability"), F.to_date(F.date_trunc("week", "ts")).alias("version"))


_FOLD = """with recursive log as (select event_id as entry_id, user_id as accession, event_type as lineage, value as probability, cast(date_trunc('week', ts) as date) as version, row_number() over (partition by user_id order by event_id) as rn from events),
fold as (select rn, accession, entry_id, version, probability, lineage from log where rn = 1 union all
 select l.rn, l.accession, case when l.version >= f.version and l.probability > f.probability then l.entry_id else f.entry_id end, case when l.version >= f.version and l.probability > f.probability then l.version else f.version end,
  case when l.version >= f.version and l.probability > f.probability then l.probability else f.probability end, case when l.version >= f.version and l.probability > f.probability then l.lineage else f.lineage end from fold f join log l on l.accession = f.accession and l.rn = f.rn + 1),
best as (select accession, arg_max(entry_id, rn) as entry_id, arg_max(version, rn) as version, arg_max(probability, rn) as probability, arg_max(lineage, rn) as lineage from fold group by accession)
"""


@register(_FOLD + "select * from best", dates="version")
def a19_latest_assignment(spark: SparkSession, sf: str) -> DataFrame:
    return A.latest_assignment(assignments(spark, sf))


@register(_FOLD + "select lineage, accession, entry_id, c_name from best join customer on accession = c_custkey")
def a20_lineage_sequences(spark: SparkSession, sf: str) -> DataFrame:
    c = M.table(spark, sf, "customer").select(F.col("c_custkey").alias("accession"), "c_name")
    return A.latest_assignment(assignments(spark, sf)).join(c, "accession").select("lineage", "accession", "entry_id", "c_name")


@register(PRE + """, t as (select name, region as class, min(coldate) as first_date, max(coldate) as last_date, count(*) / 10.0 as x from samples group by name, region) select class, arg_min(first_date - cast(round(x * 365.25) as int), row(x, name)) as earliest, max(last_date) as latest from t group by class""", dates="earliest latest")
def a21_display_ranges(spark: SparkSession, sf: str) -> DataFrame:
    t = M.samples(spark, sf).groupBy("name", F.col("region").alias("class")).agg(F.min("coldate").alias("first_date"), F.max("coldate").alias("last_date"), (F.count("*") / 10.0).alias("x"))
    return A.display_ranges(t)


@register(PRE + "select coldate, sum(count(*)) over (order by coldate) as total from samples group by coldate", dates="coldate")
def n01_cumulative_samples(spark: SparkSession, sf: str) -> DataFrame:
    return A.cumulative_samples(M.samples(spark, sf))
