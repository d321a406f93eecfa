"""Queries over quality control and predicates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from genosieve.functions import expressions as X
from genosieve.operators import qc
from genosieve.plans import mapping as M
from genosieve.plans.registry import register

PRE = M.PRELUDE


@register("select p_partkey, replace(replace(trim(p_name || ', ' || p_type || '|'), ',', '_'), '|', '_') as clean, replace(replace(p_name, ' ', '_'), '''', '''''') || '__accession__' || p_partkey as fasta from part")
def f01_clean_name(spark: SparkSession, sf: str) -> DataFrame:
    p = M.table(spark, sf, "part")
    return p.select("p_partkey", X.clean_name(F.concat("p_name", F.lit(", "), "p_type", F.lit("|"))).alias("clean"), X.fasta_name(F.col("p_name"), F.col("p_partkey").cast("string")).alias("fasta"))


@register(PRE + """select case when regexp_matches(coalesce(case when country like '%3' then lower(country) else country end, ''), '^($|[a-z])') then 'nonhuman' when price < 29000 then 'short'
  when coldate < date '1996-01-01' or coldate > date '2001-01-01' then 'baddate' else 'kept' end as reason, count(*) as n from samples group by 1""")
def f02_qc_counts(spark: SparkSession, sf: str) -> DataFrame:
    s = M.samples(spark, sf)
    country = F.when(F.col("country").endswith("3"), F.lower("country")).otherwise(F.col("country"))
    return qc.qc_counts(s, qc.qc_reason(country, F.col("price"), F.col("coldate").cast("string"), 29_000, date(1996, 1, 1), date(2001, 1, 1)))


@register(PRE + """, mask as (select p_size as pos, p_brand as alt from part where p_size < 4)
select accession, typ, pos, alt from features f where not (typ = 'A' and exists (select 1 from mask m where m.pos = f.pos and contains('OF' || m.alt, f.alt))) and (typ = 'R' or not contains(alt, 'N'))""")
def f03_mask_features(spark: SparkSession, sf: str) -> DataFrame:
    mask = M.table(spark, sf, "part").where("p_size < 4").select(F.col("p_size").alias("pos"), F.concat(F.lit("OF"), "p_brand").alias("alt"))
    return qc.mask_features(M.features(spark, sf), mask, "A", "R")


@register(PRE + "select accession, lineage from samples where accession in (select accession from features where typ = 'A')")
def f04_drop_unmutated(spark: SparkSession, sf: str) -> DataFrame:
    f = M.features(spark, sf).where("typ = 'A'")
    return qc.drop_unmutated(M.samples(spark, sf), f).select("accession", "lineage")


@register(PRE + """, days as (select distinct datediff('day', date '1994-12-01', coldate) as day from samples),
grid as (select day, k, 0.002 * day as mu, sum(case when k > 0 then ln(k) else 0 end) over (partition by day order by k) as lf from days, range(0, 100) t(k)),
cdf as (select day, k, sum(case when mu > 0 then exp(k * ln(mu) - mu - lf) when k = 0 then 1.0 else 0.0 end) over (partition by day order by k) as cdf from grid),
lim as (select day, cast(count_if(cdf <= 0.05) as int) as qmin, cast(count_if(cdf <= 1 - 0.05) as int) as qmax from cdf group by day)
select accession, day, qmin, qmax, n_features > qmax or n_features <= qmin as outlier from (select *, datediff('day', date '1994-12-01', coldate) as day from encoded) join lim using (day)""")
def f05_clock_outliers(spark: SparkSession, sf: str) -> DataFrame:
    found = qc.clock_outliers(encoded(spark, sf), 0.002, 0.05, date(1994, 12, 1), maxtime=None)
    return found.select("accession", "day", "qmin", "qmax", "outlier")


@register(PRE + """, dated as (select *, datediff('day', date '1994-12-01', coldate) as day, least(datediff('day', date '1994-12-01', coldate), 1600) as d from encoded),
grid as (select d, k, 0.0655 * d as mu, sum(case when k > 0 then ln(k) else 0 end) over (partition by d order by k) as lf from (select distinct d from dated), range(0, 400) t(k)),
cdf as (select d, k, sum(case when mu > 0 then exp(k * ln(mu) - mu - lf) when k = 0 then 1.0 else 0.0 end) over (partition by d order by k) as cdf from grid),
lim as (select d, cast(count_if(cdf <= 0.005) as int) as qmin, cast(count_if(cdf <= 1 - 0.005) as int) as qmax from cdf group by d)
select accession, day, qmin, qmax, n_features > qmax or n_features <= qmin as outlier from dated join lim using (d)""")
def f05_clock_outliers_late(spark: SparkSession, sf: str) -> DataFrame:
    """The reference's rate and cutoff, with limits beyond 100 features and days after the last one of the clock."""
    found = qc.clock_outliers(encoded(spark, sf), 0.0655, 0.005, date(1994, 12, 1), maxtime=1600)
    return found.select("accession", "day", "qmin", "qmax", "outlier")


def encoded(spark: SparkSession, sf: str) -> DataFrame:
    """Samples with their features' key and number."""
    from genosieve.operators import aggregates

    return aggregates.encode_samples(M.samples(spark, sf), M.features(spark, sf))


@register("select l_orderkey as accession, sum(l_linenumber) as total from lineitem group by 1 having sum(l_linenumber) <= 20")
def f06_total_missing(spark: SparkSession, sf: str) -> DataFrame:
    return qc.drop_missing(M.intervals(spark, sf), 20).select("accession", X.total_missing("missing").cast("long").alias("total"))


@register("select o_orderkey, nullif(o_orderstatus, 'P') as lineage from orders where o_orderstatus <> 'P'")
def f07_drop_unclassified(spark: SparkSession, sf: str) -> DataFrame:
    o = M.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).otherwise("None").alias("lineage"))
    return qc.drop_unclassified(o)


@register("""with s as (select doc_id, source || '/' || lang || '/' || doc_id as header, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) as s, doc_id % 500 as accession, n_chars, cast(2020 + doc_id % 5 as varchar) || '-' || cast(1 + doc_id % 13 as varchar) || '-11' as d from documents),
t as (select *, row_number() over (partition by accession order by header) as rn, length(s) - length(regexp_replace(regexp_replace(s, '[N?]', '', 'g'), '^-+|-+$', '', 'g')) as amb from s)
select accession, case when regexp_matches(header, '/es/') then 'nonhuman' when length(s) < 900 then 'short' when amb > length(s) * 0.08 then 'ambiguous' when regexp_matches(header, '^src7') then 'mangled' when rn > 1 then 'duplicate'
  when try_strptime(d, '%Y-%m-%d') is null or cast(try_strptime(d, '%Y-%m-%d') as date) not between date '2020-02-01' and date '2023-06-01' then 'baddate' end as reason, count(*) as n from t group by 1, 2""")
def f08_qc_strict(spark: SparkSession, sf: str) -> DataFrame:
    d = M.table(spark, sf, "documents").select(F.concat_ws("/", "source", "lang", "doc_id").alias("header"), F.regexp_replace("text", "[^A-Za-z]", "").alias("text"), (F.col("doc_id") % 500).alias("acc"), F.concat_ws("-", 2020 + F.col("doc_id") % 5, 1 + F.col("doc_id") % 13, F.lit("11")).alias("d"))
    found = qc.qc_strict(d, "header", "text", "acc", "d", 0.08, 900, "/es/", "^src7", (date(2020, 2, 1), date(2023, 6, 1)))
    return found.groupBy("accession", "reason").agg(F.count("*").alias("n"))


@register(PRE + "select accession, country, case when accession % 3 > 0 then coldate end as day from samples", dates="day")
def f09_parse_label(spark: SparkSession, sf: str) -> DataFrame:
    s = M.samples(spark, sf)
    day = F.when(F.col("accession") % 3 > 0, F.date_format("coldate", "yyyy-MM-dd")).otherwise(F.date_format("coldate", "yyyy-MM"))
    label = s.select("accession", F.concat_ws("|", F.concat_ws("/", F.lit("v"), "country", "name"), F.col("accession").cast("string"), day).alias("label"))
    country, d = X.parse_label(F.col("label"))
    return label.select("accession", country.alias("country"), d.alias("day"))


@register("select l_orderkey, l_linenumber, l_quantity as dist from lineitem where l_quantity <= least(20.0, (select max(l_quantity) from lineitem))")
def f10_edges_within(spark: SparkSession, sf: str) -> DataFrame:
    e = M.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("dist"))
    return qc.edges_within(e, default=20.0)


@register(PRE + "select lineage, variant_key, first_date, last_date from variants where first_date <= date '1998-06-30' and last_date >= date '1998-01-01'", dates="first_date last_date")
def f11_in_window(spark: SparkSession, sf: str) -> DataFrame:
    from genosieve.operators import aggregates

    v = aggregates.variants(encoded(spark, sf))
    return qc.in_window(v, date(1998, 1, 1), date(1998, 6, 30), "first_date", "last_date").select("lineage", "variant_key", "first_date", "last_date")


@register("select p_partkey, p_name from part where contains(p_name, 'red') or contains(p_type, 'red')")
def f12_match_text(spark: SparkSession, sf: str) -> DataFrame:
    p = M.table(spark, sf, "part").select("p_partkey", "p_name", F.array("p_name", "p_type").alias("labels"))
    return qc.match_text(p, "red", "labels").select("p_partkey", "p_name")


@register(PRE + "select accession, name from samples where name in (select name from samples where lineage = '1-URGENT' and status = 'P')")
def f13_points_of(spark: SparkSession, sf: str) -> DataFrame:
    s = M.samples(spark, sf)
    return qc.points_of(s, s.where("lineage = '1-URGENT' and status = 'P'"), "name").select("accession", "name")


@register("""select event_id, event_id % 2 = 0 as accession, event_type in (select distinct event_type from events where value > 10) as lineage, event_id % 13 between 1 and 12 and event_id % 31 between 1 and 31 as iso
from events where event_id % 31 is not null""")
def f14_predicates(spark: SparkSession, sf: str) -> DataFrame:
    e = M.table(spark, sf, "events")
    known = e.where("value > 10").select(F.upper("event_type").alias("key")).distinct()
    text = e.select("event_id", F.concat(F.when(F.col("event_id") % 2 == 0, "epi_isl_").otherwise("EPI_ISL"), F.col("event_id").cast("string")).alias("a"), F.upper("event_type").alias("key"), F.format_string("2021-%02d-%02d", F.col("event_id") % 13, F.col("event_id") % 31).alias("d"))
    joined = text.join(known.withColumn("hit", F.lit(True)), "key", "left")
    return joined.select("event_id", X.is_accession("a").alias("accession"), F.coalesce("hit", F.lit(False)).alias("lineage"), X.is_iso_date("d").alias("iso"))
