"""How the star schema plays the roles of the engine: samples, features, locations, trees and side tables.

``PRELUDE`` is the same mapping as DuckDB SQL, to be put before a query's own select.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer -> name, country, region. Nation and region are fixed short tables."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    small = n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.col("n_name").alias("country"), F.col("r_name").alias("region"))
    c = table(spark, sf_dir, "customer")
    return c.join(small, c.c_nationkey == small.n_nationkey).select("c_custkey", F.col("c_name").alias("name"), "country", "region", F.col("c_mktsegment").alias("segment"))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """accession, lineage, coldate, name, country, region, location, price, status."""
    o, p = table(spark, sf_dir, "orders"), places(spark, sf_dir)
    return o.join(p, o.o_custkey == p.c_custkey).select(
        F.col("o_orderkey").alias("accession"), F.col("o_orderpriority").alias("lineage"), F.to_date("o_orderdate").alias("coldate"), "name", "country", "region",
        F.concat_ws(" / ", "region", "country").alias("location"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), "segment",
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (accession, typ, pos, alt), dealt by accession, so that sums by it don't move rows again."""
    l = table(spark, sf_dir, "lineitem")
    return l.select(F.col("l_orderkey").alias("accession"), F.col("l_returnflag").alias("typ"), F.col("l_linenumber").alias("pos"), F.col("l_linestatus").alias("alt")).repartition("accession").distinct()


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """accession and its missing intervals (left, right)."""
    l = table(spark, sf_dir, "lineitem")
    return l.groupBy(F.col("l_orderkey").alias("accession")).agg(F.collect_list(F.struct(F.col("l_quantity").cast("int").alias("left"), (F.col("l_quantity").cast("int") + F.col("l_linenumber")).alias("right"))).alias("missing"))


PRELUDE = """
with samples as (
  select o_orderkey as accession, o_orderpriority as lineage, cast(o_orderdate as date) as coldate, c_name as name, n_name as country, r_name as region,
         r_name || ' / ' || n_name as location, o_totalprice as price, o_orderstatus as status, c_mktsegment as segment
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
), features as (
  select distinct l_orderkey as accession, l_returnflag as typ, l_linenumber as pos, l_linestatus as alt from lineitem
), keys as (
  select accession, string_agg(typ || '|' || pos || '|' || alt, ',' order by typ, pos, alt) as variant_key, count(*) as n_features from features group by accession
), encoded as (
  select s.*, coalesce(k.variant_key, '') as variant_key, coalesce(k.n_features, 0) as n_features from samples s left join keys k using (accession)
), variants as (
  select lineage, variant_key, count(*) as n, min(coldate) as first_date, max(coldate) as last_date from encoded group by lineage, variant_key
)
"""
