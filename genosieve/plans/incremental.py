"""Queries over incremental maintenance."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from genosieve.operators import aggregates as A, sets as S
from genosieve.plans import mapping as M
from genosieve.plans.registry import register
from genosieve.sources.shared import shared_folder
from genosieve.plans.aggregates import A05_SQL, feature_name
from genosieve.plans.filters import encoded
from genosieve.streaming import incremental as R, states as N

PRE = M.PRELUDE


@register("select event_id, event_type from events")
def r01_ingest_increment(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs of a stream over stored parts of the events; the second part repeats the first. The cache is returned."""
    root = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    e = M.table(spark, sf, "events").select("event_id", "event_type")
    for cond in ("event_id % 3 = 1", "true"):
        e.where(cond).write.mode("append").parquet(f"{root}/feed")
        feed = spark.readStream.schema(e.schema).parquet(f"{root}/feed")
        R.ingest(spark, feed, f"{root}/cache", f"{root}/log", "event_id", "event_type", f"{root}/checkpoint").awaitTermination()
    return R.cached(spark, f"{root}/cache", e.schema, "event_id")


@register(PRE + "select lineage, count(*) as n from samples where lineage in (select lineage from samples where coldate > date '2001-07-29') group by lineage")
def r02_refresh_groups(spark: SparkSession, sf: str) -> DataFrame:
    s = M.samples(spark, sf)
    updated = S.groups_to_update(s.where("coldate > '2001-07-29'"), s, s)
    return R.refresh(s, updated).groupBy("lineage").agg(F.count("*").alias("n"))


def stored_states(spark: SparkSession, sf: str) -> str:
    """The samples' states from three increments: two halves, of which one has status as its group at first, and its move."""
    path = f"{shared_folder(spark)}/states-{uuid.uuid4().hex}"
    s, f = encoded(spark, sf), M.features(spark, sf)
    early, late = s.where("accession % 2 = 0"), s.where("accession % 2 <> 0")
    wrong = early.withColumn("lineage", F.col("status"))
    for batch, come, go in (("a", wrong, None), ("b", late, None), ("c", early, wrong)):
        N.add(path, batch, (come, f), (go, f) if go is not None else None)
    return path


@register(A05_SQL, dates="lastcoldate")
def r02_merged_stats(spark: SparkSession, sf: str) -> DataFrame:
    """A05 from merged states."""
    stats = N.stats(spark, stored_states(spark, sf), feature_name(), 0.05)
    cols = ("lineage", "nsamples", "lastcoldate", "max_ndiffs", F.round("mean_ndiffs", 6).alias("mean_ndiffs"), F.size("mutations").cast("long").alias("n_mutations"))
    return stats.select(*cols, F.lit(0.0).alias("residual"), F.expr("substring(lineage, 3)").alias("raw_lineage"))


@register("with t as (select o_custkey as k, arg_max(o_totalprice, o_orderkey) as v from orders group by 1) select c_custkey as k, coalesce(v, c_acctbal) as v from customer left join t on k = c_custkey")
def r03_upsert(spark: SparkSession, sf: str) -> DataFrame:
    target = M.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    rows = M.table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), "o_orderkey")
    return R.upsert(target, rows, "k", "o_orderkey").select("k", "v")


@register("select user_id as accession, event_type as lineage, value as probability from events")
def r04_append_assignments(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{shared_folder(spark)}/assignments-{uuid.uuid4().hex}"
    e = M.table(spark, sf, "events").select(F.col("user_id").alias("accession"), F.col("event_type").alias("lineage"), F.col("value").alias("probability"), "event_id")
    for part in (0, 1):
        R.append_assignments(e.where(f"event_id % 2 = {part}").drop("event_id"), path)
    return spark.read.parquet(path)
