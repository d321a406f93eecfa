"""Queries over set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from genosieve.operators import sets as S
from genosieve.plans import mapping as M
from genosieve.plans.registry import register

PRE = M.PRELUDE


@register(PRE + "select distinct lineage, typ, pos, alt from samples join features using (accession)")
def s01_feature_union(spark: SparkSession, sf: str) -> DataFrame:
    return S.feature_union(M.samples(spark, sf), M.features(spark, sf))


@register(PRE + "select distinct country as lineage from samples where coldate >= date '2001-07-01' union (select country from samples except select n_name from nation where n_nationkey % 2 = 0)")
def s03_groups_to_update(spark: SparkSession, sf: str) -> DataFrame:
    s = M.samples(spark, sf).withColumn("lineage", F.col("country"))
    stored = M.table(spark, sf, "nation").where("n_nationkey % 2 = 0").select(F.col("n_name").alias("lineage"))
    return S.groups_to_update(s.where("coldate >= '2001-07-01'"), s, stored)


@register(PRE + "select name, count(*) as n, 'new' as state from samples where segment = 'MACHINERY' group by name union all select c_name, 0, 'stored' from customer where c_mktsegment <> 'MACHINERY' and c_custkey in (select o_custkey from orders)")
def s04_carry_over(spark: SparkSession, sf: str) -> DataFrame:
    s = M.samples(spark, sf)
    new = s.where("segment = 'MACHINERY'").groupBy("name").agg(F.count("*").alias("n")).withColumn("state", F.lit("new"))
    stored = M.table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.lit(0).cast("long").alias("n"), F.lit("stored").alias("state"))
    return S.carry_over(new, stored, s, "name")


@register("select c_name as name from customer where c_custkey not in (select o_custkey from orders where o_orderstatus = 'P')")
def s05_tip_label_check(spark: SparkSession, sf: str) -> DataFrame:
    tips = M.table(spark, sf, "customer").select(F.col("c_name").alias("name"))
    return S.tip_label_check(tips, M.samples(spark, sf).where("status = 'P'"))


@register("select c_name as name, c_acctbal as x, null as y from customer union all select s_name, null, s_acctbal from supplier union all select n_name, null, null from nation")
def s06_all_tips(spark: SparkSession, sf: str) -> DataFrame:
    c, s, n = (M.table(spark, sf, t) for t in ("customer", "supplier", "nation"))
    return S.concatenate(c.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("x")), s.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("y")), n.select(F.col("n_name").alias("name")))
