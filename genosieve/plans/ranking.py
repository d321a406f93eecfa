"""Queries over ranks and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from genosieve.functions import expressions as X
from genosieve.operators import aggregates as A, ranking as R
from genosieve.plans import mapping as M
from genosieve.plans.filters import encoded
from genosieve.plans.registry import register

PRE = M.PRELUDE


@register(PRE + "select lineage, accession, coldate, variant_key from (select *, row_number() over (partition by lineage order by coldate, variant_key, accession) as rn from encoded) where rn = 1", dates="coldate")
def w01_representative(spark: SparkSession, sf: str) -> DataFrame:
    e = encoded(spark, sf).select("lineage", "accession", "coldate", "variant_key")
    return R.representative(e, [F.col("coldate"), F.col("variant_key"), F.col("accession")])


@register(PRE + "select * from (select *, row_number() over (partition by lineage order by last_date desc, variant_key desc) as rank from variants) where rank <= 50", dates="first_date last_date")
def w02_newest_variants(spark: SparkSession, sf: str) -> DataFrame:
    return R.newest_variants(A.variants(encoded(spark, sf)), 50)


@register("""with e as (select l_suppkey % 50 as cid, l_orderkey * 10 + l_linenumber as pos, l_partkey as parent, l_suppkey as child from (select l_orderkey, l_linenumber, min(l_partkey) as l_partkey, min(l_suppkey) as l_suppkey from lineitem group by 1, 2)),
f as (select cid, parent as node, pos * 2 as k from e union all select cid, child, pos * 2 + 1 from e) select cid, node, row_number() over (partition by cid order by k) as y from (select cid, node, min(k) as k from f group by 1, 2)""")
def w03_variant_order(spark: SparkSession, sf: str) -> DataFrame:
    l = M.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("parent"), F.min("l_suppkey").alias("child"))
    return R.variant_order(l.select((F.col("child") % 50).alias("cid"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), "parent", "child"), "cid")


@register(PRE + "select lineage, variant_key, arg_min(accession, row(coldate, accession)) as variant from encoded group by 1, 2")
def w04_name_variant(spark: SparkSession, sf: str) -> DataFrame:
    return R.name_variant(encoded(spark, sf))


@register("select n_regionkey as tree, n_nationkey, coalesce(case when n_nationkey % 2 = 0 then n_name end, 'unsampled' || (row_number() over (partition by n_regionkey, n_nationkey % 2 order by n_nationkey) - 1)) as name from nation")
def w05_name_unsampled(spark: SparkSession, sf: str) -> DataFrame:
    n = M.table(spark, sf, "nation").select(F.col("n_regionkey").alias("tree"), "n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("name"))
    return R.name_unsampled(n, "tree", ["n_nationkey"])


@register(PRE + "select country, first_date, row_number() over (order by first_date, country) - 1 as y from (select country, min(coldate) as first_date from samples group by country)", dates="first_date")
def w06_rank_recombinants(spark: SparkSession, sf: str) -> DataFrame:
    return R.rank_by(M.samples(spark, sf).groupBy("country").agg(F.min("coldate").alias("first_date")), ["first_date", "country"])


@register(PRE + ", f as (select lineage, typ, pos, alt, count(*) as n from samples join features using (accession) group by all) select * from (select *, row_number() over (partition by lineage order by n desc, typ, pos, alt) as rank from f) where rank <= 10")
def w07_top_mutations(spark: SparkSession, sf: str) -> DataFrame:
    f = A.feature_frequencies(M.samples(spark, sf), M.features(spark, sf)).drop("freq")
    return R.top_k(f, "lineage", [F.desc("n"), F.col("typ"), F.col("pos"), F.col("alt")], 10)


@register(PRE + "select lineage, count(*) as n, case when count(*) < 2650 then 'minor' else 'major' end as class from variants group by lineage")
def w08_size_classes(spark: SparkSession, sf: str) -> DataFrame:
    return R.size_classes(A.variants(encoded(spark, sf)), 2650)


@register("""with p as (select c_nationkey as cid, c_custkey as id, c_custkey % 7 as y, c_acctbal as x from customer) select cid, id, y, x, row_number() over w - 1 as hit, first_value(id) over w as first_id, last_value(id) over (partition by cid order by y, x, id rows between unbounded preceding and unbounded following) as last_id from p window w as (partition by cid order by y, x, id)""")
def w09_rank_hits(spark: SparkSession, sf: str) -> DataFrame:
    return R.rank_hits(M.table(spark, sf, "customer").select(F.col("c_nationkey").alias("cid"), F.col("c_custkey").alias("id"), (F.col("c_custkey") % 7).alias("y"), F.col("c_acctbal").alias("x")))


@register("""with a as (select 0 as part, n_name, row_number() over (order by n_name desc) as k from nation where n_regionkey < 2), b as (select 1, n_name, row_number() over (order by n_name) from nation where n_regionkey between 2 and 3), c as (select 2, n_name, row_number() over (order by n_name) from nation where n_regionkey > 3)
select part, n_name, row_number() over (order by part, k) - 1 as id from (select * from a union all select * from b union all select * from c)""")
def w10_display_ids(spark: SparkSession, sf: str) -> DataFrame:
    n = M.table(spark, sf, "nation")
    return R.display_ids([(n.where("n_regionkey < 2"), True), (n.where("n_regionkey between 2 and 3"), False), (n.where("n_regionkey > 3"), False)], "n_name")


@register(PRE + "select distinct 0 as section, name as key, lower(regexp_replace(name, '[^A-Za-z0-9]', '', 'g')) as norm from samples union all select distinct 1, lineage, lower(regexp_replace(lineage, '[^A-Za-z0-9]', '', 'g')) from samples")
def w12_autocomplete_keys(spark: SparkSession, sf: str) -> DataFrame:
    s = M.samples(spark, sf)
    return R.autocomplete_keys(s.select(F.col("name").alias("key")), s.select(F.col("lineage").alias("key")), X.normalize_key("key"))
