"""Queries over the serving interface."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from genosieve.functions import expressions as X
from genosieve.operators import aggregates as A, ranking as R, serving as Q
from genosieve.plans import mapping as M
from genosieve.plans.filters import encoded
from genosieve.plans.registry import register
from genosieve.sources.shared import shared_folder

PRE = M.PRELUDE
_CID = ", ids as (select lineage, row_number() over (order by lineage) - 1 as cid from (select distinct lineage from samples))"


def points(spark: SparkSession, sf: str) -> DataFrame:
    p = A.points(encoded(spark, sf).withColumn("accession", F.concat(F.lit("EPI_ISL_"), F.col("accession").cast("string"))))
    cid = A.index_of(M.samples(spark, sf), "lineage").withColumnRenamed("key", "lineage")
    return p.join(cid, "lineage")


@register(PRE + _CID + "select accession, coldate, variant_key from encoded join ids using (lineage) where cid = 2", dates="coldate")
def q01_cluster_rows(spark: SparkSession, sf: str) -> DataFrame:
    ids = A.index_of(M.samples(spark, sf), "lineage").withColumnRenamed("key", "lineage")
    return Q.cluster_rows(encoded(spark, sf).join(ids, "lineage").select("cid", "accession", "coldate", "variant_key"), 2)


@register("select c_name, c_acctbal, c_mktsegment from customer")
def q02_tips(spark: SparkSession, sf: str) -> DataFrame:
    """A whole table without its internal id."""
    return M.table(spark, sf, "customer").select("c_name", "c_acctbal", "c_mktsegment")


@register("select p_name || p_partkey as lineage, 'XBB Lineages' as display from part where p_size = 3")
def q03_display(spark: SparkSession, sf: str) -> DataFrame:
    p = M.table(spark, sf, "part").select(F.concat("p_name", "p_partkey").alias("lineage"), F.col("p_size").alias("cid"), F.concat(F.lit("XBB."), F.col("p_size").cast("string")).alias("raw_lineage"))
    return Q.display_of(p, 3)


@register(PRE + _CID + "select cid from samples join ids using (lineage) where accession = 7")
def q04_cluster_of(spark: SparkSession, sf: str) -> DataFrame:
    s = M.samples(spark, sf).withColumn("accession", F.concat(F.lit("EPI_ISL_"), F.col("accession").cast("string")))
    return Q.lookup(A.index_of(s, "accession"), "epi_isl_7")


_Q05 = PRE + "select lineage, variant_key, coldate, count(*) as n from encoded group by 1, 2, 3 having coldate > date '1998-01-01' and coldate < date '1999-01-01' and count_if(contains(lower(location), 'asia') or contains(lower('EPI_ISL_' || accession), 'asia')) > 0"


@register(_Q05, dates="coldate")
def q05_search(spark: SparkSession, sf: str) -> DataFrame:
    return Q.search(points(spark, sf), "Asia", date(1998, 1, 1), date(1999, 1, 1)).select("lineage", "variant_key", "coldate", "n")


@register(_Q05, dates="coldate")
def q05_search_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The same through the posting index."""
    path = f"{shared_folder(spark)}/postings-{uuid.uuid4().hex}"
    p = points(spark, sf)
    Q.index_points(p, path)
    return Q.search_indexed(p, path, "Asia", date(1998, 1, 1), date(1999, 1, 1)).select("lineage", "variant_key", "coldate", "n")


@register("select 0 as section, c_name as key, lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')) as norm from customer where contains(lower(regexp_replace(c_name, '[^A-Za-z0-9]', '', 'g')), '00000001') order by c_name limit 10")
def q06_autocomplete(spark: SparkSession, sf: str) -> DataFrame:
    c = M.table(spark, sf, "customer").select(F.col("c_name").alias("key"))
    n = M.table(spark, sf, "nation").select(F.col("n_name").alias("key"))
    return Q.autocomplete(R.autocomplete_keys(c, n, X.normalize_key("key")), "#0000-0001")


@register(PRE + _CID + "select 'search' as kind, cid from encoded join ids using (lineage) where coldate > date '1998-01-01' and coldate < date '1998-02-01' and contains(lower(location), 'europe') group by cid")
def q07_route_query(spark: SparkSession, sf: str) -> DataFrame:
    index = A.index_of(M.samples(spark, sf), "lineage")
    return Q.route_query(points(spark, sf), index, "Europe", date(1998, 1, 1), date(1998, 2, 1))


@register(PRE + "select lineage, variant_key, coldate, 'EPI_ISL_' || accession as accession, location as label from encoded", dates="coldate")
def q08_sample_details(spark: SparkSession, sf: str) -> DataFrame:
    return Q.sample_details(points(spark, sf))


@register(PRE + ", sizes as (select lineage, count(*) as total from samples group by lineage) select lineage, typ || pos || alt as mutation, round(count(*) / any_value(total), 9) as frequency from samples join features using (accession) join sizes using (lineage) group by 1, 2")
def q09_mutation_details(spark: SparkSession, sf: str) -> DataFrame:
    f = A.feature_frequencies(M.samples(spark, sf), M.features(spark, sf))
    named = A.lineage_mutations(f, F.concat("typ", F.col("pos").cast("string"), "alt"))
    return Q.mutation_details(A.lineage_stats(encoded(spark, sf), named)).withColumn("frequency", F.round("frequency", 9))
