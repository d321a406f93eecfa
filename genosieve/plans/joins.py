"""Queries over joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from genosieve.operators import joins as J
from genosieve.plans import mapping as M
from genosieve.plans.aggregates import assignments
from genosieve.plans.registry import register

PRE = M.PRELUDE


@register("select l_orderkey as accession, l_linenumber, o_orderpriority as lineage from lineitem left join orders on l_orderkey = o_orderkey")
def j01_attach_lineage(spark: SparkSession, sf: str) -> DataFrame:
    l = M.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("accession"), "l_linenumber")
    report = M.table(spark, sf, "orders").select(F.col("o_orderkey").alias("accession"), F.col("o_orderpriority").alias("lineage"))
    return J.attach(l, report, "accession", strict=True, value="lineage")


@register("select c_custkey, case when c_custkey % 3 = 2 then null else r_name end as region, concat_ws(' / ', case when c_custkey % 3 = 2 then null else r_name end, case c_custkey % 3 when 0 then upper(n_name) when 1 then 'N' || n_nationkey else 'x' end) as location from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def j02_attach_region(spark: SparkSession, sf: str) -> DataFrame:
    n, r, c = (M.table(spark, sf, t) for t in ("nation", "region", "customer"))
    countries = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("name"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("code"), F.col("r_name").alias("region"))
    name = F.when(F.col("c_custkey") % 3 == 0, F.upper("n_name")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))).otherwise("x")
    df = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", name.alias("country"))
    return J.attach_region(df, countries).select("c_custkey", "region", "location")


@register("with s as (select c_custkey, c_nationkey as lineage, c_mktsegment = 'MACHINERY' and c_nationkey % 2 = 0 as cur from customer) select c_custkey, lineage from (select *, max(cur) over (partition by lineage) as any_cur from s) where cur or not any_cur")
def j03_curated_or_all(spark: SparkSession, sf: str) -> DataFrame:
    c = M.table(spark, sf, "customer")
    designated = c.where("c_mktsegment = 'MACHINERY' and c_nationkey % 2 = 0").select("c_custkey")
    return J.curated_or_all(c.select("c_custkey", F.col("c_nationkey").alias("lineage")), designated, "c_custkey").select("c_custkey", "lineage")


@register("select o_orderkey, o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'A') as is_new from orders")
def j04_new_samples(spark: SparkSession, sf: str) -> DataFrame:
    feed = M.table(spark, sf, "orders").select("o_orderkey")
    cache = M.table(spark, sf, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("o_orderkey")).distinct()
    new, known = J.split_known(feed, cache, "o_orderkey")
    return new.withColumn("is_new", F.lit(True)).unionByName(known.withColumn("is_new", F.lit(False)))


@register(PRE + "select accession, lineage, segment, round(c_acctbal, 2) as acctbal from samples join customer on name = c_name")
def j05_enrich_samples(spark: SparkSession, sf: str) -> DataFrame:
    meta = M.table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.round("c_acctbal", 2).alias("acctbal"))
    return J.attach(M.samples(spark, sf), meta, "name", strict=True, value="acctbal").select("accession", "lineage", "segment", "acctbal")


_LATEST = "with log as (select event_id as entry_id, user_id as accession, event_type as lineage, cast(date_trunc('week', ts) as date) as version from events), latest as (select accession, arg_max(lineage, row(version, entry_id)) as assigned from log group by accession), s as (select c_custkey as accession, case c_nationkey % 3 when 0 then 'click' when 1 then 'view' else 'purchase' end as lineage from customer)"


@register(_LATEST + " select accession, lineage, assigned from s join latest using (accession) where assigned <> lineage")
def j06_concordance(spark: SparkSession, sf: str) -> DataFrame:
    s = M.table(spark, sf, "customer").select(F.col("c_custkey").alias("accession"), F.when(F.col("c_nationkey") % 3 == 0, "click").when(F.col("c_nationkey") % 3 == 1, "view").otherwise("purchase").alias("lineage"))
    return J.concordance(assignments(spark, sf), s, agree=False).select("accession", "lineage", "assigned")


@register("select o_orderkey as k, o_orderpriority as v from orders where o_orderkey % 2 = 0 union all select o_orderkey, o_orderstatus from orders where o_orderkey % 2 = 1")
def j07_append_missing(spark: SparkSession, sf: str) -> DataFrame:
    o = M.table(spark, sf, "orders")
    old = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("v"))
    return J.append_missing(old, o.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v")), "k")


@register("select doc_id, case when doc_id % 5 = 0 then 'new' when doc_id % 5 = 1 then 'header' when doc_id % 5 = 2 then 'content' else 'same' end as change from documents")
def j08_detect_changes(spark: SparkSession, sf: str) -> DataFrame:
    d = M.table(spark, sf, "documents").select("doc_id", "source", "text")
    stored = d.where("doc_id % 5 != 0").select("doc_id", F.when(F.col("doc_id") % 5 == 1, "other").otherwise(F.col("source")).alias("source"), F.when(F.col("doc_id") % 5 == 2, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("text"))
    return J.detect_changes(d, stored, "doc_id", "source", "text")


@register("select doc_id, n_chars, n_chars is not null as found from labels left join (select * from documents where doc_id % 4 > 0) using (doc_id)")
def j09_lookup(spark: SparkSession, sf: str) -> DataFrame:
    wanted = M.table(spark, sf, "labels").select("doc_id")
    return J.lookup(wanted, M.table(spark, sf, "documents").where("doc_id % 4 > 0").select("doc_id", "n_chars"), "doc_id", "doc_id")


@register("select p_partkey, case p_size % 4 when 0 then 'xbb' when 1 then 'recombinant' when 2 then 'non-recombinant' else 'unknown' end as category from part")
def j10_category_split(spark: SparkSession, sf: str) -> DataFrame:
    p = M.table(spark, sf, "part").select("p_partkey", F.concat(F.element_at(F.array(*map(F.lit, ("XBB", "XA", "BA", "Q"))), (F.col("p_size") % 4 + 1).cast("int")), F.lit("."), F.col("p_size").cast("string")).alias("lineage"))
    alias = spark.sql("select * from values ('XBB', array('A.1', 'B.2')), ('XA', array('B.1', 'C.1')), ('BA', array('B.1.1.529')) t(prefix, parents)")
    return J.category_split(p, alias).select("p_partkey", "category")


@register("select n_name as lineage, r_name, 'tip' as kind from nation join region on n_regionkey = r_regionkey where n_nationkey % 2 = 0 union all select n_name, null, 'unmatched' from nation where n_nationkey % 2 = 1")
def j11_map_tips(spark: SparkSession, sf: str) -> DataFrame:
    n, r = M.table(spark, sf, "nation"), M.table(spark, sf, "region")
    tips = n.where("n_nationkey % 2 = 0").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("lineage"), "r_name")
    matched, rest = J.map_tips(tips, n.select(F.col("n_name").alias("lineage")), "lineage")
    return matched.withColumn("kind", F.lit("tip")).unionByName(rest.select("lineage", F.lit(None).cast("string").alias("r_name"), F.lit("unmatched").alias("kind")))


@register(PRE + "select country, arg_min(region, accession) as region from samples group by country")
def j12_region_map(spark: SparkSession, sf: str) -> DataFrame:
    return J.region_map(M.samples(spark, sf), "accession")


@register("with ann as (select p_size as k, string_agg(distinct p_type, ',' order by p_type) as phenotypes from part where p_size % 2 = 0 group by 1) select l_orderkey, l_linenumber, round(l_discount, 2) as frequency, coalesce(phenotypes, '') as phenotypes from lineitem left join ann on k = cast(l_quantity as int)")
def j13_attach_phenotypes(spark: SparkSession, sf: str) -> DataFrame:
    m = M.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("mutation"), F.col("l_discount").alias("frequency"))
    ann = M.table(spark, sf, "part").where("p_size % 2 = 0").select(F.col("p_size").cast("int").alias("mutation"), F.col("p_type").alias("effect"))
    return J.attach_phenotypes(m, ann).select("l_orderkey", "l_linenumber", "frequency", F.array_join("phenotypes", ",").alias("phenotypes"))


def beads(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Orders as beads of one tree (x1 = x2 = date) and edges to the arithmetic parent."""
    o = M.table(spark, sf, "orders")
    v = o.select(F.col("o_orderkey").alias("accession"), F.col("o_orderpriority").alias("label"), F.to_date("o_orderdate").alias("x1"), F.to_date("o_orderdate").alias("x2"))
    e = o.where("o_orderkey > 0").select(F.floor((F.col("o_orderkey") - 1) / 4).cast("long").alias("parent"), F.col("o_orderkey").alias("child"), (F.col("o_totalprice") / 1000).alias("dist"))
    return v, e


_BEADS = "with v as (select o_orderkey as accession, o_orderpriority as label, cast(o_orderdate as date) as x1 from orders), e as (select (o_orderkey - 1) // 4 as parent, o_orderkey as child, o_totalprice / 1000 as dist from orders where o_orderkey > 0)"


@register(_BEADS + " select child, parent, round(dist, 6) as dist, p.label as parent_label, p.x1 as parent_x1, c.label as child_label, c.x1 as x1 from e join v p on parent = p.accession join v c on child = c.accession", dates="parent_x1 x1")
def j14_edge_table(spark: SparkSession, sf: str) -> DataFrame:
    v, e = beads(spark, sf)
    return J.edge_table(e.withColumn("dist", F.round("dist", 6)), v)


@register(_BEADS + ", r as (select parent as accession, min(x1) as lo, max(x1) as hi from e join v on child = accession group by 1) select v.accession, label, least(x1, lo) as x1, greatest(x1, hi) as x2, parent, round(dist, 6) as dist from v left join r on v.accession = r.accession left join e on v.accession = child", dates="x1 x2")
def j15_extend_parents(spark: SparkSession, sf: str) -> DataFrame:
    v, e = beads(spark, sf)
    return J.extend_parents(v, e.withColumn("dist", F.round("dist", 6)))


@register("select r_name as region, coalesce(n, 0) as n from region left join (select n_regionkey, count(*) as n from customer join nation on c_nationkey = n_nationkey where n_regionkey > 1 group by 1) on n_regionkey = r_regionkey")
def j16_fill_regions(spark: SparkSession, sf: str) -> DataFrame:
    counts = M.places(spark, sf).where("region not in ('AFRICA', 'AMERICA')").groupBy("region").agg(F.count("*").alias("n"))
    return J.fill(counts, M.table(spark, sf, "region").select(F.col("r_name").alias("region")), "region")


@register("""with ids as (select event_type, event_id as id from events where event_id % 10 > 0), h as (select event_type, event_id as hit from events where event_id % 10 = 0),
b as (select i.event_type, i.id, max(case when hit <= id then hit end) as before, min(case when hit >= id then hit end) as after from ids i left join h using (event_type) group by 1, 2)
select *, case when before is null or after - id <= id - before then after else before end as nearest from b""")
def j17_nearest_hit(spark: SparkSession, sf: str) -> DataFrame:
    e = M.table(spark, sf, "events").select("event_type", F.col("event_id").alias("id"))
    return J.nearest_hit(e.where("id % 10 > 0"), e.where("id % 10 = 0"), ["event_type"])


@register("""with n as (select o_orderkey as node_id, case when o_orderkey > 0 then (o_orderkey - 1) // 4 end as parent_id, o_totalprice as x, cast(o_custkey as double) as y from orders), j as (select c.*, p.x as px, p.y as py from n c join n p on c.parent_id = p.node_id)
select node_id, 0 as part, px as x1, y as y1, x as x2, y as y2 from j union all select node_id, 1, px, py, px, y from j""")
def j18_tree_segments(spark: SparkSession, sf: str) -> DataFrame:
    o = M.table(spark, sf, "orders")
    parent = F.when(F.col("o_orderkey") > 0, F.floor((F.col("o_orderkey") - 1) / 4).cast("long"))
    return J.tree_segments(o.select(F.col("o_orderkey").alias("node_id"), parent.alias("parent_id"), F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("y")))
