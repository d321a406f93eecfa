"""Queries over the further parts of operators: tables beside the summaries, rooted and pruned trees, ranges, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from genosieve.functions import expressions as X
from genosieve.operators import aggregates as A, joins as J, qc, ranking as R, trees as T
from genosieve.plans import mapping as M
from genosieve.plans.filters import encoded
from genosieve.plans.registry import register
from genosieve.plans.trees import NODES, dates, nodes
from genosieve.sources import io
from genosieve.sources.shared import shared_folder

PRE = M.PRELUDE


@register("""with h as (select event_type, event_id as hit from events where event_id % 10 = 0 and event_id between 2000 and 6000), i as (select event_type, event_id as id from events where event_id % 10 > 0),
b as (select i.*, hit as before from i asof left join h on i.event_type = h.event_type and i.id >= h.hit), a as (select i.*, hit as after from i asof left join h on i.event_type = h.event_type and i.id <= h.hit)
select event_type, id, before, after, case when before is null or after - id <= id - before then after else before end as nearest from b join a using (event_type, id)""")
def j17_nearest_hit_in_range(spark: SparkSession, sf: str) -> DataFrame:
    e = M.table(spark, sf, "events").select("event_type", F.col("event_id").alias("id"))
    return J.nearest_hit(e.where("id % 10 > 0"), e.where("id % 10 = 0"), ["event_type"], first=2000, last=6000)


@register(PRE + """, r as (select lineage, accession, coldate, variant_key from (select *, row_number() over (partition by lineage order by coldate, variant_key, accession) as rn from encoded) where rn = 1)
select 0 as ord, 'reference' as lineage, null as accession, null as coldate, '' as variant_key union all select 1, * from r""", dates="coldate")
def w01_with_reference(spark: SparkSession, sf: str) -> DataFrame:
    e = encoded(spark, sf).select("lineage", "accession", "coldate", "variant_key")
    rows = R.representative(e, [F.col("coldate"), F.col("variant_key"), F.col("accession")])
    return R.with_reference(rows, spark.sql("select 'reference' as lineage, '' as variant_key"))


@register(NODES + """, o as (select n.tree, n.node_id as out_id, n.parent_id as start from nodes n join (select tree, max(node_id) as node_id from nodes group by tree) using (tree, node_id)),
path as (select a.tree, a.anc, a.hops, n.length from anc a join o on o.tree = a.tree and o.start = a.node_id join nodes n on n.tree = a.tree and n.node_id = a.anc),
moved as (select n.tree, n.node_id, case when p.anc is not null then q.anc else n.parent_id end as parent_id, n.name, case when p.anc is not null then q.length else n.length end as length, n.is_tip
  from nodes n left join path p on p.tree = n.tree and p.anc = n.node_id left join path q on q.tree = p.tree and q.hops = p.hops - 1 where not exists (select 1 from o where o.tree = n.tree and o.out_id = n.node_id)),
kids as (select tree, parent_id as node_id, count(*) as kids from moved where parent_id is not null group by 1, 2), kept as (select moved.* from moved left join kids using (tree, node_id) where is_tip or kids > 1),
up as (select tree, node_id, parent_id as anc, length as dist, 1 as hops from moved where parent_id is not null union all select u.tree, u.node_id, m.parent_id, u.dist + m.length, u.hops + 1 from up u join moved m on m.tree = u.tree and m.node_id = u.anc where m.parent_id is not null),
best as (select u.tree, u.node_id, arg_min(u.anc, u.hops) as parent_id, arg_min(u.dist, u.hops) as dist from up u join kept k on k.tree = u.tree and k.node_id = u.anc group by 1, 2)
select k.tree, k.node_id, b.parent_id, k.name, round(b.dist, 6) as length, k.is_tip from kept k left join best b using (tree, node_id)""")
def t11_drop_outgroup(spark: SparkSession, sf: str) -> DataFrame:
    """The last tip of every tree plays the outgroup."""
    n = nodes(spark, sf)
    last = n.groupBy("tree").agg(F.max("node_id").alias("out_id"))
    named = n.join(last, "tree").withColumn("name", F.when(F.col("node_id") == F.col("out_id"), "reference").otherwise(F.col("name"))).drop("out_id")
    return T.drop_outgroup(named).withColumn("length", F.round("length", 6))


@register(NODES + """, lab as (select tree, c_name as name, c_name || '/' || k as label from (select tree, c_name, unnest(range(1 + node_id % 3)) as k from c)), f as (select n.tree, n.node_id, n.name, label from nodes n join lab using (tree, name))
select * from f union all select tree, node_id, null, null from nodes where (tree, node_id) not in (select (tree, node_id) from f)""")
def t07_node_labels(spark: SparkSession, sf: str) -> DataFrame:
    c = M.table(spark, sf, "customer")
    k = F.explode(F.sequence(F.lit(0), (F.floor(F.col("c_custkey") / 5) % 3).cast("int")))
    labels = c.select((F.col("c_custkey") % 5).alias("tree"), F.col("c_name").alias("name"), k.alias("k")).select("tree", "name", F.concat_ws("/", "name", F.col("k").cast("string")).alias("label"))
    return T.node_labels(nodes(spark, sf), labels)


_BEADS = NODES + """, smp as (select o_custkey % 5 as tree, c_name as name, o_orderkey as accession, cast(o_orderdate as date) as coldate from orders join customer on c_custkey = o_custkey),
first as (select n.tree, n.node_id, cast(arg_min(accession, row(coldate, accession)) as varchar) as variant, count(*) as n from nodes n join smp using (tree, name) group by 1, 2), dep as (select tree, node_id, max(hops) as depth from anc group by 1, 2),
nm as (select n.tree, n.node_id, depth, coalesce(variant, 'unsampled' || (row_number() over (partition by n.tree, variant is null order by depth, n.node_id) - 1)) as variant, coalesce(f.n, 0) as n from nodes n join dep using (tree, node_id) left join first f using (tree, node_id))
"""


def _beads(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    n = nodes(spark, sf)
    o, c = M.table(spark, sf, "orders"), M.table(spark, sf, "customer")
    smp = o.join(c, o.o_custkey == c.c_custkey).select((F.col("o_custkey") % 5).alias("tree"), F.col("c_name").alias("name"), F.col("o_orderkey").alias("accession"), F.to_date("o_orderdate").alias("coldate"))
    return n, T.bead_names(n, smp)


@register(_BEADS + "select tree, node_id, variant, n from nm")
def t08_bead_names(spark: SparkSession, sf: str) -> DataFrame:
    return _beads(spark, sf)[1]


@register(_BEADS + "select n.tree, row_number() over (partition by n.tree order by b.depth, n.node_id) - 1 as pos, a.variant as parent, b.variant as child, round(n.length, 2) as dist, n.support from nodes n join nm a on a.tree = n.tree and a.node_id = n.parent_id join nm b on b.tree = n.tree and b.node_id = n.node_id")
def t08_bead_tree(spark: SparkSession, sf: str) -> DataFrame:
    n, names = _beads(spark, sf)
    return T.bead_tree(n, names, n)


@register(NODES + """, good as (select n.tree, n.node_id from nodes n join dates using (tree, node_id) where is_tip and date >= date '2020-07-01'), live as (select distinct a.tree, a.anc as node_id from anc a join good using (tree, node_id)),
al as (select nodes.* from nodes join live using (tree, node_id)), kd as (select tree, parent_id as node_id, count(*) as kids from al group by 1, 2), kept as (select al.* from al left join kd using (tree, node_id) where is_tip or kids > 1),
u as (select a.tree, a.node_id, arg_min(a.anc, hops) as anc, arg_min(a.dist, hops) as dist from anc a join kept on kept.tree = a.tree and kept.node_id = a.anc where hops > 0 group by 1, 2),
num as (select *, row_number() over (partition by tree order by node_id) - 1 as new_id from kept)
select k.tree, k.new_id as node_id, p.new_id as parent_id, k.name, round(u.dist, 6) as length, k.is_tip from num k left join u using (tree, node_id) left join num p on p.tree = k.tree and p.node_id = u.anc""")
def t14_renumbered(spark: SparkSession, sf: str) -> DataFrame:
    """Pruned trees numbered again; the layout that comes with them is T13's and is tested there."""
    found = T.renumber(T.prune_before(nodes(spark, sf), dates(spark, sf), F.lit("2020-07-01").cast("date")))
    return found.select("tree", "node_id", "parent_id", "name", F.round("length", 6).alias("length"), "is_tip")


@register(NODES + "select tree, node_id, case when is_tip then concat_ws('|', name, cast(date as varchar)) else cast(support as varchar) end as name from nodes left join dates using (tree, node_id)")
def io13_dated_labels(spark: SparkSession, sf: str) -> DataFrame:
    return T.dated_labels(nodes(spark, sf), dates(spark, sf)).select("tree", "node_id", "name")


@register(NODES + "select tree, node_id, case when not is_tip and name is null and support <> 0 then cast(support as varchar) else name end as name, case when is_tip or name is not null or support = 0 then support end as support from nodes")
def t10_support_names(spark: SparkSession, sf: str) -> DataFrame:
    return T.support_names(nodes(spark, sf)).select("tree", "node_id", "name", "support")


@register(NODES + ", st as (select c_name as name, c_mktsegment as raw_lineage from customer) select tree, node_id, raw_lineage from nodes left join st using (name)")
def t12_raw_lineage(spark: SparkSession, sf: str) -> DataFrame:
    stats = M.table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("raw_lineage"))
    return T.tree_table(nodes(spark, sf), stats).select("tree", "node_id", "raw_lineage")


@register(PRE + """, st as (select lineage, count(*) as nsamples, round(avg(n_features), 6) as mean_ndiffs from encoded where status = 'F' group by lineage), tips as (select distinct case when lineage like '1%' then 'XBB' when lineage like '2%' then 'XA' else 'B' end as prefix, lineage from samples)
select lineage, nsamples, mean_ndiffs, case when prefix like 'XBB%' then 'XBB Lineages' when prefix like 'X%' then 'Other Recombinants' else 'Non-Recombinants' end as class from tips left join st using (lineage)""")
def j11_tips_by_class(spark: SparkSession, sf: str) -> DataFrame:
    e = encoded(spark, sf)
    stats = e.where("status = 'F'").groupBy("lineage").agg(F.count("*").alias("nsamples"), F.round(F.avg("n_features"), 6).alias("mean_ndiffs"))
    prefix = F.when(F.col("lineage").startswith("1"), "XBB").when(F.col("lineage").startswith("2"), "XA").otherwise("B")
    return J.tips_by_class(e.select("lineage").distinct(), stats, "lineage", X.display_class(prefix))


@register("""with n as (select o_orderkey as node_id, case when o_orderkey > 0 then (o_orderkey - 1) // 4 end as parent_id, o_totalprice as x, cast(o_custkey as double) as y, cast(o_orderdate as date) as date from orders), j as (select c.*, p.x as px, p.y as py from n c join n p on c.parent_id = p.node_id)
select node_id, 0 as part, px as x1, py as y1, x as x2, y as y2, date from j""", dates="date")
def j18_segment_dates(spark: SparkSession, sf: str) -> DataFrame:
    o = M.table(spark, sf, "orders")
    parent = F.when(F.col("o_orderkey") > 0, F.floor((F.col("o_orderkey") - 1) / 4).cast("long"))
    n = o.select(F.col("o_orderkey").alias("node_id"), parent.alias("parent_id"), F.col("o_totalprice").alias("x"), F.col("o_custkey").cast("double").alias("y"), F.to_date("o_orderdate").alias("date"))
    return J.segment_dates(J.tree_segments(n.drop("date"), rectangular=False), n)


@register(PRE + """, s as (select min(coldate) as a, max(coldate) as b from samples) select accession, round(datediff('day', a, coldate) / (datediff('day', a, b) / 3.0) + 0.5, 9) as x from samples, s""")
def x14_scaled_axis(spark: SparkSession, sf: str) -> DataFrame:
    s = M.samples(spark, sf)
    span = s.agg(F.min("coldate").alias("a"), F.max("coldate").alias("b"))
    return s.join(F.broadcast(span)).select("accession", F.round(X.date_to_scaled_axis("coldate", "a", "a", "b", F.lit(0.5)), 9).alias("x"))  # one row


@register(PRE + """select lineage, variant_key, arg_min(regexp_replace(name, '^[^/]+/(.+)/20[0-9]{2}$', '\\1'), row(coldate, accession, location, name)) as label, count(distinct country) as n_countries, count(distinct region) as n_regions from encoded group by 1, 2""")
def a11_variant_tables(spark: SparkSession, sf: str) -> DataFrame:
    t = A.variant_tables(encoded(spark, sf))
    return t.select("lineage", "variant_key", "label", F.size("countries").cast("long").alias("n_countries"), F.size("regions").cast("long").alias("n_regions"))


@register(PRE + "select lineage, arg_min(name, row(coldate, accession, name)) as label1, min(coldate) as first_date, max(coldate) as last_date from samples group by lineage", dates="first_date last_date")
def a12_first_label(spark: SparkSession, sf: str) -> DataFrame:
    return A.first_label(M.samples(spark, sf))


@register(PRE + ", t as (select lineage, min(coldate) as first_date, max(coldate) as last_date, avg(n_features) as x from encoded group by lineage) select lineage, round(x - datediff('day', first_date, last_date) / (3.154e10 / 8.64e7), 6) as x1, round(x, 6) as x2 from t")
def a14_tip_span(spark: SparkSession, sf: str) -> DataFrame:
    t = encoded(spark, sf).groupBy("lineage").agg(F.min("coldate").alias("first_date"), F.max("coldate").alias("last_date"), F.avg("n_features").alias("x"))
    return A.tip_span(t).select("lineage", F.round("x1", 6).alias("x1"), F.round("x2", 6).alias("x2"))


@register(PRE + ", e as (select lineage, max(price) as max_dist from samples where status = 'P' group by lineage) select lineage, min(coldate) as min_date, max(coldate) as max_date, any_value(max_dist) as max_dist from samples left join e using (lineage) group by lineage", dates="min_date max_date")
def a18_cluster_extents(spark: SparkSession, sf: str) -> DataFrame:
    s = M.samples(spark, sf)
    return A.cluster_extents(s.where("status = 'P'").select("lineage", F.col("price").alias("dist")), s)


@register(PRE + ", i as (select lineage, sum(price) as infections from samples where region <> 'ASIA' and lineage < '4' group by lineage) select lineage, count(*) as nsamples, round(any_value(coalesce(infections, -1.0)), 2) as infections from samples left join i using (lineage) group by lineage")
def a05_infections(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted infections come as an input table."""
    e = encoded(spark, sf)
    predicted = e.where("region != 'ASIA' and lineage < '4'").groupBy("lineage").agg(F.sum("price").alias("infections"))
    none = e.select("lineage", F.lit("").alias("mutation"), F.lit(0.0).alias("freq")).where("false")
    return A.lineage_stats(e, none, infections=predicted).select("lineage", "nsamples", F.round("infections", 2).alias("infections"))


_FREQ = ", sz as (select lineage, count(*) as t from samples group by lineage), freq as (select lineage, typ, pos, alt, count(*) as n, count(*) / any_value(t) as freq from samples join features using (accession) join sz using (lineage) group by lineage, typ, pos, alt)"


@register(PRE + _FREQ + ", p as (select lineage, sum(2 * freq * (1 - freq)) as s from freq group by lineage) select lineage, t as nvariants, round(s * t / (t - 1), 6) as pi from sz join p using (lineage)")
def a09_summary_pi(spark: SparkSession, sf: str) -> DataFrame:
    """The summary's diversity and its sample size."""
    s = M.samples(spark, sf)
    sizes = s.groupBy("lineage").agg(F.count("*").alias("n"))
    return A.diversity_table(A.feature_frequencies(s, M.features(spark, sf)), sizes).select("lineage", "nvariants", F.round("pi", 6).alias("pi"))


@register(PRE + _FREQ + " select lineage, 'aa:' || typ || ':' || pos as mutation, round(max(freq), 9) as frequency from freq where freq >= 0.05 group by 1, 2")
def io16_mutations_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """The mutation table as CSV and back."""
    import uuid

    path = f"{shared_folder(spark).rstrip('/')}/mutations-{uuid.uuid4().hex}"
    e = encoded(spark, sf)
    common = A.common_features(e, M.features(spark, sf), min_freq=0.05)
    io.export_mutations(A.lineage_stats(e, A.lineage_mutations(common, F.concat(F.lit("aa:"), "typ", F.lit(":"), F.col("pos").cast("string")))), path)
    back = spark.read.option("header", "true").schema("lineage string, mutation string, frequency double").csv(path)
    return back.withColumn("frequency", F.round("frequency", 9))


@register("select 'big' as reason, o_orderkey as accession from orders where o_totalprice > 200000")
def f08_reason_lists(spark: SparkSession, sf: str) -> DataFrame:
    o = M.table(spark, sf, "orders")
    return qc.reason_lists(o.select(F.col("o_orderkey").alias("accession"), F.when(F.col("o_totalprice") > 200_000, "big").alias("reason")))


@register("""with log as (select user_id as accession, max(event_id) as entry_id from events group by 1) select accession, c_name, row_number() over (order by entry_id desc) - 1 as nth from log join customer on accession = c_custkey""")
def a20_newest_first(spark: SparkSession, sf: str) -> DataFrame:
    """Accessions with their raw record, the newest entry first."""
    c = M.table(spark, sf, "customer").select(F.col("c_custkey").alias("accession"), "c_name")
    log = M.table(spark, sf, "events").groupBy(F.col("user_id").alias("accession")).agg(F.max("event_id").alias("entry_id"))
    return A.newest_first(log.join(c, "accession"), "entry_id").select("accession", "c_name", "nth")
