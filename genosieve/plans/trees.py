"""Queries over distances and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from genosieve.operators import aggregates as A, chain as C, trees as T
from genosieve.plans import mapping as M
from genosieve.plans.filters import encoded
from genosieve.plans.registry import register

PRE = M.PRELUDE
LIMIT, REPLICATES = 5000, 100  # the reference's values


def dictionary(spark: SparkSession, sf: str, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """(variant features long: lineage, variant_no, feature_no; feature dictionary)."""
    return C.dictionary(encoded(spark, sf), limit)


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as five trees with an arithmetic parent."""
    c = M.table(spark, sf, "customer").select((F.col("c_custkey") % 5).alias("tree"), F.floor(F.col("c_custkey") / 5).cast("long").alias("node_id"), "c_name", "c_acctbal", "c_nationkey")
    size = c.groupBy("tree").agg(F.count("*").alias("n"))
    is_tip = F.col("node_id") * 3 + 1 >= F.col("n")
    return c.join(F.broadcast(size), "tree").select(  # five rows
        "tree", "node_id", F.when(F.col("node_id") > 0, F.floor((F.col("node_id") - 1) / 3).cast("long")).alias("parent_id"), F.when(is_tip | (F.col("node_id") % 4 == 0), F.col("c_name")).alias("name"),
        F.when(F.col("node_id") > 0, F.col("c_nationkey") / 10).alias("length"), is_tip.alias("is_tip"), (F.col("c_nationkey") / 25).alias("support"),
    )


def dates(spark: SparkSession, sf: str) -> DataFrame:
    c = M.table(spark, sf, "customer")
    return c.select((F.col("c_custkey") % 5).alias("tree"), F.floor(F.col("c_custkey") / 5).cast("long").alias("node_id"), F.date_add(F.lit("2020-01-01").cast("date"), F.col("c_nationkey") * 10).alias("date"))


NODES = """with recursive c as (select c_custkey % 5 as tree, c_custkey // 5 as node_id, c_name, c_acctbal, c_nationkey from customer), sz as (select tree, count(*) as n from c group by tree),
nodes as (select tree, node_id, case when node_id > 0 then (node_id - 1) // 3 end as parent_id, case when node_id * 3 + 1 >= n or node_id % 4 = 0 then c_name end as name, case when node_id > 0 then c_nationkey / 10 end as length, node_id * 3 + 1 >= n as is_tip, c_nationkey / 25 as support from c join sz using (tree)),
dates as (select c_custkey % 5 as tree, c_custkey // 5 as node_id, date '2020-01-01' + c_nationkey * 10 as date from customer),
anc as (select tree, node_id, node_id as anc, 0 as hops, 0.0::double as dist from nodes union all select a.tree, a.node_id, n.parent_id, a.hops + 1, a.dist + n.length from anc a join nodes n on n.tree = a.tree and n.node_id = a.anc where n.parent_id is not null)
"""
_LONG = PRE + """, num as (select *, row_number() over (partition by lineage order by last_date desc, variant_key desc) - 1 as variant_no from variants),
long as (select lineage, variant_no, unnest(string_split(variant_key, ',')) as feature from num where variant_no < 5000 and variant_key <> '')"""  # LIMIT


@register()
def t01_bootstrap_weights(spark: SparkSession, sf: str) -> DataFrame:
    return T.bootstrap_weights(dictionary(spark, sf)[1], REPLICATES)


_DISTANCE = _LONG + """, w as (select lineage, variant_no, count(*) as w from long group by 1, 2), s as (select a.lineage, a.variant_no as i, b.variant_no as j, count(*) as s from long a join long b on a.lineage = b.lineage and a.feature = b.feature and a.variant_no < b.variant_no group by 1, 2, 3)
select a.lineage, a.variant_no as i, b.variant_no as j, a.w + b.w - 2 * coalesce(s, 0) as dist from w a join w b on a.lineage = b.lineage and a.variant_no < b.variant_no left join s on s.lineage = a.lineage and s.i = a.variant_no and s.j = b.variant_no"""


def families(spark: SparkSession, sf: str) -> DataFrame:
    """Samples with one customer's orders as a lineage: many groups of bounded size, as pairs and trees ask for."""
    return encoded(spark, sf).withColumn("lineage", F.substring_index("name", "#", -1))


def family_dictionary(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return C.dictionary(families(spark, sf), LIMIT)


_FAMILY_DISTANCE = _DISTANCE.replace("from variants)", "from (select split_part(name, '#', 2) as lineage, variant_key, max(coldate) as last_date from encoded group by 1, 2))", 1)


@register(_FAMILY_DISTANCE)
def t02_pairwise_distance(spark: SparkSession, sf: str) -> DataFrame:
    return T.pairwise_distance(family_dictionary(spark, sf)[0])


def family_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Variants of every family, numbered: (lineage, variant_no, variant_key, …)."""
    return A.number_variants(A.variants(families(spark, sf)), LIMIT)


@register()
def t03_nj_trees(spark: SparkSession, sf: str) -> DataFrame:
    return C.bootstrap_trees(family_variants(spark, sf), REPLICATES)


@register(NODES + "select a.tree, a.anc as node_id, count(*) as n_tips, md5(string_agg(t.name, ',' order by t.name)) as tips from anc a join nodes t on t.tree = a.tree and t.node_id = a.node_id and t.is_tip where hops > 0 group by 1, 2")
def t04_clades(spark: SparkSession, sf: str) -> DataFrame:
    return T.clades(nodes(spark, sf)).select("tree", "node_id", F.size("tips").cast("long").alias("n_tips"), F.md5(F.array_join("tips", ",").cast("binary")).alias("tips"))


@register()
def t05_consensus(spark: SparkSession, sf: str) -> DataFrame:
    return C.consensus_trees(family_variants(spark, sf), REPLICATES)


@register("""with tips as (select n_nationkey as k, n_name as name from nation), trees as (select unnest(range(4)) as tree), splits as (select tree, (k + (case when tree = 3 then 1 else 0 end)) // 5 as part, string_agg(name, ',' order by name) as key, count(*) as size from tips, trees group by 1, 2),
kept as (select key, count(*) / 4 as support, any_value(size) as size from splits group by key having count(*) / 4 >= 0.5) select key, support, size from kept union all select name, null, 1 from tips""")
def t05_consensus_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Four trees over nations, three of which agree."""
    t = M.table(spark, sf, "nation").select(F.explode(F.sequence(F.lit(0), F.lit(3))).alias("tree"), F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"), F.lit("g").alias("group"))
    part = F.floor((F.col("k") + F.when(F.col("tree") == 3, 1).otherwise(0)) / 5)
    splits = t.groupBy("group", "tree", part.alias("part")).agg(F.array_sort(F.collect_list("name")).alias("tips")).withColumn("length", F.lit(1.0))
    found = T.consensus(splits, t.select("group", "tree", "name", F.lit(1.0).alias("length")), t.groupBy("group").agg(F.count_distinct("tree").alias("n")))
    return found.select("key", "support", F.col("size").cast("long").alias("size"))


_CONTRACT = NODES + """, f as (select *, coalesce(length <= 0.5, false) and parent_id is not null as short from nodes), k as (select tree, parent_id as node_id, count(*) as kids from f where not (is_tip and short) and parent_id is not null group by 1, 2),
g as (select f.*, coalesce(kids, 0) as kids, case when is_tip then not short else not short or coalesce(kids, 0) = 0 end as stays from f left join k using (tree, node_id)),
tg as (select a.tree, a.node_id, arg_min(a.anc, a.hops) as target from anc a join g on g.tree = a.tree and g.node_id = a.anc and g.stays where hops > 0 group by 1, 2),
more as (select tree, target as node_id, string_agg(name, '|' order by node_id) as more from g join tg using (tree, node_id) where not stays and name is not null group by 1, 2)
select tree, node_id, target as parent_id, case when name is null then more when more is null then name else name || '|' || more end as name, length, is_tip or kids = 0 as is_tip from g left join tg using (tree, node_id) left join more using (tree, node_id) where stays"""


@register(_CONTRACT)
def t06_contract(spark: SparkSession, sf: str) -> DataFrame:
    return T.contract(nodes(spark, sf))


@register(NODES + ", lab as (select tree, c_name as name, 1 + node_id % 3 as n from c) select nodes.tree, node_id, coalesce(n, 0) as n_labels, name is null as unsampled from nodes left join lab using (tree, name)")
def t07_annotate(spark: SparkSession, sf: str) -> DataFrame:
    c = M.table(spark, sf, "customer")
    labels = c.select((F.col("c_custkey") % 5).alias("tree"), F.col("c_name").alias("name"), F.explode(F.sequence(F.lit(0), F.floor(F.col("c_custkey") / 5) % 3)).alias("k"))
    return T.annotate(nodes(spark, sf), labels)


@register(NODES + ", d as (select tree, node_id, max(hops) as depth from anc group by 1, 2) select n.tree, row_number() over (partition by n.tree order by depth, n.node_id) - 1 as pos, p.name as parent, n.name as child, round(n.length, 2) as dist, depth from nodes n join nodes p on p.tree = n.tree and p.node_id = n.parent_id join d on d.tree = n.tree and d.node_id = n.node_id")
def t08_bead_edges(spark: SparkSession, sf: str) -> DataFrame:
    return T.bead_edges(nodes(spark, sf))


@register(PRE + ", one as (select name, status, max(variant_key) as variant_key, count(*) as n_samples from encoded group by 1, 2 having count(distinct variant_key) = 1) select name, status, variant_key, n_samples, 0 as n_edges, 0.0 as infections from one")
def t09_single_variant(spark: SparkSession, sf: str) -> DataFrame:
    return T.single_variant(encoded(spark, sf), ["name", "status"])


@register("select c_custkey, c_name || ':1.5[&date=2020.5]' as cleaned, replace(c_name, '#', '') || '=2020.5' as dated from customer")
def t10_clean_nexus(spark: SparkSession, sf: str) -> DataFrame:
    c = M.table(spark, sf, "customer")
    raw = F.concat(F.lit("[&U] "), F.col("c_name"), F.lit(':[&mutations="A1T"]1.5[&date=2020.5]'))
    cleaned = T.clean_nexus(raw)
    return c.select("c_custkey", cleaned.alias("cleaned"), F.array_join(T.node_dates(F.regexp_replace(cleaned, "#", "")), ",").alias("dated"))


@register(NODES + """, s as (select * from nodes where is_tip or parent_id is null or support >= 0.5), u as (select a.tree, a.node_id, arg_min(a.anc, a.hops) as anc, arg_min(a.dist, a.hops) as dist from anc a join s on s.tree = a.tree and s.node_id = a.anc where hops > 0 group by 1, 2)
select s.tree, s.node_id, u.anc as parent_id, s.name, s.support, round(u.dist, 6) as length, s.is_tip from s left join u using (tree, node_id)""")
def t11_collapse_low_support(spark: SparkSession, sf: str) -> DataFrame:
    return T.collapse_low_support(nodes(spark, sf)).withColumn("length", F.round("length", 6))


@register(NODES + "select n.tree, n.node_id, n.parent_id, n.name, p.name as parent_label, coalesce(string_agg(cast(k.node_id as varchar), ',' order by k.node_id), '') as children, coalesce(any_value(n.length), 0.0) as length, n.is_tip from nodes n left join nodes p on p.tree = n.tree and p.node_id = n.parent_id left join nodes k on k.tree = n.tree and k.parent_id = n.node_id group by n.tree, n.node_id, n.parent_id, n.name, p.name, n.is_tip")
def t12_tree_table(spark: SparkSession, sf: str) -> DataFrame:
    return T.tree_table(nodes(spark, sf)).withColumn("children", F.array_join(F.col("children").cast("array<string>"), ","))


_LAYOUT = NODES + """, kid as (select tree, parent_id as node_id, count(*) as kids from nodes where parent_id is not null group by 1, 2), path as (select tree, node_id, list(anc order by hops desc) as path, max(dist) as x from anc group by 1, 2),
tips as (select tree, node_id, row_number() over (partition by tree order by path) - 1 as ty from path join nodes using (tree, node_id) where is_tip),
sh as (select tree, node_id, node_id as anc, 1.0::double as share from nodes where is_tip union all select s.tree, s.node_id, n.parent_id, s.share / k.kids from sh s join nodes n on n.tree = s.tree and n.node_id = s.anc join kid k on k.tree = n.tree and k.node_id = n.parent_id)
select p.tree, p.node_id, round(x, 6) as x, round(y, 6) as y from path p join (select sh.tree, sh.anc as node_id, sum(share * ty) as y from sh join tips using (tree, node_id) group by 1, 2) using (tree, node_id)"""


@register(_LAYOUT)
def t13_rect_layout(spark: SparkSession, sf: str) -> DataFrame:
    return T.rect_layout(nodes(spark, sf)).withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})


@register(NODES + """, good as (select n.tree, n.node_id from nodes n join dates using (tree, node_id) where is_tip and date >= date '2020-07-01'), live as (select distinct a.tree, a.anc as node_id from anc a join good using (tree, node_id)),
al as (select nodes.* from nodes join live using (tree, node_id)), kd as (select tree, parent_id as node_id, count(*) as kids from al group by 1, 2), kept as (select al.* from al left join kd using (tree, node_id) where is_tip or kids > 1),
u as (select a.tree, a.node_id, arg_min(a.anc, hops) as anc, arg_min(a.dist, hops) as dist from anc a join kept on kept.tree = a.tree and kept.node_id = a.anc where hops > 0 group by 1, 2)
select k.tree, k.node_id, u.anc as parent_id, k.name, round(u.dist, 6) as length, k.is_tip from kept k left join u using (tree, node_id)""")
def t14_prune_before(spark: SparkSession, sf: str) -> DataFrame:
    return T.prune_before(nodes(spark, sf), dates(spark, sf), F.lit("2020-07-01").cast("date")).withColumn("length", F.round("length", 6))


@register(NODES + "select tree, node_id, parent_id, name, round(length, 6) as length, is_tip from nodes")
def io13_newick_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """Trees are written as Newick and read back; node numbers are the written ones again, carried in the labels."""
    n = nodes(spark, sf)
    labelled = n.select("tree", "node_id", "parent_id", F.concat_ws("@", F.coalesce("name", F.lit("")), "node_id").alias("name"), "length", "is_tip")
    back = T.read_newick(T.to_newick(labelled))
    own = back.withColumns({"k": F.substring_index("name", "@", -1).cast("long"), "label": F.substring_index("name", "@", 1)})
    p = own.select("tree", F.col("node_id").alias("parent_id"), F.col("k").alias("pk"))
    return own.join(p, ["tree", "parent_id"], "left").select("tree", F.col("k").alias("node_id"), F.col("pk").alias("parent_id"), F.when(F.col("label") != "", F.col("label")).alias("name"), F.round("length", 6).alias("length"), "is_tip")


@register(NODES + """, r as (select n.tree, n.node_id, row_number() over (partition by n.tree, parent_id order by n.node_id % 7, date, n.node_id) as rank from nodes n join dates using (tree, node_id)),
path as (select a.tree, a.node_id, list(rank order by hops desc) as path from anc a join r on r.tree = a.tree and r.node_id = a.anc group by 1, 2) select tree, node_id, row_number() over (partition by tree order by path) - 1 as pos from path""")
def w11_reorder_edges(spark: SparkSession, sf: str) -> DataFrame:
    spans = dates(spark, sf).select("tree", "node_id", (F.col("node_id") % 7).alias("span"), F.col("date").alias("first_date"))
    return T.reorder_edges(nodes(spark, sf), spans)


@register(NODES + ", x as (select tree, node_id, max_by(dist, hops) as d from anc group by 1, 2), t as (select tree, d, datediff('day', date '1970-01-01', date)::double as t from nodes join x using (tree, node_id) join dates using (tree, node_id) where is_tip) select tree, count(*) as n, round(regr_slope(d, t), 9) as slope, round(regr_intercept(d, t), 5) as intercept from t group by tree")
def n02_root_to_tip_fit(spark: SparkSession, sf: str) -> DataFrame:
    return T.root_to_tip_fit(nodes(spark, sf), dates(spark, sf)).withColumns({"slope": F.round("slope", 9), "intercept": F.round("intercept", 5)})


@register(NODES + """, t as (select tree, node_id, datediff('day', date '1970-01-01', date) as t from nodes join dates using (tree, node_id) where is_tip), e as (select tree, quantile_cont(t, 0.8) as e from t group by tree), r as (select tree, node_id from t join e using (tree) where t.t > e.e),
u as (select anc.* from anc join r using (tree, node_id)), p as (select a.tree, a.node_id as i, b.node_id as j, arg_min(a.dist + b.dist, a.hops) as d from u a join u b on a.tree = b.tree and a.anc = b.anc and a.node_id < b.node_id group by 1, 2, 3)
select tree, cast(floor(round(d, 6) + 0.01) as bigint) as bin, count(*) as n from p group by 1, 2""")
def n03_recent_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Lengths are tenths, so a small shift keeps whole numbers in their bin in both engines."""
    n = nodes(spark, sf).withColumn("length", F.col("length") + F.when(F.col("is_tip"), 0.005).otherwise(0.0))
    return T.recent_distances(n, dates(spark, sf), 0.8, 1.0)


_DIFFERENCE = _LONG + ", f as (select lineage, variant_no, list(feature) as f from long group by 1, 2) select a.lineage, a.variant_no as i, b.variant_no as j, len(a.f) + len(b.f) - 2 * len(list_intersect(a.f, b.f)) as d from f a join f b on a.lineage = b.lineage and b.variant_no = a.variant_no + 1"


@register(_DIFFERENCE)
def s02_symmetric_difference(spark: SparkSession, sf: str) -> DataFrame:
    return neighbour_differences(spark, sf, LIMIT)


def neighbour_differences(spark: SparkSession, sf: str, limit: int) -> DataFrame:
    from genosieve.functions import expressions as X

    f = dictionary(spark, sf, limit)[0].groupBy("lineage", "variant_no").agg(F.collect_list("feature_no").alias("f"))
    b = f.select("lineage", (F.col("variant_no") - 1).alias("variant_no"), F.col("f").alias("g"), F.col("variant_no").alias("j"))
    return f.join(b, ["lineage", "variant_no"]).select("lineage", F.col("variant_no").alias("i"), "j", X.symmetric_difference("f", "g").cast("long").alias("d"))
