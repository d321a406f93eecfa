"""Queries over column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from genosieve.functions import expressions as X
from genosieve.operators import features as O
from genosieve.plans import mapping as M
from genosieve.plans.filters import encoded
from genosieve.plans.registry import register

PRE = M.PRELUDE


@register("""with f as (select doc_id, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) as ref from documents), g as (select *, length(ref) // 40 as p from f)
select doc_id, case when p > 0 then repeat('N', 3 * p) || substr(ref, 3 * p + 1, 2 * p) || 'T' || substr(ref, 5 * p + 2, 5 * p - 1) || repeat('-', 3 * p) || substr(ref, 13 * p + 1) else ref end as seq from g""")
def x03_apply_features(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's whole letters are a reference; differences lie at fortieths of its length, none in short ones."""
    ref = F.upper(F.regexp_replace("text", "[^A-Za-z]", ""))
    d = M.table(spark, sf, "documents").select("doc_id", ref.alias("ref"), F.floor(F.length(ref) / 40).cast("int").alias("p"))

    def diff(typ: str, pos: F.Column, alt: F.Column) -> F.Column:
        return F.struct(F.lit(typ).alias("typ"), pos.alias("pos"), alt.alias("alt"))

    p = F.col("p")
    diffs = F.array(diff("~", 5 * p, F.lit("T")), diff("-", 10 * p, (3 * p).cast("string")), diff("+", 20 * p, F.lit("AA")))
    missing = F.array(F.struct(F.lit(0).alias("left"), (3 * p).alias("right")))
    return d.select("doc_id", F.when(p > 0, X.apply_features(diffs, missing, "ref")).otherwise(F.col("ref")).alias("seq"))


@register(PRE + "select accession, variant_key, n_features from keys")
def x04_variant_key(spark: SparkSession, sf: str) -> DataFrame:
    """Keys are made, parsed and made again."""
    e = encoded(spark, sf).where("n_features > 0").select("accession", X.parse_key("variant_key").alias("f"))
    return e.select("accession", X.variant_key("f").alias("variant_key"), F.size("f").cast("long").alias("n_features"))


@register("""with orfs(ord, orf, l, r) as (values (1, 'one', 0, 15), (2, 'two', 9, 30), (3, 'three', 30, 45)), f as (select distinct l_orderkey as accession, case l_returnflag when 'A' then '~' when 'N' then '+' else '-' end as typ, cast(l_quantity as int) as pos, l_linenumber as n from lineitem),
g as (select accession, typ, pos, n, case typ when '~' then substr('ACGTACG', n, 1) when '+' then repeat('A', n) else cast(n as varchar) end as alt from f),
h as (select g.*, o.orf, o.l, o.ord, row_number() over (partition by accession, typ, pos, n order by o.ord) as rn from g left join orfs o on g.typ = '~' and g.pos >= o.l and g.pos < o.r),
c as (select *, substr('ATGGCTTAACCGATTGGCACGTTAGCCATGACCGGTATCGAATTCCGGA', l + 3 * ((pos - l) // 3) + 1, 3) as codon, (pos - l) % 3 as o3, (pos - l) // 3 + 1 as codon_no from h where rn = 1),
d as (select *, case when orf is not null then substr(codon, 1, cast(o3 as bigint)) || alt || substr(codon, cast(o3 as bigint) + 2) end as mut from c), t(k, a) as (CODONS)
select distinct accession, typ, pos, alt, case when typ = '+' then 'ins:' || (pos + 1) || ':' || length(alt) when typ = '-' then 'del:' || (pos + 1) || ':' || alt when t1.a <> t2.a then 'aa:' || orf || ':' || t1.a || codon_no || t2.a end as name
from d left join t t1 on t1.k = codon left join t t2 on t2.k = mut""".replace("CODONS", "values " + ", ".join(f"('{k}', '{a}')" for k, a in X.codon_table())))
def x05_annotate_features(spark: SparkSession, sf: str) -> DataFrame:
    l = M.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("accession"), F.when(F.col("l_returnflag") == "A", "~").when(F.col("l_returnflag") == "N", "+").otherwise("-").alias("typ"), F.col("l_quantity").cast("int").alias("pos"), F.col("l_linenumber").alias("n")).distinct()
    alt = F.when(F.col("typ") == "~", F.expr("substr('ACGTACG', n, 1)")).when(F.col("typ") == "+", F.expr("repeat('A', n)")).otherwise(F.col("n").cast("string"))
    orfs = spark.sql("select * from values (1, 'one', 0, 15), (2, 'two', 9, 30), (3, 'three', 30, 45) t(ord, orf, l, r)")
    return O.annotate(l.withColumn("alt", alt).drop("n"), orfs, O.codons(spark), "ATGGCTTAACCGATTGGCACGTTAGCCATGACCGGTATCGAATTCCGGA")


@register(PRE + "select accession, concat_ws('|', name, location, cast(accession as varchar), cast(coldate as varchar)) as label from samples")
def x06_sample_label(spark: SparkSession, sf: str) -> DataFrame:
    return M.samples(spark, sf).select("accession", X.sample_label("name", "location", F.col("accession").cast("string"), F.col("coldate").cast("string")).alias("label"))


@register(PRE + "select accession, round(year(coldate) + (dayofyear(coldate) - 1) / 365.25, 9) as yf from samples")
def x07_year_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return M.samples(spark, sf).select("accession", F.round(X.year_fraction("coldate"), 9).alias("yf"))


@register("select event_id, cast(try_strptime(cast(2000 + event_id % 30 as varchar) || '-' || cast(event_id % 14 as varchar) || '-' || cast(event_id % 32 as varchar), '%Y-%m-%d') as date) as d from events", dates="d")
def x08_parse_iso(spark: SparkSession, sf: str) -> DataFrame:
    e = M.table(spark, sf, "events")
    return e.select("event_id", X.parse_iso(F.concat_ws("-", 2000 + F.col("event_id") % 30, F.col("event_id") % 14, F.col("event_id") % 32)).alias("d"))


@register("select doc_id, lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) as k from documents")
def x09_normalize_key(spark: SparkSession, sf: str) -> DataFrame:
    return M.table(spark, sf, "documents").select("doc_id", X.normalize_key("text").alias("k"))


@register("select p_partkey, case when p_size % 3 = 0 then 'XBB Lineages' when p_size % 3 = 1 then 'Other Recombinants' else 'Non-Recombinants' end as class from part")
def x10_display_class(spark: SparkSession, sf: str) -> DataFrame:
    p = M.table(spark, sf, "part")
    raw = F.concat(F.when(F.col("p_size") % 3 == 0, "XBB.").when(F.col("p_size") % 3 == 1, "XA.").otherwise("B."), F.col("p_size").cast("string"))
    return p.select("p_partkey", X.display_class(raw).alias("class"))


@register("select c_custkey, r_name || '.' || c_custkey as resolved from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey")
def x11_resolve_alias(spark: SparkSession, sf: str) -> DataFrame:
    n, r = M.table(spark, sf, "nation"), M.table(spark, sf, "region")
    alias = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("prefix"), F.col("r_name").alias("full_name"))
    c = M.table(spark, sf, "customer")
    named = c.join(n, c.c_nationkey == n.n_nationkey).select("c_custkey", F.concat_ws(".", "n_name", "c_custkey").alias("lineage"))
    return O.resolve_alias(named, alias).select("c_custkey", "resolved")


@register(PRE + "select accession, country || '/' || name as label from samples")
def x12_short_label(spark: SparkSession, sf: str) -> DataFrame:
    s = M.samples(spark, sf)
    return s.select("accession", X.short_label(F.concat_ws("/", F.lit("hCoV-19"), "country", "name", F.lit("2021"))).alias("label"))


@register(PRE + "select accession, region, country from samples")
def x13_split_location(spark: SparkSession, sf: str) -> DataFrame:
    region, country = X.split_location("location")
    return M.samples(spark, sf).select("accession", region.alias("region"), country.alias("country"))


@register(PRE + "select accession, round(datediff('day', (select min(coldate) from samples), coldate) / 365.25, 9) as x, coldate as d from samples", dates="d")
def x14_date_axis(spark: SparkSession, sf: str) -> DataFrame:
    s = M.samples(spark, sf)
    low = s.agg(F.min("coldate").alias("low"))
    x = X.date_to_axis(F.col("coldate"), F.col("low"))
    return s.join(F.broadcast(low)).select("accession", F.round(x, 9).alias("x"), X.axis_to_date(x, F.col("low")).alias("d"))


@register("""with s as (select p_partkey, cast(p_size as varchar) || 'M' || (p_size % 4 + 1) || 'D' || '3I5M' as cigar, p_size + 8 as qlen, p_size % 7 as pos, p_size from part)
select p_partkey, repeat('-', pos) || repeat('A', p_size) || repeat('-', p_size % 4 + 1) || repeat('A', 5) || repeat('-', 100 - pos - p_size - (p_size % 4 + 1) - 5) as aligned from s""")
def x01_cigar_align(spark: SparkSession, sf: str) -> DataFrame:
    return O.cigar_align(_sam(spark, sf), 100).select(F.col("qname").cast("long").alias("p_partkey"), "aligned")


def _sam(spark: SparkSession, sf: str) -> DataFrame:
    p = M.table(spark, sf, "part")
    cigar = F.concat(F.col("p_size").cast("string"), F.lit("M"), (F.col("p_size") % 4 + 1).cast("string"), F.lit("D3I5M"))
    return p.select(F.col("p_partkey").cast("string").alias("qname"), (F.col("p_size") % 7).cast("int").alias("pos"), cigar.alias("cigar"), F.expr("repeat('A', cast(p_size as int) + 8)").alias("seq"))


@register("""with s as (select p_partkey as accession, cast(p_size as int) as k, cast(p_size % 7 as int) as pos from part)
select cast(accession as varchar) as qname, '-' as typ, pos + k as pos, cast(k % 4 + 1 as varchar) as alt from s union all select cast(accession as varchar), '+', pos + k + k % 4 + 1, 'AAA' from s""")
def x02_cigar_features(spark: SparkSession, sf: str) -> DataFrame:
    return O.cigar_features(_sam(spark, sf), 100)[0]
