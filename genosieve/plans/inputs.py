"""Round trips through every reader and writer: a table is written in a format, read back and compared."""

from __future__ import annotations

import lzma
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from genosieve.operators import aggregates as A
from genosieve.plans import mapping as M
from genosieve.plans.filters import encoded
from genosieve.plans.registry import register
from genosieve.sources import io
from genosieve.sources.shared import shared_folder

PRE = M.PRELUDE


def _path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@register("select cast(doc_id as varchar) as accession, source as name, lang as lineage, replace(text, chr(10), '') as sequence from documents")
def io01_read_feed(spark: SparkSession, sf: str) -> DataFrame:
    path = _path(spark, "feed")
    d = M.table(spark, sf, "documents")
    d.select(F.col("doc_id").cast("string").alias("accession"), F.col("source").alias("name"), F.col("lang").alias("lineage"), F.col("text").alias("sequence"), F.lit("dropped").alias("other")).write.json(path)
    return io.read_feed(spark, path, ("accession", "name", "lineage", "sequence"))


@register("select cast(item_id as varchar) as accession, replace(text, chr(10), '') as sequence from benchmark")
def io01_read_feed_xz(spark: SparkSession, sf: str) -> DataFrame:
    """The same through xz files, which the tasks that hold the rows write."""
    import json

    import pyarrow.fs as pafs

    path = _path(spark, "feed-xz")
    uri = path if ":/" in path else "file://" + path

    def write(rows) -> None:
        fs, where = pafs.FileSystem.from_uri(uri)
        fs.create_dir(where, recursive=True)
        data = "".join(json.dumps({"accession": str(r.item_id), "sequence": r.text}) + "\n" for r in rows)
        if data:
            with fs.open_output_stream(f"{where}/{uuid.uuid4().hex}.xz", compression=None) as f:
                f.write(lzma.compress(data.encode()))

    M.table(spark, sf, "benchmark").select("item_id", "text").foreachPartition(write)
    return io.read_feed(spark, path, ("accession", "sequence"), compressed=True)


@register("select source || '_' || doc_id as header, upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) as sequence from documents where regexp_matches(text, '[A-Za-z]')")
def io02_fasta_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """IO02 and IO12: written with folded lines, read back."""
    path = _path(spark, "fasta")
    d = M.table(spark, sf, "documents").select(F.concat_ws(" ", "source", "doc_id").alias("h"), F.regexp_replace("text", "[^A-Za-z]", "").alias("s")).where("s != ''")
    io.write_fasta(d.withColumn("s", io.fold("s")), path, "h", "s")
    return io.read_fasta(spark, path)


@register("select cast(p_size - 1 as int) as pos, p_brand as ref, p_type as alt, p_name as info from part where p_partkey % 2 = 0")
def io03_read_mask(spark: SparkSession, sf: str) -> DataFrame:
    path = _path(spark, "mask")
    p = M.table(spark, sf, "part")
    row = F.concat_ws("\t", F.lit("chr"), "p_size", F.lit("."), F.regexp_replace("p_brand", "#", "~"), "p_type", F.lit("."), F.when(F.col("p_partkey") % 2 == 0, "mask").otherwise("caution"), "p_name")
    p.select(row).write.text(path)
    return io.read_mask(spark, path).withColumn("ref", F.regexp_replace("ref", "~", "#"))


@register("select c_name as taxon, c_mktsegment as lineage from customer where c_custkey % 7 > 0")
def io04_read_designations(spark: SparkSession, sf: str) -> DataFrame:
    path = _path(spark, "designations")
    c = M.table(spark, sf, "customer")
    spark.sql("select 'taxon,lineage' as value").write.text(path)
    c.select(F.when(F.col("c_custkey") % 7 > 0, F.concat_ws(",", "c_name", "c_mktsegment")).otherwise(F.col("c_name"))).write.mode("append").text(path)
    return io.read_designations(spark, path)[0]


@register("select n_name as prefix, case when n_nationkey % 2 = 0 then n_name || ',' || n_nationkey else 'B.' || n_nationkey end as parents from nation")
def io05_read_alias(spark: SparkSession, sf: str) -> DataFrame:
    path = _path(spark, "alias")
    n = M.table(spark, sf, "nation")
    value = F.when(F.col("n_nationkey") % 2 == 0, F.to_json(F.array("n_name", F.col("n_nationkey").cast("string")))).otherwise(F.concat(F.lit('"B.'), F.col("n_nationkey").cast("string"), F.lit('"')))
    entries = n.agg(F.concat(F.lit("{"), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), "n_name", F.lit('": '), value))), ", "), F.lit("}")))
    entries.write.text(path)
    return io.read_alias(spark, path).withColumn("parents", F.array_join("parents", ","))


@register('select cast(c_nationkey as varchar) as "index", string_agg(c_name, \',\' order by c_name) as names from customer group by c_nationkey')
def io06_read_labels(spark: SparkSession, sf: str) -> DataFrame:
    path = _path(spark, "labels")
    M.table(spark, sf, "customer").select(F.col("c_nationkey").alias("index"), F.col("c_name").alias("name")).write.option("header", "true").csv(path)
    return io.read_labels(spark, path).withColumn("names", F.array_join("names", ","))


@register(PRE + "select cast(accession as varchar) as accession, name as virus_name, cast(coldate as varchar) as collection_date, location, lineage, status as clade from samples")
def io07_read_metadata(spark: SparkSession, sf: str) -> DataFrame:
    path = _path(spark, "metadata")
    M.samples(spark, sf).select("accession", "name", "coldate", "location", "lineage", "status").write.option("sep", "\t").csv(path)
    return io.read_metadata(spark, path, "sample")


@register("select cast(p_partkey as varchar) as qname, cast(case when p_partkey % 5 = 0 then 16 else 0 end as int) as flag, 'ref' as rname, cast(p_size - 1 as int) as pos, p_size || 'M' as cigar, repeat('A', cast(p_size as int)) as seq from part where p_partkey % 7 > 1 and p_size >= 10")
def io08_read_sam(spark: SparkSession, sf: str) -> DataFrame:
    path = _path(spark, "sam")
    p = M.table(spark, sf, "part")
    k = F.col("p_partkey") % 7
    flag = F.when(F.col("p_partkey") % 5 == 0, 16).otherwise(0) + F.when(k == 1, 0x800).otherwise(0)
    row = F.concat_ws("\t", "p_partkey", flag, F.when(k == 0, "*").otherwise("ref"), "p_size", F.lit("60"), F.concat(F.col("p_size").cast("string"), F.lit("M")), F.lit("*"), F.lit("0"), F.lit("0"), F.expr("repeat('A', cast(p_size as int))"))
    spark.sql("select '@HD\tVN:1.6' as value").write.text(path)
    p.select(row).write.mode("append").text(path)
    return io.read_sam(spark, path, 10)


@register("select 'aa:S:N' || (p_size % 9 + 1) || 'Y' as mutation, string_agg(distinct p_type, ',' order by p_type) as effects from part group by 1")
def io10_read_annotations(spark: SparkSession, sf: str) -> DataFrame:
    path = _path(spark, "annotations")
    p = M.table(spark, sf, "part").select(F.concat(F.lit("> "), "p_type", F.lit("\naa:S:N"), (F.col("p_size") % 9 + 1).cast("string"), F.lit("Y")))
    p.write.text(path)
    return io.read_annotations(spark, path).withColumn("effects", F.array_join("effects", ","))


@register(PRE + "select lineage, status as variant, cast(coldate as varchar) as coldate, cast(accession as varchar) as accession, location, name from samples")
def io11_clusters_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    """IO14 and IO11: clusters as JSON lines and back."""
    path = _path(spark, "clusters")
    s = M.samples(spark, sf).select("lineage", F.col("status").alias("variant"), F.col("coldate").cast("string").alias("coldate"), F.col("accession").cast("string").alias("accession"), "location", "name")
    edges = s.select("lineage", F.lit(0).alias("pos"), F.lit("F").alias("parent"), F.lit("O").alias("child"), F.lit(1.0).alias("dist"), F.lit(0.5).alias("support")).distinct()
    io.write_clusters(s, edges, path)
    return io.read_clusters(spark, path)[0]


@register(PRE + "select lineage, count(*) as nsamples, max(n_features) as max_ndiffs from encoded group by lineage")
def io15_stats_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = _path(spark, "stats")
    e = encoded(spark, sf)
    freq = A.feature_frequencies(e, M.features(spark, sf))
    io.write_stats(A.lineage_stats(e, A.lineage_mutations(freq, F.concat("typ", F.col("pos").cast("string")))), path)
    return spark.read.schema("lineage string, nsamples bigint, max_ndiffs bigint").json(path)


@register("select c_name as lineage, round(c_acctbal, 1) as frequency from customer")
def io16_export_csv(spark: SparkSession, sf: str) -> DataFrame:
    path = _path(spark, "csv")
    io.export_csv(M.table(spark, sf, "customer").select(F.col("c_name").alias("lineage"), F.col("c_acctbal").alias("frequency")), path, 1)
    return spark.read.schema("lineage string, frequency double").option("header", "true").csv(path)


@register("select c_custkey, cast(c_nationkey as int) as cid from customer where c_nationkey = 3")
def io17_write_serving(spark: SparkSession, sf: str) -> DataFrame:
    """Stored by cluster; a read of one cluster reads one partition."""
    path = _path(spark, "serving")
    io.write_serving({"points": M.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("cid")), "regions": M.table(spark, sf, "region")}, path, "v1")
    return spark.read.schema("c_custkey bigint, cid int").parquet(f"{path}/v1/points").where("cid = 3")
