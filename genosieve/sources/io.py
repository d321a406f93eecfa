"""Readers and writers of feeds, sequences, side tables and results. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from genosieve.sources.xz import FeedSource

FEED = ("accession", "name", "lineage", "collection_date", "location", "sequence")


def _strings(fields: tuple[str, ...]) -> str:
    return ", ".join(f"`{f}` string" for f in fields)


def read_feed(spark: SparkSession, path: str, fields: tuple[str, ...] = FEED, compressed: bool = False) -> DataFrame:
    """Newline-JSON; only the given fields are read; line breaks in the sequence go."""
    if compressed:
        spark.dataSource.register(FeedSource)
        df = spark.read.format("xzjson").schema(_strings(fields)).load(path)
    else:
        df = spark.read.schema(_strings(fields)).json(path)
    return df.withColumn("sequence", F.regexp_replace("sequence", "\n", "")) if "sequence" in fields else df


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(header, sequence): records split at ``>``, folded lines joined and upper-cased."""
    raw = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    return raw.select(F.trim(F.substring_index("value", "\n", 1)).alias("header"), F.upper(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*", ""), r"\s", "")).alias("sequence"))


def write_fasta(df: DataFrame, path: str, header: str, sequence: str) -> None:
    df.select(F.concat(F.lit(">"), F.regexp_replace(header, " ", "_"), F.lit("\n"), F.col(sequence))).write.text(path)


def read_mask(spark: SparkSession, path: str) -> DataFrame:
    """(pos from 0, ref, alt, info) of the rows whose filter is ``mask`` in a tab-separated variant file."""
    t = spark.read.schema("chrom string, pos int, id string, ref string, alt string, qual string, filter string, info string").csv(path, sep="\t", comment="#")
    return t.where("filter = 'mask'").select((F.col("pos") - 1).alias("pos"), "ref", "alt", "info")


def read_designations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(taxon, lineage) with the last row of a repeated taxon, and the malformed rows. A wrong header fails.

    Files are a few text files; a row's place is its file and its offset in it.
    """
    lines = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("line"))
    header = lines.where("value = 'taxon,lineage'")
    if header.isEmpty():
        raise ValueError("the header must be taxon,lineage")
    parts = lines.where("value != 'taxon,lineage'").withColumn("p", F.split("value", ","))
    good = (F.size("p") == 2) & (F.trim(F.get("p", F.lit(0))) != "") & (F.trim(F.get("p", F.lit(1))) != "")
    kept = parts.where(good).select(F.get("p", F.lit(0)).alias("taxon"), F.get("p", F.lit(1)).alias("lineage"), "line")
    return kept.groupBy("taxon").agg(F.max_by("lineage", "line").alias("lineage")), parts.where(~good).select("value")


def read_alias(spark: SparkSession, path: str) -> DataFrame:
    """(prefix, parents): a JSON object of names or lists of names; empty names are kept."""
    text = spark.read.option("wholetext", "true").text(path)
    pairs = text.select(F.explode(F.from_json("value", "map<string,string>")).alias("prefix", "v"))
    is_list = F.col("v").startswith("[")
    return pairs.select("prefix", F.when(is_list, F.from_json("v", "array<string>")).otherwise(F.array("v")).alias("parents"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(index, names) of a CSV with the columns name and index in any order; another header is an error."""
    t = spark.read.option("header", "true").option("mode", "FAILFAST").csv(path)
    if set(t.columns) != {"name", "index"}:
        raise ValueError("the columns must be name and index")
    return t.groupBy("index").agg(F.array_sort(F.collect_list("name")).alias("names"))


def read_metadata(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Positional tab-separated tables."""
    schemas = {
        "sample": "accession string, virus_name string, collection_date string, location string, lineage string, clade string",
        "sequencing": "accession string, platform string, assembly string",
        "patient": "accession string, gender string, age int, status string",
        "acknowledgement": "accession string, originating string, submitting string, authors string",
        "lineage": "accession string, lineage string, probability double, version date, status string, note string",
    }
    return spark.read.schema(schemas[kind]).csv(path, sep="\t")


def read_sam(spark: SparkSession, path: str, min_length: int = 0) -> DataFrame:
    """(qname, flag, rname, pos from 0, cigar, seq) of mapped primary alignments that are long enough."""
    p = spark.read.text(path).where(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("p"))
    t = p.select(F.get("p", F.lit(0)).alias("qname"), F.get("p", F.lit(1)).cast("int").alias("flag"), F.get("p", F.lit(2)).alias("rname"), (F.get("p", F.lit(3)).cast("int") - 1).alias("pos"), F.get("p", F.lit(5)).alias("cigar"), F.get("p", F.lit(9)).alias("seq"))
    return t.where((F.col("rname") != "*") & (F.col("flag").bitwiseAND(F.lit(0x800)) == 0) & F.col("cigar").rlike(r"^(\d+[MIDNSHP=X])+$") & (F.length("seq") >= min_length))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(mutation, effects) from text files of constellations: a line ``> effect`` and below it lines of mutations."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
    w = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)  # files are short
    t = lines.withColumn("effect", F.last(F.when(F.col("value").startswith(">"), F.trim(F.expr("substring(value, 2)"))), ignorenulls=True).over(w))
    m = t.where(~F.col("value").startswith(">")).select("effect", F.explode(F.regexp_extract_all("value", F.lit(r"(aa:[^:\s]+:[A-Z]?\d+[A-Z*-])"), F.lit(1))).alias("mutation"))
    return m.groupBy("mutation").agg(F.array_sort(F.collect_set("effect")).alias("effects"))


def write_clusters(samples: DataFrame, edges: DataFrame, path: str, group: str = "lineage") -> None:
    """JSON lines of nodes by variant and of edges. A group spreads over as many lines as it has samples and edges, so no
    row grows with it; edges of groups without samples are left out. Order is in the dates and positions."""
    s = F.array(F.struct("coldate", "accession", "location", "name"))
    n = samples.select(F.to_json(F.struct(F.col(group).alias("lineage"), F.create_map(F.col("variant"), s).alias("nodes"))).alias("value"))
    e = edges.join(samples.select(group).distinct(), group, "left_semi")
    e = e.select(F.to_json(F.struct(F.col(group).alias("lineage"), F.array(F.struct("pos", "parent", "child", "dist", "support")).alias("edges"))).alias("value"))
    n.unionByName(e).write.text(path, compression="gzip")  # the same words in every line


def read_clusters(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes(lineage, variant, coldate, accession, location, name), edges(lineage, pos, parent, child, dist, support))."""
    sample = "struct<coldate:string,accession:string,location:string,name:string>"
    t = spark.read.schema(f"lineage string, nodes map<string,array<{sample}>>, edges array<struct<pos:int,parent:string,child:string,dist:double,support:double>>").json(path)
    nodes = t.select("lineage", F.explode("nodes").alias("variant", "s")).select("lineage", "variant", F.inline("s"))
    return nodes, t.select("lineage", F.inline("edges"))


def write_stats(stats: DataFrame, path: str) -> None:
    stats.write.json(path)


def export_csv(df: DataFrame, path: str, digits: int = 2) -> None:
    """A table with rounded doubles as CSV with a header."""
    df.select(*(F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes)).write.option("header", "true").csv(path)


def export_mutations(stats: DataFrame, path: str, group: str = "lineage") -> None:
    """Group, mutation and frequency of every group's map as CSV with a header."""
    stats.select(F.col(group).alias("lineage"), F.explode("mutations").alias("mutation", "frequency")).write.option("header", "true").csv(path)


def write_serving(tables: dict[str, DataFrame], path: str, version: str, cluster_key: str = "cid") -> None:
    """All serving tables below ``path/version``, those with a cluster key partitioned by it. ``publish`` switches readers to a version."""
    for name, df in tables.items():
        w = df.write.mode("overwrite")
        (w.partitionBy(cluster_key) if cluster_key in df.columns else w).parquet(f"{path}/{version}/{name}")


def publish(spark: SparkSession, path: str, version: str) -> None:
    """Names the version that readers take from now on. An appended row, so that readers see the old version or the new one, and
    earlier ones can be named again."""
    spark.sql("select 1").select(F.lit(version).alias("version"), F.current_timestamp().alias("at"), F.expr("uuid()").alias("id")).write.mode("append").parquet(f"{path}/_published")


def current_version(spark: SparkSession, path: str) -> str:
    """The version that was published last."""
    row = spark.read.schema("version string, at timestamp, id string").parquet(f"{path}/_published").agg(F.max_by("version", F.struct("at", "id"))).first()  # one row
    if row[0] is None:
        raise ValueError("no version is published")
    return row[0]


def read_serving(spark: SparkSession, path: str, name: str, version: str | None = None) -> DataFrame:
    """A serving table of the current version, or of another one that is stored."""
    return spark.read.parquet(f"{path}/{version or current_version(spark, path)}/{name}")


def fold(sequence: Column | str, width: int = 60) -> Column:
    """A sequence in lines."""
    return F.regexp_replace(sequence, f"(.{{{width}}})(?=.)", "$1\n")
