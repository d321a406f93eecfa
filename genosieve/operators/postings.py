"""A posting index of trigrams for substring search over labels and accessions.

Three tables, each dealt to buckets: ``grams`` has every distinct trigram of every distinct lower-cased text with the text's id, ``texts``
the texts, and ``owners`` the rows that have them. A search takes the rarest trigrams of the term, reads their buckets, keeps the
ids that have all of them, and confirms the term in their texts; the owners of those are read by bucket, too. Terms of fewer than
three letters have no trigram and scan the distinct texts, which still are fewer than the rows. A text's id is a 64-bit hash; texts that share
one are told apart when the term is confirmed, since owners have the text, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Trigrams of a term that are looked up.
RAREST = 4


def _bucket(c: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int").alias("_bucket")


def write_index(rows: DataFrame, texts: Column, keys: list[str], path: str, buckets: int = 64) -> None:
    """Indexes ``texts``, an array of strings of each row, by its ``keys``. Nulls are no texts; empty texts are found by no trigram."""
    owners = rows.select(*keys, F.explode(texts).alias("text")).where("text is not null").withColumn("text", F.lower("text")).distinct()
    owners = owners.select("*", F.xxhash64("text").alias("id"))
    owners.select("*", _bucket(F.col("id"), buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/owners")
    spark = rows.sparkSession
    distinct = spark.read.parquet(f"{path}/owners").select("id", "text").distinct()
    distinct.select("*", _bucket(F.col("id"), buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/texts")
    kept = spark.read.parquet(f"{path}/texts")
    grams = kept.where(F.length("text") >= 3).select("id", F.explode(F.array_distinct(F.expr("transform(sequence(1, length(text) - 2), i -> substring(text, i, 3))"))).alias("gram")).distinct()
    stored = grams.select("gram", "id", _bucket(F.col("gram"), buckets)).repartition("_bucket", F.pmod(F.col("id"), F.lit(8)))  # a frequent trigram is many files
    stored.sortWithinPartitions("_bucket", "gram").write.partitionBy("_bucket").parquet(f"{path}/grams")
    grams.groupBy("gram").agg(F.count("*").alias("n")).write.parquet(f"{path}/counts")


def find(spark: SparkSession, path: str, term: str, buckets: int = 64) -> DataFrame:
    """(id, text) of the distinct texts that contain the term, in any case."""
    term, texts = term.lower(), spark.read.parquet(f"{path}/texts")
    hit = F.contains("text", F.lit(term))
    grams = sorted({term[i : i + 3] for i in range(len(term) - 2)})
    if not grams:
        return texts.where(hit).select("id", "text")
    known = {r.gram: r.n for r in spark.read.parquet(f"{path}/counts").where(F.col("gram").isin(grams)).collect()}  # as many as the term has
    if len(known) < len(grams):
        return texts.where("false").select("id", "text")
    rarest = sorted(grams, key=lambda g: (known[g], g))[:RAREST]
    own = [r[0] for r in spark.createDataFrame([(g,) for g in rarest], "gram string").select(_bucket(F.col("gram"), buckets)).distinct().collect()]
    listed = spark.read.parquet(f"{path}/grams").where(F.col("_bucket").isin(own) & F.col("gram").isin(rarest))
    ids = listed.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") == len(rarest)).select("id", _bucket(F.col("id"), buckets))
    return texts.join(ids, ["_bucket", "id"]).where(hit).select("id", "text")


def owners_of(spark: SparkSession, path: str, found: DataFrame, buckets: int = 64) -> DataFrame:
    """The keys of the rows that have any of the texts found, once each."""
    owners = spark.read.parquet(f"{path}/owners")
    keys = [c for c in owners.columns if c not in ("text", "id", "_bucket")]
    return owners.join(found.select("*", _bucket(F.col("id"), buckets)), ["_bucket", "id", "text"], "left_semi").select(*keys).distinct()
