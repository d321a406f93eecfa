"""Incremental maintenance: ingest unseen keys, refresh changed groups, upsert, append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType


def upsert(target: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """Target with rows inserted or replaced by key; of several rows of a key the last by ``order``."""
    last = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")
    return target.join(last.select(key), key, "left_anti").unionByName(last.select(*target.columns))


def refresh(samples: DataFrame, updated: DataFrame, group: str = "lineage") -> DataFrame:
    """Samples of the groups that have to be computed again."""
    return samples.join(updated.select(group), group, "left_semi")


def append_assignments(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(buckets)).cast("int")


def stored(spark: SparkSession, cache_path: str, schema: StructType, but: str | None = None) -> DataFrame:
    """All versions of all keys in a cache, but those of one batch: ``schema``, _version, _batch, _bucket."""
    held = StructType([*schema.fields, StructField("_version", LongType()), StructField("_batch", StringType()), StructField("_bucket", IntegerType())])
    rows = spark.read.schema(held).parquet(cache_path)
    return rows.where(F.col("_batch") != but) if but else rows


def cached(spark: SparkSession, cache_path: str, schema: StructType, key: str) -> DataFrame:
    """The cache as it stands: the last version of every key."""
    last = stored(spark, cache_path, schema).groupBy(key).agg(F.max_by(F.struct(*schema.fieldNames()), "_version").alias("r"))
    return last.select("r.*")


def merge_batch(batch: DataFrame, name: str, cache_path: str, log_path: str, key: str, group: str, order: list[str] | None = None, buckets: int = 64) -> None:
    """Stores the rows of a batch that are new or whose group changed, and logs their (key, group).

    Of several rows of a key the greatest by ``order`` counts (by default by all columns), and a key's null is a key. A stored
    group of null is a group; changes to and from it count. The cache is dealt to ``buckets`` by a hash of the key; a batch reads
    the buckets of its own keys, a list of at most ``buckets`` numbers, and not its own folder, so that it can run again: it
    then overwrites the same folder with the same rows."""
    spark = batch.sparkSession
    columns = [F.col(c) for c in (order or batch.columns)]
    rest = F.struct(*batch.columns)
    rows = batch.groupBy(key).agg(F.max_by(rest, F.struct(*columns, F.to_json(rest))).alias("r")).select("r.*").withColumn("_bucket", _bucket(key, buckets))
    own = [r[0] for r in rows.select("_bucket").distinct().collect()]  # bounded by the number of buckets
    old = stored(spark, cache_path, batch.schema, name).where(F.col("_bucket").isin(own)).groupBy("_bucket", key).agg(F.max("_version").alias("_known"), F.max_by(group, "_version").alias("_group"))
    old = old.withColumnsRenamed({key: "_key", "_bucket": "_of"})
    joined = rows.join(old, (F.col("_bucket") == F.col("_of")) & F.col(key).eqNullSafe(F.col("_key")), "left")
    new = joined.where(F.col("_known").isNull() | ~F.col(group).eqNullSafe(F.col("_group")))
    version = F.coalesce(F.col("_known") + 1, F.lit(0).cast("long"))
    out = new.select(*batch.columns, version.alias("_version"), F.lit(name).alias("_batch"), "_bucket")
    # dynamic overwrite would keep folders of an earlier try that this one doesn't have, so a batch is one folder of its own
    out.drop("_batch").write.mode("overwrite").partitionBy("_bucket").parquet(f"{cache_path}/_batch={name}")
    spark.read.schema(batch.schema).parquet(f"{cache_path}/_batch={name}").select(key, group).write.mode("overwrite").parquet(f"{log_path}/_batch={name}")


def begin(spark: SparkSession, schema: StructType, cache_path: str) -> None:
    """An empty first folder, so that an empty cache can be read."""
    held = StructType([*schema.fields, StructField("_version", LongType())])
    spark.createDataFrame([], held).write.mode("overwrite").parquet(f"{cache_path}/_batch=start/_bucket=0")


def compact(spark: SparkSession, cache_path: str, schema: StructType, key: str, out_path: str) -> None:
    """A new cache with the last version of every key, one file a bucket, for the next stream to go on with."""
    last = stored(spark, cache_path, schema).groupBy("_bucket", key).agg(F.max_by(F.struct(*schema.fieldNames(), "_version"), "_version").alias("r")).select("r.*", "_bucket")
    last.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{out_path}/_batch=base")


def ingest(spark: SparkSession, feed: DataFrame, cache_path: str, log_path: str, key: str, group: str, checkpoint: str, order: list[str] | None = None, buckets: int = 64) -> StreamingQuery:
    """Streams a feed once over what is available, by ``merge_batch``. The cache itself is the memory, so no state grows. A
    batch's folder has the query's id, which the checkpoint keeps, and the batch's number: one that ran twice adds nothing, and a
    new checkpoint overwrites nothing."""

    def merge(batch: DataFrame, number: int) -> None:
        query = batch.sparkSession.read.json(f"{checkpoint}/metadata").first()["id"]
        merge_batch(batch, f"{query}-{number}", cache_path, log_path, key, group, order, buckets)

    begin(spark, feed.schema, cache_path)
    return feed.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
