"""Increments against a full recomputation: nulls, moved, repeated and replayed rows."""

import random

from genosieve.streaming import incremental as R

SCHEMA = "k long, g string, v int"


def recomputed(batches):
    held, log = {}, []
    for rows in batches:
        last = {}
        for k, g, v in rows:
            key = lambda x: (x[1] is not None, x[1] or 0)
            if k not in last or key((k, v)) > key((k, last[k][1])):
                last[k] = (g, v)
        for k, (g, v) in last.items():
            if k not in held or held[k][0] != g:
                held[k] = (g, v)
                log.append((k, g))
    return held, log


def test_random_increments_equal_recomputation(spark, tmp_path):
    r = random.Random(11)
    for case in range(3):
        root = f"file://{tmp_path}/{case}"
        batches = [[(r.choice([None, *range(12)]), r.choice([None, "a", "b"]), 100 * n + i) for i in range(r.randint(0, 15))] for n in range(5)]
        schema = spark.createDataFrame([], SCHEMA).schema
        R.begin(spark, schema, f"{root}/cache")
        for n, rows in enumerate(batches):
            df = spark.createDataFrame(rows, SCHEMA).repartition(3)
            for _ in range(r.choice([1, 2])):  # a batch that runs again
                R.merge_batch(df, f"q-{n}", f"{root}/cache", f"{root}/log", "k", "g", ["v"], 8)
        held, log = recomputed(batches)
        assert {x.k: (x.g, x.v) for x in R.cached(spark, f"{root}/cache", schema, "k").collect()} == held
        assert sorted(map(str, ((x.k, x.g) for x in spark.read.parquet(f"{root}/log").collect()))) == sorted(map(str, log))
        R.compact(spark, f"{root}/cache", schema, "k", f"{root}/next")
        R.merge_batch(spark.createDataFrame([(3, "z", 9), (None, "z", 9)], SCHEMA), "p-0", f"{root}/next", f"{root}/log2", "k", "g", ["v"], 8)
        held |= {3: ("z", 9), None: ("z", 9)}
        assert {x.k: (x.g, x.v) for x in R.cached(spark, f"{root}/next", schema, "k").collect()} == held


def test_a_null_group_is_seen(spark, tmp_path):
    root = f"file://{tmp_path}"
    df = spark.createDataFrame([(1, None, 0)], SCHEMA)
    R.begin(spark, df.schema, f"{root}/cache")
    for n in range(2):
        R.merge_batch(df, f"q-{n}", f"{root}/cache", f"{root}/log", "k", "g")
    assert R.stored(spark, f"{root}/cache", df.schema).count() == 1 and spark.read.schema("k long").parquet(f"{root}/log").count() == 1
    R.merge_batch(spark.createDataFrame([(1, "a", 0)], SCHEMA), "q-2", f"{root}/cache", f"{root}/log", "k", "g")
    R.merge_batch(df, "q-3", f"{root}/cache", f"{root}/log", "k", "g")
    assert [(x.g, x._version) for x in R.stored(spark, f"{root}/cache", df.schema).orderBy("_version").collect()] == [(None, 0), ("a", 1), (None, 2)]


def test_a_batch_reads_its_own_buckets(spark, tmp_path):
    root = f"file://{tmp_path}"
    whole = spark.range(4000).selectExpr("id as k", "'a' as g", "0 as v")
    schema = spark.createDataFrame([], SCHEMA).schema
    R.begin(spark, schema, f"{root}/cache")
    R.merge_batch(whole, "q-0", f"{root}/cache", f"{root}/log", "k", "g", None, 32)
    one = R.stored(spark, f"{root}/cache", schema, "q-1").where(R._bucket("k", 32) == 5).where("_bucket in (5)")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "_bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    files = {f for f in R.stored(spark, f"{root}/cache", schema).where("_bucket = 5").select("k").inputFiles() if "/_bucket=5/" in f}
    assert files and one.count() == sum(1 for r in whole.select(R._bucket("k", 32).alias("b")).collect() if r.b == 5)


def test_two_checkpoints_do_not_overwrite(spark, tmp_path):
    root = f"file://{tmp_path}"
    spark.createDataFrame([(k, "a", 0) for k in range(50)], SCHEMA).write.parquet(f"{root}/feed")
    schema = spark.createDataFrame([], SCHEMA).schema
    for n in range(3):
        if n == 2:
            spark.createDataFrame([(k, "b", 1) for k in range(40, 60)], SCHEMA).write.mode("append").parquet(f"{root}/feed")
        feed = spark.readStream.schema(schema).parquet(f"{root}/feed")
        R.ingest(spark, feed, f"{root}/cache", f"{root}/log", "k", "g", f"{root}/checkpoint{n % 2}", ["v"]).awaitTermination()
    found = {x.k: x.g for x in R.cached(spark, f"{root}/cache", schema, "k").collect()}
    assert found == {k: "a" if k < 40 else "b" for k in range(60)}
    assert spark.read.parquet(f"{root}/log").count() == 50 + 20
