"""Substring search by trigrams against scanning."""

import random

from pyspark.sql import functions as F

from genosieve.operators import postings as P


def test_search_equals_the_scan(spark, tmp_path):
    r, path = random.Random(2), f"file://{tmp_path}/index"
    parts = ["Europe", "europa", "Asia", "EPI_ISL_", "é", "日本", " / ", "77", "ab", "aaa", ""]
    rows = [(k, [r.choice([None, "".join(r.choice(parts) for _ in range(r.randint(0, 5)))]) for _ in range(r.randint(0, 3))]) for k in range(400)] + [(400, None)]
    df = spark.createDataFrame(rows, "k int, texts array<string>")
    P.write_index(df, F.col("texts"), ["k"], path, 16)
    terms = ["EUROPE", "ope", "a", "", "é", "日本 ", "aaaaaa", "zzz", "aaazzz", "7", "isl_77", "ab / asia", "aab"]
    for term in terms + ["".join(r.choice(parts) for _ in range(3)) for _ in range(8)]:
        found = {x.k for x in P.owners_of(spark, path, P.find(spark, path, term, 16), 16).collect()}
        assert found == {k for k, own in rows if own and any(t is not None and term.lower() in t.lower() for t in own)}, term


def test_a_rare_term_reads_few_rows(spark, tmp_path):
    """Of 20,000 texts one has the term: the lists read have under a hundredth of the postings, in 4 of 64 buckets at most."""
    path = f"file://{tmp_path}/index"
    df = spark.range(20_000).selectExpr("id as k", "array(concat('label ', lpad(id, 6, '0')), if(id = 777, 'needle in hay', 'plain straw')) as texts")
    P.write_index(df, F.col("texts"), ["k"], path)
    assert [x.k for x in P.owners_of(spark, path, P.find(spark, path, "Needle")).collect()] == [777]
    grams = spark.read.parquet(f"{path}/grams")
    counts = {r.gram: r.n for r in spark.read.parquet(f"{path}/counts").collect()}
    rarest = sorted(counts[g] for g in ("nee", "eed", "edl", "dle"))[: P.RAREST]
    assert sum(rarest) * 100 < grams.count()
    plan = P.find(spark, path, "needle")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_bucket" in plan or "_bucket#" in plan.split("PartitionFilters")[1] and "PushedFilters: [In(gram" in plan


def test_no_rows(spark, tmp_path):
    path = f"file://{tmp_path}/index"
    df = spark.createDataFrame([(1, [""]), (2, None)], "k int, texts array<string>")
    P.write_index(df, F.col("texts"), ["k"], path)
    assert P.find(spark, path, "abc").count() == 0
    assert [x.k for x in P.owners_of(spark, path, P.find(spark, path, "")).collect()] == [1]
