"""Small groups whole in one task against the same over node tables."""

import os
import random

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from genosieve.operators import aggregates as A, chain as C, forests as H, joining as J, trees as T
from genosieve.plans import beads as B, trees as P
from genosieve.sources import io, shared

SIZES = {"a": 1, "b": 2, "c": 3, "d": 6, "e": 6, "f": 9, "g": 17, "h": 30, "i": 66}


def samples(spark, seed=3):
    """Samples of lineages of every size: one variant, few, too many for whole sums (h), and more than the bits of a set (i)."""
    r, rows = random.Random(seed), []
    for lineage, size in SIZES.items():
        keys = set()
        while len(keys) < size:
            keys.add(",".join(sorted(f"f{x}" for x in r.sample(range(12 if size < 20 else 40), r.randint(1, 5)))))
        for key in [*sorted(keys), ""]:
            for _ in range(r.randint(1, 3)):
                rows.append((lineage, len(rows), f"2020-0{r.randint(1, 9)}-1{r.randint(0, 9)}", f"n{len(rows)}", "x / y", "x", "y", key))
    rows += [(None, len(rows) + x, "2020-01-01", "n", "x / y", "x", "y", f"f{x}") for x in range(4)]
    return spark.createDataFrame(rows, "lineage string, accession long, coldate string, name string, location string, region string, country string, variant_key string").withColumn("coldate", F.to_date("coldate")).repartition(5)


def rows(df, *columns):
    return sorted(map(str, ((*(round(x, 6) if isinstance(x, float) else x for x in r),) for r in df.select(*columns).collect())))


@pytest.mark.parametrize("replicates", [4])
def test_consensus_and_trees_of_small_groups(spark, replicates):
    """Also at ties of one half, which an even number of trees has."""
    s = samples(spark)
    long, words = C.dictionary(s, 5000)
    numbered = A.number_variants(A.variants(s), 5000)
    trees = J.bootstrap_trees(long, words, replicates)
    columns = ["lineage", "replicate", "node_id", "parent_id", "name", "length", "is_tip"]
    assert rows(C.bootstrap_trees(numbered, replicates), *columns) == rows(trees, *columns)
    columns = ["group", "key", "parent", "support", "length", "size"]
    found = rows(C.consensus_trees(numbered, replicates), *columns)
    assert found == rows(C.consensus_of(trees), *columns) and len(found) > sum(SIZES.values())


def test_bead_plots_of_small_groups(spark, monkeypatch):
    s = samples(spark, 5)
    small = C.bead_plots(s, 5000, 10)
    monkeypatch.setattr(H, "SMALL", 1)
    large = C.bead_plots(s, 5000, 10)
    assert rows(small.nodes, "lineage", "node_id", "variant", "n") == rows(large.nodes, "lineage", "node_id", "variant", "n")
    assert rows(small.samples, "lineage", "variant", *C.SAMPLE) == rows(large.samples, "lineage", "variant", *C.SAMPLE)
    columns = ["lineage", "pos", "parent", "child", "support"]
    assert rows(small.edges, *columns) == rows(large.edges, *columns)
    dist = {(x.lineage, x.child): x.dist for x in large.edges.collect()}
    assert all(abs(dist[x.lineage, x.child] - x.dist) < 0.011 for x in small.edges.collect())


def test_joining_of_whole_numbers_is_that_of_any():
    r = np.random.default_rng(2)
    for n in (2, 3, 5, 9, 14, 20):
        for top in (2, 6, 40):
            d = np.triu(r.integers(0, top, (40, n, n)).astype(float), 1)
            d += d.transpose(0, 2, 1)
            assert all((a == b).all() for a, b in zip(J.in_step(d), J._joined_plain(d.copy())))


def written(folder):
    return {os.path.join(d, f) for d, _, files in os.walk(folder) for f in files if f.endswith(".parquet")}


def test_trees_of_small_groups_are_not_written(spark, sf):
    """A hundred trees of every family were written, a row per node."""
    folder = shared.shared_folder(spark).removeprefix("file://")
    variants = P.family_variants(spark, sf).count()
    before = written(folder)
    P.t05_consensus(spark, sf).count()
    assert sum(pq.read_metadata(f).num_rows for f in written(folder) - before) <= variants


def rows_written(spark, query, sf):
    folder = shared.shared_folder(spark).removeprefix("file://")
    before = written(folder)
    query(spark, sf).count()
    return sum(pq.read_metadata(f).num_rows for f in written(folder) - before)


@pytest.mark.parametrize("name", ["bead_clusters", "beadplots", "bead_summaries", "daily_run"])
def test_bead_plots_write_no_trees(spark, sf, name):
    """Of a hundred trees of every family nothing is written but what is served: a few rows a sample."""
    assert rows_written(spark, getattr(B, name), sf) <= 10 * P.families(spark, sf).count()


def test_cluster_files_are_compressed(spark, tmp_path):
    samples = spark.range(3000).selectExpr("'A' as lineage", "'v' as variant", "'2024-01-01' as coldate", "cast(id as string) as accession", "'x' as location", "'n' as name").coalesce(1)
    edges = spark.range(1).selectExpr("'A' as lineage", "0 as pos", "'v' as parent", "'w' as child", "1.0D as dist", "0.5D as support")
    io.write_clusters(samples, edges, path := f"{tmp_path}/clusters")
    assert sum(os.path.getsize(f"{path}/{f}") for f in os.listdir(path) if f.startswith("part")) < 3000 * 20  # a line has over 100 bytes
    assert sorted(map(tuple, io.read_clusters(spark, path)[0].collect())) == sorted(map(tuple, samples.collect()))


def test_summaries_are_those_of_the_served_tables(spark):
    """Without the other tables being written."""
    plots = C.bead_plots(samples(spark, 7).where("lineage < 'h'"), 5000, 6)
    folder = shared.shared_folder(spark).removeprefix("file://")
    before = written(folder)
    own = C.cluster_summaries(plots)
    assert own.count() == 7 and not any("label" in pq.read_schema(f).names for f in written(folder) - before)
    assert sorted(map(str, own.collect())) == sorted(map(str, C.cluster_tables(plots)["clusters"].collect()))


def test_draws_are_those_of_the_weights_table(spark):
    words = spark.createDataFrame([(g, k) for g, n in (("a", 7), ("ä#1", 1), ("", 40)) for k in range(n)], "lineage string, feature_no int")
    n = words.groupBy("lineage").agg(F.count("*").cast("int").alias("n"), F.xxhash64(F.lit(1), "lineage").alias("base")).distinct()
    own = {(r.lineage, 3 + k, f): w for r in n.collect() for k, row in enumerate(H.weights(r.base, r.n, 3, 6).tolist()) for f, w in enumerate(row) if w}
    want = T.bootstrap_weights(words, 9).where("replicate >= 3").collect()
    assert own == {(r.lineage, r.replicate, r.feature_no): r.weight for r in want}


def test_groups_of_one_size_go_through_together():
    """Trees of a family at a time were too few to fill a step."""
    keys = [["f1,f2", "f1", "f3"]] * 40 + [["f1", "f2"]] * 3
    batch = pa.RecordBatch.from_arrays([pa.array([str(x) for x in range(43)]), pa.array(range(43)), pa.array([list(range(len(k))) for k in keys]), pa.array(keys)], names=["lineage", "base", "names", "keys"])
    sizes = []
    list(H.in_chunks(iter([batch]), 100, lambda own: sizes.append((len(own[0].names), len(own), H.trees_of(own)[0].shape))))
    assert sorted(sizes) == [(2, 3, (3, 300)), (3, 40, (5, 4000))]
