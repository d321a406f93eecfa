"""Single operators by hand-computed values."""

import math

from pyspark.sql import functions as F

from genosieve.operators import aggregates as A, models as C, trees as T

NODES = "tree string, node_id long, parent_id long, name string, length double, is_tip boolean"


def test_a_decision_tree_by_hand(spark):
    """Ten vectors, two values: one split at the middle; leaves give shares, and the likelier class wins."""
    rows = [(k, [float(k >= 6), 0.5], "a" if k < 5 or k == 9 else "b") for k in range(10)]  # left: 5 a, 1 b; right: 3 b, 1 a
    df = spark.createDataFrame(rows, "vec_id long, v array<double>, label string")
    found = {r.vec_id: (r.assigned, round(r.probability, 9)) for r in C.classify(df, C.train(df, "v", "label", depth=1), "v", "vec_id").collect()}
    assert found == {k: ("a", round(5 / 6, 9)) if k < 6 else ("b", 0.75) for k in range(10)}
    tie = df.where("vec_id in (0, 5)")  # equal vectors of two classes: the first class
    assert {r.assigned for r in C.classify(tie, C.train(tie, "v", "label"), "v", "vec_id").collect()} == {"a"}


def test_layout_after_pruning(spark):
    """((a:1,b:1):1,(c:1,d:2):3); without b the node above a goes, and places are numbered again."""
    rows = [("t", 0, None, None, None, False), ("t", 1, 0, None, 1.0, False), ("t", 2, 0, None, 3.0, False), ("t", 3, 1, "a", 1.0, True), ("t", 4, 1, "b", 1.0, True), ("t", 5, 2, "c", 1.0, True), ("t", 6, 2, "d", 2.0, True)]
    nodes = spark.createDataFrame(rows, NODES)
    dates = nodes.where("is_tip").select("tree", "node_id", F.when(F.col("name") == "b", F.lit("2019-01-01")).otherwise(F.lit("2021-01-01")).cast("date").alias("date"))
    found = {r.name or r.node_id: (r.node_id, r.parent_id, r.length, r.x, r.y) for r in T.renumber(T.prune_before(nodes, dates, F.lit("2020-01-01").cast("date"))).collect()}
    # children by node id: the node above c and d (old id 2) comes before a (old id 3)
    assert found == {0: (0, None, None, 0.0, 1.25), 1: (1, 0, 3.0, 3.0, 0.5), "a": (2, 0, 2.0, 2.0, 2.0), "c": (3, 1, 1.0, 4.0, 0.0), "d": (4, 1, 2.0, 5.0, 1.0)}


def test_summary_with_diversity(spark):
    nodes = spark.createDataFrame([("g", "r", False), ("g", "a", True), ("g", "b", True)], "lineage string, name string, is_tip boolean")
    labels = spark.createDataFrame([("g", "a", 3), ("g", "b", 1)], "lineage string, name string, n long")
    freq = spark.createDataFrame([("g", 0.5), ("g", 0.25)], "lineage string, freq double")
    r = A.tree_summary(nodes, labels, "lineage", freq, spark.createDataFrame([("g", 4), ("h", 1)], "lineage string, n long")).first()
    assert (r.unsampled, r.ntips, r.nvariants) == (1, 2, 4)
    assert math.isclose(r.shannon, -(0.75 * math.log(0.75) + 0.25 * math.log(0.25))) and math.isclose(r.pi, (0.5 + 0.375) * 4 / 3)


def test_maps_of_bounded_size(spark):
    index = spark.range(5000).selectExpr("concat('k', id) as key", "id % 7 as cid").unionByName(spark.createDataFrame([("k5", 0), (None, 1)], "key string, cid long"))
    maps = A.merged_maps(index, 100).collect()
    merged = {k: v for r in maps for k, v in r.m.items()}
    assert len(maps) > 40 and max(len(r.m) for r in maps) < 200
    assert merged == {f"k{i}": i % 7 for i in range(5000)} | {"k5": 0}


def test_single_variants(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "x"), ("b", "x"), ("b", "y"), ("c", "")], "lineage string, variant_key string")
    assert {(r.lineage, r.variant_key, r.n_samples, r.n_edges) for r in T.single_variant(df, ["lineage"]).collect()} == {("a", "x", 2, 0), ("c", "", 1, 0)}
