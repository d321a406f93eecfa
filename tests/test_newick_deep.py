import pytest

from genosieve.operators import trees as T

SCHEMA = "tree int, node_id long, parent_id long, name string, length double, is_tip boolean"


def test_a_deep_tree_is_written_whole(spark):
    depth = 1500  # a caterpillar: inner node k has the tip depth + k and the inner node k + 1
    rows = [(0, k, k - 1 if k else None, None, 0.5 if k else None, False) for k in range(depth)]
    rows += [(0, depth + k, k, f"t{k}", 1.0, True) for k in range(depth)]
    text = T.to_newick(spark.createDataFrame(rows, SCHEMA)).first().newick
    want = f"(t{depth - 1}:1.0):0.5"
    for k in range(depth - 2, -1, -1):
        want = f"({want},t{k}:1.0)" + (":0.5" if k else "")
    assert text == want + ";"


def test_order_single_nodes_and_no_trees(spark):
    rows = [(1, 0, None, "r", None, False), (1, 5, 0, "b", None, True), (1, 2, 0, None, 1.0, False), (1, 7, 2, "c", None, True), (1, 3, 2, "a", 2.0, True), (2, 4, None, "x", None, True)]
    n = spark.createDataFrame(rows, SCHEMA)
    assert {r.tree: r.newick for r in T.to_newick(n).collect()} == {1: "((a:2.0,c):1.0,b)r;", 2: "x;"}
    assert T.to_newick(n.where("false")).count() == 0


def test_cut_off_nodes_raise(spark):
    with pytest.raises(Exception, match="not below a root"):
        T.to_newick(spark.createDataFrame([(1, 0, None, "r", None, True), (1, 2, 9, "a", None, True)], SCHEMA)).collect()
