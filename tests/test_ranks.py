"""Ranks within groups over many ranges, with adaptive execution on."""

import random

import pytest
from pyspark.sql import functions as F

from genosieve.operators import aggregates as A, ranking as W, ranks


@pytest.fixture(scope="module")
def many(spark):
    known = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    yield spark
    for k, v in known.items():
        spark.conf.set(k, v)


def test_newest_first_loses_no_row(many):
    for n, width in ((60_000, 640), (60_000, 2_560), (1, 1), (0, 1)):
        rows = many.range(n).select("id", F.repeat(F.lit("x"), width).alias("wide")).repartition(7)
        found = A.newest_first(rows, "id")
        assert found.columns == ["id", "wide", "nth"]
        r = found.agg(F.count("*"), F.count_distinct("nth"), F.count(F.when(F.col("nth") == n - 1 - F.col("id"), 1)), F.count(F.when(F.length("wide") == width, 1))).first()
        assert tuple(r) == (n, n, n, n)


def test_ranks_against_brute_force(many):
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 18 + ["b", None]), r.choice([None, 1, 1, 1, r.randint(0, 9999)]), r.randint(0, 3), k) for k in range(30_000)]
    df = many.createDataFrame(rows, "g string, v int, w int, k int").repartition(9)
    total = [F.col("v").desc_nulls_last(), F.col("w"), F.col("k")]
    key = lambda x: (x[1] is None, -(x[1] or 0), x[2], x[3])
    want = {}
    for g in ("hot", "b", None):
        want |= {x[3]: i for i, x in enumerate(sorted((x for x in rows if x[0] == g), key=key))}
    assert {x.k: x.rank for x in ranks.ranked(df, total, ["g"]).collect()} == want
    ties = ranks.ranked(df, [F.col("v").desc_nulls_last()], ["g"], "n").collect()  # ties: any order, but all numbers
    for g in ("hot", "b", None):
        own = sorted((x.n, x.v) for x in ties if x.g == g)
        assert [n for n, _ in own] == list(range(sum(x[0] == g for x in rows)))
        assert [v for _, v in own] == [x[1] for x in sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is None, -(x[1] or 0)))]
    first = ranks.first_ranked(df, total, 5, ["g"])
    assert {x.k: x.rank for x in first.collect()} == {k: i for k, i in want.items() if i < 5}
    assert "WindowGroupLimit" in first._jdf.queryExecution().executedPlan().toString()


def test_equal_rows_are_dealt(many):
    """Nine tenths of the rows are one and the same; no range holds them all."""
    df = many.range(40_000).selectExpr("if(id % 10 = 0, id, 7) as v", "'g' as g").repartition(8)
    found = ranks.ranked(df, [F.col("v")], ["g"])
    assert found.agg(F.count_distinct("rank"), F.min("rank"), F.max("rank")).first()[:] == (40_000, 0, 39_999)
    assert found.where("rank <= 36000 and rank > 0 and v <> 7").count() == 0


def test_orders_built_on_ranks(many):
    edges = [("a", 0, "r", "x"), ("a", 1, "x", "y"), ("a", 2, "r", "z"), (None, 0, "p", "q")]
    found = W.variant_order(many.createDataFrame(edges, "g string, pos int, parent string, child string"), "g")
    assert {(r.g, r.node): r.y for r in found.collect()} == {("a", "r"): 1, ("a", "x"): 2, ("a", "y"): 3, ("a", "z"): 4, (None, "p"): 1, (None, "q"): 2}
    points = [("c", i, i % 3, i // 3) for i in range(300)] + [("d", 1, 0, 0), (None, 5, 1, 1)]
    hits = W.rank_hits(many.createDataFrame(points, "cid string, id int, y int, x int"))
    for c in ("c", "d", None):
        own = sorted((r.hit, r.y, r.x, r.id, r.first_id, r.last_id) for r in hits.collect() if r.cid == c)
        order = sorted((y, x, i) for g, i, y, x in points if g == c)
        assert [(h, i) for h, _, _, i, _, _ in own] == [(k, i) for k, (_, _, i) in enumerate(order)]
        assert {r[4:] for r in own} == {(order[0][2], order[-1][2])}
