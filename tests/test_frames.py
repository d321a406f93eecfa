"""Reading frames over positions against brute force."""

import random

from pyspark.sql import functions as F

from genosieve.operators import features as O, joins as J


def test_first_frame_of_a_position(spark):
    r = random.Random(1)
    for n, top in ((10, 40), (300, 1000)):
        frames = [(r.randint(0, 5), f"f{k}", l := r.randint(0, top), l + r.choice([0, 1, 3, r.randint(0, top)])) for k in range(n)]
        df = spark.createDataFrame(frames, "ord int, orf string, l int, r int")
        positions = spark.range(-2, 2 * top + 5).select(F.col("id").cast("int").alias("pos"))
        found = {x.pos: tuple(x.o) for x in O.covering(positions, df).collect()}
        want = {}
        for pos in range(-2, 2 * top + 5):
            own = [(o, l, f) for o, f, l, e in frames if l <= pos < e]
            if own:
                want[pos] = min(own)
        assert found == want


def test_many_overlapping_frames(spark):
    """100,000 frames over each other: linear rows, and no nested loop."""
    frames = spark.range(100_000).selectExpr("cast(100000 - id as int) as ord", "concat('f', id) as orf", "cast(id % 50 as int) as l", "cast(1000 + id % 1000 as int) as r")
    positions = spark.range(2500).select(F.col("id").cast("int").alias("pos"))
    found = O.covering(positions, frames)
    assert "NestedLoop" not in found._jdf.queryExecution().executedPlan().toString()
    got = {x.pos: x.o.orf for x in found.collect()}
    assert len(got) == 1999 and got[500] == "f99999" and got[1998] == "f99999" and got[0] == "f99950"


def test_append_missing_takes_the_least(spark):
    old = spark.createDataFrame([("a", 1, "x")], "k string, n int, v string")
    new = spark.createDataFrame([("b", 3, "q"), ("b", 2, "z"), ("a", 0, "no"), ("b", 2, "y"), (None, 5, "n")], "k string, n int, v string")
    assert sorted(map(str, (tuple(x) for x in J.append_missing(old, new, "k", ["n"]).collect()))) == sorted(map(str, [("a", 1, "x"), ("b", 2, "y"), (None, 5, "n")]))
    assert {tuple(x) for x in J.append_missing(old, new.where("k is not null"), "k").collect()} == {("a", 1, "x"), ("b", 2, "y")}
