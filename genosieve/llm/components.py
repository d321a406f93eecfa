"""Connected components over an edge table by alternating stars, each round cut by a written table.

Large stars point every larger neighbour of a node at its smallest neighbour; small stars do so with the smaller ones.
Both keep the components and shorten paths, so a component of n nodes becomes one star in about log n rounds. Rows are
joined by node; a star's centre is a hot key, which adaptive execution splits as a skewed join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from genosieve.llm.common import written


def _least(e: DataFrame) -> DataFrame:
    """For every u its smallest neighbour or itself, beside every neighbour v."""
    m = e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return e.join(m, "u")


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """edges(u, v) of one sortable type -> (node, root) for every node of an edge; root is the component's least node.

    Loops, repeated edges and both directions are allowed; nulls are ignored; no edges give an empty table.
    """
    e = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u is not null and v is not null and u != v").distinct(), "cc")
    last = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = _least(large)  # large has u > v, so these are the smaller neighbours
        small = down.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        e = written(small, "cc")
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == last or now[0] == 0:
            break
        last = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # settled: every node points at its root
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
