"""Row numbers within groups of any size.

Rows are dealt to ranges of (group, order) by a sort's sampled bounds and written with the number of their range, so that the
numbers are fixed; ranges are numbered on their own, and shifted by the rows of the same group in the ranges before, a table of
one row per range and group. A hot group is many ranges, so no task sorts it whole. Rows that are equal in the order are told
apart by a hash of their columns and their place, so that ties don't gather in one range either.

``first_ranked`` is for the first ``n`` of every group: the limit reaches the window, which drops the rest before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from genosieve.sources.shared import cut


def ranked(rows: DataFrame, order: list[Column], group: list[str] | None = None, name: str = "rank", parts: int | None = None) -> DataFrame:
    """Rows with ``name``, their number from 0 in the order within their group (null is a group). Of equal rows any comes first."""
    group, spark = group or [], rows.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(f"`{g}`") for g in group]
    tie = [F.xxhash64(*(F.col(f"`{c}`").cast("string") for c in rows.columns)), F.monotonically_increasing_id()]
    held = cut(rows.select("*", *(t.alias(f"#tie{i}") for i, t in enumerate(tie))))  # places are fixed before any bounds are drawn
    full = [*order, F.col("#tie0"), F.col("#tie1")]
    dealt = cut(held.repartitionByRange(parts, *keys, *full).withColumn("#part", F.spark_partition_id()))
    sizes = dealt.groupBy("#part", *keys).agg(F.count("*").alias("#n"))
    before = F.coalesce(F.sum("#n").over(Window.partitionBy(*keys).orderBy("#part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select(F.col("#part").alias("#of"), *(k.alias(f"#g{i}") for i, k in enumerate(keys)), before.alias("#before"))
    own = dealt.withColumn("#own", F.row_number().over(Window.partitionBy("#part", *keys).orderBy(*full)) - 1)
    same = F.col("#part") == F.col("#of")
    for i, k in enumerate(keys):
        same = same & k.eqNullSafe(F.col(f"#g{i}"))
    missed = F.raise_error(F.lit("a range of a sort was not counted")).cast("long")  # never drop a row
    number = F.when(F.col("#before").isNull(), missed).otherwise(F.col("#own") + F.col("#before"))
    return own.join(shift, same, "left").select(*(F.col(f"`{c}`") for c in rows.columns), number.alias(name))


def first_ranked(rows: DataFrame, order: list[Column], n: int, group: list[str] | None = None, name: str = "rank") -> DataFrame:
    """The first ``n`` rows of every group with their number from 0. The order has to be total."""
    number = F.row_number().over(Window.partitionBy(*(f"`{g}`" for g in group or [])).orderBy(*order))
    return rows.withColumn("#number", number).where(F.col("#number") <= n).withColumn(name, F.col("#number") - 1).drop("#number")
