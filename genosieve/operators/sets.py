"""Set operations on groups of samples and stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def feature_union(samples: DataFrame, features: DataFrame, group: str = "lineage", key: str = "accession") -> DataFrame:
    return samples.select(key, group).join(features, key).drop(key).distinct()


def groups_to_update(new: DataFrame, current: DataFrame, stored: DataFrame, col: str = "lineage") -> DataFrame:
    """Groups with new samples, and current groups that no stored row has."""
    return new.select(col).union(current.select(col).subtract(stored.select(col))).distinct()


def carry_over(recomputed: DataFrame, stored: DataFrame, current: DataFrame, key: str = "lineage", strict: bool = False) -> DataFrame:
    """Recomputed rows, and the stored ones of the other current groups; ``strict`` fails on a group that has neither."""
    kept = stored.join(recomputed.select(key), key, "left_anti").join(current.select(key).distinct(), key, "left_semi")
    out = recomputed.unionByName(kept)
    if strict and (n := current.select(key).distinct().join(out.select(key), key, "left_anti").count()):
        raise ValueError(f"{n} groups have neither a recomputed nor a stored row")
    return out


def tip_label_check(tips: DataFrame, labels: DataFrame, key: str = "name") -> DataFrame:
    """Tips without a label."""
    return tips.join(labels.select(key), key, "left_anti")


def concatenate(*tables: DataFrame) -> DataFrame:
    """Tables one after another, missing columns null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
