"""Serving queries over stored tables: lookups, search, completion and details."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame, functions as F

from genosieve.functions import expressions as X
from genosieve.operators import postings


def cluster_rows(df: DataFrame, cid: int) -> DataFrame:
    """Rows of one cluster; on tables stored by cid this reads one partition."""
    return df.where(F.col("cid") == cid).drop("cid")


def display_of(stats: DataFrame, cid: int) -> DataFrame:
    return stats.where(F.col("cid") == cid).select("lineage", X.display_class("raw_lineage").alias("display"))


def lookup(index: DataFrame, term: str) -> DataFrame:
    """The cluster of an accession or lineage, upper-cased."""
    return index.where(F.upper("key") == term.upper()).select("cid")


def search(points: DataFrame, term: str, start: date, end: date, inclusive: bool = False, labels: str = "labels", accessions: str = "accessions", day: str = "coldate") -> DataFrame:
    """Points of which a label or accession contains the term, in any case, within the dates."""
    t = F.lit(term.lower())
    hit = F.exists(labels, lambda x: F.contains(F.lower(x), t)) | F.exists(accessions, lambda x: F.contains(F.lower(x), t))
    lo, hi, d = F.lit(start), F.lit(end), F.col(day)
    return points.where((d.between(lo, hi) if inclusive else (d > lo) & (d < hi)) & hit)


def index_points(points: DataFrame, path: str, labels: str = "labels", accessions: str = "accessions", keys: tuple[str, ...] = ("lineage", "variant_key", "coldate")) -> None:
    """Writes the posting index of the points' labels and accessions."""
    postings.write_index(points, F.concat(F.coalesce(labels, F.array()), F.coalesce(accessions, F.array())), list(keys), path)


def search_indexed(points: DataFrame, path: str, term: str, start: date, end: date, inclusive: bool = False, keys: tuple[str, ...] = ("lineage", "variant_key", "coldate"), day: str = "coldate") -> DataFrame:
    """As ``search``, by the posting index: labels are not scanned. Keys are without nulls."""
    spark = points.sparkSession
    owners = postings.owners_of(spark, path, postings.find(spark, path, term))
    lo, hi, d = F.lit(start), F.lit(end), F.col(day)
    return points.where(d.between(lo, hi) if inclusive else (d > lo) & (d < hi)).join(owners, list(keys), "left_semi")


def autocomplete(keys: DataFrame, term: str, k: int = 10) -> DataFrame:
    """The first k keys: by prefix if the term has no digit, else those whose normalised form contains it."""
    norm = re.sub(r"[^a-z0-9]", "", term.lower())
    hit = F.contains(F.col("norm"), F.lit(norm)) if re.search(r"\d", term) else F.startswith(F.lower("key"), F.lit(term.lower()))
    return keys.where(hit).orderBy("section", "key").limit(k)


def route_query(points: DataFrame, index: DataFrame, term: str, start: date, end: date) -> DataFrame:
    """(kind, cid): an accession's or lineage's cluster, else the clusters of the points that a search finds."""
    known = lookup(index, term).select(F.lit("key").alias("kind"), "cid")
    found = search(points, term, start, end).select(F.lit("search").alias("kind"), "cid").distinct()
    none = index.where(F.upper("key") == term.upper()).limit(1).agg(F.count("*").alias("k"))
    return known.unionByName(found.join(F.broadcast(none)).where("k = 0").select("kind", "cid"))  # one row


def sample_details(points: DataFrame) -> DataFrame:
    """One row per sample of a point."""
    return points.select("lineage", "variant_key", "coldate", F.explode(F.arrays_zip("accessions", "labels")).alias("s")).select("lineage", "variant_key", "coldate", F.col("s.accessions").alias("accession"), F.col("s.labels").alias("label"))


def mutation_details(stats: DataFrame) -> DataFrame:
    """One row per mutation of a group."""
    return stats.select("lineage", F.explode("mutations").alias("mutation", "frequency"))
