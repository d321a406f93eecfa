"""Quality control of samples and features."""

from __future__ import annotations

import math
from datetime import date

from pyspark.sql import Column, DataFrame, Window, functions as F

from genosieve.functions import expressions as X
from genosieve.sources.shared import cut

MIN_LENGTH, MAX_MISSING, MAX_AMBIGUOUS = 29_000, 300, 0.05


def qc_reason(country: Column, length: Column, date_text: Column, min_length: int = MIN_LENGTH, min_date: date = date(2019, 12, 1), today: date | None = None, order: tuple[str, ...] = ("nonhuman", "short", "baddate")) -> Column:
    """The first rule of ``order`` that a sample fails, null if none."""
    d = X.parse_iso(date_text)
    bad_date = d.isNull() | (d < F.lit(min_date)) | (d > (F.lit(today) if today else F.current_date()))
    rules = {"nonhuman": F.coalesce(country, F.lit("")).rlike("^($|[a-z])"), "short": F.coalesce(length, F.lit(0)) < min_length, "baddate": bad_date}
    out = F.when(rules[order[0]], order[0])
    for name in order[1:]:
        out = out.when(rules[name], name)
    return out


def qc_counts(df: DataFrame, reason: Column) -> DataFrame:
    return df.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def mask_features(features: DataFrame, mask: DataFrame, substitution: str = "~", deletion: str = "-") -> DataFrame:
    """Without substitutions at masked positions whose base occurs in the mask's text, and without N outside deletions.

    Texts are searched once for every different base of a position, so neither a mask's copies nor a position's features
    multiply; the (position, base) pairs found are a written table, whose size tells whether they go to every task."""
    m = mask.select(F.col("pos").alias("m_pos"), F.col("alt").alias("m_text")).distinct()
    bases = features.where(F.col("typ") == substitution).select("pos", "alt").distinct()
    found = bases.join(m, (F.col("pos") == F.col("m_pos")) & F.contains(F.col("m_text"), F.col("alt")), "left_semi")
    found = cut(found.select(F.col("pos").alias("m_pos"), F.col("alt").alias("m_alt")))
    hit = (F.col("pos") == F.col("m_pos")) & (F.col("alt") == F.col("m_alt")) & (F.col("typ") == substitution)
    return features.join(found, hit, "left_anti").where((F.col("typ") == deletion) | ~F.col("alt").contains("N"))


def drop_unmutated(samples: DataFrame, features: DataFrame, key: str = "accession") -> DataFrame:
    return samples.join(features.select(key), key, "left_semi")


def clock_thresholds(days: DataFrame, rate: float, cutoff: float, maxtime: int | None = None) -> DataFrame:
    """(day, qmin, qmax) of a Poisson clock with ``rate`` features a day up to ``maxtime``, for the distinct days given.

    A day's distribution is one group of counts up to where its upper tail is below the cutoff by Bernstein's bound, so
    its length follows the mean and not the data's size.
    """
    mean = (F.col("day") if maxtime is None else F.least("day", F.lit(maxtime))) * F.lit(rate)
    tail = -math.log(min(cutoff, 1 - cutoff))
    top = F.greatest(mean, F.lit(0.0)) + tail / 3 + F.sqrt(tail**2 / 9 + 2 * tail * F.greatest(mean, F.lit(0.0)))
    k = F.explode(F.sequence(F.lit(0), F.ceil(top).cast("int") + 1)).alias("k")
    grid = days.select("day").distinct().select("day", k)
    order = Window.partitionBy("day").orderBy("k")
    logs = F.sum(F.when(F.col("k") > 0, F.log(F.greatest("k", F.lit(1)).cast("double"))).otherwise(0.0)).over(order)
    pmf = F.when(mean > 0, F.exp(F.col("k") * F.log(mean) - mean - logs)).otherwise((F.col("k") == 0).cast("double"))
    cdf = grid.select("day", "k", F.sum(pmf).over(order).alias("cdf"))
    return cdf.groupBy("day").agg(F.count_if(F.col("cdf") <= cutoff).cast("int").alias("qmin"), F.count_if(F.col("cdf") <= 1 - cutoff).cast("int").alias("qmax"))


def clock_outliers(samples: DataFrame, rate: float, cutoff: float, origin: date = date(2019, 12, 1), date_col: str = "coldate", count_col: str = "n_features", maxtime: int | None = 1000) -> DataFrame:
    """Adds day, qmin, qmax and outlier: more features than qmax, or not more than qmin. A cutoff of 0 rejects none. Days
    after ``maxtime`` have its limits; None lets the limits grow on."""
    dated = samples.withColumn("day", F.datediff(F.col(date_col), F.lit(origin)))
    if cutoff <= 0:
        return dated.withColumns({"qmin": F.lit(None).cast("int"), "qmax": F.lit(None).cast("int"), "outlier": F.lit(False)})
    limits = clock_thresholds(dated.where("day is not null"), rate, cutoff, maxtime)
    out = (F.col(count_col) > F.col("qmax")) | (F.col(count_col) <= F.col("qmin"))
    return dated.join(limits, "day", "left").withColumn("outlier", F.coalesce(out, F.lit(False)))


def drop_missing(samples: DataFrame, tolerance: int = MAX_MISSING, col: str = "missing") -> DataFrame:
    return samples.where(X.total_missing(F.col(col)) <= tolerance)


def drop_unclassified(samples: DataFrame, col: str = "lineage") -> DataFrame:
    return samples.where(F.col(col).isNotNull() & ~F.col(col).isin("", "None"))


def qc_strict(df: DataFrame, header: str, sequence: str, accession: str, date_col: str, max_ambiguous: float = MAX_AMBIGUOUS, min_length: int = MIN_LENGTH, nonhuman: str = r"(?i)/(bat|pangolin|mink|cat|dog|env|tiger)/", mangled: str = r"[^ -~]|\|\||^\|", window: tuple[date, date] = (date(2019, 12, 1), date(2099, 1, 1))) -> DataFrame:
    """(accession, reason): the first failing rule of the stricter check; of rows with one accession the first by header
    is kept."""
    s = F.upper(F.col(sequence))
    ambiguous = F.length(s) - F.length(F.regexp_replace(s, r"[N?]|^-+|-+$", ""))
    d = X.parse_iso(F.col(date_col))
    early = F.when(F.col(header).rlike(nonhuman), "nonhuman").when(F.length(s) < min_length, "short").when(ambiguous > F.length(s) * max_ambiguous, "ambiguous").when(F.col(header).rlike(mangled), "mangled")
    late = F.when(d.isNull() | ~d.between(F.lit(window[0]), F.lit(window[1])), "baddate")
    # sequences are judged where they are; the window moves headers and verdicts only
    judged = df.select(F.col(accession).alias("accession"), F.col(header).alias("#header"), early.alias("#early"), late.alias("#late"))
    again = F.when(F.row_number().over(Window.partitionBy("accession").orderBy("#header")) > 1, "duplicate")
    return judged.select("accession", F.coalesce("#early", again, "#late").alias("reason"))


def reason_lists(judged: DataFrame) -> DataFrame:
    """(reason, accession): the rejected rows of every reason, in order over all partitions; rows, so that no list is one
    value or one task."""
    return judged.where("reason is not null").select("reason", "accession").repartitionByRange("reason", "accession").sortWithinPartitions("reason", "accession")


def edges_within(edges: DataFrame, max_dist: float | None = None, default: float = 2.0, col: str = "dist") -> DataFrame:
    """Edges up to a distance; without one, up to ``default`` or the largest there is, whichever is less."""
    if max_dist is not None:
        return edges.where(F.col(col) <= max_dist)
    top = edges.agg(F.least(F.lit(default), F.max(col)).alias("top"))
    return edges.join(F.broadcast(top), F.col(col) <= F.col("top")).drop("top")  # one row


def in_window(df: DataFrame, start: date, end: date, first: str, last: str | None = None) -> DataFrame:
    """Rows whose interval overlaps [start, end] (or whose date lies in it)."""
    if start > end:
        raise ValueError("the start lies after the end")
    return df.where(F.col(first).between(F.lit(start), F.lit(end)) if last is None else (F.col(first) <= F.lit(end)) & (F.col(last) >= F.lit(start)))


def match_text(df: DataFrame, term: str, col: str) -> DataFrame:
    """Rows whose text, or any of whose texts, contains the term."""
    is_array = df.schema[col].dataType.typeName() == "array"
    return df.where(F.exists(col, lambda x: F.contains(x, F.lit(term))) if is_array else F.contains(F.col(col), F.lit(term)))


def points_of(points: DataFrame, selected: DataFrame, key: str = "label") -> DataFrame:
    """Points that share any label with a selection."""
    return points.join(selected.select(key).distinct(), key, "left_semi")
