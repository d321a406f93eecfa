"""License scans: MinHash bands over overlapping windows of shingles find templates, exact containment confirms them.

Words are lower-cased and stripped of outer punctuation; a shingle is five consecutive words. A template of m shingles is
looked for through windows of w shingles: 8 from 20 shingles on, else 1. Every offset of a template is a window; in
documents, windows start every w/2 (at least 1). A text that holds at least 0.8 of a template's shingles, broken by single
changed words, keeps a run of them that covers one whole window of the grid, which then equals a template window and
meets it in every band; windows with a Jaccard similarity of 0.8 meet in one of three bands with probability 0.992.
Containment over the whole document then decides. Only native expressions are used.

Defined results: null and empty texts match nothing; a template with fewer than five words is one shingle of all its
words; very long texts are scanned whole; a text that holds several templates is a row for
each; rows that are repeated are reported each; an empty table gives no rows; extra columns are not touched.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from genosieve.llm.common import written

SHINGLE, CONTAINMENT, BANDS = 5, 0.8, 3
#: A table of at most so many bytes of candidates may be broadcast.
BROADCAST_BYTES = 8 << 20
CANDIDATE_BYTES = 64
#: (name, text) of short notices that stand in running text.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("GPL-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD-clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
)


def templates_table(spark: SparkSession, templates: tuple[tuple[str, str], ...] = TEMPLATES) -> DataFrame:
    q = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return spark.sql("select * from values " + ", ".join(f"({q(n)}, {q(t)})" for n, t in templates) + " as t(template, text)")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body (or a lambda in it) uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Lower-cased words without outer punctuation; signs that stand alone vanish."""
    clean = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)(?<![\p{L}\p{N}])[^\p{L}\p{N}\s]+|[^\p{L}\p{N}\s]+(?![\p{L}\p{N}])", " ")
    return F.filter(F.split(clean, r"(?U)\s+"), lambda w: w != "")


def _runs(word: Column) -> Column:
    n = F.size(word)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - (SHINGLE - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(word, i, SHINGLE)))
    return F.when(n > 0, runs).otherwise(F.array().cast("array<bigint>"))


def shingles(text: Column) -> Column:
    """Hashes of all runs of five words, in order; of fewer words, the one hash of them all; none of none."""
    return _let(words(text), _runs)


def window(m: Column) -> Column:
    """Shingles of a window for a template of m shingles."""
    return F.when(m >= 20, 8).otherwise(1)


def _keys(h: Column, size: int, step: int) -> Column:
    """Band keys of all windows of ``size`` shingles in steps of ``step``; the last window reaches the end. A window of
    one shingle has one minimum, itself, so one band says all."""
    if size == 1:
        return h
    n = F.size(h)
    last = F.greatest(n - size + 1, F.lit(1))
    starts = F.concat(F.sequence(F.lit(1), last, F.lit(step)), F.array(last))

    def minima(band: int) -> Column:
        mixed = F.transform(h, lambda x: F.xxhash64(x, F.lit(band)))
        return _let(mixed, lambda m: F.transform(starts, lambda s: F.array_min(F.slice(m, s, size))))

    bands = [minima(b) for b in range(BANDS)]
    return F.when(n >= size, F.flatten(F.array(*bands))).otherwise(F.array().cast("array<bigint>"))


def scan(docs: DataFrame, templates: DataFrame, containment: float = CONTAINMENT, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, template, n_shingles, n_found, containment) of every document and template it contains."""
    t = templates.select("template", shingles(F.col("text")).alias("run")).where(F.size("run") > 0)
    t = written(t.select("*", F.array_distinct("run").alias("shingles"), window(F.size("run")).alias("w")), "license-templates")
    sizes = sorted(r.w for r in t.select("w").distinct().collect())  # at most two
    if not sizes:
        return docs.select(F.col(id_col), F.lit("").alias("template"), F.lit(0).cast("long").alias("n_shingles"), F.lit(0).cast("long").alias("n_found"), F.lit(0.0).alias("containment")).where(F.lit(False))
    bands = [t.where(F.col("w") == w).select("template", F.explode(_keys(F.col("run"), w, 1)).alias("key")) for w in sizes]
    bands = reduce(DataFrame.unionByName, bands).distinct()
    mine = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    keys = _let(shingles(F.col("text")), lambda h: F.flatten(F.array(*(_keys(h, w, max(1, w // 2)) for w in sizes))))
    found = mine.select("id", "mark", F.explode(keys).alias("key")).join(bands, "key").select("id", "mark", "template").distinct()
    candidates = written(found, "license-candidates")
    few = candidates.count() * CANDIDATE_BYTES <= BROADCAST_BYTES
    met = mine.alias("d").join((F.broadcast(candidates) if few else candidates).alias("c"), F.col("d.id").eqNullSafe(F.col("c.id")) & (F.col("d.mark") == F.col("c.mark")))
    checked = met.select(F.col("d.id").alias("id"), "template", shingles(F.col("d.text")).alias("h")).join(t.select("template", "shingles"), "template")
    n, both = F.size("shingles"), F.size(F.array_intersect("shingles", "h"))
    return checked.select(F.col("id").alias(id_col), "template", n.cast("long").alias("n_shingles"), both.cast("long").alias("n_found"), (both / n).alias("containment")).where(both >= n * containment)
