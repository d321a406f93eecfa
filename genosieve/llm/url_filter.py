"""URL filters by host-suffix and path-prefix expressions.

A url is expanded into every pair of a host suffix (at label boundaries) and a path prefix that ends with a slash, plus
the empty prefix. A rule is filed under its host and its path up to the last slash. Expressions meet rules by an
equi-join on the first eight hex digits of their SHA-256; the full digest and the rest of the rule's path are then
confirmed, and the longest rule wins (host first, then path; of equal ones a block).

Defined results: a null url or one without ``://`` has an empty host and path and no rule; repeated rows (the same id
and url) each get their row; urls of any length are read whole;
an empty table gives an empty result; extra columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: (host, path, verdict) of the production rules.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
DEFAULT_VERDICT = "allow"
_PREFIX_HEX = 8
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rules_table(spark: SparkSession, rules: tuple[tuple[str, str, str], ...] = RULES) -> DataFrame:
    """A rule table from a short list, as inline rows."""
    q = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join(f"({', '.join(map(q, r))})" for r in rules)
    return spark.sql(f"select * from values {rows} as t(rule_host, rule_path, rule_verdict)")


def host_suffixes(host: Column, labels: int | None = None) -> Column:
    """The host and every suffix of it that starts after a dot, of at most so many labels; none of an empty host."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    first = F.lit(1) if labels is None else F.greatest(F.lit(1), n - labels + 1)
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(first, n), lambda i: F.array_join(F.slice(parts, i, n), ".")))


def path_prefixes(path: Column, slashes: int | None = None) -> Column:
    """The empty prefix and every prefix that ends with a slash, of at most so many slashes."""
    parts = F.split(path, "/", -1 if slashes is None else slashes + 1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.when(i == 1, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, i - 1), "/"), F.lit("/"))))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) per row of ``pages``. Native expressions only.

    A url is expanded only as deep as the deepest rule: nothing deeper can meet one, so the result is the same and a url of
    any length has few expressions. Each row's expressions are aggregated where they were made before they are shuffled by row, so one shuffle moves one
    row per page. The rule side is broadcast by Spark if its known size allows, else joined by a shuffle that adaptive
    execution splits where one host holds many rows.
    """
    filed = rules.select(
        F.translate("rule_host", _UPPER, _LOWER).alias("rule_host"), F.col("rule_path"), F.col("rule_verdict"), F.regexp_extract("rule_path", r"(?s)^(.*/)", 1).alias("folder")
    ).withColumn("rule_digest", F.sha2(F.concat_ws("\n", "rule_host", "folder"), 256))
    filed = filed.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"), F.first("rule_digest").alias("rule_digest"))  # block over allow
    filed = filed.withColumn("prefix", F.substring("rule_digest", 1, _PREFIX_HEX))
    deep = filed.agg(F.max(F.size(F.split("rule_host", r"\."))), F.max(F.length(F.regexp_replace("rule_path", "[^/]", "")))).first()  # one row
    labels, slashes = deep[0] or 1, deep[1] or 0
    url = F.col(url_col)
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url"), url_host(url).alias("host"), url_path(url).alias("path"))
    # repeated rows are counted, so that every one comes back
    pairs = F.flatten(F.transform(host_suffixes(F.col("host"), labels), lambda h: F.transform(path_prefixes(F.col("path"), slashes), lambda p: F.concat(h, F.lit("\n"), p))))
    # a null expression comes first and stands for the row itself
    expressions = rows.select("*", F.explode(F.concat(F.array(F.lit(None).cast("string")), pairs)).alias("expression"))
    digests = expressions.withColumn("digest", F.sha2("expression", 256)).withColumn("short", F.substring("digest", 1, _PREFIX_HEX))
    met = digests.join(filed, digests.short == filed.prefix, "left")
    fits = (F.col("digest") == F.col("rule_digest")) & F.startswith(F.col("path"), F.col("rule_path"))
    best = F.max(F.when(fits, F.struct(F.length("rule_host").alias("a"), F.length("rule_path").alias("b"), "rule_verdict", F.concat("rule_host", "rule_path").alias("rule"))))
    judged = met.groupBy("id", "url", "host", "path").agg(best.alias("best"), F.count(F.when(F.col("expression").isNull(), 1)).alias("copies"))
    judged = judged.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return judged.select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"))
