"""Features of aligned sequences: CIGAR strings, protein changes, lineage aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from genosieve.functions import expressions as X


def cigar_operations(sam: DataFrame) -> DataFrame:
    """sam(qname, pos, cigar, seq) -> one row per operation: n, op, qpos (offset in seq), rpos (offset in reference).

    Running offsets are sums over a read's own operations, which are few.
    """
    ops = sam.select("qname", "pos", "seq", F.posexplode(F.regexp_extract_all("cigar", F.lit(r"(\d+[MIDNSHP=X])"))).alias("i", "token"))
    ops = ops.withColumns({"n": F.regexp_extract("token", r"(\d+)", 1).cast("int"), "op": F.expr("right(token, 1)")})
    before = Window.partitionBy("qname").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    q = F.when(F.col("op").isin("M", "=", "X", "I", "S"), F.col("n")).otherwise(0)
    r = F.when(F.col("op").isin("M", "=", "X", "D", "N"), F.col("n")).otherwise(0)
    return ops.withColumns({"qpos": F.coalesce(F.sum(q).over(before), F.lit(0)), "rpos": F.col("pos") + F.coalesce(F.sum(r).over(before), F.lit(0))})


def cigar_align(sam: DataFrame, ref_length: int) -> DataFrame:
    """(qname, aligned): the read laid on the reference, gaps as dashes, insertions and clips left out."""
    piece = F.when(F.col("op").isin("M", "=", "X"), F.expr("substring(seq, cast(qpos + 1 as int), n)")).when(F.col("op").isin("D", "N"), F.expr("repeat('-', n)")).otherwise("")
    parts = cigar_operations(sam).groupBy("qname", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", piece.alias("s")))), lambda x: x["s"]), "").alias("s"))
    return parts.select("qname", F.rpad(F.concat(F.expr("repeat('-', pos)"), F.col("s")), ref_length, "-").alias("aligned"))


def cigar_features(sam: DataFrame, ref_length: int, alphabet: str = "ACGT") -> tuple[DataFrame, DataFrame]:
    """(features(qname, typ, pos, alt), missing(qname, left, right)).

    An X run with an N is missing as a whole, else each of its bases is a substitution or, outside the alphabet, missing;
    insertions and deletions are features; the ends of the reference that a read leaves open are missing.
    """
    ops = cigar_operations(sam).withColumn("bases", F.expr("substring(seq, cast(qpos + 1 as int), n)"))
    blank = (F.col("op") == "X") & F.col("bases").contains("N")
    each = ops.where((F.col("op") == "X") & ~blank).select("qname", "rpos", F.posexplode(F.split("bases", "")).alias("k", "base")).where("base != ''")
    known = F.contains(F.lit(alphabet), F.col("base"))
    at = (F.col("rpos") + F.col("k")).cast("int")
    features = each.where(known).select("qname", F.lit("~").alias("typ"), at.alias("pos"), F.col("base").alias("alt"))
    features = features.unionByName(ops.where("op = 'I'").select("qname", F.lit("+").alias("typ"), F.col("rpos").cast("int").alias("pos"), F.col("bases").alias("alt")))
    features = features.unionByName(ops.where("op = 'D'").select("qname", F.lit("-").alias("typ"), F.col("rpos").cast("int").alias("pos"), F.col("n").cast("string").alias("alt")))
    span = ops.groupBy("qname").agg(F.first("pos").alias("a"), F.max(F.col("rpos") + F.when(F.col("op").isin("M", "=", "X", "D", "N"), F.col("n")).otherwise(0)).alias("b"))
    missing = each.where(~known).select("qname", at.alias("left"), (at + 1).alias("right"))
    missing = missing.unionByName(ops.where(blank).select("qname", F.col("rpos").cast("int").alias("left"), (F.col("rpos") + F.col("n")).cast("int").alias("right")))
    missing = missing.unionByName(span.where("a > 0").select("qname", F.lit(0).alias("left"), F.col("a").cast("int").alias("right")))
    return features, missing.unionByName(span.where(F.col("b") < ref_length).select("qname", F.col("b").cast("int").alias("left"), F.lit(ref_length).alias("right")))


def codons(spark: SparkSession) -> DataFrame:
    """The standard code as a table."""
    return spark.sql("select * from values " + ", ".join(f"('{k}', '{a}')" for k, a in X.codon_table()) + " t(codon, amino)")


def covering(positions: DataFrame, frames: DataFrame, levels: int = 31) -> DataFrame:
    """(pos, o): the first frame (ord, l, orf) that covers a position, l <= pos < r; positions without one have no row.

    A frame is cut into spans of powers of two, at most two a level, and each span keeps its first frame, whatever number of
    frames overlap; a position asks the one span of each level that it lies in. So it is an equi-join of linear tables."""
    level = F.sequence(F.lit(0), F.lit(levels - 1))

    def spans(k: Column) -> Column:
        width = F.pow(F.lit(2.0), k)
        lo, hi = F.ceil(F.col("l") / width).cast("long"), F.floor(F.col("r") / width).cast("long")
        return F.filter(F.array(F.struct(k.alias("level"), lo.alias("span"), (lo < hi) & (lo % 2 == 1)), F.struct(k.alias("level"), (hi - 1).alias("span"), (lo < hi) & (hi % 2 == 1))), lambda s: s["col3"])

    cut = frames.where("l < r and l >= 0").select("ord", "l", "orf", F.explode(F.flatten(F.transform(level, spans))).alias("s"))
    first = cut.groupBy(F.col("s.level").alias("level"), F.col("s.span").alias("span")).agg(F.min(F.struct("ord", "l", "orf")).alias("o"))
    asked = positions.where("pos >= 0").select("pos").distinct().select("pos", F.explode(level).alias("level")).withColumn("span", F.floor(F.col("pos") / F.pow(F.lit(2.0), F.col("level"))).cast("long"))
    return asked.join(first, ["level", "span"]).groupBy("pos").agg(F.min("o").alias("o"))


def annotate(features: DataFrame, orfs: DataFrame, code: DataFrame, ref: str) -> DataFrame:
    """(…, name): protein change of a substitution in a reading frame (the first by ``ord`` where they overlap, then by its
    start), or the place and length of an insertion or deletion; null if nothing changes. Equal features are one row. orfs(ord,
    orf, l, r) may be many; the code has a row per codon."""
    keys, features = features.columns, features.distinct()
    found = covering(features.where("typ = '~'"), orfs).withColumnRenamed("pos", "#pos")
    hit = features.join(found, (F.col("typ") == "~") & (F.col("pos") == F.col("#pos")), "left").drop("#pos")
    number = F.floor((F.col("pos") - F.col("o.l")) / 3).cast("int")
    at = ((F.col("pos") - F.col("o.l")) % 3).cast("int")
    hit = hit.withColumns({"no": number, "at": at}).withColumn("was", F.substring(F.lit(ref), F.col("o.l") + 3 * F.col("no") + 1, F.lit(3)))
    hit = hit.withColumn("now", F.when(F.col("o").isNotNull(), F.overlay("was", "alt", F.col("at") + 1, F.lit(1))))
    a = code.select(F.col("codon").alias("was"), F.col("amino").alias("a1"))
    b = code.select(F.col("codon").alias("now"), F.col("amino").alias("a2"))
    j = hit.join(F.broadcast(a), "was", "left").join(F.broadcast(b), "now", "left")
    place = (F.col("pos") + 1).cast("string")
    name = (
        F.when(F.col("typ") == "+", F.concat_ws(":", F.lit("ins"), place, F.length("alt").cast("string"))).when(F.col("typ") == "-", F.concat_ws(":", F.lit("del"), place, F.col("alt")))
        .when(F.col("a1") != F.col("a2"), F.concat(F.lit("aa:"), F.col("o.orf"), F.lit(":"), F.col("a1"), (F.col("no") + 1).cast("string"), F.col("a2")))
    )
    return j.select(*keys, name.alias("name"))


def resolve_alias(df: DataFrame, alias: DataFrame, col: str = "lineage") -> DataFrame:
    """Adds ``resolved``: the prefix before the first dot replaced by its full name, if it has one."""
    keep = F.lower(F.col(col)).isin("unclassifiable", "unassigned") | F.col(col).startswith("X")
    j = df.withColumn("prefix", F.substring_index(col, ".", 1)).join(alias, "prefix", "left")
    full = F.concat(F.col("full_name"), F.expr(f"substring({col}, length(prefix) + 1)"))
    return j.withColumn("resolved", F.when(keep | F.col("full_name").isNull() | (F.col("full_name") == ""), F.col(col)).otherwise(full)).drop("prefix", "full_name")
