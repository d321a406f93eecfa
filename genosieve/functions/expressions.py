"""Column expressions: names, dates, locations, feature keys and rebuilt sequences. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Bases whose pairs of letters stand for amino acids in T, C, A, G order, third base fastest.
_BASES = "TCAG"
_AMINO = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"


def clean_name(c: Column | str) -> Column:
    """Trimmed; commas and bars become underscores."""
    return F.regexp_replace(F.trim(c), r"[,|]", "_")


def fasta_name(c: Column | str, accession: Column | str) -> Column:
    """Blanks become underscores, quotes are doubled, the accession follows a fixed mark."""
    return F.concat(F.regexp_replace(F.regexp_replace(c, " ", "_"), "'", "''"), F.lit("__accession__"), accession)


def parse_iso(c: Column | str) -> Column:
    """y-m-d as a date, null if it is none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(c, "yyyy-M-d"))


def parse_label(c: Column | str) -> tuple[Column, Column]:
    """(country, date) of ``a/country/...|accession|ymd``; the date is null if a part of it is missing."""
    parts, last = F.split(c, r"\|"), F.element_at(F.split(c, r"\|"), -1)
    return F.try_element_at(F.split(parts[0], "/"), F.lit(2)), F.when(F.size(F.split(last, "-")) == 3, parse_iso(last))


def year_fraction(d: Column | str) -> Column:
    return F.year(d) + (F.dayofyear(d) - 1) / F.lit(365.25)


def date_to_axis(d: Column | str, earliest: Column | str) -> Column:
    return F.datediff(d, earliest) / F.lit(365.25)


def date_to_scaled_axis(d: Column | str, first: Column | str, earliest: Column | str, latest: Column | str, x: Column | str) -> Column:
    """The older form: days since the first tip's date over a third of all tips' span, from that tip's place on."""
    return F.datediff(d, first) / (F.datediff(latest, earliest) / F.lit(3.0)) + (F.col(x) if isinstance(x, str) else x)


def axis_to_date(x: Column | str, earliest: Column | str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.date_add(earliest, F.round(x * 365.25).cast("int"))


def normalize_key(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(c, r"[^A-Za-z0-9]", ""))


def display_class(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.startswith("XBB"), "XBB Lineages").when(c.startswith("X"), "Other Recombinants").otherwise("Non-Recombinants")


def short_label(c: Column | str) -> Column:
    """``virus/X/Y/20nn`` -> ``X/Y``."""
    return F.regexp_replace(c, r"^[^/]+/(.+)/20[0-9]{2}$", "$1")


def split_location(c: Column | str) -> tuple[Column, Column]:
    parts = F.split(c, " / ")
    return parts[0], F.try_element_at(parts, F.lit(2))


def sample_label(*cols: Column | str) -> Column:
    return F.concat_ws("|", *cols)


def variant_key(features: Column | str) -> Column:
    """Features sorted by (typ, pos, alt) as ``typ|pos|alt`` joined by commas."""
    return F.array_join(F.transform(F.array_sort(features), lambda f: F.concat_ws("|", f["typ"], f["pos"].cast("string"), f["alt"])), ",")


def parse_key(key: Column | str) -> Column:
    """The features of a key; an empty key has none."""
    key = F.col(key) if isinstance(key, str) else key
    parts = F.transform(F.split(key, ","), lambda f: F.split(f, r"\|"))
    return F.when(key == "", F.array().cast("array<struct<typ:string,pos:int,alt:string>>")).otherwise(F.transform(parts, lambda p: F.struct(p[0].alias("typ"), p[1].cast("int").alias("pos"), p[2].alias("alt"))))


def total_missing(intervals: Column | str) -> Column:
    return F.aggregate(intervals, F.lit(0), lambda a, x: a + x["right"] - x["left"])


def apply_features(features: Column | str, missing: Column | str, ref: Column | str) -> Column:
    """A reference with missing stretches as N, then substitutions and deletions; insertions are passed over."""
    def blank(s: Column, x: Column) -> Column:
        n = x["right"] - x["left"]
        return F.overlay(s, F.repeat(F.lit("N"), n), x["left"] + 1, n)

    def change(s: Column, f: Column) -> Column:
        n = F.when(f["typ"] == "-", f["alt"].try_cast("int")).otherwise(1)
        return F.when(f["typ"] == "~", F.overlay(s, f["alt"], f["pos"] + 1, F.lit(1))).when(f["typ"] == "-", F.overlay(s, F.repeat(F.lit("-"), n), f["pos"] + 1, n)).otherwise(s)

    ref = F.col(ref) if isinstance(ref, str) else ref
    return F.aggregate(features, F.aggregate(missing, ref, blank), change)


def symmetric_difference(a: Column | str, b: Column | str) -> Column:
    return F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))


def codon_table() -> list[tuple[str, str]]:
    """(codon, amino acid) of the standard code, with the two codes for gaps and unknowns."""
    codes = [a + b + c for a in _BASES for b in _BASES for c in _BASES]
    return [*zip(codes, _AMINO), ("---", "-"), ("XXX", "?")]


def is_accession(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.rlike(r"(?i)^EPI_ISL_[0-9]+$")


def is_iso_date(c: Column | str) -> Column:
    """Year, month 1-12 and day 1-31 in form; the calendar is not asked."""
    c = F.col(c) if isinstance(c, str) else c
    return c.rlike(r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$")
