"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps one failure bit per rule and the measurements. Policies are
versioned bit masks over the ledger, so changing a policy or measuring an ablation never reads a text again.

Defined results: a null or empty text has no words and fails ``few_words``; repeated rows are judged one by one; extra
columns of the input are not touched; very long texts are measured whole; rows with one id are rows of their own; an empty table
gives an empty ledger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Rules by bit, in order. Each takes the measurements of a ledger row as columns.
RULES = ("few_words", "repeated_words", "word_length", "symbols", "shouting", "exclamation", "duplicate_lines", "bars")
BITS = {name: 1 << i for i, name in enumerate(RULES)}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_bangs", "n_bars")
#: Thresholds of the rules; ratios are kept as integers over 100.
THRESHOLDS = {"min_words": 20, "max_repeat": 30, "min_word_chars": 2, "max_word_chars": 20, "max_symbols": 25, "max_upper": 60, "max_bangs": 25, "max_dup_lines": 50, "max_bars": 25}
#: version -> rules that reject.
POLICIES = {"v1": ("few_words", "repeated_words"), "v2": RULES}
BASE = BITS["few_words"] | BITS["repeated_words"]
_SYMBOLS = b"#*$%&|<>"


def _rank(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dense numbers of the pairs (a, b)."""
    return np.unique(a.astype(np.int64) * (int(b.max()) + 1) + b, return_inverse=True)[1]


def repeat_words(words: list[bytes], window: int = 8) -> int:
    """Words that lie in windows of ``window`` words found twice or more in the text. ``window`` is a power of two."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[bytes, int] = {}
    r = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) > n - window:  # too few repeats for two windows to be equal
        return 0
    step = 1
    while step < window:  # rank of windows of 2, 4, 8 words from the ranks of their halves
        r = _rank(r[:-step], r[step:])
        step *= 2
    again = np.bincount(r)[r] > 1
    if not again.any():
        return 0
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one whole text, in the order of MEASURES."""
    t = text or ""
    b = t.encode("utf-8", "surrogatepass")
    words = b.split()
    seen: set[str] = set()
    dup = lines = 0
    for line in t.split("\n"):
        if line and line.strip(" \t\n\x0b\x0c\r"):
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    blank = sum(map(b.count, (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")))
    symbols = sum(b.count(_SYMBOLS[i : i + 1]) for i in range(len(_SYMBOLS)))
    codes = np.frombuffer(b, np.uint8)
    upper = int(((codes >= 65) & (codes <= 90)).sum())
    lower = int(((codes >= 97) & (codes <= 122)).sum())
    return (len(words), len(t) - blank, symbols, dup, repeat_words(words), lines, upper, upper + lower, b.count(b"!!"), b.count(b"|"))


def evaluate(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The ledger: id, measurements, failure_bits. One row per input row, whole texts, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([measure(t) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(rows[:, i]) for i in range(len(MEASURES)))], names=[id_col, *MEASURES])

    kind = docs.schema[id_col].dataType.simpleString()
    measured = docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{m} bigint" for m in MEASURES))
    return measured.withColumn("failure_bits", failure_bits())


def failure_bits(limits: dict[str, int] = THRESHOLDS, columns: dict[str, Column] | None = None) -> Column:
    """All rules over the measurements, one bit each."""
    c = columns or {m: F.col(m) for m in MEASURES}
    fails = {
        "few_words": c["n_words"] < limits["min_words"],
        "repeated_words": c["n_repeat_words"] * 100 > c["n_words"] * limits["max_repeat"],
        "word_length": (c["n_words"] > 0) & ((c["word_chars"] < c["n_words"] * limits["min_word_chars"]) | (c["word_chars"] > c["n_words"] * limits["max_word_chars"])),
        "symbols": (c["n_symbols"] - c["n_bars"]) * 100 > c["n_words"] * limits["max_symbols"],
        "shouting": c["n_upper"] * 100 > c["n_letters"] * limits["max_upper"],
        "exclamation": c["n_bangs"] * 100 > c["n_words"] * limits["max_bangs"],
        "duplicate_lines": (c["n_lines"] > 3) & (c["n_dup_lines"] * 100 > c["n_lines"] * limits["max_dup_lines"]),
        "bars": c["n_bars"] * 100 > c["n_words"] * limits["max_bars"],
    }
    bits = F.lit(0).cast("long")
    for name in RULES:
        bits = bits.bitwiseOR(F.when(fails[name], F.lit(BITS[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def policy_mask(version: str, policies: dict[str, tuple[str, ...]] = POLICIES) -> int:
    return sum(BITS[r] for r in policies[version])


def apply_policy(ledger: DataFrame, version: str = "v2") -> DataFrame:
    """Adds base_failed and kept; kept means that no rule of the policy failed."""
    bits = F.col("failure_bits")
    base = bits.bitwiseAND(F.lit(BASE)) != 0
    return ledger.withColumns({"base_failed": base, "kept": ~base & (bits.bitwiseAND(F.lit(policy_mask(version))) == 0)})


def keep(docs: DataFrame, version: str = "v2", text_col: str = "text") -> DataFrame:
    """The documents that a policy keeps, with all their columns, judged where they are read: the ledger rides along and
    no join brings it back."""
    names = docs.columns
    at, ledger_name = names.index(text_col), "#ledger" + "#" * max(map(len, names))  # a name that is free
    joined = T.StructType([*docs.schema.fields, T.StructField(ledger_name, T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.array([measure(t) for t in batch.column(at).to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns, rows], names=[*names, ledger_name])

    ledger = docs.mapInArrow(run, joined)
    columns = {m: F.element_at(F.col(f"`{ledger_name}`"), i + 1) for i, m in enumerate(MEASURES)}
    kept = ledger.where(failure_bits(columns=columns).bitwiseAND(F.lit(policy_mask(version) | BASE)) == 0)
    return kept.select(*(F.col(f"`{n}`") for n in names))


def ablation(ledger: DataFrame, version: str = "v2") -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail it alone (kept if the rule went), and the bits of the
    other rules seen with it. One aggregate per rule over the ledger's bits; no text is read."""
    mask = policy_mask(version)
    hit = F.col("failure_bits").bitwiseAND(F.lit(mask))
    rules = ledger.sparkSession.createDataFrame([(r, BITS[r]) for r in POLICIES[version]], "rule string, bit bigint")
    by_bits = ledger.groupBy(hit.alias("bits")).agg(F.count("*").alias("n"))  # at most one row per bit pattern
    return (
        by_bits.join(F.broadcast(rules), by_bits.bits.bitwiseAND(rules.bit) != 0)  # the rules are a fixed short list
        .groupBy("rule")
        .agg(F.sum("n").alias("failed"), F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n")).otherwise(0)).alias("failed_alone"), F.bit_or(F.col("bits").bitwiseXOR(F.col("bit"))).alias("seen_with"))
    )
