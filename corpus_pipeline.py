"""A corpus pipeline of four stages: quality rules, toxicity, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; ``run`` writes each one as Parquet in the shared folder and
reads it back as the next one's ``docs``. All but the last return the columns of ``documents``.

Defined results: a null or empty text has too few words and goes in the first stage; of rows with equal texts, and of near
duplicates, that with the least id stays (null ids are rows like others); texts of any length pass whole; an empty table gives no
rows; extra columns stay, whatever their names, until packing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from genosieve.llm import packing, quality, simhash, toxicity
from genosieve.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep(docs)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [("quality_rules", quality_rules), ("toxicity", toxic_documents), ("near_duplicates", near_duplicates), ("packing", pack)]

#: No stage can be expressed in SQL from end to end (string kernel, fingerprints, online packing); tests hold it against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
