"""All registered queries of the engine's own operators, and their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_MODULES = ("filters", "expressions", "joins", "aggregates", "ranking", "sets", "trees", "beads", "extended", "serving", "incremental", "inputs", "models")


def register(sql: str | None = None, dates: str = "") -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the DuckDB SQL of its result. Dates are given out as text, so
    that both engines' results compare alike; ``dates`` names those columns in the SQL."""

    def wrap(f: Query) -> Query:
        def as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            return df.withColumns({c: F.col(c).cast("string") for c, kind in df.dtypes if kind == "date"})

        QUERIES[f.__name__] = as_text
        if sql:
            SQL[f.__name__] = f"select * replace ({', '.join(f'cast({c} as varchar) as {c}' for c in dates.split())}) from ({sql})" if dates else sql
        return f

    return wrap


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"genosieve.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
