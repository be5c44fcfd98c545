"""Query catalog: one Spark query per operator of the inventory, keyed
``<id>_<name>``, plus its DuckDB twin where the operator can be written in SQL.

Each query takes (spark, sf_dir) and returns a DataFrame over the whole tables.
Doubles are rounded to 6 digits on both sides (the oracle compares values exactly).
"""
from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql.strip()
        return fn
    return deco


def load_all() -> None:
    from . import q_flagship, q_text, q_tabular  # noqa: F401
    for mod in ("q_vectors", "q_models", "q_ml", "q_sources", "q_more", "q_edge", "q_degenerate", "q_further", "q_boosting"):
        try:
            __import__(f"{__package__}.{mod}")
        except ModuleNotFoundError as e:  # modules added as coverage grows
            if mod not in str(e):
                raise
