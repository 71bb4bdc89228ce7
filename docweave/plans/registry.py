"""All named queries of the engine, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a plan under its function's name; sql is the same result in DuckDB's dialect."""

    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _load() -> None:
    from docweave.plans import contents_plans, dedup_plans, edit_plans, html_plans, join_plans, level_plans, order_plans, quality_plans, report_plans, rule_plans, search_plans, shape_plans, store_plans, text_plans  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def FLAGSHIP(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every benchmark item the ten best documents by BM25, with a grade."""
    return queries()["bm25_top10"](spark, sf_dir)
