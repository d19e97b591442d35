"""Query names, their DataFrames and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import backtest_queries, build_queries, catalog_queries, factor_queries, portfolio_queries, research_queries, strategy_queries

GROUPS = [factor_queries, catalog_queries, strategy_queries, backtest_queries, portfolio_queries, research_queries, build_queries]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for g in GROUPS for k, f in g.QUERIES.items()}
ORACLE: dict[str, str] = {k: s for g in GROUPS for k, s in g.ORACLE.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_queries.QUERIES["factor_rank"](spark, sf_dir)
