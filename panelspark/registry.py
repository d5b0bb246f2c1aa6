"""Registered queries of the panel engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelspark.operators import book, paths, significance
from panelspark.plans import audits, catalog, gauntlet, ledgers, sleeves, studies
from panelspark.sources import feeds, store
from panelspark.sources.panels import PanelQuery, oracle, run_query
from panelspark.streaming import bars


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks to bars, grid, reversal scores, neutral weights, equity and metrics."""
    return book.flagship_sql().run(spark, sf_dir)


def _named() -> dict[str, PanelQuery | str]:
    return catalog.all_sql() | audits.all_sql() | sleeves.all_sql() | studies.all_sql() | studies.bench_sql()


def _query(query: PanelQuery | str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_query(spark, sf_dir, query)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _query(query) for name, query in _named().items()} | feeds.queries() | store.queries() | significance.queries() | paths.queries() | ledgers.queries() | gauntlet.queries() | bars.queries()


def oracle_sql() -> dict[str, str]:
    return {name: oracle(query) for name, query in _named().items()} | feeds.oracle_sql() | store.oracle_sql() | significance.oracle_sql() | paths.oracle_sql() | ledgers.oracle_sql() | bars.oracle_sql()
