"""All queries of the core, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestrand.plans import corpus, guard, ledger, replies, scans, search, streaming

AREAS = (ledger, search, guard, replies, corpus, scans, streaming)


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return search.search_bm25(spark, folder)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for area in AREAS for name, query in area.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for area in AREAS for name, sql in area.SQL.items()}
