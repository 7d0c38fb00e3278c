"""The catalogue of queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sievewright.plans import diff_queries, io_queries, relational_queries, score_queries, star_queries, text_queries

_PARTS = (relational_queries, text_queries, diff_queries, score_queries, star_queries, io_queries)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
SQL: dict[str, str] = {k: v for p in _PARTS for k, v in p.SQL.items()}


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return QUERIES["flagship_training_rows"](spark, sf)
