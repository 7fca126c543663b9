"""A Spark-native retrieval and text-processing engine for bilingual document collections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptorium.queries import flagship as run

    return run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from scriptorium.queries import QUERIES

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from scriptorium.queries import SQL

    return dict(SQL)
