"""Registered queries of the library: name, function and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import base, graphs, numbers, places, rows, texts

#: Importing the modules registers their queries.
MODULES = (graphs, numbers, places, rows, texts)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(base.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(base.ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.j4_one_to_one(spark, sf_dir)
