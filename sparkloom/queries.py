"""Queries over the supplied tables, one or more for each operator, and SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkloom.catalog import algebra, analytics, builds, dataset

_ALL = {**algebra.QUERIES, **dataset.QUERIES, **analytics.QUERIES, **builds.QUERIES}

entry = algebra.entry


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for name, (run, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
