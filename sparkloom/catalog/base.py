"""Shared views of the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.plans.algebra import ATOMIC, canonical_json


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, xs, k): the list of an order's quantities, in -96..100, and a number 1..10."""
    item = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.expr("cast(l_quantity * 4 - 100 as bigint)").alias("x"))
    rows = item.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "x"))).alias("s"))
    return rows.select("l_orderkey", F.expr("slice(transform(s, e -> e.x), 1, 20)").alias("xs"), (1 + F.col("l_orderkey") % 10).cast("int").alias("k"))


CASES = """cases AS (SELECT l_orderkey, (list(x ORDER BY l_linenumber, x))[1:20] AS xs, CAST(1 + l_orderkey % 10 AS INT) AS k
  FROM (SELECT l_orderkey, l_linenumber, CAST(l_quantity * 4 - 100 AS BIGINT) AS x FROM lineitem) GROUP BY l_orderkey)"""

#: The atomic operations as SQL values: pos, op.
ATOMIC_VALUES = "atomic(pos, op) AS (VALUES " + ", ".join(f"({i}, '{canonical_json(o.ast())}')" for i, o in enumerate(ATOMIC, 1)) + ")"
#: Scored candidates from events: question, candidate, model, category, size, passed.
SCORED = """scored AS (SELECT user_id AS question, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS candidate, event_type AS category,
  CAST(1 + user_id % 3 AS INT) AS n_ops, value > 50 AS passed, value, event_id, ts FROM events)"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("question"), F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("candidate"), F.col("event_type").alias("category"),
        (1 + F.col("user_id") % 3).cast("int").alias("n_ops"), (F.col("value") > 50).alias("passed"), "value", "event_id", "ts",
    )
