"""Whole builds and runs over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.catalog.base import CASES, cases, table
from sparkloom.operators import build
from sparkloom.operators import cases as inputs
from sparkloom.plans import algebra
from sparkloom.plans.algebra import Op, ops_literal

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _train(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A customer as spec, their orders as instructions and the lines of them as codes; every seventh line is listed."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("spec_id"), F.col("o_orderkey").alias("instruction_id"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("instruction_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("code_id"), F.col("l_returnflag").alias("style"), "l_linenumber")
    codes = lines.join(orders, "instruction_id").groupBy("spec_id", "code_id", "l_linenumber").agg(F.min("style").alias("style"))  # some lines are there twice
    listed = codes.where("l_linenumber = 7").select("code_id", F.lit("long match").alias("reason"))
    return orders, codes.drop("l_linenumber"), listed


_BUILD = """c AS (SELECT o_custkey AS s, l_orderkey * 10 + l_linenumber AS id, min(l_returnflag) AS st, l_linenumber AS ln FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY s, st ORDER BY sha256('13' || chr(0) || id)) AS p FROM c WHERE ln <> 7), k AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p, st) AS pick FROM r),
i AS (SELECT o_custkey AS s, o_orderkey AS o, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pick FROM orders), n AS (SELECT s, count(*) AS n FROM i GROUP BY 1)"""


@query(f"WITH {_BUILD} SELECT i.s AS spec_id, o AS instruction_id, id AS code_id, st AS style FROM i JOIN k USING (s, pick)")
def train_build(spark, sf_dir):
    return build.train_build(*_train(spark, sf_dir), 13)[0].select("spec_id", "instruction_id", "code_id", "style")


@query(f"""WITH {_BUILD} SELECT s AS spec_id, id::VARCHAR AS id, 'long match' AS reason FROM c WHERE ln = 7 UNION ALL SELECT k.s, id::VARCHAR, 'not needed' FROM k LEFT JOIN n USING (s) WHERE pick > coalesce(n, 0)
UNION ALL SELECT i.s, o::VARCHAR, 'no code' FROM i LEFT JOIN k USING (s, pick) WHERE k.id IS NULL""")
def train_rejects(spark, sf_dir):
    return build.train_build(*_train(spark, sf_dir), 13)[1]


@query("SELECT * FROM (VALUES ('repeated code_id', CAST(0 AS BIGINT)), ('repeated instruction_id', 0), ('foreign spec', 0)) t(problem, n)")
def train_build_problems(spark, sf_dir):
    instructions, codes, listed = _train(spark, sf_dir)
    return build.build_problems(build.train_build(instructions, codes, listed, 13)[0], instructions)


@query(None)
def quota_in_order(spark, sf_dir):
    """Sources take up to fifty documents each, by number, of texts no source before them has taken."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.sha2("text", 256).alias("code"))
    return build.take_in_order(d.where("source IS NOT NULL"), "source", "doc_id", "code", 50).select("source", "doc_id", "n")


@query(f"""WITH {CASES}, t AS (SELECT k, list_concat(list_concat([1], list_transform(xs, lambda x: x + 200)), CASE WHEN k = 10 THEN [3, 3] ELSE [3] END).list_concat([k + 1000, 2]) AS ids FROM cases),
p AS (SELECT k, len(ids) AS n, list_position(ids, 3) AS mark, CASE WHEN len(ids) > 9 THEN 'long' WHEN k = 10 THEN 'target' END AS problem FROM t)
SELECT k, count(*) FILTER (WHERE problem IS NULL) AS records, count(*) FILTER (WHERE problem IS NOT NULL) AS rejects, CAST(sum(n) FILTER (WHERE problem IS NULL) AS BIGINT) AS tokens,
  CAST(sum(n - mark) FILTER (WHERE problem IS NULL) AS BIGINT) AS supervised, CAST(min(n) FILTER (WHERE problem IS NULL) AS INT) AS shortest, CAST(max(n) FILTER (WHERE problem IS NULL) AS INT) AS longest FROM p GROUP BY k""")
def training_set_stats(spark, sf_dir):
    """Start, list, target mark (twice for the last k, an error), answer and end, in a context of nine."""
    c = cases(spark, sf_dir).select("k", F.expr("concat(array(1L), transform(xs, x -> x + 200), IF(k = 10, array(3L, 3L), array(3L)), array(cast(k + 1000 as bigint), 2L))").alias("ids"))
    return build.training_stats(build.training_set(c, "ids", 1, 2, 3, 9), "k")


_BOUNDARY = {"s0": (Op("filter", "positive"),), "s1": (Op("map", "abs"), Op("filter", "negative")), "s2": (Op("map", "square"), Op("filter", "lt_k"), Op("filter", "zero")), "s3": (Op("order", "reverse"),), "s4": (Op("filter", "multiple_of_k"), Op("slice", "every_other")), "s5": (Op("filter", "even"), Op("filter", "odd"))}


@query("SELECT * FROM (VALUES ('s0', 'targeted', NULL), ('s1', 'targeted', NULL), ('s2', 'targeted', NULL), ('s3', 'unreachable', 'no filter'), ('s4', 'targeted', NULL), ('s5', 'targeted', NULL), ('s6', 'unreachable', 'no input of the domain empties the filter')) t(spec_id, status, reason)")
def boundary_manifest(spark, sf_dir):
    """s6 doubles and keeps even numbers, which no one-element input fails."""
    many = _BOUNDARY | {"s6": (Op("map", "mul_const", 2), Op("filter", "even"))}
    specs = spark.sql(" UNION ALL ".join(f"SELECT '{s}' AS spec_id, {ops_literal(o)} AS ops" for s, o in many.items()))
    none = spark.createDataFrame([], "xs array<bigint>, k int")
    return build.boundary_manifest(specs, inputs.targeted(specs, list(range(-algebra.MAX_ABS, algebra.MAX_ABS + 1)), list(range(1, algebra.MAX_K + 1)), none)).select("spec_id", "status", "reason")


_RUNS = "r AS (SELECT event_type AS model, CASE WHEN event_type = 'purchase' AND user_id % 2 = 0 THEN 'b' ELSE 'a' END AS run, event_id AS question, coalesce(value > 50, false) AS passed FROM events)"


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    run = F.when((F.col("event_type") == "purchase") & (F.col("user_id") % 2 == 0), "b").otherwise("a")
    runs = e.select(F.col("event_type").alias("model"), run.alias("run"), F.lit(0.8).alias("temperature"), F.col("event_id").alias("question"), F.coalesce(F.col("value") > 50, F.lit(False)).alias("passed"))
    return build.merge_runs(runs, spark.createDataFrame([("view",)], "model string"), ["temperature"], 1)


@query(f"WITH {_RUNS} SELECT model, count(DISTINCT question) AS questions, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE passed) / count(DISTINCT question) AS rate FROM r WHERE model <> 'view' GROUP BY 1")
def runs_merged(spark, sf_dir):
    return _runs(spark, sf_dir)[0]


@query(f"WITH {_RUNS}, p AS (SELECT model, count(DISTINCT run) AS n, count(DISTINCT question) AS q FROM r WHERE model <> 'view' GROUP BY 1) SELECT model, CASE WHEN n > 1 THEN 'several runs' ELSE 'question count' END AS problem FROM p WHERE n > 1 OR q <> 1")
def runs_merge_problems(spark, sf_dir):
    return _runs(spark, sf_dir)[1]
