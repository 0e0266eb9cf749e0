"""Specs: enumerated sequences of operations, their patterns, containment and splits (all as joins and windows)."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions.hashing import sha
from sparkloom.plans.algebra import ATOMIC, canonical_json

#: Counts of a split by number of operations, fixed values: train, validation, test.
QUOTAS = {1: (24, 0, 0), 2: (434, 54, 54), 3: (9188, 1148, 1148)}


def atomic_table(spark: SparkSession) -> DataFrame:
    """(pos, spec_id, op): the 24 atomic operations in order, op as canonical JSON."""
    return spark.createDataFrame([(i, f"atomic-{i:06d}", canonical_json(o.ast())) for i, o in enumerate(ATOMIC, 1)], "pos int, spec_id string, op string")


def permutations(items: DataFrame, most: int = 3) -> DataFrame:
    """All ordered sequences of 1 to ``most`` distinct items (pos, op), numbered by (length, positions).

    The product is the result itself: n + n(n-1) + n(n-1)(n-2) rows of a small dimension table.
    """
    one = F.broadcast(items.select(F.col("pos").alias("p"), F.col("op").alias("o")))
    step = items.select(F.array("pos").alias("ps"), F.array("op").alias("ops"))
    out = step
    for _ in range(most - 1):
        step = step.join(one, ~F.array_contains("ps", F.col("p"))).select(F.array_append("ps", F.col("p")).alias("ps"), F.array_append("ops", F.col("o")).alias("ops"))
        out = out.unionByName(step)
    return numbered(out, "combined")


def numbered(specs: DataFrame, prefix: str) -> DataFrame:
    """Adds n_ops, number, spec_id and the canonical AST to (ps, ops)."""
    w = W.orderBy("n_ops", "ps")
    out = specs.withColumn("n_ops", F.size("ps")).withColumn("number", F.row_number().over(w))
    return out.withColumn("spec_id", F.concat(F.lit(f"{prefix}-"), F.lpad(F.col("number").cast("string"), 6, "0"))).withColumn("ast", ast_json("ops"))


def ast_json(ops: str) -> Column:
    """Canonical JSON of an array of operations, each canonical already."""
    return F.expr(f"CASE WHEN size({ops}) = 1 THEN {ops}[0] ELSE concat('{{\"sequence\":[', array_join({ops}, ','), ']}}') END")


def repetitions(items: DataFrame) -> DataFrame:
    """AA, AAB, BAA and AAA of all items (pos, op): first AA, then AAB and BAA a pair, then AAA, each in the items' order."""
    a = items.select(F.col("pos").alias("a"), F.col("op").alias("x"))
    b = F.broadcast(items.select(F.col("pos").alias("b"), F.col("op").alias("y")))
    pairs = a.join(b, F.col("a") != F.col("b"))
    parts = [
        a.select(F.lit(1).alias("block"), "a", F.lit(0).alias("b"), F.lit(0).alias("v"), F.array("x", "x").alias("ops")),
        pairs.select(F.lit(2).alias("block"), "a", "b", F.lit(0).alias("v"), F.array("x", "x", "y").alias("ops")),
        pairs.select(F.lit(2).alias("block"), "a", "b", F.lit(1).alias("v"), F.array("y", "x", "x").alias("ops")),
        a.select(F.lit(3).alias("block"), "a", F.lit(0).alias("b"), F.lit(0).alias("v"), F.array("x", "x", "x").alias("ops")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumn("number", F.row_number().over(W.orderBy("block", "a", "b", "v")))
    return out.withColumn("pattern", pattern("ops")).withColumn("spec_id", F.concat(F.lit("repetition-"), F.lpad(F.col("number").cast("string"), 6, "0"))).withColumn("ast", ast_json("ops"))


def pattern(ops: str) -> Column:
    """AA, AAB, BAA or AAA; anything else raises."""
    o = [f"{ops}[{i}]" for i in range(3)]
    return F.expr(
        f"CASE WHEN size({ops}) = 2 AND {o[0]} = {o[1]} THEN 'AA' WHEN size({ops}) = 3 AND {o[0]} = {o[1]} AND {o[1]} = get({ops}, 2) THEN 'AAA' "
        f"WHEN size({ops}) = 3 AND {o[0]} = {o[1]} THEN 'AAB' WHEN size({ops}) = 3 AND {o[1]} = get({ops}, 2) THEN 'BAA' ELSE raise_error('no repetition') END"
    )


def containment(specs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Specs (spec_id, ops) that contain exactly one of the pairs (pair_id, pair of operations); one with more raises."""
    hit = specs.join(F.broadcast(pairs), F.size(F.array_intersect("pair", "ops")) == 2)
    n = F.count("*").over(W.partitionBy("spec_id"))
    return hit.withColumn("n_pairs", n).withColumn("pair_id", F.expr("CASE WHEN n_pairs = 1 THEN pair_id ELSE cast(raise_error('a spec contains several pairs') as int) END")).drop("n_pairs")


def containment_audit(extracted: DataFrame, expected: DataFrame) -> DataFrame:
    """Counts by (pair_id, n_ops) beside the expected (n_ops, expected)."""
    return extracted.groupBy("pair_id", "n_ops").count().join(expected, "n_ops", "left").withColumn("ok", F.col("count").eqNullSafe(F.col("expected")))


def remaining_by_size(specs: DataFrame, taken: DataFrame, key: str = "spec_id", size: str = "n_ops") -> DataFrame:
    """How many specs are left by size once those taken are out."""
    return specs.join(taken.select(key), key, "left_anti").groupBy(size).agg(F.count("*").alias("n"))


def split_by_quota(rows: DataFrame, stratum: str, text: str, quotas: Column) -> DataFrame:
    """train, validation or test within each stratum by rank of (sha256(text), text); quotas: array of the first two counts.

    A stratum is cut by the first four digits of the hash into 65,536 pieces, so that few and large strata are ranked by many tasks: ranks run on
    within a piece, and a piece starts from the counts of those before it.
    """
    rows = rows.withColumn("_hash", sha(F.col(text))).withColumn("_piece", F.substring("_hash", 1, 4))
    counts = rows.groupBy(stratum, "_piece").agg(F.count("*").alias("_n"))
    start = F.coalesce(F.sum("_n").over(W.partitionBy(stratum).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col(stratum).alias("_stratum"), F.col("_piece").alias("_p"), start.alias("_start"))
    out = rows.withColumn("_in", F.row_number().over(W.partitionBy(stratum, "_piece").orderBy("_hash", text)))
    out = out.join(starts, F.col(stratum).eqNullSafe(F.col("_stratum")) & (F.col("_piece") == F.col("_p")))
    out = out.withColumn("rank", (F.col("_start") + F.col("_in")).cast("int")).drop("_hash", "_piece", "_stratum", "_p", "_start", "_in")
    return out.withColumn("split", F.when(F.col("rank") <= quotas[0], "train").when(F.col("rank") <= quotas[0] + quotas[1], "validation").otherwise("test"))


def split_by_rate(rows: DataFrame, text: str, train: float, validation: float) -> DataFrame:
    """The same by the hash's place in its range, without a shuffle: shares instead of exact counts."""
    u = F.conv(F.substring(sha(F.col(text)), 1, 8), 16, 10).cast("double") / 2**32
    return rows.withColumn("split", F.when(u < train, "train").when(u < train + validation, "validation").otherwise("test"))


def split_problems(parts: DataFrame, whole: DataFrame, key: str, split: str = "split") -> DataFrame:
    """(problem, n): keys in several splits, missing from the parts, or not in the whole."""
    several = parts.groupBy(key).agg(F.countDistinct(split).alias("n")).where("n > 1")
    missing, foreign = whole.select(key).join(parts.select(key), key, "left_anti"), parts.select(key).join(whole.select(key), key, "left_anti")
    named = [("in several splits", several), ("missing", missing), ("foreign", foreign)]
    out = None
    for name, df in named:
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("problem"), "n")
        out = one if out is None else out.union(one)
    return out


def duplicates(rows: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once, with their counts; empty if unique."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1")


def random_sequences(seed: int, draws: int, length: int = 4) -> list[tuple[int, ...]]:
    """Seeded draws of different atomic positions, repeats left out, in the order drawn. A few thousand; the seed fixes them."""
    rng = random.Random(seed)
    return list(dict.fromkeys(tuple(rng.sample(range(1, len(ATOMIC) + 1), length)) for _ in range(draws)))


def behaviourally_new(candidates: DataFrame, known: DataFrame, shorter: DataFrame, most: int) -> DataFrame:
    """The first ``most`` candidates (place, spec_id, fingerprint) that behave like no known spec, none before them, and none of their own
    sequences with a step left out (``shorter``: spec_id, fingerprint)."""
    new = candidates.join(known.select("fingerprint"), "fingerprint", "left_anti").join(shorter.select("spec_id", "fingerprint"), ["spec_id", "fingerprint"], "left_anti")
    first = new.groupBy("fingerprint").agg(F.min(F.struct("place", "spec_id")).alias("c")).select("c.*", "fingerprint")
    return first.orderBy("place").limit(most)


def inconsistent(subset: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys of the subset that the source lacks or has with other values (null-safe)."""
    s = source.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns])
    differs = F.col("_k").isNull()
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return subset.join(s, subset[key] == s["_k"], "left").where(differs).select(key)
