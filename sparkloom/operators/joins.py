"""Joins of the dataset pipeline: exact one-to-one, positional, balanced, replacement and as-of, as equi-joins and windows.

Windows are partitioned by the spec (a few dozen rows each), so they spread over the cluster; a key with very many rows is
spilled by Spark's window sort, not gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions.hashing import joined_sha, sha


def full_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Counts a key on both sides and ``side``: both, left or right. An exact join has no row that isn't both."""
    a, b = left.groupBy(key).agg(F.count("*").alias("n_left")), right.groupBy(key).agg(F.count("*").alias("n_right"))
    out = a.join(b, key, "full_outer")
    return out.withColumn("side", F.expr("CASE WHEN n_left IS NULL THEN 'right' WHEN n_right IS NULL THEN 'left' ELSE 'both' END"))


def exact_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Inner join that raises where a key is on one side only."""
    a, b = left.withColumn("_l", F.lit(1)), right.withColumn("_r", F.lit(1))
    out = a.join(b, key, "full_outer")
    return out.withColumn("_l", F.expr("IF(_l IS NULL OR _r IS NULL, cast(raise_error('a key is on one side only') as int), 1)")).where("_l = 1").drop("_l", "_r")


def reappearing(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Keys whose rows are not next to each other in the order of ``position``.

    A key is contiguous if its count spans its positions; positions are unique integers. One aggregate, no global order.
    """
    out = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(position).alias("lo"), F.max(position).alias("hi"))
    return out.where("hi - lo + 1 <> n").select(key)


def positional(left: DataFrame, right: DataFrame, key: str, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """The i-th row of a key on the left with the i-th on the right; column ``i`` starts at 1."""
    a = left.withColumn("i", F.row_number().over(W.partitionBy(key).orderBy(*left_order)))
    b = right.withColumn("i", F.row_number().over(W.partitionBy(key).orderBy(*right_order)))
    return a.join(b, [key, "i"])


def balanced(rows: DataFrame, group: str, style: str, rank: Column, needed: Column) -> DataFrame:
    """Adds ``pick`` and ``selected``: rows of a group are taken from the style with the fewest picks so far, by name on ties.

    The r-th row of a style is picked when its style has been picked r - 1 times, so ordering a group by (r, style) gives the picks.
    """
    out = rows.withColumn("_place", F.row_number().over(W.partitionBy(group, style).orderBy(rank)))
    out = out.withColumn("pick", F.row_number().over(W.partitionBy(group).orderBy("_place", style))).drop("_place")
    return out.withColumn("selected", F.col("pick") <= needed)


def assign_distinct(left: DataFrame, right: DataFrame, key: str, left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """``positional``, but each left row must find one: without, it raises."""
    a = left.withColumn("i", F.row_number().over(W.partitionBy(key).orderBy(*left_order)))
    b = right.withColumn("i", F.row_number().over(W.partitionBy(key).orderBy(*right_order))).withColumn("_found", F.lit(True))
    out = a.join(b, [key, "i"], "left")
    return out.withColumn("_found", F.expr("IF(_found IS NULL, cast(raise_error('no code is left for a row') as boolean), true)")).where("_found").drop("_found")


def replace_approved(source: DataFrame, approved: DataFrame, failed: DataFrame, key: str, text: str) -> DataFrame:
    """Each source row with its approved text where there is one, else its own, and ``status``: replaced, failed or retained.

    approved: (key, text); failed: (key, reason). Row for row: the source's count stays. A key in both raises.
    """
    a = approved.select(key, F.col(text).alias("_new"))
    f = failed.select(key, F.coalesce("reason", F.lit("unknown")).alias("_why"))
    out = source.join(a, key, "left").join(f, key, "left")
    both = "_new IS NOT NULL AND _why IS NOT NULL"
    out = out.withColumn("status", F.expr(f"CASE WHEN {both} THEN raise_error('a row is both approved and failed') WHEN _new IS NOT NULL THEN 'replaced' WHEN _why IS NOT NULL THEN concat('failed: ', _why) ELSE 'retained' END"))
    return out.withColumn(text, F.coalesce("_new", text)).drop("_new", "_why")


def replacement_balance(source: DataFrame, replaced: DataFrame, group: str) -> DataFrame:
    """Groups whose row counts differ before and after; empty if the replacement is one to one."""
    return full_match(source, replaced, group).where("NOT (n_left <=> n_right)")


def final_records(pairs: DataFrame) -> DataFrame:
    """Wide records of (spec_id, ast, instruction, test_suite, code_id, code, tests): ids, family, difficulty and hashes."""
    suite = F.when(F.col("test_suite").isNull(), "null").otherwise(F.concat(F.lit('"'), "test_suite", F.lit('"')))
    out = pairs.withColumn("record_id", F.concat(F.lit("record-"), joined_sha("code_id", "instruction", suite, "tests")))
    out = out.withColumn("family_id", F.concat(F.lit("family-"), sha("ast"))).withColumn("text_hash", sha("instruction"))
    return out.withColumn("code_hash", sha("code"))


def derived_suite(records: DataFrame, suite: str, input_set: str) -> DataFrame:
    """The same records under another suite and input set, with new ids and the old one as lineage."""
    out = records.withColumn("derived_from", F.col("record_id")).withColumn("test_suite", F.lit(suite)).withColumn("input_set", F.lit(input_set))
    return out.withColumn("record_id", F.concat(F.lit("record-"), joined_sha("derived_from", "test_suite", "input_set")))


def in_suite(rows: DataFrame, split: str, suite: str | None) -> DataFrame:
    """Rows of a split and suite, where no suite is matched by null only."""
    return rows.where(F.col("split").eqNullSafe(split) & F.col("test_suite").eqNullSafe(F.lit(suite)))


def suite_summary(records: DataFrame, suite: str) -> DataFrame:
    """Records, distinct ids and specs a suite."""
    return records.groupBy(suite).agg(F.count("*").alias("records"), F.countDistinct("record_id").alias("distinct_ids"), F.countDistinct("spec_id").alias("specs"))


def delta(order: DataFrame, fresh: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Fresh rows first, cached ones else, for every key of ``order``, with their ``source``."""
    tagged = fresh.withColumn("source", F.lit("fresh")).unionByName(cached.join(fresh.select(key), key, "left_anti").withColumn("source", F.lit("cached")))
    return order.join(tagged, key, "left")


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str) -> DataFrame:
    """Each left row with the last right ``value`` at or before its ``at``, within ``by``; null if there is none.

    Both sides are stacked and a window carries the last value on: one shuffle on ``by``, linear in the rows, where a join on
    a range would pair every earlier row. Where a group is larger than a task should sort, pass a coarser time bucket in ``by``
    and carry over with ``as_of_bucketed``.
    """
    names = [c for c in left.columns if c not in (*by, at)]
    a = left.select(*by, at, F.lit(1).alias("_side"), F.struct(*names).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    b = right.where(F.col(value).isNotNull()).select(*by, at, F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(value).alias("_value"))
    w = W.partitionBy(*by).orderBy(at, "_side", "_value").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = a.unionByName(b).withColumn(value, F.last("_value", ignorenulls=True).over(w)).where("_side = 1")
    return out.select(*by, at, "_row.*", value)


#: Groups of buckets that ``as_of_bucketed`` carries values over in.
CUTS = 256


def _cuts(buckets: DataFrame, column: str) -> DataFrame:
    """(_group, _from, _until): at most CUTS ranges of a column that hold about as many rows each; CUTS rows, whatever the input."""
    marks = buckets.agg(F.percentile_approx(column, [i / CUTS for i in range(CUTS)], 10_000).alias("m")).select(F.array_sort(F.array_distinct("m")).alias("m"))
    rows = marks.select("m", F.posexplode("m").alias("_group", "_from"))
    return rows.select("_group", "_from", F.expr("get(m, _group + 1)").alias("_until"))


def as_of_bucketed(left: DataFrame, right: DataFrame, at: str, value: str, bucket: Column) -> DataFrame:
    """``as_of`` without a key: rows are sorted within buckets of ``at``, and each bucket starts from the last value of those before.

    ``bucket`` must not decrease in ``at``. A value a bucket is carried over in two levels, within ``CUTS`` groups of buckets and among the groups,
    so no task gets all rows, nor all buckets.
    """
    names = [c for c in left.columns if c != at]
    a = left.select(bucket.alias("_b"), at, F.lit(1).alias("_side"), F.struct(*names).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    b = right.where(F.col(value).isNotNull()).select(bucket.alias("_b"), at, F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(value).alias("_value"))
    whole = a.unionByName(b)
    last = whole.groupBy("_b").agg(F.max(F.when(F.col("_side") == 0, F.struct(at, "_value")))["_value"].alias("_last"))
    # Two levels: buckets are carried over within groups of them by quantiles of their order, and groups among themselves.
    edges = F.broadcast(_cuts(last, "_b"))
    last = last.join(edges, (F.col("_b") >= F.col("_from")) & (F.col("_until").isNull() | (F.col("_b") < F.col("_until")))).drop("_from", "_until")
    inner = F.last("_last", ignorenulls=True).over(W.partitionBy("_group").orderBy("_b").rowsBetween(W.unboundedPreceding, -1))
    ends = last.where("_last IS NOT NULL").groupBy("_group").agg(F.max_by("_last", "_b").alias("_end"))
    groups = edges.select("_group").join(ends, "_group", "left").withColumn("_start", F.last("_end", ignorenulls=True).over(W.orderBy("_group").rowsBetween(W.unboundedPreceding, -1)))
    carried = last.withColumn("_inner", inner).join(groups.select("_group", "_start"), "_group").select("_b", F.coalesce("_inner", "_start").alias("_carry"))
    w = W.partitionBy("_b").orderBy(at, "_side", "_value").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = whole.withColumn("_in", F.last("_value", ignorenulls=True).over(w)).where("_side = 1").join(carried, "_b", "left")
    return out.select(at, "_row.*", F.coalesce("_in", "_carry").alias(value))


def interval_join(points: DataFrame, spans: DataFrame, by: list[str], lo: str, hi: str, other_lo: str, other_hi: str, width: int) -> DataFrame:
    """Rows whose half-open integer intervals overlap, within ``by``: both sides are put into bins of ``width``, joined on the bin, and
    each pair is kept in the bin where the later of the two starts."""
    bins = lambda df, s, e: df.withColumn("_bin", F.explode(F.expr(f"sequence(cast(floor({s} / {width}) as bigint), cast(floor(({e} - 1) / {width}) as bigint))")))
    a, b = bins(points.where(f"{hi} > {lo}"), lo, hi), bins(spans.where(f"{other_hi} > {other_lo}"), other_lo, other_hi)
    out = a.join(b, [*by, "_bin"]).where(f"{lo} < {other_hi} AND {other_lo} < {hi} AND _bin = floor(greatest({lo}, {other_lo}) / {width})")
    return out.drop("_bin")
