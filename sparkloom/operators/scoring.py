"""Evaluation analytics over scored candidates: pass rates, pass@k, funnels, run comparison, failures, resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pass_summary(rows: DataFrame, suite: str, size: str) -> DataFrame:
    """records, passed and rate by (suite, size), suite and in all; a grouped-out column is null and ``level`` says which (0 finest)."""
    out = rows.rollup(suite, size).agg(F.count("*").alias("records"), F.count_if("passed").alias("passed"), F.grouping_id().alias("level"))
    return out.withColumn("rate", F.col("passed") / F.col("records"))


def question_results(rows: DataFrame, keys: list[str], index: str, k: int = 5) -> DataFrame:
    """Of each question: passed candidates, pass@1 (the first candidate), pass@k (any of the first k), and whether k rescued it."""
    out = rows.where(F.col(index) <= k).groupBy(*keys).agg(F.count_if("passed").alias("n_passed"), F.coalesce(F.bool_or(F.col("passed") & (F.col(index) == 1)), F.lit(False)).alias("pass_1"), F.coalesce(F.bool_or("passed"), F.lit(False)).alias("pass_k"))
    return out.withColumn("rescued", F.col("pass_k") & ~F.col("pass_1"))


def pass_at_k(questions: DataFrame, group: list[str]) -> DataFrame:
    """Counts, percentages and the gain in percentage points by group and in all; totals are from counts, not means of rates."""
    out = questions.rollup(*group).agg(F.count("*").alias("questions"), F.count_if("pass_1").alias("pass_1"), F.count_if("pass_k").alias("pass_k"), F.count_if("rescued").alias("rescued"))
    pct = lambda c: F.round(100 * F.col(c) / F.col("questions"), 6)
    return out.withColumn("pass_1_pct", pct("pass_1")).withColumn("pass_k_pct", pct("pass_k")).withColumn("gain_pp", F.round(100 * (F.col("pass_k") - F.col("pass_1")) / F.col("questions"), 6))


STAGES = ("syntax_ok", "ast_safe", "signature_ok", "executable", "passed")


def funnel(rows: DataFrame, group: list[str], stages: tuple[str, ...] = STAGES) -> DataFrame:
    """How many rows reach each stage, having reached all before it."""
    reached, aggs = None, []
    for s in stages:
        reached = F.coalesce(F.col(s), F.lit(False)) if reached is None else reached & F.coalesce(F.col(s), F.lit(False))
        aggs.append(F.count_if(reached).alias(s))
    return rows.groupBy(*group).agg(F.count("*").alias("total"), *aggs)


def failure_stage(reason: str = "reason") -> Column:
    """static, runtime, semantic, timeout (by the clock, the processor or the step budget), or null for a pass."""
    r = F.col(reason)
    return F.when(r == "pass", None).when(r.startswith("contract_") | (r == "syntax_error"), "static").when(r.isin("timeout_or_process_exit", "step_budget"), "timeout").when(r.isin("runtime_error", "input_mutation"), "runtime").otherwise("semantic")


def reason_report(rows: DataFrame, group: list[str], reason: str, seconds: str) -> DataFrame:
    return rows.groupBy(*group, reason).agg(F.count("*").alias("n"), F.sum(seconds).alias("seconds"), F.percentile(seconds, 0.5).alias("median_seconds"))


def agreement(rows: DataFrame, key: str, model: str, a: str, b: str) -> DataFrame:
    """2 x 2 counts of two models' passes on the questions both have."""
    one = rows.where(F.col(model).isin(a, b)).groupBy(key).agg(F.max(F.when(F.col(model) == a, F.col("passed"))).alias("a_passed"), F.max(F.when(F.col(model) == b, F.col("passed"))).alias("b_passed"))
    return one.where("a_passed IS NOT NULL AND b_passed IS NOT NULL").groupBy("a_passed", "b_passed").agg(F.count("*").alias("n"))


def pivot_passes(rows: DataFrame, group: list[str], category: str, categories: list[str]) -> DataFrame:
    """Passes by group with a column for each category; duplicates of a key are the caller's to reject."""
    return rows.groupBy(*group).pivot(category, categories).agg(F.count_if("passed")).na.fill(0)


def run_diff(current: DataFrame, previous: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """(key, side, differing fields, pass change) of two runs, for keys of either."""
    a = current.select(*key, F.struct(*fields).alias("_a"))
    b = previous.select(*key, F.struct(*fields).alias("_b"))
    out = a.join(b, key, "full_outer")
    diff = F.array_compact(F.array(*[F.when(~F.col(f"_a.{f}").eqNullSafe(F.col(f"_b.{f}")), F.lit(f)) for f in fields]))
    side = F.expr("CASE WHEN _a IS NULL THEN 'previous' WHEN _b IS NULL THEN 'current' ELSE 'both' END")
    change = F.when(F.col("_a.passed") & ~F.col("_b.passed"), "gained").when(~F.col("_a.passed") & F.col("_b.passed"), "lost")
    return out.select(*key, side.alias("side"), F.when(side == "both", diff).alias("differs"), change.alias("change"))


def identity_problems(rows: DataFrame, questions: DataFrame, key: str, same: list[str]) -> DataFrame:
    """Keys missing, unknown, repeated, or with other attributes than the question's."""
    r = rows.groupBy(key).agg(F.count("*").alias("_n"), *[F.min(c).alias(f"_r_{c}") for c in same], *[F.max(c).alias(f"_s_{c}") for c in same])
    q = questions.select(key, F.lit(True).alias("_q"), *[F.col(c).alias(f"_q_{c}") for c in same])
    out = r.join(q, key, "full_outer")
    p = F.when(F.col("_n").isNull(), "missing").when(F.col("_q").isNull(), "unknown").when(F.col("_n") > 1, "repeated")
    for c in same:
        p = p.when(~(F.col(f"_r_{c}").eqNullSafe(F.col(f"_q_{c}")) & F.col(f"_s_{c}").eqNullSafe(F.col(f"_q_{c}"))), f"{c} differs")
    return out.select(key, p.alias("problem")).where("problem IS NOT NULL")


def baseline_deltas(rates: DataFrame, variant: str, baseline: str, matched: DataFrame | None = None) -> DataFrame:
    """Rates (variant, passed, records) with their difference in percentage points from the baseline's, and from a matched
    variant's (variant, other); null where there is none. A variant is a row: small tables, joined by broadcast."""
    r = rates.withColumn("rate", F.col("passed") / F.col("records"))
    base = r.where(F.col(variant) == baseline).select(F.col("rate").alias("_base"))
    out = r.join(F.broadcast(base.withColumn("_one", F.lit(1))), F.lit(1) == F.col("_one"), "left").withColumn("delta_pp", F.round(100 * (F.col("rate") - F.col("_base")), 6)).drop("_base", "_one")
    if matched is not None:
        other = r.select(F.col(variant).alias("other"), F.col("rate").alias("_other"))
        out = out.join(matched, variant, "left").join(other, "other", "left").withColumn("matched_pp", F.round(100 * (F.col("rate") - F.col("_other")), 6)).drop("_other")
    return out


def cross_check(recomputed: DataFrame, recorded: DataFrame, key: list[str], value: str, tolerance: float = 1e-12) -> DataFrame:
    """Keys whose recorded value is missing or farther than ``tolerance`` from the recomputed one."""
    b = recorded.select(*key, F.col(value).alias("_v"))
    return recomputed.join(b, key, "full_outer").where(f"NOT coalesce(abs({value} - _v) <= {tolerance}, false)")


def not_yet(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not done: what a resumed run has left."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def length_batches(rows: DataFrame, length: str, order: str, size: int) -> DataFrame:
    """Adds ``batch``, numbered within each length: batches of equal length need no padding."""
    return rows.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(length).orderBy(order)) - 1) / size).cast("long"))


def shard_commits(rows: DataFrame, order: str, size: int) -> DataFrame:
    """(shard, n, first, last, digest): a line of the commit log for each ``size`` consecutive rows; digest covers keys in order."""
    s = rows.withColumn("shard", F.floor(F.col(order) / size).cast("long"))
    return s.groupBy("shard").agg(F.count("*").alias("n"), F.min(order).alias("first"), F.max(order).alias("last"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.col(order))), lambda x: x.cast("string")), ","), 256).alias("digest"))


def candidates_problem(rows: DataFrame, keys: list[str], index: str, k: int) -> DataFrame:
    """Questions that lack one of candidates 1..k or have one twice."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct(index).alias("d"), F.min(index).alias("lo"), F.max(index).alias("hi")).where(f"NOT (n = {k} AND d = {k} AND lo = 1 AND hi = {k})")


def one_run_each(runs: DataFrame, identity: list[str], key: str) -> tuple[DataFrame, DataFrame]:
    """Runs with one identity kept once (least ``run``), and the questions on which runs of one identity disagree."""
    first = runs.groupBy(*identity).agg(F.min("run").alias("run"))
    kept = runs.join(first, [*identity, "run"], "left_semi")
    disagree = runs.groupBy(*identity, key).agg(F.min("passed").alias("lo"), F.max("passed").alias("hi")).where("lo <> hi").select(*identity, key)
    return kept, disagree


def representatives(rows: DataFrame, group: str, order: str, length: str) -> DataFrame:
    """The first row of each group at three offsets: start, middle and end."""
    first = rows.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(order))).where("_n = 1").drop("_n")
    return first.withColumn("offset", F.explode(F.array(F.lit(0), F.floor(F.col(length) / 2).cast("int"), F.col(length).cast("int"))))


def model_class(name: str) -> dict[str, Column]:
    """Parts of a model's name: size in millions, epochs, tokenizer."""
    c = F.col(name)
    return {
        "millions": F.regexp_extract(c, r"(?:^|[_-])(\d+)m(?:[_-]|$)", 1).try_cast("int"),
        "epochs": F.regexp_extract(c, r"(\d+)epoch", 1).try_cast("int"),
        "family": F.when(c.rlike("(?i)looped|middle"), "looped").when(c.rlike("(?i)ablation|no_"), "ablation").when(c.rlike("(?i)external"), "external").otherwise("standard"),
    }


def case_binding(records: DataFrame, shared: DataFrame, targeted: DataFrame) -> DataFrame:
    """(record_id, case_id, xs, k): every shared case, plus the one targeted at the record's spec. Shared cases are some dozens, and travel as one
    array, so the product is made where the records are."""
    packed = shared.agg(F.collect_list(F.struct("case_id", "xs", "k")).alias("c")).scalar()
    all_ = records.select("record_id", F.explode(packed).alias("c")).select("record_id", "c.*")
    own = records.select("record_id", "spec_id").join(targeted, "spec_id").select("record_id", "case_id", "xs", "k")
    return all_.unionByName(own)


def hidden_case_counts(bound: DataFrame, record: str, least: int) -> DataFrame:
    n = bound.groupBy(record).agg(F.count("*").alias("n"))
    return n.agg(F.min("n").alias("least"), F.max("n").alias("greatest"), F.count_if(F.col("n") < least).alias("short"))


def freeze_problems(questions: DataFrame, key: str, category: str, total: int, each: int) -> DataFrame:
    """(problem, n) of a benchmark to be frozen: keys not unique, not ``total`` questions, categories without ``each``."""
    n = questions.agg(F.count("*").alias("rows"), F.countDistinct(key).alias("keys"))
    off = questions.groupBy(category).agg(F.count("*").alias("_rows")).agg(F.count_if(F.col("_rows") != each).alias("off"))
    parts = [n.select(F.lit("repeated keys").alias("problem"), (F.col("rows") - F.col("keys")).alias("n")), n.select(F.lit("off total"), F.abs(F.col("rows") - total)), off.select(F.lit("categories off"), "off")]
    return parts[0].union(parts[1]).union(parts[2])
