"""Whole builds: train records with their rejects, quotas filled over specs in order, tokenised training sets, boundary manifests, merged runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions.hashing import seeded_rank
from sparkloom.operators import joins


def train_build(instructions: DataFrame, codes: DataFrame, rejected: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Records and rejects of instructions (spec_id, instruction_id) with codes (spec_id, code_id, style).

    Codes that ``rejected`` (code_id, reason) lists are taken out; each spec picks as many of the rest as it has instructions, balanced
    over styles in seeded order, and the i-th instruction by id gets the i-th pick. rejects: (spec_id, id, reason) of listed codes, of codes
    not needed, and of instructions without a code. Windows are a spec each.
    """
    usable = codes.join(rejected.select("code_id"), "code_id", "left_anti")
    need = instructions.groupBy("spec_id").agg(F.count("*").alias("_need"))
    ranked = joins.balanced(usable.join(need, "spec_id", "left"), "spec_id", "style", seeded_rank(seed, "code_id"), F.coalesce("_need", F.lit(0)))
    numbered = instructions.withColumn("pick", F.row_number().over(W.partitionBy("spec_id").orderBy("instruction_id")))
    picked = ranked.where("selected").select("spec_id", "pick", "code_id", "style")
    paired = numbered.join(picked, ["spec_id", "pick"], "left")
    listed = codes.join(rejected, "code_id").select("spec_id", F.col("code_id").cast("string").alias("id"), "reason")
    spare = ranked.where("NOT selected").select("spec_id", F.col("code_id").cast("string").alias("id"), F.lit("not needed").alias("reason"))
    short = paired.where("code_id IS NULL").select("spec_id", F.col("instruction_id").cast("string").alias("id"), F.lit("no code").alias("reason"))
    return paired.where("code_id IS NOT NULL").drop("pick"), listed.union(spare).union(short)


def build_problems(records: DataFrame, instructions: DataFrame) -> DataFrame:
    """(problem, n): codes used twice, instructions used twice, records of other specs than their instruction's."""
    twice = lambda c: records.groupBy(c).agg(F.count("*").alias("_n")).where("_n > 1").agg(F.count("*").alias("n"))
    foreign = records.join(instructions.select("instruction_id", F.col("spec_id").alias("_spec")), "instruction_id", "left").where("NOT spec_id <=> _spec").agg(F.count("*").alias("n"))
    parts = [(f"repeated {c}", twice(c)) for c in ("code_id", "instruction_id")] + [("foreign spec", foreign)]
    out = None
    for name, df in parts:
        one = df.select(F.lit(name).alias("problem"), "n")
        out = one if out is None else out.union(one)
    return out


def take_in_order(candidates: DataFrame, spec: str, rank: str, code: str, quota: int) -> DataFrame:
    """The first ``quota`` candidates of each spec by rank whose code no spec before it, and no rank before, has taken.

    The result of specs that take one after another in their order: a candidate that is never taken shuts no other out. Rounds of
    one aggregate and one window each: a spec's picks are right once those of the specs before it are, and rounds end when nothing changes,
    after as many as the longest chain of specs that take codes from each other. Needs a checkpoint folder, which cuts the plan.
    """
    rows = candidates.select(spec, rank, code).distinct()
    taken, before = rows, None
    while True:
        first = taken.groupBy(code).agg(F.min(F.struct(F.col(spec).alias("s"), F.col(rank).alias("r"))).alias("_first"))
        free = rows.join(first, code, "left").where(F.col("_first").isNull() | (F.struct(F.col(spec).alias("s"), F.col(rank).alias("r")) <= F.col("_first"))).drop("_first")
        taken = free.withColumn("n", F.row_number().over(W.partitionBy(spec).orderBy(rank, code))).where(F.col("n") <= quota).checkpoint()
        state = taken.agg(F.count("*"), F.bit_xor(F.xxhash64(spec, rank, code))).first()
        if state == before:
            return taken
        before = state


def training_set(rows: DataFrame, ids: str, start: int, end: int, target: int, context: int) -> DataFrame:
    """Adds ``length``, ``target_start`` (behind the one ``target`` token) and ``problem`` of token ids, null if they can be trained on."""
    times = lambda t: F.expr(f"size(filter({ids}, x -> x = {t}))")
    at = F.array_position(ids, target)
    problem = F.when(F.size(ids) > context, "longer than the context").when((times(start) != 1) | (F.col(ids)[0] != start), "start not once and first")
    problem = problem.when((times(end) != 1) | (F.element_at(ids, -1) != end), "end not once and last").when(times(target) != 1, "target not once").when(at + 1 >= F.size(ids), "no target")
    return rows.select("*", F.size(ids).alias("length"), at.cast("int").alias("target_start"), problem.alias("problem"))


def training_stats(rows: DataFrame, by: str) -> DataFrame:
    """Of ``training_set`` rows by a column: records, rejects, tokens, supervised tokens, shortest and longest."""
    good = F.col("problem").isNull()
    n = lambda c: F.when(good, c)
    return rows.groupBy(by).agg(
        F.count_if(good).alias("records"), F.count_if(~good).alias("rejects"), F.sum(n(F.col("length"))).alias("tokens"),
        F.sum(n(F.col("length") - F.col("target_start"))).alias("supervised"), F.min(n(F.col("length"))).alias("shortest"), F.max(n(F.col("length"))).alias("longest"),
    )


def boundary_manifest(specs: DataFrame, targeted: DataFrame) -> DataFrame:
    """(spec_id, status, reason, xs, k) of all specs: those with a targeted case, and those that none can reach, with why.

    targeted: (spec_id, filter_index, xs, k) as ``cases.targeted`` gives it, xs null where no input empties the filter.
    """
    out = specs.select("spec_id").join(targeted, "spec_id", "left")
    reason = F.when(F.col("filter_index").isNull(), "no filter").when(F.col("xs").isNull(), "no input of the domain empties the filter")
    return out.select("spec_id", F.when(reason.isNull(), "targeted").otherwise("unreachable").alias("status"), reason.alias("reason"), "xs", "k")


def merge_runs(runs: DataFrame, excluded: DataFrame, conditions: list[str], expected: int) -> tuple[DataFrame, DataFrame]:
    """Models by passes of runs (run, model, conditions.., question, passed) without the excluded models, and the problems of the rest.

    Runs of one model are not pooled: several are a problem, and so are conditions that differ between runs and question counts off ``expected``.
    """
    kept = runs.join(excluded.select("model").distinct(), "model", "left_anti")
    per = kept.groupBy("model").agg(F.countDistinct("run").alias("runs"), F.count("*").alias("rows"), F.countDistinct("question").alias("questions"), F.count_if("passed").alias("passed"))
    same = kept.agg(*[F.countDistinct(c).alias(c) for c in conditions])
    off = (F.col("questions") != expected) | (F.col("rows") != expected)
    problems = per.where("runs > 1").select("model", F.lit("several runs").alias("problem")).union(per.where(off & (F.col("runs") == 1)).select("model", F.lit("question count")))
    for c in conditions:
        problems = problems.union(same.where(F.col(c) > 1).select(F.lit(None).cast("string"), F.lit(f"{c} differs")))
    return per.select("model", "questions", "passed", (F.col("passed") / F.col("questions")).alias("rate")), problems


def copy_scores(matrix: DataFrame, by: list[str], tokens: Column | str = "tokens") -> DataFrame:
    """(by, copying, induction) of attention (by, q, k, weight) over ``tokens`` (an array): the mean weight on earlier places of a query's own
    token, and on places right behind one."""
    t = F.col(tokens) if isinstance(tokens, str) else tokens
    own, before = F.get(t, F.col("q")), F.get(t, F.col("k") - 1)
    copy = F.when((F.get(t, F.col("k")) == own) & (F.col("k") < F.col("q")), F.col("weight")).otherwise(0.0)
    induce = F.when((before == own) & (F.col("k") > 0) & (F.col("k") <= F.col("q")), F.col("weight")).otherwise(0.0)
    per = matrix.groupBy(*by, "q").agg(F.sum(copy).alias("_c"), F.sum(induce).alias("_i"))
    return per.groupBy(*by).agg(F.avg("_c").alias("copying"), F.avg("_i").alias("induction"))
