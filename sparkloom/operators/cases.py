"""Evaluation inputs: seeded random cases, disjoint sets, targeted searches and executions of specs on cases."""

from __future__ import annotations

import random
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.plans.algebra import MAX_ABS, MAX_K, MAX_LENGTH, ORDERS, Op, compile_sql, interpret_ops

CASE = "case_id string, xs array<bigint>, k int, tags array<string>"


def case_key(xs: str = "xs", k: str = "k") -> Column:
    """Canonical JSON of an input: {"k":..,"xs":[..]}."""
    return F.expr(f"concat('{{\"k\":', {k}, ',\"xs\":[', array_join(transform({xs}, x -> cast(x as string)), ','), ']}}')")


def boundary_cases() -> list[tuple[list[int], int]]:
    """Inputs at the edges. Fixed values."""
    return [([], 1), ([0], 1), ([1], 1), ([-1], 10), ([0, 0, 0], 3), ([-5, -1, 0, 1, 5], 2), ([5, 4, 3, 2, 1], 5), ([1, 1, 2, 2, 3, 3], 10), ([-100, 100], 1)]


# The modes of random cases by turns. What a case's first elements become, and its tags. k is the case's k, M the greatest
# absolute value, R a draw from 1 to M, S one from -M to M, the same in all its places.
STRATA = (
    ("0 -R", "contains_zero mixed_sign"),
    ("k k-1 k+1", "threshold_equal threshold_neighbors"),
    ("-k k k+1", "multiples_and_nonmultiples"),
    ("S S", "duplicates"),
    ("-M M", "value_extremes mixed_sign"),
    ("-2 3 4", "parity_mix mixed_sign"),
    ("ascending", "already_ascending"),
    ("descending", "already_descending"),
)
_TERM = re.compile(r"(-?)(\w+)([+-]\d+)?$")


def leading(pattern: str, k: int, rng: random.Random) -> list[int]:
    """The numbers that a pattern of STRATA names."""
    known = {"k": k, "M": MAX_ABS}
    ranges = {"R": (1, MAX_ABS), "S": (-MAX_ABS, MAX_ABS)}
    out = []
    for sign, name, plus in (_TERM.match(t).groups() for t in pattern.split()):
        if name in ranges and name not in known:
            known[name] = rng.randint(*ranges[name])
        value = known[name] if name in known else int(name)
        out.append((-value if sign else value) + int(plus or 0))
    return out


def random_cases(spark: SparkSession, name: str, seed: int, count: int, forbidden: set[str] | None = None) -> DataFrame:
    """``count`` seeded cases with keys that aren't forbidden, in the modes of STRATA by turns. A set has some dozens, so it is made on the
    driver by one generator, whose sequence the seed fixes: length, k, elements, then what the mode draws."""
    rng, taken, rows = random.Random(seed), set(forbidden or ()), []
    for _ in range(100 * count):
        if len(rows) == count:
            break
        mode, n, k = len(rows) % len(STRATA), rng.randint(2, MAX_LENGTH), rng.randint(1, MAX_K)
        xs = [rng.randint(-MAX_ABS, MAX_ABS) for _ in range(n)]
        pattern, tags = STRATA[mode][0], STRATA[mode][1].split()
        if pattern in ORDERS:
            xs.sort(reverse=pattern == "descending")
        else:
            lead = leading(pattern, k, rng)[:n]
            xs[: len(lead)] = lead
        key = f'{{"k":{k},"xs":[{",".join(map(str, xs))}]}}'
        if key not in taken:
            taken.add(key)
            rows.append((f"{name}-case-{len(rows) + 1:03d}", xs, k, tags))
    if len(rows) < count:
        raise ValueError(f"no {count} new cases after {100 * count} tries")
    return spark.createDataFrame(rows, CASE)


def unseen(cases: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Cases whose (xs, k) is not forbidden."""
    return cases.withColumn("_key", case_key()).join(forbidden.select(case_key().alias("_key")), "_key", "left_anti").drop("_key")


def execute(specs: DataFrame, cases: DataFrame, wide: bool = False) -> DataFrame:
    """(spec_id, case_id, out): every spec (ops array<struct>) on every case. Cases are some dozens and travel as one array, so the
    product is made row by row where the specs are, without a shuffle. ``wide`` for specs of four operations."""
    packed = [(r["case_id"], r["xs"], r["k"]) for r in cases.select("case_id", "xs", "k").limit(10_001).collect()]
    if len(packed) > 10_000:
        raise ValueError("cases are a small table")
    one = cases.sparkSession.createDataFrame([(packed,)], "cases array<struct<case_id:string,xs:array<bigint>,k:int>>")
    rows = specs.select("spec_id", "ops").withColumn("case", F.explode(one.scalar()))
    return rows.select("spec_id", F.col("case.case_id").alias("case_id"), interpret_ops("ops", "case.xs", "case.k", wide).alias("out"))


def execute_all(cases: DataFrame, key: str, specs: dict[str, tuple[Op, ...]]) -> DataFrame:
    """(spec_id, key, out): a few literal specs on every case of a large table, compiled into it: one scan, no shuffle."""
    one = F.array(*[F.struct(F.lit(s).alias("spec_id"), F.expr(compile_sql(ops, wide=len(ops) > 3)).alias("out")) for s, ops in specs.items()])
    return cases.select(key, F.explode(one).alias("r")).select("r.spec_id", key, "r.out")


def execution_counts(outputs: DataFrame) -> DataFrame:
    return outputs.agg(F.count("*").alias("executions"), F.count_if(F.size("out") == 0).alias("empty"), F.countDistinct("spec_id").alias("specs"))


def fingerprints(outputs: DataFrame) -> DataFrame:
    """(spec_id, fingerprint): a hash of a spec's outputs in case order; equal for specs that behave alike on all cases."""
    per = outputs.groupBy("spec_id").agg(F.array_sort(F.collect_list(F.struct("case_id", F.to_json("out").alias("o")))).alias("os"))
    return per.select("spec_id", F.sha2(F.array_join(F.transform("os", lambda x: x["o"]), "|"), 256).alias("fingerprint"))


def first_filter(ops: str) -> Column:
    """0-based place of the first filter; null without one."""
    return F.expr(f"nullif(array_position(transform({ops}, o -> o.kind), 'filter'), 0) - 1")


def targeted(specs: DataFrame, values: list[int], ks: list[int], forbidden: DataFrame) -> DataFrame:
    """Of each spec with a filter, the one-element input of least sha256 on which what precedes the filter is not empty and the filter empties
    it; null xs where no input does. Specs are searched independently; the domain is a literal of some thousand inputs."""
    spark = specs.sparkSession
    domain = spark.createDataFrame([([v], k) for v in values for k in ks], "xs array<bigint>, k int").withColumn("key", case_key())
    domain = domain.join(forbidden.select(case_key().alias("key")), "key", "left_anti")
    with_filter = specs.withColumn("f", first_filter("ops")).where("f IS NOT NULL")
    rows = with_filter.crossJoin(F.broadcast(domain)).withColumn("rank", F.sha2(F.concat("spec_id", F.lit("\u0000"), "key"), 256))
    before = F.when(F.col("f") == 0, F.col("xs")).otherwise(interpret_ops("slice(ops, 1, greatest(1, cast(f as int)))"))
    hit = rows.where(F.size(before) > 0).where(F.size(interpret_ops("slice(ops, 1, cast(f as int) + 1)")) == 0)
    best = hit.groupBy("spec_id").agg(F.min_by(F.struct("xs", "k"), "rank").alias("c"))
    return with_filter.select("spec_id", "f").join(best, "spec_id", "left").select("spec_id", F.col("f").cast("int").alias("filter_index"), "c.xs", "c.k")


def order_witness(cases: DataFrame, ops: str, back: str) -> DataFrame:
    """The first case (by case_id) on which a sequence and its reverse differ. cases carry both as columns of operations."""
    return cases.where(~interpret_ops(ops).eqNullSafe(interpret_ops(back))).orderBy("case_id").limit(1)


def fixed_cases(seed: int, count: int = 128) -> list[tuple[list[int], int]]:
    """Boundary inputs, ``count`` random ones, and four patterns at each k: the set that a benchmark is scored on."""
    rng = random.Random(seed)
    out = boundary_cases() + [([rng.randint(-MAX_ABS, MAX_ABS) for _ in range(rng.randint(0, MAX_LENGTH))], rng.randint(1, MAX_K)) for _ in range(count)]
    # Four patterns.
    for k in range(1, MAX_K + 1):
        out += [(xs, k) for xs in ([k - 1, k, k + 1, -k, 0, 2 * k, -2 * k], [3, -2, 0, 8, 1, 8, -7], list(range(-10, 10)), [k] * 5)]
    return out


def with_witnesses(cases: DataFrame, witnesses: DataFrame) -> DataFrame:
    """Cases and those witnesses whose (xs, k) they lack; both (case_id, xs, k)."""
    return cases.unionByName(unseen(witnesses.dropDuplicates(["xs", "k"]), cases))


def input_sets(spark: SparkSession, seeds: dict[str, int], count: int, excluded: set[str]) -> DataFrame:
    """Named random sets (set_name, case), each without the keys of the excluded inputs and of the sets before it."""
    out, taken = None, set(excluded)
    for name, seed in seeds.items():
        one = random_cases(spark, name, seed, count, taken)
        taken |= {r["key"] for r in one.select(case_key().alias("key")).collect()}
        one = one.withColumn("set_name", F.lit(name))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no set is named")
    return out


def set_overlaps(sets: DataFrame) -> DataFrame:
    """Inputs that several sets have."""
    return sets.groupBy(case_key().alias("key")).agg(F.countDistinct("set_name").alias("n")).where("n > 1")
