"""Seeded and bounded selection: top n of a group or of all, affine walks through products, batches, covers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions.hashing import joined_sha, seeded_rank


def top_per_group(rows: DataFrame, group: str, key: str, n: int, seed: int) -> DataFrame:
    """The n rows of each group of least sha256(seed NUL group NUL key), with their ``rank``. Spark prunes within tasks first."""
    h = seeded_rank(seed, group, key)
    out = rows.withColumn("rank_hash", h).withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy("rank_hash", key)))
    return out.where(F.col("rank") <= n)


def groups_short_of(rows: DataFrame, group: str, n: int) -> DataFrame:
    return rows.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") < n)


def sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The n rows of least sha256(seed NUL key): a top-k, each task keeps n rows."""
    return rows.withColumn("rank_hash", seeded_rank(seed, key)).orderBy("rank_hash", key).limit(n)


def micro_batches(rows: DataFrame, order: list[str], size: int, group: list[str] | None = None) -> DataFrame:
    """Adds ``batch``: consecutive rows of a group in batches of ``size``. Without a group all rows are ordered in one task: for small tables."""
    w = W.partitionBy(*(group or [])).orderBy(*order) if group else W.orderBy(*order)
    return rows.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def affine_start(seed: int, spec: str, ast: str, size: str) -> tuple[Column, Column]:
    """Offset and first step of the walk through a product of ``size`` combinations, from eight bytes each of a digest."""
    digest = joined_sha(F.lit(str(seed)), spec, ast)
    part = lambda at: F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)")
    n = F.col(size).cast("decimal(20,0)")
    step = (part(17) % n).cast("long")
    return (part(1) % n).cast("long"), F.when(step == 0, 1).otherwise(step)


#: The first step from s, going s % n + 1, that shares no divisor with n.
def coprime_step(step: str, size: str) -> Column:
    """Gaps between coprime numbers are short (under 2 log2(n)**2), so as many next steps are tried; Euclid runs in 92 rounds at most."""
    tries = f"sequence(0, cast(2 * power(log2({size} + 2), 2) as int) + 2)"
    gcd = f"aggregate(sequence(1, 92), named_struct('a', s, 'b', cast({size} as bigint)), (g, i) -> IF(g.b = 0, g, named_struct('a', g.b, 'b', g.a % g.b)), g -> g.a)"
    return F.expr(f"filter(transform({tries}, i -> cast(({step} - 1 + i) % {size} + 1 as bigint)), s -> {gcd} = 1)[0]")


def digits(index: str, radices: str) -> Column:
    """Mixed-radix digits of ``index``, the last digit fastest."""
    return F.expr(f"aggregate(reverse({radices}), named_struct('d', cast(array() as array<bigint>), 'r', cast({index} as bigint)), (a, n) -> named_struct('d', array_prepend(a.d, a.r % n), 'r', a.r div n), a -> a.d)")


def walk(specs: DataFrame, seed: int, most: int) -> DataFrame:
    """(.., i, d): the first ``most`` combinations of each spec's product in walk order.

    specs: spec_id, ast, radices (array<bigint>). The walk visits every combination once; only the asked-for prefix is made.
    """
    out = specs.withColumn("size", F.expr("aggregate(radices, 1L, (a, x) -> a * x)"))
    offset, step = affine_start(seed, "spec_id", "ast", "size")
    out = out.withColumn("offset", offset).withColumn("step0", step).withColumn("step", coprime_step("step0", "size"))
    out = out.withColumn("i", F.explode(F.expr(f"sequence(0L, least(size, {most}) - 1)")))
    linear = "cast((cast(offset as decimal(38,0)) + cast(i as decimal(38,0)) * step) % size as bigint)"
    return out.withColumn("linear", F.expr(linear)).withColumn("d", digits("linear", "radices")).drop("step0")


def unique_until(rows: DataFrame, spec: str, text: str, order: str, target: Column) -> DataFrame:
    """Of each spec the first rows with different texts, up to its target."""
    first = rows.groupBy(spec, text).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in (spec, text)]), order).alias("r")).select(spec, text, "r.*")
    return first.withColumn("n", F.row_number().over(W.partitionBy(spec).orderBy(order))).where(F.col("n") <= target)


def expected_rows(specs: DataFrame, counts: str, most: int) -> DataFrame:
    """Sum over specs of min(most, product of counts)."""
    one = F.expr(f"least(cast({most} as decimal(38,0)), aggregate({counts}, cast(1 as decimal(38,0)), (a, x) -> cast(a * x as decimal(38,0))))")
    return specs.agg(F.sum(one.cast("long")).alias("expected"))


def usage_summary(items: DataFrame, used: DataFrame, group: str, item: str) -> DataFrame:
    """Of each group: items, and least, greatest and mean use of them, with unused ones as 0. used: a row for each use."""
    n = used.groupBy(item).agg(F.count("*").alias("uses"))
    per = items.join(n, item, "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    return per.groupBy(group).agg(F.count("*").alias("items"), F.min("uses").alias("least"), F.max("uses").alias("greatest"), F.avg("uses").alias("mean"))


def cover_then_fill(pairs: list[tuple[str, str]], n: int, seed: int) -> list[tuple[str, str]]:
    """n pairs: in ranked order first those that add an item not yet covered, then the others. A few hundred pairs; order decides."""
    import hashlib

    ranked = sorted(pairs, key=lambda p: (hashlib.sha256("\0".join((str(seed), *p)).encode()).hexdigest(), p))
    covered: set[str] = set()
    out: list[tuple[str, str]] = []
    for p in ranked:
        if len(out) < n and not set(p) <= covered:
            out.append(p)
            covered |= set(p)
    return (out + [p for p in ranked if p not in out])[:n]


def gcd_free(step: int, size: int) -> int:
    """``coprime_step`` on numbers, for checks."""
    while math.gcd(step, size) != 1:
        step = step % size + 1
    return step
