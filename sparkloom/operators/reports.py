"""Distribution reports: histograms, rollups with balance checks, coverage, and their rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def histogram(rows: DataFrame, value: str) -> DataFrame:
    return rows.groupBy(value).agg(F.count("*").alias("frequency"))


def tag_counts(rows: DataFrame, tags: str) -> DataFrame:
    return rows.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


def spec_counts(rows: DataFrame, spec: str, ast: str, size: str) -> DataFrame:
    """Rows of each spec, and whether it has one AST and one size."""
    return rows.groupBy(spec).agg(F.count("*").alias("n"), F.min(ast).alias("ast"), F.min(size).alias("n_ops"), (F.min(ast).eqNullSafe(F.max(ast)) & F.min(size).eqNullSafe(F.max(size))).alias("consistent"))


def rollup_summary(specs: DataFrame, size: str, wanted: int, **counts: str) -> DataFrame:
    """Sums by size and in all (size null): specs, each count, and specs whose ``n`` is under ``wanted`` with what they lack."""
    lack = F.greatest(F.lit(0), F.lit(wanted) - F.col("n"))
    out = specs.rollup(size).agg(F.count("*").alias("specs"), *[F.sum(c).alias(name) for name, c in counts.items()], F.count_if(lack > 0).alias("short_specs"), F.sum(lack).alias("missing"))
    return out


def coverage(specs: DataFrame, ops: str, weight: str, targets: list[str], size: str) -> DataFrame:
    """Of each target operation, by size and in all (size null): specs that hold it, their weights, how often it occurs, and its share of all weights."""
    hit = specs.select(F.expr(f"array_distinct({ops})").alias("_d"), F.col(ops).alias("_o"), weight, size).select(F.explode("_d").alias("target"), "_o", weight, size).where(F.col("target").isin(targets))
    times = F.expr("size(filter(_o, x -> x = target))")
    total = specs.agg(F.sum(weight).alias("_total"))
    out = hit.withColumn("_t", times).cube("target", size).agg(F.count("*").alias("specs"), F.sum(weight).alias("weights"), F.sum("_t").alias("occurrences"), F.grouping("target").alias("_g")).where("_g = 0").drop("_g")
    return out.withColumn("share", F.col("weights") / total.scalar())


def balance(**terms: int) -> str:
    return ", ".join(f"{k} {v}" for k, v in terms.items())


def markdown(rows: DataFrame, columns: list[str], order: list[str], most: int = 10_000) -> str:
    """A table of a report; reports are summaries, and one of more rows than ``most`` raises."""
    found = rows.orderBy(*order).select(*columns).limit(most + 1).collect()
    if len(found) > most:
        raise ValueError("this is no summary")
    show = lambda v: "" if v is None else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else f"{v:,.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns), *("| " + " | ".join(show(r[c]) for c in columns) + " |" for r in found)]) + "\n"


def foreign_keys(rows: DataFrame, key: str, source: DataFrame, same: list[str]) -> DataFrame:
    """(key, problem) of rows whose key the source lacks or has with other values of ``same``."""
    s = source.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in same])
    out = rows.join(s, rows[key] == s["_k"], "left")
    problem = F.when(F.col("_k").isNull(), "missing")
    for c in same:
        problem = problem.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), f"{c} differs")
    return out.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def code_report(rows: DataFrame, name: str, code: str, example: str, output: str) -> DataFrame:
    """(name, section): a section of Markdown a code with its text, an example and what it gives, to be written in the order of names."""
    section = F.concat(F.lit("## "), F.col(name), F.lit("\n\n```python\n"), F.regexp_replace(code, r"\s+$", ""), F.lit("\n```\n\n"), F.lit("Input: `"), F.col(example), F.lit("`  \nOutput: `"), F.col(output), F.lit("`\n"))
    return rows.select(name, section.alias("section"))
