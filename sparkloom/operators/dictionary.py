"""The expression dictionary and its review: merging edits, releases with provenance, approval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.hashing import joined_sha, sha
from sparkloom.operators.dedup import first_wins


def effective(edited: str, generated: str) -> Column:
    """The reviewer's text if it isn't blank, else the generated one."""
    return F.coalesce(F.nullif(F.trim(F.col(edited)), F.lit("")), F.trim(F.col(generated)))


def expression_id(op: str, final: str, connective: str) -> Column:
    return F.concat(F.lit("expr-candidate-"), joined_sha(op, final, connective))


def merge_reviewed(existing: DataFrame, reviewed: DataFrame) -> DataFrame:
    """existing plus the approved rows of ``reviewed`` whose id and (op, final, connective) it lacks; first by ``position``.

    Both have expression_id, op_id, final, connective, position; reviewed also approved.
    """
    new = reviewed.where("approved").drop("approved").join(existing.select("expression_id"), "expression_id", "left_anti")
    triple = ["op_id", "final", "connective"]
    new = first_wins(new.join(existing.select(*triple), triple, "left_anti"), triple, ["position", "expression_id"])
    return existing.withColumn("source", F.lit("existing")).unionByName(new.select(*existing.columns).withColumn("source", F.lit("reviewed")))


def prepare_release(rows: DataFrame, used: DataFrame, prune: bool) -> DataFrame:
    """Rows to release with ``human_edited``; unused ones go only if asked. rows: expression_id, op_id, generated, edited."""
    out = rows.join(used.select("expression_id").distinct(), "expression_id", "left_semi") if prune else rows
    return out.withColumn("text", effective("edited", "generated")).withColumn("human_edited", ~F.col("text").eqNullSafe(F.trim("generated")))


def with_provenance(release: DataFrame, provenance: DataFrame, same: list[str]) -> DataFrame:
    """Release rows with their provenance by id; a missing one or another value of ``same`` gives a ``problem``."""
    p = provenance.select("expression_id", *[F.col(c).alias(f"_{c}") for c in same], *[c for c in provenance.columns if c not in {"expression_id", *same, *release.columns}], F.lit(True).alias("_p"))
    out = release.join(p, "expression_id", "full_outer")
    problem = F.when(F.col("_p").isNull(), "no provenance").when(F.col(same[0]).isNull() & F.col(f"_{same[0]}").isNotNull(), "not released")
    for c in same:
        problem = problem.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), f"{c} differs")
    return out.withColumn("problem", problem).drop("_p", *[f"_{c}" for c in same])


def labelled(rows: DataFrame, test_ids: DataFrame) -> DataFrame:
    """Adds ``dictionary``: test_only for ids of the curated list, else train."""
    t = test_ids.select("expression_id").distinct().withColumn("_t", F.lit(True))
    return rows.join(t, "expression_id", "left").withColumn("dictionary", F.when(F.col("_t"), "test_only").otherwise("train")).drop("_t")


def version(rows: DataFrame, line: str, order: str) -> DataFrame:
    """SHA-256 of the newline-joined lines in order: of a dictionary of some hundred rows, one value."""
    return rows.agg(sha(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda x: x[line]), "\n"), F.lit("\n"))).alias("version"))


def approve(candidates: DataFrame, reviewer: str, at: str) -> DataFrame:
    """Pending teacher candidates of the training split as approved rows; others, repeated ids and unchanged texts give a ``problem``.

    ``at`` must be a time with a zone. candidates: id, source_id, text, source_text, status, origin, split.
    """
    from datetime import datetime

    if datetime.fromisoformat(at).tzinfo is None:
        raise ValueError("the time of an approval needs a zone")
    n = candidates.groupBy("id").agg(F.count("*").alias("_n"))
    problem = F.when(F.col("_n") > 1, "repeated id").when(~F.col("status").eqNullSafe("pending"), "not pending").when(~F.col("origin").eqNullSafe("teacher"), "not of the teacher").when(~F.col("split").eqNullSafe("train"), "not of the training split").when(F.col("text").eqNullSafe(F.col("source_text")), "unchanged")
    out = candidates.join(n, "id").withColumn("problem", problem).drop("_n")
    ok = F.col("problem").isNull()
    return out.withColumn("status", F.when(ok, "approved").otherwise(F.col("status"))).withColumn("reviewer", F.when(ok, F.lit(reviewer))).withColumn("approved_at", F.when(ok, F.lit(at))).withColumn("text_hash", sha("text"))


def phrase_export(release: DataFrame, provenance: DataFrame, ops: DataFrame) -> DataFrame:
    """(op_id, phrases in order, ambiguous): each operation's different phrases; a phrase of several operations is flagged."""
    rows = release.join(provenance.select("expression_id", "op"), "expression_id").join(ops, "op").select("op_id", "text", "position")
    n = rows.groupBy("text").agg(F.countDistinct("op_id").alias("_n"))
    first = rows.groupBy("op_id", "text").agg(F.min("position").alias("position")).join(n, "text")
    return first.groupBy("op_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]).alias("phrases"), F.bool_or(F.col("_n") > 1).alias("ambiguous"))


def reference_examples(mapping: DataFrame, existing: DataFrame, n: int) -> DataFrame:
    """The first n expressions of each source operation for each target. mapping: (target, source); existing: op_id, expression_id, text."""
    from pyspark.sql import Window as W

    out = mapping.join(existing.withColumnRenamed("op_id", "source"), "source")
    return out.withColumn("place", F.row_number().over(W.partitionBy("target", "source").orderBy("expression_id"))).where(F.col("place") <= n)
