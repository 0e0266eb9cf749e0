"""Instructions from specs and expressions: bounded products, templates, replacement candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.hashing import NUL, sha
from sparkloom.operators.sampling import unique_until, walk


def grouped_expressions(expressions: DataFrame) -> DataFrame:
    """(op, op_id, options): an operation's train expressions by id. expressions: expression_id, op_id, op, final, connective, dictionary."""
    options = F.array_sort(F.collect_list(F.struct("expression_id", "final", "connective")))
    return expressions.where("dictionary = 'train'").groupBy("op", "op_id").agg(options.alias("options"))


def union_sources(sources: dict[str, DataFrame]) -> DataFrame:
    """Specs of named sources one below the other, ``split`` test where it is missing."""
    out = None
    for name, df in sources.items():
        one = df if "split" in df.columns else df.withColumn("split", F.lit(None).cast("string"))
        one = one.withColumn("source_name", F.lit(name)).withColumn("split", F.coalesce("split", F.lit("test")))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def unknown_operations(specs: DataFrame, grouped: DataFrame) -> DataFrame:
    """Operations of specs that no expression has."""
    return specs.select("spec_id", F.explode("ops").alias("op")).join(grouped.select("op"), "op", "left_anti").select("op").distinct()


def with_options(specs: DataFrame, grouped: DataFrame) -> DataFrame:
    """specs (spec_id, ast, ops) with the options of each step, in order. The dictionary is a few hundred rows."""
    steps = specs.select("spec_id", F.posexplode("ops").alias("p", "op")).join(grouped, "op")
    per = steps.groupBy("spec_id").agg(F.array_sort(F.collect_list(F.struct("p", "op_id", "options"))).alias("steps"))
    return specs.join(per, "spec_id")


def expected_counts(specs: DataFrame, most: int) -> DataFrame:
    """(spec_id, target): min(most, product of different phrases of each step, the last in its final form)."""
    n = "transform(steps, (s, i) -> cast(size(array_distinct(transform(s.options, o -> IF(i = size(steps) - 1, o.final, o.connective)))) as bigint))"
    return specs.select("spec_id", F.expr(f"least({most}L, aggregate({n}, 1L, (a, x) -> a * x))").alias("target"))


def rule_instructions(specs: DataFrame, seed: int, most: int, with_k: tuple[str, str], without_k: tuple[str, str], k_ids: list[str], slack: int = 4) -> DataFrame:
    """Up to ``most`` different instructions of each spec, in the order of its walk through the product of its expressions.

    ``with_k`` and ``without_k`` are (template id, text with {}). The walk is cut at ``slack`` times ``most`` combinations, and walked on from
    the start of the product's size for specs that this leaves short (equal phrases under several ids): rows are bounded by what is asked for.
    """
    base = with_options(specs, specs.sparkSession.createDataFrame([], "op string, op_id string, options array<struct<expression_id:string,final:string,connective:string>>")) if "steps" not in specs.columns else specs
    base = base.withColumn("radices", F.expr("transform(steps, s -> cast(size(s.options) as bigint))")).join(expected_counts(base, most), "spec_id")
    uses_k = F.exists("steps", lambda s: s["op_id"].isin(k_ids))
    base = base.withColumn("template_id", F.when(uses_k, with_k[0]).otherwise(without_k[0])).withColumn("template", F.when(uses_k, with_k[1]).otherwise(without_k[1]))

    def block(rows: DataFrame, size: int) -> DataFrame:
        w = walk(rows, seed, size)
        picked = "transform(steps, (s, j) -> s.options[cast(d[j] as int)])"
        w = w.withColumn("picked", F.expr(picked)).withColumn("phrases", F.expr("transform(picked, (o, j) -> IF(j = size(picked) - 1, o.final, o.connective))"))
        w = w.withColumn("instruction", F.replace("template", F.lit("{}"), F.array_join("phrases", "、"))).withColumn("expression_ids", F.expr("transform(picked, o -> o.expression_id)"))
        return unique_until(w.select("spec_id", "ast", "target", "template_id", "i", "instruction", "expression_ids"), "spec_id", "instruction", "i", F.col("target"))

    got = block(base, slack * most)
    short = base.join(got.groupBy("spec_id").agg(F.count("*").alias("_n")), "spec_id", "left").where("coalesce(_n, 0) < target").drop("_n")
    rest = block(short, 2**31 - 1)
    out = got.join(short.select("spec_id"), "spec_id", "left_anti").unionByName(rest)
    source = F.concat(F.col("spec_id"), F.lit(NUL), F.col("template_id"), F.lit(NUL), F.array_join("expression_ids", NUL))
    return out.withColumn("instruction_id", F.concat(F.lit("instruction-rule-"), sha(source))).withColumn("text_hash", sha("instruction"))


def paraphrase_test(test_only: DataFrame, external: DataFrame, excluded: DataFrame, train: DataFrame, template: str) -> DataFrame:
    """One instruction for each held-out expression: test_only and external ones, without excluded ids and without (op, final) that train has."""
    rows = test_only.unionByName(external).join(excluded.select("expression_id"), "expression_id", "left_anti").join(train.select("op", "final"), ["op", "final"], "left_anti")
    return rows.withColumn("instruction", F.replace(F.lit(template), F.lit("{}"), F.col("final")))
