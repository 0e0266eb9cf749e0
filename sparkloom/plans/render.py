"""Code rendered from operations as DataFrames: style axes are small tables, variants their bounded product, text a fold.

A template table holds, for every operation, expression form and direction of its condition, the text of the expression with ``{s}``
for its source and ``{e}`` for its element, and the parts of a loop. Variants are ranked by a seeded hash, so the first n of a spec are
a window, and rendering is a fold over the variant's steps: no Python worker takes part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions.hashing import joined_sha, sha, style_id
from sparkloom.plans.algebra import ATOMIC, Op, canonical_json

HEAD = "def solve(xs: list[int], k: int) -> list[int]:\n"
# Texts of conditions with the element left, and right, of the comparison; of values; of whole expressions.
CONDITIONS = {
    "even": ("{e} % 2 == 0", "0 == {e} % 2"), "odd": ("{e} % 2 != 0", "0 != {e} % 2"), "gt_k": ("{e} > k", "k < {e}"), "ge_k": ("{e} >= k", "k <= {e}"),
    "lt_k": ("{e} < k", "k > {e}"), "le_k": ("{e} <= k", "k >= {e}"), "multiple_of_k": ("{e} % k == 0", "0 == {e} % k"),
    "positive": ("{e} > 0", "0 < {e}"), "negative": ("{e} < 0", "0 > {e}"), "zero": ("{e} == 0", "0 == {e}"),
}
VALUES = {
    "add_k": {"default": "{e} + k"}, "sub_k": {"default": "{e} - k"}, "mul_k": {"default": "{e} * k"}, "mul_const": {"default": "{e} * {a}"},
    "negate": {"default": "-{e}"}, "abs": {"default": "abs({e})"}, "square": {"multiply": "{e} * {e}", "power": "{e} ** 2"},
}
PLAIN = {
    "ascending": {"default": "sorted({s})", "reverse_false": "sorted({s}, reverse=False)"},
    "descending": {"reverse_keyword": "sorted({s}, reverse=True)", "sort_then_slice": "sorted({s})[::-1]"},
    "reverse": {"slice_notation": "{s}[::-1]", "reversed_call": "list(reversed({s}))"},
    "take_first_k": {"implicit_start": "{s}[:k]", "explicit_zero": "{s}[0:k]"},
    "take_last_k": {"implicit_step": "{s}[-k:]", "explicit_empty_step": "{s}[-k::]"},
    "every_other": {"implicit_start": "{s}[::2]", "explicit_zero": "{s}[0::2]"},
}
# What a comment says of each operation.
GLOSSES = {
    "even": "偶数だけを残す", "odd": "奇数だけを残す", "gt_k": "kより大きい値だけを残す", "ge_k": "k以上の値だけを残す", "lt_k": "kより小さい値だけを残す",
    "le_k": "k以下の値だけを残す", "multiple_of_k": "kの倍数だけを残す", "positive": "正の値だけを残す", "negative": "負の値だけを残す", "zero": "ゼロだけを残す",
    "add_k": "各要素にkを加える", "sub_k": "各要素からkを引く", "mul_k": "各要素にkを掛ける", "mul_const": "各要素を{a}倍する", "negate": "各要素の符号を反転する",
    "abs": "各要素の絶対値を取る", "square": "各要素を二乗する", "ascending": "昇順に並べる", "descending": "降順に並べる", "reverse": "現在の要素順を反転する",
    "take_first_k": "先頭からk個を取る", "take_last_k": "末尾からk個を取る", "every_other": "先頭から1個おきに取る",
}


def templates(op: Op) -> list[dict[str, str]]:
    """Every (form, direction) of an operation with its texts; loop is the innermost line of a loop, test its condition."""
    a = str(op.arg or "")
    gloss = GLOSSES[op.name].replace("{a}", a)
    if op.kind == "filter":
        return [
            {"form": "default", "direction": d, "text": "[{e} for {e} in {s} if " + c + "]", "test": c, "value": "{e}", "gloss": gloss}
            for d, c in zip(("normal", "swapped"), CONDITIONS[op.name], strict=True)
        ]
    if op.kind == "map":
        return [{"form": f, "direction": "", "text": "[" + v.replace("{a}", a) + " for {e} in {s}]", "test": "", "value": v.replace("{a}", a), "gloss": gloss} for f, v in sorted(VALUES[op.name].items())]
    return [{"form": f, "direction": "", "text": t, "test": "", "value": "", "gloss": gloss} for f, t in sorted(PLAIN[op.name].items())]


def choices(spark: SparkSession, staged: bool, elements: tuple[str, ...] = ("x", "value")) -> DataFrame:
    """(op, choice): how each atomic operation can be written; loops only in staged code."""
    rows = []
    for op in ATOMIC:
        loops = ("list_comprehension", "for_loop") if staged else ("list_comprehension",)
        for t in templates(op):
            for collection in loops if op.kind in ("filter", "map") else ("",):
                for e in elements if op.kind in ("filter", "map") else ("",):
                    rows.append((canonical_json(op.ast()), {**t, "collection": collection, "element": e, "kind": op.kind, "name": op.name}))
    return spark.createDataFrame(rows, "op string, choice struct<collection:string,direction:string,element:string,form:string,gloss:string,kind:string,name:string,test:string,text:string,value:string>")


def variants(specs: DataFrame, staged: bool, names: tuple[str, ...] = ("result", "data"), elements: tuple[str, ...] = ("x", "value"), limit: int | None = None, seed: int = 0) -> DataFrame:
    """(spec_id, ast, steps, comments, annotated, style, style_id, rank) of specs (spec_id, ast, ops).

    The product of the axes of a spec's operations, without loops that write into their own source; the first ``limit`` of a spec by
    seeded hash. A spec has three operations at most, so its product is bounded by the tables above, not by data.
    """
    spark = specs.sparkSession
    table = F.broadcast(choices(spark, staged, elements).groupBy("op").agg(F.collect_list("choice").alias("options")))
    out = specs.select("spec_id", "ast", "ops").withColumn("steps", F.expr("cast(array() as array<struct<collection:string,direction:string,element:string,form:string,gloss:string,kind:string,name:string,test:string,text:string,value:string,target:string>>)"))
    targets = "array(" + ", ".join(f"'{n}'" for n in (names if staged else ("",))) + ")"
    for i in range(3):
        step = out.where(F.size("ops") > i).withColumn("op", F.col("ops")[i]).join(table, "op")
        step = step.withColumn("c", F.explode("options")).withColumn("target", F.explode(F.expr(targets)))
        source = f"coalesce(get(steps, {i - 1}).target, 'xs')"
        step = step.where(f"NOT (c.collection = 'for_loop' AND target = {source})").withColumn("steps", F.expr("array_append(steps, struct(c.*, target))"))
        out = step.select("spec_id", "ast", "ops", "steps").union(out.where(F.size("ops") <= i).select("spec_id", "ast", "ops", "steps"))
    out = out.withColumn("comments", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("annotated", F.explode(F.array(*[F.lit(x) for x in ((False, True) if staged else (False,))])))
    out = out.withColumn("staged", F.lit(staged)).withColumn("style", style_text())
    out = out.dropDuplicates(["spec_id", "style"]).withColumn("style_id", style_id("style"))
    out = out.withColumn("rank", joined_sha(sha("ast"), "style_id", F.lit(str(seed))))
    if limit is not None:
        out = out.withColumn("n", F.row_number().over(W.partitionBy("spec_id").orderBy("rank", "style_id"))).where(F.col("n") <= limit).drop("n")
    return out


def summary() -> dict[str, Column]:
    """What a style is called: code_style, collection_form, temporary_form."""
    used = "filter(transform(steps, x -> x.collection), x -> x <> '')"
    form = f"CASE WHEN size({used}) = 0 THEN null WHEN forall({used}, x -> x = 'list_comprehension') THEN 'list_comprehension' WHEN forall({used}, x -> x = 'for_loop') THEN 'for_loop' ELSE 'mixed' END"
    fresh = "size(array_distinct(transform(steps, x -> x.target))) = size(steps)"
    return {
        "code_style": F.expr(f"CASE WHEN NOT staged THEN 'expression_comprehension' ELSE CASE {form} WHEN 'for_loop' THEN 'staged_loop' WHEN 'mixed' THEN 'mixed' ELSE 'staged_comprehension' END END"),
        "collection_form": F.expr(form),
        "temporary_form": F.expr(f"CASE WHEN NOT staged THEN 'direct_return' WHEN {fresh} THEN 'fresh_names' ELSE 'reused_names' END"),
    }


def style_text() -> Column:
    """A style as canonical text: every choice in a fixed order of fields."""
    one = "concat('{\"collection\":\"', x.collection, '\",\"direction\":\"', x.direction, '\",\"element\":\"', x.element, '\",\"form\":\"', x.form, '\",\"target\":\"', x.target, '\"}')"
    return F.expr(f"concat('{{\"annotated\":', annotated, ',\"comments\":', comments, ',\"staged\":', staged, ',\"steps\":[', array_join(transform(steps, x -> {one}), ','), ']}}')")


def style_problem() -> Column:
    """Why a style is not valid, null if it is: choices of the operation's kind, loops that write elsewhere, names in staged code only."""
    loop = "exists(steps, x -> x.collection = 'for_loop')"
    kinds = "forall(steps, x -> (x.kind IN ('filter', 'map')) = (x.collection <> '') AND (x.kind = 'filter') = (x.direction <> '') AND (x.kind IN ('filter', 'map')) = (x.element <> ''))"
    own = "exists(transform(steps, (x, i) -> x.collection = 'for_loop' AND x.target = coalesce(get(steps, i - 1).target, 'xs')), x -> x)"
    return F.expr(
        f"CASE WHEN NOT ({kinds}) THEN 'choice of another kind' WHEN NOT staged AND {loop} THEN 'loop in an expression' WHEN staged AND {own} THEN 'loop writes into its source' "
        "WHEN staged <> forall(steps, x -> x.target <> '') THEN 'names and layout differ' WHEN NOT staged AND annotated THEN 'annotation without a name' END"
    )


def render() -> Column:
    """The code of (steps, comments, annotated, staged)."""
    fill = "replace(replace(x.text, '{s}', %s), '{e}', x.element)"
    direct = f"concat('{HEAD}', IF(comments, array_join(transform(steps, x -> concat('    # ', x.gloss, '\\n')), ''), ''), '    return ', aggregate(steps, 'xs', (s, x) -> {fill % 's'}), '\\n')"
    note = "IF(comments, concat('    # ', x.gloss, '\\n'), '')"
    mark = "IF(annotated AND NOT array_contains(a.seen, x.target), ': list[int]', '')"
    test = "IF(x.test = '', '', concat('        if ', replace(x.test, '{e}', x.element), ':\\n    '))"
    loop = f"concat('    ', x.target, {mark}, ' = []\\n    for ', x.element, ' in ', a.source, ':\\n', {test}, '        ', x.target, ' += [', replace(x.value, '{{e}}', x.element), ']\\n')"
    line = f"concat('    ', x.target, {mark}, ' = ', {fill % 'a.source'}, '\\n')"
    step = f"named_struct('body', concat(a.body, {note}, IF(x.collection = 'for_loop', {loop}, {line})), 'source', x.target, 'seen', array_append(a.seen, x.target))"
    start = "named_struct('body', '', 'source', 'xs', 'seen', cast(array() as array<string>))"
    return F.expr(f"IF(staged, aggregate(steps, {start}, (a, x) -> {step}, a -> concat('{HEAD}', a.body, '    return ', a.source, '\\n')), {direct})".replace(HEAD, HEAD.replace("\n", "\\n")))


def reference_code() -> Column:
    """A second renderer: one assignment to ``values`` an operation, from (ops) alone through the first form of each."""
    rows = {canonical_json(o.ast()): templates(o)[0]["text"].replace("{e}", "x").replace("{s}", "values") for o in ATOMIC}
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rows.items())
    head = HEAD.replace("\n", "\\n")
    return F.expr(f"concat('{head}    values = list(xs)\\n', array_join(transform(ops, o -> concat('    values = ', CASE o {cases} ELSE raise_error('unknown operation') END, '\\n')), ''), '    return values\\n')")
