"""The closed list algebra: 24 atomic operations over a list ``xs`` and a number ``k``, and sequences of one to four of them.

A query is an AST in JSON: ``{"filter": ["even"]}``, ``{"map": ["mul_const", 2]}``, ``{"order": "reverse"}``, ``{"slice": ["take_first_k"]}`` or
``{"sequence": [...]}``. ``compile_ast`` turns a known AST into one unrolled chain of built-in higher-order functions;
``interpret_ops`` runs operations that are data, row by row, as one ``aggregate`` over them. Both are plain columns: a query runs where
its rows are, without a shuffle or a Python worker.

Elements are BIGINT. Four operations can leave it (100**8 squared), so ``wide=True`` computes in DECIMAL(38, 0). Overflow
raises; it never wraps. Remainders are only compared with zero, so the sign of ``%`` does not matter.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LENGTH, MAX_ABS, MAX_K, MAX_STEPS = 20, 100, 10, 4

# The atomic operations in their order.
FILTERS = {
    "even": "x % 2 = 0",
    "odd": "x % 2 <> 0",
    "gt_k": "x > {k}",
    "ge_k": "x >= {k}",
    "lt_k": "x < {k}",
    "le_k": "x <= {k}",
    "multiple_of_k": "x % {k} = 0",
    "positive": "x > 0",
    "negative": "x < 0",
    "zero": "x = 0",
}
MAPS = {
    "add_k": "x + {k}",
    "sub_k": "x - {k}",
    "mul_k": "x * {k}",
    "mul_const": "x * {arg}",
    "negate": "-x",
    "abs": "abs(x)",
    "square": "x * x",
}
ORDERS = ("ascending", "descending", "reverse")
SLICES = ("take_first_k", "take_last_k", "every_other")


@dataclass(frozen=True)
class Op:
    kind: str
    name: str
    arg: int | None = None

    def ast(self) -> dict[str, Any]:
        if self.kind == "order":
            return {"order": self.name}
        return {self.kind: [self.name] if self.arg is None else [self.name, self.arg]}

    @property
    def uses_k(self) -> bool:
        return self.name.endswith("_k")


ATOMIC: tuple[Op, ...] = (
    *(Op("filter", n) for n in FILTERS),
    *(Op("map", n) for n in ("add_k", "sub_k", "mul_k")),
    Op("map", "mul_const", 2),
    Op("map", "mul_const", 3),
    *(Op("map", n) for n in ("negate", "abs", "square")),
    *(Op("order", n) for n in ORDERS),
    *(Op("slice", n) for n in SLICES),
)


def canonical_json(value: Any) -> str:
    """Sorted keys, no blanks, other characters than ASCII as they are."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def ast_of(ops: tuple[Op, ...] | list[Op]) -> dict[str, Any]:
    return ops[0].ast() if len(ops) == 1 else {"sequence": [o.ast() for o in ops]}


def parse_op(node: Any) -> Op:
    if not isinstance(node, dict) or len(node) != 1:
        raise ValueError("an operation is an object with one key")
    (kind, body), *_ = node.items()
    if kind == "order":
        if body in ORDERS:
            return Op(kind, body)
        raise ValueError(f"unknown order {body!r}")
    known = {"filter": FILTERS, "map": MAPS, "slice": SLICES}.get(kind)
    if known is None:
        raise ValueError(f"unknown kind of operation {kind!r}")
    if not isinstance(body, list) or not body or not isinstance(body[0], str) or body[0] not in known:
        raise ValueError(f"unknown {kind} {body!r}")
    if body[0] == "mul_const":
        if len(body) != 2 or type(body[1]) is not int or body[1] not in (2, 3):
            raise ValueError("mul_const takes 2 or 3")
        return Op(kind, body[0], body[1])
    if len(body) != 1:
        raise ValueError(f"{kind} {body[0]} takes no argument")
    return Op(kind, body[0])


def parse_ast(ast: dict[str, Any] | str, most: int = MAX_STEPS) -> tuple[Op, ...]:
    node = json.loads(ast) if isinstance(ast, str) else ast
    if isinstance(node, dict) and set(node) == {"sequence"}:
        steps = node["sequence"]
        if not isinstance(steps, list) or not 1 <= len(steps) <= most:
            raise ValueError(f"a sequence has 1 to {most} operations")
        return tuple(map(parse_op, steps))
    return (parse_op(node),)


def apply_sql(op: Op, xs: str, k: str) -> str:
    """SQL of one operation on the array ``xs``."""
    if op.kind == "filter":
        return f"filter({xs}, x -> {FILTERS[op.name].format(k=k)})"
    if op.kind == "map":
        return f"transform({xs}, x -> {MAPS[op.name].format(k=k, arg=op.arg)})"
    if op.name == "ascending":
        return f"sort_array({xs}, true)"
    if op.name == "descending":
        return f"sort_array({xs}, false)"
    if op.name == "reverse":
        return f"reverse({xs})"
    if op.name == "take_first_k":
        return f"slice({xs}, 1, {k})"
    if op.name == "take_last_k":
        return f"reverse(slice(reverse({xs}), 1, {k}))"
    return f"filter({xs}, (x, i) -> i % 2 = 0)"


def compile_sql(ops: tuple[Op, ...], xs: str = "xs", k: str = "k", wide: bool = False) -> str:
    out = f"cast({xs} as array<{'decimal(38,0)' if wide else 'bigint'}>)"
    for op in ops:
        out = apply_sql(op, out, k)
        if wide and op.kind == "map":
            out = f"cast({out} as array<decimal(38,0)>)"
    return out


def compile_ast(ast: dict[str, Any] | str, xs: str = "xs", k: str = "k") -> Column:
    ops = parse_ast(ast)
    return F.expr(compile_sql(ops, xs, k, wide=len(ops) > 3))


def interpret_ops(ops: str = "ops", xs: str = "xs", k: str = "k", wide: bool = False) -> Column:
    """Runs a column of operations, array<struct<kind, name, arg>>, on ``xs``; unknown ones and wrong counts raise.

    BIGINT holds what three operations make of an input; four need ``wide``, DECIMAL(38, 0).
    """
    kind = "array<decimal(38,0)>" if wide else "array<bigint>"
    cases = []
    for op in (*(Op("filter", n) for n in FILTERS), *(Op("map", n) for n in MAPS), *(Op("order", n) for n in ORDERS), *(Op("slice", n) for n in SLICES)):
        body = apply_sql(op, "acc", k).replace("None", "o.arg")
        body = f"cast({body} as {kind})" if wide and op.kind == "map" else body
        cases.append(f"WHEN o.kind = '{op.kind}' AND o.name = '{op.name}'{' AND o.arg IN (2, 3)' if op.name == 'mul_const' else ''} THEN {body}")
    unknown = f"cast(raise_error(concat('unknown operation ', coalesce(o.kind, 'null'), ' ', coalesce(o.name, 'null'))) as {kind})"
    run = f"aggregate({ops}, cast({xs} as {kind}), (acc, o) -> CASE {' '.join(cases)} ELSE {unknown} END)"
    return F.expr(f"CASE WHEN size({ops}) BETWEEN 1 AND {MAX_STEPS} THEN {run} ELSE cast(raise_error('a sequence has 1 to {MAX_STEPS} operations') as {kind}) END")


def ops_literal(ops: tuple[Op, ...] | list[Op]) -> str:
    """SQL literal of operations as ``interpret_ops`` takes them."""
    one = [f"named_struct('kind', '{o.kind}', 'name', '{o.name}', 'arg', cast({'null' if o.arg is None else o.arg} as int))" for o in ops]
    return f"array({', '.join(one)})"


def input_problem(xs: str = "xs", k: str = "k") -> Column:
    """What is wrong with an input, null if nothing: length, elements, k."""
    return F.expr(
        f"CASE WHEN {xs} IS NULL THEN 'no list' WHEN size({xs}) > {MAX_LENGTH} THEN 'too long' "
        f"WHEN NOT forall({xs}, x -> coalesce(x BETWEEN -{MAX_ABS} AND {MAX_ABS}, false)) THEN 'element out of range' "
        f"WHEN NOT coalesce({k} BETWEEN 1 AND {MAX_K}, false) THEN 'k out of range' END"
    )


def read_inputs(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` with xs, k and ``problem`` (null for a valid input) from the JSON text of an input: an object of a list of integers and an integer."""
    one = F.from_json(F.col(text), "xs array<bigint>, k bigint, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    out = rows.withColumn("_i", one).withColumn("_keys", F.array_sort(F.json_object_keys(text)))
    shape = F.when(F.col("_i._bad").isNotNull() | ~F.coalesce(F.col("_keys") == F.array(F.lit("k"), F.lit("xs")), F.lit(False)), "not an input")
    problem = F.coalesce(shape, F.when(F.expr(input_problem_sql("_i.xs", "_i.k")), "out of domain"))
    return out.select(*rows.columns, F.col("_i.xs").alias("xs"), F.col("_i.k").cast("int").alias("k"), problem.alias("problem"))


def checked(xs: str = "xs", k: str = "k") -> Column:
    """``xs``, raising where the input is not valid."""
    return F.expr(f"CASE WHEN {input_problem_sql(xs, k)} THEN cast(raise_error('input out of domain') as array<bigint>) ELSE {xs} END")


def input_problem_sql(xs: str, k: str) -> str:
    return f"NOT (coalesce(size({xs}) <= {MAX_LENGTH}, false) AND forall({xs}, x -> coalesce(x BETWEEN -{MAX_ABS} AND {MAX_ABS}, false)) AND coalesce({k} BETWEEN 1 AND {MAX_K}, false))"


def duck_sql(ops: tuple[Op, ...], xs: str = "xs", k: str = "k", wide: bool = False) -> str:
    """The same sequence in DuckDB's SQL, for checks."""
    out = f"CAST({xs} AS HUGEINT[])" if wide else xs
    for op in ops:
        if op.kind == "filter":
            out = f"list_filter({out}, lambda x: {FILTERS[op.name].format(k=k)})"
        elif op.kind == "map":
            out = f"list_transform({out}, lambda x: {MAPS[op.name].format(k=k, arg=op.arg)})"
        elif op.kind == "order":
            out = {"ascending": f"list_sort({out})", "descending": f"list_reverse_sort({out})", "reverse": f"list_reverse({out})"}[op.name]
        elif op.name == "take_first_k":
            out = f"({out})[1:{k}]"
        elif op.name == "take_last_k":
            out = f"({out})[-{k}:]"
        else:
            out = f"({out})[1:len({out}):2]"
    return out


def run(ops: tuple[Op, ...], xs: list[int], k: int) -> list[int]:
    """The sequence on one list, in Python, for small fixtures and sandboxed checks."""
    out = list(xs)
    for op in ops:
        if op.kind == "filter":
            test = {
                "even": lambda x: x % 2 == 0, "odd": lambda x: x % 2 != 0, "gt_k": lambda x: x > k, "ge_k": lambda x: x >= k, "lt_k": lambda x: x < k,
                "le_k": lambda x: x <= k, "multiple_of_k": lambda x: x % k == 0, "positive": lambda x: x > 0, "negative": lambda x: x < 0, "zero": lambda x: x == 0,
            }[op.name]
            out = [x for x in out if test(x)]
        elif op.kind == "map":
            value = {
                "add_k": lambda x: x + k, "sub_k": lambda x: x - k, "mul_k": lambda x: x * k, "mul_const": lambda x: x * op.arg,
                "negate": lambda x: -x, "abs": abs, "square": lambda x: x * x,
            }[op.name]
            out = [value(x) for x in out]
        elif op.kind == "order":
            out = out[::-1] if op.name == "reverse" else sorted(out, reverse=op.name == "descending")
        else:
            out = {"take_first_k": out[:k], "take_last_k": out[-k:], "every_other": out[::2]}[op.name]
    return out
