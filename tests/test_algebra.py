from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.plans import algebra, render, specs
from sparkloom.plans.algebra import ATOMIC, Op, compile_ast, interpret_ops, ops_literal, parse_ast, run

XS, K = [3, -4, 6, 0, -1, 4, 2, -3, 1], 4
# What each atomic operation gives on XS and K.
GOLDEN = [
    [-4, 6, 0, 4, 2], [3, -1, -3, 1], [6], [6, 4], [3, -4, 0, -1, 2, -3, 1], [3, -4, 0, -1, 4, 2, -3, 1], [-4, 0, 4], [3, 6, 4, 2, 1], [-4, -1, -3], [0],
    [7, 0, 10, 4, 3, 8, 6, 1, 5], [-1, -8, 2, -4, -5, 0, -2, -7, -3], [12, -16, 24, 0, -4, 16, 8, -12, 4], [6, -8, 12, 0, -2, 8, 4, -6, 2],
    [9, -12, 18, 0, -3, 12, 6, -9, 3], [-3, 4, -6, 0, 1, -4, -2, 3, -1], [3, 4, 6, 0, 1, 4, 2, 3, 1], [9, 16, 36, 0, 1, 16, 4, 9, 1],
    [-4, -3, -1, 0, 1, 2, 3, 4, 6], [6, 4, 3, 2, 1, 0, -1, -3, -4], [1, -3, 2, 4, -1, 0, 6, -4, 3], [3, -4, 6, 0], [4, 2, -3, 1], [3, 6, -1, 2, 1],
]


def one(spark, column, xs=XS, k=K):
    return spark.createDataFrame([(xs, k)], "xs array<bigint>, k int").select(column.alias("o")).first()[0]


def test_golden(spark):
    got = spark.createDataFrame([(XS, K)], "xs array<bigint>, k int").select(*[compile_ast(o.ast()).alias(f"o{i}") for i, o in enumerate(ATOMIC)]).first()
    assert [list(map(int, x)) for x in got] == GOLDEN
    assert [run((o,), XS, K) for o in ATOMIC] == GOLDEN


def test_four_operations_and_overflow(spark):
    ops = (Op("map", "abs"), Op("filter", "even"), Op("order", "descending"), Op("slice", "take_first_k"))
    assert [int(x) for x in one(spark, compile_ast(algebra.ast_of(ops)), [-3, 2, -8, 4, 1], 2)] == [8, 4]
    wide = compile_ast({"sequence": [{"map": ["square"]}] * 4})
    assert int(one(spark, wide, [100], 1)[0]) == 10**32


@pytest.mark.parametrize("ast", ['{"sequence":[]}', '{"filter":["prime"]}', '{"map":["mul_const",5]}', '{"map":["mul_const",2.0]}', '{"order":["reverse"]}', '{"filter":["even"],"order":"reverse"}', "[]", '{"sequence":[' + ",".join(['{"order":"reverse"}'] * 5) + "]}"])
def test_malformed(ast):
    with pytest.raises(ValueError):
        parse_ast(ast)


def test_data_driven_agrees_and_raises(spark):
    rng = random.Random(3)
    rows, want = [], []
    for i in range(300):
        ops = tuple(rng.choice([o for o in ATOMIC if o.name != "square"]) for _ in range(rng.randint(1, 4)))
        xs, k = [rng.randint(-100, 100) for _ in range(rng.randint(0, 20))], rng.randint(1, 10)
        rows.append((i, xs, k, [(o.kind, o.name, o.arg) for o in ops]))
        want.append(run(ops, xs, k))
    df = spark.createDataFrame(rows, "i int, xs array<bigint>, k int, ops array<struct<kind:string,name:string,arg:int>>")
    assert [list(r[0]) for r in df.orderBy("i").select(interpret_ops()).collect()] == want
    for bad in ([("filter", "prime", None)], [], [("map", "mul_const", 4)]):
        with pytest.raises(Exception, match="unknown operation|1 to 4"):
            spark.createDataFrame([(XS, K, bad)], "xs array<bigint>, k int, ops array<struct<kind:string,name:string,arg:int>>").select(interpret_ops()).collect()


def test_domain(spark):
    rows = [([1] * 21, 1, "too long"), ([101], 1, "element out of range"), ([None], 1, "element out of range"), ([1], 0, "k out of range"), (None, 1, "no list"), ([], 10, None)]
    got = spark.createDataFrame(rows, "xs array<bigint>, k int, want string").withColumn("p", algebra.input_problem()).collect()
    assert all(r["p"] == r["want"] for r in got)
    with pytest.raises(Exception, match="out of domain"):
        one(spark, algebra.checked(), [200], 1)


def test_rendered_code_runs(spark):
    """All styles of a few specs give what the interpreter gives."""
    table = specs.atomic_table(spark).where("pos IN (1, 7, 18, 20, 23)")
    few = specs.permutations(table, 2)
    rows = render.variants(few, False, limit=4).unionByName(render.variants(few, True, limit=6))
    rows = rows.withColumn("problem", render.style_problem()).select("ast", "problem", render.render().alias("code"), render.reference_code().alias("plain")).collect()
    assert len(rows) == 25 * 10
    for r in rows:
        assert r["problem"] is None
        for code in (r["code"], r["plain"]):
            space: dict = {}
            exec(code, space)  # noqa: S102 - text made by this library from a closed set of templates
            for xs, k in ((XS, K), ([], 1), ([5, 5, -2], 10)):
                assert space["solve"](list(xs), k) == run(parse_ast(r["ast"]), xs, k), code


def test_counts(spark):
    assert specs.permutations(specs.atomic_table(spark)).count() == 24 + 552 + 12_144
    by = {r[0]: r[1] for r in specs.repetitions(specs.atomic_table(spark)).groupBy("pattern").count().collect()}
    assert by == {"AA": 24, "AAB": 552, "BAA": 552, "AAA": 24}
    with pytest.raises(Exception, match="no repetition"):
        spark.sql("SELECT array('a', 'b') AS ops").select(specs.pattern("ops")).collect()


def test_literal_ops(spark):
    assert spark.range(1).select(F.expr(ops_literal(ATOMIC[:2]))).first()[0][1]["name"] == "odd"


def test_code_candidates_of_every_two_step_spec(spark, sf_dir):
    from sparkloom.queries import queries

    per = {r["spec_id"]: r["count"] for r in queries()["code_candidates"](spark, sf_dir).groupBy("spec_id").count().collect()}
    assert len(per) == len(ATOMIC) * (len(ATOMIC) - 1) and set(per.values()) == {3}
