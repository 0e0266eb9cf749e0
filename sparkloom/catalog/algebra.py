"""The algebra and specs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.catalog.base import ATOMIC_VALUES, CASES, cases, table
from sparkloom.operators import cases as inputs
from sparkloom.plans import algebra, render, specs
from sparkloom.plans.algebra import ATOMIC, Op, ast_of, compile_ast, compile_sql, duck_sql, ops_literal

QUERIES: dict = {}


def _text(column: str = "out") -> Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


def _list_query(name: str, ops: tuple[Op, ...], wide: bool = False) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return cases(spark, sf_dir).select("l_orderkey", F.expr(compile_sql(ops, wide=wide)).alias("out")).select("l_orderkey", _text().alias("out"))

    sql = f"WITH {CASES} SELECT l_orderkey, array_to_string({duck_sql(ops, wide=wide)}, ',') AS out FROM cases"
    QUERIES[name] = (run, sql)


for _op in ATOMIC:
    _list_query(f"alg_{_op.kind}_{_op.name}" + (f"_{_op.arg}" if _op.arg else ""), (_op,))
_list_query("alg_sequence_2", (Op("filter", "even"), Op("map", "add_k")))
_list_query("alg_sequence_3", (Op("map", "abs"), Op("order", "descending"), Op("slice", "take_last_k")))
_list_query("alg_sequence_4", (Op("map", "abs"), Op("filter", "even"), Op("order", "descending"), Op("slice", "take_first_k")), wide=True)
_list_query("alg_square_4_decimal", tuple(Op("map", "square") for _ in range(4)), wide=True)


_CHOICES = [(Op("filter", "odd"), Op("map", "mul_k")), (Op("order", "reverse"), Op("slice", "every_other"), Op("map", "negate")), (Op("filter", "lt_k"), Op("order", "ascending"), Op("map", "square")), (Op("slice", "take_last_k"),)]


def alg_data_driven(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = " ".join(f"WHEN {i} THEN {ops_literal(o)}" for i, o in enumerate(_CHOICES))
    rows = cases(spark, sf_dir).withColumn("ops", F.expr(f"CASE l_orderkey % {len(_CHOICES)} {pick} END"))
    return rows.select("l_orderkey", algebra.interpret_ops().alias("out")).select("l_orderkey", _text().alias("out"))


QUERIES["alg_data_driven"] = (alg_data_driven, f"WITH {CASES} SELECT l_orderkey, array_to_string(CASE l_orderkey % {len(_CHOICES)} " + " ".join(f"WHEN {i} THEN {duck_sql(o)}" for i, o in enumerate(_CHOICES)) + " END, ',') AS out FROM cases")


def alg_domain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cases(spark, sf_dir).withColumn("k", (F.col("l_orderkey") % 12).cast("int")).withColumn("xs", F.expr("transform(xs, x -> IF(l_orderkey % 7 = 0, x * 2, x))"))
    return rows.select(F.coalesce(algebra.input_problem(), F.lit("ok")).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


QUERIES["alg_domain_check"] = (alg_domain_check, f"""WITH {CASES}, c AS (SELECT CASE WHEN l_orderkey % 7 = 0 THEN list_transform(xs, lambda x: x * 2) ELSE xs END AS xs, l_orderkey % 12 AS k FROM cases)
SELECT CASE WHEN len(xs) > 20 THEN 'too long' WHEN list_max(xs) > 100 OR list_min(xs) < -100 THEN 'element out of range' WHEN k NOT BETWEEN 1 AND 10 THEN 'k out of range' ELSE 'ok' END AS problem, count(*) AS n FROM c GROUP BY 1""")

_TRIO = [(Op("filter", "even"),), (Op("filter", "even"), Op("filter", "even")), (Op("map", "negate"), Op("map", "abs")), (Op("map", "abs"),), (Op("order", "ascending"), Op("order", "reverse")), (Op("order", "descending"),)]


def _spec_rows(spark: SparkSession, many: list[tuple[Op, ...]]) -> DataFrame:
    one = [f"SELECT 's{i}' AS spec_id, {ops_literal(o)} AS ops" for i, o in enumerate(many)]
    return spark.sql(" UNION ALL ".join(one))


def alg_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specs that behave alike on every case: outputs are hashed case by case and combined without order, so no list is gathered."""
    out = cases(spark, sf_dir)
    rows = out.select("l_orderkey", F.explode(F.array(*[F.struct(F.lit(f"s{i}").alias("spec_id"), F.array_join(F.transform(F.expr(compile_sql(o)), lambda x: x.cast("string")), ",").alias("o")) for i, o in enumerate(_TRIO)])).alias("r"))
    per = rows.groupBy("r.spec_id").agg(F.bit_xor(F.xxhash64("l_orderkey", "r.o")).alias("f"), F.sum(F.xxhash64("r.o", "l_orderkey").cast("decimal(38,0)")).alias("g"))
    return per.groupBy("f", "g").agg(F.array_join(F.array_sort(F.collect_list("spec_id")), ",").alias("specs")).select("specs")


QUERIES["alg_fingerprint"] = (alg_fingerprint, f"WITH {CASES}, r AS (" + " UNION ALL ".join(f"SELECT l_orderkey, 's{i}' AS spec_id, array_to_string({duck_sql(o)}, ',') AS o FROM cases" for i, o in enumerate(_TRIO)) + ") , f AS (SELECT spec_id, string_agg(o, '|' ORDER BY l_orderkey) AS f FROM r GROUP BY spec_id) SELECT string_agg(spec_id, ',' ORDER BY spec_id) AS specs FROM f GROUP BY f")


def spec_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs.permutations(specs.atomic_table(spark)).select("spec_id", "n_ops", "ast", F.sha2("ast", 256).alias("semantic_hash"))


_PERMS = f"""{ATOMIC_VALUES}, perms AS (SELECT [pos] AS ps, [op] AS ops FROM atomic UNION ALL SELECT [a.pos, b.pos], [a.op, b.op] FROM atomic a JOIN atomic b ON a.pos <> b.pos
  UNION ALL SELECT [a.pos, b.pos, c.pos], [a.op, b.op, c.op] FROM atomic a JOIN atomic b ON a.pos <> b.pos JOIN atomic c ON c.pos <> a.pos AND c.pos <> b.pos),
specs AS (SELECT 'combined-' || lpad(CAST(row_number() OVER (ORDER BY len(ps), ps) AS VARCHAR), 6, '0') AS spec_id, len(ps)::INT AS n_ops, ops,
  CASE WHEN len(ps) = 1 THEN ops[1] ELSE '{{"sequence":[' || array_to_string(ops, ',') || ']}}' END AS ast FROM perms)"""
QUERIES["spec_permutations"] = (spec_permutations, f"WITH {_PERMS} SELECT spec_id, n_ops, ast, sha256(ast) AS semantic_hash FROM specs")


def spec_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs.repetitions(specs.atomic_table(spark)).select("spec_id", "pattern", "ast")


QUERIES["spec_repetition"] = (spec_repetition, f"""WITH {ATOMIC_VALUES}, r AS (SELECT 1 AS block, pos AS a, 0 AS b, 0 AS v, [op, op] AS ops, 'AA' AS pattern FROM atomic
UNION ALL SELECT 2, a.pos, b.pos, 0, [a.op, a.op, b.op], 'AAB' FROM atomic a JOIN atomic b ON a.pos <> b.pos UNION ALL SELECT 2, a.pos, b.pos, 1, [b.op, a.op, a.op], 'BAA' FROM atomic a JOIN atomic b ON a.pos <> b.pos
UNION ALL SELECT 3, pos, 0, 0, [op, op, op], 'AAA' FROM atomic)
SELECT 'repetition-' || lpad(CAST(row_number() OVER (ORDER BY block, a, b, v) AS VARCHAR), 6, '0') AS spec_id, pattern, '{{"sequence":[' || array_to_string(ops, ',') || ']}}' AS ast FROM r""")

#: Five disjoint pairs of operations, by position.
PAIRS = [(1, 11), (3, 22), (8, 18), (5, 20), (7, 21)]


def _pairs(spark: SparkSession) -> DataFrame:
    c = [algebra.canonical_json(o.ast()) for o in ATOMIC]
    return spark.createDataFrame([(i, [c[a - 1], c[b - 1]]) for i, (a, b) in enumerate(PAIRS, 1)], "pair_id int, pair array<string>")


def _compositional(spark: SparkSession) -> DataFrame:
    return specs.containment(specs.permutations(specs.atomic_table(spark)), _pairs(spark))


def spec_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compositional(spark).select("spec_id", "pair_id", "n_ops", "ast")


_PAIR_VALUES = "pairs(pair_id, a, b) AS (SELECT p.pair_id, x.op, y.op FROM (VALUES " + ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(PAIRS, 1)) + ") p(pair_id, a, b) JOIN atomic x ON x.pos = p.a JOIN atomic y ON y.pos = p.b)"
QUERIES["spec_containment"] = (spec_containment, f"WITH {_PERMS}, {_PAIR_VALUES} SELECT spec_id, pair_id, n_ops, ast FROM specs JOIN pairs ON list_contains(ops, a) AND list_contains(ops, b)")


def spec_containment_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    expected = spark.createDataFrame([(2, 2), (3, 132)], "n_ops int, expected long")
    return specs.containment_audit(_compositional(spark), expected)


QUERIES["spec_containment_audit"] = (spec_containment_audit, f"WITH {_PERMS}, {_PAIR_VALUES} SELECT pair_id, n_ops, count(*) AS count, CAST(CASE n_ops WHEN 2 THEN 2 ELSE 132 END AS BIGINT) AS expected, count(*) = CASE n_ops WHEN 2 THEN 2 ELSE 132 END AS ok FROM specs JOIN pairs ON list_contains(ops, a) AND list_contains(ops, b) GROUP BY 1, 2")


def spec_remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs.remaining_by_size(specs.permutations(specs.atomic_table(spark)), _compositional(spark))


QUERIES["spec_remaining"] = (spec_remaining, f"WITH {_PERMS}, {_PAIR_VALUES} SELECT n_ops, count(*) AS n FROM specs WHERE NOT EXISTS (SELECT 1 FROM pairs WHERE list_contains(ops, a) AND list_contains(ops, b)) GROUP BY 1")


def _split(spark: SparkSession) -> DataFrame:
    left = specs.permutations(specs.atomic_table(spark)).join(_compositional(spark).select("spec_id"), "spec_id", "left_anti")
    quotas = F.expr("CASE n_ops " + " ".join(f"WHEN {n} THEN array({q[0]}, {q[1]})" for n, q in specs.QUOTAS.items()) + " END")
    return specs.split_by_quota(left, "n_ops", "ast", quotas)


def spec_split_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark).select("spec_id", "n_ops", "split")


QUERIES["spec_split_quota"] = (spec_split_quota, f"""WITH {_PERMS}, {_PAIR_VALUES}, l AS (SELECT * FROM specs WHERE NOT EXISTS (SELECT 1 FROM pairs WHERE list_contains(ops, a) AND list_contains(ops, b))),
r AS (SELECT *, row_number() OVER (PARTITION BY n_ops ORDER BY sha256(ast), ast) AS r FROM l)
SELECT spec_id, n_ops, CASE WHEN r <= CASE n_ops WHEN 1 THEN 24 WHEN 2 THEN 434 ELSE 9188 END THEN 'train' WHEN r <= CASE n_ops WHEN 1 THEN 24 WHEN 2 THEN 488 ELSE 10336 END THEN 'validation' ELSE 'test' END AS split FROM r""")


def spec_split_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = specs.permutations(specs.atomic_table(spark)).join(_compositional(spark).select("spec_id"), "spec_id", "left_anti")
    return specs.split_problems(_split(spark), whole, "spec_id")


QUERIES["spec_split_integrity"] = (spec_split_integrity, "SELECT * FROM (VALUES ('in several splits', CAST(0 AS BIGINT)), ('missing', 0), ('foreign', 0)) t(problem, n)")


def split_hash_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", F.concat(F.col("doc_id").cast("string"), F.lit("-"), "source").alias("ast"))
    return specs.split_by_quota(docs, "lang", "ast", F.array(F.lit(100), F.lit(20))).select("doc_id", "split")


QUERIES["split_hash_quota"] = (split_hash_quota, "SELECT doc_id, CASE WHEN r <= 100 THEN 'train' WHEN r <= 120 THEN 'validation' ELSE 'test' END AS split FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id || '-' || source), doc_id || '-' || source) AS r FROM documents)")


def uniqueness_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs.duplicates(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


QUERIES["uniqueness_audit"] = (uniqueness_audit, "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")


def cross_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    sub = orders.where("o_orderkey % 3 = 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 9 == 0, "X").otherwise(F.col("o_orderstatus")))
    return specs.inconsistent(sub, orders, "o_orderkey", ["o_orderstatus", "o_orderpriority"])


QUERIES["cross_consistency"] = (cross_consistency, "SELECT o_orderkey FROM orders WHERE o_orderkey % 9 = 0 AND o_orderstatus <> 'X'")


def ast_case_cross(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every operation on every case."""
    return inputs.execution_counts(inputs.execute_all(cases(spark, sf_dir), "l_orderkey", {f"s{i}": (o,) for i, o in enumerate(ATOMIC)}))


QUERIES["ast_case_cross"] = (ast_case_cross, f"WITH {CASES}, r AS (" + " UNION ALL ".join(f"SELECT {i} AS s, len({duck_sql((o,))}) AS n FROM cases" for i, o in enumerate(ATOMIC)) + ") SELECT count(*) AS executions, count(*) FILTER (WHERE n = 0) AS empty, count(DISTINCT s) AS specs FROM r")


def code_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many styles single operations have, by code style."""
    one = specs.permutations(specs.atomic_table(spark), 1)
    rows = render.variants(one, False).unionByName(render.variants(one, True))
    return rows.withColumns(render.summary()).groupBy("spec_id", "code_style").agg(F.count("*").alias("n"))


def code_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered code of the first three variants of each two-step spec."""
    rows = render.variants(specs.permutations(specs.atomic_table(spark), 2).where("n_ops = 2"), True, limit=3, seed=7)
    return rows.select("spec_id", "style_id", render.render().alias("code")).withColumn("code_hash", F.sha2("code", 256))


QUERIES["code_variants"] = (code_variants, None)
QUERIES["code_candidates"] = (code_candidates, None)


def targeted_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    many = [(Op("filter", "positive"),), (Op("map", "abs"), Op("filter", "negative")), (Op("filter", "even"), Op("map", "mul_const", 2), Op("filter", "odd")), (Op("map", "square"),), (Op("filter", "zero"), Op("filter", "positive"))]
    none = spark.createDataFrame([], "xs array<bigint>, k int")
    rng = list(range(-100, 101))
    out = inputs.targeted(_spec_rows(spark, many), rng, list(range(1, 11)), none)
    return out.select("spec_id", "filter_index", F.array_join(F.transform("xs", lambda x: x.cast("string")), ",").alias("xs"), "k")


_DOMAIN = "d AS (SELECT x, k, '{\"k\":' || k || ',\"xs\":[' || x || ']}' AS key FROM range(-100, 101) a(x), range(1, 11) b(k))"
_TESTS = {"s0": (0, "true", "NOT x > 0"), "s1": (1, "true", "NOT abs(x) < 0"), "s2": (0, "true", "NOT x % 2 = 0"), "s4": (0, "true", "NOT x = 0")}
QUERIES["targeted_inputs"] = (targeted_inputs, f"WITH {_DOMAIN}, r AS (" + " UNION ALL ".join(f"SELECT '{s}' AS spec_id, {i} AS f, x, k, sha256('{s}' || chr(0) || key) AS h FROM d WHERE {a} AND {b}" for s, (i, a, b) in _TESTS.items()) + ") SELECT spec_id, min(f)::INT AS filter_index, arg_min(x, h)::VARCHAR AS xs, arg_min(k, h)::INT AS k FROM r GROUP BY spec_id")


def random_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = inputs.random_cases(spark, "hidden", 20260926, 64)
    return made.select("case_id", inputs.case_key().alias("key"), F.array_join("tags", ",").alias("tags"))


QUERIES["random_inputs"] = (random_inputs, None)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    ast = ast_of([Op("filter", "even"), Op("map", "add_k")])
    return cases(spark, sf_dir).select("l_orderkey", compile_ast(ast).alias("out"))
