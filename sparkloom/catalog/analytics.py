"""Scoring, numeric, text, sandbox, source and streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.catalog.base import CASES, SCORED, cases, scored, table
from sparkloom.functions import stats, text
from sparkloom.operators import cases as inputs
from sparkloom.operators import dedup, joins, metrics, sandbox, scoring
from sparkloom.plans import render, specs
from sparkloom.plans.algebra import Op, ast_of, canonical_json

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


# ---- scoring

@query(f"WITH {SCORED} SELECT category AS suite, n_ops, count(*) AS records, count(*) FILTER (WHERE passed) AS passed, CAST(grouping(category) * 2 + grouping(n_ops) AS BIGINT) AS level, count(*) FILTER (WHERE passed) / count(*) AS rate FROM scored GROUP BY ROLLUP (category, n_ops)")
def suite_rollup(spark, sf_dir):
    return scoring.pass_summary(scored(spark, sf_dir).withColumnRenamed("category", "suite"), "suite", "n_ops").withColumn("level", F.col("level").cast("long"))


_QUESTIONS = f"{SCORED}, q AS (SELECT question, n_ops, count(*) FILTER (WHERE passed) AS n_passed, bool_or(passed AND candidate = 1) AS pass_1, bool_or(passed) AS pass_k, bool_or(passed) AND NOT bool_or(passed AND candidate = 1) AS rescued FROM scored WHERE candidate <= 5 GROUP BY 1, 2)"


@query(f"WITH {_QUESTIONS} SELECT * FROM q")
def question_results(spark, sf_dir):
    return scoring.question_results(scored(spark, sf_dir), ["question", "n_ops"], "candidate")


@query(f"WITH {_QUESTIONS} SELECT n_ops, count(*) AS questions, count(*) FILTER (WHERE pass_1) AS pass_1, count(*) FILTER (WHERE pass_k) AS pass_k, count(*) FILTER (WHERE rescued) AS rescued, round(100.0::DOUBLE * count(*) FILTER (WHERE pass_1) / count(*), 6) AS pass_1_pct, round(100.0::DOUBLE * count(*) FILTER (WHERE pass_k) / count(*), 6) AS pass_k_pct, round(100.0::DOUBLE * (count(*) FILTER (WHERE pass_k) - count(*) FILTER (WHERE pass_1)) / count(*), 6) AS gain_pp FROM q GROUP BY ROLLUP (n_ops)")
def pass_at_k(spark, sf_dir):
    return scoring.pass_at_k(question_results(spark, sf_dir), ["n_ops"])


@query(f"WITH {SCORED} SELECT category, count(*) AS total, count(*) FILTER (WHERE value > 5) AS syntax_ok, count(*) FILTER (WHERE value > 10) AS ast_safe, count(*) FILTER (WHERE value > 15) AS signature_ok, count(*) FILTER (WHERE value > 25) AS executable, count(*) FILTER (WHERE value > 50) AS passed FROM scored GROUP BY 1")
def stage_funnel(spark, sf_dir):
    rows = scored(spark, sf_dir)
    for name, least in (("syntax_ok", 5), ("ast_safe", 10), ("signature_ok", 15), ("executable", 25)):
        rows = rows.withColumn(name, F.col("value") > least)
    return scoring.funnel(rows, ["category"])


_REASON = "CASE WHEN value > 50 THEN 'pass' WHEN value > 40 THEN 'output_mismatch' WHEN value > 30 THEN 'runtime_error' WHEN value > 20 THEN 'contract_call' WHEN value > 10 THEN 'timeout_or_process_exit' ELSE 'syntax_error' END"


@query(f"WITH {SCORED}, r AS (SELECT {_REASON} AS reason FROM scored) SELECT CASE WHEN reason = 'pass' THEN NULL WHEN reason LIKE 'contract_%' OR reason = 'syntax_error' THEN 'static' WHEN reason LIKE 'timeout%' THEN 'timeout' WHEN reason IN ('runtime_error', 'input_mutation') THEN 'runtime' ELSE 'semantic' END AS stage, count(*) AS n FROM r GROUP BY 1")
def failure_taxonomy(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("reason", F.expr(_REASON))
    return rows.groupBy(scoring.failure_stage().alias("stage")).agg(F.count("*").alias("n"))


@query(f"WITH {SCORED} SELECT category, {_REASON} AS reason, count(*) AS n, round(sum(value), 4) AS seconds, round(quantile_cont(value, 0.5), 6) AS median_seconds FROM scored GROUP BY 1, 2")
def reason_report(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("reason", F.expr(_REASON))
    out = scoring.reason_report(rows, ["category"], "reason", "value")
    return out.withColumn("seconds", F.round("seconds", 4)).withColumn("median_seconds", F.round("median_seconds", 6))


def _types(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """The first two event types by name."""
    found = [r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().orderBy("event_type").limit(2).collect()]
    return found[0], found[-1]


_TWO = "(SELECT min(event_type) AS a, (SELECT min(event_type) FROM events WHERE event_type > (SELECT min(event_type) FROM events)) AS b FROM events)"


@query(f"WITH {SCORED}, t AS (SELECT * FROM {_TWO}), p AS (SELECT question, max(CASE WHEN category = t.a THEN passed END) AS a_passed, max(CASE WHEN category = t.b THEN passed END) AS b_passed FROM scored, t GROUP BY 1) SELECT a_passed, b_passed, count(*) AS n FROM p WHERE a_passed IS NOT NULL AND b_passed IS NOT NULL GROUP BY 1, 2")
def both_pass_matrix(spark, sf_dir):
    a, b = _types(spark, sf_dir)
    return scoring.agreement(scored(spark, sf_dir), "question", "category", a, b)


@query(f"WITH {SCORED} SELECT category, count(*) FILTER (WHERE passed AND n_ops = 1) AS \"1\", count(*) FILTER (WHERE passed AND n_ops = 2) AS \"2\", count(*) FILTER (WHERE passed AND n_ops = 3) AS \"3\" FROM scored GROUP BY 1")
def pivot_category(spark, sf_dir):
    return scoring.pivot_passes(scored(spark, sf_dir), ["category"], "n_ops", [1, 2, 3])


_RUNS = f"""{SCORED}, t AS (SELECT * FROM {_TWO}), a AS (SELECT question, bool_or(passed) AS passed, max(candidate) AS last FROM scored, t WHERE category = t.a GROUP BY 1), b AS (SELECT question, bool_or(passed) AS passed, max(candidate) AS last FROM scored, t WHERE category = t.b GROUP BY 1)"""


@query(f"""WITH {_RUNS} SELECT coalesce(a.question, b.question) AS question, CASE WHEN a.question IS NULL THEN 'previous' WHEN b.question IS NULL THEN 'current' ELSE 'both' END AS side,
CASE WHEN a.question IS NOT NULL AND b.question IS NOT NULL THEN concat_ws(',', CASE WHEN a.passed <> b.passed THEN 'passed' END, CASE WHEN a.last <> b.last THEN 'last' END) END AS differs, CASE WHEN a.passed AND NOT b.passed THEN 'gained' WHEN NOT a.passed AND b.passed THEN 'lost' END AS change FROM a FULL JOIN b ON a.question = b.question""")
def run_diff(spark, sf_dir):
    x, y = _types(spark, sf_dir)
    one = lambda t: scored(spark, sf_dir).where(F.col("category") == t).groupBy("question").agg(F.bool_or("passed").alias("passed"), F.max("candidate").alias("last"))
    out = scoring.run_diff(one(x), one(y), ["question"], ["passed", "last"])
    return out.withColumn("differs", F.when(F.col("differs").isNotNull(), F.array_join("differs", ",")))


@query(f"""WITH {_RUNS} SELECT coalesce(a.question, b.question) AS question, CASE WHEN b.question IS NULL THEN 'unknown' WHEN a.question IS NULL THEN 'missing' ELSE 'passed differs' END AS problem FROM a FULL JOIN b ON a.question = b.question WHERE a.question IS NULL OR b.question IS NULL OR a.passed <> b.passed""")
def identity_validation(spark, sf_dir):
    x, y = _types(spark, sf_dir)
    one = lambda t: scored(spark, sf_dir).where(F.col("category") == t).groupBy("question").agg(F.bool_or("passed").alias("passed"))
    return scoring.identity_problems(one(x), one(y), "question", ["passed"])


@query(f"""WITH {SCORED}, r AS (SELECT category AS variant, count(*) FILTER (WHERE passed) AS passed, count(*) AS records FROM scored GROUP BY 1), t AS (SELECT * FROM {_TWO}) SELECT variant, passed, records, passed / records AS rate, round(100 * (passed / records - (SELECT passed / records FROM r, t WHERE variant = t.a)), 6) AS delta_pp FROM r""")
def baseline_delta(spark, sf_dir):
    rates = scored(spark, sf_dir).groupBy(F.col("category").alias("variant")).agg(F.count_if("passed").alias("passed"), F.count("*").alias("records"))
    return scoring.baseline_deltas(rates, "variant", _types(spark, sf_dir)[0])


@query("SELECT event_id FROM events WHERE event_id % 3 <> 0")
def resume_anti_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    return scoring.not_yet(e, e.where("event_id % 3 = 0"), "event_id")


@query("SELECT doc_id, CAST((row_number() OVER (PARTITION BY n_chars ORDER BY doc_id) - 1) // 4 AS BIGINT) AS batch FROM documents")
def length_batches(spark, sf_dir):
    return scoring.length_batches(table(spark, sf_dir, "documents"), "n_chars", "doc_id", 4).select("doc_id", "batch")


@query("SELECT event_id // 128 AS shard, count(*) AS n, min(event_id) AS first, max(event_id) AS last, sha256(string_agg(event_id::VARCHAR, ',' ORDER BY event_id)) AS digest FROM events GROUP BY 1")
def shard_commits(spark, sf_dir):
    return scoring.shard_commits(table(spark, sf_dir, "events").select("event_id"), "event_id", 128)


@query(f"WITH {SCORED} SELECT question, count(*) AS n, count(DISTINCT candidate) AS d, min(candidate)::INT AS lo, max(candidate)::INT AS hi FROM scored GROUP BY 1 HAVING NOT (count(*) = 5 AND count(DISTINCT candidate) = 5 AND min(candidate) = 1 AND max(candidate) = 5)")
def candidate_layout(spark, sf_dir):
    return scoring.candidates_problem(scored(spark, sf_dir), ["question"], "candidate", 5)


@query("WITH f AS (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) SELECT lang, doc_id, unnest([0, n_chars // 2, n_chars])::INT AS offset FROM f WHERE r = 1")
def representative_prefixes(spark, sf_dir):
    return scoring.representatives(table(spark, sf_dir, "documents"), "lang", "doc_id", "n_chars").select("lang", "doc_id", "offset")


# ---- series and numbers

@query("""WITH l AS (SELECT user_id, ts, event_id FROM events WHERE event_id % 2 = 0), r AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_id % 5 = 0 AND value IS NOT NULL GROUP BY 1, 2)
SELECT l.event_id, r.value FROM l ASOF LEFT JOIN r ON l.user_id = r.user_id AND l.ts >= r.ts""")
def asof_last_value(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    left = e.where("event_id % 2 = 0").select("user_id", "ts", "event_id")
    return joins.as_of(left, e.where("event_id % 5 = 0").select("user_id", "ts", "value"), ["user_id"], "ts", "value").select("event_id", "value")


@query("""WITH l AS (SELECT ts, event_id FROM events WHERE event_id % 2 = 0), r AS (SELECT ts, max(value) AS value FROM events WHERE event_id % 5 = 0 AND value IS NOT NULL GROUP BY 1)
SELECT l.event_id, r.value FROM l ASOF LEFT JOIN r ON l.ts >= r.ts""")
def asof_global(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    left = e.where("event_id % 2 = 0").select("ts", "event_id")
    return joins.as_of_bucketed(left, e.where("event_id % 5 = 0").select("ts", "value"), "ts", "value", F.date_trunc("hour", "ts")).select("event_id", "value")


@query("""SELECT a.doc_id AS a, b.item_id AS b FROM (SELECT doc_id, doc_id * 10 AS lo, doc_id * 10 + n_chars % 50 AS hi FROM documents) a JOIN (SELECT item_id, item_id * 97 AS lo, item_id * 97 + 40 AS hi FROM benchmark) b ON a.lo < b.hi AND b.lo < a.hi AND a.hi > a.lo""")
def interval_overlap(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("a"), (F.col("doc_id") * 10).alias("lo"), (F.col("doc_id") * 10 + F.col("n_chars") % 50).alias("hi"))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("b"), (F.col("item_id") * 97).alias("lo2"), (F.col("item_id") * 97 + 40).alias("hi2"))
    return joins.interval_join(a, b, [], "lo", "hi", "lo2", "hi2", 64).select("a", "b")


@query(f"WITH {SCORED} SELECT category, CAST((event_id + 1 - 1) // 20 AS BIGINT) AS interval, max(event_id + 1) AS last_step, round(avg(value), 6) AS loss FROM scored GROUP BY 1, 2")
def interval_mean(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("step", F.col("event_id") + 1)
    return stats.interval_means(rows, "step", 20, ["category"], loss="value").withColumn("loss", F.round("loss", 6))


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 9) AS loss, round(exp(least(sum(l_discount * l_quantity) / sum(l_quantity), 80)), 9) AS perplexity FROM lineitem GROUP BY 1")
def weighted_loss_perplexity(spark, sf_dir):
    loss = stats.weighted_loss("l_discount", "l_quantity")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(loss, 9).alias("loss"), F.round(stats.perplexity(loss), 9).alias("perplexity"))


@query("SELECT step, round(CASE WHEN step <= 10 THEN 0.001 * step / 10.0 ELSE 0.0001 + (0.001 - 0.0001) * 0.5 * (1 + cos(pi() * least(1.0, (step - 10) / 190.0))) END, 12) AS rate FROM range(1, 201) t(step)")
def lr_schedule(spark, sf_dir):
    return spark.range(1, 201).select(F.col("id").alias("step"), F.round(stats.learning_rate(F.col("id"), 200, 10, 0.001, 0.0001), 12).alias("rate"))


@query("""WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - 1 + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS x, rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) - 1 + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2.0::DOUBLE AS y FROM lineitem)
SELECT l_returnflag, round(corr(x, y), 6) AS spearman FROM r GROUP BY 1""")
def rank_spearman(spark, sf_dir):
    out = stats.spearman(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_discount"), "l_quantity", "l_discount", ["l_returnflag"])
    return out.withColumn("spearman", F.round("spearman", 6))


@query("SELECT l_linestatus, round(corr(l_quantity, l_extendedprice), 6) AS pearson FROM lineitem GROUP BY 1")
def pearson_correlation(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.round(stats.pearson("l_quantity", "l_extendedprice"), 6).alias("pearson"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id")
def cosine_pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("eb"))
    return e.select(F.col("vec_id").alias("a"), "embedding").join(b, "a").select("a", "b", F.round(stats.cosine("embedding", "eb"), 5).alias("cosine"))


@query("WITH p AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE)) AS e FROM embeddings) SELECT vec_id, round(list_max(e) / list_sum(e), 5) AS top, round(-list_sum(list_transform(e, lambda x: x / list_sum(e) * ln(x / list_sum(e)))) / ln(len(e)), 5) AS entropy FROM p")
def softmax_entropy(spark, sf_dir):
    p = table(spark, sf_dir, "embeddings").select("vec_id", stats.softmax("embedding").alias("p"))
    return p.select("vec_id", F.round(F.array_max("p"), 5).alias("top"), F.round(stats.entropy("p"), 5).alias("entropy"))


@query("SELECT label, round(sqrt(avg(x * x)), 5) AS rms FROM (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1")
def rms_by_group(spark, sf_dir):
    x = table(spark, sf_dir, "embeddings").select("label", F.explode("embedding").alias("x")).withColumn("x", F.col("x").cast("double"))
    return x.groupBy("label").agg(F.round(stats.rms("x"), 5).alias("rms"))


#: Vectors of a block: four layers of ten positions.
_BLOCK = 40


def _attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores among the ten positions of each layer of a block of forty vectors: dot products. Every vector is a position of one block."""
    e = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / _BLOCK).cast("int").alias("block"), (F.col("vec_id") % 4).cast("int").alias("layer"), F.floor(F.col("vec_id") % _BLOCK / 4).cast("int").alias("q"), F.expr("transform(embedding, x -> cast(x as double))").alias("x"))
    k = e.select("block", "layer", F.col("q").alias("k"), F.col("x").alias("y"))
    return e.join(k, ["block", "layer"]).where("k <= q").select("block", "layer", "q", "k", F.expr(stats.dot("x", "y")).alias("score"))


def _weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.causal_attention(_attention(spark, sf_dir), ["block", "layer"])


def _regions(spark: SparkSession) -> DataFrame:
    return spark.range(_BLOCK // 4).select(F.col("id").cast("int").alias("k"), F.expr("IF(id < 3, 'head', 'tail')").alias("region"))


_ATT = f"""a AS (SELECT CAST(vec_id // {_BLOCK} AS INT) AS block, CAST(vec_id % 4 AS INT) AS layer, CAST(vec_id % {_BLOCK} // 4 AS INT) AS q, embedding::DOUBLE[] AS x FROM embeddings),
s AS (SELECT a.block, a.layer, a.q, b.q AS k, exp(list_dot_product(a.x, b.x)) AS e FROM a JOIN a b ON a.block = b.block AND a.layer = b.layer AND b.q <= a.q), w AS (SELECT block, layer, q, k, e / sum(e) OVER (PARTITION BY block, layer, q) AS weight FROM s)"""


@query(f"WITH {_ATT} SELECT block, layer, q, k, round(weight, 6) AS weight FROM w")
def causal_attention(spark, sf_dir):
    return _weights(spark, sf_dir).withColumn("weight", F.round("weight", 6))


@query(f"""WITH {_ATT}, i AS (SELECT block, layer, q, k, CASE WHEN q = k THEN weight + 1 ELSE weight END / 2 AS w FROM w), r1 AS (SELECT block, b.q, a.k, sum(b.w * a.w) AS w FROM i b JOIN i a USING (block) WHERE a.layer = 0 AND b.layer = 1 AND a.q = b.k GROUP BY 1, 2, 3),
r2 AS (SELECT block, b.q, a.k, sum(b.w * a.w) AS w FROM i b JOIN r1 a USING (block) WHERE b.layer = 2 AND a.q = b.k GROUP BY 1, 2, 3), r3 AS (SELECT block, b.q, a.k, sum(b.w * a.w) AS w FROM i b JOIN r2 a USING (block) WHERE b.layer = 3 AND a.q = b.k GROUP BY 1, 2, 3) SELECT block, q, k, round(w, 6) AS weight FROM r3""")
def attention_rollout(spark, sf_dir):
    return stats.attention_rollout(_weights(spark, sf_dir), 4, ["block"]).select("block", "q", "k", F.round("weight", 6).alias("weight"))


@query(f"""WITH {_ATT}, h AS (SELECT block, layer, q, CASE WHEN k < 3 THEN 'head' ELSE 'tail' END AS region, sum(weight) AS mass, count(*) AS n FROM w GROUP BY 1, 2, 3, 4) SELECT block, layer, q, region, round(mass, 6) AS mass, n, round(n / (q + 1), 6) AS expected, round(mass / (n / (q + 1)), 5) AS ratio FROM h""")
def region_mass(spark, sf_dir):
    out = stats.region_mass(_weights(spark, sf_dir), _regions(spark), ["block", "layer", "q"])
    return out.select("block", "layer", "q", "region", F.round("mass", 6).alias("mass"), "n", F.round("expected", 6).alias("expected"), F.round("ratio", 5).alias("ratio"))


@query(f"WITH {_ATT} SELECT block, layer, q, k, CAST(r AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY block, layer, q ORDER BY weight DESC, k) AS r FROM w) WHERE r <= 3")
def attention_top_hits(spark, sf_dir):
    return stats.top_hits(_weights(spark, sf_dir), ["block", "layer", "q"], 3).select("block", "layer", "q", "k", "place")


@query("""WITH m AS (SELECT label, d, avg(x::DOUBLE) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS d FROM embeddings) GROUP BY 1, 2), v AS (SELECT label, list(x ORDER BY d) AS v FROM m GROUP BY 1)
SELECT a.label AS a, b.label AS b, round(list_cosine_similarity(a.v, b.v), 5) AS cosine FROM v a, v b""")
def cosine_matrix(spark, sf_dir):
    """Cosines of the mean vectors of all labels: a matrix of as many rows and columns as there are labels."""
    e = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("d", "x"))
    means = e.groupBy("label", "d").agg(F.avg(F.col("x").cast("double")).alias("x"))
    v = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("v"))
    return stats.cosine_matrix(v, "label", "v").withColumn("cosine", F.round("cosine", 5))


@query("SELECT v AS packed, array_to_string(list_transform([0, 4, 1, 5, 2, 6, 3, 7], lambda o: (v >> (4 * o)) & 15), ',') AS nibbles FROM (SELECT CAST((p_partkey * 2654435761) % 2147483647 AS BIGINT) AS v FROM part)")
def unpack_nibbles(spark, sf_dir):
    v = table(spark, sf_dir, "part").select(F.expr("(p_partkey * 2654435761) % 2147483647").alias("packed"))
    return v.select("packed", F.array_join(F.transform(stats.unpack_nibbles("array(cast(packed as int))"), lambda x: x.cast("string")), ",").alias("nibbles"))


@query("SELECT p_partkey, CAST(2048 * p_size + 6 * (4 * p_size * p_size + 3 * p_size * (p_size * 4) + 2 * p_size) + p_size AS BIGINT) AS parameters FROM part")
def parameter_count(spark, sf_dir):
    w = F.col("p_size").cast("long")
    return table(spark, sf_dir, "part").select("p_partkey", stats.parameter_count(F.lit(2048), w, F.lit(6), w * 4).alias("parameters"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE)) AS e, (vec_id % 100) / 100.0::DOUBLE AS u FROM embeddings), p AS (SELECT vec_id, u, len(e) AS n, list_transform(range(1, len(e) + 1), lambda i: list_sum(e[1:i]) / list_sum(e)) AS c FROM e)
SELECT vec_id, CAST(least(n - 1, len(list_filter(c, lambda x: x <= u))) AS INT) AS token FROM p""")
def inverse_cdf_sampling(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", stats.softmax("embedding").alias("p"), ((F.col("vec_id") % 100) / 100.0).alias("u"))
    return e.select("vec_id", stats.draw("p", "u").alias("token"))


@query("""WITH e AS (SELECT a.vec_id AS id, a.embedding::DOUBLE[] AS x, b.embedding::DOUBLE[] AS y FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id), d AS (SELECT *, list_transform(range(1, len(x) + 1), lambda i: abs(x[i] - y[i])) AS d FROM e)
SELECT id, round(list_max(d), 5) AS max_diff, round(list_avg(d), 5) AS mean_diff, round(sqrt(list_avg(list_transform(d, lambda v: v * v))), 5) AS rms_diff, list_position(x, list_max(x)) = list_position(y, list_max(y)) AS same_top, round(list_reverse_sort(x)[1] - list_reverse_sort(x)[2], 5) AS margin,
  CAST(len(list_intersect(list_reverse_sort(x)[1:5].list_transform(lambda v: list_position(x, v)), list_reverse_sort(y)[1:5].list_transform(lambda v: list_position(y, v)))) AS INT) AS top5_kept FROM d""")
def logit_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    j = e.select(F.col("vec_id").alias("id"), "x").join(e.select((F.col("vec_id") - 1).alias("id"), F.col("x").alias("y")), "id")
    m = stats.logit_metrics("x", "y")
    return j.select("id", *[F.round(m[c], 5).alias(c) for c in ("max_diff", "mean_diff", "rms_diff", "margin")], m["same_top"].alias("same_top"), m["top5_kept"].alias("top5_kept"))


@query("""WITH e AS (SELECT a.vec_id AS id, list_transform(a.embedding, lambda x: exp(x::DOUBLE)) AS x, list_transform(b.embedding, lambda x: exp(x::DOUBLE)) AS y FROM embeddings a JOIN embeddings b ON a.vec_id + 1 = b.vec_id)
SELECT id, round(list_sum(list_transform(range(1, len(x) + 1), lambda i: x[i] / list_sum(x) * ln((x[i] / list_sum(x)) / (y[i] / list_sum(y))))), 5) AS kl FROM e""")
def kl_of_neighbours(spark, sf_dir):
    """Divergence of each vector's softmax from the next one's."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", stats.softmax("embedding").alias("p"))
    j = e.select(F.col("vec_id").alias("id"), "p").join(e.select((F.col("vec_id") - 1).alias("id"), F.col("p").alias("q")), "id")
    return j.select("id", F.round(stats.kl_divergence("p", "q"), 5).alias("kl"))


@query("SELECT vec_id, array_to_string(list_transform(range(1, len(embedding) + 1), lambda i: CAST((i * 7 + vec_id) % 16 - (i - 1) // 8 AS BIGINT) * CAST(1 + (i - 1) // 8 AS BIGINT)), ',') AS weights FROM embeddings")
def dequantise_groups(spark, sf_dir):
    """Four-bit numbers of as many places as a vector has, with a zero and a scale for each eight."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.expr("transform(sequence(1, size(embedding)), i -> cast((i * 7 + vec_id) % 16 as bigint))").alias("v"), F.expr("transform(sequence(0, (size(embedding) - 1) div 8), i -> cast(i as bigint))").alias("z"), F.expr("transform(sequence(0, (size(embedding) - 1) div 8), i -> cast(i + 1 as bigint))").alias("s"))
    return e.select("vec_id", F.array_join(F.transform(stats.dequantise("v", "z", "s", 8), lambda x: x.cast("string")), ",").alias("weights"))


@query("SELECT l_orderkey, array_to_string(list_concat(ids, list_transform(range(0, 20 - len(ids)), lambda i: 0)), ',') AS input_ids, array_to_string(list_concat(list_concat([-100, -100][1:least(2, len(ids))], ids[3:]), list_transform(range(0, 20 - len(ids)), lambda i: -100)), ',') AS labels FROM (SELECT l_orderkey, xs AS ids FROM (WITH " + CASES + " SELECT * FROM cases))")
def pad_and_mask(spark, sf_dir):
    c = cases(spark, sf_dir).select("l_orderkey", F.col("xs").alias("ids"))
    p = stats.pad_and_mask("ids", "2", 20, 0)
    join = lambda x: F.array_join(F.transform(x, lambda v: v.cast("string")), ",")
    return c.select("l_orderkey", join(p["input_ids"]).alias("input_ids"), join(p["labels"]).alias("labels"))


# ---- text

_IDS = "CASE doc_id % 4 WHEN 0 THEN array(1, 11) WHEN 1 THEN array(20, 22, 16) WHEN 2 THEN array(24) ELSE array(4, 18, 19, 23) END"
_DUCK_IDS = "CASE doc_id % 4 WHEN 0 THEN '1,11' WHEN 1 THEN '20,22,16' WHEN 2 THEN '24' ELSE '4,18,19,23' END"


@query(f"SELECT doc_id, {_DUCK_IDS} AS ids, doc_id % 4 <> 2 AS uses_k FROM documents WHERE doc_id % 5 <> 0")
def cnl_round_trip(spark, sf_dir):
    """Sentences of plans, read back; every fifth is broken and must be refused."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.expr(_IDS).alias("ids0"))
    d = d.withColumn("s", F.when(F.col("doc_id") % 5 == 0, F.concat(text.sentence("ids0"), F.lit("!"))).otherwise(text.sentence("ids0")))
    d = d.select("doc_id", *[v.alias(k) for k, v in text.parse_sentence("s").items()])
    return d.where("error IS NULL").select("doc_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), "uses_k")


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN '1,11' WHEN 1 THEN '20,22' WHEN 2 THEN '22' END AS ids, CASE doc_id % 5 WHEN 0 THEN 3 WHEN 1 THEN 4 WHEN 2 THEN 7 END::BIGINT AS k, CASE doc_id % 5 WHEN 3 THEN 'unknown step: 消す' WHEN 4 THEN 'different numbers' END AS error FROM documents")
def plan_parse(spark, sf_dir):
    plans = ["1. 偶数だけを残す\n2) 各要素にkを加える\nk = 3", "- **値を降順に並べる**\n- 先頭から4個を取る", "手順：先頭から７個を取る。", "値を降順に並べる、消す", "各要素に2を加える→各要素に3を掛ける"]
    d = table(spark, sf_dir, "documents").select("doc_id", F.element_at(F.array(*[F.lit(p) for p in plans]), (F.col("doc_id") % 5 + 1).cast("int")).alias("t"))
    phrases = text.phrase_table(spark).select("phrase", "id", "uses_k")
    out = text.parse_plans(d, "doc_id", "t", phrases)
    return out.select("doc_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"), "k", "error")


@query("SELECT conv_id, turn, CASE conv_id % 3 WHEN 0 THEN 'x = 1' WHEN 1 THEN trim(role) END AS code, CASE WHEN conv_id % 3 = 2 THEN 'fences' END AS error FROM conversations")
def code_fence_extract(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").withColumn("t", F.expr("CASE conv_id % 3 WHEN 0 THEN 'so:\\n```python\\nx = 1\\n```' WHEN 1 THEN concat(' ', role, ' ') ELSE '```\\na\\n```\\n```' END"))
    f = text.fenced_code("t")
    return c.select("conv_id", "turn", f["code"].alias("code"), f["error"].alias("error"))


@query("SELECT doc_id, CASE doc_id % 4 WHEN 3 THEN NULL ELSE '{\"a\":' || doc_id || '}' END AS json, doc_id % 4 IN (1, 2) AS repaired FROM documents")
def json_repair(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("t", F.expr("concat(CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '```json\\n' WHEN 2 THEN 'Sure: ' ELSE '{{' END, '{\"a\":', doc_id, '}', CASE doc_id % 4 WHEN 1 THEN '\\n```' WHEN 2 THEN ' done' ELSE '' END)"))
    r = text.repaired_json("t")
    return d.select("doc_id", r["json"].alias("json"), r["repaired"].alias("repaired"))


@query("SELECT doc_id, 'Task ' || source || ' in ' || lang || ' of $5' AS prompt, sha256('Task ' || source || ' in ' || lang || ' of $5') AS prompt_hash FROM documents")
def prompt_template(spark, sf_dir):
    p = text.fill_template("Task $source in $lang of $5", source=F.col("source"), lang=F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", p.alias("prompt"), F.sha2(p, 256).alias("prompt_hash"))


@query("SELECT doc_id, 'p' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '' ELSE ',q' END AS kept FROM documents")
def paraphrase_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("c", F.expr("array(source, concat('p', doc_id), concat(' p', doc_id, ' '), IF(doc_id % 2 = 0, '<think>q', 'q'), '', '```r', 's') "))
    return d.select("doc_id", F.array_join(text.acceptable_paraphrases("slice(c, 1, 6)", "source", 2), ",").alias("kept"))


@query("SELECT doc_id, doc_id % 3 = 0 AS valid FROM documents")
def expression_validity(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("t", F.expr("CASE doc_id % 3 WHEN 0 THEN '各要素にkを足す' WHEN 1 THEN '各要素にnを足す' ELSE '足す。' END"))
    return d.select("doc_id", text.valid_expression("t").alias("valid"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'a|b' ELSE '' END AS steps, CASE doc_id % 4 WHEN 0 THEN NULL ELSE doc_id END AS k FROM documents")
def numbered_and_k(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("t", F.expr("IF(doc_id % 3 = 0, '1. a\\n2) b', '1. a\\n3. b')")).withColumn("n", F.expr("IF(doc_id % 4 = 0, ' ', concat('+', doc_id))"))
    return d.select("doc_id", F.array_join(text.numbered_steps("t"), "|").alias("steps"), text.parse_k("n").alias("k"))


@query("SELECT doc_id, doc_id % 2 = 0 AS follows FROM documents")
def context_detection(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.expr("IF(doc_id % 2 = 0, 'それを降順にして', '偶数を残す')").alias("t")).select("doc_id", text.follows_up("t").alias("follows"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'step 2' WHEN doc_id % 3 = 0 THEN 'k' END AS difference FROM documents")
def plan_comparison(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.array(F.lit(1), F.lit(2)).alias("a"), F.expr("IF(doc_id % 2 = 0, array(1, 3), array(1, 2))").alias("b"), F.lit(1).alias("ka"), F.expr("IF(doc_id % 3 = 0, 2, 1)").alias("kb"))
    return d.select("doc_id", text.same_plan("a", "ka", "b", "kb").alias("difference"))


@query(None)
def text_normalisation(spark, sf_dir):
    d = text.nfkc(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "n")
    return d.select("doc_id", F.sha2(F.regexp_replace("n", r"\s+", ""), 256).alias("key"))


@query(None)
def closest_benchmark_text(spark, sf_dir):
    """Of each benchmark item the closest text among the others of its key, the last digit of its id."""
    b = table(spark, sf_dir, "benchmark").select("item_id", (F.col("item_id") % 10).alias("key"), "text")
    return text.closest_of_key(b, "item_id", "key", "text").select("item_id", "other", F.round("ratio", 9).alias("ratio"))


# ---- sandbox

@query("""SELECT 'combined-' || lpad(CAST(i AS VARCHAR), 6, '0') AS spec_id, true AS passed, 'pass' AS reason, CAST(41 AS INT) AS tests_passed FROM range(1, 25) t(i), range(2) v
UNION ALL VALUES ('bad-mismatch', false, 'output_mismatch', 2), ('bad-mutation', false, 'input_mutation', 1), ('bad-import', false, 'contract_signature', 0), ('bad-syntax', false, 'syntax_error', 0), ('bad-runtime', false, 'runtime_error', 1), ('bad-signature', false, 'contract_signature', 0)""")
def verify_sandbox(spark, sf_dir):
    """Rendered code of every atomic operation and some faulty ones, run in isolation against the interpreter."""
    one = render.variants(specs.permutations(specs.atomic_table(spark), 1), True, limit=2, seed=1)
    good = one.select("spec_id", "ast", render.render().alias("code"))
    head = render.HEAD
    ast = canonical_json(ast_of([Op("filter", "even")]))
    bad = [
        ("bad-mismatch", ast, head + "    return xs\n"), ("bad-mutation", ast, head + "    xs[0:3] = []\n    return xs\n"), ("bad-import", ast, "import os\n" + head + "    return xs\n"),
        ("bad-syntax", ast, head + "    return (\n"), ("bad-runtime", ast, head + "    return [xs[2] for x in xs]\n"), ("bad-signature", ast, "def solve(xs, k):\n    return xs\n"),
    ]
    rows = good.unionByName(spark.createDataFrame(bad, "spec_id string, ast string, code string"))
    return sandbox.verify(rows, "code", "ast", sandbox.build_cases(11, 32)).select("spec_id", "passed", "reason", "tests_passed")


# Codes and what each policy says of them: null where they may run.
_CODES = {
    "ok": ("return sorted(xs)", None, None, None),
    "call": ("return eval('xs')", "contract_call", "contract_call", "contract_call"),
    "dunder": ("return xs.__class__", "contract_attribute", "contract_attribute", "contract_node"),
    "power": ("return [x ** 9 for x in xs]", "contract_exponent", None, "contract_exponent"),
    "continue": ("for x in xs:\n        continue\n    return xs", "contract_node", None, None),
    "break": ("for x in xs:\n        break\n    return xs", "contract_node", None, None),
    "pass": ("pass\n    return xs", "contract_node", None, None),
    "division": ("return [x / 2 for x in xs]", "contract_node", None, "contract_node"),
    "plus": ("return [+x for x in xs]", "contract_node", None, None),
    "generator": ("return list(x for x in xs)", "contract_node", "contract_node", None),
    "membership": ("return [x for x in xs if x in [1, 2]]", "contract_node", "contract_node", None),
    "append": ("ys = []\n    ys.append(k)\n    return ys", "contract_call", None, "contract_call"),
    "text": ("return 'xs'", "contract_constant", None, "contract_constant"),
    "zip": ("return [x for x in zip(xs, xs)]", "contract_call", "contract_call", None),
    "unknown": ("return ys", None, "contract_name", None),
    "lambda": ("f = lambda: xs\n    return xs", "contract_node", "contract_node", "contract_node"),
    "syntax": ("return (", "syntax_error", "syntax_error", "syntax_error"),
}
_SAID = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in (name, *said)) + ")" for name, (_, *said) in _CODES.items())


@query(f"SELECT * FROM (VALUES {_SAID}, ('bare', 'contract_signature', NULL, NULL)) t(name, strict, benchmark, browser)")
def static_checks(spark, sf_dir):
    codes = [(name, f"{render.HEAD}    {code}\n") for name, (code, *_) in _CODES.items()] + [("bare", "def solve(xs, k):\n    return xs\n")]
    return spark.createDataFrame(codes, "name string, code string").select("name", *[sandbox.static_check("code", p).alias(p) for p in sandbox.POLICIES])


@query(None)
def reference_renderer(spark, sf_dir):
    return specs.permutations(specs.atomic_table(spark), 2).select("spec_id", F.sha2(render.reference_code(), 256).alias("code_hash"))



# ---- metric streams, freezes and sets

@query("""WITH l AS (SELECT event_id AS step, value AS validation_loss FROM events WHERE event_id % 25 = 24), t AS (SELECT event_id AS step, value AS loss FROM events WHERE event_id % 25 <> 24 AND value IS NOT NULL)
SELECT l.step, l.validation_loss, t.loss FROM l ASOF LEFT JOIN t ON l.step >= t.step""")
def epoch_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value IS NOT NULL")
    valid = F.col("event_id") % 25 == 24
    stream = e.select(F.col("event_id").alias("step"), F.when(~valid, F.col("value")).alias("loss"), F.when(valid, F.col("value")).alias("validation_loss"), F.when(valid, "validation").alias("event"))
    train, validation = metrics.split_stream(stream)
    return metrics.epoch_metrics(train, validation, 64)


@query(f"""WITH {_ATT}, r AS (SELECT layer % 2 AS variant, block, layer AS head, q AS step, CASE WHEN k < 3 THEN 'head' ELSE 'tail' END AS region, sum(weight) AS mass FROM w GROUP BY 1, 2, 3, 4, 5),
n AS (SELECT layer % 2 AS variant, count(DISTINCT (block, layer, q)) AS n FROM w GROUP BY 1) SELECT variant, region, round(sum(mass) / any_value(n), 6) AS mass FROM r JOIN n USING (variant) GROUP BY 1, 2""")
def variant_regions(spark, sf_dir):
    w = _weights(spark, sf_dir).select((F.col("layer") % 2).alias("variant"), F.struct("block", "layer").alias("head"), F.col("q").alias("step"), "k", "weight")
    return metrics.variant_regions(w, _regions(spark)).withColumn("mass", F.round("mass", 6))


@query("WITH e AS (SELECT label AS model, vec_id, list_max(embedding)::DOUBLE AS v FROM embeddings) SELECT model, round(avg(v), 6) AS mean, round(min(v), 6) AS least, round(max(v), 6) AS greatest, arg_max(vec_id, v) AS best_head FROM e GROUP BY 1")
def head_report(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("model"), F.col("vec_id").alias("head"), F.array_max("embedding").cast("double").alias("v"))
    out = metrics.head_report(e, "model", "head", "v")
    return out.select("model", *[F.round(c, 6).alias(c) for c in ("mean", "least", "greatest")], "best_head")


@query(f"WITH {_ATT} SELECT block, layer, q, sum(weight) AS total FROM w GROUP BY 1, 2, 3 HAVING abs(sum(weight) - 1) > 0.0001")
def attention_rows_sum(spark, sf_dir):
    return metrics.unnormalised(_weights(spark, sf_dir), ["block", "layer", "q"])


@query("SELECT lang, round(sum(CASE WHEN n_chars > 500 THEN n_chars END) / count(*) FILTER (WHERE n_chars > 500), 6) AS long_mean, round(sum(CASE WHEN source = 'src0' THEN n_chars END) / nullif(count(*) FILTER (WHERE source = 'src0'), 0), 6) AS src0_mean FROM documents GROUP BY 1")
def conditional_means(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.round(stats.conditional_mean("n_chars", "n_chars > 500"), 6).alias("long_mean"), F.round(stats.conditional_mean("n_chars", "source = 'src0'"), 6).alias("src0_mean"))


@query("""SELECT * FROM (SELECT 'repeated keys' AS problem, count(*) - count(DISTINCT item_id) AS n FROM benchmark UNION ALL SELECT 'off total', abs(count(*) - 50) FROM benchmark
UNION ALL SELECT 'categories off', count(*) FROM (SELECT item_id % 10 FROM benchmark GROUP BY 1 HAVING count(*) <> 5))""")
def benchmark_freeze(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").withColumn("category", F.col("item_id") % 10)
    return scoring.freeze_problems(b, "item_id", "category", 50, 5)


@query("SELECT 'text' AS kind, count(*) AS n FROM documents WHERE doc_id % 2 = 0 AND text IN (SELECT text FROM documents WHERE doc_id % 2 = 1) UNION ALL SELECT 'source', count(*) FROM documents WHERE doc_id % 2 = 0 AND source IN (SELECT source FROM documents WHERE doc_id % 2 = 1)")
def leakage_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    return dedup.leakage_counts(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), {"text": "h", "source": "source"})


@query("SELECT 'set' || i AS set_name, CAST(64 AS BIGINT) AS n, CAST(64 AS BIGINT) AS keys FROM range(6) t(i)")
def evaluation_sets(spark, sf_dir):
    """Six disjoint input sets, and how many of their cases each has."""
    sets = inputs.input_sets(spark, {f"set{i}": 100 + i for i in range(6)}, 64, set())
    return sets.groupBy("set_name").agg(F.count("*").alias("n"), F.countDistinct(inputs.case_key()).alias("keys"))


@query(None)
def new_sequences(spark, sf_dir):
    """Drawn four-step sequences that behave like no two-step spec, no one before them and no shorter part of theirs, on 177 fixed inputs."""
    ops = specs.ATOMIC
    drawn = specs.random_sequences(20261008, 40)
    few = spark.createDataFrame([(f"c{i:03d}", xs, k) for i, (xs, k) in enumerate(inputs.fixed_cases(3))], "case_id string, xs array<bigint>, k int")
    rows = lambda many: spark.createDataFrame([(s, [(ops[p - 1].kind, ops[p - 1].name, ops[p - 1].arg) for p in ps]) for s, ps in many], "spec_id string, ops array<struct<kind:string,name:string,arg:int>>")
    small = [(f"d{i:03d}", p) for i, p in enumerate(drawn)]
    f = lambda many: inputs.fingerprints(inputs.execute(rows(many), few, wide=True))
    cut = [(f"{s}/{j}", p[:j] + p[j + 1 :]) for s, p in small for j in range(4)]
    shorter = f(cut).withColumn("spec_id", F.split("spec_id", "/")[0])
    known = f([(f"k{a}-{b}", (a, b)) for a in range(1, 25) for b in range(1, 25) if a != b])
    return specs.behaviourally_new(f(small).withColumn("place", F.col("spec_id")), known, shorter, 20).select("spec_id", "fingerprint")
