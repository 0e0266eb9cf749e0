"""Sampling, joins, dedup, distribution and corpus queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.catalog.base import table
from sparkloom.functions.hashing import seeded_rank
from sparkloom.functions.stats import length_summary
from sparkloom.operators import dedup, dictionary, instructions, joins, reports, sampling, tokenizing
from sparkloom.plans.specs import split_problems

QUERIES: dict = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# ---- sampling

@query("SELECT doc_id, lang, r AS rank FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('17' || chr(0) || lang || chr(0) || doc_id), doc_id)::INT AS r FROM documents) WHERE r <= 10")
def topn_seeded_hash(spark, sf_dir):
    return sampling.top_per_group(_docs(spark, sf_dir), "lang", "doc_id", 10, 17).select("doc_id", "lang", "rank")


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) < 50")
def topn_shortfall(spark, sf_dir):
    return sampling.groups_short_of(_docs(spark, sf_dir), "lang", 50)


@query("SELECT o_orderkey FROM orders ORDER BY sha256('5' || chr(0) || o_orderkey), o_orderkey LIMIT 100")
def sample_seeded(spark, sf_dir):
    return sampling.sample(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 100, 5).select("o_orderkey")


@query("SELECT o_orderkey, CAST((row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1) // 96 AS BIGINT) AS batch FROM orders")
def micro_batches(spark, sf_dir):
    return sampling.micro_batches(table(spark, sf_dir, "orders"), ["o_orderkey"], 96, ["o_orderpriority"]).select("o_orderkey", "batch")


def _expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as expressions of their regions' operations."""
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])
    return rows.select(F.concat(F.lit("e"), F.lpad(F.col("n_nationkey").cast("string"), 3, "0")).alias("expression_id"), F.concat(F.lit("op"), F.col("n_regionkey").cast("string")).alias("op_id"), F.col("r_name").alias("op"), F.col("n_name").alias("final"), F.concat("n_name", F.lit("て")).alias("connective"), F.lit("train").alias("dictionary"))


def _specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered pairs of regions as specs."""
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    b = r.select(F.col("r_regionkey").alias("k2"), F.col("r_name").alias("n2"))
    return r.join(F.broadcast(b), F.col("r_regionkey") != F.col("k2")).select(F.concat_ws("-", F.lit("spec"), "r_regionkey", "k2").alias("spec_id"), F.concat_ws("+", "r_name", "n2").alias("ast"), F.array("r_name", "n2").alias("ops"))


@query("""WITH s AS (SELECT 'spec-' || a.r_regionkey || '-' || b.r_regionkey AS spec_id, a.r_name || '+' || b.r_name AS ast, a.r_regionkey AS k1, b.r_regionkey AS k2 FROM region a JOIN region b ON a.r_regionkey <> b.r_regionkey),
o AS (SELECT n_regionkey AS k, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS i, count(*) OVER (PARTITION BY n_regionkey) AS n, 'e' || lpad(n_nationkey::VARCHAR, 3, '0') AS id FROM nation),
p AS (SELECT spec_id, ast, n1.n * n2.n AS size, n1.n AS r1, n2.n AS r2 FROM s JOIN (SELECT DISTINCT k, n FROM o) n1 ON n1.k = k1 JOIN (SELECT DISTINCT k, n FROM o) n2 ON n2.k = k2),
d AS (SELECT *, sha256('3' || chr(0) || spec_id || chr(0) || ast) AS h FROM p),
f AS (SELECT *, ('0x' || h[1:16])::UBIGINT % size AS off, CASE WHEN ('0x' || h[17:32])::UBIGINT % size = 0 THEN 1 ELSE ('0x' || h[17:32])::UBIGINT % size END AS s0 FROM d),
g AS (SELECT *, (list_filter([(s0::BIGINT - 1 + j) % size::BIGINT + 1 FOR j IN range(0, 100)], lambda x: gcd(x, size::BIGINT) = 1))[1] AS step FROM f),
w AS (SELECT *, unnest(range(0, least(size, 12)::BIGINT)) AS i FROM g),
x AS (SELECT spec_id, i, ((off::BIGINT + i * step) % size::BIGINT) AS lin, r1, r2 FROM w)
SELECT x.spec_id, CAST(x.i AS BIGINT) AS i, a.id || ',' || b.id AS expression_ids, 'list: ' || a.n_name || 'て、' || b.n_name AS instruction,
 'instruction-rule-' || sha256(x.spec_id || chr(0) || 'no-k' || chr(0) || a.id || chr(0) || b.id) AS instruction_id
FROM x JOIN s USING (spec_id) JOIN o a ON a.k = s.k1 AND a.i = x.lin // x.r2 JOIN o b ON b.k = s.k2 AND b.i = x.lin % x.r2""")
def affine_product_sample(spark, sf_dir):
    grouped = instructions.grouped_expressions(_expressions(spark, sf_dir))
    rows = instructions.rule_instructions(instructions.with_options(_specs(spark, sf_dir), grouped), 3, 12, ("with-k", "k list: {}"), ("no-k", "list: {}"), ["op9"])
    return rows.select("spec_id", "i", F.array_join("expression_ids", ",").alias("expression_ids"), "instruction", "instruction_id")


@query("""WITH c AS (SELECT n_regionkey AS k, count(DISTINCT n_name) AS n FROM nation GROUP BY 1)
SELECT CAST(sum(least(20, a.n * b.n)) AS BIGINT) AS expected FROM c a JOIN c b ON a.k <> b.k""")
def expected_cardinality(spark, sf_dir):
    grouped = instructions.grouped_expressions(_expressions(spark, sf_dir))
    rows = instructions.with_options(_specs(spark, sf_dir), grouped)
    return sampling.expected_rows(rows.withColumn("counts", F.expr("transform(steps, s -> cast(size(s.options) as bigint))")), "counts", 20)


@query("""WITH i AS (SELECT n_nationkey, n_regionkey, count(s_suppkey) AS u FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1, 2)
SELECT n_regionkey, count(*) AS items, min(u) AS least, max(u) AS greatest, avg(u) AS mean FROM i GROUP BY 1""")
def usage_summary(spark, sf_dir):
    used = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    return sampling.usage_summary(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), used, "n_regionkey", "n_nationkey")


@query("SELECT r_name AS op FROM region WHERE r_name NOT IN ('ASIA', 'EUROPE')")
def unknown_operations(spark, sf_dir):
    grouped = instructions.grouped_expressions(_expressions(spark, sf_dir)).where("op IN ('ASIA', 'EUROPE')")
    return instructions.unknown_operations(_specs(spark, sf_dir), grouped)


# ---- joins

@query("SELECT coalesce(a.k, b.k) AS key, n_left, n_right, CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS side FROM (SELECT o_orderkey AS k, count(*) AS n_left FROM orders GROUP BY 1) a FULL JOIN (SELECT l_orderkey AS k, count(*) AS n_right FROM lineitem GROUP BY 1) b ON a.k = b.k")
def merge_join_audit(spark, sf_dir):
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return joins.full_match(a, table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key")), "key")


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def exact_join(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    keyed = n.withColumnRenamed("n_regionkey", "key")
    return joins.exact_join(keyed, r.withColumnRenamed("r_regionkey", "key"), "key").select("n_nationkey", "n_name", "r_name")


@query("SELECT user_id FROM (SELECT user_id, count(*) AS n, max(event_id) - min(event_id) + 1 AS w FROM events GROUP BY 1) WHERE n <> w")
def reappearing_keys(spark, sf_dir):
    return joins.reappearing(table(spark, sf_dir, "events"), "user_id", "event_id")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM orders),
l AS (SELECT o_custkey, l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY o_custkey ORDER BY sha256('9' || chr(0) || l_orderkey || chr(0) || l_linenumber || chr(0) || l_partkey), l_suppkey) AS i FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT o.o_custkey, o.o_orderkey, l.l_orderkey, l.l_partkey, CAST(i AS INT) AS i FROM o JOIN l USING (o_custkey, i)""")
def exact_pairing(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    line = table(spark, sf_dir, "lineitem")
    right = line.join(o.select("o_custkey", F.col("o_orderkey").alias("l_orderkey")), "l_orderkey").select("o_custkey", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rank = [seeded_rank(9, "l_orderkey", "l_linenumber", "l_partkey"), F.col("l_suppkey")]
    return joins.positional(o, right, "o_custkey", [F.col("o_orderdate"), F.col("o_orderkey")], rank).select("o_custkey", "o_orderkey", "l_orderkey", "l_partkey", "i")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY h) AS r FROM (SELECT l_orderkey, l_returnflag, l_linenumber, l_partkey, l_suppkey, sha256('2' || chr(0) || l_partkey || chr(0) || l_suppkey || chr(0) || l_linenumber || chr(0) || CAST(CAST(l_quantity AS INT) AS VARCHAR) || chr(0) || CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR)) AS h FROM lineitem))
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(p AS INT) AS pick FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY r, l_returnflag) AS p FROM r) WHERE p <= 3""")
def balanced_selection(spark, sf_dir):
    rank = seeded_rank(2, "l_partkey", "l_suppkey", "l_linenumber", F.col("l_quantity").cast("int"), F.round(F.col("l_extendedprice") * 100).cast("long"))
    return joins.balanced(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", rank, F.lit(3)).where("selected").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "pick")


@query("""SELECT n.n_nationkey, s.doc_id FROM (SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) n
JOIN (SELECT doc_id, row_number() OVER (ORDER BY sha256('4' || chr(0) || doc_id), doc_id) AS i FROM documents) s USING (i)""")
def distinct_assignment(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.lit(1).alias("g"))
    d = sampling.sample(_docs(spark, sf_dir).select("doc_id"), "doc_id", n.count(), 4).withColumn("g", F.lit(1))
    return joins.assign_distinct(n, d, "g", [F.col("n_nationkey")], [F.col("rank_hash"), F.col("doc_id")]).select("n_nationkey", "doc_id")


@query("""SELECT d.doc_id, CASE WHEN quality = 1 THEN 'approved ' || d.doc_id ELSE source END AS source, CASE WHEN quality = 1 THEN 'replaced' WHEN quality = 0 THEN 'failed: low quality' ELSE 'retained' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)""")
def replace_left_coalesce(spark, sf_dir):
    lab = table(spark, sf_dir, "labels")
    ok = lab.where("quality = 1").select("doc_id", F.concat(F.lit("approved "), F.col("doc_id").cast("string")).alias("source"))
    bad = lab.where("quality = 0").select("doc_id", F.lit("low quality").alias("reason"))
    return joins.replace_approved(_docs(spark, sf_dir).select("doc_id", "source"), ok, bad, "doc_id", "source")


@query("SELECT lang AS key, CAST(NULL AS BIGINT) AS n_left, CAST(NULL AS BIGINT) AS n_right FROM documents WHERE false")
def replacement_balance(spark, sf_dir):
    src = _docs(spark, sf_dir).select("doc_id", "source", F.col("lang").alias("key"))
    return joins.replacement_balance(src, joins.replace_approved(src, src.limit(0), src.select("doc_id", F.lit("x").alias("reason")).limit(0), "doc_id", "source"), "key").select("key", "n_left", "n_right")


@query("""WITH p AS (SELECT doc_id, 'family-' || sha256(lang) AS family_id, 'record-' || sha256(source || chr(0) || lang || chr(0) || CASE WHEN doc_id % 3 = 0 THEN 'null' ELSE '"suite"' END || chr(0) || '["t1"]') AS record_id, sha256(lang) AS text_hash, sha256(source) AS code_hash FROM documents) SELECT * FROM p""")
def final_records(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.col("lang").alias("ast"), F.col("lang").alias("instruction"), F.when(F.col("doc_id") % 3 != 0, "suite").alias("test_suite"), F.col("source").alias("code_id"), F.col("source").alias("code"), F.lit('["t1"]').alias("tests"))
    return joins.final_records(d).select("doc_id", "family_id", "record_id", "text_hash", "code_hash")


@query("SELECT doc_id, 'record-' || sha256('r' || doc_id || chr(0) || 'boundary' || chr(0) || 'edge') AS record_id, 'r' || doc_id AS derived_from FROM documents")
def derived_suite(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("record_id"))
    return joins.derived_suite(d, "boundary", "edge").select("doc_id", "record_id", "derived_from")


@query("SELECT lang, count(*) AS records, count(DISTINCT doc_id) AS distinct_ids, count(DISTINCT source) AS specs FROM documents GROUP BY 1")
def suite_summary(spark, sf_dir):
    return joins.suite_summary(_docs(spark, sf_dir).withColumnRenamed("doc_id", "record_id").withColumnRenamed("source", "spec_id"), "lang")


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'fresh' WHEN doc_id % 2 = 0 THEN 'cached' END AS source, CASE WHEN doc_id % 4 = 0 THEN n_chars + 1 WHEN doc_id % 2 = 0 THEN n_chars END AS n_chars FROM documents")
def delta_assembly(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "n_chars")
    return joins.delta(d.select("doc_id"), d.where("doc_id % 4 = 0").withColumn("n_chars", F.col("n_chars") + 1), d.where("doc_id % 2 = 0"), "doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 = 0")
def suite_filter(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.expr("IF(doc_id % 2 = 0, 'test', 'train')").alias("split"), F.expr("IF(doc_id % 3 = 0, NULL, 'normal')").alias("test_suite"))
    return joins.in_suite(d, "test", None).select("doc_id")


# ---- dedup and contamination

@query("SELECT doc_id, text FROM (SELECT doc_id, sha256(text) AS text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def exact_dedup_first_wins(spark, sf_dir):
    return dedup.first_wins(_docs(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("text")), ["text"], ["doc_id"]).select("doc_id", "text")


@query("SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS first, doc_id <> min(doc_id) OVER (PARTITION BY text) AS is_duplicate FROM documents")
def marked_duplicates(spark, sf_dir):
    return dedup.marked_duplicates(_docs(spark, sf_dir).select("doc_id", "text"), "text", "doc_id").select("doc_id", "first", "is_duplicate")


@query("WITH s AS (SELECT DISTINCT source, sha256(text) AS h FROM documents) SELECT a.source AS a, b.source AS b, count(*) AS common FROM s a JOIN s b ON a.h = b.h AND a.source < b.source GROUP BY 1, 2")
def cross_set_overlap(spark, sf_dir):
    return dedup.set_overlap(_docs(spark, sf_dir).select("source", F.sha2("text", 256).alias("h")), "source", "h")


@query("SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM documents WHERE source = 'src0')")
def exclusion_set(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "source", F.sha2("text", 256).alias("h"), "text")
    return dedup.exclude_known(d, d.where("source = 'src0'"), "h", "text").select("doc_id")


_TOKENS = "regexp_extract_all(text, '[^\\s]+')"


def _tokens(rows: DataFrame) -> DataFrame:
    return rows.withColumn("tokens", F.expr("filter(split(text, '[ \\\\t\\\\n\\\\r\\\\f]+'), x -> x <> '')"))


@query(r"""WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f]+') AS t FROM documents), b AS (SELECT item_id, regexp_extract_all(text, '[^ \t\n\r\f]+') AS t FROM benchmark),
bg AS (SELECT array_to_string(t[i:i+7], ' ') AS g, item_id, i - 1 AS o FROM (SELECT item_id, t, unnest(range(1, len(t) - 6)) AS i FROM b)),
bi AS (SELECT g, min((item_id, o)) AS src FROM bg GROUP BY g),
dg AS (SELECT doc_id, i - 1 AS o, array_to_string(t[i:i+7], ' ') AS g FROM (SELECT doc_id, t, unnest(range(1, len(t) - 6)) AS i FROM d)),
m AS (SELECT doc_id, o, g, src, row_number() OVER (PARTITION BY doc_id ORDER BY o) AS r FROM dg JOIN bi USING (g))
SELECT doc_id, CAST(o AS INT) AS row_offset, g AS gram, src[1] AS source, CAST(src[2] AS INT) AS offset FROM m WHERE r = 1""")
def ngram_contamination(spark, sf_dir):
    index = dedup.gram_index(_tokens(table(spark, sf_dir, "benchmark")), "item_id", "tokens", 8)
    return dedup.contamination(_tokens(_docs(spark, sf_dir)), "doc_id", "tokens", index, 8)


@query(r"""WITH d AS (SELECT doc_id, regexp_extract_all(text, '[^ \t\n\r\f]+') AS t FROM documents), b AS (SELECT regexp_extract_all(text, '[^ \t\n\r\f]+') AS t FROM benchmark),
bg AS (SELECT DISTINCT array_to_string(t[i:i+7], ' ') AS g FROM (SELECT t, unnest(range(1, len(t) - 6)) AS i FROM b)),
m AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, array_to_string(t[i:i+7], ' ') AS g FROM (SELECT doc_id, t, unnest(range(1, len(t) - 6)) AS i FROM d)) JOIN bg USING (g))
SELECT count(*) AS rows, count(*) FILTER (WHERE len(t) >= 8) AS eligible, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM m)) AS matched FROM d""")
def contamination_summary(spark, sf_dir):
    docs = _tokens(_docs(spark, sf_dir))
    index = dedup.gram_index(_tokens(table(spark, sf_dir, "benchmark")), "item_id", "tokens", 8)
    return dedup.contamination_summary(docs, "doc_id", "tokens", dedup.contamination(docs, "doc_id", "tokens", index, 8), 8)


@query("""WITH u AS (SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY lang, source), r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, source) AS n FROM u) SELECT lang, source, doc_id FROM r WHERE n <= 5""")
def quota_after_dedup(spark, sf_dir):
    d = _docs(spark, sf_dir).select("lang", F.concat_ws("/", "lang", "source").alias("code"), "doc_id")
    out = dedup.take_until_quota(d, "lang", "lang", "doc_id", "code", 5)
    return out.select("lang", F.split("code", "/")[1].alias("source"), "doc_id")


@query("SELECT source, CAST(60 - count(*) AS BIGINT) AS missing FROM documents GROUP BY 1 HAVING count(*) < 60")
def quota_shortfalls(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return dedup.shortfalls(d, d.select("source").distinct(), "source", 60).select("source", F.col("missing").cast("long").alias("missing"))


@query(r"""SELECT doc_id, array_to_string(list_sort(list_filter(['LicensedundertheApacheLicense', 'ReleasedundertheMITLicense', 'withthe'], lambda p: contains(regexp_replace(text, '\s+', '', 'g'), p))), ',') AS phrases FROM documents
WHERE len(list_filter(['LicensedundertheApacheLicense', 'ReleasedundertheMITLicense', 'withthe'], lambda p: contains(regexp_replace(text, '\s+', '', 'g'), p))) > 0""")
def phrase_leakage(spark, sf_dir):
    phrases = spark.createDataFrame([("Licensed under the Apache License",), ("Released under the MIT License",), ("with the",)], "phrase string")
    return dedup.phrase_leaks(_docs(spark, sf_dir).select("doc_id", "text"), "text", phrases, "phrase").select("doc_id", F.array_join("phrases", ",").alias("phrases"))


@query("SELECT p AS phrase, count(*) AS n FROM documents, (VALUES ('License'), ('token'), ('example.com')) v(p) WHERE contains(text, p) GROUP BY p")
def weighted_phrase_counts(spark, sf_dir):
    return dedup.weighted_phrase_counts(_docs(spark, sf_dir).select("text"), "text", ["License", "token", "example.com"])


@query("SELECT item_id, sha256(CASE WHEN item_id % 2 = 0 THEN 'Please: ' || text ELSE text END) AS text, item_id % 2 = 0 AS changed FROM benchmark")
def rewrite_duplicates(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    return dedup.rewrite_duplicates(b, b.where("item_id % 2 = 0"), "text", "Please: {}").select("item_id", F.sha2("text", 256).alias("text"), "changed")


@query("SELECT * FROM (SELECT 'off quota' AS problem, count(*) AS n FROM (SELECT lang FROM documents GROUP BY 1 HAVING count(*) <> 100) UNION ALL SELECT 'hash differs', count(*) FROM documents WHERE doc_id % 5 = 0)")
def quota_audit(spark, sf_dir):
    d = _docs(spark, sf_dir).select("lang", "text", F.when(F.col("doc_id") % 5 != 0, F.sha2("text", 256)).alias("h"))
    return dedup.spec_quota_audit(d, "lang", 100, "text", "h")


# ---- distributions

@query("SELECT n, count(*) AS frequency FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY 1")
def histogram(spark, sf_dir):
    return reports.histogram(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")), "n")


@query("SELECT event_type AS tag, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'user' || user_id % 4, count(*) FROM events GROUP BY 1")
def tag_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.array("event_type", F.concat(F.lit("user"), (F.col("user_id") % 4).cast("string"))).alias("tags"))
    return reports.tag_counts(e, "tags")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("l_returnflag")).alias("ops"), F.countDistinct("l_returnflag").cast("int").alias("n_ops"))


@query("""SELECT n_ops, count(*) AS specs, CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (WHERE n < 4) AS short_specs, CAST(sum(greatest(0, 4 - n)) AS BIGINT) AS missing FROM (SELECT count(*) AS n, count(DISTINCT l_returnflag)::INT AS n_ops FROM lineitem GROUP BY l_orderkey) GROUP BY ROLLUP (n_ops)""")
def distribution_rollup(spark, sf_dir):
    return reports.rollup_summary(_orders(spark, sf_dir), "n_ops", 4, total="n")


@query("""WITH s AS (SELECT l_orderkey, count(*) AS n, list(l_returnflag) AS ops, count(DISTINCT l_returnflag)::INT AS n_ops FROM lineitem GROUP BY 1),
h AS (SELECT t AS target, n_ops, n, len(list_filter(ops, lambda x: x = t)) AS occ FROM s, (VALUES ('A'), ('R')) v(t) WHERE list_contains(ops, t))
SELECT target, n_ops, count(*) AS specs, CAST(sum(n) AS BIGINT) AS weights, CAST(sum(occ) AS BIGINT) AS occurrences, sum(n) / (SELECT sum(n) FROM s) AS share FROM h GROUP BY GROUPING SETS ((target), (target, n_ops))""")
def coverage_by_operation(spark, sf_dir):
    return reports.coverage(_orders(spark, sf_dir), "ops", "n", ["A", "R"], "n_ops")


@query("SELECT o_custkey, count(*) AS n, min(o_orderstatus) AS ast, min(o_orderpriority) AS n_ops, min(o_orderstatus) = max(o_orderstatus) AND min(o_orderpriority) = max(o_orderpriority) AS consistent FROM orders GROUP BY 1")
def spec_counts(spark, sf_dir):
    return reports.spec_counts(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "o_orderpriority")


@query("SELECT o_orderkey, 'missing' AS problem FROM orders WHERE o_orderkey % 10 = 3 UNION ALL SELECT o_orderkey, 'o_orderstatus differs' FROM orders WHERE o_orderkey % 10 = 4 AND o_orderstatus <> 'X'")
def foreign_keys(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    src = o.where("o_orderkey % 10 <> 3").withColumn("o_orderstatus", F.expr("IF(o_orderkey % 10 = 4, 'X', o_orderstatus)"))
    return reports.foreign_keys(o, "o_orderkey", src, ["o_orderstatus"])


@query("SELECT 'in several splits' AS problem, CAST(0 AS BIGINT) AS n UNION ALL SELECT 'missing', count(*) FROM documents WHERE doc_id % 11 = 0 UNION ALL SELECT 'foreign', 0")
def split_integrity(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", F.expr("IF(doc_id % 2 = 0, 'train', 'test')").alias("split"))
    return split_problems(d.where("doc_id % 11 <> 0"), d, "doc_id")


# ---- corpus and lengths

@query("""WITH u AS (SELECT 'role' AS field, role AS t FROM conversations UNION ALL SELECT 'text', text FROM conversations), d AS (SELECT field, t, count(*) AS n FROM u WHERE t IS NOT NULL GROUP BY 1, 2)
SELECT field, count(*) AS texts, CAST(sum(n) - count(*) AS BIGINT) AS dropped, CAST(sum(length(t)) AS BIGINT) AS characters, CAST(sum(strlen(t)) AS BIGINT) AS bytes FROM d GROUP BY 1""")
def corpus_unpivot_dedup(spark, sf_dir):
    return tokenizing.corpus_stats(tokenizing.corpus_texts(table(spark, sf_dir, "conversations").select("role", "text"), ["role", "text"], ["<|pad|>"]))


@query("SELECT lang, count(*) AS n, avg(n_chars) AS mean, quantile_disc(n_chars, 0.5) AS p50, quantile_disc(n_chars, 0.95) AS p95, quantile_disc(n_chars, 0.99) AS p99, max(n_chars) AS longest FROM documents GROUP BY 1")
def length_percentiles(spark, sf_dir):
    return length_summary(_docs(spark, sf_dir), "n_chars", ["lang"])


@query(None)
def byte_pair_training(spark, sf_dir):
    """The first merges learnt from conversation roles and order priorities."""
    t = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("t"))
    pairs = tokenizing.train_pairs(t, "t", 8)
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "place int, a string, b string")


# ---- dictionary

@query("""SELECT e || '' AS expression_id, source FROM (SELECT 'e' || n_nationkey AS e, 'existing' AS source FROM nation WHERE n_nationkey < 10 UNION ALL SELECT 'e' || n_nationkey, 'reviewed' FROM nation WHERE n_nationkey BETWEEN 10 AND 14 AND n_nationkey % 2 = 0)""")
def merge_reviewed(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("e"), F.col("n_nationkey").cast("string")).alias("expression_id"), F.col("n_regionkey").cast("string").alias("op_id"), F.col("n_name").alias("final"), F.concat("n_name", F.lit("+")).alias("connective"), F.col("n_nationkey").alias("position"))
    reviewed = n.where("position BETWEEN 5 AND 14").withColumn("approved", F.col("position") % 2 == 0)
    return dictionary.merge_reviewed(n.where("position < 10"), reviewed).select("expression_id", "source")


@query("""SELECT 'e' || n_nationkey AS expression_id, CASE WHEN n_nationkey % 3 = 0 THEN 'edited ' || n_nationkey ELSE n_name END AS text, n_nationkey % 3 = 0 AS human_edited FROM nation WHERE n_nationkey % 4 <> 1""")
def prepare_release(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("e"), F.col("n_nationkey").cast("string")).alias("expression_id"), F.col("n_name").alias("generated"), F.expr("CASE WHEN n_nationkey % 3 = 0 THEN concat('edited ', n_nationkey) WHEN n_nationkey % 3 = 1 THEN '  ' END").alias("edited"))
    used = table(spark, sf_dir, "nation").where("n_nationkey % 4 <> 1").select(F.concat(F.lit("e"), F.col("n_nationkey").cast("string")).alias("expression_id"))
    return dictionary.prepare_release(n, used, True).select("expression_id", "text", "human_edited")


@query("SELECT n_nationkey AS expression_id, CASE WHEN n_nationkey IN (3, 5) THEN 'test_only' ELSE 'train' END AS dictionary FROM nation")
def dictionary_labels(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("expression_id"))
    return dictionary.labelled(n, n.where("expression_id IN (3, 5)"))


@query("SELECT sha256(string_agg(r_name, chr(10) ORDER BY r_regionkey) || chr(10)) AS version FROM region")
def dictionary_version(spark, sf_dir):
    return dictionary.version(table(spark, sf_dir, "region"), "r_name", "r_regionkey")


@query("""SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'not pending' WHEN doc_id % 7 = 0 THEN 'unchanged' END AS problem, CASE WHEN doc_id % 5 = 0 THEN 'done' WHEN doc_id % 7 = 0 THEN 'pending' ELSE 'approved' END AS status FROM documents""")
def blanket_approval(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("lang").alias("text"), F.expr("IF(doc_id % 7 = 0, lang, source)").alias("source_text"), F.expr("IF(doc_id % 5 = 0, 'done', 'pending')").alias("status"), F.lit("teacher").alias("origin"), F.lit("train").alias("split"))
    return dictionary.approve(d, "reviewer", "2026-01-01T00:00:00+00:00").select("id", "problem", "status")


@query("SELECT expression_id, problem FROM (SELECT n_nationkey AS expression_id, CASE WHEN n_nationkey % 6 = 1 THEN 'no provenance' WHEN n_nationkey % 6 = 2 THEN 'n_name differs' END AS problem FROM nation) WHERE problem IS NOT NULL")
def release_provenance(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("expression_id"), "n_name")
    p = n.where("expression_id % 6 <> 1").withColumn("n_name", F.expr("IF(expression_id % 6 = 2, 'other', n_name)"))
    return dictionary.with_provenance(n, p, ["n_name"]).where("problem IS NOT NULL").select("expression_id", "problem")


@query("SELECT expression_id, instruction FROM (SELECT 'e' || lpad(n_nationkey::VARCHAR, 3, '0') AS expression_id, 'do ' || n_name AS instruction, n_nationkey FROM nation) WHERE n_nationkey % 2 = 0 AND n_nationkey % 5 <> 0 AND n_nationkey % 3 <> 0")
def paraphrase_test_set(spark, sf_dir):
    e = _expressions(spark, sf_dir).withColumn("i", F.substring("expression_id", 2, 3).cast("int"))
    out = instructions.paraphrase_test(e.where("i % 4 = 0"), e.where("i % 4 = 2"), e.where("i % 5 = 0"), e.where("i % 3 = 0"), "do {}")
    return out.select("expression_id", "instruction")
