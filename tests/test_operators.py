from __future__ import annotations

import json
import random
import time
import zipfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import hashing, stats, text
from sparkloom.operators import cases, dedup, dictionary, instructions, joins, reports, sampling, sandbox, scoring, tokenizing
from sparkloom.plans.algebra import Op, ops_literal
from sparkloom.sources import files
from sparkloom.streaming import resume


def test_balanced_selection_is_the_loop(spark):
    rng = random.Random(1)
    rows = [(g, rng.choice("abc"), f"{rng.random():.9f}") for g in range(40) for _ in range(rng.randint(1, 12))]
    want = set()
    for g in range(40):
        left = {s: sorted(r for x, t, r in rows if (x, t) == (g, s)) for s in "abc"}
        picks = Counter()
        for _ in range(5):
            open_ = [s for s in "abc" if left[s]]
            if not open_:
                break
            s = min(open_, key=lambda x: (picks[x], x))
            picks[s] += 1
            want.add((g, s, left[s].pop(0)))
    df = spark.createDataFrame(rows, "g int, s string, r string")
    assert {(r["g"], r["s"], r["r"]) for r in joins.balanced(df, "g", "s", F.col("r"), F.lit(5)).where("selected").collect()} == want


def test_exact_join_and_assignment_raise(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,), (3,)], "k int")
    with pytest.raises(Exception, match="one side"):
        joins.exact_join(a, b, "k").collect()
    left = spark.createDataFrame([(1, 1), (1, 2)], "k int, x int")
    with pytest.raises(Exception, match="no code is left"):
        joins.assign_distinct(left, spark.createDataFrame([(1, 5)], "k int, y int"), "k", [F.col("x")], [F.col("y")]).collect()
    ok = spark.createDataFrame([(1, "n")], "k int, t string")
    with pytest.raises(Exception, match="both approved and failed"):
        joins.replace_approved(spark.createDataFrame([(1, "o")], "k int, t string"), ok, spark.createDataFrame([(1, "r")], "k int, reason string"), "k", "t").collect()


def test_affine_walk_visits_all(spark):
    s = spark.createDataFrame([("s1", "a", [3, 4]), ("s2", "b", [12]), ("s3", "c", [1]), ("s4", "d", [7, 5, 3])], "spec_id string, ast string, radices array<bigint>")
    rows = sampling.walk(s, 7, 1000).collect()
    for spec, n in (("s1", 12), ("s2", 12), ("s3", 1), ("s4", 105)):
        own = [r for r in rows if r["spec_id"] == spec]
        assert sorted(r["linear"] for r in own) == list(range(n))
        assert len({tuple(r["d"]) for r in own}) == n
        assert all(r["step"] == sampling.gcd_free(r["step"], n) for r in own)


def test_short_products_are_walked_to_their_end(spark):
    """Equal phrases under many ids: the first block is short, the rest of the walk makes it up."""
    options = [(f"e{i:03d}", "same" if i else "other", "x") for i in range(60)]
    s = spark.createDataFrame([("s", "a", [(0, "op", options)])], "spec_id string, ast string, steps array<struct<p:int,op_id:string,options:array<struct<expression_id:string,final:string,connective:string>>>>")
    out = instructions.rule_instructions(s, 1, 2, ("k", "k {}"), ("n", "n {}"), ["none"], slack=1).collect()
    assert sorted(r["instruction"] for r in out) == ["n other", "n same"]


def test_cover_then_fill():
    pairs = [(a, b) for a in "abcde" for b in "abcde" if a < b]
    got = sampling.cover_then_fill(pairs, 4, 3)
    assert len(got) == 4 and {x for p in got for x in p} == set("abcde")


def test_hashes(spark):
    import hashlib

    r = spark.createDataFrame([("s", "t", None, "c", '["x"]')], "s string, t string, n string, c string, tests string").select(hashing.code_id("s", "t", "n", "c").alias("a"), hashing.record_id("c", "s", "n", "tests").alias("b"), hashing.seeded_rank(5, "s").alias("r")).first()
    h = lambda *p: hashlib.sha256("\0".join(p).encode()).hexdigest()
    assert r["a"] == "code-" + h("s", "t", "null", "c") and r["b"] == "record-" + h("c", "s", "null", '["x"]') and r["r"] == h("5", "s")


def test_targeted_and_witness(spark):
    q = spark.sql(f"SELECT 'a' AS spec_id, {ops_literal([Op('map', 'abs'), Op('filter', 'negative')])} AS ops UNION ALL SELECT 'b', {ops_literal([Op('filter', 'zero'), Op('filter', 'zero')])} UNION ALL SELECT 'c', {ops_literal([Op('map', 'abs')])}")
    none = spark.createDataFrame([], "xs array<bigint>, k int")
    got = {r["spec_id"]: r for r in cases.targeted(q, [0, 1], [1], none).collect()}
    assert set(got) == {"a", "b"} and got["a"]["filter_index"] == 1 and got["b"]["xs"] == [1]
    assert cases.random_cases(spark, "n", 1, 20).select(cases.case_key().alias("k")).distinct().count() == 20


def test_fingerprints(spark):
    q = spark.sql(f"SELECT 'a' AS spec_id, {ops_literal([Op('filter', 'even')])} AS ops UNION ALL SELECT 'b', {ops_literal([Op('filter', 'even'), Op('filter', 'even')])} UNION ALL SELECT 'c', {ops_literal([Op('filter', 'odd')])}")
    few = cases.random_cases(spark, "n", 2, 10)
    f = {r[0]: r[1] for r in cases.fingerprints(cases.execute(q, few)).collect()}
    assert f["a"] == f["b"] != f["c"]


def test_scores(spark):
    rows = spark.createDataFrame([("m", 1, 1, False), ("m", 1, 2, True), ("m", 2, 1, True), ("m", 3, 1, False), ("m", 3, 6, True)], "model string, q int, c int, passed boolean")
    got = {r["q"]: r for r in scoring.question_results(rows, ["model", "q"], "c").collect()}
    assert got[1]["rescued"] and got[2]["pass_1"] and not got[3]["pass_k"]
    kept, off = scoring.one_run_each(spark.createDataFrame([("w", "r1", 1, True), ("w", "r2", 1, False)], "w string, run string, q int, passed boolean"), ["w"], "q")
    assert kept.count() == 1 and off.count() == 1
    assert scoring.cross_check(spark.createDataFrame([(1, 0.5)], "k int, v double"), spark.createDataFrame([(1, 0.5 + 1e-9)], "k int, v double"), ["k"], "v").count() == 1
    b = scoring.case_binding(spark.createDataFrame([("r", "s"), ("r2", "t")], "record_id string, spec_id string"), spark.createDataFrame([("c", [1], 1)], "case_id string, xs array<int>, k int"), spark.createDataFrame([("s", "d", [2], 1)], "spec_id string, case_id string, xs array<int>, k int"))
    assert scoring.hidden_case_counts(b, "record_id", 2).first().asDict() == {"least": 1, "greatest": 2, "short": 1}
    assert spark.createDataFrame([("nano_15m_3epoch",)], "n string").select(scoring.model_class("n")["millions"].alias("m")).first()["m"] == 15


def test_percentiles_by_counts(spark):
    rng = random.Random(5)
    v = [rng.randint(1, 60) for _ in range(997)]
    got = stats.length_summary(spark.createDataFrame([(x,) for x in v], "n int"), "n").first()
    s = sorted(v)
    rank = lambda p: s[-(-len(s) * p // 100) - 1]
    assert (got["p50"], got["p95"], got["p99"], got["longest"]) == (rank(50), rank(95), rank(99), s[-1]) and abs(got["mean"] - sum(v) / len(v)) < 1e-9


def test_plans_and_sentences(spark):
    t = spark.createDataFrame([(1, "偶数だけを残す"), (2, "偶数だけを残さない"), (3, ""), (4, None)], "i int, t string")
    got = {r["i"]: r for r in text.parse_plans(t, "i", "t", text.phrase_table(spark).select("phrase", "id", "uses_k")).collect()}
    assert got[1]["ids"] == [1] and got[2]["error"].startswith("unknown step") and got[3]["error"] == got[4]["error"] == "no operation"
    s = spark.createDataFrame([([1, 11],), ([24],)], "ids array<int>").withColumn("s", text.sentence("ids"))
    assert all(r["error"] is None and r["ids2"] == r["ids"] for r in s.select("ids", *[v.alias({"ids": "ids2"}.get(k, k)) for k, v in text.parse_sentence("s").items()]).collect())
    assert text.ambiguous_phrases(text.phrase_table(spark)).count() == 0
    code = "def solve(xs: list[int], k: int) -> list[int]:\n    return xs\n"
    r = spark.createDataFrame([(code, 7), (code, None)], "c string, k bigint").select(text.bind_k("c", "k").alias("b")).collect()
    assert "k: int = 7)" in r[0]["b"] and r[1]["b"] == code
    with pytest.raises(Exception, match="no safe integer"):
        spark.createDataFrame([("1.5",)], "k string").select(text.parse_k("k")).collect()
    with pytest.raises(KeyError):
        text.fill_template("$a $b", a=F.lit(1))


def test_sandbox():
    head = "def solve(xs: list[int], k: int) -> list[int]:\n"
    child = sandbox.Child(2.0)
    even = '{"filter":["even"]}'
    few = [([1, 2], 1), ([3, 4], 2)]
    try:
        reason = lambda c, p="strict", steps=0: sandbox.judge(head + c, even, few, child, sandbox.POLICIES[p], steps)[7]
        assert reason("    return [x for x in xs if x % 2 == 0]\n") == "pass"
        assert reason("    return xs\n") == "output_mismatch"
        assert reason("    xs.append(1)\n    return xs\n", "benchmark") == "input_mutation"
        assert reason("    return [x // 0 for x in xs]\n") == "runtime_error"
        assert reason("    return ().__class__\n") == "contract_attribute"
        assert reason("    return [i for i in range(1001) if i < 0]\n", "browser") == "runtime_error"
        assert reason("    for x in range(3):\n        continue\n    pass\n    return [int(+x / 1) for x in xs if x % 2 == 0]\n", "benchmark") == "pass"
        assert reason("    return [x for x in xs if x % 2 in [0]]\n", "browser") == "pass"
        slow = "    for a in range(1000):\n        for b in range(1000):\n            for c in range(1000):\n                k += 1\n    return xs\n"
        assert reason(slow, "benchmark") == "timeout_or_process_exit"
        assert reason(slow, "browser", 50_000) == "step_budget"
        assert reason("    return [x for x in xs if x % 2 == 0]\n") == "pass"  # after a kill
        said = child.ask(head + "    while_ = 0\n    for a in range(k * k * k * 10 ** 7):\n        while_ += 1\n    return xs\n", [[[], 0], [[1], 0], [[2], 9]])
        assert [x["got"] for x in said["out"]] == [[], [1]] and said["error"] == "timeout"  # answers before it count
        lasting = sandbox.Child(30.0, cpu=1)
        began = time.monotonic()
        assert lasting.ask(head + "    for a in range(10 ** 9):\n        k += 1\n    return xs\n", [[[], 1]])["error"] == "timeout" and time.monotonic() - began < 20
        lasting.close()
    finally:
        child.close()


def test_sources(spark, tmp_path):
    p = tmp_path / "rows.jsonl"
    p.write_text('{"a": 1, "b": "x"}\n\n{"a": 2, "b": null}\n')
    assert files.json_lines(spark, str(p), "a int, b string").count() == 2
    (tmp_path / "bad.jsonl").write_text("{oops\n")
    with pytest.raises(Exception):
        files.json_lines(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    z = files.repeatable_zip(spark.createDataFrame([(2,), (1,)], "a int"), F.to_json(F.struct("a")), ["a"], "m.jsonl")
    assert z == files.repeatable_zip(spark.createDataFrame([(1,), (2,)], "a int"), F.to_json(F.struct("a")), ["a"], "m.jsonl")
    (tmp_path / "m.zip").write_bytes(z)
    assert [r["a"] for r in files.zip_member(spark, str(tmp_path / "m.zip"), "m.jsonl", "a int").orderBy("a").collect()] == [1, 2]
    with pytest.raises(Exception, match="no member"):
        files.zip_member(spark, str(tmp_path / "m.zip"), "other", "a int").collect()
    (tmp_path / "r.csv").write_bytes("﻿note\nid,text,edited\n1,a\n,,\n2,b,c\n".encode())
    assert [(r["id"], r["edited"]) for r in files.review_table(spark, str(tmp_path / "r.csv"), ["id", "text", "edited"]).orderBy("line").collect()] == [("1", ""), ("2", "c")]
    with pytest.raises(FileExistsError):
        files.guard(spark, [], [str(tmp_path / "r.csv")])
    with pytest.raises(ValueError):
        files.config('{"a": true}', {"a": int})
    h = files.file_hashes(spark, str(tmp_path / "r.csv"))
    assert files.changed(h, h).count() == 0
    assert zipfile.ZipFile(tmp_path / "m.zip").namelist() == ["m.jsonl"]
    files.write_json_lines(spark.createDataFrame([(2, "b"), (1, None)], "a int, b string"), str(tmp_path / "out"), ["a"], single=True)
    got = [json.loads(x) for q in sorted((tmp_path / "out").glob("part-*")) for x in q.read_text().splitlines()]
    assert got == [{"a": 1, "b": None}, {"a": 2, "b": "b"}]


def test_stream_appends_once(spark, tmp_path):
    src, sink = tmp_path / "in", str(tmp_path / "sink")
    spark.createDataFrame([(1,), (2,), (2,)], "id int").write.parquet(str(src))
    stream = lambda c: resume.append_once(spark.readStream.schema("id int").parquet(str(src)), lambda d: d.withColumn("x", F.col("id") * 2), "id", sink, str(tmp_path / c)).awaitTermination()
    stream("c1")
    spark.createDataFrame([(2,), (3,)], "id int").write.mode("append").parquet(str(src))
    stream("c1")
    stream("c2")  # all of it again
    assert sorted(r["id"] for r in spark.read.parquet(sink).collect()) == [1, 2, 3]


def test_dictionary(spark):
    with pytest.raises(ValueError, match="zone"):
        dictionary.approve(spark.createDataFrame([], "id int, text string, source_text string, status string, origin string, split string"), "r", "2026-01-01T00:00:00")
    r = spark.createDataFrame([(" ", "g "), ("e", "g")], "edited string, generated string").select(dictionary.effective("edited", "generated").alias("t")).collect()
    assert [x["t"] for x in r] == ["g", "e"]


def test_byte_pairs(spark):
    t = spark.createDataFrame([("aaab",), ("aab",), ("é",)], "t string")
    merges = tokenizing.train_pairs(t, "t", 3)
    assert merges[0] == ("a", "a")
    vocabulary = {c: i for i, c in enumerate([*tokenizing._visible().values(), *[a + b for a, b in merges]])}
    b = tokenizing.BytePairs(vocabulary, merges)
    for s in ("aaab", "é", "", "xyz aa"):
        assert b.decode(b.encode(s)) == s
    e = tokenizing.encoded(t, "t", b)
    assert tokenizing.audit(e, "ids", 2, []).first()["rows"] == 3 and tokenizing.usage(e, "ids", 2).count() == 2
    with pytest.raises(Exception, match="special token"):
        tokenizing.corpus_texts(t, ["t"], ["aab"]).collect()


def test_reports(spark):
    d = spark.createDataFrame([(1, "a|b", 1234567)], "i int, t string, n int")
    assert reports.markdown(d, ["t", "n"], ["i"]).splitlines()[2] == "| a\\|b | 1,234,567 |"
    assert dedup.collisions(spark.createDataFrame([("h", "a"), ("h", "b"), ("g", "c")], "h string, t string"), "t", "h").count() == 1


def test_case_sets(spark):
    fixed = cases.fixed_cases(3)
    assert len(fixed) == 177 and all(len(xs) <= 20 and 1 <= k <= 10 and all(abs(x) <= 100 for x in xs) for xs, k in fixed)
    a = spark.createDataFrame([("c1", [1], 1)], "case_id string, xs array<bigint>, k int")
    b = spark.createDataFrame([("w1", [1], 1), ("w2", [2], 1), ("w3", [2], 1)], "case_id string, xs array<bigint>, k int")
    assert cases.with_witnesses(a, b).count() == 2
    sets = cases.input_sets(spark, {"a": 1, "b": 1}, 12, set())
    assert sets.count() == 24 and cases.set_overlaps(sets).count() == 0
    ops = ops_literal([Op("map", "abs"), Op("order", "ascending")])
    back = ops_literal([Op("order", "ascending"), Op("map", "abs")])
    both = spark.createDataFrame([("c1", [1, 2], 1), ("c2", [-3, 1], 1)], "case_id string, xs array<bigint>, k int").selectExpr("*", f"{ops} AS p", f"{back} AS q")
    assert cases.order_witness(both, "p", "q").first()["case_id"] == "c2"


def test_metrics(spark):
    from sparkloom.operators import metrics

    assert metrics.ticks(100) == [0, 20, 40, 60, 80, 100] and metrics.ticks(7) == list(range(8)) and len(metrics.ticks(123_456)) <= 9
    bad = spark.createDataFrame([(1, None, None, None)], "step int, loss double, validation_loss double, event string")
    with pytest.raises(Exception, match="neither"):
        metrics.split_stream(bad)[0].collect()
    assert tokenizing.vocabulary_problem({"<s>": 0, "a": 1}, ["<s>"], 2) is None
    assert tokenizing.vocabulary_problem({"<s>": 1, "a": 0}, ["<s>"], 2) == "special tokens elsewhere"
    f = {r["problem"]: r["n"] for r in scoring.freeze_problems(spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "q int, c string"), "q", "c", 3, 2).collect()}
    assert f == {"repeated keys": 1, "off total": 0, "categories off": 1}


def test_as_of_by_bucket_is_as_of(spark):
    rng = random.Random(4)
    left = spark.createDataFrame([(rng.randint(0, 500), i, 1) for i in range(80)], "t int, id int, g int")
    right = spark.createDataFrame([(rng.randint(50, 500), rng.random(), 1) for i in range(20)], "t int, v double, g int")
    a = joins.as_of(left, right, ["g"], "t", "v").select("id", "v")
    b = joins.as_of_bucketed(left, right.select("t", "v"), "t", "v", F.floor(F.col("t") / 60)).select("id", "v")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()), key=lambda x: x) if all(r["v"] is not None for r in a.collect()) else {tuple(r) for r in a.collect()} == {tuple(r) for r in b.collect()}


def test_intervals(spark):
    rng = random.Random(2)
    make = lambda n: [(i, lo := rng.randint(0, 300), lo + rng.randint(0, 90)) for i in range(n)]
    p, q = make(40), make(30)
    a, b = spark.createDataFrame(p, "a int, lo int, hi int"), spark.createDataFrame(q, "b int, lo2 int, hi2 int")
    got = sorted((r["a"], r["b"]) for r in joins.interval_join(a, b, [], "lo", "hi", "lo2", "hi2", 16).collect())
    assert got == sorted((i, j) for i, x, y in p for j, u, v in q if x < v and u < y and y > x and v > u)
