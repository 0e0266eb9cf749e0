"""Whole builds, sinks for review and policies, against plain versions."""

from __future__ import annotations

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import build, cases, reports, scoring, tokenizing
from sparkloom.plans import algebra
from sparkloom.sources import files

#: Of the keys of sixty-four cases in the order of their making.
DIGEST = "f934b7a3ec181cba6a21c72e4bc49276e18cbec05b13cd9d546cae16dd4734e3"


@pytest.mark.parametrize("quota", [1, 3])
def test_take_in_order(spark, quota):
    """Specs one after another, each by rank; a code beyond a quota stays free for others."""
    rng = random.Random(quota)
    rows = [(s, r, f"c{rng.randrange(40)}") for s in range(12) for r in range(8)] + [(3, 2, "c1"), (3, 2, "c1")]
    used, want = set(), []
    for s in range(12):
        n = 0
        for _, r, c in sorted(x for x in set(rows) if x[0] == s):
            if n < quota and c not in used:
                used.add(c)
                want.append((s, r, c))
                n += 1
    got = build.take_in_order(spark.createDataFrame(rows, "s int, r int, c string"), "s", "r", "c", quota)
    assert sorted(map(tuple, got.select("s", "r", "c").collect())) == sorted(want)


def test_train_build_rejects(spark):
    i = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 20)], "spec_id int, instruction_id int")
    c = spark.createDataFrame([(1, 100, "a"), (1, 101, "a"), (1, 102, "b"), (2, 200, "a"), (2, 201, "a"), (3, 300, "a")], "spec_id int, code_id int, style string")
    records, rejects = build.train_build(i, c, spark.createDataFrame([(100, "long match")], "code_id int, reason string"), 1)
    assert {(r["spec_id"], r["instruction_id"]) for r in records.collect()} == {(1, 10), (1, 11), (2, 20)}
    assert {r["style"] for r in records.where("spec_id = 1").collect()} == {"a", "b"}
    got = sorted((r["spec_id"], r["reason"]) for r in rejects.collect())
    assert got == [(1, "long match"), (1, "no code"), (2, "not needed"), (3, "not needed")]
    assert all(r["n"] == 0 for r in build.build_problems(records, i).collect())
    twice = records.union(records)
    assert {r["problem"]: r["n"] for r in build.build_problems(twice, i.where("spec_id = 1")).collect()} == {"repeated code_id": 3, "repeated instruction_id": 3, "foreign spec": 2}


def test_training_set(spark):
    ids = {"good": [1, 7, 3, 8, 2], "long": [1] + [7] * 9 + [3, 8, 2], "no start": [7, 3, 8, 2], "two ends": [1, 3, 2, 2], "no target mark": [1, 8, 2], "nothing after it": [1, 7, 3, 2], "two starts": [1, 1, 3, 8, 2]}
    got = {r["n"]: r for r in build.training_set(spark.createDataFrame(list(ids.items()), "n string, ids array<int>"), "ids", 1, 2, 3, 10).collect()}
    assert got["good"]["problem"] is None and got["good"]["target_start"] == 3 and got["good"]["length"] == 5
    assert {n: r["problem"] for n, r in got.items() if n != "good"} == {
        "long": "longer than the context", "no start": "start not once and first", "two ends": "end not once and last", "no target mark": "target not once", "nothing after it": "no target", "two starts": "start not once and first",
    }


def test_merge_runs(spark):
    rows = [("r1", "m1", 0.8, q, q < 3) for q in range(5)] + [("r2", "m2", 0.8, q, q < 4) for q in range(5)] + [("r3", "m2", 0.8, 0, True)] + [("r4", "m3", 0.7, q, True) for q in range(4)] + [("r5", "m4", 0.1, 0, True)]
    merged, problems = build.merge_runs(spark.createDataFrame(rows, "run string, model string, temperature double, question int, passed boolean"), spark.createDataFrame([("m4",)], "model string"), ["temperature"], 5)
    assert {r["model"]: (r["questions"], r["passed"]) for r in merged.collect()} == {"m1": (5, 3), "m2": (5, 5), "m3": (4, 4)}
    assert sorted(map(tuple, problems.collect()), key=repr) == sorted([("m2", "several runs"), ("m3", "question count"), (None, "temperature differs")], key=repr)


def test_copy_scores(spark):
    """A head that looks at its token's earlier place copies; one that looks behind it induces."""
    tokens = [5, 6, 7, 5, 6]
    rows = [("copy", q, k, float(k == q - 3)) for q in range(5) for k in range(q + 1)] + [("induce", q, k, float(k == q - 2)) for q in range(5) for k in range(q + 1)]
    df = spark.createDataFrame(rows, "head string, q int, k int, weight double").withColumn("tokens", F.array(*[F.lit(t) for t in tokens]))
    got = {r["head"]: (r["copying"], r["induction"]) for r in build.copy_scores(df.withColumn("t2", F.col("tokens")).select("head", "q", "k", "weight", "tokens"), ["head"]).collect()}
    assert got["copy"] == (0.4, 0.0) and got["induce"] == (0.0, 0.4)


def test_random_cases_are_fixed_by_their_seed(spark):
    """Sixty-four keys of one seed, by a digest of them."""
    rows = cases.random_cases(spark, "normal", 2026092602, 64).select(cases.case_key().alias("key")).collect()
    assert rows[1]["key"] == '{"k":7,"xs":[7,6,8,21,12,-31,15,100,93,-15]}'
    assert sha256("\n".join(r["key"] for r in rows).encode()).hexdigest() == DIGEST
    rng = random.Random(1)
    assert cases.leading("-k k k+1", 4, rng) == [-4, 4, 5] and cases.leading("0 -R", 4, rng)[1] < 0 and len(set(cases.leading("S S", 4, rng))) == 1


def test_failure_stages(spark):
    said = {"pass": None, "contract_node": "static", "syntax_error": "static", "runtime_error": "runtime", "input_mutation": "runtime", "output_mismatch": "semantic", "timeout_or_process_exit": "timeout", "step_budget": "timeout"}
    got = spark.createDataFrame([(r,) for r in said], "reason string").select("reason", scoring.failure_stage().alias("stage")).collect()
    assert {r["reason"]: r["stage"] for r in got} == said


def test_review_sink_and_keyed_lines(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b, c", None), (1, "a", 3)], "id int, text string, n int")
    files.write_review(rows, str(tmp_path / "review.csv"), ["id", "text", "n"], ["approved", "note"], ["id"])
    assert (tmp_path / "review.csv").read_text(encoding="utf-8") == '\ufeffid,text,n,approved,note\n1,a,3,,\n2,"b, c",,,\n'
    assert files.review_table(spark, str(tmp_path / "review.csv"), ["id", "approved"]).count() == 2
    (tmp_path / "a.jsonl").write_text('{"id": 1}\n{"id": 2}\n')
    assert sorted(r["id"] for r in files.keyed_json_lines(spark, str(tmp_path / "a.jsonl"), "id int", "id").collect()) == [1, 2]
    for text, why in (('{"id": 1}\n{"id": 1}\n', "repeated"), ('{"id": null}\n', "no key")):
        (tmp_path / "b.jsonl").write_text(text)
        with pytest.raises(Exception, match=why):
            files.keyed_json_lines(spark, str(tmp_path / "b.jsonl"), "id int", "id").collect()
    report = reports.code_report(spark.createDataFrame([("x", "def f(): pass\n", "[1]", "[2]")], "n string, c string, e string, o string"), "n", "c", "e", "o").first()
    assert report["section"] == "## x\n\n```python\ndef f(): pass\n```\n\nInput: `[1]`  \nOutput: `[2]`\n"


def test_byte_pairs_by_heap_and_audit(spark):
    """Against a pass over the whole text for each merge; least counts, longest pieces and the audit."""
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcde é", k=rng.randint(0, 60))) for _ in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    merges = tokenizing.train_pairs(df, "t", 20, cut=7)
    assert len(merges) == 20 == len(set(merges))
    b = tokenizing.BytePairs({c: i for i, c in enumerate([*tokenizing._visible().values(), *[x + y for x, y in merges]])}, merges)

    def plain(text):
        parts = [b.to_char[x] for x in text.encode()]
        for pair in merges:
            out = []
            for p in parts:
                if out and (out[-1], p) == pair:
                    out[-1] += p
                else:
                    out.append(p)
            parts = out
        return [b.vocabulary[p] for p in parts]

    assert all(b.encode(t) == plain(t) and b.decode(b.encode(t)) == t for t in [*texts, "a" * 50, ""])
    short = tokenizing.train_pairs(df, "t", 20, least=20, longest=2)
    assert short and all(len(x + y) <= 2 for x, y in short) and len(short) < 20
    total = tokenizing.check_totals(tokenizing.checked(df, "t", b), len(b.vocabulary)).first()
    ids = [i for t in texts for i in plain(t)]
    assert total["rows"] == 40 and total["broken"] == 0 and abs(total["byte_share"] - sum(i < 256 for i in ids) / len(ids)) < 1e-9 and abs(total["used_share"] - len(set(ids)) / len(b.vocabulary)) < 1e-9


def test_inputs_from_text(spark):
    said = {'{"k":2,"xs":[1,-3]}': None, '{"xs":[],"k":1}': None, '{"k":11,"xs":[]}': "out of domain", '{"k":1,"xs":[101]}': "out of domain", '{"k":1}': "not an input", '{"k":1,"xs":["a"]}': "not an input", "oops": "not an input", '{"k":1,"xs":[1],"y":2}': "not an input", "[1]": "not an input"}
    got = {r["t"]: r for r in algebra.read_inputs(spark.createDataFrame([(t,) for t in said], "t string"), "t").collect()}
    assert {t: r["problem"] for t, r in got.items()} == said and got['{"k":2,"xs":[1,-3]}']["xs"] == [1, -3]


def test_large_files_are_hashed_as_streams(spark, tmp_path, monkeypatch):
    (tmp_path / "a").write_bytes(b"x" * 100)
    (tmp_path / "b").write_bytes(b"y" * 3000)
    whole = sorted(map(tuple, files.file_hashes(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(files, "ONE_VALUE", 1000)
    assert sorted(map(tuple, files.file_hashes(spark, str(tmp_path)).collect())) == whole
    assert [r[2] for r in whole] == [sha256(b"x" * 100).hexdigest(), sha256(b"y" * 3000).hexdigest()]
