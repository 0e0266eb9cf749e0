"""Quality rules as a short-circuit cascade, on built-in functions only.

Each rule rejects a document. ``plan`` measures every rule's cost and selectivity on a bounded sample and orders the
rules by rejections per second; ``verdict`` chains them in that order as one CASE, which stops at the first rule that
rejects. The order changes what is computed, never the verdict. Nothing is shuffled. The sample is drawn evenly from the whole table.

Null or empty text: no words, so it fails the base rule of 20 words; an empty table stays empty. Repeated rows are judged alike, each by
itself, whatever their id. Rules that tie in the plan are taken by name.
Texts of any length are read whole; the work is linear, or n log n in the repeated windows of one document.
"""

from __future__ import annotations

import re
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import SPACE, Tables, let, words_sql

REPEAT_WINDOW = 8
MIN_WORDS = 20
#: Rows or so, drawn from the whole table, on which costs and selectivities are measured.
SAMPLE_ROWS = 1000


def _repeat_words() -> str:
    """Words inside windows of 8 words that the text holds twice or more: sort (hash, position), keep equal neighbours."""
    n = REPEAT_WINDOW
    gram = "xxhash64(x, " + ", ".join(f"get(g, i + {j})" for j in range(1, n)) + ")"
    windows = f"transform(slice(g, 1, greatest(0, size(g) - {n - 1})), (x, i) -> {gram})"
    equal = "filter(s, (e, i) -> coalesce(e.h = get(s, i - 1).h, false) OR coalesce(e.h = get(s, i + 1).h, false))"
    covered = f"aggregate(transform(p, (x, i) -> least({n}, coalesce(get(p, i + 1) - x, {n}))), 0, (a, x) -> a + x)"
    found = let("s", "array_sort(transform(v, (x, i) -> named_struct('h', x, 'p', i)))", let("p", f"array_sort(transform({equal}, e -> e.p))", covered))
    return let("g", "transform(words, x -> xxhash64(x))", let("v", windows, f"IF(size(array_distinct(v)) = size(v), 0, {found})"))


#: SQL of the measures that rules read, over text, words and lines.
MEASURES = {
    "n_words": "cast(size(words) as bigint)",
    "word_chars": "cast(length(text) - regexp_count(text, '[\\\\x20\\\\x09-\\\\x0D]') as bigint)",
    "n_symbols": "cast(regexp_count(text, '[#*$%&|<>]') as bigint)",
    "n_dup_lines": "cast(size(lines) - size(array_distinct(lines)) as bigint)",
    "n_lines": "cast(size(lines) as bigint)",
    "n_repeat_words": f"cast({_repeat_words()} as bigint)",
}


def _parts(docs: DataFrame) -> DataFrame:
    """The row's columns as ``row``, its text, words and lines.

    ``here`` isn't deterministic, so no filter above is computed below it once more.
    """
    lines = "filter(split(coalesce(text, ''), '\\n'), l -> l RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')"
    base = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    return base.select("row", "text", F.expr(words_sql("text", SPACE)).alias("words"), F.expr(lines).alias("lines"), F.monotonically_increasing_id().alias("here"))


def features(docs: DataFrame) -> DataFrame:
    """``row``, text, words and every measure of each row; ``docs`` needs a column text."""
    return _parts(docs).select("row", "text", "words", "here", *[F.expr(e).alias(m) for m, e in MEASURES.items()])


@dataclass(frozen=True)
class Rule:
    name: str
    #: SQL over text, words and MEASURES.
    rejects: str


BASE_RULES = (
    Rule("few_words", f"n_words < {MIN_WORDS}"),
    Rule("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
)
#: Bounds that ordinary prose of the labelled rows keeps with room to spare.
RULES = (
    Rule("symbols", "100 * n_symbols > 10 * n_words"),
    Rule("duplicate_lines", "100 * n_dup_lines > 40 * n_lines"),
    Rule("word_length", "word_chars < 2 * n_words OR word_chars > 14 * n_words"),
    Rule("capitals", "2 * regexp_count(text, '\\\\p{Lu}') > regexp_count(text, '\\\\p{L}')"),
    Rule("exclamations", "2 * regexp_count(text, '!') > n_words"),
    # In a lambda only lambda variables: a column could be replaced by what it is computed from, once an element.
    Rule("stutter", "4 * " + let("ws", "words", "size(filter(ws, (w, i) -> coalesce(w = get(ws, i - 1), false)))") + " > n_words"),
)


def plan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second on about ``sample_rows`` rows, best first; ties by name.

    Each row of the table, of any length, is as likely in the sample as any other: one scan draws it, on the executors, and
    writes it once.
    """
    tables = Tables(docs.sparkSession, "quality")
    written = tables.write(docs.select("text").sample(min(1.0, sample_rows / max(1, docs.count())), seed=11))
    sample = features(written).drop("row")
    scored = []
    for rule in rules:
        best = None
        for _ in range(2):  # the first run also compiles
            began = time.perf_counter()
            rejected = sample.agg(F.count_if(F.expr(rule.rejects))).first()[0]
            best = min(best or 1e9, time.perf_counter() - began)
        scored.append((-(rejected + 1) / best, rule.name, rule))
    tables.drop(written)
    return [r for _, _, r in sorted(scored, key=lambda x: x[:2])]


def rejected_by(rules: list[Rule] | tuple[Rule, ...]) -> Column:
    """The name of the first rule that rejects, in the order given; null where none does."""
    out = F.when(F.expr(rules[0].rejects), rules[0].name)
    for rule in rules[1:]:
        out = out.when(F.expr(rule.rejects), rule.name)
    return out


def score(docs: DataFrame, order: list[Rule] | None = None) -> DataFrame:
    """doc_id, the measures, base_failed, kept and the rejecting rule of each row of ``docs`` (doc_id, text)."""
    order = plan(docs) if order is None else order
    out = features(docs.select("doc_id", "text"))
    out = out.withColumn("base_failed", F.expr(" OR ".join(f"({r.rejects})" for r in BASE_RULES)))
    out = out.withColumn("rejected_by", F.when(F.col("base_failed"), "base").otherwise(rejected_by(order)))
    return out.select(
        F.col("row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by"
    )


def keep(docs: DataFrame, order: list[Rule] | None = None) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns.

    A measure is computed inside the rule that reads it, so a document pays for the rules up to the one that rejects it only.
    """
    order = plan(docs, BASE_RULES + RULES) if order is None else [*BASE_RULES, *order]
    verdict = " ".join(f"WHEN {_inlined(r.rejects)} THEN false" for r in order)
    return _parts(docs).where(f"here >= 0 AND CASE {verdict} ELSE true END").select("row.*")


def _inlined(predicate: str) -> str:
    return re.sub(r"\b(" + "|".join(MEASURES) + r")\b", lambda m: MEASURES[m[0]], predicate)


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT r, i, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM rep) GROUP BY r),
f AS (SELECT w.doc_id, w.text, w.w, len(w.w) AS n_words, length(w.text) - len(regexp_extract_all(w.text, '[\x20\x09-\x0D]')) AS word_chars,
        len(regexp_extract_all(w.text, '[#*$%&|<>]')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(cov.n, 0) AS n_repeat_words FROM w LEFT JOIN cov USING (r)),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        100 * n_symbols > 10 * n_words AS x1, 100 * n_dup_lines > 40 * n_lines AS x2, word_chars < 2 * n_words OR word_chars > 14 * n_words AS x3,
        2 * len(regexp_extract_all(text, '\p{Lu}')) > len(regexp_extract_all(text, '\p{L}')) AS x4,
        2 * len(regexp_extract_all(text, '!')) > n_words AS x5,
        4 * len(list_filter(range(2, n_words + 1), lambda i: w[i] = w[i - 1])) > n_words AS x6 FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT (base_failed OR x1 OR x2 OR x3 OR x4 OR x5 OR x6) AS kept FROM j
"""
