"""Text front end: controlled language, tolerant plans, fences, JSON repair, templates and predicates, as columns.

Phrases of operations are a dimension table (form, phrase, id); texts are cut and looked up with joins or, for the closed set of
canonical phrases, with a literal map. Only Unicode normalisation needs Python, as an Arrow function.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.plans.algebra import ATOMIC, MAX_STEPS, canonical_json

# The sentence's frame.
WITH_K, WITHOUT_K, TAIL, COMMA = "整数リストxsと整数kを受け取り、", "整数リストxsから", "solve関数を書いてください。", "、"
# Final and connective phrase of the operations, in the order of ATOMIC.
PHRASES = [
    ("偶数だけを残す", "偶数だけを残し"), ("奇数だけを残す", "奇数だけを残し"), ("kより大きい値だけを残す", "kより大きい値だけを残し"),
    ("k以上の値だけを残す", "k以上の値だけを残し"), ("kより小さい値だけを残す", "kより小さい値だけを残し"), ("k以下の値だけを残す", "k以下の値だけを残し"),
    ("kの倍数だけを残す", "kの倍数だけを残し"), ("正の値だけを残す", "正の値だけを残し"), ("負の値だけを残す", "負の値だけを残し"),
    ("ゼロだけを残す", "ゼロだけを残し"), ("各要素にkを加える", "各要素にkを加え"), ("各要素からkを引く", "各要素からkを引き"),
    ("各要素にkを掛ける", "各要素にkを掛け"), ("各要素を2倍する", "各要素を2倍し"), ("各要素を3倍する", "各要素を3倍し"),
    ("各要素の符号を反転する", "各要素の符号を反転し"), ("各要素の絶対値を取る", "各要素の絶対値を取り"), ("各要素を二乗する", "各要素を二乗し"),
    ("値を昇順に並べる", "値を昇順に並べ"), ("値を降順に並べる", "値を降順に並べ"), ("現在の要素順を反転する", "現在の要素順を反転し"),
    ("先頭からk個を取る", "先頭からk個を取り"), ("末尾からk個を取る", "末尾からk個を取り"), ("先頭から1個おきに取る", "先頭から1個おきに取り"),
]


def phrase_table(spark: SparkSession) -> DataFrame:
    """(id, form, phrase, uses_k, op): the canonical phrases."""
    rows = []
    for i, (op, pair) in enumerate(zip(ATOMIC, PHRASES, strict=True), 1):
        rows += [(i, form, phrase, op.uses_k, canonical_json(op.ast())) for form, phrase in zip(("final", "connective"), pair, strict=True)]
    return spark.createDataFrame(rows, "id int, form string, phrase string, uses_k boolean, op string")


def ambiguous_phrases(phrases: DataFrame) -> DataFrame:
    """Phrases that stand for several operations; empty if the table is a function."""
    return phrases.groupBy("phrase").agg(F.countDistinct("id").alias("n")).where("n > 1")


def _lookup(form: str, field: str) -> str:
    at = 0 if form == "final" else 1
    pairs = []
    for i, (op, pair) in enumerate(zip(ATOMIC, PHRASES, strict=True), 1):
        value = {"id": str(i), "k": str(op.uses_k).lower(), "op": f"'{canonical_json(op.ast())}'"}[field]
        pairs.append(f"WHEN '{pair[at]}' THEN {value}")
    return " ".join(pairs)


def sentence(ids: str) -> Column:
    """The controlled sentence of an array of operation ids."""
    final = " ".join(f"WHEN {i} THEN '{p[0]}'" for i, p in enumerate(PHRASES, 1))
    conn = " ".join(f"WHEN {i} THEN '{p[1]}'" for i, p in enumerate(PHRASES, 1))
    k = ", ".join(str(i) for i, o in enumerate(ATOMIC, 1) if o.uses_k)
    body = f"array_join(transform({ids}, (d, i) -> IF(i = size({ids}) - 1, CASE d {final} END, CASE d {conn} END)), '{COMMA}')"
    return F.expr(f"concat(IF(exists({ids}, d -> d IN ({k})), '{WITH_K}', '{WITHOUT_K}'), {body}, '{TAIL}')")


def parse_sentence(text: str) -> dict[str, Column]:
    """ids, uses_k and error of a controlled sentence (error null if valid): frame, 1 to 4 phrases, forms, agreement in k."""
    t = f"trim({text})"
    k = f"(startswith({t}, '{WITH_K}') AND endswith({t}, '{TAIL}'))"
    no_k = f"(NOT {k} AND startswith({t}, '{WITHOUT_K}') AND endswith({t}, '{TAIL}'))"
    start = f"IF({k}, {len(WITH_K)}, {len(WITHOUT_K)})"
    parts = f"split(substring({t}, {start} + 1, length({t}) - {start} - {len(TAIL)}), '{COMMA}')"
    ids = f"transform(array({parts}), ps -> transform(ps, (p, i) -> IF(i = size(ps) - 1, CASE p {_lookup('final', 'id')} END, CASE p {_lookup('connective', 'id')} END)))[0]"
    k_ids = ", ".join(str(i) for i, o in enumerate(ATOMIC, 1) if o.uses_k)
    error = (
        f"CASE WHEN {text} IS NULL OR {t} = '' THEN 'empty' WHEN {t} RLIKE '[\\n\\r]' THEN 'several lines' WHEN NOT ({k} OR {no_k}) THEN 'frame' "
        f"WHEN size({parts}) > {MAX_STEPS} OR array_contains({parts}, '') THEN 'number of operations' WHEN exists({ids}, d -> d IS NULL) THEN 'unknown phrase' "
        f"WHEN exists({ids}, d -> d IN ({k_ids})) <> {k} THEN 'use of k' END"
    )
    return {"ids": F.expr(f"CASE WHEN {error} IS NULL THEN {ids} END"), "uses_k": F.expr(k), "error": F.expr(error)}


def ids_to_ast(ids: str) -> Column:
    one = " ".join(f"WHEN {i} THEN '{canonical_json(o.ast())}'" for i, o in enumerate(ATOMIC, 1))
    ops = f"transform({ids}, d -> CASE d {one} END)"
    return F.expr(f"IF(size({ids}) = 1, {ops}[0], concat('{{\"sequence\":[', array_join({ops}, ','), ']}}'))")


def same_plan(a: str, ka: str, b: str, kb: str) -> Column:
    """Why two plans differ: length, the first step, k; null if they don't."""
    return F.expr(f"CASE WHEN size({a}) <> size({b}) THEN 'number of steps' WHEN NOT ({a} <=> {b}) THEN concat('step ', array_position(zip_with({a}, {b}, (x, y) -> x <=> y), false)) WHEN NOT ({ka} <=> {kb}) THEN 'k' END")


def nfkc(rows: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the NFKC form of a text: an Arrow function, ASCII texts pass unchanged."""

    @F.arrow_udf("string")
    def norm(v: pa.Array) -> pa.Array:
        return pa.array([x if x is None or x.isascii() else unicodedata.normalize("NFKC", x) for x in v.to_pylist()], pa.string())

    return rows.withColumn(out, norm(text))


def parse_plans(rows: DataFrame, key: str, text: str, phrases: DataFrame) -> DataFrame:
    """(key, ids, k, error) of tolerantly written plans.

    phrases: (phrase, id, uses_k), aliases included. A line may be fenced, bulleted, numbered, bold; ``k = 3`` gives k; one number in a
    phrase that needs k stands for it. Steps that aren't known are errors, never dropped; numbers that disagree are one too.
    """
    norm = nfkc(rows.select(key, text), text, "_t")
    lines = norm.select(key, F.posexplode(F.split(F.regexp_replace(F.coalesce("_t", F.lit("")), r"\*\*([^*]+)\*\*|`([^`]+)`", "$1$2"), r"\r?\n")).alias("_l", "_x"))
    x = F.regexp_replace(F.trim("_x"), r"^(?:[-*•・]\s*|(?:\(\d+\)|\d+[.)、:])\s*)", "")
    x = F.regexp_replace(x, r"^(?:出力|手順|操作一覧)[:：]\s*", "")
    lines = lines.withColumn("_x", x).where(~F.col("_x").rlike(r"^```[a-z]*$|^$|^(?:操作|処理手順|以下の操作|以下の手順)[:：]?$"))
    is_k = F.col("_x").rlike(r"(?i)^k\s*(?:[=:]|は|の値)")
    given = lines.where(is_k).select(key, F.regexp_extract("_x", r"(?i)^k\s*[=:]\s*([+-]?\d+)[。.]?$", 1).try_cast("bigint").alias("_g"))
    given = given.groupBy(key).agg(F.min("_g").alias("_glo"), F.max("_g").alias("_ghi"))
    steps = lines.where(~is_k).select(key, "_l", F.posexplode(F.split("_x", r"、|。|\s*(?:→|->|;)\s*")).alias("_p", "_s"))
    s = F.regexp_replace(F.trim("_s"), r"^(?:その後|次に|最後に)\s*", "")
    s = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"[.]$", ""), "ください$", ""), "元素", "要素")
    steps = steps.withColumn("_s", F.trim(s)).where("_s <> ''").withColumn("_number", F.when(F.regexp_count("_s", F.lit(r"[+-]?\d+")) == 1, F.regexp_extract("_s", r"([+-]?\d+)", 1).try_cast("bigint")))
    steps = steps.withColumn("_k", F.regexp_replace("_s", r"[+-]?\d+", "k"))
    p = F.broadcast(phrases.select("phrase", "id", "uses_k").distinct())
    a = steps.join(p.select(F.col("phrase").alias("_s"), F.col("id").alias("_i1"), F.col("uses_k").alias("_u1")), "_s", "left")
    a = a.join(p.where("uses_k").select(F.col("phrase").alias("_k"), F.col("id").alias("_i2")), "_k", "left")
    by_number = F.col("_i1").isNull() & F.col("_i2").isNotNull() & F.col("_number").isNotNull()
    a = a.withColumn("_id", F.coalesce("_i1", F.when(by_number, F.col("_i2")))).withColumn("_n", F.when(by_number, F.col("_number"))).withColumn("_u", F.coalesce("_u1", by_number))
    # A plan's steps: a few lines of one text.
    got = a.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_l", "_p", "_id", "_s"))).alias("_st"), F.min("_n").alias("_nlo"), F.max("_n").alias("_nhi"), F.bool_or("_u").alias("_uses"))
    out = rows.select(key).join(got, key, "left").join(given, key, "left")
    error = F.expr("CASE WHEN _st IS NULL THEN 'no operation' WHEN exists(_st, x -> x._id IS NULL) THEN concat('unknown step: ', filter(_st, x -> x._id IS NULL)[0]._s) WHEN _nlo <> _nhi THEN 'different numbers' WHEN size(_st) > 4 THEN 'number of operations' END")
    k = F.expr("CASE WHEN _uses THEN coalesce(_nlo, IF(_glo = _ghi, _glo, NULL)) END")
    return out.withColumn("error", error).select(key, F.expr("CASE WHEN error IS NULL THEN transform(_st, x -> x._id) END").alias("ids"), F.when(F.col("error").isNull(), k).alias("k"), "error")


def parse_k(text: str) -> Column:
    """A whole number that a double holds exactly; blank is null, anything else raises."""
    c = F.trim(F.col(text).cast("string"))
    n = c.try_cast("bigint")
    return F.when(c.isNull() | (c == ""), None).when(c.rlike(r"^[+-]?\d+$") & n.between(-(2**53 - 1), 2**53 - 1), n).otherwise(F.raise_error(F.lit("k is no safe integer")).cast("bigint"))


def bind_k(code: str, k: str) -> Column:
    """The code with k as the default of its parameter, only in the signature; null k leaves it, a missing signature raises."""
    found = F.col(code).rlike(r"(?m)^def solve\(xs: list\[int\], k: int\) -> list\[int\]:\r?$")
    bound = F.regexp_replace(F.col(code), F.lit(r"(?m)^(def solve\(xs: list\[int\], k: int)(\) -> list\[int\]:\r?)$"), F.concat(F.lit("$1 = "), F.col(k).cast("string"), F.lit("$2")))
    return F.when(F.col(k).isNull(), F.col(code)).when(found, bound).otherwise(F.raise_error(F.lit("no signature to bind k to")).cast("string"))


def numbered_steps(text: str) -> Column:
    """The steps of a list numbered 1..n without a gap; empty if it is none."""
    lines = f"filter(split(trim({text}), '\\r?\\n'), l -> trim(l) <> '')"
    m = r"^\\s*(\\d+)[.)．、]\\s*(.+?)\\s*$"
    ok = f"size({lines}) > 0 AND NOT exists(transform({lines}, (l, i) -> NOT coalesce(try_cast(regexp_extract(l, '{m}', 1) as int) = i + 1, false)), x -> x)"
    return F.expr(f"IF(coalesce({ok}, false), transform({lines}, l -> regexp_extract(l, '{m}', 2)), cast(array() as array<string>))")


def follows_up(text: str) -> Column:
    """Whether a request refers to what came before."""
    t = F.trim(F.col(text))
    return t.rlike("^(?:前の|前回の|さっきの|先ほどの|直前の|それ(?:に|を|の|は|も)|その結果|その処理|その操作|その手順|その後|これに|これを|続けて|続き)") | t.rlike("(?i)^(?:k|数値)(?:の値)?(?:を|は|=).*?(?:変えて|変更して|変更する|にして)")


def fenced_code(text: str) -> dict[str, Column]:
    """code and error: the inside of exactly one fenced block, the trimmed text without one."""
    n = F.regexp_count(F.col(text), F.lit("```"))
    inside = F.regexp_extract(F.col(text), r"(?s)```[A-Za-z0-9_+-]*[ \t]*\r?\n(.*?)```", 1)
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    code = F.when(n == 0, bare(F.col(text))).when(n == 2, bare(inside))
    return {"code": code, "error": F.when(n.isin(0, 2), F.lit(None).cast("string")).otherwise("fences")}


def repaired_json(text: str) -> dict[str, Column]:
    """json and repaired: the text if it parses, else without a fence, else from its first { to its last }; null if nothing does."""
    t = F.trim(F.col(text))
    bare = F.trim(F.regexp_replace(t, r"(?s)^```(?:json)?\s*(.*?)\s*```$", "$1"))
    braces = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    good = lambda c: F.try_parse_json(c).isNotNull()
    return {"json": F.when(good(t), t).when(good(bare), bare).when(good(braces), braces), "repaired": ~good(t) & (good(bare) | good(braces))}


def has_thoughts(text: str) -> Column:
    return F.col(text).rlike(r"(?i)</?think>")


def fill_template(template: str, **values: Column) -> Column:
    """``$name`` by the column of that name; a name without a column raises here, not in a job."""
    import re

    out = F.lit(template)
    names = set(re.findall(r"\$([A-Za-z_]\w*)", template))
    if missing := names - set(values):
        raise KeyError(f"no value for {sorted(missing)}")
    for name in sorted(names, key=len, reverse=True):
        out = F.replace(out, F.lit(f"${name}"), values[name].cast("string"))
    return out


def acceptable_paraphrases(candidates: str, source: str, most: int) -> Column:
    """The first ``most`` different ones that aren't the source and hold neither thoughts nor fences."""
    return F.expr(f"slice(filter(array_distinct(transform({candidates}, c -> trim(c))), c -> c <> '' AND c <> {source} AND NOT c RLIKE '(?i)</?think>|```'), 1, {most})")


def valid_expression(text: str, most: int = 60, ends: tuple[str, ...] = ("る", "す", "く", "う", "む", "つ", "ぐ", "ぶ", "ぬ")) -> Column:
    """A one-line expression in Japanese: no Latin letters but k, no closing mark, a verb's ending."""
    t = F.col(text)
    return (F.length(t).between(1, most)) & ~t.rlike(r"[\r\n]") & ~t.rlike("[A-Za-jl-z]") & ~t.rlike(r"[。．.、,!！?？]$") & t.rlike(f"(?:{'|'.join(ends)})$")


def distinct_in_order(rows: DataFrame, group: str, value: str, order: str) -> DataFrame:
    """Each value of a group once, at its first place."""
    return rows.groupBy(group, value).agg(F.min(order).alias(order))


def closest_of_key(rows: DataFrame, item: str, key: str, text: str) -> DataFrame:
    """Of each item the other one of its key with the greatest Ratcliff-Obershelp ratio (least ``other`` on ties): (item, other, ratio).

    Every pair within a key is compared, the texts of one spec, some dozens; ratios in an Arrow function. An item alone in its key has no row.
    """

    @F.arrow_udf("double")
    def ratio(x: pa.Array, y: pa.Array) -> pa.Array:
        from difflib import SequenceMatcher

        return pa.array([None if u is None or v is None else SequenceMatcher(None, u, v).ratio() for u, v in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.float64())

    others = rows.select(key, F.col(item).alias("other"), F.col(text).alias("_text"))
    scored = rows.select(item, key, text).join(others, key).where(F.col(item) != F.col("other")).withColumn("ratio", ratio(text, "_text"))
    return scored.groupBy(item).agg(F.min_by(F.struct("other", "ratio"), F.struct(-F.col("ratio"), F.col("other"))).alias("m")).select(item, "m.*")



def code_tokens(rows: DataFrame, code: str, out: str) -> DataFrame:
    """Adds the Python tokens of a code without comments and layout; none where it can't be read."""

    @F.arrow_udf("array<string>")
    def tokens(v: pa.Array) -> pa.Array:
        import io
        import tokenize

        skip = {tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER, tokenize.ENCODING}
        found = []
        for x in v.to_pylist():
            try:
                found.append([t.string for t in tokenize.generate_tokens(io.StringIO(x or "").readline) if t.type not in skip])
            except (tokenize.TokenError, SyntaxError, IndentationError):
                found.append([])
        return pa.array(found, pa.list_(pa.string()))

    return rows.withColumn(out, tokens(code))


def ranked_options(rows: DataFrame, group: str, item: str, text: str, contexts: DataFrame, context: str, seed: int) -> DataFrame:
    """Items whose text is seen in each kind of context, ranked by seeded hash. contexts: (item, kind, context text)."""
    from sparkloom.functions.hashing import seeded_rank

    seen = rows.join(contexts, item).where(F.contains(F.col(context), F.col(text))).groupBy(group, item).agg(F.countDistinct("kind").alias("kinds"), F.count("*").alias("n"))
    return seen.withColumn("place", F.row_number().over(W.partitionBy(group).orderBy(seeded_rank(seed, group, item), item)))
