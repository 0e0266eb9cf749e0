"""Benchmark decontamination by winnowing, on built-in functions only.

A k-gram of ``gram`` words is hashed, and of each ``window - gram + 1`` consecutive k-grams the least hash is kept, with its position,
on both sides. A span of ``window`` shared words holds the same such run of k-grams, so it keeps the same hash at the same place: the
join of the fingerprints finds every shared span. Hits are then extended from their positions: each window of the document around a hit
is compared with the item windows, as a whole word sequence, so a hash decides nothing by itself, and overlapping windows
merge to the longest shared spans.

Items of fewer words than a window are windows of their own length and have every position of that length as fingerprint. The
training side is scanned once for the fingerprints of all lengths, and only fingerprints (about 2 in 7 words) meet the test side;
that side is broadcast only if its counted bytes are under ``BROADCAST_BYTES``, and shuffled else. Texts with hits are read once more.

Defined cases: null or empty text or item: no words, so no hit; an empty table on either side: no hit. An item with a null item_id counts
for words hit, not for items. Repeated items and repeated documents are each reported by their id; rows of one doc_id, or of a null
one, with other texts are kept apart. Texts of any length are read whole. Of equal least hashes the leftmost is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import ASCII_LOWER, NULL_ID, Tables, let, words_sql

WINDOW, GRAM = 10, 5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes of fingerprints, or of windows, at most that are sent to every executor.
BROADCAST_BYTES = 8 << 20
#: Words of a text are fewer: positions take the low bits of a packed hash.
_POSITION = (1 << 31) - 1


def _words(column: str) -> str:
    return words_sql(ASCII_LOWER.format(f"coalesce({column}, '')"), SEPARATORS)


def _grams(k: int) -> str:
    """Hashes of the k-grams of ``g``, the hashes of single words."""
    gram = "xxhash64(x" + "".join(f", get(g, i + {j})" for j in range(1, k)) + ")"
    return f"transform(slice(g, 1, greatest(0, size(g) - {k - 1})), (x, i) -> {gram})"


def fingerprints_sql(window: int, gram: int) -> str:
    """SQL for the winnowed grams of column ``words``, as structs (f, p) of hash and position; the window's length is hashed along,
    so lengths don't mix. Hashes are compared by their high 33 bits, then by position."""
    w = window - gram + 1
    least = "least(x" + "".join(f", get(v, i + {j})" for j in range(1, w)) + ")" if w > 1 else "x"
    kept = f"array_distinct(transform(slice(v, 1, greatest(0, size(v) - {w - 1})), (x, i) -> {least}))"
    packed = let("v", f"transform(h, (x, i) -> (x & {~_POSITION}) | i)", kept)
    found = f"transform({packed}, x -> named_struct('f', h[cast(x & {_POSITION} as int)], 'p', cast(x & {_POSITION} as int)))"
    return let("g", f"transform(words, x -> xxhash64(x, {window}))", let("h", _grams(gram), found))


def windows_sql(window: int) -> str:
    return let("ws", "words", f"transform(sequence(0, size(ws) - {window}), i -> array_join(slice(ws, i + 1, {window}), ' '))")


#: SQL for the windows (n, p, win) of column ``words`` around its column ``hits`` of (n, g, p): of n words, over the gram of g words at p.
_AROUND = let(
    "ws",
    "words",
    "transform(array_distinct(flatten(transform(hits, h -> IF(greatest(0, h.p + h.g - h.n) > least(h.p, size(ws) - h.n), array(), transform("
    "sequence(greatest(0, h.p + h.g - h.n), least(h.p, size(ws) - h.n)), i -> named_struct('n', h.n, 'p', i)))))), "
    "e -> named_struct('n', e.n, 'p', e.p, 'win', array_join(slice(ws, e.p + 1, e.n), ' ')))",
)


def _small(df: DataFrame, n_bytes: int) -> DataFrame:
    return F.broadcast(df) if n_bytes <= BROADCAST_BYTES else df


def _scored(docs: DataFrame, items: DataFrame, window: int, gram: int) -> DataFrame:
    """The columns of ``decontaminate`` after k and t, the id and the hash of the text that tell rows apart."""
    d = docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("k"), F.xxhash64("text").alias("t"), F.col("doc_id"), F.col("text"))
    b = items.select("item_id", F.expr(_words("text")).alias("words")).where("size(words) > 0")
    b = b.withColumn("n", F.least(F.size("words"), F.lit(window)))
    lengths = sorted(r[0] for r in b.select("n").distinct().collect())  # at most `window` values

    def worded(rows: DataFrame) -> DataFrame:
        """With words; the id keeps the filter from being computed below them once more."""
        out = rows.select("*", F.expr(_words("text")).alias("words"), F.monotonically_increasing_id().alias("here"))
        return out.where((F.size("words") >= (lengths[0] if lengths else 0)) & (F.col("here") >= 0)).drop("text", "here")

    out = d.select("k", "t", "doc_id", F.size(F.expr(_words("text"))).cast("long").alias("n_words"))
    if not lengths:
        none = F.lit(0).cast("long")
        return out.select("*", none.alias("n_hit"), none.alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"), F.expr("cast(array() as array<struct<s:int,e:int>>)").alias("spans"))

    tables = Tables(docs.sparkSession, "decontaminate")
    test = wins = None
    for n in lengths:
        of, g = b.where(F.col("n") == n), min(gram, n)
        f = of.select(F.explode(F.expr(fingerprints_sql(n, g))).alias("e")).select("e.f", F.lit(n).alias("n"), F.lit(g).alias("g"))
        w = of.select("item_id", F.lit(n).alias("n"), F.explode(F.expr(windows_sql(n))).alias("win"))
        test, wins = (f, w) if test is None else (test.union(f), wins.union(w))
    test, wins = tables.write(test.distinct()), tables.write(wins.distinct())
    test_bytes = 24 * test.count()
    win_bytes = wins.agg(F.sum(F.octet_length("win") + 32)).first()[0]

    prints = F.expr("concat(" + ", ".join(fingerprints_sql(n, min(gram, n)) for n in lengths) + ")")
    found = worded(d.select("k", "t", "text")).select("k", "t", F.explode(prints).alias("e")).select("k", "t", "e.f", "e.p")
    hits = found.join(_small(test, test_bytes), "f").groupBy("k", "t").agg(F.collect_set(F.struct("n", "g", "p")).alias("hits"))
    near = worded(d.select("k", "t", "text").join(hits, ["k", "t"])).select("k", "t", F.explode(F.expr(_AROUND)).alias("e")).select("k", "t", "e.*")
    # Read twice below; written, the texts are joined with their hits once.
    at = tables.write(near.join(_small(wins.select("n", "win").distinct(), win_bytes), ["n", "win"], "left_semi"))

    # A document's positions: no more than its words.
    spans = at.groupBy("k", "t", "p").agg(F.max("n").alias("n")).groupBy("k", "t").agg(F.array_sort(F.collect_list(F.struct("p", "n"))).alias("s"))
    step = "named_struct('n', a.n + greatest(0, x.p + x.n - greatest(x.p, a.e)), 'e', greatest(a.e, x.p + x.n))"
    spans = spans.select("k", "t", "s", F.expr(f"aggregate(s, named_struct('n', 0, 'e', 0), (a, x) -> {step}).n").cast("long").alias("n_hit"))
    named = at.select("k", "t", "n", "win").distinct().join(_small(wins.where("item_id IS NOT NULL"), win_bytes), ["n", "win"]).select("k", "t", "item_id").distinct()
    named = named.groupBy("k", "t").agg(F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("ids"))
    named = named.select("k", "t", F.size("ids").cast("long").alias("n_items"), F.array_join("ids", ",").alias("items"))
    out = out.join(spans, ["k", "t"], "left").join(named, ["k", "t"], "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    merged = (
        "aggregate(coalesce(s, array()), cast(array() as array<struct<s:int,e:int>>), (a, x) -> IF(x.p <= coalesce(get(a, size(a) - 1).e, -1), "
        "concat(slice(a, 1, size(a) - 1), array(named_struct('s', get(a, size(a) - 1).s, 'e', greatest(get(a, size(a) - 1).e, x.p + x.n)))), array_append(a, named_struct('s', x.p, 'e', x.p + x.n))))"
    )
    return out.select("k", "t", "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.expr(merged).alias("spans"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM, spans: bool = False) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of ``docs`` (doc_id, text).

    With ``spans`` also the longest shared spans, as structs (s, e) of the first word and the one after the last.
    """
    return _scored(docs, items, window, gram).drop("k", "t", *([] if spans else ["spans"]))


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """The rows of ``docs`` in which no item window occurs, with all their columns; each row by its own text, whatever its id."""
    bad = _scored(docs, items, window, gram).where("contaminated").select(F.col("k").alias("bad_id"), F.col("t").alias("bad_text")).distinct()
    same = (F.coalesce(docs["doc_id"], F.lit(NULL_ID)) == bad["bad_id"]) & (F.xxhash64(docs["text"]) == bad["bad_text"])
    return docs.join(bad, same, "left_anti")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS win FROM (
        SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i:i+n-1], ' ') AS win FROM (
        SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
h AS (SELECT r, i, n, win FROM dw WHERE win IN (SELECT win FROM bw)),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
it AS (SELECT r, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS items
        FROM (SELECT DISTINCT r, win FROM h) JOIN bw USING (win) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN it USING (r)
"""
