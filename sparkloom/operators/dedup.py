"""Exact and n-gram dedup: first-wins, exclusion, overlap of sets, shingles and contamination probes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions.hashing import sha


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``: an aggregate with partial minima, so a hot key costs a row a task."""
    rest = [c for c in rows.columns if c not in key]
    least = F.min_by(F.struct(*rest), F.struct(*order)) if rest else F.count("*")
    out = rows.groupBy(*key).agg(least.alias("_row"))
    return out.select(*key, *([f"_row.{c}" for c in rest] if rest else []))


def marked_duplicates(rows: DataFrame, text: str, order: str) -> DataFrame:
    """Adds ``text_hash``, ``first`` (of the rows with this text) and ``is_duplicate``. Texts are the same if their SHA-256 is (``collisions`` looks for
    hashes that lie); null ones are a text of their own."""
    hashed = rows.withColumn("text_hash", F.coalesce(sha(F.col(text)), F.lit("null")))
    least = hashed.groupBy("text_hash").agg(F.min(order).alias("first"))
    return hashed.join(least, "text_hash").withColumn("is_duplicate", F.col(order) != F.col("first"))


def collisions(rows: DataFrame, text: str, hash_: str) -> DataFrame:
    """Hashes that stand for more than one text."""
    return rows.groupBy(hash_).agg(F.min(text).alias("a"), F.max(text).alias("b")).where("a <> b")


def exclude_known(rows: DataFrame, known: DataFrame, hash_: str, text: str) -> DataFrame:
    """Rows whose (hash, text) no known row has."""
    return rows.join(known.select(hash_, text), [hash_, text], "left_anti")


def set_overlap(rows: DataFrame, set_: str, hash_: str) -> DataFrame:
    """(a, b, common): hashes that two sets share, for all pairs of sets; sets are few, hashes many.

    The sets of a hash are gathered (no more than there are sets) and their pairs counted, so hashes are shuffled once.
    """
    per = rows.groupBy(hash_).agg(F.array_sort(F.collect_set(set_)).alias("sets")).where("size(sets) > 1")
    pairs = per.select(F.explode("sets").alias("a"), "sets").select("a", F.explode("sets").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("common"))


def shingles(tokens: str | Column, size: int) -> Column:
    """Consecutive ``size`` tokens as texts joined by blanks; none where there are fewer."""
    t = tokens if isinstance(tokens, str) else "tokens"
    return F.expr(f"CASE WHEN size({t}) < {size} THEN cast(array() as array<string>) ELSE transform(sequence(0, size({t}) - {size}), i -> array_join(slice({t}, i + 1, {size}), ' ')) END")


def gram_hashes(tokens: str, size: int) -> Column:
    """A hash of each gram that ``shingles`` gives, from the hashes of its tokens, without the gram itself."""
    gram = "xxhash64(" + ", ".join(f"h[i + {j}]" for j in range(size)) + ")"
    found = f"transform(array(transform({tokens}, x -> xxhash64(x))), h -> transform(sequence(0, size(h) - {size}), i -> {gram}))[0]"
    return F.expr(f"CASE WHEN size({tokens}) < {size} THEN cast(array() as array<bigint>) ELSE {found} END")


def gram_index(corpus: DataFrame, source: str, tokens: str, size: int) -> DataFrame:
    """(gram_hash, gram, source, offset): of each gram the first (source, offset)."""
    both = F.expr("arrays_zip(g, h)")
    grams = corpus.select(source, shingles(tokens, size).alias("g"), gram_hashes(tokens, size).alias("h")).select(source, F.posexplode(both).alias("offset", "z")).select(source, "offset", F.col("z.g").alias("gram"), F.col("z.h").alias("gram_hash"))
    return grams.groupBy("gram_hash", "gram").agg(F.min(F.struct(F.col(source).alias("source"), "offset")).alias("at")).select("gram_hash", "gram", "at.source", "at.offset")


def contamination(rows: DataFrame, key: str, tokens: str, index: DataFrame, size: int) -> DataFrame:
    """The first gram of each row that the index has: (key, row_offset, gram, source, offset). Rows have different keys.

    Hashes of grams meet the index first; the grams themselves are made and compared only where one is there.
    """
    hashes = rows.select(key, F.posexplode(gram_hashes(tokens, size)).alias("row_offset", "gram_hash"))
    at = hashes.join(index.select("gram_hash").distinct(), "gram_hash", "left_semi").groupBy(key).agg(F.collect_set("row_offset").alias("_at"))
    grams = F.expr(f"transform(_at, i -> named_struct('row_offset', i, 'gram', array_join(slice({tokens}, i + 1, {size}), ' ')))")
    near = rows.select(key, tokens).join(at, key).select(key, F.explode(grams).alias("g")).select(key, "g.row_offset", "g.gram")
    hit = near.join(index, "gram")
    return hit.groupBy(key).agg(F.min(F.struct("row_offset", "gram", "source", "offset")).alias("m")).select(key, "m.*")


def contamination_summary(rows: DataFrame, key: str, tokens: str, hits: DataFrame, size: int) -> DataFrame:
    """rows, eligible (long enough), matched."""
    joined = rows.select(key, (F.size(tokens) >= size).alias("e")).join(hits.select(key, F.lit(True).alias("m")), key, "left")
    return joined.agg(F.count("*").alias("rows"), F.count_if("e").alias("eligible"), F.count_if("m").alias("matched"))


def take_until_quota(candidates: DataFrame, spec: str, order: str, rank: str, code: str, quota: int) -> DataFrame:
    """Verified candidates, deduplicated over all specs (first by spec order and rank), then the first ``quota`` of each spec.

    A candidate that no spec would have tried must not exclude others: pass blocks of ranks in turn and give what was taken before
    through ``exclude_known``.
    """
    unique = first_wins(candidates, [code], [order, rank])
    return unique.withColumn("n", F.row_number().over(W.partitionBy(spec).orderBy(rank, code))).where(F.col("n") <= quota)


def shortfalls(taken: DataFrame, specs: DataFrame, spec: str, quota: int) -> DataFrame:
    """Specs with fewer rows than the quota, and how many they lack."""
    n = taken.groupBy(spec).agg(F.count("*").alias("n"))
    return specs.join(n, spec, "left").select(spec, (F.lit(quota) - F.coalesce("n", F.lit(0))).alias("missing")).where("missing > 0")


def phrase_leaks(texts: DataFrame, text: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """Texts that contain a held-out phrase once both are freed of white space. Phrases are a curated list of some dozens.

    The list is gathered in one array and tested in a single pass over the texts, instead of pairing each text with each phrase.
    """
    norm = lambda c: F.regexp_replace(c, r"\s+", "")
    listed = [r[0] for r in phrases.select(norm(F.col(phrase))).distinct().limit(10_001).collect()]
    if len(listed) > 10_000:
        raise ValueError("more held-out phrases than one pass should test")
    found = F.filter(F.array(*[F.lit(p) for p in sorted(listed)]), lambda p: F.contains(norm(F.col(text)), p))
    return texts.withColumn("phrases", found).where("size(phrases) > 0")


def weighted_phrase_counts(texts: DataFrame, text: str, phrases: list[str]) -> DataFrame:
    """(phrase, n): rows that contain each phrase: each text as often as it is there. Texts are not shuffled, only phrases with partial counts."""
    one = texts.select(F.explode(F.filter(F.array(*[F.lit(p) for p in phrases]), lambda p: F.contains(F.col(text), p))).alias("phrase"))
    return one.groupBy("phrase").agg(F.count("*").alias("n"))


def rewrite_duplicates(rows: DataFrame, known: DataFrame, text: str, template: str) -> DataFrame:
    """Rows whose text is known get ``template`` around it (``{}``); ``changed`` says which."""
    out = rows.join(known.select(text).distinct().withColumn("_k", F.lit(True)), text, "left").withColumn("changed", F.col("_k").isNotNull())
    return out.withColumn(text, F.when(F.col("changed"), F.replace(F.lit(template), F.lit("{}"), F.col(text))).otherwise(F.col(text))).drop("_k")


def spec_quota_audit(rows: DataFrame, spec: str, quota: int, code: str, code_hash: str) -> DataFrame:
    """(problem, n): specs off the quota, rows whose hash isn't their text's."""
    off = rows.groupBy(spec).agg(F.count("*").alias("c")).where(F.col("c") != quota).agg(F.count("*").alias("n")).select(F.lit("off quota").alias("problem"), "n")
    bad = rows.where(~F.col(code_hash).eqNullSafe(sha(code))).agg(F.count("*").alias("n")).select(F.lit("hash differs").alias("problem"), "n")
    return off.union(bad)


def leakage_counts(benchmark: DataFrame, train: DataFrame, keys: dict[str, str]) -> DataFrame:
    """(kind, n): benchmark rows whose key of each kind, a column name, some training row has."""
    out = None
    for kind, key in keys.items():
        one = benchmark.join(train.select(key).distinct(), key, "left_semi").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.union(one)
    return out
