"""Tokenizer corpus, its statistics, and byte-pair encoding with a given or a small trained vocabulary."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.hashing import sha
from sparkloom.functions.stats import length_summary


def corpus_texts(rows: DataFrame, fields: list[str], special: list[str]) -> DataFrame:
    """(field, text_hash, text): each field's different texts once; one with a special token raises."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])).alias("r")).select("r.*").where("text IS NOT NULL")
    bad = F.lit(False)
    for s in special:
        bad = bad | F.contains("text", F.lit(s))
    long = long.withColumn("text", F.when(bad, F.raise_error(F.lit("a text holds a special token")).cast("string")).otherwise(F.col("text"))) if special else long
    return long.withColumn("text_hash", sha("text")).groupBy("field", "text_hash").agg(F.min("text").alias("text"), F.count("*").alias("times"))


def corpus_stats(texts: DataFrame) -> DataFrame:
    """By field: texts, duplicates dropped, characters, bytes."""
    return texts.groupBy("field").agg(F.count("*").alias("texts"), (F.sum("times") - F.count("*")).alias("dropped"), F.sum(F.length("text")).alias("characters"), F.sum(F.octet_length("text")).alias("bytes"))


def _visible() -> dict[int, str]:
    """Each byte as a printable character: printable Latin-1 as it is, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in out):
        out[b] = chr(256 + i)
    return out


class BytePairs:
    """Byte-level BPE over whole texts: the pair of lowest rank is merged everywhere, until none is known."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], special: int = 0) -> None:
        self.vocabulary, self.ranks, self.special = vocabulary, {m: i for i, m in enumerate(merges)}, special
        self.pieces = {i: p for p, i in vocabulary.items()}
        self.to_char = _visible()
        self.to_byte = {c: b for b, c in self.to_char.items()}

    def encode(self, text: str) -> list[int]:
        """Pairs wait in a heap by rank and place; neighbours are linked, so a merge costs a logarithm of the text's length."""
        parts: list[str | None] = [self.to_char[b] for b in text.encode()]
        n = len(parts)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        waiting = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := self.ranks.get((parts[i], parts[i + 1]))) is not None]
        heapify(waiting)
        while waiting:
            _, i, x, y = heappop(waiting)
            j = after[i] if parts[i] == x else n
            if j >= n or parts[j] != y:
                continue  # one of the two has gone into another piece
            parts[i], parts[j] = x + y, None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for at in (before[i], i):
                if at >= 0 and after[at] < n and (r := self.ranks.get((parts[at], parts[after[at]]))) is not None:
                    heappush(waiting, (r, at, parts[at], parts[after[at]]))
        return [self.vocabulary[p] for p in parts if p is not None]

    def decode(self, ids: list[int]) -> str:
        return bytes(self.to_byte[c] for i in ids if i >= self.special for c in self.pieces[i]).decode(errors="replace")


def train_pairs(texts: DataFrame, text: str, merges: int, least: int = 2, longest: int | None = None, cut: int = 16) -> list[tuple[str, str]]:
    """The first ``merges`` merges of byte-pair training on texts as single words: one count of pairs a merge, for small vocabularies.

    Pairs seen fewer than ``least`` times, or of more than ``longest`` characters together, are not merged. Words are kept as arrays; pairs are
    counted with partial sums and only the best pair comes to the driver. Each ``cut`` merges the words are checkpointed, which cuts the plan.
    """
    visible = _visible()
    table = F.create_map(*[x for b, c in visible.items() for x in (F.lit(f"{b:02X}"), F.lit(c))])
    hexed = F.expr(f"filter(split(hex(cast({text} as binary)), '(?<=\\\\G..)'), x -> x <> '')")
    rows = texts.select(F.transform(hexed, lambda h: table[h]).alias("p")).groupBy("p").agg(F.count("*").alias("n")).checkpoint()
    done: list[tuple[str, str]] = []
    for step in range(1, merges + 1):
        pairs = rows.select("n", F.explode(F.expr("transform(sequence(0, greatest(0, size(p) - 2)), i -> named_struct('a', get(p, i), 'b', get(p, i + 1)))")).alias("x")).where("x.b IS NOT NULL")
        if longest is not None:
            pairs = pairs.where(F.length("x.a") + F.length("x.b") <= longest)
        best = pairs.groupBy("x").agg(F.sum("n").alias("c")).orderBy(F.desc("c"), "x").limit(1).collect()
        if not best or best[0]["c"] < least:
            break
        a, b = best[0]["x"]["a"], best[0]["x"]["b"]
        done.append((a, b))
        joined = F.aggregate(
            "p",
            F.expr("cast(array() as array<string>)"),
            lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, F.when(F.size(acc) > 0, -1).otherwise(1)) == F.lit(a)) & (x == F.lit(b)), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.lit(a + b)))).otherwise(F.concat(acc, F.array(x))),
        )
        rows = rows.select(joined.alias("p"), "n")
        if step % cut == 0:
            rows = rows.checkpoint()
    return done


def encoded(rows: DataFrame, text: str, tokenizer: BytePairs) -> DataFrame:
    """Adds ``ids`` in Arrow batches."""
    names = rows.columns
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, ids array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [None if t is None else tokenizer.encode(t) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"])

    return rows.mapInArrow(run, schema)


def checked(rows: DataFrame, text: str, tokenizer: BytePairs) -> DataFrame:
    """Adds ``ids``, whether they decode to the text again (``same``), and how many stand for a single byte (``n_bytes``), in Arrow batches."""
    names = rows.columns
    single = {i for i, p in tokenizer.pieces.items() if i >= tokenizer.special and len(p) == 1}
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in rows.schema)}, ids array<int>, same boolean, n_bytes int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(text).to_pylist()]
            ids = [tokenizer.encode(t) for t in texts]
            same = [tokenizer.decode(i) == t for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32())), pa.array(same), pa.array([sum(x in single for x in i) for i in ids], pa.int32())], [*names, "ids", "same", "n_bytes"])

    return rows.mapInArrow(run, schema)


def check_totals(rows: DataFrame, vocabulary: int) -> DataFrame:
    """Of ``checked`` rows: how many don't decode to themselves, the share of tokens that are single bytes, and the share of the vocabulary in use."""
    used = rows.select(F.explode("ids").alias("i")).agg(F.countDistinct("i").alias("used")).scalar()
    n = F.sum(F.size("ids"))
    return rows.agg(F.count("*").alias("rows"), F.count_if(~F.col("same")).alias("broken"), (F.sum("n_bytes") / F.nullif(n, F.lit(0))).alias("byte_share"), (F.first(used) / F.lit(vocabulary)).alias("used_share"))


def audit(ids: DataFrame, column: str, context: int, special: list[int]) -> DataFrame:
    """Lengths, share over the context, and rows in which a special token isn't there exactly once."""
    n = F.size(column)
    wrong = F.lit(False)
    for s in special:
        wrong = wrong | (F.size(F.filter(column, lambda x, s=s: x == s)) != 1)
    return ids.agg(F.count("*").alias("rows"), F.avg(n).alias("mean"), F.max(n).alias("longest"), (F.count_if(n > context) / F.count("*")).alias("over_share"), F.count_if(wrong).alias("wrong_special"))


def usage(ids: DataFrame, column: str, top: int) -> DataFrame:
    """The most used tokens."""
    return ids.select(F.explode(column).alias("token")).groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(top)


def lengths(ids: DataFrame, column: str) -> DataFrame:
    return length_summary(ids.select(F.size(column).alias("n_tokens")), "n_tokens")


def vocabulary_problem(vocabulary: dict[str, int], special: list[str], size: int) -> str | None:
    """Why a vocabulary isn't as declared: its size, ids without a gap, special tokens first and in order."""
    if len(vocabulary) != size:
        return f"{len(vocabulary)} tokens instead of {size}"
    if sorted(vocabulary.values()) != list(range(size)):
        return "ids with gaps"
    if [vocabulary.get(s) for s in special] != list(range(len(special))):
        return "special tokens elsewhere"
    return None
