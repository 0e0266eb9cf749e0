"""What substring dedup and suffix-array dedup share: anchors, their contexts, and spans over a sequence of symbols.

A text is a sequence of symbols (words, or bytes). A window is ``length`` consecutive symbols. Winnowing keeps, of the
``length - gram + 1`` grams in a window, the one of least hash (leftmost on a tie) as the window's anchor. The choice depends on the
window's content alone, so equal windows have equal anchors at equal offsets. Windows with one anchor are consecutive: they form a
run, and the text that a run covers is the anchor's context.

Hashes of symbols and grams only bring runs together. Contexts are told apart by a digest of their text (see ``hashes``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import NULL_ID, Tables, bloom, let_through, maybe_in, slices
from sparkloom.llm.hashes import digests, mix

#: Of a text in UTF-8: a hash of each symbol, and what gives the bytes of spans by their first symbols and ends.
Reader = Callable[[bytes], tuple[np.ndarray, Callable[[np.ndarray, np.ndarray], list[bytes]]]]

#: Symbols of a text are fewer than 2**31, the bytes that a string can have.
_POSITION = np.uint64((1 << 31) - 1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse, n at least."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]), 1 << 16)
        inverse = np.uint64(pow(int(_BASE), -1, 2**64))
        for i, b in enumerate((_BASE, inverse)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def gram_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive values, for candidates only."""
    n = len(values) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[size:] - total[:-size]) * down[:n])


def runs(symbols: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, position) of each anchor, and its first and last window start."""
    n = len(symbols)
    if n < length:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none
    hashes = gram_hashes(symbols, gram)
    best = (mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) & ~_POSITION) | np.arange(n - gram + 1, dtype=np.uint64)
    wide, left = 1, length - gram + 1
    while wide * 2 <= left:
        best = np.minimum(best[:-wide], best[wide:])
        wide *= 2
    if wide < left:
        best = np.minimum(best[: len(best) - (left - wide)], best[left - wide :])
    where = (best & _POSITION).astype(np.int64)
    first = np.concatenate([[0], np.flatnonzero(where[1:] != where[:-1]) + 1])
    last = np.concatenate([first[1:] - 1, [len(where) - 1]])
    return hashes[where[first]], where[first], first, last


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n symbols lie in a span."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, np.asarray(starts, np.int64), 1)
    np.add.at(step, np.minimum(np.asarray(ends, np.int64), n), -1)
    return np.cumsum(step[:-1]) > 0


def rows_of(docs: DataFrame) -> DataFrame:
    """(k, t, text): id and a hash of the text, which keeps apart texts under one id."""
    return docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).cast("long").alias("k"), F.xxhash64("text").alias("t"), F.coalesce("text", F.lit("")).alias("text"))


_RUNS = (("h", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("k", pa.int64()), ("t", pa.int64()), ("s", pa.int32()), ("e", pa.int32()), ("p", pa.int32()))


def contexts(docs: DataFrame, read: Reader, length: int, gram: int, tables: Tables) -> tuple[DataFrame, DataFrame]:
    """Two written tables over ``docs`` (k, t, text).

    runs: (h, x, y, k, t, s, e, p): a run of windows that start at symbols s to e of document k, whose anchor, at p, has a hash h that
    occurs elsewhere too; x and y are the digest of the context.
    kinds: (h, x, y, n, first, others): how many runs share a context; the least (k, t, s, e, p) of them; the number of other contexts of h.

    A first scan counts anchor hashes, added up in each batch. The second writes the runs of anchors that a bit field of the repeated
    ones lets through; a stray one has a count of 1 and does no harm.
    """
    spark = docs.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [runs(read(t.encode())[0], length, gram)[0] for t in b.column("text").to_pylist()]
            h, c = np.unique(np.concatenate(found), return_counts=True) if found else (np.empty(0, np.uint64), [])
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c, pa.int64())], ["h", "c"])

    counted = docs.select("text").mapInArrow(count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where("c > 1")
    repeated = tables.write(counted.select("h"))
    field = spark.sparkContext.broadcast(bloom(repeated, "h", repeated.count()))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[list[np.ndarray]] = [[] for _ in _RUNS]
            for k, t, text in zip(*[b.column(c).to_pylist() for c in ("k", "t", "text")], strict=True):
                symbols, spans = read(text.encode())
                h, p, first, last = runs(symbols, length, gram)
                keep = maybe_in(field.value, h.view(np.int64)) if len(h) else np.empty(0, bool)
                if keep.any():
                    h, p, first, last = h[keep], p[keep], first[keep], last[keep]
                    x, y = digests(spans(first, last + length))
                    for i, v in enumerate((h.view(np.int64), x, y, np.full(len(h), k), np.full(len(h), t), first, last, p)):
                        out[i].append(v)
            cat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in out]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, (_, kind) in zip(cat, _RUNS, strict=True)], [n for n, _ in _RUNS])

    runs_ = tables.write(docs.mapInArrow(emit, "h long, x long, y long, k long, t long, s int, e int, p int"))
    tables.drop(repeated)
    kinds = runs_.groupBy("h", "x", "y").agg(F.count("*").alias("n"), F.min(F.struct("k", "t", "s", "e", "p")).alias("first"))
    kinds = tables.write(kinds)
    many = kinds.groupBy("h").agg(F.count("*").alias("m")).where("m > 1")
    out = tables.write(kinds.join(many, "h", "left").select("h", "x", "y", "n", "first", F.coalesce(F.col("m") - 1, F.lit(0)).alias("others")))
    tables.drop(kinds)
    return runs_, out


def with_texts(docs: DataFrame, per_doc: DataFrame) -> DataFrame:
    """``per_doc`` (one row a k and t, written) with the texts of its documents; only texts that a bit field lets through are shuffled."""
    return let_through(docs, "t", bloom(per_doc, "t", per_doc.count())).join(per_doc, ["k", "t"])


def finish(docs: DataFrame, spans: DataFrame, judge: Callable[[str, np.ndarray, np.ndarray], tuple], fields: str) -> DataFrame:
    """doc_id and what ``judge`` says of each row's text and the starts and ends of its ``spans`` (k, t, s, e).

    Spans are gathered a document, each once however often rows repeat, so at most two for each of its symbols. Documents that the bit field of those with spans doesn't
    let through are judged where they are read; the other texts are shuffled to their spans once.
    """
    per_doc = spans.groupBy("k", "t").agg(F.collect_set(F.struct("s", "e")).alias("spans"))
    marked = spans.select("t").distinct()
    field = docs.sparkSession.sparkContext.broadcast(bloom(marked, "t", marked.count()))
    names = [f.split()[0] for f in fields.split(", ")]
    schema = pa.schema([("k", pa.int64()), ("t", pa.int64()), ("text", pa.string()), *[(n, pa.string() if f.endswith("string") else pa.int64()) for n, f in zip(names, fields.split(", "), strict=True)]])
    none = np.empty(0, np.int64)

    def table(b, text, said) -> pa.RecordBatch:
        cols = list(zip(*said, strict=True)) if said else [[] for _ in names]
        return pa.RecordBatch.from_arrays([b.column("k"), b.column("t"), pa.array(text, pa.string()), *[pa.array(c, f.type) for c, f in zip(cols, list(schema)[3:], strict=True)]], schema=schema)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            maybe = maybe_in(field.value, b.column("t").to_numpy(zero_copy_only=False))
            texts = b.column("text").to_pylist()
            said = [(None,) * len(names) if m else judge(t, none, none) for m, t in zip(maybe, texts, strict=True)]
            yield table(b, [t if m else None for m, t in zip(maybe, texts, strict=True)], said)

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, before = b.column("text").to_pylist(), [b.column(n).to_pylist() for n in names]
            spans_, said = b.column("spans"), []
            for i, t in enumerate(texts):
                if t is None:
                    said.append(tuple(c[i] for c in before))
                    continue
                own = spans_[i].values
                s, e = (own.field("s").to_numpy(zero_copy_only=False), own.field("e").to_numpy(zero_copy_only=False)) if own is not None else (none, none)
                said.append(judge(t, s, e))
            yield table(b, [None] * len(texts), said)

    out = docs.mapInArrow(first, f"k long, t long, text string, {fields}").join(per_doc, ["k", "t"], "left").mapInArrow(second, f"k long, t long, text string, {fields}")
    return out.select(F.when(F.col("k") != NULL_ID, F.col("k")).alias("doc_id"), *names)
