"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier are removed.

A sparse suffix array. Only where an anchor, a winnowed gram of 32 bytes (see ``repeats``), repeats can a 100-byte string repeat, so
only the suffixes of contexts whose anchor repeats are ordered:

* Copies are aggregated before anything is shuffled by suffix: of runs with equal contexts (by a digest of 128 bits) all but the first, by
  (doc_id, start), are removed whole; the first speaks for the context from here on.
* The contexts that are left and share their anchor with another are range-partitioned by the leading bytes of their suffix from the
  anchor on, with splitters that Spark samples. A digest of the context breaks ties, so an anchor of very many contexts, or one very frequent
  continuation, spreads over buckets like any other.
* A bucket goes through its contexts in order, some ``BUCKET_WINDOWS`` suffixes at a time: it sorts the suffixes that start in them by multikey
  quicksort, ternary partitions on eight bytes a step; those alone in their partition leave it. Of each group of equal 100-byte
  prefixes all but the first are removed.
* Comparison across boundaries: equal suffixes whose bytes from the anchor on lead the bucket's first or last context may also lie in
  the bucket before or after. What is left of those, one a group, is compared with all other buckets' by its digest; again all but the first go.

Null or empty text and an empty table: no bytes. Texts of any length are read whole. Rows that repeat a doc_id with the same text are one
document, and get the same result; other texts under one doc_id, or a null one (which comes before all others), are kept apart
by a hash, in whose order they then come.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import repeats
from sparkloom.llm.common import Tables, slices, slots
from sparkloom.llm.hashes import digests, mix

WINDOW, GRAM = 100, 32
#: Suffixes that a bucket sorts at a time; leading bytes that buckets are dealt by.
BUCKET_WINDOWS, LEAD = 400_000, 64
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def read(raw: bytes) -> tuple[np.ndarray, Callable[[np.ndarray, np.ndarray], list[bytes]]]:
    """Byte values, and spans of bytes."""
    return _VALUES[np.frombuffer(raw, np.uint8)], lambda s, e: [raw[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)]


def multikey_quicksort(columns: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that share their first ``length`` bytes with another: their indices in ``at``, and a group number of each.

    columns: the eight bytes from each position, as one number. All open partitions take their steps together: each is split by the column
    it has come to into less than, equal to and greater than its middle suffix's; the equal ones go on to the next column.
    Partitions of one suffix are closed, and so are those equal in all columns.
    """
    steps = np.array([*range(0, length - 7, 8), *([length - 8] if length % 8 else [])])
    item, first, depth = np.arange(len(at)), np.zeros(min(1, len(at)), np.int64), np.zeros(min(1, len(at)), np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    while len(item):
        size = np.diff(np.append(first, len(item)))
        part = np.repeat(np.arange(len(first)), size)
        key = columns[at[item] + steps[depth][part]]
        pivot = key[first + size // 2][part]
        side = 1 + (key > pivot).astype(np.int8) - (key < pivot).astype(np.int8)
        # A stable partition: each side's elements keep their order and come after the sides before.
        counts = np.bincount(part * 3 + side, minlength=3 * len(first))
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        place = np.empty(len(item), np.int64)
        for x in range(3):
            mine = np.flatnonzero(side == x)
            own = part[mine]
            before = np.cumsum(counts[x::3]) - counts[x::3]
            place[mine] = starts[3 * own + x] + np.arange(len(mine)) - before[own]
        sorted_ = np.empty_like(item)
        sorted_[place] = item
        deeper = np.tile(np.array([0, 1, 0]), len(first)) + np.repeat(depth, 3)
        open_, closed = (counts > 1) & (deeper < len(steps)), (counts > 1) & (deeper == len(steps))
        if closed.any():
            members = np.repeat(closed, counts)
            done.append((sorted_[members], np.repeat(np.arange(closed.sum()), counts[closed])))
        item, depth, sizes = sorted_[np.repeat(open_, counts)], deeper[open_], counts[open_]
        first = np.cumsum(sizes) - sizes
    if not done:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    base = np.cumsum([0, *[g[-1] + 1 for _, g in done]])
    return np.concatenate([i for i, _ in done]), np.concatenate([g + b for (_, g), b in zip(done, base, strict=False)])


def _common(leads: list[bytes], other: bytes) -> np.ndarray:
    """How many leading bytes each of ``leads`` shares with ``other``."""
    rows = np.frombuffer(b"".join([x.ljust(LEAD, b"\0") for x in leads]), np.uint8).reshape(-1, LEAD)
    same = rows == np.frombuffer(other.ljust(LEAD, b"\0"), np.uint8)
    return np.minimum(np.where(same.all(1), LEAD, same.argmin(1)), np.minimum([len(x) for x in leads], len(other)))


def _sorted(rows: pa.Table, window: int) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...]]:
    """Of contexts that come in order: (k, t, first, last) of the runs of starts whose windows have an earlier equal one among them, and
    (x, y, k, t, start) of the windows that may have an equal one before or after, one of each."""
    n = lambda c: rows.column(c).to_numpy().astype(np.int64)
    texts, leads, counts = rows.column("text").to_pylist(), rows.column("lead").to_pylist(), n("n")
    data = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    columns = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
    offset = np.concatenate([[0], np.cumsum([len(t) for t in texts])])[:-1]
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    of = np.repeat(np.arange(len(texts)), counts)
    at, k, t, s = offset[of] + inside, n("k")[of], n("t")[of], n("s")[of] + inside
    left, group = multikey_quicksort(columns, at, window)
    order = np.lexsort((s[left], t[left], k[left], group))
    left, group = left[order], group[order]
    first = np.concatenate([[True], group[1:] != group[:-1]]) if len(left) else np.empty(0, bool)
    lead = left[np.flatnonzero(first)[np.cumsum(first) - 1]] if len(left) else left
    again = ~first
    # A document that repeats, by id and text, has each of its starts twice.
    moved = (k[left] != k[lead]) | (t[left] != t[lead]) | (s[left] != s[lead])
    later = left[again & moved]
    near = np.maximum(_common(leads, leads[0]), _common(leads, leads[-1]))
    may = near[of] >= np.minimum(window - n("o")[of] + inside, LEAD)
    may[left[again]] = False
    across = np.flatnonzero(may)
    x, y = digests([data[p : p + window].tobytes() for p in at[across].tolist()])
    k2, t2, s2 = k[later], t[later], s[later]
    order = np.lexsort((s2, t2, k2))
    k2, t2, s2 = k2[order], t2[order], s2[order]
    new = np.flatnonzero(np.concatenate([[True], (k2[1:] != k2[:-1]) | (t2[1:] != t2[:-1]) | (s2[1:] > s2[:-1] + 1)])) if len(k2) else np.empty(0, np.int64)
    runs = (k2[new], t2[new], s2[new], s2[np.append(new[1:], len(s2)) - 1] if len(k2) else s2)
    return runs, (x, y, k[across], t[across], s[across])


_CUT = (("lead", pa.binary()), ("x", pa.int64()), ("k", pa.int64()), ("t", pa.int64()), ("s", pa.int32()), ("n", pa.int32()), ("o", pa.int32()), ("text", pa.binary()))
_FOUND = (("x", pa.int64()), ("y", pa.int64()), ("k", pa.int64()), ("t", pa.int64()), ("s", pa.int32()), ("e", pa.int32()))


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    tables = Tables(spark, "suffixes")
    rows = repeats.rows_of(docs)
    runs, kinds = repeats.contexts(rows, read, window, gram, tables)
    copies = kinds.where("n > 1").select("h", "x", "y", F.col("first.k").alias("fk"), F.col("first.t").alias("ft"), F.col("first.s").alias("fs"))
    copied = runs.join(copies, ["h", "x", "y"]).where("k <> fk OR t <> ft OR s <> fs").select("k", "t", "s", (F.col("e") + window).alias("e"))

    some = kinds.where("others > 0").select("first.k", "first.t", "x", "first.s", "first.e", "first.p")
    own = tables.write(some.groupBy("k", "t").agg(F.collect_list(F.struct("x", "s", "e", "p")).alias("own")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[tuple] = []
            for i, (k, t, text) in enumerate(zip(*[b.column(c).to_pylist() for c in ("k", "t", "text")], strict=True)):
                raw = text.encode()
                for o in b.column("own")[i].as_py():
                    s, e, p = o["s"], o["e"], o["p"]
                    out.append((raw[p : min(p + LEAD, e + window)], o["x"], k, t, s, e - s + 1, p - s, raw[s : e + window]))
            cols = list(zip(*out, strict=True)) if out else [[]] * len(_CUT)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(cols, _CUT, strict=True)], [n for n, _ in _CUT])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bucket's contexts come in order."""

        def flush() -> pa.RecordBatch:
            (k, t, s, e), (x, y, k2, t2, s2) = _sorted(pa.Table.from_batches(held).combine_chunks(), window)
            none, absent = np.zeros(len(k), np.int64), np.concatenate([np.ones(len(k), bool), np.zeros(len(x), bool)])
            cols = [np.concatenate(c) for c in ((none, x), (none, y), (k, k2), (t, t2), (s, s2), (e, s2))]
            return pa.RecordBatch.from_arrays([pa.array(c, kind, mask=absent if n in "xy" else None) for c, (n, kind) in zip(cols, _FOUND, strict=True)], [n for n, _ in _FOUND])

        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            ends = np.cumsum(b.column("n").to_numpy())
            lo = 0
            while lo < b.num_rows:
                hi = max(lo + 1, int(np.searchsorted(ends, BUCKET_WINDOWS - size + (ends[lo - 1] if lo else 0), side="right")))
                held.append(b.slice(lo, hi - lo))
                size += int(ends[hi - 1] - (ends[lo - 1] if lo else 0))
                lo = hi
                if size >= BUCKET_WINDOWS or lo < b.num_rows:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    cuts = repeats.with_texts(rows, own).mapInArrow(cut, "lead binary, x long, k long, t long, s int, n int, o int, text binary")
    cuts = tables.write(cuts)
    ordered = cuts.repartitionByRange(slots(spark), "lead", "x").sortWithinPartitions("lead", "x")
    found = tables.write(ordered.mapInArrow(sort, "x long, y long, k long, t long, s int, e int"))
    across = found.where("x IS NOT NULL")
    first = across.groupBy("x", "y").agg(F.min(F.struct("k", "t", "s")).alias("f"), F.count("*").alias("c")).where("c > 1")
    across = across.join(first, ["x", "y"]).where("k <> f.k OR t <> f.t OR s <> f.s").select("k", "t", "s", "e")
    later = found.where("x IS NULL").select("k", "t", "s", "e").union(across).select("k", "t", "s", (F.col("e") + window).alias("e"))
    spans = tables.write(copied.union(later))
    tables.drop(runs, kinds, own, cuts, found)

    def judge(text: str, s: np.ndarray, e: np.ndarray) -> tuple:
        raw = text.encode()
        if not len(s):
            return len(raw), 0, 0, sha256(raw).hexdigest()
        gone = repeats.covered(len(raw), s, e)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
        return len(raw), len(raw) - len(kept), n_spans, sha256(kept).hexdigest()

    return repeats.finish(rows, spans, judge, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")


ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
g AS (SELECT doc_id, i, substr(x, 2 * i + 1, 200) AS g FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99)) AS i FROM d)),
f AS (SELECT g, min((doc_id, i)) AS f FROM g GROUP BY g HAVING count(*) > 1),
r AS (SELECT doc_id, i FROM g JOIN f USING (g) WHERE (doc_id, i) <> f.f),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 100)) AS p FROM r),
n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE q IS NULL OR p > q + 1) AS s FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM c) GROUP BY doc_id),
a AS (SELECT doc_id, string_agg(substr(x, 2 * p + 1, 2), '' ORDER BY p) AS kept FROM (
        SELECT d.doc_id, x, p FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2)) AS p FROM d WHERE doc_id IN (SELECT doc_id FROM n)) d ANTI JOIN c USING (doc_id, p)) GROUP BY doc_id)
SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(s, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN x ELSE coalesce(kept, '') END)) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN a USING (doc_id)
"""
