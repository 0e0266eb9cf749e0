"""Substring dedup by seed and extend: words covered by repeated runs of 35 words are removed.

Seeds are winnowed anchors of 8 words (see ``repeats``): every run of 35 words has one, at the same offset in each copy. Anchors
that repeat are extended both ways over their whole context, the text that all their windows cover:

* runs that share a context are repeated in every window: a group of copies costs one row a run, never a pair;
* where an anchor has several contexts, the first run of each extends window by window: windows are counted with partial
  sums on the map side, and those of a count of two or more are the maximal repeats' windows.

Each window belongs to one anchor, so nothing is compared twice. Contexts and windows are equal when the digests (BLAKE2b, 128
bits) of their words, joined by one space, are; word and gram hashes bring them together only. A window counts as repeated when it
starts at two places, the same document included. Windows are judged on the input. Removed is what any repeated window covers.

Null or empty text and an empty table: no words. Texts of any length are read whole. Repeated rows, also of one doc_id, are copies like any
others; so are rows of a null doc_id. Texts under one doc_id are kept apart by a hash. There are no ties: all copies are removed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import repeats
from sparkloom.llm.common import Tables, slices
from sparkloom.llm.hashes import digests, word_spans

WINDOW, GRAM = 35, 8


def read(raw: bytes) -> tuple[np.ndarray, Callable[[np.ndarray, np.ndarray], list[bytes]]]:
    """Word hashes, and spans of words joined by one space."""
    hashes, starts, ends = word_spans(raw)
    return hashes, lambda s, e: [b" ".join(raw[x:y].split()) for x, y in zip(starts[s].tolist(), ends[e - 1].tolist(), strict=True)]


def dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row of ``docs`` (doc_id, text); with ``texts`` also the kept words."""
    tables = Tables(docs.sparkSession, "substrings")
    rows = repeats.rows_of(docs)
    runs, kinds = repeats.contexts(rows, read, window, gram, tables)
    copied = runs.join(kinds.where("n > 1").select("h", "x", "y"), ["h", "x", "y"], "left_semi")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            ks, ts, xs, ys, starts, times = [], [], [], [], [], []
            for i, (k, t, text) in enumerate(zip(*[b.column(c).to_pylist() for c in ("k", "t", "text")], strict=True)):
                words = text.encode().split()
                own = b.column("own")[i].values
                s, e, n = (own.field(c).to_numpy(zero_copy_only=False) for c in ("s", "e", "n"))
                at = np.concatenate([np.arange(x, y + 1) for x, y in zip(s, e, strict=True)])
                ks.append(np.full(len(at), k))
                ts.append(np.full(len(at), t))
                x, y = digests([b" ".join(words[j : j + window]) for j in at.tolist()])
                xs.append(x)
                ys.append(y)
                starts.append(at)
                times.append(np.repeat(n, e - s + 1))
            cat = [np.concatenate(x) if x else np.empty(0, np.int64) for x in (xs, ys, ks, ts, starts, times)]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in cat[:4]], *[pa.array(c, pa.int32()) for c in cat[4:]]], ["x", "y", "k", "t", "s", "n"])

    some = kinds.where("others > 0").select("first.k", "first.t", "first.s", "first.e", F.least("n", F.lit(2)).cast("int").alias("n"))
    own = tables.write(some.groupBy("k", "t").agg(F.collect_list(F.struct("s", "e", "n")).alias("own")))
    windows = tables.write(repeats.with_texts(rows, own).mapInArrow(extend, "x long, y long, k long, t long, s int, n int"))
    twice = windows.groupBy("x", "y").agg(F.sum("n").alias("n")).where("n > 1").select("x", "y")
    found = windows.join(twice, ["x", "y"], "left_semi").select("k", "t", "s", (F.col("s") + window).alias("e"))
    spans = tables.write(copied.select("k", "t", "s", (F.col("e") + window).alias("e")).union(found))
    tables.drop(runs, kinds, own, windows)

    def judge(text: str, s: np.ndarray, e: np.ndarray) -> tuple:
        words = text.encode().split()
        if len(s):
            gone = repeats.covered(len(words), s, e)
            kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
        else:
            kept = words
        joined = b" ".join(kept)
        out = len(words), len(words) - len(kept), sha256(joined).hexdigest()
        return (*out, joined.decode()) if texts else out

    return repeats.finish(rows, spans, judge, "n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts)


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i+34], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g WHERE g IN (SELECT g FROM g GROUP BY g HAVING count(*) > 1)),
c AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM r) GROUP BY doc_id),
p AS (SELECT doc_id, p, w[p] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM w)),
k AS (SELECT p.doc_id, string_agg(x, ' ' ORDER BY p.p) AS kept FROM p ANTI JOIN (SELECT doc_id, unnest(ps) AS p FROM c) q ON q.doc_id = p.doc_id AND q.p = p.p GROUP BY p.doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(len(c.ps), 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""
