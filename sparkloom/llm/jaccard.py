"""Exact n-gram Jaccard join at 0.8 by a size-aware heavy-light join, and the components of its links.

A document's set holds the hashes of its distinct 5-word shingles. Documents of equal sets (by size and a digest of 128 bits) form one
class, a vertex of its own number; only classes are compared, so copies are never expanded into pairs.

* Small sets (up to ``boundary`` shingles): linked sets x, y share at least c = ceil(4 (|x| + |y|) / 9) shingles, hence a subset
  of c. Each small set enumerates its subsets of every size c that a partner of its size range can ask for; sets that meet in a
  subset of size c share c shingles, so only sizes decide, and linking each with the smallest set of
  the subset connects all that link there. One minimum a subset, no list of pairs.
* Large sets: two linked sets share a shingle among the first |x| - ceil(0.8 |x|) + 1 of each in one global order (rare
  ones first, by counters over all documents). Inverted lists of those prefixes give candidates. Per list, every set is first paired with the list's
  centre, the member most of whose prefix other sets have (of near copies of one text: the text itself or the one with the fewest
  changes), and with its last member; the links so found are closed to components. Then pairs in different components are listed. In lists of
  up to ``SHORT_LIST`` sets the rows have sizes only, and a pair stays if it shares as many prefix shingles as a link needs (``_ENOUGH``). In longer
  ones, of which there are few, each row has its set's parity sketch, which filters in the join condition: its Hamming distance never exceeds the
  sets' difference, so no link is lost. Where many sets of those can still be linked with members of another component, up to ``TURNS`` rounds
  pair them with two other members of each list before. All remaining pairs, those of small sets too, are held against the sketches and
  verified on the whole sets. A list of over ``BLOCK`` sets is compared in blocks: its sets are
  dealt into bands of sizes, of which only equal and neighbouring ones can link, and each band into blocks of ``BLOCK`` sets or so; each
  pair of blocks is a key of its own, so no task gets more than a block squared of one list.

``boundary`` is chosen by cost: of all documents it is counted how many sets have each size, and enumerating costs its subsets, scanning its
prefix plus the list entries that a shingle meets on average. Any boundary, any blocks and any order of shingles give the same links.

Null or empty texts and texts without words have the empty set and stand alone, whatever their ids. Each row belongs to the class of its own
text: rows of one doc_id with several texts, and rows of a null doc_id, are compared each by its text. ``component_id`` is the
smallest doc_id that is not null in the component, null if there is none. Repeated rows get the same result. Words are
lower-cased in A-Z only. Texts of any length are read whole. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import NULL_ID, Tables, bloom, components, let_through, maybe_in, slices, slots
from sparkloom.llm.hashes import grams, lowered, mix, word_hashes

SHINGLE = 5
#: Read no more: shingles are counted over all documents. The name stays for tests that set it.
SAMPLE_DOCS = 0
#: Counters of shingles, as powers of two, at least and at most (16 a document between), and the counters of one row of their sums.
COUNTERS_LEAST, COUNTERS_MOST, PIECE = 16, 24, 1_024
#: Largest boundary between small and large sets that is considered.
LARGEST_SMALL = 17
#: Bits of the parity sketch, as a power of two, and the shingles up to which a set has the shorter one.
SHORT_BITS, LONG_BITS, SHORT_SET = 10, 13, 1_500
#: Sets of a list up to which its pairs are listed by size, without sketches: a pair is smaller than a sketch. Any number gives the same links.
SHORT_LIST = 64
#: Sets of a list that are compared with each other in one piece.
BLOCK = 1_000
#: Rounds in which sets are paired with other members of their lists before all pairs that are left are listed, at most; a round is
#: left out if it has less than one pair for so many sets. Neither decides which links are found.
TURNS, FEW = 4, 20
_SEED = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = word_hashes(lowered(text))
    if not len(words):
        return words
    size = min(SHINGLE, len(words))
    return np.unique(grams(words, size) + np.uint64(size))


def sketch(s: np.ndarray) -> np.ndarray:
    """The parity of the number of elements that fall on each bit, 64 bits an int64."""
    bits = SHORT_BITS if len(s) <= SHORT_SET else LONG_BITS
    odd = np.bincount((mix(s) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def subset_sizes(n: int) -> list[int]:
    """The overlaps c that a set of n shingles can need with a partner of its own size or another: ceil(4 (n + m) / 9) <= n."""
    return sorted({c for m in range(ceil(0.8 * n - 1e-9), int(n / 0.8 + 1e-9) + 1) if (c := -(-4 * (n + m) // 9)) <= n})


def subsets(s: np.ndarray) -> Iterator[tuple[int, int]]:
    """(c, hash) of the subsets of a small set: the sum of the left-out elements is taken from the sum of all."""
    with np.errstate(over="ignore"):
        m = mix(s)
        total = m.sum(dtype=np.uint64)
        for c in subset_sizes(len(s)):
            for out in combinations(range(len(s)), len(s) - c):
                yield c, int((total - m[list(out)].sum(dtype=np.uint64)).view(np.int64)) if out else int(total.view(np.int64))


def boundary(sizes: dict[int, int], extra: float) -> int:
    """The size up to which subsets cost less than prefixes. sizes: sets by size; extra: other entries of a shingle's list."""
    best, least, cost = 0, 0.0, 0.0
    for n in range(1, LARGEST_SMALL + 1):
        enumerate_ = sum(comb(n, c) for c in subset_sizes(n))
        scan = (n - ceil(0.8 * n - 1e-9) + 1) * (1 + 4 * extra)
        cost += sizes.get(n, 0) * (enumerate_ - scan)
        if cost < least:
            best, least = n, cost
    return best


def _levels(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes in the same order: up to 63 as they are, then 16 steps for each doubling."""
    more = 64 + 16 * np.log2(np.maximum(counts, 64) / 64)
    return np.where(counts < 64, counts, np.minimum(more, 255)).astype(np.uint8)


def _counter(s: np.ndarray, bits: int) -> np.ndarray:
    return (s >> np.uint64(64 - bits)).astype(np.int64)


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in as few bytes each as the largest needs."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0)))).tobytes()


def _wide(counts: bytes, n: int) -> np.ndarray:
    """The ``n`` counts that ``_narrow`` has written."""
    return np.frombuffer(counts, f"u{len(counts) // n}").astype(np.int64)


def _order(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many documents have a shingle of each counter, as ``_levels``; the boundary. Both from one scan of all texts.

    A shingle is counted by the leading bits of its hash. Shingles that share a counter have its sum, so the order is the same for all sets.
    """
    bits = min(COUNTERS_MOST, max(COUNTERS_LEAST, (16 * docs.count()).bit_length()))
    tasks = slots(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sizes = np.zeros(1 << bits, np.uint32), np.zeros(LARGEST_SMALL + 2, np.uint32)
        for b in slices(batches):
            sets = [shingles(t) for t in b.column("text").to_pylist()]
            if sets:
                at, c = np.unique(_counter(np.concatenate(sets), bits), return_counts=True)
                total[at] += c.astype(np.uint32)
                sizes += np.bincount([min(len(x), LARGEST_SMALL + 1) for x in sets], minlength=len(sizes)).astype(np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([_narrow(sizes)])], ["k", "c"])
        for at in range(0, len(total) // PIECE, 256):
            pieces = [total[i * PIECE : (i + 1) * PIECE] for i in range(at, min(at + 256, len(total) // PIECE))]
            here = [(at + i, _narrow(x)) for i, x in enumerate(pieces) if x.any()]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in here], pa.int32()), pa.array([x for _, x in here], pa.binary())], ["k", "c"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, c in zip(b.column("k").to_pylist(), b.column("c").to_pylist(), strict=True):
                sums[k] = sums.get(k, 0) + _wide(c, PIECE if k >= 0 else LARGEST_SMALL + 2)
        out = [(k, (x if k < 0 else _levels(x)).tobytes(), float(x.sum()), float((x.astype(np.float64) ** 2).sum())) for k, x in sums.items()]
        k, c, n, square = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(c, pa.binary()), pa.array(n, pa.float64()), pa.array(square, pa.float64())], ["k", "c", "n", "square"])

    counted = docs.select("text").coalesce(tasks).mapInArrow(count, "k int, c binary").repartition(tasks, "k")
    levels, sizes, n, square = np.zeros(1 << bits, np.uint8), np.zeros(0, np.int64), 0.0, 0.0
    for r in counted.mapInArrow(add, "k int, c binary, n double, square double").toArrow().to_pylist():
        if r["k"] < 0:
            sizes = np.frombuffer(r["c"], np.int64)
        else:
            levels[r["k"] * PIECE : (r["k"] + 1) * PIECE] = np.frombuffer(r["c"], np.uint8)
            n, square = n + r["n"], square + r["square"]
    # The sum of squares less what shingles that share a counter by chance add to it.
    extra = max(0.0, square / max(1.0, n) - 1 - n / (1 << bits))
    return levels, boundary({i: int(x) for i, x in enumerate(sizes)}, min(8.0, extra))


def _own_postings(s: np.ndarray, levels: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and their c of one set: its subsets of each size c, hashed with c, its prefix with c = 0, or both.

    Sets up to ``limit`` enumerate subsets. Those above have prefixes, and so have those that can have a partner above.
    """
    n, hs, cs = len(s), [], []
    if 0 < n <= limit:
        c, h = zip(*subsets(s), strict=True)
        cs.append(np.array(c, np.int32))
        hs.append(mix(np.array(h, np.int64).view(np.uint64) + cs[0].astype(np.uint64) * _SEED).view(np.int64))
    if n > 0.8 * limit and n:
        v = s.view(np.int64)
        order = np.lexsort((v, levels[_counter(s, len(levels).bit_length() - 1)]))
        hs.append(v[order[: n - -(-8 * n // 10) + 1]])
        cs.append(np.zeros(len(hs[-1]), np.int32))
    return (np.concatenate(hs), np.concatenate(cs)) if hs else (np.empty(0, np.int64), np.empty(0, np.int32))


def _lists(arrays: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    flat = np.concatenate(arrays) if len(arrays) else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64) if flat.dtype == np.uint64 else flat))


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, whatever its order: two sums of its mixed elements."""
    return int(mix(s + np.uint64(1)).sum(dtype=np.uint64).view(np.int64)), int(mix(s ^ _SEED).sum(dtype=np.uint64).view(np.int64))


def _scanned(docs: DataFrame, levels, limit: int) -> DataFrame:
    """doc_id, t, set size, digest, sketch and postings of each document: one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in slices(batches):
                sets = [shingles(t) for t in b.column("text").to_pylist()]
                both = [_digest(s) for s in sets]
                posted = [_own_postings(s, levels.value, limit) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id"),
                        b.column("t"),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([x for x, _ in both], pa.int64()),
                        pa.array([y for _, y in both], pa.int64()),
                        _lists([sketch(s) for s in sets]),
                        _lists([h for h, _ in posted]),
                        _lists([c for _, c in posted]) if posted else pa.array([], pa.list_(pa.int32())),
                    ],
                    ["doc_id", "t", "n", "d1", "d2", "b", "hs", "cs"],
                )

    return docs.select("doc_id", "t", "text").mapInArrow(run, "doc_id long, t long, n int, d1 long, d2 long, b array<long>, hs array<long>, cs array<int>")


def _sets(docs: DataFrame) -> DataFrame:
    """The set of each text with its size and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for b in slices(batches):
                sets = [shingles(t) for t in b.column("text").to_pylist()]
                both = [_digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in sets], pa.int32()), pa.array([x for x, _ in both], pa.int64()), pa.array([y for _, y in both], pa.int64()), _lists(sets)], ["n", "d1", "d2", "s"])

    return docs.select("text").mapInArrow(run, "n int, d1 long, d2 long, s array<long>")


def _postings(found: DataFrame, field: np.ndarray) -> DataFrame:
    """(h, c, n, d1, d2, near): the postings that ``field`` lets through; near: how many in a thousand of its prefix that are."""
    sent = found.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            hs, cs = (b.column(x) for x in ("hs", "cs"))
            of = np.repeat(np.arange(b.num_rows), hs.value_lengths().to_numpy(zero_copy_only=False))
            h, c = hs.flatten(), cs.flatten()
            through, prefix = maybe_in(sent.value, h.to_numpy()), c.to_numpy() == 0
            all_, shared = (np.bincount(of[x], minlength=b.num_rows) for x in (prefix, prefix & through))
            near = (1000 * shared // np.maximum(1, all_)).astype(np.int32)
            at = pa.array(np.flatnonzero(through))
            rows = of[through]
            yield pa.RecordBatch.from_arrays([h.take(at), c.take(at), *(b.column(x).take(pa.array(rows)) for x in ("n", "d1", "d2")), pa.array(near[rows])], ["h", "c", "n", "d1", "d2", "near"])

    return found.select("n", "d1", "d2", "hs", "cs").mapInArrow(run, "h long, c int, n int, d1 long, d2 long, near int")


#: Whether two sets can be linked, by their sizes and sketches: a link's sets differ in (na + nb) / 9 shingles at most.
_POSSIBLE = (
    "10 * least(na, nb) >= 8 * greatest(na, nb) AND (size(ba) <> size(bb) OR "
    "9 * aggregate(zip_with(ba, bb, (x, y) -> bit_count(x ^ y)), 0, (a, x) -> a + x) <= na + nb)"
)


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Those pairs (a, b) that sizes and sketches allow."""
    out = pairs.join(classes.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("b").alias("ba")), "a")
    return out.join(classes.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("b").alias("bb")), "b").where(_POSSIBLE).select("a", "b")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, tables: Tables) -> DataFrame:
    """Those of the written pairs (a, b) whose whole sets have a Jaccard similarity of 0.8 or more.

    Of each class one text is read again; only texts that a bit field lets through are shuffled.
    """
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    needed = tables.write(classes.join(ids, "id", "left_semi").select("id", "n", "d1", "d2", "lead.t"))
    texts = let_through(docs.select("t", "text"), "t", bloom(needed, "t", needed.count()))
    # Two texts of one t would differ in their other hash, and both stay.
    texts = texts.join(needed.select("t").distinct(), "t", "left_semi").withColumn("u", F.hash("text")).dropDuplicates(["t", "u"])
    sets = _sets(texts).join(needed.drop("t"), ["n", "d1", "d2"]).groupBy("id").agg(F.first("s").alias("s"))
    sets = tables.write(sets)
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    out = tables.write(both.where(100 * shared >= 80 * (F.size("sa") + F.size("sb") - shared)).select("a", "b"))
    tables.drop(sets, needed)
    return out


def _blocked(placed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the comparison of long lists, keyed by (h, lo, hi, i, j): block i of band lo with block j of band hi.

    placed: (h, id, n, comp, b). A set of n shingles is in the band floor(log n / log 1.25), so linked sets are in one band or in neighbours.
    """
    band = F.floor(F.log("n") / F.log(F.lit(1.25))).cast("int")
    sizes = placed.groupBy("h", band.alias("band")).agg(F.count("*").alias("m"))
    sizes = sizes.groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("band", F.ceil(F.col("m") / BLOCK).cast("int")))).alias("blocks"))
    rows = placed.join(sizes, "h").withColumn("band", band)
    rows = rows.withColumn("g", F.element_at("blocks", F.col("band"))).withColumn("i", F.pmod(F.xxhash64("id"), F.col("g")).cast("int"))
    key = "named_struct('lo', {lo}, 'hi', {hi}, 'i', {i}, 'j', {j})"
    same = lambda seq, i, j: f"transform({seq}, z -> {key.format(lo='band', hi='band', i=i, j=j)})"
    other = lambda at, lo, hi, i, j: f"IF(element_at(blocks, {at}) IS NOT NULL, transform(sequence(0, element_at(blocks, {at}) - 1), z -> {key.format(lo=lo, hi=hi, i=i, j=j)}), array())"
    x = f"concat({same('sequence(i, g - 1)', 'i', 'z')}, {other('band + 1', 'band', 'band + 1', 'i', 'z')})"
    y = f"concat({same('sequence(0, i)', 'z', 'i')}, {other('band - 1', 'band - 1', 'band', 'z', 'i')})"
    return tuple(_side(rows.select(F.explode(F.expr(e)).alias("key"), "h", "id", "n", "comp", "b"), v, "key.lo", "key.hi", "key.i", "key.j") for e, v in ((x, "a"), (y, "b")))


def _side(placed: DataFrame, v: str, *key: str) -> DataFrame:
    return placed.select("h", *key, F.col("id").alias(v), F.col("n").alias(f"n{v}"), F.col("comp").alias(f"c{v}"), F.col("b").alias(f"b{v}"))


def _placed(inverted: DataFrame, comp: DataFrame) -> DataFrame:
    """(h, id, n, all, comp): the rows of lists with their components."""
    return inverted.select("h", "id", "n", "all").join(comp.withColumnRenamed("v", "id"), "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def _mixed(inverted: DataFrame, comp: DataFrame, classes: DataFrame) -> DataFrame:
    """(h, id, n, all, comp, b): the long lists with members in different components; all: the list's length."""
    placed = _placed(inverted.where(F.col("all") > SHORT_LIST), comp)
    mixed = placed.groupBy("h").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("h")
    return placed.join(mixed, "h").join(classes.select("id", "b"), "id")


#: Whether m shingles in both prefixes are enough for a link of sets of na and nb. Of those that a link shares, ceil(4 (na + nb) / 9) at least,
#: the set whose prefix ends first in the order has all but ceil(0.8 n) - 1 in its prefix, and there the other set's prefix has them too.
_ENOUGH = "m >= (4 * (na + nb) + 8) div 9 - (8 * greatest(na, nb) + 9) div 10 + 1"


def _listed(placed: DataFrame) -> DataFrame:
    """The pairs (a, b) of short lists in different components that sizes and common prefix shingles allow.

    placed: ``_placed`` of the lists of three sets up to ``SHORT_LIST``. Pairs with shorter or longer lists may miss here, as not all that they
    share is counted: the two sets of a list are each other's centre or last member and tried before, and those of longer lists are found there.
    """
    lists = placed.groupBy("h").agg(F.collect_list(F.struct("id", "n", "comp")).alias("of"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y")
    other = "filter(of, y -> x.id < y.id AND x.comp <> y.comp AND 10 * least(x.n, y.n) >= 8 * greatest(x.n, y.n))"
    pairs = lists.select(F.expr(f"inline(flatten(transform(of, x -> transform({other}, y -> named_struct('a', x.id, 'b', y.id, 'na', x.n, 'nb', y.n)))))"))
    return pairs.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("m")).where(_ENOUGH).select("a", "b")


#: Whether a pair of a mixed list may link two components.
_NEAR = f"ca <> cb AND {_POSSIBLE}"


def _pair(found: DataFrame) -> DataFrame:
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _turn(placed: DataFrame, turn: int) -> DataFrame:
    """Pairs of each set with two members of each of its lists, others for each list and turn, that may link their components."""
    by = F.xxhash64("id", "h", F.lit(turn))
    member = F.struct(*[F.col(x) for x in ("id", "n", "comp", "b")])
    ends = placed.groupBy("h").agg(F.array(F.min_by(member, by), F.max_by(member, by)).alias("two")).select("h", F.explode("two").alias("m"))
    ends = ends.select("h", *[F.col(f"m.{x}").alias(y) for x, y in (("id", "b"), ("n", "nb"), ("comp", "cb"), ("b", "bb"))])
    return _pair(_side(placed, "a").join(ends, "h").where(_NEAR)).distinct()


def _members(docs: DataFrame) -> DataFrame:
    """doc_id, t, n, comp (the component's smallest doc_id) and whether the row's text is the one that speaks for its component."""
    spark: SparkSession = docs.sparkSession
    tables = Tables(spark, "jaccard")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")
    levels, limit = _order(rows)
    found = tables.write(_scanned(rows, spark.sparkContext.broadcast(levels), limit))

    # Copies have equal sketches, so any of a class will do. Once written, the numbers are fixed.
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "t"))
    classes = found.where("n > 0").groupBy("n", "d1", "d2").agg(lead.alias("lead"), F.first("b").alias("b"))
    classes = tables.write(classes.withColumn("id", F.monotonically_increasing_id()))
    ids = classes.select("n", "d1", "d2", "id")

    # Only what two classes hold can link them.
    postings = found.select("d1", F.explode("hs").alias("h"))
    often = tables.write(postings.groupBy("h").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).where("lo < hi").select("h"))
    maybe = _postings(found, bloom(often, "h", often.count()))
    lists = tables.write(maybe.join(often, "h").distinct().join(ids, ["n", "d1", "d2"]).select("h", "c", "id", "n", "near"))
    tables.drop(often)

    # Small sets: those of a subset of size c link with its smallest set where c is enough for both sizes.
    ends = lists.groupBy("h").agg(F.min(F.struct("n", "id")).alias("lo"), F.min("id").alias("first"), F.max("id").alias("last"), F.max(F.struct("near", "id"))["id"].alias("centre"), F.count("*").alias("all")).where("first < last")
    small = lists.where("c > 0").join(ends, "h").where("9 * c >= 4 * (n + lo.n) AND id <> lo.id").select(F.least("id", "lo.id").alias("a"), F.greatest("id", "lo.id").alias("b"))

    # Large sets: first each with the centres and last members of its lists.
    inverted = tables.write(lists.where("c = 0").join(ends.select("h", "centre", "last", "all"), "h"))
    stars = _pair(inverted.select(F.col("centre").alias("a"), F.col("id").alias("b")).union(inverted.select(F.col("id").alias("a"), F.col("last").alias("b"))).where("a <> b")).distinct()
    stars = tables.write(_possible(stars, classes).union(small).distinct())
    tables.drop(lists)
    linked = _verified(stars, classes, rows, tables)
    comp = tables.write(components(spark, linked, tables))
    placed = tables.write(_mixed(inverted, comp, classes))
    tried, used = stars, [stars, linked]

    # Then those of long lists, while many of them in different components may be linked, with other members.
    for turn in range(TURNS):
        more = tables.write(_turn(placed, turn).join(tried, ["a", "b"], "left_anti"))
        used.append(more)
        if FEW * more.count() < placed.select("id").distinct().count() or more.isEmpty():
            break  # they are among the pairs listed below
        links = _verified(more, classes, rows, tables)
        tried = tried.union(more)
        whole = tables.write(components(spark, comp.toDF("a", "b").union(links), tables))
        tables.drop(comp, placed, links)
        comp = whole
        placed = tables.write(_mixed(inverted, comp, classes))

    # Then the pairs of a list that are in different components.
    pairs = _possible(_listed(_placed(inverted.where(F.col("all").between(3, SHORT_LIST)), comp)), classes)
    whole_lists = placed.where(F.col("all") <= BLOCK)
    pairs = pairs.union(_pair(_side(whole_lists, "a").join(_side(whole_lists, "b"), "h").where(f"a < b AND {_NEAR}")))
    if not (long := placed.where(F.col("all") > BLOCK)).isEmpty():
        x, y = _blocked(long)
        pairs = pairs.union(_pair(x.join(y, ["h", "lo", "hi", "i", "j"]).where(f"(lo < hi OR i < j OR a < b) AND {_NEAR}")))
    pairs = pairs.distinct()
    cross = tables.write(pairs.join(tried, ["a", "b"], "left_anti"))
    whole = comp
    if not cross.isEmpty():
        whole = components(spark, comp.toDF("a", "b").union(_verified(cross, classes, rows, tables)), tables)

    placed_in = tables.write(classes.select("n", "d1", "d2", "id", "lead").join(whole, F.col("id") == F.col("v"), "left").withColumn("comp", F.coalesce("comp", "id")).drop("v"))
    best = placed_in.groupBy("comp").agg(F.min("lead").alias("best"))
    by_class = placed_in.join(best, "comp").select("n", "d1", "d2", "best")
    # No aggregate follows, so that a class of very many copies can be split among tasks.
    same = (F.col("doc_id").eqNullSafe(F.col("best.doc_id"))) & (F.col("t") == F.col("best.t"))
    out = found.select("doc_id", "t", "n", "d1", "d2").join(by_class, ["n", "d1", "d2"], "left")
    out = tables.write(out.select("doc_id", "t", "n", F.when(F.col("n") > 0, F.col("best.doc_id")).otherwise(F.col("doc_id")).alias("comp"), ((F.col("n") == 0) | same).alias("speaks")))
    tables.drop(found, classes, inverted, *used, comp, placed, cross, placed_in)
    return out


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of each row of ``docs`` (doc_id, text)."""
    return _members(docs).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("comp").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of ``docs``, with all its columns; every row without words stays.

    It is one of the smallest doc_id (null last), and of several texts under that id the one of least hash. Of rows that repeat id and
    text, any one stays.
    """
    key, text = F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)), F.xxhash64(docs["text"])
    speaks = _members(docs).where("speaks").groupBy(F.coalesce("doc_id", F.lit(NULL_ID)).alias("kept_id"), F.col("t").alias("kept_text"), (F.col("n") > 0).alias("worded")).count()
    tables = Tables(docs.sparkSession, "kept")
    kept = tables.write(speaks)
    once = kept.where("count = 1 OR NOT worded")
    out = docs.join(once, (key == once["kept_id"]) & (text == once["kept_text"]), "left_semi")
    again = kept.where("count > 1 AND worded").select(F.col("kept_id").alias("again_id"), F.col("kept_text").alias("again_text"))
    if again.isEmpty():
        return out
    names = docs.columns
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("row"), key.alias("again_id"), text.alias("again_text"))
    return out.union(rows.join(again, ["again_id", "again_text"], "left_semi").dropDuplicates(["again_id", "again_text"]).select("row.*"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i:i+4] END AS g
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= 80 * (x.n + y.n - i)),
r(v, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.v)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c, w.doc_id)::BIGINT AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT v, min(c) AS c FROM r GROUP BY v) ON v = w.doc_id
"""
