"""What the text operators share: the shared folder, written tables, SQL helpers and components of a graph.

Conventions of every operator here:

* only the columns an operator needs are selected first, so extra columns, also with names that an operator uses
  itself, do no harm;
* a null text has no words, characters or bytes;
* ``doc_id`` is the key of ``documents``. Rows with a null id stay, as one key ``NULL_ID`` inside an operator.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null doc_id where ids are grouped or joined.
NULL_ID = -(2**63)
#: White space of ``[^\x20\x09-\x0D]+`` words, as a pattern that splits.
SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a new one only where that is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders of tables written inside ``scratch`` blocks that are open, innermost last.
_open: list[list[str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what operators called inside have left in the shared folder.

    For callers that have written or collected an operator's result: a result is lazy and reads the operator's last tables.
    """
    _open.append([])
    try:
        yield
    finally:
        for root in _open.pop():
            _delete(spark, root)


class Tables:
    """Tables written to the shared folder during one call of an operator; ``drop`` deletes those no longer read.

    Those that the result still reads go with the ``scratch`` block around the call, or else when the driver ends.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", 0
        if _open:
            _open[-1].append(self.root)
        at = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(at)
        files.deleteOnExit(at)

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._sparkloom_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            _delete(self.spark, t._sparkloom_path)


def let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is evaluated once a row."""
    return f"transform(array({value}), {name} -> {body})[0]"


def words_sql(column: str, separators: str) -> str:
    """SQL for the non-empty pieces of a column between separators; of null: no pieces."""
    escaped = separators.replace("\\", "\\\\")
    return f"array_remove(split(coalesce({column}, ''), '{escaped}'), '')"


ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def slots(spark: SparkSession) -> int:
    return max(2, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Bits of a bit field, as powers of two: at least and at most (32 MB).
FIELD_LEAST, FIELD_MOST = 16, 28


def bloom(df: DataFrame, column: str, rows: int) -> np.ndarray:
    """A bit field with a bit for each value of a long column of ``rows`` rows, 16 bits a row or more.

    It is built on the executors, a word of 64 bits a row, and has 2**FIELD_MOST bits at most, so it can be broadcast whatever the
    input. Beyond 2**24 values it lets more through and the exact join that follows it has more to do; it never loses one.
    """
    bits_log2 = min(FIELD_MOST, max(FIELD_LEAST, (16 * rows).bit_length()))
    words = bits_log2 - 6
    mixed = F.shiftrightunsigned(F.xxhash64(F.col(column)), 64 - bits_log2)
    found = (
        df.select(F.shiftrightunsigned(mixed, 6).cast("int").alias("w"), F.expr("1L").alias("one"), mixed.alias("m"))
        .select("w", F.expr("shiftleft(one, cast(m & 63 as int))").alias("b"))
        .groupBy("w")
        .agg(F.bit_or("b").alias("b"))
    ).toArrow()
    field = np.zeros(1 << words, np.int64)
    field[found["w"].to_numpy()] = found["b"].to_numpy()
    return field


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def xxhash64_of_long(values: np.ndarray) -> np.ndarray:
    """What Spark's xxhash64 gives for a bigint column, as uint64."""
    rot = lambda x, r: (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    with np.errstate(over="ignore"):
        h = np.full(len(values), np.uint64(42) + _P5 + np.uint64(8), np.uint64)
        h ^= rot(values.astype(np.int64).view(np.uint64) * _P2, 31) * _P1
        h = rot(h, 27) * _P1 + _P4
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def maybe_in(field: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values a ``bloom`` lets through."""
    m = xxhash64_of_long(values) >> np.uint64(64 - (len(field).bit_length() - 1 + 6))
    return (field.view(np.uint64)[(m >> np.uint64(6)).astype(np.int64)] >> (m & np.uint64(63))) & np.uint64(1) == 1


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches: what a worker makes of a batch is bounded, whatever the session's batch size."""
    for b in batches:
        for at in range(0, max(1, b.num_rows), rows):
            yield b.slice(at, rows)


def let_through(df: DataFrame, column: str, field: np.ndarray) -> DataFrame:
    """The rows of ``df`` whose ``column`` (long) a ``bloom`` lets through."""
    sent = df.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(maybe_in(sent.value, b.column(column).to_numpy(zero_copy_only=False))))

    return df.mapInArrow(run, df.schema)


def components(spark: SparkSession, edges: DataFrame, tables: Tables) -> DataFrame:
    """(v, comp): the smallest vertex that each vertex of ``edges`` (a, b) reaches.

    Rounds of large-star and small-star (Kiveris et al. 2014) on a written edge table; a hub only ever gets its smallest
    neighbour as a value, so no neighbour list is gathered. The rounds are logarithmic in practice; stars stay as they are.
    """
    now = tables.write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = lambda t: t.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
    before = state(now)
    while before[0]:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
        large = both.join(least, both.a == least.k).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = tables.write(large.where("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m")
        small = large.join(low, large.a == low.k).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        after = tables.write(small.where("a <> b").distinct())
        tables.drop(now, large)
        now, last, before = after, before, state(after)
        if before == last:
            break
    return now.select(F.col("a").alias("v"), F.col("b").alias("comp")).union(now.select(F.col("b").alias("v"), F.col("b").alias("comp"))).groupBy("v").agg(F.min("comp").alias("comp"))
