"""Sources and sinks: JSON lines, members of archives, review tables, manifests; guarded, atomic and repeatable writes."""

from __future__ import annotations

import csv
import io
import json
import zipfile
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Objects, one a line, with a declared schema; blank lines are skipped, others that don't fit fail the read."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def keyed_json_lines(spark: SparkSession, path: str, schema: StructType | str, key: str) -> DataFrame:
    """``json_lines`` whose ``key`` must be there and unique: a row without one, or with one that another row has, raises when it is read."""
    rows = json_lines(spark, path, schema)
    seen = rows.groupBy(key).agg(F.count("*").alias("_n"))
    out = rows.join(seen, rows[key].eqNullSafe(seen[key]), "inner").drop(seen[key])
    problem = F.when(F.col(key).isNull(), "a row has no key").when(F.col("_n") > 1, F.concat(F.lit("a key is repeated: "), F.col(key).cast("string")))
    return out.withColumn("_n", F.when(problem.isNotNull(), F.raise_error(problem).cast("long")).otherwise(F.col("_n"))).where("_n = 1").drop("_n")


def zip_member(spark: SparkSession, path: str, member: str, schema: StructType | str) -> DataFrame:
    """Objects in a member of each archive at ``path``: archives are read in parallel, lines of one as a stream; a missing member raises."""

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    if member not in z.namelist():
                        raise FileNotFoundError(f"{p} has no member {member}")
                    held: list[str] = []
                    with z.open(member) as f:
                        for raw in io.TextIOWrapper(f, "utf-8"):
                            if raw.strip():
                                held.append(raw)
                            if len(held) >= 10_000:
                                yield pa.RecordBatch.from_arrays([pa.array(held)], ["line"])
                                held = []
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["line"])

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(lines, "line string")
    return found.select(F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def chained(sources: list[DataFrame]) -> DataFrame:
    """Sources one after the other, with ``source_ordinal``."""
    out = None
    for i, s in enumerate(sources):
        one = s.withColumn("source_ordinal", F.lit(i))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source")
    return out


def review_table(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A reviewed CSV: a byte order mark and lines before the header are tolerated, short rows padded, blank ones dropped, long ones raise.

    Such a file is edited by people and fits one task; files are spread.
    """
    import csv

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                table = list(csv.reader(io.StringIO(content.decode("utf-8-sig"), newline="")))
                at = next((i for i, r in enumerate(table) if set(required) <= set(r)), None)
                if at is None:
                    raise ValueError(f"{p} has no header with {required}")
                head, out = table[at], []
                for n, r in enumerate(table[at + 1 :], at + 2):
                    if not any(x.strip() for x in r):
                        continue
                    if len(r) > len(head):
                        raise ValueError(f"{p}, line {n}: more cells than the header")
                    out.append((n, dict(zip(head, r + [""] * (len(head) - len(r)), strict=True))))
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.int32()), pa.array([list(d.items()) for _, d in out], pa.map_(pa.string(), pa.string()))], ["line", "cells"])

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, "line int, cells map<string,string>")
    return found.select("line", *[F.col("cells")[c].alias(c) for c in required], "cells")


def csv_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("mode", "FAILFAST").csv(path)


def config(text: str, keys: dict[str, type], kind: str = "json") -> dict[str, Any]:
    """An object of JSON, or of YAML where a library for it is there, with exactly these keys and types; a boolean is no integer."""
    if kind == "yaml":
        try:
            import yaml
        except ImportError as e:
            raise ValueError("no library reads YAML here") from e
        value = yaml.safe_load(text)
    else:
        value = json.loads(text)
    if not isinstance(value, dict) or set(value) != set(keys):
        raise ValueError(f"the keys must be {sorted(keys)}")
    for k, t in keys.items():
        if type(value[k]) is not t:
            raise ValueError(f"{k} must be of type {t.__name__}")
    return value


#: Bytes of a file that may be one value.
ONE_VALUE = 1 << 30


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files. Those too large to be one value, few, are hashed as streams from the driver."""
    found = spark.read.format("binaryFile").load(path)
    out = found.where(F.col("length") <= ONE_VALUE).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = []
    for r in found.where(F.col("length") > ONE_VALUE).select("path", "length").collect():
        p, files = _file_system(spark, r["path"])
        stream = files.open(p)
        try:
            large.append((r["path"], r["length"], spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)))
        finally:
            stream.close()
    return out.union(spark.createDataFrame(large, out.schema)) if large else out


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose hash differs, or that are on one side only."""
    a, b = before.select("path", F.col("sha256").alias("_a")), after.select("path", F.col("sha256").alias("_b"))
    return a.join(b, "path", "full_outer").where("NOT (_a <=> _b)").select("path")


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def guard(spark: SparkSession, inputs: list[str], outputs: list[str], overwrite: bool = False) -> None:
    """Raises if an output is an input, or is there and may not be overwritten."""
    if same := set(inputs) & set(outputs):
        raise ValueError(f"an output is also an input: {sorted(same)}")
    for o in outputs:
        p, fs = _file_system(spark, o)
        if not overwrite and fs.exists(p):
            raise FileExistsError(o)


def write_json_lines(rows: DataFrame, path: str, order: list[str] | None = None, single: bool = False, overwrite: bool = False) -> None:
    """JSON lines, in parts sorted by range of ``order``; one part only if the consumer needs a single file. Spark commits all or nothing."""
    out = rows
    if order:
        out = (out.coalesce(1).sortWithinPartitions(*order) if single else out.repartitionByRange(*order).sortWithinPartitions(*order))
    out.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", False).json(path)


def append_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("ignoreNullFields", False).json(path)


def write_partitioned(rows: DataFrame, path: str, by: list[str], overwrite: bool = False) -> None:
    """Parquet by columns of few values, such as suite and split; rows of one are brought together, large ones over several files."""
    rows.repartition(*by, F.pmod(F.xxhash64(*rows.columns[:1]), F.lit(8))).write.mode("overwrite" if overwrite else "errorifexists").partitionBy(*by).parquet(path)


def repeatable_zip(rows: DataFrame, line: Column, order: list[str], member: str, most: int = 2_000_000) -> bytes:
    """An archive of sorted lines with fixed time, mode and compression: equal rows give equal bytes. For release files that fit the driver."""
    data, n = io.BytesIO(), 0
    info = zipfile.ZipInfo(member, (1980, 1, 1, 0, 0, 0))
    info.external_attr, info.compress_type = 0o644 << 16, zipfile.ZIP_DEFLATED
    with zipfile.ZipFile(data, "w") as z, z.open(info, "w") as f:
        for r in rows.select(*order, line.alias("_line")).orderBy(*order).toLocalIterator():
            n += 1
            if n > most:
                raise ValueError("too many rows for one archive")
            f.write(r["_line"].encode() + b"\n")
    return data.getvalue()


def write_review(rows: DataFrame, path: str, columns: list[str], blank: list[str], order: list[str]) -> None:
    """CSV for people to fill in: ``columns`` in this order, then empty ``blank`` ones, with a header and a byte order mark, in one file.

    A review fits one task; more than 100,000 rows raise.
    """
    picked = rows.orderBy(*order).select(*columns, *[F.lit("").alias(c) for c in blank]).limit(100_001)
    found = picked.collect()
    if len(found) > 100_000:
        raise ValueError("more rows than people review")
    out = io.StringIO()
    table = csv.writer(out, lineterminator="\n")
    table.writerow([*columns, *blank])
    table.writerows([["" if v is None else v for v in r] for r in found])
    target = Path(path)
    part = target.with_name(f".{target.name}.part")
    part.write_text("\ufeff" + out.getvalue(), encoding="utf-8")
    part.replace(target)
