"""Resumable work as streams: results are appended once for each key, whatever is delivered again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def append_once(source: DataFrame, work: Callable[[DataFrame], DataFrame], key: str, sink: str, checkpoint: str) -> StreamingQuery:
    """Runs ``work`` on what a stream brings, and appends rows whose key the sink lacks.

    A batch that is run again after a failure, and keys delivered twice, add nothing: each batch is deduplicated and anti-joined with the
    keys in the sink, of which one column is read, before it is written. A null key is a key like any other.
    """

    def commit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = batch.dropDuplicates([key])
        path = spark._jvm.org.apache.hadoop.fs.Path(sink)
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            done = spark.read.parquet(sink).select(F.col(key).alias("_done"))
            new = new.join(done, new[key].eqNullSafe(done["_done"]), "left_anti")
        work(new).withColumn("batch", F.lit(number)).write.mode("append").parquet(sink)

    return source.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_passes(source: DataFrame, at: str, late: str, width: str, group: list[str]) -> DataFrame:
    """Passes by tumbling window of event time, closed ``late`` after the latest time seen."""
    return source.withWatermark(at, late).groupBy(F.window(at, width), *group).agg(F.count("*").alias("n"), F.count_if("passed").alias("passed"))


def latest_metrics(source: DataFrame, at: str, late: str, key: str) -> DataFrame:
    """A stream of metrics without the rows delivered again within ``late``."""
    return source.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
