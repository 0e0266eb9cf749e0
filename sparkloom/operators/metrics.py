"""Training-metric streams and per-model summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.operators.joins import as_of_bucketed


def split_stream(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Training rows (with a loss) and validation rows (event = validation) of an append-only stream; any other row raises."""
    train = F.col("loss").isNotNull() & F.col("event").isNull()
    valid = F.col("event").eqNullSafe("validation")
    kind = F.when(train, "train").when(valid, "validation").otherwise(F.raise_error(F.lit("a row is neither training nor validation")).cast("string"))
    tagged = rows.withColumn("_kind", kind)
    return tagged.where("_kind = 'train'").drop("_kind"), tagged.where("_kind = 'validation'").drop("_kind")


def epoch_metrics(train: DataFrame, validation: DataFrame, every: int) -> DataFrame:
    """Validation rows with the last training loss logged at or before their step."""
    return as_of_bucketed(validation.select("step", "validation_loss"), train.select("step", "loss"), "step", "loss", F.floor(F.col("step") / every))


def ticks(most: int, wanted: int = 8) -> list[int]:
    """Places of an axis from 0 to ``most`` at 1, 2 or 5 times a power of ten."""
    step = 1
    while most / step > wanted:
        step = step * 5 // 2 if str(step)[0] == "2" else step * 2
    return list(range(0, most + 1, step))


def variant_regions(weights: DataFrame, regions: DataFrame) -> DataFrame:
    """Mean attention mass of each region over steps and heads: (variant, region, mass). regions: (region, k), a small table."""
    per = weights.join(regions, "k").groupBy("variant", "step", "head", "region").agg(F.sum("weight").alias("mass"))
    n = weights.select("variant", "step", "head").distinct().groupBy("variant").agg(F.count("*").alias("n"))
    return per.groupBy("variant", "region").agg(F.sum("mass").alias("mass")).join(n, "variant").select("variant", "region", (F.col("mass") / F.col("n")).alias("mass"))


def head_report(rows: DataFrame, model: str, head: str, value: str) -> DataFrame:
    """Of each model the mean, the least and the greatest value and the head that has it (first by name on ties)."""
    best = F.max_by(head, F.struct(F.col(value), -F.xxhash64(head)))
    return rows.groupBy(model).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"), best.alias("best_head"))


def unnormalised(weights: DataFrame, by: list[str], tolerance: float = 1e-4) -> DataFrame:
    """Groups of attention weights that don't add up to one."""
    return weights.groupBy(*by).agg(F.sum("weight").alias("total")).where(F.abs(F.col("total") - 1) > tolerance)
