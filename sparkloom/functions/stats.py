"""Numeric columns and aggregates: percentiles, losses, ranks, correlation, attention and sampling arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def nearest_rank(value: str, percent: float) -> Column:
    """The ceil(p n / 100)-th smallest value, an aggregate."""
    return F.expr(f"percentile_disc({percent / 100}) WITHIN GROUP (ORDER BY {value})")


def length_summary(rows: DataFrame, value: str, group: list[str] | None = None) -> DataFrame:
    """count, mean, p50, p95, p99 and max of a length; percentiles from counts by length, so no group is sorted whole."""
    counted = rows.groupBy(*(group or []), value).agg(F.count("*").alias("_n"))
    w = W.partitionBy(*(group or [F.lit(0)])).orderBy(value)
    run = counted.withColumn("_c", F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("_t", F.sum("_n").over(W.partitionBy(*(group or [F.lit(0)]))))
    at = lambda p: F.min(F.when(F.col("_c") >= F.ceil(F.col("_t") * p / 100), F.col(value)))
    return run.groupBy(*(group or [])).agg(F.sum("_n").alias("n"), (F.sum(F.col(value) * F.col("_n")) / F.sum("_n")).alias("mean"), at(50).alias("p50"), at(95).alias("p95"), at(99).alias("p99"), F.max(value).alias("longest"))


def weighted_loss(loss: str, tokens: str) -> Column:
    """Mean loss by tokens, an aggregate."""
    return F.sum(F.col(loss) * F.col(tokens)) / F.sum(tokens)


def perplexity(loss: Column) -> Column:
    return F.exp(F.least(loss, F.lit(80.0)))


def learning_rate(step: Column, total: int, warmup: int, top: float, bottom: float) -> Column:
    """Of steps from 1: linear to ``top`` at the last warm-up step, then a half cosine to ``bottom``."""
    x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (step - warmup) / F.lit(float(max(1, total - warmup)))))
    cosine = bottom + (top - bottom) * 0.5 * (1 + F.cos(F.pi() * x))
    return F.when(step <= warmup, top * step / F.lit(float(warmup))).otherwise(cosine) if warmup > 0 else cosine


def interval_means(rows: DataFrame, step: str, every: int, group: list[str], **means: str) -> DataFrame:
    """Means over each ``every`` steps: one partial aggregate."""
    out = rows.withColumn("interval", F.floor((F.col(step) - 1) / every).cast("long"))
    return out.groupBy(*group, "interval").agg(F.max(step).alias("last_step"), *[F.avg(c).alias(name) for name, c in means.items()])


def average_rank(rows: DataFrame, value: str, group: list[str], name: str = "rank", pieces: int = 64) -> DataFrame:
    """0-based ranks within a group, the mean rank for ties; computed on distinct values with their counts.

    A few large groups would be a task each, so the values are cut at approximate quantiles into ``pieces``: counts run on within a piece, and
    a piece starts from the counts of those before it, ``pieces`` rows a group.
    """
    marks = sorted(set(rows.approxQuantile(value, [i / pieces for i in range(1, pieces)], 0.01)))
    per = rows.groupBy(*group, value).agg(F.count("*").alias("_n"))
    per = per.withColumn("_piece", F.size(F.filter(F.array(*[F.lit(float(m)) for m in marks]), lambda m: m < F.col(value).cast("double"))) if marks else F.lit(0))
    totals = per.groupBy(*group, "_piece").agg(F.sum("_n").alias("_all"))
    start = F.coalesce(F.sum("_all").over(W.partitionBy(*group).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = totals.withColumn("_start", start).drop("_all")
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*group, "_piece").orderBy(value).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per = per.withColumn("_before", before).join(totals, [*group, "_piece"])
    per = per.select(*group, value, (F.col("_start") + F.col("_before") + (F.col("_n") - 1) / F.lit(2.0)).alias(name))
    return rows.join(per, [*group, value])


def pearson(x: str, y: str) -> Column:
    """Correlation, 0 where it has none; an aggregate."""
    c = F.corr(x, y)
    return F.when(c.isNull() | F.isnan(c), 0.0).otherwise(c)


def spearman(rows: DataFrame, x: str, y: str, group: list[str]) -> DataFrame:
    a = average_rank(rows, x, group, "_rx")
    return average_rank(a, y, group, "_ry").groupBy(*group).agg(pearson("_rx", "_ry").alias("spearman"))


def dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (x, y) -> cast(x as double) * cast(y as double)), 0D, (s, v) -> s + v)"


def cosine(a: str, b: str) -> Column:
    """Cosine of two array columns; 0 where one has no length."""
    return F.expr(f"coalesce({dot(a, b)} / nullif(sqrt({dot(a, a)}) * sqrt({dot(b, b)}), 0D), 0D)")


def cosine_matrix(rows: DataFrame, key: str, vector: str, most: int = 2_000) -> DataFrame:
    """(a, b, cosine) of all pairs of a few rows, ``most`` at most: a full matrix is its own size squared. More rows raise."""
    if rows.count() > most:
        raise ValueError(f"a matrix of more than {most} rows")
    a = rows.select(F.col(key).alias("a"), F.col(vector).alias("va"), F.lit(1).alias("_one"))
    b = rows.select(F.col(key).alias("b"), F.col(vector).alias("vb"), F.lit(1).alias("_one"))
    return a.join(F.broadcast(b), "_one").select("a", "b", cosine("va", "vb").alias("cosine"))


def softmax(values: str, temperature: float = 1.0) -> Column:
    """Of an array, made stable by its maximum; at temperature 0 the first maximum has it all."""
    if temperature == 0:
        return F.expr(f"transform({values}, (x, i) -> IF(i = array_position({values}, array_max({values})) - 1, 1D, 0D))")
    e = f"transform({values}, x -> exp((cast(x as double) - array_max({values})) / {temperature}D))"
    return F.expr(f"transform(array({e}), e -> transform(e, x -> x / aggregate(e, 0D, (s, v) -> s + v)))[0]")


def draw(probabilities: str, u: str) -> Column:
    """The 0-based index where the running sum first passes u; the last one if rounding leaves u over."""
    step = f"named_struct('s', a.s + p, 'i', IF(a.i < 0 AND {u} < a.s + p, a.n, a.i), 'n', a.n + 1)"
    return F.expr(f"aggregate({probabilities}, named_struct('s', 0D, 'i', -1, 'n', 0), (a, p) -> {step}, a -> IF(a.i < 0, a.n - 1, a.i))")


def entropy(probabilities: str) -> Column:
    """Shannon entropy over the log of the length: 0 for one-hot, 1 for uniform."""
    return F.expr(f"IF(size({probabilities}) < 2, 0D, aggregate({probabilities}, 0D, (s, p) -> s - IF(p > 0, p * ln(p), 0D)) / ln(size({probabilities})))")


def rms(value: str) -> Column:
    return F.sqrt(F.avg(F.col(value) * F.col(value)))


def causal_attention(scores: DataFrame, group: list[str]) -> DataFrame:
    """(group, q, k, weight): softmax of ``score`` over keys up to the query; a group's row is one query."""
    rows = scores.where("k <= q")
    w = W.partitionBy(*group, "q")
    e = F.exp(F.col("score") - F.max("score").over(w))
    return rows.withColumn("_e", e).withColumn("weight", F.col("_e") / F.sum("_e").over(w)).drop("_e", "score")


def attention_rollout(weights: DataFrame, layers: int, by: list[str] | None = None) -> DataFrame:
    """(by, q, k, weight) of the product of row-normalised (A + I) over layers 0..n-1; weights: (by, layer, q, k, weight), heads averaged."""
    by = by or []
    eye = weights.select(*by, "layer", "q").distinct().select(*by, "layer", "q", F.col("q").alias("k"), F.lit(1.0).alias("weight"))
    a = weights.unionByName(eye).groupBy(*by, "layer", "q", "k").agg(F.sum("weight").alias("w"))
    a = a.withColumn("w", F.col("w") / F.sum("w").over(W.partitionBy(*by, "layer", "q")))
    out = a.where("layer = 0").select(*by, "q", "k", "w")
    for layer in range(1, layers):
        left = a.where(f"layer = {layer}").select(*by, "q", F.col("k").alias("m"), F.col("w").alias("u"))
        out = left.join(out.select(*by, F.col("q").alias("m"), "k", "w"), [*by, "m"]).groupBy(*by, "q", "k").agg(F.sum(F.col("u") * F.col("w")).alias("w"))
    return out.withColumnRenamed("w", "weight")


def region_mass(weights: DataFrame, regions: DataFrame, by: list[str]) -> DataFrame:
    """(by, region, mass, n, expected, ratio) of attention (by, k, weight) on regions (region, k): share, size, share if uniform, ratio.

    Regions label positions of a prompt, a small table."""
    n = weights.select(*by, "k").distinct().groupBy(*by).agg(F.count("*").alias("keys"))
    hit = weights.join(regions, "k").groupBy(*by, "region").agg(F.sum("weight").alias("mass"), F.countDistinct("k").alias("n"))
    out = hit.join(n, by).withColumn("expected", F.col("n") / F.col("keys"))
    return out.withColumn("ratio", F.col("mass") / F.col("expected")).drop("keys")


def top_hits(weights: DataFrame, by: list[str], n: int) -> DataFrame:
    """The n largest weights of each group, with their ``place``; ties by key."""
    return weights.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("weight"), "k"))).where(F.col("place") <= n)


def conditional_mean(value: str, condition: str) -> Column:
    """A mean with its own denominator; null without a row."""
    return F.sum(F.when(F.expr(condition), F.col(value))) / F.nullif(F.count_if(F.expr(condition)), F.lit(0))


def kl_divergence(p: str, q: str) -> Column:
    return F.expr(f"aggregate(zip_with({p}, {q}, (x, y) -> IF(x > 0, x * ln(x / y), 0D)), 0D, (s, v) -> s + v)")


def logit_metrics(a: str, b: str) -> dict[str, Column]:
    """How two logit arrays differ: greatest, mean and rms absolute difference, same best index, margin of the best of a, the best five's indices and how many of b's are among them."""
    d = f"zip_with({a}, {b}, (x, y) -> abs(cast(x as double) - cast(y as double)))"
    places = lambda v: f"sort_array(transform({v}, (x, i) -> named_struct('v', -cast(x as double), 'i', i)))"
    order, five = places(a), lambda v: f"transform(slice({places(v)}, 1, 5), x -> x.i)"
    return {
        "max_diff": F.expr(f"array_max({d})"),
        "mean_diff": F.expr(f"aggregate({d}, 0D, (s, v) -> s + v) / size({a})"),
        "rms_diff": F.expr(f"sqrt(aggregate({d}, 0D, (s, v) -> s + v * v) / size({a}))"),
        "same_top": F.expr(f"array_position({a}, array_max({a})) = array_position({b}, array_max({b}))"),
        "margin": F.expr(f"{order}[1].v - {order}[0].v"),
        "top5": F.expr(five(a)),
        "top5_kept": F.expr(f"size(array_intersect({five(a)}, {five(b)}))"),
    }


def unpack_nibbles(packed: str, order: tuple[int, ...] = (0, 4, 1, 5, 2, 6, 3, 7)) -> Column:
    """Eight 4-bit numbers of each packed int, nibble j of the result from nibble order[j] of the int."""
    at = ", ".join(str(4 * o) for o in order)
    return F.expr(f"flatten(transform({packed}, v -> transform(array({at}), s -> cast(shiftright(v, s) & 15 as int))))")


def dequantise(values: str, zeros: str, scales: str, group: int) -> Column:
    """(value - zero) * scale, one zero and scale for each ``group`` values."""
    return F.expr(f"transform({values}, (v, i) -> (v - {zeros}[cast(i div {group} as int)]) * {scales}[cast(i div {group} as int)])")


def parameter_count(vocabulary: Column, width: Column, layers: Column, inner: Column) -> Column:
    """Of a decoder with tied embeddings, four square projections, a gated feed-forward of three and two norms a layer, and a last norm."""
    return vocabulary * width + layers * (4 * width * width + 3 * width * inner + 2 * width) + width


def pad_and_mask(ids: str, start: str, length: int, pad: int, ignore: int = -100) -> dict[str, Column]:
    """Right-padded ids, labels that ignore what lies before ``start`` and the padding, and the attention mask."""
    return {
        "input_ids": F.expr(f"concat({ids}, array_repeat({pad}, greatest(0, {length} - size({ids}))))"),
        "labels": F.expr(f"concat(transform({ids}, (x, i) -> IF(i < {start}, {ignore}, x)), array_repeat({ignore}, greatest(0, {length} - size({ids}))))"),
        "mask": F.expr(f"concat(array_repeat(1, size({ids})), array_repeat(0, greatest(0, {length} - size({ids}))))"),
    }
