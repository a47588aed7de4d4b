"""Analytics of step-indexed logs and of sweeps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.operators.ordered import BLOCK_ROWS, in_blocks, upper_medians


def smooth(df: DataFrame, run: str, step: str, value: str, half: int = 4, from_step: int = 200, rows: int = BLOCK_ROWS) -> DataFrame:
    """Centred mean over ``half`` rows on either side, shorter at the ends; raw before ``from_step``. Long runs are
    smoothed in blocks of about ``rows`` rows that know their neighbours' ends."""
    d = in_blocks(df, run, step, half, half, rows)
    w = Window.partitionBy(run, "_block").orderBy(step).rowsBetween(-half, half)
    d = d.withColumn("smoothed", F.when(F.col(step) < from_step, F.col(value)).otherwise(F.avg(value).over(w)))
    return d.where(~F.col("_halo")).drop("_block", "_halo")


def summarize(df: DataFrame, run: str, step: str, loss: str, last: int = 8) -> DataFrame:
    """Per run the last step, the mean of the last losses, the largest value and the upper median. The last rows are
    picked map-side first, and the median is bracketed, so no run is ordered as a whole."""
    d = df.where(F.col(loss).isNotNull())
    w = Window.partitionBy(run).orderBy(F.desc(step))
    tail = d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last).groupBy(run).agg(F.avg(loss).alias("_tail"))
    whole = d.groupBy(run).agg(F.max(step).alias("last_step"), F.round(F.max(loss), 6).alias("max_value"))
    same = lambda x, n: x.withColumnRenamed(run, n)
    j = whole.join(same(tail, "_a"), F.col(run).eqNullSafe(F.col("_a"))).join(same(upper_medians(d, run, loss), "_b"), F.col(run).eqNullSafe(F.col("_b")))
    return j.select(run, "last_step", F.round("_tail", 6).alias("tail_mean"), "max_value", F.round("median", 6).alias("median_value"))


def weighted_score(df: DataFrame, run: str, source: str, value: str, weights: dict[str, float]) -> DataFrame:
    """Mean over the sources present, their weights renormalised."""
    t = df.sparkSession.createDataFrame(list(weights.items()), f"{source} string, w double")
    d = df.join(F.broadcast(t), source).where(F.col(value).isNotNull())
    return d.groupBy(run).agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias("score"))


def best_run(df: DataFrame, setting: str, score: str) -> DataFrame:
    """The setting of the least score, the smallest one if several; and whether it lies at the edge of the sweep."""
    return df.agg(
        F.min_by(setting, F.struct(score, setting)).alias("best"), F.min(score).alias("score"), F.min(setting).alias("_lo"), F.max(setting).alias("_hi")
    ).select("best", "score", ((F.col("best") == F.col("_lo")) | (F.col("best") == F.col("_hi"))).alias("at_edge"))


def best_setting(df: DataFrame, setting: str, value: str) -> DataFrame:
    """The highest value per setting over its epochs, then the best setting, the smallest one if several."""
    top = df.groupBy(setting).agg(F.max(value).alias("value"))
    return top.agg(F.min_by(setting, F.struct(-F.col("value"), F.col(setting))).alias("best"), F.max("value").alias("value"))


def spread(df: DataFrame, group: str, value: str, gap: float) -> DataFrame:
    """Label places in the order of ``value``, at least ``gap`` apart: the running maximum of ``value - i * gap``."""
    w = Window.partitionBy(group).orderBy(value, "label")
    i = F.row_number().over(w) - 1
    d = df.withColumn("_i", i)
    run = Window.partitionBy(group).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("place", F.max(F.col(value) - F.col("_i") * gap).over(run) + F.col("_i") * gap).drop("_i")


def throughput(df: DataFrame, run: str, step: str, seconds: Column, tokens_per_step: int, parameters: float, peak: float, rows: int = BLOCK_ROWS) -> DataFrame:
    """Tokens a second since the row before and the share of the peak arithmetic rate, ``6 N`` operations a token. Long
    runs are read in blocks that know the last row ahead of them."""
    w = Window.partitionBy(run, "_block").orderBy(step)
    d = in_blocks(df.withColumn("_s", seconds), run, step, 1, 0, rows)
    steps, dt = F.col(step) - F.lag(step).over(w), F.col("_s") - F.lag("_s").over(w)
    tps = F.when(dt > 0, tokens_per_step * steps / dt)
    d = d.withColumn("tokens_per_s", F.round(tps, 6)).withColumn("mfu", 6 * parameters * F.col("tokens_per_s") / peak)
    return d.where(~F.col("_halo")).drop("_s", "_block", "_halo")


def source_losses(df: DataFrame, source: str, loss: str) -> DataFrame:
    """``source, batches, loss``: the mean loss over the batches of each source; batches without a loss do not count,
    and a source without any has a null loss."""
    return df.groupBy(source).agg(F.count(loss).alias("batches"), F.avg(loss).alias("loss"))


def gains(df: DataFrame, row: str, column: str, value: str, columns: list[str], base: str) -> DataFrame:
    """A table with a row for each ``row`` and the mean ``value`` in each of ``columns``, and beside it what it gains
    over the column ``base``. Cells without values are null."""
    p = df.groupBy(row).pivot(column, columns).agg(F.avg(value))
    more = [F.round(F.col(f"`{c}`") - F.col(f"`{base}`"), 6).alias(f"{c}_gain") for c in columns if c != base]
    return p.select(row, *[F.round(F.col(f"`{c}`"), 6).alias(c) for c in columns], *more)


def cosine_rate(step: Column, most: int | Column, peak: float, warmup: int, least_ratio: float = 0.1) -> Column:
    """Linear warm-up, then a cosine down to ``least_ratio`` of the peak at the step ``most``."""
    last = F.lit(most) if isinstance(most, int) else most
    done = F.least(F.lit(1.0), (step - warmup) / F.greatest(F.lit(1), last - warmup))
    low = peak * least_ratio
    return F.when(step < warmup, peak * (step + 1) / warmup).otherwise(low + 0.5 * (peak - low) * (1 + F.cos(F.lit(math.pi) * done)))
