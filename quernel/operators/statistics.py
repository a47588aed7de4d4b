"""Paired statistics of systems that answered the same questions."""

from __future__ import annotations

import math
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.session import cut


def mean_std(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and sample deviation, 0 for a single value."""
    return df.groupBy(*by).agg(
        F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("std")
    )


def paired(long: DataFrame, a: str, b: str, system: str = "system", item: str = "item_id", value: str = "correct") -> DataFrame:
    """``item, a, b``: the outcomes of two systems on the items that both answered."""
    return (
        long.where(F.col(system).isin(a, b)).groupBy(item)
        .agg(F.max(F.when(F.col(system) == a, F.col(value))).alias("a"), F.max(F.when(F.col(system) == b, F.col(value))).alias("b"))
        .where("a IS NOT NULL AND b IS NOT NULL")
    )


def log_factorial(n: Column) -> Column:
    """By Stirling's series from 32 on, where four terms are exact to the last digits, else by the product."""
    x = F.greatest(n, F.lit(32)).cast("double")
    series = x * F.log(x) - x + 0.5 * F.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, F.lit(5.0)))
    small = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(n, F.lit(1)), F.lit(32)).cast("int")), F.lit(0.0), lambda s, i: s + F.log(i.cast("double")))
    return F.when(n >= 32, series).otherwise(small)


def mcnemar(pairs: DataFrame) -> DataFrame:
    """``only_a, only_b, p, log_p``: discordant counts and the exact two-sided binomial chance (1 without discordant
    pairs). ``p`` is 0 only below the smallest double; its natural logarithm is not.

    The tail is summed downwards from its largest term. Terms fall like a normal density, so those further than 40
    deviations away, which are not summed, cannot change a digit.
    """
    c = pairs.agg(F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_a"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("only_b"))
    n, k = F.col("only_a") + F.col("only_b"), F.least("only_a", "only_b")
    top = log_factorial(n) - log_factorial(k) - log_factorial(n - k) - n * math.log(2.0)
    steps = F.least(k, (20 * F.sqrt(n.cast("double")) + 50).cast("long"))
    tail = F.aggregate(
        F.sequence(F.lit(0).cast("long"), steps),
        F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda s, i: F.struct((s["term"] * (k - i) / (n - k + i + 1)).alias("term"), (s["sum"] + s["term"]).alias("sum")),
    )["sum"]
    log_p = F.when(n == 0, 0.0).otherwise(F.least(F.lit(0.0), math.log(2.0) + top + F.log(tail)))
    return c.withColumn("log_p", log_p).withColumn("p", F.exp("log_p")).select("only_a", "only_b", "p", "log_p")


def resampled_means(values: DataFrame, value: str, n_boot: int, seed: int = 0, buckets: int = 256) -> DataFrame:
    """``resample, mean`` of ``n_boot`` resamples of as many values as there are; no rows without values.

    Equal values are counted first. How often a resample draws from each of ``buckets`` fixed groups of values is
    multinomial, and so is, given that, how often it draws each value of a group; so every group is drawn in a task of
    its own, and only sums are brought together. Nothing is collected but the size of each group. Each group draws from
    its own stream of the seed, so the result does not depend on the number of tasks.
    """
    x = values.select(F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    counted = x.groupBy("v").agg(F.count("*").alias("c")).withColumn("bucket", F.pmod(F.xxhash64("v"), F.lit(buckets)).cast("int"))
    counted = cut(counted)
    sizes = {r["bucket"]: r["c"] for r in counted.groupBy("bucket").agg(F.sum("c").alias("c")).collect()}  # one a bucket
    n = sum(sizes.values())
    names = sorted(sizes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf["bucket"].iloc[0])
        mine = names.index(k)
        share = np.array([sizes[b] for b in names], dtype=float) / n
        drawn = np.random.default_rng([seed, buckets]).multinomial(n, share, n_boot)[:, mine]
        pdf = pdf.sort_values("v")
        v, p = pdf["v"].to_numpy(), pdf["c"].to_numpy(dtype=float)
        rng, p = np.random.default_rng([seed, k]), p / p.sum()
        sums = np.array([rng.multinomial(m, p) @ v for m in drawn])
        return pd.DataFrame({"resample": np.arange(n_boot), "part": sums})

    parts = counted.groupBy("bucket").applyInPandas(run, "resample long, part double")
    # in one order, so that the sums are the same to the last digit
    total = F.aggregate(F.array_sort(F.collect_list("part")), F.lit(0.0), lambda a, b: a + b)  # one a bucket
    return parts.groupBy("resample").agg((total / F.lit(float(max(1, n)))).alias("mean"))


def bootstrap_interval(values: DataFrame, value: str, n_boot: int = 10_000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """One row ``mean, low, high``, null without values: sorted resampled means at fixed places, without interpolation."""
    means = resampled_means(values, value, n_boot, seed).agg(F.sort_array(F.collect_list("mean")).alias("m"))  # n_boot numbers
    at = lambda i: F.try_element_at("m", F.lit(i + 1))
    return values.agg(F.avg(value).alias("mean")).crossJoin(means).select(
        "mean", at(int(alpha / 2 * n_boot)).alias("low"), at(int((1 - alpha / 2) * n_boot) - 1).alias("high")
    )


def paired_bootstrap(pairs: DataFrame, n_boot: int = 10_000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """One row ``diff, low, high, p`` for ``a - b``, null without pairs: p is the share of resampled differences as far from the mean as 0 is."""
    d = pairs.select((F.col("a").cast("int") - F.col("b").cast("int")).alias("d"))
    m = resampled_means(d, "d", n_boot, seed).agg(F.sort_array(F.collect_list("mean")).alias("m"))
    at = lambda i: F.try_element_at("m", F.lit(i + 1))
    far = F.size(F.filter("m", lambda x: F.abs(x - F.col("diff")) >= F.abs(F.col("diff")))) / n_boot
    return d.agg(F.avg("d").alias("diff")).crossJoin(m).select(
        "diff", at(int(alpha / 2 * n_boot)).alias("low"), at(int((1 - alpha / 2) * n_boot) - 1).alias("high"), F.greatest(far, F.lit(1 / n_boot)).alias("p")
    )


def wilson(successes: Column, n: Column, z: float = 1.959964) -> Column:
    """``struct(low, high)`` of a share."""
    p, z2 = successes / n, z * z
    mid, half = (p + z2 / (2 * n)) / (1 + z2 / n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return F.struct(F.round(mid - half, 6).alias("low"), F.round(mid + half, 6).alias("high"))


def comparisons(long: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Per declared pair of systems the common items, the difference and the discordant counts; one pass over ``long``."""
    t = long.sparkSession.createDataFrame(pairs, "sys_a string, sys_b string")
    a = long.select(F.col("system").alias("sys_a"), "item_id", F.col("correct").alias("a"))
    b = long.select(F.col("system").alias("sys_b"), "item_id", F.col("correct").alias("b"))
    j = a.join(F.broadcast(t), "sys_a").join(b, ["sys_b", "item_id"])
    return j.groupBy("sys_a", "sys_b").agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("a") - F.col("b")), 6).alias("diff"),
        F.count_if((F.col("a") == 1) & (F.col("b") == 0)).alias("only_a"), F.count_if((F.col("a") == 0) & (F.col("b") == 1)).alias("only_b"),
    )
