"""Distributions over scores in rows, and vectors in array columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def softmax(df: DataFrame, by: str, score: str, temperature: float = 1.0) -> DataFrame:
    w = Window.partitionBy(by)
    e = F.exp((F.col(score) - F.max(score).over(w)) / temperature)
    return df.withColumn("_e", e).withColumn("p", F.col("_e") / F.sum("_e").over(w)).drop("_e")


def top_k(df: DataFrame, by: str, score: str, tie: str, k: int) -> DataFrame:
    """Exactly ``k`` rows a group, ties by ``tie``."""
    w = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def top_p(df: DataFrame, by: str, p: str, tie: str, mass: float) -> DataFrame:
    """Rows before which less than ``mass`` is used up; the first of each group always stays."""
    w = Window.partitionBy(by).orderBy(F.desc(p), tie)
    before = F.coalesce(F.sum(p).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    d = df.withColumn("_b", F.round(before, 12)).withColumn("_r", F.row_number().over(w))
    return d.where((F.col("_b") < mass) | (F.col("_r") == 1)).drop("_b", "_r")


def inverse_cdf(df: DataFrame, by: str, p: str, order: str, u: Column) -> DataFrame:
    """Per group the first row, in ``order``, whose running share exceeds ``u``; the last one if none does."""
    w = Window.partitionBy(by)
    run = w.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_u", u * F.sum(p).over(w)).withColumn("_c", F.sum(p).over(run))
    hit = F.when(F.col("_c") > F.col("_u"), F.col(order))
    return d.groupBy(by).agg(F.coalesce(F.min(hit), F.max(order)).alias("drawn"))


def cross_entropy(df: DataFrame, by: str, score: str, is_target: Column) -> DataFrame:
    """Per group log-sum-exp less the target's score; groups without a target are left out (ignored labels)."""
    m = F.max(score).over(Window.partitionBy(by))
    d = df.withColumn("_m", m).withColumn("_t", F.when(is_target, F.col(score)))
    g = d.groupBy(by).agg((F.max("_m") + F.log(F.sum(F.exp(F.col(score) - F.col("_m"))))).alias("lse"), F.max("_t").alias("t"))
    return g.where("t IS NOT NULL").select(by, (F.col("lse") - F.col("t")).alias("loss"))


def clip_scale(df: DataFrame, value: str, most: float) -> DataFrame:
    """One row: the norm over all values and the factor that brings it down to ``most``."""
    norm = F.sqrt(F.sum(F.col(value) * F.col(value)))
    return df.agg(norm.alias("norm")).withColumn("scale", F.least(F.lit(1.0), F.lit(most) / (F.col("norm") + 1e-6)))


# ------------------------------------------------------------------------------------------------------------ vectors
def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def rms_norm(v: Column, eps: float = 1e-5) -> Column:
    scale = F.sqrt(dot(v, v) / F.size(v) + eps)
    return F.transform(v, lambda x: x.cast("double") / scale)


def cosine(a: Column, b: Column) -> Column:
    """Null if either has no length."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def silu(x: Column) -> Column:
    return x / (1 + F.exp(-x))


def rotate(v: Column, position: Column, base: float = 10_000.0) -> Column:
    """Rotary position: the halves of ``v`` are turned as pairs, each by its own frequency."""
    half = (F.size(v) / 2).cast("int")

    def angle(i: Column) -> Column:
        return position * F.pow(F.lit(base), -(2.0 * i) / F.size(v))

    a, b = F.slice(v, F.lit(1), half), F.slice(v, half + 1, half)
    first = F.zip_with(F.transform(a, lambda x, i: x.cast("double") * F.cos(angle(i))), F.transform(b, lambda x, i: x.cast("double") * F.sin(angle(i))), lambda x, y: x - y)
    second = F.zip_with(F.transform(a, lambda x, i: x.cast("double") * F.sin(angle(i))), F.transform(b, lambda x, i: x.cast("double") * F.cos(angle(i))), lambda x, y: x + y)
    return F.concat(first, second)


def matvec(rows: Column, v: Column) -> Column:
    """The product of a matrix, given as an array of rows, with a vector."""
    return F.transform(rows, lambda r: dot(r, v))


def lookup(df: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Embedding lookup: rows with the vector of their id."""
    return df.join(vectors, key, "left")
