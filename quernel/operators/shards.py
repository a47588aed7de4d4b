"""Packed token shards, window draws, mix schedules."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions.hashing import unit


def offsets(df: DataFrame, shard: str, order: str, tokens: str) -> DataFrame:
    """``start, stop`` of each document in its shard; documents are followed by one end token. A shard is a bounded
    range of the input, so its window sorts a bounded number of rows."""
    w = Window.partitionBy(shard).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col(tokens) + 1).over(w)
    return df.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col(tokens) - 1)


def shard_starts(lengths: DataFrame, shard: str, tokens: str, seq_len: int) -> DataFrame:
    """``shard, starts, before, upto``: legal window starts of each shard and their running sums; shards that are too
    short for one window are dropped. There is a row a shard."""
    s = lengths.where(F.col(tokens) > seq_len + 1).withColumn("starts", F.col(tokens) - seq_len - 1)
    w = Window.orderBy(shard).rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("upto", F.sum("starts").over(w))
    return s.select(shard, "starts", (F.col("upto") - F.col("starts")).alias("before"), "upto")


def locate(draws: DataFrame, starts: DataFrame, shard: str, value: str) -> DataFrame:
    """Shard and offset of each draw in ``[0, all starts)``. ``starts`` has a row a shard.

    The space of starts is cut into as many equal strips as there are shards; a draw meets the shards of its strip by an
    equality join, so there are at most two rows a shard and no product.
    """
    w = F.broadcast(starts.agg(F.greatest(F.lit(1).cast("long"), F.ceil(F.max("upto") / F.count("*"))).alias("_wide")))  # one row
    strip = lambda c: F.floor(c / F.col("_wide"))
    parts = F.explode(F.sequence(strip(F.col("before")), strip(F.col("upto") - 1)))
    s = starts.crossJoin(w).select(shard, "before", "upto", parts.alias("_strip"))
    j = draws.crossJoin(w).withColumn("_strip", strip(F.col(value))).join(s, "_strip")
    j = j.where((F.col(value) >= F.col("before")) & (F.col(value) < F.col("upto")))
    return j.select(*draws.columns, shard, (F.col(value) - F.col("before")).alias("offset"))


def schedule_weights(progress: DataFrame, schedule: list[tuple[float, dict[str, float]]], column: str = "progress") -> DataFrame:
    """``source, weight`` in force at each progress: the first phase that ends later, else the last one."""
    phases = [(i, u, s, w) for i, (u, ws) in enumerate(schedule) for s, w in ws.items()]
    t = progress.sparkSession.createDataFrame(phases, "phase int, until double, source string, weight double")
    n = len(schedule)
    phase = F.lit(n - 1)
    for i in range(n - 1, -1, -1):
        phase = F.when(F.col(column) < schedule[i][0], F.lit(i)).otherwise(phase)
    return progress.withColumn("phase", phase).join(F.broadcast(t.drop("until")), "phase")


def average_mix(schedule: DataFrame) -> DataFrame:
    """Weights averaged over the phases' lengths. ``schedule`` has ``phase, until, source, weight``."""
    ends = schedule.select("phase", "until").distinct()
    ends = ends.withColumn("part", F.col("until") - F.coalesce(F.lag("until").over(Window.orderBy("phase")), F.lit(0.0)))
    return schedule.join(F.broadcast(ends.select("phase", "part")), "phase").groupBy("source").agg(F.round(F.sum(F.col("weight") * F.col("part")), 6).alias("weight"))


def draw_source(key: Column, weights: list[tuple[str, float]]) -> Column:
    """A source by inverse distribution function of a hash of ``key``."""
    u, total = unit(key), sum(w for _, w in weights)
    cum, expr = 0.0, None
    for s, w in weights:
        cum += w
        expr = F.when(u * total < cum, s) if expr is None else expr.when(u * total < cum, s)
    return F.coalesce(expr, F.lit(weights[-1][0]))


def windows(tokens: Column, offset: Column, seq_len: int) -> Column:
    """``struct(x, y)`` of ``seq_len`` tokens each, shifted by one."""
    return F.struct(F.slice(tokens, offset + 1, seq_len).alias("x"), F.slice(tokens, offset + 2, seq_len).alias("y"))


def packed_windows(df: DataFrame, shard: str, order: str, ids: str, end: int, seq_len: int) -> DataFrame:
    """``shard, window, x, y``: the consecutive windows of each shard, in which documents follow each other with ``end``
    behind each. ``x`` has ``seq_len`` tokens and ``y`` the ones after them; the last window of a shard may be shorter.

    Only the parts of documents that lie in a window are put together, so a group has ``seq_len + 1`` tokens.
    """
    d = df.select(F.col(shard), F.col(order), F.concat(F.col(ids), F.array(F.lit(end))).alias("_t"))
    d = offsets(d.withColumn("_n", F.size("_t") - 1), shard, order, "_n")
    span = F.sequence(F.floor(F.greatest(F.col("start") - 1, F.lit(0)) / seq_len), F.floor((F.col("stop") - 1) / seq_len))
    d = d.withColumn("window", F.explode(span))
    low = F.greatest(F.col("start"), F.col("window") * seq_len)
    high = F.least(F.col("stop"), F.col("window") * seq_len + seq_len + 1)
    part = F.slice("_t", (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
    g = d.where(high > low).groupBy(shard, "window").agg(F.array_sort(F.collect_list(F.struct(low.alias("at"), part.alias("part")))).alias("p"))
    g = g.select(shard, "window", F.flatten(F.transform("p", lambda x: x["part"])).alias("t")).where(F.size("t") > 1)
    return g.select(shard, "window", F.slice("t", F.lit(1), F.size("t") - 1).alias("x"), F.slice("t", F.lit(2), F.size("t") - 1).alias("y"))


def write_uint16(df: DataFrame, folder: str, shard: str, order: str, ids: str, end: int) -> DataFrame:
    """Writes flat little-endian uint16 files, one a shard, into a folder that all executors have mounted (a path or a
    ``file:`` address). Returns ``shard, tokens``; the files are there once it is evaluated."""
    if "://" in folder and not folder.startswith("file:"):
        raise ValueError("shard files are written through the file system")
    folder = folder.removeprefix("file://").removeprefix("file:")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import os

        import numpy as np

        name = str(pdf[shard].iloc[0])
        flat = np.concatenate([np.asarray([*x, end], dtype=np.uint16) for x in pdf.sort_values(order)[ids]])
        os.makedirs(folder, exist_ok=True)
        tmp = os.path.join(folder, f".{name}.{os.getpid()}.tmp")
        flat.tofile(tmp)
        os.replace(tmp, os.path.join(folder, f"{name}.bin"))
        return pd.DataFrame({shard: [name], "tokens": [len(flat)]})

    return df.groupBy(shard).applyInPandas(run, f"{shard} string, tokens long")


def read_uint16(spark, folder: str, seq_len: int | None = None) -> DataFrame:
    """``shard, tokens`` of such files; with ``seq_len`` only of those that hold a window, of more than that and one."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        import numpy as np

        for b in batches:
            yield pd.DataFrame(
                {
                    "shard": [os.path.basename(p)[:-4] for p in b["path"]],
                    "tokens": [np.frombuffer(c, dtype=np.uint16).astype("int32") for c in b["content"]],
                }
            )

    least = -1 if seq_len is None else 2 * (seq_len + 1)  # two bytes a token
    return files.where(F.col("length") > least).select("path", "content").mapInPandas(run, "shard string, tokens array<int>")
