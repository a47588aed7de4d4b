"""Query-feature score, threshold selection, hash split, repetition, summaries."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.functions.hashing import md5_int
from quernel.functions.text import NOT_WORD, WORD

# The query features, one pattern each; the score is the number of features present.
KEYWORDS = ["select", "from", "where", "join", "having", "limit", "union"]
PHRASES = [r"group\s+by", r"order\s+by"]
AGGREGATES = r"(?:count|sum|avg|min|max)\s*\("
COMMON_TABLE = rf"with\s+{WORD}\s+as\s*\("

_BEGIN, _END = rf"(?:^|{NOT_WORD})", rf"(?:$|{NOT_WORD})"
#: Of each feature the plain strings of which one must occur in the lower-case text, and the pattern.
FEATURES = (
    [([k], f"{_BEGIN}{k}{_END}") for k in KEYWORDS]
    + [([p.split("\\")[0]], f"{_BEGIN}{p}{_END}") for p in PHRASES]
    + [(["count", "sum", "avg", "min", "max"], f"{_BEGIN}{AGGREGATES}"), (["with"], f"{_BEGIN}{COMMON_TABLE}")]
)


def query_score(text: Column) -> Column:
    """0..11: how many distinct query features ``text`` has; 0 for null or empty text.

    A pattern is tried only on texts that contain one of its words, which is a much cheaper search.
    """
    t = F.lower(F.coalesce(text, F.lit("")))

    def has(words: list[str], pattern: str) -> Column:
        return (reduce(lambda a, b: a | b, [F.contains(t, F.lit(w)) for w in words]) & t.rlike(pattern)).cast("int")

    return reduce(lambda a, b: a + b, [has(*f) for f in FEATURES])


def histogram(scored: DataFrame, score: str = "score") -> DataFrame:
    return scored.groupBy(score).agg(F.count("*").alias("n"))


def threshold(hist: DataFrame, keep_frac: float, score: str = "score") -> DataFrame:
    """``score, tie_p``: the score at which the running count from above reaches ``keep_frac`` of all, and the share of
    that score to keep. One row; none if ``hist`` is empty. The histogram has a row a score, twelve at most."""
    w = Window.orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    need = F.lit(keep_frac) * F.sum("n").over(Window.partitionBy())
    h = hist.withColumn("upto", F.sum("n").over(w)).withColumn("need", need).where(F.col("upto") >= F.col("need"))
    return h.orderBy(F.desc(score)).limit(1).select(
        F.col(score).alias("cut_score"), ((F.col("need") - (F.col("upto") - F.col("n"))) / F.greatest("n", F.lit(1))).alias("tie_p")
    )


def keep_by_threshold(scored: DataFrame, cut: DataFrame, text: str = "text", score: str = "score") -> DataFrame:
    """Rows above the threshold, and of those at it a share chosen by a hash of the text. Equal texts go together."""
    h = md5_int(F.coalesce(F.col(text), F.lit("")), 9) % 10_000
    j = scored.crossJoin(F.broadcast(cut))  # one row
    s = F.col(score)
    return j.where((s > F.col("cut_score")) | ((s == F.col("cut_score")) & (h < F.col("tie_p") * 10_000))).drop("cut_score", "tie_p")


@F.pandas_udf(T.LongType())
def xxh64(text: pd.Series) -> pd.Series:
    """xxHash64 with seed 0 as a signed long (Spark's own uses seed 42)."""
    import xxhash

    def one(x):
        v = xxhash.xxh64_intdigest((x or "").encode("utf-8"))
        return v - (1 << 64) if v >= 1 << 63 else v

    return text.map(one)


def is_validation(text: Column, rate: float) -> Column:
    """Decided by another slice of the hash than ``keep_by_threshold`` uses."""
    return md5_int(F.coalesce(text, F.lit("")), 1) % 10_000 < F.lit(rate) * 10_000


def repeat_rows(df: DataFrame, times: Column) -> DataFrame:
    """Each row ``times`` times with ``copy`` from 1; rows with less than one are dropped."""
    return df.withColumn("_n", times).where("_n >= 1").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("_n")))).drop("_n")


def shard_summary(df: DataFrame, size: str, source: str = "source", split: str = "split") -> DataFrame:
    """Per source documents and size in each split, and the share of all training size; with a total row (null source)."""
    train, val = F.col(split) == "train", F.col(split) == "val"
    s = df.groupBy(source).agg(
        F.count_if(train).alias("docs_train"), F.count_if(val).alias("docs_val"),
        F.coalesce(F.sum(F.when(train, F.col(size))), F.lit(0)).cast("long").alias("size_train"),
        F.coalesce(F.sum(F.when(val, F.col(size))), F.lit(0)).cast("long").alias("size_val"),
    )
    total = s.agg(F.lit("all").alias(source), *[F.sum(c).cast("long").alias(c) for c in ("docs_train", "docs_val", "size_train", "size_val")])
    whole = total.select(F.col("size_train").alias("_all"))
    return s.unionByName(total).crossJoin(F.broadcast(whole)).withColumn(
        "share", F.when(F.col("_all") > 0, F.round(F.col("size_train") / F.col("_all"), 6)).otherwise(0.0)
    ).drop("_all")


def sample_to_size(df: DataFrame, key: str, size: str, target: float) -> DataFrame:
    """``role`` of each group of rows: groups in hash order are ``sample`` until their sizes reach ``target``, the next
    one is ``held_out``, the rest ``unused``. Groups are files or row groups, so the window sorts few rows."""
    g = df.groupBy(key).agg(F.sum(size).cast("long").alias("size")).withColumn("h", md5_int(F.col(key).cast("string")))
    w = Window.orderBy("h", key).rowsBetween(Window.unboundedPreceding, -1)
    g = g.withColumn("before", F.coalesce(F.sum("size").over(w), F.lit(0)))
    role = F.when(F.col("before") < target, "sample").when(F.row_number().over(Window.partitionBy(F.col("before") < target).orderBy("h", key)) == 1, "held_out").otherwise("unused")
    return g.select(key, "size", role.alias("role"))
