"""Problem 3: per source, the score cutoff that keeps a target fraction of its records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions.hashing import md5_int
from quernel.operators.selection import query_score
from quernel.session import cut
from quernel.sources.tables import latest

TIE_BITS = 48
#: Sources that are handled at once: their brackets come to the driver and are broadcast. More of them are done in blocks.
MOST_SOURCES = 20_000


def ranked_keys(docs: DataFrame) -> DataFrame:
    """``row_id, source, score, tie, key``, a row a record. Only numbers are shuffled, never texts.

    ``key`` orders by score and then by a hash of the id, so that no two records of a source compare equal
    (but for 48-bit collisions, which the row id settles).
    """
    scored = docs.select("row_id", "loaded_at", "source", query_score(F.col("text")).alias("score"))
    one = latest(scored, "row_id", ["source", "score"]).where(F.col("source").isNotNull())
    tie = md5_int(F.coalesce(F.col("row_id").cast("string"), F.lit("")), 1, 12)
    return one.withColumn("tie", tie).withColumn(
        "key", F.col("score").cast("long") * F.lit(1 << TIE_BITS) + F.col("tie")
    )


def source_cutoffs(docs: DataFrame, targets: DataFrame, accuracy: int = 2000, sort_at_most: int = 500_000) -> DataFrame:
    """For every row of ``targets (source, keep_frac)``: the cutoff that keeps ``ceil(keep_frac * n)`` records.

    A quantile sketch of each source gives a bracket around the target rank. Records above the bracket are only
    counted; if the counts show that the target lies outside, that side is opened up again, so the result never
    depends on the sketch being right. Brackets are narrowed by further sketches until each holds at most
    ``sort_at_most`` records, and only those are sorted. A hot source thus never comes to one task as a whole.

    Columns: ``source, keep_frac, n_records, n_target, cutoff_score, cutoff_tie, n_above, n_at, n_kept`` where a
    record is kept if its score exceeds ``cutoff_score`` or equals it with a ``tie`` of ``cutoff_tie`` or more.
    A source without records, or with a target of no records, has null cutoffs and keeps 0. Sources of ``docs``
    that have no target are left out. A null or negative ``keep_frac`` keeps none, one above 1 keeps all. If
    ``targets`` names a source twice, the larger fraction holds. Extra columns are ignored.
    """
    wanted = targets.groupBy("source").agg(F.max("keep_frac").alias("keep_frac")).where(F.col("source").isNotNull())
    keys = cut(ranked_keys(docs).join(wanted.select("source"), "source", "left_semi").select("source", "score", "key", "row_id"))
    blocks = -(-wanted.count() // MOST_SOURCES)
    if blocks <= 1:
        return _cutoffs(keys, wanted, accuracy, sort_at_most)
    block = F.pmod(F.xxhash64("source"), F.lit(blocks))
    parts = [_cutoffs(keys.where(block == i), wanted.where(block == i), accuracy, sort_at_most) for i in range(blocks)]
    return reduce(DataFrame.unionByName, parts)


def _cutoffs(keys: DataFrame, wanted: DataFrame, accuracy: int, sort_at_most: int) -> DataFrame:
    spark = keys.sparkSession
    rows = {r["source"]: r["n"] for r in keys.groupBy("source").agg(F.count("*").alias("n")).collect()}
    need = {}
    for r in wanted.collect():  # a row for each configured source
        n, frac = rows.get(r["source"], 0), min(1.0, max(0.0, r["keep_frac"] or 0.0))
        need[r["source"]] = (n, -int(-round(frac * n, 6) // 1))

    # (lo, hi, above): the wanted key is in [lo, hi], above which there are `above` keys
    low, high = 0, 12 << TIE_BITS
    state = {s: (low, high, 0, n) for s, (n, k) in need.items() if k > 0}
    error = 2.0 / accuracy
    wide = dict(state)  # the first sketch is taken of every source
    while wide:
        bounds = spark.createDataFrame([(s, v[0], v[1]) for s, v in wide.items()], "source string, lo long, hi long")
        inside_now = keys.join(F.broadcast(bounds), "source").where(F.col("key").between(F.col("lo"), F.col("hi")))
        grid = [i / 1000 for i in range(1001)]
        sketch = inside_now.groupBy("source").agg(F.percentile_approx("key", grid, accuracy).alias("q")).collect()
        narrowed = []
        for r in sketch:
            lo, hi, above, inside = wide[r["source"]]
            q_lo, q_hi = _fractions(need[r["source"]][1] - above, inside, error)
            a = r["q"][max(0, int(q_lo * 1000) - 1)] if q_lo > 0 else lo
            b = r["q"][min(1000, int(q_hi * 1000) + 2)] if q_hi < 1 else hi
            narrowed.append((r["source"], lo, hi, a, b))
        counts = (
            keys.join(F.broadcast(spark.createDataFrame(narrowed, "source string, lo long, hi long, a long, b long")), "source")
            .where(F.col("key").between(F.col("lo"), F.col("hi")))
            .groupBy("source", "lo", "hi", "a", "b")
            .agg(F.count_if(F.col("key") > F.col("b")).alias("over"), F.count_if(F.col("key").between(F.col("a"), F.col("b"))).alias("mid"))
            .collect()
        )
        moved = False
        for r in counts:
            s, k = r["source"], need[r["source"]][1]
            _, _, above, inside = state[s]
            if k <= above + r["over"]:
                new = (r["b"] + 1, r["hi"], above, r["over"])
            elif k <= above + r["over"] + r["mid"]:
                new = (r["a"], r["b"], above + r["over"], r["mid"])
            else:
                new = (r["lo"], r["a"] - 1, above + r["over"] + r["mid"], inside - r["over"] - r["mid"])
            moved = moved or new[3] < inside
            state[s] = new
        wide = {s: v for s, v in state.items() if v[3] > sort_at_most} if moved else {}  # else only equal keys are left

    plan = spark.createDataFrame(
        [(s, lo, hi, need[s][1] - above) for s, (lo, hi, above, _) in state.items()] or [("", 1, 0, 0)],
        "source string, lo long, hi long, rank_wanted long",
    )
    order = Window.partitionBy("source").orderBy(F.desc("key"), F.col("row_id"))
    at = (
        keys.join(F.broadcast(plan), "source")
        .where(F.col("key").between(F.col("lo"), F.col("hi")))
        .withColumn("r", F.row_number().over(order))
        .where(F.col("r") == F.col("rank_wanted"))
        .select("source", F.col("key").alias("cut_key"), F.col("score").alias("cutoff_score"))
    )
    sizes = (
        keys.join(F.broadcast(at), "source", "left")
        .groupBy("source")
        .agg(
            F.count("*").alias("n_records"),
            F.count_if(F.col("score") > F.col("cutoff_score")).alias("n_above"),
            F.count_if(F.col("score") == F.col("cutoff_score")).alias("n_at"),
            F.count_if(F.col("key") >= F.col("cut_key")).alias("n_kept"),
            F.max("cut_key").alias("cut_key"),
            F.max("cutoff_score").alias("cutoff_score"),
        )
    )
    target = spark.createDataFrame([(s, k) for s, (_, k) in need.items()] or [(None, 0)], "source string, n_target long")
    zero = F.lit(0).cast("long")
    return (
        wanted.join(F.broadcast(target), "source")
        .join(sizes, "source", "left")
        .select(
            "source",
            "keep_frac",
            F.coalesce("n_records", zero).alias("n_records"),
            "n_target",
            "cutoff_score",
            (F.col("cut_key") % F.lit(1 << TIE_BITS)).alias("cutoff_tie"),
            F.coalesce("n_above", zero).alias("n_above"),
            F.coalesce("n_at", zero).alias("n_at"),
            F.coalesce("n_kept", zero).alias("n_kept"),
        )
    )


def _fractions(rank_from_top: int, inside: int, error: float) -> tuple[float, float]:
    """The quantiles, from below, that certainly enclose the record of that rank if the sketch errs by ``error``."""
    at = 1 - rank_from_top / max(1, inside)
    return max(0.0, at - error - 0.001), min(1.0, at + error + 0.001)


def kept_rows(docs: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """``row_id, source, score`` of the records that ``cutoffs`` keep. ``cutoffs`` has a row a configured source."""
    c = cutoffs.where(F.col("cutoff_score").isNotNull()).select("source", "cutoff_score", "cutoff_tie")
    if c.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES:
        c = F.broadcast(c)
    s, t = F.col("score"), F.col("cutoff_score")
    return (
        ranked_keys(docs)
        .join(c, "source")
        .where((s > t) | ((s == t) & (F.col("tie") >= F.col("cutoff_tie"))))
        .select("row_id", "source", "score")
    )
