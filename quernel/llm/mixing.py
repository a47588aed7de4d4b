"""Problem 5: a mixture in which every source has its target share of the total size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions.hashing import unit
from quernel.session import cut
from quernel.sources.tables import latest

#: ``targets`` is configuration; a table beyond this many rows is joined by a shuffle instead of broadcast.
BROADCAST_ROWS = 10_000


def _sized(docs: DataFrame) -> DataFrame:
    """``row_id, source, size``, read once and kept: texts are not looked at again."""
    sized = docs.select("row_id", "loaded_at", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"))
    return cut(latest(sized, "row_id", ["source", "size"]))


def mixture_plan(docs: DataFrame, targets: DataFrame, total: float | None = None) -> DataFrame:
    """Per source of ``targets (source, mix_weight, max_repeats)`` its size and its repetition rate.

    The total is ``total`` characters, by default the largest at which no source with text must be repeated more
    than ``max_repeats`` times; with a larger total those sources are held at the cap and miss their share. Weights
    count among the sources that have text at all. Null or negative weights and caps count as 0; of a source named
    twice the row with the largest weight holds.
    """
    return _plan(_sized(docs), targets, total)


def _plan(sized: DataFrame, targets: DataFrame, total: float | None) -> DataFrame:
    t = (
        targets.where(F.col("source").isNotNull())
        .groupBy("source")
        .agg(F.max(F.struct(F.coalesce("mix_weight", F.lit(0.0)).alias("w"), F.coalesce("max_repeats", F.lit(0)).alias("m"))).alias("x"))
        .select("source", F.greatest("x.w", F.lit(0.0)).alias("mix_weight"), F.greatest("x.m", F.lit(0)).alias("max_repeats"))
    )
    sizes = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n_records"))
    p = t.join(sizes, "source", "left").select(
        "source", "mix_weight", "max_repeats",
        F.coalesce("size", F.lit(0).cast("long")).alias("size"),
        F.coalesce("n_records", F.lit(0).cast("long")).alias("n_records"),
    )
    live = (F.col("size") > 0) & (F.col("mix_weight") > 0)
    all_targets = Window.partitionBy()  # a row a configured source
    p = p.withColumn("live_weight", F.sum(F.when(live, F.col("mix_weight"))).over(all_targets)).withColumn(
        "per_weight", F.min(F.when(live, F.col("max_repeats") * F.col("size") / F.col("mix_weight"))).over(all_targets)
    )
    unit_size = F.col("per_weight") if total is None else F.lit(float(total)) / F.col("live_weight")
    rate = F.least(F.col("mix_weight") * unit_size / F.col("size"), F.col("max_repeats").cast("double"))
    return p.select(
        "source", "mix_weight", "max_repeats", "size", "n_records",
        F.when(live, F.col("mix_weight") / F.col("live_weight")).otherwise(0.0).alias("target_share"),
        F.when(live, rate).otherwise(0.0).alias("rate"),
    )


def mixture(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 0) -> DataFrame:
    """``row_id, source, size, copies``: the records of the mixture and how often each is used.

    A record is used ``floor(rate)`` times, and once more with the probability of the rate's fraction, drawn from a
    hash of its id and the ``seed``; with one seed the draw is the same in every run and on every executor, and draws
    with different seeds are independent. Records without a source, of a source
    without target, or drawn 0 times are not in the result. A text delivered twice counts once; null and empty texts
    have size 0 and are drawn like others.
    """
    sized = _sized(docs)
    return _mix(sized, targets, _plan(sized, targets, total), seed)


def _mix(sized: DataFrame, targets: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    plan = plan.select("source", "rate")
    if targets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    whole = F.floor("rate")
    name = F.coalesce(F.col("row_id").cast("string"), F.lit(""))
    extra = (unit(name if seed == 0 else F.concat(F.lit(f"{seed}:"), name), 5) < F.col("rate") - whole).cast("int")
    return (
        sized.join(plan, "source")
        .select("row_id", "source", "size", (whole + extra).cast("int").alias("copies"))
        .where(F.col("copies") > 0)
    )


def mixture_shares(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 0) -> DataFrame:
    """Per source of ``targets``: target share, rate, and the size and share that the mixture really has."""
    sized = _sized(docs)
    plan = _plan(sized, targets, total)
    got = _mix(sized, targets, plan, seed).groupBy("source").agg(
        F.sum(F.col("copies") * F.col("size")).alias("mixed_size"), F.sum("copies").alias("mixed_records")
    )
    zero = F.lit(0).cast("long")
    p = plan.join(got, "source", "left").withColumns(
        {"mixed_size": F.coalesce("mixed_size", zero), "mixed_records": F.coalesce("mixed_records", zero)}
    )
    return p.withColumn("all_size", F.sum("mixed_size").over(Window.partitionBy())).select(
        "source", "size", "mixed_records", "mixed_size",
        F.round("target_share", 6).alias("target_share"),
        F.round("rate", 6).alias("rate"),
        F.round(F.when(F.col("all_size") > 0, F.col("mixed_size") / F.col("all_size")).otherwise(0.0), 6).alias("actual_share"),
    )
