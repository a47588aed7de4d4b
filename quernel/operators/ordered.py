"""Windows and medians over groups of any size, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block in which one task evaluates a window.
BLOCK_ROWS = 1_000_000


def in_blocks(df: DataFrame, by: str, order: str, before: int, after: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """``df`` with ``_block``, a part of the group ``by`` along the number ``order``, and ``_halo``.

    Every block also has, marked by ``_halo``, the ``before`` rows ahead of it and the ``after`` rows behind it, so a
    window of that reach over ``by, _block`` sees what a window over ``by`` would; drop the halo afterwards. A group is
    cut into strips of equal width with ``rows`` rows on average. Only the rows at the strips' ends are ordered within
    a whole group. Rows without ``order`` come first. ``order`` is unique within a group, or ties are as undefined as in a window.
    """
    names = df.columns
    width = F.greatest(F.lit(1.0), (F.max(order) - F.min(order) + 1) / F.ceil(F.count("*") / rows))
    spans = df.groupBy(by).agg(F.min(order).alias("_least"), width.alias("_wide")).withColumnRenamed(by, "_by")
    cut = df.join(spans, F.col(by).eqNullSafe(F.col("_by")))
    cut = cut.withColumn("_block", F.coalesce(F.floor((F.col(order) - F.col("_least")) / F.col("_wide")), F.lit(-1))).select(*names, "_block")
    reach = max(before, after)
    inner = Window.partitionBy(by, "_block")
    ends = cut.withColumn("_up", F.row_number().over(inner.orderBy(order))).withColumn("_down", F.row_number().over(inner.orderBy(F.desc(order))))
    ends = ends.where((F.col("_up") <= reach) | (F.col("_down") <= reach))
    row = F.struct(*names)
    whole = Window.partitionBy(by).orderBy("_block", order)
    none = F.array().cast(f"array<{ends.select(row.alias('r')).schema['r'].dataType.simpleString()}>")
    ahead = F.collect_list(row).over(whole.rowsBetween(-before, -1)) if before else none
    behind = F.collect_list(row).over(whole.rowsBetween(1, after)) if after else none
    met = F.concat(F.when(F.col("_up") == 1, ahead).otherwise(none), F.when(F.col("_down") == 1, behind).otherwise(none))
    halo = ends.select("_block", met.alias("_met")).select("_block", F.explode("_met").alias("_row"))
    halo = halo.select(*[F.col("_row").getField(n).alias(n) for n in names], "_block", F.lit(True).alias("_halo"))
    return cut.withColumn("_halo", F.lit(False)).unionByName(halo)


def upper_medians(df: DataFrame, by: str, value: str) -> DataFrame:
    """``by, median``: of each group the element at place ``floor(n / 2)`` from 0 of its sorted values, exactly.

    A sketch of the group, merged map-side, brackets the place within guaranteed bounds; values outside of the bracket are
    counted and only those inside are ordered, equal ones as one. Null values do not count.
    """
    d = df.where(F.col(value).isNotNull()).select(F.col(by).alias("_g"), F.col(value).alias("_v"))
    accuracy = 10_000
    edge = 2.5 / accuracy
    spans = d.groupBy("_g").agg(
        F.count("*").alias("_n"), F.percentile_approx("_v", F.array(F.lit(0.5 - edge), F.lit(0.5 + edge)), F.lit(accuracy)).alias("_p")
    ).select(F.col("_g").alias("_by"), "_n", F.col("_p")[0].alias("_low"), F.col("_p")[1].alias("_high"))
    j = d.join(spans, F.col("_g").eqNullSafe(F.col("_by")))
    place = F.when(F.col("_v") < F.col("_low"), F.lit(None)).otherwise(F.col("_v"))
    counted = j.where("_v <= _high").groupBy("_g", "_n", place.alias("_v")).agg(F.count("*").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy("_g").orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0))
    hit = counted.withColumn("_u", upto).where(F.col("_v").isNotNull() & (F.col("_u") > F.floor(F.col("_n") / 2)))
    return hit.groupBy("_g").agg(F.min("_v").alias("median")).select(F.col("_g").alias(by), "median")
