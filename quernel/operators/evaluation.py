"""Scores of predicted statements, kinds of failure, accuracy tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Kinds of failure in their order of report.
CATEGORIES = [
    "invalid", "select column", "aggregation", "condition column", "operator", "value",
    "missing condition", "extra condition", "multiple", "other",
]


def normalize_sql(sql: Column) -> Column:
    """For exact comparison: trimmed, without a last semicolon, white space collapsed, lower case."""
    t = F.regexp_replace(sql, r"(?U)^\s+|\s+$", "")
    t = F.regexp_replace(F.regexp_replace(t, r";+$", ""), r"(?U)\s+", " ")
    return F.lower(F.regexp_replace(t, r"^ | $", ""))


def scores(df: DataFrame) -> DataFrame:
    """One row: ``n`` and the shares of ``valid``, ``correct`` and ``exact`` rows, 0 without rows."""
    share = lambda c: F.coalesce(F.round(F.avg(F.coalesce(F.col(c).cast("int"), F.lit(0))), 6), F.lit(0.0)).alias(c)
    return df.agg(F.count("*").alias("n"), share("valid"), share("correct"), share("exact"))


def _sorted(conds: Column) -> Column:
    return F.array_sort(F.transform(conds, lambda c: F.struct(c["col_ix"].alias("c"), c["op"].alias("o"), F.lower(F.regexp_replace(c["val"], r"(?U)^\s+|\s+$", "")).alias("v"))))


def diagnose(pred: Column, gold: Column) -> Column:
    """Kind of failure of ``pred`` against ``gold``, both ``struct(sel, agg, conds)``; ``invalid`` if ``pred`` has no
    ``sel``, null if they have one structure. Conditions are compared in sorted order, values without case."""
    p, g = _sorted(pred["conds"]), _sorted(gold["conds"])
    np_, ng = F.size(p), F.size(g)
    pairs = F.zip_with(
        g, p,
        lambda a, b: F.when(a["c"] != b["c"], "condition column").when(a["o"] != b["o"], "operator").when(a["v"] != b["v"], "value"),
    )
    subset = lambda a, b: F.size(F.array_except(a, b)) == 0
    where = (
        F.when(p == g, F.array().cast("array<string>"))
        .when((np_ < ng) & subset(p, g), F.array(F.lit("missing condition")))
        .when((np_ > ng) & subset(g, p), F.array(F.lit("extra condition")))
        .when(np_ == ng, F.filter(pairs, lambda x: x.isNotNull()))
        .otherwise(F.array(F.lit("multiple")))
    )
    head = F.array_compact(F.array(F.when(pred["sel"] != gold["sel"], "select column"), F.when(pred["agg"] != gold["agg"], "aggregation")))
    wrong = F.array_distinct(F.concat(head, where))
    found = F.when(F.size(wrong) == 1, F.get(wrong, F.lit(0))).when(F.size(wrong) > 1, F.lit("multiple"))
    return F.when(pred["sel"].isNull(), F.lit("invalid")).otherwise(found)


def failure_summary(df: DataFrame, category: str = "category", correct: str = "correct") -> DataFrame:
    """``category, n, share`` of the wrong rows in report order, zeros included; wrong rows of equal structure are
    ``other``. The row ``right but different`` counts correct rows with another structure."""
    spark = df.sparkSession
    kinds = spark.createDataFrame(list(enumerate([*CATEGORIES, "right but different"])), "ix int, category string")
    wrong = ~F.col(correct)
    kind = F.when(wrong, F.coalesce(F.col(category), F.lit("other"))).when(F.col(category).isNotNull(), F.lit("right but different"))
    n = df.select(kind.alias("category"), wrong.cast("int").alias("w")).where("category IS NOT NULL").groupBy("category").agg(F.count("*").alias("n"), F.sum("w").alias("w"))
    all_ = F.sum("w").over(Window.partitionBy())
    return (
        F.broadcast(kinds).join(n, "category", "left")
        .select("ix", "category", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce(F.round(F.col("w") / all_, 6), F.lit(0.0)).alias("share"))
    )


def by_conditions(df: DataFrame, conds: str = "conds", correct: str = "correct") -> DataFrame:
    return df.groupBy(F.size(conds).alias("k")).agg(F.count("*").alias("n"), F.round(F.avg(F.col(correct).cast("int")), 6).alias("accuracy"))


def components(pred: Column, gold: Column) -> list[Column]:
    """Whether the select column, the aggregate, the condition columns and the whole WHERE agree."""
    cols = lambda s: F.array_sort(F.transform(s["conds"], lambda c: c["col_ix"]))
    no = F.lit(False)
    return [
        F.coalesce(pred["sel"] == gold["sel"], no).alias("select_ok"),
        F.coalesce(pred["agg"] == gold["agg"], no).alias("aggregate_ok"),
        F.coalesce(cols(pred) == cols(gold), no).alias("columns_ok"),
        F.coalesce(_sorted(pred["conds"]) == _sorted(gold["conds"]), no).alias("where_ok"),
    ]


def logical_form(pred: Column, gold: Column) -> Column:
    """Equal structure, conditions in any order."""
    return F.coalesce((pred["sel"] == gold["sel"]) & (pred["agg"] == gold["agg"]) & (_sorted(pred["conds"]) == _sorted(gold["conds"])), F.lit(False))


def misaligned(preds: DataFrame, items: DataFrame, key: str, same: str) -> DataFrame:
    """Rows that have no partner, or one of another ``same``; empty if the sides are aligned."""
    p, i = preds.select(key, F.col(same).alias("pred_side"), F.lit(1).alias("p")), items.select(key, F.col(same).alias("item_side"), F.lit(1).alias("i"))
    j = p.join(i, key, "full")
    return j.where(F.col("p").isNull() | F.col("i").isNull() | ~F.col("pred_side").eqNullSafe(F.col("item_side"))).select(key, "pred_side", "item_side")


def length_batches(df: DataFrame, length: Column, order: str, most: int = 64) -> DataFrame:
    """``batch`` within rows of equal length, at most ``most`` rows each."""
    w = Window.partitionBy("length").orderBy(order)
    return df.withColumn("length", length).withColumn("batch", F.ceil(F.row_number().over(w) / most))
