"""Inputs that several queries share, made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.operators import cleaning, rendering
from quernel.sources.tables import table


def pages(spark: SparkSession, d: str) -> DataFrame:
    t = cleaning.clean_web(table(spark, d, "web_pages", "page_id", "text", "url"))
    return t


def files(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.clean_sql(table(spark, d, "sql_files", "file_id", "content", "max_stars_repo_name", "max_stars_repo_licenses"))


def threads(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.clean_thread(table(spark, d, "threads", "id", "site", "threadtext", "score", "contentlicense"))


def items(spark: SparkSession, d: str) -> DataFrame:
    """Questions with the header and types of their table and the gold statement."""
    q = rendering.with_tables(table(spark, d, "eval_questions"), table(spark, d, "table_meta"))
    return q.withColumn("gold_sql", rendering.to_sql(F.col("header"), F.col("sel"), F.col("agg"), F.col("conds")))


def prompts(spark: SparkSession, d: str) -> DataFrame:
    q = items(spark, d)
    return cleaning.format_prompt(
        q.withColumn("context", rendering.schema_text(F.col("header"), F.col("types"))), "context", "question", "gold_sql"
    )


def cleaned(spark: SparkSession, d: str) -> DataFrame:
    """All sources under the canonical columns."""
    p, f, t, g = pages(spark, d), files(spark, d), threads(spark, d), prompts(spark, d)
    empty = F.lit("")
    size = lambda c: F.length(F.coalesce(F.col(c), empty))
    licenses = F.concat(F.lit("["), F.array_join(F.col("max_stars_repo_licenses"), ", "), F.lit("]"))
    return (
        cleaning.canonical(p, "fineweb_edu", F.lit(cleaning.WEB_LICENSE), F.coalesce("url", empty), size("text"))
        .unionByName(cleaning.canonical(f, "stack_sql", licenses, F.coalesce("max_stars_repo_name", empty), size("content")))
        .unionByName(
            cleaning.canonical(t, "stackexchange", F.coalesce("contentlicense", F.lit(cleaning.THREAD_LICENSE)), F.concat("site", F.lit(":"), F.col("id").cast("string")), size("threadtext"))
        )
        .unionByName(cleaning.canonical(g, "gretel_sql", F.lit(cleaning.PROMPT_LICENSE), F.concat(F.lit("gretel:"), F.col("item_id").cast("string")), F.lit(0)))
    )


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Gold and changed statements: the rest of the id by 8 says what is changed. For exercising the scoring."""
    q = items(spark, d)
    m, n = F.col("item_id") % 8, F.size("header")
    none = F.array().cast("array<struct<col_ix:int,op:int,val:string>>")
    conds = F.coalesce("conds", none)
    extra = F.struct(((F.col("sel") + 1) % n).cast("int").alias("col_ix"), F.lit(1).alias("op"), F.lit("extra").alias("val"))
    first = lambda f: F.transform(conds, lambda c, i: F.when(i == 0, f(c)).otherwise(c))
    struct = lambda c, o, v: F.struct(c.alias("col_ix"), o.alias("op"), v.alias("val"))
    changed = (
        F.when(m == 3, first(lambda c: struct(c["col_ix"], c["op"], F.lit("changed"))))
        .when(m == 4, F.slice(conds, F.lit(1), F.greatest(F.size(conds) - 1, F.lit(0))))
        .when(m == 5, F.concat(conds, F.array(extra)))
        .when(m == 6, first(lambda c: struct(c["col_ix"], ((c["op"] + 1) % 3).cast("int"), c["val"])))
        .otherwise(conds)
    )
    sel = F.when(m == 1, ((F.col("sel") + 1) % n).cast("int")).otherwise(F.col("sel"))
    agg = F.when(m == 2, ((F.col("agg") + 1) % 6).cast("int")).otherwise(F.col("agg"))
    pred = F.when(m == 7, F.lit("SELECT nothing")).otherwise(rendering.to_sql(F.col("header"), sel, agg, changed))
    return q.withColumn("pred_sql", pred).withColumn("gold", F.struct("sel", "agg", conds.alias("conds")))


def ratings(spark: SparkSession, d: str) -> DataFrame:
    """Raters as systems, documents as items: 1 if the rater ever said unsafe."""
    t = table(spark, d, "doc_labels").where(F.col("verdict").isin("safe", "unsafe"))
    return t.groupBy(F.col("rater").alias("system"), F.col("doc_id").alias("item_id")).agg(F.max((F.col("verdict") == "unsafe").cast("int")).alias("correct"))
