"""Per-source cleaning. Each cleaner adds ``clean_text`` (null if the row is dropped) and ``reason``.

The first failing rule gives the reason; ``truncated_dump`` is the one reason of a row that is kept. A null text is
treated as empty and dropped as ``too_short``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions.text import NOT_WORD, count_matches, normalize

# Thresholds and licences of the sources.
WEB_LEAST, SQL_LEAST, THREAD_LEAST = 200, 50, 300
DUMP_CHARS, LONG_LINE = 8000, 1000
WEB_LICENSE, THREAD_LICENSE, PROMPT_LICENSE = "ODC-By", "CC BY-SA", "Apache-2.0"
STATEMENTS = "select|create|insert|update|delete|alter|drop"


def _judged(df: DataFrame, text: str, reason: Column) -> DataFrame:
    kept = reason.isNull() | (reason == "truncated_dump")
    return df.withColumn("reason", reason).withColumn("clean_text", F.when(kept, F.col(text))).drop(text)


def clean_web(df: DataFrame, text: str = "text") -> DataFrame:
    d = df.withColumn("_t", normalize(F.coalesce(F.col(text), F.lit(""))))
    t, n = F.col("_t"), F.length("_t")
    d = d.withColumn("_lines", F.filter(F.split(t, "\n"), lambda x: x.rlike(r"(?U)\S")))
    lines, distinct = F.size("_lines"), F.size(F.array_distinct("_lines"))
    reason = (
        F.when(n < WEB_LEAST, "too_short")
        .when(count_matches(t, "�") / n > 0.01, "replacement_chars")
        .when(count_matches(t, r"\p{L}") / n < 0.55, "low_alpha_fraction")
        .when((lines >= 10) & (1 - distinct / lines > 0.3), "repeated_lines")
    )
    return _judged(d, "_t", reason).drop("_lines")


def clean_sql(df: DataFrame, text: str = "content") -> DataFrame:
    d = df.withColumn("_t", normalize(F.coalesce(F.col(text), F.lit(""))))
    t = F.col("_t")
    short = F.length(t) < SQL_LEAST
    lines = F.size(F.split(t, "\n"))
    dump = ~short & (F.regexp_count(t, F.lit(r"(?im)^\s*insert\b")) / lines > 0.5)
    d = d.withColumns({"_short": short, "_dump": dump})
    head = F.substring(t, 1, DUMP_CHARS)
    cut = F.when(head.contains("\n"), F.regexp_extract(head, r"(?s)^(.*)\n", 1)).otherwise(head)
    d = d.withColumn("_t", F.when(F.col("_dump"), cut).otherwise(t))
    longest = F.array_max(F.transform(F.split(t, "\n"), lambda x: F.length(x)))
    reason = (
        F.when(F.col("_short"), "too_short")
        .when(longest > LONG_LINE, "long_lines")
        .when(count_matches(t, r"[\p{L}\p{N}]") / F.greatest(F.length(t), F.lit(1)) < 0.3, "low_alnum_fraction")
        .when(~t.rlike(rf"(?i)(?:^|{NOT_WORD})(?:{STATEMENTS})(?:$|{NOT_WORD})"), "no_sql_keyword")
        .when(F.col("_dump"), "truncated_dump")
    )
    return _judged(d, "_t", reason).drop("_short", "_dump")


def clean_thread(df: DataFrame, text: str = "threadtext", score: str = "score") -> DataFrame:
    """A null score passes."""
    d = df.withColumn("_t", normalize(F.coalesce(F.col(text), F.lit(""))))
    reason = F.when(F.col(score) < 0, "negative_score").when(F.length("_t") < THREAD_LEAST, "too_short")
    return _judged(d, "_t", reason)


def format_prompt(df: DataFrame, context: str = "sql_context", prompt: str = "sql_prompt", sql: str = "sql") -> DataFrame:
    """Schema, question and answer in one text; only the CREATE TABLE statements of the context are kept."""
    tables = F.transform(
        F.regexp_extract_all(F.coalesce(F.col(context), F.lit("")), F.lit(r"(?is)CREATE\s+TABLE\b[^;]*;"), F.lit(0)),
        lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")),
    )
    missing = (F.size(tables) == 0) | (F.coalesce(F.col(prompt), F.lit("")) == "") | (F.coalesce(F.col(sql), F.lit("")) == "")
    text = F.concat(
        F.lit("<schema>"), F.array_join(tables, "\n"), F.lit("</schema>\n<question>"), normalize(F.col(prompt)),
        F.lit("</question>\n<sql>"), normalize(F.col(sql)), F.lit("</sql>"),
    )
    reason = F.when(missing, "missing_field")
    return df.withColumn("reason", reason).withColumn("clean_text", F.when(~missing, text))


def canonical(df: DataFrame, source: str, license: Column, origin: Column, chars: Column) -> DataFrame:
    """Canonical columns plus what reports need: ``source, license, origin, text, reason, chars_in``."""
    return df.select(
        F.lit(source).alias("source"), license.cast("string").alias("license"), origin.alias("origin"),
        F.col("clean_text").alias("text"), "reason", chars.cast("long").alias("chars_in"),
    )


def report(cleaned: DataFrame) -> DataFrame:
    """Per source: documents and characters in and out, and the kept share."""
    kept = F.col("text").isNotNull()
    return cleaned.groupBy("source").agg(
        F.count("*").alias("docs_in"),
        F.count_if(kept).alias("docs_out"),
        F.sum(F.coalesce("chars_in", F.lit(0).cast("long"))).alias("chars_in"),
        F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("chars_out"),
        F.round(F.count_if(kept) / F.count("*"), 6).alias("kept"),
    )


def reasons(cleaned: DataFrame) -> DataFrame:
    """Per source and reason the rows dropped or changed for it."""
    return cleaned.where(F.col("reason").isNotNull()).groupBy("source", "reason").agg(F.count("*").alias("n"))
