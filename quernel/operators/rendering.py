"""Structured queries to text: identifiers, schemas, statements, prompts, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Aggregate and operator codes.
AGGREGATES = ["", "MAX", "MIN", "COUNT", "SUM", "AVG"]
OPERATORS = ["=", ">", "<", "OP"]


def column_names(header: Column) -> Column:
    """A blank or null name becomes ``col`` and its place."""
    return F.transform(
        header, lambda h, i: F.when(F.coalesce(h, F.lit("")).rlike(r"(?U)^\s*$"), F.concat(F.lit("col"), i.cast("string"))).otherwise(h)
    )


def quote_ident(name: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(name, F.lit('"'), F.lit('""')), F.lit('"'))


def quote_value(value: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(value.cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))


def schema_text(header: Column, types: Column) -> Column:
    cols = F.zip_with(
        column_names(header), types, lambda n, t: F.concat(quote_ident(n), F.when(t == "real", F.lit(" REAL")).otherwise(F.lit(" TEXT")))
    )
    return F.concat(F.lit("CREATE TABLE t ("), F.array_join(cols, ", "), F.lit(");"))


def _code(codes: list[str], ix: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in codes]), ix + 1)


def to_sql(header: Column, sel: Column, agg: Column, conds: Column) -> Column:
    """``conds`` is an array of ``struct(col_ix, op, val)``; a null or empty one gives no WHERE."""
    names = F.transform(column_names(header), quote_ident)
    chosen = F.get(names, sel)
    select = F.when(agg > 0, F.concat(_code(AGGREGATES, agg), F.lit("("), chosen, F.lit(")"))).otherwise(chosen)
    each = F.transform(
        conds, lambda c: F.concat(F.get(names, c["col_ix"]), F.lit(" "), _code(OPERATORS, c["op"]), F.lit(" "), quote_value(c["val"]))
    )
    where = F.when(F.size(conds) > 0, F.concat(F.lit(" WHERE "), F.array_join(each, " AND "))).otherwise(F.lit(""))
    return F.concat(F.lit("SELECT "), select, F.lit(" FROM t"), where, F.lit(";"))


def prompt_text(question: Column, header: Column, types: Column) -> Column:
    q = F.regexp_replace(F.coalesce(question, F.lit("")), r"(?U)^\s+|\s+$", "")
    return F.concat(F.lit("<schema>"), schema_text(header, types), F.lit("</schema>\n<question>"), q, F.lit("</question>\n<sql>"))


def with_tables(items: DataFrame, tables: DataFrame) -> DataFrame:
    """Items with the ``header`` and ``types`` of their table; items of unknown tables are left out. The planner
    broadcasts ``tables`` if it is small."""
    return items.join(tables, "table_id")


def examples(items: DataFrame, tables: DataFrame) -> DataFrame:
    """``item_id, table_id, question, prompt, completion``."""
    j = with_tables(items, tables)
    h = F.col("header")
    return j.select(
        "item_id", "table_id", "question",
        prompt_text(F.col("question"), h, F.col("types")).alias("prompt"),
        F.concat(to_sql(h, F.col("sel"), F.col("agg"), F.col("conds")), F.lit("</sql>")).alias("completion"),
    )


def masked_labels(prompt_ids: Column, completion_ids: Column, end: int, most: int) -> Column:
    """``struct(ids, labels)``: labels of the prompt are -100; both are cut to ``most``."""
    ids = F.concat(prompt_ids, completion_ids, F.array(F.lit(end)))
    labels = F.concat(F.array_repeat(F.lit(-100), F.size(prompt_ids)), completion_ids, F.array(F.lit(end)))
    return F.struct(F.slice(ids, 1, most).alias("ids"), F.slice(labels, 1, most).alias("labels"))


def collate(df: DataFrame, batch: str, ids: str, labels: str, pad: int) -> DataFrame:
    """``x, y`` of each row: padded to the longest of its batch, then shifted by one."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(batch))
    padded = lambda c, v: F.concat(F.col(c), F.array_repeat(F.lit(v), longest - F.size(c)))
    d = df.withColumn("_n", longest - 1).withColumn("_x", padded(ids, pad)).withColumn("_y", padded(labels, -100))
    return d.withColumn("x", F.slice("_x", F.lit(1), F.col("_n"))).withColumn("y", F.slice("_y", F.lit(2), F.col("_n"))).drop("_n", "_x", "_y")
