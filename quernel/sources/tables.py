"""Readers. Each returns a lazy DataFrame with only the columns asked for."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """The parquet table ``name`` of ``folder``, pruned to ``columns`` if any are named."""
    df = spark.read.parquet(os.path.join(folder, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def latest(df: DataFrame, key: str, columns: list[str | Column], stamp: str = "loaded_at") -> DataFrame:
    """One row for each ``key``: its latest delivery by ``stamp``, ties to the greatest values of ``columns``.

    The values are reduced map-side first, so put small derived columns in ``columns`` rather than the text they
    come from. A null ``stamp`` counts as the earliest. Rows without a key stay apart unless they are equal.
    """
    value = F.struct(*[F.col(c) if isinstance(c, str) else c for c in columns])
    names = [c.name for c in df.select(value.alias("v")).schema["v"].dataType.fields]
    return (
        df.select(F.col(key), value.alias("_v"), F.col(stamp).alias("_at"))
        .groupBy(key, F.when(F.col(key).isNull(), F.hash("_v")).alias("_apart"))
        .agg(F.max(F.struct(F.col("_at"), F.col("_v"))).alias("_top"))
        .select(key, *[F.col(f"_top._v.{n}").alias(n) for n in names])
    )


def first_rows(df: DataFrame, most: int | None, *order: str) -> DataFrame:
    """For trial runs: ``most`` rows, the first ones in ``order`` if any is given, or all of them for None."""
    if most is None:
        return df
    return (df.orderBy(*order) if order else df).limit(most)


#: File pattern and columns of each raw source.
SOURCES = {
    "fineweb_edu": ("*.parquet", ["text", "url"]),
    "stack_sql": ("*.parquet", ["content", "max_stars_repo_licenses", "max_stars_repo_name"]),
    "stackexchange": ("*/*.parquet", ["ThreadText", "Score", "ContentLicense", "Id"]),
    "gretel_sql": ("*.parquet", ["sql_context", "sql_prompt", "sql", "id"]),
}


def raw_source(spark: SparkSession, root: str, source: str) -> DataFrame:
    """Files of one raw source, pruned; threads get their ``site`` from the name of their folder."""
    pattern, columns = SOURCES[source]
    df = spark.read.parquet(os.path.join(root, source, pattern))
    keep = [F.col(c) for c in columns]
    if source == "stackexchange":
        keep.append(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("site"))
    return df.select(*keep)


QUESTION_SCHEMA = T.StructType(
    [
        T.StructField("table_id", T.StringType()),
        T.StructField("question", T.StringType()),
        T.StructField(
            "sql",
            T.StructType(
                [
                    T.StructField("sel", T.IntegerType()),
                    T.StructField("agg", T.IntegerType()),
                    T.StructField("conds", T.ArrayType(T.ArrayType(T.StringType()))),
                ]
            ),
        ),
    ]
)


def jsonl(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON lines. Without a schema the union of all keys is inferred and absent keys are null."""
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def csv_named(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """CSV with a header whose columns are renamed by position."""
    return spark.read.csv(path, header=True).toDF(*names)


def sqlite_table(spark: SparkSession, path: str, name: str, max_rows: int = 1_000_000) -> DataFrame:
    """A table of a SQLite file, opened read-only. Such files are single-node, so more than ``max_rows`` is an error."""
    import sqlite3

    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        quoted = '"' + name.replace('"', '""') + '"'
        cols = [(r[1], (r[2] or "").upper()) for r in con.execute(f"PRAGMA table_info({quoted})")]
        rows = con.execute(f"SELECT * FROM {quoted} LIMIT {max_rows + 1}").fetchall()
    if not cols:
        raise ValueError(f"no table {name}")
    if len(rows) > max_rows:
        raise ValueError(f"{name} has more than {max_rows} rows; export it to parquet")
    number = [kind.startswith(("REAL", "FLOA", "DOUB", "INT", "NUM")) for _, kind in cols]
    schema = T.StructType([T.StructField(c, T.DoubleType() if n else T.StringType()) for (c, _), n in zip(cols, number)])
    data = [tuple(None if v is None else float(v) if n else str(v) for v, n in zip(r, number)) for r in rows]
    return spark.createDataFrame(data, schema)
