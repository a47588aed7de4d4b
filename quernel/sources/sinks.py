"""Writers: parquet, JSON lines, reports, logs, manifests of finished inputs."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_parquet(df: DataFrame, path: str, *partition_by: str) -> None:
    """Zstandard parquet; the committer makes the result appear at once."""
    w = df.write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines in UTF-8; null fields are written as null."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_report(df: DataFrame, path: str, key: str, most: int = 100_000) -> dict:
    """A nested JSON file ``{key: row}`` of a small aggregate; more than ``most`` rows is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    out = {str(r[key]): {k: v for k, v in r.asDict(recursive=True).items() if k != key} for r in rows}
    tmp = f"{path}.tmp"
    with open(tmp, "w", encoding="utf-8") as f:
        json.dump(out, f, indent=1, ensure_ascii=False, default=str)
    os.replace(tmp, path)
    return out


def unfinished(inputs: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """Inputs that the manifest of finished ones does not name."""
    return inputs.join(manifest.select(key).distinct(), key, "left_anti")


def checksums(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, length, sha256`` of files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def as_view(df: DataFrame, names: list[str], view: str = "t") -> None:
    """Renames columns by position and registers the result. Its text columns compare without regard to case."""
    loose = [F.col(c.name).cast("string collate UTF8_LCASE").alias(n) if c.dataType.simpleString() == "string" else F.col(c.name).alias(n) for c, n in zip(df.schema, names)]
    df.select(*loose).createOrReplaceTempView(view)
