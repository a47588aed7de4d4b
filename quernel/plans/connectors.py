"""Queries that write tables through the sinks and read them back through the sources."""

from __future__ import annotations

import json
import os
import sqlite3
import tempfile

from pyspark.sql import functions as F

from quernel.functions.text import words
from quernel.operators import shards
from quernel.session import scratch
from quernel.sources import sinks, tables
from quernel.sources.tables import table

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def parquet_roundtrip(s, d):
    path = scratch(s)
    sinks.write_parquet(table(s, d, "customer"), path, "c_mktsegment")
    return s.read.parquet(path).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query
def jsonl_roundtrip(s, d):
    """Questions as JSON lines, null ones included; ``named`` says whether the line has the field."""
    path = scratch(s)
    t = table(s, d, "eval_questions", "item_id", "table_id", "question", "sel")
    sinks.write_jsonl(t, path)
    lines = s.read.text(path).select(F.from_json("value", t.schema).alias("r"), F.contains("value", F.lit('"question":')).alias("named"))
    return lines.select("r.*", "named")


@query
def jsonl_source(s, d):
    path = scratch(s)
    t = table(s, d, "eval_questions")
    conds = F.transform("conds", lambda c: F.array(c["col_ix"].cast("string"), c["op"].cast("string"), c["val"]))
    sinks.write_jsonl(t.select("table_id", "question", F.struct("sel", "agg", conds.alias("conds")).alias("sql")), path)
    q = tables.jsonl(s, path, tables.QUESTION_SCHEMA)
    return q.groupBy("table_id").agg(F.count("*").alias("n"), F.count("question").alias("asked"), F.sum("sql.sel").alias("sel"), F.sum(F.size("sql.conds")).alias("conds"))


@query
def csv_source(s, d):
    path = scratch(s)
    table(s, d, "customer", "c_custkey", "c_name", "c_mktsegment").write.csv(path, header=True)
    return tables.csv_named(s, path, ["id", "name", "segment"])


@query
def log_append(s, d):
    path = scratch(s)
    n = table(s, d, "nation", "n_nationkey", "n_regionkey")
    sinks.append_log(n.select(F.col("n_nationkey").alias("step"), "n_regionkey"), path)
    sinks.append_log(n.select((F.col("n_nationkey") + 100).alias("step"), F.lit(0.5).alias("val_loss"), "n_regionkey"), path)
    return tables.jsonl(s, path).groupBy("n_regionkey").agg(F.count("*").alias("n"), F.max("step").alias("last"), F.count("val_loss").alias("evals"))


@query
def report_file(s, d):
    folder = tempfile.mkdtemp(prefix="quernel-report-")  # reports are files of the driver
    sinks.write_report(table(s, d, "documents", "doc_id", "lang").groupBy("lang").agg(F.count("*").alias("docs")), os.path.join(folder, "r.json"), "lang")
    with open(os.path.join(folder, "r.json"), encoding="utf-8") as f:
        return s.createDataFrame([(k, v["docs"]) for k, v in json.load(f).items()], "lang string, docs long")


@query
def shard_files(s, d):
    """Shards of packed tokens as binary files; those too short for a window of 512 tokens are dropped. Word lengths
    stand for ids."""
    path = scratch(s)
    t = table(s, d, "documents", "doc_id", "text").select("doc_id", F.floor(F.col("doc_id") / 50).cast("string").alias("shard"), F.transform(words(F.coalesce("text", F.lit(""))), lambda w: F.length(w)).alias("ids"))
    shards.write_uint16(t, path, "shard", "doc_id", "ids", 0).collect()
    r = shards.read_uint16(s, path, 512)
    return r.select("shard", F.size("tokens").alias("tokens"), F.md5(F.array_join(F.transform("tokens", lambda v: v.cast("string")), " ")).alias("ids"))


@query
def sqlite_source(s, d):
    path = os.path.join(tempfile.mkdtemp(prefix="quernel-sqlite-"), "t.sqlite")  # such files are the driver's
    rows = [tuple(r) for r in table(s, d, "supplier", "s_name", "s_acctbal").orderBy("s_name").collect()]
    with sqlite3.connect(path) as con:
        con.execute("create table t (name text, balance real)")
        con.executemany("insert into t values (?, ?)", rows)
    return tables.sqlite_table(s, path, "t")


@query
def raw_threads(s, d):
    """Threads in a folder a site, read by the registry of raw sources."""
    root = scratch(s)
    t = table(s, d, "threads").select(F.col("threadtext").alias("ThreadText"), F.col("score").alias("Score"), F.col("contentlicense").alias("ContentLicense"), F.col("id").alias("Id"), "site")
    for r in t.select("site").distinct().collect():  # folders
        t.where(F.col("site") == r["site"]).drop("site").write.parquet(os.path.join(root, "stackexchange", r["site"]))
    return tables.raw_source(s, root, "stackexchange").groupBy("site").agg(F.count("*").alias("n"), F.count("ThreadText").alias("texts"), F.sum("Score").alias("score"))


@query
def caseless_view(s, d):
    sinks.as_view(table(s, d, "customer", "c_custkey", "c_mktsegment"), ["No.", "Market Segment"], "caseless_t")
    return s.sql("SELECT `No.` AS id FROM caseless_t WHERE `Market Segment` = 'bUILDING'")


@query
def first_documents(s, d):
    """A trial run over the first hundred documents."""
    return tables.first_rows(table(s, d, "documents", "doc_id", "source"), 100, "doc_id")


ORACLE = {
    "parquet_roundtrip": "SELECT * FROM customer",
    "jsonl_roundtrip": "SELECT item_id, table_id, question, sel, TRUE AS named FROM eval_questions",
    "jsonl_source": """SELECT table_id, count(*) AS n, count(question) AS asked, sum(sel)::BIGINT AS sel, sum(length(conds))::BIGINT AS conds
FROM eval_questions GROUP BY table_id""",
    "csv_source": "SELECT c_custkey::VARCHAR AS id, c_name AS name, c_mktsegment AS segment FROM customer",
    "log_append": "SELECT n_regionkey::BIGINT AS n_regionkey, 2 * count(*) AS n, max(n_nationkey)::BIGINT + 100 AS last, count(*) AS evals FROM nation GROUP BY ALL",
    "report_file": "SELECT coalesce(lang, 'None') AS lang, count(*) AS docs FROM documents GROUP BY ALL",
    "shard_files": r"""WITH t AS (SELECT doc_id, doc_id // 50 AS shard, list_append(list_transform(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+'), lambda w: length(w)), 0) AS t FROM documents),
g AS (SELECT shard, flatten(list(t ORDER BY doc_id)) AS l FROM t GROUP BY shard)
SELECT shard::VARCHAR AS shard, length(l) AS tokens, md5(array_to_string(l, ' ')) AS ids FROM g WHERE length(l) > 513""",
    "sqlite_source": "SELECT s_name AS name, s_acctbal AS balance FROM supplier",
    "raw_threads": "SELECT site, count(*) AS n, count(threadtext) AS texts, sum(score)::BIGINT AS score FROM threads WHERE site IS NOT NULL GROUP BY site",
    "caseless_view": "SELECT c_custkey AS id FROM customer WHERE lower(c_mktsegment) = 'building'",
    "first_documents": "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 100",
}
