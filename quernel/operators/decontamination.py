"""Documents that share n-grams with held-out questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.functions.text import words
from quernel.session import cut

LONGEST, SHORTEST = 13, 8
#: Sides with more rows than this are joined by a shuffle instead of broadcast.
BROADCAST_GRAMS, BROADCAST_DOCS = 500_000, 2_000_000


def eval_index(items: DataFrame, key: str = "item_id", text: str = "question") -> DataFrame:
    """``n, gram, item``: every 13-gram of long questions, shorter ones down to 8 words whole; the least item wins."""
    t = items.select(F.col(key).alias("item"), words(F.coalesce(F.col(text), F.lit(""))).alias("t")).where(F.size("t") >= SHORTEST)
    n = F.least(F.size("t"), F.lit(LONGEST))
    grams = t.select(
        "item", n.alias("n"),
        F.explode(F.transform(F.sequence(F.lit(1), F.size("t") - n + 1), lambda i: F.array_join(F.slice("t", i, n), " "))).alias("gram"),
    )
    return grams.groupBy("n", "gram").agg(F.min("item").alias("item"))


def hits(docs: DataFrame, index: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, item, n, pos``: per contaminated document its first hit, shortest n-grams first, then by place.

    Every indexed gram begins with ``SHORTEST`` words, so only hashes of runs of that length are made of the corpus and
    joined; the few places that meet are compared word by word with the whole gram. ``key`` is unique.
    """
    hashed = lambda tokens: F.transform(tokens, lambda w: F.xxhash64(w))
    start = F.xxhash64(F.slice(hashed(F.split("gram", " ")), 1, SHORTEST))
    small = _small(index.select(start.alias("g"), "n", "gram", "item"), BROADCAST_GRAMS)
    t = docs.select(F.col(key).alias("k"), words(F.coalesce(F.col(text), F.lit(""))).alias("t"))
    last = F.size("w") - SHORTEST + 1
    runs = t.select("k", hashed(F.col("t")).alias("w")).where(last >= 1)
    runs = runs.select("k", F.posexplode(F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice("w", i, SHORTEST)))).alias("pos", "g"))
    met = cut(runs.join(small, "g").select("k", "pos", "n", "gram", "item"))
    ids = _small(met.select(F.col("k").alias("id")).distinct(), BROADCAST_DOCS)
    near = t.join(ids, F.col("k").eqNullSafe(F.col("id")), "left_semi").select(F.col("k").alias("doc"), "t")
    return (
        met.join(near, F.col("k").eqNullSafe(F.col("doc")))
        .where(F.array_join(F.slice("t", F.col("pos") + 1, F.col("n")), " ") == F.col("gram"))
        .groupBy(F.col("k").alias(key))
        .agg(F.min(F.struct("n", "pos", "item")).alias("first"))
        .select(key, F.col("first.item").alias("item"), F.col("first.n").alias("n"), F.col("first.pos").alias("pos"))
    )


def _small(df: DataFrame, most: int) -> DataFrame:
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def keep(docs: DataFrame, found: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.join(found.select(key), key, "left_anti")


def report(docs: DataFrame, found: DataFrame, key: str = "doc_id", source: str = "source") -> DataFrame:
    """Per source: documents, removed documents, and the three least removed ids as examples."""
    d = docs.select(key, source).join(found.select(key, F.lit(1).alias("hit")), key, "left")
    ids = F.slice(F.array_sort(F.collect_list(F.when(F.col("r") <= 3, F.col(key)))), 1, 3)
    w = Window.partitionBy(source).orderBy(key)
    top = d.where("hit = 1").withColumn("r", F.row_number().over(w)).where("r <= 3").groupBy(source).agg(ids.alias("examples"))
    n = d.groupBy(source).agg(F.count("*").alias("docs_in"), F.count("hit").alias("removed"))
    j = n.join(top, n[source].eqNullSafe(top[source]), "left")
    return j.select(n[source], "docs_in", "removed", F.coalesce("examples", F.array().cast(f"array<{docs.schema[key].dataType.simpleString()}>")).alias("examples"))
