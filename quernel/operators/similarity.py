"""Exact and near duplicates: classes of equal text, MinHash bands, verified links, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.functions.text import words
from quernel.session import cut

SHINGLE = 5
#: At the Jaccard ``SIMILAR`` one pair in ten million shares no band.
BANDS, ROWS = 32, 4
SIMILAR = 0.8
#: Members of a bucket that one task compares with as many others.
BLOCK = 256
#: Buckets of more than two members that are broadcast; more of them are joined by a shuffle.
BROADCAST_BUCKETS = 500_000
#: Links of which ``clusters`` finds the components on the driver; more of them take rounds on the cluster.
DRIVER_LINKS = 200_000
_MASK = (1 << 32) - 1


def permutations(n: int = BANDS * ROWS) -> list[tuple[int, int]]:
    """Multiplier (odd) and offset of each hash function, from the MD5 of its number."""
    import hashlib

    def of(kind: str, i: int) -> int:
        return int(hashlib.md5(f"{kind}{i}".encode()).hexdigest()[:8], 16)

    return [(of("a", i) | 1, of("b", i)) for i in range(n)]


def shingle_hashes(tokens: list[str], text: str) -> list[int]:
    """Distinct 32-bit hashes of the five-word shingles. Shorter texts are one shingle; without words, the whole text."""
    import hashlib

    n = len(tokens)
    grams = {" ".join(tokens[i : i + SHINGLE]) for i in range(n - SHINGLE + 1)} or {" ".join(tokens) or text}
    return [int.from_bytes(hashlib.md5(g.encode("utf-8")).digest()[:4], "big") for g in grams]


@F.pandas_udf(T.ArrayType(T.LongType()))
def signature(tokens: pd.Series, text: pd.Series) -> pd.Series:
    """MinHash of the shingles: per function the least ``(a * h + b) mod 2**32``. Null for a null text."""
    p = np.array(permutations(), dtype=np.uint64)

    def one(t, whole):
        if whole is None:
            return None
        x = np.array(shingle_hashes(list(t), whole), dtype=np.uint64)
        best = np.full(len(p), _MASK, dtype=np.uint64)
        for i in range(0, len(x), 4096):
            v = (x[i : i + 4096, None] * p[:, 0] + p[:, 1]) & np.uint64(_MASK)
            best = np.minimum(best, v.min(0))
        return best.astype(np.int64)

    return pd.Series([one(t, x) for t, x in zip(tokens, text)])


_SETS = T.StructType([T.StructField("sig", T.ArrayType(T.LongType())), T.StructField("grams", T.ArrayType(T.IntegerType()))])


@F.pandas_udf(_SETS)
def _sets(hashes: pd.Series, whole: pd.Series) -> pd.DataFrame:
    p = np.array(permutations(), dtype=np.uint64)
    low, factor = np.uint64(_MASK), np.uint64(0x9E3779B97F4A7C15)
    sigs, grams = [], []
    for h, w in zip(hashes, whole):
        h = np.asarray(h, dtype=np.int64).astype(np.uint64)
        if len(h) == 0:
            h = np.array([w], dtype=np.int64).astype(np.uint64)
        size = min(SHINGLE, len(h))
        runs = np.zeros(len(h) - size + 1, dtype=np.uint64)
        for j in range(size):
            runs = runs * factor + h[j : j + len(runs)]
        runs ^= runs >> np.uint64(29)
        x = np.unique((runs * factor) >> np.uint64(32))
        best = np.full(len(p), _MASK, dtype=np.uint64)
        for i in range(0, len(x), 4096):
            best = np.minimum(best, ((x[i : i + 4096, None] * p[:, 0] + p[:, 1]) & low).min(0))
        sigs.append(best.astype(np.int64))
        grams.append(x.astype(np.uint32).astype(np.int32))
    return pd.DataFrame({"sig": sigs, "grams": grams})


def shingle_sets(text: Column) -> Column:
    """``struct(sig, grams)`` of a text: its MinHash and the hashes of its distinct shingles, for comparing. Words are
    hashed in the JVM, so only numbers go to Python. Fewer words than a shingle are one; without words, the whole text is."""
    return _sets(F.transform(words(text), lambda w: F.xxhash64(w)), F.xxhash64(text))


def band_keys(sig: Column, bands: int = BANDS, rows: int = ROWS) -> Column:
    """One key a band; bands do not share keys."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(F.slice(sig, i * rows + 1, rows), i))


def exact_keep(df: DataFrame, text: str, order: list[str]) -> DataFrame:
    """The first row of each text in ``order``. Only a hash, the length and the order are reduced by text; equal hashes
    of 128 bits are taken as equal texts. Null texts are one class."""
    key = F.coalesce(F.md5(F.col(text)), F.lit(""))
    firsts = df.groupBy(key.alias("_h")).agg(F.min(F.struct(*order)).alias("_o")).select("_o.*")
    return df.join(firsts, order, "left_semi")


def links(classes: DataFrame, key: str, sig: str, grams: str, bands: int = BANDS, rows: int = ROWS, similar: float = SIMILAR) -> DataFrame:
    """``a, b``: all pairs ``a < b`` that share a band and whose sets ``grams`` of distinct hashes have that Jaccard.

    Members of a large bucket meet in blocks of ``BLOCK``, so no task holds a whole bucket; each pair is judged once.
    The work in a bucket is that of its pairs, as all of them count. Most buckets have one member or two, and are
    settled by one aggregation; only members of larger ones are looked up again.
    """
    keys = cut(classes.select(F.col(key).alias("k"), band_keys(F.col(sig), bands, rows).alias("bands"), F.col(grams).alias("g")))
    left = keys.select("k", F.explode("bands").alias("bucket"))
    shared = left.groupBy("bucket").agg(F.count("*").alias("n"), F.min("k").alias("a"), F.max("k").alias("b")).where("n > 1")
    shared = cut(shared)
    two = shared.where("n = 2 AND a < b").select("a", "b")
    more = shared.where("n > 2").select("bucket", F.ceil(F.col("n") / BLOCK).alias("blocks"))
    few = more.limit(BROADCAST_BUCKETS + 1).count()
    pairs = two
    if few:
        more = F.broadcast(more) if few <= BROADCAST_BUCKETS else more
        met = cut(left.join(more, "bucket").withColumn("mine", F.pmod(F.xxhash64("k"), "blocks")))
        others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
        first = met.select(F.col("k").alias("a"), "bucket", F.col("mine").alias("i"), others.alias("j"))
        second = met.select(F.col("k").alias("b"), "bucket", others.alias("i"), F.col("mine").alias("j"))
        pairs = two.unionByName(first.join(second, ["bucket", "i", "j"]).where("a < b").select("a", "b"))
    sets = keys.select("k", "g")
    both = F.size(F.array_intersect("x", "y"))
    return cut(
        pairs.distinct().join(sets.select(F.col("k").alias("a"), F.col("g").alias("x")), "a")
        .join(sets.select(F.col("k").alias("b"), F.col("g").alias("y")), "b")
        .where(both / (F.size("x") + F.size("y") - both) >= similar)
        .select("a", "b")
    )


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``k, component``: the least node that each node is linked to. ``nodes`` has ``k``, ``edges`` has ``a, b``.

    Labels spread along links and jump to the label of their label, so the rounds grow with the logarithm of the
    longest path. Only nodes that have links take part. Nothing is collected; each round is checkpointed.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(both.groupBy(F.col("a").alias("k")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(label, both["a"] == label["k"]).groupBy(F.col("b").alias("k")).agg(F.min("component").alias("least"))
        step = label.join(near, "k").select("k", "component", F.least("component", "least").alias("next"))
        jump = label.select(F.col("k").alias("next"), F.col("component").alias("jump"))
        step = cut(step.join(jump, "next").select("k", F.col("component").alias("old"), F.least("next", "jump").alias("component")))
        label = step.select("k", "component")
        if step.where("old <> component").isEmpty():
            return nodes.select("k").join(label, "k", "left").select("k", F.coalesce("component", "k").alias("component"))


def _far(x: str, y: str) -> Column:
    """In how many functions two sketches differ. A sketch is two planes of two words, a bit of each function in either."""
    words = [F.col(x)[i].bitwiseXOR(F.col(y)[i]) for i in range(4)]
    return F.bit_count(words[0].bitwiseOR(words[2])) + F.bit_count(words[1].bitwiseOR(words[3]))


def clusters(nodes: DataFrame, most: int, similar: float = SIMILAR) -> DataFrame:
    """``k, component`` of the nodes that are linked to any other: the connected components of the pairs that share a
    band and whose sets have the Jaccard ``similar``. ``nodes`` has ``k, bands, sketch, grams``; a ``k`` that stands in
    several rows has the same values in each.

    Only components are wanted, so not all links are looked for. First all members of a bucket are compared with its
    least; then, in blocks of ``BLOCK``, those that are not yet known to be of one component. Sizes tell most pairs that
    can't be similar, and sketches those that differ in more than ``most`` functions; sets travel for the rest only.
    """
    left = nodes.select("k", F.explode("bands").alias("bucket"))
    shared = left.groupBy("bucket").agg(F.count("*").alias("n"), F.min("k").alias("head"), F.max("k").alias("last")).where("head < last")
    shared = cut(shared.select("bucket", "head", F.ceil(F.col("n") / BLOCK).alias("blocks")))
    met = left.join(_broadcast(shared, BROADCAST_BUCKETS), "bucket").distinct()
    about = nodes.groupBy("k").agg(F.first("sketch").alias("s"), F.first(F.size("grams")).alias("size"))
    met = cut(met.join(about, "k"))
    close = (_far("s", "t") <= most) & (F.least("size", "size2") >= similar * F.greatest("size", "size2"))
    names = {"k": "b", "s": "t", "size": "size2"}

    heads = met.where("k = head").select("bucket", F.col("k").alias("a"), "s", "size")
    stars = heads.join(met.where("k <> head").withColumnsRenamed(names), "bucket").where(close).select("a", "b")
    links = _alike(stars, nodes, similar)

    met = met.where("k <> head").join(_broadcast(_linked(links), BROADCAST_BUCKETS), "k", "left").withColumn("component", F.coalesce("component", "k"))
    mixed = met.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("bucket")
    met = cut(met.join(mixed, "bucket", "left_semi").withColumn("mine", F.pmod(F.xxhash64("k"), "blocks")))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    first = met.select(F.col("k").alias("a"), "s", "size", "component", "bucket", F.col("mine").alias("i"), others.alias("j"))
    second = met.withColumnsRenamed(names | {"component": "other"}).select("b", "t", "size2", "other", "bucket", others.alias("i"), F.col("mine").alias("j"))
    pairs = first.join(second, ["bucket", "i", "j"]).where((F.col("a") < F.col("b")) & (F.col("component") != F.col("other")) & close)
    return _linked(links.unionByName(_alike(pairs.select("a", "b"), nodes, similar)))


def _broadcast(df: DataFrame, rows: int) -> DataFrame:
    """``df``, which is at hand, broadcast if it has no more rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _linked(links: DataFrame) -> DataFrame:
    """``k, component`` of the ends of ``links``: the least node that each is linked to. At most ``DRIVER_LINKS`` links
    reach the driver."""
    some = links.limit(DRIVER_LINKS + 1).toArrow()
    if some.num_rows > DRIVER_LINKS:
        return cut(components(links.select(F.col("a").alias("k")).union(links.select("b")).distinct(), links))
    least: dict[int, int] = {}

    def root(k: int) -> int:
        while (up := least.setdefault(k, k)) != k:
            least[k] = k = least.setdefault(up, up)
        return k

    for a, b in zip(some["a"].to_pylist(), some["b"].to_pylist()):
        low, high = sorted((root(a), root(b)))
        least[high] = low
    kind = some.schema.field("a").type
    found = pa.table({"k": pa.array(least, kind), "component": pa.array(map(root, list(least)), kind)})
    return links.sparkSession.createDataFrame(found)


def _alike(pairs: DataFrame, nodes: DataFrame, similar: float) -> DataFrame:
    """The distinct ``a, b`` of ``pairs`` whose sets have that Jaccard. Only the sets of their members are shuffled."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys = [], []
            for side in ("x", "y"):
                column = batch.column(side)
                sizes.append(np.diff(column.offsets.to_numpy()))
                values = column.flatten().to_numpy().view(np.uint32).astype(np.uint64)
                keys.append(values | np.repeat(np.arange(len(column), dtype=np.uint64) << np.uint64(32), sizes[-1]))
            merged = np.sort(np.concatenate(keys), kind="stable")
            both = np.bincount((merged[1:][merged[1:] == merged[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(sizes[0]))
            yield batch.select(["a", "b"]).filter(pa.array(both / (sizes[0] + sizes[1] - both) >= similar))

    pairs = cut(pairs.distinct())
    ends = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()
    ends = F.broadcast(ends) if pairs.limit(BROADCAST_BUCKETS + 1).count() <= BROADCAST_BUCKETS else ends
    sets = cut(nodes.select("k", "grams").join(ends, "k", "left_semi").groupBy("k").agg(F.first("grams").alias("g")))
    both = pairs.join(sets.select(F.col("k").alias("a"), F.col("g").alias("x")), "a").join(sets.select(F.col("k").alias("b"), F.col("g").alias("y")), "b")
    kind = pairs.schema["a"].dataType.simpleString()
    return cut(both.select("a", "b", "x", "y").mapInArrow(judged, f"a {kind}, b {kind}"))


def near_duplicates(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, class_id, links, keep``: near-duplicate class of each row, its verified links, and whether it is kept.

    Rows of equal text are one node. A class is a connected component of nodes whose shingle sets have the Jaccard
    ``SIMILAR``; its id is the least key in it. The longest text is kept, ties to the least key. ``links`` counts the
    links of a row's text to other texts. Null texts form one class; of an id given twice the longest text counts. Texts
    are hashed and signed where they are read and never shuffled; their sets of shingles are.
    """
    d = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    small = d.select("id", F.coalesce(F.md5("text"), F.lit("")).alias("h"), F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    hashed = cut(small.groupBy("id").agg(F.max(F.struct("n", "h")).alias("x")).select("id", "x.h", "x.n"))
    reps = hashed.groupBy("h").agg(F.min("id").alias("k"), F.max("n").alias("n"))
    nodes = cut(reps)
    sigs = cut(
        d.where(F.col("text").isNotNull())
        .select(F.col("id").alias("k"), F.md5("text").alias("h"), shingle_sets(F.col("text")).alias("s"))
        .join(nodes.select("k", "h"), ["k", "h"], "left_semi")
        .groupBy("k").agg(F.first("s").alias("s")).select("k", "s.*")
    )
    edges = links(sigs, "k", "sig", "grams")
    comp = components(nodes, edges)
    degree = edges.select(F.col("a").alias("k")).unionByName(edges.select(F.col("b").alias("k"))).groupBy("k").agg(F.count("*").alias("links"))
    texts = nodes.join(comp, "k").join(degree, "k", "left")
    best = texts.groupBy("component").agg(F.min_by("k", F.struct(-F.col("n"), F.col("k"))).alias("kept"))
    return (
        hashed.join(texts.select("h", "component", "k", "links"), "h")
        .join(best, "component")
        .select(
            F.col("id").alias(key), F.col("component").alias("class_id"),
            F.coalesce("links", F.lit(0).cast("long")).alias("links"),
            ((F.col("k") == F.col("kept")) & (F.col("id") == F.col("k"))).alias("keep"),
        )
    )


def near_duplicates_of(df: DataFrame, key: str, text: str, source: str, chosen: list[str]) -> DataFrame:
    """``near_duplicates`` among the rows of the ``chosen`` sources. All other rows, those without a source included, are
    kept, each as a class of its own. ``key`` is unique."""
    mine = F.coalesce(F.col(source).isin(*chosen), F.lit(False))
    rest = df.where(~mine).select(key, F.col(key).alias("class_id"), F.lit(0).cast("long").alias("links"), F.lit(True).alias("keep"))
    return near_duplicates(df.where(mine), key, text).unionByName(rest)


def first_of_each(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in a total order."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
