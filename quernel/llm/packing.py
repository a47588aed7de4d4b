"""Problem 4: texts into containers of fixed capacity with little room left over."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quernel.session import cut
from quernel.sources.tables import latest

#: A length with more pieces than this is ranked in several buckets, so that no task sorts a hot length alone.
RANK_ROWS = 250_000
#: Rows of a plan that is broadcast; a longer one, of a large capacity, is joined by a shuffle.
BROADCAST_ROWS = 500_000


def plan_best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over a histogram of lengths, without looking at single items.

    Containers with equal content are handled as one run. Each step puts as many items of one length as fit into
    every container of the run with the least sufficient room, so the number of steps depends on the number of
    distinct lengths (``capacity`` at most), not on the number of items. Gives slots ``(length, first rank, ranks,
    items a container, first container, offset)`` and the number of containers.
    """
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> runs (first container, containers)
    rooms: list[int] = []
    slots, used = [], 0

    def put(left: int, first: int, n: int) -> None:
        if left > 0 and n > 0:
            if not room[left]:
                insort(rooms, left)
            room[left].append((first, n))

    for length in sorted((x for x in counts if x > 0), reverse=True):
        if length > capacity:
            raise ValueError(f"length {length} exceeds the capacity {capacity}")
        todo, rank = counts[length], 0
        while todo:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                left = rooms[i]
                first, n = room[left].pop()
                if not room[left]:
                    del rooms[i]
            else:
                left, first = capacity, used
                n = -(-todo // (capacity // length))
                used += n
            each = left // length
            full = min(n, todo // each)
            if full:
                slots.append((length, rank, full * each, each, first, capacity - left))
                rank, todo = rank + full * each, todo - full * each
                put(left - each * length, first, full)
                first, n = first + full, n - full
            if n and todo:  # fewer items are left than one more container takes
                slots.append((length, rank, todo, todo, first, capacity - left))
                put(left - todo * length, first, 1)
                rank, todo, first, n = rank + todo, 0, first + 1, n - 1
            put(left, first, n)
    return slots, used


def pack_texts(docs: DataFrame, packs: DataFrame) -> DataFrame:
    """The container of each text, for every row of ``packs (pack_id, capacity_chars)``.

    Columns ``pack_id, row_id, piece, length, container_id, start``: ``piece`` counts from 0, ``start`` is the place
    within the container. Only a text longer than the capacity has several pieces: full containers and a rest.
    Containers are numbered from 0 in each pack. An empty text takes no room and is put into container 0; a null text
    has no container (null). A text delivered twice is packed once; equal texts under different ids are packed each.
    Null or non-positive capacities are left out, of a pack given twice the larger capacity holds.

    Only lengths are shuffled. The driver gets one count for each distinct piece length, at most ``capacity_chars``
    of them, and the plan has about as many rows: both are bounded by the capacity, whatever the corpus.
    """
    spark = docs.sparkSession
    sizes = (
        packs.where((F.col("capacity_chars") > 0) & F.col("pack_id").isNotNull())
        .groupBy("pack_id").agg(F.max("capacity_chars").alias("cap")).collect()  # a few configured container sizes
    )
    each = F.array(*[F.struct(F.lit(r["pack_id"]).alias("pack_id"), F.lit(r["cap"]).cast("long").alias("cap")) for r in sizes])
    if not sizes:
        each = F.array().cast("array<struct<pack_id:int,cap:bigint>>")
    lengths = latest(docs.select("row_id", "loaded_at", F.length("text").alias("n")), "row_id", ["n"])
    lengths = cut(lengths)
    per_pack = lengths.select("row_id", "n", F.explode(each).alias("p")).select("row_id", "n", "p.*")
    rest = F.col("n") % F.col("cap")
    tally = per_pack.where(F.col("n") > 0).groupBy("pack_id", "cap", rest.alias("rest")).agg(
        F.count("*").alias("items"), F.sum(F.floor(F.col("n") / F.col("cap"))).alias("full")
    )
    counts: dict[tuple, dict[int, int]] = defaultdict(lambda: defaultdict(int))
    for r in tally.collect():  # at most `cap` rows a pack
        counts[r["pack_id"], r["cap"]][r["rest"]] += r["items"]
        counts[r["pack_id"], r["cap"]][r["cap"]] += r["full"]
    plan, buckets = [], []
    for (pack, cap), c in counts.items():
        c.pop(0, None)
        slots, _ = plan_best_fit({k: v for k, v in c.items() if v}, cap)
        plan += [(pack, *s) for s in slots]
        buckets += [(pack, k, -(-v // RANK_ROWS)) for k, v in c.items() if v > RANK_ROWS]

    pieces = per_pack.where(F.col("n") > 0).select(
        "pack_id", "row_id", "cap", "n",
        F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / F.col("cap")).cast("int") - 1)).alias("piece"),
    ).select("pack_id", "row_id", "piece", F.least(F.col("cap"), F.col("n") - F.col("piece") * F.col("cap")).cast("long").alias("length"))
    ranked = _ranked(pieces, _small(spark.createDataFrame(buckets or [(-1, -1, 1)], "pack_id int, length long, buckets long"), len(buckets)))
    table = spark.createDataFrame(
        plan or [(-1, 0, 0, 0, 1, 0, 0)],
        "pack_id int, length long, r0 long, ranks long, each long, first long, start0 long",
    )
    r = F.col("rank") - F.col("r0")
    placed = (
        ranked.join(_small(table, len(plan)), ["pack_id", "length"])
        .where((r >= 0) & (r < F.col("ranks")))
        .select(
            "pack_id", "row_id", "piece", "length",
            (F.col("first") + F.floor(r / F.col("each"))).alias("container_id"),
            (F.col("start0") + r % F.col("each") * F.col("length")).alias("start"),
        )
    )
    nothing = per_pack.where(F.col("n").isNull() | (F.col("n") == 0)).select(
        "pack_id", "row_id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("length"),
        F.when(F.col("n") == 0, F.lit(0).cast("long")).alias("container_id"),
        F.when(F.col("n") == 0, F.lit(0).cast("long")).alias("start"),
    )
    return placed.unionByName(nothing)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _ranked(pieces: DataFrame, buckets: DataFrame) -> DataFrame:
    """Adds ``rank`` from 0 within (pack_id, length). Hot lengths are split into buckets whose ranks are shifted."""
    salted = pieces.join(buckets, ["pack_id", "length"], "left").withColumn(
        "bucket", F.pmod(F.xxhash64("row_id", "piece"), F.coalesce("buckets", F.lit(1).cast("long")))
    )
    salted = cut(salted.select("pack_id", "row_id", "piece", "length", "bucket"))
    sizes = salted.where(F.col("bucket") >= 0).groupBy("pack_id", "length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("pack_id", "length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select("pack_id", "length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    own = Window.partitionBy("pack_id", "length", "bucket").orderBy("row_id", "piece")
    return (
        salted.withColumn("r", F.row_number().over(own) - 1)
        .join(shift.where(F.col("shift") > 0), ["pack_id", "length", "bucket"], "left")
        .select("pack_id", "row_id", "piece", "length", (F.col("r") + F.coalesce("shift", F.lit(0))).alias("rank"))
    )


def pack_room(docs: DataFrame, packs: DataFrame) -> DataFrame:
    """Per pack: containers, characters in them, and the room left over in characters and as a share."""
    got = pack_texts(docs, packs).groupBy("pack_id").agg(
        (F.max("container_id") + 1).alias("containers"), F.sum("length").alias("chars")
    )
    room = F.col("containers") * F.col("capacity_chars") - F.col("chars")
    caps = packs.groupBy("pack_id").agg(F.max("capacity_chars").alias("capacity_chars"))
    return caps.join(got, "pack_id").select(
        "pack_id", "capacity_chars", "containers", "chars", room.alias("unused"),
        F.round(room / (F.col("containers") * F.col("capacity_chars")), 6).alias("unused_share"),
    )


def pack_checks(docs: DataFrame, packs: DataFrame) -> DataFrame:
    """Per pack what must hold of ``pack_texts``: texts, pieces and characters placed, pieces that overlap the one before
    them in their container, and pieces that stand out of it."""
    caps = packs.groupBy("pack_id").agg(F.max("capacity_chars").alias("cap"))
    got = pack_texts(docs, packs).join(caps, "pack_id")
    inside = Window.partitionBy("pack_id", "container_id").orderBy("start", "length")  # a container is bounded
    got = got.withColumn("over", F.coalesce(F.lag(F.col("start") + F.col("length")).over(inside) > F.col("start"), F.lit(False)))
    return got.groupBy("pack_id").agg(
        F.count_if(F.col("piece") == 0).alias("texts"), F.count("*").alias("pieces"), F.sum("length").alias("chars"),
        F.count_if(F.col("over") & F.col("container_id").isNotNull()).alias("overlaps"), F.count_if(F.col("start") + F.col("length") > F.col("cap")).alias("outside"),
    )
