import json
import math
import random
import sqlite3
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel.operators import bpe, distribution, logs, selection, shards, statistics
from quernel.sources import sinks, tables
from quernel.streaming import incremental


# ------------------------------------------------------------------------------------------------------------ selection
def test_threshold_keeps_the_fraction(spark):
    kinds = ["drop index a", "select a from b", "select a from b where c order by d"]
    rows = [(i, f"{kinds[(i % 10 > 5) + (i % 10 > 8)]} -- {i}") for i in range(1700)]  # 60, 30 and 10 of a hundred
    df = spark.createDataFrame(rows, "id int, text string").withColumn("score", selection.query_score(F.col("text")))
    cut = selection.threshold(selection.histogram(df), 0.25)
    kept = {r.id for r in selection.keep_by_threshold(df, cut).collect()}
    assert {i for i in range(1700) if i % 10 == 9} <= kept and not any(i % 10 < 6 for i in kept)
    assert abs(len(kept) - 425) < 45
    assert selection.threshold(selection.histogram(df.limit(0)), 0.25).collect() == []


def test_features(spark):
    texts = ["SELECT a FROM b", "selection", "WITH x AS (SELECT 1) SELECT max ( a ) FROM x GROUP  BY a ORDER\nBY a HAVING 1 LIMIT 1 UNION JOIN WHERE", None, ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(selection.query_score(F.col("t"))).collect()]
    assert got == [2, 0, 11, 0, 0]


def test_hashes(spark):
    import xxhash

    df = spark.createDataFrame([("abc",), ("",), (None,), ("é漢",)], "t string")
    want = [xxhash.xxh64_intdigest((t or "").encode()) for t in ("abc", "", None, "é漢")]
    assert [r[0] % (1 << 64) for r in df.select(selection.xxh64("t")).collect()] == want
    many = spark.range(20_000).select(F.col("id").cast("string").alias("t"))
    share = many.where(selection.is_validation(F.col("t"), 0.1)).count() / 20_000
    assert abs(share - 0.1) < 0.01


# ------------------------------------------------------------------------------------------------------------ tokenizer
def slow_train(counts, merges):
    words, out = [(list(c), n) for c, n in counts.items()], []
    for k in range(merges):
        pairs = Counter()
        for w, n in words:
            for p in zip(w, w[1:]):
                pairs[p] += n
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        out.append(best)
        words = [(bpe.merge(w, best, 256 + k), n) for w, n in words]
    return out


def test_training_equals_the_plain_loop():
    rng = random.Random(5)
    for _ in range(6):
        counts = {bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 9))): rng.randint(1, 5) for _ in range(60)}
        assert bpe.train_counts(counts, 25) == slow_train(counts, 25)
    assert bpe.train_counts({b"aaabdaaabac": 1}, 1) == [(97, 97)]
    assert bpe.merge([1, 1, 1, 2], (1, 1), 9) == [9, 1, 2]


def test_training_on_the_cluster_gives_the_same_merges(spark):
    rng = random.Random(9)
    counts = {"".join(rng.choice("aabé") for _ in range(rng.randint(1, 8))): rng.randint(1, 5) for _ in range(50)} | {"aaaa": 40}
    df = spark.createDataFrame(list(counts.items()), "chunk string, n long")
    want = bpe.train_counts({k.encode(): n for k, n in counts.items()}, 7)
    assert bpe.train_distributed(df, 7, 3) == want == bpe.train(df, 7, most_chunks=10)
    assert bpe.train_distributed(df.limit(0), 3) == []


def test_merges_go_on_to_the_whole_vocabulary(spark, tmp_path):
    from quernel.plans.queries import QUERIES

    names = [f"{a}{b}{c}" for a in "bcdfghklmn" for b in "aeiou" for c in "rstvwxz"]
    spark.createDataFrame([(i, f"{w} {w}") for i, w in enumerate(names)] * 2, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    pieces = {bytes(r.piece) for r in QUERIES["bpe_merges"](spark, str(tmp_path)).collect()}
    assert {n.encode() for n in names} <= pieces  # 350 words and their parts, far more than 200 merges


def test_vocabulary_round_trip(spark, tmp_path):
    texts = ["SELECT name FROM users WHERE id = 1;"] * 30 + ["The quick brown fox"] * 30
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    v = bpe.Vocabulary(bpe.train(bpe.chunk_counts(df), 60))
    v.save(str(tmp_path / "v.json"))
    w = bpe.Vocabulary.load(str(tmp_path / "v.json"))
    rng = random.Random(1)
    for t in texts[:2] + ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x800), 0x6F22, 0x1F642])) for _ in range(20)) for _ in range(100)] + ["", "<sql>x</sql>"]:
        assert v.decode(v.encode(t)) == t and w.encode(t) == v.encode(t)
    special = v.encode("<sql>x")
    assert special[0] == v.specials["<sql>"] and v.specials["<sql>"] not in v.encode("<sql>x", False)
    got = {r.id: r.ids for r in bpe.encode(df, v, "id", allow_special=F.col("id") < 0).collect()}
    assert got[0] == v.encode(texts[0], False)
    pieces = spark.createDataFrame([("a<sql>b</sql>",)], "t string").select(bpe.split_specials(F.col("t"))).first()[0]
    assert pieces == ["a", "<sql>", "b", "</sql>"]


def test_chunks_join_to_the_text(spark):
    import regex

    texts = ["I'll don't  stop\r\n\n x", "漢字かな 12345 ...!!\n", "tab\t\t end  ", "été İstanbul🙂"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(bpe.chunks(F.col("t"))).collect()]
    assert got == [regex.findall(bpe.PATTERN, t) for t in texts]


def test_compression(spark):
    df = spark.createDataFrame([("a", 10, 5), ("a", 30, 5), ("a", 8, 0), ("b", 9, 3), (None, 4, 4)], "s string, b long, t long")
    got = {r.s: (r.bytes_per_token, r.median_bytes_per_token) for r in bpe.compression(df, "b", "t", "s").collect()}
    assert got == {"a": (4.8, 6.0), "b": (3.0, 3.0), None: (1.0, 1.0)}


# --------------------------------------------------------------------------------------------------------------- shards
def test_offsets_windows_and_schedule(spark, tmp_path):
    df = spark.createDataFrame([("s", 1, 3), ("s", 2, 0), ("s", 3, 5), ("r", 1, 2)], "shard string, id int, tokens int")
    got = {(r.shard, r.id): (r.start, r.stop) for r in shards.offsets(df, "shard", "id", "tokens").collect()}
    assert got == {("s", 1): (0, 4), ("s", 2): (4, 5), ("s", 3): (5, 11), ("r", 1): (0, 3)}
    n = spark.createDataFrame([("a", 20), ("b", 5), ("c", 12)], "shard string, tokens int")
    starts = shards.shard_starts(n, "shard", "tokens", 4)
    assert [(r.shard, r.starts, r.before, r.upto) for r in starts.orderBy("shard").collect()] == [("a", 15, 0, 15), ("c", 7, 15, 22)]
    d = shards.locate(spark.createDataFrame([(0,), (14,), (15,), (21,)], "v int"), starts, "shard", "v").orderBy("v").collect()
    assert [(r.shard, r.offset) for r in d] == [("a", 0), ("a", 14), ("c", 0), ("c", 6)]
    p = spark.createDataFrame([(0.0,), (0.85,), (1.0,), (0.849,)], "progress double")
    got = {r.progress: r.phase for r in shards.schedule_weights(p, [(0.85, {"x": 1.0}), (1.0, {"x": 0.5, "y": 0.5})]).collect()}
    assert got == {0.0: 0, 0.85: 1, 1.0: 1, 0.849: 0}
    ids = spark.createDataFrame([("k", 2, [7, 8]), ("k", 1, [9]), ("m", 1, [65535])], "shard string, id int, ids array<int>")
    assert {r.shard: r.tokens for r in shards.write_uint16(ids, str(tmp_path), "shard", "id", "ids", 1).collect()} == {"k": 5, "m": 2}
    assert {r.shard: r.tokens for r in shards.read_uint16(spark, str(tmp_path)).collect()} == {"k": [9, 1, 7, 8, 1], "m": [65535, 1]}
    draw = spark.range(20_000).select(shards.draw_source(F.col("id").cast("string"), [("a", 0.7), ("b", 0.2), ("c", 0.1)]).alias("s"))
    share = {r.s: r["count"] / 20_000 for r in draw.groupBy("s").count().collect()}
    assert abs(share["a"] - 0.7) < 0.02 and abs(share["c"] - 0.1) < 0.02


# ----------------------------------------------------------------------------------------------------------- statistics
def test_mcnemar_is_exact(spark):
    from fractions import Fraction

    for x, y, both in ((10, 2, 5), (0, 0, 3), (300, 260, 10), (1, 0, 0), (900, 600, 0), (7, 90, 1), (50, 50, 0), (2000, 1, 0)):
        rows = [(1, 0)] * x + [(0, 1)] * y + [(1, 1)] * both
        r = statistics.mcnemar(spark.createDataFrame(rows, "a int, b int")).first()
        n, k = x + y, min(x, y)
        want = min(Fraction(1), 2 * Fraction(sum(math.comb(n, i) for i in range(k + 1)), 2**n)) if n else Fraction(1)
        log = math.log(want.numerator) - math.log(want.denominator)
        assert (r.only_a, r.only_b) == (x, y) and r.log_p == pytest.approx(log, abs=1e-9 * max(1, abs(log)))
        assert r.p == pytest.approx(float(want), rel=1e-9)
    r = statistics.mcnemar(spark.createDataFrame([(1, 0)] * 900 + [(0, 1)] * 600, "a int, b int")).first()
    assert 0 < r.p < 1e-12
    assert statistics.mcnemar(spark.createDataFrame([], "a int, b int")).first().p == 1.0


def test_bootstrap(spark):
    x = [1] * 300 + [0] * 100
    df = spark.createDataFrame([(v,) for v in x], "v int")
    a = statistics.bootstrap_interval(df, "v", 2000).first()
    assert tuple(a) == tuple(statistics.bootstrap_interval(df.repartition(5), "v", 2000).first())
    half = 1.96 * math.sqrt(0.75 * 0.25 / 400)
    assert a["mean"] == 0.75 and abs(a["high"] - a["low"] - 2 * half) < 0.25 * 2 * half
    same = statistics.paired_bootstrap(spark.createDataFrame([(1, 1)] * 50 + [(0, 0)] * 50, "a int, b int"), 500).first()
    assert same["diff"] == 0 and same["p"] == 1.0
    far = statistics.paired_bootstrap(spark.createDataFrame([(1, 0)] * 50 + [(0, 0)] * 50, "a int, b int"), 500).first()
    assert far["diff"] == 0.5 and far["p"] == pytest.approx(1 / 500)


# ----------------------------------------------------------------------------------------------------------------- logs
def test_logs(spark):
    v = [float(i * i % 17) for i in range(60)]
    df = spark.createDataFrame([("r", i * 10, x) for i, x in enumerate(v)], "run string, step int, loss double")
    got = [r.smoothed for r in logs.smooth(df, "run", "step", "loss").orderBy("step").collect()]
    want = [x if i * 10 < 200 else float(np.mean(v[max(0, i - 4) : i + 5])) for i, x in enumerate(v)]
    assert got == pytest.approx(want)
    s = logs.summarize(df, "run", "step", "loss").first()
    assert (s.last_step, s.tail_mean, s.median_value) == (590, round(float(np.mean(v[-8:])), 6), sorted(v)[30])
    m = spark.createDataFrame([("r", "a", 1.0), ("r", "b", 3.0), ("q", "b", 2.0), ("q", "c", 9.0)], "run string, source string, v double")
    assert {r.run: r.score for r in logs.weighted_score(m, "run", "source", "v", {"a": 0.6, "b": 0.2}).collect()} == pytest.approx({"r": 1.5, "q": 2.0})
    b = spark.createDataFrame([(1, 0.5), (2, 0.3), (3, 0.3)], "lr int, s double")
    assert tuple(logs.best_run(b, "lr", "s").first()) == (2, 0.3, False)
    y = spark.createDataFrame([("g", "a", 1.0), ("g", "b", 1.1), ("g", "c", 5.0)], "g string, label string, y double")
    assert [r.place for r in logs.spread(y, "g", "y", 1.0).orderBy("label").collect()] == [1.0, 2.0, 5.0]
    rate = [r[0] for r in spark.range(3).select(logs.cosine_rate(F.element_at(F.array(F.lit(0), F.lit(100), F.lit(1000)), (F.col("id") + 1).cast("int")), 1000, 1.0, 100)).collect()]
    assert rate == pytest.approx([0.01, 1.0, 0.1])


def test_blocks_see_their_neighbours(spark):
    rng = random.Random(4)
    rows = [(g, s, rng.random(), float(s * s % 13)) for g in ("a", "b", None) for s in sorted(rng.sample(range(0, 4000, 7), 90 if g else 3))]
    df = spark.createDataFrame(rows, "run string, step int, loss double, sec double")
    for size in (1, 4, 25, 1000):
        got = {(r.run, r.step): r.smoothed for r in logs.smooth(df, "run", "step", "loss", 4, 0, size).collect()}
        speed = {(r.run, r.step): r.tokens_per_s for r in logs.throughput(df, "run", "step", F.col("sec"), 10, 1.0, 1.0, size).collect()}
        assert len(got) == len(speed) == len(rows)
        for g in ("a", "b", None):
            mine = [r for r in rows if r[0] == g]
            for i, (_, s, _, sec) in enumerate(mine):
                part = [r[2] for r in mine[max(0, i - 4) : i + 5]]
                assert got[g, s] == pytest.approx(sum(part) / len(part))
                dt = sec - mine[i - 1][3] if i else 0
                assert speed[g, s] == (pytest.approx(10 * (s - mine[i - 1][1]) / dt, abs=1e-6) if dt > 0 else None)
    assert logs.smooth(df.limit(0), "run", "step", "loss").collect() == []


def test_upper_medians(spark):
    from quernel.operators.ordered import upper_medians

    rng = random.Random(6)
    groups = {"a": [rng.random() for _ in range(30_000)], "b": [float(rng.randrange(3)) for _ in range(501)], "c": [2.0], None: [1.0, 5.0], "d": [7.0] * 40 + [1.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs] + [("e", None), ("a", None)], "g string, v double")
    got = {r.g: r["median"] for r in upper_medians(df, "g", "v").collect()}
    assert got == {g: sorted(vs)[len(vs) // 2] for g, vs in groups.items()}


def test_resampled_means_have_the_right_spread(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(3, 2, 700), [3.0] * 300])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    m = np.array([r["mean"] for r in statistics.resampled_means(df, "v", 4000, seed=1).collect()])
    se = x.std() / math.sqrt(len(x))
    assert len(m) == 4000 and abs(m.mean() - x.mean()) < 4 * se / math.sqrt(4000) + 1e-9 and 0.95 < m.std() / se < 1.05
    assert abs(np.mean(np.abs(m - x.mean()) < 1.96 * se) - 0.95) < 0.015
    assert statistics.resampled_means(df.limit(0), "v", 10).collect() == []


def test_losses_and_gains(spark):
    df = spark.createDataFrame([("a", "base", 1.0), ("a", "base", 2.0), ("a", "new", 4.0), ("b", "new", None), ("b", "base", 3.0)], "r string, c string, v double")
    assert sorted(map(tuple, logs.source_losses(df, "r", "v").collect())) == [("a", 3, 7 / 3), ("b", 1, 3.0)]
    g = {r.r: r.asDict() for r in logs.gains(df, "r", "c", "v", ["base", "new"], "base").collect()}
    assert g["a"] == {"r": "a", "base": 1.5, "new": 4.0, "new_gain": 2.5} and g["b"]["new_gain"] is None


# -------------------------------------------------------------------------------------------------------- distributions
def test_nucleus(spark):
    rng = np.random.default_rng(11)
    rows = [(g, i, float(p)) for g in range(12) for i, p in enumerate(rng.dirichlet([0.7] * 9))]
    df = spark.createDataFrame(rows, "g int, i int, p double")
    for mass in (0.0, 0.3, 0.62, 0.999):
        want = set()
        for g in range(12):
            used = 0.0
            for _, i, p in sorted((-p, i, p) for h, i, p in rows if h == g):
                if used >= mass and used > 0:
                    break
                want.add((g, i))
                used += p
        assert {(r.g, r.i) for r in distribution.top_p(df, "g", "p", "i", mass).collect()} == want


def test_distributions(spark):
    df = spark.createDataFrame([(0, i, x) for i, x in enumerate([1.0, 3.0, 3.0, 1000.0])] + [(1, 0, -5.0)], "g int, i int, s double")
    p = distribution.softmax(df, "g", "s").groupBy("g").agg(F.sum("p").alias("t")).collect()
    assert all(r.t == pytest.approx(1) for r in p)
    assert sorted((r.g, r.i) for r in distribution.top_k(df, "g", "s", "i", 2).collect()) == [(0, 1), (0, 3), (1, 0)]
    u = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0), (0, 2, 2.0)], "g int, i int, p double")
    for x, want in ((0.0, 0), (0.25, 1), (0.49, 1), (0.5, 2), (1.0, 2)):
        assert distribution.inverse_cdf(u, "g", "p", "i", F.lit(x)).first().drawn == want
    e = distribution.cross_entropy(df.where("g = 0 AND i < 3"), "g", "s", F.col("i") == 1).first().loss
    assert e == pytest.approx(math.log(math.exp(1) + 2 * math.exp(3)) - 3)
    c = distribution.clip_scale(spark.createDataFrame([(3.0,), (4.0,)], "v double"), "v", 1.0).first()
    assert c.norm == 5.0 and c.scale == pytest.approx(0.2, rel=1e-5)
    v = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],)], "v array<double>")
    r = v.select(distribution.rotate(F.col("v"), F.lit(0)).alias("z"), distribution.rotate(F.col("v"), F.lit(7)).alias("r"), distribution.rms_norm(F.col("v")).alias("n"), distribution.cosine(F.col("v"), F.col("v")).alias("c")).first()
    assert r.z == [1.0, 2.0, 3.0, 4.0] and sum(x * x for x in r.r) == pytest.approx(30) and r.c == pytest.approx(1)
    assert sum(x * x for x in r.n) == pytest.approx(4, rel=1e-4)


# ------------------------------------------------------------------------------------------------------ sources, sinks
def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", None), (2, "b", 3.5)], "id int, t string, v double")
    sinks.write_parquet(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    sinks.write_jsonl(df.coalesce(1), str(tmp_path / "j"))
    sinks.append_log(df.coalesce(1), str(tmp_path / "j"))
    assert sorted(r.t for r in tables.jsonl(spark, str(tmp_path / "j"), df.schema).collect()) == ["b", "b", "é", "é"]
    sinks.write_report(df, str(tmp_path / "r.json"), "id")
    assert json.loads((tmp_path / "r.json").read_text())["1"] == {"t": "é", "v": None}
    (tmp_path / "c.csv").write_text("A,B\n1,x\n")
    assert tables.csv_named(spark, str(tmp_path / "c.csv"), ["n", "s"]).first().asDict() == {"n": "1", "s": "x"}
    con = sqlite3.connect(tmp_path / "d.sqlite")
    con.execute("create table q (col0 text, col1 real)")
    con.execute("insert into q values ('a', 2), (null, null)")
    con.commit()
    con.close()
    assert tables.sqlite_table(spark, str(tmp_path / "d.sqlite"), "q").collect() == [("a", 2.0), (None, None)]
    with pytest.raises(ValueError, match="more than"):
        tables.sqlite_table(spark, str(tmp_path / "d.sqlite"), "q", 1)
    left = sinks.unfinished(df, spark.createDataFrame([(1,), (1,)], "id int"), "id").collect()
    assert [r.id for r in left] == [2]
    assert sinks.checksums(spark, str(tmp_path), "c.csv").count() == 1
    sinks.as_view(df.select("t", "v"), ["a", "No."])
    assert spark.sql("SELECT `No.` FROM t WHERE a = 'b'").first()[0] == 3.5
    (tmp_path / "raw/stackexchange/dba.stackexchange.com").mkdir(parents=True)
    spark.createDataFrame([("x", 1, "l", 5)], "ThreadText string, Score int, ContentLicense string, Id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "raw/stackexchange/dba.stackexchange.com"))
    assert tables.raw_source(spark, str(tmp_path / "raw"), "stackexchange").first().site == "dba.stackexchange.com"


def test_latest(spark):
    rows = [(1, "a", 1), (1, "b", 2), (1, "c", None), (2, None, None), (None, "x", 1), (None, "x", 1), (None, "y", 1)]
    df = spark.createDataFrame(rows, "id int, v string, at int")
    got = sorted(((r.id, r.v) for r in tables.latest(df, "id", ["v"], "at").collect()), key=repr)
    assert got == [(1, "b"), (2, None), (None, "x"), (None, "y")]


def test_streams(spark, tmp_path):
    import datetime as dt

    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    rows = [(1, t(1), "a", 1.0), (1, t(2), "a", 1.0), (2, t(7), "b", 2.0), (3, t(8), "a", 3.0), (4, t(59), "a", 1.0)]
    df = spark.createDataFrame(rows, "id int, ts timestamp, kind string, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))

    def run(make, name):
        s = incremental.read_folder(spark, str(tmp_path / "in"), df.schema)
        q = make(s).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(60)
        return spark.table(name).collect()

    assert sorted(r.id for r in run(lambda s: incremental.first_deliveries(s, "id", "ts"), "first")) == [1, 2, 3, 4]
    w = run(lambda s: incremental.windowed_counts(s, "ts", "kind"), "windows")
    assert sorted((r.start.minute, r.kind, r.n, r.total) for r in w) == [(0, "a", 2, 2.0), (5, "a", 1, 3.0), (5, "b", 1, 2.0)]


def test_time_limit(spark):
    from quernel.session import within

    assert within(spark, 60, lambda: spark.range(5).count()) == (True, 5)
    ok, why = within(spark, 0.5, lambda: spark.range(1 << 40).selectExpr("sum(cos(id))").collect())
    assert not ok and why
    assert within(spark, 60, lambda: spark.sql("SELECT nothing"))[0] is False


def test_matvec(spark):
    m = spark.createDataFrame([([[1.0, 2.0], [0.0, -1.0]], [3.0, 4.0])], "m array<array<double>>, v array<double>")
    assert m.select(distribution.matvec(F.col("m"), F.col("v"))).first()[0] == [11.0, -4.0]
