"""The nine operators against brute force, on small tables with every odd case."""

import datetime as dt
import hashlib
import math
import random
import re
import unicodedata
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quernel import session
from quernel.llm import cutoff, leakage, mixing, packing, prose, provenance, repetition, tokenizing, toxicity
from quernel.operators import similarity

T0 = dt.datetime(2025, 1, 1)
T1 = dt.datetime(2025, 1, 2)
DOC = "row_id long, text string, source string, license string, origin string, loaded_at timestamp"


def docs(spark, rows):
    """``(row_id, text, source[, loaded_at])``"""
    return spark.createDataFrame([(r[0], r[1], r[2], None, "", r[3] if len(r) > 3 else T0) for r in rows], DOC)


def clashing(df):
    """Extra columns named like what operators use inside."""
    return df.select("*", *[F.lit("x").alias(n) for n in ("n", "k", "rank", "score", "tokens", "pos", "item", "size", "t", "d", "f", "key", "length")])


# ------------------------------------------------------------------------------------------------------ 1 repetition
RECORD = "tbl string, rec_id long, loaded_at timestamp, text string"
PLAIN = "The harbour opened early that morning. Nobody had expected so many boats. Most of them carried wool, and a few brought timber from the north."


def brute_repeat(text):
    """Share of characters in words covered by an earlier equal run of eight words."""
    w = [(m.group().casefold(), m.start()) for m in re.finditer(r"\w+", text)]
    hit = [False] * len(w)
    for i in range(len(w) - 7):
        run = [x[0] for x in w[i : i + 8]]
        if any([x[0] for x in w[j : j + 8]] == run for j in range(i)):
            hit[i : i + 8] = [True] * 8
    ends = [s for _, s in w[1:]] + [len(text)]
    return sum(e - s for (_, s), e, h in zip(w, ends, hit) if h) / max(1, len(text))


def test_repetition_shares():
    r = repetition.repetition(PLAIN + " " + PLAIN)
    assert 0.49 < r["all"] <= 0.51
    assert abs(r["ngrams"] - brute_repeat(PLAIN + " " + PLAIN)) < 1e-9
    assert repetition.repetition(PLAIN)["all"] == 0
    assert repetition.repetition("ha" * 200)["all"] > 0.9
    assert repetition.repetition("now " * 100)["all"] > 0.9
    lines = "\n".join(f"{i}) Each river carries a little sand to the sea" for i in range(9))
    assert repetition.repetition(lines)["all"] > 0.8
    near = "We answer within the hour in %s, so please call the office and ask for a free quote today.\n"
    assert repetition.repetition("".join(near % t for t in ("Rome", "Oslo", "Bern", "Lyon")))["all"] > 0.6
    for text in ("", "   ", "\n\n", "a", "。" * 50):
        assert 0 <= repetition.repetition(text)["all"] <= 1
    assert repetition.repetition("x y z " * 50_000)["all"] > 0.99  # long, linear time


def test_repetition_cases(spark):
    rows = [("web_pages", i, T0, PLAIN + f" Then {i} more came.") for i in range(30)]
    rows += [("web_pages", 100 + i, T0, PLAIN + f" It was {i}. " + "buy now " * 120) for i in range(10)]
    rows += [("threads", 1, T0, "click here\n" * 60), ("threads", 1, T0, "click here\n" * 60), ("threads", 2, None, None), ("threads", 3, T0, ""), ("threads", None, T0, "a")]
    got = repetition.cases(clashing(spark.createDataFrame(rows, RECORD)))
    assert got.columns == ["tbl", "rec_id"]
    found = [(r.tbl, r.rec_id) for r in got.collect()]
    assert sorted(found) == [("threads", 1)] + [("web_pages", 100 + i) for i in range(10)]
    assert repetition.cases(spark.createDataFrame([], RECORD)).collect() == []


def test_short_phrases_and_blocks_of_letters(spark):
    rng = random.Random(3)
    fill = [f"{a}{b}" for a in "ba be bi bo bu da de di do du fa fe fi fo".split() for b in "lor min sat ket rup".split()]
    stuffed = " ".join(" ".join(rng.choices(fill, k=5)) + " buy cheap running shoes online" for _ in range(40)) + "."
    blocks = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=14)) * 8 for _ in range(4))
    near = " ".join(f"The {a} house beside the old river stands quite alone tonight and {b}." for a, b in zip(fill[:20], fill[20:]))
    assert all(repetition.repetition(t)["all"] >= 0.4 for t in (stuffed, blocks, near))
    assert repetition.repetition(PLAIN)["all"] < 0.2
    # the newest sentence of a trigram is not the alike one
    first = "one two three four five six seven eight nine ten eleven twelve"
    other = "one two three " + " ".join(fill[:9])
    third = "one two three four five six seven zero nine ten eleven twelve"
    assert repetition.repetition(f"{first}. {other}. {third}.")["sentences"] > 0.25
    rows = [("web_pages", i, T0, PLAIN + f" Then {i} more came.") for i in range(30)] + [("web_pages", 100 + i, T0, "buy now " * 120) for i in range(10)]
    rows += [("web_pages", 200, T0, stuffed), ("web_pages", 201, T0, blocks)]
    got = {r.rec_id for r in repetition.cases(spark.createDataFrame(rows, RECORD)).collect()}
    assert got == {*range(100, 110), 200, 201}


def test_expectation_maximisation_tells_good_rules_from_bad():
    random.seed(1)
    n = Counter()
    for _ in range(4000):
        y = random.random() < 0.3
        v = [str(int(y if random.random() < a else not y)) if random.random() < 0.8 else "2" for a in (0.95, 0.9, 0.85, 0.55)]
        n["".join(v)] += 1
    post = repetition.expectation_maximisation(dict(n))
    assert post["1112"] > 0.95 and post["0002"] < 0.05
    assert post["1120"] > 0.5 and post["0021"] < 0.5  # the weak rule is outvoted
    assert repetition.expectation_maximisation({}) == {}


def test_the_posterior_decides_alone(spark):
    r = dict.fromkeys(("ngrams", "lines", "sentences", "periods", "letters", "all", "unbroken"), 0.0) | {"n_lines": 1, "packed": 0.6, "variety": 0.8, "favourite": 0.02}
    low = r | {"ngrams": 0.3, "all": 0.3, "packed": 0.3, "variety": 0.3, "favourite": 0.3}
    assert repetition.votes(low | {"all": 0.9}, 900) == repetition.votes(low, 900)  # no rule sees the whole share
    counts = Counter({"".join(map(str, repetition.votes(r, 900))): 900, "".join(map(str, repetition.votes(r | {"ngrams": 0.5, "packed": 0.3, "variety": 0.3, "favourite": 0.3}, 900))): 60})
    counts["".join(map(str, repetition.votes(low, 900)))] += 3
    post = repetition.expectation_maximisation(dict(counts))
    assert post["".join(map(str, repetition.votes(low, 900)))] > 0.5  # below a third, and still probable
    rng = random.Random(9)
    word = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 8))) for _ in range(400)]
    rows = [("web_pages", i, T0, " ".join(rng.choices(word, k=120)) + ".") for i in range(60)] + [("web_pages", 100 + i, T0, "buy cheap now " * 90) for i in range(8)]
    rows.append(("web_pages", 300, T0, " ".join(word[:60]) + " " + "".join(rng.choices("qrstuvwxyz", k=20)) * 40))
    got = {r.rec_id for r in repetition.cases(spark.createDataFrame(rows, RECORD)).collect()}
    assert got == {*range(100, 108), 300}


# ------------------------------------------------------------------------------------------------------ 2 provenance
FILE = "file_id long, content string, max_stars_repo_name string, loaded_at timestamp"
HAND = "-- totals for the week\nselect a.town, count(*) as n\nfrom places a\njoin visits v on v.place_id = a.id\nwhere v.day > 7\ngroup by a.town;\n"


def library(name):
    body = "".join(
        f"CREATE OR REPLACE FUNCTION {name}.f{i}(p_{a} bigint) RETURNS bigint AS $$\nDECLARE v_{b} bigint;\nBEGIN SELECT max(id) INTO v_{b} FROM {name}_{a}s WHERE {b}_id = p_{a};\nRETURN v_{b}; END;\n$$ LANGUAGE plpgsql;\n"
        for i, (a, b) in enumerate([("slot", "lease"), ("chain", "token"), ("shard", "epoch"), ("batch", "digest"), ("queue", "owner")])
    )
    return body + f"CREATE TABLE {name}_log (id bigserial, note text, made timestamptz, level int, who text);\n"


def test_file_evidence(spark):
    rows = [(1, HAND, "me/app"), (2, "-- Generated by tool 1.2. Do not edit\n" + HAND, "me/app"), (3, HAND.replace("week", "month"), None)]
    rows += [(10 + i, library("quickq"), f"user{i}/app{i}") for i in range(3)] + [(20, library("quickq"), "quickq/core"), (21, "-- vendored from a/b @ 12ab\n" + HAND, "z/z")]
    rows += [(30, "INSERT INTO t VALUES\n" + ",\n".join(f"({i}, 'x{i}', {i}.5)" for i in range(60)) + ";", "me/app")]
    rows += [(31, "id,name,day\n" + "\n".join(f"{i},Anna,2020-01-01" for i in range(50)), "me/app"), (32, '{"rows": [' + '{"a": "b"},' * 40 + "{}]}", "me/app")]
    rows += [(33, "create table x (id int, name text, day date);\ninsert into x values (1, 'a', null);\n" + HAND, "me/app")]
    rows += [(40, ";".join(f"select a{i},b from t where a{i}=b and c<d" for i in range(40)), "me/app")]
    rows += [(41, "-- the name column is a generated column\n-- do not edit the production copy directly\nselect id from t where id in (" + ", ".join(map(str, range(300))) + ");", "me/app")]
    rows += [(50, None, None), (51, "", "a/b"), (52, "   ", "a/b"), (53, "drop table x;", "a/b"), (54, "drop table x;", "c/d"), (None, HAND, "q/q")]
    df = spark.createDataFrame([(*r, T0) for r in rows] + [(2, rows[1][1], "me/app", T1)], FILE)
    e = {r.file_id: r.asDict() for r in provenance.file_evidence(clashing(df)).collect()}
    got = {i: sorted(k for k, v in r.items() if k != "file_id" and v) for i, r in e.items()}
    expected = {2: ["generated"], 10: ["vendored"], 11: ["vendored"], 12: ["vendored"], 21: ["vendored"], 30: ["data"], 31: ["data"], 32: ["data"], 40: ["minified"]}
    assert {i: v for i, v in got.items() if v} == expected
    assert sorted(r.file_id for r in provenance.machine_made(df).collect()) == sorted(expected)
    assert provenance.machine_made(spark.createDataFrame([], FILE)).collect() == []


def test_families_of_one_tool(spark):
    def crud(table, cols):
        args = ", ".join(f"@p{i} INT" for i in range(len(cols)))
        return "".join(
            f"CREATE PROCEDURE {table}_{k} {args} AS\n{verb}\nGO\n"
            for k, verb in (("Ins", f"INSERT INTO {table} ({', '.join(cols)}) VALUES ({', '.join('@p%d' % i for i in range(len(cols)))})"), ("Upd", f"UPDATE {table} SET " + ", ".join(f"{c} = @p{i}" for i, c in enumerate(cols)) + f" WHERE {cols[0]} = @p0"), ("Del", f"DELETE FROM {table} WHERE {cols[0]} = @p0"), ("Get", f"SELECT {', '.join(cols)} FROM {table} WHERE {cols[0]} = @p0"))
        ) * 2

    rows = [(i, crud(f"tab{i}", [f"c{i}_{j}" for j in range(5)]), f"u/r{i}", T0) for i in range(5)]
    rows += [(100 + i, HAND.replace("town", f"t{i}"), f"v/r{i}", T0) for i in range(5)]
    got = {r.file_id for r in provenance.file_evidence(spark.createDataFrame(rows, FILE)).where("family").collect()}
    assert got == {0, 1, 2, 3, 4}


def test_short_copies_and_names_of_the_repository(spark):
    lib = "create function quickq.take(p_slot bigint) returns bigint as 'select max(id) from quickq_leases where slot_id = p_slot' language sql;\nselect quickq.take(41), quickq.drop_lease('x7', 90) from quickq_slots where epoch > 12;\n"
    orders = "create table orders_a (orders_id int);\ncreate view orders_v as select orders_id from orders_a;\n"
    rows = [(i, lib, f"u{i}/app{i}", T0) for i in range(3)] + [(9, lib.replace("12", "13"), "w/app", T0), (10, lib, "quickq/core", T0)]
    rows += [(20 + i, "alter table orders add column status int;", f"u{i}/x", T0) for i in range(4)]
    rows += [(30, "-- vendored from a/b @ 12ab\n" + orders, "x/orders", T0), (31, orders, "x/orders", T0)]
    rows += [(40 + i, library("quickq") + "select orders_id, orders_day, orders_sum from quickq_log;\n", r, T0) for i, r in enumerate(["x/orders", "y/a", "z/b"])]
    got = {r.file_id for r in provenance.file_evidence(spark.createDataFrame(rows, FILE)).where("vendored").collect()}
    assert got == {0, 1, 2, 9, 30, 40, 41, 42}


def test_variants_of_one_tool_and_its_short_files(spark):
    def made(t, extra, times):
        base = f"CREATE PROCEDURE {t}_ins @a INT AS\nINSERT INTO {t} (a, b) VALUES (@a, @b)\nGO\nCREATE PROCEDURE {t}_del @a INT AS\nDELETE FROM {t} WHERE a = @a\nGO\n"
        return (base + extra.replace("#", t)) * times

    extras = ["GRANT EXECUTE ON #_ins TO PUBLIC\nGRANT EXECUTE ON #_del TO ops\nGO\n", "CREATE INDEX #_x ON # (b DESC)\nCREATE UNIQUE INDEX #_y ON # (a)\nGO\n", "ALTER TABLE # ADD CONSTRAINT #_p PRIMARY KEY (a)\nDROP VIEW IF EXISTS #_v\nGO\n"]
    rows = [(10 * v + i, made(f"tab{v}{i}", x, 8), f"u/r{v}{i}", T0) for v, x in enumerate(extras) for i in range(3)]
    rows += [(50, made("few", "", 2), "u/few", T0)] + [(100 + i, HAND.replace("town", f"t{i}"), f"v/r{i}", T0) for i in range(5)]
    sets = [set(provenance.shingles(provenance.tokens(made("t", x, 8))[1]).tolist()) for x in extras]
    assert all(len(a & b) / len(a | b) < 0.7 and 2 * len(a & b) > len(a) for a in sets for b in sets if a is not b)
    got = {r.file_id for r in provenance.file_evidence(spark.createDataFrame(rows, FILE)).where("family").collect()}
    assert got == {0, 1, 2, 10, 11, 12, 20, 21, 22, 50}


def test_components_without_all_pairs(spark, monkeypatch):
    rng = random.Random(21)
    sets = {}
    for family in range(3):
        base = rng.sample(range(1 << 32), 220)
        for i in range(300 if family == 0 else 40):
            sets[len(sets)] = rng.sample(base, 220 - rng.randint(0, 16)) + rng.sample(range(1 << 32), rng.randint(0, 8))
        for i in range(30):  # not alike, though they share bands
            sets[len(sets)] = rng.sample(base, 150) + rng.sample(range(1 << 32), 60)
    chain = rng.sample(range(1 << 32), 400)
    for i in range(12):
        sets[len(sets)] = chain[15 * i : 15 * i + 200]
    hashes = {k: np.unique(np.array(x, dtype=np.uint64)) for k, x in sets.items()}
    bands, sketches = provenance._banded(np.stack([provenance.signature(x) for x in hashes.values()]))
    buckets, up = defaultdict(list), {k: k for k in sets}
    for k in sets:
        for i, b in enumerate(bands[k]):
            buckets[i, b].append(k)

    def root(k):
        return k if up[k] == k else root(up[k])

    every = {(a, b) for x in buckets.values() for a in x for b in x if a < b}
    for a, b in every:
        if (n := len(set(sets[a]) & set(sets[b]))) / (len(sets[a]) + len(sets[b]) - n) >= 0.8:
            low, high = sorted((root(a), root(b)))
            up[high] = low
    linked = {root(k) for k in sets if root(k) != k}
    expected = {k: root(k) for k in sets if root(k) in linked}

    rows = [(k, bands[k].tolist(), sketches[k].tolist(), x.astype(np.uint32).view(np.int32).tolist()) for k, x in hashes.items()]
    nodes = spark.createDataFrame([*rows, rows[0], rows[5]], "k long, bands array<long>, sketch array<long>, grams array<int>")
    compared, alike = [], similarity._alike

    def counted(pairs, *rest):
        compared.append(pairs.distinct().count())
        return alike(pairs, *rest)

    monkeypatch.setattr(similarity, "_alike", counted)
    assert {r.k: r.component for r in similarity.clusters(nodes, provenance.SKETCH_FAR).collect()} == expected
    assert len(every) > 45_000 and 5 * sum(compared) < len(every)
    monkeypatch.setattr(similarity, "DRIVER_LINKS", 5)
    assert {r.k: r.component for r in similarity.clusters(nodes, provenance.SKETCH_FAR).collect()} == expected


def test_sketches_of_alike_sets_are_near():
    rng = random.Random(22)
    pairs = []
    for n in (20, 200, 2000):
        for _ in range(300):
            x = rng.sample(range(1 << 32), n + n // 8)
            pairs.append((x[:n], x[n // 8 :]))  # a Jaccard of 7 / 9 to 0.8
    sides = [provenance._banded(np.stack([provenance.signature(np.array(p[i], dtype=np.uint64)) for p in pairs]))[1].view(np.uint64) for i in (0, 1)]
    planes = sides[0] ^ sides[1]
    far = [sum(int(w).bit_count() for w in row) for row in planes[:, :2] | planes[:, 2:]]
    assert max(far) <= provenance.SKETCH_FAR and 18 < sum(far) / len(far) < 22


def test_evidence_leaves_no_files(spark):
    def kept():
        return sorted(x.name for x in Path(session._shared(spark).removeprefix("file:")).glob("scratch-*"))

    before = kept()
    provenance.file_evidence(spark.createDataFrame([(1, HAND, "me/app", T0), (2, None, None, T0)], FILE)).collect()
    assert kept() == before


def test_banners_are_learnt_from_the_corpus(spark, monkeypatch):
    monkeypatch.setattr(provenance, "_GENERATED", re.compile("(?!)"))
    rng = random.Random(8)
    remarks = ["dates are local time", "keep the order of columns", "nulls count as zero", "ask finance about refunds", "generated columns come last", "old rows live elsewhere"]
    tools = ["forgeddl", "rowpress", "tabmill", "sqlspin"]

    def body(i):
        return [f"create table t{i}_{j} (\n  id int primary key,\n  " + ",\n  ".join(f"{rng.choice('abcdefg')}{k} {rng.choice(['int', 'text', 'date'])}{rng.choice(['', ' not null'])}" for k in range(rng.randint(2, 6))) + "\n);\n" for j in range(rng.randint(2, 4))]

    rows, made = [], set()
    for i in range(160):
        parts = body(i)
        if i % 5 == 0:
            made.add(i)
            line = f"-- emitted by {rng.choice(tools)} {rng.randint(1, 9)}.{rng.randint(0, 9)}, changes vanish at the next run\n"
            parts = [line, *parts] if i % 10 else [*parts, line]
        else:
            at = rng.sample(range(len(parts) + 1), rng.randint(1, 2))
            for k in sorted(at, reverse=True):
                parts.insert(k, f"-- {rng.choice(remarks)}\n")
        rows.append((i, "".join(parts), f"u{i}/r", T0))
    rows += [(500, "select 1; -- quick look\n", "a/b", T0), (501, "select 2; -- quick look\n", "a/c", T0), (502, "select 3; -- quick look\n", "a/d", T0)]
    got = {r.file_id for r in provenance.file_evidence(spark.createDataFrame(rows, FILE)).where("generated").collect()}
    assert got == made


# ---------------------------------------------------------------------------------------------------------- 3 cutoff
TARGET = "source string, keep_frac double, mix_weight double, max_repeats int"


def score_of(text):
    t = (text or "").lower()
    names = ["select", "from", "where", "join", "having", "limit", "union"]
    patterns = [rf"\b{k}\b" for k in names] + [r"\bgroup\s+by\b", r"\border\s+by\b", r"\b(?:count|sum|avg|min|max)\s*\(", r"\bwith\s+\w+\s+as\s*\("]
    return sum(bool(re.search(p, t)) for p in patterns)


@pytest.mark.parametrize("sort_at_most", [5, 500_000])
def test_cutoffs_keep_exactly_the_target(spark, sort_at_most):
    random.seed(3)
    texts = ["", None, "select 1", "select a from b where c", "select count(*) from b group by c order by d limit 3", "with x as (select 1) select 2 from x"]
    rows = [(i, random.choice(texts), random.choice(["a", "a", "b", None, "no target"])) for i in range(400)]
    df = clashing(docs(spark, rows + rows[:50]))
    targets = spark.createDataFrame([("a", 0.37, 0.0, 1), ("b", 1.0, 0.0, 1), ("none", 0.5, 0.0, 1), ("zero", None, 0.0, 1)], TARGET)
    got = {r.source: r for r in cutoff.source_cutoffs(df, targets, sort_at_most=sort_at_most).collect()}
    tie = lambda i: int(hashlib.md5(str(i).encode()).hexdigest()[:12], 16)
    for s, frac in (("a", 0.37), ("b", 1.0)):
        keys = sorted(((score_of(t), tie(i)) for i, t, x in rows if x == s), reverse=True)
        k = math.ceil(round(frac * len(keys), 6))
        assert (got[s].n_records, got[s].n_target, got[s].n_kept) == (len(keys), k, k)
        assert (got[s].cutoff_score, got[s].cutoff_tie) == keys[k - 1]
    assert (got["none"].n_records, got["none"].n_kept, got["none"].cutoff_score) == (0, 0, None)
    assert got["zero"].n_kept == 0 and set(got) == {"a", "b", "none", "zero"}
    if sort_at_most == 5:
        whole, cutoff.MOST_SOURCES = cutoff.MOST_SOURCES, 2
        assert sorted(map(str, cutoff.source_cutoffs(df, targets, sort_at_most=5).collect())) == sorted(map(str, got.values()))
        cutoff.MOST_SOURCES = whole
        kept = cutoff.kept_rows(df, cutoff.source_cutoffs(df, targets, sort_at_most=5)).collect()
        assert Counter(r.source for r in kept) == {"a": got["a"].n_kept, "b": got["b"].n_kept}
    empty = cutoff.source_cutoffs(docs(spark, []), targets).collect()
    assert {r.n_kept for r in empty} == {0}


# --------------------------------------------------------------------------------------------------------- 4 packing
def naive_best_fit(lengths, cap):
    rooms = []
    for n in sorted((x for x in lengths if x > 0), reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            i = min(fits, key=lambda i: rooms[i])
            rooms[i] -= n
        else:
            rooms.append(cap - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(12))
def test_plan_equals_best_fit_by_item(seed):
    rng = random.Random(seed)
    cap = rng.choice([7, 20, 100])
    lengths = [rng.randint(1, cap) for _ in range(rng.randint(0, 300))]
    slots, used = packing.plan_best_fit(Counter(lengths), cap)
    assert used == naive_best_fit(lengths, cap)
    fill, ranks = defaultdict(list), defaultdict(list)
    for length, r0, n, each, first, start in slots:
        for r in range(n):
            fill[first + r // each].append((start + r % each * length, length))
            ranks[length].append(r0 + r)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(c)) for k, c in Counter(lengths).items()}
    for parts in fill.values():
        at = 0
        for start, n in sorted(parts):
            assert start >= at
            at = start + n
        assert at <= cap


def test_packing_whole_table(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 7)  # hot lengths are ranked in several buckets
    random.seed(5)
    rows = [(i, "x" * random.choice([3, 3, 3, 10, 17, 55]), "a") for i in range(200)] + [(900, "", "a"), (901, None, "a"), (902, "y" * 150, "a"), (903, "z" * 100, None)]
    packs = spark.createDataFrame([(1, 50), (2, 100), (3, None), (None, 10)], "pack_id int, capacity_chars long")
    got = packing.pack_texts(clashing(docs(spark, rows + rows[:20])), packs).collect()
    for pack, cap in ((1, 50), (2, 100)):
        mine = [r for r in got if r.pack_id == pack]
        by_row = defaultdict(list)
        for r in mine:
            by_row[r.row_id].append(r)
        assert set(by_row) == {i for i, *_ in rows}
        for i, t, _ in rows:
            pieces = sorted(by_row[i], key=lambda r: r.piece)
            assert sum(r.length for r in pieces) == len(t or "")
            assert len(pieces) == max(1, -(-len(t or "") // cap))
        assert by_row[900][0].container_id == 0 and by_row[901][0].container_id is None
        space = defaultdict(list)
        for r in mine:
            if r.length:
                space[r.container_id].append((r.start, r.length))
        for parts in space.values():
            at = 0
            for s, n in sorted(parts):
                assert s >= at
                at = s + n
            assert at <= cap
        lengths = [n for _, t, _ in rows for n in [cap] * (len(t or "") // cap) + [len(t or "") % cap]]
        assert len(space) == naive_best_fit(lengths, cap) == max(space) + 1
    assert packing.pack_texts(docs(spark, []), packs).collect() == []
    assert {r.pack_id for r in got} == {1, 2}


# ---------------------------------------------------------------------------------------------------------- 5 mixing
def test_mixture(spark):
    rows = [(i, "x" * 10, "big") for i in range(2000)] + [(5000 + i, "y" * 5, "small") for i in range(100)] + [(9000, None, "big"), (9001, "q", None), (9002, "q", "untargeted")]
    targets = spark.createDataFrame([("big", 0.0, 0.8, 1), ("small", 0.0, 0.2, 3), ("absent", 0.0, 0.5, 9), (None, 0.0, 0.5, 9), ("nil", 0.0, None, None)], TARGET)
    df = clashing(docs(spark, rows + rows[:100]))
    got = mixing.mixture(df, targets).collect()
    assert Counter(r.row_id for r in got).most_common(1)[0][1] == 1
    caps = {"big": 1, "small": 3}
    assert all(1 <= r.copies <= caps[r.source] for r in got)
    shares = {r.source: r for r in mixing.mixture_shares(df, targets).collect()}
    assert abs(shares["big"].actual_share - 0.8) < 0.05 and abs(shares["small"].actual_share - 0.2) < 0.05
    assert shares["small"].rate == 3.0 and shares["absent"].mixed_size == 0 and set(shares) == {"big", "small", "absent", "nil"}
    assert sorted(got) == sorted(mixing.mixture(df.repartition(7), targets).collect())
    half = lambda seed: {r.row_id for r in mixing.mixture(df, targets, total=1000.0, seed=seed).collect() if r.source == "big"}
    a, b = half(1), half(2)
    assert a == half(1) and len(a & b) < 0.3 * min(len(a), len(b)) and len(a) > 40
    assert all(r.mixed_size == 0 for r in mixing.mixture_shares(docs(spark, []), targets).collect())


# ----------------------------------------------------------------------------------------------------------- 6 prose
TABLE = "Anna | 12 | yes\nBert | 17 | no\nCarl | 44 | yes\n" * 6


@pytest.mark.parametrize("seed", range(8))
def test_chunks_give_the_counts_of_the_whole(seed):
    rng = random.Random(seed)
    text = "".join(rng.choice(["word ", "the ", "\n", "\n\n", "Ünï-côdé ", "12.5", "| ", ". ", "supercalifragilistic", "\r\n", "\t", "“q” "]) for _ in range(rng.randint(0, 300)))
    whole = prose.State.of(text).finish()
    for size in (1, 2, 5, 13, 1000):
        parts = [prose.State.of(text[i : i + size]) for i in range(0, len(text), size)] or [prose.State.of("")]
        while len(parts) > 1:  # any tree
            i = rng.randrange(len(parts) - 1)
            parts[i : i + 2] = [parts[i].then(parts[i + 1])]
        assert parts[0].finish() == whole


def test_no_cut_changes_the_counts():
    bits = ["word ", "the ", "\n", "\n\n", " ", "Ã", "Ã ", "â", "€", "â€", "://", "www.", ". ", '."', '!") ', ")", "a1the", "|", "x" * 70, "é" * 30, "漢字。", "Да "]
    for seed in range(10_000):
        rng = random.Random(seed)
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        whole, size = prose.State.of(text).finish(), rng.choice([1, 2, 3, 7, 40])
        parts = [prose.State.of(text[i : i + size]) for i in range(0, len(text), size)] or [prose.State.of("")]
        while len(parts) > 1:
            i = rng.randrange(len(parts) - 1)
            parts[i : i + 2] = [parts[i].then(parts[i + 1])]
        assert parts[0].finish() == whole, (text, size)


def test_states_are_bounded():
    import pickle

    part = prose.State.of("QmFzZTY0" * 8192)
    state = part
    for _ in range(10):  # 64 MB without a blank
        state = state.then(state)
    assert len(pickle.dumps(state)) < 2000
    got = state.finish()
    assert (got["chars"], got["words"], got["prose"]) == (65536 * 1024, 1, 0)


def test_parts_of_one_line_and_other_languages():
    listed = ", ".join(f"{a} {b}" for a in ("running", "walking", "hiking", "trail", "winter") for b in ("shoes", "boots", "socks", "laces", "soles", "gear")) + " "

    def share(text):
        t = prose.State.of(text).finish()
        return t["prose"] / t["solid"]

    assert share((PLAIN + " ") * 3 + listed * 2) < 0.5 < share((PLAIN + " ") * 5 + listed)
    for good in (
        "Port otworzył się wcześnie rano. Nikt nie spodziewał się tylu łodzi.", "Liman sabah erkenden açıldı. Kimse bu kadar çok tekne beklemiyordu.",
        "Гавань открылась рано утром. Никто не ожидал столько лодок.", "Satama avattiin varhain aamulla. Kukaan ei odottanut niin monta venettä.",
    ):
        assert share(good) > 0.9, good
    for junk in ("яблоко, груша, слива, вишня, арбуз, дыня, персик, инжир", "Главная\nНовости\nКонтакты\nВойти", "首页\n关于我们\n联系\n新闻", "вгд ждз клм. нпр стф хцч шщв. бвг джз.", "Xqzt vrkp wmnb plgh. Tzzk bcdf ghjk lmnp."):
        assert share(junk) < 0.5, junk


def test_text_counts_of_long_texts(spark):
    long = (PLAIN + "\n" + TABLE) * 40
    rows = [(1, long, "a"), (2, "x" * 3000, "a"), (3, None, "a"), (4, "", "a"), (5, PLAIN, "a"), (None, PLAIN, "a")]
    small = {r.row_id: r.asDict() for r in prose.text_counts(docs(spark, rows), chunk=64).collect()}
    for i, t, _ in rows:
        assert {k: small[i][k] for k in prose.TOTALS} == prose.State.of(t or "").finish()


def test_junk_found(spark):
    junk = {1: TABLE, 2: "http://a.example/b/1\nhttp://c.example/d/2\n" * 9, 3: "QmFzZTY0IGlzIGEgZ3JvdXAgb2YgdHdvIGJpbmFyeQ\n" * 8, 4: "xqzt vrkp wmnb plgh tzzk\n" * 9, 5: PLAIN + "\n" + TABLE * 2}
    good = {11: PLAIN, 12: PLAIN.upper(), 13: PLAIN.replace(" ", "\n", 3), 14: "Der Hafen war früh offen. Niemand hatte so viele Boote erwartet.", 15: "Le port était ouvert tôt. Personne ne s'attendait à tant de bateaux.", 16: "It rained.", 20: "Το λιμάνι άνοιξε νωρίς το πρωί. Κανείς δεν περίμενε τόσα πλοία.", 21: "港口清晨很早就开放了。没有人预料到会有这么多船只。", 17: PLAIN * 3 + "\n" + TABLE[:60], 18: None, 19: ""}
    rows = [(i, t, "fineweb_edu") for i, t in {**junk, **good}.items()] + [(50, TABLE, "stack_sql"), (51, TABLE, None), (1, TABLE, "fineweb_edu")]
    got = prose.junk_found(clashing(docs(spark, rows))).collect()
    assert sorted(r.row_id for r in got) == sorted(junk)
    assert prose.junk_found(docs(spark, [])).collect() == []
    q = {r.row_id: r for r in prose.text_quality(docs(spark, rows)).collect()}
    assert q[18].n_chars == 0 and q[18].few_words and not q[18].not_prose and len(q) == len(junk) + len(good) + 2


# ------------------------------------------------------------------------------------------------------- 7 tokenizer
def test_prefix_encoder_equals_the_reference_encoder():
    tiktoken = pytest.importorskip("tiktoken")
    pt = pytest.importorskip("public_tokenizers")
    e = tokenizing.PrefixEncoder.load(tokenizing.vocabulary_path())
    ref = tiktoken.Encoding("own", pat_str=pt.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    rng = random.Random(2)
    texts = ["", " ", "a", "<|endoftext|>", "don't  stop\n\n", "é漢字🙂​", "=" * 500, "a" * 3000, "\r\n\t x"]
    texts += ["".join(rng.choice("abcdeinrst    \n'.,0123éß漢🙂") for _ in range(rng.randint(0, 80))) for _ in range(500)]
    for t in texts:
        ids = e.encode(t)
        assert ids == ref.encode_ordinary(t)
        assert ref.decode(ids) == t
    a, b = b"internationalization", b"internationalisation!"
    assert e.ids(b, e.edited(a, e.table(a), b)) == e.ids(b)
    assert e.extend(a, e.table(a[:7])) == e.table(a)


def test_tables_near_an_edit():
    pytest.importorskip("public_tokenizers")
    e = tokenizing.PrefixEncoder.load(tokenizing.vocabulary_path())
    rng = random.Random(3)
    made = []
    plain = e._entry
    e._entry = lambda data, last: (made.append(1), plain(data, last))
    for _ in range(60):
        old = "".join(rng.choice("abcdefghij") for _ in range(1500)).encode()
        i = rng.randrange(1500)
        new = old[:i] + "".join(rng.choice("xyz") for _ in range(rng.randrange(4))).encode() + old[i + rng.randrange(4) :]
        table = e.table(old)
        made.clear()
        assert e.edited(old, table, new) == e.table(new)
    made.clear()
    e.edited(old, table, old[:700] + b"q" + old[701:])
    assert len(made) < 400 + e.longest  # not the 800 bytes behind the edit


def test_encode_documents(spark):
    pytest.importorskip("public_tokenizers")
    df = clashing(spark.createDataFrame([(1, "hello world"), (2, None), (3, ""), (1, "hello world"), (None, "x")], "doc_id long, text string"))
    got = tokenizing.encode_documents(df)
    assert got.columns == ["doc_id", "ids"]
    rows = sorted(((r.doc_id, r.ids) for r in got.collect()), key=repr)
    assert rows == [(1, [31373, 995]), (1, [31373, 995]), (2, []), (3, []), (None, [87])]
    assert tokenizing.encode_documents(df.limit(0)).collect() == []


# --------------------------------------------------------------------------------------------------------- 8 leakage
def brute_leaks(documents, questions):
    words = lambda t: re.findall(r"\w+", unicodedata.normalize("NFC", unicodedata.normalize("NFC", t or "").casefold()))
    out = set()
    for i, t in documents:
        w = words(t)
        for q, s in questions:
            v = words(s)
            n = min(13, len(v))
            if n >= 8 and any(w[a : a + n] == v[b : b + n] for a in range(len(w) - n + 1) for b in range(len(v) - n + 1)):
                out.add((i, q))
    return out


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["what", "is", "the", "total", "of", "name", "when", "año", "Été", "river_1", "42", "for", "team", "in", "and"]
    questions = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 8, 11, 13, 14, 20])))) for i in range(40)]
    questions += [(100, questions[0][1]), (101, None), (102, ""), (103, "Too short a question")]
    documents = []
    for i in range(120):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if i % 2:
            q = re.findall(r"\w+", rng.choice(questions[:40])[1])
            cut = q[: rng.choice([len(q), max(1, len(q) - 1), 7])]
            base[5:5] = [w.upper() if rng.random() < 0.5 else unicodedata.normalize("NFD", w) for w in cut]
        documents.append((i, rng.choice([" ", "  ", ", ", "\n"]).join(base)))
    documents += [(500, None), (501, ""), (0, documents[0][1]), (None, documents[1][1])]
    d = clashing(spark.createDataFrame(documents, "doc_id long, text string"))
    q = clashing(spark.createDataFrame(questions, "item_id long, question string"))
    got = [(r.doc_id, r.item_id) for r in leakage.passages_found(d, q).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_leaks(documents, questions) and len(got) > 20
    assert leakage.passages_found(d.limit(0), q).collect() == [] and leakage.passages_found(d, q.limit(0)).collect() == []


def test_edited_copies_score_high(spark):
    q = [(1, "Which harbour belongs to the longest river that was measured by the old survey in 1890 near Oslo?")]
    d = [(1, "They asked: which harbour belongs to the very longest river that was measured by an old survey in 1890 near Oslo"), (2, PLAIN)]
    got = leakage.leaks(spark.createDataFrame(d, "doc_id long, text string"), spark.createDataFrame(q, "item_id long, question string")).collect()
    assert [(r.doc_id, r.item_id, r.exact) for r in got] == [(1, 1, False)] and got[0].score > 0.7


def edited(rng, tokens, share, spare):
    """The words with so large a share of them replaced, left out or doubled by a strange one."""
    out = list(tokens)
    for i in sorted(rng.sample(range(len(out)), round(share * len(out))), reverse=True):
        out[i : i + 1] = rng.choice([[rng.choice(spare)], [rng.choice(spare)], [rng.choice(spare)], [], [out[i], rng.choice(spare)]])
    return out


@pytest.mark.parametrize(("length", "share", "least"), [(13, 0.1, 0.97), (13, 0.2, 0.9), (20, 0.2, 0.9)])
def test_recall_of_edited_copies(spark, length, share, least):
    rng = random.Random(length)
    vocabulary = ["".join(rng.choices("bcdfglmnprst", k=2)) + rng.choice("aeiou") + str(i) for i in range(3000)]
    opening = [["what", "is", "the", "total"], ["how", "many", "of", "the"], ["name", "the", "highest", "value"]]
    questions = [(i, rng.choice(opening) + rng.choices(vocabulary, k=length - 4)) for i in range(120)]
    documents = []
    for i, (_, q) in enumerate(questions):
        documents.append((i, " ".join(rng.choices(vocabulary, k=40) + edited(rng, q, share, vocabulary) + rng.choices(vocabulary, k=40))))
    documents += [(1000 + i, " ".join(rng.choice(opening) + rng.choices(vocabulary, k=60))) for i in range(300)]
    d = spark.createDataFrame(documents, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(d, spark.createDataFrame([(i, " ".join(q)) for i, q in questions], "item_id long, question string")).collect()}
    assert sum((i, i) in got for i in range(120)) / 120 >= least
    assert all(a == b for a, b in got)


def test_questions_in_several_passes(spark, monkeypatch):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(60)]
    questions = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(8, 16)))) for i in range(30)]
    documents = [(i, " ".join(rng.choices(vocabulary, k=20)) + " " + questions[i % 30][1]) for i in range(45)]
    d, q = spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(questions, "item_id long, question string")
    whole = sorted(map(tuple, leakage.leaks(d, q).collect()))
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 100)
    assert sorted(r[:2] for r in whole if r[3]) == sorted(brute_leaks(documents, questions))
    assert {r[:2] for r in whole if r[3]} == {(r.doc_id, r.item_id) for r in leakage.passages_found(d, q).collect()}


def test_smith_waterman_by_hand():
    assert list(leakage.smith_waterman([["a", "b", "c"]], [["x", "a", "b", "c", "y"]])) == [1.0]
    assert list(leakage.smith_waterman([["a", "b", "c", "d"]], [["a", "b", "x", "d"]])) == [pytest.approx((2 + 2 - 1 + 2) / 8)]
    assert len(leakage.smith_waterman([], [])) == 0


# -------------------------------------------------------------------------------------------------------- 9 toxicity
LABEL = "doc_id long, rater string, verdict string, rated_at timestamp"


def toxic_corpus():
    rng = random.Random(6)
    insults = ["you are a worthless glorp and nobody wants you", "shut up you stupid glorp", "go away filthy snarg", "what a pathetic snarg you are"]
    neutral = ["the river rises in spring", "boats carry timber and wool", "a survey measured the old bridge", "children draw the harbour at noon", "the glorp filter hides words in the forum"]
    out = []
    for i in range(2400):
        parts = [rng.choice(neutral) for _ in range(6)]
        bad = i % 16 == 0
        if bad:
            parts.insert(rng.randrange(6), rng.choice(insults).replace("snarg", rng.choice(["snarg", "s-n-a-r-g", "sn​arg", "snаrg", "snaaaarg"])))
        out.append((i, ". ".join(parts), rng.choice(["a", "b", None]), bad))
    return out


def test_held_out_accuracy(spark):
    rows = toxic_corpus()
    rng = random.Random(1)
    labels = [(i, "r1", ("unsafe" if b else "safe") if rng.random() > 0.05 else "safe", T0) for i, _, _, b in rows if i < 1200]
    labels += [(0, "r2", "unsafe", T0), (1, None, None, None), (2, "r3", "unsure", T0), (None, "r1", "safe", T0), (9999, "r1", "unsafe", T0)]
    df = clashing(spark.createDataFrame([(i, t, s) for i, t, s, _ in rows] + [(7000, None, "a"), (7001, "", None), (None, "the river", "a")], "doc_id long, text string, source string"))
    lab = spark.createDataFrame(labels, LABEL)
    got = {r.doc_id: r for r in toxicity.score(df, toxicity.train(df, lab)).collect()}
    held = [(got[i].flagged, b) for i, _, _, b in rows if i >= 1200]
    assert sum(f == b for f, b in held) / len(held) > 0.97
    assert not got[7000].flagged and not got[7001].flagged and got[7000].score == 0 and len(got) == 2403
    rates = {r.source: r for r in toxicity.source_rates(df, lab).collect()}
    assert None in rates and sum(r.docs for r in rates.values()) == 2403
    assert toxicity.flagged(df, lab.limit(0)).collect() == [] and toxicity.flagged(df.limit(0), lab).collect() == []


def test_spellings_become_one():
    assert toxicity.words("L-O-S-E-R p r i c k mo​ron $h1t loseeeer bitсh 42 a b") == ["loser", "prick", "moron", "shit", "loser", "bitch", "a", "b"]
    m = toxicity.Model({"nude": 5.0, "naked": 5.0})
    assert m.resolve(toxicity.words("n**e n***d f**k")) == ["nude", "naked", "f**k"]


def test_maximal_segments_equal_brute_force():
    rng = random.Random(0)
    for _ in range(300):
        x = [rng.choice([-2, -1, -0.5, 1, 2, 3]) for _ in range(rng.randint(0, 12))]

        def split(lo, hi):
            """The best segment, the shortest of equals, then both sides of it."""
            best = max(((sum(x[i:j]), -(j - i), -i) for i in range(lo, hi) for j in range(i + 1, hi + 1)), default=(0, 0, 0))
            if best[0] <= 0:
                return []
            i = -best[2]
            j = i - best[1]
            return split(lo, i) + [(best[0], i, j)] + split(j, hi)

        got = toxicity.maximal_segments(x)
        assert sum(s for s, _, _ in got) == pytest.approx(sum(s for s, _, _ in split(0, len(x))))
        assert max((s for s, _, _ in got), default=0) == pytest.approx(max((s for s, _, _ in split(0, len(x))), default=0))
