import random
from collections import defaultdict

from pyspark.sql import functions as F

from quernel.functions.text import words
from quernel.operators import decontamination, similarity


def text(rng, n=300):
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


def test_signature_agreement(spark):
    rng = random.Random(1)
    a = text(rng)
    rows = [(1, a), (2, a + " tail here"), (3, text(rng)), (4, "one two"), (5, ""), (6, None)]
    sig = {r.id: r.s for r in spark.createDataFrame(rows, "id int, t string").select("id", similarity.signature(words(F.col("t")), "t").alias("s")).collect()}
    share = lambda x, y: sum(p == q for p, q in zip(sig[x], sig[y])) / 128
    assert share(1, 2) > 0.85 and share(1, 3) < 0.1 and sig[6] is None and len(sig[5]) == 128


def test_exact_keep_takes_the_first(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (5, None), (4, None), (6, "")], "id int, t string")
    assert sorted(r.id for r in similarity.exact_keep(df, "t", ["id"]).collect()) == [1, 2, 4, 6]


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(2)
    base = [text(rng) for _ in range(12)]
    rows, n = [], 0
    for b in base:
        for k in range(4):
            w = b.split()
            for _ in range(k):
                w[rng.randrange(len(w))] = "edit"
            rows.append((n, " ".join(w) + (" end" if k == 2 else "")))
            n += 1
    rows += [(n + i, base[0]) for i in range(40)] + [(200, None), (201, None), (202, "short text")]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {r.id: r for r in similarity.near_duplicates(df, "id", "t").collect()}
    assert len(got) == len(rows)
    groups = defaultdict(set)
    for r in got.values():
        groups[r.class_id].add(r.id)
    assert all(min(g) == c for c, g in groups.items())
    for i, b in enumerate(base):
        assert {got[4 * i + k].class_id for k in range(4)} == {4 * i}
    assert len(groups) == 12 + 2
    for g in groups.values():
        kept = [i for i in g if got[i].keep]
        assert len(kept) == 1
        longest = max(len(dict(rows)[i] or "") for i in g)
        assert len(dict(rows)[kept[0]] or "") == longest
    assert similarity.near_duplicates(df.limit(0), "id", "t").collect() == []


def test_all_similar_pairs_are_linked(spark):
    rng = random.Random(5)
    base = text(rng, 200).split()
    rows = []
    for i in range(60):  # like boilerplate: mutual similarities around 0.8
        w = list(base)
        for _ in range(2 + i % 2):
            w[rng.randrange(len(w))] = f"edit{i}"
        rows.append((i, " ".join(w)))
    sets = {i: set(similarity.shingle_hashes(t.split(), t)) for i, t in rows}
    pairs = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert 20 < len(pairs) < 60 * 59 / 2 * 0.9
    got = {r.id: r.links for r in similarity.near_duplicates(spark.createDataFrame(rows, "id long, t string"), "id", "t").collect()}
    assert got == {i: sum(i in p for p in pairs) for i in sets}


def test_no_link_is_lost_in_hot_buckets(spark, monkeypatch):
    rng = random.Random(11)
    base = text(rng, 120).split()
    rows = []
    for i in range(90):  # one bucket holds nearly all of them, in blocks
        w = list(base)
        for k in rng.sample(range(len(w)), i % 4):
            w[k] = f"own{i}"
        rows.append((i, " ".join(w)))
    rows += [(500 + i, text(rng, 60)) for i in range(10)]
    sets = {i: set(similarity.shingle_hashes(t.split(), t)) for i, t in rows}
    pairs = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    same = {t: min(i for i, u in rows if u == t) for _, t in rows}
    firsts = {i for i, t in rows if same[t] == i}
    links = {i: sum(i in p and p[0] in firsts and p[1] in firsts for p in pairs) for i in firsts}
    df = spark.createDataFrame(rows, "id long, t string")
    for block, few in ((7, 1), (256, 500_000)):
        monkeypatch.setattr(similarity, "BLOCK", block)
        monkeypatch.setattr(similarity, "BROADCAST_BUCKETS", few)
        got = {r.id: r.links for r in similarity.near_duplicates(df, "id", "t").collect()}
        assert {i: got[i] for i in firsts} == links


def test_near_duplicates_of_chosen_sources(spark):
    t = "one two three four five six seven eight nine ten"
    df = spark.createDataFrame([(1, t, "a"), (2, t, "a"), (3, t, "b"), (4, t, None), (5, None, "a"), (6, "", "a")], "id long, t string, s string")
    got = {r.id: (r.class_id, r.keep) for r in similarity.near_duplicates_of(df, "id", "t", "s", ["a"]).collect()}
    # a null text and an empty one are classes of their own
    assert got == {1: (1, True), 2: (1, False), 3: (3, True), 4: (4, True), 5: (5, True), 6: (6, True)}


def test_components_of_a_long_path(spark):
    nodes = spark.createDataFrame([(i,) for i in range(60)], "k long")
    edges = spark.createDataFrame([(i, i + 1) for i in range(39)] + [(50, 51)], "a long, b long")
    got = {r.k: r.component for r in similarity.components(nodes, edges).collect()}
    assert all(got[i] == 0 for i in range(40)) and got[51] == 50 and got[59] == 59


def test_decontamination(spark):
    whole = "what is the total name of that old river team today"
    long = "which of the many old harbour towns near the northern river had the largest survey"
    items = spark.createDataFrame([(1, whole), (2, "too short here"), (3, long), (4, whole), (5, None)], "item_id long, question string")
    docs = spark.createDataFrame(
        [(1, "x " + whole.upper() + " y", "a"), (2, "pad pad " + " ".join(long.split()[:13]), "a"), (3, " ".join(long.split()[:12]), "b"), (4, None, "b"), (5, "", None)],
        "doc_id long, text string, source string",
    )
    index = decontamination.eval_index(items)
    assert index.where(F.col("n") == 11).first()["item"] == 1 and index.where("n = 13").count() == len(long.split()) - 12
    hits = decontamination.hits(docs, index)
    assert sorted((r.doc_id, r.item, r.n, r.pos) for r in hits.collect()) == [(1, 1, 11, 1), (2, 3, 13, 2)]
    assert sorted(r.doc_id for r in decontamination.keep(docs, hits).collect()) == [3, 4, 5]
    rep = {r.source: (r.docs_in, r.removed, r.examples) for r in decontamination.report(docs, hits).collect()}
    assert rep == {"a": (2, 2, [1, 2]), "b": (2, 0, []), None: (1, 0, [])}
    assert decontamination.hits(docs, decontamination.eval_index(items.limit(0))).collect() == []
