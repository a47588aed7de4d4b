import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from quernel.operators import dialect, evaluation, rendering

COND = "array<struct<col_ix:int,op:int,val:string>>"


def test_rendering(spark):
    row = spark.createDataFrame(
        [(["Player", 'No. "x"', " ", "Team"], ["text", "real", "text", "text"], 0, 3, [(3, 0, "Butler CC (KS)"), (1, 1, "it's 20")])],
        f"header array<string>, types array<string>, sel int, agg int, conds {COND}",
    )
    c = F.col
    r = row.select(
        rendering.column_names(c("header")).alias("n"), rendering.schema_text(c("header"), c("types")).alias("s"),
        rendering.to_sql(c("header"), c("sel"), c("agg"), c("conds")).alias("q"),
    ).first()
    assert r.n == ["Player", 'No. "x"', "col2", "Team"]
    assert r.s == 'CREATE TABLE t ("Player" TEXT, "No. ""x""" REAL, "col2" TEXT, "Team" TEXT);'
    assert r.q == 'SELECT COUNT("Player") FROM t WHERE "Team" = \'Butler CC (KS)\' AND "No. ""x""" > \'it\'\'s 20\';'


def test_lexing(spark):
    texts = ["""SELECT "Driver's Age" FROM t WHERE "a""b" = 'It''S "Q"';""", "x 'open", '"abc""', "", "''"]
    got = spark.createDataFrame([(t,) for t in texts], "q string").select(dialect.lex(F.col("q")).alias("p"), dialect.lower_literals(F.col("q")).alias("l")).collect()
    assert [(p.kind, p.text, p.closed) for p in got[0].p if p.kind != "code"] == [("ident", "Driver's Age", True), ("ident", 'a"b', True), ("string", "It'S \"Q\"", True)]
    assert got[0].l == """SELECT "Driver's Age" FROM t WHERE "a""b" = 'it''s "q"';"""
    assert [(p.kind, p.text, p.closed) for p in got[1].p][1] == ("string", "open", False)
    assert [(p.kind, p.text, p.closed) for p in got[2].p] == [("ident", 'abc"', False)]
    assert got[3].p == [] and [(p.text, p.closed) for p in got[4].p] == [("", True)]
    u = spark.createDataFrame([('SELECT "b" FROM "t" WHERE "a" = \'"z"\'', ["a"])], "q string, c array<string>")
    assert u.select(dialect.unknown_identifiers(F.col("q"), F.col("c"))).first()[0] == ["b"]


@pytest.mark.parametrize(
    "sql",
    [
        'SELECT "x" FROM t', 'SELECT MAX("a" FROM t', 'SELECT "a" FROM other', 'SELECT "a" FROM t WHERE "a" != \'1\'', 'SELECT "a" FROM t WHERE "a" = \'open',
        "DROP TABLE t", "", 'SELECT "a" FROM t WHERE "a" = \'1\' OR "a" = \'2\'',
    ],
)
def test_unsupported(sql):
    with pytest.raises(dialect.Unsupported):
        dialect.parse(sql, ["a", "b c"])


def test_parsing():
    assert dialect.parse("""select avg( "b c" ) from T where "a" > '1' and "a"='x''y' ; """, ["a", "b c"]) == (1, 5, [(0, 1, "1"), (0, 0, "x'y")])
    assert dialect.parse('SELECT "a" FROM t', ["a", "a"]) == (0, 0, [])


FULL = [
    """SELECT "Name" FROM t;""", """SELECT COUNT("Näme") FROM t WHERE "Name" = 'año ''x''';""",
    """SELECT "Name" FROM t WHERE "Name" > '1' AND "Näme" < '2';""",
]


@pytest.mark.parametrize("sql", FULL)
def test_every_prefix_is_accepted(sql):
    g = dialect.Grammar(["Name", "Näme", "Na"], "What is 1, 2 and AÑO 'x' here?")
    data = sql.encode()
    assert g.check(data) == "complete"
    assert all(g.check(data[:i]) == "prefix" for i in range(len(data)))


@pytest.mark.parametrize(
    "sql",
    [
        "select", 'SELECT "Other"', 'SELECT "Name" FROM t; ', 'SELECT "Name" FROM t WHERE "Name" = \'absent', 'SELECT "Name" FROM t WHERE "Name" = \'\';',
        'SELECT  "Name"', 'SELECT "Name" FROM t WHERE "Name" = \'1\' OR',
    ],
)
def test_invalid_is_rejected(sql):
    assert dialect.Grammar(["Name"], "What is 1?").check(sql.encode()) == "invalid"


def test_grammar_bytes_and_limits():
    g = dialect.Grammar(["a"])
    assert g.check(b"SELECT \"a\" FROM t WHERE \"a\" = '\x80") == "invalid"
    six = " AND ".join(["\"a\" = '1'"] * 6)
    assert g.check(f'SELECT "a" FROM t WHERE {six};'.encode()) == "complete"
    assert g.check(f"SELECT \"a\" FROM t WHERE {six} AND".encode()) == "invalid"
    assert g.check(b"SELECT \"a\" FROM t WHERE \"a\" = '" + b"x" * 101) == "invalid"


def test_execution_equals_sqlite(spark):
    rng = random.Random(3)
    names = ["name", "n", "team"]
    rows = [(rng.choice(["ann", "bob", "12 km", "9", None]), rng.choice([1.0, 5.0, 10.0, -2.5, None]), rng.choice(["duke", "butler cc (ks)", "x'y"])) for _ in range(60)]
    con = sqlite3.connect(":memory:")
    con.execute("create table t (name text, n real, team text)")
    con.executemany("insert into t values (?, ?, ?)", rows)
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, name string, n double, team string")
    data = dialect.cells(df, "t1", "id", names).cache()
    queries = []
    for q in range(60):
        conds = [(rng.randrange(3), rng.randrange(3), rng.choice(["5", " 1e1 ", "1,200", "duke", "Ann", "9", "-2.5", "zzz", "x'y"])) for _ in range(rng.randrange(3))]
        queries.append((q, "t1", rng.randrange(3), rng.randrange(6), conds))
    df_q = spark.createDataFrame(queries + [(999, "unknown", 0, 0, [])], f"query_id int, table_id string, sel int, agg int, conds {COND}")
    batch = {r.query_id: r.result for r in dialect.execute_all(df_q, data).collect()}
    assert 999 not in batch

    def plain(v):
        if v is None:
            return "NULL"
        try:
            return f"{float(v):.6f}" if not isinstance(v, str) else v
        except ValueError:
            return v

    def number(x):
        try:
            return f"{float(x):.6f}"
        except ValueError:
            return x

    for k, (q, _, sel, agg, conds) in enumerate(queries):
        col = names[sel]
        where = " and ".join(f"{names[c]} {'=><'[o]} '" + v.lower().replace("'", "''") + "'" for c, o, v in conds)
        sql = f"select {f'{rendering.AGGREGATES[agg]}({col})' if agg else col} from t" + (f" where {where}" if conds else "")
        want = sorted(number(plain(r[0])) for r in con.execute(sql).fetchall())
        assert sorted(number(x) for x in batch[q]) == want, sql
        if k < 12:
            one = [r.result for r in dialect.execute(df, names, sel, agg, conds).collect()]
            assert sorted(number(plain(x)) for x in one) == want, sql


def test_grounding(spark):
    values = spark.createDataFrame([("t", 0, "gentoo"), ("t", 1, "torgersen"), ("t", 1, "dream"), ("t", 0, "long gentoo bird")], "table_id string, col_ix int, txt string")
    rows = [(1, "t", 0, 0, "Gentoo penguin"), (2, "t", 0, 0, "Torgersen island"), (3, "t", 0, 0, "gentoo"), (4, "t", 0, 1, "Gentoo penguin"), (5, "t", 0, 0, "the long gentoo bird"), (6, "t", 0, 0, "dreamy")]
    got = {r.id: (r.col_ix, r.val) for r in dialect.ground(spark.createDataFrame(rows, "id int, table_id string, col_ix int, op int, val string"), values).collect()}
    assert got == {1: (0, "gentoo"), 2: (1, "torgersen"), 3: (0, "gentoo"), 4: (0, "Gentoo penguin"), 5: (0, "long gentoo bird"), 6: (0, "dreamy")}


GOLD = (0, 0, [(1, 0, "X "), (2, 1, "5")])
CASES = [
    (GOLD, None), ((0, 0, [(2, 1, "5"), (1, 0, "x")]), None), (None, "invalid"), ((1, 0, GOLD[2]), "select column"), ((0, 3, GOLD[2]), "aggregation"),
    ((0, 0, [(3, 0, "x"), (2, 1, "5")]), "condition column"), ((0, 0, [(1, 0, "x"), (3, 1, "5")]), "condition column"), ((0, 0, [(1, 0, "x"), (2, 2, "5")]), "operator"),
    ((0, 0, [(1, 0, "y"), (2, 1, "5")]), "value"), ((0, 0, [(1, 0, "x")]), "missing condition"), ((0, 0, [*GOLD[2], (0, 0, "z")]), "extra condition"),
    ((0, 0, [(9, 0, "q")]), "multiple"), ((1, 2, GOLD[2]), "multiple"),
]


def test_diagnosis(spark):
    kind = f"struct<sel:int,agg:int,conds:{COND}>"
    df = spark.createDataFrame([(i, p or (None, None, None), GOLD) for i, (p, _) in enumerate(CASES)], f"i int, p {kind}, g {kind}")
    got = df.select("i", evaluation.diagnose(F.col("p"), F.col("g")).alias("c"), evaluation.logical_form(F.col("p"), F.col("g")).alias("l")).orderBy("i").collect()
    assert [r.c for r in got] == [c for _, c in CASES]
    assert [r.l for r in got] == [c is None for _, c in CASES]


def test_scores(spark):
    df = spark.createDataFrame([(True, True, False), (True, True, True), (True, False, False), (False, False, False)], "valid boolean, correct boolean, exact boolean")
    assert tuple(evaluation.scores(df).first()) == (4, 0.75, 0.5, 0.25)
    assert tuple(evaluation.scores(df.limit(0)).first()) == (0, 0.0, 0.0, 0.0)
    s = spark.createDataFrame([(" SELECT  A\nFROM t ; ",)], "q string").select(evaluation.normalize_sql(F.col("q"))).first()[0]
    assert s == "select a from t"


def test_pattern(spark):
    rows = [('SELECT "a""b" FROM t;', True), ("SELECT MAX(\"x\") FROM t WHERE \"x\" > 'it''s' AND \"x\" = '1';", True), ('SELECT "x" FROM t', False), ('SELECT "y" FROM t;', False), (None, False)]
    df = spark.createDataFrame([(q, ['a"b', "x", r"q\E"], w) for q, w in rows], "q string, c array<string>, w boolean")
    assert all(r.m == r.w for r in df.select(dialect.matches(F.col("q"), F.col("c")).alias("m"), "w").collect())
