import unicodedata

from pyspark.sql import functions as F

from quernel.functions.text import fold, normalize
from quernel.operators import cleaning


def test_normalize_order(spark):
    texts = ["a\r\nb\rc\x00d\x07 ", "éte", "x²", "    y  ", "", "plain\n"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(normalize(F.col("t"))).collect()]
    assert got == ["a\nb\ncd", "éte", "x²", "y", "", "plain"]
    low = spark.createDataFrame([("STRASSE",), ("straße",), ("É",), (None,)], "t string").select(fold(F.col("t"))).collect()
    assert [r[0] for r in low] == ["strasse", "strasse", "é", None]


GOOD = "The quick brown fox jumps over the lazy dog near the river bank. " * 10


def test_web_reasons(spark):
    boiler = "\n".join(["home about contact us today"] * 20 + [f"unique line number {c}" for c in "abcde"]) * 2
    rows = [(1, GOOD), (2, "short"), (3, GOOD + "�" * 200), (4, "12345 67890 " * 40), (5, boiler), (6, None), (7, "")]
    got = {r.id: r for r in cleaning.clean_web(spark.createDataFrame(rows, "id int, text string")).collect()}
    assert [got[i].reason for i in range(1, 8)] == [None, "too_short", "replacement_chars", "low_alpha_fraction", "repeated_lines", "too_short", "too_short"]
    assert got[1].clean_text == GOOD.strip() and got[2].clean_text is None


def test_sql_reasons(spark):
    dump = "CREATE TABLE t (a int);\n" + "INSERT INTO t VALUES (1);\n" * 2000
    rows = [(1, "SELECT a, count(*) FROM t GROUP BY a;\n" * 3), (2, GOOD), (3, "select " + "x, " * 600), (4, dump), (5, "x"), (6, None), (7, "select " + "-=+*/ " * 30)]
    got = {r.id: r for r in cleaning.clean_sql(spark.createDataFrame(rows, "id int, content string")).collect()}
    assert [got[i].reason for i in range(1, 8)] == [None, "no_sql_keyword", "long_lines", "truncated_dump", "too_short", "too_short", "low_alnum_fraction"]
    assert len(got[4].clean_text) <= 8000 and got[4].clean_text.endswith(";")


def test_threads_and_prompts(spark):
    t = spark.createDataFrame([(1, "x" * 500, 3), (2, "x" * 500, -2), (3, "tiny", 1), (4, "y" * 400, None), (5, None, -1)], "id int, threadtext string, score int")
    assert [r.reason for r in cleaning.clean_thread(t).orderBy("id").collect()] == [None, "negative_score", "too_short", None, "negative_score"]
    p = spark.createDataFrame(
        [(1, "create  table a\n(x int); insert into a values (1); CREATE TABLE b (y int);", " q? ", "select 1"), (2, "insert into a values (1);", "q", "s"), (3, None, "q", "s"), (4, "create table a (x int);", "", "s")],
        "id int, sql_context string, sql_prompt string, sql string",
    )
    got = {r.id: r for r in cleaning.format_prompt(p).collect()}
    assert got[1].clean_text == "<schema>create table a (x int);\nCREATE TABLE b (y int);</schema>\n<question>q?</question>\n<sql>select 1</sql>"
    assert [got[i].reason for i in (1, 2, 3, 4)] == [None, "missing_field", "missing_field", "missing_field"]


def test_report_counts(spark):
    c = cleaning.clean_web(spark.createDataFrame([(GOOD,), ("no",), (None,)], "text string"))
    c = cleaning.canonical(c, "s", F.lit("l"), F.lit("o"), F.length(F.coalesce("text", F.lit(""))))
    r = cleaning.report(c).first()
    assert (r.docs_in, r.docs_out, r.chars_in, r.chars_out) == (3, 1, len(GOOD) + 2, len(GOOD.strip()))
    assert [(x.reason, x.n) for x in cleaning.reasons(c).collect()] == [("too_short", 2)]
    assert unicodedata.normalize("NFC", r.source) == "s"
