"""The single-table dialect: lexing, parsing, prefix grammar, execution with text/number affinity, grounding.

Only ``SELECT column | AGG(column) FROM t [WHERE column op 'value' AND ...]`` is executed. Anything else is reported as
not valid rather than run: text is never handed to the SQL engine, so nothing but reading is possible.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernel.functions.hashing import md5_int
from quernel.operators.rendering import AGGREGATES, OPERATORS

PIECES = r""""(?:[^"]|"")*"?|'(?:[^']|'')*'?|[^'"]+"""
NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
MOST_CONDITIONS, MOST_BYTES = 6, 100


# ------------------------------------------------------------------------------------------------------------ lexing
def lex(sql: Column) -> Column:
    """Array of ``struct(kind, text, closed)``: ``code``, ``ident`` and ``string`` pieces, doubled quotes undone."""

    def piece(p: Column) -> Column:
        q = F.substring(p, 1, 1)
        kind = F.when(q == '"', "ident").when(q == "'", "string").otherwise("code")
        inner = F.substring(p, F.lit(2), F.length(p))
        closed = F.when(kind == "code", F.lit(True)).otherwise(F.contains(F.replace(inner, F.concat(q, q), F.lit("")), q))
        body = F.when(closed, F.substring(inner, F.lit(1), F.length(inner) - 1)).otherwise(inner)
        text = F.when(kind == "code", p).otherwise(F.replace(body, F.concat(q, q), q))
        return F.struct(kind.alias("kind"), text.alias("text"), closed.alias("closed"))

    return F.transform(F.regexp_extract_all(F.coalesce(sql, F.lit("")), F.lit(PIECES), F.lit(0)), piece)


def lower_literals(sql: Column) -> Column:
    """Lower-cases strings only; identifiers and keywords keep their case."""

    def back(p: Column) -> Column:
        q = F.when(p["kind"] == "ident", '"').otherwise("'")
        text = F.when(p["kind"] == "string", F.lower(p["text"])).otherwise(p["text"])
        quoted = F.concat(q, F.replace(text, q, F.concat(q, q)), F.when(p["closed"], q).otherwise(F.lit("")))
        return F.when(p["kind"] == "code", p["text"]).otherwise(quoted)

    return F.array_join(F.transform(lex(sql), back), "")


def unknown_identifiers(sql: Column, columns: Column) -> Column:
    """Sorted quoted names that are neither columns nor ``t``."""
    names = F.transform(F.filter(lex(sql), lambda p: p["kind"] == "ident"), lambda p: p["text"])
    return F.array_sort(F.array_except(names, F.concat(columns, F.array(F.lit("t")))))


# ----------------------------------------------------------------------------------------------------------- parsing
_TOKEN = re.compile(r"""\s*(?:(?P<ident>"(?:[^"]|"")*")|(?P<string>'(?:[^']|'')*')|(?P<word>[A-Za-z]+)|(?P<sign>[=<>(),;*]|.))""", re.S)


class Unsupported(ValueError):
    """The text is not a statement of the dialect."""


def _tokens(sql: str) -> list[tuple[str, str]]:
    out, at, sql = [], 0, sql.strip()
    while at < len(sql):
        m = _TOKEN.match(sql, at)
        kind = m.lastgroup
        text = m.group(kind)
        if kind in ("ident", "string"):
            text = text[1:-1].replace(text[0] * 2, text[0])
        out.append((kind, text))
        at = m.end()
    while out and out[-1] == ("sign", ";"):
        out.pop()
    return out


def parse(sql: str, columns: list[str]) -> tuple[int, int, list[tuple[int, int, str]]]:
    """``(sel, agg, conds)`` or Unsupported. Of columns with one name the first is meant."""
    todo = _tokens(sql)[::-1]

    def take(kind: str, *wanted: str) -> str:
        if not todo or todo[-1][0] != kind:
            raise Unsupported(f"expected {wanted or kind}")
        text = todo.pop()[1]
        if wanted and (text.upper() if kind == "word" else text) not in wanted:
            raise Unsupported(f"expected {wanted}, not {text}")
        return text

    def column() -> int:
        name = take("ident")
        if name not in columns:
            raise Unsupported(f"no column {name}")
        return columns.index(name)

    take("word", "SELECT")
    agg = 0
    if todo and todo[-1][0] == "word":
        agg = AGGREGATES.index(take("word", *AGGREGATES[1:]).upper())
        take("sign", "(")
    sel = column()
    if agg:
        take("sign", ")")
    take("word", "FROM")
    take("word", "T")
    conds = []
    if todo:
        take("word", "WHERE")
        while True:
            c = column()
            op = OPERATORS.index(take("sign", *OPERATORS[:3]))
            conds.append((c, op, take("string")))
            if not todo:
                break
            take("word", "AND")
    return sel, agg, conds


def parse_column(sql: Column, columns: Column) -> Column:
    """``struct(sel, agg, conds, error)``; on an error the others are null."""
    kind = "sel int, agg int, conds array<struct<col_ix:int,op:int,val:string>>, error string"

    @F.pandas_udf(kind)
    def run(text: pd.Series, names: pd.Series) -> pd.DataFrame:
        rows = []
        for s, n in zip(text, names):
            try:
                sel, agg, conds = parse(s or "", list(n))
                rows.append((sel, agg, [{"col_ix": c, "op": o, "val": v} for c, o, v in conds], None))
            except Unsupported as e:
                rows.append((None, None, None, str(e)))
        return pd.DataFrame(rows, columns=["sel", "agg", "conds", "error"]).astype({"sel": "Int32", "agg": "Int32"})

    return run(sql, columns)


# ----------------------------------------------------------------------------------------------------------- grammar
class Allowed:
    """Which values a question allows: those that stand in it, whatever their case. Without one, any of MOST_BYTES bytes.

    The question is folded letter by letter; at each place of the folded text it is known how a letter there may have
    been spelt, so a value that ends inside a letter is judged by the letters that can follow.
    """

    def __init__(self, question: str | None):
        self.folded: str | None = None
        if question is None:
            return
        self.folded, self.spelt = "", {}
        for letter in question:
            forms = {letter, letter.lower(), letter.upper(), letter.title()}
            self.spelt[len(self.folded)] = [f.encode("utf-8") for f in sorted(forms) if len(f) == 1]
            self.folded += letter.lower()

    def judge(self, value: bytes) -> tuple[bool, bool]:
        """Whether ``value`` is allowed as it is, and whether it is or can become so."""
        reader = codecs.getincrementaldecoder("utf-8")()
        try:
            text = "".join(map(str.lower, reader.decode(value)))
        except UnicodeDecodeError:
            return False, False
        cut = reader.getstate()[0]
        if self.folded is None:
            short = len(value) <= MOST_BYTES
            return short and bool(value) and not cut, short
        if not cut:
            found = text in self.folded
            return found and bool(text), found or not text
        at = self.folded.find(text)
        while at >= 0:
            if any(f.startswith(cut) for f in self.spelt.get(at + len(text), ())):
                return False, True
            at = self.folded.find(text, at + 1)
        return False, False


_VALUE = re.compile(rb"((?:[^']|'')*)('?)", re.S)


class Grammar:
    """Whether bytes are a complete statement, the beginning of one, or neither. Case and single blanks count.

    All readings are followed at once as a set of places in the input, so a column name that begins like another one
    needs no going back. With a question, values must occur in it whatever their case.
    """

    def __init__(self, columns: Iterable[str], question: str | None = None):
        self.columns = [('"' + c.replace('"', '""') + '"').encode() for c in columns]
        self.allowed = Allowed(question)

    def check(self, s: bytes) -> str:
        open_end = False

        def literal(places: set[int], *options: bytes) -> set[int]:
            nonlocal open_end
            out = set()
            for i in places:
                for o in options:
                    if s.startswith(o, i):
                        out.add(i + len(o))
                    elif len(s) - i < len(o) and o.startswith(s[i:]):
                        open_end = True
            return out

        def value(places: set[int]) -> set[int]:
            nonlocal open_end
            out = set()
            for i in literal(places, b"'"):
                m = _VALUE.match(s, i)
                body, closed = m.group(1).replace(b"''", b"'"), bool(m.group(2))
                whole, begun = self.allowed.judge(body)
                if closed and whole:
                    out.add(m.end())
                # at the end of the input a quote may be the first half of a doubled one
                if m.end() == len(s) and (self.allowed.judge(body + b"'")[1] if closed else begun):
                    open_end = True
            return out

        start = literal({0}, b"SELECT ")
        plain = literal(start, *self.columns)
        called = literal(literal(literal(start, *(a.encode() + b"(" for a in AGGREGATES[1:])), *self.columns), b")")
        here = literal(plain | called, b" FROM t")
        ends = literal(here, b";")
        here = literal(here, b" WHERE ")
        for _ in range(MOST_CONDITIONS):
            here = literal(here, *self.columns)
            here = value(literal(literal(here, b" "), *(o.encode() + b" " for o in OPERATORS[:3])))
            ends |= literal(here, b";")
            if _ + 1 < MOST_CONDITIONS:
                here = literal(here, b" AND ")
        return "complete" if len(s) in ends else "prefix" if open_end else "invalid"


def grammar_column(sql: Column, columns: Column, question: Column) -> Column:
    """``complete``, ``prefix`` or ``invalid`` for each row; a null question puts no constraint on values."""

    @F.pandas_udf("string")
    def run(text: pd.Series, names: pd.Series, q: pd.Series) -> pd.Series:
        return pd.Series([Grammar(n, a).check((s or "").encode("utf-8")) for s, n, a in zip(text, names, q)])

    return run(sql, columns, question)


def matches(sql: Column, columns: Column) -> Column:
    """Whether a statement is complete, as one regular expression: no limit on conditions, no check of values."""
    quoted = lambda c: F.concat(F.lit(r'\Q"'), F.replace(F.replace(c, F.lit('"'), F.lit('""')), F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r'"\E'))
    name = F.concat(F.lit("(?:"), F.array_join(F.transform(columns, quoted), "|"), F.lit(")"))
    condition = F.concat(name, F.lit(" [=<>] '(?:[^']|'')+'"))
    whole = F.concat(
        F.lit("(?s)^SELECT (?:"), name, F.lit(rf"|(?:{'|'.join(AGGREGATES[1:])})\("), name, F.lit(r"\)) FROM t(?: WHERE "), condition,
        F.lit("(?: AND "), condition, F.lit(")*)?;$"),
    )
    return F.coalesce(F.rlike(sql, whole), F.lit(False))


# --------------------------------------------------------------------------------------------------------- execution
def number_of(literal: Column) -> Column:
    """The literal as a double if all of it is a number, else null."""
    return F.when(literal.rlike(rf"^\s*{NUMBER}\s*$"), F.trim(literal).cast("double"))


def prefix_number(text: Column) -> Column:
    """The number that a text begins with, 0 if none; null stays null."""
    n = F.regexp_extract(text, rf"^\s*({NUMBER})", 1)
    return F.when(text.isNotNull(), F.when(n == "", 0.0).otherwise(F.when(n != "", n).cast("double")))


def _compare(op: Column, less: Column, equal: Column, greater: Column) -> Column:
    return F.when(op == 0, equal).when(op == 1, greater).when(op == 2, less).otherwise(F.lit(False))


def holds(real: Column, number: Column, text: Column, op: Column, literal: Column) -> Column:
    """Whether a cell fulfils a condition. A number column compares as numbers with a numeric literal, and lies below any
    other text; a text column compares as lower-case text. Null cells never fulfil one."""
    lit = F.lower(literal)
    value = number_of(literal)
    as_number = _compare(op, number < value, number == value, number > value)
    below = (op == 2) & number.isNotNull()
    as_text = _compare(op, text < lit, text == lit, text > lit)
    return F.coalesce(F.when(real, F.when(value.isNotNull(), as_number).otherwise(below)).otherwise(as_text), F.lit(False))


def execute(df: DataFrame, columns: list[str], sel: int, agg: int, conds: list[tuple[int, int, str]]) -> DataFrame:
    """One structured query over the named columns of ``df``; the result has the one column ``result``.

    Filters stay plain comparisons of columns with constants, so they reach the parquet scan.
    """
    kinds = dict(df.dtypes)

    def is_real(c: str) -> bool:
        return kinds[c] in ("double", "float", "int", "bigint", "smallint", "tinyint") or kinds[c].startswith("decimal")

    def one(c: int, op: int, literal: str) -> Column:
        name = columns[c]
        x = F.col(name)
        if op not in (0, 1, 2):
            raise Unsupported(f"operator {op}")
        if is_real(name):
            if re.fullmatch(rf"\s*{NUMBER}\s*", literal):
                v = F.lit(float(literal))
                return (x == v, x > v, x < v)[op]
            return x.isNotNull() if op == 2 else F.lit(False)
        t, v = F.lower(x.cast("string")), F.lit(literal.lower())
        return (t == v, t > v, t < v)[op]

    d = df.where(reduce(lambda a, b: a & b, [one(*c) for c in conds])) if conds else df
    name = columns[sel]
    x = F.col(name) if is_real(name) else F.lower(F.col(name).cast("string"))
    kind = AGGREGATES[agg]
    if not kind:
        return d.select(x.alias("result"))
    n = x.cast("double") if is_real(name) else prefix_number(x)
    return d.agg({"MAX": F.max(x), "MIN": F.min(x), "COUNT": F.count(x), "SUM": F.sum(n), "AVG": F.avg(n)}[kind].alias("result"))


def cells(df: DataFrame, table_id: str, key: str, columns: list[str]) -> DataFrame:
    """``table_id, row_id, col_ix, real, num, txt``: a table in long form, texts in lower case."""
    kinds = dict(df.dtypes)
    parts = []
    for i, c in enumerate(columns):
        real = kinds[c] not in ("string", "timestamp", "date", "boolean")
        parts.append(
            F.struct(
                F.lit(i).alias("col_ix"), F.lit(real).alias("real"),
                (F.col(c).cast("double") if real else F.lit(None).cast("double")).alias("num"),
                (F.lit(None).cast("string") if real else F.lower(F.col(c).cast("string"))).alias("txt"),
            )
        )
    return df.select(F.lit(table_id).alias("table_id"), F.col(key).alias("row_id"), F.explode(F.array(*parts)).alias("c")).select("table_id", "row_id", "c.*")


def _key(real: Column, number: Column, text: Column) -> Column:
    """One text for equal cells: numbers and texts do not share any."""
    return F.when(real, F.concat(F.lit("n"), (number + 0.0).cast("string"))).otherwise(F.concat(F.lit("t"), text))


def _rows_met(queries: DataFrame, data: DataFrame) -> DataFrame:
    """``query_id, table_id, row_id`` of the rows that fulfil all conditions of the queries that have any.

    A query with an equality begins with the cells equal to its first one, found by hash; only a query without any
    compares the cells of a whole column. What is left is checked against the cells of the rows found so far.
    """
    conds = queries.select("query_id", "table_id", F.size("conds").alias("need"), F.posexplode("conds").alias("at", "c")).select(
        "query_id", "table_id", "need", "at", "c.*"
    )
    lead = conds.groupBy("query_id").agg(F.min(F.struct((F.col("op") != 0).cast("int").alias("o"), F.col("at").alias("at"))).alias("l"))
    conds = conds.join(lead.select("query_id", F.col("l.at").alias("lead"), (F.col("l.o") == 0).alias("equal")), "query_id")
    first = conds.where(F.col("at") == F.col("lead"))
    low = F.lower("val")
    wanted = first.where("equal").select(
        "query_id", "table_id", "col_ix", "need", F.explode(F.array_compact(F.array(F.concat(F.lit("t"), low), _key(F.lit(True), number_of(F.col("val")), low)))).alias("key")
    )
    keyed = data.withColumn("key", _key(F.col("real"), F.col("num"), F.col("txt")))
    by_hash = wanted.join(keyed, ["table_id", "col_ix", "key"]).select("query_id", "table_id", "row_id", "need")
    fits = holds(F.col("real"), F.col("num"), F.col("txt"), F.col("op"), F.col("val"))
    by_column = first.where(~F.col("equal")).join(data, ["table_id", "col_ix"]).where(fits).select("query_id", "table_id", "row_id", "need")
    begun = by_hash.unionByName(by_column)
    rest = conds.where(F.col("at") != F.col("lead")).select("query_id", "col_ix", "op", "val")
    more = (
        begun.where("need > 1").join(rest, "query_id").join(data, ["table_id", "row_id", "col_ix"]).where(fits)
        .groupBy("query_id", "table_id", "row_id", "need").agg(F.count("*").alias("got")).where("got = need - 1")
    )
    names = ["query_id", "table_id", "row_id"]
    return begun.where("need = 1").select(*names).unionByName(more.select(*names))


def _values(queries: DataFrame, data: DataFrame) -> DataFrame:
    """``query_id, agg, real, num, txt``: the selected cells of the rows that each query keeps."""
    free = queries.where(F.size("conds") == 0).select("query_id", "table_id")
    chosen = queries.select("query_id", "table_id", F.col("sel").alias("col_ix"), "agg")
    seen = _rows_met(queries, data).join(chosen, ["query_id", "table_id"]).join(data, ["table_id", "row_id", "col_ix"])
    every = free.join(chosen, ["query_id", "table_id"]).join(data, ["table_id", "col_ix"])
    return seen.select("query_id", "agg", "real", "num", "txt").unionByName(every.select("query_id", "agg", "real", "num", "txt"))


def _executed(queries: DataFrame, data: DataFrame, *more: Column) -> DataFrame:
    """``query_id, agg, n, value`` and ``more`` aggregates; ``value`` is null for plain selects."""
    n = F.when(F.col("real"), F.col("num")).otherwise(prefix_number(F.col("txt")))
    got = _values(queries, data).groupBy("query_id").agg(
        F.max("num").alias("max_n"), F.min("num").alias("min_n"), F.max("txt").alias("max_t"), F.min("txt").alias("min_t"),
        F.count(F.coalesce(F.col("num").cast("string"), F.col("txt"))).alias("n_set"), F.sum(n).alias("s"), F.avg(n).alias("a"), F.count("*").alias("n"), *more,
    )
    known = data.select("table_id").distinct()
    all_ = queries.join(known, "table_id", "left_semi").select("query_id", "agg").join(got, "query_id", "left")
    as_text = lambda x: F.round(x, 6).cast("string")
    value = (
        F.when(F.col("agg") == 1, F.coalesce(as_text(F.col("max_n")), F.col("max_t")))
        .when(F.col("agg") == 2, F.coalesce(as_text(F.col("min_n")), F.col("min_t")))
        .when(F.col("agg") == 3, F.coalesce("n_set", F.lit(0).cast("long")).cast("string"))
        .when(F.col("agg") == 4, as_text(F.col("s")))
        .otherwise(as_text(F.col("a")))
    )
    return all_.withColumn("n", F.coalesce("n", F.lit(0).cast("long"))).withColumn("value", F.when(F.col("agg") > 0, F.coalesce(value, F.lit("NULL"))))


def _plain() -> Column:
    return F.coalesce(F.when(F.col("real"), F.round("num", 6).cast("string")).otherwise(F.col("txt")), F.lit("NULL"))


def execute_all(queries: DataFrame, data: DataFrame) -> DataFrame:
    """Many structured queries in one job: ``query_id, n, result``.

    ``queries`` has ``query_id, table_id, sel, agg, conds``; ``data`` are cells. A plain select gives a sorted array of
    its values as text, an aggregate an array of one, so this is for results that fit in a row. Queries without
    conditions take all rows. Queries of unknown tables give no row.
    """
    all_ = _executed(queries, data, F.array_sort(F.collect_list(F.when(F.col("agg") == 0, _plain()))).alias("plain"))
    none = F.array().cast("array<string>")
    return all_.select("query_id", "n", F.when(F.col("agg") == 0, F.coalesce("plain", none)).otherwise(F.array("value")).alias("result"))


def execute_digests(queries: DataFrame, data: DataFrame) -> DataFrame:
    """``query_id, n, value, digest``: like ``execute_all``, for results of any size.

    ``value`` is the text of an aggregate. ``digest`` adds up two hashes of each value of a plain select, so it is that
    of the multiset and is reduced map-side; equal digests of 96 bits are taken as equal results.
    """
    part = lambda i: F.coalesce(F.sum(F.when(F.col("agg") == 0, md5_int(_plain(), i, 12)).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))
    all_ = _executed(queries, data, F.concat_ws(":", part(1).cast("string"), part(13).cast("string")).alias("digest"))
    return all_.select("query_id", "n", "value", F.when(F.col("agg") == 0, F.coalesce("digest", F.lit("0:0"))).alias("digest"))


def run_texts(statements: DataFrame, columns: DataFrame, data: DataFrame) -> DataFrame:
    """``query_id, valid, error, n, value, digest``: statements executed from their text.

    ``statements`` has ``query_id, table_id, sql``, ``columns`` has ``table_id, names`` with the displayed names of the
    columns. A text is read by the dialect's own parser and only its structure is executed, so nothing but reading is
    possible. What does not parse, names an unknown column or table, or is null is not valid, with the reason.
    """
    read = statements.join(columns, "table_id", "left").withColumn("p", parse_column(F.col("sql"), F.coalesce("names", F.array().cast("array<string>"))))
    reason = F.when(F.col("names").isNull(), F.lit("unknown table")).when(F.col("sql").isNull(), F.lit("no statement")).otherwise(F.col("p.error"))
    read = read.select("query_id", "table_id", reason.alias("error"), F.col("p.sel").alias("sel"), F.col("p.agg").alias("agg"), F.col("p.conds").alias("conds"))
    done = execute_digests(read.where("error IS NULL").drop("error"), data)
    j = read.select("query_id", "error").join(done, "query_id", "left")
    # an empty table has no cells, and every statement on it is valid
    return j.select("query_id", F.col("error").isNull().alias("valid"), "error", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "value", "digest")


def execution_match(predicted: DataFrame, gold: DataFrame) -> DataFrame:
    """``query_id, valid, correct``: whether the prediction ran, and whether both ran and gave the same multiset.

    Both sides are results of ``run_texts``; a prediction without a gold result is not correct.
    """
    g = gold.select("query_id", F.col("valid").alias("g_valid"), F.col("n").alias("g_n"), F.col("value").alias("g_value"), F.col("digest").alias("g_digest"))
    c = F.col
    same = _multiset(c("value"), c("digest"), c("n")) == _multiset(c("g_value"), c("g_digest"), c("g_n"))
    return predicted.join(g, "query_id", "left").select("query_id", "valid", F.coalesce(c("valid") & c("g_valid") & same, F.lit(False)).alias("correct"))


def _multiset(value: Column, digest: Column, n: Column) -> Column:
    """One text for equal results: an aggregate is one value, and equals a plain select of that one."""
    alone = F.concat_ws(":", F.lit("1"), md5_int(value, 1, 12).cast("string"), md5_int(value, 13, 12).cast("string"))
    return F.when(value.isNotNull(), alone).otherwise(F.concat_ws(":", n.cast("string"), F.coalesce(digest, F.lit("0:0"))))


def ground(conds: DataFrame, values: DataFrame) -> DataFrame:
    """``id, col_ix, val`` with values replaced by cells they contain as whole words.

    ``conds`` has ``id, table_id, col_ix, op, val``; ``values`` the distinct text cells ``table_id, col_ix, txt`` in lower
    case. Only ``=`` conditions whose value is no cell of their column change: the chosen column comes first, then the
    others in order; of several cells the longest wins, then the first by text. A cell is found by its rarest word, so no
    condition meets cells that share a frequent word only.
    """
    word = "[a-z0-9]+"
    eq = conds.where("op = 0")
    exact = eq.join(values, (eq.table_id == values.table_id) & (eq.col_ix == values.col_ix) & (F.lower(F.trim(eq.val)) == values.txt), "left_semi").select("id")
    open_ = eq.join(exact, "id", "left_anti").withColumn("low", F.lower(F.trim("val")))
    listed = values.withColumn("w", F.explode(F.array_distinct(F.regexp_extract_all("txt", F.lit(word), F.lit(0)))))
    often = listed.groupBy("table_id", "w").agg(F.count("*").alias("often"))
    rarest = F.min(F.struct("often", "w"))["w"]
    first = listed.join(often, ["table_id", "w"]).groupBy("table_id", F.col("col_ix").alias("cell_col"), "txt").agg(rarest.alias("w"))
    parts = open_.withColumn("w", F.explode(F.array_distinct(F.regexp_extract_all("low", F.lit(word), F.lit(0)))))
    bounded = F.concat(F.lit(r"(?s).*(?<![a-z0-9])\Q"), F.col("txt"), F.lit(r"\E(?![a-z0-9]).*"))
    hit = parts.join(first, ["table_id", "w"]).where(F.rlike("low", bounded))
    rank = F.struct((F.col("cell_col") != F.col("col_ix")).cast("int"), F.when(F.col("cell_col") != F.col("col_ix"), F.col("cell_col")).otherwise(-1), -F.length("txt"), F.col("txt"))
    best = hit.groupBy("id").agg(F.min_by(F.struct("cell_col", "txt"), rank).alias("b"))
    return conds.join(best, "id", "left").select(
        "id", F.coalesce("b.cell_col", "col_ix").alias("col_ix"), F.coalesce("b.txt", "val").alias("val")
    )
