"""Queries over whole tables: name -> callable of session and folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Window
from pyspark.sql import functions as F

from quernel.functions.hashing import md5_int, unit
from quernel.functions.text import words
from quernel.operators import (
    bpe, cleaning, decontamination, dialect, distribution, evaluation, logs, rendering, selection, shards, similarity, statistics,
)
from quernel.plans import inputs
from quernel.session import cut
from quernel.sources.sinks import unfinished
from quernel.sources.tables import latest, table

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _text_hash(c="clean_text"):
    return F.md5(F.coalesce(F.col(c), F.lit(""))).alias("text_md5")


# ------------------------------------------------------------------------------------------------------------ cleaning
@query
def clean_web_report(s, d):
    p = inputs.pages(s, d)
    return cleaning.report(cleaning.canonical(p, "fineweb_edu", F.lit(cleaning.WEB_LICENSE), F.coalesce("url", F.lit("")), F.length(F.coalesce("text", F.lit("")))))


@query
def clean_web_verdict(s, d):
    return inputs.pages(s, d).select("page_id", "reason", _text_hash())


@query
def clean_sql_verdict(s, d):
    return inputs.files(s, d).select("file_id", "reason", _text_hash())


@query
def thread_verdict(s, d):
    return inputs.threads(s, d).select("id", "reason", _text_hash())


@query
def prompt_format(s, d):
    return inputs.prompts(s, d).select("item_id", "reason", F.col("clean_text").alias("text"))


@query
def clean_report(s, d):
    return cleaning.report(inputs.cleaned(s, d))


@query
def clean_reasons(s, d):
    return cleaning.reasons(inputs.cleaned(s, d))


@query
def clean_origins(s, d):
    return inputs.cleaned(s, d).where("text IS NOT NULL").select("source", "license", "origin")


@query
def latest_deliveries(s, d):
    return latest(table(s, d, "clean_docs"), "row_id", ["source", F.length("text").alias("n_chars")])


# ----------------------------------------------------------------------------------------------------------- rendering
@query
def render_sql(s, d):
    return inputs.items(s, d).select("item_id", "gold_sql", rendering.schema_text(F.col("header"), F.col("types")).alias("schema"))


@query
def sft_examples(s, d):
    return rendering.examples(table(s, d, "eval_questions"), table(s, d, "table_meta"))


@query
def label_mask(s, d):
    """Word hashes stand for token ids."""
    e = rendering.examples(table(s, d, "eval_questions"), table(s, d, "table_meta"))
    ids = lambda c: F.transform(words(F.col(c)), lambda w: (md5_int(w, 1, 4) % 1000).cast("int"))
    m = e.select("item_id", rendering.masked_labels(ids("prompt"), ids("completion"), 1000, 1024).alias("m"))
    return m.select("item_id", F.array_join(F.transform("m.ids", lambda x: x.cast("string")), " ").alias("ids"), F.array_join(F.transform("m.labels", lambda x: x.cast("string")), " ").alias("labels"))


@query
def collate_batches(s, d):
    q = table(s, d, "eval_questions").select("item_id", F.floor(F.col("item_id") / 64).alias("batch"), F.transform(words(F.coalesce("question", F.lit(""))), lambda w: F.length(w)).alias("ids"))
    c = rendering.collate(q, "batch", "ids", "ids", 0)
    return c.select("item_id", F.array_join(F.transform("x", lambda v: v.cast("string")), " ").alias("x"), F.array_join(F.transform("y", lambda v: v.cast("string")), " ").alias("y"))


# -------------------------------------------------------------------------------------------------------- duplicates
@query
def exact_dedup_keep(s, d):
    return similarity.exact_keep(table(s, d, "documents", "doc_id", "text"), "text", ["doc_id"]).select("doc_id")


@query
def exact_dedup_report(s, d):
    t = table(s, d, "documents", "doc_id", "source", "text")
    k = similarity.exact_keep(t, "text", ["doc_id"])
    a = t.groupBy("source").agg(F.count("*").alias("docs_in"))
    b = k.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("docs_out"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("chars_out"))
    z = F.lit(0).cast("long")
    return a.join(b, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "docs_in", F.coalesce("docs_out", z).alias("docs_out"), F.coalesce("chars_out", z).alias("chars_out"))


@query
def minhash_signature(s, d):
    t = table(s, d, "documents", "doc_id", "text").where("text IS NOT NULL")
    g = t.select("doc_id", similarity.signature(words(F.col("text")), "text").alias("g"))
    return g.select("doc_id", F.md5(F.array_join(F.transform("g", lambda x: x.cast("string")), ",")).alias("signature"))


@query
def near_duplicate_classes(s, d):
    return similarity.near_duplicates(table(s, d, "documents"), "doc_id", "text")


@query
def near_duplicate_report(s, d):
    """Per source: documents, those left after exact and after near removal, and the removed share."""
    t = table(s, d, "documents", "doc_id", "source", "text")
    near = similarity.near_duplicates(t, "doc_id", "text")
    exact = similarity.exact_keep(t, "text", ["doc_id"]).select(F.col("doc_id").alias("e"))
    j = t.join(near.select("doc_id", "keep"), "doc_id").join(exact, F.col("doc_id") == F.col("e"), "left")
    return j.groupBy("source").agg(
        F.count("*").alias("docs_in"), F.count("e").alias("after_exact"), F.count_if("keep").alias("after_near"),
        F.round(1 - F.count_if("keep") / F.count("*"), 6).alias("removed"),
    )


@query
def near_duplicate_sources(s, d):
    """Near duplicates among the SQL scripts only; all other documents pass."""
    return similarity.near_duplicates_of(table(s, d, "documents"), "doc_id", "text", "source", ["stack_sql"])


# ----------------------------------------------------------------------------------------------------- decontamination
def _hits(s, d):
    return decontamination.hits(table(s, d, "documents"), decontamination.eval_index(table(s, d, "eval_questions")))


@query
def eval_ngram_index(s, d):
    return decontamination.eval_index(table(s, d, "eval_questions"))


@query
def contaminated_docs(s, d):
    return _hits(s, d)


@query
def decontamination_keep(s, d):
    return decontamination.keep(table(s, d, "documents"), _hits(s, d)).select("doc_id")


@query
def decontamination_report(s, d):
    r = decontamination.report(table(s, d, "documents"), _hits(s, d))
    return r.withColumn("examples", F.array_join(F.transform("examples", lambda x: x.cast("string")), ","))


# ----------------------------------------------------------------------------------------------------------- selection
def _scored(s, d):
    return table(s, d, "clean_docs", "row_id", "source", "text").withColumn("score", selection.query_score(F.col("text")))


@query
def query_score(s, d):
    return _scored(s, d).select("row_id", "score")


@query
def score_histogram(s, d):
    return selection.histogram(_scored(s, d))


@query
def score_threshold(s, d):
    return selection.threshold(selection.histogram(_scored(s, d).where("source = 'stack_sql'")), 0.7)


@query
def score_keep(s, d):
    t = _scored(s, d).where("source = 'stack_sql'")
    return selection.keep_by_threshold(t, selection.threshold(selection.histogram(t), 0.7)).select("row_id")


@query
def text_hash(s, d):
    return table(s, d, "documents", "doc_id", "text").select("doc_id", selection.xxh64("text").alias("h"))


@query
def hash_split(s, d):
    v = selection.is_validation(F.col("text"), 0.1)
    return table(s, d, "documents", "doc_id", "text").select("doc_id", F.when(v, "val").otherwise("train").alias("split"))


@query
def upsample_mix(s, d):
    t = table(s, d, "documents", "doc_id", "source", "text").withColumn("val", selection.is_validation(F.col("text"), 0.1))
    times = F.when(F.col("source").eqNullSafe("gretel_sql") & ~F.col("val"), 3).otherwise(1)
    return selection.repeat_rows(t, times).select("doc_id", "copy")


@query
def shard_summary(s, d):
    t = table(s, d, "documents", "doc_id", "source", "text")
    t = t.withColumn("split", F.when(selection.is_validation(F.col("text"), 0.1), "val").otherwise("train")).withColumn("n", F.size(words(F.coalesce("text", F.lit("")))) + 1)
    return selection.shard_summary(t, "n")


@query
def sample_groups(s, d):
    t = table(s, d, "documents", "origin", "n_chars").where("origin IS NOT NULL")
    return selection.sample_to_size(t.withColumn("n_chars", F.coalesce("n_chars", F.lit(0))), "origin", "n_chars", 50_000)


@query
def unfinished_documents(s, d):
    return unfinished(table(s, d, "documents", "doc_id"), table(s, d, "doc_labels"), "doc_id")


# ----------------------------------------------------------------------------------------------------------- tokenizer
def _word_counts(s, d):
    t = table(s, d, "documents", "text").select(F.explode(words(F.coalesce("text", F.lit("")))).alias("chunk"))
    return t.groupBy("chunk").agg(F.count("*").alias("n"))


@query
def word_counts(s, d):
    return _word_counts(s, d)


@query
def byte_pair_counts(s, d):
    return bpe.byte_pairs(_word_counts(s, d))


@query
def chunk_counts(s, d):
    return bpe.chunk_counts(table(s, d, "documents", "text"))


@query
def special_pieces(s, d):
    t = table(s, d, "clean_docs", "row_id", "text")
    return t.select("row_id", F.size(bpe.split_specials(F.col("text"))).alias("pieces"), F.size(F.filter(bpe.split_specials(F.col("text")), lambda p: p.isin(*bpe.SPECIALS))).alias("specials"))


#: Merges that SQL can repeat.
FEW = 12


def _few(s, d):
    return bpe.Vocabulary(bpe.train(_word_counts(s, d), FEW))


@query
def first_merges(s, d):
    v = _few(s, d)
    return s.createDataFrame([(i, a, b) for i, (a, b) in enumerate(v.merges)], "rank int, a int, b int")


@query
def word_ids(s, d):
    """Every distinct word, encoded by the first merges."""
    e = bpe.encode(_word_counts(s, d), _few(s, d), "chunk", "chunk")
    return e.select("chunk", F.array_join(F.transform("ids", lambda x: x.cast("string")), " ").alias("ids"))


@query
def decode_roundtrip(s, d):
    """Documents encoded by a vocabulary that was saved and loaded again, and decoded."""
    v = _few(s, d)
    folder = tempfile.mkdtemp(prefix="quernel-vocabulary-")  # a file of the driver
    v.save(os.path.join(folder, "v.json"))
    v = bpe.Vocabulary.load(os.path.join(folder, "v.json"))
    e = bpe.encode(table(s, d, "documents", "doc_id", "text"), v, "doc_id")
    return bpe.decode(e, v, "doc_id").select("doc_id", F.md5("text").alias("text_md5"))


@query
def control_tokens(s, d):
    """Control tokens that encoding emits: only the text-to-SQL source may."""
    v = _few(s, d)
    t = table(s, d, "clean_docs", "row_id", "source", "text").withColumn("k", F.struct("row_id", F.xxhash64("text").alias("h")))
    e = bpe.encode(t, v, "k", allow_special=F.col("source").eqNullSafe("gretel_sql"))
    return e.select("k.row_id", F.size(F.filter("ids", lambda i: i >= len(v.bytes))).alias("specials"))


@query
def bytes_per_word(s, d):
    """The compression report with words in place of tokens."""
    t = table(s, d, "documents", "source", "text").where("text IS NOT NULL")
    return bpe.compression(t.select("source", F.octet_length("text").alias("bytes"), F.size(words(F.col("text"))).alias("tokens")), "bytes", "tokens", "source")


# Fixed value: the reference's vocabulary, of bytes, merges and control tokens.
VOCABULARY = 32_768


def _vocabulary(s, d):
    return bpe.Vocabulary(bpe.train(bpe.chunk_counts(table(s, d, "documents", "text")), VOCABULARY - 256 - len(bpe.SPECIALS), 2))


@query
def bpe_merges(s, d):
    v = _vocabulary(s, d)
    return s.createDataFrame([(i, a, b, v.bytes[256 + i]) for i, (a, b) in enumerate(v.merges)], "rank int, a int, b int, piece binary")


@query
def bpe_compression(s, d):
    v = _vocabulary(s, d)
    t = table(s, d, "documents", "doc_id", "source", "text").where("text IS NOT NULL")
    ids = bpe.encode(t.withColumn("k", F.struct("doc_id", "source", F.octet_length("text").alias("bytes"))), v, "k", allow_special=F.col("source").eqNullSafe("gretel_sql"))
    return bpe.compression(ids.select("k.*", F.size("ids").alias("tokens")), "bytes", "tokens", "source")


# -------------------------------------------------------------------------------------------------------------- shards
def _sized(s, d):
    t = table(s, d, "documents", "doc_id", "text")
    return t.select("doc_id", F.floor(F.col("doc_id") / 250).alias("shard"), F.size(words(F.coalesce("text", F.lit("")))).alias("tokens"))


@query
def pack_offsets(s, d):
    return shards.offsets(_sized(s, d), "shard", "doc_id", "tokens")


@query
def shard_starts(s, d):
    n = _sized(s, d).groupBy("shard").agg(F.sum(F.col("tokens") + 1).alias("tokens"))
    return shards.shard_starts(n, "shard", "tokens", 128)


@query
def window_lookup(s, d):
    starts = shard_starts(s, d)
    total = starts.agg(F.max("upto").alias("total"))
    draws = table(s, d, "events", "event_id").crossJoin(F.broadcast(total)).select("event_id", (md5_int(F.col("event_id").cast("string")) % F.col("total")).alias("draw"))
    return shards.locate(draws, starts, "shard", "draw").select("event_id", "shard", "offset")


# The mix schedule, source weights until a share of the run.
SCHEDULE = [
    (0.85, {"fineweb_edu": 0.82, "stack_sql": 0.15, "stackexchange": 0.025, "gretel_sql": 0.005}),
    (1.0, {"fineweb_edu": 0.54, "stack_sql": 0.36, "stackexchange": 0.08, "gretel_sql": 0.02}),
]


@query
def mix_phase(s, d):
    e = table(s, d, "events", "event_id").select("event_id", (F.col("event_id") % 1000 / 1000.0).alias("progress"))
    w = shards.schedule_weights(e, SCHEDULE)
    return w.groupBy("phase", "source").agg(F.count("*").alias("n"), F.round(F.max("weight"), 6).alias("weight"))


@query
def mix_average(s, d):
    rows = [(i, u, n, w) for i, (u, ws) in enumerate(SCHEDULE) for n, w in ws.items()]
    return shards.average_mix(s.createDataFrame(rows, "phase int, until double, source string, weight double"))


@query
def mix_draws(s, d):
    draw = shards.draw_source(F.col("event_id").cast("string"), list(SCHEDULE[0][1].items()))
    return table(s, d, "events", "event_id").select(draw.alias("source")).groupBy("source").agg(F.count("*").alias("n"))


@query
def token_windows(s, d):
    """All windows of 2048 tokens of the packed shards, the last shorter one included; word lengths stand for ids."""
    t = _sized(s, d).join(table(s, d, "documents", "doc_id", "text"), "doc_id")
    t = t.select("doc_id", "shard", F.transform(words(F.coalesce("text", F.lit(""))), lambda w: F.length(w)).alias("ids"))
    w = shards.packed_windows(t, "shard", "doc_id", "ids", 0, 2048)
    joined = lambda c: F.md5(F.array_join(F.transform(c, lambda v: v.cast("string")), " "))
    return w.select("shard", "window", F.size("x").alias("tokens"), joined("x").alias("x"), joined("y").alias("y"))


# ------------------------------------------------------------------------------------------------------------- dialect
CUSTOMER = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
ORDERS = ["o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query
def dialect_select(s, d):
    return dialect.execute(table(s, d, "customer"), CUSTOMER, 0, 0, [(3, 0, "Building"), (2, 1, "5000")])


def _aggregate(agg):
    def run(s, d):
        r = dialect.execute(table(s, d, "orders"), ORDERS, 2, agg, [(3, 0, "1-URGENT"), (2, 2, " 2e5 ")])
        return r.select(F.round(F.col("result").cast("double"), 2).alias("result"))

    return run


for _i, _n in enumerate(rendering.AGGREGATES):
    if _n:
        QUERIES[f"dialect_{_n.lower()}"] = _aggregate(_i)


@query
def dialect_text_number(s, d):
    """Numbers lie below text, so ``<`` holds for all and ``>`` for none."""
    c = table(s, d, "customer")
    parts = [dialect.execute(c, CUSTOMER, 2, 3, [(2, op, "1,200")]).select(F.lit(op).alias("op"), "result") for op in (0, 1, 2)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def dialect_sum_text(s, d):
    return dialect.execute(table(s, d, "orders"), ORDERS, 3, 4, [(1, 0, "o")]).select(F.round("result", 2).alias("result"))


@query
def lex_pieces(s, d):
    p = inputs.items(s, d).select("item_id", dialect.lex(F.col("gold_sql")).alias("p"))
    return p.select("item_id", F.size("p").alias("n"), F.array_join(F.transform("p", lambda x: x["kind"]), " ").alias("kinds"), F.array_join(F.transform("p", lambda x: x["text"]), "|").alias("texts"))


@query
def lower_literals(s, d):
    return inputs.items(s, d).select("item_id", dialect.lower_literals(F.col("gold_sql")).alias("sql"))


@query
def unknown_identifiers(s, d):
    """Statements against the first two columns of their table only."""
    u = dialect.unknown_identifiers(F.col("gold_sql"), F.slice(rendering.column_names(F.col("header")), 1, 2))
    return inputs.items(s, d).select("item_id", F.array_join(u, "|").alias("unknown"))


@query
def parse_roundtrip(s, d):
    p = inputs.items(s, d).withColumn("p", dialect.parse_column(F.col("gold_sql"), rendering.column_names(F.col("header"))))
    again = rendering.to_sql(F.col("header"), F.col("p.sel"), F.col("p.agg"), F.col("p.conds"))
    return p.select("item_id", (again == F.col("gold_sql")).alias("same"))


@query
def grammar_states(s, d):
    """Each statement and its first half against the grammar."""
    i = inputs.items(s, d).withColumn("names", rendering.column_names(F.col("header")))
    half = F.substring("gold_sql", F.lit(1), (F.length("gold_sql") / 2).cast("int"))
    free = F.lit(None).cast("string")
    return i.select("item_id", dialect.grammar_column(F.col("gold_sql"), F.col("names"), free).alias("whole"), dialect.grammar_column(half, F.col("names"), free).alias("half"))


@query
def grammar_pattern(s, d):
    i = inputs.items(s, d).withColumn("names", rendering.column_names(F.col("header")))
    short = F.substring("gold_sql", F.lit(1), F.length("gold_sql") - 1)
    return i.select("item_id", dialect.matches(F.col("gold_sql"), F.col("names")).alias("whole"), dialect.matches(short, F.col("names")).alias("cut"))


@query
def batch_execute(s, d):
    """One structured query a nation over its customers, all in one job."""
    n = F.col("n_nationkey")
    cond = lambda c, o, v: F.struct(F.lit(c).alias("col_ix"), F.lit(o).alias("op"), v.alias("val"))
    own, agg = cond(1, 0, n.cast("string")), (n % 6).cast("int")
    q = table(s, d, "nation").select(
        n.cast("long").alias("query_id"), F.lit("customer").alias("table_id"), F.when(agg.isin(0, 3), 3).otherwise(2).alias("sel"), agg.alias("agg"),
        F.when(n % 5 == 4, F.array().cast("array<struct<col_ix:int,op:int,val:string>>")).when(n % 2 == 1, F.array(own, cond(2, 1, F.lit("0")))).otherwise(F.array(own)).alias("conds"),
    )
    b = dialect.execute_digests(q, dialect.cells(table(s, d, "customer"), "customer", "c_custkey", CUSTOMER))
    return b.select("query_id", "n", F.round(F.col("value").try_cast("double"), 2).alias("number"), "digest")


def _statements(s, d):
    """A gold statement a nation, and a prediction that equals it, is changed in effect or only in form, or is broken."""
    n, names = F.col("n_nationkey"), F.array(*[F.lit(c) for c in CUSTOMER])
    cond = lambda c, o, v: F.struct(F.lit(c).alias("col_ix"), F.lit(o).alias("op"), v.alias("val"))
    agg = (n % 6).cast("int")
    kind, sel = n % 8, F.when(agg.isin(0, 3), 3).otherwise(2)
    rich = F.when(n % 2 == 1, F.array(cond(2, 1, F.lit("0"))))
    none = F.array().cast("array<struct<col_ix:int,op:int,val:string>>")
    conds = lambda v: F.concat(F.array(cond(1, 0, v.cast("string"))), F.coalesce(rich, none))
    gold = conds(n)
    text = rendering.to_sql(names, sel, agg, gold)
    loose = rendering.to_sql(names, sel, agg, F.reverse(gold))
    for word in ("SELECT", "FROM", "WHERE", "AND"):
        loose = F.replace(loose, F.lit(word), F.lit(word.lower()))
    pred = (
        F.when(kind == 1, loose)
        .when(kind == 2, rendering.to_sql(names, sel, ((agg + 1) % 6).cast("int"), gold))
        .when(kind == 3, rendering.to_sql(names, sel, agg, conds(n + 1)))
        .when(kind == 4, F.replace(text, F.lit("c_nationkey"), F.lit("c_nation")))
        .when(kind == 5, F.replace(text, F.lit("="), F.lit("!=")))
        .when(kind == 6, rendering.to_sql(names, sel, agg, F.concat(gold, F.array(cond(2, 2, F.lit("1e9"))))))
        .when(kind != 7, text)
    )
    return table(s, d, "nation").select(
        n.cast("long").alias("query_id"), F.when(n % 9 == 8, "nowhere").otherwise("customer").alias("asked"), F.lit("customer").alias("table_id"),
        sel.alias("sel"), agg.alias("agg"), gold.alias("conds"), text.alias("gold_sql"), pred.alias("pred_sql"),
    )


def _run(s, d, statements):
    names = s.createDataFrame([("customer", CUSTOMER)], "table_id string, names array<string>")
    return dialect.run_texts(statements, names, dialect.cells(table(s, d, "customer"), "customer", "c_custkey", CUSTOMER))


@query
def text_execute(s, d):
    """Predicted statements run from their text."""
    r = _run(s, d, _statements(s, d).select("query_id", "table_id", F.col("pred_sql").alias("sql")))
    return r.select("query_id", "valid", "n", F.round(F.col("value").try_cast("double"), 2).alias("number"), F.when(F.col("valid"), F.col("digest")).alias("digest"))


def _matched(s, d):
    """Both sides of all statements in one run."""
    q = _statements(s, d)
    side = lambda c, i: q.select((F.col("query_id") * 2 + i).alias("query_id"), "table_id", F.col(c).alias("sql"))
    ran = cut(_run(s, d, side("gold_sql", 0).unionByName(side("pred_sql", 1))))
    of = lambda i: ran.where(F.col("query_id") % 2 == i).withColumn("query_id", F.floor(F.col("query_id") / 2))
    return q.join(dialect.execution_match(of(1), of(0)), "query_id")


@query
def execution_match(s, d):
    """Predictions against gold statements, both run from their text."""
    return _matched(s, d).select("query_id", "valid", "correct")


@query
def execution_scores(s, d):
    m = _matched(s, d)
    return evaluation.scores(m.withColumn("exact", F.coalesce(evaluation.normalize_sql(F.col("pred_sql")) == evaluation.normalize_sql(F.col("gold_sql")), F.lit(False))))


@query
def gold_self_check(s, d):
    """Gold statements run from their text against the structures they were made of; some ask a table that is not there."""
    q = _statements(s, d)
    texts = _run(s, d, q.select("query_id", F.col("asked").alias("table_id"), F.col("gold_sql").alias("sql")))
    whole = dialect.execute_digests(q.select("query_id", "table_id", "sel", "agg", "conds"), dialect.cells(table(s, d, "customer"), "customer", "c_custkey", CUSTOMER))
    return dialect.execution_match(texts, whole.withColumn("valid", F.lit(True)))


@query
def grammar_question(s, d):
    """Statements whose values must stand in the question, which is made to mention the first one: as they are, with
    their values in other case, with a blank too many, and cut within the last value."""
    i = inputs.items(s, d).withColumn("names", rendering.column_names(F.col("header")))
    i = i.withColumn("asked", F.concat(F.coalesce("question", F.lit("")), F.lit(" about "), F.coalesce(F.upper(F.get("conds", F.lit(0))["val"]), F.lit(""))))
    state = lambda sql: dialect.grammar_column(sql, F.col("names"), F.col("asked"))
    swapped = rendering.to_sql(F.col("header"), F.col("sel"), F.col("agg"), F.transform("conds", lambda c: F.struct(c["col_ix"].alias("col_ix"), c["op"].alias("op"), F.upper(c["val"]).alias("val"))))
    return i.select("item_id", state(F.col("gold_sql")).alias("whole"), state(swapped).alias("upper"), state(F.replace(F.col("gold_sql"), F.lit("SELECT "), F.lit("SELECT  "))).alias("spaced"), state(F.substring("gold_sql", F.lit(1), F.length("gold_sql") - 3)).alias("cut"))


@query
def value_grounding(s, d):
    """Values that hold a market segment or a name among other words, in the chosen column and in another one; equal
    values and other comparisons stay."""
    cells = dialect.cells(table(s, d, "customer"), "customer", "c_custkey", CUSTOMER)
    values = cells.where("NOT real").select("table_id", "col_ix", "txt").distinct()
    kind = F.col("c_custkey") % 5
    val = (
        F.when(kind == 1, F.concat(F.lit("buyer "), "c_name", F.lit(" of "), "c_mktsegment")).when(kind == 2, F.concat(F.lit("about "), "c_name"))
        .when(kind == 4, F.col("c_mktsegment")).otherwise(F.concat(F.lit("the "), "c_mktsegment", F.lit(" segment")))
    )
    c = table(s, d, "customer").select(
        F.col("c_custkey").alias("id"), F.lit("customer").alias("table_id"), F.when(kind.isin(2, 4), 3).otherwise(0).alias("col_ix"), F.when(kind == 3, 1).otherwise(0).alias("op"), val.alias("val")
    )
    return dialect.ground(c, values)


# ---------------------------------------------------------------------------------------------------------- evaluation
def _judged(s, d):
    p = inputs.predictions(s, d)
    p = p.withColumn("p", dialect.parse_column(F.col("pred_sql"), rendering.column_names(F.col("header"))))
    return p.withColumn("category", evaluation.diagnose(F.col("p"), F.col("gold"))).withColumn("exact", evaluation.normalize_sql(F.col("pred_sql")) == evaluation.normalize_sql(F.col("gold_sql"))).withColumn("valid", F.col("p.error").isNull()).withColumn("correct", evaluation.logical_form(F.col("p"), F.col("gold")))


@query
def failure_category(s, d):
    return _judged(s, d).select("item_id", "category")


@query
def failure_summary(s, d):
    return evaluation.failure_summary(_judged(s, d))


@query
def score_summary(s, d):
    return evaluation.scores(_judged(s, d))


@query
def accuracy_by_conditions(s, d):
    return evaluation.by_conditions(_judged(s, d))


@query
def component_accuracy(s, d):
    j = _judged(s, d).select(*evaluation.components(F.col("p"), F.col("gold")))
    return j.agg(*[F.round(F.avg(F.col(c).cast("int")), 6).alias(c) for c in j.columns])


@query
def misaligned_predictions(s, d):
    """First deliveries that have a text against last deliveries of all pages: what came again later is misaligned."""
    t = table(s, d, "web_pages", "page_id", "text", "loaded_at").withColumn("at", F.unix_micros("loaded_at"))
    p = t.where("text IS NOT NULL").groupBy("page_id").agg(F.min("at").alias("at"))
    return evaluation.misaligned(p, t.groupBy("page_id").agg(F.max("at").alias("at")), "page_id", "at")


@query
def length_batches(s, d):
    q = table(s, d, "eval_questions").select("item_id", "question")
    return evaluation.length_batches(q, F.size(words(F.coalesce("question", F.lit("")))), "item_id").select("item_id", "length", "batch")


# ---------------------------------------------------------------------------------------------------------- statistics
@query
def system_mean_std(s, d):
    return statistics.mean_std(inputs.ratings(s, d), ["system"], "correct")


@query
def mcnemar(s, d):
    m = statistics.mcnemar(statistics.paired(inputs.ratings(s, d), "rater1", "rater2"))
    return m.withColumn("p", F.round("p", 9)).withColumn("log_p", F.round("log_p", 6))


@query
def system_pairs(s, d):
    return statistics.comparisons(inputs.ratings(s, d), [("rater1", "rater2"), ("rater1", "rater3"), ("rater2", "rater3")])


@query
def item_means(s, d):
    return inputs.ratings(s, d).groupBy("item_id").agg(F.round(F.avg("correct"), 6).alias("mean"), F.count("*").alias("runs"))


@query
def bootstrap_interval(s, d):
    return statistics.bootstrap_interval(inputs.ratings(s, d), "correct", 2000)


@query
def paired_bootstrap(s, d):
    return statistics.paired_bootstrap(statistics.paired(inputs.ratings(s, d), "rater1", "rater2"), 2000)


@query
def verdict_audit(s, d):
    n = table(s, d, "doc_labels").groupBy("verdict").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    w = n.withColumn("w", statistics.wilson(F.col("n"), total))
    return w.select("verdict", "n", F.col("w.low").alias("low"), F.col("w.high").alias("high"))


# ---------------------------------------------------------------------------------------------------------------- logs
@query
def smooth_values(s, d):
    e = logs.smooth(table(s, d, "events", "event_id", "event_type", "value"), "event_type", "event_id", "value")
    return e.select("event_id", F.round("smoothed", 6).alias("smoothed"))


@query
def tail_summary(s, d):
    return logs.summarize(table(s, d, "events", "event_id", "event_type", "value"), "event_type", "event_id", "value")


@query
def weighted_score(s, d):
    e = table(s, d, "events", "user_id", "event_type", "value").groupBy("user_id", "event_type").agg(F.avg("value").alias("v"))
    w = logs.weighted_score(e, "user_id", "event_type", "v", {"click": 0.6, "view": 0.3, "purchase": 0.1})
    return w.withColumn("score", F.round("score", 9))


@query
def best_by_group(s, d):
    e = table(s, d, "events", "user_id", "value").groupBy((F.col("user_id") % 10).alias("setting")).agg(F.round(F.avg("value"), 6).alias("score"))
    return logs.best_run(e, "setting", "score")


@query
def best_setting(s, d):
    e = table(s, d, "events", "user_id", "event_type", "value").groupBy((F.col("user_id") % 10).alias("setting"), "event_type").agg(F.round(F.avg("value"), 6).alias("value"))
    return logs.best_setting(e, "setting", "value")


@query
def label_spread(s, d):
    e = table(s, d, "nation").select(F.col("n_regionkey").alias("g"), F.col("n_name").alias("label"), (F.col("n_nationkey") / 10.0).alias("y"))
    return logs.spread(e, "g", "y", 0.75).select("label", F.round("place", 6).alias("place"))


@query
def throughput(s, d):
    e = table(s, d, "events", "event_id", "event_type", "ts").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    t = logs.throughput(e, "event_type", "event_id", F.col("t") / 1_000_000, 1000, 1.25e8, 1.2e14)
    return t.select("event_id", F.round("tokens_per_s", 2).alias("tokens_per_s"), F.round("mfu", 14).alias("mfu"))


@query
def log_row_kinds(s, d):
    """Events by whether their JSON holds the key ``k``."""
    e = table(s, d, "events", "event_type", "props").withColumn("k", F.get_json_object("props", "$.k").try_cast("int"))
    return e.groupBy("event_type").agg(F.count_if(F.col("k").isNotNull()).alias("with_k"), F.count_if(F.col("k").isNull()).alias("without_k"), F.round(F.avg("k"), 6).alias("mean_k"))


@query
def source_losses(s, d):
    return logs.source_losses(table(s, d, "events", "event_type", "value"), "event_type", "value").withColumn("loss", F.round("loss", 6))


@query
def gains_table(s, d):
    """Mean values of each user by event type, and the gains over views."""
    return logs.gains(table(s, d, "events", "user_id", "event_type", "value"), "user_id", "event_type", "value", ["view", "click", "purchase"], "view")


@query
def cosine_schedule(s, d):
    """The orders as steps of one run."""
    o = table(s, d, "orders", "o_orderkey")
    r = o.crossJoin(F.broadcast(o.agg(F.max("o_orderkey").alias("most"))))  # one row
    return r.select("o_orderkey", F.round(logs.cosine_rate(F.col("o_orderkey"), F.col("most"), 1e-3, 100), 9).alias("rate"))


# -------------------------------------------------------------------------------------------------------- distributions
def _probabilities(s, d):
    e = table(s, d, "events", "event_id", "user_id", "value")
    return distribution.softmax(e, "user_id", "value", 10.0)


@query
def softmax_scores(s, d):
    return _probabilities(s, d).select("event_id", F.round("p", 9).alias("p"))


@query
def topk_filter(s, d):
    return distribution.top_k(table(s, d, "events", "event_id", "user_id", "value"), "user_id", "value", "event_id", 3).select("event_id")


@query
def nucleus_filter(s, d):
    return distribution.top_p(_probabilities(s, d), "user_id", "p", "event_id", 0.5).select("event_id")


@query
def inverse_cdf(s, d):
    e = table(s, d, "events", "event_id", "user_id").withColumn("p", (F.col("event_id") % 7 + 1).cast("double"))
    return distribution.inverse_cdf(e, "user_id", "p", "event_id", unit(F.col("user_id").cast("string")))


@query
def greedy_choice(s, d):
    return table(s, d, "events", "event_id", "user_id", "value").groupBy("user_id").agg(F.min_by("event_id", F.struct(-F.col("value"), F.col("event_id"))).alias("event_id"))


@query
def cross_entropy(s, d):
    """The first purchase of each user is the target; users without one have an ignored label."""
    e = table(s, d, "events", "event_id", "user_id", "event_type", "value").withColumn("value", F.col("value") / 10)
    bought = F.col("event_type") == "purchase"
    e = e.withColumn("first", F.min(F.when(bought, F.col("event_id"))).over(Window.partitionBy("user_id")))
    return distribution.cross_entropy(e, "user_id", "value", F.col("event_id") == F.col("first")).select("user_id", F.round("loss", 6).alias("loss"))


@query
def clip_scale(s, d):
    return distribution.clip_scale(table(s, d, "events", "value"), "value", 1.0).select(F.round("norm", 4).alias("norm"), F.round("scale", 9).alias("scale"))


@query
def rmsnorm_vectors(s, d):
    v = table(s, d, "embeddings", "vec_id", "embedding").select("vec_id", distribution.rms_norm(F.col("embedding")).alias("v"))
    return v.select("vec_id", F.round(F.get("v", F.lit(0)), 5).alias("first"), F.round(distribution.dot(F.col("v"), F.col("v")), 4).alias("square"))


@query
def label_cosine(s, d):
    """Each vector against the first vector of its label."""
    v = table(s, d, "embeddings")
    first = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("c"))
    return v.join(first, "label").select("vec_id", F.round(distribution.cosine(F.col("embedding"), F.col("c")), 5).alias("cosine"))


@query
def rotary_vectors(s, d):
    v = table(s, d, "embeddings", "vec_id", "embedding").select("vec_id", "embedding", distribution.rotate(F.col("embedding"), F.col("vec_id") % 128).alias("r"))
    return v.select("vec_id", F.round(F.get("r", F.lit(0)), 5).alias("first"), F.round(distribution.dot(F.col("r"), F.col("r")), 4).alias("square"))


@query
def silu_values(s, d):
    return table(s, d, "events", "event_id", "value").select("event_id", F.round(distribution.silu(F.col("value")), 6).alias("silu"))


@query
def embedding_lookup(s, d):
    e = table(s, d, "events", "event_id").withColumn("vec_id", F.col("event_id") % 700)
    return distribution.lookup(e, table(s, d, "embeddings", "vec_id", "embedding"), "vec_id").select("event_id", F.round(F.get("embedding", F.lit(3)).cast("double"), 6).alias("value"))
