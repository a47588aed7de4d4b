"""Queries of the training-data problems over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import cutoff, leakage, mixing, packing, prose, provenance, repetition, tokenizing, toxicity
from quernel.sources.tables import table


def _records(spark: SparkSession, folder: str) -> DataFrame:
    """Web pages and threads under common names."""
    pages = table(spark, folder, "web_pages").select(
        F.lit("web_pages").alias("tbl"), F.col("page_id").alias("rec_id"), "loaded_at", "text"
    )
    threads = table(spark, folder, "threads").select(
        F.lit("threads").alias("tbl"), F.col("id").alias("rec_id"), "loaded_at", F.col("threadtext").alias("text")
    )
    return pages.unionByName(threads)


def p1_found(spark, folder):
    return repetition.cases(_records(spark, folder))


def p1_repetition(spark, folder):
    return repetition.repetitive_records(_records(spark, folder))


def p2_found(spark, folder):
    return provenance.machine_made(table(spark, folder, "sql_files"))


def p2_evidence(spark, folder):
    return provenance.file_evidence(table(spark, folder, "sql_files"))


def p3_cutoffs(spark, folder):
    return cutoff.source_cutoffs(table(spark, folder, "clean_docs"), table(spark, folder, "source_targets"))


def p3_kept(spark, folder):
    return cutoff.kept_rows(table(spark, folder, "clean_docs"), p3_cutoffs(spark, folder))


def p4_pack(spark, folder):
    return packing.pack_texts(table(spark, folder, "clean_docs"), table(spark, folder, "pack_sizes"))


def p4_room(spark, folder):
    return packing.pack_room(table(spark, folder, "clean_docs"), table(spark, folder, "pack_sizes"))


def p4_checks(spark, folder):
    return packing.pack_checks(table(spark, folder, "clean_docs"), table(spark, folder, "pack_sizes"))


def p5_mix(spark, folder):
    return mixing.mixture(table(spark, folder, "clean_docs"), table(spark, folder, "source_targets"))


def p5_shares(spark, folder):
    return mixing.mixture_shares(table(spark, folder, "clean_docs"), table(spark, folder, "source_targets"))


def p6_found(spark, folder):
    return prose.junk_found(table(spark, folder, "clean_docs"))


def p6_quality(spark, folder):
    return prose.text_quality(table(spark, folder, "clean_docs"))


def p6_counts(spark, folder):
    """The figures of p6_quality that SQL can express."""
    return p6_quality(spark, folder).select("row_id", "n_chars", "n_words", "n_lines", "mean_word", "alpha_ratio")


def p7_ids(spark, folder):
    return tokenizing.encode_documents(table(spark, folder, "documents"))


def p7_decoded(spark, folder):
    """What the ids of each document stand for."""
    return tokenizing.decode_documents(p7_ids(spark, folder)).select("doc_id", F.md5("text").alias("text_md5"))


def p7_totals(spark, folder):
    return tokenizing.token_totals(table(spark, folder, "documents"))


def p8_found(spark, folder):
    return leakage.passages_found(table(spark, folder, "documents"), table(spark, folder, "eval_questions"))


def p8_leaks(spark, folder):
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_questions"))


def p9_found(spark, folder):
    return toxicity.flagged(table(spark, folder, "documents"), table(spark, folder, "doc_labels"))


def p9_scores(spark, folder):
    docs = table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, folder, "doc_labels")))


def p9_rates(spark, folder):
    return toxicity.source_rates(table(spark, folder, "documents"), table(spark, folder, "doc_labels"))


QUERIES = {
    name: f
    for name, f in list(globals().items())
    if name.startswith("p") and name[1].isdigit() and callable(f)
}

# ---------------------------------------------------------------------------------------------------------- SQL
_W = r"[^\p{L}\p{N}_]"
_FEATURES = [
    rf"(?i)(?:^|{_W}){x}(?:$|{_W})"
    for x in ("select", "from", "where", "join", "having", "limit", "union", r"group\s+by", r"order\s+by")
] + [
    rf"(?i)(?:^|{_W})(?:count|sum|avg|min|max)\s*\(",
    rf"(?i)(?:^|{_W})with\s+[\p{{L}}\p{{N}}_]+\s+as\s*\(",
]
_SCORE = " + ".join(f"regexp_matches(coalesce(text, ''), '{p}')::INT" for p in _FEATURES)

_ONE = """one AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT row_id, source, text, row_number() OVER (PARTITION BY row_id ORDER BY loaded_at DESC NULLS LAST) AS rn
    FROM clean_docs) WHERE rn = 1)"""
_RANKED = f"""WITH {_ONE},
scored AS (
  SELECT row_id, source, {_SCORE} AS score, ('0x' || substr(md5(row_id::VARCHAR), 1, 12))::BIGINT AS tie
  FROM one WHERE source IS NOT NULL),
ranked AS (
  SELECT s.*, t.keep_frac, row_number() OVER (PARTITION BY s.source ORDER BY score DESC, tie DESC, row_id) AS r,
    ceil(round(t.keep_frac * count(*) OVER (PARTITION BY s.source), 6))::BIGINT AS n_target
  FROM scored s JOIN source_targets t USING (source))"""

_MIX = f"""WITH {_ONE},
sized AS (SELECT row_id, source, coalesce(length(text), 0) AS size FROM one),
sizes AS (SELECT source, sum(size)::BIGINT AS size FROM sized GROUP BY source),
p AS (SELECT t.source, mix_weight, max_repeats, coalesce(s.size, 0) AS size FROM source_targets t LEFT JOIN sizes s USING (source)),
b AS (SELECT sum(mix_weight) FILTER (size > 0) AS live_weight, min(max_repeats * size / mix_weight) FILTER (size > 0) AS per_weight FROM p),
plan AS (
  SELECT source, size AS total, CASE WHEN size > 0 THEN mix_weight / live_weight ELSE 0 END AS target_share,
    CASE WHEN size > 0 THEN least(mix_weight * per_weight / size, max_repeats::DOUBLE) ELSE 0 END AS rate FROM p, b),
mix AS (
  SELECT row_id, source, size, (floor(rate) + (
    ('0x' || substr(md5(row_id::VARCHAR), 5, 13))::BIGINT::DOUBLE / 4503599627370496.0 < rate - floor(rate))::INT)::INT AS copies
  FROM sized JOIN plan USING (source))"""

ORACLE = {
    "p3_cutoffs": f"""{_RANKED}
SELECT t.source, t.keep_frac, coalesce(g.n_records, 0) AS n_records, coalesce(g.n_target, 0) AS n_target,
  g.cutoff_score, g.cutoff_tie, coalesce(g.n_above, 0) AS n_above, coalesce(g.n_at, 0) AS n_at, coalesce(g.n_target, 0) AS n_kept
FROM source_targets t LEFT JOIN (
  SELECT r.source, count(*) AS n_records, max(n_target) AS n_target, max(c.score) AS cutoff_score, max(c.tie) AS cutoff_tie,
    count(*) FILTER (r.score > c.score) AS n_above, count(*) FILTER (r.score = c.score) AS n_at
  FROM ranked r JOIN (SELECT source, score, tie FROM ranked WHERE r = n_target) c USING (source) GROUP BY r.source) g USING (source)""",
    "p3_kept": f"{_RANKED} SELECT row_id, source, score FROM ranked WHERE r <= n_target",
    "p4_checks": f"""WITH {_ONE}, x AS (SELECT pack_id, capacity_chars AS cap, length(text) AS n FROM one, pack_sizes)
SELECT pack_id, count(*) AS texts, sum(greatest(1, ceil(coalesce(n, 0) / cap)))::BIGINT AS pieces, coalesce(sum(n), 0)::BIGINT AS chars, 0::BIGINT AS overlaps, 0::BIGINT AS outside
FROM x GROUP BY pack_id""",
    "p7_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
    "p5_mix": f"{_MIX} SELECT row_id, source, size, copies FROM mix WHERE copies > 0",
    "p5_shares": f"""{_MIX},
got AS (SELECT source, sum(copies * size)::BIGINT AS mixed_size, sum(copies)::BIGINT AS mixed_records FROM mix GROUP BY source)
SELECT source, total AS size, coalesce(mixed_records, 0) AS mixed_records, coalesce(mixed_size, 0) AS mixed_size,
  round(target_share, 6) AS target_share, round(rate, 6) AS rate,
  round(coalesce(mixed_size, 0) / sum(coalesce(mixed_size, 0)) OVER (), 6) AS actual_share
FROM plan LEFT JOIN got USING (source)""",
    "p6_counts": rf"""WITH {_ONE},
c AS (SELECT row_id, coalesce(text, '') AS t FROM one)
SELECT row_id, length(replace(t, chr(10), '')) AS n_chars,
  length(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+'))::BIGINT AS n_words,
  length(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\s]')))::BIGINT AS n_lines,
  coalesce(round(list_sum(list_transform(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+'), lambda x: length(x)))
    / nullif(length(regexp_extract_all(t, '[\p{{L}}\p{{N}}_]+')), 0), 6), 0) AS mean_word,
  coalesce(round(length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) / nullif(length(replace(t, chr(10), '')), 0), 6), 0) AS alpha_ratio
FROM c""",
    "p8_found": r"""WITH q AS (
  SELECT item_id, regexp_extract_all(lower(nfc_normalize(question)), '[\p{L}\p{N}_]+') AS w FROM eval_questions),
runs AS (
  SELECT DISTINCT item_id, least(length(w), 13) AS n,
    array_to_string(list_slice(w, i::BIGINT, (i + least(length(w), 13) - 1)::BIGINT), ' ') AS run
  FROM q, unnest(range(1, greatest(length(w) - 13, 0) + 2)) AS u(i) WHERE length(w) >= 8),
d AS (SELECT doc_id, regexp_extract_all(lower(nfc_normalize(text)), '[\p{L}\p{N}_]+') AS w FROM documents WHERE text <> ''),
g AS (
  SELECT doc_id, n, array_to_string(list_slice(w, i::BIGINT, (i + n - 1)::BIGINT), ' ') AS run
  FROM d, (SELECT DISTINCT n FROM runs) s, unnest(range(1, greatest(length(w) - n + 2, 1))) AS u(i))
SELECT DISTINCT doc_id, item_id FROM g JOIN runs USING (n, run)""",
}
