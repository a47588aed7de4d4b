"""The queries of :mod:`quernel.plans.queries` in SQL, for those that SQL can express."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

_S = r"[\s\p{Z}\x{85}]"
_W = r"[\p{L}\p{N}_]"
_N = r"[^\p{L}\p{N}_]"


def _norm(x: str) -> str:
    unix = rf"regexp_replace(nfc_normalize(coalesce({x}, '')), '\r\n?', chr(10), 'g')"
    clean = rf"regexp_replace({unix}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g')"
    return rf"regexp_replace({clean}, '^{_S}+|{_S}+$', '', 'g')"


def _count(t: str, cls: str) -> str:
    return f"(length({t}) - length(regexp_replace({t}, '{cls}', '', 'g')))"


def _words(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '{_W}+')"


def _md5(x: str, start: int = 1, digits: int = 8) -> str:
    return f"('0x' || substr(md5({x}), {start}, {digits}))::BIGINT"


# ------------------------------------------------------------------------------------------------------------ cleaning
_WEB = rf"""web AS (
  SELECT *, CASE
    WHEN length(t) < 200 THEN 'too_short'
    WHEN {_count('t', chr(0xFFFD))} / length(t) > 0.01 THEN 'replacement_chars'
    WHEN {_count('t', r'\p{L}')} / length(t) < 0.55 THEN 'low_alpha_fraction'
    WHEN length(l) >= 10 AND 1 - length(list_distinct(l)) / length(l) > 0.3 THEN 'repeated_lines' END AS reason
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\s\p{{Z}}\x{{85}}]')) AS l
    FROM (SELECT *, {_norm('text')} AS t FROM web_pages)))"""
_SQL = rf"""files AS (
  SELECT *, CASE WHEN short THEN 'too_short'
    WHEN list_max(list_transform(string_split(u, chr(10)), lambda x: length(x))) > 1000 THEN 'long_lines'
    WHEN {_count('u', r'[\p{L}\p{N}]')} / greatest(length(u), 1) < 0.3 THEN 'low_alnum_fraction'
    WHEN NOT regexp_matches(u, '(?i)(?:^|{_N})(?:select|create|insert|update|delete|alter|drop)(?:$|{_N})') THEN 'no_sql_keyword'
    WHEN dump THEN 'truncated_dump' END AS reason
  FROM (SELECT *, CASE WHEN dump THEN CASE WHEN contains(substr(t, 1, 8000), chr(10))
      THEN regexp_extract(substr(t, 1, 8000), '(?s)^(.*)\n', 1) ELSE substr(t, 1, 8000) END ELSE t END AS u
    FROM (SELECT *, length(t) < 50 AS short, length(t) >= 50 AND length(regexp_extract_all(t, '(?im)^\s*insert\b')) / length(string_split(t, chr(10))) > 0.5 AS dump
      FROM (SELECT *, {_norm('content')} AS t FROM sql_files))))"""
_THREAD = f"""posts AS (
  SELECT *, CASE WHEN score < 0 THEN 'negative_score' WHEN length(t) < 300 THEN 'too_short' END AS reason
  FROM (SELECT *, {_norm('threadtext')} AS t FROM threads))"""

_NAMES = r"list_transform(header, lambda h, i: CASE WHEN regexp_matches(coalesce(h, ''), '^[\s\p{Z}]*$') THEN 'col' || (i - 1)::VARCHAR ELSE h END)"
_QUOTED = """list_transform(names, lambda n: '"' || replace(n, '"', '""') || '"')"""
_AGG = "['', 'MAX', 'MIN', 'COUNT', 'SUM', 'AVG']"
_RENDER = (
    """CASE WHEN {agg} > 0 THEN """ + _AGG + """[{agg} + 1] || '(' || quoted[{sel} + 1] || ')' ELSE quoted[{sel} + 1] END"""
)


def _render(sel: str, agg: str, conds: str) -> str:
    head = _RENDER.format(sel=sel, agg=agg)
    each = f"""list_transform({conds}, lambda c: quoted[c.col_ix + 1] || ' ' || ['=', '>', '<', 'OP'][c.op + 1] || ' ''' || replace(c.val, '''', '''''') || '''')"""
    return f"""'SELECT ' || {head} || ' FROM t' || CASE WHEN length({conds}) > 0 THEN ' WHERE ' || array_to_string({each}, ' AND ') ELSE '' END || ';'"""


_SCHEMA = """'CREATE TABLE t (' || array_to_string(list_transform(quoted, lambda q, i: q || CASE WHEN types[i] = 'real' THEN ' REAL' ELSE ' TEXT' END), ', ') || ');'"""
_ITEMS = f"""items AS (
  SELECT *, {_render('sel', 'agg', 'conds')} AS gold_sql, {_SCHEMA} AS schema FROM (
    SELECT *, {_QUOTED} AS quoted FROM (SELECT *, {_NAMES} AS names FROM eval_questions JOIN table_meta USING (table_id))))"""
_PROMPT = rf"""prompts AS (
  SELECT *, CASE WHEN coalesce(question, '') = '' THEN 'missing_field' END AS reason,
    '<schema>' || regexp_replace(schema, '\s+', ' ', 'g') || '</schema>' || chr(10) || '<question>' || {_norm('question')} || '</question>'
      || chr(10) || '<sql>' || {_norm('gold_sql')} || '</sql>' AS t FROM items)"""
_CLEAN = f"""WITH {_WEB}, {_SQL}, {_THREAD}, {_ITEMS}, {_PROMPT}, cleaned AS (
  SELECT 'fineweb_edu' AS source, 'ODC-By' AS license, coalesce(url, '') AS origin, CASE WHEN reason IS NULL THEN t END AS text, reason, length(coalesce(text, '')) AS chars_in FROM web
  UNION ALL SELECT 'stack_sql', '[' || array_to_string(max_stars_repo_licenses, ', ') || ']', coalesce(max_stars_repo_name, ''),
    CASE WHEN reason IS NULL OR reason = 'truncated_dump' THEN u END, reason, length(coalesce(content, '')) FROM files
  UNION ALL SELECT 'stackexchange', coalesce(contentlicense, 'CC BY-SA'), site || ':' || id, CASE WHEN reason IS NULL THEN t END, reason, length(coalesce(threadtext, '')) FROM posts
  UNION ALL SELECT 'gretel_sql', 'Apache-2.0', 'gretel:' || item_id, CASE WHEN reason IS NULL THEN t END, reason, 0 FROM prompts)"""
_REPORT = """SELECT source, count(*) AS docs_in, count(text) AS docs_out, sum(chars_in)::BIGINT AS chars_in,
  coalesce(sum(length(text)), 0)::BIGINT AS chars_out, round(count(text) / count(*), 6) AS kept FROM cleaned"""

ORACLE |= {
    "clean_web_report": f"{_CLEAN} {_REPORT} WHERE source = 'fineweb_edu' GROUP BY source",
    "clean_report": f"{_CLEAN} {_REPORT} GROUP BY source",
    "clean_reasons": f"{_CLEAN} SELECT source, reason, count(*) AS n FROM cleaned WHERE reason IS NOT NULL GROUP BY ALL",
    "clean_origins": f"{_CLEAN} SELECT source, license, origin FROM cleaned WHERE text IS NOT NULL",
    "clean_web_verdict": f"WITH {_WEB} SELECT page_id, reason, md5(CASE WHEN reason IS NULL THEN t ELSE '' END) AS text_md5 FROM web",
    "clean_sql_verdict": f"WITH {_SQL} SELECT file_id, reason, md5(CASE WHEN reason IS NULL OR reason = 'truncated_dump' THEN u ELSE '' END) AS text_md5 FROM files",
    "thread_verdict": f"WITH {_THREAD} SELECT id, reason, md5(CASE WHEN reason IS NULL THEN t ELSE '' END) AS text_md5 FROM posts",
    "prompt_format": f"WITH {_ITEMS}, {_PROMPT} SELECT item_id, reason, CASE WHEN reason IS NULL THEN t END AS text FROM prompts",
    "latest_deliveries": """SELECT row_id, source, n_chars FROM (
  SELECT row_id, source, length(text) AS n_chars, row_number() OVER (PARTITION BY row_id ORDER BY loaded_at DESC NULLS LAST) AS r FROM clean_docs) WHERE r = 1""",
    "render_sql": f"WITH {_ITEMS} SELECT item_id, gold_sql, schema FROM items",
    "sft_examples": rf"""WITH {_ITEMS} SELECT item_id, table_id, question, '<schema>' || schema || '</schema>' || chr(10) || '<question>'
  || regexp_replace(coalesce(question, ''), '^{_S}+|{_S}+$', '', 'g') || '</question>' || chr(10) || '<sql>' AS prompt, gold_sql || '</sql>' AS completion FROM items""",
    "label_mask": rf"""WITH {_ITEMS}, e AS (
  SELECT item_id, '<schema>' || schema || '</schema>' || chr(10) || '<question>' || coalesce(question, '') || '</question>' || chr(10) || '<sql>' AS p, gold_sql || '</sql>' AS c FROM items),
t AS (SELECT item_id, list_transform({_words('p')}, lambda w: {_md5('w', 1, 4)} % 1000) AS p, list_transform({_words('c')}, lambda w: {_md5('w', 1, 4)} % 1000) AS c FROM e)
SELECT item_id, array_to_string(list_slice(list_concat(p, c, [1000]), 1, 1024), ' ') AS ids,
  array_to_string(list_slice(list_concat(list_transform(p, lambda x: -100), c, [1000]), 1, 1024), ' ') AS labels FROM t""",
    "collate_batches": f"""WITH q AS (SELECT item_id, item_id // 64 AS batch, list_transform({_words('question')}, lambda w: length(w)) AS ids FROM eval_questions),
m AS (SELECT *, max(length(ids)) OVER (PARTITION BY batch) AS n FROM q)
SELECT item_id, array_to_string(list_slice(list_resize(ids, n, 0), 1, (n - 1)::BIGINT), ' ') AS x,
  array_to_string(list_slice(list_resize(ids, n, -100), 2, n::BIGINT), ' ') AS y FROM m""",
}

# ---------------------------------------------------------------------------------------------- duplicates, eval overlap
_INDEX = f"""q AS (SELECT item_id AS item, {_words('question')} AS w FROM eval_questions),
idx AS (
  SELECT n, gram, min(item) AS item FROM (
    SELECT item, least(length(w), 13) AS n, array_to_string(list_slice(w, i::BIGINT, (i + least(length(w), 13) - 1)::BIGINT), ' ') AS gram
    FROM q, unnest(range(1, greatest(length(w) - 13, 0) + 2)) AS u(i) WHERE length(w) >= 8) GROUP BY n, gram)"""
_HITS = f"""{_INDEX},
d AS (SELECT doc_id, {_words('text')} AS w FROM documents),
g AS (SELECT doc_id, n, i - 1 AS pos, array_to_string(list_slice(w, i::BIGINT, (i + n - 1)::BIGINT), ' ') AS gram
  FROM d, (SELECT DISTINCT n FROM idx) s, unnest(range(1, greatest(length(w) - n + 2, 1))) AS u(i)),
hits AS (SELECT doc_id, item, n, pos FROM (
  SELECT doc_id, item, n, pos, row_number() OVER (PARTITION BY doc_id ORDER BY n, pos, item) AS r FROM g JOIN idx USING (n, gram)) WHERE r = 1)"""
_NEAR = f"""WITH RECURSIVE node AS (SELECT text, min(doc_id) AS k, coalesce(length(text), 0) AS n FROM documents GROUP BY text),
w AS (SELECT k, text, {_words('text')} AS w FROM node WHERE text IS NOT NULL),
s AS (SELECT DISTINCT k, {_md5('gram')} AS h FROM (
  SELECT k, unnest(CASE WHEN length(w) >= 5 THEN list_transform(range(1, length(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))
    WHEN length(w) > 0 THEN [array_to_string(w, ' ')] ELSE [text] END) AS gram FROM w)),
z AS (SELECT k, count(*) AS z FROM s GROUP BY k),
c AS (SELECT x.k AS a, y.k AS b, count(*) AS shared FROM s x JOIN s y ON x.h = y.h AND x.k < y.k GROUP BY ALL),
link AS (SELECT a, b FROM c JOIN z x ON x.k = a JOIN z y ON y.k = b WHERE shared / (x.z + y.z - shared) >= 0.8),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT k, k AS c FROM node UNION SELECT edge.b, reach.c FROM reach JOIN edge ON edge.a = reach.k),
class AS (SELECT k, min(c) AS class_id FROM reach GROUP BY k),
best AS (SELECT class_id, arg_min(k, (-n, k)) AS kept FROM class JOIN node USING (k) GROUP BY class_id),
near AS (SELECT doc_id, class_id, coalesce(l.links, 0) AS links, doc_id = kept AS keep
  FROM documents d JOIN node ON node.text IS NOT DISTINCT FROM d.text JOIN class USING (k) JOIN best USING (class_id)
  LEFT JOIN (SELECT a AS k, count(*) AS links FROM edge GROUP BY a) l USING (k))"""
ORACLE |= {
    "exact_dedup_keep": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
    "exact_dedup_report": """WITH k AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text)
SELECT source, count(*) AS docs_in, count(k.doc_id) AS docs_out, coalesce(sum(length(text)) FILTER (k.doc_id IS NOT NULL), 0)::BIGINT AS chars_out
FROM documents LEFT JOIN k USING (doc_id) GROUP BY source""",
    "minhash_signature": f"""WITH t AS (SELECT doc_id, text, {_words('text')} AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, {_md5('gram')} AS h FROM (
  SELECT doc_id, unnest(CASE WHEN length(w) >= 5 THEN list_transform(range(1, length(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' '))
    WHEN length(w) > 0 THEN [array_to_string(w, ' ')] ELSE [text] END) AS gram FROM t)),
p AS (SELECT i, {_md5("'a' || i")} | 1 AS a, {_md5("'b' || i")} AS b FROM range(128) r(i)),
m AS (SELECT doc_id, i, min((a::HUGEINT * h + b) % 4294967296) AS v FROM s, p GROUP BY doc_id, i)
SELECT doc_id, md5(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY i)) AS signature FROM m GROUP BY doc_id""",
    "near_duplicate_classes": f"""{_NEAR} SELECT doc_id, class_id, links, keep FROM near""",
    "near_duplicate_report": f"""{_NEAR}, e AS (SELECT min(doc_id) AS doc_id FROM documents GROUP BY text)
SELECT source, count(*) AS docs_in, count(e.doc_id) AS after_exact, count(*) FILTER (keep) AS after_near, round(1 - count(*) FILTER (keep) / count(*), 6) AS removed
FROM documents JOIN near USING (doc_id) LEFT JOIN e USING (doc_id) GROUP BY source""",
    "near_duplicate_sources": f"""{_NEAR.replace('FROM documents', "FROM (SELECT * FROM documents WHERE source = 'stack_sql')")} SELECT doc_id, class_id, links, keep FROM near
UNION ALL SELECT doc_id, doc_id, 0, TRUE FROM documents WHERE coalesce(source, '') <> 'stack_sql'""",
    "eval_ngram_index": f"WITH {_INDEX} SELECT n, gram, item FROM idx",
    "contaminated_docs": f"WITH {_HITS} SELECT doc_id, item, n, pos FROM hits",
    "decontamination_keep": f"WITH {_HITS} SELECT doc_id FROM documents ANTI JOIN hits USING (doc_id)",
    "decontamination_report": f"""WITH {_HITS} SELECT source, count(*) AS docs_in, count(h.doc_id) AS removed,
  coalesce(array_to_string(list_slice(list_sort(list(h.doc_id) FILTER (h.doc_id IS NOT NULL)), 1, 3), ','), '') AS examples
FROM documents LEFT JOIN hits h USING (doc_id) GROUP BY source""",
}

# ----------------------------------------------------------------------------------------------------------- selection
_FEATURES = [rf"(?i)(?:^|{_N}){x}(?:$|{_N})" for x in ("select", "from", "where", "join", "having", "limit", "union", r"group\s+by", r"order\s+by")] + [
    rf"(?i)(?:^|{_N})(?:count|sum|avg|min|max)\s*\(", rf"(?i)(?:^|{_N})with\s+{_W}+\s+as\s*\(",
]
_SCORED = "scored AS (SELECT row_id, source, text, " + " + ".join(f"regexp_matches(coalesce(text, ''), '{p}')::INT" for p in _FEATURES) + " AS score FROM clean_docs)"
_CUT = f"""{_SCORED}, h AS (SELECT score, count(*) AS n FROM scored WHERE source = 'stack_sql' GROUP BY score),
c AS (SELECT score, n, sum(n) OVER (ORDER BY score DESC) AS upto, 0.7::DOUBLE * sum(n) OVER () AS need FROM h),
cut AS (SELECT score AS cut_score, (need - (upto - n)) / n AS tie_p FROM c WHERE upto >= need ORDER BY score DESC LIMIT 1)"""
_VAL = f"""{_md5("coalesce(text, '')")} % 10000 < 0.1::DOUBLE * 10000"""
ORACLE |= {
    "query_score": f"WITH {_SCORED} SELECT row_id, score FROM scored",
    "score_histogram": f"WITH {_SCORED} SELECT score, count(*) AS n FROM scored GROUP BY score",
    "score_threshold": f"WITH {_CUT} SELECT cut_score, tie_p FROM cut",
    "score_keep": f"""WITH {_CUT} SELECT row_id FROM scored, cut WHERE source = 'stack_sql'
  AND (score > cut_score OR (score = cut_score AND {_md5("coalesce(text, '')", 9)} % 10000 < tie_p * 10000))""",
    "hash_split": f"SELECT doc_id, CASE WHEN {_VAL} THEN 'val' ELSE 'train' END AS split FROM documents",
    "upsample_mix": f"SELECT doc_id, unnest(range(1, CASE WHEN coalesce(source, '') = 'gretel_sql' AND NOT ({_VAL}) THEN 4 ELSE 2 END)) AS copy FROM documents",
    "shard_summary": f"""WITH t AS (SELECT source, {_VAL} AS val, length({_words('text')}) + 1 AS n FROM documents),
s AS (SELECT source, count(*) FILTER (NOT val) AS docs_train, count(*) FILTER (val) AS docs_val, coalesce(sum(n) FILTER (NOT val), 0)::BIGINT AS size_train,
  coalesce(sum(n) FILTER (val), 0)::BIGINT AS size_val FROM t GROUP BY source),
a AS (FROM s UNION ALL SELECT 'all', sum(docs_train)::BIGINT, sum(docs_val)::BIGINT, sum(size_train)::BIGINT, sum(size_val)::BIGINT FROM s)
SELECT *, round(size_train / (SELECT sum(size_train) FROM s), 6) AS share FROM a""",
    "sample_groups": f"""WITH g AS (SELECT origin, sum(coalesce(n_chars, 0))::BIGINT AS size, {_md5('origin')} AS h FROM documents WHERE origin IS NOT NULL GROUP BY origin),
b AS (SELECT *, coalesce(sum(size) OVER (ORDER BY h, origin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
SELECT origin, size, CASE WHEN before < 50000 THEN 'sample' WHEN row_number() OVER (PARTITION BY before < 50000 ORDER BY h, origin) = 1 THEN 'held_out' ELSE 'unused' END AS role FROM b""",
    "unfinished_documents": "SELECT doc_id FROM documents ANTI JOIN doc_labels USING (doc_id)",
}

# --------------------------------------------------------------------------------------------------- tokenizer, shards
_WC = f"wc AS (SELECT chunk, count(*) AS n FROM (SELECT unnest({_words('text')}) AS chunk FROM documents) GROUP BY chunk)"
_SIZED = f"sized AS (SELECT doc_id, doc_id // 250 AS shard, length({_words('text')}) AS tokens FROM documents)"
_STARTS = f"""{_SIZED}, n AS (SELECT shard, sum(tokens + 1) AS tokens FROM sized GROUP BY shard),
starts AS (SELECT shard, (tokens - 129)::BIGINT AS starts, (sum(tokens - 129) OVER (ORDER BY shard))::BIGINT AS upto FROM n WHERE tokens > 129)"""
_SPECIAL = r"<\|(?:endoftext|pad|system|user|assistant|end)\|>|</?(?:schema|question|sql)>"
# RE2 looks neither ahead nor back, so a mark is put before the last blank of a run that something else follows
_BLANK = r"[\s\x{0B}\x{85}\p{Z}]"
_FLAT = r"[\t\x{0B}\f\x{85}\p{Z} ]"
_INK = r"[^\s\x{0B}\x{85}\p{Z}]"
_PUNCT = r"[^\s\x{0B}\x{85}\p{Z}\p{L}\p{N}\x{01}]"
_CHUNK = (
    r"'(?i:[sdmt]|ll|ve|re)|[^\r\n\p{L}\p{N}\x{01}]?\p{L}+|\p{N}{1,3}| ?".replace("'", "''", 1)
    + rf"{_PUNCT}+[\r\n]*|{_BLANK}*[\r\n]|{_BLANK}+"
)
_CHUNKS = rf"""parts AS (SELECT unnest(regexp_split_to_array(coalesce(text, ''), '{_SPECIAL}')) AS t FROM documents),
chunks AS (SELECT unnest(regexp_extract_all(regexp_replace(t, '({_BLANK})({_FLAT})({_INK})', '\1' || chr(1) || '\2\3', 'g'), '{_CHUNK}')) AS chunk FROM parts)"""
_MERGES = f"""WITH RECURSIVE {_WC},
st AS (
  SELECT 0 AS step, NULL::INT AS a, NULL::INT AS b, (SELECT list(struct_pack(chunk := chunk, n := n, ids := ids)) FROM (
    SELECT chunk, n, list_transform(range(1, length(x) // 2 + 1), lambda i: ('0x' || substr(x, 2 * i - 1, 2))::INT) AS ids FROM (SELECT chunk, n, hex(encode(chunk)) AS x FROM wc))) AS words
  UNION ALL
  SELECT step + 1, p.a, p.b, list_transform(words, lambda w: struct_pack(chunk := w.chunk, n := w.n, ids := list_reduce(list_transform(w.ids, lambda x: [x]),
    lambda l, x: CASE WHEN l[-1] = p.a AND x[1] = p.b THEN list_append(l[:-2], 256 + step) ELSE list_concat(l, x) END)))
  FROM st, LATERAL (SELECT w.ids[i] AS a, w.ids[i + 1] AS b FROM (SELECT unnest(words) AS w), LATERAL (SELECT unnest(range(1, length(w.ids))) AS i) GROUP BY ALL ORDER BY sum(w.n) DESC, 1, 2 LIMIT 1) p
  WHERE step < 12)"""
_MIX = """mix(phase, until, source, weight) AS (VALUES (0, 0.85, 'fineweb_edu', 0.82), (0, 0.85, 'stack_sql', 0.15), (0, 0.85, 'stackexchange', 0.025),
  (0, 0.85, 'gretel_sql', 0.005), (1, 1.0, 'fineweb_edu', 0.54), (1, 1.0, 'stack_sql', 0.36), (1, 1.0, 'stackexchange', 0.08), (1, 1.0, 'gretel_sql', 0.02))"""
ORACLE |= {
    "word_counts": f"WITH {_WC} SELECT chunk, n FROM wc",
    "byte_pair_counts": f"""WITH {_WC}, h AS (SELECT hex(encode(chunk)) AS x, n FROM wc)
SELECT ('0x' || substr(x, 2 * i - 1, 2))::INT AS a, ('0x' || substr(x, 2 * i + 1, 2))::INT AS b, sum(n)::BIGINT AS n
FROM h, unnest(range(1, (length(x) // 2)::BIGINT)) AS u(i) GROUP BY ALL""",
    "pack_offsets": f"""WITH {_SIZED}, w AS (SELECT *, (sum(tokens + 1) OVER (PARTITION BY shard ORDER BY doc_id))::BIGINT AS stop FROM sized)
SELECT doc_id, shard, tokens, stop, stop - tokens - 1 AS start FROM w""",
    "shard_starts": f"WITH {_STARTS} SELECT shard, starts, upto - starts AS before, upto FROM starts",
    "window_lookup": f"""WITH {_STARTS}, d AS (SELECT event_id, {_md5('event_id::VARCHAR')} % (SELECT max(upto) FROM starts) AS draw FROM events)
SELECT event_id, shard, draw - (upto - starts) AS "offset" FROM d JOIN starts ON draw >= upto - starts AND draw < upto""",
    "mix_phase": f"""WITH {_MIX}, e AS (SELECT CASE WHEN event_id % 1000 / 1000 < 0.85 THEN 0 ELSE 1 END AS phase FROM events)
SELECT phase, source, count(*) AS n, round(max(weight)::DOUBLE, 6) AS weight FROM e JOIN mix USING (phase) GROUP BY ALL""",
    "mix_average": f"WITH {_MIX} SELECT source, round(sum(weight * CASE phase WHEN 0 THEN 0.85 ELSE 0.15 END)::DOUBLE, 6) AS weight FROM mix GROUP BY source",
    "mix_draws": f"""WITH e AS (SELECT {_md5('event_id::VARCHAR', 1, 13)}::DOUBLE / 4503599627370496 AS u FROM events)
SELECT CASE WHEN u < 0.82 THEN 'fineweb_edu' WHEN u < 0.97 THEN 'stack_sql' WHEN u < 0.995 THEN 'stackexchange' ELSE 'gretel_sql' END AS source, count(*) AS n FROM e GROUP BY ALL""",
    "token_windows": f"""WITH t AS (SELECT doc_id, doc_id // 250 AS shard, list_append(list_transform({_words('text')}, lambda w: length(w)), 0) AS t FROM documents),
o AS (SELECT *, sum(length(t)) OVER (PARTITION BY shard ORDER BY doc_id) - length(t) AS start FROM t),
e AS (SELECT shard, (start + i - 1)::BIGINT AS pos, t[i] AS id FROM o, unnest(range(1, length(t) + 1)) AS u(i)),
w AS (SELECT shard, pos // 2048 AS "window", pos, id FROM e UNION ALL SELECT shard, pos // 2048 - 1, pos, id FROM e WHERE pos % 2048 = 0 AND pos > 0),
g AS (SELECT shard, "window", list(id ORDER BY pos) AS l FROM w GROUP BY ALL)
SELECT shard, "window", length(l) - 1 AS tokens, md5(array_to_string(l[:-2], ' ')) AS x, md5(array_to_string(l[2:], ' ')) AS y FROM g WHERE length(l) > 1""",
    "chunk_counts": f"""WITH {_CHUNKS} SELECT chunk, count(*) AS n FROM chunks GROUP BY chunk""",
    "first_merges": f"""{_MERGES} SELECT (step - 1)::INT AS rank, a, b FROM st WHERE step > 0""",
    "word_ids": f"""{_MERGES} SELECT unnest(list_transform(words, lambda w: w.chunk)) AS chunk, unnest(list_transform(words, lambda w: array_to_string(w.ids, ' '))) AS ids FROM st WHERE step = 12""",
    "decode_roundtrip": "SELECT doc_id, md5(coalesce(text, '')) AS text_md5 FROM documents",
    "control_tokens": f"""SELECT row_id, CASE WHEN coalesce(source, '') = 'gretel_sql' THEN length(regexp_extract_all(coalesce(text, ''), '{_SPECIAL}')) ELSE 0 END AS specials FROM clean_docs""",
    "bytes_per_word": f"""WITH t AS (SELECT source, strlen(text) AS b, length({_words('text')}) AS n FROM documents WHERE text IS NOT NULL),
m AS (SELECT source, list_sort(list(b / n))[(count(*) // 2 + 1)::BIGINT] AS m FROM t WHERE n > 0 GROUP BY source), w AS (SELECT source, sum(b) / sum(n) AS w FROM t GROUP BY source)
SELECT w.source, round(w, 6) AS bytes_per_token, round(m, 6) AS median_bytes_per_token FROM w LEFT JOIN m ON w.source IS NOT DISTINCT FROM m.source""",
    "special_pieces": f"""WITH t AS (SELECT row_id, coalesce(text, '') AS t FROM clean_docs)
SELECT row_id, length(list_filter(regexp_split_to_array(t, '{_SPECIAL}'), lambda x: x <> '')) + length(regexp_extract_all(t, '{_SPECIAL}')) AS pieces,
  length(regexp_extract_all(t, '{_SPECIAL}')) AS specials FROM t""",
}

# ------------------------------------------------------------------------------------------------------------- dialect
_PIECES = """"(?:[^"]|"")*"?|''(?:[^'']|'''')*''?|[^''"]+"""
_RAN = """q AS (SELECT n_nationkey AS k, n_nationkey % 6 AS agg, n_nationkey % 8 AS m, n_nationkey % 2 = 1 AS two FROM nation),
s AS (SELECT k, two, 'g' AS side, agg, agg IN (0, 3) AS words, k AS nation FROM q
  UNION ALL SELECT k, two, 'p', CASE m WHEN 2 THEN (agg + 1) % 6 ELSE agg END, agg IN (0, 3), CASE m WHEN 3 THEN k + 1 ELSE k END FROM q WHERE m NOT IN (4, 5, 7)),
r AS (SELECT s.*, c_custkey, c_acctbal AS v, lower(c_mktsegment) AS t, CASE WHEN words THEN lower(c_mktsegment) ELSE round(c_acctbal, 6)::VARCHAR END AS x
  FROM s LEFT JOIN customer ON c_nationkey = nation AND (NOT two OR c_acctbal > 0)),
ran AS (SELECT k, side, agg, count(c_custkey) AS n, CASE WHEN agg = 0 THEN list_sort(coalesce(list(x) FILTER (c_custkey IS NOT NULL), [])) ELSE [coalesce(CASE agg
    WHEN 1 THEN CASE WHEN words THEN max(t) ELSE round(max(v), 6)::VARCHAR END WHEN 2 THEN CASE WHEN words THEN min(t) ELSE round(min(v), 6)::VARCHAR END
    WHEN 3 THEN count(x)::VARCHAR WHEN 4 THEN CASE WHEN words THEN (0 * sum(v))::VARCHAR ELSE round(sum(v), 6)::VARCHAR END
    ELSE CASE WHEN words THEN (0 * sum(v))::VARCHAR ELSE round(avg(v), 6)::VARCHAR END END, 'NULL')] END AS res FROM r GROUP BY k, side, agg, words),
matched AS (SELECT q.*, p.k IS NOT NULL AS valid, coalesce(p.res = g.res, false) AS correct FROM q LEFT JOIN ran p ON p.k = q.k AND p.side = 'p' JOIN ran g ON g.k = q.k AND g.side = 'g')"""
_EXECUTED = {
    "text_execute": f"""WITH {_RAN}, e AS (SELECT q.k, p.k IS NOT NULL AS valid, coalesce(p.n, 0) AS n, p.agg, p.res FROM q LEFT JOIN ran p ON p.k = q.k AND p.side = 'p')
SELECT k::BIGINT AS query_id, valid, n, CASE WHEN agg > 0 THEN round(try_cast(res[1] AS DOUBLE), 2) END AS number,
  CASE WHEN agg = 0 THEN coalesce(list_sum(list_transform(res, lambda x: {_md5('x', 1, 12)})), 0)::BIGINT || ':' || coalesce(list_sum(list_transform(res, lambda x: {_md5('x', 13, 12)})), 0)::BIGINT END AS digest FROM e""",
    "execution_match": f"WITH {_RAN} SELECT k::BIGINT AS query_id, valid, correct FROM matched",
    "execution_scores": f"""WITH {_RAN} SELECT count(*) AS n, round(avg(valid::INT), 6) AS valid, round(avg(correct::INT), 6) AS correct,
  round(avg((m = 0 OR (m = 1 AND NOT two))::INT), 6) AS exact FROM matched""",
    "gold_self_check": "SELECT n_nationkey::BIGINT AS query_id, n_nationkey % 9 <> 8 AS valid, n_nationkey % 9 <> 8 AS correct FROM nation",
}
_URGENT = "FROM orders WHERE lower(o_orderpriority) = '1-urgent' AND o_totalprice < 200000"
ORACLE |= {
    "dialect_select": "SELECT lower(c_name) AS result FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 5000",
    "dialect_max": f"SELECT round(max(o_totalprice), 2) AS result {_URGENT}",
    "dialect_min": f"SELECT round(min(o_totalprice), 2) AS result {_URGENT}",
    "dialect_count": f"SELECT count(o_totalprice)::DOUBLE AS result {_URGENT}",
    "dialect_sum": f"SELECT round(sum(o_totalprice), 2) AS result {_URGENT}",
    "dialect_avg": f"SELECT round(avg(o_totalprice), 2) AS result {_URGENT}",
    "dialect_text_number": "SELECT op, CASE WHEN op = 2 THEN count(c_acctbal) ELSE 0 END AS result FROM customer, range(3) r(op) GROUP BY op",
    "dialect_sum_text": r"SELECT sum(coalesce(nullif(regexp_extract(o_orderpriority, '^[0-9]+'), '')::DOUBLE, 0)) AS result FROM orders WHERE lower(o_orderstatus) = 'o'",
    "lex_pieces": f"""WITH {_ITEMS}, p AS (SELECT item_id, regexp_extract_all(gold_sql, '{_PIECES}') AS p FROM items)
SELECT item_id, length(p) AS n, array_to_string(list_transform(p, lambda x: CASE x[1] WHEN '"' THEN 'ident' WHEN '''' THEN 'string' ELSE 'code' END), ' ') AS kinds,
  array_to_string(list_transform(p, lambda x: CASE x[1] WHEN '"' THEN replace(x[2:-2], '""', '"') WHEN '''' THEN replace(x[2:-2], '''''', '''') ELSE x END), '|') AS texts FROM p""",
    "lower_literals": f"""WITH {_ITEMS}, p AS (SELECT item_id, regexp_extract_all(gold_sql, '{_PIECES}') AS p FROM items)
SELECT item_id, array_to_string(list_transform(p, lambda x: CASE WHEN x[1] = '''' THEN lower(x) ELSE x END), '') AS sql FROM p""",
    "unknown_identifiers": f"""WITH {_ITEMS}, p AS (SELECT item_id, names, list_transform(list_filter(regexp_extract_all(gold_sql, '{_PIECES}'), lambda x: x[1] = '"'),
  lambda x: replace(x[2:-2], '""', '"')) AS i FROM items)
SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(i, lambda x: NOT list_contains(list_slice(names, 1, 2), x) AND x <> 't'))), '|') AS unknown FROM p""",
    "parse_roundtrip": "SELECT item_id, TRUE AS same FROM eval_questions JOIN table_meta USING (table_id)",
    "grammar_states": "SELECT item_id, 'complete' AS whole, 'prefix' AS half FROM eval_questions JOIN table_meta USING (table_id)",
    "grammar_pattern": "SELECT item_id, TRUE AS whole, FALSE AS cut FROM eval_questions JOIN table_meta USING (table_id)",
    "batch_execute": f"""WITH q AS (SELECT n_nationkey AS k, n_nationkey % 6 AS agg, n_nationkey % 5 = 4 AS free, n_nationkey % 2 = 1 AS two FROM nation),
r AS (SELECT k, agg, c_acctbal AS v, lower(c_mktsegment) AS t FROM q LEFT JOIN customer ON free OR (c_nationkey = k AND (NOT two OR c_acctbal > 0)))
SELECT k::BIGINT AS query_id, count(t) AS n, round(CASE agg WHEN 1 THEN max(v) WHEN 2 THEN min(v) WHEN 3 THEN count(t) WHEN 4 THEN sum(v) WHEN 5 THEN avg(v) END, 2) AS number,
  CASE WHEN agg = 0 THEN coalesce(sum({_md5('t', 1, 12)}), 0)::HUGEINT || ':' || coalesce(sum({_md5('t', 13, 12)}), 0)::HUGEINT END AS digest FROM r GROUP BY k, agg""",
    "grammar_question": f"""WITH {_ITEMS}, v AS (SELECT item_id, length(conds) <= 6 AND list_bool_and(list_append(list_transform(conds, lambda c: c.op < 3 AND c.val <> ''
  AND contains(lower(coalesce(question, '') || ' about ' || upper(coalesce(conds[1].val, ''))), lower(c.val))), true)) AS ok,
  list_bool_and(list_append(list_transform(conds, lambda c, i: contains(lower(coalesce(question, '') || ' about ' || upper(coalesce(conds[1].val, ''))),
    CASE WHEN i = length(conds) THEN lower(c.val[:-2]) ELSE lower(c.val) END)), true)) AS begun FROM items)
SELECT item_id, CASE WHEN ok THEN 'complete' ELSE 'invalid' END AS whole, CASE WHEN ok THEN 'complete' ELSE 'invalid' END AS upper, 'invalid' AS spaced,
  CASE WHEN begun THEN 'prefix' ELSE 'invalid' END AS cut FROM v""",
    "value_grounding": """SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 3 WHEN 4 THEN 3 ELSE 0 END AS col_ix,
  CASE c_custkey % 5 WHEN 0 THEN lower(c_mktsegment) WHEN 3 THEN 'the ' || c_mktsegment || ' segment' WHEN 4 THEN c_mktsegment ELSE lower(c_name) END AS val FROM customer""",
} | _EXECUTED

# ---------------------------------------------------------------------------------------------------------- evaluation
_PRED = f"""{_ITEMS}, pr AS (
  SELECT *, CASE m WHEN 1 THEN (sel + 1) % n ELSE sel END AS p_sel, CASE m WHEN 2 THEN (agg + 1) % 6 ELSE agg END AS p_agg,
    CASE m WHEN 3 THEN list_transform(conds, lambda c, i: CASE WHEN i = 1 THEN struct_pack(col_ix := c.col_ix, op := c.op, val := 'changed') ELSE c END)
      WHEN 4 THEN list_slice(conds, 1, (length(conds) - 1)::BIGINT)
      WHEN 5 THEN list_append(conds, struct_pack(col_ix := ((sel + 1) % n)::INT, op := 1, val := 'extra'))
      WHEN 6 THEN list_transform(conds, lambda c, i: CASE WHEN i = 1 THEN struct_pack(col_ix := c.col_ix, op := ((c.op + 1) % 3)::INT, val := c.val) ELSE c END)
      ELSE conds END AS p_conds
  FROM (SELECT *, item_id % 8 AS m, length(header) AS n FROM items)),
lists AS (
  SELECT *, list_sort(list_transform(conds, lambda c: struct_pack(c := c.col_ix, o := c.op, v := lower(trim(c.val))))) AS g,
    list_sort(list_transform(p_conds, lambda c: struct_pack(c := (list_position(names, names[c.col_ix + 1]) - 1)::INT, o := c.op, v := lower(trim(c.val))))) AS p,
    list_position(names, names[p_sel + 1]) - 1 AS found_sel FROM pr),
kinds AS (
  SELECT *, list_distinct(list_concat(CASE WHEN found_sel <> sel THEN ['select column'] ELSE []::VARCHAR[] END, CASE WHEN p_agg <> agg THEN ['aggregation'] ELSE []::VARCHAR[] END,
    CASE WHEN p = g THEN []::VARCHAR[]
      WHEN length(p) < length(g) AND length(list_filter(p, lambda x: NOT list_contains(g, x))) = 0 THEN ['missing condition']
      WHEN length(p) > length(g) AND length(list_filter(g, lambda x: NOT list_contains(p, x))) = 0 THEN ['extra condition']
      WHEN length(p) = length(g) THEN list_filter(list_transform(g, lambda x, i: CASE WHEN x.c <> p[i].c THEN 'condition column' WHEN x.o <> p[i].o THEN 'operator'
        WHEN x.v <> p[i].v THEN 'value' END), lambda y: y IS NOT NULL)
      ELSE ['multiple'] END)) AS wrong FROM lists),
judged AS (
  SELECT *, m <> 7 AS valid, CASE WHEN m = 7 THEN 'invalid' WHEN length(wrong) = 1 THEN wrong[1] WHEN length(wrong) > 1 THEN 'multiple' END AS category,
    m <> 7 AND found_sel = sel AND p_agg = agg AND p = g AS correct, m <> 7 AND lower({_render('p_sel', 'p_agg', 'p_conds')}) = lower(gold_sql) AS exact FROM kinds)"""
ORACLE |= {
    "failure_category": f"WITH {_PRED} SELECT item_id, category FROM judged",
    "failure_summary": f"""WITH {_PRED}, k(ix, category) AS (VALUES (0, 'invalid'), (1, 'select column'), (2, 'aggregation'), (3, 'condition column'), (4, 'operator'), (5, 'value'),
  (6, 'missing condition'), (7, 'extra condition'), (8, 'multiple'), (9, 'other'), (10, 'right but different')),
c AS (SELECT CASE WHEN NOT correct THEN coalesce(category, 'other') WHEN category IS NOT NULL THEN 'right but different' END AS category, NOT correct AS w FROM judged)
SELECT ix, k.category, count(c.category) AS n, coalesce(round(count(c.category) FILTER (w) / (SELECT count(*) FILTER (w) FROM c), 6), 0) AS share
FROM k LEFT JOIN c ON c.category = k.category GROUP BY ix, k.category""",
    "score_summary": f"WITH {_PRED} SELECT count(*) AS n, round(avg(valid::INT), 6) AS valid, round(avg(correct::INT), 6) AS correct, round(avg(exact::INT), 6) AS exact FROM judged",
    "accuracy_by_conditions": f"WITH {_PRED} SELECT length(conds) AS k, count(*) AS n, round(avg(correct::INT), 6) AS accuracy FROM judged GROUP BY ALL",
    "component_accuracy": f"""WITH {_PRED} SELECT round(avg((m <> 7 AND found_sel = sel)::INT), 6) AS select_ok, round(avg((m <> 7 AND p_agg = agg)::INT), 6) AS aggregate_ok,
  round(avg((m <> 7 AND list_transform(p, lambda x: x.c) = list_transform(g, lambda x: x.c))::INT), 6) AS columns_ok, round(avg((m <> 7 AND p = g)::INT), 6) AS where_ok FROM judged""",
    "misaligned_predictions": """WITH p AS (SELECT page_id, min(epoch_us(loaded_at)) AS pred_side FROM web_pages WHERE text IS NOT NULL GROUP BY page_id),
i AS (SELECT page_id, max(epoch_us(loaded_at)) AS item_side FROM web_pages GROUP BY page_id)
SELECT page_id, pred_side, item_side FROM p FULL JOIN i USING (page_id) WHERE pred_side IS DISTINCT FROM item_side""",
    "length_batches": f"""WITH q AS (SELECT item_id, length({_words('question')}) AS length FROM eval_questions)
SELECT item_id, length, ceil(row_number() OVER (PARTITION BY length ORDER BY item_id) / 64)::BIGINT AS batch FROM q""",
}

# ---------------------------------------------------------------------------------------------------------- statistics
_RATE = "r AS (SELECT rater AS system, doc_id AS item_id, max((verdict = 'unsafe')::INT) AS correct FROM doc_labels WHERE verdict IN ('safe', 'unsafe') GROUP BY ALL)"
ORACLE |= {
    "system_mean_std": f"WITH {_RATE} SELECT system, count(correct) AS n, round(avg(correct), 6) AS mean, round(coalesce(stddev_samp(correct), 0), 6) AS std FROM r GROUP BY system",
    "mcnemar": f"""WITH {_RATE}, p AS (SELECT a.correct AS a, b.correct AS b FROM r a JOIN r b USING (item_id) WHERE a.system = 'rater1' AND b.system = 'rater2'),
c AS (SELECT count(*) FILTER (a = 1 AND b = 0) AS only_a, count(*) FILTER (a = 0 AND b = 1) AS only_b FROM p),
x AS (SELECT *, CASE WHEN only_a + only_b = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform(range(0, least(only_a, only_b) + 1),
  lambda i: exp(lgamma(only_a + only_b + 1) - lgamma(i + 1) - lgamma(only_a + only_b - i + 1) - (only_a + only_b) * ln(2))))) END::DOUBLE AS p FROM c)
SELECT only_a, only_b, round(p, 9) AS p, round(ln(p), 6) AS log_p FROM x""",
    "system_pairs": f"""WITH {_RATE} SELECT a.system AS sys_a, b.system AS sys_b, count(*) AS n, round(avg(a.correct - b.correct), 6) AS diff,
  count(*) FILTER (a.correct = 1 AND b.correct = 0) AS only_a, count(*) FILTER (a.correct = 0 AND b.correct = 1) AS only_b FROM r a JOIN r b USING (item_id)
WHERE (a.system, b.system) IN (('rater1', 'rater2'), ('rater1', 'rater3'), ('rater2', 'rater3')) GROUP BY ALL""",
    "item_means": f"WITH {_RATE} SELECT item_id, round(avg(correct), 6) AS mean, count(*) AS runs FROM r GROUP BY item_id",
    "verdict_audit": """WITH n AS (SELECT verdict, count(*) AS n FROM doc_labels GROUP BY verdict), t AS (SELECT *, n / sum(n) OVER () AS p, sum(n) OVER () AS t, 1.959964::DOUBLE AS z FROM n)
SELECT verdict, n, round((p + z * z / (2 * t)) / (1 + z * z / t) - z * sqrt(p * (1 - p) / t + z * z / (4 * t * t)) / (1 + z * z / t), 6) AS low,
  round((p + z * z / (2 * t)) / (1 + z * z / t) + z * sqrt(p * (1 - p) / t + z * z / (4 * t * t)) / (1 + z * z / t), 6) AS high FROM t""",
}

# ------------------------------------------------------------------------------------------------- logs, distributions
_P = """p AS (SELECT *, e / sum(e) OVER (PARTITION BY user_id) AS p FROM (SELECT *, exp((value - max(value) OVER (PARTITION BY user_id)) / 10.0::DOUBLE) AS e FROM events))"""
_SETTING = "round(avg(value), 6)"
ORACLE |= {
    "smooth_values": """SELECT event_id, round(CASE WHEN event_id < 200 THEN value
  ELSE avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) END, 6) AS smoothed FROM events""",
    "tail_summary": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events)
SELECT event_type, max(event_id) AS last_step, round(avg(value) FILTER (r <= 8), 6) AS tail_mean, round(max(value), 6) AS max_value,
  round(list_sort(list(value))[count(*) // 2 + 1], 6) AS median_value FROM e GROUP BY event_type""",
    "weighted_score": """WITH e AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY ALL), w(event_type, w) AS (VALUES ('click', 0.6::DOUBLE), ('view', 0.3), ('purchase', 0.1))
SELECT user_id, round(sum(w * v) / sum(w), 9) AS score FROM e JOIN w USING (event_type) GROUP BY user_id""",
    "best_by_group": f"""WITH e AS (SELECT user_id % 10 AS setting, {_SETTING} AS score FROM events GROUP BY ALL), b AS (SELECT * FROM e ORDER BY score, setting LIMIT 1)
SELECT setting AS best, score, setting = (SELECT min(setting) FROM e) OR setting = (SELECT max(setting) FROM e) AS at_edge FROM b""",
    "best_setting": f"""WITH e AS (SELECT user_id % 10 AS setting, event_type, {_SETTING} AS value FROM events GROUP BY ALL)
SELECT setting AS best, max(value) AS value FROM e GROUP BY setting ORDER BY value DESC, setting LIMIT 1""",
    "label_spread": """WITH i AS (SELECT n_name AS label, n_regionkey AS g, n_nationkey / 10 AS y, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey / 10, n_name) - 1 AS i FROM nation)
SELECT label, round(max(y - i * 0.75::DOUBLE) OVER (PARTITION BY g ORDER BY i) + i * 0.75::DOUBLE, 6) AS place FROM i""",
    "throughput": """WITH e AS (SELECT event_id, epoch_us(ts) / 1000000 AS t, lag(event_id) OVER w AS p, lag(epoch_us(ts) / 1000000) OVER w AS pt FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id)),
v AS (SELECT event_id, CASE WHEN t - pt > 0 THEN round(1000 * (event_id - p) / (t - pt), 6) END AS tps FROM e)
SELECT event_id, round(tps, 2) AS tokens_per_s, round(6 * 1.25e8::DOUBLE * tps / 1.2e14::DOUBLE, 14) AS mfu FROM v""",
    "log_row_kinds": """WITH e AS (SELECT event_type, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events)
SELECT event_type, count(k) AS with_k, count(*) - count(k) AS without_k, round(avg(k), 6) AS mean_k FROM e GROUP BY event_type""",
    "cosine_schedule": """SELECT o_orderkey, round(CASE WHEN o_orderkey < 100 THEN 1e-3::DOUBLE * (o_orderkey + 1) / 100
  ELSE 1e-4::DOUBLE + 0.5::DOUBLE * 9e-4::DOUBLE * (1 + cos(pi() * least(1.0::DOUBLE, (o_orderkey - 100) / greatest(1, (SELECT max(o_orderkey) FROM orders) - 100)))) END, 9) AS rate FROM orders""",
    "source_losses": "SELECT event_type, count(value) AS batches, round(avg(value), 6) AS loss FROM events GROUP BY event_type",
    "gains_table": """WITH g AS (SELECT user_id, avg(value) FILTER (event_type = 'view') AS v, avg(value) FILTER (event_type = 'click') AS c, avg(value) FILTER (event_type = 'purchase') AS p FROM events GROUP BY user_id)
SELECT user_id, round(v, 6) AS view, round(c, 6) AS click, round(p, 6) AS purchase, round(c - v, 6) AS click_gain, round(p - v, 6) AS purchase_gain FROM g""",
    "softmax_scores": f"WITH {_P} SELECT event_id, round(p, 9) AS p FROM p",
    "topk_filter": "SELECT event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) <= 3",
    "nucleus_filter": f"""WITH {_P} SELECT event_id FROM p QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY p DESC, event_id) = 1 OR
  round(coalesce(sum(p) OVER (PARTITION BY user_id ORDER BY p DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 12) < 0.5""",
    "inverse_cdf": f"""WITH e AS (SELECT user_id, event_id, sum(event_id % 7 + 1) OVER (PARTITION BY user_id ORDER BY event_id) AS c,
  {_md5('user_id::VARCHAR', 1, 13)}::DOUBLE / 4503599627370496 * sum(event_id % 7 + 1) OVER (PARTITION BY user_id) AS u FROM events)
SELECT user_id, coalesce(min(event_id) FILTER (c > u), max(event_id)) AS drawn FROM e GROUP BY user_id""",
    "greedy_choice": "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) = 1",
    "cross_entropy": """WITH m AS (SELECT user_id, event_id, value / 10 AS v, max(value / 10) OVER (PARTITION BY user_id) AS m, min(event_id) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id) AS f FROM events)
SELECT user_id, round(max(m) + ln(sum(exp(v - m))) - max(v) FILTER (event_id = f), 6) AS loss FROM m GROUP BY user_id HAVING max(f) IS NOT NULL""",
    "clip_scale": "SELECT round(sqrt(sum(value * value)), 4) AS norm, round(least(1, 1 / (sqrt(sum(value * value)) + 1e-6)), 9) AS scale FROM events",
    "rmsnorm_vectors": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e, list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) AS s FROM embeddings)
SELECT vec_id, round(e[1] / sqrt(s / length(e) + 1e-5::DOUBLE), 5) AS first, round(s / (s / length(e) + 1e-5::DOUBLE), 4) AS square FROM v""",
    "label_cosine": """WITH c AS (SELECT label, arg_min(embedding, vec_id) AS c FROM embeddings GROUP BY label)
SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], c::DOUBLE[]), 5) AS cosine FROM embeddings JOIN c USING (label)""",
    "rotary_vectors": """SELECT vec_id, round(embedding[1]::DOUBLE * cos(vec_id % 128) - embedding[length(embedding) // 2 + 1]::DOUBLE * sin(vec_id % 128), 5) AS first,
  round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)), 4) AS square FROM embeddings""",
    "silu_values": "SELECT event_id, round(value / (1 + exp(-value)), 6) AS silu FROM events",
    "embedding_lookup": "SELECT event_id, round(embedding[4]::DOUBLE, 6) AS value FROM events e LEFT JOIN embeddings v ON v.vec_id = e.event_id % 700",
}
