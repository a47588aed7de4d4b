"""Problem 2: SQL files that nobody wrote by hand in their repository."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.operators.similarity import clusters
from quernel.session import cut, dropped, scratch
from quernel.sources.tables import latest

SHINGLE = 5
BANDS, ROWS = 25, 5
SIMILAR = 0.8
#: Sketches of two bits a function: of pairs at the Jaccard ``SIMILAR`` one in a thousand million differs in more functions.
SKETCH_FAR = 46
#: Files that are alike are copies, not alike by chance, if they share so many shingles that are rare elsewhere: at most
#: one file outside for so many files that have the shingle.
COPY_RARE, COPY_OUTSIDE = 16, 10
#: A file made by a tool repeats itself: at least so many tokens, at most so many distinct masked shingles a token.
FAMILY_TOKENS, FAMILY_RATIO, FAMILY_FILES = 150, 0.2, 3
#: At least this share of a tool's family consists of shingles that are mostly its own; what people write is not.
FAMILY_OWN = 0.5
#: Any other script is a tool's if this share of its masked shingles, and so many, are mostly those of tools' families.
FAMILY_LIKE, FAMILY_KINDS = 0.8, 16
DATA_SHARE = 0.75
#: What comments say is told from corpus counts: runs of words in so many files, rounds of expectation-maximisation, what a
#: verdict needs, and the weights to begin with: of files whose comments stand only at an edge, and of the others.
REMARK_FILES, REMARK_ROUNDS, REMARK_SURE = 3, 5, 0.95
REMARK_EDGE, REMARK_INSIDE = 0.5, 0.02
#: Rows of a side that is broadcast.
BROADCAST_ROWS = 500_000
#: Minified: so many separators, mostly without a blank behind them, on lines of such a mean length.
DENSE_SIGNS, DENSE_SHARE, DENSE_LINE = 20, 0.7, 200

# Words of SQL that are kept when identifiers are masked, and its types, which count as equal.
KEYWORDS = frozenset(
    """add all alter and as asc avg begin by case column commit constraint copy count create cross cursor database
    declare default delete desc distinct drop else end exception exec execute exists foreign from full function go grant
    group having if in index inner insert into is join key language left like limit max min not null offset on or order
    outer over partition primary procedure raise references replace return returns revoke right rollback select set sum
    table temporary then trigger truncate union unique update use using values view when where with""".split()
)
TYPES = frozenset(
    """bigint bigserial bit blob boolean char character clob date datetime decimal double float int integer json numeric
    nvarchar precision real serial smallint text time timestamp timestamptz tinyint uuid varchar""".split()
)

_COMMENT = re.compile(r"--[^\n]*|/\*.*?(?:\*/|\Z)|^[ \t]*#[^\n]*", re.S | re.M)
_TOKEN = re.compile(r"'(?:[^']|'')*'|0x[0-9a-f]+|\d+(?:\.\d+)?|[^\W\d]\w*|[^\s\w]")
_STATEMENT = re.compile(
    r"\s*(?:select|with|create|alter|drop|update|delete|insert|merge|begin|commit|rollback|set|use|go|grant|revoke|"
    r"truncate|declare|if|exec|execute|call|explain|copy|comment|raise|return|end|do|lock|vacuum|analyze)\b",
    re.I,
)
_ROWS = re.compile(r"\s*insert\s+into\s[^;']*?\bvalues\b", re.I)
_COPY = re.compile(r"\s*copy\s.*\bfrom\s+stdin\s*$", re.I | re.S)
# What files say of themselves. They decide only where the clusters and the corpus counts do not.
_GENERATED = re.compile(
    r"^(?:this\s+(?:file|script)\s+(?:was|is)\s+)?(?:auto[- ]?generated|generated|machine[- ]written)\s+(?:automatically\s+)?(?:by|with|from)\s"
    r"|^@generated\b|\bdo\s+not\s+(?:edit|modify)\b(?=\s*(?:[.!;,]|$|by\s+hand|manually|this\s+file))",
    re.I,
)
_COPIED = re.compile(r"^vendored\s+from\b|^third[- ]party:|^copied\s+(?:unchanged\s+)?from\s+the\b", re.I)
_ENDS = re.compile(r"'(?:[^']|'')*'|;")
_TIGHT = re.compile(r"[,;=<>](?=[^\s=>])")
_REMARK = re.compile(r"\w+|[^\w\s]")
_FENCE = re.compile(r"^\s*(?:--+|/\*+!?|#+)|\*+/$")
_STRING = re.compile(r"'(?:[^']|'')*'")


_FACTOR = np.uint64(0x9E3779B97F4A7C15)


class _Memory(dict):
    """What a worker knows of single tokens; looked up without a call, and emptied when full."""

    def __init__(self, of: Callable):
        self.of = of

    def __missing__(self, token: str):
        if len(self) >= 200_000:
            self.clear()
        value = self[token] = self.of(token)
        return value


def _plain(w: str) -> str:
    return "S" if w[0] == "'" else "N" if w[0].isdigit() else "T" if w in TYPES else w


_hashes = _Memory(xxhash.xxh64_intdigest)
_plains = _Memory(_plain)
_masks = _Memory(lambda p: "I" if (p[0].isalpha() or p[0] == "_") and p not in KEYWORDS and p not in ("S", "N", "T") else p)
_mask_hashes = _Memory(lambda w: _hashes[_masks[_plains[w]]])
_firsts = _Memory(lambda p: first if p[0].isalpha() and p not in KEYWORDS and len(first := p.split("_")[0]) > 3 else "")
_spoken = _Memory(lambda w: "0" if any(map(str.isdigit, w)) else w)


def _masked(raw: list[str]) -> tuple[list[str], list[str]]:
    plain = list(map(_plains.__getitem__, raw))
    return plain, list(map(_masks.__getitem__, plain))


def tokens(body: str) -> tuple[list[str], list[str]]:
    """Tokens of comment-free SQL with literals and types masked, and the same with identifiers masked too."""
    return _masked(_TOKEN.findall(body.lower()))


def shingles(words: list[str]) -> np.ndarray:
    """Distinct 32-bit hashes of the runs of SHINGLE tokens; fewer tokens are one run."""
    return _runs(np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words)))


def _runs(h: np.ndarray) -> np.ndarray:
    runs = max(1, len(h) - SHINGLE + 1)
    out = np.full(runs, len(h) < SHINGLE, dtype=np.uint64)
    for j in range(min(SHINGLE, len(h))):
        out = out * _FACTOR + h[j : j + runs]
    out ^= out >> np.uint64(29)
    out *= _FACTOR
    out >>= np.uint64(32)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


_rng = np.random.Generator(np.random.PCG64(20260101))
_A = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)
_LOW, _HIGH = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77)
_BAND = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """MinHash of a set of 32-bit hashes: the smallest of each function ``a * h + b`` of 32 bits."""
    best = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, dtype=np.uint32)
    x = hashes.astype(np.uint32)
    for i in range(0, len(x), 256):
        y = x[i : i + 256, None] * _A
        y += _B
        np.minimum(best, y.min(0), out=best)
    return best


def _banded(best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, a signature, the keys of its bands and a sketch: two bits of each function, as two planes of two words."""
    keys = np.tile(_BAND, (len(best), 1))
    for j in range(ROWS):
        keys = (keys ^ best[:, j::ROWS]) * _FACTOR
        keys ^= keys >> np.uint64(31)
    mixed = best * _LOW ^ best * _HIGH >> np.uint32(7)
    planes = np.zeros((len(best), 2, 128), dtype=bool)
    planes[:, 0, : BANDS * ROWS] = mixed >> np.uint32(31)
    planes[:, 1, : BANDS * ROWS] = mixed >> np.uint32(30) & np.uint32(1)
    return keys.view(np.int64), np.packbits(planes, axis=2).reshape(len(best), 32).view(np.int64)


def remarks(content: str, comments: list[re.Match]) -> tuple[list[int], bool]:
    """Hashes of the words and word pairs of the comments, figures being equal to each other, and whether all comments
    stand on lines of their own before the first or behind the last statement."""
    grams: set[str] = set()
    spans: list[list[int]] = []
    for m in comments:
        if spans and not content[spans[-1][1] : m.start()].strip():
            spans[-1][1] = m.end()
        else:
            spans.append([m.start(), m.end()])
        for line in m.group().lower().split("\n"):
            words = list(map(_spoken.__getitem__, _REMARK.findall(line.strip(" \t\r-/*#!"))))
            grams.update(words)
            grams.update(map(" ".join, zip(["^", *words], [*words, "$"])) if words else ())
    first = len(content) - len(content.lstrip())
    last = len(content.rstrip())
    edge = all(
        (b <= first or e >= last) and not content[content.rfind("\n", 0, b) + 1 : b].strip() for b, e in spans
    )
    return sorted(_hashes[g] - (1 << 63) for g in grams), edge


def data_share(body: str) -> float:
    """Share of the characters that are rows of data: inserted literals, copied rows, or no statements at all."""
    if not body.strip():
        return 0.0
    data, copying = 0, False
    low = body.lower()
    copies, inserts = "copy" in low, "insert" in low or not body.isascii()
    for part in _split(body, copies):
        if copying:
            data += len(part)
            copying = not part.rstrip().endswith("\\.")
        elif copies and _COPY.match(part.rstrip().rstrip(";")):
            data += len(part)
            copying = True
        elif inserts and (m := _ROWS.match(part)):
            rest = tokens(part[m.end() :])[1]
            names = sum(w == "I" for w in rest)
            data += len(part) if names <= 0.05 * len(rest) else 0
        elif part.strip() and not _STATEMENT.match(part):
            data += len(part)
    return data / len(body)


def _split(body: str, copies: bool = True) -> Iterator[str]:
    """Statements, cut behind each semicolon outside strings; text after ``copy ... from stdin;`` up to ``\\.`` is one.
    ``copies``: whether there may be such text."""
    at = 0
    for m in _ENDS.finditer(body):
        if m.start() < at or m.group() != ";":
            continue
        yield body[at : m.end()]
        if copies and _COPY.match(body[at : m.start()]):
            end = body.find("\n\\.", m.end())
            stop = len(body) if end < 0 else end + 3
            yield body[m.end() : stop]
            at = stop
        else:
            at = m.end()
    yield body[at:]


def describe(content: str, repo: str | None) -> dict:
    """What one file shows by itself, its sets of hashes, signatures of those that are compared, and whether its names are
    those of its own repository."""
    comments = list(_COMMENT.finditer(content))
    lines = [x.strip().strip("*!").strip() for c in comments for x in _FENCE.sub("", c.group()).split("\n")]
    body = " ".join(map(content.__getitem__, map(slice, [0, *(c.end() for c in comments)], [*(c.start() for c in comments), None])))
    low = body.lower()
    whole = _TOKEN.findall(low)
    plain = list(map(_plains.__getitem__, whole))
    b = _runs(np.fromiter(map(_mask_hashes.__getitem__, whole), dtype=np.uint64, count=len(whole)))
    share = data_share(body)
    script = share < DATA_SHARE
    minified = False
    if script:
        no_strings = _STRING.sub("''", body).strip()
        signs = sum(map(no_strings.count, ",;=<>"))
        long = len(no_strings) >= DENSE_LINE * (no_strings.count("\n") + 1)
        minified = long and signs >= DENSE_SIGNS and len(_TIGHT.findall(no_strings)) >= DENSE_SHARE * signs
    own = False
    if places := [p for p in (repo or "").lower().split("/") if p and p in low]:
        names = Counter(map(_firsts.__getitem__, plain))
        names.pop("", None)
        most = max(names.values(), default=0)
        own = most >= 3 and any(names.get(p) == most for p in places)
    said, edge = remarks(content, comments)
    regular = script and len(whole) >= FAMILY_TOKENS and len(b) <= FAMILY_RATIO * len(whole)
    grams = shingles(whole) if script else None
    return {
        "generated": any(map(_GENERATED.search, lines)),
        "copied": any(map(_COPIED.search, lines)),
        "minified": minified,
        "data_share": round(share, 6),
        "own": own,
        "script": script,
        "regular": regular,
        "edge": edge,
        "talk": xxhash.xxh64_intdigest(repr((said, edge))) - (1 << 63) if said else None,
        "body": xxhash.xxh64_intdigest("\x1f".join(plain)) - (1 << 63),
        "whole": xxhash.xxh64_intdigest("\x1f".join(whole)) - (1 << 63),
        "shape": xxhash.xxh64_intdigest(b.tobytes()) - (1 << 63) if regular else None,
        "said": said,
        "grams": None if grams is None else grams.astype(np.uint32).view(np.int32),
        "plain": signature(grams) if script else None,
        "kinds": b.astype(np.uint32).view(np.int32),
        "masked": signature(b) if regular else None,
    }


_FLAGS = ("generated", "copied", "minified", "data_share", "own", "script", "regular", "edge", "talk", "body", "whole")
_ARRAYS = {"said": pa.int64(), "grams": pa.int32(), "kinds": pa.int32(), "bands": pa.int64(), "sketch": pa.int64(), "masked_bands": pa.int64(), "masked_sketch": pa.int64()}
_SCHEMA = (
    "generated boolean, copied boolean, minified boolean, data_share double, own boolean, script boolean, "
    "regular boolean, edge boolean, talk long, body long, whole long, shape long, said array<long>, grams array<int>, "
    "kinds array<int>, bands array<long>, sketch array<long>, masked_bands array<long>, masked_sketch array<long>"
)
_KINDS = {"data_share": pa.float64()} | dict.fromkeys(("talk", "body", "whole", "shape"), pa.int64())


def _of_batch(signatures: list[np.ndarray | None]) -> list[tuple]:
    """``_banded`` of those that are not null."""
    full = [x for x in signatures if x is not None]
    found = iter(zip(*_banded(np.stack(full)))) if full else iter(())
    return [(None, None) if x is None else next(found) for x in signatures]


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of each batch but ``content``, and what ``describe`` says of the files. Sets stay arrays of numbers."""
    for b in batches:
        rows = [describe(c or "", r) for c, r in zip(b.column("content").to_pylist(), b.column("repo").to_pylist())]
        out = {n: b.column(n) for n in b.schema.names if n != "content"}
        for r, *pairs in zip(rows, *(_of_batch([r[n] for r in rows]) for n in ("plain", "masked"))):
            (r["bands"], r["sketch"]), (r["masked_bands"], r["masked_sketch"]) = pairs
        for n in (*_FLAGS, "shape"):
            out[n] = pa.array([r[n] for r in rows], _KINDS.get(n, pa.bool_()))
        for n, kind in _ARRAYS.items():
            each = [r[n] for r in rows]
            ends = np.cumsum([0, *(0 if x is None else len(x) for x in each)], dtype=np.int32)
            full = [x for x in each if x is not None and len(x)]
            values = pa.array(np.concatenate(full), kind) if full else pa.array([], kind)
            out[n] = pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array([x is None for x in each]))
        yield pa.RecordBatch.from_pydict(out)


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _once(raw: DataFrame, by: str, *columns: str) -> DataFrame:
    """``by, *columns`` of one row for each value of ``by``. The columns are not shuffled; rows that are left out are few."""
    firsts = raw.where(F.col(by).isNotNull()).groupBy(by).agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = cut(raw.select(by, "row").join(firsts, by).where("row > first").select("row"))
    return raw.where(F.col(by).isNotNull()).join(_small(again), "row", "left_anti").select(by, *columns)


def _own_families(one: DataFrame, raw: DataFrame, components: DataFrame) -> DataFrame:
    """``body`` of the families of ``FAMILY_FILES`` files whose masked shingles hardly occur outside of all such groups,
    and of the scripts, long or short, that consist of the shingles of such families.

    Variants of one tool's output support each other, as a shingle is weighed against the files that are in no group.
    Shingles are counted once for each distinct token sequence, over the whole corpus. There are few masked shingles,
    so nearly all of the counting is done before the shuffle.
    """
    sizes = one.join(components, "body").groupBy("component").agg(F.count("*").alias("files")).where(F.col("files") >= FAMILY_FILES)
    groups = cut(components.join(sizes.select("component"), "component", "left_semi"))
    bodies = _once(raw, "body", "script", "kinds")
    kinds = bodies.join(_small(groups), "body", "left").select("component", F.explode("kinds").alias("kind"))
    everywhere = cut(kinds.groupBy("kind").agg(F.count("*").alias("n_all"), F.count("component").alias("n_groups")))
    inside = bodies.join(_small(groups), "body").select("component", F.explode("kinds").alias("kind")).groupBy("component", "kind").agg(F.count("*").alias("n"))
    inside = cut(inside)
    own = F.sum(F.when(2 * F.col("n_groups") >= F.col("n_all"), F.col("n")).otherwise(0)) / F.sum("n")
    good = cut(inside.join(everywhere, "kind").groupBy("component").agg(own.alias("own")).where(F.col("own") >= FAMILY_OWN).select("component"))
    tool = inside.join(good, "component", "left_semi").groupBy("kind").agg(F.sum("n").alias("n_tool"))
    theirs = cut(everywhere.join(tool, "kind").where(2 * F.col("n_tool") >= F.col("n_all")).select("kind"))
    scored = bodies.where("script").select("body", F.size("kinds").alias("n"), F.explode("kinds").alias("kind")).join(_small(theirs), "kind")
    scored = scored.groupBy("body", "n").agg(F.count("*").alias("theirs"))
    like = scored.where((F.col("theirs") >= FAMILY_LIKE * F.col("n")) & (F.col("theirs") >= FAMILY_KINDS)).select("body")
    return groups.join(good, "component", "left_semi").select("body").union(like).distinct()


def _copies(one: DataFrame, raw: DataFrame) -> DataFrame:
    """``whole, copy_of``: scripts that are alike, literals and names included, in two repositories or more, and not by
    chance.

    All distinct token sequences are compared, however short. What many people write alike is told by its shingles: they
    stand in other scripts too. Only shingles that two files or more of such a group share are counted over the corpus.
    """
    scripts = raw.where("script")
    found = clusters(scripts.select(F.col("whole").alias("k"), "bands", "sketch", "grams"), SKETCH_FAR, SIMILAR)
    found = found.select(F.col("k").alias("whole"), F.col("component").alias("copy_of"))
    files = cut(one.where("script").groupBy("whole").agg(F.count("*").alias("files"), F.min(F.coalesce("repo", F.lit(""))).alias("x"), F.max(F.coalesce("repo", F.lit(""))).alias("y")))
    placed = files.join(_small(found), "whole", "left").withColumn("copy_of", F.coalesce("copy_of", "whole"))
    wide = placed.groupBy("copy_of").agg(F.min("x").alias("x"), F.max("y").alias("y")).where("x < y").select("copy_of")
    placed = cut(placed.join(wide, "copy_of", "left_semi").select("whole", "copy_of", "files"))
    sets = _once(scripts, "whole", "grams")
    inside = sets.join(_small(placed), "whole").select("copy_of", "files", F.explode("grams").alias("gram"))
    inside = cut(inside.groupBy("copy_of", "gram").agg(F.sum("files").alias("n")).where("n >= 2"))
    # A sequence counts for as many files as have it at their latest delivery, mostly one; the others are looked up.
    odd = raw.where("script").select("whole").distinct().join(files, "whole", "left").select("whole", F.coalesce("files", F.lit(0)).alias("files")).where("files <> 1")
    counted = sets.join(_small(cut(odd)), "whole", "left").select(F.coalesce("files", F.lit(1)).alias("files"), F.explode("grams").alias("gram"))
    everywhere = counted.join(_small(cut(inside.select("gram").distinct())), "gram", "left_semi").groupBy("gram").agg(F.sum("files").alias("n_all"))
    rare = inside.join(everywhere, "gram").where(COPY_OUTSIDE * (F.col("n_all") - F.col("n")) <= F.col("n"))
    sure = rare.groupBy("copy_of").agg(F.count("*").alias("rare")).where(F.col("rare") >= COPY_RARE)
    return placed.join(sure.select("copy_of"), "copy_of", "left_semi").select("whole", "copy_of")


def _banners(told: DataFrame, raw: DataFrame) -> DataFrame:
    """``talk, seed, sure, known``: how probable a tool wrote the comments ``talk``, and how many of their words and pairs
    are known, that is, stand in ``REMARK_FILES`` files or more.

    ``told`` has ``talk, edge, seed``, a row a file; ``seed`` marks files of verified families. What people write stands
    between statements too, or beside what does; a tool's banner stands alone at an edge of the file. Files are a mixture
    of two kinds, told by their words and their comments' place; weights and word counts are estimated in turn over all
    files, beginning with the places and the seeds. Files of one ``talk`` are one row, so little is shuffled.
    """
    nodes = told.groupBy("talk", "edge", "seed").agg(F.count("*").alias("n")).withColumn("node", F.xxhash64("talk", "seed"))
    begin = F.when(F.col("seed"), 1.0).when(F.col("edge"), REMARK_EDGE).otherwise(REMARK_INSIDE)
    nodes = cut(nodes.select("node", "talk", "edge", "seed", "n", begin.alias("w"), F.lit(0).cast("long").alias("known")))
    said = cut(nodes.select("node", "talk", "n").join(_once(raw, "talk", "said"), "talk").select("node", "n", "said"))
    often = said.select("n", F.explode("said").alias("gram")).groupBy("gram").agg(F.sum("n").alias("files")).where(F.col("files") >= REMARK_FILES)
    known = said.select("node", F.explode("said").alias("gram")).join(_small(cut(often.select("gram"))), "gram")
    known = cut(known.groupBy("node").agg(F.collect_list("gram").alias("grams")))
    free = ~F.col("seed")
    share = lambda c: F.coalesce(F.sum(F.when(c, F.col("n") * F.col("w"))) / F.sum(F.when(c, F.col("n"))), F.lit(0.5))
    logit = lambda p: F.log(p / (1 - p))
    for _ in range(REMARK_ROUNDS):
        t = nodes.agg(
            F.coalesce(F.sum(F.col("n") * F.col("w")), F.lit(0.0)).alias("yes"), F.coalesce(F.sum("n"), F.lit(0)).alias("all"),
            share(free & F.col("edge")).alias("edge"), share(free & ~F.col("edge")).alias("inside"),
        ).first()
        of_all = known.join(nodes.select("node", "n", "w"), "node").select("n", "w", F.explode("grams").alias("gram")).groupBy("gram").agg(F.sum(F.col("n") * F.col("w")).alias("y"), F.sum(F.col("n") * (1 - F.col("w"))).alias("x"))
        odds = F.log((F.col("y") + 0.1) / (t["yes"] + 0.2)) - F.log((F.col("x") + 0.1) / (t["all"] - t["yes"] + 0.2))
        heard = known.select("node", F.explode("grams").alias("gram")).join(_small(cut(of_all.select("gram", odds.alias("odds")))), "gram")
        heard = heard.groupBy("node").agg((F.sum("odds") / F.sqrt(F.count("*"))).alias("odds"), F.count("*").alias("known"))
        place = logit(F.least(F.lit(0.999), F.greatest(F.lit(0.001), F.when(F.col("edge"), t["edge"]).otherwise(t["inside"]))))
        w = 1 / (1 + F.exp(-(place + F.coalesce("odds", F.lit(0.0)))))
        nodes = cut(
            nodes.drop("known").join(heard, "node", "left").select(
                "node", "talk", "edge", "seed", "n", F.when(F.col("seed"), 1.0).otherwise(w).alias("w"), F.coalesce("known", F.lit(0).cast("long")).alias("known")
            )
        )
    return nodes.select("talk", "seed", F.col("w").alias("sure"), "known")


def file_evidence(files: DataFrame) -> DataFrame:
    """Per ``file_id``, at its latest delivery, the evidence against hand-written source.

    ``family`` the file repeats itself and, identifiers masked, is like ``FAMILY_FILES`` files or more that share little
    with hand-written ones, or consists of the shingles of such files; ``generated`` its comments are a tool's banner by the
    counts of the whole corpus; ``minified``; ``data`` mostly rows of data; ``vendored`` a copy that stands in several
    repositories, unless most of its names are its own repository's. Only where those leave it open, the file's own
    words decide: that it is generated, or, without a copy elsewhere, that it is copied.
    ``files`` has ``file_id, content, max_stars_repo_name, loaded_at``. A null, empty or blank content has no evidence;
    a null repository is no repository of its own.
    """

    spark = files.sparkSession
    kind, stamp = (files.schema[c].dataType.simpleString() for c in ("file_id", "loaded_at"))
    each = files.select("file_id", "loaded_at", F.col("max_stars_repo_name").alias("repo"), "content")
    each = each.mapInArrow(_described, f"file_id {kind}, loaded_at {stamp}, repo string, {_SCHEMA}")
    # As columns, so that each of the passes below reads only what it needs.
    path = scratch(spark)
    try:
        each.withColumn("row", F.monotonically_increasing_id()).write.parquet(path)
        return _evidence(spark.read.parquet(path))
    finally:
        dropped(spark, path)


def _evidence(raw: DataFrame) -> DataFrame:
    """``file_evidence`` from the files as ``describe`` tells them; the result does not need ``raw`` any more."""
    one = cut(latest(raw.select("file_id", "loaded_at", "repo", *_FLAGS), "file_id", ["repo", *_FLAGS]))

    # Regular files of one set of masked shingles are one node; a tool's files are often equal once names are masked.
    shaped = cut(raw.where("regular").select("body", "shape", "masked_bands", "masked_sketch", "kinds"))
    grouped = clusters(shaped.select(F.col("shape").alias("k"), F.col("masked_bands").alias("bands"), F.col("masked_sketch").alias("sketch"), F.col("kinds").alias("grams")), SKETCH_FAR, SIMILAR)
    regular = shaped.select("body", "shape").distinct().join(_small(grouped), F.col("shape") == F.col("k"), "left")
    regular = regular.select("body", F.coalesce("component", "shape").alias("component"))

    copies = _copies(one, raw)
    families = cut(_own_families(one, raw, regular).withColumn("family", F.lit(True)))
    all_ = one.join(copies, "whole", "left").join(families, "body", "left").withColumn("seed", F.coalesce("family", F.lit(False)))
    all_ = cut(all_.select("file_id", *_FLAGS, "seed", "copy_of"))
    open_ = F.col("copy_of").isNull() & ~F.col("minified") & (F.col("data_share") < DATA_SHARE)
    banners = _banners(all_.where(F.col("talk").isNotNull() & open_).select("talk", "edge", "seed"), raw)
    undecided = (F.coalesce("known", F.lit(0)) == 0) | F.col("sure").between(1 - REMARK_SURE, REMARK_SURE)
    learnt = ~F.col("seed") & ~undecided & (F.col("sure") > 0.5)
    return all_.join(_small(banners), ["talk", "seed"], "left").select(
        "file_id",
        (open_ & (learnt | undecided & ~F.col("seed") & F.col("generated"))).alias("generated"),
        F.col("seed").alias("family"),
        "minified",
        (F.col("data_share") >= DATA_SHARE).alias("data"),
        (F.col("copy_of").isNotNull() & ~F.col("own") | F.col("copy_of").isNull() & F.col("copied")).alias("vendored"),
    )


def machine_made(files: DataFrame) -> DataFrame:
    """``file_id`` of the files with any evidence."""
    return file_evidence(files).where("generated OR family OR minified OR data OR vendored").select("file_id")
