"""Problem 9: passages that insult, threaten, degrade, hate or are sexually explicit."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Labelled documents the model is fitted on, at most, and characters they have; chosen whole by a hash of the id.
MOST_LABELLED, MOST_CHARS = 50_000, 500_000_000
#: Weight of the corpus-wide prior in pseudo-documents, and what a word unknown to the labels costs in a segment.
PRIOR, DRIFT = 20.0, -0.8
CAP = 6.0
#: A passage holds a word of this weight: one that hardly occurs in harmless text.
SPECIFIC = 4.5
GAP = 1.5
#: Features seen in fewer labelled documents are left to the prior.
LEAST_DOCS = 2
#: A feature is a subject if so few unsafe labels among its flagged documents have less than this chance.
UNCONFIRMED = 0.01

# Look-alikes of Latin letters, and signs written for letters.
LOOK_ALIKE = str.maketrans("аеорсухіјѕԁһαεορνικτ", "aeopcyxijsdhaeopvikt")
SIGNS = str.maketrans("@$0134578!|€", "asoieastbile")

_INVISIBLE = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff]")
#: Letters spelt out, with one separator throughout; the last part may be the rest of the word unless blanks separate.
_SPELT = re.compile(r"(?<![^\W_])[^\W\d_]([-._·*~])(?:[^\W\d_]\1)+[^\W\d_]+|(?<![^\W_])[^\W\d_](?: [^\W\d_]){2,}(?![^\W_])")
_PIECES = re.compile(r"[^\W_](?:[\w@$!|€*'’]*[\w$@*])?|[@$][\w@$!|*]*\w", re.U)
_RUNS = re.compile(r"([^\W\d_])\1{2,}")
_FILLER = re.compile(r"(?<!\w)([^\W\d_])\1{6,}(?!\w)")


def words(text: str) -> list[str]:
    """Words in one spelling: composed, lower case, without invisible characters, look-alikes, signs and long runs.

    A word with letters left out keeps its asterisks.
    """
    t = text.casefold() if text.isascii() else _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)).casefold()
    if _RUNS.search(t):
        t = _RUNS.sub(r"\1", _FILLER.sub(" ", t))
    t = _SPELT.sub(lambda m: re.sub(r"[-._·*~ ]", "", m.group()), t)
    return [w for w in map(_spellings.__getitem__, _PIECES.findall(t)) if w]


def _spelling(w: str) -> str:
    """One word in its plain spelling; empty for what has no letters."""
    if w.isascii():
        if w.isalpha():
            return w
        if w.replace("_", "").isalpha():
            return w.strip("_")
    else:
        swapped = w.translate(LOOK_ALIKE)
        w = swapped if swapped.isascii() else unicodedata.normalize("NFC", w)
    if not w.isalpha():
        letters = sum(map(str.isalpha, w))
        if letters == 0:
            return ""  # numbers are neutral
        if "*" not in w and letters * 2 >= len(w):
            w = w.translate(SIGNS)
        w = w.strip("'’!|_")
    return _RUNS.sub(r"\1", w)


class Memory(dict):
    """Results of a function of one word, as many as fit."""

    def __init__(self, of: Callable[[str], str], most: int = 200_000):
        self.of, self.most = of, most

    def __missing__(self, word: str) -> str:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.of(word)
        return value


_spellings = Memory(_spelling)


def features(tokens: list[str]) -> list[tuple[str, str]]:
    """The word and the pair with the word before it, of each token."""
    return [(w, f"{p} {w}") for p, w in zip(["", *tokens], tokens)]


def log_odds(unsafe: dict[str, float], safe: dict[str, float], n_unsafe: float, n_safe: float, prior: dict[str, float]) -> dict[str, float]:
    """Log-odds of each feature with an informative Dirichlet prior; what speaks for unsafe is lowered by half its spread.

    ``prior`` is the share of all corpus documents that have the feature.
    """
    out = {}
    for f in unsafe.keys() | safe.keys():
        a = PRIOR * prior.get(f, 0.0) + 0.05
        y, n = unsafe.get(f, 0.0) + a, safe.get(f, 0.0) + a
        odds = math.log(y / max(1e-9, n_unsafe + PRIOR - y)) - math.log(n / max(1e-9, n_safe + PRIOR - n))
        if odds > 0:
            odds = max(0.0, odds - 0.5 * math.sqrt(1 / y + 1 / n))
        out[f] = max(-CAP, min(CAP, odds))
    return out


def _pair(feature: str) -> tuple[str, str]:
    before, _, after = feature.rpartition(" ")
    return before, after


class Model:
    """Feature weights, with the words behind masked and stretched spellings, and the calibration of scores."""

    def __init__(self, weights: dict[str, float], scale: float = 1.0, size: float = 1.0, threshold: float = 0.01, specific: float = 0.0):
        self.weights = weights
        self.specific = specific
        self.scale, self.size, self.threshold = scale, size, threshold
        self.masked: dict[tuple[str, int], list[str]] = {}
        self.squeezed: dict[str, str] = {}
        for f, w in sorted(weights.items(), key=lambda x: (-x[1], x[0])):
            if " " not in f and w > 1:
                self.masked.setdefault((f[:1], len(f)), []).append(f)
                self.squeezed.setdefault(re.sub(r"(.)\1+", r"\1", f), f)

        self.pairs = {_pair(f): w for f, w in weights.items() if " " in f}
        self.known = Memory(self._resolved)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "known"}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.known = Memory(self._resolved)

    def _resolved(self, w: str) -> str:
        if "*" in w:
            pattern = re.compile("".join("." if c == "*" else re.escape(c) for c in w))
            return next((f for f in self.masked.get((w[0], len(w)), ()) if pattern.fullmatch(f)), w)
        return w if w in self.weights else self.squeezed.get(re.sub(r"(.)\1+", r"\1", w), w)

    def resolve(self, tokens: list[str]) -> list[str]:
        """Puts the heaviest known word in place of one that is masked by asterisks or that was stretched."""
        return list(map(self.known.__getitem__, tokens))

    def passages(self, tokens: list[str]) -> list[tuple[float, int, int]]:
        """Maximal segments ``(score, begin, end)`` of resolved words that hold a specific word.

        A word scores its own weight and half the weight of either pair it belongs to, less the drift.
        """
        own = list(map(self.weights.get, tokens, repeat(0.0)))
        if self.specific > 0 and max(own, default=0.0) < self.specific:
            return []
        pairs = [*map(self.pairs.get, zip(["", *tokens], tokens), repeat(0.0)), 0.0]
        segments = maximal_segments([w + 0.5 * (pairs[i] + pairs[i + 1]) + DRIFT for i, w in enumerate(own)])
        if self.specific <= 0:
            return segments
        return [(s, i, j) for s, i, j in segments if max(own[i:j]) >= self.specific]

    def best(self, text: str) -> tuple[float, int]:
        """Score of the best passage and the number of words."""
        tokens = self.resolve(words(text))
        return max((s for s, _, _ in self.passages(tokens)), default=0.0), len(tokens)

    def p_value(self, score: float, n: int) -> float:
        """Chance that ``n`` harmless words hold a segment of this score (extreme-value distribution)."""
        return -math.expm1(-self.size * max(1, n) * math.exp(-self.scale * score))


def maximal_segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """All disjoint maximal-scoring segments ``(score, begin, end)`` in linear time."""
    found: list[list[float]] = []  # begin, end, sum before, sum through
    total = 0.0
    for i, x in enumerate(scores):
        before, total = total, total + x
        if x <= 0:
            continue
        now = [i, i + 1, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= now[2]:
                j -= 1
            if j < 0 or found[j][3] >= now[3]:
                found.append(now)
                break
            now = [found[j][0], now[1], found[j][2], now[3]]
            del found[j:]
    return [(r - s, int(b), int(e)) for b, e, s, r in found]


def calibrate(model: Model, safe: list[tuple[float, int]], unsafe: list[tuple[float, int]]) -> Model:
    """Fits the extreme-value distribution to the best segments of harmless documents, then the threshold.

    Raters err, so the highest twentieth of the harmless scores is left out of the fit. The threshold tells most
    labelled documents apart, both classes weighing the same; of those within two documents of the best it is the loosest
    one with a gap of ``GAP`` in the scores around it.
    """
    s = np.array([x - 0.0 for x, _ in safe] or [0.0])
    logs = np.array([math.log(max(1, n)) for _, n in safe] or [0.0])
    keep = s <= np.quantile(s, 0.95)
    spread = max(float(s[keep].std()), 1.0)
    scale = math.pi / (spread * math.sqrt(6))
    size = math.exp(float((scale * s[keep] - logs[keep]).mean()) - 0.5772156649)
    out = Model(model.weights, scale, size, specific=model.specific)
    labelled = [(out.p_value(x, n), 0) for x, n in safe] + [(out.p_value(x, n), 1) for x, n in unsafe]
    labelled.sort()
    cuts, hit, false = [], 0, 0  # gain, width of the gap, threshold within it
    for (p, y), (after, _) in zip(labelled, labelled[1:] + [(1.0, 0)]):
        hit, false = hit + y, false + 1 - y
        if after > p:
            low, high = math.log(max(p, 1e-300)), math.log(max(after, 1e-300))
            cuts.append((hit / max(1, len(unsafe)) - false / max(1, len(safe)), high - low, math.exp((low + high) / 2)))
    best = max((g for g, _, _ in cuts), default=0.0)
    good = [(w / scale, t) for g, w, t in cuts if g >= best - 2.0 / max(1, len(unsafe))]
    clear = [t for w, t in good if w >= GAP]
    threshold = max(clear) if clear else max(good, default=(0.0, 1e-6))[1]
    out.threshold = min(threshold, 0.5)
    return out


def fit(labelled: list[tuple[str, int]], counts: dict[str, int], n_docs: int, rounds: int = 2) -> Model:
    """Weights from labelled texts ``(text, 1 if unsafe)`` and the number of corpus documents that have each feature.

    The corpus is nearly all harmless, so its counts join those of the safe documents, and give the prior.

    First, features of unsafe documents are set against those of safe ones. Then only the words inside the segments
    found so far count as unsafe, and the rest of those documents as safe, since a passage is a small part of its text.
    """
    tokens = [(words(t), y) for t, y in labelled]
    y_n = sum(y for _, y in tokens)
    n_n = len(tokens) - y_n + n_docs
    prior = {f: n / max(1, n_docs) for f, n in counts.items()}
    model = Model({})
    for k in range(rounds + 1):
        yes, no = Counter(), Counter()
        for w, y in tokens:
            w = model.resolve(w)
            pairs = features(w)
            if y and k:
                inside: set[str] = set()
                marks = set()
                for s, i, j in model.passages(w):
                    if s >= 3:
                        marks.update(range(i, j))
                inside.update(f for i in marks for f in pairs[i])
                yes.update(inside)
                no.update({f for i, p in enumerate(pairs) if i not in marks for f in p} - inside)
            else:
                (yes if y else no).update({f for p in pairs for f in p})
        keep = {f for f, n in (yes + no).items() if n >= LEAST_DOCS}
        safe = {f: no[f] + counts.get(f, 0) for f in keep}
        model = Model(log_odds({f: yes[f] for f in keep}, safe, y_n, n_n + (y_n if k else 0), prior))
    best = [(model.best(t), y) for t, y in labelled]
    return calibrate(model, [b for b, y in best if not y], [b for b, y in best if y])


def at_most(k: int, n: int, p: float) -> float:
    """Chance of at most ``k`` successes in ``n`` trials."""
    if k >= n * p:
        return 1.0
    top = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total, term = 0.0, 1.0
    for i in range(k, -1, -1):
        total += term
        term *= i / (n - i + 1) * (1 - p) / p
    return math.exp(top) * total


def refit(model: Model, counts: dict[str, tuple[int, int]], n_flagged: int, n_rest: int, labelled: list[tuple[str, int]]) -> Model:
    """Weights from the passages that ``model`` finds in the whole corpus against everything else.

    ``counts`` has, of each feature, the documents with it inside of such a passage and outside. Unlike the labelled
    sample alone, this covers all harmless uses, and raters' errors and unlabelled passages no longer count as safe.
    Of the flagged documents, raters saw some share and called them unsafe. A feature whose flagged documents they
    called unsafe significantly less often belongs to a subject, which a few wrong or unlucky labels made suspect: it
    counts as safe wherever it stands.
    Weaker passages of documents that raters called unsafe are moved from the one count to the other.
    """
    yes = Counter({f: y for f, (y, _) in counts.items()})
    no = Counter({f: n for f, (_, n) in counts.items()})
    confirmed, hits = Counter(), 0
    for t, y in labelled:
        tokens = model.resolve(words(t)) if y else []
        pairs = features(tokens)
        inside = {f for s, i, j in model.passages(tokens) if model.p_value(s, len(tokens)) <= model.threshold for p in pairs[i:j] for f in p}
        confirmed.update(inside)
        hits += bool(inside)
    share = hits / max(1, n_flagged)
    for f, n in yes.items():
        if 0 < share < 1 and at_most(confirmed[f], n, share) < UNCONFIRMED:
            no[f] += n
            yes[f] = 0
    for t, y in labelled:
        tokens = model.resolve(words(t)) if y else []
        found = model.passages(tokens)
        if not found or any(model.p_value(s, len(tokens)) <= model.threshold for s, _, _ in found):
            continue
        _, i, j = max(found)
        pairs = features(tokens)
        moved = {f for p in pairs[i:j] for f in p if f in counts}
        yes.update(moved)
        no.subtract(moved)
        n_flagged, n_rest = n_flagged + 1, n_rest - 1
    no = {f: max(0, n) for f, n in no.items()}
    total = max(1, n_flagged + n_rest)
    prior = {f: (yes[f] + no[f]) / total for f in counts}
    new = Model(log_odds(dict(yes), no, n_flagged, n_rest, prior), specific=SPECIFIC)
    best = [(new.best(t), y) for t, y in labelled]
    return calibrate(new, [b for b, y in best if not y], [b for b, y in best if y])


def tally(texts: Iterator[str | None], wanted: frozenset[str], model: Model | None = None) -> tuple[Counter, Counter, int, int]:
    """Documents that have each wanted feature inside and outside of the passages of ``model``, and how many documents
    have such a passage and have none."""
    inside, outside, hit, rest = Counter(), Counter(), 0, 0
    pairs_wanted = {_pair(f) for f in wanted if " " in f}

    def found(tokens: list[str], places: list[int] | None = None) -> set[str]:
        before = ["", *tokens]
        some = tokens if places is None else list(map(tokens.__getitem__, places))
        ahead = before if places is None else map(before.__getitem__, places)
        return (set(some) & wanted) | set(map(" ".join, set(zip(ahead, some)) & pairs_wanted))

    for t in texts:
        tokens = words(t) if t else []
        marks: set[int] = set()
        if model is not None and tokens:
            tokens = model.resolve(tokens)
            for s, i, j in model.passages(tokens):
                if model.p_value(s, len(tokens)) <= model.threshold:
                    marks.update(range(i, j))
        if marks:
            hit += 1
            within = found(tokens, sorted(marks))
            inside.update(within)
            outside.update(found(tokens, [i for i in range(len(tokens)) if i not in marks]) - within)
        else:
            rest += 1
            outside.update(found(tokens))
    return inside, outside, hit, rest


def majority(labels: DataFrame) -> DataFrame:
    """``doc_id, unsafe``: the view of most raters who said safe or unsafe; ties and other verdicts are left out.

    A rater who saw a document twice counts with the latest verdict.
    """
    one = (
        labels.where(F.col("verdict").isin("safe", "unsafe"))
        .groupBy("doc_id", F.coalesce("rater", F.lit("")).alias("rater"))
        .agg(F.max(F.struct("rated_at", "verdict")).alias("v"))
    )
    lean = F.sum(F.when(F.col("v.verdict") == "unsafe", 1).otherwise(-1))
    return one.groupBy("doc_id").agg(lean.alias("lean")).where("lean <> 0").select("doc_id", (F.col("lean") > 0).alias("unsafe"))


def _counted(docs: DataFrame, wanted: frozenset[str], model: Model | None) -> tuple[dict[str, tuple[int, int]], int, int]:
    """``tally`` over all of ``docs``: each task counts its own rows, and only sums are shuffled.

    The result has a row for each wanted feature, and those are bounded by the labelled sample.
    """
    shared = docs.sparkSession.sparkContext.broadcast((wanted, model))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep, m = shared.value
        y, n, hit, rest = tally((t for b in batches for t in b["text"]), keep, m)
        f = list(y.keys() | n.keys())
        yield pd.DataFrame({"f": [*f, ""], "y": [*(y[x] for x in f), hit], "n": [*(n[x] for x in f), rest]})

    got = docs.select("text").mapInPandas(run, "f string, y long, n long").groupBy("f").agg(F.sum("y").alias("y"), F.sum("n").alias("n"))
    counts = {r["f"]: (r["y"], r["n"]) for r in got.collect()}
    hit, rest = counts.pop("", (0, 0))
    return counts, hit, rest


def train(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, most_chars: int = MOST_CHARS) -> Model:
    """Fits a model on at most ``most`` labelled documents with ``most_chars`` characters, then on the passages it finds
    in all documents.

    Without labels of both kinds nothing can be learnt, and the model flags nothing.
    """
    read = docs.where(F.length("text") > 0)
    judged = read.select("doc_id", F.length("text").alias("n")).join(majority(labels), "doc_id")  # without the texts
    order = Window.orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    sized = judged.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(most)
    chosen = sized.withColumn("upto", F.sum("n").over(order)).where(F.col("upto") <= most_chars).select("doc_id", "unsafe").distinct()
    sample = [(r["text"], int(r["unsafe"])) for r in read.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").orderBy("doc_id").collect()]
    if len({y for _, y in sample}) < 2:
        return Model({}, threshold=0.0)
    seen = Counter()
    for t, _ in sample:
        seen.update({f for p in features(words(t)) for f in p})
    wanted = frozenset(f for f, n in seen.items() if n >= LEAST_DOCS)
    counts, _, n_docs = _counted(docs, wanted, None)
    first = fit(sample, {f: n for f, (_, n) in counts.items()}, n_docs)
    wanted |= {f for t, _ in sample for p in features(first.resolve(words(t))) for f in p} & first.weights.keys()
    return refit(first, *_counted(docs, frozenset(wanted), first), sample)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, source, score, p_value, passages, flagged`` of every document.

    ``score`` is that of the best segment, ``p_value`` the chance of such a score among as many harmless words,
    ``passages`` the number of segments that are significant by themselves. Null and empty texts score 0 and are
    never flagged. Repeated rows are scored alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for b in batches:
            rows = []
            for t in b["text"]:
                tokens = m.resolve(words(t)) if t else []
                found = [s for s, _, _ in m.passages(tokens)]
                top = max(found, default=0.0)
                p = m.p_value(top, len(tokens)) if tokens else 1.0
                hits = sum(m.p_value(s, len(tokens)) <= m.threshold for s in found)
                rows.append((round(top, 6), p, hits, bool(tokens) and p <= m.threshold))
            yield pd.DataFrame({"doc_id": b["doc_id"], "source": b["source"]}).assign(
                score=[r[0] for r in rows], p_value=[r[1] for r in rows], passages=[r[2] for r in rows], flagged=[r[3] for r in rows]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "source", "text").mapInPandas(
        run, f"doc_id {kind}, source string, score double, p_value double, passages long, flagged boolean"
    )


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id`` of the documents with a significant passage."""
    return score(docs, train(docs, labels)).where("flagged").select("doc_id")


def source_rates(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per source (null included) documents, flagged documents and their share."""
    s = score(docs, train(docs, labels)).groupBy("source").agg(F.count("*").alias("docs"), F.count_if("flagged").alias("flagged"))
    return s.withColumn("rate", F.round(F.col("flagged") / F.col("docs"), 6))
