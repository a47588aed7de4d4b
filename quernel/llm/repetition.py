"""Problem 1: how much of a document repeats what stood earlier in it."""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.sources.tables import latest

#: A rule that measures a share of repeated characters votes for a case from this share on.
CASE = 1 / 3
#: Runs of so many words count if they stood so many times before. Every longer run consists of such runs.
PHRASES = {4: 1, 3: 2}
#: Words of a window in which distinct words are counted, and the least number of words for that.
WINDOW, FEW_WORDS = 50, 20
#: Letters of a run inside one word that stood earlier in it.
LETTERS = 9
LONGEST_PERIOD = 12
NEAR = 0.85

_WORDS = re.compile(r"(\w+)")
_FIGURES = re.compile(r"\d+")
_SENTENCE = re.compile(r"[^.!?;:…\n]+[.!?;:…\n]*")
_LONG = re.compile(r"\S{12,}")
_RUN = re.compile(r"(\S{1,8}?)\1{5,}")

#: Each rule votes 1 (repetitive), 0 (not) or abstains (2). They look at different things and err on different texts.
RULES = ("ngrams", "lines", "sentences", "periods", "letters", "packed", "variety", "favourite")


def _cover(marks: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """Characters of the marked words, each with what follows it up to the next word."""
    out = np.zeros(n, dtype=bool)
    if len(marks):
        out[starts[0] :] = np.repeat(marks, np.diff(np.append(starts, n)))
    return out


def _again(ids: np.ndarray, size: int, before: int) -> np.ndarray:
    """Places in runs of ``size`` equal ids that occurred ``before`` times before."""
    k = len(ids) - size + 1
    if k <= before:
        return np.zeros(len(ids), dtype=bool)
    gram = np.zeros(k, dtype=np.uint64)
    for j in range(size):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + k] + np.uint64(1)
    order = np.argsort(gram, kind="stable")
    ordered = gram[order]
    # a run has occurred `before` times before if the one so many places ahead in order is the same
    at = order[before:][ordered[before:] == ordered[:-before]]
    if len(at) == 0:
        return np.zeros(len(ids), dtype=bool)
    marks = np.zeros(len(ids) + 1, dtype=np.int64)
    marks[at] += 1
    marks[at + size] -= 1
    return np.cumsum(marks)[:-1] > 0


def _ngrams(ids: np.ndarray) -> np.ndarray:
    """Words in runs, numbers being equal to each other, that occurred before, or in shorter ones that occurred again and
    again."""
    marks = np.zeros(len(ids), dtype=bool)
    for size, before in PHRASES.items():
        marks |= _again(ids, size, before)
    return marks


def _periods(ids: np.ndarray) -> np.ndarray:
    """Words in three or more rounds of a few words; the first round is not marked."""
    marks = np.zeros(len(ids), dtype=bool)
    for p in range(1, min(LONGEST_PERIOD, len(ids) - 1) + 1):
        equal = ids[p:] == ids[:-p]
        if np.count_nonzero(equal) < 2 * p:
            continue
        same = np.concatenate([[False], equal, [False]])
        edge = np.flatnonzero(same[1:] != same[:-1])
        for i, j in zip(edge[::2], edge[1::2]):
            if j - i >= 2 * p:
                marks[i + p : j + p] = True
    return marks


def _units(bounds: Iterator[tuple[int, int]], text: str, ids: list[int], starts: list[int], least: int, near: bool) -> tuple[np.ndarray, int]:
    """Lines or sentences whose words, numbers aside, occurred before; with ``near`` also those of which most words agree
    with an earlier one. Gives the marked characters and the number of units."""
    mask = np.zeros(len(text), dtype=bool)
    seen: set = set()
    by_gram: dict[tuple, list[tuple[int, Counter]]] = {}
    count = at = 0
    for begin, end in bounds:
        first, at = at, bisect_left(starts, end, at)
        words = tuple(filter(None, ids[first:at]))  # 0 stands for numbers
        key = words or text[begin:end].strip()
        if not key:
            continue
        count += 1
        n = len(words)
        if n < least or end - begin < 4:
            continue
        if key in seen:
            mask[begin:end] = True
            continue
        seen.add(key)
        if near and n >= 5:
            grams = set(zip(words, words[1:], words[2:]))
            others = {id(o): (m, o) for g in grams & by_gram.keys() for m, o in by_gram[g] if 2 * min(m, n) >= NEAR * (m + n)}
            bag = Counter(words)
            if others and any(2 * (bag & o).total() >= NEAR * (n + m) for m, o in others.values()):
                mask[begin:end] = True
            for g in grams:
                by_gram.setdefault(g, []).append((n, bag))
    return mask, count


def _line_bounds(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for line in text.split("\n"):
        yield at, min(at + len(line) + 1, len(text))
        at += len(line) + 1


def _variety(ids: np.ndarray) -> float:
    """Distinct words a word in windows of WINDOW words, on average; 1 for few words."""
    if len(ids) < FEW_WORDS:
        return 1.0
    size = min(WINDOW, len(ids))
    whole = np.sort(ids[: len(ids) // size * size].reshape(-1, size), axis=1)
    return float(1 + np.count_nonzero(whole[:, 1:] != whole[:, :-1], axis=1).mean()) / size


def _favourite(ids: np.ndarray) -> float:
    """Share of the words that stand in the most frequent pair of words."""
    if len(ids) < FEW_WORDS:
        return 0.0
    _, often = np.unique(ids[:-1] * np.uint64(0x9E3779B97F4A7C15) + ids[1:], return_counts=True)
    return min(1.0, 2 * float(often.max()) / len(ids))


def _repeats(word: str, size: int) -> bool:
    k = len(word) - size + 1
    return len({word[i : i + size] for i in range(k)}) < k


def _said_again(ids: list[int]) -> bool:
    """Whether a word stands twice in a row or three words in sequence occur twice, numbers counted or left out. Without
    that no run, period or sentence can repeat."""
    if any(map(eq, ids, ids[1:])):
        return True
    for some in (ids, list(filter(None, ids))) if 0 in ids else (ids,):
        if len(set(zip(some, some[1:], some[2:]))) < len(some) - 2:
            return True
    return False


_MASKS = ("ngrams", "lines", "sentences", "periods", "letters")


def repetition(text: str) -> dict[str, float]:
    """Shares of the characters that repeat earlier ones, by kind and over all kinds, and what else the rules look at, in
    time linear in the text."""
    n = len(text)
    if not text.strip():
        return dict.fromkeys((*_MASKS, "all", "favourite", "unbroken"), 0.0) | {"n_lines": 0, "packed": 1.0, "variety": 1.0}
    low = text.lower()
    if len(low) != n:  # a few letters grow when lowered
        low = text
    parts = _WORDS.split(low)  # what is between words, and words, in turn
    words = parts[1::2]
    number, known = {"0": 0}, {}
    for w in dict.fromkeys(words):
        known[w] = number.setdefault(w if w.isalpha() else _FIGURES.sub("0", w), len(number))
    listed = list(map(known.__getitem__, words))
    starts = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)))[:-1:2]
    begins, ids = starts.tolist(), np.array(listed, dtype=np.uint64)
    none = np.zeros(n, dtype=bool)
    masks = dict.fromkeys(_MASKS, none)
    again = _said_again(listed)
    if again:
        masks |= {"ngrams": _cover(_ngrams(ids), starts, n), "periods": _cover(_periods(ids), starts, n)}
        masks["sentences"], _ = _units((m.span() for m in _SENTENCE.finditer(text)), text, listed, begins, 4, True)
    unbroken = 0
    for word in _LONG.finditer(text):
        unbroken += word.end() - word.start() - 11
        if not _repeats(word.group(), 3):
            continue
        if masks["letters"] is none:
            masks["letters"] = none.copy()
        mine = masks["letters"][word.start() : word.end()]
        for m in _RUN.finditer(word.group()):
            if m.end() - m.start() >= 12:  # six or more rounds of a few letters
                mine[m.start() + len(m.group(1)) : m.end()] = True
        if _repeats(word.group(), LETTERS):
            mine |= _again(np.frombuffer(word.group().encode("utf-32-le"), dtype=np.uint32).astype(np.uint64), LETTERS, 1)
    masks["lines"], lines = _units(_line_bounds(text), text, listed, begins, 0, False)
    union = np.logical_or.reduce(list(masks.values()))
    data = text.encode("utf-8", "replace")
    return {k: float(np.count_nonzero(m)) / n for k, m in masks.items()} | {
        "all": float(np.count_nonzero(union)) / n, "n_lines": lines, "packed": len(zlib.compress(data, 1)) / len(data),
        "variety": _variety(ids), "favourite": _favourite(ids), "unbroken": unbroken / n,
    }


def votes(r: dict[str, float], n: int) -> list[int]:
    """One vote a rule, in the order of RULES. No rule sees the share over all kinds. Rules that look at words cannot
    clear a text of which much is unbroken."""
    worded = r["unbroken"] < CASE

    def by(value, low, high, sees=True):
        return 1 if value >= high else 0 if value <= low and sees else 2

    return [
        by(r["ngrams"], 0.15, CASE, worded),
        by(r["lines"], 0.1, CASE, worded) if r["n_lines"] > 1 else 2,
        by(r["sentences"], 0.15, CASE, worded),
        1 if r["periods"] >= CASE else 2,
        1 if r["letters"] >= CASE else 2,
        by(-r["packed"], -0.5, -0.4) if n >= 300 else 2,
        by(-r["variety"], -0.6, -0.4, worded) if n >= 100 else 2,
        by(r["favourite"], 0.1, 0.2, worded) if n >= 100 else 2,
    ]


def measure(records: DataFrame) -> DataFrame:
    """``tbl, rec_id, share, pattern``: repeated share and rule votes of each record's latest delivery.

    ``records`` has ``tbl, rec_id, loaded_at, text``. A null, empty or blank text has share 0. Texts are read where
    they lie; only the figures are shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            shares, patterns = [], []
            for t in b["text"]:
                r = repetition(t or "")
                shares.append(round(r["all"], 6))
                patterns.append("".join(map(str, votes(r, len(t or "")))))
            yield pd.DataFrame({"k": b["k"], "share": shares, "pattern": patterns})

    kind = records.schema["rec_id"].dataType.simpleString()
    stamp = records.schema["loaded_at"].dataType.simpleString()
    found = records.select(F.struct("tbl", "rec_id", "loaded_at").alias("k"), "text").mapInPandas(
        run, f"k struct<tbl string, rec_id {kind}, loaded_at {stamp}>, share double, pattern string"
    )
    flat = found.select(F.struct("k.tbl", "k.rec_id").alias("k"), F.col("k.loaded_at").alias("loaded_at"), "share", "pattern")
    return latest(flat, "k", ["share", "pattern"]).select("k.tbl", "k.rec_id", "share", "pattern")


def expectation_maximisation(patterns: dict[str, int], rounds: int = 200) -> dict[str, float]:
    """Posterior probability of "repetitive" for each pattern of votes.

    A latent class emits each rule's vote (1, 0 or abstention) independently; the votes' probabilities and the class
    share are estimated from the counts of patterns alone, beginning with the plain majority. Nothing is labelled.
    The input is bounded by the number of patterns, 3 to the power of the number of rules.
    """
    if not patterns:
        return {}
    names = sorted(patterns)
    votes_ = np.array([[int(c) for c in p] for p in names])
    weight = np.array([patterns[p] for p in names], dtype=float)
    post = np.where((votes_ == 1).sum(1) > (votes_ == 0).sum(1), 0.95, 0.05)
    one_hot = np.stack([votes_ == v for v in range(3)], axis=2).astype(float)  # pattern, rule, vote
    for _ in range(rounds):
        prior = np.clip((weight * post).sum() / weight.sum(), 1e-6, 1 - 1e-6)
        log = []
        for p in (post, 1 - post):
            emit = (one_hot * (weight * p)[:, None, None]).sum(0) + 0.5
            emit /= emit.sum(1, keepdims=True)
            log.append((one_hot * np.log(emit)[None]).sum((1, 2)))
        odds = np.log(prior / (1 - prior)) + log[0] - log[1]
        new = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return dict(zip(names, post.tolist()))


def repetitive_records(records: DataFrame) -> DataFrame:
    """``tbl, rec_id, share, probability``: the share of repeated text and the posterior that the record is a case."""
    from quernel.session import cut

    m = cut(measure(records))
    counts = {r["pattern"]: r["n"] for r in m.groupBy("pattern").agg(F.count("*").alias("n")).collect()}
    post = expectation_maximisation(counts)
    table = records.sparkSession.createDataFrame(list(post.items()) or [("", 0.0)], "pattern string, probability double")
    return m.join(F.broadcast(table), "pattern").select("tbl", "rec_id", "share", "probability")


def cases(records: DataFrame) -> DataFrame:
    """``tbl, rec_id`` of the records that are probably repetitive; the posterior alone decides."""
    return repetitive_records(records).where(F.col("probability") >= 0.5).select("tbl", "rec_id")
