"""Problem 8: held-out questions that stand in the corpus, whole, in part or edited."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.session import cut

#: Words of a passage that must stand in sequence; shorter questions count as a whole, down to FEWEST words.
PASSAGE, FEWEST = 13, 8
#: Words of a seed, and seeds of each passage: all but its three most frequent ones.
SEED, SEEDS = 3, 8
#: Words read on either side of the place where the item is expected in the document; places so close are one.
MARGIN, CLOSE = 12, 6
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of a perfect alignment that counts as an edited copy.
LEAST_SCORE = 0.6
#: Words of the questions that one pass over the corpus looks for; more of them take more passes.
BLOCK_WORDS = 500_000
#: Cells of the alignment matrices that are computed at once.
CELLS = 1 << 20

_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    """Words without regard to case and the composition of accents."""
    if not text:
        return []
    if text.isascii():
        return _WORD.findall(text.lower())
    return _WORD.findall(unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold()))


class Index:
    """The questions of one block as numbers, and the runs of ``SEED`` words that lead to them."""

    def __init__(self, texts: list[list[str]]):
        self.number: dict[str, int] = {}
        self.items = [np.array([self.number.setdefault(w, len(self.number)) for w in t], dtype=np.int64) for t in texts]
        self.width = len(self.number) + 1
        self.grams, self.kept = np.zeros(0, dtype=np.int64), None
        runs = [self.runs(x) for x in self.items]
        self.grams = np.unique(np.concatenate([*runs, np.zeros(0, dtype=np.int64)]))

    def runs(self, ids: np.ndarray) -> np.ndarray:
        """A number for each run of SEED words; negative if one of them is in no question."""
        k = max(0, len(ids) - SEED + 1)
        out, known = np.zeros(k, dtype=np.int64), np.ones(k, dtype=bool)
        for j in range(SEED):
            out = out * self.width + ids[j : j + k]
            known &= ids[j : j + k] >= 0
        return np.where(known, out, -1)

    def read(self, text: str | None) -> np.ndarray:
        get = self.number.get
        return np.array([get(w, -1) for w in words(text)], dtype=np.int64)

    def places(self, ids: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of runs in ``ids`` that are in the sorted ``among``, and which ones."""
        runs = self.runs(ids)
        if not len(among) or not len(runs):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(among, runs), len(among) - 1)
        hit = np.flatnonzero(among[at] == runs)
        return hit, at[hit]

    def choose(self, often: dict[int, int], least_score: float) -> Index:
        """Keeps of each passage the ``SEEDS`` runs that are rarest in the corpus, of those that occur there at all."""
        gram, item, place = [], [], []
        for k, ids in enumerate(self.items):
            runs = self.runs(ids).tolist()
            size = min(len(ids), PASSAGE) - SEED + 1
            chosen: set[int] = set()
            for b in range(len(runs) - size + 1):
                here = [i for i in range(b, b + size) if often.get(runs[i], 0) > 0]
                chosen.update(sorted(here, key=lambda i: (often[runs[i]], i))[:SEEDS])
            for i in sorted(chosen):
                gram.append(runs[i])
                item.append(k)
                place.append(i)
        grams = np.array(gram, dtype=np.int64)
        order = np.argsort(grams, kind="stable")
        self.item, self.place = np.array(item, dtype=np.int64)[order], np.array(place, dtype=np.int64)[order]
        self.kept, begin = np.unique(grams[order], return_index=True)
        self.begin = np.append(begin, len(gram))
        self.sets = [frozenset(x.tolist()) for x in self.items]
        self.need = [min(PASSAGE, len(x), int(np.ceil(least_score * len(x)))) for x in self.items]
        return self

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int, int]]:
        """``(item, begin, end)`` of the parts of a document that may hold a copy: a seed of the item stands there, and
        as many of its words as a copy has at least."""
        at, which = self.places(ids, self.kept)
        near: set[tuple[int, int]] = set()
        for p, g in zip(at.tolist(), which.tolist()):
            i, j = self.begin[g], self.begin[g + 1]
            near.update(zip(self.item[i:j].tolist(), ((p - self.place[i:j]) // CLOSE * CLOSE).tolist()))
        out = []
        for k, start in near:
            n = len(self.items[k])
            begin, end = max(0, start - MARGIN), min(len(ids), start + n + MARGIN + CLOSE)
            mine = self.sets[k]
            if sum(x in mine for x in ids[begin:end].tolist()) >= self.need[k]:
                out.append((k, begin, end))
        return out


def align(items: list[np.ndarray], parts: list[np.ndarray]) -> list[tuple[float, int]]:
    """Smith-Waterman of each pair: the best local alignment as a share of a perfect one of the item, and the most words
    that match in sequence without a gap. Pairs of like size are computed together."""
    out: list[tuple[float, int]] = [(0.0, 0)] * len(items)
    order = sorted(range(len(items)), key=lambda i: (len(items[i]), len(parts[i])))
    while order:
        size = len(items[order[-1]]) * max(1, len(parts[order[-1]]))
        batch = order[-max(1, CELLS // max(1, size)) :]
        del order[-len(batch) :]
        n, m = max(len(items[i]) for i in batch), max(len(parts[i]) for i in batch)
        a, b = np.full((len(batch), n), -2), np.full((len(batch), m), -3)
        for r, i in enumerate(batch):
            a[r, : len(items[i])], b[r, : len(parts[i])] = items[i], parts[i]
        above, runs = np.zeros((len(batch), m + 1), dtype=np.int32), np.zeros((len(batch), m + 1), dtype=np.int32)
        best, longest = np.zeros(len(batch), dtype=np.int32), np.zeros(len(batch), dtype=np.int32)
        along = -GAP * np.arange(m + 1, dtype=np.int32)
        for i in range(n):
            same = b == a[:, i : i + 1]
            row, run = np.zeros_like(above), np.zeros_like(runs)
            run[:, 1:] = np.where(same, runs[:, :-1] + 1, 0)
            row[:, 1:] = np.maximum(np.maximum(above[:, :-1] + np.where(same, MATCH, MISMATCH), above[:, 1:] + GAP), 0)
            # gaps in the item: the best earlier cell of the row less what the way from there costs
            row = np.maximum.accumulate(row + along, axis=1) - along
            best, longest = np.maximum(best, row.max(axis=1)), np.maximum(longest, run.max(axis=1))
            above, runs = row, run
        for r, i in enumerate(batch):
            out[i] = (float(best[r]) / (MATCH * len(items[i])), int(longest[r]))
    return out


def smith_waterman(items: list[list[str]], parts: list[list[str]]) -> np.ndarray:
    """The scores of ``align`` for pairs of word lists."""
    number: dict[str, int] = {}
    coded = [[np.array([number.setdefault(w, len(number)) for w in t], dtype=np.int64) for t in side] for side in (items, parts)]
    return np.array([score for score, _ in align(*coded)])


def leaks(docs: DataFrame, items: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """``doc_id, item_id, score, exact``: documents with passages of the items ``(item_id, question)``.

    Every run of ``PASSAGE`` words of a question (the whole question if it has ``FEWEST`` to ``PASSAGE`` words) gives
    seeds: of its runs of ``SEED`` words that occur in the corpus, the ``SEEDS`` rarest ones. Where a document has a seed
    and enough of the item's words near it, the two are aligned by Smith-Waterman. ``score`` is the best alignment's
    share of a perfect one; ``exact`` says whether ``PASSAGE`` words, or the whole shorter item, match without a gap in
    it. Pairs that are exact or reach ``least_score`` are returned once. Every exact passage
    holds its own seeds, so none is missed; edited copies are found if one of theirs is intact.

    The questions are what is shipped to the tasks, at most ``BLOCK_WORDS`` words of them in one pass; texts are read
    where they lie, and only pairs are shuffled. So a frequent seed costs time where it stands, but no rows.

    Null and empty texts and questions, and questions of fewer than ``FEWEST`` words, give no rows. Repeated rows
    change nothing. A document with a null id is compared like any other and returned under the null id.
    """
    spark = docs.sparkSession
    doc_kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"item_id": b["item_id"], "tokens": [words(t) for t in b["question"]]})

    named = items.select("item_id", "question").mapInPandas(tokens, f"item_id {item_kind}, tokens array<string>")
    named = cut(named.where(F.size("tokens") >= FEWEST).withColumn("t", F.md5(F.array_join("tokens", " "))).distinct())
    texts = cut(named.groupBy("t").agg(F.first("tokens").alias("tokens")))
    total = texts.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    blocks = -(-total // BLOCK_WORDS)
    corpus = docs.select("doc_id", "text").where(F.length("text") > 0)
    found = spark.createDataFrame([], f"doc_id {doc_kind}, t string, score double, exact boolean")
    for block in range(blocks):
        rows = texts.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == block).orderBy("t").collect()
        found = found.unionByName(_scan(corpus, [r["t"] for r in rows], [r["tokens"] for r in rows], doc_kind, least_score))
    best = found.groupBy("doc_id", "t").agg(F.round(F.max("score"), 6).alias("score"), F.bool_or("exact").alias("exact"))
    return best.where(F.col("exact") | (F.col("score") >= least_score)).join(named.select("item_id", "t"), "t").select("doc_id", "item_id", "score", "exact")


def _scan(corpus: DataFrame, names: list[str], texts: list[list[str]], doc_kind: str, least_score: float) -> DataFrame:
    """Counts the seeds of one block over all documents, then aligns the documents that hold one."""
    context = corpus.sparkSession.sparkContext
    index = Index(texts)
    plain = context.broadcast(index)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = plain.value
        n = np.zeros(len(x.grams), dtype=np.int64)
        for b in batches:
            for t in b["text"]:
                _, which = x.places(x.read(t), x.grams)
                np.add.at(n, which, 1)
        some = np.flatnonzero(n)
        yield pd.DataFrame({"gram": x.grams[some], "n": n[some]})

    often = corpus.select("text").mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    shared = context.broadcast(index.choose({r["gram"]: r["n"] for r in often.collect()}, least_score))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x = shared.value
        for b in batches:
            at, which, parts = [], [], []
            for k, t in enumerate(b["text"]):
                ids = x.read(t)
                for item, begin, end in x.candidates(ids):
                    at.append(k)
                    which.append(item)
                    parts.append(ids[begin:end])
            scored = align([x.items[i] for i in which], parts)
            exact = [r >= min(PASSAGE, len(x.items[i])) for (_, r), i in zip(scored, which)]
            yield pd.DataFrame(
                {"doc_id": b["doc_id"].iloc[at].reset_index(drop=True), "t": pd.Series([names[i] for i in which], dtype=object), "score": [s for s, _ in scored], "exact": exact}
            )

    return corpus.mapInPandas(run, f"doc_id {doc_kind}, t string, score double, exact boolean")


def passages_found(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id`` of the pairs whose alignment has a passage without a gap."""
    return leaks(docs, items).where("exact").select("doc_id", "item_id")
