"""Problem 7: token ids of a public byte-level BPE vocabulary by dynamic programming over prefixes."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The splitting pattern of the byte-level vocabularies (fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct pieces whose ids a worker remembers; the memory is emptied when full.
REMEMBERED = 200_000


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Place of a vocabulary file: in ``folder``, or where the installed public_tokenizers package keeps it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


class PrefixEncoder:
    """Encodes pieces of text left to right.

    The encoding of every prefix of a piece ends in one token that is determined by the prefix alone. ``last[i]``
    holds it for the first ``i`` bytes. The token that ends at ``i`` is the one candidate ``t`` of the vocabulary for
    which merging ``last[i - len(t)] + t`` gives back exactly these two tokens, so a prefix is solved from shorter
    prefixes, bytes can be appended without touching what stands before, and after an edit only the table near the
    edit is made anew. Time is linear in the length of the piece.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {i: b for b, i in ranks.items()}
        self.longest = max(map(len, ranks))
        self._pairs: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}
        self._pieces: dict[str, list[int]] = {}

    @classmethod
    def load(cls, path: str) -> PrefixEncoder:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})

    def _merged(self, data: bytes) -> list[int]:
        """Plain lowest-rank-first merging, used on at most two tokens' bytes."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def _adjacent(self, a: int, b: int) -> bool:
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) > 4 * REMEMBERED:
                self._pairs.clear()
            known = self._pairs[a, b] = self._merged(self.bytes[a] + self.bytes[b]) == [a, b]
        return known

    def _alone(self, t: int) -> bool:
        known = self._whole.get(t)
        if known is None:
            known = self._whole[t] = self._merged(self.bytes[t]) == [t]
        return known

    def extend(self, data: bytes, last: list[int]) -> list[int]:
        """Fills ``last`` (whose entry 0 stands for the empty prefix) up to the whole of ``data``."""
        while len(last) <= len(data):
            self._entry(data, last)
        return last

    def _entry(self, data: bytes, last: list[int]) -> None:
        """Appends the entry of the next prefix."""
        i, get = len(last), self.ranks.get
        for j in range(max(0, i - self.longest), i):
            t = get(data[j:i])
            if t is not None and (self._alone(t) if j == 0 else self._adjacent(last[j], t)):
                last.append(t)
                return
        raise ValueError(f"byte {data[i - 1]} is not in the vocabulary")

    def table(self, data: bytes) -> list[int]:
        return self.extend(data, [-1])

    def ids(self, data: bytes, last: list[int] | None = None) -> list[int]:
        """Ids of ``data``, read backwards from the table of its prefixes."""
        last = self.table(data) if last is None else last
        out, i = [], len(data)
        while i:
            out.append(last[i])
            i -= len(self.bytes[last[i]])
        return out[::-1]

    def edited(self, before: bytes, last: list[int], after: bytes) -> list[int]:
        """The table of ``after``, made anew only near the edit.

        The entries up to the first byte that differs are kept. Behind the last byte that differs the old entries hold
        again once as many in sequence agree with them as the longest token has bytes, since an entry depends on no more.
        """
        same = len(os.path.commonprefix([before, after]))
        tail = len(os.path.commonprefix([before[same:][::-1], after[same:][::-1]]))
        new, shift, agree = last[: same + 1], len(before) - len(after), 0
        while len(new) <= len(after):
            i = len(new)
            self._entry(after, new)
            agree = agree + 1 if i > len(after) - tail and new[i] == last[i + shift] else 0
            if agree > self.longest:
                return new + last[i + shift + 1 :]
        return new

    def encode(self, text: str) -> list[int]:
        import regex

        out: list[int] = []
        for piece in regex.findall(PATTERN, text):
            known = self._pieces.get(piece)
            if known is None:
                data = piece.encode("utf-8", "replace")
                one = self.ranks.get(data)
                known = [one] if one is not None else self.ids(data)
                if len(piece) <= 64:
                    if len(self._pieces) >= REMEMBERED:
                        self._pieces.clear()
                    self._pieces[piece] = known
            out += known
        return out


_loaded: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    """The encoder of a vocabulary file, read once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = PrefixEncoder.load(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids``: the token ids of every row's text, without special tokens; ``[]`` for empty and for null text.

    Strings that look like special tokens are ordinary text. Rows are encoded where they are read, without a shuffle;
    each Python worker encodes a distinct piece once. Repeated ids give repeated rows. Other columns are not read.
    """
    where = path or vocabulary_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(where)
        for b in batches:
            yield pd.DataFrame({key: b[key], "ids": [enc.encode(t) if t else [] for t in b[text]]})

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(run, f"{key} {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key, text`` of every row's ids; bytes that are no UTF-8 become replacement characters."""
    where = path or vocabulary_path()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = encoder(where).bytes
        for b in batches:
            yield pd.DataFrame({key: b[key], "text": [b"".join(names[i] for i in x).decode("utf-8", "replace") for x in b[ids]]})

    return encoded.select(key, ids).mapInPandas(run, f"{key} {encoded.schema[key].dataType.simpleString()}, text string")


def token_totals(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per source documents, tokens, UTF-8 bytes and bytes a token (null without tokens)."""
    ids = encode_documents(docs.withColumn("_k", F.struct("source", F.octet_length(F.coalesce("text", F.lit(""))).alias("b"))), path, "_k")
    tokens, size = F.sum(F.size("ids")), F.sum("_k.b")
    return (
        ids.groupBy(F.col("_k.source").alias("source"))
        .agg(F.count("*").alias("docs"), tokens.alias("tokens"), size.alias("bytes"))
        .withColumn("bytes_per_token", F.when(F.col("tokens") > 0, F.round(F.col("bytes") / F.col("tokens"), 6)))
    )
