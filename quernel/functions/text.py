"""Column expressions on text. All stay in the JVM except Unicode normalisation, which Spark lacks."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters, digits and underscore over all of Unicode; a bare ``\w`` is ASCII in Java and RE2.
WORD = r"[\p{L}\p{N}_]+"
NOT_WORD = r"[^\p{L}\p{N}_]"
_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def _fold(s: pd.Series) -> pd.Series:
    def one(x):
        return None if x is None else unicodedata.normalize("NFC", unicodedata.normalize("NFC", x).casefold())

    return s.map(one)


def _beyond_ascii(text: Column) -> Column:
    return text.rlike(r"[^\x00-\x7F]")


def nfc(text: Column) -> Column:
    """NFC form. Plain ASCII never leaves the JVM: the Python function sees null for it."""
    return F.coalesce(_nfc(F.when(_beyond_ascii(text), text)), text)


def fold(text: Column) -> Column:
    """Case-folded NFC form, for comparisons that ignore case and the composition of accents."""
    return F.coalesce(_fold(F.when(_beyond_ascii(text), text)), F.lower(text))


def strip(text: Column) -> Column:
    """Removes Unicode white space at both ends; SQL ``trim`` removes spaces only."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_controls(text: Column) -> Column:
    unix = F.regexp_replace(text, r"\r\n?", "\n")
    return strip(F.regexp_replace(unix, _CONTROL, ""))


def normalize(text: Column) -> Column:
    """NFC, unix line ends, no control characters, stripped - in that order."""
    return clean_controls(nfc(text))


def words(text: Column) -> Column:
    """Lower-case word tokens."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def count_matches(text: Column, pattern: str) -> Column:
    """Characters of ``text`` that match the one-character class ``pattern``."""
    return F.length(text) - F.length(F.regexp_replace(text, pattern, ""))


def word_ngrams(tokens: Column, n: int) -> Column:
    """Space-joined n-grams; an empty array if there are fewer than ``n`` tokens."""
    last = F.size(tokens) - n + 1
    return F.when(
        last >= 1,
        F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.array_join(F.slice(tokens, i, n), " ")),
    ).otherwise(F.array().cast("array<string>"))
