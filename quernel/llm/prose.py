"""Problem 6: text statistics of each document, from mergeable counts of its chunks."""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from operator import add

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quernel.sources.tables import latest

#: Characters of a chunk. Documents up to this length are counted where they are read.
CHUNK = 1 << 16
#: States merged by one task in one round of the tree.
FAN_IN = 64

# Common words of English, German, French and Spanish.
COMMON = frozenset(
    """a about after all also an and any are as at be because been before between both but by can could did do does
    during each even every few for from had has have he her his how if in into is it its just like may more most my
    neither no nor not of on once only or other our over she should some such than that the their them then there these
    they this those through to too under was we were what when where which while who whom whose why will with without
    would you your
    aber als am an auch auf aus bei bis das dass dem den der des die doch durch ein eine einem einen einer eines er es
    für gegen hat haben hinter ich ihr im in ist kann man mit nach neben nicht noch nur oder ohne sehr seit sich sie
    sind so um und unter viele vom von vor war warum was wenn wer wie wir wird wo wurde zu zum zur zwischen über
    au aux avant avec ce ces cette chez comme dans de des du elle en est et était être il ils la le les leur lorsque
    mais ne nous on ou où par pas pendant plus pour presque puis quand que qui rien sa sans se ses si son sont sous sur
    un une vers vous y à depuis
    al antes aquel casi cerca como con cuando de del desde después donde e el ella ellos en entre era es esta este está
    fue ha hace hacia hasta hay junto la las le lo los más mientras muy nada ni no nos o otra para pero por porque qué
    que se ser si sin sobre son su sus también tan todo un una unas uno unos y ya""".split()
)
ENDS = ".!?…:;\"”’»)。！？؟।"
#: Letters, digits and underscores of an unbroken run beyond which its words are counted but not looked at.
LONG = 64

_WORDS = re.compile(r"\w+")
_LETTERS = re.compile(r"[^\W\d_]")
#: Letters beyond the Latin script.
_FOREIGN = re.compile("[^\\W\\d_\\u0000-\\u024f]")
#: Vowels of the Latin, Greek and Cyrillic scripts, and all letters of others.
_LOW = "aeiouyæœøäöüàáâãåèéêëìíîïòóôõùúûýÿąęėįųūāēīōůőűıαεηιουωάέήίόύώаеёиоуыэюяіїєўө"
_VOWELS = re.compile(rf"[{_LOW}{''.join(sorted(set(_LOW.upper())))}]|[^\W\d_\u0000-\u052f\u1e00-\u1fff]")
_PLAIN = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*[,.;:!?…)\"”’»]*")
#: Marks of tables, markup, addresses and broken encodings.
_MARKS = re.compile(r"[|{}<>\[\]\\#=~^_§¶%&@*/+ÃÂ�]|(?<=â)€")
#: The end of a sentence inside a line.
_STOP = r"[.!?…。！？؟।][\"'”’»)\]]{0,8}"
_STOPS = re.compile(rf"{_STOP}(?=\s)")
_STOPPED = re.compile(rf"{_STOP}\Z")
_EDGES = re.compile(r"(\S*)(.*\s)(\S*)", re.S)

_SUMS = ("chars", "letters", "digits", "marks", "words", "word_chars", "common", "plain", "upper", "foreign", "vowels", "commas")


class Counts:
    """Counts of some whole runs of non-blanks. ``chars`` are non-blanks."""

    __slots__ = ("sums", "longest", "last")

    def __init__(self, sums: tuple = (0,) * len(_SUMS), longest: int = 0, last: str = ""):
        self.sums, self.longest, self.last = sums, longest, last

    def __getattr__(self, name: str) -> int:
        return self.sums[_SUMS.index(name)]

    def __getstate__(self):
        return self.sums, self.longest, self.last

    def __setstate__(self, state):
        self.sums, self.longest, self.last = state

    def __add__(self, other: Counts) -> Counts:
        if not other.last:
            return self
        if not self.last:
            return other
        return Counts(tuple(map(add, self.sums, other.sums)), max(self.longest, other.longest), other.last)

    @classmethod
    def of(cls, s: str) -> Counts:
        tokens = s.split()
        if not tokens:
            return cls()
        longest = max(map(len, tokens))
        if longest > LONG:
            total = cls()
            for t in tokens:
                total = total + (Run.of(t).counts() if len(t) > LONG else cls.of(t))
            return total
        words = _WORDS.findall(s)
        ascii_ = s.isascii()
        return cls(
            (
                sum(map(len, tokens)), len(_LETTERS.findall(s)), sum(map(str.isdigit, s)), len(_MARKS.findall(s)), len(words),
                sum(map(len, words)), sum(w.lower() in COMMON for w in words), sum(_PLAIN.fullmatch(t) is not None for t in tokens),
                sum(w[0].isupper() for w in words), 0 if ascii_ else len(_FOREIGN.findall(s)), sum(map(s.count, "aeiouyAEIOUY")) if ascii_ else len(_VOWELS.findall(s)),
                sum(t[-1] in ",，、،" for t in tokens),
            ), longest, tokens[-1][-1],
        )


class Run:
    """A run of non-blanks that may go on at either end: its text, or, beyond LONG characters, what is needed of it."""

    __slots__ = ("text", "sums", "size", "first", "last", "end")

    def __init__(self, text: str | None = "", sums: tuple = (), size: int = 0, first: str = "", last: str = "", end: str = ""):
        self.text, self.sums, self.size, self.first, self.last, self.end = text, sums, size, first, last, end

    def __getstate__(self):
        return self.text, self.sums, self.size, self.first, self.last, self.end

    def __setstate__(self, state):
        self.text, self.sums, self.size, self.first, self.last, self.end = state

    @classmethod
    def of(cls, s: str) -> Run:
        return cls(s) if len(s) <= LONG else cls(s)._closed()

    def _closed(self) -> Run:
        if self.text is None:
            return self
        s = self.text
        words = _WORDS.findall(s)
        sums = (
            len(s), len(_LETTERS.findall(s)), sum(map(str.isdigit, s)), len(_MARKS.findall(s)), len(words), sum(map(len, words)), 0, 0,
            sum(w[0].isupper() for w in words), len(_FOREIGN.findall(s)), len(_VOWELS.findall(s)), 0,
        )
        return Run(None, sums, len(s), s[:1], s[-1:], s[-LONG:])

    def __bool__(self) -> bool:
        return self.text != ""

    def __add__(self, other: Run) -> Run:
        if not self or not other:
            return other if not self else self
        if self.text is not None and other.text is not None and len(self.text) + len(other.text) <= LONG:
            return Run(self.text + other.text)
        a, b = self._closed(), other._closed()
        sums = list(map(add, a.sums, b.sums))
        if _WORDS.match(a.last) and _WORDS.match(b.first):  # one word, cut in two
            sums[4] -= 1
            sums[8] -= b.first.isupper()
        if a.last == "â" and b.first == "€":
            sums[3] += 1
        return Run(None, tuple(sums), a.size + b.size, a.first, b.last, (a.end + b.end)[-LONG:])

    def counts(self) -> Counts:
        if self.text is not None and len(self.text) <= LONG:
            return Counts.of(self.text)
        x = self._closed()
        return Counts((*x.sums[:-1], int(x.last in ",，、،")), x.size, x.last)

    def stopped(self) -> bool:
        return _STOPPED.search(self.end if self.text is None else self.text) is not None


def is_prose(x: Counts) -> bool:
    """Whether a sentence, or what stands between two in a line, reads as running text: mostly plain words, few marks
    and figures, and enough common words of four languages. Without those it must look like a sentence of another
    language: ended, few names and commas, words with vowels; or, beyond the Latin script, be ended or long.
    """
    if x.words == 0 or x.marks > 0.12 * x.words + 1 or x.letters < 0.6 * x.chars:
        return False
    ended, spelt = x.last in ENDS, 0.22 * x.letters <= x.vowels
    if 2 * x.foreign > x.letters:
        return spelt and x.commas <= 0.4 * x.words and (ended or x.letters >= 25)
    if x.longest > 60:
        return False
    common, plain, upper = x.common / x.words, x.plain / x.words, x.upper / x.words
    if x.words < 4:
        return ended and plain >= 0.6 and upper <= 0.67
    if common >= 0.2:
        return plain >= 0.55
    if plain < 0.7 or upper > 0.4:
        return False
    return common >= 0.1 or (ended and (common > 0 or spelt and x.commas <= 0.25 * x.words and plain >= 0.8 and x.vowels <= 0.65 * x.letters))


TOTALS = ("chars", "letters", "digits", "marks", "words", "word_chars", "common", "lines", "ended", "solid", "prose")
_SCHEMA = ", ".join(f"{t} long" for t in TOTALS)


class State:
    """What must be known of some text to put it together with what stands before and behind it. Its size is bounded.

    Sentences and lines that lie inside are in ``totals``. ``left`` and ``right`` are runs of non-blanks that may go on
    outside (``right`` is None if the text is one such run), ``head`` and ``tail`` count the whole runs between them and
    the first and the last end of a sentence or line (``tail`` is None if there is no such end, and ``head`` reaches
    ``right``). ``opening`` and ``closing`` are the last signs of the lines cut at the two ends (``closing`` is None
    without a line end).
    """

    __slots__ = ("totals", "left", "head", "tail", "right", "opening", "closing")

    def __init__(self):
        self.totals = dict.fromkeys(TOTALS, 0)
        self.left, self.head, self.tail, self.right = Run(), Counts(), None, None
        self.opening, self.closing = "", None

    def __getstate__(self):
        return tuple(getattr(self, n) for n in self.__slots__)

    def __setstate__(self, state):
        for n, v in zip(self.__slots__, state):
            setattr(self, n, v)

    @classmethod
    def of(cls, text: str) -> State:
        s = cls()
        s.totals["chars"] = len(text) - text.count("\n")
        first, *rest = text.split("\n")
        s.opening = first.rstrip()[-1:]
        if rest:
            s.closing = rest[-1].rstrip()[-1:]
            for line in rest[:-1]:
                s._line(line.rstrip()[-1:])
        m = _EDGES.fullmatch(text)
        if m is None:
            s.left = Run.of(text)
            return s
        left, middle, right = m.groups()
        s.left, s.right = Run.of(left), Run.of(right)
        parts = []
        for line in (" " + middle).split("\n"):
            at = 0
            for stop in _STOPS.finditer(line):
                parts.append(line[at : stop.end()])
                at = stop.end()
            parts.append(line[at:])
        s.head = Counts.of(parts[0])
        if len(parts) > 1:
            for p in parts[1:-1]:
                s._close(Counts.of(p))
            s.tail = Counts.of(parts[-1])
        return s

    def _line(self, last: str) -> None:
        if last:
            self.totals["lines"] += 1
            self.totals["ended"] += last in ENDS

    def _close(self, x: Counts) -> None:
        t = self.totals
        for n, v in zip(_SUMS[1:7], x.sums[1:7]):
            t[n] += v
        t["solid"] += x.sums[0]
        if is_prose(x):
            t["prose"] += x.sums[0]

    def then(self, other: State) -> State:
        out = State()
        out.totals = {k: v + other.totals[k] for k, v in self.totals.items()}
        out.opening, out.closing = self.opening, other.closing
        joined = (self.opening if self.closing is None else self.closing, other.opening)
        if self.closing is None:
            out.opening = joined[1] or joined[0]
        elif other.closing is None:
            out.closing = joined[1] or joined[0]
        else:
            out._line(joined[1] or joined[0])
        if self.right is None:
            out.left, out.head, out.tail, out.right = self.left + other.left, other.head, other.tail, other.right
            return out
        if other.right is None:
            out.left, out.head, out.tail, out.right = self.left, self.head, self.tail, self.right + other.left
            return out
        out.left, out.head, out.tail, out.right = self.left, self.head, self.tail, other.right
        run = self.right + other.left
        out._extend(run.counts())
        if run.stopped():
            out._end(Counts())
        out._extend(other.head)
        if other.tail is not None:
            out._end(other.tail)
        return out

    def _extend(self, x: Counts) -> None:
        if self.tail is None:
            self.head = self.head + x
        else:
            self.tail = self.tail + x

    def _end(self, tail: Counts) -> None:
        """An end of a sentence or line, and the whole runs behind the last one."""
        if self.tail is not None:
            self._close(self.tail)
        self.tail = tail

    def finish(self) -> dict[str, int]:
        edge = State.of("\n")
        out = edge.then(self).then(edge).totals
        out["chars"] = self.totals["chars"]
        return out


def text_counts(docs: DataFrame, key: str = "row_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """``key`` and the totals of each row's text, 0 for null or empty text.

    Short texts are counted where they are read, without a shuffle. Longer ones are cut into chunks, which are spread
    over the cluster and counted alone; the states, which carry the lines and words cut at their ends, are merged in
    a tree of ``FAN_IN`` states a task, so the result equals that of the uncut text.
    """
    kind = docs.schema[key].dataType.simpleString()
    d = docs.select(F.col(key), F.col(text).alias("text"))
    size = F.coalesce(F.length("text"), F.lit(0))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [State.of(t or "").finish() for t in b["text"]]
            yield pd.DataFrame({key: b[key], **{n: [r[n] for r in rows] for n in TOTALS}})

    short = d.where(size <= chunk).mapInPandas(count, f"{key} {kind}, {_SCHEMA}")

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(
                {key: b[key], "doc": b["doc"], "no": b["no"], "state": [pickle.dumps(State.of(t)) for t in b["text"]]}
            )

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no")
        total = None
        for s in map(pickle.loads, pdf["state"]):
            total = s if total is None else total.then(s)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "doc": [pdf["doc"].iloc[0]], "no": [pdf["no"].iloc[0] // FAN_IN], "state": [pickle.dumps(total)]})

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [pickle.loads(s).finish() for s in b["state"]]
            yield pd.DataFrame({key: b[key], **{n: [r[n] for r in rows] for n in TOTALS}})

    long = d.where(size > chunk)
    most = long.agg(F.max(F.length("text"))).first()[0]
    if most is None:
        return short
    states = (
        long.withColumn("doc", F.monotonically_increasing_id())
        .select(key, "doc", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0))).alias("no", "text"))
        .repartition("doc", "no")
        .mapInPandas(part, f"{key} {kind}, doc long, no long, state binary")
    )
    n = -(-most // chunk)
    while n > 1:
        states = states.groupBy("doc", F.floor(F.col("no") / FAN_IN)).applyInPandas(merge, f"{key} {kind}, doc long, no long, state binary")
        n = -(-n // FAN_IN)
    return short.unionByName(states.mapInPandas(finish, f"{key} {kind}, {_SCHEMA}"))


def _ratio(a, b):
    return F.when(b > 0, F.round(a / b, 6)).otherwise(0.0)


def text_quality(docs: DataFrame) -> DataFrame:
    """Per ``row_id``, at its latest delivery, the ratios and rule outcomes of its text.

    ``n_chars, n_words, n_lines`` (lines with text), ``mean_word, symbol_ratio`` (neither letter, digit nor blank is
    not told apart here: marks of markup a word), ``ended_lines, common_words, alpha_ratio, prose_share``, and the
    rules ``few_words, odd_words, many_symbols, few_common, few_ended, not_prose``. A null text counts as empty: all
    figures are 0, and ``few_words`` is its only outcome.
    """
    c = text_counts(docs.select(F.struct("row_id", "loaded_at", "source").alias("k"), "text"), "k")
    flat = c.select(F.col("k.row_id").alias("row_id"), F.col("k.loaded_at").alias("loaded_at"), F.col("k.source").alias("source"), *TOTALS)
    one = latest(flat, "row_id", ["source", *TOTALS])
    x = F.col
    stats = one.select(
        "row_id", "source", x("chars").alias("n_chars"), x("words").alias("n_words"), x("lines").alias("n_lines"),
        _ratio(x("word_chars"), x("words")).alias("mean_word"), _ratio(x("marks"), x("words")).alias("symbol_ratio"),
        _ratio(x("ended"), x("lines")).alias("ended_lines"), _ratio(x("common"), x("words")).alias("common_words"),
        _ratio(x("letters"), x("chars")).alias("alpha_ratio"), _ratio(x("prose"), x("solid")).alias("prose_share"),
        x("solid"),
    )
    some = x("solid") > 0
    return stats.select(
        "*",
        (x("n_words") < 50).alias("few_words"),
        (some & ~x("mean_word").between(3, 10)).alias("odd_words"),
        (some & (x("symbol_ratio") > 0.1)).alias("many_symbols"),
        (some & (x("common_words") < 0.15)).alias("few_common"),
        (some & (x("ended_lines") < 0.1)).alias("few_ended"),
        (some & (x("prose_share") < 0.5)).alias("not_prose"),
    ).drop("solid")


def junk_found(docs: DataFrame, source: str = "fineweb_edu") -> DataFrame:
    """``row_id`` of the rows of ``source`` whose text is, by characters, for the larger part no prose."""
    return text_quality(docs.where(F.col("source") == source)).where("not_prose").select("row_id")
