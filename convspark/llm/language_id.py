"""Operator 10: the language of a text by cross-parsing.

A suffix automaton for each language accepts all substrings of a sample of its labelled text. A text is parsed against
each automaton into phrases, each the longest match from where the last one ended, with the next letter if the sample lacks it; the number of phrases, times the logarithm
of the sample's length and over the text's length, estimates the cross entropy. The language with the least wins.

Texts are parsed whole, in pieces of ``PIECE`` symbols that each begin a phrase, so that the pieces of a batch advance
together: one array step takes the next symbol of every piece in every language.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convspark.llm.common import table

#: Bound of the labelled sample: different texts of a language, each learned whole.
SAMPLE_DOCS = 16
#: Texts of more code points are sampled only where a language has too few others.
LONG_TEXT = 20_000
#: Groups of tasks whose candidates are ranked apart first.
_GROUPS = 16
UNKNOWN = "und"
PIECE = 1024
#: Pieces that advance together.
TOGETHER = 8192
_GAP = " "

FOUND = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
_ARROW_FOUND = pa.struct([("lang", pa.string()), ("score", pa.float64())])


def held_out(doc_id: Column) -> Column:
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4) == 2


def letters(text: str) -> str:
    """Lower-case letters; each run of anything else becomes one blank, and one stands at either end."""
    return _GAP + _GAP.join("".join(c if c.isalpha() else _GAP for c in text.lower()).split()) + _GAP


def sample(docs: DataFrame, max_docs: int = SAMPLE_DOCS, long_text: int = LONG_TEXT) -> dict[str, str]:
    """Normalised training text of each language: whole texts, ``max_docs`` of a language at most. Of the different labelled
    texts outside the held-out quarter those with the smallest hashes are taken, such of more than ``long_text`` code
    points last. Only these texts reach the driver. Null languages, null texts and texts without letters teach nothing."""
    known = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    known = known.select("lang", F.xxhash64("text").alias("h"), (F.char_length("text") > long_text).alias("long"), "text")
    # copies go first, by their hash; then max_docs rows of a language stay in each task, in each group of tasks, in all
    places = known.select("lang", "h", "long").distinct().withColumn("part", F.spark_partition_id() % _GROUPS)
    order = [F.col("long"), F.col("h")]
    rank = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    few = places.withColumn("n", rank("lang", "part")).filter(F.col("n") <= max_docs).drop("n")
    few = few.withColumn("n", rank("lang")).filter(F.col("n") <= max_docs).select("lang", "h", "long", "n")
    taken = known.join(F.broadcast(few), ["lang", "h", "long"])  # max_docs rows of a language
    rows = taken.groupBy("lang", "n").agg(F.min("text").alias("text")).orderBy("lang", "n").collect()
    out: dict[str, str] = {}
    for r in rows:
        out[r["lang"]] = out.get(r["lang"], "") + letters(r["text"])
    return out


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the automaton that accepts the substrings of the text; state 0 is the start."""
    step: list[dict[str, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text:
        new = len(step)
        step.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return step


@dataclass
class Model:
    """Small to send: training texts. The automata are built once in each Python worker."""

    texts: dict[str, str]
    key: str = field(init=False)

    def __post_init__(self):
        self.key = hashlib.sha256(repr(sorted(self.texts.items())).encode()).hexdigest()


class Parser:
    """The automata of all languages as one hash table of their edges: memory follows the length of the samples, whatever
    the number of letters. A state is written as its number times the number of symbols, so an edge's key is a sum."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        if not self.langs:
            return
        alphabet = sorted({c for t in texts.values() for c in t} - {_GAP})
        # 0 is a letter that no language has, 1 a gap
        self.codes = np.zeros(0x110000, np.uint8 if len(alphabet) < 254 else np.int32)
        for i, c in enumerate([_GAP, *alphabet]):
            self.codes[ord(c)] = i + 1
        size = len(alphabet) + 2
        keys, goals, starts, self.first = [], [], [], np.zeros((len(self.langs), size), np.int64)
        base = 0
        for n, lang in enumerate(self.langs):
            steps = suffix_automaton(texts[lang])
            states = np.fromiter((s for s, go in enumerate(steps) for _ in go), np.int64)
            codes = self.codes[np.fromiter((ord(c) for go in steps for c in go), np.int64)]
            to = (base + np.fromiter((t for go in steps for t in go.values()), np.int64)) * size
            keys.append((base + states) * size + codes)
            goals.append(to)
            starts.append(base * size)
            self.first[n] = base * size  # a letter that the sample lacks is the last of its phrase
            self.first[n, codes[states == 0]] = to[states == 0]
            base += len(steps)
        self.starts = np.array(starts, np.int64)
        self._fill(np.concatenate(keys), np.concatenate(goals))
        self.norm = np.array([math.log2(len(texts[lang]) + 1) for lang in self.langs])

    def _fill(self, keys: np.ndarray, goals: np.ndarray) -> None:
        """Open addressing, a quarter full: an edge lies at its place or behind it, with no gap between."""
        bits = max(3, int(len(keys) * 4 - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.goals = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)
        place = self._place(keys)
        while len(keys):
            taken, first = np.unique(place, return_index=True)
            first = first[self.keys[taken] < 0]
            self.keys[place[first]], self.goals[place[first]] = keys[first], goals[first]
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, goals, place = keys[rest], goals[rest], (place[rest] + 1) & self.mask

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def _follow(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(goal, found) of each edge."""
        place = self._place(keys)
        there = self.keys[place]
        found = there == keys
        open_ = np.flatnonzero(~found & (there >= 0))
        while len(open_):
            place[open_] = (place[open_] + 1) & self.mask
            there = self.keys[place[open_]]
            hit = there == keys[open_]
            found[open_[hit]] = True
            open_ = open_[~hit & (there >= 0)]
        return self.goals[place], found

    def symbols(self, text: str) -> np.ndarray:
        return self.codes[np.frombuffer(letters(text).encode("utf-32-le", "replace"), np.uint32)]

    def count(self, pieces: list[np.ndarray]) -> np.ndarray:
        """Phrases of each piece (rows) in each language (columns)."""
        sizes = np.array([len(p) for p in pieces])
        order = np.argsort(-sizes, kind="stable")
        grid = np.zeros((int(sizes.max()), len(pieces)), pieces[0].dtype)
        for column, i in enumerate(order.tolist()):
            grid[: sizes[i], column] = pieces[i]
        state = np.repeat(self.starts[:, None], len(pieces), axis=1)
        ended = np.zeros(state.shape, np.int32)
        live = np.searchsorted(-sizes[order], -np.arange(len(grid)), side="left")
        for t, n in enumerate(live.tolist()):
            goal, found = self._follow((state[:, :n] + grid[t, :n]).ravel())
            # where no edge goes on the phrase ends, and the letter begins the next one if the sample has it
            misses = np.flatnonzero(~found)
            lang, piece = np.divmod(misses, n)
            goal[misses] = self.first[lang, grid[t, piece]]
            ended[lang, piece] += 1
            state[:, :n] = goal.reshape(-1, n)
        out = np.empty((len(pieces), len(self.langs)), np.int64)
        begun = state != self.starts[:, None]
        out[order] = (ended + begun).T
        return out

    def predict(self, texts: list[str | None]) -> list[dict]:
        out = [{"lang": UNKNOWN, "score": 0.0} for _ in texts]
        totals = np.zeros((len(texts), len(self.langs)))
        lengths = np.zeros(len(texts))
        pieces: list[np.ndarray] = []
        owners: list[int] = []

        def run():
            if pieces:
                np.add.at(totals, owners, self.count(pieces))
                pieces.clear()
                owners.clear()

        for i, text in enumerate(texts):
            if not self.langs or not text or not any(map(str.isalpha, text)):
                continue
            codes = self.symbols(text)
            lengths[i] = len(codes)
            for at in range(0, len(codes), PIECE):
                pieces.append(codes[at : at + PIECE])
                owners.append(i)
                if len(pieces) == TOGETHER:
                    run()
        run()
        for i in np.flatnonzero(lengths).tolist():
            rate = totals[i] * self.norm / lengths[i]
            best = int(rate.argmin())
            rest = np.delete(rate, best)
            score = 1.0 - rate[best] / rest.min() if len(rest) else 1.0
            out[i] = {"lang": self.langs[best], "score": float(score)}
        return out


_PARSERS: dict[str, Parser] = {}


def _parser(model: Model) -> Parser:
    if model.key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[model.key] = Parser(model.texts)
    return _PARSERS[model.key]


def fit(docs: DataFrame) -> Model:
    return Model(sample(docs))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (input columns of these names go).

    A null text or one without a letter is ``und`` with score 0, as is every text if nothing was learned. Of languages
    that need equally many phrases the first by name wins, with score 0. The score is 1 less the ratio of the best rate to
    the second best; with a single language it is 1. The text is the only input; each row is judged alone.
    """
    kept = docs.drop("lang_pred", "score")
    found = _parsed(kept, model)
    return found.select(
        *kept.columns, F.col("_llm_found.lang").alias("lang_pred"), F.col("_llm_found.score").alias("score")
    )


def _parsed(docs: DataFrame, model: Model) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(FOUND)
    def parse(text: pa.Array) -> pa.Array:
        return pa.array(_parser(sent.value).predict(text.to_pylist()), _ARROW_FOUND)

    return docs.withColumn("_llm_found", parse("text"))


def known_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with a language: rejects texts without letters and texts that fit two languages alike. Where no
    row teaches a language, all texts with letters stay."""
    model = fit(docs)
    if not model.texts:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    seen = _parsed(docs, model)
    return seen.filter((F.col("_llm_found.lang") != UNKNOWN) & (F.col("_llm_found.score") > 0)).select(*docs.columns)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    seen = identify(docs.select("doc_id", "text"), fit(docs))
    return seen.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op10_language_id": query}
ORACLE = {}
