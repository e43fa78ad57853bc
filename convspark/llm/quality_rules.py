"""Operator 9: quality rules, a base filter and a decision list learned from labelled statistics.

The list is learned by sequential covering: a rule is a conjunction of thresholds on statistics of a text. It is grown
on two thirds of the labelled rows by information gain, pruned on the other third, and kept if it is precise there;
the rows it covers go, and the next rule is grown. The rules become one ordered conditional expression in Spark.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convspark.llm.common import replaced, table

REPEAT_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Labelled rows that the rules are learned from, those with the smallest hashes of doc_id.
FIT_ROWS = 20_000
#: No bound in practice: each rule covers a labelled row that no rule before it does, and the list ends by precision.
MAX_RULES = FIT_ROWS
#: Of the rows of the pruning third that a rule covers, the part that must be bad.
MIN_PRECISION = 0.9

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_digits", "n_marks", "n_same", "n_distinct"]
_ARROW = pa.struct([(c, pa.int64()) for c in _COUNTS])


def _bytes(chars: str) -> np.ndarray:
    return np.frombuffer(chars.encode(), np.uint8)


_BLANKS = _bytes("\t\n\x0b\x0c\r ")
_SYMBOLS = _bytes("#*$%&|<>")
_UPPER = _bytes("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGITS = _bytes("0123456789")
_MARKS = _bytes("!?.,;:")
_STEPS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(REPEAT_WORDS)], np.uint64)


def repeated_words(words: list[bytes], window: int = REPEAT_WORDS) -> int:
    """Words in windows that the text has twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    sums = np.zeros(n, np.uint64)
    for i in range(window):
        sums += ids[i : i + n] * _STEPS[i]
    order = np.argsort(sums, kind="stable")
    same = sums[order][1:] == sums[order][:-1]
    twice = order[np.r_[False, same] | np.r_[same, False]]
    if not len(twice):
        return 0
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def statistics_of(data: bytes | None) -> dict[str, int]:
    data = data or b""
    chars = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    points = len(data) - int(chars[0x80:0xC0].sum())
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    return {
        "n_words": len(words),
        "word_chars": points - int(chars[_BLANKS].sum()),
        "n_symbols": int(chars[_SYMBOLS].sum()),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated_words(words),
        "n_lines": len(lines),
        "n_upper": int(chars[_UPPER].sum()),
        "n_digits": int(chars[_DIGITS].sum()),
        "n_marks": int(chars[_MARKS].sum()),
        "n_same": sum(map(eq, words, words[1:])),
        "n_distinct": len(set(words)),
    }


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in _COUNTS]))
def _statistics(text: pa.Array) -> pa.Array:
    return pa.array([statistics_of(t) for t in text.cast(pa.binary()).to_pylist()], _ARROW)


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``stats`` (an input column of that name goes): counts over the whole text; 0 if it is null."""
    return replaced(docs, stats=_statistics("text"))


def base_failed(stats: Column) -> Column:
    few = stats["n_words"] < MIN_WORDS
    return few | (100 * stats["n_repeat_words"] > MAX_REPEAT_PERCENT * stats["n_words"])


def features(stats: Column) -> dict[str, Column]:
    """What the rules' thresholds are on."""
    words = F.greatest(stats["n_words"], F.lit(1)).cast("double")
    chars = F.greatest(stats["word_chars"], F.lit(1)).cast("double")
    lines = F.greatest(stats["n_lines"], F.lit(1)).cast("double")
    return {
        "words": stats["n_words"].cast("double"),
        "chars_per_word": stats["word_chars"] / words,
        "symbols_per_word": stats["n_symbols"] / words,
        "repeat_share": stats["n_repeat_words"] / words,
        "duplicate_line_share": stats["n_dup_lines"] / lines,
        "words_per_line": words / lines,
        "upper_share": stats["n_upper"] / chars,
        "digit_share": stats["n_digits"] / chars,
        "marks_per_word": stats["n_marks"] / words,
        "same_as_before_share": stats["n_same"] / words,
        "distinct_share": stats["n_distinct"] / words,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        x = rows[self.feature]
        return x >= self.threshold if self.at_least else x <= self.threshold

    def column(self, made: dict[str, Column]) -> Column:
        x = made[self.feature]
        return x >= F.lit(self.threshold) if self.at_least else x <= F.lit(self.threshold)


Rule = tuple[Condition, ...]


def _covers(rule: Rule, rows: dict[str, np.ndarray], size: int) -> np.ndarray:
    out = np.ones(size, bool)
    for c in rule:
        out &= c.holds(rows)
    return out


def _cuts(x: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Half way between neighbouring values, except where both have bad rows only or good rows only. ``x`` is sorted,
    ``hits`` counts the bad rows before each place."""
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    ends = np.r_[first[1:], len(x)]
    share = (hits[ends] - hits[first]) / (ends - first)
    same = (share[1:] == share[:-1]) & ((share[1:] == 0) | (share[1:] == 1))
    values = x[first]
    return (values[:-1] + (values[1:] - values[:-1]) / 2)[~same]


def _grow(rows: dict[str, np.ndarray], bad: np.ndarray, tried: list[str]) -> Rule:
    """Adds the condition of the largest gain until the rule covers no good row."""
    rule: Rule = ()
    inside = np.ones(len(bad), bool)
    while bad[inside].any() and not bad[inside].all():
        p0, n0 = int(bad[inside].sum()), int((~bad[inside]).sum())
        best, gain = None, 0.0
        for name in tried:
            x, y = rows[name][inside], bad[inside]
            order = np.argsort(x, kind="stable")
            x, hits = x[order], np.r_[0, np.cumsum(y[order])]
            values = _cuts(x, hits)
            if not len(values):
                continue
            for at_least in (True, False):
                at = np.searchsorted(x, values, side="left" if at_least else "right")
                p = p0 - hits[at] if at_least else hits[at]
                n = (len(x) - at if at_least else at) - p
                with np.errstate(divide="ignore", invalid="ignore"):
                    g = p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))
                g = np.where((p > 0) & (n < n0), g, 0.0)
                i = int(g.argmax())
                if g[i] > gain + 1e-9:
                    best, gain = Condition(name, at_least, float(values[i])), float(g[i])
        if best is None:
            break
        rule += (best,)
        inside &= best.holds(rows)
    return rule


def _prune(rule: Rule, rows: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The leading conditions that are worth most on rows that the rule was not grown on; the shortest of equals."""

    def worth(r: Rule) -> float:
        c = _covers(r, rows, len(bad))
        p, n = int(bad[c].sum()), int((~bad[c]).sum())
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=worth, default=())


def learn(rows: dict[str, np.ndarray], bad: np.ndarray, max_rules: int = MAX_RULES, precision: float = MIN_PRECISION) -> list[Rule]:
    """The decision list for bad rows; rows no rule covers are good. Every third row is for pruning."""
    third = np.arange(len(bad)) % 3 == 2
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    tried = list(rows)
    while len(rules) < max_rules and bad[left].any():
        grow, prune = left & ~third, left & third
        rule = _grow({k: v[grow] for k, v in rows.items()}, bad[grow], tried)
        if not rule:
            break
        begun = rule[0].feature
        held = {k: v[prune] for k, v in rows.items()}
        rule = _prune(rule, held, bad[prune])
        c = _covers(rule, held, int(prune.sum()))
        if not c.any() or bad[prune][c].mean() < precision:
            tried.remove(begun)  # grown again without the statistic that it began with
            continue
        tried = list(rows)
        rules.append(rule)
        left &= ~_covers(rule, rows, len(bad))
    return rules


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = FIT_ROWS) -> list[Rule]:
    """Rules from at most ``max_rows`` labelled documents that pass the base filter.

    Labels with a null doc_id or quality teach nothing; of several labels of a document the lowest quality counts.
    """
    known = labels.filter("doc_id is not null and quality is not null")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # two numbers a row, max_rows rows
    rows = docs.select("doc_id", "text").join(F.broadcast(few), "doc_id")
    rows = statistics(rows).filter(~base_failed(F.col("stats")))
    made = features(F.col("stats"))
    # in the order of a hash: labels that follow a period in doc_id would fall into one of the thirds
    got = rows.select(F.xxhash64("doc_id").alias("h"), "quality", *[c.alias(k) for k, c in made.items()]).toPandas()
    got = got.sort_values(["h", *made], kind="stable")
    return learn({k: got[k].to_numpy(float) for k in made}, (got["quality"] == 0).to_numpy())


def verdict(stats: Column, rules: list[Rule]) -> Column:
    """Number of the first rule that covers the row, from 1; null if none does."""
    made = features(stats)
    out = F.when(F.lit(False), F.lit(0))  # one flat CASE, however many rules
    for number, rule in enumerate(rules, 1):
        condition = rule[0].column(made)
        for c in rule[1:]:
            condition = condition & c.column(made)
        out = out.when(condition, F.lit(number))
    return out


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` with ``stats``, ``base_failed``, ``rule`` (that rejects it; null if none) and ``kept``; input columns of
    these names go. Null and empty texts have no words and fail the base filter. Each row is judged alone."""
    seen = statistics(docs).drop("base_failed", "rule", "kept")
    seen = seen.withColumn("base_failed", base_failed(F.col("stats")))
    seen = seen.withColumn("rule", F.when(~F.col("base_failed"), verdict(F.col("stats"), rules)))
    return seen.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    out = judge(docs, rules)
    return out.select("doc_id", *[f"stats.{c}" for c in _COUNTS[:5]], "base_failed", "rule", "kept")


QUERIES = {"op9_quality_rules": query}
ORACLE = {}
