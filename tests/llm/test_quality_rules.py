import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from convspark.llm import quality_rules as Q
from tests.llm.fixtures import documents, frame, words
import random

BLANK = " \t\n\x0b\x0c\r"


def plain_statistics(text):
    text = text or ""
    w = [x for x in re.split(f"[{BLANK}]+", text) if x]
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if line.strip(BLANK):
            dups += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dups, len(cover)


TEXTS = [
    "one two\none two\none two \n\n\n x\u00a0y \u2028 z",
    "a b c d e f g h i a b c d e f g h j " * 3,
    "# $ % & | < > * é日本語",
    "\x1c\x1d a \x85 b",
]


def test_statistics_equal_plain_version():
    for text in [*TEXTS, *[d[1] for d in documents()]]:
        s = Q.statistics_of(text.encode() if text else None)
        assert tuple(s[c] for c in Q._COUNTS[:5]) == plain_statistics(text)


def junk(rng, n):
    return " ".join(f"{x} |" for x in words(rng, n).split())


def labelled(n=300):
    rng = random.Random(3)
    docs = [(i, (words if i % 3 else junk)(rng, rng.randrange(25, 120)), "en", "s", 1) for i in range(n)]
    return docs, [(i, int(i % 3 != 0), 0) for i in range(n) if i % 2]


def test_learned_rules_reject_held_out_junk_and_keep_the_rest(spark):
    docs, labels = labelled()
    rules = Q.fit(frame(spark, docs), frame(spark, labels, "doc_id long, quality int, toxic int"))
    assert rules and len(rules) <= Q.MAX_RULES
    held = Q.judge(frame(spark, docs), rules).filter("doc_id % 2 = 0").collect()
    assert sum(r.kept == (r.doc_id % 3 != 0) for r in held) >= 0.97 * len(held)


def test_expression_equals_the_list():
    rng = np.random.default_rng(0)
    rows = {"a": rng.random(900).round(2), "b": rng.random(900).round(2)}
    bad = (rows["a"] > 0.7) & (rows["b"] < 0.4) | (rows["a"] < 0.1)
    rules = Q.learn(rows, bad)
    found = np.zeros(900, bool)
    for rule in rules:
        found |= Q._covers(rule, rows, 900)
    assert (found == bad).mean() > 0.97
    assert Q.learn({"a": np.zeros(0)}, np.zeros(0, bool)) == []
    assert Q.learn({"a": np.zeros(9)}, np.arange(9) % 2 == 0) == []  # nothing tells them apart


def _found(rows, bad):
    rules = Q.learn(rows, bad)
    return rules, np.any([np.zeros(len(bad), bool), *[Q._covers(r, rows, len(bad)) for r in rules]], axis=0)


def test_a_rare_defect_is_cut_off_where_it_begins():
    rng = np.random.default_rng(1)
    bad = np.arange(6000) % 200 == 7
    rows = {"a": np.where(bad, 1.1 + rng.random(6000) / 10, rng.random(6000))}
    rows["a"][7] = 500.0  # an outlier moves no threshold
    assert (_found(rows, bad)[1] == bad).all()


def test_the_list_ends_by_precision_and_not_by_length():
    rng = np.random.default_rng(2)
    rows = {"a": rng.integers(0, 40, 8000).astype(float)}
    bad = rows["a"] % 2 == 1
    rules, found = _found(rows, bad)
    assert len(rules) > 12 and (found == bad).all()
    noise = rng.random(8000) < 0.1
    assert (_found({"a": rng.random(8000), "b": rng.random(8000)}, noise)[1]).mean() < 0.01


def test_rule_numbers_follow_the_order(spark):
    rules = [(Q.Condition("words", False, 10.0),), (Q.Condition("words", True, 5.0), Q.Condition("digit_share", True, 0.5))]
    docs = frame(spark, [(i, t, "en", "s", 1) for i, t in enumerate(["a b", "1 " * 30, "x " * 30])])
    stats = Q.statistics(docs)
    got = {r.doc_id: r.n for r in stats.select("doc_id", Q.verdict(F.col("stats"), rules).alias("n")).collect()}
    assert got == {0: 1, 1: 2, 2: None}


def test_awkward_rows_and_columns(spark, tmp_path):
    rows = documents()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    frame(spark, [(1, 0, 0), (1, None, 1), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = Q.query(spark, str(tmp_path)).collect()
    want = Counter((i, *plain_statistics(t)) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got) == want
    for r in got:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    clash = frame(spark, rows).withColumn("stats", F.lit(1)).withColumn("kept", F.lit(2))
    assert Q.judge(clash, []).columns[-4:] == ["stats", "base_failed", "rule", "kept"]
    assert Q.judge(frame(spark, []), []).count() == 0
