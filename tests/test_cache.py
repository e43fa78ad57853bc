import math
import random
from collections import Counter, OrderedDict

import pytest
from pyspark.sql import functions as F

from convspark.operators import cache


def _vec(text):
    import re

    def fnv(t):
        h = 2166136261
        for b in t.encode():
            h = ((h ^ b) * 16777619) & 0xFFFFFFFF
        return h % 4096

    return Counter(fnv(t) for t in re.split(r"[^a-z0-9]+", text.lower()) if len(t) >= 2)


def _cos(a, b):
    if not a or not b:
        return 0.0
    dot = sum(v * b.get(k, 0) for k, v in a.items())
    n = lambda x: math.sqrt(sum(v * v for v in x.values()))
    return dot / (n(a) * n(b))


def _fold(rows, threshold, limit=10**9, evicted=None):
    """rows: (ns, seq, key, response) in order -> {(ns, seq): (kind, entry, answer)}"""
    spaces, out = {}, {}
    evicted = {} if evicted is None else evicted
    for ns, seq, key, response in rows:
        lru = spaces.setdefault(ns, OrderedDict())
        exact = next((e for e, v in lru.items() if v[0] == key), None)
        best, sim = exact, 1.0
        if exact is None:
            vec, best, sim = _vec(key), None, 0.0
            for e, (_, v, _) in lru.items():
                s = _cos(vec, v)
                if s > sim:
                    best, sim = e, s
        if best is not None and sim >= threshold:
            lru.move_to_end(best)
            out[(ns, seq)] = ("exact" if sim >= 1 - 1e-9 else "near", best, lru[best][2], round(sim, 9))
        else:
            lru[seq] = (key, _vec(key), response)
            out[(ns, seq)] = ("miss", None, None, round(sim, 9))
            if len(lru) > limit:
                evicted[(ns, seq)] = lru.popitem(last=False)[0]
    return out


def _rows(seed, n, words):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    rows = []
    for i in range(n):
        base = rng.randrange(6)
        text = " ".join([f"topic{base}"] * 3 + [rng.choice(vocabulary) for _ in range(rng.randrange(3))])
        rows.append((f"n{rng.randrange(2)}", i, text if rng.random() > 0.05 else "!", f"r{base}-{i}"))
    return rows


@pytest.mark.parametrize("seed,threshold", [(1, 0.9), (2, 0.75)])
def test_replay_equals_sequential_walk(spark, seed, threshold):
    rows = _rows(seed, 90, 5)
    expect = _fold(rows, threshold)
    df = spark.createDataFrame(rows, "ns string, seq long, key_text string, response string")
    got = {(r.ns, r.seq): (r.kind, r.entry_id, r.answer, round(r.similarity, 9)) for r in cache.replay(df, threshold).collect()}
    assert got == expect


def test_ties_go_to_the_least_recently_used_entry(spark):
    texts = ["aa bb", "cc dd", "aa bb cc dd", "cc dd aa bb", "aa bb", "dd cc bb aa", "cc bb aa dd", "ee ff", "bb aa dd cc"]
    rows = [("n", i, t, f"r{i}") for i, t in enumerate(texts)]
    expect = _fold(rows, 0.7)
    assert len({expect[("n", i)][1] for i in (2, 3, 5, 6, 8)}) == 2
    df = spark.createDataFrame(rows, "ns string, seq long, key_text string, response string")
    got = {(r.ns, r.seq): (r.kind, r.entry_id, r.answer, round(r.similarity, 9)) for r in cache.replay(df, 0.7).collect()}
    assert got == expect


def test_eviction_equals_sequential_walk(spark):
    rows = _rows(7, 80, 5)
    df = spark.createDataFrame(rows, "ns string, seq long, key_text string, response string")
    unlimited = {(r.ns, r.seq): (r.kind, r.entry_id, r.answer, round(r.similarity, 9)) for r in cache.replay_lru(df, 0.8, 1000).collect()}
    assert unlimited == _fold(rows, 0.8)
    tight, evicted = cache.replay_lru(df, 0.8, 2), {}
    assert {(r.ns, r.seq): (r.kind, r.entry_id, r.answer, round(r.similarity, 9)) for r in tight.collect()} == _fold(rows, 0.8, 2, evicted)
    assert {(r.ns, r.seq): r.evicted for r in tight.filter("evicted IS NOT NULL").collect()} == evicted and evicted


def test_copies_settle_in_one_round(spark):
    rows = [("n", i, f"same words here again {'x' * (i % 2)}", "a") for i in range(40)]
    df = spark.createDataFrame(rows, "ns string, seq long, key_text string, response string")
    kinds = Counter(r.kind for r in cache.replay(df, 0.9).collect())
    assert kinds["miss"] == 1


def test_threshold_bounds(spark):
    df = spark.createDataFrame([("n", 1, "a", "b")], "ns string, seq long, key_text string, response string")
    for bad in (0.0, 1.1):
        with pytest.raises(ValueError):
            cache.replay(df, bad)


def test_stats_and_report_equal_sums_over_the_walk(spark):
    rows = _rows(4, 60, 4)
    df = spark.createDataFrame(rows, "ns string, seq long, key_text string, response string")
    df = df.selectExpr("*", "'cold' AS request_kind", "0.5D AS call_cost")
    walked = _fold(rows, 0.8)
    runs = cache.replay(df, 0.8)
    stored = df.selectExpr("ns", "seq AS entry_id", "key_text AS entry_text")
    truth = {(ns, seq): response for ns, seq, _, response in rows}
    for r in cache.stats(runs.join(stored, ["ns", "entry_id"], "left"), ["ns"]).collect():
        mine = {k: v for k, v in walked.items() if k[0] == r.ns}
        kinds = Counter(v[0] for v in mine.values())
        assert (r.lookups, r.misses, r.stores, r.evictions) == (len(mine), kinds["miss"], kinds["miss"], 0)
        assert (r.exact_hits, r.near_hits) == (kinds["exact"], kinds["near"])
        assert r.output_tokens_saved == sum(len(v[2]) // 4 for v in mine.values() if v[2])
    for r in cache.sweep(df, [1.0, 0.8], {"ns": F.col("ns")}).transform(lambda d: cache.report(d, ["threshold"])).collect():
        if r.threshold == 0.8:
            wrong = sum(v[2] is not None and v[2] != truth[k] for k, v in walked.items())
            hits = sum(v[0] != "miss" for v in walked.values())
            assert (r.hits, r.false_hits, r.no_cache_cost_usd, r.cost_saved_usd) == (hits, wrong, 30.0, 0.5 * hits)


def test_lookup_equals_all_pairs(spark):
    rows = _rows(11, 80, 6)
    entries, asked = rows[:40], rows[40:]
    e = spark.createDataFrame([("n", s, k, r, s) for _, s, k, r in entries], "ns string, entry_id long, key_text string, response string, last_touch_seq long")
    q = spark.createDataFrame([("n", s, k) for _, s, k, _ in asked], "ns string, request_id long, key_text string")
    got = {r.request_id: r for r in cache.lookup(q, e, 0.9).collect()}
    assert len(got) == len(asked)
    for _, seq, key, _ in asked:
        equal = [s for _, s, k, _ in entries if k == key]
        sims = sorted(((-_cos(_vec(key), _vec(k)), s) for _, s, k, _ in entries))
        r, best = got[seq], -sims[0][0]
        assert r.similarity == pytest.approx(1.0 if equal else best)
        assert r.entry_id == (equal[0] if equal else None if best < 0.9 else min(s for x, s in sims if abs(x + best) < 1e-12))


def test_small_blocks_change_nothing(spark, monkeypatch):
    from convspark.operators import similarity

    monkeypatch.setattr(similarity, "BLOCK", 7)
    monkeypatch.setattr(similarity, "WALK", 5)
    test_replay_equals_sequential_walk(spark, 3, 0.8)
    test_lookup_equals_all_pairs(spark)


def test_a_chain_of_similar_prompts_takes_no_round_per_link(spark, monkeypatch):
    from convspark.operators import similarity

    tables = []
    for module in (cache, similarity):
        cut = module.cut_lineage
        monkeypatch.setattr(module, "cut_lineage", lambda df, cut=cut: tables.append(df) or cut(df))
    texts = [f"w{i} w{i + 1} w{i + 2} w{i + 3}" for i in range(24)]  # each like the one before it, 24 links
    rows = [("n", i, t, "r") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "ns string, seq long, key_text string, response string")
    got = {(r.ns, r.seq): r.kind for r in cache.replay(df, 0.7, miss_similarity=False).collect()}
    assert got == {k: v[0] for k, v in _fold(rows, 0.7).items()} and len(tables) < 25


def test_prompts_of_one_possible_entry_take_no_part_in_ties(spark, monkeypatch):
    """Their requests are settled with the key: only those of prompts between several entries are looked at one by one."""
    plain, near = "alpha beta gamma delta", "alpha beta gamma delta epsilon"
    rows = [("a", i, plain if i % 2 else near, f"r{i}") for i in range(1, 60)]
    rows += [("b", 1, "one two", "x"), ("b", 2, "three four", "y"), ("b", 3, "one three", "z"), ("b", 4, "one three", "w")]
    seen, least_recent = [], cache._least_recent
    monkeypatch.setattr(cache, "_least_recent", lambda tied, *rest: seen.append(tied.select("ns", "seq").distinct().collect()) or least_recent(tied, *rest))
    got = {}
    df = spark.createDataFrame(rows, "ns string, seq long, key_text string, response string")
    for r in cache.replay(df, 0.45).collect():
        got[r.ns, r.seq] = (r.kind, r.entry_id, r.answer)
    assert sorted((r.ns, r.seq) for r in seen[0]) == [("b", 3), ("b", 4)]
    assert got == {k: v[:3] for k, v in _fold(rows, 0.45).items()}


def test_leaders_across_blocks_of_rows(spark, monkeypatch):
    """Rows are compared with those behind them only, block by block; copies lie in other blocks than their leaders."""
    from convspark.operators import similarity

    monkeypatch.setattr(similarity, "_ROWS", 3)
    rows = [("n", *row[1:]) for row in _rows(11, 60, 5) if row[2] != "!"]
    bags = cache.bags(spark.createDataFrame([(r[1], r[2]) for r in rows], "key_id long, key_text string"), ["key_id"], "key_text")
    table = bags.select(F.lit("n").alias("ns"), F.col("key_id"), F.lit(0.8).alias("threshold"), "bag", "sq").toArrow()
    space = similarity._spaces(table, ["key_id"])[1]["n"]
    texts, stored = {r[1]: r[2] for r in rows}, []
    for key in sorted(texts):
        if not any(_cos(_vec(texts[key]), _vec(texts[other])) >= 0.8 for other in stored):
            stored.append(key)
    assert [int(space.columns["key_id"][i]) for i in similarity._leaders(space)] == stored


def _tied_log(n, exact=5):
    """Two entries that every later prompt is as similar to: each request depends on the choice of the one before."""
    rows = [("a", 0, "red blue", "r0"), ("a", 1, "red green", "r1")]
    return rows + [("a", i, "red" if i % exact else "red blue", f"r{i}") for i in range(2, n)]


@pytest.mark.parametrize("walk_rows", [0, cache.TIE_ROWS])
def test_chains_of_ties_walked_and_in_rounds_agree(spark, monkeypatch, walk_rows):
    monkeypatch.setattr(cache, "TIE_ROWS", walk_rows)
    rows = _tied_log(14)
    got = {r.seq: r.entry_id for r in cache.replay(spark.createDataFrame(rows, "ns string, seq long, key_text string, response string"), 0.6).collect()}
    touched, want = {0: 0, 1: 1}, {0: None, 1: None}
    for _, seq, text, _ in rows[2:]:
        want[seq] = 0 if text == "red blue" else min(touched, key=touched.get)
        touched[want[seq]] = seq
    assert got == want


def test_a_chain_of_ties_takes_no_round_per_request(spark, monkeypatch):
    cuts, cut = [], cache.cut_lineage
    monkeypatch.setattr(cache, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    df = spark.createDataFrame(_tied_log(30, 99), "ns string, seq long, key_text string, response string")
    cache.replay(df, 0.6).collect()
    assert len(cuts) < 20


def test_the_log_of_a_sweep_is_not_repeated_by_threshold(spark, monkeypatch):
    """The joins of the log see a request once for each scope, without texts; answers are joined where they are asked for."""
    seen, joined = [], cache._joined
    monkeypatch.setattr(cache, "_joined", lambda rows, *rest: seen.append(rows.count()) or joined(rows, *rest))
    rows = [(f"t{i % 2}", i, ["what is my rate", "my rate please"][i % 3 > 1], f"answer {i % 4}" if i % 7 else None) for i in range(40)]
    df = spark.createDataFrame(rows, "ns string, seq long, key_text string, response string")
    scopes, thresholds = {"one": F.lit("x"), "own": F.col("ns")}, [1.0, 0.9, 0.8, 0.6]
    whole = cache.sweep(df, thresholds, scopes).collect()
    assert seen == [80] and len(whole) == 320
    told = {seq: response for _, seq, _, response in rows}
    for scope, ns in scopes.items():
        for t in thresholds:
            want = {r.seq: (r.kind, r.entry_id, r.answer) for r in cache.replay(df.withColumn("ns", ns), t).collect()}
            got = {r.seq: r for r in whole if (r.scope, r.threshold) == (scope, t)}
            assert {k: (r.kind, r.entry_id, r.answer) for k, r in got.items()} == want
            for r in got.values():
                both = told.get(r.entry_id) is not None and r.response is not None
                assert r.wrong == (told[r.entry_id] != r.response if both else None)
    slim = cache.sweep(df, thresholds, scopes, answers=False)
    assert "answer" not in slim.columns
    assert sorted((r.scope, r.threshold, r.seq, r.kind, str(r.wrong)) for r in slim.collect()) == sorted(
        (r.scope, r.threshold, r.seq, r.kind, str(r.wrong)) for r in whole
    )
