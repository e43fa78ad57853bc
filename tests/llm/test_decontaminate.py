import random
import re
import weakref

import numpy as np

from convspark.llm import decontaminate as D
from convspark.llm.fm_index import FMIndex, suffix_array
from tests.llm.fixtures import documents, frame, words

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_words(text):
    return WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def plain_search(text, items):
    w, hit, have = plain_words(text), set(), set()
    for item, body in items:
        b = plain_words(body)
        grams = [b[i : i + 10] for i in range(max(1, len(b) - 9))] if b else []
        for g in grams:
            for i in range(len(w) - len(g) + 1):
                if w[i : i + len(g)] == g:
                    hit |= set(range(i, i + len(g)))
                    have.add("" if item is None else str(item))
    return len(w), len(hit), sorted(have)


def test_index_finds_what_a_scan_finds():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n, k = int(rng.integers(1, 200)), int(rng.integers(1, 5))
        s = rng.integers(0, k + 1, n + 1)
        s[-1] = 0
        rank = s + (s == 0).sum()
        rank[s == 0] = np.arange((s == 0).sum())
        assert list(suffix_array(s)) == sorted(range(len(s)), key=lambda i: tuple(rank[i:]))
        index = FMIndex(s, k, sample=4)
        phrases, lengths = rng.integers(1, k + 1, (30, 4)).astype(np.int32), rng.integers(1, 5, 30)
        low, high = index.search(phrases, lengths)
        for p, m, a, b in zip(phrases, lengths, low, high):
            want = [j for j in range(len(s)) if list(s[j : j + m]) == list(p[:m])]
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want


def cases():
    rng = random.Random(7)
    docs = documents(size=15)
    items = [(1, words(rng, 25)), (2, "Three Short WORDS"), (3, ""), (4, None), (None, words(rng, 14)), (1, words(rng, 11)), (12, "É日本語 ß")]
    long, other = items[0][1].split(), items[4][1].split()
    docs += [
        (900, f"x y {' '.join(long[3:18])} z three, short! Words", "en", "s", 1),
        (901, " ".join(long) + "\n" + " ".join(other), "en", "s", 1),
        (902, "three short é日本語 ß", "en", "s", 1),
        (903, " ".join(long[:9]), "en", "s", 1),
        (904, items[0][1].upper(), "en", "s", 1),
    ]
    return docs, items


def test_search_equals_plain_scan(spark):
    docs, items = cases()
    table = frame(spark, items, "item_id long, text string")
    for block in (D.BLOCK, 3):
        got = D.search(frame(spark, docs), table, block=block).select("doc_id", "text", "found").collect()
        assert len(got) == len(docs)
        for r in got:
            assert (r.found.n_words, r.found.n_hit, r.found["items"]) == plain_search(r.text, items)
            assert sum(s.end - s.start for s in r.found.spans) == r.found.n_hit


def test_small_shards_find_the_same(spark, monkeypatch):
    docs, items = cases()
    texts = [D.words_of((t or "").encode()) for _, t, *_ in docs]
    found = {}
    for i, b in items:
        for p in D.phrases_of((b or "").encode()):
            found.setdefault(p, []).append(str(i))
    block = D.Block([{"phrase": p, "items": i} for p, i in found.items()])
    whole = D.search_shard(texts, [block])
    assert whole == [x for t in texts for x in D.search_shard([t], [block])]


def test_one_block_is_resident(tmp_path):
    alive = weakref.WeakSet()

    class Sent:
        """A block that lies in a file, as a broadcast in a Python worker does."""

        def __init__(self, number):
            self._path = f"block {number}"
            self.number = number

        @property
        def value(self):
            if not hasattr(self, "_value"):
                assert len(alive) == 0
                self._value = D.Block([{"phrase": f"a{self.number} b", "items": [str(self.number)]}])
                alive.add(self._value)
            return self._value

    sent = [Sent(i) for i in range(5)]
    for _ in range(2):
        found = D.search_shard([b"a3 b a1 b x a4".split(), b"a0 b".split()], D._in_turn(sent))
        assert [f["items"] for f in found] == [["1", "3"], ["0"]]
    single = [Sent(7)]
    list(D._in_turn(single))
    assert single[0].value is next(D._in_turn(single))  # a single block is read once


def test_many_blocks(spark):
    rng = random.Random(3)
    items = [(i, words(rng, 12, 5000)) for i in range(200)]
    docs = [(i, f"{words(rng, 30)} {items[i * 9][1]} {words(rng, 5)}", "en", "s", 1) for i in range(20)]
    got = D.search(frame(spark, docs), frame(spark, items, "item_id long, text string"), block=50).collect()
    assert {r.doc_id: r.found["items"] for r in got} == {i: [str(i * 9)] for i in range(20)}


def test_removal_cuts_the_spans(spark):
    docs, items = cases()
    out = {r.doc_id: r for r in D.decontaminate(frame(spark, docs), frame(spark, items, "item_id long, text string")).collect()}
    assert out[900].text == "x y  z " + "!"[:0] + ""
    assert out[900].n_chars == len(out[900].text)
    assert 901 not in out and 904 not in out  # nothing is left of them
    assert out[903].text == dict((d[0], d[1]) for d in docs)[903]
    assert sum(plain_search(r.text, items)[1] for r in out.values()) == 0


def test_empty_tables_and_clashing_columns(spark):
    docs, items = cases()
    none = frame(spark, [], "item_id long, text string")
    assert D.search(frame(spark, []), none).count() == 0
    clash = frame(spark, docs[:3]).selectExpr("*", "1 as found", "2 as items")
    seen = D.search(clash, none)
    assert seen.columns == [*clash.columns[:5], "items", "found"]
    assert [r.found.n_hit for r in seen.collect()] == [0, 0, 0]
