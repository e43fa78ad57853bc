import random

import numpy as np
from pyspark.sql import functions as F

from convspark.llm import substring_dedup as S
from tests.llm.fixtures import documents, frame, words


def plain(rows):
    """Kept words of each distinct (doc_id, text); rows in the operator's order."""
    keyed = {(i, t) for i, t, *_ in rows}
    order = sorted(keyed, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    seen, out = set(), {}
    for i, t in order:
        w = (t or "").encode().split()
        cover = [False] * len(w)
        for at in range(len(w) - 19):
            gram = tuple(w[at : at + 20])
            if gram in seen:
                cover[at : at + 20] = [True] * 20
            seen.add(gram)
        out[i, t] = (len(w), sum(cover), b" ".join(x for x, c in zip(w, cover) if not c).decode())
    return out


def check(spark, rows):
    got = S.deduplicate(frame(spark, rows)).collect()
    want = plain(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept) == want[r.doc_id, r.text], (r.doc_id, (r.text or "")[:80])


def test_equals_plain_version_on_copies_and_passages(spark):
    check(spark, documents(size=40))


def test_equals_plain_version_where_words_are_few(spark):
    # few different words: seeds repeat by chance, in other places than the windows do
    rng = random.Random(5)
    rows = [(i, words(rng, rng.randrange(15, 200), 2), "en", "s", 1) for i in range(40)]
    rows += [(100 + i, " ".join(["a b a a"] * rng.randrange(1, 30)), "en", "s", 1) for i in range(10)]
    check(spark, rows)


def test_equals_plain_version_on_spliced_texts(spark):
    # windows across a factor's end that occur elsewhere, not at the first place of their seed
    rng = random.Random(9)
    parts = [words(rng, 15, 1000) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(parts) for _ in range(rng.randrange(2, 9))), "en", "s", 1) for i in range(60)]
    check(spark, rows)


def test_seeds_depend_on_the_window_alone():
    rng = random.Random(2)
    text = words(rng, 300, 3).encode().split()
    hashes, places = S.seeds_of(text)
    chosen = set(places.tolist())
    runs = S._runs(S._hashes(text), S.SEED_WORDS)
    assert (runs[places] == hashes).all()
    for start in range(len(text) - 19):
        inside = runs[start : start + S._PLACES]
        assert {start + i for i in np.flatnonzero(inside == inside.min())} <= chosen


def test_empty_table_and_clashing_columns(spark):
    assert S.deduplicate(frame(spark, [])).count() == 0
    clash = frame(spark, documents(size=5)).withColumn("kept", F.lit(1)).withColumn("spans", F.lit(2))
    out = S.deduplicate(clash)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "spans", "n_words", "n_removed", "kept"]
    assert {r.spans for r in out.collect()} == {2}
