import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from convspark.llm import components, simhash
from tests.llm.fixtures import documents, frame


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_components(values: list[int], bits: int) -> dict[int, int]:
    """Value to smallest value that chains of links reach; unsigned in, unsigned out."""
    left, out = set(values), {}
    while left:
        group, todo = set(), [min(left)]
        while todo:
            v = todo.pop()
            group.add(v)
            left.discard(v)
            todo += [x for x in left if (x ^ v).bit_count() <= bits and x not in group and x not in todo]
        out |= {v: min(group) for v in group}
    return out


def test_fingerprints_equal_plain_count():
    for _, text, *_ in documents():
        if len(text or "") < 5000:
            assert simhash.fingerprint(text.encode() if text else None) & (1 << 64) - 1 == plain_fingerprint(text)


def test_long_text_is_counted_in_parts(monkeypatch):
    text = documents()[-9][1] or "x y z"
    whole = simhash.fingerprint(text.encode())
    monkeypatch.setattr(simhash, "_PART", 255 * 2)
    assert simhash.fingerprint(text.encode()) == whole


@pytest.mark.parametrize("cell", [2, 8, 512])
def test_links_give_the_components_of_all_pairs(spark, cell):
    rng = np.random.default_rng(3)
    values = set()
    for centre in rng.integers(0, 2**63, 6):
        for _ in range(40):
            v = int(centre)
            for b in rng.integers(0, 64, rng.integers(0, 5)):
                v ^= 1 << int(b)
            values.add(v)
    want = plain_components(sorted(values), 4)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    fps = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    found = {r.node: r.root for r in components.roots(simhash.links(fps, cell=cell)).collect()}
    groups = lambda m: sorted(sorted(k for k in m if m[k] == r) for r in set(m.values()))
    got = {v: found.get(signed(v), signed(v)) for v in values}
    assert groups(got) == groups(want)


def test_near_duplicates_equal_plain_version(spark):
    rows = documents()
    got = simhash.near_duplicates(frame(spark, rows).select("doc_id", "text")).collect()
    prints = {plain_fingerprint(r[1]) for r in rows}
    group = plain_components(sorted(prints), 4)
    first = {}
    for i, text, *_ in rows:
        root = group[plain_fingerprint(text)]
        if i is not None:
            first[root] = min(i, first.get(root, i))
    key = lambda t: tuple((x is None, x) for x in t)
    want = [(i, plain_fingerprint(t), first.get(group[plain_fingerprint(t)])) for i, t, *_ in rows]
    assert sorted(((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got), key=key) == sorted(want, key=key)


def test_one_row_of_each_group_stays(spark):
    rows = documents()
    docs = frame(spark, rows).withColumn("_tie_", F.lit(1))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    group = plain_components(sorted({plain_fingerprint(r[1]) for r in rows}), 4)
    assert kept.count() == len(set(group.values()))
    assert {r.doc_id for r in kept.collect() if r.doc_id is not None} <= {r[0] for r in rows}


def test_rows_without_an_id_are_groups_too(spark):
    rows = [(None, "one lonely text without a number", "en", "s", 1)] * 2 + [(None, "another quite different lonely text", "en", "s", 1)]
    kept = simhash.keep_one(frame(spark, rows))
    assert sorted(r.text for r in kept.collect()) == sorted({r[1] for r in rows})
    assert {r.component_id for r in simhash.near_duplicates(frame(spark, rows)).collect()} == {None}


def test_empty_table(spark):
    docs = frame(spark, [])
    assert simhash.near_duplicates(docs.select("doc_id", "text")).count() == 0
    assert simhash.keep_one(docs).count() == 0
