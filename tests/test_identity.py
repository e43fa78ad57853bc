import random

import pytest
from pyspark.sql import functions as F

from convspark.operators import identity as I
from tests import folds


def _events(spark, rows):
    data = [(t, e, e, k, x, [{"kind": a, "value": b} for a, b in h]) for t, e, k, x, h in rows]
    schema = (
        "tenant_id string, event_id long, n long, idempotency_key string, customer_id string, "
        "hints array<struct<kind:string,value:string>>"
    )
    df = spark.createDataFrame(data, schema)
    return df.withColumn("received_at", F.timestamp_seconds("n")).drop("n")


def _random_rows(rng, n):
    rows = []
    for e in range(n):
        hints = []
        for kind, values in (("external_id", 6), ("email", 5), ("phone", 5), ("chat_handle", 4)):
            if rng.random() < 0.45:
                hints.append((kind, f"{kind[0]}{rng.randrange(values)}"))
                if kind == "email" and rng.random() < 0.3:
                    other = (kind, f"e{rng.randrange(values)}")
                    if other not in hints:
                        hints.append(other)
        explicit = f"x{rng.randrange(3)}" if rng.random() < 0.1 else None
        rows.append((f"t{rng.randrange(2)}", e, f"k{rng.randrange(n)}", explicit, hints))
    return rows


def _check(spark, rows, identities=()):
    expect = folds.link(rows, identities)
    known = None
    if identities:
        known = spark.createDataFrame(list(identities), "tenant_id string, kind string, value string, customer_id string")
    got = {r.event_id: r for r in I.resolve(_events(spark, rows), known).collect()}
    assert set(got) == set(expect)
    names = {}
    for eid, (outcome, customer, added) in sorted(expect.items()):
        r = got[eid]
        assert r.outcome == outcome, (eid, r, expect[eid])
        assert [(h.kind, h.value) for h in r.added or []] == added, (eid, r, expect[eid])
        if customer is None:
            assert r.customer_id is None
        else:  # new ids differ in spelling only
            assert names.setdefault(customer, r.customer_id) == r.customer_id, (eid, r)
    assert len(set(names.values())) == len(names)


@pytest.mark.parametrize("seed", [1, 2])
def test_resolution_equals_sequential_walk(spark, seed):
    rng = random.Random(seed)
    _check(spark, _random_rows(rng, 120))


def test_resolution_with_known_identities(spark):
    rng = random.Random(9)
    known = [("t0", "external_id", "e1", "old1"), ("t0", "email", "e0", "old2"), ("t1", "phone", "p0", "old3")]
    _check(spark, _random_rows(rng, 100), known)


def test_chain_of_shared_hints(spark):
    rows = [("t0", i, f"k{i}", None, [("email", f"m{i}"), ("phone", f"m{i + 1}")] if i % 2 else
             [("email", f"m{i + 1}"), ("phone", f"m{i}")]) for i in range(20)]
    _check(spark, rows)


def test_collision_keeps_earlier_hints_and_frees_key(spark):
    rows = [
        ("t0", 0, "a", None, [("email", "a@x.com")]),
        ("t0", 1, "b", None, [("email", "b@x.com")]),
        ("t0", 2, "c", None, [("external_id", "n1"), ("email", "a@x.com"), ("email", "b@x.com")]),
        ("t0", 3, "c", None, [("external_id", "n1")]),
        ("t0", 4, "c", None, [("email", "b@x.com")]),
    ]
    _check(spark, rows)
    got = {r.event_id: r.outcome for r in I.resolve(_events(spark, rows)).collect()}
    assert got == {0: "created", 1: "created", 2: "collision", 3: "linked", 4: "replay"}


def test_normalisation(spark):
    cases = [
        ("phone", "+1 (555) 010-0100", "+15550100100"),
        ("phone", " 555+010 ", "555+010"),
        ("phone", "++1+5", "+1+5"),
        ("phone", "+١٢-3", "+١٢3"),
        ("email", " Jane@X.com\t", "jane@x.com"),
        ("external_id", " AbC ", "AbC"),
        ("chat_handle", "JaneD", "janed"),
        ("email", "   ", ""),
    ]
    df = spark.createDataFrame(cases, "kind string, raw string, want string")
    for r in df.select("*", I.normalize(F.col("kind"), F.col("raw")).alias("got")).collect():
        assert r.got == r.want, r


def test_hints_order_and_types(spark):
    payload = '{"username":"Zed","from_phone":" +1 2","email":"B@x.com","from_email":"b@X.com","external_id":7,"customer_external_id":"E9"}'
    df = spark.createDataFrame([(payload,)], "p string")
    got = df.select(I.hints(F.col("p")).alias("h")).first().h
    assert [(h.kind, h.value) for h in got] == [
        ("external_id", "E9"), ("email", "b@x.com"), ("phone", "+12"), ("chat_handle", "zed"),
    ]


@pytest.mark.parametrize("walk_rows", [0, 6, I.WALK_ROWS])
def test_customers_are_created_in_order(spark, walk_rows):
    rng = random.Random(4)
    stored = {("t", "email", "m0")}
    rows, expect = [], {}
    for i in range(40):
        ids = [("email", f"m{rng.randrange(12)}")] + ([("phone", f"p{rng.randrange(12)}")] if rng.random() < 0.6 else [])
        rows.append(("t", f"c{i:02d}", i, [{"kind": k, "value": v} for k, v in ids]))
        keys = {("t", k, v) for k, v in ids}
        expect[f"c{i:02d}"] = not keys & stored
        if expect[f"c{i:02d}"]:
            stored |= keys
    requests = spark.createDataFrame(
        rows, "tenant_id string, customer_id string, created_at long, identities array<struct<kind:string,value:string>>"
    )
    known = spark.createDataFrame([("t", "email", "m0", "old")], "tenant_id string, kind string, value string, customer_id string")
    inserted, refused = I.create_customers(requests, known, walk_rows)
    assert {r.customer_id for r in inserted.collect()} == {c for c, ok in expect.items() if ok}
    assert {r.customer_id for r in refused.collect()} == {c for c, ok in expect.items() if not ok}


def test_chain_of_a_thousand_requests_takes_one_walk(spark, monkeypatch):
    rounds = []
    step = I._earliest
    monkeypatch.setattr(I, "_earliest", lambda open_: rounds.append(1) or step(open_))
    # every request shares an identity with the one before it: each is accepted or refused only after that one
    chain = spark.range(1000).select(
        F.lit("t").alias("tenant_id"),
        F.format_string("c%04d", "id").alias("customer_id"),
        F.col("id").alias("created_at"),
        F.transform(
            F.array(F.col("id"), F.col("id") + 1),
            lambda n: F.struct(F.lit("email").alias("kind"), n.cast("string").alias("value")),
        ).alias("identities"),
    )
    inserted, refused = I.create_customers(chain, None)
    assert {r.customer_id for r in inserted.collect()} == {f"c{i:04d}" for i in range(0, 1000, 2)}
    assert {r.customer_id for r in refused.collect()} == {f"c{i:04d}" for i in range(1, 1000, 2)}
    assert len(rounds) == 1


def test_requests_without_a_usable_identity_end(spark):
    rows = [("t", "a", 1, [(None, "x"), ("email", None)]), ("t", "b", 2, []), ("t", "c", 3, None), ("t", "d", 4, [("email", "m")])]
    requests = spark.createDataFrame(
        rows, "tenant_id string, customer_id string, created_at long, identities array<struct<kind:string,value:string>>"
    )
    inserted, refused = I.create_customers(requests, None)
    assert [(r.customer_id, r.kind, r.value) for r in inserted.collect()] == [("d", "email", "m")]
    assert refused.count() == 0


def test_events_without_hints_take_no_part_in_the_rounds(spark, monkeypatch):
    import datetime

    seen, whole = [], I._round
    monkeypatch.setattr(I, "_round", lambda base, *rest: seen.append(base.count()) or whole(base, *rest))
    hint, at = [("email", "a@x")], lambda i: datetime.datetime(2024, 1, 1, 0, i)
    rows = [("t", 1, at(1), "k1", None, []), ("t", 2, at(2), "k1", None, hint), ("t", 3, at(3), "k2", None, hint), ("t", 4, at(4), "k2", None, None)]
    schema = "tenant_id string, event_id long, received_at timestamp, idempotency_key string, customer_id string, hints array<struct<kind:string,value:string>>"
    got = {r.event_id: (r.outcome, r.replay_of) for r in I.resolve(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: ("created", None), 2: ("replay", 1), 3: ("created", None), 4: ("replay", 3)}
    assert set(seen) == {1}


@pytest.mark.parametrize("walk_rows", [0, 150, I.CORE_ROWS])
def test_cores_walked_and_settled_in_rounds_agree(spark, walk_rows):
    rng = random.Random(4)
    rows = [(f"t{rng.randrange(3) // 2}", *r[1:]) for r in _random_rows(rng, 150)]
    rows = [(t, e, None if e % 9 == 0 else k, x, h) for t, e, k, x, h in rows]
    known = [("t0", "external_id", "e1", "old1"), ("t1", "phone", "p0", "old3")]
    expect = folds.link([(t, e, k or f"none-{e}", x, h) for t, e, k, x, h in rows], known)
    table = spark.createDataFrame(known, "tenant_id string, kind string, value string, customer_id string")
    got = {r.event_id: r for r in I.resolve(_events(spark, rows), table, walk_rows=walk_rows).collect()}
    assert {e: (r.outcome, [(h.kind, h.value) for h in r.added or []]) for e, r in got.items()} == {
        e: (outcome, added) for e, (outcome, _, added) in expect.items()
    }
    pairs = {(customer, got[e].customer_id) for e, (_, customer, _) in expect.items()}
    assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_dependent_collisions_take_no_round_each(spark, monkeypatch):
    """Every collision frees a key, whose next event claims what the next collision depends on."""
    seen, whole = [], I._round
    monkeypatch.setattr(I, "_round", lambda *args: seen.append(1) or whole(*args))
    rows = [("t", 0, "a", None, [("email", "m0")])]
    for i in range(12):
        e = 3 * i + 1
        rows += [
            ("t", e, f"b{i}", None, [("phone", f"p{i}")]),
            ("t", e + 1, f"k{i}", None, [("phone", f"p{i}"), ("email", f"m{i}")]),
            ("t", e + 2, f"k{i}", None, [("email", f"m{i + 1}")]),
        ]
    _check(spark, rows)
    assert len(seen) == 1


def test_settled_identities_leave_the_core(spark, monkeypatch):
    """Only the events that may claim an identity, and those ahead of them in their keys, decide who owns what."""
    cores, settled = [], I._settled
    monkeypatch.setattr(I, "_settled", lambda core, *rest: cores.append(core) or settled(core, *rest))
    rows = [("t", i, f"k{i // 2}", None, [("email", f"m{i % 3}"), ("phone", f"p{i % 3}")]) for i in range(60)]
    _check(spark, rows)
    assert {r.event_id for r in cores[0].collect()} == {0, 1, 2, 4}
