"""Whole jobs: the five-event journey, stream = batch, tenant isolation, and the registry."""

import random

from pyspark.sql import functions as F

from convspark.operators import decisions as DC, identity as I, proposals as PR
from convspark.plans import prepare
from convspark.queries import identity_queries as IQ, registry
from convspark.sources import readers, sinks
from tests import folds

SF = "/root/testdata/sf0.001"


def test_registry_names_and_sql():
    queries, oracle = registry.queries(), registry.oracle_sql()
    assert set(oracle) <= set(queries)
    assert len(queries) > 140


def test_five_event_journey(spark):
    rows = [
        (1, "jane-evt-001", "chat", "message_received", '{"external_id":"jane.doe.001","from_email":"jane.doe@example.com"}'),
        (2, "jane-evt-002", "email", "document_uploaded", '{"external_id":"jane.doe.001","from_email":"Jane.Doe@example.com"}'),
        (3, "jane-evt-003", "sms", "message_received", '{"external_id":"jane.doe.001","from_phone":"+1 555 010 0123"}'),
        (4, "jane-evt-004", "api", "status_changed", '{"external_id":"jane.doe.001"}'),
        (5, "jane-evt-005", "api", "anomaly_detected", '{"external_id":"jane.doe.001"}'),
        (6, "jane-evt-001", "chat", "message_received", '{"external_id":"somebody.else"}'),
    ]
    e = spark.createDataFrame(rows, "event_id long, idempotency_key string, channel_code string, event_type string, payload string")
    e = e.withColumn("tenant_id", F.lit("acme-bank")).withColumn("received_at", F.timestamp_seconds("event_id"))
    linked = I.resolve(e.withColumn("customer_id", F.lit(None).cast("string")).withColumn("hints", I.hints(F.col("payload"))))
    got = {r.event_id: r for r in linked.collect()}
    assert len({got[i].customer_id for i in range(1, 7)}) == 1
    assert [got[i].outcome for i in range(1, 7)] == ["created", "linked", "linked", "linked", "linked", "replay"]
    events = sinks.new_events(e, None, ["received_at", "event_id"]).withColumn("customer_id", F.lit("c"))
    rules = spark.createDataFrame(
        [("acme-bank", "send_borrower_message", "approval_required"), ("acme-bank", "*", "auto")],
        "tenant_id string, key string, decision string",
    )
    quorum = spark.createDataFrame([], "tenant_id string, action_type string, required_approvals int, eligible_approvers array<string>")
    actions = DC.apply_decision(DC.decide(DC.materialize(PR.propose(events)), rules), quorum)
    status = [(r.action_type, r.status) for r in actions.orderBy("event_id").collect()]
    assert status == [
        ("send_borrower_message", "pending_approval"),
        ("update_status", "executed"),
        ("send_borrower_message", "pending_approval"),
        ("notify_loan_officer", "executed"),
        ("notify_loan_officer", "executed"),
    ]


def _hinted(spark):
    e = IQ.hinted_events(spark, SF).withColumn("customer_id", F.lit(None).cast("string"))
    return e.select("tenant_id", "event_id", "received_at", "idempotency_key", "customer_id", "hints")


def test_resolution_of_given_events_and_stream(spark):
    rows = _hinted(spark)
    ordered = rows.orderBy("received_at", "event_id").collect()
    expect = folds.link(
        [(r.tenant_id, r.event_id, r.idempotency_key, None, [(h.kind, h.value) for h in r.hints]) for r in ordered]
    )
    batch = {r.event_id: r for r in registry.queries()["resolved_customers"](spark, SF).collect()}
    assert {k: v.outcome for k, v in batch.items()} == {k: v[0] for k, v in expect.items()}
    names = {}
    for eid, (outcome, customer, _) in expect.items():
        if outcome in ("created", "linked"):
            assert names.setdefault(customer, batch[eid].customer_id) == batch[eid].customer_id
    streamed = {r.event_id: r for r in registry.queries()["stream_linked_customers"](spark, SF).collect()}
    assert {k: v.outcome for k, v in streamed.items()} == {k: v[0] for k, v in expect.items()}
    for eid, r in streamed.items():
        if r.outcome != "replay":
            assert r.customer_id == batch[eid].customer_id


def test_tenant_isolation(spark):
    from convspark.operators import policy as P
    from convspark.queries.ingest_queries import scenarios
    from convspark.sources import tables as T

    s, rules = scenarios(spark, SF), T.policy_rules(spark)
    full = P.declarative(s, rules).filter("tenant_id = 't1'")
    alone = P.declarative(s.filter("tenant_id = 't1'"), rules.filter("tenant_id = 't1'"))
    cols = ["scenario_id", "decision"]
    assert full.select(cols).exceptAll(alone.select(cols)).isEmpty() and alone.select(cols).exceptAll(full.select(cols)).isEmpty()


def test_orphan_pair_fails(spark):
    import pytest

    pairs = spark.createDataFrame([("p1", "c1"), ("p2", "gone")], "pair_id string, customer_id string")
    known = spark.createDataFrame([("c1",), ("c1",)], "customer_id string")
    with pytest.raises(Exception, match="without history"):
        readers.guard_orphans(pairs, known).collect()


def test_lost_audit_entries_are_reported(spark):
    old = spark.createDataFrame([("t", 1), ("t", 2)], "tenant_id string, id long")
    assert sinks.lost_entries(old, old.filter("id = 1")).count() == 1
    assert sinks.lost_entries(old, old.union(old)).isEmpty()


def test_padding_equals_a_walk_over_the_pool(spark):
    rng = random.Random(5)
    pool = [(i, f"d{i}", rng.choice([0, 1, 1, 2, 5])) for i in range(1, 9000)]
    starts = {3: "a", 4: "b", 4095: "c", 4097: "d", 8995: "e"}
    want, pair = set(), None
    for at, name, n in pool:
        if at in starts:
            pair, back, total = starts[at], 0, 0
        if pair and (back == 0 or total < 7):
            want.add((pair, name, back, n, n if back == 0 else max(0, min(n, 8 - total))))
        if pair:
            back, total = back + 1, total + n
    dialogues = spark.createDataFrame(pool, "pool_pos long, conv_id string, n_messages int")
    first = spark.createDataFrame([(v, k) for k, v in starts.items()], "pair_id string, pool_pos long")
    got = prepare.pad_histories(dialogues, first, 7, 8).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_all_strategies_share_one_reading_of_the_tables(spark):
    from convspark.queries.retrieval_queries import run_all

    briefs, _ = run_all(spark, "/root/testdata/sf0.001")
    plan = briefs._jdf.queryExecution().toString()
    assert "FileScan" not in plan and plan.split("== Physical Plan ==")[1].count("bag_cosine") == 1  # of hybrid's middle tier


def test_views_read_actions_and_votes_that_were_computed_once(spark):
    from convspark.queries import policy_queries as PQ

    folder = "/root/testdata/sf0.001"
    view = PQ.QUERIES["action_views"](spark, folder)
    assert not [f for f in view.inputFiles() if f.endswith("events.parquet")]
    assert view.count() == spark.read.parquet(f"{folder}/events.parquet").count()
