"""Keyed state across micro-batches and restarts: against plain walks, and without a look at earlier batches."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from convspark.operators import identity as I
from convspark.sources import sinks
from convspark.streaming import decide as SD, ingest as SI
from convspark.streaming.state import BatchTable, KeyTable, run_available

T0 = datetime(2024, 1, 1)


def at(n):
    return T0 + timedelta(seconds=n)


class Feed:
    """Files that arrive one after another; every arrival is a run of its own, so state goes through the checkpoint."""

    def __init__(self, spark, schema, tmp_path):
        self.spark, self.schema, self.path = spark, schema, str(tmp_path)

    def arrive(self, rows, step, handler, mode="append", name="q"):
        self.spark.createDataFrame(rows, self.schema).write.mode("append").parquet(f"{self.path}/in")
        stream = self.spark.readStream.schema(self.schema).parquet(f"{self.path}/in")
        run_available(step(stream), handler, f"{self.path}/checkpoint-{name}", mode)


def no_reads(monkeypatch):
    def read(self, before=None):
        raise AssertionError("an earlier batch was read")

    monkeypatch.setattr(BatchTable, "read", read)


def test_first_wins_across_arrivals(spark, tmp_path, monkeypatch):
    schema = "event_id long, tenant_id string, idempotency_key string, received_at timestamp"
    feed = Feed(spark, schema, tmp_path)
    table = BatchTable(spark, f"{tmp_path}/table", schema)
    seen = []

    def handle(batch, batch_id):
        SI.insert_new(table, lambda new, i: seen.append((i, new.count())))(batch, batch_id)
        seen.append({(r.idempotency_key, r.event_id, r.created, r.arrivals) for r in batch.collect()})

    step = lambda s: SI.first_wins(s, ["received_at", "event_id"])
    reader = BatchTable.read
    no_reads(monkeypatch)
    feed.arrive([(2, "t", "a", at(5)), (1, "t", "a", at(9)), (3, "t", "b", at(1)), (9, "u", "a", at(1))], step, handle, "update")
    feed.arrive([(4, "t", "a", at(0)), (5, "t", "c", at(0)), (6, "t", None, at(0))], step, handle, "update")
    assert seen[0] == (0, 3) and seen[2] == (1, 2)
    assert ("a", 2, True, 2) in seen[1] and ("a", 2, False, 3) in seen[3]  # an earlier time comes too late
    assert sorted(r.event_id for r in reader(table).collect()) == [2, 3, 5, 6, 9]


def test_decisions_stay_as_they_were(spark, tmp_path, monkeypatch):
    schema = "event_id long, tenant_id string, customer_id string, event_type string, received_at timestamp"
    feed = Feed(spark, schema, tmp_path)
    names = {"answers": SD.ANSWER_SCHEMA, "queue": SD.QUEUE_SCHEMA, "audit": SD.AUDIT_SCHEMA, "rejects": SD.REJECT_SCHEMA}
    t = {n: BatchTable(spark, f"{tmp_path}/{n}", s) for n, s in names.items()}
    quorum = spark.createDataFrame([], "tenant_id string, action_type string, required_approvals int, eligible_approvers array<string>")
    rules = lambda d: spark.createDataFrame([("t", "*", d)], "tenant_id string, key string, decision string")
    handler = SD.decide(t["answers"], t["queue"], t["audit"])
    reader = BatchTable.read
    with monkeypatch.context() as m:
        no_reads(m)
        for rows, decision in (
            ([(1, "t", "c", "status_changed", at(0)), (1, "t", "c", "status_changed", at(1)), (None, "t", "c", "x", at(0))], "auto"),
            ([(1, "t", "c", "status_changed", at(5)), (2, "t", "c", "status_changed", at(6)), (3, None, "c", "x", at(0))], "reject"),
        ):
            feed.arrive(rows, lambda s, d=decision: SD.decided(s, rules(d), quorum), handler, "update")
            run_available(SD.rejected(spark.readStream.schema(schema).parquet(f"{tmp_path}/in")), t["rejects"].write, f"{tmp_path}/c2")
    assert BatchTable.read is reader
    actions = {r.event_id: (r.decision, r.status) for r in SD.stored_actions(t["answers"]).collect()}
    assert actions == {1: ("auto", "executed"), 2: ("reject", "rejected")}
    again = sorted((r.event_id, r.decision, r.arrivals) for r in SD.replayed_actions(t["answers"]).collect())
    assert again == [(1, "auto", 2), (1, "auto", 3)]  # the rules have changed, the answer has not
    kinds = sorted((r.event_id, r.step, r.kind) for r in t["audit"].read().collect())
    assert kinds == [(1, 1, "proposal"), (1, 2, "decision"), (1, 3, "execution"), (2, 1, "proposal"), (2, 2, "decision"), (2, 3, "rejection")]
    assert t["rejects"].read().count() == 2


def plain_votes(arrivals, queue):
    state, out = {}, {}
    for rows in arrivals:
        for tenant, action, vote_id, vote, who, _, when in sorted(rows, key=lambda r: (r[6], r[2])):
            rule = queue.get((tenant, action))
            if rule is None:
                out[vote_id] = ("not_found", None)
                continue
            needed, pool = rule
            voters, n, ended = state.setdefault((tenant, action), [[], 0, False])
            allowed = (pool is None or who in pool) and (vote == "reject" or needed <= 1 or who is not None)
            if ended:
                out[vote_id] = ("already_decided", None)
            elif not allowed:
                out[vote_id] = ("not_eligible", None)
            elif vote == "reject":
                out[vote_id] = ("accepted", None)
                state[tenant, action][2] = True
            elif who is not None and who in voters:
                out[vote_id] = ("duplicate", None)
            else:
                state[tenant, action] = [[*voters, who], n + 1, n + 1 >= needed]
                out[vote_id] = ("accepted", n + 1)
    return out


def test_votes_equal_a_plain_walk(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    queue = {("t", f"a{i}"): (1 + i % 4, [None, ["ann", "bob", "cy", "di"]][i % 2]) for i in range(30)}
    arrivals, n = [], 0
    for _ in range(3):
        rows = []
        for _ in range(120):
            n += 1
            action = "a0" if rng.random() < 0.2 else f"a{rng.randrange(33)}"  # some are not there
            who = rng.choice(["ann", "bob", "cy", "di", "eve", None])
            rows.append(("t", action, n, "reject" if rng.random() < 0.08 else "approve", who, None, at(rng.randrange(60))))
        arrivals.append(rows)
    schema = "tenant_id string, action_id string, vote_id long, vote string, decided_by string, reason string, voted_at timestamp"
    table = BatchTable(spark, f"{tmp_path}/votes", SD.VOTE_SCHEMA)
    rules = [(t, a, k, pool) for (t, a), (k, pool) in queue.items()]
    rules = spark.createDataFrame(rules, "tenant_id string, action_id string, required_approvals int, eligible_approvers array<string>")
    feed = Feed(spark, schema, tmp_path)
    with monkeypatch.context() as m:
        no_reads(m)
        for rows in arrivals:
            feed.arrive(rows, lambda s: SD.voted(s, rules), table.write)
    got = {r.vote_id: (r.outcome, r.n_approvals) for r in table.read().collect()}
    assert got == plain_votes(arrivals, queue)


def test_a_batch_reads_the_buckets_of_its_own_keys(spark, tmp_path):
    table = KeyTable(spark, f"{tmp_path}/keys", SI.STORED_SCHEMA, sinks.KEY, buckets=64)
    rows = lambda lo, hi: spark.range(lo, hi).select(
        F.lit("t").alias("tenant_id"), F.col("id").cast("string").alias("idempotency_key"), F.col("id").alias("event_id"), F.lit("c").alias("customer_id")
    )
    read = []
    for batch in range(6):
        mine = rows(1000 * batch, 1000 * batch + 1).unionByName(rows(0, 1))
        found = table.read_for(mine, batch)
        read.append(found.count())
        assert {r.event_id for r in found.filter("idempotency_key = '0'").collect()} == ({0} if batch else set())
        table.write(rows(1000 * batch, 1000 * batch + 640), batch)
    assert table.read_for(rows(0, 1), 0).count() == 0  # nothing of a batch's own attempt
    assert max(read) < 6 * 640 / 64 * 2 * 2 and table.read().count() == 6 * 640


EVENT = "tenant_id string, event_id long, received_at timestamp, idempotency_key string, customer_id string, hints array<struct<kind:string,value:string>>"


def test_replay_in_a_later_batch_names_the_stored_event(spark, tmp_path):
    feed = Feed(spark, EVENT, tmp_path)
    out = BatchTable(spark, f"{tmp_path}/out", SI.OUTCOME_SCHEMA)
    identities = KeyTable(spark, f"{tmp_path}/ids", SI.IDENTITY_SCHEMA, ["tenant_id", "kind", "value"], 8)
    stored = KeyTable(spark, f"{tmp_path}/keys", SI.STORED_SCHEMA, sinks.KEY, 8)
    handler = SI.link(identities, stored, out)
    same = lambda s: s
    feed.arrive([("t", 1, at(1), "k1", None, [("email", "a@x")]), ("t", 2, at(2), "k1", None, [])], same, handler)
    feed.arrive([("t", 3, at(3), "k1", None, [("email", "b@x")]), ("t", 4, at(4), "k2", None, [("email", "a@x")])], same, handler)
    got = {r.event_id: r for r in out.read().collect()}
    assert [got[i].outcome for i in (1, 2, 3, 4)] == ["created", "replay", "replay", "linked"]
    assert got[1].customer_id == got[2].customer_id == got[3].customer_id == got[4].customer_id
    assert (got[2].replay_of, got[3].replay_of) == (1, 1)


def test_unknown_explicit_customers_are_refused(spark):
    rows = [
        ("t", 1, at(1), "k1", "gone", [("email", "a@x")]),  # attaches nothing
        ("t", 2, at(2), "k1", None, [("email", "a@x")]),  # its key stayed free
        ("t", 3, at(3), "k3", "here", [("email", "h@x")]),
        ("t", 4, at(4), "k1", "gone", []),  # a replay stays one
        ("u", 5, at(5), "k5", "here", []),  # a customer of another tenant
        ("t", 6, at(6), "k6", None, [("email", "h@x")]),
    ]
    customers = spark.createDataFrame([("t", "here")], "tenant_id string, customer_id string")
    got = {r.event_id: r for r in I.resolve(spark.createDataFrame(rows, EVENT), customers=customers).collect()}
    assert [got[i].outcome for i in range(1, 7)] == ["unknown_customer", "created", "linked", "replay", "unknown_customer", "linked"]
    assert (got[1].customer_id, got[5].customer_id, got[6].customer_id) == (None, None, "here")
    assert got[1].attached_to is None and not got[1].added and got[4].replay_of == 2
    free = I.resolve(spark.createDataFrame(rows, EVENT)).filter("event_id = 1").first()
    assert (free.outcome, free.customer_id) == ("linked", "gone")


def test_actions_share_a_state(spark, tmp_path):
    """Many actions, two groups: a micro-batch calls Python once a group, and the outcomes are those of a plain walk."""
    queue = {("t", f"a{i}"): (1 + i % 3, None) for i in range(200)}
    rng = random.Random(7)
    vote = lambda n: ("t", f"a{rng.randrange(210)}", n, "approve", rng.choice(["ann", "bob", "cy", None]), None, at(n % 50))
    arrivals = [[vote(n) for n in range(start, start + 500)] for start in (0, 500)]
    schema = "tenant_id string, action_id string, vote_id long, vote string, decided_by string, reason string, voted_at timestamp"
    table = BatchTable(spark, f"{tmp_path}/votes", SD.VOTE_SCHEMA)
    rules = [(t, a, k, pool) for (t, a), (k, pool) in queue.items()]
    rules = spark.createDataFrame(rules, "tenant_id string, action_id string, required_approvals int, eligible_approvers array<string>")
    feed = Feed(spark, schema, tmp_path)
    calls = []
    for rows in arrivals:
        feed.arrive(rows, lambda s: SD.voted(s, rules, groups=2), table.write)
        state = spark.read.format("statestore").load(f"{tmp_path}/checkpoint-q")
        calls.append(state.count())
    assert max(calls) <= 2
    assert {r.vote_id: (r.outcome, r.n_approvals) for r in table.read().collect()} == plain_votes(arrivals, queue)


def test_policies_do_not_gather_a_stream_by_tenant(spark):
    """Policy and quorum rules are broadcast whatever Spark knows of their size, so actions are not shuffled by tenant."""
    rows = [(i, f"t{i % 2}", "c", "message_received", at(i)) for i in range(20)]
    events = spark.createDataFrame(rows, "event_id long, tenant_id string, customer_id string, event_type string, received_at timestamp")
    rules = spark.createDataFrame([("t0", "*", "auto")], "tenant_id string, key string, decision string")
    quorum = "tenant_id string, action_type string, required_approvals int, eligible_approvers array<string>"
    decided = SD.decided(events, rules, spark.createDataFrame([("t1", "send_borrower_message", 2, None)], quorum))
    assert "SortMergeJoin" not in decided._jdf.queryExecution().executedPlan().toString()
    assert {(r.tenant_id, r.decision, r.required_approvals) for r in decided.collect()} == {("t0", "auto", 1), ("t1", "approval_required", 2)}
