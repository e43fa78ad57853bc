"""Streams over the given events, run to their end, against the batch result (survey 2.8)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from convspark.operators import cache as C, decisions as DC
from convspark.queries import cache_queries, duck as D, identity_queries as IQ, policy_queries as PQ
from convspark.sources import sinks, tables as T
from convspark.streaming import decide as SD, ingest as SI, rings as SR
from convspark.streaming.state import BatchTable, KeyTable, run_available

QUERIES, ORACLE = {}, {}
CUTS = ["2024-01-11", "2024-01-21"]


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return register


def play(spark, rows, steps, name: str, time: str = "received_at"):
    """Feed ``rows`` as three arrivals, in time order, to a file stream that is stopped and resumed in between.

    ``steps``: (what becomes of the stream, handler of its micro-batches, output mode)."""
    folder = sinks.scratch(spark, name)
    at = F.date_format(time, "yyyy-MM-dd")
    parts = [at < CUTS[0], (at >= CUTS[0]) & (at < CUTS[1]), at >= CUTS[1]]
    for part in parts:
        rows.filter(part).write.mode("append").parquet(f"{folder}/in")
        for i, (step, handler, mode) in enumerate(steps):
            stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
            run_available(step(stream), handler, f"{folder}/checkpoint{i}", mode)


def _same(stream):
    return stream


def _table(spark, name, schema, cls=BatchTable):
    return cls(spark, sinks.scratch(spark, name), schema)


_EVENT = "event_id long, tenant_id string, customer_id string, idempotency_key string, event_type string, channel_code string, received_at timestamp"


def _events(spark, sf):
    e = T.events(spark, sf).withColumn("idempotency_key", F.concat_ws("-", "user_id", "event_type"))
    return e.select("event_id", "tenant_id", "customer_id", "idempotency_key", "event_type", "channel_code", "received_at")


@query("stream_first_wins_insert", D.sql(["kfirst"], "SELECT event_id, tenant_id, idempotency_key FROM kfirst"))
def _(spark, sf):
    table = _table(spark, "events", _EVENT)
    play(spark, _events(spark, sf), [(lambda s: SI.first_wins(s, ["received_at", "event_id"]), SI.insert_new(table), "update")], "ingest")
    return table.read().select("event_id", "tenant_id", "idempotency_key")


@query(
    "stream_dedup_within_watermark",
    D.sql(["evt"], """SELECT tenant_id, idempotency_key, arg_min(event_id, {'t': received_at, 'e': event_id}) AS event_id, 1 AS n FROM evt
    GROUP BY tenant_id, idempotency_key"""),
)
def _(spark, sf):
    """Keys repeat within a day only, so a bounded delay of two days loses nothing. The first rows of all keys come in the
    first micro-batch, the second ones in the second."""
    table = _table(spark, "dedup", "tenant_id string, idempotency_key string, event_id long")
    rows = T.events(spark, sf).select("event_id", "tenant_id", "idempotency_key", "received_at")
    folder = sinks.scratch(spark, "watermark")
    turn = F.row_number().over(Window.partitionBy("tenant_id", "idempotency_key").orderBy("received_at", "event_id"))
    arrivals = rows.withColumn("turn", F.least(turn, F.lit(3)))
    for n in (1, 2, 3):
        arrivals.filter(F.col("turn") == n).drop("turn").write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/in")
        once = SI.dedup_within(stream, ["tenant_id", "idempotency_key"], "2 days")
        # each run of the stream numbers its micro-batches on
        run_available(once, lambda batch, i: table.write(batch, i), f"{folder}/checkpoint")
    won = table.read().groupBy("tenant_id", "idempotency_key")
    return won.agg(F.min("event_id").alias("event_id"), F.count("*").cast("int").alias("n"))


def _decide(spark, rows, name):
    """Runs the decision flow over the stream of ``rows``; its tables."""
    schemas = {"answers": SD.ANSWER_SCHEMA, "queue": SD.QUEUE_SCHEMA, "audit": SD.AUDIT_SCHEMA, "rejects": SD.REJECT_SCHEMA}
    t = {n: _table(spark, n, s) for n, s in schemas.items()}
    decided = lambda s: SD.decided(s, T.policy_rules(spark), T.quorum_rules(spark))
    handler = SD.decide(t["answers"], t["queue"], t["audit"])
    play(spark, rows, [(decided, handler, "update"), (SD.rejected, t["rejects"].write, "append")], name)
    return t


@query(
    "stream_decisions",
    D.sql(["flow0", "quorum"], """SELECT f.action_id, f.decision, CASE decision WHEN 'reject' THEN 'rejected' WHEN 'auto' THEN 'executed'
    ELSE 'pending_approval' END AS status FROM flow0 f"""),
)
def _(spark, sf):
    """Every event arrives twice; the second arrival changes nothing."""
    e = _events(spark, sf).drop("idempotency_key", "channel_code")
    again = e.withColumn("received_at", F.col("received_at") + F.expr("INTERVAL 3 DAYS"))
    t = _decide(spark, e.unionByName(again), "decide")
    return SD.stored_actions(t["answers"]).select("action_id", "decision", "status")


@query(
    "stream_replayed_actions",
    D.sql(["flow0"], """SELECT tenant_id, event_id, action_id, decision, CASE decision WHEN 'reject' THEN 'rejected' WHEN 'auto' THEN 'executed'
    ELSE 'pending_approval' END AS status FROM flow0"""),
)
def _(spark, sf):
    """Every event arrives twice, in one batch or in two: the second arrival is answered with the stored action."""
    e = _events(spark, sf).drop("idempotency_key", "channel_code")
    again = e.withColumn("received_at", F.col("received_at") + F.expr("INTERVAL 3 DAYS"))
    t = _decide(spark, e.unionByName(again), "replay")
    return SD.replayed_actions(t["answers"]).select("tenant_id", "event_id", "action_id", "decision", "status")


@query(
    "stream_audit_counts",
    D.sql(["flow0", "evt"], """SELECT kind, count(*) AS n FROM (SELECT unnest(CASE decision WHEN 'approval_required' THEN ['proposal', 'decision']
    WHEN 'reject' THEN ['proposal', 'decision', 'rejection'] ELSE ['proposal', 'decision', 'execution'] END) AS kind FROM flow0
    WHERE event_id % 10 <> 0) GROUP BY kind UNION ALL SELECT 'refused', count(*) FROM evt WHERE event_id % 10 = 0"""),
)
def _(spark, sf):
    """Audit entries per kind; every tenth event has lost its tenant and is refused without failing the batch."""
    e = _events(spark, sf).drop("idempotency_key", "channel_code")
    e = e.withColumn("tenant_id", F.when(F.col("event_id") % 10 != 0, F.col("tenant_id")))
    t = _decide(spark, e, "audit")
    kinds = t["audit"].read().groupBy("kind").agg(F.count("*").alias("n"))
    return kinds.unionByName(t["rejects"].read().agg(F.lit("refused").alias("kind"), F.count("*").alias("n")))


@query("stream_vote_outcomes", D.sql(["vwalk"], "SELECT vote_id, outcome FROM vwalk WHERE vote_id IS NOT NULL", recursive=True))
def _(spark, sf):
    actions = PQ.flow(spark, sf)
    queue_path = sinks.scratch(spark, "queue")
    DC.queue_rows(actions).write.parquet(queue_path)
    outcomes = _table(spark, "votes", SD.VOTE_SCHEMA)
    queue = spark.read.parquet(queue_path)
    play(spark, PQ.votes(spark, sf), [(lambda s: SD.voted(s, queue), outcomes.write, "append")], "votes", "voted_at")
    return outcomes.read().select("vote_id", "outcome")


@query(
    "stream_recent_events",
    D.sql(["evt"], """SELECT tenant_id, event_id, age FROM (SELECT tenant_id, event_id, row_number() OVER (PARTITION BY tenant_id
    ORDER BY received_at DESC, event_id DESC) AS age FROM evt) WHERE age <= 50"""),
)
def _(spark, sf):
    ring = _table(spark, "ring", "tenant_id string, event_id long, event_type string, received_at timestamp", SR.RingTable)
    order = ["received_at", "event_id"]
    play(spark, _events(spark, sf), [(_same, SR.keep_ring(ring, order, SR.EVENTS_CAP), "append")], "ring")
    return SR.newest(ring.read_last(), order, SR.EVENTS_CAP).select("tenant_id", "event_id", "age")


@query(
    "recent_proposals",
    D.sql(["flow0"], """SELECT tenant_id, event_id, action_type, age FROM (SELECT tenant_id, event_id, action_type,
    row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, event_id DESC) AS age FROM flow0) WHERE age <= 50"""),
)
def _(spark, sf):
    from convspark.operators import proposals as PR

    p = PR.propose(T.events(spark, sf))
    return SR.newest(p, ["proposed_at", "event_id"], SR.PROPOSALS_CAP).select("tenant_id", "event_id", "action_type", "age")


@query(
    "quarantine_ring",
    D.sql(["evt"], """, q AS (SELECT event_id, received_at, CASE WHEN event_id % 12 IN (2, 3, 4, 5, 6) THEN '_unparseable_' ELSE tenant_id END AS tenant_id
    FROM evt WHERE event_id % 12 IN (1, 2, 3, 4, 5, 6, 8))
    SELECT tenant_id, event_id, age FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY received_at DESC, event_id DESC) AS age
    FROM q) WHERE age <= 200"""),
)
def _(spark, sf):
    from convspark.operators import validate as A
    from convspark.queries.ingest_queries import raw_requests

    parsed = A.parse_requests(raw_requests(spark, sf)).filter(F.size("errors") > 0)
    q = parsed.select(F.col("quarantine_tenant").alias("tenant_id"), "event_id")
    q = q.join(T.events(spark, sf).select("event_id", "received_at"), "event_id")
    return SR.newest(q, ["received_at", "event_id"], SR.QUARANTINE_CAP).select("tenant_id", "event_id", "age")


D.part(
    "dfr",
    ["evt"],
    """SELECT tenant_id, event_id AS call_id, received_at, CASE WHEN event_id % 6 = 0 THEN 'deadline_exceeded' ELSE 'transient_error' END AS reason,
    CASE event_id % 6 WHEN 0 THEN 'DeadlineExceeded: over ' || k || ' ms' WHEN 2 THEN 'ConnectionError: ' ELSE
    event_type || ' returned degraded result without explicit error' END AS detail FROM evt WHERE event_id % 2 = 0""",
)


def _deferred(spark, sf):
    """Every second call is degraded: a deadline, an error, or a degraded result without an error."""
    n = F.col("event_id")
    calls = T.events(spark, sf).select(
        "tenant_id",
        F.col("event_type").alias("operation"),
        (n % 2 == 0).alias("degraded"),
        F.when(n % 6 == 0, "DeadlineExceeded").when(n % 6 == 2, "ConnectionError").alias("error_class"),
        F.when(n % 6 == 0, F.concat(F.lit("over "), "k", F.lit(" ms"))).alias("error_message"),
        F.lit("{}").alias("payload"),
        F.col("value").alias("elapsed_ms"),
        F.col("received_at").alias("deferred_at"),
        n.alias("call_id"),
    )
    return SR.deferred(calls)


@query(
    "deferred_calls",
    D.sql(["dfr"], """SELECT tenant_id, call_id, reason, detail, age FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id
    ORDER BY received_at DESC, call_id DESC) AS age FROM dfr) WHERE age <= 500"""),
)
def _(spark, sf):
    q = SR.newest(_deferred(spark, sf), ["deferred_at", "call_id"], SR.DEFERRED_CAP)
    return q.select("tenant_id", "call_id", "reason", "detail", "age")


@query(
    "drained_calls",
    D.sql(["dfr"], """, q AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY received_at DESC, call_id DESC) AS age FROM dfr),
    o AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY received_at, call_id) AS turn FROM q WHERE age <= 500)
    SELECT tenant_id, call_id, turn <= 100 AS drained FROM o"""),
)
def _(spark, sf):
    q = SR.newest(_deferred(spark, sf), ["deferred_at", "call_id"], SR.DEFERRED_CAP).drop("age")
    taken, rest = SR.drain(q, ["deferred_at", "call_id"], 100)
    return taken.select("tenant_id", "call_id", F.lit(True).alias("drained")).unionByName(
        rest.select("tenant_id", "call_id", F.lit(False).alias("drained"))
    )


@query(
    "bus_messages",
    D.sql(["evt"], """SELECT tenant_id, event_type, count(*) AS n FROM evt WHERE event_id % 7 NOT IN (1, 2) GROUP BY ALL"""),
)
def _(spark, sf):
    """Envelopes off the bus; what is not JSON, or not an object, is dropped."""
    n = F.col("event_id") % 7
    good = F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), "tenant_id", "customer_id", "channel_code", "event_type"))
    raw = T.events(spark, sf).select(F.when(n == 1, F.lit("not json")).when(n == 2, F.lit("[1]")).otherwise(good).alias("value"))
    return SI.envelopes(raw).groupBy("tenant_id", "event_type").agg(F.count("*").alias("n"))


@query(
    "stream_linked_customers",
    D.sql(
        ["link_walk"],
        """SELECT w.tenant_id, w.event_id, w.outcome, CASE w.outcome WHEN 'collision' THEN NULL WHEN 'replay' THEN s.customer
            ELSE w.customer END AS customer_id,
        CASE WHEN w.outcome = 'replay' THEN s.event_id END AS replay_of,
        CASE WHEN w.outcome = 'linked' THEN split_part(w.matched, ':', 1) END AS matched_kind,
        CASE WHEN w.outcome = 'linked' THEN substr(w.matched, instr(w.matched, ':') + 1) END AS matched_value FROM link_walk w
        LEFT JOIN (SELECT * FROM link_walk WHERE outcome IN ('created', 'linked')) s ON s.tenant_id = w.tenant_id AND s.key = w.key
        WHERE w.event_id IS NOT NULL""",
        recursive=True,
    ),
)
def _(spark, sf):
    """Identity linking in three arrivals; a replay names the stored event and its customer, whenever that was stored."""
    e = IQ.hinted_events(spark, sf).withColumn("customer_id", F.lit(None).cast("string"))
    rows = e.select("tenant_id", "event_id", "received_at", "idempotency_key", "customer_id", "hints")
    out = _table(spark, "outcomes", SI.OUTCOME_SCHEMA)
    identities = KeyTable(spark, sinks.scratch(spark, "identities"), SI.IDENTITY_SCHEMA, ["tenant_id", "kind", "value"], 16)
    stored = KeyTable(spark, sinks.scratch(spark, "keys"), SI.STORED_SCHEMA, sinks.KEY, 16)
    play(spark, rows, [(_same, SI.link(identities, stored, out), "append")], "link")
    return out.read().select("tenant_id", "event_id", "outcome", "customer_id", "replay_of", "matched_kind", "matched_value")


@query(
    "cache_replay_with_eviction",
    D.sql(["tight_walk"], "SELECT ns, seq, kind, round(similarity, 6) AS similarity, entry_id, evicted FROM tight_walk WHERE seq IS NOT NULL",
          recursive=True),
)
def _(spark, sf):
    """Replay per customer with room for two entries only."""
    r = cache_queries.requests(spark, sf).withColumn("ns", F.concat_ws(":", "tenant_id", "customer_id"))
    return C.replay_lru(r, 0.9, 2).select("ns", "seq", "kind", F.round("similarity", 6).alias("similarity"), "entry_id", "evicted")
