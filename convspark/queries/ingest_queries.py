"""Sources, sinks, validation (survey 2.1, 2.2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from convspark import values as V
from convspark.functions import text as X
from convspark.operators import validate as A
from convspark.plans import prepare
from convspark.queries import duck as D
from convspark.queries.text_queries import PHRASES
from convspark.sources import readers, sinks, tables as T

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return register


# ---- files --------------------------------------------------------------------------------------


# so many messages or actions share a history
_HISTORY = 20


def _write_histories(spark, sf) -> str:
    """JSON lines in the nested history layout: some messages or some events of a customer in one line."""
    folder = sinks.scratch(spark, "histories")
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    inside = lambda items: F.transform(F.sort_array(items), lambda x: x["item"])
    where = ["tenant_id", "customer_id", F.floor(F.col("seq") / _HISTORY).alias("part")]
    message = F.struct(
        "channel", "sender", "content", stamp("ts").alias("timestamp"), F.struct("subject", "attachments").alias("metadata")
    )
    messages = T.messages(spark, sf).groupBy(*where).agg(
        inside(F.collect_list(F.struct("seq", message.alias("item")))).alias("channel_messages")
    )
    seq = F.col("seq")
    details = F.struct(
        F.array_join("details.v", "").alias("k"),
        F.array(F.lit("w2"), F.concat(F.lit("it's "), seq)).alias("papers"),
        seq.cast("int").alias("n"),
        (seq % 2 == 0).alias("even"),
        F.when(seq % 3 == 0, "x").alias("note"),
    )
    action = F.struct("action_type", details.alias("details"), stamp("ts").alias("timestamp"))
    actions = T.prior_actions(spark, sf).groupBy(*where).agg(
        inside(F.collect_list(F.struct("seq", action.alias("item")))).alias("prior_actions")
    )
    for n, part in enumerate((messages, actions)):
        rows = part.withColumns({"source": F.lit("tables"), "source_ids": F.array(F.col("part").cast("string"))})
        rows.drop("part").write.option("ignoreNullFields", "false").json(f"{folder}/kind={n}")
    return folder


@query(
    "load_histories",
    D.sql(
        ["msg", "act"],
        f"""SELECT tenant_id, customer_id, 'message' AS kind, seq % {_HISTORY} AS seq, md5({D.LINE} || ' (subject='
        || CASE WHEN subject IS NULL THEN 'None' ELSE {D.repr_('subject')} END || '; attachments='
        || CASE WHEN attachments IS NULL THEN 'None' ELSE '[' || array_to_string(attachments, ', ') || ']' END || ')') AS body_md5,
        '' AS text FROM msg
        UNION ALL SELECT tenant_id, customer_id, 'action',
        row_number() OVER (PARTITION BY tenant_id, customer_id, seq // {_HISTORY} ORDER BY seq) - 1,
        md5('[action] ' || {D.minute('ts')} || ' ' || action_type || ' (k=' || k || '; papers=w2, it''s ' || seq || '; n=' || seq
        || '; even=' || CASE WHEN seq % 2 = 0 THEN 'True' ELSE 'False' END || '; note=' || CASE WHEN seq % 3 = 0 THEN 'x' ELSE 'None' END
        || ')'), action_type || ' k ' || k || ' papers [''w2'', "it''s ' || seq || '"] n ' || seq || ' even '
        || CASE WHEN seq % 2 = 0 THEN 'True' ELSE 'False' END || ' note ' || CASE WHEN seq % 3 = 0 THEN 'x' ELSE 'None' END
        FROM act""",
    ),
)
def _(spark, sf):
    h = readers.load_histories(spark, _write_histories(spark, sf))
    cols = [F.col(c) for c in ("channel", "ts", "sender", "content", "subject", "attachments", "extras")]
    m = readers.history_messages(h).select(
        "tenant_id", "customer_id", F.lit("message").alias("kind"), "seq", X.message_line(*cols).alias("b"), F.lit("").alias("text")
    )
    a = readers.history_actions(h).select(
        "tenant_id", "customer_id", F.lit("action").alias("kind"), "seq",
        X.action_line(F.col("ts"), F.col("action_type"), F.col("details")).alias("b"),
        X.action_text(F.col("action_type"), F.col("details")).alias("text"),
    )
    return m.unionByName(a).select("tenant_id", "customer_id", "kind", "seq", F.md5("b").alias("body_md5"), "text")


def _pairs_file(spark, sf) -> str:
    folder = sinks.scratch(spark, "pairs")
    pairs, _, _ = prepare.histories(spark, sf)
    pairs.select(
        "pair_id", "customer_id", "tenant_id", "query", "ground_truth",
        F.col("n_messages").cast("int").alias("history_message_count"), F.col("bucket").alias("history_bucket"),
        F.lit("conversations").alias("source"), "intent",
    ).write.json(folder)
    return folder


@query(
    "load_pairs",
    D.sql(["pairs"], """SELECT pair_id, customer_id, tenant_id, md5(query) AS q, md5(ground_truth) AS g,
    n_messages::INT AS history_message_count, bucket AS history_bucket, intent, 0 AS n_tags FROM pairs"""),
)
def _(spark, sf):
    customers = T.messages(spark, sf).select("customer_id")
    p = readers.load_pairs(spark, _pairs_file(spark, sf), customers)
    return p.select(
        "pair_id", "customer_id", "tenant_id", F.md5("query").alias("q"), F.md5("ground_truth").alias("g"),
        "history_message_count", "history_bucket", "intent", F.size("tags").alias("n_tags"),
    )


@query("pairs_in_bucket", D.sql(["pairs"], "SELECT pair_id, bucket FROM pairs WHERE bucket = 'medium'"))
def _(spark, sf):
    return readers.in_bucket(prepare.histories(spark, sf)[0], "medium", "bucket").select("pair_id", "bucket")


# what a scenario of each event type expects: the event's number picks one in turn
EXPECTED_ACTIONS = {
    "message_received": ["send_borrower_message", "schedule_call", "notify_loan_officer", "no_op"],
    "document_uploaded": ["update_status", "request_document"],
    "status_changed": ["notify_loan_officer", "send_borrower_message", "update_status"],
    "anomaly_detected": ["notify_loan_officer", "no_op"],
    "system_event": ["no_op"],
}
DIFFICULTIES = ["easy", "medium", "hard"]


def _expected_action():
    out = F
    for kind, names in EXPECTED_ACTIONS.items():
        out = out.when(F.col("event_type") == kind, T.nth(names, F.col("event_id") % len(names)))
    return out.otherwise(F.lit(None))


_EXPECTED_SQL = "CASE event_type" + "".join(
    f" WHEN {D.lit(kind)} THEN {D.strlist(names)}[(event_id % {len(names)} + 1)::INT]" for kind, names in EXPECTED_ACTIONS.items()
) + " END"


D.part(
    "scen",
    ["evt"],
    f"""SELECT 's' || event_id AS scenario_id, event_id, tenant_id, customer_id, channel_code, event_type, received_at,
    {_EXPECTED_SQL} AS action_type, {D.strlist(DIFFICULTIES)}[(event_id % 3 + 1)::INT] AS difficulty FROM evt""",
)


def scenarios(spark, sf):
    """Every event as a scenario with the action it expects."""
    return T.events(spark, sf).select(
        F.concat(F.lit("s"), F.col("event_id")).alias("scenario_id"),
        "event_id", "tenant_id", "customer_id", "channel_code", "event_type", "received_at",
        _expected_action().alias("action_type"), T.nth(DIFFICULTIES, F.col("event_id") % 3).alias("difficulty"),
    )


def _scenario_file(spark, sf):
    folder = sinks.scratch(spark, "scenarios")
    scenarios(spark, sf).select(
        "scenario_id", "tenant_id",
        F.struct(F.col("event_id").cast("string").alias("event_id"), "event_type", "customer_id", "channel_code").alias("event"),
        F.col("action_type").alias("expected_action_type"), "difficulty",
        F.when(F.col("event_id") % 2 == 0, F.array("difficulty")).alias("tags"),
    ).write.json(folder)
    return folder


@query(
    "load_scenarios",
    D.sql(["scen"], """SELECT scenario_id, tenant_id, event_type, channel_code, action_type AS expected_action_type,
    difficulty, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS n_tags, '' AS brief_text FROM scen"""),
)
def _(spark, sf):
    s = readers.load_scenarios(spark, _scenario_file(spark, sf))
    return s.select(
        "scenario_id", "tenant_id", "event.event_type", "event.channel_code", "expected_action_type", "difficulty",
        F.size("tags").alias("n_tags"), "brief_text",
    )


@query(
    "select_scenarios",
    D.sql(["scen"], "SELECT scenario_id FROM scen WHERE tenant_id = 't1' AND event_type = 'message_received' "
          "AND difficulty = 'hard'"),
)
def _(spark, sf):
    s = scenarios(spark, sf).withColumn("event", F.struct("event_type"))
    return readers.select_scenarios(s, "t1", "message_received", "hard").select("scenario_id")


@query(
    "load_tenant_policies",
    D.sql(["evt"], """SELECT tenant_id, event_type AS key, CASE WHEN count(*) % 2 = 0 THEN 'auto' ELSE 'reject' END
    AS decision FROM evt GROUP BY ALL"""),
)
def _(spark, sf):
    """Policy documents, one file per tenant, loaded as rules."""
    counts = T.events(spark, sf).groupBy("tenant_id", "event_type").agg(F.count("*").alias("n"))
    rule = F.struct("event_type", F.when(F.col("n") % 2 == 0, "auto").otherwise("reject"))
    table = counts.groupBy("tenant_id").agg(F.map_from_entries(F.collect_list(rule)).alias("rules"))  # five event types
    folder = sinks.scratch(spark, "policies")
    document = F.to_json(F.create_map("tenant_id", "rules")).alias("value")
    table.select(document, F.col("tenant_id").alias("of")).write.partitionBy("of").text(folder)
    return readers.load_tenant_policies(spark, folder)


# ---- event table --------------------------------------------------------------------------------

SPLIT = "2024-01-16"
D.part("kevt", ["evt"], "SELECT * REPLACE (user_id || '-' || event_type AS idempotency_key) FROM evt")
D.part(
    "kfirst",
    ["kevt"],
    """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, idempotency_key ORDER BY received_at, event_id)
    AS z FROM kevt) WHERE z = 1""",
)


def _keyed(spark, sf):
    """Events whose key repeats across days, so that the later half replays the earlier one."""
    return T.events(spark, sf).withColumn("idempotency_key", F.concat_ws("-", "user_id", "event_type"))


ORDER = ["received_at", "event_id"]


@query(
    "idempotent_insert",
    D.sql(["kevt", "kfirst"], f"""SELECT k.event_id, f.event_id AS stored_id, k.event_id = f.event_id AS created
    FROM kevt k JOIN kfirst f USING (tenant_id, idempotency_key) WHERE k.received_at >= TIMESTAMP '{SPLIT}'"""),
)
def _(spark, sf):
    e = _keyed(spark, sf)
    cut = F.lit(SPLIT).cast("timestamp")
    stored = sinks.first_per_key(e.filter(F.col("received_at") < cut), ORDER)
    out = sinks.upsert_outcomes(e.filter(F.col("received_at") >= cut), stored, ORDER)
    return out.select("event_id", "stored_id", "created")


@query(
    "event_by_key",
    D.sql(["kfirst"], "SELECT event_id, tenant_id, idempotency_key FROM kfirst WHERE tenant_id = 't1' "
          "AND idempotency_key = '6-message_received'"),
)
def _(spark, sf):
    e = _keyed(spark, sf)
    hit = A.for_tenant(e, "t1", idempotency_key="6-message_received")
    return sinks.first_per_key(hit, ORDER).select("event_id", "tenant_id", "idempotency_key")


@query("event_by_id", D.sql(["evt"], "SELECT event_id, tenant_id, event_type FROM evt WHERE tenant_id = 't3' AND event_id = 0"))
def _(spark, sf):
    return A.for_tenant(T.events(spark, sf), "t3", event_id=0).select("event_id", "tenant_id", "event_type")


@query(
    "count_by_tenant",
    D.sql(["kfirst"], """SELECT coalesce(tenant_id, '*') AS tenant_id, count(*) AS n_events,
    count(DISTINCT customer_id) AS n_customers FROM kfirst GROUP BY ROLLUP (tenant_id)"""),
)
def _(spark, sf):
    stored = sinks.first_per_key(_keyed(spark, sf), ORDER)
    return (
        stored.rollup("tenant_id")
        .agg(F.count("*").alias("n_events"), F.countDistinct("customer_id").alias("n_customers"))
        .withColumn("tenant_id", F.coalesce("tenant_id", F.lit("*")))
    )


@query(
    "audit_append",
    D.sql(["evt"], """SELECT tenant_id, count(*) AS n_entries, 0 AS n_lost FROM evt GROUP BY tenant_id"""),
)
def _(spark, sf):
    """Two appended batches; the first snapshot must be contained in the second."""
    e = T.events(spark, sf).select("tenant_id", "event_id", "event_type", F.col("received_at").alias("ts"))
    log = sinks.AuditLog(spark, sinks.scratch(spark, "audit"))
    cut = F.lit(SPLIT).cast("timestamp")
    log.append(e.filter(F.col("ts") < cut))
    before = e.filter(F.col("ts") < cut)
    log.append(e.filter(F.col("ts") >= cut))
    lost = sinks.lost_entries(before, log.read()).groupBy("tenant_id").agg(F.count("*").alias("l"))
    counts = log.read().groupBy("tenant_id").agg(F.count("*").alias("n_entries"))
    return counts.join(lost, "tenant_id", "left").select(
        "tenant_id", "n_entries", F.coalesce("l", F.lit(0)).cast("int").alias("n_lost")
    )


@query(
    "audit_ids",
    D.sql(["evt"], """SELECT event_id, row_number() OVER (PARTITION BY tenant_id ORDER BY received_at, event_id) AS audit_id
    FROM evt"""),
)
def _(spark, sf):
    return sinks.with_audit_ids(T.events(spark, sf), ["received_at", "event_id"], "received_at").select("event_id", "audit_id")


@query(
    "event_envelopes",
    D.sql(["kfirst"], """SELECT tenant_id, 'events.' || tenant_id AS channel,
    '{"channel_code":"' || channel_code || '","customer_id":"' || customer_id || '","event_id":"' || event_id ||
    '","event_type":"' || event_type || '","received_at":"' || strftime(received_at, '%Y-%m-%dT%H:%M:%S') ||
    CASE WHEN epoch_us(received_at) % 1000000 = 0 THEN '' ELSE strftime(received_at, '.%f') END || '+00:00","tenant_id":"'
    || tenant_id || '"}' AS message FROM kfirst"""),
)
def _(spark, sf):
    return sinks.envelopes(sinks.new_events(_keyed(spark, sf), None, ORDER))


@query(
    "result_files",
    D.sql(["evt"], """SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM evt GROUP BY event_type"""),
)
def _(spark, sf):
    """Rows and their summary written, and the summary rebuilt from the written rows."""
    rows = T.events(spark, sf)
    agg = lambda d: d.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    folder = sinks.scratch(spark, "results")
    sinks.write_results(rows, agg(rows), folder)
    written = spark.read.schema("event_type string, n long, total double").json(f"{folder}/summary")
    return agg(spark.read.parquet(f"{folder}/rows")).join(written.select("event_type", "n"), ["event_type", "n"])


@query(
    "normalized_events",
    D.sql(["evt"], """SELECT CASE WHEN event_id % 3 = 0 THEN 'evt_' || left(sha256(tenant_id || '|' || event_id), 32)
    ELSE 'e' || event_id END AS event_id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE customer_id END AS customer_id,
    CASE WHEN event_id % 5 < 2 THEN 'api' ELSE channel_code END AS channel_code FROM evt"""),
)
def _(spark, sf):
    e = T.events(spark, sf)
    n = F.col("event_id")
    loose = e.select(
        F.when(n % 3 != 0, F.concat(F.lit("e"), n)).when(n % 2 == 0, F.lit("")).alias("event_id"),
        F.when(n % 4 != 0, F.col("customer_id")).alias("customer_id"),
        F.when(n % 5 >= 2, F.col("channel_code")).alias("channel_code"),
        X.stable_id("evt_", F.col("tenant_id"), n).alias("fallback"),
    )
    return readers.normalize_events(loose, F.col("fallback")).drop("fallback")


# ---- validation ---------------------------------------------------------------------------------

# raw request bodies: every event, with a defect chosen by its id
_DEFECT_SQL = """CASE event_id % 12
    WHEN 1 THEN '{"tenant_id":"' || tenant_id || '","channel_code":"fax","event_type":"' || event_type || '","payload":{"k":1},"extra":1}'
    WHEN 2 THEN '{"tenant_id":"","channel_code":"chat","event_type":"' || event_type || '"}'
    WHEN 3 THEN '{"channel_code":"chat","event_type":"gone","idempotency_key":""}'
    WHEN 4 THEN 'not json ' || event_id
    WHEN 5 THEN '[1, 2]'
    WHEN 6 THEN '{"tenant_id":7,"channel_code":"sms","event_type":"' || event_type || '","payload":[1]}'
    WHEN 7 THEN '{"tenant_id":"' || tenant_id || '","customer_id":null,"channel_code":"api","event_type":"' || event_type || '","idempotency_key":null}'
    WHEN 8 THEN '{"tenant_id":"' || tenant_id || '","customer_id":5,"channel_code":"api","event_type":"' || event_type || '","payload":null}'
    ELSE '{"tenant_id":"' || tenant_id || '","customer_id":"' || customer_id || '","channel_code":"' || channel_code || '","event_type":"'
        || event_type || '","idempotency_key":"' || idempotency_key || '","payload":{"k":' || k || '}}' END"""


def raw_requests(spark, sf):
    return T.events(spark, sf).select("event_id", F.expr(_DEFECT_SQL.replace("event_id % 12", "CAST(event_id % 12 AS INT)")).alias("raw"))


_ERRORS = {1: "channel_code,extra", 2: "tenant_id", 3: "tenant_id,event_type,idempotency_key", 4: "body", 5: "body",
           6: "tenant_id,payload", 8: "customer_id,payload"}


@query(
    "request_validation",
    D.sql(["evt"], f"""SELECT event_id, CASE event_id % 12 {" ".join(f"WHEN {k} THEN {D.lit(v)}" for k, v in _ERRORS.items())} ELSE '' END AS errors,
    CASE WHEN event_id % 12 IN (2, 3, 4, 5, 6) THEN '_unparseable_' ELSE tenant_id END AS quarantine_tenant FROM evt"""),
)
def _(spark, sf):
    return A.parse_requests(raw_requests(spark, sf)).select(
        "event_id", F.array_join("errors", ",").alias("errors"), "quarantine_tenant"
    )


@query(
    "validation_quarantine",
    D.sql(["evt"], """SELECT tenant_id, 'validation_failed' AS reason, detail, count(*) AS n FROM (
    SELECT CASE WHEN event_id % 12 IN (2, 3, 4, 5, 6) THEN '_unparseable_' ELSE tenant_id END AS tenant_id,
    'validation failed: ' || CASE event_id % 12 WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 3 THEN 3 WHEN 4 THEN 1 WHEN 5 THEN 1
    ELSE 2 END || ' error(s)' AS detail FROM evt WHERE event_id % 12 IN (1, 2, 3, 4, 5, 6, 8)) GROUP BY ALL"""),
)
def _(spark, sf):
    _, bad = A.split_valid(A.parse_requests(raw_requests(spark, sf)))
    return bad.groupBy("tenant_id", "reason", "detail").agg(F.count("*").alias("n"))


@query(
    "resolved_keys",
    D.sql(["evt"], """, k AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE idempotency_key END AS h,
    CASE event_id % 7 WHEN 0 THEN NULL WHEN 1 THEN 'other' ELSE idempotency_key END AS b FROM evt)
    SELECT event_id, coalesce(nullif(h, ''), nullif(b, '')) AS key,
    CASE WHEN nullif(h, '') IS NULL AND nullif(b, '') IS NULL THEN 'missing_idempotency_key'
    WHEN nullif(h, '') <> nullif(b, '') THEN 'idempotency_key_mismatch' END AS reason FROM k"""),
)
def _(spark, sf):
    n = F.col("event_id")
    e = T.events(spark, sf).select(
        n,
        F.when(n % 4 == 0, F.lit(None)).when(n % 4 == 1, F.lit("")).otherwise(F.col("idempotency_key")).alias("h"),
        F.when(n % 7 == 0, F.lit(None)).when(n % 7 == 1, F.lit("other")).otherwise(F.col("idempotency_key")).alias("b"),
    )
    key, reason = A.resolve_key(F.col("h"), F.col("b"))
    return e.select("event_id", key.alias("key"), reason.alias("reason"))


def text_events(spark, sf):
    """Every document as an inbound event with a nested payload; by its id, one in eight phrases is added."""
    d = T.read(spark, sf, "documents")
    phrase = T.nth(PHRASES, F.col("doc_id") % len(PHRASES))
    payload = F.to_json(
        F.struct(
            F.col("text").alias("text"),
            F.struct(F.array(phrase, F.col("source")).alias("notes"), F.col("n_chars").alias("n")).alias("meta"),
            F.array(F.struct(F.col("lang").alias("lang"), F.lit(True).alias("ok"))).alias("tags"),
        )
    )
    return d.select(
        F.col("doc_id").alias("event_id"),
        F.concat(F.lit("t"), F.col("doc_id") % 5).alias("tenant_id"),
        F.concat(F.lit("c"), F.col("doc_id") % 97).alias("customer_id"),
        T.nth(V.EVENT_TYPES, F.col("doc_id") % 2).alias("event_type"),
        T.nth(V.CHANNELS, F.col("doc_id") % 5).alias("channel_code"),
        payload.alias("payload"),
        F.timestamp_seconds(F.lit(T.EPOCH) + F.col("doc_id") * 60).alias("received_at"),
    )


_PH = f"{D.strlist(PHRASES)}[(doc_id % {len(PHRASES)} + 1)::INT]"


@query(
    "payload_strings",
    f"SELECT doc_id AS event_id, 4 AS n_leaves, md5(text || '|' || {_PH} || '|' || source || '|' || lang) AS leaves_md5 FROM documents",
)
def _(spark, sf):
    leaves = A.payload_strings(F.col("payload"))
    rows = text_events(spark, sf).select("event_id", leaves.alias("leaves"))
    return rows.select("event_id", F.size("leaves").alias("n_leaves"), F.md5(F.array_join("leaves", "|")).alias("leaves_md5"))


_HIT = " OR ".join(D.grep(x, p) for x in ("text", _PH) for _, p, _ in V.INJECTION_FAMILIES)


@query(
    "injection_quarantine",
    f"SELECT 't' || (doc_id % 5) AS tenant_id, doc_id AS event_id, 'injection_suspected' AS reason, false AS blocking "
    f"FROM documents WHERE {_HIT}",
)
def _(spark, sf):
    e = text_events(spark, sf).withColumn("leaves", A.payload_strings(F.col("payload")))
    return A.quarantine_injections(e, F.col("leaves"))


@query(
    "unknown_customers",
    D.sql(["evt", "msg"], """SELECT event_id, tenant_id, customer_id FROM evt WHERE (tenant_id, customer_id) NOT IN
    (SELECT tenant_id, customer_id FROM msg)"""),
)
def _(spark, sf):
    return A.unknown_customers(T.events(spark, sf), T.messages(spark, sf))[1].select("event_id", "tenant_id", "customer_id")


@query(
    "envelope_field_check",
    D.sql(["evt"], """SELECT event_id % 9 = 0 OR event_id % 10 = 0 AS missing, count(*) AS n FROM evt GROUP BY ALL"""),
)
def _(spark, sf):
    n = F.col("event_id")
    e = T.events(spark, sf).select(
        F.when(n % 9 != 0, F.col("tenant_id")).alias("tenant_id"),
        F.when(n % 10 != 0, n.cast("string")).otherwise(F.lit("")).alias("event_id"),
    )
    return e.groupBy(A.missing_envelope_fields(e).alias("missing")).agg(F.count("*").alias("n"))


@query(
    "constraint_violations",
    D.sql(["evt"], """SELECT entity, rule, count(*) AS n FROM (
    SELECT 'actions' AS entity, 'executed_at_iff_executed' AS rule FROM evt WHERE (event_id % 3 = 0) <> (event_id % 2 = 0)
    UNION ALL SELECT 'actions', 'status_enum' FROM evt WHERE event_id % 3 = 2
    UNION ALL SELECT 'actions', 'action_type_enum' FROM evt WHERE event_type = 'system_event'
    UNION ALL SELECT 'briefs', 'tokens_within_budget' FROM documents WHERE length(text) // 4 > 200
    UNION ALL SELECT 'quorum', 'at_least_one' FROM evt WHERE event_id % 4 = 0
    UNION ALL SELECT 'quorum', 'pool_large_enough' FROM evt WHERE event_id % 4 = 3 AND event_id % 5 <> 0
    UNION ALL SELECT 'quorum', 'pool_distinct' FROM evt WHERE event_id % 5 = 1
    UNION ALL SELECT 'tenants', 'slug_pattern' FROM documents WHERE NOT regexp_full_match(source, '[a-z0-9][a-z0-9-]*')
    ) GROUP BY ALL"""),
)
def _(spark, sf):
    e = T.events(spark, sf)
    n = F.col("event_id")
    actions = e.select(
        "event_id",
        F.when(n % 3 == 0, "executed").when(n % 3 == 1, "rejected").otherwise("unheard_of").alias("status"),
        F.when(n % 2 == 0, F.col("received_at")).alias("executed_at"),
        F.when(F.col("event_type") == "system_event", F.lit("dance")).otherwise(F.lit("no_op")).alias("action_type"),
    )
    pool = F.when(n % 5 == 1, F.array(F.lit("a"), F.lit("a"))).when(n % 5 != 0, F.array(F.lit("a"), F.lit("b")))
    quorum = e.select("event_id", (n % 4).cast("int").alias("required_approvals"), pool.alias("eligible_approvers"))
    docs = T.read(spark, sf, "documents")
    briefs = docs.select("doc_id", X.estimate_tokens(F.col("text")).alias("brief_tokens"), F.lit(200).alias("token_budget"))
    found = [
        A.violations(actions, "actions", n),
        A.violations(quorum, "quorum", n),
        A.violations(briefs, "briefs", F.col("doc_id")),
        A.violations(docs.select("doc_id", F.col("source").alias("slug")), "tenants", F.col("doc_id")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("entity", "rule").agg(F.count("*").alias("n"))


@query(
    "duplicate_event_keys",
    D.sql(["evt"], """SELECT 'events' AS entity, tenant_id, idempotency_key, count(*) AS n FROM evt GROUP BY ALL
    HAVING count(*) > 1"""),
)
def _(spark, sf):
    return A.duplicate_keys(T.events(spark, sf), "events")


@query(
    "tenant_scoped_read",
    D.sql(["evt"], "SELECT event_id, event_type FROM evt WHERE tenant_id = 't2' AND customer_id = 'c7'"),
)
def _(spark, sf):
    return A.for_tenant(T.events(spark, sf), "t2", customer_id="c7").select("event_id", "event_type")


@query(
    "message_projection",
    """SELECT 't' || (doc_id % 5) AS tenant_id, 'c' || (doc_id % 97) AS customer_id, doc_id AS event_id, 'inbound' AS direction,
    md5(text) AS body_md5 FROM documents WHERE doc_id % 2 = 0""",
)
def _(spark, sf):
    m = A.project_messages(text_events(spark, sf))
    return m.select("tenant_id", "customer_id", "event_id", "direction", F.md5("body").alias("body_md5"))
