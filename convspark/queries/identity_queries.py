"""Identity hints, lookups and customer resolution (survey 2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from convspark.operators import identity as I
from convspark.queries import duck as D
from convspark.sources import tables as T

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return register


def hinted_events(spark, sf):
    """Events whose payload carries identity fields; a shared e-mail per ``k`` links customers across users."""
    e = T.events(spark, sf)
    n = F.col("event_id")
    fields = F.struct(
        F.when(n % 5 == 0, F.concat(F.lit(" User"), "user_id", F.lit(" "))).alias("username"),
        F.when(n % 7 == 0, F.concat(F.lit("+1 (555) 0"), "user_id")).alias("from_phone"),
        F.when(n % 11 == 0, F.concat(F.lit("K"), "k", F.lit("@X.com"))).alias("from_email"),
        F.when(n % 3 == 0, F.concat(F.lit("U"), "user_id")).alias("external_id"),
        F.when(n % 4 == 0, F.concat(F.lit("  Name "), "user_id")).alias("customer_name"),
        F.when(n % 6 == 0, F.col("user_id")).alias("email"),  # not a string: ignored
    )
    return e.withColumn("payload", F.to_json(fields)).withColumn("hints", I.hints(F.to_json(fields)))


_EXT = "CASE WHEN event_id % 3 = 0 THEN 'external_id:U' || user_id END"
_EMAIL = "CASE WHEN event_id % 11 = 0 THEN 'email:k' || k || '@x.com' END"
_PHONE = "CASE WHEN event_id % 7 = 0 THEN 'phone:+15550' || user_id END"
_HANDLE = "CASE WHEN event_id % 5 = 0 THEN 'chat_handle:user' || user_id END"


@query(
    "normalized_identities",
    """SELECT event_id, 'U' || user_id || 'x' AS external_id, lower('Mail' || user_id || '@X.Com') AS email,
    '+1555' || user_id AS phone, '1' || user_id || '+2' AS bare_phone, 'han ' || user_id AS chat_handle FROM events""",
)
def _(spark, sf):
    u = F.col("user_id")
    raw = {
        "external_id": ("external_id", F.concat(F.lit("\t U"), u, F.lit("x \n"))),
        "email": ("email", F.concat(F.lit(" Mail"), u, F.lit("@X.Com"))),
        "phone": ("phone", F.concat(F.lit("+ 1 (555) "), u, F.lit("."))),
        "bare_phone": ("phone", F.concat(F.lit("(1) "), u, F.lit("+2"))),
        "chat_handle": ("chat_handle", F.concat(F.lit("HAN "), u, F.lit(" "))),
    }
    e = T.read(spark, sf, "events")
    return e.select("event_id", *[I.normalize(F.lit(kind), v).alias(name) for name, (kind, v) in raw.items()])


@query("identity_hints", D.sql(["evt"], f"SELECT event_id, concat_ws(',', {_EXT}, {_EMAIL}, {_PHONE}, {_HANDLE}) AS hints FROM evt"))
def _(spark, sf):
    text = F.array_join(F.transform("hints", lambda h: F.concat_ws(":", h["kind"], h["value"])), ",")
    return hinted_events(spark, sf).select("event_id", text.alias("hints"))


@query("display_names", D.sql(["evt"], "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'Name ' || user_id END AS name FROM evt"))
def _(spark, sf):
    return hinted_events(spark, sf).select("event_id", I.display_name(F.col("payload")).alias("name"))


# identity table: every customer's external id, and its handle from the first event on
D.part(
    "ident",
    ["evt"],
    """SELECT tenant_id, 'external_id' AS kind, 'U' || user_id AS value, customer_id, min(received_at) AS created_at FROM evt GROUP BY ALL
    UNION ALL SELECT tenant_id, 'chat_handle', 'user' || user_id, customer_id, max(received_at) FROM evt GROUP BY ALL""",
)


def identity_table(spark, sf):
    per_user = T.events(spark, sf).groupBy("tenant_id", "customer_id", "user_id").agg(
        F.min("received_at").alias("a"), F.max("received_at").alias("b")
    )
    entry = lambda kind, prefix, at: F.struct(
        F.lit(kind).alias("kind"), F.concat(F.lit(prefix), "user_id").alias("value"), F.col(at).alias("created_at")
    )
    both = F.array(entry("external_id", "U", "a"), entry("chat_handle", "user", "b"))
    rows = per_user.select("tenant_id", "customer_id", F.inline(both))
    return rows.withColumn("identity_id", F.concat_ws(":", "customer_id", "kind"))


def customer_table(spark, sf):
    return T.events(spark, sf).select("tenant_id", "customer_id").distinct()


@query(
    "customers_by_identity",
    D.sql(["evt", "ident"], """SELECT DISTINCT i.tenant_id, i.kind, i.value, i.customer_id FROM ident i JOIN evt e ON e.tenant_id = i.tenant_id
    WHERE (i.kind = 'external_id' AND e.event_id % 3 = 0 AND i.value = 'U' || e.user_id)
    OR (i.kind = 'chat_handle' AND e.event_id % 5 = 0 AND i.value = 'user' || e.user_id)"""),
)
def _(spark, sf):
    wanted = hinted_events(spark, sf).select("tenant_id", F.inline("hints")).distinct()
    found = I.find_by_identity(wanted, identity_table(spark, sf), customer_table(spark, sf))
    return found.select("tenant_id", "kind", "value", "customer_id")


@query(
    "identities_of_customer",
    D.sql(["ident"], "SELECT kind, value, epoch_us(created_at) AS created_us FROM ident WHERE tenant_id = 't3' AND customer_id = 'c8'"),
)
def _(spark, sf):
    return I.list_identities(identity_table(spark, sf), "t3", "c8").select("kind", "value", F.unix_micros("created_at").alias("created_us"))


@query(
    "added_identities",
    D.sql(["evt", "ident"], """, r AS (SELECT event_id, tenant_id, CASE event_id % 4 WHEN 0 THEN customer_id WHEN 1 THEN 'c' || (user_id + 5)
    WHEN 2 THEN 'gone' ELSE CASE WHEN event_id % 12 = 3 THEN 'gone' ELSE customer_id END END AS customer_id,
    CASE WHEN event_id % 4 = 3 THEN 'email' ELSE 'external_id' END AS kind,
    CASE WHEN event_id % 4 = 3 THEN 'n' || event_id // 40 ELSE 'U' || user_id END AS value FROM evt),
    c AS (SELECT DISTINCT tenant_id, customer_id FROM evt),
    j AS (SELECT r.*, c.customer_id IS NOT NULL AS known, i.customer_id AS stored FROM r
    LEFT JOIN c ON c.tenant_id = r.tenant_id AND c.customer_id = r.customer_id
    LEFT JOIN ident i ON i.tenant_id = r.tenant_id AND i.kind = r.kind AND i.value = r.value),
    o AS (SELECT *, coalesce(stored, first_value(CASE WHEN known THEN customer_id END IGNORE NULLS) OVER (
    PARTITION BY tenant_id, kind, value ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS owner FROM j)
    SELECT event_id, CASE WHEN owner = customer_id THEN 'noop' WHEN owner IS NOT NULL THEN 'collision'
    WHEN known THEN 'insert' ELSE 'unknown_customer' END AS action FROM o"""),
)
def _(spark, sf):
    e = T.events(spark, sf)
    n = F.col("event_id")
    other = F.concat(F.lit("c"), F.col("user_id") + 5)
    requests = e.select(
        "event_id",
        "tenant_id",
        F.when(n % 4 == 1, other).when((n % 4 == 2) | (n % 12 == 3), "gone").otherwise(F.col("customer_id")).alias("customer_id"),
        F.when(n % 4 == 3, "email").otherwise("external_id").alias("kind"),
        F.when(n % 4 == 3, F.concat(F.lit("n"), F.floor(n / 40))).otherwise(F.concat(F.lit("U"), "user_id")).alias("value"),
    )
    return I.add_identities(requests, identity_table(spark, sf), customer_table(spark, sf), "event_id").select("event_id", "action")


D.part(
    "newc",
    ["evt"],
    """SELECT tenant_id, customer_id, min(received_at) AS created_at, 'm' || min(k::INT) || '@x' AS mail, 'N' || customer_id AS ext
    FROM evt GROUP BY tenant_id, customer_id""",
)


@query(
    "created_customers",
    D.sql(["newc", "ident"], """, ok AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, mail ORDER BY created_at, customer_id) AS z FROM newc)
    SELECT tenant_id, customer_id, 'email' AS kind, mail AS value FROM ok WHERE z = 1
    UNION ALL SELECT tenant_id, customer_id, 'external_id', ext FROM ok WHERE z = 1"""),
)
def _(spark, sf):
    """One new customer per user, with an e-mail that several ask for: only the first gets created."""
    per = T.events(spark, sf).groupBy("tenant_id", "customer_id").agg(
        F.min("received_at").alias("created_at"), F.min(F.col("k").cast("int")).alias("k")
    )
    entry = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    ids = F.array(
        entry("email", F.concat(F.lit("m"), "k", F.lit("@x"))), entry("external_id", F.concat(F.lit("N"), "customer_id"))
    )
    requests = per.select("tenant_id", "customer_id", "created_at", ids.alias("identities"))
    rows, _ = I.create_customers(requests, identity_table(spark, sf))
    return rows.select("tenant_id", "customer_id", "kind", "value")


@query(
    "matched_customers",
    D.sql(["evt"], """SELECT event_id, CASE WHEN event_id % 3 = 0 OR event_id % 5 = 0 THEN customer_id END AS customer_id,
    CASE WHEN event_id % 3 = 0 THEN 'external_id' WHEN event_id % 5 = 0 THEN 'chat_handle' END AS matched_kind,
    CASE WHEN event_id % 3 = 0 THEN 'U' || user_id WHEN event_id % 5 = 0 THEN 'user' || user_id END AS matched_value FROM evt"""),
)
def _(spark, sf):
    """First owned hint of each event against the fixed identity table."""
    m = I.resolve_each(hinted_events(spark, sf), identity_table(spark, sf))
    return m.select("event_id", "customer_id", "matched_kind", "matched_value")


def resolved(spark, sf):
    e = hinted_events(spark, sf).withColumn("customer_id", F.lit(None).cast("string"))
    return I.resolve(e)


# events one by one: who owns an identity, and which customer a stored key went to
D.part(
    "arrival_seq",
    ["evt"],
    f"""SELECT tenant_id, event_id, idempotency_key AS key, received_at,
    list_filter([{_EXT}, {_EMAIL}, {_PHONE}, {_HANDLE}], lambda x: x IS NOT NULL) AS hs,
    'cust_' || left(sha256(tenant_id || '|' || event_id), 32) AS fresh,
    row_number() OVER (PARTITION BY tenant_id ORDER BY received_at, event_id) AS r FROM evt""",
)
D.part(
    "link_walk",
    ["arrival_seq"],
    """SELECT tenant_id, 0::BIGINT AS r, NULL::BIGINT AS event_id, NULL::VARCHAR AS key, NULL::VARCHAR AS outcome, NULL::VARCHAR AS customer,
    NULL::VARCHAR AS matched, []::VARCHAR[] AS added, MAP {}::MAP(VARCHAR, VARCHAR) AS owner, []::VARCHAR[] AS keys
    FROM (SELECT DISTINCT tenant_id FROM arrival_seq)
    UNION ALL SELECT tenant_id, r, event_id, key, outcome, customer, matched, added,
    CASE WHEN len(added) = 0 THEN owner
        ELSE map_concat(owner, map_from_entries(list_transform(added, lambda x: {'k': x, 'v': customer}))) END,
    CASE WHEN outcome IN ('created', 'linked') THEN list_append(keys, key) ELSE keys END
    FROM (SELECT *, CASE WHEN replayed THEN [] ELSE list_filter(hs[1:cut - 1], lambda x: owner[x] IS NULL) END AS added,
        CASE WHEN replayed THEN 'replay' WHEN cut <= len(hs) THEN 'collision' WHEN matched IS NULL THEN 'created' ELSE 'linked' END AS outcome
        FROM (SELECT *, coalesce(nullif(list_position(list_transform(hs, lambda x: coalesce(owner[x] <> customer, false)), true), 0),
            len(hs) + 1) AS cut
            FROM (SELECT *, coalesce(owner[matched], fresh) AS customer
                FROM (SELECT w.tenant_id, a.r, a.event_id, a.key, a.hs, a.fresh, w.owner, w.keys, list_contains(w.keys, a.key) AS replayed,
                    list_filter(a.hs, lambda x: w.owner[x] IS NOT NULL)[1] AS matched
                    FROM link_walk w JOIN arrival_seq a ON a.tenant_id = w.tenant_id AND a.r = w.r + 1))))""",
)


@query(
    "resolved_customers",
    D.sql(
        ["link_walk"],
        """SELECT w.tenant_id, event_id, outcome, CASE outcome WHEN 'replay' THEN kept WHEN 'collision' THEN NULL ELSE customer END AS customer_id,
        outcome = 'created' AS customer_created, CASE WHEN outcome = 'linked' THEN split_part(matched, ':', 1) END AS matched_kind,
        CASE WHEN outcome = 'linked' THEN substr(matched, instr(matched, ':') + 1) END AS matched_value,
        CASE WHEN len(added) > 0 THEN array_to_string(added, ',') END AS identities_added FROM link_walk w
        LEFT JOIN (SELECT tenant_id, key, customer AS kept FROM link_walk WHERE outcome IN ('created', 'linked')) s
        ON s.tenant_id = w.tenant_id AND s.key = w.key WHERE event_id IS NOT NULL""",
        recursive=True,
    ),
)
def _(spark, sf):
    """Whole event table in arrival order."""
    r = resolved(spark, sf)
    added = F.array_join(F.transform("added", lambda h: F.concat_ws(":", h["kind"], h["value"])), ",")
    return r.select(
        "tenant_id", "event_id", "outcome", "customer_id", "customer_created", "matched_kind", "matched_value",
        added.alias("identities_added"),
    )


@query(
    "resolution_summary",
    D.sql(["link_walk"], "SELECT tenant_id, outcome, count(*) AS n FROM link_walk WHERE event_id IS NOT NULL GROUP BY ALL", recursive=True),
)
def _(spark, sf):
    return resolved(spark, sf).groupBy("tenant_id", "outcome").agg(F.count("*").alias("n"))
