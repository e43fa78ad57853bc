"""Semantic response cache (survey 2.7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from convspark import values as V
from convspark.functions import text as X
from convspark.operators import cache as C
from convspark.plans import prepare
from convspark.queries import duck as D
from convspark.sources import tables as T

QUERIES, ORACLE = {}, {}
THRESHOLD = 0.9


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return register


def requests(spark, sf):
    """Request log: every event of a customer with a dialogue asks that dialogue's question, verbatim or reworded."""
    e = T.events(spark, sf).select("event_id", "tenant_id", "customer_id", F.col("k").cast("int").alias("k"))
    c = prepare.carve(T.dialogues(spark, sf)).select(
        F.concat(F.lit("c"), "conv_id").alias("customer_id"), "query", F.col("ground_truth").alias("response")
    )
    rows = e.join(c, "customer_id")
    v = F.col("k") % 4
    key = (
        F.when(v == 1, F.concat(F.lit("can you tell me "), F.lower("query")))
        .when(v == 2, F.concat(F.lower("query"), F.lit(" please thanks")))
        .otherwise(F.col("query"))
    )
    kind = F.when(v.isin(1, 2), "paraphrase_return").otherwise("exact_return")
    return rows.select(
        F.col("event_id").alias("seq"),
        "tenant_id",
        "customer_id",
        key.alias("key_text"),
        "response",
        kind.alias("request_kind"),
        X.call_cost(X.estimate_tokens(key), X.estimate_tokens(F.col("response")), F.lit(3.0), F.lit(15.0)).alias("call_cost"),
    )


def entries(spark, sf, scope):
    """Snapshot: one stored answer per dialogue, the plain question of two thirds and a reworded one of the rest."""
    c = prepare.carve(T.dialogues(spark, sf))
    tenant, customer = F.concat(F.lit("t"), F.col("conv_id") % 5), F.concat(F.lit("c"), F.col("conv_id"))
    key = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("quick question "), F.col("query"))).otherwise(F.col("query"))
    return c.select(
        X.cache_namespace(tenant, customer, scope).alias("ns"),
        F.col("conv_id").alias("entry_id"),
        key.alias("key_text"),
        F.col("ground_truth").alias("response"),
        F.col("conv_id").alias("last_touch_seq"),
    )


D.part(
    "req",
    ["evt", "carved"],
    """SELECT e.event_id AS seq, e.tenant_id, e.customer_id, CASE k::INT % 4 WHEN 1 THEN 'can you tell me ' || lower(query)
    WHEN 2 THEN lower(query) || ' please thanks' ELSE query END AS key_text, c.truth AS response FROM evt e
    JOIN carved c ON e.customer_id = 'c' || c.conv_id""",
)
D.part(
    "ent",
    ["carved"],
    """SELECT conv_id AS entry_id, 't' || (conv_id % 5) AS tenant_id, 'c' || conv_id AS customer_id,
    CASE WHEN conv_id % 3 = 0 THEN 'quick question ' || query ELSE query END AS key_text, truth AS response FROM carved""",
)


def _bow(src: str, key: str) -> str:
    return (
        f"SELECT {key}, {D.fnv('token')} % 4096 AS b, count(*) AS c FROM "
        f"(SELECT {key}, unnest({D.tok('key_text')}) AS token FROM {src}) GROUP BY ALL"
    )


# the distinct key texts of the log are compared with every entry of their tenant
D.part("rkeys", ["req"], "SELECT DISTINCT tenant_id, key_text, md5(key_text) AS h FROM req")
D.part("rbow", ["rkeys"], _bow("rkeys", "tenant_id, h"))
D.part("ebow", ["ent"], _bow("ent", "tenant_id, entry_id"))
D.part(
    "csim",
    ["rkeys", "rbow", "ebow", "ent"],
    """SELECT k.tenant_id, k.h, e.entry_id, e.customer_id AS entry_customer, e.key_text = k.key_text AS same, e.response,
    coalesce(d.dot / (sqrt(rn.n) * sqrt(en.n)), 0.0) AS sim FROM rkeys k JOIN ent e ON e.tenant_id = k.tenant_id
    LEFT JOIN (SELECT r.tenant_id, h, entry_id, sum(r.c * e.c) AS dot FROM rbow r JOIN ebow e ON e.tenant_id = r.tenant_id AND e.b = r.b
        GROUP BY ALL) d ON d.tenant_id = k.tenant_id AND d.h = k.h AND d.entry_id = e.entry_id
    LEFT JOIN (SELECT tenant_id, h, sum(c * c) AS n FROM rbow GROUP BY ALL) rn ON rn.tenant_id = k.tenant_id AND rn.h = k.h
    LEFT JOIN (SELECT tenant_id, entry_id, sum(c * c) AS n FROM ebow GROUP BY ALL) en ON en.tenant_id = k.tenant_id AND en.entry_id = e.entry_id""",
)


def _lookup_sql(scope_filter: str) -> str:
    return f""", z AS (SELECT r.seq, s.*, row_number() OVER (PARTITION BY r.seq ORDER BY s.same DESC, s.sim DESC, s.entry_id) AS z
        FROM req r JOIN csim s ON s.tenant_id = r.tenant_id AND s.h = md5(r.key_text) {scope_filter})
    SELECT seq AS request_id, CASE WHEN same OR sim >= {THRESHOLD}::DOUBLE THEN entry_id END AS entry_id,
    round(CASE WHEN same THEN 1.0 ELSE sim END, 6) AS similarity,
    CASE WHEN same OR sim >= 1 - 1e-9::DOUBLE THEN 'exact' WHEN sim >= {THRESHOLD}::DOUBLE THEN 'near' ELSE 'miss' END AS kind
    FROM z WHERE z = 1"""


def _looked_up(spark, sf, scope):
    r = requests(spark, sf)
    r = r.select(X.cache_namespace(F.col("tenant_id"), F.col("customer_id"), scope).alias("ns"), F.col("seq").alias("request_id"), "key_text")
    out = C.lookup(r, entries(spark, sf, scope), THRESHOLD)
    return out.select("request_id", "entry_id", F.round("similarity", 6).alias("similarity"), "kind")


@query("cache_lookup_per_tenant", D.sql(["req", "csim"], _lookup_sql("")))
def _(spark, sf):
    return _looked_up(spark, sf, "tenant")


@query("cache_lookup_per_customer", D.sql(["req", "csim"], _lookup_sql("AND s.entry_customer = r.customer_id")))
def _(spark, sf):
    return _looked_up(spark, sf, "tenant_customer")


@query(
    "cache_exact_hits",
    D.sql(["req", "ent"], "SELECT r.seq AS request_id, min(e.entry_id) AS entry_id FROM req r JOIN ent e ON e.tenant_id = r.tenant_id AND e.key_text = r.key_text GROUP BY r.seq"),
)
def _(spark, sf):
    scope = X.cache_namespace(F.col("tenant_id"), F.col("customer_id"), "tenant")
    r = requests(spark, sf).select(scope.alias("ns"), F.col("seq").alias("request_id"), "key_text")
    return C.exact_hits(r, entries(spark, sf, "tenant")).select("request_id", "entry_id")


# the log walked request by request; a namespace keeps its entries with the request that touched them last
D.part(
    "key_sim",
    ["rbow"],
    """SELECT tenant_id, h, map_from_entries(list((h2, sim))) AS m FROM (SELECT a.tenant_id, a.h, b.h AS h2,
    sum(a.c * b.c) / (sqrt(any_value(na.n)) * sqrt(any_value(nb.n))) AS sim FROM rbow a
    JOIN rbow b ON a.tenant_id = b.tenant_id AND a.b = b.b
    JOIN (SELECT tenant_id, h, sum(c * c) AS n FROM rbow GROUP BY ALL) na ON na.tenant_id = a.tenant_id AND na.h = a.h
    JOIN (SELECT tenant_id, h, sum(c * c) AS n FROM rbow GROUP BY ALL) nb ON nb.tenant_id = b.tenant_id AND nb.h = b.h
    GROUP BY a.tenant_id, a.h, b.h) GROUP BY tenant_id, h""",
)
THRESHOLDS = [1.0, 0.95, 0.9, 0.8, 0.7, 0.6]


def walked(name: str, scopes: list[str], thresholds: list[float], limit: int = 1 << 30) -> None:
    """Parts ``<name>_seq``, the requests by scope and threshold, and ``<name>``, the walk over them with ``limit`` entries."""
    values = ", ".join(f"('{s}', {t!r}::DOUBLE)" for s in scopes for t in thresholds)
    D.part(
        f"{name}_seq",
        ["req", "key_sim"],
        f"""SELECT *, row_number() OVER (PARTITION BY scope, threshold, ns ORDER BY seq) AS r FROM (
        SELECT v.scope, v.threshold, CASE v.scope WHEN 'tenant' THEN q.tenant_id ELSE q.tenant_id || ':' || q.customer_id END AS ns,
        q.seq, md5(q.key_text) AS h, k.m FROM req q LEFT JOIN key_sim k ON k.tenant_id = q.tenant_id AND k.h = md5(q.key_text),
        (VALUES {values}) v(scope, threshold))""",
    )
    D.part(
        name,
        [f"{name}_seq"],
        f"""SELECT scope, threshold, ns, 0::BIGINT AS r, NULL::BIGINT AS seq, NULL::VARCHAR AS kind, NULL::DOUBLE AS similarity,
        NULL::BIGINT AS entry_id, NULL::BIGINT AS evicted, []::STRUCT(e BIGINT, h VARCHAR, t BIGINT)[] AS entries
        FROM (SELECT DISTINCT scope, threshold, ns FROM {name}_seq)
        UNION ALL SELECT scope, threshold, ns, r, seq, kind, similarity, CASE WHEN kind <> 'miss' THEN b.e END, evicted,
        CASE WHEN kind = 'miss' THEN list_append(list_filter(entries, lambda x: evicted IS NULL OR x.e <> evicted),
            {{'e': seq, 'h': h, 't': r}}) ELSE list_transform(entries,
            lambda x: {{'e': x.e, 'h': x.h, 't': CASE WHEN x.e = b.e THEN r ELSE x.t END}}) END
        FROM (SELECT *, CASE WHEN kind = 'miss' AND len(entries) >= {limit}
            THEN list_sort(list_transform(entries, lambda x: {{'t': x.t, 'e': x.e}}))[1].e END AS evicted
        FROM (SELECT *, CASE WHEN b IS NULL THEN 0.0 ELSE least(b.s, 1.0) END AS similarity,
            CASE WHEN b IS NULL OR b.s < threshold THEN 'miss' WHEN b.s >= 1 - 1e-9::DOUBLE THEN 'exact' ELSE 'near' END AS kind
            FROM (SELECT w.scope, w.threshold, w.ns, q.r, q.seq, q.h, w.entries, list_sort(list_transform(w.entries, lambda x:
                {{'s': CASE WHEN x.h = q.h THEN 2.0::DOUBLE ELSE coalesce(q.m[x.h], 0.0) END, 't': -x.t, 'e': x.e}}))[-1] AS b
                FROM {name} w JOIN {name}_seq q ON q.scope = w.scope AND q.threshold = w.threshold AND q.ns = w.ns AND q.r = w.r + 1)))""",
    )


walked("cache_walk", ["tenant_customer"], [THRESHOLD])
walked("tight_walk", ["tenant_customer"], [THRESHOLD], 2)
walked("sweep_walk", ["tenant", "tenant_customer"], THRESHOLDS)


def _scopes():
    tenant, customer = F.col("tenant_id"), F.col("customer_id")
    return {s: X.cache_namespace(tenant, customer, s) for s in ("tenant", "tenant_customer")}


def _replayed(spark, sf, scope="tenant_customer", threshold=THRESHOLD):
    return C.replay(requests(spark, sf).withColumn("ns", _scopes()[scope]), threshold)


@query(
    "cache_replay",
    D.sql(["cache_walk"], "SELECT ns, seq, kind, round(similarity, 6) AS similarity, entry_id FROM cache_walk WHERE seq IS NOT NULL",
          recursive=True),
)
def _(spark, sf):
    """Request log replayed in order, each customer with an own namespace."""
    return _replayed(spark, sf).select("ns", "seq", "kind", F.round("similarity", 6).alias("similarity"), "entry_id")


@query(
    "cache_stats",
    D.sql(
        ["cache_walk", "req"],
        f""", x AS (SELECT q.tenant_id, w.kind, length(e.key_text) // 4 AS i, length(e.response) // 4 AS o FROM cache_walk w
        JOIN req q ON q.seq = w.seq LEFT JOIN req e ON e.seq = w.entry_id)
        SELECT tenant_id, count(*) AS lookups, count(*) FILTER (kind <> 'miss') AS hits, count(*) FILTER (kind = 'miss') AS misses,
        count(*) FILTER (kind = 'miss') AS stores, 0::BIGINT AS evictions, count(*) FILTER (kind = 'exact') AS exact_hits,
        count(*) FILTER (kind = 'near') AS near_hits, round(avg(CASE WHEN kind <> 'miss' THEN 1 ELSE 0 END), 6) AS hit_rate,
        coalesce(sum(i), 0)::BIGINT AS input_tokens_saved, coalesce(sum(o), 0)::BIGINT AS output_tokens_saved,
        round(coalesce(sum(i / 1e6 * {V.USD_PER_M_INPUT}::DOUBLE + o / 1e6 * {V.USD_PER_M_OUTPUT}::DOUBLE), 0), 6) AS cost_saved_usd
        FROM x GROUP BY tenant_id""",
        recursive=True,
    ),
)
def _(spark, sf):
    r = _replayed(spark, sf)
    stored = requests(spark, sf).select(F.col("seq").alias("entry_id"), F.col("key_text").alias("entry_text"))
    return C.stats(r.join(stored, "entry_id", "left"), ["tenant_id"])


@query(
    "cache_sweep",
    D.sql(
        ["sweep_walk", "req"],
        """, x AS (SELECT w.scope, w.threshold, w.kind <> 'miss' AS hit, q.paraphrase, coalesce(e.response <> q.response, false) AS wrong,
        length(q.key_text) // 4 / 1e6 * 3.0::DOUBLE + length(q.response) // 4 / 1e6 * 15.0::DOUBLE AS cost
        FROM sweep_walk w JOIN (SELECT r.*, k::INT % 4 IN (1, 2) AS paraphrase FROM req r JOIN evt v ON v.event_id = r.seq) q
        ON q.seq = w.seq LEFT JOIN req e ON e.seq = w.entry_id)
        SELECT scope, threshold, count(*) AS lookups, count(*) FILTER (hit) AS hits,
        round(avg(CASE WHEN hit THEN 1 ELSE 0 END), 6) AS hit_rate, 0::BIGINT AS hits_cold,
        count(*) FILTER (hit AND NOT paraphrase) AS hits_exact_return, count(*) FILTER (hit AND paraphrase) AS hits_paraphrase_return,
        round(sum(cost), 6) AS no_cache_cost_usd, round(sum(CASE WHEN hit THEN cost ELSE 0 END), 6) AS cost_saved_usd,
        round(sum(CASE WHEN hit THEN cost ELSE 0 END) * 100 / sum(cost), 4) AS cost_reduction_pct,
        count(*) FILTER (hit AND wrong) AS false_hits,
        round(coalesce(count(*) FILTER (hit AND wrong) / nullif(count(*) FILTER (hit), 0), 0), 6) AS false_hit_rate
        FROM x GROUP BY scope, threshold""",
        recursive=True,
    ),
)
def _(spark, sf):
    runs = C.sweep(requests(spark, sf), THRESHOLDS, _scopes(), answers=False)
    return C.report(runs, ["scope", "threshold"])


@query(
    "cache_isolation",
    D.sql(["req"], "SELECT 'b' AS ns, count(*) AS lookups, 0::BIGINT AS hits FROM req"),
)
def _(spark, sf):
    """Everything stored in one namespace, the same prompts asked in another: no hit."""
    r = requests(spark, sf).select(F.lit("b").alias("ns"), F.col("seq").alias("request_id"), "key_text")
    e = entries(spark, sf, "tenant").withColumn("ns", F.lit("a"))
    out = C.lookup(r, e, 0.5)
    return out.groupBy("ns").agg(F.count("*").alias("lookups"), F.count_if(F.col("kind") != "miss").alias("hits"))
