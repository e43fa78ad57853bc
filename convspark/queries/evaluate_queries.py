"""Scoring, summaries, cost, load statistics and dataset preparation (survey 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from convspark.plans import evaluate as E, prepare as N
from convspark.queries import duck as D, policy_queries  # noqa: F401 (registers the scenario parts)
from convspark.queries.retrieval_queries import run_all
from convspark.session import cut_lineage
from convspark.sources import tables as T

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return register


# a stand-in latency that grows with the brief, so that percentiles have something to rank
_LAT = "(0.05 + brief_tokens * 0.003 + n_kept * 0.001)"


def judged(spark, sf, strategies=None):
    """(briefs of every strategy with bucket and latency, their scores, pairs)"""
    briefs, pairs = run_all(spark, sf, strategies=strategies) if strategies else run_all(spark, sf)
    briefs = briefs.join(pairs.select("pair_id", "bucket"), "pair_id").withColumn("latency_ms", F.expr(_LAT))
    briefs = cut_lineage(briefs)  # several reports read the packed briefs
    return briefs, E.score(briefs, pairs), pairs


D.part(
    "briefs_x",
    ["all_briefs", "pairs"],
    f"""SELECT b.*, p.bucket, p.query, p.ground_truth, p.intent, 0.05 + b.brief_tokens * 0.003 + b.n_kept * 0.001 AS latency_ms
    FROM all_briefs b JOIN pairs p ON p.pair_id = b.pair_id""",
)
D.part(
    "scored0",
    ["briefs_x"],
    f"""SELECT *, {D.recall('q', 'b')} AS query_recall, {D.recall('g', 'b')} AS truth_recall FROM
    (SELECT *, {D.rtok('query')} AS q, {D.rtok('ground_truth')} AS g, {D.rtok('brief_text')} AS b FROM briefs_x)""",
)
D.part(
    "scored",
    ["scored0"],
    f"""SELECT *, {D.score('(0.5::DOUBLE * query_recall + 0.5::DOUBLE * truth_recall)')} AS quality,
    concat_ws(';', CASE WHEN len(g) = 0 THEN 'gt_has_no_factual_tokens' END,
    CASE WHEN len(q) = 0 THEN 'query_has_no_factual_tokens' END) AS notes FROM scored0""",
)


def rsql(needs, body):
    return D.sql(needs, body, recursive=True)


@query(
    "brief_scores",
    rsql(["scored"], """SELECT strategy, pair_id, bucket, quality, round(query_recall, 6) AS query_recall,
    round(truth_recall, 6) AS truth_recall, notes FROM scored"""),
)
def _(spark, sf):
    s = judged(spark, sf)[1]
    return s.select(
        "strategy", "pair_id", "bucket", "quality", F.round("query_recall", 6).alias("query_recall"),
        F.round("truth_recall", 6).alias("truth_recall"), "notes",
    )


_BOTH = "(SELECT * FROM {t} UNION ALL SELECT * REPLACE ('*' AS bucket) FROM {t})"


@query(
    "quality_summary",
    rsql(["scored"], f"""SELECT strategy, bucket, count(*) AS n_pairs, round(avg(quality), 3) AS mean_quality,
    median(quality) AS median_quality, {', '.join(f'count(*) FILTER (quality = {k}) AS score_{k}' for k in range(1, 6))}
    FROM {_BOTH.format(t='scored')} GROUP BY ALL"""),
)
def _(spark, sf):
    return E.quality_summary(judged(spark, sf)[1])


@query(
    "results_with_scores",
    rsql(["scored"], """SELECT strategy, pair_id, brief_tokens::INT AS brief_tokens, CASE WHEN strategy <> 'recency' THEN quality END AS quality
    FROM scored"""),
)
def _(spark, sf):
    briefs, scores, _ = judged(spark, sf)
    out = E.attach_scores(briefs.select("strategy", "pair_id", "brief_tokens"), scores.filter("strategy <> 'recency'"))
    return out.select("strategy", "pair_id", "brief_tokens", "quality")


@query(
    "brief_summary",
    rsql(["briefs_x"], f""", r AS (SELECT strategy, bucket, count(*) AS n, avg(brief_tokens) AS t, max(token_budget) AS budget,
    list(latency_ms ORDER BY latency_ms) AS x FROM {_BOTH.format(t='briefs_x')} GROUP BY ALL)
    SELECT strategy, bucket, n AS n_pairs, budget AS effective_token_budget, round(t, 1) AS avg_brief_tokens,
    round(x[n // 2 + 1], 4) AS latency_ms_p50, round(x[greatest(0, floor(n * 0.95)::BIGINT - 1) + 1], 4) AS latency_ms_p95,
    round(t / budget * 100, 1) AS budget_saturation_pct FROM r"""),
)
def _(spark, sf):
    return E.brief_summary(judged(spark, sf)[0])


@query(
    "brief_cost",
    rsql(["briefs_x"], f""", r AS (SELECT strategy, bucket, count(*) AS n, avg(brief_tokens + 200 + greatest(1, length(query) // 4)) AS t
    FROM {_BOTH.format(t='briefs_x')} GROUP BY ALL)
    SELECT strategy, bucket, n AS n_pairs, round(t, 1) AS avg_input_tokens, round(t / 1e6 * 3 + 180 / 1e6 * 15, 6) AS usd_per_query,
    round((t / 1e6 * 3 + 180 / 1e6 * 15) * 100, 4) AS usd_per_100q FROM r"""),
)
def _(spark, sf):
    briefs, _, pairs = judged(spark, sf)
    return E.brief_cost(briefs, pairs)


@query(
    "hybrid_against_naive",
    rsql(["scored"], """SELECT count(*) FILTER (h.quality > n.quality) AS champion_wins, count(*) FILTER (h.quality = n.quality) AS ties,
    count(*) FILTER (h.quality < n.quality) AS baseline_wins FROM scored h JOIN scored n ON n.pair_id = h.pair_id
    AND n.strategy = 'naive_dump' WHERE h.strategy = 'hybrid'"""),
)
def _(spark, sf):
    return E.head_to_head(judged(spark, sf, ("hybrid", "naive_dump"))[1], "hybrid", "naive_dump")


@query(
    "fact_pairs",
    D.sql(["pairs"], "SELECT pair_id FROM pairs WHERE intent NOT IN ('greeting', 'courtesy') ORDER BY pair_id LIMIT 50"),
)
def _(spark, sf):
    return E.fact_subset(N.histories(spark, sf)[0])


@query(
    "headline_ratios",
    rsql(["scored"], """, s AS (SELECT strategy, round((avg(brief_tokens + 200 + greatest(1, length(query) // 4)) / 1e6 * 3 + 180 / 1e6 * 15) * 100, 4) AS usd,
    round(avg(quality), 3) AS q, list(latency_ms ORDER BY latency_ms) AS x, count(*) AS n FROM scored GROUP BY strategy)
    SELECT round((1 - h.usd / b.usd) * 100, 1) AS cost_reduction_pct,
    round(round(b.x[b.n // 2 + 1], 4) / greatest(round(h.x[h.n // 2 + 1], 4), 1e-6), 2) AS speedup, round(h.q - b.q, 3) AS quality_delta
    FROM s h, s b WHERE h.strategy = 'hybrid' AND b.strategy = 'naive_dump'"""),
)
def _(spark, sf):
    briefs, scores, pairs = judged(spark, sf, ("hybrid", "naive_dump"))
    return E.headline(E.brief_cost(briefs, pairs), E.quality_summary(scores), E.brief_summary(briefs), "hybrid", "naive_dump")


@query(
    "quality_per_token",
    rsql(["scored"], """, s AS (SELECT strategy, round(avg(quality), 3) AS q, round(avg(brief_tokens), 1) AS t FROM scored GROUP BY strategy)
    SELECT strategy, round(q * 1000 / t, 3) AS quality_per_1k_tokens, round(t / q, 1) AS tokens_per_quality_unit FROM s"""),
)
def _(spark, sf):
    briefs, scores, _ = judged(spark, sf)
    return E.quality_per_token(E.quality_summary(scores), E.brief_summary(briefs))


# ---- load and latency ---------------------------------------------------------------------------


def samples(spark, sf):
    e = T.events(spark, sf)
    down = (F.col("event_type") == "anomaly_detected") & (F.col("event_id") % 4 == 0)
    return e.select(
        "tenant_id", "channel_code", "event_type", F.when(down, 500).otherwise(202).alias("status"),
        (F.col("value") / 1000).alias("latency_s"),
    )


D.part(
    "smp",
    ["evt"],
    """SELECT tenant_id, event_type, CASE WHEN event_type = 'anomaly_detected' AND event_id % 4 = 0 THEN 500 ELSE 202 END AS status,
    value / 1000 AS latency_s FROM evt""",
)


@query(
    "load_summary",
    D.sql(["smp"], """, r AS (SELECT * FROM smp UNION ALL SELECT * REPLACE ('*' AS tenant_id) FROM smp)
    SELECT tenant_id, count(*) AS n, count(*) FILTER (status BETWEEN 200 AND 299) AS n_ok, round(count(*) / 60.0, 6) AS rps,
    round(count(*) FILTER (status BETWEEN 200 AND 299) / count(*), 6) AS success_rate,
    round(quantile_cont(latency_s * 1000, 0.5), 6) AS p50_ms, round(quantile_cont(latency_s * 1000, 0.95), 6) AS p95_ms,
    round(quantile_cont(latency_s * 1000, 0.99), 6) AS p99_ms, round(max(latency_s * 1000), 6) AS max_ms FROM r GROUP BY tenant_id"""),
)
def _(spark, sf):
    return E.load_summary(samples(spark, sf), 60.0)


@query("load_by_event_type", D.sql(["smp"], "SELECT event_type AS value, 'event_type' AS dimension, count(*) AS n FROM smp GROUP BY event_type"))
def _(spark, sf):
    return E.manifest_counts(samples(spark, sf), ["event_type"])


@query(
    "latency_stats",
    D.sql(["evt"], """SELECT event_type, count(*) AS n, round(min(value), 4) AS min, round(quantile_cont(value, 0.5), 4) AS p50,
    round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99, round(max(value), 4) AS max,
    round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS stdev FROM evt GROUP BY event_type"""),
)
def _(spark, sf):
    return E.latency_stats(T.events(spark, sf), ["event_type"], "value")


# ---- dataset preparation ------------------------------------------------------------------------


@query("carved_dialogues", D.sql(["carved"], "SELECT conv_id, lt AS last_turn, md5(query) AS q, md5(truth) AS t FROM carved"))
def _(spark, sf):
    c = N.carve(T.dialogues(spark, sf))
    return c.select("conv_id", "last_turn", F.md5("query").alias("q"), F.md5("ground_truth").alias("t"))


@query(
    "long_dialogues",
    """SELECT conv_id, count(*) FILTER (role = 'user') AS n_user, count(*) AS n_turns FROM conversations GROUP BY conv_id
    HAVING count(*) FILTER (role = 'user') >= 3""",
)
def _(spark, sf):
    return N.enough_user_turns(T.dialogues(spark, sf))


@query(
    "padded_histories",
    D.sql(
        ["lastu"],
        """, d AS (SELECT conv_id, row_number() OVER (ORDER BY conv_id) AS pos, greatest(1, lt) AS n FROM lastu),
    s AS (SELECT pos, 'p' || conv_id AS pair_id, lead(pos, 1, 1000000000) OVER (ORDER BY pos) AS nxt FROM d WHERE pos % 4 = 1),
    r AS (SELECT s.pair_id, d.conv_id, d.n, d.pos - s.pos AS days_back, sum(d.n) OVER (PARTITION BY s.pair_id ORDER BY d.pos) - d.n AS before
        FROM s JOIN d ON d.pos >= s.pos AND d.pos < s.nxt)
    SELECT pair_id, conv_id, days_back, n AS n_messages, CASE WHEN days_back = 0 THEN n ELSE greatest(0, least(n, 12 - before)) END::BIGINT AS n_kept
    FROM r WHERE days_back = 0 OR before < 10""",
    ),
)
def _(spark, sf):
    """Every fourth dialogue is a primary, padded with the ones after it to 10-12 messages."""
    from convspark.functions.scale import sliced_rank

    last = N.carve(T.dialogues(spark, sf)).select("conv_id", F.greatest(F.lit(1), F.col("last_turn")).alias("n_messages"))
    pool = sliced_rank(last, [], [F.col("conv_id")], F.floor(F.col("conv_id") / 4096), "pool_pos")
    starts = pool.filter(F.col("pool_pos") % 4 == 1).select(F.concat(F.lit("p"), "conv_id").alias("pair_id"), "pool_pos")
    return N.pad_histories(pool, starts, 10, 12)


@query(
    "manifest_counts",
    D.sql(
        ["scen_x"],
        " UNION ALL ".join(
            f"SELECT '{d}' AS dimension, {d} AS value, count(*) AS n FROM scen_x GROUP BY {d}"
            for d in ("tenant_id", "event_type", "action_type", "difficulty", "expected_decision")
        ),
    ),
)
def _(spark, sf):
    from convspark.operators import policy as P
    from convspark.queries.ingest_queries import scenarios

    s = P.declarative(scenarios(spark, sf), T.policy_rules(spark), "expected_decision")
    return E.manifest_counts(s, ["tenant_id", "event_type", "action_type", "difficulty", "expected_decision"])


@query(
    "content_digest",
    D.sql(
        ["evt"],
        """, h AS (SELECT sha256(concat_ws('|', event_id, tenant_id, event_type, idempotency_key)) AS h FROM evt),
    s AS (SELECT count(*) AS n, sum(('0x' || substr(h, 1, 12))::BIGINT::HUGEINT) AS a, sum(('0x' || substr(h, 13, 12))::BIGINT::HUGEINT) AS b FROM h)
    SELECT n, sha256(n || ':' || a || ':' || b) AS digest FROM s""",
    ),
)
def _(spark, sf):
    line = F.concat_ws("|", "event_id", "tenant_id", "event_type", "idempotency_key")
    return E.content_digest(T.events(spark, sf), line)
