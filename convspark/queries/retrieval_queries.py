"""Retrieval strategies and packing (survey 2.5, 2.6)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convspark import values as V
from convspark.operators import packing, retrieval as R
from convspark.plans import prepare
from convspark.queries import duck as D
from convspark.session import cut_lineage
from convspark.sources import tables as T

QUERIES, ORACLE = {}, {}
NOW = "2024-02-01 00:00:00"
TIGHT = 600


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return register


# ---- oracle parts: one per strategy, columns pair_id, customer_id, tenant_id, source, ord, seq, body, priority -----

_ROW = "pair_id, tenant_id, customer_id"
D.part(
    "s_recency",
    ["hm", "ha"],
    f"""SELECT {_ROW}, 'prior_action' AS source, 0 AS ord, seq, body, epoch_us(ts) / 1e6 + 1.0 AS priority FROM ha
    UNION ALL SELECT {_ROW}, 'recent_message', 1, seq, body, epoch_us(ts) / 1e6 FROM hm""",
)
D.part(
    "s_naive_dump",
    ["hm", "ha"],
    f"""SELECT {_ROW}, 'recent_message' AS source, 0 AS ord, seq, body, -epoch_us(ts) / 1e6 AS priority FROM hm
    UNION ALL SELECT {_ROW}, 'prior_action', 1, seq, body, -epoch_us(ts) / 1e6 FROM ha""",
)
D.part(
    "hrows",
    ["hm", "ha"],
    f"""SELECT {_ROW}, 0 AS kind, seq, ts, body, content AS text FROM hm
    UNION ALL SELECT {_ROW}, 1, seq, ts, body, text FROM ha""",
)
D.part(
    "hbow",
    ["hrows"],
    f"""SELECT pair_id, kind, seq, {D.fnv('token')} % 4096 AS b, count(*) AS c FROM
    (SELECT pair_id, kind, seq, unnest({D.tok('text')}) AS token FROM hrows) GROUP BY ALL""",
)
D.part(
    "qbow",
    ["pairs"],
    f"""SELECT pair_id, {D.fnv('token')} % 4096 AS b, count(*) AS c FROM
    (SELECT pair_id, unnest({D.tok('query')}) AS token FROM pairs) GROUP BY ALL""",
)
D.part(
    "hsim",
    ["hrows", "hbow", "qbow"],
    """SELECT r.*, coalesce(d.dot / (qn.n * hn.n), 0.0) AS sim FROM hrows r
    LEFT JOIN (SELECT h.pair_id, kind, seq, sum(h.c * q.c) AS dot FROM hbow h JOIN qbow q
        ON h.pair_id = q.pair_id AND h.b = q.b GROUP BY ALL) d
        ON d.pair_id = r.pair_id AND d.kind = r.kind AND d.seq = r.seq
    LEFT JOIN (SELECT pair_id, kind, seq, sqrt(sum(c * c)) AS n FROM hbow GROUP BY ALL) hn
        ON hn.pair_id = r.pair_id AND hn.kind = r.kind AND hn.seq = r.seq
    LEFT JOIN (SELECT pair_id, sqrt(sum(c * c)) AS n FROM qbow GROUP BY ALL) qn ON qn.pair_id = r.pair_id""",
)
D.part(
    "s_semantic",
    ["hsim"],
    f"""SELECT {_ROW}, CASE kind WHEN 0 THEN 'semantic_match' ELSE 'prior_action' END AS source, kind AS ord, seq, body,
    sim + epoch_us(ts) / 1e6 * 1e-12 AS priority, round(sim, 6) AS similarity, ts FROM hsim""",
)
_SUMMARY = (
    "'[summary] ' || left(string_agg(line, chr(10) ORDER BY ts DESC, seq), 200) || '...[mock-summary]'"
)
D.part(
    "s_summarized",
    ["hm", "ha"],
    f"""SELECT {_ROW}, 'summary' AS source, 0 AS ord, 0 AS seq, {_SUMMARY} AS body, 1e18 AS priority FROM
        (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY ts DESC, seq) AS r FROM hm) WHERE r > 5 GROUP BY ALL
    UNION ALL SELECT {_ROW}, 'prior_action', 1, seq, body, 1e12 + epoch_us(ts) / 1e6 FROM ha
    UNION ALL SELECT {_ROW}, 'recent_message', 2, seq, body, epoch_us(ts) / 1e6 FROM
        (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY ts DESC, seq) AS r FROM hm) WHERE r <= 5""",
)
D.part(
    "tiered",
    ["hm", "hrows"],
    """SELECT m.*, CASE WHEN m.ts >= x.ref - INTERVAL 24 HOUR THEN 'warm'
        WHEN m.ts >= x.ref - INTERVAL 72 HOUR THEN 'mid' ELSE 'cold' END AS tier
    FROM hm m JOIN (SELECT pair_id, max(ts) AS ref FROM hrows GROUP BY pair_id) x ON x.pair_id = m.pair_id""",
)
D.part(
    "s_hybrid",
    ["tiered", "ha", "hsim"],
    f"""SELECT {_ROW}, 'summary' AS source, 0 AS ord, 0 AS seq, {_SUMMARY} AS body, 1e18 AS priority FROM tiered
        WHERE tier = 'cold' GROUP BY ALL
    UNION ALL SELECT {_ROW}, 'prior_action', 1, seq, body, 1e12 + epoch_us(ts) / 1e6 FROM ha
    UNION ALL SELECT {_ROW}, 'recent_message', 2, seq, body, 1e6 + epoch_us(ts) / 1e6 FROM tiered WHERE tier = 'warm'
    UNION ALL SELECT t.pair_id, t.tenant_id, t.customer_id, 'semantic_match', 3, t.seq, t.body,
        s.sim + epoch_us(t.ts) / 1e6 * 1e-12 FROM tiered t JOIN hsim s
        ON s.pair_id = t.pair_id AND s.kind = 0 AND s.seq = t.seq WHERE t.tier = 'mid'""",
)
_BI = "list_distinct(list_transform(range(1, greatest(len({t}), 1)), lambda i: {t}[i] || ' ' || {t}[i + 1]))"
_JAC = (
    "CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 0.0 ELSE "
    "len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"
)
D.part(
    "rr0",
    ["s_semantic", "pairs"],
    f"""SELECT s.*, row_number() OVER (PARTITION BY s.pair_id ORDER BY s.priority DESC, ord, seq) AS r,
    {D.tok('s.body')} AS t, {D.tok('p.query')} AS q, trim(p.query) = '' AS q_blank
    FROM s_semantic s JOIN pairs p ON p.pair_id = s.pair_id""",
)
D.part(
    "s_rerank",
    ["rr0"],
    f"""SELECT {_ROW}, source, CASE WHEN r <= 30 AND NOT q_blank THEN r ELSE ord + 1000000 END AS ord, seq, body,
    CASE WHEN r <= 30 AND NOT q_blank THEN 1000.0 ELSE 0.0 END + CASE WHEN r <= 30 AND NOT q_blank THEN
        similarity + 0.7 * {_JAC.format(a=_BI.format(t='q'), b=_BI.format(t='t'))}
        + 0.4 * {_JAC.format(a='list_distinct(q)', b='list_distinct(t)')}
        + 0.2 * pow(0.5, greatest(0.0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 86400e6) / 30.0)
        ELSE priority END AS priority,
    CASE WHEN q_blank THEN NULL WHEN r <= 30 THEN 'head' ELSE 'tail' END AS stage FROM rr0""",
)

_RANK = "row_number() OVER (PARTITION BY pair_id ORDER BY priority DESC, ord, seq) AS rank"
_OUT = "pair_id, source, seq, body, (length(body) // 4)::INT AS token_estimate"


def _ranked(segments, slices=None):
    return R.ranked(segments, slices=slices).select("pair_id", "source", "seq", "body", "token_estimate", "rank")


@query("recency_segments", D.sql(["s_recency"], f"SELECT {_OUT}, {_RANK} FROM s_recency"))
def _(spark, sf):
    _, messages, actions = prepare.histories(spark, sf)
    return _ranked(R.recency(messages, actions))


@query("naive_dump_segments", D.sql(["s_naive_dump"], f"SELECT {_OUT}, {_RANK} FROM s_naive_dump"))
def _(spark, sf):
    _, messages, actions = prepare.histories(spark, sf)
    return _ranked(R.naive_dump(messages, actions))


@query(
    "semantic_segments",
    D.sql(["s_semantic"], f"SELECT {_OUT}, round(priority, 6) AS priority, similarity FROM s_semantic"),
)
def _(spark, sf):
    pairs, messages, actions = prepare.histories(spark, sf)
    s = R.semantic(pairs, messages, actions)
    return s.select(
        "pair_id", "source", "seq", "body", "token_estimate", F.round("priority", 6).alias("priority"), "similarity"
    )


@query(
    "semantic_top_segments",
    D.sql(["s_semantic"], f"SELECT * FROM (SELECT pair_id, source, seq, {_RANK} FROM s_semantic) WHERE rank <= 30"),
)
def _(spark, sf):
    """First-stage candidates of the re-ranker."""
    from pyspark.sql import Window

    pairs, messages, actions = prepare.histories(spark, sf)
    w = Window.partitionBy(*R.KEYS).orderBy(*R.reading_order())
    top = R.semantic(pairs, messages, actions).withColumn("rank", F.row_number().over(w))
    return top.filter(F.col("rank") <= V.RERANK_TOP_K).select("pair_id", "source", "seq", "rank")


@query("summarized_segments", D.sql(["s_summarized"], f"SELECT {_OUT}, {_RANK} FROM s_summarized"))
def _(spark, sf):
    _, messages, actions = prepare.histories(spark, sf)
    return _ranked(R.summarized(messages, actions))


@query("history_tiers", D.sql(["tiered"], "SELECT pair_id, seq, tier FROM tiered"))
def _(spark, sf):
    _, messages, actions = prepare.histories(spark, sf)
    return R.tiers(messages, actions).select("pair_id", "seq", "tier")


@query("hybrid_segments", D.sql(["s_hybrid"], f"SELECT {_OUT}, {_RANK} FROM s_hybrid"))
def _(spark, sf):
    pairs, messages, actions = prepare.histories(spark, sf)
    # below the time bands the priority is a similarity, so those rows are sliced by thousandths of it
    p = F.col("priority")
    slices = F.when(p < 1000, -F.floor(p * 1000)).otherwise(F.floor(-p / 86400) - 2000)
    return _ranked(R.hybrid(pairs, messages, actions), slices)


@query(
    "rerank_segments",
    D.sql(["s_rerank"], f"SELECT {_OUT}, round(priority, 6) AS priority, stage FROM s_rerank"),
)
def _(spark, sf):
    pairs, messages, actions = prepare.histories(spark, sf)
    s = R.run_strategy("rerank", pairs, messages, actions, F.lit(NOW).cast("timestamp"))
    return s.select(
        "pair_id", "source", "seq", "body", "token_estimate", F.round("priority", 6).alias("priority"), "stage"
    )


# ---- packing: the oracle walks each pair's list with a recursive CTE ---------------------------------------------

_ORDERED = "row_number() OVER (PARTITION BY pair_id ORDER BY priority DESC, ord, seq) AS r"
_HEAD = "'Borrower: ' || customer_id || ' (tenant=' || tenant_id || ')'"


def pack_sql(strategy: str, budget: int, name: str) -> str:
    """Register WITH parts that pack ``strategy``; the last one, ``name``, has one brief per pair."""
    D.part(
        f"{name}_seq",
        [f"s_{strategy}"],
        f"SELECT pair_id, {_ORDERED}, source, body, length(body) // 4 + 1 AS cost FROM s_{strategy}",
    )
    D.part(
        f"{name}_heads",
        ["pairs"],
        f"""SELECT pair_id, CASE WHEN length({_HEAD}) // 4 + 1 <= {budget} THEN {_HEAD} END AS head,
        CASE WHEN length({_HEAD}) // 4 + 1 <= {budget} THEN length({_HEAD}) // 4 + 1 ELSE 0 END AS head_cost FROM pairs""",
    )
    D.part(
        f"{name}_walk",
        [f"{name}_seq", f"{name}_heads"],
        f"""SELECT pair_id, 0::BIGINT AS r, head_cost::BIGINT AS used, head AS brief, 0 AS n_kept FROM {name}_heads
        UNION ALL SELECT w.pair_id, s.r, CASE WHEN w.used + s.cost <= {budget} THEN w.used + s.cost ELSE w.used END,
        CASE WHEN w.used + s.cost <= {budget} THEN concat_ws(chr(10), w.brief, s.body) ELSE w.brief END,
        CASE WHEN w.used + s.cost <= {budget} THEN w.n_kept + 1 ELSE w.n_kept END
        FROM {name}_walk w JOIN {name}_seq s ON s.pair_id = w.pair_id AND s.r = w.r + 1""",
    )
    return D.part(
        name,
        [f"{name}_walk"],
        f"""SELECT pair_id, {budget} AS token_budget, coalesce(brief, '') AS brief_text, n_kept, used AS used_tokens,
        length(coalesce(brief, '')) // 4 AS brief_tokens FROM
        (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY r DESC) AS z FROM {name}_walk) WHERE z = 1""",
    )


def briefs(spark, sf, strategy: str, budget: int):
    pairs, messages, actions = prepare.histories(spark, sf)
    segments = R.run_strategy(strategy, pairs, messages, actions, F.lit(NOW).cast("timestamp"))
    groups = packing.brief_groups(pairs, F.lit(budget))
    return packing.pack(segments, groups, R.KEYS, budget), segments, pairs


_BRIEF = "pair_id, token_budget, md5(brief_text) AS brief_md5, n_kept, used_tokens::INT AS used_tokens, brief_tokens::INT AS brief_tokens"


def _brief_out(b):
    return b.select("pair_id", "token_budget", F.md5("brief_text").alias("brief_md5"), "n_kept", "used_tokens", "brief_tokens")


def _register_brief(name, strategy, budget):
    part = pack_sql(strategy, budget, f"b_{strategy}_{budget}")

    @query(name, D.sql([part], f"SELECT {_BRIEF} FROM {part}", recursive=True))
    def _(spark, sf):
        return _brief_out(briefs(spark, sf, strategy, budget)[0])


for _s in ("recency", "semantic", "summarized", "hybrid", "rerank"):
    _register_brief(f"{_s}_briefs", _s, V.DEFAULT_BUDGET)
    _register_brief(f"{_s}_briefs_tight", _s, TIGHT)
_register_brief("naive_dump_briefs", "naive_dump", V.NAIVE_BUDGET)


@query(
    "brief_budget_check",
    D.sql(
        ["b_recency_600"],
        "SELECT count(*) AS n_briefs, count(*) FILTER (brief_tokens > token_budget) AS n_over FROM b_recency_600",
        recursive=True,
    ),
)
def _(spark, sf):
    """The tail trim of the packer is unreachable: no brief is ever over its budget."""
    b = briefs(spark, sf, "recency", TIGHT)[0]
    return b.agg(F.count("*").alias("n_briefs"), F.count_if("over_budget").alias("n_over"))


@query(
    "brief_source_counts",
    D.sql(
        ["b_hybrid_600"],
        """SELECT s.pair_id, s.source, count(*) AS n_in_brief FROM s_hybrid s JOIN b_hybrid_600 b ON b.pair_id = s.pair_id
        WHERE contains(b.brief_text, s.body) GROUP BY ALL""",
        recursive=True,
    ),
)
def _(spark, sf):
    b, segments, _ = briefs(spark, sf, "hybrid", TIGHT)
    return packing.source_counts(segments, b, R.KEYS).select("pair_id", "source", "n_in_brief")


def run_all(spark, sf, default_budget: int = V.DEFAULT_BUDGET, strategies=tuple(R.STRATEGY_BUDGETS)):
    """The given strategies on every pair, each under its own budget or the run's default."""
    pairs, messages, actions = prepare.histories(spark, sf, several=len(strategies) > 1)
    now = F.lit(NOW).cast("timestamp")
    # every text is compared with its query once, whatever number of strategies begins with that
    both = {"semantic", "rerank"} <= set(strategies)
    first = cut_lineage(R.semantic(pairs, messages, actions)) if both else None
    keys, by_budget = ["strategy", *R.KEYS], {}
    for name in strategies:
        by_budget.setdefault(R.strategy_budget(name, default_budget), []).append(name)
    packed = []
    for budget, names in by_budget.items():  # strategies of one budget are packed together
        tag = lambda name: F.lit(name).alias("strategy")
        cols = [*R.KEYS, "source", "ord", "seq", "body", "token_estimate", "priority"]
        runs = [R.run_strategy(n, pairs, messages, actions, now, first).select(tag(n), *cols) for n in names]
        groups = [packing.brief_groups(pairs, F.lit(budget), [tag(n)]) for n in names]
        packed.append(packing.pack(reduce(DataFrame.unionByName, runs), reduce(DataFrame.unionByName, groups), keys, budget))
    return reduce(DataFrame.unionByName, packed), pairs


_ALL = list(R.STRATEGY_BUDGETS)
D.part(
    "all_briefs",
    [f"b_{s}_{R.strategy_budget(s, V.DEFAULT_BUDGET)}" for s in _ALL],
    " UNION ALL ".join(
        f"SELECT {D.lit(s)} AS strategy, * FROM b_{s}_{R.strategy_budget(s, V.DEFAULT_BUDGET)}" for s in _ALL
    ),
)


@query(
    "all_strategy_briefs",
    D.sql(["all_briefs"], f"SELECT strategy, {_BRIEF} FROM all_briefs", recursive=True),
)
def _(spark, sf):
    b, _ = run_all(spark, sf)
    return b.select(
        "strategy", "pair_id", "token_budget", F.md5("brief_text").alias("brief_md5"), "n_kept", "used_tokens", "brief_tokens"
    )
