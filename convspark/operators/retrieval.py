"""History ranking strategies.

Every strategy returns one row per segment: the key columns, ``source``, ``body``, ``token_estimate``, ``priority``
and the tie columns ``ord`` and ``seq``. The reading order of a key is (priority desc, ord, seq); it needs no global
sort, so a customer holding a large share of all rows stays spread over tasks. ``ranked`` adds the position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convspark import values as V
from convspark.functions import text as X
from convspark.functions.scale import sliced_rank, top_rank
from convspark.functions.vectors import bag_cosine

KEYS = ["tenant_id", "customer_id", "pair_id"]
SEGMENT = ["source", "ord", "seq", "ts", "body", "token_estimate", "priority", "similarity"]


def _epoch(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1e6)


def message_rows(messages: DataFrame, keys: list[str]) -> DataFrame:
    body = X.message_line(*[F.col(c) for c in ("channel", "ts", "sender", "content", "subject", "attachments")])
    return messages.select(
        *keys,
        "seq",
        "ts",
        body.alias("body"),
        F.col("content").alias("text"),
        X.plain_line(*[F.col(c) for c in ("channel", "ts", "sender", "content")]).alias("line"),
    )


def action_rows(actions: DataFrame, keys: list[str]) -> DataFrame:
    return actions.select(
        *keys,
        "seq",
        "ts",
        X.action_line(F.col("ts"), F.col("action_type"), F.col("details")).alias("body"),
        X.action_text(F.col("action_type"), F.col("details")).alias("text"),
    )


def _segments(rows: DataFrame, keys: list[str], source: str, ord_: int, priority: Column, similarity=None) -> DataFrame:
    return rows.select(
        *keys,
        F.lit(source).alias("source"),
        F.lit(ord_).alias("ord"),
        F.col("seq").cast("long").alias("seq"),
        "ts",
        "body",
        X.estimate_tokens(F.col("body")).alias("token_estimate"),
        priority.cast("double").alias("priority"),
        (F.lit(None) if similarity is None else similarity).cast("double").alias("similarity"),
    )


def reading_order(columns: list[str] | None = None) -> list[Column]:
    return [F.col("priority").desc(), F.col("ord"), F.col("seq")]


def ranked(segments: DataFrame, keys: list[str] = KEYS, slices: Column | None = None) -> DataFrame:
    """Add the position in reading order. The default slice is the day of a time-like priority."""
    slices = F.floor(-F.col("priority") / 86400) if slices is None else slices
    return sliced_rank(segments, keys, reading_order(), slices)


def recency(messages: DataFrame, actions: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Newest first; an action counts as one second newer than it is."""
    acts = _segments(action_rows(actions, keys), keys, "prior_action", 0, _epoch(F.col("ts")) + 1.0)
    return acts.unionByName(
        _segments(message_rows(messages, keys), keys, "recent_message", 1, _epoch(F.col("ts")))
    )


def naive_dump(messages: DataFrame, actions: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Chronological, oldest first: priority is the negated time, so the common reading order applies."""
    msgs = _segments(message_rows(messages, keys), keys, "recent_message", 0, -_epoch(F.col("ts")))
    return msgs.unionByName(_segments(action_rows(actions, keys), keys, "prior_action", 1, -_epoch(F.col("ts"))))


def _scored(rows: DataFrame, queries: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of keys that have a query, with ``sim`` to it."""
    return rows.join(queries.select(*keys, "query"), keys).withColumn("sim", bag_cosine("text", "query")).drop("query")


def semantic(queries: DataFrame, messages: DataFrame, actions: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Hashed bag-of-words cosine to the query, newest first among equals."""
    rank = F.col("sim") + _epoch(F.col("ts")) * F.lit(V.TIME_TIEBREAK)
    msgs = _scored(message_rows(messages, keys).drop("line"), queries, keys)
    acts = _scored(action_rows(actions, keys), queries, keys)
    return _segments(msgs, keys, "semantic_match", 0, rank, F.round("sim", 6)).unionByName(
        _segments(acts, keys, "prior_action", 1, rank, F.round("sim", 6))
    )


def _summary(cold_newest_first: DataFrame, keys: list[str], summariser: X.Summariser) -> DataFrame:
    """One SUMMARY segment per key from its cold messages."""
    block = cold_newest_first.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("cold_rank", "line"))).alias("lines"), F.max("ts").alias("ts")
    )
    body = F.concat(
        F.lit("[summary] "), summariser.text(F.array_join(F.transform("lines", lambda s: s["line"]), "\n"))
    )
    rows = block.select(*keys, F.lit(0).alias("seq"), "ts", body.alias("body"))
    return _segments(rows, keys, "summary", 0, F.lit(V.SUMMARY_BAND))


def _newest(rows: DataFrame, keys: list[str], n: int | None, name: str) -> DataFrame:
    """The newest ``n`` rows per key, or all; the literal limit is applied map-side before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.col("ts").desc(), F.col("seq"))
    numbered = rows.withColumn(name, F.row_number().over(w))
    return numbered if n is None else numbered.filter(F.col(name) <= n)


def summarized(
    messages: DataFrame,
    actions: DataFrame,
    recent_window: int = 5,
    keys: list[str] = KEYS,
    summariser: X.Summariser = X.HEAD,
) -> DataFrame:
    """Newest ``recent_window`` messages verbatim, one summary of the rest, every action."""
    msgs = message_rows(messages, keys)
    head = _newest(msgs, keys, None if summariser.reads is None else recent_window + summariser.reads, "r")
    warm = head.filter(F.col("r") <= recent_window)
    cold = head.filter(F.col("r") > recent_window).withColumn("cold_rank", F.col("r"))
    acts = _segments(action_rows(actions, keys), keys, "prior_action", 1, F.lit(V.ACTION_BAND) + _epoch(F.col("ts")))
    return (
        _summary(cold, keys, summariser)
        .unionByName(acts)
        .unionByName(_segments(warm, keys, "recent_message", 2, _epoch(F.col("ts"))))
    )


def tiers(
    messages: DataFrame, actions: DataFrame, warm_hours: int = 24, cold_hours: int = 72, keys: list[str] = KEYS
) -> DataFrame:
    """Messages with ``tier`` warm / mid / cold, measured from the newest message or action of the key."""
    if cold_hours <= warm_hours:
        raise ValueError(f"cold_hours ({cold_hours}) must be > warm_hours ({warm_hours})")
    newest = (
        messages.select(*keys, "ts").unionByName(actions.select(*keys, "ts")).groupBy(*keys).agg(F.max("ts").alias("ref"))
    )
    age = F.col("ref") - F.col("ts")
    hours = lambda h: F.make_dt_interval(F.lit(0), F.lit(h))
    tier = F.when(age <= hours(warm_hours), "warm").when(age <= hours(cold_hours), "mid").otherwise("cold")
    return message_rows(messages, keys).join(newest, keys).withColumn("tier", tier).drop("ref")


def hybrid(
    queries: DataFrame,
    messages: DataFrame,
    actions: DataFrame,
    warm_hours: int = 24,
    cold_hours: int = 72,
    keys: list[str] = KEYS,
    summariser: X.Summariser = X.HEAD,
) -> DataFrame:
    """Summary of the cold tail, all actions, warm messages verbatim, mid messages by similarity."""
    tiered = tiers(messages, actions, warm_hours, cold_hours, keys)
    cold = _newest(tiered.filter("tier = 'cold'"), keys, summariser.reads, "cold_rank")
    acts = _segments(action_rows(actions, keys), keys, "prior_action", 1, F.lit(V.ACTION_BAND) + _epoch(F.col("ts")))
    # warm and mid rows in one pass: the tier decides source, priority and whether there is a cosine
    asked = queries.select(*keys, "query", F.lit(True).alias("asked"))
    live = tiered.filter("tier != 'cold'").drop("line").join(asked, keys, "left")
    warm = F.col("tier") == "warm"
    live = live.filter(warm | F.col("asked"))
    live = live.withColumn("sim", bag_cosine(F.when(~warm, F.col("text")), F.when(~warm, F.col("query"))))
    live = live.withColumn("sim", F.when(~warm, F.col("sim")))
    near = F.col("sim") + _epoch(F.col("ts")) * F.lit(V.TIME_TIEBREAK)
    rank = F.when(warm, F.lit(V.WARM_BAND) + _epoch(F.col("ts"))).otherwise(near)
    rows = _segments(live.withColumn("rank", rank), [*keys, "tier"], "", 0, F.col("rank"), F.round("sim", 6))
    rows = rows.withColumns(
        {"source": F.when(warm, "recent_message").otherwise("semantic_match"), "ord": F.when(warm, 2).otherwise(3)}
    )
    return _summary(cold, keys, summariser).unionByName(acts).unionByName(rows.drop("tier"))


def rerank(
    queries: DataFrame,
    messages: DataFrame,
    actions: DataFrame,
    now: Column,
    top_k: int = V.RERANK_TOP_K,
    keys: list[str] = KEYS,
    first: DataFrame | None = None,
) -> DataFrame:
    """Semantic ranking whose first ``top_k`` rows are rescored; adds ``stage`` (head/tail) and ``rerank_score``.

    Head rows come first. A blank query leaves the semantic result unchanged (stage is null). ``first``: the result of
    ``semantic`` for the same histories, where it is there already.
    """
    first = semantic(queries, messages, actions, keys) if first is None else first
    base = top_rank(first, keys, reading_order(), top_k, "semantic_rank")
    blank = X.strip(F.coalesce(F.col("query"), F.lit(""))) == ""
    qtok = queries.select(*keys, X.tokens(F.col("query")).alias("q"), blank.alias("q_blank"))
    weight = V.RERANK_WEIGHTS

    def score(t: Column) -> Column:
        return (
            F.lit(weight["cosine"]) * F.col("similarity")
            + F.lit(weight["bigram"]) * X.jaccard(X.bigrams(F.col("q")), X.bigrams(t))
            + F.lit(weight["jaccard"]) * X.jaccard(F.array_distinct("q"), F.array_distinct(t))
            + F.lit(weight["recency"]) * X.recency_decay(F.col("ts"), now)
        )

    joined = base.join(qtok, keys)
    in_head = F.col("semantic_rank").isNotNull() & ~F.col("q_blank")
    joined = joined.withColumn("rerank_score", F.when(in_head, X.let(X.tokens(F.col("body")), score)))
    stage = F.when(~F.col("q_blank"), F.when(F.col("rerank_score").isNotNull(), "head").otherwise("tail"))
    return joined.select(
        *keys,
        "source",
        # the head keeps its first-stage order among equal scores and precedes the tail
        F.when(stage == "head", F.col("semantic_rank").cast("int")).otherwise(F.col("ord") + 1000000).alias("ord"),
        "seq",
        "ts",
        "body",
        "token_estimate",
        F.coalesce("rerank_score", "priority").alias("priority"),
        "similarity",
        stage.alias("stage"),
        F.round("rerank_score", 6).alias("rerank_score"),
        F.coalesce(stage == "head", F.lit(False)).cast("int").alias("is_head"),
    )


# ---- strategy table -----------------------------------------------------------------------------

STRATEGY_BUDGETS: dict[str, int | None] = {
    "recency": None,
    "semantic": None,
    "summarized": None,
    "hybrid": None,
    "rerank": None,
    "naive_dump": V.NAIVE_BUDGET,
}


def strategy_budget(name: str, default: int, overrides: dict[str, int | None] | None = None) -> int:
    """A strategy's own budget where it has one, else the run's default; unknown names fail."""
    table = STRATEGY_BUDGETS if overrides is None else overrides
    if name not in table:
        raise KeyError(f"unknown strategy {name!r}")
    own = table[name]
    if own is not None and own <= 0:
        raise ValueError(f"token budget of {name!r} must be positive, got {own}")
    return default if own is None else own


def run_strategy(
    name: str, queries: DataFrame, messages: DataFrame, actions: DataFrame, now=None, first: DataFrame | None = None
) -> DataFrame:
    """The segments of a strategy; ``first`` is the semantic result, for those that begin with it."""
    if name == "recency":
        return recency(messages, actions)
    if name == "naive_dump":
        return naive_dump(messages, actions)
    if name == "semantic":
        return semantic(queries, messages, actions) if first is None else first
    if name == "summarized":
        return summarized(messages, actions)
    if name == "hybrid":
        return hybrid(queries, messages, actions)
    if name == "rerank":
        out = rerank(queries, messages, actions, now, first=first)
        # the head precedes the tail whatever the scores are
        return out.withColumn("priority", F.col("priority") + F.col("is_head") * F.lit(1e3))
    raise KeyError(f"unknown strategy {name!r}")
