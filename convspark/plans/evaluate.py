"""Scores, summaries, cost and comparison tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convspark import values as V
from convspark.functions import text as X
from convspark.functions.scale import order_statistics

# ---- policy study -------------------------------------------------------------------------------


def policy_results(decided: DataFrame) -> DataFrame:
    return decided.withColumn("correct", F.col("decision") == F.col("expected_decision"))


def correctness(results: DataFrame) -> DataFrame:
    """Share of right decisions per strategy and per tenant, event type and expected decision, in one pass."""
    return (
        results.groupingSets(
            [["strategy"], ["strategy", "tenant_id"], ["strategy", "event_type"], ["strategy", "expected_decision"]],
            "strategy",
            "tenant_id",
            "event_type",
            "expected_decision",
        )
        .agg(
            F.grouping_id().alias("g"),
            F.count("*").alias("n"),
            F.avg(F.col("correct").cast("int")).alias("correctness"),
        )
        .select(
            "strategy",
            F.when(F.col("g") == 7, "all")
            .when(F.col("g") == 3, "tenant")
            .when(F.col("g") == 5, "event_type")
            .otherwise("expected_decision")
            .alias("dimension"),
            F.coalesce("tenant_id", "event_type", "expected_decision", F.lit("*")).alias("value"),
            "n",
            F.round("correctness", 4).alias("correctness"),
        )
    )


def confusion(results: DataFrame) -> DataFrame:
    table = results.groupBy("strategy", "expected_decision").pivot("decision", V.DECISIONS).count()
    return table.select("strategy", "expected_decision", *[F.coalesce(d, F.lit(0)).alias(f"observed_{d}") for d in V.DECISIONS])


def failed_preview(results: DataFrame, order: str, limit: int = 25) -> DataFrame:
    """First failures per strategy in scenario order, with the total; the literal limit prunes map-side."""
    bad = results.filter("NOT correct")
    w = Window.partitionBy("strategy").orderBy(order)
    totals = bad.groupBy("strategy").agg(F.count("*").alias("failed_total"))
    head = bad.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit)
    return head.join(totals, "strategy").select("strategy", "n", "scenario_id", "failed_total")


def decision_cost(results: DataFrame) -> DataFrame:
    """Model calls, cost per 100 decisions from the token counters, and the projection to production prompts."""
    usd = X.call_cost(F.col("t_in"), F.col("t_out"), F.lit(V.USD_PER_M_INPUT), F.lit(V.USD_PER_M_OUTPUT))
    per_call = (V.PROD_INPUT_TOKENS * V.USD_PER_M_INPUT + V.PROD_OUTPUT_TOKENS * V.USD_PER_M_OUTPUT) / 1e6
    sums = results.groupBy("strategy").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("input_tokens") > 0).alias("n_calls"),
        F.sum("input_tokens").alias("t_in"),
        F.sum("output_tokens").alias("t_out"),
        F.avg(F.col("correct").cast("int")).alias("correctness"),
    )
    return sums.select(
        "strategy",
        "n",
        "n_calls",
        F.round("correctness", 4).alias("correctness"),
        F.round(usd / F.col("n") * 100, 6).alias("usd_per_100"),
        F.round(F.lit(per_call) * 100 * F.col("n_calls") / F.col("n"), 4).alias("projected_usd_per_100"),
    )


def failure_shape(results: DataFrame, strategy: str, order: str) -> DataFrame:
    """Per tenant: failures and their most common (expected, observed); ties go to the pair seen first."""
    rows = results.filter(F.col("strategy") == strategy)
    per_tenant = rows.groupBy("tenant_id").agg(
        F.count("*").alias("n"),
        F.count_if("correct").alias("n_correct"),
        F.round(F.avg(F.col("correct").cast("int")), 3).alias("correctness"),
    )
    pairs = (
        rows.filter("NOT correct")
        .groupBy("tenant_id", "expected_decision", "decision")
        .agg(F.count("*").alias("c"), F.min(order).alias("seen"))
    )
    top = pairs.groupBy("tenant_id").agg(
        F.min(F.struct((-F.col("c")).alias("down"), "seen", "expected_decision", "decision")).alias("t")
    )
    return per_tenant.join(top, "tenant_id", "left").select(
        "tenant_id",
        "n",
        "n_correct",
        "correctness",
        (F.col("n") - F.col("n_correct")).alias("n_failures"),
        F.col("t.expected_decision").alias("top_expected"),
        F.col("t.decision").alias("top_observed"),
        (-F.col("t.down")).alias("top_count"),
    )


def with_rubric(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    rubric = spark.createDataFrame(
        [(s, a, m) for s, (a, m) in V.RUBRIC.items()], "strategy string, auditability int, maintainability int"
    )
    return rows.join(F.broadcast(rubric), "strategy", "left")


def frontier(costs: DataFrame) -> DataFrame:
    """One row per strategy, most correct first."""
    return with_rubric(costs).orderBy(F.col("correctness").desc(), "strategy")


# ---- brief study --------------------------------------------------------------------------------


def score(briefs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Quality 1-5 of each brief against its pair's query and true answer."""
    truth = pairs.select(
        "pair_id", X.recall_tokens(F.col("query")).alias("q"), X.recall_tokens(F.col("ground_truth")).alias("g")
    )
    rows = briefs.join(truth, "pair_id").withColumn("b", X.recall_tokens(F.col("brief_text")))
    rows = rows.withColumn("query_recall", X.recall(F.col("q"), F.col("b"))).withColumn(
        "truth_recall", X.recall(F.col("g"), F.col("b"))
    )
    combined = F.lit(0.5) * F.col("query_recall") + F.lit(0.5) * F.col("truth_recall")
    notes = F.concat_ws(
        ";",
        F.when(F.size("g") == 0, "gt_has_no_factual_tokens"),
        F.when(F.size("q") == 0, "query_has_no_factual_tokens"),
    )
    return rows.withColumn("quality", X.recall_score(combined)).withColumn("notes", notes).drop("q", "g", "b")


def quality_summary(scored: DataFrame) -> DataFrame:
    """Mean, median and histogram per strategy and per (strategy, bucket). Scores have five values, so the exact
    median needs no more than five counts per group."""
    hist = [F.count_if(F.col("quality") == k).alias(f"score_{k}") for k in range(1, 6)]
    return (
        scored.groupingSets([["strategy"], ["strategy", "bucket"]], "strategy", "bucket")
        .agg(
            F.count("*").alias("n_pairs"),
            F.round(F.avg("quality"), 3).alias("mean_quality"),
            F.percentile("quality", 0.5).alias("median_quality"),
            *hist,
        )
        .withColumn("bucket", F.coalesce("bucket", F.lit("*")))
    )


def attach_scores(results: DataFrame, scored: DataFrame) -> DataFrame:
    """Result rows with their score; rows that were not judged are kept."""
    cols = ["quality", "query_recall", "truth_recall", "notes"]
    return results.join(scored.select("strategy", "pair_id", *cols), ["strategy", "pair_id"], "left")


def _both(rows: DataFrame) -> DataFrame:
    """Rows per strategy and bucket, and again per strategy with bucket '*'."""
    return rows.withColumn("bucket", F.explode(F.array(F.col("bucket"), F.lit("*"))))


def brief_summary(briefs: DataFrame, latency: str = "latency_ms") -> DataFrame:
    """Tokens, latency percentiles and budget saturation per strategy and per (strategy, bucket)."""
    rows = _both(briefs)
    keys = ["strategy", "bucket"]
    means = rows.groupBy(*keys).agg(
        F.count("*").alias("n_pairs"),
        F.avg("brief_tokens").alias("mean_tokens"),
        F.max("token_budget").alias("budget"),
    )
    points = {"p50": ("upper_mid", 0.5), "p95": ("floor", 0.95)}
    stats = order_statistics(rows, keys, latency, points).select(*keys, "p50", "p95")
    return means.join(stats, keys).select(
        *keys,
        "n_pairs",
        F.col("budget").alias("effective_token_budget"),
        F.round("mean_tokens", 1).alias("avg_brief_tokens"),
        F.round("p50", 4).alias("latency_ms_p50"),
        F.round("p95", 4).alias("latency_ms_p95"),
        F.round(F.col("mean_tokens") / F.col("budget") * 100, 1).alias("budget_saturation_pct"),
    )


def brief_cost(briefs: DataFrame, pairs: DataFrame) -> DataFrame:
    """USD per query and per 100 queries, per strategy and per (strategy, bucket)."""
    asked = pairs.select("pair_id", X.query_tokens(F.col("query")).alias("q_tokens"))
    rows = _both(briefs.join(asked, "pair_id"))
    tokens_in = F.col("brief_tokens") + F.lit(V.SYSTEM_PROMPT_TOKENS) + F.col("q_tokens")
    means = rows.groupBy("strategy", "bucket").agg(F.count("*").alias("n_pairs"), F.avg(tokens_in).alias("t_in"))
    usd = X.call_cost(F.col("t_in"), F.lit(V.RESPONSE_TOKENS), F.lit(V.USD_PER_M_INPUT), F.lit(V.USD_PER_M_OUTPUT))
    return means.select(
        "strategy",
        "bucket",
        "n_pairs",
        F.round("t_in", 1).alias("avg_input_tokens"),
        F.round(usd, 6).alias("usd_per_query"),
        F.round(usd * 100, 4).alias("usd_per_100q"),
    )


def head_to_head(scored: DataFrame, champion: str, baseline: str) -> DataFrame:
    """Wins, ties and losses of the champion over pairs judged for both."""
    at = lambda s: F.max(F.when(F.col("strategy") == s, F.col("quality")))
    per_pair = scored.groupBy("pair_id").agg(at(champion).alias("c"), at(baseline).alias("b"))
    both = per_pair.filter("c IS NOT NULL AND b IS NOT NULL")
    return both.agg(
        F.count_if(F.col("c") > F.col("b")).alias("champion_wins"),
        F.count_if(F.col("c") == F.col("b")).alias("ties"),
        F.count_if(F.col("c") < F.col("b")).alias("baseline_wins"),
    )


def fact_subset(pairs: DataFrame, cap: int = 50) -> DataFrame:
    """First ``cap`` pair ids, by sort, whose intent carries facts (a top-k report)."""
    return pairs.filter(F.col("intent").isin(V.FACT_INTENTS)).select("pair_id").orderBy("pair_id").limit(cap)


def headline(costs: DataFrame, quality: DataFrame, summary: DataFrame, champion: str, baseline: str) -> DataFrame:
    """Cost reduction, speed-up and quality delta of the champion against the baseline, from one-row-per-strategy tables."""
    joined = (
        costs.filter("bucket = '*'")
        .select("strategy", "usd_per_100q")
        .join(quality.filter("bucket = '*'").select("strategy", "mean_quality"), "strategy")
        .join(summary.filter("bucket = '*'").select("strategy", "latency_ms_p50", "avg_brief_tokens"), "strategy")
    )
    at = lambda s, c: F.max(F.when(F.col("strategy") == s, F.col(c)))
    return joined.agg(
        F.round((1 - at(champion, "usd_per_100q") / at(baseline, "usd_per_100q")) * 100, 1).alias("cost_reduction_pct"),
        F.round(
            at(baseline, "latency_ms_p50") / F.greatest(at(champion, "latency_ms_p50"), F.lit(1e-6)), 2
        ).alias("speedup"),
        F.round(at(champion, "mean_quality") - at(baseline, "mean_quality"), 3).alias("quality_delta"),
    )


def quality_per_token(quality: DataFrame, summary: DataFrame) -> DataFrame:
    rows = quality.filter("bucket = '*'").join(
        summary.filter("bucket = '*'").select("strategy", "avg_brief_tokens"), "strategy"
    )
    return rows.select(
        "strategy",
        F.round(F.col("mean_quality") * 1000 / F.col("avg_brief_tokens"), 3).alias("quality_per_1k_tokens"),
        F.round(F.col("avg_brief_tokens") / F.col("mean_quality"), 1).alias("tokens_per_quality_unit"),
    )


# ---- load and latency ---------------------------------------------------------------------------

_LINEAR = {"p50": ("linear", 0.5), "p95": ("linear", 0.95), "p99": ("linear", 0.99)}


def load_summary(samples: DataFrame, wall_s: float) -> DataFrame:
    """Throughput, success rate and linear percentiles, overall ('*') and per tenant. No samples give one zero row."""
    rows = samples.withColumn("ms", F.col("latency_s") * 1000).withColumn(
        "tenant_id", F.explode(F.array(F.col("tenant_id"), F.lit("*")))
    )
    ok = F.col("status").between(200, 299)
    counts = rows.groupBy("tenant_id").agg(F.count("*").alias("n"), F.count_if(ok).alias("n_ok"))
    stats = order_statistics(rows, ["tenant_id"], "ms", _LINEAR).drop("n", "min")
    empty = samples.sparkSession.createDataFrame([("*",)], "tenant_id string")
    full = counts.join(stats, "tenant_id").join(empty, "tenant_id", "full")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    return full.select(
        "tenant_id",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("n_ok", F.lit(0)).alias("n_ok"),
        F.round(zero("n") / F.lit(float(wall_s)) if wall_s > 0 else F.lit(0.0), 6).alias("rps"),
        F.round(F.when(F.col("n") > 0, F.col("n_ok") / F.col("n")).otherwise(F.lit(0.0)), 6).alias("success_rate"),
        *[F.round(zero(p), 6).alias(f"{p}_ms") for p in _LINEAR],
        F.round(zero("max"), 6).alias("max_ms"),
    )


def latency_stats(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    stats = order_statistics(samples, keys, value, _LINEAR)
    spread = samples.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("stdev"))
    cols = ["min", "p50", "p95", "p99", "max", "mean", "stdev"]
    return stats.join(spread, keys).select(*keys, "n", *[F.round(c, 4).alias(c) for c in cols])


# ---- manifests ----------------------------------------------------------------------------------


def manifest_counts(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """Counts per value of each dimension, in one pass."""
    pairs = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions])
    return rows.select(F.inline(pairs)).groupBy("dimension", "value").agg(F.count("*").alias("n"))


def content_digest(rows: DataFrame, line: Column) -> DataFrame:
    """Digest of a row set, whatever the row order: row hashes are summed in two halves, then hashed once."""
    h = F.sha2(line, 256)
    part = lambda start: F.conv(F.substring(h, start, 12), 16, 10).cast("decimal(38,0)")
    sums = rows.agg(F.count("*").alias("n"), F.sum(part(1)).alias("a"), F.sum(part(13)).alias("b"))
    text = F.concat_ws(":", "n", F.col("a").cast("string"), F.col("b").cast("string"))
    return sums.select("n", F.sha2(text, 256).alias("digest"))
