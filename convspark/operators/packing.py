"""Greedy packing of ranked segments into token-budgeted briefs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convspark.functions import text as X
from convspark.operators.retrieval import KEYS, reading_order


def header(customer: Column, tenant: Column) -> Column:
    return F.concat(F.lit("Borrower: "), customer, F.lit(" (tenant="), tenant, F.lit(")"))



def pack(segments: DataFrame, groups: DataFrame, keys: list[str], max_budget: int) -> DataFrame:
    """Pack each key of ``groups`` (key columns, ``header`` or '', ``token_budget``).

    Segments are taken in reading order; one that does not fit is skipped and the walk goes on. A segment costs
    token_estimate + 1. The header is reserved first, and dropped when it does not fit.

    The walk itself is sequential, but its input is bounded by the budget: once a segment of cost c is skipped,
    every later one of cost c is skipped too, so only the first floor(budget / c) segments of each cost can be
    taken: at most four times the budget in characters for each distinct cost. That filter is exact. ``max_budget`` is an
    upper bound that applies map-side; a group with a larger budget is an error. The walk reads costs only and notes
    positions; texts are picked once, at its end.
    """
    if max_budget <= 0:
        raise ValueError(f"token_budget must be positive, got {max_budget}")
    over = F.raise_error(F.concat(F.lit(f"token_budget above max_budget {max_budget}: "), F.col("token_budget").cast("string")))
    head_cost = F.when(F.col("header") != "", X.estimate_tokens(F.col("header")) + 1).otherwise(F.lit(0))
    groups = groups.withColumn("token_budget", F.when(F.col("token_budget") > max_budget, over.cast("int")).otherwise(F.col("token_budget").cast("int")))
    groups = groups.select(
        *keys,
        "token_budget",
        F.when(head_cost <= F.col("token_budget"), blank(F.col("header"))).alias("header"),
        F.when(head_cost <= F.col("token_budget"), head_cost).otherwise(F.lit(0)).cast("int").alias("head_cost"),
    )
    sized = segments.select(*keys, "priority", "ord", "seq", (F.col("token_estimate") + 1).alias("cost"), "body", "source")
    same_cost = Window.partitionBy(*keys, "cost").orderBy(*reading_order())
    candidates = (
        sized.filter(F.col("cost") <= max_budget)
        .withColumn("nth", F.row_number().over(same_cost))
        .filter(F.col("nth") <= max_budget)
        .filter(F.col("nth") * F.col("cost") <= max_budget)
    )
    item = F.struct((-F.col("priority")).alias("down"), "ord", "seq", "cost", "body", "source")
    items = candidates.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("items"))
    costs = F.transform("items", lambda x, i: F.struct(x["cost"].alias("cost"), i.alias("at")))
    start = F.struct(F.col("head_cost").alias("used"), F.array().cast("array<int>").alias("kept"))

    def step(s, x):
        fits = s["used"] + x["cost"] <= F.col("token_budget")
        taken = F.struct((s["used"] + x["cost"]).alias("used"), F.array_append(s["kept"], x["at"]).alias("kept"))
        return F.when(fits, taken).otherwise(s)

    walked = groups.join(items, keys, "left").withColumn(
        "w",
        F.when(F.col("items").isNotNull(), F.aggregate(costs, start, step)).otherwise(start),
    )
    parts = F.when(F.col("items").isNotNull(), F.transform(F.col("w.kept"), lambda i: F.get("items", i)))
    packed = walked.select(*keys, "token_budget", "header", F.col("w.used").alias("used_tokens"), parts.alias("parts"))
    lines = F.array_join(F.transform("parts", lambda p: p["body"]), "\n")
    n_kept = F.coalesce(F.size("parts"), F.lit(0))
    brief = F.concat_ws("\n", F.col("header"), F.when(n_kept > 0, lines))
    out = packed.select(
        *keys, "token_budget", F.coalesce(brief, F.lit("")).alias("brief_text"), n_kept.alias("n_kept"), "used_tokens"
    )
    # the accounting above makes a tail trim unreachable; kept as a check
    return out.withColumn("brief_tokens", X.estimate_tokens(F.col("brief_text"))).withColumn(
        "over_budget", F.col("brief_tokens") > F.col("token_budget")
    )


def blank(c: Column) -> Column:
    return F.when(c != "", c)


def brief_groups(pairs: DataFrame, token_budget: Column, extra: list[str] = []) -> DataFrame:
    return pairs.select(
        *KEYS,
        *extra,
        header(F.col("customer_id"), F.col("tenant_id")).alias("header"),
        token_budget.alias("token_budget"),
    )


def source_counts(segments: DataFrame, briefs: DataFrame, keys: list[str]) -> DataFrame:
    """Segments per source whose body occurs in the brief, packed or not."""
    hit = F.contains("brief_text", "body")
    return (
        segments.select(*keys, "source", "body")
        .join(briefs.select(*keys, "brief_text"), keys)
        .filter(hit)
        .groupBy(*keys, "source")
        .agg(F.count("*").alias("n_in_brief"))
    )
