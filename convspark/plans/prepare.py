"""Benchmark material from dialogues: carving, padding, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from convspark import values as V
from convspark.functions import text as X
from convspark.functions.scale import sums_before
from convspark.session import cut_lineage
from convspark.sources import tables as T


def carve(dialogues: DataFrame) -> DataFrame:
    """Last user turn = query, the assistant turn right after = truth (else a fixed text)."""
    last = (
        dialogues.filter("role = 'user'")
        .groupBy("conv_id")
        .agg(F.max(F.struct("turn", "text")).alias("m"))
        .select("conv_id", F.col("m.turn").alias("last_turn"), F.col("m.text").alias("query"))
    )
    answer = dialogues.filter("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("last_turn"), F.col("text").alias("truth")
    )
    return last.join(answer, ["conv_id", "last_turn"], "left").select(
        "conv_id", "last_turn", "query", F.coalesce("truth", F.lit(V.NO_TRUTH)).alias("ground_truth")
    )


def enough_user_turns(dialogues: DataFrame, least: int = 3) -> DataFrame:
    return (
        dialogues.groupBy("conv_id")
        .agg(F.count_if(F.col("role") == "user").alias("n_user"), F.count("*").alias("n_turns"))
        .filter(F.col("n_user") >= least)
    )


def histories(spark: SparkSession, sf_dir: str, several: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs, history messages, history actions): the turns before the query and all events of the customer.

    ``several``: more than one plan reads them, so they are computed once and kept in the shared folder.
    """
    keep = cut_lineage if several else lambda df: df
    carved = carve(T.dialogues(spark, sf_dir)).withColumn("pair_id", F.concat(F.lit("p"), F.col("conv_id")))
    messages = (
        T.messages(spark, sf_dir)
        .join(carved.select("conv_id", "pair_id", "last_turn"), "conv_id")
        .filter(F.col("seq") < F.col("last_turn"))
        .drop("last_turn", "conv_id")
    )
    messages = keep(messages)
    owners = carved.select("pair_id", F.concat(F.lit("c"), F.col("conv_id")).alias("customer_id"))
    actions = keep(T.prior_actions(spark, sf_dir).join(owners, "customer_id"))
    sizes = (
        messages.select("pair_id", F.lit(1).alias("m"))
        .unionByName(actions.select("pair_id", F.lit(0).alias("m")))
        .groupBy("pair_id")
        .agg(F.count("*").alias("n_rows"), F.sum("m").alias("n_messages"))
    )
    pairs = carved.join(sizes, "pair_id", "left").select(
        "pair_id",
        F.concat(F.lit("t"), F.col("conv_id") % 5).alias("tenant_id"),
        F.concat(F.lit("c"), F.col("conv_id")).alias("customer_id"),
        "query",
        "ground_truth",
        F.coalesce("n_messages", F.lit(0)).alias("n_messages"),
        X.length_bucket(F.coalesce("n_rows", F.lit(0))).alias("bucket"),
        T.nth(V.FACT_INTENTS + ["greeting", "courtesy"], F.col("conv_id") % 12).alias("intent"),
    )
    return keep(pairs), messages, actions


def pad_histories(dialogues: DataFrame, starts: DataFrame, least: int, most: int) -> DataFrame:
    """Pad each primary dialogue with older ones up to ``least`` messages, trimming the oldest beyond ``most``.

    ``dialogues``: pool_pos (1-based pool order), conv_id, n_messages. ``starts``: pair_id, pool_pos of the primary.
    The pool is consumed in order: a pair takes its primary and then the following dialogues until its running count
    reaches ``least``. Each padding dialogue is one day older than the one before it. Returns one row per (pair,
    dialogue) with ``days_back`` and ``n_kept``, the messages left after trimming from the oldest end.

    Pairs own disjoint stretches of the pool, so the running count is a prefix-sum difference; dialogues before the
    next start are matched to their pair by position, not by comparing all pairs with all dialogues.
    """
    # a stretch is found from the sorted starts by counting starts at or before a position, slice by slice
    marked = starts.select("pair_id", "pool_pos").join(dialogues, "pool_pos", "right")
    slice_ = F.floor(F.col("pool_pos") / 4096)
    per_slice = marked.groupBy(slice_.alias("s")).agg(F.count("pair_id").alias("n"))
    base = sums_before(per_slice, [], "s", "n", "base")
    inside = Window.partitionBy("s").orderBy("pool_pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = marked.withColumn("s", slice_).withColumn("i", F.count("pair_id").over(inside)).join(base, "s")
    placed = counted.withColumn("stretch", F.col("base") + F.col("i")).filter("stretch > 0")
    # the messages and dialogues before a position are sums over the whole pool, so no stretch is summed in one task
    for size, name in (("n_messages", "messages"), ("1", "rows")):
        sizes = dialogues.select("pool_pos", F.expr(size).cast("long").alias("size"))
        placed = placed.join(sums_before(sizes, [], "pool_pos", "size", name), "pool_pos")
    placed = placed.select("stretch", "pair_id", "conv_id", "n_messages", "messages", "rows")
    first = placed.filter("pair_id IS NOT NULL").select(
        "stretch", "pair_id", F.col("messages").alias("messages_0"), F.col("rows").alias("rows_0")
    )
    run = placed.drop("pair_id").join(first, "stretch")
    run = run.withColumn("before", F.col("messages") - F.col("messages_0"))
    run = run.withColumn("days_back", (F.col("rows") - F.col("rows_0")).cast("int"))
    primary = F.col("days_back") == 0
    used = run.filter(primary | (F.col("before") < least))
    # the newest messages stay: the primary is newest, so what exceeds ``most`` falls off the last dialogue; a primary
    # alone is never trimmed
    kept = F.greatest(F.lit(0), F.least(F.col("n_messages"), F.lit(most) - F.col("before")))
    kept = F.when(primary, F.col("n_messages")).otherwise(kept)
    return used.select("pair_id", "conv_id", "days_back", "n_messages", kept.alias("n_kept"))
