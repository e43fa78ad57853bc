"""The given parquet tables as conversation entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convspark import values as V

EVENT_TYPE_OF = {
    "view": "message_received",
    "click": "document_uploaded",
    "purchase": "status_changed",
    "error": "anomaly_detected",
    "signup": "system_event",
}
EPOCH = 1704067200  # 2024-01-01T00:00:00Z


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lookup(mapping: dict[str, str], key: Column, default: Column | None = None) -> Column:
    """Fixed small mapping as a CASE expression."""
    out = F
    for k, v in mapping.items():
        out = out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(None) if default is None else default)


def nth(items: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(i) for i in items]), (index + 1).cast("int"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per inbound event, with tenant, customer, channel, idempotency key and payload fields."""
    raw = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    kind = lookup(EVENT_TYPE_OF, F.col("event_type"))
    return raw.select(
        "event_id",
        F.concat(F.lit("t"), F.col("user_id") % 5).alias("tenant_id"),
        F.concat(F.lit("c"), F.col("user_id")).alias("customer_id"),
        "user_id",
        nth(V.CHANNELS, F.col("event_id") % 5).alias("channel_code"),
        kind.alias("event_type"),
        F.concat_ws("-", F.col("user_id"), kind, F.date_format("ts", "yyyy-MM-dd")).alias("idempotency_key"),
        "value",
        F.get_json_object("props", "$.k").alias("k"),
        F.col("ts").alias("received_at"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as channel messages, 18 hours apart."""
    conv = read(spark, sf_dir, "conversations")
    channel = nth(V.CHANNELS[:4], F.col("turn") % 4)
    return conv.select(
        F.concat(F.lit("t"), F.col("conv_id") % 5).alias("tenant_id"),
        F.concat(F.lit("c"), F.col("conv_id")).alias("customer_id"),
        "conv_id",
        F.col("turn").alias("seq"),
        channel.alias("channel"),
        F.col("role").alias("sender"),
        F.col("text").alias("content"),
        F.timestamp_seconds(F.lit(EPOCH) + F.col("conv_id") * 86400 + F.col("turn") * 64800).alias("ts"),
        F.when(channel == "email", F.concat(F.col("role"), F.lit("'s turn "), F.col("turn"))).alias("subject"),
        F.when(
            channel == "sms",
            F.array(F.concat(F.lit("img-"), F.col("conv_id")), F.concat(F.lit("scan-"), F.col("turn"))),
        ).alias("attachments"),
    )


def prior_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of a customer as a prior action."""
    return events(spark, sf_dir).select(
        "tenant_id",
        "customer_id",
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("action_type"),
        F.array(F.struct(F.lit("k").alias("k"), F.col("k").alias("v"), F.col("k").alias("s"))).alias("details"),
        F.col("received_at").alias("ts"),
    )


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def policy_rules(spark: SparkSession) -> DataFrame:
    """Tenant policy table: exact + default, exact + wildcard, wildcard only; t3 is empty, t4 unconfigured."""
    rows = [
        ("t0", "default", "approval_required"),
        ("t0", "send_borrower_message", "auto"),
        ("t0", "update_status", "auto"),
        ("t0", "no_op", "auto"),
        ("t0", "schedule_call", "reject"),
        ("t1", "*", "reject"),
        ("t1", "notify_loan_officer", "auto"),
        ("t1", "send_borrower_message", "approval_required"),
        ("t2", "*", "auto"),
    ]
    return spark.createDataFrame(rows, "tenant_id string, key string, decision string")


def quorum_rules(spark: SparkSession) -> DataFrame:
    rows = [
        ("t0", "notify_loan_officer", 2, ["a0", "a1", "a2", "a3", "a4"]),
        ("t1", "send_borrower_message", 3, None),
        ("t3", "send_borrower_message", 2, None),
        ("t3", "notify_loan_officer", 2, ["a0", "a1", "a2"]),
    ]
    return spark.createDataFrame(
        rows, "tenant_id string, action_type string, required_approvals int, eligible_approvers array<string>"
    )
