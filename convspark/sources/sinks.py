"""Event table, audit log, envelopes and result files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convspark.functions.scale import sliced_rank
from convspark.session import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the cluster's shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/convspark-{name}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, name: str) -> DataFrame:
    """The rows, computed once, from a table of the shared folder."""
    folder = scratch(rows.sparkSession, name)
    rows.write.parquet(folder)
    return rows.sparkSession.read.parquet(folder)


def iso(ts: Column) -> Column:
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.unix_micros(ts) % 1000000
    return F.concat(
        whole,
        F.when(micros != 0, F.concat(F.lit("."), F.lpad(micros.cast("string"), 6, "0"))).otherwise(F.lit("")),
        F.lit("+00:00"),
    )


KEY = ["tenant_id", "idempotency_key"]


def first_per_key(batch: DataFrame, order: list[str]) -> DataFrame:
    """The earliest row per (tenant, key). A MIN over structs combines map-side, so a hot key is no hot task."""
    rest = [c for c in batch.columns if c not in KEY and c not in order]
    picked = batch.groupBy(*KEY).agg(F.min(F.struct(*order, *rest)).alias("r"))
    return picked.select(*KEY, *[F.col(f"r.{c}").alias(c) for c in [*order, *rest]]).select(*batch.columns)


def new_events(batch: DataFrame, stored: DataFrame | None, order: list[str]) -> DataFrame:
    """Rows to append: first per (tenant, key) in the batch and not stored before."""
    fresh = first_per_key(batch, order)
    return fresh if stored is None else fresh.join(stored.select(*KEY), KEY, "left_anti")


def upsert_outcomes(batch: DataFrame, stored: DataFrame | None, order: list[str], id_col: str = "event_id") -> DataFrame:
    """Each inbound row with the id of the stored row its key stands for, and whether this row created it."""
    fresh = new_events(batch, stored, order)
    table = fresh.select(*KEY, F.col(id_col).alias("stored_id"))
    if stored is not None:
        table = table.unionByName(stored.select(*KEY, F.col(id_col).alias("stored_id")))
    return batch.join(table, KEY).withColumn("created", F.col(id_col) == F.col("stored_id"))


def envelopes(created: DataFrame) -> DataFrame:
    """Channel and compact JSON with sorted keys, for newly created events only."""
    fields = F.struct(
        "channel_code",
        "customer_id",
        F.col("event_id").cast("string").alias("event_id"),
        "event_type",
        iso(F.col("received_at")).alias("received_at"),
        "tenant_id",
    )
    return created.select(
        "tenant_id",
        F.concat(F.lit("events."), F.col("tenant_id")).alias("channel"),
        F.to_json(fields, {"ignoreNullFields": "false"}).alias("message"),
    )


def with_audit_ids(entries: DataFrame, order: list[str], ts: str = "ts", start: int = 0) -> DataFrame:
    """Increasing id per tenant in ``order``; numbered hour by hour, so a large tenant is spread over tasks."""
    hour = F.floor(F.unix_seconds(F.col(ts)) / 3600)
    ids = sliced_rank(entries, ["tenant_id"], [F.col(c) for c in order], hour, "audit_id")
    return ids.withColumn("audit_id", F.col("audit_id") + F.lit(start))


class AuditLog:
    """Append-only parquet table partitioned by tenant; there is no update, delete or overwrite."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, entries: DataFrame) -> None:
        entries.write.mode("append").partitionBy("tenant_id").parquet(self.path)

    def read(self, tenant_id: str | None = None) -> DataFrame:
        table = self.spark.read.parquet(self.path)
        return table if tenant_id is None else table.filter(F.col("tenant_id") == tenant_id)


def lost_entries(old_snapshot: DataFrame, new_snapshot: DataFrame) -> DataFrame:
    """Entries of the old snapshot that are gone or changed; empty for an append-only log."""
    return old_snapshot.exceptAll(new_snapshot.select(*old_snapshot.columns))


def write_results(rows: DataFrame, summary: DataFrame, folder: str) -> None:
    rows.write.mode("errorifexists").parquet(f"{folder}/rows")
    summary.write.mode("errorifexists").json(f"{folder}/summary")
