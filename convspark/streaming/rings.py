"""Per-tenant rings of recent rows, and the deferred-call queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from convspark.streaming.state import BatchTable

EVENTS_CAP = 50
PROPOSALS_CAP = 50
QUARANTINE_CAP = 200
DEFERRED_CAP = 500


def newest(rows: DataFrame, order: list[str], cap: int) -> DataFrame:
    """The ``cap`` newest rows per tenant, ``age`` 1 being the newest; rows without tenant are dropped.

    The literal cap prunes before the shuffle, so a tenant with most of the rows sends ``cap`` rows per task.
    """
    w = Window.partitionBy("tenant_id").orderBy(*[F.col(c).desc() for c in order])
    kept = rows.filter(F.coalesce("tenant_id", F.lit("")) != "")
    return kept.withColumn("age", F.row_number().over(w)).filter(F.col("age") <= cap)


def recent(ring: DataFrame, tenant_id: str, limit: int = 20) -> DataFrame:
    """Newest-first read of one tenant; a limit of zero or less is empty."""
    return ring.filter((F.col("tenant_id") == tenant_id) & (F.col("age") <= limit)).orderBy("age")


def keep_ring(ring: BatchTable, order: list[str], cap: int):
    """Ring as a table: the ring of the batch before, plus the micro-batch, cut to the cap. The ring of a batch
    replaces the one before it, so reading takes the last batch."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        names = ring.schema.names
        before = ring.read_last(before=batch_id).select(*names)
        merged = newest(batch.select(*names), order, cap).select(*names).unionByName(before)
        ring.write(newest(merged, order, cap).select(*names), batch_id)

    return handle


class RingTable(BatchTable):
    """Small by construction: at most cap rows per tenant and batch."""

    def read_last(self, before: int | None = None) -> DataFrame:
        """The ring of the batch before ``before``, by default of the newest. Batches are numbered one after another, so
        no older folder is read; only a reader that did not write looks up the newest number, from the folder names."""
        full = self.spark.createDataFrame([], self.schema).withColumn("batch", F.lit(0).cast("long"))
        if before is None:
            table = self._stored(full.schema)
            newest_batch = None if table is None else table.agg(F.max("batch")).first()[0]
            before = 0 if newest_batch is None else newest_batch + 1
        table = self._stored(full.schema, f"/batch={before - 1}") if before > 0 else None
        return (full if table is None else table).select(*self.schema.names)


# ---- deferred calls -----------------------------------------------------------------------------


def deferred(outcomes: DataFrame) -> DataFrame:
    """Degraded calls (``error_class`` set) with reason and detail."""
    cls, message = F.col("error_class"), F.col("error_message")
    return outcomes.filter("degraded").select(
        "tenant_id",
        "operation",
        F.when(cls == "DeadlineExceeded", "deadline_exceeded").otherwise("transient_error").alias("reason"),
        F.when(cls.isNotNull(), F.concat(cls, F.lit(": "), F.coalesce(message, F.lit(""))))
        .otherwise(F.concat("operation", F.lit(" returned degraded result without explicit error")))
        .alias("detail"),
        "payload",
        "elapsed_ms",
        "deferred_at",
        "call_id",
    )


def drain(queue: DataFrame, order: list[str], limit: int) -> tuple[DataFrame, DataFrame]:
    """(oldest ``limit`` calls per tenant, the rest). The queue itself holds at most DEFERRED_CAP rows per tenant."""
    w = Window.partitionBy("tenant_id").orderBy(*order)
    turn: Column = F.row_number().over(w)
    taken = queue.withColumn("turn", turn).filter(F.col("turn") <= max(limit, 0))
    return taken, queue.join(taken.select("tenant_id", "call_id"), ["tenant_id", "call_id"], "left_anti")
