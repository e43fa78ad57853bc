"""Online ingest: parsing of bus messages, deduplication and identity linking."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convspark.operators import identity as I
from convspark.sources import sinks
from convspark.streaming.state import BatchTable, KeyTable, first_arrivals

ENVELOPE = "event_id string, tenant_id string, customer_id string, channel_code string, event_type string, received_at string"


def envelopes(raw: DataFrame, column: str = "value") -> DataFrame:
    """Bus messages as envelope rows; what is not a JSON object is dropped."""
    is_object = F.json_object_keys(F.col(column)).isNotNull()
    return raw.filter(is_object).select(F.from_json(F.col(column), ENVELOPE).alias("e")).select("e.*")


def malformed_count(raw: DataFrame, column: str = "value") -> DataFrame:
    good = F.json_object_keys(F.col(column)).isNotNull()
    return raw.agg(F.count("*").alias("n"), F.count_if(~good).alias("n_dropped"))


def dedup_within(events: DataFrame, keys: list[str], delay: str, time: str = "received_at") -> DataFrame:
    """One event per key with state bounded by ``delay``: a replay later than that counts as new. The first micro-batch wins;
    of rows of one key in one micro-batch Spark keeps any."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def first_wins(events: DataFrame, order: list[str]) -> DataFrame:
    """Exact first-wins upsert as keyed state: each key of a micro-batch with its stored event (for update mode)."""
    return first_arrivals(events, sinks.KEY, order)


def insert_new(table: BatchTable, created: Callable[[DataFrame, int], None] | None = None):
    """Appends the events that ``first_wins`` created; no earlier batch is read. ``created`` gets the new rows."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        table.write(batch.filter("created"), batch_id)
        if created is not None:
            created(table.read_batch(batch_id), batch_id)

    return handle


def link(identities: KeyTable, stored: KeyTable, outcomes: BatchTable):
    """Identity linking per micro-batch against what earlier batches stored for its own identities and keys."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        asked = batch.select("tenant_id", F.explode("hints").alias("h")).select("tenant_id", "h.kind", "h.value")
        owned = identities.read_for(asked, batch_id)
        resolved = I.resolve(batch, owned, stored.read_for(batch, batch_id))
        outcomes.write(resolved, batch_id)
        done = outcomes.read_batch(batch_id)
        identities.write(I.new_identities(done), batch_id)
        kept = done.filter("outcome IN ('created', 'linked')").select("tenant_id", "event_id", F.col("customer_id").alias("owner"))
        keys = batch.join(kept, ["tenant_id", "event_id"])
        stored.write(keys.select("tenant_id", "idempotency_key", "event_id", F.col("owner").alias("customer_id")), batch_id)

    return handle


IDENTITY_SCHEMA = "tenant_id string, customer_id string, kind string, value string"
STORED_SCHEMA = "tenant_id string, idempotency_key string, event_id long, customer_id string"
OUTCOME_SCHEMA = (
    "tenant_id string, event_id long, outcome string, customer_id string, customer_created boolean, matched_kind string, "
    "matched_value string, added array<struct<kind:string,value:string>>, attached_to string, replay_of long"
)
