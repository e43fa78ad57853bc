"""One proposal per event: a valid model response, else the rule table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convspark import values as V
from convspark.functions import safety, text as X
from convspark.sources.tables import lookup


def fallback_action(event_type: Column) -> Column:
    return lookup(V.FALLBACK_ACTIONS, event_type, F.lit(V.FALLBACK_DEFAULT))


def fallback_reason(event_type: Column) -> Column:
    quoted = X.py_repr(F.coalesce(event_type, F.lit("")))
    known = F.coalesce(event_type.isin(list(V.FALLBACK_ACTIONS)), F.lit(False))
    return F.when(known, F.concat(F.lit("rule-table fallback for event_type="), quoted)).otherwise(
        F.concat(F.lit("rule-table default (unknown event_type="), quoted, F.lit(", escalating)"))
    )


def _text_of(v: Column, path: str) -> Column:
    return X.let(
        F.try_variant_get(v, path, "variant"),
        lambda field: F.when(F.schema_of_variant(field) == "STRING", field.cast("string")),
    )


def parse_response(raw: Column) -> Column:
    """STRUCT<action_type, payload MAP> of a valid response, else null.

    The action must be a known type and the payload an object; the reasoning is copied into the payload unless it is
    there already.
    """
    return X.let(X.strict_object(X.unfence(F.coalesce(raw, F.lit("")))), _validated)


def _validated(obj: Column) -> Column:
    action = _text_of(obj, "$.action_type")
    kind = F.schema_of_variant(F.try_variant_get(obj, "$.payload", "variant"))
    # a missing payload is an empty one; JSON null is not an object
    payload_ok = kind.isNull() | kind.startswith("OBJECT")
    payload = F.coalesce(
        F.try_variant_get(obj, "$.payload", "map<string,string>"), F.create_map().cast("map<string,string>")
    )
    reasoning = X.blank_to_null(_text_of(obj, "$.reasoning"))
    add = reasoning.isNotNull() & ~F.map_contains_key(payload, F.lit("_planner_reasoning"))
    full = F.when(add, F.map_concat(payload, F.create_map(F.lit("_planner_reasoning"), reasoning))).otherwise(payload)
    return F.when(action.isin(V.ACTION_TYPES) & payload_ok, F.struct(action.alias("action_type"), full.alias("payload")))


def propose(events: DataFrame, responses: DataFrame | None = None, brief: Column | None = None) -> DataFrame:
    """Exactly one proposal per event.

    ``events`` has tenant_id, event_id, customer_id, event_type; ``responses`` has tenant_id, event_id, raw. Flags of a
    sanitised brief are stamped on the payload whichever way the proposal was made.
    """
    if responses is None:
        joined = events.withColumn("parsed", F.lit(None).cast("struct<action_type:string,payload:map<string,string>>"))
    else:
        parsed = responses.select("tenant_id", "event_id", parse_response(F.col("raw")).alias("parsed"))
        joined = events.join(parsed, ["tenant_id", "event_id"], "left")
    own = F.create_map(F.lit("_planner_reasoning"), fallback_reason(F.col("event_type")))
    payload = F.coalesce("parsed.payload", own)
    if brief is not None:
        _, flags = safety.sanitize(F.coalesce(brief, F.lit("")))
        stamp = F.create_map(F.lit("_injection_flags"), F.array_join(flags, ","))
        kept = F.map_filter(payload, lambda k, _: k != "_injection_flags")
        payload = F.when(F.size(flags) > 0, F.map_concat(kept, stamp)).otherwise(payload)
    return joined.select(
        X.stable_id("prop_", F.col("tenant_id"), F.col("event_id")).alias("proposal_id"),
        "tenant_id",
        "event_id",
        "customer_id",
        "event_type",
        F.coalesce("parsed.action_type", fallback_action(F.col("event_type"))).alias("action_type"),
        F.when(F.col("parsed").isNotNull(), "llm").otherwise("fallback").alias("proposed_by"),
        payload.alias("payload"),
        F.col("received_at").alias("proposed_at"),
    )
