"""Read models over actions, approval rows and the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def actions_of(actions: DataFrame, tenant_id: str) -> DataFrame:
    """Actions of a tenant in insertion order."""
    return actions.filter(F.col("tenant_id") == tenant_id).orderBy("created_at", "action_id")


def pending(queue: DataFrame, actions: DataFrame) -> DataFrame:
    """Pending rows with their action, first in first out; rows without an action are skipped."""
    rows = queue.filter("state = 'pending'").select("action_id", "enqueued_at", "required_approvals")
    return rows.join(actions, "action_id").orderBy("tenant_id", "enqueued_at", "action_id")


def visible_payload(payload="payload"):
    """Payload without the internal ``_`` keys."""
    return F.map_filter(payload, lambda k, _: ~k.startswith("_"))


def action_view(actions: DataFrame, audit: DataFrame) -> DataFrame:
    """Action with reasoning lifted out of the payload and its audit trail in order.

    A trail has at most three policy entries and one entry per accepted vote plus an execution.
    """
    trail = audit.groupBy("tenant_id", "action_id").agg(
        F.sort_array(F.collect_list(F.struct("ts", "step", "vote_id", "kind", "actor_kind", "actor_id"))).alias("audit_trail")
    )
    hidden = F.map_filter("payload", lambda k, _: ~k.isin("_planner_reasoning", "_executed_payload"))
    return actions.join(trail, ["tenant_id", "action_id"], "left").select(
        "action_id",
        "tenant_id",
        "event_id",
        "customer_id",
        "action_type",
        "status",
        F.coalesce(F.try_element_at("payload", F.lit("_planner_reasoning")), F.lit("")).alias("reasoning"),
        hidden.alias("payload"),
        "executed_payload",
        "audit_trail",
    )


def recent_audit(audit: DataFrame, limit: int = 20) -> DataFrame:
    """Newest entries per tenant; the literal limit prunes map-side."""
    w = Window.partitionBy("tenant_id").orderBy(F.col("audit_id").desc())
    return audit.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= limit)


def tenants_seen(audit: DataFrame) -> DataFrame:
    """Tenants by first appearance."""
    first = audit.groupBy("tenant_id").agg(F.min(F.struct("ts", "action_id", "step")).alias("first"))
    return first.orderBy("first").select("tenant_id", F.col("first.ts").alias("first_ts"))


def decision_times(audit: DataFrame) -> DataFrame:
    """First approval and first rejection per action."""
    when = lambda kind: F.min(F.when(F.col("kind") == kind, F.col("ts")))
    times = audit.groupBy("tenant_id", "action_id").agg(
        when("approval").alias("approved_at"), when("rejection").alias("rejected_at")
    )
    return times.filter("approved_at IS NOT NULL OR rejected_at IS NOT NULL")


def audit_for(audit: DataFrame, tenant_id: str | None = None, action_id: str | None = None, event_id=None) -> DataFrame:
    for column, wanted in (("tenant_id", tenant_id), ("action_id", action_id), ("event_id", event_id)):
        if wanted is not None:
            audit = audit.filter(F.col(column) == wanted)
    return audit
