"""Proposal -> action -> policy decision -> queue or execution -> audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convspark import values as V
from convspark.functions import text as X
from convspark.operators import policy as P


def as_actions(proposals: DataFrame) -> DataFrame:
    """The pending_policy action that each proposal would be, row by row."""
    rest = [c for c in proposals.columns if c not in ("tenant_id", "event_id", "proposed_at", "proposal_id", "payload")]
    return proposals.select(
        X.stable_id("act_", F.col("tenant_id"), F.col("event_id")).alias("action_id"),
        "tenant_id",
        "event_id",
        "proposal_id",
        *rest,
        F.lit("pending_policy").alias("status"),
        "payload",
        F.col("proposed_at").alias("created_at"),
    )


def materialize(proposals: DataFrame) -> DataFrame:
    """One pending_policy action per (tenant, event): a replayed event keeps its first proposal.

    The minimum struct combines map-side, so an event replayed very often is no hot task; maps have no order, so the
    payload rides as entries.
    """
    rest = [c for c in proposals.columns if c not in ("tenant_id", "event_id", "proposed_at", "proposal_id", "payload")]
    entries = F.array_sort(F.map_entries("payload")).alias("entries")
    first = proposals.groupBy("tenant_id", "event_id").agg(
        F.min(F.struct("proposed_at", "proposal_id", *rest, entries)).alias("p")
    )
    return first.select(
        X.stable_id("act_", F.col("tenant_id"), F.col("event_id")).alias("action_id"),
        "tenant_id",
        "event_id",
        *[F.col(f"p.{c}").alias(c) for c in ["proposal_id", *rest]],
        F.lit("pending_policy").alias("status"),
        F.map_from_entries("p.entries").alias("payload"),
        F.col("p.proposed_at").alias("created_at"),
    )


def decide(actions: DataFrame, rules: DataFrame) -> DataFrame:
    return P.declarative(actions, rules)


def quorum_of(actions: DataFrame, rules: DataFrame) -> DataFrame:
    """Required approvals and voter pool per action; one open approval where no rule is set. Rules are broadcast, as
    policies are."""
    joined = actions.join(F.broadcast(rules), ["tenant_id", "action_type"], "left")
    return joined.withColumn("required_approvals", F.coalesce("required_approvals", F.lit(1)))


def invalid_quorum(rules: DataFrame) -> DataFrame:
    pool = F.col("eligible_approvers")
    why = F.array_compact(
        F.array(
            F.when(F.col("required_approvals") < 1, F.lit("at_least_one")),
            F.when(F.size(F.array_distinct(pool)) != F.size(pool), F.lit("pool_distinct")),
            F.when(F.col("required_approvals") > F.size(pool), F.lit("pool_large_enough")),
        )
    )
    return rules.withColumn("broken", why).filter(F.size("broken") > 0)


def effect(payload: Column, action_type: Column) -> Column:
    """What the action would send, with the defaults of its type; null for a type without a handler."""
    at = lambda k: F.try_element_at(payload, F.lit(k))
    filled = lambda k: X.blank_to_null(at(k))
    message = F.coalesce(
        filled("message"),
        F.concat(
            F.lit("Acknowledged: we received your message for loan "),
            F.coalesce(at("loan_id"), F.lit("(unknown)")),
            F.lit("."),
        ),
    )
    reason = F.coalesce(filled("reason"), at("_planner_reasoning"), F.lit("Event flagged for loan-officer review."))
    pairs = {
        "send_borrower_message": {"channel": F.lit("chat"), "recipient": F.lit("borrower"), "message": message},
        "notify_loan_officer": {"channel": F.lit("internal"), "recipient": F.lit("loan_officer"), "reason": reason},
        "schedule_call": {
            "channel": F.lit("voice"),
            "scheduled_for": F.coalesce(at("scheduled_for"), F.lit("next available slot")),
        },
        "request_document": {
            "channel": F.lit("email"),
            "recipient": F.lit("borrower"),
            "document_type": F.coalesce(at("document_type"), F.lit("missing document")),
        },
        "update_status": {
            "channel": F.lit("internal"),
            "new_status": F.coalesce(at("new_status"), F.lit("in_review")),
        },
        "no_op": {"channel": F.lit("noop")},
    }
    out = F
    for kind, fields in pairs.items():
        out = out.when(action_type == kind, F.create_map(*[c for k, v in fields.items() for c in (F.lit(k), v)]))
    return out.otherwise(F.lit(None))


def execute(actions: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Adds the effect, or the error of ``failures`` (action_id, error_kind, error_message).

    An unknown type fails by itself. The result has status, executed_payload, error_kind and error_message.
    """
    done = actions.withColumn("executed_payload", effect(F.col("payload"), F.col("action_type")))
    if failures is None:
        done = done.withColumn("f_kind", F.lit(None).cast("string")).withColumn("f_message", F.lit(None).cast("string"))
    else:
        table = failures.select("action_id", F.col("error_kind").alias("f_kind"), F.col("error_message").alias("f_message"))
        done = done.join(table, "action_id", "left")
    unknown = F.col("executed_payload").isNull()
    missing = F.concat(F.lit("no executor registered for action_type="), X.py_repr(F.col("action_type")))
    kind = F.when(unknown, "ExecutionError").otherwise(F.col("f_kind"))
    failed = kind.isNotNull()
    return (
        done.withColumn("error_kind", kind)
        .withColumn("error_message", F.when(unknown, missing).otherwise(F.col("f_message")))
        .withColumn("executed_payload", F.when(~failed, F.col("executed_payload")))
        .withColumn("status", F.when(failed, "execution_failed").otherwise("executed"))
        .drop("f_kind", "f_message")
    )


def apply_decision(decided: DataFrame, quorum: DataFrame, failures: DataFrame | None = None) -> DataFrame:
    """Status after the policy: rejected, pending_approval (with its quorum) or executed / execution_failed."""
    ran = execute(decided, failures)
    auto = F.col("decision") == "auto"
    status = F.when(F.col("decision") == "reject", "rejected").when(auto, F.col("status")).otherwise("pending_approval")
    gated = ran.withColumn("status", status)
    for c in ("executed_payload", "error_kind", "error_message"):
        gated = gated.withColumn(c, F.when(auto, F.col(c)))
    return quorum_of(gated, quorum)


def queue_rows(actions: DataFrame, queued: DataFrame | None = None) -> DataFrame:
    """Approval rows of actions waiting for approval; an action already queued is not queued again."""
    rows = actions.filter("status = 'pending_approval'").select(
        X.stable_id("appr_", F.col("action_id")).alias("queue_id"),
        "action_id",
        "tenant_id",
        F.lit("pending").alias("state"),
        "required_approvals",
        "eligible_approvers",
        F.col("created_at").alias("enqueued_at"),
    )
    return rows if queued is None else rows.join(queued.select("action_id"), "action_id", "left_anti")


_AUDIT = "array<struct<step:int,kind:string,actor_kind:string,actor_id:string,ts:timestamp,payload:map<string,string>>>"


def _entry(step: int, kind, actor_kind, ts: Column, payload: dict[str, Column], actor_id=None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    actor_kind = F.lit(actor_kind) if isinstance(actor_kind, str) else actor_kind
    entries = [c for k, v in payload.items() for c in (F.lit(k), v.cast("string"))]
    return F.struct(
        F.lit(step).alias("step"),
        kind.alias("kind"),
        actor_kind.alias("actor_kind"),
        (F.lit(None).cast("string") if actor_id is None else actor_id).alias("actor_id"),
        ts.alias("ts"),
        F.create_map(*entries).alias("payload"),
    )


def policy_audit(actions: DataFrame) -> DataFrame:
    """Proposal, decision and, where the policy settles the action, its execution, failure or rejection."""
    ts = F.col("created_at")
    proposal = _entry(
        1,
        "proposal",
        F.when(F.col("proposed_by") == "llm", "llm").otherwise("fallback"),
        ts,
        {
            "proposed_by": F.col("proposed_by"),
            "action_type": F.col("action_type"),
            "reasoning": F.coalesce(F.try_element_at("payload", F.lit("_planner_reasoning")), F.lit("")),
        },
    )
    decision = _entry(2, "decision", "system", ts, {"decision": F.col("decision"), "action_type": F.col("action_type")})
    rejected = _entry(3, "rejection", "system", ts, {"reason": F.lit("policy=reject"), "by": F.lit("policy_engine")})
    executed = _entry(3, "execution", "system", ts, {"executed_payload": F.to_json("executed_payload")})
    failed = _entry(
        3, "execution_failed", "system", ts, {"error_kind": F.col("error_kind"), "error_message": F.col("error_message")}
    )
    last = (
        F.when(F.col("status") == "rejected", rejected)
        .when(F.col("status") == "executed", executed)
        .when(F.col("status") == "execution_failed", failed)
    )
    entries = F.array_compact(F.array(proposal, decision, last))
    out = actions.select("tenant_id", "action_id", "event_id", F.inline(entries))
    return out.withColumn("vote_id", F.lit(None).cast("long"))


def vote_audit(classified: DataFrame, actions: DataFrame) -> DataFrame:
    """Entries of accepted votes, and of the execution that the deciding approval sets off; ``vote_id`` orders votes of
    one moment."""
    votes = classified.filter("outcome = 'accepted'")
    # the action side has one row per action; a hot action only makes the vote side large
    key = ["tenant_id", "action_id"]
    keyed = votes.join(actions.select(*key, "event_id", "action_type", "payload"), key)
    reached = F.col("n_approvals") >= F.col("required_approvals")
    approval = _entry(
        1,
        "approval",
        "human",
        F.col("voted_at"),
        {
            "prior_status": F.lit("pending_approval"),
            "approvals_recorded": F.col("n_approvals"),
            "required_approvals": F.col("required_approvals"),
            "quorum_reached": reached,
        },
        F.col("decided_by"),
    )
    veto = _entry(
        1,
        "rejection",
        "human",
        F.col("voted_at"),
        {"prior_status": F.lit("pending_approval"), "reason": F.coalesce("reason", F.lit(""))},
        F.col("decided_by"),
    )
    sent = effect(F.col("payload"), F.col("action_type"))
    execution = _entry(2, "execution", "system", F.col("voted_at"), {"executed_payload": F.to_json(sent)})
    is_veto = F.col("vote") == "reject"
    entries = F.array_compact(F.array(F.when(is_veto, veto).otherwise(approval), F.when(~is_veto & reached, execution)))
    return keyed.select("tenant_id", "action_id", "event_id", "vote_id", F.inline(entries))
