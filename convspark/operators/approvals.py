"""N-of-M approval: the outcome of every vote in closed form, without walking a vote list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def eligible(pool, voter):
    """An open pool takes anyone, anonymous voters included; a closed one its members only."""
    return pool.isNull() | (voter.isNotNull() & F.array_contains(pool, F.coalesce(voter, F.lit(""))))


#: Parts that the approvals of one action are ranked in.
_SLOTS = 64


def classify(votes: DataFrame, queue: DataFrame) -> DataFrame:
    """``outcome`` of every vote: not_found, already_decided, not_eligible, duplicate or accepted.

    ``votes``: tenant_id, action_id, vote_id, vote (approve/reject), decided_by, voted_at [, reason].
    ``queue``: tenant_id, action_id, required_approvals, eligible_approvers; one row per action.
    Approvals are ranked in ``_SLOTS`` parts of an action first, of which at most N each go on to the ranking of the action.

    Votes take effect in (voted_at, vote_id) order. An action ends with the earlier of its first eligible veto and its
    Nth valid approval, counting each voter's first one; both are aggregates of the votes, so an action holding a large
    share of all votes is spread over tasks. ``n_approvals`` is the tally after an accepted vote.
    """
    key = ["tenant_id", "action_id"]
    at = F.struct("voted_at", "vote_id")
    rules = queue.select(*key, "required_approvals", "eligible_approvers")
    v = votes.join(rules, key, "left").withColumn("at", at)
    found = F.col("required_approvals").isNotNull()
    in_pool = eligible(F.col("eligible_approvers"), F.col("decided_by"))
    named = (F.col("required_approvals") <= 1) | F.col("decided_by").isNotNull()
    v = v.withColumn("may_vote", found & in_pool & ((F.col("vote") == "reject") | named))

    veto = v.filter("vote = 'reject' AND may_vote").groupBy(*key).agg(F.min("at").alias("veto_at"))
    # a voter's first valid approval; an anonymous one counts by itself (only where one approval is enough)
    approvals = v.filter("vote = 'approve' AND may_vote")
    firsts = approvals.groupBy(*key, "decided_by", "required_approvals").agg(F.min("at").alias("first_at"))
    firsts = firsts.withColumn("slot", F.pmod(F.xxhash64("decided_by"), F.lit(_SLOTS)))
    seats = firsts
    for part in ([*key, "slot"], key):
        order = Window.partitionBy(*part).orderBy("first_at")
        seats = seats.withColumn("seat", F.row_number().over(order)).filter(F.col("seat") <= F.col("required_approvals"))
    quorum = seats.filter("seat = required_approvals").select(*key, F.col("first_at").alias("quorum_at"))
    end = (
        rules.select(*key)
        .join(veto, key, "left")
        .join(quorum, key, "left")
        .select(*key, F.least("veto_at", "quorum_at").alias("end_at"))
    )
    # the seat belongs to one vote, so this join has unique keys on both sides
    seat = seats.select(*key, F.col("first_at.vote_id").alias("vote_id"), "seat")
    out = v.join(end, key, "left").join(seat, [*key, "vote_id"], "left")
    outcome = (
        F.when(~found, "not_found")
        .when(F.col("end_at").isNotNull() & (F.col("at") > F.col("end_at")), "already_decided")
        .when(~F.col("may_vote"), "not_eligible")
        .when((F.col("vote") == "approve") & F.col("seat").isNull(), "duplicate")
        .otherwise("accepted")
    )
    return out.withColumn("outcome", outcome).withColumn(
        "n_approvals", F.when(outcome == "accepted", F.col("seat"))
    ).drop("at", "may_vote", "end_at", "seat")


def resolve(classified: DataFrame, queue: DataFrame) -> DataFrame:
    """Final state of every queue row: state, approvers in order, decider, note, row_version."""
    key = ["tenant_id", "action_id"]
    accepted = classified.filter("outcome = 'accepted'")
    last = F.max_by("decided_by", F.struct("voted_at", "vote_id"))
    tally = accepted.groupBy(*key).agg(
        F.count_if(F.col("vote") == "approve").alias("n"),
        F.bool_or(F.col("vote") == "reject").alias("vetoed"),
        # at most required_approvals votes are accepted as approvals
        F.sort_array(F.collect_list(F.when(F.col("vote") == "approve", F.struct("n_approvals", "decided_by")))).alias("a"),
        last.alias("last_by"),
        F.max("voted_at").alias("last_at"),
        F.count("*").alias("changes"),
    )
    state = F.when(F.col("vetoed"), "rejected").when(F.col("n") >= F.col("required_approvals"), "approved")
    state = F.coalesce(state, F.lit("pending"))
    return queue.join(tally, key, "left").select(
        *[c for c in queue.columns if c != "state"],
        state.alias("state"),
        F.coalesce(F.array_compact(F.transform("a", lambda s: s["decided_by"])), F.array().cast("array<string>")).alias("approvals"),
        F.coalesce("n", F.lit(0)).alias("approvals_recorded"),
        F.when(state != "pending", F.col("last_by")).alias("decided_by"),
        F.when(state != "pending", F.col("last_at")).alias("decided_at"),
        F.coalesce("changes", F.lit(0)).alias("row_version"),
    )


def progress(resolved: DataFrame) -> DataFrame:
    n = F.size("approvals")
    return resolved.select(
        "tenant_id",
        "action_id",
        "state",
        "required_approvals",
        n.alias("approvals_recorded"),
        F.greatest(F.lit(0), F.col("required_approvals") - n).alias("approvals_remaining"),
        F.array_join("approvals", ",").alias("approvers"),
        F.array_join("eligible_approvers", ",").alias("eligible_approvers"),
    )


def promote(actions: DataFrame, resolved: DataFrame) -> DataFrame:
    """Status of queued actions after the votes: executed, rejected or still pending_approval."""
    state = resolved.select("tenant_id", "action_id", F.col("state").alias("q_state"), F.col("decided_at").alias("q_at"))
    joined = actions.join(state, ["tenant_id", "action_id"], "left")
    status = (
        F.when(F.col("q_state") == "approved", "executed")
        .when(F.col("q_state") == "rejected", "rejected")
        .otherwise(F.col("status"))
    )
    return joined.withColumn("status", status).withColumn("resolved_at", F.col("q_at")).drop("q_state", "q_at")
