"""Online decisions and approvals."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from convspark.operators import approvals as AP, decisions as DC, proposals as PR, validate as A
from convspark.streaming.state import BatchTable, first_arrivals

ACTION_SCHEMA = (
    "action_id string, tenant_id string, event_id long, proposal_id string, customer_id string, event_type string, "
    "action_type string, proposed_by string, status string, payload map<string,string>, created_at timestamp, "
    "decision string, executed_payload map<string,string>, error_kind string, error_message string, "
    "required_approvals int, eligible_approvers array<string>"
)
QUEUE_SCHEMA = (
    "queue_id string, action_id string, tenant_id string, state string, required_approvals int, "
    "eligible_approvers array<string>, enqueued_at timestamp"
)
AUDIT_SCHEMA = (
    "tenant_id string, action_id string, event_id long, step int, kind string, actor_kind string, actor_id string, "
    "ts timestamp, payload map<string,string>"
)
REJECT_SCHEMA = "tenant_id string, event_id long, reason string"
VOTE_SCHEMA = (
    "tenant_id string, action_id string, vote_id long, vote string, decided_by string, reason string, voted_at timestamp, "
    "outcome string, n_approvals int"
)


_MAPS = ["payload", "executed_payload"]
#: The action of each event that was asked in a micro-batch: whether it is new, and the arrivals of its event so far.
ANSWER_SCHEMA = ACTION_SCHEMA + ", created boolean, arrivals long"


def rejected(events: DataFrame) -> DataFrame:
    """Rows without tenant or event id, for the reject table; they never reach the keyed state."""
    bad = events.filter(A.missing_envelope_fields(events))
    return bad.select("tenant_id", "event_id", F.lit("missing envelope field").alias("reason"))


def decided(events: DataFrame, rules: DataFrame, quorum: DataFrame) -> DataFrame:
    """Event -> proposal -> decision, once per (tenant, event), as keyed state (for update mode).

    Every arrival is proposed and decided as it comes, row by row; the state keeps the action of the first one. So an
    event that is asked again, in this micro-batch or a later one, gets the action that was stored, whatever the rules
    have become since.
    """
    good = events.filter(~A.missing_envelope_fields(events))
    actions = DC.apply_decision(DC.decide(DC.as_actions(PR.propose(good)), rules), quorum)
    flat = actions.withColumns({c: F.array_sort(F.map_entries(c)) for c in _MAPS})
    kept = first_arrivals(flat, ["tenant_id", "event_id"], ["created_at", "proposal_id"])
    return kept.withColumns({c: F.map_from_entries(c) for c in _MAPS})


def decide(answers: BatchTable, queue: BatchTable, audit: BatchTable):
    """Every answer of a micro-batch is written once; new actions also go to the approval queue and the audit log. No
    earlier batch is read."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        answers.write(batch, batch_id)
        new = answers.read_batch(batch_id).filter("created")
        queue.write(DC.queue_rows(new), batch_id)
        audit.write(DC.policy_audit(new), batch_id)

    return handle


def stored_actions(answers: BatchTable) -> DataFrame:
    """One action per (tenant, event), as it was decided when the event came first."""
    return answers.read().filter("created").drop("created", "arrivals")


def replayed_actions(answers: BatchTable) -> DataFrame:
    """The stored action once for each micro-batch in which its event was asked again."""
    return answers.read().filter("NOT created OR arrivals > 1")


#: What is kept of a group of actions, an entry for each: who approved it, how often, and whether it has ended.
_VOTING = "tenants array<string>, actions array<string>, approvers array<array<string>>, n array<int>, ended array<boolean>"
#: Groups of actions that share a state.
GROUPS = 1 << 13


def _walk(votes: pd.DataFrame, kept: dict[tuple[str, str], tuple[list, int, bool]]) -> tuple[list, list]:
    """(outcomes, tallies) of votes in order; ``kept`` goes on from the state of their actions to the one behind them."""
    outcomes, tallies = [], []
    names = ["tenant_id", "action_id", "vote", "decided_by", "may_vote", "required_approvals", "found"]
    for tenant, action, vote, who, may, needed, found in zip(*[votes[n].tolist() for n in names]):
        tally = None
        if not found:
            outcome = "not_found"
        else:
            approvers, n, ended = kept.get((tenant, action), ([], 0, False))
            if ended:
                outcome = "already_decided"
            elif not may:
                outcome = "not_eligible"
            elif vote == "reject":
                outcome, ended = "accepted", True
            elif who is not None and who in approvers:
                outcome = "duplicate"
            else:
                n += 1
                outcome, tally, ended = "accepted", n, n >= needed
                if who is not None:
                    approvers.append(who)  # at most N of them
            kept[tenant, action] = approvers, n, ended
        outcomes.append(outcome)
        tallies.append(tally)
    return outcomes, tallies


def voted(votes: DataFrame, queue: DataFrame, groups: int = GROUPS) -> DataFrame:
    """The outcome of every vote. The state keeps of each action its approvers (at most N) and whether it has ended.

    Votes take effect by micro-batch, inside one in (voted_at, vote_id) order. Eligibility is settled before the state, by
    a join of the stream to the queue; a vote on an action that is not there is ``not_found`` and makes no state. A call of
    Python costs milliseconds, so actions share a state by a hash, in ``groups`` groups: a micro-batch takes that many
    calls at most, however many actions it touches. A task holds the votes that one group gets in one micro-batch, and the
    state of its actions. A stream keeps its number of groups; one of very many actions and small micro-batches wants more,
    since a state is written whole. States have no time-out: an action that forgot its votes would accept new ones.
    """
    key = ["tenant_id", "action_id"]
    rules = queue.select(*key, "required_approvals", "eligible_approvers")
    joined = votes.join(rules, key, "left")
    found = F.col("required_approvals").isNotNull()
    named = (F.col("required_approvals") <= 1) | F.col("decided_by").isNotNull()
    may = AP.eligible(F.col("eligible_approvers"), F.col("decided_by")) & ((F.col("vote") == "reject") | named)
    names = ["vote_id", "vote", "decided_by", "reason", "voted_at"]
    group = F.pmod(F.xxhash64(*key), F.lit(groups)).alias("group")
    needed = F.coalesce("required_approvals", F.lit(0)).alias("required_approvals")
    joined = joined.select(group, *key, *names, needed, F.coalesce(may, F.lit(False)).alias("may_vote"), found.alias("found"))

    def judge(_, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(["voted_at", "vote_id"])
        kept = {}
        if state.exists:
            for tenant, action, approvers, n, ended in zip(*state.get):
                kept[tenant, action] = list(approvers), n, ended
        outcomes, tallies = _walk(rows, kept)
        if kept:
            tenants, actions = zip(*kept)
            state.update(tuple(list(column) for column in (tenants, actions, *zip(*kept.values()))))
        yield rows[[*key, *names]].assign(outcome=outcomes, n_approvals=pd.array(tallies, dtype="Int32"))

    return joined.groupBy("group").applyInPandasWithState(judge, VOTE_SCHEMA, _VOTING, "append", GroupStateTimeout.NoTimeout)
