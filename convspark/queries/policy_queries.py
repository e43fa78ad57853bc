"""Proposals, policy, decisions, approvals, audit, views and the policy study (survey 2.9, 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from convspark import values as V
from convspark.functions import text as X
from convspark.operators import approvals as AP, decisions as DC, policy as P, proposals as PR
from convspark.plans import evaluate as E, views as W
from convspark.queries import duck as D
from convspark.queries.ingest_queries import scenarios, text_events
from convspark.queries.text_queries import PHRASES
from convspark.sources import sinks, tables as T

QUERIES, ORACLE = {}, {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLE[name] = oracle
        return fn

    return register


# ---- proposals ----------------------------------------------------------------------------------

# raw model responses: every event, with a shape chosen by its id; the same text runs in both engines
_RAW = """CASE CAST(event_id % 9 AS INT)
    WHEN 0 THEN '{"action_type":"schedule_call","reasoning":"r' || event_id || '","payload":{"scheduled_for":"day ' || k || '"}}'
    WHEN 1 THEN '```json' || chr(10) || '{"action_type":"no_op","payload":{}}' || chr(10) || '```' || chr(10) || 'done'
    WHEN 2 THEN '{"action_type":"fly_away","payload":{}}'
    WHEN 3 THEN '{"action_type":"no_op","payload":["x"]}'
    WHEN 4 THEN '{"action_type":"request_document"}'
    WHEN 5 THEN '{"action_type":"no_op","payload":{}} and some prose'
    WHEN 6 THEN 'I would schedule a call.'
    WHEN 7 THEN '{"action_type":"update_status","reasoning":"why","payload":{"new_status":"open","_planner_reasoning":"own"}}'
    ELSE '' END"""
_FALL = D.case(V.FALLBACK_ACTIONS, "event_type", D.lit(V.FALLBACK_DEFAULT))
_PARSED = """CASE event_id % 9 WHEN 0 THEN 'schedule_call' WHEN 1 THEN 'no_op' WHEN 4 THEN 'request_document'
    WHEN 7 THEN 'update_status' END"""
_REASON = """CASE event_id % 9 WHEN 0 THEN 'r' || event_id WHEN 7 THEN 'own' END"""


def responses(spark, sf):
    return T.events(spark, sf).select("tenant_id", "event_id", F.expr(_RAW).alias("raw"))


@query(
    "fallback_proposals",
    D.sql(["evt"], f"""SELECT event_id, {_FALL} AS action_type, 'rule-table fallback for event_type=''' || event_type || ''''
    AS reasoning FROM evt"""),
)
def _(spark, sf):
    e = T.events(spark, sf)
    return e.select(
        "event_id",
        PR.fallback_action(F.col("event_type")).alias("action_type"),
        PR.fallback_reason(F.col("event_type")).alias("reasoning"),
    )


@query(
    "parsed_responses",
    D.sql(["evt"], f"""SELECT event_id, {_PARSED} AS action_type, {_REASON} AS reasoning,
    CASE event_id % 9 WHEN 0 THEN 2 WHEN 1 THEN 0 WHEN 4 THEN 0 WHEN 7 THEN 2 END AS n_keys FROM evt"""),
)
def _(spark, sf):
    p = responses(spark, sf).withColumn("p", PR.parse_response(F.col("raw")))
    return p.select(
        "event_id",
        "p.action_type",
        F.try_element_at("p.payload", F.lit("_planner_reasoning")).alias("reasoning"),
        F.when(F.col("p").isNotNull(), F.size("p.payload")).alias("n_keys"),
    )


@query(
    "chosen_proposals",
    D.sql(["evt"], f"""SELECT event_id, 'prop_' || left(sha256(tenant_id || '|' || event_id), 32) AS proposal_id,
    coalesce({_PARSED}, {_FALL}) AS action_type, CASE WHEN {_PARSED} IS NULL THEN 'fallback' ELSE 'llm' END AS proposed_by,
    CASE WHEN {_PARSED} IS NULL THEN 'rule-table fallback for event_type=''' || event_type || '''' ELSE {_REASON} END AS reasoning
    FROM evt"""),
)
def _(spark, sf):
    p = PR.propose(T.events(spark, sf), responses(spark, sf))
    reasoning = F.try_element_at("payload", F.lit("_planner_reasoning"))
    return p.select("event_id", "proposal_id", "action_type", "proposed_by", reasoning.alias("reasoning"))


_PH = f"{D.strlist(PHRASES)}[(doc_id % {len(PHRASES)} + 1)::INT]"


def _brief_flags_sql() -> str:
    parts, prev = [f"t0 AS (SELECT doc_id, text || ' ' || {_PH} AS b, []::VARCHAR[] AS f FROM documents)"], "t0"
    for i, (flag, pattern, repl) in enumerate(V.INJECTION_FAMILIES, 1):
        parts.append(
            f"t{i} AS (SELECT doc_id, regexp_replace(b, {D.lit('(?i)' + pattern)}, {D.lit(repl)}, 'g') AS b, "
            f"CASE WHEN {D.grep('b', pattern)} THEN list_append(f, {D.lit(flag)}) ELSE f END AS f FROM {prev})"
        )
        prev = f"t{i}"
    return f"WITH {', '.join(parts)} SELECT doc_id AS event_id, nullif(array_to_string(f, ','), '') AS flags FROM {prev}"


@query("flagged_proposals", _brief_flags_sql())
def _(spark, sf):
    """Proposals whose brief is the event's text; the flags of the rewriting are stamped on the payload."""
    phrase = T.nth(PHRASES, F.col("event_id") % len(PHRASES))
    e = text_events(spark, sf).withColumn("brief", F.concat_ws(" ", F.get_json_object("payload", "$.text"), phrase))
    p = PR.propose(e, None, F.col("brief"))
    return p.select("event_id", F.try_element_at("payload", F.lit("_injection_flags")).alias("flags"))


# ---- policy -------------------------------------------------------------------------------------

D.part("ptab", ["policy"], "SELECT tenant_id, key, decision FROM policy")


def decide_sql(tenant: str, action: str) -> str:
    at = lambda key: f"(SELECT max(decision) FROM ptab p WHERE p.tenant_id = {tenant} AND p.key = {key})"
    return f"coalesce({at(action)}, {at(D.lit('default'))}, {at(D.lit('*'))}, 'approval_required')"


D.part(
    "scen_x",
    ["scen", "ptab"],
    f"SELECT *, {decide_sql('s.tenant_id', 's.action_type')} AS expected_decision FROM scen s",
)

_LOADS = """SELECT tenant_id, CAST(extract(day FROM received_at) AS INT) AS load_id,
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS key,
    CASE WHEN event_id % 97 = 0 THEN 'maybe' WHEN event_id % 3 = 0 THEN 'auto' ELSE 'reject' END AS decision"""


@query(
    "policy_loads",
    D.sql(["evt"], f""", l AS ({_LOADS} FROM evt), d AS (SELECT tenant_id, load_id, key, min(decision) AS decision FROM l GROUP BY ALL),
    ok AS (SELECT tenant_id, load_id FROM d GROUP BY ALL HAVING count(*) FILTER (key IS NOT NULL AND decision = 'maybe') = 0),
    latest AS (SELECT tenant_id, max(load_id) AS load_id FROM ok GROUP BY ALL)
    SELECT d.tenant_id, d.key, d.decision FROM d JOIN latest USING (tenant_id, load_id) WHERE key IS NOT NULL"""),
)
def _(spark, sf):
    """Daily policy loads: the newest load without a bad rule replaces the table of its tenant."""
    e = T.events(spark, sf)
    n = F.col("event_id")
    loads = e.select(
        "tenant_id",
        F.dayofmonth("received_at").alias("load_id"),
        F.when(n % 5 != 0, F.col("event_type")).alias("key"),
        F.when(n % 97 == 0, "maybe").when(n % 3 == 0, "auto").otherwise("reject").alias("decision"),
    )
    loads = loads.groupBy("tenant_id", "load_id", "key").agg(F.min("decision").alias("decision"))
    return P.set_policies(loads)[0]


_DECIDED = "SELECT scenario_id, expected_decision AS decision FROM scen_x"


@query("declarative_decisions", D.sql(["scen_x"], _DECIDED))
def _(spark, sf):
    return P.declarative(scenarios(spark, sf), T.policy_rules(spark)).select("scenario_id", "decision")


@query("python_rule_decisions", D.sql(["scen_x"], _DECIDED))
def _(spark, sf):
    s = scenarios(spark, sf)
    return P.python_rules(s, T.policy_rules(spark), F.struct("event_type")).select("scenario_id", "decision")


D.part(
    "pjson",
    ["ptab"],
    """SELECT tenant_id, '{' || string_agg('"' || key || '": "' || decision || '"', ', ' ORDER BY key) || '}' AS j
    FROM ptab GROUP BY tenant_id""",
)
D.part(
    "judged",
    ["scen_x", "pjson"],
    f"""SELECT s.*, ((length('Tenant policy table (JSON):' || chr(10) || coalesce(j, '{{}}') || chr(10) || chr(10) ||
    'Proposed action_type: ' || action_type || chr(10) || chr(10) || 'Return ONLY the JSON object as instructed.')
    + {len(V.JUDGE_SYSTEM_PROMPT)}) // 4)::INT AS input_tokens, 32 AS output_tokens
    FROM scen_x s LEFT JOIN pjson p ON p.tenant_id = s.tenant_id""",
)
D.part(
    "naived",
    ["scen_x", "narr"],
    f"""SELECT *, ((length(prompt) + {len(V.NAIVE_SYSTEM_PROMPT)}) // 4)::INT AS input_tokens,
    ((11 + least(length(prompt), 128)) // 4)::INT AS output_tokens,
    {D.case(V.NAIVE_DECISIONS, 'event_type', D.lit(V.SAFE_DECISION))} AS decision FROM (
    SELECT s.*, 'Policy narrative:' || chr(10) || coalesce(narrative, '(no policy configured for this tenant)') || chr(10) ||
    chr(10) || 'Proposed action: ' || action_type || chr(10) || 'Source event type: ' || event_type || chr(10) || chr(10) ||
    'What should the system do?' AS prompt FROM scen_x s LEFT JOIN narr n ON n.tenant_id = s.tenant_id)""",
)


@query(
    "judge_decisions",
    D.sql(["judged"], "SELECT scenario_id, expected_decision AS decision, input_tokens, output_tokens FROM judged"),
)
def _(spark, sf):
    return P.judge(scenarios(spark, sf), T.policy_rules(spark)).select(
        "scenario_id", "decision", "input_tokens", "output_tokens"
    )


@query(
    "parsed_judgements",
    D.sql(["evt"], """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'auto' WHEN 1 THEN 'reject' ELSE 'approval_required' END
    AS decision FROM evt"""),
)
def _(spark, sf):
    raw = """CASE CAST(event_id % 6 AS INT) WHEN 0 THEN '{"decision": "auto", "reasoning": "k=' || k || '"}'
        WHEN 1 THEN '```json' || chr(10) || '{"decision": "reject"}' || chr(10) || '```'
        WHEN 2 THEN '{"decision": "auto"} because' WHEN 3 THEN '{"decision": "never"}' WHEN 4 THEN '["auto"]' ELSE '' END"""
    e = T.events(spark, sf)
    return e.select("event_id", P.parse_judge(F.expr(raw)).alias("decision"))


@query("naive_decisions", D.sql(["naived"], "SELECT scenario_id, decision, input_tokens, output_tokens FROM naived"))
def _(spark, sf):
    return P.naive(scenarios(spark, sf), T.policy_rules(spark)).select(
        "scenario_id", "decision", "input_tokens", "output_tokens"
    )


@query(
    "parsed_free_text",
    f"""WITH t AS (SELECT doc_id, lower(text || ' ' || {_PH}) AS r FROM documents) SELECT doc_id, CASE
    WHEN contains(r, 'reject') THEN 'reject' WHEN contains(r, 'approval_required') OR contains(r, 'approval required')
    THEN 'approval_required' WHEN contains(r, 'approval') THEN 'approval_required' WHEN contains(r, 'auto') THEN 'auto'
    ELSE 'approval_required' END AS decision FROM t""",
)
def _(spark, sf):
    phrase = T.nth(PHRASES, F.col("doc_id") % len(PHRASES))
    d = T.read(spark, sf, "documents")
    return d.select("doc_id", P.parse_naive(F.concat_ws(" ", "text", phrase)).alias("decision"))


@query(
    "configured_tenants",
    D.sql(["evt", "ptab"], """SELECT p.tenant_id, p.key, p.decision, e.n AS n_events FROM ptab p JOIN
    (SELECT tenant_id, count(*) AS n FROM evt GROUP BY ALL) e ON e.tenant_id = p.tenant_id"""),
)
def _(spark, sf):
    rules = T.policy_rules(spark)
    counts = T.events(spark, sf).groupBy("tenant_id").agg(F.count("*").alias("n_events"))
    listed = P.tenants(rules).join(counts, "tenant_id")
    return rules.join(listed, "tenant_id")


# ---- decisions ----------------------------------------------------------------------------------

D.part(
    "flow0",
    ["evt", "ptab"],
    f"""SELECT 'act_' || left(sha256(tenant_id || '|' || event_id), 32) AS action_id, event_id, tenant_id, customer_id,
    {_FALL} AS action_type, event_type, received_at AS created_at,
    'rule-table fallback for event_type=''' || event_type || '''' AS reasoning,
    {decide_sql('e.tenant_id', _FALL)} AS decision FROM evt e""",
)
D.part(
    "flow",
    ["flow0", "quorum"],
    """SELECT f.*, CASE decision WHEN 'reject' THEN 'rejected' WHEN 'auto' THEN
        CASE WHEN event_id % 50 = 0 THEN 'execution_failed' ELSE 'executed' END ELSE 'pending_approval' END AS status,
    coalesce(q.required_approvals, 1) AS required_approvals, q.pool FROM flow0 f
    LEFT JOIN quorum q ON q.tenant_id = f.tenant_id AND q.action_type = f.action_type""",
)


def _failures(spark, sf):
    """Every fiftieth event's executor is down."""
    e = T.events(spark, sf).filter(F.col("event_id") % 50 == 0)
    return e.select(
        X.stable_id("act_", F.col("tenant_id"), F.col("event_id")).alias("action_id"),
        F.lit("TimeoutError").alias("error_kind"),
        F.lit("executor unreachable").alias("error_message"),
    )


def flow(spark, sf):
    """All events through proposal, policy, queue and execution."""
    actions = DC.materialize(PR.propose(T.events(spark, sf)))
    decided = DC.decide(actions, T.policy_rules(spark))
    return DC.apply_decision(decided, T.quorum_rules(spark), _failures(spark, sf))


@query(
    "materialized_actions",
    D.sql(["flow0"], "SELECT action_id, event_id, action_type, 'pending_policy' AS status, reasoning FROM flow0"),
)
def _(spark, sf):
    # every event arrives twice; the replay adds nothing
    e = T.events(spark, sf)
    a = DC.materialize(PR.propose(e.unionByName(e.withColumn("received_at", F.col("received_at") + F.expr("INTERVAL 1 DAY")))))
    return a.select("action_id", "event_id", "action_type", "status", F.try_element_at("payload", F.lit("_planner_reasoning")).alias("reasoning"))


@query(
    "action_statuses",
    D.sql(["flow"], "SELECT action_id, decision, status, required_approvals, array_to_string(pool, ',') AS pool FROM flow"),
)
def _(spark, sf):
    return flow(spark, sf).select(
        "action_id", "decision", "status", "required_approvals", F.array_join("eligible_approvers", ",").alias("pool")
    )


_EFFECT = """CASE action_type
    WHEN 'send_borrower_message' THEN '{"channel":"chat","recipient":"borrower","message":"Acknowledged: we received your message for loan (unknown)."}'
    WHEN 'notify_loan_officer' THEN '{"channel":"internal","recipient":"loan_officer","reason":"' || reasoning || '"}'
    WHEN 'update_status' THEN '{"channel":"internal","new_status":"in_review"}' WHEN 'no_op' THEN '{"channel":"noop"}' END"""


@query(
    "executed_effects",
    D.sql(["flow"], f"""SELECT action_id, CASE WHEN status = 'executed' THEN {_EFFECT} END AS executed_payload,
    CASE WHEN status = 'execution_failed' THEN 'TimeoutError' END AS error_kind FROM flow WHERE decision = 'auto'"""),
)
def _(spark, sf):
    done = flow(spark, sf).filter("decision = 'auto'")
    return done.select("action_id", F.to_json("executed_payload").alias("executed_payload"), "error_kind")


@query(
    "response_effects",
    D.sql(["evt"], f"""SELECT event_id, CASE event_id % 9
    WHEN 0 THEN '{{"channel":"voice","scheduled_for":"day ' || k || '"}}' WHEN 1 THEN '{{"channel":"noop"}}'
    WHEN 4 THEN '{{"channel":"email","recipient":"borrower","document_type":"missing document"}}'
    WHEN 7 THEN '{{"channel":"internal","new_status":"open"}}' ELSE NULL END AS executed_payload FROM evt
    WHERE event_id % 9 IN (0, 1, 4, 7)"""),
)
def _(spark, sf):
    p = PR.propose(T.events(spark, sf), responses(spark, sf)).filter("proposed_by = 'llm'")
    done = DC.execute(p.withColumn("action_id", F.col("proposal_id")))
    return done.select("event_id", F.to_json("executed_payload").alias("executed_payload"))


@query(
    "unknown_action_failures",
    D.sql(["evt"], """SELECT event_id, 'execution_failed' AS status, 'ExecutionError' AS error_kind,
    'no executor registered for action_type=''' || event_type || '''' AS error_message FROM evt"""),
)
def _(spark, sf):
    a = T.events(spark, sf).select(
        "event_id", F.col("event_id").cast("string").alias("action_id"), F.col("event_type").alias("action_type"),
        F.create_map().cast("map<string,string>").alias("payload"),
    )
    return DC.execute(a).select("event_id", "status", "error_kind", "error_message")


@query(
    "quorum_rule_check",
    D.sql(["evt"], """, r AS (SELECT event_id, (event_id % 4)::INT AS n, CASE WHEN event_id % 3 = 0 THEN NULL
    WHEN event_id % 3 = 1 THEN ['a', 'b'] ELSE ['a', 'a', 'b'] END AS pool FROM evt)
    SELECT event_id, concat_ws(',', CASE WHEN n < 1 THEN 'at_least_one' END,
    CASE WHEN len(list_distinct(pool)) <> len(pool) THEN 'pool_distinct' END,
    CASE WHEN n > len(pool) THEN 'pool_large_enough' END) AS broken FROM r
    WHERE n < 1 OR len(list_distinct(pool)) <> len(pool) OR n > len(pool)"""),
)
def _(spark, sf):
    n = F.col("event_id")
    names = lambda *v: F.array(*[F.lit(x) for x in v])
    pool = F.when(n % 3 == 1, names("a", "b")).when(n % 3 == 2, names("a", "a", "b"))
    r = T.events(spark, sf).select(n, (n % 4).cast("int").alias("required_approvals"), pool.alias("eligible_approvers"))
    return DC.invalid_quorum(r).select("event_id", F.array_join("broken", ",").alias("broken"))


@query(
    "approval_queue_rows",
    D.sql(["flow"], """SELECT 'appr_' || left(sha256(action_id), 32) AS queue_id, action_id, 'pending' AS state, required_approvals
    FROM flow WHERE status = 'pending_approval' AND created_at >= TIMESTAMP '2024-01-16'"""),
)
def _(spark, sf):
    """Second enqueue run over all actions: those of the first half of the month are queued already."""
    actions = flow(spark, sf)
    queued = DC.queue_rows(actions.filter(F.col("created_at") < F.lit("2024-01-16").cast("timestamp")))
    return DC.queue_rows(actions, queued).select("queue_id", "action_id", "state", "required_approvals")


# ---- votes: eight per action, the oracle walks them in order -------------------------------------

D.part(
    "votes",
    ["evt", "flow0"],
    """SELECT f.action_id, f.tenant_id, e.event_id AS vote_id, CASE WHEN e.event_id % 17 = 0 THEN 'reject' ELSE 'approve' END AS vote,
    CASE WHEN e.event_id % 13 <> 0 THEN 'a' || (e.user_id % 6) END AS decided_by, e.received_at AS voted_at
    FROM evt e JOIN flow0 f ON f.event_id = e.event_id // 8""",
)
D.part(
    "votes_seq",
    ["votes", "flow"],
    """SELECT v.*, f.required_approvals AS n, f.pool, f.status, row_number() OVER (PARTITION BY v.action_id
    ORDER BY voted_at, vote_id) AS r FROM votes v JOIN flow f ON f.action_id = v.action_id""",
)
D.part(
    "vwalk",
    ["votes_seq"],
    """SELECT action_id, 0::BIGINT AS r, 'pending' AS state, []::VARCHAR[] AS approvals, NULL::BIGINT AS vote_id,
        NULL::VARCHAR AS outcome FROM (SELECT DISTINCT action_id FROM votes_seq)
    UNION ALL SELECT action_id, r, CASE WHEN outcome <> 'accepted' THEN state WHEN vote = 'reject' THEN 'rejected'
        WHEN n <= 1 OR len(approvals) + 1 >= n THEN 'approved' ELSE state END,
        CASE WHEN outcome = 'accepted' AND vote = 'approve' AND decided_by IS NOT NULL THEN list_append(approvals, decided_by)
        ELSE approvals END, vote_id, outcome
    FROM (SELECT w.action_id, s.r, w.state, w.approvals, s.vote_id, s.vote, s.decided_by, s.n, CASE
        WHEN s.status <> 'pending_approval' THEN 'not_found' WHEN w.state <> 'pending' THEN 'already_decided'
        WHEN s.pool IS NOT NULL AND (s.decided_by IS NULL OR NOT list_contains(s.pool, s.decided_by)) THEN 'not_eligible'
        WHEN s.vote = 'reject' OR s.n <= 1 THEN 'accepted' WHEN s.decided_by IS NULL THEN 'not_eligible'
        WHEN list_contains(w.approvals, s.decided_by) THEN 'duplicate' ELSE 'accepted' END AS outcome
        FROM vwalk w JOIN votes_seq s ON s.action_id = w.action_id AND s.r = w.r + 1)""",
)
D.part(
    "vfinal",
    ["vwalk"],
    """SELECT action_id, state, approvals, (SELECT count(*) FROM vwalk x WHERE x.action_id = w.action_id AND outcome = 'accepted')
    AS row_version FROM (SELECT *, row_number() OVER (PARTITION BY action_id ORDER BY r DESC) AS z FROM vwalk) w WHERE z = 1""",
)


def votes(spark, sf):
    e = T.events(spark, sf)
    actions = e.select(
        F.col("event_id").alias("target"),
        X.stable_id("act_", F.col("tenant_id"), F.col("event_id")).alias("action_id"),
        "tenant_id",
    )
    v = e.select(
        F.floor(F.col("event_id") / 8).alias("target"),
        F.col("event_id").alias("vote_id"),
        F.when(F.col("event_id") % 17 == 0, "reject").otherwise("approve").alias("vote"),
        F.when(F.col("event_id") % 13 != 0, F.concat(F.lit("a"), F.col("user_id") % 6)).alias("decided_by"),
        F.lit(None).cast("string").alias("reason"),
        F.col("received_at").alias("voted_at"),
    )
    return v.join(actions, "target").drop("target")


def voted(spark, sf, several: bool = False):
    """(actions, queue rows, classified votes, resolved queue rows)

    ``several``: more than one plan reads actions and votes, so they are computed once and kept in the shared folder.
    """
    keep = sinks.kept if several else lambda rows, name: rows
    actions = keep(flow(spark, sf), "actions")
    queue = DC.queue_rows(actions)
    classified = keep(AP.classify(votes(spark, sf), queue), "classified")
    return actions, queue, classified, AP.resolve(classified, queue)


@query("vote_outcomes", D.sql(["vwalk"], "SELECT vote_id, outcome FROM vwalk WHERE vote_id IS NOT NULL", recursive=True))
def _(spark, sf):
    return voted(spark, sf)[2].select("vote_id", "outcome")


@query(
    "resolved_approvals",
    D.sql(["vfinal", "flow"], """SELECT f.action_id, coalesce(v.state, 'pending') AS state,
    coalesce(array_to_string(v.approvals, ','), '') AS approvals, coalesce(row_version, 0) AS row_version
    FROM flow f LEFT JOIN vfinal v ON v.action_id = f.action_id WHERE f.status = 'pending_approval'""", recursive=True),
)
def _(spark, sf):
    r = voted(spark, sf)[3]
    return r.select("action_id", "state", F.array_join("approvals", ",").alias("approvals"), "row_version")


D.part(
    "promoted",
    ["flow", "vfinal"],
    """SELECT f.* REPLACE (CASE WHEN f.status = 'pending_approval' THEN CASE v.state WHEN 'approved' THEN 'executed'
    WHEN 'rejected' THEN 'rejected' ELSE f.status END ELSE f.status END AS status) FROM flow f
    LEFT JOIN vfinal v ON v.action_id = f.action_id""",
)


@query("promoted_actions", D.sql(["promoted"], "SELECT action_id, status FROM promoted", recursive=True))
def _(spark, sf):
    actions, _, _, resolved = voted(spark, sf)
    return AP.promote(actions, resolved).select("action_id", "status")


@query(
    "approval_progress",
    D.sql(["vfinal", "flow"], """SELECT f.action_id, f.required_approvals, coalesce(len(v.approvals), 0) AS approvals_recorded,
    greatest(0, f.required_approvals - coalesce(len(v.approvals), 0)) AS approvals_remaining,
    coalesce(array_to_string(v.approvals, ','), '') AS approvers, array_to_string(f.pool, ',') AS eligible_approvers
    FROM flow f LEFT JOIN vfinal v ON v.action_id = f.action_id WHERE f.status = 'pending_approval'""", recursive=True),
)
def _(spark, sf):
    return AP.progress(voted(spark, sf)[3]).drop("tenant_id", "state")


# ---- audit and views ----------------------------------------------------------------------------

D.part(
    "audit",
    ["flow", "vwalk", "votes_seq"],
    """SELECT tenant_id, action_id, event_id, 1 AS step, 'proposal' AS kind, 'fallback' AS actor_kind, NULL AS actor_id, created_at AS ts, NULL::BIGINT AS vote_id FROM flow
    UNION ALL SELECT tenant_id, action_id, event_id, 2, 'decision', 'system', NULL, created_at, NULL FROM flow
    UNION ALL SELECT tenant_id, action_id, event_id, 3, CASE status WHEN 'rejected' THEN 'rejection' WHEN 'executed' THEN 'execution'
        ELSE status END, 'system', NULL, created_at, NULL FROM flow WHERE status <> 'pending_approval'
    UNION ALL SELECT s.tenant_id, s.action_id, f.event_id, 1, CASE s.vote WHEN 'reject' THEN 'rejection' ELSE 'approval' END,
        'human', s.decided_by, s.voted_at, s.vote_id FROM vwalk w JOIN votes_seq s ON s.vote_id = w.vote_id JOIN flow f
        ON f.action_id = s.action_id WHERE w.outcome = 'accepted'
    UNION ALL SELECT s.tenant_id, s.action_id, f.event_id, 2, 'execution', 'system', NULL, s.voted_at, s.vote_id FROM vwalk w
        JOIN votes_seq s ON s.vote_id = w.vote_id JOIN flow f ON f.action_id = s.action_id
        WHERE w.outcome = 'accepted' AND w.state = 'approved'""",
)
D.part(
    "audit_n",
    ["audit"],
    "SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY ts, action_id, step, vote_id NULLS FIRST) AS audit_id FROM audit",
)


def audit(spark, sf, flow_and_votes=None):
    actions, _, classified, _ = flow_and_votes or voted(spark, sf, several=True)
    entries = DC.policy_audit(actions).unionByName(DC.vote_audit(classified, actions))
    return sinks.with_audit_ids(entries, ["ts", "action_id", "step", "vote_id"])


_ENTRY = ["tenant_id", "audit_id", "action_id", "event_id", "kind", "actor_kind", "actor_id"]


@query("audit_entries", D.sql(["audit_n"], f"SELECT {', '.join(_ENTRY)} FROM audit_n", recursive=True))
def _(spark, sf):
    return audit(spark, sf).select(*_ENTRY)


@query(
    "approval_tallies",
    D.sql(["vwalk", "votes_seq"], """SELECT s.vote_id, s.n AS required, CASE WHEN s.decided_by IS NULL THEN 1 ELSE len(w.approvals) END AS recorded,
    w.state = 'approved' AS quorum_reached FROM vwalk w JOIN votes_seq s ON s.vote_id = w.vote_id
    WHERE w.outcome = 'accepted' AND s.vote = 'approve'""", recursive=True),
)
def _(spark, sf):
    """Running tally carried by the audit entry of every accepted approval."""
    c = voted(spark, sf)[2].filter("outcome = 'accepted' AND vote = 'approve'")
    return c.select(
        "vote_id", F.col("required_approvals").alias("required"), F.col("n_approvals").alias("recorded"),
        (F.col("n_approvals") >= F.col("required_approvals")).alias("quorum_reached"),
    )


@query(
    "tenant_actions",
    D.sql(["flow"], "SELECT action_id, status FROM flow WHERE tenant_id = 't2'"),
)
def _(spark, sf):
    return W.actions_of(flow(spark, sf), "t2").select("action_id", "status")


@query(
    "pending_actions",
    D.sql(["promoted"], "SELECT tenant_id, action_id, action_type, created_at::VARCHAR AS enqueued FROM promoted WHERE status = 'pending_approval'",
          recursive=True),
)
def _(spark, sf):
    actions, _, _, resolved = voted(spark, sf)
    p = W.pending(resolved, actions.drop("required_approvals"))
    stamp = F.regexp_replace(F.date_format("enqueued_at", "yyyy-MM-dd HH:mm:ss.SSSSSS"), r"\.?0+$", "")
    return p.select("tenant_id", "action_id", "action_type", stamp.alias("enqueued"))


@query(
    "action_views",
    D.sql(["promoted", "audit"], """SELECT p.action_id, p.status, p.reasoning,
    (SELECT string_agg(kind, '>' ORDER BY ts, step, vote_id NULLS FIRST, kind) FROM audit a WHERE a.action_id = p.action_id) AS trail FROM promoted p""",
          recursive=True),
)
def _(spark, sf):
    parts = voted(spark, sf, several=True)
    actions, _, _, resolved = parts
    view = W.action_view(AP.promote(actions, resolved), audit(spark, sf, parts))
    return view.select("action_id", "status", "reasoning", F.array_join(F.transform("audit_trail", lambda a: a["kind"]), ">").alias("trail"))


@query(
    "recent_audit",
    D.sql(["audit_n"], """SELECT tenant_id, audit_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id
    ORDER BY audit_id DESC) AS n FROM audit_n) WHERE n <= 20""", recursive=True),
)
def _(spark, sf):
    return W.recent_audit(audit(spark, sf)).select("tenant_id", "audit_id", "kind")


@query(
    "tenants_seen",
    D.sql(["audit"], "SELECT tenant_id, epoch_us(min(ts)) AS first_us FROM audit GROUP BY tenant_id", recursive=True),
)
def _(spark, sf):
    return W.tenants_seen(audit(spark, sf)).select("tenant_id", F.unix_micros("first_ts").alias("first_us"))


@query(
    "visible_payloads",
    D.sql(["evt"], f"""SELECT event_id, CASE event_id % 9 WHEN 0 THEN 'scheduled_for=day ' || k WHEN 7 THEN 'new_status=open' ELSE '' END AS payload
    FROM evt"""),
)
def _(spark, sf):
    p = PR.propose(T.events(spark, sf), responses(spark, sf))
    shown = F.transform(F.array_sort(F.map_entries(W.visible_payload())), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return p.select("event_id", F.array_join(shown, ",").alias("payload"))


@query(
    "decision_times",
    D.sql(["audit"], """SELECT tenant_id, action_id, epoch_us(min(ts) FILTER (kind = 'approval')) AS approved_us,
    epoch_us(min(ts) FILTER (kind = 'rejection')) AS rejected_us FROM audit GROUP BY ALL
    HAVING count(*) FILTER (kind IN ('approval', 'rejection')) > 0""", recursive=True),
)
def _(spark, sf):
    t = W.decision_times(audit(spark, sf))
    return t.select("tenant_id", "action_id", F.unix_micros("approved_at").alias("approved_us"), F.unix_micros("rejected_at").alias("rejected_us"))


@query(
    "audit_of_event",
    D.sql(["audit"], "SELECT tenant_id, kind, step FROM audit WHERE event_id = 100", recursive=True),
)
def _(spark, sf):
    return W.audit_for(audit(spark, sf), event_id=100).select("tenant_id", "kind", "step")


# ---- policy study -------------------------------------------------------------------------------

D.part(
    "study",
    ["judged", "naived"],
    """SELECT 'declarative' AS strategy, scenario_id, event_id, tenant_id, event_type, expected_decision, expected_decision AS decision,
        0 AS input_tokens, 0 AS output_tokens FROM scen_x
    UNION ALL SELECT 'python_rules', scenario_id, event_id, tenant_id, event_type, expected_decision, expected_decision, 0, 0 FROM scen_x
    UNION ALL SELECT 'llm_judge', scenario_id, event_id, tenant_id, event_type, expected_decision, expected_decision, input_tokens, output_tokens FROM judged
    UNION ALL SELECT 'naive_llm', scenario_id, event_id, tenant_id, event_type, expected_decision, decision, input_tokens, output_tokens FROM naived""",
)


def study(spark, sf):
    """Four engines on every scenario, against the decision of the policy table."""
    rules = T.policy_rules(spark)
    stamped = P.declarative(scenarios(spark, sf), rules, "expected_decision")
    return E.policy_results(P.all_engines(stamped, rules))


@query("stamped_scenarios", D.sql(["scen_x"], "SELECT scenario_id, action_type, expected_decision FROM scen_x"))
def _(spark, sf):
    s = P.declarative(scenarios(spark, sf), T.policy_rules(spark), "expected_decision")
    return s.select("scenario_id", "action_type", "expected_decision")


@query(
    "policy_results",
    D.sql(["study"], "SELECT strategy, scenario_id, expected_decision, decision, decision = expected_decision AS correct FROM study"),
)
def _(spark, sf):
    return study(spark, sf).select("strategy", "scenario_id", "expected_decision", "decision", "correct")


@query(
    "policy_correctness",
    D.sql(["study"], """, r AS (SELECT *, CASE WHEN decision = expected_decision THEN 1.0 ELSE 0.0 END AS c FROM study)
    SELECT strategy, 'all' AS dimension, '*' AS value, count(*) AS n, round(avg(c), 4) AS correctness FROM r GROUP BY ALL
    UNION ALL SELECT strategy, 'tenant', tenant_id, count(*), round(avg(c), 4) FROM r GROUP BY ALL
    UNION ALL SELECT strategy, 'event_type', event_type, count(*), round(avg(c), 4) FROM r GROUP BY ALL
    UNION ALL SELECT strategy, 'expected_decision', expected_decision, count(*), round(avg(c), 4) FROM r GROUP BY ALL"""),
)
def _(spark, sf):
    return E.correctness(study(spark, sf))


@query(
    "policy_confusion",
    D.sql(["study"], """SELECT strategy, expected_decision, count(*) FILTER (decision = 'auto') AS observed_auto,
    count(*) FILTER (decision = 'approval_required') AS observed_approval_required,
    count(*) FILTER (decision = 'reject') AS observed_reject FROM study GROUP BY ALL"""),
)
def _(spark, sf):
    return E.confusion(study(spark, sf))


@query(
    "policy_failures",
    D.sql(["study"], """SELECT strategy, n, scenario_id, failed_total FROM (SELECT strategy, scenario_id,
    row_number() OVER (PARTITION BY strategy ORDER BY event_id) AS n, count(*) OVER (PARTITION BY strategy) AS failed_total
    FROM study WHERE decision <> expected_decision) WHERE n <= 25"""),
)
def _(spark, sf):
    return E.failed_preview(study(spark, sf), "event_id")


_COST = """SELECT strategy, count(*) AS n, count(*) FILTER (input_tokens > 0) AS n_calls,
    round(avg(CASE WHEN decision = expected_decision THEN 1.0 ELSE 0.0 END), 4) AS correctness,
    round((sum(input_tokens) / 1e6 * 3.0 + sum(output_tokens) / 1e6 * 15.0) / count(*) * 100, 6) AS usd_per_100,
    round(0.0057 * 100 * count(*) FILTER (input_tokens > 0) / count(*), 4) AS projected_usd_per_100 FROM study GROUP BY strategy"""


@query("policy_cost", D.sql(["study"], _COST))
def _(spark, sf):
    return E.decision_cost(study(spark, sf))


@query(
    "policy_frontier",
    D.sql(["study"], f"""SELECT c.*, r.auditability, r.maintainability FROM ({_COST}) c JOIN (VALUES ('declarative', 5, 5),
    ('python_rules', 3, 2), ('naive_llm', 2, 4), ('llm_judge', 4, 4)) r(strategy, auditability, maintainability) USING (strategy)"""),
)
def _(spark, sf):
    return E.frontier(E.decision_cost(study(spark, sf)))


@query(
    "policy_failure_shape",
    D.sql(["study"], """, r AS (SELECT * FROM study WHERE strategy = 'naive_llm'),
    p AS (SELECT tenant_id, expected_decision, decision, count(*) AS c, min(event_id) AS seen FROM r
        WHERE decision <> expected_decision GROUP BY ALL),
    t AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY c DESC, seen) AS z FROM p)
    SELECT r.tenant_id, count(*) AS n, count(*) FILTER (r.decision = r.expected_decision) AS n_correct,
    round(avg(CASE WHEN r.decision = r.expected_decision THEN 1.0 ELSE 0.0 END), 3) AS correctness,
    count(*) FILTER (r.decision <> r.expected_decision) AS n_failures, any_value(t.expected_decision) AS top_expected,
    any_value(t.decision) AS top_observed, any_value(t.c) AS top_count
    FROM r LEFT JOIN t ON t.tenant_id = r.tenant_id AND t.z = 1 GROUP BY r.tenant_id"""),
)
def _(spark, sf):
    return E.failure_shape(study(spark, sf), "naive_llm", "event_id")
