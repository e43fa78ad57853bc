"""DuckDB text for the oracle side: shared expressions and named WITH parts over the same tables."""

from __future__ import annotations

from convspark import values as V

EVENT_TYPE = (
    "CASE event_type WHEN 'view' THEN 'message_received' WHEN 'click' THEN 'document_uploaded' "
    "WHEN 'purchase' THEN 'status_changed' WHEN 'error' THEN 'anomaly_detected' WHEN 'signup' THEN 'system_event' END"
)


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strlist(items) -> str:
    return "[" + ", ".join(lit(i) for i in items) + "]"


def case(mapping: dict[str, str], key: str, default: str = "NULL") -> str:
    return f"CASE {key} " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in mapping.items()) + f" ELSE {default} END"


def tok(x: str, v: str = "t") -> str:
    return f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda {v}: length({v}) >= 2)"


def fnv(t: str) -> str:
    codes = f"list_transform(string_split({t}, ''), lambda ch: ascii(ch)::BIGINT)"
    return (
        f"list_reduce(list_concat([{V.FNV_OFFSET}::BIGINT], {codes}), "
        f"lambda h, x: (xor(h, x) * {V.FNV_PRIME}) & 4294967295)"
    )


def repr_(x: str) -> str:
    body = f"replace(replace(replace(replace({x}, '\\', '\\\\'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')"
    return (
        f"CASE WHEN contains({x}, '''') AND NOT contains({x}, '\"') THEN '\"' || {body} || '\"' "
        f"WHEN contains({x}, '''') THEN '''' || replace({body}, '''', '\\''') || '''' "
        f"ELSE '''' || {body} || '''' END"
    )


def minute(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M')"


def rtok(x: str) -> str:
    return (
        f"list_filter(list_distinct(string_split_regex(lower({x}), '[^a-z0-9]+')), lambda t: "
        f"length(t) >= (CASE WHEN regexp_matches(t, '[0-9]') THEN 2 ELSE 3 END) "
        f"AND NOT list_contains({strlist(V.STOPWORDS)}, t))"
    )


def recall(n: str, h: str) -> str:
    return f"CASE WHEN len({n}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({n}, {h}))::DOUBLE / len({n}) END"


def score(r: str) -> str:
    return "(1 + " + " + ".join(f"(CASE WHEN {r} >= {t}::DOUBLE THEN 1 ELSE 0 END)" for t in V.SCORE_THRESHOLDS) + ")"


def bucket(n: str) -> str:
    return (
        f"CASE WHEN {n} BETWEEN 10 AND 30 THEN 'short' WHEN {n} BETWEEN 31 AND 100 THEN 'medium' "
        f"WHEN {n} BETWEEN 101 AND 300 THEN 'long' WHEN {n} BETWEEN 301 AND 500 THEN 'very_long' "
        f"WHEN {n} > 500 THEN 'very_long' ELSE 'short' END"
    )


def grep(x: str, pattern: str) -> str:
    return f"regexp_matches({x}, {lit('(?i)' + pattern)})"


LINE = "'[' || channel || '] ' || " + minute("ts") + " || ' ' || sender || ': ' || content"

PARTS = {
    "evt": f"""SELECT event_id, 't' || (user_id % 5) AS tenant_id, 'c' || user_id AS customer_id, user_id,
        {strlist(V.CHANNELS)}[(event_id % 5 + 1)::INT] AS channel_code, {EVENT_TYPE} AS event_type,
        user_id || '-' || {EVENT_TYPE} || '-' || strftime(ts, '%Y-%m-%d') AS idempotency_key, value,
        json_extract_string(props, '$.k') AS k, ts AS received_at FROM events""",
    "msg": f"""SELECT 't' || (conv_id % 5) AS tenant_id, 'c' || conv_id AS customer_id, conv_id, turn AS seq,
        {strlist(V.CHANNELS[:4])}[(turn % 4 + 1)::INT] AS channel, role AS sender, text AS content,
        TIMESTAMP '2024-01-01' + to_seconds(conv_id * 86400 + turn * 64800) AS ts,
        CASE WHEN turn % 4 = 1 THEN role || '''s turn ' || turn END AS subject,
        CASE WHEN turn % 4 = 2 THEN ['img-' || conv_id, 'scan-' || turn] END AS attachments FROM conversations""",
    "msg_line": f"""SELECT *, {LINE} || CASE WHEN subject IS NOT NULL THEN ' (subject=' || {repr_('subject')} || ')'
        WHEN attachments IS NOT NULL THEN ' (attachments=[' || array_to_string(attachments, ', ') || '])' ELSE '' END
        AS body, {LINE} AS line FROM msg""",
    "act": f"""SELECT tenant_id, customer_id, event_id AS seq, event_type AS action_type, k, received_at AS ts,
        '[action] ' || {minute('received_at')} || ' ' || event_type || ' (k=' || k || ')' AS body,
        event_type || ' k ' || k AS text FROM evt""",
    "lastu": "SELECT conv_id, max(turn) AS lt FROM conversations WHERE role = 'user' GROUP BY conv_id",
    "carved": f"""SELECT l.conv_id, l.lt, u.text AS query, coalesce(a.text, {lit(V.NO_TRUTH)}) AS truth FROM lastu l
        JOIN conversations u ON u.conv_id = l.conv_id AND u.turn = l.lt
        LEFT JOIN conversations a ON a.conv_id = l.conv_id AND a.turn = l.lt + 1 AND a.role = 'assistant'""",
    "hm": """SELECT 'p' || m.conv_id AS pair_id, m.* FROM msg_line m JOIN lastu l
        ON m.conv_id = l.conv_id AND m.seq < l.lt""",
    "ha": """SELECT 'p' || l.conv_id AS pair_id, a.* FROM act a JOIN lastu l ON a.customer_id = 'c' || l.conv_id""",
    "hcount": """SELECT pair_id, count(*) AS n_rows, sum(is_msg) AS n_messages FROM
        (SELECT pair_id, 1 AS is_msg FROM hm UNION ALL SELECT pair_id, 0 FROM ha) GROUP BY pair_id""",
    "intents": "SELECT unnest(" + strlist(V.FACT_INTENTS + ["greeting", "courtesy"]) + ") AS intent, "
    "unnest(range(12)) AS i",
    "pairs": f"""SELECT 'p' || c.conv_id AS pair_id, 't' || (c.conv_id % 5) AS tenant_id, 'c' || c.conv_id AS customer_id,
        c.query, c.truth AS ground_truth, coalesce(n_messages, 0)::BIGINT AS n_messages,
        {bucket('coalesce(n_rows, 0)')} AS bucket, i.intent
        FROM carved c LEFT JOIN hcount h ON h.pair_id = 'p' || c.conv_id JOIN intents i ON i.i = c.conv_id % 12""",
    "policy": """SELECT * FROM (VALUES ('t0','default','approval_required'), ('t0','send_borrower_message','auto'),
        ('t0','update_status','auto'), ('t0','no_op','auto'), ('t0','schedule_call','reject'), ('t1','*','reject'),
        ('t1','notify_loan_officer','auto'), ('t1','send_borrower_message','approval_required'), ('t2','*','auto'))
        v(tenant_id, key, decision)""",
    "quorum": """SELECT * FROM (VALUES ('t0','notify_loan_officer',2,['a0','a1','a2','a3','a4']),
        ('t1','send_borrower_message',3,NULL), ('t3','send_borrower_message',2,NULL),
        ('t3','notify_loan_officer',2,['a0','a1','a2'])) v(tenant_id, action_type, required_approvals, pool)""",
}
# what each part reads, in definition order
NEEDS = {
    "msg_line": ["msg"],
    "act": ["evt"],
    "carved": ["lastu"],
    "hm": ["msg_line", "lastu"],
    "ha": ["act", "lastu"],
    "hcount": ["hm", "ha"],
    "pairs": ["carved", "hcount", "intents"],
}


def part(name: str, needs: list[str], text: str) -> str:
    """Register a further WITH part and return its name."""
    PARTS[name], NEEDS[name] = text, needs
    return name


def sql(needs: list[str], body: str, recursive: bool = False) -> str:
    """``body`` preceded by the WITH parts it needs."""
    order: list[str] = []

    def visit(name):
        for n in NEEDS.get(name, []):
            visit(n)
        if name not in order:
            order.append(name)

    for n in needs:
        visit(n)
    parts = ",\n".join(f"{n} AS {'MATERIALIZED ' if n.endswith(('_seq', 'sim')) else ''}({PARTS[n]})" for n in order)
    keyword = "WITH RECURSIVE" if recursive else "WITH"
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"{keyword} {parts},\n{body[5:]}" if parts else body
    return f"{keyword} {parts}\n{body}" if parts else body
