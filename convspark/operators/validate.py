"""Request validation, key resolution, quarantine and constraint checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from convspark import values as V
from convspark.functions import safety, text as X


def parse_requests(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Typed fields plus ``errors``: one entry per rule broken, empty for a valid request.

    The document is parsed once, then each field once; Spark keeps the three steps apart because later ones use the
    parsed values several times.
    """
    names = [c for c in raw.columns]
    parsed = raw.select("*", F.try_parse_json(F.col(column)).alias("_v"), F.json_object_keys(F.col(column)).alias("_keys"))
    # kind of each field: VOID for JSON null, MISSING when absent, so that the rules below never see an unknown
    field = lambda f: F.try_variant_get("_v", f"$.{f}", "variant")
    kind_of = lambda f: F.coalesce(
        F.schema_of_variant(field(f)), F.when(F.array_contains("_keys", f), "VOID").otherwise("MISSING")
    )
    fields = parsed.select(
        *names,
        "_keys",
        F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False)).alias("_is_object"),
        *[kind_of(f).alias(f"_kind_{f}") for f in V.REQUEST_FIELDS],
        *[F.try_variant_get("_v", f"$.{f}", "string").alias(f) for f in V.REQUEST_FIELDS[:-1]],
        F.coalesce(F.get_json_object(column, "$.payload"), F.lit("{}")).alias("payload"),
    )
    string = lambda f: F.col(f"_kind_{f}") == "STRING"
    optional = lambda f: F.col(f"_kind_{f}").isin("VOID", "MISSING")
    size = lambda f: F.length(f)
    rule = lambda bad, name: F.when(bad, F.lit(name))
    broken = F.array(
        rule(~string("tenant_id") | ~size("tenant_id").between(1, 64), "tenant_id"),
        rule(~optional("customer_id") & (~string("customer_id") | (size("customer_id") > 64)), "customer_id"),
        rule(~string("channel_code") | ~F.col("channel_code").isin(V.CHANNELS), "channel_code"),
        rule(~string("event_type") | ~F.col("event_type").isin(V.EVENT_TYPES), "event_type"),
        rule(
            ~optional("idempotency_key") & (~string("idempotency_key") | ~size("idempotency_key").between(1, 128)),
            "idempotency_key",
        ),
        rule(~F.col("_kind_payload").startswith("OBJECT") & (F.col("_kind_payload") != "MISSING"), "payload"),
    )
    extra = F.array_except("_keys", F.array(*[F.lit(f) for f in V.REQUEST_FIELDS]))
    errors = F.when(F.col("_is_object"), F.array_compact(F.concat(broken, extra))).otherwise(F.array(F.lit("body")))
    tenant = F.when(F.col("_is_object") & string("tenant_id"), X.blank_to_null(F.col("tenant_id")))
    return fields.select(
        *names,
        *V.REQUEST_FIELDS,
        errors.alias("errors"),
        F.coalesce(tenant, F.lit("_unparseable_")).alias("quarantine_tenant"),
    )


def split_valid(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantine rows)."""
    bad = parsed.filter(F.size("errors") > 0).select(
        F.col("quarantine_tenant").alias("tenant_id"),
        F.lit("validation_failed").alias("reason"),
        F.concat(F.lit("validation failed: "), F.size("errors"), F.lit(" error(s)")).alias("detail"),
        F.col("raw").alias("raw_payload"),
    )
    return parsed.filter(F.size("errors") == 0).drop("errors", "quarantine_tenant"), bad


def resolve_key(header: Column, body: Column) -> tuple[Column, Column]:
    """(idempotency key, rejection reason or null)."""
    h, b = X.blank_to_null(header), X.blank_to_null(body)
    reason = F.when(h.isNull() & b.isNull(), "missing_idempotency_key").when(
        h.isNotNull() & b.isNotNull() & (h != b), "idempotency_key_mismatch"
    )
    return F.coalesce(h, b), reason


# a JSON string, with the colon behind it if it is a key
_STRING_TOKEN = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*+:)?'


def payload_strings(payload: Column) -> Column:
    """String leaves of a JSON payload at any depth, in document order (keys excluded); a null payload has none.

    Outside strings JSON has no quotes, so the string tokens are found without walking the tree; those before a colon
    are keys, and the rest is parsed at once.
    """
    tokens = F.regexp_extract_all(F.coalesce(payload, F.lit("")), F.lit(_STRING_TOKEN), F.lit(0))
    leaves = F.filter(tokens, lambda t: ~F.endswith(t, F.lit(":")))
    return F.from_json(F.concat(F.lit("["), F.array_join(leaves, ","), F.lit("]")), "array<string>")


def quarantine_injections(events: DataFrame, leaves: Column) -> DataFrame:
    """Non-blocking rows for events whose payload holds injection text; replays are reported again."""
    hit = F.exists(leaves, lambda s: safety.has_markers(s))
    return events.filter(hit).select(
        "tenant_id",
        "event_id",
        F.lit("injection_suspected").alias("reason"),
        F.lit(False).alias("blocking"),
    )


def unknown_customers(events: DataFrame, customers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events to go on with, events naming a customer their tenant does not have)."""
    known = customers.select("tenant_id", "customer_id").distinct()
    anonymous = events.filter(F.col("customer_id").isNull())
    named = events.filter(F.col("customer_id").isNotNull())
    rejected = named.join(known, ["tenant_id", "customer_id"], "left_anti")
    passed = named.join(known, ["tenant_id", "customer_id"], "left_semi")
    return anonymous.unionByName(passed), rejected


def missing_envelope_fields(envelopes: DataFrame) -> Column:
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    return blank("tenant_id") | blank("event_id")


# (entity, rule, predicate that marks a violation)
CONSTRAINTS = [
    ("actions", "executed_at_iff_executed", "(status = 'executed') <> (executed_at IS NOT NULL)"),
    ("actions", "status_enum", "status NOT IN (" + ", ".join(f"'{s}'" for s in V.ACTION_STATUSES) + ")"),
    ("actions", "action_type_enum", "action_type NOT IN (" + ", ".join(f"'{s}'" for s in V.ACTION_TYPES) + ")"),
    ("briefs", "tokens_within_budget", "brief_tokens > token_budget"),
    ("quorum", "at_least_one", "required_approvals < 1"),
    ("quorum", "pool_large_enough", "eligible_approvers IS NOT NULL AND required_approvals > size(eligible_approvers)"),
    (
        "quorum",
        "pool_distinct",
        "eligible_approvers IS NOT NULL AND size(array_distinct(eligible_approvers)) <> size(eligible_approvers)",
    ),
    ("tenants", "slug_pattern", "NOT slug RLIKE '^[a-z0-9][a-z0-9-]*$'"),
    ("policies", "decision_enum", "decision NOT IN (" + ", ".join(f"'{s}'" for s in V.DECISIONS) + ")"),
    ("events", "channel_enum", "channel_code NOT IN (" + ", ".join(f"'{s}'" for s in V.CHANNELS) + ")"),
    ("events", "event_type_enum", "event_type NOT IN (" + ", ".join(f"'{s}'" for s in V.EVENT_TYPES) + ")"),
]
UNIQUE_KEYS = {
    "customer_identities": ["tenant_id", "kind", "value"],
    "events": ["tenant_id", "idempotency_key"],
    "policies": ["tenant_id", "key"],
    "approval_queue": ["action_id"],
}


def violations(rows: DataFrame, entity: str, id_col: Column) -> DataFrame:
    """One row per broken rule of ``entity``."""
    rules = [(rule, predicate) for e, rule, predicate in CONSTRAINTS if e == entity]
    broken = F.array_compact(F.array(*[F.when(F.expr(p), F.lit(rule)) for rule, p in rules]))
    return rows.select(F.lit(entity).alias("entity"), id_col.cast("string").alias("id"), F.explode(broken).alias("rule"))


def duplicate_keys(rows: DataFrame, entity: str) -> DataFrame:
    keys = UNIQUE_KEYS[entity]
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").select(F.lit(entity).alias("entity"), *keys, "n")


def for_tenant(rows: DataFrame, tenant_id: str, **match) -> DataFrame:
    """Tenant-scoped read: a row of another tenant looks the same as a missing one."""
    rows = rows.filter(F.col("tenant_id") == tenant_id)
    for column, wanted in match.items():
        rows = rows.filter(F.col(column) == wanted)
    return rows


def project_messages(events: DataFrame, payload: str = "payload") -> DataFrame:
    """Inbound messages of message_received events; text is payload ``text`` or ``body``."""
    body = F.coalesce(F.get_json_object(payload, "$.text"), F.get_json_object(payload, "$.body"))
    return events.filter(F.col("event_type") == "message_received").select(
        "tenant_id",
        "customer_id",
        "event_id",
        "channel_code",
        F.lit("inbound").alias("direction"),
        body.alias("body"),
        F.col("received_at").alias("sent_at"),
    )
