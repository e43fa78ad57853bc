"""Text, hash, vector and math functions as Column builders. Nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from convspark import values as V

# Python's notion of white space, which is wider than Spark's trim()
_EDGE_SPACE = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE_SPACE, "")


def blank_to_null(c: Column) -> Column:
    return F.when(c != "", c)


# ---- tokens and hashed bag of words -------------------------------------------------------------


def tokens(c: Column) -> Column:
    """Lower-cased alphanumeric runs of length >= 2, in order."""
    parts = F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+")
    return F.filter(parts, lambda t: F.length(t) >= 2)


def fnv1a32(token: Column) -> Column:
    """FNV-1a, 32 bit, of an ASCII token; BIGINT arithmetic stays below 2^56."""
    codes = F.transform(F.split(token, ""), lambda ch: F.ascii(ch).cast("long"))
    step = lambda h, x: (h.bitwiseXOR(x) * F.lit(V.FNV_PRIME).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(token == "", F.lit(V.FNV_OFFSET)).otherwise(F.aggregate(codes, F.lit(V.FNV_OFFSET), step))


def buckets(c: Column) -> Column:
    """One hash bucket per token, repeats kept, sorted so that equal buckets are neighbours."""
    return F.sort_array(F.transform(tokens(c), lambda t: (fnv1a32(t) % V.EMBED_BUCKETS).cast("int")))


def squared_norm(sorted_buckets: Column) -> Column:
    """Sum of squared bucket counts: each step of a run of length n adds 2n+1."""
    start = F.struct(F.lit(-1).alias("b"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("sq"))

    def step(s, b):
        run = F.when(s["b"] == b, s["run"]).otherwise(F.lit(0).cast("long"))
        return F.struct(b.alias("b"), (run + 1).alias("run"), (s["sq"] + 2 * run + 1).alias("sq"))

    return F.aggregate(sorted_buckets, start, step, lambda s: s["sq"])


def bucket_dot(text_buckets: Column, query_counts: Column) -> Column:
    """Dot product: every text token adds the query's count of its bucket."""
    weight = lambda b: F.coalesce(F.try_element_at(query_counts, b), F.lit(0).cast("long"))
    return F.aggregate(text_buckets, F.lit(0).cast("long"), lambda s, b: s + weight(b))


def bucket_counts(text_buckets: Column) -> Column:
    """Sparse vector as MAP<bucket, count>; meant for short texts such as queries."""
    pairs = F.transform(
        F.array_distinct(text_buckets),
        lambda b: F.struct(b, F.size(F.filter(text_buckets, lambda x: x == b)).cast("long")),
    )
    return F.map_from_entries(pairs)


def cosine(text_buckets: Column, query_counts: Column, query_sq: Column) -> Column:
    sq = squared_norm(text_buckets)
    norm = F.sqrt(query_sq.cast("double")) * F.sqrt(sq.cast("double"))
    return F.when(norm > 0, bucket_dot(text_buckets, query_counts) / norm).otherwise(F.lit(0.0))


def map_cosine(a: Column, b: Column) -> Column:
    """Cosine of two sparse vectors stored as MAP<bucket, double>; 0 when either is empty."""
    sq = lambda m: F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v * v)
    dot = F.aggregate(
        F.map_entries(a),
        F.lit(0.0),
        lambda s, e: s + e["value"] * F.coalesce(F.try_element_at(b, e["key"]), F.lit(0.0)),
    )
    norm = F.sqrt(sq(a)) * F.sqrt(sq(b))
    return F.when(norm > 0, dot / norm).otherwise(F.lit(0.0))


def bigrams(toks: Column) -> Column:
    pair = F.zip_with(
        F.slice(toks, 1, F.greatest(F.size(toks) - 1, F.lit(0))),
        F.slice(toks, 2, F.greatest(F.size(toks) - 1, F.lit(0))),
        lambda x, y: F.concat_ws(" ", x, y),
    )
    return F.when(F.size(toks) >= 2, F.array_distinct(pair)).otherwise(F.array().cast("array<string>"))


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def recency_decay(ts: Column, now: Column) -> Column:
    age_days = (F.unix_micros(now) - F.unix_micros(ts)) / F.lit(86400e6)
    return F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_days) / F.lit(V.HALF_LIFE_DAYS))


# ---- token estimates and rendering --------------------------------------------------------------


def estimate_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / 4).cast("int")


def query_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), estimate_tokens(c))


def py_repr(c: Column) -> Column:
    """Quoting of a printable string the way the rendered briefs expect it."""
    body = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for raw, esc in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(raw), F.lit(esc))
    single, double = F.contains(c, F.lit("'")), F.contains(c, F.lit('"'))
    return (
        F.when(single & ~double, F.concat(F.lit('"'), body, F.lit('"')))
        .when(single, F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))
        .otherwise(F.concat(F.lit("'"), body, F.lit("'")))
    )


def minute(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def plain_line(channel: Column, ts: Column, sender: Column, content: Column) -> Column:
    return F.concat(F.lit("["), channel, F.lit("] "), minute(ts), F.lit(" "), sender, F.lit(": "), content)


def message_line(channel, ts, sender, content, subject, attachments, extras: Column | None = None) -> Column:
    """``extras`` replaces what subject and attachments render to, see ``metadata_extras``."""
    if extras is None:
        extras = F.concat_ws(
            "; ",
            F.when(subject.isNotNull(), F.concat(F.lit("subject="), py_repr(subject))),
            F.when(
                attachments.isNotNull(),
                F.concat(F.lit("attachments=["), F.array_join(attachments, ", "), F.lit("]")),
            ),
        )
    tail = F.when(extras != "", F.concat(F.lit(" ("), extras, F.lit(")"))).otherwise(F.lit(""))
    return F.concat(plain_line(channel, ts, sender, content), tail)


def _variant_text(value: Column, quote: bool) -> Column:
    """A JSON scalar as text; strings quoted or as they are. Objects stay JSON text."""
    kind, plain = F.schema_of_variant(value), value.cast("string")
    text = F.when(kind == "VOID", "None").when(kind == "BOOLEAN", F.initcap(plain))
    if quote:
        text = text.when(kind == "STRING", py_repr(plain))
    return text.otherwise(plain)


def _variant_items(value: Column, quote: bool) -> Column:
    items = F.try_variant_get(value, "$", "array<variant>")
    return F.array_join(F.transform(items, lambda x: _variant_text(x, quote)), ", ")


def _is_list(value: Column) -> Column:
    return F.startswith(F.schema_of_variant(value), F.lit("ARRAY"))


def detail(key: Column, value: Column) -> Column:
    """One action detail from its JSON value: ``v`` for the line, where a list is joined, and ``s`` for scoring, where it
    keeps brackets and quotes."""
    line = F.when(_is_list(value), _variant_items(value, False)).otherwise(_variant_text(value, False))
    scored = F.when(_is_list(value), F.concat(F.lit("["), _variant_items(value, True), F.lit("]")))
    return F.struct(key.alias("k"), line.alias("v"), scored.otherwise(_variant_text(value, False)).alias("s"))


def metadata_extras(metadata: Column) -> Column:
    """Subject and attachments of a message's metadata, a map of JSON values: given keys are rendered, nulls too."""
    given = lambda k: F.coalesce(F.map_contains_key(metadata, k), F.lit(False))
    subject, files = F.try_element_at(metadata, F.lit("subject")), F.try_element_at(metadata, F.lit("attachments"))
    listed = F.concat(F.lit("["), _variant_items(files, False), F.lit("]"))
    return F.concat_ws(
        "; ",
        F.when(given("subject"), F.concat(F.lit("subject="), _variant_text(subject, True))),
        F.when(given("attachments"), F.concat(F.lit("attachments="), F.when(_is_list(files), listed).otherwise(_variant_text(files, True)))),
    )


def action_line(ts: Column, action_type: Column, details: Column) -> Column:
    """``details`` is ARRAY<STRUCT<k, v, s>>, which keeps key order."""
    parts = F.array_join(F.transform(details, lambda d: F.concat(d["k"], F.lit("="), d["v"])), "; ")
    tail = F.when(F.size(details) > 0, F.concat(F.lit(" ("), parts, F.lit(")"))).otherwise(F.lit(""))
    return F.concat(F.lit("[action] "), minute(ts), F.lit(" "), action_type, tail)


def action_text(action_type: Column, details: Column) -> Column:
    parts = F.array_join(F.transform(details, lambda d: F.concat_ws(" ", d["k"], d["s"])), " ")
    return strip(F.concat(action_type, F.lit(" "), parts))


@dataclass(frozen=True)
class Summariser:
    """A text from a block of lines, newest first. One that declares to read only the first ``reads`` characters gets a
    block of so many lines (a line has at least one character and its break); any other gets the whole block."""

    text: Callable[[Column], Column]
    reads: int | None = None


def summarize(block: Column) -> Column:
    """Default deterministic summariser: head of the block plus a marker."""
    return F.concat(F.left(block, F.lit(V.SUMMARY_CHARS)), F.lit(V.SUMMARY_SUFFIX))


HEAD = Summariser(summarize, V.SUMMARY_CHARS)


# ---- answer recall ------------------------------------------------------------------------------


def recall_tokens(c: Column) -> Column:
    """Distinct tokens without stop words; tokens holding a digit may be shorter."""
    parts = F.array_distinct(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+"))
    least = lambda t: F.when(t.rlike("[0-9]"), F.lit(2)).otherwise(F.lit(3))
    return F.array_except(
        F.filter(parts, lambda t: F.length(t) >= least(t)), F.array(*[F.lit(w) for w in V.STOPWORDS])
    )


def recall(needles: Column, haystack: Column) -> Column:
    hits = F.size(F.array_intersect(needles, haystack))
    return F.when(F.size(needles) == 0, F.lit(1.0)).otherwise(hits / F.size(needles))


def recall_score(r: Column) -> Column:
    return reduce(lambda s, t: s + (r >= F.lit(t)).cast("int"), V.SCORE_THRESHOLDS, F.lit(1))


def first_score_digit(c: Column) -> Column:
    return F.regexp_extract(c, "[1-5]", 0).try_cast("int")


# ---- keys, prompts, responses, money ------------------------------------------------------------


def cache_key_text(query: Column, brief: Column) -> Column:
    return F.concat(query, F.lit("\n"), brief)


def cache_namespace(tenant: Column, customer: Column, scope: str) -> Column:
    if scope not in ("tenant", "tenant_customer"):
        raise ValueError(f"unknown cache scope {scope!r}")
    return F.concat_ws(":", tenant, customer) if scope == "tenant_customer" else tenant


def unfence(raw: Column) -> Column:
    """Drop the opening fence line and everything from the closing fence on."""

    def inner(lines):
        close = F.array_position(F.transform(lines, lambda x: strip(x).startswith("```")), True).cast("int")
        return F.when(close > 0, F.slice(lines, 1, F.greatest(close - 1, F.lit(0)))).otherwise(lines)

    after_first = lambda lines: F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    opened = lambda text: let(let(F.split(text, "\r\n|\n|\r"), after_first), inner)
    return let(
        strip(raw),
        lambda text: F.when(text.startswith("```"), strip(F.array_join(opened(text), "\n"))).otherwise(text),
    )


def strict_object(text: Column) -> Column:
    """VARIANT of a JSON object, null for anything else; trailing prose is refused by two wrappings."""

    def checked(t):
        one_item = let(
            F.try_parse_json(F.concat(F.lit("["), t, F.lit("]"))),
            lambda v: v.isNotNull() & F.try_variant_get(v, "$[1]", "variant").isNull(),
        )
        kind_of_x = let(
            F.try_parse_json(F.concat(F.lit('{"x":'), t, F.lit("}"))),
            lambda v: F.schema_of_variant(F.try_variant_get(v, "$.x", "variant")),
        )
        return let(
            F.try_parse_json(t),
            lambda v: let(
                F.schema_of_variant(v),
                lambda kind: F.when(kind.startswith("OBJECT") & one_item & (kind_of_x == kind), v),
            ),
        )

    return let(text, checked)


def call_cost(in_tokens: Column, out_tokens: Column, usd_in: Column, usd_out: Column) -> Column:
    return in_tokens / F.lit(1e6) * usd_in + out_tokens / F.lit(1e6) * usd_out


def length_bucket(n: Column) -> Column:
    out = F
    for name, lo, hi in V.LENGTH_BUCKETS:
        out = out.when(n.between(lo, hi), F.lit(name))
    return out.when(n > 500, F.lit("very_long")).otherwise(F.lit("short"))


def tenant_narrative(tenant: Column, rules: Column) -> Column:
    """English policy text. ``rules`` is ARRAY<STRUCT<key, decision>> in key order."""

    def line(r):
        told = lambda lead: F.concat(F.lit(lead + "the system should treat it as '"), r["decision"], F.lit("'."))
        return (
            F.when(r["key"] == "default", told("  - For any action not listed below, "))
            .when(r["key"] == "*", told("  - For any action, "))
            .otherwise(
                F.concat(
                    F.lit("  - When the proposed action is '"),
                    r["key"],
                    F.lit("', the system should treat it as '"),
                    r["decision"],
                    F.lit("'."),
                )
            )
        )

    head = F.concat(
        F.lit("Tenant "), py_repr(tenant), F.lit(" has the following customer-service policy rules:\n")
    )
    return F.concat(head, F.array_join(F.transform(rules, line), "\n"))


def proposal_prompt(env: dict[str, Column], sanitised_brief: Column) -> Column:
    shown = lambda c: F.coalesce(c, F.lit("None"))
    brief = F.when(
        F.coalesce(sanitised_brief, F.lit("")) != "", F.concat(F.lit("Customer brief:\n"), sanitised_brief, F.lit("\n"))
    ).otherwise(
        F.lit("Customer brief: (no brief available — customer not yet linked or brief lookup failed)\n")
    )
    customer = F.coalesce(blank_to_null(env["customer_id"]), F.lit("(unlinked)"))
    return F.concat(
        F.lit("Event:\n  event_id: "), shown(env["event_id"]),
        F.lit("\n  tenant_id: "), shown(env["tenant_id"]),
        F.lit("\n  customer_id: "), customer,
        F.lit("\n  channel_code: "), shown(env["channel_code"]),
        F.lit("\n  event_type: "), shown(env["event_type"]),
        F.lit("\n  received_at: "), shown(env["received_at"]),
        F.lit("\n\n"), brief,
        F.lit("\nReturn ONE JSON object as instructed."),
    )


def judge_prompt(policy_json: Column, action_type: Column) -> Column:
    return F.concat(
        F.lit("Tenant policy table (JSON):\n"), policy_json,
        F.lit("\n\nProposed action_type: "), action_type,
        F.lit("\n\nReturn ONLY the JSON object as instructed."),
    )


def naive_prompt(narrative: Column, action_type: Column, event_type: Column) -> Column:
    return F.concat(
        F.lit("Policy narrative:\n"), F.coalesce(narrative, F.lit("(no policy configured for this tenant)")),
        F.lit("\n\nProposed action: "), action_type,
        F.lit("\nSource event type: "), F.coalesce(event_type, F.lit("unknown")),
        F.lit("\n\nWhat should the system do?"),
    )


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.left(F.sha2(F.concat_ws("|", *parts), 256), F.lit(32)))
