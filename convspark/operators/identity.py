"""Identity hints, lookups and order-dependent customer resolution."""

from __future__ import annotations

from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from convspark import values as V
from convspark.functions import text as X
from convspark.operators import graph
from convspark.session import cut_lineage

IDENTITY = ["tenant_id", "kind", "value"]


def normalize(kind: Column, raw: Column) -> Column:
    """Canonical identity value: trimmed; phones keep digits and one leading +; email and handle are lower-cased."""

    def canonical(v):
        # class with Unicode digits, as the stored values were made
        digits = F.regexp_replace(F.regexp_replace(v, r"(?U)[^\d+]", ""), r"^\++", "")
        phone = F.concat(F.when(v.startswith("+"), F.lit("+")).otherwise(F.lit("")), digits)
        return (
            F.when(v == "", v)
            .when(kind == "phone", phone)
            .when(kind.isin("email", "chat_handle"), F.lower(v))
            .otherwise(v)
        )

    return X.let(X.strip(raw), canonical)


def _string(payload: Column, key: str) -> Column:
    """String field of a VARIANT object; any other type is ignored."""
    return X.let(
        F.try_variant_get(payload, f"$.{key}", "variant"),
        lambda field: F.when(F.schema_of_variant(field) == "STRING", field.cast("string")),
    )


def hints(payload: Column) -> Column:
    """ARRAY<STRUCT<kind, value>> in lookup priority, deduplicated, from a JSON payload."""

    def entries(v):
        return F.array(
            *[
                F.struct(
                    F.lit(V.IDENTITY_KINDS.index(kind)).alias("p"),
                    F.lit(i).alias("i"),
                    F.lit(kind).alias("kind"),
                    normalize(F.lit(kind), _string(v, key)).alias("value"),
                )
                for i, (key, kind) in enumerate(V.IDENTITY_KEYS)
            ]
        )

    found = F.filter(X.let(F.try_parse_json(payload), entries), lambda h: F.coalesce(h["value"], F.lit("")) != "")
    ordered = F.sort_array(found)
    return F.array_distinct(F.transform(ordered, lambda h: F.struct(h["kind"].alias("kind"), h["value"].alias("value"))))


def display_name(payload: Column) -> Column:
    first = lambda v: F.coalesce(*[X.blank_to_null(X.strip(_string(v, key))) for key in V.DISPLAY_NAME_KEYS])
    return F.left(X.let(F.try_parse_json(payload), first), F.lit(128))


def find_by_identity(wanted: DataFrame, identities: DataFrame, customers: DataFrame) -> DataFrame:
    """Customers owning the wanted (tenant, kind, value); the equi-join is broadcast by Spark while small."""
    owners = identities.select(*IDENTITY, "customer_id")
    return wanted.join(owners, IDENTITY).join(customers, ["tenant_id", "customer_id"])


def list_identities(identities: DataFrame, tenant_id: str, customer_id: str) -> DataFrame:
    mine = identities.filter((F.col("tenant_id") == tenant_id) & (F.col("customer_id") == customer_id))
    return mine.orderBy("created_at", "identity_id")


def add_identities(requests: DataFrame, identities: DataFrame, customers: DataFrame, order: str) -> DataFrame:
    """``action`` per requested (tenant, customer, kind, value): insert, noop, collision or unknown_customer.

    Requests take effect by the column ``order``. Who owns the identity is looked at first: an identity of somebody else is
    a collision even for an unknown customer. A free identity goes to the earliest request of a known customer, which is
    a map-side minimum; the requests after it meet that owner.
    """
    owners = identities.select(*IDENTITY, F.col("customer_id").alias("owner"))
    known = customers.select("tenant_id", "customer_id", F.lit(True).alias("known")).distinct()
    joined = requests.join(known, ["tenant_id", "customer_id"], "left").join(owners, IDENTITY, "left")
    free = joined.filter(F.col("owner").isNull() & F.col("known"))
    claims = free.groupBy(*IDENTITY).agg(F.min(F.struct(F.col(order).alias("at"), "customer_id")).alias("claim"))
    joined = joined.join(claims, IDENTITY, "left")
    claimed = F.when(F.col(order) > F.col("claim.at"), F.col("claim.customer_id"))
    owner = F.coalesce("owner", claimed)
    action = (
        F.when(owner == F.col("customer_id"), "noop")
        .when(owner.isNotNull(), "collision")
        .when(F.col("known").isNull(), "unknown_customer")
        .otherwise("insert")
    )
    return joined.withColumn("action", action).drop("known", "claim")


#: Identity rows of a group of connected requests that one fold may walk; larger groups go on in rounds.
WALK_ROWS = 4096
_WHO = ["tenant_id", "customer_id"]


def create_customers(
    requests: DataFrame, identities: DataFrame | None, walk_rows: int = WALK_ROWS
) -> tuple[DataFrame, DataFrame]:
    """(identity rows to insert, refused requests) for new customers created with all their identities or not at all.

    ``requests``: tenant_id, customer_id, created_at, identities ARRAY<STRUCT<kind, value>>; hints without kind or value
    are none. A request is refused when one of its identities is stored already, or belongs to a request of the batch
    that was accepted before it, by (created_at, customer_id).

    A round settles what the earliest requests decide. What is left depends on other requests in turn, and is cut into
    groups connected by shared identities: no group concerns another, so each of at most ``walk_rows`` identity rows
    is settled in one ordered fold, however long its chain of conflicts. Larger ones go on in rounds, and are cut again
    after 2, 4, 8 ... rounds, as they fall apart.
    """
    rows = requests.select(*_WHO, "created_at", F.explode("identities").alias("h"))
    rows = cut_lineage(
        rows.select(*_WHO, "created_at", "h.kind", "h.value").filter("kind IS NOT NULL AND value IS NOT NULL")
    )
    if identities is None:
        refused = rows.select(*_WHO).limit(0)
    else:
        refused = rows.join(identities.select(*IDENTITY), IDENTITY, "left_semi").select(*_WHO).distinct()
    open_ = cut_lineage(rows.join(refused, _WHO, "left_anti"))
    accepted = rows.limit(0)
    rounds = 0
    while not open_.isEmpty():
        steps = [_earliest]
        rounds += 1
        if rounds & (rounds - 1) == 0:
            steps.append(lambda left: _walked(left, walk_rows))
        for step in steps:
            won, lost, open_ = step(open_)
            accepted, refused = accepted.unionByName(won), refused.unionByName(lost)
    return accepted.select(*_WHO, "kind", "value", "created_at"), refused


def _earliest(open_: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(identity rows accepted, requests refused, identity rows left): requests that are the earliest for all their
    identities are accepted, those that share an identity with them refused; both by map-side minima."""
    first = open_.groupBy(*IDENTITY).agg(F.min(F.struct("created_at", "customer_id")).alias("first"))
    marked = open_.join(first, IDENTITY).withColumn("leads", F.col("first.customer_id") == F.col("customer_id"))
    leaders = marked.groupBy(*_WHO).agg(F.bool_and("leads").alias("leads")).filter("leads").select(*_WHO)
    won = cut_lineage(open_.join(leaders, _WHO, "left_semi"))
    left = open_.join(won.select(*_WHO).distinct(), _WHO, "left_anti")
    lost = cut_lineage(left.join(won.select(*IDENTITY), IDENTITY, "left_semi").select(*_WHO).distinct())
    return won, lost, cut_lineage(left.join(lost, _WHO, "left_anti"))


def _walked(open_: DataFrame, walk_rows: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``_earliest``, but whole groups of connected requests, of at most ``walk_rows`` identity rows each."""
    who = F.struct(*_WHO)
    links = open_.join(open_.groupBy(*IDENTITY).agg(F.min(who).alias("first")), IDENTITY).select(who.alias("who"), "first")
    found = graph.roots(links).select("node.*", "root")
    grouped = cut_lineage(open_.join(found, _WHO, "left").withColumn("root", F.coalesce("root", who)))
    small = grouped.groupBy("root").agg(F.count("*").alias("n")).filter(F.col("n") <= walk_rows).select("root")
    inside = cut_lineage(grouped.join(small, "root", "left_semi"))
    key = F.to_json(F.struct("kind", "value"))
    asked = inside.groupBy("root", *_WHO).agg(F.min("created_at").alias("created_at"), F.collect_set(key).alias("keys"))
    line = F.sort_array(F.collect_list(F.struct("created_at", "customer_id", "keys"))).alias("line")
    none = F.array().cast("array<string>")

    def step(s, x):
        took = F.struct(F.concat(s["taken"], x["keys"]).alias("taken"), F.array_append(s["won"], x["customer_id"]).alias("won"))
        return F.when(F.arrays_overlap(s["taken"], x["keys"]), s).otherwise(took)

    walked = asked.groupBy("root", "tenant_id").agg(line).select(
        "tenant_id", F.aggregate("line", F.struct(none.alias("taken"), none.alias("won")), step)["won"].alias("won")
    )
    walked = cut_lineage(walked.select("tenant_id", F.explode("won").alias("customer_id")))
    inside = inside.drop("root")
    lost = inside.join(walked, _WHO, "left_anti").select(*_WHO).distinct()
    left = grouped.join(small, "root", "left_anti").drop("root")
    return inside.join(walked, _WHO, "left_semi"), lost, cut_lineage(left)


# ---- resolution ---------------------------------------------------------------------------------

_NO_CUT = 1 << 20  # above any hint position
_REFUSED = -1  # below any: a refused event claims nothing
_EVENT, _KEY = ["tenant_id", "event_id"], ["tenant_id", "idempotency_key"]
#: Hint rows of a tenant's core that one ordered walk may settle; larger ones are settled in rounds.
CORE_ROWS = 1 << 17


def _first_cut() -> Column:
    return F.when(F.col("refused"), F.lit(_REFUSED)).otherwise(F.lit(_NO_CUT))


def resolve(
    events: DataFrame,
    identities: DataFrame | None = None,
    stored: DataFrame | None = None,
    customers: DataFrame | None = None,
    walk_rows: int = CORE_ROWS,
) -> DataFrame:
    """Resolve every event to a customer, exactly as processing them one by one in (received_at, event_id) order would.

    ``events``: tenant_id, event_id, received_at, idempotency_key, customer_id (explicit or null), hints.
    ``identities``: tenant_id, kind, value, customer_id already known. ``stored``: tenant_id, idempotency_key, event_id,
    customer_id of events stored before; a replay of one names it and its customer. ``customers``: tenant_id, customer_id of
    the customers there are; an event with another explicit customer is refused (``unknown_customer``): it attaches
    nothing, is not stored, and its key stays free. Without ``customers`` explicit customers are taken as they are.

    An event is a replay when an earlier event of its key was stored. Otherwise the explicit customer, the owner of its
    first owned hint, or a new customer takes it, and its free hints become that customer's, in order, up to the first
    hint owned by somebody else: that is a collision, the event is not stored and its key stays free.

    What happens to an event depends only on earlier ones. Who owns which identity follows from a core of the events
    (``_core``); the others meet owners that the core made, and are judged in one pass at the end. The core of a tenant of
    at most ``walk_rows`` hint rows is walked in order by one task; larger cores are settled as set steps to a fixed point.
    """
    at = F.struct("received_at", "event_id")
    base = events.select(
        "tenant_id", "event_id", "idempotency_key", F.col("customer_id").alias("explicit"), at.alias("at"), "hints"
    )
    if customers is None:
        base = base.withColumn("refused", F.lit(False))
    else:
        there = customers.select("tenant_id", F.col("customer_id").alias("explicit"), F.lit(True).alias("there")).distinct()
        base = base.join(there, ["tenant_id", "explicit"], "left")
        base = base.withColumn("refused", F.col("explicit").isNotNull() & F.col("there").isNull()).drop("there")
    if stored is not None:
        key = ["tenant_id", "idempotency_key"]
        used = stored.select(*key, F.col("event_id").alias("stored_event_id"), F.col("customer_id").alias("stored_customer_id"))
        used = used.dropDuplicates(key)
        replayed = base.select(*key, "event_id").join(used, key).select(
            "tenant_id", "event_id", "stored_event_id", "stored_customer_id"
        )
        base = base.join(used.select(*key), key, "left_anti")
    # what events without hints store is known from the start: they neither claim nor collide. So the rounds need the events
    # with hints only, and of these only such as come before the first event without hints of their key; others are replays
    base = cut_lineage(base.withColumn("plain", F.coalesce(F.size("hints"), F.lit(0)) <= 0))
    live = base.filter("NOT refused").groupBy(*_KEY)
    heads = live.agg(F.min(F.when(F.col("plain"), F.col("at"))).alias("sure"), F.min(F.when(~F.col("plain"), F.col("at"))).alias("head"))
    open_ = ~F.col("plain") & (F.col("sure").isNull() | (F.col("at") < F.col("sure")))
    every = cut_lineage(base.join(heads, _KEY, "left").withColumn("open", open_).drop("plain", "sure"))
    rest, hinted = every.filter("NOT open").drop("hints"), every.filter("open").drop("open")
    base = hinted.drop("hints")
    rows = hinted.select(*_EVENT, "idempotency_key", "explicit", "refused", "at", "head", F.posexplode("hints").alias("pos", "h"))
    sure = (F.col("at") == F.col("head")) & (F.col("pos") <= F.when(F.col("explicit").isNull(), 1).otherwise(0))
    rows = rows.select(*_EVENT, "idempotency_key", "refused", "at", "pos", sure.alias("sure"), "h.kind", "h.value")
    # the stored identities are read once: who owns a hint's identity already does not change from round to round
    if identities is None:
        rows = rows.withColumn("known", F.lit(None).cast("string"))
    else:
        rows = rows.join(identities.select(*IDENTITY, F.col("customer_id").alias("known")), IDENTITY, "left")
    rows = cut_lineage(rows)

    judged = _round(base, rows, _settled(*_core(base, rows), walk_rows))
    none = F.lit(None).cast("string")
    rest = rest.filter("tenant_id IS NOT NULL AND event_id IS NOT NULL").select(
        *_EVENT,
        "idempotency_key",
        "explicit",
        "at",
        _first_cut().alias("cut"),
        F.coalesce("explicit", X.stable_id("cust_", F.col("tenant_id"), F.col("event_id"))).alias("customer_id"),
        none.alias("match_kind"),
        none.alias("match_value"),
        F.col("explicit").isNull().alias("created"),
        F.lit(None).cast(judged.schema["added"].dataType).alias("added"),
    )
    out = _replays(cut_lineage(judged.unionByName(rest)))
    collided = F.col("cut") < _NO_CUT
    refused = F.col("cut") == _REFUSED
    outcome = F.when(F.col("replay"), "replay").when(refused, "unknown_customer").when(collided, "collision")
    outcome = outcome.when(F.col("created"), "created").otherwise("linked")
    live = ~F.col("replay") & ~collided
    result = out.select(
        "tenant_id",
        "event_id",
        outcome.alias("outcome"),
        F.when(F.col("replay"), F.col("stored_customer_id")).when(live, F.col("customer_id")).alias("customer_id"),
        (live & F.col("created")).alias("customer_created"),
        F.when(live & F.col("explicit").isNull(), F.col("match_kind")).alias("matched_kind"),
        F.when(live & F.col("explicit").isNull(), F.col("match_value")).alias("matched_value"),
        # hints in front of a colliding one stay attached
        F.when(~F.col("replay"), F.col("added")).alias("added"),
        F.when(~F.col("replay") & ~refused, F.col("customer_id")).alias("attached_to"),
        F.when(F.col("replay"), F.col("stored_event_id")).alias("replay_of"),
    )
    if stored is not None:
        filled = {"outcome": F.lit("replay"), "customer_id": F.col("stored_customer_id"), "replay_of": F.col("stored_event_id")}
        filled |= {"tenant_id": F.col("tenant_id"), "event_id": F.col("event_id"), "customer_created": F.lit(False)}
        again = [filled.get(n, F.lit(None)).cast(t).alias(n) for n, t in result.dtypes]
        result = result.unionByName(replayed.select(*again))
    return result


def _core(base: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The events, and their hint rows, that decide who owns which identity.

    The earliest live event of a key is no replay. Its first two hints (with an explicit customer, the first) are owned
    after it: nothing ahead of them can collide, since that takes two owners. So later events of these identities claim
    them no more (``sure``). The core is the events with a hint that they may claim, and those ahead of them in their keys;
    no other event concerns these.
    """
    free = rows.filter("known IS NULL AND NOT refused")
    owned = free.filter("sure").groupBy(*IDENTITY).agg(F.min("at").alias("owned"))
    may = free.join(owned, IDENTITY, "left").filter(F.col("owned").isNull() | (F.col("at") <= F.col("owned")))
    last = may.groupBy(*_KEY).agg(F.max("at").alias("last"))
    ahead = F.col("idempotency_key").isNull() | (F.col("at") <= F.col("last"))
    core = cut_lineage(base.filter("NOT refused").join(last, _KEY, "left").filter(ahead).drop("last"))
    own = X.stable_id("cust_", F.col("tenant_id"), F.col("event_id")).alias("own")
    wanted = core.select(*_EVENT, "explicit", own)
    return core, cut_lineage(rows.drop("refused", "sure").join(wanted, _EVENT))


def _settled(core: DataFrame, rows: DataFrame, walk_rows: int) -> DataFrame:
    """(identity, at, owner): the event that first claims each identity, and the customer that has it since."""
    sizes = cut_lineage(rows.groupBy("tenant_id").agg(F.count("*").alias("n")))
    small = F.col("n") <= walk_rows
    total, large = sizes.agg(F.coalesce(F.sum(F.when(small, F.col("n"))), F.lit(0)), F.count_if(~small)).first()
    group = F.pmod(F.xxhash64("tenant_id"), F.lit(-(-total // max(walk_rows, 1)) or 1)).alias("g")
    walked = rows.join(sizes.filter(small).select("tenant_id"), "tenant_id", "left_semi") if large else rows
    claims = _walked_claims(walked.select("*", "at.received_at", group))
    if large:
        others = sizes.filter(~small).select("tenant_id")
        part = [cut_lineage(x.join(others, "tenant_id", "left_semi")) for x in (core, rows)]
        claims = claims.unionByName(_fixed_point(*part))
    return cut_lineage(claims)


def _walked_claims(rows: DataFrame) -> DataFrame:
    """``_settled`` by walking the events of each tenant in order; memory holds the tenants of one group."""
    names = [*IDENTITY, "received_at", "event_id"]
    schema = StructType([*[rows.schema[n] for n in names], StructField("owner", StringType())])
    order = [(n, "ascending") for n in ("tenant_id", "received_at", "event_id", "pos", "known")]

    def walk(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=order, null_placement="at_start"))
        tenant, event, kind, value, known, key, explicit, own = (
            table[n].to_pylist() for n in ("tenant_id", "event_id", "kind", "value", "known", "idempotency_key", "explicit", "own")
        )
        owners: dict[tuple, str] = {}
        used, taken = set(), {}
        for _, positions in groupby(range(len(event)), lambda i: (tenant[i], event[i])):
            at = list(positions)
            first = at[0]
            name = (tenant[first], key[first])
            if name in used:
                continue
            usable = [i for i in at if kind[i] is not None and value[i] is not None]
            hints = [((tenant[i], kind[i], value[i]), i) for i in usable]
            customer = explicit[first]
            if customer is None:
                found = (owners.get(h) if known[i] is None else known[i] for h, i in hints)
                customer = next((c for c in found if c is not None), own[first])
            for h, i in hints:
                owner = owners.get(h) if known[i] is None else known[i]
                if owner is None:
                    owners[h] = taken[i] = customer
                elif owner != customer:
                    break
            else:
                if key[first] is not None:
                    used.add(name)
        return table.select(names).take(pa.array(list(taken), pa.int64())).append_column("owner", pa.array(list(taken.values()), pa.string()))

    claims = rows.groupBy("g").applyInArrow(walk, schema)
    return claims.select(*IDENTITY, F.struct("received_at", "event_id").alias("at"), "owner")


def _fixed_point(base: DataFrame, rows: DataFrame) -> DataFrame:
    """``_settled`` with no group walked. The job repeats three set steps until nothing changes: (1) each identity belongs
    to its earliest claim, a map-side minimum; (2) customers follow from pointers to the earlier claiming event, by
    pointer doubling; (3) collisions and replays give the next claims. The first k dependent outcomes are final after k
    rounds, so the fixed point is the sequential result."""
    head = F.coalesce(F.col("at") > F.col("head"), F.lit(False)).alias("replay")
    state = cut_lineage(base.select(*_EVENT, F.lit(_NO_CUT).alias("cut"), head))
    while True:
        claims = cut_lineage(_claims(rows, state))
        new = cut_lineage(_replays(_round(base, rows, claims)).select(*_EVENT, "cut", "replay"))
        old = state.select(*_EVENT, F.col("cut").alias("cut0"), F.col("replay").alias("replay0"))
        changed = new.join(old, _EVENT).filter((F.col("cut") != F.col("cut0")) | (F.col("replay") != F.col("replay0")))
        if changed.isEmpty():
            return claims
        state = new


def _claims(rows: DataFrame, state: DataFrame) -> DataFrame:
    """``_settled`` under the claims that ``state`` leaves."""
    live = rows.join(state, _EVENT).filter("NOT replay AND pos < cut")
    first = cut_lineage(live.filter("known IS NULL").groupBy(*IDENTITY).agg(F.min("at").alias("first")))
    claimers = first.select("tenant_id", F.col("first.event_id").alias("event_id")).distinct()
    # one row per identity on the right: a hot identity only makes the left side large, which is split at run time
    hint = rows.join(claimers, _EVENT, "left_semi").join(first, IDENTITY, "left")
    before = F.col("known").isNotNull() | (F.col("first") < F.col("at"))
    claimer = F.when(F.col("known").isNull(), F.col("first.event_id")).alias("claimer")
    match = F.min(F.when(before, F.struct("pos", "known", claimer))).alias("m")
    nodes = hint.groupBy(*_EVENT).agg(F.first("explicit").alias("explicit"), F.first("own").alias("own"), match)
    roots = nodes.select(
        *_EVENT,
        F.when(F.col("explicit").isNull(), F.col("m.claimer")).alias("parent"),
        F.coalesce("explicit", "m.known", F.when(F.col("m").isNull(), F.col("own"))).alias("customer_id"),
    )
    roots = cut_lineage(roots)
    while not roots.filter("customer_id IS NULL").isEmpty():
        up = roots.select(
            "tenant_id", F.col("event_id").alias("parent"), F.col("parent").alias("p2"), F.col("customer_id").alias("c2")
        )
        roots = cut_lineage(
            roots.join(up, ["tenant_id", "parent"], "left").select(
                *_EVENT, F.col("p2").alias("parent"), F.coalesce("customer_id", "c2").alias("customer_id")
            )
        )
    owner = roots.select("tenant_id", F.col("event_id").alias("claimer"), F.col("customer_id").alias("owner"))
    first = first.withColumn("claimer", F.col("first.event_id"))
    return first.join(owner, ["tenant_id", "claimer"]).select(*IDENTITY, F.col("first").alias("at"), "owner")


def _round(base: DataFrame, rows: DataFrame, claims: DataFrame) -> DataFrame:
    """Customer of every event under ``claims``, ``cut``, the position of its first colliding hint, and what it adds."""
    # one row per identity on the right: a hot identity only makes the left side large, which is split at run time
    hint = rows.select(*_EVENT, "at", "pos", "kind", "value", "known").join(
        claims.withColumnRenamed("at", "first"), IDENTITY, "left"
    )
    before = F.col("known").isNotNull() | F.coalesce(F.col("first") < F.col("at"), F.lit(False))
    mine = F.col("known").isNull() & F.coalesce(F.col("first") == F.col("at"), F.lit(False))
    hint = hint.filter(before | mine)
    owner = F.coalesce("known", "owner").alias("owner")
    seen = F.sort_array(F.collect_list(F.struct("pos", "kind", "value", owner, before.alias("before")))).alias("seen")  # at most 11 hints per event
    out = base.filter("tenant_id IS NOT NULL AND event_id IS NOT NULL")
    out = out.join(hint.groupBy(*_EVENT).agg(seen), _EVENT, "left")
    out = out.withColumn("met", F.filter("seen", lambda h: h["before"])).withColumn("m", F.get("met", 0))
    own = X.stable_id("cust_", F.col("tenant_id"), F.col("event_id"))
    out = out.withColumn("customer", F.coalesce("explicit", "m.owner", own))
    clash = F.get(F.filter("met", lambda h: h["owner"] != F.col("customer")), 0)["pos"]
    added = F.filter("seen", lambda h: ~h["before"])
    return out.select(
        *_EVENT,
        "idempotency_key",
        "explicit",
        "at",
        F.when(F.col("refused"), F.lit(_REFUSED)).otherwise(F.coalesce(clash, F.lit(_NO_CUT))).alias("cut"),
        F.col("customer").alias("customer_id"),
        F.col("m.kind").alias("match_kind"),
        F.col("m.value").alias("match_value"),
        (F.col("explicit").isNull() & F.col("m").isNull()).alias("created"),
        F.when(F.size(added) > 0, F.transform(added, lambda h: F.struct(h["kind"].alias("kind"), h["value"].alias("value")))).alias("added"),
    )


def _replays(judged: DataFrame) -> DataFrame:
    """With the stored event of each key and its customer, and whether the event itself is a ``replay`` of that."""
    stored = judged.filter(f"cut = {_NO_CUT}").groupBy(*_KEY).agg(F.min(F.struct("at", "event_id", "customer_id")).alias("s"))
    out = judged.join(stored, _KEY, "left")
    replay = F.coalesce(F.col("at") > F.col("s.at"), F.lit(False)).alias("replay")
    return out.select("*", replay, F.col("s.event_id").alias("stored_event_id"), F.col("s.customer_id").alias("stored_customer_id")).drop("s")


def new_identities(resolved: DataFrame) -> DataFrame:
    """Identity rows the resolution adds to the identity table."""
    return resolved.filter("added IS NOT NULL").select(
        "tenant_id", F.col("attached_to").alias("customer_id"), F.explode("added").alias("h")
    ).select("tenant_id", "customer_id", "h.kind", "h.value")


def resolve_each(requests: DataFrame, identities: DataFrame) -> DataFrame:
    """Lookup-only form: the first owned hint of each request against a fixed identity table."""
    rows = requests.select("tenant_id", "event_id", F.posexplode("hints").alias("pos", "h"))
    rows = rows.select("tenant_id", "event_id", "pos", "h.kind", "h.value")
    hit = rows.join(identities.select(*IDENTITY, "customer_id"), IDENTITY)
    best = hit.groupBy("tenant_id", "event_id").agg(F.min(F.struct("pos", "kind", "value", "customer_id")).alias("m"))
    return requests.select("tenant_id", "event_id").join(best, ["tenant_id", "event_id"], "left").select(
        "tenant_id", "event_id", "m.customer_id", F.col("m.kind").alias("matched_kind"), F.col("m.value").alias("matched_value")
    )
