"""Plain sequential re-statements of the order-dependent rules, for comparison with the set-based jobs."""


def link(events, identities=(), stored=()):
    """events: (tenant, event_id, key, explicit, hints) in order. Returns {event_id: (outcome, customer, added)}."""
    owner = {(t, k, v): c for t, k, v, c in identities}
    keys = dict(stored)
    out = {}
    for tenant, eid, key, explicit, hints in events:
        if (tenant, key) in keys:
            out[eid] = ("replay", keys[(tenant, key)], [])
            continue
        found = [h for h in hints if (tenant, *h) in owner]
        if explicit is not None:
            customer, kind = explicit, "linked"
        elif found:
            customer, kind = owner[(tenant, *found[0])], "linked"
        else:
            customer, kind = f"new-{eid}", "created"
        added, clash = [], False
        for h in hints:
            now = owner.get((tenant, *h))
            if now is None:
                owner[(tenant, *h)] = customer
                added.append(h)
            elif now != customer:
                clash = True
                break
        if clash:
            out[eid] = ("collision", None, added)
        else:
            keys[(tenant, key)] = customer
            out[eid] = (kind, customer, added)
    return out


def vote(rule, votes):
    """rule: (required, pool). votes in order: (vote, voter). Returns (outcomes, state, approvals, version)."""
    required, pool = rule
    state, approvals, version, out = "pending", [], 0, []
    for kind, voter in votes:
        if state != "pending":
            out.append("already_decided")
        elif pool is not None and voter not in pool:
            out.append("not_eligible")
        elif kind == "reject":
            state, version = "rejected", version + 1
            out.append("accepted")
        elif required <= 1:
            if voter is not None:
                approvals.append(voter)
            state, version = "approved", version + 1
            out.append("accepted")
        elif voter is None:
            out.append("not_eligible")
        elif voter in approvals:
            out.append("duplicate")
        else:
            approvals.append(voter)
            version += 1
            state = "approved" if len(approvals) >= required else "pending"
            out.append("accepted")
    return out, state, approvals, version


def pack(costs, budget, used=0):
    kept = []
    for i, c in enumerate(costs):
        if used + c <= budget:
            kept.append(i)
            used += c
    return kept
