import hashlib
import random
import re
import sys
import zlib
from collections import Counter
from functools import cache

import pytest

from convspark.llm import turn_repair as R

SCHEMA = "conv_id long, turn long, role string, text string, audit string, copies string"
BLANK = re.compile("[^\x20\x09-\x0d]")


def damage(rows):
    """The rows after the damage, by conversation, each in order."""
    out = {}
    for conv, turn, role, text, *_ in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        role = "user" if kind == 4 else role
        out.setdefault(conv, []).extend([(turn is not None, turn or 0, role, text)] * {0: 0, 3: 2}.get(kind, 1))
    return {c: [(t if some else None, r, x) for some, t, r, x in sorted(v)] for c, v in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        core = text.rstrip(" \t\n\x0b\x0c\r")
        if not BLANK.search(text):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if core[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def cheapest(rows, kinds):
    """(cost, audit, output) by trying all edits from behind, no stack and no merging by order."""

    @cache
    def best(i, last, inserts):
        """From row i on, with the initial of the last output; at most so many inserts in a row."""
        ways = []
        if i == len(rows) and last in ("", "a"):
            ways.append((0, "", ()))
        for role in ("user", "assistant"):
            if inserts and last + role[0] in ("u", "su", "ua", "au"):
                c, w, o = best(i, role[0], inserts - 1)
                ways.append((c + 3, "I" + w, ((role, ""), *o)))
        if i < len(rows):
            _, role, text = rows[i]
            c, w, o = best(i + 1, last, 2)
            ways.append((c + 4, "D" + w, o))
            if kinds[i] not in ("blank", "duplicate"):
                extra = 3 if kinds[i] == "truncated" else 0
                for new, price, letter in ((role, 0, "K"), ("user", 3, "R"), ("assistant", 3, "R")):
                    if new and last + new[0] in ("s", "u", "su", "ua", "au"):
                        c, w, o = best(i + 1, new[0], 2)
                        ways.append((c + price + extra, letter + w, ((new, text), *o)))
        return min(ways, default=(10**9, "~", ()))

    sys.setrecursionlimit(20_000)
    return best(0, "", 2)


def plain(rows):
    out = []
    for conv, after in damage(rows).items():
        kinds = faults(after)
        n = Counter(kinds)
        turns = [t for t, *_ in after if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
        cost, audit, output = cheapest(after, kinds)
        text = "\n".join(f"{r}:{t}" for r, t in output)
        out.append((conv, gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


def awkward(seed=3, convs=60):
    rng = random.Random(seed)
    texts = ["yes.", "no?", "well", "go on!", "", " \t", None, "long " * 50 + ".", "é日.", "a\nb. \n", "over"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "User", "usher", "sys"]
    rows = []
    for conv in range(convs):
        for turn in range(rng.randrange(1, 14)):
            role = rng.choice(roles) if conv % 2 else ("assistant" if turn % 2 else "user")
            rows.append((conv, turn + (turn > 5) * 3 if rng.random() < 0.9 else None, role, rng.choice(texts)))
    rows += rows[5:9] + rows[5:7]  # repeated rows
    rows += [(None, t, r, "x.") for t, r in ((0, "user"), (1, "assistant"), (None, "user"))]
    rows += [(900, t, "user" if t % 2 == 0 else "assistant", f"{t % 7}.") for t in range(180)]  # a long one
    dropped = next(c for c in range(1000, 9000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows += [(dropped, 0, "user", "gone."), (2000, 0, "system", "alone."), (2001, 0, "assistant", "answer first.")]
    return [(*r, "x", "y") for r in rows]


KEY = lambda t: tuple((x is None, x) for x in t)


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_repairs_equal_all_edits(spark, block):
    rows = awkward()
    got = R.repair(R.damaged(spark.createDataFrame(rows, SCHEMA)), block=block)
    assert sorted(map(tuple, got.collect()), key=KEY) == sorted(plain(rows), key=KEY)


def test_one_conversation_over_many_tasks(spark):
    rng = random.Random(8)
    rows = [(1, t, rng.choice(["user", "assistant", "tool"]), rng.choice([f"{t}.", "same.", f"{t}"]), "", "") for t in range(400)]
    rows += [(2, None, "user", "alike.", "", "")] * 50 + [(3, 0, "user", "q.", "", ""), (3, 1, "assistant", "a.", "", "")]
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    parts = R.pieces(R.with_faults(R.damaged(frame)), block=16)
    assert parts.filter("conv_id = 1").select("part").distinct().count() > 1
    got = R.repair(R.damaged(frame), block=16)
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows))


def test_merged_tops_give_the_same_as_all_edits():
    rng = random.Random(11)
    kind_of = {"": R._OK, "blank": R._BLANK, "duplicate": R._DUPLICATE, "truncated": R._TRUNCATED}
    for _ in range(3000):
        rows = [(0, rng.choice(["user", "assistant", "system", "tool"]), "x") for _ in range(rng.randrange(9))]
        kinds = [rng.choice(["", "", "truncated", "duplicate", "blank"]) for _ in rows]
        stack = R.Stack(R.NONE)
        for (_, role, _), kind in zip(rows, kinds):
            stack.append(R.edits(role[:1], kind_of[kind]))
        assert stack.finish() == cheapest(rows, kinds)[:2]


def test_empty_table(spark):
    got = R.repair(R.damaged(spark.createDataFrame([], SCHEMA)))
    assert got.count() == 0
    assert got.columns[0] == "conv_id" and len(got.columns) == 9
