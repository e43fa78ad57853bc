"""Operator 13: repair of conversation structure by a generalised LR parse with edits.

The role grammar is ``(system? (user assistant)+)?``. Its automaton has four states: nothing yet, after system, after user,
after assistant. A row may be kept (if its role fits), given another role, or deleted, and rows may be inserted before it,
each at a cost. The stack is a graph: after each row it has at most one top for each state, and a top that several edits
reach keeps the parent of the smallest (cost, audit) alone. Parents are linked, so the audit, one letter for each edit, is
read off at the end. Which of two audits of equal cost is smaller follows from the order of their parents' audits and the
letters added: audits of tops of one row use up the same rows, so none begins another.

Spark sorts all rows by conversation and turn over ranges, so a conversation of any size is spread over tasks. A
conversation inside one task is parsed there. Of one that crosses a border, or has more than ``BLOCK`` rows, every block of
rows is parsed from each of the four states; blocks are then put together in order, state by state, and the texts of such
a conversation go once more, as a stream, through the hash of its repaired text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convspark.llm.common import BLANKS, shared_folder, table

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows, and bytes of text, that a task holds of one conversation at a time.
BLOCK, BLOCK_BYTES = 4096, 16 << 20
NONE, SYSTEM, USER, ASSISTANT = range(4)
_ACCEPTING = (NONE, ASSISTANT)
#: The state that a role leads to from each state, by its initial.
_STEP = {"s": {NONE: SYSTEM}, "u": {NONE: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_OK, _BLANK, _DUPLICATE, _TRUNCATED = range(4)
_LEGAL = {"su", "ua", "au"}


def _after_inserts() -> dict[int, list[tuple[int, str, int]]]:
    """(state, letters, cost) that inserted rows alone lead to; a second way to a state is never cheaper."""
    out = {}
    for start in range(4):
        found, at, letters = {start: ("", 0)}, start, ""
        while True:
            at, letters = (ASSISTANT if at == USER else USER), letters + "I"
            if at in found:
                break
            found[at] = (letters, INSERT * len(letters))
        out[start] = [(s, *w) for s, w in found.items()]
    return out


_INSERTS = _after_inserts()


@cache
def edits(initial: str, fault: int) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, letters): the cheapest way between two states over a row, of equal ones the smallest letters."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for start, reached in _INSERTS.items():
        for state, letters, cost in reached:
            ways = [(state, cost + DELETE, letters + "D")]
            if fault in (_OK, _TRUNCATED):
                extra = TRUNCATED if fault == _TRUNCATED else 0
                if state in _STEP.get(initial, {}):
                    ways.append((_STEP[initial][state], cost + extra, letters + "K"))
                ways.append((ASSISTANT if state == USER else USER, cost + extra + REROLE, letters + "R"))
            for to, c, w in ways:
                best[start, to] = min((c, w), best.get((start, to), (c, w)))
    return [(s, t, c, w) for (s, t), (c, w) in sorted(best.items())]


class Stack:
    """Graph-structured stack from one starting state: for each live state its cost, the order of its audit among the
    tops, and its node (parent node, letters)."""

    def __init__(self, start: int):
        self.tops = {start: (0, 0, (None, ""))}

    def append(self, ways) -> None:
        """``ways``: (from, to, cost, letters) of a row, or of a whole block of rows."""
        best: dict[int, tuple[int, int, str, tuple]] = {}
        for start, to, cost, letters in ways:
            top = self.tops.get(start)
            if top is not None:
                way = (top[0] + cost, top[1], letters, top[2])
                if to not in best or way[:3] < best[to][:3]:
                    best[to] = way
        order = sorted(best, key=lambda state: best[state][1:3])
        self.tops = {to: (best[to][0], n, (best[to][3], best[to][2])) for n, to in enumerate(order)}

    def paths(self) -> list[tuple[int, int, str]]:
        """(state, cost, audit) of each top."""
        return [(state, cost, _letters(node)) for state, (cost, _, node) in sorted(self.tops.items())]

    def finish(self) -> tuple[int, str]:
        """(cost, audit) of the cheapest end, rows inserted behind the last one included."""
        ends = [
            (cost + more, _letters(node) + letters)
            for state, (cost, _, node) in self.tops.items()
            for to, letters, more in _INSERTS[state]
            if to in _ACCEPTING
        ]
        return min(ends)


def _letters(node: tuple) -> str:
    out = []
    while node is not None:
        out.append(node[1])
        node = node[0]
    return "".join(reversed(out))


class Writer:
    """Walks the edits of an audit beside the rows and hashes the repaired conversation."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.first = audit, 0, NONE, True
        self.digest = hashlib.sha256()

    def _line(self, role: str, text: str) -> None:
        self.digest.update(f"{'' if self.first else chr(10)}{role}:{text}".encode())
        self.first = False

    def _insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state = ASSISTANT if self.state == USER else USER
            self._line(_ROLE[self.state], "")
            self.at += 1

    def row(self, role: str, text: str) -> None:
        self._insert()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = _STEP[role[:1]][self.state]
            self._line(role, text)
        elif edit == "R":
            self.state = ASSISTANT if self.state == USER else USER
            self._line(_ROLE[self.state], text)

    def finish(self) -> str:
        self._insert()
        return self.digest.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): the rows after the damage of the contract. A dropped row has no copies, a
    repeated one two. Nulls of role and text are one space, as is a null conv_id or turn where the damage is drawn."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text"))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(space("role")).alias("role"),
        F.when(kind == 0, F.lit("")).otherwise(text).alias("text"),
        F.when(kind == 0, F.lit(0)).when(kind == 3, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("copies"),
    )


def _fault(later: Column) -> Column:
    core = F.rtrim(F.col("text"), F.lit(BLANKS))
    return (
        F.when(core == "", F.lit(_BLANK))
        .when(later, F.lit(_DUPLICATE))
        .when(~F.right(core, F.lit(1)).isin(".", "!", "?"), F.lit(_TRUNCATED))
        .otherwise(F.lit(_OK))
    )


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows that are alike become one, with the sum of their copies; ``fault`` is that of its first copy, any further one
    is a duplicate (or blank). The first turn of each role and text is a minimum by their MD5, which combines map-side;
    only what is there at more than one turn goes on, as a table of known size, to the join."""
    spark = rows.sparkSession
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    said = F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text").cast("binary"))
    rows = rows.withColumn("said", F.unhex(said))
    turn = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    firsts = rows.filter("copies > 0").groupBy("conv_id", "said")
    firsts = firsts.agg(F.min(turn).alias("first"), F.max(turn).alias("last")).filter("first != last")
    folder = shared_folder(spark, "turns")
    firsts.select(F.col("conv_id").alias("_conv"), F.col("said").alias("_said"), "first").write.parquet(folder)
    firsts = spark.read.parquet(folder)
    joined = rows.join(firsts, rows["conv_id"].eqNullSafe(firsts["_conv"]) & (rows["said"] == firsts["_said"]), "left")
    later = F.col("first").isNotNull() & (turn != F.col("first"))
    return joined.select("conv_id", "turn", "role", "text", "copies", _fault(later).alias("fault"))


_COUNTS = ["first_turn", "last_turn", "n_turns", "blank", "duplicate", "truncated", "illegal"]
_NUMBERS = [T.StructField(name, T.LongType()) for name in _COUNTS]
_ENDS = [T.StructField("head", T.StringType()), T.StructField("tail", T.StringType())]
_PATHS = [T.StructField("froms", T.ArrayType(T.IntegerType())), T.StructField("tos", T.ArrayType(T.IntegerType()))]
_PATHS += [T.StructField("costs", T.ArrayType(T.LongType())), T.StructField("audits", T.ArrayType(T.StringType()))]
_PLACE = [T.StructField("part", T.IntegerType()), T.StructField("piece", T.LongType())]
_END = [T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())]
_WHOLE = [T.StructField("repaired_sha256", T.StringType())]


class Piece:
    """What is known of consecutive rows of a conversation: counts, and a stack for each state it may start in."""

    def __init__(self, starts: tuple[int, ...]):
        self.stacks = {s: Stack(s) for s in starts}
        self.head = self.tail = None
        self.first_turn = self.last_turn = self.turn = None
        self.n_turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.rows, self.bytes = [], 0

    def add(self, turn, role: str, text: str, copies: int, fault: int) -> None:
        if copies and turn is not None and turn != self.turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = self.turn = turn
            self.n_turns += 1
        for n in range(copies):
            kind = fault if n == 0 or fault == _BLANK else _DUPLICATE
            self.blank += kind == _BLANK
            self.duplicate += kind == _DUPLICATE
            self.truncated += kind == _TRUNCATED
            initial = role[:1]
            if self.head is None:
                self.head = initial
            else:
                self.illegal += self.tail + initial not in _LEGAL
            self.tail = initial
            for stack in self.stacks.values():
                stack.append(edits(initial, kind))
            self.rows.append((role, text))
            self.bytes += len(text)

    def counts(self) -> dict:
        return {name: getattr(self, name) for name in _COUNTS}

    def paths(self) -> dict:
        found = [(s, *path) for s, stack in self.stacks.items() for path in stack.paths()]
        return {name: [p[i] for p in found] for i, name in enumerate(("froms", "tos", "costs", "audits"))}


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


def _emitted(rows: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += 400 + sum(len(a) for a in row.get("audits") or ()) + len(row.get("audit") or "")
        if size > 4 << 20:
            yield pa.RecordBatch.from_pylist(part, schema)
            part, size = [], 0
    yield pa.RecordBatch.from_pylist(part, schema)


def _arrow(fields: list[T.StructField], id_type: pa.DataType) -> pa.Schema:
    kinds = {"long": pa.int64(), "integer": pa.int32(), "string": pa.string()}
    kind = lambda t: pa.list_(kind(t.elementType)) if isinstance(t, T.ArrayType) else kinds[t.typeName()]
    return pa.schema([("conv_id", id_type), *[(f.name, kind(f.dataType)) for f in fields]])


_PIECE_FIELDS = [*_PLACE, *_NUMBERS, *_ENDS, *_PATHS, *_END, *_WHOLE]


def pieces(faulty: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each conversation that lies inside a task and a block (with repaired_sha256), and one for each block
    of the others (without), in the order (part, piece)."""
    schema = T.StructType([faulty.schema["conv_id"], *_PIECE_FIELDS])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def ended(conv, piece: Piece, number: int, whole: bool) -> dict:
            row = {"conv_id": conv, "part": part, "piece": number, **piece.counts(), "head": piece.head, "tail": piece.tail}
            if not whole:
                return row | piece.paths()
            cost, audit = piece.stacks[NONE].finish()
            writer = Writer(audit)
            for role, text in piece.rows:
                writer.row(role, text)
            return row | {"cost": cost, "audit": audit, "repaired_sha256": writer.finish()}

        def found(rows: Iterator[tuple]) -> Iterator[dict]:
            conv, piece, number, open_, first = None, None, 0, True, True
            for conv_id, turn, role, text, copies, fault in rows:
                if first or conv_id != conv:
                    if not first:
                        # the first conversation of a task may have begun in the task before
                        yield ended(conv, piece, number, not open_)
                    number += 1
                    open_ = first
                    conv, first = conv_id, False
                    piece = Piece((NONE, SYSTEM, USER, ASSISTANT) if open_ else (NONE,))
                while copies > 0:  # rows that are alike may fill blocks of their own
                    if len(piece.rows) >= block or piece.bytes > block_bytes:
                        turn_before = piece.turn
                        yield ended(conv, piece, number, False)
                        number, open_ = number + 1, True
                        piece = Piece((NONE, SYSTEM, USER, ASSISTANT))
                        piece.turn = turn_before  # counted already
                    some = min(copies, block - len(piece.rows))
                    piece.add(turn, role, text, some, fault)
                    copies -= some
                    fault = fault if fault == _BLANK else _DUPLICATE
            if not first:  # the last one may go on in the next task
                yield ended(conv, piece, number, False)

        for batch in batches:  # the first one; the others follow behind it
            arrow = _arrow(_PIECE_FIELDS, batch.schema.field(0).type)
            yield from _emitted(found(_rows_of(_chain(batch, batches))), arrow)

    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role")]
    rows = faulty.withColumn("_head", F.substring("text", 1, 32))
    ranges = int(faulty.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(ranges, *order, F.asc("_head")).sortWithinPartitions(*order, F.asc("text"))
    return rows.select("conv_id", "turn", "role", "text", "copies", "fault").mapInArrow(parse, schema)


def _chain(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


_REPAIR_FIELDS = [
    *[T.StructField(name, T.LongType()) for name in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
    T.StructField("audit", T.StringType()),
]


def _joined(parts: Iterator[dict], conv) -> dict:
    """Pieces of one conversation, in order."""
    stack, tail, turns = Stack(NONE), None, 0
    first_turn = last_turn = None
    sums = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    for p in parts:
        stack.append(zip(p["froms"], p["tos"], p["costs"], p["audits"]))
        for name in sums:
            sums[name] += p[name]
        if p["head"] is not None:
            sums["illegal"] += tail is not None and tail + p["head"] not in _LEGAL
            tail = p["tail"]
        if p["first_turn"] is not None:
            # a turn that a border of tasks cuts is counted on both sides
            turns += p["n_turns"] - (p["first_turn"] == last_turn)
            first_turn = p["first_turn"] if first_turn is None else first_turn
            last_turn = p["last_turn"]
    cost, audit = stack.finish()
    gaps = 0 if first_turn is None else last_turn - first_turn + 1 - turns
    return {"conv_id": conv, "gaps": gaps, **sums, "cost": cost, "audit": audit}


def joined(parts: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) from pieces; one conversation's blocks arrive
    in order and go one by one, so a task holds the audits of the tops and nothing else."""
    schema = T.StructType([parts.schema["conv_id"], *_REPAIR_FIELDS])

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first in batches:
            arrow = _arrow(_REPAIR_FIELDS, first.schema.field("conv_id").type)
            yield from _emitted(_conversations(_dicts(_chain(first, batches))), arrow)

    ordered = parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    return ordered.mapInArrow(put_together, schema)


def _dicts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


def _conversations(rows: Iterator[dict]) -> Iterator[dict]:
    row = next(rows, None)
    while row is not None:
        conv, after = row["conv_id"], []

        def same(first=row, conv=conv, after=after):
            yield first
            for r in rows:
                if r["conv_id"] != conv:
                    after.append(r)
                    return
                yield r

        yield _joined(same(), conv)
        row = after[0] if after else None


def hashes(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) for the conversations of ``audits``: their damaged rows as a stream, behind the audit.
    A hash goes over a text from its start to its end, so one conversation is read by one task, which keeps a row."""
    schema = T.StructType([rows.schema["conv_id"], *_WHOLE])
    wanted = audits.select(F.col("conv_id").alias("_conv"))
    chosen = rows.join(wanted, rows["conv_id"].eqNullSafe(wanted["_conv"]), "left_semi").filter("copies > 0")
    none = F.lit(None)
    heads = audits.select("conv_id", F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("string").alias("role"),
                          F.col("audit").alias("text"), F.lit(1).cast("long").alias("copies"))
    both = heads.unionByName(chosen.select("conv_id", F.lit(1).alias("kind"), F.col("turn").cast("long").alias("turn"), "role", "text", "copies"))
    order = [F.asc_nulls_first("conv_id"), F.asc("kind"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first in batches:
            arrow = _arrow(_WHOLE, first.schema.field(0).type)

            def found(rows: Iterator[tuple]) -> Iterator[dict]:
                writer = conv = None
                for conv_id, kind, role, text, copies in rows:
                    if kind == 0:
                        if writer:
                            yield {"conv_id": conv, "repaired_sha256": writer.finish()}
                        conv, writer = conv_id, Writer(text)
                        continue
                    for _ in range(copies):
                        writer.row(role, text)
                if writer:
                    yield {"conv_id": conv, "repaired_sha256": writer.finish()}

            yield from _emitted(found(_rows_of(_chain(first, batches))), arrow)

    dealt = both.repartition("conv_id").sortWithinPartitions(*order)
    return dealt.select("conv_id", "kind", "role", "text", "copies").mapInArrow(write, schema)


def repair(rows: DataFrame, block: int = BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row for each conv_id of
    ``rows`` (conv_id, turn, role, text, copies; see ``damaged``).

    Rows of a conversation go by turn (null first), those of one turn by role, then text. A null conv_id is a
    conversation of its own. One without rows after the damage has zeros, an empty audit and the hash of nothing. Roles
    of another initial than s, u or a fit nowhere: they are given another role or deleted. Other columns are not read.
    """
    spark = rows.sparkSession
    folder = shared_folder(spark, "repair")
    pieces(with_faults(rows), block, block_bytes).write.parquet(f"{folder}/pieces")
    found = spark.read.parquet(f"{folder}/pieces")
    joined(found.filter("audit IS NULL")).write.parquet(f"{folder}/joined")
    crossing = spark.read.parquet(f"{folder}/joined")
    digests = hashes(rows, crossing).withColumnRenamed("conv_id", "_conv")
    crossing = crossing.join(digests, crossing["conv_id"].eqNullSafe(digests["_conv"]))
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"), F.lit(0)).alias("gaps")
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    alone = found.filter("audit IS NOT NULL").select(*[gaps if n == "gaps" else F.col(n) for n in names])
    return alone.union(crossing.select(*names))


def query(spark, sf_dir):
    return repair(damaged(table(spark, sf_dir, "conversations")))


def repair_sql(conversations: str) -> str:
    """DuckDB text: damage and faults by windows, then a walk row by row that keeps the cheapest way to each state."""
    draw = (
        "list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(k, ''), lambda ch: "
        "list_concat([ord(ch)::BIGINT], list_transform(range(0, 8), lambda b: -1::BIGINT))))), "
        "lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END)"
    )
    return f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM {conversations}
), drawn AS (
  SELECT k, xor({draw}, 4294967295) % 20 AS kind FROM (SELECT DISTINCT k FROM keyed)
), convs AS (
  SELECT conv_id, row_number() OVER () AS cid FROM (SELECT DISTINCT conv_id FROM {conversations})
), after AS (
  SELECT cid, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(0, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM keyed JOIN drawn USING (k) JOIN convs ON convs.conv_id IS NOT DISTINCT FROM keyed.conv_id
), placed AS (
  SELECT cid, turn, role, text, left(role, 1) AS initial,
    row_number() OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text) AS i,
    lag(left(role, 1)) OVER (PARTITION BY cid ORDER BY turn NULLS FIRST, role, text) AS before,
    rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core
  FROM after
), rows_ AS MATERIALIZED (
  SELECT *, CASE WHEN core = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY cid, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed
), counts AS (
  SELECT cid, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_ GROUP BY cid
), ins(s, t, letters, price, lines) AS (
  VALUES (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''),
    (0, 2, 'I', 3, chr(10) || 'user:'), (1, 2, 'I', 3, chr(10) || 'user:'), (3, 2, 'I', 3, chr(10) || 'user:'),
    (2, 3, 'I', 3, chr(10) || 'assistant:'), (0, 3, 'II', 6, chr(10) || 'user:' || chr(10) || 'assistant:'),
    (1, 3, 'II', 6, chr(10) || 'user:' || chr(10) || 'assistant:')
), act(s, t, letter, price, needs) AS (
  VALUES (0, 1, 'K', 0, 's'), (0, 2, 'K', 0, 'u'), (1, 2, 'K', 0, 'u'), (3, 2, 'K', 0, 'u'), (2, 3, 'K', 0, 'a'),
    (0, 2, 'R', 3, 'user'), (1, 2, 'R', 3, 'user'), (3, 2, 'R', 3, 'user'), (2, 3, 'R', 3, 'assistant'),
    (0, 0, 'D', 4, ''), (1, 1, 'D', 4, ''), (2, 2, 'D', 4, ''), (3, 3, 'D', 4, '')
), walk AS (
  SELECT cid, CAST(0 AS BIGINT) AS i, 0 AS state, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'out': ''}} AS w FROM convs
  UNION ALL
  SELECT walk.cid, walk.i + 1, act.t, min({{
    'cost': CAST(w.cost + ins.price + act.price + CASE WHEN letter <> 'D' AND fault = 'truncated' THEN 3 ELSE 0 END AS BIGINT),
    'audit': w.audit || ins.letters || letter,
    'out': w.out || ins.lines || CASE letter WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || role || ':' || text ELSE chr(10) || needs || ':' || text END}})
  FROM walk JOIN rows_ ON rows_.cid = walk.cid AND rows_.i = walk.i + 1 JOIN ins ON ins.s = walk.state JOIN act ON act.s = ins.t
  WHERE letter = 'D' OR (fault NOT IN ('blank', 'duplicate') AND (letter = 'R' OR needs = initial))
  GROUP BY walk.cid, walk.i, act.t
), ended AS (
  SELECT walk.cid, min({{'cost': CAST(w.cost + ins.price AS BIGINT), 'audit': w.audit || ins.letters, 'out': w.out || ins.lines}}) AS w
  FROM walk LEFT JOIN counts USING (cid) JOIN ins ON ins.s = walk.state AND ins.t IN (0, 3)
  WHERE walk.i = coalesce(n, 0) GROUP BY walk.cid
)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, w.cost AS cost, w.audit AS audit,
  sha256(substr(w.out, 2)) AS repaired_sha256
FROM convs JOIN ended USING (cid) LEFT JOIN counts USING (cid)"""


QUERIES = {"op13_conversation_repair": query}
ORACLE = {"op13_conversation_repair": repair_sql("conversations")}
