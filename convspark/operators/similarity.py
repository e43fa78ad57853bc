"""Cosine similarity of bags of words inside namespaces, block against block.

A namespace is cut into blocks of bounded size and every pair of blocks is one task's matrix product, so nothing is shuffled
for a pair of texts: a text travels once for each block of the other side. Small namespaces share a task. Products of
whole numbers are exact, and a similarity is dot / (sqrt(a) * sqrt(b)) in double precision, wherever it is computed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convspark.session import cut_lineage

#: Texts of one side in a task, and rows of a matrix of similarities that are there at once.
BLOCK, _ROWS = 2048, 256


def bags(counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bag, sq): the counted buckets of a key in one row, and its squared norm; at most one entry per bucket."""
    bag = F.collect_list(F.struct("bucket", "w")).alias("bag")
    return counts.groupBy(*keys).agg(bag, F.sum(F.col("w") * F.col("w")).alias("sq"))


@dataclass
class _Space:
    """The rows of one namespace in a task, from ``start`` on, and its bags as (row, bucket, weight)."""

    start: int
    columns: dict[str, np.ndarray]
    row: np.ndarray
    bucket: np.ndarray
    weight: np.ndarray
    sq: np.ndarray

    def matrix(self, words: np.ndarray, dtype) -> np.ndarray:
        out = np.zeros((len(self.sq), len(words)), dtype)
        at = np.searchsorted(words, self.bucket)
        known = at < len(words)
        known[known] = words[at[known]] == self.bucket[known]
        out[self.row[known], at[known]] = self.weight[known]
        return out


def _spaces(table: pa.Table, order: list[str]) -> tuple[pa.Table, dict[str, _Space]]:
    """(the table sorted by namespace and ``order``, its namespaces)."""
    table = table.sort_by([(c, "ascending") for c in ["ns", *order]]).combine_chunks()
    if not table.num_rows:
        return table, {}
    bag = table["bag"].combine_chunks()
    size = pc.list_value_length(bag).to_numpy()
    flat, ends = bag.flatten(), np.cumsum(size)
    bucket, weight = (pc.struct_field(flat, f).to_numpy() for f in ("bucket", "w"))
    row, sq = np.repeat(np.arange(len(size)), size), table["sq"].to_numpy()
    numbers = {f.name: table[f.name].to_numpy() for f in table.schema if f.type in (pa.int64(), pa.float64())}
    names = table["ns"].to_pylist()
    starts = [i for i, name in enumerate(names) if not i or name != names[i - 1]]
    out = {}
    for a, b in zip(starts, [*starts[1:], len(names)]):
        part = slice(ends[a] - size[a], ends[b - 1])
        columns = {name: values[a:b] for name, values in numbers.items()}
        out[names[a]] = _Space(a, columns, row[part] - a, bucket[part], weight[part], sq[a:b])
    return table, out


def _similarities(a: _Space, b: _Space) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, similarities) of some rows of ``a`` after the other, with all rows of ``b``."""
    words = np.intersect1d(a.bucket, b.bucket)
    # the terms of a product are whole and not negative, so a float32 holds each partial sum below 2^24 as it is
    dtype = np.float32 if float(a.sq.max()) * float(b.sq.max()) < 2.0**48 else np.float64
    left, right = a.matrix(words, dtype), b.matrix(words, dtype).T
    root_a, root_b = np.sqrt(a.sq.astype(float)), np.sqrt(b.sq.astype(float))
    for at in range(0, len(a.sq), _ROWS):
        dot = (left[at : at + _ROWS] @ right).astype(float)
        yield at, dot / (root_a[at : at + _ROWS, None] * root_b[None, :])


def _paired(asked: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Both sides with the group ``g`` of each block pair a row belongs to; None where no namespace has both."""
    sizes = asked.groupBy("ns").agg(F.count("*").alias("a")).join(entries.groupBy("ns").agg(F.count("*").alias("b")), "ns")
    blocks = [F.ceil(F.col(c) / BLOCK).alias(f"n_{c}") for c in ("a", "b")]
    sizes = cut_lineage(sizes.select("ns", *blocks, (F.col("a") + F.col("b")).alias("n")))
    small = (F.col("n_a") == 1) & (F.col("n_b") == 1)
    total, any_ = sizes.agg(F.sum(F.when(small, F.col("n"))), F.count("*")).first()
    if not any_:
        return None
    shared = F.pmod(F.xxhash64("ns"), F.lit(-(-(total or 0) // BLOCK) or 1))
    # groups that fall on one number by chance are compared once more, which changes no result
    group = F.when(small, shared).otherwise(F.xxhash64("ns", "i", "j")).alias("g")

    def side(rows: DataFrame, key: str, own: str, other: str, mine: str, across: str) -> DataFrame:
        placed = rows.join(sizes.drop("n"), "ns").withColumn(mine, F.pmod(F.xxhash64(key), F.col(own)))
        placed = placed.withColumn(across, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        return placed.select(*[F.col(c).alias(c) for c in rows.columns], group)  # both sides may come from one table

    return side(asked, "key_id", "n_a", "n_b", "i", "j"), side(entries, "entry_id", "n_b", "n_a", "j", "i")


def _compare(asked: DataFrame, entries: DataFrame, order: list[str], found, schema: str) -> DataFrame:
    """What ``found`` makes of every namespace of every block pair; entries come sorted by ``order``. It names the ``row``
    of the asked side each of its results is for, columns it does not give are those of that row."""
    sides = _paired(asked, entries)
    if sides is None:
        return asked.sparkSession.createDataFrame([], schema)
    types = _arrow(schema)

    def judge(left: pa.Table, right: pa.Table) -> pa.Table:
        others, out = _spaces(right, order)[1], []
        left, spaces = _spaces(left, ["key_id"])
        for ns, space in spaces.items():
            if ns in others:
                out.extend(found(space, others[ns]))
        if not out:
            return pa.table({n: pa.array([], t) for n, t in types.items()})
        columns = {n: np.concatenate([part[n] for part in out]) for n in out[0]}
        rows = left.take(columns.pop("row"))
        return pa.table({n: columns[n] if n in columns else rows[n] for n in types})

    return sides[0].groupBy("g").cogroup(sides[1].groupBy("g")).applyInArrow(judge, schema)


def _arrow(schema: str) -> dict[str, pa.DataType]:
    types = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}
    return {name: types[kind] for name, kind in (field.split() for field in schema.split(", "))}


def nearest(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """(ns, key_id, entry_id, sim): of each key the most similar entry of its namespace that shares a bucket with it, of
    equally similar ones the least recently touched.

    ``asked``: ns, key_id (string), bag, sq. ``entries``: ns, entry_id (long), touch (long), bag, sq.
    """

    def found(a: _Space, b: _Space):
        touch, entry = b.columns["touch"], b.columns["entry_id"]
        for at, sim in _similarities(a, b):
            best = sim.argmax(axis=1)  # the first of equal ones
            top = sim[np.arange(len(sim)), best]
            some = np.flatnonzero(top > 0)
            best, top = best[some], top[some]
            yield {"row": a.start + at + some, "entry_id": entry[best], "touch": touch[best], "sim": top}

    schema = "ns string, key_id string, entry_id long, touch long, sim double"
    best = _compare(asked, entries, ["touch", "entry_id"], found, schema)
    front = F.max_by(F.struct("entry_id", "sim"), F.struct("sim", -F.col("touch"), -F.col("entry_id")))
    return best.groupBy("ns", "key_id").agg(front.alias("b")).select("ns", "key_id", "b.entry_id", "b.sim")


def reached(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """(ns, key_id) of the keys that reach their ``threshold`` with any entry. ``asked``: ns, key_id (long), threshold, bag, sq."""

    def found(a: _Space, b: _Space):
        threshold = a.columns["threshold"]
        for at, sim in _similarities(a, b):
            yield {"row": a.start + at + np.flatnonzero((sim >= threshold[at : at + len(sim), None]).any(axis=1))}

    return _compare(asked, entries, ["entry_id"], found, "ns string, key_id long").distinct()


def best_before(keys: DataFrame) -> DataFrame:
    """(ns, key_id, best): of each key the similarity of the most similar key in front of it, where any shares a bucket."""

    def found(a: _Space, b: _Space):
        key, entry = a.columns["key_id"], b.columns["entry_id"]
        for at, sim in _similarities(a, b):
            ahead = np.where(entry[None, :] < key[at : at + len(sim), None], sim, 0.0).max(axis=1)
            some = np.flatnonzero(ahead > 0)
            yield {"row": a.start + at + some, "sim": ahead[some]}

    entries = keys.withColumnRenamed("key_id", "entry_id")
    sims = _compare(keys, entries, ["entry_id"], found, "ns string, key_id long, sim double")
    return sims.groupBy("ns", "key_id").agg(F.max("sim").alias("best"))


def candidates(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """(ns, key_id, entry_id, sim): the entries that may answer a request of a key, one that comes at key_id or later.

    These reach the threshold, and no entry stored before them, and none stored before the key came, is more similar.
    ``asked``: ns, key_id (long), threshold, bag, sq. ``entries``: ns, entry_id (long, its position), bag, sq.
    """

    def found(a: _Space, b: _Space):
        key, entry, threshold = a.columns["key_id"], b.columns["entry_id"], a.columns["threshold"]
        for at, sim in _similarities(a, b):
            rows = slice(at, at + len(sim))
            before = np.where(entry[None, :] < key[rows, None], sim, -1.0).max(axis=1)
            least = np.maximum(np.maximum.accumulate(sim, axis=1), before[:, None])
            r, c = np.nonzero((sim >= threshold[rows, None]) & (sim >= least))
            yield {"row": a.start + at + r, "entry_id": entry[c], "sim": sim[r, c]}

    kept = _compare(asked, entries, ["entry_id"], found, "ns string, key_id long, entry_id long, sim double").distinct()
    whole = Window.partitionBy("ns", "key_id")
    before = F.max(F.when(F.col("entry_id") < F.col("key_id"), F.col("sim"))).over(whole)
    running = F.max("sim").over(whole.orderBy("entry_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = kept.withColumn("least", F.greatest(before, running))
    return kept.filter("sim >= least").drop("least")


#: Keys of a namespace that one ordered walk settles.
WALK = 4096


def _leaders(space: _Space) -> list[int]:
    """The rows of a namespace that are stored when they come in order. Only rows that no earlier one covers are compared,
    and only with those behind them."""
    words = np.unique(space.bucket)
    dtype = np.float32 if float(space.sq.max()) < 2.0**24 else np.float64  # as in ``_similarities``
    bags, roots = space.matrix(words, dtype), np.sqrt(space.sq.astype(float))
    threshold, covered, out = space.columns["threshold"], np.zeros(len(space.sq), bool), []
    for at in range(0, len(roots), _ROWS):
        rows = at + np.flatnonzero(~covered[at : at + _ROWS])
        dot = (bags[rows] @ bags[at:].T).astype(float)
        near = dot / (roots[rows, None] * roots[None, at:]) >= threshold[None, at:]
        for row, reached_ in zip(rows.tolist(), near):
            if not covered[row]:
                out.append(row)
                covered[at:] |= reached_
    return out


def _walked(front: DataFrame) -> DataFrame:
    """(ns, key_id) of the keys that are stored when the keys of each namespace come in order, each one being stored
    unless it reaches its threshold with a stored one. At most ``WALK`` keys per namespace."""
    total = front.count()
    group = F.pmod(F.xxhash64("ns"), F.lit(-(-total // WALK) or 1)).alias("g")

    def walk(table: pa.Table) -> pa.Table:
        table, spaces = _spaces(table, ["key_id"])
        stored = [space.start + i for space in spaces.values() for i in _leaders(space)]
        return table.take(stored).select(["ns", "key_id"])

    return front.select("*", group).groupBy("g").applyInArrow(walk, "ns string, key_id long")


def stored_keys(keys: DataFrame) -> DataFrame:
    """(ns, key_id) of the keys a sequential run would store: those that reach their threshold with no stored key before.

    ``keys``: ns, key_id (the position of the key's first request), threshold, bag, sq. A round walks the first ``WALK``
    open keys of every namespace in order, then compares all other open keys with what the walk has stored. So a
    namespace of n keys takes at most n / WALK rounds, and near copies of stored keys leave with the first of them.
    """
    at = Window.partitionBy("ns").orderBy("key_id")
    open_, stored = keys.select("ns", "key_id"), None
    while not open_.isEmpty():
        # the first ones of each namespace are found map-side too
        front = cut_lineage(open_.withColumn("at", F.row_number().over(at)).filter(F.col("at") <= WALK).drop("at"))
        new = cut_lineage(_walked(keys.join(front, ["ns", "key_id"], "left_semi")))
        stored = new if stored is None else stored.unionByName(new)
        open_ = cut_lineage(open_.join(front, ["ns", "key_id"], "left_anti"))
        if open_.isEmpty():
            break
        leaders = keys.join(new, ["ns", "key_id"], "left_semi").select("ns", F.col("key_id").alias("entry_id"), "bag", "sq")
        near = reached(keys.join(open_, ["ns", "key_id"], "left_semi"), leaders)
        open_ = cut_lineage(open_.join(near, ["ns", "key_id"], "left_anti"))
    return keys.select("ns", "key_id").limit(0) if stored is None else stored
