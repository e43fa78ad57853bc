"""Operator 4: SimHash near-duplicates by a segment-popcount embedding.

A fingerprint is cut into 32 segments of two bits, and each segment is mapped to its bit count (0, 1 or 2). The Manhattan
distance of two count vectors never exceeds the Hamming distance of the fingerprints. Counts are kept in unary (0 is 00,
1 is 01, 2 is 11), so a vector is one 64-bit number and the Manhattan distance is the bit count of an exclusive or.

The range join runs over grids: the 32 counts form ``BLOCKS`` blocks, and two vectors within distance r agree in at least
BLOCKS - r blocks, so they share a cell in the grid of one of the choices of so many blocks. Fingerprints that share a
cell are linked if the Manhattan distance, then the Hamming distance, is at most r. Of a cell with more than two, only a
star for each group of linked fingerprints leaves the task, so a group of near copies gives no pairs.

A cell with more than ``CELL`` fingerprints is not compared. Its fingerprints go through an exact way instead: two
fingerprints within 2h bits have a common neighbour within h bits of both, so each one visits all 64-bit numbers within h
bits, and all that meet at a number are within 2h of each other and linked to the smallest of them, without pairs.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convspark.llm import components
from convspark.llm.common import replaced, shared_folder, table
from convspark.session import cut_lineage

SHINGLE_WORDS = 4
SEED = 42
MAX_BITS = 4
#: Blocks of equal width that the counts form; 8 blocks of 8 bits give 70 grids of some 2^23 cells in effect.
BLOCKS = 8
#: Fingerprints of a cell that are compared with each other; larger cells go the exact way without comparisons.
CELL = 512
_EVEN = 0x5555555555555555
#: Shingles whose bits are counted at once.
_PART = 255 * 64


def fingerprint(data: bytes | None) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text; 0 for a text without words."""
    words = (data or b"").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends]
    if len(words) > SHINGLE_WORDS:
        ends = ends[SHINGLE_WORDS - 1 :]
        hashes = [xxhash.xxh64_intdigest(line[s : e - 1], SEED) for s, e in zip(starts, ends)]
    else:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _PART):
        part = np.array(hashes[at : at + _PART], np.uint64)
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").view(np.uint64)
        # eight one-byte counters in a number; 255 rows cannot overflow them
        lanes = np.add.reduceat(bits, np.arange(0, len(part), 255), axis=0)
        counts += lanes.view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


@F.arrow_udf(T.LongType())
def simhash(text: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t) for t in text.cast(pa.binary()).to_pylist()], pa.int64())


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def embedding(fp: Column) -> Column:
    """Unary bit counts of the 32 two-bit segments."""
    next_bit = F.shiftrightunsigned(fp, 1)
    at_least_one = fp.bitwiseOR(next_bit).bitwiseAND(F.lit(_EVEN))
    both = fp.bitwiseAND(next_bit).bitwiseAND(F.lit(_EVEN))
    return at_least_one.bitwiseOR(F.shiftleft(both, 1))


def _cells(counts: Column, max_bits: int, blocks: int) -> Column:
    """One cell key for each choice of blocks that must agree; the number of the choice stands in a free block."""
    width = 64 // blocks
    edges = [*range(0, 64, width)][:blocks] + [64]
    masks = [((1 << edges[b + 1]) - 1) ^ ((1 << edges[b]) - 1) for b in range(blocks)]
    keys = []
    for number, chosen in enumerate(combinations(range(blocks), blocks - max_bits)):
        free = next(b for b in range(blocks) if b not in chosen)
        mask = sum(masks[b] for b in chosen)
        tag = (number << edges[free]) & ~mask & ((1 << 64) - 1)
        keys.append(counts.bitwiseAND(F.lit(_signed(mask))).bitwiseXOR(F.lit(_signed(tag))))
    return F.array(*keys)


def cell_stars(fps: list[int], max_bits: int) -> list[tuple[int, int]]:
    """(smallest, other) for the groups that the links between the fingerprints of a cell form."""
    x = np.array(sorted(fps), np.int64).view(np.uint64)
    even = np.uint64(_EVEN)
    after = x >> np.uint64(1)
    counts = ((x | after) & even) | ((x & after & even) << np.uint64(1))
    left = np.ones(len(x), bool)
    out = []
    while left.any():
        first = int(left.argmax())
        left[first] = False
        reached, at = [], 0
        while at <= len(reached):
            one = first if at == 0 else reached[at - 1]
            near = np.flatnonzero(left & (np.bitwise_count(counts ^ counts[one]) <= max_bits))
            near = near[np.bitwise_count(x[near] ^ x[one]) <= max_bits]
            left[near] = False
            reached += near.tolist()
            at += 1
        out += [(first, other) for other in reached]
    signed = x.view(np.int64).tolist()
    return [(signed[a], signed[b]) for a, b in out]


_LINKS = T.ArrayType(T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())]))
_ARROW_LINKS = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))


def links(fps: DataFrame, max_bits: int = MAX_BITS, blocks: int = BLOCKS, cell: int = CELL) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` of which the components are those of all pairs within
    ``max_bits`` (from 0 to blocks - 1 bits, blocks at most 16)."""

    @F.arrow_udf(_LINKS)
    def stars(cells: pa.Array) -> pa.Array:
        found = [[{"a": a, "b": b} for a, b in cell_stars(c, max_bits)] for c in cells.to_pylist()]
        return pa.array(found, _ARROW_LINKS)

    # every fingerprint becomes as many rows as there are grids, so few small partitions must not stay few
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = fps.repartition(parts, "fp").select("fp", embedding(F.col("fp")).alias("counts"))
    placed = placed.select("fp", F.explode(_cells(F.col("counts"), max_bits, blocks)).alias("key"))
    shared = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    # counted once; as a checkpoint it leaves the other side of the join free to be split where a cell is crowded
    shared = cut_lineage(shared.filter("n > 1"))
    # most cells that are shared have two fingerprints
    pairs = shared.filter("n = 2").select("a", "b")
    bound = F.bit_count(embedding(F.col("a")).bitwiseXOR(embedding(F.col("b"))))
    difference = F.col("a").bitwiseXOR(F.col("b"))
    pairs = pairs.filter(bound <= max_bits).filter(F.bit_count(difference) <= max_bits)

    # the cells of more than two are few; as a table their true size is known, and Spark broadcasts them while it is small
    folder = shared_folder(fps.sparkSession, "cells")
    shared.filter("n > 2").select("key", "n").write.parquet(folder)
    many = fps.sparkSession.read.schema("key long, n long").parquet(folder)
    members = placed.join(many, "key")
    together = members.filter(F.col("n") <= cell).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    pairs = pairs.union(together.select(F.explode(stars("fps")).alias("link")).select("link.a", "link.b"))

    crowded = members.filter(F.col("n") > cell).select("fp").distinct()
    half = (max_bits + 1) // 2
    flips = [_signed(sum(1 << i for i in chosen)) for k in range(half + 1) for chosen in combinations(range(64), k)]
    around = crowded.select("fp", F.explode(F.transform(F.array(*map(F.lit, flips)), lambda m: m.bitwiseXOR(F.col("fp")))).alias("at"))
    # at most as many fingerprints as there are flips can meet at a number
    met = around.groupBy("at").agg(F.sort_array(F.collect_list("fp")).alias("fps")).filter(F.size("fps") > 1)
    if max_bits % 2:  # an odd distance: those that meet may be one bit too far apart
        met = met.select("fps", F.posexplode("fps").alias("i", "a"))
        stars = met.select("a", F.explode(F.slice("fps", F.col("i") + 2, F.size("fps") - F.col("i") - 1)).alias("b"))
        stars = stars.filter(F.bit_count(difference) <= max_bits)
    else:
        stars = met.select(F.element_at("fps", 1).alias("a"), F.explode(F.slice("fps", 2, F.size("fps"))).alias("b"))
    return pairs.union(stars)


def components_of(prints: DataFrame, id_col: str = "doc_id", max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root, first_id): of each distinct fingerprint the smallest fingerprint and the smallest id of its component."""
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min(id_col).alias("own")))
    near = components.roots(links(distinct.select("fp"), max_bits))
    rooted = distinct.join(near.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = rooted.select("fp", F.coalesce("root", "fp").alias("root"), "own")
    rooted = cut_lineage(rooted)
    # both sides as checkpoints: the members of a large component are split
    first = cut_lineage(rooted.groupBy("root").agg(F.min("own").alias("first_id")))
    return rooted.join(first, "root").select("fp", "root", "first_id")


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id), one row per input row.

    Null and empty texts have fingerprint 0 and are linked like any other. Rows that repeat a doc_id or a text stay rows
    of their own. A null doc_id never names a component that also has other ids; a component without any has null.
    """
    prints = cut_lineage(docs.select("doc_id", simhash("text").alias("fp")))
    found = components_of(prints, "doc_id", max_bits)
    return prints.join(found, "fp").select("doc_id", "fp", F.col("first_id").alias("component_id"))


def keep_one(docs: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` that remain when of each component one document stays: that with the smallest doc_id (null
    last), of equal ids that with the smallest text hash, of equal rows one. Columns are those of ``docs``."""
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    prints = cut_lineage(docs.select("doc_id", tie.alias("_tie"), simhash("text").alias("fp")))
    found = components_of(prints, "doc_id", max_bits)
    order = F.struct(F.col("doc_id").isNull().alias("_null"), "doc_id", "_tie")
    best = prints.groupBy("fp").agg(F.min(order).alias("_best")).join(found, "fp")
    best = best.groupBy("root").agg(F.min("_best").alias("_best")).select("_best.doc_id", "_best._tie")
    # one key for the join and for repeated rows: texts are dealt and sorted once; a struct with a null equals its like
    best = best.select(F.struct("doc_id", "_tie").alias("_llm_best"))
    keyed = docs.withColumn("_llm_key", F.struct("doc_id", tie.alias("_tie")))
    kept = keyed.join(best, keyed["_llm_key"] == best["_llm_best"], "left_semi")
    return kept.dropDuplicates(["_llm_key"]).select(*docs.columns)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op4_simhash_dedup": query}
ORACLE = {}
