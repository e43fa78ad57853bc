"""Operator 5: repeated passages removed by relative Lempel-Ziv factors.

The reference is the whole corpus in its order. It is indexed by seeds: of the runs of ``SEED_WORDS`` words in a window, the
one with the smallest hash. A seed is content-defined, so equal windows have equal seeds, and the index, seed to first
place, is spread by hash over blocks that every document consults through one join. Seeds that occur once are dropped before.

A document is factored greedily: a factor goes on as long as the next seed, which touches or overlaps the last one, has its
first place at the same distance from it in the same document. All words of a factor stand in that earlier place, so
a factor of a window or more is a duplicate span without looking at a text.

Windows that reach over the boundary of a factor may still have occurred, elsewhere. The first occurrence of a window is
never inside a factor; it lies around a later seed, or around the first place of its seed. So it suffices to hash the
windows around later seeds that are not inside the seed's factor, and those in the same places around the seed's first
place, and to compare them with each other.

Runs and windows are compared by 64-bit hashes of words that are hashed to 64 bits themselves.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convspark.llm.common import shared_folder, table

WINDOW = 20
#: A seed is longer than two neighbouring seeds of a text can be apart, which is WINDOW - SEED_WORDS + 1 words at most.
SEED_WORDS = 11
_PLACES = WINDOW - SEED_WORDS + 1
_STEP = 0x9E3779B97F4A7C15
_POWERS = {n: np.array([pow(_STEP, i + 1, 1 << 64) for i in range(n)], np.uint64) for n in (SEED_WORDS, WINDOW)}


def _words(data: bytes | None) -> list[bytes]:
    return (data or b"").split()


def _hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of so many words, mixed so that its order says nothing about the words."""
    n = len(hashes) - length + 1
    out = np.zeros(n, np.uint64)
    for i, power in enumerate(_POWERS[length]):
        out += hashes[i : i + n] * power
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return out


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """Least or largest of each run of so many values, by doubling."""
    done, step = values, 1
    while 2 * step <= width:
        done, step = pick(done[:-step], done[step:]), 2 * step
    if width > step:
        done = pick(done[: len(values) - width + 1], done[width - step :])
    return done


def seeds_of(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of the seeds of a text, none if it is shorter than a window. All places of a least hash count, so
    that the choice depends on the window alone."""
    if len(words) < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    runs = _runs(_hashes(words), SEED_WORDS)
    least = _sliding(runs, _PLACES, np.minimum)
    around = np.r_[np.zeros(_PLACES - 1, np.uint64), least, np.zeros(_PLACES - 1, np.uint64)]
    places = np.flatnonzero(_sliding(around, _PLACES, np.maximum) == runs)
    return runs[places], places


def windows_of(words: list[bytes], ranges: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the windows that start in one of the ranges (last place included)."""
    n = len(words) - WINDOW + 1
    edges = np.zeros(max(n, 0) + 1, np.int64)
    lows, highs = np.clip(np.array(ranges).T + [[0], [1]], 0, max(n, 0))
    np.add.at(edges, lows, 1)
    np.add.at(edges, highs, -1)
    starts = np.flatnonzero(np.cumsum(edges) > 0)
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    return _runs(_hashes(words), WINDOW)[starts], starts


_SEED = T.StructType([T.StructField("h", T.LongType()), T.StructField("at", T.LongType())])
_ARROW_SEEDS = pa.list_(pa.struct([("h", pa.int64()), ("at", pa.int64())]))


def _pairs(rows: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    ends = np.cumsum([0, *[len(h) for h, _ in rows]])
    h = np.concatenate([h for h, _ in rows] or [np.zeros(0, np.uint64)]).view(np.int64)
    at = np.concatenate([a for _, a in rows] or [np.zeros(0, np.int64)])
    pairs = pa.StructArray.from_arrays([pa.array(h), pa.array(at.astype(np.int64))], ["h", "at"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)


@F.arrow_udf(T.ArrayType(_SEED))
def _seeds(text: pa.Array) -> pa.Array:
    return _pairs([seeds_of(_words(t)) for t in text.cast(pa.binary()).to_pylist()])


@F.arrow_udf(T.ArrayType(_SEED))
def _windows(packed: pa.Array, ranges: pa.Array) -> pa.Array:
    rows = zip(packed.to_pylist(), ranges.to_pylist())
    return _pairs([windows_of(_words(_unpacked(p)), [(x >> 32, x & 0xFFFFFFFF) for x in r]) for p, r in rows])


def _unpacked(packed: bytes | None) -> bytes | None:
    return None if packed is None else zlib.decompress(packed)


@F.arrow_udf(T.BinaryType())
def _pack(text: pa.Array) -> pa.Array:
    return pa.array([None if t is None else zlib.compress(t, 1) for t in text.cast(pa.binary()).to_pylist()], pa.binary())


@F.arrow_udf(T.StringType())
def _unpack(packed: pa.Array) -> pa.Array:
    return pa.array([None if p is None else _unpacked(p).decode() for p in packed.to_pylist()], pa.string())


_KEPT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
_ARROW_KEPT = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def keep_words(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    if not spans:
        return words
    cover = np.zeros(len(words) + 1, np.int64)
    starts, ends = np.array(spans).T
    np.add.at(cover, starts, 1)
    np.add.at(cover, ends, -1)
    return [words[i] for i in np.flatnonzero(np.cumsum(cover[:-1]) == 0)]


@F.arrow_udf(_KEPT)
def _cut(packed: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for p, s in zip(packed.to_pylist(), spans.to_pylist()):
        words = _words(_unpacked(p))
        kept = keep_words(words, [(x["start"], x["end"]) for x in s or ()])
        out.append({"n_words": len(words), "n_removed": len(words) - len(kept), "kept": b" ".join(kept).decode()})
    return pa.array(out, _ARROW_KEPT)


TIE, PACKED, FOUND = "_llm_tie", "_llm_packed", "_llm_found"


#: A place is the document's doc_id and one number: 32 bits of a hash of its text, then the number of the word.
def _spot(at: Column) -> Column:
    return F.shiftleft(F.col("tie"), 32).bitwiseOR(at)


def _tie(spot: Column) -> Column:
    return F.shiftright(spot, 32)


def _at(spot: Column) -> Column:
    return spot.bitwiseAND(F.lit(0xFFFFFFFF))


def _stored(df: DataFrame, kind: str) -> DataFrame:
    """Written once in the shared folder and read from there: what follows uses it more than once."""
    folder = shared_folder(df.sparkSession, kind)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def _repeated(places: DataFrame) -> DataFrame:
    """(h, doc_id, spot, first) of the places whose hash occurs twice or more; first is the earliest place.

    Only hashes and counts, combined map-side, decide what repeats. Both sides of a join are tables or scans, not
    aggregates, so that Spark can split the rows of a frequent hash among tasks: each meets one row."""
    often = _stored(places.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "often")
    again = _stored(places.join(often, "h"), "seeds")
    first = _stored(again.groupBy("h").agg(F.min(F.struct("doc_id", "spot")).alias("first")), "first")
    return again.join(first, "h")


def _later(repeated: DataFrame) -> DataFrame:
    return repeated.filter(~F.struct("doc_id", "spot").eqNullSafe(F.col("first")))


def duplicate_spans(docs: DataFrame, packed: DataFrame) -> DataFrame:
    """(key, spans): merged word spans to remove of the documents that have any.

    ``docs`` has doc_id, ``TIE`` and text, ``packed`` doc_id, ``TIE`` and the deflated text."""
    places = docs.select("doc_id", F.col(TIE).alias("tie"), F.explode(_seeds("text")).alias("seed"))
    places = places.select(F.col("seed.h").alias("h"), "doc_id", _spot(F.col("seed.at")).alias("spot"))
    later = _later(_repeated(places)).select(
        "doc_id",
        _tie(F.col("spot")).alias("tie"),
        _at(F.col("spot")).alias("at"),
        F.col("first.doc_id").alias("ref_doc"),
        F.col("first.spot").alias("ref"),
    )

    # seeds of a document in order: a factor ends where the next seed refers elsewhere or does not touch
    along = Window.partitionBy("doc_id", "tie").orderBy("at", "ref_doc", "ref")
    before = lambda c: F.lag(c).over(along)
    goes_on = (
        F.col("ref_doc").eqNullSafe(before("ref_doc"))
        & (F.col("ref") - before("ref") == F.col("at") - before("at"))
        & (F.col("at") - before("at") <= SEED_WORDS)
    )
    factored = later.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("factor", F.sum("new").over(along))
    whole = Window.partitionBy("doc_id", "tie", "factor")
    factored = factored.withColumns({"start": F.min("at").over(whole), "end": F.max("at").over(whole) + SEED_WORDS})
    factored = _stored(factored.drop("new", "factor"), "factors")

    long = F.col("end") - F.col("start") >= WINDOW
    spans = factored.filter((F.col("at") == F.col("start")) & long).select("doc_id", "tie", "start", "end")

    # a seed's windows start up to so many words before it; those not inside the factor are looked at, here and there
    earliest = F.col("at") - (WINDOW - SEED_WORDS)
    left = F.struct(earliest.alias("low"), F.least(F.col("at"), F.col("start") - 1).alias("high"))
    right = F.struct(F.greatest(earliest, F.col("end") - WINDOW + 1).alias("low"), F.col("at").alias("high"))
    both = F.filter(F.array(left, right), lambda r: r["low"] <= r["high"])
    # a range as one number; what lies before a text's start is cut off
    one = lambda low, high: F.shiftleft(F.greatest(low, F.lit(0)), 32).bitwiseOR(high)
    shift = _at(F.col("ref")) - F.col("at")
    here = lambda r: F.struct(
        F.struct("doc_id", "tie").alias("key"), r["low"].alias("low"), r["high"].alias("high")
    )
    there = lambda r: F.struct(
        F.struct(F.col("ref_doc").alias("doc_id"), _tie(F.col("ref")).alias("tie")).alias("key"),
        (r["low"] + shift).alias("low"),
        (r["high"] + shift).alias("high"),
    )
    looked = factored.select(F.explode(F.concat(F.transform(both, here), F.transform(both, there))).alias("r")).select("r.*")
    looked = looked.filter("high >= 0").select("key", one(F.col("low"), F.col("high")).alias("range"))
    looked = looked.groupBy("key").agg(F.collect_set("range").alias("ranges"))

    seen = _joined(packed, looked, "inner")
    windows = seen.select("doc_id", F.col(TIE).alias("tie"), F.explode(_windows(PACKED, FOUND)).alias("window"))
    windows = windows.select(F.col("window.h").alias("h"), "doc_id", _spot(F.col("window.at")).alias("spot"))
    # as for the seeds: tables on both sides of the join, for windows that are very frequent
    windows = _stored(windows, "windows")
    first = windows.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "spot")).alias("first"))
    again = _later(windows.join(_stored(first.filter("n > 1").drop("n"), "first"), "h"))
    again = again.select("doc_id", _tie(F.col("spot")).alias("tie"), _at(F.col("spot")).alias("start"))
    spans = spans.union(again.select("doc_id", "tie", "start", F.col("start") + WINDOW))
    spans = _merged(spans.select(F.struct("doc_id", "tie").alias("key"), "start", "end"))
    return spans.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _merged(spans: DataFrame) -> DataFrame:
    """Overlapping and touching spans of a document as one."""
    along = Window.partitionBy("key").orderBy("start", "end")
    reached = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    parts = spans.withColumn("new", F.when(F.col("start") <= reached, 0).otherwise(1))
    parts = parts.withColumn("part", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return parts.groupBy("key", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def _joined(docs: DataFrame, other: DataFrame, how: str) -> DataFrame:
    """Texts with what is known of them, by one key (a struct with a null equals its like): the texts are dealt by
    document alike each time, and not sorted."""
    right = other.select(F.col("key").alias("_llm_key"), F.col(other.columns[-1]).alias(FOUND))
    key = F.struct(docs["doc_id"], docs[TIE].alias("tie"))
    return docs.join(right.hint("shuffle_hash"), key == right["_llm_key"], how)


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, n_removed and kept, the words that stay joined by blanks; input columns of these names go.

    A word goes if it is covered by a window of 20 words that also starts earlier: in a document with a smaller doc_id
    (null is smallest), or earlier in the same one. Rows that repeat a doc_id are ordered by a hash of their text; equal
    rows are one document, and each gets its result. Null and empty texts have no words.
    """
    tie = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).bitwiseAND(F.lit(0x7FFFFFFF))
    clean = docs.drop("n_words", "n_removed", "kept")
    keyed = clean.withColumn(TIE, tie)
    # texts travel deflated, and only they: all other columns are light
    packed = keyed.withColumn(PACKED, _pack("text")).drop("text")
    spans = duplicate_spans(keyed.select("doc_id", TIE, "text"), packed.select("doc_id", TIE, PACKED))
    out = _joined(packed, spans, "left").withColumn("_llm_cut", _cut(PACKED, FOUND))
    columns = [_unpack(PACKED).alias(c) if c == "text" else F.col(f"`{c}`") for c in clean.columns]
    return out.select(*columns, *[F.col(f"_llm_cut.{c}").alias(c) for c in ("n_words", "n_removed", "kept")])


def query(spark, sf_dir):
    found = deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op5_substring_dedup": query}
ORACLE = {}
