"""Operator 3: benchmark passages in training documents, found by an FM-index per training shard.

Phrases are the windows of ten consecutive words of the benchmark items (an item of fewer words is one phrase). A shard is
an Arrow batch of documents. Words that no phrase has are boundaries in the index, and stretches between boundaries that
are shorter than the shortest phrase cannot hold one and are left out; both lose no occurrence. Phrases are searched
backwards through the wavelet ranks, all at once; occurrences are located by sampled positions and merged to spans.

No document leaves its task. The phrases are a stated query set, sent to the tasks in blocks of at most ``BLOCK`` phrases.
The driver and each Python worker hold one block at a time; the others lie in files, so that memory does not follow the size
of the benchmark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convspark.llm.common import prepared, replaced, table
from convspark.llm.fm_index import FMIndex

WINDOW = 10
#: Phrases in a block (some 100 bytes each).
BLOCK = 100_000
#: Words of a shard after which the next one begins.
SHARD_WORDS = 1 << 21
# bytes of a UTF-8 text: digits, a-z and everything beyond ASCII
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_WORD_TEXT = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")

_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("spans", T.ArrayType(_SPAN)),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_ARROW_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_ARROW_FOUND = pa.struct(
    [("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(_ARROW_SPAN)), ("items", pa.list_(pa.string()))]
)


def words_of(data: bytes | None) -> list[bytes]:
    return _WORD.findall((data or b"").lower())


def phrases_of(data: bytes | None, window: int = WINDOW) -> list[str]:
    words = words_of(data)
    if not words:
        return []
    return sorted({b" ".join(words[i : i + window]).decode() for i in range(max(1, len(words) - window + 1))})


def phrases(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(phrase, items): the distinct phrases with the ids, as strings, of the items that have them.

    Null texts and texts without words give none; a null item_id counts as an empty string.
    """

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def cut(text: pa.Array) -> pa.Array:
        return pa.array([phrases_of(t, window) for t in text.cast(pa.binary()).to_pylist()], pa.list_(pa.string()))

    item = F.coalesce(F.col("item_id").cast("string"), F.lit(""))
    one = benchmark.select(item.alias("item"), F.explode(cut("text")).alias("phrase"))
    return one.groupBy("phrase").agg(F.sort_array(F.collect_set("item")).alias("items"))


class Block:
    """Some phrases as numbers: vocabulary, phrase matrix, item ids."""

    def __init__(self, rows: list):
        self.vocabulary: dict[bytes, int] = {}
        number = lambda w: self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        coded = [[number(w) for w in r["phrase"].encode().split(b" ")] for r in rows]
        self.lengths = np.array([len(c) for c in coded], np.int64)
        self.phrases = np.zeros((len(coded), int(self.lengths.max())), np.int32)
        for i, c in enumerate(coded):
            self.phrases[i, : len(c)] = c
        self.items = [r["items"] for r in rows]


def _blocks(found: DataFrame, size: int) -> Iterator[Block]:
    rows = []
    for row in found.toLocalIterator():
        rows.append(row)
        if len(rows) == size:
            yield Block(rows)
            rows = []
    if rows:
        yield Block(rows)


def _in_turn(sent: list[Broadcast]) -> Iterator[Block]:
    """The blocks one after another. Where there are several, a worker forgets each before it reads the next; an encrypted
    block cannot be read twice and stays."""
    for one in sent:
        yield one.value
        if len(sent) > 1 and getattr(one, "_path", None):
            one.__dict__.pop("_value", None)


def _occurrences(texts: list[list[bytes]], block: Block):
    """(document, first word, length, phrase) of each occurrence, as arrays."""
    shortest = int(block.lengths.min())
    sizes = np.array([len(w) for w in texts], np.int64)
    ids = np.zeros(int(sizes.sum()) + len(texts) + 1, np.int32)  # a boundary behind each document
    starts = np.cumsum(np.r_[0, sizes[:-1] + 1])
    get = block.vocabulary.get
    for at, words in zip(starts, texts):
        ids[at : at + len(words)] = np.fromiter(map(get, words, repeat(0)), np.int32, len(words))
    known = np.r_[False, ids != 0, False]
    edges = np.flatnonzero(known[1:] != known[:-1])
    first, last = edges[::2], edges[1::2]
    long = last - first >= shortest
    first, last = first[long], last[long]
    if not len(first):
        return None
    # the stretches one after another, a boundary behind each; from: where a stretch came from
    lengths = last - first + 1
    to = np.cumsum(np.r_[0, lengths[:-1]])
    source = np.arange(int(lengths.sum())) + np.repeat(first - to, lengths)
    symbols = ids[source]
    symbols[to + lengths - 1] = 0
    index = FMIndex(symbols, len(block.vocabulary))
    low, high = index.search(block.phrases, block.lengths)
    counts = high - low
    if not counts.any():
        return None
    which = np.repeat(np.arange(len(counts)), counts)
    rows = np.arange(len(which)) + np.repeat(low - np.r_[0, np.cumsum(counts)[:-1]], counts)
    at = source[index.locate(rows)]
    doc = np.searchsorted(starts, at, side="right") - 1
    return doc, at - starts[doc], block.lengths[which], which


def search_shard(texts: list[list[bytes]], blocks) -> list[dict]:
    """For the words of each document: counts, merged spans of hit words, items with occurring phrases."""
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[str]] = [set() for _ in texts]
    for block in blocks:
        if (hits := _occurrences(texts, block)) is not None:
            doc, at, length, which = hits
            order = np.lexsort((at, doc))
            for d, a, n in zip(doc[order].tolist(), at[order].tolist(), length[order].tolist()):
                found[d].append((a, a + n))
            for d, w in np.unique(np.stack([doc, which], 1), axis=0).tolist():
                items[d].update(block.items[w])
        del block  # the next one is read without it
    out = []
    for words, spans, have in zip(texts, found, items):
        merged: list[list[int]] = []
        for a, b in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        spans = [{"start": a, "end": b} for a, b in merged]
        out.append({"n_words": len(words), "n_hit": sum(b - a for a, b in merged), "spans": spans, "items": sorted(have)})
    return out


def search(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block: int = BLOCK, name: str = "found"
) -> DataFrame:
    """``docs`` with a column ``name`` (an input column of that name goes): n_words, n_hit, spans of hit words (numbers
    of words, end exclusive, merged), items (ids as strings, sorted).

    A null or empty text has no words and no hits. Rows are judged one by one, so repeated rows and ids stay. Very long
    texts are whole; one text is the least that a shard holds. An empty benchmark hits nothing.
    """
    spark = prepared(docs.sparkSession)
    sent = [spark.sparkContext.broadcast(b) for b in _blocks(phrases(benchmark, window), block)]

    @F.arrow_udf(FOUND)
    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out, texts, size = [], [], 0
            for data in batch.cast(pa.binary()):
                texts.append(words_of(data.as_py()))
                size += len(texts[-1])
                if size >= SHARD_WORDS:
                    out += search_shard(texts, _in_turn(sent))
                    texts, size = [], 0
            out += search_shard(texts, _in_turn(sent))
            yield pa.array(out, _ARROW_FOUND)

    return replaced(docs, **{name: look("text")})


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans of words, from a span's first word to the end of its last."""
    kept, done, left = [], 0, iter(spans)
    span = next(left, None)
    start = 0
    for n, word in enumerate(_WORD_TEXT.finditer(_lower(text))):
        if span is None:
            break
        if n == span[0]:
            start = word.start()
        if n == span[1] - 1:
            kept.append(text[done:start])
            done = word.end()
            span = next(left, None)
    return "".join([*kept, text[done:]])


def _lower(text: str) -> str:
    return text.encode().lower().decode()


@F.arrow_udf(T.StringType())
def _without(text: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for t, s in zip(text.to_pylist(), spans.to_pylist()):
        out.append(cut_words(t, [(x["start"], x["end"]) for x in s]) if s else t)
    return pa.array(out, pa.string())


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` with the removal spans cut out of the texts; other documents stay as they are.

    A document of which no word is left goes, unless it had none to begin with. ``n_chars``, where there is such a
    column, is counted anew for changed texts.
    """
    found = "_llm_found"
    seen = search(docs, benchmark, name=found)
    hit = F.col(f"{found}.n_hit") > 0
    clean = seen.filter(~hit | (F.col(f"{found}.n_hit") < F.col(f"{found}.n_words")))
    clean = clean.withColumn("text", _without("text", F.when(hit, F.col(f"{found}.spans"))))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(hit, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    seen = search(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "found.*")
    return seen.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {"op3_decontaminate": query}
ORACLE = {}
