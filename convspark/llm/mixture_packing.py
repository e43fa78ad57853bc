"""Operator 12: packing controlled by a mixture, by deficit round-robin over source queues.

The documents of a source, end to end, form its queue of tokens. Rounds go over the sources in order: in each round a source
is credited its share of ``window`` tokens, and served as many slices of ``SLICE`` tokens as its credit covers; what is left
of the credit, its deficit, is carried to the next round. A source whose queue is empty gets nothing, so the others fill the
windows in the proportions left. The tokens in the order of service are cut into windows.

After any number of rounds the credit of a source is that number times its share, so its deficit in front of any round, and
with it the place of any slice, follows from the totals of the sources by whole-number arithmetic. No task waits for
another: every partition finds the windows of its documents by itself, with the deficits that the partitions before it
left. Texts are tokenized once; their ids lie in a table of the shared folder.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from convspark.functions.scale import sums_before
from convspark.llm.common import shared_folder, table

WINDOW = 2048
SLICE = 64
END_ID = 1
_UNIT = 20  # shares are multiples of 2^-20 slices a round
#: Entries of a worker's table of known words, half of those of its table of known pieces; a full table starts anew.
_KNOWN = 1 << 18
#: Slices that are placed at once.
_AT_ONCE = 1 << 14
_ASCII_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: Texts of printable ASCII and the letters of Latin-1, and their pieces: no mark joins a letter there, and lower case is
#: one letter for one.
_PLAIN = re.compile(r"[\x20-\x7e\n\t\r\xc0-\xd6\xd8-\xf6\xf8-\xff]*")
_PLAIN_PIECE = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^a-z0-9\xdf-\xf6\xf8-\xff \n\t\r]+")
#: Pieces of such letters that are encoded in one call, with blanks between them.
_LETTERS, _TOGETHER = re.compile(r"[a-z\xdf-\xf6\xf8-\xff]+"), 512


class Encoder:
    """Ids of texts as bytes, equal to what the tokenizer gives for the whole text.

    White space always ends a token of this kind of tokenizer (``splits_words``), so a text is the sequence of its words,
    and words that were seen are not encoded again. Texts of Latin-1 letters are cut into the tokenizer's own pieces, as are
    printable ASCII words of other texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.by_word = splits_words(self.tokenizer)
        self.last = self._last_of_words()

    def _last_of_words(self) -> np.ndarray | None:
        """Whether each id is the last one of a word; None for tokenizers that do not mark it."""
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        if not self.by_word or not suffix:
            return None
        vocabulary = self.tokenizer.get_vocab()
        last = np.zeros(max(vocabulary.values()) + 1, bool)
        last[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        return last

    def _plain(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, self.dtype).tobytes() for e in found]

    def _letters(self, pieces: list[str]) -> list[bytes]:
        """Pieces of letters, many in a call. Each is one word, so its ids go on to the next id that ends one; where there
        are not as many of these as pieces, the pieces are encoded one by one."""
        out, size = [], self.dtype.itemsize
        chunks = [pieces[at : at + _TOGETHER] for at in range(0, len(pieces), _TOGETHER)]
        found = self.tokenizer.encode_batch_fast([" ".join(c) for c in chunks], add_special_tokens=False)
        for chunk, e in zip(chunks, found):
            ids = np.array(e.ids, self.dtype)
            ends = ((np.flatnonzero(self.last[ids]) + 1) * size).tolist()
            raw = ids.tobytes()
            if len(ends) == len(chunk) and ends[-1] == len(raw):
                out.extend([raw[a:b] for a, b in zip([0, *ends], ends)])
            else:
                out.extend(self._plain(chunk))
        return out

    def _learn_pieces(self, pieces: set[str]) -> None:
        new = pieces - self.pieces.keys()
        if self.last is not None:
            letters = [p for p in new if _LETTERS.fullmatch(p)]
            self.pieces.update(zip(letters, self._letters(letters)))
            new.difference_update(letters)
        rest = list(new)
        self.pieces.update(zip(rest, self._plain(rest)))

    def _learn(self, words: list[str]) -> None:
        cut = [self._cut(w) for w in words]
        self._learn_pieces({p for ps in cut for p in ps})
        self.words.update((w, b"".join([self.pieces[p] for p in ps])) for w, ps in zip(words, cut))

    @staticmethod
    def _cut(word: str) -> list[str]:
        if "<|" in word:  # may be a special token
            return [word]
        if word.isascii():
            return _ASCII_PIECE.findall(word.lower()) if word.isprintable() else [word]
        core = word.rstrip(".,;:!?")
        if len(core) < len(word) and core and core[-1].lower().isalpha():  # a letter still in lower case
            return [core, word[len(core) :]]
        return [word]

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._plain(texts)
        if len(self.pieces) > 2 * _KNOWN:
            self.pieces.clear()
        if len(self.words) > _KNOWN:
            self.words.clear()
        plain = [_PLAIN.fullmatch(t) is not None and "<|" not in t for t in texts]
        cut = [_PLAIN_PIECE.findall(t.lower()) if p else None for t, p in zip(texts, plain)]
        self._learn_pieces(set().union(*[c for c in cut if c]))
        blanks = str.maketrans("\n\t\r", "   ")
        split = [None if p else t.translate(blanks).split(" ") for t, p in zip(texts, plain)]
        self._learn(list(set().union(*[w for w in split if w]) - self.words.keys()))
        pieces, words = self.pieces.__getitem__, self.words.__getitem__
        return [b"".join(map(pieces, c) if p else map(words, w)) for p, c, w in zip(plain, cut, split)]


def splits_words(tokenizer) -> bool:
    """Whether a text gives the ids of its words, on a text of marks, digits, letters of two scripts and blanks. False for
    tokenizers that put blanks into tokens; they then encode whole texts."""
    probe = "It's 3,05 o'CLOCK... \n\n(Élan's)\t«naïve» x_y--z 12% don't,we'll Ünd!? 日本 a"
    words = re.split("[ \n\t\r]+", probe)
    whole = tokenizer.encode(probe, add_special_tokens=False).ids
    cut = [p for w in words for p in Encoder._cut(w)]
    return whole == [i for p in cut for i in tokenizer.encode(p, add_special_tokens=False).ids]


_ENCODERS: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _ENCODERS:  # kept by a worker from task to task
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, source, part, before, n, ids): the ids of each document with ``end_id`` behind them, as little-endian
    unsigned numbers of 16 or 32 bits, in a table of the shared folder. ``before``: tokens of the source that stand
    before the document in its part."""
    spark = docs.sparkSession
    fields = [
        T.StructField("source", T.StringType()),
        T.StructField("part", T.LongType()),
        T.StructField("before", T.LongType()),
        T.StructField("n", T.LongType()),
        T.StructField("ids", T.BinaryType()),
    ]
    schema = T.StructType([docs.schema["doc_id"], *fields])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = _encoder(path), TaskContext.get().partitionId(), {}
        end = np.array([end_id], encoder.dtype).tobytes()
        for batch in batches:
            ids = [b + end for b in encoder.encode(batch.column(2).to_pylist())]
            n = [len(b) // encoder.dtype.itemsize for b in ids]
            before = []
            for source, tokens in zip(batch.column(1).to_pylist(), n):
                at = seen.get(source, 0)
                before.append(at)
                seen[source] = at + tokens
            out = [batch.column(0), batch.column(1), pa.array([part] * len(n), pa.int64()), pa.array(before, pa.int64())]
            yield pa.RecordBatch.from_arrays([*out, pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=schema.names)

    source = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")
    read = docs.select("doc_id", source, F.coalesce("text", F.lit("")).alias("text"))
    folder = shared_folder(spark, "tokens")
    read.mapInArrow(encode, schema).write.parquet(folder)
    return spark.read.parquet(folder)


class Schedule:
    """Where the tokens of the queues go. ``totals``: tokens of each source, in the order of service; ``shares``: slices
    that a source is credited in a round, in units of 2^-20."""

    def __init__(self, totals: list[int], shares: list[int], window: int = WINDOW):
        self.totals = np.array(totals, np.int64)
        self.shares = np.array(shares, np.int64)
        self.window = window
        #: the round after which a queue is empty
        self.rounds = -(-(-(-self.totals // SLICE) << _UNIT) // np.maximum(self.shares, 1)) + 1
        whole = int(self.totals.sum())
        # the rest behind the last full window forms windows of powers of two, which need no padding
        rest, starts = whole % window, [whole - whole % window]
        while rest:
            starts.append(starts[-1] + (1 << rest.bit_length() - 1))
            rest -= 1 << rest.bit_length() - 1
        self.full, self.tail = whole // window, np.array(starts, np.int64)

    def served(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens of each source (columns) that were served after so many rounds (rows)."""
        credit = np.minimum(rounds[:, None], self.rounds[None]) * self.shares[None]
        return np.minimum(self.totals[None], (credit >> _UNIT) * SLICE)

    def deficits(self, rounds: np.ndarray) -> np.ndarray:
        """Tokens, rounded down, that each source is short of its credit after so many rounds; 0 once its queue is empty."""
        credit = np.minimum(rounds[:, None], self.rounds[None]) * self.shares[None] * SLICE >> _UNIT
        return np.minimum(self.totals[None], credit) - self.served(rounds)

    def place(self, source: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Place, in the order of service, of the first token of the slices ``number`` of the queues ``source``."""
        out = np.empty(len(number), np.int64)
        for at in range(0, len(number), max(1, _AT_ONCE * 16 // max(16, len(self.totals)))):
            some = slice(at, at + max(1, _AT_ONCE * 16 // max(16, len(self.totals))))
            s, k = source[some], number[some]
            share = self.shares[s]
            rounds = -(-(k + 1 << _UNIT) // share) - 1  # the round whose credit covers the slice
            old, new = self.served(rounds), self.served(rounds + 1)
            rows = np.arange(len(s))
            in_round = np.concatenate([np.zeros((len(s), 1), np.int64), np.cumsum(new - old, axis=1)], axis=1)
            out[some] = old.sum(axis=1) + in_round[rows, s] + k * SLICE - old[rows, s]
        return out

    def window_of(self, place: np.ndarray) -> np.ndarray:
        tail = self.full + np.searchsorted(self.tail, place, "right") - 1
        return np.where(place < self.tail[0], place // self.window, tail)

    def start_of(self, window: np.ndarray) -> np.ndarray:
        tail = self.tail[np.clip(window - self.full, 0, len(self.tail) - 1)]
        return np.where(window < self.full, window * self.window, tail)

    def pieces(self, source: np.ndarray, first: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """(row, start, length, window, offset) of the pieces of documents that begin at the token ``first`` of their
        queue and have ``n`` tokens, by row and start. Neighbours that meet in a window are one piece."""
        low, high = first // SLICE, (first + n - 1) // SLICE + 1
        count = high - low
        row = np.repeat(np.arange(len(n)), count)
        number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        begin = np.maximum(number * SLICE, first[row])
        length = np.minimum((number + 1) * SLICE, (first + n)[row]) - begin
        place = self.place(source[row], number) + begin - number * SLICE
        window, last = self.window_of(place), self.window_of(place + length - 1)
        cuts = last - window + 1
        piece = np.repeat(np.arange(len(row)), cuts)
        window = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts) + np.repeat(window, cuts)
        start = np.maximum(place[piece], self.start_of(window))
        end = np.minimum((place + length)[piece], self.start_of(window + 1))
        end = np.where(window == last[piece], (place + length)[piece], end)
        row, at = row[piece], begin[piece] - first[row[piece]] + start - place[piece]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (window[1:] != window[:-1]) | (start[1:] != end[:-1])
        heads = np.flatnonzero(new)
        lengths = np.add.reduceat(end - start, heads) if len(heads) else heads
        return row[heads], at[heads], lengths, window[heads], start[heads] - self.start_of(window[heads])


def schedule(tokens: DataFrame, weights: dict[str, float] | None, default: float, window: int) -> tuple[Schedule, list[str]]:
    """The schedule and the sources in the order of service. One number for each source goes through the driver."""
    found = tokens.groupBy("source").agg(F.sum("n").alias("n")).orderBy("source").collect()
    weight = [float(r["n"] if weights is None else weights.get(r["source"], default)) for r in found]
    whole = sum(weight)
    # a source of weight 0 has the smallest share there is: its documents are packed too, last
    shares = [max(1, round(w / whole * (window / SLICE) * (1 << _UNIT))) if whole else 1 << _UNIT for w in weight]
    return Schedule([r["n"] for r in found], shares, window), [r["source"] for r in found]


def pack(
    docs: DataFrame,
    path: str,
    weights: dict[str, float] | None = None,
    default: float = 1.0,
    window: int = WINDOW,
    end_id: int = END_ID,
) -> DataFrame:
    """(doc_id, source, start, length, doc_tokens, sequence_id, offset, ids): the pieces of the documents; ``ids`` are
    little-endian unsigned 32-bit numbers.

    ``path`` names a tokenizer file that driver and executors see. ``weights`` give the target proportions of tokens
    (``default`` for sources not named); None stands for the proportions of the corpus, the only ones that hold in all
    windows when every document is packed once. With others, windows keep to them while all queues last.
    A null or empty text is its end id alone, a null source counts as ''. Rows that repeat a doc_id are documents of their
    own. A queue follows the order of the table. Sequences are full but for at most one of each power of two below
    ``window``. Other columns are not read. Memory of a task: its batch, and one number for each source.
    """
    spark = docs.sparkSession
    tokens = tokenized(docs, path, end_id)
    plan, sources = schedule(tokens, weights, default, window)
    number = {source: i for i, source in enumerate(sources)}
    sizes = tokens.groupBy("source", "part").agg(F.sum("n").alias("n"))
    offsets = sums_before(sizes, ["source"], "part", "n", "base")
    offsets = offsets.withColumnsRenamed({"source": "_source", "part": "_part"})
    placed = tokens.join(offsets, (F.col("source") == F.col("_source")) & (F.col("part") == F.col("_part")))
    placed = placed.select("doc_id", "source", (F.col("base") + F.col("before")).alias("first"), "n", "ids")
    names = ["start", "length", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType(
        [docs.schema["doc_id"], T.StructField("source", T.StringType())]
        + [T.StructField(name, T.LongType()) for name in names]
        + [T.StructField("ids", T.BinaryType())]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            first, n = (batch.column(i).to_numpy() for i in (2, 3))
            source = np.array([number[s] for s in batch.column(1).to_pylist()], np.int64)
            row, start, length, sequence, offset = plan.pieces(source, first, n)
            ids = batch.column(4).to_pylist()
            wide = [np.frombuffer(b, f"<u{len(b) // k}").astype("<u4").tobytes() for b, k in zip(ids, n.tolist())]
            parts = [wide[r][4 * s : 4 * (s + k)] for r, s, k in zip(row.tolist(), start.tolist(), length.tolist())]
            place = pa.array(row)
            columns = [batch.column(0).take(place), batch.column(1).take(place), pa.array(start), pa.array(length)]
            columns += [pa.array(n[row]), pa.array(sequence), pa.array(offset), pa.array(parts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return placed.mapInArrow(cut, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the packed sequences, each of at most a window of ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.unhex(F.lit("")), lambda whole, p: F.concat(whole, p["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir):
    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_path())
    crc = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "source", "start", "length", crc, "doc_tokens", "sequence_id", "offset")


QUERIES = {"op12_mixture_packing": query}
ORACLE = {}
