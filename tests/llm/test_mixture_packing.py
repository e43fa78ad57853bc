import random
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from convspark.llm import mixture_packing as P
from tests.llm.fixtures import documents, frame

PATH = P.tokenizer_path()


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def test_words_give_the_ids_of_whole_texts(tokenizer):
    rng = random.Random(4)
    alphabet = "abcXYZ  \n\t'.,;:!?-_<|>%$#0123éÉßıİΣςσ日本  \x0b\x0c\x1c\x85̸́ﬁ²Ⅷ"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(4000)]
    plain = "abcXYZ  \n\t'.,;:!?-_|>#0123éÉßÿÖöÆ sd'll've"
    texts += ["".join(rng.choice(plain) for _ in range(rng.randrange(60))) for _ in range(4000)]
    texts += ["It's we'll DON'T 'Tis o'rec", "a <|endoftext|> b<|endoftext|>c <|startoftext|", "", " ", "x" * 50_000, "ΟΔΟΣ ΣΑΣ."]
    texts += [t for _, t, *_ in documents() if t]
    encoder = P.Encoder(PATH)
    assert encoder.by_word
    want = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # then from the tables of known words
        assert [np.frombuffer(b, encoder.dtype).tolist() for b in encoder.encode(texts)] == want


def test_pieces_of_letters_are_encoded_together(tokenizer):
    class Counted:
        texts = 0

        def encode_batch_fast(self, texts, **options):
            Counted.texts += len(texts)
            return tokenizer.encode_batch_fast(texts, **options)

    rng = random.Random(8)
    words = ["".join(rng.choice("abcdeéßøÿst") for _ in range(rng.randrange(1, 30))) for _ in range(2000)]
    texts = [" ".join(words[at : at + 100]) + "'s 'till 3,5" for at in range(0, 2000, 100)]
    encoder = P.Encoder(PATH)
    encoder.tokenizer = Counted()
    got = [np.frombuffer(b, encoder.dtype).tolist() for b in encoder.encode(texts)]
    assert got == [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert Counted.texts < 20  # 2,000 before
    # ids that do not end as many words as there are pieces: one by one
    encoder.pieces.clear()
    encoder.last = np.zeros_like(encoder.last)
    encoder.last[tokenizer.encode("a", add_special_tokens=False).ids] = True
    assert [np.frombuffer(b, encoder.dtype).tolist() for b in encoder.encode(texts)] == got


def plain_service(totals, shares):
    """Deficit round-robin, round by round, slice by slice: the sources of the tokens in the order of service."""
    left, credit, out = list(totals), [0] * len(totals), []
    while any(left):
        for s, share in enumerate(shares):
            if not left[s]:
                continue
            credit[s] += share
            while credit[s] >= 1 << P._UNIT and left[s]:
                credit[s] -= 1 << P._UNIT
                some = min(P.SLICE, left[s])
                out += [s] * some
                left[s] -= some
    return out


@pytest.mark.parametrize("seed", range(6))
def test_places_equal_rounds_one_by_one(seed):
    rng = random.Random(seed)
    n = rng.randrange(1, 7)
    totals = [rng.randrange(1, 6000) for _ in range(n)]
    shares = [rng.choice([1 << 14, 1 << 20, 12345678, 700_000]) for _ in range(n)]
    order = plain_service(totals, shares)
    plan = P.Schedule(totals, shares, window=256)
    queue, place = Counter(), {}
    for at, s in enumerate(order):
        place[s, queue[s]] = at
        queue[s] += 1
    for s, total in enumerate(totals):
        cuts = sorted(rng.sample(range(1, total), min(total - 1, 5))) if total > 1 else []
        first = np.array([0, *cuts])
        length = np.diff([0, *cuts, total])
        row, start, size, window, offset = plan.pieces(np.full(len(first), s), first, length)
        got = {}
        for r, b, k, w, o in zip(row, start, size, window, offset):
            for i in range(k):
                got[first[r] + b + i] = plan.start_of(np.array([w]))[0] + o + i
        assert got == {i: place[s, i] for i in range(total)}


def check(rows, pieces, tokenizer, window):
    """Every id in one piece, sequences gapless, full but for powers of two."""
    want = Counter()
    for i, text, *_ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        want[i, struct.pack(f"<{len(ids)}I", *ids)] += 1
    found, seqs = defaultdict(list), defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length and p.length > 0
        found[p.doc_id, p.doc_tokens].append((p.start, bytes(p.ids)))
        seqs[p.sequence_id].append((p.offset, p.length))
    have = Counter()
    for (i, n), parts in found.items():
        copies = Counter(s for s, _ in parts)[0]
        if copies == 1:
            parts.sort()
            whole = b"".join(b for _, b in parts)
            assert [s for s, _ in parts] == list(np.cumsum([0] + [len(b) // 4 for _, b in parts[:-1]]))
            have[i, whole] += 1
        else:  # rows that repeat an id: total length only
            assert sum(len(b) for _, b in parts) == 4 * n * copies
            want = Counter({k: v for k, v in want.items() if k[0] != i or len(k[1]) != 4 * n})
    assert have == want
    lengths = []
    for parts in seqs.values():
        parts.sort()
        assert [o for o, _ in parts] == list(np.cumsum([0] + [k for _, k in parts[:-1]]))
        lengths.append(sum(k for _, k in parts))
    assert set(seqs) == set(range(len(seqs))) and max(lengths) <= window
    assert all(n & (n - 1) == 0 for n in lengths) and Counter(lengths).most_common(1)[0][0] == window


@pytest.mark.parametrize("weights", [None, {"s0": 5.0, "s1": 0.0}])
def test_every_id_lies_in_one_piece(spark, tokenizer, weights):
    rows = documents()
    docs = frame(spark, rows).withColumns({"length": F.lit("x"), "ids": F.lit(1), "part": F.lit(2)}).repartition(5)
    pieces = P.pack(docs, PATH, weights, window=256)
    check(rows, pieces.collect(), tokenizer, 256)
    whole = P.sequences(pieces)
    assert whole.filter("length * 4 != length(ids)").count() == 0


def test_windows_keep_the_proportions(spark):
    rows = [(i, " ".join(["word"] * (1 + i * 7 % 300)), "en", f"s{i % 3 if i % 7 else 0}", 0) for i in range(600)]
    pieces = P.pack(frame(spark, rows).repartition(7), PATH)
    total = {r.source: r.n for r in pieces.groupBy("source").agg(F.sum("length").alias("n")).collect()}
    share = {s: n / sum(total.values()) for s, n in total.items()}
    upto = Counter()
    by_window = {(r.sequence_id, r.source): r.n for r in pieces.groupBy("sequence_id", "source").agg(F.sum("length").alias("n")).collect()}
    for w in range(sum(total.values()) // P.WINDOW):
        for s in share:
            upto[s] += by_window.get((w, s), 0)
            # deficits are carried: the sum over windows never strays, and neither does a window
            assert abs(upto[s] - share[s] * P.WINDOW * (w + 1)) <= P.SLICE * (len(share) + 1)


def test_target_weights_hold_while_queues_last(spark):
    rows = [(i, " ".join(["word"] * 99), "en", f"s{i % 2}", 0) for i in range(400)]
    pieces = P.pack(frame(spark, rows), PATH, {"s0": 3.0})
    n = {r.source: r.n for r in pieces.filter("sequence_id < 8").groupBy("source").agg(F.sum("length").alias("n")).collect()}
    assert abs(n["s0"] - 8 * P.WINDOW * 0.75) <= 2 * P.SLICE


def test_tables_of_known_words_start_anew(tokenizer, monkeypatch):
    monkeypatch.setattr(P, "_KNOWN", 10)
    encoder = P.Encoder(PATH)
    for _, text, *_ in documents()[:30]:
        want = tokenizer.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode([text or ""])[0], encoder.dtype).tolist() == want


def test_empty_table(spark):
    assert P.pack(frame(spark, []), PATH).count() == 0
