import math
import random
import zlib

from pyspark.sql import functions as F

from convspark.llm import language_id as L
from tests.llm.fixtures import documents, frame

SYLLABLES = {"aa": "ka to mi re su".split(), "bb": "blorn strig fump dex wol".split(), "cc": "été où ça nöl gü".split()}


def text_of(rng, lang, n=60):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n)) + "."


def corpus(n=300):
    rng = random.Random(4)
    langs = sorted(SYLLABLES)
    return [(i, text_of(rng, langs[i % 3]), langs[i % 3], "s", 1) for i in range(n)]


def plain_phrases(symbols: str, sample: str) -> int:
    count = at = 0
    while at < len(symbols):
        end = at
        while end < len(symbols) and symbols[at : end + 1] in sample:
            end += 1
        at = end + (end < len(symbols) and symbols[end] not in sample)
        count += 1
    return count


def test_automaton_accepts_exactly_the_substrings():
    text = L.letters("abracadabra abba baccarat")
    steps = L.suffix_automaton(text)

    def accepts(s):
        state = 0
        for c in s:
            if c not in steps[state]:
                return False
            state = steps[state][c]
        return True

    rng = random.Random(1)
    for _ in range(500):
        s = "".join(rng.choice("abcrdt ") for _ in range(rng.randrange(1, 7)))
        assert accepts(s) == (s in text)


def test_phrases_equal_plain_parsing():
    rng = random.Random(2)
    samples = {lang: L.letters(text_of(rng, lang, 30)) for lang in SYLLABLES}
    parser = L.Parser(samples)
    texts = [text_of(rng, lang, n) for lang in SYLLABLES for n in (1, 5, 900)] + ["qqq zzz 日本", "x"]
    pieces = [L.letters(t)[a : a + L.PIECE] for t in texts for a in range(0, len(L.letters(t)), L.PIECE)]
    got = parser.count([parser.codes[[ord(c) for c in p]] for p in pieces])
    for p, row in zip(pieces, got):
        assert row.tolist() == [plain_phrases(p, samples[lang]) for lang in parser.langs]
    whole = parser.predict(texts)
    for t, r in zip(texts, whole):
        n = len(L.letters(t))
        cut = [L.letters(t)[a : a + L.PIECE] for a in range(0, n, L.PIECE)]
        rates = {x: sum(plain_phrases(p, samples[x]) for p in cut) * math.log2(len(samples[x]) + 1) / n for x in parser.langs}
        assert r["lang"] == min(sorted(rates), key=rates.get)
        best, second = sorted(rates.values())[:2]
        assert abs(r["score"] - (1 - best / second)) < 1e-9


def test_held_out_accuracy_and_columns(spark, tmp_path):
    rows = corpus()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = L.query(spark, str(tmp_path)).collect()
    true = {r[0]: r[2] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in got if r.held_out]
    assert held and all(r.lang_pred == true[r.doc_id] and 0 < r.score <= 1 for r in held)


def test_labels_of_held_out_rows_teach_nothing(spark):
    rows = corpus()
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    other = [(i, t, "wrong" if held(i) else lang, s, n) for i, t, lang, s, n in rows]
    assert L.sample(frame(spark, rows)) == L.sample(frame(spark, other))


def test_sample_takes_different_texts_from_any_place(spark):
    rng = random.Random(6)
    header = "same header of all pages " * 20
    rows = [(i, header + text_of(rng, "bb", 200), "bb", "s", 1) for i in range(200)]
    rows += [(i, "0" * 400 + text_of(rng, "aa", 9), "aa", "s", 1) for i in range(200, 230)]
    rows += [(i, "only copy", "cc", "s", 1) for i in range(1000, 3000)] + [(i, text_of(rng, "cc"), "cc", "s", 1) for i in range(300, 400)]
    got = L.sample(frame(spark, rows).repartition(40))
    assert got["bb"].count("strig") > 100  # what stands behind the header
    assert got["aa"].count(" ") > 50  # letters behind 400 digits
    assert got["cc"].count("only copy") <= 1 and len(got["cc"]) > 60 * L.SAMPLE_DOCS
    whole = {L.letters(t) for _, t, *_ in rows}
    for text in got.values():  # whole texts, as many as the bound says
        assert sum(text.count(t) for t in whole if t in text) == L.SAMPLE_DOCS


def test_long_texts_are_sampled_last(spark):
    rng = random.Random(7)
    rows = [(i, text_of(rng, "aa", 400), "aa", "s", 1) for i in range(60)] + [(i, text_of(rng, "aa", 9), "aa", "s", 1) for i in range(60, 70)]
    rows += [(i, text_of(rng, "bb", 400), "bb", "s", 1) for i in range(100, 103)]
    got = L.sample(frame(spark, rows), max_docs=4, long_text=200)
    assert len(got["aa"]) < 4 * 200 < len(got["bb"])


def test_many_letters_take_little_memory():
    rng = random.Random(3)
    signs = [chr(c) for c in range(0x4E00, 0x4E00 + 5000)]
    samples = {f"l{k}": L.letters("".join(rng.choice(signs[k * 500 :]) for _ in range(20_000))) for k in range(4)}
    parser = L.Parser(samples)
    assert parser.keys.nbytes + parser.goals.nbytes < 64 * sum(map(len, samples.values())) * 4
    piece = L.letters("".join(rng.choice(signs) for _ in range(900)) + samples["l2"][500:560])
    got = parser.count([parser.symbols(piece)])[0].tolist()
    assert got == [plain_phrases(L.letters(piece), samples[lang]) for lang in parser.langs]


def test_pipeline_keeps_texts_with_letters_where_nothing_was_learned(spark):
    docs = frame(spark, [(1, "abc def", None, "s", 7), (2, "12 3", None, "s", 4), (3, None, None, "s", 0), (4, "é", None, "s", 1)])
    assert sorted(r.doc_id for r in L.known_language(docs).collect()) == [1, 4]


def test_awkward_texts(spark):
    rows = [*documents(), (901, "123 !! 45", "en", "s", 1)]
    docs = frame(spark, [*corpus(90), *rows]).withColumn("score", F.lit("clash"))
    out = L.identify(docs, L.fit(docs))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "lang_pred", "score"]
    for r in out.collect():
        letters = bool(r.text) and any(map(str.isalpha, r.text))
        assert (r.lang_pred == L.UNKNOWN) == (not letters) and 0 <= r.score <= 1
    kept = L.known_language(docs.drop("score"))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept.filter("doc_id = 901 or text is null").count() == 0


def test_nothing_to_learn(spark):
    docs = frame(spark, [(1, "some words", None, "s", 1)])
    assert [(r.lang_pred, r.score) for r in L.identify(docs, L.fit(docs)).collect()] == [("und", 0.0)]
    assert L.identify(frame(spark, []), L.fit(frame(spark, []))).count() == 0
    one = L.Model({"xx": L.letters("some words")})
    assert [(r.lang_pred, r.score) for r in L.identify(docs, one).collect()] == [("xx", 1.0)]
