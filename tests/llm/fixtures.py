"""Small awkward tables: nulls, empty and long texts, repeated rows and ids, columns with clashing names."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(seed: int = 1, size: int = 40) -> list[tuple]:
    """Documents with exact copies, near copies, shared passages, and the awkward ones."""
    rng = random.Random(seed)
    passage = words(rng, 60)
    texts = [words(rng, rng.randrange(1, 150)) for _ in range(size)]
    for i in range(0, size, 5):
        texts.append(f"{words(rng, 12)} {passage} {words(rng, 9)}")
        texts.append(texts[i])
        cut = texts[i].split()
        cut[len(cut) // 2] = "changed"
        texts.append(" ".join(cut))
    texts += ["", None, " \n\t ", "a", "a " * 500, words(rng, 20_000), "É ß 日本語   x"]
    rows = [(i, t, ["en", "de", None][i % 3], ["s0", "s0", "s1", None][i % 4], len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, texts[4], "en", "s0", 1), (None, None, None, None, None)]


def frame(spark, rows, schema: str = DOCS):
    return spark.createDataFrame(rows, schema)
