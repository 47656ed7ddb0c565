"""Small tables with every odd case: nulls, empty and long texts, repeated rows, clashing names."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, uid long, word string, node string, size long, at long, n long, spans string, key string"


def odd_docs(spark, texts: list[tuple[int | None, str | None]]):
    """documents with extra columns whose names operators use themselves."""
    rows = [(i, t, "en", "s", None if t is None else len(t), 1, "w", None, None, 3, 5, "x", None) for i, t in texts]
    return spark.createDataFrame(rows, DOCS)


def sentence(rng: random.Random, n: int, vocabulary: int = 3000) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    """Ids and texts: null, empty, blank, short, long, near and exact copies, repeated rows, a null id."""
    rng = random.Random(seed)
    base = sentence(rng, 120)
    words = base.split()
    near = " ".join([*words[:60], "other", *words[61:]])
    far = " ".join(words[:50]) + " " + sentence(rng, 70)
    huge = sentence(rng, 60_000)
    out: list[tuple[int | None, str | None]] = [
        (1, None), (2, ""), (3, " \t\n "), (4, "one two"), (5, "One  TWO"), (6, base), (7, base.upper()), (8, near), (9, far),
        (10, huge), (11, huge + " end"), (12, base), (12, base), (None, near), (None, None), (13, "Ünïcödé ÄÖ   Straße 日本語 テキスト 😀 you"),
        (14, "é" * 5000), (15, " ".join(["same"] * 400)), (16, "<|endoftext|> a<|startoftext|>b don't I'll \x85 x y ¡hola! 1234 3.14"),
    ]
    for k in range(20, 60):
        copy = base.split()
        for _ in range(rng.randrange(6)):
            copy[rng.randrange(len(copy))] = f"x{rng.randrange(50)}"
        out.append((k, " ".join(copy)))
    for k in range(60, 90):
        out.append((k, sentence(rng, rng.randrange(5, 12), 6)))
    return out
