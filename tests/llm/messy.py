"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing column names."""

from __future__ import annotations

import random

CLASHING = "score string, n long, size long, grams string, class string, rank int, place int, path string, x int"


def documents(spark, texts, sources=None, ids=None, langs=None):
    n = len(texts)
    ids = list(range(n)) if ids is None else ids
    sources, langs = sources or ["s"] * n, langs or ["en"] * n
    rows = [(i, t, g, s, None if t is None else len(t), "-", 7, 7, "-", "-", 7, 7, "-", 7) for i, t, g, s in zip(ids, texts, langs, sources)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")


def words(rng: random.Random, n: int, vocabulary: int) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def messy_texts(rng: random.Random) -> list:
    """Plain, near-copied, null, empty, tiny and long texts."""
    base = [words(rng, rng.randrange(20, 80), 400) for _ in range(25)]
    near = []
    for k in range(40):
        own = base[k % 6].split(" ")
        own[rng.randrange(len(own))] = "changed"
        near.append(" ".join(own))
    return [*base, *near, base[0], base[0].upper(), None, "", "  ", "one", "one", "one two three", "ONE\ttwo\nthree", "é ß 你好", words(rng, 6000, 50)]
