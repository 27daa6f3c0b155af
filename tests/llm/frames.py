"""Small tables for the tests."""

from __future__ import annotations

import random


def documents(spark, rows, extra="ids string, spans string, _text string, _key long"):
    """``(doc_id, text)`` rows with extra columns whose names the operators use inside."""
    names = [part.split()[0] for part in extra.split(", ")]
    schema = f"doc_id long, text string, {extra}"
    return spark.createDataFrame([(*r, *[None] * len(names)) for r in rows], schema)


def words(rng: random.Random, n: int, vocabulary: int = 500) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


ODD_TEXTS = [
    None,
    "",
    "   \n\t ",
    "a",
    "one two",
    "It's I'LL don't; a\n\nb  c \n d\tz\xa0e",
    "Éa les ÇÑ ß ﬁ é ΣΑΣ İstanbul 日本語 です。 हिन्दी \U0001f600!!",
    "<|endoftext|>x <|startoftext|>y<|endoftext|>",
    "mississippi banananana hahahahaha " * 3,
    "x" * 5000,
    "long text. " * 3000,
    "\x00\x01 nul",
]
