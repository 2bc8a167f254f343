"""What the corpus operators' tests share: texts made from a seed, and small tables."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"

_SYLLABLES = ["ka", "lo", "mi", "ten", "sor", "va", "ril", "po", "dun", "shi", "ber", "an", "qua", "fe", "nol", "zet"]


def vocabulary(seed: int, n: int = 400) -> list[str]:
    rng = random.Random(seed)
    return sorted({"".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(2, 4))) for _ in range(2 * n)})[:n]


def prose(seed: int, n: int, words: list[str] | None = None) -> str:
    rng = random.Random(seed)
    words = words or vocabulary(1)
    return " ".join(rng.choice(words) for _ in range(n))


def edited(text: str, seed: int, share: float = 0.02) -> str:
    """The text with a share of its words replaced, one at least."""
    rng = random.Random(seed)
    tokens = text.split(" ")
    for at in rng.sample(range(len(tokens)), max(1, int(share * len(tokens)))):
        tokens[at] = "x" + rng.choice(_SYLLABLES) + str(seed)
    return " ".join(tokens)


def documents(spark, texts, lang="en", source="web"):
    """A table of documents numbered from 1."""
    rows = [(i, t, lang, source, None if t is None else len(t)) for i, t in enumerate(texts, 1)]
    return spark.createDataFrame(rows, DOCS)


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
