"""Fixtures of the training-data tests."""

from __future__ import annotations

import random

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def documents(spark, rows):
    """Rows of (id, text) or (id, text, source) as documents with a column of a clashing kind."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 7, "x") for r in rows]
    return spark.createDataFrame(full, DOCS)


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


def odd_rows():
    """Null, empty, blank and very long texts, a null id, and a repeated row."""
    return [(1, None), (2, ""), (3, "  \n\t "), (4, prose(4, 30_000)), (None, "left alone"), (5, "same row"), (5, "same row"), (6, "é ß 漢字 \U0001f600")]
