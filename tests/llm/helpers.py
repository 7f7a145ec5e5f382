"""Fixtures of the operator tests."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, row string, mark double, chunk string, score int"

_SYLLABLES = ["er", "on", "th", "ing", "re", "an", "ti", "es", "ou", "ha", "ble", "st"]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 4))) for _ in range(n))


def rows(pairs):
    """Rows of (doc_id, text) with columns whose names the operators use themselves."""
    return [(d, t, None, "s", None if t is None else len(t), 7, "x", None, None, 3) for d, t in pairs]


def docs(spark, pairs):
    return spark.createDataFrame(rows(pairs), DOCS)


def odd_pairs():
    """Null ids and texts, empty and blank texts, repeated rows, ties, a long text, no white space."""
    long_text = prose(99, 6000)
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, prose(1, 60)), (7, prose(1, 60)), (7, prose(1, 60)),
        (None, prose(2, 40)), (None, None), (8, long_text), (9, long_text[:9000] + prose(3, 50)), (10, "x" * 5000), (11, "Ünïcode ß 日本語 " * 30),
        (12, prose(1, 60) + " tail"), (13, prose(4, 80)), (14, prose(5, 100) + " " + prose(4, 80)), (15, "the " * 200),
    ]
