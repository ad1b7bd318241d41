from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `row` string, `key` int, digest string, score string"
WORDS = "the quick brown fox jumps over a lazy dog while seven wizards brew strong potions near old mills".split()


def prose(seed: int, words: int) -> str:
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) + draw.choice(["", "", "", "s", "ing", "ed"]) for _ in range(words))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty, blank and very long texts, repeated rows, equal texts under other keys."""
    texts = [
        (None, prose(1, 30)), (1, None), (2, ""), (3, "  \n\t "), (4, prose(2, 60_000)), (5, prose(3, 40)), (5, prose(3, 40)),
        (6, prose(3, 40)), (7, "12345 ++ !!"), (8, "Ünïcode ΣΑΣ ́a 你好 🙂 <|endoftext|>"), (None, None), (9, "x" * 30_000),
        (10, "\x00 nul \x1c sep\x85arator"),
    ]
    return [(k, t, "en" if k else None, None, None, "r", i, None, "s") for i, (k, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
