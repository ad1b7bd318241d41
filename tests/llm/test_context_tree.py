"""Context-tree scores and the unigram base against brute force over dictionaries."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from lathework.llm import context_tree


@cache
def kt(zeros, ones):
    """Krichevsky and Trofimov's estimate, bit by bit."""
    p, seen = 0.0, [0, 0]
    for bit, n in ((0, zeros), (1, ones)):
        for _ in range(n):
            p += math.log((seen[bit] + 0.5) / (sum(seen) + 1))
            seen[bit] += 1
    return p


class Trees:
    """One context tree for each beginning of a byte's bits, straight from the definition."""

    def __init__(self, texts, depth):
        self.depth = depth
        self.counts = defaultdict(lambda: [0, 0])
        self.children = defaultdict(set)
        for text in texts:
            whole = b"\xff" * depth + text + b"\xff"
            for i in range(depth, len(whole)):
                for start, bit in self.bits(whole[i]):
                    for d in range(depth + 1):
                        context = whole[i - d : i]
                        self.counts[start, context][bit] += 1
                        if d < depth:
                            self.children[start, context].add(whole[i - d - 1 : i])
        self.weighted = cache(self.weighted)

    @staticmethod
    def bits(byte):
        digits = f"{byte:08b}"
        return [(digits[:k], int(digits[k])) for k in range(8)]

    def below(self, start, context):
        return sum(self.weighted(start, c) for c in self.children.get((start, context), ()))

    def weighted(self, start, context):
        own = kt(*self.counts[start, context]) if (start, context) in self.counts else 0.0
        if len(context) == self.depth:
            return own
        return math.log(0.5) + np.logaddexp(own, self.below(start, context))

    def bit(self, start, bit, full, d=0):
        context = full[len(full) - d :]
        zeros, ones = self.counts.get((start, context), (0, 0))
        own = ((zeros, ones)[bit] + 0.5) / (zeros + ones + 1)
        if d == self.depth:
            return own
        odds = math.exp(kt(zeros, ones) - self.below(start, context))
        return (odds * own + self.bit(start, bit, full, d + 1)) / (odds + 1)

    def text(self, text):
        whole = b"\xff" * self.depth + text + b"\xff"
        return sum(
            math.log10(self.bit(start, bit, whole[i - self.depth : i]))
            for i in range(self.depth, len(whole)) for start, bit in self.bits(whole[i])
        )


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)), None]


def brute(rows, depth):
    trees = Trees([(t or "").encode() for _, t, use in rows if use], depth)
    learnt = Counter(w for _, t, use in rows if use for w in tokens(t or ""))
    total, kinds = sum(learnt.values()), len(learnt)
    scored = {t: trees.text((t or "").encode()) for t in {t for _, t, _ in rows}}
    out = []
    for key, text, _ in rows:
        own = tokens(text or "")
        base = sum(math.log10((learnt[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in own)
        out.append((key, len(own), sum(w in learnt for w in own), total, base, scored[text]))
    return out


def same(found, wanted):
    order = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[5], 4))
    found, wanted = sorted(map(tuple, found), key=order), sorted(wanted, key=order)
    assert [r[:4] for r in found] == [r[:4] for r in wanted]
    for a, b in zip(found, wanted):
        assert a[4:] == pytest.approx(b[4:], rel=1e-9, abs=1e-9)


def prose(seed, words):
    draw = random.Random(seed)
    return " ".join(draw.choice(["the", "a", "Old", "mill", "miller", "Čeština", "öl", "x\x1cy", "12"]) + draw.choice(["", "s", "\n"]) for _ in range(words))


ROWS = [
    (None, "null keys stay", False), (None, None, False), (1, None, True), (2, "", True), (3, " \t\n\x0b\x0c\r", True), (4, prose(1, 900), True),
    (5, prose(2, 60), False), (6, prose(3, 200), True), (7, prose(4, 80), True), (7, prose(4, 80), True), (8, "Zebra QUARTZ never learnt", False),
    (9, "you 你好 🙂", True), (10, "a\x00b", None), (11, "aaaa" * 40, True), (12, "The MILL the mill", False),
]
SCHEMA = "doc_id long, text string, learns boolean, block int, bucket string, kind string, word string, grams long, score double"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "b", "k", "w", 2, 0.5) for r in rows], SCHEMA)


@pytest.mark.parametrize(("depth", "block", "piece", "batch", "parts"), [(5, 1 << 20, 1 << 20, 1 << 17, 1), (3, 700, 64, 50, 4), (6, 1, 1000, 1, 3)])
def test_scores(spark, depth, block, piece, batch, parts):
    docs = frame(spark, ROWS).repartition(parts)
    found = context_tree.score(docs, F.col("learns"), depth=depth, block_bytes=block, piece_bytes=piece, batch_grams=batch, bucket_bytes=block)
    assert found.columns == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    same(found.collect(), brute(ROWS, depth))


def test_scores_without_anything_learnt(spark):
    rows = [(1, "abc", False), (2, None, False)]
    same(context_tree.score(frame(spark, rows), F.lit(False)).collect(), [(1, 2, 0, 0, 0.0, 32 * math.log10(0.5)), (2, 1, 0, 0, 0.0, 8 * math.log10(0.5))])
    assert context_tree.score(frame(spark, []), F.lit(True)).count() == 0


def test_bytes_after_a_context_add_up_to_one():
    trees = Trees([prose(5, 80).encode()], 3)
    for context in (b"the", b"\xffol", b"qqq"):
        total = 0.0
        for byte in range(256):
            total += math.exp(sum(math.log(trees.bit(start, bit, context)) for start, bit in Trees.bits(byte)))
        assert total == pytest.approx(1.0)


def test_long_texts_repeat_at_less_cost(spark):
    text = prose(6, 400)
    rows = [(1, text, True), (2, text, False), (3, "".join(random.Random(7).sample(text, len(text))), False)]
    found = {r["doc_id"]: r["score"] for r in context_tree.score(frame(spark, rows), F.col("learns")).collect()}
    assert found[1] == pytest.approx(found[2]) and found[1] > 2 * found[3]


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 7.5, 100.0, 1e6 + 0.5])
    assert context_tree.log_gamma(x, np.log) == pytest.approx([math.lgamma(v) for v in x], rel=1e-11, abs=1e-11)
