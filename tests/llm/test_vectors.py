"""Hard negatives and centroid clustering against brute force in Python's whole numbers."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lathework.llm import centroids, hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, `row` string, name int, score string, `key` double, v string, wanted long"


def rows_of(seed, count, dim, spread=1.0):
    """Random vectors around a few centres, copies among them, in three labels of which one holds most rows."""
    draw = random.Random(seed)
    centres = [[draw.gauss(0, spread) for _ in range(dim)] for _ in range(5)]
    out = []
    for i in range(count):
        v = [float(np.float32(x + draw.gauss(0, spread / 4))) for x in draw.choice(centres)]
        out.append((i, v, draw.choice([0, 0, 0, 1, 2])))
    same = out[3][1]
    return [(i, same if i % 3 == 0 else v, label) for i, v, label in out]


ODD = [
    (None, [1.0] * 8, 1), (1000, None, 1), (1100, [1.0] * 7 + [None], 1), (1200, [1.0] * 7 + [float("nan")], 1),
    (1300, [float("inf")] * 8, 1), (1400, [0.5] * 8, None), (1500, [], 1), (1600, [], 1), (1700, [], 2), (1800, [1.0, 2.0], 1),
    (1900, [1.0, 2.0], 1), (1901, [1.0, 2.0], 2), (2000, [0.0] * 8, 1), (5, [0.25] * 8, 0), (5, [0.25] * 8, 2),
]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "a", 1, "b", 2.0, "c", 3) for r in rows], SCHEMA).repartition(3)


def sound(v, scale):
    return v is not None and all(x is not None and math.isfinite(x * scale) for x in v)


def whole(v, scale):
    return [math.floor(x * scale) for x in v]


def capped(x):
    return max(-(1 << 63), min((1 << 63) - 1, x))


def brute_negatives(rows, scale=256.0):
    kept = [(n, whole(v, scale), lab) for n, v, lab in rows if n is not None and lab is not None and sound(v, scale)]
    out = []
    for i, (name, v, label) in enumerate(kept):
        if name % 100:
            continue
        met = [
            (capped(sum(a * b for a, b in zip(v, w))), other, lab)
            for j, (other, w, lab) in enumerate(kept) if j != i and len(w) == len(v)
        ]
        for p, positive, _ in sorted((x for x in met if x[2] == label), key=lambda x: (-x[0], x[1]))[:5]:
            hard = sorted((x for x in met if x[2] != label and 80 * p <= 100 * x[0] <= 100 * p), key=lambda x: (-x[0], x[1]))
            out += [(name, positive, k, other, p, s) for k, (s, other, _) in enumerate(hard[:5], 1)]
    return sorted(out)


def found_negatives(df):
    return sorted(tuple(r) for r in hard_negatives.mine(df, F.col("vec_id") % 100 == 0, F.col("label")).collect())


@pytest.mark.parametrize("block", [4096, 64])
def test_hard_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    rows = rows_of(1, 450, 8) + ODD
    found = found_negatives(frame(spark, rows))
    assert found == brute_negatives(rows)
    assert len(found) > 20


def test_hard_negatives_beyond_double_precision(spark):
    rows = [(i, v, label) for i, v, label in rows_of(2, 220, 6, 3e7)] + [(700, [1e36] * 6, 0), (701, [1e36] * 6, 0), (702, [9e35] * 6, 1)]
    found = found_negatives(frame(spark, rows))
    assert found == brute_negatives(rows)
    assert any(abs(r[4]) > 1 << 53 for r in found)


def test_hard_negatives_of_nothing(spark):
    assert found_negatives(frame(spark, [])) == []
    assert found_negatives(frame(spark, [(100, [1.0], 1)])) == []


@pytest.mark.parametrize(("low", "high", "dim"), [(-3, 3, 5), (-512, 511, 64), (-(10**6), 10**6, 7), (-(10**12), 10**12, 3), (5, 5, 2)])
def test_packed_scores_are_exact(low, high, dim):
    draw = random.Random(dim)
    candidates = np.array([[draw.randint(low, high) for _ in range(dim)] for _ in range(37)], np.float64)
    anchors = np.array([[draw.randint(low, high) for _ in range(dim)] for _ in range(11)], np.float64)
    packed = hard_negatives.Packed(candidates, low, high)
    exact = [[capped(sum(int(a) * int(b) for a, b in zip(x, y))) for y in candidates] for x in anchors]
    assert packed.scores(anchors).tolist() == exact


def test_small_components_share_a_word():
    assert hard_negatives.Packed(np.array([[-130.0] * 64, [130.0] * 64]), -130, 130).fields == 2
    assert hard_negatives.Packed(np.array([[1e30, -1e30]]), -(10**30), 10**30).fields == 0


def brute_clusters(rows, clusters, rounds, dimension, scale=64.0):
    kept = [(n, v, whole(v, scale)) for n, v, *_ in rows if sound(v, scale) and len(v) == dimension]
    digest = {n: "~" if n is None else hashlib.sha256(f"1:{n}".encode()).hexdigest() for n, _, _ in kept}
    centres = [w for _, _, w in sorted(kept, key=lambda r: (digest[r[0]], r[2]))[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(w, c)), k) for k, c in enumerate(centres)) for _, _, w in kept]

    for _ in range(rounds):
        places = assign()
        for k in range(len(centres)):
            own = [w for (_, _, w), (_, c) in zip(kept, places) if c == k]
            if own:
                centres[k] = [sum(x) // len(own) for x in zip(*own)]
    found = assign()
    sums = [sum(d for d, c in found if c == k) for k in range(len(centres))]
    told = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(
        str((n, c, capped(d), capped(sums[c]), capped(sum(sums)), told[c])) for (n, _, _), (d, c) in zip(kept, found)
    )


@pytest.mark.parametrize(("dim", "spread", "clusters", "block"), [(8, 1.0, 16, 8192), (8, 1.0, 7, 64), (3, 1e4, 5, 64), (4, 1e7, 4, 8192)])
def test_clusters(spark, monkeypatch, dim, spread, clusters, block):
    monkeypatch.setattr(centroids, "BLOCK", block)
    rows = rows_of(3, 400, dim, spread) + ODD + [(7, [0.0] * dim, 1), (7, [0.0] * dim, 1)]
    found = centroids.summary(*centroids.cluster(frame(spark, rows), clusters=clusters, dimension=dim))
    assert found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(str(tuple(r)) for r in found.collect()) == brute_clusters(rows, clusters, 3, dim)


def test_clusters_of_vast_components(spark):
    rows = [(i, [s * 10.0**e, -(10.0**e)], 0) for i, (s, e) in enumerate([(1, 30), (-1, 30), (1, 5), (2, 5), (1, 9), (3, 30)])]
    found = centroids.cluster(frame(spark, rows), clusters=2, dimension=2)[0]
    wanted = brute_clusters([(n, [float(np.float32(x)) for x in v], c) for n, v, c in rows], 2, 3, 2)
    assert sorted(str(tuple(r)) for r in found.collect()) == [w.split(", ")[0] + ", " + ", ".join(w.split(", ")[1:3]) + ")" for w in wanted]


def test_clusters_of_few_rows(spark):
    found, centres = centroids.cluster(frame(spark, []))
    assert centroids.summary(found, centres).collect() == []
    found, centres = centroids.cluster(frame(spark, [(None, [0.5] * 64, 1), (3, [0.5] * 64, 1)]))
    assert len(centres.values) == 2
    assert {(r["vec_id"], r["cluster"], r["distance"]) for r in found.collect()} == {(None, 0, 0), (3, 0, 0)}


def test_a_cluster_without_vectors_stays(spark):
    found, centres = centroids.cluster(frame(spark, [(1, [1.0, 1.0], 0)] * 3), clusters=3, dimension=2)
    assert centres.values == [[64, 64]] * 3
    assert {r["cluster"] for r in found.collect()} == {0}
