"""Indexes, neighbours, running values and quantiles, with a hot key and several partitionings."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lathework.operators import ordering as O


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    # a third of the rows share one key
    return [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(40)}", float(rng.randrange(50))) for i in range(3000)]


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_row_index_is_contiguous_whatever_the_partitions(spark, rows, parts):
    df = spark.createDataFrame(rows, "id int, k string, v double").repartition(parts)
    out = O.with_row_index(df, ["v", "id"]).collect()
    assert [r["id"] for r in sorted(out, key=lambda r: r["row_index"])] == [r[0] for r in sorted(rows, key=lambda r: (r[2], r[0]))]
    assert sorted(r["row_index"] for r in out) == list(range(len(rows)))


def test_row_index_within_groups_with_nulls(spark):
    data = [(i, None if i % 3 == 0 else i % 2) for i in range(50)]
    df = spark.createDataFrame(data, "id int, g int")
    out = O.with_row_index(df, ["id"], within=["g"]).collect()
    assert len(out) == 50
    for g in (None, 0, 1):
        mine = sorted((r["row_index"], r["id"]) for r in out if r["g"] == g)
        assert [i for i, _ in mine] == list(range(len(mine)))
        assert [x for _, x in mine] == sorted(x for x, h in data if h == g)


@pytest.mark.parametrize("parts", [1, 7])
def test_shuffled_index(spark, rows, parts):
    df = spark.createDataFrame(rows, "id int, k string, v double").repartition(parts)
    out = O.with_shuffled_index(df, ["id"], 42, total="n").collect()
    assert sorted(r["row_index"] for r in out) == list(range(len(rows)))
    assert {r["n"] for r in out} == {len(rows)}
    import hashlib

    order = sorted((hashlib.md5(f"42:{r[0]}".encode()).hexdigest(), r[0]) for r in rows)
    assert [r["id"] for r in sorted(out, key=lambda r: r["row_index"])] == [i for _, i in order]


def test_neighbours_cross_blocks_but_not_groups(spark, rows):
    df = O.with_row_index(spark.createDataFrame(rows, "id int, k string, v double"), ["k", "id"], name="i")
    out = O.shift_columns(df, "i", {"last": ("id", 1), "next2": ("id", -2)}, within=["k"], block_rows=10).collect()
    assert len(out) == len(rows)
    groups: dict[str, list[int]] = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        groups.setdefault(r[1], []).append(r[0])
    for r in out:
        mine = groups[r["k"]]
        at = mine.index(r["id"])
        assert r["last"] == (mine[at - 1] if at else None)
        assert r["next2"] == (mine[at + 2] if at + 2 < len(mine) else None)


def test_running_sums_and_maxima(spark):
    data = [(i, (i * 7) % 5, i % 11 == 3) for i in range(200)]
    df = spark.createDataFrame(data, "i int, v int, mark boolean")
    out = O.running(df, "i", {"s": F.col("v")}, {"m": F.when(F.col("mark"), F.col("i"))}, block_rows=9)
    total, last = 0, None
    for r in sorted(out.collect(), key=lambda r: r["i"]):
        total += r["v"]
        last = r["i"] if r["mark"] else last
        assert (r["s"], r["m"]) == (total, last)


def test_quantiles_equal_numpy_for_hot_values_and_nan(spark):
    rng = random.Random(3)
    data = [(i, "a" if i % 3 else "b", 7.0 if i % 3 == 1 else rng.random()) for i in range(999)]
    data += [(1000, "a", float("nan")), (1001, "a", None), (1002, "c", 4.0)]
    df = spark.createDataFrame(data, "id int, g string, v double")
    levels = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p99": 0.99, "p100": 1.0}
    out = {r["g"]: r for r in O.quantiles(df, ["g"], "v", levels, ["id"]).collect()}
    assert set(out) == {"a", "b", "c"}
    for g, r in out.items():
        values = [v for _, h, v in data if h == g and v is not None and v == v]
        for name, p in levels.items():
            assert r[name] == pytest.approx(np.quantile(values, p), abs=1e-12)


def test_keep_first_and_last(spark, rows):
    df = spark.createDataFrame(rows, "id int, k string, v double").repartition(13)
    first = {r["k"]: r["id"] for r in O.keep_first(df, "k", ["id"]).collect()}
    last = {r["k"]: r["id"] for r in O.keep_last(df, ["k"], ["id"]).collect()}
    for k in first:
        ids = [r[0] for r in rows if r[1] == k]
        assert (first[k], last[k]) == (min(ids), max(ids))
    assert len(first) == len({r[1] for r in rows})


def test_scratch_needs_a_shared_folder_on_a_cluster():
    from lathework import session

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master, applicationId = "spark://host:7077", "app"

    class Fake:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        session.scratch_root(Fake())
