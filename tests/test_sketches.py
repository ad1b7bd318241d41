"""Quantile sketches of runs: merged ones against exact ranks, and runs stored again."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lathework.operators import sketches
from lathework.sources import writers

LEVELS = {"p1": 0.01, "median": 0.5, "p99": 0.99}


@pytest.fixture(scope="module")
def values(spark):
    draw = random.Random(8)
    rows = [(run, "a", draw.gauss(0, 1) * 10**run) for run in range(5) for _ in range(6000)]
    rows += [(run, "b", draw.choice([1.0, 2.0, 2.0, 3.0])) for run in range(3) for _ in range(500)]
    rows += [(1, "a", None), (1, "a", float("nan")), (9, "empty", None), (9, None, 4.0)]
    return spark.createDataFrame(rows, "run int, kind string, x double").repartition(6).persist()


def test_merged_quantiles_are_near_the_exact_ones(spark, values, tmp_path):
    daily = sketches.sketch_values(values, ["run", "kind"], "x")
    writers.store_runs(daily, str(tmp_path / "s"), ["run"])
    stored = writers.read_runs(spark, str(tmp_path / "s"), daily)
    merged = {r["kind"]: r for r in sketches.merged_quantiles(stored, ["kind"], LEVELS).collect()}
    exact = np.array([r["x"] for r in values.where("kind = 'a' and x is not null and not isnan(x)").collect()])
    a = merged["a"]
    assert (a["n"], a["least"], a["most"]) == (30000, exact.min(), exact.max()) and a["total"] == pytest.approx(exact.sum())
    for name, p in LEVELS.items():
        assert abs((exact <= a[name]).mean() - p) <= sketches.RANK_ERROR
    assert merged["b"]["median"] == 2.0 and merged[None]["median"] == 4.0
    assert (merged["empty"]["n"], merged["empty"]["median"], merged["empty"]["least"]) == (0, None, None)


def test_rank_errors(spark, values):
    merged = sketches.merged_quantiles(sketches.sketch_values(values, ["kind"], "x"), ["kind"], LEVELS)
    found = {r["kind"]: r for r in sketches.rank_errors(values, ["kind"], "x", merged, LEVELS).collect()}
    assert set(found) == {"a", "b", None}
    assert all(r[name] <= sketches.RANK_ERROR for r in found.values() for name in LEVELS)
    wrong = merged.withColumn("median", merged["p99"])
    assert sketches.rank_errors(values, ["kind"], "x", wrong, LEVELS).where("kind = 'a'").first()["median"] > 0.4


def test_a_run_stored_again_replaces_itself_only(spark, values, tmp_path):
    path = str(tmp_path / "runs")
    daily = sketches.sketch_values(values, ["run", "kind"], "x").drop("sketch")
    writers.store_runs(daily, path, ["run"])
    once = sorted(map(str, writers.read_runs(spark, path, daily).collect()))
    writers.store_runs(daily.where("run = 2"), path, ["run"])
    assert sorted(map(str, writers.read_runs(spark, path, daily).collect())) == once
    writers.store_runs(daily.where("run = 2 and kind = 'b'"), path, ["run"])
    assert writers.read_runs(spark, path, daily).where("run = 2").count() == 1
