from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from lathework.operators import mixing, splits


@pytest.mark.parametrize("n", [1, 10, 999])
def test_split_counts_are_exact(spark, n):
    df = spark.range(n)
    out = splits.ratio_split(df, ["id"], ["a", "b", "c"], [0.7, 0.2, 0.1], seed=1).collect()
    counts = Counter(r["split"] for r in out)
    assert len({r["id"] for r in out}) == len(out) == n
    assert (counts["a"], counts["b"]) == (int(n * 0.7), int(n * 0.2))


def test_both_split_paths_agree_under_any_partitioning(spark):
    plain = splits.ratio_split(spark.range(500), ["id"], ["a", "b"], [0.5, 0.5], seed=9)
    indexed = splits.ratio_split(spark.range(500).repartition(7), ["id"], ["a", "b"], [0.5, 0.5], seed=9, index="i")
    assert {(r["id"], r["split"]) for r in plain.collect()} == {(r["id"], r["split"]) for r in indexed.collect()}
    for name in ("a", "b"):
        assert sorted(r["i"] for r in indexed.where(F.col("split") == name).collect()) == list(range(250))


def test_split_arguments(spark):
    with pytest.raises(ValueError):
        splits.ratio_split(spark.range(3), ["id"], ["a"], [0.5, 0.5])
    with pytest.raises(ValueError):
        splits.percent_split(spark.range(3), ["id"], 100)
    with pytest.raises(ValueError):
        splits.auto_split(spark.range(3), ["id"], 0)


def test_samples(spark):
    df = spark.range(100).repartition(5)
    once = {r["id"] for r in splits.sample_exact(df, ["id"], 10).collect()}
    again = {r["id"] for r in splits.sample_exact(spark.range(100), ["id"], 10).collect()}
    assert once == again and len(once) == 10
    assert splits.sample_exact(df, ["id"], 1000).count() == 100


def test_samples_and_caps_do_not_hang_on_the_partitions(spark):
    df = spark.range(300)
    for n in (1, 120):
        samples = [{r["id"] for r in splits.sample_exact(df.repartition(k), ["id"], n).collect()} for k in (1, 7)]
        assert samples[0] == samples[1] and len(samples[0]) == n
    assert {r["id"] for r in splits.cap_rows(df.repartition(3), ["id"], 70).collect()} == set(range(70))


def test_batches(spark):
    df = spark.range(10)
    sizes = Counter(r["batch_id"] for r in splits.with_batches(df, "id", 3).collect())
    assert sizes == {0: 3, 1: 3, 2: 3, 3: 1}
    assert set(Counter(r["batch_id"] for r in splits.with_batches(df, "id", 15).collect())) == {0}
    with pytest.raises(ValueError):
        splits.with_batches(df, "id", 0)
    assert splits.require_full_batches(df, "id", 5).count() == 10
    with pytest.raises(Exception, match="incomplete"):
        splits.require_full_batches(df, "id", 3).collect()


@pytest.mark.parametrize("n,replicas", [(10, 4), (12, 4), (3, 8), (1, 5)])
@pytest.mark.parametrize("shuffle", [True, False])
def test_shards_are_even(spark, n, replicas, shuffle):
    shards = splits.even_shards(spark.range(n), ["id"], replicas, shuffle_key=shuffle)
    out = shards.collect()
    assert sum(r["valid_rows"] for r in splits.shard_sizes(shards).collect()) == n
    sizes = Counter(r["shard"] for r in out)
    assert len(sizes) == replicas and len(set(sizes.values())) == 1
    real = [r["id"] for r in out if not r["is_pad"]]
    assert sorted(real) == list(range(n))
    assert len({(r["shard"], r["position"]) for r in out}) == len(out)


def test_mix_covers_every_row_and_stops_at_once(spark):
    data = [(i, "big" if i < 60 else "small") for i in range(75)]
    df = spark.createDataFrame(data, "id int, d string")
    out = mixing.weighted_mix(df, "d", ["id"], {"big": 0.7, "small": 0.3}, seed=3, block_rows=16)
    rows = sorted(out.collect(), key=lambda r: r["t"])
    assert [r["t"] for r in rows] == list(range(len(rows)))
    assert {r["id"] for r in rows} == set(range(75))
    # the last draw is the one that completes the cover
    assert rows[-1]["id"] not in {r["id"] for r in rows[:-1]}
    for name, n in (("big", 60), ("small", 15)):
        drawn = [r["id"] for r in rows if r["d"] == name]
        assert drawn[:n] == drawn[n : 2 * n][:n] + drawn[:n][len(drawn[n : 2 * n]) :]
    with pytest.raises(ValueError):
        mixing.weighted_mix(df, "d", ["id"], {"big": 0.7, "small": 0.3}, seed=3, max_rows=10)


def test_mix_with_an_absent_dataset(spark):
    df = spark.createDataFrame([(i, "a") for i in range(5)], "id int, d string")
    out = mixing.weighted_mix(df, "d", ["id"], {"a": 0.5, "b": 0.5})
    assert {r["id"] for r in out.collect()} == set(range(5))


def test_packs_hold_whole_sequences(spark):
    data = [(i, (i * 37) % 50) for i in range(400)] + [(1000, 500)]
    df = spark.createDataFrame(data, "id int, n int")
    packed = mixing.pack_sequences(df, "id", "n", 100, rows_per_bucket=64)
    rows = packed.collect()
    assert sorted(r["id"] for r in rows) == sorted(i for i, _ in data)
    loads = Counter()
    for r in rows:
        loads[r["bucket"], r["pack"]] += r["n"]
    over = [load for load in loads.values() if load > 100]
    assert over == [500]
    padding = mixing.pack_padding(packed, "n", 100).collect()
    assert {(r["tokens"] + r["padding"]) for r in padding} <= {100, 500}


def test_concat_fills_missing_columns(spark):
    out = mixing.concat(spark.range(2), spark.range(2).withColumn("x", F.lit(1))).collect()
    assert sorted((r["id"], r["x"]) for r in out if r["x"]) == [(0, 1), (1, 1)] and len(out) == 4


def test_caps_and_samples_stay_in_their_partitions(spark):
    df = spark.range(0, 1000, 1, 16).withColumnRenamed("id", "k")
    for n in (0, 1, 400, 5000):
        assert sorted(r["k"] for r in splits.cap_rows(df, ["k"], n).collect()) == list(range(min(n, 1000)))
        sample = splits.sample_exact(df, ["k"], n, 7)
        assert sample.count() == min(n, 1000)
    assert splits.cap_rows(df, ["k"], 400).rdd.getNumPartitions() == 16
    assert splits.sample_exact(df, ["k"], 400).rdd.getNumPartitions() == 16


@pytest.mark.parametrize("n,replicas", [(1, 4), (2, 7), (10, 4), (9, 3), (0, 3)])
def test_shards_padded_at_random_or_not_at_all(spark, n, replicas):
    df = spark.range(n).withColumnRenamed("id", "k")
    padded = splits.even_shards(df, ["k"], replicas, pad="random").collect()
    total = -(-n // replicas) * replicas
    assert sorted((r["shard"], r["position"]) for r in padded) == [(i % replicas, i // replicas) for i in sorted(range(total), key=lambda i: (i % replicas, i))]
    assert sorted(r["k"] for r in padded if not r["is_pad"]) == list(range(n)) and {r["k"] for r in padded} == set(range(n))
    if 0 < total - n < n:
        head = splits.even_shards(df, ["k"], replicas, pad="head")
        assert sorted(map(tuple, padded)) == sorted(map(tuple, head.collect()))
    plain = splits.even_shards(df, ["k"], replicas, pad="none")
    assert plain.count() == n and plain.where("is_pad").count() == 0
    sizes = [r["rows"] for r in splits.shard_sizes(plain).collect()]
    assert not sizes or max(sizes) - min(sizes) <= 1
