"""Concatenate, weight and pack datasets."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathework.operators.ordering import BLOCK_ROWS, draw_below, seeded_digest, with_row_index
from lathework.session import materialize


def concat(*tables: DataFrame) -> DataFrame:
    """All rows of all tables; a column missing from one is NULL there."""
    plain = [table.select("*") for table in tables]
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), plain)


# Fixed value: seed of the weighted mix.
MIX_SEED = 19851243


def _picks(spark: SparkSession, n: int, weights: Mapping[str, float], seed: int, block_rows: int) -> DataFrame:
    """``n`` draws ``t``, the dataset each picks, and the block of draws it lies in."""
    total = sum(weights.values())
    edges, so_far = [], 0.0
    for dataset, weight in weights.items():
        so_far += weight / total
        edges.append((dataset, so_far))
    pick: Column = F.lit(edges[-1][0])
    for dataset, edge in reversed(edges[:-1]):
        pick = F.when(draw_below(F.col("__digest"), edge), F.lit(dataset)).otherwise(pick)
    return (
        spark.range(n)
        .withColumnRenamed("id", "t")
        .withColumn("__digest", seeded_digest(seed, "t"))
        .select("t", pick.alias("dataset"), F.floor(F.col("t") / block_rows).alias("__block"))
    )


def _block_offsets(picks: DataFrame) -> DataFrame:
    """Draws of each dataset in a block and in the blocks before it."""
    earlier = Window.partitionBy("dataset").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    counts = picks.groupBy("dataset", "__block").agg(F.count(F.lit(1)).alias("__n"))
    return counts.withColumn("__offset", F.coalesce(F.sum("__n").over(earlier), F.lit(0)))


def _numbered(picks: DataFrame, offsets: DataFrame) -> DataFrame:
    """Adds ``draw``, the running number within the dataset; a window holds one dataset's draws of one block."""
    inside = Window.partitionBy("__block", "dataset").orderBy("t")
    return (
        picks.withColumn("__rank", F.row_number().over(inside))
        .join(offsets.drop("__n"), ["dataset", "__block"])
        .select("t", "dataset", (F.col("__offset") + F.col("__rank") - 1).alias("draw"))
    )


def weighted_mix(
    df: DataFrame,
    dataset: str,
    order_by: Sequence[str],
    weights: Mapping[str, float],
    seed: int = MIX_SEED,
    max_rows: int | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Interleave datasets by weight until every row of each has been drawn; exhausted ones start again.

    A tiny weight makes the result many times the input; ``max_rows`` then refuses the mix rather than
    cutting it short. Adds ``t`` (place in the mix) and ``draw`` (running number within the dataset).
    """
    spark = df.sparkSession
    rows = with_row_index(df.where(F.col(dataset).isin(list(weights))), order_by, [dataset], "__i")
    sizes = {r[dataset]: r["n"] for r in rows.groupBy(dataset).agg(F.count(F.lit(1)).alias("n")).collect()}
    live = {name: weight for name, weight in weights.items() if sizes.get(name)}
    if not live:
        return rows.withColumnRenamed("__i", "draw").withColumn("t", F.lit(None).cast("bigint"))
    scale = sum(live.values())
    n = int(1.2 * max(sizes[name] * scale / weight for name, weight in live.items())) + 100
    size = F.create_map(*[F.lit(x) for name in live for x in (name, sizes[name])])[F.col("dataset")]
    while True:
        # the block counts alone tell where each dataset completes; only those blocks are numbered
        picks = _picks(spark, n, live, seed, block_rows)
        offsets = _block_offsets(picks)
        last = offsets.where((F.col("__offset") < size) & (F.col("__offset") + F.col("__n") >= size))
        last = last.select("dataset", "__block", "__offset").collect()  # one row per dataset at most
        if len(last) == len(live):
            break
        n *= 2
    ends = functools.reduce(
        lambda a, b: a | b, [(F.col("__block") == r["__block"]) & (F.col("dataset") == r["dataset"]) for r in last]
    )
    completing = _numbered(picks.where(ends), offsets.where(ends)).where(F.col("draw") == size - 1)
    length = completing.agg(F.max("t").alias("t")).first()["t"] + 1
    if max_rows is not None and length > max_rows:
        raise ValueError(f"the mix has {length} rows, more than the {max_rows} allowed")
    picks = _picks(spark, length, live, seed, block_rows)
    picks = _numbered(picks, _block_offsets(picks)).withColumn("__i", F.col("draw") % size)
    return picks.join(rows, (picks["dataset"] == rows[dataset]) & (picks["__i"] == rows["__i"])).select(
        picks["t"], picks["draw"], *[rows[f"`{c}`"] for c in df.columns]
    )


def pack_sequences(
    df: DataFrame, key: str, length: str, capacity: int, rows_per_bucket: int = 4096, seed: int = 0
) -> DataFrame:
    """Give each sequence a pack so that no pack exceeds ``capacity`` (an over-long sequence is alone in one).

    Filling packs is sequential, so rows are first spread over even digest buckets, whose number grows
    with the table; each bucket of about ``rows_per_bucket`` rows is filled in key order on its own. Only the
    key and the length go through Python. Adds ``bucket``, ``pack`` and ``offset``; how full a pack is, is left to
    :func:`pack_padding`.
    """
    count = df.count()
    buckets = max(1, -(-count // rows_per_bucket))
    bucket = F.conv(F.substring(seeded_digest(seed, key), 1, 13), 16, 10).cast("bigint") % buckets
    slim = df.select(bucket.alias("bucket"), F.col(key), F.col(length).cast("bigint").alias(length))
    schema = T.StructType(
        [*slim.schema.fields, T.StructField("pack", T.LongType()), T.StructField("offset", T.LongType())]
    )

    def fill(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(key, kind="stable").reset_index(drop=True)
        packs, offsets, pack, used = [], [], 0, 0
        for size in group[length].tolist():
            if used and used + size > capacity:
                pack, used = pack + 1, 0
            packs.append(pack)
            offsets.append(used)
            used += size
        return group.assign(pack=packs, offset=offsets)

    return slim.groupBy("bucket").applyInPandas(fill, schema)


def pack_padding(packed: DataFrame, length: str, capacity: int) -> DataFrame:
    """Per pack: how many sequences and tokens it holds and how much padding fills it."""
    return packed.groupBy("bucket", "pack").agg(
        F.count(F.lit(1)).alias("sequences"),
        F.sum(length).alias("tokens"),
        F.greatest(F.lit(capacity) - F.sum(length), F.lit(0)).alias("padding"),
    )


def freeze(df: DataFrame) -> DataFrame:
    """Fix a mix or a packing as a written table before several readers use it."""
    return materialize(df, "mix")
