"""Splits, samples, caps, batches and shards with exact counts."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathework.functions.params import checked_shares
from lathework.operators.ordering import (
    bucket_offsets,
    digest_bucket,
    seeded_digest,
    with_row_index,
    with_shuffled_index,
)


def _cut_points(shares: Sequence[float], total: Column) -> list[Column]:
    """Index at which each split but the last ends: every count is cut to an integer, the last takes the rest."""
    cuts, so_far = [], F.lit(0).cast("bigint")
    for share in shares[:-1]:
        so_far = so_far + F.floor(total.cast("double") * F.lit(share))
        cuts.append(so_far)
    return cuts


def _label(names: Sequence[str], cuts: Sequence[Column], index: Column) -> Column:
    label = F.lit(names[-1])
    for name, cut in reversed(list(zip(names, cuts))):
        label = F.when(index < cut, F.lit(name)).otherwise(label)
    return label


def _start(cuts: Sequence[Column], index: Column) -> Column:
    """Index of the first row of the split that ``index`` falls into."""
    starts = [F.lit(0).cast("bigint"), *cuts]
    out = starts[-1]
    for start, cut in reversed(list(zip(starts, cuts))):
        out = F.when(index < cut, start).otherwise(out)
    return out


def ratio_split(
    df: DataFrame,
    key: Sequence[str],
    names: Sequence[str],
    shares: Sequence[float],
    seed: int = 42,
    name: str = "split",
    index: str | None = None,
) -> DataFrame:
    """Label each row with its split after a seeded shuffle; counts are exact, the last split takes the rest.

    Without ``index`` no row moves: each is compared with the rows at the cuts. With ``index`` each row
    also gets its position within its split, which needs the full order.
    """
    if len(names) != len(shares):
        raise ValueError("one share per split name")
    shares = checked_shares(list(shares))
    if index:
        ranked = with_shuffled_index(df, key, seed, name="__i", total="__n")
        cuts = _cut_points(shares, F.col("__n"))
        return (
            ranked.withColumn(name, _label(names, cuts, F.col("__i")))
            .withColumn(index, F.col("__i") - _start(cuts, F.col("__i")))
            .drop("__i", "__n")
        )
    return _label_in_place(df, key, seed, names, lambda total: _cut_points(shares, total), name)


def _label_in_place(
    df: DataFrame,
    key: Sequence[str],
    seed: int,
    names: Sequence[str],
    cuts_of: Callable[[Column], list[Column]],
    name: str,
) -> DataFrame:
    """Label rows by where cuts fall into the digest order, by comparing each row with the rows at the cuts.

    Bucket counts tell which few buckets (at most one per cut) hold a cut; their keys alone are ranked, and what is
    kept of them is one row: digest and key of the row at each cut. No row moves to get its label.
    """
    keys = [F.col(f"`{k}`") for k in key]
    tagged = df.select(seeded_digest(seed, *key).alias("__digest"), *keys).withColumn(
        "__bucket", digest_bucket(F.col("__digest"))
    )
    offsets = bucket_offsets(tagged.select("__bucket"))
    cuts = cuts_of(F.col("__total"))
    holds = functools.reduce(
        lambda x, y: x | y, [(F.col("__offset") <= c) & (c < F.col("__offset") + F.col("__size")) for c in cuts], F.lit(False)
    )
    inside = Window.partitionBy("__bucket").orderBy("__digest", *keys)
    # at most one bucket per cut, hence the broadcast
    ranked = tagged.join(F.broadcast(offsets.where(holds)), "__bucket").withColumn("__rank", F.row_number().over(inside))
    place = F.col("__offset") + F.col("__rank") - 1
    row = F.struct("__digest", *keys)
    edges = [F.max(F.when(place == c, row)).alias(f"e{i}") for i, c in enumerate(cuts)]
    if not edges:
        return df.withColumn(name, F.lit(names[-1]))
    edge = ranked.agg(*edges).select(F.struct("*").alias("edges")).scalar()
    here = F.struct(seeded_digest(seed, *key).alias("__digest"), *keys)
    label = F.lit(names[-1])
    for i in reversed(range(len(cuts))):
        # no row at a cut: it lies behind the last row
        label = F.when(F.coalesce(here < edge.getField(f"e{i}"), F.lit(True)), F.lit(names[i])).otherwise(label)
    return df.withColumn(name, label)


# Fixed value: seed of the automatic validation split.
AUTO_SPLIT_SEED = 1289525893


def auto_split(df: DataFrame, key: Sequence[str], ratio: float = 0.2, seed: int = AUTO_SPLIT_SEED, **kwargs) -> DataFrame:
    """A validation split of ``int(n * ratio)`` rows and a training split of the rest."""
    if not 0 < ratio < 1:
        raise ValueError("ratio must lie between 0 and 1")
    return ratio_split(df, key, ["validation", "train"], [ratio, 1 - ratio], seed, **kwargs)


def percent_split(
    df: DataFrame, key: Sequence[str], percent: float, seed: int = 42, names: Sequence[str] = ("train", "eval"), **kwargs
) -> DataFrame:
    """``int(n * percent / 100)`` rows to the first name, the rest to the second."""
    if not 0 < percent < 100:
        raise ValueError("percent must lie between 0 and 100")
    return ratio_split(df, key, list(names), [percent / 100, 1 - percent / 100], seed, **kwargs)


def sample_exact(df: DataFrame, key: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """``min(n, rows)`` rows without replacement: the first in digest order, kept in the partitions they are in."""
    cut = F.lit(n).cast("bigint")
    labelled = _label_in_place(df, key, seed, ["in", "out"], lambda total: [cut], "__sample")
    return labelled.where(F.col("__sample") == "in").drop("__sample")


def sample_values(df: DataFrame, column: str, n: int, order_by: str, seed: int = 42) -> DataFrame:
    """``n`` of the distinct values of a column, each with the first row that has it."""
    values = df.select(column).distinct()
    picked = sample_exact(values, [column], n, seed)
    rest = [c for c in df.columns if c != column]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    return (
        df.join(picked, column, "left_semi")
        .groupBy(column)
        .agg(F.min_by(row, F.col(order_by)).alias("__row"))
        .select(column, "__row.*")
    )


def cap_rows(df: DataFrame, order_by: Sequence[str], n: int, within: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows in a stated order, over the table or per group.

    Over the table an index over the order columns alone gives the first row that is left out, and rows before it are kept in
    the partitions they are in. ``order_by`` must identify a row.
    """
    if within:
        return with_row_index(df, order_by, within, "__i").where(F.col("__i") < n).drop("__i")
    order = [F.col(f"`{c}`") for c in order_by]
    named = [c.alias(f"o{i}") for i, c in enumerate(order)]
    indexed = with_row_index(df.select(*named), [f"o{i}" for i in range(len(order))], name="__i")
    row = F.struct(*[f"o{i}" for i in range(len(order))])
    edge = indexed.where(F.col("__i") == n).agg(F.max(row).alias("edge")).scalar()
    return df.where(F.coalesce(F.struct(*named) < edge, F.lit(True)))


def with_batches(df: DataFrame, index: str, size: int, name: str = "batch_id") -> DataFrame:
    """Consecutive batches of ``size`` rows; the last may be shorter."""
    if size < 1:
        raise ValueError("size must be at least one")
    return df.withColumn(name, F.floor(F.col(index) / size))


def require_full_batches(df: DataFrame, index: str, size: int) -> DataFrame:
    """The table, unless its last batch would be short: then the query fails."""
    short = df.agg((F.count(F.lit(1)) % size).alias("rest")).scalar()
    return df.where(
        F.when(short == 0, F.lit(True)).otherwise(F.raise_error(F.lit("the last batch is incomplete")).cast("boolean"))
    )


def even_shards(
    df: DataFrame, key: Sequence[str], replicas: int, seed: int = 0, shuffle_key: bool = True, pad: str = "head"
) -> DataFrame:
    """Strided shards; adds ``shard``, ``position`` within the shard and ``is_pad``.

    ``pad`` says what fills the last round: ``head`` the first rows (repeated as often as needed), ``random`` the first rows too, but seeded random rows if
    there are at least as many places to fill as rows, ``none`` nothing, so that shards differ by a row at most. Pads are fewer than ``replicas``, and only their places
    are dealt out anew; all other rows stay where the index leaves them. An empty table has no shards' rows.
    """
    if pad not in ("head", "random", "none"):
        raise ValueError(f"unknown padding {pad}")
    if shuffle_key:
        indexed = with_shuffled_index(df, key, seed, name="__i", total="__n")
    else:
        indexed = with_row_index(df, key, name="__i")
        indexed = indexed.withColumn("__n", df.agg(F.count(F.lit(1)).alias("n")).scalar())
    missing = F.ceil(F.col("__n") / replicas) * replicas - F.col("__n")
    if pad == "head":
        # copy c of row i sits at i + c * n; a row of the head has one for each that still fits
        copies = F.floor((missing + F.col("__n") - 1 - F.col("__i")) / F.col("__n"))
        spread = indexed.withColumn("__c", F.explode(F.sequence(F.lit(0).cast("bigint"), copies)))
        places = spread.withColumns({"__place": F.col("__i") + F.col("__c") * F.col("__n"), "is_pad": F.col("__c") > 0}).drop("__c")
    else:
        places = indexed.withColumns({"__place": F.col("__i"), "is_pad": F.lit(False)})
    if pad == "random":
        # fewer than `replicas` places, each with the row it takes
        rows = df.agg(F.count(F.lit(1)).alias("__n"))
        gaps = rows.where("__n > 0").select("__n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(replicas - 1))).alias("__g")).where(F.col("__g") < missing)
        gaps = gaps.withColumn("__place", F.col("__n") + F.col("__g"))
        drawn = F.conv(F.substring(seeded_digest(seed, "__place"), 1, 13), 16, 10).cast("bigint") % F.col("__n")
        gaps = gaps.select("__place", F.when(missing < F.col("__n"), F.col("__g")).otherwise(drawn).alias("__i"))
        pads = indexed.join(F.broadcast(gaps), "__i").withColumn("is_pad", F.lit(True))
        places = places.unionByName(pads.select(*places.columns))
    return (
        places.withColumn("shard", F.col("__place") % replicas)
        .withColumn("position", F.floor(F.col("__place") / replicas))
        .select(*[f"`{c}`" for c in df.columns], "shard", "position", "is_pad")
    )


def shard_sizes(shards: DataFrame) -> DataFrame:
    """Rows and valid (unpadded) rows of each shard."""
    return shards.groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("is_pad")).alias("valid_rows")
    )
