"""Row order at scale: contiguous indexes, neighbours, running values, exact quantiles, keep-first.

No operator here puts one key, or the whole table, into a single task. Orders are built by range
partitioning on a unique key; what crosses partitions is one summary row per partition or block.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lathework.session import materialize

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row number of a partition in the low 33 bits
_BUCKET_DIGITS = 4  # hex digits of the digest that name a shuffle bucket: at most 65,536 buckets
BLOCK_ROWS = 1 << 16


def with_row_index(
    df: DataFrame,
    order_by: Sequence[str | Column],
    within: Sequence[str] = (),
    name: str = "row_index",
    seen: Observation | None = None,
) -> DataFrame:
    """Add a contiguous 0-based index in the given order, restarted per ``within`` group.

    ``seen`` is told the number of ``rows`` by the pass that writes them.

    ``order_by`` must identify a row. One range shuffle, one written table, then a broadcast of one
    start offset per range partition. Groups that span partitions need no special care: their index is
    the global index less the smallest one of the group.
    """
    keys = [F.col(f"`{k}`") for k in within] + [F.col(c) if isinstance(c, str) else c for c in order_by]
    ranged = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("__mid", F.monotonically_increasing_id())
    )
    if seen is not None:
        # after the shuffle: the sampling of its edges reads the rows as well
        ranged = ranged.observe(seen, F.count(F.lit(1)).alias("rows"))
    stored = materialize(ranged, "row-index")
    stored = stored.withColumn("__part", F.shiftright("__mid", _LOCAL_BITS)).withColumn(
        "__pos", F.col("__mid").bitwiseAND((1 << _LOCAL_BITS) - 1)
    )
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.groupBy("__part")
        .agg(F.count(F.lit(1)).alias("__n"))
        .select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__offset"))
    )
    # one row per range partition, hence the broadcast
    indexed = stored.join(F.broadcast(offsets), "__part").withColumn(
        name, F.col("__offset") + F.col("__pos")
    )
    indexed = indexed.drop("__mid", "__part", "__pos", "__offset")
    if within:
        starts = indexed.groupBy(*[F.col(f"`{k}`") for k in within]).agg(F.min(name).alias("__start"))
        starts = starts.select(*[F.col(f"`{k}`").alias(f"__g{i}") for i, k in enumerate(within)], "__start")
        same = functools.reduce(
            lambda a, b: a & b,
            [indexed[f"`{k}`"].eqNullSafe(starts[f"__g{i}"]) for i, k in enumerate(within)],
        )
        indexed = (
            indexed.join(starts, same)
            .withColumn(name, F.col(name) - F.col("__start"))
            .drop("__start", *[f"__g{i}" for i in range(len(within))])
        )
    return indexed


def ordered_blocks(df: DataFrame, order_by: Sequence[str | Column], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The rows in the given order as blocks: adds ``__block``, which ascends with the order, and ``__pos`` within its range partition.

    ``order_by`` must identify a row. One range shuffle and one written table; no block has more than ``block_rows`` rows. Enough for scans
    that carry a summary from block to block and need no contiguous index.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order_by]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__mid", F.monotonically_increasing_id())
    stored = materialize(ranged, "ordered")
    pos = F.col("__mid").bitwiseAND((1 << _LOCAL_BITS) - 1)
    block = F.col("__mid") - pos + F.floor(pos / block_rows)
    return stored.withColumns({"__block": block, "__pos": pos}).drop("__mid")


def seeded_digest(seed: int | str, *key: str) -> Column:
    """``md5("seed:key")``: a uniform order that any engine can reproduce."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(f"`{k}`").cast("string") for k in key]))


def digest_bucket(digest: Column) -> Column:
    """The leading hex digits; their text order is the digest order."""
    return F.substring(digest, 1, _BUCKET_DIGITS)


def draw_below(digest: Column, edge: float) -> Column:
    """True if the first 13 hex digits, read as a number in [0, 1), are below ``edge``.

    The edge is turned into hex digits instead, so each row compares two short texts.
    """
    limit = math.ceil(edge * 16**13)
    if limit >= 16**13:
        return F.lit(True)
    return F.substring(digest, 1, 13) < F.lit(f"{limit:013x}")


def bucket_offsets(df: DataFrame) -> DataFrame:
    """Rows before each bucket of column ``__bucket``, its size, and the total: at most 65,536 rows."""
    earlier = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    return (
        df.groupBy("__bucket")
        .agg(F.count(F.lit(1)).alias("__size"))
        .select(
            "__bucket",
            "__size",
            F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__offset"),
            F.sum("__size").over(whole).alias("__total"),
        )
    )


def with_shuffled_index(
    df: DataFrame, key: Sequence[str], seed: int | str, name: str = "row_index", total: str | None = None
) -> DataFrame:
    """Contiguous index in the seeded digest order of a unique key.

    Digests are uniform, so their leading digits split the order into even buckets without sampling
    and without a written table. The bucket is a function of the row alone, so reruns agree.
    """
    tagged = df.withColumn("__digest", seeded_digest(seed, *key)).withColumn(
        "__bucket", digest_bucket(F.col("__digest"))
    )
    offsets = bucket_offsets(tagged.select("__bucket"))
    inside = Window.partitionBy("__bucket").orderBy("__digest", *[F.col(f"`{k}`") for k in key])
    # at most 65,536 rows, hence the broadcast
    ranked = tagged.withColumn("__rank", F.row_number().over(inside)).join(F.broadcast(offsets), "__bucket")
    ranked = ranked.withColumn(name, F.col("__offset") + F.col("__rank") - 1)
    if total:
        ranked = ranked.withColumn(total, F.col("__total"))
    return ranked.drop("__digest", "__bucket", "__size", "__offset", "__total", "__rank")


def shift_columns(
    df: DataFrame,
    index: str,
    shifts: Mapping[str, tuple[str, int]],
    within: Sequence[str] = (),
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add ``new: (column, distance)`` values taken from the row ``distance`` places away.

    Positive looks back, negative ahead. ``index`` is a contiguous global index, so it cuts the table
    into blocks of equal size whatever the keys are; the rows near a block edge are copied into the
    next block. A neighbour from another ``within`` group gives NULL.
    """
    reach = max(abs(distance) for _, distance in shifts.values())
    if reach >= block_rows:
        raise ValueError("distance exceeds the block size")
    own = F.floor(F.col(index) / block_rows)
    place = F.col(index) % block_rows
    targets = F.array_compact(
        F.array(
            own,
            F.when(place >= block_rows - reach, own + 1),
            F.when(place < reach, own - 1),
        )
    )
    spread = df.withColumn("__own", own).withColumn("__block", F.explode(targets))
    order = Window.partitionBy("__block").orderBy(index)
    for new, (column, distance) in shifts.items():
        at = F.lag if distance > 0 else F.lead
        value = at(F.col(column), abs(distance)).over(order)
        for key in within:
            neighbour = at(F.col(key), abs(distance)).over(order)
            value = F.when(neighbour.eqNullSafe(F.col(key)), value)
        spread = spread.withColumn(new, value)
    return spread.where(F.col("__block") == F.col("__own")).drop("__block", "__own")


def running(
    df: DataFrame,
    index: str,
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Running sums and maxima over a contiguous global index, the current row included.

    Blocks are summarised first; the summary (one row per block) carries the earlier blocks' totals.
    """
    sums, maxima = dict(sums or {}), dict(maxima or {})
    blocked = df.withColumn("__block", F.floor(F.col(index) / block_rows))
    totals = [F.sum(value).alias(f"__t_{new}") for new, value in sums.items()] + [
        F.max(value).alias(f"__t_{new}") for new, value in maxima.items()
    ]
    earlier = Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = [F.sum(f"__t_{new}").over(earlier).alias(f"__c_{new}") for new in sums] + [
        F.max(f"__t_{new}").over(earlier).alias(f"__c_{new}") for new in maxima
    ]
    summary = blocked.groupBy("__block").agg(*totals).select("__block", *carried)
    so_far = Window.partitionBy("__block").orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    out = blocked
    for new, value in sums.items():
        out = out.withColumn(new, F.sum(value).over(so_far))
    for new, value in maxima.items():
        out = out.withColumn(new, F.max(value).over(so_far))
    out = out.join(summary, "__block")
    for new in sums:
        out = out.withColumn(new, F.coalesce(F.col(new), F.lit(0)) + F.coalesce(F.col(f"__c_{new}"), F.lit(0)))
    for new in maxima:
        out = out.withColumn(new, F.greatest(F.col(new), F.col(f"__c_{new}")))
    return out.drop("__block", *[f"__c_{new}" for new in [*sums, *maxima]])


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Mapping[str, float],
    tie_break: Sequence[str],
    approximate: bool = False,
) -> DataFrame:
    """One column per named probability, linear between the two nearest ranks; NULL and NaN ignored,
    NULL for a group that has nothing else.

    Exact quantiles are read off a sorted index at the ranks needed, so no aggregation buffer holds a
    group. ``tie_break`` names columns that make a row unique and so keep a frequent value divisible.
    """
    clean = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    if approximate:
        valid = F.when(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")), F.col(value))
        return df.groupBy(*keys).agg(
            *[F.percentile_approx(valid, p, 100_000).cast("double").alias(n) for n, p in probabilities.items()]
        )
    clean = clean.select(*keys, F.col(value).cast("double").alias("__v"), *[t for t in tie_break if t not in keys])
    indexed = with_row_index(clean, [*keys, "__v", *tie_break], name="__i")
    wanted = F.array(
        *[F.struct(F.lit(n).alias("name"), ((F.col("__n") - 1) * F.lit(p)).alias("at")) for n, p in probabilities.items()]
    )
    # a group fills one run of the index, so its ranks are places in the index
    ends = (
        indexed.groupBy(*keys)
        .agg(F.min("__i").alias("__start"), F.count(F.lit(1)).alias("__n"))
        .withColumn("__w", F.explode(wanted))
        .withColumn("__low", F.floor("__w.at"))
        .withColumn("__place", F.explode(F.array_distinct(F.array(F.col("__low"), F.ceil("__w.at")))))
        .withColumn("__i", F.col("__start") + F.col("__place"))
    )
    picked = ends.join(indexed.select("__i", "__v"), "__i").groupBy(*keys, F.col("__w.name").alias("__name")).agg(
        F.min_by("__v", "__place").alias("__a"),
        F.max_by("__v", "__place").alias("__b"),
        F.max(F.col("__w.at") - F.col("__low")).alias("__share"),
    )
    level = F.col("__a") + (F.col("__b") - F.col("__a")) * F.col("__share")
    # a row without levels for each group, so that one without valid values is not lost
    groups = df.select(*keys).distinct().select(*keys, *[F.lit(None).cast(t).alias(n) for n, t in (("__name", "string"), ("__a", "double"), ("__b", "double"), ("__share", "double"))])
    levels = picked.unionByName(groups).groupBy(*keys)
    return levels.agg(*[F.max(F.when(F.col("__name") == n, level)).alias(n) for n in probabilities])


def keep_first(df: DataFrame, key: Column | str, order_by: Sequence[str], wide: bool = False) -> DataFrame:
    """One row per key, the first in the given order.

    A map-side minimum, so the copies of a frequent key shrink before the shuffle. Keys are grouped by
    their SHA-256 digest. For ``wide`` rows the minimum runs over the order columns alone (which must
    identify a row) and the rows are then looked up by them, so payloads are neither sorted nor buffered.
    """
    column = F.col(key) if isinstance(key, str) else key
    order = F.struct(*[F.col(f"`{c}`") for c in order_by])
    groups = df.groupBy(F.sha2(column.cast("string"), 256).alias("__key"))
    if wide:
        if len(order_by) == 1:
            winners = groups.agg(F.min(F.col(f"`{order_by[0]}`")).alias(order_by[0])).drop("__key")
        else:
            winners = groups.agg(F.min(order).alias("__first")).select("__first.*")
        winners = winners.select(*[F.col(f"`{c}`").alias(f"__w{i}") for i, c in enumerate(order_by)])
        same = functools.reduce(
            lambda a, b: a & b, [df[f"`{c}`"].eqNullSafe(winners[f"__w{i}"]) for i, c in enumerate(order_by)]
        )
        return df.join(winners, same, "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return groups.agg(F.min_by(row, order).alias("__row")).select("__row.*")


def keep_last(df: DataFrame, keys: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """One row per key, the last in the given order (a later update replaces an earlier one)."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(f"`{c}`") for c in rest])
    order = F.struct(*[F.col(f"`{c}`") for c in order_by])
    picked = df.groupBy(*keys).agg(F.max_by(row, order).alias("__row"))
    return picked.select(*keys, "__row.*").select(*df.columns)
