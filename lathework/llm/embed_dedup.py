"""Embedding near-duplicates by sorted projection passes.

A pass draws random directions; the signs of a vector's projections on them, one bit each, joined to one number, are its name. All vectors are sorted
by name, and each is compared with a bounded window of neighbours before and after it. Near vectors often agree in the leading bits and then lie
in one stretch of the sorted order. A stretch is as many leading bits as give even data half a window of vectors, so its vectors nearly always see each other
through their windows; one that is longer than a window is compared whole. So two vectors meet in a pass if they agree in its leading bits, however
dense the region they lie in, and often if they do not. The number of passes follows from how many rows there are: it gives two vectors at the threshold more than
the wanted chance to agree in some pass. Verified pairs of all passes are united.

A stretch too large for one task is first dealt at random into parts of a bounded size, which are compared like stretches. Then tiles of it meet
in all pairs, but those of which both sides are known to hang together already; what this leaves is quadratic in the stretch.

Links are handed on as stars, one for each set that hangs together, so a large group of copies costs rows in proportion to its members.
What the stars cannot count, the number of a vector's direct links, is then counted exactly within each component, tile by tile.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathework.llm.common import Scratch, components, grouped
from lathework.operators.ordering import with_row_index

#: Neighbours on either side in the sorted order with which a vector is compared.
WINDOW = 128
#: Bits of a name, at most.
BITS = 48
#: Vectors of a stretch, or of a part of one, compared whole in one task.
LARGE = 2048
#: Chance that a pair at the threshold meets in some pass.
RECALL = 0.995
#: Passes over small tables too.
LEAST_PASSES = 8
#: Passes whose rows are shuffled together.
PASSES_AT_ONCE = 16
#: Vectors of a tile in which links are counted.
TILE = 1024
_SEED = 20_240_501


def passes_for(rows: int, threshold: float, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes so that a pair at the threshold meets with the wanted chance.

    Two vectors meet if they agree in all ``bits_for`` bits, which are no more than those that leave half a window's worth of rows:
    a bit agrees with a chance of one less their angle over half a turn.
    """
    agree = 1 - math.acos(threshold) / math.pi
    chance = agree ** max(1.0, math.log2(max(2, rows) / (window / 2)))
    return max(LEAST_PASSES, math.ceil(math.log(1 - recall) / math.log(1 - chance))) if chance < 1 else LEAST_PASSES


def bits_for(rows: int, window: int = WINDOW) -> int:
    """Leading bits of a stretch, so that evenly spread rows give it half a window at least; none if the table has no more."""
    return min(BITS, max(0, math.floor(math.log2(max(1, rows) / (window / 2)))))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Scaled to length 1; by the largest component first, so that no square overflows or vanishes."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def _matrix(column: pa.ChunkedArray | pa.Array, kind: str) -> np.ndarray:
    """Vectors of one length from their bytes, in double precision."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64)


def _names(passes: range, kind: str, whole: bool = True):
    """Adds the names of passes to blocks of vectors; the vectors stay if ``whole``."""
    worth = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array(pc.binary_length(batch.column("v")))
            for dim in np.unique(sizes).tolist():
                some = pa.array(np.flatnonzero(sizes == dim))
                rows, raw = batch.column("row").take(some), batch.column("v").take(some)
                unit = _unit(_matrix(raw, kind))
                for p in passes:
                    ways = np.random.default_rng([_SEED, p, unit.shape[1]]).standard_normal((unit.shape[1], BITS))
                    name = (unit @ ways > 0) @ worth
                    columns = [pa.array(np.full(len(some), p, np.int32)), pa.array(np.full(len(some), dim, np.int32)), pa.array(name), rows]
                    yield pa.RecordBatch.from_arrays(columns + [raw] * whole, names=["pass", "dim", "name", "row", "v"][: 4 + whole])

    return run


def _stars(linked: np.ndarray, rows: np.ndarray, others: np.ndarray | None = None) -> list[np.ndarray]:
    """Pairs of rows that hold together what ``linked`` (``rows`` by ``others``, or by themselves) holds together."""
    square = others is None
    others = rows if square else others
    waiting, fresh = linked.any(axis=1), linked.any(axis=0)
    out = []
    for start in np.flatnonzero(waiting):
        new = np.array([start]) if waiting[start] else np.zeros(0, np.int64)
        while len(new):
            waiting[new] = False
            met = np.flatnonzero(linked[new].any(axis=0) & fresh)
            fresh[met] = False
            out.append(np.stack([others[met], np.full(len(met), rows[start])]))
            new = np.flatnonzero(linked[:, met].any(axis=1) & waiting)
            if not square:
                out.append(np.stack([rows[new], np.full(len(new), rows[start])]))
    return out


def _pairs(stars: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.concatenate(stars, axis=1) if stars else np.zeros((2, 0), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], names=["a", "b"])


def _window_links(unit: np.ndarray, seen: int, window: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of linked vectors at most ``window`` apart in sorted order, pairs within the first ``seen`` left out.

    The order is cut into strips of a window's length; each strip meets itself and the one before it in one product.
    """
    strips = -(-len(unit) // window)
    padded = np.zeros((strips + 1, window, unit.shape[1]))
    padded[1:].reshape(-1, unit.shape[1])[: len(unit)] = unit
    both = np.concatenate([padded[:-1], padded[1:]], axis=1)
    strip, i, j = np.nonzero(padded[1:] @ both.transpose(0, 2, 1) >= threshold)
    a, b = strip * window + i, (strip - 1) * window + j
    real = (b >= 0) & (b < a) & (a - b <= window) & (a >= seen) & (a < len(unit))
    return a[real], b[real]


def _forest(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each place that pairs hold to a smaller one, and the smallest that it hangs together with."""
    least = np.arange(size)
    while True:
        low = np.minimum(least[a], least[b])
        after = least.copy()
        for places in (a, b, least[a], least[b]):
            np.minimum.at(after, places, low)
        after = after[after]
        if (after == least).all():
            held = np.flatnonzero(least != np.arange(size))
            return held, least[held]
        least = after


def _neighbours(threshold: float, window: int, shift: int, kind: str):
    """Links of a sorted stream: within windows, and within all of each stretch, or part of one, that is longer; as stars."""

    def links(rows: np.ndarray, unit: np.ndarray, stretch: np.ndarray, seen: int) -> list[np.ndarray]:
        a, b = _window_links(unit, seen, window, threshold)
        held, least = _forest(a, b, len(rows))
        found = [np.stack([rows[held], rows[least]])] if len(held) else []
        cuts = [seen, *(np.flatnonzero((stretch[seen + 1 :] != stretch[seen:-1]).any(axis=1)) + seen + 1).tolist(), len(rows)]
        for start, end in zip(cuts, cuts[1:]):
            if end - start > window + 1:
                linked = unit[start:end] @ unit[start:end].T >= threshold
                np.fill_diagonal(linked, False)
                found += _stars(linked, rows[start:end]) if linked.any() else []
        return found

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # vectors waiting for the end of their stretch, after ``seen`` that are done and only serve as neighbours
        held, seen = None, 0
        rows, unit, stretch = np.zeros(0, np.int64), np.zeros((0, 1)), np.zeros((0, 2), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in ("pass", "dim")], axis=1)
            own = np.stack([np.asarray(batch.column("name")) >> shift, np.asarray(batch.column("part"))], axis=1)
            cuts = [0, *(np.flatnonzero((order[1:] != order[:-1]).any(axis=1)) + 1).tolist(), len(order)]
            found = []
            for a, b in zip(cuts, cuts[1:]):
                more = _unit(_matrix(batch.column("v").slice(a, b - a), kind))
                if held != tuple(order[a].tolist()):
                    if len(rows) > seen:
                        found += links(rows, unit, stretch, seen)
                    held, seen = tuple(order[a].tolist()), 0
                    rows, unit, stretch = rows[:0], more[:0], stretch[:0]
                rows = np.concatenate([rows, np.asarray(batch.column("row"))[a:b]])
                unit, stretch = np.concatenate([unit, more]), np.concatenate([stretch, own[a:b]])
                ended = np.flatnonzero((stretch != stretch[-1]).any(axis=1))
                done = int(ended[-1]) + 1 if len(ended) else 0
                if done > seen:
                    found += links(rows[:done], unit[:done], stretch[:done], seen)
                    start = max(0, done - window)
                    rows, unit, stretch, seen = rows[start:], unit[start:], stretch[start:], done - start
            yield _pairs(found)
        if len(rows) > seen:
            yield _pairs(links(rows, unit, stretch, seen))

    return run


def _across(threshold: float, kind: str):
    """Links between the two tiles of a pair, or within the tile of a pair of one, as stars."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pair in grouped(batches, ["pass", "dim", "stretch", "i", "j"]):
            ours = np.asarray(pair.column("side")) == 0
            unit, rows = _unit(_matrix(pair.column("v"), kind)), np.asarray(pair.column("row"))
            if ours.all():
                yield _pairs(_stars(unit @ unit.T >= threshold, rows))
            else:
                yield _pairs(_stars(unit[ours] @ unit[~ours].T >= threshold, rows[ours], rows[~ours]))

    return run


def _across_tiles(distinct: DataFrame, members: DataFrame, roots: DataFrame, threshold: float, kind: str, scratch: Scratch) -> DataFrame:
    """``a, b``: links within large stretches, between vectors not known to hang together.

    ``members`` has ``pass, dim, stretch, row`` of them, ``roots`` what is known. Tiles are cut along the roots, so a pair of tiles of one and the same root is left out.
    """
    within = ["pass", "dim", "stretch"]
    members = members.join(roots, "row", "left").withColumn("root", F.coalesce("root", "row"))
    placed = with_row_index(members, ["root", "row"], within=within, name="place")
    placed = scratch.keep(placed.withColumn("tile", F.floor(F.col("place") / LARGE)).drop("place"), "stretch-tiles")
    tiles = placed.groupBy(*within, "tile").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    first = tiles.select(*within, F.col("tile").alias("i"), "lo", "hi")
    second = tiles.select(*within, F.col("tile").alias("j"), F.col("lo").alias("lo_j"), F.col("hi").alias("hi_j"))
    known = "lo = hi and lo = lo_j and lo = hi_j"
    pairs = first.join(second, within).where(f"i <= j and not ({known})").select(*within, "i", "j")
    pairs = scratch.keep(pairs, "stretch-tile-pairs")
    placed = placed.select(*within, "row", "tile").join(distinct.select("row", "v"), "row")
    columns = [*within, "i", "j", "side", "row", "v"]
    left = placed.withColumnRenamed("tile", "i").join(pairs, [*within, "i"]).withColumn("side", F.lit(0))
    right = placed.withColumnRenamed("tile", "j").join(pairs.where("i < j"), [*within, "j"]).withColumn("side", F.lit(1))
    dealt = left.select(*columns).union(right.select(*columns)).repartition(*columns[:5]).sortWithinPartitions(*columns[:7])
    return scratch.keep(dealt.mapInArrow(_across(threshold, kind), "a long, b long").distinct(), "stretch-links")


def _count(threshold: float, kind: str):
    """Links of each vector of the first side of a pair of tiles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tile in grouped(batches, ["root", "dim", "i", "j"]):
            side = np.array(tile.column("side").to_pylist())
            unit, weight = _unit(_matrix(tile.column("v"), kind)), np.array(tile.column("copies").to_pylist(), np.int64)
            rows = np.array(tile.column("row").to_pylist(), np.int64)
            ours, theirs = side == 0, (side == 1) if (side == 1).any() else (side == 0)
            linked = unit[ours] @ unit[theirs].T >= threshold
            linked &= rows[ours][:, None] != rows[theirs][None, :]
            yield pa.RecordBatch.from_arrays([pa.array(rows[ours]), pa.array(linked @ weight[theirs])], names=["row", "links"])

    return run


def near_duplicates(
    vectors: DataFrame, threshold: float = 0.9, key: str = "vec_id", vector: str = "embedding", window: int = WINDOW, recall: float = RECALL
) -> DataFrame:
    """``key, n_links, component_id, kept`` for every row: links have a cosine of at least ``threshold`` in double precision.

    ``component_id`` is the smallest key that found links reach, the row's own included, and the row whose key it is is kept.
    Vectors that are null, of length zero, or hold a null or non-finite component link with nothing. Vectors of different lengths do not link.
    Equal vectors (by 128 bits of digest) are one while links are sought and count with their number. A null key is never the smallest
    unless the whole component has none; such a row is kept if it links with nothing. Repeated keys are rows of their own.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    given = vectors.select(vectors[f"`{key}`"].alias("key"), vectors[f"`{vector}`"].cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    # -0.0 becomes 0.0, so that equal vectors have equal digests
    given = given.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    # floats stay floats on the way; all arithmetic is in double precision
    kind = "<f4" if vectors.select(F.explode(vectors[f"`{vector}`"])).dtypes[0][1] == "float" else "<f8"
    named = ["digest", "second"]
    sound = F.coalesce(fine, F.lit(False))
    rows = given.select("key", *[F.when(sound, F.xxhash64(F.lit(k), "v")).alias(n) for k, n in enumerate(named)], "v")
    distinct = rows.where("digest is not null").groupBy(*named).agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"))
    # row numbers are fixed by writing them
    distinct = distinct.select(F.monotonically_increasing_id().alias("row"), *named, "copies", "v")
    distinct = scratch.keep(distinct.mapInArrow(_as_bytes(kind), "row long, digest long, second long, copies long, v binary"), "distinct-vectors")
    count = distinct.count()
    passes, bits = passes_for(count, threshold, window, recall), bits_for(count, window)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    within, stretch = ["pass", "dim", "stretch"], F.shiftright("name", BITS - bits).alias("stretch")
    found, large = [], []
    for number in range(0, passes, PASSES_AT_ONCE):
        some = range(number, min(passes, number + PASSES_AT_ONCE))
        sorts = distinct.select("row", "v").mapInArrow(_names(some, kind), "pass int, dim int, name long, row long, v binary").select("*", stretch)
        short = distinct.select("row", "v").mapInArrow(_names(some, kind, False), "pass int, dim int, name long, row long").select("*", stretch)
        sizes = short.groupBy(*within).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > LARGE)
        # at most one row for LARGE rows of a pass, hence the broadcasts
        sizes = scratch.keep(sizes.select(*within, F.ceil(F.col("n") / LARGE).alias("parts")), "large-stretches")
        part = F.lit(0)
        if sizes.head(1):
            large.append(scratch.keep(short.join(F.broadcast(sizes), within).drop("parts", "name"), "large-stretch-rows"))
            sorts = sorts.join(F.broadcast(sizes), within, "left")
            part = F.pmod(F.xxhash64("row", "pass"), F.coalesce("parts", F.lit(1)))
        sorts = sorts.select(*within, part.cast("long").alias("part"), "name", "row", "v")
        # equal keys share a partition, so no stretch is cut; windows that reach over a partition's edge end there
        dealt = sorts.repartitionByRange(parts, *within, "part").sortWithinPartitions(*within, "part", "name", "row").drop("stretch")
        found.append(scratch.keep(dealt.mapInArrow(_neighbours(threshold, window, BITS - bits, kind), "a long, b long").distinct(), "window-links"))
    links = functools.reduce(DataFrame.union, found)
    roots = scratch.keep(components(links, "a", "b").withColumnRenamed("node", "row"), "roots")
    if large:
        more = _across_tiles(distinct, functools.reduce(DataFrame.union, large), roots, threshold, kind, scratch)
        known = roots.select(F.col("row").alias("a"), F.col("root").alias("b")).where("a != b")
        roots = scratch.keep(components(known.union(more), "a", "b").withColumnRenamed("node", "row"), "roots")
    linked = scratch.keep(distinct.join(roots, "row").withColumn("dim", F.octet_length("v")), "linked-vectors")
    placed = with_row_index(linked.select("root", "dim", "row"), ["row"], within=["root", "dim"], name="place")
    placed = scratch.keep(placed.withColumn("tile", F.floor(F.col("place") / TILE)).drop("place"), "tiles")
    tiles = placed.groupBy("root", "dim").agg((F.max("tile") + 1).alias("tiles"))
    sized = linked.join(placed.select("row", "tile"), "row").join(tiles, ["root", "dim"])
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    columns = ["root", "dim", "row", "copies", "v"]
    first = sized.select(*columns, F.col("tile").alias("i"), other.alias("j"), F.lit(0).alias("side"))
    second = sized.select(*columns, other.alias("i"), F.col("tile").alias("j"), F.lit(1).alias("side")).where("i != j")
    dealt = first.union(second).repartition("root", "dim", "i", "j").sortWithinPartitions("root", "dim", "i", "j", "side", "row")
    counts = dealt.mapInArrow(_count(threshold, kind), "row long, links long").groupBy("row").agg(F.sum("links").alias("links"))
    known = distinct.select("row", *named, "copies").join(roots, "row", "left").join(counts, "row", "left")
    placed = rows.drop("v").join(known, named, "left").drop(*named).withColumn("root", F.coalesce("root", "row"))
    placed = scratch.keep(placed, "placed-vectors")
    smallest = placed.where("root is not null").groupBy("root").agg(F.min("key").alias("least"))
    least = F.coalesce("least", "key")
    return placed.join(smallest, "root", "left").select(
        F.col("key").alias(key),
        F.coalesce(F.coalesce("links", F.lit(0)) + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"),
        least.alias("component_id"),
        F.coalesce(F.col("key") == least, F.col("root").isNull() | F.col("least").isNull()).alias("kept"),
    )


def _as_bytes(kind: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [np.array(v, kind).tobytes() for v in batch.column("v").to_pylist()]
            others = ["row", "digest", "second", "copies"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(raw, pa.binary())], names=[*others, "v"])

    return run
