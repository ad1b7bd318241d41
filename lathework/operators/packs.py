"""Packed, padded training sequences from a best-fit plan over sizes alone."""

from __future__ import annotations

import bisect
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathework.operators.ordering import with_row_index
from lathework.session import materialize


@dataclass(frozen=True)
class Placement:
    """Pieces ``start`` to ``start + count - 1`` of one size: the first goes into ``pack``, the next into the next pack, all at ``offset``."""

    size: int
    start: int
    count: int
    pack: int
    offset: int


class _Stretches:
    """Stretches of consecutive packs ``(first, count)`` by how much room each pack of them has."""

    def __init__(self):
        self._rooms: list[int] = []
        self._by_room: dict[int, list[tuple[int, int]]] = {}

    def add(self, room: int, first: int, count: int) -> None:
        if not room or not count:
            return
        if room not in self._by_room:
            bisect.insort(self._rooms, room)
            self._by_room[room] = []
        self._by_room[room].append((first, count))

    def take(self, size: int, most: int) -> tuple[int, int, int] | None:
        """Up to ``most`` packs of one stretch with the least room that is enough: ``room, first, count``."""
        at = bisect.bisect_left(self._rooms, size)
        if at == len(self._rooms):
            return None
        room = self._rooms[at]
        stretches = self._by_room[room]
        first, count = stretches.pop()
        if count > most:
            stretches.append((first + most, count - most))
        elif not stretches:
            del self._by_room[room], self._rooms[at]
        return room, first, min(count, most)


def plan_packs(sizes: Mapping[int, int], capacity: int) -> tuple[list[Placement], int]:
    """Places for all pieces, of which there are ``sizes[size]`` of each size up to ``capacity``, and the number of packs.

    Largest first, each into the pack with the least room that is enough. Pieces of one size and packs of one content are handled
    together, so the work depends on how many sizes there are, not on how many pieces.
    """
    if any(not 0 < size <= capacity for size in sizes):
        raise ValueError("sizes must be between 1 and the capacity")
    places: list[Placement] = []
    open_packs, packs = _Stretches(), 0
    for size in sorted(sizes, reverse=True):
        done, total = 0, sizes[size]
        while done < total:
            found = open_packs.take(size, total - done)
            if found is None:
                # no pack has room: new ones take as many of this size as they hold, a last one the rest
                deep = min(capacity // size, total - done)
                count = (total - done) // deep
                room, first = capacity, packs
                packs += count
                for turn in range(deep):
                    places.append(Placement(size, done, count, first, turn * size))
                    done += count
                open_packs.add(room - deep * size, first, count)
            else:
                room, first, count = found
                places.append(Placement(size, done, count, first, capacity - room))
                done += count
                open_packs.add(room - size, first, count)
    return places, packs


def packed_sequences(df: DataFrame, key: str, tokens: str, capacity: int, pad: int = 0) -> DataFrame:
    """Whole packs: ``pack, tokens, segments, positions, used, sources``.

    ``tokens`` of a pack are its sequences one after the other, padded with ``pad`` to exactly ``capacity``; ``segments`` number the sequences from 1
    (0 for padding), ``positions`` restart at 0 with each, and ``sources`` are ``key, piece, offset, length`` in order. A sequence longer than ``capacity``
    is cut into pieces of ``capacity``, the last may be shorter; an empty or NULL one is in no pack. Keys may repeat or be NULL.

    Only sizes are counted and planned: the histogram has at most ``capacity`` rows, and so the plan, which every task gets, is bounded by the capacity. The tokens
    are written once, meet their places, and are shuffled by pack, of which all are equally large.
    """
    spark = df.sparkSession
    rows = df.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(tokens).alias("tokens"))
    rows = materialize(rows.where(F.size("tokens") > 0), "sequences")
    length = F.size("tokens")
    numbers = F.sequence(F.lit(0), F.ceil(length / capacity).cast("int") - 1)
    pieces = rows.select(
        "row", F.explode(F.transform(numbers, lambda i: F.struct(i.alias("piece"), F.least(F.lit(capacity), length - i * capacity).alias("size")))).alias("p")
    ).select("row", "p.piece", "p.size")
    counts = {r["size"]: r["n"] for r in pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()}
    places, _ = plan_packs(counts, capacity)
    plan = spark.createDataFrame(
        [(p.size, p.start, p.start + p.count, p.pack, p.offset) for p in places], "size int, start long, stop long, first long, offset int"
    )
    numbered = with_row_index(pieces, ["row", "piece"], ["size"], "number")
    # bounded by the capacity, hence the broadcast
    placed = numbered.join(F.broadcast(plan), "size").where("number >= start and number < stop")
    placed = placed.select("row", "piece", "size", (F.col("first") + F.col("number") - F.col("start")).alias("pack"), "offset")
    parts = placed.join(rows, "row").select(
        "pack",
        F.struct("offset", "key", "piece", F.slice("tokens", F.col("piece") * capacity + 1, F.col("size")).alias("tokens")).alias("part"),
    )
    whole = parts.groupBy("pack").agg(F.array_sort(F.collect_list("part"), lambda a, b: a["offset"] - b["offset"]).alias("parts"))
    whole = whole.withColumn("used", F.aggregate("parts", F.lit(0), lambda n, p: n + F.size(p["tokens"])))
    rest = F.lit(capacity) - F.col("used")

    def filled(values, nothing):
        return F.concat(F.flatten(values), F.array_repeat(nothing, rest))

    kind = df.schema[tokens].dataType.elementType
    return whole.select(
        "pack",
        filled(F.transform("parts", lambda p: p["tokens"]), F.lit(pad).cast(kind)).alias("tokens"),
        filled(F.transform("parts", lambda p, i: F.array_repeat((i + 1).cast("int"), F.size(p["tokens"]))), F.lit(0)).alias("segments"),
        filled(F.transform("parts", lambda p: F.sequence(F.lit(0), F.size(p["tokens"]) - 1)), F.lit(0)).alias("positions"),
        "used",
        F.transform("parts", lambda p: F.struct(p["key"], p["piece"], p["offset"], F.size(p["tokens"]).alias("length"))).alias("sources"),
    )


def unpacked(packs: DataFrame, columns: Sequence[str] = ("tokens",)) -> DataFrame:
    """Each piece of each pack with its stretch of ``columns``: ``pack, key, piece, offset, length`` and these."""
    each = packs.select("pack", *columns, F.explode("sources").alias("s"))
    return each.select("pack", "s.*", *[F.slice(c, F.col("s.offset") + 1, F.col("s.length")).alias(c) for c in columns])
