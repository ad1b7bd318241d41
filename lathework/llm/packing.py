"""Best-fit packing of tokenized documents into sequences of a fixed length, by hierarchical residual rounds.

Each task packs its own pieces best fit, emits the nearly full bins, and hands on the others. Underfull
bins then meet in fewer, larger partitions, where they are items of the next best-fit round, up a tree.
A bin holds at most one sequence's tokens, so it travels as one row with its pieces.
"""

from __future__ import annotations

import functools
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

from lathework.llm.bpe import Coded, word_bpe
from lathework.llm.common import Scratch

#: Items that a task packs together; the bins left open go on to its next block.
BLOCK_ITEMS = 40_000
#: Words whose ids a worker keeps before it starts anew.
PARTS_KEPT = 800_000
#: Partitions of one round that meet in one partition of the next.
FAN_IN = 4
#: A bin with at most this share of its room left is emitted at once.
SLACK = 0.005
#: Rounds over the smallest number of partitions end when one frees less than this share of the bins.
GAIN = 0.002


def best_fit(items: list[tuple], capacity: int, sizes: Callable[[tuple], int]) -> list[list[tuple]]:
    """Items, largest first, each into the open bin whose room it fills best, ties to the bin opened last.

    Open bins are kept by their room; a bit per room tells which rooms there are.
    """
    bins: list[list[tuple]] = []
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for item in items:
        size = sizes(item)
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            room, at = capacity, len(bins)
            bins.append([])
        bins[at].append(item)
        room -= size
        if room:
            open_bins[room].append(at)
            rooms |= 1 << room
    return bins


def _piece_type(key: pa.DataType) -> pa.StructType:
    return pa.struct(
        [("doc_id", key), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())]
    )


def _packed(blocks: Iterable[list[tuple]], capacity: int, schema: pa.Schema, tag: int) -> Iterator[pa.RecordBatch]:
    """Bins of a task's blocks of items ``(used, pieces)``: full ones with a number, open ones without."""
    context = TaskContext.get()
    number = (tag << 56) | ((context.partitionId() if context else 0) << 32)
    enough = capacity - int(capacity * SLACK)

    def batch(bins: list[tuple], numbered: bool) -> pa.RecordBatch:
        nonlocal number
        numbers = range(number, number + len(bins)) if numbered else [None] * len(bins)
        number += len(bins) if numbered else 0
        for _, pieces in bins:
            for piece, offset in zip(pieces, accumulate((p["length"] for p in pieces), initial=0)):
                piece["offset"] = offset
        return pa.RecordBatch.from_arrays(
            [pa.array(numbers, pa.int64()), pa.array([b[0] for b in bins], pa.int64()), pa.array([b[1] for b in bins], schema.field("pieces").type)],
            schema=schema,
        )

    left: list[tuple] = []
    for block in blocks:
        items = sorted(left + block, key=_order)
        full, left = [], []
        for members in best_fit(items, capacity, lambda item: item[0]):
            used = sum(m[0] for m in members)
            merged = (used, members[0][1] if len(members) == 1 else [p for m in members for p in m[1]])
            (full if used >= enough else left).append(merged)
        if full:
            yield batch(full, True)
        if len(left) > BLOCK_ITEMS:
            yield batch(left, False)
            left = []
    if left:
        yield batch(left, False)


def _order(item: tuple) -> tuple:
    first = item[1][0]
    return -item[0], first["doc_id"] is None, first["doc_id"] if first["doc_id"] is not None else 0, first["piece"]


def _schema(key: pa.DataType) -> pa.Schema:
    return pa.schema([("sequence_id", pa.int64()), ("used", pa.int64()), ("pieces", pa.list_(_piece_type(key)))])


@functools.lru_cache(maxsize=2)
def _id_bytes(vocabulary: str) -> Coded:
    """Per part of a text: its ids as little-endian 32-bit numbers."""
    return Coded(word_bpe(vocabulary), lambda ids: array("I", ids).tobytes(), PARTS_KEPT)


def tokenized_pieces(parts: list[bytes], capacity: int, end: int) -> list[tuple]:
    """``(piece, start, length, crc)`` of a text's id bytes and the end id; only longer ones are cut."""
    ids = b"".join(parts) + end.to_bytes(4, "little")
    step = 4 * capacity
    return [
        (k, k * capacity, (min(at + step, len(ids)) - at) // 4, zlib.crc32(ids[at : at + step]))
        for k, at in enumerate(range(0, len(ids), step))
    ]


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` for every piece of every document.

    A document's ids are its text's (null and empty texts have none) and then ``end``. Repeated rows are
    packed as often as they come, a null ``key`` is kept; other columns are not read. Ties in size go by
    key, then piece. Sequences are numbered by round, partition and place, so a task that runs again
    gives the same numbers.
    """
    scratch = Scratch(docs.sparkSession)
    schema = _schema(to_arrow_type(docs.schema[key].dataType))
    ddl = from_arrow_schema(schema)

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = _id_bytes(vocabulary)

        def blocks() -> Iterator[list[tuple]]:
            held = []
            for batch in batches:
                for doc, parts in zip(batch.column(0).to_pylist(), coded.rows(batch.column(1).to_pylist())):
                    for piece, start, length, crc in tokenized_pieces(parts, capacity, end):
                        held.append((length, [{"doc_id": doc, "piece": piece, "start": start, "length": length, "ids_crc32": crc}]))
                    if len(held) >= BLOCK_ITEMS:
                        yield held
                        held = []
            yield held

        yield from _packed(blocks(), capacity, schema, 0)

    def again(tag: int):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def blocks() -> Iterator[list[tuple]]:
                held = []
                for batch in batches:
                    held += zip(batch.column("used").to_pylist(), batch.column("pieces").to_pylist())
                    while len(held) >= BLOCK_ITEMS:
                        yield held[:BLOCK_ITEMS]
                        held = held[BLOCK_ITEMS:]
                yield held

            yield from _packed(blocks(), capacity, schema, tag)

        return run

    narrow = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text"))
    done = scratch.keep(narrow.mapInArrow(first, ddl), "bins")
    rounds = [done]
    parts, bins, tag = done.rdd.getNumPartitions(), None, 0
    while True:
        open_bins = rounds[-1].where("sequence_id is null")
        count = open_bins.count()
        least = -(-count // BLOCK_ITEMS) or 1
        settled = parts <= least and bins is not None and count >= (1 - GAIN) * bins
        if count == 0 or settled or (parts == 1 and bins is not None) or tag == 120:
            break
        parts, bins, tag = max(least, parts // FAN_IN, 1), count, tag + 1
        # a different hash each round, so that other bins meet
        dealt = open_bins.select("*", F.xxhash64(F.lit(tag), F.monotonically_increasing_id()).alias("deal")).repartition(parts, "deal")
        rounds.append(scratch.keep(dealt.drop("deal").mapInArrow(again(tag), ddl), "bins"))
    closed = rounds[0].where("sequence_id is not null")
    for later in rounds[1:]:
        closed = closed.unionByName(later.where("sequence_id is not null"))
    rest = rounds[-1].where("sequence_id is null").withColumn(
        "sequence_id", F.lit(127 << 56) + F.monotonically_increasing_id()
    )
    closed = closed.unionByName(rest)
    placed = closed.select("sequence_id", F.explode("pieces").alias("p"))
    return placed.select(F.col("p.doc_id").alias(key), "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", "p.offset")
