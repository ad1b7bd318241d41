"""Hard-negative mining by exact inner products, several candidates to a multiplication (Kronecker packing).

Candidates' components are biased to whole numbers from 0 and set side by side as fields of one wide integer per dimension. An anchor's biased
component multiplies all fields at once; the products add up over the dimensions without touching the next field, as a field is as
wide as the largest possible sum. Unpacked and freed of the bias, the fields are the exact scores.

A wide integer of up to 53 bits is held by a double, so that one matrix product multiplies whole blocks exactly. Where not even one field
fits, Python's own integers hold all candidates of a block, in fields of whole bytes.

Rows are range-sorted by label into blocks. Blocks of anchors first meet only the groups of blocks that hold one of their labels (positives), then,
with the scores of their positives, all groups (negatives). A task hands on the best few of each anchor, or of each anchor and
positive score, so what follows is small.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathework.llm.common import Scratch, grouped, whole_numbers

#: Candidates of a block, blocks of a group, anchors of a block; long vectors make blocks shorter.
BLOCK, GROUP_BLOCKS, ANCHOR_BLOCK = 4096, 4, 256
BLOCK_BYTES = 16 << 20
#: Bits of a whole number that a double holds exactly.
WORD_BITS = 53
LEAST, MOST = -(1 << 63), (1 << 63) - 1
_BLOCKS = "dim int, part int, slot int, labels array<string>, ids binary, vectors binary, wanted array<array<bigint>>"
_MET = ["dim", "labels", "ids", "vectors", "wanted"]


def _vectors(dim: int, rows: int, data: bytes) -> np.ndarray:
    """Whole numbers as doubles; two bytes a component where these are enough, else eight."""
    short = len(data) == 2 * dim * rows
    return np.frombuffer(data, np.int16 if short else np.float64).reshape(rows, dim).astype(np.float64)


def _pack(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Consecutive rows ``row, name, label, v, wanted`` of one length as blocks, in their order."""
    part, held, slots = TaskContext.get().partitionId(), {}, {}

    def block(dim: int) -> pa.RecordBatch:
        rows = held.pop(dim)
        vectors = np.array([r[3] for r in rows], np.float64).reshape(len(rows), dim)
        if np.abs(vectors).max(initial=0) < 1 << 15:
            vectors = vectors.astype(np.int16)
        slots[dim] = slots.get(dim, -1) + 1
        columns = [
            pa.array([dim], pa.int32()), pa.array([part], pa.int32()), pa.array([slots[dim]], pa.int32()),
            pa.array([[r[2] for r in rows]], pa.list_(pa.string())), pa.array([np.array([r[:2] for r in rows], np.int64).tobytes()], pa.binary()),
            pa.array([vectors.tobytes()], pa.binary()), pa.array([[r[4] for r in rows]], pa.list_(pa.list_(pa.int64()))),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["dim", "part", "slot", "labels", "ids", "vectors", "wanted"])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            dim = len(row[3])
            rows = held.setdefault(dim, [])
            rows.append(row)
            if len(rows) >= min(size, max(64, BLOCK_BYTES // (8 * max(1, dim)))):
                yield block(dim)
    for dim in list(held):
        yield block(dim)


class Side:
    """The rows of a block: row numbers, keys, labels and vectors."""

    def __init__(self, dim: int, labels: list[str], ids: bytes, vectors: bytes):
        self.row, self.name = np.frombuffer(ids, np.int64).reshape(-1, 2).T
        self.labels = labels
        self.vectors = _vectors(dim, len(labels), vectors)


class Packed:
    """Candidates as wide integers, for anchors whose components lie between ``lo`` and ``hi``."""

    def __init__(self, vectors: np.ndarray, lo: int, hi: int):
        self.count, self.dim = vectors.shape
        self.lo = lo
        self.least, most = int(vectors.min(initial=0)), int(vectors.max(initial=0))
        self.width = max(1, (self.dim * (hi - lo) * (most - self.least)).bit_length())
        reach = self.dim * max(abs(lo), abs(hi), 1) * max(abs(self.least), abs(most), 1)
        self.fields = WORD_BITS // self.width if reach < 1 << 61 else 0
        if self.fields:
            biased = vectors - self.least
            self.sums = biased.sum(axis=1).astype(np.int64)
            self.per_field = -(-self.count // self.fields)
            padded = np.zeros((self.fields * self.per_field, self.dim))
            padded[: self.count] = biased
            scale = 2.0 ** (self.width * np.arange(self.fields))
            self.words = np.tensordot(scale, padded.reshape(self.fields, self.per_field, self.dim), 1).T.copy()
        else:
            whole = [[int(x) - self.least for x in row] for row in vectors]
            self.sums = [sum(row) for row in whole]
            self.bytes = -(-self.width // 8)
            self.words = [
                int.from_bytes(b"".join(row[d].to_bytes(self.bytes, "little") for row in whole), "little") for d in range(self.dim)
            ]

    def scores(self, anchors: np.ndarray) -> np.ndarray:
        """Exact inner products (anchors x candidates); those beyond a long are set to its limits."""
        if not self.fields:
            return np.array([self._wide([int(x) for x in a]) for a in anchors], np.int64).reshape(len(anchors), self.count)
        biased = anchors - self.lo
        product = (biased @ self.words).astype(np.int64)
        out = np.empty((len(anchors), self.fields * self.per_field), np.int64)
        mask = (1 << self.width) - 1
        for f in range(self.fields):
            out[:, f * self.per_field : (f + 1) * self.per_field] = (product >> (f * self.width)) & mask
        out = out[:, : self.count]
        out += self.lo * self.sums + self.dim * self.lo * self.least
        out += (self.least * biased.sum(axis=1).astype(np.int64))[:, None]
        return out

    def _wide(self, anchor: list[int]) -> list[int]:
        product = sum((x - self.lo) * word for x, word in zip(anchor, self.words))
        raw, n = product.to_bytes(self.bytes * self.count, "little"), self.bytes
        fixed = self.least * (sum(anchor) - self.dim * self.lo) + self.dim * self.lo * self.least
        found = (int.from_bytes(raw[i * n : (i + 1) * n], "little") + self.lo * self.sums[i] + fixed for i in range(self.count))
        return [max(LEAST, min(MOST, s)) for s in found]


class Best:
    """The ``k`` best hits, by score and then by smaller key, of each of some targets."""

    def __init__(self, targets: int, k: int):
        self.k = k
        self.floor = np.full(targets, LEAST, np.int64)
        self.target = self.score = self.name = np.empty(0, np.int64)

    def add(self, target: np.ndarray, score: np.ndarray, name: np.ndarray) -> None:
        if not len(target):
            return
        target, score, name = (np.concatenate(x) for x in ((self.target, target), (self.score, score), (self.name, name)))
        order = np.lexsort((name, ~score, target))  # ~x reverses the order of all longs
        target, score, name = target[order], score[order], name[order]
        place = np.arange(len(target)) - np.searchsorted(target, target)
        full = place == self.k - 1
        self.floor[target[full]] = score[full]
        kept = place < self.k
        self.target, self.score, self.name = target[kept], score[kept], name[kept]


def _hits(scores: np.ndarray, allowed: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of allowed scores from the floor of their row on that can be among the row's best ``k``."""
    allowed &= scores >= floor[:, None]
    if k < scores.shape[1] and np.count_nonzero(allowed) > 8 * k * len(scores):
        masked = np.where(allowed, scores, LEAST)
        allowed &= scores >= np.partition(masked, -k, axis=1)[:, -k][:, None]
    return np.nonzero(allowed)


def _positives(asked: Side, group: list[tuple[Side, Packed]], k: int) -> Best:
    best = Best(len(asked.row), k)
    for side, packed in group:
        _, same = _label_masks(asked, side)
        scores = packed.scores(asked.vectors)
        same &= asked.row[:, None] != side.row
        row, place = _hits(scores, same, best.floor, k)
        best.add(row, scores[row, place], side.name[place])
    return best


def _label_masks(asked: Side, side: Side) -> tuple[np.ndarray, np.ndarray]:
    codes = {label: i for i, label in enumerate(dict.fromkeys(asked.labels))}
    own = np.array([codes[x] for x in asked.labels])
    same = own[:, None] == np.array([codes.get(x, -1) for x in side.labels])
    return ~same, same


def _negatives(asked: Side, wanted: list[list[int]], group: list[tuple[Side, Packed]], k: int, percent: int) -> tuple[Best, list]:
    """Targets are the anchors' distinct positive scores; a hit of one lies between ``percent`` of it and itself."""
    targets = [(i, p) for i, scores in enumerate(wanted) for p in sorted(set(scores))]
    anchor = np.array([i for i, _ in targets], np.int64)
    upper = np.array([p for _, p in targets], np.int64)
    lower = np.array([-((-percent * p) // 100) for _, p in targets], np.int64)
    turn = np.arange(len(targets)) - np.searchsorted(anchor, anchor)
    best = Best(len(targets), k)
    best.floor = lower.copy()
    for side, packed in group:
        other, _ = _label_masks(asked, side)
        scores = packed.scores(asked.vectors)
        for n in range(int(turn.max(initial=-1)) + 1):
            which = np.flatnonzero(turn == n)
            rows = anchor[which]
            part = scores[rows]
            row, place = _hits(part, other[rows] & (part <= upper[which][:, None]), np.maximum(best.floor, lower)[which], k)
            best.add(which[row], part[row, place], side.name[place])
    return best, targets


def _column(values: Iterable[int]) -> pa.Array:
    return pa.array(np.asarray(values, np.int64), pa.int64())


def _meet(met: DataFrame, groups: int, lo: int, hi: int, work) -> DataFrame:
    """Anchor blocks (kind 1) after all candidate blocks (kind 0) of their group; ``work`` yields the four columns of hits."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for part in grouped(batches, ["group", "dim", "kind", "ids"]):
            group, dim, kind, labels, ids, data, wanted = (part.column(c)[0].as_py() for c in ("group", "dim", "kind", *_MET[1:]))
            if current != (group, dim):
                current, held = (group, dim), []
            side = Side(dim, labels, ids, data)
            if kind == 0:
                held.append((side, Packed(side.vectors, lo, hi)))
            elif held:
                yield pa.RecordBatch.from_arrays([_column(c) for c in work(side, wanted, held)], names=["row", "asked", "score", "name"])

    dealt = met.repartition(groups, "group").sortWithinPartitions("group", "dim", "kind", "ids")
    return dealt.mapInArrow(run, "row long, asked long, score long, name long")


def mine(
    vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, percent: int = 80,
    key: str = "vec_id", vector: str = "embedding", scale: float = 256.0,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``: hard negatives of each anchor and positive.

    Components count as ``floor(scale x component)`` in double precision; a score is an integer inner product, and one beyond a long counts as
    that limit. An anchor's positives are its best ``positives`` other rows of its label, its negatives for a positive the best
    ``negatives`` rows of other labels whose score is between ``percent`` of the positive's and the positive's own, so there are none below a
    positive score under 0. Ties go to the smaller key. Ranks are ints from 1. An anchor without positives, or a positive without negatives, gives no row.

    Keys are longs. Rows whose key, label or vector is null or whose vector has a component that is null, not finite or not finite times ``scale`` take no part; an anchor and rows
    whose vectors have another length do not meet; vectors without components score 0. Labels are compared as text. Rows of equal keys are rows of their own: an
    anchor never meets itself but may meet a row with its key. Only ``key``, ``vector`` and what the two expressions read are read.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(
        F.monotonically_increasing_id().alias("row"), vectors[f"`{key}`"].cast("long").alias("name"), label.cast("string").alias("label"),
        vectors[f"`{vector}`"].cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    ).where("name is not null and label is not null and v is not null")
    rows = rows.withColumn("v", whole_numbers("v", scale)).where("v is not null")
    nothing = F.lit(None).cast("array<bigint>").alias("wanted")
    # written once, so that row numbers stay as they are
    rows = scratch.keep(rows, "rows")
    sorted_rows = rows.repartitionByRange(F.size("v"), "label", "row").sortWithinPartitions(F.size("v"), "label", "row")
    blocks = scratch.keep(
        sorted_rows.select("row", "name", "label", "v", nothing).mapInArrow(lambda b: _pack(b, BLOCK), _BLOCKS), "blocks"
    )
    # a group holds neighbouring blocks; one row per partition numbers them
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.groupBy("part").agg((F.floor(F.max("slot") / GROUP_BLOCKS) + 1).alias("n"))
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    placed = blocks.join(F.broadcast(offsets), "part").withColumn("group", F.col("offset") + F.floor(F.col("slot") / GROUP_BLOCKS))
    groups = int(sizes.agg(F.coalesce(F.sum("n"), F.lit(1))).first()[0])

    asking = rows.where("asks").select("row", "name", "label", "v")
    lo, hi = asking.agg(F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    lo, hi = int(lo or 0), int(hi or 0)
    candidates = placed.select("group", F.lit(0).alias("kind"), *_MET)
    ordered = asking.repartitionByRange(F.size("v"), "label", "row").sortWithinPartitions(F.size("v"), "label", "row")
    asked = scratch.keep(ordered.select("*", nothing).mapInArrow(lambda b: _pack(b, ANCHOR_BLOCK), _BLOCKS), "anchor-blocks")

    holds = placed.select("group", "dim", F.explode("labels").alias("label")).distinct()
    asks = asked.select("part", "slot", "dim", F.explode("labels").alias("label")).distinct()
    pairs = asks.join(holds, ["dim", "label"]).select("part", "slot", "dim", "group").distinct()
    with_group = asked.join(pairs, ["part", "slot", "dim"]).select("group", F.lit(1), *_MET)

    def find_positives(side: Side, _, held: list) -> tuple:
        best = _positives(side, held, positives)
        return side.row[best.target], side.name[best.target], best.score, best.name

    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "name")
    first = _meet(candidates.union(with_group), groups, lo, hi, find_positives)
    first = scratch.keep(first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives), "positives")

    scores = first.groupBy("row").agg(F.collect_set("score").alias("wanted"))
    again = asking.join(scores, "row").mapInArrow(lambda b: _pack(b, ANCHOR_BLOCK), _BLOCKS)
    again = scratch.keep(again, "anchor-blocks")
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)).cast("array<bigint>"))

    def find_negatives(side: Side, wanted: list, held: list) -> tuple:
        best, targets = _negatives(side, wanted, held, negatives, percent)
        row = np.array([side.row[i] for i, _ in targets], np.int64)
        score = np.array([p for _, p in targets], np.int64)
        return row[best.target], score[best.target], best.score, best.name

    met = candidates.union(again.select(every.alias("group"), F.lit(1), *_MET))
    order = Window.partitionBy("row", "asked").orderBy(F.col("score").desc(), "name")
    last = _meet(met, groups, lo, hi, find_negatives).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    last = last.select("row", F.col("asked").alias("positive_score"), "rank", F.col("name").alias("negative_id"), F.col("score").alias("negative_score"))
    known = first.select("row", F.col("asked").alias("anchor_id"), F.col("name").alias("positive_id"), F.col("score").alias("positive_score"))
    return known.join(last, ["row", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
