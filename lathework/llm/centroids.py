"""Centroid clustering of integer vectors, with distances looked up in tables.

Vectors are stored once as blocks: per dimension the whole numbers that occur in the block, and for each vector the place of
its number among them. A round tabulates the squared difference of every occurring number and every centroid, dimension by dimension;
a distance is then the sum of table entries. Sums of a cluster follow the same way, from how often a number occurs in it.

The driver holds centroids only; a task hands on one sum per cluster and dimension. All arithmetic is in whole numbers: in 64 bits where
these are enough, else in Python's own, so nothing is rounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lathework.llm.common import Scratch, whole_numbers

#: Vectors of a block at most; long vectors make blocks shorter, so that codes stay below this many bytes.
BLOCK, BLOCK_BYTES = 8192, 8 << 20
#: Components up to this size keep 64-bit distances exact for up to 2^14 dimensions.
SHORT = 1 << 22
MOST = (1 << 63) - 1
_LIMB = 1 << 32


@dataclass
class Centroids:
    """``values[c]`` are the whole components of centroid ``c``."""

    values: list[list[int]]

    def digest(self, c: int) -> str:
        return hashlib.sha256(",".join(map(str, self.values[c])).encode()).hexdigest()


def _pack(batches: Iterable[pa.RecordBatch], size: int, dimension: int, key_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    """Blocks: keys, places of each vector's components among the numbers of their dimension, those numbers, how many of each dimension."""
    for batch in batches:
        for start in range(0, batch.num_rows, size):
            part = batch.slice(start, size)
            vectors = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, dimension)
            codes = np.empty(vectors.shape, np.uint16)
            numbers, counts = [], []
            for d in range(dimension):
                own, codes[:, d] = np.unique(vectors[:, d], return_inverse=True)
                numbers.append(own)
                counts.append(len(own))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part.column(0).to_pylist()], pa.list_(key_type)),
                    pa.array([codes.tobytes()], pa.binary()),
                    pa.array([np.concatenate(numbers or [np.empty(0)]).astype(np.float64).tobytes()], pa.binary()),
                    pa.array([counts], pa.list_(pa.int32())),
                ],
                names=["keys", "codes", "numbers", "counts"],
            )


class Block:
    """Codes of a block's vectors and, per dimension, the numbers they stand for."""

    def __init__(self, rows: int, codes: bytes, numbers: bytes, counts: list[int]):
        self.codes = np.frombuffer(codes, np.uint16).reshape(rows, len(counts))
        flat = np.frombuffer(numbers, np.float64)
        short = np.abs(flat).max(initial=0) <= SHORT
        self.whole = flat.astype(np.int64) if short else np.array([int(x) for x in flat], object)
        self.ends = np.cumsum(counts)
        self.short = short and len(counts) <= 1 << 14

    def numbers(self, d: int) -> np.ndarray:
        return self.whole[self.ends[d - 1] if d else 0 : self.ends[d]]

    def assign(self, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
        """Nearest centroid, the first of equally near ones, and the squared distance to it."""
        short = self.short and all(abs(x) <= SHORT for c in centroids.values for x in c)
        kind = np.int64 if short else object
        centres = np.array(centroids.values, kind).reshape(len(centroids.values), -1)
        total = np.zeros((len(self.codes), len(centres)), kind)
        for d in range(self.codes.shape[1]):
            table = (self.numbers(d).astype(kind)[:, None] - centres[:, d]) ** 2
            total += table[self.codes[:, d]]
        cluster = np.argmin(total, axis=1) if len(total) else np.empty(0, np.int64)
        return cluster, total[np.arange(len(total)), cluster]

    def sums(self, cluster: np.ndarray, clusters: int) -> list[list[int]]:
        """Per cluster and dimension the sum of its vectors' components: each number times its count there."""
        out = [[0] * self.codes.shape[1] for _ in range(clusters)]
        for d in range(self.codes.shape[1]):
            own = self.numbers(d)
            pairs = np.bincount(cluster * len(own) + self.codes[:, d], minlength=clusters * len(own)).reshape(clusters, len(own))
            for c, counts in enumerate(pairs):
                there = np.flatnonzero(counts)
                out[c][d] = int((counts[there].astype(own.dtype) * own[there]).sum())
        return out


_COLUMNS = ("keys", "codes", "numbers", "counts")


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, Block]]:
    for batch in batches:
        for keys, codes, numbers, counts in zip(*(batch.column(c).to_pylist() for c in _COLUMNS)):
            yield keys, Block(len(keys), codes, numbers, counts)


def _limbs(number: int) -> list[int]:
    """Digits of 32 bits, smallest first, each with the number's sign; they can be added up one by one."""
    sign, rest, out = (-1 if number < 0 else 1), abs(number), []
    while rest:
        out.append(sign * (rest % _LIMB))
        rest //= _LIMB
    return out


def _next(blocks: DataFrame, centroids: Centroids) -> Centroids:
    """Each centroid moved to the floor of its vectors' mean; one without vectors stays."""
    size, dimension = len(centroids.values), len(centroids.values[0])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = [0] * size, [[0] * dimension for _ in range(size)]
        for _, block in _blocks(batches):
            cluster, _ = block.assign(centroids)
            for c, (n, own) in enumerate(zip(np.bincount(cluster, minlength=size).tolist(), block.sums(cluster, size))):
                counts[c] += n
                sums[c] = [a + b for a, b in zip(sums[c], own)]
        # dimension -1 counts vectors
        rows = [(c, d, i, x) for c in range(size) for d, n in enumerate([counts[c], *sums[c]], -1) for i, x in enumerate(_limbs(n))]
        columns = list(zip(*rows)) or [()] * 4
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["c", "d", "i", "x"])

    parts = blocks.select(*_COLUMNS).mapInArrow(work, "c int, d int, i int, x long").groupBy("c", "d", "i")
    totals: dict[tuple[int, int], int] = {}
    for r in parts.agg(F.sum(F.col("x").cast("decimal(28,0)")).alias("x")).collect():  # clusters x dimensions, and a few limbs
        totals[r["c"], r["d"]] = totals.get((r["c"], r["d"]), 0) + int(r["x"]) * _LIMB ** r["i"]
    moved = [
        [totals.get((c, d), 0) // totals[c, -1] for d in range(dimension)] if (c, -1) in totals else old
        for c, old in enumerate(centroids.values)
    ]
    return Centroids(moved)


def _assigned(blocks: DataFrame, centroids: Centroids, key_type: T.DataType) -> DataFrame:
    schema = T.StructType([T.StructField("key", key_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    arrow = to_arrow_type(key_type)

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, block in _blocks(batches):
            cluster, distance = block.assign(centroids)
            capped = distance if distance.dtype == np.int64 else np.array([min(MOST, x) for x in distance], np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, arrow), pa.array(cluster.astype(np.int32)), pa.array(capped, pa.int64())], names=["key", "cluster", "distance"]
            )

    return blocks.select(*_COLUMNS).mapInArrow(work, schema)


def cluster(
    vectors: DataFrame, clusters: int = 16, rounds: int = 3, dimension: int = 64, seed: str = "1",
    key: str = "vec_id", vector: str = "embedding", scale: float = 64.0,
) -> tuple[DataFrame, Centroids]:
    """``key, cluster, distance`` of every kept vector after ``rounds`` rounds, and the final centroids.

    Kept are vectors with exactly ``dimension`` components, none of them null, not finite, or not finite times ``scale``; components count
    as ``floor(scale x component)`` in double precision. The first centroids are the vectors whose ``sha256("seed:key")`` is smallest, in that
    order; rows of equal keys follow each other by their vectors, null keys come last, and fewer vectors than ``clusters`` give fewer centroids. A round assigns each
    vector to the nearest centroid, ties to the smaller number, and moves each centroid that has vectors to the floor of their mean.
    Every kept row gives a row, also of a null or repeated key. A squared distance beyond a long is returned as the largest long;
    which centroid is nearest is always exact. No vectors give no rows and no centroids.
    """
    scratch = Scratch(vectors.sparkSession)
    kept = vectors.select(vectors[f"`{key}`"].alias("key"), vectors[f"`{vector}`"].cast("array<double>").alias("v"))
    kept = kept.withColumn("v", whole_numbers("v", scale)).where(F.col("v").isNotNull() & (F.size("v") == dimension))
    key_type = kept.schema["key"].dataType
    schema = T.StructType(
        [
            T.StructField("keys", T.ArrayType(key_type)), T.StructField("codes", T.BinaryType()),
            T.StructField("numbers", T.BinaryType()), T.StructField("counts", T.ArrayType(T.IntegerType())),
        ]
    )
    arrow = to_arrow_type(key_type)
    size = max(64, min(BLOCK, BLOCK_BYTES // (2 * max(1, dimension))))
    blocks = scratch.keep(kept.mapInArrow(lambda b: _pack(b, size, dimension, arrow), schema), "vector-blocks")
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")), 256)
    first = kept.orderBy(name.asc_nulls_last(), F.col("key").asc_nulls_last(), "v").limit(clusters).collect()
    centroids = Centroids([[int(x) for x in r["v"]] for r in first])
    if not first or not dimension:
        schema = T.StructType([T.StructField(key, key_type), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
        return vectors.sparkSession.createDataFrame([], schema), Centroids([])
    for _ in range(rounds):
        centroids = _next(blocks, centroids)
    return _assigned(blocks, centroids, key_type).withColumnRenamed("key", key), centroids


def summary(assigned: DataFrame, centroids: Centroids) -> DataFrame:
    """Adds to each row its cluster's and all distances summed (``cluster_inertia, inertia``) and ``centroid_sha256``, the digest of its
    centroid's components joined by commas. Sums beyond a long are returned as the largest long."""
    assigned = Scratch(assigned.sparkSession).keep(assigned, "clusters")
    # one row per cluster
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(28,0)")).alias("s")).collect()}
    if not sums:
        return assigned.selectExpr("*", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256")
    told = [
        F.struct(F.lit(min(MOST, sums.get(c, 0))).cast("long").alias("s"), F.lit(centroids.digest(c)).alias("d"))
        for c in range(len(centroids.values))
    ]
    own = F.get(F.array(*told), F.col("cluster"))
    total = F.lit(min(MOST, sum(sums.values()))).cast("long")
    return assigned.withColumns({"cluster_inertia": own["s"], "inertia": total, "centroid_sha256": own["d"]})
