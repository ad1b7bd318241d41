"""Exact top-k search by inner product, coarse to fine over segment statistics.

A vector is cut into segments; each has a mean and a deviation. The squared distance of two vectors is at least the sum over
segments of ``length x ((difference of means)² + (difference of deviations)²)``, which bounds their inner product from above by the sum of
``length x (product of means + product of deviations)``. Few long segments give a loose bound for all candidates, more and shorter
ones a tighter bound for those left, and only what survives all of them gets its exact score.

All candidates are cut into groups of blocks; every block of queries meets every group, and a group hands on its best k per query. A block of
queries meets a block of candidates in one matrix product per level; a candidate that no query of the block needs any more leaves it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathework.llm.common import Scratch, grouped, whole_numbers

#: Segments of the levels, coarse to fine.
LEVELS = (1, 4, 16)
#: Vectors of a candidate block, blocks of a group, vectors of a query block.
BLOCK, GROUP_BLOCKS, QUERY_BLOCK = 4096, 4, 256
#: Scores stay exact in double precision while the sum of products is below this.
EXACT = 1 << 53
_BLOB = "dim int, rows int, ids binary, vectors binary"


def _pack(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Blocks of at most ``size`` vectors of one length: row numbers with ids, and the vectors, as bytes."""
    held: dict[int, list] = {}

    def block(dim: int) -> pa.RecordBatch:
        rows = held.pop(dim)
        ids = np.array([r[:2] for r in rows], np.int64).tobytes()
        vectors = np.array([r[2] for r in rows], np.float64).tobytes()
        return pa.RecordBatch.from_arrays(
            [pa.array([dim], pa.int32()), pa.array([len(rows)], pa.int32()), pa.array([ids], pa.binary()), pa.array([vectors], pa.binary())],
            names=["dim", "rows", "ids", "vectors"],
        )

    for batch in batches:
        for row, name, vector in zip(*(c.to_pylist() for c in batch.columns)):
            rows = held.setdefault(len(vector), [])
            rows.append((row, name, vector))
            if len(rows) == size:
                yield block(len(vector))
    for dim in list(held):
        yield block(dim)


def _segments(vectors: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations, both times the square root of the segment's length."""
    edges = np.linspace(0, vectors.shape[1], min(count, vectors.shape[1]) + 1).astype(int)
    lengths = np.diff(edges)
    sums = np.add.reduceat(vectors, edges[:-1], axis=1)
    squares = np.add.reduceat(vectors * vectors, edges[:-1], axis=1)
    means = sums / np.sqrt(lengths)
    return means, np.sqrt(np.maximum(squares - means * means, 0))


class Block:
    """Vectors with their statistics at all levels."""

    def __init__(self, rows: int, ids: bytes, vectors: bytes):
        self.row, self.name = np.frombuffer(ids, np.int64).reshape(rows, 2).T
        self.vectors = np.frombuffer(vectors, np.float64).reshape(rows, -1)
        self.largest = float(np.abs(self.vectors).max(initial=0))
        self.levels = [np.hstack(_segments(self.vectors, n)) for n in LEVELS] if self.vectors.shape[1] else []


class Best:
    """The best ``k`` candidates so far of each query of a block: more score first, then the smaller name, then the smaller row."""

    def __init__(self, asked: Block, k: int):
        self.asked, self.k = asked, k
        self.query, self.score, self.name, self.row = (np.zeros(0, np.int64) for _ in range(4))
        #: k-th best score of each query, none yet if it has fewer candidates
        self.floors = np.full(len(asked.row), -np.inf)

    def meet(self, block: Block) -> None:
        asked, k = self.asked, self.k
        norms = np.sqrt((asked.vectors * asked.vectors).sum(axis=1))
        slack = 1e-9 * (1 + norms * np.sqrt(asked.vectors.shape[1]) * block.largest)
        exact = block.largest * asked.largest * max(1, asked.vectors.shape[1]) < EXACT
        floors, fresh = self.floors, bool(np.isneginf(self.floors).any())
        alive, which = block.row[:, None] != asked.row[None, :], np.arange(len(block.row))
        for level, own in zip(block.levels, asked.levels):
            bound = level[which] @ own.T + slack
            if fresh and exact and len(which) > 4 * k:
                # the exact scores of the most promising raise the floors first
                first = np.argpartition(np.where(alive, -bound, np.inf), k, axis=0)[:k]
                found = np.einsum("kqd,qd->kq", block.vectors[which[first]], asked.vectors)
                sure = np.take_along_axis(alive, first, axis=0).all(axis=0)
                floors = np.maximum(floors, np.where(sure, found.min(axis=0), -np.inf))
            # a bound that is no number rules nothing out
            alive &= ~(bound < floors)
            needed = alive.any(axis=1)
            which, alive = which[needed], alive[needed]
        if exact:
            scores = (block.vectors[which] @ asked.vectors.T).astype(np.int64)
            c, q = np.nonzero(alive & (scores >= floors))
            self._add(q, scores[c, q], block.name[which[c]], block.row[which[c]])
        else:
            # whole numbers beyond double precision are added up as such
            c, q = np.nonzero(alive)
            ours = {i: [int(x) for x in block.vectors[i]] for i in which.tolist()}
            theirs = [[int(x) for x in v] for v in asked.vectors]
            sums = [sum(a * b for a, b in zip(ours[i], theirs[j])) for i, j in zip(which[c].tolist(), q.tolist())]
            scores = np.array([max(-(2**63), min(2**63 - 1, x)) for x in sums], np.int64)
            self._add(q, scores, block.name[which[c]], block.row[which[c]])

    def _add(self, query: np.ndarray, score: np.ndarray, name: np.ndarray, row: np.ndarray) -> None:
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        name, row = np.concatenate([self.name, name]), np.concatenate([self.row, row])
        # ~score turns the order round without leaving the range of a long
        order = np.lexsort((row, name, ~score, query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        order, place = order[place < self.k], place[place < self.k]
        self.query, self.score, self.name, self.row = query[order], score[order], name[order], row[order]
        last = place == self.k - 1
        self.floors = np.full(len(self.floors), -np.inf)
        self.floors[self.query[last]] = self.score[last]


def search(
    vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding", scale: float = 1024.0
) -> DataFrame:
    """``query_id, rank, key, score`` (int rank from 1) of each query row's ``k`` largest inner products, of all other rows.

    Components count as ``floor(scale x component)`` in double precision. Ties go to the smaller key; keys are read as longs, and
    one that is no number ends the job if the session is in ANSI mode. Rows whose key or vector is null, or whose vector has a null or non-finite component, or one
    that the scale makes so, take no part; vectors of other lengths than the query's are no candidates of
    it. Repeated keys are rows of their own: a query never meets its own row, but may meet another with its key. Scores beyond a long are
    set to its limits before they are ranked. Only ``key``, ``vector`` and what ``is_query`` reads are read.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = vectors.select(
        vectors[f"`{key}`"].cast("long").alias("name"), vectors[f"`{vector}`"].cast("array<double>").alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).where("name is not null and v is not null")
    rows = rows.withColumn("v", whole_numbers("v", scale)).where("v is not null")
    # row numbers are fixed by writing them
    rows = scratch.keep(rows.select(F.monotonically_increasing_id().alias("row"), "name", "v", "asks"), "vectors")
    queries = scratch.keep(
        rows.where("asks").select("row", "name", "v").mapInArrow(lambda b: _pack(b, QUERY_BLOCK), _BLOB), "query-blocks"
    )
    blocks = scratch.keep(
        rows.select("row", "name", "v").mapInArrow(lambda b: _pack(b, BLOCK), _BLOB), "candidate-blocks"
    )
    groups = max(1, -(-blocks.count() // GROUP_BLOCKS))
    place = F.pmod(F.xxhash64("ids"), F.lit(groups)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    columns = ["dim", "rows", "ids", "vectors"]
    met = blocks.select(place.alias("group"), F.lit(0).alias("kind"), *columns).union(
        queries.select(every.alias("group"), F.lit(1), *columns)
    )

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, candidates = None, []
        for part in grouped(batches, ["group", "dim", "kind", "ids"]):
            group, dim, kind = (part.column(c)[0].as_py() for c in ("group", "dim", "kind"))
            for count, ids, data in zip(*(part.column(c).to_pylist() for c in ("rows", "ids", "vectors"))):
                if current != (group, dim):
                    current, candidates = (group, dim), []
                if kind == 0:
                    candidates.append(Block(count, ids, data))
                    continue
                best = Best(Block(count, ids, data), k)
                for block in candidates:
                    best.meet(block)
                columns = [best.asked.row[best.query], best.asked.name[best.query], best.name, best.score]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row", "query_id", "name", "score"])

    dealt = met.repartition(groups, "group").sortWithinPartitions("group", "dim", "kind", "ids")
    best = dealt.mapInArrow(meet, "row long, query_id long, name long, score long")
    order = Window.partitionBy("row").orderBy(F.col("score").desc(), "name")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("name").alias(key), "score")
