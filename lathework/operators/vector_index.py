"""Approximate nearest neighbours: an inverted-file index whose recall is measured when it is built.

Items are dealt into lists by the nearest of some centroids, which are fitted on a bounded sample; every item is in one list. A question looks only into the
lists whose centroids are nearest to it. How many that must be depends on the data, so the index finds out: it searches some
items exactly and takes the fewest lists that hold the wanted share of their neighbours.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lathework.operators.ordering import draw_below, seeded_digest
from lathework.operators.retrieval import _better, _nothing, _unit
from lathework.session import materialize, scratch_path

SAMPLE_ROWS = 65_536  # vectors at most that the centroids are fitted on
SAMPLE_BYTES = 64 << 20  # and their bytes as doubles
SAMPLE_PER_LIST = 32  # so there are at most 2,048 lists, and what is broadcast is bounded by the sample / 32
FIT_ROUNDS = 8
CALIBRATION = 256  # items that are searched exactly to measure the recall
PART_ROWS = 1 << 16  # items of a list that a task holds; longer lists are dealt into parts
_STEP = 4096  # vectors that meet the centroids at a time


@dataclass(frozen=True)
class VectorIndex:
    """``items`` has ``list, item_id, vector`` of every item, stored by list; ``parts`` is ``list, rows, parts``, a row for each list."""

    items: DataFrame
    parts: DataFrame
    centroids: np.ndarray
    cosine: bool
    probes: int  # lists a question looks into
    recall: float  # measured with so many, without the question's own row


def _order(vectors: np.ndarray, centroids: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` nearest lists of each vector, nearest first."""
    out = np.empty((len(vectors), most), dtype="int32")
    for a in range(0, len(vectors), _STEP):
        part = vectors[a : a + _STEP]
        far = (centroids * centroids).sum(axis=1) - 2 * (part @ centroids.T)
        near = np.argpartition(far, most - 1, axis=1)[:, :most] if most < len(centroids) else np.argsort(far, axis=1)
        rank = np.argsort(np.take_along_axis(far, near, axis=1), axis=1, kind="stable")
        out[a : a + _STEP] = np.take_along_axis(near, rank, axis=1)
    return out


def _fit(sample: np.ndarray, lists: int, rounds: int) -> np.ndarray:
    """Lloyd's rounds from evenly spaced sample rows; a list without vectors takes the vector farthest from its centroid."""
    centroids = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(rounds):
        own = _order(sample, centroids, 1)[:, 0]
        counts = np.bincount(own, minlength=lists)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        filled = counts > 0
        centroids[filled] = sums[filled] / counts[filled, None]
        far = np.argsort(-((sample - centroids[own]) ** 2).sum(axis=1), kind="stable")
        centroids[~filled] = sample[far[: int((~filled).sum())]]
    return centroids


def _numbers(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(-1, width)


def _sample(vectors: DataFrame, rows: int, wanted: int, seed: int) -> tuple[list[int], np.ndarray]:
    """Ids and vectors of about ``wanted`` rows, never more, by the digest of the id alone."""
    share = min(1.0, 1.2 * wanted / max(1, rows))
    drawn = vectors.where(draw_below(seeded_digest(seed, "item_id"), share)) if share < 1 else vectors
    found = drawn.limit(wanted).toPandas()
    found = found.sort_values("item_id", kind="stable")
    return found["item_id"].tolist(), np.stack(found["vector"].to_numpy()).astype("float64")


def _exact(index: DataFrame, ids: list[int], asked: np.ndarray, k: int, digits: int) -> DataFrame:
    """The best ``k`` of all items for a few questions that every task gets: ``question, item_id, score, list``; not the question's own row."""
    spark, width = index.sparkSession, asked.shape[1]
    shared = spark.sparkContext.broadcast((np.array(ids), asked))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, questions = shared.value
        best, place = _nothing(), {}
        for batch in batches:
            items = batch.column(1).to_numpy()
            best = _better(best, questions, items, _numbers(batch.column(2), width), k + 1, digits)
            kept = set(best[1].tolist())
            place = {i: x for i, x in [*place.items(), *zip(items.tolist(), batch.column(0).to_pylist())] if i in kept}
        row, item, score = best
        other = names[row] != item if len(row) else np.empty(0, dtype=bool)
        row, item, score = row[other], item[other], score[other]
        yield pa.RecordBatch.from_arrays(
            [pa.array(row, pa.int64()), pa.array(item, pa.int64()), pa.array(score, pa.float64()), pa.array([place[i] for i in item.tolist()], pa.int32())],
            names=["question", "item_id", "score", "list"],
        )

    found = index.select("list", F.col("item_id").cast("long"), "vector").mapInArrow(scan, "question long, item_id long, score double, list int")
    best = Window.partitionBy("question").orderBy(F.col("score").desc(), "item_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _vectors(table: DataFrame, key: str, vector: str, name: str, cosine: bool) -> DataFrame:
    """``name, vector`` of the rows that have a vector, of length one if the cosine counts."""

    @F.pandas_udf("array<double>")
    def unit(column: pd.Series) -> pd.Series:
        return pd.Series(list(_unit(np.stack(column.to_numpy()).astype("float64"))) if len(column) else [], index=column.index, dtype=object)

    rows = table.select(F.col(key).alias(name), F.col(vector).cast("array<double>").alias("vector")).where(F.col("vector").isNotNull())
    return rows.withColumn("vector", unit("vector")) if cosine else rows


def build_index(
    items: DataFrame,
    item: str,
    vector: str,
    cosine: bool = True,
    lists: int | None = None,
    recall: float = 0.95,
    k: int = 10,
    sample_rows: int = SAMPLE_ROWS,
    part_rows: int = PART_ROWS,
    seed: int = 0,
) -> VectorIndex:
    """Index every row that has a vector; all vectors have one length, item ids are integers and none is null.

    ``lists`` (by default the square root of the rows) is at most ``sample_rows / 32``. The centroids are fitted on at most
    ``sample_rows`` rows, fewer if they are long, the only thing besides 256 questions that the driver holds. ``probes`` is the smallest number of lists that gave
    these questions ``recall`` of their ``k`` nearest other items; on data without any clusters it comes close to all lists.
    Two passes over the items: one that deals them, one that searches the questions exactly. The stored items survive lost executors.
    """
    spark = items.sparkSession
    rows = _vectors(items, item, vector, "item_id", cosine)
    count, width = items.where(F.col(vector).isNotNull()).agg(F.count(F.lit(1)), F.max(F.size(vector))).first()
    if not count:
        empty = rows.withColumn("list", F.lit(0)).select("list", "item_id", "vector")
        return VectorIndex(empty, spark.createDataFrame([], "list int, rows long, parts int"), np.zeros((1, 0)), cosine, 1, 1.0)
    sample_rows = max(SAMPLE_PER_LIST, min(sample_rows, SAMPLE_BYTES // (8 * max(1, width))))
    lists = max(1, min(lists or math.isqrt(count), sample_rows // SAMPLE_PER_LIST, count))
    _, sample = _sample(rows, count, min(count, lists * SAMPLE_PER_LIST), seed)
    lists = min(lists, len(sample))
    centroids = _fit(sample, lists, FIT_ROUNDS)
    shared = spark.sparkContext.broadcast(centroids)

    @F.pandas_udf("int")
    def nearest_list(column: pd.Series) -> pd.Series:
        return pd.Series(_order(np.stack(column.to_numpy()), shared.value, 1)[:, 0] if len(column) else [], index=column.index, dtype="int32")

    path = scratch_path(spark, "vector-index")
    dealt = rows.withColumn("list", nearest_list("vector"))
    # a list is a folder, so that lists nobody asks for are not read; long ones are written by several tasks
    salt = F.pmod(F.xxhash64("item_id"), F.lit(max(1, math.ceil(count / (lists * part_rows)))))
    dealt.repartition("list", salt).write.partitionBy("list").parquet(path)
    schema = T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType())])
    stored = spark.read.schema(schema).parquet(path).select("list", "item_id", "vector")
    sizes = stored.groupBy("list").agg(F.count(F.lit(1)).alias("rows"))
    parts = materialize(sizes.withColumn("parts", F.ceil(F.col("rows") / part_rows).cast("int")), "index-parts")

    ids, asked = _sample(rows, count, min(count, CALIBRATION), seed + 1)
    found = _exact(stored, ids, asked, k, 9).select("question", "list").collect()
    place = np.argsort(_order(asked, centroids, lists), axis=1)
    needed = np.sort([place[r["question"], r["list"]] for r in found]) + 1
    probes = int(needed[min(len(needed), math.ceil(recall * len(needed))) - 1]) if len(needed) else 1
    reached = float((needed <= probes).mean()) if len(needed) else 1.0
    return VectorIndex(stored, parts, centroids, cosine, probes, reached)


def search_index(
    index: VectorIndex, questions: DataFrame, question: str, vector: str, k: int, probes: int | None = None, digits: int = 9
) -> DataFrame:
    """``question_id, item_id, score, rank`` as ``nearest`` gives them, from the ``probes`` nearest lists of each question.

    With as many probes as lists the result is exact. Questions without a vector have no hits. A question's vector travels once per part of its lists,
    an item once if anyone asks for its list; a task holds one part and streams the questions past it.
    """
    k = max(1, k)
    asked = _vectors(questions, question, vector, "question_id", index.cosine)
    most = min(probes or index.probes, len(index.centroids))
    shared = index.items.sparkSession.sparkContext.broadcast(index.centroids)
    width = index.centroids.shape[1]

    @F.pandas_udf("array<int>")
    def nearest_lists(column: pd.Series) -> pd.Series:
        return pd.Series(list(_order(np.stack(column.to_numpy()), shared.value, most)) if len(column) and width else [[]] * len(column), index=column.index, dtype=object)

    asked = materialize(asked.withColumn("lists", nearest_lists("vector")), "questions")
    # one row per list at most, hence the broadcasts
    wanted = asked.select(F.explode("lists").alias("list")).distinct()
    parts = F.broadcast(index.parts.select("list", "parts"))
    place = F.pmod(F.xxhash64("item_id"), F.col("parts")).cast("int")
    stored = index.items.join(F.broadcast(wanted), "list", "left_semi").join(parts, "list")
    id_types = asked.schema["question_id"].dataType, index.items.schema["item_id"].dataType
    left = stored.select(
        "list", place.alias("part"), F.lit(0).alias("kind"), F.lit(None).cast(id_types[0]).alias("question_id"), "item_id", "vector"
    )
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    right = asked.select("question_id", "vector", F.explode("lists").alias("list")).join(parts, "list")
    right = right.select("list", every.alias("part"), F.lit(1), "question_id", F.lit(None).cast(id_types[1]), "vector")
    schema = T.StructType(
        [T.StructField("question_id", id_types[0]), T.StructField("item_id", id_types[1]), T.StructField("score", T.DoubleType())]
    )
    arrow = to_arrow_schema(schema)

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, vectors = None, [], []
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("list", "part", "kind")])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                cell, kind = (int(keys[0, a]), int(keys[1, a])), keys[2, a]
                if cell != current:
                    current, ids, vectors = cell, [], []
                if kind == 0:
                    ids.append(part.column("item_id").to_numpy())
                    vectors.append(_numbers(part.column("vector"), width))
                elif ids:
                    if len(ids) > 1:
                        ids, vectors = [np.concatenate(ids)], [np.concatenate(vectors)]
                    names = part.column("question_id")
                    row, item, score = _better(_nothing(), _numbers(part.column("vector"), width), ids[0], vectors[0], k, digits)
                    columns = [names.take(pa.array(row)), pa.array(item, arrow.field(1).type), pa.array(score, pa.float64())]
                    yield pa.RecordBatch.from_arrays(columns, names=arrow.names)

    met = left.unionAll(right).repartition("list", "part").sortWithinPartitions("list", "part", "kind")
    best = Window.partitionBy("question_id").orderBy(F.col("score").desc(), F.col("item_id"))
    return met.mapInArrow(meet, schema).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
