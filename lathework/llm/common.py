"""What the operators of this subpackage share: scratch tables, streams of groups, connected components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.session import path_object, scratch_path


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; only the registered queries use it, operators take a path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def whole_numbers(vector: str, scale: float) -> Column:
    """``floor(scale x component)`` of an array of doubles, as doubles; NULL if a component is null or its product is not finite."""
    scaled = F.transform(vector, lambda x: x * scale)
    sound = F.forall(scaled, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    # beyond 2^53 doubles are whole, and floor() would give a long
    return F.when(sound, F.transform(scaled, lambda y: F.when(F.abs(y) >= 1 << 53, y).otherwise(F.floor(y).cast("double"))))


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it ends; else they stay until the driver happens to collect its garbage."""
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


class Scratch:
    """Tables written to the shared scratch folder, so that a lost executor never loses them.

    ``keep`` writes a table and reads it back, which also cuts its lineage; ``drop`` deletes the ones
    that nothing reads any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._paths: dict[int, tuple[DataFrame, str]] = {}

    def keep(self, df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
        path = scratch_path(self.spark, label)
        with shuffles_removed(self.spark):
            df.write.parquet(path, compression=compression)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        for table in tables:
            _, path = self._paths.pop(id(table), (None, None))
            if path:
                files, folder = path_object(self.spark, path)
                files.delete(folder, True)


def grouped(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal ``keys`` of a sorted stream, whatever batches they came in."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in keys]
        start = 0
        for i, key in enumerate(zip(*columns)):
            if key != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, key
        if batch.num_rows > start:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, with freed memory given back at the end of its task: workers stay alive, idle ones too, beside what runs next."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
            if trim:
                trim(0)

    return wrapped


class Forest:
    """Union-find over the rows of one task."""

    def __init__(self, size: int):
        self.parent = list(range(size))

    def root(self, x: int) -> int:
        parent = self.parent
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node, root`` for every node of an edge list of longs; the root is the component's smallest node.

    Alternating stars: each node hands its larger neighbours, then its smaller ones, to the smallest
    neighbour it knows, until nothing moves. A hub's neighbours stay rows: its minimum is combined
    before the shuffle, and the join back to it is one that adaptive execution splits.
    """
    scratch = Scratch(edges.sparkSession)
    links = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct()
    links = scratch.keep(links, "links")
    seen = None
    while True:
        sums = links.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))
        ).first()
        if seen is not None and tuple(sums) == seen:
            return links.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(
                links.select("lo", "lo").distinct()
            )
        seen = tuple(sums)
        both = links.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(links.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.keep(large.distinct(), "large-star")
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").where("v > m").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        after = scratch.keep(moved.union(small.select("m", "u")).distinct(), "small-star")
        scratch.drop(links, large)
        links = after
