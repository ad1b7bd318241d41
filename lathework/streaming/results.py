"""Structured Streaming jobs: results as they arrive, running means, latest status."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lathework.operators.ordering import keep_last
from lathework.session import path_children


def read_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 64) -> DataFrame:
    """Files of a folder as they appear, a bounded number per batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(
    stream: DataFrame, step: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, interval: str | None = None
) -> StreamingQuery:
    """Apply ``step`` and append its rows to Parquet; with an ``interval`` run on, else drain and stop."""
    writer = step(stream).writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start(path)


def running_mean(
    stream: DataFrame, by: Sequence[str], value: str, weight: str, publish: Callable[[DataFrame, int], None], checkpoint: str
) -> StreamingQuery:
    """Weighted mean so far per key, NULL and NaN values left out; the state is two sums, ``publish`` gets the whole table each batch."""
    valid = F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))
    sums = stream.groupBy(*by).agg(
        F.sum(F.when(valid, F.col(value) * F.col(weight))).alias("__s"), F.sum(F.when(valid, F.col(weight))).alias("weight")
    )
    means = sums.select(
        *by, "weight", F.when(F.col("weight") > 0, F.col("__s") / F.col("weight")).otherwise(F.col("__s")).alias("mean")
    )
    return (
        means.writeStream.outputMode("complete")
        .foreachBatch(publish)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def settled_files(spark: SparkSession, path: str, as_of: Column, age: str = "1 minute", glob: str = "*") -> DataFrame:
    """Files that have not changed for a while (the rest are picked up by a later run)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.where(F.col("modificationTime") <= as_of - F.expr(f"INTERVAL {age}")).select(
        "path", "modificationTime", "length"
    )


def publish_settled(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    out: str,
    run_id: int,
    as_of: datetime,
    age: timedelta = timedelta(minutes=1),
) -> None:
    """Publish the rows of files that have settled and were not published before.

    Unsettled files are pruned at the listing and wait for a later run. A run writes its rows, then its part of the ledger (one row per file), then
    the marker. Only what the ledger names counts as published, so a run reads the ledgers of earlier runs, a row per file, and never their rows. A repeated
    run overwrites its own folders; one that failed before its ledger was written leaves rows that ``published`` does not show and a later run publishes anew.
    """
    meta = F.col("_metadata")
    cut = F.lit(as_of - age)
    rows = (
        spark.read.schema(schema)
        .parquet(path)
        .select("*", meta["file_path"].alias("source_file"), meta["file_modification_time"].alias("changed_at"))
        .where(F.col("changed_at") <= cut)
    )
    rows = rows.join(ledger(spark, out).where(F.col("run_id") < run_id), "source_file", "left_anti")
    target = f"{out}/run_id={run_id}"
    rows.write.mode("overwrite").parquet(target)
    files = spark.read.schema(rows.schema).parquet(target).groupBy("source_file").agg(
        F.max("changed_at").alias("changed_at"), F.count(F.lit(1)).alias("rows")
    )
    files.write.mode("overwrite").parquet(f"{out}/_ledger/run_id={run_id}")
    latest = spark.range(1).select(F.lit(run_id).cast("bigint").alias("latest_run"))
    latest.write.mode("overwrite").json(f"{out}/_latest")


def ledger(spark: SparkSession, out: str) -> DataFrame:
    """``source_file, changed_at, rows, run_id`` of every published file."""
    schema = "source_file string, changed_at timestamp, rows long, run_id int"
    runs = [name for name in path_children(spark, f"{out}/_ledger") if name.startswith("run_id=")]
    if not runs:
        return spark.createDataFrame([], schema)
    # a folder without a success marker belongs to a run that did not finish
    done = [f"{out}/_ledger/{name}" for name in runs if "_SUCCESS" in path_children(spark, f"{out}/_ledger/{name}")]
    return spark.read.schema(schema).option("basePath", f"{out}/_ledger").parquet(*done) if done else spark.createDataFrame([], schema)


def published(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """The rows of all runs in the ledger, with ``source_file`` and ``run_id``."""
    whole = T.StructType([*schema.fields, T.StructField("source_file", T.StringType()), T.StructField("run_id", T.IntegerType())])
    runs = sorted(r["run_id"] for r in ledger(spark, out).select("run_id").distinct().collect())  # one row per run
    if not runs:
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", out).parquet(*[f"{out}/run_id={n}" for n in runs])


def latest_run(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema("latest_run bigint").json(f"{out}/_latest")


def publish_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each batch to a writer until the folder is drained."""
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def latest_status(updates: DataFrame, key: str, at: Sequence[str]) -> DataFrame:
    """The last update of each job."""
    return keep_last(updates, [key], at)


def append_status(path: str, key: str, at: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """A batch writer that stores the last update per key of each batch; its cost follows the batch alone.

    A repeated batch overwrites its own folder.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        keep_last(batch, [key], at).write.mode("overwrite").parquet(f"{path}/updates/batch_id={batch_id}")

    return write


def _status_parts(spark: SparkSession, path: str, schema: T.StructType, upto: int | None = None) -> DataFrame:
    """The newest compacted table and the batches after it (those up to ``upto``, if given)."""
    parts = spark.read.schema(schema).option("basePath", f"{path}/updates").parquet(f"{path}/updates/batch_id=*")
    if upto is not None:
        parts = parts.where(F.col("batch_id") <= upto)
    done = [int(name.removeprefix("upto=")) for name in path_children(spark, f"{path}/compacted")]
    done = [number for number in done if upto is None or number < upto]
    if not done:
        return parts.drop("batch_id")
    base = spark.read.schema(schema).parquet(f"{path}/compacted/upto={max(done)}")
    return base.unionByName(parts.where(F.col("batch_id") > max(done)).drop("batch_id").select(*base.columns))


def current_status(spark: SparkSession, path: str, schema: T.StructType, key: str, at: Sequence[str]) -> DataFrame:
    """The last update per key over all batches."""
    return keep_last(_status_parts(spark, path, schema), [key], at)


def compact_status(spark: SparkSession, path: str, schema: T.StructType, key: str, at: Sequence[str], upto: int) -> None:
    """Fold the batches up to ``upto`` into one table; later reads start from it.

    Run it for finished batches (batch ids only grow). Folders that were folded in may then be removed.
    """
    folded = keep_last(_status_parts(spark, path, schema, upto), [key], at)
    folded.write.mode("overwrite").parquet(f"{path}/compacted/upto={upto}")
