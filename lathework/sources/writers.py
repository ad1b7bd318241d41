"""Writers and small report tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.session import path_object


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON Lines with explicit nulls."""
    df.write.option("ignoreNullFields", "false").json(path)


def write_splits(df: DataFrame, path: str, split: str = "split", mode: str = "errorifexists") -> None:
    """One Parquet folder per split; an empty split leaves none."""
    df.withColumnRenamed(split, "split").write.mode(mode).partitionBy("split").parquet(path)


def write_csv_quoted(df: DataFrame, path: str) -> None:
    """CSV with a header and every field quoted."""
    df.write.option("quoteAll", "true").option("escape", '"').csv(path, header=True)


def write_texts(df: DataFrame, path: str, text: str) -> None:
    """One ``.txt`` file per row: the text and a line break, in a folder for each task.

    Files are created through ``pyarrow.fs`` (local or mounted folders, S3, GCS, HDFS with its client library), as Hadoop's local file system starts a
    process for the mode of each. A task writes to a folder of its attempt; those of attempts that won, and that alone, lose their underscore.
    """
    spark = df.sparkSession
    files, folder = path_object(spark, path)
    base = folder.makeQualified(files.getUri(), files.getWorkingDirectory()).toString().rstrip("/")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri("file:///" + base[6:].lstrip("/") if base.startswith("file:/") else base)
        name, n = f"_{uuid.uuid4().hex}", 0
        for batch in batches:
            if not n:
                store.create_dir(f"{root}/{name}", recursive=True)
            for start in range(0, len(batch), 64):
                for value in batch.column(0).slice(start, 64).to_pylist():
                    with store.open_output_stream(f"{root}/{name}/{n:09}.txt") as out:
                        out.write(f"{value or ''}\n".encode())
                    n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.string())], names=["name"])

    files.mkdirs(folder)
    won = df.select(F.col(text).alias("text")).mapInArrow(run, "name string").collect()  # a row per task
    for name in (row["name"] for row in won):
        if not files.rename(path_object(spark, f"{path}/{name}")[1], path_object(spark, f"{path}/{name[1:]}")[1]):
            raise OSError(f"{path}/{name} could not be renamed")


def write_tsv(df: DataFrame, path: str) -> None:
    """Tab-separated without a header."""
    df.write.csv(path, sep="\t", header=False)


def append_run(df: DataFrame, path: str) -> None:
    """Add result rows to a shared run table."""
    df.write.mode("append").parquet(path)


def store_runs(rows: DataFrame, path: str, keys: Sequence[str]) -> None:
    """Append the rows of some runs to a table; a run that is there already is replaced, all others stay.

    ``keys`` name a run; each is a folder, and only the folders of ``rows`` are overwritten, so that a repeated or retried run changes nothing.
    """
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def read_runs(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """The stored table, in the columns of ``rows``."""
    return spark.read.schema(rows.schema).parquet(path).select(*rows.columns)


def write_run(
    results: DataFrame, summary: DataFrame, path: str, run_id: str,
    config: Mapping[str, object] | None = None, prompts: Mapping[str, str] | None = None,
) -> None:
    """What a run leaves behind: results and their one-row summary, and its settings and prompt templates if given.

    They lie under ``results/run_id=...``, ``summary/...``, ``config/...`` (one row) and ``prompts/...`` (``name, template``, a row for each). A run that is
    written again replaces itself.
    """
    spark = results.sparkSession
    tables = {"results": results, "summary": summary}
    if config is not None:
        # values of any kind that JSON has; one row
        tables["config"] = spark.range(1).select(F.lit(json.dumps(config, ensure_ascii=False, sort_keys=True)).alias("value"))
    if prompts is not None:
        tables["prompts"] = spark.createDataFrame(sorted(prompts.items()), "name string, template string")
    for name, table in tables.items():
        writer = table.write.mode("overwrite")
        target = f"{path}/{name}/run_id={run_id}"
        writer.text(target) if name == "config" else writer.option("ignoreNullFields", "false").json(target)


def read_run_records(spark: SparkSession, path: str) -> DataFrame:
    """``run_id, kind, name, value`` of the settings and prompt templates of all runs; a setting that is no text is shown as JSON."""
    config = spark.read.text(f"{path}/config", wholetext=True).select("value", "run_id")
    settings = config.select("run_id", F.explode(F.from_json("value", "map<string,string>")).alias("name", "value"))
    prompts = spark.read.schema("name string, template string, run_id string").json(f"{path}/prompts")
    return settings.select(F.col("run_id").cast("string").alias("run_id"), F.lit("config").alias("kind"), "name", "value").unionByName(
        prompts.select("run_id", F.lit("prompt").alias("kind"), "name", F.col("template").alias("value"))
    )


def preview(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The first ``n`` rows as JSON text; ``n <= 0`` gives none."""
    if n <= 0:
        return df.limit(0).select(F.to_json(F.struct("*")).alias("json"))
    return df.orderBy(*order_by).limit(n).select(F.to_json(F.struct("*")).alias("json"))
