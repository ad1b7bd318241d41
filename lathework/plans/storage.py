"""Queries: readers, writers and streams, run over files that Spark writes from the given tables."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from lathework.operators import inference, scoring
from lathework.operators import messages as M
from lathework.plans.evaluate import count_words, six
from lathework.plans.registry import query, table
from lathework.session import materialize, path_children, path_object, scratch_path
from lathework.sources import readers, synthetic, writers
from lathework.streaming import results as S


@query("load_split", "SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents WHERE lang = 'fr' GROUP BY source")
def load_split(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "splits")
    docs = table(spark, folder, "documents").withColumnRenamed("lang", "split")
    writers.write_splits(docs.select("split", "source", "n_chars"), path)
    chosen = readers.read_split(spark, path, "fr")
    return chosen.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("write_splits", "SELECT lang AS split, doc_id, text FROM documents")
def write_splits(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "splits")
    writers.write_splits(table(spark, folder, "documents").select("doc_id", "text", F.col("lang").alias("split")), path)
    return spark.read.parquet(path)


@query(
    "roundtrip_jsonl",
    "SELECT doc_id, text, CASE WHEN lang <> 'fr' THEN lang END AS lang, source AS first, 'user' AS role FROM documents",
)
def roundtrip_jsonl(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "jsonl")
    docs = table(spark, folder, "documents")
    rows = docs.select(
        "doc_id", "text", F.when(F.col("lang") != "fr", F.col("lang")).alias("lang"), F.array(M.message("user", F.col("source"))).alias("messages")
    )
    writers.write_jsonl(rows, path)
    back = readers.read_json_dir(spark, path, rows.schema, glob="*.json")
    first = F.get("messages", F.lit(0))
    return back.select("doc_id", "text", "lang", first["content"].alias("first"), first["role"].alias("role"))


@query(
    "read_json_mixed",
    """
    SELECT event_id, CASE WHEN event_type = 'view' THEN NULL ELSE event_type END AS event_type FROM events WHERE event_type <> 'error'
    """,
)
def read_json_mixed(spark: SparkSession, folder: str) -> DataFrame:
    """JSON Lines with broken lines and lines that hold no object, array files, and files of one object."""
    path, rows = _mixed(spark, folder)
    return readers.read_json_dir(spark, path, rows.schema, refuse=[".json", ".jsonl"])


def _mixed(spark: SparkSession, folder: str) -> tuple[str, DataFrame]:
    """A folder of ``.jsonl`` and ``.json`` files of all events, and the events."""
    path, staged = scratch_path(spark, "mixed"), scratch_path(spark, "mixed-staged")
    events = table(spark, folder, "events").select("event_id", F.nullif("event_type", F.lit("view")).alias("event_type"))
    good = F.to_json(F.struct("event_id", "event_type"))
    broken = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("{bad "), good)).otherwise(F.concat(F.lit("[1, "), "event_id", F.lit("]")))
    line = F.coalesce(F.when(F.col("event_type") == "error", broken), good)
    # every fifth event goes into one of some arrays, one of each kind into an object of its own, all others into lines
    alone = F.row_number().over(Window.partitionBy("kind", "event_type").orderBy("event_id")) == 1
    placed = events.withColumn("kind", F.when(F.col("event_type") == "error", "lines").otherwise(F.when(F.col("event_id") % 5 == 0, "array").otherwise("lines")))
    placed = placed.withColumn("kind", F.when(alone & (F.col("kind") == "lines") & (F.coalesce("event_type", F.lit("")) != "error"), "object").otherwise(F.col("kind")))
    placed = materialize(placed, "mixed-events")
    arrays = placed.where("kind = 'array'").groupBy((F.col("event_id") % 16).alias("file"))
    objects = placed.where("kind = 'object'").select(good.alias("value"))
    parts = {
        "jsonl": placed.where("kind = 'lines'").select(line.alias("value")),
        "arrays": arrays.agg(F.to_json(F.collect_list(F.struct("event_id", "event_type"))).alias("value")).select("value"),
        "objects": objects,
    }
    files, target = path_object(spark, path)
    files.mkdirs(target)
    for name, part in parts.items():
        part.write.option("maxRecordsPerFile", 0 if name == "jsonl" else 1).text(f"{staged}/{name}")
        ending = "jsonl" if name == "jsonl" else "json"
        for n, file in enumerate(f for f in path_children(spark, f"{staged}/{name}") if f.endswith(".txt")):
            files.rename(path_object(spark, f"{staged}/{name}/{file}")[1], path_object(spark, f"{path}/{name}-{n}.{ending}")[1])
    return path, events


@query(
    "read_json_counts",
    """
    SELECT count(*) AS records, count(*) FILTER (event_type = 'error') AS bad, count(*) FILTER (event_type <> 'error') AS "rows" FROM events
    """,
)
def read_json_counts(spark: SparkSession, folder: str) -> DataFrame:
    """What the reader reports of all records, in the pass that counts its rows."""
    path, rows = _mixed(spark, folder)
    seen = Observation()
    read = readers.read_json_dir(spark, path, rows.schema, refuse=[".json", ".jsonl"], seen=seen)
    counted = materialize(read.agg(F.count(F.lit(1)).alias("rows")), "json-rows")
    told = seen.get
    return counted.select(*[F.lit(told[name]).cast("bigint").alias(name) for name in ("records", "bad")], "rows")


@query("roundtrip_csv", "SELECT doc_id, text, lang, n_chars FROM documents")
def roundtrip_csv(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang", "n_chars")
    writers.write_csv_quoted(docs, path)
    return readers.read_table(spark, path, docs.schema, multi_line=True)


@query("roundtrip_tsv", "SELECT c_custkey, c_name, c_mktsegment, c_acctbal FROM customer")
def roundtrip_tsv(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "tsv")
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    writers.write_tsv(customers, path)
    return readers.read_table(spark, path, customers.schema, sep="\t", header=False)


@query(
    "append_runs",
    """
    SELECT l_returnflag AS run, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY l_returnflag
    UNION ALL SELECT l_linestatus, count(*), CAST(sum(l_quantity) AS BIGINT) FROM lineitem GROUP BY l_linestatus
    """,
)
def append_runs(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "runs")
    for column in ("l_returnflag", "l_linestatus"):
        rows = table(spark, folder, "lineitem").groupBy(F.col(column).alias("run"))
        writers.append_run(
            rows.agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("bigint").alias("quantity")), path
        )
    return spark.read.parquet(path)


@query("read_wholetext", "SELECT doc_id, text FROM documents")
def read_wholetext(spark: SparkSession, folder: str) -> DataFrame:
    """One text file per document, read back whole."""
    path = scratch_path(spark, "texts")
    docs = table(spark, folder, "documents", costly=True)
    named = docs.select(F.concat_ws("\n", F.col("doc_id").cast("string"), "text").alias("text"))
    writers.write_texts(named, path, "text")
    texts = readers.read_documents(spark, path, recursive=True)
    head = F.substring_index("text", "\n", 1)
    # the writer ends each file with a line break
    body = F.substr("text", F.length(head) + 2, F.length("text") - F.length(head) - 2)
    return texts.select(head.cast("bigint").alias("doc_id"), body.alias("text"))


@query(
    "read_log_lines",
    "SELECT event_id, event_id || ' ' || event_type AS line, true AS in_order FROM events",
)
def read_log_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Logs of consecutive events: within a file, line number and event number differ by a constant."""
    path = scratch_path(spark, "logs")
    events = table(spark, folder, "events").repartitionByRange("event_id").sortWithinPartitions("event_id")
    events.select(F.concat_ws(" ", "event_id", "event_type").alias("line")).write.text(path)
    lines = readers.read_log_lines(spark, path).withColumn(
        "event_id", F.regexp_extract("line", r"^(\d+)", 1).cast("bigint")
    )
    starts = lines.groupBy("path").agg(F.min("event_id").alias("start"))
    in_order = F.col("event_id") - F.col("line_number") == F.col("start")
    return lines.join(starts, "path").select("event_id", "line", in_order.alias("in_order"))


@query(
    "write_eval_run",
    """
    SELECT doc_id, quality, 'run-1' AS run_id, (SELECT round(avg(quality), 6) FROM labels) AS mean FROM labels
    """,
)
def write_eval_run(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "eval")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    writers.write_run(labels, scoring.mean_summary(labels, ["quality"], digits=6), path, "run-1")
    summary = spark.read.schema("quality double, run_id string").json(f"{path}/summary")
    back = spark.read.schema("doc_id bigint, quality int, run_id string").json(f"{path}/results")
    means = summary.select("run_id", F.col("quality").alias("mean"))
    return back.join(means, "run_id").select("doc_id", "quality", "run_id", "mean")


@query(
    "write_run_records",
    """
    WITH n AS (SELECT CAST(count(*) AS VARCHAR) AS c, quality FROM labels WHERE quality IS NOT NULL GROUP BY quality)
    SELECT 'q' || quality AS run_id, 'config' AS kind, 'rows' AS name, c AS value FROM n
    UNION ALL SELECT 'q' || quality, 'config', 'metrics', '["quality"]' FROM n
    UNION ALL SELECT 'q' || quality, 'prompt', 'judge', 'Rate "{text}"' || chr(10) || 'in ' || c || ' rows' FROM n
    """,
)
def write_run_records(spark: SparkSession, folder: str) -> DataFrame:
    """A run for each grade of the labels, each written twice, with its settings and prompt templates."""
    path = scratch_path(spark, "eval")
    labels = table(spark, folder, "labels").select("doc_id", "quality").where("quality is not null")
    grades = labels.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per grade
    for grade in [*grades, *grades]:
        rows = labels.where(F.col("quality") == grade["quality"])
        config = {"rows": grade["n"], "metrics": ["quality"]}
        prompts = {"judge": 'Rate "{text}"\nin %d rows' % grade["n"]}
        writers.write_run(rows, scoring.mean_summary(rows, ["quality"]), path, f"q{grade['quality']}", config, prompts)
    return writers.read_run_records(spark, path)


@query(
    "preview_json",
    """
    SELECT '{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}' AS json FROM documents ORDER BY doc_id LIMIT 20
    """,
)
def preview_json(spark: SparkSession, folder: str) -> DataFrame:
    return writers.preview(table(spark, folder, "documents").select("doc_id", "lang", "source"), 20, ["doc_id"])


@query(
    "join_binary_paths",
    "SELECT source, count(*) AS lines, CAST(sum(octet_length(encode(replace(text, chr(10), ' '))) + 1) AS BIGINT) AS bytes FROM documents GROUP BY source",
)
def join_binary_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Files addressed by their path relative to the table; the bytes are counted, not decoded."""
    path = scratch_path(spark, "payload")
    flat = F.replace("text", F.lit("\n"), F.lit(" "))
    table(spark, folder, "documents").select("source", flat.alias("line")).write.partitionBy("source").text(path)
    relative = F.regexp_extract(F.col("_metadata.file_path"), "(source=[^/]+/[^/]+)$", 1)
    index = spark.read.text(path).groupBy(relative.alias("path")).agg(F.count(F.lit(1)).alias("lines"))
    joined = readers.join_binaries(index, "path", path, "*.txt")
    source = F.regexp_extract("path", "source=([^/]+)/", 1)
    return joined.groupBy(source.alias("source")).agg(F.sum("lines").alias("lines"), F.sum("length").alias("bytes"))


@query(
    "gen_long_random",
    """
    WITH k AS (SELECT doc_id, role, '0:' || doc_id || ':' || role AS key FROM documents, (SELECT unnest(['user', 'assistant']) AS role)),
    b AS (SELECT doc_id, role, n, substr(to_base64(unhex(md5(key || ':' || n))), 1, 21) AS part FROM k, (SELECT unnest(range(563)) AS n))
    SELECT doc_id, role, substr(replace(replace(string_agg(part, '' ORDER BY n), '+', ' '), '/', ''), 1, 8192) AS content
    FROM b GROUP BY doc_id, role
    """,
)
def gen_long_random(spark: SparkSession, folder: str) -> DataFrame:
    return synthetic.long_conversations(table(spark, folder, "documents", costly=True), "doc_id")


def _staged(spark: SparkSession, folder: str, name: str, *columns: str) -> tuple[str, DataFrame]:
    """A table as a folder of several files for a stream to pick up."""
    path = scratch_path(spark, f"stage-{name}")
    df = table(spark, folder, name).select(*columns)
    df.repartition(8).write.parquet(path)
    return path, df


_WORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))"


@query(
    "stream_ingest_results",
    f"""
    SELECT doc_id, CASE WHEN contains(text, '@') THEN '**ERROR**: address in text' ELSE {_WORDS} || ' words' END AS llm_inference
    FROM documents
    """,
)
def stream_ingest_results(spark: SparkSession, folder: str) -> DataFrame:
    staged, df = _staged(spark, folder, "documents", "doc_id", "text")
    out, checkpoint = scratch_path(spark, "answers"), scratch_path(spark, "progress")

    def answer(rows: DataFrame) -> DataFrame:
        asked = rows.select("doc_id", F.array(M.message("user", F.col("text"))).alias("messages"))
        return inference.batch_infer(asked, count_words, "messages").drop("messages")

    S.ingest(S.read_stream(spark, staged, df.schema, files_per_batch=3), answer, out, checkpoint).awaitTermination()
    return spark.read.parquet(out)


@query(
    "stream_running_mean",
    """
    SELECT l_returnflag, CAST(sum(l_linenumber) AS BIGINT) AS weight, round(sum(l_quantity * l_linenumber) / sum(l_linenumber), 6) AS mean
    FROM lineitem GROUP BY l_returnflag
    """,
)
def stream_running_mean(spark: SparkSession, folder: str) -> DataFrame:
    staged, df = _staged(spark, folder, "lineitem", "l_returnflag", "l_quantity", "l_linenumber")
    out, checkpoint = scratch_path(spark, "means"), scratch_path(spark, "progress")

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    stream = S.read_stream(spark, staged, df.schema, files_per_batch=3)
    S.running_mean(stream, ["l_returnflag"], "l_quantity", "l_linenumber", publish, checkpoint).awaitTermination()
    return spark.read.parquet(out).select("l_returnflag", "weight", six("mean"))


@query(
    "stream_settled_files",
    "SELECT event_type, count(*) AS n, CAST(1 AS INTEGER) AS first_run, CAST(2 AS BIGINT) AS latest_run FROM events GROUP BY event_type",
)
def stream_settled_files(spark: SparkSession, folder: str) -> DataFrame:
    """Three runs: nothing has settled yet, then everything has (as seen in an hour), then nothing is new."""
    staged, df = _staged(spark, folder, "events", "event_id", "event_type")
    out, now = scratch_path(spark, "published"), datetime.now(timezone.utc)
    for run_id, as_of in enumerate([now - timedelta(hours=1), now + timedelta(hours=1), now + timedelta(hours=2)]):
        S.publish_settled(spark, staged, df.schema, out, run_id, as_of)
    counts = S.published(spark, out, df.schema).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.min("run_id").alias("first_run"))
    return counts.withColumn("latest_run", S.latest_run(spark, out).scalar())


@query("latest_status", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS updated_at FROM events GROUP BY user_id")
def latest_status(spark: SparkSession, folder: str) -> DataFrame:
    staged, df = _staged(spark, folder, "events", "user_id", "event_type", "ts", "event_id")
    out, checkpoint = scratch_path(spark, "status"), scratch_path(spark, "progress")
    key, at = "user_id", ["ts", "event_id"]
    stream = S.read_stream(spark, staged, df.schema, files_per_batch=3)
    S.publish_batches(stream, S.append_status(out, key, at), checkpoint).awaitTermination()
    S.compact_status(spark, out, df.schema, key, at, upto=1)
    last = S.current_status(spark, out, df.schema, key, at)
    return last.select("user_id", F.col("event_type").alias("status"), F.col("ts").alias("updated_at"))
