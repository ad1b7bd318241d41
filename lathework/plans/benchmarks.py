"""Queries: tables of benchmark runs, logs, serving latencies and scene metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.functions.text import duration_seconds, duration_text, millions_text
from lathework.operators import benchruns as B
from lathework.operators import mixing, records, sketches
from lathework.operators.ordering import quantiles, with_row_index
from lathework.plans.evaluate import six
from lathework.plans.registry import query, table
from lathework.session import scratch_path
from lathework.sources import writers


def scenario_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Parts as scenarios; suppliers, by position, as the result files of the first of them.

    Suppliers of even balance report latencies, the others throughput.
    """
    scenarios = with_row_index(table(spark, folder, "part").select("p_partkey", "p_size", "p_brand"), ["p_partkey"], name="row")
    balance = F.abs("s_acctbal")
    results = with_row_index(table(spark, folder, "supplier"), ["s_suppkey"], name="row").select(
        "row",
        "s_suppkey",
        F.lit("overridden").alias("p_brand"),
        F.when(F.col("s_nationkey") % 2 == 0, balance / 1000).alias("avg_latency"),
        F.create_map(F.lit("90"), balance / 500, F.lit("99"), balance / 250).alias("percentiles"),
        (balance * 3).alias("tokens_per_second"),
        (balance / 7 + 1).alias("elapsed_time"),
        (F.col("s_suppkey") + 1).alias("prompts"),
    )
    return B.scenario_results(scenarios, results, "row")


_RUNS = """
    scenarios AS (SELECT p_partkey, p_size, p_brand, row_number() OVER (ORDER BY p_partkey) - 1 AS row FROM part),
    results AS (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS row, abs(s_acctbal) AS b, s_nationkey FROM supplier),
    runs AS (SELECT * FROM scenarios JOIN results USING (row))
"""


@query("scenario_results", f"WITH {_RUNS} SELECT row, p_partkey, p_size, p_brand, s_suppkey, s_suppkey + 1 AS prompts FROM runs")
def scenario_results(spark: SparkSession, folder: str) -> DataFrame:
    return scenario_runs(spark, folder).select("row", "p_partkey", "p_size", "p_brand", "s_suppkey", "prompts")


@query(
    "latency_summary",
    f"""
    WITH {_RUNS}
    SELECT row, p_brand, round(b / 1000 * 1000, 6) AS avg_latency_ms, round(b / 500 * 1000, 6) AS p90_latency_ms,
           round(b / 250 * 1000, 6) AS p99_latency_ms, round(b / 1000 / p_size * 1000, 6) AS avg_latency_per_token_ms
    FROM runs WHERE s_nationkey % 2 = 0
    """,
)
def latency_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = B.latency_summary(scenario_runs(spark, folder), "avg_latency", "percentiles", "p_size", ["row", "p_brand"])
    names = ["avg_latency_ms", "p90_latency_ms", "p99_latency_ms", "avg_latency_per_token_ms"]
    return rows.select("row", "p_brand", *[six(n) for n in names])


@query(
    "throughput_summary",
    f"""
    WITH {_RUNS}
    SELECT row, p_brand, CAST(trunc(b * 3) AS BIGINT) AS total_tokens_per_s,
           CAST(trunc((s_suppkey + 1) * p_size / (b / 7 + 1)) AS BIGINT) AS generated_tokens_per_s,
           round((s_suppkey + 1) / (b / 7 + 1), 6) AS requests_per_s, round(b / 7 + 1, 6) AS elapsed_s,
           CAST((s_suppkey + 1) * p_size AS BIGINT) AS total_tokens
    FROM runs WHERE s_nationkey % 2 <> 0
    """,
)
def throughput_summary(spark: SparkSession, folder: str) -> DataFrame:
    runs = scenario_runs(spark, folder).withColumns(
        {"requests": F.col("prompts") / F.col("elapsed_time"), "tokens": F.col("prompts") * F.col("p_size")}
    )
    rows = B.throughput_summary(
        runs, "avg_latency", "tokens_per_second", "elapsed_time", "prompts", "p_size", ["row", "p_brand"], "requests", "tokens"
    )
    return rows.select(
        "row", "p_brand", "total_tokens_per_s", "generated_tokens_per_s", six("requests_per_s"), six("elapsed_s"), "total_tokens"
    )


def token_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as tokens: a request is a user's day, sent at midnight, served by one of three models."""
    day = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz")
    return table(spark, folder, "events").select(
        F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"), "user_id", day.alias("day"), "ts", "event_id"
    )


_METRICS = """
    tokens AS (SELECT 'm' || (user_id % 3) AS model, user_id, date_trunc('day', ts)::TIMESTAMP AS day, ts, event_id FROM events),
    gaps AS (SELECT model, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, day ORDER BY ts, event_id))) / 1000.0::DOUBLE AS x
             FROM tokens),
    requests AS (SELECT model, user_id, day, count(*) AS n, epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS b, epoch_us(day) AS s
                 FROM tokens GROUP BY model, user_id, day),
    long AS (SELECT model, 'gap_ms' AS metric, x FROM gaps
             UNION ALL SELECT model, 'ttft_ms', (a - s) / 1000.0::DOUBLE FROM requests
             UNION ALL SELECT model, 'e2e_ms', (b - s) / 1000.0::DOUBLE FROM requests
             UNION ALL SELECT model, 'tpot_ms', CASE WHEN n > 1 THEN (b - a) / 1000.0::DOUBLE / (n - 1) END FROM requests)
"""


def _serving_values(spark: SparkSession, folder: str) -> DataFrame:
    """One long table of the values of all metrics, with the day they belong to as their run."""
    tokens = token_log(spark, folder)
    request = ["model", "user_id", "day"]
    gaps = B.token_gaps(tokens, request, "ts", ["event_id"])
    requests = B.request_latencies(tokens, request, "ts", "day")
    run = F.date_format("day", "yyyy-MM-dd").alias("run")
    return mixing.concat(
        gaps.select("model", F.lit("gap_ms").alias("metric"), F.col("gap_ms").alias("x"), "event_id", run),
        requests.unpivot(["model", "user_id", "day"], ["ttft_ms", "e2e_ms", "tpot_ms"], "metric", "x").select(
            "model", "metric", "x", F.xxhash64("user_id", "day").alias("event_id"), run
        ),
    )


@query(
    "serving_percentiles",
    f"""
    WITH {_METRICS}
    SELECT model, metric, count(x) AS n, round(avg(x), 3) AS mean, round(quantile_cont(x, 0.5), 3) AS median,
           round(quantile_cont(x, 0.99), 3) AS p99
    FROM long GROUP BY model, metric
    """,
)
def serving_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    values = mixing.freeze(_serving_values(spark, folder))  # written once because it is read twice
    levels = quantiles(values, ["model", "metric"], "x", B.SERVING_LEVELS, ["event_id"])
    means = values.groupBy("model", "metric").agg(F.count("x").alias("n"), F.round(F.avg("x"), 3).alias("mean"))
    return means.join(levels, ["model", "metric"]).select(
        "model", "metric", "n", "mean", *[F.round(c, 3).alias(c) for c in B.SERVING_LEVELS]
    )


@query(
    "serving_percentiles_merged",
    f"""
    WITH {_METRICS}
    SELECT model, metric, count(x) AS n, round(avg(x), 3) AS mean, round(min(x), 3) AS least, round(max(x), 3) AS most,
           true AS median, true AS p99
    FROM long GROUP BY model, metric
    """,
)
def serving_percentiles_merged(spark: SparkSession, folder: str) -> DataFrame:
    """A sketch for each day, model and metric, stored by day, one day stored again, then merged; are the quantiles within the error of their rank?"""
    values = mixing.freeze(_serving_values(spark, folder))
    daily = sketches.sketch_values(values, ["run", "model", "metric"], "x")
    path = scratch_path(spark, "serving-sketches")
    writers.store_runs(daily, path, ["run"])
    again = values.where(F.col("run") == values.agg(F.min("run")).scalar())
    writers.store_runs(sketches.sketch_values(again, ["run", "model", "metric"], "x"), path, ["run"])
    merged = sketches.merged_quantiles(writers.read_runs(spark, path, daily), ["model", "metric"], B.SERVING_LEVELS)
    errors = sketches.rank_errors(values, ["model", "metric"], "x", merged, B.SERVING_LEVELS)
    return merged.drop(*B.SERVING_LEVELS).join(errors, ["model", "metric"]).select(
        "model",
        "metric",
        "n",
        F.round(F.col("total") / F.col("n"), 3).alias("mean"),
        *[F.round(c, 3).alias(c) for c in ("least", "most")],
        *[(F.col(c) <= sketches.RANK_ERROR).alias(c) for c in B.SERVING_LEVELS],
    )


@query(
    "serving_rates",
    """
    WITH tokens AS (SELECT 'm' || (user_id % 3) AS model, user_id, date_trunc('day', ts)::TIMESTAMP AS day, ts FROM events)
    SELECT model, count(DISTINCT (user_id, day)) AS requests, count(*) AS tokens,
           round(count(DISTINCT (user_id, day)) / ((epoch_us(max(ts)) - epoch_us(min(day))) / 1000000.0::DOUBLE), 9) AS requests_per_s,
           round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(day))) / 1000000.0::DOUBLE), 9) AS tokens_per_s
    FROM tokens GROUP BY model
    """,
)
def serving_rates(spark: SparkSession, folder: str) -> DataFrame:
    return B.serving_rates(token_log(spark, folder), ["model"], ["user_id", "day"], "ts", "day")


BANDS = {"p1": 0.01, "p5": 0.05, "p10": 0.1, "p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


@query(
    "quantile_bands",
    "SELECT l_returnflag, "
    + ", ".join(f"round(quantile_cont(l_extendedprice, {p}), 4) AS {n}" for n, p in BANDS.items())
    + " FROM lineitem GROUP BY l_returnflag",
)
def quantile_bands(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem")
    bands = quantiles(items, ["l_returnflag"], "l_extendedprice", BANDS, ["l_orderkey", "l_linenumber", "l_partkey"])
    return bands.select("l_returnflag", *[F.round(n, 4).alias(n) for n in BANDS])


LOG_PATTERNS = {
    "throughput": r"throughput per GPU \(TFLOP/s/GPU\): ([0-9.]+)",
    "ms_per_step": r"elapsed time per iteration \(ms\): ([0-9.]+)",
    "memory": r"mem usages: ([0-9.]+)",
}


def training_log(spark: SparkSession, folder: str) -> DataFrame:
    """One log line per line item and one run per ship status; some lines carry no numbers."""

    line = F.when(F.col("l_quantity") == 1, F.lit("iteration skipped")).otherwise(
        F.concat(
            F.lit("throughput per GPU (TFLOP/s/GPU): "), F.col("l_quantity"),
            F.lit(" | elapsed time per iteration (ms): "), F.col("l_extendedprice"),
            F.lit(" | mem usages: "), F.col("l_discount"), F.lit(" |"),
        )
    )
    return table(spark, folder, "lineitem", costly=True).select(F.concat("l_returnflag", "l_linestatus").alias("run"), line.alias("line"))


@query(
    "log_metric_means",
    """
    WITH v AS (SELECT l_returnflag || l_linestatus AS run, * FROM lineitem WHERE l_quantity <> 1)
    SELECT run, 'throughput' AS metric, round(avg(l_quantity), 6) AS mean, count(*) AS n FROM v GROUP BY run
    UNION ALL SELECT run, 'ms_per_step', round(avg(l_extendedprice), 6), count(*) FROM v GROUP BY run
    UNION ALL SELECT run, 'memory', round(avg(l_discount), 6), count(*) FROM v GROUP BY run
    """,
)
def log_metric_means(spark: SparkSession, folder: str) -> DataFrame:
    return B.log_means(training_log(spark, folder), "line", LOG_PATTERNS, ["run"]).select("run", "metric", six("mean"), "n")


@query(
    "tokens_per_gpu_s",
    """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
           CASE WHEN l_discount > 0 THEN round(l_quantity * 2048 * 1000 / (l_discount * l_linenumber), 4) END AS tokens_per_gpu_s
    FROM lineitem
    """,
)
def tokens_per_gpu_s(spark: SparkSession, folder: str) -> DataFrame:
    rate = B.tokens_per_gpu(F.col("l_quantity"), F.lit(2048), F.col("l_discount"), F.col("l_linenumber"))
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.round(rate, 4).alias("tokens_per_gpu_s")
    )


def section_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as a section log in event order."""
    i, kind = F.col("event_id"), F.col("event_type")
    line = (
        F.when((i % 20 == 0) & (i % 3 == 0), "Benchmark Banana")
        .when((i % 20 == 0) & (i % 3 == 1), "Benchmark Truck")
        .when(i % 20 == 0, "Benchmark the rasterization process with size (640, 360)")
        .when(kind == "error", "terminate called")
        .when(kind == "view", "  what(): negative dimension")
        .when(kind == "click", F.concat(F.lit("itern_num: "), F.col("user_id")))
        .otherwise(F.concat(F.lit("real\t1m"), F.format_string("%.3f", "value"), F.lit("s")))
    )
    return table(spark, folder, "events").select("event_id", line.alias("line"))


_SECTIONS = r"""
    lines AS (SELECT event_id, CASE WHEN event_id % 20 = 0 AND event_id % 3 = 0 THEN 'Benchmark Banana'
                WHEN event_id % 20 = 0 AND event_id % 3 = 1 THEN 'Benchmark Truck'
                WHEN event_id % 20 = 0 THEN 'Benchmark the rasterization process with size (640, 360)'
                WHEN event_type = 'error' THEN 'terminate called'
                WHEN event_type = 'view' THEN '  what(): negative dimension'
                WHEN event_type = 'click' THEN 'itern_num: ' || user_id
                ELSE 'real' || chr(9) || '1m' || printf('%.3f', value) || 's' END AS line, value FROM events),
    ahead AS (SELECT *, lead(line) OVER (ORDER BY event_id) AS nxt FROM lines),
    kept AS (SELECT event_id, line, value, CASE WHEN starts_with(line, 'Benchmark') THEN 'header'
               WHEN contains(line, 'terminate') AND contains(nxt, 'negative dimension') THEN 'overflow'
               WHEN contains(line, 'terminate') THEN 'error' WHEN starts_with(line, 'real') THEN 'time' ELSE 'other' END AS kind
             FROM ahead WHERE regexp_matches(line, '^Benchmark|itern_num|^real|terminate')),
    placed AS (SELECT *, lag(kind) OVER (ORDER BY event_id) AS before,
                      count(*) FILTER (kind = 'header') OVER (ORDER BY event_id) AS section FROM kept),
    timed AS (SELECT section, (first_value(line) OVER (PARTITION BY section ORDER BY event_id)) AS header,
                     event_id, value, before, kind FROM placed WHERE section > 0),
    cells AS (SELECT section, header, row_number() OVER (PARTITION BY section ORDER BY event_id) - 1 AS cell,
                     round(60 + value, 6) AS seconds,
                     CASE before WHEN 'overflow' THEN 'overflow' WHEN 'error' THEN 'error' ELSE 'ok' END AS status
              FROM timed WHERE kind = 'time')
"""


def _timings(spark: SparkSession, folder: str) -> DataFrame:
    value = F.round(duration_seconds(F.element_at(F.split("line", "\t"), -1)), 6)
    return B.section_timings(section_log(spark, folder), ["event_id"], "line", value)


@query("log_sections", f"WITH {_SECTIONS} SELECT section, header, cell, seconds, status FROM cells")
def log_sections(spark: SparkSession, folder: str) -> DataFrame:
    return _timings(spark, folder)


@query(
    "log_section_cells",
    f"""
    WITH {_SECTIONS},
    shown AS (SELECT section, header, cell, CASE status WHEN 'overflow' THEN -1.0 ELSE seconds END AS s FROM cells)
    SELECT section, header, CASE WHEN max(cell) < 4 THEN 4 ELSE 16 END AS layout, count(*) FILTER (cell >= 16) AS beyond,
           """
    + ", ".join(f"max(s) FILTER (cell = {c}) AS c{c}" for c in range(16))
    + """
    FROM shown GROUP BY section, header
    """,
)
def log_section_cells(spark: SparkSession, folder: str) -> DataFrame:
    """The table of cells with overflows as -1, so that numbers rather than their spelling are compared."""
    shown = B.section_table(_timings(spark, folder), (4, 16))

    def number(c: str):
        return F.when(F.col(c) == "**Memory overflow**", F.lit(-1.0)).otherwise(F.col(c).try_cast("double"))

    return shown.select("section", "header", "layout", "beyond", *[number(f"cell_{i}").alias(f"c{i}") for i in range(16)])


VALUES = ["psnr", "ssim", "mem", "seconds"]


def scene_stats(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Line items as statistics: a scene per supplier, a configuration per status, ranks by line number.

    Unit quantities count as missing memory values.
    """
    items = table(spark, folder, "lineitem").select(
        F.concat(F.lit("scene"), "l_suppkey").alias("scene"),
        F.concat("l_returnflag", "l_linestatus").alias("config"),
        F.col("l_linenumber").alias("rank"),
        F.when(F.col("l_quantity") != 1, F.col("l_quantity")).alias("mem"),
        # whole cents and percents, so that sums are exact in any order
        F.round(F.col("l_extendedprice") * 100).alias("seconds"),
        F.round(F.col("l_discount") * 100).alias("l_discount"),
        F.round(F.col("l_tax") * 100).alias("l_tax"),
    )
    complete = B.complete_groups(items, ["scene", "config"], "rank", 7)
    train = B.rank_average(complete, ["scene", "config"], ["mem", "seconds"])
    validation = (
        items.where(F.col("rank") == 1)
        .groupBy("scene", "config")
        .agg(F.avg("l_discount").alias("psnr"), F.avg("l_tax").alias("ssim"), F.count(F.lit(1)).alias("num_gs"))
    )
    return train, validation


_SCENES = """
    items AS (SELECT 'scene' || l_suppkey AS scene, l_returnflag || l_linestatus AS config, l_linenumber AS rank,
                     CASE WHEN l_quantity <> 1 THEN l_quantity END AS mem, round(l_extendedprice * 100) AS seconds,
                     round(l_discount * 100) AS l_discount, round(l_tax * 100) AS l_tax FROM lineitem),
    complete AS (SELECT scene, config FROM items GROUP BY ALL HAVING count(DISTINCT rank) = 7),
    train AS (SELECT scene, config, avg(mem) AS mem, avg(seconds) AS seconds FROM items JOIN complete USING (scene, config) GROUP BY ALL),
    validation AS (SELECT scene, config, avg(l_discount) AS psnr, avg(l_tax) AS ssim, count(*) AS num_gs FROM items WHERE rank = 1 GROUP BY ALL),
    rows AS (SELECT scene, config, psnr, ssim, mem, seconds FROM train JOIN validation USING (scene, config)),
    metrics AS (SELECT * FROM rows
      UNION ALL SELECT 'Average', config, avg(psnr), avg(ssim), avg(mem), avg(seconds) FROM rows GROUP BY config
      UNION ALL SELECT 'Std', config, stddev_samp(psnr), stddev_samp(ssim), stddev_samp(mem), stddev_samp(seconds) FROM rows GROUP BY config)
"""


@query(
    "scene_metrics",
    f"""
    WITH {_SCENES}
    SELECT scene, config, round(psnr, 6) AS psnr, round(ssim, 6) AS ssim, round(mem, 6) AS mem, round(seconds, 6) AS seconds FROM metrics
    """,
)
def scene_metrics(spark: SparkSession, folder: str) -> DataFrame:
    train, validation = scene_stats(spark, folder)
    metrics = B.scene_metrics(train, validation, ["scene", "config"], "scene", "config", VALUES)
    return metrics.select("scene", "config", *[six(v) for v in VALUES])


@query(
    "report_rows_md",
    f"""
    WITH {_SCENES}, r AS (SELECT config, count(*) AS n, count(mem) AS with_mem FROM rows GROUP BY config)
    SELECT config, '| ' || config || ' | ' || n || ' | ' || CASE WHEN config LIKE 'A%' THEN 'N/A' ELSE with_mem::VARCHAR END || ' |' AS line FROM r
    """,
)
def report_rows_md(spark: SparkSession, folder: str) -> DataFrame:
    train, validation = scene_stats(spark, folder)
    joined = train.join(validation, ["scene", "config"])
    counts = joined.groupBy("config").agg(F.count(F.lit(1)).alias("n"), F.count("mem").alias("with_mem"))
    counts = counts.withColumn("with_mem", F.when(~F.col("config").startswith("A"), F.col("with_mem")))
    return counts.select("config", B.markdown_rows(counts, ["config", "n", "with_mem"]).alias("line"))


@query(
    "complete_ranks_semi",
    """
    WITH g AS (SELECT l_suppkey, l_returnflag, l_linestatus FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_linenumber) = 7)
    SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_linenumber
    FROM lineitem SEMI JOIN g USING (l_suppkey, l_returnflag, l_linestatus)
    """,
)
def complete_ranks_semi(spark: SparkSession, folder: str) -> DataFrame:
    full = B.complete_groups(table(spark, folder, "lineitem"), ["l_suppkey", "l_returnflag", "l_linestatus"], "l_linenumber", 7)
    return full.select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber")


@query(
    "rank_average",
    """
    SELECT l_suppkey, round(avg(CASE WHEN l_quantity > 40 THEN l_quantity END), 6) AS mem, round(avg(round(l_extendedprice * 100)), 6) AS seconds
    FROM lineitem GROUP BY l_suppkey
    """,
)
def rank_average(spark: SparkSession, folder: str) -> DataFrame:
    stats = table(spark, folder, "lineitem").select(
        "l_suppkey",
        F.when(F.col("l_quantity") > 40, F.col("l_quantity")).alias("mem"),
        F.round(F.col("l_extendedprice") * 100).alias("seconds"),
    )
    means = B.rank_average(stats, ["l_suppkey"], ["mem", "seconds"])
    return means.select("l_suppkey", six("mem"), six("seconds"))


@query(
    "pivot_by_scene",
    """
    WITH v AS (SELECT l_linestatus AS config, l_returnflag AS scene, sum(l_partkey) * 7 AS num FROM lineitem GROUP BY ALL),
    m AS (SELECT config, scene, printf('%.2fM', num / 1000000.0::DOUBLE) AS num FROM v)
    SELECT config, max(num) FILTER (scene = 'A') AS "A", max(num) FILTER (scene = 'N') AS "N", max(num) FILTER (scene = 'R') AS "R"
    FROM m GROUP BY config
    """,
)
def pivot_by_scene(spark: SparkSession, folder: str) -> DataFrame:
    sums = (
        table(spark, folder, "lineitem")
        .groupBy(F.col("l_linestatus").alias("config"), F.col("l_returnflag").alias("scene"))
        .agg((F.sum("l_partkey") * 7).alias("num"))
    )
    return B.pivot_by_scene(sums, "config", "scene", ["A", "N", "R"], millions_text(F.col("num")))


@query(
    "scenario_grid",
    """
    WITH cells AS (SELECT * FROM (SELECT unnest(['A', 'N', 'R', 'X']) AS l_returnflag), (SELECT unnest(['F', 'O']) AS l_linestatus),
                                 (SELECT unnest([1, 2, 4, 7, 8]) AS l_linenumber)),
    r AS (SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS runs, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY ALL)
    SELECT l_returnflag, l_linestatus, l_linenumber, runs, mean FROM cells LEFT JOIN r USING (l_returnflag, l_linestatus, l_linenumber)
    """,
)
def scenario_grid(spark: SparkSession, folder: str) -> DataFrame:
    lists = {"l_returnflag": ["A", "N", "R", "X"], "l_linestatus": ["F", "O"], "l_linenumber": [1, 2, 4, 7, 8]}
    results = (
        table(spark, folder, "lineitem")
        .groupBy(*lists)
        .agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("l_quantity"), 6).alias("mean"))
    )
    return records.grid_results(records.grid(spark, lists), results, list(lists))


@query(
    "latest_checkpoint",
    """
    WITH n AS (SELECT event_type, CASE WHEN value > 50 THEN 'checkpoint_' || event_id ELSE 'checkpoint_' || event_id || '-tmp' END AS name,
                      event_id, value FROM events)
    SELECT event_type, 'checkpoint_' || max(event_id) AS latest, max(event_id) AS checkpoint FROM n WHERE value > 50 GROUP BY event_type
    """,
)
def latest_checkpoint(spark: SparkSession, folder: str) -> DataFrame:
    base = F.concat(F.lit("checkpoint_"), "event_id")
    name = F.when(F.col("value") > 50, base).otherwise(F.concat(base, F.lit("-tmp")))
    named = table(spark, folder, "events").select("event_type", name.alias("name"))
    return records.latest_checkpoint(named, "name", ["event_type"])


@query(
    "scene_durations",
    f"""
    WITH {_SCENES}
    SELECT scene, config, CAST(floor(round(seconds, 2) / 60) AS BIGINT) || 'm'
             || printf('%.2f', round(round(seconds, 2) - floor(round(seconds, 2) / 60) * 60, 2)) || 's' AS train_time FROM rows
    """,
)
def scene_durations(spark: SparkSession, folder: str) -> DataFrame:
    train, validation = scene_stats(spark, folder)
    joined = train.join(validation, ["scene", "config"])
    return joined.select("scene", "config", duration_text(F.round("seconds", 2)).alias("train_time"))
