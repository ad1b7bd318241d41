"""Queries: assays, generated molecules, forecast fields and label volumes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.operators import gridded as G
from lathework.operators import records
from lathework.operators.ordering import keep_first
from lathework.operators.scoring import uniqueness
from lathework.plans.evaluate import six
from lathework.plans.registry import query, table


@query(
    "censored_clean",
    """
    SELECT o_orderkey, o_totalprice / 100 AS "IC50" FROM orders
    WHERE o_custkey % 11 <> 0 AND o_custkey % 13 <> 0 AND o_totalprice / 100 < 1000 AND o_orderpriority NOT IN ('5-LOW', '1-URGENT')
    """,
)
def censored_clean(spark: SparkSession, folder: str) -> DataFrame:
    number = (F.col("o_totalprice") / 100).cast("string")
    text = (
        F.when(F.col("o_custkey") % 11 == 0, F.concat(F.lit("<"), number))
        .when(F.col("o_custkey") % 13 == 0, F.concat(F.lit(">"), number))
        .otherwise(number)
    )
    assays = table(spark, folder, "orders").select("o_orderkey", text.alias("exp (nM)"), F.col("o_orderpriority").alias("exp_method"))
    return records.clean_assays(assays, "exp (nM)", "exp_method", ["5-LOW", "1-URGENT"], 1000, "IC50")


@query(
    "threshold_hits",
    """
    SELECT l_partkey, min(l_orderkey) AS l_orderkey FROM lineitem WHERE l_discount > 0.08 AND l_tax < 0.03 GROUP BY l_partkey
    """,
)
def threshold_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Rows over both thresholds, then the first one of each item."""
    items = table(spark, folder, "lineitem").select("l_partkey", "l_orderkey", "l_discount", "l_tax")
    hits = records.all_thresholds(items, [F.col("l_discount") > 0.08, F.col("l_tax") < 0.03])
    return keep_first(hits, "l_partkey", ["l_orderkey", "l_discount", "l_tax"]).select("l_partkey", "l_orderkey")


@query(
    "sample_efficiency",
    """
    SELECT count(*) AS total, count(*) FILTER (o_orderkey % 3 = 0) AS invalid, count(*) FILTER (o_orderkey % 3 = 2) AS batch_duplicates,
           count(*) - count(DISTINCT o_custkey) AS duplicates FROM orders
    """,
)
def sample_efficiency(spark: SparkSession, folder: str) -> DataFrame:
    molecules = table(spark, folder, "orders").select("o_custkey", (F.col("o_orderkey") % 3).alias("state"))
    return records.sample_efficiency(molecules, "o_custkey", "state")


def reference_field(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly mean of event values: variable = event type, latitude from the user."""
    latitude = ((F.col("user_id") % 5) * 15).cast("double")
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    return (
        table(spark, folder, "events")
        .groupBy(F.col("event_type").alias("variable"), latitude.alias("lat"), hour.alias("valid_time"))
        .agg(F.avg("value").alias("value"))
    )


LEADS = [12, 24, 36, 48]


def forecast_field(spark: SparkSession, folder: str) -> DataFrame:
    """Persistence: the forecast for each lead is the value at the start."""
    return reference_field(spark, folder).select(
        "variable",
        "lat",
        F.col("valid_time").alias("init_time"),
        F.explode(F.array(*[F.lit(h) for h in LEADS])).alias("lead_hours"),
        "value",
    )


_FIELD = """
    reference AS (SELECT event_type AS variable, (user_id % 5 * 15)::DOUBLE AS lat, date_trunc('hour', ts)::TIMESTAMP AS valid_time,
                         avg(value) AS value FROM events GROUP BY ALL),
    forecast AS (SELECT variable, lat, valid_time AS init_time, unnest([12, 24, 36, 48]) AS lead_hours, value FROM reference)
"""


@query(
    "forecast_rmse_mae",
    f"""
    WITH {_FIELD},
    e AS (SELECT f.variable, f.lead_hours, f.value - r.value AS d, cos(radians(f.lat)) AS w FROM forecast f
          JOIN reference r ON r.variable = f.variable AND r.lat = f.lat AND r.valid_time = f.init_time + to_hours(f.lead_hours))
    SELECT variable, lead_hours, count(*) AS n, round(sqrt(avg(d * d)), 6) AS rmse, round(avg(abs(d)), 6) AS mae,
           round(sqrt(sum(w * d * d) / sum(w)), 6) AS weighted_rmse, round(sum(w * abs(d)) / sum(w), 6) AS weighted_mae
    FROM e GROUP BY variable, lead_hours
    """,
)
def forecast_rmse_mae(spark: SparkSession, folder: str) -> DataFrame:
    forecast, reference = forecast_field(spark, folder), reference_field(spark, folder)
    keys, by = ["variable", "lat"], ["variable", "lead_hours"]
    scores = G.verify(forecast, reference, keys, "init_time", "lead_hours", "valid_time", by, latitude="lat")
    return scores.select(*by, "n", *[six(c) for c in ("rmse", "mae", "weighted_rmse", "weighted_mae")])


@query(
    "forecast_select",
    f"""
    WITH {_FIELD}
    SELECT variable, lat, init_time, lead_hours, round(value, 6) AS value, 'exclusive' AS bound FROM forecast
    WHERE variable IN ('click', 'view') AND hour(init_time) IN (0, 12) AND init_time >= '2024-01-05' AND init_time < '2024-01-20'
    UNION ALL SELECT variable, lat, init_time, lead_hours, round(value, 6), 'inclusive' FROM forecast
    WHERE variable IN ('click', 'view') AND hour(init_time) IN (0, 12) AND init_time >= '2024-01-05' AND init_time <= '2024-01-20'
    """,
)
def forecast_select(spark: SparkSession, folder: str) -> DataFrame:
    field = forecast_field(spark, folder)
    parts = []
    for bound in ("exclusive", "inclusive"):
        chosen = G.select_fields(
            field, ["click", "view"], None, [0, 12], "2024-01-05", "2024-01-20", end_inclusive=bound == "inclusive"
        )
        parts.append(chosen.select("variable", "lat", "init_time", "lead_hours", six("value"), F.lit(bound).alias("bound")))
    return parts[0].unionByName(parts[1])


@query(
    "first_n_steps",
    f"""
    WITH {_FIELD}, s AS (SELECT *, dense_rank() OVER (PARTITION BY variable ORDER BY valid_time) AS d FROM reference)
    SELECT variable, lat, valid_time, round(value, 6) AS value FROM s WHERE d <= 24
    """,
)
def first_n_steps(spark: SparkSession, folder: str) -> DataFrame:
    first = G.first_steps(reference_field(spark, folder), "valid_time", ["variable"], 24)
    return first.orderBy("lat").select("variable", "lat", "valid_time", six("value"))


@query(
    "step_delta",
    """
    WITH s AS (SELECT DISTINCT event_type, date_diff('hour', TIMESTAMP '2024-01-01', ts) AS step FROM events),
    r AS (SELECT event_type, step, lead(step) OVER w - step AS step_length, row_number() OVER w AS i FROM s WINDOW w AS (PARTITION BY event_type ORDER BY step))
    SELECT event_type, step_length FROM r WHERE i = 1
    """,
)
def step_delta(spark: SparkSession, folder: str) -> DataFrame:
    hours = F.timestamp_diff("HOUR", F.lit("2024-01-01").cast("timestamp_ntz"), F.col("ts"))
    steps = table(spark, folder, "events").select("event_type", hours.alias("step"))
    return G.step_lengths(steps, "step", ["event_type"])


@query(
    "robust_range",
    """
    WITH e AS (SELECT event_type, value FROM events WHERE value <> 0),
    r AS (SELECT event_type, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi, min(value) AS mn, max(value) AS mx
          FROM e GROUP BY event_type)
    SELECT event_type, round(lo, 6) AS low, round(hi, 6) AS high, round(20 - greatest(mx - 20, 20 - mn), 6) AS symmetric_low,
           round(20 + greatest(mx - 20, 20 - mn), 6) AS symmetric_high FROM r
    """,
)
def robust_range(spark: SparkSession, folder: str) -> DataFrame:
    nan = F.when(F.col("value") == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    events = table(spark, folder, "events").select("event_type", "event_id", nan.alias("value"))
    robust = G.value_range(events, "value", ["event_type"], ["event_id"], robust=True)
    symmetric = G.value_range(events, "value", ["event_type"], ["event_id"], center=20.0)
    symmetric = symmetric.select("event_type", F.col("low").alias("symmetric_low"), F.col("high").alias("symmetric_high"))
    return robust.join(symmetric, "event_type").select(
        "event_type", *[six(c) for c in ("low", "high", "symmetric_low", "symmetric_high")]
    )


@query(
    "dice_by_case",
    """
    WITH v AS (SELECT l_suppkey, l_returnflag, (l_quantity > 25)::INTEGER AS pred, (l_discount > 0.05 AND l_suppkey % 5 <> 0)::INTEGER AS label FROM lineitem)
    SELECT l_suppkey, l_returnflag, CASE WHEN sum(label) = 0 THEN 0.0 ELSE round(2 * sum(pred * label) / (sum(pred) + sum(label))::DOUBLE, 6) END AS dice
    FROM v WHERE l_returnflag IN ('A', 'R') GROUP BY l_suppkey, l_returnflag
    """,
)
def dice_by_case(spark: SparkSession, folder: str) -> DataFrame:
    voxels = table(spark, folder, "lineitem").select(
        "l_suppkey",
        "l_returnflag",
        (F.col("l_quantity") > 25).cast("int").alias("pred"),
        ((F.col("l_discount") > 0.05) & (F.col("l_suppkey") % 5 != 0)).cast("int").alias("label"),
    )
    scores = G.dice(voxels, ["l_suppkey", "l_returnflag"], "pred", "label", "l_returnflag", ["A", "R"])
    return scores.select("l_suppkey", "l_returnflag", six("dice"))


@query(
    "uniqueness_runs",
    """
    WITH u AS (SELECT l_linenumber AS run, count(DISTINCT l_partkey) / count(*)::DOUBLE AS u FROM lineitem GROUP BY 1)
    SELECT round(avg(u), 6) AS mean, round(stddev_samp(u), 6) AS std, count(*) AS runs FROM u
    """,
)
def uniqueness_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Uniqueness per run, then its mean and standard deviation over runs."""
    runs = uniqueness(table(spark, folder, "lineitem"), "l_partkey", ["l_linenumber"])
    return runs.agg(
        F.round(F.avg("uniqueness"), 6).alias("mean"),
        F.round(F.stddev_samp("uniqueness"), 6).alias("std"),
        F.count(F.lit(1)).alias("runs"),
    )
