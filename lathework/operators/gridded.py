"""Forecast fields and label volumes as long tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lathework.operators.ordering import quantiles


def select_fields(
    df: DataFrame,
    variables: Sequence[str] | None = None,
    levels: Sequence[int] | None = None,
    hours: Sequence[int] | None = None,
    start: str | None = None,
    end: str | None = None,
    end_inclusive: bool = False,
    variable: str = "variable",
    level: str = "level",
    time: str = "init_time",
) -> DataFrame:
    """Rows of the wanted variables, levels, hours of day and period."""
    if variables is not None:
        df = df.where(F.col(variable).isin(list(variables)))
    if levels is not None:
        df = df.where(F.col(level).isin(list(levels)))
    if hours is not None:
        df = df.where(F.hour(time).isin(list(hours)))
    if start is not None:
        df = df.where(F.col(time) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        bound = F.lit(end).cast("timestamp_ntz")
        df = df.where(F.col(time) <= bound if end_inclusive else F.col(time) < bound)
    return df


def steps_of(df: DataFrame, step: str, by: Sequence[str]) -> DataFrame:
    """The distinct steps of each series, numbered; values are deduplicated before the window."""
    order = Window.partitionBy(*by).orderBy(step)
    return df.select(*by, step).distinct().withColumn("step_number", F.row_number().over(order) - 1)


def first_steps(df: DataFrame, step: str, by: Sequence[str], n: int) -> DataFrame:
    """Rows of the first ``n`` steps of each series."""
    wanted = steps_of(df, step, by).where(F.col("step_number") < n).drop("step_number")
    return df.join(wanted, [*by, step], "left_semi")


def step_lengths(df: DataFrame, step: str, by: Sequence[str]) -> DataFrame:
    """The distance from the first step to the second, per series."""
    steps = steps_of(df, step, by).where(F.col("step_number") < 2)
    pair = steps.groupBy(*by).agg(F.min(step).alias("a"), F.max(step).alias("b"), F.count(F.lit(1)).alias("n"))
    return pair.select(*by, F.when(F.col("n") == 2, F.col("b") - F.col("a")).alias("step_length"))


def verify(
    forecast: DataFrame,
    reference: DataFrame,
    on: Sequence[str],
    init_time: str,
    lead_hours: str,
    valid_time: str,
    by: Sequence[str],
    latitude: str | None = None,
) -> DataFrame:
    """RMSE and MAE of forecasts against the reference at their valid time.

    With ``latitude`` the same pass also gives ``weighted_rmse`` and ``weighted_mae``, where each cell counts by
    the cosine of its latitude (the usual area weight).
    """
    valid = F.col(init_time) + F.make_dt_interval(hours=F.col(lead_hours))
    pairs = forecast.withColumn(valid_time, valid).join(
        reference.withColumnRenamed("value", "__truth"), [*on, valid_time]
    )
    error = F.col("value") - F.col("__truth")
    scores = [
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
    ]
    if latitude:
        weight = F.cos(F.radians(F.col(latitude)))
        scores += [
            F.sqrt(F.sum(weight * error * error) / F.sum(weight)).alias("weighted_rmse"),
            (F.sum(weight * F.abs(error)) / F.sum(weight)).alias("weighted_mae"),
        ]
    return pairs.groupBy(*by).agg(*scores)


def value_range(
    df: DataFrame, value: str, by: Sequence[str], tie_break: Sequence[str], robust: bool = False, center: float | None = None
) -> DataFrame:
    """Smallest and largest value, or the 2nd and 98th percentile, without NaN; may be made symmetric."""
    clean = df.where(~F.isnan(value) & F.col(value).isNotNull())
    if robust:
        ends = quantiles(clean, by, value, {"low": 0.02, "high": 0.98}, tie_break)
    else:
        ends = clean.groupBy(*by).agg(F.min(value).alias("low"), F.max(value).alias("high"))
    if center is None:
        return ends
    reach = F.greatest(F.col("high") - center, center - F.col("low"))
    return ends.select(*by, (center - reach).alias("low"), (center + reach).alias("high"))


def dice(
    voxels: DataFrame,
    by: Sequence[str],
    prediction: str,
    label: str,
    channel: str | None = None,
    channels: Sequence[object] | None = None,
) -> DataFrame:
    """Overlap ``2 sum(xy) / (sum x + sum y)`` per case; an empty label gives 0."""
    if channel and channels is not None:
        voxels = voxels.where(F.col(channel).isin(list(channels)))
    sums = voxels.groupBy(*by).agg(
        F.sum(F.col(prediction) * F.col(label)).alias("__xy"),
        F.sum(prediction).alias("__x"),
        F.sum(label).alias("__y"),
    )
    score = F.when(F.col("__y") == 0, 0.0).otherwise(2 * F.col("__xy") / (F.col("__x") + F.col("__y")))
    return sums.select(*by, score.alias("dice"))
