"""Quantiles over many runs from mergeable sketches, so that old runs are never read again."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SKETCH_K = 1000  # a sketch has some thousand numbers at most, whatever it has seen
RANK_ERROR = 0.01  # of a quantile from sketches of that size; the theory gives 0.003 for 99 % of them


def sketch_values(values: DataFrame, by: Sequence[str], value: str, k: int = SKETCH_K) -> DataFrame:
    """``by, n, total, least, most, sketch`` of each group; NULL and NaN are left out, and a group that has nothing else keeps a row with n = 0.

    One aggregation that sketches in each task first: what is shuffled is a sketch per group and task.
    """
    number = F.col(value).cast("double")
    valid = F.when(number.isNotNull() & ~F.isnan(number), number)
    return values.select(*by, valid.alias("__v")).groupBy(*by).agg(
        F.count("__v").alias("n"),
        F.sum("__v").alias("total"),
        F.min("__v").alias("least"),
        F.max("__v").alias("most"),
        F.kll_sketch_agg_double("__v", k).alias("sketch"),
    )


def merged_quantiles(sketches: DataFrame, by: Sequence[str], probabilities: Mapping[str, float]) -> DataFrame:
    """``by, n, total, least, most`` over all runs and one column per named probability, within ``RANK_ERROR`` of its rank; NULL if n = 0."""
    merged = sketches.groupBy(*by).agg(
        *[F.sum(c).alias(c) for c in ("n", "total")],
        F.min("least").alias("least"),
        F.max("most").alias("most"),
        F.kll_merge_agg_double(F.when(F.col("n") > 0, F.col("sketch"))).alias("sketch"),
    )

    def level(p: float) -> Column:
        return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))))

    return merged.select(*by, "n", "total", "least", "most", *[level(p).alias(name) for name, p in probabilities.items()])


def rank_errors(values: DataFrame, by: Sequence[str], value: str, levels: DataFrame, probabilities: Mapping[str, float]) -> DataFrame:
    """How far the true rank of each estimate is from its probability, as ``by`` and a column per name; a scan of all values, for checks."""
    names = {name: f"__level_{name}" for name in probabilities}
    told = levels.select(*[F.col(c).alias(f"__{c}") for c in by], *[F.col(n).alias(a) for n, a in names.items()])
    same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    met = values.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).join(told, same)

    def error(name: str, p: float) -> Column:
        below, upto = (F.avg((F.col(value) < F.col(names[name])).cast("double")), F.avg((F.col(value) <= F.col(names[name])).cast("double")))
        return F.greatest(below - p, p - upto, F.lit(0.0)).alias(name)

    return met.groupBy(*by).agg(*[error(name, p) for name, p in probabilities.items()])
