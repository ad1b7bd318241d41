"""From source tables to accepted training rows: cap, split, convert, set bad rows aside."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathework.operators.messages import ChatSpec, chat_rows, check_columns
from lathework.operators.ordering import with_row_index
from lathework.operators.splits import cap_rows, ratio_split


def by_ratio(
    df: DataFrame,
    key: Sequence[str],
    shares: Mapping[str, float],
    spec: ChatSpec,
    data_source: str,
    seed: int = 42,
    max_rows: int | None = None,
    preserve: Sequence[str] = (),
) -> DataFrame:
    """One source cut into splits by shares; a cap applies to the source, in key order, before the shuffle.

    Gives ``data_source, messages, extra_info, split``, rejected rows included (see ``messages.accepted``).
    """
    check_columns(df.columns, spec)
    if max_rows is not None:
        df = cap_rows(df, key, max_rows)
    placed = ratio_split(df, key, list(shares), list(shares.values()), seed, name="__split", index="__place")
    rows = chat_rows(placed, spec, data_source, F.col("__split"), "__place", preserve)
    return rows.withColumn("split", F.col("extra_info.split"))


def by_name(
    sources: Mapping[str, DataFrame],
    order_by: Sequence[str],
    spec: ChatSpec,
    data_source: str,
    max_rows: int | None = None,
    preserve: Sequence[str] = (),
) -> DataFrame:
    """Sources that are splits already; each keeps its order, its own columns and its own cap."""
    parts = []
    for name, df in sources.items():
        check_columns(df.columns, spec)
        placed = with_row_index(df, order_by, name="__place")
        if max_rows is not None:
            placed = placed.where(F.col("__place") < max_rows)
        rows = chat_rows(placed, spec, data_source, name, "__place", preserve)
        parts.append(rows.withColumn("split", F.lit(name)))
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
