"""Row filters, length limits, and reshaping of nested records."""

from __future__ import annotations

import functools
import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathework.functions.text import words
from lathework.operators.ordering import with_row_index
from lathework.operators.splits import cap_rows

# Fixed value: the usual longest sequence, in tokens.
MAX_SEQUENCE = 2048


def keep_equal(df: DataFrame, column: str, value: object) -> DataFrame:
    return df.where(F.col(column) == F.lit(value))


def require_keys(df: DataFrame, json_column: str, keys: Sequence[str]) -> DataFrame:
    """Rows whose JSON object has every key; a NULL value counts as present."""
    present = F.json_object_keys(F.col(json_column))
    wanted = F.array(*[F.lit(k) for k in keys])
    return df.where(F.size(F.array_except(wanted, present)) == 0)


def within_length(df: DataFrame, tokens: Column, max_tokens: int) -> DataFrame:
    """Rows with at most ``max_tokens`` tokens."""
    return df.where(tokens <= max_tokens)


def limit_length(df: DataFrame, text: str, how: str = "filter", max_length: int = MAX_SEQUENCE) -> DataFrame:
    """Drop texts over the limit, or cut their token list to it; adds ``tokens``."""
    tokens = words(F.col(text))
    if how == "filter":
        return df.withColumn("tokens", tokens).where(F.size("tokens") <= max_length)
    if how == "truncate":
        return df.withColumn("tokens", F.slice(tokens, 1, max_length))
    raise ValueError("how must be filter or truncate")


def first_passing(df: DataFrame, keep: Column, order_by: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows that pass a filter (the filter comes before the cap)."""
    return cap_rows(df.where(keep), order_by, n)


def flatten_struct(df: DataFrame, booleans: Sequence[str] = (), separator: str = "/") -> DataFrame:
    """Every leaf of nested structs as a top-level column with a joined name; listed ints become booleans."""

    def leaves(schema: T.StructType, path: tuple[str, ...]) -> list[tuple[str, ...]]:
        out = []
        for f in schema.fields:
            here = (*path, f.name)
            out += leaves(f.dataType, here) if isinstance(f.dataType, T.StructType) else [here]
        return out

    columns = []
    for path in leaves(df.schema, ()):
        name = separator.join(path)
        value = F.col(".".join(f"`{p}`" for p in path))
        columns.append((value.cast("boolean") if name in booleans else value).alias(name))
    return df.select(*columns)


def reshape_vector(vector: Column, width: int) -> Column:
    """A flat list as rows of ``width`` values; NULL unless the length divides evenly."""
    rows = F.size(vector) / width
    starts = F.sequence(F.lit(0), rows.cast("int") - 1)
    shaped = F.transform(starts, lambda i: F.slice(vector, i * width + 1, F.lit(width)))
    return F.when((F.size(vector) > 0) & (F.size(vector) % width == 0), shaped)


def explode_steps(episodes: DataFrame, number: str, steps: str) -> DataFrame:
    """One row per step of an episode with the path its image is stored under."""
    rows = episodes.select(
        *[c for c in episodes.columns if c != steps], F.posexplode(F.col(steps)).alias("step", "data")
    )
    path = F.format_string("episode_%04d/step_%04d.png", F.col(number), F.col("step"))
    return rows.withColumn("image_path", path)


def environment_map(columns: Sequence[str], prefix: str = "export ") -> tuple[list[str], Column]:
    """Argument columns, and the columns named with the prefix (any case) as a map without it."""
    marked = [c for c in columns if c.lower().startswith(prefix)]
    rest = [c for c in columns if c not in marked]
    entries = [x for c in marked for x in (F.lit(c[len(prefix) :]), F.col(f"`{c}`").cast("string"))]
    return rest, F.create_map(*entries) if entries else F.create_map().cast("map<string,string>")


def command_line(tool: str, arguments: Sequence[str], output: Column) -> Column:
    """The command a scenario row stands for; a value that starts with ``=`` is attached to its name."""
    parts = []
    for name in arguments:
        value = F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))
        joined = F.when(value.startswith("="), F.concat(F.lit(f"--{name}"), value))
        parts.append(F.coalesce(joined, F.concat(F.lit(f"--{name} "), value)))
    return F.concat_ws(" ", F.lit(f"python {tool}"), *parts, F.concat(F.lit("--output-json "), output))


def zip_lines(left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """Rows paired by position, cut to the shorter side, with a warning if something is cut."""
    return zip_lines_counted(left, right, left_order, right_order)[0]


def zip_lines_counted(
    left: DataFrame, right: DataFrame, left_order: Sequence[str], right_order: Sequence[str]
) -> tuple[DataFrame, dict[str, int]]:
    """Rows paired by position, and how many there were: ``left``, ``right``, ``paired`` and ``cut``.

    The counts come from the passes that write the two sides, not from reading them again. Unequal sides give a warning.
    """
    seen = Observation(), Observation()
    a = with_row_index(left, left_order, name="__i", seen=seen[0])
    b = with_row_index(right, right_order, name="__i", seen=seen[1])
    n, m = (each.get["rows"] for each in seen)
    if n != m:
        warnings.warn(f"{n} rows against {m}: the last {abs(n - m)} of the longer side have no partner", stacklevel=2)
    counts = {"left": n, "right": m, "paired": min(n, m), "cut": abs(n - m)}
    return a.join(b, "__i").withColumnRenamed("__i", "line_number"), counts


def clean_lines(df: DataFrame, line: str, remove_prefix: str = "") -> DataFrame:
    """Trimmed lines without blank ones; a prefix is removed only if one is given."""
    from lathework.functions.text import strip

    value = strip(F.col(line))
    if remove_prefix:
        value = F.when(value.startswith(remove_prefix), F.substr(value, F.lit(len(remove_prefix) + 1))).otherwise(value)
    return df.withColumn(line, value).where(F.length(line) > 0)


def grid(spark, values: Mapping[str, Sequence[object]]) -> DataFrame:
    """Every combination of short parameter lists, one explode per list."""
    out = spark.range(1).select(F.lit(0).alias("__seed"))
    for name, options in values.items():
        out = out.withColumn(name, F.explode(F.array(*[F.lit(o) for o in options])))
    return out.drop("__seed")


def grid_results(cells: DataFrame, results: DataFrame, on: Sequence[str]) -> DataFrame:
    """All cells with their results; a cell that was not run shows NULLs."""
    return cells.join(results, list(on), "left")


def clean_assays(df: DataFrame, value: str, method: str, drop_methods: Sequence[str], limit: float, renamed: str) -> DataFrame:
    """Without censored values (``<`` or ``>`` in front) and unwanted methods, below a limit, as numbers."""
    number = F.col(f"`{value}`").try_cast("double")
    return (
        df.where(~F.col(f"`{value}`").rlike("^[<>]"))
        .withColumn(renamed, number)
        .where((F.col(renamed) < limit) & ~F.coalesce(F.col(method).isin(list(drop_methods)), F.lit(False)))
        .drop(value, method)
    )


def all_thresholds(df: DataFrame, conditions: Sequence[Column]) -> DataFrame:
    return df.where(functools.reduce(lambda a, b: a & b, conditions))


def latest_checkpoint(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """The name ``checkpoint_N`` with the largest number."""
    number = F.regexp_extract(F.col(name), r"^checkpoint_(\d+)$", 1).try_cast("bigint")
    found = df.withColumn("checkpoint", number).where(F.col("checkpoint").isNotNull())
    return found.groupBy(*by).agg(
        F.max_by(F.col(name), F.col("checkpoint")).alias("latest"), F.max("checkpoint").alias("checkpoint")
    )


def sample_efficiency(df: DataFrame, item: str, state: str) -> DataFrame:
    """Generated, invalid (state 0) and batch-duplicate (state 2) items, and repeats of earlier rows.

    Missing items count as equal to each other.
    """
    distinct = F.count_distinct(F.col(item)) + F.coalesce(F.max(F.col(item).isNull().cast("int")), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col(state) == 0).alias("invalid"),
        F.count_if(F.col(state) == 2).alias("batch_duplicates"),
        (F.count(F.lit(1)) - distinct).alias("duplicates"),
    )
