"""Tables of benchmark runs: scenario results, logs, serving latencies, scene metrics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathework.operators.ordering import BLOCK_ROWS, ordered_blocks, shift_columns, with_row_index

MARKDOWN_NULL = "N/A"


def scenario_results(scenarios: DataFrame, results: DataFrame, row: str) -> DataFrame:
    """Scenario rows with their results; of columns named alike the scenario's is kept.

    A scenario that was not run (or failed) has no result and gives no row.
    """
    extra = [c for c in results.columns if c != row and c not in scenarios.columns]
    return scenarios.join(results.select(row, *extra), row)


def latency_summary(df: DataFrame, avg: str, percentiles: str, output_length: str, keep: Sequence[str]) -> DataFrame:
    """Latencies of the files that report one, in milliseconds."""
    seconds = {
        "avg_latency_ms": F.col(avg),
        "p90_latency_ms": F.try_element_at(F.col(percentiles), F.lit("90")),
        "p99_latency_ms": F.try_element_at(F.col(percentiles), F.lit("99")),
        "avg_latency_per_token_ms": F.try_divide(F.col(avg), F.col(output_length).cast("double")),
    }
    return df.where(F.col(avg).isNotNull()).select(*keep, *[(s * 1000).alias(n) for n, s in seconds.items()])


def throughput_summary(
    df: DataFrame,
    avg: str,
    per_second: str,
    elapsed: str,
    prompts: str,
    output_length: str,
    keep: Sequence[str],
    requests_per_second: str,
    total_tokens: str,
) -> DataFrame:
    """What the files that report no latency say: token rates cut to whole tokens, request rate, time and tokens in all."""
    generated = F.try_divide(F.col(prompts).cast("bigint") * F.col(output_length).cast("bigint"), F.col(elapsed))
    return df.where(F.col(avg).isNull()).select(
        *keep,
        F.col(per_second).cast("bigint").alias("total_tokens_per_s"),
        generated.cast("bigint").alias("generated_tokens_per_s"),
        F.col(requests_per_second).alias("requests_per_s"),
        F.col(elapsed).alias("elapsed_s"),
        F.col(total_tokens).cast("bigint").alias("total_tokens"),
    )


def log_means(lines: DataFrame, line: str, patterns: Mapping[str, str], by: Sequence[str]) -> DataFrame:
    """Mean of every number a pattern's first group finds in the log lines, per metric (NULL if it finds none).

    Each line adds its numbers up by itself, so lines are not multiplied before the aggregate.
    """
    sums = []
    for metric, pattern in patterns.items():
        found = F.regexp_extract_all(F.col(line), F.lit(pattern), F.lit(1))
        numbers = F.array_compact(F.transform(found, lambda text: text.try_cast("double")))
        total = F.aggregate(numbers, F.lit(0.0), lambda so_far, number: so_far + number)
        sums += [total.alias(f"{metric}:sum"), F.size(numbers).alias(f"{metric}:n")]
    totals = lines.select(*by, *sums).groupBy(*by).agg(
        *[F.sum(f"{metric}:{part}").alias(f"{metric}:{part}") for metric in patterns for part in ("sum", "n")]
    )
    rows = [
        F.struct(
            F.lit(metric).alias("metric"),
            F.try_divide(F.col(f"{metric}:sum"), F.col(f"{metric}:n")).alias("mean"),
            F.col(f"{metric}:n").alias("n"),
        )
        for metric in patterns
    ]
    return totals.select(*by, F.explode(F.array(*rows)).alias("m")).select(*by, "m.metric", "m.mean", "m.n")


def tokens_per_gpu(batch: Column, sequence: Column, ms_per_step: Column, gpus: Column) -> Column:
    """Tokens per GPU and second; NULL for a missing, zero or NaN time."""
    rate = F.try_divide(batch * sequence * F.lit(1000.0), ms_per_step * gpus)
    return F.when((ms_per_step > 0) & ~F.isnan(ms_per_step), rate)


# The lines of a section log that carry information.
HEADER = r"Benchmark (Banana|Truck|the rasterization)"
MARKERS = HEADER + "|itern?_num:|num_points:|real\t|terminate"


def section_timings(
    lines: DataFrame, order_by: Sequence[str], line: str, value: Column, header: str = HEADER, markers: str = MARKERS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Timings of a section log: ``section, header, cell, seconds, status``.

    A timing belongs to the last header before it and takes the next cell of that section. It counts as a
    memory overflow if the informative line before it reports one: ``terminate`` with ``negative
    dimension`` on the raw line that follows.

    One scan over ordered blocks of what the lines say, which is written once: inside a block windows look back and ahead, and one row per block
    carries the last header, the last kind and the counts on to the later ones. A log or a section of any length is spread over tasks.
    """
    text = F.col(line)
    kind = (
        F.when(text.rlike(header), "header").when(text.contains("terminate"), "terminate").when(text.contains("real\t"), "time").otherwise("other")
    )
    said = lines.select(
        *order_by,
        F.when(text.rlike(markers), kind).alias("__kind"),
        F.coalesce(text.contains("negative dimension"), F.lit(False)).alias("__negative"),
        F.when(text.rlike(header), text).alias("__header"),
        F.when(text.contains("real\t"), value).alias("seconds"),
    )
    inside = Window.partitionBy("__block").orderBy("__pos")
    so_far, earlier = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    is_header, is_time = F.col("__kind") == "header", F.col("__kind") == "time"

    def ended(follows: Column, otherwise: str) -> Column:
        return F.when(follows, "overflow").when(~follows, "error").otherwise(otherwise)

    # the line after a block's last one is known to the next block only
    rows = ordered_blocks(said, order_by, block_rows)
    rows = rows.withColumn("__kind", F.when(F.col("__kind") == "terminate", ended(F.lead("__negative").over(inside), "edge")).otherwise(F.col("__kind")))
    rows = rows.withColumns(
        {
            "__before": F.last("__kind", ignorenulls=True).over(earlier),
            "__times": F.count(F.when(is_time, 1)).over(so_far),
            "__headers": F.count(F.when(is_header, 1)).over(so_far),
            "__last_header": F.last(F.when(is_header, F.col("__header")), ignorenulls=True).over(so_far),
        }
    ).withColumn("__first", F.max(F.when(is_header, F.col("__times"))).over(so_far))

    def last(column: str, given: Column) -> Column:
        return F.max_by(F.when(given, F.col(column)), F.when(given, F.col("__pos"))).alias(column)

    blocks = rows.groupBy("__block").agg(
        F.min_by("__negative", "__pos").alias("__opens"),
        last("__kind", F.col("__kind").isNotNull()),
        last("__last_header", F.col("__last_header").isNotNull()),
        *[F.max(c).alias(c) for c in ("__times", "__headers", "__first")],
    )
    order = Window.orderBy("__block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumns(
        {
            "__kind": F.when(F.col("__kind") == "edge", ended(F.lead("__opens").over(order), "error")).otherwise(F.col("__kind")),
            "__t": F.coalesce(F.sum("__times").over(before), F.lit(0)),
            "__h": F.coalesce(F.sum("__headers").over(before), F.lit(0)),
        }
    )
    carried = blocks.select(
        "__block",
        "__t",
        "__h",
        F.last("__kind", ignorenulls=True).over(before).alias("__k"),
        F.last("__last_header", ignorenulls=True).over(before).alias("__l"),
        F.max(F.col("__first") + F.col("__t")).over(before).alias("__f"),
    )
    status = F.coalesce("__before", "__k")
    return (
        rows.where(is_time)
        .join(carried, "__block")
        .select(
            (F.col("__headers") + F.col("__h")).alias("section"),
            F.coalesce("__last_header", "__l").alias("header"),
            (F.col("__times") + F.col("__t") - F.coalesce(F.col("__first") + F.col("__t"), F.col("__f")) - 1).alias("cell"),
            "seconds",
            F.when(status.isin("overflow", "error"), status).otherwise("ok").alias("status"),
        )
        .where("section > 0")
    )


def section_table(timings: DataFrame, layouts: Sequence[int]) -> DataFrame:
    """One row per section, laid out as the smallest of the ``layouts`` that holds its cells, else as the largest.

    ``layout`` is the number of cells shown, ``beyond`` how many timings found no cell. One text column per cell of the largest layout:
    an overflow shows as such, a missing cell as N/A, a cell that the layout lacks as NULL.
    """
    sizes = sorted(layouts)
    shown = F.when(F.col("status") == "overflow", F.lit("**Memory overflow**")).otherwise(F.col("seconds").cast("string"))
    filled = timings.groupBy("section", "header").agg(
        (F.max("cell") + 1).alias("__cells"),
        F.count_if(F.col("cell") >= sizes[-1]).alias("beyond"),
        *[F.max(F.when(F.col("cell") == c, shown)).alias(f"cell_{c}") for c in range(sizes[-1])],
    )
    layout = F.lit(sizes[-1])
    for size in reversed(sizes):
        layout = F.when(F.col("__cells") <= size, F.lit(size)).otherwise(layout)
    cells = [F.when(F.col("layout") > c, F.coalesce(f"cell_{c}", F.lit(MARKDOWN_NULL))).alias(f"cell_{c}") for c in range(sizes[-1])]
    return filled.withColumn("layout", layout).select("section", "header", "layout", "beyond", *cells)


def token_gaps(tokens: DataFrame, request: Sequence[str], at: str, tie_break: Sequence[str]) -> DataFrame:
    """Each token with the milliseconds since the one before it in its request (NULL for the first)."""
    ordered = with_row_index(tokens, [*request, at, *tie_break], name="__i")
    gapped = shift_columns(ordered, "__i", {"__last": (at, 1)}, within=request)
    micros = F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col("__last").cast("timestamp"))
    return gapped.withColumn("gap_ms", micros / 1000).drop("__last", "__i")


def request_latencies(tokens: DataFrame, request: Sequence[str], at: str, sent: str) -> DataFrame:
    """Per request: time to first token, end-to-end time, tokens, time per further token (ms)."""
    first, last = F.min(at), F.max(at)

    def micros(c: Column) -> Column:
        return F.unix_micros(c.cast("timestamp"))

    sums = tokens.groupBy(*request).agg(
        micros(F.min(sent)).alias("__sent"), micros(first).alias("__first"), micros(last).alias("__last"),
        F.count(F.lit(1)).alias("tokens"),
    )
    return sums.select(
        *request,
        "tokens",
        ((F.col("__first") - F.col("__sent")) / 1000).alias("ttft_ms"),
        ((F.col("__last") - F.col("__sent")) / 1000).alias("e2e_ms"),
        F.try_divide((F.col("__last") - F.col("__first")) / 1000, F.col("tokens") - 1).alias("tpot_ms"),
    )


def serving_rates(tokens: DataFrame, by: Sequence[str], request: Sequence[str], at: str, sent: str) -> DataFrame:
    """Requests and tokens, and both per second between the first request sent and the last token."""

    def seconds(c: Column) -> Column:
        return F.unix_micros(c.cast("timestamp")) / 1e6

    counts = tokens.groupBy(*by).agg(
        F.count_distinct(*[F.col(r) for r in request]).alias("requests"),
        F.count(F.lit(1)).alias("tokens"),
        (seconds(F.max(at)) - seconds(F.min(sent))).alias("__s"),
    )
    rates = [F.round(F.try_divide(F.col(c), F.col("__s")), 9).alias(f"{c}_per_s") for c in ("requests", "tokens")]
    return counts.select(*by, "requests", "tokens", *rates)


SERVING_LEVELS = {"median": 0.5, "p99": 0.99}


def rank_average(stats: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Means over ranks that skip missing values; all missing gives NULL."""
    return stats.groupBy(*by).agg(*[F.avg(v).alias(v) for v in values])


def complete_groups(df: DataFrame, by: Sequence[str], rank: str, expected: int) -> DataFrame:
    """Rows of the groups that have all expected ranks."""
    full = df.groupBy(*by).agg(F.count_distinct(F.col(rank)).alias("__n")).where(F.col("__n") == expected)
    return df.join(full.drop("__n"), list(by), "left_semi")


def scene_metrics(train: DataFrame, validation: DataFrame, on: Sequence[str], scene: str, config: str, values: Sequence[str]) -> DataFrame:
    """Scenes that have both files, then an ``Average`` and a ``Std`` (sample) row per configuration."""
    rows = train.join(validation, list(on)).select(scene, config, *values)
    summary = rows.groupBy(config).agg(
        *[F.avg(v).alias(f"Average:{v}") for v in values], *[F.stddev_samp(v).alias(f"Std:{v}") for v in values]
    )
    labelled = [
        F.struct(F.lit(label).alias(scene), *[F.col(f"`{label}:{v}`").alias(v) for v in values])
        for label in ("Average", "Std")
    ]
    extra = summary.select(config, F.explode(F.array(*labelled)).alias("r")).select(
        F.col(f"r.{scene}").alias(scene), config, *[F.col(f"r.{v}").alias(v) for v in values]
    )
    return rows.unionByName(extra)


def pivot_by_scene(df: DataFrame, config: str, scene: str, scenes: Sequence[str], value: Column) -> DataFrame:
    """One row per configuration, one column per scene."""
    return df.groupBy(config).agg(*[F.max(F.when(F.col(scene) == s, value)).alias(s) for s in scenes])


def markdown_rows(df: DataFrame, columns: Sequence[str]) -> Column:
    """Each row as a line of a Markdown table; NULL shows as N/A."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(MARKDOWN_NULL)) for c in columns]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def markdown_head(columns: Sequence[str]) -> list[str]:
    return ["| " + " | ".join(columns) + " |", "|" + "|".join("-------" for _ in columns) + "|"]
