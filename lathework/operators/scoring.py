"""Scores of predictions against references, their summaries and counters."""

from __future__ import annotations

import functools
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathework.functions.text import answer_key, clamp_at_zero, contains_any, is_error, metric_tokens

BLEU_ORDER = 4
HISTOGRAM_BINS = 20


def exact_match(prediction: Column, reference: Column, **options: bool) -> Column:
    """1.0 if both texts agree after normalisation, else 0.0; its mean is the match rate (a fraction)."""
    return F.when(answer_key(prediction, **options) == answer_key(reference, **options), 1.0).otherwise(0.0)


_ORDERS = range(1, BLEU_ORDER + 1)
_MATCHES = T.StructType([T.StructField(f"match_{n}", T.LongType()) for n in _ORDERS])


_SLICE_TOKENS = 1 << 18  # tokens whose n-grams are counted at a time, or those of one row


@F.arrow_udf(_MATCHES)
def _clipped_matches(prediction: pa.Array, references: pa.Array) -> pa.Array:
    """Count the n-grams of stretches of an Arrow batch; no token becomes a Python object."""
    ends = np.cumsum(np.diff(prediction.offsets)) + np.cumsum(np.diff(references.flatten().offsets.take(references.offsets)))
    found, start = [np.zeros((0, len(_ORDERS)), "int64")], 0
    while start < len(prediction):
        limit = _SLICE_TOKENS + (ends[start - 1] if start else 0)
        stop = max(start + 1, int(np.searchsorted(ends, limit, side="right")))
        found.append(_matches_of(prediction.slice(start, stop - start), references.slice(start, stop - start)))
        start = stop
    counts = np.concatenate(found)
    return pa.StructArray.from_arrays([pa.array(c) for c in counts.T], names=[f"match_{n}" for n in _ORDERS])


def _matches_of(prediction: pa.Array, references: pa.Array) -> np.ndarray:
    """Clipped matches by row and order: tokens and then grams become integer codes."""
    rows, others = len(prediction), references.flatten()
    owner = np.concatenate([np.arange(rows), np.repeat(np.arange(rows), references.value_lengths().to_numpy())])
    sizes = np.concatenate([prediction.value_lengths().to_numpy(), others.value_lengths().to_numpy()])
    text_of = np.repeat(np.arange(len(sizes)), sizes)
    # a side without tokens may come with no offsets to join
    sides = [side for side in (prediction.flatten(), others.flatten()) if len(side)]
    tokens = pa.concat_arrays(sides) if sides else pa.array([], pa.string())
    codes = tokens.dictionary_encode().indices.to_numpy().astype("int64")
    matches = []
    gram = codes
    for n in _ORDERS:
        if n > 1:
            gram = pd.factorize(gram[:-1] * (codes.max(initial=0) + 1) + codes[n - 1 :])[0].astype("int64")
        inside = text_of[: len(gram)] == text_of[n - 1 :]
        width = gram.max(initial=0) + 1
        seen, times = np.unique(text_of[: len(gram)][inside] * width + gram[inside], return_counts=True)
        key = owner[seen // width] * width + seen % width
        predicted = seen // width < rows
        allowed = pd.Series(times[~predicted]).groupby(key[~predicted]).max()
        clipped = np.minimum(times[predicted], allowed.reindex(key[predicted], fill_value=0).to_numpy())
        matches.append(np.bincount(seen[predicted] // width, weights=clipped, minlength=rows).astype("int64"))
    return np.stack(matches, axis=1)


def bleu_counts(df: DataFrame, key: str, prediction: str, references: str, keep: Sequence[str] = ()) -> DataFrame:
    """Per row: clipped matches and possible n-grams of each order, and both lengths.

    ``references`` is an array of texts. Tokens are cut in the JVM; the n-grams of a row are counted in the
    task that holds the row, in Arrow batches, so no text is shuffled. Columns in ``keep`` are carried along.
    """
    zero, none = F.lit(0).cast("bigint"), F.array().cast("array<string>")
    tokens = df.select(
        key,
        *keep,
        F.coalesce(metric_tokens(F.col(prediction)), none).alias("__p"),
        F.transform(
            F.coalesce(references, none), lambda t: F.coalesce(metric_tokens(t), none)
        ).alias("__r"),
    )
    matched = tokens.withColumn("__m", _clipped_matches("__p", "__r"))
    length = F.size("__p").cast("bigint")
    return matched.select(
        key,
        *keep,
        length.alias("prediction_length"),
        F.coalesce(F.array_min(F.transform("__r", lambda t: F.size(t))), F.lit(0)).cast("bigint").alias("reference_length"),
        "__m.*",
        *[F.greatest(length - (n - 1), zero).alias(f"possible_{n}") for n in _ORDERS],
    )


def bleu_from_counts(counts: DataFrame, by: Sequence[str] = (), means: Sequence[str] = ()) -> DataFrame:
    """Corpus BLEU from summed counts: order 4, no smoothing, brevity penalty; in the same pass, some means."""
    orders = _ORDERS
    sums = [F.sum(c).alias(c) for n in orders for c in (f"match_{n}", f"possible_{n}")]
    totals = counts.groupBy(*by).agg(
        F.sum("prediction_length").alias("prediction_length"),
        F.sum("reference_length").alias("reference_length"),
        *sums,
        *[F.avg(m).alias(m) for m in means],
    )
    ratio = F.col("prediction_length") / F.col("reference_length")
    penalty = F.when(ratio > 1, F.lit(1.0)).otherwise(F.exp(1 - F.try_divide(F.lit(1.0), ratio)))
    log_sum = sum((F.log(F.col(f"match_{n}") / F.col(f"possible_{n}")) for n in orders), F.lit(0.0))
    some_zero = F.least(*[F.col(f"match_{n}") for n in orders]) == 0
    bleu = F.when(some_zero, 0.0).otherwise(F.exp(log_sum / BLEU_ORDER) * penalty)
    return totals.select(*by, "prediction_length", "reference_length", bleu.alias("bleu"), *means)


_SCORES = T.StructType([T.StructField(name, T.DoubleType()) for name in ("precision", "recall", "f1")])


MATCH_BLOCK = 1024  # tokens of each side whose similarities a task holds at a time: 8 MB, however long the two sides are


def greedy_scores(prediction: np.ndarray, reference: np.ndarray, block: int = MATCH_BLOCK) -> tuple[float, float, float]:
    """Precision, recall and F1 of two matrices of token vectors: the mean best similarity of the rows of either side.

    The best of each row and column are kept while blocks of similarities go by, so that memory grows with the tokens and not with their pairs.
    """

    def unit(vectors: np.ndarray) -> np.ndarray:
        vectors = vectors.astype("float64")
        return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)

    p, r = unit(prediction), unit(reference)
    best_p, best_r = np.full(len(p), -np.inf), np.full(len(r), -np.inf)
    for a in range(0, len(p), block):
        for b in range(0, len(r), block):
            similarity = p[a : a + block] @ r[b : b + block].T
            rows, columns = best_p[a : a + block], best_r[b : b + block]
            np.maximum(rows, similarity.max(axis=1), out=rows)
            np.maximum(columns, similarity.max(axis=0), out=columns)
    precision, recall = best_p.mean(), best_r.mean()
    total = precision + recall
    return precision, recall, 2 * precision * recall / total if total else 0.0


@F.pandas_udf(_SCORES)
def _greedy_match(prediction: pd.Series, reference: pd.Series) -> pd.DataFrame:
    scores = np.zeros((len(prediction), 3))
    for row, (p, r) in enumerate(zip(prediction, reference)):
        if p is not None and r is not None and len(p) and len(r):
            scores[row] = greedy_scores(np.stack(p), np.stack(r))
    return pd.DataFrame(scores, columns=["precision", "recall", "f1"])


def embedding_match(df: DataFrame, prediction: str, reference: str) -> DataFrame:
    """Precision, recall and F1 of greedy cosine matching between two lists of token vectors.

    Negative values become zero. Works row by row on arrays the caller brings; no pairs leave the task.
    """
    scored = df.withColumn("__s", _greedy_match(F.col(prediction), F.col(reference)))
    for name in ("precision", "recall", "f1"):
        scored = scored.withColumn(name, clamp_at_zero(F.col(f"__s.{name}")))
    return scored.drop("__s")


def mean_summary(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), digits: int = 4) -> DataFrame:
    """The mean of each column, rounded."""
    return df.groupBy(*by).agg(*[F.round(F.avg(c), digits).alias(c) for c in columns])


def metric_summary(rows: DataFrame, key: str = "context_document_id", on_error: str = "score", digits: int = 4) -> DataFrame:
    """One row of metrics for inference rows: exact match and BLEU against the one gold answer.

    A failed call is scored as the text it is, or left out with ``on_error="drop"``. Several gold answers
    for a row are an error.
    """
    if on_error not in ("score", "drop"):
        raise ValueError("on_error must be score or drop")
    if on_error == "drop":
        rows = rows.where(~is_error(F.col("llm_inference")))
    gold = single_gold(F.col("gold_standard_result"))
    pairs = rows.select(key, F.col("llm_inference").alias("__p"), gold.alias("__g"))
    scored = pairs.select(
        key, "__p", F.array("__g").alias("__r"), exact_match(F.col("__p"), F.col("__g")).alias("exact_match")
    )
    counts = bleu_counts(scored, key, "__p", "__r", keep=["exact_match"])
    summary = bleu_from_counts(counts, means=["exact_match"])
    return summary.select(*[F.round(c, digits).alias(c) for c in ("exact_match", "bleu")])


def histogram(df: DataFrame, value: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Equal-width bins over the range, the last one closed; one value widens to half a unit either side.

    Empty bins are listed too. The range is a scalar subquery, so nothing is collected or joined.
    """
    known = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(
        F.col(value).cast("double").alias("__v")
    )
    low, high, mean = (known.agg(f("__v").alias("s")).scalar() for f in (F.min, F.max, F.avg))
    ranged = known.withColumn("__lo", low).withColumn("__hi", high)
    flat = F.col("__lo") == F.col("__hi")
    ranged = ranged.withColumn("__a", F.when(flat, F.col("__lo") - 0.5).otherwise(F.col("__lo"))).withColumn(
        "__w", F.when(flat, F.lit(1.0)).otherwise(F.col("__hi") - F.col("__lo")) / bins
    )
    place = F.least(F.floor((F.col("__v") - F.col("__a")) / F.col("__w")), F.lit(bins - 1)).cast("int")
    filled = ranged.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    edges = (
        df.sparkSession.range(bins)
        .select(F.col("id").cast("int").alias("bin"))
        .withColumn("__lo", low)
        .withColumn("__hi", high)
        .withColumn("mean", mean)
    )
    start = F.when(flat, F.col("__lo") - 0.5).otherwise(F.col("__lo"))
    width = F.when(flat, F.lit(1.0)).otherwise(F.col("__hi") - F.col("__lo")) / bins
    return edges.join(filled, "bin", "left").select(
        "bin",
        (start + width * F.col("bin")).alias("bin_start"),
        (start + width * (F.col("bin") + 1)).alias("bin_end"),
        F.coalesce(F.col("count"), F.lit(0)).alias("count"),
        "mean",
    )


def weighted_mean(df: DataFrame, value: str, weight: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``sum(value * n) / sum(n)`` over valid entries; with no weight it is the plain mean."""
    n = F.col(weight) if weight else F.lit(1)
    valid = F.col(value).isNotNull() & ~F.isnan(F.col(value))
    total = F.sum(F.when(valid, F.col(value) * n))
    count = F.sum(F.when(valid, n))
    return df.groupBy(*by).agg(
        count.alias("weight"), F.when(count > 0, total / count).otherwise(total).alias("mean")
    )


def run_counters(df: DataFrame, excluded: Column, failed: Column) -> DataFrame:
    """Total, processed, excluded by length and failed rows in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~excluded).alias("processed"),
        F.count_if(excluded).alias("excluded"),
        F.count_if(~excluded & failed).alias("errors"),
    )


def single_gold(gold: Column, strict: bool = True) -> Column:
    """The one gold answer; several raise an error, or give NULL if not strict."""
    one = F.size(gold) == 1
    answer = F.get(gold, F.lit(0))
    if strict:
        return F.when(one, answer).otherwise(F.raise_error(F.lit("Multiple correct answers")).cast("string"))
    return F.when(one, answer)


def attach_gold(answers: DataFrame, documents: DataFrame, key: str) -> DataFrame:
    """Each answer with its gold answer and document; Spark picks the join from the sizes."""
    return answers.join(documents, key, "inner")


def before_after(scores: DataFrame, item: Sequence[str], phase: str, score: str) -> DataFrame:
    """Scores of two phases side by side; one aggregation instead of a self-join."""
    pivoted = scores.groupBy(*item).agg(
        F.max(F.when(F.col(phase) == "before", F.col(score))).alias("before"),
        F.max(F.when(F.col(phase) == "after", F.col(score))).alias("after"),
    )
    return pivoted.withColumn("change", F.col("after") - F.col("before"))


def softmax(scores: Column, scale: float = 1.0) -> Column:
    """Softmax over an array of scores, shifted by its maximum."""
    top = F.array_max(scores)
    powers = F.transform(scores, lambda s: F.exp((s - top) * scale))
    total = F.aggregate(powers, F.lit(0.0), lambda a, p: a + p)
    return F.transform(powers, lambda p: p / total)


def softmax_rows(df: DataFrame, item: Sequence[str], score: str, scale: float = 1.0) -> DataFrame:
    """Softmax over the rows of each item, however many an item has.

    Powers are summed per item and score band, each relative to its band's upper edge: one map-side
    aggregate without knowing the maximum. The few bands of an item are then put together, and its maximum
    and total joined back, the only step that moves rows.
    """
    width = 50.0 / scale  # a band spans e**-50, well inside a double
    value = F.col(score).cast("double")
    banded = df.groupBy(*item, F.ceil(value / width).alias("__band")).agg(
        F.sum(F.exp((value - F.ceil(value / width) * width) * scale)).alias("__part"), F.max(value).alias("__m")
    )
    tops = banded.withColumn("__top", F.max("__m").over(Window.partitionBy(*item)))
    share = F.col("__part") * F.exp((F.col("__band") * width - F.col("__top")) * scale)
    totals = tops.groupBy(*item).agg(F.max("__top").alias("__top"), F.sum(share).alias("__total"))
    names = [f"__item{i}" for i in range(len(item))]
    totals = totals.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(item, names)], "__top", "__total")
    same = functools.reduce(lambda x, y: x & y, [df[f"`{c}`"].eqNullSafe(totals[n]) for c, n in zip(item, names)])
    return (
        df.join(totals, same)
        .drop(*names)
        .withColumn("probability", F.exp((value - F.col("__top")) * scale) / F.col("__total"))
        .withColumn("is_top", value == F.col("__top"))
        .drop("__top", "__total")
    )


def keyword_scores(df: DataFrame, answer: str, expected: str) -> DataFrame:
    """1 if any expected keyword occurs in the answer, ignoring case."""
    return df.withColumn("score", contains_any(F.col(answer), F.col(expected)).cast("int"))


def metrics_long(summary: DataFrame, ids: Mapping[str, str] | Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """A wide summary as one row per metric."""
    return summary.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        list(ids), list(metrics), "metric", "value"
    )


def uniqueness(df: DataFrame, item: str, by: Sequence[str] = (), approximate: bool = False) -> DataFrame:
    """Distinct items over all items."""
    distinct = F.approx_count_distinct(item) if approximate else F.count_distinct(F.col(item))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), distinct.alias("unique")).withColumn(
        "uniqueness", F.col("unique") / F.col("total")
    )


def novelty(items: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Items that the known set does not hold."""
    return items.join(known.select(key), key, "left_anti")
