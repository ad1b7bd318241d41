"""Batch calls of a caller's function over a table; a failure is a value, never a failed job."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathework.functions.templates import render
from lathework.functions.text import ERROR_PREFIX, GRADE_PATTERN, grade, is_error, word_count
from lathework.operators.messages import judge_followup, judge_request, message
from lathework.operators.ordering import keep_last, with_row_index
from lathework.operators.splits import cap_rows


_TEXTS = 64  # texts that are Python objects at a time


def with_retry(
    call: Callable[..., Any],
    tries: int = 4,
    delay: float = 0.5,
    factor: float = 2.0,
    fatal: Callable[[Exception], bool] = lambda error: False,
    sleep: Callable[[float], None] = time.sleep,
) -> Callable[..., Any]:
    """Repeat a failing call with growing pauses; a fatal error, or the last one, is passed on.

    Pauses hold a task slot, so the defaults are shorter than those of an interactive client.
    """

    def wrapped(*args: Any, **kwargs: Any) -> Any:
        pause = delay
        for attempt in range(tries):
            try:
                return call(*args, **kwargs)
            except Exception as error:
                if fatal(error) or attempt == tries - 1:
                    raise
                sleep(pause)
                pause *= factor

    return wrapped


def _stretches(batch: Any, rows: int) -> Iterator[Any]:
    """Consecutive rows of an Arrow batch, so that only these become Python objects at a time."""
    return (batch.slice(start, rows) for start in range(0, len(batch), rows))


def batch_infer(
    df: DataFrame,
    call: Callable[[Any], str],
    request: str,
    answer: str = "llm_inference",
    batch_size: int = 64,
    workers: int = 1,
) -> DataFrame:
    """``call(request)`` for each row; an exception becomes the text ``**ERROR**: message``.

    Only the request goes through Python, ``batch_size`` rows at a time. The call counts as nondeterministic, so Spark moves no predicate
    through it and makes it once per row. ``workers`` threads serve calls that wait
    on a network. Write the result before reading it twice, so that no call is repeated.
    """
    @F.arrow_udf("string")
    def ask(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with ThreadPoolExecutor(workers) as pool:
            each = pool.map if workers > 1 else map
            for batch in batches:
                answers = [pa.array([], pa.string())]
                for part in _stretches(batch, batch_size):
                    answers.append(pa.array(list(each(guarded, part.to_pandas())), pa.string(), from_pandas=True))
                yield pa.concat_arrays(answers)

    def guarded(value: Any) -> str:
        try:
            return call(value)
        except Exception as error:
            return f"{ERROR_PREFIX}: {error}"

    return df.withColumn(answer, ask.asNondeterministic()(F.col(request)))


def inference_rows(
    df: DataFrame,
    call: Callable[[Any], str],
    template: str,
    context: str,
    gold: str,
    order_by: Sequence[str],
    document_id: str | None = None,
    max_tokens: int | None = None,
    count: Callable[[Column], Column] = word_count,
    subset: int = 0,
    batch_size: int = 64,
    workers: int = 1,
) -> DataFrame:
    """Ask a model about each document and keep what scoring needs.

    The prompt is the template with ``{context}`` filled in; prompts over ``max_tokens`` are left out before
    the ``subset`` is counted. Without an id column the row index (taken before any filter) is the id. Gives
    ``llm_inference, gold_standard_result, context_document_id, context_document, prompt_template``.
    """
    if document_id is None:
        df, document_id = with_row_index(df, order_by, name="__doc"), "__doc"
    order = [f"__order{i}" for i in range(len(order_by))]
    rows = df.select(
        F.array(F.col(gold).cast("string")).alias("gold_standard_result"),
        F.col(document_id).cast("string").alias("context_document_id"),
        F.col(context).alias("context_document"),
        F.lit(template).alias("prompt_template"),
        render(template, {"context": F.col(context)}).alias("__prompt"),
        *[F.col(c).alias(name) for c, name in zip(order_by, order)],
    )
    if max_tokens is not None:
        rows = rows.where(count(F.col("__prompt")) <= max_tokens)
    if subset > 0:
        rows = cap_rows(rows, order, subset)
    asked = rows.withColumn("__request", F.array(message("user", F.col("__prompt")))).drop("__prompt", *order)
    return batch_infer(asked, call, "__request", "llm_inference", batch_size, workers).drop("__request")


def token_counts(text: Column, count: Callable[[str], int]) -> Column:
    """Token counts by a caller's tokenizer, in Arrow batches."""

    @F.arrow_udf("int")
    def counted(texts: pa.Array) -> pa.Array:
        each = (t for part in _stretches(texts, _TEXTS) for t in part.to_pylist())
        return pa.array([0 if t is None else count(t) for t in each], pa.int32())

    return counted.asNondeterministic()(text)


def tokenize(df: DataFrame, key: str, text: str, encode: Callable[[str], Sequence[int]]) -> DataFrame:
    """``key, tokens, n_tokens`` by a caller's tokenizer."""
    schema = T.StructType(
        [df.schema[key], T.StructField("tokens", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.IntegerType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _stretches(batch, _TEXTS):
                tokens = pa.array([list(encode(t)) for t in part.column(1).to_pylist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), tokens, tokens.value_lengths()], names=[key, "tokens", "n_tokens"])

    return df.select(key, text).mapInArrow(run, schema)


def embed(
    df: DataFrame,
    text: str,
    call: Callable[[list[str]], Sequence[Sequence[float]]],
    vector: str = "embedding",
    batch_size: int = 1024,
) -> DataFrame:
    """A vector per row by a caller's function over up to ``batch_size`` texts; a NULL text has none and is not sent.

    Nondeterministic to Spark, so that a filter on the vector does not call the model again.
    """

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            found = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            there = batch.dropna()
            for start in range(0, len(there), batch_size):
                part = there.iloc[start : start + batch_size]
                for place, v in zip(part.index, call(part.tolist())):
                    found.at[place] = [float(x) for x in v]
            yield found

    return df.withColumn(vector, vectors.asNondeterministic()(F.col(text)))


def drop_failed(df: DataFrame, answer: str) -> DataFrame:
    """Without answers that are missing or report an error."""
    return df.where(~is_error(F.col(answer)))


def judge_two_step(
    df: DataFrame,
    call: Callable[[Any], str],
    template: str,
    grade_request: str,
    context: str = "context_document",
    answer: str = "llm_inference",
    pattern: str = GRADE_PATTERN,
    batch_size: int = 64,
    workers: int = 1,
) -> DataFrame:
    """Ask for an explanation, then for a grade; a row fails if either call does or no grade is stated.

    Adds ``judge_explanation``, ``judge_answer``, ``judge_grade`` (NULL if the row failed).
    """
    asked = df.withColumn("__request", judge_request(template, F.col(context), F.col(answer)))
    explained = batch_infer(asked, call, "__request", "judge_explanation", batch_size, workers)
    explained = drop_failed(explained, "judge_explanation").withColumn(
        "__request", judge_followup(F.col("__request"), F.col("judge_explanation"), grade_request)
    )
    graded = batch_infer(explained, call, "__request", "judge_answer", batch_size, workers)
    return (
        drop_failed(graded, "judge_answer")
        .withColumn("judge_grade", grade(F.col("judge_answer"), pattern))
        .where(F.col("judge_grade").isNotNull())
        .drop("__request")
    )


def judged_fields(judged: DataFrame, key: str, order_by: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Stored fields of the last judgement of each document: grades, generations, explanations, whole prompts."""
    return keep_last(judged.select(key, *[c for c in order_by if c != key], *fields), [key], order_by).select(key, *fields)


def judge_summary(candidates: DataFrame, judged: DataFrame, key: str, grade_column: str, order_by: Sequence[str]) -> DataFrame:
    """Mean grade over the last judgement of each document, and how many candidates got none."""
    last = judged.groupBy(key).agg(F.max_by(F.col(grade_column), F.struct(*order_by)).alias("__g"))
    n = candidates.agg(F.count_distinct(F.col(key)).alias("n")).scalar()
    return last.agg(F.avg("__g").alias("mean_grade"), F.count(F.lit(1)).alias("judged")).select(
        "mean_grade", n.alias("candidates"), "judged", (n - F.col("judged")).alias("missing")
    )
