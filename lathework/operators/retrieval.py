"""Exact nearest neighbours and retrieval prompts for a table of questions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lathework.functions.templates import render
from lathework.functions.text import strip
from lathework.operators.inference import embed
from lathework.operators.messages import message
from lathework.session import materialize

BLOCK_BYTES = 64 << 20  # vectors of one side that a task holds
_SCAN_CELLS = 4_000_000  # scores a task holds at a time
_TILE = 512, 2048  # questions and items whose products of single precision a task holds at a time
_EXACT = 1 << 16  # pairs whose vectors a task gathers at a time
_PAIRS_PER_CORE = 4  # pairs of blocks, if the blocks get no smaller than this:
_LEAST_BLOCK = 1024


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows of doubles; they do not become Python objects. A null component is not a number."""
    widths = pc.unique(pc.list_value_length(vectors)).to_pylist()
    if len(widths) > 1:
        raise ValueError(f"vectors of different lengths: {sorted(widths)[:5]}")
    flat = pc.list_flatten(vectors).to_numpy().astype("float64")
    return flat.reshape(len(vectors), widths[0]) if widths else np.zeros((0, 0))


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


Best = tuple[np.ndarray, np.ndarray, np.ndarray]  # question row, item id, score


def _nothing() -> Best:
    return np.empty(0, dtype="int64"), np.empty(0, dtype="int64"), np.empty(0)


def _kept(found: Best, k: int) -> Best:
    """Best score first, then smallest id, and the first ``k`` of each question."""
    row, item, score = found
    order = np.lexsort((item, -score, row))
    row, item, score = row[order], item[order], score[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], item[kept], score[kept]


def _better(best: Best, questions: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, digits: int) -> Best:
    """The best ``k`` items per question of those so far and some more, scored a bounded number at a time."""
    step = max(64, _SCAN_CELLS // max(1, len(questions)))
    for start in range(0, len(ids), step):
        scores = np.round(questions @ vectors[start : start + step].T, digits)
        if scores.shape[1] > k:
            row, column = np.nonzero(scores >= np.partition(scores, -k, axis=1)[:, -k][:, None])
        else:
            row, column = np.nonzero(np.ones(scores.shape, dtype=bool))
        found = row, ids[start : start + step][column], scores[row, column]
        best = _kept(tuple(np.concatenate(pair) for pair in zip(best, found)), k)
    return best


def _first_copies(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """Places of the items that may be among any question's best ``k``: of equal vectors the ``k`` with the smallest ids."""
    same = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.itemsize * vectors.shape[1]))).ravel(), return_inverse=True)[1]
    order = np.lexsort((ids, same))
    same = same[order]
    return order[np.arange(len(same)) - np.searchsorted(same, same) < k]


def _search(questions: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int, digits: int) -> Best:
    """The best ``k`` items per question. Products of single precision, with a bound on their error, rule items out; the rest are scored in double precision.

    Both sides go by tiles, so memory does not grow with their product.
    """
    largest = max(np.abs(questions).max(initial=0), np.abs(vectors).max(initial=0)) if vectors.shape[1] else np.inf
    if not largest < 1e15:  # missing or huge components: the plain way
        return _better(_nothing(), questions, ids, vectors, k, digits)
    kept = _first_copies(ids, vectors, k)
    ids, vectors = ids[kept], vectors[kept]
    asked, stored = questions.astype("float32"), vectors.astype("float32")
    norms = np.sqrt((questions * questions).sum(axis=1)) * np.sqrt((vectors * vectors).sum(axis=1).max(initial=0))
    slack = (vectors.shape[1] + 8) * 2.0**-23 * norms + 10.0**-digits + 1e-30
    parts = [_nothing()]
    for first in range(0, len(questions), _TILE[0]):
        rows = slice(first, first + _TILE[0])
        best = _nothing()
        floors = np.full(len(asked[rows]), -np.inf)
        for start in range(0, len(ids), _TILE[1]):
            scores = asked[rows] @ stored[start : start + _TILE[1]].T
            if start == 0 and scores.shape[1] > k:
                floors = np.partition(scores, -k, axis=1)[:, -k] - slack[rows]
            bounds = np.nextafter((floors - slack[rows]).astype("float32"), np.float32(-np.inf))
            hit = np.flatnonzero(scores >= bounds[:, None])
            for piece in range(0, len(hit), _EXACT):
                row, column = np.divmod(hit[piece : piece + _EXACT], scores.shape[1])
                column += start
                exact = np.round(np.einsum("ij,ij->i", questions[rows][row], vectors[column]), digits)
                best = _kept(tuple(np.concatenate(pair) for pair in zip(best, (row, ids[column], exact))), k)
            if len(best[0]) == k * len(floors):
                floors = best[2][k - 1 :: k]
        parts.append((best[0] + first, *best[1:]))
    return tuple(np.concatenate(column) for column in zip(*parts))


def _as_table(asked: pa.Table, best: Best, schema: pa.Schema) -> pa.Table:
    row, item, score = best
    columns = asked["question_id"].take(pa.array(row)), pa.array(item, from_pandas=True), pa.array(score, from_pandas=True)
    return pa.Table.from_arrays([c.cast(field.type) for c, field in zip(columns, schema)], schema=schema)


def _block_pairs(
    questions: DataFrame, banks: int, items: DataFrame, blocks: int, schema: T.StructType, prepare: Any, k: int, digits: int
) -> DataFrame:
    """Digests cut both sides into even blocks and each pair of blocks meets in one task."""

    def block(column: str, n: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(n))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))

    left = questions.withColumn("q", block("question_id", banks)).withColumn("i", every(blocks))
    right = items.withColumn("i", block("item_id", blocks)).withColumn("q", every(banks))

    arrow = to_arrow_schema(schema)

    def run(asked: pa.Table, stored: pa.Table) -> pa.Table:
        best = _nothing()
        if len(asked) and len(stored):
            vectors = prepare(_matrix(stored["vector"]))
            best = _search(prepare(_matrix(asked["vector"])), stored["item_id"].to_numpy(), vectors, k, digits)
        return _as_table(asked, best, arrow)

    return left.groupBy("q", "i").cogroup(right.groupBy("q", "i")).applyInArrow(run, schema)


def _blocks(asked: DataFrame, stored: DataFrame, block_bytes: int) -> list[int]:
    """Blocks of two tables of vectors: twice as many as their doubles fill, as blocks are even on average only, and enough pairs for all cores."""
    counts, parts = [], []
    for side in (asked, stored):
        rows, width = side.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
        counts.append(rows)
        parts.append(max(1, -(-2 * rows * max(1, width) * 8 // block_bytes)))
    wanted = _PAIRS_PER_CORE * asked.sparkSession.sparkContext.defaultParallelism
    while parts[0] * parts[1] < wanted:
        longer = 0 if counts[0] // parts[0] > counts[1] // parts[1] else 1
        if counts[longer] // parts[longer] < 2 * _LEAST_BLOCK:
            break
        parts[longer] += 1
    return parts


def nearest(
    questions: DataFrame,
    question: str,
    question_vector: str,
    items: DataFrame,
    item: str,
    item_vector: str,
    k: int,
    cosine: bool = True,
    digits: int = 9,
    block_bytes: int = BLOCK_BYTES,
    items_written: bool = False,
) -> DataFrame:
    """The ``k`` most similar items of each question, exactly; ``question_id, item_id, score, rank``.

    Item ids are integers. Both sides are cut into blocks of at most about ``block_bytes``, and each pair of blocks
    meets in one task, which emits only ``k`` items per question; nothing passes through the driver. Scores are compared after rounding to
    ``digits``, ties go to the smaller id; ``k`` is at least one and at most the number of items. Vectors may come from a model, so
    both sides are written before they are counted and paired; ``items_written`` says that the items are a stored table already.
    """
    k = max(1, k)
    asked = questions.select(F.col(question).alias("question_id"), F.col(question_vector).alias("vector"))
    asked = asked.where(F.col("vector").isNotNull())
    stored = items.select(F.col(item).alias("item_id"), F.col(item_vector).alias("vector"))
    stored = stored.where(F.col("vector").isNotNull())
    schema = T.StructType([asked.schema["question_id"], stored.schema["item_id"], T.StructField("score", T.DoubleType())])
    prepare = _unit if cosine else np.asarray
    asked, stored = materialize(asked, "questions"), stored if items_written else materialize(stored, "items")
    banks, blocks = _blocks(asked, stored, block_bytes)
    candidates = _block_pairs(asked, banks, stored, blocks, schema, prepare, k, digits)
    best = Window.partitionBy("question_id").orderBy(F.col("score").desc(), F.col("item_id"))
    return candidates.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def class_scores(items: DataFrame, vector: str, classes: DataFrame, name: str, class_vector: str, block_rows: int = 256) -> DataFrame:
    """A row for each item and class: the item's other columns, ``class`` and ``score``, the dot product of the two vectors.

    Classes are a table of any size, cut into blocks of about ``block_rows``; a copy of each item meets each block.
    """
    blocks = max(1, -(-classes.count() // block_rows))
    place = F.pmod(F.xxhash64(name), F.lit(blocks))
    banks = classes.groupBy(place.alias("__block")).agg(
        F.collect_list(F.struct(F.col(name).alias("class"), F.col(class_vector).alias("e"))).alias("__bank")
    )
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    met = items.withColumn("__block", every).join(banks, "__block")
    others = [c for c in items.columns if c != vector]

    def dot(e: Column) -> Column:
        products = F.zip_with(F.col(vector), e, lambda a, b: a.cast("double") * b.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)

    scored = met.select(*others, F.explode(F.transform("__bank", lambda c: F.struct(c["class"].alias("class"), dot(c["e"]).alias("score")))).alias("__s"))
    return scored.select(*others, "__s.class", "__s.score")


# Fixed value: the frame around the passages and the question.
PROMPT_FRAME = (
    "Using only the context below, answer the following question.\n\n"
    "Context:\n{context}\n\n"
    "Question: {question}\n\n"
    "If the context does not contain the answer, state that the information is not available in the provided text."
)


# Fixed value: what the system turn says.
SYSTEM_TURN = "You are a precise assistant. Never use outside knowledge; rely only on the provided Context."


def retrieval_prompts(
    hits: DataFrame, questions: DataFrame, question: str, text: str, frame: str = PROMPT_FRAME, system: str | None = None
) -> DataFrame:
    """Passages of each question (at most ``k``, first of equal ones) in rank order inside the frame.

    ``hits`` has ``question_id, rank, text``. Adds ``context``, ``prompt`` and ``passages`` to the questions, and with ``system`` the ``messages`` of a
    model call. A question without passages, or with a NULL id, stays, with an empty context.
    """
    first = hits.groupBy("question_id", F.sha2(strip(F.col("text")), 256).alias("__same")).agg(
        F.min_by(F.struct("rank", "text"), F.col("rank")).alias("__hit")
    )
    passages = first.groupBy("question_id").agg(F.array_sort(F.collect_list("__hit")).alias("__hits"))
    context = F.coalesce(F.array_join(F.transform("__hits", lambda hit: hit["text"]), "\n\n"), F.lit(""))
    joined = questions.join(passages, questions[question] == passages["question_id"], "left").withColumn("context", context)
    out = joined.withColumn("prompt", render(frame, {"context": F.col("context"), "question": F.col(text)})).withColumn(
        "passages", F.coalesce(F.size("__hits"), F.lit(0))
    )
    if system is not None:
        out = out.withColumn("messages", F.array(message("system", F.lit(system)), message("user", F.col("prompt"))))
    return out.drop("__hits", "question_id")


def answer_prompts(
    questions: DataFrame,
    question: str,
    text: str,
    chunks: DataFrame,
    chunk_id: str,
    call: Callable[[list[str]], Sequence[Sequence[float]]],
    k: int,
    hint: str | None = None,
    frame: str = PROMPT_FRAME,
    system: str | None = SYSTEM_TURN,
) -> DataFrame:
    """Embed deduplicated chunks and questions, retrieve, deduplicate, and build one prompt per question that is not blank.

    Where the column ``hint`` is not blank, it is searched for in place of the question, which the prompt still asks; ``searched_by`` tells which. Chunks are
    embedded and written once. Without chunks every question stays, with an empty context.
    """
    def filled(column: str) -> Column:
        return F.nullif(strip(F.col(column)), F.lit(""))

    store = materialize(embed(chunks.select(chunk_id, "text"), "text", call), "chunk-store")
    asked = questions.where(filled(text).isNotNull())
    hinted = filled(hint) if hint else F.lit(None).cast("string")
    asked = asked.withColumn("searched_by", F.when(hinted.isNotNull(), "hint").otherwise("question"))
    searched = embed(asked.select(question, F.coalesce(hinted, filled(text)).alias("__search")), "__search", call)
    hits = nearest(searched, question, "embedding", store, chunk_id, "embedding", k, items_written=True)
    hits = hits.join(store.select(F.col(chunk_id).alias("item_id"), "text"), "item_id")
    return retrieval_prompts(hits, asked.withColumn(text, strip(F.col(text))), question, text, frame, system)
