"""Cut documents into passages."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.functions.text import strip
from lathework.operators.ordering import keep_first

CHUNK_SIZE = 800
CHUNK_OVERLAP = 100
SEPARATORS = ("\n\n", "\n", " ", "")


def fixed_chunks(df: DataFrame, key: str, text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Windows of ``size`` characters that overlap by ``overlap``; ``key, pos, text`` rows.

    The last window is the first that reaches the end of the text.
    """
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than size")
    length = F.length(text)
    last = F.greatest(F.ceil((length - overlap) / step), F.lit(1)).cast("int")
    return df.where(length > 0).select(
        key,
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), last - 1), lambda i: F.substring(F.col(text), i * step + 1, F.lit(size))
            )
        ).alias("pos", "text"),
    )


Span = tuple[int, int]


def _pieces(text: str, start: int, end: int, separator: str) -> Iterator[Span]:
    """Cut before each separator, which stays at the head of the piece it opens."""
    step = len(separator) or 1
    at = start
    while at < end:
        # the cut after a piece that opens with a separator is the next one behind it
        head = at + step if text.startswith(separator, at, end) else at
        cut = (text.find(separator, head, end) if separator else head) if head < end else end
        cut = end if cut < 0 else cut
        yield at, cut
        at = cut


def _merge(pieces: Sequence[Span], size: int, overlap: int) -> Iterator[Span]:
    """Join neighbouring pieces up to ``size``, carrying at most ``overlap`` characters over."""
    window: deque[int] = deque()  # where the pieces of the window start
    end = 0
    for start, stop in pieces:
        if window and stop - window[0] > size:
            yield window[0], end
            while window and (end - window[0] > overlap or stop - window[0] > size):
                window.popleft()
        window.append(start)
        end = stop
    if window:
        yield window[0], end


def _split(text: str, start: int, end: int, size: int, overlap: int, separators: Sequence[str]) -> Iterator[Span]:
    level = next((i for i, mark in enumerate(separators) if mark == "" or text.find(mark, start, end) >= 0), None)
    if level is None:
        yield start, end
        return
    finer = separators[level + 1 :]
    run: list[Span] = []
    for a, b in _pieces(text, start, end, separators[level]):
        if b - a < size or (not finer and b - a <= size):
            run.append((a, b))
            continue
        yield from _merge(run, size, overlap)
        run = []
        if finer:
            yield from _split(text, a, b, size, overlap, finer)
        else:
            yield a, b
    yield from _merge(run, size, overlap)


def split_spans(
    text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: Sequence[str] = SEPARATORS
) -> Iterator[tuple[int, str]]:
    """Passages, trimmed, with the place of their first character. Cut at the coarsest separator present; only pieces that are still too long are cut finer."""
    for start, end in _split(text, 0, len(text), size, overlap, separators):
        body = text[start:end].lstrip()
        if body:
            yield end - len(body), body.rstrip()


def split_text(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """The passages alone."""
    return [chunk for _, chunk in split_spans(text, size, overlap, separators)]


@F.udtf(returnType="pos int, text string, start int", useArrow=False)
class RecursiveSplit:
    """Table function: the passages of one text, in order, with their place in it. ``register_split`` names it for SQL."""

    def eval(self, text: str, size: int, overlap: int, separators: list[str]):
        for pos, (start, chunk) in enumerate(split_spans(text, size, overlap, separators) if text is not None else ()):
            yield pos, chunk, start


def register_split(spark: SparkSession, name: str = "recursive_split") -> str:
    """Make the table function known to SQL: ``SELECT ... FROM docs, LATERAL recursive_split(text, 800, 100, array(...))``."""
    spark.udtf.register(name, RecursiveSplit)
    return name


def recursive_chunks(
    df: DataFrame,
    key: str,
    text: str,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    separators: Sequence[str] = SEPARATORS,
) -> DataFrame:
    """``key, pos, text, start``: passages cut at paragraph, line, word and character boundaries; ``start`` counts characters from 0.

    A lateral join with a table function, so passages leave the task one by one; sequential only inside a document.
    NULL, empty and blank texts have no passages; keys may repeat or be NULL.
    """
    docs = df.select(F.col(key).alias("__key"), F.col(text).alias("__text")).where(F.col("__text").isNotNull())
    marks = F.array(*[F.lit(mark) for mark in separators])
    cut = RecursiveSplit(F.col("__text").outer(), F.lit(size), F.lit(overlap), marks)
    return docs.lateralJoin(cut).select(F.col("__key").alias(key), "pos", "text", "start")


def not_blank(df: DataFrame, text: str) -> DataFrame:
    return df.where(F.length(strip(F.col(text))) > 0)


def dedup_chunks(chunks: DataFrame, text: str = "text", order_by: Sequence[str] = ("doc_id", "pos")) -> DataFrame:
    """The first of the passages that are equal once trimmed."""
    return keep_first(not_blank(chunks, text), strip(F.col(text)), order_by, wide=True)


def with_source(chunks: DataFrame, documents: DataFrame, key: str, *columns: str) -> DataFrame:
    """Each passage with columns of its document."""
    return chunks.join(documents.select(key, *columns), key)
