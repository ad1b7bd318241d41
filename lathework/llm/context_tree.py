"""Language-model scores by context-tree weighting over bytes.

A byte is eight binary decisions; each decision (the bits before it in the byte) has a context tree of its own, whose nodes are the last 0, 1, ...
``depth`` bytes. A node estimates its next bit by Krichevsky and Trofimov's rule from what the corpus showed there, and the tree mixes the estimates of
all depths: a node's weight against its children is the probability it gave the corpus against theirs. After learning the weights stay,
so a byte's probability depends on it and the ``depth`` bytes before it alone: a text's score is a sum over its grams of ``depth + 1`` bytes.

All distinct grams of all texts travel, never a sample: documents are written as blocks of some megabytes, a block sends its distinct grams with their training counts,
dealt by context into buckets, as many as the texts ask for. A bucket adds them up and works out the two deepest levels; the levels above,
whose nodes are few, are sums and joins of DataFrames. Back down, each bucket prices its grams and answers the blocks that sent them, and each block scores
its texts from the answers. Words for the unigram base go the same way, in buckets of their own.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lathework.llm.common import Scratch

#: Bytes of context. A gram, with the byte after them, must fit 63 bits.
DEPTH, DEEPEST = 5, 6
#: Text bytes of a block of documents, and of a piece that is coded at a time.
BLOCK_BYTES, PIECE_BYTES = 32 << 20, 2 << 20
#: Text bytes for each bucket of contexts or of words; a task takes some buckets and holds one at a time, or some small ones.
BUCKET_BYTES, LEAST_BITS, MOST_BITS = 4 << 20, 6, 26
#: Grams that are worked on together.
BATCH_GRAMS = 1 << 17
#: A byte that no UTF-8 text holds: stands before each text and ends it.
END = b"\xff"
_HASH = np.uint64(0x9E3779B97F4A7C15)
_FACTOR = 1640531527  # below 2^31, so that its product with 32 bits fits a long
_LN2 = math.log(2.0)


# Estimates. The formulas hold for NumPy arrays and for Spark columns alike.


def log_gamma(x, log: Callable):
    """Logarithm of the gamma function for x >= 1/2: Stirling's series eight places up, less the factors between."""
    y = x + 8.0
    series = 1.0 / (y * 12.0) - 1.0 / (y * y * y * 360.0) + 1.0 / (y * y * y * y * y * 1260.0) - 1.0 / (y * y * y * y * y * y * y * 1680.0)
    between = x
    for k in range(1, 8):
        between = between * (x + float(k))
    return (y - 0.5) * log(y) - y + series + 0.5 * math.log(2 * math.pi) - log(between)


def log_estimate(zeros, ones, log: Callable):
    """Log probability that a node gives all its bits: Krichevsky and Trofimov's estimate."""
    return log_gamma(zeros + 0.5, log) + log_gamma(ones + 0.5, log) - log_gamma(zeros + ones + 1.0, log) - math.log(math.pi)


def _weighted(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    return np.logaddexp(own, children) - _LN2


def _stay(own: np.ndarray, children: np.ndarray) -> np.ndarray:
    """Share of a node's own estimate against its children's."""
    return 1.0 / (1.0 + np.exp(np.minimum(children - own, 700.0)))


# Grams of texts: the bytes before, the last one first, then the byte itself.


def _pieces(texts: Iterable[bytes], depth: int, limit: int) -> Iterator[list[tuple[int, bytes, int]]]:
    """Lists of ``(row, bytes, count)``: ``depth`` bytes of context and ``count`` bytes to code; a long text is cut, no byte is left out."""
    held, size = [], 0
    for row, text in enumerate(texts):
        whole = END * depth + text + END
        for start in range(0, len(text) + 1, limit):
            part = whole[start : start + limit + depth]
            held.append((row, part, len(part) - depth))
            size += len(part)
            if size >= limit:
                yield held
                held, size = [], 0
    if held:
        yield held


def _grams(pieces: list[tuple[int, bytes, int]], depth: int) -> np.ndarray:
    """Grams of all coded bytes of some pieces, in order."""
    raw = np.frombuffer(b"".join(p for _, p, _ in pieces), np.uint8)
    sizes = np.array([n for _, _, n in pieces])
    coded = np.ones(len(raw), bool)
    starts = np.cumsum(sizes + depth) - sizes - depth
    coded[(starts[:, None] + np.arange(depth)).ravel()] = False
    wide = raw.astype(np.int64)
    gram = wide[depth:].copy()
    for back in range(1, depth + 1):
        gram |= wide[depth - back : len(raw) - back] << (8 * (depth + 1 - back))
    return gram[coded[depth:]]


def _summed(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the values of equal ones added up."""
    if not len(keys):
        return keys, *values
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], *(np.add.reduceat(v[order], first) for v in values)


def _bucket(grams: np.ndarray, bits: int) -> np.ndarray:
    """Bucket of each gram's last ``depth - 2`` bytes of context, at most 32 bits: product hashing, in longs."""
    return (((grams >> 24) * _FACTOR) % (1 << 32) >> (32 - bits)).astype(np.int32)


def _node_bucket(node: Column, bits: int) -> Column:
    """The bucket of the grams below a node, as a column."""
    mixed = (F.shiftright(node, 8) * F.lit(_FACTOR)) % F.lit(1 << 32)
    return F.shiftright(mixed, 32 - bits).cast("int")


# Numbers travel by their bytes: first the low ones of all, then the next, so that the shuffle's compression sees the empty ones.


def _planes(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T.tobytes()


def _whole(data: bytes, dtype=np.int64) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(dtype).ravel()


def _steps(grams: np.ndarray) -> bytes:
    """Grams in order, as the first and the differences."""
    return _planes(np.diff(grams, prepend=0))


def _walk(data: bytes) -> np.ndarray:
    return np.cumsum(_whole(data))


def _rounded(prices: np.ndarray) -> np.ndarray:
    """Rounded to 36 bits after the first, a relative error below 1e-11, so that two of the eight bytes are empty."""
    return ((prices.view(np.int64) + (1 << 15)) >> 16 << 16).view(np.float64)


def _by_bucket(grams: np.ndarray, counts: np.ndarray, bits: int) -> list[pa.Array]:
    """Buckets that occur, their grams in order, and the counts beside them."""
    bucket = _bucket(grams, bits)
    order = np.lexsort((grams, bucket))
    there, first = np.unique(bucket[order], return_index=True)
    grams, counts = (np.split(x[order], first[1:])[: len(there)] for x in (grams, counts))
    return [pa.array(there, pa.int32()), pa.array(map(_steps, grams), pa.binary()), pa.array(map(_planes, counts), pa.binary())]


# The two deepest levels of a bucket's trees


def _parent(nodes: np.ndarray) -> np.ndarray:
    """A node is its context, the last byte first, and the decision in the low byte; its parent lacks the oldest byte."""
    return ((nodes >> 16) << 8) | (nodes & 255)


class Leaves:
    """The nodes of the two deepest levels on the way of some grams; grams of equal parents' parents belong together."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        symbol, context = grams & 255, grams >> 8
        steps = np.arange(8)[:, None]
        decision = (1 << steps) | (symbol >> (8 - steps))
        self.bit = ((symbol >> (7 - steps)) & 1).ravel()
        n = np.tile(counts.astype(np.float64), 8)
        self.low, self.low_of = np.unique(((context << 8) | decision).ravel(), return_inverse=True)
        self.low_bits = self._sums(self.low_of, len(self.low), n * (1 - self.bit), n * self.bit)
        own = log_estimate(*self.low_bits, np.log)
        self.high, self.high_of = np.unique(_parent(self.low), return_inverse=True)
        *self.high_bits, self.children = self._sums(self.high_of, len(self.high), *self.low_bits, own)
        self.own = log_estimate(*self.high_bits, np.log)

    @staticmethod
    def _sums(place: np.ndarray, size: int, *values: np.ndarray) -> list[np.ndarray]:
        return [np.bincount(place, v, size) for v in values]

    def above(self) -> tuple[np.ndarray, ...]:
        """Nodes of the level above with the sums of their bits and of their children's log probabilities."""
        return _summed(_parent(self.high), *self.high_bits, _weighted(self.own, self.children))

    def prices(self, nodes: np.ndarray, zero: np.ndarray, one: np.ndarray, rest: np.ndarray) -> np.ndarray:
        """Log probability of each gram's last byte after its context; the arguments are what the levels above give (see ``_downwards``)."""

        def estimate(bits: list[np.ndarray], place: np.ndarray) -> np.ndarray:
            zeros, ones = bits[0][place], bits[1][place]
            return (np.where(self.bit, ones, zeros) + 0.5) / (zeros + ones + 1.0)

        high = self.high_of[self.low_of]
        stay = _stay(self.own, self.children)[high]
        deep = stay * estimate(self.high_bits, high) + (1.0 - stay) * estimate(self.low_bits, self.low_of)
        top = np.searchsorted(nodes, _parent(self.high))[high]
        p = np.where(self.bit, one[top], zero[top]) + rest[top] * deep
        return np.log(p).reshape(8, -1).sum(axis=0)


# Spark


def _documents(docs: DataFrame, key: str, text: str, learns: Column, block_bytes: int) -> DataFrame:
    """``block, key, learns, text`` of all rows; a block is a stretch of a partition of about ``block_bytes``."""
    rows = docs.select(
        F.col(f"`{key}`").alias("key"), F.coalesce(learns, F.lit(False)).alias("learns"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")
    )
    schema = T.StructType([T.StructField("block", T.LongType()), *rows.schema.fields])
    names = [f.name for f in schema]

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 33, 0
        for batch in batches:
            out = []
            for n in pc.binary_length(batch.column(2)).to_pylist():
                if size and size + n > block_bytes:
                    block, size = block + 1, 0
                size += n + 1
                out.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), *batch.columns], names=names)

    return rows.mapInArrow(number, schema)


def _by_block(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Stretches of rows of one block."""
    for batch in batches:
        block = batch.column(0).to_numpy()
        edges = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(block)]
        for a, b in zip(edges, edges[1:]):
            if b > a:
                yield int(block[a]), batch.slice(a, b - a)


def _bytes(batch: pa.RecordBatch) -> list[bytes]:
    return batch.column(batch.schema.get_field_index("text")).cast(pa.large_binary()).to_pylist()


def _gram_counts(docs: DataFrame, depth: int, piece: int, bits: int) -> DataFrame:
    """``block, bucket, grams, counts``: the distinct grams of a block with their number in texts to learn from, which may be 0."""

    def rows(block: int, grams: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        columns = _by_bucket(grams, counts, bits)
        return pa.RecordBatch.from_arrays([pa.array([block] * len(columns[0]), pa.int64()), *columns], names=["block", "bucket", "grams", "counts"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, (np.empty(0, np.int64),) * 2
        for block, batch in _by_block(batches):
            if block != current:
                if len(held[0]):
                    yield rows(current, *held)
                current, held = block, (np.empty(0, np.int64),) * 2
            texts, learns = _bytes(batch), batch.column(2).to_pylist()
            for weight in (0, 1):
                for pieces in _pieces((t for t, use in zip(texts, learns) if use == weight), depth, piece):
                    own, n = np.unique(_grams(pieces, depth), return_counts=True)
                    held = _summed(np.concatenate([held[0], own]), np.concatenate([held[1], n * weight]))
        if len(held[0]):
            yield rows(current, *held)

    return docs.mapInArrow(count, "block long, bucket int, grams binary, counts binary")


def _buckets(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grams and summed counts of some whole buckets of a stream sorted by bucket, of about ``limit`` grams unless one has more."""
    last, held, size, fresh = None, [], 0, 0

    def merged() -> tuple[np.ndarray, np.ndarray]:
        return _summed(*(np.concatenate(x) for x in zip(*held)))

    for batch in batches:
        for bucket, grams, counts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "grams", "counts"))):
            if bucket != last and size > limit:
                yield merged()
                held, size, fresh = [], 0, 0
            elif fresh > max(4 * limit, size - fresh):
                held = [merged()]
                size, fresh = len(held[0][0]), 0
            last = bucket
            held.append((_walk(grams), _whole(counts)))
            size += len(held[-1][0])
            fresh += len(held[-1][0])
    if held:
        yield merged()


def _model(counted: DataFrame, batch_grams: int, bits: int) -> DataFrame:
    """``bucket, grams, counts`` of the whole corpus."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams, counts in _buckets(batches, batch_grams):
            yield pa.RecordBatch.from_arrays(_by_bucket(grams, counts, bits), names=["bucket", "grams", "counts"])

    dealt = counted.select("bucket", "grams", "counts").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(add, "bucket int, grams binary, counts binary")


_NODE = "node long, zeros double, ones double, children double"


def _leaf_sums(model: DataFrame, batch_grams: int) -> DataFrame:
    """Nodes two levels above the leaves, in parts to be added up."""

    def climb(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams, counts in _buckets(batches, batch_grams):
            for a, b in _stretches(grams, batch_grams):
                nodes, *sums = Leaves(grams[a:b], counts[a:b]).above()
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (nodes, *sums)], names=["node", "zeros", "ones", "children"])

    return model.mapInArrow(climb, _NODE)


def _stretches(grams: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Cuts of sorted grams into stretches of about ``limit`` that keep all of a context's parent together (at most 65,536 grams)."""
    context = grams >> 16
    edges, at = [0], 0
    while at < len(grams):
        at = int(np.searchsorted(context, context[min(at + limit, len(grams)) - 1], "right"))
        edges.append(at)
    return list(zip(edges, edges[1:]))


def _levels(leaf_sums: DataFrame, depth: int, scratch: Scratch) -> list[DataFrame]:
    """Nodes of the depths 0 to ``depth - 2``, each with its own log estimate and its children's."""
    found, rows = [], leaf_sums
    for _ in range(depth - 1):
        sums = rows.groupBy("node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "children")])
        level = scratch.keep(sums.withColumn("own", log_estimate(F.col("zeros"), F.col("ones"), F.log)), "level")
        found.append(level)
        more = F.greatest("own", "children") + F.log1p(F.exp(-F.abs(F.col("own") - F.col("children")))) - _LN2
        above = F.shiftleft(F.shiftright("node", 16), 8).bitwiseOR(F.col("node").bitwiseAND(255))
        rows = level.select(above.alias("node"), "zeros", "ones", more.alias("children"))
    return found[::-1]


def _downwards(levels: list[DataFrame], scratch: Scratch) -> DataFrame:
    """``node, zero, one, rest`` of the deepest of some levels.

    The probability of a bit is ``zero`` (or ``one``), what the levels so far give it, plus ``rest`` times what those below say.
    """
    stay = 1.0 / (1.0 + F.exp(F.least(F.col("children") - F.col("own"), F.lit(700.0))))
    total = F.col("zeros") + F.col("ones") + 1.0
    own = [((F.col(c) + 0.5) / total).alias(c) for c in ("zeros", "ones")]
    above = None
    for level in levels:
        here = level.select("node", *own, stay.alias("stay"))
        if above is None:
            here = here.select("*", F.lit(0.0).alias("zero"), F.lit(0.0).alias("one"), F.lit(1.0).alias("rest"))
        else:
            up = F.shiftleft(F.shiftright("node", 16), 8).bitwiseOR(F.col("node").bitwiseAND(255))
            here = here.withColumn("up", up).join(above.withColumnRenamed("node", "up"), "up")
        above = here.select(
            "node", *[(F.col(a) + F.col("rest") * F.col("stay") * F.col(b)).alias(a) for a, b in (("zero", "zeros"), ("one", "ones"))],
            (F.col("rest") * (1.0 - F.col("stay"))).alias("rest"),
        )
        above = scratch.keep(above, "mixture")
    return above


def _answers(counted: DataFrame, model: DataFrame, top: DataFrame, batch_grams: int, bits: int) -> DataFrame:
    """``block, grams, prices``: to each block the log probabilities of its grams."""
    nothing = F.lit(None)
    columns = {"block": "long", "grams": "binary", "counts": "binary", "node": "long", "zero": "double", "one": "double", "rest": "double"}

    def kind(df: DataFrame, number: int, *own: str) -> DataFrame:
        return df.select("bucket", F.lit(number).alias("kind"), *[c if c in own else nothing.cast(t).alias(c) for c, t in columns.items()])

    with_bucket = top.withColumn("bucket", _node_bucket(F.col("node"), bits))
    met = kind(with_bucket, 0, "node", "zero", "one", "rest").unionAll(kind(model, 1, "grams", "counts"))
    met = met.unionAll(kind(counted, 2, "block", "grams"))

    def price(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, grams, asked, size, known = [], [], [], 0, None

        def answer() -> pa.RecordBatch:
            nonlocal known
            known = known or _priced(nodes, grams, batch_grams)
            prices = [_planes(known[1][np.searchsorted(known[0], _walk(g))]) for _, g in asked]
            blocks, wanted = zip(*asked)
            return pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int64()), pa.array(wanted, pa.binary()), pa.array(prices, pa.binary())], names=["block", "grams", "prices"]
            )

        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            edges = [0, *(np.flatnonzero(kinds[1:] != kinds[:-1]) + 1).tolist(), len(kinds)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if kinds[a] == 0 and (known or size > batch_grams):  # a new bucket, and enough of those before
                    if asked:
                        yield answer()
                    nodes, grams, asked, size, known = [], [], [], 0, None
                if kinds[a] == 0:
                    nodes.append([part.column(c).to_numpy() for c in ("node", "zero", "one", "rest")])
                elif kinds[a] == 1:
                    more = list(zip(part.column("grams").to_pylist(), part.column("counts").to_pylist()))
                    grams += more
                    size += sum(len(g) for g, _ in more) // 8
                else:
                    for block, own in zip(part.column("block").to_pylist(), part.column("grams").to_pylist()):
                        asked.append((block, own))
                        size += len(own) // 8
                        if size > 8 * batch_grams:
                            yield answer()
                            asked, size = [], 0
        if asked:
            yield answer()

    dealt = met.repartition("bucket").sortWithinPartitions("bucket", "kind")
    return dealt.mapInArrow(price, "block long, grams binary, prices binary")


def _priced(nodes: list, grams: list, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """All grams of some buckets in order, and the log probability of each."""
    top = [np.concatenate(x) for x in zip(*nodes)]
    order = np.argsort(top[0])
    top = [x[order] for x in top]
    own, counts = _summed(np.concatenate([_walk(g) for g, _ in grams]), np.concatenate([_whole(n) for _, n in grams]))
    return own, _rounded(np.concatenate([Leaves(own[a:b], counts[a:b]).prices(*top) for a, b in _stretches(own, limit)]))


class Prices:
    """Log probabilities by gram: most are found at the place a product hash names, the others by search."""

    def __init__(self, grams: np.ndarray, prices: np.ndarray):
        self.grams, first = np.unique(grams, return_index=True)
        self.prices = prices[first]
        bits = max(8, (4 * len(self.grams)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.at = np.zeros(1 << bits, np.int32)
        self.at[self._slot(self.grams)] = np.arange(len(self.grams))

    def _slot(self, grams: np.ndarray) -> np.ndarray:
        return (grams.view(np.uint64) * _HASH) >> self.shift

    def of(self, grams: np.ndarray) -> np.ndarray:
        place = self.at[self._slot(grams)]
        lost = np.flatnonzero(self.grams[place] != grams)
        place[lost] = np.searchsorted(self.grams, grams[lost])
        return self.prices[place]


def words_of(text: bytes) -> list[bytes]:
    """Words between ASCII blanks, A to Z in lower case."""
    return text.lower().split()


def _dealt_words(counts: dict[bytes, int], bits: int) -> list[pa.Array]:
    """Buckets that occur, their words in a line each, and the counts beside them."""
    words = sorted(counts)
    bucket = np.array([zlib.crc32(w) for w in words], np.int64) >> (32 - bits)
    order = np.argsort(bucket, kind="stable")
    there, first = np.unique(bucket[order], return_index=True)
    numbers = np.array([counts[w] for w in words], np.int64)[order]
    ends = [*first[1:], len(words)]
    lines = [b"\n".join([words[i] for i in order[a:b]]) for a, b in zip(first, ends)]
    return [pa.array(there, pa.int32()), pa.array(lines, pa.binary()), pa.array([_planes(numbers[a:b]) for a, b in zip(first, ends)], pa.binary())]


def _word_counts(docs: DataFrame, bits: int) -> DataFrame:
    """``block, bucket, words, counts``: the distinct words of a block with their number in texts to learn from, which may be 0."""

    def rows(block: int, counts: Counter) -> pa.RecordBatch:
        columns = _dealt_words(counts, bits)
        return pa.RecordBatch.from_arrays([pa.array([block] * len(columns[0]), pa.int64()), *columns], names=["block", "bucket", "words", "counts"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, counts = None, Counter()
        for block, batch in _by_block(batches):
            if block != current:
                if counts:
                    yield rows(current, counts)
                current, counts = block, Counter()
            for text, use in zip(_bytes(batch), batch.column(2).to_pylist()):
                if use:
                    counts.update(words_of(text))
                else:
                    counts.update(dict.fromkeys(words_of(text), 0))
        if counts:
            yield rows(current, counts)

    return docs.mapInArrow(count, "block long, bucket int, words binary, counts binary")


def _word_totals(counted: DataFrame, bits: int) -> DataFrame:
    """``bucket, words, counts`` of the whole corpus, and ``tokens, learnt``: all counts, and the words with one."""

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            columns = _dealt_words(totals, bits)
            sums = [pa.array([x], pa.int64()) for x in (sum(totals.values()), sum(n > 0 for n in totals.values()))]
            return pa.RecordBatch.from_arrays([*columns, *sums], names=["bucket", "words", "counts", "tokens", "learnt"])

        last, totals = None, Counter()
        for batch in batches:
            for bucket, words, counts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "words", "counts"))):
                if bucket != last and last is not None:
                    yield rows()
                    totals = Counter()
                last = bucket
                totals.update(dict(zip(words.split(b"\n"), _whole(counts).tolist())))
        if last is not None:
            yield rows()

    dealt = counted.select("bucket", "words", "counts").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(add, "bucket int, words binary, counts binary, tokens long, learnt long")


def _word_answers(counted: DataFrame, totals: DataFrame) -> DataFrame:
    """``block, words, totals``: to each block the counts of its words in the whole corpus."""
    met = totals.select("bucket", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("block"), "words", "counts").unionAll(
        counted.select("bucket", F.lit(1), "block", "words", F.lit(None).cast("binary"))
    )

    def answer(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            out = []
            for kind, block, words, counts in zip(*(batch.column(c).to_pylist() for c in ("kind", "block", "words", "counts"))):
                if kind == 0:
                    known = dict(zip(words.split(b"\n"), _whole(counts).tolist()))
                else:
                    out.append((block, words, _planes(np.array([known[w] for w in words.split(b"\n")], np.int64))))
            columns = list(zip(*out)) or [()] * 3
            kinds = [pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["block", "words", "totals"])

    dealt = met.repartition("bucket").sortWithinPartitions("bucket", "kind")
    return dealt.mapInArrow(answer, "block long, words binary, totals binary")


def score(
    docs: DataFrame, learns: Column, key: str = "doc_id", text: str = "text", depth: int = DEPTH,
    block_bytes: int = BLOCK_BYTES, piece_bytes: int = PIECE_BYTES, batch_grams: int = BATCH_GRAMS,
    bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """``key, n_tokens, n_known, train_tokens, base_score, score`` of every row, learnt from the rows where ``learns`` holds (null: not).

    ``score`` is the log10 probability of the text's UTF-8 bytes and its end under the context trees of ``depth`` bytes (3 to 6), ``base_score`` that of its
    tokens under a unigram model with half a count added: words (between ASCII blanks, A-Z in lower case) and one end, an unseen token counting as one more. ``n_tokens`` counts them with the end, ``n_known`` those
    that the rows to learn from hold, ``train_tokens`` all tokens of these rows. A null text counts as empty: it has its end only. Null and repeated keys are rows of their own.
    Without rows to learn from every bit has probability 1/2 and every token 1. The last four parameters bound what a task holds and do not change results. Only ``key``, ``text`` and what ``learns`` reads are read.
    """
    if not 3 <= depth <= DEEPEST:
        raise ValueError(f"depth must be between 3 and {DEEPEST}")
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(_documents(docs, key, text, learns, block_bytes), "documents", compression="zstd")
    ends, blocks, size = rows.agg(
        F.count(F.when(F.col("learns"), 1)), F.count_distinct("block"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))
    ).first()
    bits = min(MOST_BITS, max(LEAST_BITS, (size // bucket_bytes).bit_length()))
    counted = scratch.keep(_gram_counts(rows, depth, piece_bytes, bits), "grams")
    model = scratch.keep(_model(counted, batch_grams, bits), "model")
    top = _downwards(_levels(_leaf_sums(model, batch_grams), depth, scratch), scratch)
    answers = _answers(counted, model, top, batch_grams, bits)

    words = scratch.keep(_word_counts(rows, bits), "words")
    totals = scratch.keep(_word_totals(words, bits), "word-totals")
    tokens, distinct = totals.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("tokens", "learnt")]).first()
    tokens, distinct = tokens + ends, distinct + (ends > 0)
    known = _word_answers(words, totals)

    nothing = F.lit(None)
    columns = {"grams": "binary", "prices": "binary", "words": "binary", "totals": "binary", "key": rows.schema["key"].dataType, "text": "string"}

    def kind(df: DataFrame, number: int, *own: str) -> DataFrame:
        return df.select("block", F.lit(number).alias("kind"), *[c if c in own else nothing.cast(t).alias(c) for c, t in columns.items()])

    met = kind(answers, 0, "grams", "prices").unionAll(kind(known, 1, "words", "totals")).unionAll(kind(rows, 2, "key", "text"))
    dealt = met.repartition(max(1, blocks), "block").sortWithinPartitions("block", "kind")
    schema = T.StructType(
        [
            T.StructField(key, rows.schema["key"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
            T.StructField("train_tokens", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
        ]
    )
    arrow = to_arrow_schema(schema)

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = tokens + 0.5 * (distinct + 1)
        unseen = math.log10(0.5 / whole)
        end = math.log10((ends + 0.5) / whole)
        current, grams, prices, shares, table = None, [], [], {}, None
        for block, batch in _by_block(batches):
            if block != current:
                current, grams, prices, shares, table = block, [], [], {}, None
            kinds = batch.column("kind").to_numpy()
            a, b = np.searchsorted(kinds, [1, 2])
            grams += [_walk(x) for x in batch.column("grams").slice(0, a).to_pylist()]
            prices += [_whole(x, np.float64) for x in batch.column("prices").slice(0, a).to_pylist()]
            part = batch.slice(a, b - a)
            for words, totals in zip(part.column("words").to_pylist(), part.column("totals").to_pylist()):
                learnt = _whole(totals)
                logs = np.log10((learnt + 0.5) / whole).tolist()
                shares.update((w, x) for w, n, x in zip(words.split(b"\n"), learnt.tolist(), logs) if n)
            rest = batch.slice(b)
            if not rest.num_rows:
                continue
            if table is None:
                table, grams, prices = Prices(np.concatenate(grams), np.concatenate(prices)), [], []
            texts = _bytes(rest)
            sums = np.zeros(len(texts))
            for pieces in _pieces(texts, depth, piece_bytes):
                found = table.of(_grams(pieces, depth))
                starts = np.cumsum([0, *(n for _, _, n in pieces[:-1])])
                np.add.at(sums, [row for row, _, _ in pieces], np.add.reduceat(found, starts))
            cut = [words_of(t) for t in texts]
            seen = [[shares[w] for w in row if w in shares] for row in cut]
            sizes, hits = [len(row) + 1 for row in cut], [len(row) + (ends > 0) for row in seen]
            base = [math.fsum(row) + end + unseen * (size - 1 - len(row)) for row, size in zip(seen, sizes)]
            yield pa.RecordBatch.from_arrays(
                [
                    rest.column("key"), pa.array(sizes, pa.int64()), pa.array(hits, pa.int64()), pa.array([tokens] * len(texts), pa.int64()),
                    pa.array(base, pa.float64()), pa.array(sums / math.log(10.0), pa.float64()),
                ],
                names=arrow.names,
            )

    return dealt.mapInArrow(finish, schema)
