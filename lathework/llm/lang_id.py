"""Language identification: multinomial naive Bayes over hashed character n-grams."""

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: N-grams of one to this many characters.
LONGEST_GRAM = 3
#: Hash buckets of all n-grams together; a power of two.
BUCKETS = 1 << 14
#: A model of more languages than this is refused, so what is broadcast has a fixed bound (16 MB per 128 languages).
MAX_LANGUAGES = 512
UNDETERMINED = "und"
#: Texts that are Python objects at a time.
_TEXTS = 64
#: N-grams times languages that are scored together.
_PRODUCT_CELLS = 1_000_000
#: Texts of fewer n-grams, some ten words, are too short to be told from noise and are never taken for it.
LEAST_GRAMS = 200
_CODE_POINTS = 0x110000


@functools.cache
def _alphabet() -> np.ndarray:
    """Lower-cased code point of each letter, a blank for every other character."""
    fold = np.full(_CODE_POINTS, 32, np.uint64)
    for point in range(_CODE_POINTS):
        letter = chr(point)
        if letter.isalpha():
            fold[point] = ord(letter.lower()[0])
    return fold


def _letters(text: str) -> np.ndarray:
    """Lower-cased code points of a text, each run of others as one blank, and a blank on either side; empty without letters."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    letters = _alphabet()[points]
    spoken = letters != 32
    if not spoken.any():
        return np.zeros(0, np.uint64)
    spoken[1:] |= spoken[:-1].copy()
    return np.concatenate([[np.uint64(32)], letters[spoken], [np.uint64(32)]]).astype(np.uint64)


def _hashed(padded: np.ndarray, buckets: int = BUCKETS, longest: int = LONGEST_GRAM) -> np.ndarray:
    if not len(padded):
        return np.zeros(0, np.int64)
    shift = np.uint64(64 - (buckets.bit_length() - 1))
    found = []
    for n in range(1, min(longest, len(padded)) + 1):
        mixed = np.full(len(padded) - n + 1, n, np.uint64)
        for k in range(n):
            mixed = (mixed ^ padded[k : len(padded) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        found.append((mixed >> shift).astype(np.int64))
    return np.concatenate(found)


def gram_buckets(text: str, buckets: int = BUCKETS, longest: int = LONGEST_GRAM) -> np.ndarray:
    """Bucket of each n-gram of a text, in no order; empty for a text without letters.

    Runs of characters that are no letters count as one blank, also before the first word and after the last.
    """
    return _hashed(_letters(text), buckets, longest)


def gram_counts(text: str, buckets: int = BUCKETS, longest: int = LONGEST_GRAM) -> np.ndarray:
    """How often each bucket's n-grams occur in a text; empty for a text without letters."""
    found = gram_buckets(text, buckets, longest)
    return np.bincount(found, minlength=buckets) if len(found) else found


class NaiveBayes:
    """Log probabilities of each bucket in each language, and of the languages."""

    def __init__(self, languages: list[str], counts: np.ndarray, texts: np.ndarray, smoothing: float = 1.0):
        self.languages = languages
        smooth = counts + smoothing
        self.gram_log = np.log(smooth / smooth.sum(axis=1, keepdims=True)) if languages else np.zeros((0, BUCKETS))
        self.prior_log = np.log(texts / texts.sum()) if languages else np.zeros(0)

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language of one text, ties to the smaller name, and its posterior probability."""
        return self.predict_all([text])[0]

    def predict_all(self, texts: Iterable[str | None]) -> list[tuple[str, float]]:
        """The same for many texts: their counts are a sparse matrix (texts x buckets), multiplied by the log probabilities a stretch at a time."""
        return [(self.languages[k] if n else UNDETERMINED, share) for k, share, _, n in self._score_all(texts)]

    def identified(self, texts: Iterable[str | None], bounds: np.ndarray, min_score: float) -> list[bool]:
        """Whether each text has letters, a likely enough language, and is not noise by that language's bound on an n-gram's log probability."""
        return [
            n > 0 and share >= min_score and (n < LEAST_GRAMS or total >= n * bounds[k])
            for k, share, total, n in self._score_all(texts)
        ]

    def _score_all(self, texts: Iterable[str | None]) -> list[tuple[int, float, float, int]]:
        """Language, posterior, log probability of the n-grams and their number; all 0 for a text that says nothing."""
        out: list[tuple[int, float, float, int]] = []
        held: list[np.ndarray] = []
        size = 0
        for text in texts:
            held.append(gram_buckets(text) if text and self.languages else np.zeros(0, np.int64))
            size += len(held[-1])
            if size * max(1, len(self.languages)) >= _PRODUCT_CELLS:
                out += self._scored(held)
                held, size = [], 0
        return out + self._scored(held)

    def _scored(self, grams: list[np.ndarray]) -> list[tuple[int, float, float, int]]:
        sizes = np.array([len(g) for g in grams], np.int64)
        spoken = np.flatnonzero(sizes)
        out = [(0, 0.0, 0.0, 0)] * len(grams)
        if not len(spoken):
            return out
        row = np.repeat(np.arange(len(spoken)), sizes[spoken])
        cell, count = np.unique(row * BUCKETS + np.concatenate([grams[k] for k in spoken]), return_counts=True)
        row, bucket = cell // BUCKETS, cell % BUCKETS
        first = np.searchsorted(row, np.arange(len(spoken)))
        scores = np.empty((len(spoken), len(self.languages)))
        for k, logs in enumerate(self.gram_log):
            scores[:, k] = np.add.reduceat(logs[bucket] * count, first) + self.prior_log[k]
        best = np.argmax(scores, axis=1)
        top = scores[np.arange(len(spoken)), best]
        share = 1.0 / np.exp(scores - top[:, None]).sum(axis=1)
        fit = top - self.prior_log[best]
        for place, *said in zip(spoken.tolist(), best.tolist(), share.tolist(), fit.tolist(), sizes[spoken].tolist()):
            out[place] = tuple(said)
        return out


def _stretches(batch: pa.RecordBatch | pa.Array) -> Iterator[pa.RecordBatch | pa.Array]:
    """A batch a few texts at a time, so that only these become Python objects."""
    return (batch.slice(start, _TEXTS) for start in range(0, len(batch), _TEXTS))


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language of this partition: counts by bucket; bucket -1 counts texts."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in _stretches(batch):
            for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                counts = gram_counts(text)
                total = sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                total[BUCKETS] += 1
                if len(counts):
                    total[:BUCKETS] += counts
    for lang, total in sums.items():
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(there), pa.string()), pa.array(there, pa.int64()), pa.array(total[there], pa.int64())],
            names=["lang", "bucket", "n"],
        )


def train(docs: DataFrame, text: str = "text", lang: str = "lang", max_languages: int = MAX_LANGUAGES) -> NaiveBayes:
    """Fit on every row with a text and a language.

    Counts are summed in each task, then by language and bucket; the driver gets ``languages x BUCKETS``
    sums, however many rows there are. More than ``max_languages`` languages are refused.
    """
    rows = docs.select(docs[f"`{text}`"].alias("text"), docs[f"`{lang}`"].cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null")
    sums = rows.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    by_language = sums.groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("sums"))
    found = by_language.orderBy("lang").limit(max_languages + 1).collect()
    if len(found) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    counts = np.zeros((len(found), BUCKETS + 1))
    for k, row in enumerate(found):
        for bucket, n in row["sums"]:
            counts[k, bucket] = n
    return NaiveBayes([r["lang"] for r in found], counts[:, :BUCKETS], counts[:, BUCKETS])


def predict(docs: DataFrame, model: NaiveBayes, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score`` (posterior probability, 0 to 1) to every row.

    A null text, an empty one and one without letters give ``und`` and 0, as does a model of no language.
    Nothing but the text decides. Rows keep their number; columns of these two names are replaced.
    The log-probability matrix is broadcast; its size is bounded by ``MAX_LANGUAGES``.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("lang_pred string, score double")
    def tell(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        for batch in texts:
            said = known.predict_all(t for part in _stretches(batch) for t in part.to_pylist())
            columns = pa.array([k for k, _ in said], pa.string()), pa.array([share for _, share in said], pa.float64())
            yield pa.StructArray.from_arrays(columns, names=["lang_pred", "score"])

    said = tell.asNondeterministic()(docs[f"`{text}`"])  # so that a filter on it does not run it twice
    others = [c for c in docs.columns if c not in ("lang_pred", "score")]
    out = docs.select(F.struct("*").alias("row"), said.alias("said"))
    return out.select(*[F.col("row").getField(c).alias(c) for c in others], "said.lang_pred", "said.score")


def noise_bounds(docs: DataFrame, model: NaiveBayes, text: str = "text", lang: str = "lang") -> np.ndarray:
    """For each language the log probability of an n-gram half way between its texts and the same texts with their letters shuffled.

    Taken from every row with a text and a language; the driver gets one row per language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def gather(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        place = {lang: k for k, lang in enumerate(known.languages)}
        sums = np.zeros((len(place), 3))
        for batch in batches:
            for part in _stretches(batch):
                for said, spoken in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    letters = _letters(said)
                    mixed, own = letters.copy(), np.flatnonzero(letters != 32)
                    mixed[own] = letters[np.random.default_rng(len(own)).permutation(own)]
                    logs = known.gram_log[place[spoken]]
                    sums[place[spoken]] += len(_hashed(letters)), logs[_hashed(letters)].sum(), logs[_hashed(mixed)].sum()
        yield pa.RecordBatch.from_arrays([pa.array(known.languages, pa.string()), *map(pa.array, sums.T)], names=["lang", "n", "own", "noise"])

    rows = docs.select(docs[f"`{text}`"].alias("text"), docs[f"`{lang}`"].cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null").mapInArrow(gather, "lang string, n double, own double, noise double")
    sums = {r["lang"]: r for r in rows.groupBy("lang").agg(*[F.sum(c).alias(c) for c in ("n", "own", "noise")]).collect()}
    # a language without any letters rules nothing out
    return np.array([(sums[k]["own"] + sums[k]["noise"]) / 2 / sums[k]["n"] if k in sums and sums[k]["n"] else -np.inf for k in model.languages])


def fold_of(key: str = "doc_id", folds: int = 5):
    """Remainder of the checksum of a key's text."""
    return F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % folds


def held_out_predictions(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Learn from four of five folds of the labelled documents, predict all of them.

    ``key, held_out, lang_pred, score``. A null key is in no fold: not learned from, not held out.
    """
    model = train(docs.where(fold_of(key) != 0), text, lang)
    held = F.coalesce(fold_of(key) == 0, F.lit(False)).alias("held_out")
    told = predict(docs.select(F.struct(docs[f"`{key}`"].alias("key"), held).alias("row"), docs[f"`{text}`"].alias("text")), model)
    return told.select(F.col("row.key").alias(key), "row.held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, text: str = "text", lang: str = "lang", min_score: float = 0.3) -> DataFrame:
    """The documents whose language can be told, with their own columns.

    Rejected are texts without letters (null and empty ones among them), those for which no language reaches ``min_score``, and noise: texts whose
    n-grams are less likely in their likeliest language than its ``noise_bounds``; with fewer than ``LEAST_GRAMS`` n-grams none goes for that. Texts in a language that was not learned go if its letters follow each other unlike those of all learned ones.
    Without any labelled document nothing can be learned, and only texts without letters go.
    """
    model = train(docs, text, lang)
    told = docs.select(F.struct("*").alias("row"), docs[f"`{text}`"].alias("text"))
    stays = F.col("text").rlike(r"\p{L}")
    if model.languages:
        bounds = noise_bounds(docs, model, text, lang)
        shared = docs.sparkSession.sparkContext.broadcast(model)

        @F.arrow_udf("boolean")
        def identified(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in texts:
                said = (t for part in _stretches(batch) for t in part.to_pylist())
                yield pa.array(shared.value.identified(said, bounds, min_score), pa.bool_())

        stays = identified("text")
    return told.where(stays).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
