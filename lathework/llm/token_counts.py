"""Token counts of a unigram vocabulary: Aho-Corasick matches and a count-only Viterbi pass.

The best segmentation's score and number of pieces are all that travels along a word, so no
segmentation is ever built.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from lathework.llm.bpe import CACHE_ENTRIES

#: The mark that stands for the blank before a word, and what an unknown character costs beyond the worst piece (fixed values).
WORD_MARK = "▁"
UNKNOWN_PENALTY = 10.0
_MARKED = re.compile(f"{WORD_MARK}[^{WORD_MARK}]*")


class UnigramCounter:
    """Number of pieces, and score, of the best segmentation of words over scored pieces.

    Ties follow the tokenizer: among equal scores the piece that starts first, that is the longest last
    piece, wins. A character that is no piece itself costs the unknown penalty and counts as its UTF-8
    bytes where the vocabulary has all byte pieces; otherwise a run of such characters counts once.
    """

    def __init__(self, pieces: list[tuple[str, float]]):
        self.matches = ahocorasick.Automaton()
        for text, score in pieces:
            if text:
                self.matches.add_word(text, (len(text), score))
        self.matches.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        names = {text for text, _ in pieces}
        self.has_bytes = all(f"<0x{b:02X}>" in names for b in range(256))

    def word(self, text: str) -> tuple[int, float]:
        """Piece count and score of one word, mark included."""
        size = len(text)
        scores, counts = [0.0] * (size + 1), [0] * (size + 1)
        unknown_end = [False] * (size + 1)  # whether the best way there ends in an unknown character
        found: list[list[tuple[int, float]]] = [[] for _ in range(size + 1)]
        for last, match in self.matches.iter(text):
            found[last + 1].append(match)  # longest first
        for end in range(1, size + 1):
            best = None
            alone = False
            for length, score in found[end]:
                alone |= length == 1
                total = score + scores[end - length]
                if best is None or total > best:
                    best, counts[end] = total, counts[end - length] + 1
            if not alone:
                total = self.unknown + scores[end - 1]
                if best is None or total > best:
                    best = total
                    unknown_end[end] = True
                    step = len(text[end - 1].encode("utf-8", "replace")) if self.has_bytes else 0 if unknown_end[end - 1] else 1
                    counts[end] = counts[end - 1] + step
            scores[end] = best
        return counts[size], scores[size]

    def chunk(self, chunk: str) -> tuple[int, float]:
        """Piece count and score of text without blanks; a mark in it begins a new word, as after a blank."""
        marked = chunk if chunk[0] == WORD_MARK else WORD_MARK + chunk
        words = [self.word(w) for w in _MARKED.findall(marked)]
        return sum(w[0] for w in words), sum(w[1] for w in words)


@functools.lru_cache(maxsize=2)
def unigram_counter(path: str) -> UnigramCounter:
    """One counter per worker and sentencepiece file, whose pieces and scores it takes as they are."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return UnigramCounter([(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())])


def count_tokens(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, n_words, n_tokens`` (longs) and ``score`` (double) of each whole text.

    Texts are split at white space, each word is segmented on its own. Null and empty texts count 0; repeated
    rows come back as often; other columns are not read. Counts of distinct words are kept in a cache
    of a fixed size; memory is one Arrow batch besides.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = unigram_counter(vocabulary)
        known: dict[str, tuple[int, float]] = {}
        for batch in batches:
            rows = [t.split() if t else [] for t in batch.column(1).to_pylist()]
            if len(known) > CACHE_ENTRIES:
                known = {}
            for chunk in {c for row in rows for c in row if c not in known}:
                known[chunk] = counter.chunk(chunk)
            found = [[known[c] for c in row] for row in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([sum([x[0] for x in f]) for f in found], pa.int64()),
                    pa.array([float(sum([x[1] for x in f])) for f in found], pa.float64()),
                ],
                names=["key", "n_words", "n_tokens", "score"],
            )

    kind = docs.schema[key].dataType.simpleString()
    narrow = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text"))
    return narrow.mapInArrow(run, f"key {kind}, n_words long, n_tokens long, score double").withColumnRenamed("key", key)
