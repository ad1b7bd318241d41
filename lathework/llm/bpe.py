"""BPE encoding and decoding by a depth-first walk over the trie of a batch's distinct words.

The encoding of a word's prefix is the encoding of a shorter prefix plus one last token, and exactly
one suffix of the prefix can be that token: the one that the merges leave apart from what precedes it.
So a trie node needs its last token only, and all words below it share it. Sorted words are the trie in
depth-first order: the walk keeps the states of one path from the root and steps back to the prefix that
the next word shares, so the trie's nodes are never held together.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

NEVER = 1 << 60
WORD_END = "</w>"
#: Entries that a worker's caches of chunks and words may hold before they start anew.
CACHE_ENTRIES = 400_000
#: White space of Python that the tokenizer's patterns do not count as such.
_SEPARATORS = re.compile("[\x1c-\x1f]")
_BLANKS = re.compile("[^\\S\x1c-\x1f]+")
#: Latin letters whose lower case is one letter of the split patterns below. The lower case of some lies beyond U+024F,
#: where those patterns would cut a word.
_LETTERS = "".join(
    c for c in map(chr, range(0xC0, 0x250)) if c not in "\u00d7\u00f7" and len(c.lower()) == 1 and c.lower() <= "\u024f"
)
#: Chunks of ASCII and such letters need no Unicode normalisation but lower case.
_LATIN = re.compile(f"[!-~{_LETTERS}]+\\Z")
#: The tokenizer's split pattern for such chunks (fixed values).
_LATIN_WORDS = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u024f]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u024f]+"
)
#: Whole texts of such chunks and ASCII blanks, and their words.
_LATIN_TEXT = re.compile(f"[\t-\r -~{_LETTERS}]*\\Z")
_LATIN_TEXT_WORDS = re.compile(
    "'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u024f]+|[0-9]|[^\t-\r a-z0-9\u00df-\u00f6\u00f8-\u024f]+"
)
#: The byte alphabet of byte-level tokenizers: visible Latin-1 characters stand for themselves, the
#: other bytes for the characters from 256 on.
_VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _VISIBLE)}


def chunks_of(text: str) -> list[str]:
    """The parts of a text between blanks; no token of the word tokenizer spans a blank."""
    if _SEPARATORS.search(text):
        return [c for c in _BLANKS.split(text) if c]
    return text.split()


class _Suffixes:
    """Automaton over the vocabulary: for the text read so far, all tokens that are a suffix of it.

    A node is ``(moves by character, inner tokens, tokens at a word's end, longest suffix of the text that
    begins a token)``; both lists hold ``(token, length)``, longest first. Nodes are made when first met, and there are no
    more than beginnings of tokens.
    """

    def __init__(self, inner: dict[str, int], final: dict[str, int]):
        self._inner, self._final = inner, final
        self._beginnings = {t[:n] for t in (*inner, *final) for n in range(len(t) + 1)}
        self._nodes: dict[str, tuple] = {}
        self.root = self._node("")

    def _node(self, text: str) -> tuple:
        if text not in self._nodes:
            ends = [text[i:] for i in range(len(text))]
            found = [[(m[t], len(t)) for t in ends if t in m] for m in (self._inner, self._final)]
            self._nodes[text] = {}, *found, text
        return self._nodes[text]

    def step(self, node: tuple, letter: str) -> tuple:
        text = node[3] + letter
        while text not in self._beginnings:
            text = text[1:]
        after = node[0][letter] = self._node(text)
        return after


class WordBpe:
    """Encoder and decoder for a ``tokenizers`` file with a BPE model that marks word ends."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != WORD_END:
            raise ValueError(f"{path} is not a BPE vocabulary with word ends")
        self.library = Tokenizer.from_file(path)
        vocab: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in vocab.items()}
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in specials.items()})
        self.specials = specials
        self._special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self._rank: dict[tuple[int, int], int] = {}
        self._parts: dict[int, tuple[int, int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, whole = vocab[left], vocab[right], vocab[left + right]
            self._rank[a, b] = rank
            self._parts.setdefault(whole, (a, b, rank))
        self._right_edges: dict[int, list[tuple[int, int]]] = {}
        self._left_edges: dict[int, list[tuple[int, int]]] = {}
        self._apart: dict[int, bool] = {}
        # a token that the merges never form cannot end an encoding
        reachable: set[int] = set()
        for token in vocab.values():
            parts = self._parts.get(token)
            if parts is None:
                if len(self.tokens[token].removesuffix(WORD_END)) == 1:
                    reachable.add(token)
            elif parts[0] in reachable and parts[1] in reachable and self._meet(*parts[:2]) == parts[:2]:
                reachable.add(token)
        inner = {t: i for t, i in vocab.items() if i in reachable and not t.endswith(WORD_END)}
        final = {t[: -len(WORD_END)]: i for t, i in vocab.items() if i in reachable and t.endswith(WORD_END)}
        self._suffixes = _Suffixes(inner, final)
        self._words: dict[str, tuple[int, ...]] = {}

    def _edges(self, token: int, side: int) -> list[tuple[int, int]]:
        """What stands at one edge of a token while it is merged, each with the rank that ends it."""
        known = (self._left_edges, self._right_edges)[side]
        if token not in known:
            parts = self._parts.get(token)
            below = [] if parts is None else [*self._edges(parts[side], side)[:-1], (parts[side], parts[2])]
            known[token] = [*below, (token, NEVER)]
        return known[token]

    def _meet(self, left: int, right: int) -> tuple[int, int] | None:
        """The first merge across the border of two neighbours, or None if they stay apart.

        Merges run by rank and, within a rank, from the left.
        """
        ours, theirs = self._edges(left, 1), self._edges(right, 0)
        i = j = 0
        while True:
            (a, a_end), (b, b_end) = ours[i], theirs[j]
            rank = self._rank.get((a, b), NEVER)
            if rank < a_end and rank <= b_end and rank != NEVER:
                return a, b
            if a_end == b_end == NEVER:
                return None
            if a_end <= b_end:
                i += 1
            else:
                j += 1

    def _part(self, pair: int) -> bool:
        """Whether two neighbours stay apart; answers are kept."""
        if len(self._apart) > CACHE_ENTRIES:
            self._apart.clear()
        alone = self._apart[pair] = self._meet(pair >> 20, pair & 0xFFFFF) is None
        return alone

    def encode_sorted(self, words: Iterable[str]) -> Iterator[tuple[int, ...]]:
        """Token ids of each word; words are in the tokenizer's byte alphabet, sorted.

        ``path`` holds, for each inner prefix from the root, the suffix automaton's node, the last token
        and the length of the prefix before that token.
        """
        apart, step, part = self._apart, self._suffixes.step, self._part
        root = self._suffixes.root
        nodes, tokens, befores = [root], [0], [0]
        previous = ""
        for word in words:
            size = len(word)
            shared, most = 0, min(len(nodes), size) - 1
            while shared < most and previous[shared] == word[shared]:
                shared += 1
            del nodes[shared + 1 :], tokens[shared + 1 :], befores[shared + 1 :]
            node = nodes[shared]
            for end in range(shared + 1, size + 1):
                letter = word[end - 1]
                node = node[0].get(letter) or step(node, letter)
                for token, length in node[1] if end < size else node[2]:
                    if length == end:
                        break
                    pair = tokens[end - length] << 20 | token
                    alone = apart.get(pair)
                    if alone or alone is None and part(pair):
                        break
                else:
                    raise ValueError("no last token: the vocabulary lacks a symbol")
                if end < size:
                    nodes.append(node)
                    tokens.append(token)
                    befores.append(end - length)
            out, at = [token], size - length
            while at:
                out.append(tokens[at])
                at = befores[at]
            out.reverse()
            previous = word
            yield tuple(out)

    def _split(self, chunk: str) -> list[str | int]:
        """Words of a chunk in the byte alphabet; special tokens as ids."""
        if _LATIN.match(chunk) and "<|" not in chunk:
            words = _LATIN_WORDS.findall(chunk.lower())
            return words if chunk.isascii() else [w.encode().decode("latin-1").translate(_BYTES) for w in words]
        out: list[str | int] = []
        start = 0
        spots = [(m.start(), m.end()) for m in self._special.finditer(chunk)] if self._special else []
        for a, b in [*spots, (len(chunk), len(chunk))]:
            if a > start:
                plain = self.library.normalizer.normalize_str(chunk[start:a])
                out += [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(plain)]
            if b > a:
                out.append(self.specials[chunk[a:b]])
            start = b
        return out

    def encode_chunks(self, chunks: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Token ids of distinct chunks: all their new words go through the trie together."""
        parts = {c: self._split(c) for c in chunks}
        if len(self._words) > CACHE_ENTRIES:
            self._words = {}
        new = sorted({w for words in parts.values() for w in words if type(w) is str and w not in self._words})
        self._words.update(zip(new, self.encode_sorted(new)))
        known = self._words
        out = {}
        for chunk, words in parts.items():
            if len(words) == 1 and type(words[0]) is str:
                out[chunk] = known[words[0]]
            else:
                out[chunk] = tuple(i for w in words for i in (known[w] if type(w) is str else (w,)))
        return out

    def encode_words(self, words: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Token ids of distinct lower-case Latin words."""
        spelled = sorted((w if w.isascii() else w.encode().decode("latin-1").translate(_BYTES), w) for w in words)
        return {w: ids for (_, w), ids in zip(spelled, self.encode_sorted(s for s, _ in spelled))}

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        """Token ids of each text."""
        rows = [chunks_of(t) for t in texts]
        known = self.encode_chunks({c for row in rows for c in row})
        return [[i for c in row for i in known[c]] for row in rows]

    def decode(self, ids: Sequence[int]) -> str:
        """The text of token ids: without a decoder in the file, tokens with a blank between them."""
        return " ".join([self.tokens[i] for i in ids if i in self.tokens])


class Coded:
    """What ``make`` makes of the ids of each word, or chunk, of texts; kept for all tasks of a worker, up to a bound.

    Texts of Latin letters and ASCII are cut into words at once; others into chunks, which the library's normalizer and
    splitter see when they are new.
    """

    def __init__(self, coder: WordBpe, make: Callable[[tuple[int, ...]], object], entries: int = CACHE_ENTRIES):
        self._coder, self._make, self._entries = coder, make, entries
        self._words: dict[str, object] = {}
        self._chunks: dict[str, object] = {}

    def rows(self, texts: Iterable[str | None]) -> list[list]:
        """The parts of each text in order; a null text has none."""
        cut = []
        for text in texts:
            if text and _LATIN_TEXT.match(text) and "<|" not in text:
                cut.append((self._words, _LATIN_TEXT_WORDS.findall(text.lower())))
            else:
                cut.append((self._chunks, chunks_of(text) if text else []))
        for known, encode in ((self._words, self._coder.encode_words), (self._chunks, self._coder.encode_chunks)):
            if len(known) > self._entries:
                known.clear()
            met = set().union(*(row for kind, row in cut if kind is known))
            new = [part for part in met if part not in known]
            make = self._make
            known.update([(part, make(ids)) for part, ids in encode(new).items()])
        return [list(map(kind.__getitem__, row)) for kind, row in cut]


@functools.lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One encoder per worker and file."""
    return WordBpe(path)



def encode_documents(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, ids array<int>``: the token ids of each whole text (null text: none)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_bpe(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = pa.array(coder.encode(texts), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["key", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    narrow = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text"))
    return narrow.mapInArrow(run, f"key {kind}, ids array<int>").withColumnRenamed("key", key)


@functools.lru_cache(maxsize=2)
def _digest_parts(vocabulary: str) -> Coded:
    """Per part: its ids as text, their number, and their decoded text."""
    coder = word_bpe(vocabulary)
    return Coded(coder, lambda ids: (" ".join(map(str, ids)), len(ids), coder.decode(ids)))


def token_digests(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each whole text, decode it again, and return counts and digests of both.

    ``key``, ``n_tokens`` long, ``ids_sha256`` (of decimal ids with one space between them) and
    ``decoded_sha256`` (of the decoded text). Null and empty texts have no tokens; rows that repeat
    come back as often; other columns are not read. A word's ids and its decoded tokens are joined
    once and reused for all its places. Work per row is a lookup per word; memory is one Arrow batch and
    caches of a fixed size.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded = _digest_parts(vocabulary)
        for batch in batches:
            counts, ids_sums, text_sums = [], [], []
            for found in coded.rows(batch.column(1).to_pylist()):
                counts.append(sum([f[1] for f in found]))
                ids_sums.append(hashlib.sha256(" ".join([f[0] for f in found]).encode()).hexdigest())
                text_sums.append(hashlib.sha256(" ".join([f[2] for f in found]).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_sums, pa.string()), pa.array(text_sums, pa.string())],
                names=["key", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[key].dataType.simpleString()
    narrow = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text"))
    schema = f"key {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return narrow.mapInArrow(run, schema).withColumnRenamed("key", key)
