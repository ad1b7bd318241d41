"""Secret scans: fixed patterns, and a linear-chain conditional random field that adds what they miss.

Tokens are tagged secret begin (B), inside (I) or outside (O) from their own shape, the kinds of their neighbours and
the file they stand in. The field is trained on a bounded sample of the pattern matches in all documents; its features do not name a
value, so it carries over to values that no pattern covers. Decoding is Viterbi's. A token whose own score for O exceeds all that any
neighbours, file and transitions could say against it is O on every best path, so the chains that need decoding are the short
ones between such tokens; nothing is lost by that.
"""



import dataclasses
import hashlib
import re
import warnings
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathework.llm.common import Scratch

#: The patterns, with the group whose length counts and its least length (fixed values).
PATTERNS = {
    "assign": (
        re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A),
        2,
        12,
    ),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]{16,}"), 0, 16),  # a run of 16 or more, hence the same as any run that long
}
FIELD = "crf"
#: Distinct texts from which training windows without a match are taken, at most about so many whatever the table's size.
SAMPLE_DOCUMENTS = 10_000
#: Tokens of a training window.
WINDOW = 32
#: Tokens that a token sees on either side, at most.
REACH = 2
OUTSIDE, BEGIN, INSIDE = 0, 1, 2
_TOKEN = re.compile(r"[\w+/-]+|[^\w\s]")
_KEYWORD = re.compile(r"pass(word|wd|phrase)?$|pwd$|secret|token|api_?key|credential|private_?key|access_?key|auth|bearer", re.I)
#: Parts of which every keyword has one.
_KEYWORD_PARTS = ("pass", "pwd", "secret", "token", "api", "credential", "key", "auth", "bearer")
_STOPS = ".,;:!?()\"'|"
_HEX = re.compile(r"[0-9a-f]+\Z")
_CHUNK = re.compile(r"\S+")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the whole matches of the patterns, by start, then kind as listed."""
    found = []
    for kind, (pattern, group, least) in PATTERNS.items():
        if kind == "assign" and ":" not in text and "=" not in text:
            continue
        found += [(m.start(), m.end(), kind) for m in pattern.finditer(text) if len(m[group]) >= least]
    return sorted(found, key=lambda s: (s[0], list(PATTERNS).index(s[2])))


def secret_values(text: str) -> list[tuple[int, int]]:
    """Where the values themselves are: the value of an assignment, else the whole match."""
    return [
        m.span(group)
        for pattern, group, least in PATTERNS.values()
        for m in pattern.finditer(text)
        if len(m[group]) >= least
    ]


def kind_of(token: str) -> str:
    """What a neighbour sees of a token."""
    if len(token) == 1 and not token.isalnum():
        return token if token in "=:\"'`<>()[]{},.;|" else "mark"
    if _KEYWORD.search(token):
        return "keyword"
    digits = sum(c.isdigit() for c in token)
    if digits == len(token):
        return "number"
    return "mixed" if digits else "word"


def shape_of(token: str) -> list[str]:
    """What a token's own form says."""
    size = len(token)
    length = next(str(n) for n in (1, 2, 4, 7, 11, 15, 19, 31, 39, 1 << 60) if size <= n)
    kind = kind_of(token)
    out = [f"length {length}", f"kind {kind}", f"{kind} {length}"]
    if kind in ("mixed", "number"):
        digits = sum(c.isdigit() for c in token)
        turns = sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:]))
        out += [f"digits {min(9, 10 * digits // size)}", f"turns {min(turns, 8)}"]
    out.append("hex" if kind == "mixed" and _HEX.match(token) else "no hex")
    cases = (any(c.islower() for c in token), any(c.isupper() for c in token))
    out.append(f"cases {cases} {kind}")
    return out


def file_kind(text: str) -> str:
    """What sort of file a token is in."""
    return f"file {'=' in text} {'{' in text or ';' in text} {_KEYWORD.search(text) is not None}"


@dataclasses.dataclass
class Field:
    """Weights by feature (rows of O, B, I) and of transitions."""

    weights: dict[str, np.ndarray]
    moves: np.ndarray

    def __post_init__(self):
        self._none = np.zeros(3)
        self._tokens: dict[str, tuple[np.ndarray, ...]] = {}
        self._plain: dict[tuple, bool] = {}
        self._margin = self.context_margin()
        self._stops = any(self.of(c)[4] for c in _STOPS)

    def context_margin(self) -> float:
        """The most that neighbours, file and transitions can say for B or I against O."""
        most = 0.0
        for place in ("before ", "before2 ", "after ", "file "):
            said = [w for name, w in self.weights.items() if name.startswith(place)]
            most += max([0.0, *(float(max(w[BEGIN], w[INSIDE]) - w[OUTSIDE]) for w in said)])
        m = self.moves
        most += max(
            m[p, y] + m[y, n] - m[p, OUTSIDE] - m[OUTSIDE, n] for p in range(3) for n in range(3) for y in (BEGIN, INSIDE)
        )
        return float(most)

    def of(self, token: str) -> tuple[np.ndarray, ...]:
        """A token's own scores, and what it says as the one before, the second before, and after; and whether it may be no O."""
        if token not in self._tokens:
            if len(self._tokens) > 200_000:
                self._tokens.clear()
            get, kind = self.weights.get, kind_of(token)
            own = sum((get(f, self._none) for f in shape_of(token)), self._none)
            near = [get(f"{place} {kind}", self._none) for place in ("before", "before2", "after")]
            self._tokens[token] = (own, *near, bool(max(own[BEGIN], own[INSIDE]) + self._margin >= own[OUTSIDE]))
        return self._tokens[token]

    def doubtful(self, chunk: str) -> bool:
        """Whether any token of a chunk may be no O. A plain word's answer hangs on its length and case alone."""
        word = chunk.strip(_STOPS)
        if word.isalpha() and not self._stops:
            plain = word.lower()
            if not any([k in plain for k in _KEYWORD_PARTS]):
                form = min(len(word), 40), word.islower(), word.isupper(), word == plain
                known = self._plain.get(form)
                if known is None:
                    known = self._plain[form] = self.of(word)[4]
                return known
        return any([self.of(t)[4] for t in _TOKEN.findall(chunk)])

    def decode(self, text: str, doubtful: Callable[[str], bool]) -> list[tuple[int, int]]:
        """Spans of the tokens that the best path tags as secret; neighbours within a chunk are one span.

        Only the stretches around doubtful chunks are looked at, with as many chunks about them as a token sees tokens.
        """
        chunks = [m.span() for m in _CHUNK.finditer(text)]
        stretches: list[list[int]] = []
        for k, (a, b) in enumerate(chunks):
            if doubtful(text[a:b]):
                if stretches and k - 2 * REACH <= stretches[-1][1]:
                    stretches[-1][1] = k
                else:
                    stretches.append([k, k])
        file = self.weights.get(file_kind(text), self._none)
        spans = []
        for first, last in stretches:
            a, b = chunks[max(0, first - REACH)][0], chunks[min(len(chunks) - 1, last + REACH)][1]
            spans += [(a + x, a + y) for x, y in self._decode(text[a:b], file)]
        return spans

    def _decode(self, text: str, file: np.ndarray) -> list[tuple[int, int]]:
        tokens = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text)]
        known = [self.of(t) for t, _, _ in tokens]
        spans: list[tuple[int, int]] = []
        i = 0
        while i < len(tokens):
            if not known[i][4]:
                i += 1
                continue
            j = i
            while j < len(tokens) and known[j][4]:
                j += 1
            scores = np.array(
                [
                    known[k][0] + file
                    + (known[k - 1][1] if k else self._none)
                    + (known[k - 2][2] if k > 1 else self._none)
                    + (known[k + 1][3] if k + 1 < len(tokens) else self._none)
                    for k in range(i, j)
                ]
            )
            for k, tag in enumerate(self._best(scores, i > 0, j < len(tokens)), i):
                if tag == OUTSIDE:
                    continue
                if tag == INSIDE and spans and spans[-1][1] == tokens[k][1]:
                    spans[-1] = spans[-1][0], tokens[k][2]
                else:
                    spans.append(tokens[k][1:])
            i = j
        return spans

    def _best(self, scores: np.ndarray, after_outside: bool, before_outside: bool) -> list[int]:
        """Viterbi over one chain between tokens that are O."""
        best = scores[0] + (self.moves[OUTSIDE] if after_outside else 0)
        back = []
        for row in scores[1:]:
            ways = best[:, None] + self.moves
            back.append(ways.argmax(axis=0))
            best = ways.max(axis=0) + row
        if before_outside:
            best = best + self.moves[:, OUTSIDE]
        path = [int(best.argmax())]
        for step in reversed(back):
            path.append(int(step[path[-1]]))
        return path[::-1]


def features(tokens: list[str], file: str) -> list[list[str]]:
    kinds = [kind_of(t) for t in tokens]
    return [
        [
            *shape_of(t), file,
            *([f"before {kinds[i - 1]}"] if i else []),
            *([f"before2 {kinds[i - 2]}"] if i > 1 else []),
            *([f"after {kinds[i + 1]}"] if i + 1 < len(tokens) else []),
        ]
        for i, t in enumerate(tokens)
    ]


def fit(windows: list[tuple[list[str], str, list[int]]], epochs: int = 40, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """Weights of the largest likelihood of tagged windows ``(tokens, file kind, tags)``, less a penalty on their squares.

    Gradients are expectations from the forward and backward sums of all windows at once. Without windows everything is O.
    """
    if not windows:
        return Field({}, np.array([[9.0, 0, 0], [9.0, 0, 0], [9.0, 0, 0]]))
    listed = [features(tokens, file) for tokens, file, _ in windows]
    names = {name: k + 1 for k, name in enumerate(sorted({f for w in listed for t in w for f in t}))}
    count, steps = len(windows), max(map(len, listed))
    wide = max(len(t) for w in listed for t in w)
    ids = np.zeros((count, steps, wide), np.int64)  # row 0 of the weights stays 0
    tags, there = np.zeros((count, steps), np.int64), np.zeros((count, steps), bool)
    for a, window in enumerate(listed):
        for b, token in enumerate(window):
            ids[a, b, : len(token)] = [names[f] for f in token]
        tags[a, : len(window)], there[a, : len(window)] = windows[a][2], True
    weights, moves = np.zeros((len(names) + 1, 3)), np.zeros((3, 3))
    seen_w, seen_m = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    truth = np.eye(3)[tags] * there[..., None]
    both = there[:, 1:]
    pairs = np.einsum("nti,ntj->ij", truth[:, :-1] * both[..., None], truth[:, 1:])
    for _ in range(epochs):
        scores = weights[ids].sum(axis=2)
        alpha, beta = np.zeros_like(scores), np.zeros_like(scores)
        alpha[:, 0] = scores[:, 0]
        for t in range(1, steps):
            new = np.logaddexp.reduce(alpha[:, t - 1, :, None] + moves, axis=1) + scores[:, t]
            alpha[:, t] = np.where(there[:, t, None], new, alpha[:, t - 1])
        total = np.logaddexp.reduce(alpha[:, -1], axis=1)
        for t in range(steps - 2, -1, -1):
            new = np.logaddexp.reduce(moves + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
            beta[:, t] = np.where(there[:, t + 1, None], new, 0)
        expected = np.exp(alpha + beta - total[:, None, None]) * there[..., None]
        flow = np.exp(
            alpha[:, :-1, :, None] + moves + (scores + beta)[:, 1:, None, :] - total[:, None, None, None]
        ) * both[..., None, None]
        off = np.repeat((truth - expected).reshape(-1, 3), wide, axis=0)
        step_w = np.stack([np.bincount(ids.ravel(), off[:, y], len(weights)) for y in range(3)], axis=1)
        step_w[0] = 0
        step_w -= decay * count * weights
        step_m = pairs - flow.sum(axis=(0, 1)) - decay * count * moves
        seen_w += step_w**2
        seen_m += step_m**2
        weights += rate * step_w / np.sqrt(seen_w)
        moves += rate * step_m / np.sqrt(seen_m)
    return Field({name: weights[k] for name, k in names.items()}, moves)


def tagged_windows(text: str, seed: int) -> list[tuple[list[str], str, list[int]]]:
    """Of one document: a window around each pattern match, and one more at a place that the seed gives."""
    tokens = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text)]
    if not tokens:
        return []
    tags = [OUTSIDE] * len(tokens)
    starts = np.array([t[1] for t in tokens])
    places = {seed % len(tokens)}
    for a, b in secret_values(text):
        first = int(np.searchsorted(starts, a, "right")) - 1
        last = int(np.searchsorted(starts, b, "left"))
        for k in range(max(first, 0), last):
            if tags[k] == OUTSIDE and tokens[k][2] > a:
                tags[k] = INSIDE if k > first and tokens[k - 1][2] == tokens[k][1] and tags[k - 1] else BEGIN
        places.add(max(first, 0))
    file = file_kind(text)
    out = []
    for place in sorted(places):
        cut = slice(max(0, place - WINDOW // 2), max(0, place - WINDOW // 2) + WINDOW)
        out.append(([t[0] for t in tokens[cut]], file, tags[cut]))
    return out


class _Least:
    """The ``most`` items with the smallest digests, each digest once."""

    def __init__(self, most: int):
        self.most = most
        self.items: dict[bytes, tuple] = {}

    def add(self, digest: bytes, item: tuple) -> None:
        self.items[digest] = item
        if len(self.items) > 2 * self.most + 1000:
            self.items = dict(self.chosen())

    def chosen(self) -> list[tuple[bytes, tuple]]:
        return sorted(self.items.items(), key=lambda x: x[0])[: self.most]


def train(docs: DataFrame, text: str = "text", sample_documents: int = SAMPLE_DOCUMENTS) -> Field:
    """Fit on distinct windows: those around matches come from all documents, the others from about ``sample_documents`` distinct texts.

    Windows are taken evenly by digest. A task hands on, and the driver gets, short windows only: a twentieth of ``sample_documents`` around matches,
    and as many others. If no document holds a match nothing can be learned: the field adds no span, and a warning says so.
    """
    rows = docs.select(docs[f"`{text}`"].alias("text")).where("text is not null").withColumn("seed", F.xxhash64("text"))
    share = min(1.0, sample_documents / max(1, rows.agg(F.approx_count_distinct("seed")).first()[0]))
    limit, most = int(share * (1 << 20)), sample_documents // 20

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = {True: _Least(most), False: _Least(most)}
        for batch in batches:
            for t, seed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sampled = seed % (1 << 20) < limit
                if not sampled and not base_spans(t):
                    continue
                for tokens, file, tags in tagged_windows(t, seed):
                    hit = any(tags)
                    if (hit or sampled) and sum(map(len, tokens)) < 4096:
                        digest = hashlib.md5("\0".join([file, *tokens, *map(str, tags)]).encode("utf-8", "replace")).digest()
                        kept[hit].add(digest, (tokens, file, tags, hit))
        found = [(digest, *item) for least in kept.values() for digest, item in least.chosen()]
        columns = list(zip(*found)) or [()] * 5
        kinds = [pa.binary(), pa.list_(pa.string()), pa.string(), pa.list_(pa.int32()), pa.bool_()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["digest", "tokens", "file", "tags", "hit"]
        )

    windows = rows.mapInArrow(cut, "digest binary, tokens array<string>, file string, tags array<int>, hit boolean")
    windows = Scratch(docs.sparkSession).keep(windows, "training-windows").dropDuplicates(["digest"])
    chosen = []
    for hit in (True, False):
        chosen += windows.where(F.col("hit") == hit).orderBy("digest").limit(most).collect()
    if not any(row["hit"] for row in chosen):
        warnings.warn("no document holds a match to learn from: only patterns find secrets", stacklevel=2)
        return fit([])
    return fit([(row["tokens"], row["file"], row["tags"]) for row in chosen])


def scan_text(text: str, field: Field, known: dict[str, bool]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Pattern spans, and all spans: those of the field that touch no pattern span are added."""
    base = base_spans(text)
    chunks = set(text.split())
    for chunk in chunks:
        if chunk not in known:
            known[chunk] = field.doubtful(chunk)
    if not any([known[c] for c in chunks]):
        return base, base
    taken = sorted(base)
    added = []
    for a, b in field.decode(text, known.__getitem__):
        if not any(x < b and a < y for x, y, _ in taken):
            added.append((a, b, FIELD))
    return base, sorted(base + added, key=lambda s: (s[0], [*PATTERNS, FIELD].index(s[2])))


def _said(spans: Iterable[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find_secrets(docs: DataFrame, field: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, counts by pattern and of the field, ``base_sha256`` and ``spans`` for every row.

    Spans are ``kind:start:end`` in code points of the whole match, end exclusive. Null and empty texts have none; repeated rows come back as often.
    Only ``key`` and ``text`` are read. The field is broadcast: a few hundred weights.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf, known = shared.value, {}
        for batch in batches:
            rows = []
            for t in batch.column(1).to_pylist():
                if len(known) > 500_000:
                    known.clear()
                base, every = scan_text(t, crf, known) if t else ([], [])
                kinds = [s[2] for s in every]
                rows.append(
                    (*(kinds.count(k) for k in (*PATTERNS, FIELD)), hashlib.sha256(_said(base).encode()).hexdigest(), _said(every))
                )
            columns = list(zip(*rows)) or [()] * 6
            types = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, types))],
                names=["key", "n_assign", "n_access", "n_hex", "n_crf", "base_sha256", "spans"],
            )

    narrow = docs.select(docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text"))
    schema = f"key {kind}, n_assign long, n_access long, n_hex long, n_crf long, base_sha256 string, spans string"
    return narrow.mapInArrow(run, schema).withColumnRenamed("key", key)


def mask_secrets(docs: DataFrame, field: Field, text: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The documents with every secret value replaced by ``mask``; all rows and columns stay, null texts too."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        crf, known = shared.value, {}
        for batch in batches:
            if len(known) > 500_000:
                known.clear()
            yield batch.map(lambda t: masked(t, crf, known, mask) if t else t)

    return docs.withColumn(text, clean(F.col(f"`{text}`")))


def masked(text: str, field: Field, known: dict[str, bool], mask: str) -> str:
    _, every = scan_text(text, field, known)
    if not every:
        return text
    spans = sorted([*secret_values(text), *((a, b) for a, b, kind in every if kind == FIELD)])
    out, at = [], 0
    for a, b in spans:
        if a >= at:
            out += [text[at:a], mask]
        at = max(at, b)
    return "".join([*out, text[at:]])
