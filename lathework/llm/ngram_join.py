"""N-gram Jaccard join: all links of at least a similarity, exact, as a blocked product of the document by n-gram matrix.

The matrix is cut along both sides. Along the n-grams (ordered by hash) a document's row falls into blocks, one more than
the number of n-grams in which two linked documents of its size class can differ, and some to spare. So the rows of linked documents
are equal in a known number of whole blocks, one more than the spare ones. Of its blocks each document leaves out the most popular ones, one
fewer than it must share: linked documents still share one, while a passage that many have makes no candidates. Along the documents, those
that hang together by shared blocks are cut into tiles of a bounded number of n-grams and of documents, ordered by size. A
pair of tiles whose sizes allow a link is one product: overlap counts add up over slices of the n-grams, and pairs
that cannot reach their bound any more are discarded on the way. In groups of many tiles each one first meets
itself and the next one; then the tiles are cut anew along the components found, and those meet that are not inside one component.

Before that, rows that cannot link go: those with more n-grams of their own than a link allows. Own n-grams are counted over a
fixed slice of the hash range, which is enough to tell: what a slice lacks, the whole lacks too. Each task sends its
n-grams of the slice as arrays by hash range.

Documents with equal sets are one row of the matrix, however many there are. A product returns a spanning forest of its
links, not all pairs, so a group of near copies costs rows in proportion to its members (times its tiles, where they do not hang together).
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lathework.llm.common import Forest, Scratch, components, grouped, lean
from lathework.operators.ordering import with_row_index

#: N-grams of the documents of one tile.
TILE_GRAMS = 1 << 17
#: Documents of one tile, however short: the dense arrays of a product take some 40 bytes for each pair of documents.
TILE_ROWS = 2048
#: Groups of so many tiles have all pairs of them multiplied at once.
FEW_TILES = 8
#: N-grams of one slice of a product.
SLICE_GRAMS = 4096
#: Blocks beyond those that a linked pair can spoil: so many, empty ones first, a document can leave out; one more for each 2 blocks.
SPARE_BLOCKS = 2
#: Largest ratio of sizes in one class, about: wider classes have more blocks for their small members, narrower ones more
#: members that belong to two.
CLASS_RATIO = 1.4
#: Texts that become Python objects at once, and words whose hashes a task remembers.
TEXTS_AT_ONCE = 1024
KNOWN_WORDS = 1 << 17
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _B
    return (x ^ (x >> np.uint64(29))) * _C


def _few(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(start, TEXTS_AT_ONCE) for batch in batches for start in range(0, batch.num_rows, TEXTS_AT_ONCE))


class Shingles:
    """Sets of word n-gram hashes (sorted, 64 bits) of texts.

    Words are runs of characters other than ASCII blanks, A-Z in lower case. A text with fewer words than ``width`` has its
    whole sequence as its one n-gram, a text without words has none.
    """

    def __init__(self, width: int = 3):
        self.width = width
        self._words: dict[bytes, int] = {}

    def sets(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        return [self._set(self._hashes(t.encode("utf-8", "replace").lower().split() if t else [])) for t in texts]

    def _hashes(self, row: list[bytes]) -> np.ndarray:
        """Of the words of one text: those of a whole batch would be Python objects of many times its size."""
        known = self._words
        if len(known) > KNOWN_WORDS:
            known.clear()
        for word in row:
            if word not in known:
                known[word] = xxhash.xxh3_64_intdigest(word)
        return np.array([known[w] for w in row], np.uint64)

    def _set(self, words: np.ndarray) -> np.ndarray:
        if not len(words):
            return words
        width = min(self.width, len(words))
        grams = np.full(len(words) - width + 1, width, np.uint64)
        for k in range(width):
            grams = _mix(grams * _A + words[k : len(words) - width + 1 + k])
        return np.unique(grams)


class Bounds:
    """What sizes say about a link: ``percent`` of the union must be shared."""

    def __init__(self, percent: int):
        if not 50 <= percent <= 100:
            raise ValueError("percent must be from 50 to 100")
        self.percent = percent
        self._steps = max(1, round(math.log(CLASS_RATIO) / math.log(100 / percent))) if percent < 100 else 1
        self._starts = [1]

    def links(self, overlap, a, b):
        """Whether sets of ``a`` and ``b`` n-grams that share ``overlap`` are linked."""
        return (100 + self.percent) * overlap >= self.percent * (a + b)

    def size_class(self, size: int) -> int:
        """Number of the size's class; a class and the next one hold all partners of its larger members."""
        while self._starts[-1] <= size:
            start = self._starts[-1]
            for _ in range(self._steps):
                start = max(start + 1, -(-100 * (start - 1) // self.percent) + 1)
            self._starts.append(start)
        return int(np.searchsorted(self._starts, size, "right")) - 1

    def blocks(self, number: int) -> tuple[int, int]:
        """Blocks of a class and how many of them are spare: one for each difference that its largest pairs can have, one
        more, and the spare ones. None if linked sets are equal.
        """
        while len(self._starts) <= number + 1:
            self.size_class(self._starts[-1])
        most = 2 * (self._starts[number + 1] - 1) * (100 - self.percent) // (100 + self.percent)
        spare = SPARE_BLOCKS + most // 2
        return (most + 1 + spare, spare) if most else (0, 0)

    def slice_share(self) -> float:
        """Share of the hash range over which own n-grams are counted: twice and a half what a link leaves."""
        return min(1.0, 2.5 * (100 - self.percent) / 100) or 1.0

    def classes(self, size: int) -> list[int]:
        """The size's own class, and the next if a partner may be there."""
        own = self.size_class(size)
        self.size_class(self._starts[own + 1])
        return [own, own + 1] if 100 * size >= self.percent * self._starts[own + 1] else [own]


def class_signatures(grams: np.ndarray, bounds: Bounds) -> Iterator[tuple[int, int, np.ndarray]]:
    """Per size class that a set's row belongs to: its number, one hash for each block, and how many of them a linked set must share.

    Blocks are even ranges of the hash. A linked pair has one equal block more than there are spare ones. Empty blocks have no signature,
    and count as shared, unless there are more than the spare ones: then a partner may have left out as many, and one is what must be shared.
    """
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_mix(grams ^ _A), dtype=np.uint64)])
    for number in bounds.classes(len(grams)):
        blocks, spare = bounds.blocks(number)
        if not blocks:
            continue
        edges = (np.arange(1, blocks, dtype=np.float64) * (2.0**64 / blocks)).astype(np.uint64)
        cuts = np.concatenate([[0], np.searchsorted(grams, edges), [len(grams)]])
        place = np.arange(blocks, dtype=np.uint64) + np.uint64(number << 32)
        signs = _mix(_mix(sums[cuts[1:]] - sums[cuts[:-1]]) + place * _A)
        full = cuts[1:] > cuts[:-1]
        empty = int(blocks - full.sum())
        yield (number, spare + 1 - empty, signs[full]) if empty <= spare else (number, 1, signs)


def signatures(grams: np.ndarray, bounds: Bounds) -> np.ndarray:
    """The block hashes of all size classes of a set."""
    out = [signs for _, _, signs in class_signatures(grams, bounds)]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def product(sets: list[np.ndarray], left: int, bounds: Bounds) -> list[tuple[int, int]]:
    """A spanning forest of the links between the first ``left`` sets and the others, or among all if there are no others."""
    sizes = np.array([len(s) for s in sets], np.int64)
    rows = np.repeat(np.arange(len(sets)), sizes)
    _, columns, copies = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = copies > 1
    number = np.cumsum(shared) - 1
    keep = shared[columns]
    rows, columns = rows[keep], number[columns[keep]]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    ours = slice(0, left)
    theirs = slice(left, None) if left < len(sets) else ours
    overlap = np.zeros((left, len(sets) - left if left < len(sets) else left), np.float32)
    rest = np.bincount(rows, minlength=len(sets))
    need = bounds.percent * (sizes[ours, None] + sizes[None, theirs])
    alive = np.ones(overlap.shape, bool)
    total = int(shared.sum())
    for start in range(0, total, SLICE_GRAMS):
        a, b = np.searchsorted(columns, [start, start + SLICE_GRAMS])
        part = np.zeros((len(sets), min(SLICE_GRAMS, total - start)), np.float32)
        part[rows[a:b], columns[a:b] - start] = 1
        some, other = alive.any(axis=1), alive.any(axis=0)
        overlap[np.ix_(some, other)] += part[ours][some] @ part[theirs][other].T
        rest -= np.bincount(rows[a:b], minlength=len(sets))
        reach = overlap + np.minimum(rest[ours, None], rest[None, theirs])
        alive &= (100 + bounds.percent) * reach.astype(np.int64) >= need
        if not alive.any():
            return []
    linked = alive & ((100 + bounds.percent) * overlap.astype(np.int64) >= need)
    forest = Forest(len(sets))
    base = left if left < len(sets) else 0
    return [(int(x), int(y) + base) for x, y in zip(*np.nonzero(linked)) if x != y + base and forest.join(int(x), int(y) + base)]


def ngram_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 3, percent: int = 90
) -> DataFrame:
    """``key, n_shingles, component_id`` for every row: two rows link if their n-gram sets share ``percent`` of their union.

    ``component_id`` is the smallest key that links reach, the row's own included. Texts without words (null and empty ones
    among them) have 0 n-grams and link with nothing. Rows with equal sets link, repeated rows too. A null key is never the smallest
    unless the whole component has none. Only ``key`` and ``text`` are read.

    Sets are named by a 64-bit digest; a second one is compared, and two different sets of one name end the job.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    kind = docs.schema[key].dataType.simpleString()

    def describe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in _few(batches):
            sets = shingles.sets(batch.column("text").to_pylist())
            columns = [
                batch.column("key"),
                batch.column("row"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_name(s) for s in sets], pa.int64()),
                pa.array([_name(s, 1) for s in sets], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "row", "n", "node", "proof"])

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, bounds = Shingles(width), Bounds(percent)
        for batch in _few(batches):
            sets = shingles.sets(batch.column("text").to_pylist())
            found = [(node, *x) for node, s in zip(batch.column("node").to_pylist(), sets) for x in class_signatures(s, bounds)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x in found], pa.int64()),
                    pa.array([x[1] for x in found], pa.int32()),
                    pa.array([x[2] for x in found], pa.int32()),
                    pa.array([x[3].view(np.int64) for x in found], pa.list_(pa.int64())),
                ],
                names=["node", "class", "need", "signs"],
            )

    rows = docs.select(
        docs[f"`{key}`"].alias("key"), docs[f"`{text}`"].alias("text"), F.xxhash64(docs[f"`{key}`"], docs[f"`{text}`"]).alias("row")
    )
    schema = f"key {kind}, row long, n long, node long, proof long"
    described = scratch.keep(rows.mapInArrow(lean(describe), schema), "shingle-sets")
    sets = described.where("node is not null").groupBy("node").agg(
        F.min("row").alias("row"), F.min("n").alias("n"), F.min("proof").alias("a"), F.max("proof").alias("b")
    )
    own = _own_grams(rows.select("text"), width, Bounds(percent))
    sets = sets.join(own, "node", "left").where(100 * (F.col("n") - F.coalesce("own", F.lit(0))) >= percent * F.col("n"))
    sets = scratch.keep(sets, "linkable-sets")
    if sets.where("a < b").head(1):
        raise RuntimeError("two different n-gram sets have one digest")
    # a merge join whatever the sizes: texts move once, in proportion to the input
    texts = rows.join(sets.select("row", "node", "n").hint("merge"), "row").dropDuplicates(["row"])
    texts = scratch.keep(texts.select("node", "n", "text"), "linkable-texts")
    signs = texts.select("node", "text").mapInArrow(lean(sign), "node long, class int, need int, signs array<long>")
    signs = signs.select("node", "class", "need", F.explode("signs").alias("sign"))
    # one shuffle of the signatures, and only those of several sets are written
    signs = signs.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy("sign"))).where("copies > 1")
    signs = scratch.keep(signs, "signatures")
    popular = Window.partitionBy("node", "class").orderBy(F.col("copies").desc(), "sign")
    rare = signs.withColumn("rank", F.row_number().over(popular)).where("rank >= need").select("node", "sign")
    rare = scratch.keep(rare, "rare-signatures")
    scratch.drop(signs)
    shared = rare.groupBy("sign").agg(F.min("node").alias("hub"), F.max("node").alias("other")).where("hub < other")
    met = rare.join(shared.select("sign", "hub"), "sign").where("node > hub").select("node", "hub")
    near = components(met, "node", "hub").withColumnRenamed("root", "group")
    scratch.drop(rare)
    links = _products(texts, near, width, percent, scratch)
    scratch.drop(texts)
    roots = components(links, "a", "b")
    placed = described.select("key", "n", "node").join(roots, "node", "left")
    placed = placed.withColumn("root", F.coalesce("root", "node"))
    smallest = placed.where("root is not null").groupBy("root").agg(F.min("key").alias("least"))
    return placed.join(smallest, "root", "left").select(
        F.col("key").alias(key), F.col("n").alias("n_shingles"), F.coalesce("least", "key").alias("component_id")
    )


def _name(grams: np.ndarray, seed: int = 0) -> int | None:
    """A set's digest; none for the empty set."""
    return xxhash.xxh3_64_intdigest(grams.tobytes(), seed) - 2**63 if len(grams) else None


def _own_grams(texts: DataFrame, width: int, bounds: Bounds) -> DataFrame:
    """``node, own``: how many n-grams of the slice no other set has.

    A batch sends, for each part of the slice, its n-grams (the low 48 bits; the part tells the high ones) with the sets that have
    them, each set once; a part sends its counts, as arrays too, by set. Two n-grams with the same bits make a set seem less alone, never more.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    limit = int(bounds.slice_share() * 2**64) - 1
    edges = (np.arange(parts + 1, dtype=np.float64) * (limit / parts)).astype(np.uint64)

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in _few(batches):
            found = {_name(s): s[: np.searchsorted(s, np.uint64(limit))] for s in shingles.sets(batch.column(0).to_pylist()) if len(s)}
            if not found:
                continue
            names = np.array(list(found), np.int64)
            grams = np.concatenate(list(found.values()))
            owner = np.repeat(np.arange(len(names), dtype=np.int32), [len(s) for s in found.values()])
            order = np.argsort(grams, kind="stable")
            grams, owner = grams[order], owner[order]
            cuts = np.searchsorted(grams, edges)
            cuts[-1] = len(grams)
            for part in np.flatnonzero(np.diff(cuts)):
                a, b = cuts[part], cuts[part + 1]
                there, index = np.unique(owner[a:b], return_inverse=True)
                blobs = [
                    grams[a:b].view(np.uint8).reshape(-1, 8)[:, :6].tobytes(),
                    index.astype(np.uint16 if len(there) < 1 << 16 else np.uint32).tobytes(),
                    names[there].tobytes(),
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part], pa.int32()), *(pa.array([x], pa.binary()) for x in blobs)],
                    names=["part", "grams", "owner", "names"],
                )

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, ["part"]):
            grams, nodes = [], []
            for raw, owner, names in zip(*(part.column(c).to_pylist() for c in ("grams", "owner", "names"))):
                wide = np.zeros((len(raw) // 6, 8), np.uint8)
                wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
                grams.append(wide.view(np.uint64).ravel())
                kind = np.uint16 if len(owner) == 2 * len(wide) else np.uint32
                nodes.append(np.frombuffer(names, np.int64)[np.frombuffer(owner, kind)])
            gram, node = np.concatenate(grams), np.concatenate(nodes)
            order = np.lexsort((node, gram))
            gram, node = gram[order], node[order]
            first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
            last = np.concatenate([first[1:], [len(gram)]]) - 1
            alone, own = np.unique(node[first][node[first] == node[last]], return_counts=True)
            shard = alone % parts
            order = np.argsort(shard, kind="stable")
            alone, own, shard = alone[order], own[order].astype(np.int32), shard[order]
            for number in np.unique(shard):
                a, b = np.searchsorted(shard, [number, number + 1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int32()), pa.array([alone[a:b].tobytes()], pa.binary()), pa.array([own[a:b].tobytes()], pa.binary())],
                    names=["shard", "names", "counts"],
                )

    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in grouped(batches, ["shard"]):
            nodes = np.frombuffer(b"".join(shard.column("names").to_pylist()), np.int64)
            counts = np.frombuffer(b"".join(shard.column("counts").to_pylist()), np.int32)
            node, place = np.unique(nodes, return_inverse=True)
            own = np.bincount(place, counts, len(node)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(own)], names=["node", "own"])

    sent = texts.mapInArrow(lean(deal), "part int, grams binary, owner binary, names binary")
    # a task gets one part: hashed, some tasks would get several
    dealt = sent.repartitionById(parts, F.col("part")).sortWithinPartitions("part")
    counted = dealt.mapInArrow(lean(count), "shard int, names binary, counts binary")
    met = counted.repartitionById(parts, F.col("shard")).sortWithinPartitions("shard")
    return met.mapInArrow(lean(total), "node long, own long")


def _products(texts: DataFrame, near: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """``a, b``: links that hold together what any links of a group hold together; a tile's sizes are within a factor of two.

    ``texts`` has one text for each set, ``near`` the group in which it may link.
    """
    members = texts.select("node", "n").join(near, "node").withColumn("klass", F.floor(F.log2("n")))
    placed = _tiles(members, ["n", "node"], scratch, "tiles")
    tiles = placed.groupBy("group", "tile").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    tiles = tiles.withColumn("at", F.row_number().over(Window.partitionBy("group").orderBy("tile")))
    tiles = scratch.keep(tiles.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("group"))), "tile-sizes")
    last = F.when(F.col("many") > FEW_TILES, F.col("at") + 1).otherwise(F.col("many"))
    beside = tiles.select("group", F.explode(F.sequence("at", F.greatest("at", last))).alias("at"), F.col("tile").alias("i"), F.col("hi").alias("hi_i"))
    pairs = beside.join(tiles.select("group", "at", F.col("tile").alias("j"), F.col("lo").alias("lo_j")), ["group", "at"])
    pairs = scratch.keep(pairs.where(100 * F.col("hi_i") >= percent * F.col("lo_j")).select("group", "i", "j"), "tile-pairs")
    links = scratch.keep(_met(texts, placed, pairs, width, percent), "links")
    large = tiles.where((F.col("at") == 1) & (F.col("many") > FEW_TILES)).select("group")
    if not large.head(1):
        return links
    roots = components(links, "a", "b")
    members = placed.join(large, "group").select("node", "n", "group", "klass").join(roots, "node", "left")
    members = members.withColumn("root", F.coalesce("root", "node"))
    placed = _tiles(members, ["root", "n", "node"], scratch, "component-tiles")
    one = F.when(F.min("root") == F.max("root"), F.min("root"))
    tiles = placed.groupBy("group", "tile").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), one.alias("one"))
    first = tiles.select("group", F.col("tile").alias("i"), F.col("lo").alias("lo_i"), F.col("hi").alias("hi_i"), F.col("one").alias("one_i"))
    second = tiles.select("group", F.col("tile").alias("j"), F.col("lo").alias("lo_j"), F.col("hi").alias("hi_j"), F.col("one").alias("one_j"))
    pairs = first.join(second, "group").where((F.col("i") <= F.col("j")) & ~F.coalesce(F.col("one_i") == F.col("one_j"), F.lit(False)))
    sized = (100 * F.col("hi_i") >= percent * F.col("lo_j")) & (100 * F.col("hi_j") >= percent * F.col("lo_i"))
    pairs = scratch.keep(pairs.where(sized).select("group", "i", "j"), "component-pairs")
    return links.union(scratch.keep(_met(texts, placed, pairs, width, percent), "component-links"))


def _tiles(members: DataFrame, order: list[str], scratch: Scratch, label: str) -> DataFrame:
    """``members`` with the ``tile`` of their group that they fall into, in the given order within sizes of a factor of two."""
    placed = with_row_index(members, order, within=["group", "klass"], name="place")
    tall = F.greatest(F.lit(1), F.floor(F.lit(TILE_GRAMS) / F.pow(F.lit(2.0), F.col("klass") + 1)))
    tall = F.least(F.lit(TILE_ROWS), tall).cast("long")
    return scratch.keep(placed.withColumn("tile", F.struct("klass", F.floor(F.col("place") / tall).alias("k"))), label)


def _met(texts: DataFrame, placed: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """``a, b``: a spanning forest of the links of each pair of tiles. Sides are told by node, so that a text moves once before it is dealt out."""
    bounds = Bounds(percent)
    left = placed.join(pairs, (placed["group"] == pairs["group"]) & (placed["tile"] == pairs["i"]))
    right = placed.join(pairs.where("i < j"), (placed["group"] == pairs["group"]) & (placed["tile"] == pairs["j"]))
    columns = [placed["group"].alias("g"), F.xxhash64("i", "j").alias("pair")]
    sides = left.select(*columns, F.lit(0).alias("side"), "node").union(right.select(*columns, F.lit(1).alias("side"), "node"))
    sided = texts.select("node", "text").join(sides, "node").select("g", "pair", "side", "node", "text")

    def multiply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for tile in grouped(batches, ["g", "pair"]):
            sides = tile.column("side").to_pylist()
            nodes = tile.column("node").to_pylist()
            forest = product(shingles.sets(tile.column("text").to_pylist()), len(sides) - sum(sides), bounds)
            if forest:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([nodes[x] for x, _ in forest], pa.int64()), pa.array([nodes[y] for _, y in forest], pa.int64())],
                    names=["a", "b"],
                )

    dealt = sided.repartition("g", "pair").sortWithinPartitions("g", "pair", "side", "node")
    return dealt.mapInArrow(lean(multiply), "a long, b long")


def keep_representatives(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """One document of each group that links hold together: the one with the smallest key, null last, ties to the row's digest.

    Documents without words link with nothing and all stay. Rows equal in all columns are one document. All columns stay.
    """
    digest = F.xxhash64(*[docs[f"`{c}`"] for c in docs.columns])
    order = F.struct(docs[f"`{key}`"].isNull().alias("none"), docs[f"`{key}`"].alias("key"), digest.alias("digest"))
    named = docs.select(order.alias("key"), docs[f"`{text}`"].alias("text"))
    found = ngram_components(named, "key", "text", width, percent)
    kept = found.where(F.col("key") == F.col("component_id")).select(F.col("key.digest").alias("kept")).distinct()
    rows = docs.select(F.struct("*").alias("row"), digest.alias("digest"))
    if rows.groupBy("digest").count().where("count > 1").head(1):
        rows = rows.dropDuplicates(["digest"])
    return rows.join(kept.hint("merge"), rows["digest"] == kept["kept"], "left_semi").select("row.*")
