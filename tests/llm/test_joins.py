"""N-gram join, line dedup, top-k search and embedding dedup against brute force."""

from __future__ import annotations

import math
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lathework.llm import embed_dedup, line_dedup, ngram_join, topk_search



class Groups(dict):
    def __missing__(self, x):
        self[x] = x
        return x

    def root(self, x):
        while self[x] != x:
            x = self[x]
        return x

    def join(self, x, y):
        x, y = self.root(x), self.root(y)
        self[max(x, y)] = min(x, y)


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    width = min(width, len(words))
    return frozenset((width, *words[i : i + width]) for i in range(len(words) - width + 1))


def brute_components(rows, width, percent):
    sets = [shingle_set(t, width) for _, t in rows]
    groups = Groups()
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * len(a | sets[j]) and sets[j]:
                groups.join(i, j)
    least = {}
    for i, (key, _) in enumerate(rows):
        r = groups.root(i)
        least[r] = min((k for k in (least.get(r), key) if k is not None), default=None)
    return sorted(str((k, len(sets[i]), least[groups.root(i)])) for i, (k, _) in enumerate(rows))


def near_copies(seed, count, words, edits):
    draw = random.Random(seed)
    base = [f"w{draw.randrange(10**6)}" for _ in range(words)]
    out = []
    for n in range(count):
        copy = list(base)
        for _ in range(draw.randrange(edits + 1)):
            copy[draw.randrange(words)] = f"e{n}{draw.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_ngram_components(spark, edge_docs, edge_rows, no_docs, width, percent):
    texts = near_copies(1, 60, 150, 8) + near_copies(2, 30, 40, 3) + near_copies(3, 12, 9, 2) + near_copies(4, 8, 2, 1)
    rows = [(100 + i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = ngram_join.ngram_components(docs, width=width, percent=percent)
    assert sorted(str(tuple(r)) for r in found.collect()) == brute_components(rows, width, percent)
    found = ngram_join.ngram_components(edge_docs, width=width, percent=percent)
    assert sorted(str(tuple(r)) for r in found.collect()) == brute_components([r[:2] for r in edge_rows], width, percent)
    assert ngram_join.ngram_components(no_docs).count() == 0


def test_tiles_meet_across_their_edges(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE_GRAMS", 1 << 9)
    monkeypatch.setattr(ngram_join, "SLICE_GRAMS", 64)
    rows = list(enumerate(near_copies(9, 40, 80, 6)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_join.ngram_components(docs, width=3, percent=80)
    assert sorted(str(tuple(r)) for r in found.collect()) == brute_components(rows, 3, 80)


def test_signatures_agree_somewhere_for_every_link():
    draw = np.random.default_rng(3)
    bounds = ngram_join.Bounds(80)
    for size in (5, 11, 40, 300, 2000):
        for _ in range(20):
            both = np.unique(draw.integers(0, 2**64, size, dtype=np.uint64))
            more = [np.unique(draw.integers(0, 2**64, size // 9, dtype=np.uint64)) for _ in range(2)]
            a, b = (np.unique(np.concatenate([both, x])) for x in more)
            if bounds.links(len(np.intersect1d(a, b)), len(a), len(b)) and not np.array_equal(a, b):
                assert np.intersect1d(ngram_join.signatures(a, bounds), ngram_join.signatures(b, bounds)).size


def test_linked_sets_share_as_many_signatures_as_both_need():
    draw = np.random.default_rng(4)
    for percent, size in [(80, 5), (80, 12), (80, 40), (80, 300), (80, 2000), (90, 30), (90, 400)]:
        bounds, most = ngram_join.Bounds(percent), (100 - percent) / (2 * percent)
        for _ in range(20):
            both = np.unique(draw.integers(0, 2**64, size, dtype=np.uint64))
            more = [np.unique(draw.integers(0, 2**64, int(size * most), dtype=np.uint64)) for _ in range(2)]
            a, b = (np.unique(np.concatenate([both, x])) for x in more)
            if not bounds.links(len(np.intersect1d(a, b)), len(a), len(b)) or np.array_equal(a, b):
                continue
            left = {number: (need, signs) for number, need, signs in ngram_join.class_signatures(a, bounds)}
            right = {number: (need, signs) for number, need, signs in ngram_join.class_signatures(b, bounds)}
            shared = [(len(np.intersect1d(left[k][1], right[k][1])), left[k][0], right[k][0]) for k in left.keys() & right.keys()]
            assert any(n >= max(ours, theirs) for n, ours, theirs in shared) and all(x >= 1 for y in shared for x in y[1:])


def watched_scratch(monkeypatch):
    kept, real = {}, ngram_join.Scratch.keep

    def keep(self, df, label):
        kept[label] = real(self, df, label)
        return kept[label]

    monkeypatch.setattr(ngram_join.Scratch, "keep", keep)
    return kept


def test_a_passage_that_many_have_makes_no_group(spark, monkeypatch):
    """Pairs of near copies, all with one passage: linked are the pairs alone, and their texts meet no others."""
    draw = random.Random(11)
    passage = " ".join(f"p{n}" for n in range(60))
    texts = []
    for n in range(80):
        words = [f"w{draw.randrange(10**6)}" for _ in range(draw.randrange(180, 220))]
        texts += [" ".join([*words, passage]), " ".join([*words[:-1], f"e{n}", passage])]
    rows = list(enumerate(texts))
    kept = watched_scratch(monkeypatch)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = ngram_join.ngram_components(docs, width=5, percent=80)
    assert sorted(str(tuple(r)) for r in found.collect()) == brute_components(rows, 5, 80)
    sizes = [r["count"] for r in kept["tiles"].groupBy("group").count().collect()]
    assert sum(sizes) == 160 and max(sizes) <= 8


def test_tiles_inside_one_component_do_not_meet_again(spark, monkeypatch):
    """A large group of near copies costs products in proportion to its tiles."""
    monkeypatch.setattr(ngram_join, "TILE_GRAMS", 1 << 9)
    rows = list(enumerate(near_copies(12, 240, 80, 1)))
    kept = watched_scratch(monkeypatch)
    found = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=80)
    assert sorted(str(tuple(r)) for r in found.collect()) == brute_components(rows, 3, 80)
    tiles = kept["tiles"].select("group", "tile").distinct().count()
    assert tiles >= 15 and kept["tile-pairs"].count() <= 2 * tiles and kept["component-pairs"].count() == 0


def test_written_tables_leave_no_shuffle(spark):
    """Its files go when the table is written, not when the driver collects its garbage."""
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {n for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(disk.getAllFiles()) if (n := f.getName()).startswith("shuffle_")}
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, there = spark.conf.get(setting, "false"), shuffled()
    rows = spark.range(1000).repartition(4, "id").groupBy((F.col("id") % 7).alias("k")).count()
    table = ngram_join.Scratch(spark).keep(rows, "counts")
    for _ in range(50):
        if not shuffled() - there:
            break
        time.sleep(0.1)
    assert not shuffled() - there and spark.conf.get(setting, "false") == before
    assert sum(r["count"] for r in table.collect()) == 1000


def test_representatives_keep_one_row_of_each_group(edge_docs):
    kept = ngram_join.keep_representatives(edge_docs)
    assert kept.columns == edge_docs.columns
    keys = sorted(str(r["doc_id"]) for r in kept.collect())
    assert keys == sorted(["None", "None", "1", "2", "3", "4", "5", "7", "8", "9", "10"])


def brute_lines(rows, min_words):
    """Positions deleted, by row; rows are in order of key and text."""
    lines = [(t.split("\n") if t is not None else []) for _, t in rows]
    gone = [set() for _ in rows]
    flat = [(d, i) for d, x in enumerate(lines) for i in range(len(x))]
    for b in flat:
        for a in flat:
            if a >= b:
                break
            size = words = 0
            while (
                a[1] + size < len(lines[a[0]]) and b[1] + size < len(lines[b[0]])
                and lines[a[0]][a[1] + size] == lines[b[0]][b[1] + size]
            ):
                words += len(re.findall(r"[^\x20\x09-\x0D]+", lines[b[0]][b[1] + size]))
                size += 1
            if words >= min_words:
                gone[b[0]] |= set(range(b[1], b[1] + size))
    return ["\n".join(x for i, x in enumerate(ls) if i not in g) if t is not None else None for (_, t), ls, g in zip(rows, lines, gone)]


def test_line_runs(spark):
    draw = random.Random(4)
    pool = ["", "a", "b c", "one two three", "x y z w", "five words are in here"]
    rows = [(k, "\n".join(draw.choice(pool) for _ in range(draw.randrange(1, 14)))) for k in range(24)] + [(99, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for min_words in (1, 6, 12):
        found = dict(line_dedup.drop_repeated_runs(docs, min_words=min_words).collect())
        assert [found[k] for k, _ in rows] == brute_lines(rows, min_words)


def test_line_dedup_of_edge_rows(edge_docs, no_docs):
    out = line_dedup.drop_repeated_runs(edge_docs, removed_count="gone", min_words=30)
    assert out.columns == [*edge_docs.columns, "gone"]
    found = [(r["doc_id"], r["text"], r["gone"]) for r in out.collect()]
    assert sorted(f[2] for f in found if f[0] == 5) == [0, 0]  # rows that repeat key and text are one document
    assert [f[1:] for f in found if f[0] == 6] == [("", 1)]
    assert len(found) == 13 and {f[1] for f in found if f[0] in (1, 2)} == {None, ""}
    assert line_dedup.drop_repeated_runs(edge_docs, keep_emptied=False, min_words=30).count() == 12
    assert line_dedup.drop_repeated_runs(no_docs).count() == 0


def test_long_stretches_of_equal_lines(spark):
    """A run starts at every line of a stretch of blank lines; what goes is the later copy, each line once."""
    blanks, words = [""] * 3000, [f"word{i}" for i in range(60)]
    text = "\n".join(["a", *blanks, *words, "b"])
    docs = spark.createDataFrame([(1, text), (2, "\n".join([*blanks, *words, "c"]))], "doc_id long, text string")
    out = {r["doc_id"]: r for r in line_dedup.drop_repeated_runs(docs, removed_count="gone").collect()}
    assert out[1]["gone"] == 0 and out[1]["text"] == text
    assert out[2]["gone"] == 3060 and out[2]["text"] == "c"


def test_line_dedup_plan_is_native(edge_docs):
    plan = line_dedup.drop_repeated_runs(edge_docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


VECTORS = "vec_id long, embedding array<float>, label int, `row` int, name string"


def vector_rows(count=120, dim=8):
    draw = np.random.default_rng(11)
    rows = [(k, [float(x) for x in draw.standard_normal(dim)], None, 1, "n") for k in range(count)]
    rows += [(200 + k, [x + 0.02 * k for x in rows[7][1]], None, 1, None) for k in range(6)]
    rows += [
        (300, None, 1, 1, None), (301, [float("nan")] * dim, 1, 1, None), (302, [1.0, None] + [0.0] * (dim - 2), 1, 1, None),
        (303, [0.0] * dim, 1, 1, None), (304, [], 1, 1, None), (305, [1.0, 2.0], 1, 1, None), (None, rows[3][1], 1, 1, None),
        (400, rows[7][1], 1, 1, None), (400, rows[7][1], 1, 1, None), (306, [float("inf")] * dim, 1, 1, None),
    ]
    return rows


def test_topk(spark, monkeypatch):
    monkeypatch.setattr(topk_search, "BLOCK", 16)
    monkeypatch.setattr(topk_search, "QUERY_BLOCK", 4)
    rows = vector_rows()
    frame = spark.createDataFrame(rows, VECTORS).repartition(3)
    found = topk_search.search(frame, F.col("vec_id") % 20 == 0, k=5)
    whole = [
        (i, k, [math.floor(1024 * float(np.float32(x))) for x in v])
        for i, (k, v, *_) in enumerate(rows)
        if k is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    wanted = []
    for i, key, query in whole:
        if key % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(query, v)), k) for j, k, v in whole if j != i and len(v) == len(query))
            wanted += [(key, n + 1, k, -s) for n, (s, k) in enumerate(scores[:5])]
    assert sorted(map(tuple, found.collect())) == sorted(wanted)
    assert topk_search.search(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def block_of(rows):
    ids = np.array([[k, name] for k, name, _ in rows], np.int64)
    return topk_search.Block(len(rows), ids.tobytes(), np.array([v for _, _, v in rows], np.float64).tobytes())


@pytest.mark.parametrize(("low", "high", "dim"), [(-3, 3, 16), (-1000, 1000, 64), (0, 1, 3), (-(10**9), 10**9, 5), (-(10**12), 10**12, 2)])
def test_blocks_of_queries_meet_blocks_of_candidates(low, high, dim):
    draw = random.Random(dim)
    rows = [(k, draw.randint(0, 60), [draw.randint(low, high) for _ in range(dim)]) for k in range(300)]
    rows = [(k, name, rows[5][2] if k % 9 == 0 else v) for k, name, v in rows]
    queries, k = rows[:24], 7
    best = topk_search.Best(block_of(queries), k)
    for start in range(0, len(rows), 100):
        best.meet(block_of(rows[start : start + 100]))
    capped = lambda x: max(-(2**63), min(2**63 - 1, x))
    wanted = []
    for n, (row, _, q) in enumerate(queries):
        scores = [(-capped(sum(a * b for a, b in zip(q, v))), name, other) for other, name, v in rows if other != row]
        wanted += [(n, -s, name, other) for s, name, other in sorted(scores)[:k]]
    assert list(zip(*(c.tolist() for c in (best.query, best.score, best.name, best.row)))) == wanted


def test_scores_beyond_double_precision():
    best = topk_search.Best(block_of([(2, 7, [3e9, 3.0])]), 2)
    best.meet(block_of([(0, 5, [3e9, 1.0]), (1, 6, [3e9, 2.0])]))
    assert best.score.tolist() == [9 * 10**18 + 6, 9 * 10**18 + 3] and best.name.tolist() == [6, 5]


def test_embedding_links(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "TILE", 4)
    rows = vector_rows()
    found = embed_dedup.near_duplicates(spark.createDataFrame(rows, VECTORS).repartition(3)).collect()
    fine = [
        (i, np.array(v, np.float32).astype(float))
        for i, (k, v, *_) in enumerate(rows)
        if v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]
    groups, links = Groups(), {i: 0 for i in range(len(rows))}
    for a, x in fine:
        for b, y in fine:
            if a < b and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.9:
                groups.join(a, b)
                links[a] += 1
                links[b] += 1
    least = {}
    for i, row in enumerate(rows):
        r = groups.root(i)
        least[r] = min((k for k in (least.get(r), row[0]) if k is not None), default=None)
    wanted = [(row[0], links[i], least[groups.root(i)]) for i, row in enumerate(rows)]
    assert sorted(str(tuple(r)[:3]) for r in found) == sorted(map(str, wanted))
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found if r["vec_id"] is not None)
    assert embed_dedup.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def test_passes_grow_with_the_logarithm_of_the_rows():
    few, many = embed_dedup.passes_for(10_000, 0.9), embed_dedup.passes_for(10**9, 0.9)
    assert few < many < few * 30


def true_components(vectors, threshold=0.9):
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    groups = Groups()
    for a, b in np.argwhere(np.triu(unit @ unit.T >= threshold, 1)):
        groups.join(int(a), int(b))
    return {k: groups.root(k) for k in range(len(vectors))}


def test_links_into_a_dense_region(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "LARGE", 128, raising=False)
    draw = np.random.default_rng(5)
    scaled = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    middle = scaled(draw.standard_normal(32))
    blob = scaled(middle + 0.25 * scaled(draw.standard_normal((600, 32))))
    near = blob[:60]
    away = scaled((near @ middle)[:, None] * near - middle)
    linked = 0.92 * near + math.sqrt(1 - 0.92**2) * away
    vectors = np.concatenate([blob, linked, draw.standard_normal((1200, 32))])
    assert ((scaled(linked) @ blob.T >= 0.9).sum(axis=1) < 4).all()
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = embed_dedup.near_duplicates(frame, window=4)
    wanted = true_components(vectors)
    assert {r["vec_id"]: r["component_id"] for r in found.collect()} == wanted
    assert sum(r == 0 for r in wanted.values()) >= 660


def test_vectors_meet_whatever_the_partitions(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "LEAST_PASSES", 1)
    draw = np.random.default_rng(6)
    half = draw.standard_normal((50, 64))
    vectors = np.concatenate([half, half + 0.3 * draw.standard_normal((50, 64))])
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        found = {r["vec_id"]: r["component_id"] for r in embed_dedup.near_duplicates(frame, recall=0.5).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found == true_components(vectors)


def test_tiles_of_short_texts_have_bounded_rows(spark, monkeypatch):
    kept, real = {}, ngram_join.Scratch.keep

    def keep(self, df, label):
        kept[label] = real(self, df, label)
        return kept[label]

    monkeypatch.setattr(ngram_join.Scratch, "keep", keep)
    docs = spark.range(3000).selectExpr("id as doc_id", "concat('a b c d e f g h i j k w', id) as text")
    found = ngram_join.ngram_components(docs, width=3, percent=80).collect()
    assert len(found) == 3000 and {r["component_id"] for r in found} == {0}
    sizes = [r["count"] for r in kept["tiles"].groupBy("group", "tile").count().collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 2048


def test_windows_of_a_sorted_stream():
    draw = np.random.default_rng(7)
    for size, window, seen in [(1, 3, 0), (7, 3, 0), (40, 4, 9), (64, 8, 8), (65, 8, 0)]:
        unit = embed_dedup._unit(draw.standard_normal((size, 3)))
        a, b = embed_dedup._window_links(unit, seen, window, 0.8)
        near = unit @ unit.T >= 0.8
        wanted = {(i, j) for i in range(seen, size) for j in range(max(0, i - window), i) if near[i, j]}
        assert set(zip(a.tolist(), b.tolist())) == wanted and len(a) == len(wanted)
        groups = Groups()
        for i, j in wanted:
            groups.join(i, j)
        held, least = embed_dedup._forest(a, b, size)
        assert dict(zip(held.tolist(), least.tolist())) == {k: groups.root(k) for k in range(size) if groups.root(k) != k}


@pytest.mark.parametrize("batch", [1, 5, 37, 400])
def test_neighbours_do_not_depend_on_batches(batch):
    draw = np.random.default_rng(8)
    window, shift, size = 6, 40, 200
    vectors = np.repeat(draw.standard_normal((40, 4)), 5, axis=0) + 0.3 * draw.standard_normal((size, 4))
    order = sorted((int(p), int(draw.choice([0, 0, 0, 1, 2, 3])) << shift, k) for k, p in enumerate(draw.integers(0, 2, size)))
    table = pa.table({
        "pass": pa.array([p for p, _, _ in order], pa.int32()), "dim": pa.array([32] * size, pa.int32()),
        "part": pa.array([0] * size, pa.int64()), "name": pa.array([n for _, n, _ in order], pa.int64()),
        "row": pa.array([k for _, _, k in order], pa.int64()), "v": pa.array([vectors[k].tobytes() for _, _, k in order], pa.binary()),
    })
    run = embed_dedup._neighbours(0.9, window, shift, "<f8")
    found, wanted = Groups(), Groups()
    for part in run(iter(table.to_batches(max_chunksize=batch))):
        for a, b in zip(part.column("a").to_pylist(), part.column("b").to_pylist()):
            found.join(a, b)
    unit = embed_dedup._unit(vectors)
    for i, (p, name, a) in enumerate(order):
        for j, (q, other, b) in enumerate(order[:i]):
            if p == q and (name == other or i - j <= window) and unit[a] @ unit[b] >= 0.9:
                wanted.join(a, b)
    assert [found.root(k) for k in range(size)] == [wanted.root(k) for k in range(size)]


def test_planted_pairs_at_the_threshold_are_found(spark):
    draw = np.random.default_rng(9)
    half = embed_dedup._unit(draw.standard_normal((300, 64)))
    side = draw.standard_normal((300, 64))
    side = embed_dedup._unit(side - (side * half).sum(axis=1, keepdims=True) * half)
    vectors = np.concatenate([half, 0.905 * half + math.sqrt(1 - 0.905**2) * side, draw.standard_normal((4000, 64))])
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    found = {r["vec_id"]: r["component_id"] for r in embed_dedup.near_duplicates(frame).where("n_links > 0").collect()}
    assert sum(found.get(300 + k) == k for k in range(300)) >= 294
