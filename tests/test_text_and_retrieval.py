from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lathework.operators import chunks, inference, retrieval


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 40), st.sampled_from([" ", "\n", "\n\n", "   "])), max_size=30), st.integers(5, 60))
def test_recursive_chunks_keep_all_text_and_fit(words, size):
    marks = iter(range(0x4E00, 0x9FFF))  # each mark occurs once, so its place is known
    text = "".join("".join(chr(next(marks)) for _ in range(n)) + blank for n, blank in words)
    overlap = size // 5
    out = chunks.split_text(text, size, overlap)
    assert all(0 < len(c) <= size and c == c.strip() for c in out)
    end = 0
    for chunk in out:
        start = text.find(chunk)
        assert start >= 0 and end - start <= overlap
        assert not text[end:start].strip()
        end = start + len(chunk)
    assert not text[end:].strip()


def test_recursive_chunks_prefer_coarse_separators():
    text = "one two\n\nthree four\n\nfive"
    assert chunks.split_text(text, 12, 0) == ["one two", "three four", "five"]
    assert chunks.split_text("abcdefgh", 3, 1) == ["abc", "cde", "efg", "gh"]


def test_recursive_chunks_table(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "  "), (3, None)], "doc_id long, text string")
    out = chunks.recursive_chunks(df, "doc_id", "text", 4, 0).collect()
    assert [(r["doc_id"], r["pos"], r["text"]) for r in out] == [(1, 0, "a b"), (1, 1, "c d")]


def test_recursive_chunks_tell_their_place(spark):
    text = "  one two\n\nthree  four five six\nseven \n\n" + "x" * 25
    rows = [(1, text, 5, "p"), (1, text, 6, None), (None, "ab", 7, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pos int, start string")
    out = chunks.recursive_chunks(df, "doc_id", "text", 11, 4)
    assert out.columns == ["doc_id", "pos", "text", "start"]
    found = [tuple(r) for r in out.collect()]
    assert all(text[start : start + len(chunk)] == chunk for key, _, chunk, start in found if key == 1)
    assert (None, 0, "ab", 0) in found and len(found) == 2 * len(chunks.split_text(text, 11, 4)) + 1


def test_the_table_function_in_sql(spark):
    spark.createDataFrame([(1, "a b c d"), (2, None)], "id long, text string").createOrReplaceTempView("split_docs")
    name = chunks.register_split(spark)
    rows = spark.sql(f"SELECT id, c.* FROM split_docs, LATERAL {name}(text, 4, 0, array(' ', '')) c ORDER BY pos").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "a b", 0), (1, 1, "c d", 4)]


@pytest.mark.parametrize("n", [1, 99, 100, 101, 800, 801, 1500, 1501])
def test_fixed_chunks_cover_the_text(spark, n):
    text = "".join(chr(97 + i % 26) for i in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = sorted(chunks.fixed_chunks(df, "doc_id", "text").collect(), key=lambda r: r["pos"])
    joined = rows[0]["text"] + "".join(r["text"][100:] for r in rows[1:])
    assert joined == text
    assert all(len(r["text"]) <= 800 for r in rows)
    assert len(rows) == 1 or len(rows[-1]["text"]) > 100


@pytest.mark.parametrize("block_bytes", [1 << 20, 1000])
def test_nearest_equals_brute_force(spark, block_bytes):
    rng = np.random.default_rng(2)
    items = rng.integers(-3, 4, size=(300, 6)).astype(float)
    items[200:] = items[5]  # a third of the items are copies of one
    questions = rng.integers(-3, 4, size=(40, 6)).astype(float)
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(questions)], "id long, v array<double>")
    x = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(items)], "id long, v array<double>").repartition(9)
    out = retrieval.nearest(q, "id", "v", x, "id", "v", 4, block_bytes=block_bytes).collect()
    norms = np.linalg.norm(questions, axis=1)[:, None] * np.linalg.norm(items, axis=1)[None, :]
    scores = np.round(np.divide(questions @ items.T, norms, out=np.zeros_like(norms), where=norms > 0), 9)
    for i in range(len(questions)):
        best = sorted(range(len(items)), key=lambda j: (-scores[i, j], j))[:4]
        mine = sorted((r["rank"], r["item_id"]) for r in out if r["question_id"] == i)
        assert mine == list(enumerate(best, start=1))


def test_k_is_clamped(spark):
    v = spark.createDataFrame([(0, [1.0]), (1, [2.0])], "id long, v array<double>")
    assert retrieval.nearest(v, "id", "v", v, "id", "v", 99).count() == 4
    assert retrieval.nearest(v, "id", "v", v, "id", "v", 0).count() == 2


def test_equal_passages_appear_once_in_a_prompt(spark):
    hits = spark.createDataFrame([(1, 1, "b"), (1, 2, " b"), (1, 3, "a")], "question_id long, rank int, text string")
    questions = spark.createDataFrame([(1, "why?")], "id long, q string")
    row = retrieval.retrieval_prompts(hits, questions, "id", "q", "{context}|{question}").first()
    assert (row["prompt"], row["passages"]) == ("b\n\na|why?", 2)


def test_answer_prompts_from_text_to_prompt(spark):
    texts = ["apples are red", "the sky is blue", "apples grow on trees"]
    stored = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    asked = spark.createDataFrame([(7, "blue sky"), (8, "  ")], "id long, q string")

    def letters(batch):
        return [[float(t.count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for t in batch]

    out = retrieval.answer_prompts(asked, "id", "q", stored, "chunk_id", letters, 1).collect()
    assert len(out) == 1 and out[0]["context"] == "the sky is blue"


def test_hints_system_turns_and_questions_without_passages(spark):
    stored = spark.createDataFrame([(0, "apples are red"), (1, "the sky is blue")], "chunk_id long, text string")
    rows = [(7, " blue sky ", " red apples "), (8, "blue sky", " "), (9, "blue sky", None), (10, None, "red"), (None, "sky", None)]
    asked = spark.createDataFrame(rows, "id long, q string, h string")

    def letters(batch):
        return [[float(t.count(c)) for c in "abcdefghijklmnopqrstuvwxyz"] for t in batch]

    out = {r["id"]: r for r in retrieval.answer_prompts(asked, "id", "q", stored, "chunk_id", letters, 1, hint="h").collect()}
    assert set(out) == {7, 8, 9, None}
    assert (out[7]["context"], out[7]["searched_by"]) == ("apples are red", "hint") and "Question: blue sky\n" in out[7]["prompt"]
    assert {(out[n]["context"], out[n]["searched_by"]) for n in (8, 9)} == {("the sky is blue", "question")}
    assert [m["role"] for m in out[7]["messages"]] == ["system", "user"] and out[7]["messages"][1]["content"] == out[7]["prompt"]
    nothing = retrieval.answer_prompts(asked, "id", "q", stored.where("chunk_id > 5"), "chunk_id", letters, 3)
    assert {(r["id"], r["context"], r["passages"]) for r in nothing.collect()} == {(n, "", 0) for n in (7, 8, 9, None)}


def test_tokenizers(spark):
    df = spark.createDataFrame([(1, "a bb"), (2, "")], "id long, t string")
    out = {r["id"]: r["tokens"] for r in inference.tokenize(df, "id", "t", lambda t: [len(w) for w in t.split()]).collect()}
    assert out == {1: [1, 2], 2: []}
    counted = df.select(inference.token_counts(F.col("t"), lambda t: len(t.split())).alias("n")).collect()
    assert [r["n"] for r in counted] == [2, 0]


def test_tiles_search_exactly_and_in_bounded_memory():
    """Copies, ties, vectors of length zero and near misses; as whole products of double precision find them."""
    import tracemalloc

    draw = np.random.default_rng(4)
    items = retrieval._unit(draw.normal(size=(6000, 8)))
    items[1000:3000] = items[7]
    items[3000:3010] = items[7] + 1e-8 * draw.normal(size=(10, 8))
    items[5] = 0
    ids = draw.permutation(6000)
    questions = items[::5]
    expected = retrieval._better(retrieval._nothing(), questions, ids, items, 5, 9)
    tracemalloc.start()
    found = retrieval._search(questions, ids, items, 5, 9)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 << 20
    assert all((a == b).all() for a, b in zip(found[:2], expected[:2]))
    assert found[2] == pytest.approx(expected[2], abs=1e-9)


def test_small_tables_are_paired_by_all_cores(spark):
    v = spark.range(20_000).select("id", F.array(F.col("id") % 7).alias("vector"))
    banks, blocks = retrieval._blocks(v, v, 64 << 20)
    assert banks * blocks >= 2 * spark.sparkContext.defaultParallelism


def test_tokenizing_holds_few_texts_at_a_time(spark):
    """Each stretch of texts leaves as a batch of its own, and large keys stay exact beside missing ones."""
    df = spark.createDataFrame([(None if i == 3 else (1 << 60) + i, "a bc") for i in range(200)], "id long, t string").coalesce(1)
    out = inference.tokenize(df, "id", "t", lambda t: [len(w) for w in t.split()])
    assert {r["id"] for r in out.collect()} == {None if i == 3 else (1 << 60) + i for i in range(200)}
    assert "MapInArrow" in out._jdf.queryExecution().toString()
