from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lathework.operators import inference, scoring

P = ["Seven otters built a dam.", "Rain fell all night."]


def bleu(spark, predictions, references):
    df = spark.createDataFrame(list(zip(range(len(predictions)), predictions, references)), "id int, p string, r array<string>")
    return scoring.bleu_from_counts(scoring.bleu_counts(df, "id", "p", "r")).first()["bleu"]


def plain_bleu(predictions, references):
    match, possible, p_len, r_len = [0] * 4, [0] * 4, 0, 0
    for p, refs in zip(predictions, references):
        p_len += len(p)
        r_len += min(len(r) for r in refs)
        for n in range(1, 5):
            grams = [Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in [p, *refs]]
            most = Counter()
            for g in grams[1:]:
                most |= g
            match[n - 1] += sum((grams[0] & most).values())
            possible[n - 1] += max(len(p) - n + 1, 0)
    if min(match) == 0:
        return 0.0
    score = math.exp(sum(math.log(m / q) for m, q in zip(match, possible)) / 4)
    return score * (1 if p_len > r_len else math.exp(1 - r_len / p_len))


def test_exact_match_is_a_fraction(spark):
    df = spark.createDataFrame([("Seven OTTERS built a dam", P[0]), ("Rain fell all night.", "Rain fell at noon.")], "p string, r string")
    assert df.agg(F.avg(scoring.exact_match(F.col("p"), F.col("r")))).first()[0] == 0.5
    strict = scoring.exact_match(F.col("p"), F.col("r"), ignore_case=False)
    assert df.agg(F.avg(strict)).first()[0] == 0.0


def test_bleu_constants(spark):
    assert bleu(spark, P, [[t] for t in P]) == pytest.approx(1.0)
    assert bleu(spark, P, [["Seven otters built a raft."], ["Rain fell at noon."]]) < 1.0
    assert bleu(spark, ["a b"], [["c d"]]) == 0.0


def test_bleu_against_a_plain_count(spark):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(list("abcd"), size=rng.integers(0, 30))) for _ in range(60)]
    refs = [[" ".join(rng.choice(list("abcd"), size=rng.integers(1, 30))) for _ in range(rng.integers(1, 4))] for _ in texts]
    expected = plain_bleu([t.split() for t in texts], [[r.split() for r in group] for group in refs])
    assert bleu(spark, texts, refs) == pytest.approx(expected)


def test_embedding_match(spark):
    df = spark.createDataFrame(
        [([[1.0, 0.0], [0.0, 2.0]], [[3.0, 0.0]]), ([[1.0, 0.0]], [[-1.0, 0.0]]), ([[1.0, 0.0]], [])],
        "p array<array<double>>, r array<array<double>>",
    )
    out = [(r["precision"], r["recall"], r["f1"]) for r in scoring.embedding_match(df, "p", "r").collect()]
    assert out[0] == pytest.approx((0.5, 1.0, 2 / 3))
    assert out[1] == (0.0, 0.0, 0.0) and out[2] == (0.0, 0.0, 0.0)


def test_embedding_match_of_long_texts_in_bounded_memory():
    """20,000 tokens a side: 3.2 GB of similarities, of which 8 MB are held at a time."""
    import tracemalloc

    draw = np.random.default_rng(3)
    p, r = draw.normal(size=(20_000, 4)), draw.normal(size=(20_000, 4))
    tracemalloc.start()
    found = scoring.greedy_scores(p, r)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 << 20
    assert all(0.9 < x <= 1.0 for x in found)
    some = scoring.greedy_scores(p[:300], r[:200], block=7)
    cosine = (p[:300] / np.linalg.norm(p[:300], axis=1)[:, None]) @ (r[:200] / np.linalg.norm(r[:200], axis=1)[:, None]).T
    assert some[:2] == pytest.approx((cosine.max(axis=1).mean(), cosine.max(axis=0).mean()))


def test_clamp(spark):
    from lathework.functions.text import clamp_at_zero

    values = [float(v) for v in np.random.default_rng(0).uniform(-100, 100, 1000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r[0] for r in df.select(clamp_at_zero(F.col("v"))).collect()] == [max(v, 0.0) for v in values]


def test_histogram_matches_numpy(spark):
    values = [float(v) for v in np.random.default_rng(4).normal(size=500)]
    out = scoring.histogram(spark.createDataFrame([(v,) for v in values], "v double"), "v").orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=20)
    assert [r["count"] for r in out] == list(counts)
    assert [r["bin_start"] for r in out] == pytest.approx(list(edges[:-1]))
    assert out[0]["mean"] == pytest.approx(np.mean(values))


def test_histogram_of_one_value(spark):
    out = scoring.histogram(spark.createDataFrame([(2.0,)] * 3, "v double"), "v").orderBy("bin").collect()
    counts, edges = np.histogram([2.0] * 3, bins=20)
    assert [r["count"] for r in out] == list(counts)
    assert out[-1]["bin_end"] == pytest.approx(edges[-1])


def test_softmax_forms_agree(spark):
    data = [(i, c, float((i * c) % 7) / 10) for i in range(20) for c in range(5)]
    df = spark.createDataFrame(data, "item int, c int, s double")
    far = spark.createDataFrame([(0, -900.0), (0, 3.0), (0, 2.0), (1, -900.0)], "item int, s double")
    probabilities = {(r["item"], r["s"]): r["probability"] for r in scoring.softmax_rows(far, ["item"], "s").collect()}
    assert probabilities[0, 3.0] == pytest.approx(1 / (1 + math.exp(-1))) and probabilities[1, -900.0] == pytest.approx(1.0)
    rows = scoring.softmax_rows(df, ["item"], "s", 100.0)
    for r in rows.collect():
        mine = np.array([s for i, _, s in data if i == r["item"]]) * 100
        p = np.exp(mine - mine.max())
        assert r["probability"] == pytest.approx(p[r["c"]] / p.sum())
        assert r["is_top"] == (r["s"] * 100 == mine.max())
    array = df.groupBy("item").agg(F.array_sort(F.collect_list("s")).alias("a")).select(scoring.softmax(F.col("a"), 100.0).alias("p"))
    assert all(sum(r["p"]) == pytest.approx(1.0) for r in array.collect())


def test_several_gold_answers(spark):
    df = spark.createDataFrame([(["a"],), (["a", "b"],)], "g array<string>")
    assert [r[0] for r in df.select(scoring.single_gold(F.col("g"), strict=False)).collect()] == ["a", None]
    with pytest.raises(Exception, match="Multiple correct answers"):
        df.select(scoring.single_gold(F.col("g"))).collect()


def test_model_failures_become_values(spark):
    def call(messages):
        if messages[0]["content"] == "bad":
            raise RuntimeError("the line is busy")
        return messages[0]["content"].upper()

    df = spark.createDataFrame([(0, [("user", "ok")]), (1, [("user", "bad")])], "id int, m array<struct<role:string,content:string>>")
    for workers in (1, 4):
        out = {r["id"]: r["llm_inference"] for r in inference.batch_infer(df, call, "m", batch_size=1, workers=workers).collect()}
        assert out == {0: "OK", 1: "**ERROR**: the line is busy"}


def test_retry():
    calls, pauses = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError("down")
        return "up"

    assert inference.with_retry(flaky, tries=5, delay=1, sleep=pauses.append)() == "up"
    assert pauses == [1, 2]
    calls.clear()
    with pytest.raises(OSError):
        inference.with_retry(flaky, tries=2, sleep=pauses.append)()
    calls.clear()
    with pytest.raises(OSError):
        inference.with_retry(flaky, fatal=lambda e: True, sleep=pauses.append)()
    assert len(calls) == 1


def test_judge_summary_takes_the_last_judgement(spark):
    candidates = spark.range(4)
    judged = spark.createDataFrame([(0, 1, 3), (0, 2, 9), (1, 1, 5)], "id long, seq int, g int")
    row = inference.judge_summary(candidates, judged, "id", "g", ["seq"]).first()
    assert tuple(row) == (7.0, 4, 2, 2)


def test_before_after_and_weighted_mean(spark):
    df = spark.createDataFrame([(0, "before", 1.0), (0, "after", 3.0), (1, "before", 1.0)], "i int, phase string, s double")
    out = {r["i"]: r["change"] for r in scoring.before_after(df, ["i"], "phase", "s").collect()}
    assert out == {0: 2.0, 1: None}
    means = spark.createDataFrame([(1.0, 1), (float("nan"), 5), (4.0, 2)], "v double, n int")
    assert tuple(scoring.weighted_mean(means, "v", "n").first()) == (3, 3.0)


def test_inference_rows_count_the_subset_after_the_filter(spark):
    df = spark.createDataFrame([(i, "w " * (i % 4 + 1), f"g{i}") for i in range(12)], "n int, doc string, gold string")
    rows = inference.inference_rows(df, lambda m: m[0]["content"].strip(), "{context}", "doc", "gold", ["n"], max_tokens=2, subset=3)
    found = {r["context_document_id"]: (r["llm_inference"], r["gold_standard_result"]) for r in rows.collect()}
    assert found == {"0": ("w", ["g0"]), "1": ("w w", ["g1"]), "4": ("w", ["g4"])}
    assert set(rows.columns) == {
        "llm_inference", "gold_standard_result", "context_document_id", "context_document", "prompt_template",
    }


def test_metric_summary(spark):
    data = [("0", P[0], [P[0]]), ("1", P[1], [P[1]]), ("2", "**ERROR**: x", ["y"])]
    df = spark.createDataFrame(data, "context_document_id string, llm_inference string, gold_standard_result array<string>")
    assert tuple(scoring.metric_summary(df, on_error="drop").first()) == (1.0, 1.0)
    assert scoring.metric_summary(df).first()["exact_match"] == 0.6667
    with pytest.raises(ValueError):
        scoring.metric_summary(df, on_error="keep")


def test_missing_answers_and_references_score_as_empty(spark):
    rows = [(1, None, ["a b c d e"]), (2, "a b c d e", ["a b c d e"]), (3, "a", None), (4, "a", [None])]
    df = spark.createDataFrame(rows, "id int, p string, r array<string>")
    counts = {r["id"]: r for r in scoring.bleu_counts(df, "id", "p", "r").collect()}
    assert counts[1]["prediction_length"] == 0 and counts[1]["reference_length"] == 5
    assert counts[2]["match_4"] == 2 and counts[3]["reference_length"] == counts[4]["reference_length"] == 0


def test_softmax_keeps_rows_without_an_item(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 1.0), (None, 1.0)], "item string, s double")
    found = sorted(r["probability"] for r in scoring.softmax_rows(df, ["item"], "s").collect())
    assert found == pytest.approx([0.5, 0.5, 1.0])


def test_only_the_request_goes_through_the_model_call(spark):
    rows = [(9007199254740993, "x"), (None, "y"), (3, None)]
    df = spark.createDataFrame(rows, "id long, q string")
    out = inference.batch_infer(df, lambda q: str(q), "q").where("llm_inference is not null")
    assert {r["id"] for r in out.collect()} == {9007199254740993, None, 3}
    assert out._jdf.queryExecution().toString().split("Physical Plan")[1].count("ArrowEvalPython") == 1


def test_embedding_is_called_once_and_never_with_a_missing_text(spark):
    df = spark.createDataFrame([("x",), (None,), ("yy",)], "t string")
    out = inference.embed(df, "t", lambda texts: [[len(t)] for t in texts], batch_size=1)
    assert sorted(r["embedding"] or [] for r in out.collect()) == [[], [1.0], [2.0]]
    plan = out.where("embedding is not null")._jdf.queryExecution().toString().split("Physical Plan")[1]
    assert plan.count("ArrowEvalPython") == 1


def test_bleu_counts_in_stretches_hold_no_token_as_an_object(monkeypatch):
    """400,000 tokens a side: fewer objects than tokens, and the counts of stretches are those of the whole."""
    import tracemalloc

    import pyarrow as pa

    draw = np.random.default_rng(6)
    texts = [[str(w) for w in draw.integers(0, 900, size=n)] for n in (0, 3, 200_000, 1, 0, 199_996)]
    prediction = pa.array(texts, pa.list_(pa.string()))
    references = pa.array([[t[::-1], t[:5]] if t else [] for t in texts], pa.list_(pa.list_(pa.string())))
    whole = scoring._matches_of(prediction, references)
    count = scoring._clipped_matches.func
    tracemalloc.start()
    assert count(prediction, references).to_pylist() == [dict(zip(("match_1", "match_2", "match_3", "match_4"), row)) for row in whole.tolist()]
    assert tracemalloc.get_traced_memory()[1] < 80 << 20
    tracemalloc.stop()
    monkeypatch.setattr(scoring, "_SLICE_TOKENS", 5)
    assert [list(r.values()) for r in count(prediction[1:], references[1:]).to_pylist()] == whole[1:].tolist()


def test_requests_become_objects_a_few_at_a_time():
    import pyarrow as pa

    batch = pa.array(["x"] * 1000)
    parts = inference._stretches(batch, 64)
    assert len(next(parts)) == 64 and sum(map(len, parts)) == 936
