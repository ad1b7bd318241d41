"""Properties of the physical plans that matter at scale."""

from __future__ import annotations

import re

import pytest

from __spark_entry__ import queries

KNOWN = queries()


def plan(spark, folder, name):
    return KNOWN[name](spark, folder)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["knn_topk", "scenario_grid", "softmax_scores", "embedding_prf", "score_histogram", "attach_gold"])
def test_no_cross_join(spark, sf_small, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(spark, sf_small, name))


def test_filters_and_columns_reach_the_scan(spark, sf_small):
    text = plan(spark, sf_small, "filter_kind")
    assert "EqualTo(role,user)" in text and "ReadSchema: struct<conv_id:bigint,turn:bigint,role:string,text:string>" in text
    text = plan(spark, sf_small, "threshold_hits")
    assert "GreaterThan(l_discount,0.08)" in text and "l_extendedprice" not in text
    assert "text" not in plan(spark, sf_small, "ratio_split").split("ReadSchema")[1]


@pytest.mark.parametrize("name", ["qa_to_messages", "render_template", "chat_template_render", "grade_extract", "judge_messages", "clip_rescale"])
def test_projections_shuffle_nothing_and_run_no_python(spark, sf_small, name):
    assert not re.search("Exchange|Python|MapInPandas", plan(spark, sf_small, name))


@pytest.mark.parametrize("name,most", [("rank_average", 1), ("dice_by_case", 1), ("weighted_mean", 1), ("keyword_score", 1), ("before_after", 1)])
def test_one_shuffle_per_aggregation(spark, sf_small, name, most):
    assert plan(spark, sf_small, name).count("Exchange hashpartitioning") <= most


def test_text_is_not_shuffled_for_bleu(spark, sf_small):
    spark_plan = plan(spark, sf_small, "corpus_bleu")
    shuffles = re.findall(r"Exchange hashpartitioning\(([^)]*)", spark_plan)
    assert len(shuffles) == 1 and "lang" in shuffles[0]


def test_unordered_windows_see_only_summaries(spark, sf_small):
    """A window without partition keys may order bucket or partition summaries, never rows."""
    for name in ("ratio_split", "extra_info", "row_ids", "batch_ids", "even_shards"):
        for order in re.findall(r"windowspecdefinition\(([^)]*)", plan(spark, sf_small, name)):
            first = order.split(",")[0].strip()
            if re.search("ASC|DESC", first):  # no partition key before the order
                assert re.match("__(bucket|part)#", first), (name, order)
