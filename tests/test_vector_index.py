"""The inverted-file index against exact search."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lathework.operators import retrieval, vector_index


def pairs(hits):
    return {(r["question_id"], r["item_id"]) for r in hits.collect()}


def table(spark, vectors):
    return spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "id long, v array<double>").repartition(5)


def clustered(seed, count, dim, clusters):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(clusters, dim))
    return (centres[draw.integers(clusters, size=count)] + 0.2 * draw.normal(size=(count, dim))).tolist()


@pytest.mark.parametrize("cosine", [True, False])
def test_recall_on_clusters_with_few_probes(spark, cosine):
    items = table(spark, clustered(1, 3000, 16, 40))
    index = vector_index.build_index(items, "id", "v", cosine=cosine)
    asked = items.where("id % 20 = 0")
    found = pairs(vector_index.search_index(index, asked, "id", "v", 10))
    exact = pairs(retrieval.nearest(asked, "id", "v", items, "id", "v", 10, cosine=cosine))
    assert len(index.centroids) == 54 and index.probes < 20
    assert index.items.count() == 3000
    assert len(found & exact) >= 0.9 * len(exact) and len(found) == len(exact)


def test_recall_without_clusters(spark):
    items = table(spark, np.random.default_rng(2).normal(size=(1500, 24)).tolist())
    index = vector_index.build_index(items, "id", "v")
    asked = items.where("id % 20 = 0")
    found = pairs(vector_index.search_index(index, asked, "id", "v", 10))
    exact = pairs(retrieval.nearest(asked, "id", "v", items, "id", "v", 10))
    assert index.recall >= 0.95 and len(found & exact) >= 0.9 * len(exact)


def test_all_probes_are_exact_with_ties_and_parts(spark):
    """A third of the items are equal, and lists are cut into parts of a few rows."""
    vectors = clustered(3, 600, 6, 5)
    vectors = [vectors[0] if i % 3 == 0 else v for i, v in enumerate(vectors)] + [[0.0] * 6]
    items = table(spark, vectors)
    index = vector_index.build_index(items, "id", "v", lists=7, part_rows=20)
    assert index.parts.agg(F.max("parts")).first()[0] >= 10
    asked = items.where("id % 20 = 0 or id = 600")
    found = vector_index.search_index(index, asked, "id", "v", 5, probes=7).orderBy("question_id", "rank")
    exact = retrieval.nearest(asked, "id", "v", items, "id", "v", 5).orderBy("question_id", "rank")
    assert [tuple(r) for r in found.collect()] == [tuple(r) for r in exact.collect()]


def test_items_without_vectors_and_few_rows(spark):
    schema = "id long, v array<double>"
    none = spark.createDataFrame([(1, None)], schema)
    asked = spark.createDataFrame([(7, [1.0, 0.0]), (8, None)], schema)
    assert vector_index.search_index(vector_index.build_index(none, "id", "v"), asked, "id", "v", 3).count() == 0
    one = spark.createDataFrame([(1, None), (2, [2.0, 0.0])], schema)
    hits = vector_index.search_index(vector_index.build_index(one, "id", "v"), asked, "id", "v", 3).collect()
    assert [tuple(r) for r in hits] == [(7, 2, 1.0, 1)]


def test_the_plan_pairs_lists_only(spark):
    items = table(spark, clustered(4, 2000, 8, 30))
    index = vector_index.build_index(items, "id", "v")
    hits = vector_index.search_index(index, items.where("id % 20 = 0"), "id", "v", 10)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|NestedLoop|FlatMapCoGroups", plan)
    assert "dynamicpruning" in plan.lower()
    assert "WindowGroupLimit" in plan
