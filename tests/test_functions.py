from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lathework.functions import params
from lathework.functions import text as X
from lathework.functions.templates import placeholders, render


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_name_lists():
    assert params.name_list("a, b  c,,") == ["a", "b", "c"]
    assert params.name_list(None) == []
    assert params.field_list(["a b, c", ""]) == ["a b", "c"]


def test_percentages():
    assert params.percentages("80,10 10") == pytest.approx([0.8, 0.1, 0.1])
    assert params.percentages("0.5 0.5") == [0.5, 0.5]
    for bad in ("", "a", "-1 2", "0.5 0.4", "60 60"):
        with pytest.raises(ValueError):
            params.percentages(bad)


def test_share_mapping():
    assert params.share_mapping('{"train": 0.9, "test": 0.1}') == {"train": 0.9, "test": 0.1}
    assert params.share_mapping("train:0.9,test:0.1") == {"train": 0.9, "test": 0.1}
    assert params.share_mapping(" ") == {}
    with pytest.raises(ValueError):
        params.share_mapping("train")


def test_required_columns_take_any_candidate():
    params.require_any(["a", "b"], {"prompt": ["x", "b"]})
    with pytest.raises(ValueError, match="prompt"):
        params.require_any(["a"], {"prompt": ["x", "y"]})


def test_alias_is_chosen_by_schema():
    assert params.resolve_alias(["b", "c"], "a", ["c", "b"]) == "c"
    assert params.resolve_alias(["a"], "a", ["a"]) == "a"
    assert params.resolve_alias([], "a") is None


def test_template(spark):
    df = spark.createDataFrame([("x", None, 3)], "a string, b string, c int")
    row = df.select(render("{a}-{b}-{c}-{d} {a}", df.columns).alias("t"), render("", df.columns).alias("e")).first()
    assert tuple(row) == ("x--3-{d} x", "")
    assert placeholders("{a} {b}") == ["a", "b"]


def test_template_does_not_substitute_twice(spark):
    df = spark.createDataFrame([("{b}", "y")], "a string, b string")
    assert df.select(render("{a}", df.columns)).first()[0] == "{b}"


def test_durations(spark):
    texts = ["0m18.236s", "1h2m3.4s", "5s", "2m", "1.23456s", "none"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    found = [r[0] for r in df.select(X.duration_seconds(F.col("t"))).collect()]
    assert found == pytest.approx([18.236, 3723.4, 5, 120, 1.234, 0])
    shown = one(spark, *[X.duration_text(F.lit(v).cast("double")) for v in (59.5, 61.25, 0.0, None, float("nan"))])
    assert shown == ("0m59.50s", "1m1.25s", "0m0.00s", "N/A", "N/A")


def test_grades(spark):
    answers = ["x Grade: [[7]] Grade: [[2]]", "Grade: [[10]]", "Grade: [[11]]", "Rating: [[5]]", None]
    df = spark.createDataFrame([(a,) for a in answers], "a string")
    assert [r[0] for r in df.select(X.grade(F.col("a"))).collect()] == [7, 10, None, None, None]


def test_slug_and_numbers(spark):
    row = one(
        spark,
        X.slug(F.lit("http://a.b/c d")),
        X.last_segment(F.lit("org/model")),
        X.millions_text(F.lit(2_340_000)),
        X.rescale(F.lit(5.0), 0, 4, 0, 1),
        X.clamp_at_zero(F.lit(-0.5)),
    )
    assert row == ("http___a_b_c_d", "model", "2.34M", 1.0, 0.0)


def test_metric_tokens(spark):
    cases = {
        "This is a test prediction.": ["This", "is", "a", "test", "prediction", "."],
        "1,000.5 a,b 3-4 x-y": ["1,000.5", "a", ",", "b", "3", "-", "4", "x-y"],
        "a-\nb\nc &quot;d&amp;": ["ab", "c", '"', "d", "&"],
        "it's [ok]..": ["it's", "[", "ok", "]", ".", "."],
    }
    for text, tokens in cases.items():
        assert one(spark, X.metric_tokens(F.lit(text)))[0] == tokens


def test_strip_takes_all_blanks(spark):
    assert one(spark, X.strip(F.lit("\n\t a \r\n")))[0] == "a"


def test_every_unicode_blank_trims_and_splits(spark):
    text = "  a b 　c "
    assert one(spark, X.strip(F.lit(text)), X.word_count(F.lit(text))) == ("a b 　c", 3)
    assert one(spark, X.strip(F.lit("   ")))[0] == ""


def test_shares_of_a_mapping_are_checked():
    assert params.share_mapping({"a": 75, "b": 25}) == {"a": 0.75, "b": 0.25}
    for bad in ('{"a": 0.5}', "a:-1,b:2", "a:x,b:1"):
        with pytest.raises(ValueError):
            params.share_mapping(bad)
