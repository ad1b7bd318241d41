from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lathework.operators import messages as M

ROLES = M.Roles(user_aliases=["human"], assistant_aliases=["gpt"])


def run(df, spec, **kwargs):
    rows = M.chat_rows(df, spec, "src", "train", "i", **kwargs)
    return [([tuple(m) for m in r["messages"]], r["extra_info"].asDict()) for r in rows.collect()]


def test_structs_pairs_and_bad_rows(spark):
    schema = "i int, c array<struct<role:string,content:string>>"
    data = [(0, [("human", "hi"), ("gpt", None)]), (1, [(None, "x")]), (2, [("robot", "x")]), (3, None), (4, [])]
    out = run(spark.createDataFrame(data, schema), M.ChatSpec(conversation="c", roles=ROLES))
    assert out[0][0] == [("user", "hi"), ("assistant", "")]
    reasons = [info["skip_reason"] for _, info in out]
    assert reasons == ["", "message without a role", "unknown role: robot", "conversation is not a list", ""]
    assert all(messages == [] for messages, _ in out[1:])
    pairs = spark.createDataFrame([(0, [["human", "hi"], ["gpt", "yo"]]), (1, [["human"]])], "i int, c array<array<string>>")
    out = run(pairs, M.ChatSpec(conversation="c", roles=ROLES))
    assert out[0][0] == [("user", "hi"), ("assistant", "yo")]
    assert out[1][1]["skip_reason"] == "message without a role"


def test_system_turn_is_added_before_the_conversation_keeps_its_own(spark):
    df = spark.createDataFrame([(0, [("system", "own"), ("user", "q")])], "i int, c array<struct<role:string,content:string>>")
    out = run(df, M.ChatSpec(conversation="c", system_text="fixed"))
    assert [c for _, c in out[0][0]] == ["fixed", "own", "q"]


def test_question_answer_columns_and_extra_info(spark):
    df = spark.createDataFrame([(0, "q", None, 5)], "i int, ask string, reply string, score int")
    spec = M.ChatSpec("prompt", "reply", prompt_aliases=["ask"])
    messages, info = run(df, spec, preserve=["score", "absent"])[0]
    assert messages == [("user", "q"), ("assistant", "")]
    assert info == {"split": "train", "index": 0, "skip_reason": "", "score": 5}
    as_text = run(df, M.ChatSpec("ask", "reply", null_text="None"))[0][0]
    assert as_text[1] == ("assistant", "None")


def test_missing_columns_are_refused():
    with pytest.raises(ValueError, match="prompt"):
        M.check_columns(["reply"], M.ChatSpec("ask", "reply"))
    M.check_columns(["reply"], M.ChatSpec(response="reply", prompt_template="x"))
    with pytest.raises(ValueError):
        M.check_columns(["a"], M.ChatSpec(conversation="c"))
    with pytest.raises(ValueError):
        M.check_columns(["a"], M.ChatSpec(prompt="a"))


def test_turn_tables_follow_the_same_rules(spark):
    data = [(0, 0, "human", "a"), (0, 1, "gpt", None), (1, 0, "human", "b"), (1, 1, "robot", "c"), (1, 2, None, "d")]
    df = spark.createDataFrame(data, "conv int, turn int, role string, text string")
    out = {(r["conv"], r["turn"]): r for r in M.normalize_turns(df, "conv", "turn", "role", "text", ROLES).collect()}
    assert out[0, 1]["text"] == "" and out[0, 1]["role"] == "assistant"
    assert {out[0, t]["skip_reason"] for t in (0, 1)} == {""}
    assert {out[1, t]["skip_reason"] for t in (0, 1, 2)} == {"unknown role: robot"}


def test_preferences(spark):
    df = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "a double, b double")
    assert M.preference_filter(df, "a", "b").count() == 1
    assert M.preference_filter(df, "a", "b", "non_ties").first()["b"] == 2.0
    with pytest.raises(ValueError):
        M.preference_filter(df, "a", "b", "all")


def test_instruction_layouts(spark):
    row = spark.range(1).select(
        *[M.instruction_format(layout, F.lit("do"), F.lit(extra)) for layout in ("extra_first", "extra_last", "extra_next_line") for extra in ("it", "", None)],
        M.instruction_format("instruction_only", F.lit("do"), F.lit("it")),
    ).first()
    assert list(row) == ["it\n\ndo", "do", "do", "do\n\nit", "do", "do", "do\nit", "do", "do", "do"]


def test_accepted_and_rejected_rows(spark):
    schema = "i int, c array<struct<role:string,content:string>>"
    df = spark.createDataFrame([(0, [("user", "a")]), (1, [("robot", "b")])], schema)
    rows = M.chat_rows(df, M.ChatSpec(conversation="c"), "src", "train", "i")
    assert [r["extra_info"]["index"] for r in M.accepted(rows).collect()] == [0]
    assert [r["extra_info"]["index"] for r in M.rejected(rows).collect()] == [1]


def test_layouts(spark):
    df = spark.createDataFrame([([("system", "s"), ("user", "q"), ("assistant", "a"), ("user", "r")],)], "m array<struct<role:string,content:string>>")
    own = M.Layout({"user": "U:", "*": "{role}>"}, {"*": ";"}, opening="^")
    row = df.select(*[M.chat_text(F.col("m"), layout) for layout in ("mistral-with-system", own)]).first()
    assert tuple(row) == ("<s>[INST] s\n\nq [/INST] a</s>[INST] r [/INST]", "^system>s;U:q;assistant>a;U:r;")
    assert set(M.CHAT_LAYOUTS) >= {"chat-ml", "mistral-with-system", "simplified-llama31"}


def test_no_turn_is_lost_in_any_layout(spark):
    turns = [("system", "s1"), ("system", "s2"), ("user", "u"), ("assistant", None), ("system", "late")]
    df = spark.createDataFrame([(turns,)], "m array<struct<role: string, content: string>>")
    merged = df.select(M.chat_text(F.col("m"), "mistral-with-system")).first()[0]
    assert merged == "<s>[INST] s1\n\ns2\n\nu [/INST] </s>[INST] late [/INST]"
    assert df.select(M.chat_text(F.col("m"), "plain")).first()[0].count("\n") == 5


def test_bad_turn_without_a_conversation_id(spark):
    df = spark.createDataFrame([(None, 1, "wizard", "x"), (1, 1, "user", "y")], "c int, t int, role string, content string")
    found = {r["c"]: r["skip_reason"] for r in M.normalize_turns(df, "c", "t", "role", "content", M.Roles()).collect()}
    assert found[None].startswith("unknown role") and found[1] == ""


def test_keep_original_takes_the_models_own_layout(spark):
    df = spark.createDataFrame([([("user", "hi"), ("assistant", "yo")],)], "m array<struct<role: string, content: string>>")
    own = M.Layout({"*": "<{role}>"}, {"*": "</s>"}, opening="^")
    assert df.select(M.chat_text(F.col("m"), M.KEEP_ORIGINAL, own)).first()[0] == "^<user>hi</s><assistant>yo</s>"
    with pytest.raises(ValueError):
        M.chat_text(F.col("m"), M.KEEP_ORIGINAL)
