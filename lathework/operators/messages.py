"""Build chat, preference and prompt rows from columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lathework.functions.params import require_any, resolve_alias
from lathework.functions.templates import render

MESSAGES = "array<struct<role:string,content:string>>"


def message(role: str | Column, content: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.cast("string").alias("role"), content.cast("string").alias("content"))


def no_messages() -> Column:
    return F.array().cast(MESSAGES)


@dataclass(frozen=True)
class Roles:
    """Canonical role names and the other names accepted for them."""

    user: str = "user"
    assistant: str = "assistant"
    system: str = "system"
    user_aliases: Sequence[str] = ()
    assistant_aliases: Sequence[str] = ()
    system_aliases: Sequence[str] = ()

    def canonical(self, role: Column) -> Column:
        """The canonical role; a name that is neither an alias nor canonical is returned as it is."""
        return (
            F.when(role.isin(list(self.user_aliases)), F.lit(self.user))
            .when(role.isin(list(self.assistant_aliases)), F.lit(self.assistant))
            .when(role.isin(list(self.system_aliases)), F.lit(self.system))
            .otherwise(role)
        )

    def known(self, role: Column) -> Column:
        return role.isin(self.user, self.assistant, self.system)


@dataclass(frozen=True)
class ChatSpec:
    """Which columns make a training row, and how."""

    prompt: str | None = None
    response: str | None = None
    prompt_aliases: Sequence[str] = ()
    response_aliases: Sequence[str] = ()
    prompt_template: str = ""
    conversation: str | None = None
    system_text: str = ""
    system_column: str | None = None
    system_aliases: Sequence[str] = ()
    system_template: str = ""
    roles: Roles = field(default_factory=Roles)
    null_text: str = ""  # what a NULL prompt or response becomes outside templates


def check_columns(columns: Iterable[str], spec: ChatSpec) -> None:
    """Refuse a table that lacks a needed column before any work is done."""
    if spec.conversation:
        require_any(columns, {"conversation": [spec.conversation]})
        return
    if not spec.response or not (spec.prompt or spec.prompt_template):
        raise ValueError("a response column and a prompt column or prompt template are needed")
    wanted: dict[str, list[str]] = {"response": [spec.response, *spec.response_aliases]}
    if not spec.prompt_template:
        wanted["prompt"] = [spec.prompt, *spec.prompt_aliases]
    require_any(columns, wanted)


def system_prompt(columns: Sequence[str], spec: ChatSpec) -> Column:
    """Template before column before fixed text. Aliases count only if a system column is named."""
    if spec.system_template:
        return render(spec.system_template, columns)
    name = resolve_alias(columns, spec.system_column, spec.system_aliases) if spec.system_column else None
    fixed = F.lit(spec.system_text)
    if name is None:
        return fixed
    given = F.col(f"`{name}`").cast("string")
    return F.when(F.coalesce(given, F.lit("")) != "", given).otherwise(fixed)


def _field(columns: Sequence[str], primary: str | None, aliases: Sequence[str], null_text: str) -> Column:
    name = resolve_alias(columns, primary, aliases)
    if name is None:
        return F.lit("")
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(null_text))


def qa_messages(columns: Sequence[str], spec: ChatSpec) -> Column:
    """One user and one assistant message."""
    if spec.prompt_template:
        prompt = render(spec.prompt_template, columns)
    else:
        prompt = _field(columns, spec.prompt, spec.prompt_aliases, spec.null_text)
    response = _field(columns, spec.response, spec.response_aliases, spec.null_text)
    return F.array(message(spec.roles.user, prompt), message(spec.roles.assistant, response))


def as_messages(conversation: Column, element: T.DataType) -> Column:
    """Structs or ``[role, content]`` pairs as structs; a pair of another length has a NULL role."""
    if isinstance(element, T.ArrayType):
        return F.transform(
            conversation,
            lambda pair: F.struct(
                F.when(F.size(pair) == 2, F.get(pair, F.lit(0))).alias("role"),
                F.get(pair, F.lit(1)).alias("content"),
            ),
        )
    return F.transform(
        conversation, lambda m: F.struct(m["role"].alias("role"), m["content"].cast("string").alias("content"))
    )


def normalize_conversation(conversation: Column, element: T.DataType, roles: Roles) -> tuple[Column, Column]:
    """The messages with canonical roles, and the reason to skip the row ('' if there is none)."""
    turns = F.transform(
        as_messages(conversation, element),
        lambda m: F.struct(
            roles.canonical(m["role"]).alias("role"), F.coalesce(m["content"], F.lit("")).alias("content")
        ),
    )
    bad = F.get(F.filter(turns, lambda m: m["role"].isNull() | ~roles.known(m["role"])), F.lit(0))
    reason = (
        F.when(conversation.isNull(), F.lit("conversation is not a list"))
        .when(bad.isNull(), F.lit(""))
        .when(bad["role"].isNull(), F.lit("message without a role"))
        .otherwise(F.concat(F.lit("unknown role: "), bad["role"]))
    )
    return turns, reason


def chat_rows(
    df: DataFrame,
    spec: ChatSpec,
    data_source: str,
    split: str | Column,
    index: str,
    preserve: Sequence[str] = (),
) -> DataFrame:
    """``data_source, messages, extra_info`` rows; a bad row has a ``skip_reason`` and no messages."""
    check_columns(df.columns, spec)
    system = system_prompt(df.columns, spec)
    opening = F.when(system != "", F.array(message(spec.roles.system, system))).otherwise(no_messages())
    if spec.conversation:
        element = df.schema[spec.conversation].dataType.elementType
        body, reason = normalize_conversation(F.col(f"`{spec.conversation}`"), element, spec.roles)
    else:
        body, reason = qa_messages(df.columns, spec), F.lit("")
    kept = [name for name in preserve if name in df.columns]
    split = F.lit(split) if isinstance(split, str) else split
    return df.withColumn("__reason", reason).select(
        F.lit(data_source).alias("data_source"),
        F.when(F.col("__reason") == "", F.concat(opening, body)).otherwise(no_messages()).alias("messages"),
        F.struct(
            split.alias("split"),
            F.col(index).alias("index"),
            F.col("__reason").alias("skip_reason"),
            *[F.col(f"`{name}`") for name in kept],
        ).alias("extra_info"),
    )


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("extra_info.skip_reason") == "")


def rejected(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("extra_info.skip_reason") != "")


def _named_turns(turns: DataFrame, role: str, content: str, roles: Roles) -> DataFrame:
    return turns.withColumn(role, roles.canonical(F.col(role))).withColumn(
        content, F.coalesce(F.col(content), F.lit(""))
    )


def _bad_turn(role: str, roles: Roles) -> Column:
    """The reason a turn is bad, NULL if it is good."""
    return F.when(F.col(role).isNull(), F.lit("message without a role")).when(
        ~roles.known(F.col(role)), F.concat(F.lit("unknown role: "), F.col(role))
    )


def normalize_turns(
    turns: DataFrame, conversation: str, turn: str, role: str, content: str, roles: Roles
) -> DataFrame:
    """The same rules on a table with one row per turn, so a conversation of any length stays spread.

    Adds ``skip_reason`` of the whole conversation: that of its first bad turn. Only bad turns are
    aggregated (with a map-side minimum), so the joined side holds bad conversations alone.
    """
    named = _named_turns(turns, role, content, roles)
    bad = named.withColumn("__bad", _bad_turn(role, roles)).where(F.col("__bad").isNotNull())
    reasons = bad.groupBy(F.col(conversation).alias("__conversation")).agg(F.min_by("__bad", turn).alias("skip_reason"))
    same = named[conversation].eqNullSafe(reasons["__conversation"])
    return (
        named.join(reasons, same, "left")
        .withColumn("skip_reason", F.coalesce(F.col("skip_reason"), F.lit("")))
        .drop("__conversation")
    )


def good_conversations(turns: DataFrame, conversation: str, role: str, roles: Roles) -> DataFrame:
    """Ids of the conversations without a bad turn: one map-side count, no join."""
    named = turns.select(conversation, roles.canonical(F.col(role)).alias(role))
    bad = named.groupBy(conversation).agg(F.count(_bad_turn(role, roles)).alias("__bad"))
    return bad.where(F.col("__bad") == 0).drop("__bad")


def instruction_format(layout: str, instruction: Column, extra: Column) -> Column:
    """One of the layouts in which an instruction and its input are put together."""
    has_extra = F.coalesce(extra, F.lit("")) != ""
    layouts = {
        "extra_first": F.concat(extra, F.lit("\n\n"), instruction),
        "extra_last": F.concat(instruction, F.lit("\n\n"), extra),
        "extra_next_line": F.concat(instruction, F.lit("\n"), extra),
    }
    if layout == "instruction_only":
        return instruction
    return F.when(has_extra, layouts[layout]).otherwise(instruction)


def tagged_rows(df: DataFrame, dataset: str, index: str, messages: Column) -> DataFrame:
    """``id, dataset, messages`` rows with the id ``dataset_index``."""
    return df.select(row_id(dataset, F.col(index)).alias("id"), F.lit(dataset).alias("dataset"), messages.alias("messages"))


def row_id(dataset: str, index: Column) -> Column:
    return F.concat_ws("_", F.lit(dataset), index.cast("string"))


def append_generation(prompts: Column, generations: Column) -> Column:
    """The first prompt of a nested list plus its first generation as the assistant's turn."""
    return F.concat(F.get(prompts, F.lit(0)), F.array(message("assistant", F.get(generations, F.lit(0)))))


def preference_triple(prompt: Column, chosen: Column, rejected_answer: Column) -> list[Column]:
    """The first message of the prompt, and the second of either answer."""
    return [
        F.slice(prompt, 1, 1).alias("prompt_messages"),
        F.slice(chosen, 2, 1).alias("chosen_messages"),
        F.slice(rejected_answer, 2, 1).alias("rejected_messages"),
    ]


def preference_filter(df: DataFrame, chosen_score: str, rejected_score: str, keep: str = "ties") -> DataFrame:
    """Keep rows whose scores tie, or (``keep="non_ties"``) those whose scores differ."""
    if keep not in ("ties", "non_ties"):
        raise ValueError("keep must be ties or non_ties")
    tie = F.col(chosen_score) == F.col(rejected_score)
    return df.where(tie if keep == "ties" else ~tie)


def retag(messages: Column, tags: Mapping[str, str], role_tag: str = "from", content_tag: str = "value") -> Column:
    """Messages with other field names and role tags."""
    pairs = F.create_map(*[F.lit(x) for pair in tags.items() for x in pair])
    return F.transform(
        messages,
        lambda m: F.struct(
            F.coalesce(F.try_element_at(pairs, m["role"]), m["role"]).alias(role_tag), m["content"].alias(content_tag)
        ),
    )


@dataclass(frozen=True)
class Layout:
    """How a conversation becomes one text: what stands before and after each message, by role.

    ``*`` serves the roles not named; ``{role}`` is replaced by the role. ``merge_system`` puts a system
    message in front of the user message it precedes, for models that know no system turn.
    """

    before: Mapping[str, str]
    after: Mapping[str, str]
    opening: str = ""
    merge_system: bool = False


# Public chat layouts.
CHAT_LAYOUTS = {
    "chat-ml": Layout({"*": "<|im_start|>{role}\n"}, {"*": "<|im_end|>\n"}),
    "simplified-llama31": Layout(
        {"*": "<|start_header_id|>{role}<|end_header_id|>\n\n"}, {"*": "<|eot_id|>"}, opening="<|begin_of_text|>"
    ),
    "mistral-with-system": Layout(
        {"user": "[INST] ", "*": " "}, {"user": " [/INST]", "*": "</s>"}, opening="<s>", merge_system=True
    ),
    "plain": Layout({"*": "{role}: "}, {"*": "\n"}),
}


def _by_role(texts: Mapping[str, str], role: Column) -> Column:
    def filled(text: str) -> Column:
        head, mark, tail = text.partition("{role}")
        return F.concat(F.lit(head), role, F.lit(tail)) if mark else F.lit(text)

    out = filled(texts.get("*", ""))
    for name, text in texts.items():
        if name != "*":
            out = F.when(role == name, filled(text)).otherwise(out)
    return out


def _with_system_merged(messages: Column) -> Column:
    """System texts in front of the next user turn, in order; those without one become a user turn of their own at the end."""
    turn = "struct<role: string, content: string>"
    start = F.struct(F.array().cast(f"array<{turn}>").alias("turns"), F.array().cast("array<string>").alias("waiting"))

    def step(state: Column, m: Column) -> Column:
        led = F.when(
            m["role"] == "user", F.array_join(F.concat(state["waiting"], F.array(m["content"])), "\n\n")
        ).otherwise(m["content"])
        is_system = F.coalesce(m["role"] == "system", F.lit(False))
        added = F.concat(state["turns"], F.array(F.struct(m["role"].alias("role"), led.alias("content"))))
        waiting = F.when(is_system, F.concat(state["waiting"], F.array(m["content"]))).otherwise(
            F.when(m["role"] == "user", F.array().cast("array<string>")).otherwise(state["waiting"])
        )
        return F.struct(
            F.when(is_system, state["turns"]).otherwise(added).alias("turns"), waiting.alias("waiting")
        )

    def finish(state: Column) -> Column:
        rest = F.struct(F.lit("user").alias("role"), F.array_join(state["waiting"], "\n\n").alias("content"))
        return F.when(F.size(state["waiting"]) > 0, F.concat(state["turns"], F.array(rest))).otherwise(state["turns"])

    return F.aggregate(messages, start, step, finish)


#: The layout that a model brings along itself.
KEEP_ORIGINAL = "keep-original"


def chat_text(messages: Column, layout: str | Layout = "chat-ml", own: Layout | None = None) -> Column:
    """All messages as one text in a named layout or the caller's.

    ``keep-original`` names the layout that the model brings along, ``own``; it is an error if there is none.
    """
    if layout == KEEP_ORIGINAL:
        if own is None:
            raise ValueError("keep-original needs the model's own layout")
        layout = own
    form = CHAT_LAYOUTS[layout] if isinstance(layout, str) else layout
    messages = F.transform(
        messages, lambda m: F.struct(m["role"].alias("role"), F.coalesce(m["content"], F.lit("")).alias("content"))
    )
    if form.merge_system:
        messages = _with_system_merged(messages)
    texts = F.transform(
        messages, lambda m: F.concat(_by_role(form.before, m["role"]), m["content"], _by_role(form.after, m["role"]))
    )
    return F.concat(F.lit(form.opening), F.array_join(texts, ""))


def judge_request(template: str, context: Column, answer: Column) -> Column:
    """Step one: ask for an explanation."""
    return F.array(message("user", render(template, {"context": context, "answer": answer})))


def judge_followup(request: Column, explanation: Column, grade_request: str) -> Column:
    """Step two: the explanation as the assistant's turn, then the request for a grade."""
    return F.concat(request, F.array(message("assistant", explanation), message("user", F.lit(grade_request))))
