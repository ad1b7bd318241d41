"""Queries: building, filtering, splitting and mixing training rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.functions.templates import render
from lathework.functions.text import word_count, words
from lathework.operators import messages as M
from lathework.operators import datasets, mixing, packs, records, splits
from lathework.operators.ordering import with_row_index
from lathework.plans.registry import query, table
from lathework.session import materialize

ROLES = M.Roles(user_aliases=["human"], assistant_aliases=["gpt", "bot"], system_aliases=["developer"])


def exploded(df: DataFrame, key: str, messages: str = "messages") -> DataFrame:
    """Messages as scalar rows."""
    return df.select(key, F.posexplode(messages).alias("pos", "m")).select(key, "pos", "m.role", "m.content")


@query(
    "qa_to_messages",
    """
    SELECT doc_id, 0 AS pos, 'system' AS role, 'Answer in full.' AS content FROM documents
    UNION ALL SELECT doc_id, 1, 'user', source FROM documents
    UNION ALL SELECT doc_id, 2, 'assistant', text FROM documents
    """,
)
def qa_to_messages(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    spec = M.ChatSpec(prompt="source", response="text", system_text="Answer in full.")
    rows = M.chat_rows(docs, spec, "documents", "train", "doc_id")
    return exploded(rows.select(F.col("extra_info.index").alias("doc_id"), "messages"), "doc_id")


def raw_turns(spark: SparkSession, folder: str) -> DataFrame:
    """Turns with other role names in some conversations and an unknown role in others."""
    role = F.when((F.col("role") == "user") & (F.col("conv_id") % 3 == 0), "human").when(
        (F.col("role") == "assistant") & (F.col("conv_id") % 17 == 0) & (F.col("turn") > 1), "tool"
    )
    return table(spark, folder, "conversations").withColumn("role", F.coalesce(role, F.col("role")))


_TURNS = """
    raw AS (SELECT conv_id, turn, text, CASE WHEN role = 'user' AND conv_id % 3 = 0 THEN 'human'
                   WHEN role = 'assistant' AND conv_id % 17 = 0 AND turn > 1 THEN 'tool' ELSE role END AS role
            FROM conversations),
    named AS (SELECT conv_id, turn, text AS content, CASE WHEN role = 'human' THEN 'user' WHEN role IN ('gpt', 'bot')
                     THEN 'assistant' WHEN role = 'developer' THEN 'system' ELSE role END AS role FROM raw),
    bad AS (SELECT conv_id, 'unknown role: ' || arg_min(role, turn) AS skip_reason FROM named
            WHERE role NOT IN ('user', 'assistant', 'system') GROUP BY conv_id)
"""


@query(
    "normalize_roles",
    f"""
    WITH {_TURNS}
    SELECT n.conv_id, n.turn, n.role, n.content, coalesce(b.skip_reason, '') AS skip_reason
    FROM named n LEFT JOIN bad b USING (conv_id)
    """,
)
def normalize_roles(spark: SparkSession, folder: str) -> DataFrame:
    turns = raw_turns(spark, folder).withColumnRenamed("text", "content")
    return M.normalize_turns(turns, "conv_id", "turn", "role", "content", ROLES).select(
        "conv_id", "turn", "role", "content", "skip_reason"
    )


def line_conversations(docs: DataFrame) -> DataFrame:
    """Each document's lines as turns; some lines get an unknown role, empty ones none."""
    turns = F.transform(
        F.split("text", "\n"),
        lambda line, i: F.struct(
            F.when(F.length(line) == 0, F.lit(None).cast("string"))
            .when(F.length(line) % 97 == 13, "tool")
            .when(i % 2 == 0, "human")
            .otherwise("gpt")
            .alias("role"),
            line.alias("content"),
        ),
    )
    return docs.withColumn("conversation", turns)


@query(
    "quarantine_reasons",
    r"""
    WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
                          generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    bad AS (SELECT doc_id, arg_min(CASE WHEN length(line) = 0 THEN 'message without a role'
                                        ELSE 'unknown role: tool' END, i) AS reason
            FROM lines WHERE length(line) = 0 OR length(line) % 97 = 13 GROUP BY doc_id),
    sizes AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id)
    SELECT doc_id, coalesce(reason, '') AS skip_reason,
           CAST(CASE WHEN reason IS NULL THEN n ELSE 0 END AS INTEGER) AS n_messages
    FROM sizes LEFT JOIN bad USING (doc_id)
    """,
)
def quarantine_reasons(spark: SparkSession, folder: str) -> DataFrame:
    docs = line_conversations(table(spark, folder, "documents", costly=True))
    rows = M.chat_rows(docs, M.ChatSpec(conversation="conversation", roles=ROLES), "documents", "train", "doc_id")
    return rows.select(
        F.col("extra_info.index").alias("doc_id"),
        F.col("extra_info.skip_reason").alias("skip_reason"),
        F.size("messages").alias("n_messages"),
    )


@query(
    "system_prompt_precedence",
    """
    WITH noted AS (SELECT *, CASE lang WHEN 'en' THEN source WHEN 'fr' THEN '' END AS note FROM documents)
    SELECT doc_id, 'From ' || source || ' in ' || lang AS by_template,
           CASE WHEN coalesce(note, '') <> '' THEN note ELSE 'fixed' END AS by_column, 'fixed' AS by_text
    FROM noted
    """,
)
def system_prompt_precedence(spark: SparkSession, folder: str) -> DataFrame:
    note = F.when(F.col("lang") == "en", F.col("source")).when(F.col("lang") == "fr", "")
    docs = table(spark, folder, "documents").withColumn("note", note)
    named = M.ChatSpec(system_text="fixed", system_column="remark", system_aliases=["note"])
    framed = M.ChatSpec(system_text="fixed", system_column="note", system_template="From {source} in {lang}")
    return docs.select(
        "doc_id",
        M.system_prompt(docs.columns, framed).alias("by_template"),
        M.system_prompt(docs.columns, named).alias("by_column"),
        M.system_prompt(docs.columns, M.ChatSpec(system_text="fixed")).alias("by_text"),
    )


@query(
    "render_template",
    """
    SELECT p_partkey, coalesce(nullif(p_name, 'red widget'), '') || ' Sequence: ' || p_type || ' {unknown} '
           || p_size AS rendered
    FROM part
    """,
)
def render_template(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").withColumn("p_name", F.nullif("p_name", F.lit("red widget")))
    return part.select("p_partkey", render("{p_name} Sequence: {p_type} {unknown} {p_size}", part.columns).alias("rendered"))


@query(
    "alias_columns",
    """
    WITH c AS (SELECT *, nullif(c_mktsegment, 'BUILDING') AS segment FROM customer)
    SELECT c_custkey, c_name AS prompt, coalesce(segment, '') AS response, coalesce(segment, 'None') AS response_as_text,
           '' AS absent
    FROM c
    """,
)
def alias_columns(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer").withColumn("segment", F.nullif("c_mktsegment", F.lit("BUILDING")))
    spec = M.ChatSpec("question", "answer", ["c_name"], ["segment"])
    as_text = M.ChatSpec("question", "answer", ["c_name"], ["segment"], null_text="None")
    absent = M.ChatSpec("question", "answer", ["c_name"], ["reply"])

    def content(s: M.ChatSpec, i: int):
        return F.get(M.qa_messages(c.columns, s), F.lit(i))["content"]

    return c.select(
        "c_custkey",
        content(spec, 0).alias("prompt"),
        content(spec, 1).alias("response"),
        content(as_text, 1).alias("response_as_text"),
        content(absent, 1).alias("absent"),
    )


_SPLIT3 = """
    ranked AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || {key}), {key}) - 1 AS i, count(*) OVER () AS n
               FROM {rel}),
    cuts AS (SELECT *, CAST(floor(n * 0.8::DOUBLE) AS BIGINT) AS c1,
                    CAST(floor(n * 0.8::DOUBLE) AS BIGINT) + CAST(floor(n * 0.1::DOUBLE) AS BIGINT) AS c2 FROM ranked),
    placed AS (SELECT *, CASE WHEN i < c1 THEN 'train' WHEN i < c2 THEN 'validation' ELSE 'test' END AS split,
                      CASE WHEN i < c1 THEN i WHEN i < c2 THEN i - c1 ELSE i - c2 END AS idx FROM cuts)
"""
NAMES, SHARES = ["train", "validation", "test"], [0.8, 0.1, 0.1]


@query(
    "extra_info",
    f"""
    WITH {_SPLIT3.format(key="doc_id", rel="documents")}
    SELECT doc_id, split, idx AS index, '' AS skip_reason, lang FROM placed
    """,
)
def extra_info(spark: SparkSession, folder: str) -> DataFrame:
    docs = splits.ratio_split(table(spark, folder, "documents"), ["doc_id"], NAMES, SHARES, index="__index")
    spec = M.ChatSpec(prompt="source", response="text")
    rows = M.chat_rows(docs, spec, "documents", F.col("split"), "__index", ["doc_id", "lang", "absent"])
    return rows.select("extra_info.doc_id", "extra_info.split", "extra_info.index", "extra_info.skip_reason", "extra_info.lang")


@query(
    "instruction_formats",
    """
    WITH d AS (SELECT doc_id, text AS instruction, CASE WHEN lang = 'fr' THEN '' WHEN lang = 'de' THEN NULL
                      ELSE source END AS extra FROM documents),
    e AS (SELECT *, coalesce(extra, '') <> '' AS has FROM d)
    SELECT doc_id, 'extra_first' AS layout,
           CASE WHEN has THEN extra || chr(10) || chr(10) || instruction ELSE instruction END AS content FROM e
    UNION ALL SELECT doc_id, 'extra_last',
           CASE WHEN has THEN instruction || chr(10) || chr(10) || extra ELSE instruction END FROM e
    UNION ALL SELECT doc_id, 'extra_next_line', CASE WHEN has THEN instruction || chr(10) || extra ELSE instruction END FROM e
    UNION ALL SELECT doc_id, 'instruction_only', instruction FROM e
    """,
)
def instruction_formats(spark: SparkSession, folder: str) -> DataFrame:
    extra = F.when(F.col("lang") == "fr", "").when(F.col("lang") == "de", None).otherwise(F.col("source"))
    docs = table(spark, folder, "documents").withColumn("extra", extra)
    made = [
        F.struct(F.lit(layout).alias("layout"), M.instruction_format(layout, F.col("text"), F.col("extra")).alias("content"))
        for layout in ("extra_first", "extra_last", "extra_next_line", "instruction_only")
    ]
    return docs.select("doc_id", F.explode(F.array(*made)).alias("m")).select("doc_id", "m.layout", "m.content")


@query(
    "append_generation",
    """
    SELECT doc_id, 0 AS pos, 'user' AS role, text AS content FROM documents
    UNION ALL SELECT doc_id, 1, 'assistant', source FROM documents
    """,
)
def append_generation(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    prompts = F.array(F.array(M.message("user", F.col("text"))), F.array(M.message("user", F.col("lang"))))
    made = M.append_generation(prompts, F.array("source", "lang"))
    return exploded(docs.select("doc_id", made.alias("messages")), "doc_id")


@query("preference_triples", "SELECT doc_id, text AS prompt, source AS chosen, lang AS rejected FROM documents")
def preference_triples(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    ask = M.message("user", F.col("text"))
    answers = [F.array(ask, M.message("assistant", F.col(c))) for c in ("source", "lang")]
    triple = docs.select("doc_id", *M.preference_triple(answers[0], *answers))
    one = {"prompt": "prompt_messages", "chosen": "chosen_messages", "rejected": "rejected_messages"}
    return triple.select("doc_id", *[F.get(F.col(c), F.lit(0))["content"].alias(n) for n, c in one.items()])


@query("preference_ties", "SELECT doc_id, quality, toxic FROM labels WHERE quality = toxic")
def preference_ties(spark: SparkSession, folder: str) -> DataFrame:
    return M.preference_filter(table(spark, folder, "labels"), "quality", "toxic")


@query(
    "row_ids",
    """
    SELECT lang || '_' || (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) AS id, doc_id,
           row_number() OVER (ORDER BY doc_id) - 1 AS row_index
    FROM documents
    """,
)
def row_ids(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    within = with_row_index(docs, ["doc_id"], ["lang"], "i")
    whole = with_row_index(within, ["doc_id"])
    return whole.select(F.concat_ws("_", "lang", "i").alias("id"), "doc_id", "row_index")


@query(
    "tagged_messages",
    """
    SELECT doc_id, 0 AS pos, 'human' AS "from", text AS value FROM documents
    UNION ALL SELECT doc_id, 1, 'gpt', source FROM documents
    UNION ALL SELECT doc_id, 2, 'system', lang FROM documents
    """,
)
def tagged_messages(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    chat = F.array(*[M.message(r, F.col(c)) for r, c in (("user", "text"), ("assistant", "source"), ("system", "lang"))])
    tagged = docs.select("doc_id", M.retag(chat, {"user": "human", "assistant": "gpt"}).alias("m"))
    return tagged.select("doc_id", F.posexplode("m").alias("pos", "m")).select("doc_id", "pos", "m.from", "m.value")


@query(
    "chat_template_render",
    """
    SELECT doc_id, 'chat-ml' AS layout, '<|im_start|>system' || chr(10) || lang || '<|im_end|>' || chr(10) || '<|im_start|>user'
           || chr(10) || text || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || source || '<|im_end|>' || chr(10) AS rendered
    FROM documents
    UNION ALL SELECT doc_id, 'plain', 'system: ' || lang || chr(10) || 'user: ' || text || chr(10) || 'assistant: ' || source || chr(10)
    FROM documents
    UNION ALL SELECT doc_id, 'mistral-with-system', '<s>[INST] ' || lang || chr(10) || chr(10) || text || ' [/INST] ' || source || '</s>'
    FROM documents
    UNION ALL SELECT doc_id, 'simplified-llama31', '<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || lang
           || '<|eot_id|><|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || text
           || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) || source || '<|eot_id|>' FROM documents
    """,
)
def chat_template_render(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    chat = F.array(*[M.message(r, F.col(c)) for r, c in (("system", "lang"), ("user", "text"), ("assistant", "source"))])
    made = [
        F.struct(F.lit(name).alias("layout"), M.chat_text(chat, name).alias("rendered"))
        for name in ("chat-ml", "plain", "mistral-with-system", "simplified-llama31")
    ]
    return docs.select("doc_id", F.explode(F.array(*made)).alias("m")).select("doc_id", "m.layout", "m.rendered")


@query(
    "eval_prompts",
    "SELECT doc_id, 'Name the main points of this passage:' || chr(10) || '    ' || text AS prompt FROM documents",
)
def eval_prompts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    prompt = render("Name the main points of this passage:\n    {context}", {"context": F.col("text")})
    return docs.select("doc_id", prompt.alias("prompt"))


@query(
    "explode_steps",
    """
    WITH s AS (SELECT vec_id, unnest(range(8)) AS step, embedding FROM embeddings)
    SELECT vec_id, CAST(step AS INTEGER) AS step, printf('episode_%04d/step_%04d.png', vec_id, step) AS image_path,
           CAST(embedding[step * 8 + 1] AS DOUBLE) AS first_value, CAST(embedding[step * 8 + 8] AS DOUBLE) AS last_value
    FROM s
    """,
)
def explode_steps(spark: SparkSession, folder: str) -> DataFrame:
    episodes = table(spark, folder, "embeddings").select("vec_id", records.reshape_vector(F.col("embedding"), 8).alias("steps"))
    steps = records.explode_steps(episodes, "vec_id", "steps")
    ends = {"first_value": 0, "last_value": 7}
    return steps.select(
        "vec_id", "step", "image_path", *[F.get("data", F.lit(i)).cast("double").alias(n) for n, i in ends.items()]
    )


@query(
    "reshape_vectors",
    """
    SELECT vec_id, CAST(8 AS INTEGER) AS rows_of_8, CAST(embedding[17] AS DOUBLE) AS third_row_head,
           CAST(NULL AS INTEGER) AS rows_of_7
    FROM embeddings
    """,
)
def reshape_vectors(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings")
    by8, by7 = (records.reshape_vector(F.col("embedding"), w) for w in (8, 7))
    return v.select(
        "vec_id",
        F.size(by8).alias("rows_of_8"),
        F.get(F.get(by8, F.lit(2)), F.lit(0)).cast("double").alias("third_row_head"),
        F.when(by7.isNotNull(), F.size(by7)).alias("rows_of_7"),
    )


@query(
    "flatten_struct",
    """
    SELECT event_id, user_id AS "steps/user/id", event_type AS "steps/user/action",
           (event_type = 'error') AS "steps/failed", value AS "value"
    FROM events
    """,
)
def flatten_struct(spark: SparkSession, folder: str) -> DataFrame:
    nested = table(spark, folder, "events").select(
        "event_id",
        F.struct(
            F.struct(F.col("user_id").alias("id"), F.col("event_type").alias("action")).alias("user"),
            (F.col("event_type") == "error").cast("int").alias("failed"),
        ).alias("steps"),
        "value",
    )
    return records.flatten_struct(nested, booleans=["steps/failed"])


@query(
    "scenario_env_map",
    """
    SELECT p_partkey, 'BRAND' AS name, p_brand AS value,
           'python bench.py --p_partkey ' || p_partkey || ' --size=' || p_size || ' --output-json out_' || p_partkey
           || '.json' AS command FROM part
    UNION ALL SELECT p_partkey, 'TYPE', p_type, 'python bench.py --p_partkey ' || p_partkey || ' --size=' || p_size
           || ' --output-json out_' || p_partkey || '.json' FROM part
    """,
)
def scenario_env_map(spark: SparkSession, folder: str) -> DataFrame:
    scenarios = table(spark, folder, "part").select(
        "p_partkey",
        F.concat(F.lit("="), "p_size").alias("size"),
        F.col("p_brand").alias("export BRAND"),
        F.col("p_type").alias("Export TYPE"),
    )
    arguments, environment = records.environment_map(scenarios.columns)
    output = F.concat(F.lit("out_"), "p_partkey", F.lit(".json"))
    return scenarios.select(
        "p_partkey",
        records.command_line("bench.py", arguments, output).alias("command"),
        F.explode(environment).alias("name", "value"),
    )


@query("filter_kind", "SELECT conv_id, turn, text FROM conversations WHERE role = 'user'")
def filter_kind(spark: SparkSession, folder: str) -> DataFrame:
    return records.keep_equal(table(spark, folder, "conversations"), "role", "user").select("conv_id", "turn", "text")


@query(
    "require_keys",
    """
    SELECT event_id, props FROM
      (SELECT event_id, CASE WHEN event_type = 'error' THEN '{"other": 1}' WHEN event_type = 'view' THEN '{"k": null}'
              ELSE props END AS props FROM events)
    WHERE list_contains(json_keys(props), 'k')
    """,
)
def require_keys(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.col("event_type")
    props = F.when(kind == "error", '{"other": 1}').when(kind == "view", '{"k": null}').otherwise(F.col("props"))
    events = table(spark, folder, "events").select("event_id", props.alias("props"))
    return records.require_keys(events, "props", ["k"])


_WORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))"


@query(
    "context_length_filter",
    f"""
    SELECT doc_id, n_tokens FROM (SELECT doc_id, CAST({_WORDS} AS INTEGER) AS n_tokens FROM documents) WHERE n_tokens <= 256
    """,
)
def context_length_filter(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", word_count(F.col("text")).alias("n_tokens"))
    return records.within_length(docs, F.col("n_tokens"), 256)


@query(
    "length_handling",
    r"""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS t FROM documents)
    SELECT doc_id, 'filter' AS mode, CAST(len(t) AS INTEGER) AS n_tokens, array_to_string(t, ' ') AS tokens
    FROM w WHERE len(t) <= 512
    UNION ALL SELECT doc_id, 'truncate', CAST(least(len(t), 512) AS INTEGER), array_to_string(t[1:512], ' ') FROM w
    """,
)
def length_handling(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    parts = [
        records.limit_length(docs, "text", how, 512).select(
            "doc_id", F.lit(how).alias("mode"), F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens")
        )
        for how in ("filter", "truncate")
    ]
    return mixing.concat(*parts)


@query("ratio_split", f"WITH {_SPLIT3.format(key='doc_id', rel='documents')} SELECT doc_id, split FROM placed")
def ratio_split(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id")
    return splits.ratio_split(docs, ["doc_id"], NAMES, SHARES)


@query(
    "auto_split",
    """
    WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('1289525893:' || o_orderkey), o_orderkey) - 1 AS i,
                      count(*) OVER () AS n FROM orders),
    p AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) - 1 AS i,
                      count(*) OVER () AS n FROM orders)
    SELECT 'auto' AS kind, o_orderkey, CASE WHEN i < floor(n * 0.2::DOUBLE) THEN 'validation' ELSE 'train' END AS split FROM r
    UNION ALL
    SELECT 'percent', o_orderkey, CASE WHEN i < floor(n * 0.9::DOUBLE) THEN 'train' ELSE 'eval' END FROM p
    """,
)
def auto_split(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey")
    auto = splits.auto_split(orders, ["o_orderkey"]).select(F.lit("auto").alias("kind"), "o_orderkey", "split")
    percent = splits.percent_split(orders, ["o_orderkey"], 90)
    return auto.unionByName(percent.select(F.lit("percent").alias("kind"), "o_orderkey", "split"))


@query(
    "concat_datasets",
    """
    SELECT doc_id AS id, text, lang FROM documents UNION ALL SELECT item_id, text, NULL FROM benchmark
    """,
)
def concat_datasets(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text", "lang")
    items = table(spark, folder, "benchmark").select(F.col("item_id").alias("id"), "text")
    return mixing.concat(docs, items)


WEIGHTS = {"en": 0.5, "fr": 0.2, "de": 0.2, "es": 0.1}


@query(
    "weighted_mix",
    """
    WITH w AS (SELECT * FROM (VALUES ('en', 0.5::DOUBLE), ('fr', 0.2), ('de', 0.2), ('es', 0.1)) AS w(lang, p)),
    sizes AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang),
    draws AS (SELECT t, ('0x' || substr(md5('19851243:' || t), 1, 13))::BIGINT / pow(16::DOUBLE, 13) AS u
              FROM (SELECT unnest(range((SELECT CAST(4 * max(n / p) AS BIGINT) + 1000 FROM sizes JOIN w USING (lang)))) AS t)),
    picks AS (SELECT t, CASE WHEN u < 0.5::DOUBLE THEN 'en' WHEN u < 0.5::DOUBLE + 0.2::DOUBLE THEN 'fr'
                     WHEN u < 0.5::DOUBLE + 0.2::DOUBLE + 0.2::DOUBLE THEN 'de' ELSE 'es' END AS lang FROM draws),
    counted AS (SELECT t, lang, row_number() OVER (PARTITION BY lang ORDER BY t) - 1 AS draw FROM picks),
    cut AS (SELECT max(t) AS last FROM counted JOIN sizes USING (lang) WHERE draw = n - 1),
    docs AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i FROM documents)
    SELECT t, draw, doc_id, c.lang
    FROM counted c JOIN sizes s ON c.lang = s.lang JOIN docs d ON d.lang = c.lang AND d.i = c.draw % s.n
    WHERE t <= (SELECT last FROM cut)
    """,
)
def weighted_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    return mixing.weighted_mix(docs, "lang", ["doc_id"], WEIGHTS)


@query(
    "sample_n",
    "SELECT doc_id, text FROM documents ORDER BY md5('42:' || doc_id), doc_id LIMIT 100",
)
def sample_n(spark: SparkSession, folder: str) -> DataFrame:
    return splits.sample_exact(table(spark, folder, "documents").select("doc_id", "text"), ["doc_id"], 100)


@query(
    "distinct_sample",
    """
    WITH v AS (SELECT DISTINCT source FROM documents),
    s AS (SELECT source FROM v ORDER BY md5('42:' || source), source LIMIT 10)
    SELECT source, min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang FROM documents JOIN s USING (source) GROUP BY source
    """,
)
def distinct_sample(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("source", "doc_id", "lang")
    return splits.sample_values(docs, "source", 10, "doc_id")


@query(
    "cap_rows",
    """
    SELECT 'group' AS kind, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= 50
    UNION ALL SELECT 'table', doc_id FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100)
    """,
)
def cap_rows(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "lang")
    each = splits.cap_rows(docs, ["doc_id"], 50, within=["lang"]).select(F.lit("group").alias("kind"), "doc_id")
    return each.unionByName(splits.cap_rows(docs, ["doc_id"], 100).select(F.lit("table").alias("kind"), "doc_id"))


@query(
    "subset_after_filter",
    f"""
    SELECT doc_id, n_tokens FROM (SELECT doc_id, CAST({_WORDS} AS INTEGER) AS n_tokens FROM documents)
    WHERE n_tokens <= 256 ORDER BY doc_id LIMIT 100
    """,
)
def subset_after_filter(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", word_count(F.col("text")).alias("n_tokens"))
    return records.first_passing(docs, F.col("n_tokens") <= 256, ["doc_id"], 100)


@query(
    "batch_ids",
    "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 64 AS batch_id FROM orders",
)
def batch_ids(spark: SparkSession, folder: str) -> DataFrame:
    orders = with_row_index(table(spark, folder, "orders").select("o_orderkey"), ["o_orderkey"], name="i")
    return splits.with_batches(orders, "i", 64).drop("i")


@query(
    "even_shards",
    """
    WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('0:' || o_orderkey), o_orderkey) - 1 AS i,
                      count(*) OVER () AS n FROM orders),
    p AS (SELECT o_orderkey, i AS place, false AS is_pad FROM r
          UNION ALL SELECT o_orderkey, i + n, true FROM r WHERE i + n < CAST(ceil(n / 7.0) AS BIGINT) * 7)
    SELECT o_orderkey, place % 7 AS shard, place // 7 AS position, is_pad FROM p
    """,
)
def even_shards(spark: SparkSession, folder: str) -> DataFrame:
    return splits.even_shards(table(spark, folder, "orders").select("o_orderkey"), ["o_orderkey"], 7)


@query(
    "shards_unpadded",
    """
    WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5('0:' || o_orderkey), o_orderkey) - 1 AS i FROM orders)
    SELECT i % 7 AS shard, count(*) AS n_rows, count(*) AS valid_rows, CAST(sum(i // 7) AS BIGINT) AS positions FROM r GROUP BY 1
    """,
)
def shards_unpadded(spark: SparkSession, folder: str) -> DataFrame:
    shards = splits.even_shards(table(spark, folder, "orders").select("o_orderkey"), ["o_orderkey"], 7, pad="none")
    sizes = splits.shard_sizes(shards).join(shards.groupBy("shard").agg(F.sum("position").alias("positions")), "shard")
    return sizes.withColumnRenamed("rows", "n_rows")


@query(
    "shards_random_pads",
    """
    WITH n AS (SELECT count(*) AS n FROM documents), k AS (SELECT n * 5 // 2 AS replicas, n FROM n),
    r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('3:' || doc_id), doc_id) - 1 AS i FROM documents),
    places AS (SELECT unnest(range(replicas)) AS place, n FROM k),
    taken AS (SELECT place, place >= n AS is_pad, CASE WHEN place < n THEN place ELSE ('0x' || substr(md5('3:' || place), 1, 13))::BIGINT % n END AS i FROM places)
    SELECT doc_id, place AS shard, CAST(0 AS BIGINT) AS position, is_pad FROM taken JOIN r USING (i)
    """,
)
def shards_random_pads(spark: SparkSession, folder: str) -> DataFrame:
    """More replicas than documents: the places left over take seeded random documents."""
    docs = table(spark, folder, "documents").select("doc_id")
    return splits.even_shards(docs, ["doc_id"], docs.count() * 5 // 2, seed=3, pad="random")


@query(
    "pack_sequences",
    f"""
    WITH RECURSIVE d AS (SELECT doc_id, CAST({_WORDS} AS BIGINT) AS n_tokens,
                                ('0x' || substr(md5('0:' || doc_id), 1, 13))::BIGINT
                                % greatest(1, (SELECT CAST(ceil(count(*) / 64.0) AS BIGINT) FROM documents)) AS bucket
                         FROM documents),
    o AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY doc_id) AS i FROM d),
    fill AS (
      SELECT doc_id, bucket, i, n_tokens, CAST(0 AS BIGINT) AS pack, CAST(0 AS BIGINT) AS "offset", n_tokens AS used
      FROM o WHERE i = 1
      UNION ALL
      SELECT o.doc_id, o.bucket, o.i, o.n_tokens,
             CASE WHEN f.used > 0 AND f.used + o.n_tokens > 2048 THEN f.pack + 1 ELSE f.pack END,
             CASE WHEN f.used > 0 AND f.used + o.n_tokens > 2048 THEN 0 ELSE f.used END,
             CASE WHEN f.used > 0 AND f.used + o.n_tokens > 2048 THEN o.n_tokens ELSE f.used + o.n_tokens END
      FROM fill f JOIN o ON o.bucket = f.bucket AND o.i = f.i + 1)
    SELECT doc_id, bucket, n_tokens, pack, "offset" FROM fill
    """,
)
def pack_sequences(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", costly=True)
    docs = docs.select("doc_id", word_count(F.col("text")).alias("n_tokens"))
    return mixing.pack_sequences(docs, "doc_id", "n_tokens", 2048, rows_per_bucket=64)


_IDS = """
    list_transform(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> ''), lambda w: ('0x' || substr(md5(w), 1, 4))::INTEGER)
"""


def _token_ids(text: str) -> Column:
    """A stand-in for a tokenizer: 16 bits of each word's digest."""
    return F.transform(words(F.col(text)), lambda w: F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int"))


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", costly=True).select("doc_id", _token_ids("text").alias("ids"))
    return packs.packed_sequences(docs, "doc_id", "ids", 2048)


@query(
    "packed_tokens",
    f"""
    SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_tokens, md5(array_to_string(ids, ' ')) AS ids_md5,
           CAST(ceil(len(ids) / 2048.0) AS BIGINT) AS n_pieces, 2048 AS width, true AS sound
    FROM (SELECT doc_id, {_IDS} AS ids FROM documents) WHERE len(ids) > 0
    """,
)
def packed_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as they come out of packed sequences of 2,048 ids again, and whether segments and positions restart with each."""
    whole = _packed(spark, folder).withColumn("width", F.size("tokens"))
    pieces = packs.unpacked(whole, ["tokens", "segments", "positions"]).join(whole.select("pack", "width"), "pack")
    restarts = F.col("positions") == F.sequence(F.lit(0), F.col("length") - 1)
    one = (F.array_min("segments") == F.array_max("segments")) & (F.array_min("segments") > 0)
    sized = (F.size("tokens") == F.col("length")) & (F.size("segments") == F.col("length"))
    texts = pieces.groupBy(F.col("key").alias("doc_id")).agg(
        F.sum("length").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("piece", "tokens"))).alias("parts"),
        F.count(F.lit(1)).alias("n_pieces"),
        F.min("width").alias("width"),
        F.every(restarts & one & sized).alias("sound"),
    )
    ids = F.array_join(F.flatten(F.transform("parts", lambda p: p["tokens"])), " ")
    return texts.select("doc_id", "n_tokens", F.md5(ids).alias("ids_md5"), "n_pieces", "width", "sound")


@query(
    "packed_fill",
    f"""
    SELECT CAST(sum(len(ids)) AS BIGINT) AS tokens, true AS tight, true AS gapless FROM (SELECT {_IDS} AS ids FROM documents)
    """,
)
def packed_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens in all packs; whether the packs are at most a hundredth, and one, more than any packing needs, and are numbered without gaps."""
    sums = _packed(spark, folder).agg(F.sum("used").alias("tokens"), F.count(F.lit(1)).alias("n"), F.max("pack").alias("last"))
    least = F.ceil(F.col("tokens") / 2048)
    return sums.select("tokens", (F.col("n") <= least * 1.01 + 1).alias("tight"), (F.col("last") == F.col("n") - 1).alias("gapless"))


@query(
    "prepare_by_ratio",
    f"""
    WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
    ok AS (SELECT doc_id, count(*) + 1 AS n_turns FROM lines GROUP BY doc_id
           HAVING count(*) FILTER (length(line) = 0 OR length(line) % 97 = 13) = 0),
    {_SPLIT3.format(key="doc_id", rel="documents")}
    SELECT 'documents' AS data_source, split, idx AS index, doc_id, CAST(n_turns AS INTEGER) AS n_messages, 'In ' || lang AS opening
    FROM placed JOIN ok USING (doc_id)
    """,
)
def prepare_by_ratio(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of documents as conversations with a system turn, split 80/10/10; only accepted rows."""
    docs = line_conversations(table(spark, folder, "documents", costly=True).select("doc_id", "lang", "text")).drop("text")
    spec = M.ChatSpec(conversation="conversation", system_template="In {lang}", roles=ROLES)
    rows = datasets.by_ratio(docs, ["doc_id"], dict(zip(NAMES, SHARES)), spec, "documents", preserve=["doc_id"])
    return M.accepted(rows).select(
        "data_source",
        "split",
        "extra_info.index",
        "extra_info.doc_id",
        F.size("messages").alias("n_messages"),
        F.get("messages", F.lit(0))["content"].alias("opening"),
    )


@query(
    "prepare_by_name",
    """
    SELECT 'good' AS split, row_number() OVER (ORDER BY doc_id) - 1 AS index, doc_id, text AS response
    FROM labels JOIN documents USING (doc_id) WHERE quality = 1
    UNION ALL
    SELECT 'poor', row_number() OVER (ORDER BY doc_id) - 1, doc_id, text FROM labels JOIN documents USING (doc_id) WHERE quality = 0
    """,
)
def prepare_by_name(spark: SparkSession, folder: str) -> DataFrame:
    """Good and poor documents as two splits with their own column names."""
    rated = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")
    good = rated.where(F.col("quality") == 1).select("doc_id", "source", "text")
    poor = rated.where(F.col("quality") == 0).select("doc_id", "source", F.col("text").alias("body"))
    spec = M.ChatSpec("source", "text", response_aliases=["body"])
    rows = datasets.by_name({"good": good, "poor": poor}, ["doc_id"], spec, "documents", preserve=["doc_id"])
    response = F.get("messages", F.lit(1))["content"]
    return M.accepted(rows).select("split", "extra_info.index", "extra_info.doc_id", response.alias("response"))


FLAGSHIP_SQL = f"""
    WITH {_TURNS},
    convs AS (SELECT DISTINCT conv_id FROM named ANTI JOIN bad USING (conv_id)),
    {_SPLIT3.format(key="conv_id", rel="convs")}
    SELECT split, role, count(DISTINCT n.conv_id) AS conversations, count(*) AS turns,
           CAST(sum(length(content)) AS BIGINT) AS characters
    FROM named n JOIN placed p ON n.conv_id = p.conv_id GROUP BY split, role
"""


@query("flagship", FLAGSHIP_SQL)
def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Normalise roles, set bad conversations aside, split the rest 80/10/10, and count.

    The turns are read twice: for the ids of the good conversations, which are written once and split, and
    to join each turn to its split.
    """
    raw = raw_turns(spark, folder)
    good = materialize(M.good_conversations(raw, "conv_id", "role", ROLES), "conversations")
    placed = splits.ratio_split(good, ["conv_id"], NAMES, SHARES)
    return (
        raw.withColumn("role", ROLES.canonical(F.col("role")))
        .join(placed, "conv_id")
        .groupBy("split", "role")
        .agg(
            F.count_distinct(F.col("conv_id")).alias("conversations"),
            F.count(F.lit(1)).alias("turns"),
            F.sum(F.length("text")).cast("bigint").alias("characters"),
        )
    )


@query("custom_transform", "SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ALL")
def custom_transform(spark: SparkSession, folder: str) -> DataFrame:
    def user_script(df: DataFrame) -> DataFrame:
        return df.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))

    return table(spark, folder, "documents").transform(user_script)
