"""Queries: chunks, tokens, embeddings, nearest neighbours and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.functions.text import duration_seconds, duration_text, last_segment, slug, words
from lathework.operators import chunks, inference, records, retrieval, vector_index
from lathework.operators.ordering import with_row_index
from lathework.plans.registry import query, table
from lathework.session import materialize

_CHUNKS = """
    windows AS (SELECT doc_id, text, source, unnest(range(greatest(CAST(ceil((length(text) - 100) / 700.0) AS INTEGER), 1))) AS pos
                FROM documents WHERE length(text) > 0),
    chunks AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, substr(text, CAST(pos * 700 + 1 AS BIGINT), 800) AS text, source FROM windows)
"""
_TRIM = "trim({0}, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11))"
_FIRST = f"""
    first_chunks AS (SELECT doc_id, pos, text FROM chunks WHERE length({_TRIM.format('text')}) > 0
                     QUALIFY row_number() OVER (PARTITION BY {_TRIM.format('text')} ORDER BY doc_id, pos) = 1)
"""


@query("chunk_fixed", f"WITH {_CHUNKS} SELECT doc_id, pos, text FROM chunks")
def chunk_fixed(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.fixed_chunks(table(spark, folder, "documents", costly=True), "doc_id", "text")


@query("chunk_dedup", f"WITH {_CHUNKS}, {_FIRST} SELECT doc_id, pos, text FROM first_chunks")
def chunk_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.dedup_chunks(chunk_fixed(spark, folder))


@query("chunk_provenance", f"WITH {_CHUNKS} SELECT doc_id, pos, source, CAST(length(text) AS INTEGER) AS size FROM chunks")
def chunk_provenance(spark: SparkSession, folder: str) -> DataFrame:
    sourced = chunks.with_source(chunk_fixed(spark, folder), table(spark, folder, "documents"), "doc_id", "source")
    return sourced.select("doc_id", "pos", "source", F.length("text").alias("size"))


_MARKS = ("chr(10) || chr(10)", "chr(10)", "' '", "''")


def _level(n: int) -> str:
    """SQL that cuts the segments ``seg<n>``: pieces in runs of short ones, and the long ones as the next segments."""
    first = " ".join(f"WHEN lev <= {i} AND contains(t, {mark}) THEN {i}" for i, mark in enumerate(_MARKS[:3]))
    mark = " ".join(f"WHEN {i} THEN {mark}" for i, mark in enumerate(_MARKS[:3]))
    return f"""
    mark{n} AS (SELECT *, CASE {first} ELSE 3 END AS mi FROM seg{n}),
    part{n} AS (
      SELECT doc_id, a, mi, unnest(parts) AS part, generate_subscripts(parts, 1) AS i, length(CASE mi {mark} ELSE '' END) AS width
      FROM (SELECT *, CASE WHEN mi = 3 THEN regexp_extract_all(t, '(?s).') ELSE string_split(t, CASE mi {mark} END) END AS parts FROM mark{n})),
    size{n} AS (
      SELECT *, len + a + sum(len) OVER (PARTITION BY doc_id, a ORDER BY i) - 2 * len AS s
      FROM (SELECT *, length(part) + CASE WHEN i > 1 THEN width ELSE 0 END AS len FROM part{n}) WHERE len > 0),
    piece{n} AS (
      SELECT *, len >= 800 AND mi < 3 AS long, count(*) FILTER (len >= 800 AND mi < 3) OVER (PARTITION BY doc_id, a ORDER BY i) AS run FROM size{n}),
    seg{n + 1} AS (
      SELECT p.doc_id, substr(d.text, CAST(p.s + 1 AS BIGINT), p.len) AS t, CAST(p.s AS BIGINT) AS a, p.mi + 1 AS lev
      FROM piece{n} p JOIN documents d USING (doc_id) WHERE long)"""


_RECURSIVE = f"""
    seg0 AS (SELECT doc_id, text AS t, CAST(0 AS BIGINT) AS a, 0 AS lev FROM documents WHERE length(text) > 0),
    {",".join(_level(n) for n in range(4))},
    runs AS (
      SELECT doc_id, list(CAST(s AS BIGINT) ORDER BY s) || [CAST(max(s + len) AS BIGINT)] AS st
      FROM ({" UNION ALL ".join(f"SELECT doc_id, {n} AS n, a, run, s, len FROM piece{n} WHERE NOT long" for n in range(4))})
      GROUP BY doc_id, n, a, run),
    spans AS (
      SELECT doc_id, st, CAST(1 AS BIGINT) AS j, CAST(len(list_filter(st, lambda x: x <= st[1] + 800)) AS BIGINT) AS c FROM runs
      UNION ALL
      SELECT doc_id, st, n, CAST(len(list_filter(st, lambda x: x <= st[n] + 800)) AS BIGINT)
      FROM (SELECT doc_id, st, CAST(1 + len(list_filter(st, lambda x: x < greatest(st[c] - 100, st[c + 1] - 800))) AS BIGINT) AS n
            FROM spans WHERE c < len(st))),
    cut AS (SELECT doc_id, st[j] AS s, substr(text, st[j] + 1, st[c] - st[j]) AS body FROM spans JOIN documents USING (doc_id)),
    recursive_chunks AS (
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS INTEGER) AS pos, {_TRIM.format('body')} AS text,
           CAST(s + length(body) - length({_TRIM.format('body').replace('trim(', 'ltrim(', 1)}) AS INTEGER) AS start
    FROM cut WHERE length({_TRIM.format('body')}) > 0)
"""


@query("chunk_recursive", f"WITH RECURSIVE {_RECURSIVE} SELECT doc_id, pos, text, start FROM recursive_chunks")
def chunk_recursive(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.recursive_chunks(table(spark, folder, "documents", costly=True), "doc_id", "text")


@query(
    "chunk_recursive_cover",
    r"""
    SELECT doc_id, CAST(length(regexp_replace(text, '\s', '', 'g')) AS BIGINT) AS visible, true AS in_place, true AS fits, true AS laps
    FROM documents WHERE length(regexp_replace(text, '\s', '', 'g')) > 0
    """,
)
def chunk_recursive_cover(spark: SparkSession, folder: str) -> DataFrame:
    """What passages must be whatever their cuts: in their place, no longer than 800, overlapping by at most 100, and missing nothing but blanks."""
    docs = table(spark, folder, "documents", costly=True).select("doc_id", "text")
    docs.createOrReplaceTempView("chunk_documents")
    cut = spark.sql(
        f"SELECT doc_id, c.* FROM chunk_documents, LATERAL {chunks.register_split(spark)}(text, 800, 100, array('\\n\\n', '\\n', ' ', '')) c"
    )
    passages = cut.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "start", F.col("text").alias("body")))).alias("parts"))

    def lap(part: Column, i: Column) -> Column:
        """Characters that the passage before holds too."""
        before = F.element_at("parts", F.greatest(i, F.lit(1)).cast("int"))
        end = F.when(i > 0, before["start"] + F.length(before["body"])).otherwise(0)
        return F.greatest(end - part["start"], F.lit(0))

    seen = F.transform("parts", lambda p, i: F.length(F.regexp_replace(F.substr(p["body"], lap(p, i) + 1), r"\s", "")))
    same = F.forall("parts", lambda p: F.substr(F.col("text"), p["start"] + 1, F.length(p["body"])) == p["body"])
    return docs.join(passages, "doc_id").select(
        "doc_id",
        F.aggregate(seen, F.lit(0).cast("bigint"), lambda a, n: a + n).alias("visible"),
        same.alias("in_place"),
        F.forall("parts", lambda p: F.length(p["body"]) <= 800).alias("fits"),
        (F.array_max(F.transform("parts", lap)) <= 100).alias("laps"),
    )


@query(
    "tokenize_documents",
    r"""
    WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '') AS t FROM documents)
    SELECT doc_id, array_to_string(t, ' ') AS tokens, CAST(len(t) AS INTEGER) AS n_tokens,
           CAST(list_sum(list_transform(t, lambda w: length(w))) AS BIGINT) AS encoded_sum
    FROM w
    """,
)
def tokenize_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Native word tokens, joined to the ids that a caller's tokenizer gives (here a token's length)."""
    docs = table(spark, folder, "documents", costly=True).select("doc_id", "text")
    encoded = inference.tokenize(docs, "doc_id", "text", lambda text: [len(token) for token in text.split()])
    total = F.aggregate("tokens", F.lit(0).cast("bigint"), lambda a, t: a + t)
    native = docs.select("doc_id", F.array_join(words(F.col("text")), " ").alias("tokens"))
    return native.join(encoded.select("doc_id", "n_tokens", total.alias("encoded_sum")), "doc_id")


LETTERS = "etaoinshrdlucmfwyp"


def letter_counts(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedding model: how often each of some letters occurs."""
    return [[float(text.count(letter)) for letter in LETTERS] for text in texts]


_COUNTS = "[" + ", ".join(f"(length({{0}}) - length(replace({{0}}, '{c}', '')))::DOUBLE" for c in LETTERS) + "]"


@query(
    "embed_chunks",
    f"""
    WITH {_CHUNKS}, v AS (SELECT doc_id, pos, {_COUNTS.format('text')} AS e FROM chunks)
    SELECT doc_id, pos, CAST(len(e) AS INTEGER) AS width, list_sum(e) AS total, e[1] AS first FROM v
    """,
)
def embed_chunks(spark: SparkSession, folder: str) -> DataFrame:
    vectors = inference.embed(chunk_fixed(spark, folder), "text", letter_counts)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    first = F.get("embedding", F.lit(0)).cast("double")
    return vectors.select("doc_id", "pos", F.size("embedding").alias("width"), total.alias("total"), first.alias("first"))


@query(
    "knn_topk",
    """
    WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    s AS (SELECT q.vec_id AS question_id, i.vec_id AS item_id,
                 round(list_dot_product(q.e, i.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(i.e, i.e))), 9) AS score
          FROM v q, v i),
    r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, item_id) AS rank FROM s)
    SELECT question_id, item_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5
    """,
)
def knn_topk(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings")
    hits = retrieval.nearest(v, "vec_id", "embedding", v, "vec_id", "embedding", 5)
    return hits.select("question_id", "item_id", F.round("score", 6).alias("score"), "rank")


def _indexed(spark: SparkSession, folder: str, k: int) -> tuple[DataFrame, DataFrame]:
    """Every twentieth vector as a question, and its hits among all vectors."""
    v = table(spark, folder, "embeddings")
    asked = v.where(F.col("vec_id") % 20 == 0)
    index = vector_index.build_index(v, "vec_id", "embedding", k=k)
    return asked, vector_index.search_index(index, asked, "vec_id", "embedding", k)


@query("knn_indexed")
def knn_indexed(spark: SparkSession, folder: str) -> DataFrame:
    """The ten nearest by an inverted-file index over all rows; approximate, so SQL cannot state it."""
    _, hits = _indexed(spark, folder, 10)
    return hits.select("question_id", "item_id", F.round("score", 6).alias("score"), "rank")


@query(
    "knn_indexed_recall",
    """
    SELECT count(*) AS questions, CAST(count(*) * (SELECT least(count(*), 10) FROM embeddings) AS BIGINT) AS hits, true AS enough
    FROM embeddings WHERE vec_id % 20 = 0
    """,
)
def knn_indexed_recall(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the index finds nine tenths and more of what the exact search over the whole table does."""
    asked, hits = _indexed(spark, folder, 10)
    exact = retrieval.nearest(asked, "vec_id", "embedding", table(spark, folder, "embeddings"), "vec_id", "embedding", 10)
    both = exact.select("question_id", "item_id", F.lit(1).alias("exact")).join(
        hits.select("question_id", "item_id", F.lit(1).alias("found")), ["question_id", "item_id"], "full_outer"
    )
    shared = F.count(F.when(F.col("exact").isNotNull() & F.col("found").isNotNull(), 1))
    return both.agg(
        F.count_distinct("question_id").alias("questions"), F.count("found").alias("hits"), (shared >= 0.9 * F.count("exact")).alias("enough")
    )


@query(
    "rag_prompt",
    f"""
    WITH {_CHUNKS}, {_FIRST},
    store AS (SELECT text, row_number() OVER (ORDER BY doc_id, pos) - 1 AS chunk_id, {_COUNTS.format('text')} AS e FROM first_chunks),
    items AS (SELECT *, sqrt(list_dot_product(e, e)) AS len FROM store),
    asked AS (SELECT item_id, text, e, sqrt(list_dot_product(e, e)) AS len
              FROM (SELECT item_id, text, {_COUNTS.format('text')} AS e FROM benchmark)),
    s AS (SELECT item_id, chunk_id, i.text, round(CASE WHEN i.len = 0 OR a.len = 0 THEN 0 ELSE list_dot_product(a.e, i.e) / (a.len * i.len) END, 9) AS score
          FROM asked a, items i),
    best AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 4),
    contexts AS (SELECT item_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n,
                        string_agg(substr(text, 1, 80), '|' ORDER BY rank) AS previews FROM best GROUP BY item_id)
    SELECT b.item_id, CAST(n AS INTEGER) AS passages, 'Context:' || chr(10) || context || chr(10) || 'Question: ' || b.text AS prompt
    FROM benchmark b JOIN contexts c USING (item_id)
    """,
)
def rag_prompt(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents, cut, deduplicated, embedded and searched for every benchmark text."""
    first = chunks.dedup_chunks(chunk_fixed(spark, folder))
    store = inference.embed(with_row_index(first, ["doc_id", "pos"], name="chunk_id"), "text", letter_counts)
    store = materialize(store, "chunk-store")
    asked = inference.embed(table(spark, folder, "benchmark"), "text", letter_counts)
    hits = retrieval.nearest(asked, "item_id", "embedding", store, "chunk_id", "embedding", 4)
    hits = hits.join(store.select(F.col("chunk_id").alias("item_id"), "text"), "item_id")
    frame = "Context:\n{context}\nQuestion: {question}"
    prompts = retrieval.retrieval_prompts(hits, table(spark, folder, "benchmark"), "item_id", "text", frame)
    return prompts.select("item_id", "passages", "prompt")


_SEARCH = "CASE WHEN item_id % 3 = 0 THEN substr(text, 1, 40) ELSE text END"


@query(
    "rag_answers",
    f"""
    WITH RECURSIVE {_RECURSIVE},
    firsts AS (SELECT doc_id, pos, text FROM recursive_chunks QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id, pos) = 1),
    store AS (SELECT text, row_number() OVER (ORDER BY doc_id, pos) - 1 AS chunk_id, {_COUNTS.format('text')} AS e FROM firsts),
    items AS (SELECT *, sqrt(list_dot_product(e, e)) AS len FROM store),
    asked AS (SELECT item_id, e, sqrt(list_dot_product(e, e)) AS len
              FROM (SELECT item_id, {_COUNTS.format('search')} AS e FROM (SELECT item_id, {_TRIM.format(_SEARCH)} AS search FROM benchmark))),
    s AS (SELECT item_id, chunk_id, i.text, round(CASE WHEN i.len = 0 OR a.len = 0 THEN 0 ELSE list_dot_product(a.e, i.e) / (a.len * i.len) END, 9) AS score
          FROM asked a, items i),
    best AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, chunk_id) AS rank FROM s QUALIFY rank <= 4),
    contexts AS (SELECT item_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context, count(*) AS n FROM best GROUP BY item_id)
    SELECT b.item_id, CASE WHEN b.item_id % 3 = 0 THEN 'hint' ELSE 'question' END AS searched_by, CAST(n AS INTEGER) AS passages,
           'system|user' AS roles, 'Context:' || chr(10) || context || chr(10) || 'Question: ' || {_TRIM.format('b.text')} AS prompt
    FROM benchmark b JOIN contexts c USING (item_id) WHERE length({_TRIM.format('b.text')}) > 0
    """,
)
def rag_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Recursive passages of whole documents behind every benchmark text; every third is searched for by a hint."""
    first = chunks.dedup_chunks(chunk_recursive(spark, folder)).select("doc_id", "pos", "text")
    store = with_row_index(first, ["doc_id", "pos"], name="chunk_id")
    asked = table(spark, folder, "benchmark").withColumn("hint", F.when(F.col("item_id") % 3 == 0, F.substring("text", 1, 40)))
    frame = "Context:\n{context}\nQuestion: {question}"
    out = retrieval.answer_prompts(asked, "item_id", "text", store, "chunk_id", letter_counts, 4, hint="hint", frame=frame)
    roles = F.array_join(F.transform("messages", lambda m: m["role"]), "|")
    return out.select("item_id", "searched_by", "passages", roles.alias("roles"), "prompt")


@query(
    "rag_previews",
    """
    WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    s AS (SELECT q.vec_id AS question_id, i.vec_id AS doc_id,
                 round(list_dot_product(q.e, i.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(i.e, i.e))), 9) AS score
          FROM v q, v i),
    r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 3)
    SELECT question_id, CAST(rank AS INTEGER) AS rank, doc_id, source, substr(text, 1, 80) AS preview
    FROM r JOIN documents USING (doc_id)
    """,
)
def rag_previews(spark: SparkSession, folder: str) -> DataFrame:
    """The first characters of each retrieved passage, with its source."""
    v = table(spark, folder, "embeddings")
    hits = retrieval.nearest(v, "vec_id", "embedding", v, "vec_id", "embedding", 3)
    docs = table(spark, folder, "documents").select(
        F.col("doc_id").alias("item_id"), "source", F.substring("text", 1, 80).alias("preview")
    )
    return hits.join(docs, "item_id").select("question_id", "rank", F.col("item_id").alias("doc_id"), "source", "preview")


@query(
    "format_duration",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity = 1 THEN 'N/A' ELSE
             CAST(floor(l_extendedprice / 60) AS BIGINT) || 'm'
             || printf('%.2f', round(l_extendedprice - floor(l_extendedprice / 60) * 60, 2)) || 's' END AS shown
    FROM lineitem
    """,
)
def format_duration(spark: SparkSession, folder: str) -> DataFrame:
    seconds = F.when(F.col("l_quantity") != 1, F.col("l_extendedprice"))
    return table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", duration_text(seconds).alias("shown"))


@query(
    "parse_duration",
    """
    SELECT event_id, round(CASE event_type WHEN 'click' THEN user_id * 3600 + 2 * 60 + value WHEN 'error' THEN user_id * 60.0
                                WHEN 'view' THEN 0.0 ELSE 5 * 60 + value END, 6) AS seconds
    FROM events
    """,
)
def parse_duration(spark: SparkSession, folder: str) -> DataFrame:
    kind, value = F.col("event_type"), F.format_string("%.3f", "value")
    text = (
        F.when(kind == "click", F.concat("user_id", F.lit("h2m"), value, F.lit("s")))
        .when(kind == "error", F.concat("user_id", F.lit("m")))
        .when(kind == "view", F.lit("unknown"))
        .otherwise(F.concat(F.lit("5m"), value, F.lit("999s")))
    )
    return table(spark, folder, "events").select("event_id", F.round(duration_seconds(text), 6).alias("seconds"))


@query(
    "slug_names",
    r"""
    SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9]', '_', 'g') AS slug, string_split(url, '/')[-1] AS last FROM pages
    """,
)
def slug_names(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return pages.select("page_id", slug(F.col("url")).alias("slug"), last_segment(F.col("url")).alias("last"))


@query(
    "zip_lines",
    f"""
    WITH lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS i,
                          {_TRIM.format('unnest(string_split(text, chr(10)))')} AS line FROM documents),
    a AS (SELECT line, row_number() OVER (ORDER BY doc_id, i) - 1 AS n FROM lines WHERE line <> ''),
    b AS (SELECT text, row_number() OVER (ORDER BY conv_id, turn) - 1 AS n FROM conversations)
    SELECT a.n AS line_number, line, text FROM a JOIN b USING (n)
    """,
)
def zip_lines(spark: SparkSession, folder: str) -> DataFrame:
    zipped, _ = _zipped(spark, folder)
    return zipped.select(F.col("line").alias("line"), "text", "line_number")


def _zipped(spark: SparkSession, folder: str) -> tuple[DataFrame, dict[str, int]]:
    docs = table(spark, folder, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    return records.zip_lines_counted(records.clean_lines(lines, "line"), turns, ["doc_id", "i"], ["conv_id", "turn"])


@query(
    "zip_counts",
    f"""
    WITH a AS (SELECT count(*) AS n FROM (SELECT {_TRIM.format('unnest(string_split(text, chr(10)))')} AS line FROM documents) WHERE line <> ''),
    b AS (SELECT count(*) AS m FROM conversations)
    SELECT n AS "left", m AS "right", least(n, m) AS paired, abs(n - m) AS cut, least(n, m) AS "rows" FROM a, b
    """,
)
def zip_counts(spark: SparkSession, folder: str) -> DataFrame:
    """What the zip reports about its two sides, beside the rows that come out."""
    zipped, counts = _zipped(spark, folder)
    told = [F.lit(counts[name]).cast("bigint").alias(name) for name in ("left", "right", "paired", "cut")]
    return zipped.agg(F.count(F.lit(1)).alias("rows")).select(*told, "rows")
