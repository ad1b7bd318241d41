"""Queries: scores, judgements and batch inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lathework.functions.templates import render
from lathework.functions.text import clamp_at_zero, grade, rescale, two_decimals, word_count
from lathework.operators import inference, mixing, records, retrieval, scoring
from lathework.operators import messages as M
from lathework.plans.prepare import exploded
from lathework.plans.registry import query, table
from lathework.session import materialize, scratch_path
from lathework.sources import writers


def six(column: str) -> Column:
    return F.round(column, 6).alias(column)


LOWER = "abcdefghijklmnopqrstuvwxyz"  # engines differ in the capitals of other letters


def scored_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents as gold answers; predictions differ from them in a way that depends on the language."""
    text, lang = F.col("text"), F.col("lang")
    even = F.col("n_chars") % 2 == 0
    prediction = (
        F.when((lang == "en") & even, F.replace(text, F.lit(" and "), F.lit(" or ")))
        .when(lang == "en", F.concat(F.translate(text, LOWER, LOWER.upper()), F.lit("!")))
        .when(lang == "fr", F.regexp_replace(text, r"\s+\S+\s*$", ""))
        .when(lang == "de", F.concat_ws(" ", text, F.col("source")))
        .otherwise(text)
    )
    docs = table(spark, folder, "documents", costly=True)
    return docs.select("doc_id", "lang", prediction.alias("prediction"), text.alias("gold"))


_PAIRS = r"""
    pairs AS (SELECT doc_id, lang, text AS gold, CASE
                WHEN lang = 'en' AND n_chars % 2 = 0 THEN replace(text, ' and ', ' or ')
                WHEN lang = 'en' THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || '!'
                WHEN lang = 'fr' THEN regexp_replace(text, '\s+\S+\s*$', '')
                WHEN lang = 'de' THEN text || ' ' || source
                ELSE text END AS prediction FROM documents)
"""
_KEY = r"""regexp_replace(lower({0}), '[!-/:-@\[-`{{-~]', '', 'g')"""


@query(
    "exact_match",
    f"""
    WITH {_PAIRS}
    SELECT lang, count(*) AS n,
           round(avg(CASE WHEN {_KEY.format('prediction')} = {_KEY.format('gold')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6)
             AS exact_match
    FROM pairs GROUP BY lang
    """,
)
def exact_match(spark: SparkSession, folder: str) -> DataFrame:
    pairs = scored_pairs(spark, folder)
    match = scoring.exact_match(F.col("prediction"), F.col("gold"))
    return pairs.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg(match), 6).alias("exact_match")
    )


def _tokens_13a(column: str) -> str:
    text = f"replace(regexp_replace({column}, '<skipped>|-\\n', '', 'g'), chr(10), ' ')"
    for entity, mark in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = f"replace({text}, '{entity}', '{mark}')"
    text = f"(' ' || {text} || ' ')"
    text = rf"regexp_replace({text}, '([!-&(-+:-@/\[-`{{-~])', ' \1 ', 'g')"
    text = rf"regexp_replace({text}, '([^0-9])([.,])', '\1 \2 ', 'g')"
    text = rf"regexp_replace({text}, '([.,])([^0-9])', ' \1 \2', 'g')"
    text = rf"regexp_replace({text}, '([0-9])(-)', '\1 \2 ', 'g')"
    return rf"list_filter(regexp_split_to_array({text}, '\s+'), lambda w: w <> '')"


_BLEU = f"""
    tokens AS (SELECT doc_id, lang, {_tokens_13a('prediction')} AS p, {_tokens_13a('gold')} AS r FROM pairs),
    sides AS (SELECT doc_id, lang, 0 AS side, unnest(p) AS w, generate_subscripts(p, 1) AS i FROM tokens
              UNION ALL SELECT doc_id, lang, 1, unnest(r), generate_subscripts(r, 1) FROM tokens),
    ahead AS (SELECT *, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4
              FROM sides WINDOW o AS (PARTITION BY doc_id, side ORDER BY i)),
    grams AS (SELECT doc_id, lang, side, 1 AS n, w AS gram FROM ahead
              UNION ALL SELECT doc_id, lang, side, 2, w || ' ' || w2 FROM ahead WHERE w2 IS NOT NULL
              UNION ALL SELECT doc_id, lang, side, 3, w || ' ' || w2 || ' ' || w3 FROM ahead WHERE w3 IS NOT NULL
              UNION ALL SELECT doc_id, lang, side, 4, w || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM ahead WHERE w4 IS NOT NULL),
    counted AS (SELECT doc_id, lang, n, gram, count(*) FILTER (side = 0) AS cp, count(*) FILTER (side = 1) AS cr
                FROM grams GROUP BY ALL),
    matches AS (SELECT lang, n, sum(least(cp, cr)) AS m, sum(cp) AS possible FROM counted GROUP BY lang, n),
    logs AS (SELECT lang, avg(ln(m / possible::DOUBLE)) AS l, min(m) AS lowest FROM matches GROUP BY lang),
    lengths AS (SELECT lang, CAST(sum(len(p)) AS BIGINT) AS prediction_length, CAST(sum(len(r)) AS BIGINT) AS reference_length
                FROM tokens GROUP BY lang),
    bleus AS (SELECT lang, prediction_length, reference_length, CASE WHEN lowest = 0 THEN 0.0::DOUBLE ELSE
                exp(l) * CASE WHEN prediction_length > reference_length THEN 1.0
                              ELSE exp(1 - reference_length / prediction_length::DOUBLE) END END AS bleu
              FROM logs JOIN lengths USING (lang))
"""


@query(
    "corpus_bleu",
    f"WITH {_PAIRS}, {_BLEU} SELECT lang, prediction_length, reference_length, round(bleu, 6) AS bleu FROM bleus",
)
def corpus_bleu(spark: SparkSession, folder: str) -> DataFrame:
    pairs = scored_pairs(spark, folder)
    pairs = pairs.withColumn("references", F.array("gold"))
    counts = scoring.bleu_counts(pairs, "doc_id", "prediction", "references", keep=["lang"])
    bleu = scoring.bleu_from_counts(counts, ["lang"])
    return bleu.select("lang", "prediction_length", "reference_length", six("bleu"))


_COUNT = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> ''))"
_ASKED = f"""
    asked AS (SELECT doc_id, source, text, row_number() OVER (ORDER BY doc_id) - 1 AS i, 'Repeat this:' || chr(10) || text AS prompt
              FROM documents),
    answered AS (SELECT i, text, CASE WHEN contains(prompt, '@') THEN '**ERROR**: address in text' ELSE replace(text, ' and ', ' or ') END
                   AS answer
                 FROM asked WHERE {_COUNT.format('prompt')} <= 1000)
"""


def stub_repeat(messages) -> str:
    """A stand-in for a model: repeats the text with one word changed, and fails on texts that hold an @."""
    text = messages[-1]["content"]
    if "@" in text:
        raise ValueError("address in text")
    return text.partition("\n")[2].replace(" and ", " or ")


def repeated(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", costly=True).select("doc_id", "text")
    return inference.inference_rows(docs, stub_repeat, "Repeat this:\n{context}", "text", "text", ["doc_id"], max_tokens=1000)


@query(
    "inference_rows",
    f"""
    WITH {_ASKED}
    SELECT i::VARCHAR AS context_document_id, answer AS llm_inference, text AS gold, text AS context_document,
           'Repeat this:' || chr(10) || '{{context}}' AS prompt_template
    FROM answered
    """,
)
def inference_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = repeated(spark, folder)
    gold = F.get("gold_standard_result", F.lit(0)).alias("gold")
    return rows.select("context_document_id", "llm_inference", gold, "context_document", "prompt_template")


@query(
    "metric_run",
    f"""
    WITH {_ASKED},
    pairs AS (SELECT i AS doc_id, 'all' AS lang, text AS gold, answer AS prediction FROM answered WHERE NOT starts_with(answer, '**ERROR**')),
    {_BLEU},
    e AS (SELECT avg(CASE WHEN {_KEY.format('prediction')} = {_KEY.format('gold')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS x FROM pairs)
    SELECT round(x, 4) AS exact_match, round(bleu, 4) AS bleu FROM bleus, e
    """,
)
def metric_run(spark: SparkSession, folder: str) -> DataFrame:
    """Ask, keep the answers as a table so that no call is repeated, then score them."""
    answers = materialize(repeated(spark, folder), "answers")
    return scoring.metric_summary(answers, on_error="drop")


@query(
    "embedding_prf",
    """
    WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
    pairs AS (SELECT a.vec_id, a.e AS p, b.e AS r FROM v a JOIN v b ON b.vec_id = a.vec_id + 1),
    sims AS (SELECT vec_id, i, j, list_cosine_similarity(p[i * 8 + 1:i * 8 + 8], r[j * 8 + 1:j * 8 + 8]) AS s
             FROM pairs, (SELECT unnest(range(8)) AS i), (SELECT unnest(range(8)) AS j)),
    ps AS (SELECT vec_id, avg(s) AS x FROM (SELECT vec_id, i, max(s) AS s FROM sims GROUP BY vec_id, i) GROUP BY vec_id),
    rs AS (SELECT vec_id, avg(s) AS y FROM (SELECT vec_id, j, max(s) AS s FROM sims GROUP BY vec_id, j) GROUP BY vec_id)
    SELECT vec_id, round(greatest(x, 0), 6) AS precision, round(greatest(y, 0), 6) AS recall,
           round(greatest(2 * x * y / (x + y), 0), 6) AS f1
    FROM ps JOIN rs USING (vec_id)
    """,
)
def embedding_prf(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings")
    tokens = v.select("vec_id", records.reshape_vector(F.col("embedding"), 8).alias("tokens"))
    other = tokens.select((F.col("vec_id") - 1).alias("vec_id"), F.col("tokens").alias("reference"))
    scored = scoring.embedding_match(tokens.join(other, "vec_id"), "tokens", "reference")
    return scored.select("vec_id", six("precision"), six("recall"), six("f1"))


def _summary(spark: SparkSession, folder: str) -> DataFrame:
    pairs = scored_pairs(spark, folder).select(
        "lang",
        scoring.exact_match(F.col("prediction"), F.col("gold")).alias("accuracy"),
        (F.length("prediction") / F.length("gold")).alias("length_ratio"),
    )
    return scoring.mean_summary(pairs, ["accuracy", "length_ratio"], ["lang"])


_SUMMARY = f"""
    {_PAIRS},
    summary AS (SELECT lang,
             round(avg(CASE WHEN {_KEY.format('prediction')} = {_KEY.format('gold')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4)
               AS accuracy,
             round(avg(length(prediction) / length(gold)::DOUBLE), 4) AS length_ratio FROM pairs GROUP BY lang)
"""


@query("eval_summary", f"WITH {_SUMMARY} SELECT lang, accuracy, length_ratio FROM summary")
def eval_summary(spark: SparkSession, folder: str) -> DataFrame:
    return _summary(spark, folder)


@query(
    "metrics_long",
    f"""
    WITH {_SUMMARY}
    SELECT 'eval' AS experiment, lang AS run, 'accuracy' AS metric, accuracy AS value FROM summary
    UNION ALL SELECT 'eval', lang, 'length_ratio', length_ratio FROM summary
    """,
)
def metrics_long(spark: SparkSession, folder: str) -> DataFrame:
    summary = _summary(spark, folder).select(F.lit("eval").alias("experiment"), F.col("lang").alias("run"), "accuracy", "length_ratio")
    return scoring.metrics_long(summary, ["experiment", "run"], ["accuracy", "length_ratio"])


@query(
    "metrics_append",
    f"""
    WITH {_SUMMARY},
    long AS (SELECT lang AS run, 'accuracy' AS metric, accuracy AS value FROM summary UNION ALL SELECT lang, 'length_ratio', length_ratio FROM summary)
    SELECT 'eval' AS experiment, run, metric, value FROM long
    UNION ALL SELECT 'again', run, metric, value FROM long WHERE run >= 'e'
    """,
)
def metrics_append(spark: SparkSession, folder: str) -> DataFrame:
    """A shared metric table: an experiment appended, another one beside it, and runs of the first written once more."""
    rows, path = metrics_long(spark, folder), scratch_path(spark, "metrics")
    keys = ["experiment", "run"]
    writers.store_runs(rows, path, keys)
    writers.store_runs(rows.where("run >= 'e'").withColumn("experiment", F.lit("again")), path, keys)
    writers.store_runs(rows.where("run < 'f'"), path, keys)
    return writers.read_runs(spark, path, rows)


@query(
    "score_histogram",
    """
    WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, avg(o_totalprice) AS mean FROM orders),
    b AS (SELECT CAST(least(floor((o_totalprice - lo) / ((hi - lo) / 20)), 19) AS INTEGER) AS bin, count(*) AS c
          FROM orders, r GROUP BY 1)
    SELECT CAST(i AS INTEGER) AS bin, round(lo + (hi - lo) / 20 * i, 4) AS bin_start,
           round(lo + (hi - lo) / 20 * (i + 1), 4) AS bin_end, coalesce(c, 0) AS count, round(mean, 4) AS mean
    FROM (SELECT unnest(range(20)) AS i) CROSS JOIN r LEFT JOIN b ON b.bin = i
    """,
)
def score_histogram(spark: SparkSession, folder: str) -> DataFrame:
    bins = scoring.histogram(table(spark, folder, "orders"), "o_totalprice")
    return bins.select("bin", "count", *[F.round(c, 4).alias(c) for c in ("bin_start", "bin_end", "mean")])


@query(
    "judge_summary",
    """
    WITH last AS (SELECT user_id, arg_max(1 + CAST(json_extract(props, '$.k') AS INTEGER) % 10, event_id) AS g
                  FROM events GROUP BY user_id)
    SELECT round(avg(g), 6) AS mean_grade, (SELECT count(DISTINCT c_custkey) FROM customer) AS candidates,
           count(*) AS judged, (SELECT count(DISTINCT c_custkey) FROM customer) - count(*) AS missing
    FROM last
    """,
)
def judge_summary(spark: SparkSession, folder: str) -> DataFrame:
    judged = table(spark, folder, "events").select(
        F.col("user_id").alias("c_custkey"),
        "event_id",
        (1 + F.get_json_object("props", "$.k").cast("int") % 10).alias("grade"),
    )
    summary = inference.judge_summary(table(spark, folder, "customer"), judged, "c_custkey", "grade", ["event_id"])
    return summary.select(six("mean_grade"), "candidates", "judged", "missing")


_WORDS = _COUNT.format("text")


@query(
    "run_counters",
    f"""
    WITH d AS (SELECT {_WORDS} > 256 AS excluded, n_chars % 19 = 0 AS failed FROM documents)
    SELECT count(*) AS total, count(*) FILTER (NOT excluded) AS processed, count(*) FILTER (excluded) AS excluded,
           count(*) FILTER (NOT excluded AND failed) AS errors FROM d
    """,
)
def run_counters(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return scoring.run_counters(docs, word_count(F.col("text")) > 256, F.col("n_chars") % 19 == 0)


@query(
    "attach_gold",
    """
    SELECT doc_id, 'quality ' || quality AS llm_inference, source AS gold, text AS context_document
    FROM labels JOIN documents USING (doc_id)
    """,
)
def attach_gold(spark: SparkSession, folder: str) -> DataFrame:
    answers = table(spark, folder, "labels").select("doc_id", F.concat(F.lit("quality "), "quality").alias("llm_inference"))
    docs = table(spark, folder, "documents").select("doc_id", F.col("source").alias("gold"), F.col("text").alias("context_document"))
    return scoring.attach_gold(answers, docs, "doc_id")


@query(
    "before_after",
    """
    SELECT doc_id, quality / 2.0::DOUBLE AS before, toxic / 4.0::DOUBLE AS after,
           toxic / 4.0::DOUBLE - quality / 2.0::DOUBLE AS change FROM labels
    """,
)
def before_after(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels")
    before = labels.select("doc_id", F.lit("before").alias("phase"), (F.col("quality") / 2).alias("score"))
    after = labels.select("doc_id", F.lit("after").alias("phase"), (F.col("toxic") / 4).alias("score"))
    return scoring.before_after(mixing.concat(before, after), ["doc_id"], "phase", "score")


@query(
    "softmax_scores",
    """
    WITH c AS (SELECT label AS class, arg_min(embedding, vec_id)::DOUBLE[] AS e FROM embeddings GROUP BY label),
    s AS (SELECT vec_id, class, 100 * list_dot_product(embedding::DOUBLE[], e) AS x FROM embeddings, c),
    m AS (SELECT *, exp(x - max(x) OVER w) AS p, x = max(x) OVER w AS is_top FROM s WINDOW w AS (PARTITION BY vec_id))
    SELECT vec_id, class, round(p / sum(p) OVER (PARTITION BY vec_id), 6) AS probability, is_top FROM m
    """,
)
def softmax_scores(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings")
    classes = v.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("e"))
    scored = retrieval.class_scores(v.select("vec_id", "embedding"), "embedding", classes, "label", "e")
    out = scoring.softmax_rows(scored, ["vec_id"], "score", 100.0)
    return out.select("vec_id", "class", F.round("probability", 6).alias("probability"), "is_top")


@query(
    "softmax_long",
    """
    WITH m AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_returnflag, l_discount,
                      exp(20 * (l_discount - max(l_discount) OVER w)) AS p, l_discount = max(l_discount) OVER w AS is_top
               FROM lineitem WINDOW w AS (PARTITION BY l_suppkey, l_returnflag))
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round(p / sum(p) OVER (PARTITION BY l_suppkey, l_returnflag), 6) AS probability,
           is_top FROM m
    """,
)
def softmax_long(spark: SparkSession, folder: str) -> DataFrame:
    """Softmax and best flag over rows: line items as the candidates of a supplier and flag."""
    items = table(spark, folder, "lineitem")
    scored = scoring.softmax_rows(items, ["l_suppkey", "l_returnflag"], "l_discount", 20.0)
    return scored.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", six("probability"), "is_top")


@query(
    "keyword_score",
    """
    WITH s AS (SELECT lang, CASE WHEN contains(lower(text), lower(source)) OR contains(lower(text), 'ould')
                                 OR contains(lower(text), lang || 's') THEN 1 ELSE 0 END AS score FROM documents)
    SELECT lang, CAST(sum(score) AS BIGINT) AS score, count(*) AS asked FROM s GROUP BY lang
    """,
)
def keyword_score(spark: SparkSession, folder: str) -> DataFrame:
    expected = F.array(F.col("source"), F.lit("OULD"), F.concat("lang", F.lit("S")))
    scored = scoring.keyword_scores(table(spark, folder, "documents").withColumn("expected", expected), "text", "expected")
    return scored.groupBy("lang").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("asked"))


@query(
    "uniqueness",
    """
    SELECT lang, count(*) AS total, count(DISTINCT text) AS "unique",
           round(count(DISTINCT text) / count(*)::DOUBLE, 6) AS uniqueness FROM documents GROUP BY lang
    """,
)
def uniqueness(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("lang", F.sha2("text", 256).alias("item"))
    return scoring.uniqueness(docs, "item", ["lang"]).select("lang", "total", "unique", six("uniqueness"))


@query(
    "novelty_anti",
    """
    SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS
      (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')
    """,
)
def novelty_anti(spark: SparkSession, folder: str) -> DataFrame:
    known = table(spark, folder, "customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("o_custkey"))
    return scoring.novelty(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), known, "o_custkey")


@query(
    "single_gold_guard",
    "SELECT c_custkey, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_name END AS gold FROM customer",
)
def single_gold_guard(spark: SparkSession, folder: str) -> DataFrame:
    gold = F.when(F.col("c_mktsegment") == "MACHINERY", F.array("c_name", "c_mktsegment")).otherwise(F.array("c_name"))
    return table(spark, folder, "customer").select("c_custkey", scoring.single_gold(gold, strict=False).alias("gold"))


@query(
    "weighted_mean",
    """
    SELECT l_returnflag, round(sum(l_quantity), 6) AS weight,
           round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 6) AS mean FROM lineitem GROUP BY l_returnflag
    """,
)
def weighted_mean(spark: SparkSession, folder: str) -> DataFrame:
    means = scoring.weighted_mean(table(spark, folder, "lineitem"), "l_extendedprice", "l_quantity", ["l_returnflag"])
    return means.select("l_returnflag", six("weight"), six("mean"))


_SHOWN = """
    CASE WHEN n_chars % 19 = 0 THEN '**ERROR**: lost' WHEN n_chars % 13 = 0 THEN text || ' Rating: [[5]]'
         ELSE 'Grade: [[12]] ' || text || ' Grade: [[' || (1 + doc_id % 10) || ']] Grade: [[1]]' END
"""


def judge_answers(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    good = F.concat(F.lit("Grade: [[12]] "), text, F.lit(" Grade: [["), 1 + F.col("doc_id") % 10, F.lit("]] Grade: [[1]]"))
    answer = (
        F.when(F.col("n_chars") % 19 == 0, "**ERROR**: lost")
        .when(F.col("n_chars") % 13 == 0, F.concat(text, F.lit(" Rating: [[5]]")))
        .otherwise(good)
    )
    return table(spark, folder, "documents").select("doc_id", answer.alias("answer"))


@query(
    "grade_extract",
    f"""
    SELECT doc_id, TRY_CAST(nullif(regexp_extract(answer, 'Grade: \\[\\[([1-9]|10)\\]\\]', 1), '') AS INTEGER) AS grade
    FROM (SELECT doc_id, {_SHOWN} AS answer FROM documents)
    """,
)
def grade_extract(spark: SparkSession, folder: str) -> DataFrame:
    return judge_answers(spark, folder).select("doc_id", grade(F.col("answer")).alias("grade"))


@query(
    "judge_error_drop",
    f"SELECT doc_id, answer FROM (SELECT doc_id, {_SHOWN} AS answer FROM documents) WHERE NOT starts_with(answer, '**ERROR**')",
)
def judge_error_drop(spark: SparkSession, folder: str) -> DataFrame:
    return inference.drop_failed(judge_answers(spark, folder), "answer")


JUDGE_TEMPLATE = "Rate this.\n[Text]\n{context}\n[Answer]\n{answer}\nExplain:"
GRADE_REQUEST = "Give it as Grade: [[n]]."


@query(
    "judge_messages",
    """
    WITH a AS (SELECT doc_id, 'Rate this.' || chr(10) || '[Text]' || chr(10) || text || chr(10) || '[Answer]' || chr(10)
                      || source || chr(10) || 'Explain:' AS request, lang FROM documents)
    SELECT doc_id, 0 AS pos, 'user' AS role, request AS content FROM a
    UNION ALL SELECT doc_id, 1, 'assistant', 'written in ' || lang FROM a
    UNION ALL SELECT doc_id, 2, 'user', 'Give it as Grade: [[n]].' FROM a
    """,
)
def judge_messages(spark: SparkSession, folder: str) -> DataFrame:
    request = M.judge_request(JUDGE_TEMPLATE, F.col("text"), F.col("source"))
    both = M.judge_followup(request, F.concat(F.lit("written in "), "lang"), GRADE_REQUEST)
    return exploded(table(spark, folder, "documents").select("doc_id", both.alias("messages")), "doc_id")


def count_words(messages) -> str:
    """A stand-in for a model: counts the words of the last message and fails on texts that hold an @."""
    text = messages[-1]["content"]
    if "@" in text:
        raise ValueError("address in text")
    return f"{len(text.split())} words"


@query(
    "batch_infer_stub",
    f"""
    SELECT doc_id, CASE WHEN contains(text, '@') THEN '**ERROR**: address in text' ELSE {_WORDS} || ' words' END AS llm_inference
    FROM documents
    """,
)
def batch_infer_stub(spark: SparkSession, folder: str) -> DataFrame:
    asked = table(spark, folder, "documents", costly=True).select("doc_id", F.array(M.message("user", F.col("text"))).alias("messages"))
    return inference.batch_infer(asked, count_words, "messages").drop("messages")


def stub_judge(messages) -> str:
    """A stand-in for a judge: explains by word count, then turns that count into a grade."""
    if len(messages) == 1:
        return count_words(messages)
    words = int(messages[1]["content"].split()[0])
    return "no grade" if words % 7 == 0 else f"Grade: [[{1 + words % 10}]]"


@query(
    "judge_two_step",
    r"""
    WITH a AS (SELECT doc_id, text, 'Rate this.' || chr(10) || '[Text]' || chr(10) || text || chr(10) || '[Answer]' || chr(10)
                      || source || chr(10) || 'Explain:' AS request FROM documents),
    w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(request, '\s+'), lambda w: w <> '')) AS n FROM a
          WHERE NOT contains(request, '@'))
    SELECT doc_id, n || ' words' AS judge_explanation, CAST(1 + n % 10 AS INTEGER) AS judge_grade FROM w WHERE n % 7 <> 0
    """,
)
def judge_two_step(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", costly=True).select("doc_id", "text", "source")
    judged = inference.judge_two_step(docs, stub_judge, JUDGE_TEMPLATE, GRADE_REQUEST, "text", "source")
    return judged.select("doc_id", "judge_explanation", "judge_grade")


@query(
    "judge_accessors",
    r"""
    WITH a AS (SELECT doc_id, source, doc_id // 2 AS item, 'Rate this.' || chr(10) || '[Text]' || chr(10) || text || chr(10) || '[Answer]' || chr(10)
                      || source || chr(10) || 'Explain:' AS prompt FROM documents),
    w AS (SELECT *, len(list_filter(regexp_split_to_array(prompt, '\s+'), lambda w: w <> '')) AS n FROM a WHERE NOT contains(prompt, '@'))
    SELECT item, arg_max(CAST(1 + n % 10 AS INTEGER), doc_id) AS grade, arg_max(source, doc_id) AS generation,
           arg_max(n || ' words', doc_id) AS judgement, arg_max(prompt, doc_id) AS prompt FROM w WHERE n % 7 <> 0 GROUP BY item
    """,
)
def judge_accessors(spark: SparkSession, folder: str) -> DataFrame:
    """Two documents count as runs of one item; the later one is what the accessors show."""
    docs = table(spark, folder, "documents", costly=True).select(
        "doc_id", F.floor(F.col("doc_id") / 2).alias("item"), "text", F.col("source").alias("generation")
    )
    judged = inference.judge_two_step(docs, stub_judge, JUDGE_TEMPLATE, GRADE_REQUEST, "text", "generation")
    judged = judged.withColumn("prompt", render(JUDGE_TEMPLATE, {"context": F.col("text"), "answer": F.col("generation")}))
    judged = judged.withColumnsRenamed({"judge_grade": "grade", "judge_explanation": "judgement"})
    return inference.judged_fields(judged, "item", ["doc_id"], ["grade", "generation", "judgement", "prompt"])


@query("token_counts_injected", f"SELECT doc_id, CAST({_WORDS} AS INTEGER) AS n_tokens FROM documents")
def token_counts_injected(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts by a function of the caller."""
    counted = inference.token_counts(F.col("text"), lambda text: len(text.split()))
    return table(spark, folder, "documents", costly=True).select("doc_id", counted.alias("n_tokens"))


@query(
    "rounded_cells",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN o_orderpriority ELSE printf('%.2f', o_totalprice / 3) END AS cell FROM orders",
)
def rounded_cells(spark: SparkSession, folder: str) -> DataFrame:
    cell = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderpriority")).otherwise((F.col("o_totalprice") / 3).cast("string"))
    return table(spark, folder, "orders").select("o_orderkey", two_decimals(cell).alias("cell"))


@query(
    "clip_rescale",
    """
    SELECT o_orderkey, round(least(greatest((o_totalprice - 50000) / 350000 * 2 - 1, -1), 1), 6) AS scaled,
           round(greatest(o_totalprice - 250000, 0), 6) AS above FROM orders
    """,
)
def clip_rescale(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.round(rescale(price, 50000, 400000, -1, 1), 6).alias("scaled"),
        F.round(clamp_at_zero(price - 250000), 6).alias("above"),
    )
