"""Line deduplication: repeated runs of lines are found with a suffix array over line ids; later copies go.

Distinct repeated lines are numbered in order; a line that occurs once ends every run. Prefix doubling then
ranks the suffixes by their first 2, 4, 8, ... lines: the rank of ``2h`` lines is the place of the pair of ranks of ``h``
lines among all such pairs, from one range sort. Suffixes of equal rank are an interval of the suffix array with
a common prefix of at least that length. A suffix whose pair occurs once is alone and leaves the sort.

A run counts if it has ``min_words`` words. The shortest runs with that many words that begin, or end, at each line
cover every longer run, so the doubling stops at the longest of those. An interval of such a run, given by the ranks of its first
and last ``h`` lines, has its earliest copy as its smallest position, and all others are deleted. Adjoining and overlapping
intervals add up to the maximal repeated runs. All of it is DataFrame code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lathework.llm.common import Scratch
from lathework.operators.ordering import with_row_index

#: Low bits of a position: the line's number in its document, above them the document's number.
LINE_BITS = 28
#: A word is a run of characters that are no ASCII blanks.
_WORD = r"[^\x20\x09-\x0D]+"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _blocks(repeated: DataFrame, min_words: int) -> DataFrame:
    """``pos, size``: shortest stretches of repeated lines with ``min_words`` words from, and to, each line.

    ``repeated`` has ``n, i, w``: document, line and words. Boundaries between lines carry the words before them,
    so both ends are a running minimum or maximum over boundaries ordered by words. A window holds one document's lines.
    """
    doc = Window.partitionBy("n").orderBy("i")
    before = F.coalesce(F.sum("w").over(doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = repeated.select(
        "n", "i", "w", before.alias("c"), (F.col("i") - F.row_number().over(doc)).alias("stretch"),
        F.lead("i").over(doc).alias("after"),
    )
    last = F.col("after").isNull() | (F.col("after") != F.col("i") + 1)
    ends = F.array(
        F.struct("i", "c"),
        F.when(last, F.struct((F.col("i") + 1).alias("i"), (F.col("c") + F.col("w")).alias("c"))),
    )
    bounds = placed.select("n", "stretch", F.explode(F.array_compact(ends)).alias("b")).select("n", "stretch", "b.i", "b.c")
    stretch = Window.partitionBy("n", "stretch")
    reach = (Window.unboundedPreceding, -min_words)
    found = bounds.select(
        "n", "i",
        F.min("i").over(stretch.orderBy((-F.col("c")).alias("d")).rangeBetween(*reach)).alias("to"),
        F.max("i").over(stretch.orderBy("c").rangeBetween(*reach)).alias("from"),
    )
    both = found.select(
        "n", F.explode(F.array(F.struct(F.col("i").alias("a"), F.col("to").alias("z")), F.struct(F.col("from").alias("a"), F.col("i").alias("z")))).alias("x")
    ).where("x.a is not null and x.z is not null")
    pos = F.shiftleft("n", LINE_BITS) + F.col("x.a")
    return both.select(pos.alias("pos"), (F.col("x.z") - F.col("x.a")).cast("long").alias("size")).distinct()


def repeated_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50) -> DataFrame:
    """``k, h, removed``: lines (0-based, ascending) of later copies, by key and digest of the text.

    Only documents that lose a line appear. The order of copies is key (null first), digest, line.
    """
    if min_words < 1:
        raise ValueError("min_words must be positive")
    scratch = Scratch(docs.sparkSession)
    whole = docs.select(docs[f"`{key}`"].alias("k"), docs[f"`{text}`"].alias("t")).where("t is not null")
    lines = _lines(F.col("t"))
    arrays = whole.select(
        "k", F.md5("t").alias("h"),
        F.transform(lines, lambda x: F.unhex(F.md5(x))).alias("ids"),
        F.transform(lines, lambda x: F.regexp_count(x, F.lit(_WORD))).alias("words"),
    ).dropDuplicates(["k", "h"])
    numbered = with_row_index(arrays, ["k", "h"], name="n")
    every = numbered.select("n", F.posexplode(F.arrays_zip("ids", "words")).alias("i", "line")).select(
        "n", "i", F.col("line.ids").alias("id"), F.col("line.words").alias("w")
    )
    twice = every.groupBy("id").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").select("id")
    repeated = every.join(with_row_index(twice, ["id"], name="r"), "id")
    repeated = scratch.keep(
        repeated.select((F.shiftleft("n", LINE_BITS) + F.col("i")).alias("pos"), "n", "i", "w", "r"), "repeated-lines"
    )
    blocks = scratch.keep(
        _blocks(repeated.select("n", "i", "w"), min_words).withColumn("level", F.floor(F.log2("size"))), "blocks"
    )
    top = blocks.agg(F.max("level")).first()[0]
    ranks, found = repeated.select("pos", "r"), []
    for level in range(0, (-1 if top is None else top) + 1):
        length = 1 << level
        here = blocks.where(F.col("level") == level).join(ranks, "pos")
        second = ranks.select((F.col("pos") + length).alias("end"), F.col("r").alias("r2"))
        if level:
            here = here.withColumn("end", F.col("pos") + F.col("size")).join(second, "end")
        else:
            here = here.withColumn("r2", F.col("r"))
        here = scratch.keep(here.select("pos", "size", "r", "r2"), "ranked-blocks")
        interval = here.groupBy("size", "r", "r2").agg(F.min("pos").alias("earliest"), F.count(F.lit(1)).alias("copies"))
        later = here.join(interval.where("copies > 1"), ["size", "r", "r2"]).where("pos > earliest")
        found.append(later.select("pos", "size"))
        if level < top:
            paired = ranks.join(ranks.select((F.col("pos") - length).alias("pos"), F.col("r").alias("r2")), "pos")
            paired = scratch.keep(paired, "pairs")
            shared = paired.groupBy("r", "r2").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
            ordered = with_row_index(shared.select("r", "r2"), ["r", "r2"], name="rank")
            ranks = scratch.keep(
                paired.join(ordered, ["r", "r2"]).select("pos", F.col("rank").alias("r")), "suffix-ranks"
            )
    if not found:
        return numbered.where("false").select("k", "h", F.array().cast("array<int>").alias("removed"))
    runs = found[0]
    for more in found[1:]:
        runs = runs.union(more)
    first = F.col("pos").bitwiseAND((1 << LINE_BITS) - 1).cast("int")
    # runs overlap, one may start at every line: they open and close, and what is open somewhere goes, each line once
    opens = F.struct(first.alias("i"), F.lit(1).alias("d"))
    closes = F.struct((first + F.col("size").cast("int")).alias("i"), F.lit(-1).alias("d"))
    edges = runs.select(F.shiftright("pos", LINE_BITS).alias("n"), F.explode(F.array(opens, closes)).alias("e"))
    steps = edges.groupBy("n", "e.i").agg(F.sum("e.d").alias("d"))
    along = Window.partitionBy("n").orderBy("i")
    open_now = F.sum("d").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("open")
    spans = steps.select("n", "i", open_now, F.lead("i").over(along).alias("z")).where("open > 0")
    gone = spans.groupBy("n").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("i", "z"))), lambda s: F.sequence(s["i"], s["z"] - 1))).alias("removed")
    )
    return scratch.keep(numbered.select("n", "k", "h").join(gone, "n").select("k", "h", "removed"), "removed-lines")


def drop_repeated_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_words: int = 50,
    removed_count: str | None = None, keep_emptied: bool = True,
) -> DataFrame:
    """The documents without later copies of repeated line runs of at least ``min_words`` words.

    The first copy of each run stays, wherever the others are, in the same document too; copies may overlap. A line goes only
    if the same line stays elsewhere. A document that loses all its lines has an empty text, or goes if ``keep_emptied``
    is false. Null and empty texts stay as they are. Rows that repeat key and text are one document
    and come back as often, alike. Null keys order first. All columns stay; ``removed_count`` adds the number of deleted lines.
    """
    removed = repeated_lines(docs, key, text, min_words)
    rows = docs.select(
        F.struct("*").alias("row"), docs[f"`{key}`"].alias("k0"), F.md5(docs[f"`{text}`"]).alias("h0")
    )
    # a merge join whatever the sizes: texts move once, in proportion to the input
    matched = rows.join(removed.hint("merge"), F.col("k").eqNullSafe(F.col("k0")) & (F.col("h") == F.col("h0")), "left")
    body = F.col("row").getField(text)
    lines = _lines(body)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))
    after = F.when(F.col("removed").isNull(), body).otherwise(F.array_join(F.transform(kept, lambda i: lines[i]), "\n"))
    if not keep_emptied:
        matched = matched.where(F.col("removed").isNull() | (F.size("removed") < F.size(lines)))
    out = [(after.alias(c) if c == text else F.col("row").getField(c).alias(c)) for c in docs.columns]
    if removed_count:
        out.append(F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias(removed_count))
    return matched.select(*out)
