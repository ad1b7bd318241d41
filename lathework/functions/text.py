"""Scalar text and number expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All blanks of Unicode: controls, separators, and the spaces of fixed width.
WHITESPACE = (
    " \t\n\r\f\x0b\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
)
# Fixed value: the ASCII punctuation marks removed before an exact-match comparison.
PUNCTUATION = r"[!-/:-@\[-`{-~]"
# Fixed value: the form in which a judge states its grade.
GRADE_PATTERN = r"Grade: \[\[([1-9]|10)\]\]"
ERROR_PREFIX = "**ERROR**"


def strip(text: Column) -> Column:
    """Trim every kind of blank, not only spaces."""
    return F.btrim(text, F.lit(WHITESPACE))


def words(text: Column) -> Column:
    """Blank-separated tokens. Every blank becomes a space first, as splitting at one plain character needs no pattern."""
    spaced = F.translate(text, WHITESPACE, " " * len(WHITESPACE))
    return F.filter(F.split(spaced, " "), lambda token: token != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def answer_key(text: Column, ignore_case: bool = True, ignore_punctuation: bool = True) -> Column:
    """The form in which two answers are compared for an exact match."""
    if ignore_case:
        text = F.lower(text)
    if ignore_punctuation:
        text = F.regexp_replace(text, PUNCTUATION, "")
    return text


def metric_tokens(text: Column) -> Column:
    """The public mteval-13a tokenisation used by BLEU."""
    text = F.regexp_replace(text, "<skipped>|-\n", "")
    text = F.replace(text, F.lit("\n"), F.lit(" "))
    for entity, mark in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        text = F.replace(text, F.lit(entity), F.lit(mark))
    text = F.concat(F.lit(" "), text, F.lit(" "))
    # every mark but the period, comma, hyphen and apostrophe stands alone
    text = F.regexp_replace(text, r"([!-&(-+:-@/\[-`{-~])", " $1 ")
    text = F.regexp_replace(text, r"([^0-9])([\.,])", "$1 $2 ")
    text = F.regexp_replace(text, r"([\.,])([^0-9])", " $1 $2")
    text = F.regexp_replace(text, r"([0-9])(-)", "$1 $2 ")
    return words(text)


def grade(answer: Column, pattern: str = GRADE_PATTERN) -> Column:
    """The first stated grade, NULL if the answer states none."""
    return F.regexp_extract(answer, pattern, 1).try_cast("int")


def is_error(answer: Column) -> Column:
    return answer.isNull() | answer.startswith(ERROR_PREFIX)


def duration_text(seconds: Column) -> Column:
    """Seconds as ``XmY.YYs``; NULL or NaN gives ``N/A``."""
    minutes = F.floor(seconds / 60)
    rest = seconds - minutes * 60
    shown = F.format_string("%dm%.2fs", minutes, rest)
    return F.when(seconds.isNull() | F.isnan(seconds), F.lit("N/A")).otherwise(shown)


def duration_seconds(text: Column) -> Column:
    """``1h2m3.4s`` to seconds; each part is optional, what is below a thousandth of a second is dropped."""

    def amount(unit: str, seconds: int) -> Column:
        number = F.regexp_extract(text, rf"([0-9.]+){unit}", 1).try_cast("decimal(18,9)")
        return F.coalesce(number, F.lit(0).cast("decimal(18,9)")).cast("double") * seconds

    whole = F.when(text.isNotNull(), amount("h", 3600) + amount("m", 60))
    return whole + F.floor(amount("s", 1) * 1000 + 1e-6) / 1000


def millions_text(value: Column) -> Column:
    return F.format_string("%.2fM", value.cast("double") / 1e6)


def two_decimals(cell: Column) -> Column:
    """A table cell that is a number with two decimals; any other text as it is."""
    number = cell.try_cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number), F.format_string("%.2f", number)).otherwise(cell)


def slug(name: Column) -> Column:
    return F.regexp_replace(name, "[^a-zA-Z0-9]", "_")


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def clamp_at_zero(value: Column) -> Column:
    return F.greatest(value, F.lit(0.0))


def rescale(value: Column, a_min: float, a_max: float, b_min: float, b_max: float) -> Column:
    """Map ``[a_min, a_max]`` to ``[b_min, b_max]`` and clip what falls outside."""
    scaled = (value - a_min) / (a_max - a_min) * (b_max - b_min) + b_min
    return F.least(F.greatest(scaled, F.lit(float(b_min))), F.lit(float(b_max)))


def contains_any(text: Column, keywords: Column) -> Column:
    """True if any keyword of the array occurs in the text, ignoring case."""
    lowered = F.lower(text)
    return F.exists(keywords, lambda keyword: F.contains(lowered, F.lower(keyword)))
