"""Line-first quality rules, in DataFrame functions only.

Every line is judged by itself (punctuation, navigation, boilerplate); failing lines are taken out, and
a document that loses too much of its text is rejected, as is one that fails the whole-text rules
(too few words, or too many words in repeated windows).

Defined results: a null or empty text has no words, so it fails the base rule and is rejected; repeated
rows are judged one by one; ties cannot arise; extra columns pass through ``filter_documents`` and are
dropped by ``judge``.  No step moves rows between tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import WHITE

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: A document is rejected when its failing lines hold more than this share of its text.
MAX_LOST_PERCENT = 50

SYMBOLS = "#*$%&|<>"
_SPACES = r"[\x20\x09-\x0D]+"
#: A line of fewer words than this must end a sentence.
SHORT_LINE = 8
ENDS = r"""[.!?:;\x22')\]…。！？”’»][\x20\x09-\x0D]*$"""
BARS = "|»›•"
BOILERPLATE = (
    r"(?i)(lorem ipsum|all rights reserved|privacy policy|cookie policy|we use cookies|accept cookies|terms of (use|service)"
    r"|enable javascript|sign up for|subscribe to our|click here to|share on (facebook|twitter)|powered by|back to top)"
)


def words_of(text: Column) -> Column:
    """The words of a text as an array."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(WHITE))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, _SPACES, -1))


def _count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _fails(line: Column) -> Column:
    """Whether a line is to be removed."""
    size = F.length(line)
    n_words = F.size(F.split(F.btrim(line, F.lit(WHITE)), _SPACES, -1))
    bars = _count_of(line, BARS)
    punctuation = (n_words < SHORT_LINE) & ~line.rlike(ENDS) | (_count_of(line, SYMBOLS) * 10 > size)
    navigation = (bars >= 3) & (n_words <= (bars + 1) * 4)
    boilerplate = (n_words <= 25) & line.rlike(BOILERPLATE)
    return punctuation | navigation | boilerplate


def _with_measures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns, then the measures; each project is used more than once, so it stays separate."""
    text = F.coalesce(F.col("text"), F.lit(""))
    step = docs.select(*keep, text.alias("_text"), words_of(F.col("text")).alias("_words"), F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(WHITE)) != "").alias("_lines"))
    n = F.size("_words")
    step = step.select(
        *keep, "_text", "_lines", n.alias("_n"),
        F.when(n >= WINDOW, F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW)))).alias("_hashes"),
    )
    step = step.select(
        "*",
        F.when(F.size(F.array_distinct("_hashes")) < F.size("_hashes"), F.array_sort(F.transform("_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_order"),
        F.filter("_lines", lambda x: ~_fails(x)).alias("_good"),
    )
    same = lambda e, j: (F.get(F.col("_order"), j - 1)["h"] == e["h"]) | (F.get(F.col("_order"), j + 1)["h"] == e["h"])
    step = step.select("*", F.array_sort(F.transform(F.filter("_order", lambda e, j: F.coalesce(same(e, j), F.get(F.col("_order"), j - 1)["h"] == e["h"], F.get(F.col("_order"), j + 1)["h"] == e["h"], F.lit(False))), lambda e: e["i"])).alias("_again"))
    gap = F.transform("_again", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_again"), k + 1) - p, F.lit(WINDOW))))
    total = lambda lines: F.aggregate(lines, F.lit(0).cast("long"), lambda acc, x: acc + F.length(x))
    step = step.select(
        *keep, "_text", "_good",
        F.col("_n").cast("long").alias("n_words"),
        F.length(F.translate("_text", WHITE, "")).cast("long").alias("word_chars"),
        _count_of(F.col("_text"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(gap, F.lit(0), lambda acc, x: acc + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        total(F.col("_lines")).alias("_all_chars"),
        total(F.col("_good")).alias("_good_chars"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    lost = F.col("_all_chars") - F.col("_good_chars")
    return step.withColumn("base_failed", failed).withColumn("lost_chars", lost).withColumn("kept", ~failed & (lost * 100 <= F.col("_all_chars") * MAX_LOST_PERCENT))


def judge(docs: DataFrame) -> DataFrame:
    """One row per document: its measures, whether the base rules fail, and the final verdict."""
    return _with_measures(docs, ["doc_id"]).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")


def filter_documents(docs: DataFrame) -> DataFrame:
    """The documents that are kept, without their failing lines; ``n_chars`` follows the new text."""
    names = docs.columns
    packed = docs.select("text", F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"))
    out = _with_measures(packed, ["_row"])
    blank = lambda x: F.btrim(x, F.lit(WHITE)) == ""
    cleaned = F.when(F.col("lost_chars") == 0, F.col("_text")).otherwise(F.array_join(F.filter(F.split("_text", "\n", -1), lambda x: blank(x) | ~_fails(x)), "\n"))
    # A generator and not a filter: a filter would be pushed below the projects and measure every text again.
    out = out.select(F.inline(F.when(F.col("kept"), F.array(F.struct("_row", cleaned.alias("_clean"))))))
    new = {"text": F.col("_clean"), "n_chars": F.length("_clean").cast("long")}
    return out.select(*(new.get(c, F.col(f"_row.`{c}`")).alias(c) for c in names))
