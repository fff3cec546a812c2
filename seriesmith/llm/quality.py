"""Line-first cleaning of documents, with DataFrame functions only.

Each line is judged by rules on punctuation, navigation and boilerplate; lines that fail are
removed; a document that loses too many of its words that way is rejected.  Measures of the whole
text (repetition, symbols, length) are computed beside it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, WORD

SYMBOLS = "[#*$%&|<>]"
#: Phrases of page furniture, in lower case (fixed values).
BOILERPLATE = [
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "use of cookies",
    "uses cookies", "enable javascript", "javascript is disabled", "click here", "sign up", "log in", "subscribe to",
    "share this", "read more", "skip to content", "back to top", "follow us", "lorem ipsum",
]
#: Share of the words that the removed lines may hold.
LOSS = 0.5


def words_of(text):
    """Array of the runs of characters other than ASCII white space; null gives none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, r"[\x20\x09-\x0D]+"))


def repeated_words(words):
    """Positions of ``words`` in three-word windows that occur twice or more in the array.

    Window hashes are sorted with their positions, so equal windows are neighbours; a window that
    recurs covers its three words, overlaps counted once.  XXH64 values stand for the windows of
    one text: all different for nearly every text, which then needs no sort."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - 2), lambda i: F.xxhash64(
        F.element_at(words, i), F.element_at(words, i + 1), F.element_at(words, i + 2)))


def measures(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = (docs.withColumn("__words", words_of(F.col(f"`{text_col}`"))).withColumn("__lines", lines)
           .withColumn("n_words", F.size("__words").cast("bigint"))
           .withColumn("word_chars", (F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]"))).cast("bigint"))
           .withColumn("n_symbols", F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint"))
           .withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"))
           .withColumn("__hashes", F.when(F.col("n_words") >= 3, repeated_words(F.col("__words")))
                       .otherwise(F.array().cast("array<bigint>"))))
    again = F.size(F.array_distinct("__hashes")) < F.size("__hashes")
    # sorted (hash, position); kept are the positions whose neighbour has the same hash
    pairs = F.sort_array(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("__sorted", F.when(again, pairs))
    near = lambda i: F.get(F.col("__sorted"), i)["h"]
    hit = F.filter(F.transform("__sorted", lambda x, i: F.when(
        (x["h"].eqNullSafe(near(i - 1))) | (x["h"].eqNullSafe(near(i + 1))), x["i"])), lambda p: p.isNotNull())
    out = out.withColumn("__hit", F.sort_array(hit))
    reach = F.transform("__hit", lambda p, i: F.least(F.lit(3), F.coalesce(F.get(F.col("__hit"), i + 1) - p, F.lit(3))))
    covered = F.aggregate(reach, F.lit(0).cast("bigint"), lambda s, x: s + x)
    out = out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).drop("__words", "__hashes", "__sorted", "__hit")


def failing(line, n):
    """Whether a line of ``n`` words is furniture, not text.

    Boilerplate: a phrase of page furniture, or braces.  Navigation: separators between items, or
    symbols or shouting in most of its words.  Punctuation: no sentence mark at the end of more
    than three words that are followed by none anywhere in the line."""
    low = F.lower(line)
    boilerplate = F.lit(False)
    for phrase in BOILERPLATE:
        boilerplate = boilerplate | low.contains(phrase)
    boilerplate = boilerplate | line.contains("{") | line.contains("}")
    navigation = (F.regexp_count(line, F.lit(SYMBOLS)) * 4 >= n) | (F.regexp_count(line, F.lit("!")) * 2 > n)
    punctuation = (n > 3) & ~line.rlike(r"[.!?…。！？]")
    return punctuation | ((n > 1) & navigation) | boilerplate


def clean(docs: DataFrame, text_col: str = "text", loss: float = LOSS) -> DataFrame:
    """``measures`` with ``clean_text`` (lines that pass, joined by line ends), ``lost_words`` and
    ``kept``: not failed by the base rules, and at most ``loss`` of the words lost.

    Null and empty texts have no words and are not kept.  Rows are independent: repeated rows
    stay, an empty table gives an empty result, nothing is shuffled.  Columns of ``docs`` with the
    names of the results are replaced."""
    counted = F.transform("__lines", lambda x: F.struct(x.alias("line"), F.regexp_count(x, F.lit(WORD)).alias("n")))
    out = measures(docs, text_col).withColumn("__lines", counted)
    out = out.withColumn("__good", F.filter("__lines", lambda x: ~failing(x["line"], x["n"])))
    good = F.aggregate("__good", F.lit(0).cast("bigint"), lambda s, x: s + x["n"])
    return (out.withColumn("clean_text", F.array_join(F.col("__good.line"), "\n")).withColumn("lost_words", F.col("n_words") - good)
            .withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") <= F.col("n_words") * F.lit(loss)))
            .drop("__lines", "__good"))
