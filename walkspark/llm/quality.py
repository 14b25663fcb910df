"""Line-first cleaning: rules judge every line, failing lines go, and a document that loses too
much of its text that way goes too. Built-in functions only, row by row, without a shuffle.

Rules for a line (lines without a word are left out first; words are parted and lines end by any of the six ASCII
white-space characters, so a carriage return before the line's end says nothing):
- punctuation: over a tenth of its characters are marks such as # * $ % & | < >, or over a fifth of its words
  end in doubled marks ("!!"), or it has no closing mark, fewer than `min_words` words and isn't the only line;
- navigation: at least two separators (| » › • ·), one for four words or more;
- boilerplate: it holds a stock phrase of web pages and has at most 15 words, or such phrases cover over
  a fifth of its characters; or it repeats an earlier line of the document.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from walkspark.llm.common import let, unused, words_of

#: Phrases of page furniture, lower case.
STOCK = [
    "all rights reserved", "accept cookies", "cookie policy", "cookies on this site", "enable javascript", "privacy policy", "terms of service",
    "terms of use", "sign up for our newsletter", "subscribe to our newsletter", "skip to content", "back to top", "lorem ipsum",
]
STOCK_WORDS = 15
WORD = r"[^\x20\x09-\x0D]+"
BLANK = " \t\n\x0b\f\r"
MARKS = r"[#*$%&|<>{}\[\]\\^~=_]"
SEPARATORS = r"[|»›•·]"
CLOSING = list(".!?…:;。！？\"'”’»)]")
DOUBLED = r"[!?*#$%&]{2,}(?=\s|$)"
ANY = r"[#*$%&|<>{}\[\]\\^~=_»›•·]|[!?]{2}"


def repeated_words(words: Column) -> Column:
    """Words in windows of three words that the text has twice or more, the first time included."""

    def covered(hashes):
        def among(twice):
            # a few repeated windows are found by looking each window up, more by sorting all of them
            return F.when(F.size(twice) <= 8, positions(F.filter(F.transform(hashes, lambda h, i: F.when(F.array_contains(twice, h), i)), lambda i: i.isNotNull()))).otherwise(positions(sorted_repeats(hashes)))

        return let(F.sort_array(hashes), lambda s: let(F.array_distinct(F.filter(s, lambda h, j: F.coalesce(h == F.get(s, j - 1), F.lit(False)))), among))

    def sorted_repeats(hashes):
        pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
        return let(F.sort_array(pairs), lambda s: F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1))), lambda x: x["i"])))

    def positions(at):
        return F.aggregate(at, F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")), lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])

    hashes = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))).cast("long")


def line_fails(line: Column, min_words: Column, marked: Column, stock: Column) -> Column:
    """The rules that look at one line alone. marked, stock: whether the whole text has any mark,
    separator or doubled mark, or any stock phrase; most texts have none and skip those rules."""
    n_words = F.regexp_count(line, F.lit(WORD))
    marks = F.regexp_count(line, F.lit(MARKS))
    bars = F.regexp_count(line, F.lit(SEPARATORS))
    doubled = F.regexp_count(line, F.lit(DOUBLED))
    punctuation = (marks * 10 > F.length(line)) | (doubled * 5 > n_words)
    navigation = (bars >= 2) & (bars * 4 >= n_words)
    unclosed = ~F.substring(F.rtrim(line, F.lit(BLANK)), -1, 1).isin(CLOSING) & (n_words < min_words)
    without = F.length(F.regexp_replace(F.lower(line), "|".join(STOCK), ""))
    phrases = let(F.length(F.lower(line)) - without, lambda n: (n > 0) & ((n_words <= STOCK_WORDS) | (5 * n > F.length(line))))
    return (marked & (punctuation | navigation)) | (stock & phrases) | unclosed


def clean_lines(documents: DataFrame, text: str = "text", max_loss: float = 0.5, min_words: int = 4) -> DataFrame:
    """documents with `n_words`, `word_chars`, `n_symbols`, `n_dup_lines`, `n_repeat_words`, `base_failed`,
    `lost_share`, `clean_text` and `kept`; columns of those names are replaced.

    base_failed: under 50 words, or over half of them in repeated windows. kept: not base_failed, and
    at most max_loss of the characters in failing lines. A null text counts as empty: no words,
    so it fails; so does an empty one. Texts of any length are judged whole. Every row is judged alone, so there are no
    ties, and repeated rows get equal verdicts. Other columns stay as they are. An empty table gives no rows.
    """
    source = F.coalesce(F.col(text), F.lit(""))

    def of_lines(lines, marked, stock):
        def split(kept_lines):
            whole, kept = F.length(F.array_join(lines, "")), F.length(F.array_join(kept_lines, ""))
            return F.struct(
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                F.when(whole == 0, F.lit(1.0)).otherwise(1.0 - kept / whole).alias("lost_share"),
                F.array_join(kept_lines, "\n").alias("clean_text"),
            )

        alone = F.when(F.size(lines) == 1, 0).otherwise(min_words)
        return let(F.filter(F.array_distinct(lines), lambda x: ~line_fails(x, alone, marked, stock)), split)

    lines = F.filter(F.split(source, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    has_stock = let(F.lower(source), lambda s: reduce(or_, [F.contains(s, F.lit(x)) for x in STOCK]))
    by_words = let(words_of(F.col(text)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeated_words(w).alias("n_repeat_words")))
    by_lines = let(F.struct(lines.alias("x"), source.rlike(ANY).alias("marked"), has_stock.alias("stock")), lambda s: of_lines(s["x"], s["marked"], s["stock"]))
    w, l = unused(documents, "words", "lines")  # noqa: E741
    made = documents.withColumns({w: by_words, l: by_lines, "n_symbols": F.regexp_count(source, F.lit(r"[#*$%&|<>]")).cast("long")})
    facts = {c: F.col(w)[c] for c in ("n_words", "word_chars", "n_repeat_words")} | {c: F.col(l)[c] for c in ("n_dup_lines", "lost_share", "clean_text")}
    made = made.withColumns(facts).drop(w, l)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return made.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("lost_share") <= max_loss))
