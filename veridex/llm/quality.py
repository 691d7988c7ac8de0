"""Quality rules, line first: bad lines go, then documents that lose too much text.

Everything is an expression of the document's own row: nothing moves between tasks, whatever the size of the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veridex.llm import textcols

SYMBOLS = r"[#*$%&|<>]"
#: What a sentence or clause ends with, marks between menu entries, and stock phrases of web pages.
ENDS = r"[.!?,;:…。！？»”\"')\]]$"
MENU_MARKS = r"[|»›>•]"
STOCK = r"(?i)\b(cookie policy|privacy policy|terms of (use|service)|all rights reserved|click here|sign (in|up)|log ?in|subscribe|javascript|licensed under|is licensed under)\b"

#: At least so many words at the start of a line without blanks around it; nothing after them is read.
FOUR_WORDS = r"^(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){3}[^\x20\x09-\x0D]"
SIXTEEN_WORDS = r"^(?:[^\x20\x09-\x0D]++[\x20\x09-\x0D]++){15}[^\x20\x09-\x0D]"


#: Bits of a place: a string of at most 2^31 bytes has fewer words.  The other bits hold a window's hash.
PLACE_BITS = 30


def with_repeats(frame: DataFrame, words: str, out: str) -> DataFrame:
    """Adds how many words stand in a three-word window that occurs at least twice, step by step so that no step is computed twice.

    Hashes of windows only tell which texts and places to look at: equal windows have equal hashes, so a text whose hashes
    are all different is done, and in the others the windows themselves are compared where hashes are equal.
    """

    def twins(items: str, of) -> Column:
        """The elements of a sorted array that equal a neighbour in of()."""
        return F.filter(items, lambda x, j: (of(x) == of(F.get(items, j + 1))) | (of(x) == of(F.get(items, j - 1))))

    frame = frame.withColumn("_word", F.transform(words, lambda x: F.xxhash64(x)))
    starts = F.slice("_word", 1, F.greatest(F.size("_word") - 2, F.lit(0)))
    frame = frame.withColumn("_hash", F.transform(starts, lambda x, i: F.xxhash64(x, F.get("_word", i + 1), F.get("_word", i + 2))))
    differ = F.size(F.array_distinct("_hash")) == F.size("_hash")
    packed = F.transform("_hash", lambda x, i: F.shiftleft(x, PLACE_BITS).bitwiseOR(i.cast("bigint")))
    frame = frame.withColumn("_packed", F.when(~differ, F.sort_array(packed)))
    frame = frame.withColumn("_close", twins("_packed", lambda x: F.shiftright(x, PLACE_BITS)))

    mask = F.lit((1 << PLACE_BITS) - 1).cast("bigint")
    places = F.transform("_close", lambda x: x.bitwiseAND(mask).cast("int"))
    window = lambda p: F.concat_ws(" ", F.get(words, p), F.get(words, p + 1), F.get(words, p + 2)).alias("t")
    frame = frame.withColumn("_exact", F.array_sort(F.transform(places, lambda p: F.struct(window(p), p.alias("p")))))
    frame = frame.withColumn("_same", twins("_exact", lambda x: x["t"]))
    covered = F.flatten(F.transform("_same", lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2)))
    frame = frame.withColumn(out, F.coalesce(F.array_size(F.array_distinct(covered)), F.lit(0)).cast("bigint"))
    return frame.drop("_word", "_hash", "_packed", "_close", "_exact", "_same")


def line_passes(line: Column) -> Column:
    """Whether a line with a word is text: it isn't a menu, a stock phrase, signs, or a scrap without an end."""
    bare = textcols.strip_blanks(line)
    marks = F.regexp_count(bare, F.lit(MENU_MARKS))
    menu = (marks >= 2) & (marks * 4 >= F.size(F.split(bare, textcols.BLANK_RUN)))
    stock = ~bare.rlike(SIXTEEN_WORDS) & bare.rlike(STOCK)
    signs = F.regexp_count(bare, F.lit(SYMBOLS)) * 10 > F.length(bare)
    scrap = ~bare.rlike(FOUR_WORDS) & ~bare.rlike(ENDS)
    return ~(menu | stock | signs | scrap)


def clean_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat: int = 50, max_lost: int = 50
) -> DataFrame:
    """One row for each row of docs: id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    lost_chars, kept, text (the lines that pass, joined by line ends).

    base_failed: fewer than min_words words, or over max_repeat per cent of them in repeated windows of three words.
    Otherwise lines are judged one by one, and a document is kept unless the lines that fail hold over max_lost per cent
    of its word characters.  A null or empty text has no words and fails.  Repeated rows and null ids give a row each;
    an empty table gives none.  Other columns of docs are not read, so their names can't clash.
    """
    frame = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    frame = frame.withColumn("_words", textcols.words(F.col("_text")))
    frame = with_repeats(frame, "_words", "n_repeat_words").withColumn("n_words", F.size("_words").cast("bigint"))
    frame = frame.withColumn("word_chars", F.length(F.array_join("_words", "")).cast("bigint")).drop("_words")
    frame = frame.withColumn("_lines", textcols.lines(F.col("_text")))
    frame = frame.withColumn("_full", F.filter("_lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    frame = frame.withColumn("_good", F.filter("_full", line_passes))
    frame = frame.withColumn("_cleaned", F.array_join("_good", "\n"))
    good = F.length(F.regexp_replace("_cleaned", textcols.BLANK_RUN, ""))
    frame = frame.withColumn("lost_chars", F.when(F.size("_good") < F.size("_full"), F.col("word_chars") - good).otherwise(0).cast("bigint"))
    frame = frame.withColumn(
        "base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    )
    return frame.select(
        F.col("_id").alias(id_col),
        "n_words",
        "word_chars",
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        (F.size("_full") - F.size(F.array_distinct("_full"))).cast("bigint").alias("n_dup_lines"),
        "n_repeat_words",
        "base_failed",
        "lost_chars",
        (~F.col("base_failed") & (100 * F.col("lost_chars") <= max_lost * F.col("word_chars"))).alias("kept"),
        F.col("_cleaned").alias("text"),
    )
