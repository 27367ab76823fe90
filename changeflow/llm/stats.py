"""Statistics of whole texts from built-in functions only; every text is worked on in its own row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeflow.llm.shared import words

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def occurrences(text: Column, characters: str) -> Column:
    """How many of some single-byte characters are in the text."""
    return reduce(lambda a, b: a + b, (F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit(""))) for c in characters)).cast("long")


def with_words(documents: DataFrame) -> DataFrame:
    """doc_id, text (never NULL) and its words."""
    whole = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return whole.withColumn("words", words(F.col("text")))


def _duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _from(items: Column, start: int) -> Column:
    """The items of an array from a place on."""
    return F.slice(items, start, F.greatest(F.size(items), F.lit(1)))


def counted(documents: DataFrame) -> DataFrame:
    """doc_id with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, and more counts that rules may use.

    n_repeat_words marks windows of three words that occur again: windows are sorted by a 64-bit hash with their place,
    so equal ones stand side by side, and the distinct places they cover are counted. The lists stay inside their row.
    """
    text, found = F.col("text"), F.col("words")
    rows = with_words(documents).select(
        "doc_id", "words",
        F.size(found).cast("long").alias("n_words"),
        (F.char_length(text).cast("long") - occurrences(text, WHITE)).alias("word_chars"),
        occurrences(text, SYMBOLS).alias("n_symbols"),
        _duplicate_lines(text).alias("n_dup_lines"),
        occurrences(text, ".!?").alias("n_ends"),
        occurrences(text, "!").alias("n_shouts"),
        occurrences(text, "0123456789").alias("n_digits"),
        F.size(F.regexp_extract_all(text, F.lit(r"[A-Z]{2,}"), F.lit(0))).cast("long").alias("n_capitals"),
        F.size(F.array_distinct(found)).cast("long").alias("n_distinct"))
    # Three lists of equal length, so that no window is incomplete.
    size = F.greatest(F.size(found) - 2, F.lit(0))
    triples = F.arrays_zip(*(F.slice(found, i + 1, size).alias(name) for i, name in enumerate("abc")))
    placed = F.sort_array(F.transform(triples, lambda w, i: F.struct(F.xxhash64(w["a"], w["b"], w["c"]).alias("x"), i.alias("i"))))
    rows = rows.withColumn("placed", placed).drop("words")
    following = _from(F.col("placed"), 2)
    equal = F.zip_with(F.col("placed"), following, lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], a["i"] + 1, a["i"] + 2, b["i"], b["i"] + 1, b["i"] + 2)))
    covered = F.array_distinct(F.flatten(F.filter(equal, lambda x: x.isNotNull())))
    return rows.withColumn("n_repeat_words", F.size(covered).cast("long")).drop("placed")
