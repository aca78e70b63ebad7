"""Dictionaries of any size: each text gets a pattern of the terms that may occur in it.

The terms stay a table.  A term is known by its first words, up to three of them; a text
has the runs of one, two and three words that occur in it.  The two are joined, so a text
meets the terms whose first words it holds, and only those go into its pattern.  Leaving
out terms that cannot occur does not change what a pattern matches: the others are tried
in the same order and the first that fits wins.

A frequent key makes a skewed join, whose text side Spark splits at run time; the patterns
are then put together by text.  What one task holds are the terms that may occur in one text.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushtext.functions import marks
from hushtext.plans.dictionary import atoms, case_folds
from hushtext.sources.scratch import written

KEY_WORDS = 3
_ROW = "__hush_row"
_WORDS = "__hush_words"
_WORD = r"(?U)\w++"
_SYMBOL = r"(?U)[^\w]"
_LONE = "\0"  # before the key of a term without a word character


def with_patterns(df: DataFrame, text: str, terms: DataFrame, prefix: str, name: str) -> DataFrame:
    """Add ``name``: ``prefix`` and a pattern of the terms that ``text`` may hold, or null.

    ``terms`` has the distinct terms as column ``term``.  The rows are written once, as
    they go through a join; streams are not possible.
    """
    if df.isStreaming:
        raise ValueError("a dictionary of this size is joined in batches: use foreachBatch")
    keyed = written(_keyed(terms), "term_keys")
    kinds = {row.kind for row in keyed.select("kind").distinct().collect()}  # four at most
    rows = written(df.withColumn(_ROW, F.monotonically_increasing_id()), "texts")
    found = (
        rows.select(_ROW, _folded(text).alias("folded"))
        .select(_ROW, "folded", F.regexp_extract_all("folded", F.lit(_WORD), F.lit(0)).alias(_WORDS))
        .select(_ROW, F.explode(_runs(kinds)).alias("key"))
        .join(keyed.select("key", "term", "pattern"), "key")
    )
    # in the order of the terms; a set, as a task that is run again may not count twice
    listed = F.sort_array(F.collect_set(F.struct("term", "pattern")))["pattern"]
    patterns = found.groupBy(_ROW).agg(listed.alias("patterns"))
    body = F.concat(F.lit(prefix + r"\b(?:"), F.array_join("patterns", "|"), F.lit(r")\b"))
    return rows.join(patterns.select(_ROW, body.alias(name)), _ROW, "left")


def _keyed(terms: DataFrame) -> DataFrame:
    """``term``, ``pattern``, ``key``, ``kind``: words of the key, 0 for a lone symbol.

    Terms are spelled the way the text is while the rules run.
    """
    spelled = terms.select(marks.protect("term").alias("term"))
    words = F.regexp_extract_all(_folded("term"), F.lit(_WORD), F.lit(0))
    known = spelled.withColumn("words", F.slice(words, 1, KEY_WORDS))
    lone = F.concat(F.lit(_LONE), F.substring(_folded("term"), 1, 1))
    kind = F.size("words")
    return known.select(
        "term",
        _pattern_function()("term").alias("pattern"),
        F.when(kind > 0, F.array_join("words", " ")).otherwise(lone).alias("key"),
        kind.alias("kind"),
    )


def _folded(text: str) -> Column:
    """Case and apostrophes folded as the patterns do, by characters."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    source, target = case_folds()
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, source, target))


def _runs(kinds: set[int]) -> Column:
    """The keys of all kinds of terms there are that occur in a text."""
    found = []
    if 1 in kinds:
        found.append(F.col(_WORDS))
    found += [_runs_of(size) for size in sorted(kinds - {0, 1})]
    if 0 in kinds:
        symbols = F.array_distinct(F.regexp_extract_all("folded", F.lit(_SYMBOL), F.lit(0)))
        found.append(F.transform(symbols, lambda ch: F.concat(F.lit(_LONE), ch)))
    return F.array_distinct(F.concat(*found)) if found else F.array().cast("array<string>")


def _runs_of(size: int) -> Column:
    last = F.size(_WORDS) - (size - 1)
    starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(
        starts, lambda at: F.array_join(F.slice(_WORDS, at, F.lit(size)), " ")
    )


def _pattern_function():
    spelled = atoms()

    # a local function travels by value: workers need not have this package
    def pattern(terms: pd.Series) -> pd.Series:
        return terms.map(lambda term: term.translate(spelled))

    return F.pandas_udf(pattern, T.StringType())
