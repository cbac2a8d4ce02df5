"""Keyword tests and tokens; every expression sees the whole text."""

from __future__ import annotations

import re
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# The marks removed from segmented ad texts.
MARKS = '\t\n.-:;)(?"？，,+/（“【】[]）<>{}《》_；。：#！、!”'


def contains_any(text: Column, words: list[str] | tuple[str, ...]) -> Column:
    """True if the text holds one of the words; a missing text holds none."""
    return F.coalesce(text.rlike("|".join(re.escape(w) for w in words)), F.lit(False))


def contains_at_least(text: Column, words: list[str] | tuple[str, ...], n: int) -> Column:
    """True if at least ``n`` different words occur: all pairs of words in one pass for ``n = 2``."""
    hits = [F.contains(text, F.lit(w)).cast("int") for w in dict.fromkeys(words)]
    return F.coalesce(reduce(add, hits) >= n, F.lit(False))


def tokens(text: Column, marks: str = MARKS) -> Column:
    """Words between blanks and marks."""
    separators = "[ \\r\\f" + "".join(re.escape(m) for m in marks) + "]+"
    return F.filter(F.split(text, separators), lambda w: w != "")


def cjk_pairs(words: Column) -> Column:
    """Split every run of three or more Chinese characters into overlapping pairs."""

    def pairs(word: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(word) - 1)
        return F.when(
            word.rlike("^[\\u4e00-\\u9fff]{3,}$"), F.transform(starts, lambda i: F.substr(word, i, F.lit(2)))
        ).otherwise(F.array(word))

    return F.flatten(F.transform(words, pairs))


def without(words: Column, stop_words: list[str]) -> Column:
    """Drop stop words and keep the repeats of the other words."""
    return F.filter(words, lambda w: ~w.isin(*stop_words)) if stop_words else words


def not_blank(line: Column) -> Column:
    return F.coalesce(F.trim(line) != "", F.lit(False))
