"""From seed words to an expanded search: matched ads, negative sample, word scores and the final search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions import text as tx
from footfall.operators import keywords
from footfall.sources.staging import stage


def segmented(text: Column, stop_words: list[str] | None = None) -> Column:
    """Words of a text without marks and stop words; Chinese runs become overlapping pairs."""
    return tx.without(tx.cjk_pairs(tx.tokens(text)), stop_words or [])


def scored_words(ads: DataFrame, verified: DataFrame, stop_words: list[str] | None = None) -> DataFrame:
    """Mutual information of every word, from verified ads against ten times as many unmatched ones."""
    matched = stage(keywords.seed_filter(ads).select("id"), "matched_ids")
    negatives = keywords.negative_sample(ads, matched, verified)
    words = segmented(F.col("text"), stop_words)
    positive_counts = stage(keywords.word_counts(verified, words), "positive_words")
    negative_counts = stage(keywords.word_counts(negatives, words), "negative_words")
    return keywords.word_mi(keywords.paired_counts(negative_counts, positive_counts)).orderBy(F.desc("mi"), "word")
