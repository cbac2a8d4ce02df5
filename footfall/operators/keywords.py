"""Finding ads of one kind by seed words, and new words for the search by mutual information."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions import text as tx
from footfall.functions.numeric import half_entropy_cell
from footfall.operators.ranking import first_by_hash, md5_key
from footfall.sources.staging import stage

# The words of the original search for job ads.
SEED_WORDS = ("招聘", "岗位", "待遇", "薪资")
ANY_WORDS = ("招聘", "薪资", "兼职")
PAIR_WORDS = (
    "招聘", "工作", "薪资", "兼职", "待遇", "一金", "学历", "经理", "月薪", "高薪", "急招", "岗位",
    "优厚", "培训", "五险", "包吃", "客服", "城市", "保安", "快递", "工资", "双休", "日结", "底薪", "年薪",
)
NEGATIVE_RATIO = 10


def seed_filter(ads: DataFrame, words: tuple[str, ...] | list[str] = SEED_WORDS) -> DataFrame:
    """Distinct ads whose text holds a seed word; only the hits are compared with each other."""
    return ads.where(tx.contains_any(F.col("text"), words)).distinct()


def negative_sample(ads: DataFrame, matched: DataFrame, verified: DataFrame, ratio: int = NEGATIVE_RATIO) -> DataFrame:
    """``ratio`` negative ads per verified positive one, drawn by id from the ads the seed words did not match.

    Only ids are shuffled to draw. The sample is the start of the md5 order, so the largest hash in it keeps the texts of
    other ads in the scan, and the few left join the ids.
    """
    others = ads.select("id").distinct().join(matched.select("id"), "id", "left_anti")
    quota = verified.select("id").distinct().agg((F.count("*") * ratio).alias("quota"))
    sample = stage(first_by_hash(others, [], ["id"], quota).select("id"), "negative_ids")
    last = sample.agg(F.max(md5_key("id"))).scalar()
    return ads.where(md5_key("id") <= last).join(sample, "id", "left_semi")


def word_counts(texts: DataFrame, words: Column, by: list[str] | None = None) -> DataFrame:
    """How often each word occurs, per class if ``by`` is given."""
    keys = by or []
    said = texts.where(tx.not_blank(F.col("text"))).select(*keys, F.explode(words).alias("word"))
    return said.groupBy(*keys, "word").agg(F.count("*").alias("n"))


def without_stop_words(counts: DataFrame, stop_words: DataFrame) -> DataFrame:
    """Counts of the words that are on no line of a stop word list; done after counting, when rows are few."""
    return counts.join(stop_words.select(F.col("line").alias("word")), "word", "left_anti")


def paired_counts(negative: DataFrame, positive: DataFrame) -> DataFrame:
    """Two word lists side by side; a word missing from one of them counts 0 there."""
    left = negative.select("word", F.col("n").alias("l1"))
    right = positive.select("word", F.col("n").alias("r1"))
    zero = F.lit(0).cast("long")
    return left.join(right, "word", "full_outer").select(
        "word", F.coalesce("l1", zero).alias("l1"), F.coalesce("r1", zero).alias("r1")
    )


def class_word_counts(texts: DataFrame, words: Column, positive: Column) -> DataFrame:
    """The same table straight from labelled texts, with one aggregation."""
    said = texts.where(tx.not_blank(F.col("text"))).select(positive.alias("hit"), F.explode(words).alias("word"))
    return said.groupBy("word").agg(F.count_if(~F.col("hit")).alias("l1"), F.count_if("hit").alias("r1"))


def word_mi(counts: DataFrame) -> DataFrame:
    """Mutual information of every word with the class (``l``: negative texts, ``r``: positive texts)."""
    totals = {"l": counts.agg(F.sum("l1")).scalar(), "r": counts.agg(F.sum("r1")).scalar()}
    cells = counts.withColumns({"l": totals["l"], "r": totals["r"]}).withColumns(
        {"l0": F.col("l") - F.col("l1"), "r0": F.col("r") - F.col("r1"), "n": F.col("l") + F.col("r")}
    )
    parts = [
        half_entropy_cell(F.col(f"{side}{seen}"), F.col(f"l{seen}") + F.col(f"r{seen}"), F.col(side), F.col("n"))
        for side in ("l", "r")
        for seen in (1, 0)
    ]
    return cells.select("word", "l1", "r1", sum(parts[1:], parts[0]).alias("mi"))


def keyword_search(
    ads: DataFrame,
    any_words: tuple[str, ...] | list[str] = ANY_WORDS,
    pair_words: tuple[str, ...] | list[str] = PAIR_WORDS,
) -> DataFrame:
    """Distinct ads with one of ``any_words`` or two different ``pair_words``, found in one pass."""
    text = F.col("text")
    return ads.where(tx.contains_any(text, any_words) | tx.contains_at_least(text, pair_words, 2)).distinct()
