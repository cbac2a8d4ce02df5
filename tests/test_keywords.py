from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from footfall.functions.text import tokens
from footfall.operators import keywords
from footfall.plans.keyword_expansion import scored_words


def test_seed_filter_drops_full_copies(spark, rows):
    ads = spark.createDataFrame([(1, "急招保安 招聘"), (1, "急招保安 招聘"), (2, "卖车"), (3, None), (4, "待遇好")], "id int, text string")
    assert rows(keywords.seed_filter(ads), "id") == [(1,), (4,)]


def test_search_by_one_strong_or_two_weak_words(spark, rows):
    ads = spark.createDataFrame([(1, "兼职"), (2, "工作"), (3, "工作在城市"), (4, "工作 工作"), (5, None)], "id int, text string")
    assert rows(keywords.keyword_search(ads), "id") == [(1,), (3,)]
    assert len(keywords.PAIR_WORDS) == 25


def test_negative_sample_is_disjoint_and_sized(spark):
    ads = spark.createDataFrame([(i, "招聘" if i < 20 else f"t{i}") for i in range(200)], "id int, text string")
    matched = keywords.seed_filter(ads)
    verified = matched.where("id < 5")
    got = [r.id for r in keywords.negative_sample(ads, matched, verified).collect()]
    assert len(got) == 50 and len(set(got)) == 50 and min(got) >= 20
    again = [r.id for r in keywords.negative_sample(ads.repartition(7), matched, verified).collect()]
    assert sorted(got) == sorted(again)
    assert keywords.negative_sample(ads, matched, matched).count() == 180


def mi_by_hand(l1, r1, left, right):
    n = left + right
    cells = [(l1, l1 + r1, left), (left - l1, n - l1 - r1, left), (r1, l1 + r1, right), (right - r1, n - l1 - r1, right)]
    return sum(c / n * math.log2(n * c / (row * col)) for c, row, col in cells if c)


def test_mutual_information(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(12)]
    texts = [(i % 3 == 0, " ".join(rng.choices(words[: 6 if i % 3 else 12], k=9)) + " ,same") for i in range(90)]
    df = spark.createDataFrame(texts, "hit boolean, text string")
    counts = keywords.class_word_counts(df, tokens(F.col("text")), F.col("hit"))
    negative = keywords.word_counts(df.where(~F.col("hit")), tokens(F.col("text")))
    positive = keywords.word_counts(df.where("hit"), tokens(F.col("text")))
    tally = {hit: Counter(w for h, t in texts if h == hit for w in t.replace(",", "").split()) for hit in (True, False)}
    left, right = sum(tally[False].values()), sum(tally[True].values())
    for table in (counts, keywords.paired_counts(negative, positive)):
        got = {r.word: r for r in keywords.word_mi(table).collect()}
        assert set(got) == set(tally[True]) | set(tally[False])
        for w, r in got.items():
            assert (r.l1, r.r1) == (tally[False][w], tally[True][w])
            assert r.mi == pytest.approx(mi_by_hand(r.l1, r.r1, left, right))


def test_an_independent_word_tells_nothing(spark):
    counts = spark.createDataFrame([("a", 10, 5), ("b", 20, 10), ("c", 0, 0)], "word string, l1 long, r1 long")
    assert [r.mi for r in keywords.word_mi(counts).collect()] == pytest.approx([0.0, 0.0, 0.0])


def test_blank_texts_count_nothing(spark):
    df = spark.createDataFrame([("  ",), (None,), ("a a",)], "text string")
    assert [tuple(r) for r in keywords.word_counts(df, tokens(F.col("text"))).collect()] == [("a", 2)]


def test_the_whole_expansion(spark):
    ads = spark.createDataFrame(
        [(i, "招聘 保安" if i < 6 else f"卖车 车{i % 3}") for i in range(100)] + [(500, "招聘 会")], "id int, text string"
    )
    scores = scored_words(ads, ads.where("id < 6"), ["会"]).collect()
    assert {scores[0].word, scores[1].word, scores[2].word} == {"招聘", "保安", "卖车"}
    assert "会" not in {r.word for r in scores}
