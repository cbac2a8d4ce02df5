from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from footfall.functions import calendar as cal
from footfall.functions import codes, numeric
from footfall.functions import text as tx

CAMPAIGN = cal.STUDY_CAMPAIGN


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("day", "label"),
    [
        (20210131, None),
        (20210201, "before"),
        (20210228, "before"),
        (20210301, "now"),
        (20210328, "now"),
        (20210329, "after"),
        (20210425, "after"),
        (20210426, None),
    ],
)
def test_periods_are_half_open(spark, day, label):
    assert one(spark, cal.period_of(F.lit(day), CAMPAIGN)) == label
    assert one(spark, cal.in_campaign(F.lit(day), CAMPAIGN)) == (label is not None)


def test_periods_last_four_weeks_each():
    assert [(cal.as_day(p.hi) - cal.as_day(p.lo)).days for p in CAMPAIGN.periods] == [28, 28, 28]


@pytest.mark.parametrize(
    ("snapshot", "paid", "label"),
    [
        (20210301, 20210201, "before"),
        (20210301, 20210131, None),
        (20210301, 20210301, None),
        (20210329, 20210301, "now"),
        (20210426, 20210425, "after"),
        (20210302, 20210215, None),
    ],
)
def test_snapshot_period(spark, snapshot, paid, label):
    assert one(spark, cal.snapshot_period(F.lit(snapshot), F.lit(paid), CAMPAIGN)) == label


def test_week_ranges_of_the_studies():
    assert cal.ACTIVITY_WEEKS.n == 26 and cal.ACTIVITY_WEEKS.bounds[0] == (20210301, 20210307)
    assert cal.ACTIVITY_WEEKS.last_day == 20210829
    assert cal.PLACE_WEEKS.n == 21 and cal.PLACE_WEEKS.bounds[-1] == (20210321, 20210327)


def test_week_index_and_label(spark):
    weeks = cal.Weeks(20201101, 21)
    days = cal.day_range(spark, 20201101, 20210327)
    got = days.select("dayno", weeks.index(F.col("dayno")).alias("w")).withColumn("label", weeks.label(F.col("w")))
    for day, week, label in got.collect():
        lo, hi = weeks.bounds[week]
        assert lo <= day <= hi and label == f"{lo}~{hi}"


def test_day_lists_agree(spark):
    listed = cal.day_list(20210301, 20210829, 7)
    assert len(listed) == 26
    assert [r[0] for r in cal.day_range(spark, 20210301, 20210829, 7).collect()] == listed
    assert one(spark, cal.dayno_of(F.lit("2021-03-01 23:59:59").cast("timestamp"))) == 20210301


@pytest.mark.parametrize(
    ("price", "bucket"),
    [
        ("-5", "_1000"),
        ("1000", "_1000"),
        ("1001", "1000_2000"),
        ("1999.9", "1000_2000"),
        ("2000", "1000_2000"),
        ("6000", "5000_6000"),
        ("6000.5", "5000_6000"),
        ("6001", "_6000"),
        ("cheap", "_6000"),
        (None, "_6000"),
    ],
)
def test_price_buckets(spark, price, bucket):
    assert one(spark, codes.price_bucket(F.lit(price).cast("string"))) == bucket


def test_missing_price_label_is_an_option(spark):
    assert one(spark, codes.price_bucket(F.lit(None).cast("string"), null_label="nan")) == "nan"


def test_codes(spark):
    assert [one(spark, codes.code_label(F.lit(c).cast("int"), codes.GENDERS)) for c in (1, 0, 2, None)] == [
        "man", "woman", "nan", "nan",
    ]
    assert one(spark, codes.listed_or_missing(F.lit("new1"), codes.CITY_LEVELS)) == "new1"
    assert one(spark, codes.listed_or_missing(F.lit("4"), codes.CITY_LEVELS)) == "nan"


def test_indicators_sum_to_one_per_known_attribute(spark):
    assert len(codes.indicator_names()) == 19
    people = spark.createDataFrame(
        [("man", "_17", "1", "_1000"), ("nan", "nan", "nan", "_6000"), (None, None, None, None)],
        "base_gender string, base_age string, city_level string, on_price string",
    )
    sums = [
        [sum(r[c] for c in levels.values()) for levels in codes.INDICATORS.values()]
        for r in people.select(*codes.indicators()).collect()
    ]
    assert sums == [[1, 1, 1, 1], [0, 0, 0, 1], [0, 0, 0, 0]]


@pytest.mark.parametrize(("a", "b"), list(itertools.product([None, 0.0, 3.0], repeat=2)))
def test_interaction_truth_table(spark, a, b):
    expected = 0.0 if a is None and b is None else b if a is None else a if b is None else a * b
    got = one(spark, numeric.interaction(F.lit(a).cast("double"), F.lit(b).cast("double")))
    assert got == expected


def test_log_ratio_and_argmax(spark):
    assert one(spark, numeric.log_ratio(F.lit(9.0), F.lit(99.0))) == pytest.approx(0.5)
    assert one(spark, numeric.log_ratio(F.lit(0.0), F.lit(0.0))) == 0.0
    assert one(spark, numeric.first_argmax(F.array(*map(F.lit, [1.0, 7.0, 7.0])))) == 1
    assert one(spark, numeric.flag(F.lit(None))) == 0


def test_entropy_cell_of_an_empty_cell_is_zero(spark):
    args = [F.lit(x) for x in (0, 5, 0, 10)]
    assert one(spark, numeric.half_entropy_cell(*args)) == 0.0
    assert one(spark, numeric.half_entropy_cell(*map(F.lit, (2, 4, 5, 10)))) == pytest.approx(0.2 * math.log2(1.0))


def test_keyword_tests(spark):
    assert one(spark, tx.contains_any(F.lit("a+b"), ["+"]))
    assert not one(spark, tx.contains_any(F.lit(None).cast("string"), ["a"]))
    assert not one(spark, tx.contains_at_least(F.lit(None).cast("string"), ["a", "b"], 2))


def test_two_keywords_equal_all_pairs(spark):
    rng, words = random.Random(7), ["ab", "bc", "cd", "da", "aa"]
    texts = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 9))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[1] for r in df.select("t", tx.contains_at_least(F.col("t"), [*words, "ab"], 2)).collect()]
    pairs = list(itertools.combinations(words, 2))
    assert got == [any(a in t and b in t for a, b in pairs) for t in texts]


def test_tokens(spark):
    text = "招聘,保安  a.b\tc(d)\n“x”！[y] "
    assert one(spark, tx.tokens(F.lit(text))) == ["招聘", "保安", "a", "b", "c", "d", "x", "y"]
    assert one(spark, tx.tokens(F.lit(" .,! "))) == []
    assert one(spark, tx.without(tx.tokens(F.lit("a b a c")), ["b"])) == ["a", "a", "c"]


def test_cjk_pairs(spark):
    words = F.array(*map(F.lit, ["包吃住", "保安", "abc"]))
    assert one(spark, tx.cjk_pairs(words)) == ["包吃", "吃住", "保安", "abc"]
