from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from footfall.operators import joins
from footfall.operators.names import names_in_texts, pieces, required_text


def test_pieces_in_one_pass(spark):
    df = spark.createDataFrame([("abcab",), ("é漢\U0001f600x",), ("ab",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(pieces(F.col("t"), 3)).collect()]
    assert got == [["abc", "bca", "cab"], ["é漢\U0001f600", "漢\U0001f600x"], [], [], None]


@pytest.mark.parametrize(
    ("pattern", "text"),
    [("plain name", "plain name"), ("ab+cde", "cde"), ("abc?de", "ab"), ("a.*bcd$", "bcd"), ("x[abc]yz", "yz"), ("x[]a]yz", "yz"), ("ab{0,3}c", "a"), ("ab{23}", "a"), (".*", ""), ("a|b", ""), ("(?i)abc", ""), (r"\Qa.b\E", ""), ("", ""), ("^go$", "go")],
)
def test_required_text(pattern, text):
    assert required_text(pattern) == text


def test_required_text_is_in_every_match():
    rng = random.Random(8)
    for _ in range(3000):
        pattern = "".join(rng.choice(["a", "b", "c", ".", "?", "*", "+", "[ab]", "{2}", "{0,1}"]) for _ in range(rng.randint(1, 6)))
        try:
            compiled = re.compile(pattern)
        except re.error:
            continue
        for _ in range(5):
            text = "".join(rng.choice("abc") for _ in range(6))
            if compiled.search(text):
                assert required_text(pattern) in text, (pattern, text)


def expected(asked, names, found):
    return sorted((i, t, n) for i, t in asked if t is not None for n in names if n is not None and found(n, t))


def run(spark, asked, names, **kwargs):
    rows = spark.createDataFrame(asked, "imei int, said string")
    known = spark.createDataFrame([(n,) for n in names], "appname string")
    owners = rows.select("imei").distinct().crossJoin(known)
    return sorted(tuple(r) for r in names_in_texts(rows, "said", known, owners, **kwargs).select("imei", "said", "appname").collect())


def test_five_thousand_names_and_one_busy_user(spark):
    rng = random.Random(1)
    syllables = ["go", "ma", "li", "地", "图", "app", "x", "né", " ", "\U0001f600", "map"]
    names = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 6))) for _ in range(5000)]
    asked = [(7 if rng.random() < 0.7 else rng.randint(1, 50), "".join(rng.choice(syllables) for _ in range(rng.randint(0, 8)))) for _ in range(400)]
    asked += [(7, "gomali")] * 50 + [(1, None), (2, "")]
    want = expected(asked, set(names), lambda n, t: n in t)
    assert len(want) > 1000
    assert run(spark, asked, names) == want
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert run(spark, asked, names, short_list=10, sample=20) == want
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_patterns_with_and_without_certain_text(spark):
    names = ["gomap", "go.ap", "g.*p", "(map|list)", "^go", "[gm]a", "o?", None, ".", "ma+p"]
    asked = [(1, "gomap"), (1, "golap"), (2, "my list"), (2, "maap"), (3, ""), (3, None), (4, "gomap")]
    assert run(spark, asked, names, regex=True) == expected(asked, names, lambda n, t: re.search(n, t))


def test_empty_names_and_empty_tables(spark):
    assert run(spark, [(1, "ab")], ["", "b"]) == [(1, "ab", ""), (1, "ab", "b")]
    assert run(spark, [], ["ab"]) == [] and run(spark, [(1, "ab")], []) == [] and run(spark, [(1, "ab")], [None]) == []


def test_extra_columns_stay(spark):
    rows = spark.createDataFrame([(1, "get ab", 5)] * 2, "imei int, q string, names int")
    got = names_in_texts(rows, "q", spark.createDataFrame([("ab",)], "appname string"), spark.createDataFrame([(1, "ab")], "imei int, appname string"))
    assert [tuple(r) for r in got.collect()] == [(1, "get ab", 5, "ab")] * 2


def test_long_lists_of_users_become_a_filter_in_the_scan(spark):
    facts = spark.range(20_000).select((F.col("id") % 5000).alias("imei"), "id")
    users = spark.range(0, 5000, 7).withColumnRenamed("id", "imei")
    exact = joins.of_users(facts, users)
    loose = joins.of_users(facts, users, short_list=10)
    assert loose.join(users, "imei").count() == exact.count() == exact.join(users, "imei").count()
    assert exact.count() <= loose.count() < 1.2 * exact.count()
    plan = loose._jdf.queryExecution().executedPlan().toString()
    assert "getbit" in plan.lower() and "hashpartitioning(imei" not in plan
    few = facts.where(joins.maybe_in(users, "imei", most_bits=64))
    assert few.join(users, "imei").count() == exact.count()
