from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from footfall.operators import joins
from footfall.operators.joins import of_users, salted_join, split_hot_keys
from footfall.operators.ranking import first_by_hash, md5_key, numbered, ranked


@pytest.fixture(scope="module")
def facts(spark):
    rng = random.Random(1)
    data = [("hot" if rng.random() < 0.4 else f"k{rng.randint(0, 30)}", i % 17) for i in range(2000)]
    data += [(None, 1), ("alone", 2)] + [("hot", 5)] * 50
    return spark.createDataFrame(data, "k string, v int")


@pytest.fixture(scope="module")
def lookup(spark):
    data = [(f"k{i}", i) for i in range(0, 40, 2)] + [("hot", 100), ("hot", 101), (None, 7)]
    return spark.createDataFrame(data, "k string, w int")


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_spread_joins_equal_a_plain_join(spark, rows, facts, lookup, how, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        plain = rows(facts.join(lookup, ["k"], how))
        assert rows(salted_join(facts, lookup, ["k"], ["v"], how)) == plain
        assert rows(split_hot_keys(facts, lookup, ["k"], how, rows_per_task=60)) == plain
        counts = facts.groupBy("k").agg(F.count("*").alias("n_rows"))
        assert rows(split_hot_keys(facts, lookup, ["k"], how, rows_per_task=60, counts=counts)) == plain
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_keys_are_dealt_to_several_parts(spark, facts, lookup):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = split_hot_keys(facts, lookup, ["k"], rows_per_task=60)._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert "hashpartitioning(k" in plan and "_salt" in plan


def test_numbered_equals_row_number_on_a_skewed_group(spark, rows):
    rng = random.Random(2)
    data = [("big" if rng.random() < 0.7 else f"g{rng.randint(0, 4)}", rng.randint(1, 6), i) for i in range(1500)]
    df = spark.createDataFrame(data, "g string, visits int, id int").withColumn("h", md5_key("id"))
    buckets = {"b0": -F.col("visits"), "b1": F.substring("h", 1, 1)}
    got = numbered(df, ["g"], buckets, [F.col("h"), F.col("id")], "rn")
    plain = df.withColumn("rn", F.row_number().over(W.partitionBy("g").orderBy(F.desc("visits"), "h", "id")))
    assert rows(got, "g", "id", "rn") == rows(plain, "g", "id", F.col("rn").cast("long"))
    assert set(got.columns) == set(plain.columns)


def first_ids(ids, n):
    return sorted(ids, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))[:n]


@pytest.mark.parametrize("prefix", [1, 3])
def test_first_by_hash_with_every_kind_of_quota(spark, rows, prefix):
    ids = {"a": range(500), "b": range(500, 530), "c": range(600, 603)}
    df = spark.createDataFrame([(g, i) for g, r in ids.items() for i in r], "g string, id int")
    wanted = {"a": 100, "b": 30, "c": 5}
    quota = spark.createDataFrame(list(wanted.items()), "g string, quota long")
    expected = sorted((g, i) for g, r in ids.items() for i in first_ids(r, wanted[g]))
    assert sorted(rows(first_by_hash(df, ["g"], ["id"], quota, prefix))) == expected
    seven = sorted((g, i) for g, r in ids.items() for i in first_ids(r, 7))
    assert sorted(rows(first_by_hash(df, ["g"], ["id"], 7, prefix))) == seven
    everyone = [i for r in ids.values() for i in r]
    total = spark.range(1).select(F.lit(40).alias("quota"))
    got = sorted(r[0] for r in first_by_hash(df.select("id"), [], ["id"], total, prefix).collect())
    assert got == sorted(first_ids(everyone, 40))


def test_users_filter_facts_by_a_list_or_by_a_bit_filter(spark):
    facts = spark.range(10).selectExpr("id % 5 as imei", "id")
    users = spark.createDataFrame([(1,), (1,), (3,)], "imei long")
    assert of_users(facts, users).count() == 4
    kept = of_users(facts, users, short_list=2)
    assert kept.join(users.distinct(), "imei").count() == 4 and kept.count() <= 10


def test_ranks_of_a_whole_table(spark):
    rng = random.Random(6)
    rows = [(i, 1 if rng.random() < 0.9 else rng.randint(2, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "w int, n int").repartition(7)
    got = ranked(df, [F.desc("n"), F.asc("w")], n_tasks=13)
    want = {w: r for r, (w, _) in enumerate(sorted(rows, key=lambda x: (-x[1], x[0])), 1)}
    assert {r.w: r["rank"] for r in got.collect()} == want and got.columns == ["w", "n", "rank"]
    assert ranked(df.limit(0), [F.asc("w")]).count() == 0
    assert [tuple(r) for r in ranked(df.where("w = 5"), [F.asc("w")], "place").select("w", "place").collect()] == [(5, 1)]
