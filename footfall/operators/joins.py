"""Equi-joins that survive a key holding a large part of the rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

N_SALTS = 8
SHORT_LIST = 1_000_000  # ids that are broadcast at most: some 30 MB
ROWS_PER_TASK = 2_000_000
MOST_BITS = 1 << 28  # of a filter that is handed to every task: 32 MB


def salted_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: list[str],
    spread_by: list[str],
    how: str = "inner",
    n_salts: int = N_SALTS,
) -> DataFrame:
    """Join folded facts to a short lookup, each fact key spread over ``n_salts`` tasks.

    The lookup is repeated once per salt, so this is for dimension-sized lookups. No broadcast is forced:
    Spark broadcasts the lookup when its size is under ``autoBroadcastJoinThreshold`` and shuffles by
    (key, salt) otherwise. ``how`` is any type that keeps the fact side.
    """
    salt = F.pmod(F.xxhash64(*spread_by), F.lit(n_salts)).cast("int")
    left = facts.withColumn("_salt", salt)
    right = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n_salts - 1))))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def maybe_in(keys: DataFrame, on: str, most_bits: int = MOST_BITS) -> Column:
    """A filter on column ``on`` that keeps every value of ``keys`` and few others, for lists too long to be broadcast.

    It is a Bloom filter of some ten bits a key and ``most_bits`` at most (32 MB), built by Spark and handed to the tasks that
    read the facts; with more keys it lets more rows through, never fewer. ``keys`` is a written table, as it is counted.
    """
    n = max(keys.count(), 1)
    n_words = max(min(10 * n, most_bits) // 64, 1)
    seeds = range(max(1, min(4, round(0.7 * 64 * n_words / n))))

    def place(seed: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), on), F.lit(64 * n_words))

    places = keys.select(F.explode(F.array(*map(place, seeds))).alias("place"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("place") % 64).cast("int"))
    words = places.select((F.col("place") / 64).cast("long").alias("word"), one.alias("bits"))
    every = keys.sparkSession.range(n_words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    merged = words.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    packed = merged.agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("all"))
    bits = packed.select(F.transform("all", lambda word: word["bits"])).scalar()

    def has(seed: int) -> Column:
        return F.getbit(F.get(bits, (place(seed) / 64).cast("int")), (place(seed) % 64).cast("int")) == 1

    return reduce(and_, map(has, seeds))


def of_users(facts: DataFrame, users: DataFrame, short_list: int = SHORT_LIST) -> DataFrame:
    """Facts of the given users, filtered where they are read.

    Up to ``short_list`` users are broadcast. A longer list becomes a bit filter that lets a few other users through: every
    caller joins the exact list after folding the facts, which is when it costs least. ``users`` is a written table.
    """
    if users.limit(short_list + 1).count() > short_list:
        return facts.where(maybe_in(users, "imei"))
    return facts.join(F.broadcast(users.select("imei").distinct()), "imei", "left_semi")


def split_hot_keys(
    facts: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "inner",
    rows_per_task: int = ROWS_PER_TASK,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Join raw facts of any skew to a long lookup: only keys above ``rows_per_task`` are split.

    Rows per key come from ``counts`` (the key and ``n_rows``) or from a first pass over the key column. A
    key with n rows gets n / rows_per_task parts, its facts are dealt to them by the hash of the whole row,
    and only its lookup rows are repeated. The list of hot keys has rows / rows_per_task entries at most; Spark
    broadcasts it while it is small. Exact copies of one row share a part; where those alone are too many, the skew join of
    adaptive execution divides the part further, as every caller shuffles again or writes after the join.
    """
    if counts is None:
        counts = facts.groupBy(*on).agg(F.count("*").alias("n_rows"))
    parts = F.ceil(F.col("n_rows") / rows_per_task).cast("int").alias("_parts")
    hot = counts.where(F.col("n_rows") > rows_per_task).select(*on, parts)
    n_parts = F.coalesce("_parts", F.lit(1))
    left = facts.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*facts.columns), n_parts).cast("int"))
    right = lookup.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), n_parts - 1)))
    return left.drop("_parts").join(right.drop("_parts"), [*on, "_salt"], how).drop("_salt")
