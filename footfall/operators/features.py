"""Time per app category and user-day, widened and scaled for topic models."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from footfall.functions.numeric import log_ratio, zero_if_null
from footfall.operators.joins import of_users, salted_join
from footfall.operators.ranking import PREFIX, first_by_hash, md5_key, numbered
from footfall.sources.staging import stage, stage_by

USER_DAY = ["city", "imei", "dayno"]


def category_list(categories: DataFrame) -> list[str]:
    """Names of the categories, which become columns."""
    return [r[0] for r in categories.select("newcat").distinct().orderBy("newcat").collect()]


def user_sample(active: DataFrame, n: int) -> DataFrame:
    """Up to ``n`` active users of every city. Nothing else samples: features and models take every user given."""
    return first_by_hash(active.select("city", "imei").distinct(), ["city"], ["imei"], n).select("city", "imei")


def user_numbers(users: DataFrame) -> DataFrame:
    """Short numbers from 1 for the users of all cities together, the same in every run."""
    hashed = users.select("city", "imei").distinct().withColumn("_md5", md5_key("city", "imei"))
    buckets = {"_bucket": F.substring("_md5", 1, PREFIX + 1)}
    return numbered(hashed, [], buckets, [F.col("_md5"), F.col("city"), F.col("imei")], "imei_number").drop("_md5")


def with_day_key(user_days: DataFrame, numbers: DataFrame) -> DataFrame:
    """User-days keyed by ``number-day``."""
    key = F.concat_ws("-", F.col("imei_number"), F.col("dayno"))
    return user_days.join(numbers, ["city", "imei"]).withColumn("daynum", key)


def from_day_key(df: DataFrame) -> DataFrame:
    """Number and day read back from the key."""
    parts = {name: F.split_part("daynum", F.lit("-"), F.lit(i)) for i, name in ((1, "imei_number"), (2, "dayno"))}
    return df.withColumns({"imei_number": parts["imei_number"].cast("long"), "dayno": parts["dayno"].cast("int")})


def use_by_user(use: DataFrame, n_buckets: int | None = None) -> DataFrame:
    """Use per user, day and package, written once in buckets of users.

    Rows are added up before they move, so a user moves no more than days x packages rows, however many events there are. What is
    read per user from here on (activity, features, scaling, windows) needs no further shuffle of facts.
    """
    folded = use.groupBy("imei", "dayno", "pack_name").agg(F.sum("duration").alias("duration"))
    return stage_by(folded, "use_by_user", ["imei"], n_buckets)


def _category_rows(users: DataFrame, use: DataFrame, categories: DataFrame) -> DataFrame:
    """Rows of the users' time per day, package and category. ``use`` comes from ``use_by_user``, ``users`` is a written table.

    The lookup is written too, so that Spark knows its size before it decides whether facts have to move to meet it.
    """
    mine = of_users(use, users).join(users.select("imei", "city"), "imei")
    lookup = stage(categories.select("pack_name", "newcat").distinct(), "categories")
    return salted_join(mine, lookup, ["pack_name"], spread_by=["imei", "dayno"])


def category_time_by_day(users: DataFrame, use: DataFrame, categories: DataFrame) -> DataFrame:
    """Time per user, day and category, from ``use_by_user``."""
    rows = _category_rows(users, use, categories)
    return rows.groupBy(*USER_DAY, "newcat").agg(F.sum("duration").alias("sumtime"))


def category_wide(users: DataFrame, use: DataFrame, categories: DataFrame, names: list[str]) -> DataFrame:
    """One row per user-day and one column per category, zero-filled, from ``use_by_user``.

    Rows of a user lie together as written, so neither the wide rows nor the user's means are moved while the lookup is broadcast.
    Names become positions in the lookup, so that the facts compare numbers. A category of the lookup that is not among the
    names raises, as its time would vanish.
    """
    place = F.array_position(F.array(*map(F.lit, names)), F.col("newcat"))
    unknown = F.raise_error(F.concat(F.lit("category without a column: "), F.col("newcat")))
    position = F.when(place == 0, unknown.cast("long")).otherwise(place).cast("int")
    rows = _category_rows(users, use, categories.withColumn("newcat", position))
    cells = [
        zero_if_null(F.sum(F.when(F.col("newcat") == i, F.col("duration")))).alias(c) for i, c in enumerate(names, 1)
    ]
    return rows.groupBy(*USER_DAY).agg(*cells)


def scaled_by_mean(wide: DataFrame, names: list[str]) -> DataFrame:
    """Every category against the user's own daily mean, on the log scale.

    The ratios are taken over arrays: as one expression per column they compile to a method too long for the
    JVM to optimise.
    """
    own = W.partitionBy("city", "imei")
    means = wide.select(*USER_DAY, F.array(*names).alias("x"), F.array(*(F.avg(c).over(own) for c in names)).alias("m"))
    scaled = means.select(*USER_DAY, F.zip_with("x", "m", log_ratio).alias("s"))
    return scaled.select(*USER_DAY, *(F.col("s")[i].alias(c) for i, c in enumerate(names)))


def feature_vectors(df: DataFrame, names: list[str], keep: list[str]) -> DataFrame:
    """Assemble ``names`` into a vector and leave out rows with a NULL among them."""
    assembler = VectorAssembler(inputCols=names, outputCol="features", handleInvalid="skip")
    return assembler.transform(df).select(*keep, "features")
