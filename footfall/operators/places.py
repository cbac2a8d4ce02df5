"""Place visits of active users, per day or week, and their rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.calendar import Weeks
from footfall.operators.joins import of_users
from footfall.operators.ranking import md5_key, numbered

PLACE = ["poi_name", "level_1", "level_2", "level_3"]
WHO = ["city", "base_gender", "base_age"]


def _visitors(active: DataFrame, portrait: DataFrame) -> DataFrame:
    return portrait.join(active.select("imei"), "imei", "left_semi").select("imei", *WHO).distinct()


def _visits(poi: DataFrame, when: Column) -> DataFrame:
    return poi.groupBy("imei", when.alias("when"), *PLACE).agg(F.count("*").alias("visitnum"))


def daily_places(active: DataFrame, portrait: DataFrame, poi: DataFrame, days: tuple[int, int]) -> DataFrame:
    """Visits per user, day and place in a half-open day range."""
    rows = poi.where((F.col("dayno") >= days[0]) & (F.col("dayno") < days[1]))
    seen = _visits(of_users(rows, active), F.col("dayno")).withColumnRenamed("when", "dayno")
    return seen.join(_visitors(active, portrait), "imei").select("imei", "dayno", *WHO, *PLACE, "visitnum")


def weekly_places(active: DataFrame, portrait: DataFrame, poi: DataFrame, weeks: Weeks) -> DataFrame:
    """Visits and visitors per week, kind of user and place; visits are counted per user first."""
    day = F.col("dayno")
    seen = _visits(of_users(poi.where(weeks.contains(day)), active), weeks.index(day))
    return (
        seen.join(_visitors(active, portrait), "imei")
        .groupBy("when", *WHO, *PLACE)
        .agg(F.sum("visitnum").alias("visitnum"), F.count("*").alias("imeinum"))
        .select(weeks.label(F.col("when")).alias("dayno"), *WHO, *PLACE, "visitnum", "imeinum")
    )


def ranked_places(weekly: DataFrame) -> DataFrame:
    """Rank within the week by visits, most first; equal visits follow the md5 order of their keys."""
    hashed = weekly.withColumn("_md5", md5_key(*WHO, *PLACE))
    buckets = {"_visits": -F.col("visitnum"), "_bucket": F.substring("_md5", 1, 2)}
    order = [F.col("_md5"), *(F.col(c) for c in (*WHO, *PLACE))]
    return numbered(hashed, ["dayno"], buckets, order, "imei_number").drop("_md5")
