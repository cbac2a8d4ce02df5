"""Users active in every week, and how much time they spend per package, app and day."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.calendar import Weeks
from footfall.operators.joins import of_users, salted_join, split_hot_keys


def weekly_use_time(people: DataFrame, use: DataFrame, weeks: Weeks, threshold: float) -> DataFrame:
    """(city, user, week) with more use time than the threshold."""
    day = F.col("dayno")
    per_week = (
        use.where(weeks.contains(day))
        .groupBy("imei", weeks.index(day).alias("week"))
        .agg(F.sum("duration").alias("sumtime"))
        .where(F.col("sumtime") > threshold)
    )
    return per_week.join(people.select("imei", "city"), "imei").select("city", "imei", "week", "sumtime")


def active_people(people: DataFrame, use: DataFrame, weeks: Weeks, threshold: float) -> DataFrame:
    """Users of a city above the threshold in every single week: one pass with one sum per week."""
    day = F.col("dayno")
    sums = [
        F.sum(F.when(day.between(lo, hi), F.col("duration"))).alias(f"w{i}") for i, (lo, hi) in enumerate(weeks.bounds)
    ]
    always = reduce(and_, (F.col(f"w{i}") > threshold for i in range(weeks.n)))
    steady = use.where(weeks.contains(day)).groupBy("imei").agg(*sums).where(always).select("imei")
    return people.select("imei", "city").join(steady, "imei").select("city", "imei", F.lit(weeks.n).alias("imeinums"))


def active_use(active: DataFrame, use: DataFrame, days: tuple[int, int]) -> DataFrame:
    """Use rows of active users in a half-open day range, with their city."""
    rows = use.where((F.col("dayno") >= days[0]) & (F.col("dayno") < days[1]))
    who = active.select("imei", "city").distinct()
    return split_hot_keys(of_users(rows, active), who, ["imei"])


def package_day_totals(active: DataFrame, use: DataFrame, days: tuple[int, int]) -> DataFrame:
    """Time and users per city, package and day; use is folded per user first, so users are plain counts."""
    per_user = (
        of_users(use.where((F.col("dayno") >= days[0]) & (F.col("dayno") < days[1])), active)
        .groupBy("imei", "pack_name", "dayno")
        .agg(F.sum("duration").alias("duration"))
    )
    return (
        per_user.join(active.select("imei", "city").distinct(), "imei")
        .groupBy("city", "pack_name", "dayno")
        .agg(F.sum("duration").alias("sumtimes"), F.count("*").alias("sumimei"))
    )


def app_day_totals(packages: DataFrame, ads: DataFrame, day: int) -> DataFrame:
    """Package totals rolled up to apps: time adds up, users are those of the largest package."""
    names = ads.where(F.col("dayno") == day).select("app_name", F.col("package_name").alias("pack_name")).distinct()
    return (
        salted_join(packages, names, ["pack_name"], spread_by=["city", "dayno"])
        .groupBy("city", "app_name", "dayno")
        .agg(F.sum("sumtimes").alias("sumtimes"), F.max("sumimei").alias("sumimei"))
    )
