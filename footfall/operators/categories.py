"""App category groups and the time users spend in each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.numeric import zero_if_null
from footfall.operators.joins import salted_join

GROUPS = ["GH", "GL", "H", "L"]

# The group of games in the category lookup, and the text that marks a heavy game.
GAME_GROUP = "G"
HEAVY_FLAG = "是"


def app_groups(ads: DataFrame, app_cat: DataFrame, game_cat: DataFrame, day: int) -> DataFrame:
    """Group of every advertised app: apps by category lookup, games by name lookup and heavy flag."""
    snapshot = ads.where(F.col("dayno") == day).select("brand_name", "package_name", "app_cat2_name").distinct()
    cats = app_cat.where(F.col("y") != GAME_GROUP).select(F.col("x").alias("app_cat2_name"), F.col("y").alias("hl"))
    games = game_cat.select(
        F.col("x").alias("brand_name"),
        F.col("y").alias("app_cat2_name"),
        F.when(F.col("z") == HEAVY_FLAG, "GH").otherwise("GL").alias("hl"),
    )
    apps = salted_join(snapshot, cats, ["app_cat2_name"], spread_by=["package_name"])
    out = [F.col("brand_name").alias("appname"), "package_name", "app_cat2_name", "hl"]
    return apps.select(*out).unionByName(snapshot.join(games, ["brand_name", "app_cat2_name"]).select(*out)).distinct()


def category_time(cohort: DataFrame, use_facts: DataFrame, groups: DataFrame) -> DataFrame:
    """Use time of every cohort user in each group, zero-filled: one row per user.

    ``use_facts`` is the use of cohort pairs, by period or in total.
    """
    app_group = groups.select("appname", "hl").distinct()
    timed = salted_join(use_facts.select("imei", "appname", "duration"), app_group, ["appname"], spread_by=["imei"])
    wide = timed.groupBy("imei").agg(*(F.sum(F.when(F.col("hl") == g, F.col("duration"))).alias(g) for g in GROUPS))
    users = cohort.select("imei").distinct()
    return users.join(wide, "imei", "left").select("imei", *(zero_if_null(F.col(g)).alias(g) for g in GROUPS))
