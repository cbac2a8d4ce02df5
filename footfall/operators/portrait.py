"""Bucketed user attributes and their 0/1 form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions import codes
from footfall.operators.joins import salted_join

ATTRIBUTES = ["base_age", "base_gender", "city_level", "on_price"]


def people_portrait(
    people: DataFrame, levels: DataFrame, day: int, *, on: str = "model", price_null: str = "_6000"
) -> DataFrame:
    """City, gender, age, city level and price bucket of every user of a snapshot day."""
    snapshot = people.where(F.col("dayno") == day)
    return salted_join(snapshot, levels, [on], spread_by=["imei"]).select(
        "imei",
        F.coalesce("city", F.lit(codes.MISSING)).alias("city"),
        codes.code_label(F.col("base_gender"), codes.GENDERS).alias("base_gender"),
        codes.code_label(F.col("base_age"), codes.AGES).alias("base_age"),
        codes.listed_or_missing(F.col("city_level"), codes.CITY_LEVELS).alias("city_level"),
        codes.price_bucket(F.col("on_price"), null_label=price_null).alias("on_price"),
    )


def portrait_counts(portrait: DataFrame, keys: list[str]) -> DataFrame:
    return portrait.groupBy(*keys).agg(F.count("*").alias("people"))


def portrait_indicators(cohort: DataFrame, portrait: DataFrame) -> DataFrame:
    """One row per cohort user with an indicator per attribute level; unknown users get zeros."""
    users = cohort.select("imei").distinct()
    return users.join(portrait, "imei", "left").select("imei", *codes.indicators())
