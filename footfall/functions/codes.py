"""Coded portrait attributes to labels, buckets and 0/1 indicators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of the coded attributes, and the levels that get an indicator.
MISSING = "nan"
GENDERS = {1: "man", 0: "woman"}
AGES = {0: "_17", 1: "18_24", 2: "25_29", 3: "30_34", 4: "35_49", 5: "_50"}
CITY_LEVELS = ("1", "2", "3", "new1")

# Attribute levels that get an indicator, with its column name.
INDICATORS = {
    "base_gender": {"man": "base_gender_man", "woman": "base_gender_woman"},
    "base_age": {
        "_17": "base_age_17",
        "18_24": "base_age18_24",
        "25_29": "base_age25_29",
        "30_34": "base_age30_34",
        "35_49": "base_age35_49",
        "_50": "base_age_50",
    },
    "city_level": {
        "1": "city_level_1",
        "2": "city_level_2",
        "3": "city_level_3",
        "new1": "city_level_new1",
    },
    "on_price": {
        "_1000": "on_price1000",
        "1000_2000": "on_price_1000_2000",
        "2000_3000": "on_price_2000_3000",
        "3000_4000": "on_price_3000_4000",
        "4000_5000": "on_price_4000_5000",
        "5000_6000": "on_price_5000_6000",
        "_6000": "on_price6000",
    },
}


def code_label(code: Column, labels: dict[int, str]) -> Column:
    """Label of a code; anything else, NULL included, is the missing category."""
    return F.coalesce(*(F.when(code == k, F.lit(v)) for k, v in labels.items()), F.lit(MISSING))


def listed_or_missing(value: Column, allowed: tuple[str, ...]) -> Column:
    return F.when(value.isin(*allowed), value).otherwise(F.lit(MISSING))


def price_bucket(price: Column, *, width: int = 1000, top: int = 6000, null_label: str = "_6000") -> Column:
    """Right-closed price buckets from text or numbers; unreadable prices fall to ``null_label``."""
    whole = F.floor(price.try_cast("double"))
    buckets = F.when(whole.isNull(), F.lit(null_label)).when(whole <= width, F.lit(f"_{width}"))
    for low in range(width, top, width):
        buckets = buckets.when(whole <= low + width, F.lit(f"{low}_{low + width}"))
    return buckets.otherwise(F.lit(f"_{top}"))


def indicators(spec: dict[str, dict[str, str]] = INDICATORS) -> list[Column]:
    """One 0/1 column per attribute level; a missing attribute gives zeros throughout."""
    return [
        F.coalesce((F.col(attribute) == level).cast("int"), F.lit(0)).alias(name)
        for attribute, levels in spec.items()
        for level, name in levels.items()
    ]


def indicator_names(spec: dict[str, dict[str, str]] = INDICATORS) -> list[str]:
    return [name for levels in spec.values() for name in levels.values()]
