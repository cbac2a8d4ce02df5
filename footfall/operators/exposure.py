"""Which apps were advertised enough, and who saw their ads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.operators.joins import split_hot_keys

BRAND = ["brand_name", "app_cat2_name"]


def ads_on(ads: DataFrame, day: int) -> DataFrame:
    """The ad dimension as of one snapshot day."""
    return ads.where(F.col("dayno") == day)


def ad_totals(exposures: DataFrame, days: tuple[int, int]) -> DataFrame:
    """Exposures and rows per ad over a closed day range: a very popular ad becomes one row."""
    seen = exposures.where(F.col("dayno").between(*days))
    return seen.groupBy("ad_id").agg(F.sum("expose_cnt").alias("expose_cnt"), F.count("*").alias("n_rows"))


def exposure_summary(ads: DataFrame, totals: DataFrame) -> DataFrame:
    """Total exposures and number of ads per (brand, category)."""
    return (
        totals.join(ads.select("ad_id", *BRAND), "ad_id")
        .groupBy(*BRAND)
        .agg(F.sum("expose_cnt").alias("expose_cnt"), F.count_distinct("ad_id").alias("adnum"))
    )


def advertised_apps(summary: DataFrame, min_exposure: int = 10000) -> DataFrame:
    """(brand, category) pairs with at least ``min_exposure`` exposures."""
    return summary.where(F.col("expose_cnt") >= min_exposure).select(*BRAND)


def kept_ads(ads: DataFrame, apps: DataFrame) -> DataFrame:
    """Ads of the kept apps, with the app they advertise."""
    return ads.join(apps, BRAND, "left_semi").select("ad_id", F.col("brand_name").alias("appname")).distinct()


def exposed_people(
    kept: DataFrame, exposures: DataFrame, days: tuple[int, int], totals: DataFrame | None = None
) -> DataFrame:
    """Distinct (user, app) pairs that saw an ad of one of the kept apps; ``totals`` tell which ads are hot."""
    seen = exposures.where(F.col("dayno").between(*days)).select("imei", "ad_id")
    return split_hot_keys(seen, kept, ["ad_id"], counts=totals).select("imei", "appname").distinct()
