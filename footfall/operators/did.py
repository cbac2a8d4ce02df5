"""Stratified difference-in-differences of use between exposed and unexposed users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.calendar import Campaign

ARMS = (1, 0)
WHO = ["imei", "appname", "is_expose"]


def strata(
    use_facts: DataFrame, portrait: DataFrame, keys: list[str], campaign: Campaign, cohort: DataFrame | None = None
) -> DataFrame:
    """Users per app, stratum and arm: with any use (``n1``, ``n0``) and with use in a period (``m1_now``, ...).

    Use is folded to one row per (user, app, arm) first, so plain counts are counts of distinct users. With a
    ``cohort``, ``n1`` and ``n0`` count all of its users and not only those with use.
    """
    periods = campaign.labels
    users = use_facts.groupBy(*WHO).agg(*(F.max((F.col("time") == t).cast("int")).alias(t) for t in periods))
    if cohort is not None:
        users = cohort.select(*WHO).join(users, WHO, "left").fillna(0, list(periods))
    people = portrait.select("imei", *keys).distinct()

    def arm(e: int, x: Column) -> Column:
        return F.sum(F.when(F.col("is_expose") == e, x).otherwise(0))

    return (
        users.join(people, "imei")
        .groupBy("appname", *keys)
        .agg(
            *(arm(e, F.lit(1)).alias(f"n{e}") for e in ARMS),
            *(arm(e, F.col(t)).alias(f"m{e}_{t}") for t in periods for e in ARMS),
        )
    )


def _shared() -> Column:
    return (F.col("n1") > 0) & (F.col("n0") > 0)


def _count_columns() -> list[Column]:
    return [
        F.count_if(F.col("n1") > 0).alias("expose_layer_num"),
        F.count_if(F.col("n0") > 0).alias("noexpose_layer_num"),
        F.count_if(_shared()).alias("use_layer_num"),
        *(F.sum(F.when(_shared(), F.col(f"n{e}")).otherwise(0)).alias(f"expose{e}_people") for e in ARMS),
    ]


def strata_counts(cells: DataFrame) -> DataFrame:
    """Per app: strata of each arm, strata both arms share, and the people in the shared ones."""
    return cells.groupBy("appname").agg(*_count_columns())


def did_by_app(cells: DataFrame, campaign: Campaign) -> DataFrame:
    """Adjusted rate of use per arm and period, weighted by stratum size, and its double difference.

    An app whose arms share no stratum gets rates of 0, next to a ``use_layer_num`` of 0.
    """
    weight = F.when(_shared(), F.col("n1") + F.col("n0"))

    def rate(e: int, t: str) -> Column:
        part = F.when(_shared(), weight * F.col(f"m{e}_{t}") / F.col(f"n{e}"))
        return F.coalesce(F.sum(part) / F.sum(weight), F.lit(0.0)).alias(f"{t}{e}")

    before, now, after = campaign.labels
    rates = [rate(e, t) for t in campaign.labels for e in ARMS]

    def double_difference(t: str) -> Column:
        return (F.col(f"{t}1") - F.col(f"{before}1")) - (F.col(f"{t}0") - F.col(f"{before}0"))

    out = cells.groupBy("appname").agg(*_count_columns(), *rates)
    return out.withColumns({f"did_{t}": double_difference(t) for t in (now, after)})
