"""The wide conversion table of a cohort and the table the regressions read."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.calendar import Campaign
from footfall.functions.codes import INDICATORS, MISSING, indicator_names
from footfall.functions.numeric import interaction, log10_plus1, zero_if_null
from footfall.operators import facts as ft
from footfall.operators.facts import PAIR

METRICS = ["use", "down", "search"]
GROUPS = ["GH", "GL", "H", "L"]


def conversion_panel(
    cohort: DataFrame,
    use: DataFrame,
    installs: DataFrame,
    queries: DataFrame,
    clicks: DataFrame,
    campaign: Campaign,
) -> DataFrame:
    """Use, installs and searches before, during and after, plus the click flag: one row per cohort pair.

    The raw facts of all kinds are stacked and folded by one conditional aggregation, so they are shuffled
    once together, and meet the cohort in one join on the same keys.
    """
    now = F.lit(campaign.now.label).alias("time")
    kinds = {
        "use": (ft.use_rows(use, campaign), "time", F.col("duration")),
        "down": (ft.fresh_installs(installs, campaign), "time", F.lit(1)),
        "search": (ft.search_hits(cohort, queries, campaign), "time", F.col("n")),
        "click": (ft.clicks_in(clicks, campaign.now), now, F.lit(1)),
    }
    stacked = [
        facts.select(*PAIR, time, F.lit(kind).alias("kind"), amount.cast("double").alias("x"))
        for kind, (facts, time, amount) in kinds.items()
    ]
    rows = reduce(DataFrame.unionByName, stacked)

    def cell(period: str, kind: str) -> Column:
        amount = F.when((F.col("time") == period) & (F.col("kind") == kind), F.col("x"))
        return F.max(amount) if kind in ("down", "click") else F.sum(amount)

    cells = [cell(t, m).alias(f"{t}{m}") for m in METRICS for t in campaign.labels]
    wide = rows.groupBy(*PAIR).agg(*cells, cell(campaign.now.label, "click").alias("isclick"))
    filled = [zero_if_null(F.col(f"{t}use")).alias(f"{t}use") for t in campaign.labels]
    counts = [*(f"{t}{m}" for m in METRICS[1:] for t in campaign.labels), "isclick"]
    filled += [zero_if_null(F.col(c)).cast("long").alias(c) for c in counts]
    return cohort.join(wide, PAIR, "left").select(*PAIR, "is_expose", *filled)


def total_use(panel: DataFrame, campaign: Campaign) -> DataFrame:
    """Use time of every pair over the whole campaign, read off the panel instead of the facts."""
    periods = [F.col(f"{t}use") for t in campaign.labels]
    return panel.select(*PAIR, sum(periods[1:], periods[0]).alias("duration"))


def regression_data(panel: DataFrame, portrait_wide: DataFrame, category_time: DataFrame) -> DataFrame:
    """Panel, portrait indicators and category time of every pair; amounts on the log scale."""
    amounts = [c for c in panel.columns if c.endswith(("use", "search"))]
    others = [c for c in panel.columns if c not in amounts and c not in (*PAIR, "is_expose")]
    return (
        panel.join(portrait_wide, "imei")
        .join(category_time, "imei")
        .select(
            *PAIR,
            "is_expose",
            *indicator_names(),
            *(log10_plus1(F.col(c)).alias(c) for c in amounts),
            *others,
            *(log10_plus1(F.col(c)).alias(c) for c in GROUPS),
        )
    )


def regression_features(data: DataFrame) -> DataFrame:
    """Predictors of the regression (exposure, prior behaviour, group interactions, portrait) and responses."""
    gh, gl, h, low = (F.col(c) for c in GROUPS)
    return data.select(
        *PAIR,
        "is_expose",
        *(zero_if_null(F.col(c)).alias(c) for c in ("beforeuse", "beforedown", "beforesearch")),
        interaction(gh, gl).alias("Guse"),
        interaction(h, low).alias("NGuse"),
        interaction(gh, h).alias("Huse"),
        interaction(low, gl).alias("Luse"),
        *indicator_names(),
        "nowuse",
        "afteruse",
    )


def regression_design(features: DataFrame) -> DataFrame:
    """Features with an indicator of each attribute's missing values, so that its baseline level can be left out.

    All levels of an attribute and the intercept depend on each other for an app whose users' attributes are all known, and do
    not for another. Without the baseline, with missing values as a level, the fit is the same and coefficients are
    differences from the same level for every app; a level that an app does not have is aliased.
    """
    return features.withColumns(
        {f"{attribute}_{MISSING}": 1 - reduce(add, map(F.col, levels.values())) for attribute, levels in INDICATORS.items()}
    )


BEHAVIOUR = ["is_expose", "beforeuse", "beforedown", "beforesearch", "Guse", "NGuse", "Huse", "Luse"]
#: The level of every attribute that others are compared with: the first one listed.
BASELINES = {attribute: next(iter(levels.values())) for attribute, levels in INDICATORS.items()}
PORTRAIT = [name for name in indicator_names() if name not in BASELINES.values()]
PREDICTORS = [*BEHAVIOUR, *PORTRAIT, *(f"{attribute}_{MISSING}" for attribute in INDICATORS)]
RESPONSES = ["nowuse", "afteruse"]
