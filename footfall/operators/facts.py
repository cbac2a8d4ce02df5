"""What cohort users did with the advertised app in each period of a campaign.

Facts are folded to one row per (user, app) with a column per period before they meet the cohort. A user or
app with very many rows is combined on the map side, and a fact table is shuffled once: the fold and the join
use the same partitioning, and rows per period are unfolded after the join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.functions.calendar import Campaign, Period, in_campaign, period_of, snapshot_period
from footfall.functions.numeric import flag, zero_if_null
from footfall.operators.joins import salted_join
from footfall.operators.names import names_in_texts

PAIR = ["imei", "appname"]


def of_apps(facts: DataFrame, apps: DataFrame) -> DataFrame:
    """Facts of the studied apps only: with a written, short app list this is decided inside the scan's task."""
    return salted_join(facts, apps.select("appname").distinct(), ["appname"], spread_by=["imei"], how="left_semi")


def timed(facts: DataFrame, campaign: Campaign, *cols: str) -> DataFrame:
    """Facts of the campaign with their period; the plain day range can be pushed into the scan."""
    day = F.col("dayno")
    rows = facts.where(in_campaign(day, campaign)).select(*cols, period_of(day, campaign).alias("time"))
    return rows.where(F.col("time").isNotNull())


def fresh_installs(installs: DataFrame, campaign: Campaign) -> DataFrame:
    return timed(installs.where(F.col("is_upgrade_install") == 0), campaign, *PAIR)


def use_rows(use: DataFrame, campaign: Campaign) -> DataFrame:
    """Use in the campaign; a row without a duration still counts as use."""
    return timed(use, campaign, *PAIR, "duration").withColumn("duration", zero_if_null(F.col("duration")))


def payments(pay: DataFrame, campaign: Campaign) -> DataFrame:
    """Snapshots taken at the end of a period whose last payment lies inside it."""
    label = snapshot_period(F.col("dayno"), F.col("recent_pay_dayno"), campaign)
    ends = [p.hi for p in campaign.periods]
    found = pay.where(F.col("dayno").isin(ends)).select(*PAIR, label.alias("time"))
    return found.where(F.col("time").isNotNull())


def clicks_in(clicks: DataFrame, period: Period) -> DataFrame:
    day = F.col("dayno")
    return clicks.where((day >= period.lo) & (day < period.hi) & (F.col("click_nums") > 0)).select(*PAIR)


def search_hits(cohort: DataFrame, queries: DataFrame, campaign: Campaign, *, regex: bool = False) -> DataFrame:
    """Searches whose text names an app of the cohort; ``regex`` reads the name as a pattern.

    A text becomes the names it holds where it is read, through an index of the names. Whose pairs are in the cohort is left
    to the join of the folded rows.
    """
    asked = timed(queries, campaign, "imei", "query")
    found = names_in_texts(asked, "query", cohort.select("appname"), cohort.select(*PAIR), regex=regex)
    return found.select(*PAIR, "time", F.lit(1).cast("long").alias("n"))


def fold(rows: DataFrame, campaign: Campaign, measure: Column, how: Callable[[Column], Column] = F.sum) -> DataFrame:
    """One row per (user, app), one column per period; NULL where the period has no row."""
    cells = [how(F.when(F.col("time") == t, measure)).alias(t) for t in campaign.labels]
    return rows.groupBy(*PAIR).agg(*cells)


def _unfold(wide: DataFrame, campaign: Campaign, measure: str) -> DataFrame:
    cells = F.array(*(F.struct(F.lit(t).alias("time"), F.col(t).alias(measure)) for t in campaign.labels))
    return wide.select(*PAIR, "is_expose", F.explode(cells).alias("cell")).select(*PAIR, "is_expose", "cell.*")


def by_period(cohort: DataFrame, folded: DataFrame, campaign: Campaign, measure: str) -> DataFrame:
    """Cohort pairs and periods that have facts."""
    rows = _unfold(cohort.join(folded, PAIR), campaign, measure)
    return rows.where(F.col(measure).isNotNull())


def period_panel(cohort: DataFrame, folded: DataFrame, campaign: Campaign) -> DataFrame:
    """Every cohort pair in every period, zero where nothing was seen."""
    rows = _unfold(cohort.join(folded, PAIR, "left"), campaign, "sum_data")
    return rows.withColumn("sum_data", zero_if_null(F.col("sum_data")))


def installs_folded(installs: DataFrame, campaign: Campaign) -> DataFrame:
    return fold(fresh_installs(installs, campaign), campaign, F.lit(1), F.max)


def use_folded(use: DataFrame, campaign: Campaign) -> DataFrame:
    return fold(use_rows(use, campaign), campaign, F.col("duration"))


def searches_folded(cohort: DataFrame, queries: DataFrame, campaign: Campaign, *, regex: bool = False) -> DataFrame:
    return fold(search_hits(cohort, queries, campaign, regex=regex), campaign, F.col("n"))


def installs_by_period(cohort: DataFrame, installs: DataFrame, campaign: Campaign) -> DataFrame:
    return by_period(cohort, installs_folded(installs, campaign), campaign, "installed").drop("installed")


def use_by_period(cohort: DataFrame, use: DataFrame, campaign: Campaign) -> DataFrame:
    return by_period(cohort, use_folded(use, campaign), campaign, "duration")


def pay_by_period(cohort: DataFrame, pay: DataFrame, campaign: Campaign) -> DataFrame:
    folded = fold(payments(pay, campaign), campaign, F.lit(1), F.max)
    return by_period(cohort, folded, campaign, "paid").drop("paid")


def search_by_period(cohort: DataFrame, queries: DataFrame, campaign: Campaign, *, regex: bool = False) -> DataFrame:
    return by_period(cohort, searches_folded(cohort, queries, campaign, regex=regex), campaign, "searchnum")


def click_flags(cohort: DataFrame, clicks: DataFrame, campaign: Campaign) -> DataFrame:
    """Every cohort pair with 1 if it clicked an ad of the app during the campaign."""
    hit = clicks_in(clicks, campaign.now).distinct().withColumn("hit", F.lit(1))
    return cohort.join(hit, PAIR, "left").select(*PAIR, "is_expose", flag(F.col("hit")).alias("is_click"))
