"""Effect of advertising per app: matched cohorts, then strata with double differences, then regression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from footfall.functions.calendar import Campaign
from footfall.operators import categories, cohort, did, exposure, facts, ols, panel, portrait
from footfall.sources.staging import stage


@dataclass(frozen=True)
class AdTables:
    """Source tables, in the columns the operators read."""

    ads: DataFrame
    exposures: DataFrame
    use: DataFrame
    population: DataFrame
    people: DataFrame
    city_level: DataFrame


@dataclass(frozen=True)
class AdSettings:
    """Days and thresholds of one study: apps count as advertised by their exposures on ``threshold_days``, and people as
    exposed by those on ``ad_days``."""

    snapshot: int
    people_snapshot: int
    threshold_days: tuple[int, int]
    ad_days: tuple[int, int]
    use_days: tuple[int, int]
    campaign: Campaign
    min_exposure: int = 10000


# The days of the original study.
STUDY = AdSettings(
    snapshot=20210503,
    people_snapshot=20211101,
    threshold_days=(20210301, 20210328),
    ad_days=(20210201, 20210425),
    use_days=(20210201, 20210425),
    campaign=Campaign.from_days((20210201, 20210301, 20210329, 20210426)),
)


def analysis_people(t: AdTables, s: AdSettings) -> DataFrame:
    """The matched cohort, written once because every later step reads it."""
    ads = exposure.ads_on(t.ads, s.snapshot)
    totals = exposure.ad_totals(t.exposures, s.threshold_days)
    apps = exposure.advertised_apps(exposure.exposure_summary(ads, totals), s.min_exposure)
    kept = stage(exposure.kept_ads(ads, apps), "kept_ads")
    exposed = stage(exposure.exposed_people(kept, t.exposures, s.ad_days), "exposed_people")
    use = facts.of_apps(t.use, studied_apps(kept))
    return stage(cohort.matched_cohort(exposed, use, t.population, s.use_days), "analysis_people")


def studied_apps(people: DataFrame) -> DataFrame:
    """The apps of the cohort as a small written table, by which facts are filtered before any shuffle."""
    return stage(people.select("appname").distinct(), "studied_apps")


def effect_by_strata(t: AdTables, s: AdSettings, people: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Adjusted rates of use and double differences of every app in one job."""
    used = facts.use_by_period(people, facts.of_apps(t.use, studied_apps(people)), s.campaign)
    who = portrait.people_portrait(t.people, t.city_level, s.people_snapshot)
    return did.did_by_app(did.strata(used, who, keys or portrait.ATTRIBUTES, s.campaign), s.campaign)


def effect_by_regression(
    t: AdTables,
    s: AdSettings,
    people: DataFrame,
    *,
    installs: DataFrame,
    searches: DataFrame,
    clicks: DataFrame,
    groups: DataFrame,
) -> DataFrame:
    """Regression of use during and after the campaign on exposure, prior behaviour and portrait: rows and a status for every app."""
    who = portrait.people_portrait(t.people, t.city_level, s.people_snapshot)
    apps = studied_apps(people)
    use, installs, clicks = (facts.of_apps(f, apps) for f in (t.use, installs, clicks))
    wide = stage(panel.conversion_panel(people, use, installs, searches, clicks, s.campaign), "conversion_panel")
    spent = categories.category_time(people, panel.total_use(wide, s.campaign), groups)
    data = panel.regression_data(wide, portrait.portrait_indicators(people, who), spent)
    design = panel.regression_design(panel.regression_features(data))
    return ols.ols_by_group(design, "appname", panel.PREDICTORS, panel.RESPONSES)
