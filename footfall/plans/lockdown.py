"""Behaviour of steady users of each city: app time, places, topics of their days and clusters of users."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.clustering import LDAModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.functions.calendar import ACTIVITY_WEEKS, PLACE_WEEKS, Weeks
from footfall.operators import activity, features, kmodes, places, portrait, topics
from footfall.operators.joins import of_users
from footfall.operators.topics import MAX_ITER
from footfall.sources.staging import stage
from footfall.sources.writers import write_csv, write_table


@dataclass(frozen=True)
class CityTables:
    """Source tables, in the columns the operators read."""

    people: DataFrame
    city_level: DataFrame
    use: DataFrame
    ads: DataFrame
    places: DataFrame
    categories: DataFrame


@dataclass(frozen=True)
class CitySettings:
    """Days, thresholds and model sizes of one study; the defaults are those of the original.

    ``sample`` takes so many users of each city for the features; by default they take all. ``partitions`` is the layout
    that topic models are fitted on, and part of their result.
    """

    snapshot: int = 20211101
    use_days: tuple[int, int] = (20201101, 20210901)
    weeks: Weeks = ACTIVITY_WEEKS
    place_weeks: Weeks = PLACE_WEEKS
    weekly_time: float = 25200.0
    sample: int | None = None
    sweep: range = topics.SWEEP
    topics: int = 20
    clusters: int = 30
    partitions: int = 200
    max_iter: int = MAX_ITER


def steady_users(t: CityTables, s: CitySettings) -> tuple[DataFrame, DataFrame]:
    """Portrait of everyone, and the users active in every week, written because all steps read them."""
    who = stage(portrait.people_portrait(t.people, t.city_level, s.snapshot), "portrait")
    return who, stage(activity.active_people(who, t.use, s.weeks, s.weekly_time), "active_people")


def app_time(t: CityTables, s: CitySettings, active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Time and users per day, by package and by app."""
    packages = stage(activity.package_day_totals(active, t.use, s.use_days), "package_totals")
    return packages, activity.app_day_totals(packages, t.ads, s.snapshot)


def place_ranks(t: CityTables, s: CitySettings, who: DataFrame, active: DataFrame) -> DataFrame:
    """Weekly visits per kind of user and place, ranked."""
    weekly = stage(places.weekly_places(active, who, t.places, s.place_weeks), "weekly_places")
    return places.ranked_places(weekly)


def day_features(t: CityTables, s: CitySettings, active: DataFrame, names: list[str]) -> DataFrame:
    """Scaled category time of steady users on the days of the study as feature vectors."""
    users = active.select("city", "imei").distinct() if s.sample is None else features.user_sample(active, s.sample)
    users = stage(users, "users")
    use = t.use.where((F.col("dayno") >= s.use_days[0]) & (F.col("dayno") < s.use_days[1]))
    wide = features.category_wide(users, features.use_by_user(of_users(use, users)), t.categories, names)
    return topics.training_rows(features.scaled_by_mean(wide, names), names, s.partitions)


def topic_sweep(rows: DataFrame, s: CitySettings, names: list[str], folder: str) -> DataFrame:
    """Fit every number of topics; write terms, user-day mixes and daily shares of each, and return the scores."""

    def keep(k: int, model: LDAModel) -> None:
        mix = topics.topic_mix(model, rows)
        write_table(topics.topic_terms(model, names), f"{folder}/terms/k={k}")
        write_table(mix, f"{folder}/mix/k={k}")
        write_csv(topics.topic_share(mix, ["city", "dayno"], k), f"{folder}/share/k={k}")

    return topics.sweep(rows, s.sweep, s.max_iter, keep=keep)


def user_clusters(rows: DataFrame, s: CitySettings, days: list[int]) -> kmodes.KModes:
    """Topics of every user-day, the heaviest one per day, and clusters of users by their days."""
    model = topics.fit_topics(rows, s.topics, s.max_iter)
    calendar = topics.topic_calendar(topics.dominant_topic(topics.topic_mix(model, rows)), days)
    return kmodes.kmodes(calendar, s.clusters)
