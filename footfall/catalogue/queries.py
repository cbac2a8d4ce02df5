"""One entry per operator: (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.catalogue import views as vw
from footfall.catalogue.views import Views
from footfall.functions import calendar
from footfall.functions import text as tx
from footfall.operators import (
    activity,
    categories,
    cohort,
    did,
    exposure,
    facts,
    features,
    keywords,
    kmodes,
    ols,
    panel,
    places,
    portrait,
    topics,
)
from footfall.operators.joins import of_users
from footfall.operators.ranking import ranked
from footfall.plans import ad_effect
from footfall.plans.keyword_expansion import segmented
from footfall.sources import readers, writers
from footfall.sources.staging import stage, staging_path

START_MODES = 6  # of which the SQL restates the choice

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
    QUERIES[fn.__name__] = lambda spark, folder: fn(Views(spark, folder))
    return fn


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    """Sums of doubles depend on their order in the last digits; results are given to six."""
    return df.withColumns({c: F.round(c, digits) for c in cols})


# --- advertised apps and cohorts


def _totals(v: Views) -> DataFrame:
    return exposure.ad_totals(v.ad_counts, vw.AD_DAYS)


@query
def exposure_summary(v: Views) -> DataFrame:
    return exposure.exposure_summary(exposure.ads_on(v.ads, vw.SNAPSHOT), _totals(v))


@query
def advertised_apps(v: Views) -> DataFrame:
    return exposure.advertised_apps(exposure_summary(v), vw.MIN_EXPOSURE)


@query
def exposed_people(v: Views) -> DataFrame:
    ads, totals = exposure.ads_on(v.ads, vw.SNAPSHOT), stage(_totals(v), "ad_totals")
    apps = exposure.advertised_apps(exposure.exposure_summary(ads, totals), vw.MIN_EXPOSURE)
    kept = stage(exposure.kept_ads(ads, apps), "kept_ads")
    return exposure.exposed_people(kept, v.exposures, vw.AD_DAYS, totals)


@query
def cohort_active_exposed(v: Views) -> DataFrame:
    return cohort.active_exposed(exposed_people(v), v.app_use, vw.USE_DAYS)


def _cohort(v: Views, population: DataFrame) -> DataFrame:
    exposed = stage(exposed_people(v), "exposed_people")
    return cohort.matched_cohort(exposed, v.app_use, population, vw.USE_DAYS)


@query
def cohort_matched(v: Views) -> DataFrame:
    return _cohort(v, v.customers)


@query
def cohort_matched_browsers(v: Views) -> DataFrame:
    return _cohort(v, v.browsers)


def _people(v: Views) -> DataFrame:
    """The matched cohort as a written table: most steps read it several times."""
    return stage(_cohort(v, v.browsers), "matched_cohort")


# --- portrait


@query
def portrait_buckets(v: Views) -> DataFrame:
    return portrait.people_portrait(v.people, v.city_level, vw.SNAPSHOT)


@query
def portrait_counts(v: Views) -> DataFrame:
    return portrait.portrait_counts(portrait_buckets(v), ["city", *portrait.ATTRIBUTES])


@query
def portrait_onehot(v: Views) -> DataFrame:
    return portrait.portrait_indicators(_people(v), portrait_buckets(v))


# --- conversions by period


@query
def installs_by_period(v: Views) -> DataFrame:
    return facts.installs_by_period(_people(v), v.installs, vw.CAMPAIGN)


def _use(v: Views, people: DataFrame) -> DataFrame:
    return facts.use_by_period(people, v.app_use, vw.CAMPAIGN)


@query
def use_by_period(v: Views) -> DataFrame:
    return rounded(_use(v, _people(v)), "duration")


@query
def pay_by_period(v: Views) -> DataFrame:
    return facts.pay_by_period(_people(v), v.pay, vw.CAMPAIGN)


@query
def click_flags(v: Views) -> DataFrame:
    return facts.click_flags(_people(v), v.clicks, vw.CAMPAIGN)


@query
def search_by_period(v: Views) -> DataFrame:
    return facts.search_by_period(_people(v), v.searches, vw.CAMPAIGN)


@query
def search_by_period_regex(v: Views) -> DataFrame:
    return facts.search_by_period(_people(v), v.searches, vw.CAMPAIGN, regex=True)


@query
def use_panel(v: Views) -> DataFrame:
    folded = facts.use_folded(v.app_use, vw.CAMPAIGN)
    return rounded(facts.period_panel(_people(v), folded, vw.CAMPAIGN), "sum_data")


@query
def install_panel(v: Views) -> DataFrame:
    folded = facts.installs_folded(v.installs, vw.CAMPAIGN)
    return facts.period_panel(_people(v), folded, vw.CAMPAIGN)


@query
def search_panel(v: Views) -> DataFrame:
    people = _people(v)
    folded = facts.searches_folded(people, v.searches, vw.CAMPAIGN)
    return facts.period_panel(people, folded, vw.CAMPAIGN)


# --- category groups, panel and regression


@query
def app_categories(v: Views) -> DataFrame:
    return categories.app_groups(v.ads, v.app_cat, v.game_cat, vw.SNAPSHOT)


def _category_time(v: Views, people: DataFrame) -> DataFrame:
    return categories.category_time(people, _use(v, people), v.app_group)


@query
def category_time_pivot(v: Views) -> DataFrame:
    return rounded(_category_time(v, _people(v)), *categories.GROUPS)


def _panel(v: Views, people: DataFrame) -> DataFrame:
    return panel.conversion_panel(people, v.app_use, v.installs, v.searches, v.clicks, vw.CAMPAIGN)


@query
def conversion_panel(v: Views) -> DataFrame:
    return rounded(_panel(v, _people(v)), "beforeuse", "nowuse", "afteruse")


def _regression_data(v: Views) -> DataFrame:
    people = _people(v)
    conversions = stage(_panel(v, people), "conversion_panel")
    spent = categories.category_time(people, panel.total_use(conversions, vw.CAMPAIGN), v.app_group)
    return panel.regression_data(conversions, portrait.portrait_indicators(people, portrait_buckets(v)), spent)


@query
def regression_data(v: Views) -> DataFrame:
    data = _regression_data(v)
    return rounded(data, *(c for c in data.columns if c.endswith(("use", "search")) or c in panel.GROUPS))


def _regression_features(v: Views) -> DataFrame:
    return panel.regression_features(_regression_data(v))


@query
def regression_features(v: Views) -> DataFrame:
    data = _regression_features(v)
    return rounded(data, *(c for c in data.columns if c.endswith("use")))


@query
def ols_simple_by_app(v: Views) -> DataFrame:
    fits = ols.simple_ols_by_group(_regression_features(v), "appname", "is_expose", panel.RESPONSES)
    return rounded(fits, *(c for c in fits.columns if c not in ("appname", "n")))


def _design(v: Views) -> DataFrame:
    return panel.regression_design(_regression_features(v))


@query
def ols_by_app(v: Views) -> DataFrame:
    return ols.ols_by_group(_design(v), "appname", panel.PREDICTORS, panel.RESPONSES)


@query
def ols_exposure_effect(v: Views) -> DataFrame:
    """What exposure adds to all other predictors, with standard error, R2 and state of every app's regression; the users of
    one app have no group time, so that none of its rows is complete."""
    behaviour = [c for c in panel.PREDICTORS if c != "is_expose"]
    lost = F.when(F.col("appname") != vw.LOST_APP, F.col("Guse"))
    fits = ols.ols_by_group(_design(v).withColumn("Guse", lost), "appname", [*behaviour, "is_expose"], panel.RESPONSES)
    shown = fits.where(F.col("term") == "is_expose").drop("term")
    return rounded(shown, *ols.result_columns(len(panel.RESPONSES)))


@query
def ols_normal_equations(v: Views) -> DataFrame:
    """Every predictor is orthogonal to the residuals of the fits, aliased ones included."""
    data = stage(_design(v), "regression_design")
    fits = ols.ols_by_group(data, "appname", panel.PREDICTORS, panel.RESPONSES)
    gaps = ols.normal_equations(data, fits, "appname", panel.PREDICTORS, panel.RESPONSES)
    return rounded(gaps, "gap_r1", "gap_r2")


# --- strata and difference-in-differences


def _strata(v: Views, keys: list[str]) -> DataFrame:
    return did.strata(_use(v, _people(v)), portrait_buckets(v), keys, vw.CAMPAIGN)


def _did(v: Views, keys: list[str]) -> DataFrame:
    out = did.did_by_app(_strata(v, keys), vw.CAMPAIGN)
    return rounded(out, *(c for c in out.columns if c.startswith(("before", "now", "after", "did"))))


@query
def strata_counts(v: Views) -> DataFrame:
    return did.strata_counts(_strata(v, ["base_gender", "city_level"]))


@query
def did_by_app(v: Views) -> DataFrame:
    return _did(v, ["base_gender", "city_level"])


@query
def did_by_app_4key(v: Views) -> DataFrame:
    return _did(v, portrait.ATTRIBUTES)


@query
def did_by_app_whole_cohort(v: Views) -> DataFrame:
    """Rates over all cohort users of a stratum instead of those with use."""
    people = _people(v)
    cells = did.strata(_use(v, people), portrait_buckets(v), ["base_gender", "city_level"], vw.CAMPAIGN, people)
    out = did.did_by_app(cells, vw.CAMPAIGN)
    return rounded(out, *(c for c in out.columns if c.startswith(("before", "now", "after", "did"))))


# --- steady users, their use and places


def _active(v: Views) -> DataFrame:
    return activity.active_people(portrait_buckets(v), v.all_use, vw.WEEKS, vw.WEEKLY_TIME)


def _steady(v: Views) -> DataFrame:
    """The active people as a written table, by which facts are filtered before they are folded."""
    return stage(_active(v), "active_people")


@query
def weekly_use_time(v: Views) -> DataFrame:
    return rounded(activity.weekly_use_time(portrait_buckets(v), v.all_use, vw.WEEKS, vw.WEEKLY_TIME), "sumtime")


@query
def active_people(v: Views) -> DataFrame:
    return _active(v)


@query
def active_use(v: Views) -> DataFrame:
    return activity.active_use(_steady(v), v.all_use, vw.USE_DAYS)


def _packages(v: Views) -> DataFrame:
    return activity.package_day_totals(_steady(v), v.all_use, vw.USE_DAYS)


@query
def package_day_totals(v: Views) -> DataFrame:
    return rounded(_packages(v), "sumtimes")


@query
def app_day_totals(v: Views) -> DataFrame:
    return rounded(activity.app_day_totals(_packages(v), v.ads, vw.SNAPSHOT), "sumtimes")


@query
def daily_places(v: Views) -> DataFrame:
    return places.daily_places(_steady(v), portrait_buckets(v), v.places, vw.USE_DAYS)


@query
def weekly_places(v: Views) -> DataFrame:
    return places.weekly_places(_steady(v), portrait_buckets(v), v.places, vw.WEEKS)


@query
def weekly_places_rank(v: Views) -> DataFrame:
    return places.ranked_places(stage(weekly_places(v), "weekly_places"))


# --- category features, topics and clusters


@query
def user_sample(v: Views) -> DataFrame:
    """The sampling operator itself: five users per city."""
    return features.user_sample(_active(v), 5)


@query
def user_numbers(v: Views) -> DataFrame:
    return features.user_numbers(_active(v))


@query
def user_day_keys(v: Views) -> DataFrame:
    """Days of active users, keyed by number and day and read back from the key."""
    active = stage(_active(v), "active_people")
    days = activity.active_use(active, v.all_use, vw.USE_DAYS).select("city", "imei", "dayno").distinct()
    keyed = features.with_day_key(days, features.user_numbers(active)).select("city", "imei", "daynum")
    return features.from_day_key(keyed)


def _users(v: Views) -> DataFrame:
    return stage(_active(v).select("city", "imei"), "active_users")


@query
def user_day_categories(v: Views) -> DataFrame:
    users = _users(v)
    return rounded(features.category_time_by_day(users, _by_user(v, users), v.categories), "sumtime")


def _by_user(v: Views, users: DataFrame) -> DataFrame:
    return features.use_by_user(of_users(v.all_use, users))


def _wide(v: Views) -> DataFrame:
    users = _users(v)
    return features.category_wide(users, _by_user(v, users), v.categories, vw.CATEGORIES)


@query
def user_day_category_wide(v: Views) -> DataFrame:
    return rounded(_wide(v), *vw.CATEGORIES)


def _scaled(v: Views) -> DataFrame:
    return features.scaled_by_mean(_wide(v), vw.CATEGORIES)


@query
def user_day_scaled(v: Views) -> DataFrame:
    return rounded(_scaled(v), *vw.CATEGORIES)


def _training(v: Views) -> DataFrame:
    return topics.training_rows(_scaled(v), vw.CATEGORIES, vw.LDA_PARTITIONS)


@query
def lda_sweep(v: Views) -> DataFrame:
    return topics.sweep(_training(v))


@query
def topic_terms(v: Views) -> DataFrame:
    return topics.topic_terms(topics.fit_topics(_training(v), 20), vw.CATEGORIES)


@query
def topic_terms_rounding(v: Views) -> DataFrame:
    """Per topic: its terms, places where a rank or a rounded weight differs from the whole weights, and the weights' sum."""
    model = topics.fit_topics(_training(v), 20)
    weights = topics.term_weights(model, vw.CATEGORIES)
    listed = topics.topic_terms(model, vw.CATEGORIES).alias("l")
    again = topics.heaviest_terms(weights).withColumnRenamed("weight", "again").drop("term")
    whole = weights.withColumnRenamed("weight", "whole")
    met = listed.join(again, ["topic", "rank"], "full").join(whole, ["topic", "term"], "left")
    wrong = ~F.col("weight").eqNullSafe(F.col("again")) | (F.abs(F.col("weight") - F.col("whole")) > 0.005 + 1e-12)
    terms = met.groupBy("topic").agg(F.count("*").alias("terms"), F.count_if(wrong).alias("wrong"))
    total = weights.groupBy("topic").agg(F.round(F.sum("weight"), 6).alias("total"))
    return terms.join(total, "topic")


@query
def topic_fit(v: Views) -> DataFrame:
    """The fit of the topics: user-days, how far Jensen's bound is from the likelihood, and whether topics explain more than the
    categories' overall shares do."""
    rows = topics.vector_rows(_scaled(v), vw.CATEGORIES)
    model = topics.fit_topics(topics.dealt(rows, vw.LDA_PARTITIONS), 20)
    mixes = model.transform(rows).select(*features.USER_DAY, "features", vector_to_array("topicDistribution").alias("mix"))
    bounds = topics.likelihood_bounds(mixes, topics.term_weights(model, vw.CATEGORIES), vw.CATEGORIES)
    return bounds.agg(
        F.count("*").alias("user_days"),
        F.round(F.abs(F.sum("likelihood") - F.sum("bound")) / F.sum("size"), 6).alias("gap"),
        (F.sum("likelihood") > F.sum("one_topic")).alias("explains_more"),
    )


def _mix(v: Views) -> DataFrame:
    rows = topics.vector_rows(_scaled(v), vw.CATEGORIES)
    return topics.topic_mix(topics.fit_topics(topics.dealt(rows, vw.LDA_PARTITIONS), 20), rows)


@query
def daily_topic_share(v: Views) -> DataFrame:
    return topics.topic_share(_mix(v), ["city", "dayno"], 20)


@query
def daily_topic_share_totals(v: Views) -> DataFrame:
    """The shares of every city and day add up to 1."""
    shares = topics.topic_share(_mix(v), ["city", "dayno"], 20)
    total = sum((F.col(f"topic{i}") for i in range(1, 20)), F.col("topic0"))
    return shares.select("city", "dayno", F.round(total, 6).alias("total"))


@query
def topic_calendar_days(v: Views) -> DataFrame:
    """Days with a topic per user: the days with use."""
    calendar = topics.topic_calendar(topics.dominant_topic(_mix(v)), vw.DAYS)
    used = F.size(F.filter("calendar", lambda t: t != topics.NO_TOPIC)).cast("long")
    return calendar.select("city", "imei", used.alias("days"))


@query
def topic_calendar(v: Views) -> DataFrame:
    calendar = topics.topic_calendar(topics.dominant_topic(_mix(v)), vw.DAYS)
    return topics.calendar_columns(calendar, vw.DAYS)


@query
def dominant_topic(v: Views) -> DataFrame:
    return topics.dominant_topic(v.table("embeddings"), "embedding").select("vec_id", "topic")


@query
def label_topic_share(v: Views) -> DataFrame:
    size = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    mix = v.table("embeddings").select("label", size.alias("mix"))
    out = topics.topic_share(mix, ["label"], 8)
    return rounded(out, *(c for c in out.columns if c != "label"))


def _category_calendar(v: Views) -> DataFrame:
    """Every user's heaviest category per day."""
    wide = _wide(v).select(*features.USER_DAY, F.array(*vw.CATEGORIES).alias("mix"))
    return topics.topic_calendar(topics.dominant_topic(wide), vw.DAYS)


@query
def category_calendar(v: Views) -> DataFrame:
    return topics.calendar_columns(_category_calendar(v), vw.DAYS)


@query
def kmodes_clusters(v: Views) -> DataFrame:
    return kmodes.kmodes(_category_calendar(v)).labelled.select("city", "imei", "cluster", "mismatches")


@query
def kmodes_centroids(v: Views) -> DataFrame:
    return kmodes.kmodes(_category_calendar(v)).centroids()


@query
def kmodes_cost(v: Views) -> DataFrame:
    model = kmodes.kmodes(_category_calendar(v))
    totals = model.labelled.agg(F.sum("mismatches").alias("cost"), F.count("*").alias("people"))
    return totals.withColumn("converged", F.lit(model.converged))


@query
def kmodes_start(v: Views) -> DataFrame:
    """The first modes of the densest start, in the order in which they are chosen, by their distance from earlier ones."""
    rows = stage(_category_calendar(v), "kmodes_rows")
    modes = kmodes.dense_start(rows, START_MODES, "calendar")
    listed = [(i, [int(x) for x in mode]) for i, mode in enumerate(modes, 1)]
    return v.spark.createDataFrame(listed, "step int, calendar array<int>").select(
        "step", *(F.col("calendar")[i].alias(f"d{d}") for i, d in enumerate(vw.DAYS))
    )


@query
def kmodes_start_gain(v: Views) -> DataFrame:
    """Whether the clusters cost no more than those found from either start alone."""
    rows = stage(_category_calendar(v), "kmodes_rows")
    cost = kmodes.kmodes(rows).costs[-1]
    alone = [kmodes.kmodes(rows, starts=(start,)).costs[-1] for start in kmodes.STARTS]
    return rows.agg(F.count("*").alias("people")).withColumn("no_worse", F.lit(cost <= min(alone)))


@query
def kmodes_fixed_point(v: Views) -> DataFrame:
    """Every mode is the majority of its cluster, and the labels add up to the reported cost."""
    return kmodes.fixed_point(kmodes.kmodes(_category_calendar(v)))


def _heaviest(v: Views) -> DataFrame:
    """Active users labelled by the category they spent most time on, the first of equal ones."""
    wide = _wide(v)
    sums = wide.groupBy("city", "imei").agg(F.array(*(F.round(F.sum(c), 6) for c in vw.CATEGORIES)).alias("mix"))
    return topics.dominant_topic(sums, alias="cluster")


@query
def cluster_sizes_by_category(v: Views) -> DataFrame:
    """Sizes per city of the groups of a written labelling."""
    return kmodes.cluster_sizes(stage(_heaviest(v), "labelled"))


@query
def user_day_vectors(v: Views) -> DataFrame:
    """Feature vectors of the user-days that miss no feature; every seventh day misses the first one."""
    scaled = _scaled(v).withColumn("cat1", F.when(F.col("dayno") % 7 != 0, F.col("cat1")))
    vectors = features.feature_vectors(scaled, vw.CATEGORIES, features.USER_DAY)
    values = vectors.select(*features.USER_DAY, vector_to_array("features").alias("x"))
    return rounded(values.select(*features.USER_DAY, *(F.col("x")[i].alias(c) for i, c in enumerate(vw.CATEGORIES))), *vw.CATEGORIES)


@query
def cluster_sizes(v: Views) -> DataFrame:
    calendar = topics.topic_calendar(topics.dominant_topic(_mix(v)), vw.DAYS)
    return kmodes.cluster_sizes(kmodes.kmodes(calendar).labelled)


# --- keyword expansion


def _words() -> Column:
    return tx.tokens(F.col("text"))


@query
def seed_filter(v: Views) -> DataFrame:
    return keywords.seed_filter(v.ad_text, vw.SEED_WORDS)


@query
def negative_sample(v: Views) -> DataFrame:
    """The verified positives are the matched texts labelled with quality 0."""
    matched = stage(seed_filter(v).select("id"), "matched_ids")
    verified = matched.join(v.table("labels").where(F.col("quality") == 0), F.col("id") == F.col("doc_id"), "left_semi")
    return keywords.negative_sample(v.ad_text, matched, verified)


@query
def word_counts(v: Views) -> DataFrame:
    return keywords.word_counts(v.labelled_text, _words(), ["quality"])


@query
def word_counts_without_stop_words(v: Views) -> DataFrame:
    """Words of one or two letters as a stop word list in a Chinese encoding."""
    path = staging_path(v.spark, "stop_words")
    counts = stage(keywords.word_counts(v.ad_text, _words()), "word_counts")
    readers.allow_encoding(v.spark, "GB18030")
    short = counts.where(F.length("word") <= 2).select("word")
    writers.write_csv(short, path, header=False, encoding="GB18030")
    return keywords.without_stop_words(counts, readers.read_lines(v.spark, path, encoding="GB18030"))


@query
def cjk_pair_counts(v: Views) -> DataFrame:
    """Words of texts in which some syllables are Chinese: runs become pairs, and stop words go."""
    text = F.col("text")
    for syllable, chinese in vw.CHINESE.items():
        text = F.replace(text, F.lit(syllable), F.lit(chinese))
    return keywords.word_counts(v.ad_text.select(text.alias("text")), segmented(F.col("text"), vw.CJK_STOP_WORDS))


@query
def top_words(v: Views) -> DataFrame:
    """Every word with its rank, the most frequent first."""
    return ranked(keywords.word_counts(v.ad_text, _words()), [F.desc("n"), F.asc("word")])


@query
def study_days(v: Views) -> DataFrame:
    """Use per day of the study, over the list of its days."""
    days = calendar.day_range(v.spark, *vw.USE_DAYS)
    used = v.all_use.groupBy("dayno").agg(F.count("*").alias("n"))
    return days.join(used, "dayno", "left").select("dayno", F.coalesce("n", F.lit(0)).alias("n"))


@query
def word_mi_ranked(v: Views) -> DataFrame:
    """The words by what they tell about the class, the most telling first."""
    return ranked(word_mi(v), [F.desc("mi"), F.asc("word")])


@query
def word_mi(v: Views) -> DataFrame:
    counts = keywords.class_word_counts(v.labelled_text, _words(), F.col("quality") == 0)
    return rounded(keywords.word_mi(stage(counts, "word_counts")), "mi", digits=9)


@query
def word_mi_from_lists(v: Views) -> DataFrame:
    negative = keywords.word_counts(v.labelled_text.where(F.col("quality") != 0), _words())
    positive = keywords.word_counts(v.labelled_text.where(F.col("quality") == 0), _words())
    counts = keywords.paired_counts(stage(negative, "negative_words"), stage(positive, "positive_words"))
    return rounded(keywords.word_mi(counts), "mi", digits=9)


@query
def keyword_search(v: Views) -> DataFrame:
    return keywords.keyword_search(v.ad_text, vw.ANY_WORDS, vw.PAIR_WORDS)


# --- sources and sinks


@query
def table_by_day(v: Views) -> DataFrame:
    """Write facts by day, append a second part, and read one period back from its partitions."""
    path = staging_path(v.spark, "use_by_day")
    writers.write_table(v.app_use, path, partition_by=["dayno"])
    writers.append_table(v.app_use, path, partition_by=["dayno"])
    now = vw.CAMPAIGN.now
    rows = readers.read_days(v.spark, path, now.lo, now.hi, closed=False)
    totals = rows.groupBy("appname", "dayno").agg(F.sum("duration").alias("duration"), F.count("*").alias("n"))
    return rounded(totals, "duration")


@query
def lookup_csv(v: Views) -> DataFrame:
    """A lookup in a Chinese encoding, read with columns named by position."""
    path = staging_path(v.spark, "game_cat")
    readers.allow_encoding(v.spark, "GBK")
    writers.write_csv(v.game_cat, path, encoding="GBK")
    return readers.read_lookup_csv(v.spark, path, ["app", "category", "heavy"])


@query
def ad_text_csv(v: Views) -> DataFrame:
    """Whole texts, line breaks included, through a CSV file."""
    path = staging_path(v.spark, "ad_text")
    writers.write_csv(v.ad_text, path)
    return readers.read_ad_texts(v.spark, path, multi_line=True).select(F.col("id").cast("long").alias("id"), "text")


@query
def segmented_lines(v: Views) -> DataFrame:
    """Segmented texts as lines, read back and counted."""
    path = staging_path(v.spark, "segmented")
    writers.write_lines(v.ad_text.select(_words().alias("words")), F.concat_ws(" ", "words"), path)
    lines = readers.read_lines(v.spark, path)
    return keywords.word_counts(lines.withColumnRenamed("line", "text"), F.split("text", " "))


def flagship(spark: SparkSession, folder: str, min_exposure: int = 1000) -> DataFrame:
    """From ad exposures to the effect of every app by strata of gender and city level, end to end."""
    v = Views(spark, folder)
    tables = ad_effect.AdTables(v.ads, v.exposures, v.app_use, v.browsers, v.people, v.city_level)
    settings = ad_effect.AdSettings(vw.SNAPSHOT, vw.SNAPSHOT, vw.AD_DAYS, vw.AD_DAYS, vw.USE_DAYS, vw.CAMPAIGN, min_exposure)
    people = ad_effect.analysis_people(tables, settings)
    return ad_effect.effect_by_strata(tables, settings, people, ["base_gender", "city_level"])
