from __future__ import annotations

import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from conftest import DATA
from footfall.catalogue import queries
from footfall.catalogue import views as vw
from footfall.catalogue.views import CATEGORIES, DAYS, SNAPSHOT, USE_DAYS, Views
from footfall.functions.calendar import Weeks
from footfall.operators import activity, features, kmodes, places, topics
from footfall.plans import lockdown
from footfall.sources import staging

WEEKS = Weeks(20240101, 3)
RANGE = (20240101, 20240122)


@pytest.fixture
def people(spark):
    return spark.createDataFrame([(1, "c"), (2, "c"), (3, "d"), (4, "d")], "imei int, city string")


@pytest.fixture
def use(spark):
    """User 1 is steady, 2 misses exactly one week, 3 meets the threshold without passing it, 4 is steady."""
    days = {1: [1, 8, 15], 2: [1, 8, 14], 3: [1, 8, 15], 4: [7, 14, 21]}
    time = {1: 11.0, 2: 50.0, 3: 10.0, 4: 20.0}
    data = [(u, f"p{u % 2}", time[u], 20240100 + d) for u, ds in days.items() for d in ds]
    return spark.createDataFrame([*data, (1, "p1", 99.0, 20240122)], "imei int, pack_name string, duration double, dayno int")


def test_weekly_time_and_active_people(rows, people, use):
    weekly = activity.weekly_use_time(people, use, WEEKS, 10.0)
    assert rows(weekly.where("imei = 2")) == [("c", 2, 0, 50.0), ("c", 2, 1, 100.0)]
    assert weekly.where("imei = 3").count() == 0
    active = activity.active_people(people, use, WEEKS, 10.0)
    assert rows(active) == [("c", 1, 3), ("d", 4, 3)]
    by_weeks = weekly.groupBy("city", "imei").count().where("count = 3").select("city", "imei")
    assert rows(by_weeks) == rows(active, "city", "imei")


def test_active_use_keeps_rows_and_repeats(rows, people, use):
    active = activity.active_people(people, use, WEEKS, 10.0)
    doubled = use.unionByName(use.where("imei = 1"))
    got = activity.active_use(active, doubled, RANGE)
    assert Counter(r[0] for r in rows(got, "imei")) == {1: 6, 4: 3}


def test_package_and_app_totals(spark, rows):
    active = spark.createDataFrame([(1, "c"), (2, "c")], "imei int, city string")
    use = spark.createDataFrame(
        [(1, "p", 1.0, 20240101), (1, "p", 2.0, 20240101), (2, "p", 4.0, 20240101), (1, "q", 8.0, 20240101), (3, "p", 9.0, 20240101)],
        "imei int, pack_name string, duration double, dayno int",
    )
    packages = activity.package_day_totals(active, use, RANGE)
    assert rows(packages) == [("c", "p", 20240101, 7.0, 2), ("c", "q", 20240101, 8.0, 1)]
    ads = spark.createDataFrame([("a", "p", 5), ("a", "p", 5), ("a", "q", 5), ("b", "q", 6)], "app_name string, package_name string, dayno int")
    assert rows(activity.app_day_totals(packages, ads, 5)) == [("c", "a", 20240101, 15.0, 2)]


def test_places_per_day_week_and_rank(spark, rows):
    who = spark.createDataFrame([(u, "c", "man", "_17") for u in (1, 2, 3)], "imei int, city string, base_gender string, base_age string")
    active = spark.createDataFrame([(1,), (2,)], "imei int")
    visits = [(1, "x", 1)] * 2 + [(1, "x", 7), (2, "x", 2), (2, "y", 3), (3, "y", 3), (1, "y", 8)]
    poi = spark.createDataFrame([(u, p, "a", "b", "c", 20240100 + d) for u, p, d in visits],
                                "imei int, poi_name string, level_1 string, level_2 string, level_3 string, dayno int")
    daily = places.daily_places(active, who, poi, RANGE)
    assert rows(daily, "imei", "dayno", "poi_name", "visitnum") == [
        (1, 20240101, "x", 2), (1, 20240107, "x", 1), (1, 20240108, "y", 1), (2, 20240102, "x", 1), (2, 20240103, "y", 1),
    ]
    weekly = places.weekly_places(active, who, poi, WEEKS)
    assert rows(weekly, "dayno", "poi_name", "visitnum", "imeinum") == [
        ("20240101~20240107", "x", 4, 2), ("20240101~20240107", "y", 1, 1), ("20240108~20240114", "y", 1, 1),
    ]
    ranked = places.ranked_places(weekly)
    assert rows(ranked, "dayno", "imei_number", "poi_name") == [
        ("20240101~20240107", 1, "x"), ("20240101~20240107", 2, "y"), ("20240108~20240114", 1, "y"),
    ]


def test_category_features(spark, rows):
    sample = spark.createDataFrame([("c", 1)], "city string, imei int")
    use = spark.createDataFrame(
        [(1, "p", 9.0, 1), (1, "q", 1.0, 1), (1, "p", 99.0, 2), (2, "p", 5.0, 1)], "imei int, pack_name string, duration double, dayno int"
    )
    cats = spark.createDataFrame([("p", "k1"), ("q", "k1"), ("z", "k2")], "pack_name string, newcat string")
    assert features.category_list(cats) == ["k1", "k2"]
    long = features.category_time_by_day(sample, features.use_by_user(use), cats)
    assert rows(long, "imei", "dayno", "newcat", "sumtime") == [(1, 1, "k1", 10.0), (1, 2, "k1", 99.0)]
    wide = features.category_wide(sample, features.use_by_user(use), cats, ["k1", "k2"])
    assert rows(wide, "dayno", "k1", "k2") == [(1, 10.0, 0.0), (2, 99.0, 0.0)]
    scaled = rows(features.scaled_by_mean(wide, ["k1", "k2"]), "dayno", "k1", "k2")
    mean = np.log10(54.5 + 1)
    assert scaled[0][1] == pytest.approx(np.log10(11) / mean) and scaled[1][1] == pytest.approx(2 / mean)
    assert scaled[0][2] == 0.0


def test_rows_with_a_gap_are_left_out_of_the_vectors(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 1.0)], "id int, a double, b double")
    got = features.feature_vectors(df, ["a", "b"], ["id"]).collect()
    assert [(r.id, list(r.features)) for r in got] == [(1, [1.0, 2.0])]


@pytest.fixture(scope="module")
def training(spark):
    rng = random.Random(4)
    names = [f"k{i}" for i in range(6)]
    data = [("c" if u % 2 else "d", u, d, *[rng.random() * (3 if (i + u) % 3 == 0 else 0.2) for i in range(6)]) for u in range(20) for d in (20240101, 20240102)]
    df = spark.createDataFrame(data, "city string, imei int, dayno int, " + ", ".join(f"{n} double" for n in names))
    return topics.training_rows(df, names, 3), names


def test_topic_model_outputs(training):
    train, names = training
    model = topics.fit_topics(train, 3, max_iter=5)
    mix = topics.topic_mix(model, train)
    assert mix.count() == 40
    shares = topics.topic_share(mix, ["city", "dayno"], 3).collect()
    assert len(shares) == 4 and all(sum(r[f"topic{i}"] for i in range(3)) == pytest.approx(1.0) for r in shares)
    terms = topics.topic_terms(model, names, 4).collect()
    assert len(terms) == 12 and {r["term"] for r in terms} <= set(names)
    first = [r["weight"] for r in sorted(terms, key=lambda r: (r["topic"], r["rank"])) if r["topic"] == 0]
    assert first == sorted(first, reverse=True)
    again = topics.topic_mix(topics.fit_topics(train, 3, max_iter=5), train)
    assert mix.exceptAll(again).count() == 0


def test_sweep_agrees_with_the_model(training):
    train, _ = training
    got = {r.k: r for r in topics.sweep(train, [2, 3], max_iter=3).collect()}
    model = topics.fit_topics(train, 3, max_iter=3)
    assert got[3].log_likelihood == pytest.approx(model.logLikelihood(train))
    assert got[3].log_perplexity == pytest.approx(model.logPerplexity(train))
    assert sorted(got) == [2, 3]


def test_topic_calendar(spark, rows):
    days = spark.createDataFrame([("c", 1, 20240101, 3), ("c", 1, 20240103, 0), ("d", 2, 20240102, 5), ("d", 2, 20240109, 1)],
                                 "city string, imei int, dayno int, topic int")
    wanted = [20240101, 20240102, 20240103]
    calendar = topics.topic_calendar(days, wanted)
    assert rows(calendar) == [("c", 1, [3, -1, 0]), ("d", 2, [-1, 5, -1])]
    assert rows(topics.calendar_columns(calendar, wanted)) == [("c", 1, 3, -1, 0), ("d", 2, -1, 5, -1)]


def kmodes_by_hand(values, modes):
    """Rounds of assignment and majority vote in plain Python."""
    costs = []
    while True:
        near = [min((sum(a != b for a, b in zip(v, m)), c) for c, m in enumerate(modes)) for v in values]
        costs.append(sum(d for d, _ in near))
        members = defaultdict(list)
        for v, (_, c) in zip(values, near):
            members[c].append(v)
        moved = [
            [min(Counter(col).items(), key=lambda x: (-x[1], x[0]))[0] for col in zip(*members[c])] if c in members else m
            for c, m in enumerate(modes)
        ]
        if moved == modes:
            return modes, costs, [c for _, c in near]
        modes = moved


def test_kmodes_equals_a_run_by_hand(spark):
    rng = random.Random(9)
    base = [[rng.randint(-1, 4) for _ in range(12)] for _ in range(4)]
    values = [[x if rng.random() < 0.75 else rng.randint(-1, 4) for x in rng.choice(base)] for _ in range(150)] + base * 3
    df = spark.createDataFrame([("c" if i % 3 else "d", i, v) for i, v in enumerate(values)], "city string, imei int, calendar array<int>")
    model = kmodes.kmodes(df, 4)
    start = sorted(Counter(map(tuple, values)).items(), key=lambda x: -x[1])
    assert {tuple(b) for b in base} == {t for t, _ in start[:4]}
    labels = {r.imei: (r.cluster, r.mismatches) for r in model.labelled.collect()}
    assert all(a >= b for a, b in zip(model.costs, model.costs[1:]))
    frequent = kmodes.kmodes(df, 4, starts=(kmodes.frequent_start,))
    assert model.costs[-1] <= frequent.costs[-1]
    modes, _, near = kmodes_by_hand(values, model.modes.tolist())
    assert modes == model.modes.tolist() and [labels[i][0] for i in range(len(values))] == near
    assert sum(m for _, m in labels.values()) == model.costs[-1]
    assert sum(r.people for r in kmodes.cluster_sizes(model.labelled).collect()) == len(values)
    assert model.centroids().count() == 4 * 12


def dense_by_hand(values, k):
    """The greedy choice over all rows, one step after the other."""
    counts = [Counter(col) for col in zip(*values)]
    rated = {v: sum(c[x] for c, x in zip(counts, v)) for v in set(map(tuple, values))}
    order = {v: hashlib.md5(",".join(map(str, v)).encode()).hexdigest() for v in rated}
    chosen = []
    while len(chosen) < k:
        score = {v: d * min((sum(a != b for a, b in zip(v, c)) for c in chosen), default=1) for v, d in rated.items()}
        best = min(score, key=lambda v: (-score[v], order[v]))
        if not score[best]:
            break
        chosen.append(best)
    return [list(c) for c in chosen]


@pytest.mark.parametrize("most", [1, 3, 2048])
def test_dense_start_is_the_greedy_choice_however_many_candidates(spark, most):
    rng = random.Random(4)
    values = [[rng.choice([0, 0, 0, 1, 2]) for _ in range(5)] for _ in range(80)] + [[9, 9, 9, 9, 9]]
    df = spark.createDataFrame([(v,) for v in values], "calendar array<int>")
    k = 4 if most == 1 else 9
    assert kmodes.dense_start(df, k, "calendar", most).tolist() == dense_by_hand(values, k)
    few = spark.createDataFrame([([1, 2],)] * 5 + [([1, 3],)], "calendar array<int>")
    assert kmodes.dense_start(few, 9, "calendar", most).tolist() == [[1, 2], [1, 3]]


def test_kmodes_with_fewer_rows_than_clusters(spark):
    df = spark.createDataFrame([("c", i, [i, i]) for i in range(3)], "city string, imei int, calendar array<int>")
    model = kmodes.kmodes(df, 30)
    assert model.costs[-1] == 0 and len(model.modes) == 3
    with pytest.raises(ValueError):
        kmodes.kmodes(df.where("imei > 5"), 2)


def test_user_sample_is_per_city(spark):
    active = spark.createDataFrame([(c, u) for c in "ab" for u in range(40)] * 2, "city string, imei int")
    got = Counter(r.city for r in features.user_sample(active, 15).collect())
    assert got == {"a": 15, "b": 15}
    assert features.user_sample(active, 100).agg(F.count("*")).first()[0] == 80


def test_user_numbers_and_day_keys(spark, rows):
    users = spark.createDataFrame([("c", u) for u in range(50)] * 2 + [("d", 3)], "city string, imei int")
    numbers = features.user_numbers(users)
    assert sorted(r[0] for r in rows(numbers, "imei_number")) == list(range(1, 52))
    days = spark.createDataFrame([("c", 3, 20240101), ("d", 3, 20240102)], "city string, imei int, dayno int")
    keyed = features.with_day_key(days, numbers)
    back = features.from_day_key(keyed.select("city", "imei", "daynum"))
    assert rows(back, "imei_number", "dayno") == rows(keyed, "imei_number", "dayno")


def test_the_whole_study(spark, tmp_path):
    v = Views(spark, str(DATA))
    t = lockdown.CityTables(v.people, v.city_level, v.all_use, v.ads, v.places, v.categories)
    s = lockdown.CitySettings(
        snapshot=SNAPSHOT, use_days=USE_DAYS, weeks=Weeks(20240101, 4), place_weeks=Weeks(20240101, 4), weekly_time=300.0,
        sweep=range(3, 5), topics=4, clusters=3, partitions=3, max_iter=5,
    )
    who, active = lockdown.steady_users(t, s)
    assert active.count() == 13
    packages, apps = lockdown.app_time(t, s, active)
    total = "sum(sumtimes)"
    assert packages.selectExpr(total).first()[0] >= apps.selectExpr(total).first()[0] > 0
    assert lockdown.place_ranks(t, s, who, active).where("imei_number = 1").count() == 4
    train = lockdown.day_features(t, s, active, CATEGORIES)
    scores = lockdown.topic_sweep(train, s, CATEGORIES, str(tmp_path))
    assert [r.k for r in scores.orderBy("k").collect()] == [3, 4]
    assert spark.read.parquet(f"{tmp_path}/mix").groupBy("k").count().count() == 2
    assert spark.read.csv(f"{tmp_path}/share/k=4", header=True).columns[-1] == "topic3"
    clusters = lockdown.user_clusters(train, s, DAYS)
    assert clusters.labelled.count() == 13 and len(clusters.modes) == 3


def test_fixed_point_tells_a_wrong_mode(spark):
    df = spark.createDataFrame([("c", i, [i % 2, 1, i % 2]) for i in range(20)], "city string, imei int, calendar array<int>")
    model = kmodes.kmodes(df, 2)
    assert tuple(kmodes.fixed_point(model).first()) == (20, 0, 0, True)
    wrong = kmodes.KModes(model.modes + np.array([[0, 5, 0], [0, 0, 0]]), model.costs, model.labelled, model.converged)
    assert tuple(kmodes.fixed_point(wrong).first()) == (20, 1, 10, True)


def test_sparse_codes_are_counted_by_value(spark):
    df = spark.createDataFrame([("c", i, [10**9 * (i % 2), -5, i % 2]) for i in range(20)], "city string, imei int, calendar array<int>")
    model = kmodes.kmodes(df, 2)
    assert model.converged and model.costs[-1] == 0 and model.modes.tolist() == [[10**9, -5, 1], [0, -5, 0]] or model.costs[-1] == 0
    limited = kmodes.kmodes(df.unionByName(df.limit(1).selectExpr("city", "99 as imei", "array(7, 7, 7) as calendar")), 2, max_iter=0)
    assert not limited.converged


def test_an_unlisted_category_raises(spark):
    users = spark.createDataFrame([("c", 1)], "city string, imei int")
    use = spark.createDataFrame([(1, "p", 5.0, 1), (1, "q", 7.0, 1)], "imei int, pack_name string, duration double, dayno int")
    cats = spark.createDataFrame([("p", "k1"), ("q", "new")], "pack_name string, newcat string")
    with pytest.raises(Exception, match="category without a column: new"):
        features.category_wide(users, features.use_by_user(use), cats, ["k1"]).collect()


def test_topics_do_not_depend_on_how_rows_are_read(spark, tmp_path):
    names = ["k0", "k1", "k2"]
    rng = random.Random(3)
    data = [("c", u, d, *[rng.random() for _ in names]) for u in range(30) for d in range(5)]
    df = spark.createDataFrame(data, "city string, imei int, dayno int, k0 double, k1 double, k2 double")
    found = []
    for files in (1, 7):
        df.repartition(files).write.parquet(f"{tmp_path}/{files}")
        train = topics.training_rows(spark.read.parquet(f"{tmp_path}/{files}"), names, 4)
        assert train.rdd.getNumPartitions() == 4
        found.append([tuple(r) for r in topics.topic_terms(topics.fit_topics(train, 2, max_iter=5), names).orderBy("topic", "rank").collect()])
    assert found[0] == found[1]


def test_mixes_are_taken_from_the_written_rows(spark, monkeypatch):
    names = vw.CATEGORIES
    rng = random.Random(5)
    data = [("c", u, 20240101 + d, *[rng.random() for _ in names]) for u in range(20) for d in range(3)]
    scaled = spark.createDataFrame(data, "city string, imei int, dayno int, " + ", ".join(f"{n} double" for n in names))
    monkeypatch.setattr(queries, "_scaled", lambda v: scaled)
    mix = queries._mix(None)
    assert "REPARTITION_BY_NUM" not in mix._jdf.queryExecution().toString()
    train = topics.training_rows(scaled, names, vw.LDA_PARTITIONS)
    again = topics.topic_mix(topics.fit_topics(train, 20), train)
    assert mix.count() == 60 and mix.exceptAll(again).count() == 0


def test_use_outside_the_study_is_left_out(spark):
    use = [(u, "p", 5.0, d) for u in range(12) for d in (20240101, 20240201)]
    use = spark.createDataFrame(use, "imei int, pack_name string, duration double, dayno int")
    cats = spark.createDataFrame([("p", "k1"), ("p2", "k2")], "pack_name string, newcat string")
    active = spark.createDataFrame([("c", u) for u in range(12)], "city string, imei int")
    t = lockdown.CityTables(None, None, use, None, None, cats)
    s = lockdown.CitySettings(use_days=(20240101, 20240131), partitions=2)
    got = lockdown.day_features(t, s, active, ["k1", "k2"])
    assert {r.dayno for r in got.collect()} == {20240101} and got.count() == 12  # every user, without a sample
    assert lockdown.day_features(t, lockdown.CitySettings(use_days=(20240101, 20240131), partitions=2, sample=5), active, ["k1", "k2"]).count() == 5


def test_facts_of_users_are_moved_once(spark):
    use = spark.range(4000).selectExpr("id % 60 as imei", "cast(20240101 + id % 9 as int) as dayno", "concat('p', id % 7) as pack_name", "1.0 as duration")
    hot = spark.range(6000).selectExpr("7L as imei", "20240101 as dayno", "'p1' as pack_name", "2.0 as duration")
    users = staging.stage(spark.range(0, 60, 3).selectExpr("id as imei", "'c' as city"), "users")
    cats = spark.createDataFrame([(f"p{i}", f"k{i % 2}") for i in range(7)], "pack_name string, newcat string")
    before = {t.name for t in spark.catalog.listTables()}
    folded = features.use_by_user(use.unionByName(hot), 3)
    assert {t.name for t in spark.catalog.listTables()} == before
    assert folded.where("imei = 7").count() <= 9 * 7 and folded.agg(F.sum("duration")).first()[0] == 16000.0
    scaled = features.scaled_by_mean(features.category_wide(users, folded, cats, ["k0", "k1"]), ["k0", "k1"])
    plan = scaled._jdf.queryExecution().executedPlan().toString()
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            depth = line.index("Exchange")
            below = itertools.takewhile(lambda x: len(x) - len(x.lstrip(" :+-*(0123456789)")) > depth, lines[i + 1 :])
            assert not any("duration" in x for x in below), "only the lists of users and packages may be moved"
    assert "Bucketed: true" in plan and scaled.count() == 20 * 3
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    shuffled = features.scaled_by_mean(features.category_wide(users, folded, cats, ["k0", "k1"]), ["k0", "k1"])
    assert sorted(map(tuple, shuffled.collect())) == sorted(map(tuple, scaled.collect()))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_likelihood_and_its_bound_against_numpy(spark):
    rng = np.random.default_rng(5)
    names, k, n = ["a", "b", "c", "d"], 3, 7
    beta = rng.dirichlet(np.ones(4), k)
    theta = rng.dirichlet(np.ones(k), n)
    x = rng.integers(0, 4, (n, 4)).astype(float)
    x[0] = 0
    weights = spark.createDataFrame([(t, names[w], float(beta[t, w])) for t in range(k) for w in range(4)], "topic int, term string, weight double")
    rows = [("c", i, 1, Vectors.dense(x[i]), [float(v) for v in theta[i]]) for i in range(n)]
    mixes = spark.createDataFrame(rows, ["city", "imei", "dayno", "features", "mix"])
    got = {r.imei: r for r in topics.likelihood_bounds(mixes, weights, names).collect()}
    chances, shares = theta @ beta, x.sum(axis=0) / x.sum()
    for i in range(n):
        assert got[i].likelihood == pytest.approx((x[i] * np.log(chances[i])).sum())
        assert got[i].bound == pytest.approx(got[i].likelihood) and got[i].size == x[i].sum()
        assert got[i].one_topic == pytest.approx((x[i] * np.log(shares)).sum())
    ties = spark.createDataFrame([(0, "a", 0.254), (0, "b", 0.254), (0, "c", 0.492), (1, "c", 1.0)], "topic int, term string, weight double")
    listed = sorted(tuple(r) for r in topics.heaviest_terms(ties, 2).collect())
    assert listed == [(0, 1, "c", 0.49), (0, 2, "a", 0.25), (1, 1, "c", 1.0)]


def test_likelihood_bounds_go_to_numpy_in_blocks(spark, monkeypatch):
    """Functions on arrays took most of the time: they are interpreted, several times for each topic and term of a row."""
    monkeypatch.setattr(topics, "BOUND_ROWS", 3, raising=False)
    names, rng = ["k0", "k1", "k2", "k3"], random.Random(8)
    beta = [[0.4, 0.1], [0.3, 0.0], [0.3, 0.9], [0.0, 0.0]]  # a topic without k1, and k3 in none
    weights = spark.createDataFrame([(t, names[i], beta[i][t]) for i in range(4) for t in (0, 1)], "topic int, term string, weight double")
    rows = [(u, [rng.choice([0.0, rng.random()]), rng.random(), 2 * rng.random(), 0.0], rng.random()) for u in range(1, 40)]
    rows += [(None, [0.0] * 4, 0.5), (7, [0.0, 1.0, 0.0, 0.0], 0.5), (7, [0.0, 1.0, 0.0, 0.0], 0.5), (50, [1.0, 0.0, 0.0, 2.0], 0.3)]
    values = [("c", u, 3, Vectors.dense(x), [t, 1 - t]) for u, x, t in rows]
    kind = StructType().add("city", "string").add("imei", "long").add("dayno", "integer").add("features", VectorUDT()).add("mix", ArrayType(DoubleType()))
    bounds = topics.likelihood_bounds(spark.createDataFrame(values, kind).repartition(2), weights, names)
    assert [f.simpleString() for f in bounds.schema][:3] == ["city:string", "imei:bigint", "dayno:int"]

    totals = [sum(x[i] for _, x, _ in rows) for i in range(4)]

    def by_hand(u, x, t):
        joint = [[b * m for b, m in zip(w, (t, 1 - t))] for w in beta]
        p = [sum(j) for j in joint]
        unknown = any(v > 0 and not c for v, c in zip(x, p))
        likelihood = None if unknown else sum(v * math.log(c) for v, c in zip(x, p) if v > 0)
        bound = sum(v * sum(j / c * math.log(j / (j / c)) for j in js if j > 0) for v, js, c in zip(x, joint, p))
        one = sum(v * math.log(s / sum(totals)) for v, s in zip(x, totals) if v > 0)
        return tuple(None if v is None else round(v, 9) for v in (u, sum(x), likelihood, bound, one))

    got = Counter(tuple(None if v is None else round(v, 9) + 0.0 for v in (r.imei, r["size"], r.likelihood, r.bound, r.one_topic)) for r in bounds.collect())
    assert got == Counter(tuple(None if v is None else v + 0.0 for v in by_hand(*r)) for r in rows)
    assert sum(k[2] is None for k in got) == 1
    plan = bounds._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "zip_with" not in plan and "transform(" not in plan
