from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from conftest import DATA
from footfall.catalogue.views import AD_DAYS, SNAPSHOT, USE_DAYS, Views
from footfall.functions.calendar import Campaign
from footfall.operators import categories, cohort, did, exposure, facts, ols, panel, portrait
from footfall.plans import ad_effect
from footfall.sources import staging

DAYS = (20210201, 20210425)
CAMPAIGN = Campaign.from_days((20210201, 20210301, 20210329, 20210426))


def test_exposure_summary_counts_ads_once_and_sums_every_row(spark, rows):
    ads = spark.createDataFrame(
        [(1, "b", "c"), (2, "b", "c"), (3, "b", "d"), (4, "z", "c")], "ad_id int, brand_name string, app_cat2_name string"
    )
    seen = spark.createDataFrame(
        [(1, 9, 6000, 20210201), (1, 8, 3000, 20210425), (2, 9, 1000, 20210301), (3, 9, 9999, 20210301),
         (4, 9, 50000, 20210426)],
        "ad_id int, imei int, expose_cnt long, dayno int",
    )
    totals = exposure.ad_totals(seen, DAYS)
    summary = exposure.exposure_summary(ads, totals)
    assert rows(summary) == [("b", "c", 10000, 2), ("b", "d", 9999, 1)]
    apps = exposure.advertised_apps(summary)
    assert rows(apps) == [("b", "c")]
    kept = exposure.kept_ads(ads, apps)
    for counts in (None, totals):
        assert rows(exposure.exposed_people(kept, seen, DAYS, counts)) == [(8, "b"), (9, "b")]


def ring_controls(population, exposed, n_controls):
    """What the ring should give, spelled out user by user."""
    order = sorted(set(population), key=lambda u: (hashlib.md5(str(u).encode()).hexdigest(), u))
    out = []
    for app, n in n_controls.items():
        start = int(hashlib.md5(app.encode()).hexdigest()[:8], 16) % len(order)
        walk = order[start:] + order[:start]
        out += [(u, app) for u in [u for u in walk if (u, app) not in exposed][:n]]
    return sorted(out)


@pytest.mark.parametrize("block", [3, 16, 4096])
def test_controls_walk_the_ring(spark, block):
    rng = random.Random(block)
    population = list(range(200))
    exposed = {(u, a) for a, share in (("x", 0.9), ("y", 0.2), ("z", 0.5)) for u in range(220) if rng.random() < share}
    n_controls = {"x": 50, "y": 30, "z": 120}
    seen = Counter(a for _, a in exposed)
    sizes = spark.createDataFrame([(a, n, seen[a]) for a, n in n_controls.items()], "appname string, n_controls long, n_seen long")
    got = cohort.unexposed_controls(
        spark.createDataFrame([(u,) for u in population * 2], "imei int"),
        spark.createDataFrame(sorted(exposed), "imei int, appname string"),
        sizes,
        block,
    )
    assert sorted(map(tuple, got.collect())) == ring_controls(population, exposed, n_controls)


def test_matched_cohort_is_disjoint_and_balanced(spark):
    rng = random.Random(3)
    exposed = [(u, a) for a in ("a", "b") for u in range(300) if rng.random() < 0.5]
    use = [(u, a, 20210210) for u, a in exposed if rng.random() < 0.3] + [(u, "a", 20210426) for u in range(300)]
    use += use[:20]
    people = cohort.matched_cohort(
        spark.createDataFrame(exposed, "imei int, appname string"),
        spark.createDataFrame(use, "imei int, appname string, dayno int"),
        spark.range(1000).select(F.col("id").cast("int").alias("imei")),
        DAYS,
    ).collect()
    assert len(people) == len({(r.imei, r.appname) for r in people})
    active = {(u, a) for u, a, d in use if d <= DAYS[1]}
    for app in ("a", "b"):
        mine = [r for r in people if r.appname == app]
        treated = {(r.imei, app) for r in mine if r.is_expose == 1}
        n = len([p for p in active if p[1] == app])
        idle = len([p for p in exposed if p[1] == app and p not in active])
        assert {p for p in active if p[1] == app} <= treated <= set(exposed)
        assert len(treated) == n + min(n, idle)
        controls = {(r.imei, app) for r in mine if r.is_expose == 0}
        assert len(controls) == len(treated) and not controls & set(exposed)


def test_no_controls_beyond_the_population(spark):
    exposed = spark.createDataFrame([(u, "a") for u in range(8)], "imei int, appname string")
    sizes = spark.createDataFrame([("a", 50, 8)], "appname string, n_controls long, n_seen long")
    got = cohort.unexposed_controls(spark.createDataFrame([(u,) for u in range(10)], "imei int"), exposed, sizes)
    assert sorted(r.imei for r in got.collect()) == [8, 9]


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame([(1, "a", 1), (1, "b", 1), (2, "a", 0)], "imei int, appname string, is_expose int")


def test_installs_ignore_upgrades_and_repeats(spark, rows, pairs):
    installs = spark.createDataFrame(
        [(1, "a", 20210201, 0), (1, "a", 20210202, 0), (1, "a", 20210301, 1), (2, "a", 20210425, 0), (3, "a", 20210301, 0),
         (2, "a", 20210426, 0)],
        "imei int, appname string, dayno int, is_upgrade_install int",
    )
    got = facts.installs_by_period(pairs, installs, CAMPAIGN)
    assert rows(got, "imei", "appname", "is_expose", "time") == [(1, "a", 1, "before"), (2, "a", 0, "after")]


def test_pay_belongs_to_one_period(spark, rows, pairs):
    pay = spark.createDataFrame(
        [(1, "a", 20210301, 20210301), (1, "a", 20210301, 20210329), (2, "a", 20210228, 20210301), (2, "a", 20210228, 20210329)],
        "imei int, appname string, recent_pay_dayno int, dayno int",
    )
    got = facts.pay_by_period(pairs, pay, CAMPAIGN)
    assert rows(got, "imei", "appname", "time") == [(1, "a", "now"), (2, "a", "before")]


def test_click_flags_do_not_fan_out(spark, rows, pairs):
    clicks = spark.createDataFrame(
        [(1, "a", 20210301, 1), (1, "a", 20210302, 4), (2, "a", 20210303, 0), (1, "b", 20210329, 1)],
        "imei int, appname string, dayno int, click_nums int",
    )
    assert rows(facts.click_flags(pairs, clicks, CAMPAIGN)) == [(1, "a", 1, 1), (1, "b", 1, 0), (2, "a", 0, 0)]


def test_search_names_are_plain_text_by_default(spark, rows):
    people = spark.createDataFrame([(1, "a.b", 1), (1, "(x", 1), (2, "q", 0)], "imei int, appname string, is_expose int")
    asked = spark.createDataFrame(
        [(1, "get a.b", 20210301), (1, "get a.b", 20210301), (1, "axb", 20210301), (1, "(x now", 20210201), (2, "z", 20210301)],
        "imei int, query string, dayno int",
    )
    got = facts.search_by_period(people, asked, CAMPAIGN)
    assert rows(got, "appname", "time", "searchnum") == [("(x", "before", 1), ("a.b", "now", 2)]
    named = people.where("appname = 'a.b'")
    assert rows(facts.search_by_period(named, asked, CAMPAIGN, regex=True), "searchnum") == [(3,)]


def test_period_panel_is_zero_filled(spark, rows, pairs):
    use = spark.createDataFrame([(1, "a", 20210201, 2.0), (1, "a", 20210202, 3.0)], "imei int, appname string, dayno int, duration double")
    got = facts.period_panel(pairs, facts.use_folded(use, CAMPAIGN), CAMPAIGN)
    assert got.count() == 9
    assert rows(got.where("sum_data > 0"), "imei", "appname", "time", "sum_data") == [(1, "a", "before", 5.0)]


def test_use_without_a_duration_is_still_use(spark, rows, pairs):
    use = spark.createDataFrame([(1, "a", 20210201, None)], "imei int, appname string, dayno int, duration double")
    assert rows(facts.use_by_period(pairs, use, CAMPAIGN), "imei", "time", "duration") == [(1, "before", 0.0)]


def test_conversion_panel_equals_the_single_facts(spark, pairs):
    use = spark.createDataFrame([(1, "a", 20210201, 2.0), (2, "a", 20210330, 3.0)], "imei int, appname string, dayno int, duration double")
    installs = spark.createDataFrame([(1, "a", 20210301, 0)] * 2, "imei int, appname string, dayno int, is_upgrade_install int")
    asked = spark.createDataFrame([(1, "b here", 20210329)] * 3, "imei int, query string, dayno int")
    clicks = spark.createDataFrame([(1, "b", 20210301, 2)], "imei int, appname string, dayno int, click_nums int")
    got = {(r.imei, r.appname): r for r in panel.conversion_panel(pairs, use, installs, asked, clicks, CAMPAIGN).collect()}
    assert len(got) == 3
    assert (got[1, "a"].beforeuse, got[1, "a"].nowdown, got[1, "a"].isclick) == (2.0, 1, 0)
    assert (got[1, "b"].aftersearch, got[1, "b"].isclick, got[1, "b"].nowuse) == (3, 1, 0.0)
    assert (got[2, "a"].afteruse, got[2, "a"].is_expose) == (3.0, 0)


def test_app_groups_from_three_lookups(spark, rows):
    ads = spark.createDataFrame(
        [("n", "p1", "news", 5), ("g", "p2", "game", 5), ("h", "p3", "game", 5), ("n", "p1", "news", 6)],
        "brand_name string, package_name string, app_cat2_name string, dayno int",
    )
    app_cat = spark.createDataFrame([("news", "H"), ("game", "G")], "x string, y string")
    game_cat = spark.createDataFrame([("g", "game", "是"), ("h", "game", "否")], "x string, y string, z string")
    got = categories.app_groups(ads, app_cat, game_cat, 5)
    assert rows(got) == [("g", "p2", "game", "GH"), ("h", "p3", "game", "GL"), ("n", "p1", "news", "H")]


def test_category_time_covers_every_cohort_user(spark, rows, pairs):
    used = spark.createDataFrame([(1, "a", 2.0), (1, "b", 3.0)], "imei int, appname string, duration double")
    groups = spark.createDataFrame([("a", "p", "H"), ("a", "q", "H"), ("b", "r", "GL")], "appname string, package_name string, hl string")
    assert rows(categories.category_time(pairs, used, groups)) == [(1, 0.0, 3.0, 2.0, 0.0), (2, 0.0, 0.0, 0.0, 0.0)]


def test_portrait_rows_and_indicators(spark, rows, pairs):
    people = spark.createDataFrame(
        [(1, None, 1, 0, "500", "m", 5), (2, "c", None, 9, None, "m", 5), (3, "c", 0, 1, "1", "none", 5), (1, "c", 1, 0, "500", "m", 6)],
        "imei int, city string, base_gender int, base_age int, on_price string, model string, dayno int",
    )
    levels = spark.createDataFrame([("m", "new1"), ("o", "2")], "model string, city_level string")
    who = portrait.people_portrait(people, levels, 5)
    assert rows(who) == [(1, "nan", "man", "_17", "new1", "_1000"), (2, "c", "nan", "nan", "new1", "_6000")]
    wide = {r.imei: r for r in portrait.portrait_indicators(pairs, who).collect()}
    assert sorted(wide) == [1, 2]
    assert wide[1].base_gender_man == 1 and wide[2].base_gender_man == wide[2].base_gender_woman == 0


def did_by_hand(use, who, keys):
    """Rates per app from sets of users."""
    attr = {r["imei"]: tuple(r[k] for k in keys) for r in who}
    n, m = defaultdict(set), defaultdict(set)
    for imei, app, e, t in use:
        if imei in attr:
            n[app, attr[imei], e].add(imei)
            m[app, attr[imei], e, t].add(imei)
    out = {}
    for app in {a for a, _, _ in n}:
        shared = [s for a, s, e in n if a == app and e == 1 and (app, s, 0) in n]
        total = sum(len(n[app, s, 1]) + len(n[app, s, 0]) for s in shared)
        for e in (1, 0):
            for t in ("before", "now", "after"):
                out[app, f"{t}{e}"] = sum(
                    (len(n[app, s, 1]) + len(n[app, s, 0])) / total * len(m[app, s, e, t]) / len(n[app, s, e]) for s in shared
                )
    return out


def test_did_equals_a_count_by_hand(spark):
    rng = random.Random(5)
    use = [
        (u, a, (u + (a == "b")) % 2, t)
        for u in range(120) for a in ("a", "b") for t in CAMPAIGN.labels if rng.random() < 0.4
    ]
    who = [{"imei": u, "g": rng.choice("mw"), "c": rng.choice("123")} for u in range(115)]
    facts_df = spark.createDataFrame([(*r, 1.0) for r in use] * 2, "imei int, appname string, is_expose int, time string, duration double")
    cells = did.strata(facts_df, spark.createDataFrame(who).select("imei", "g", "c"), ["g", "c"], CAMPAIGN)
    expected = did_by_hand(use, who, ["g", "c"])
    got = did.did_by_app(cells, CAMPAIGN).collect()
    assert len(got) == 2
    for r in got:
        for e in (1, 0):
            for t in CAMPAIGN.labels:
                assert r[f"{t}{e}"] == pytest.approx(expected[r.appname, f"{t}{e}"])
        assert r.did_now == pytest.approx((r.now1 - r.before1) - (r.now0 - r.before0))


def test_did_of_two_worked_strata(spark):
    cells = spark.createDataFrame(
        [("a", "s1", 2, 4, 1, 1, 2, 2, 0, 4), ("a", "s2", 4, 2, 4, 0, 2, 1, 1, 1), ("a", "s3", 9, 0, 9, 0, 9, 0, 9, 0),
         ("b", "s1", 1, 0, 1, 0, 1, 0, 1, 0)],
        "appname string, s string, n1 long, n0 long, m1_before long, m0_before long, m1_now long, m0_now long, m1_after long, m0_after long",
    )
    a, b = sorted(did.did_by_app(cells, CAMPAIGN).collect(), key=lambda r: r.appname)
    assert (a.expose_layer_num, a.noexpose_layer_num, a.use_layer_num, a.expose1_people, a.expose0_people) == (3, 2, 2, 6, 6)
    assert (a.before1, a.before0, a.now1, a.now0) == pytest.approx((0.75, 0.125, 0.75, 0.5))
    assert (a.did_now, a.did_after) == pytest.approx((-0.375, 0.125 - 0.75 - (0.75 - 0.125)))
    assert (b.use_layer_num, b.before1, b.did_now) == (0, 0.0, 0.0)


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(11)
    n = 600
    pdf = pd.DataFrame({"app": rng.choice(["a", "b", "c"], n), **{f"x{i}": rng.normal(size=n) for i in range(4)}})
    pdf["x3"] = pdf["x3"].where(pdf["app"] != "c", 2.0)
    pdf["x4"] = pdf["x0"] - 2 * pdf["x1"] + 1
    pdf["y1"] = 1 + 2 * pdf["x0"] - pdf["x2"] + rng.normal(size=n)
    pdf["y2"] = pdf["x1"] * 3 + rng.normal(size=n)
    return pdf


X = ["x0", "x1", "x2", "x3", "x4"]


def test_ols_equals_least_squares(spark, regression):
    gap = pd.concat([regression, regression[:1].assign(app="a", x0=-99.0)])
    df = spark.createDataFrame(gap).withColumn("x0", F.when(F.col("x0") != -99.0, F.col("x0")))
    got = ols.ols_by_group(df, "app", X, ["y1", "y2"]).toPandas().set_index(["app", "term"])
    for app, part in regression.groupby("app"):
        aliased = {"x4"} | ({"x3"} if app == "c" else set())
        terms = [t for t in X if t not in aliased]
        z = np.column_stack([np.ones(len(part)), part[terms]])
        inv = np.linalg.inv(z.T @ z)
        for k, y in (("1", "y1"), ("2", "y2")):
            b = inv @ z.T @ part[y].to_numpy()
            residual = part[y].to_numpy() - z @ b
            se = np.sqrt(np.diag(inv) * (residual @ residual) / (len(part) - z.shape[1]))
            rows = got.loc[app].loc[["intercept", *terms]]
            assert rows[f"c{k}"].to_numpy() == pytest.approx(b, abs=1e-8)
            assert rows[f"se{k}"].to_numpy() == pytest.approx(se, abs=1e-8)
            r2 = 1 - residual @ residual / ((part[y] - part[y].mean()) ** 2).sum()
            assert rows[f"r2_{k}"].iloc[0] == pytest.approx(r2)
            assert np.abs(z.T @ residual).max() < 1e-8
        assert set(got.loc[app].index[got.loc[app]["aliased"]]) == aliased
        assert got.loc[app].loc[sorted(aliased), "c1"].isna().all()
        assert (got.loc[app]["n"] == len(part)).all()


def test_ols_equals_mllib(spark, regression):
    x = X[:4]
    df = spark.createDataFrame(regression).where("app = 'a'")
    mine = {r.term: r for r in ols.ols_by_group(df, "app", x, ["y1", "y2"]).collect()}
    train = VectorAssembler(inputCols=x, outputCol="features").transform(df)
    model = LinearRegression(labelCol="y1", solver="normal", regParam=0.0, elasticNetParam=1.0).fit(train)
    errors = model.summary.coefficientStandardErrors
    assert [mine[t].c1 for t in x] == pytest.approx(list(model.coefficients), abs=1e-9)
    assert [mine[t].se1 for t in [*x, "intercept"]] == pytest.approx(errors, abs=1e-9)
    assert mine["intercept"].c1 == pytest.approx(model.intercept) and mine["x0"].r2_1 == pytest.approx(model.summary.r2)


def test_ols_tasks_hand_on_their_triangles(spark, regression, monkeypatch):
    columns = [*X, "y1", "y2"]
    monkeypatch.setattr(ols, "FLUSH_GROUPS", 1)
    run = ols._triangles("app", columns)
    parts = list(run(iter([regression[:300], regression[300:]])))
    assert len(parts) == 2 and sum(p["n"].sum() for p in parts) == len(regression)
    z = np.column_stack([np.ones(len(regression)), regression[columns]])
    squares = [ols._unpack(r, len(columns) + 1) for p in parts for r in p["r"]]
    assert sum(r.T @ r for r in squares) == pytest.approx(z.T @ z)
    alike = pd.concat(parts).assign(app="all")
    (one,) = ols._merged("app", len(columns) + 1)(iter([alike[:2], alike[2:]]))
    r = ols._unpack(one["r"][0], len(columns) + 1)
    assert one["n"].tolist() == [len(regression)] and r.T @ r == pytest.approx(z.T @ z)


def test_every_group_has_rows_and_a_status(spark, regression):
    few = regression[regression["app"] == "a"][:3].assign(app="few")
    lost = regression[:5].assign(app="lost", x1=np.nan)
    wild = regression[:4].assign(app="wild", y1=np.inf)
    df = spark.createDataFrame(pd.concat([regression, few, lost, wild, lost.assign(app=None)]))
    got = ols.ols_by_group(df, "app", X, ["y1"]).toPandas().set_index(["app", "term"])
    assert set(got.index) == {(a, t) for a in ["a", "b", "c", "few", "lost", "wild"] for t in ["intercept", *X]}
    state = got.groupby("app")["status"].agg(set)
    assert state["a"] == {"fitted"} and state["few"] == {"no degrees of freedom"} and state["lost"] == state["wild"] == {"no complete rows"}
    assert got.loc["lost", ["c1", "se1", "r2_1"]].isna().all(axis=None) and (got.loc["lost", "n"] == 0).all()
    assert got.loc["few", "se1"].isna().all() and got.loc["few", "r2_1"].tolist() == pytest.approx([1.0] * 6)
    assert ols.ols_by_group(df.limit(0), "app", X, ["y1"]).count() == 0


def test_nearly_dependent_predictors_keep_their_digits(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=400)
    pdf = pd.DataFrame({"app": "a", "x": 1e6 + x, "z": 1e6 + x + 1e-3 * rng.normal(size=400)})
    pdf["y"] = pdf["x"] - 1e6 + 2 * (pdf["z"] - 1e6)
    got = {r.term: r.c1 for r in ols.ols_by_group(spark.createDataFrame(pdf), "app", ["x", "z"], ["y"]).collect()}
    assert (got["x"], got["z"]) == pytest.approx((1.0, 2.0), abs=1e-5)


def test_baselines_are_the_same_for_every_app(spark):
    names = panel.indicator_names()
    rng = np.random.default_rng(4)
    rows = []
    for app in ("known", "unknown"):
        for i in range(400):
            marks = dict.fromkeys(names, 0)
            for attribute, levels in panel.INDICATORS.items():
                if app == "known" or rng.random() < 0.8:
                    marks[rng.choice(list(levels.values()))] = 1
            rows.append({"imei": i, "appname": app, "y": 2.0 * marks["base_gender_woman"] + rng.normal(scale=1e-9), **marks})
    design = panel.regression_design(spark.createDataFrame(pd.DataFrame(rows)))
    portrait_terms = [p for p in panel.PREDICTORS if p not in panel.BEHAVIOUR]
    got = ols.ols_by_group(design, "appname", portrait_terms, ["y"]).toPandas().set_index(["appname", "term"])
    assert not set(panel.BASELINES.values()) & set(panel.PREDICTORS) and len(panel.PREDICTORS) == 27
    assert got.loc["known"].loc["base_gender_woman", "c1"] == pytest.approx(2.0, abs=1e-6)
    assert got.loc["unknown"].loc["base_gender_woman", "c1"] == pytest.approx(2.0, abs=1e-6)
    assert got.loc["known"].loc["base_gender_nan", "aliased"] and not got.loc["unknown"].loc["base_gender_nan", "aliased"]
    assert not got.loc["known"].drop(index=[f"{a}_nan" for a in panel.INDICATORS])["aliased"].any()


def test_too_few_rows_have_no_standard_error(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0, 3.0), ("a", 2.0, 4.0, 1.0)], "app string, x double, y1 double, y2 double")
    got = ols.ols_by_group(df, "app", ["x"], ["y1", "y2"]).collect()
    assert [r.se1 for r in got] == [None, None] and [r.c1 for r in got] == pytest.approx([0.0, 2.0])


def test_normal_equations_show_a_wrong_fit(spark, regression):
    df = spark.createDataFrame(regression).withColumn("imei", F.monotonically_increasing_id())
    fits = ols.ols_by_group(df, "app", X, ["y1", "y2"])
    good = ols.normal_equations(df, fits, "app", X, ["y1", "y2"]).collect()
    assert sum(r.n for r in good) == len(regression) and max(max(r.gap_r1, r.gap_r2) for r in good) < 1e-8
    wrong = fits.withColumn("c2", F.col("c2") + 0.01)
    assert min(r.gap_r2 for r in ols.normal_equations(df, wrong, "app", X, ["y1", "y2"]).collect()) > 0.1


def test_normal_equations_move_and_multiply_no_rows(spark):
    """The rows meet short coefficients where they are, and are not repeated for every predictor."""
    data = spark.range(20000).select(
        F.concat(F.lit("a"), (F.col("id") % 2).cast("string")).alias("app"), F.col("id").alias("imei"),
        F.when(F.col("id") != 7, F.sin("id")).alias("x1"), F.cos("id").alias("x2"), F.sqrt("id").alias("y1"),
    )
    fits = spark.createDataFrame(
        [(app, term, c) for app in ("a0", "a1") for term, c in (("intercept", 2.0), ("x1", 0.5), ("x2", None))], "app string, term string, c1 double"
    )
    data = staging.stage(data.withColumn("other", F.md5(F.col("imei").cast("string"))), "rows")
    gaps = ols.normal_equations(data, fits, "app", ["x1", "x2"], ["y1"])
    plan = gaps._jdf.queryExecution().executedPlan().toString()
    assert "posexplode" not in plan and plan.count("BroadcastExchange") == 1
    assert "x1" not in plan.split("BroadcastExchange")[1]
    got = {r.app: r for r in gaps.collect()}
    for a in (0, 1):
        i = np.arange(a, 20000, 2, dtype=float)
        whole = i != 7  # a row with a gap is counted and has no residual
        r = np.sqrt(i) - 2.0 - 0.5 * np.sin(i)
        sums = [abs((value * r)[whole].sum()) for value in (np.ones(len(i)), np.sin(i), np.cos(i))]
        assert got[f"a{a}"].n == 10000 and got[f"a{a}"].gap_r1 == pytest.approx(max(sums))


def test_effect_of_both_kinds_end_to_end(spark):
    v = Views(spark, str(DATA))
    tables = ad_effect.AdTables(v.ads, v.exposures, v.app_use, v.browsers, v.people, v.city_level)
    days = Campaign.from_days((20240101, 20240111, 20240121, 20240131))
    settings = ad_effect.AdSettings(SNAPSHOT, SNAPSHOT, AD_DAYS, AD_DAYS, USE_DAYS, days, 1000)
    people = ad_effect.analysis_people(tables, settings)
    direct = cohort.matched_cohort(
        exposure.exposed_people(
            exposure.kept_ads(v.ads, exposure.advertised_apps(exposure.exposure_summary(v.ads, exposure.ad_totals(v.exposures, AD_DAYS)), 1000)),
            v.exposures, AD_DAYS,
        ),
        v.app_use, v.browsers, USE_DAYS,
    )
    assert people.exceptAll(direct).count() == 0 and people.count() == direct.count() > 0
    assert ad_effect.effect_by_strata(tables, settings, people).count() > 0
    fits = ad_effect.effect_by_regression(
        tables, settings, people, installs=v.installs, searches=v.searches, clicks=v.clicks, groups=v.app_group
    )
    assert fits.count() == people.select("appname").distinct().count() * (len(panel.PREDICTORS) + 1)


@pytest.mark.parametrize("responses", [["y1"], ["y1", "y2", "x4"]])
def test_any_number_of_responses(spark, regression, responses):
    df = spark.createDataFrame(regression).withColumn("imei", F.monotonically_increasing_id())
    two = {(r.app, r.term): r for r in ols.ols_by_group(df, "app", X[:3], ["y1", "y2"]).collect()}
    fits = ols.ols_by_group(df, "app", X[:3], responses)
    assert len(fits.columns) == 5 + 3 * len(responses)
    for r in fits.collect():
        assert (r.c1, r.se1, r.r2_1) == pytest.approx((two[r.app, r.term].c1, two[r.app, r.term].se1, two[r.app, r.term].r2_1))
    gaps = ols.normal_equations(df, fits, "app", X[:3], responses)
    assert len(gaps.columns) == 2 + len(responses) and max(max(tuple(r)[2:]) for r in gaps.collect()) < 1e-8


def test_searches_are_the_same_with_a_broadcast_and_a_shuffled_index(spark, rows):
    people = spark.createDataFrame([(1, "ab", 1), (1, "b.", 1), (2, "ab", 0), (2, None, 0)], "imei int, appname string, is_expose int")
    asked = [(1, "get ab. free", 20210201), (1, "get ab. free", 20210201), (2, "b. ab", 20210302), (3, "ab", 20210301), (1, None, 20210301), (2, "xb", 20210301)]
    asked = spark.createDataFrame(asked, "imei int, query string, dayno int")
    for regex in (False, True):
        found = facts.by_period(people, facts.searches_folded(people, asked, CAMPAIGN, regex=regex), CAMPAIGN, "n")
        inside = rows(found, "imei", "appname", "time", "n")
        assert inside == [(1, "ab", "before", 2), (1, "b.", "before", 2), (2, "ab", "now", 1)]
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        found = facts.by_period(people, facts.searches_folded(people, asked, CAMPAIGN, regex=regex), CAMPAIGN, "n")
        assert rows(found, "imei", "appname", "time", "n") == inside
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_text_of_a_search_is_moved(spark):
    people = spark.createDataFrame([(1, "ab", 1)], "imei int, appname string, is_expose int")
    asked = spark.createDataFrame([(1, "get ab", 20210201)], "imei int, query string, dayno int")
    plan = facts.searches_folded(people, asked, CAMPAIGN)._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(moved) == 1 and "imei" in moved[0] and "query" not in moved[0]


def test_threshold_and_exposure_days_are_apart(spark, rows):
    ads = spark.createDataFrame([(1, "a", "c", 5), (2, "b", "c", 5)], "ad_id int, brand_name string, app_cat2_name string, dayno int")
    seen = [(1, 7, 10, 20210310), (2, 7, 10, 20210205), (1, 8, 1, 20210210), (1, 9, 1, 20210601)]
    seen = spark.createDataFrame(seen, "ad_id int, imei int, expose_cnt long, dayno int")
    use = spark.createDataFrame([(7, "a", 1.0, 20210301)], "imei int, appname string, duration double, dayno int")
    tables = ad_effect.AdTables(ads, seen, use, spark.range(30).selectExpr("int(id) as imei"), None, None)
    settings = ad_effect.AdSettings(5, 5, (20210301, 20210328), DAYS, DAYS, CAMPAIGN, 10)
    people = ad_effect.analysis_people(tables, settings)
    assert rows(people.where("is_expose = 1"), "imei", "appname") == [(7, "a"), (8, "a")]
