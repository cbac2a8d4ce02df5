"""Sweeps that infer all models together, against MLlib's fits."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from footfall.operators import topics, variational


@pytest.fixture(scope="module")
def train(spark):
    """72 user-days in 3 partitions; a sixth holds nothing."""
    rng, names = random.Random(7), [f"k{i}" for i in range(6)]
    data = [
        ("c", u, d, *[0.0 if u % 6 == 0 or rng.random() < 0.4 else rng.random() * 3 for _ in names])
        for u in range(36)
        for d in (1, 2)
    ]
    df = spark.createDataFrame(data, "city string, imei int, dayno int, " + ", ".join(f"{n} double" for n in names))
    return topics.training_rows(df, names, 3)


def test_all_models_come_from_one_reading(train, monkeypatch):
    fitted, fit = [], topics._fit

    def counted(rows, k, max_iter, *more):
        fitted.append((rows.count(), max_iter))
        return fit(rows, k, max_iter, *more)

    monkeypatch.setattr(topics, "_fit", counted)
    got = topics.sweep(train, [2, 3, 5], max_iter=3).collect()
    assert [r.k for r in got] == [2, 3, 5]
    assert fitted == [(1, 0)] * 3  # MLlib only gives the topics to start from


def test_a_sweep_says_what_mllib_says(train):
    """Rounds enough for some that draw nothing, and documents that hold nothing."""
    got = topics.sweep(train, [2, 5, 2], max_iter=40).collect()
    assert [r.k for r in got] == [2, 5, 2] and got[0] == got[2]
    for r in got[:2]:
        model = topics.fit_topics(train, r.k, max_iter=40)
        assert r.log_likelihood == pytest.approx(model.logLikelihood(train), rel=1e-6)
        assert r.log_perplexity == pytest.approx(model.logPerplexity(train), rel=1e-6)


def test_a_sweep_without_rounds_or_models(train):
    model = topics.fit_topics(train, 3, max_iter=0)
    assert topics.sweep(train, [3], max_iter=0).first().log_likelihood == pytest.approx(model.logLikelihood(train))
    assert topics.sweep(train, []).count() == 0


def test_kept_models_have_the_same_scores(train):
    kept = {}
    with_models = topics.sweep(train, [2, 4], max_iter=4, keep=kept.__setitem__).collect()
    alone = topics.sweep(train, [2, 4], max_iter=4).collect()
    assert sorted(kept) == [2, 4]
    assert [r.log_likelihood for r in alone] == pytest.approx([r.log_likelihood for r in with_models], rel=1e-6)


def test_starting_points():
    """Few numbers are drawn for all seeds at once, many seed by seed; a thousand seeds hold variates that are not kept."""
    seeds = np.concatenate([np.arange(-500, 500), [2**40 + 3, -(2**63), 2**63 - 1]])
    few = variational.starting_points(seeds, 20)
    assert np.array_equal(few, variational.starting_points(seeds, 60)[:, :20])
    assert np.array_equal(few[:, :7], variational.starting_points(seeds, 7))
    assert few.mean() == pytest.approx(1.0, abs=0.005) and few.std() == pytest.approx(0.1, abs=0.005)


def test_special_functions():
    x = np.array([0.01, 0.3, 1.0, 2.5, 40.0])
    assert variational.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], abs=1e-9)
    assert variational.digamma(np.array([1.0, 0.5])) == pytest.approx([-np.euler_gamma, -np.euler_gamma - 2 * math.log(2)], abs=1e-9)
    assert variational.digamma(x + 1) - variational.digamma(x) == pytest.approx(1 / x, rel=1e-9)
    assert variational.exp_digamma(x) == pytest.approx(np.exp(variational.digamma(x)), rel=1e-12)
    assert variational.trigamma(np.array([1.0])) == pytest.approx([math.pi**2 / 6], abs=1e-9)
    assert variational.trigamma(x) - variational.trigamma(x + 1) == pytest.approx(1 / x**2, rel=1e-9)
