from __future__ import annotations

import math
import random
import statistics as pystat

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs

from quire.functions import maths as m
from quire.operators import statistics as st


@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(4)
    rows = [(g, float(rng.choice([0, 1, 2, 2, 5, 9, 13.5, 40])) + rng.random() * (g == "b")) for g in "abc" for _ in range(60)] + [("one", 3.0), ("none", None)]
    df = spark.createDataFrame([(g, x, 1) for g, x in rows], "g string, v double, x int").cache()
    values: dict[str, list[float]] = {}
    for g, x in rows:
        if x is not None:
            values.setdefault(g, []).append(x)
    return df, values


def _by(df, column):
    return {r.g: r[column] for r in df.collect()}


def _near(got, want):
    assert set(got) == set(want)
    for k, x in want.items():
        assert got[k] == pytest.approx(x, rel=1e-9, abs=1e-9), k


def test_order_statistics(sample):
    df, values = sample
    _near(_by(st.median(df, ["g"], "v"), "median"), {g: pystat.median(x) for g, x in values.items()})
    _near(_by(st.quantile_linear(df, ["g"], "v", 0.3), "quantile"), {g: float(np.quantile(x, 0.3)) for g, x in values.items()})
    _near(_by(st.bottom_average(df, ["g"], "v", 1), "bottom_average"), {g: min(x) for g, x in values.items()})
    assert _by(st.bottom_average(df, ["g"], "v", 5), "bottom_average")["one"] is None


def test_gini_both_ways(sample):
    df, values = sample

    def pairs(x):
        n, mu = len(x), sum(x) / len(x)
        return sum(abs(a - b) for a in x for b in x) / (n * (n - 1) * mu) / 2 if n > 1 else 0.0

    _near(_by(st.gini(df, ["g"], "v", pairs=True), "gini"), {g: pairs(x) for g, x in values.items()})
    _near(_by(st.gini(df, ["g"], "v"), "gini"), {g: sum((2 * i - len(x) - 1) * v for i, v in enumerate(sorted(x), 1)) / (len(x) * sum(x)) for g, x in values.items()})


def test_soft_percentile_and_counts(sample):
    df, values = sample

    def percentile(x, p):
        place = int((1 - p) * len(x))
        top = sorted(x, reverse=True)
        if place + 1 > len(x):
            return None
        return (top[place] + top[place - 1]) / 2 if p * len(x) == place else top[place]

    _near(_by(st.soft_percentile(df, ["g"], "v", 0.75), "percentile"), {g: percentile(x, 0.75) for g, x in values.items()})
    _near(_by(st.soft_percentile(df, ["g"], "v", 0.5), "percentile"), {g: percentile(x, 0.5) for g, x in values.items()})
    _near(_by(st.count_above(df, ["g"], "v", 2.5), "count_above"), {g: sum(1 / (1 + math.exp(-max(-700, min(700, 100 * (v - 2.5))))) for v in x) for g, x in values.items()})
    soft = _by(st.soft_percentile_count(df, ["g"], "v", 0.4, steps=40), "threshold")
    for g, x in values.items():
        if len(x) > 1:
            assert sum(1 / (1 + math.exp(-10 * (v - soft[g]))) for v in x) / len(x) == pytest.approx(0.4, abs=0.02)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hs.lists(hs.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=40))
def test_ranks_are_those_of_sorting(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "v double")
    got = sorted((r.x, r.n, r.before, r.total) for r in st.ranked(df, [], "v").collect())
    want = sorted((x, sum(y == x for y in xs), sum(y < x for y in xs), len(xs)) for x in set(xs))
    assert got == want


def test_moments_and_entropy(sample):
    df, values = sample
    rows = {r.g: r for r in st.moments(df.where("g <> 'one'"), ["g"], "v").collect() if r.g != "none"}
    for g, r in rows.items():
        x = np.array(values[g])
        z = (x - x.mean()) / x.std(ddof=1)
        assert r.skewness == pytest.approx((z**3).mean()) and r.kurtosis == pytest.approx((z**4).mean() - 3)
    h = _by(st.entropies(df, ["g"], "v"), "entropy")
    for g in "abc":
        p = np.array(values[g]) / (sum(values[g]) + 1e-5)
        assert h[g] == pytest.approx(-(p[p > 0] * np.log(p[p > 0])).sum())


def test_matrix_correlations_are_pearsons(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([(row.tolist(),) for row in x] + [(None,), ([1.0],)], "v array<double>")
    got = np.zeros((5, 5))
    for r in st.matrix_correlations(df, "v", 5).collect():
        got[r.i, r.j] = r.r
    assert np.allclose(got, np.corrcoef(x.T))


def test_row_correlations(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(4, 30)), rng.normal(size=(3, 30))
    a = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>")
    b = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "id int, v array<double>")
    for r in st.row_correlations(a, b, "id", "v").collect():
        assert r.r == pytest.approx(np.corrcoef(x[r.i], y[r.j])[0, 1], abs=1e-5)


def test_sigmoid_does_not_overflow(spark):
    rows = spark.createDataFrame([(-1e4,), (0.0,), (1e4,), (None,)], "x double").select(m.sigmoid("x").alias("y")).collect()
    assert [r.y for r in rows] == [0.0, 0.5, 1.0, None]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "g string, v double")
    for f in (st.median, st.moments, st.entropies, st.gini, st.soft_extremes, st.modes, st.normality):
        assert f(empty, ["g"], "v").count() == 0
