"""Crossed intercepts and coefficients that vary by group, against numpy."""

import numpy as np
import pandas as pd
import pytest

from quadrat.operators import effects
from quadrat.sources import tables


def one_way(values, level):
    """Components and pulled deviations of a pandas grouping."""
    g = values.groupby(level)
    n, mean, within = g.size(), g.mean(), g.var(ddof=0) * g.size()
    grand = (n * mean).sum() / n.sum()
    sigma2 = within.sum() / (n.sum() - len(n))
    spread = n.sum() - (n * n).sum() / n.sum()
    tau2 = max(((n * (mean - grand) ** 2).sum() / (len(n) - 1) - sigma2) * (len(n) - 1) / spread, 0)
    return sigma2, tau2, n * tau2 / (n * tau2 + sigma2) * (mean - grand)


def crossed_by_hand(pdf, keys, sweeps):
    found = {}
    for _ in range(sweeps):
        for k in keys:
            left = pdf["y"] - pdf["y"].mean()
            for j in keys:
                if j != k and j in found:
                    left = left - pdf[j].map(found[j][2])
            found[k] = one_way(left, pdf[k])
    return found


@pytest.fixture(scope="module")
def crossed_rows():
    rng = np.random.default_rng(2)
    n = 4000
    pdf = pd.DataFrame({"a": rng.integers(0, 40, n), "b": rng.integers(0, 25, n), "c": rng.integers(0, 6, n)})
    pdf.loc[: n // 3, "a"] = 0  # one level holds a third of all rows
    u = {k: rng.normal(0, s, 40) for k, s in (("a", 2.0), ("b", 1.0), ("c", 0.5))}
    pdf["y"] = 10 + sum(u[k][pdf[k]] for k in "abc") + rng.normal(size=n)
    return pdf, u


@pytest.mark.parametrize("few", [10_000, 10, 1])
def test_crossed_intercepts(spark, monkeypatch, crossed_rows, few):
    monkeypatch.setattr("quadrat.operators.groups.FEW_GROUPS", few)
    pdf, _ = crossed_rows
    df = spark.createDataFrame(pdf).repartition(5)
    fit = effects.crossed_intercepts(df, ["a", "b", "c"], "y", sweeps=2, tolerance=0.0)
    want = crossed_by_hand(pdf, ["a", "b", "c"], 2)
    got = {(r.key, r.level): r.effect for r in fit.effects.collect()}
    assert got == pytest.approx({(k, str(i)): e for k, w in want.items() for i, e in w[2].items()}, abs=1e-9)
    assert fit.tau2 == pytest.approx([want[k][1] for k in "abc"])


def test_crossed_intercepts_find_what_was_put_in(spark, crossed_rows):
    pdf, u = crossed_rows
    fit = effects.crossed_intercepts(spark.createDataFrame(pdf), ["a", "b", "c"], "y")
    assert fit.sweeps < 25 and fit.sigma2 == pytest.approx(1.0, rel=0.1)
    got = {(r.key, int(r.level)): r.effect for r in fit.effects.collect()}
    for k, size in (("a", 40), ("b", 25), ("c", 6)):
        own = np.array([got[k, i] for i in range(size)])
        assert np.corrcoef(own, u[k][:size])[0, 1] > 0.95


def test_crossed_intercepts_read_the_rows_once(spark, tables_dir):
    orders = tables.given(spark, tables_dir, "orders").select("o_custkey", "o_orderpriority", "o_totalprice")
    fit = effects.crossed_intercepts(orders, ["o_custkey", "o_orderpriority"], "o_totalprice", 3)
    plan = fit.effects._jdf.queryExecution().executedPlan().toString()
    assert "orders.parquet" not in plan
    single = effects.random_intercept(orders, "o_custkey", "o_totalprice")._jdf.queryExecution().executedPlan().toString()
    assert "orders.parquet" not in single and single.count("FileScan") == 1


def test_crossed_intercepts_edges(spark):
    df = spark.createDataFrame([(1, "p", 2.0), (1, None, 3.0), (None, "q", 1.0), (2, "q", None)], "a int, b string, y double")
    got = effects.crossed_intercepts(df, ["a", "b"], "y").effects.collect()
    assert {(r.key, r.level, r.n, r.effect) for r in got} == {("a", "1", 1, 0.0), ("b", "p", 1, 0.0)}
    assert effects.crossed_intercepts(df.limit(0), ["a", "b"], "y").effects.count() == 0
    assert effects.random_intercept(df.limit(0), "a", "y").count() == 0


def coefficients_by_hand(pdf, names, intercept):
    """The same estimator with whole design matrices and the covariance of the responses."""
    x_all = np.column_stack([np.ones(len(pdf))] * intercept + [pdf[t] - pdf[t].mean() for t in names])
    k = x_all.shape[1]
    parts = {g: (x_all[i], pdf["y"].to_numpy()[i]) for g, i in pdf.groupby("g").indices.items()}
    own, rss, left = {}, 0.0, 0
    for g, (x, y) in parts.items():
        if len(y) > k and np.linalg.matrix_rank(x) == k:
            own[g] = np.linalg.lstsq(x, y, rcond=None)[0]
            rss, left = rss + ((y - x @ own[g]) ** 2).sum(), left + len(y) - k
    sigma2 = rss / left
    b = np.array(list(own.values()))
    apart = np.cov(b.T, ddof=1).reshape(k, k) - sigma2 * np.mean([np.linalg.inv(parts[g][0].T @ parts[g][0]) for g in own], axis=0)
    values, vectors = np.linalg.eigh(apart)
    cov = vectors @ np.diag(np.maximum(values, 0)) @ vectors.T
    v = {g: x @ cov @ x.T + sigma2 * np.eye(len(y)) for g, (x, y) in parts.items()}
    m = sum(x.T @ np.linalg.solve(v[g], x) for g, (x, y) in parts.items())
    mean = np.linalg.solve(m, sum(x.T @ np.linalg.solve(v[g], y) for g, (x, y) in parts.items()))
    pulled = {g: mean + cov @ x.T @ np.linalg.solve(v[g], y - x @ mean) for g, (x, y) in parts.items()}
    return mean, cov, sigma2, own, pulled


@pytest.mark.parametrize(("names", "intercept"), [(["x1", "x2"], True), (["x1"], True), (["x1", "x2"], False)])
def test_random_coefficients(spark, names, intercept):
    rng = np.random.default_rng(7)
    rows = []
    for g in range(30):
        n = [1, 2, 3, 40, 400][g % 5]
        x1, x2 = 100 + rng.normal(size=n), rng.normal(size=n)
        if g == 8:
            x2[:] = 1.0  # no spread
        b = rng.multivariate_normal([5, 1, -1], [[2, 0.5, 0], [0.5, 1, 0.2], [0, 0.2, 0.3]])
        rows += list(zip([g] * n, x1, x2, b[0] * intercept + b[1] * (x1 - 100) + b[2] * x2 + rng.normal(size=n), strict=True))
    pdf = pd.DataFrame(rows, columns=["g", "x1", "x2", "y"])
    extra = [(None, 1.0, 1.0, 1.0), (3, None, 1.0, 1.0), (3, 1.0, 1.0, None)]
    schema = "g int, x1 double, x2 double, y double"
    df = spark.createDataFrame([(int(r[0]), *map(float, r[1:])) for r in rows] + extra, schema)
    fit = effects.random_coefficients(df, "g", names, "y", intercept)
    mean, cov, sigma2, own, pulled = coefficients_by_hand(pdf, names, intercept)
    assert fit.mean == pytest.approx(mean, rel=1e-6) and fit.sigma2 == pytest.approx(sigma2)
    assert fit.covariance == pytest.approx(cov, rel=1e-6, abs=1e-9)
    labels = ["intercept"] * intercept + names
    got = {r.g: r for r in fit.effects.collect()}
    assert len(got) == 30
    for g, r in got.items():
        assert [r[t] for t in labels] == pytest.approx(pulled[g], rel=1e-6, abs=1e-7)
        mine = [r[f"{t}_own"] for t in labels]
        assert mine == pytest.approx(own[g], rel=1e-6, abs=1e-7) if g in own else mine == [None] * len(labels)


def test_random_coefficients_of_nothing(spark):
    df = spark.createDataFrame([], "g int, x double, y double")
    assert effects.random_coefficients(df, "g", ["x"], "y").effects.count() == 0
    one = spark.createDataFrame([(1, 2.0, 3.0)], "g int, x double, y double")
    got = effects.random_coefficients(one, "g", ["x"], "y").effects.collect()
    assert [(r.g, r.intercept, r.intercept_own) for r in got] == [(1, pytest.approx(3.0), None)]
