import math

import numpy as np
import pandas as pd
import pytest

from quadrat.operators import effects, design as de
from quadrat.operators import models


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    n = 400
    x = rng.normal(1e6, 2.0, n)  # a large offset must not cost digits
    w = 0.6 * (x - 1e6) + rng.normal(0, 1, n)
    sex = rng.choice(["F", "M"], n)
    y = 3 + 0.5 * (x - 1e6) - 1.5 * w + 2 * (sex == "M") + rng.normal(0, 0.7, n)
    return x, w, sex, y


@pytest.fixture(scope="module")
def table(spark, data):
    x, w, sex, y = data
    rows = [(float(a), float(b), str(c), float(d)) for a, b, c, d in zip(x, w, sex, y, strict=True)]
    return spark.createDataFrame(rows, "x double, w double, sex string, y double").repartition(7)


def terms_of():
    return [de.num("x"), de.num("w"), de.dummies("sex", ("F", "M"))]


def matrix(data):
    x, w, sex, _ = data
    return np.column_stack([np.ones(len(x)), x - 1e6, w, sex == "M"])


def test_least_squares(spark, data, table):
    names = de.column_names(terms_of())
    got = {r["term"]: r for r in models.least_squares(de.design(table, terms_of(), "y"), names).collect()}
    a, y = matrix(data), data[3]
    beta = np.linalg.lstsq(a, y, rcond=None)[0]
    s2 = ((y - a @ beta) ** 2).sum() / (len(y) - 4)
    se = np.sqrt(s2 * np.diag(np.linalg.inv(a.T @ a)))
    assert [got[n]["estimate"] for n in names] == pytest.approx(beta[1:], rel=1e-8)
    assert [got[n]["std_error"] for n in names] == pytest.approx(se[1:], rel=1e-8)
    assert got["intercept"]["estimate"] == pytest.approx(beta[0] - 1e6 * beta[1], rel=1e-8)


def test_penalised_fit_solves_its_equations_and_nears_least_squares(spark, data, table):
    names = de.column_names(terms_of())
    d = de.design(table, terms_of(), "y")
    sds = {"strong": 0.1, "wide": 1e6, "flat": math.inf}
    got = {(r["prior"], r["term"]): r["estimate"] for r in models.gaussian_map(d, names, sds).collect()}
    a, y = matrix(data)[:, 1:], data[3]
    ac, yc = a - a.mean(axis=0), y - y.mean()
    flat = np.linalg.solve(ac.T @ ac, ac.T @ yc)
    s2 = ((yc - ac @ flat) ** 2).sum() / (len(y) - 4)
    strong = np.linalg.solve(ac.T @ ac + np.eye(3) * s2 / 0.01, ac.T @ yc)
    assert [got["strong", n] for n in names] == pytest.approx(strong, rel=1e-8)
    assert [got["flat", n] for n in names] == pytest.approx(flat, rel=1e-8)
    assert [got["wide", n] for n in names] == pytest.approx(flat, rel=1e-6)
    side = models.prior_sensitivity(d, names, sds).collect()
    assert {r["term"] for r in side} == {"intercept", *names}
    assert all(r["strong"] == got["strong", r["term"]] for r in side)


def test_vif(spark, data, table):
    names = de.column_names(terms_of())
    got = {r["term"]: r["vif"] for r in models.vif(de.design(table, terms_of(), "y"), names).collect()}
    a = matrix(data)[:, 1:]
    want = np.diag(np.linalg.inv(np.corrcoef(a.T)))
    assert [got[n] for n in names] == pytest.approx(want, rel=1e-8)
    assert min(got.values()) >= 1


def test_determined_terms_give_nulls(spark):
    df = spark.createDataFrame([(float(i), float(i % 3)) for i in range(12)], "x double, y double")
    terms = [de.num("x"), [("twice", df["x"] * 2)], [("one", df["x"] * 0 + 1)]]
    d = de.design(df, terms, "y")
    names = de.column_names(terms)
    got = {r["term"]: r["estimate"] for r in models.least_squares(d, names).collect()}
    assert got["twice"] is None and got["one"] is None and got["x"] is not None
    assert {r["term"]: r["vif"] for r in models.vif(d, names).collect()} == {"x": 1.0, "twice": None, "one": None}


def test_correlations_are_pairwise_complete(spark):
    rows = [(1.0, 2.0, None), (2.0, None, 3.0), (3.0, 7.0, 1.0), (5.0, 1.0, 4.0), (8.0, 3.0, 4.5)]
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(3)
    got = {(r["a"], r["b"]): (r["r"], r["n"]) for r in models.correlation_matrix(df, ["a", "b", "c"]).collect()}
    m = np.array([[np.nan if v is None else v for v in r] for r in rows])
    for (i, a), (j, b) in (((0, "a"), (1, "b")), ((0, "a"), (2, "c")), ((1, "b"), (2, "c"))):
        ok = ~np.isnan(m[:, i]) & ~np.isnan(m[:, j])
        assert got[a, b][0] == pytest.approx(np.corrcoef(m[ok, i], m[ok, j])[0, 1])
        assert got[a, b][1] == ok.sum()
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "a double, b double")
    assert models.correlation_matrix(flat, ["a", "b"]).first()["r"] is None


def test_design_drops_incomplete_rows_and_repeats(spark):
    df = spark.createDataFrame(
        [(1.0, "F", 1.0), (2.0, "O", 2.0), (None, "P", 3.0), (4.0, "X", 4.0), (5.0, "P", None)],
        "x double, f string, y double",
    )
    terms = [de.interaction(de.num("x"), de.dummies("f", ("F", "O", "P"))), de.squared("x"), de.num("x")]
    d = de.design(df, terms, "y")
    assert d.columns == ["y", "x", "f_O", "f_P", "x:f_O", "x:f_P", "x_sq"]
    assert sorted(map(tuple, d.collect())) == [(1.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0), (2.0, 2.0, 1.0, 0.0, 2.0, 0.0, 4.0)]
    assert de.level_list(df, "f") == ["F", "O", "P", "X"]


def test_random_intercept_shrinks_towards_the_grand_mean(spark):
    rng = np.random.default_rng(2)
    groups = {g: rng.normal(m, 1, size) for g, m, size in (("a", 0, 300), ("b", 3, 20), ("c", -2, 5), ("d", 1, 1))}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, y double")
    got = {r["g"]: r for r in effects.random_intercept(df.repartition(5), "g", "y").collect()}
    n = np.array([len(v) for v in groups.values()])
    mean = np.array([v.mean() for v in groups.values()])
    grand = (n * mean).sum() / n.sum()
    s2 = sum(((v - v.mean()) ** 2).sum() for v in groups.values()) / (n.sum() - 4)
    msb = (n * (mean - grand) ** 2).sum() / 3
    tau2 = max((msb - s2) * 3 / (n.sum() - (n**2).sum() / n.sum()), 0)
    want = n * tau2 / (n * tau2 + s2) * (mean - grand)
    assert [got[g]["effect"] for g in groups] == pytest.approx(want)
    assert all(0 <= got[g]["shrink"] < 1 for g in groups)


def test_equal_groups_are_pulled_together(spark):
    df = spark.createDataFrame([(g, v) for g in "ab" for v in (1.0, 2.0, 3.0)], "g string, y double")
    assert all(r["effect"] == 0 for r in effects.random_intercept(df, "g", "y").collect())


def test_random_slope(spark):
    rng = np.random.default_rng(4)
    rows = []
    for g, b in enumerate((0.0, 1.0, 2.0, 3.0)):
        x = rng.normal(size=50)
        rows += [(g, float(a), float(b * a + rng.normal(0, 0.3))) for a in x]
    rows.append((9, 1.0, 5.0))
    df = spark.createDataFrame(rows, "g int, x double, y double")
    got = {r["g"]: r for r in models.random_slope(df, "g", "x", "y").collect()}
    assert [got[g]["pulled"] for g in range(4)] == pytest.approx([0, 1, 2, 3], abs=0.25)
    assert got[9]["slope"] is None and got[9]["shrink"] == 0


def loglik_gradient(x, y, beta, k, prec):
    eta = np.column_stack([np.zeros(len(x)), x @ beta.T])
    p = np.exp(eta - eta.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    hit = np.eye(k)[y - 1]
    return (hit - p)[:, 1:].T @ x - beta * prec


def test_multinomial_is_at_the_penalised_optimum(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(500, 2))
    eta = np.column_stack([np.zeros(500), x @ [1, -1] + 0.3, x @ [0.5, 2] - 1])
    p = np.exp(eta) / np.exp(eta).sum(axis=1, keepdims=True)
    y = np.array([rng.choice(3, p=r) for r in p]) + 1
    rows = [(int(c), float(a), float(b)) for c, (a, b) in zip(y, x, strict=True)]
    df = spark.createDataFrame(rows, "y int, a double, b double").repartition(6)
    fit = models.multinomial_map(df, "y", 3, ["a", "b"], slope_sd=1.0, intercept_sd=2.0)
    got = {(r["class"], r["term"]): r for r in fit.table(spark).collect()}
    beta = np.array([[got[c, t]["estimate"] for t in ("intercept", "a", "b")] for c in (2, 3)])
    # the intercept prior holds at the predictor means
    centred = np.column_stack([np.ones(500), x - x.mean(axis=0)])
    beta[:, 0] += beta[:, 1:] @ x.mean(axis=0)
    gradient = loglik_gradient(centred, y, beta, 3, np.array([0.25, 1.0, 1.0]))
    assert np.abs(gradient).max() < 1e-4
    again = models.multinomial_map(df.coalesce(1), "y", 3, ["a", "b"], 1.0, 2.0)
    assert again.estimate == pytest.approx(fit.estimate, abs=1e-8)
    drawn = fit.draws(spark, 4000).toPandas().pivot(index="draw_id", columns=["class", "term"], values="value")
    keys = fit.keys()
    assert drawn[keys].mean().to_numpy() == pytest.approx(fit.estimate, abs=0.02)
    assert np.cov(drawn[keys].to_numpy().T) == pytest.approx(np.array(fit.covariance), abs=0.004)
    assert [got[k]["std_error"] for k in keys] == pytest.approx(np.sqrt(np.diag(fit.covariance)))


def test_multinomial_finite_prior_survives_a_missing_class(spark):
    df = spark.createDataFrame([(1, 0.0), (1, 1.0), (2, 2.0), (2, 0.5)], "y int, x double")
    fit = models.multinomial_map(df, "y", 3, ["x"], slope_sd=1.0, intercept_sd=1.0)
    assert all(math.isfinite(v) for v in fit.estimate)


def test_residuals_sum_to_zero(spark, table):
    names = de.column_names(terms_of())
    d = de.design(table, terms_of(), "y")
    fit = models.least_squares(d, names)
    got = models.residuals(d, names, fit).agg({"residual": "sum"}).first()[0]
    assert abs(got) < 1e-6


@pytest.mark.parametrize("slope", [10, 0])
def test_gaussian_mode_without_spread(spark, slope):
    """Where the terms determine the response, what is left of its squares is rounding of either sign: there is no mode."""
    df = spark.range(200).selectExpr("id / 1000 x", f"(90000 + id * {slope}) / 100 / 1000 y")
    got = models.gaussian_mode(df, ["x"], (0.3, 0.4), 0.5, 2.0).collect()
    assert [tuple(r) for r in got] == [(t, None, None, None) for t in ("intercept", "x", "sigma")]



@pytest.mark.parametrize(("shift", "rate"), [(0.0, 1.0), (-3.0, 50.0)])
def test_gaussian_mode(spark, shift, rate):
    """The mode is a stationary point of the density written out, and no point around it is better."""
    rng = np.random.default_rng(8)
    n = 300
    x = rng.normal(size=(n, 2)) + 5
    y = 4 + shift + x @ [0.7, -0.3] - 5 * 0.4 + rng.normal(0, 0.8, n)
    pdf = pd.DataFrame({"x1": x[:, 0], "x2": x[:, 1], "x3": x[:, 0] * 2, "y": y})
    df = spark.createDataFrame(pdf).repartition(3)
    got = {r.term: r for r in models.gaussian_mode(df, ["x1", "x2", "x3"], (1.5, 0.4), 0.5, rate).collect()}
    assert got["x3"].estimate is None and list(got) == ["intercept", "x1", "x2", "x3", "sigma"]
    centred = x - x.mean(axis=0)

    def density(a, b1, b2, s):
        rest = y - a - centred @ [b1, b2]
        value = -n * np.log(s) - (rest @ rest) / (2 * s * s) - np.log(a) - (np.log(a) - 1.5) ** 2 / (2 * 0.4**2)
        return value - (b1 * b1 + b2 * b2) / (2 * 0.5**2) - rate * s

    mode = np.array([got[t].estimate for t in ("intercept", "x1", "x2", "sigma")])
    assert (mode[[0, 3]] > 0).all() and all(abs(got[t].gradient) < 1e-6 for t in ("intercept", "x1", "x2", "sigma"))
    best = density(*mode)
    for k in range(4):
        for step in (-1e-3, 1e-3):
            near = mode.copy()
            near[k] += step
            assert density(*near) < best
    errors = [got[t].std_error for t in ("intercept", "x1", "x2", "sigma")]
    for k, e in enumerate(errors):  # curvature along an axis is that of the density, up to the other parameters
        up, down = mode.copy(), mode.copy()
        up[k] += 0.01 * e
        down[k] -= 0.01 * e
        assert -(density(*up) + density(*down) - 2 * best) / (0.01 * e) ** 2 * e * e > 0.98
