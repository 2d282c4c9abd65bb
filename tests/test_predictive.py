import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.functions import random as rnd
from quadrat.operators import draws as dr
from quadrat.operators import predictive as pp
from quadrat.operators import priors

TERMS = ("intercept", "x")


@pytest.fixture(scope="module")
def rows(spark):
    labels = F.when(F.col("id") % 4 == 0, "b").when(F.col("id") % 4 == 1, "zz").otherwise("a")
    return spark.range(300).select("id", (F.col("id") / 100.0 - 1.5).alias("x"), labels.alias("s"))


def coefficients(spark, n_draws):
    """Three classes; the third never wins."""
    cells = spark.range(1, n_draws + 1).select(
        F.col("id").alias("draw_id"), F.explode(F.array(*[F.lit(c) for c in (2, 3)])).alias("class")
    )
    cells = cells.withColumn("term", F.explode(F.array(*[F.lit(t) for t in TERMS])))
    noise = rnd.std_normal("draw_id", "class", F.length("term"), stream="test")
    level = F.when((F.col("class") == 3) & (F.col("term") == "intercept"), -60.0).otherwise(noise)
    return cells.withColumn("value", level)


def numpy_cells(rows, draws, u):
    pdf = rows.toPandas()
    w = {(r.draw_id, r["class"], r.term): r.value for _, r in draws.toPandas().iterrows()}
    out = {}
    for d in sorted({k[0] for k in w}):
        for i, x in zip(pdf["id"], pdf["x"], strict=True):
            e = np.exp([0.0] + [w[d, c, "intercept"] + w[d, c, "x"] * x for c in (2, 3)])
            out[d, i] = 1 + int((u[d, i] * e.sum() >= np.cumsum(e)[:-1]).sum())
    return out


PATHS = {
    "expressions": {},
    "salted join": {"MAX_ARRAY_VALUES": 4},
    "matrix product": {"MAX_SPELLED_OUT": 0, "BLOCK_CELLS": 100},
}


@pytest.mark.parametrize("path", PATHS)
def test_categories_match_a_direct_computation(spark, rows, monkeypatch, path):
    for name, value in PATHS[path].items():
        monkeypatch.setattr(pp, name, value)
    draws = coefficients(spark, 6)
    cells = pp.predict_category(rows.drop("s"), "id", draws, 3, TERMS, 6).collect()
    grid = rows.select("id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("draw_id"))
    u = grid.select("draw_id", "id", rnd.uniform("draw_id", "id", stream="class").alias("u")).collect()
    want = numpy_cells(rows, draws, {(r["draw_id"], r["id"]): r["u"] for r in u})
    assert len(cells) == 1800
    assert {(r["draw_id"], r["id"]): r["category"] for r in cells} == want


@pytest.mark.parametrize("path", PATHS)
def test_missing_covariates_give_null_classes(spark, rows, monkeypatch, path):
    full = pp.predict_category(rows.drop("s"), "id", coefficients(spark, 5), 3, TERMS, 5).collect()
    for name, value in PATHS[path].items():
        monkeypatch.setattr(pp, name, value)
    gaps = F.when(F.col("id") % 3 == 0, F.lit(None)).when(F.col("id") % 3 == 1, F.lit(float("nan"))).otherwise(F.col("x"))
    cells = pp.predict_category(rows.drop("s").withColumn("x", gaps), "id", coefficients(spark, 5), 3, TERMS, 5)
    want = {(r["draw_id"], r["id"]): r["category"] if r["id"] % 3 == 2 else None for r in full}
    assert {(r["draw_id"], r["id"]): r["category"] for r in cells.collect()} == want
    modes = {r["id"]: r["prediction"] for r in pp.row_mode(cells, "id", 3).collect()}
    assert all((modes[i] is None) == (i % 3 != 2) for i in range(300))


@pytest.mark.parametrize("values", [{}, {"MAX_ARRAY_VALUES": 4}], ids=["fold", "cells"])
def test_check_table_leaves_missing_covariates_out(spark, rows, values, monkeypatch):
    for name, value in values.items():
        monkeypatch.setattr(pp, name, value)
    gaps = rows.withColumn("x", F.when(F.col("id") % 3 > 0, F.col("x")))
    args = ("id", "s", {"a": "A", "b": "B", "never": "N"}, coefficients(spark, 5), TERMS, 5)
    got, want = (sorted(map(tuple, pp.category_check(r, *args).collect()), key=str) for r in (gaps, rows.where("id % 3 > 0")))
    assert got == want


def test_stated_number_of_draws_is_enforced(spark, rows):
    with pytest.raises(Exception, match="more than the stated 3 draws"):
        pp.predict_category(rows.drop("s"), "id", coefficients(spark, 6), 3, TERMS, 3).collect()


def test_counts_envelope_and_modes(spark, rows):
    cells = pp.predict_category(rows.drop("s"), "id", coefficients(spark, 8), 3, TERMS, 8)
    pdf = cells.toPandas()
    per = pp.counts_per_draw(cells, 3).toPandas()
    assert (per[["c1", "c2", "c3"]].sum(axis=1) == 300).all() and (per["c3"] == 0).all()
    env = {r["category"]: (r["lower"], r["upper"]) for r in pp.envelope(pp.counts_per_draw(cells, 3), 3).collect()}
    for c in (1, 2):
        n = (pdf["category"] == c).groupby(pdf["draw_id"]).sum()
        assert env[c] == (n.min(), n.max())
    assert env[3] == (0, 0)
    modes = {r["id"]: r["prediction"] for r in pp.row_mode(cells, "id", 3).collect()}
    for i, part in pdf.sort_values("draw_id").groupby("id"):
        n = part["category"].value_counts()
        best = n[n == n.max()].index
        assert modes[i] == next(c for c in part["category"] if c in best)


def test_extreme_predictors_stay_finite(spark, rows):
    draws = coefficients(spark, 2).withColumn("value", F.col("value") * 1e4)
    cells = pp.predict_category(rows.drop("s"), "id", draws, 3, TERMS, 2)
    assert cells.where(F.col("category").isNull()).count() == 0 and cells.count() == 600


@pytest.mark.parametrize("prediction", ["mode", "first"])
@pytest.mark.parametrize("values", [{}, {"BLOCK_CELLS": 64}, {"MAX_ARRAY_VALUES": 4}], ids=["fold", "blocks", "cells"])
def test_check_table(spark, rows, prediction, values, monkeypatch):
    for name, value in values.items():
        monkeypatch.setattr(pp, name, value)
    cells = pp.predict_category(rows.drop("s"), "id", coefficients(spark, 5), 3, TERMS, 5)
    if prediction == "mode":
        chosen = pp.row_mode(cells, "id", 3)
    else:
        chosen = pp.single_draw(rows, "id", coefficients(spark, 5), 3, TERMS)
    want = dict(chosen.groupBy("prediction").count().collect())
    bounds = {r["category"]: r for r in pp.envelope(pp.counts_per_draw(cells, 3), 3).collect()}
    classes = {"a": "A", "b": "B", "never": "N"}
    args = (rows, "id", "s", classes, coefficients(spark, 5), TERMS, 5)
    got = {(r["source"], r["label"]): r for r in pp.category_check(*args, prediction=prediction).collect()}
    # "zz" is outside the classes and is not counted as observed
    assert [got["observed", v]["count"] for v in "ABN"] == [150, 75, 0]
    for i, v in enumerate("ABN", 1):
        row = got["posterior", v]
        assert row["count"] == want.get(i, 0)
        assert (row["lower"], row["upper"]) == (bounds[i]["lower"], bounds[i]["upper"])
    assert sum(want.values()) == 300
    assert got["posterior", "N"]["count"] == 0 and got["posterior", "N"]["upper"] == 0
    assert got["observed", "A"]["lower"] is None
    again = pp.category_check(rows.repartition(1), *args[1:], prediction=prediction).collect()
    assert sorted(map(str, again)) == sorted(map(str, got.values()))


def test_gaussian_replicates(spark, rows):
    entries = [(1, "mu", "intercept", 2.0), (1, "mu", "x", 3.0), (1, "sigma", "intercept", 0.5)]
    draws = spark.createDataFrame(entries, "draw_id long, class string, term string, value double")
    got = pp.predict_gaussian(rows.drop("s"), "id", draws, TERMS, 1).join(rows, "id").toPandas()
    rest = (got["y_rep"] - 2 - 3 * got["x"]) / 0.5
    assert abs(rest.mean()) < 0.2 and abs(rest.std() - 1) < 0.15


def test_overlay_has_one_curve_per_chosen_draw(spark, rows):
    ids = spark.range(1, 11).withColumnRenamed("id", "draw_id")
    entry = F.array(
        *[
            F.struct(F.lit(c).alias("class"), F.lit(t).alias("term"), F.lit(v).alias("value"))
            for c, t, v in (("mu", "intercept", 0.0), ("mu", "x", 1.0), ("sigma", "intercept", 0.1))
        ]
    )
    draws = ids.select("draw_id", F.inline(entry))
    got = pp.density_overlay(rows, "id", "x", draws, TERMS, 10, show=4, points=128).toPandas()
    curves = got.fillna({"draw_id": 0}).groupby("draw_id")
    assert len(curves) == 5
    for _, c in curves:
        c = c.sort_values("x")
        assert np.trapezoid(c["density"], c["x"]) == pytest.approx(1, abs=0.02)


def chain_draws(spark, series):
    """series: {(variable, chain): values}; kept iterations 11, 13, 15, ..."""
    rows = [(c, 11 + 2 * i, v, float(x)) for (v, c), xs in series.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "chain int, iteration int, variable string, value double").repartition(5)


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(7)
    out = {}
    for c in (1, 2, 3):
        e = rng.normal(size=301)
        slow = np.zeros(301)
        for i in range(1, 301):
            slow[i] = 0.8 * slow[i - 1] + e[i]
        out["slow", c] = slow
        out["white", c] = rng.normal(size=301)
        out["apart", c] = rng.normal(3 * c, 1, size=301)
        out["flat", c] = np.ones(301)
    return out


def test_warmup_and_thinning(spark):
    df = spark.range(1, 21).select(F.col("id").alias("iteration"))
    assert [r[0] for r in dr.keep_draws(df, 10, 2).orderBy("iteration").collect()] == [11, 13, 15, 17, 19]


def test_rhat(spark, series):
    got = {r["variable"]: r["rhat"] for r in dr.rhat(chain_draws(spark, series)).collect()}
    assert got["flat"] is None and got["apart"] > 2 and abs(got["white"] - 1) < 0.02
    halves = [h for c in (1, 2, 3) for h in (series["slow", c][:150], series["slow", c][151:])]
    w = np.mean([h.var(ddof=1) for h in halves])
    b = np.var([h.mean() for h in halves], ddof=1)
    assert got["slow"] == pytest.approx(np.sqrt((149 / 150 * w + b) / w))


@pytest.mark.parametrize("block", [65536, 32])
def test_autocorrelation(spark, series, block):
    got = dr.autocorrelation(chain_draws(spark, series), 12, block).collect()
    assert len(got) == 12 * 13
    for r in got:
        x = series[r["variable"], r["chain"]]
        d = x - x.mean()
        if r["variable"] == "flat":
            assert r["rho"] is None
        else:
            want = (d[: len(d) - r["lag"]] * d[r["lag"] :]).sum() / (d * d).sum()
            assert r["rho"] == pytest.approx(want, abs=1e-12)


def test_effective_size(spark, series):
    got = {r["variable"]: r["ess"] for r in dr.effective_size(chain_draws(spark, series)).collect()}
    assert got["flat"] is None
    # lag-1 autocorrelation 0.8 leaves about a ninth of the draws
    assert 60 < got["slow"] < 160 and got["white"] > 600 and got["apart"] < 30


@pytest.mark.parametrize("block", [4, 64, 128])
def test_effective_size_of_long_chains_agrees(spark, series, block):
    df = chain_draws(spark, series)
    want = {r["variable"]: r["ess"] for r in dr.effective_size(df).collect()}
    got = {r["variable"]: r["ess"] for r in dr.effective_size(df, block).collect()}
    assert got.keys() == want.keys() and got["flat"] is None
    for v in ("slow", "white", "apart"):
        assert got[v] == pytest.approx(want[v], rel=1e-9)


def rank_rhat_by_hand(chains):
    """Bulk and folded R-hat of normal scores of average ranks, over split chains."""
    from statistics import NormalDist

    import pandas as pd

    def split(x):
        half = len(x) // 2
        return [x[:half], x[len(x) - half :]]

    def rhat(parts):
        pooled = pd.Series(np.concatenate(parts))
        ranks = pooled.rank(method="average").to_numpy()
        z = np.array([NormalDist().inv_cdf((r - 0.375) / (len(pooled) + 0.25)) for r in ranks])
        cut = np.split(z, np.cumsum([len(p) for p in parts])[:-1])
        n, w = len(cut[0]), np.mean([c.var(ddof=1) for c in cut])
        return np.sqrt(((n - 1) / n * w + np.var([c.mean() for c in cut], ddof=1)) / w)

    middle = np.median(np.concatenate(chains))
    return rhat([p for c in chains for p in split(c)]), rhat([p for c in chains for p in split(np.round(np.abs(c - middle), 9))])


def test_rank_rhat(spark, series):
    wide = {("wide", c): series["white", c] * c * c for c in (1, 2, 3)}
    steps = {("steps", c): np.floor(series["slow", c]) for c in (1, 2, 3)}  # many ties
    data = {**series, **wide, **steps}
    got = {r.variable: r for r in dr.rank_rhat(chain_draws(spark, data)).collect()}
    assert got["flat"].rhat is None
    for v in ("slow", "white", "apart", "wide", "steps"):
        bulk, folded = rank_rhat_by_hand([data[v, c] for c in (1, 2, 3)])
        assert (got[v].bulk, got[v].folded, got[v].rhat) == pytest.approx((bulk, folded, max(bulk, folded)), rel=1e-9)
    assert got["wide"].bulk < 1.05 < got["wide"].folded


def test_inverse_normal(spark):
    from statistics import NormalDist

    from quadrat.functions.expr import inverse_normal

    p = [1e-300, 1e-20, 1e-5, 0.01, 0.07, 0.08, 0.3, 0.5, 0.5000001, 0.9, 0.925, 0.93, 0.999999, 1 - 1e-15]
    got = spark.createDataFrame([(x,) for x in p], "p double").select(inverse_normal(F.col("p")).alias("z")).collect()
    assert [r.z for r in got] == pytest.approx([NormalDist().inv_cdf(x) for x in p], rel=1e-14, abs=1e-300)


def test_average_ranks_over_many_ranges(spark):
    from quadrat.operators.ranks import average_ranks

    rng = np.random.default_rng(4)
    values = {"a": rng.integers(0, 50, 4000) / 7, "b": rng.normal(size=3000), None: np.array([1.0, 1.0, 2.0])}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("a", None), ("b", float("nan"))]
    got = average_ranks(spark.createDataFrame(rows, "g string, x double").repartition(7), "x", ["g"]).collect()
    import pandas as pd

    for g, vs in values.items():
        want = dict(zip(vs, pd.Series(vs).rank(method="average"), strict=True))
        assert {r.x: r["rank"] for r in got if r.g == g} == want
        assert {r.n for r in got if r.g == g} == {len(vs)}


def test_summary_and_intervals(spark, series):
    df = chain_draws(spark, series)
    allx = np.concatenate([series["slow", c] for c in (1, 2, 3)])
    got = dr.summarise(df).where("variable = 'slow'").first()
    assert [got["mean"], got["sd"], got["lower"], got["upper"]] == pytest.approx(
        [allx.mean(), allx.std(ddof=1), *np.quantile(allx, (0.025, 0.975))]
    )
    got = dr.intervals(df, "^s").collect()
    assert len(got) == 1
    assert [got[0][c] for c in ("ll", "l", "m", "h", "hh")] == pytest.approx(np.quantile(allx, (0.05, 0.25, 0.5, 0.75, 0.95)))


def test_prior_lines_and_band(spark, rows):
    lines = priors.prior_lines(rows, "x", F.col("line") * 1.0, F.lit(2.0), lines=3, points=5).toPandas()
    x = rows.toPandas()["x"]
    first = lines[lines["line"] == 1].sort_values("point")
    assert first["x"].to_numpy() == pytest.approx(np.linspace(x.min(), x.max(), 5))
    assert first["y"].to_numpy() == pytest.approx(1 + 2 * (first["x"] - x.mean()).to_numpy())
    band = priors.share_outside(spark.createDataFrame(lines[["line", "point", "x", "y"]]), 0.0, 4.0).first()
    assert band["below"] == pytest.approx((lines["y"] < 0).mean())
    assert band["above"] == pytest.approx((lines["y"] > 4).mean())


def test_prior_response_shares_group_effects(spark):
    rows = spark.range(40).select("id", (F.col("id") % 4).alias("g"), F.lit(0.0).alias("x"))
    par = priors.prior_parameters(
        spark, 6, {"intercept": F.lit(1.0), "sd_group": F.lit(2.0), "sigma": F.lit(0.5), "b": F.lit(9.0)}
    )
    got = priors.prior_response(rows, "id", "g", {"x": "b"}, par, 6).join(rows, "id").toPandas()
    assert len(got) == 240
    assert (got.groupby(["draw_id", "g"])["mu"].nunique() == 1).all()
    assert got.groupby("draw_id")["mu"].nunique().min() == 4
    assert 0.3 < (got["y_rep"] - got["mu"]).std() < 0.7


def test_a_misspelt_term_fails(spark):
    rows = [(d, c, t, 1.0) for d in (1, 2) for c in (2, 3) for t in ("intercept", "x")]
    df = spark.createDataFrame(rows, "draw_id long, class int, term string, value double")
    assert [list(r.w) for r in pp.pack_draws(df, (2, 3), ("intercept", "x")).collect()] == [[1.0] * 4] * 2
    with pytest.raises(Exception, match="no coefficient of z for 2"):
        pp.pack_draws(df, (2, 3), ("intercept", "z")).collect()
    packed = pp.pack_draws(df, (2, 3), ("intercept", "z"), [(2, "z"), (3, "z")])
    assert [list(r.w) for r in packed.collect()] == [[1.0, 0.0, 1.0, 0.0]] * 2
