import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.functions import random as rnd


def draws(spark, n, expr, parts=4):
    rows = spark.range(n).repartition(parts).select("id", expr.alias("v")).toPandas()
    return rows.sort_values("id")["v"].to_numpy()


def test_uniform_is_uniform_and_uncorrelated(spark):
    n = 200_000
    u = draws(spark, n, rnd.uniform("id"))
    assert 0 < u.min() and u.max() < 1
    counts = np.histogram(u, 64, (0, 1))[0]
    chi2 = ((counts - n / 64) ** 2 / (n / 64)).sum()
    assert chi2 < 110  # 63 degrees of freedom, p about 2e-4
    for lag in (1, 2, 7, 100):
        assert abs(np.corrcoef(u[:-lag], u[lag:])[0, 1]) < 0.01


def test_uniform_tells_large_and_negative_keys_apart(spark):
    big = F.col("id") * F.lit(3_000_000_019)
    u = draws(spark, 50_000, rnd.uniform(big))
    assert len(np.unique(u)) == 50_000
    neg = draws(spark, 1000, rnd.uniform(-F.col("id") - 1))
    assert ((neg > 0) & (neg < 1)).all()


def test_streams_seeds_and_key_order_differ(spark):
    n = 20_000
    base = draws(spark, n, rnd.uniform("id", F.lit(3)))
    for other in (
        rnd.uniform("id", F.lit(3), stream="other"),
        rnd.uniform("id", F.lit(3), seed=5),
        rnd.uniform(F.lit(3), "id"),
        rnd.uniform("id", F.lit(4)),
    ):
        assert abs(np.corrcoef(base, draws(spark, n, other))[0, 1]) < 0.03


def test_same_numbers_for_any_partitioning(spark):
    a = draws(spark, 5000, rnd.std_normal("id"), 1)
    b = draws(spark, 5000, rnd.std_normal("id"), 8)
    assert (a == b).all()


def test_moments(spark):
    n = 200_000
    z = draws(spark, n, rnd.normal(2.0, 3.0, "id"))
    assert abs(z.mean() - 2) < 0.03 and abs(z.std() - 3) < 0.03
    assert abs(((z - 2) ** 4).mean() / 81 - 3) < 0.1
    e = draws(spark, n, rnd.exponential(2.0, "id"))
    assert e.min() > 0 and abs(e.mean() - 0.5) < 0.01
    w = draws(spark, n, rnd.lognormal(1.5, 0.4, "id"))
    assert abs(np.log(w).mean() - 1.5) < 0.01 and abs(np.median(w) - math.exp(1.5)) < 0.05


def test_half_student_t3_quantiles(spark):
    from quadrat.operators.priors import half_student_t3

    t = draws(spark, 200_000, half_student_t3(2.5, "id", seed=1, stream="t"))
    # quartiles of |t| with 3 degrees of freedom: 0.3492, 0.7649, 1.4226
    assert np.quantile(t, (0.25, 0.5, 0.75)) / 2.5 == pytest.approx((0.3492, 0.7649, 1.4226), rel=0.02)


def test_arrays_give_the_same_numbers(spark):
    u = draws(spark, 2000, rnd.uniform("id", F.col("id") * 977 - 5000, seed=3, stream="s"))
    ids = np.arange(2000, dtype=np.int64)
    assert (rnd.array_uniform(3, "s")(np, ids, ids * 977 - 5000) == u).all()


def test_no_period_and_no_shifted_streams():
    of = rnd.array_uniform()
    r = np.arange(200_000, dtype=np.int64)
    base = of(np, np.int64(1), r)
    for period in rnd.MODULI:
        for times in (1, 2, 1000):
            assert abs(np.corrcoef(base, of(np, np.int64(1), r + times * period))[0, 1]) < 0.01
            assert abs(np.corrcoef(of(np, r), of(np, r + times * period))[0, 1]) < 0.01
    # of every two of 3,000 draws: no value comes again anywhere in the other stream
    u = np.sort(of(np, np.arange(3000, dtype=np.int64)[:, None], r[None, :400]).ravel())
    assert (np.diff(u) > 1e-16).all()
    assert (np.diff(u) < 2e-9).mean() < 0.01
    few = of(np, np.arange(1, 40, dtype=np.int64)[:, None], r[None, :20_000])
    between = np.corrcoef(few)[np.triu_indices(39, 1)]
    assert np.abs(between).max() < 0.035


def test_expression_grows_by_the_same_length_with_each_key():
    length = [len(str(rnd.std_normal(*[F.lit(k) for k in range(n)]))) for n in range(1, 7)]
    steps = np.diff(length)
    assert steps.max() - steps.min() <= 8 and steps.max() < 2500


def test_string_keys_equal_their_sql(spark):
    import duckdb

    from quadrat.plans import sqltext

    words = ["", "a", "Ünïcode", "subject 7", "b" * 300]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", rnd.uniform(rnd.text_key("w"), F.lit(3)).alias("u"))
    con = duckdb.connect()
    for r in got.collect():
        want = con.execute(f"SELECT {sqltext.uniform(sqltext.text_key('w'), '3')} FROM (SELECT ? AS w)", [r.w]).fetchone()[0]
        assert r.u == want
    assert len({r.u for r in got.collect()}) == len(words)


def test_once_keeps_filters_above_the_draw(spark):
    drawn = spark.range(1000).select("id", rnd.once(rnd.std_normal("id", F.lit(1))).alias("z"))
    plain = {r.id: r.z for r in spark.range(1000).select("id", rnd.std_normal("id", F.lit(1)).alias("z")).collect()}
    found = drawn.where("z > 0").where("z < 2")
    assert {r.id: r.z for r in found.collect()} == {i: z for i, z in plain.items() if 0 < z < 2}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    filters = [line for line in plan.splitlines() if "Filter" in line]
    assert filters and not any("bitwise" in line or "^" in line for line in filters)


def test_prior_response_takes_string_groups(spark):
    from quadrat.operators import priors

    rows = spark.createDataFrame([(f"r{i}", f"g{i % 3}", float(i)) for i in range(30)], "row string, g string, x double")
    par = priors.prior_parameters(
        spark, 5, {"intercept": F.lit(1.0), "sd_group": F.lit(2.0), "sigma": F.lit(0.0), "b": F.lit(0.0)}
    )
    got = priors.prior_response(rows, "row", "g", {"x": "b"}, par, 5).join(rows, "row")
    levels = got.groupBy("draw_id", "g").agg(F.min("mu").alias("lo"), F.max("mu").alias("hi"), F.max("y_rep").alias("y")).collect()
    assert len(levels) == 15 and all(r.lo == r.hi == r.y for r in levels) and len({r.lo for r in levels}) == 15
