import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadrat.functions import expr as X
from quadrat.operators import describe, prep
from quadrat.sources import tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def column(df, name, order):
    return [r[name] for r in df.orderBy(order).collect()]


def test_zscore_skips_nulls_and_constant_gives_null(spark):
    df = frame(spark, [(1, 2.0, 5.0), (2, 4.0, 5.0), (3, None, 5.0), (4, 9.0, 5.0)], "id int, x double, c double")
    got = prep.zscore(df, {"z": "x", "zc": "c"}).orderBy("id").collect()
    want = (np.array([2, 4, 9]) - 5) / np.std([2, 4, 9], ddof=1)
    assert [got[i]["z"] for i in (0, 1, 3)] == pytest.approx(want)
    assert got[2]["z"] is None and all(r["zc"] is None for r in got)


def test_each_column_is_scaled_on_its_own_population(spark):
    rows = [(1, None, 10.0, 1.0), (2, 1.0, None, 2.0), (3, 2.0, 30.0, 3.0), (4, 4.0, 50.0, 5.0), (5, 9.0, 10.0, 8.0), (6, 3.0, 7.0, 13.0)]
    df = frame(spark, rows, "id int, a double, b double, c double")
    steps = [("scale", "zc", "c"), ("keep", "a"), ("scale", "za", "a"), ("keep", "b"), ("scale", "zb", "b")]
    got = prep.filter_then_scale(df, steps).orderBy("id").collect()
    assert [r["id"] for r in got] == [3, 4, 5, 6]

    def z(values, kept):
        return [(v - np.mean(values)) / np.std(values, ddof=1) for v in kept]

    assert [r["zc"] for r in got] == pytest.approx(z([1, 2, 3, 5, 8, 13], [3, 5, 8, 13]))
    assert [r["za"] for r in got] == pytest.approx(z([1, 2, 4, 9, 3], [2, 4, 9, 3]))
    assert [r["zb"] for r in got] == pytest.approx(z([30, 50, 10, 7], [30, 50, 10, 7]))


def test_filters_reach_the_scan(spark, tables_dir):
    df = prep.keep_present(tables.given(spark, tables_dir, "lineitem"), "l_tax").select("l_tax")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_tax)]" in plan and "ReadSchema: struct<l_tax:double>" in plan


def test_null_rules(spark):
    df = frame(spark, [("a", 1), ("b", 0), ("c", None), ("a", 1), (None, 1)], "s string, f int")
    assert df.where(X.holds_or_null(F.col("f") == 1)).count() == 4
    got = df.agg(X.n_distinct("s").alias("a"), X.n_distinct_where("s", F.col("f") == 1).alias("b")).first()
    assert got["a"] == 4  # a, b, c and null
    assert got["b"] == 2  # a and the missing value


def test_distinct_counts_of_an_empty_table(spark):
    df = frame(spark, [], "s string, f int")
    got = df.agg(X.n_distinct("s").alias("a"), X.n_distinct_where("s", F.col("f") == 1).alias("b")).first()
    assert (got["a"], got["b"]) == (0, 0)


def test_contingency_has_zeros_and_no_nulls(spark):
    df = frame(spark, [("a", 1), ("a", 1), ("b", 2), ("c", None), (None, 1)], "s string, f int")
    got = {(r["s"], r["f"]): r["n"] for r in describe.contingency(df, "s", "f").collect()}
    assert got == {("a", 1): 2, ("a", 2): 0, ("b", 1): 0, ("b", 2): 1, ("c", 1): 0, ("c", 2): 0}
    blocks = {(r["s"], r["f"]): r["n"] for r in describe.contingency(df, "s", "f", at_once=1).collect()}
    assert blocks == got
    sparse = {(r["s"], r["f"]): r["n"] for r in describe.contingency(df, "s", "f", zeros=False).collect()}
    assert sparse == {("a", 1): 2, ("b", 2): 1}


PROBS = (0.0, 0.1, 0.25, 0.5, 0.9, 1.0)


def check_quantiles(spark, values, **kw):
    df = frame(spark, [(float(v) if v is not None else None,) for v in values], "x double")
    got = {r["prob"]: r["value"] for r in describe.quantiles(df, "x", PROBS, **kw).collect()}
    clean = [v for v in values if v is not None and not math.isnan(v)]
    want = np.quantile(np.array(clean, dtype=float), PROBS)
    assert [got[p] for p in PROBS] == pytest.approx(want, rel=1e-12, abs=1e-300)


@pytest.mark.parametrize(
    "values",
    [
        [3.0],
        [5.0] * 50,
        [0.0] * 400 + list(range(800)),  # one value holds a third of the rows
        [1e300, -1e300, 1e-300, 0.0, -0.0, 1.0, 2.0],  # range overflows
        [1.0, 2.0, 3.0, 1e12],  # far outlier
        [None, float("nan"), 1.0, 2.0, 7.0],
        list(np.random.default_rng(1).lognormal(0, 3, 3000)),
        list(-np.random.default_rng(2).pareto(0.5, 3000)),
    ],
    ids=["one", "constant", "hot", "extreme", "outlier", "missing", "lognormal", "heavy"],
)
def test_quantiles_are_exact(spark, values):
    check_quantiles(spark, values)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60))
def test_quantiles_property(spark, values):
    check_quantiles(spark, values)


def test_few_bins_and_many_rounds_agree(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).cast("double").alias("x"))
    ranks = [F.lit(0), F.lit(17), F.lit(2500), F.lit(4999)]
    for bins, most in ((2, 1), (3, 4), (1024, 5000), (16, 30)):
        got = describe.order_statistics(df, "x", ranks, bins=bins, most=most).collect()
        assert {r["rank"]: r["x"] for r in got} == {0: 0.0, 17: 17.0, 2500: 2500.0, 4999: 4999.0}


# 10,000: all groups broadcast; 2: the largest broadcast, the others hashed; 1: all hashed
@pytest.mark.parametrize("few", [10_000, 2, 1])
def test_quantiles_by_group_with_null_group(spark, monkeypatch, few):
    monkeypatch.setattr("quadrat.operators.groups.FEW_GROUPS", few)
    rng = np.random.default_rng(3)
    data = {"a": rng.normal(size=301), None: rng.normal(size=40), "b": np.array([2.0])}
    df = frame(spark, [(k, float(v)) for k, vs in data.items() for v in vs], "g string, x double")
    got = {(r["g"], r["prob"]): r["value"] for r in describe.quantiles(df, "x", (0.3, 0.5), ["g"]).collect()}
    assert got == pytest.approx({(k, p): np.quantile(v, p) for k, v in data.items() for p in (0.3, 0.5)})


def test_large_groups_are_broadcast_and_small_ones_hashed(spark, monkeypatch):
    from quadrat.operators.groups import attach_group_values

    monkeypatch.setattr("quadrat.operators.groups.FEW_GROUPS", 3)
    key = F.when(F.col("id") < 700, F.lit(None)).otherwise(F.col("id"))
    rows = spark.range(1000).select(key.alias("k"), F.col("id").alias("v"))
    values = rows.groupBy("k").agg(F.count("*").alias("n"))
    got = attach_group_values(rows, values, ["k"], few=False, size="n")
    assert got.count() == 1000 and got.where("k is null").count() == 700
    assert got.agg(F.sum("n")).first()[0] == 700 * 700 + 300
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "ShuffledHashJoin" in plan


def test_density_by_group_does_not_depend_on_the_join(spark, monkeypatch):
    df = spark.range(400).select((F.col("id") % 7 % 3).alias("g"), F.sqrt("id").alias("x"))
    want = describe.density(df, "x", ["g"], 32).orderBy("g", "j").collect()
    monkeypatch.setattr("quadrat.operators.groups.FEW_GROUPS", 2)
    got = describe.density(df, "x", ["g"], 32).orderBy("g", "j").collect()
    assert [tuple(r) for r in got] == [pytest.approx(tuple(r)) for r in want]


def window_rows(spark, df, values, by=(), **how):
    """Results of order statistics and the most rows that any of its windows gets in one partition."""
    seen = []
    real = describe.save

    def spying(frame, path):
        out = real(frame, path)
        seen.append(frame)
        return out

    describe.save = spying
    try:
        out = describe.order_statistics(df, "x", values, by, **how)
        rows = out.collect()
    finally:
        describe.save = real
    largest = 0
    for frame in [*seen, out]:
        # what a window orders: rows below it, counted per group of its keys
        plan = frame._jdf.queryExecution().optimizedPlan()
        largest = max(largest, *[_largest_group(spark, w) for w in _windows(plan)], 0)
    return rows, largest


def _windows(plan):
    found = [plan] if plan.nodeName() == "Window" else []
    for i in range(plan.children().size()):
        found += _windows(plan.children().apply(i))
    return found


def _largest_group(spark, window):
    from pyspark.sql import DataFrame

    below = spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, window.children().apply(0))
    keys = [window.partitionSpec().apply(i).name() for i in range(window.partitionSpec().size())]
    counts = DataFrame(below, spark).groupBy(*keys).count()
    return counts.agg(F.max("count")).first()[0] or 0


@pytest.mark.parametrize("kind", ["log-uniform", "outlier", "groups", "dense"])
def test_no_window_orders_more_than_the_stated_rows(spark, kind):
    x = {
        "log-uniform": F.pow(F.lit(10.0), -30 * F.col("id") / 60_000),
        "outlier": F.when(F.col("id") == 5, 1e300).otherwise(1 + F.col("id") * 1e-9),
        "groups": F.sqrt("id"),
        "dense": F.when(F.col("id") < 20_000, 0.1).otherwise(F.col("id") / 60_000),
    }[kind]
    by = ["g"] if kind == "groups" else []
    n = 60_000
    df = spark.range(n).select((F.col("id") % 20_000).alias("g"), x.alias("x"))
    ranks = [F.lit(0), F.floor(F.col("n") / 3), F.floor(F.col("n") / 2), F.col("n") - 1]
    rows, largest = window_rows(spark, df, ranks, by, bins=64, most=200)
    assert 0 < largest <= 2100 if kind == "log-uniform" else 0 < largest <= 200
    pdf = df.toPandas()
    if by:
        want = {(g, r): v for g, vs in pdf.groupby("g")["x"] for r, v in [(0, vs.min()), (1, sorted(vs)[1]), (2, vs.max())]}
        assert {(r.g, r.rank): r.x for r in rows} == want
    else:
        values = np.sort(pdf["x"].to_numpy())
        assert {r["rank"]: r.x for r in rows} == {k: values[k] for k in (0, n // 3, n // 2, n - 1)}


def test_summary_counts_nan_as_null(spark):
    df = frame(spark, [(1.0,), (float("nan"),), (None,), (3.0,)], "x double")
    got = describe.summary6(df, "x").first()
    assert (got["n"], got["n_null"], got["max"], got["mean"], got["median"]) == (2, 2, 3.0, 2.0, 2.0)


def test_profile_counts_all_kinds_of_columns(spark):
    rows = [(1, "x", [1, 2], None), (2, None, [1, 2], 0.0), (2, "x" * 5000, None, -0.0), (None, "é", [2], float("nan"))]
    df = frame(spark, rows, "i int, s string, a array<int>, `d.e` double")
    got = {r.column: (r.n, r.n_null, r.n_distinct, r.min_num, r.max_num, r.min_text, r.max_text) for r in tables.profile(df).collect()}
    assert got["i"] == (4, 1, 3, 1.0, 2.0, None, None)
    assert got["s"] == (4, 1, 4, None, None, "x", "é")
    assert got["a"][:3] == (4, 1, 3) and got["d.e"][:3] == (4, 1, 3)
    empty = tables.profile(df.limit(0)).collect()
    assert [(r.n, r.n_distinct) for r in empty] == [(0, 0)] * 4


def test_summary_of_an_all_null_column(spark):
    df = frame(spark, [(None,), (None,)], "x double")
    got = describe.summary6(df, "x").first()
    assert got["n_null"] == 2 and got["median"] is None and got["min"] is None


def test_equal_bins_are_right_closed(spark):
    df = frame(spark, [(0.0,), (10.0,), (20.0,)], "x double")
    # Sturges gives 3 bins of width 20/3
    got = column(describe.histogram(df, "x", "equal"), "n", "bin")
    assert got == [1, 1, 1]


def pretty_edges(spark, values):
    df = frame(spark, [(float(v),) for v in values], "x double")
    rows = describe.histogram(df, "x").orderBy("bin").collect()
    return [rows[0]["lower"], *[r["upper"] for r in rows]], [r["n"] for r in rows]


def test_pretty_bins(spark):
    # edge values fall in the lower bin, the smallest in the first
    edges, n = pretty_edges(spark, range(0, 101, 10))
    assert edges == pytest.approx([0, 20, 40, 60, 80, 100]) and n == [3, 2, 2, 2, 2]
    edges, n = pretty_edges(spark, [5, 5, 5])
    assert edges == pytest.approx([0, 5]) and n == [3]
    edges, n = pretty_edges(spark, [1.0, 1.1, 1.9, 0.1 + 0.2, 0.3])
    assert edges == pytest.approx([0, 0.5, 1.0, 1.5, 2.0]) and n == [2, 1, 1, 1]
    # empty bins are kept
    edges, n = pretty_edges(spark, [0] * 10 + [100])
    assert edges == pytest.approx([0, 20, 40, 60, 80, 100]) and n == [10, 0, 0, 0, 1]


def test_density_matches_a_direct_sum(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=400), rng.normal(4, 0.5, 200)])
    df = frame(spark, [(float(v),) for v in x], "x double")
    got = describe.density(df, "x").orderBy("j").toPandas()
    iqr = np.subtract(*np.quantile(x, (0.75, 0.25)))
    bw = 0.9 * min(x.std(ddof=1), iqr / 1.34) * len(x) ** -0.2
    at = got["x"].to_numpy()
    direct = np.exp(-0.5 * ((at[:, None] - x) / bw) ** 2).sum(axis=1) / (len(x) * bw * math.sqrt(2 * math.pi))
    assert len(got) == 512 and at[0] == pytest.approx(x.min() - 3 * bw)
    assert got["density"].to_numpy() == pytest.approx(direct, abs=2e-3 * direct.max())
    assert np.trapezoid(got["density"], at) == pytest.approx(1, abs=2e-3)


def test_density_of_equal_values_and_by_group(spark):
    df = frame(spark, [("a", 1.0), ("a", 1.0), (None, 2.0), (None, 3.0), (None, 5.0)], "g string, x double")
    got = describe.density(df, "x", ["g"], points=256).toPandas()
    for _, part in got.groupby("g", dropna=False):
        part = part.sort_values("x")
        assert np.trapezoid(part["density"], part["x"]) == pytest.approx(1, abs=5e-3)


def test_attach_renames_and_saves(spark, tmp_path):
    path = str(tmp_path / "raw")
    spark.createDataFrame([("a", 1.0)], "observationID string, `time.n` double").write.parquet(path)
    df = tables.attach(spark, path, "observationID string, `time.n` double", view="scan_table")
    assert df.columns == ["observation_id", "time_n"]
    assert spark.table("scan_table").count() == 1
    back = tables.save(df, str(tmp_path / "out"))
    assert back.collect() == df.collect()


def test_declared_schemas_parse(spark):
    for ddl in (tables.BIRTH_INTERVAL, tables.BEHAVIOUR_SCAN, *tables.GIVEN.values()):
        assert spark.createDataFrame([], ddl).columns


def test_shared_dir_is_read_from_the_session(spark):
    from quadrat.session import shared_dir, shared_path

    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert shared_path(spark, "x").startswith(shared_dir(spark) + "/x-")
    assert shared_path(spark, "x") != shared_path(spark, "x")
