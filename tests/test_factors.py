import pytest
from pyspark.sql import functions as F

from quadrat.functions import expr as X
from quadrat.operators import factors, reshape


def test_mode_first_seen_wins_ties_and_null_may_win(spark):
    rows = [(1, 1, 2), (1, 2, 1), (1, 3, 1), (1, 4, 2), (2, 1, 3), (2, 2, 3), (2, 3, 1), (2, 4, 1)]
    rows += [(3, 1, None), (3, 2, None), (3, 3, 1), (3, 4, 2)]
    df = spark.createDataFrame(rows, "row int, draw int, cat int").repartition(5)
    got = {r["row"]: r["mode"] for r in factors.mode_first(df, ["row"], "cat", "draw").collect()}
    assert got == {1: 2, 2: 3, 3: None}
    known = factors.mode_first(df, ["row"], "cat", "draw", na_rm=True)
    assert {r["row"]: r["mode"] for r in known.collect()} == {1: 2, 2: 3, 3: 1}


def test_codes(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["c", "a", "b", "a", None])], "id int, s string")
    got = [r["y"] for r in factors.factor_code(df, "s", "y").orderBy("id").collect()]
    assert got == [3, 1, 2, 1, None]
    got = factors.factor_code(df, "s", "y", array_levels=2).orderBy("id").collect()
    assert [r["y"] for r in got] == [3, 1, 2, 1, None]
    placed = df.select("id", X.level_code("s", ("b", "a")).alias("p")).orderBy("id").collect()
    assert [r["p"] for r in placed] == [None, 2, 1, 2, None]


@pytest.mark.parametrize("few", [10_000, 10])
def test_codes_of_many_levels(spark, monkeypatch, few):
    monkeypatch.setattr("quadrat.operators.groups.FEW_GROUPS", few)
    hot = F.when(F.col("id") % 3 == 0, F.lit("k5")).when(F.col("id") % 100 != 1, F.concat(F.lit("k"), F.col("id") % 2000))
    df = spark.range(20_000).select("id", hot.alias("s"))
    levels = sorted({r.s for r in df.where("s is not null").collect()})
    got = factors.factor_code(df, "s", "y").collect()
    assert len(got) == 20_000 and all(r.y == (None if r.s is None else levels.index(r.s) + 1) for r in got[::97])


def test_a_million_levels(spark):
    codes = factors.dense_codes(spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003).alias("v")), "v")
    got = codes.agg(F.count("*").alias("n"), F.max("code").alias("top"), F.countDistinct("code").alias("d")).first()
    assert (got.n, got.top, got.d) == (1_000_000, 1_000_000, 1_000_000)
    steps = codes.orderBy("code").limit(1000).collect()
    assert [r.level for r in steps] == sorted(r.level for r in steps)


def test_dense_codes_rank_all_levels(spark):
    df = spark.range(3000).select(F.concat(F.lit("k"), F.col("id") % 997).alias("s")).repartition(6)
    got = factors.dense_codes(df, "s").orderBy("code").collect()
    assert [r["level"] for r in got] == sorted(f"k{i}" for i in range(997))
    assert [r["code"] for r in got] == list(range(1, 998))


def test_tabulate_first_seen_match_and_which_max(spark):
    df = spark.createDataFrame([(0, 4), (1, 2), (2, None), (3, 4), (4, 2), (5, None)], "at int, code int")
    assert [r["n"] for r in factors.tabulate(df, "code", 4).orderBy("code").collect()] == [0, 2, 0, 2]
    seen = factors.first_seen(df, "code", "at")
    assert {r["code"]: r["first_at"] for r in seen.collect()} == {4: 0, 2: 1, None: 2}
    found = factors.match_position(df, "code", seen, "code", "first_at").orderBy("at").collect()
    assert [r["first_at"] for r in found] == [0, 1, 2, 0, 1, 2]
    assert factors.which_max(df, "code", "at").first()["position"] == 0


def test_reshape(spark):
    df = spark.createDataFrame([(1, 10.0, None), (2, 20.0, 5.0)], "id int, a double, b double")
    long = reshape.to_long(df, ["id"], ["a", "b"], "name", "v").orderBy("id", "name").collect()
    assert [(r["id"], r["name"], r["v"]) for r in long] == [(1, "a", 10.0), (1, "b", None), (2, "a", 20.0), (2, "b", 5.0)]
    both = reshape.stack_tagged({"x": df.select("id"), "y": df.select("id")}, "from")
    assert sorted(map(tuple, both.collect())) == [(1, "x"), (1, "y"), (2, "x"), (2, "y")]
