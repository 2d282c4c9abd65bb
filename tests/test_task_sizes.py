"""What one task holds does not grow with the input: ranks are placed by tasks of stated size, chains go to Python in slices,
rows of a fit are packed, classes are chosen in pieces."""

import numpy as np
from pyspark.sql import functions as F

from quadrat.operators import draws as dr
from quadrat.operators import models, predictive, ranks


def test_ranks_are_placed_in_bounded_tasks(spark, monkeypatch):
    df = spark.range(6000).select((F.col("id") % 300).alias("g"), F.abs(F.hash("id") % 50).cast("double").alias("v"))
    whole = sorted(map(tuple, ranks.average_ranks(df, "v", ["g"]).collect()))
    monkeypatch.setattr(ranks, "PLACED", 200, raising=False)
    got = ranks.average_ranks(df, "v", ["g"])
    assert sorted(map(tuple, got.collect())) == whole
    tasks = -(-len(whole) // 200)
    assert "hashpartitioning(g#" in got._jdf.queryExecution().executedPlan().toString()
    assert f", {tasks}), REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()


def test_chains_go_to_python_in_slices(spark, monkeypatch):
    sizes = []

    class Batch:
        num_rows = 1000

        def slice(self, at, n):
            sizes.append(min(n, self.num_rows - at))
            return self

        def to_pandas(self):
            return None

    def none(batches):
        return iter(())

    assert list(dr._in_slices(none, "a", lambda pa: (pa.int64(),))(iter([Batch()]))) == []
    assert sizes == [256, 256, 256, 232]


def test_multinomial_steps_read_packed_rows(spark, monkeypatch):
    frames = []
    kind = type(spark.range(1))
    persist = kind.persist

    def kept(self, *args):
        frames.append(self)
        return persist(self, *args)

    monkeypatch.setattr(kind, "persist", kept)
    rows = spark.range(0, 2000, 1, 3).selectExpr("sin(id) x", "cos(3 * id) `a:b`", "cast(id * id % 7 % 3 + 1 as int) code")
    fit = models.multinomial_map(rows, "code", 3, ["x", "a:b"], 2.0, 2.0)
    # a step took up every row as a row of its own
    assert frames[0].count() < 2000 / 50
    for size, fold in ((1, 10_000), (100, 7)):
        monkeypatch.setattr(models, "PACKED_BYTES", size)
        monkeypatch.setattr(models, "FOLD_ROWS", fold)
        again = models.multinomial_map(rows, "code", 3, ["x", "a:b"], 2.0, 2.0)
        assert np.allclose(again.estimate, fit.estimate, atol=1e-9) and np.allclose(again.covariance, fit.covariance, atol=1e-9)


def test_classes_are_chosen_in_pieces(spark, monkeypatch):
    sizes = []
    array_uniform = predictive.rnd.array_uniform

    def watched(*args):
        of = array_uniform(*args)

        def run(np, *keys):
            out = of(np, *keys)
            sizes.append(out.size)
            return out

        return run

    monkeypatch.setattr(predictive.rnd, "array_uniform", watched)
    packed = spark.createDataFrame([(d, [d / 9, -0.3, 0.2 * d, 1.0]) for d in range(1, 31)], "draw_id long, w array<double>")
    x = np.column_stack([np.ones(5000), np.sin(np.arange(5000))])
    x[17, 1] = np.nan

    def classes():
        _, blocks = predictive._category_blocks(packed, 3, ["intercept", "x"], 30, 5)
        return np.concatenate([c for _, _, c in blocks(np, np.arange(5000) * 11, x)], axis=1)

    got = classes()
    # one array of 150,000 cells was drawn
    assert got.shape == (5000, 30) and max(sizes) <= 32_000
    assert not got[17].any() and set(np.delete(got, 17, 0).ravel()) == {1, 2, 3}
    monkeypatch.setattr(predictive, "PIECE_CELLS", 10**9)
    assert (classes() == got).all()
