"""Simulation from priors: lines over a covariate range and whole-model draws."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions import random as rnd
from quadrat.operators.predictive import cross_draws


def normal_draws(df: DataFrame, key: str, mu: float, sd: float, seed: int, stream: str) -> DataFrame:
    """One normal draw per key."""
    return df.select(key, rnd.normal(mu, sd, key, seed=seed, stream=stream).alias("value"))


def lognormal_draws(df: DataFrame, key: str, mu: float, sd: float, seed: int, stream: str) -> DataFrame:
    """One lognormal draw per key."""
    return df.select(key, rnd.lognormal(mu, sd, key, seed=seed, stream=stream).alias("value"))


def prior_lines(
    df: DataFrame,
    x: str,
    intercept: Column,
    slope: Column,
    lines: int = 100,
    points: int = 101,
) -> DataFrame:
    """Lines ``a + b * (x - mean(x))`` on a regular grid over the range of ``x``.

    ``intercept`` and ``slope`` are expressions over ``line``. The table is read
    once, for the range and mean.
    """
    span = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("mid"))
    drawn = span.select("*", F.explode(F.sequence(F.lit(1), F.lit(lines))).alias("line"))
    drawn = drawn.withColumn("a", intercept).withColumn("b", slope)
    grid = drawn.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    at = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("point") / (points - 1)
    grid = grid.withColumn("x", at)
    return grid.select("line", "point", "x", (F.col("a") + F.col("b") * (F.col("x") - F.col("mid"))).alias("y"))


def share_outside(lines: DataFrame, low: float, high: float) -> DataFrame:
    """Share of points below, above and inside a plausible band, and lines that leave it."""
    below, above = F.col("y") < low, F.col("y") > high
    per_line = lines.groupBy("line").agg(
        F.count("*").alias("n"),
        F.count_if(below).alias("n_below"),
        F.count_if(above).alias("n_above"),
    )
    return per_line.agg(
        (F.sum("n_below") / F.sum("n")).alias("below"),
        (F.sum("n_above") / F.sum("n")).alias("above"),
        F.count_if(F.col("n_below") + F.col("n_above") > 0).alias("lines_out"),
    )


def half_student_t3(scale: float, *keys, seed: int, stream: str) -> Column:
    """Absolute Student t with 3 degrees of freedom, from four normals."""
    z = [rnd.std_normal(*keys, seed=seed, stream=f"{stream}.{i}") for i in range(4)]
    chi2 = z[1] * z[1] + z[2] * z[2] + z[3] * z[3]
    return F.abs(F.lit(scale) * z[0] / F.sqrt(chi2 / 3))


def prior_parameters(spark: SparkSession, draws: int, parameters: Mapping[str, Column]) -> DataFrame:
    """One row per draw with each parameter drawn from its prior, an expression over ``draw_id``."""
    ids = spark.range(1, draws + 1).withColumnRenamed("id", "draw_id")
    return ids.select("draw_id", *[c.alias(n) for n, c in parameters.items()])


def prior_response(
    rows: DataFrame,
    row_id: str,
    group: str,
    slopes: Mapping[str, str],
    parameters: DataFrame,
    draws: int,
    seed: int = rnd.DEFAULT_SEED,
) -> DataFrame:
    """Responses of a Gaussian model with a random intercept, simulated from priors alone.

    ``parameters`` has draw_id, intercept, sd_group, sigma and the columns that
    ``slopes`` maps from covariates. One row per data row and draw: ``row_id``,
    ``draw_id``, ``mu``, ``y_rep``. The effect of a group depends on draw and group
    only, so no table of group effects is made; ``group`` and ``row_id`` are integers or strings.
    """
    names = ["intercept", "sd_group", "sigma", *slopes.values()]
    packed = parameters.select("draw_id", F.array(*names).alias("w"))
    cells = cross_draws(rows.select(row_id, group, *slopes), packed, row_id, draws, len(names))
    w = F.col("w")
    mu = w[0] + w[1] * rnd.std_normal("draw_id", rnd.as_key(rows, group), seed=seed, stream="group")
    for i, covariate in enumerate(slopes):
        mu = mu + w[3 + i] * F.col(covariate)
    noise = w[2] * rnd.std_normal("draw_id", rnd.as_key(rows, row_id), seed=seed, stream="noise")
    cells = cells.select(row_id, "draw_id", rnd.once(mu).alias("mu"), rnd.once(noise).alias("e"))
    return cells.select(row_id, "draw_id", "mu", (F.col("mu") + F.col("e")).alias("y_rep"))
