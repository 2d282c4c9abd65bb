"""Group effects from sufficient statistics: one intercept, several crossed ones, several coefficients at once.

Rows are reduced to one row per group (or per combination of groups) before anything moves, so a group with a third of
all rows costs no more than any other. These tables are written to the shared folder and everything after works on
them: the observations are read once. What reaches the driver are sums whose number depends on the terms only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.operators import groups as gr
from quadrat.operators.groups import attach_group_values
from quadrat.session import shared_path
from quadrat.sources.tables import save


def _name(c: str) -> Column:
    return F.col(f"`{c}`")


def _saved(df: DataFrame, name: str) -> DataFrame:
    return save(df, shared_path(df.sparkSession, name))


def _complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    for c in columns:
        df = df.where(_name(c).isNotNull())
    return df


# ------------------------------------------------------------ intercepts


@dataclass(frozen=True)
class Components:
    """One-way variance components: groups, grand mean, variance within and between groups (None: not estimable)."""

    groups: int
    grand: float | None
    sigma2: float | None
    tau2: float | None

    def shrink(self) -> Column:
        """How much of a group's deviation is kept."""
        if self.sigma2 is None or self.tau2 is None:
            return F.lit(0.0)
        kept = F.col("n") * F.lit(self.tau2)
        return F.coalesce(kept / F.nullif(kept + F.lit(self.sigma2), F.lit(0.0)), F.lit(0.0))


def components(groups: DataFrame, centred: bool = False) -> Components:
    """Moment estimates from a written table with ``n``, ``mean`` and ``within`` (squares around the mean) per group.

    Means that are ``centred`` near zero keep their digits in a sum of squares, which saves a second look at the groups.
    """
    t = groups.agg(
        F.count("*").alias("g"),
        F.sum("n").alias("n"),
        F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"),
        F.sum("within").alias("within"),
        F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("square"),
    ).first()
    if not t.g:
        return Components(0, None, None, None)
    if centred:
        between = max(t.square - t.n * t.grand * t.grand, 0.0)
    else:
        between = groups.agg(F.sum(F.col("n") * F.pow(F.col("mean") - F.lit(t.grand), 2))).first()[0]
    sigma2 = t.within / (t.n - t.g) if t.n > t.g else None
    spread = t.n - t.n2 / t.n
    tau2 = None
    if sigma2 is not None and t.g > 1 and spread > 0:
        tau2 = max((between / (t.g - 1) - sigma2) * (t.g - 1) / spread, 0.0)
    return Components(t.g, t.grand, sigma2, tau2)


def random_intercept(df: DataFrame, group: str, y: str) -> DataFrame:
    """Group means pulled towards the grand mean by one-way variance components.

    Returns ``group``, ``n``, ``mean``, ``shrink``, ``effect`` (the pulled deviation). Rows without group or value
    are left out.
    """
    rows = _complete(df, [group, y])
    groups = _saved(
        rows.groupBy(_name(group).alias("group")).agg(
            F.count("*").alias("n"), F.avg(_name(y)).alias("mean"), (F.var_pop(_name(y)) * F.count("*")).alias("within")
        ),
        "groups",
    )
    found = components(groups)
    out = groups.withColumn("shrink", found.shrink())
    effect = F.col("shrink") * (F.col("mean") - F.lit(found.grand))
    return out.select(F.col("group").alias(group), "n", "mean", "shrink", effect.alias("effect"))


@dataclass(frozen=True)
class CrossedFit:
    """Crossed intercepts: the overall level, variances, and one row per key and level."""

    keys: tuple[str, ...]
    intercept: float
    sigma2: float | None
    tau2: tuple[float | None, ...]
    sweeps: int
    effects: DataFrame


def crossed_intercepts(
    df: DataFrame, keys: Sequence[str], y: str, sweeps: int = 25, tolerance: float = 1e-10
) -> CrossedFit:
    """Several random intercepts whose groups cross, by backfitting on sufficient statistics.

    Observations are reduced once to one row per combination of levels (count, mean, squares around it). A sweep takes
    the keys in turn: the effects of the other keys are subtracted from the means of the combinations, the rest is
    added up per level, and ``components`` of these sums pulls the level's mean towards the grand mean. Sweeps
    end when no key's sum of squared effects changes by more than ``tolerance`` of itself (0: never), or after ``sweeps``.
    The effects are one row per level; they are broadcast to the combinations when few, else joined, the
    levels with most combinations apart.

    ``effects`` has ``key``, ``level`` (as text), ``n``, ``mean`` (of what the other keys leave over), ``shrink``,
    ``effect``. Rows with a null key or value are left out.
    """
    keys = list(keys)
    rows = _complete(df, [*keys, y])
    cells = rows.groupBy(*[_name(k).alias(f"k{i}") for i, k in enumerate(keys)]).agg(
        F.count("*").alias("n"), F.avg(_name(y)).alias("mean"), (F.var_pop(_name(y)) * F.count("*")).alias("within")
    )
    cells = _saved(cells, "cells")
    level = cells.agg((F.sum(F.col("n") * F.col("mean")) / F.sum("n"))).first()[0] or 0.0
    effects: list[DataFrame | None] = [None] * len(keys)
    found: list[Components | None] = [None] * len(keys)
    sizes: list[float | None] = [None] * len(keys)
    done = 0
    while done < sweeps:
        done, steady = done + 1, True
        for i in range(len(keys)):
            rest, left = cells, F.col("mean") - F.lit(level)
            for j, other in enumerate(effects):
                if j != i and other is not None:
                    values = other.select(f"k{j}", F.col("effect").alias(f"e{j}"), F.col("cells").alias(f"c{j}"))
                    rest = attach_group_values(rest, values, [f"k{j}"], found[j].groups <= gr.FEW_GROUPS, size=f"c{j}")
                    left = left - F.col(f"e{j}")
            rest = rest.select(f"k{i}", "n", "within", left.alias("r"))
            weighted = F.sum(F.col("n") * F.col("r"))
            one = _saved(
                rest.groupBy(f"k{i}").agg(
                    F.count("*").alias("cells"),
                    (weighted / F.sum("n")).alias("mean"),
                    F.greatest(
                        F.sum("within") + F.sum(F.col("n") * F.col("r") * F.col("r")) - weighted * weighted / F.sum("n"),
                        F.lit(0.0),
                    ).alias("within"),
                    F.sum("n").alias("n"),
                ),
                "effects",
            )
            found[i] = components(one, centred=True)
            pulled = one.withColumn("shrink", found[i].shrink())
            effects[i] = pulled.withColumn("effect", F.col("shrink") * (F.col("mean") - F.lit(found[i].grand)))
            if tolerance > 0:
                size = effects[i].agg(F.sum(F.col("n") * F.col("effect") * F.col("effect"))).first()[0] or 0.0
                steady &= sizes[i] is not None and abs(size - sizes[i]) <= tolerance * max(size, sizes[i])
                sizes[i] = size
            else:
                steady = False
        if steady:
            break
    last = found[-1]
    table = None
    for i, (k, e) in enumerate(zip(keys, effects, strict=True)):
        part = e.select(
            F.lit(k).alias("key"), F.col(f"k{i}").cast("string").alias("level"), "n", "mean", "shrink", "effect"
        )
        table = part if table is None else table.unionByName(part)
    return CrossedFit(
        tuple(keys), level + (last.grand or 0.0), last.sigma2, tuple(f.tau2 for f in found), done, table
    )


# ------------------------------------------------------------ coefficients


def _summed(groups: DataFrame, fold) -> np.ndarray:
    """Vector added up over all groups; ``fold(pdf)`` makes it for a batch of moments."""

    def run(batches):
        import numpy as np
        import pandas as pd

        total = None
        for pdf in batches:
            part = fold(pdf)
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    rows = groups.mapInPandas(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    return np.array([r.v for r in sorted(rows, key=lambda r: r.i)])


def _kernels(k: int):
    """Functions that tasks carry: the moments of a batch of groups, and their least squares."""

    def moments(pdf):
        import numpy as np

        a = np.empty((len(pdf), k, k))
        for i in range(k):
            for j in range(i, k):
                a[:, i, j] = a[:, j, i] = pdf[f"a{i}_{j}"]
        c = np.stack([pdf[f"c{i}"].to_numpy(float) for i in range(k)], axis=1)
        return a, c, pdf["n"].to_numpy(float), pdf["yy"].to_numpy(float)

    def own(a, c, n):
        """Least squares of every group, and which groups have enough spread for it."""
        import numpy as np

        scale = np.sqrt(np.maximum(np.einsum("gii->gi", a), 1e-300))
        unit = a / scale[:, :, None] / scale[:, None, :]
        usable = (np.linalg.eigvalsh(unit)[:, 0] > 1e-9) & (n > k)
        b = np.full(c.shape, np.nan)
        if usable.any():
            b[usable] = np.linalg.solve(a[usable], c[usable][:, :, None])[:, :, 0]
        return b, usable

    return moments, own


@dataclass(frozen=True)
class CoefficientFit:
    """Coefficients that vary by group: their mean, covariance between groups, residual variance, and effects."""

    terms: tuple[str, ...]
    mean: np.ndarray
    covariance: np.ndarray
    sigma2: float
    effects: DataFrame


def random_coefficients(df: DataFrame, group: str, terms: Sequence[str], y: str, intercept: bool = True) -> CoefficientFit:
    """Intercept and slopes that vary together by group, pulled towards their mean by their covariance.

    Each group is reduced to its moments X'X, X'y, y'y and n in one aggregate, covariates centred at their
    overall means (the intercept is the level there). Least squares per group, solved in batches, gives the
    residual variance and, by moments, the covariance between groups: that of the estimates less their mean sampling
    covariance, negative directions set to zero. The mean coefficients are generalised least squares over all
    groups. A group's coefficients are the mean plus its best linear predictor, which needs no inverse of X'X, so
    groups with few rows or without spread get one too.

    ``effects`` has ``group``, ``n`` and per term the pulled coefficient and ``<term>_own``, the group's least
    squares (null where not estimable). Rows with a null in any used column are left out.
    """
    terms = list(terms)
    names = [*(["intercept"] if intercept else []), *terms]
    k = len(names)
    rows = _complete(df, [group, *terms, y])
    means = rows.agg(*[F.avg(_name(t)) for t in [*terms, y]]).first()
    centre = [0.0 if m is None else float(m) for m in means]
    level = centre[-1] if intercept else 0.0
    x = [*([F.lit(1.0)] if intercept else []), *[_name(t) - F.lit(m) for t, m in zip(terms, centre, strict=False)]]
    out = _name(y) - F.lit(level)
    sums = [F.sum(x[i] * x[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)]
    sums += [F.sum(x[i] * out).alias(f"c{i}") for i in range(k)]
    groups = _saved(
        rows.groupBy(_name(group).alias("group")).agg(F.count("*").alias("n"), F.sum(out * out).alias("yy"), *sums), "moments"
    )
    moments, own_fit = _kernels(k)

    def plain(pdf):
        import numpy as np

        a, c, _, _ = moments(pdf)
        return np.concatenate([a.sum(axis=0).ravel(), c.sum(axis=0)])

    pooled = _summed(groups, plain)
    if not len(pooled):
        nothing = groups.select(F.col("group").alias(group), "n", *[F.lit(0.0).alias(t) for t in names], *[F.lit(0.0).alias(f"{t}_own") for t in names])
        return CoefficientFit(tuple(names), np.full(k, np.nan), np.full((k, k), np.nan), np.nan, nothing)
    start = np.linalg.lstsq(pooled[: k * k].reshape(k, k), pooled[k * k :], rcond=None)[0]

    def spread(pdf):
        import numpy as np

        a, c, n, yy = moments(pdf)
        b, usable = own_fit(a, c, n)
        d, a, c, n, yy, b = b[usable] - start, a[usable], c[usable], n[usable], yy[usable], b[usable]
        rss = np.maximum(yy - np.einsum("gi,gi->g", b, c), 0.0)
        return np.concatenate(
            [[len(d), rss.sum(), (n - k).sum()], d.sum(axis=0), np.einsum("gi,gj->ij", d, d).ravel(), np.linalg.inv(a).sum(axis=0).ravel()]
        )

    total = _summed(groups, spread)
    g, rss, left = total[:3]
    sigma2 = rss / left if left > 0 else 0.0
    covariance = np.zeros((k, k))
    if g > 1:
        mid, square = total[3 : 3 + k], total[3 + k : 3 + k + k * k].reshape(k, k)
        sampling = total[3 + k + k * k :].reshape(k, k) * sigma2 / g
        apart = (square - np.outer(mid, mid) / g) / (g - 1) - sampling
        values, vectors = np.linalg.eigh((apart + apart.T) / 2)
        covariance = (vectors * np.maximum(values, 0.0)) @ vectors.T
    if not sigma2 > 0:  # nothing is left over: own estimates where there are any
        sigma2 = 0.0
    eye = np.eye(k) * (sigma2 or 1e-300)

    def weighted(pdf):
        import numpy as np

        a, c, _, _ = moments(pdf)
        inner = eye + a @ covariance
        both = np.linalg.solve(inner, np.concatenate([a, c[:, :, None]], axis=2))
        return np.concatenate([both[:, :, :k].sum(axis=0).ravel(), both[:, :, k].sum(axis=0)])

    mean = start
    if sigma2 > 0:
        sums_ = _summed(groups, weighted)
        mean = np.linalg.lstsq(sums_[: k * k].reshape(k, k), sums_[k * k :], rcond=None)[0]
    shown = np.array([level if t == "intercept" and intercept else 0.0 for t in names])

    def pulled(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            a, c, n, _ = moments(pdf)
            own, usable = own_fit(a, c, n)
            if sigma2 > 0:
                inner = eye + a @ covariance
                shift = np.linalg.solve(inner, (c - a @ mean)[:, :, None])[:, :, 0]
                b = mean + shift @ covariance
            else:
                b = np.where(usable[:, None], own, mean)
            made = {group: pdf["group"], "n": pdf["n"]}
            made |= {t: b[:, i] + shown[i] for i, t in enumerate(names)}
            made |= {f"{t}_own": own[:, i] + shown[i] for i, t in enumerate(names)}
            yield pd.DataFrame(made)

    kind = groups.schema["group"].dataType.simpleString()
    schema = ", ".join([f"`{group}` {kind}", "n long", *[f"`{t}` double" for t in [*names, *[f"{t}_own" for t in names]]]])
    effects = groups.mapInPandas(pulled, schema)
    effects = effects.select(group, "n", *[_name(t) for t in names], *[F.nanvl(_name(f"{t}_own"), F.lit(None)).alias(f"{t}_own") for t in names])
    return CoefficientFit(tuple(names), mean + shown, covariance, sigma2, effects)
