"""Correlations and penalised regressions from distributed sufficient statistics.

Each operator reduces the rows to sums whose number depends only on the number of
terms: every task folds its rows into one vector, and the vectors are added entry
by entry across tasks. The small linear algebra on the single row that results
runs in a task too, so the plan stays lazy.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions import random as rnd
from quadrat.functions.expr import ratio

# Bytes of rows that the multinomial fit keeps as one value, and rows that a task turns into products at once.
PACKED_BYTES, FOLD_ROWS = 2048, 10_000


def _name(c: str) -> Column:
    return F.col(f"`{c}`")


def _column_means(df: DataFrame, cols: Sequence[str]) -> Column:
    return df.agg(F.array(*[F.avg(_name(c)) for c in cols])).scalar()


def _centred_sums(df: DataFrame, cols: Sequence[str], kernel) -> DataFrame:
    """One row with ``mean`` and ``sums``, the total of ``kernel`` over all batches.

    ``kernel(np, x)`` turns a matrix of centred values (NaN for null) into a vector
    that adds up over rows. Centring first keeps the digits of large offsets.
    """
    means = _column_means(df, cols)
    placed = df.select(*[_name(c).cast("double").alias(f"x{i}") for i, c in enumerate(cols)])
    placed = placed.withColumn("m", means)
    centred = placed.select(*[F.col(f"x{i}") - F.col("m")[i] for i in range(len(cols))])

    def fold(batches):
        import numpy as np
        import pandas as pd

        total = None
        for pdf in batches:
            part = kernel(np, pdf.to_numpy(dtype=float))
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

    entries = centred.mapInPandas(fold, "i long, v double").groupBy("i").agg(F.sum("v").alias("v"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"])
    return entries.agg(packed.alias("sums")).withColumn("mean", means)


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson r and count for each pair of columns, over rows where both are present."""
    cols = list(cols)
    k = len(cols)

    def kernel(np, x):
        there = (~np.isnan(x)).astype(float)
        x = np.where(there > 0, x, 0.0)
        return np.concatenate(
            [m.ravel() for m in (there.T @ there, x.T @ there, (x * x).T @ there, x.T @ x)]
        )

    def finish(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for sums in pdf["sums"]:
                total = np.asarray(sums, dtype=float)
                if not len(total):
                    total = np.zeros(4 * k * k)
                n, s, ss, xy = total.reshape(4, k, k)
                with np.errstate(invalid="ignore", divide="ignore"):
                    spread = ss - s * s / n
                    r = (xy - s * s.T / n) / np.sqrt(spread * spread.T)
                pairs = list(itertools.combinations(range(k), 2))
                yield pd.DataFrame(
                    {
                        "a": [cols[i] for i, _ in pairs],
                        "b": [cols[j] for _, j in pairs],
                        "r": [r[i, j] for i, j in pairs],
                        "n": [int(n[i, j]) for i, j in pairs],
                    }
                )

    got = _centred_sums(df, cols, kernel).mapInPandas(finish, "a string, b string, r double, n long")
    return got.select("a", "b", F.nanvl("r", F.lit(None)).alias("r"), "n")


def _on_moments(df: DataFrame, terms: Sequence[str], response: str | None, solve, schema: str) -> DataFrame:
    """Apply ``solve(np, n, mean, cross, usable)`` to the centred cross products.

    Columns are the terms and then the response. ``usable`` lists the positions of
    terms that are not linear combinations of the ones before them.
    """
    cols = [*terms, *([response] if response else [])]
    p, size = len(terms), len(cols)

    def kernel(np, x):
        return np.append((x.T @ x).ravel(), len(x))

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for mean, sums in zip(pdf["mean"], pdf["sums"], strict=True):
                total = np.asarray(sums, dtype=float)
                if not len(total) or total[-1] < 2:
                    continue
                cross = total[:-1].reshape(size, size)
                usable: list[int] = []
                for j in range(p):
                    own = rest = cross[j, j]
                    if usable:
                        inner = np.linalg.solve(cross[np.ix_(usable, usable)], cross[usable, j])
                        rest = own - cross[j, usable] @ inner
                    if own > 0 and rest > 1e-10 * own:
                        usable.append(j)
                mean = np.asarray(mean, dtype=float)
                yield pd.DataFrame(solve(np, int(total[-1]), mean, cross, usable))

    return _centred_sums(df, cols, kernel).mapInPandas(run, schema)


def vif(design_rows: DataFrame, terms: Sequence[str]) -> DataFrame:
    """Variance inflation factor of each term; null for a term the others determine.

    Rows must be complete (``design`` drops the others, response included).
    """
    terms = list(terms)

    def solve(np, n, mean, cross, usable):
        out = [None] * len(terms)
        if usable:
            block = cross[np.ix_(usable, usable)]
            sd = np.sqrt(np.diag(block))
            inverse = np.linalg.inv(block / np.outer(sd, sd))
            for place, j in enumerate(usable):
                out[j] = float(inverse[place, place])
        return {"term": terms, "vif": np.array(out, dtype=float)}

    found = _on_moments(design_rows, terms, None, solve, "term string, vif double")
    return found.select("term", F.nanvl("vif", F.lit(None)).alias("vif"))


def gaussian_map(
    design_rows: DataFrame,
    terms: Sequence[str],
    slope_sd: Mapping[str, float] | None = None,
    response: str = "y",
) -> DataFrame:
    """Gaussian regression under normal(0, s) slope priors, one block per prior.

    ``slope_sd`` maps a prior name to s; infinity is a flat prior, hence least
    squares. All priors share the same pass over the rows. The residual variance
    is the least-squares estimate; the intercept is not penalised. Returns
    ``prior``, ``term``, ``estimate``, ``std_error``; a term that the ones before
    it determine gets nulls.
    """
    priors = dict(slope_sd or {"flat": math.inf})
    terms = list(terms)
    names = ["intercept", *terms]

    def solve(np, n, mean, cross, usable):
        x, y = usable, len(terms)
        sxx, sxy = cross[np.ix_(x, x)], cross[x, y]
        ols = np.linalg.solve(sxx, sxy) if x else np.zeros(0)
        left = n - len(x) - 1
        rss = max(cross[y, y] - ols @ sxy, 0.0)
        sigma2 = rss / left if left > 0 else 0.0
        rows = {"prior": [], "term": [], "estimate": [], "std_error": []}
        for prior, s in priors.items():
            precision = sxx + np.eye(len(x)) * (sigma2 / (s * s))
            slopes = np.linalg.solve(precision, sxy) if x else np.zeros(0)
            spread = np.linalg.inv(precision) if x else np.zeros((0, 0))
            centre = mean[x]
            estimate = np.full(len(names), np.nan)
            error = np.full(len(names), np.nan)
            estimate[0] = mean[y] - slopes @ centre
            error[0] = np.sqrt(sigma2 * (1.0 / n + centre @ spread @ centre))
            for place, j in enumerate(x):
                estimate[j + 1] = slopes[place]
                error[j + 1] = np.sqrt(sigma2 * spread[place, place])
            rows["prior"] += [prior] * len(names)
            rows["term"] += names
            rows["estimate"] += list(estimate)
            rows["std_error"] += list(error)
        return rows

    schema = "prior string, term string, estimate double, std_error double"
    found = _on_moments(design_rows, terms, response, solve, schema)
    return found.select(
        "prior",
        "term",
        F.nanvl("estimate", F.lit(None)).alias("estimate"),
        F.nanvl("std_error", F.lit(None)).alias("std_error"),
    )


def least_squares(design_rows: DataFrame, terms: Sequence[str], response: str = "y") -> DataFrame:
    """Ordinary least squares: ``term``, ``estimate``, ``std_error``."""
    return gaussian_map(design_rows, terms, response=response).drop("prior")


def prior_sensitivity(
    design_rows: DataFrame, terms: Sequence[str], slope_sd: Mapping[str, float], response: str = "y"
) -> DataFrame:
    """Estimates under several priors side by side, one column per prior."""
    fits = gaussian_map(design_rows, terms, slope_sd, response)
    return fits.groupBy("term").agg(
        *[F.max(F.when(F.col("prior") == p, F.col("estimate"))).alias(p) for p in slope_sd]
    )


def gaussian_mode(
    design_rows: DataFrame,
    terms: Sequence[str],
    intercept: tuple[float, float],
    slope_sd: float,
    sigma_rate: float,
    response: str = "y",
) -> DataFrame:
    """Posterior mode of a Gaussian regression with a lognormal intercept and an exponential residual spread.

    The intercept (the level at the covariates' means) is lognormal with the two given parameters, slopes are
    normal(0, ``slope_sd``), the residual standard deviation is exponential with rate ``sigma_rate``. The prior of the
    intercept and the spread are not conjugate, so the mode is found by damped Newton steps; these need the moments
    of one aggregate only, never the rows again. Steps run on the logarithms of intercept and spread, where the
    posterior density of the original parameters is maximised. Returns ``term`` (intercept, terms, sigma),
    ``estimate``, ``std_error`` (from the curvature, on the original scale) and ``gradient`` (0 at the mode, per
    standard error); a term that the ones before it determine gets nulls. If the terms determine the response but for
    rounding, the density grows without end as the spread shrinks; there is no mode, and all values are null.
    """
    terms = list(terms)
    centre, width = intercept

    def solve(np, n, mean, cross, usable):
        x, y, k = usable, len(terms), len(usable)
        sxx, sxy, syy, level = cross[np.ix_(x, x)], cross[x, y], cross[y, y], mean[y]

        def parts(point):
            """Logarithm of the density, its gradient and curvature at (log intercept, slopes, log spread)."""
            alpha, b, tau = point[0], point[1 : 1 + k], point[-1]
            a, s, w = np.exp(alpha), np.exp(tau), np.exp(-2 * tau)
            miss, rest = level - a, sxy - sxx @ b
            square = syy - 2 * b @ sxy + b @ sxx @ b + n * miss * miss
            value = -n * tau - square * w / 2 - alpha - (alpha - centre) ** 2 / (2 * width**2)
            value += -(b @ b) / (2 * slope_sd**2) - sigma_rate * s
            g = np.empty(k + 2)
            g[0] = n * miss * a * w - 1 - (alpha - centre) / width**2
            g[1:-1] = rest * w - b / slope_sd**2
            g[-1] = -n + square * w - sigma_rate * s
            h = np.zeros((k + 2, k + 2))
            h[0, 0] = n * a * w * (miss - a) - 1 / width**2
            h[1:-1, 1:-1] = -sxx * w - np.eye(k) / slope_sd**2
            h[-1, -1] = -2 * square * w - sigma_rate * s
            h[0, -1] = h[-1, 0] = -2 * n * miss * a * w
            h[1:-1, -1] = h[-1, 1:-1] = -2 * rest * w
            return value, g, h

        names = ["intercept", *terms, "sigma"]
        ols = np.linalg.solve(sxx, sxy) if k else np.zeros(0)
        rest = syy - ols @ sxy
        if rest <= max(1e-13 * syy, n * (4 * np.finfo(float).eps * level) ** 2):
            nothing = np.full(len(names), np.nan)
            return {"term": names, "estimate": nothing, "std_error": nothing, "gradient": nothing}
        left = max(rest, 1e-12 * max(syy, 1.0)) / max(n, 1)
        point = np.concatenate([[np.log(max(level, np.exp(centre - 3 * width)))], ols, [0.5 * np.log(left)]])
        value, g, h = parts(point)
        for _ in range(200):
            # a curvature that is not negative is turned until it is
            vals, vecs = np.linalg.eigh(h)
            step = vecs @ ((vecs.T @ g) / np.maximum(np.abs(vals), 1e-12))
            if g @ step <= 1e-18:  # squared distance to the mode in standard errors
                break
            size = 1.0
            while size > 1e-12:
                new = parts(point + size * step)
                if new[0] >= value + 1e-4 * size * (g @ step):
                    break
                # where the density has no more digits, its gradient decides
                if abs(new[0] - value) <= 1e-9 * (1 + abs(value)) and abs(new[1] @ step) < abs(g @ step):
                    break
                size /= 2
            else:
                break
            point = point + size * step
            value, g, h = new
        scale = np.concatenate([[np.exp(point[0])], np.ones(k), [np.exp(point[-1])]])
        error = np.sqrt(np.maximum(np.diag(np.linalg.inv(-h)), 0.0))
        at = [0, *[1 + x.index(j) if j in x else -1 for j in range(len(terms))], k + 1]
        full = {"estimate": np.concatenate([[scale[0]], point[1:-1], [scale[-1]]]), "std_error": error * scale, "gradient": g * error}
        return {"term": names} | {c: [v[i] if i >= 0 else np.nan for i in at] for c, v in full.items()}

    found = _on_moments(design_rows, terms, response, solve, "term string, estimate double, std_error double, gradient double")
    return found.select("term", *[F.nanvl(c, F.lit(None)).alias(c) for c in ("estimate", "std_error", "gradient")])


# ------------------------------------------------------------ group effects


def random_slope(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Slope of y on x per group, pulled towards the pooled within-group slope.

    The between-group variance is the moment estimate from precision-weighted
    slopes. Returns ``group``, ``n``, ``slope`` (null without spread in x),
    ``shrink`` and ``pulled``.
    """
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & F.col(group).isNotNull())
    groups = rows.groupBy(F.col(group).alias("group")).agg(
        F.count("*").alias("n"),
        F.regr_sxx(F.col(y), F.col(x)).alias("sxx"),
        F.regr_sxy(F.col(y), F.col(x)).alias("sxy"),
        F.regr_syy(F.col(y), F.col(x)).alias("syy"),
    )
    sxx, sxy = F.col("sxx"), F.col("sxy")
    groups = groups.withColumn("slope", ratio(sxy, sxx))
    fitted = F.col("sxx") > 0
    totals = groups.agg(
        F.struct(
            (F.sum(sxy) / F.nullif(F.sum(sxx), F.lit(0.0))).alias("pooled"),
            F.sum(F.when(fitted, F.col("syy") - F.col("slope") * sxy)).alias("rss"),
            F.sum(F.when(fitted, F.col("n") - 2)).alias("df"),
            F.count_if(fitted).alias("g"),
            F.sum(sxx).alias("s1"),
            F.sum(sxx * sxx).alias("s2"),
        )
    ).scalar()
    placed = groups.withColumn("t", totals)
    apart = placed.agg(F.sum(sxx * F.pow(F.col("slope") - F.col("t.pooled"), 2))).scalar()
    t = placed.withColumn("apart", apart)
    t = t.withColumn("sigma2", ratio(F.col("t.rss"), F.col("t.df").cast("double")))
    excess = F.col("apart") - (F.col("t.g") - 1) * F.col("sigma2")
    tau2 = ratio(excess, F.col("t.s1") - ratio(F.col("t.s2"), F.col("t.s1")))
    t = t.withColumn("tau2", F.greatest(tau2, F.lit(0.0)))
    pull = ratio(sxx * F.col("tau2"), sxx * F.col("tau2") + F.col("sigma2"))
    t = t.withColumn("shrink", F.coalesce(pull, F.lit(0.0)))
    pulled = F.col("t.pooled") + F.col("shrink") * (
        F.coalesce("slope", F.col("t.pooled")) - F.col("t.pooled")
    )
    return t.select(F.col("group").alias(group), "n", "slope", "shrink", pulled.alias("pulled"))


def residuals(design_rows: DataFrame, terms: Sequence[str], fit: DataFrame, response: str = "y") -> DataFrame:
    """Add ``residual``, response minus fitted value; terms without an estimate count zero."""
    pairs = fit.agg(F.map_from_entries(F.collect_list(F.struct("term", F.coalesce("estimate", F.lit(0.0))))))
    rows = design_rows.withColumn("_b", pairs.scalar())
    fitted = F.col("_b")["intercept"]
    for t in terms:
        fitted = fitted + F.col("_b")[t] * _name(t)
    return rows.withColumn("residual", _name(response) - fitted).drop("_b")


# ------------------------------------------------------------- multinomial


@dataclass(frozen=True)
class MultinomialFit:
    """Estimates of a multinomial logit against class 1, flat in (class, term) order."""

    terms: tuple[str, ...]
    classes: int
    estimate: tuple[float, ...]
    covariance: tuple[tuple[float, ...], ...]

    def keys(self) -> list[tuple[int, str]]:
        return [(c, t) for c in range(2, self.classes + 1) for t in self.terms]

    def table(self, spark: SparkSession) -> DataFrame:
        """``class``, ``term``, ``estimate``, ``std_error``."""
        rows = [
            (c, t, b, math.sqrt(v[i]))
            for i, ((c, t), b, v) in enumerate(zip(self.keys(), self.estimate, self.covariance, strict=True))
        ]
        return spark.createDataFrame(rows, "class int, term string, estimate double, std_error double")

    def draws(self, spark: SparkSession, n: int, seed: int = rnd.DEFAULT_SEED) -> DataFrame:
        """``n`` draws from the normal approximation: draw_id, class, term, value.

        The numbers are keyed by draw and coefficient, so any part can be recomputed.
        """
        import numpy as np

        root = np.linalg.cholesky(np.asarray(self.covariance))
        rows = [
            (i, c, t, b, [float(v) for v in root[i, : i + 1]])
            for i, ((c, t), b) in enumerate(zip(self.keys(), self.estimate, strict=True))
        ]
        schema = "i int, class int, term string, centre double, root array<double>"
        cells = spark.createDataFrame(rows, schema).withColumn(
            "draw_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long")))
        )
        steps = cells.select(
            "draw_id", "i", "class", "term", "centre", F.posexplode("root").alias("j", "weight")
        )
        z = rnd.std_normal("draw_id", "j", seed=seed, stream="posterior")
        moved = steps.groupBy("draw_id", "i", "class", "term", "centre").agg(F.sum(F.col("weight") * z).alias("move"))
        return moved.select("draw_id", "class", "term", (F.col("centre") + F.col("move")).alias("value"))


def multinomial_map(
    design_rows: DataFrame,
    code: str,
    k: int,
    terms: Sequence[str],
    slope_sd: float = math.inf,
    intercept_sd: float = math.inf,
    tolerance: float = 1e-9,
    max_steps: int = 50,
) -> MultinomialFit:
    """Multinomial logit against class 1 under normal priors, by Newton steps.

    ``code`` holds classes 1..k. A step is one pass: each task folds its rows into
    one gradient and one Hessian, summed by entry across tasks; only those sums,
    whose size is set by the model, reach the driver. As usual for these priors,
    the intercept prior holds at the mean of all predictors; the returned
    intercept is that at zero. The centred rows stay in memory or on disk between
    steps, several packed as one binary value, since a value costs Spark as much as a
    row of a step does; a lost part is computed again.
    """
    import numpy as np

    terms = list(terms)
    p, free = len(terms) + 1, k - 1
    size = p * free
    names = [f"x{i}" for i in range(len(terms))]
    rows = design_rows.where(_name(code).isNotNull())
    means = [float(v or 0.0) for v in rows.agg(*[F.avg(_name(t)) for t in terms]).first()] if terms else []
    rows = rows.select(
        _name(code).cast("int").alias("code"),
        *[(_name(t) - F.lit(m)).alias(x) for t, m, x in zip(terms, means, names, strict=True)],
    )
    together = max(1, PACKED_BYTES // (8 * p))

    def pack(batches):
        import pandas as pd

        for pdf in batches:
            raw = pdf[["code", *names]].to_numpy(dtype="<f8").tobytes()
            yield pd.DataFrame({"packed": [raw[a : a + 8 * p * together] for a in range(0, len(raw), 8 * p * together)]})

    rows = rows.mapInPandas(pack, "packed binary").persist()
    fold_rows = FOLD_ROWS
    precision = np.tile([1.0 / intercept_sd**2] + [1.0 / slope_sd**2] * len(terms), free)

    def pieces(batches):
        """Arrays of up to ``FOLD_ROWS`` rows: the class and the predictors."""
        import numpy as np

        for pdf in batches:
            whole = np.frombuffer(b"".join(pdf["packed"]), "<f8").reshape(-1, p)
            for a in range(0, len(whole), fold_rows):
                yield whole[a : a + fold_rows].astype(float, copy=True)

    def sums_at(beta):
        weights = beta.reshape(free, p).copy()

        def fold(batches):
            import numpy as np
            import pandas as pd

            total = np.zeros(1 + size + size * size)
            for x in pieces(batches):
                n, code = len(x), x[:, 0].astype(int)
                x[:, 0] = 1.0
                eta = np.column_stack([np.zeros(n), x @ weights.T])
                eta -= eta.max(axis=1, keepdims=True)
                prob = np.exp(eta)
                norm = prob.sum(axis=1, keepdims=True)
                prob /= norm
                hit = np.eye(k)[code - 1]
                total[0] += float((hit * eta).sum() - np.log(norm).sum())
                total[1 : 1 + size] += ((hit - prob)[:, 1:].T @ x).ravel()
                hess = np.zeros((free, p, free, p))
                for a in range(free):
                    for b in range(a, free):
                        w = prob[:, a + 1] * ((a == b) - prob[:, b + 1])
                        hess[a, :, b, :] = (x * w[:, None]).T @ x
                        hess[b, :, a, :] = hess[a, :, b, :].T
                total[1 + size :] += hess.ravel()
            yield pd.DataFrame({"i": np.arange(len(total)), "v": total})

        parts = rows.mapInPandas(fold, "i long, v double")
        got = parts.groupBy("i").agg(F.sum("v").alias("v")).toPandas()
        total = np.zeros(1 + size + size * size)
        total[got["i"].to_numpy()] = got["v"].to_numpy()
        objective = total[0] - 0.5 * float(precision @ beta**2)
        gradient = total[1 : 1 + size] - precision * beta
        return objective, gradient, total[1 + size :].reshape(size, size) + np.diag(precision)

    beta = np.zeros(size)
    try:
        objective, gradient, curvature = sums_at(beta)
        for _ in range(max_steps):
            step = np.linalg.solve(curvature, gradient)
            if float(gradient @ step) < tolerance:
                break
            scale = 1.0
            trial = sums_at(beta + step)
            while trial[0] < objective and scale > 1e-6:
                scale /= 2
                trial = sums_at(beta + scale * step)
            beta = beta + scale * step
            objective, gradient, curvature = trial
        else:
            raise RuntimeError("no convergence: classes may be separated; use finite priors")
    finally:
        rows.unpersist()
    # back from centred predictors
    shift = np.eye(p)
    shift[0, 1:] = -np.asarray(means)
    shift = np.kron(np.eye(free), shift)
    covariance = shift @ np.linalg.inv(curvature) @ shift.T
    return MultinomialFit(
        ("intercept", *terms), k, tuple(map(float, shift @ beta)), tuple(tuple(map(float, r)) for r in covariance)
    )
