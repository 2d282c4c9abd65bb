"""Queries of the modelling stage: collinearity, regressions, priors."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quadrat.functions import random as rnd
from quadrat.operators import design as de
from quadrat.operators import effects, models, prep, priors
from quadrat.operators import predictive as pp
from quadrat.plans import sqltext as S
from quadrat.plans.explore import scans
from quadrat.plans.registry import query, round_all, rounded
from quadrat.sources import tables

SEED = rnd.DEFAULT_SEED

# ------------------------------------------------------------ design matrix

# Names of the item design's columns, in order; ``qty`` is asked for twice and kept once.
ITEM_NAMES = [
    "qty", "qty_sq", "disc", "l_linestatus_O", "disc:l_linestatus_O", "l_returnflag_N", "l_returnflag_R",
]


def item_terms():
    return [
        de.num("qty"),
        de.squared("qty"),
        de.interaction(de.num("disc"), de.dummies("l_linestatus", ("F", "O"))),
        de.dummies("l_returnflag", ("A", "N", "R")),
        de.num("qty"),
    ]


ITEMS = """(SELECT l_orderkey, l_linenumber, l_quantity / 10 AS qty, nullif(l_discount, 0.0) * 10 AS disc,
  l_returnflag, l_linestatus, l_extendedprice / 10000 AS price FROM lineitem)"""

# The design matrix spelled out, without any product with the reference level F.
ITEM_DESIGN = f"""(SELECT l_orderkey, l_linenumber, price AS y, qty AS x1, qty * qty AS x2, disc AS x3,
  (l_linestatus = 'O')::INT::DOUBLE AS x4, disc * (l_linestatus = 'O')::INT AS x5,
  (l_returnflag = 'N')::INT::DOUBLE AS x6, (l_returnflag = 'R')::INT::DOUBLE AS x7
  FROM {ITEMS} WHERE disc IS NOT NULL)"""


def items(spark, folder):
    rows = tables.given(spark, folder, "lineitem")
    return rows.select(
        "l_orderkey", "l_linenumber", (F.col("l_quantity") / 10).alias("qty"),
        (F.nullif("l_discount", F.lit(0.0)) * 10).alias("disc"),
        "l_returnflag", "l_linestatus", (F.col("l_extendedprice") / 10000).alias("price"),
    )


def item_design(spark, folder, keep=()):
    return de.design(items(spark, folder), item_terms(), "price", keep)


@query(
    "SELECT l_orderkey, l_linenumber, round(y, 6) AS y, "
    + ", ".join(f'round(x{i}, 6) + 0.0 AS "{n}"' for i, n in enumerate(ITEM_NAMES, 1))
    + f" FROM {ITEM_DESIGN}"
)
def design(spark, folder):
    return round_all(item_design(spark, folder, ("l_orderkey", "l_linenumber")))


# ------------------------------------------------------------ least squares, VIF


@query(
    """WITH s AS (SELECT count(*) n, avg(p_partkey / 1000.0) mx, avg(p_retailprice / 1000.0) my,
  regr_sxx(p_retailprice / 1000.0, p_partkey / 1000.0) sxx, regr_sxy(p_retailprice / 1000.0, p_partkey / 1000.0) sxy,
  regr_syy(p_retailprice / 1000.0, p_partkey / 1000.0) syy FROM part),
f AS (SELECT *, sxy / sxx AS b, greatest(syy - sxy * sxy / sxx, 0) / (n - 2) AS s2 FROM s)
SELECT 'intercept' AS term, round(my - b * mx, 8) AS estimate, round(sqrt(s2 * (1.0 / n + mx * mx / sxx)), 8) AS std_error FROM f
UNION ALL SELECT 'key', round(b, 8), round(sqrt(s2 / sxx), 8) FROM f"""
)
def ols2(spark, folder):
    part = tables.given(spark, folder, "part").select(
        (F.col("p_partkey") / 1000.0).alias("key"), (F.col("p_retailprice") / 1000.0).alias("price")
    )
    return round_all(models.least_squares(de.design(part, [de.num("key")], "price"), ["key"]), 8)


ITEM_X = [f"x{i}" for i in range(1, len(ITEM_NAMES) + 1)]


def _gaussian_sql(priors_: dict[str, float]) -> str:
    """Least squares and penalised fits of the item design, by sweeping."""
    p, m = len(ITEM_X), len(ITEM_X) + 1
    ctes = [
        f"d AS (SELECT * FROM {ITEM_DESIGN})",
        f"a AS ({S.moment_matrix([*ITEM_X, 'y'], 'd')})",
        "t AS (SELECT count(*)::DOUBLE n, " + ", ".join(f"avg({c}) m_{c}" for c in [*ITEM_X, "y"]) + " FROM d)",
    ]
    steps, flat = S.sweep("a", m, p, "flat_")
    ctes += steps
    ctes.append(f"s2 AS (SELECT a_{m}_{m} / (n - {p} - 1) AS v FROM {flat}, t)")
    out = []
    for name, s in priors_.items():
        last = flat
        if math.isfinite(s):
            cols = [
                f"a_{i}_{j}" + (f" + v / {s * s}" if i == j and i <= p else "") + f" AS a_{i}_{j}"
                for i in range(1, m + 1)
                for j in range(1, m + 1)
            ]
            ctes.append(f"start_{name} AS (SELECT {', '.join(cols)} FROM a, s2)")
            steps, last = S.sweep(f"start_{name}", m, p, f"{name}_")
            ctes += steps
        mean = " + ".join(f"a_{i}_{m} * m_x{i}" for i in range(1, p + 1))
        quad = " + ".join(
            f"-a_{i}_{j} * m_x{i} * m_x{j}" for i in range(1, p + 1) for j in range(1, p + 1)
        )
        out.append(
            f"SELECT '{name}' AS prior, 'intercept' AS term, m_y - ({mean}) AS estimate, "
            f"sqrt(v * (1 / n + {quad})) AS std_error FROM {last}, t, s2"
        )
        out += [
            f"SELECT '{name}', '{term}', a_{i}_{m}, sqrt(v * -a_{i}_{i}) FROM {last}, s2"
            for i, term in enumerate(ITEM_NAMES, 1)
        ]
    ctes.append("fits AS (" + " UNION ALL ".join(out) + ")")
    return "WITH " + ",\n".join(ctes)


@query(
    _gaussian_sql({"flat": math.inf})
    + " SELECT term, round(estimate, 7) + 0.0 AS estimate, round(std_error, 7) AS std_error FROM fits"
)
def ols(spark, folder):
    return round_all(models.least_squares(item_design(spark, folder), ITEM_NAMES), 7)


# weakly, strongly and not regularising slope priors
SLOPE_SD = {"weak": 1.0, "uniform": math.inf, "strong": 0.5}


@query(
    _gaussian_sql(SLOPE_SD)
    + " SELECT prior, term, round(estimate, 7) + 0.0 AS estimate, round(std_error, 7) AS std_error FROM fits"
)
def ridge(spark, folder):
    return round_all(models.gaussian_map(item_design(spark, folder), ITEM_NAMES, SLOPE_SD), 7)


@query(
    _gaussian_sql(SLOPE_SD)
    + " SELECT term, "
    + ", ".join(f"round(max(estimate) FILTER (prior = '{p}'), 7) + 0.0 AS {p}" for p in SLOPE_SD)
    + " FROM fits GROUP BY term"
)
def prior_sens(spark, folder):
    return round_all(models.prior_sensitivity(item_design(spark, folder), ITEM_NAMES, SLOPE_SD), 7)


def _vif_sql() -> str:
    p = len(ITEM_X)
    steps, last = S.sweep("a", p, p, "w_")
    ctes = [
        f"d AS (SELECT * FROM {ITEM_DESIGN})",
        f"a AS ({S.moment_matrix(ITEM_X, 'd')})",
        "o AS (SELECT " + ", ".join(f"a_{i}_{i} AS own_{i}" for i in range(1, p + 1)) + " FROM a)",
        *steps,
    ]
    rows = [
        f"SELECT '{term}' AS term, round(-a_{i}_{i} * own_{i}, 6) AS vif FROM {last}, o"
        for i, term in enumerate(ITEM_NAMES, 1)
    ]
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(rows)


@query(_vif_sql())
def vif(spark, folder):
    return round_all(models.vif(item_design(spark, folder), ITEM_NAMES))


@query(
    """WITH r AS (SELECT corr(l_quantity, l_extendedprice) a, corr(l_quantity, l_discount) b, corr(l_extendedprice, l_discount) c FROM lineitem),
d AS (SELECT *, 1 + 2 * a * b * c - a * a - b * b - c * c AS det FROM r)
SELECT 'l_quantity' AS term, round((1 - c * c) / det, 8) AS vif FROM d
UNION ALL SELECT 'l_extendedprice', round((1 - b * b) / det, 8) FROM d
UNION ALL SELECT 'l_discount', round((1 - a * a) / det, 8) FROM d"""
)
def vif3(spark, folder):
    rows = tables.given(spark, folder, "lineitem")
    names = ["l_quantity", "l_extendedprice", "l_discount"]
    return round_all(models.vif(de.design(rows, [de.num(n) for n in names]), names), 8)


# ------------------------------------------------------------ group effects


@query(
    """WITH g AS (SELECT role, count(*) n, avg(length(text)) mean, var_pop(length(text)) * count(*) AS ss FROM conversations GROUP BY role),
t AS (SELECT count(*) g, sum(n) n, sum(n * n) n2, sum(n * mean) / sum(n) grand, sum(ss) ss FROM g),
v AS (SELECT t.*, ss / (t.n - g) AS s2, (SELECT sum(n * pow(mean - (SELECT grand FROM t), 2)) FROM g) / (g - 1) AS msb FROM t),
w AS (SELECT *, greatest((msb - s2) * (g - 1) / (n - n2 / n), 0) AS tau2 FROM v)
SELECT role, g.n::BIGINT AS n, round(mean, 6) AS mean, round(g.n * tau2 / (g.n * tau2 + s2), 6) + 0.0 AS shrink,
  round(g.n * tau2 / (g.n * tau2 + s2) * (mean - grand), 6) + 0.0 AS effect FROM g, w"""
)
def rand_intercept(spark, folder):
    talk = tables.given(spark, folder, "conversations").select("role", F.length("text").alias("len"))
    return round_all(effects.random_intercept(talk, "role", "len"))


@query(
    """WITH g AS (SELECT l_suppkey, count(*) n, regr_sxx(y, x) sxx, regr_sxy(y, x) sxy, regr_syy(y, x) syy
  FROM (SELECT l_suppkey, l_quantity / 10 AS x, l_extendedprice / 10000 AS y FROM lineitem) GROUP BY l_suppkey),
h AS (SELECT *, sxy / nullif(sxx, 0) AS b FROM g),
t AS (SELECT sum(sxy) / sum(sxx) AS pooled, sum(syy - b * sxy) / sum(n - 2) FILTER (sxx > 0) AS s2,
  count(*) FILTER (sxx > 0) AS g, sum(sxx) s1, sum(sxx * sxx) sq FROM h),
u AS (SELECT *, greatest(((SELECT sum(sxx * pow(b - (SELECT pooled FROM t), 2)) FROM h) - (g - 1) * s2) / (s1 - sq / s1), 0) AS tau2 FROM t)
SELECT l_suppkey, n, round(b, 6) + 0.0 AS slope, round(coalesce(sxx * tau2 / (sxx * tau2 + s2), 0), 6) + 0.0 AS shrink,
  round(pooled + coalesce(sxx * tau2 / (sxx * tau2 + s2), 0) * (coalesce(b, pooled) - pooled), 6) + 0.0 AS pulled FROM h, u"""
)
def rand_slope(spark, folder):
    rows = tables.given(spark, folder, "lineitem").select(
        "l_suppkey", (F.col("l_quantity") / 10).alias("x"), (F.col("l_extendedprice") / 10000).alias("y")
    )
    return round_all(models.random_slope(rows, "l_suppkey", "x", "y"))


# lognormal(0.3, 0.4) intercept, normal(0, 0.5) slope, exponential(2) spread: the mode by repeated single Newton steps
_MODE_SQL = """WITH RECURSIVE r AS (SELECT p_retailprice / 1000 AS y, p_partkey / 1000 AS x FROM part),
m AS (SELECT count(*)::DOUBLE AS n, avg(y) AS my, regr_sxx(y, x) AS sxx, regr_sxy(y, x) AS sxy, regr_syy(y, x) AS syy FROM r),
i(k, alpha, b, tau) AS (SELECT 0, ln(my), sxy / sxx, 0.5 * ln((syy - sxy * sxy / sxx) / n) FROM m
  UNION ALL SELECT k + 1,
    alpha - (n * (my - exp(alpha)) * exp(alpha - 2 * tau) - 1 - (alpha - 0.3) / 0.16)
      / (n * exp(alpha - 2 * tau) * (my - 2 * exp(alpha)) - 1 / 0.16),
    sxy / (sxx + exp(2 * tau) / 0.25),
    tau - (-n + (syy - 2 * b * sxy + b * b * sxx + n * pow(my - exp(alpha), 2)) * exp(-2 * tau) - 2 * exp(tau))
      / (-2 * (syy - 2 * b * sxy + b * b * sxx + n * pow(my - exp(alpha), 2)) * exp(-2 * tau) - 2 * exp(tau))
  FROM i, m WHERE k < 100),
e AS (SELECT * FROM i WHERE k = 100)
SELECT 'intercept' AS term, round(exp(alpha), 6) AS estimate FROM e UNION ALL SELECT 'x', round(b, 6) + 0.0 FROM e
UNION ALL SELECT 'sigma', round(exp(tau), 6) FROM e"""


@query(_MODE_SQL)
def gaussian_mode(spark, folder):
    """Retail prices on part numbers with a lognormal intercept and an exponential spread."""
    rows = tables.given(spark, folder, "part").select((F.col("p_retailprice") / 1000).alias("y"), (F.col("p_partkey") / 1000).alias("x"))
    return round_all(models.gaussian_mode(rows, ["x"], (0.3, 0.4), 0.5, 2.0).select("term", "estimate"))


CROSSED = ("o_custkey", "month", "o_orderpriority")
CROSSED_SWEEPS = 3


def _crossed_sql() -> str:
    """Backfitting written out: per sweep and key the sums per level, their components, the effects."""
    keys, k = CROSSED, len(CROSSED)
    ctes = [
        "b AS MATERIALIZED (SELECT o_custkey AS k0, strftime(o_orderdate, '%Y-%m') AS k1, o_orderpriority AS k2, o_totalprice / 1000 AS y FROM orders)",
        "c AS MATERIALIZED (SELECT k0, k1, k2, count(*) n, avg(y) mean, var_pop(y) * count(*) AS ss FROM b GROUP BY ALL)",
        "l AS (SELECT sum(n * mean) / sum(n) AS level FROM c)",
    ]
    latest: dict[int, str] = {}
    for sweep in range(CROSSED_SWEEPS):
        for i in range(k):
            t = f"{sweep}_{i}"
            others = {j: name for j, name in latest.items() if j != i}
            left = "c.mean - level" + "".join(f" - {name}.effect" for name in others.values())
            joins = "".join(f" JOIN {name} ON {name}.k = c.k{j}" for j, name in others.items())
            ctes += [
                f"r{t} AS (SELECT c.k{i} AS k, c.n, c.ss, {left} AS r FROM c, l{joins})",
                f"g{t} AS MATERIALIZED (SELECT k, sum(n) AS n, sum(n * r) / sum(n) AS mean, "
                f"greatest(sum(ss) + sum(n * r * r) - pow(sum(n * r), 2) / sum(n), 0) AS ss FROM r{t} GROUP BY k)",
                f"t{t} AS (SELECT count(*) g, sum(n) n, sum(n * n) n2, sum(n * mean) / sum(n) AS grand, sum(ss) AS ss FROM g{t})",
                f"v{t} AS (SELECT *, ss / (n - g) AS s2, (SELECT sum(n * pow(mean - (SELECT grand FROM t{t}), 2)) FROM g{t}) AS apart FROM t{t})",
                f"w{t} AS (SELECT *, greatest((apart / (g - 1) - s2) * (g - 1) / (n - n2 / n), 0) AS tau2 FROM v{t})",
                f"e{t} AS MATERIALIZED (SELECT g.k, g.n, g.mean, coalesce(g.n * tau2 / nullif(g.n * tau2 + s2, 0), 0) AS shrink, "
                f"coalesce(g.n * tau2 / nullif(g.n * tau2 + s2, 0), 0) * (g.mean - grand) AS effect FROM g{t} g, w{t})",
            ]
            latest[i] = f"e{t}"
    rows = [
        f"SELECT '{keys[i]}' AS key, k::VARCHAR AS level, n::BIGINT AS n, round(mean, 6) + 0.0 AS mean, round(shrink, 6) + 0.0 AS shrink, "
        f"round(effect, 6) + 0.0 AS effect FROM {name}"
        for i, name in sorted(latest.items())
    ]
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(rows)


@query(_crossed_sql())
def crossed_intercepts(spark, folder):
    """Customers, months and priorities as crossed random intercepts of the order's price."""
    orders = tables.given(spark, folder, "orders").select(
        "o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderpriority", (F.col("o_totalprice") / 1000).alias("y")
    )
    return round_all(effects.crossed_intercepts(orders, CROSSED, "y", CROSSED_SWEEPS, tolerance=0.0).effects)


# two coefficients per group: 2 x 2 inverses written out; the eigenvalues below zero of the covariance go
_COEFFICIENTS_SQL = """WITH r AS MATERIALIZED (SELECT l_suppkey AS g, l_quantity / 10 AS x, l_extendedprice / 10000 AS y FROM lineitem),
c AS (SELECT avg(x) AS mx, avg(y) AS my FROM r),
m AS MATERIALIZED (SELECT g, count(*)::DOUBLE AS n, sum(x - mx) AS sx, sum((x - mx) * (x - mx)) AS sxx, sum(y - my) AS sy,
  sum((x - mx) * (y - my)) AS sxy, sum((y - my) * (y - my)) AS syy FROM r, c GROUP BY g),
p AS (SELECT (sum(sxx) * sum(sy) - sum(sx) * sum(sxy)) / (sum(n) * sum(sxx) - sum(sx) * sum(sx)) AS s0,
  (sum(n) * sum(sxy) - sum(sx) * sum(sy)) / (sum(n) * sum(sxx) - sum(sx) * sum(sx)) AS s1 FROM m),
o AS MATERIALIZED (SELECT *, n * sxx - sx * sx AS det, 1 - abs(sx) / sqrt(n * nullif(sxx, 0)) > 1e-9 AND n > 2 AS usable FROM m),
b AS MATERIALIZED (SELECT *, CASE WHEN usable THEN (sxx * sy - sx * sxy) / det END AS b0,
  CASE WHEN usable THEN (n * sxy - sx * sy) / det END AS b1 FROM o),
u AS (SELECT count(*) AS g, sum(greatest(syy - b0 * sy - b1 * sxy, 0)) / sum(n - 2) AS s2, sum(b0 - s0) AS d0, sum(b1 - s1) AS d1,
  sum((b0 - s0) * (b0 - s0)) AS q00, sum((b0 - s0) * (b1 - s1)) AS q01, sum((b1 - s1) * (b1 - s1)) AS q11,
  sum(sxx / det) AS i00, sum(-sx / det) AS i01, sum(n / det) AS i11 FROM b, p WHERE usable),
v AS (SELECT *, (q00 - d0 * d0 / g) / (g - 1) - s2 * i00 / g AS a, (q01 - d0 * d1 / g) / (g - 1) - s2 * i01 / g AS h,
  (q11 - d1 * d1 / g) / (g - 1) - s2 * i11 / g AS d FROM u),
e AS (SELECT *, (a + d) / 2 + sqrt(pow((a - d) / 2, 2) + h * h) AS top, (a + d) / 2 - sqrt(pow((a - d) / 2, 2) + h * h) AS low FROM v),
t AS (SELECT s2, CASE WHEN low >= 0 THEN a WHEN top <= 0 THEN 0 ELSE top * (a - low) / (top - low) END AS t00,
  CASE WHEN low >= 0 THEN h WHEN top <= 0 THEN 0 ELSE top * h / (top - low) END AS t01,
  CASE WHEN low >= 0 THEN d WHEN top <= 0 THEN 0 ELSE top * (d - low) / (top - low) END AS t11 FROM e),
k AS MATERIALIZED (SELECT b.*, t.*, s2 + n * t00 + sx * t01 AS k00, n * t01 + sx * t11 AS k01, sx * t00 + sxx * t01 AS k10,
  s2 + sx * t01 + sxx * t11 AS k11 FROM b, t),
j AS MATERIALIZED (SELECT *, k00 * k11 - k01 * k10 AS kd FROM k),
w AS (SELECT sum((k11 * n - k01 * sx) / kd) AS m00, sum((k11 * sx - k01 * sxx) / kd) AS m01, sum((k00 * sx - k10 * n) / kd) AS m10,
  sum((k00 * sxx - k10 * sx) / kd) AS m11, sum((k11 * sy - k01 * sxy) / kd) AS z0, sum((k00 * sxy - k10 * sy) / kd) AS z1 FROM j),
f AS (SELECT (m11 * z0 - m01 * z1) / (m00 * m11 - m01 * m10) AS f0, (m00 * z1 - m10 * z0) / (m00 * m11 - m01 * m10) AS f1 FROM w),
x AS (SELECT j.*, f0, f1, sy - n * f0 - sx * f1 AS r0, sxy - sx * f0 - sxx * f1 AS r1 FROM j, f),
y AS (SELECT *, (k11 * r0 - k01 * r1) / kd AS h0, (k00 * r1 - k10 * r0) / kd AS h1 FROM x)
SELECT g AS l_suppkey, n::BIGINT AS n, round(f0 + t00 * h0 + t01 * h1 + my, 6) + 0.0 AS intercept, round(f1 + t01 * h0 + t11 * h1, 6) + 0.0 AS x,
  round(b0 + my, 6) + 0.0 AS intercept_own, round(b1, 6) + 0.0 AS x_own FROM y, c"""


@query(_COEFFICIENTS_SQL)
def rand_coefficients(spark, folder):
    """Level and slope of the price per supplier, pulled together."""
    rows = tables.given(spark, folder, "lineitem").select(
        "l_suppkey", (F.col("l_quantity") / 10).alias("x"), (F.col("l_extendedprice") / 10000).alias("y")
    )
    return round_all(effects.random_coefficients(rows, "l_suppkey", ["x"], "y").effects)


# ------------------------------------------------------------ multinomial

SCAN_CLASSES = ("click", "error", "purchase", "signup", "view")


def scan_design(spark, folder):
    z = prep.zscore(scans(spark, folder), {"zminutes": "minutes", "zvalue": "value"})
    y = F.array_position(F.array(*[F.lit(c) for c in SCAN_CLASSES]), F.col("event_type")).cast("int")
    return z.select("event_id", y.alias("y"), "zminutes", "zvalue", "minutes", "value")


@query()
def multinom(spark, folder):
    rows = scan_design(spark, folder)
    terms = [de.num("zminutes"), de.squared("zminutes"), de.num("zvalue")]
    d = de.design(rows, terms, "y")
    fit = models.multinomial_map(d, "y", len(SCAN_CLASSES), de.column_names(terms), 1.0, 1.0)
    return round_all(fit.table(spark), 5)


@query(
    """WITH c AS (SELECT CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3
    WHEN 'signup' THEN 4 ELSE 5 END AS class, (hour(ts) >= 12)::INT AS late, count(*)::DOUBLE AS n FROM events GROUP BY ALL),
w AS (SELECT class, max(n) FILTER (late = 0) AS n0, max(n) FILTER (late = 1) AS n1 FROM c GROUP BY class),
r AS (SELECT n0 AS r0, n1 AS r1 FROM w WHERE class = 1)
SELECT class, 'intercept' AS term, round(ln(n0 / r0), 5) + 0.0 AS estimate, round(sqrt(1 / n0 + 1 / r0), 5) AS std_error FROM w, r WHERE class > 1
UNION ALL SELECT class, 'late', round(ln(n1 / r1) - ln(n0 / r0), 5) + 0.0, round(sqrt(1 / n0 + 1 / r0 + 1 / n1 + 1 / r1), 5) FROM w, r WHERE class > 1"""
)
def multinom_saturated(spark, folder):
    rows = scan_design(spark, folder).select("y", (F.col("minutes") >= 720).cast("double").alias("late"))
    return round_all(models.multinomial_map(rows, "y", len(SCAN_CLASSES), ["late"]).table(spark), 5)


# ------------------------------------------------------------ prior simulation


@query(f"SELECT event_id, round({S.std_normal('event_id', stream='slope')} * 0.5 + 0.25, 6) + 0.0 AS value FROM events")
def prior_normal(spark, folder):
    ev = tables.given(spark, folder, "events")
    return round_all(priors.normal_draws(ev, "event_id", 0.25, 0.5, SEED, "slope"))


@query(f"SELECT event_id, round(exp(1.5 + 0.4 * {S.std_normal('event_id', stream='level')}), 6) + 0.0 AS value FROM events")
def prior_lognormal(spark, folder):
    ev = tables.given(spark, folder, "events")
    return round_all(priors.lognormal_draws(ev, "event_id", 1.5, 0.4, SEED, "level"))


LINES_SQL = f"""s AS (SELECT min(l_quantity / 10) lo, max(l_quantity / 10) hi, avg(l_quantity / 10) mid FROM lineitem),
l AS (SELECT line, exp(1.5 + 0.4 * {S.std_normal('line', stream='a')}) AS a, {S.std_normal('line', stream='b')} AS b
  FROM generate_series(1, 100) t(line)),
g AS (SELECT line::INT AS line, point::INT AS point, lo + (hi - lo) * point / 100 AS x,
  a + b * (lo + (hi - lo) * point / 100 - mid) AS y FROM s, l, generate_series(0, 100) q(point))"""


def item_lines(spark, folder):
    rows = items(spark, folder)
    a = rnd.lognormal(1.5, 0.4, "line", seed=SEED, stream="a")
    b = rnd.normal(0.0, 1.0, "line", seed=SEED, stream="b")
    return priors.prior_lines(rows, "qty", a, b)


@query(f"WITH {LINES_SQL} SELECT line, point, round(x, 6) AS x, round(y, 6) + 0.0 AS y FROM g")
def prior_lines(spark, folder):
    return round_all(item_lines(spark, folder))


@query(
    f"""WITH {LINES_SQL}, p AS (SELECT line, count(*) n, count(*) FILTER (y < 0) b, count(*) FILTER (y > 10) a FROM g GROUP BY line)
SELECT round(sum(b) / sum(n), 6) AS below, round(sum(a) / sum(n), 6) AS above, count(*) FILTER (a + b > 0) AS lines_out FROM p"""
)
def prior_band(spark, folder):
    return round_all(priors.share_outside(item_lines(spark, folder), 0.0, 10.0))


PRIOR_DRAWS = 40


def prior_columns():
    """Lognormal intercept, normal slope, exponential group sd, half-t residual sd."""
    return {
        "intercept": rnd.lognormal(1.5, 0.4, "draw_id", seed=SEED, stream="intercept"),
        "b_z": rnd.normal(0.0, 1.0, "draw_id", seed=SEED, stream="slope"),
        "sd_group": rnd.exponential(1.0, "draw_id", seed=SEED, stream="sd_group"),
        "sigma": priors.half_student_t3(2.5, "draw_id", seed=SEED, stream="sigma"),
    }


@query(
    f"""WITH z AS (SELECT o_orderkey, o_custkey, (o_totalprice - m) / s AS z
  FROM orders, (SELECT avg(o_totalprice) m, stddev_samp(o_totalprice) s FROM orders)),
d AS (SELECT draw_id, 1.5 + 0.4 * {S.std_normal('draw_id', stream='intercept')} AS la, {S.std_normal('draw_id', stream='slope')} AS b,
  {S.exponential(1.0, 'draw_id', stream='sd_group')} AS sg, {S.half_student_t3(2.5, 'draw_id', seed=SEED, stream='sigma')} AS sigma
  FROM generate_series(1, {PRIOR_DRAWS}) t(draw_id)),
y AS (SELECT draw_id, exp(la) + sg * {S.std_normal('draw_id', 'o_custkey', stream='group')} + b * z AS mu,
  sigma * {S.std_normal('draw_id', 'o_orderkey', stream='noise')} AS e FROM z, d)
SELECT draw_id, count(*) AS n, round(avg(mu), 5) + 0.0 AS mean_mu, round(avg(mu + e), 5) + 0.0 AS mean_y,
  round(stddev_samp(mu + e), 5) AS sd_y, round(avg((mu + e < 0)::INT), 6) AS negative FROM y GROUP BY draw_id"""
)
def prior_only(spark, folder):
    orders = tables.given(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    z = pp.parallel_rows(prep.zscore(orders, {"z": "o_totalprice"}), "o_orderkey")
    parameters = priors.prior_parameters(spark, PRIOR_DRAWS, prior_columns())
    cells = priors.prior_response(z, "o_orderkey", "o_custkey", {"z": "b_z"}, parameters, PRIOR_DRAWS)
    got = cells.groupBy("draw_id").agg(
        F.count("*").alias("n"),
        F.avg("mu").alias("mean_mu"),
        F.avg("y_rep").alias("mean_y"),
        F.stddev_samp("y_rep").alias("sd_y"),
        F.avg((F.col("y_rep") < 0).cast("int")).alias("neg"),
    )
    return got.select(
        "draw_id", "n", rounded("mean_mu", 5).alias("mean_mu"), rounded("mean_y", 5).alias("mean_y"),
        rounded("sd_y", 5).alias("sd_y"), rounded("neg", 6).alias("negative"),
    )


@query(
    f"""WITH e AS (SELECT p_partkey, line, exp(1.5 + 0.4 * {S.std_normal('line', stream='a')})
  + {S.std_normal('line', stream='b')} * (p_size - m) / s AS y
  FROM part, (SELECT avg(p_size) m, stddev_samp(p_size) s FROM part), generate_series(1, 30) t(line))
SELECT p_partkey, round(avg(y), 6) + 0.0 AS mean, round(min(y), 6) + 0.0 AS lo, round(max(y), 6) + 0.0 AS hi FROM e GROUP BY p_partkey"""
)
def grid_cross(spark, folder):
    z = prep.zscore(tables.given(spark, folder, "part"), {"z": "p_size"}).select("p_partkey", "z")
    cells = z.withColumn("line", F.explode(F.sequence(F.lit(1), F.lit(30))))
    a = rnd.lognormal(1.5, 0.4, "line", seed=SEED, stream="a")
    b = rnd.normal(0.0, 1.0, "line", seed=SEED, stream="b")
    got = cells.groupBy("p_partkey").agg(
        F.avg(a + b * F.col("z")).alias("mean"), F.min(a + b * F.col("z")).alias("lo"),
        F.max(a + b * F.col("z")).alias("hi"),
    )
    return round_all(got)
