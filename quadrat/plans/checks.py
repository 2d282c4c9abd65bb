"""Queries on draws and on draws x rows: summaries, diagnostics, predictive checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.functions import random as rnd
from quadrat.operators import draws as dr
from quadrat.operators import predictive as pp
from quadrat.operators import prep, reshape
from quadrat.plans import sqltext as S
from quadrat.plans.explore import DISPLAY, EVENT_TYPES, SCANS, kde_sql, scans
from quadrat.plans.registry import query, round_all, rounded
from quadrat.sources import tables

# ------------------------------------------------------------ draws of parameters

CHAINS, ITERATIONS, WARMUP = 3, 400, 200


def kept(spark, folder, thin=1):
    """Draws of one intercept per supplier, autocorrelated, with chains that differ a little; warm-up and thinning go first."""
    levels = tables.given(spark, folder, "supplier").select("s_suppkey", "s_acctbal")
    cells = (
        pp.parallel_rows(levels, "s_suppkey")
        .withColumn("chain", F.explode(F.sequence(F.lit(1), F.lit(CHAINS))))
        .withColumn("iteration", F.explode(F.sequence(F.lit(1), F.lit(ITERATIONS))))
    )
    cells = dr.keep_draws(cells, WARMUP, thin)
    now = rnd.std_normal("s_suppkey", "chain", "iteration", stream="draw")
    last = rnd.std_normal("s_suppkey", "chain", F.col("iteration") - 1, stream="draw")
    return cells.select(
        "chain",
        "iteration",
        F.concat(F.lit("r_supplier["), F.col("s_suppkey").cast("string"), F.lit("]")).alias("variable"),
        rnd.once(F.col("s_acctbal") / 1000 + 0.1 * F.col("chain") + now + 0.6 * last).alias("value"),
    )


def _draws_sql(thin: int = 1) -> str:
    return f"""d AS (SELECT chain::INT AS chain, iteration::INT AS iteration, 'r_supplier[' || s_suppkey || ']' AS variable,
  s_acctbal / 1000 + 0.1::DOUBLE * chain + {S.std_normal('s_suppkey', 'chain', 'iteration', stream='draw')}
  + 0.6::DOUBLE * {S.std_normal('s_suppkey', 'chain', 'iteration - 1', stream='draw')} AS value
  FROM supplier, generate_series(1, {CHAINS}) c(chain), generate_series(1, {ITERATIONS}) t(iteration)
  WHERE iteration > {WARMUP} AND (iteration - {WARMUP} - 1) % {thin} = 0)"""


@query(f"WITH {_draws_sql(2)} SELECT chain, iteration, variable, round(value, 6) + 0.0 AS value FROM d")
def burn_thin(spark, folder):
    return round_all(kept(spark, folder, 2))


@query(
    f"""WITH {_draws_sql()} SELECT variable, round(avg(value), 6) + 0.0 AS mean, round(stddev_samp(value), 6) AS sd,
  round(quantile_cont(value, 0.025), 6) + 0.0 AS lower, round(quantile_cont(value, 0.975), 6) + 0.0 AS upper FROM d GROUP BY variable"""
)
def draw_summary(spark, folder):
    return round_all(dr.summarise(kept(spark, folder)))


@query(
    f"""WITH {_draws_sql()} SELECT variable, """
    + ", ".join(
        f"round(quantile_cont(value, {p}), 6) + 0.0 AS {n}"
        for n, p in (("ll", 0.05), ("l", 0.25), ("m", 0.5), ("h", 0.75), ("hh", 0.95))
    )
    + " FROM d WHERE regexp_matches(variable, '^r_supplier\\[[0-9]*[05]\\]$') GROUP BY variable"
)
def intervals(spark, folder):
    return round_all(dr.intervals(kept(spark, folder), r"^r_supplier\[[0-9]*[05]\]$"))


@query(
    f"""WITH {_draws_sql()}, h AS (SELECT variable, chain, iteration > {WARMUP + (ITERATIONS - WARMUP) // 2} AS late,
  count(*) n, avg(value) m, var_samp(value) v FROM d GROUP BY ALL),
p AS (SELECT variable, avg(n) n, var_samp(m) b, avg(v) w FROM h GROUP BY variable)
SELECT variable, round(sqrt(((n - 1) / n * w + b) / w), 6) AS rhat FROM p"""
)
def rhat_split(spark, folder):
    return round_all(dr.rhat(kept(spark, folder)))


def _score_sql(value: str) -> str:
    rank = f"(rank() OVER (PARTITION BY variable ORDER BY {value}) + (count(*) OVER (PARTITION BY variable, {value}) - 1) / 2.0::DOUBLE)"
    return f"({rank} - 0.375::DOUBLE) / (count(*) OVER (PARTITION BY variable) + 0.25::DOUBLE)"


@query(
    f"""WITH {_draws_sql()}, a AS (SELECT variable, chain, iteration > {WARMUP + (ITERATIONS - WARMUP) // 2} AS late, value,
  round(abs(value - median(value) OVER (PARTITION BY variable)), 9) AS apart FROM d),
q AS (SELECT *, {_score_sql('value')} AS p1, {_score_sql('apart')} AS p2 FROM a),
z AS (SELECT *, {S.inverse_normal('p1')} AS z1, {S.inverse_normal('p2')} AS z2 FROM q),
h AS (SELECT variable, chain, late, count(*) n, avg(z1) m1, var_samp(z1) v1, avg(z2) m2, var_samp(z2) v2 FROM z GROUP BY ALL),
p AS (SELECT variable, avg(n) n, var_samp(m1) b1, avg(v1) w1, var_samp(m2) b2, avg(v2) w2 FROM h GROUP BY variable),
r AS (SELECT variable, sqrt(((n - 1) / n * w1 + b1) / w1) AS bulk, sqrt(((n - 1) / n * w2 + b2) / w2) AS folded FROM p)
SELECT variable, round(bulk, 6) AS bulk, round(folded, 6) AS folded, round(greatest(bulk, folded), 6) AS rhat FROM r"""
)
def rhat_rank(spark, folder):
    return round_all(dr.rank_rhat(kept(spark, folder)))


MAX_LAG = 20


@query(
    f"""WITH {_draws_sql()}, c AS (SELECT *, value - avg(value) OVER (PARTITION BY variable, chain) AS e FROM d),
g AS (SELECT a.variable, a.chain, lag::INT AS lag, sum(a.e * b.e) AS s FROM c a, generate_series(0, {MAX_LAG}) t(lag)
  JOIN c b ON b.variable = a.variable AND b.chain = a.chain AND b.iteration = a.iteration + lag GROUP BY ALL)
SELECT variable, chain, lag, round(s / max(s) FILTER (lag = 0) OVER (PARTITION BY variable, chain), 6) + 0.0 AS rho FROM g"""
)
def acf(spark, folder):
    return round_all(dr.autocorrelation(kept(spark, folder), MAX_LAG))


ESS_SQL = f"""WITH {_draws_sql()}, c AS (SELECT variable, chain, iteration, value - avg(value) OVER w AS e, avg(value) OVER w AS mu,
  count(*) OVER w AS n FROM d WINDOW w AS (PARTITION BY variable, chain)),
g AS (SELECT a.variable, a.chain, b.iteration - a.iteration AS lag, any_value(a.mu) AS mu, any_value(a.n) AS n, sum(a.e * b.e) / any_value(a.n) AS s
  FROM c a JOIN c b ON b.variable = a.variable AND b.chain = a.chain AND b.iteration >= a.iteration GROUP BY ALL),
v AS (SELECT variable, lag, avg(s) AS s, any_value(n) AS n, var_samp(mu) AS b, count(*) AS m FROM g GROUP BY ALL),
z AS (SELECT variable, s * n / (n - 1) AS w, s + b AS total FROM v WHERE lag = 0),
r AS (SELECT variable, lag, n, m, CASE WHEN lag = 0 THEN 1 ELSE 1 - (w - s) / total END AS rho FROM v JOIN z USING (variable)),
p AS (SELECT variable, lag // 2 AS k, any_value(n) * any_value(m) AS size, sum(rho) AS pair FROM r GROUP BY ALL HAVING count(*) = 2),
q AS (SELECT *, min(pair) OVER (PARTITION BY variable ORDER BY k) AS least FROM p)
SELECT variable, round(size / greatest(-1 + 2 * sum(least), 1 / log10(size)), 4) AS ess FROM q WHERE least >= 0 GROUP BY variable, size"""


@query(ESS_SQL)
def ess(spark, folder):
    return round_all(dr.effective_size(kept(spark, folder)), 4)


@query(ESS_SQL)
def ess_long(spark, folder):
    """The same from blocks of 64 draws, as a chain longer than a block takes them."""
    return round_all(dr.effective_size(kept(spark, folder), block=64), 4)


@query(
    f"""WITH {_draws_sql()} SELECT variable, chain, iteration, round(value, 6) + 0.0 AS value FROM d WHERE iteration % 10 = 0"""
)
def trace(spark, folder):
    return round_all(dr.trace(kept(spark, folder), every=10))


def _draw_density_sql() -> str:
    return (
        f"WITH {_draws_sql()}, {kde_sql('d', 'value', 'variable', 64)} "
        "SELECT variable, j, round(x, 6) + 0.0 AS x, round(density, 8) + 0.0 AS density FROM k"
    )


@query(_draw_density_sql())
def trace_density(spark, folder):
    d = dr.marginal_density(kept(spark, folder), 64)
    return d.select("variable", "j", rounded("x").alias("x"), rounded("density", 8).alias("density"))


# ------------------------------------------------------------ categorical predictive check

N_DRAWS = 50
TERMS = ("intercept", "zminutes", "zvalue")
K = len(EVENT_TYPES)


def scan_rows(spark, folder):
    z = prep.zscore(scans(spark, folder), {"zminutes": "minutes", "zvalue": "value"})
    return z.select("event_id", "event_type", "zminutes", "zvalue")


def coefficient_draws(spark, folder):
    """Approximate draws of a multinomial logit.

    Intercepts are normal around the log ratio of class counts; slopes are drawn
    from a normal(0, 0.5) prior.
    """
    counts = tables.given(spark, folder, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    coded = counts.select(
        F.array_position(F.array(*[F.lit(c) for c in EVENT_TYPES]), F.col("event_type")).cast("int").alias("class"), "n"
    )
    base = coded.where(F.col("class") == 1).agg(F.max("n")).scalar()
    cells = (
        coded.where(F.col("class") > 1)
        .withColumn("base", base)
        .withColumn("draw_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(N_DRAWS).cast("long"))))
        .select("*", F.posexplode(F.array(*[F.lit(t) for t in TERMS])).alias("p", "term"))
    )
    z = rnd.std_normal("draw_id", "class", "p", stream="coefficient")
    level = F.ln(F.col("n") / F.col("base")) + z * F.sqrt(1 / F.col("n") + 1 / F.col("base"))
    value = F.when(F.col("p") == 0, level).otherwise(0.5 * z)
    return cells.select("draw_id", "class", "term", value.alias("value"))


def _coefficient(c: int, p: int) -> str:
    z = S.std_normal("draw_id", str(c), str(p), stream="coefficient")
    if p:
        return f"0.5::DOUBLE * {z}"
    return f"ln(n{c}::DOUBLE / n1) + {z} * sqrt(1.0::DOUBLE / n{c} + 1.0::DOUBLE / n1)"


CELLS_SQL = f"""r AS (SELECT * FROM {SCANS}),
z AS (SELECT event_id, event_type, (minutes - mm) / sm AS zminutes, (value - mv) / sv AS zvalue
  FROM r, (SELECT avg(minutes) mm, stddev_samp(minutes) sm, avg(value) mv, stddev_samp(value) sv FROM r)),
n AS (SELECT {', '.join(f"count(*) FILTER (event_type = '{v}') AS n{i}" for i, v in enumerate(EVENT_TYPES, 1))} FROM events),
w AS (SELECT draw_id::BIGINT AS draw_id, {', '.join(f"{_coefficient(c, p)} AS w{c}_{p}" for c in range(2, K + 1) for p in range(3))}
  FROM n, generate_series(1, {N_DRAWS}) t(draw_id)),
e AS (SELECT draw_id, event_id, {', '.join(f"w{c}_0 + w{c}_1 * zminutes + w{c}_2 * zvalue AS e{c}" for c in range(2, K + 1))},
  {S.uniform('draw_id', 'event_id', stream='class')} AS u FROM z, w),
t AS (SELECT *, greatest(0, {', '.join(f'e{c}' for c in range(2, K + 1))}) AS top FROM e),
s AS (SELECT draw_id, event_id, u, exp(-top) AS s1, {', '.join(
    'exp(-top) + ' + ' + '.join(f'exp(e{b} - top)' for b in range(2, c + 1)) + f' AS s{c}' for c in range(2, K + 1))} FROM t),
p AS (SELECT draw_id, event_id, CASE {' '.join(f'WHEN u * s{K} < s{c} THEN {c}' for c in range(1, K))} ELSE {K} END AS category FROM s)"""


def scan_cells(spark, folder):
    rows = pp.parallel_rows(scan_rows(spark, folder).drop("event_type"), "event_id")
    draws = coefficient_draws(spark, folder)
    return pp.predict_category(rows, "event_id", draws, K, TERMS, N_DRAWS)


@query(f"WITH {CELLS_SQL} SELECT draw_id, event_id, category FROM p")
def post_predict(spark, folder):
    return scan_cells(spark, folder)


@query(
    f"WITH {CELLS_SQL} SELECT draw_id, "
    + ", ".join(f"count(*) FILTER (category = {c}) AS c{c}" for c in range(1, K + 1))
    + " FROM p GROUP BY draw_id"
)
def per_draw_counts(spark, folder):
    return pp.counts_per_draw(scan_cells(spark, folder), K)


@query(
    f"""WITH {CELLS_SQL}, c AS (SELECT draw_id, k::INT AS category, count(*) FILTER (category = k) AS n
  FROM p, generate_series(1, {K}) g(k) GROUP BY ALL)
SELECT category, min(n) AS lower, max(n) AS upper FROM c GROUP BY category"""
)
def ppc_envelope(spark, folder):
    return pp.envelope(pp.counts_per_draw(scan_cells(spark, folder), K), K)


MODE_SQL = """c AS (SELECT event_id, category, count(*) n, min(draw_id) f FROM p GROUP BY ALL),
m AS (SELECT event_id, category AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY n DESC, f) AS place FROM c) WHERE place = 1)"""
FIRST_SQL = "m AS (SELECT event_id, category AS prediction FROM p WHERE draw_id = 1)"


@query(f"WITH {CELLS_SQL}, {MODE_SQL} SELECT event_id, prediction FROM m")
def row_mode(spark, folder):
    return pp.row_mode(scan_cells(spark, folder), "event_id", K)


@query(f"WITH {CELLS_SQL}, {FIRST_SQL} SELECT event_id, prediction FROM m")
def single_draw(spark, folder):
    rows = scan_rows(spark, folder).drop("event_type")
    return pp.single_draw(rows, "event_id", coefficient_draws(spark, folder), K, TERMS)


@query(
    f"WITH {CELLS_SQL} SELECT event_id, "
    + ", ".join(f"count(*) FILTER (category = {c}) AS c{c}" for c in range(1, K + 1))
    + " FROM p GROUP BY event_id"
)
def transpose_draws(spark, folder):
    return reshape.transpose_counts(scan_cells(spark, folder), "event_id", "category", K)


_FRAME = (
    "f(category, label, raw) AS (VALUES "
    + ", ".join(f"({i}, '{DISPLAY[v]}', '{v}')" for i, v in enumerate(EVENT_TYPES, 1))
    + ")"
)
_PAIRED = f"""{_FRAME}, q AS (SELECT f.category, f.label, (SELECT count(*) FROM events WHERE event_type = f.raw) AS observed,
  (SELECT count(*) FROM m WHERE prediction = f.category) AS predicted FROM f)"""


@query(f"WITH {CELLS_SQL}, {MODE_SQL}, {_PAIRED} SELECT category, label, observed, predicted FROM q")
def obs_vs_pred(spark, folder):
    cells = scan_cells(spark, folder)
    observed = scan_rows(spark, folder).select(
        F.array_position(F.array(*[F.lit(c) for c in EVENT_TYPES]), F.col("event_type")).cast("int").alias("category")
    )
    predicted = pp.row_mode(cells, "event_id", K).select(F.col("prediction").alias("category"))
    frame = pp.class_frame(cells, [DISPLAY[c] for c in EVENT_TYPES])
    return pp.observed_and_predicted(frame, observed, predicted)


def _check_sql(choice: str) -> str:
    return f"""WITH {CELLS_SQL}, {choice}, {_PAIRED},
b AS (SELECT k AS category, min(n) AS lower, max(n) AS upper FROM (
  SELECT draw_id, k, count(*) FILTER (category = k) AS n FROM p, generate_series(1, {K}) g(k) GROUP BY ALL) GROUP BY k)
SELECT 'observed' AS source, category, label, observed AS count, NULL::DOUBLE AS lower, NULL::DOUBLE AS upper FROM q
UNION ALL SELECT 'posterior', category, label, predicted, lower::DOUBLE, upper::DOUBLE FROM q JOIN b USING (category)"""


def scan_check(spark, folder, prediction="mode"):
    return pp.category_check(
        scan_rows(spark, folder), "event_id", "event_type", {c: DISPLAY[c] for c in EVENT_TYPES},
        coefficient_draws(spark, folder), TERMS, N_DRAWS, prediction=prediction,
    )


@query(_check_sql(MODE_SQL))
def ppc_table(spark, folder):
    return scan_check(spark, folder)


@query(_check_sql(FIRST_SQL))
def ppc_table_single(spark, folder):
    return scan_check(spark, folder, "first")


# ------------------------------------------------------------ Gaussian predictive check


def balance_rows(spark, folder):
    return tables.given(spark, folder, "customer").select(
        "c_custkey", (F.col("c_acctbal") / 1000).alias("balance"), (F.col("c_nationkey") / 10.0).alias("x")
    )


def balance_draws(spark, folder):
    """Draws of balance ~ x: least squares plus normal error of the stated standard errors."""
    x, y = F.col("x"), F.col("balance")
    s = balance_rows(spark, folder).agg(
        F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"),
        F.regr_sxx(y, x).alias("sxx"), F.regr_sxy(y, x).alias("sxy"), F.regr_syy(y, x).alias("syy"),
    )
    s = s.withColumn("b", F.col("sxy") / F.col("sxx"))
    s = s.withColumn("sigma", F.sqrt(F.greatest(F.col("syy") - F.col("b") * F.col("sxy"), F.lit(0.0)) / (F.col("n") - 2)))
    d = s.withColumn("draw_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(N_DRAWS).cast("long"))))
    slope = F.col("b") + rnd.std_normal("draw_id", stream="gb") * F.col("sigma") / F.sqrt("sxx")
    level = F.col("my") + rnd.std_normal("draw_id", stream="ga") * F.col("sigma") / F.sqrt("n")
    d = d.withColumn("slope", slope).withColumn("level", level - F.col("slope") * F.col("mx"))
    entries = F.array(
        *[
            F.struct(F.lit(c).alias("class"), F.lit(t).alias("term"), F.col(v).alias("value"))
            for c, t, v in (("mu", "intercept", "level"), ("mu", "x", "slope"), ("sigma", "intercept", "sigma"))
        ]
    )
    return d.select("draw_id", F.inline(entries))


_REPLICATES = f"""r AS (SELECT c_custkey, c_acctbal / 1000 AS balance, c_nationkey / 10.0::DOUBLE AS x FROM customer),
s AS (SELECT count(*) n, avg(x) mx, avg(balance) my, regr_sxx(balance, x) sxx, regr_sxy(balance, x) sxy, regr_syy(balance, x) syy FROM r),
c AS (SELECT *, sxy / sxx AS b, sqrt(greatest(syy - sxy / sxx * sxy, 0) / (n - 2)) AS sigma FROM s),
w AS (SELECT draw_id::BIGINT AS draw_id, b + {S.std_normal('draw_id', stream='gb')} * sigma / sqrt(sxx) AS slope,
  my + {S.std_normal('draw_id', stream='ga')} * sigma / sqrt(n) AS centre, mx, sigma FROM c, generate_series(1, {N_DRAWS}) t(draw_id)),
y AS (SELECT draw_id, c_custkey, centre - slope * mx + slope * x + sigma * {S.std_normal('draw_id', 'c_custkey', stream='replicate')} AS y_rep FROM r, w)"""


def balance_cells(spark, folder):
    rows = pp.parallel_rows(balance_rows(spark, folder), "c_custkey")
    return pp.predict_gaussian(rows, "c_custkey", balance_draws(spark, folder), ("intercept", "x"), N_DRAWS)


@query(
    f"""WITH {_REPLICATES} SELECT draw_id, count(*) AS n, round(avg(y_rep), 6) + 0.0 AS mean, round(stddev_samp(y_rep), 6) AS sd,
  round(min(y_rep), 6) + 0.0 AS lo, round(max(y_rep), 6) + 0.0 AS hi FROM y GROUP BY draw_id"""
)
def pp_gaussian(spark, folder):
    got = balance_cells(spark, folder).groupBy("draw_id").agg(
        F.count("*").alias("n"), F.avg("y_rep").alias("mean"), F.stddev_samp("y_rep").alias("sd"),
        F.min("y_rep").alias("lo"), F.max("y_rep").alias("hi"),
    )
    return round_all(got)


SHOW, GRID = 20, 128


def _overlay_sql() -> str:
    last = GRID - 1
    return f"""WITH {_REPLICATES},
h AS (SELECT count(*) n, stddev_samp(balance) sd, min(balance) lo, max(balance) hi,
  quantile_cont(balance, 0.75) - quantile_cont(balance, 0.25) iqr FROM r),
bw AS (SELECT *, 0.9 * least(sd, iqr / 1.34) * pow(n, -0.2) AS bw FROM h),
l AS (SELECT n, bw, lo - 3 * bw AS x0, (hi - lo + 6 * bw) / {last} AS dx, lo - 7 * bw AS b0, (hi - lo + 14 * bw) / {last} AS db FROM bw),
o AS (SELECT draw_id FROM w ORDER BY {S.uniform('draw_id', stream='pick')}, draw_id LIMIT {SHOW}),
v AS (SELECT draw_id, y_rep AS v FROM y WHERE draw_id IN (SELECT draw_id FROM o) UNION ALL SELECT NULL, balance FROM r),
q AS (SELECT draw_id, (v - b0) / db AS pos FROM v, l),
m AS (SELECT draw_id, floor(pos) AS i, sum(1 - (pos - floor(pos))) AS mass FROM q GROUP BY ALL
  UNION ALL SELECT draw_id, floor(pos) + 1, sum(pos - floor(pos)) FROM q GROUP BY ALL)
SELECT draw_id, j::INT AS j, round(any_value(x0 + j * dx), 6) + 0.0 AS x,
  round(sum(mass * exp(-0.5 * pow((x0 + j * dx - b0 - i * db) / bw, 2)) / (bw * sqrt(2 * pi()))) / any_value(n), 8) + 0.0 AS density
FROM m, l, generate_series(0, {last}) g(j) GROUP BY draw_id, j"""


@query(_overlay_sql())
def pp_overlay(spark, folder):
    d = pp.density_overlay(
        balance_rows(spark, folder), "c_custkey", "balance", balance_draws(spark, folder),
        ("intercept", "x"), N_DRAWS, SHOW, GRID,
    )
    return d.select("draw_id", "j", rounded("x").alias("x"), rounded("density", 8).alias("density"))
