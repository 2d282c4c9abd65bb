"""The studies run on the given tables, shaped like the observation tables.

Orders stand in for births (customer = mother) and line items for behaviour scans
(supplier = subject, order = observation).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from quadrat.functions import random as rnd
from quadrat.operators import predictive, prep, reshape
from quadrat.plans import sqltext as S
from quadrat.plans import studies
from quadrat.plans.checks import CELLS_SQL, MODE_SQL, K, N_DRAWS, TERMS, scan_cells, scan_rows
from quadrat.plans.registry import query, round_all
from quadrat.sources import tables

SEXES = ("F", "O", "P")


def births(spark, folder):
    orders = tables.given(spark, folder, "orders")
    mothers = tables.given(spark, folder, "customer").select(
        F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_nationkey"
    )
    return prep.attach_attribute(orders, mothers, "o_custkey").select(
        F.col("o_orderkey").alias("name_code"),
        F.col("o_custkey").alias("mother_name"),
        F.col("o_orderstatus").alias("off_sex"),
        (F.col("c_acctbal") / 100).alias("mother_age"),
        (F.col("c_nationkey") / 24.0).alias("rank"),
        (F.col("o_totalprice") / 100000).alias("ibi"),
        F.coalesce(F.nullif(F.col("c_nationkey"), F.lit(0)) / 24.0, F.lit(0.5)).alias("rank2"),
    )


_BIRTHS = """b AS (SELECT o_custkey AS mother_name, o_orderstatus AS sex, c_acctbal / 100 AS age, c_nationkey / 24.0::DOUBLE AS rank,
  o_totalprice / 100000 AS y FROM orders LEFT JOIN customer ON o_custkey = c_custkey),
z AS (SELECT mother_name, y, (age - ma) / sa AS x1, (rank - mr) / sr AS x2, (sex = 'O')::INT::DOUBLE AS x3, (sex = 'P')::INT::DOUBLE AS x4
  FROM b, (SELECT avg(age) ma, stddev_samp(age) sa, avg(rank) mr, stddev_samp(rank) sr FROM b)),
d AS (SELECT *, x2 * x3 AS x5, x2 * x4 AS x6 FROM z)"""
_BIRTH_TERMS = ("zage", "zrank", "off_sex_O", "off_sex_P", "zrank:off_sex_O", "zrank:off_sex_P")


def _vif_sql(prefix: str, names, source: str = "d") -> str:
    xs = [f"x{i}" for i in range(1, len(names) + 1)]
    steps, last = S.sweep("a", len(xs), len(xs), "w_")
    ctes = [prefix, f"a AS ({S.moment_matrix(xs, source)})"]
    ctes.append("o AS (SELECT " + ", ".join(f"a_{i}_{i} AS own_{i}" for i in range(1, len(xs) + 1)) + " FROM a)")
    rows = [
        f"SELECT '{n}' AS term, round(-a_{i}_{i} * own_{i}, 6) AS vif FROM {last}, o" for i, n in enumerate(names, 1)
    ]
    return "WITH " + ", ".join([*ctes, *steps]) + " " + " UNION ALL ".join(rows)


@query(_vif_sql(_BIRTHS, _BIRTH_TERMS[:4]))
def births_vif(spark, folder):
    rows = studies.prepare_intervals(births(spark, folder), "m1")
    return round_all(studies.interval_vif(rows, "m1", SEXES))


def _births_fit() -> str:
    """CTEs up to ``c``: least-squares coefficients b1..b6 and the means of the design."""
    steps, last = S.sweep("a", 7, 6, "w_")
    xs = [f"x{i}" for i in range(1, 7)]
    means = ", ".join(f"avg({x}) AS m_{x}" for x in [*xs, "y"])
    picked = ", ".join(f"a_{i}_7 AS b{i}" for i in range(1, 7))
    return ", ".join(
        [_BIRTHS, f"a AS ({S.moment_matrix([*xs, 'y'], 'd')})", f"t AS (SELECT {means} FROM d)", *steps,
         f"c AS (SELECT {picked}, t.* FROM {last}, t)"]
    )


@query(
    f"WITH {_births_fit()}, r AS (SELECT mother_name, y - m_y - ("
    + " + ".join(f"b{i} * (x{i} - m_x{i})" for i in range(1, 7))
    + """) AS e FROM d, c),
g AS (SELECT mother_name, count(*) n, avg(e) mean, var_pop(e) * count(*) AS ss FROM r GROUP BY mother_name),
s AS (SELECT count(*) g, sum(n) n, sum(n * n) n2, sum(n * mean) / sum(n) grand, sum(ss) ss FROM g),
v AS (SELECT s.*, ss / (s.n - g) AS s2, (SELECT sum(n * pow(mean - (SELECT grand FROM s), 2)) FROM g) / (g - 1) AS msb FROM s),
w AS (SELECT *, greatest((msb - s2) * (g - 1) / (n - n2 / n), 0) AS tau2 FROM v)
SELECT mother_name, g.n::BIGINT AS n, round(mean, 6) + 0.0 AS mean, round(g.n * tau2 / (g.n * tau2 + s2), 6) + 0.0 AS shrink,
  round(g.n * tau2 / (g.n * tau2 + s2) * (mean - grand), 6) + 0.0 AS effect FROM g, w"""
)
def births_group_effects(spark, folder):
    rows = studies.prepare_intervals(births(spark, folder), "m1")
    return round_all(studies.interval_group_effects(rows, "m1", SEXES))


@query(_vif_sql(_BIRTHS.replace("c_nationkey / 24.0::DOUBLE", "coalesce(nullif(c_nationkey, 0) / 24.0::DOUBLE, 0.5)"), _BIRTH_TERMS[:4]))
def births_vif_m2(spark, folder):
    """The second study takes a rank that is filled where it is missing."""
    rows = studies.prepare_intervals(births(spark, folder), "m2")
    return round_all(studies.interval_vif(rows, "m2", SEXES))


@query(_vif_sql(_BIRTHS + ", f AS (SELECT x1, x3 AS x2, x4 AS x3 FROM d)", ("zage", "off_sex_O", "off_sex_P"), "f"))
def births_vif_m3(spark, folder):
    rows = studies.prepare_intervals(births(spark, folder), "m3")
    return round_all(studies.interval_vif(rows, "m3", SEXES))


def _births_fits_sql() -> str:
    """Least squares, then the same sweep with the residual variance over the prior's on the diagonal."""
    xs = [f"x{i}" for i in range(1, 7)]
    steps, last = S.sweep("a", 7, 6, "w_")
    means = ", ".join(f"avg({x}) AS m_{x}" for x in [*xs, "y"])
    ctes = [_BIRTHS, f"a AS ({S.moment_matrix([*xs, 'y'], 'd')})", f"t AS (SELECT count(*) AS n, {means} FROM d)", *steps]
    ctes.append(f"v AS (SELECT greatest(a_7_7, 0) / (n - 7) AS s2 FROM {last}, t)")
    ends = {}
    for prior, sd in studies.SLOPE_SD.items():
        if sd == float("inf"):
            ends[prior] = last
            continue
        cells = ", ".join(
            f"a_{i}_{j}" + (f" + s2 / {sd * sd}::DOUBLE" if i == j and i < 7 else "") + f" AS a_{i}_{j}"
            for i in range(1, 8)
            for j in range(1, 8)
        )
        more, ends[prior] = S.sweep(f"a_{prior}", 7, 6, f"{prior}_")
        ctes += [f"a_{prior} AS (SELECT {cells} FROM a, v)", *more]
    rows = []
    for i, name in enumerate(("intercept", *_BIRTH_TERMS)):
        cols = []
        for prior, end in ends.items():
            value = f"e_{prior}.a_{i}_7" if i else "m_y - (" + " + ".join(f"e_{prior}.a_{j}_7 * m_x{j}" for j in range(1, 7)) + ")"
            cols.append(f"round({value}, 7) + 0.0 AS {prior}")
        tables_ = ", ".join(f"{end} AS e_{prior}" for prior, end in ends.items())
        rows.append(f"SELECT '{name}' AS term, {', '.join(cols)} FROM t, {tables_}")
    return "WITH " + ", ".join(ctes) + " " + " UNION ALL ".join(rows)


@query(_births_fits_sql())
def births_fits(spark, folder):
    """Estimates under the weak, the uniform and the strong priors side by side."""
    rows = studies.prepare_intervals(births(spark, folder), "m1")
    return round_all(studies.interval_fits(rows, "m1", SEXES), 7)


# ------------------------------------------------------------ line items as scans


def item_scans(spark, folder):
    li = tables.given(spark, folder, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("scan_id"),
        F.col("l_suppkey").alias("subject"),
        F.col("l_orderkey").alias("observation_id"),
        F.concat("l_returnflag", "l_linestatus").alias("new_scan"),
        F.col("l_quantity").alias("eldest_offspring_age"),
        (F.col("l_extendedprice") / 1000).alias("youngest_off_age"),
        (F.col("l_partkey") / 100.0).alias("age"),
        (F.col("l_suppkey") / 10.0).alias("rank"),
        F.nullif("l_discount", F.lit(0.0)).alias("food_availability"),
        F.col("l_linenumber").cast("double").alias("time_n"),
        F.nullif("l_tax", F.lit(0.0)).alias("party_adults"),
        F.dayofmonth("l_shipdate").cast("double").alias("imm_kids"),
        F.when(F.month("l_shipdate") <= 6, "F").otherwise("M").alias("youngest_off_sex"),
        F.when(F.quarter("l_shipdate").isin(1, 3), "F").otherwise("M").alias("eldest_off_sex"),
        F.when(F.year("l_shipdate") < 1998, "N").otherwise("S").alias("community"),
        F.concat("l_returnflag", "l_linestatus").alias("scan"),
        F.when(F.col("l_linenumber") % 3 != 0, (F.col("l_quantity") > 25).cast("double")).alias("pregnant"),
        (F.col("l_tax") > 0.04).cast("double").alias("oestrous"),
        F.when(F.col("l_partkey") % 4 != 0, F.col("l_suppkey") % 7 + F.col("l_discount")).alias("ibi"),
    )


_ITEM_NAMES = (
    "zeoffage", "zyoffage", "zage", "zrank", "eldest_off_sex_M", "youngest_off_sex_M",
    "zfai", "ztime", "zparty", "zkids",
)
_ITEM_SCANS = """r AS (SELECT l_orderkey * 8 + l_linenumber AS scan_id, l_quantity AS eo, l_extendedprice / 1000 AS yo, l_partkey / 100.0::DOUBLE AS age,
  l_suppkey / 10.0::DOUBLE AS rank, nullif(l_discount, 0.0) AS food, l_linenumber::DOUBLE AS t, nullif(l_tax, 0.0) AS party,
  day(l_shipdate)::DOUBLE AS kids, (month(l_shipdate) > 6)::INT::DOUBLE AS ysex, (quarter(l_shipdate) NOT IN (1, 3))::INT::DOUBLE AS esex FROM lineitem),
s AS (SELECT avg(eo) m1, stddev_samp(eo) s1, avg(yo) m2, stddev_samp(yo) s2, avg(age) m3, stddev_samp(age) s3, avg(rank) m4, stddev_samp(rank) s4,
  avg(food) m7, stddev_samp(food) s7, avg(t) FILTER (food IS NOT NULL) m8, stddev_samp(t) FILTER (food IS NOT NULL) s8,
  avg(party) FILTER (food IS NOT NULL) m9, stddev_samp(party) FILTER (food IS NOT NULL) s9,
  avg(kids) FILTER (food IS NOT NULL AND party IS NOT NULL) m10, stddev_samp(kids) FILTER (food IS NOT NULL AND party IS NOT NULL) s10 FROM r),
d AS (SELECT scan_id, (eo - m1) / s1 AS x1, (yo - m2) / s2 AS x2, (age - m3) / s3 AS x3, (rank - m4) / s4 AS x4, esex AS x5, ysex AS x6,
  (food - m7) / s7 AS x7, (t - m8) / s8 AS x8, (party - m9) / s9 AS x9, (kids - m10) / s10 AS x10 FROM r, s
  WHERE food IS NOT NULL AND party IS NOT NULL)"""


@query(
    f"WITH {_ITEM_SCANS} SELECT scan_id, "
    + ", ".join(f"round(x{i}, 6) + 0.0 AS {n}" for i, n in enumerate(_ITEM_NAMES, 1) if n[0] == "z")
    + " FROM d"
)
def scans_prepared(spark, folder):
    rows = studies.prepare_scans(item_scans(spark, folder), "m5")
    return round_all(rows.select("scan_id", *[n for n in _ITEM_NAMES if n[0] == "z"]))


@query(_vif_sql(_ITEM_SCANS, _ITEM_NAMES))
def scans_vif(spark, folder):
    rows = studies.prepare_scans(item_scans(spark, folder), "m5")
    return round_all(studies.scan_vif(rows, "m5", studies.scan_levels(rows, "m5")))


# the studies without an eldest offspring: missing pregnancies count as none, the sixth scales the birth interval last
_ITEM_STUDIES = """r AS (SELECT l_extendedprice / 1000 AS yo, l_partkey / 100.0::DOUBLE AS age, l_suppkey / 10.0::DOUBLE AS rank,
  nullif(l_discount, 0.0) AS food, l_linenumber::DOUBLE AS t, nullif(l_tax, 0.0) AS party, day(l_shipdate)::DOUBLE AS kids,
  (month(l_shipdate) > 6)::INT::DOUBLE AS ysex, (l_tax > 0.04)::INT::DOUBLE AS oest,
  CASE WHEN l_linenumber % 3 <> 0 THEN (l_quantity > 25)::INT::DOUBLE ELSE 0 END AS preg,
  CASE WHEN l_partkey % 4 <> 0 THEN l_suppkey % 7 + l_discount END AS ibi FROM lineitem),
s AS (SELECT avg(yo) m1, stddev_samp(yo) s1, avg(age) m2, stddev_samp(age) s2, avg(rank) m3, stddev_samp(rank) s3,
  avg(food) m5, stddev_samp(food) s5, avg(t) FILTER (food IS NOT NULL) m6, stddev_samp(t) FILTER (food IS NOT NULL) s6,
  avg(party) FILTER (food IS NOT NULL) m7, stddev_samp(party) FILTER (food IS NOT NULL) s7,
  avg(kids) FILTER (food IS NOT NULL AND party IS NOT NULL) m8, stddev_samp(kids) FILTER (food IS NOT NULL AND party IS NOT NULL) s8,
  avg(ibi) FILTER (food IS NOT NULL AND party IS NOT NULL) m9, stddev_samp(ibi) FILTER (food IS NOT NULL AND party IS NOT NULL) s9 FROM r),
q AS (SELECT (yo - m1) / s1 AS a1, (age - m2) / s2 AS a2, (rank - m3) / s3 AS a3, ysex AS a4, (food - m5) / s5 AS a5, (t - m6) / s6 AS a6,
  (party - m7) / s7 AS a7, (kids - m8) / s8 AS a8, (ibi - m9) / s9 AS a9, oest, preg FROM r, s WHERE food IS NOT NULL AND party IS NOT NULL)"""
_M4 = ("zoffage", "zage", "zrank", "youngest_off_sex_M", "zfai", "ztime", "zparty", "zkids", "oestrous", "pregnant")
_M6 = (*_M4[:4], "zibi", *_M4[4:])
_M4_ROWS = "SELECT a1 AS x1, a2 AS x2, a3 AS x3, a4 AS x4, a5 AS x5, a6 AS x6, a7 AS x7, a8 AS x8, oest AS x9, preg AS x10 FROM q"
_M6_ROWS = """SELECT a1 AS x1, a2 AS x2, a3 AS x3, a4 AS x4, a9 AS x5, a5 AS x6, a6 AS x7, a7 AS x8, a8 AS x9, oest AS x10, preg AS x11
  FROM q WHERE a9 IS NOT NULL"""


def _study_vif(spark, folder, study):
    rows = studies.prepare_scans(item_scans(spark, folder), study)
    return round_all(studies.scan_vif(rows, study, studies.scan_levels(rows, study)))


@query(_vif_sql(f"{_ITEM_STUDIES}, d AS ({_M4_ROWS})", _M4))
def scans_vif_m4(spark, folder):
    return _study_vif(spark, folder, "m4")


@query(_vif_sql(f"{_ITEM_STUDIES}, d AS ({_M6_ROWS})", _M6))
def scans_vif_m6(spark, folder):
    return _study_vif(spark, folder, "m6")


@query()
def scans_fit(spark, folder):
    rows = studies.prepare_scans(item_scans(spark, folder), "m5")
    fit = studies.scan_fit(rows, "m5", studies.scan_levels(rows, "m5"), "scan_id")
    return round_all(fit.table(spark), 4)


@query()
def scans_check(spark, folder):
    rows = studies.prepare_scans(item_scans(spark, folder), "m5")
    levels = studies.scan_levels(rows, "m5")
    fit = studies.scan_fit(rows, "m5", levels, "scan_id")
    return studies.scan_check(rows, "m5", levels, "scan_id", fit.draws(spark, N_DRAWS), N_DRAWS)


# ------------------------------------------------------------ predictions on rows, prior-only classes


@query(
    f"""WITH {CELLS_SQL}, {MODE_SQL} SELECT e.event_id, e.event_type, m.prediction FROM events e JOIN m USING (event_id)"""
)
def attach_predictions(spark, folder):
    modes = predictive.row_mode(scan_cells(spark, folder), "event_id", K)
    return scan_rows(spark, folder).select("event_id", "event_type").join(modes, "event_id")


PRIOR_SETS = {"narrow": 1.0, "wide": 5.0}


def prior_class_draws(spark, sd: float, n: int):
    """Class intercepts from normal(0, sd) and slopes from normal(0, 1)."""
    cells = spark.range(1, n + 1).withColumnRenamed("id", "draw_id")
    cells = cells.withColumn("class", F.explode(F.sequence(F.lit(2), F.lit(K))))
    cells = cells.select("*", F.posexplode(F.array(*[F.lit(t) for t in TERMS])).alias("p", "term"))
    z = rnd.std_normal("draw_id", "class", "p", stream="prior")
    value = z * F.when(F.col("p") == 0, sd).otherwise(1.0)
    return cells.select("draw_id", "class", "term", value.alias("value"))


def _prior_only_sql() -> str:
    def cells(name: str, sd: float) -> str:
        eta = []
        for c in range(2, K + 1):
            w = [S.std_normal("draw_id", str(c), str(p), stream="prior") for p in range(3)]
            eta.append(f"{w[0]} * {sd}::DOUBLE AS w{c}_0, {w[1]} AS w{c}_1, {w[2]} AS w{c}_2")
        head = CELLS_SQL.index("w AS (SELECT draw_id")
        tail = CELLS_SQL.index("e AS (SELECT draw_id, event_id")
        draws_ = f"w AS (SELECT draw_id::BIGINT AS draw_id, {', '.join(eta)} FROM generate_series(1, {N_DRAWS}) t(draw_id)),\n"
        return f"""SELECT '{name}' AS prior, category, min(n) AS lower, max(n) AS upper FROM (
  WITH {CELLS_SQL[:head]}{draws_}{CELLS_SQL[tail:]}
  SELECT draw_id, k::INT AS category, count(*) FILTER (category = k) AS n FROM p, generate_series(1, {K}) g(k) GROUP BY ALL) GROUP BY category"""

    return " UNION ALL ".join(cells(n, sd) for n, sd in PRIOR_SETS.items())


@query(_prior_only_sql())
def prior_only_classes(spark, folder):
    rows = predictive.parallel_rows(scan_rows(spark, folder).drop("event_type"), "event_id")
    blocks = {}
    for name, sd in PRIOR_SETS.items():
        cells = predictive.predict_category(
            rows, "event_id", prior_class_draws(spark, sd, N_DRAWS), K, TERMS, N_DRAWS
        )
        blocks[name] = predictive.envelope(predictive.counts_per_draw(cells, K), K)
    return reshape.stack_tagged(blocks, "prior")
