"""Queries of the exploration and preparation stage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions import expr as X
from quadrat.operators import describe, factors, models, prep, reshape
from quadrat.plans.registry import query, round_all, rounded
from quadrat.session import shared_path
from quadrat.sources import tables


def flagged_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with their quality flags; documents without labels have null flags."""
    docs = tables.given(spark, folder, "documents").drop("text")
    return prep.attach_attribute(docs, tables.given(spark, folder, "labels"), "doc_id")


FLAGGED = (
    "(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic "
    "FROM documents d LEFT JOIN labels l USING (doc_id))"
)


def scans(spark: SparkSession, folder: str, *more: str, source: DataFrame | None = None) -> DataFrame:
    """Events as behaviour scans: minutes of the day, a flag and a partly missing covariate.

    ``more`` names further columns of ``source``, the events unless given.
    """
    ev = tables.given(spark, folder, "events") if source is None else source
    return ev.select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        X.minutes_of_day("ts").alias("minutes"),
        F.when(F.col("event_type") != "error", F.col("value")).alias("amount"),
        F.when(F.col("event_type") == "purchase", 1)
        .when(F.col("event_type") == "signup", 0)
        .alias("flag"),
        *more,
    )


def scans_with_k(spark: SparkSession, folder: str) -> DataFrame:
    """Scans and the number ``k`` from their JSON properties, parsed once per row."""
    k = F.nullif(F.get_json_object("props", "$.k").cast("double"), F.lit(0.0))
    events = tables.given(spark, folder, "events").select("*", X.computed_once({"k": k}))
    return scans(spark, folder, "k", source=events)


SCANS = """(SELECT event_id, user_id, event_type, value,
  hour(ts) * 60 + minute(ts) + second(ts) / 60.0::DOUBLE AS minutes,
  CASE WHEN event_type <> 'error' THEN value END AS amount,
  nullif(CAST(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS k,
  CASE event_type WHEN 'purchase' THEN 1 WHEN 'signup' THEN 0 END AS flag
  FROM events)"""


# ------------------------------------------------------------ sources


_PROFILED = (("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"), ("quality", "int"), ("toxic", "int"))


def _profile_sql() -> str:
    rows = []
    for i, (c, kind) in enumerate(_PROFILED, 1):
        ends = f"min({c}), max({c})" if kind == "string" else f"min({c})::DOUBLE, max({c})::DOUBLE"
        ends = f"NULL::DOUBLE, NULL::DOUBLE, {ends}" if kind == "string" else f"{ends}, NULL::VARCHAR, NULL::VARCHAR"
        rows.append(
            f"SELECT {i}, '{c}', '{kind}', count(*), count(*) - count({c}), count(DISTINCT {c}) + max(({c} IS NULL)::INT)::BIGINT, {ends} FROM d"
        )
    names = "position, \"column\", type, n, n_null, n_distinct, min_num, max_num, min_text, max_text"
    return (
        "WITH d AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)), "
        f"p({names}) AS ({' UNION ALL '.join(rows)}) SELECT * FROM p"
    )


@query(_profile_sql())
def profile(spark, folder):
    """All columns of the documents with their flags, texts included."""
    docs = tables.given(spark, folder, "documents")
    return tables.profile(prep.attach_attribute(docs, tables.given(spark, folder, "labels"), "doc_id"))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def save_reload(spark, folder):
    return tables.save(tables.given(spark, folder, "customer"), shared_path(spark, "customer"))


@query(
    """SELECT p_partkey AS part, p_brand AS brand, round(p_retailprice / 1000.0, 6) AS price,
  round(p_size::DOUBLE * p_size, 6) AS size_sq FROM part"""
)
def project_rename(spark, folder):
    part = tables.given(spark, folder, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size")
    return (
        part.withColumn("price", rounded(F.col("p_retailprice") / 1000.0))
        .withColumn("size_sq", rounded(F.pow(F.col("p_size"), 2)))
        .drop("p_retailprice", "p_size")
        .withColumnsRenamed({"p_partkey": "part", "p_brand": "brand"})
    )


@query(
    """SELECT event_id, round(hour(ts) * 60 + minute(ts) + second(ts) / 60.0::DOUBLE, 6) AS minutes FROM events"""
)
def minutes_of_day(spark, folder):
    ev = tables.given(spark, folder, "events")
    return ev.select("event_id", rounded(X.minutes_of_day("ts")).alias("minutes"))


# ------------------------------------------------------------ null rules


@query(
    f"""SELECT doc_id, coalesce(toxic, 0) AS toxic, quality IS NULL AS unknown, NULL::DOUBLE AS bound
FROM {FLAGGED} WHERE toxic = 1 OR toxic IS NULL"""
)
def null_rules(spark, folder):
    rows = flagged_documents(spark, folder).where(X.holds_or_null(F.col("toxic") == 1))
    return prep.fill_missing(rows, {"toxic": 0}).select(
        "doc_id", "toxic", F.col("quality").isNull().alias("unknown"), X.missing_double().alias("bound")
    )


@query(f"SELECT count(*) AS n FROM {FLAGGED} WHERE toxic = 1 OR toxic IS NULL")
def count_or_null(spark, folder):
    return flagged_documents(spark, folder).where(X.holds_or_null(F.col("toxic") == 1)).agg(
        F.count("*").alias("n")
    )


@query(
    f"""SELECT count(DISTINCT lang) FILTER (toxic = 1)
  + max((toxic IS NULL)::INT)::BIGINT AS langs,
  count(DISTINCT n_chars) FILTER (quality = 1) + max((quality IS NULL)::INT)::BIGINT AS lengths
FROM {FLAGGED}"""
)
def distinct_where(spark, folder):
    return flagged_documents(spark, folder).agg(
        X.n_distinct_where("lang", F.col("toxic") == 1).alias("langs"),
        X.n_distinct_where("n_chars", F.col("quality") == 1).alias("lengths"),
    )


@query(
    f"""SELECT count(DISTINCT source) + max((source IS NULL)::INT)::BIGINT AS sources,
  count(DISTINCT quality) + max((quality IS NULL)::INT)::BIGINT AS qualities,
  count(DISTINCT toxic) + max((toxic IS NULL)::INT)::BIGINT AS toxics,
  count(DISTINCT doc_id) + max((doc_id IS NULL)::INT)::BIGINT AS docs FROM {FLAGGED}"""
)
def level_counts(spark, folder):
    return flagged_documents(spark, folder).agg(
        X.n_distinct("source").alias("sources"),
        X.n_distinct("quality").alias("qualities"),
        X.n_distinct("toxic").alias("toxics"),
        X.n_distinct("doc_id").alias("docs"),
    )


@query("SELECT DISTINCT k FROM " + SCANS + " WHERE k IS NOT NULL ORDER BY k")
def levels_sorted(spark, folder):
    return describe.levels(scans_with_k(spark, folder), "k")


@query("SELECT doc_id, lang, quality, toxic FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL")
def attach_attr(spark, folder):
    docs = tables.given(spark, folder, "documents").select("doc_id", "lang")
    return prep.attach_attribute(docs, tables.given(spark, folder, "labels"), "doc_id", "quality")


# ------------------------------------------------------------ scaling


@query(
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, nullif(l_discount, 0.0) AS d FROM lineitem),
f AS (SELECT * FROM r WHERE d IS NOT NULL),
s AS (SELECT avg(l_quantity) mq, stddev_samp(l_quantity) sq, avg(l_extendedprice) mp,
  stddev_samp(l_extendedprice) sp, avg(d) md, stddev_samp(d) sd FROM f)
SELECT l_orderkey, l_linenumber, round((l_quantity - mq) / nullif(sq, 0), 6) + 0.0 AS zquantity,
  round((l_extendedprice - mp) / nullif(sp, 0), 6) + 0.0 AS zprice, round((d - md) / nullif(sd, 0), 6) + 0.0 AS zdiscount
FROM f, s"""
)
def zscore_filtered(spark, folder):
    rows = tables.given(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
        F.nullif("l_discount", F.lit(0.0)).alias("d"),
    )
    z = prep.zscore(
        prep.keep_present(rows, "d"), {"zquantity": "l_quantity", "zprice": "l_extendedprice", "zdiscount": "d"}
    )
    return round_all(z.select("l_orderkey", "l_linenumber", "zquantity", "zprice", "zdiscount"))


@query(
    f"""WITH r AS (SELECT * FROM {SCANS}),
a AS (SELECT avg(minutes) m, stddev_samp(minutes) s FROM r),
b AS (SELECT avg(amount) m, stddev_samp(amount) s FROM r WHERE amount IS NOT NULL),
c AS (SELECT avg(k) m, stddev_samp(k) s FROM r WHERE amount IS NOT NULL AND k IS NOT NULL)
SELECT event_id, round((minutes - a.m) / a.s, 6) + 0.0 AS zminutes, round((amount - b.m) / b.s, 6) + 0.0 AS zamount,
  round((k - c.m) / c.s, 6) + 0.0 AS zk, coalesce(flag, 0) AS flag
FROM r, a, b, c WHERE amount IS NOT NULL AND k IS NOT NULL"""
)
def prep_chain(spark, folder):
    steps = [
        ("scale", "zminutes", "minutes"),
        ("keep", "amount"),
        ("scale", "zamount", "amount"),
        ("keep", "k"),
        ("scale", "zk", "k"),
    ]
    z = prep.filter_then_scale(scans_with_k(spark, folder), steps)
    z = prep.fill_missing(z, {"flag": 0})
    return round_all(z.select("event_id", "zminutes", "zamount", "zk", "flag"))


# ------------------------------------------------------------ summaries

NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", min({c}) AS lo, max({c}) AS hi FROM lineitem" for c in NUMBERS
    )
)
def range_all(spark, folder):
    return describe.ranges(tables.given(spark, folder, "lineitem"), NUMBERS)


@query(
    f"""SELECT 'price' AS variable, min(o_totalprice) AS min, quantile_cont(o_totalprice, 0.25) AS q1,
  quantile_cont(o_totalprice, 0.5) AS median, round(avg(o_totalprice), 4) AS mean,
  quantile_cont(o_totalprice, 0.75) AS q3, max(o_totalprice) AS max, count(o_totalprice) AS n, count(*) - count(o_totalprice) AS n_null FROM orders
UNION ALL SELECT 'amount', min(amount), quantile_cont(amount, 0.25), quantile_cont(amount, 0.5),
  round(avg(amount), 4), quantile_cont(amount, 0.75), max(amount), count(amount), count(*) - count(amount) FROM {SCANS}""".replace(
        "quantile_cont(o_totalprice, 0.25)", "round(quantile_cont(o_totalprice, 0.25), 4)"
    )
    .replace("quantile_cont(o_totalprice, 0.5)", "round(quantile_cont(o_totalprice, 0.5), 4)")
    .replace("quantile_cont(o_totalprice, 0.75)", "round(quantile_cont(o_totalprice, 0.75), 4)")
    .replace("quantile_cont(amount, 0.25)", "round(quantile_cont(amount, 0.25), 4)")
    .replace("quantile_cont(amount, 0.5)", "round(quantile_cont(amount, 0.5), 4)")
    .replace("quantile_cont(amount, 0.75)", "round(quantile_cont(amount, 0.75), 4)")
)
def summary6(spark, folder):
    price = describe.summary6(tables.given(spark, folder, "orders"), "o_totalprice")
    amount = describe.summary6(scans(spark, folder), "amount")
    return round_all(reshape.stack_tagged({"price": price, "amount": amount}, "variable"), 4)


PROBS = (0.0, 0.025, 0.25, 0.5, 0.975, 1.0)


@query(
    " UNION ALL ".join(
        f"SELECT {p}::DOUBLE AS prob, round(quantile_cont(o_totalprice, {p}), 6) AS value FROM orders" for p in PROBS
    )
)
def quantiles(spark, folder):
    return round_all(describe.quantiles(tables.given(spark, folder, "orders"), "o_totalprice", PROBS))


@query(
    " UNION ALL ".join(
        f"SELECT l_returnflag, {p}::DOUBLE AS prob, round(quantile_cont(l_extendedprice, {p}), 4) AS value "
        "FROM lineitem GROUP BY l_returnflag"
        for p in (0.1, 0.5, 0.9)
    )
)
def quantiles_grouped(spark, folder):
    rows = tables.given(spark, folder, "lineitem")
    return round_all(describe.quantiles(rows, "l_extendedprice", (0.1, 0.5, 0.9), ["l_returnflag"]), 4)


@query(
    """WITH s AS (SELECT min(o_totalprice) lo, max(o_totalprice) hi, ceil(log2(count(*)) + 1)::INT k FROM orders),
c AS (SELECT greatest(least(ceil((o_totalprice - lo) / ((hi - lo) / k))::INT, k), 1) AS bin, count(*) AS n
  FROM orders, s GROUP BY 1),
f AS (SELECT unnest(generate_series(1, k))::INT AS bin, lo, (hi - lo) / k AS w FROM s)
SELECT bin, round(lo + (bin - 1) * w, 4) AS lower, round(lo + bin * w, 4) AS upper, coalesce(n, 0) AS n
FROM f LEFT JOIN c USING (bin)"""
)
def hist_sturges(spark, folder):
    return round_all(describe.histogram(tables.given(spark, folder, "orders"), "o_totalprice", "equal"), 4)


@query(
    """WITH s AS (SELECT min(value) lo, max(value) hi, ceil(log2(count(*)) + 1)::INT k FROM events),
u AS (SELECT lo, hi, (hi - lo) / k AS cell, pow(10.0, floor(log10((hi - lo) / k))) AS base FROM s),
w AS (SELECT lo, hi, CASE
  WHEN 2 * base - cell >= 1.5 * (cell - base) THEN base
  WHEN 5 * base - cell >= 2.75 * (cell - 2 * base) THEN 2 * base
  WHEN 10 * base - cell >= 1.5 * (cell - 5 * base) THEN 5 * base ELSE 10 * base END AS unit FROM u),
l AS (SELECT unit, floor(lo / unit + 1e-10) AS a, ceil(hi / unit - 1e-10) AS b FROM w),
c AS (SELECT greatest(ceil((value - a * unit - 1e-7 * unit) / unit)::INT, 1) AS bin, count(*) AS n FROM events, l GROUP BY 1),
f AS (SELECT unnest(generate_series(1, (b - a)::INT))::INT AS bin, a, unit FROM l)
SELECT bin, round((a + bin - 1) * unit, 6) + 0.0 AS lower, round((a + bin) * unit, 6) + 0.0 AS upper, coalesce(n, 0) AS n
FROM f LEFT JOIN c USING (bin)"""
)
def hist_pretty(spark, folder):
    return round_all(describe.histogram(tables.given(spark, folder, "events"), "value"))


def kde_sql(source: str, value: str, by: str | None, points: int) -> str:
    """Checking SQL of a binned Gaussian density; ``source`` has the value and group."""
    g = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    on = f"USING ({by})" if by else "ON true"
    last = points - 1
    return f"""s AS (SELECT {g}count(*) n, stddev_samp({value}) sd, min({value}) lo, max({value}) hi,
  quantile_cont({value}, 0.75) - quantile_cont({value}, 0.25) iqr FROM {source} WHERE {value} IS NOT NULL {group}),
h AS (SELECT *, 0.9 * CASE WHEN least(sd, iqr / 1.34) > 0 THEN least(sd, iqr / 1.34) WHEN sd > 0 THEN sd ELSE 1 END
  * pow(n, -0.2) AS bw FROM s),
y AS (SELECT {g}n, bw, lo - 3 * bw AS x0, (hi - lo + 6 * bw) / {last} AS dx,
  lo - 7 * bw AS b0, (hi - lo + 14 * bw) / {last} AS db FROM h),
p AS (SELECT {g}n, bw, x0, dx, b0, db, ({value} - b0) / db AS pos FROM {source} JOIN y {on} WHERE {value} IS NOT NULL),
m AS (SELECT {g}n, bw, x0, dx, b0, db, floor(pos) AS i, sum(1 - (pos - floor(pos))) AS w FROM p GROUP BY ALL
  UNION ALL SELECT {g}n, bw, x0, dx, b0, db, floor(pos) + 1, sum(pos - floor(pos)) FROM p GROUP BY ALL),
k AS (SELECT {g}j::INT AS j, any_value(x0 + j * dx) AS x,
  sum(w * exp(-0.5 * pow((x0 + j * dx - b0 - i * db) / bw, 2)) / (bw * sqrt(2 * pi()))) / any_value(n) AS density
  FROM m, generate_series(0, {last}) t(j) GROUP BY {g}j)"""


@query(f"WITH {kde_sql('lineitem', 'l_quantity', None, 512)} SELECT j, round(x, 6) + 0.0 AS x, round(density, 8) + 0.0 AS density FROM k")
def kde(spark, folder):
    rows = tables.given(spark, folder, "lineitem")
    d = describe.density(rows, "l_quantity")
    return d.select("j", rounded("x").alias("x"), rounded("density", 8).alias("density"))


@query(
    f"WITH {kde_sql('events', 'value', 'event_type', 128)} "
    "SELECT event_type, j, round(x, 6) + 0.0 AS x, round(density, 8) + 0.0 AS density FROM k"
)
def kde_grouped(spark, folder):
    d = describe.density(tables.given(spark, folder, "events"), "value", ["event_type"], 128)
    return d.select("event_type", "j", rounded("x").alias("x"), rounded("density", 8).alias("density"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type")
def count_by(spark, folder):
    return describe.count_by(tables.given(spark, folder, "events"), "event_type")


@query(
    """SELECT a.p_brand, b.p_size, coalesce(c.n, 0) AS n
FROM (SELECT DISTINCT p_brand FROM part) a CROSS JOIN (SELECT DISTINCT p_size FROM part) b
LEFT JOIN (SELECT p_brand, p_size, count(*) n FROM part GROUP BY ALL) c ON a.p_brand = c.p_brand AND b.p_size = c.p_size"""
)
def contingency(spark, folder):
    return describe.contingency(tables.given(spark, folder, "part"), "p_brand", "p_size")


EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


@query(
    "SELECT user_id, "
    + ", ".join(f"count(*) FILTER (event_type = '{v}') AS {v}" for v in EVENT_TYPES)
    + " FROM events GROUP BY user_id"
)
def contingency_wide(spark, folder):
    return describe.contingency_wide(tables.given(spark, folder, "events"), "user_id", "event_type", EVENT_TYPES)


@query(
    """WITH r AS (SELECT l_quantity, l_extendedprice, nullif(l_discount, 0.0) AS discount, nullif(l_tax, 0.0) AS tax FROM lineitem)
"""
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 8) + 0.0 AS r, "
        f"count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n FROM r"
        for a, b in (
            ("l_quantity", "l_extendedprice"), ("l_quantity", "discount"), ("l_quantity", "tax"),
            ("l_extendedprice", "discount"), ("l_extendedprice", "tax"), ("discount", "tax"),
        )
    )
)
def corr_matrix(spark, folder):
    rows = tables.given(spark, folder, "lineitem").select(
        "l_quantity", "l_extendedprice",
        F.nullif("l_discount", F.lit(0.0)).alias("discount"), F.nullif("l_tax", F.lit(0.0)).alias("tax"),
    )
    return round_all(models.correlation_matrix(rows, rows.columns), 8)


@query(
    f"""SELECT event_type, min(k) AS min, round(quantile_cont(k, 0.25), 4) AS q1, round(quantile_cont(k, 0.5), 4) AS median,
  round(avg(k), 4) AS mean, round(quantile_cont(k, 0.75), 4) AS q3, max(k) AS max, count(*) AS n
FROM {SCANS} WHERE k IS NOT NULL GROUP BY event_type"""
)
def pair_mixed(spark, folder):
    return round_all(describe.mixed_pairs(scans_with_k(spark, folder), "k", "event_type"), 4)


# ------------------------------------------------------------ sorting, codes, modes


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 6")
def head6(spark, folder):
    rows = tables.given(spark, folder, "events").select("event_id", "user_id", "event_type")
    return describe.head(rows, ["event_id"])


@query("SELECT min(event_id) AS position FROM events WHERE value = (SELECT max(value) FROM events)")
def which_max(spark, folder):
    return factors.which_max(tables.given(spark, folder, "events"), "value", "event_id")


@query(
    """SELECT event_id, event_type, dense_rank() OVER (ORDER BY event_type)::INT AS y FROM events"""
)
def factor_code(spark, folder):
    rows = tables.given(spark, folder, "events").select("event_id", "event_type")
    return factors.factor_code(rows, "event_type", "y")


@query(
    "SELECT level, row_number() OVER (ORDER BY level) AS code FROM (SELECT DISTINCT o_custkey AS level FROM orders)"
)
def dense_codes(spark, folder):
    return factors.dense_codes(tables.given(spark, folder, "orders"), "o_custkey")


@query(
    """SELECT event_id, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 END AS place
FROM events"""
)
def factor_levels(spark, folder):
    order = ("view", "click", "signup", "purchase")
    return tables.given(spark, folder, "events").select(
        "event_id", X.level_code("event_type", order).alias("place")
    )


@query(
    """WITH c AS (SELECT CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN 3 WHEN 'view' THEN 4 END AS code FROM events)
SELECT t.code::INT AS code, count(c.code) AS n FROM generate_series(1, 5) t(code) LEFT JOIN c ON c.code = t.code GROUP BY t.code"""
)
def tabulate_codes(spark, folder):
    rows = tables.given(spark, folder, "events").select(
        X.level_code("event_type", ("click", "absent", "purchase", "view")).alias("code")
    )
    return factors.tabulate(rows, "code", 5)


@query(f"SELECT flag, min(event_id) AS first_at FROM {SCANS} GROUP BY flag")
def dedupe_first(spark, folder):
    return factors.first_seen(scans(spark, folder), "flag", "event_id")


@query(
    f"""WITH f AS (SELECT flag, min(event_id) AS first_at FROM {SCANS} GROUP BY flag)
SELECT s.event_id, f.first_at FROM {SCANS} s JOIN f ON s.flag IS NOT DISTINCT FROM f.flag"""
)
def match_lookup(spark, folder):
    rows = scans(spark, folder).select("event_id", "flag")
    return factors.match_position(
        rows, "flag", factors.first_seen(rows, "flag", "event_id"), "flag", "first_at"
    ).drop("flag")


@query(
    f"""WITH c AS (SELECT user_id, flag, count(*) n, min(event_id) s FROM {SCANS} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, s) AS place FROM c),
d AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, s) AS place FROM c WHERE flag IS NOT NULL)
SELECT r.user_id, r.flag AS mode, d.flag AS mode_known FROM r LEFT JOIN d ON r.user_id = d.user_id AND d.place = 1 WHERE r.place = 1"""
)
def mode_first(spark, folder):
    rows = scans(spark, folder).select("user_id", "flag", "event_id")
    every = factors.mode_first(rows, ["user_id"], "flag", "event_id")
    known = factors.mode_first(rows, ["user_id"], "flag", "event_id", na_rm=True, out="mode_known")
    return every.join(known, "user_id", "left")


# ------------------------------------------------------------ reshaping


@query(
    " UNION ALL ".join(
        f"SELECT l_orderkey, l_linenumber, '{c}' AS variable, {c} AS value FROM lineitem" for c in NUMBERS
    )
)
def to_long(spark, folder):
    rows = tables.given(spark, folder, "lineitem")
    return reshape.to_long(rows, ["l_orderkey", "l_linenumber"], NUMBERS, "variable", "value")


@query(
    """SELECT 'customer' AS source, c_nationkey AS nation, count(*) AS n FROM customer GROUP BY ALL
UNION ALL SELECT 'supplier', s_nationkey, count(*) FROM supplier GROUP BY ALL"""
)
def union_tag(spark, folder):
    c = tables.given(spark, folder, "customer").select(F.col("c_nationkey").alias("nation"))
    s = tables.given(spark, folder, "supplier").select(F.col("s_nationkey").alias("nation"))
    return reshape.stack_tagged(
        {"customer": describe.count_by(c, "nation"), "supplier": describe.count_by(s, "nation")}
    )


DISPLAY = {
    "click": "Clicked", "error": "Failed", "purchase": "Bought", "signup": "Joined", "view": "Viewed",
}


@query(
    "SELECT event_id, d.label FROM events JOIN (VALUES "
    + ", ".join(f"('{k}', '{v}')" for k, v in DISPLAY.items())
    + ") d(raw, label) ON event_type = d.raw"
)
def code_labels(spark, folder):
    dim = spark.range(1).select(
        F.inline(F.array(*[F.struct(F.lit(k).alias("raw"), F.lit(v).alias("label")) for k, v in DISPLAY.items()]))
    )
    ev = tables.given(spark, folder, "events").select("event_id", "event_type")
    # one row per display label, fixed above
    return ev.join(F.broadcast(dim), ev.event_type == dim.raw).select("event_id", "label")


@query(
    "SELECT event_id, CAST(user_id AS VARCHAR) = '1' AS is_one FROM events"
)
def code_equals(spark, folder):
    return tables.given(spark, folder, "events").select(
        "event_id", (F.col("user_id").cast("string") == "1").alias("is_one")
    )
