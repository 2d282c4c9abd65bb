"""Counts, ranges, quantiles, histograms and densities of columns."""

from __future__ import annotations

import functools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.operators import groups
from quadrat.operators.groups import attach_group_values
from quadrat.session import shared_path
from quadrat.sources.tables import save


def ranges(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Minimum and maximum of each column, one row per column, from one scan."""
    row = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("column"),
                    F.min(c).cast("double").alias("lo"),
                    F.max(c).cast("double").alias("hi"),
                )
                for c in cols
            ]
        ).alias("r")
    )
    return row.select(F.inline("r"))


def count_by(df: DataFrame, group: str, name: str = "n") -> DataFrame:
    """Rows per group; the null group is dropped."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias(name))


def levels(df: DataFrame, col: str) -> DataFrame:
    """Distinct non-null values in ascending order."""
    return df.where(F.col(col).isNotNull()).select(col).distinct().orderBy(col)


def head(df: DataFrame, order: Sequence[str], n: int = 6) -> DataFrame:
    """First rows under an explicit order; each task keeps n rows, nothing is fully sorted."""
    return df.orderBy(*order).limit(n)


#: Levels of one column that travel as one array value.
LEVELS_AT_ONCE = 10_000


def contingency(df: DataFrame, a: str, b: str, zeros: bool = True, name: str = "n", at_once: int = LEVELS_AT_ONCE) -> DataFrame:
    """Rows per pair of levels; nulls are dropped. Any number of levels.

    Counts are pre-aggregated, so a hot pair costs one row per task. With ``zeros`` (as many rows as pairs) pairs that never
    occur count 0: every level of ``a`` meets the levels of ``b`` in blocks of about ``at_once``, joined on the
    block and a share of the levels of ``a``, so neither side is gathered. Without, only pairs that occur are returned.
    """
    counts = (
        df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
        .groupBy(a, b)
        .agg(F.count("*").alias(name))
    )
    if not zeros:
        return counts
    b_levels = df.where(F.col(b).isNotNull()).select(b).distinct()
    a_levels = df.where(F.col(a).isNotNull()).select(a).distinct()
    blocks = -(-b_levels.count() // at_once)
    if blocks <= 1:
        frame = a_levels.select(a, F.explode(b_levels.agg(F.collect_list(b)).scalar()).alias(b))
    else:
        shares = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sides = b_levels.groupBy(F.pmod(F.xxhash64(b), F.lit(blocks)).cast("int").alias("_b")).agg(F.collect_list(b).alias("_v"))
        sides = sides.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
        each = a_levels.withColumn("_s", F.pmod(F.xxhash64(a), F.lit(shares)).cast("int"))
        each = each.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        frame = each.join(sides.hint("merge"), ["_b", "_s"]).select(a, F.explode("_v").alias(b))
    return frame.join(counts, [a, b], "left").select(
        a, b, F.coalesce(name, F.lit(0).cast("long")).alias(name)
    )


def contingency_wide(df: DataFrame, a: str, b: str, b_levels: Sequence) -> DataFrame:
    """Two-way table with one column per given level of ``b``."""
    kept = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    return kept.groupBy(a).agg(
        *[F.count_if(F.col(b) == F.lit(v)).alias(str(v)) for v in b_levels]
    )


# ---------------------------------------------------------------- quantiles


#: Rows that one bracket may bring to a window: bins of a count or distinct values, never a group.
MOST_ROWS = 4096
#: Bins into which a larger bracket is cut.
BINS = 1024


def _magnitude(x: Column) -> Column:
    """Number of the two octaves around x, monotone over all doubles: at most 2,100 different ones."""
    octaves = F.floor(F.log2(F.abs(x)) / 2) + 600
    sign = F.signum(x).cast("long")
    return F.when(x == 0, F.lit(0).cast("long")).when(F.abs(x) == math.inf, sign * 5000).otherwise(sign * octaves)


def _bin_in(x: Column, lo: Column, hi: Column, bins: int) -> Column:
    pos = F.floor((x - lo) / F.nullif(hi - lo, F.lit(0.0)) * bins)
    return F.coalesce(F.least(pos, F.lit(bins - 1).cast("long")), F.lit(0).cast("long"))


def _rows_in_brackets(
    base: DataFrame, brackets: DataFrame, by: list[str], most: int, few: bool
) -> DataFrame:
    """Rows of ``base`` that lie inside a bracket of their group, tagged with it.

    Brackets of a group do not overlap and there are at most ``most`` of them.
    """
    entries = F.sort_array(F.collect_list(F.struct("lo", "hi", "below", "c")))
    if by:
        packed = brackets.groupBy(*by, "n").agg(entries.alias("bs"))
        tagged = attach_group_values(base, packed, by, few, size="n")
    else:
        packed = brackets.agg(F.struct(F.first("n").alias("n"), entries.alias("bs")))
        tagged = base.withColumn("s", packed.scalar()).select("x", "s.n", "s.bs")
    # the last bracket that starts at or before x
    starts = " + ".join(f"int(coalesce(get(bs, {i}).lo <= x, false))" for i in range(most))
    nearest = F.expr(f"inline(array(get(bs, {starts} - 1)))")
    return tagged.select(*by, "n", "x", nearest).where("x <= hi")


def order_statistics(
    df: DataFrame,
    value: str,
    ranks: Sequence[Column],
    by: Sequence[str] = (),
    bins: int = BINS,
    most: int = MOST_ROWS,
) -> DataFrame:
    """Exact values at 0-based ranks by radix selection, without sorting or collecting a group.

    ``ranks`` are expressions over the per-group count ``n``. The first scan counts the rows of every
    group by their magnitude (sign and pair of octaves, so tiny values and far outliers do not share a
    bin with the rest) and keeps the brackets that hold a rank. A bracket of more than ``most`` rows is
    cut into ``bins`` equal parts between its observed minimum and maximum by another scan; of a smaller one the
    distinct values are counted. That is repeated until all brackets are single values. Counts are added
    up in tasks before they move, so a value or a group with a third of all rows is a few rows per task,
    and no window orders more than ``max(bins, most)`` rows, or the 2,100 magnitudes. Brackets are written to the shared
    folder after each scan; the last scan is part of the result. If no group has more than ``most`` rows, one scan
    counts them and another orders each group; a trillion evenly spread values take four scans. Nulls and NaN are
    skipped. Returns ``by``, ``n``, ``rank``, ``x``.
    """
    by = list(by)
    x, skipped = F.col("x"), F.col("skipped")
    wanted = F.array_distinct(F.array(*[r.cast("long") for r in ranks]))

    def inside(start: Column) -> Column:
        return F.filter(wanted, lambda r: (r >= start) & (r < start + F.col("c")))

    base = df.select(*by, F.col(value).cast("double").alias("x"))
    # false for NaN, which sorts above infinity, and unknown for null
    base = base.where(x <= F.lit(math.inf))
    sums = [F.count("*").alias("c"), F.min("x").alias("lo"), F.max("x").alias("hi")]
    group = W.partitionBy(*by)
    if by and (base.groupBy(*by).count().agg(F.max("count")).first()[0] or 0) <= most:
        placed = base.select(*by, "x", F.count("*").over(group).alias("n"), (F.row_number().over(group.orderBy("x")) - 1).alias("rank"))
        placed = placed.withColumn("rank", F.col("rank").cast("long"))
        return placed.where(F.array_contains(wanted, F.col("rank"))).select(*by, "n", "rank", "x")
    placed = base.groupBy(*by, _magnitude(x).alias("part")).agg(*sums)
    placed = placed.withColumn("n", F.sum("c").over(group))
    placed = placed.withColumn("skipped", F.sum("c").over(group.orderBy("part")) - F.col("c"))
    small = F.col("n") <= most
    start = F.when(small, F.lit(0).cast("long")).otherwise(skipped)
    brackets = placed.where(small | (F.size(inside(skipped)) > 0)).groupBy(*by, "n", start.alias("below")).agg(
        F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    found = []
    while True:
        brackets = save(brackets, shared_path(df.sparkSession, "brackets"))
        found.append(brackets.where("lo = hi"))
        open_ = brackets.where("lo < hi")
        size = open_.agg(F.max("c").alias("c"), F.count("*").alias("k")).first()
        if size.c is None:
            break
        tagged = _rows_in_brackets(base, open_, by, len(ranks), bool(by) and size.k <= groups.FEW_GROUPS)
        cut = _bin_in(x, F.col("lo"), F.col("hi"), bins).cast("double")
        counted = tagged.groupBy(*by, "n", "below", F.when(F.col("c") > most, cut).otherwise(x).alias("part")).agg(*sums)
        order = W.partitionBy(*by, "below").orderBy("part")
        counted = counted.withColumn("skipped", F.col("below") + F.sum("c").over(order) - F.col("c"))
        brackets = counted.where(F.size(inside(skipped)) > 0).select(*by, "n", skipped.alias("below"), "c", "lo", "hi")
        if size.c <= most:
            found.append(brackets)
            break
    values = [f.select(*by, "n", F.explode(inside(F.col("below"))).alias("rank"), F.col("lo").alias("x")) for f in found]
    return functools.reduce(DataFrame.unionByName, values)


def quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles with linear interpolation between order statistics: ``by``, ``prob``, ``value``."""
    by = list(by)

    def at(p: float) -> Column:
        return (F.col("n") - 1) * F.lit(float(p))

    wanted = [f(at(p)) for p in probs for f in (F.floor, F.ceil)]
    found = order_statistics(df, value, wanted, by)
    per_group = found.groupBy(*by).agg(
        F.first("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("m")
    )
    # at rank r = (n - 1) * p, between the values at floor(r) and ceil(r)
    rows = ", ".join(
        f"struct(double({float(p)!r}) AS prob, m[floor(r{i})] + (r{i} - floor(r{i})) * (m[ceil(r{i})] - m[floor(r{i})]) AS value)"
        for i, p in enumerate(probs)
    )
    per_group = per_group.select(*by, "m", *[at(p).alias(f"r{i}") for i, p in enumerate(probs)])
    return per_group.select(*by, F.expr(f"inline(array({rows}))"))


def summary6(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Minimum, quartiles, mean, maximum, number of values and of nulls; NaN counts as null."""
    by = list(by)
    df = df.select(*by, F.nanvl(F.col(value).cast("double"), F.lit(None)).alias(value))
    base = df.groupBy(*by).agg(
        F.min(value).cast("double").alias("min"),
        F.max(value).cast("double").alias("max"),
        F.avg(value).alias("mean"),
        F.count(value).alias("n"),
        F.count_if(F.col(value).isNull()).alias("n_null"),
    )
    q = (
        quantiles(df, value, (0.25, 0.5, 0.75), by)
        .groupBy(*by)
        .agg(
            *[
                F.max(F.when(F.col("prob") == p, F.col("value"))).alias(name)
                for p, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))
            ]
        )
    )
    cols = ["min", "q1", "median", "mean", "q3", "max", "n", "n_null"]
    if not by:
        packed = q.select(F.struct("q1", "median", "q3")).scalar()
        base = base.withColumn("q", packed).select("*", "q.*")
        return base.select(*cols)
    same = F.lit(True)
    for k in by:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    joined = base.alias("l").join(q.alias("r"), same, "left")
    return joined.select(*[F.col(f"l.{k}") for k in by], *cols)


# ---------------------------------------------------------------- histogram


def _sturges(n: Column) -> Column:
    return F.ceil(F.log2(n.cast("double")) + 1).cast("int")


def histogram(df: DataFrame, value: str, breaks: str = "pretty") -> DataFrame:
    """Counts in right-closed bins; the lowest edge belongs to the first bin.

    Sturges' rule gives the wanted number of bins. ``breaks="pretty"`` moves the
    edges to multiples of 1, 2 or 5 times a power of ten, ``"equal"`` splits the
    range evenly. Empty bins are kept. One scan finds the range, one counts.
    """
    x = F.col("x")
    base = df.select(F.col(value).cast("double").alias("x")).where(x.isNotNull())
    stats = base.agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    stats = stats.where(F.col("n") > 0).withColumn("k", _sturges(F.col("n")))
    lo, hi, k = F.col("lo"), F.col("hi"), F.col("k")
    if breaks == "equal":
        width = F.when(hi > lo, (hi - lo) / k).otherwise(F.lit(1.0))
        layout = stats.select(
            lo.alias("start"),
            width.alias("width"),
            F.when(hi > lo, k).otherwise(F.lit(1)).alias("bins"),
            F.lit(0.0).alias("fuzz"),
        )
    elif breaks == "pretty":
        layout = _pretty_layout(stats)
    else:
        raise ValueError(f"unknown breaks: {breaks}")
    spec = layout.select(F.struct("start", "width", "bins", "fuzz")).scalar()
    placed = base.withColumn("s", spec).select("x", "s.*")
    number = F.ceil((x - F.col("start") - F.col("fuzz")) / F.col("width")).cast("int")
    number = F.greatest(F.least(number, F.col("bins")), F.lit(1))
    counts = placed.groupBy(number.alias("bin")).agg(F.count("*").alias("n"))
    frame = layout.select(
        F.explode(F.sequence(F.lit(1), F.col("bins"))).alias("bin"), "start", "width"
    )
    return frame.join(counts, "bin", "left").select(
        "bin",
        (F.col("start") + (F.col("bin") - 1) * F.col("width")).alias("lower"),
        (F.col("start") + F.col("bin") * F.col("width")).alias("upper"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
    )


def _pretty_layout(stats: DataFrame) -> DataFrame:
    """Bin start and width on round numbers, about ``k`` bins over [lo, hi]."""
    lo, hi, k = F.col("lo"), F.col("hi"), F.col("k")
    # Bias towards larger units (1.5 in general, 2.75 for a 5-unit),
    # rounding slack and fuzz relative to the bin width, and the shrinkage, large
    # value rule and share of bins used when all values are equal.
    bias, bias5, slack, fuzz = 1.5, 2.75, 1e-10, 1e-7
    shrink, large, least_share = 0.75, 10.0, 3
    s = stats.withColumn("least", F.greatest(F.expr(f"k div {least_share}"), F.lit(1).cast("long")))
    size = F.when(F.abs(hi) > large, 9 + F.abs(hi) / 10).when(hi == 0, F.lit(1.0))
    flat = size.otherwise(F.abs(hi)) * shrink / F.col("least")
    s = s.withColumn("cell", F.when(hi > lo, (hi - lo) / k).otherwise(flat))
    s = s.withColumn("base", F.pow(F.lit(10.0), F.floor(F.log10("cell"))))
    cell, base = F.col("cell"), F.col("base")
    # Move up through 1, 2, 5, 10 times the base while the next unit is close enough.
    two = (2 * base - cell) < bias * (cell - base)
    five = (5 * base - cell) < bias5 * (cell - 2 * base)
    ten = (10 * base - cell) < bias * (cell - 5 * base)
    unit = F.when(two & five & ten, 10 * base).when(two & five, 5 * base).when(two, 2 * base)
    s = s.withColumn("unit", unit.otherwise(base))
    unit, first, last = F.col("unit"), F.col("first"), F.col("last")
    s = s.withColumn("first", F.floor(lo / unit + slack))
    s = s.withColumn("last", F.ceil(hi / unit - slack))
    # Too few bins: widen on both sides, the odd one below zero-or-more, else above.
    s = s.withColumn("lack", F.greatest(F.col("least") - (last - first), F.lit(0).cast("long")))
    below = F.when(first >= 0, F.expr("(lack + 1) div 2")).otherwise(F.expr("lack div 2"))
    s = s.withColumn("below", below)
    start = first - F.col("below")
    return s.select(
        (start * unit).alias("start"),
        unit.alias("width"),
        (last + F.col("lack") - F.col("below") - start).cast("int").alias("bins"),
        (unit * fuzz).alias("fuzz"),
    )


# ---------------------------------------------------------------- density


def bin_mass(
    df: DataFrame, value: str, by: Sequence[str], start: Column, step: Column
) -> DataFrame:
    """Linear binning: each value splits its unit mass over the two nearest grid points.

    Only the count and the summed offset per cell are shuffled.
    """
    pos = (F.col(value) - start) / step
    cells = df.select(*by, F.floor(pos).alias("cell"), (pos - F.floor(pos)).alias("f"))
    cells = cells.groupBy(*by, "cell").agg(F.count("*").alias("c"), F.sum("f").alias("f"))
    halves = F.array(
        F.struct(F.col("cell").alias("i"), (F.col("c") - F.col("f")).alias("mass")),
        F.struct((F.col("cell") + 1).alias("i"), F.col("f").alias("mass")),
    )
    return cells.select(*by, F.inline(halves)).groupBy(*by, "i").agg(F.sum("mass").alias("mass"))


def _bandwidth(n: Column, sd: Column, iqr: Column, adjust: float) -> Column:
    """0.9 * min(sd, IQR / 1.34) * n**-0.2, falling back to sd, then 1, when that is zero."""
    spread = F.least(sd, iqr / 1.34)
    spread = F.when(spread > 0, spread).when(sd > 0, sd).otherwise(F.lit(1.0))
    return F.lit(0.9 * adjust) * spread * F.pow(n.cast("double"), F.lit(-0.2))


def density_layout(
    df: DataFrame, value: str, by: Sequence[str] = (), points: int = 512,
    adjust: float = 1.0, cut: float = 3.0,
) -> DataFrame:
    """Bandwidth, evaluation grid and binning grid of a density, per group."""
    by = list(by)
    base = df.select(*by, F.col(value).cast("double").alias("x")).where(F.col("x").isNotNull())
    stats = base.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.coalesce(F.stddev_samp("x"), F.lit(0.0)).alias("sd"),
        F.min("x").alias("lo"),
        F.max("x").alias("hi"),
    )
    quart = (
        quantiles(base, "x", (0.25, 0.75), by)
        .groupBy(*by)
        .agg((F.max("value") - F.min("value")).alias("iqr"))
    )
    if by:
        joined = attach_group_values(stats, quart, by, few=False)
    else:
        joined = stats.withColumn("iqr", quart.scalar())
    bw = _bandwidth(F.col("n"), F.col("sd"), F.col("iqr"), adjust)
    joined = joined.where(F.col("n") > 0).withColumn("bw", bw)
    wide, bw = cut + 4.0, F.col("bw")
    return joined.select(
        *by,
        "n",
        "bw",
        (F.col("lo") - cut * bw).alias("from"),
        ((F.col("hi") - F.col("lo") + 2 * cut * bw) / (points - 1)).alias("by_x"),
        (F.col("lo") - wide * bw).alias("start"),
        ((F.col("hi") - F.col("lo") + 2 * wide * bw) / (points - 1)).alias("step"),
    )


LAYOUT = ("n", "bw", "from", "by_x", "start", "step")


def smooth(mass: DataFrame, by: Sequence[str], points: int = 512) -> DataFrame:
    """Gaussian kernel sum of binned mass at the evaluation grid.

    ``mass`` holds at most ``points`` rows per group, so the work per group is
    fixed, whatever the number of observations behind it.
    """
    at = mass.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("from") + F.col("j") * F.col("by_x")
    z = (x - F.col("start") - F.col("i") * F.col("step")) / F.col("bw")
    kernel = F.exp(F.lit(-0.5) * z * z) / (F.col("bw") * F.lit(math.sqrt(2 * math.pi)))
    return at.groupBy(*by, "j").agg(
        F.max(x).alias("x"), (F.sum(F.col("mass") * kernel) / F.max("n")).alias("density")
    )


def density(
    df: DataFrame, value: str, by: Sequence[str] = (), points: int = 512,
    adjust: float = 1.0, cut: float = 3.0,
) -> DataFrame:
    """Gaussian kernel density on a regular grid: ``by``, ``j``, ``x``, ``density``.

    The layout, one row per group, is written to the shared folder before values are binned.
    """
    by = list(by)
    layout = save(density_layout(df, value, by, points, adjust, cut), shared_path(df.sparkSession, "layout"))
    base = df.select(*by, F.col(value).cast("double").alias("v")).where(F.col("v").isNotNull())
    if by:
        placed = attach_group_values(base, layout, by, layout.count() <= groups.FEW_GROUPS, size="n")
        mass = bin_mass(placed, "v", [*by, *LAYOUT], F.col("start"), F.col("step"))
    else:
        spec = layout.select(F.struct(*LAYOUT)).scalar()
        placed = base.withColumn("s", spec).select("v", "s.*")
        mass = bin_mass(placed, "v", list(LAYOUT), F.col("start"), F.col("step"))
    return smooth(mass, by, points)


def mixed_pairs(df: DataFrame, number: str, category: str) -> DataFrame:
    """Quartiles, range and count of a number within each category."""
    kept = df.where(F.col(category).isNotNull() & F.col(number).isNotNull())
    return summary6(kept, number, [category]).drop("n_null")
