"""Cleaning and standardising observation tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions.expr import computed_once, ratio


def keep_present(df: DataFrame, *cols: str) -> DataFrame:
    """Rows with no null in the given columns; the test is pushed into the scan."""
    for c in cols:
        df = df.where(F.col(f"`{c}`").isNotNull())
    return df


def fill_missing(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Replace nulls by a constant per column."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def filter_then_scale(df: DataFrame, steps: Sequence[tuple[str, ...]]) -> DataFrame:
    """Run ``("keep", col)`` and ``("scale", out, col)`` steps in order.

    Each z-score uses the rows that survive the filters before it, so every
    column has its own reference population. All means and standard deviations
    come from one conditional aggregate, whatever the number of steps, and reach
    the rows as one scalar; no row is shuffled. A zero or undefined standard
    deviation gives null.
    """
    alive = F.lit(True)
    moments, scaled, kept = [], {}, []
    for kind, *args in steps:
        if kind == "keep":
            alive = alive & F.col(args[0]).isNotNull()
            kept.append(args[0])
        elif kind == "scale":
            out, src = args
            seen = F.when(alive, F.col(src))
            i = len(scaled)
            inverse = ratio(F.lit(1.0), F.stddev_samp(seen))
            moments += [F.avg(seen).alias(f"m{i}"), inverse.alias(f"w{i}")]
            scaled[out] = src
        else:
            raise ValueError(f"unknown step: {kind}")
    stats = df.agg(F.struct(*moments).alias("s")).scalar()
    rows = keep_present(df, *kept) if kept else df
    rows = rows.drop(*scaled).withColumn("_moments", stats)
    z = {
        out: (F.col(src) - F.col(f"_moments.m{i}")) * F.col(f"_moments.w{i}")
        for i, (out, src) in enumerate(scaled.items())
    }
    return rows.select(*[c for c in rows.columns if c != "_moments"], computed_once(z))


def zscore(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Add ``{out: source}`` z-scores over all rows."""
    return filter_then_scale(df, [("scale", out, src) for out, src in columns.items()])


def attach_attribute(
    df: DataFrame, attributes: DataFrame, on: str, required: str | None = None
) -> DataFrame:
    """Add per-key attributes; with ``required``, keep rows that got a value.

    A plain equi-join: small attributes are broadcast by their measured size, and
    a hot key of large ones is split by adaptive execution.
    """
    joined = df.join(attributes, on, "left")
    return keep_present(joined, required) if required else joined
