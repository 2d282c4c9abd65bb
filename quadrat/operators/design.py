"""Design matrices from term lists.

A term is a list of (name, column) pairs, so terms add and interact as lists.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions.expr import computed_once
from quadrat.operators.prep import keep_present

Term = list[tuple[str, Column]]

INTERCEPT = "intercept"


def num(col: str) -> Term:
    return [(col, F.col(col).cast("double"))]


def squared(col: str) -> Term:
    c = F.col(col).cast("double")
    return [(f"{col}_sq", c * c)]


def dummies(col: str, levels: Sequence[str]) -> Term:
    """0/1 column per level after the first; null where the label is null or unknown."""
    known = F.col(col).isin(list(levels))
    return [
        (f"{col}_{v}", F.when(known, (F.col(col) == F.lit(v)).cast("double")))
        for v in levels[1:]
    ]


def interaction(a: Term, b: Term) -> Term:
    """Both terms and all their products."""
    return [*a, *b, *[(f"{n}:{m}", c * d) for n, c in a for m, d in b]]


def column_names(terms: Sequence[Term]) -> list[str]:
    """Names in order of first use; a repeated term counts once."""
    return list(dict.fromkeys(name for term in terms for name, _ in term))


def design(
    df: DataFrame, terms: Sequence[Term], response: str | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """``keep`` columns, the response as ``y`` and one column per term.

    A row with a null in the response or any term is dropped.
    """
    cols = {name: c for term in reversed(terms) for name, c in reversed(term)}
    names = column_names(terms)
    values = {n: cols[n] for n in names}
    if response:
        values = {"y": F.col(response), **values}
    return keep_present(df.select(*keep, computed_once(values)), *values)


def level_lists(df: DataFrame, cols: Sequence[str], max_levels: int = 1000) -> dict[str, list[str]]:
    """Sorted non-null labels of each column, for building dummies; one scan for all.

    Fails when a column has more than ``max_levels`` labels.
    """
    pairs = df.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("level")) for c in cols]))
    )
    found = pairs.where(F.col("level").isNotNull()).distinct().limit(len(cols) * max_levels + 1).collect()
    out = {c: sorted(r["level"] for r in found if r["name"] == c) for c in cols}
    for c, levels in out.items():
        if len(levels) > max_levels:
            raise ValueError(f"more than {max_levels} levels in {c}")
    return out


def level_list(df: DataFrame, col: str, max_levels: int = 1000) -> list[str]:
    """Sorted non-null labels of one column."""
    return level_lists(df, [col], max_levels)[col]
