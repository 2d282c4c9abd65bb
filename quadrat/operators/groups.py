"""Attaching one row of values per group to all rows of the group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Groups whose values may be broadcast: one short row each.
FEW_GROUPS = 10_000


def few_groups(df: DataFrame, by: Sequence[str]) -> bool:
    """Whether the key columns have at most ``FEW_GROUPS`` distinct values.

    Runs a job that reads the key columns only and stops at the limit.
    """
    return df.select(*by).distinct().limit(FEW_GROUPS + 1).count() <= FEW_GROUPS


def _same_keys(by: Sequence[str]) -> Column:
    same = F.lit(True)
    for k in by:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return same


def _attach(rows: DataFrame, values: DataFrame, by: Sequence[str]) -> DataFrame:
    picked = [F.col(f"l.{c}").alias(c) for c in rows.columns]
    picked += [F.col(f"r.{c}").alias(c) for c in values.columns if c not in by]
    return rows.alias("l").join(values.alias("r"), _same_keys(by)).select(*picked)


def attach_group_values(
    rows: DataFrame, values: DataFrame, by: Sequence[str], few: bool, size: str | None = None
) -> DataFrame:
    """Inner join of rows with one row of values per group; null keys match.

    With few groups the values are broadcast and no row moves, so a hot group is
    no different. Otherwise both sides are hashed by group, the values being the
    build side: the optimizer cannot tell how much an ``explode`` multiplies rows
    and might broadcast the wrong side if left to choose.

    ``size`` names the column of ``values`` with the rows per group, for groups of
    unequal size. Groups above a share of 1 / ``FEW_GROUPS`` of all rows, of which
    there are fewer than ``FEW_GROUPS``, are then broadcast too, and only rows of
    the small groups are hashed.
    """
    if few:
        return _attach(rows, F.broadcast(values), by)
    if size is None:
        return _attach(rows, values.hint("shuffle_hash"), by)
    share = values.agg(F.sum(size) / FEW_GROUPS).scalar()
    hot, light = values.where(F.col(size) > share), values.where(F.col(size) <= share)
    cool = rows.alias("l").join(F.broadcast(hot.select(*by)).alias("r"), _same_keys(by), "left_anti")
    return _attach(rows, F.broadcast(hot), by).unionByName(
        _attach(cool, light.hint("shuffle_hash"), by)
    )
