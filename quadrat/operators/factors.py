"""Category codes, counts per code and most frequent values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.functions.expr import level_code
from quadrat.operators import groups
from quadrat.session import shared_path
from quadrat.sources.tables import save


#: Codes in one array value that rows are looked up in; more levels come to the rows by a join.
ARRAY_LEVELS = 1000


def factor_code(df: DataFrame, col: str, out: str, array_levels: int = ARRAY_LEVELS) -> DataFrame:
    """Code each label by its place in the sorted levels, from 1; null stays null. Any number of levels.

    Few levels are one small array, so rows are coded in place, unshuffled. More are ranked by ``dense_codes`` and
    joined: broadcast up to the bound of group values, else hashed, with the levels that have most rows apart.
    """
    codes = save(dense_codes(df, col), shared_path(df.sparkSession, "codes"))
    n = codes.count()
    if n <= array_levels:
        levels = codes.agg(F.array_sort(F.collect_list("level"))).scalar()
        return df.withColumn(out, F.array_position(levels, F.col(col)).cast("int"))
    known, missing = df.where(F.col(col).isNotNull()), df.where(F.col(col).isNull())
    sizes = known.groupBy(F.col(col).alias("level")).agg(F.count("*").alias("_n"))
    values = codes.join(sizes, "level").select(F.col("level").alias(col), F.col("code").cast("int").alias(out), "_n")
    if n > groups.FEW_GROUPS:
        values = save(values, shared_path(df.sparkSession, "codes"))
    coded = groups.attach_group_values(known, values, [col], n <= groups.FEW_GROUPS, size="_n")
    return coded.drop("_n").unionByName(missing.withColumn(out, F.lit(None).cast("int")))


def dense_codes(df: DataFrame, col: str) -> DataFrame:
    """Table of (level, code) for any number of levels.

    Distinct levels are dealt by sampled ranges, as many as the session's shuffle partitions, and written; each
    is ranked inside its range and shifted by the size of the ranges before it, so no task sees all levels.
    """
    levels = df.where(F.col(col).isNotNull()).select(F.col(col).alias("level")).distinct()
    placed = levels.repartitionByRange("level").withColumn("part", F.spark_partition_id())
    placed = save(placed, shared_path(df.sparkSession, "levels"))
    # one row per range
    sizes = placed.groupBy("part").agg(F.count("*").alias("c"))
    sizes = sizes.withColumn("before", F.sum("c").over(W.orderBy("part")) - F.col("c"))
    ranked = placed.withColumn("r", F.row_number().over(W.partitionBy("part").orderBy("level")))
    return ranked.join(sizes, "part").select("level", (F.col("before") + F.col("r")).alias("code"))


def tabulate(df: DataFrame, code: str, k: int, name: str = "n") -> DataFrame:
    """Rows per code 1..k, zero where a code never occurs."""
    counts = df.where(F.col(code).isNotNull()).groupBy(code).agg(F.count("*").alias(name))
    frame = df.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias(code))
    return frame.join(counts, code, "left").select(
        code, F.coalesce(name, F.lit(0).cast("long")).alias(name)
    )


def first_seen(df: DataFrame, value: str, order: str) -> DataFrame:
    """Distinct values, null included, with the first position of each."""
    return df.groupBy(value).agg(F.min(order).alias("first_at"))


def match_position(df: DataFrame, value: str, table: DataFrame, key: str, index: str) -> DataFrame:
    """Look up each value's index in a table; a null value finds a null key."""
    pos = table.select(F.col(key).alias("_key"), F.col(index))
    return df.join(pos, F.col(value).eqNullSafe(F.col("_key")), "left").drop("_key")


def which_max(df: DataFrame, value: str, order: str, out: str = "position") -> DataFrame:
    """First position of the maximum."""
    return df.where(F.col(value).isNotNull()).agg(
        F.max_by(F.col(order), F.struct(F.col(value), -F.col(order))).alias(out)
    )


def mode_first(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    order: str,
    na_rm: bool = False,
    out: str = "mode",
) -> DataFrame:
    """Most frequent value per key; the value seen first wins a tie.

    Null competes like any value unless ``na_rm``. Counts are pre-aggregated per
    (key, value), so a hot key moves one row per task and value.
    """
    rows = df.where(F.col(value).isNotNull()) if na_rm else df
    counted = rows.groupBy(*keys, value).agg(F.count("*").alias("_n"), F.min(order).alias("_at"))
    return counted.groupBy(*keys).agg(
        F.max_by(F.col(value), F.struct(F.col("_n"), -F.col("_at"))).alias(out)
    )


def explicit_code(df: DataFrame, col: str, levels: Sequence[str], out: str) -> DataFrame:
    """Code each label by its place in a given level order; other labels get null."""
    return df.withColumn(out, level_code(col, levels))
