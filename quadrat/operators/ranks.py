"""Average ranks of values within groups, and their normal scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.functions.expr import inverse_normal
from quadrat.session import shared_path
from quadrat.sources.tables import save

#: Rows that a task places at once, about.
PLACED = 500_000


def average_ranks(df: DataFrame, value: str, by: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """``by``, ``keep``, ``value``, ``c`` (equal rows), ``n`` (rows of the group) and ``rank`` from 1 in the group.

    Equal values share the mean of the places they take. Equal rows are counted in tasks before they move, then
    dealt by ranges of (group, value); ranks follow from a running count within a range plus the counts of the ranges
    before it; so neither a long group nor a frequent value is gathered. Nulls and NaN are left out. The dealt
    values are written to the shared folder, and their number says how many tasks place them.
    """
    by = list(by)
    x = F.col(value)
    kept = df.where(x.isNotNull() & ~F.isnan(x.cast("double")))
    counts = kept.groupBy(*by, *keep, value).agg(F.count("*").alias("c"))
    dealt = counts.repartitionByRange(*by, value).withColumn("p", F.spark_partition_id())
    dealt = save(dealt, shared_path(df.sparkSession, "ranks"))
    parts = dealt.groupBy(*by, "p").agg(F.sum("c").alias("t"))
    group = W.partitionBy(*by)
    parts = parts.select(
        *by, "p", (F.sum("t").over(group.orderBy("p")) - F.col("t")).alias("before"), F.sum("t").over(group).alias("n")
    )
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-dealt.count() // PLACED))
    dealt = dealt.repartition(tasks, *by, "p")
    part = W.partitionBy(*by, "p")
    placed = dealt.withColumn("upto", F.sum("c").over(part.orderBy(value)))
    placed = placed.withColumn("ties", F.sum("c").over(W.partitionBy(*by, "p", value)))
    same = F.col("l.p") == F.col("r.p")
    for k in by:
        same &= F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    joined = placed.alias("l").join(parts.alias("r"), same)
    rank = F.col("before") + F.col("upto") - F.col("ties") + (F.col("ties") + 1) / 2
    return joined.select(*[F.col(f"l.{k}").alias(k) for k in [*by, *keep, value, "c"]], "n", rank.alias("rank"))


def normal_score(rank: Column, n: Column) -> Column:
    """The normal quantile at a rank, with Blom's offsets (3/8 and 1/4)."""
    return inverse_normal((rank - 0.375) / (n + 0.25))
