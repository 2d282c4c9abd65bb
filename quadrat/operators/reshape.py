"""Stacking tables and turning wide ones long."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions.expr import missing_double


def to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str, value: str) -> DataFrame:
    """One row per id and column."""
    return df.unpivot(list(ids), list(cols), name, value)


def stack_tagged(blocks: Mapping[str, DataFrame], tag: str = "source") -> DataFrame:
    """UNION ALL of the blocks, each marked with its name."""
    out = None
    for name, block in blocks.items():
        marked = block.withColumn(tag, F.lit(name))
        out = marked if out is None else out.unionByName(marked)
    return out


def transpose_counts(df: DataFrame, by: str, category: str, k: int) -> DataFrame:
    """One row per ``by`` with a count column ``c1``..``ck`` per category.

    In the long form, draws by rows and rows by draws differ only in ``by``.
    """
    return df.groupBy(by).agg(
        *[F.count_if(F.col(category) == i).alias(f"c{i}") for i in range(1, k + 1)]
    )


def comparison_long(
    counts: DataFrame, ids: Sequence[str], observed: str, predicted: str, lower: str, upper: str
) -> DataFrame:
    """Turn each row into one per source: "observed" without bounds, "posterior" with them."""
    def entry(source: str, count: str, lo: Column, hi: Column) -> Column:
        return F.struct(
            F.lit(source).alias("source"), F.col(count).alias("count"), lo.alias("lower"), hi.alias("upper")
        )

    both = F.array(
        entry("observed", observed, missing_double(), missing_double()),
        entry("posterior", predicted, F.col(lower).cast("double"), F.col(upper).cast("double")),
    )
    return counts.select(*ids, F.inline(both)).select("source", *ids, "count", "lower", "upper")
