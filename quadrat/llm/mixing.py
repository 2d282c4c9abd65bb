"""Mixing sources to target weights, cut exactly at each source's budget of words.

Every row gets a random key from a hash of its id; within each source rows are ordered by that key.
The order is never sorted as a whole: the leading hex digits of the key are a range of the order, so
rows are dealt by (source, range), summed within, and the sums of the ranges are summed up over each
source. A source's budget is spent in passes over that order: whole passes first, then rows until
the budget ends. The row at the end gives only its first words.

Targets: sources by code point, null last, weigh 3, 1, 2 and again; together they get ``share`` times
all words. None gets more than ``most`` times its own words; what is above goes to the others by
weight, which is one water level for all and is found from running sums over the sources.

Defined results: a null text has no words. Sources without words get target 0. Rows with equal ids
are ordered by the hash of their text; equal rows are alike, so it does not matter which comes first.
An empty table gives an empty result. Other columns stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.llm.common import WORD, free_names, stored

#: Weights of the sources in order, repeating (fixed values).
WEIGHTS = (3, 1, 2)
#: Wanted number of rows in one range of the order.
RANGE_ROWS = 100_000
#: Hex digits of the key that name a range, at most.
DIGITS = 6


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, source: str, size: str, weights=WEIGHTS, share=1.5, most=2.0) -> DataFrame:
    """``target`` per source from one row (source, words) each.

    The water level is the first one that fits, sources in order of ``most * words / weight``; later
    ones are lower, so it is the greatest that fits.
    """
    if share > most:
        raise ValueError("the sources cannot give that much")
    by_name = W.orderBy(F.col(source).asc_nulls_last())
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights))
    s = sizes.select("*", weight.alias("_weight"), (F.lit(float(most)) * F.col(size)).alias("_cap"))
    up = W.orderBy(F.col("_cap") / F.col("_weight"), F.col(source).asc_nulls_last())
    before = up.rowsBetween(W.unboundedPreceding, -1)
    after = up.rowsBetween(0, W.unboundedFollowing)
    total = F.sum(size).over(W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) * F.lit(float(share))
    level = (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_weight").over(after)
    s = s.select("*", level.alias("_level"))
    fits = F.when(F.col("_level") * F.col("_weight") <= F.col("_cap"), F.col("_level"))
    everywhere = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    water = F.max(fits).over(everywhere)
    s = s.select("*", water.alias("_water"))
    return s.select(
        source, size, F.least("_cap", F.coalesce(F.col("_water") * F.col("_weight"), F.col("_cap"))).alias("target")
    )


def with_taken(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: str = "mix",
               share: float = 1.5, most: float = 2.0, range_rows: int = RANGE_ROWS, size: str = "size",
               source_size: str = "source_size", target: str = "target", taken: str = "taken") -> DataFrame:
    """Append the row's words, its source's words and target, and the words that the mix takes of it."""
    kept = df.columns
    if clash := {c.lower() for c in kept} & {size.lower(), source_size.lower(), target.lower(), taken.lower()}:
        raise ValueError(f"columns exist already: {sorted(clash)}; choose other names")
    key, sub, rng, before, upto = free_names(kept + [size, source_size, target, taken], "key", "sub", "rng", "before", "upto")
    rows = df.select(
        *[F.col(f"`{c}`") for c in kept],
        n_words(F.col(f"`{text}`")).alias(size),
        F.md5(F.concat(F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit("")), F.lit(f":{seed}"))).alias(key),
        F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))).alias(sub),
    )
    small = rows.select(F.col(f"`{source}`").alias("s"), F.col(size).alias("n"))
    per_source = stored(small.groupBy("s").agg(F.sum("n").alias("words"), F.count("*").alias("rows")), "mix-sources")
    most_rows = per_source.agg(F.max("rows")).first()[0] or 0
    digits = next((d for d in range(1, DIGITS) if most_rows <= range_rows * 16**d), DIGITS)
    goals = targets(per_source.select("s", "words"), "s", "words", share=share, most=most).select(
        F.col("s").alias("_s"), F.col("words").alias(source_size), F.col("target").alias(target)
    )
    rows = rows.withColumn(rng, F.substring(key, 1, digits))
    sums = rows.groupBy(F.col(f"`{source}`").alias("_rs"), F.col(rng).alias("_r")).agg(F.sum(size).alias("_n"))
    so_far = W.partitionBy("_rs").orderBy("_r").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("_rs", "_r", F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias(before))
    offsets = stored(
        sums.join(goals, F.col("_rs").eqNullSafe(F.col("_s")), "inner").drop("_s"), "mix-ranges"
    )
    inside = W.partitionBy(F.col(f"`{source}`"), F.col(rng)).orderBy(key, sub).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn(upto, F.coalesce(F.sum(size).over(inside), F.lit(0)))
    rows = rows.join(offsets, F.col(f"`{source}`").eqNullSafe(F.col("_rs")) & (F.col(rng) == F.col("_r")), "inner")
    budget = F.floor(F.col(target)).cast("long")
    passes = F.when(F.col(source_size) > 0, F.floor(budget / F.col(source_size))).otherwise(0).cast("long")
    rest = budget - passes * F.col(source_size)
    last = F.least(F.greatest(rest - F.col(before) - F.col(upto), F.lit(0)), F.col(size))
    return rows.select(
        *[F.col(f"`{c}`") for c in kept], size, source_size, target, (passes * F.col(size) + last).cast("long").alias(taken)
    )


def mixed(df: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mix itself, in whole documents: a row comes once for each pass that takes words of it.

    A document at the end of a budget comes whole, so that no text is cut; rows of which nothing is
    taken go.
    """
    size, source_size, target, taken, copy = free_names(df.columns, "size", "source_size", "target", "taken", "copy")
    out = with_taken(df, doc_id, source, text, size=size, source_size=source_size, target=target, taken=taken, **options)
    times = F.when(F.col(taken) > 0, F.ceil(F.col(taken) / F.col(size))).otherwise(0).cast("int")
    out = out.where(F.col(taken) > 0).withColumn(copy, F.explode(F.array_repeat(F.lit(1), times)))
    return out.select(*[F.col(f"`{c}`") for c in df.columns])
