"""Sharding by best-fit-decreasing bin packing: equal texts stay together, shards come out equal in bytes.

Rows with equal texts form a group, known by size and hash. Only two kinds of items reach the packing,
each a bounded number whatever the input: large groups, of at least ``1 / grain`` of a shard, and
bundles of smaller groups, filled to about that much. Bundles are cut from the groups in order of size
by sums over ranges, never in one task. A group of more than a shard's mean is split into pieces of
at most that, since no packing could keep it whole; it is the only case in which equal texts part.

The items, in order of size, enter the bin with the least room that still takes them; the rooms are
kept in a balanced search tree. The capacity is the least one (by bisection) at which no more than
the given number of shards is needed, so all of them end near the mean.

Defined results: a null text counts as empty and shares its group. Repeated rows are rows of one
group. An empty table gives an empty result; fewer items than shards leave shards empty. Other
columns stay, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.llm.common import free_names, stored
from quadrat.llm.rooms import Rooms

#: Groups of a shard's mean divided by this are packed one by one, smaller ones in bundles of that size.
GRAIN = 500
#: Wanted number of rows per block when rows are numbered, and of groups per range when bundles are cut.
BLOCK_ROWS = 200_000


def pack(sizes: list[int], capacity: float, most: int) -> list[int] | None:
    """Best fit for sizes in descending order; the bin of each, or None if ``most`` bins don't do."""
    rooms, opened, out = Rooms(), 0, []
    for size in sizes:
        found = rooms.pop_least(size)
        if found is None:
            if opened == most or size > capacity:
                return None
            found = (capacity, opened)
            opened += 1
        room, b = found
        out.append(b)
        rooms.push(room - size, b)
    return out


def pack_evenly(sizes: list[int], shards: int, steps: int = 25) -> list[int]:
    """Pack into ``shards`` bins of the least capacity found by bisection (sizes in descending order)."""
    if not sizes:
        return []
    low = max(sum(sizes) / shards, sizes[0])
    high = low + sizes[0]
    while (best := pack(sizes, high, shards)) is None:
        high *= 1.1
    for _ in range(steps):
        middle = (low + high) / 2
        got = pack(sizes, middle, shards)
        if got is None:
            low = middle
        else:
            best, high = got, middle
    return best


def _numbered(rows: DataFrame, group: str, order: list, block_rows: int, out: str) -> DataFrame:
    """Gapless numbers from 0 within each value of ``group`` (few values), without a task per value."""
    n = rows.count()
    blocks = max(1, math.ceil(n / block_rows))
    block, first, at = free_names(rows.columns + [out], "block", "first", "at")
    rows = rows.withColumn(block, F.pmod(F.xxhash64(*order), F.lit(blocks)).cast("int"))
    counts = rows.groupBy(F.col(group).alias("_g"), F.col(block).alias("_b")).agg(F.count("*").alias("_n"))
    so_far = W.partitionBy("_g").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    firsts = counts.select("_g", "_b", F.coalesce(F.sum("_n").over(so_far), F.lit(0)).alias(first))
    rows = rows.withColumn(at, F.row_number().over(W.partitionBy(group, block).orderBy(*order)) - 1)
    joined = rows.join(firsts, (F.col(group) == F.col("_g")) & (F.col(block) == F.col("_b")), "inner")
    return joined.withColumn(out, (F.col(first) + F.col(at)).cast("long")).drop("_g", "_b", block, first, at)


def sharded(df: DataFrame, shards: int = 24, doc_id: str = "doc_id", text: str = "text", grain: int = GRAIN,
            block_rows: int = BLOCK_ROWS, size: str = "size", text_crc32: str = "text_crc32", shard: str = "shard",
            slot: str = "slot") -> DataFrame:
    """Append the row's size (UTF-8 bytes of the text plus 8), the text's crc32, its shard and its place there."""
    kept = df.columns
    if clash := {c.lower() for c in kept} & {x.lower() for x in (size, text_crc32, shard, slot)}:
        raise ValueError(f"columns exist already: {sorted(clash)}; choose other names")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    digest, piece, cut = free_names(kept + [size, text_crc32, shard, slot], "digest", "piece", "cut")
    rows = df.select(
        *[F.col(f"`{c}`") for c in kept],
        (F.octet_length(body) + 8).cast("long").alias(size),
        F.crc32(body.cast("binary")).alias(text_crc32),
        F.unhex(F.md5(body)).alias(digest),
    )
    total, largest = rows.agg(F.coalesce(F.sum(size), F.lit(0)), F.max(size)).first()
    if not total:
        return rows.select(*[F.col(f"`{c}`") for c in kept], size, text_crc32, F.lit(None).cast("int").alias(shard), F.lit(None).cast("long").alias(slot))
    mean = total / shards
    ids = F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))
    groups = rows.groupBy(F.col(digest).alias("_d"), F.col(size).alias("_size")).agg(F.count("*").alias("_rows"))
    # copies of one text beyond a shard's mean are dealt to pieces by hash
    pieces = F.ceil(F.col("_rows") * F.col("_size") / F.lit(mean)).cast("int")
    groups = stored(groups.select("*", F.greatest(pieces, F.lit(1)).alias("_cut")), "shard-groups")
    split = groups.where("_cut > 1").select("_d", "_cut")  # at most as many as shards
    rows = rows.join(F.broadcast(split), F.col(digest) == F.col("_d"), "left").drop("_d").withColumnRenamed("_cut", cut)
    rows = rows.withColumn(
        piece, F.when(F.col(cut).isNull(), 0).otherwise(F.pmod(F.xxhash64(ids), F.col(cut))).cast("int")
    ).drop(cut)
    whole = groups.where("_cut = 1").select("_d", F.lit(0).alias("_piece"), (F.col("_rows") * F.col("_size")).alias("_bytes"))
    parts = (
        rows.join(F.broadcast(split), F.col(digest) == F.col("_d"), "left_semi")
        .groupBy(F.col(digest).alias("_d"), F.col(piece).alias("_piece"))
        .agg(F.sum(size).alias("_bytes"))
    )
    items = whole.unionByName(parts)
    least = mean / grain
    large = items.where(F.col("_bytes") >= least).select(
        "*", F.concat_ws(":", F.lit("g"), F.hex("_d"), F.col("_piece").cast("string")).alias("_item")
    )
    small = _bundled(items.where(F.col("_bytes") < least), least, block_rows)
    packed = stored(large.unionByName(small.select("_d", "_piece", "_bytes", "_item")), "shard-items")
    totals = packed.groupBy("_item").agg(F.sum("_bytes").alias("_bytes")).collect()  # about 2 * shards * grain at most
    order = sorted(((r["_bytes"], r["_item"]) for r in totals), key=lambda x: (-x[0], x[1]))
    bins = pack_evenly([b for b, _ in order], shards)
    spark = df.sparkSession
    chosen = spark.createDataFrame([(i, b) for (_, i), b in zip(order, bins, strict=True)], "_item string, _shard int")
    placed = packed.join(F.broadcast(chosen), "_item").select("_d", "_piece", F.col("_shard").alias(shard))
    out = rows.join(
        placed, (F.col(digest) == F.col("_d")) & (F.col(piece) == F.col("_piece")), "inner"
    ).drop("_d", "_piece", piece)
    text_key = F.col(digest)
    out = _numbered(out, shard, [F.col(f"`{doc_id}`"), text_key], block_rows, slot)
    return out.select(*[F.col(f"`{c}`") for c in kept], size, text_crc32, shard, slot)


def _bundled(small: DataFrame, least: float, block_rows: int) -> DataFrame:
    """Cut small groups, by size and hash, into bundles of about ``least`` bytes.

    A range is one power of two of sizes and one share of the hashes; bundles are cut from the running sum
    inside a range, so that a range adds at most one bundle that is not full. The number of
    ranges follows the bytes, not the rows: at most one for every full bundle, and one per power.
    """
    power = F.floor(F.log2(F.col("_bytes").cast("double"))).cast("int")
    small = small.withColumn("_p", power)
    by_power = {r["_p"]: (r["n"], r["b"]) for r in small.groupBy("_p").agg(F.count("*").alias("n"), F.sum("_bytes").alias("b")).collect()}
    shares = {p: max(1, min(math.ceil(n / block_rows), int(b // (2 * least)))) for p, (n, b) in by_power.items()}
    if not shares:
        return small.select("_d", "_piece", "_bytes", F.lit("").alias("_item"))
    lookup = F.create_map(*[F.lit(x) for pair in sorted(shares.items()) for x in pair])
    small = small.withColumn("_r", F.pmod(F.xxhash64("_d"), F.element_at(lookup, F.col("_p"))).cast("int"))
    inside = W.partitionBy("_p", "_r").orderBy(F.col("_bytes").desc(), "_d").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_bytes").over(inside), F.lit(0))
    small = small.withColumn("_k", F.floor(before / F.lit(least)).cast("long"))
    return small.withColumn("_item", F.concat_ws(":", F.lit("b"), *[F.col(c).cast("string") for c in ("_p", "_r", "_k")]))
