"""Benchmark decontamination by spaced seeds, in DataFrame operations alone.

A text is contaminated by a benchmark item if a window of consecutive words of the item stands in the
text with few words substituted. How long the window is, and how many of its words may differ, depends
on the item's length (``TIERS``): 12 words with 2 substitutions for items of 12 words or more,
8 words with 1 from 8 words on, 5 words with none from 5 words on. Shorter items match nothing.

For each tier a fixed mask takes some positions and ignores the others. Its ones are so spaced that its
shifts within a window never share a position, and there is one shift more than substitutions
allowed: whatever words are substituted, one shift sees none of them. So joining the mask's
hash at every position of the items with the hash at every position of the texts finds every such window.
Around each hit the windows that hold the mask are compared word by word.

Seeds of the items go to every task, in as many portions as a stated bound on their number asks for;
texts are not shuffled. What leaves a task is one row per hit.

Defined results: words are compared with A-Z lower-cased. Null and empty texts and items match nothing.
Equal items are reported each. Rows with one id are reported together. Other columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import BROADCAST_ROWS, SPACE, free_names, stored

#: Seeds sent to every task at a time; each carries up to ``2 * window`` words of 8 bytes.
SEEDS = 200_000
#: Words of a text that a row carries.
PIECE = 256
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Tier:
    """Items of at least ``window`` words (and too few for the tier above) and how they may differ."""

    window: int
    substitutions: int
    mask: str

    @property
    def ones(self) -> list[int]:
        return [k for k, c in enumerate(self.mask) if c == "1"]

    @property
    def shifts(self) -> int:
        return self.window - len(self.mask) + 1


TIERS = (Tier(12, 2, "1001001001"), Tier(8, 1, "1010101"), Tier(5, 0, "11111"))


def word_hashes(text: Column) -> Column:
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    return F.transform(F.filter(F.split(plain, SPACE), lambda w: w != ""), lambda w: F.xxhash64(w))


def _seed(hashes: str, at: str, tier: Tier) -> Column:
    """The mask's hash at a position."""
    return F.xxhash64(F.lit(tier.window), *[F.get(hashes, F.col(at) + k) for k in tier.ones])


def _item_seeds(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """``seed, item, window, at, il, iw`` (position in the item, number of its words, words around) for all items."""
    items = benchmark.select(F.col(f"`{item_id}`").alias("item"), word_hashes(F.col(f"`{text}`")).alias("h"))
    items = items.withColumn("il", F.size("h"))
    out, below = None, None
    for tier in TIERS:
        some = items.where((F.col("il") >= tier.window) & (F.col("il") < below if below else F.lit(True)))
        below = tier.window
        seeds = some.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("il") - len(tier.mask))))
        around = F.array(*[F.get("h", F.col("at") + k) for k in range(1 - tier.shifts, tier.window)])
        seeds = seeds.select(_seed("h", "at", tier).alias("seed"), "item", F.lit(tier.window).alias("window"), "at", "il", around.alias("iw"))
        out = seeds if out is None else out.unionByName(seeds)
    return out


def _positions(texts: DataFrame, names: list[str]) -> DataFrame:
    """``_pos`` of every word in its piece ``_h`` of the text, which begins at word ``_base``, and ``seed`` per tier.

    Pieces overlap by what a window needs, so each row carries a bounded number of words however long the text is.
    """
    lead, tail = max(t.shifts for t in TIERS) - 1, max(t.window for t in TIERS)
    starts = F.sequence(F.lit(0), F.greatest(F.size("_h") - 1, F.lit(0)), F.lit(PIECE))

    def piece(s: Column) -> Column:
        base = F.greatest(s - lead, F.lit(0))
        return F.struct(base.alias("base"), (s - base).alias("own"), F.slice("_h", base + 1, s - base + PIECE + tail).alias("h"))

    # the outer form spares Spark from computing the pieces twice, once to see whether there are any
    pieces = texts.select(*names, F.explode_outer(F.transform(starts, piece)).alias("_p"))
    pieces = pieces.select(*names, F.col("_p.base").alias("_base"), F.col("_p.own").alias("_own"), F.col("_p.h").alias("_h"))
    rows = pieces.select(*names, "_base", "_own", "_h", F.posexplode("_h").alias("_pos", "_w"))
    rows = rows.where((F.col("_pos") >= F.col("_own")) & (F.col("_pos") < F.col("_own") + PIECE))
    return rows.select(*names, "_base", "_h", "_pos", F.explode(F.array(*[_seed("_h", "_pos", t) for t in TIERS])).alias("seed"))


def hits(df: DataFrame, benchmark: DataFrame, key: list[str], text: str = "text", item_id: str = "item_id",
         item_text: str = "text", seeds_at_once: int = SEEDS) -> DataFrame:
    """``key``, the item, the window's first word in the text, and how many of its words are equal.

    One row per window that qualifies and seed that found it.
    """
    names = [f"_k{i}" for i in range(len(key))]
    texts = df.select(*[F.col(f"`{k}`").alias(n) for k, n in zip(key, names, strict=True)], word_hashes(F.col(f"`{text}`")).alias("_h"))
    seeds = _item_seeds(benchmark, item_id, item_text)
    portions = -(-seeds.count() // seeds_at_once) or 1
    out = None
    for p in range(portions):
        part = seeds if portions == 1 else seeds.where(F.pmod(F.xxhash64("seed"), F.lit(portions)) == p)
        found = _matches(_positions(texts, names), part, names)
        out = found if out is None else out.unionByName(found)
    return out.withColumnsRenamed(dict(zip(names, key, strict=True)))


def _matches(positions: DataFrame, seeds: DataFrame, names: list[str]) -> DataFrame:
    met = positions.join(F.broadcast(seeds), "seed")
    windows = None
    for tier in TIERS:
        lead, some = tier.shifts - 1, []
        equal = [
            F.coalesce((F.get("_h", F.col("_pos") + k) == F.get("iw", F.lit(k + lead))).cast("int"), F.lit(0))
            for k in range(-lead, tier.window)
        ]
        for s in range(tier.shifts):
            start = F.col("_pos") - s
            inside = (F.col("at") - s >= 0) & (F.col("at") - s + tier.window <= F.col("il"))
            inside = inside & (start >= 0) & (start + tier.window <= F.size("_h"))
            total = sum(equal[lead - s : lead - s + tier.window], F.lit(0))
            enough = total >= tier.window - tier.substitutions
            some.append(F.struct(F.when(inside & enough, total).alias("equal"), (F.col("_base") + start).alias("first")))
        hit = F.col("window") == tier.window
        windows = F.when(hit, F.array(*some)) if windows is None else windows.when(hit, F.array(*some))
    met = met.select(*names, "item", "window", F.explode_outer(windows).alias("w")).where("w.equal is not null")
    return met.select(*names, "item", F.col("w.first").alias("first"), "window", F.col("w.equal").alias("equal"))


def overlaps(df: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
             item_text: str = "text", **options) -> DataFrame:
    """One row per document and item that contaminates it.

    ``windows`` counts the qualifying windows, ``best_equal`` is the most equal words in one of
    ``window_words``, ``first_word`` and ``last_word`` enclose all of them in the text.
    """
    found = hits(df, benchmark, [doc_id], text, item_id, item_text, **options)
    each = found.groupBy(F.col(f"`{doc_id}`"), F.col("item").alias(item_id), "window", "first").agg(F.max("equal").alias("equal"))
    return each.groupBy(doc_id, item_id).agg(
        F.count("*").alias("windows"), F.max("equal").alias("best_equal"), F.max("window").alias("window_words"),
        F.min("first").alias("first_word"), F.max(F.col("first") + F.col("window") - 1).alias("last_word"),
    )


def decontaminated(df: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                   item_text: str = "text", **options) -> DataFrame:
    """The rows whose text no item contaminates. Texts are known by two hashes, so ids don't matter.

    The hashes of contaminated texts are written first and broadcast while there are at most ``BROADCAST_ROWS``, so that no
    text is shuffled; beyond, both sides are.
    """
    one, two = free_names(df.columns, "hash_one", "hash_two")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    keyed = df.withColumns({one: F.xxhash64(body), two: F.crc32(body.cast("binary"))})
    found = hits(keyed, benchmark, [one, two], text, item_id, item_text, **options)
    gone = stored(found.select(one, two).distinct(), "contaminated")
    if gone.count() <= BROADCAST_ROWS:
        gone = F.broadcast(gone)
    return keyed.join(gone, [one, two], "left_anti").drop(one, two)
