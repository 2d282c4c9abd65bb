"""Exact deduplication by a content sort.

Texts are normalised (every run of white space becomes one space) and their bytes put in order: rows are
range-partitioned by sampled splitters, each partition is sorted on disk where memory does not suffice, and
equal texts come to stand next to each other. A window over the whole normalised text then compares each row
with the one before it, byte by byte, and hands the smallest identifier of every run of equals to its rows.

The order is (first ``HEAD`` characters, 64-bit hash, whole text). The splitters hold heads and hashes only, so
the sample that Spark takes in the driver is small however long the texts are, and texts that begin alike are
spread by their hashes; hashes decide places only, never equality.

Copies of one text above ``PIECE_ROWS`` rows (at most ``MOST_HOT`` texts, the most frequent ones) are split into
pieces by a hash of the identifier, which is part of the order. Each piece is sorted like any other run; the first
rows of all pieces of a text, one per piece, are then compared and merged, and the few results are broadcast. A
text that is not among them has at most one ``MOST_HOT``-th of all rows.

Defined results: a null text counts as empty; empty texts are equal. Identifiers are compared as they are; a
missing one comes after all others, so ``keep_id`` is null only where no copy has one. Of repeated rows with the
smallest identifier exactly one is kept. An empty table gives an empty table. All columns stay; if one of the
four new names is taken, the new column gets an underscore in front.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quadrat.llm.common import SPACE, free_names

#: Leading characters by which ranges are cut before the hash decides.
HEAD = 32
#: Copies of a text that are sorted in one piece, about.
PIECE_ROWS = 1000
#: Texts whose copies are split, at most.
MOST_HOT = 10_000
#: Pieces of all split texts together, about.
MOST_PIECES = 100_000

OUT = ("keep_id", "group_size", "kept", "text_sha256")


def _column(name: str):
    return F.col(f"`{name}`")


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", piece_rows: int = PIECE_ROWS) -> DataFrame:
    """Append ``keep_id``, ``group_size``, ``kept`` and ``text_sha256`` (of the normalised text)."""
    names = docs.columns
    keep, size, kept, sha, norm, digest, head, piece, place = free_names(
        names, *OUT, "norm", "digest", "head", "piece", "place"
    )
    rows = docs.select(*map(_column, names), F.regexp_replace(F.coalesce(_column(text), F.lit("")), SPACE, " ").alias(norm))
    rows = rows.select("*", F.xxhash64(norm).alias(digest))
    hot = _hot(rows, digest, piece_rows)
    if hot is None:
        rows = rows.withColumn(piece, F.lit(0))
    else:
        hot = F.broadcast(hot.toDF(digest, "pieces"))
        rows = rows.join(hot, digest, "left")
        part = F.when(F.col("pieces").isNull(), 0).otherwise(F.pmod(F.xxhash64(_column(doc_id)), F.col("pieces")) + 1)
        rows = rows.select(*map(_column, names), norm, digest, part.cast("int").alias(piece))

    def sorted_runs(some: DataFrame) -> DataFrame:
        """Every row with the first identifier and the length of its run of equals, and its place there."""
        dealt = some.withColumn(head, F.substring(norm, 1, HEAD)).repartitionByRange(head, digest, piece)
        run = Window.partitionBy(head, digest, piece, norm).orderBy(_column(doc_id).asc_nulls_last())
        whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return dealt.select(
            "*",
            F.first(_column(doc_id)).over(whole).alias(keep),
            F.count(F.lit(1)).over(whole).alias(size),
            F.row_number().over(run).alias(place),
        )

    out = sorted_runs(rows).withColumn(sha, F.sha2(norm, 256))
    first = F.col(place) == 1
    if hot is not None:
        ends = sorted_runs(rows.where(F.col(piece) > 0).select(_column(doc_id), norm, digest, piece)).where(first)
        lead = F.struct(F.col(keep).isNull(), keep, piece)
        merged = ends.groupBy(digest, norm).agg(F.min(lead).alias("lead"), F.sum(size).alias("total"))
        merged = merged.select(F.sha2(norm, 256).alias(sha), "lead", "total")
        out = out.drop(norm).join(F.broadcast(merged), sha, "left")
        first &= F.coalesce(F.col("lead")[piece] == F.col(piece), F.lit(True))
        out = out.withColumns(
            {
                kept: first,
                keep: F.when(F.col("lead").isNull(), F.col(keep)).otherwise(F.col("lead")[keep]),
                size: F.coalesce("total", size),
            }
        )
    else:
        out = out.withColumn(kept, first)
    return out.select(*map(_column, names), keep, size, kept, sha)


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with their columns."""
    out = judged(docs, doc_id, text)
    return out.where(F.col(out.columns[-2])).select(*map(_column, docs.columns))


def _hot(rows: DataFrame, digest: str, piece_rows: int) -> DataFrame | None:
    """The most frequent hashes above ``piece_rows`` rows, with their numbers of pieces."""
    counts = rows.groupBy(digest).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > piece_rows)
    found = counts.orderBy(F.desc("n"), digest).limit(MOST_HOT).collect()
    if not found:
        return None
    share = max(piece_rows, -(-sum(r.n for r in found) // MOST_PIECES))
    return rows.sparkSession.createDataFrame([(r[0], -(-r.n // share)) for r in found], "digest long, pieces int")
