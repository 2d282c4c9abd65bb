"""Line deduplication by sharded minimal perfect hashing.

A line's key is the line without white space at its ends and with A-Z lower-cased, known by a 64-bit
hash. Keys of at least ten characters that occur in two documents or more are kept with the number
of the least document; a key's documents are pre-aggregated to their least and greatest id before
the shuffle, so a line that every document holds costs one row per task.

These keys are split into shards by hash. Each shard gets a minimal perfect hash function (levels of
bit arrays; keys that collide on one level go to the next) and, in its order, an array of fingerprints
(the full hash, so a line that is not a key is recognised) and one of the least documents. Lines probe
the arrays; they are never joined. While all arrays together are small, every task holds them
and texts are not shuffled; beyond ``ARRAY_BYTES`` the hashes of the lines go to the shards, in pieces
of about ``PROBE_ROWS`` hashes counted beforehand, so that a frequent line is no hot spot, and only the verdicts return.

Defined results: a null or empty text is one empty line. All lines of a key go except those in the
least document, where all stay. Rows with one id are one document for counting; rows without id are
never counted and keep their lines. Other columns stay, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import appended, free_names, stored
from quadrat.llm.words import mix

#: Keys shorter than this many characters stay wherever they are.
LEAST = 10
#: Keys per shard, about; shards are a power of two.
SHARD_KEYS = 200_000
#: All arrays up to this size go to every task.
ARRAY_BYTES = 96 << 20
#: Line hashes that one call of the shards gets, about.
PROBE_ROWS = 1_000_000
#: Stands for a missing id.
NO_ID = -(2**63)
_STRIP = b" \t\n\x0b\x0c\r"


class PerfectHash:
    """A minimal perfect hash of 64-bit keys: a number below ``n`` for each, by vectorised look-up."""

    def __init__(self, levels: list[tuple[int, np.ndarray, np.ndarray, int]]) -> None:
        self.levels = levels

    @staticmethod
    def build(keys: np.ndarray, room: float = 2.0) -> PerfectHash:
        """``keys`` are distinct. A level has ``room`` bits per key and settles those that are alone on a bit."""
        levels, placed, seed = [], 0, 0
        while len(keys):
            seed += 1
            bits = max(64, int(len(keys) * room) + 63 >> 6 << 6)
            at = _spot(keys, seed, bits)
            alone = np.bincount(at, minlength=bits) == 1
            ranks = np.concatenate([[0], np.cumsum(alone.reshape(-1, 64).sum(axis=1))[:-1]]).astype(np.int64)
            levels.append((bits, np.packbits(alone), ranks, placed))
            settled = alone[at]
            placed += int(settled.sum())
            keys = keys[~settled]
        return PerfectHash(levels)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; for others some number or -1."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for seed, (bits, packed, ranks, before) in enumerate(self.levels, 1):
            if not len(open_):
                break
            at = _spot(keys[open_], seed, bits)
            hit = (packed[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
            word = at[hit] >> 6
            bytes_ = packed.reshape(-1, 8)[word]
            inside = np.unpackbits(bytes_, axis=1) if len(word) else np.zeros((0, 64), np.uint8)
            below = np.arange(64)[None, :] < (at[hit] & 63)[:, None]
            out[open_[hit]] = before + ranks[word] + (inside * below).sum(axis=1)
            open_ = open_[~hit]
        return out


def _spot(keys: np.ndarray, seed: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bits)).astype(np.int64)


class Shard:
    """A perfect hash with its fingerprints and least documents."""

    def __init__(self, keys: np.ndarray, least: np.ndarray) -> None:
        self.hash = PerfectHash.build(keys)
        order = self.hash(keys)
        self.prints, self.least = np.empty_like(keys), np.empty_like(least)
        self.prints[order], self.least[order] = keys, least

    def probe(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are in the shard, and the least document of those that are."""
        at = self.hash(keys)
        found = at >= 0
        found[found] = self.prints[at[found]] == keys[found]
        return found, self.least[np.where(found, at, 0)] if len(self.least) else np.zeros(len(keys), np.int64)


def line_keys(text: str | None, least: int = LEAST) -> tuple[list[bytes], np.ndarray]:
    """The lines of a text and the hash of each line's key, 0 for keys too short to count."""
    lines = (text or "").encode().split(b"\n")
    out = np.zeros(len(lines), np.uint64)
    for i, line in enumerate(lines):
        key = line.strip(_STRIP).lower()
        if len(key) >= least and (len(key) >= 4 * least or len(key.decode(errors="replace")) >= least):
            out[i] = xxhash.xxh3_64_intdigest(key) or 1
    return lines, out


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        ids, keys = [], []
        for doc, text in zip(pdf["id"], pdf["text"], strict=True):
            k = line_keys(text)[1]
            k = np.unique(k[k != 0])
            keys.append(k)
            ids.append(np.full(len(k), doc, np.int64))
        if keys:
            yield pd.DataFrame({"key": np.concatenate(keys).view(np.int64), "id": np.concatenate(ids)})


def repeated_keys(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``least``: the line hashes found in two documents or more, with the least of them."""
    rows = df.where(F.col(f"`{doc_id}`").isNotNull()).select(
        F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")
    )
    keys = rows.mapInPandas(_hashes, "key long, id long")
    ends = keys.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("greatest"))
    return ends.where("least < greatest").select("key", "least")


def _verdict(lines: list[bytes], gone: np.ndarray) -> tuple[int, int, str, str]:
    kept = b"\n".join(line for line, g in zip(lines, gone, strict=True) if not g) if gone.any() else b"\n".join(lines)
    return len(lines), int(gone.sum()), kept.decode(), hashlib.sha256(kept).hexdigest()


def _verdicts(split, bounds, gone, keep_text):
    done = [_verdict(lines, gone[bounds[i] : bounds[i + 1]]) for i, (lines, _) in enumerate(split)]
    return [[d[k] for d in done] for k in ((0, 1, 2, 3) if keep_text else (0, 1, 3))]


def _bounds(split) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(k) for _, k in split], dtype=np.int64)])


def deduplicated(df: DataFrame, doc_id: str = "doc_id", text: str = "text", array_bytes: int = ARRAY_BYTES,
                 shard_keys: int = SHARD_KEYS, keep_text: bool = True, probe_rows: int = PROBE_ROWS) -> DataFrame:
    """Append ``n_lines``, ``n_dropped``, ``kept_text`` (unless not wanted) and ``kept_sha256``."""
    kept = df.columns
    if clash := {c.lower() for c in kept} & {"n_lines", "n_dropped", "kept_text", "kept_sha256"}:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    found = stored(repeated_keys(df, doc_id, text), "line-keys")
    n = found.count()
    shards = 1 << max(0, int(np.ceil(np.log2(max(1, n / shard_keys)))))
    sid, sdoc = free_names(kept, "row_id", "row_text")
    # rows without id come before all others and so lose nothing
    number = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(NO_ID))
    rows = df.select(*[F.col(f"`{c}`") for c in kept], number.alias(sid), F.col(f"`{text}`").alias(sdoc))
    if n * 24 <= array_bytes:
        return _probed_at_home(rows, found, shards, sid, sdoc, keep_text)
    return _probed_at_shards(rows, found, shards, sid, sdoc, keep_text, probe_rows)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    return (keys >> np.uint64(40)) & np.uint64(shards - 1)


def _schema(keep_text: bool) -> str:
    return f"n_lines long, n_dropped long, {'kept_text string, ' * keep_text}kept_sha256 string"


def _probed_at_home(rows, found, shards, sid, sdoc, keep_text):
    """All arrays, of proven size, travel to the tasks."""
    table = found.toArrow()
    keys = table["key"].to_numpy().view(np.uint64)
    least = table["least"].to_numpy()
    part = shard_of(keys, shards)
    sent = rows.sparkSession.sparkContext.broadcast([Shard(keys[part == s], least[part == s]) for s in range(shards)])

    def make(ids, texts):
        arrays = sent.value
        split = [line_keys(t) for t in texts.to_pylist()]
        bounds = _bounds(split)
        flat = np.concatenate([k for _, k in split])
        owner = np.repeat(ids.to_numpy(), np.diff(bounds))
        gone, part = np.zeros(len(flat), bool), shard_of(flat, len(arrays))
        for s, shard in enumerate(arrays):
            mine = np.flatnonzero((part == s) & (flat != 0))
            hit, first = shard.probe(flat[mine])
            gone[mine] = hit & (first < owner[mine])
        return _verdicts(split, bounds, gone, keep_text)

    return appended(rows, make, _schema(keep_text), [sid, sdoc], [sid, sdoc])


def dealt(rows, found, shards, sid, sdoc, probe_rows):
    """Line hashes (``key, id``) and arrays (``key, least``), both with ``shard`` and ``piece``.

    A shard has a piece for each ``probe_rows`` of its line hashes, and its arrays come once per piece.
    """
    texts = rows.where(F.col(sid) != NO_ID).select(F.col(sid).alias("id"), F.col(sdoc).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shards, np.int64)
        for pdf in _hashes(batches):
            total += np.bincount(shard_of(pdf["key"].to_numpy().view(np.uint64), shards).astype(np.int64), minlength=shards)
        yield pd.DataFrame({"shard": np.flatnonzero(total).astype(np.int32), "n": total[total > 0]})

    counts = texts.mapInPandas(count, "shard int, n long").groupBy("shard").agg(F.sum("n").alias("n"))
    pieces = stored(counts.select("shard", F.ceil(F.col("n") / F.lit(probe_rows)).cast("int").alias("pieces")), "line-pieces")
    shard = F.shiftrightunsigned("key", 40).bitwiseAND(F.lit(shards - 1)).cast("int")
    asked = texts.mapInPandas(_hashes, "key long, id long").withColumn("shard", shard).join(F.broadcast(pieces), "shard")
    asked = asked.withColumn("piece", F.pmod(F.xxhash64("key", "id"), F.col("pieces")).cast("int")).select("key", "id", "shard", "piece")
    arrays = found.select("key", "least", shard.alias("shard")).join(F.broadcast(pieces), "shard")
    arrays = arrays.select("key", "least", "shard", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    return asked, arrays


def _probed_at_shards(rows, found, shards, sid, sdoc, keep_text, probe_rows):
    """Line hashes go to the arrays; documents get back the hashes that they must drop."""
    asked, arrays = dealt(rows, found, shards, sid, sdoc, probe_rows)

    def probe(lines: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        if not len(lines) or not len(table):
            return pd.DataFrame({"id": np.empty(0, np.int64), "key": np.empty(0, np.int64)})
        s = Shard(table["key"].to_numpy().view(np.uint64), table["least"].to_numpy())
        hit, first = s.probe(lines["key"].to_numpy().view(np.uint64))
        gone = hit & (first < lines["id"].to_numpy())
        return pd.DataFrame({"id": lines["id"].to_numpy()[gone], "key": lines["key"].to_numpy()[gone]})

    drops = (
        asked.groupBy("shard", "piece").cogroup(arrays.groupBy("shard", "piece")).applyInPandas(probe, "id long, key long")
    )
    drops = drops.groupBy(F.col("id").alias("_id")).agg(F.collect_set("key").alias("_gone"))
    joined = rows.join(drops, F.col(sid) == F.col("_id"), "left").drop("_id")

    def make(texts, drop):
        split = [line_keys(t) for t in texts.to_pylist()]
        mask = [
            (k != 0) & np.isin(k.view(np.int64), d if d is not None else [])
            for (_, k), d in zip(split, drop.to_pylist(), strict=True)
        ]
        return _verdicts(split, _bounds(split), np.concatenate(mask), keep_text)

    return appended(joined, make, _schema(keep_text), [sdoc, "_gone"], [sid, sdoc, "_gone"])
