"""Jaccard join of texts on word shingles, and the groups of near-duplicates it makes.

Two texts link when the sets of their shingles overlap in at least ``similarity`` of their union. Equal
sets are one *class*; the join works on classes.

Candidates. Shingles are ordered: frequent ones last, else by hash. The first
``n - ceil(similarity * n) + 1 + extra(n)`` shingles of a set are its keys. Two sets that link overlap in at least
``similarity`` of the larger one, so of the set whose keys end first all but ``n - keys`` shingles of the overlap are keys
of both: they share at least ``1 + extra`` keys. Classes meet under shared keys, and a class that shares fewer
than that with all others together links with none; without these classes more keys have one class only,
and so on. That leaves out nearly all that share a phrase by chance. Of the keys that are left, put in order of the
number of classes under them, a class needs all but its last ``extra``, since two sets that share more than those
also share one before them; so the most frequent keys are hardly used. The
frequent shingles are found by counting within chunks; the list is no more than a hint about the order,
which may be any order as long as it is one, so its length may be bounded.

Checking. Every class that is left has a bitmap on which its shingles are hashed. For a pair, the
number of bits that differ bounds the overlap from above; pairs whose bound is too low, or whose
sizes alone forbid a link, go. The exact overlap of the rest comes from their sorted arrays.

Skew. The classes under one shingle are not paired with each other. First each is checked against the
least and the greatest of them only, which joins up a large group of copies in as many checks as it
has members. Then, where a shingle still has classes of several components, these are cut into
tiles of bounded size, and bitmaps are compared between components within a size band. The tiles get the sorted
arrays of the classes that have a partner by their bitmaps, compare them where no link connects them yet, and return a
spanning forest of the links. So every pair that shares a shingle is in
one component already or has been compared, no link is lost, and no step makes more pairs than the
tiles have members. Before that, in ``turns``, each class names one other per tile, the nearest at first, and components are joined
up, so that fewer arrays go to the tiles.

Defined results: a null or empty text, or one without words, has no shingles and links with
nothing. A text of fewer words than a shingle has one, made of all its words. Equal texts link. Rows
without id belong to their group but do not name it. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.llm.common import BROADCAST_ROWS, free_names, freed, stored
from quadrat.llm.graph import components
from quadrat.llm.words import mix, shingle_sets, signed, word_hashes

#: A shingle counts as frequent from so many texts in a chunk, and so many in all these chunks.
CHUNK_TEXTS, CHUNK_OFTEN, OFTEN = 2048, 4, 32
#: So many frequent shingles are put last at most (8 bytes each go to every task).
MOST_FREQUENT = 1_000_000
#: Classes per tile.
TILE = 2048
#: Turns in which a class names one other per tile, before the tiles settle what remains: they spare arrays, but cost bitmaps.
TURNS = 1
#: One more key for so many shingles, by which a link needs more than one shared key.
EXTRA = 16
#: Another look for classes with too few shared keys, if the last one left no more than this share.
SHRUNK, LOOKS = 0.8, 3
#: Rows compared in one call, and bytes of sorted arrays, about; a single tile may have more.
BATCH_ROWS, BATCH_BYTES = 20_000, 16 << 20
#: Bits of the filter that spares texts from being read into sets (sent to every task).
FILTER_BITS = 1 << 22
#: Texts turned into sets at a time.
_SLICE = 256


@dataclass(frozen=True)
class Rule:
    """What a link is: ``100 * overlap >= percent * union`` on shingles of ``width`` words."""

    width: int = 5
    percent: int = 80

    def prefix(self, n: int) -> int:
        """Keys of a set of ``n`` shingles."""
        return n - -(-self.percent * n // 100) + 1 + n // EXTRA

    def shared(self, n: int) -> int:
        """Keys that such a set shares with any that it links with, which has ``percent`` of its size at least."""
        return 1 + -(-self.percent * n // 100) // EXTRA

    def sizes_fit(self, a, b):
        return 100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)

    def links(self, overlap, a, b):
        return 100 * overlap >= self.percent * (a + b - overlap)


def class_id(shingles: np.ndarray) -> int:
    """A 64-bit digest of a set."""
    with np.errstate(over="ignore"):
        return int(signed(mix(np.array([mix(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum() + np.uint64(len(shingles))])))[0])


def bitmap(shingles: np.ndarray) -> bytes:
    """Shingles hashed on bits, six for each shingle at least, in whole powers of two."""
    width = 1 << max(6, math.ceil(math.log2(6 * len(shingles) + 1)))
    bits = np.zeros(width, np.uint8)
    bits[(shingles >> np.uint64(20)) & np.uint64(width - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: bytes, width: int) -> np.ndarray:
    """A bitmap on fewer bits, as 64-bit numbers."""
    x = np.frombuffer(bits, np.uint64)
    while len(x) * 64 > width:
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    return x


def most_overlap(a: int, b: int, bits_a: bytes, bits_b: bytes) -> int:
    """No two sets of these sizes and bitmaps overlap in more."""
    width = 8 * min(len(bits_a), len(bits_b))
    differ = int(np.bitwise_count(folded(bits_a, width) ^ folded(bits_b, width)).sum())
    return (a + b - differ) // 2


def _sets(texts, rule: Rule) -> list[np.ndarray]:
    out = []
    for k in range(0, len(texts), _SLICE):
        out += shingle_sets(*word_hashes(texts.slice(k, _SLICE)), rule.width)
    return out


def _batch(columns: dict, types: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, types[k], from_pandas=True) for k, v in columns.items()], list(columns))


def _classes(docs: DataFrame, rule: Rule) -> DataFrame:
    """``id, n, cls`` per text, and with null ``n`` the often seen shingles of chunks as ``cls, times``."""
    kinds = {"id": pa.int64(), "n": pa.int32(), "cls": pa.int64(), "times": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]):
        seen: dict[int, np.ndarray] = {}
        for batch in batches:
            sets = _sets(batch.column(1), rule)
            ids = [class_id(s) if len(s) else 0 for s in sets]
            yield _batch({"id": batch.column(0), "n": [len(s) for s in sets], "cls": ids, "times": [None] * len(ids)}, kinds)
            for cls, s in zip(ids, sets, strict=True):
                if len(s):
                    seen[cls] = s
                if len(seen) >= CHUNK_TEXTS:
                    yield often(seen)
                    seen = {}
        if seen:
            yield often(seen)

    def often(seen):
        key, times = np.unique(np.concatenate(list(seen.values())), return_counts=True)
        key, times = key[times >= CHUNK_OFTEN], times[times >= CHUNK_OFTEN]
        none = [None] * len(key)
        return _batch({"id": none, "n": none, "cls": signed(key), "times": times}, kinds)

    return docs.mapInArrow(run, "id long, n int, cls long, times int")


def _prefixes(docs: DataFrame, rule: Rule, frequent) -> DataFrame:
    """``key, cls, need``: the classes under their keys, with the keys that each must share."""
    kinds = {"key": pa.int64(), "cls": pa.int64(), "need": pa.int32()}

    def run(batches):
        last, seen = frequent.value, set()
        for batch in batches:
            keys, ids, need = [], [], []
            for s in _sets(batch.column(1), rule):
                cls = class_id(s) if len(s) else None
                if cls is None or cls in seen:
                    continue
                seen.add(cls)
                p = rule.prefix(len(s))
                need.append(rule.shared(len(s)))
                if len(last):
                    at = np.searchsorted(last, s)
                    often = last[np.minimum(at, len(last) - 1)] == s
                    s = np.concatenate([s[~often][:p], s[often][:p]])
                keys.append(s[:p])
                ids.append(cls)
            if ids:
                size = [len(k) for k in keys]
                owner, need = np.repeat(np.array(ids, np.int64), size), np.repeat(np.array(need, np.int32), size)
                yield _batch({"key": signed(np.concatenate(keys)), "cls": owner, "need": need}, kinds)

    return docs.mapInArrow(run, "key long, cls long, need int")


def _met(rows: DataFrame) -> DataFrame:
    """The rows under keys of several classes, each once, with the least and the greatest class there."""
    by_key = W.partitionBy("key")
    ends = rows.select("key", "cls", "need", F.min("cls").over(by_key).alias("lo"), F.max("cls").over(by_key).alias("hi"))
    return ends.where("lo < hi").distinct()


def _meetings(prefixes: DataFrame) -> DataFrame:
    """``key, cls, lo, hi`` without the classes that share too few keys to link with any other."""
    meets = stored(_met(prefixes), "jaccard-meets")
    size = meets.count()
    for _ in range(LOOKS):
        few = meets.groupBy("cls").agg(F.count("*").alias("k"), F.max("need").alias("need")).where("k >= need").select("cls")
        left = stored(_met(meets.select("key", "cls", "need").join(few, "cls", "left_semi")), "jaccard-meets")
        freed(meets)
        meets, before, size = left, size, left.count()
        if size > SHRUNK * before:
            break
    # a link shares `need` keys at least, so a class can do without its `need - 1` most frequent ones
    placed = meets.select("key", "cls", "need", F.count("*").over(W.partitionBy("key")).alias("g"))
    own = W.partitionBy("cls")
    placed = placed.withColumn("at", F.row_number().over(own.orderBy("g", "key"))).withColumn("k", F.count("*").over(own))
    left = stored(_met(placed.where("at <= k - need + 1").select("key", "cls", "need")), "jaccard-meets")
    freed(meets)
    return left


def _of_classes(docs: DataFrame, rule: Rule, wanted: DataFrame, make, schema: str) -> DataFrame:
    """``cls`` and what ``make`` tells of the set, one row for each of the wanted classes.

    ``wanted`` has ``cls`` and the ``id`` of a text that has it; only texts whose ids may be among these are read into
    sets. Texts without id are read in any case.
    """
    spots = wanted.where("id is not null").select(F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).cast("int").alias("s"))
    mask = np.zeros(FILTER_BITS, bool)
    mask[spots.distinct().toArrow()["s"].to_numpy()] = True
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(mask))
    spot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).cast("int")
    placed = docs.select(F.when(F.col("id").isNotNull(), spot).alias("spot"), "text")
    names = schema.replace(",", "").split()[::2]
    kinds = dict(zip(names, [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[t] for t in schema.replace(",", "").split()[1::2]], strict=True))

    def run(batches):
        open_, seen = np.unpackbits(sent.value), set()
        for batch in batches:
            at = batch.column(0).fill_null(-1).to_numpy()
            texts = batch.column(1).filter(pa.array((at < 0) | (open_[at] > 0)))
            for k in range(0, len(texts), _SLICE):
                rows = []
                for s in shingle_sets(*word_hashes(texts.slice(k, _SLICE)), rule.width):
                    cls = class_id(s) if len(s) else None
                    if cls is not None and cls not in seen:
                        seen.add(cls)
                        rows.append((cls, *make(s)))
                if rows:
                    yield _batch(dict(zip(names, zip(*rows, strict=True), strict=True)), kinds)

    found = placed.mapInArrow(run, schema)
    # several tasks may have made a class, and the filter lets others through
    return found.join(wanted.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])


def _sets_of(docs: DataFrame, rule: Rule, wanted: DataFrame) -> DataFrame:
    """``cls, items``: the sorted arrays of the wanted classes."""
    return _of_classes(docs, rule, wanted, lambda s: (s.tobytes(),), "cls long, items binary")


def _marks_of(docs: DataFrame, rule: Rule, wanted: DataFrame) -> DataFrame:
    """``cls, n, bits``: sizes and bitmaps of the wanted classes."""
    return _of_classes(docs, rule, wanted, lambda s: (len(s), bitmap(s)), "cls long, n int, bits binary")


def _sides(table: DataFrame, name: str) -> DataFrame:
    return table.withColumnsRenamed({c: name if c == "cls" else f"{c}_{name}" for c in table.columns})


def _close(pairs: DataFrame, marks: DataFrame, rule: Rule) -> DataFrame:
    """The pairs ``a, b`` that may link by their sizes, then by their bitmaps."""
    sizes = marks.select("cls", "n")
    near = pairs.join(_sides(sizes, "a"), "a").join(_sides(sizes, "b"), "b")
    near = near.where(100 * F.least("n_a", "n_b") >= rule.percent * F.greatest("n_a", "n_b")).select("a", "b")
    near = near.join(_sides(marks, "a"), "a").join(_sides(marks, "b"), "b")

    def run(batches):
        for pdf in batches:
            ok = [
                bool(rule.links(most_overlap(na, nb, x, y), na, nb))
                for na, nb, x, y in zip(pdf["n_a"], pdf["n_b"], pdf["bits_a"], pdf["bits_b"], strict=True)
            ]
            yield pdf.loc[ok, ["a", "b"]]

    return near.mapInPandas(run, "a long, b long")


def _linked(docs: DataFrame, close: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """The pairs ``a, b`` whose exact overlap makes a link; only their texts are read into sets."""
    close = stored(close, "jaccard-close")
    wanted = texts.join(close.select(F.explode(F.array("a", "b")).alias("cls")).distinct(), "cls", "left_semi")
    sets = stored(_sets_of(docs, rule, wanted), "jaccard-sets")

    def run(batches):
        for pdf in batches:
            ok = []
            for x, y in zip(pdf["items_a"], pdf["items_b"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                ok.append(bool(rule.links(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
            yield pdf.loc[ok, ["a", "b"]]

    full = close.join(_sides(sets, "a"), "a").join(_sides(sets, "b"), "b")
    links = stored(full.mapInPandas(run, "a long, b long"), "jaccard-links")
    freed(close, sets)
    return links


def _tiles(meets: DataFrame, found: DataFrame, tile: int) -> DataFrame:
    """``key, i, j, cut, cls, component``: the members of all tiles whose shingle has classes of several components.

    Of up to three classes under a shingle all pairs have been checked before.
    """
    parts = found.select(F.col("node").alias("cls"), "component")
    by_key = W.partitionBy("key")
    rows = meets.withColumn("g", F.count("*").over(by_key)).where("g > 3")
    rows = rows.join(parts, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    rows = rows.select(
        "key", "cls", "component", "g", F.min("component").over(by_key).alias("lo"), F.max("component").over(by_key).alias("hi")
    ).where("lo < hi")
    cuts = F.ceil(F.col("g") / F.lit(tile)).cast("int")
    rows = rows.withColumn("cuts", cuts).withColumn("cut", F.pmod("cls", F.col("cuts")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    rows = rows.select("key", F.least("cut", "other").alias("i"), F.greatest("cut", "other").alias("j"), "cut", "cls", "component")
    return stored(rows, "jaccard-tiles")


def _in_tiles(rows: DataFrame, values: DataFrame, each, schema: str) -> DataFrame:
    """Rows that ``each`` makes of the members of a tile, which come sorted by size with their ``values``.

    Small tiles share a call; a call has about ``BATCH_ROWS`` rows and ``BATCH_BYTES`` of arrays, or one tile.
    """
    batches = -(-rows.count() // BATCH_ROWS) or 1
    if "items" in values.columns:
        size = rows.groupBy("cls").agg(F.count("*").alias("k")).join(values.select("cls", "n"), "cls").agg(F.sum(F.col("k") * F.col("n") * 8))
        batches = max(batches, -(-(size.first()[0] or 0) // BATCH_BYTES))
    rows = rows.join(values, "cls").withColumn("batch", F.pmod(F.xxhash64("key", "i", "j"), F.lit(batches)))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "i", "j", "n", "cls"], kind="stable").reset_index(drop=True)
        key, i, j = (pdf[c].to_numpy() for c in ("key", "i", "j"))
        ends = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        found = [each(pdf.iloc[a:b], i[a] != j[a]) for a, b in zip([0, *ends], [*ends, len(key)], strict=True)] if len(key) else []
        return pd.DataFrame({c: np.concatenate([f[k] for f in found]) if found else [] for k, c in enumerate(names)}).drop_duplicates()

    return rows.groupBy("batch").applyInPandas(run, schema)


def _named(rule: Rule, turn: int):
    """Function of a tile: for each class one later class of another component that may link with it."""

    def each(pdf, cut):
        n, part, cls = (pdf[c].to_numpy(np.int64) for c in ("n", "component", "cls"))
        left, right = [], []
        for x, y, differ in _tile_pairs(n, part, pdf["cut"].to_numpy() if cut else None, pdf["bits"].tolist(), rule):
            # on the first turn the nearest, later others, the same under every shingle
            order = differ if turn == 0 else mix((cls[x] ^ cls[y]).view(np.uint64) + np.uint64(turn))
            left.append(cls[x])
            right.append(cls[y[order.argmin()]])
        a, b = np.array(left, np.int64), np.array(right, np.int64)
        return np.minimum(a, b), np.maximum(a, b)

    return each


def _open(rule: Rule):
    """Function of a tile: the members that may link with another of another component."""

    def each(pdf, cut):
        n, part = (pdf[c].to_numpy(np.int64) for c in ("n", "component"))
        some = np.zeros(len(pdf), bool)
        for x, y, _ in _tile_pairs(n, part, pdf["cut"].to_numpy() if cut else None, pdf["bits"].tolist(), rule):
            some[x] = some[y] = True
        return tuple(pdf[c].to_numpy()[some] for c in ("key", "i", "j", "cut", "cls", "component"))

    return each


def _forest(rule: Rule):
    """Function of a tile with sorted arrays: links that connect all that its links connect, one less than members at most."""

    def each(pdf, cut):
        n, part, cls = (pdf[c].to_numpy(np.int64) for c in ("n", "component", "cls"))
        sets = [np.frombuffer(x, np.uint64) for x in pdf["items"]]
        part = part.copy()
        left, right = [], []
        for x, y, _ in _tile_pairs(n, part, pdf["cut"].to_numpy() if cut else None, [bitmap(s) for s in sets], rule):
            while len(y := y[part[y] != part[x]]):
                other, y = y[0], y[1:]
                if rule.links(len(np.intersect1d(sets[x], sets[other], assume_unique=True)), n[x], n[other]):
                    part[part == part[other]] = part[x]
                    left.append(cls[x])
                    right.append(cls[other])
        a, b = np.array(left, np.int64), np.array(right, np.int64)
        return np.minimum(a, b), np.maximum(a, b)

    return each


def _tile_pairs(n, part, cut, bits, rule: Rule):
    """For each row of a tile, in order of size, the later rows of other components that may link with it.

    With ``cut``, only rows of different cuts are compared. The number of bits that differ comes along.
    """
    ends = np.searchsorted(n, 100 * n // rule.percent, side="right")
    at = 0
    while at < len(n):
        top = ends[at]  # a band: rows from the first to the largest that may link with it
        stop = ends[top - 1]  # partners of the band's last row
        if top - at > 1 or stop > top:
            width = min(8 * len(b) for b in bits[at:stop])
            block = np.stack([folded(b, width) for b in bits[at:stop]])
            for x in range(at, top):
                y = np.arange(x + 1, ends[x])
                y = y[(part[y] != part[x]) & (cut[y] != cut[x] if cut is not None else True)]
                if len(y):
                    differ = np.bitwise_count(block[y - at] ^ block[x - at]).sum(axis=1, dtype=np.int64)
                    ok = rule.links((n[x] + n[y] - differ) // 2, n[x], n[y])
                    if ok.any():
                        yield x, y[ok], differ[ok]
        at = top


def _all_linked(docs: DataFrame, meets: DataFrame, links: DataFrame, marks: DataFrame, texts: DataFrame, rule: Rule,
                tile: int, turns: int) -> DataFrame:
    """Components of all links among the classes that meet, of which some ``links`` are known.

    In a turn, if there is any, every class names one of another component per tile, which joins up most of a large
    group of near copies. After ``turns`` of them, or one that joined nothing, the tiles settle the rest.
    """
    found = components(links)

    def joined(new: DataFrame) -> DataFrame:
        old = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        out = components(old.unionByName(new))
        freed(found)
        return out

    for turn in range(turns):
        rows = _tiles(meets, found, tile)
        if rows.isEmpty():
            freed(rows)
            return found
        pairs = _in_tiles(rows, marks, _named(rule, turn), "a long, b long").distinct()
        new = _linked(docs, pairs, texts, rule)
        freed(rows)
        nothing = new.isEmpty()
        if not nothing:
            found = joined(new)
        freed(new)
        if nothing:
            break
    rows = _tiles(meets, found, tile)
    schema = "key long, i int, j int, cut int, cls long, component long"
    still = stored(_in_tiles(rows, marks, _open(rule), schema).distinct(), "jaccard-open")
    freed(rows)
    wanted = texts.join(still.select("cls").distinct(), "cls", "left_semi")
    sets = stored(_sets_of(docs, rule, wanted), "jaccard-sets")
    values = sets.select("cls", "items", (F.length("items") / 8).cast("int").alias("n"))
    new = stored(_in_tiles(still, values, _forest(rule), "a long, b long").distinct(), "jaccard-links")
    if not new.isEmpty():
        found = joined(new)
    freed(still, sets, new)
    return found


def grouped(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: Rule = Rule(), tile: int = TILE, turns: int = TURNS,
            often: int = OFTEN, n_shingles: str = "n_shingles", component_id: str = "component_id") -> DataFrame:
    """``doc_id``, the number of shingles, and the least id of the documents reachable by links.

    One row per row of ``df``; the id keeps its name.
    """
    spark = df.sparkSession
    docs = df.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    first = stored(_classes(docs, rule), "jaccard-classes")
    members = first.where("n is not null").select("id", "n", "cls")
    common = (
        first.where("n is null").groupBy("cls").agg(F.sum("times").alias("t")).where(F.col("t") >= often)
        .orderBy(F.desc("t"), "cls").limit(MOST_FREQUENT).select("cls").toArrow()["cls"].to_numpy()
    )
    frequent = spark.sparkContext.broadcast(np.sort(common.view(np.uint64)))
    meets = _meetings(_prefixes(docs, rule, frequent))
    # a text for every class that meets others
    texts = members.where("n > 0").groupBy("cls").agg(F.min("id").alias("id"))
    texts = stored(texts.join(meets.select("cls").distinct(), "cls", "left_semi"), "jaccard-texts")
    marks = stored(_marks_of(docs, rule, texts), "jaccard-marks")
    ends = F.explode(
        F.array(
            F.struct(F.col("lo").alias("a"), F.col("cls").alias("b")), F.struct(F.col("cls").alias("a"), F.col("hi").alias("b"))
        )
    )
    to_ends = meets.select(ends.alias("p")).select("p.a", "p.b").where("a < b").distinct()
    links = _linked(docs, _close(to_ends, marks, rule), texts, rule)
    found = _all_linked(docs, meets.select("key", "cls"), links, marks, texts, rule, tile, turns)
    freed(meets, links, marks, texts)
    parts = found.select(F.col("node").alias("cls"), "component")
    classes = members.where("n > 0").groupBy("cls").agg(F.min("id").alias("least"))
    classes = classes.join(parts, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    names = classes.groupBy("component").agg(F.min("least").alias("name"))
    classes = classes.join(names, "component").select(F.col("cls").alias("c"), "name")
    out = members.join(classes, (F.col("cls") == F.col("c")) & (F.col("n") > 0), "left")
    out = out.select(
        F.col("id").alias(doc_id), F.col("n").cast("long").alias(n_shingles),
        F.when(F.col("n") > 0, F.col("name")).otherwise(F.col("id")).alias(component_id),
    )
    out.made_of = (first, found)
    return out


def one_of_each(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rule: Rule = Rule()) -> DataFrame:
    """The rows whose id names their group: one document of every group of near-duplicates stays.

    Of several rows with that id one stays. Rows without id stay.
    """
    out_id, n, name = free_names(df.columns, "id", "n_shingles", "component")
    groups = grouped(df.select(F.col(f"`{doc_id}`").alias(out_id), F.col(f"`{text}`").alias("text")), out_id, "text", rule,
                     n_shingles=n, component_id=name)
    made_of, groups = groups.made_of, stored(groups, "jaccard-groups")
    freed(*made_of)
    gone = groups.where(F.col(out_id) != F.col(name)).select(out_id).distinct()
    if gone.count() <= BROADCAST_ROWS:  # so that texts are not shuffled
        gone = F.broadcast(gone)
    twice = groups.where(F.col(out_id) == F.col(name)).groupBy(out_id).agg(F.count("*").alias(n)).where(F.col(n) > 1).select(out_id)
    key = F.col(f"`{doc_id}`").cast("long") == F.col(out_id)
    kept = df.join(gone, key, "left_anti")
    if twice.isEmpty():
        return kept
    once = kept.join(twice, key, "left_semi").dropDuplicates([doc_id])
    return kept.join(twice, key, "left_anti").unionByName(once)
