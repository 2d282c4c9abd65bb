"""Language-model scores by deleted interpolation.

The model mixes the relative frequency of a word after its context (the word before it, or the start
of the text) with the smoothed frequency of the word alone:

    P(w | v) = L(v) * c(v, w) / c(v) + (1 - L(v)) * (c(w) + 1) / (N + V + 1)

over words and one end per text; unknown words share what the second part leaves, so probabilities sum to
one. L depends on the bucket of the context's frequency, a power of two. The weights are found by
expectation-maximisation on held-out counts: one fold of the training texts is scored with the
counts of the others, and the histogram of the ratios of both parts by bucket is all that the
iteration needs. The final counts are those of all training texts.

How it runs. Words are counted with partial sums in every task. Tasks hold the ``VOCABULARY`` most frequent words; pairs
of such words are dealt by hash into buckets as packed ranks, a row per chunk of texts and bucket, in the order of the texts;
a bucket counts its pairs and turns each into a ratio. A row holds steps from text to text instead of the texts'
ids, so it costs the same per pair whatever the number of buckets, and sums of a chunk's texts are added in tasks before they
move. One shuffle of packed pairs therefore serves the counts, the weights and the scores, and a frequent word is no hot
spot, since pairs are dealt, not words. Pairs with a rarer word (a few in a hundred) get its counts by a join on that word;
what they change in a text's score is added to it. Chunks are named by task, so the order of rows in a partition must not change
when a task is repeated; it does not if the texts are read from files.

Defined results: a null text counts as empty; an empty text is one end. Equal rows score alike; ids
may be null or repeat. Without training texts N and V are 0 and every token has probability 1 in base and model.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.llm.common import appended, remainder, stored
from quadrat.llm.words import GOLDEN, mix, signed, word_hashes

#: Words that tasks hold at most (20 bytes each).
VOCABULARY = 4_000_000
#: Buckets of pairs: at least so many, and more if a bucket would have more pairs than that.
BUCKETS, BUCKET_PAIRS = 64, 800_000
#: Context-frequency buckets, and steps of the ratio histogram per power of two.
POWERS, STEPS = 40, 16
#: Tokens counted together, pairs packed together, texts whose sums a task holds.
COUNTED, PACK, SUMS = 400_000, 400_000, 4_000_000
#: Sums of a text come from so many tasks per token of a text at most (or two per core).
SPREAD = 0.2
END, START = np.uint64(1), np.uint64(2)
_SLICE = 256


def tokens(texts) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each text and one end, and the bounds of each text."""
    words, bounds = word_hashes(texts)
    n = len(bounds) - 1
    out = np.empty(len(words) + n, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(bounds))
    out[np.arange(len(words)) + owner] = words
    bounds = bounds + np.arange(n + 1)
    out[bounds[1:] - 1] = END
    return out, bounds


def _before(items: np.ndarray, bounds: np.ndarray, start) -> np.ndarray:
    out = np.empty_like(items)
    out[1:] = items[:-1]
    out[bounds[:-1]] = start
    return out


@dataclass
class Vocabulary:
    """Words by hash, ranked by frequency; counts in all training texts and in those not held out."""

    hashes: np.ndarray
    ranks: np.ndarray

    def rank(self, items: np.ndarray) -> np.ndarray:
        """Rank of each word, the number of words if unknown."""
        known, back = np.unique(items, return_inverse=True)
        if not len(self.hashes):
            return np.zeros(len(items), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, known), len(self.hashes) - 1)
        return np.where(self.hashes[at] == known, self.ranks[at], len(self.hashes))[back].astype(np.int64)


def _counts(docs: DataFrame) -> DataFrame:
    """``word, rest, fold``: counts of training tokens in texts not held out and held out for the weights."""

    def run(batches):
        for batch in batches:
            words, kinds, n = [], [], 0
            for k in range(0, batch.num_rows, _SLICE):
                part = batch.slice(k, _SLICE)
                items, bounds = tokens(part.column(1))
                words.append(items)
                kinds.append(np.repeat(part.column(2).to_numpy().astype(np.int8), np.diff(bounds)))
                n += len(items)
                if n >= COUNTED:
                    yield counted(np.concatenate(words), np.concatenate(kinds))
                    words, kinds, n = [], [], 0
            if n:
                yield counted(np.concatenate(words), np.concatenate(kinds))
        pa.default_memory_pool().release_unused()

    def counted(words, kinds):
        columns = [np.unique(words[kinds == k], return_counts=True) for k in (1, 2)]
        known = np.concatenate([c[0] for c in columns])
        rest, fold = (np.concatenate([c[1] if i == j else np.zeros(len(c[0]), np.int64) for i, c in enumerate(columns)]) for j in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(signed(known)), pa.array(rest), pa.array(fold)], ["word", "rest", "fold"])

    each = docs.mapInArrow(run, "word long, rest long, fold long")
    return each.groupBy("word").agg(F.sum("rest").alias("rest"), F.sum("fold").alias("fold"))


def _ranked(found: DataFrame, n: int) -> tuple[Vocabulary, np.ndarray, np.ndarray]:
    """The words of ``word, all, rest``, and their counts by rank, with a place for the start of a text.

    The driver holds numbers no wider than ``n`` tokens need, and each step's only until the next.
    """
    width, kind = ("int", np.uint32) if n < 2**31 else ("long", np.int64)
    table = found.select("word", *[F.col(c).cast(width).alias(c) for c in ("all", "rest")]).toArrow()
    size = table.num_rows
    columns = {"word": np.empty(size, np.uint64), "all": np.empty(size, kind), "rest": np.empty(size, kind)}
    for name, column in columns.items():
        at = 0
        for chunk in table[name].chunks:
            column[at : at + len(chunk)] = chunk.to_numpy().view(np.uint64) if name == "word" else chunk.to_numpy()
            at += len(chunk)
        table = table.drop_columns(name)
    del table
    pa.default_memory_pool().release_unused()
    hashes, all_, rest = columns.pop("word"), columns.pop("all"), columns.pop("rest")
    order = np.argsort(hashes).astype(np.uint32)
    hashes, all_, rest = hashes[order], all_[order], rest[order]
    # by count, words of one count by hash
    order = np.argsort(all_.max(initial=0) - all_, kind="stable").astype(np.uint32)
    ranks = np.empty(size, np.uint32)
    ranks[order] = np.arange(size, dtype=np.uint32)
    all_, rest = (np.append(c[order], kind(0)) for c in (all_, rest))
    return Vocabulary(hashes, ranks), all_, rest


def _sent(found: DataFrame, sizes: Sizes):
    """Broadcasts of the words of ``found`` and of their counts; the driver keeps neither."""
    words, all_, rest = _ranked(found, sizes.n)
    all_[-1], rest[-1] = sizes.texts, sizes.texts_rest
    context = found.sparkSession.sparkContext
    return context.broadcast(words), context.broadcast((all_, rest))


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte, all first bytes first: bytes of one rank are alike and compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplaned(b: bytes, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(width, -1).T).view(kind).reshape(-1)


def _squeezed(*parts: bytes) -> bytes:
    """Blocks in a row, compressed, after their length."""
    raw = b"".join(parts)
    return len(raw).to_bytes(4, "little") + pa.Codec("zstd", compression_level=1).compress(raw, asbytes=True)


def _unsqueezed(b: bytes) -> bytes:
    return pa.Codec("zstd").decompress(b[4:], int.from_bytes(b[:4], "little"), asbytes=True)


def _packed(docs: DataFrame, buckets: int, vocabulary) -> DataFrame:
    """Pairs of held words by chunk of texts and bucket: ``bucket, chunk, idents, sizes, pairs``.

    Texts of a chunk are ordered by kind, pairs of a row by text. ``sizes`` are the numbers of pairs of each kind, ``pairs`` the
    steps from text to text, the first and the second words. One row of a chunk has the ``idents`` of its texts.
    """
    names = ["bucket", "chunk", "idents", "sizes", "pairs"]

    def emit(held, chunk):
        idents, kinds = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        sizes = np.concatenate([h[2] for h in held])
        first, second = np.concatenate([h[3] for h in held]), np.concatenate([h[4] for h in held])
        place = np.empty(len(idents), np.uint32)
        by_kind = np.argsort(kinds, kind="stable")
        place[by_kind] = np.arange(len(idents), dtype=np.uint32)
        text = np.repeat(place, sizes)
        with np.errstate(over="ignore"):
            bucket = (mix(first.astype(np.uint64) * GOLDEN + second.astype(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket * len(idents) + text, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=buckets))])
        kind_cuts = np.searchsorted(kinds[by_kind], np.arange(4))
        rows, own = [], idents[by_kind].tobytes()
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            at = order[cuts[b] : cuts[b + 1]]
            steps = np.diff(text[at], prepend=np.uint32(0))
            of_kind = np.diff(np.searchsorted(text[at], kind_cuts)).astype(np.uint32)
            rows.append((b, chunk, own, of_kind.tobytes(), _squeezed(_planes(steps), _planes(first[at]), _planes(second[at]))))
            own = None
        types = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    def run(batches):
        known, chunk = vocabulary(), TaskContext.get().partitionId() << 32
        start = np.uint32(len(known.hashes))
        held, n = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, _SLICE):
                part = batch.slice(k, _SLICE)
                items, bounds = tokens(part.column(1))
                rank = known.rank(items).astype(np.uint32)
                ok = rank < start
                first, ok = _before(rank, bounds, start), ok & _before(ok, bounds, True)
                sizes = np.add.reduceat(ok, bounds[:-1], dtype=np.int64)
                held.append((part.column(0).to_numpy(), part.column(2).to_numpy(), sizes, first[ok], rank[ok]))
                n += int(sizes.sum())
                if n >= PACK:
                    yield emit(held, chunk)
                    held, n, chunk = [], 0, chunk + 1
        if n:
            yield emit(held, chunk)
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, "bucket int, chunk long, idents binary, sizes binary, pairs binary")


@dataclass
class Sizes:
    """Tokens in all training texts and in those not held out, distinct words, texts of both kinds."""

    n: int
    n_rest: int
    v: int
    texts: int
    texts_rest: int


def _power(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(counts, 1)).astype(np.int64), POWERS - 1)


def _steps(r: np.ndarray) -> np.ndarray:
    return np.where(r > 0, np.round(STEPS * np.log2(np.where(r > 0, r, 1))), -(10**6)).astype(np.int64)


def _ratios(rows: pd.DataFrame, sizes: Sizes, counts) -> pd.DataFrame:
    """One bucket: count its pairs; per chunk the ratio and power of each, and the histogram for the weights."""
    of_kind = [np.frombuffer(b, np.uint32) for b in rows["sizes"]]
    kind = np.concatenate([np.repeat(np.arange(3, dtype=np.uint8), k) for k in of_kind])
    cuts = np.concatenate([[0], np.cumsum([k.sum() for k in of_kind], dtype=np.int64)])
    steps, first, second = [], np.empty(len(kind), np.uint32), np.empty(len(kind), np.uint32)
    for b, i, j in zip(rows["pairs"], cuts[:-1], cuts[1:], strict=True):
        raw, width = _unsqueezed(b), 4 * (j - i)
        steps.append(raw[:width])
        first[i:j], second[i:j] = _unplaned(raw[width : 2 * width], np.uint32), _unplaned(raw[2 * width :], np.uint32)
    all_, rest = counts
    key = first.astype(np.uint64) << np.uint64(32) | second
    # pairs in order; each gets its counts in all training texts and in those not held out
    order = np.argsort(key)
    key = key[order]
    group = np.cumsum(np.concatenate([[False], key[1:] != key[:-1]]), dtype=np.int32)
    del key
    sorted_kind = kind[order]
    pair, pair_rest = np.empty(len(order), np.int32), np.empty(len(order), np.int32)
    pair[order] = np.bincount(group[sorted_kind > 0], minlength=group[-1] + 1)[group]
    pair_rest[order] = np.bincount(group[sorted_kind == 1], minlength=group[-1] + 1)[group]
    del order, group, sorted_kind
    cv = all_[first]
    ratio = (pair / cv * ((sizes.n + sizes.v + 1) / (all_[second] + 1))).astype(np.float32)
    power = _power(cv).astype(np.uint8)
    del cv, pair
    out = [
        (int(c), o, int(j - i), _squeezed(s, _planes(ratio[i:j]), power[i:j].tobytes()), None, None, None)
        for c, o, s, i, j in zip(rows["chunk"], rows["idents"], steps, cuts[:-1], cuts[1:], strict=True)
    ]
    fold = kind == 2
    cv_rest, cw_rest, pair_rest = rest[first[fold]], rest[second[fold]], pair_rest[fold]
    ok = cv_rest > 0
    if ok.any():
        r = pair_rest[ok] / cv_rest[ok] * ((sizes.n_rest + sizes.v + 1) / (cw_rest[ok] + 1))
        cell, n = np.unique(np.stack([_power(cv_rest[ok]), _steps(r)]), axis=1, return_counts=True)
        out += [(None, None, None, None, int(b), int(s), int(k)) for b, s, k in zip(cell[0], cell[1], n, strict=True)]
    frame = pd.DataFrame(out, columns=["chunk", "idents", "pairs", "ratios", "power", "step", "n"])
    return frame.astype({c: "Int64" for c in ("chunk", "pairs", "power", "step", "n")})


_RATIOS = "chunk long, idents binary, pairs int, ratios binary, power int, step int, n long"


def _rarer(docs: DataFrame, rare: DataFrame, sizes: Sizes, vocabulary, counts):
    """Pairs with a word that tasks do not hold but training texts have, with the counts of their words, and what a batch of them gives.

    ``rare`` are the words of the training texts that tasks do not hold. The function that is returned runs in tasks.
    """

    def run(batches):
        known = vocabulary()
        for batch in batches:
            for k in range(0, batch.num_rows, _SLICE):
                part = batch.slice(k, _SLICE)
                items, bounds = tokens(part.column(1))
                rank = known.rank(items)
                unheld = rank == len(known.hashes)
                before = _before(unheld, bounds, False)
                at = np.flatnonzero(unheld | before)
                text = np.searchsorted(bounds, at, side="right") - 1
                v, w = signed(_before(items, bounds, START))[at], signed(items)[at]
                # 0: the first word is not held, 1: the second, 2: both; the other word goes by its rank, a start by the last
                side = np.where(before[at], np.where(unheld[at], 2, 0), 1)
                other = np.select([side == 0, side == 1], [rank[at], _before(rank, bounds, len(known.hashes))[at]], w)
                cols = [part.column(0).to_numpy()[text], (3 * side + part.column(2).to_numpy()[text]).astype(np.int8), np.where(side == 1, w, v), other]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["ident", "sort", "word", "other"])

    pairs = docs.mapInArrow(run, "ident long, sort byte, word long, other long")
    kind, side = F.col("sort") % 3, F.floor(F.col("sort") / 3)
    same = W.partitionBy("word", side, "other")
    met = pairs.join(rare, "word", "left").where(F.col("all").isNotNull() | (side == 2)).select(
        "ident", "sort", "other", "all", "rest",
        F.sum((kind > 0).cast("long")).over(same).alias("pair"), F.sum((kind == 1).cast("long")).over(same).alias("pair_rest"),
    )
    met = stored(met, "lm-rare")
    of_other = rare.select(F.col("word").alias("other"), F.col("all").alias("all2"), F.col("rest").alias("rest2"))
    none = F.lit(0).cast("long")
    both = met.where(side < 2).select("*", none.alias("all2"), none.alias("rest2")).unionByName(met.where(side == 2).join(of_other, "other", "left"))
    both = both.fillna(0, ["all", "rest", "all2", "rest2"])
    total, total_rest = sizes.n + sizes.v + 1, sizes.n_rest + sizes.v + 1

    def judge(p: pd.DataFrame):
        """What a batch adds: ``base, known``; whether ``context`` and ``power`` count, ratios; and fold powers with steps."""
        held, held_rest = counts()
        side, kind = np.divmod(p["sort"].to_numpy(np.int64), 3)
        own, own_rest = p["all"].to_numpy(float), p["rest"].to_numpy(float)
        rank = np.where(side == 2, 0, p["other"].to_numpy())
        mate = np.where(side == 2, p["all2"].to_numpy(), held[rank]).astype(float)
        mate_rest = np.where(side == 2, p["rest2"].to_numpy(), held_rest[rank]).astype(float)
        a, ar = np.where(side == 1, mate, own), np.where(side == 1, mate_rest, own_rest)
        b, br = np.where(side == 1, own, mate), np.where(side == 1, own_rest, mate_rest)
        known, seen = (side != 0) & (b > 0), (a > 0) & (b > 0)
        ratio = (p["pair"].to_numpy() / np.maximum(a, 1) * (total / (b + 1))).astype(np.float32)
        fold = seen & (kind == 2) & (ar > 0)
        r = p["pair_rest"].to_numpy()[fold] / ar[fold] * (total_rest / (br[fold] + 1))
        return np.where(known, np.log10(b + 1), 0.0), known, (side != 1) & (a > 0), seen, _power(a), ratio, _power(ar[fold]), _steps(r)

    return both, judge


def weights(histogram: dict[int, dict[int, int]], rounds: int = 60) -> np.ndarray:
    """L per power of the context's count, by expectation-maximisation; 0.5 where nothing was held out."""
    out = np.full(POWERS, 0.5)
    for b, cells in histogram.items():
        step = np.array(sorted(cells))
        n = np.array([cells[s] for s in step], float)
        r = np.where(step > -(10**6), 2.0 ** (np.maximum(step, -(10**5)) / STEPS), 0.0)
        x = 0.5
        for _ in range(rounds):
            x = float((n * (x * r / (x * r + 1 - x))).sum() / n.sum())
            x = min(max(x, 1e-6), 1 - 1e-6)
        out[b] = x
    return out


def scored(df: DataFrame, doc_id: str = "doc_id", text: str = "text", modulus: int = 7, held_out: int = 2,
           fold: int = 3, vocabulary: int = VOCABULARY) -> DataFrame:
    """Per row of ``df``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Texts whose crc32 of the id leaves ``held_out`` are not learned from; those that leave ``fold`` are held out
    for the weights. Scores are logarithms to base 10 of the whole text's probability.
    """
    spark = df.sparkSession
    left = F.coalesce(remainder(doc_id, modulus), F.lit(-1))
    kind = F.when(left == held_out, 0).when(left == fold, 2).otherwise(1).cast("int")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    docs = df.select(F.xxhash64(F.col(f"`{doc_id}`"), body).alias("ident"), body.alias("text"), kind.alias("kind"))
    counted = stored(_counts(docs), "lm-words")
    found = counted.where(F.col("rest") + F.col("fold") > 0)
    end = F.col("word") == int(END)
    got = found.agg(
        F.coalesce(F.sum(F.col("rest") + F.col("fold")), F.lit(0)), F.coalesce(F.sum("rest"), F.lit(0)), F.count("*"),
        F.coalesce(F.sum(F.when(end, F.col("rest") + F.col("fold"))), F.lit(0)), F.coalesce(F.sum(F.when(end, F.col("rest"))), F.lit(0)),
    ).first()
    sizes = Sizes(*got)
    ids = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(F.col(f"`{doc_id}`"), body).alias("ident"), body.alias("text"), kind.alias("kind"))
    buckets = max(BUCKETS, -(-sizes.n // BUCKET_PAIRS))
    total = sizes.n + sizes.v + 1
    # the words that tasks hold: those with at least ``least`` occurrences, and the end
    found = found.select("word", (F.col("rest") + F.col("fold")).alias("all"), "rest")
    least = 1
    if sizes.v > vocabulary:
        left = vocabulary
        for r in found.groupBy("all").count().orderBy(F.desc("all")).collect():  # counts that differ: at most the root of twice the tokens
            if r["count"] > left:
                least = r["all"] + 1
                break
            left -= r["count"]
    holds = (F.col("all") >= least) | end
    known, counts = _sent(found.where(holds), sizes)
    packed = _packed(docs, buckets, lambda: known.value)
    path_table = stored(packed.groupBy("bucket").applyInPandas(lambda rows: _ratios(rows, sizes, counts.value), _RATIOS), "lm-ratios")
    cells = path_table.where("n is not null").select("power", "step", "n")
    if least > 1:
        rare, judge = _rarer(docs, found.where(~holds), sizes, lambda: known.value, lambda: counts.value)

        def folds(batches):
            for p in batches:
                cell, n = np.unique(np.stack(judge(p)[-2:]), axis=1, return_counts=True)
                yield pd.DataFrame({"power": cell[0], "step": cell[1], "n": n})

        cells = cells.unionByName(rare.mapInPandas(folds, "power int, step int, n long"))
    histogram: dict[int, dict[int, int]] = {}
    for r in cells.groupBy("power", "step").agg(F.sum("n").alias("n")).collect():  # at most POWERS times the steps of a ratio
        histogram.setdefault(r["power"], {})[r["step"]] = r["n"]
    mixed = weights(histogram)
    gain, loss = mixed / (1 - mixed), np.log10(1 - mixed)

    def add(batches):
        """Sums per text of a chunk, added up over the buckets of a task."""
        sums, idents, size = {}, {}, 0

        def flushed():
            for c, s in sums.items():
                yield pa.RecordBatch.from_arrays([pa.array([c]), pa.array([idents.get(c)], pa.binary()), pa.array([_squeezed(_planes(s))], pa.binary())], ["chunk", "idents", "sums"])

        for batch in batches:
            for c, o, n, b in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                raw = _unsqueezed(b)
                text = np.cumsum(_unplaned(raw[: 4 * n], np.uint32), dtype=np.int64)
                value = np.log10(1 + gain[np.frombuffer(raw[8 * n :], np.uint8)] * _unplaned(raw[4 * n : 8 * n], np.float32))
                part = np.bincount(text, value)
                if o is not None:
                    idents[c] = o
                old = sums.get(c)
                if old is None or len(old) < len(part):
                    size += len(part) - (0 if old is None else len(old))
                    old, part = part, old
                if part is not None:
                    old[: len(part)] += part
                sums[c] = old
                if size > SUMS:
                    yield from flushed()
                    sums, idents, size = {}, {}, 0
        yield from flushed()
        pa.default_memory_pool().release_unused()

    def joined(rows: pd.DataFrame) -> pd.DataFrame:
        idents = np.frombuffer(rows["idents"].dropna().iat[0], np.int64)
        out = np.zeros(len(idents))
        for b in rows["sums"]:
            s = _unplaned(_unsqueezed(b), np.float64)
            out[: len(s)] += s
        return pd.DataFrame({"ident": idents, "s": out})

    parts = path_table.where("n is null").select("chunk", "idents", "pairs", "ratios")
    parts = parts.coalesce(max(2 * spark.sparkContext.defaultParallelism, int(SPREAD * sizes.n / max(1, sizes.texts))))
    parts = parts.mapInArrow(add, "chunk long, idents binary, sums binary").groupBy("chunk").applyInPandas(joined, "ident long, s double")
    parts = parts.select("ident", "s", F.lit(0.0).alias("base"), F.lit(0).alias("known"))
    if least > 1:

        def rise(batches):
            for p in batches:
                base, new, context, seen, power, ratio, _, _ = judge(p)
                s = base + np.where(seen, np.log10(1 + gain[power] * ratio), 0.0) + np.where(context, loss[power], 0.0)
                yield pd.DataFrame({"ident": p["ident"], "s": s, "base": base, "known": new.astype(np.int32)})

        parts = parts.unionByName(rare.mapInPandas(rise, "ident long, s double, base double, known int"))
    sums = parts.groupBy("ident").agg(F.sum("s").alias("s"), F.sum("base").alias("b"), F.sum("known").alias("k"))

    def measure(texts):
        items, bounds = tokens(texts)
        rank = known.value.rank(items)
        c = np.where(rank < len(known.value.hashes), counts.value[0][rank], 0).astype(np.int64)
        n, at = np.diff(bounds), bounds[:-1]
        base = np.add.reduceat(np.log10((c + 1) / total), at)
        context = _before(c, bounds, sizes.texts)
        less = np.where(context > 0, loss[_power(context)], 0.0)
        return [n, np.add.reduceat((c > 0).astype(np.int64), at), base, base + np.add.reduceat(less, at)]

    schema = "n_tokens long, n_held long, base double, plain double"
    each = appended(ids, measure, schema, ["text"], ["text"])
    alike = each.groupBy("ident").agg(F.count("*").alias("times"))
    sums = sums.join(alike, "ident").select("ident", *[(F.col(c) / F.col("times")).alias(c) for c in "sbk"])
    out = each.join(sums, "ident", "left")
    more, more_base, more_known = (F.coalesce(F.col(c), F.lit(0.0)) for c in "sbk")
    return out.select(
        F.col("doc_id").alias(doc_id), (F.col("kind") == 0).alias("held_out"), "n_tokens", (F.col("n_held") + F.round(more_known).cast("long")).alias("n_known"),
        F.lit(sizes.n).cast("long").alias("train_tokens"), (F.col("base") + more_base).alias("base_score"), (F.col("plain") + more).alias("score"),
    )
