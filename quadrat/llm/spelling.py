"""Spelling variants of words by a trie of letter-group counts.

Letters are dealt to ``GROUPS`` groups of about equal frequency. A word is placed in a trie by its length and then
by how many of its letters fall into each group, one level per number. Two words that differ by one inserted,
deleted or replaced letter have counts that differ by one more letter in at most one group and one less in at
most one: so a search goes down the trie with a budget of one surplus and one deficit, and the words of the
leaves it reaches are verified letter by letter. A pair is found once, from the shorter word, else from the word of
which the first unequal count is the smaller (the deficit may only be spent after the surplus), else
from the word with the smaller letter where both differ; the result is handed to both.

On the cluster the trie is cut into parts. Its top, the nodes that have more than ``PART_WORDS`` words below
them, is counted level by level and is small; it travels with the tasks, which send every word once to
the part that holds it and as a query to the parts its budget reaches. Parts that cannot be cut further (words
with equal counts in all groups) are dealt into pieces by hash, and queries above ``PART_QUERIES`` for a part
too; every piece of the queries meets every piece of the words. Inside a part the search is depth first over blocks
of queries, and each part returns per word the number of near words and the best of them only.

Defined results: a null or empty text has no words, an empty table gives an empty table; a missing identifier
counts as an empty string where it is hashed. Other columns of the documents are not looked at.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import stored

#: Letters of words (fixed by the contract): A-Z, a-z and U+00C0 to U+00FF.
LETTERS = [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]
#: One in so many runs of a document loses a letter (fixed by the contract).
SLIP = 31
#: Letters and occurrences that a word needs, and how much more frequent a form is (fixed by the contract).
LEAST_LETTERS, LEAST_COUNT, TIMES = 7, 2, 10
#: Levels of the trie below the length.
GROUPS = 12
#: Words in a part of the trie, and queries that it gets at once, about.
PART_WORDS, PART_QUERIES = 40_000, 400_000
#: Nodes of the trie's top hold at least one in so many words each, which bounds their number.
MOST_NODES = 10_000
#: Entries of the search that are carried at once.
BLOCK = 1 << 18
#: Words up to this length are compared in one matrix.
WIDE = 40

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if b in set(LETTERS) else 32 for b in range(256))


# ---------------------------------------------------------------- words


def runs(text: str | None) -> list[bytes]:
    """Maximal runs of letters in Latin-1, A-Z lower-cased."""
    return (text or "").encode("latin-1", "replace").translate(_LOWER).split()


def _slipped(start: int, run: bytes) -> bytes:
    """The run, without one letter if its hash says so. ``start`` is the crc32 of the document's part."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), start)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def counted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word`` and ``n``: the words of all texts that are long and frequent enough."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flushed():
            out = pa.RecordBatch.from_arrays(
                [pa.array([w.decode("latin-1") for w in total], pa.string()), pa.array(list(total.values()), pa.int64())],
                ["word", "n"],
            )
            total.clear()
            return out

        for batch in batches:
            for doc, body in zip(batch.column(0), batch.column(1), strict=True):
                start = zlib.crc32(f"{doc.as_py() or ''}:".encode())
                for run, k in Counter([r for r in runs(body.as_py()) if len(r) >= LEAST_LETTERS]).items():
                    word = _slipped(start, run)
                    if len(word) >= LEAST_LETTERS:
                        total[word] += k
                if len(total) > 300_000:
                    yield flushed()
        yield flushed()

    slim = docs.select(F.col(f"`{doc_id}`").cast("string"), F.col(f"`{text}`").cast("string"))
    parts = slim.mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# ---------------------------------------------------------------- trie


def dealt_letters(counts: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The group of each Latin-1 letter: the most frequent letters first, each to the lightest group."""
    load, out = np.zeros(groups), np.zeros(256, np.int64)
    for letter in sorted(range(256), key=lambda c: (-counts[c], c)):
        out[letter] = load.argmin()
        load[out[letter]] += counts[letter] + 1e-9
    return out


class Words:
    """Words as flat letters, with their lengths and places in the trie."""

    def __init__(self, words: pa.Array, group: np.ndarray, groups: int) -> None:
        self.length = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
        self.flat = np.frombuffer("".join(words.to_pylist()).encode("latin-1"), np.uint8)
        self.end = np.cumsum(self.length)
        self.begin = self.end - self.length
        n = len(self.length)
        owner = np.repeat(np.arange(n), self.length)
        at = owner * groups + group[self.flat]
        self.path = np.empty((n, groups + 1), np.int64)
        self.path[:, 0] = self.length
        self.path[:, 1:] = np.bincount(at, minlength=n * groups).reshape(n, groups)

    def blocks(self) -> list[np.ndarray]:
        """The first ``WIDE`` letters, eight to a number, zeros behind them."""
        out = []
        for k in range(0, min(WIDE, int(self.length.max(initial=0))), 8):
            left = np.clip(self.length - k, 0, 8)
            some = np.zeros(len(self.length), np.uint64)
            for j in range(8):
                has = np.flatnonzero(left > j)
                some[has] |= self.flat[self.begin[has] + k + j].astype(np.uint64) << np.uint64(8 * j)
            out.append(some)
        return out

    def bytes_of(self, i: int) -> bytes:
        return self.flat[self.begin[i] : self.end[i]].tobytes()


def stepped(level: int, want: np.ndarray, left: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The counts a search may take on a level: which entries, the wanted count and what is left to spend.

    ``left`` is 2 (a surplus and a deficit to spend, or neither), 1 (the deficit is due), 0 (nothing to spend) or
    3 (one surplus is due and no deficit allowed).
    """
    yield np.arange(len(want)), want, left
    if level == 0:  # a word that is longer by one has one surplus and no deficit
        yield np.arange(len(want)), want + 1, np.full(len(want), 3)
        return
    more = np.flatnonzero(left >= 2)
    yield more, want[more] + 1, np.where(left[more] == 2, 1, 0)
    less = np.flatnonzero(left == 1)
    yield less, want[less] - 1, np.zeros(len(less), np.int64)


class Trie:
    """Sorted paths; a level's nodes are known by (node above, count)."""

    def __init__(self, path: np.ndarray) -> None:
        self.order = np.lexsort(path.T[::-1])
        path = path[self.order]
        self.span = int(path.max(initial=0)) + 2
        self.keys, node = [], np.zeros(len(path), np.int64)
        for level in range(path.shape[1]):
            key = node * self.span + path[:, level]
            new = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.zeros(0, bool)
            self.keys.append(key[new])
            node = np.cumsum(new) - 1
        starts = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.zeros(0, np.int64)
        self.leaf = np.append(starts, len(path))

    def reached(self, path: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Queries and leaves within the budget: depth first, a block of entries at a time."""
        levels = path.shape[1]
        n = len(path)
        stack = [(0, np.arange(n), np.zeros(n, np.int64), np.full(n, 2))]
        while stack:
            level, query, node, left = stack.pop()
            if len(query) > BLOCK:
                half = len(query) // 2
                stack += [(level, query[s], node[s], left[s]) for s in (slice(half), slice(half, None))]
                continue
            if level == levels:
                done = (left == 2) | (left == 0)
                yield query[done], node[done]
                continue
            keys, found = self.keys[level], []
            for which, want, rest in stepped(level, path[query, level], left):
                key = node[which] * self.span + want
                key[(want < 0) | (want >= self.span)] = -1
                at = np.searchsorted(keys, key)
                hit = keys[np.minimum(at, len(keys) - 1)] == key if len(keys) else np.zeros(len(key), bool)
                found.append((query[which[hit]], at[hit], rest[hit]))
            query, node, left = (np.concatenate(x) for x in zip(*found, strict=True))
            if len(query):
                stack.append((level + 1, query, node, left))


def near_pairs(queries: Words, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, word) that differ by one letter, each pair of words from one side only."""
    trie = Trie(words.path)
    letters = queries.blocks(), words.blocks()
    out = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for query, leaf in trie.reached(queries.path):
        size = trie.leaf[leaf + 1] - trie.leaf[leaf]
        for part in np.array_split(np.arange(len(query)), max(1, int(size.sum()) // BLOCK + 1)):
            if not len(part):
                continue
            n = size[part]
            q = np.repeat(query[part], n)
            first = np.repeat(trie.leaf[leaf[part]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            w = trie.order[first + np.arange(len(q))]
            good = verified(queries, words, letters, q, w)
            out.append((q[good], w[good]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


_LOW, _HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)
_EIGHT, _TOP = np.uint64(8), np.uint64(56)


def _block(letters: list[np.ndarray], k: int, which: np.ndarray) -> np.ndarray:
    return letters[k][which] if k < len(letters) else np.zeros(len(which), np.uint64)


def verified(queries: Words, words: Words, letters, q: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Which pairs differ by exactly one letter; the query's is the smaller one if all counts are equal."""
    good = np.zeros(len(q), bool)
    long_q, long_w = queries.length[q], words.length[w]
    short = np.flatnonzero((long_w == long_q) & (long_w <= WIDE))
    if len(short):
        a, b = q[short], w[short]
        unequal = np.zeros(len(short), np.uint8)
        less = np.zeros(len(short), bool)
        for k in range(-(-int(long_w[short].max()) // 8)):
            x, y = _block(letters[0], k, a), _block(letters[1], k, b)
            d = x ^ y
            unequal += np.bitwise_count((((d & _LOW) + _LOW) | d) & _HIGH)
            less |= x < y  # of the only unequal letter, where there is one only
        one = np.flatnonzero(unequal == 1)
        equal = (queries.path[a[one]] == words.path[b[one]]).all(axis=1)
        good[short[one]] = ~equal | less[one]
    longer = np.flatnonzero((long_w == long_q + 1) & (long_w <= WIDE))
    if len(longer):
        a, b = q[longer], w[longer]
        fine, before = np.ones(len(longer), bool), np.ones(len(longer), bool)
        for k in range(-(-int(long_w[longer].max()) // 8)):
            x, y, z = _block(letters[0], k, a), _block(letters[1], k, b), _block(letters[1], k + 1, b)
            d = x ^ y
            lowest = d & (~d + np.uint64(1))
            # letters from the first unequal one on, in the block where it stands; all letters in later blocks
            behind = np.zeros(len(d), np.uint64)
            bit = np.bitwise_count(lowest - np.uint64(1)) & np.uint8(0x38)
            here = before & (d != 0)
            behind[here] = ~((np.uint64(1) << bit[here].astype(np.uint64)) - np.uint64(1))
            behind[~before] = ~np.uint64(0)
            fine &= ((x ^ ((y >> _EIGHT) | (z << _TOP))) & behind) == 0
            before &= d == 0
        good[longer] = fine
    for k in np.flatnonzero(long_w > WIDE):
        x, y = queries.bytes_of(q[k]), words.bytes_of(w[k])
        i = next((j for j, (c, d) in enumerate(zip(x, y, strict=False)) if c != d), len(x))
        if len(x) == len(y):
            good[k] = i < len(x) and x[i + 1 :] == y[i + 1 :]
            if good[k] and (queries.path[q[k]] == words.path[w[k]]).all():
                good[k] = x[i] < y[i]
        else:
            good[k] = x[i:] == y[i + 1 :]
    return good


# ---------------------------------------------------------------- parts of the trie


class Top:
    """The nodes above the parts: per level the sorted keys (node above, count) of those that are cut further."""

    SPAN = 1 << 32

    def __init__(self) -> None:
        self.levels: list[np.ndarray] = []
        self.before = [1]

    def grow(self, keys: np.ndarray) -> None:
        self.levels.append(np.sort(keys))
        self.before.append(self.before[-1] + len(keys))

    def _go(self, level: int, node: np.ndarray, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The keys of the children, and their numbers where they are nodes of the top (else -1)."""
        key = node * self.SPAN + want
        if level >= len(self.levels) or not len(self.levels[level]):
            return key, np.full(len(key), -1)
        keys = self.levels[level]
        at = np.searchsorted(keys, key)
        hit = keys[np.minimum(at, len(keys) - 1)] == key
        return key, np.where(hit, self.before[level] + at, -1)

    def home(self, path: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The key of each word's part; with ``levels`` only of words that lie below as many nodes, others -1."""
        out, node = np.full(len(path), -1), np.zeros(len(path), np.int64)
        for level in range(path.shape[1] if levels is None else levels + 1):
            going = np.flatnonzero(node >= 0)
            key, child = self._go(level, node[going], path[going, level])
            final = child < 0 if levels is None and level + 1 < path.shape[1] else np.full(len(going), level == (levels or level))
            if levels is None or level == levels:
                out[going[final]] = key[final]
            node[going] = np.where(final, -1, child)
        return out

    def reached(self, path: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries and the keys of the parts their budgets reach."""
        n = len(path)
        query, node, left, out = np.arange(n), np.zeros(n, np.int64), np.full(n, 2), []
        for level in range(path.shape[1]):
            found = []
            for which, want, rest in stepped(level, path[query, level], left):
                fine = want >= 0
                which, want, rest = which[fine], want[fine], rest[fine]
                key, child = self._go(level, node[which], want)
                end = (child < 0) | (level + 1 == path.shape[1])
                out.append((query[which[end]], key[end]))
                found.append((query[which[~end]], child[~end], rest[~end]))
            query, node, left = (np.concatenate(x) for x in zip(*found, strict=True))
            if not len(query):
                break
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _summed(words: DataFrame, make, schema: str) -> DataFrame:
    """Rows (key, n) made per batch of words, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, n = make(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])

    return words.mapInArrow(run, schema).groupBy("key").agg(F.sum("n").alias("n"))


def _counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(keys, return_counts=True)


def near(vocabulary: DataFrame, groups: int = GROUPS, part_words: int = PART_WORDS,
         part_queries: int = PART_QUERIES) -> DataFrame:
    """``word``, ``n_near`` and ``best`` (``minus_n``, ``word`` of the most frequent near word) of words that have any.

    ``vocabulary`` has distinct ``word`` and ``n`` and is read several times.
    """
    words = vocabulary.select("word", "n")
    slim = words.select("word")
    letters = _summed(slim, lambda w: _counts(np.frombuffer("".join(w.to_pylist()).encode("latin-1"), np.uint8)), "key long, n long")
    seen = np.zeros(256)
    for r in letters.collect():
        seen[r.key] = r.n
    group = dealt_letters(seen, groups)
    total = words.count()
    bound = max(part_words, total // MOST_NODES)
    top, pieces = Top(), {}
    for level in range(groups + 1):
        below = _summed(
            slim,
            lambda w, level=level: _counts((k := top.home(Words(w, group, groups).path, level))[k >= 0]),
            "key long, n long",
        )
        found = {r.key: r.n for r in below.where(F.col("n") > bound).collect()}
        if not found:
            break
        if level == groups:
            pieces = {k: -(-n // bound) for k, n in found.items()}
        else:
            top.grow(np.array(list(found), np.int64))
    asked = _summed(slim, lambda w: _counts(top.reached(Words(w, group, groups).path)[1]), "key long, n long")
    turns = {r.key: -(-r.n // part_queries) for r in asked.where(F.col("n") > part_queries).collect()}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every word once as a word (``query`` false) and as a query for the parts within reach."""
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 15):
                part = batch.slice(at, 1 << 15)
                path = Words(part.column(0), group, groups).path
                query, key = top.reached(path)
                who = np.concatenate([np.arange(part.num_rows), query])
                key = np.concatenate([top.home(path), key])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key),
                        pa.array(np.arange(len(who)) >= part.num_rows),
                        part.column(0).take(pa.array(who)),
                        part.column(1).take(pa.array(who)),
                    ],
                    ["key", "query", "word", "n"],
                )

    parts = words.mapInArrow(dealt, "key long, query boolean, word string, n long")
    tile = F.lit(0)
    if pieces or turns:
        cut = parts.sparkSession.createDataFrame(
            [(k, pieces.get(k, 1), turns.get(k, 1)) for k in pieces.keys() | turns.keys()], "key long, p int, t int"
        )
        parts = parts.join(F.broadcast(cut), "key", "left").withColumns({"p": F.coalesce("p", F.lit(1)), "t": F.coalesce("t", F.lit(1))})
        mine = F.pmod(F.xxhash64("word"), F.when(F.col("query"), F.col("t")).otherwise(F.col("p"))).cast("int")
        others = F.sequence(F.lit(0), F.when(F.col("query"), F.col("p")).otherwise(F.col("t")) - 1)
        parts = parts.withColumn("mine", mine).withColumn("other", F.explode(others))
        tile = F.when(F.col("query"), F.col("mine") + F.col("t") * F.col("other")).otherwise(F.col("other") + F.col("t") * F.col("mine"))
    parts = parts.select("key", tile.alias("tile"), "query", "word", "n")

    def searched(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks = table.column("query")
        sides = [table.filter(asks), table.filter(pc.invert(asks))]
        names = [(s.column("word").combine_chunks() if s.num_rows else pa.array([], pa.string())) for s in sides]
        schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("minus_n", pa.int64()), ("best", pa.string())])
        if not sides[0].num_rows or not sides[1].num_rows:
            return schema.empty_table()
        a, b = near_pairs(Words(names[0], group, groups), Words(names[1], group, groups))
        if not len(a):
            return schema.empty_table()
        both = pa.concat_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in names])
        n = np.concatenate([s.column("n").to_numpy() for s in sides])
        one, other = np.concatenate([a, b + len(names[0])]), np.concatenate([b + len(names[0]), a])
        used, at = np.unique(other, return_inverse=True)
        texts = both.take(pa.array(used)).to_pylist()
        place = np.empty(len(used), np.int64)
        place[sorted(range(len(used)), key=lambda i: (-n[used[i]], texts[i]))] = np.arange(len(used))
        order = np.lexsort((place[at], one))
        one, other = one[order], other[order]
        first = np.flatnonzero(np.concatenate([[True], one[1:] != one[:-1]]))
        count = np.diff(np.append(first, len(one)))
        return pa.Table.from_arrays(
            [both.take(pa.array(one[first])), pa.array(count), pa.array(-n[other[first]]), both.take(pa.array(other[first]))],
            schema=schema,
        )

    found = parts.groupBy("key", "tile").applyInArrow(searched, "word string, n_near long, minus_n long, best string")
    best = F.min(F.struct("minus_n", F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best"))


def rooted(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, the last word that is reached from ``word`` over ``form``; paths double in each turn."""
    up = stored(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = up.join(on, "root", "left")
        up = stored(
            joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots"
        )
        if up.where("moved").isEmpty():
            return up.select("word", "root")
        up = up.select("word", "root")


def grouped(vocabulary: DataFrame, times: int = TIMES, **how: int) -> DataFrame:
    """Distinct words ``word`` with counts ``n`` get ``form``, ``root``, ``n_near`` and ``form_n``."""
    vocabulary = stored(vocabulary.select("word", "n"), "spelling-words")
    found = near(vocabulary, **how)
    good = F.col("best")["minus_n"] * -1 >= F.col("n") * times
    rows = stored(
        vocabulary.join(found, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(good, F.col("best")["word"]).alias("form"),
            F.when(good, -F.col("best")["minus_n"]).alias("form_n"),
        ),
        "spelling-forms",
    )
    roots = rooted(rows.where("form is not null").select("word", "form"))
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The words of all documents with their forms and roots."""
    return grouped(counted(docs, doc_id, text))
