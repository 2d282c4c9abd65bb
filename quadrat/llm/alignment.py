"""Which tokens of two tokenizers cover each other, by interval coalescing.

Both tokenizers cut the same bytes (a space and the text) into tokens, so every token is an interval. All tokens of both
are sorted by where they start (``lexsort``), the running maximum of their ends (``maximum.accumulate``) is carried along,
and a group ends where a token starts at that maximum: there a token of either side ends. Inside a group the last token
of each side is carried along in the same way; every token after the first of a group links with the other side's last
one, which gives every overlapping pair once.

Neither tokenizer joins letters with a space behind them. A text is therefore cut before every space that follows a
character other than white space, distinct pieces of a batch are tokenised and aligned once, and documents are put
together from the results of their pieces. All pieces of a batch are sorted and coalesced at once.

Links are then counted over the corpus: each document names its distinct pairs once, tasks add up before the shuffle.
Counts from a threshold on go to every task as sorted arrays of at most ``TABLE_PAIRS`` entries, the
threshold being the least power of two that allows it; the pairs below it, each in fewer documents than that, get
their counts by a join, which has no frequent key then. If the threshold is 2, what is not in the arrays has count 1.

Defined results: a text that is null or empty, or whose tokens' bytes of either side are not the space and the text
again, has no tokens: all numbers are 0, the groups an empty string, the digest an empty string. Special tokens'
strings are plain text. Rows are taken as they are, repeated or without identifier: each row counts as a document.
An empty table gives an empty table. Other columns stay; a taken name gets an underscore in front.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.llm.common import free_names, stored

#: Vocabulary files; they must stand under these paths on every executor.
PATH_A = "/opt/tokenizers/byte_bpe_50k.json"
PATH_B = "/opt/tokenizers/piece_bpe_32k.model"
#: How the byte-level tokenizer splits a text first (fixed value of the vocabulary).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes of text that are aligned at once, about (a longer text comes alone).
BATCH_BYTES = 4 << 20
#: Counted pairs that travel to every task.
TABLE_PAIRS = 4_000_000
#: A piece: white space, other characters, and what follows up to a space after a character that is not white space.
PIECE = re.compile(r"\s*\S+(?:[^\S ]\s*\S*)*|\s+")
#: Separators inside the written groups.
NEXT_GROUP, OTHER_SIDE, NEXT_TOKEN = ";", "|", ","

COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "groups", "groups_sha256")


def byte_letters() -> dict[str, int]:
    """Which letter stands for which byte in a byte-level vocabulary: printable ones for themselves, the rest in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class Side:
    """A tokenizer of pieces, with the bytes of every token and how its number is written."""

    def __init__(self, encode, tokens: list[bytes]) -> None:
        self.encode, self.bytes = encode, tokens
        self.size = len(tokens)
        self.length = np.array([len(t) for t in tokens], np.int64)

    def of(self, pieces: list[str], wanted: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens of all pieces in a row, their numbers per piece, and which pieces they spell."""
        found = self.encode(pieces)
        token = self.bytes.__getitem__
        right = np.fromiter((b"".join(map(token, ids)) == w for ids, w in zip(found, wanted, strict=True)), bool, len(pieces))
        count = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int64, int(count.sum())), count, right


@functools.lru_cache(maxsize=4)
def byte_level(path: str) -> Side:
    """The byte-level BPE of a JSON file. Its merges make tokens in the order of their numbers, so numbers are ranks."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    letters = byte_letters()
    ranks = {bytes(letters[c] for c in entry): i for entry, i in spec["model"]["vocab"].items() if entry not in special}
    made = [m if isinstance(m, str) else " ".join(m) for m in spec["model"]["merges"]]
    if any(spec["model"]["vocab"][m.replace(" ", "")] != 256 + k for k, m in enumerate(made)):
        raise ValueError(f"{path}: merges do not follow the numbers of the tokens")
    coder = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = [b""] * (max(spec["model"]["vocab"].values()) + 1)
    for entry, i in ranks.items():
        tokens[i] = entry
    return Side(lambda pieces: [coder.encode_ordinary(p) for p in pieces], tokens)


@functools.lru_cache(maxsize=4)
def piece_level(path: str) -> Side:
    """The sentence-piece BPE of a model file. It puts a space before its input, so pieces lose the one they begin with."""
    import sentencepiece

    coder = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [coder.id_to_piece(i) for i in range(coder.get_piece_size())]
    tokens = []
    for i, name in enumerate(names):
        if coder.is_byte(i):
            tokens.append(bytes([int(name[3:5], 16)]))
        elif coder.is_control(i) or coder.is_unknown(i):
            tokens.append(b"")
        else:
            tokens.append(name.replace("▁", " ").encode())
    if any("▁" in name.lstrip("▁") for name in names):
        raise ValueError(f"{path}: a piece holds a space behind a letter")
    space = coder.piece_to_id("▁")

    def encode(pieces: list[str]) -> list[list[int]]:
        found = coder.encode([p[1:] for p in pieces], num_threads=1)
        return [ids if len(p) > 1 else [space] for ids, p in zip(found, pieces, strict=True)]

    return Side(encode, tokens)


@functools.lru_cache(maxsize=4)
def _written(size: int) -> dict[str, np.ndarray]:
    """Per separator the fixed-width bytes of separator and number."""
    return {s: np.array([f"{s}{i}" for i in range(size)], "S") for s in (NEXT_GROUP, OTHER_SIDE, NEXT_TOKEN)}


def coalesced(start: np.ndarray, end: np.ndarray, side: np.ndarray):
    """Order of the tokens by start, where groups begin in it, and per place the last token of each side so far."""
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order]) if len(order) else end
    begins = np.ones(len(order), bool)
    begins[1:] = start[order][1:] >= reach[:-1]
    at = np.arange(len(order))
    last = [np.maximum.accumulate(np.where(side[order] == k, at, -1)) if len(order) else at for k in (0, 1)]
    return order, begins, last[0], last[1]


def aligned_pieces(pieces: list[str], a: Side, b: Side) -> dict[str, np.ndarray | list[bytes]]:
    """Per piece: whether it is spelt by both sides, its tokens, groups, links (as numbers) and written groups."""
    wanted = [p.encode() for p in pieces]
    ids, counts, rights = zip(*(s.of(pieces, wanted) for s in (a, b)), strict=True)
    right = rights[0] & rights[1]
    n = [np.where(right, c, 0) for c in counts]
    token = [i[np.repeat(right, c)] for i, c in zip(ids, counts, strict=True)]
    size = [s.length[t] for s, t in zip((a, b), token, strict=True)]
    stop = [np.cumsum(x) for x in size]
    owner = np.concatenate([np.repeat(np.arange(len(pieces)), k) for k in n])
    start = np.concatenate([e - x for e, x in zip(stop, size, strict=True)])
    side = np.repeat([0, 1], [len(t) for t in token])
    order, begins, last_a, last_b = coalesced(start, np.concatenate(stop), side)
    token, side, owner = np.concatenate(token)[order], side[order], owner[order]
    group = np.cumsum(begins)
    link = ~begins
    pair = token[last_a[link]] * b.size + token[last_b[link]]
    # groups in writing: tokens of the first side, then of the other
    by = np.argsort(group * 2 + side, kind="stable")
    t, s, g = token[by], side[by], group[by]
    new_group = np.concatenate([[True], g[1:] != g[:-1]]) if len(g) else np.zeros(0, bool)
    turned = ~new_group & np.concatenate([[False], s[1:] != s[:-1]]) if len(g) else new_group
    words = _written(max(a.size, b.size))
    text = words[NEXT_TOKEN][t]
    text[turned], text[new_group] = words[OTHER_SIDE][t[turned]], words[NEXT_GROUP][t[new_group]]
    # bytes of each entry without the padding
    width = np.char.str_len(text) if len(text) else np.zeros(0, np.int64)
    total = np.concatenate([[0], np.cumsum(width)])
    entries = np.concatenate([[0], np.cumsum(n[0] + n[1])])
    whole = text.tobytes().translate(None, b"\0")
    cuts = total[entries].tolist()
    return {
        "right": right,
        "n_a": n[0],
        "n_b": n[1],
        "n_groups": np.bincount(owner[begins], minlength=len(pieces)),
        "n_links": np.bincount(owner[link], minlength=len(pieces)),
        "pair": pair,
        "written": [whole[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)],
    }


def _ragged(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Places begin, begin + 1, ... of every run in a row."""
    end = np.cumsum(count)
    return np.repeat(begin - (end - count), count) + np.arange(int(end[-1]) if len(end) else 0)


def aligned_texts(texts: list[str | None], a: Side, b: Side) -> list[tuple]:
    """Per text: numbers of tokens, groups and links, written groups, distinct links as numbers and how often."""
    index: dict[str, int] = {}
    flat, bounds = [], [0]
    for text in texts:
        if text:
            flat += [index.setdefault(p, len(index)) for p in PIECE.findall(" " + text)]
        bounds.append(len(flat))
    done = aligned_pieces(list(index), a, b)
    flat, bounds = np.array(flat, np.int64), np.array(bounds)

    def added(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values[flat])])
        return total[bounds[1:]] - total[bounds[:-1]]

    wrong = added(~done["right"]) > 0
    if wrong.any():
        keep = ~np.repeat(wrong, np.diff(bounds))
        lengths = np.where(wrong, 0, np.diff(bounds))
        flat, bounds = flat[keep], np.concatenate([[0], np.cumsum(lengths)])
    n_a, n_b, n_groups, n_links = (added(done[k]) for k in ("n_a", "n_b", "n_groups", "n_links"))
    first = np.cumsum(done["n_links"]) - done["n_links"]
    pair = done["pair"][_ragged(first[flat], done["n_links"][flat])]
    key, times = np.unique((np.repeat(np.arange(len(texts)), n_links) << 32) + pair, return_counts=True)
    cut = np.searchsorted(key >> 32, np.arange(len(texts) + 1))
    pair = key & 0xFFFFFFFF
    out = []
    written = done["written"]
    for i in range(len(texts)):
        groups = b"".join([written[k] for k in flat[bounds[i] : bounds[i + 1]].tolist()])[1:]
        here = slice(cut[i], cut[i + 1])
        out.append((int(n_a[i]), int(n_b[i]), int(n_groups[i]), int(n_links[i]), groups, pair[here], times[here]))
    return out


def _batches(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """Texts in portions of about ``BATCH_BYTES``, with their place."""
    part, size, at = [], 0, 0
    for i, text in enumerate(column):
        text = text.as_py()
        part.append(text)
        size += len(text or "") + 1
        if size > BATCH_BYTES:
            yield at, part
            part, size, at = [], 0, i + 1
    if part:
        yield at, part


def _lists(parts: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    flat = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.astype(kind.to_pandas_dtype()), kind))


def with_links(docs: DataFrame, text: str = "text", keep_text: bool = True, keep_groups: bool = True, path_a: str = PATH_A,
               path_b: str = PATH_B) -> tuple[DataFrame, dict[str, str]]:
    """Append the numbers, groups and links of each row; also the names of the new columns by their usual ones."""
    stay = [i for i, c in enumerate(docs.columns) if keep_text or c != text]
    wanted = [c for c in (*COLUMNS, "pairs", "times") if keep_groups or c != "groups"]
    names = dict(zip(wanted, free_names([docs.columns[i] for i in stay], *wanted), strict=True))
    narrow = byte_level(path_a).size * piece_level(path_b).size < 1 << 31
    code = pa.int32() if narrow else pa.int64()
    kinds = {"groups": "string", "groups_sha256": "string", "pairs": f"array<{'int' if narrow else 'bigint'}>", "times": "array<int>"}
    fields = [T.StructField(names[c], T._parse_datatype_string(kinds.get(c, "bigint"))) for c in wanted]
    schema = T.StructType([docs.schema.fields[i] for i in stay] + fields)
    at_text = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = byte_level(path_a), piece_level(path_b)
        for batch in batches:
            for at, texts in _batches(batch.column(at_text)):
                part = batch.slice(at, len(texts))
                rows = list(zip(*aligned_texts(texts, a, b), strict=True))
                made = {c: pa.array(rows[k], pa.int64()) for k, c in enumerate(COLUMNS[:4])}
                if keep_groups:
                    made["groups"] = pa.array([g.decode() for g in rows[4]], pa.string())
                made["groups_sha256"] = pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in rows[4]], pa.string())
                made["pairs"] = _lists(rows[5], code)
                made["times"] = _lists(rows[6], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(i) for i in stay] + [made[c] for c in wanted], schema.names)

    return docs.mapInArrow(run, schema), names


def pair_counts(linked: DataFrame, pairs: str = "pairs") -> DataFrame:
    """``pair`` and ``n``: in how many rows each pair of tokens is linked."""
    return linked.select(F.explode(pairs).alias("pair")).select(F.col("pair").cast("long")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def aligned(docs: DataFrame, text: str = "text", keep_text: bool = True, keep_groups: bool = True, path_a: str = PATH_A,
            path_b: str = PATH_B, table_pairs: int = TABLE_PAIRS) -> DataFrame:
    """Append tokens, groups and links of each row, and how often its links occur in the corpus.

    ``n_best`` links have the highest count of their A token, ``count_sum`` adds the counts of all links.
    ``groups`` spells the groups: A tokens by commas, a bar, B tokens by commas, groups by semicolons.
    """
    linked, names = with_links(docs, text, keep_text, keep_groups, path_a, path_b)
    (row,) = free_names(linked.columns, "row_number")
    linked = stored(linked.withColumn(row, F.monotonically_increasing_id()), "alignment-links")
    counts = stored(pair_counts(linked, names["pairs"]), "alignment-counts")
    width = piece_level(path_b).size
    best = counts.groupBy((F.col("pair") / width).cast("long").alias("a")).agg(F.max("n").alias("n"))
    most = np.zeros(byte_level(path_a).size, np.int64)
    for r in best.collect():  # one row per token of A
        most[r.a] = r.n
    by_size = counts.groupBy(F.floor(F.log2("n")).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = {r.k: r.n for r in by_size}
    power = next(k for k in range(64) if sum(n for j, n in sizes.items() if j >= k) <= table_pairs)
    table = counts.where(F.col("n") >= 1 << power).toArrow()
    order = np.argsort(table["pair"].to_numpy())
    sent = linked.sparkSession.sparkContext.broadcast(
        (table["pair"].to_numpy()[order].astype(np.uint32), table["n"].to_numpy()[order], most)
    )
    at = [linked.columns.index(names[c]) for c in ("pairs", "times")]
    final = [names[c] for c in names if c not in ("pairs", "times")]
    base = [c for c in linked.columns if c not in {*names.values(), row}]
    n_best, count_sum = free_names([*base, *final], "n_best", "count_sum")
    stay = [linked.columns.index(c) for c in [row, *base, *final]]
    new = [T.StructField(n_best, T.LongType()), T.StructField(count_sum, T.LongType())]
    schema = T.StructType([linked.schema.fields[i] for i in stay] + new)

    def looked_up(batch: pa.RecordBatch):
        """Links of a batch: row in it, number, times, count (1 where the arrays have none) and whether they have one."""
        pairs, table = [batch.column(i) for i in at], sent.value
        owner = np.repeat(np.arange(batch.num_rows), pairs[0].value_lengths().to_numpy(zero_copy_only=False))
        pair, times = (c.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in pairs)
        place = np.minimum(np.searchsorted(table[0], pair.astype(np.uint32)), max(0, len(table[0]) - 1))
        known = table[0][place] == pair if len(table[0]) else np.zeros(len(pair), bool)
        return owner, pair, times, np.where(known, table[1][place] if len(table[0]) else 1, 1), known

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = sent.value[2]
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                owner, pair, times, n, known = looked_up(batch)
                counted = known | (power <= 1)
                sums = [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
                np.add.at(sums[0], owner, times * (counted & (n == most[pair // width])))
                np.add.at(sums[1], owner, times * np.where(counted, n, 0))
                arrays = [batch.column(i) for i in stay] + [pa.array(s, pa.int64()) for s in sums]
                yield pa.RecordBatch.from_arrays(arrays, schema.names)

    out = linked.mapInArrow(judged, schema)
    if power > 1:

        def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for k in range(0, whole.num_rows, 1000):
                    batch = whole.slice(k, 1000)
                    owner, pair, times, _, known = looked_up(batch)
                    ids = batch.column(batch.schema.get_field_index(row)).to_numpy()[owner[~known]]
                    best_n = sent.value[2][pair[~known] // width]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, pa.int64()) for x in (ids, pair[~known], times[~known], best_n)], ["id", "pair", "times", "most"]
                    )

        asked = linked.mapInArrow(rare, "id long, pair long, times long, most long")
        joined = asked.join(counts.where(F.col("n") < 1 << power), "pair")
        more = joined.groupBy(F.col("id").alias(row)).agg(
            F.sum(F.when(F.col("n") == F.col("most"), F.col("times")).otherwise(0)).alias("more_best"),
            F.sum(F.col("times") * F.col("n")).alias("more_sum"),
        )
        more = more.select(F.col(row).alias("_of"), F.col("more_best").alias("_best"), F.col("more_sum").alias("_sum"))
        out = out.join(more, out[row] == more["_of"], "left").withColumns(
            {n_best: F.col(n_best) + F.coalesce("_best", F.lit(0)), count_sum: F.col(count_sum) + F.coalesce("_sum", F.lit(0))}
        )
    return out.select(*[F.col(f"`{c}`") for c in [*base, *final, n_best, count_sum]])
