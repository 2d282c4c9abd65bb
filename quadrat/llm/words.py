"""Words and shingles of whole texts as flat numpy arrays, for use inside tasks.

A word is a run of characters other than space, tab, line feed, vertical tab, form feed and
carriage return; A-Z are lower-cased, all other letters stay. Words are known by a 64-bit hash of
their UTF-8 bytes, shingles by a 64-bit mix of the hashes of their words. All work is done on whole
columns of bytes; no Python object is made per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd 64-bit multipliers of the mixing functions (fixed values).
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
#: Masks that keep the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


def text_bytes(texts) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each text begins and ends (null: empty)."""
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string(), from_pandas=True)
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def spans(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and where each text's words begin and end among them."""
    word = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
    edge = np.zeros(len(raw) + 1, bool)
    edge[at] = True
    begins = np.flatnonzero(word & (edge[:-1] | ~np.concatenate([[False], word[:-1]])))
    ends = np.flatnonzero(word & (edge[1:] | ~np.concatenate([word[1:], [False]]))) + 1
    return begins, ends, np.searchsorted(begins, at)


def word_hashes(texts, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words begin and end.

    Text ``i`` owns ``hashes[bounds[i]:bounds[i + 1]]``; a null text owns none.
    """
    raw, at = text_bytes(texts)
    begins, ends, bounds = spans(raw, at)
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    if lower:
        padded += ((padded >= 65) & (padded <= 90)).astype(np.uint8) << np.uint8(5)
    eights = np.lib.stride_tricks.as_strided(padded[:8].view("<u8"), (len(raw) + 1,), (1,))
    length = ends - begins
    out = np.empty(len(begins), np.uint64)
    with np.errstate(over="ignore"):
        out[:] = mix(length.astype(np.uint64) * GOLDEN)
        open_, done = np.arange(len(begins)), 0
        while len(open_):
            left = length[open_] - done
            piece = eights[begins[open_] + done] & _FIRST[np.minimum(left, 8)]
            out[open_] = mix((out[open_] ^ piece) * MIX_A + GOLDEN)
            open_ = open_[left > 8]
            done += 8
    return out, bounds


def runs(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` words in the flat array (runs may cross texts)."""
    n = max(0, len(words) - width + 1)
    out = np.full(n, np.uint64(width))
    with np.errstate(over="ignore"):
        for k in range(width):
            out *= GOLDEN
            out += words[k : k + n]
        return mix(out)


def shingle_sets(words: np.ndarray, bounds: np.ndarray, width: int) -> list[np.ndarray]:
    """Per text the sorted distinct hashes of its runs of ``width`` words.

    A text with fewer words has one: all its words as a run. A text without words has none.
    """
    flat = runs(words, width)
    out = []
    for b, e in zip(bounds[:-1], bounds[1:], strict=True):
        n = e - b
        out.append(np.unique(flat[b : e - width + 1]) if n >= width else runs(words[b:e], n) if n else words[:0])
    return out


def signed(x: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark's long."""
    return x.view(np.int64)
