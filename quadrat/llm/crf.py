"""Text quality from a linear-chain conditional random field over lines.

Every line of a text is good or bad. A line's features describe its words and characters, and those of the
line before and after it; the chain adds how labels follow each other. Forward-backward gives each line's
probability of being good, and a text's quality is their mean weighted by length.

Learning takes a bounded sample of labelled texts (``SAMPLE`` rows by hash, of at most ``SAMPLE_LINES``
lines each); their lines inherit the label. The conditional likelihood with a Gaussian prior is
maximised on the driver over the sample's features. All texts are then scored in one pass without a
shuffle, a few hundred at a time.

Defined results: a null text counts as empty, and an empty text is one empty line. Without labels of
both kinds all scores are 0.5. Repeated rows score alike; ids with several labels take the least.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import appended, remainder
from quadrat.llm.words import GOLDEN, mix, spans, text_bytes, word_hashes

#: Labelled texts learned from, at most, and the most lines such a text may have.
SAMPLE, SAMPLE_LINES = 6_000, 400
#: Steps of the optimiser, its rate, and the prior's weight per parameter.
ROUNDS, RATE, PRIOR = 220, 0.08, 1e-4

_KINDS = {
    "capital": [*range(65, 91)], "shout": [33], "bar": [124], "symbol": [ord(c) for c in "#*$%&<>"],
    "digit": [*range(48, 58)], "stop": [ord(c) for c in ".,;:?"], "other": [*range(128, 256)], "quote": [34, 39, 40, 41],
}


def line_features(texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of features per line of each text, the lines' lengths in characters, and the bounds of each text."""
    raw, at = text_bytes(texts)
    n_texts = len(at) - 1
    breaks = np.flatnonzero(raw == 10)
    # a line begins where a text begins and after each line break
    begin = np.concatenate([at[:-1], breaks + 1])
    owner = np.concatenate([np.arange(n_texts), np.searchsorted(at, breaks, side="right") - 1])
    order = np.lexsort((begin, owner))
    begin, owner = begin[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(n_texts + 1))
    last = np.zeros(len(begin), bool)
    last[bounds[1:] - 1] = True
    end = np.empty_like(begin)
    end[:-1] = begin[1:] - 1
    end[last] = at[1:]

    def counted(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return (total[end] - total[begin]).astype(float)

    letters = np.zeros(256, np.int64)
    chars = counted((raw & 0xC0) != 0x80)
    kinds = []
    for codes in _KINDS.values():
        letters[:] = 0
        letters[codes] = 1
        kinds.append(counted(letters[raw]))
    word_begin, word_end, _ = spans(raw, at)
    hashes, _ = word_hashes(texts, lower=False)
    # an empty text or line begins where the next one does; the last that begins there has the word
    line = np.searchsorted(begin, word_begin, side="right") - 1
    m = len(begin)
    n_words = np.bincount(line, minlength=m).astype(float)
    word_chars = np.bincount(line, weights=word_end - word_begin, minlength=m)
    same = np.zeros(len(line))
    if len(line) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    with np.errstate(over="ignore"):
        pairs = np.unique(mix(line.astype(np.uint64) * GOLDEN + hashes), return_index=True)[1]
    distinct = np.bincount(line[pairs], minlength=m)
    repeats = np.bincount(line, weights=same, minlength=m)
    words = np.maximum(n_words, 1)
    # lines with the same words as an earlier line of the text
    digest = np.zeros(m, np.uint64)
    with np.errstate(over="ignore"):
        np.add.at(digest, line, mix(hashes + GOLDEN))
        _, first = np.unique(mix(digest + owner.astype(np.uint64) * GOLDEN), return_index=True)
    again = np.ones(m)
    again[first] = 0
    again[n_words == 0] = 0
    own = np.stack(
        [np.log1p(n_words), np.minimum(word_chars / words, 30) / 10, repeats / words, distinct / words, again, n_words == 0]
        + [np.minimum(k / words, 5) for k in kinds],
        axis=1,
    )
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    starts = np.zeros(m)
    starts[bounds[:-1]] = 1
    before[bounds[:-1]] = 0
    after[bounds[1:] - 1] = 0
    out = np.concatenate([own, before, after, starts[:, None], last[:, None]], axis=1)
    return out.astype(np.float32), chars + 1, bounds


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    links: np.ndarray  # [label before, label], log potentials; label 1 is good

    def unary(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weight + self.bias


def _steps(bounds: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Texts by falling length, and for each position the lines there."""
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    longest = int(size.max()) if len(size) else 0
    alive = np.searchsorted(-size[order], -np.arange(longest), side="left")
    return order, [bounds[:-1][order[:k]] + t for t, k in enumerate(alive)]


def marginals(unary: np.ndarray, links: np.ndarray, bounds: np.ndarray):
    """Probability of good per line, expected links (2 x 2), by scaled forward-backward over all texts at once."""
    _, steps = _steps(bounds)
    shift = links.max()
    follow = np.exp(links - shift)
    own = np.stack([np.exp(-np.maximum(unary, 0)), np.exp(np.minimum(unary, 0))], axis=1)
    forward = np.empty_like(own)
    for t, lines in enumerate(steps):
        a = own[lines] if t == 0 else (forward[lines - 1] @ follow) * own[lines]
        forward[lines] = a / a.sum(axis=1, keepdims=True)
    backward = np.ones_like(own)
    expected = np.zeros((2, 2))
    for t in range(len(steps) - 1, 0, -1):
        lines = steps[t]
        message = own[lines] * backward[lines]
        joint = forward[lines - 1][:, :, None] * follow[None] * message[:, None, :]
        expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        b = message @ follow.T
        backward[lines - 1] = b / b.sum(axis=1, keepdims=True)
    p = forward * backward
    return p[:, 1] / p.sum(axis=1), expected


def fitted(x: np.ndarray, y: np.ndarray, bounds: np.ndarray) -> Model | None:
    """Maximise the conditional likelihood of the lines' labels ``y``; None without both labels."""
    if not len(y) or y.min() == y.max():
        return None
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = ((x - mean) / scale).astype(float)
    inner = np.ones(len(y), bool)
    inner[bounds[:-1]] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[np.flatnonzero(inner) - 1], y[inner]), 1)
    n = len(y)
    theta = np.zeros(z.shape[1] + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, ROUNDS + 1):
        p, expected = marginals(z @ theta[:-5] + theta[-5], theta[-4:].reshape(2, 2), bounds)
        miss = y - p
        g = np.concatenate([z.T @ miss, [miss.sum()], (seen - expected).ravel()]) / n - PRIOR * theta
        # Adam
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        theta = theta + RATE * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Model(mean, scale, theta[:-5], float(theta[-5]), theta[-4:].reshape(2, 2))


def qualities(texts, model: Model | None) -> np.ndarray:
    """Quality of each text: mean probability of its lines, by length."""
    x, chars, bounds = line_features(texts)
    if model is None:
        return np.full(len(bounds) - 1, 0.5)
    p, _ = marginals(model.unary(x), model.links, bounds)
    at = bounds[:-1]
    return np.clip(np.add.reduceat(p * chars, at) / np.add.reduceat(chars, at), 0, 1)


def learned(df: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, sample: int) -> Model | None:
    """Fit to the texts of at most ``sample`` labelled rows (``labels`` holds those to learn from)."""
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("key")).agg(F.min(label).cast("int").alias("label"))
        .orderBy(F.xxhash64("key"), "key").limit(sample)
    )
    slim = df.select(F.col(f"`{doc_id}`").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    slim = slim.where(F.length("text") - F.length(F.translate("text", "\n", "")) < SAMPLE_LINES)

    def features(texts):
        x, _, bounds = line_features(texts)
        return [np.diff(bounds), [x[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]]

    some = slim.join(F.broadcast(chosen), "key").orderBy(F.xxhash64("key"), "key").limit(sample)
    table = appended(some.select("key", "label", "text"), features, "lines int, x binary", ["text"], ["text"]).toArrow()
    if not table.num_rows:
        return None
    table = table.sort_by("key")
    n = table["lines"].to_numpy()
    x = np.frombuffer(b"".join(table["x"].to_pylist()), np.float32)
    return fitted(x.reshape(n.sum(), -1), np.repeat(table["label"].to_numpy(), n), np.concatenate([[0], np.cumsum(n)]))


def scored(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
           modulus: int = 3, held_out: int = 1, sample: int = SAMPLE) -> DataFrame:
    """Append ``held_out``, ``score`` and ``predicted``; labels of ids that leave ``held_out`` are not learned from."""
    kept = df.columns
    if clash := {c.lower() for c in kept} & {"held_out", "score", "predicted"}:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    model = learned(df, labels.where(remainder(doc_id, modulus) != held_out), doc_id, text, label, sample)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def make(texts):
        score = qualities(texts, sent.value)
        return [pa.array(score), (score >= 0.5).astype(np.int32)]

    out = df.withColumn("held_out", F.coalesce(remainder(doc_id, modulus) == held_out, F.lit(False)))
    return appended(out, make, "score double, predicted int", [text])
