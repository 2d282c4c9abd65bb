"""Counter-based random numbers as plain column expressions.

A value depends only on the seed, the stream name and the key columns, never on
partitioning, task order or retries, so a lost executor recomputes the same
draws. Steps run inside whole-stage codegen on primitive longs.

Two lanes work modulo two primes just below 2**31. A non-negative key below
2**62 is told apart by its pair of residues. After the last key both lanes take up
each other, so keys that agree in one residue only give unrelated numbers, and
the streams of two draws are not shifted copies. The expression grows by the same
length with each key.

A generator or a pushed-down filter evaluates an expression as often as it is
written out, a projection once. ``once`` keeps a drawn column in its projection.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lane moduli, multipliers and masks of the generator.
MODULI = (2147483647, 2147483629)
MULTIPLIERS = (
    (742938285, 950706376, 1226874159, 62089911),
    (1343714438, 1835413279, 784213963, 1107421741),
)
MASKS = (
    (625341585, 1592708710, 461845907, 668265263),
    (1013904242, 374761393, 1291169091, 1390208809),
)

DEFAULT_SEED = 1977


def stream_seed(seed: int, stream: str, lane: int) -> int:
    """Starting state of a lane; different stream names give independent numbers."""
    return zlib.crc32(f"{lane}/{seed}/{stream}".encode()) % MODULI[lane]


def _as_key(key) -> Column:
    if isinstance(key, int):
        return F.lit(key).cast("long")
    return (F.col(key) if isinstance(key, str) else key).cast("long")


def _step(state: Column, lane: int, i: int) -> Column:
    masked = state.bitwiseXOR(F.lit(MASKS[lane][i]).cast("long"))
    return (masked * F.lit(MULTIPLIERS[lane][i]).cast("long")) % F.lit(MODULI[lane]).cast("long")


def _lanes(keys, seed: int, stream: str) -> tuple[Column, Column]:
    states = []
    for lane, modulus in enumerate(MODULI):
        state = F.lit(stream_seed(seed, stream, lane)).cast("long")
        for key in keys:
            state = _step(_step(state + F.pmod(_as_key(key), F.lit(modulus).cast("long")), lane, 0), lane, 1)
        states.append(state)
    a, b = states
    # each lane takes up the other, by a map that loses nothing
    mixed = (a + b) % F.lit(MODULI[0]).cast("long"), (a * F.lit(2).cast("long") + b) % F.lit(MODULI[1]).cast("long")
    return tuple(_step(_step(state, lane, 2), lane, 3) for lane, state in enumerate(mixed))


def text_key(text) -> Column:
    """Integer key of a string, from its md5 digest; it has 60 bits."""
    return F.conv(F.substring(F.md5(F.col(text) if isinstance(text, str) else text), 1, 15), 16, 10).cast("long")


def as_key(df: DataFrame, name: str) -> Column:
    """Key of a column by its type: strings by ``text_key``, integers as they are."""
    return text_key(f"`{name}`") if df.schema[name].dataType.typeName() == "string" else F.col(f"`{name}`")


def once(value: Column) -> Column:
    """The same number, evaluated where it is projected: filters above do not repeat its expression."""
    return value + F.monotonically_increasing_id() * F.lit(0.0)


def uniform(*keys, seed: int = DEFAULT_SEED, stream: str = "u") -> Column:
    """Uniform on (0, 1), one value per distinct key tuple."""
    high, low = _lanes(keys, seed, stream)
    return (high + (low + F.lit(0.5)) / F.lit(float(MODULI[1]))) / F.lit(float(MODULI[0]))


def array_uniform(seed: int = DEFAULT_SEED, stream: str = "u"):
    """The same numbers as ``uniform`` for integer arrays that broadcast together.

    Returns a self-contained function of (numpy, *keys) that tasks can carry.
    """
    moduli, multipliers, masks = MODULI, MULTIPLIERS, MASKS
    starts = tuple(stream_seed(seed, stream, lane) for lane in (0, 1))

    def of(np, *keys):
        def step(state, lane, i):
            return (state ^ masks[lane][i]) * multipliers[lane][i] % moduli[lane]

        states = [np.int64(s) for s in starts]
        for key in keys:
            states = [step(step(states[lane] + key % moduli[lane], lane, 0), lane, 1) for lane in (0, 1)]
        a, b = states
        mixed = (a + b) % moduli[0], (2 * a + b) % moduli[1]
        ends = [step(step(state, lane, 2), lane, 3) for lane, state in enumerate(mixed)]
        return (ends[0] + (ends[1] + 0.5) / float(moduli[1])) / float(moduli[0])

    return of


def std_normal(*keys, seed: int = DEFAULT_SEED, stream: str = "n") -> Column:
    """Standard normal by the Box-Muller transform, radius and angle from one lane each."""
    first, second = (
        (lane + F.lit(0.5)) / F.lit(float(m)) for lane, m in zip(_lanes(keys, seed, stream), MODULI, strict=True)
    )
    return F.sqrt(F.lit(-2.0) * F.ln(first)) * F.cos(F.lit(2 * math.pi) * second)


def normal(mu, sd, *keys, seed: int = DEFAULT_SEED, stream: str = "n") -> Column:
    """Normal draws; ``mu`` and ``sd`` are numbers or columns."""
    return F.lit(mu) + F.lit(sd) * std_normal(*keys, seed=seed, stream=stream)


def lognormal(mu, sd, *keys, seed: int = DEFAULT_SEED, stream: str = "n") -> Column:
    return F.exp(normal(mu, sd, *keys, seed=seed, stream=stream))


def exponential(rate, *keys, seed: int = DEFAULT_SEED, stream: str = "e") -> Column:
    return -F.ln(uniform(*keys, seed=seed, stream=stream)) / F.lit(rate)
