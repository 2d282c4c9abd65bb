"""Checking SQL: text for the random columns and for small linear solves."""

from __future__ import annotations

from quadrat.functions.expr import NORMAL_CENTRE, NORMAL_MIDDLE, NORMAL_TAIL
from quadrat.functions.random import DEFAULT_SEED, MASKS, MODULI, MULTIPLIERS, stream_seed


def _lanes(keys: tuple[str, ...], seed: int, stream: str) -> tuple[str, str]:
    def step(state: str, lane: int, i: int) -> str:
        return f"((xor({state}, {MASKS[lane][i]}::BIGINT) * {MULTIPLIERS[lane][i]}) % {MODULI[lane]})"

    states = []
    for lane, m in enumerate(MODULI):
        state = f"{stream_seed(seed, stream, lane)}::BIGINT"
        for key in keys:
            state = step(step(f"({state} + ((({key})::BIGINT % {m}) + {m}) % {m})", lane, 0), lane, 1)
        states.append(state)
    mixed = f"(({states[0]} + {states[1]}) % {MODULI[0]})", f"((2 * {states[0]} + {states[1]}) % {MODULI[1]})"
    return tuple(step(step(state, lane, 2), lane, 3) for lane, state in enumerate(mixed))


def text_key(text: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 15))::BIGINT"


def uniform(*keys: str, seed: int = DEFAULT_SEED, stream: str = "u") -> str:
    high, low = _lanes(keys, seed, stream)
    return f"(({high} + ({low} + 0.5::DOUBLE) / {MODULI[1]}::DOUBLE) / {MODULI[0]}::DOUBLE)"


def std_normal(*keys: str, seed: int = DEFAULT_SEED, stream: str = "n") -> str:
    first, second = (
        f"(({lane} + 0.5::DOUBLE) / {m}::DOUBLE)" for lane, m in zip(_lanes(keys, seed, stream), MODULI, strict=True)
    )
    return f"(sqrt(-2.0::DOUBLE * ln({first})) * cos(2 * pi() * {second}))"


def exponential(rate: float, *keys: str, seed: int = DEFAULT_SEED, stream: str = "e") -> str:
    return f"(-ln({uniform(*keys, seed=seed, stream=stream)}) / {rate}::DOUBLE)"


def half_student_t3(scale: float, *keys: str, seed: int, stream: str) -> str:
    z = [std_normal(*keys, seed=seed, stream=f"{stream}.{i}") for i in range(4)]
    return f"abs({scale}::DOUBLE * {z[0]} / sqrt((pow({z[1]}, 2) + pow({z[2]}, 2) + pow({z[3]}, 2)) / 3))"


def inverse_normal(p: str) -> str:
    def rational(pair, r: str) -> str:
        parts = []
        for terms in pair:
            total = f"{terms[-1]!r}::DOUBLE"
            for c in reversed(terms[:-1]):
                total = f"({total} * {r} + {c!r}::DOUBLE)"
            parts.append(total)
        return f"{parts[0]} / {parts[1]}"

    q, tail = f"({p} - 0.5::DOUBLE)", f"sqrt(-ln(least({p}, 1 - {p})))"
    return (
        f"CASE WHEN abs({q}) <= 0.425 THEN {q} * ({rational(NORMAL_CENTRE, f'(0.180625::DOUBLE - {q} * {q})')}) "
        f"WHEN {tail} <= 5 THEN sign({q}) * ({rational(NORMAL_MIDDLE, f'({tail} - 1.6::DOUBLE)')}) "
        f"ELSE sign({q}) * ({rational(NORMAL_TAIL, f'({tail} - 5)')}) END"
    )


def sweep(start: str, m: int, p: int, tag: str) -> tuple[list[str], str]:
    """CTEs that sweep the first p columns of the symmetric m x m matrix in ``start``.

    ``start`` is a one-row relation with columns a_i_j. Afterwards the first block
    holds minus the inverse, a_j_{p+1} the regression of the last column on the
    first p, and a_{p+1}_{p+1} its residual.
    """
    ctes, name = [], start
    for k in range(1, p + 1):
        cols = []
        for i in range(1, m + 1):
            for j in range(1, m + 1):
                if i == k and j == k:
                    e = f"-1.0::DOUBLE / a_{k}_{k}"
                elif i == k:
                    e = f"a_{k}_{j} / a_{k}_{k}"
                elif j == k:
                    e = f"a_{i}_{k} / a_{k}_{k}"
                else:
                    e = f"a_{i}_{j} - a_{i}_{k} * a_{k}_{j} / a_{k}_{k}"
                cols.append(f"{e} AS a_{i}_{j}")
        ctes.append(f"{tag}{k} AS (SELECT {', '.join(cols)} FROM {name})")
        name = f"{tag}{k}"
    return ctes, name


def moment_matrix(cols: list[str], source: str) -> str:
    """SELECT of the centred cross products a_i_j of the columns."""
    parts = [
        f"(count(*) - 1) * covar_samp({x}, {y}) AS a_{i}_{j}"
        for i, x in enumerate(cols, 1)
        for j, y in enumerate(cols, 1)
    ]
    return f"SELECT {', '.join(parts)} FROM {source}"
