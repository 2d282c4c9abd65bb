"""Null rules, codes and small scalar expressions.

Aggregates skip nulls. Where the statistical convention counts a null instead
(distinct values, a condition on a null), the helper here says so.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def holds_or_null(condition: Column) -> Column:
    """True where the condition holds or is unknown: an unknown row is kept and counted."""
    return F.coalesce(condition, F.lit(True))


def n_distinct(c) -> Column:
    """Distinct count in which null is one more value."""
    c = as_col(c)
    return F.count_distinct(c) + F.coalesce(F.max(c.isNull().cast("long")), F.lit(0).cast("long"))


def n_distinct_where(c, condition: Column) -> Column:
    """Distinct values of ``c`` over rows where the condition holds or is unknown.

    A row with an unknown condition contributes the missing value, whatever its ``c``.
    """
    c = as_col(c)
    missing = (condition & c.isNull()) | condition.isNull()
    return F.count_distinct(F.when(condition, c)) + F.coalesce(
        F.max(F.coalesce(missing, F.lit(False)).cast("long")), F.lit(0).cast("long")
    )


def minutes_of_day(ts) -> Column:
    """Minutes since midnight, seconds as a fraction."""
    ts = as_col(ts)
    return F.hour(ts) * 60 + F.minute(ts) + F.second(ts) / F.lit(60.0)


def level_code(c, levels: Sequence[str]) -> Column:
    """1-based position in an explicit level order; null for a value outside it."""
    found = F.array_position(F.array(*[F.lit(v) for v in levels]), as_col(c))
    return F.nullif(found, F.lit(0)).cast("int")


def ratio(a, b) -> Column:
    """a / b, null where b is zero."""
    return as_col(a) / F.nullif(as_col(b), F.lit(0.0))


def missing_double() -> Column:
    return F.lit(None).cast("double")


def computed_once(columns: Mapping[str, Column]) -> Column:
    """Columns evaluated once per row, for use in a ``select``.

    Left alone, the optimizer copies an expression to every place that uses the
    column, and a long chain outgrows what the JVM compiles. A generator is not
    copied.
    """
    return F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()])))


# Coefficients of Wichura's algorithm AS 241 (PPND16), constant term first.
NORMAL_CENTRE = (
    (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457,
     67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
    (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867,
     39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
)
NORMAL_MIDDLE = (
    (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258,
     0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4),
    (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590,
     0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
)
NORMAL_TAIL = (
    (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930,
     0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
    (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4,
     1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
)


def _rational(pair, r):
    value = []
    for terms in pair:
        total = F.lit(terms[-1])
        for c in reversed(terms[:-1]):
            total = total * r + F.lit(c)
        value.append(total)
    return value[0] / value[1]


def inverse_normal(p: Column) -> Column:
    """Standard normal quantile at ``p`` in (0, 1), to about 1e-16 of itself (AS 241)."""
    q = p - 0.5
    tail = F.sqrt(-F.ln(F.least(p, 1 - p)))
    far = F.when(tail <= 5, _rational(NORMAL_MIDDLE, tail - 1.6)).otherwise(_rational(NORMAL_TAIL, tail - 5))
    return F.when(F.abs(q) <= 0.425, q * _rational(NORMAL_CENTRE, 0.180625 - q * q)).otherwise(F.signum(q) * far)
