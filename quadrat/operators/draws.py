"""Summaries of a long table of draws: (chain, iteration, variable, value).

The number of draws per variable is set by the sampler (chains x kept
iterations), not by the size of the data; the number of variables is not bounded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.functions import random as rnd
from quadrat.operators.describe import density, quantiles
from quadrat.operators.groups import attach_group_values
from quadrat.operators.ranks import average_ranks, normal_score

def keep_draws(draws: DataFrame, warmup: int, thin: int = 1) -> DataFrame:
    """Discard the warm-up and keep every ``thin``-th draw after it (iterations from 1)."""
    it = F.col("iteration")
    return draws.where((it > warmup) & ((it - warmup - 1) % thin == 0))


def select_variables(draws: DataFrame, pattern: str) -> DataFrame:
    """Draws of the variables whose name matches a regular expression."""
    return draws.where(F.col("variable").rlike(pattern))


def _wide_quantiles(draws: DataFrame, names: dict[str, float]) -> DataFrame:
    q = quantiles(draws, "value", list(names.values()), ["variable"])
    return q.groupBy("variable").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for n, p in names.items()]
    )


def summarise(draws: DataFrame) -> DataFrame:
    """Mean, sd and central 95 % interval per variable."""
    moments = draws.groupBy("variable").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    ends = _wide_quantiles(draws, {"lower": 0.025, "upper": 0.975})
    return moments.join(ends, "variable", "left").select("variable", "mean", "sd", "lower", "upper")


def intervals(draws: DataFrame, pattern: str | None = None) -> DataFrame:
    """Median, inner 50 % and outer 90 % interval per variable."""
    rows = select_variables(draws, pattern) if pattern else draws
    return _wide_quantiles(rows, {"ll": 0.05, "l": 0.25, "m": 0.5, "h": 0.75, "hh": 0.95})


def _placed(draws: DataFrame) -> DataFrame:
    """Draws with their place ``i`` in the chain, from 0, its length and its mean.

    Kept draws are evenly spaced, so the place follows from the iteration and no
    chain needs to be sorted.
    """
    chains = ["variable", "chain"]
    layout = draws.groupBy(*chains).agg(
        F.count("*").alias("len"),
        F.avg("value").alias("mu"),
        F.min("iteration").alias("first"),
        F.max("iteration").alias("last"),
    )
    step = (F.col("last") - F.col("first")) / F.nullif(F.col("len") - 1, F.lit(0))
    place = F.coalesce(F.round((F.col("iteration") - F.col("first")) / step), F.lit(0.0)).cast("long")
    rows = attach_group_values(draws, layout, chains, few=False)
    return rows.select(*chains, place.alias("i"), "len", "mu", "value")


def _halves(draws: DataFrame) -> DataFrame:
    """Draws with the half of their chain, 0 or 1; the middle draw of an odd chain is in neither."""
    half = F.floor(F.col("len") / 2)
    side = F.when(F.col("i") < half, 0).when(F.col("i") >= F.col("len") - half, 1)
    return _placed(draws).withColumn("side", side).where(F.col("side").isNotNull())


def _between_within(halves: DataFrame, name: str) -> DataFrame:
    """R-hat from ``n``, mean ``m`` and variance ``v`` of half chains."""
    per = halves.groupBy("variable").agg(
        F.avg("n").alias("n"), F.var_samp("m").alias("between"), F.avg("v").alias("within")
    )
    pooled = (F.col("n") - 1) / F.col("n") * F.col("within") + F.col("between")
    return per.select("variable", F.sqrt(pooled / F.nullif("within", F.lit(0.0))).alias(name))


def rhat(draws: DataFrame) -> DataFrame:
    """Split R-hat: every chain cut in halves, between against within variance.

    The middle draw of an odd chain belongs to neither half.
    """
    halves = _halves(draws).groupBy("variable", "chain", "side")
    halves = halves.agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v"))
    return _between_within(halves, "rhat")


def _rhat_of_scores(rows: DataFrame, value: str, name: str) -> DataFrame:
    """Split R-hat of the normal scores of the ranks of ``value`` over all chains of a variable."""
    ranked = average_ranks(rows, value, ["variable"], ["chain", "side"])
    scored = ranked.withColumn("z", normal_score(F.col("rank"), F.col("n")))
    c, z = F.col("c"), F.col("z")
    size, total = F.sum("c"), F.sum(c * z)
    halves = scored.groupBy("variable", "chain", "side").agg(
        size.alias("n"), (total / size).alias("m"), ((F.sum(c * z * z) - total * total / size) / F.nullif(size - 1, F.lit(0))).alias("v")
    )
    return _between_within(halves, name)


def rank_rhat(draws: DataFrame, digits: int = 9) -> DataFrame:
    """Rank-normalised split R-hat: ``bulk``, ``folded`` and the larger of both, ``rhat``.

    Draws are replaced by the normal scores of their average ranks over all chains; ``folded`` does the same for their
    distances from the median, which tells chains of unequal spread apart. Distances are rounded to ``digits``
    places, because the two middle draws are equally far from the median but for rounding.
    """
    rows = _halves(draws).select("variable", "chain", "side", "value")
    middle = quantiles(draws, "value", [0.5], ["variable"]).select("variable", F.col("value").alias("middle"))
    apart = attach_group_values(rows, middle, ["variable"], few=False)
    apart = apart.withColumn("apart", F.round(F.abs(F.col("value") - F.col("middle")), digits))
    bulk, folded = _rhat_of_scores(rows, "value", "bulk"), _rhat_of_scores(apart, "apart", "folded")
    return bulk.join(folded, "variable").select("variable", "bulk", "folded", F.greatest("bulk", "folded").alias("rhat"))


def _lag_products(draws: DataFrame, max_lag: int, block: int) -> DataFrame:
    """Sum of products of centred draws per variable, chain and lag, with length and mean.

    Chains are cut into blocks that also hold the next ``max_lag`` draws, so each
    window is bounded however long a chain is. Lagged values come from one
    window, not from a self-join.
    """
    if max_lag >= block:
        raise ValueError("max_lag must be smaller than block")
    chains = ["variable", "chain"]
    own = F.floor(F.col("i") / block)
    near = (F.col("i") % block < max_lag) & (own > 0)
    rows = _placed(draws).select(
        *chains,
        "i",
        "len",
        "mu",
        (F.col("value") - F.col("mu")).alias("d"),
        F.explode(F.when(near, F.array(own, own - 1)).otherwise(F.array(own))).alias("b"),
    )
    order = W.partitionBy(*chains, "b").orderBy("i")
    ahead = F.collect_list("d").over(order.rowsBetween(0, max_lag))
    rows = rows.withColumn("ahead", ahead).where(own == F.col("b"))
    pairs = rows.select(*chains, "len", "mu", "d", F.posexplode("ahead").alias("lag", "e"))
    return pairs.groupBy(*chains, "lag").agg(
        F.sum(F.col("d") * F.col("e")).alias("c"), F.max("len").alias("len"), F.max("mu").alias("mu")
    )


def autocorrelation(draws: DataFrame, max_lag: int = 20, block: int = 65536) -> DataFrame:
    """Autocorrelation per variable, chain and lag 0..max_lag of consecutive draws."""
    chains = ["variable", "chain"]
    sums = _lag_products(draws, max_lag, block)
    packed = sums.groupBy(*chains).agg(F.collect_list(F.struct("lag", "c")).alias("g"))
    c0 = F.array_min("g")["c"]
    return packed.select(*chains, c0.alias("c0"), F.inline("g")).select(
        *chains, "lag", (F.col("c") / F.nullif("c0", F.lit(0.0))).alias("rho")
    )


#: Chains or variables that a task turns into arrays at once.
_SLICE = 256


def _in_slices(run, names: str, types):
    """The function of pandas batches ``run`` as one of Arrow batches, which it gets and returns in slices of ``_SLICE`` rows."""
    names, rows = names.split(), _SLICE

    def sliced(batches):
        import pyarrow as pa

        schema = pa.schema(list(zip(names, types(pa), strict=True)))
        for batch in batches:
            for k in range(0, batch.num_rows, rows):
                for out in run([batch.slice(k, rows).to_pandas()]):
                    yield pa.RecordBatch.from_pandas(out[names], schema=schema, preserve_index=False)

    return sliced


def _lag_sums(block: int, lags: int):
    """Function of batches of blocks: sums of products of a block's draws with those that follow, at all lags below ``lags``."""

    def sums_of(d, own):
        import numpy as np

        width = 1 << int(len(d) + own).bit_length()
        turned = np.fft.rfft(d, width) * np.fft.rfft(d[:own], width).conj()
        cross = np.fft.irfft(turned, width)[:lags]
        out = np.zeros(lags)
        out[: len(cross)] = cross
        out[len(d) :] = 0.0
        return out

    def run(batches):
        for pdf in batches:
            sums, means = [], []
            for b, first, values in zip(pdf["b"], pdf["first"], pdf["x"], strict=True):
                means.append(values.mean())
                # a block of a longer chain comes centred; a whole chain is centred here
                d = values - means[-1] if b < 0 else values
                sums.append(sums_of(d, len(d) if b < 0 else min(len(d), (b + 1) * block - first)))
            out = pdf[["variable", "chain", "len", "mu"]].copy()
            out["mu"] = out["mu"].where(pdf["b"] >= 0, means)
            out["c"] = sums
            yield out

    return _in_slices(run, "variable chain len mu c", lambda pa: (pa.string(), pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64())))


def _sizes():
    """Function of batches of variables with the lag sums of their chains: effective sizes, and whether the lags settle them."""

    def size(n, means, c):
        import numpy as np

        m = len(means)
        acov = np.stack(c)[:, :n].mean(axis=0) / n
        lags = len(acov)
        total = acov[0] + (np.var(means, ddof=1) if m > 1 else 0.0)
        if not total > 0 or n < 2:
            return None, True
        rho = 1 - (acov[0] * n / (n - 1) - acov) / total
        rho[0] = 1.0
        pairs = rho[: lags - lags % 2].reshape(-1, 2).sum(axis=1)
        negative = np.flatnonzero(pairs < 0)
        done = bool(len(negative)) or lags >= n
        pairs = np.minimum.accumulate(pairs[: negative[0]] if len(negative) else pairs)
        return m * n / max(-1 + 2 * pairs.sum(), 1 / np.log10(m * n)), done

    def run(batches):
        import pandas as pd

        for pdf in batches:
            found = [size(int(n), means, c) for n, means, c in zip(pdf["n"], pdf["mu"], pdf["c"], strict=True)]
            out = pd.DataFrame({"variable": pdf["variable"], "ess": [f[0] for f in found], "complete": [f[1] for f in found]})
            yield out.astype({"ess": "float64", "complete": "bool"})

    return _in_slices(run, "variable ess complete", lambda pa: (pa.string(), pa.float64(), pa.bool_()))


def effective_size(draws: DataFrame, block: int = 65536) -> DataFrame:
    """Effective sample size over all chains of a variable.

    Autocovariances are summed in pairs of lags up to the first negative pair, each pair no larger than the one
    before it. Sums of lagged products come from Fourier transforms of blocks of a chain, each with
    the draws that follow it as far as the lags reach: a draw is copied once at most, whatever the number of lags. Chains
    of up to ``block`` draws are one block and have all lags. Longer ones start with half a block of lags; while the pairs
    of some variable have not turned negative, blocks and lags grow fourfold. All chains of a variable must
    have the same length; a variable without spread gets null.
    """
    longest = draws.groupBy("variable", "chain").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    lags = longest if longest <= block else block // 2
    chains = ["variable", "chain"]
    while True:
        if longest <= block:
            ordered = F.array_sort(F.collect_list(F.struct("iteration", "value")))
            rows = draws.groupBy(*chains).agg(ordered.alias("g")).select(
                *chains, F.size("g").cast("long").alias("len"), F.lit(0.0).alias("mu"), F.lit(-1).cast("long").alias("b"),
                F.lit(0).cast("long").alias("first"), F.transform("g", lambda e: e["value"]).alias("x"),
            )
        else:
            own = F.floor(F.col("i") / block)
            near = (F.col("i") % block < lags) & (own > 0) if lags < longest else F.lit(False)
            rows = _placed(draws).withColumn("b", F.explode(F.when(near, F.array(own, own - 1)).otherwise(F.array(own))))
            ordered = F.array_sort(F.collect_list(F.struct("i", (F.col("value") - F.col("mu")).alias("d"))))
            rows = rows.groupBy(*chains, "b").agg(F.max("len").alias("len"), F.max("mu").alias("mu"), ordered.alias("g"))
            rows = rows.select(*chains, "len", "mu", "b", F.col("g")[0]["i"].alias("first"), F.transform("g", lambda e: e["d"]).alias("x"))
        sums = rows.mapInArrow(_lag_sums(block, lags), "variable string, chain int, len long, mu double, c array<double>")
        if longest > block:
            one = sums.select(*chains, "len", "mu", F.posexplode("c").alias("lag", "s"))
            one = one.groupBy(*chains, "lag").agg(F.sum("s").alias("s"), F.max("len").alias("len"), F.max("mu").alias("mu"))
            packed = F.transform(F.array_sort(F.collect_list(F.struct("lag", "s"))), lambda e: e["s"])
            sums = one.groupBy(*chains).agg(F.max("len").alias("len"), F.max("mu").alias("mu"), packed.alias("c"))
        per = sums.groupBy("variable").agg(F.max("len").alias("n"), F.collect_list("mu").alias("mu"), F.collect_list("c").alias("c"))
        sized = per.mapInArrow(_sizes(), "variable string, ess double, complete boolean")
        if lags >= longest or sized.where(~F.col("complete")).isEmpty():
            return sized.select("variable", F.nanvl("ess", F.lit(None)).alias("ess"))
        block, lags = block * 4, min(lags * 4, longest)


def trace(draws: DataFrame, every: int = 1) -> DataFrame:
    """Points of a trace plot, every ``every``-th iteration, in plotting order."""
    return (
        draws.where(F.col("iteration") % every == 0)
        .select("variable", "chain", "iteration", "value")
        .orderBy("variable", "chain", "iteration")
    )


def marginal_density(draws: DataFrame, points: int = 512) -> DataFrame:
    """Density curve of each variable over all chains."""
    return density(draws, "value", ["variable"], points)


def pick_draws(draws: DataFrame, n: int, seed: int = rnd.DEFAULT_SEED) -> DataFrame:
    """``n`` draw ids in hash order: a fixed random choice."""
    ids = draws.select("draw_id").distinct()
    order = rnd.uniform("draw_id", seed=seed, stream="pick")
    return ids.orderBy(order, "draw_id").limit(n)
