"""Posterior prediction and the comparison of observed with predicted counts.

The draws x rows relation is generated and folded in the same stage; it is never
written, cached or widened into columns per draw.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions import random as rnd
from quadrat.functions.expr import level_code
from quadrat.operators.describe import LAYOUT, bin_mass, density_layout, smooth
from quadrat.operators.draws import pick_draws
from quadrat.operators.reshape import comparison_long

# Coefficients (draws x terms x classes) that may travel as one array with each task.
MAX_ARRAY_VALUES = 4_000_000

# Coefficients per draw up to which predictors are spelled out as column expressions;
# longer ones outgrow what the JVM compiles and go through a matrix product.
MAX_SPELLED_OUT = 24

# Cells of a block of rows x draws that a task holds at a time, and of a piece whose classes are chosen at once (its
# arrays stay in the cache of a core).
BLOCK_CELLS, PIECE_CELLS = 400_000, 32_000


def parallel_rows(rows: DataFrame, row_id: str) -> DataFrame:
    """Spread rows over all tasks by id before each is multiplied by the draws.

    The later aggregate per row then finds its rows in place.
    """
    spark = rows.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, row_id)


def pack_draws(
    draws: DataFrame, groups: Sequence, terms: Sequence[str], optional: Sequence[tuple] = ()
) -> DataFrame:
    """One row per draw with its coefficients as an array, in (group, term) order.

    ``draws`` has columns draw_id, class, term, value. A draw without one of the coefficients fails the query (a misspelt
    term, say), but for the ``optional`` pairs of group and term, which count as zero.
    """
    def cell(g, t) -> Column:
        hit = (F.col("class") == F.lit(g)) & (F.col("term") == F.lit(t))
        found = F.max(F.when(hit, F.col("value")))
        if (g, t) in optional:
            return F.coalesce(found, F.lit(0.0))
        return F.coalesce(found, F.raise_error(F.lit(f"a draw has no coefficient of {t} for {g}")).cast("double"))

    return draws.groupBy("draw_id").agg(
        F.array(*[cell(g, t) for g in groups for t in terms]).alias("w")
    )


def cross_draws(
    rows: DataFrame, packed: DataFrame, row_id: str, n_draws: int, width: int
) -> DataFrame:
    """Every row with every draw: the row's columns plus ``draw_id`` and ``w``.

    Up to ``MAX_ARRAY_VALUES`` coefficients travel as one array value that each
    row unfolds. The size is checked again when the query runs. Beyond that the
    draws are cut into blocks, and rows meet blocks in an equi-join whose key
    also holds a hash of the row, so no block is a hot key.
    """
    entry = F.struct("draw_id", "w")
    if n_draws * width <= MAX_ARRAY_VALUES:
        checked = packed.limit(n_draws + 1).agg(F.sort_array(F.collect_list(entry)).alias("v")).select(
            F.when(F.size("v") <= n_draws, F.col("v")).otherwise(
                F.raise_error(F.lit(f"more than the stated {n_draws} draws"))
            )
        )
        return rows.withColumn("_d", F.explode(checked.scalar())).select(
            *rows.columns, "_d.draw_id", "_d.w"
        )
    blocks = math.ceil(n_draws * width / MAX_ARRAY_VALUES)
    salts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = packed.groupBy(F.pmod(F.xxhash64("draw_id"), F.lit(blocks)).alias("_b")).agg(
        F.collect_list(entry).alias("_ds")
    )
    sides = sides.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    keyed = rows.withColumn("_s", F.pmod(F.xxhash64(row_id), F.lit(salts)).cast("int"))
    keyed = keyed.withColumn(
        "_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    )
    met = keyed.join(sides.hint("merge"), ["_b", "_s"]).withColumn("_d", F.explode("_ds"))
    return met.select(*rows.columns, "_d.draw_id", "_d.w")


def _linear(terms: Sequence[str], group: int, weights: str = "w") -> Column:
    at = group * len(terms)
    total = None
    for i, t in enumerate(terms):
        w = F.col(weights)[at + i]
        part = w if t == "intercept" else w * F.col(f"`{t}`")
        total = part if total is None else total + part
    return total


def _category_blocks(packed: DataFrame, k: int, terms: Sequence[str], n_draws: int, seed: int):
    """Function from (numpy, ids, design matrix) to blocks of predicted classes.

    Brings the coefficients, at most ``MAX_ARRAY_VALUES`` numbers, to the driver to
    ship them with the function. A block is (index of its first draw, its draw
    ids, classes as rows x draws, 0 where a covariate is missing).
    """
    import numpy as np

    got = packed.orderBy("draw_id").limit(n_draws + 1).toPandas()
    if len(got) > n_draws:
        raise ValueError(f"more than the stated {n_draws} draws")
    draw_ids = got["draw_id"].to_numpy(dtype=np.int64)
    flat = np.array(got["w"].tolist(), dtype=float)
    weights = flat.reshape(len(draw_ids), k - 1, len(terms))
    uniform = rnd.array_uniform(seed, "class")
    block_cells, piece_cells = BLOCK_CELLS, PIECE_CELLS

    def choose(np, eta, u):
        """Classes from the predictors by (row, draw, class) and the uniforms; 0 where a predictor is missing."""
        # subtracting the largest predictor keeps every exponential finite
        top = np.zeros(u.shape)
        for c in range(k - 1):
            np.maximum(top, eta[:, :, c], out=top)
        reach = np.exp(-top)
        sums = [reach]
        for c in range(k - 1):
            reach = reach + np.exp(eta[:, :, c] - top)
            sums.append(reach)
        target = u * sums[-1]
        category = np.ones(target.shape, dtype=np.int32)
        for reach in sums[:-1]:
            category += target >= reach
        category[np.isnan(target)] = 0
        return category

    def blocks(np, ids, x):
        step = max(1, block_cells // max(1, len(ids)))
        for start in range(0, len(draw_ids), step):
            some = draw_ids[start : start + step]
            w = weights[start : start + step].reshape(-1, x.shape[1])
            eta = (x @ w.T).reshape(len(ids), len(some), k - 1)
            category = np.empty((len(ids), len(some)), dtype=np.int32)
            piece = max(1, piece_cells // len(some))
            for a in range(0, len(ids), piece):
                at = slice(a, a + piece)
                category[at] = choose(np, eta[at], uniform(np, some[None, :], ids[at, None]))
            yield start, some, category

    return draw_ids, blocks


def _design_columns(row_id: str, terms: Sequence[str]) -> list[Column]:
    """Row id and one column per term, named by position."""
    cols = [F.lit(1.0) if t == "intercept" else F.col(f"`{t}`").cast("double") for t in terms]
    return [F.col(row_id).cast("long").alias("id"), *[c.alias(f"x{i}") for i, c in enumerate(cols)]]


def _predict_by_product(rows, row_id, packed, k, terms, n_draws, seed) -> DataFrame:
    _, blocks = _category_blocks(packed, k, terms, n_draws, seed)

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            ids = pdf["id"].to_numpy()
            for _, some, category in blocks(np, ids, pdf.iloc[:, 1:].to_numpy(dtype=float)):
                yield pd.DataFrame(
                    {"d": np.tile(some, len(ids)), "i": np.repeat(ids, len(some)), "c": category.ravel()}
                )

    cells = rows.select(*_design_columns(row_id, terms)).mapInPandas(run, "d long, i long, c int")
    known = F.when(F.col("c") > 0, F.col("c"))
    return cells.select(F.col("d").alias("draw_id"), F.col("i").alias(row_id), known.alias("category"))


def _complete(rows: DataFrame, terms: Sequence[str]) -> DataFrame:
    """The rows that have a prediction: no covariate is null or NaN."""
    for t in terms:
        if t != "intercept":
            rows = rows.where(F.col(f"`{t}`").isNotNull() & ~F.isnan(F.col(f"`{t}`").cast("double")))
    return rows


def fold_predictions(
    rows: DataFrame,
    row_id: str,
    code: str,
    draws: DataFrame,
    k: int,
    terms: Sequence[str],
    n_draws: int,
    seed: int = rnd.DEFAULT_SEED,
) -> DataFrame:
    """Counts of classes 1..k over draws x rows, in one pass without moving a cell.

    Each task walks its rows in blocks and keeps three sets of counts: per draw,
    of the most frequent class of each row (the earliest draw wins a tie), and of
    the observed ``code``. Returns one row per draw (``kind`` "draw") and one each
    of kind "mode" and "observed": ``kind``, ``draw_id``, ``c1``..``ck``. Rows with
    a null (or NaN) covariate count nowhere.
    """
    terms = list(terms)
    rows = _complete(rows, terms)
    packed = pack_draws(draws, range(2, k + 1), terms)
    draw_ids, blocks = _category_blocks(packed, k, terms, n_draws, seed)
    names = [f"c{c}" for c in range(1, k + 1)]

    def fold(batches):
        import numpy as np
        import pandas as pd

        n = len(draw_ids)
        per_draw = np.zeros((n, k), dtype=np.int64)
        modes, observed = np.zeros(k, dtype=np.int64), np.zeros(k, dtype=np.int64)
        for pdf in batches:
            known = pdf["code"].dropna().to_numpy(dtype=np.int64)
            observed += np.bincount(known - 1, minlength=k)[:k]
            x = pdf.drop(columns=["id", "code"]).to_numpy(dtype=float)
            counts = np.zeros((len(pdf), k), dtype=np.int64)
            first = np.full((len(pdf), k), n, dtype=np.int64)
            for start, some, category in blocks(np, pdf["id"].to_numpy(), x):
                for c in range(k):
                    hit = category == c + 1
                    per_draw[start : start + len(some), c] += hit.sum(axis=0)
                    found = hit.sum(axis=1)
                    new = (counts[:, c] == 0) & (found > 0)
                    first[new, c] = start + hit[new].argmax(axis=1)
                    counts[:, c] += found
            # more draws first, then the earlier first draw
            best = (counts * (n + 1) + (n - first)).argmax(axis=1)
            modes += np.bincount(best, minlength=k)
        table = np.vstack([per_draw, modes, observed])
        out = pd.DataFrame(table, columns=names)
        out.insert(0, "draw_id", pd.array([*draw_ids, None, None], dtype="Int64"))
        out.insert(0, "kind", ["draw"] * n + ["mode", "observed"])
        yield out

    schema = "kind string, draw_id long, " + ", ".join(f"{c} long" for c in names)
    parts = rows.select(F.col(code).alias("code"), *_design_columns(row_id, terms)).mapInPandas(fold, schema)
    return parts.groupBy("kind", "draw_id").agg(*[F.sum(c).alias(c) for c in names])


def predict_category(
    rows: DataFrame,
    row_id: str,
    draws: DataFrame,
    k: int,
    terms: Sequence[str],
    n_draws: int,
    seed: int = rnd.DEFAULT_SEED,
) -> DataFrame:
    """Predicted class 1..k for every row and draw of a multinomial logit.

    Class 1 is the reference. A class is chosen by inverting the softmax
    distribution at a uniform that depends on (draw, row) only. A row with a null
    (or NaN) covariate has a null class, whatever way the product is computed.
    """
    terms = list(terms)
    packed = pack_draws(draws, range(2, k + 1), terms)
    width = (k - 1) * len(terms)
    if width > MAX_SPELLED_OUT and n_draws * width <= MAX_ARRAY_VALUES:
        return _predict_by_product(rows, row_id, packed, k, terms, n_draws, seed)
    cells = cross_draws(rows, packed, row_id, n_draws, width)
    classes = range(1, k + 1)
    cells = cells.select(
        "draw_id",
        row_id,
        F.lit(0.0).alias("_e1"),
        *[_linear(terms, c - 2).alias(f"_e{c}") for c in classes[1:]],
        rnd.uniform("draw_id", row_id, seed=seed, stream="class").alias("_u"),
    )
    # subtracting the largest predictor keeps every exponential finite
    top = F.greatest(*[f"_e{c}" for c in classes]) if k > 1 else F.col("_e1")
    cells = cells.select("draw_id", row_id, "_u", top.alias("_top"), *[f"_e{c}" for c in classes])
    cells = cells.select(
        "draw_id", row_id, "_u", *[F.exp(F.col(f"_e{c}") - F.col("_top")).alias(f"_w{c}") for c in classes]
    )

    def reach(c: int) -> Column:
        total = F.col("_w1")
        for i in range(2, c + 1):
            total = total + F.col(f"_w{i}")
        return total

    target, choice = F.col("_u") * reach(k), F.lit(k)
    for c in reversed(range(1, k)):
        choice = F.when(target < reach(c), c).otherwise(choice)
    known = target.isNotNull() & ~F.isnan(target)
    return cells.select("draw_id", row_id, F.when(known, choice).cast("int").alias("category"))


def predict_gaussian(
    rows: DataFrame,
    row_id: str,
    draws: DataFrame,
    terms: Sequence[str],
    n_draws: int,
    seed: int = rnd.DEFAULT_SEED,
) -> DataFrame:
    """Replicated response for every row and draw of a Gaussian regression.

    Draws carry class "mu" with one value per term and class "sigma" with term
    "intercept" for the residual sd.
    """
    terms = list(terms)
    packed = pack_draws(draws, ("mu", "sigma"), terms, [("sigma", t) for t in terms if t != "intercept"])
    cells = cross_draws(rows, packed, row_id, n_draws, 2 * len(terms))
    noise = rnd.std_normal("draw_id", row_id, seed=seed, stream="replicate")
    sigma = F.col("w")[len(terms) + terms.index("intercept")]
    return cells.select("draw_id", row_id, (_linear(terms, 0) + sigma * noise).alias("y_rep"))


def counts_per_draw(cells: DataFrame, k: int) -> DataFrame:
    """One row per draw with counts ``c1``..``ck``, zero where a class is absent."""
    return cells.groupBy("draw_id").agg(
        *[F.count_if(F.col("category") == c).alias(f"c{c}") for c in range(1, k + 1)]
    )


def envelope(per_draw: DataFrame, k: int) -> DataFrame:
    """Smallest and largest count of each class over all draws."""
    entries = F.array(
        *[
            F.struct(
                F.lit(c).alias("category"),
                F.min(f"c{c}").alias("lower"),
                F.max(f"c{c}").alias("upper"),
            )
            for c in range(1, k + 1)
        ]
    )
    return per_draw.agg(entries.alias("e")).select(F.inline("e"))


def row_mode(cells: DataFrame, row_id: str, k: int) -> DataFrame:
    """Most frequent class 1..k per row over the draws; the earliest draw wins a tie.

    A row without any class has a null mode. Counts and first draws of all classes are numbers in one hash aggregate per
    row. Rows already spread by id are aggregated where they are.
    """
    stats = cells.groupBy(row_id).agg(
        *[F.count_if(F.col("category") == c).alias(f"_n{c}") for c in range(1, k + 1)],
        *[F.min(F.when(F.col("category") == c, F.col("draw_id"))).alias(f"_f{c}") for c in range(1, k + 1)],
    )
    entries = [
        F.struct(F.col(f"_n{c}").alias("n"), (-F.col(f"_f{c}")).alias("f"), F.lit(c).alias("c"))
        for c in range(1, k + 1)
    ]
    best = F.array_max(F.array(*entries))
    return stats.select(row_id, F.when(best["n"] > 0, best["c"]).alias("prediction"))


def first_draw(draws: DataFrame) -> DataFrame:
    """Coefficients of the draw with the smallest id."""
    return draws.where(F.col("draw_id") == draws.agg(F.min("draw_id")).scalar())


def single_draw(
    rows: DataFrame,
    row_id: str,
    draws: DataFrame,
    k: int,
    terms: Sequence[str],
    seed: int = rnd.DEFAULT_SEED,
) -> DataFrame:
    """Class per row in the first draw alone; the other draws are never computed."""
    cells = predict_category(rows, row_id, first_draw(draws), k, terms, 1, seed)
    return cells.select(row_id, F.col("category").alias("prediction"))


def class_frame(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Dimension (category, label) for codes 1..k."""
    entries = F.array(*[F.lit(v) for v in labels])
    one = rows.sparkSession.range(1).select(F.posexplode(entries).alias("p", "label"))
    return one.select((F.col("p") + 1).alias("category"), "label")


def observed_and_predicted(
    frame: DataFrame, observed: DataFrame, predicted: DataFrame
) -> DataFrame:
    """Counts of observed and predicted classes side by side, paired by code.

    A full outer pairing: a class missing on either side counts zero, and a code
    outside the frame is kept. Both sides are stacked and counted in one aggregate.
    """
    def block(rows: DataFrame, label, o: int, p: int) -> DataFrame:
        return rows.where(F.col("category").isNotNull()).select(
            "category", label.alias("label"), F.lit(o).alias("o"), F.lit(p).alias("p")
        )

    none = F.lit(None).cast("string")
    stacked = block(frame, F.col("label"), 0, 0).unionByName(block(observed, none, 1, 0))
    stacked = stacked.unionByName(block(predicted, none, 0, 1))
    return stacked.groupBy("category").agg(
        F.max("label").alias("label"), F.sum("o").alias("observed"), F.sum("p").alias("predicted")
    )


def category_check(
    rows: DataFrame,
    row_id: str,
    label: str,
    classes: Mapping[str, str],
    draws: DataFrame,
    terms: Sequence[str],
    n_draws: int,
    seed: int = rnd.DEFAULT_SEED,
    prediction: str = "mode",
) -> DataFrame:
    """Posterior predictive check of a categorical model; ``row_id`` is an integer key.

    ``classes`` maps raw labels, in code order, to display labels. One row per
    class and source: ``source``, ``category``, ``label``, ``count``, ``lower``,
    ``upper``. "observed" counts the data; "posterior" counts the predicted class of
    each row ("mode" over its draws, or "first" draw) with the least and greatest
    class count over the draws as bounds.
    """
    if prediction not in ("mode", "first"):
        raise ValueError(f"unknown prediction: {prediction}")
    k = len(classes)
    wanted = [t for t in terms if t != "intercept"]
    coded = rows.select(row_id, *[f"`{t}`" for t in wanted], level_code(label, list(classes)).alias("_code"))
    slim = parallel_rows(coded, row_id)
    if n_draws * (k - 1) * len(terms) <= MAX_ARRAY_VALUES:
        counts = fold_predictions(slim, row_id, "_code", draws, k, terms, n_draws, seed)
    else:
        counts = _counts_from_cells(slim, row_id, "_code", draws, k, terms, n_draws, seed)
    is_draw, first = F.col("kind") == "draw", F.struct("kind", "draw_id")

    def entry(i: int, display: str) -> Column:
        c = F.col(f"c{i}")
        if prediction == "mode":
            predicted = F.max(F.when(F.col("kind") == "mode", c))
        else:
            predicted = F.min_by(F.when(is_draw, c), F.when(is_draw, first))
        return F.struct(
            F.lit(i).alias("category"),
            F.lit(display).alias("label"),
            F.max(F.when(F.col("kind") == "observed", c)).alias("observed"),
            predicted.alias("predicted"),
            F.min(F.when(is_draw, c)).alias("lower"),
            F.max(F.when(is_draw, c)).alias("upper"),
        )

    table = counts.agg(F.array(*[entry(i, v) for i, v in enumerate(classes.values(), 1)]).alias("t"))
    table = table.select(F.inline("t"))
    return comparison_long(table, ["category", "label"], "observed", "predicted", "lower", "upper")


def _counts_from_cells(slim, row_id, code, draws, k, terms, n_draws, seed) -> DataFrame:
    """What ``fold_predictions`` returns, for draws too many to ship with a task."""
    names = [f"c{c}" for c in range(1, k + 1)]
    slim = _complete(slim, terms)
    cells = predict_category(slim.drop(code), row_id, draws, k, terms, n_draws, seed)
    none = F.lit(None).cast("long")

    def tally(df: DataFrame, column: str, kind: str) -> DataFrame:
        counted = df.agg(*[F.count_if(F.col(column) == c).alias(n) for c, n in enumerate(names, 1)])
        return counted.select(F.lit(kind).alias("kind"), none.alias("draw_id"), *names)

    per_draw = counts_per_draw(cells, k).select(F.lit("draw").alias("kind"), "draw_id", *names)
    modes = tally(row_mode(cells, row_id, k), "prediction", "mode")
    return per_draw.unionByName(modes).unionByName(tally(slim, code, "observed"))


def density_overlay(
    rows: DataFrame,
    row_id: str,
    y: str,
    draws: DataFrame,
    terms: Sequence[str],
    n_draws: int,
    show: int = 100,
    points: int = 512,
    seed: int = rnd.DEFAULT_SEED,
) -> DataFrame:
    """Density of the response and of ``show`` replicated responses on one grid.

    Grid and bandwidth come from the observed response. ``draw_id`` is null for
    the observed curve.
    """
    layout = density_layout(rows, y, points=points)
    spec = layout.select(F.struct(*LAYOUT)).scalar()
    wanted = [t for t in terms if t != "intercept"]
    slim = parallel_rows(rows.select(row_id, y, *wanted).where(F.col(y).isNotNull()), row_id)
    chosen = draws.join(pick_draws(draws, show, seed), "draw_id", "left_semi")
    replicated = predict_gaussian(slim, row_id, chosen, terms, min(show, n_draws), seed)
    curves = replicated.select("draw_id", F.col("y_rep").alias("v")).unionByName(
        slim.select(F.lit(None).cast("long").alias("draw_id"), F.col(y).alias("v"))
    )
    curves = curves.withColumn("s", spec).select("draw_id", "v", "s.*")
    mass = bin_mass(curves, "v", ["draw_id", *LAYOUT], F.col("start"), F.col("step"))
    return smooth(mass, ["draw_id"], points)
