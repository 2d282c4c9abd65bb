"""The six analyses end to end: preparation, collinearity, fits, predictive check.

Birth-interval studies m1-m3 model the years between births; behaviour-scan
studies m4-m6 model the class of each scan. Every function takes and returns
DataFrames with the snake-case columns of ``sources.tables``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions import random as rnd
from quadrat.operators import design as de
from quadrat.operators import effects, factors, models, predictive, prep, priors

# Slope (and class intercept) standard deviations of the three prior sets.
SLOPE_SD = {"weak": 1.0, "uniform": math.inf, "strong": 0.5}

# Lognormal intercept priors and exponential rates of group sds, Gaussian models.
INTERCEPT_LOGNORMAL = {"weak": (1.5, 0.4), "strong": (1.0, 0.25)}
GROUP_RATE = {"weak": 1.0, "strong": 1.0}

# Display labels in code order; code 1 is the reference class.
SCAN_LABELS = {
    "m4": (
        "Non social", "Foodshare with offspring", "Nurse", "Sociopositive with offspring",
        "Sociopositive with others",
    ),
    "m5": (
        "Non social", "Nutritional with eldest", "Sociopositive with eldest", "Nurture both",
        "Nurture youngest", "Sociopositive with others",
    ),
    "m6": (
        "Non social", "Foodshare with offspring", "Nurse", "Sociopositive with offspring",
        "Sociopositive with others",
    ),
}
SCAN_RESPONSE = {"m4": "scan", "m5": "new_scan", "m6": "scan"}

# ------------------------------------------------------------ birth intervals

RANK_COLUMN = {"m1": "rank", "m2": "rank2", "m3": None}


def prepare_intervals(df: DataFrame, study: str) -> DataFrame:
    """Standardise the mother's age and, where the study has one, her rank."""
    scaled = {"zage": "mother_age"}
    if RANK_COLUMN[study]:
        scaled["zrank"] = RANK_COLUMN[study]
    return prep.zscore(df, scaled)


def interval_terms(study: str, sexes: Sequence[str]) -> list[de.Term]:
    """m1, m2: age and rank by sex; m3: age by sex."""
    sex = de.dummies("off_sex", sexes)
    if study == "m3":
        return [de.interaction(de.num("zage"), sex)]
    return [de.num("zage"), de.interaction(de.num("zrank"), sex)]


def interval_vif(prepared: DataFrame, study: str, sexes: Sequence[str]) -> DataFrame:
    """Inflation factors of the main effects."""
    terms = [de.num("zage"), *([] if study == "m3" else [de.num("zrank")]), de.dummies("off_sex", sexes)]
    return models.vif(de.design(prepared, terms, "ibi"), de.column_names(terms))


def interval_fits(prepared: DataFrame, study: str, sexes: Sequence[str]) -> DataFrame:
    """Estimates under the three prior sets side by side."""
    terms = interval_terms(study, sexes)
    return models.prior_sensitivity(de.design(prepared, terms, "ibi"), de.column_names(terms), SLOPE_SD)


def interval_group_effects(prepared: DataFrame, study: str, sexes: Sequence[str]) -> DataFrame:
    """Partially pooled mother effects on what the fixed effects leave over."""
    terms = interval_terms(study, sexes)
    names = de.column_names(terms)
    rows = de.design(prepared, terms, "ibi", keep=["mother_name"])
    rest = models.residuals(rows, names, models.least_squares(rows, names))
    return effects.random_intercept(rest, "mother_name", "residual")


def interval_prior_lines(prepared: DataFrame, covariate: str, prior: str = "weak", lines: int = 100) -> DataFrame:
    """Prior predictive lines of the response over the range of a covariate."""
    level, spread = INTERCEPT_LOGNORMAL[prior]
    return priors.prior_lines(
        prepared, covariate,
        rnd.lognormal(level, spread, "line", stream="a"),
        rnd.normal(0.0, SLOPE_SD[prior], "line", stream="b"),
        lines,
    )


# ------------------------------------------------------------ behaviour scans


def prepare_scans(df: DataFrame, study: str) -> DataFrame:
    """Standardise covariates, dropping rows as each partly missing one is reached.

    Ages and rank are scaled before any row is dropped. Study m6 keeps the scaled
    columns of all scans, then keeps scans with a birth interval and scales that.
    """
    if study == "m5":
        ages = [("scale", "zeoffage", "eldest_offspring_age"), ("scale", "zyoffage", "youngest_off_age")]
    else:
        ages = [("scale", "zoffage", "youngest_off_age")]
    steps = [
        *ages,
        ("scale", "zage", "age"),
        ("scale", "zrank", "rank"),
        ("keep", "food_availability"),
        ("scale", "zfai", "food_availability"),
        ("keep", "time_n"),
        ("scale", "ztime", "time_n"),
        ("keep", "party_adults"),
        ("scale", "zparty", "party_adults"),
        ("keep", "imm_kids"),
        ("scale", "zkids", "imm_kids"),
    ]
    if study == "m6":
        steps += [("keep", "ibi"), ("scale", "zibi", "ibi")]
    out = prep.filter_then_scale(df, steps)
    return out if study == "m5" else prep.fill_missing(out, {"pregnant": 0})


def scan_levels(prepared: DataFrame, study: str) -> dict[str, list[str]]:
    """Sorted labels of the response and of every factor, needed to name design columns."""
    cols = [SCAN_RESPONSE[study], "youngest_off_sex", "community", *(["eldest_off_sex"] if study == "m5" else [])]
    return de.level_lists(prepared, cols)


def scan_terms(study: str, levels: dict[str, Sequence[str]]) -> list[de.Term]:
    """Fixed effects of the scan models."""
    young = de.dummies("youngest_off_sex", levels["youngest_off_sex"])
    community = de.dummies("community", levels["community"])
    shared = [community, de.num("ztime"), de.num("zparty"), de.num("zkids")]
    if study == "m5":
        eldest = de.dummies("eldest_off_sex", levels["eldest_off_sex"])
        return [
            de.num("zyoffage"), de.squared("zyoffage"), de.num("zeoffage"), de.num("zage"),
            de.interaction(de.num("zrank"), young), de.interaction(de.num("zrank"), eldest),
            de.num("zfai"), *shared,
        ]
    return [
        de.num("zoffage"), de.squared("zoffage"), de.num("zage"), de.interaction(de.num("zrank"), young),
        de.num("zfai"), *([de.num("zibi")] if study == "m6" else []), *shared,
        de.num("pregnant"), de.num("oestrous"),
    ]


def scan_vif(prepared: DataFrame, study: str, levels: dict[str, Sequence[str]]) -> DataFrame:
    """Inflation factors of the main effects; the response takes part in dropping rows."""
    young = de.dummies("youngest_off_sex", levels["youngest_off_sex"])
    if study == "m5":
        eldest = de.dummies("eldest_off_sex", levels["eldest_off_sex"])
        terms = [de.num("zeoffage"), de.num("zyoffage"), de.num("zage"), de.num("zrank"), eldest, young]
    else:
        terms = [de.num("zoffage"), de.num("zage"), de.num("zrank"), young]
        terms += [de.num("zibi")] if study == "m6" else []
    terms += [de.num("zfai"), de.num("ztime"), de.num("zparty"), de.num("zkids")]
    terms += [] if study == "m5" else [de.num("oestrous"), de.num("pregnant")]
    return models.vif(de.design(prepared, terms, SCAN_RESPONSE[study]), de.column_names(terms))


def scan_design(
    prepared: DataFrame, study: str, levels: dict[str, Sequence[str]], row_id: str
) -> tuple[DataFrame, list[str]]:
    """Complete design rows with ``row_id``, raw label ``y`` and class ``code``; and the term names."""
    terms = scan_terms(study, levels)
    rows = de.design(prepared, terms, SCAN_RESPONSE[study], keep=[row_id])
    coded = factors.explicit_code(rows, "y", levels[SCAN_RESPONSE[study]], "code")
    return coded, de.column_names(terms)


def scan_fit(
    prepared: DataFrame, study: str, levels: dict[str, Sequence[str]], row_id: str, prior: str = "weak"
) -> models.MultinomialFit:
    """Fixed effects of the scan model under one of the prior sets."""
    rows, names = scan_design(prepared, study, levels, row_id)
    sd = SLOPE_SD[prior]
    return models.multinomial_map(rows, "code", len(levels[SCAN_RESPONSE[study]]), names, sd, sd)


def scan_check(
    prepared: DataFrame,
    study: str,
    levels: dict[str, Sequence[str]],
    row_id: str,
    draws: DataFrame,
    n_draws: int,
    labels: Sequence[str] | None = None,
    prediction: str = "mode",
) -> DataFrame:
    """Observed against predicted class counts; ``draws`` may come from any sampler."""
    rows, names = scan_design(prepared, study, levels, row_id)
    raw = levels[SCAN_RESPONSE[study]]
    classes = dict(zip(raw, labels or SCAN_LABELS[study], strict=True))
    return predictive.category_check(
        rows, row_id, "y", classes, draws, ["intercept", *names], n_draws, prediction=prediction
    )
