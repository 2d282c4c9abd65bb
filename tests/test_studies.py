"""The six studies on small made tables with the observation schemas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.operators import design as de
from quadrat.plans import studies
from quadrat.sources import tables


@pytest.fixture(scope="module")
def births(spark, tmp_path_factory):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(98):
        sex, age, rank = ("female", "male")[i % 2], float(rng.uniform(12, 45)), float(rng.uniform())
        ibi = 5 + 0.03 * age + 0.5 * (sex == "male") + float(rng.normal(0, 0.8))
        rows.append(("north", f"o{i}", f"m{i % 40}", sex, 1.0, sex, ibi, f"o{i}", age, rank if i < 68 else None, rank))
    path = str(tmp_path_factory.mktemp("t") / "births")
    spark.createDataFrame(rows, tables.BIRTH_INTERVAL).write.parquet(path)
    return tables.attach(spark, path, tables.BIRTH_INTERVAL)


@pytest.fixture(scope="module")
def scans(spark, tmp_path_factory):
    rng = np.random.default_rng(2)
    four = ["anone", "bfood", "cnurse", "dsocio", "eothers"]
    six = ["anone", "bnutri", "csocio", "dboth", "eyoung", "fothers"]
    rows = []
    for i in range(1500):
        maybe = lambda v, p=0.05: None if rng.uniform() < p else v
        rows.append(
            {
                "subject": f"s{i % 15}", "time.n": maybe(float(rng.uniform(300, 1100))), "observationID": f"f{i % 60}",
                "youngest_offspring": f"y{i % 16}", "eldest_offspring_age": float(rng.uniform(5, 12)),
                "scan": four[rng.choice(5, p=[0.6, 0.1, 0.1, 0.1, 0.1])],
                "new_scan": six[rng.choice(6, p=[0.5, 0.1, 0.1, 0.1, 0.1, 0.1])],
                "pregnant": maybe(float(rng.integers(0, 2)), 0.2), "youngest_off_age": float(rng.uniform(0, 5)),
                "youngest_off_sex": ("F", "M")[rng.integers(0, 2)], "eldest_off_sex": ("F", "M")[rng.integers(0, 2)],
                "community": ("N", "S")[rng.integers(0, 2)], "food_availability": maybe(float(rng.uniform(0, 3))),
                "party_adults": maybe(int(rng.integers(1, 12))), "rank": float(rng.uniform()),
                "imm_kids": maybe(float(rng.integers(0, 4))), "age": float(rng.uniform(12, 45)),
                "oestrous": float(rng.integers(0, 2)), "ibi": maybe(float(rng.uniform(3, 8)), 0.5), "frequency": 1.0,
            }
        )
    path = str(tmp_path_factory.mktemp("t") / "scans")
    spark.createDataFrame(rows, tables.BEHAVIOUR_SCAN).write.parquet(path)
    df = tables.attach(spark, path, tables.BEHAVIOUR_SCAN)
    return df.withColumn("row_id", F.xxhash64("time_n", "age", "youngest_off_age")).cache()


@pytest.mark.parametrize("study", ["m1", "m2", "m3"])
def test_interval_studies(spark, births, study):
    rows = births.where(F.col("rank").isNotNull()) if study == "m1" else births
    sexes = de.level_list(rows, "off_sex")
    ready = studies.prepare_intervals(rows, study)
    z = ready.agg(F.avg("zage"), F.stddev_samp("zage")).first()
    assert z[0] == pytest.approx(0, abs=1e-12) and z[1] == pytest.approx(1)
    factors = {r["term"]: r["vif"] for r in studies.interval_vif(ready, study, sexes).collect()}
    assert set(factors) == {"zage", "off_sex_male", *(() if study == "m3" else ("zrank",))}
    assert all(1 <= v < 2 for v in factors.values())
    fits = {r["term"]: r for r in studies.interval_fits(ready, study, sexes).collect()}
    product = "zage:off_sex_male" if study == "m3" else "zrank:off_sex_male"
    assert product in fits
    main = fits["off_sex_male"]
    assert abs(main["strong"]) < abs(main["weak"]) < abs(main["uniform"])
    effects = studies.interval_group_effects(ready, study, sexes)
    assert effects.count() == rows.select("mother_name").distinct().count()
    lines = studies.interval_prior_lines(ready, "zage", "strong", lines=7)
    assert lines.count() == 7 * 101


@pytest.mark.parametrize("study", ["m4", "m5", "m6"])
def test_scan_studies(spark, scans, study):
    ready = studies.prepare_scans(scans, study)
    needed = ["food_availability", "time_n", "party_adults", "imm_kids", *(["ibi"] if study == "m6" else [])]
    kept = scans
    for c in needed:
        kept = kept.where(F.col(c).isNotNull())
    assert ready.count() == kept.count()
    # ages are scaled over all scans, the last covariate over the kept ones
    whole = scans.agg(F.avg("age").alias("m"), F.stddev_samp("age").alias("s")).first()
    some = ready.select("age", "zage").first()
    assert some["zage"] == pytest.approx((some["age"] - whole["m"]) / whole["s"])
    last = "zibi" if study == "m6" else "zkids"
    assert ready.agg(F.avg(last)).first()[0] == pytest.approx(0, abs=1e-12)
    if study != "m5":
        assert ready.where(F.col("pregnant").isNull()).count() == 0
    levels = studies.scan_levels(ready, study)
    inflation = studies.scan_vif(ready, study, levels).collect()
    assert all(1 <= r["vif"] < 1.5 for r in inflation)
    assert ("zibi" in {r["term"] for r in inflation}) == (study == "m6")
    _, names = studies.scan_design(ready, study, levels, "row_id")
    assert len(names) == len(set(names)) and any(n.endswith("_sq") for n in names)
    weak = studies.scan_fit(ready, study, levels, "row_id", "weak")
    strong = studies.scan_fit(ready, study, levels, "row_id", "strong")
    slopes = [i for i, (_, t) in enumerate(weak.keys()) if t != "intercept"]
    assert sum(strong.estimate[i] ** 2 for i in slopes) < sum(weak.estimate[i] ** 2 for i in slopes)
    check = studies.scan_check(ready, study, levels, "row_id", weak.draws(spark, 40), 40).toPandas()
    labels = studies.SCAN_LABELS[study]
    assert sorted(check["label"]) == sorted(labels * 2)
    n = ready.count()
    observed, posterior = (check[check["source"] == s] for s in ("observed", "posterior"))
    assert observed["count"].sum() == n and posterior["count"].sum() == n
    # the model has an intercept per class, so observed counts lie inside the envelope
    both = observed.merge(posterior, on="label", suffixes=("", "_p"))
    assert ((both["count"] >= both["lower_p"]) & (both["count"] <= both["upper_p"])).all()
