"""The public-health table's panels and models on a small table of its schema."""

import math

import numpy as np
import pandas as pd
import pytest
from frames import day, lstsq
from pyspark.sql import functions as F

from panelwright import operators as op
from panelwright.plans import county
from panelwright.plans import workflow as wf
from panelwright.plans.county import COUNTY
from panelwright.plans.panels import lag_frame, panel_log, panel_percapita


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(11)
    counties, days = 45, 40
    static = {"E_TOTPOP": rng.integers(10_000, 3_000_000, counties)}
    for c in (*COUNTY.statics, *COUNTY.percapita_statics):
        static[c] = rng.random(counties) + 0.01
    static["MEDIAN_INCOME"] = rng.uniform(20_000, 160_000, counties)
    for c in (*[f for fine in COUNTY.bands.values() for f in fine], *COUNTY.shares.values()):
        static[c] = rng.integers(1, 500, counties)
    static["RPL_THEMES"][0] = -999.0
    per_county = pd.DataFrame(static)
    rows = per_county.loc[np.repeat(np.arange(counties), days)].reset_index(drop=True)
    rows["FIPS"] = [f"{26_000 + i:05d}" for i in np.repeat(np.arange(counties), days)]
    rows["COUNTY"] = [f"county {i % 40}" for i in np.repeat(np.arange(counties), days)]
    rows["DATE"] = [day(i) for i in np.tile(np.arange(days), counties)]
    rows["CONFIRMED_CASES"] = rng.integers(1, 5_000, len(rows))
    rows["DEATHS"] = rng.integers(0, 50, len(rows))
    return rows


@pytest.fixture(scope="module")
def source(spark, table):
    return spark.createDataFrame(table).cache()


def test_schema(source, table):
    assert len(table.columns) == 76
    log, percapita, lags = (f(source, COUNTY) for f in (panel_log, panel_percapita, lag_frame))
    assert (len(log.columns), len(percapita.columns), len(lags.columns)) == (55, 56, 14)
    assert set(percapita.columns) - set(log.columns) == {"EP_PCI", "EP_POV"}
    assert set(log.columns) - set(percapita.columns) == {"PERCENT_WHITE"}
    scaled = [c for c in log.columns if c not in county.UNSCALED]
    assert tuple(scaled) == county.SCALED and log.columns == COUNTY.log_columns()
    assert len(scaled) == 49 and len(county.CORRELATED) == 31
    assert [len(x) for _, x in county.FORMULAS.values()] == [31, 37, 30, 25]
    assert [len(v) for v in county.DESCRIBED.values()] == [2, 8, 7, 15]
    assert set(county.CORRELATED) <= set(log.columns)


def test_values_equal_pandas(source, table):
    kept = table[(table.RPL_THEMES > 0) & (table.DEATHS > 0)].sort_values(["FIPS", "DATE"])
    got = panel_log(source, COUNTY).toPandas().sort_values(["FIPS", "DATE"])
    assert len(got) == len(kept)
    cases = np.floor(np.log(kept.CONFIRMED_CASES) + 0.5)
    np.testing.assert_array_equal(got.CONFIRMED_CASES, cases)
    np.testing.assert_array_equal(got.y, kept.CONFIRMED_CASES)
    np.testing.assert_allclose(got.CC_PER_CAPITA, kept.CONFIRMED_CASES / kept.E_TOTPOP)
    np.testing.assert_array_equal(got.CCT_7, cases.groupby(kept.FIPS).shift(7))
    np.testing.assert_array_equal(got.DT_3, kept.DEATHS.groupby(kept.FIPS).shift(3))
    fine = [f"FEMALE_{b}" for b in county.AGE_BANDS["OVER_50"]]
    np.testing.assert_allclose(got.FEMALE_OVER_50, kept[fine].sum(axis=1) / kept.E_TOTPOP)


def test_scaled_columns_lie_between_0_and_1(source):
    out = wf.scaled(panel_log(source, COUNTY), county.SCALED).agg(
        *[F.min(c).alias(f"lo_{c}") for c in county.SCALED], *[F.max(c).alias(f"hi_{c}") for c in county.SCALED]
    ).first().asDict()
    assert all(v is None or 0 <= v <= 1 for v in out.values())


def test_lags_by_county_name_mix_counties(source):
    by_key = lag_frame(source, COUNTY, keys=True).where("CCT_1 is null").count()
    by_name = lag_frame(source, COUNTY, by_name=True, keys=True).where("CCT_1 is null").count()
    assert (by_key, by_name) == (45, 40)


@pytest.mark.parametrize("name", ["cases", "deaths", "percapita"])
def test_models_equal_least_squares(source, name):
    y, xs = county.FORMULAS[name]
    if name == "percapita":
        panel = panel_percapita(source, COUNTY)
        model = op.ols(panel, y, xs, "FIPS", "DATE")
        pdf = panel.select(y, *xs).toPandas()
    else:
        panel = panel_log(source, COUNTY)
        model = wf.scaled_ols(panel, y, xs, "FIPS", "DATE")
        pdf = panel.select(y, *xs).toPandas()
        pdf = (pdf - pdf.min()) / (pdf.max() - pdf.min())
    beta, rss, n, rank, *_ = lstsq(pdf[y], [pdf[x] for x in xs])
    fit = model.fit.first()
    assert (fit.n, fit["rank"]) == (n, rank)
    assert fit.rss == pytest.approx(rss, rel=1e-8)
    if rank == len(xs) + 1:
        coef = [r.coef for r in model.coef.collect()]
        np.testing.assert_allclose(coef, beta, rtol=1e-5, atol=1e-9)


def test_summaries_and_correlation(source):
    percapita = panel_percapita(source, COUNTY)
    for group in ("measures", "covariates"):
        assert op.describe(percapita, county.DESCRIBED[group]).count() == len(
            county.DESCRIBED[group]
        )
    log = panel_log(source, COUNTY)
    got = op.corr_targets(log, county.CORRELATED, ["CONFIRMED_CASES", "DEATHS"])
    assert got.count() == 62
    pdf = log.select("DEATHS", "EP_DISABL").toPandas()
    r = got.where("var_x = 'EP_DISABL' and var_y = 'DEATHS'").first().r
    assert r == pytest.approx(pdf.corr().iloc[0, 1])


def test_forecast_error_model_survives_few_counties(source):
    """Five counties cannot identify 25 static terms: the rank says so, nothing fails."""
    panel = panel_log(source, COUNTY).withColumnRenamed("FIPS", "entity_id")
    five = [f"{26_000 + i:05d}" for i in range(1, 6)]
    forecasts = wf.training_forecast(panel, five, str(day(30)))
    errors = wf.training_error(forecasts, panel)
    model = op.ols(errors, *county.FORMULAS["forecast_error"], "entity_id", "ds")
    fit = model.fit.first()
    assert fit["rank"] == 5 and fit.df_resid == fit.n - 5
    assert all(r.se is None or math.isfinite(r.se) for r in model.coef.collect())
    assert errors.where(F.col("error").isNull()).count() == 0
