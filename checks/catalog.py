"""One query per operator: each takes a session and a table folder, returns a DataFrame.

Doubles that come out of sums are rounded, so that sums added in another order compare equal.
Ratios, logs, lags and scaled values are single operations on exact inputs and stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright import operators as op
from panelwright.operators.correlate import tiled
from panelwright.plans import supplier as sup
from panelwright.plans import workflow as wf
from panelwright.plans.panels import lag_frame, panel_filter, panel_log, panel_percapita
from panelwright.plans.supplier import SUPPLIER
from panelwright.sources import panel_nation, panel_supplier, scan_panel, series_event_type
from panelwright.sources.standin import SEGMENT_COUNTS, SEGMENTS

CUTOFF = "2024-01-23"
ENTITIES = ("click", "error", "purchase", "signup", "view")
KEYS = ("entity_id", "ds")
LINEITEM_OLS = ("l_extendedprice", ("l_quantity", "l_discount"))
SIMPLE_OLS = ("D_PER_CAPITA", ("CC_PER_CAPITA",))
CROSS_CORR = ("cases", "deaths", *SUPPLIER.lags_of("CCT"), *SUPPLIER.lags_of("DT"))
# The rounded log of the population is the same for all suppliers here, so its coefficient is not determined.
ERROR_OLS = ("error", tuple(x for x in sup.FORMULAS["forecast_error"][1] if x != "log_pop"))
SELECT_Y = "deaths"
SELECT_X = (
    "acctbal", "cases", "pop", "CC_PER_CAPITA", "D_PER_CC", "O_q01_10", "O_q31_50",
    "F_q31_50", "share_disc_01", "share_disc_05",
)
SELECT_LAGS = (*SELECT_X, *sup.CASE_LAGS, *sup.DEATH_LAGS)
DESCRIBED = {
    "measures": ("cases", "deaths"),
    "bands": tuple(SUPPLIER.bands),
    "shares": SUPPLIER.percapita_shares,
    "covariates": ("pop", "acctbal", "nation_id", "CC_PER_CAPITA", "D_PER_CAPITA", "D_PER_CC"),
}
SKEWED = ("cases", "deaths", "log_cases", "log_deaths")
FIT_CHECKED = (
    "y", "n", "rank", "df_model", "df_resid", "r2", "adj_r2", "f", "llf", "aic", "bic", "rss",
    "sigma2", "skew", "kurtosis", "omnibus", "omnibus_p", "jarque_bera", "jarque_bera_p",
    "durbin_watson",
)


def rounded(df: DataFrame, places: int = 6, **other: int) -> DataFrame:
    """Doubles rounded to ``places``, or to ``other[column]``; -0.0 becomes 0.0."""
    return df.select(
        *[
            (F.round(c, other.get(c, places)) + F.lit(0.0)).alias(c) if t == "double" else F.col(c)
            for c, t in df.dtypes
        ]
    )


# Panels ------------------------------------------------------------------------------------


def _log(spark: SparkSession, sf: str) -> DataFrame:
    return panel_log(panel_supplier(spark, sf), SUPPLIER)


def _percapita(spark: SparkSession, sf: str) -> DataFrame:
    return panel_percapita(panel_supplier(spark, sf), SUPPLIER)


def _narrow(spark: SparkSession, sf: str) -> DataFrame:
    return panel_supplier(spark, sf, wide=False)


def _filtered(spark: SparkSession, sf: str) -> DataFrame:
    return _narrow(spark, sf).where(panel_filter(SUPPLIER))


def q_scan_panel(spark, sf):
    columns = {
        "order_id": "o_orderkey",
        "entity_id": "o_custkey",
        "status": "o_orderstatus",
        "amount": "o_totalprice",
    }
    return scan_panel(spark, f"{sf}/orders.parquet", columns, F.col("o_totalprice") > 150000)


def q_panel_filtered(spark, sf):
    return _filtered(spark, sf).select(
        "entity_id", "ds", "entity_name", "cases", "deaths", "pop", "acctbal", "nation_id"
    )


def q_panel_log(spark, sf):
    return _log(spark, sf)


def q_panel_percapita(spark, sf):
    return _percapita(spark, sf)


# Features ----------------------------------------------------------------------------------


def q_log_transform(spark, sf):
    measures = ("cases", "deaths", "pop")
    return op.log_transform(panel_nation(spark, sf), measures).select(
        *KEYS, *[f"log_{m}" for m in measures]
    )


def q_per_capita(spark, sf):
    ratios = {
        "cc_per_capita": ("cases", "pop"),
        "d_per_capita": ("deaths", "pop"),
        "d_per_cc": ("deaths", "cases"),
    }
    return op.per_capita(panel_nation(spark, sf), ratios).select(*KEYS, *ratios)


def q_population_shares(spark, sf):
    shares = {f"share_{s}": c for s, c in zip(SEGMENTS, SEGMENT_COUNTS)}
    out = op.population_shares(panel_nation(spark, sf), shares, "pop")
    return out.select(*KEYS, *shares)


def q_band_shares(spark, sf):
    out = op.band_shares(panel_supplier(spark, sf), SUPPLIER.bands, "pop")
    return out.select(*KEYS, *SUPPLIER.bands)


def q_date_keys(spark, sf):
    return op.date_keys(panel_nation(spark, sf), "ds", "ds_key").select(
        *KEYS, "ds_key", F.col("ds").cast("string").alias("ds_text")
    )


def q_numeric_view(spark, sf):
    return op.numeric_view(_filtered(spark, sf), drop=("entity_id", "nation_id"))


# Lags --------------------------------------------------------------------------------------


def _lags(df, exprs):
    names = [f"{n}_{k}" for n in exprs for k in op.OFFSETS]
    return op.add_lags(df, exprs).select(*KEYS, *names)


def q_lags_log_cases(spark, sf):
    panel = op.log_transform(_filtered(spark, sf), ("cases",))
    return _lags(panel, {"CCT": "log_cases"})


def q_lags_raw_deaths(spark, sf):
    return _lags(_filtered(spark, sf), {"DT": "deaths"})


def q_lags_unfiltered(spark, sf):
    return lag_frame(_narrow(spark, sf), SUPPLIER, keys=True).drop("entity_name")


def q_lags_percapita(spark, sf):
    ratios = {"cc": ("cases", "pop"), "d": ("deaths", "pop")}
    panel = op.per_capita(_filtered(spark, sf), ratios)
    return _lags(panel, {"CCT": "cc", "DT": "d"})


def q_lags_calendar(spark, sf):
    out = op.add_lags(_filtered(spark, sf), {"cases": "cases"}, offsets=(31, 61), calendar=True)
    return out.select(*KEYS, "cases_31", "cases_61")


def q_lags_sliced(spark, sf):
    """Entities of more than 31 rows in ranges, each with the last rows before it."""
    out = op.add_lags(_filtered(spark, sf), {"cases": "cases"}, offsets=(1, 7), max_rows=31)
    return out.select(*KEYS, "cases_1", "cases_7")


def q_lags_ranged(spark, sf):
    """What ``lags_log_cases`` gives, without a window over a whole entity."""
    panel = op.log_transform(_filtered(spark, sf), ("cases",))
    return op.add_lags(panel, {"CCT": "log_cases"}, max_rows=40).select(*KEYS, *[f"CCT_{k}" for k in op.OFFSETS])


# Splits ------------------------------------------------------------------------------------


def q_train_split(spark, sf):
    return op.train_split(series_event_type(spark, sf), ENTITIES, CUTOFF)


def q_future_dates(spark, sf):
    series = series_event_type(spark, sf)
    return op.future_dates(op.train_split(series, None, CUTOFF))


def q_union_entities(spark, sf):
    series = series_event_type(spark, sf)
    return op.entity_frames(series, ENTITIES, {ENTITIES[0]: {"weekday": F.dayofweek("ds")}})


# Descriptions ------------------------------------------------------------------------------


def _describe(group: str) -> Callable:
    def query(spark, sf):
        return rounded(op.describe(_percapita(spark, sf), DESCRIBED[group]))

    return query


def q_describe_approx(spark, sf):
    """Sketched quartiles, held against the shares of rows below them: a rank error of half a percent is allowed."""
    panel, cols = _percapita(spark, sf), DESCRIBED["bands"]
    sketched = op.describe(panel, cols, approx=True).select("variable", "count", "p25", "p50", "p75")
    rows = panel.unpivot([], list(cols), "name", "x").where("x is not null").join(F.broadcast(sketched), F.col("name") == F.col("variable"))

    def near(p: int):
        low, high = (F.avg((F.col("x") < F.col(f"p{p}")).cast("int")), F.avg((F.col("x") <= F.col(f"p{p}")).cast("int")))
        return ((low - 0.005 <= p / 100) & (p / 100 <= high + 0.005)).alias(f"p{p}_near")

    return rows.groupBy("variable", "count").agg(*[near(p) for p in (25, 50, 75)])


def q_skew_report(spark, sf):
    panel = op.log_transform(_filtered(spark, sf), ("cases", "deaths"))
    return rounded(op.skew_report(panel, SKEWED))


def q_weekday_profile(spark, sf):
    return rounded(op.weekday_profile(series_event_type(spark, sf), "y"))


# Scaling and correlation -------------------------------------------------------------------


def q_minmax_params(spark, sf):
    return op.minmax_fit(_log(spark, sf), sup.SCALED)


def q_minmax_scaled(spark, sf):
    panel = _log(spark, sf)
    return wf.scaled(panel, sup.SCALED).select(*KEYS, *sup.SCALED)


def q_corr_matrix(spark, sf):
    return rounded(op.correlate(_log(spark, sf), sup.CORRELATED))


def q_corr_matrix_wide(spark, sf):
    return rounded(op.corr_matrix(_log(spark, sf), sup.CORRELATED))


def q_corr_tiles(spark, sf):
    """Every pair of the logged panel's columns, tile by tile as for thousands of them."""
    return rounded(tiled(_log(spark, sf), list(sup.CORRELATED), None, 8))


def q_corr_targets(spark, sf):
    return rounded(op.corr_targets(_log(spark, sf), sup.CORRELATED, ("log_cases", "log_deaths")))


def q_autocorr_raw(spark, sf):
    lags = lag_frame(_narrow(spark, sf), SUPPLIER)
    return rounded(op.correlate(lags, lags.columns))


def q_cross_corr_lags(spark, sf):
    panel = op.add_lags(_narrow(spark, sf), {"CCT": "cases", "DT": "deaths"})
    return rounded(op.correlate(panel, CROSS_CORR, ("cases", "deaths")))


# Regression --------------------------------------------------------------------------------


def q_ols_simple(spark, sf):
    model = op.ols(_percapita(spark, sf), SIMPLE_OLS[0], SIMPLE_OLS[1])
    return rounded(model.coef.select("term", "coef", "se", "t"), 8, t=6)


def q_ols_multi(spark, sf):
    lines = scan_panel(spark, f"{sf}/lineitem.parquet")
    model = op.ols(lines, LINEITEM_OLS[0], LINEITEM_OLS[1])
    return rounded(model.coef.select("term", "coef"), 4)


def q_ols_summary_coef(spark, sf):
    model = op.ols(_percapita(spark, sf), *SIMPLE_OLS, *KEYS)
    return rounded(model.coef, 8, t=6, p=6)


def q_ols_summary_fit(spark, sf):
    model = op.ols(_percapita(spark, sf), *SIMPLE_OLS, *KEYS)
    return rounded(model.fit)


def _model(name: str, spark, sf):
    if name == "percapita":
        return op.ols(_percapita(spark, sf), *sup.FORMULAS[name], *KEYS)
    return wf.scaled_ols(_log(spark, sf), *sup.FORMULAS[name], *KEYS)


def _coef(name: str) -> Callable:
    return lambda spark, sf: rounded(_model(name, spark, sf).coef, 8, t=6, p=6)


def _fit(name: str) -> Callable:
    return lambda spark, sf: rounded(_model(name, spark, sf).fit.select(*FIT_CHECKED), 6)


def _together(spark, sf):
    """The three models from one panel, with one pass over it and one over the residuals."""
    formulas = {name: sup.FORMULAS[name] for name in ("cases", "deaths", "percapita")}
    return wf.models_together(panel_supplier(spark, sf), SUPPLIER, formulas, ("cases", "deaths"), ("percapita",))


def q_ols_together(spark, sf):
    coefs = [rounded(m.coef, 8, t=6, p=6).select(F.lit(name).alias("model"), "*") for name, m in _together(spark, sf).items()]
    return coefs[0].unionByName(coefs[1]).unionByName(coefs[2])


def q_ols_together_fit(spark, sf):
    fits = [rounded(m.fit.select(*FIT_CHECKED), 6) for m in _together(spark, sf).values()]
    return fits[0].unionByName(fits[1]).unionByName(fits[2])


def q_forward_selection(spark, sf):
    return rounded(op.forward_selection(_percapita(spark, sf), SELECT_Y, SELECT_X))


def q_forward_selection_lags(spark, sf):
    """Candidates with NULLs at the start of every series: each model on its own rows."""
    return rounded(op.forward_selection(_percapita(spark, sf), SELECT_Y, SELECT_LAGS))


# Forecasts ---------------------------------------------------------------------------------


def line_predictions(series: DataFrame) -> DataFrame:
    """A straight line per entity: predictions that SQL can redo, to check what uses them."""
    day = F.datediff("ds", F.lit("2024-01-01").cast("date")).cast("double")
    line = series.groupBy("entity_id").agg(
        F.regr_slope("y", day).alias("slope"), F.regr_intercept("y", day).alias("start")
    )
    return series.join(line, "entity_id").select(
        *KEYS, (F.col("start") + F.col("slope") * day).alias("yhat")
    )


def _train(spark, sf):
    return op.train_split(series_event_type(spark, sf), None, CUTOFF)


def _forecast(spark, sf):
    return wf.training_forecast(series_event_type(spark, sf), None, CUTOFF)


def _supplier_line_errors(spark, sf):
    """In-sample errors of a line per supplier, joined back to the logged feature panel, which is
    kept because both sides read it."""
    panel = _log(spark, sf).persist(StorageLevel.MEMORY_AND_DISK)
    predictions = line_predictions(panel.select(*KEYS, "y"))
    return op.forecast_error(predictions, panel)


def q_join_actual_pred(spark, sf):
    train = _train(spark, sf)
    return rounded(op.join_actual_pred(train, line_predictions(train)))


def q_forecast_error(spark, sf):
    return rounded(
        _supplier_line_errors(spark, sf).select(*KEYS, "y", "yhat", "error", "log_pop", "acctbal"),
        4,
    )


def q_rmse_by_entity(spark, sf):
    train = _train(spark, sf)
    return rounded(op.rmse(op.join_actual_pred(train, line_predictions(train))))


def q_trend_concavity(spark, sf):
    return rounded(op.trend_concavity(_train(spark, sf), "y"))


def _pooled_line_model(spark, sf):
    """Errors of one line through all suppliers, regressed on the features: unlike those of a line
    per supplier, they do not sum to zero in each, so the coefficients mean something."""
    panel = _log(spark, sf).persist(StorageLevel.MEMORY_AND_DISK).withColumn("t", F.datediff("ds", F.lit("2024-01-01").cast("date")).cast("double"))
    line = panel.agg(F.regr_slope("y", "t").alias("slope"), F.regr_intercept("y", "t").alias("start")).first()
    predictions = panel.select(*KEYS, (F.lit(line["start"]) + F.lit(line["slope"]) * F.col("t")).alias("yhat"))
    return op.ols(op.forecast_error(predictions, panel), *ERROR_OLS, *KEYS)


def q_ols_forecast_error(spark, sf):
    return rounded(_pooled_line_model(spark, sf).coef, 5, t=4, p=6)


def q_ols_forecast_error_fit(spark, sf):
    fit = _pooled_line_model(spark, sf).fit
    return rounded(fit.select("y", "n", "rank", "df_model", "df_resid", "r2", "f", "rss"), 4)


def q_forecast_entities(spark, sf):
    return rounded(_forecast(spark, sf))


def q_forecast_insample(spark, sf):
    return rounded(_forecast(spark, sf).where("not is_future"))


def q_forecast_pooled(spark, sf):
    return rounded(op.forecast_pooled(_train(spark, sf)))


def _pooled_rows(spark, sf):
    train = _train(spark, sf)
    return op.predict_rows(train, op.forecast_pooled(train))


def q_forecast_pooled_rows(spark, sf):
    """The pooled model's prediction and error for every row of every entity."""
    return rounded(_pooled_rows(spark, sf))


def q_forecast_pooled_rmse(spark, sf):
    return rounded(op.rmse(_pooled_rows(spark, sf)))


def q_forecast_components(spark, sf):
    return rounded(op.components(_forecast(spark, sf)))


def q_forecast_changepoints(spark, sf):
    return rounded(op.changepoints(_train(spark, sf)))


def q_forecast_rmse(spark, sf):
    return rounded(wf.training_rmse(_forecast(spark, sf)))


def q_forecast_trend_shape(spark, sf):
    return rounded(op.trend_concavity(_forecast(spark, sf)))


def q_forecast_sparse(spark, sf):
    """The few changes of slope of every nation's monthly series."""
    series = panel_nation(spark, sf).select(*KEYS, F.col("cases").alias("y"))
    return rounded(op.changepoints(series, trend="sparse"))


def q_forecast_simulated(spark, sf):
    """Forecasts with bands of simulated courses, the same from one seed."""
    series = _train(spark, sf)
    return rounded(op.forecast(series, trend="sparse", bands="simulated", seed=1))


def q_forecast_suppliers(spark, sf):
    """Every supplier's monthly series forecast in one job."""
    series = _filtered(spark, sf).select(*KEYS, F.col("cases").alias("y"))
    return rounded(op.forecast(series))


def q_forecast_error_model(spark, sf):
    """Forecast every supplier, join errors to the features, regress them on the statics."""
    model = wf.forecast_error_model(_log(spark, sf), *sup.FORMULAS["forecast_error"])
    return rounded(model.coef, 5, t=4, p=6)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_panel": q_scan_panel,
    "panel_filtered": q_panel_filtered,
    "panel_log": q_panel_log,
    "panel_percapita": q_panel_percapita,
    "log_transform": q_log_transform,
    "per_capita": q_per_capita,
    "population_shares": q_population_shares,
    "band_shares": q_band_shares,
    "date_keys": q_date_keys,
    "numeric_view": q_numeric_view,
    "lags_log_cases": q_lags_log_cases,
    "lags_raw_deaths": q_lags_raw_deaths,
    "lags_unfiltered": q_lags_unfiltered,
    "lags_percapita": q_lags_percapita,
    "lags_calendar": q_lags_calendar,
    "lags_sliced": q_lags_sliced,
    "lags_ranged": q_lags_ranged,
    "train_split": q_train_split,
    "future_dates": q_future_dates,
    "union_entities": q_union_entities,
    "describe_measures": _describe("measures"),
    "describe_bands": _describe("bands"),
    "describe_approx": q_describe_approx,
    "describe_shares": _describe("shares"),
    "describe_covariates": _describe("covariates"),
    "skew_report": q_skew_report,
    "weekday_profile": q_weekday_profile,
    "minmax_params": q_minmax_params,
    "minmax_scaled": q_minmax_scaled,
    "corr_matrix": q_corr_matrix,
    "corr_matrix_wide": q_corr_matrix_wide,
    "corr_tiles": q_corr_tiles,
    "corr_targets": q_corr_targets,
    "autocorr_raw": q_autocorr_raw,
    "cross_corr_lags": q_cross_corr_lags,
    "ols_simple": q_ols_simple,
    "ols_multi": q_ols_multi,
    "ols_summary_coef": q_ols_summary_coef,
    "ols_summary_fit": q_ols_summary_fit,
    "ols_cases": _coef("cases"),
    "ols_cases_fit": _fit("cases"),
    "ols_deaths": _coef("deaths"),
    "ols_deaths_fit": _fit("deaths"),
    "ols_percapita": _coef("percapita"),
    "ols_percapita_fit": _fit("percapita"),
    "ols_forecast_error": q_ols_forecast_error,
    "ols_forecast_error_fit": q_ols_forecast_error_fit,
    "ols_together": q_ols_together,
    "ols_together_fit": q_ols_together_fit,
    "forward_selection": q_forward_selection,
    "forward_selection_lags": q_forward_selection_lags,
    "join_actual_pred": q_join_actual_pred,
    "forecast_error": q_forecast_error,
    "rmse_by_entity": q_rmse_by_entity,
    "trend_concavity": q_trend_concavity,
    "forecast_entities": q_forecast_entities,
    "forecast_insample": q_forecast_insample,
    "forecast_pooled": q_forecast_pooled,
    "forecast_pooled_rows": q_forecast_pooled_rows,
    "forecast_pooled_rmse": q_forecast_pooled_rmse,
    "forecast_components": q_forecast_components,
    "forecast_changepoints": q_forecast_changepoints,
    "forecast_rmse": q_forecast_rmse,
    "forecast_trend_shape": q_forecast_trend_shape,
    "forecast_sparse": q_forecast_sparse,
    "forecast_simulated": q_forecast_simulated,
    "forecast_suppliers": q_forecast_suppliers,
    "forecast_error_model": q_forecast_error_model,
}
