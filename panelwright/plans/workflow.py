"""Whole analyses: scaled models, and forecast -> error -> RMSE -> regression on the error."""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.operators.evaluate import forecast_error, rmse
from panelwright.operators.forecast import forecast, predict_rows
from panelwright.operators.regress import OlsModel, ols, ols_together
from panelwright.operators.scaling import minmax_fit, minmax_transform
from panelwright.operators.split import train_split
from panelwright.plans.panels import PanelSpec, panel_log


def scaled(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``df`` with ``cols`` min-max scaled by their own range.

    ``df`` is marked to be kept, so that range and result are one computation of it; ``df.unpersist()``
    releases it.
    """
    df.persist(StorageLevel.MEMORY_AND_DISK)
    return minmax_transform(df, minmax_fit(df, cols), cols)


def scaled_ols(
    df: DataFrame, y: str, xs: Sequence[str], by: str | None = None, order: str | None = None
) -> OlsModel:
    """Model on min-max scaled columns. The scaler sees all rows, the model the complete ones,
    so the columns are kept while both passes read them."""
    keys = [k for k in (by, order) if k]
    data = df.select(*dict.fromkeys([*keys, y, *xs]))
    try:
        return ols(scaled(data, [y, *xs]), y, xs, by, order, keep=False)
    finally:
        data.unpersist()


def models_together(
    source: DataFrame, spec: PanelSpec, formulas: Mapping[str, tuple[str, Sequence[str]]],
    scaled: Collection[str], percapita: Collection[str], **settings,
) -> dict[str, OlsModel]:
    """Models of the logged and of the per-capita panel from one panel, read once.

    ``scaled`` are on min-max scaled columns. The lags in the formulas named in ``percapita`` are those of the per-capita
    ratios; their terms keep the usual names.
    """
    own = "percapita_"
    lags = {f"{n}_{k}" for n in (spec.case_lag, spec.death_lag) for k in spec.offsets}
    panel = panel_log(source, spec, percapita=own)
    named = {
        name: (y, [own + x if name in percapita and x in lags else x for x in xs]) for name, (y, xs) in formulas.items()
    }
    models = ols_together(panel, named, spec.entity, spec.date, scaled=scaled, **settings)
    for name in percapita:
        term = F.regexp_replace("term", f"^{own}", "")
        models[name] = replace(models[name], coef=models[name].coef.withColumn("term", term))
    return models


def training_forecast(
    series: DataFrame, entities: Sequence | None, cutoff: str, by: str = "entity_id", **settings
) -> DataFrame:
    """Forecast frame of the chosen entities trained up to the cutoff."""
    keep = series.select(by, "ds", "y")
    return forecast(train_split(keep, entities, cutoff, by), by=(by,), **settings)


def training_error(
    forecasts: DataFrame, panel: DataFrame, by: str = "entity_id"
) -> DataFrame:
    """In-sample rows of a forecast frame joined to the panel, with ``error``."""
    in_sample = forecasts.where("not is_future").drop("is_future")
    return forecast_error(in_sample, panel, keys=(by, "ds"))


def training_rmse(
    forecasts: DataFrame, series: DataFrame | None = None, by: str | Sequence[str] = "entity_id"
) -> DataFrame:
    """RMSE per entity over the training rows.

    A forecast has one row per date. Where dates repeat, pass the training ``series``: every row of it
    then counts. Without it each date must stand for one row, or the job fails.
    """
    keys = [by] if isinstance(by, str) else list(by)
    in_sample = forecasts.where("not is_future")
    if series is not None:
        return rmse(predict_rows(series, in_sample, keys), by=keys)
    single = F.when(F.col("n_obs") == 1, F.col("y")).otherwise(
        F.raise_error(F.lit("a date has several rows: pass the series")).cast("double")
    )
    return rmse(in_sample.withColumn("y", single), by=keys)


def forecast_error_model(
    panel: DataFrame, y: str, xs: Sequence[str], by: str = "entity_id",
    entities: Sequence | None = None, cutoff: str | None = None, **settings,
) -> OlsModel:
    """Forecast the raw cases of the chosen entities of ``panel`` from their rows up to ``cutoff``
    (default: all of both), join the in-sample errors back to the features, and regress ``y``
    (``error``) on ``xs``. The panel is kept while both the forecast and the join read it."""
    rows = panel.select(*dict.fromkeys([by, "ds", "y", *xs]))
    rows = rows if entities is None else rows.where(F.col(by).isin(*entities))
    rows = rows if cutoff is None else rows.where(F.col("ds") <= F.lit(cutoff).cast("date"))
    data = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        forecasts = forecast(data.select(by, "ds", "y"), by=(by,), **settings)
        return ols(training_error(forecasts, data, by), y, xs, by, "ds")
    finally:
        data.unpersist()
