from panelwright.operators.correlate import corr_matrix, corr_targets, correlate
from panelwright.operators.describe import describe, skew_report, weekday_profile
from panelwright.operators.evaluate import (
    forecast_error,
    join_actual_pred,
    rmse,
    trend_concavity,
)
from panelwright.operators.features import (
    band_shares,
    date_keys,
    log_transform,
    numeric_view,
    per_capita,
    population_shares,
)
from panelwright.operators.forecast import (
    changepoints,
    components,
    forecast,
    forecast_pooled,
    predict_rows,
)
from panelwright.operators.lags import OFFSETS, add_lags
from panelwright.operators.regress import OlsModel, ols, ols_together
from panelwright.operators.scaling import minmax_fit, minmax_transform
from panelwright.operators.selection import forward_selection
from panelwright.operators.split import entity_frames, future_dates, train_split, union_entities

__all__ = [
    "OFFSETS",
    "OlsModel",
    "add_lags",
    "band_shares",
    "changepoints",
    "components",
    "corr_matrix",
    "corr_targets",
    "correlate",
    "date_keys",
    "describe",
    "entity_frames",
    "forecast",
    "forecast_error",
    "forecast_pooled",
    "forward_selection",
    "future_dates",
    "join_actual_pred",
    "log_transform",
    "minmax_fit",
    "minmax_transform",
    "numeric_view",
    "ols",
    "ols_together",
    "per_capita",
    "population_shares",
    "predict_rows",
    "rmse",
    "skew_report",
    "train_split",
    "trend_concavity",
    "union_entities",
    "weekday_profile",
]
