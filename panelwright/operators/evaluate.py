"""Joining predictions to actuals, errors, RMSE and the shape of a trend."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelwright.sources.scan import unique_rows

KEYS = ("entity_id", "ds")


def join_actual_pred(
    actual: DataFrame, predicted: DataFrame, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Every actual row with its prediction, all entities at once; a prediction key that
    appears twice fails the job, so the number of rows is that of ``actual``."""
    return actual.join(unique_rows(predicted, keys), list(keys), "left")


def forecast_error(
    predicted: DataFrame, panel: DataFrame, y: str = "y", keys: Sequence[str] = KEYS
) -> DataFrame:
    """Predictions joined back to the feature panel, with ``error`` = panel's y - yhat.

    Panel columns whose names clash, one named ``error`` included, get the suffix ``_panel``.
    """
    if "error" in predicted.columns:
        raise ValueError("the predictions have a column named error already")
    clash = {*predicted.columns, "error"} & set(panel.columns) - set(keys)
    right = panel.select(*[F.col(c).alias(f"{c}_panel") if c in clash else c for c in panel.columns])
    actual = f"{y}_panel" if y in clash else y
    return predicted.join(unique_rows(right, keys), list(keys), "left").withColumn(
        "error", F.col(actual) - F.col("yhat")
    )


def rmse(
    df: DataFrame, by: Sequence[str] = ("entity_id",), y: str = "y", yhat: str = "yhat"
) -> DataFrame:
    """Root mean square error and row count per entity. A missing prediction fails the job
    rather than shrinking the denominator."""
    predicted = F.when(F.col(yhat).isNotNull(), F.col(yhat)).otherwise(
        F.raise_error(F.lit("row without a prediction")).cast("double")
    )
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.sqrt(F.avg(F.pow(F.col(y) - predicted, F.lit(2.0)))).alias("rmse"),
    )


def trend_concavity(
    df: DataFrame, value: str = "trend", by: str = "entity_id", order: str = "ds"
) -> DataFrame:
    """Mean second difference of a series per entity, and the shape it means.

    A mean within 1e-9 of the series' mean size is rounding noise and counts as linear.
    """
    window = Window.partitionBy(by).orderBy(order)
    v = F.col(value)
    bend = v - 2 * F.lag(v, 1).over(window) + F.lag(v, 2).over(window)
    mean, noise = F.col("mean_second_difference"), F.col("__size") * 1e-9
    return (
        df.select(by, bend.alias("__bend"), F.abs(v).alias("__abs"))
        .groupBy(by)
        .agg(F.avg("__bend").alias("mean_second_difference"), F.avg("__abs").alias("__size"))
        .withColumn(
            "shape",
            F.when(mean > noise, "convex")
            .when(mean < -noise, "concave")
            .when(mean.isNotNull(), "linear"),
        )
        .drop("__size")
    )
