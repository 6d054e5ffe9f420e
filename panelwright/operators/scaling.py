"""Min-max scaling with reusable parameters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.sources.scan import nan_to_null


def minmax_fit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with ``{col}_min`` and ``{col}_max``; combined map-side in a single pass. NaN counts
    as NULL."""
    return nan_to_null(df.select(*cols)).agg(
        *[
            f(F.col(c).cast("double")).alias(f"{c}_{end}")
            for c in cols
            for end, f in (("min", F.min), ("max", F.max))
        ]
    )


def minmax_columns(params: Mapping[str, float | None], cols: Sequence[str]) -> dict[str, Column]:
    """Each of ``cols`` scaled by the parameters, as an expression."""
    scaled = {}
    for c in cols:
        lo, hi = params[f"{c}_min"], params[f"{c}_max"]
        x = F.col(c).cast("double")
        if lo is None:
            out = F.lit(None).cast("double")
        elif hi == lo:
            out = F.when(x.isNotNull(), x - F.lit(lo))
        else:
            out = (x - F.lit(lo)) / F.lit(hi - lo)
        scaled[c] = out.alias(c)
    return scaled


def minmax_transform(df: DataFrame, params: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Scale ``cols`` to [0, 1] in place; a constant column gives 0, NULL and NaN give NULL.

    The parameters are two numbers per column. They become literals of the plan, so scaling
    is a projection and needs neither a join nor a broadcast.
    """
    scaled = minmax_columns(params.first().asDict(), cols)
    df = nan_to_null(df, cols)
    return df.select(*[scaled.get(c, F.col(c)) for c in df.columns])
