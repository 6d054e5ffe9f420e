"""Row-wise features: logs, ratios, shares, regrouped bands, date keys, numeric view."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions import band_share, date_key, ratio, round_ln


def log_transform(df: DataFrame, cols: Sequence[str], prefix: str = "log_") -> DataFrame:
    """Add the rounded natural log of each column, to tame a right skew before regression."""
    return df.select("*", *[round_ln(c).alias(f"{prefix}{c}") for c in cols])


def per_capita(df: DataFrame, ratios: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Add ``{output: (numerator, denominator)}``; a zero denominator gives NULL."""
    return df.select("*", *[ratio(n, d).alias(out) for out, (n, d) in ratios.items()])


def population_shares(df: DataFrame, shares: Mapping[str, str], denominator: str) -> DataFrame:
    """Add ``{output: count column}`` divided by the population."""
    return per_capita(df, {out: (cnt, denominator) for out, cnt in shares.items()})


def band_shares(
    df: DataFrame, bands: Mapping[str, Sequence[str]], denominator: str
) -> DataFrame:
    """Regroup fine counts into coarse shares: ``{output: [fine count columns]}``."""
    return df.select("*", *[band_share(c, denominator).alias(out) for out, c in bands.items()])


def date_keys(df: DataFrame, col: str, out: str = "ds") -> DataFrame:
    """Add (or replace) ``out`` with the ``yyyy-MM-dd`` text of a date or timestamp."""
    return df.withColumn(out, date_key(col))


def numeric_view(df: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    """Keep the numeric columns, less any named key, ready for correlation and regression."""
    keep = [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.NumericType) and f.name not in drop
    ]
    return df.select(*keep)
