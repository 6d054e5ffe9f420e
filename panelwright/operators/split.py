"""Train split, future dates and appending of entity frames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def train_split(
    df: DataFrame,
    entities: Sequence | None,
    cutoff: str,
    by: str = "entity_id",
    order: str = "ds",
) -> DataFrame:
    """Rows of the chosen entities up to and including the cutoff date."""
    rows = df.where(F.col(order) <= F.lit(cutoff).cast("date"))
    return rows if entities is None else rows.where(F.col(by).isin(*entities))


def future_dates(
    df: DataFrame, horizon: int = 14, by: Sequence[str] = ("entity_id",), order: str = "ds"
) -> DataFrame:
    """The dates of every entity plus ``horizon`` further days, as ``(by..., ds, is_future)``."""
    keys = list(by)
    history = df.select(*keys, order).distinct().withColumn("is_future", F.lit(False))
    last = df.groupBy(*keys).agg(F.max(order).alias("__last"))
    days = F.sequence(F.date_add("__last", 1), F.date_add("__last", horizon))
    future = last.select(*keys, F.explode(days).alias(order), F.lit(True).alias("is_future"))
    return history.unionByName(future)


def entity_frames(
    df: DataFrame, entities: Sequence, extra: dict | None = None, by: str = "entity_id"
) -> DataFrame:
    """The frames of chosen entities appended by name, from one scan: the rows of all of them, with
    the columns ``extra = {entity: {name: expression}}`` of some, NULL for the others."""
    out = df.where(F.col(by).isin(*entities))
    names: dict[str, Column] = {}
    for entity, columns in (extra or {}).items():
        for name, e in columns.items():
            here = F.when(F.col(by) == entity, e)
            names[name] = F.coalesce(names[name], here) if name in names else here
    return out.withColumns(names) if names else out


def union_entities(*frames: DataFrame) -> DataFrame:
    """Append frames by column name; a column a frame lacks becomes NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
