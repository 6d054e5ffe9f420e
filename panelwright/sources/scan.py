"""Reading a panel table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def scan_panel(
    spark: SparkSession,
    source: str,
    columns: Sequence[str] | dict[str, str] | None = None,
    where: Column | None = None,
    unique: Sequence[str] = (),
) -> DataFrame:
    """Lazy scan of a parquet path or a catalog table, with projection, renames and a filter.

    ``columns`` is a list of names or a map ``{output name: source name}``; ``where`` speaks of
    source names and reaches the parquet reader. NaN becomes NULL. The filter is applied once
    more after that, because Spark sorts NaN above every number and would let it pass ``> 0``.
    ``unique`` names the source's keys: a job at once makes sure that they are neither NULL nor repeated.
    """
    df = spark.read.parquet(source) if "/" in source else spark.table(source)
    if where is not None:
        clean = nan_to_null(df.where(where))
        df = clean.where(where) if clean is not df else df.where(where)
    else:
        df = nan_to_null(df)
    if unique:
        assert_unique(df, unique)
    if columns is None:
        return df
    names = columns if isinstance(columns, dict) else {c: c for c in columns}
    return df.select(*[F.col(src).alias(out) for out, src in names.items()])


def nan_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Turn NaN into NULL: one NaN makes ``max`` and ``corr`` NaN and is counted by ``count``."""
    chosen = set(df.columns if cols is None else cols)
    doubles = {n for n, t in df.dtypes if t in ("double", "float") and n in chosen}
    if not doubles:
        return df
    return df.select(
        *[
            F.when(~F.isnan(c), F.col(c)).alias(c) if c in doubles else F.col(c)
            for c in df.columns
        ]
    )


#: Nodes of an optimized plan that cost no more than reading what is below them.
_CHEAP = frozenset("Project Filter SubqueryAlias LocalLimit GlobalLimit Sample".split())


def is_scan(df: DataFrame) -> bool:
    """Whether reading ``df`` again costs no more than a scan: nothing but projections and filters over tables or cached rows."""
    left = [df._jdf.queryExecution().optimizedPlan()]
    while left:
        node = left.pop()
        below = node.children()
        if below.size() and node.nodeName() not in _CHEAP:
            return False
        left += [below.apply(k) for k in range(below.size())]
    return True


def unique_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` itself, failing at run time when two rows share the same ``keys`` or a key is NULL.

    The test rides on a sort by the keys, which a join on them needs anyway and reuses.
    """
    window = Window.partitionBy(*keys).orderBy(*keys)
    name = F.concat_ws(" ", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys])
    missing = F.lit(False)
    for k in keys:
        missing |= F.col(k).isNull()
    failure = F.raise_error(
        F.concat(F.when(missing, "NULL key").otherwise("duplicate key"), F.lit(f" ({', '.join(keys)}): "), name)
    )
    tested = df.withColumn("__repeated", (F.row_number().over(window) > 1) | missing)
    fine = F.when(F.col("__repeated"), failure.cast("boolean")).otherwise(F.lit(True))
    return tested.where(fine).drop("__repeated")


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` itself, after a job that made sure that no key is NULL and no two rows share their
    ``keys``, whichever columns are read later. Counts are combined map-side."""
    repeated = df.groupBy(*keys).count()
    missing = F.lit(False)
    for k in keys:
        missing |= F.col(k).isNull()
    bad = repeated.where((F.col("count") > 1) | missing).first()
    if bad is not None:
        kind = "NULL key" if any(bad[k] is None for k in keys) else "duplicate key"
        raise ValueError(f"{kind} ({', '.join(keys)}): {' '.join(str(bad[k]) for k in keys)}")
    return df
