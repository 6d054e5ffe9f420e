"""Row lags and calendar lags inside an entity."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The lag offsets, in rows.
OFFSETS = (1, 2, 3, 7, 14, 21, 31)
#: Cells for each range of a large entity, and at most for one; most large entities, which go to all executors.
CELLS, MOST_CELLS, MOST_LARGE = 16, 1 << 14, 1_000_000


def with_lags(
    df: DataFrame,
    keep: Sequence[Column | str],
    exprs: Mapping[str, Column | str],
    by: Sequence[str],
    order: Sequence[str],
    offsets: Sequence[int] = OFFSETS,
    unique: bool = True,
) -> DataFrame:
    """``keep`` and ``{name}_{k}`` over one window: one shuffle, one sort.

    ``keep`` and the lagged values are projected before the shuffle, so it carries results (a
    few bands) and not their inputs (many fine counts). All expressions speak of the columns
    of ``df``, also where ``keep`` reuses a name for something else. With ``unique`` a row whose
    order value equals its predecessor's, or with a NULL key, fails the job; the test rides on the same
    sort, and goes when nobody reads the lags (``scan_panel(..., unique=)`` tests a table once and for all).
    """
    kept = df.select(*keep).columns
    values = {n: F.col(e) if isinstance(e, str) else e for n, e in exprs.items()}
    rows = df.select(
        *keep,
        *[F.col(k) for k in dict.fromkeys([*by, *order]) if k not in kept],
        *[v.alias(f"__value_{n}") for n, v in values.items()],
    )
    window = Window.partitionBy(*by).orderBy(*order)
    lags = {f"{n}_{k}": F.lag(f"__value_{n}", k).over(window) for n in values for k in offsets}
    if not unique:
        return rows.select(*kept, *[c.alias(n) for n, c in lags.items()])
    repeated = F.lag(order[0], 1).over(window) == F.col(order[0])
    wide = rows.select(
        *kept,
        *[c.alias(n) for n, c in lags.items()],
        F.when(_null_key([*by, *order]), F.lit("NULL key"))
        .when(repeated, F.concat(F.lit("duplicate key: two rows at "), F.col(order[0]).cast("string")))
        .alias("__repeated"),
    )
    failure = F.raise_error(F.col("__repeated"))
    return wide.select(
        *kept,
        *[
            F.when(F.col("__repeated").isNotNull(), failure).otherwise(F.col(c)).alias(c)
            for c in lags
        ],
    )


def _null_key(keys: Sequence[str]) -> Column:
    missing = F.lit(False)
    for k in keys:
        missing |= F.col(k).isNull()
    return missing


def add_lags(
    df: DataFrame,
    exprs: Mapping[str, Column | str],
    offsets: Sequence[int] = OFFSETS,
    by: str | Sequence[str] = "entity_id",
    order: str | Sequence[str] = "ds",
    calendar: bool = False,
    unique: bool = True,
    max_rows: int | None = None,
) -> DataFrame:
    """Add ``{name}_{k}``: the value ``k`` rows earlier in the entity.

    ``calendar=True`` looks ``k`` days back instead, giving NULL where that day has no row.

    One window per entity is right when the entity is bounded, as in a panel: one row per date
    is some 37,000 rows a century. Where ``by`` has no such bound (high-frequency order keys,
    entities merged by name), give ``max_rows``: entities with more rows are split into ranges of their first order key of
    about that many, each of which carries the last rows before it, with the same result. ``df`` is then read
    three times: to count entities, to count parts of the large ones, and for the lags.
    """
    keys = [by] if isinstance(by, str) else list(by)
    orders = [order] if isinstance(order, str) else list(order)
    checked = unique and len(orders) == 1
    if calendar:
        return _calendar_lags(df, exprs, offsets, keys, orders[0], checked)
    if max_rows is not None:
        return _ranged_lags(df, exprs, offsets, keys, orders, checked, max_rows)
    return with_lags(df, ["*"], exprs, keys, orders, offsets, checked)


def _calendar_lags(df, exprs, offsets, keys, order, checked):
    base = Window.partitionBy(*keys).orderBy(F.unix_date(F.col(order)))
    values = {n: F.col(e) if isinstance(e, str) else e for n, e in exprs.items()}
    if checked:
        # Rows on this very day, read with every value so that it goes when they go.
        same_day = F.count(F.lit(1)).over(base.rangeBetween(0, 0))
        df = df.withColumn("__same_day", same_day)
        null_key = _null_key([*keys, order])
        message = F.when(null_key, "NULL key").otherwise(
            F.concat(F.lit("duplicate key: two rows at "), F.col(order).cast("string"))
        )
        values = {
            n: F.when(null_key | (F.col("__same_day") > 1), F.raise_error(message)).otherwise(v)
            for n, v in values.items()
        }
    lagged = df.select(
        "*",
        *[
            F.max(v).over(base.rangeBetween(-k, -k)).alias(f"{n}_{k}")
            for n, v in values.items()
            for k in offsets
        ],
    )
    return lagged.drop("__same_day")


def _place(df: DataFrame, order: str) -> Column:
    """A number that does not fall as the order key grows."""
    kind = dict(df.dtypes)[order]
    if kind == "date":
        return F.unix_date(order).cast("double")
    if kind == "timestamp":
        return F.unix_micros(order).cast("double")
    if kind == "timestamp_ntz":
        return F.unix_micros(F.col(order).cast("timestamp")).cast("double")
    if not kind.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")):
        raise ValueError(f"ranges need a date, a time or a number to order by, and {order} is {kind}")
    return F.col(order).cast("double")


def _ranged_lags(df, exprs, offsets, keys, orders, checked, max_rows):
    """Lags with large entities in ranges.

    The span of a large entity is cut into ``CELLS`` equal cells for each range it will have, and the rows of the cells are
    counted, map-side combined: so the number of rows before each cell is known without a sort. Neighbouring cells make
    a range of ``max_rows`` rows or a little more; the cells with the last rows before a range are read by it as well.
    """
    halo = max(offsets)
    if max_rows < halo:
        raise ValueError("max_rows must be at least the largest offset")
    place = _place(df, orders[0])
    entity = df.groupBy(*keys).agg(F.count(place).alias("__n"), F.min(place).alias("__lo"), F.max(place).alias("__hi"))
    total = entity.agg(F.sum("__n"), F.max("__n")).first()
    rows = max(max_rows, (total[0] or 0) // MOST_LARGE)
    if (total[1] or 0) <= rows:
        return with_lags(df, ["*"], exprs, keys, orders, offsets, checked)
    # No more than MOST_LARGE of them, about a hundred bytes each.
    cells = F.least(F.lit(MOST_CELLS), CELLS * F.ceil(F.col("__n") / rows)).cast("int")
    large = entity.where(F.col("__n") > rows).select(*[F.col(k).alias(f"__e_{k}") for k in keys], "__lo", "__hi", cells.alias("__cells"))
    same = [F.col(k) == F.col(f"__e_{k}") for k in keys]
    share = F.try_divide(place - F.col("__lo"), F.col("__hi") - F.col("__lo"))
    cell = F.least(F.col("__cells") - 1, F.coalesce(F.floor(share * F.col("__cells")).cast("int"), F.lit(0)))
    placed = df.join(F.broadcast(large), same, "left").withColumn("__cell", F.when(place.isNotNull(), cell))

    counted = placed.where("__cell is not null").groupBy(*keys, "__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    counted = counted.withColumn("__home", F.floor(F.col("__before") / rows).cast("int"))
    whole = Window.partitionBy(*keys)
    starts = F.array_agg(F.when(F.col("__first"), F.struct(F.col("__home").alias("home"), F.col("__before").alias("before"))))
    first = F.lag("__home").over(Window.partitionBy(*keys).orderBy("__cell"))
    counted = counted.withColumn("__first", first.isNull() | (first != F.col("__home")))
    counted = counted.withColumn("__starts", starts.over(whole))
    # A later range looks at the cells that reach into the rows just before it.
    reads = F.transform(
        F.filter("__starts", lambda s: (s["home"] > F.col("__home")) & (s["before"] - halo < F.col("__before") + F.col("__n"))),
        lambda s: s["home"],
    )
    ranges = counted.select(*[F.col(k).alias(f"__c_{k}") for k in keys], F.col("__cell").alias("__c"), "__home", F.concat(F.array("__home"), reads).alias("__ranges"))
    same = [F.col(k) == F.col(f"__c_{k}") for k in keys] + [F.col("__cell") == F.col("__c")]
    found = placed.join(ranges, same, "left").withColumn("__home", F.coalesce("__home", F.lit(0)))
    copies = found.withColumn("__range", F.explode(F.coalesce("__ranges", F.array(F.lit(0)))))
    # Rows of one order value share a cell, so the check for repeated keys holds here too.
    lagged = with_lags(copies, [*df.columns, "__home", "__range"], exprs, [*keys, "__range"], orders, offsets, checked)
    return lagged.where(F.col("__home") == F.col("__range")).drop("__home", "__range")
