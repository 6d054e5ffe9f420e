"""Tiny frames and numpy references for the tests."""

import datetime as dt

import numpy as np

DAY0 = dt.date(2024, 1, 1)


def day(i):
    return DAY0 + dt.timedelta(days=int(i))


def panel(spark, values, name="y", kind="double"):
    """``{entity: {day number: value}}`` as an (entity_id, ds, y) frame."""
    rows = [
        (e, day(d), None if v is None else (float(v) if kind == "double" else int(v)))
        for e, series in values.items()
        for d, v in series.items()
    ]
    return spark.createDataFrame(rows, f"entity_id string, ds date, {name} {kind}")


def column(spark, values, name="x"):
    return spark.createDataFrame([(v,) for v in values], f"{name} double")


def lstsq(y, x):
    """Coefficients with intercept, residual sum of squares, n and rank, on complete rows."""
    data = np.column_stack([y, *x]).astype(float)
    data = data[~np.isnan(data).any(axis=1)]
    design = np.column_stack([np.ones(len(data)), data[:, 1:]])
    beta, _, rank, _ = np.linalg.lstsq(design, data[:, 0], rcond=None)
    residual = data[:, 0] - design @ beta
    return beta, float(residual @ residual), len(data), int(rank), design, data[:, 0]


def adj_r2(y, x):
    _, rss, n, rank, _, target = lstsq(y, x)
    tss = float(((target - target.mean()) ** 2).sum())
    return 1 - rss / tss * (n - 1) / (n - rank)
