"""Ordinary least squares with intercept, on complete rows.

One pass over the data reduces the design to its K x K triangular factor in the tasks; the solve
happens on the driver, by singular values of that factor. A second pass, made of built-in
expressions only, takes the moments of the residuals.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelwright.functions.distributions import (
    chi2_upper_2df,
    f_upper,
    t_quantile,
    t_two_sided,
)
from panelwright.operators.factors import Factor, collect_factors
from panelwright.operators.scaling import minmax_columns, minmax_fit
from panelwright.sources.scan import is_scan, nan_to_null

COEF_SCHEMA = "term string, coef double, se double, t double, p double, lo double, hi double"
FIT_SCHEMA = (
    "y string, n bigint, rank int, df_model int, df_resid bigint, r2 double, adj_r2 double, "
    "f double, f_p double, llf double, aic double, bic double, rss double, sigma2 double, "
    "skew double, kurtosis double, omnibus double, omnibus_p double, jarque_bera double, "
    "jarque_bera_p double, durbin_watson double, condition_number double"
)


@dataclass
class LinearFit:
    """Least-squares solution; the intercept comes first in ``beta`` and ``unit_cov``."""

    n: int
    rank: int
    beta: np.ndarray
    unit_cov: np.ndarray
    rss: float
    tss: float
    condition_number: float

    @property
    def df_resid(self) -> int:
        return self.n - self.rank

    @property
    def r2(self) -> float:
        return 1.0 - self.rss / self.tss if self.tss > 0 else math.nan

    @property
    def adj_r2(self) -> float:
        if self.df_resid <= 0:
            return math.nan
        return 1.0 - (1.0 - self.r2) * (self.n - 1) / self.df_resid


def solve(factor: Factor, y: int, xs: Sequence[int]) -> LinearFit:
    """Least squares of column ``y`` on columns ``xs`` and a constant, from the rows' factor.

    Columns are scaled to length 1 before singular values are judged, so units do not matter;
    values under rounding error count as zero. On a collinear design the result is the
    shortest coefficient vector, as a pseudo-inverse of the design would give, and ``rank`` counts
    the independent columns, the constant included.
    """
    xs = list(xs)
    k = len(xs) + 1
    r = factor.take([*xs, y])
    x, target = r[:, :k], r[:, k]
    size = np.linalg.norm(x, axis=0)
    unit = np.where(size > 0, size, 1.0)
    left, values, right = np.linalg.svd(x / unit, full_matrices=False)
    kept = values > np.finfo(float).eps * max(factor.n, k) ** 0.5 * k * values[0]
    inverse = (right[kept].T / values[kept]) / unit[:, None]
    beta = inverse @ (left[:, kept].T @ target)
    unit_cov = inverse @ inverse.T
    if not kept.all():
        q, _ = np.linalg.qr((right[~kept] / unit).T)
        project = np.eye(k) - q @ q.T
        beta = project @ beta
        unit_cov = project @ unit_cov @ project
        # A term that lies in the null space as a whole (a column of zeros) is exactly zero.
        void = np.diag(project) < 1e-12
        beta[void] = 0.0
        unit_cov[void, :] = unit_cov[:, void] = 0.0
    missed = target - left[:, kept] @ (left[:, kept].T @ target)
    raw = np.linalg.svd(x, compute_uv=False)
    return LinearFit(
        factor.n, int(kept.sum()), beta, unit_cov, float(missed @ missed), float(target[1:] @ target[1:]),
        float(raw[0] / raw[-1]) if raw[-1] > 0 else math.inf,
    )


def linear_predictor(beta: Sequence[float], xs: Sequence[str]) -> Column:
    terms = [F.lit(float(b)) * F.col(x).cast("double") for b, x in zip(beta[1:], xs)]
    return reduce(add, terms, F.lit(float(beta[0])))


@dataclass
class OlsModel:
    """``coef``: one row per term; ``fit``: one row; ``residuals``: the complete rows with
    ``yhat`` and ``residual``, lazy."""

    coef: DataFrame
    fit: DataFrame
    residuals: DataFrame


def ols(
    df: DataFrame,
    y: str,
    xs: Sequence[str],
    by: str | None = None,
    order: str | None = None,
    level: float = 0.95,
    keep: bool = True,
) -> OlsModel:
    """Regress ``y`` on ``xs`` with an intercept, over the rows complete in these columns.

    The rows are read twice; ``keep`` holds them between unless ``df`` is no more than a scan, needless
    also where it is a cached table.

    NaN counts as NULL. ``by`` and ``order`` name the entity and date keys. The Durbin-Watson statistic needs them:
    it sums successive differences inside each entity; without them it is NULL.
    """
    spark = df.sparkSession
    xs = list(xs)
    keys = [k for k in (by, order) if k]
    df = nan_to_null(df, [y, *xs])
    data = df.select(*dict.fromkeys([*keys, y, *xs])).dropna(subset=[y, *xs])
    keep = keep and not is_scan(data)
    if keep:
        data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        factor = collect_factors(data, [y, *xs]).get("")
        if factor is None:
            raise ValueError("no complete row for this formula")
        model = solve(factor, 0, range(1, len(xs) + 1))
        diagnostics = _residual_moments(data, y, linear_predictor(model.beta, xs), by, order)
    finally:
        if keep:
            data.unpersist()
    fitted = df.dropna(subset=[y, *xs]).withColumn("yhat", linear_predictor(model.beta, xs))
    return OlsModel(
        spark.createDataFrame(_coef_rows(model, xs, diagnostics["rss"], level), COEF_SCHEMA),
        spark.createDataFrame([_fit_row(model, y, diagnostics)], FIT_SCHEMA),
        fitted.withColumn("residual", F.col(y) - F.col("yhat")),
    )


def ols_together(
    df: DataFrame,
    formulas: Mapping[str, tuple[str, Sequence[str]]],
    by: str | None = None,
    order: str | None = None,
    level: float = 0.95,
    scaled: Collection[str] = (),
) -> dict[str, OlsModel]:
    """Several models ``name: (y, xs)`` on one frame; each uses the rows complete in its own columns.

    One pass keeps a factor for each formula, all from the same batches and the same test for missing values; a
    second one takes the moments of all residuals. The models named in ``scaled`` are those on columns
    min-max scaled over all rows: scaling is linear, so it is applied to the factor and not to the rows.
    Columns are computed once and held between the passes.
    """
    spark = df.sparkSession
    formulas = {name: (y, list(xs)) for name, (y, xs) in formulas.items()}
    columns = list(dict.fromkeys(c for y, xs in formulas.values() for c in (y, *xs)))
    keys = [k for k in (by, order) if k]
    df = nan_to_null(df, columns)
    data = df.select(*dict.fromkeys([*keys, *columns])).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        places = {name: [columns.index(c) for c in (y, *xs)] for name, (y, xs) in formulas.items()}
        factors = collect_factors(data, columns, _by_formula(places))
        if missing := [name for name in formulas if name not in factors]:
            raise ValueError(f"no complete row for the formula of {missing[0]}")
        wide = list(dict.fromkeys(c for name in scaled for c in (formulas[name][0], *formulas[name][1])))
        params = minmax_fit(data, wide).first().asDict() if wide else {}
        fits, errors, values = {}, {}, {}
        for name, (y, xs) in formulas.items():
            exprs = minmax_columns(params, [y, *xs]) if name in scaled else {c: F.col(c).cast("double") for c in (y, *xs)}
            factor = _scaled_factor(factors[name], [y, *xs], params) if name in scaled else factors[name]
            fits[name] = solve(factor, 0, range(1, len(xs) + 1))
            values[name] = exprs
            errors[name] = exprs[y] - _predictor(fits[name].beta, [exprs[x] for x in xs])
        moments = _moments_together(data, errors, by, order)
    finally:
        data.unpersist()
    out = {}
    for name, (y, xs) in formulas.items():
        fitted = df.dropna(subset=[y, *xs]).select(*[values[name].get(c, F.col(c)).alias(c) for c in df.columns])
        fitted = fitted.withColumn("yhat", linear_predictor(fits[name].beta, xs))
        out[name] = OlsModel(
            spark.createDataFrame(_coef_rows(fits[name], xs, moments[name]["rss"], level), COEF_SCHEMA),
            spark.createDataFrame([_fit_row(fits[name], y, moments[name])], FIT_SCHEMA),
            fitted.withColumn("residual", F.col(y) - F.col("yhat")),
        )
    return out


def _by_formula(places: Mapping[str, list[int]]):
    """For each formula its columns of the rows that are complete in them."""

    def group(x: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
        there = ~np.isnan(x)
        for name, cols in places.items():
            yield name, x[there[:, cols].all(axis=1)][:, cols]

    return group


def _scaled_factor(factor: Factor, cols: Sequence[str], params: Mapping[str, float]) -> Factor:
    """The factor of the min-max scaled columns: of a linear map of the rows it is the same map of its own columns."""
    r = factor.r.copy()
    for k, c in enumerate(cols, start=1):
        lo, hi = params[f"{c}_min"], params[f"{c}_max"]
        r[:, k] = (r[:, k] - lo * r[:, 0]) / (hi - lo) if hi > lo else 0.0
    return Factor(factor.n, r)


def _predictor(beta: Sequence[float], xs: Sequence[Column]) -> Column:
    return reduce(add, [F.lit(float(b)) * x for b, x in zip(beta[1:], xs)], F.lit(float(beta[0])))


def _moments_together(
    data: DataFrame, errors: Mapping[str, Column], by: str | None, order: str | None
) -> dict[str, dict[str, float | None]]:
    """What :func:`_residual_moments` gives, for several residuals at once; NULL where a row lacks something."""
    names = list(errors)
    keys = [F.col(c).alias(f"__{n}") for n, c in (("by", by), ("order", order)) if c]
    rows = data.select(*keys, *[errors[n].alias(f"__e{k}") for k, n in enumerate(names)])
    if by and order:
        before = Window.partitionBy("__by").orderBy("__order").rowsBetween(Window.unboundedPreceding, -1)
        rows = rows.select("*", *[F.last(f"__e{k}", ignorenulls=True).over(before).alias(f"__b{k}") for k in range(len(names))])
    found = []
    for k in range(len(names)):
        e = F.col(f"__e{k}")
        step = e - F.col(f"__b{k}") if by and order else F.lit(None).cast("double")
        found += [F.sum(e * e).alias(f"rss{k}"), F.skewness(e).alias(f"skew{k}"), F.kurtosis(e).alias(f"excess{k}"), F.sum(step * step).alias(f"successive{k}")]
    row = rows.agg(*found).first()
    return {n: {m: row[f"{m}{k}"] for m in ("rss", "skew", "excess", "successive")} for k, n in enumerate(names)}


def _residual_moments(
    data: DataFrame, y: str, predictor: Column, by: str | None, order: str | None
) -> dict[str, float | None]:
    e = F.col("__e")
    keys = [F.col(c).alias(f"__{n}") for n, c in (("by", by), ("order", order)) if c]
    rows = data.select(*keys, (F.col(y) - predictor).alias("__e"))
    successive = F.lit(None).cast("double")
    if by and order:
        rows = rows.withColumn("__before", F.lag("__e").over(Window.partitionBy("__by").orderBy("__order")))
        successive = F.sum((e - F.col("__before")) * (e - F.col("__before")))
    row = rows.agg(
        F.sum(e * e).alias("rss"),
        F.skewness(e).alias("skew"),
        F.kurtosis(e).alias("excess"),
        successive.alias("successive"),
    ).first()
    return row.asDict()


def _coef_rows(model: LinearFit, xs: Sequence[str], rss: float, level: float) -> list[tuple]:
    df = model.df_resid
    half = t_quantile((1 + level) / 2, df) if df > 0 else math.nan
    rows = []
    for term, b, var in zip(["Intercept", *xs], model.beta, np.diag(model.unit_cov)):
        b = float(b)
        se = math.sqrt(max(rss / df * float(var), 0.0)) if df > 0 else math.nan
        if se > 0:
            t = b / se
            rows.append((term, b, se, t, t_two_sided(t, df), b - half * se, b + half * se))
        else:
            rows.append((term, b, _number(se), None, None, None, None))
    return rows


def _number(x: float | None) -> float | None:
    return None if x is None or not math.isfinite(x) else float(x)


def _fit_row(model: LinearFit, y: str, diagnostics: dict) -> tuple:
    n, rank, df, rss = model.n, model.rank, model.df_resid, diagnostics["rss"]
    explained = model.tss - rss
    r2 = 1.0 - rss / model.tss if model.tss > 0 else None
    adj = 1.0 - (1.0 - r2) * (n - 1) / df if r2 is not None and df > 0 else None
    f = f_p = llf = aic = bic = None
    if rank > 1 and df > 0 and rss > 0:
        f = explained / (rank - 1) / (rss / df)
        f_p = f_upper(f, rank - 1, df)
    if rss > 0:
        llf = -n / 2 * (math.log(2 * math.pi) + math.log(rss / n) + 1)
        aic = -2 * llf + 2 * rank
        bic = -2 * llf + rank * math.log(n)
    skew, kurt = diagnostics["skew"], diagnostics["excess"]
    kurt = None if kurt is None else kurt + 3
    omnibus = _omnibus(n, skew, kurt)
    jb = None if skew is None or kurt is None else n / 6 * (skew**2 + (kurt - 3) ** 2 / 4)
    dw = diagnostics["successive"] / rss if diagnostics["successive"] is not None and rss else None
    return (
        y, n, rank, rank - 1, df, r2, adj, f, f_p, llf, aic, bic, rss,
        rss / df if df > 0 else None, skew, kurt,
        omnibus, None if omnibus is None else chi2_upper_2df(omnibus),
        jb, None if jb is None else chi2_upper_2df(jb),
        dw, _number(model.condition_number),
    )


def _omnibus(n: int, skew: float | None, kurt: float | None) -> float | None:
    """D'Agostino & Pearson (1973) normality statistic from the skewness test of D'Agostino
    (1970) and the kurtosis test of Anscombe & Glynn (1983)."""
    if n < 8 or skew is None or kurt is None:
        return None
    y = skew * math.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta2 = (
        3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3)
        / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    )
    w2 = math.sqrt(2 * (beta2 - 1)) - 1
    z_skew = math.asinh(y / math.sqrt(2 / (w2 - 1))) / math.sqrt(math.log(w2) / 2)
    centre = 3 * (n - 1) / (n + 1)
    spread = 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (kurt - centre) / math.sqrt(spread)
    root = (
        6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9))
        * math.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    )
    a = 6 + 8 / root * (2 / root + math.sqrt(1 + 4 / root**2))
    inner = 1 + x * math.sqrt(2 / (a - 4))
    if inner == 0:
        return None
    third = math.copysign(((1 - 2 / a) / abs(inner)) ** (1 / 3), inner)
    z_kurt = (1 - 2 / (9 * a) - third) / math.sqrt(2 / (9 * a))
    return z_skew**2 + z_kurt**2
