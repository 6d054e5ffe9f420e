"""Additive trend, weekly and yearly forecasts, one series per entity or one for all.

The model form is that of Taylor & Letham, "Forecasting at Scale" (2018): a piecewise linear
trend with a hinge at each changepoint, plus Fourier terms: weekly ones for series of two weeks or more
with dates less than a week apart, yearly ones for series of two years or more. Hinges are shrunk by a normal prior
of the changepoint prior scale (``trend="smooth"``), which has a closed-form, deterministic solution, or
by a Laplace prior (``trend="sparse"``), which leaves few changepoints with a change at all. Bands are normal
ones in closed form, or quantiles of simulated courses.

The design depends on the date alone, so rows are first collapsed to one per entity and date
(count, sum, sum of squares): the weighted fit on those is the fit on all rows, and a group
never holds more than one row per date, however many rows an entity has.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.functions.distributions import normal_quantile

HORIZON = 14
PRIOR_SCALE = 0.5
LEVEL = 0.95

_FORECAST = (
    "is_future boolean, n_obs bigint, y double, yhat double, yhat_lower double, "
    "yhat_upper double, trend double, weekly double, yearly double, converged boolean"
)
#: Simulated courses, and how many dates' noise is held at a time.
DRAWS, BLOCK = 1000, 1024
TRENDS, BANDS = ("smooth", "sparse"), ("normal", "simulated")
_DAY = np.timedelta64(1, "D")


class _Series:
    """Fit of one series; dates are whole days since the epoch, sorted and distinct."""

    max_changepoints = 25
    changepoint_range = 0.8
    weekly_order, yearly_order, year = 3, 10, 365.25
    #: Noise variance, as a share of the mean square of y, under which it is rounding error.
    noise_floor = 1e-12

    def __init__(self, days, n, sum_y, sum_yy, scale, prior, trend="smooth"):
        self.start, self.span = days[0], max(days[-1] - days[0], 1)
        self.scale = scale or 1.0
        self.changepoints = self._place_changepoints(days)
        step = int(np.diff(days).min()) if len(days) > 1 else 1
        self.weekly = days[-1] - days[0] >= 14 and step < 7
        self.yearly = days[-1] - days[0] >= 730
        y = sum_y / self.scale
        x = self.design(days)
        gram, cross = x.T @ (x * n[:, None]), x.T @ y
        self._fit(gram, cross, float((sum_yy / self.scale**2).sum()), n.sum(), prior, trend)

    def _fit(self, gram, cross, total_square, n, prior, trend):
        """Prior on the hinges (h), none on level, slope and seasons (u), which are eliminated first."""
        h = np.zeros(len(gram), dtype=bool)
        h[2 : 2 + len(self.changepoints)] = True
        u = ~h
        inverse_u = np.linalg.pinv(gram[np.ix_(u, u)], hermitian=True)
        carry = inverse_u @ gram[np.ix_(u, h)]
        left = gram[np.ix_(h, h)] - gram[np.ix_(h, u)] @ carry
        lean = cross[h] - carry.T @ cross[u]
        unexplained = total_square - cross[u] @ inverse_u @ cross[u]
        free = n - np.linalg.matrix_rank(gram[np.ix_(u, u)], hermitian=True)
        least = self.noise_floor * total_square / n if n else 0.0
        balance = _smooth if trend == "smooth" else _sparse
        deltas, inverse_h, self.sigma2, self.converged = balance(left, lean, unexplained, free, n, prior, least)
        self.cov = np.zeros_like(gram)
        self.cov[np.ix_(h, h)] = inverse_h
        self.cov[np.ix_(u, h)] = -carry @ inverse_h
        self.cov[np.ix_(h, u)] = self.cov[np.ix_(u, h)].T
        self.cov[np.ix_(u, u)] = inverse_u + carry @ inverse_h @ carry.T
        self.beta = np.zeros(len(gram))
        self.beta[h] = deltas
        self.beta[u] = inverse_u @ cross[u] - carry @ deltas

    def _place_changepoints(self, days):
        early = days[: int(np.floor(len(days) * self.changepoint_range))]
        count = min(self.max_changepoints, (days[-1] - days[0] + 1) // 7, len(early) - 1)
        if count < 1:
            return days[:0]
        index = np.linspace(0, len(early) - 1, count + 1).round().astype(int)[1:]
        return early[np.unique(index)]

    def _time(self, days):
        return (days - self.start) / self.span

    def design(self, days):
        t = self._time(days)
        hinges = np.maximum(t[:, None] - self._time(self.changepoints)[None, :], 0.0)
        columns = [np.ones_like(t), t, *hinges.T]
        if self.weekly:
            columns += _waves((days % 7) / 7, self.weekly_order)
        if self.yearly:
            columns += _waves(days / self.year, self.yearly_order)
        return np.column_stack(columns)

    def predict(self, days, level, rng=None, draws=DRAWS):
        """Prediction, band and components; with a generator ``rng`` the band is one of ``draws`` simulated courses."""
        x = self.design(days)
        cut = 2 + len(self.changepoints)
        weeks = cut + 2 * self.weekly_order * self.weekly
        trend, weekly, yearly = (
            x[:, a:b] @ self.beta[a:b] for a, b in ((0, cut), (cut, weeks), (weeks, None))
        )
        ahead = np.maximum(self._time(days) - 1.0, 0.0)
        yhat = trend + weekly + yearly
        if rng is None:
            below, above = self._normal_band(x, ahead, level)
        else:
            below, above = self._simulated_band(x, ahead, level, rng, draws)
        return [self.scale * v for v in (yhat, yhat + below, yhat + above, trend, weekly, yearly)]

    def _change_size(self):
        deltas = np.abs(self.beta[2 : 2 + len(self.changepoints)])
        return deltas.mean() if len(deltas) else 0.0

    def _normal_band(self, x, ahead, level):
        """Noise, uncertainty of the coefficients, and slope changes still to come: Laplace
        sized, arriving at the rate seen in training, integrated over the time ahead."""
        variance = (
            self.sigma2 * (1.0 + (x @ self.cov * x).sum(axis=1))
            + len(self.changepoints) * 2 * self._change_size() ** 2 * ahead**3 / 3
        )
        half = normal_quantile((1 + level) / 2) * np.sqrt(np.maximum(variance, 0.0))
        return -half, half

    def _simulated_band(self, x, ahead, level, rng, draws):
        """The same three parts drawn: quantiles of courses, which need be neither normal nor even-sided.

        Slope changes to come arrive as a Poisson process at the rate of training, each with a Laplace size.
        """
        values, vectors = np.linalg.eigh(self.cov)
        root = vectors * np.sqrt(np.maximum(values, 0.0) * self.sigma2)
        coefficients = rng.standard_normal((draws, len(root))) @ root.T
        reach = ahead.max(initial=0.0)
        count = rng.poisson(len(self.changepoints) * reach, draws)
        most = count.max(initial=0)
        size = rng.laplace(0.0, self._change_size(), (draws, most)) * (np.arange(most) < count[:, None])
        when = rng.uniform(0.0, reach, (draws, most))
        share = [(1 - level) / 2, (1 + level) / 2]
        found = []
        for low in range(0, len(x), BLOCK):
            here = slice(low, low + BLOCK)
            course = coefficients @ x[here].T + rng.normal(0.0, np.sqrt(self.sigma2), (draws, len(x[here])))
            later = np.flatnonzero(ahead[here] > 0)
            for k in range(most):
                course[:, later] += size[:, k : k + 1] * np.maximum(ahead[here][later] - when[:, k : k + 1], 0.0)
            found.append(np.quantile(course, share, axis=0))
        return np.concatenate(found, axis=1)

    @property
    def deltas(self):
        """Change of slope at each changepoint, in units of y per day."""
        return self.beta[2 : 2 + len(self.changepoints)] * self.scale / self.span


def _smooth(left, lean, unexplained, free, n, prior, least):
    """Ridge on the hinges: their changes, the inverse of their penalised Gram matrix, the noise variance, and whether it stands.

    One eigendecomposition serves every penalty. The penalty is noise variance over squared prior scale, the noise
    variance that of the fit under the penalty; the two are balanced by bisection in the logarithm of the
    penalty, between the last two of growing steps away from 1 that lie on different sides. Noise under
    ``least`` is rounding error and counts as that.
    """
    roots, basis = np.linalg.eigh(left)
    roots = np.maximum(roots, 0.0)
    lean = basis.T @ lean

    def noise(weight):
        shrunk = lean / (roots + weight)
        rss = max(unexplained - shrunk @ (2 * lean - roots * shrunk), 0.0)
        over = free - float((roots / (roots + weight)).sum())
        return rss / over if over > 1e-6 else 0.0

    floor = max(least / prior**2, 1e-12)

    def excess(log_weight):
        weight = math.exp(log_weight)
        return math.log(max(noise(weight) / prior**2, floor)) - log_weight

    low = high = 0.0
    down = excess(0.0) < 0
    step, lowest = 0.5, math.log(floor)
    while (excess(low) < 0) if down else (excess(high) >= 0):
        if down:
            high, low = low, max(low - step, lowest)
        else:
            low, high = high, high + step
        if low == high or high > 700:
            break
        step *= 1.5
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if excess(middle) >= 0:
            low = middle
        else:
            high = middle
    weight = math.exp(high)
    inverse = (basis / (roots + weight)) @ basis.T
    return basis @ (lean / (roots + weight)), inverse, noise(weight), high <= 700


def _sparse(left, lean, unexplained, free, n, prior, least):
    """Laplace prior on the hinges: what :func:`_smooth` gives, with most changes exactly zero.

    The most probable changes for every ratio of noise to prior scale form a path with a corner wherever a
    hinge enters or leaves (Osborne, Presnell & Turlach 2000; Efron et al. 2004). Its sets of hinges are judged by
    the Bayesian information criterion, a hinge counting twice, for its place and its size, and a misfit of 3 %
    of that without hinges counting as none, since a kink may lie between two hinges. Of the
    best set goes what the criterion can do without; on the rest the changes are the most probable ones at the prior's scale.
    """
    trifle = max(1e-3 * unexplained / n, least, 1e-300) if n else 1.0
    kinks = [()] + _path(left, lean)

    def residual(kept):
        if not kept:
            return max(unexplained, 0.0), np.empty(0)
        at = np.ix_(kept, kept)
        size = np.linalg.lstsq(left[at], lean[list(kept)], rcond=1e-10)[0]
        return max(unexplained - size @ lean[list(kept)], 0.0), size

    def criterion(kept):
        rss, _ = residual(kept)
        return n * math.log(max(rss / n, trifle)) + 2 * len(kept) * math.log(max(n, 2))

    kept = min((k for k in dict.fromkeys(kinks) if free - len(k) > 0 or not k), key=lambda k: (criterion(k), len(k)))
    while kept:
        fewer = min(((*kept[:k], *kept[k + 1 :]) for k in range(len(kept))), key=criterion)
        if criterion(fewer) > criterion(kept):
            break
        kept = fewer
    rss, size = residual(kept)
    over = free - len(kept)
    sigma2 = rss / over if over > 1e-6 else 0.0
    deltas, inverse = np.zeros(len(lean)), np.zeros_like(left)
    done = True
    if kept:
        at = np.ix_(kept, kept)
        size, done = _soft(left[at], lean[list(kept)], sigma2 / prior, size)
        deltas[list(kept)] = size
        inverse[at] = np.linalg.pinv(left[at], hermitian=True)
    return deltas, inverse, sigma2, done


def _path(left, lean, corners=200):
    """The sets of hinges along the path of the most probable changes, from none to all that matter.

    Where hinges cannot be told apart, the path ends.
    """
    found, kept, sign = [], [], []
    live = np.diag(left) > 1e-10 * np.abs(left).max(initial=0.0)
    if not live.any():
        return found
    size = np.zeros(len(lean))
    tiny = 1e-10 * np.abs(lean).max()
    gone = -1
    for _ in range(corners):
        pull = lean - left @ size
        level = np.abs(pull[kept]).max() if kept else np.abs(pull).max()
        if level <= tiny:
            break
        if not kept:
            j = int(np.abs(np.where(live, pull, 0.0)).argmax())
            kept, sign = [j], [math.copysign(1.0, pull[j])]
        at = np.ix_(kept, kept)
        if np.linalg.cond(left[at]) > 1e12:
            break
        found.append(tuple(sorted(kept)))
        way = np.linalg.solve(left[at], np.array(sign))
        slope = left[:, kept] @ way
        # How far the level falls until a hinge joins, or one of the set comes to zero.
        joins, leaves = (level, -1, 0.0), (level, -1)
        for j in range(len(lean)):
            if j in kept or j == gone or not live[j]:
                continue
            for s in (1.0, -1.0):
                gap, rate = level - s * pull[j], 1.0 - s * slope[j]
                if rate > 1e-14 and 0 <= gap / rate < joins[0]:
                    joins = (gap / rate, j, s)
        for k, j in enumerate(kept):
            if size[j] * way[k] < 0 and -size[j] / way[k] < leaves[0]:
                leaves = (-size[j] / way[k], k)
        step = min(joins[0], leaves[0])
        size[kept] += step * way
        gone = -1
        if leaves[1] >= 0 and leaves[0] <= joins[0]:
            gone = kept.pop(leaves[1])
            sign.pop(leaves[1])
            size[gone] = 0.0
        elif joins[1] >= 0:
            kept.append(joins[1])
            sign.append(joins[2])
        else:
            break
    return found


def _soft(left, lean, threshold, size, sweeps=1000):
    """The changes drawn to zero by the threshold: at once where none changes its sign, else by coordinate descent, each in turn
    to its best value. ``size`` are the changes without a threshold."""
    drawn = np.linalg.lstsq(left, lean - threshold * np.sign(size), rcond=1e-12)[0]
    if (np.sign(drawn) == np.sign(size)).all():
        return drawn, True
    size = size.copy()
    for _ in range(sweeps):
        before = size.copy()
        for j in range(len(size)):
            pull = lean[j] - left[j] @ size + left[j, j] * size[j]
            size[j] = math.copysign(max(abs(pull) - threshold, 0.0), pull) / left[j, j]
        if np.abs(size - before).max() <= 1e-12 * max(np.abs(size).max(), 1e-300):
            return size, True
    return size, False


def _waves(phase: np.ndarray, order: int) -> list[np.ndarray]:
    angles = [2 * np.pi * k * phase for k in range(1, order + 1)]
    return [f(a) for a in angles for f in (np.sin, np.cos)]


def _step(days: np.ndarray) -> tuple[str, int]:
    """Spacing of a series: whole months if every date is the same day of a month, else days."""
    gaps = np.diff(days)
    if len(gaps) and gaps.min() >= 28:
        dates = np.datetime64(0, "D") + days * _DAY
        months = dates.astype("datetime64[M]")
        if len(set((dates - months.astype("datetime64[D]")).tolist())) == 1:
            return "months", int(np.diff(months.astype(int)).min())
    return "days", int(gaps.min()) if len(gaps) else 1


def _ahead(days: np.ndarray, horizon: int) -> np.ndarray:
    """``horizon`` further dates at the spacing of the series."""
    unit, size = _step(days)
    if unit == "days":
        return days[-1] + size * np.arange(1, horizon + 1)
    last = np.datetime64(0, "D") + days[-1] * _DAY
    month = last.astype("datetime64[M]")
    day = last - month.astype("datetime64[D]")
    later = month + size * np.arange(1, horizon + 1)
    # A day that a month lacks is that month's last.
    end = (later + 1).astype("datetime64[D]") - _DAY
    return (np.minimum(later.astype("datetime64[D]") + day, end) - np.datetime64(0, "D")) // _DAY


def _daily(df: DataFrame, by: Sequence[str], order: str, y: str) -> DataFrame:
    value = F.col(y).cast("double")
    return (
        df.where(F.col(y).isNotNull() & F.col(order).isNotNull())
        .groupBy(*by, F.col(order).cast("date").alias("ds"))
        .agg(
            F.count(value).alias("n"),
            F.sum(value).alias("sum_y"),
            F.sum(value * value).alias("sum_yy"),
            F.max(F.abs(value)).alias("max_abs"),
        )
    )


def _fit(rows: pd.DataFrame, prior: float, trend: str) -> tuple[_Series, pd.DataFrame, np.ndarray]:
    rows = rows.sort_values("ds", ignore_index=True)
    days = _to_days(rows["ds"])
    stats = [rows[c].to_numpy(float) for c in ("n", "sum_y", "sum_yy")]
    return _Series(days, *stats, float(rows["max_abs"].max()), prior, trend), rows, days


def _to_days(dates: pd.Series) -> np.ndarray:
    return (pd.to_datetime(dates).to_numpy().astype("datetime64[D]") - np.datetime64(0, "D")) // _DAY


def _to_dates(days: np.ndarray) -> list:
    return list((np.datetime64(0, "D") + days * _DAY).astype(object))


def _grouped(
    df: DataFrame, by: Sequence[str], order: str, y: str, schema: str,
    fit: Callable[[pd.DataFrame], pd.DataFrame],
) -> DataFrame:
    keys = list(by)
    daily = _daily(df, keys, order, y)
    fields = dict(daily.dtypes)
    head = "".join(f"`{k}` {fields[k]}, " for k in keys)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = fit(rows)
        for i, k in enumerate(keys):
            out.insert(i, k, rows[k].iloc[0])
        return out

    if keys:
        # A fit costs far more than its bytes suggest: keep all partitions, where adaptive
        # coalescing would go by size. It is the shuffle the grouping needs anyway.
        partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        daily = daily.repartition(partitions, *keys)
    return daily.groupBy(*keys).applyInPandas(run, head + schema)


def forecast(
    df: DataFrame,
    by: Sequence[str] = ("entity_id",),
    order: str = "ds",
    y: str = "y",
    horizon: int = HORIZON,
    prior: float = PRIOR_SCALE,
    level: float = LEVEL,
    trend: str = "smooth",
    bands: str = "normal",
    draws: int = DRAWS,
    seed: int = 0,
) -> DataFrame:
    """One model per entity, all entities in parallel. One row per training date
    (``is_future`` false, with the mean actual ``y`` of its ``n_obs`` rows) and ``horizon`` further
    dates at the spacing of the series (days, or months where every date is the same day of a
    month), with the interval and the components. ``by=()`` fits one model to all rows.
    ``trend`` is "smooth" or "sparse", ``bands`` "normal" or "simulated": quantiles of ``draws`` courses, which
    depend on ``seed`` and the entity alone, not on how rows are dealt. ``converged`` is false where the
    noise of a series could not be settled; its rows are there all the same, and no series fails the job."""
    if trend not in TRENDS or bands not in BANDS:
        raise ValueError(f"trend is one of {TRENDS}, bands of {BANDS}")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        name = "\x1f".join(str(rows[k].iloc[0]) for k in by)
        rng = np.random.default_rng([seed, crc32(name.encode())]) if bands == "simulated" else None
        series, rows, days = _fit(rows, prior, trend)
        dates = np.concatenate([days, _ahead(days, horizon)])
        yhat, lower, upper, level_, weekly, yearly = series.predict(dates, level, rng, draws)
        ahead = [None] * horizon
        return pd.DataFrame(
            {
                "ds": _to_dates(dates),
                "is_future": np.arange(len(dates)) >= len(days),
                "n_obs": pd.array([*rows["n"], *ahead], dtype="Int64"),
                "y": [*(rows["sum_y"] / rows["n"]), *ahead],
                "yhat": yhat,
                "yhat_lower": lower,
                "yhat_upper": upper,
                "trend": level_,
                "weekly": weekly,
                "yearly": yearly,
                "converged": series.converged,
            }
        )

    return _grouped(df, by, order, y, f"ds date, {_FORECAST}", fit)


def forecast_pooled(df: DataFrame, **settings) -> DataFrame:
    """One model over the rows of all entities; dates may repeat across them, and ``y`` in the
    result is the mean over a date's rows. See :func:`predict_rows` for every row's prediction."""
    return forecast(df, by=(), **settings)


def predict_rows(
    df: DataFrame, forecasts: DataFrame, by: Sequence[str] = (), order: str = "ds", y: str = "y"
) -> DataFrame:
    """Every row of ``df`` with ``yhat`` of its date (and entity, if ``by``) and ``error`` = y - yhat,
    also where a date repeats."""
    keys = [*by, "ds"]
    found = forecasts.select(*keys, F.col("yhat").alias("__yhat"))
    rows = df.withColumn("__ds", F.col(order).cast("date")).alias("r")
    for k in keys:
        found = found.withColumnRenamed(k, f"__f_{k}")
    same = [F.col(f"r.{'__ds' if k == 'ds' else k}") == F.col(f"__f_{k}") for k in keys]
    out = rows.join(found, same, "left")
    return out.select(*[F.col(f"r.{c}") for c in df.columns], F.col("__yhat").alias("yhat")).withColumn(
        "error", F.col(y) - F.col("yhat")
    )


def changepoints(
    df: DataFrame,
    by: Sequence[str] = ("entity_id",),
    order: str = "ds",
    y: str = "y",
    prior: float = PRIOR_SCALE,
    trend: str = "smooth",
) -> DataFrame:
    """Changepoints of every entity's trend: date and change of slope in y per day, which is zero at most
    of them under ``trend="sparse"``."""
    if trend not in TRENDS:
        raise ValueError(f"trend is one of {TRENDS}")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        series, _, _ = _fit(rows, prior, trend)
        return pd.DataFrame(
            {"changepoint_ds": _to_dates(series.changepoints), "delta": series.deltas}
        )

    return _grouped(df, by, order, y, "changepoint_ds date, delta double", fit)


def components(forecasts: DataFrame, by: Sequence[str] = ("entity_id",)) -> DataFrame:
    """The additive parts of a forecast frame."""
    return forecasts.select(*by, "ds", "is_future", "trend", "weekly", "yearly", "yhat")
