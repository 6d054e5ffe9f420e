import datetime
import importlib
import math

import numpy as np
import pytest
from frames import DAY0, day, panel
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelwright import operators as op
from panelwright.operators.forecast import _Series
from panelwright.plans import workflow as wf

forecast_module = importlib.import_module("panelwright.operators.forecast")
EPOCH_DAY0 = (np.datetime64(DAY0) - np.datetime64(0, "D")).astype(int)


def wave(d, start=10.0, slope=0.5, height=3.0):
    return start + slope * d + height * np.sin(2 * np.pi * (EPOCH_DAY0 + d) / 7)


def line_wave(spark, days=60):
    d = np.arange(days)
    return panel(
        spark,
        {e: dict(zip(d, wave(d, 10 * i, 0.5 * i, i))) for i, e in enumerate("abc", start=1)},
    )


def test_line_and_wave_are_recovered_and_continued(spark):
    got = op.forecast(line_wave(spark)).collect()
    assert len(got) == 3 * 74
    for r in got:
        i = "abc".index(r.entity_id) + 1
        d = (r.ds - DAY0).days
        assert r.yhat == pytest.approx(wave(np.array([d]), 10 * i, 0.5 * i, i)[0], abs=1e-6)
        assert r.yhat == pytest.approx(r.trend + r.weekly)
        assert r.yhat_lower <= r.yhat <= r.yhat_upper
        assert r.is_future == (d >= 60) and (r.y is None) == r.is_future


def test_one_row_per_date_and_fourteen_future_rows(spark):
    df = panel(spark, {"a": {0: 1, 1: 5, 9: 2, 30: 4}, "one": {3: 7.0}, "two": {0: 1, 4: 2}})
    got = op.forecast(df)
    assert got.groupBy("entity_id", "ds").count().where("count > 1").count() == 0
    counts = {r.entity_id: r.n for r in got.where("is_future").groupBy("entity_id").agg(
        F.count("*").alias("n")).collect()}
    assert counts == {"a": 14, "one": 14, "two": 14}
    last = got.where("entity_id = 'a' and is_future").agg(F.min("ds"), F.max("ds")).first()
    assert tuple(last) == (day(31), day(44))


def test_known_slope_change_is_located(spark):
    d = np.arange(100)
    df = panel(spark, {"k": dict(zip(d, d + 4.0 * np.maximum(d - 40, 0)))})
    rows = op.changepoints(df).collect()
    assert 1 <= len(rows) <= 25 and max(r.changepoint_ds for r in rows) < day(80)
    near = sum(r.delta for r in rows if abs((r.changepoint_ds - day(40)).days) <= 7)
    assert near == pytest.approx(4.0, abs=0.2)


@pytest.mark.parametrize("days,kink", [(23, 0.0), (60, 0.0), (150, 0.0), (150, 1.0)])
def test_interval_covers_the_future(days, kink):
    rng = np.random.default_rng(7)
    d = np.arange(19_700, 19_700 + days + 14)
    hits = []
    for _ in range(300):
        i = np.arange(len(d))
        y = 50 + 0.4 * i + kink * np.maximum(i - 70, 0) + 6 * np.sin(2 * np.pi * d / 7)
        y = y + rng.normal(0, 8, len(d))
        train = y[:days]
        series = _Series(d[:days], np.ones(days), train, train**2, np.abs(train).max(), 0.5)
        _, lower, upper, *_ = series.predict(d[days:], 0.95)
        hits.append(((y[days:] >= lower) & (y[days:] <= upper)).mean())
    assert 0.93 <= np.mean(hits) <= 0.98


def test_weighted_fit_equals_fit_on_all_rows():
    """Counts and sums per date stand for the rows: the pooled model is exact."""
    rng = np.random.default_rng(3)
    d = np.arange(100, 160)
    rows = rng.normal(20, 4, (60, 5)) + 0.2 * np.arange(60)[:, None]
    pooled = _Series(
        d, np.full(60, 5.0), rows.sum(axis=1), (rows**2).sum(axis=1), np.abs(rows).max(), 0.5
    )
    x = np.repeat(pooled.design(d), 5, axis=0)
    y = rows.reshape(-1) / pooled.scale
    penalty = np.zeros(x.shape[1])
    weight = pooled.sigma2 / 0.25
    penalty[2 : 2 + len(pooled.changepoints)] = weight
    inverse = np.linalg.inv(x.T @ x + np.diag(penalty))
    np.testing.assert_allclose(pooled.beta, inverse @ (x.T @ y), rtol=1e-6, atol=1e-9)
    rss = ((y - x @ pooled.beta) ** 2).sum()
    edf = np.trace(inverse @ x.T @ x)
    assert pooled.sigma2 == pytest.approx(rss / (300 - edf), rel=1e-8)


def test_pooled_model_sees_every_row(spark):
    d = np.arange(30)
    df = panel(spark, {"a": dict(zip(d, d * 1.0)), "b": dict(zip(d, d * 1.0 + 10))})
    got = op.forecast_pooled(df)
    assert "entity_id" not in got.columns and got.count() == 44
    assert got.where("not is_future").agg(F.min("n_obs"), F.max("n_obs")).first()[:] == (2, 2)
    r = got.where(F.col("ds") == F.lit(day(10))).first()
    assert r.yhat == pytest.approx(15.0, abs=0.5) and r.y == 15.0


def test_hot_entity_collapses_before_grouping(spark):
    """Many rows per date reach the fit as one row per date."""
    df = spark.range(30_000).select(
        F.lit("hot").alias("entity_id"),
        F.date_add(F.lit(DAY0), (F.col("id") % 30).cast("int")).alias("ds"),
        (F.col("id") % 30).cast("double").alias("y"),
    )
    got = op.forecast(df)
    assert got.count() == 44
    assert got.where("not is_future").agg(F.sum("n_obs")).first()[0] == 30_000


def test_same_forecast_at_any_partitioning(spark, shuffle_partitions):
    df = line_wave(spark, 40).withColumn("y", F.col("y") + F.hash("ds", "entity_id") % 3)
    frames = []
    for n in (1, 4, 200):
        shuffle_partitions(n)
        frames.append(op.forecast(df.repartition(n)).orderBy("entity_id", "ds").toPandas())
    for other in frames[1:]:
        np.testing.assert_allclose(frames[0].yhat, other.yhat, rtol=1e-9)
        np.testing.assert_allclose(frames[0].yhat_upper, other.yhat_upper, rtol=1e-9)


def test_null_observations_are_left_out(spark):
    df = panel(spark, {"a": {d: (None if d == 5 else float(d)) for d in range(20)}})
    got = op.forecast(df).where("not is_future")
    assert got.count() == 19


# Evaluation --------------------------------------------------------------------------------


def test_left_join_keeps_every_actual_row(spark):
    actual = panel(spark, {"a": {1: 1, 2: 2}})
    predicted = panel(spark, {"a": {1: 5}, "b": {1: 9}}, name="yhat")
    got = op.join_actual_pred(actual, predicted).orderBy("ds").collect()
    assert [(r.y, r.yhat) for r in got] == [(1.0, 5.0), (2.0, None)]


def test_duplicate_predictions_fail(spark):
    actual = panel(spark, {"a": {1: 1}})
    predicted = panel(spark, {"a": {1: 5}}, name="yhat")
    with pytest.raises(PySparkException, match="duplicate key"):
        op.join_actual_pred(actual, predicted.union(predicted)).collect()


def test_error_is_panel_value_minus_prediction(spark):
    predicted = panel(spark, {"a": {1: 5}}, name="yhat").withColumn("y", F.lit(99.0))
    features = panel(spark, {"a": {1: 7}}).withColumn("pop", F.lit(3))
    r = op.forecast_error(predicted, features).first()
    assert (r.y, r.y_panel, r.error, r.pop) == (99.0, 7.0, 2.0, 3)


def test_rmse_and_missing_predictions(spark):
    df = panel(spark, {"a": {1: 1, 2: 2}, "b": {1: 1}}).withColumn("yhat", F.col("y") + 3)
    got = {r.entity_id: (r.n, r.rmse) for r in op.rmse(df).collect()}
    assert got == {"a": (2, 3.0), "b": (1, 3.0)}
    with pytest.raises(PySparkException, match="without a prediction"):
        op.rmse(df.withColumn("yhat", F.when(F.col("ds") == F.lit(day(1)), 1.0))).collect()


def test_concavity(spark):
    d = np.arange(10)
    df = panel(
        spark,
        {"up": dict(zip(d, d**2.0)), "down": dict(zip(d, -(d**2.0))),
         "flat": dict(zip(d, 0.1 * d)), "short": {0: 1.0}},
        name="trend",
    )
    got = {r.entity_id: r["shape"] for r in op.trend_concavity(df).collect()}
    assert got == {"up": "convex", "down": "concave", "flat": "linear", "short": None}


def test_whole_forecast_workflow(spark):
    series = line_wave(spark, 44)
    forecasts = wf.training_forecast(series, ["a", "b"], str(day(29)))
    assert forecasts.where("is_future").count() == 28
    errors = wf.training_error(forecasts, series.withColumn("pop", F.lit(1)))
    assert errors.count() == 60
    worst = wf.training_rmse(forecasts).agg(F.max("rmse"), F.count("*")).first()
    assert worst[0] < 1e-5 and worst[1] == 2


# Seasons and spacing -----------------------------------------------------------------------


def test_a_yearly_wave_is_carried_on(spark):
    wave = {d: 80 + 20 * math.sin(2 * math.pi * d / 365.25) for d in range(3 * 365)}
    got = op.forecast(panel(spark, {"a": wave})).where("is_future").orderBy("ds").collect()
    for k, r in enumerate(got):
        want = 80 + 20 * math.sin(2 * math.pi * (3 * 365 + k) / 365.25)
        assert abs(r.yhat - want) < 1 and r.yhat_lower < want + 1 and r.yhat_upper > want - 1


def test_monthly_series_have_no_weekly_term_and_go_on_by_months(spark):
    rng = np.random.default_rng(0)
    rows = [("a", datetime.date(2015 + k // 12, k % 12 + 1, 1), float(rng.normal(10, 3))) for k in range(20)]
    got = op.forecast(spark.createDataFrame(rows, "entity_id string, ds date, y double"), horizon=5)
    assert got.where("weekly != 0").count() == 0
    future = [r.ds for r in got.where("is_future").orderBy("ds").collect()]
    assert future == [datetime.date(2016, m, 1) for m in range(9, 13)] + [datetime.date(2017, 1, 1)]


def test_rows_of_repeated_dates_all_count(spark):
    rows = [(e, day(d), base + 1.0 * d) for e, base in (("a", 0.0), ("b", 100.0)) for d in range(28)]
    df = spark.createDataFrame(rows, "entity_id string, ds date, y double")
    pooled = op.forecast_pooled(df)
    predicted = op.predict_rows(df, pooled)
    assert predicted.count() == 56
    total = op.rmse(predicted.withColumn("all", F.lit(1)), by=["all"]).first()
    assert total.n == 56 and total.rmse == pytest.approx(50, abs=1e-6)
    assert wf.training_rmse(op.forecast(df)).count() == 2
    one = df.withColumn("entity_id", F.lit("x"))
    with pytest.raises(Exception, match="several rows"):
        wf.training_rmse(op.forecast(one)).collect()
    assert wf.training_rmse(op.forecast(one), one).first().rmse == pytest.approx(50, abs=1e-6)


def test_error_model_of_chosen_entities_and_dates(spark):
    rng = np.random.default_rng(3)
    rows = [(e, day(d), float(rng.poisson(20)), float(rng.normal())) for e in "abc" for d in range(40)]
    df = spark.createDataFrame(rows, "entity_id string, ds date, y double, x double")
    model = wf.forecast_error_model(df, "error", ["x"], entities=["a", "b"], cutoff=str(day(29)))
    assert model.fit.first().n == 60
    fitted = op.forecast(df.where("entity_id != 'c'").where(F.col("ds") <= F.lit(day(29))))
    pdf = df.join(fitted.where("not is_future").select("entity_id", "ds", "yhat"), ["entity_id", "ds"]).toPandas()
    slope = np.polyfit(pdf.x, pdf.y - pdf.yhat, 1)[0]
    assert model.coef.where("term = 'x'").first().coef == pytest.approx(slope, rel=1e-6)


# Balance, sparse changepoints and simulated bands ------------------------------------------


def simulated_series(rng, kind, n):
    d = np.arange(n)
    return {
        "constant": lambda: np.full(n, 3.3),
        "zero": lambda: np.zeros(n),
        "line": lambda: 1.5 + 0.3 * d,
        "exponential": lambda: np.exp(0.02 * d),
        "counts": lambda: rng.poisson(2, n).astype(float),
        "spikes": lambda: np.where(rng.random(n) < 0.02, 1e6, 1.0),
        "noise": lambda: rng.normal(0, 1e-3, n),
        "wave": lambda: 50 + 6 * np.sin(2 * np.pi * d / 7) + rng.normal(0, 8, n),
    }[kind]()


@pytest.mark.parametrize("kind", ["constant", "zero", "line", "exponential", "counts", "spikes", "noise", "wave"])
def test_every_series_settles(kind):
    """2,500 series of each kind, gaps and single dates included."""
    rng = np.random.default_rng(len(kind))
    for k in range(2500):
        n = int(rng.integers(1, 60)) if k % 10 else int(rng.integers(60, 400))
        days = 19_000 + (np.arange(n) if k % 2 else np.sort(rng.choice(3 * n, n, replace=False)))
        y = simulated_series(rng, kind, n)
        fitted = _Series(days, np.ones(n), y, y**2, np.abs(y).max(), 0.5, "sparse" if k % 10 == 3 else "smooth")
        assert fitted.converged and np.isfinite(fitted.beta).all() and fitted.sigma2 >= 0
        assert np.isfinite(fitted.predict(np.r_[days, days[-1] + 5], 0.95)).all()


def test_the_balance_is_a_fixed_point():
    rng = np.random.default_rng(8)
    days = np.arange(120)
    y = 5 + 0.2 * days + rng.normal(0, 2, 120)
    fitted = _Series(days, np.ones(120), y, y**2, np.abs(y).max(), 0.5)
    x = fitted.design(days)
    penalty = np.zeros(x.shape[1])
    penalty[2 : 2 + len(fitted.changepoints)] = fitted.sigma2 / 0.25
    inverse = np.linalg.inv(x.T @ x + np.diag(penalty))
    beta = inverse @ x.T @ (y / fitted.scale)
    rss = ((y / fitted.scale - x @ beta) ** 2).sum()
    assert fitted.sigma2 == pytest.approx(rss / (120 - np.trace(inverse @ x.T @ x)), rel=1e-8)


def kinked(rng, n, noise, at=None):
    """A series with one change of slope, and its fit with few changes."""
    days = np.arange(n)
    at = n // 3 if at is None else at
    y = 5 + 0.1 * days + np.maximum(days - at, 0) + rng.normal(0, noise, n)
    return _Series(days, np.ones(n), y, y**2, np.abs(y).max(), 0.5, "sparse")


@pytest.mark.parametrize("noise", [0.0, 0.5, 2.0])
def test_one_planted_kink_gives_few_changes(noise):
    rng = np.random.default_rng(9)
    for _ in range(40):
        fitted = kinked(rng, 150, noise)
        changed = np.flatnonzero(fitted.deltas)
        assert 1 <= len(changed) <= 3
        assert np.abs(fitted.changepoints[changed] - 50).min() <= 8
        assert fitted.deltas.sum() == pytest.approx(1.0, abs=0.15)
    flat = [_Series(np.arange(120), np.ones(120), y, y**2, np.abs(y).max(), 0.5, "sparse") for y in rng.normal(20, 2, (40, 120))]
    assert np.mean([(f.deltas != 0).sum() for f in flat]) < 0.2


def test_soft_threshold_equals_coordinate_descent():
    rng = np.random.default_rng(10)
    a = rng.normal(size=(30, 4))
    left, lean = a.T @ a, rng.normal(size=4) * 8
    size = np.linalg.solve(left, lean)
    for threshold in (0.0, 0.3, 3.0, 1e3):
        got, done = forecast_module._soft(left, lean, threshold, size)
        assert done
        pull = lean - left @ got
        np.testing.assert_allclose(pull[got != 0], threshold * np.sign(got[got != 0]), atol=1e-8)
        assert (np.abs(pull[got == 0]) <= threshold + 1e-8).all()


@pytest.mark.parametrize("trend,kink", [("smooth", 0.0), ("smooth", 1.0), ("sparse", 1.0)])
def test_simulated_bands_cover_the_future(trend, kink):
    rng = np.random.default_rng(7)
    days = np.arange(19_700, 19_700 + 164)
    hits = []
    for k in range(150):
        i = np.arange(len(days))
        y = 50 + 0.4 * i + kink * np.maximum(i - 70, 0) + 6 * np.sin(2 * np.pi * days / 7) + rng.normal(0, 8, len(days))
        train = y[:150]
        fitted = _Series(days[:150], np.ones(150), train, train**2, np.abs(train).max(), 0.5, trend)
        yhat, lower, upper, *_ = fitted.predict(days[150:], 0.95, np.random.default_rng(k))
        assert (lower < yhat).all() and (yhat < upper).all()
        hits.append(((y[150:] >= lower) & (y[150:] <= upper)).mean())
    assert 0.93 <= np.mean(hits) <= 0.98


def test_simulated_and_normal_bands_agree_where_no_change_is_to_come():
    rng = np.random.default_rng(12)
    days = np.arange(100)
    y = rng.normal(20, 3, 100)
    fitted = _Series(days, np.ones(100), y, y**2, np.abs(y).max(), 0.5)
    _, low, high, *_ = fitted.predict(days, 0.95)
    _, low_drawn, high_drawn, *_ = fitted.predict(days, 0.95, np.random.default_rng(1), 20_000)
    np.testing.assert_allclose(high_drawn - low_drawn, high - low, rtol=0.05)


def test_a_seed_gives_the_same_bands_at_any_partitioning(spark, shuffle_partitions):
    df = line_wave(spark, 40).withColumn("y", F.col("y") + F.hash("ds", "entity_id") % 3)
    frames = []
    for n in (1, 5):
        shuffle_partitions(n)
        frames.append(op.forecast(df.repartition(n), bands="simulated", trend="sparse", seed=3).orderBy("entity_id", "ds").toPandas())
    np.testing.assert_allclose(frames[0].yhat_lower, frames[1].yhat_lower, rtol=1e-9)
    other = op.forecast(df, bands="simulated", trend="sparse", seed=4).orderBy("entity_id", "ds").toPandas()
    assert frames[0].converged.all() and (frames[0].yhat_lower != other.yhat_lower).any()
    with pytest.raises(ValueError):
        op.forecast(df, trend="other")
    with pytest.raises(ValueError):
        op.changepoints(df, trend="other")
