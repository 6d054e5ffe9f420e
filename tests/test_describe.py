import importlib
import math

import numpy as np
import pytest
from frames import column, panel
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelwright import operators as op
from panelwright.operators.describe import order_statistics
from panelwright.sources.scan import is_scan

describe_module = importlib.import_module("panelwright.operators.describe")
SETTINGS = settings(max_examples=8, deadline=None)


def test_quartiles_interpolate_and_skip_nulls(spark):
    r = op.describe(column(spark, [1.0, 2.0, 3.0, 10.0, None]), ["x"]).first()
    assert (r["count"], r.p25, r.p50, r.p75) == (4, 1.75, 2.5, 4.75)
    assert r["std"] == pytest.approx(4.08248290463863) and (r["min"], r["max"]) == (1.0, 10.0)


def test_describe_of_an_empty_column(spark):
    r = op.describe(column(spark, [None, None]), ["x"]).first()
    assert r["count"] == 0 and r["mean"] is None and r["p50"] is None


def test_skewness_is_the_population_kind(spark):
    r = op.skew_report(column(spark, [1.0, 2.0, 3.0, 10.0]), ["x"]).first()
    assert r.skew == pytest.approx(1.0182337649)
    assert r.p75_over_max == pytest.approx(0.475) and r.mean_over_p50 == pytest.approx(1.6)


HEAVY = {
    "lognormal": np.exp(np.random.default_rng(0).normal(0, 4, 4000)),
    "ties": np.repeat([0.0, 0.0, 0.0, 1.0, 7.0], 800),
    "signed": np.random.default_rng(1).normal(0, 1e-6, 4000) - 1e-7,
    "huge": 1e308 * np.random.default_rng(2).uniform(-0.8, 0.8, 4000),
}


@pytest.mark.parametrize("name", HEAVY)
def test_counted_quartiles_equal_gathered_ones(spark, name):
    df = column(spark, [float(v) for v in HEAVY[name]])
    counted = op.describe(df, ["x"]).first()
    # Halves, or the difference of two neighbours would overflow.
    want = 2 * np.percentile(np.sort(HEAVY[name]) / 2, [25, 50, 75])
    np.testing.assert_allclose([counted[p] for p in ("p25", "p50", "p75")], want, rtol=1e-12)


def test_passes_do_not_grow_with_the_spread(spark, monkeypatch):
    """Values over thirty decades, both signs, zeros and the least numbers there are: eight passes."""
    rng = np.random.default_rng(3)
    x = 10.0 ** rng.uniform(-15, 15, 3000) * rng.choice([-1, 1], 3000)
    x = np.r_[x, np.zeros(5), 5e-324, -5e-324, 1.7e308]
    passes = []
    count = describe_module._count_parts
    monkeypatch.setattr(describe_module, "_count_parts", lambda *a: passes.append(1) or count(*a))
    df = column(spark, [float(v) for v in x])
    ranks = {0, 1, 700, 1503, 1504, 1505, 2500, len(x) - 1}
    got = order_statistics(df, {"x": ranks}, {"x": (float(x.min()), float(x.max()))})
    assert got["x"] == {r: float(np.sort(x)[r]) for r in ranks}
    assert len(passes) <= 8


@pytest.mark.parametrize("parts", [2, 8])
def test_order_statistics_narrow_down_without_gathering(spark, parts):
    x = HEAVY["lognormal"]
    df = column(spark, [float(v) for v in x])
    ranks = {0, 1, 1999, 2000, 3999}
    ends = {"x": (float(x.min()), float(x.max()))}
    got = order_statistics(df, {"x": ranks}, ends, parts=parts)
    assert got["x"] == {r: float(np.sort(x)[r]) for r in ranks}


def test_approximate_quartiles_are_close(spark):
    x = HEAVY["lognormal"]
    r = op.describe(column(spark, [float(v) for v in x]), ["x"], approx=True).first()
    assert abs((x <= r.p50).mean() - 0.5) < 0.01


def test_weekday_profile(spark):
    df = panel(spark, {"a": {d: d for d in range(14)}})
    got = {r.weekday: (r.n, r.mean_y) for r in op.weekday_profile(df, "y").collect()}
    # Day 0, 2024-01-01, is a Monday: weekday 2.
    assert got[2] == (2, 3.5) and len(got) == 7


def test_minmax_constant_null_and_reuse(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, None)], "x double, c double")
    params = op.minmax_fit(df, ["x", "c"])
    got = op.minmax_transform(df, params, ["x", "c"]).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0), (1.0, 0.0), (None, None)]
    other = spark.createDataFrame([(5.0, 7.0)], "x double, c double")
    assert tuple(op.minmax_transform(other, params, ["x", "c"]).first()) == (2.0, 2.0)


def test_minmax_plan_has_no_join(spark):
    df = spark.range(10).withColumn("x", F.col("id") * 2.0)
    scaled = op.minmax_transform(df, op.minmax_fit(df, ["x"]), ["x"])
    plan = scaled._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


@SETTINGS
@given(st.lists(st.floats(-1e6, 1e6), min_size=2, max_size=30))
def test_minmax_is_monotone_and_in_range(spark, xs):
    df = column(spark, xs).withColumn("raw", F.col("x"))
    out = op.minmax_transform(df, op.minmax_fit(df, ["x"]), ["x"]).orderBy("raw").collect()
    scaled = [r.x for r in out]
    assert all(0.0 <= s <= 1.0 and math.isfinite(s) for s in scaled)
    assert all(a <= b for a, b in zip(scaled, scaled[1:]))


def test_nan_is_missing_everywhere(spark):
    nan = float("nan")
    df = column(spark, [1.0, nan, 3.0, None])
    r = op.describe(df, ["x"]).first()
    assert (r["count"], r["mean"], r["max"]) == (2, 2.0, 3.0)
    out = op.minmax_transform(df, op.minmax_fit(df, ["x"]), ["x"]).collect()
    assert sorted((x.x is None, x.x or 0.0) for x in out) == [(False, 0.0), (False, 1.0), (True, 0.0), (True, 0.0)]


def test_no_sketch_and_nothing_kept_for_a_scan(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(1000).select(F.col("id").cast("double").alias("x")).write.parquet(path)
    df = spark.read.parquet(path)
    assert is_scan(df) and not is_scan(df.groupBy().agg(F.sum("x").alias("x")))
    assert op.describe(df, ["x"]).first()["p50"] == 499.5


def test_sketched_quartiles_are_near_in_rank(spark, monkeypatch):
    """Partial sketches of many tasks meet in a tree; ties, NULLs and NaN included."""
    monkeypatch.setattr(describe_module, "FAN_IN", 2)
    monkeypatch.setattr(describe_module, "LEVELS", 5)
    rng = np.random.default_rng(4)
    x = np.sort(np.r_[np.exp(rng.normal(0, 4, 30_000)), np.repeat([0.0, 3.0], 5000)])
    values = [(float(v),) for v in rng.permutation(x)] + [(None,), (float("nan"),)]
    r = op.describe(spark.createDataFrame(values, "x double").repartition(40), ["x"], approx=True).first()
    assert r["count"] == len(x) and (r.min, r.max) == (x[0], x[-1])
    for p, v in ((0.25, r.p25), (0.5, r.p50), (0.75, r.p75)):
        low, high = np.searchsorted(x, v, "left") / len(x), np.searchsorted(x, v, "right") / len(x)
        assert low - 0.006 <= p <= high + 0.006
    assert op.describe(column(spark, [None]), ["x"], approx=True).first()["count"] == 0
