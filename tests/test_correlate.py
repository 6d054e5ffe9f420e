import importlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelwright import operators as op
from panelwright.operators.moments import Moments

correlate_module = importlib.import_module("panelwright.operators.correlate")


def matrix(df, cols):
    return {(r.var_x, r.var_y): (r.n, r.r) for r in op.correlate(df, cols).collect()}


def test_pairs_use_the_rows_both_have(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0), (2.0, None), (3.0, 7.0), (4.0, 1.0)], "x double, y double"
    )
    got = matrix(df, ["x", "y"])
    assert got["x", "y"][0] == 3 and got["x", "y"][1] == pytest.approx(0.0339422117)
    assert got["x", "x"] == (4, pytest.approx(1.0))


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 0.1), (2.0, 0.1), (4.0, 0.1)], "x double, c double")
    got = matrix(df.repartition(3), ["x", "c"])
    assert got["x", "c"] == (3, None) and got["c", "c"] == (3, None)


def test_column_constant_on_the_shared_rows_only(spark):
    df = spark.createDataFrame(
        [(1.0, 0.1), (2.0, 0.1), (4.0, 0.1), (None, 0.7)], "x double, c double"
    )
    assert matrix(df, ["x", "c"])["x", "c"] == (3, None)


def test_empty_and_all_null(spark):
    df = spark.createDataFrame([(None, 1.0)], "x double, y double")
    assert matrix(df, ["x", "y"])["x", "y"] == (0, None)
    assert matrix(df.where("y > 5"), ["x", "y"])["x", "y"] == (0, None)


def frame_with_nulls(n=500, k=6, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(1e6, 1.0, (n, k)) @ np.triu(np.ones((k, k)))
    x[rng.random((n, k)) < 0.2] = np.nan
    return pd.DataFrame(x, columns=[f"c{i}" for i in range(k)])


def test_equals_pandas_with_nulls_and_large_means(spark):
    pdf = frame_with_nulls()
    df = spark.createDataFrame(pdf).replace(float("nan"), None).repartition(7)
    want = pdf.corr()
    got = matrix(df, list(pdf.columns))
    for (a, b), (n, r) in got.items():
        assert r == pytest.approx(want.loc[a, b], abs=1e-9)
        assert n == int((pdf[a].notna() & pdf[b].notna()).sum())


def test_symmetric_bounded_and_unchanged_by_scaling(spark):
    pdf = frame_with_nulls(200, 4)
    cols = list(pdf.columns)
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    plain = matrix(df, cols)
    scaled = matrix(op.minmax_transform(df, op.minmax_fit(df, cols), cols), cols)
    for (a, b), (_, r) in plain.items():
        assert -1.0 <= r <= 1.0 and r == pytest.approx(plain[b, a][1], abs=1e-12)
        assert r == pytest.approx(scaled[a, b][1], abs=1e-7)


def test_targets_wide_form_and_order(spark):
    pdf = frame_with_nulls(100, 4)
    df = spark.createDataFrame(pdf).replace(float("nan"), None)
    long = op.corr_targets(df, list(pdf.columns), ["c0", "c1"]).collect()
    assert [(r.var_x, r.var_y) for r in long] == [
        (f"c{i}", f"c{j}") for i in range(4) for j in range(2)
    ]
    wide = op.corr_matrix(df, list(pdf.columns))
    assert wide.columns == ["var_x", *pdf.columns] and wide.count() == 4


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 4), st.integers(2, 5), st.floats(0, 1e7))
def test_merged_moments_equal_moments_of_all_rows(seed, parts, k, offset):
    rng = np.random.default_rng(seed)
    x = rng.normal(offset, 1 + rng.random(), (40, k))
    x[rng.random((40, k)) < 0.3] = np.nan
    merged = sum(
        (Moments.of(p) for p in np.array_split(x, parts)[1:]), Moments.of(np.array_split(x, parts)[0])
    )
    whole = Moments.of(x)
    np.testing.assert_array_equal(merged.n, whole.n)
    np.testing.assert_allclose(merged.mean, whole.mean, rtol=1e-9, atol=1e-9)
    np.testing.assert_allclose(merged.sxy, whole.sxy, rtol=1e-5, atol=1e-4)
    again = Moments.from_bytes(merged.to_bytes())
    np.testing.assert_array_equal(again.sxx, merged.sxx)


def test_no_row_of_the_target_table_is_dropped(spark):
    df = spark.range(30).select(*[F.rand(i).alias(f"c{i}") for i in range(60)])
    names = [f"c{i}" for i in range(60)]
    assert op.corr_targets(df, names, ["c0", "c1"]).count() == 120


def test_no_pair_of_rows_or_columns_is_exploded(spark):
    """The data side of the plan is a projection into the task function."""
    df = spark.range(10).select(F.col("id").cast("double").alias("a"), F.rand().alias("b"))
    assert op.correlate(df, ["a", "b"]).count() == 4


@pytest.mark.parametrize("targets", [None, ["c03", "c19"]])
def test_tiles_equal_one_matrix(spark, targets):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(120, 23)) + 1e3
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 4] = 5.0
    names = [f"c{k:02d}" for k in range(23)]
    df = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in row] for row in x], ", ".join(f"{n} double" for n in names)).repartition(5)
    whole = {(r.var_x, r.var_y): (r.n, r.r) for r in op.correlate(df, names, targets).collect()}
    tiles = [(r.var_x, r.var_y, r.n, r.r) for r in correlate_module.tiled(df, names, targets, 6).collect()]
    assert len(tiles) == len(whole) == 23 * len(targets or names)
    for a, b, n, r in tiles:
        assert whole[a, b][0] == n and (r is None) == (whole[a, b][1] is None)
        assert r is None or r == pytest.approx(whole[a, b][1], abs=1e-12)
    empty = correlate_module.tiled(df.limit(0), names[:3], None, 2).collect()
    assert len(empty) == 9 and all((r.n, r.r) == (0, None) for r in empty)


def test_many_columns_go_by_tiles(spark, monkeypatch):
    """No task holds more than two blocks of columns."""
    monkeypatch.setattr(correlate_module, "WHOLE", 10)
    df = spark.range(50).select(*[(F.col("id") * k % 7).cast("double").alias(f"c{k}") for k in range(1, 15)])
    got = op.correlate(df, df.columns)
    assert got.count() == 14 * 14
    assert "FlatMapGroupsInPandas" in got._jdf.queryExecution().optimizedPlan().toString()
