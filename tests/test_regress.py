import math
import time

import numpy as np
import pandas as pd
import pytest
from frames import adj_r2, day, lstsq
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from panelwright import operators as op
from panelwright.functions import distributions as dist
from panelwright.operators import selection
from panelwright.operators.factors import Factor
from panelwright.operators.regress import _omnibus, solve

XS = ["a", "b", "c"]


def sample(n=300, nulls=0.1, seed=0):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(rng.normal([5, 1e4, -2], [1, 30, 0.01], (n, 3)), columns=XS)
    pdf["y"] = 3 + 2 * pdf.a - 0.1 * pdf.b + 40 * pdf.c + rng.normal(0, 1, n)
    pdf = pdf.mask(rng.random(pdf.shape) < nulls)
    pdf["entity_id"] = np.arange(n) % 5
    pdf["ds"] = [day(i // 5) for i in range(n)]
    return pdf


def to_spark(spark, pdf):
    return spark.createDataFrame(pdf).replace(float("nan"), None)


def test_equals_least_squares_on_complete_rows(spark):
    pdf = sample()
    model = op.ols(to_spark(spark, pdf).repartition(6), "y", XS, "entity_id", "ds")
    beta, rss, n, rank, design, _ = lstsq(pdf.y, [pdf[c] for c in XS])
    coef = {r.term: r for r in model.coef.collect()}
    assert [r.term for r in model.coef.collect()] == ["Intercept", *XS]
    np.testing.assert_allclose([coef[t].coef for t in ["Intercept", *XS]], beta, rtol=1e-8)
    cov = np.linalg.inv(design.T @ design) * rss / (n - rank)
    np.testing.assert_allclose(
        [coef[t].se for t in ["Intercept", *XS]], np.sqrt(np.diag(cov)), rtol=1e-6
    )
    fit = model.fit.first()
    assert (fit.n, fit["rank"], fit.df_model, fit.df_resid) == (n, 4, 3, n - 4)
    assert fit.rss == pytest.approx(rss) and fit.adj_r2 == pytest.approx(
        adj_r2(pdf.y, [pdf[c] for c in XS])
    )
    assert fit.condition_number == pytest.approx(np.linalg.cond(design), rel=1e-3)
    assert fit.llf == pytest.approx(-n / 2 * (math.log(2 * math.pi * rss / n) + 1))
    assert fit.aic == pytest.approx(-2 * fit.llf + 8)
    assert fit.bic == pytest.approx(-2 * fit.llf + 4 * math.log(n))


def test_agrees_with_the_built_in_linear_regression(spark):
    pdf = sample(nulls=0)
    df = to_spark(spark, pdf)
    ours = op.ols(df, "y", XS)
    built_in = LinearRegression(solver="normal", labelCol="y").fit(
        VectorAssembler(inputCols=XS, outputCol="features").transform(df)
    )
    s = built_in.summary
    # The built-in summary puts the intercept last.
    order = [3, 0, 1, 2]
    rows = ours.coef.collect()
    np.testing.assert_allclose([r.t for r in rows], np.array(s.tValues)[order], rtol=1e-6)
    np.testing.assert_allclose([r.p for r in rows], np.array(s.pValues)[order], atol=1e-9)
    assert ours.fit.first().adj_r2 == pytest.approx(s.r2adj)


def test_residuals_are_orthogonal_to_every_column(spark):
    model = op.ols(to_spark(spark, sample()), "y", XS)
    sums = model.residuals.agg(
        F.sum("residual"), *[F.sum(F.col("residual") * F.col(x)) for x in XS]
    ).first()
    assert all(abs(v) < 1e-3 for v in sums)


def test_residual_statistics(spark):
    pdf = sample(nulls=0, seed=4)
    fit = op.ols(to_spark(spark, pdf), "y", XS, "entity_id", "ds").fit.first()
    beta, *_ = lstsq(pdf.y, [pdf[c] for c in XS])
    e = (pdf.y - beta[0] - pdf[XS].to_numpy() @ beta[1:]).to_numpy()
    m2 = (e**2).mean()
    assert fit.skew == pytest.approx((e**3).mean() / m2**1.5, abs=1e-8)
    assert fit.kurtosis == pytest.approx((e**4).mean() / m2**2, abs=1e-8)
    by_entity = pd.Series(e).groupby(pdf.entity_id)
    assert fit.durbin_watson == pytest.approx(
        sum((g.diff().dropna() ** 2).sum() for _, g in by_entity) / (e**2).sum()
    )
    jb = len(e) / 6 * (fit.skew**2 + (fit.kurtosis - 3) ** 2 / 4)
    assert fit.jarque_bera == pytest.approx(jb)
    assert fit.jarque_bera_p == pytest.approx(math.exp(-jb / 2))


def test_durbin_watson_needs_keys(spark):
    assert op.ols(to_spark(spark, sample()), "y", XS).fit.first().durbin_watson is None


def test_collinear_design_gives_the_shortest_solution(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"a": rng.normal(size=40), "b": rng.normal(2, 3, size=40), "k": 7.0})
    pdf["b2"] = 2 * pdf.b
    pdf["y"] = 1 + pdf.a + 5 * pdf.b + rng.normal(0, 0.1, 40)
    xs = ["a", "b", "b2", "k"]
    model = op.ols(to_spark(spark, pdf), "y", xs)
    design = np.column_stack([np.ones(40), pdf[xs]])
    inverse = np.linalg.pinv(design, rcond=1e-10)
    rows = model.coef.collect()
    np.testing.assert_allclose([r.coef for r in rows], inverse @ pdf.y, rtol=1e-7)
    fit = model.fit.first()
    assert (fit["rank"], fit.df_resid) == (3, 37)
    cov = inverse @ inverse.T * fit.rss / 37
    np.testing.assert_allclose([r.se for r in rows], np.sqrt(np.diag(cov)), rtol=1e-6)


def test_column_of_zeros_is_exactly_zero(spark):
    pdf = sample(nulls=0).assign(z=0.0)
    row = op.ols(to_spark(spark, pdf), "y", [*XS, "z"]).coef.where("term = 'z'").first()
    assert (row.coef, row.se, row.t) == (0.0, 0.0, None)


def test_same_model_at_any_partitioning(spark, shuffle_partitions):
    df = to_spark(spark, sample())
    fits = []
    for n in (1, 4, 200):
        shuffle_partitions(n)
        fits.append(op.ols(df.repartition(n), "y", XS).coef.collect())
    for other in fits[1:]:
        np.testing.assert_allclose(
            [r.coef for r in fits[0]], [r.coef for r in other], rtol=1e-9
        )


def test_no_complete_row_is_an_error(spark):
    df = spark.createDataFrame([(1.0, None)], "y double, a double")
    with pytest.raises(ValueError, match="no complete row"):
        op.ols(df, "y", ["a"])


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 5), st.integers(10, 60))
def test_solve_equals_lstsq(seed, k, n):
    rng = np.random.default_rng(seed)
    x = rng.normal(rng.normal(0, 100, k), 1 + rng.random(k), (n, k))
    y = rng.normal(size=n)
    fit = solve(Factor.of(np.column_stack([y, x])), 0, range(1, k + 1))
    beta, rss, _, rank, *_ = lstsq(y, x.T)
    np.testing.assert_allclose(fit.beta, beta, rtol=1e-6, atol=1e-6)
    assert fit.rank == rank and fit.rss == pytest.approx(rss, rel=1e-8, abs=1e-9)


def test_tails_and_quantiles():
    assert dist.t_two_sided(2.0, 10) == pytest.approx(0.07338803477074039, rel=1e-12)
    assert dist.f_upper(3.0, 1, 10) == pytest.approx(dist.t_two_sided(math.sqrt(3), 10))
    assert dist.t_quantile(0.975, 10) == pytest.approx(2.228138851986274, rel=1e-12)
    # With very many degrees of freedom t is normal and 4 F is chi-square with 4.
    assert dist.t_two_sided(dist.normal_quantile(0.975), 1e13) == pytest.approx(0.05, rel=1e-7)
    assert dist.f_upper(3.0, 4, 1e13) == pytest.approx(math.exp(-6) * 7, rel=1e-7)


def test_omnibus_of_a_symmetric_sample_of_normal_kurtosis_is_small():
    assert _omnibus(1000, 0.0, 3.0) < 0.05
    assert _omnibus(1000, 1.0, 5.0) > 100
    assert _omnibus(7, 0.0, 3.0) is None


# Forward selection -------------------------------------------------------------------------


def brute_force(pdf, y, names):
    selected, best = [], 0.0
    steps = []
    while True:
        scored = [
            (round(adj_r2(pdf[y], [pdf[c] for c in [*selected, n]]), 12), n)
            for n in names
            if n not in selected
        ]
        if not scored or max(scored)[0] <= best:
            return steps
        best, name = max(scored)
        selected.append(name)
        steps.append((name, best))


def selection_frame(seed):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(rng.normal(size=(250, 6)), columns=list("abcdef"))
    pdf["y"] = pdf.a + 0.5 * pdf.b - 0.2 * pdf.c + rng.normal(0, 1, 250)
    cols = [c for c in pdf.columns if c != "e"]
    pdf[cols] = pdf[cols].mask(rng.random((250, 6)) < 0.15)
    return pdf


@pytest.mark.parametrize("seed", [0, 1])
def test_forward_selection_equals_brute_force(spark, seed):
    pdf = selection_frame(seed)
    df = to_spark(spark, pdf).withColumn("text", F.lit("dropped"))
    got = op.forward_selection(df, "y").orderBy("step").collect()
    want = brute_force(pdf, "y", list("abcdef"))
    assert [r.term for r in got] == [t for t, _ in want]
    np.testing.assert_allclose([r.adj_r2 for r in got], [s for _, s in want], atol=1e-10)
    scores = [r.adj_r2 for r in got]
    assert all(a < b for a, b in zip(scores, scores[1:]))


def test_equal_scores_go_to_the_last_name(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"a": rng.normal(size=50)})
    pdf["z"], pdf["m"] = pdf.a, 2 * pdf.a
    pdf["y"] = pdf.a + rng.normal(0, 0.1, 50)
    got = op.forward_selection(to_spark(spark, pdf), "y").collect()
    assert [r.term for r in got] == ["z"]


def test_nothing_selected_is_no_row(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (0.5, 1.0)], "y double, c double")
    assert op.forward_selection(df, "y").count() == 0


# Ill-conditioned designs -------------------------------------------------------------------


def test_near_collinear_design_is_solved_like_lstsq(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=2000)
    z = x + 1e-7 * rng.normal(size=2000)
    y = (z - x) * 1e7 + 0.05 * rng.normal(size=2000)
    model = op.ols(to_spark(spark, pd.DataFrame({"y": y, "x": x, "z": z})), "y", ["x", "z"])
    fit = model.fit.first()
    beta, *_ = np.linalg.lstsq(np.column_stack([np.ones(2000), x, z]), y, rcond=None)
    assert fit.rank == 3 and fit.r2 > 0.99
    np.testing.assert_allclose([r.coef for r in model.coef.collect()][1:], beta[1:], rtol=1e-5)


@pytest.mark.parametrize("power", [3, 8, 11])
def test_condition_number(power):
    rng = np.random.default_rng(power)
    u, _ = np.linalg.qr(rng.normal(size=(500, 3)))
    x = u @ np.diag([1.0, 1.0, 10.0**-power]) @ np.linalg.qr(rng.normal(size=(3, 3)))[0]
    fit = solve(Factor.of(np.column_stack([rng.normal(size=500), x])), 0, range(1, 4))
    want = np.linalg.cond(np.column_stack([np.ones(500), x]))
    assert fit.rank == 4 and fit.condition_number == pytest.approx(want, rel=1e-2)


def test_factors_merge_to_the_factor_of_all_rows():
    x = np.random.default_rng(0).normal(50, 1, (300, 4))
    parts = [Factor.of(p) for p in np.array_split(x, 7)]
    merged = sum(parts[1:], parts[0])
    again = Factor.from_bytes(merged.to_bytes())
    assert again.n == 300
    np.testing.assert_allclose(abs(again.r), abs(Factor.of(x).r), rtol=1e-9, atol=1e-9)


def test_merge_has_a_bounded_fan_in(spark, monkeypatch):
    """5,000 tasks: no merge sees more than FAN_IN parts."""
    from panelwright.operators import moments

    class Count:
        most = 0

        def __init__(self, n, seen=1):
            self.n, self.seen = n, seen

        def __add__(self, other):
            return Count(self.n + other.n, self.seen + 1)

        def to_bytes(self):
            assert self.seen <= moments.FAN_IN
            return str(self.n).encode()

        @classmethod
        def from_bytes(cls, data):
            return cls(int(data))

    rows = spark.range(5000).select(
        F.lit("").alias("key"), F.col("id").cast("int").alias("part"), F.lit(b"1").alias("payload")
    )
    assert moments.merged(rows, Count)[""].n == 5000


def test_names_e_and_before_are_free(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"e": np.repeat([1, 2], 20), "before": np.tile(np.arange(20), 2), "y": rng.normal(size=40), "x": rng.normal(size=40)})
    assert op.ols(to_spark(spark, pdf), "y", ["x"], "e", "before").fit.first().durbin_watson > 0


def test_nan_is_missing_in_regression_and_selection(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.1, 2.0), (2.9, 3.0), (float("nan"), 4.0), (5.0, float("nan"))], "y double, x double")
    assert op.ols(df, "y", ["x"]).fit.first().n == 3
    assert op.forward_selection(df, "y").first().term == "x"


def test_selection_over_many_candidates_with_nulls(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(size=(400, 60)), columns=[f"c{i:02d}" for i in range(60)])
    pdf["y"] = pdf.c07 - pdf.c31 + 0.1 * rng.normal(size=400)
    pdf = pdf.mask(rng.random(pdf.shape) < 0.02)
    got = op.forward_selection(to_spark(spark, pdf).select("y", "c07", "c31", *[f"c{i:02d}" for i in range(8, 31)]), "y").orderBy("step").collect()
    assert [r.term for r in got][:2] in (["c07", "c31"], ["c31", "c07"])


def test_selection_from_hundreds_of_candidates_stays_off_the_decompositions():
    """Each step is one projection: 300 candidates take seconds on the driver."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 300))
    x[:, 299] = x[:, :3].sum(axis=1)
    y = x[:, :40] @ np.linspace(1, 2, 40) + rng.normal(size=900)
    names = [f"c{i:03d}" for i in range(300)]
    factors = {"0" * 300: Factor.of(np.column_stack([y, x]))}
    start = time.perf_counter()
    steps = selection._greedy(names, selection._Scores(["y", *names], factors, None))
    assert time.perf_counter() - start < 10
    assert {t for _, t, _ in steps} >= set(names[3:40]) and len(steps) < 300
    pdf = pd.DataFrame(x, columns=names)
    for k in (0, 20, 60, len(steps) - 1):
        chosen = [t for _, t, _ in steps[: k + 1]]
        assert steps[k][2] == pytest.approx(adj_r2(pd.Series(y), [pdf[c] for c in chosen]), abs=1e-10)


@pytest.mark.parametrize("patterns", [1, 4, 1024])
def test_selection_holds_common_patterns_and_reads_the_others(spark, monkeypatch, patterns):
    monkeypatch.setattr(selection, "PATTERNS", patterns)
    pdf = selection_frame(5)
    pdf.loc[:39, ["a", "b"]] = np.nan
    pdf.loc[40:79, ["d"]] = np.nan
    got = op.forward_selection(to_spark(spark, pdf), "y").orderBy("step").collect()
    want = brute_force(pdf, "y", list("abcdef"))
    assert [r.term for r in got] == [t for t, _ in want]
    np.testing.assert_allclose([r.adj_r2 for r in got], [s for _, s in want], atol=1e-10)
