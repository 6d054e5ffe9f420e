import numpy as np
import pytest
from panelwright.llm import hard_negatives as hn
from pyspark.sql import functions as F

SCHEMA = "vec_id long, embedding array<float>, label int"


def mined(rows, positives=5, negatives=3, low=50, high=95):
    known = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v], l) for i, v, l in rows if i is not None and l is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = set()
    for i, v, l in known:
        if i % 50:
            continue
        scored = {(-sum(a * b for a, b in zip(v, w, strict=True)), j, m) for j, w, m in known if len(w) == len(v)}
        for p, j in sorted({(s, j) for s, j, m in scored if m == l and j != i})[:positives]:
            fit = sorted({(s, k) for s, k, m in scored if m != l and low * -p <= 100 * -s <= high * -p})[:negatives]
            out |= {(i, j, rank + 1, k, -p, -s) for rank, (s, k) in enumerate(fit)}
    return sorted(out)


def got(spark, rows, schema=SCHEMA, **more):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return sorted(tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % 50 == 0, **more).collect())


def clustered(rng, n, labels=4, dim=24):
    center = rng.normal(size=(labels, dim))
    label = rng.integers(0, labels, n)
    return [(int(i), [float(x) for x in rng.normal(size=dim) * 0.7 + center[l] * 0.8 + center[0]], int(l)) for i, l in enumerate(label)]


def small(monkeypatch):
    for name, value in (("BLOCK", 16), ("ANCHORS", 3), ("FEWEST", 40), ("MOST", 90), ("LEVELS", (1, 3, 8))):
        monkeypatch.setattr(hn, name, value)


@pytest.mark.parametrize("tiny", [False, True])
def test_equals_brute_force(spark, monkeypatch, tiny):
    if tiny:
        small(monkeypatch)
    rows = clustered(np.random.default_rng(0), 420)
    want = mined(rows)
    assert len(want) > 60 and got(spark, rows) == want


def test_ties_copies_nulls_and_odd_vectors(spark, monkeypatch):
    small(monkeypatch)
    rng = np.random.default_rng(1)
    rows = [(int(i), [float(x) for x in rng.integers(0, 3, 5) / 4], int(l)) for i, l in enumerate(rng.integers(0, 3, 160))]
    rows += [(1000 + k, rows[50][1], k % 3) for k in range(60)] + rows[40:60]
    rows += [(None, [1.0] * 5, 1), (2000, None, 1), (2050, [], 1), (2100, [1.0, None, 0.0, 0.0, 0.0], 1), (2150, [float("nan")] * 5, 2), (2200, [float("inf")] * 5, 2), (2250, [1.0] * 5, None)]
    rows += [(3000, [1.0, 2.0], 1), (3001, [1.0, 2.0], 1), (3002, [1.0, 1.0], 2), (50, [0.5] * 5, 2), (4000, [-1.0] * 5, 9), (4050, [0.0] * 5, 1)]
    assert got(spark, rows) == mined(rows)
    assert got(spark, [r for r in rows if r[0] == 2000]) == [] and got(spark, []) == []


def test_other_columns_and_large_components(spark):
    rows = [(k, [float(k % 7) * 2.0**12, 2.0**10 * (k % 3)], k % 2, 1, "x") for k in range(120)]
    schema = "vec_id long, embedding array<double>, label int, id int, key string"
    assert got(spark, rows, schema) == mined([r[:3] for r in rows])
    huge = [(k, [float(k % 7) * 2.0**30, 2.0**20], k % 2) for k in range(60)]
    assert got(spark, huge, "vec_id long, embedding array<double>, label int") == []  # scores held at the greatest are none of 95 percent


def test_bounds_hold_and_narrow():
    rng = np.random.default_rng(2)
    made = [hn.Vectors(np.zeros(n, int), np.arange(n), np.arange(n), rng.integers(-90, 90, (n, 37)), np.zeros((n, 0), int)) for n in (20, 30)]
    a, b = np.arange(20), np.arange(30)
    score, width = made[0].scores(made[1], a, b), []
    for level in range(len(hn.LEVELS)):
        low, high = made[0].bounds(made[1], level, a, b)
        assert (low <= score).all() and (score <= high).all()
        width.append((high - low).mean())
    assert width == sorted(width, reverse=True)
