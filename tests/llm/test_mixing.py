import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import mixing
from texts import SCHEMA, corpus, odd_texts, words


def two_kinds(spark, rng):
    plain = [" ".join(words(rng, int(rng.integers(20, 80)))) for _ in range(120)]
    accented = [" ".join(f"{w}é" for w in words(rng, int(rng.integers(20, 80)))) for _ in range(40)]
    df = corpus(spark, plain + accented, rate=("int", 1), tokens=("string", None), p0=("double", 9.0))
    known = df.select("doc_id", F.when(F.col("doc_id") < 120, "a").otherwise("b").alias("domain")).where("doc_id % 3 = 0")
    return df, known


def test_totals_reach_their_targets(spark):
    df, known = two_kinds(spark, np.random.default_rng(0))
    out, report = mixing.mixing_rates(df, known, {"a": 0.4, "b": 0.6})
    rows = out.collect()
    total = sum(r.tokens for r in rows)
    for k, (d, share) in enumerate((("a", 0.4), ("b", 0.6))):
        reached = sum(r.rate * r.tokens * r.posteriors[k] for r in rows)
        assert reached == pytest.approx(share * total, rel=5e-3) and report[d]["reached"] == pytest.approx(reached, rel=1e-6)
    assert min(r.rate for r in rows) >= 0
    assert all(abs(sum(r.posteriors) - 1) < 1e-9 for r in rows)
    right = sum((r.posteriors[0] > 0.5) == (r.row.doc_id < 120) for r in rows)
    assert right > 155


def test_rates_are_a_minimum_of_least_squares(spark):
    """Targets out of reach: the projected gradient is zero where rates are positive, and not negative at 0."""
    df, known = two_kinds(spark, np.random.default_rng(1))
    out, report = mixing.mixing_rates(df, known, {"a": 1.0, "b": 0.0}, tolerance=1e-7)
    slope = [(report[d]["reached"] - report[d]["target"]) / report[d]["natural"] for d in "ab"]
    for r in out.collect():
        g = float(np.dot(r.posteriors, slope))
        assert g > -1e-3 and (abs(g) < 1e-3 or r.rate < 1e-3)


def test_temper_asks_no_domain_for_less_than_it_has(spark):
    df, known = two_kinds(spark, np.random.default_rng(2))
    out, report = mixing.mixing_rates(df, known, None, temper=0.7)
    assert all(v["target"] >= v["natural"] * (1 - 1e-9) for v in report.values())
    assert out.agg(F.min("rate")).first()[0] > 0.98


def test_odd_rows(spark):
    rng = np.random.default_rng(3)
    df, known = two_kinds(spark, rng)
    odd = corpus(spark, odd_texts(), [None] * len(odd_texts()), rate=("int", 1), tokens=("string", None), p0=("double", 9.0))
    out, _ = mixing.mixing_rates(df.unionByName(odd), known, {"a": 0.5, "b": 0.5})
    rows = out.where("row.doc_id is null").collect()
    assert len(rows) == len(odd_texts()) and all(r.rate >= 0 for r in rows)
    empty, report = mixing.mixing_rates(spark.createDataFrame([], SCHEMA), known, {"a": 1.0})
    assert empty.count() == 0 and report["a"]["reached"] == 0
    with pytest.raises(ValueError, match="no labelled document"):
        mixing.mixing_rates(df, known, {"a": 0.5, "nowhere": 0.5})


def test_copies_average_to_the_rate(spark):
    n = spark.range(20_000).select(mixing.copies(F.lit(1.3), F.col("id")).alias("n")).agg(F.avg("n"), F.max("n")).first()
    assert n[0] == pytest.approx(1.3, abs=0.02) and n[1] == 2


def test_missed_targets_show(spark):
    df, known = two_kinds(spark, np.random.default_rng(2))
    _, report = mixing.mixing_rates(df, known, {"a": 0.4, "b": 0.6})
    assert mixing.missed(report) <= 1e-3
    mixed = df.withColumn("text", F.lit("the same text for all"))  # nothing tells domains apart
    _, report = mixing.mixing_rates(mixed, known, {"a": 0.01, "b": 0.99})
    assert mixing.missed(report) > 0.05 and mixing.missed({}) == 0
