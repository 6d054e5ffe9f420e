import collections

import numpy as np
import pytest

from panelwright.llm import quality as ql
from panelwright.llm.tokens import flat
from texts import SCHEMA, WORD, corpus, odd_texts, words


def brute(text):
    ws = WORD.findall(text)
    lines = text.split("\n")
    dup, seen = 0, set()
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    count = collections.Counter(windows)
    repeat = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(3)}
    return len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(repeat)


def test_counts_equal_brute_force():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    texts = [(t or "") for t in odd_texts()] + ["a\na\n a\n\n\nb", "x x x x", "#*é|\t<", "\n"]
    texts += ["\n".join(" ".join(words(rng, 5, 4)) for _ in range(rng.integers(1, 9))) for _ in range(50)]
    data, at = flat(pa.array(texts))
    got = ql.counts(data, at)
    for k, t in enumerate(texts):
        assert tuple(int(got[c][k]) for c in ql.COUNTS[:5]) == brute(t)


def test_chi_square():
    assert ql.chi2_cdf(11.0705, 5) == pytest.approx(0.95, abs=1e-5)
    assert ql.chi2_quantile(0.975, 6) == pytest.approx(14.4494, abs=1e-4)


def test_junk_is_rejected_and_clean_texts_stay(spark):
    rng = np.random.default_rng(1)
    clean = [" ".join(words(rng, int(rng.integers(60, 300)), 5000)) for _ in range(400)]
    junk = [" ".join(f"{w}***" for w in words(rng, 100, 5000)) for _ in range(90)]
    junk += [" ".join(w.upper() + "!!" for w in words(rng, 100, 5000)) for _ in range(30)]
    df = corpus(spark, clean + junk + ["short text"] + ["same " * 80], kept=("boolean", False), grp=("string", "g"), x0=("double", 1.0))
    rows = {r.row.doc_id: r for r in ql.quality(df).collect()}
    assert all(rows[i].kept for i in range(400))
    assert not any(rows[i].kept for i in range(400, 520))
    assert rows[520].base_failed and rows[521].base_failed and rows[520].distance is None


def test_groups_too_small_nulls_and_empty_tables(spark):
    rows = ql.quality(corpus(spark, odd_texts(), [None] * len(odd_texts())).withColumn("lang", __import__("pyspark.sql.functions").sql.functions.lit(None).cast("string"))).collect()
    assert len(rows) == len(odd_texts())
    assert [r.kept for r in rows] == [r.n_words >= 50 for r in rows]
    assert ql.quality(spark.createDataFrame([], SCHEMA)).count() == 0


def test_mcd_is_not_moved_by_a_fifth_of_outliers(spark):
    rng = np.random.default_rng(3)
    shape = rng.normal(size=(ql.P, ql.P)) / 3 + np.eye(ql.P)
    good, bad = rng.normal(size=(4000, ql.P)) @ shape.T, rng.normal(8, 0.3, (1000, ql.P))
    rows = [("g", *map(float, x)) for x in np.vstack([good, bad])]
    fit = ql.fits(spark.createDataFrame(rows, "grp string, " + ", ".join(f"{x} double" for x in ql.X)), True).first()
    centre = np.array([fit[f"m{i}"] for i in range(ql.P)])
    assert np.abs(centre).max() < 0.25
    root = np.zeros((ql.P, ql.P))
    for i, j in ql.PAIRS:
        root[i, j] = fit[f"l{i}{j}"]
    distance = ((np.vstack([good, bad]) - centre) @ root.T) ** 2
    cut = ql.chi2_quantile(0.9999, ql.P)
    assert (distance.sum(1)[:4000] <= cut).mean() > 0.99 and (distance.sum(1)[4000:] > cut).all()


@pytest.mark.parametrize("copies", [False, True])
def test_two_fifths_of_junk_and_a_third_of_copies_are_rejected(spark, copies):
    rng = np.random.default_rng(4)
    clean = [" ".join(words(rng, int(rng.integers(60, 300)), 5000)) for _ in range(300)]
    junk = [" ".join(f"{w}***" for w in words(rng, int(rng.integers(60, 300)), 5000)) for _ in range(200)]
    junk = junk[:1] * 150 if copies else junk
    kept = {r.row.doc_id: r.kept for r in ql.quality(corpus(spark, clean + junk)).collect()}
    assert all(kept[i] for i in range(300))
    assert not any(kept[i] for i in range(300, 300 + len(junk)))
