import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import toxicity as tx
from texts import SCHEMA, corpus, odd_texts, words

BAD = ["vilewort", "grubface", "slimebag"]


def labelled(rng, n):
    texts, toxic = [], []
    for k in range(n):
        ws = words(rng, int(rng.integers(20, 80)), 3000)
        if k % 4 == 0:
            for at in rng.integers(0, len(ws), 3):
                ws[at] = str(rng.choice(BAD)) + str(rng.choice(["", "s", "ling"]))
        texts.append(" ".join(ws).capitalize() + ".")
        toxic.append(int(k % 4 == 0))
    return texts, np.array(toxic)


@pytest.fixture(scope="module")
def field():
    return tx.fit(*labelled(np.random.default_rng(0), 800))


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    steps = rng.normal(size=(2, 2))
    for n in (1, 2, 7):
        emit = rng.normal(size=n)
        weight, total = np.zeros(n), 0.0
        for path in itertools.product((0, 1), repeat=n):
            w = np.exp(sum(e for e, s in zip(emit, path, strict=True) if s) + sum(steps[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += w
            weight += w * np.array(path)
        got = tx.marginals(emit, np.array([0, n]), steps)
        np.testing.assert_allclose(got, weight / total, rtol=1e-10)


def test_windows_do_not_change_a_long_chain():
    rng = np.random.default_rng(2)
    steps = np.array([[1.0, -1.0], [-0.5, 0.8]])
    emit = rng.normal(size=3 * tx.WINDOW + 17)
    got = tx.marginals(emit, np.array([0, len(emit)]), steps)
    ahead, back, _ = tx._forward_backward(emit[None, :], steps)
    np.testing.assert_allclose(got, (ahead * back / (1 + ahead * back))[0], rtol=1e-9)


def test_spans_and_scores(spark, field):
    texts, toxic = labelled(np.random.default_rng(5), 200)
    rows = sorted(tx.toxicity(corpus(spark, texts, spans=("string", None), score=("int", 3)), field).collect(), key=lambda r: r.row.doc_id)
    predicted = np.array([r.score >= 0.5 for r in rows])
    assert (predicted == toxic).mean() > 0.97
    for r, t in zip(rows, texts, strict=True):
        for s in r.spans:
            assert any(b in t[s.start : s.end].lower() for b in BAD) and not t[s.start : s.end].startswith(" ")


def test_odd_texts_have_the_score_of_no_toxic_token(spark, field):
    rows = tx.toxicity(corpus(spark, odd_texts(), [None] * len(odd_texts())), field).collect()
    assert len(rows) == len(odd_texts()) and all(0 <= r.score < 0.5 for r in rows)
    assert tx.toxicity(spark.createDataFrame([], SCHEMA), field).count() == 0
    seen = tx.toxicity(corpus(spark, ["Ünïcödé ☃ VILEWORT!"]), field).first()
    assert [(s.start, s.end) for s in seen.spans] == [(10, 18)]


def test_held_out_rows_teach_nothing(spark):
    texts, toxic = labelled(np.random.default_rng(6), 400)
    df = corpus(spark, texts)
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic)], "doc_id long, toxic int")
    use = F.crc32(F.col("known_id").cast("string")) % 5 != 0
    one = tx.learned(df, labels, use)
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    two = tx.learned(df, flipped, use)
    np.testing.assert_array_equal(one.weights, two.weights)
    assert zlib.crc32(b"0") % 5 == spark.range(1).select((F.crc32(F.lit("0")) % 5).alias("r")).first().r
    nothing = tx.learned(df, labels.where("toxic = 7"), use)
    assert tx.toxicity(df, nothing).agg(F.max("score")).first()[0] == 0.5


def test_a_passage_at_the_end_of_a_long_labelled_text_is_learned(spark):
    """Whole texts train the field; what bounds the sample is documents and bytes."""
    rng = np.random.default_rng(21)
    sizes = [20_000, *[2500] * 40]
    texts = [" ".join(words(rng, n, 3000)) for n in sizes] + [" ".join(words(rng, n, 3000)) + " endfoulness" for n in sizes]
    field = tx.fit(texts, np.repeat([0, 1], len(sizes)))
    probe = ["quiet words of no harm", "quiet endfoulness of no harm"]
    assert field.settled
    clean, bad = (r.score for r in sorted(tx.toxicity(corpus(spark, probe), field).collect(), key=lambda r: r.row.doc_id))
    assert bad > 0.5 > clean


def test_the_sample_is_bounded_by_documents_and_bytes(spark, monkeypatch):
    texts, toxic = labelled(np.random.default_rng(22), 80)
    docs = corpus(spark, [*texts, texts[0]], [*range(80), 0])
    known = spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(tx, "fit", lambda t, y: seen.append((t, y)))
    for limits in ({}, {"documents": 5}, {"size": 2000}, {"size": 1}):
        tx.learned(docs, known, F.lit(True), **limits)
    (every, y), (few, few_y), (small, _), (one, one_y) = seen
    assert sorted(every) == sorted([*texts, texts[0]]) and y.sum() == 21
    assert len(set(few)) == 10 and 5 <= few_y.sum() <= 6
    assert 2 < len(small) < 40 and all(t in texts for t in small)
    assert set(one_y.tolist()) == {0, 1} and 2 <= len(one) <= 4
