import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import fingerprints as fp
from texts import SCHEMA, WORD, corpus, odd_texts, words


def sets(text):
    ws = WORD.findall(text or "")
    return {tuple(ws)} if 0 < len(ws) < 5 else {tuple(ws[i : i + 5]) for i in range(len(ws) - 4)}


def alike(a, b):
    return 1.0 if not a | b else len(a & b) / len(a | b)


def expected(rows):
    """(id, text, edited, next) by descending id, null ids last, ties by text."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(t) // 2
        out.append((i, t, t[: len(t) - half] + n[:half], n))
    return out


@pytest.mark.parametrize("partitions", ["3", "200"])
def test_neighbours_edits_and_likeness(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        rng = np.random.default_rng(0)
        texts = [" ".join(words(rng, int(rng.integers(0, 90)))) for _ in range(150)] + [t for t in odd_texts() if t is None or len(t) < 10**4]
        ids = [int(i) for i in rng.choice(10**7, len(texts) - 3, replace=False)]
        ids += ids[:3]
        df = corpus(spark, texts, ids, block=("int", 1), sketch=("string", "x"), id=("int", 4))
        rows = fp.fingerprints(df).withColumn("near", fp.resemblance(F.col("sketch"), F.col("edited_sketch"))).withColumn("after", fp.resemblance(F.col("sketch"), F.col("next_sketch"))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = sorted((r.id, r.text, r.edited, round(r.near, 9), round(r.after, 9)) for r in rows)
    # texts of under 128 shingles: estimates are exact
    assert got == sorted((i, t, e, round(alike(sets(t), sets(e)), 9), round(alike(sets(t), sets(n)), 9)) for i, t, e, n in expected(list(zip(ids, texts, strict=True))))


def test_estimates_on_long_texts(spark):
    rng = np.random.default_rng(1)
    base = words(rng, 3000, 10**6)
    texts = [" ".join(base), " ".join(base[:2000] + words(rng, 1000, 10**6)), " ".join(base[:1000])]
    df = corpus(spark, texts).withColumn("s", fp.sketch(F.col("text")))
    a, b, c = [r.s for r in df.orderBy("doc_id").collect()]
    pair = spark.createDataFrame([(a, b, c)], "a array<long>, b array<long>, c array<long>")
    r = pair.select(
        fp.resemblance(F.col("a"), F.col("b")).alias("j"), fp.containment(F.col("c"), F.col("a")).alias("inside"),
        fp.distinct_shingles(F.col("a")).alias("n"), fp.fingerprint(F.col("a")).alias("f"),
    ).first()
    assert abs(r.j - 0.5) < 0.15 and r.inside > 0.6 and abs(r.n - 2996) < 900 and len(r.f) == 16 * fp.K


def test_sketches_merge(spark):
    rng = np.random.default_rng(2)
    df = corpus(spark, [" ".join(words(rng, 100, 10**6)) for _ in range(8)] + [""]).withColumn("s", fp.sketch(F.col("text"))).withColumn("g", F.col("doc_id") % 2)
    merged = {r.g: r.s for r in fp.merge_sketches(df, ["g"], "s").collect()}
    for g in (0, 1):
        every = sorted({h for r in df.where(F.col("g") == g).select(fp.shingle_hashes(F.col("text")).alias("h")).collect() for h in r.h})
        assert merged[g] == every[: fp.K]


def test_nulls_single_rows_and_empty_tables(spark):
    only = fp.fingerprints(corpus(spark, ["a b c d e f g"], [None])).first()
    assert only.edited == "a b c da b c " and only.next_sketch == only.sketch
    assert fp.fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    both = fp.fingerprints(corpus(spark, [None, None], [None, 3])).collect()
    assert [(r.text, r.edited, r.sketch) for r in both] == [("", "", [])] * 2


def test_equal_texts_have_equal_fingerprints(spark):
    rows = corpus(spark, ["x y z"] * 3, [5, 1, 9]).select(fp.fingerprint(fp.sketch(F.col("text"))).alias("f"))
    assert rows.distinct().count() == 1
    assert hashlib.sha256(rows.first().f.encode()).hexdigest()
