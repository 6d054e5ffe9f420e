import numpy as np
from pyspark.sql import functions as F

from panelwright.llm import lines
from texts import SCHEMA, corpus, odd_texts, without_shared_lines


def report(df):
    out = lines.dedup_lines(df).select("row.doc_id", "n_lines", "n_dropped", F.coalesce("text", F.lit("")).alias("t"))
    return sorted(tuple(r) for r in out.collect())


def test_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    pool = [f"{'A line that many texts share' if k % 2 else 'short'} {k}" for k in range(12)]
    texts = ["\n".join(f"  {p.upper() if rng.random() < 0.3 else p}\t" for p in rng.choice(pool, rng.integers(0, 9))) for _ in range(60)]
    texts += odd_texts() + ["\n", "x\n\n" + pool[1]]
    ids = list(range(len(texts)))
    assert report(corpus(spark, texts)) == sorted(without_shared_lines(texts, ids))


def test_a_line_of_most_documents_is_spread_and_dropped(spark):
    texts = [f"a very common line of text\nown line number {k} of this text" for k in range(500)]
    got = report(corpus(spark, texts).repartition(6))
    assert [g[2] for g in got] == [1] * 499 + [0]


def test_repeated_rows_null_ids_and_other_columns(spark):
    line = "this line is long enough to count"
    texts, ids = [line, line + "\nmore", line, line, None], [1, 1, 2, 3, None]
    df = corpus(spark, texts, ids, drop=("string", "d"), id=("int", 5), text_hash=("int", 1))
    assert report(df.where("doc_id is not null")) == sorted((i, *rest) for i, *rest in without_shared_lines(texts[:4], ids[:4]))
    null = lines.dedup_lines(corpus(spark, [line] * 4, [None] * 4)).collect()
    assert [r.n_dropped for r in null] == [0] * 4
    kept = lines.without_shared_lines(df)
    assert kept.columns == df.columns and kept.where("text is null").count() == 1
    assert lines.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0
