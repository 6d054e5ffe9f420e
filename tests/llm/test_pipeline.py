import collections

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from checks import compare
from panelwright.llm import mixing, oracle, quality, queries, subwords
from panelwright.llm.tokens import flat
from texts import SCHEMA, corpus, linked_components, without_shared_lines, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """Each stage's input and result, as rows."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).cache())
    return out


def texts_of(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_in_order_keep_the_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_duplicates", "mix_sources", "encode"]
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_quality_rules_keep_all_that_pass(spark, stages):
    verdict = {r.row.doc_id: r.kept for r in quality.quality(stages[0]).collect()}
    assert set(texts_of(stages[1])) == {i for i, kept in verdict.items() if kept}
    data, at = flat(pa.array(list(texts_of(stages[0]).values())))
    n = quality.counts(data, at)["n_words"]
    assert all(w >= 50 for w, i in zip(n, texts_of(stages[0]), strict=True) if verdict[i])


def test_line_dedup_equals_brute_force(stages):
    before, after = texts_of(stages[1]), texts_of(stages[2])
    assert after == {i: t for i, _, _, t in without_shared_lines(before.values(), before)}
    assert all(r.n_chars == len(r.text) for r in stages[2].collect())


def test_one_document_of_each_group_stays(stages):
    before = texts_of(stages[2])
    groups = linked_components(before.values(), before)
    assert set(texts_of(stages[3])) == {i for i in before if groups[i] == i}


def test_mixing_keeps_every_document(stages):
    assert texts_of(stages[4]) == texts_of(stages[3])


def test_pieces_spell_the_texts(spark, stages):
    found = subwords.decode(stages[5].select(F.struct("doc_id").alias("row"), "ids")).collect()
    assert collections.Counter((r.row.doc_id, r.text) for r in found) == collections.Counter((r.doc_id, r.text) for r in stages[4].collect())


def test_run_gives_the_last_stage(spark, stages):
    assert corpus_pipeline.run(spark, SF).count() == stages[5].count()


def test_all_queries_are_registered():
    names = set(contract.queries())
    assert {k for k in names if k.startswith("op")} == set(queries.QUERIES) and len(queries.QUERIES) == 13 and "pipeline" in names


@pytest.mark.parametrize("key", list(oracle.ORACLE))
def test_query_equals_sql(spark, key):
    cur = compare.connect(SF).execute(oracle.ORACLE[key])
    cols = sorted(d[0] for d in cur.description)
    place = [[d[0] for d in cur.description].index(c) for c in cols]
    want = sorted((tuple(r[k] for k in place) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(r) for r in queries.QUERIES[key](spark, SF).select(*cols).collect()), key=repr) == want and want


@pytest.mark.parametrize("key", [k for k in queries.QUERIES if k not in oracle.ORACLE])
def test_query_has_a_row_for_each_document(spark, key):
    table = "pages" if key == "op5_html_text" else "documents"
    assert queries.QUERIES[key](spark, SF).count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_copies_follow_the_rates(spark, stages):
    """Each document as often as its rate says, rounded by a hash, and once at least."""
    docs = stages[3]
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    known = docs.join(labels, "doc_id", "left_semi").select("doc_id", F.col("lang").alias("domain"))
    rates, report = mixing.mixing_rates(docs, known, None, temper=0.8)
    want = {r.doc_id: max(1, r.times) for r in rates.select("row.doc_id", mixing.copies(F.col("rate"), F.col("row.doc_id")).alias("times")).collect()}
    assert collections.Counter(r.doc_id for r in stages[4].collect()) == want
    assert mixing.missed(report) <= 0.01 and max(want.values()) > 1


def odd_docs(spark):
    """Null ids and texts, repeated rows, and columns named like those a stage makes."""
    rng = np.random.default_rng(3)
    texts = [" ".join(words(rng, 80, 3000)) for _ in range(30)]
    more = {c: ("int", k) for k, c in enumerate(("copy", "times", "row", "gone_id", "gone_hash", "times_id", "text_hash", "kept", "rate", "u"))}
    return corpus(spark, [*texts, texts[0], None, "", texts[1]], [*range(30), 0, 31, 32, None], **more)


def test_stages_stand_odd_rows_and_names(spark):
    docs = odd_docs(spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == odd_docs(spark).columns
    kept = collections.Counter(r.doc_id for r in docs.collect())
    assert {*range(2, 30), 0, None} <= set(kept) and not {31, 32} & set(kept)
    assert corpus_pipeline.encode(spark, docs, SF).count() == docs.count()


def test_stages_of_an_empty_table_are_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        assert docs.count() == 0
