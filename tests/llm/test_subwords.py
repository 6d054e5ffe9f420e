import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from panelwright.llm import subwords
from panelwright.llm.tokens import flat, mix
from texts import SCHEMA, corpus, odd_texts, words

TEXTS = ["Hello  world\n\tx ", "", " a", "日本語 text émigré ñ 🎉\0 ", "a" * 300 + " " * 70 + "b" * 60, "  ", "x"]


@pytest.fixture(scope="module")
def vocabulary():
    return subwords.vocabulary(subwords._model(subwords.MODEL))


def encoded(vocabulary, texts, dropout, seed=1, **kind):
    data, at = flat(pa.array(texts))
    ids, cuts = subwords.encode_block(vocabulary, data, at, mix(np.arange(len(texts)).astype(np.uint64)), dropout, seed, **kind)
    return [ids[a:b].tolist() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def test_without_dropout_it_is_the_usual_segmentation(vocabulary):
    sp = sentencepiece.SentencePieceProcessor(model_file=subwords.MODEL)
    rng = np.random.default_rng(0)
    texts = TEXTS + ["".join(chr(c) for c in rng.choice([32, 97, 101, 110, 116, 228, 8364, 10], 40)) for _ in range(100)]
    assert encoded(vocabulary, texts, 0.0) == [sp.encode(t) for t in texts]


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_decoding_gives_back_every_text(spark, dropout):
    texts = TEXTS + odd_texts() + ["▁ mark ▁▁"]
    df = corpus(spark, texts, ids_=("int", 1), row=("string", "r"))
    out = subwords.encode(df, dropout=dropout, seed=3, spelled=True)
    assert {r.row.doc_id: r.text for r in out.collect()} == dict(enumerate(texts))
    assert {r.row.doc_id: r.text for r in subwords.decode(out.select("row", "ids")).collect()} == dict(enumerate(texts))
    assert {r.ids is None for r in out.where("text is null").collect()} == {True}


def test_seeds_vary_and_repeat(vocabulary):
    text = [" ".join(words(np.random.default_rng(1), 200))] * 2
    one = encoded(vocabulary, text, 0.3, seed=1)
    assert one == encoded(vocabulary, text, 0.3, seed=1) != encoded(vocabulary, text, 0.3, seed=2)
    assert len(encoded(vocabulary, text, 0.5)[0]) > len(one[0]) > len(encoded(vocabulary, text, 0.0)[0])


@pytest.mark.parametrize("dropout", [0.0, 0.2])
def test_the_agenda_gives_what_the_rounds_give(vocabulary, dropout):
    rng = np.random.default_rng(2)
    skip = int(dropout * 2**64)
    for _ in range(60):
        points = rng.choice([97, 101, 105, 110, 114, 115, 116, 233], int(rng.integers(2, 40)))
        symbols = vocabulary.chars[points]
        key = np.array([rng.integers(0, 2**63)], np.uint64)
        done, n = subwords._together(vocabulary, symbols[None, :].astype(np.int32).copy(), key, skip)
        assert done[0, : n[0]].tolist() == subwords._agenda(vocabulary, symbols, key[0], skip).tolist()


def test_known_words_and_words_apart_agree(vocabulary):
    text = [" ".join(words(np.random.default_rng(5), 300, 60))]
    known = subwords.Known(most=40)
    again = [encoded(vocabulary, text, 0.2, known=known) for _ in range(3)]
    assert again == [encoded(vocabulary, text, 0.2, apart=True)] * 3


def test_every_occurrence_draws_its_own_skips(vocabulary):
    text = ["understanding"] * 4000
    found = encoded(vocabulary, text, 0.1)
    kinds, usual = {tuple(x) for x in found}, encoded(vocabulary, text[:1], 0.0)[0]
    assert len(kinds) > 20 and 0.2 < np.mean([x == usual for x in found]) < 0.8
    assert found == encoded(vocabulary, text, 0.1, apart=True)


def test_empty_table(spark):
    assert subwords.encode(spark.createDataFrame([], SCHEMA)).count() == 0
