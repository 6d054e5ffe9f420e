import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import repeats
from texts import SCHEMA, corpus, odd_texts, words


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = collections.Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(int), 0]))
        out.append((len(b), [tuple(x) for x in edge.reshape(-1, 2).tolist()], np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


def report(df, length):
    rows = repeats.drop_repeats(df, length=length).select("row.doc_id", "n_bytes", "spans", "kept").collect()
    return [(r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in sorted(rows, key=lambda r: r.doc_id)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    rng = np.random.default_rng(seed)
    passages = [" ".join(words(rng, 30, 50)) for _ in range(6)]
    texts = []
    for _ in range(40):
        parts = [" ".join(words(rng, int(rng.integers(0, 20)), 50)) for _ in range(3)]
        texts.append(f" {rng.choice(passages)} ".join(parts))
    texts += ["ab" * 100, "abc" * 50, "é" * 90, "x" * 41] + texts[:3]
    assert report(corpus(spark, texts).repartition(4), 40) == brute(texts, 40)


def test_production_length_and_odd_texts(spark):
    rng = np.random.default_rng(5)
    passage = " ".join(words(rng, 120, 9000))
    texts = [" ".join(words(rng, 50, 9000)) + passage + " ".join(words(rng, 20, 9000)) for _ in range(5)]
    texts += ["Ther " * 200, passage[:399], passage[:400]] + [t for t in odd_texts() if t is None or len(t) < 1000]
    df = corpus(spark, texts, t=("string", "c"), id=("int", 1), marks=("string", None), first=("int", 2))
    assert report(df, 400) == brute(texts, 400)


def test_heavy_anchors_are_compared_by_hash(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HEAVY", 300)
    rng = np.random.default_rng(6)
    passage = " ".join(words(rng, 20, 9000))
    texts = [" ".join(words(rng, 9, 9000)) + passage + " ".join(words(rng, 9, 9000)) for _ in range(12)]
    assert report(corpus(spark, texts), 40) == brute(texts, 40)


def test_repeated_rows_and_empty_tables(spark):
    text = "q" + "".join(map(str, range(100)))
    rows = repeats.drop_repeats(corpus(spark, [text, text], [None, None]), length=40).collect()
    assert [bytes(r.kept) for r in rows] == [b"", b""]
    assert repeats.drop_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("seed", range(30))
def test_run_length_index_matches(seed):
    rng = np.random.default_rng(seed)
    length = int(rng.integers(2, 9))
    parts = [bytes(rng.integers(97, 99 + seed % 3, int(rng.integers(length, 60))).astype(np.uint8)) for _ in range(6)]
    parts += [p[: len(p) // 2] + b"x" + p[len(p) // 2 :] for p in parts[:3]]
    count = collections.Counter(p[i : i + length] for p in parts for i in range(len(p) - length + 1))
    for p, flags in zip(parts, repeats.repeated_windows(parts, length), strict=True):
        assert flags.tolist() == [count[p[i : i + length]] > 1 for i in range(len(p) - length + 1)]


def test_runs_are_fewer_in_repetitive_text():
    rng = np.random.default_rng(0)
    base = rng.integers(1, 5, 2000).astype(np.int16)
    once = repeats.RunIndex.of(np.r_[base, 0].astype(np.int16))
    often = repeats.RunIndex.of(np.r_[np.tile(np.r_[base, 0], 8)].astype(np.int16))
    assert len(often.starts) < 1.2 * len(once.starts)


def test_suffix_array():
    text = np.random.default_rng(1).integers(0, 3, 500).astype(np.int16)
    want = sorted(range(500), key=lambda i: text[i:].tolist())
    assert repeats.suffix_array(text).tolist() == want
