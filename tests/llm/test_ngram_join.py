import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.llm import ngram_join as nj
from panelwright.llm import scratch
from texts import SCHEMA, corpus, edited, linked_components, odd_texts, shingles, words


def found(df):
    return {r.doc_id: r for r in nj.near_duplicates(df).collect()}


@pytest.mark.parametrize("seed,sizes", [(0, (1, 12)), (1, (8, 60)), (2, (40, 300))])
def test_components_equal_brute_force(spark, seed, sizes):
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(25):
        base = words(rng, int(rng.integers(*sizes)))
        texts.append(" ".join(base))
        for _ in range(int(rng.integers(0, 4))):
            texts.append(" ".join(edited(rng, base, int(rng.integers(0, 1 + len(base) // 20)))).title())
    rng.shuffle(texts)
    got = found(corpus(spark, texts).repartition(4))
    want = linked_components(texts, range(len(texts)))
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(shingles(texts[i])) for i, r in got.items())
    assert len(set(want.values())) < len(texts)


def test_a_passage_that_very_many_texts_share_links_only_what_is_similar(spark):
    """More texts than WIDE under the passage's keys, in small and large shares of the text."""
    rng = np.random.default_rng(4)
    passage = words(rng, 60, 10**6)
    texts = [" ".join(passage + words(rng, n, 10**6)) for n in (10, 14, 20, 40, 60) for _ in range(30)]
    texts += [" ".join(edited(rng, texts[k].split(), 1)) for k in range(0, 150, 10)]
    got = found(corpus(spark, texts).repartition(3))
    assert {i: r.component_id for i, r in got.items()} == linked_components(texts, range(len(texts)))


def test_odd_texts_ids_and_columns(spark):
    texts = odd_texts()
    df = corpus(spark, texts, id=("int", 1), n=("int", 2), component_id=("string", "x"), counts=("string", None))
    got = found(df)
    assert {i: r.component_id for i, r in got.items()} == linked_components(texts, range(len(texts)))
    assert [got[i].n_shingles for i in range(3)] == [0, 0, 0]
    nulls = nj.near_duplicates(corpus(spark, ["a b", "a b"], [None, None])).collect()
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in nulls] == [(None, 1, None)] * 2
    twice = nj.near_duplicates(corpus(spark, ["a b", "c d", "c d"], [7, 7, 3])).collect()
    assert sorted((r.doc_id, r.component_id) for r in twice) == [(3, 3), (7, 3), (7, 3)]
    assert nj.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_text_of_each_component_stays(spark):
    df = corpus(spark, ["p q", "a b c d e f", "a b c d e f", None], note=("string", "x"))
    kept = nj.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 3]


@pytest.mark.parametrize("deletions", [False, True])
def test_similar_sets_share_a_key(deletions):
    """The pigeonhole argument, on sets at the edge of the threshold."""
    rng = np.random.default_rng(0)
    scheme = nj.Scheme(75, deletions)
    for size in (1, 2, 3, 5, 9, 17, 40, 150):
        for _ in range(20):
            a = rng.integers(0, 2**63, size).astype(np.uint64)
            grow = int(rng.integers(0, size // 3 + 1))
            swap = int(rng.integers(0, size // 7 + 1))
            b = np.unique(np.concatenate([a[swap:], rng.integers(0, 2**63, grow).astype(np.uint64)]))
            a = np.unique(a)
            inner = len(np.intersect1d(a, b))
            if 100 * inner < 75 * (len(a) + len(b) - inner):
                continue
            keys = [set() for _ in range(2)]
            sets = np.concatenate([a, b])
            of = np.repeat([0, 1], [len(a), len(b)])
            for k, t, _ in scheme.keys(sets, of, np.array([len(a), len(b)]), np.empty(0, np.uint64), 64):
                for text in (0, 1):
                    keys[text] |= set(k[t == text].tolist())
            assert keys[0] & keys[1]


def test_counts_never_rule_out_a_similar_pair():
    rng = np.random.default_rng(1)
    for size in (3, 30, 300):
        a = np.unique(rng.integers(0, 2**63, size).astype(np.uint64))
        b = np.unique(np.concatenate([a[size // 8 :], rng.integers(0, 2**63, size // 4).astype(np.uint64)]))
        counts = nj._spread_counts(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), np.array([len(a), len(b)]))
        x, y = (np.frombuffer(c, np.uint8).astype(int) for c in counts)
        while len(x) != len(y):
            x, y = (x, y.reshape(-1, 2).sum(1)) if len(x) < len(y) else (x.reshape(-1, 2).sum(1), y)
        assert np.abs(x - y).sum() <= len(np.setxor1d(a, b))


def test_packing_keeps_keys_and_ids():
    keys = np.sort(np.random.default_rng(0).integers(0, 2**50, 1000).astype(np.uint64))
    ids = np.random.default_rng(1).integers(-5, 5, 1000)
    k, i = nj._unpacked(nj._packed(keys, ids))
    assert (k == keys).all() and (i == ids).all()


def test_blocks_of_a_wide_key_and_large_classes_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 16)
    monkeypatch.setattr(scratch, "HOT_SHARE", 1e-6)  # classes of more than ten rows
    rng = np.random.default_rng(6)
    passage = words(rng, 60, 10**6)
    texts = [" ".join(passage + words(rng, n, 10**6)) for n in (10, 14, 20) for _ in range(60)]
    texts += [" ".join(edited(rng, texts[k].split(), 1)) for k in range(0, 180, 12)] + [texts[5]] * 30 + [""] * 3
    got = found(corpus(spark, texts).repartition(3))
    assert {i: r.component_id for i, r in got.items()} == linked_components(texts, range(len(texts)))
    assert len({got[i].set_id for i in range(195, 225)} | {got[5].set_id}) == 1


def test_each_two_texts_of_a_key_meet_once_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(nj, "BLOCK", 4)
    entries = spark.createDataFrame([(b, i, i, n) for b, n in ((1, 3), (2, 23)) for i in range(n)], "bucket long, id long, component long, texts long")
    cells = {}
    for r in nj._in_blocks(entries).collect():
        cells.setdefault((r.bucket, r.low, r.high), []).append((r.side, r.id))
    met = [(k[0], min(a, b), max(a, b)) for k, rows in cells.items() for s, a in rows for t, b in rows if a < b and (k[1] == k[2] or s != t)]
    assert sorted(met) == sorted((b, i, j) for b, n in ((1, 3), (2, 23)) for i in range(n) for j in range(i + 1, n))
    assert max(map(len, cells.values())) < 23


def test_leaders_of_a_text_are_one_row_of_its_join(spark):
    lists = spark.createDataFrame([(1, 0, [0, 1, 2, 3]), (2, 1, [1, 2, 3]), (3, 1, [1, 2, 3]), (4, 0, [0, 4])], nj.LIST)
    to = spark.createDataFrame([(i, i, 10 if i == 4 else 100) for i in range(5)], "id long, set_id long, n long")
    out = nj._led(lists, to, 75)
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert len(joins) == 2 and all("(leader#" in x or "(id#" in x for x in joins)
    assert sorted((r.u, r.v) for r in out.collect()) == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3)]


def test_texts_that_share_a_passage_only_are_not_compared(spark, monkeypatch):
    """Few entries of keys are left to compare, and components are right."""
    entries = []

    def written(df, label, files=None):
        out = scratch.written(df, label, files)
        if "bucket" in df.columns and label == "open":
            entries.append(out.count())
        return out

    monkeypatch.setattr(nj, "written", written)
    rng = np.random.default_rng(8)
    passage = words(rng, 60, 10**6)
    texts = [" ".join(passage + words(rng, n, 10**6)) for n in (30, 36, 44) for _ in range(60)]
    texts += [" ".join(edited(rng, texts[k].split(), 1)) for k in range(0, 180, 12)]
    got = found(corpus(spark, texts).repartition(3))
    assert {i: r.component_id for i, r in got.items()} == linked_components(texts, range(len(texts)))
    assert entries and max(entries) < 5 * len(texts)


@pytest.mark.parametrize("common", [False, True])
def test_similar_sets_of_two_components_share_a_rare_shingle(spark, common):
    """And from one of those on both have enough shingles left; also where some are common, or the sample sees few."""
    rng = np.random.default_rng(9)
    texts = []
    for n in (1, 3, 5, 9, 20, 70, 200):
        base = words(rng, n, 10**6)
        texts += [" ".join(base)] + [" ".join(edited(rng, base, k)) for k in (1, 2, 3 + n // 30) for _ in range(2)]
    texts = list(dict.fromkeys(texts))
    often = np.empty(0, np.uint64)
    if common:
        data = [x.encode() for x in texts[::3]]
        often, _, _ = nj.shingle_sets(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0] + [len(x) for x in data]), 5)
        often = np.unique(often)
    df = spark.createDataFrame([(i, i, t, i) for i, t in enumerate(texts)], "id long, component long, text string, number long").repartition(3)
    kept = {r.id for r in nj._sharing(df, 75, 5, often).collect()}
    keys = {}
    for r in nj._rare(df, 75, 5, often).collect():
        keys.setdefault(r.id, {})[r.bucket] = r.rest
    sets, links = [shingles(t) for t in texts], 0
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                links += 1
                least = 75 * (len(sets[a]) + len(sets[b]))
                assert {a, b} <= kept
                assert any(175 * min(keys[a][k], keys[b][k]) >= least for k in keys[a].keys() & keys[b].keys())
    assert links > 10


def test_components_with_more_pairs_than_a_first_look_takes_say_so(spark):
    rows = [(1, 0, 0, 0, i, i % 2, 8, 8, bytes([1] * 8)) for i in range(6)]
    names = "bucket long, low int, high int, side int, id long, component long, n long, rest long, counts binary"
    df = spark.createDataFrame(rows, names).coalesce(1)
    out = "u long, v long, more boolean"
    first = df.mapInArrow(nj._apart(75, 3), out).collect()
    assert len(first) == 3 and [r.more for r in first].count(True) == 1
    every = df.mapInArrow(nj._apart(75, None), out).collect()
    assert len(every) == 9 and not any(r.more for r in every)
    short = df.withColumn("rest", F.lit(5).cast("long"))
    assert short.mapInArrow(nj._apart(75, None), out).count() == 0
