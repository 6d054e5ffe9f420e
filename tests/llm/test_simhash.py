import numpy as np
import pytest
from panelwright.llm import scratch, simhash
from texts import FOLD, SCHEMA, WORD, corpus, edited, odd_texts, words
from xxhash import xxh64_intdigest


def fingerprint(text, width=4):
    ws = WORD.findall((text or "").translate(FOLD))
    grams = [" ".join(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))] if ws else []
    hashes = [xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_reached(prints, ids, near=4):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, p in zip(ids, prints, strict=True):
        for b, q in zip(ids, prints, strict=True):
            if a < b and (p ^ q).bit_count() <= near:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in ids]


def test_the_code_is_perfect_and_two_errors_share_a_codeword():
    assert sorted(set(simhash._COUNT.tolist())) == [1, 6]
    assert simhash._COUNT.sum() == 1 + 23 + 253 + 1771 + 8855
    rng = np.random.default_rng(0)
    x = rng.integers(0, 1 << 23, 3000)
    y = x ^ (1 << rng.integers(0, 23, 3000)) ^ (1 << rng.integers(0, 23, 3000))
    (a, in_a), (b, in_b) = simhash.codewords(x), simhash.codewords(y)
    shared = (a[:, :, None] == b[:, None, :]) & in_a[:, :, None] & in_b[:, None, :]
    assert shared.any((1, 2)).all()


def test_fingerprints_within_four_bits_share_a_key():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 64, 2000, dtype=np.uint64)
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << rng.integers(0, 64, 2000, dtype=np.uint64)
    (k, of), (l, of_l) = simhash.keys(x), simhash.keys(y)
    assert k.max() < simhash.KEY_SPACE
    shared = set(zip(k.tolist(), of.tolist(), strict=True)) & set(zip(l.tolist(), of_l.tolist(), strict=True))
    assert {i for _, i in shared} == set(range(2000))


@pytest.mark.parametrize("piece", [40, 1 << 20])
def test_fingerprint_equals_brute_force(monkeypatch, piece):
    monkeypatch.setattr(simhash, "PIECE", piece)
    rng = np.random.default_rng(2)
    texts = [" ".join(words(rng, n)) for n in (1, 2, 3, 4, 5, 6, 7, 60, 300)] + ["Ä b\x0bC  d\nE f", "a b c d a b c d a b c d", "é x y z"]
    for text in texts + odd_texts()[:7]:
        assert simhash.simhash(None if text is None else text.encode()) == fingerprint(text)


def test_components_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    base = [words(rng, 150) for _ in range(12)]
    texts = [" ".join(edited(rng, b, int(e))) for b in base for e in rng.integers(0, 4, 8)] + odd_texts()
    ids = rng.permutation(len(texts)).tolist()
    got = {r.doc_id: (r.print % 2**64, r.component_id) for r in simhash.near_duplicates(corpus(spark, texts, ids)).collect()}
    prints = [fingerprint(t) for t in texts]
    assert got == {i: (p, c) for i, p, c in zip(ids, prints, least_reached(prints, ids), strict=True)}
    assert len({c for _, c in got.values()}) < len(texts) - 15


@pytest.mark.parametrize("few", [2, 32])
def test_links_join_what_all_pairs_join(monkeypatch, spark, few):
    monkeypatch.setattr(simhash, "FEW", few)
    rng = np.random.default_rng(4)
    prints = set()
    for _ in range(6):
        center = int(rng.integers(0, 2**63))
        prints |= {center ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64))) for _ in range(60)}
    prints = sorted(prints)
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    links = simhash.near_fingerprints(spark.createDataFrame([(p,) for p in signed], "print long")).collect()
    assert all(((r.u ^ r.v) % 2**64).bit_count() <= 4 for r in links)
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for r in links:
        root[find(r.u % 2**64)] = find(r.v % 2**64)
    want = least_reached(prints, prints)
    assert len({find(p) for p in prints}) == len(set(want))
    assert all(find(p) == find(w) for p, w in zip(prints, want, strict=True))


def test_repeated_ids_nulls_copies_and_other_columns(spark, monkeypatch):
    monkeypatch.setattr(scratch, "HOT_SHARE", 1e-6)
    rng = np.random.default_rng(5)
    a, b, c = (" ".join(words(rng, 80)) for _ in range(3))
    df = corpus(spark, [a] * 30 + [b, b, c, a, "", None], [*range(10, 40), 5, 7, 7, None, 90, 91], id=("int", 1), print=("string", "p"), u=("int", 2), known=("int", 3))
    got = {(r.doc_id, r.print): r.component_id for r in simhash.near_duplicates(df).collect()}
    assert {v for (i, _), v in got.items() if i is not None and 10 <= i < 40} == {10}
    assert {v for (i, _), v in got.items() if i in (5, 7)} == {5}  # 7 has the texts b and c
    assert [v for (i, _), v in got.items() if i is None] == [None]
    assert got[90, 0] == got[91, 0] == 90
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        simhash.near_duplicates(df, near=5)
