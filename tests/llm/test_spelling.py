import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from panelwright.llm import spelling
from texts import FOLD, SCHEMA, corpus, odd_texts


def counts(texts, ids):
    found = Counter()
    for i, t in zip(ids, texts, strict=True):
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(FOLD)
            h = crc32(f"{i}:{run}".encode())
            if i is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def forms(texts, ids):
    n = counts(texts, ids)
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {w: min(near[w], key=lambda v: (-n[v], v)) if near[w] else None for w in n}
    form = {w: v if v is not None and n[v] >= 2 * n[w] else None for w, v in form.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), n[w], len(near[w]), n.get(form[w]) or 0) for w in n)


def got(df, **names):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in spelling.spelling_forms(df, **names).collect())


def typo(rng, word):
    k, letter = int(rng.integers(0, len(word))), "abcéÿ"[rng.integers(0, 5)]
    return [word[:k] + word[k + 1 :], word[:k] + letter + word[k + 1 :], word[:k] + letter + word[k:], word + letter][rng.integers(0, 4)]


def texts_with_typos(rng, n):
    letters = list("abcdé")
    base = ["".join(rng.choice(letters, size)) for size in rng.integers(4, 12, 40)]
    out = []
    for _ in range(n):
        ws = []
        for w in rng.choice(base, 60):
            for _ in range(int(rng.integers(0, 3))):
                w = typo(rng, str(w)) if rng.random() < 0.3 and len(w) > 2 else w
            ws.append(str(w).capitalize() if rng.random() < 0.2 else str(w))
        out.append(" ".join(ws) + "... don't; ×÷ 12Ab\n")
    return out


def test_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    texts = texts_with_typos(rng, 90) + odd_texts()
    ids = [*range(len(texts) - 1), None]
    want = forms(texts, ids)
    assert got(corpus(spark, texts, ids)) == want
    assert sum(w[1] != "" for w in want) > 20


@pytest.mark.parametrize("piece", [1, 7, 64])
def test_long_texts_are_read_block_by_block(monkeypatch, piece):
    monkeypatch.setattr(spelling, "PIECE", piece)
    text = "straße éééé 世界 naïve÷x word’s ÀÿÃ " * 3 + "z" * 200
    low = text.encode().lower()
    assert spelling._runs(low) == Counter(r.encode() for r in re.findall(r"[a-zÀ-ÿ]+", low.decode()))


def test_every_kind_of_edit_at_every_place(spark):
    word = "abcdefghi"
    others = {word[:k] + "z" + word[k + 1 :] for k in range(9)} | {word[:k] + word[k + 1 :] for k in range(9)} | {word[:k] + "z" + word[k:] for k in range(10)}
    df = spark.createDataFrame([(w, 3) for w in [word, *sorted(others), "abcdefxyi", "aabcdefghii"]], "word string, n long")
    near = {r.other for r in spelling.near_words(df).where(f"word = '{word}'").collect()}
    assert near == others


def test_forms_lead_to_a_root_and_ties_go_to_the_first(spark):
    words = ["wordabc"] * 40 + ["wordab"] * 20 + ["worda"] * 10 + ["qwertyx"] * 6 + ["qwertyy"] * 6 + ["qwerty"] * 3 + ["Alone"] * 3 + ["rarely"] * 2
    df = corpus(spark, words, [None] * len(words), word=("string", "w"), n=("int", 1), root=("int", 2))
    found = {r[0]: r for r in got(df)}
    assert found["worda"][1:3] == ("wordab", "wordabc") and found["qwerty"][1] == "qwertyx" and found["qwertyx"][1] == ""
    assert found["alone"] == ("alone", "", "alone", 3, 0, 0) and "rarely" not in found
    assert got(spark.createDataFrame([], SCHEMA)) == []
