"""Small corpora and brute-force versions for the tests of the corpus operators."""

import re

import numpy as np

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
BLANK = " \t\n\x0b\x0c\r"


def words(rng, n, vocabulary=400):
    return [f"w{k}" for k in rng.integers(0, vocabulary, n)]


def edited(rng, ws, n):
    out = list(ws)
    for k in rng.integers(0, len(out), n):
        out[k] = f"x{rng.integers(0, 10**6)}"
    return out


def corpus(spark, texts, ids=None, **extra):
    """Documents with these texts; further columns as ``name=(type, value)``."""
    ids = range(len(texts)) if ids is None else ids
    schema = SCHEMA + "".join(f", `{k}` {t}" for k, (t, _) in extra.items())
    more = [v for _, v in extra.values()]
    rows = [(i, t, "en", "s", None if t is None else len(t), *more) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, schema)


def shingles(text, width=5):
    ws = WORD.findall((text or "").translate(FOLD))
    if 0 < len(ws) < width:
        return frozenset([tuple(ws)])
    return frozenset(tuple(ws[i : i + width]) for i in range(len(ws) - width + 1))


def linked_components(texts, ids, percent=75):
    """Least id of each id's component, by comparing all pairs."""
    sets = {}
    for i, t in zip(ids, texts, strict=True):
        sets.setdefault(i, []).append(shingles(t))
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    names = sorted(sets)
    for a in names:
        for b in names:
            if a < b and any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i in names}


def without_shared_lines(texts, ids, documents=3, length=20):
    held = {}
    for i, t in zip(ids, texts, strict=True):
        for line in (t or "").split("\n"):
            key = line.strip(BLANK).translate(FOLD)
            if len(key) >= length and i is not None:
                held.setdefault(key, set()).add(i)
    out = []
    for i, t in zip(ids, texts, strict=True):
        lines = (t or "").split("\n")
        kept = []
        for line in lines:
            key = line.strip(BLANK).translate(FOLD)
            if i is None or len(held.get(key, ())) < documents or i == max(held[key]):
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def odd_texts():
    """Null, empty, white space, one word, a very long text, ties."""
    rng = np.random.default_rng(9)
    long = " ".join(words(rng, 30_000, 3000))
    return [None, "", " \t\n ", "Word", "Word", "a b c", "a b c", long, long, "ünïcödé ☃ ▁ text"]
