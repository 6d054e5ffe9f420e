import hashlib
import re

import numpy as np
from pyspark.sql import functions as F

from panelwright.llm import privacy
from texts import SCHEMA, corpus, odd_texts, words

PATTERNS = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def brute(text):
    out = []
    for kind, p in enumerate(PATTERNS):
        for m in p.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = (True, kind == 1 and all(int(x) <= 255 for x in m.group().split(".")), 12 <= len(digits) <= 19 and luhn(digits), 9 <= len(digits) <= 15)[kind]
            if ok:
                out.append((m.start(), kind, m.end()))
    return sorted(out)


def spans(df, column="entities", **limits):
    return {r.row.doc_id: [(s.start, s.kind, s.end) for s in r[column]] for r in privacy.personal_data(df, **limits).collect()}


def test_entities_equal_brute_force(spark):
    rng = np.random.default_rng(0)
    texts = ["a@b.com_x@c.de, q@w", "1.2.3.4.5.6.7.8 300.1.1.1 007.1.1.1 1.2.3", "é 4111 1111-1111 1111 41111111111111112 4111--1111", "+1 (988) 555-2485. +12 +1.2.3.4.5.6.7.8.9"]
    texts += ["".join(rng.choice(list("a1.@-+ 94(%_"), 200)) for _ in range(150)] + ["9" * 400, "a" * 5000 + "@", "4111111111111111 " * 700]
    texts += [t or "" for t in odd_texts()]
    df = corpus(spark, texts, entities=("string", "e"), spans=("int", 1), terms=("int", 2))
    assert spans(df) == {i: brute(t) for i, t in enumerate(texts)}


def test_base_hash_and_written_spans(spark):
    row = privacy.personal_data(corpus(spark, ["x a@b.cd 10.0.0.1"])).select(privacy.written_out(F.col("spans")).alias("s")).first()
    assert row.s == "email:2:8,ip:9:17" and len(hashlib.sha256(row.s.encode()).hexdigest()) == 64


def leaky(rng, n):
    return [f"{' '.join(words(rng, 12, 10**6))} Zanthor Quill {w} jo@mail.org {' '.join(words(rng, 12, 10**6))}" for w in words(rng, n, 10**6)]


def test_terms_that_disclose_an_entity_are_found(spark):
    rng = np.random.default_rng(1)
    texts = leaky(rng, 8) + [" ".join(words(rng, 30, 10**6)) for _ in range(40)]
    rows = {r.row.doc_id: r for r in privacy.personal_data(corpus(spark, texts)).collect()}
    for i in range(8):
        found = {s.value.lower() for s in rows[i].spans if s.kind == 4}
        assert found == {"zanthor", "quill"}
        assert "jo@mail.org" not in rows[i].clean and "Zanthor" not in rows[i].clean and "[EMAIL]" in rows[i].clean
    assert all(not rows[i].spans and rows[i].clean == texts[i] for i in range(8, 48))


def test_common_words_copies_and_near_copies_prove_nothing(spark):
    rng = np.random.default_rng(2)
    common = [f"{' '.join(words(rng, 8, 10**6))} usual {w} jo@mail.org {' '.join(words(rng, 8, 10**6))}" for w in words(rng, 6, 10**6)]
    common += [f"usual {' '.join(words(rng, 9, 10**6))}" for _ in range(200)]
    text = leaky(rng, 1)[0]
    near = [text + " " + w for w in words(rng, 20, 10**6)] + [text] * 20
    got = spans(corpus(spark, common + near), "spans")
    assert all(kind != 4 for s in got.values() for _, kind, _ in s)


def test_many_texts_and_a_fixed_label_take_no_disclosing_term_away(spark):
    rng = np.random.default_rng(3)
    texts = [f"{' '.join(words(rng, 30, 300))}\nName: Zanthor Quill Email: jo@mail.org\n{' '.join(words(rng, 30, 300))}" for _ in range(1000)]
    texts += [" ".join(words(rng, 60, 300)) for _ in range(2000)]
    rows = {r.row.doc_id: r for r in privacy.personal_data(corpus(spark, texts)).collect()}
    assert all({"zanthor", "quill"} <= {s.value.lower() for s in rows[i].spans if s.kind == 4} for i in range(1000))
    assert all(not rows[i].spans for i in range(1000, 3000))


def test_terms_anywhere_in_the_text_and_identifiers_are_found(spark):
    rng = np.random.default_rng(4)
    texts = []
    for i in range(8):
        far = [" ".join(words(rng, 60, 10**6)) for _ in range(3)]
        beside = "Quorra" if i == 0 else ""
        after = "" if i == 0 else "Quorra"
        texts.append(f"Zanthor\n\n{far[0]}\n\nstaff AB4711 {beside} jo@mail.org\n\n{far[1]} {after}\n\n{far[2]} Wu")
    texts += [" ".join(words(rng, 60, 10**6)) for _ in range(40)]
    got = {r.row.doc_id: r for r in privacy.personal_data(corpus(spark, texts)).collect()}
    for i in range(8):
        found = {s.value.lower() for s in got[i].spans if s.kind == 4}
        assert found == {"zanthor", "staff", "ab4711", "quorra", "wu"}
    assert all(not got[i].spans for i in range(8, 48))


def test_rare_words_that_meet_a_common_entity_by_chance_stay(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(words(rng, 40, 4000)) + (" info@mail.org" if k % 3 == 0 else "") for k in range(600)]
    got = spans(corpus(spark, texts), "spans")
    assert all(kind != 4 for s in got.values() for _, kind, _ in s)


def test_nulls_and_empty_tables(spark):
    rows = privacy.personal_data(corpus(spark, [None, None], [None, None])).collect()
    assert [(r.entities, r.spans, r.clean) for r in rows] == [([], [], "")] * 2
    assert privacy.personal_data(spark.createDataFrame([], SCHEMA)).count() == 0


def test_long_texts_with_many_matches_and_terms(spark):
    """Twenty thousand words: places are added up in blocks, and only the text's own terms are placed."""
    rng = np.random.default_rng(11)
    few = leaky(rng, 12)
    mails = " ".join(f"é {w}@mail{k}.org" for k, w in enumerate(words(rng, 9000, 10**6)))
    dots = "a@" + "b." * 20_000 + "c " + "1" * 60_000 + " 1.2.3" * 3000
    long = " ".join(words(rng, 20_000, 10**6)) + " Zanthor said jo@mail.org and Quill went Zanthor"
    texts = [*few, mails, dots, long]
    rows = {r.row.doc_id: r for r in privacy.personal_data(corpus(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert [(s.start, s.kind, s.end) for s in rows[i].entities] == brute(t)
    found = [long[s.start : s.end] for s in rows[14].spans]
    assert found == ["Zanthor", "jo@mail.org", "Quill", "Zanthor"]
    assert rows[14].clean.endswith(long[-48:].replace("Zanthor", "").replace("jo@mail.org", "[EMAIL]").replace("Quill", ""))
    assert rows[12].clean.count("[EMAIL]") == 9000 and len(rows[12].spans) == 9000


def test_overlapping_spans_count_once_in_blocks(spark):
    n = 1000
    text = "".join(chr(97 + k % 26) for k in range(4 * n)) + "é"
    given = [(4 * k, 4 * k + 5 if k % 3 == 0 else 4 * k + 2, str(k % 10)) for k in range(n)]
    df = spark.createDataFrame([(text, given), ("abc", [])], "text string, spans array<struct<start:int,end:int,put:string>>")
    want, at = "", 0
    for a, b, put in given:
        if a >= at:
            want += text[at:a] + put
            at = b
    got = [r.s for r in df.select(privacy.sanitised(F.col("text"), F.col("spans")).alias("s")).collect()]
    assert got == [want + text[at:], "abc"]
