"""Spelling variants: words one edit apart, found by asymmetric q-chunks, and the forms they lead to.

Of two words one edit apart, one contributes its two disjoint halves as chunks, the other its positional
grams of a chunk's size. The edit touches one half at most, so the other half is a gram of the second word, at its
own place or, behind an insertion or deletion, one place aside: chunks and grams are joined on
text and length where the places are within one. The same holds within the half that may be touched: it
has two chunks again, one of which stays. So what is joined is a chunk and a chunk of the
other half, three quarters of a word, of which few words have the same. Whatever meets is tested by its
edit distance.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.scratch import written

#: The letters of a word as UTF-8 in lower case: a-z, and U+00C0 to U+00FF.
RUN = re.compile(rb"(?:[a-z]++|(?:\xc3[\x80-\xbf])++)++")
#: One of so many occurrences, by hash, loses a letter.
LOSES = 97
MIN_LETTERS, MIN_COUNT, RATIO = 5, 3, 2
#: Bytes of a long text that are searched at a time, and distinct words a task holds before it sends counts on.
PIECE, HELD = 1 << 20, 200_000


def _runs(data: bytes) -> Counter:
    """Counts of the runs of a text, a block at a time; a run is not cut."""
    found: Counter = Counter()
    low = 0
    while low < len(data):
        high = min(low + PIECE, len(data))
        if high < len(data):
            tail = RUN.match(data, high - (data[high] in range(0x80, 0xC0)))
            high = tail.end() if tail else high
        found.update(RUN.findall(data, low, high))
        low = high
    return found


def _spelled(run: bytes, prefix: int | None) -> bytes:
    """The run, or what it is without one letter where the hash of id and run says so."""
    h = 1 if prefix is None else crc32(run, prefix)
    if h % LOSES:
        return run
    letters = run.decode()
    k = h % len(letters)
    return (letters[:k] + letters[k + 1 :]).encode()


def _counted(batches):
    def sent():
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

    held: Counter = Counter()
    for rows in batches:
        texts = rows.column("text").cast(pa.large_binary())
        for id, text in zip(rows.column("id").to_pylist(), texts, strict=True):
            prefix = None if id is None else crc32(f"{id}:".encode())
            for run, n in _runs((text.as_py() or b"").lower()).items():  # bytes: A-Z alone
                if len(run) >= MIN_LETTERS:
                    held[_spelled(run, prefix)] += n
            if len(held) > HELD:
                yield sent()
                held = Counter()
    yield sent()


def spelled_words(docs: DataFrame, id: str, text: str) -> DataFrame:
    """``(word, n)`` of the words of at least five letters seen three times or more."""
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    found = rows.mapInArrow(_counted, "word string, n long").where(F.char_length("word") >= MIN_LETTERS)
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def _quarters(size: Column) -> list[tuple[Column, Column]]:
    """First place and end of the four quarters of a word of ``size`` letters, halves of its halves."""
    half = F.floor(size / 2)
    edges = [F.lit(0), F.floor(half / 2), half, half + F.floor((size - half) / 2), size]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _part(word: Column, low: Column, high: Column) -> Column:
    return F.substring(word, (low + 1).cast("int"), (high - low).cast("int"))


def _keys(word: Column, size: Column, other: Column) -> Column:
    """A key for each quarter that an edit may touch: the untouched half and the other half's untouched quarter.

    ``other`` is the length of the word that contributes chunks; behind the touched quarter the grams of ``word`` stand as
    many places aside as it is longer or shorter, one at most.
    """
    shift = size - other
    return F.array(
        *[
            F.xxhash64(other, F.lit(k), _part(word, F.lit(0), low), _part(word, high + shift, size))
            for k, (low, high) in enumerate(_quarters(other))
        ]
    )


def near_words(words: DataFrame) -> DataFrame:
    """``(word, n, other, other_n)``: all words of ``(word, n)`` and those exactly one insertion, deletion or replacement apart, both ways."""
    sized = words.select("word", "n", F.char_length("word").alias("size"))
    chunks = sized.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.explode(_keys(F.col("word"), F.col("size"), F.col("size"))).alias("key"))
    # The shorter word gives the grams; words of one length meet twice and count once.
    grams = F.concat(_keys(F.col("word"), F.col("size"), F.col("size")), _keys(F.col("word"), F.col("size"), F.col("size") + 1))
    pairs = sized.select("word", "n", "size", F.explode(grams).alias("key")).join(chunks, "key")
    longer = F.char_length("other") - F.col("size")
    pairs = pairs.where(((longer == 0) & (F.col("word") < F.col("other"))) | (longer == 1))
    pairs = pairs.where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n").distinct()
    back = pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))
    return pairs.unionByName(back)


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of the words with a form, by pointers that double their reach each round."""
    now = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = written(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = found.select("word", "root")
        if found.where("moved").isEmpty():
            return now


def spelling_forms(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``(word, form, root, n, n_near, form_n)`` of each word of five letters or more that occurs three times or more.

    Words are the runs of the letters A-Z, a-z and U+00C0 to U+00FF of whole texts, A-Z in lower case. A run
    whose hash with its id (CRC-32 of ``id:run``) is divisible by 97 loses the letter at that hash modulo its length;
    rows with a null id lose none. ``form`` is the most frequent near word (of equal ones the first in
    code-point order) if it occurs at least twice as often as the word; ``root`` is where forms lead, the
    word itself if nowhere. Null and empty texts have no words; repeated rows count as often as
    they occur. Other columns, whatever their names, are not read; an empty table gives an empty result.
    """
    words = written(spelled_words(docs, id, text), "words")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    found = words.join(near, "word", "left")
    taken = -F.col("best.less") >= RATIO * F.col("n")
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("best.form")).alias("form"), F.when(taken, -F.col("best.less")).alias("form_n"))
    found = written(found, "forms")
    roots = _roots(found.where("form is not null"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
