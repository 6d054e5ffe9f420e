"""Near-duplicate documents by SimHash fingerprints, joined by Golay-code fuzzy hashing.

A fingerprint of 64 bits falls into three segments of 22, 21 and 21 bits. If two fingerprints differ in at
most four bits, two of the three segments differ in at most two bits each. Segments are words of 23 bits
(with zeros) under the perfect binary Golay code, whose 4,096 codewords have every word within three bits: the
word halfway between two words two bits apart is within three bits of a codeword, which is within four
bits of both. So each segment is decoded to all codewords within four bits, one or six of
them, and two segments that differ in two bits or less share a codeword. The keys of a fingerprint are the
pairs of codeword indices of two segments, 85 on average out of three times 2^24.

Distinct fingerprints alone are joined, so copies cost nothing. Those under one key are compared with
each other: a fingerprint linked to one before is visited from there and not compared again, so a
cluster costs about one comparison each and gives a spanning forest, not all pairs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from panelwright.llm.linked import components
from panelwright.llm.scratch import looked_up, written
from panelwright.llm.tokens import mix

U = np.uint64
SHINGLE, SEED = 4, 42
#: Differing bits up to which fingerprints link; the segments are laid out for no more.
NEAR = 4
#: Bytes of a long text that are hashed at a time.
PIECE = 1 << 20
#: The Golay code's generator polynomial (a fixed value), its word length and check bits.
GENERATOR, LENGTH, CHECK = 0b110001110101, 23, 11
#: First bit and bits of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
KEY_SPACE = 3 << 24
#: Keys of one part, about, which one task holds (12 bytes each).
PART_KEYS = 1_000_000
#: Fingerprints under one key up to which neighbours are compared side by side for all keys at once.
FEW = 32
_WHITE = re.compile(rb"[\x20\x09-\x0D]")


def _remainders() -> np.ndarray:
    """Of each power of x up to 22, the remainder by the generator."""
    out = [1]
    for _ in range(LENGTH - 1):
        up = out[-1] << 1
        out.append(up ^ GENERATOR if up >> CHECK else up)
    return np.array(out, np.int64)


def _golay() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and of the high 11 bits; per syndrome the error patterns of up to four bits and their number."""
    power = _remainders()

    def syndromes(bits: np.ndarray) -> np.ndarray:
        on = np.arange(1 << len(bits))[:, None] >> np.arange(len(bits)) & 1
        return np.bitwise_xor.reduce(on * bits, axis=1)

    patterns, count = np.zeros((1 << CHECK, 6), np.int64), np.zeros(1 << CHECK, np.int64)
    for weight in range(NEAR + 1):
        for bits in combinations(range(LENGTH), weight):
            s = np.bitwise_xor.reduce(power[list(bits)], initial=0)
            # Nearer codewords than three bits have none at four; at three there are five more at four.
            patterns[s, count[s]] = sum(1 << b for b in bits)
            count[s] += 1
    return syndromes(power[:12]), syndromes(power[12:]), patterns, count


_LOW, _HIGH, _PATTERNS, _COUNT = _golay()


def codewords(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices (12 bits) of the codewords within four bits of each word of 23 bits: a row of six, and which of them count."""
    syndrome = _LOW[words & 4095] ^ _HIGH[words >> 12]
    return (words[:, None] ^ _PATTERNS[syndrome]) >> CHECK, np.arange(6) < _COUNT[syndrome][:, None]


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All keys (26 bits) of the fingerprints, and the number of the fingerprint of each."""
    index, holds = zip(*(codewords((prints >> U(first)).astype(np.int64) & ((1 << size) - 1)) for first, size in SEGMENTS), strict=True)
    out, of = [], []
    for pair, (i, j) in enumerate(combinations(range(3), 2)):
        key = (pair << 24) | (index[i][:, :, None] << 12) | index[j][:, None, :]
        both = holds[i][:, :, None] & holds[j][:, None, :]
        out.append(key[both])
        of.append(np.nonzero(both)[0])
    return np.concatenate(out).astype(np.uint32), np.concatenate(of)


def _blocks_of(data: bytes) -> Iterator[bytes]:
    """The text in blocks that end at white space."""
    low = 0
    while low < len(data):
        cut = _WHITE.search(data, min(low + PIECE, len(data)))
        high = cut.start() if cut else len(data)
        yield data[low:high]
        low = high


def simhash(text: bytes | None, width: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text (UTF-8): a bit is 1 if it is in over half of the shingles' hashes, repeats counted."""
    ones, n, held = np.zeros(64, np.int64), 0, []
    for block in _blocks_of((text or b"").lower()):  # bytes: A-Z alone
        held += block.split()
        if len(held) < width:
            continue
        size = np.fromiter(map(len, held), np.int64, len(held))
        end = np.cumsum(size + 1) - 1
        joined = b" ".join(held)
        spans = zip((end - size).tolist(), end[width - 1 :].tolist(), strict=False)
        hashes = np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in spans), U, len(held) - width + 1)
        for low in range(0, len(hashes), 1 << 16):
            ones += np.unpackbits(hashes[low : low + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        n += len(hashes)
        held = held[len(held) - width + 1 :]
    if not n:
        return xxh64_intdigest(b" ".join(held), SEED) if held else 0
    return int(np.packbits(2 * ones > n).view(U)[0])


def _prints(width: int):
    def run(batches):
        for rows in batches:
            texts = rows.column("text").cast(pa.large_binary())
            found = np.fromiter((simhash(t.as_py(), width) for t in texts), U, len(texts))
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(found.view(np.int64))], names=["id", "print"])

    return run


def _keyed(parts: int, flush: int = 1 << 14):
    """The keys of the fingerprints, packed for each part of the key space."""

    def run(batches):
        for rows in batches:
            prints = rows.column("print").to_numpy().view(U)
            for low in range(0, len(prints), flush):
                here = prints[low : low + flush]
                key, of = keys(here)
                part = ((mix(key.astype(U)) >> U(32)) * U(parts)) >> U(32)
                order = np.argsort(part, kind="stable")
                key, held, part = key[order], here[of[order]], part[order]
                cut = np.r_[np.flatnonzero(np.r_[True, part[1:] != part[:-1]]), len(part)]
                names = part[cut[:-1]].astype(np.int64)
                packed = [[x[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)] for x in (key, held)]
                yield pa.RecordBatch.from_arrays([pa.array(names), *(pa.array(p, pa.binary()) for p in packed)], names=["part", "keys", "prints"])

    return run


def _forest(prints: np.ndarray, near: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that join whatever links reach among the distinct fingerprints; each is reached once."""
    while len(prints) > 1:
        open_, prints = [prints[0]], prints[1:]
        while open_ and len(prints):
            x = open_.pop()
            hit = np.bitwise_count(prints ^ x) <= near
            if hit.any():
                yield np.full(hit.sum(), x), prints[hit]
                open_.extend(prints[hit])
                prints = prints[~hit]


def links_under_keys(key: np.ndarray, prints: np.ndarray, near: int) -> np.ndarray:
    """Links ``(u, v)``, u < v, that join what is linked under each key."""
    order = np.lexsort((prints, key))
    key, prints = key[order], prints[order]
    cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[cut, len(key)])
    found = [np.empty((0, 2), U)]
    here = np.flatnonzero(np.repeat((size > 1) & (size <= FEW), size))
    for step in range(1, FEW):
        here = here[here + step < len(key)]
        here = here[key[here + step] == key[here]]
        if not len(here):
            break
        linked = here[np.bitwise_count(prints[here] ^ prints[here + step]) <= near]
        found.append(np.stack([prints[linked], prints[linked + step]], 1))
    for k in np.flatnonzero(size > FEW):
        for u, v in _forest(prints[cut[k] : cut[k] + size[k]], near):
            found.append(np.stack([np.minimum(u, v), np.maximum(u, v)], 1))
    return np.unique(np.concatenate(found), axis=0)


def _linked(near: int):
    def run(batches):
        def solve():
            key, held = np.frombuffer(b"".join(k for k, _ in packed), np.uint32), np.frombuffer(b"".join(p for _, p in packed), U)
            found = links_under_keys(key, held, near).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])

        packed, last = [], None
        for rows in batches:
            for part, k, p in zip(*(rows.column(c).to_pylist() for c in ("part", "keys", "prints")), strict=True):
                if part != last and packed:
                    yield solve()
                    packed = []
                packed.append((k, p))
                last = part
        if packed:
            yield solve()

    return run


def near_fingerprints(prints: DataFrame, near: int = NEAR) -> DataFrame:
    """Links ``(u, v)``, u < v as unsigned numbers, that join all of the distinct fingerprints ``print`` that links of at most ``near`` bits reach."""
    if not 0 <= near <= NEAR:
        raise ValueError(f"fingerprints link at 0 to {NEAR} bits")
    spark = prints.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 85 * prints.count() // PART_KEYS)
    keyed = prints.select("print").mapInArrow(_keyed(parts), "part long, keys binary, prints binary")
    dealt = keyed.repartition(parts, "part").sortWithinPartitions("part")
    return written(dealt.mapInArrow(_linked(near), "u long, v long").distinct(), "links")


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = SHINGLE, near: int = NEAR) -> DataFrame:
    """``(doc_id, print, component_id)`` of each row, all long; ``print`` holds the fingerprint's 64 bits.

    Words are runs without white space, A-Z taken as a-z; fewer than ``width`` words are one shingle, and a
    text without words (null, empty or white space) has fingerprint zero, which links as any other.
    ``component_id`` is the least id that links of at most ``near`` differing bits reach, itself
    included. Rows that share an id are one node with the links of all of them. A row with a null
    id is returned with its fingerprint and a null component, and links nothing. Equal texts have equal
    fingerprints, so ties and repeated rows are one class. Other columns, whatever
    their names, are not read; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    found = written(rows.mapInArrow(_prints(width), "id long, print long"), "prints")
    named = found.where("id is not null")
    classes = written(named.groupBy("print").agg(F.min("id").alias("least"), F.count("*").alias("copies")), "classes")
    links = near_fingerprints(classes, near)
    for side in ("u", "v"):
        links = links.join(classes.select(F.col("print").alias(side), F.col("least").alias(f"{side}_id")), side)
    links = links.select(F.col("u_id").alias("u"), F.col("v_id").alias("v"))
    # An id with several texts ties their classes together.
    tied = named.groupBy("id").agg(F.min("print").alias("a"), F.max("print").alias("b")).where("a != b").select("id")
    tied = named.join(tied, "id").join(classes, "print").select(F.col("id").alias("u"), F.col("least").alias("v"))
    linked = components(links.unionByName(tied))
    of_class = classes.join(linked, classes["least"] == linked["node"], "left")
    of_class = written(of_class.select("print", "copies", F.coalesce("component", "least").alias("component_id")), "classes")
    return looked_up(found, of_class, ["print"], found.count()).select(F.col("id").alias("doc_id"), "print", F.when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"))
