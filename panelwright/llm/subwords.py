"""Subword encoding by a merge vocabulary, with seeded merge-dropout, and its inverse.

A text begins with a word mark, spaces are word marks, and neighbouring symbols merge in the order of
the vocabulary's scores, leftmost first, as long as their string is a piece. With dropout each
candidate merge is skipped if a keyed hash of its place says so, so that one seed always gives the same pieces
and another seed others. Characters without a piece become bytes. Whatever is skipped, the
pieces spell the text, so decoding gives back every text exactly.

Pieces never hold a word mark after another character, so words are encoded one by one. Every occurrence of a word draws
its own skips, by a hash of seed, text and place. Equal words of a task are encoded once without skips, and
an occurrence takes that result if it skips none of the merges that made it, for then the merges are the same;
others are encoded one by one. Words are known by a hash; every block is decoded again at once, and one that
does not come out as it went in (two words of one hash) is encoded word by word. Short words are merged many at a time, one
merge of each a round; long ones by an agenda, with the same result.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.tokens import _power, mix, pieces, salt

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words of more characters go through the agenda.
LONG = 48
NONE = np.int32(2**31 - 1)
U = np.uint64


@dataclass
class Vocabulary:
    """Pieces, and the merges that make them, from the bytes of a model file."""

    names: list[str]
    chars: np.ndarray  # symbol of each code point; -1 - code point where no piece holds it
    pairs: list[np.ndarray]  # left * 2^32 + right of each merge, in tables by two hashes, and the rest sorted
    ranks: list[np.ndarray]  # of the piece that the pair makes
    made: np.ndarray  # piece of each rank
    bytes_: np.ndarray  # piece of each byte
    spelled: np.ndarray  # what all pieces spell, one after the other
    spell_at: np.ndarray
    extra: dict[int, str]  # symbols of characters that are no piece themselves


@lru_cache(maxsize=4)
def vocabulary(model: bytes) -> Vocabulary:
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    n = sp.get_piece_size()
    names = [sp.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    byte = {int(names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
    if len(byte) != 256:
        raise ValueError("the vocabulary has no piece for every byte")
    if any(a != MARK and b == MARK for i in plain for a, b in zip(names[i], names[i][1:], strict=False)):
        raise ValueError("a piece holds a word mark after another character")
    symbol = {names[i]: i for i in plain}
    extra = {}
    for i in plain:
        for c in names[i]:
            if c not in symbol:
                symbol[c] = n + len(extra)
                extra[symbol[c]] = c
    order = sorted((i for i in plain if len(names[i]) > 1), key=lambda i: (-sp.get_score(i), i))
    merges = {}
    for rank, i in enumerate(order):
        for cut in range(1, len(names[i])):
            left, right = symbol.get(names[i][:cut]), symbol.get(names[i][cut:])
            if left is not None and right is not None:
                merges[left << 32 | right] = rank
    chars = -1 - np.arange(0x110000, dtype=np.int32)
    for c, k in symbol.items():
        if len(c) == 1:
            chars[ord(c)] = k
    chars[32], chars[ord(MARK)] = symbol[MARK], -1 - ord(MARK)  # a mark in a text is not a space
    pairs, ranks = _tables(np.array(sorted(merges), np.int64), np.array([merges[k] for k in sorted(merges)], np.int32))
    spelled = [b""] * n
    for i in plain:
        spelled[i] = names[i].replace(MARK, " ").encode()
    for b, i in byte.items():
        spelled[i] = bytes([b])
    return Vocabulary(
        names,
        chars,
        pairs,
        ranks,
        np.array(order, np.int32),
        np.array([byte[b] for b in range(256)], np.int32),
        np.frombuffer(b"".join(spelled), np.uint8),
        np.cumsum([0, *map(len, spelled)]),
        extra,
    )


def _slot(pair: np.ndarray, table: int, bits: int) -> np.ndarray:
    return ((pair.view(U) * salt(47, table)) >> U(64 - bits)).astype(np.int64)


BITS = 18


def _tables(pairs: np.ndarray, ranks: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Two tables by hash, each slot with the first pair that falls there; what finds no slot stays sorted."""
    out = [], []
    for table in (0, 1):
        slot = _slot(pairs, table, BITS)
        first = np.unique(slot, return_index=True)[1]
        there, rank = np.full(1 << BITS, -1, np.int64), np.full(1 << BITS, NONE, np.int32)
        there[slot[first]], rank[slot[first]] = pairs[first], ranks[first]
        out[0].append(there)
        out[1].append(rank)
        left = np.ones(len(pairs), bool)
        left[first] = False
        pairs, ranks = pairs[left], ranks[left]
    return [*out[0], np.r_[pairs, np.iinfo(np.int64).max]], [*out[1], np.r_[ranks, NONE]]


def _rank(v: Vocabulary, pair: np.ndarray) -> np.ndarray:
    """Rank of the piece that each pair makes; ``NONE`` where it makes none."""
    rank = NONE
    for table in (0, 1):
        slot = _slot(pair, table, BITS)
        rank = np.minimum(rank, np.where(v.pairs[table][slot] == pair, v.ranks[table][slot], NONE))
    if len(v.pairs[2]) > 1:
        at = np.searchsorted(v.pairs[2], pair)
        rank = np.minimum(rank, np.where(v.pairs[2][at] == pair, v.ranks[2][at], NONE))
    return rank


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left.astype(np.int64) << 32) | right.astype(np.int64)


def _skipped(key, place: np.ndarray, pair: np.ndarray, skip: int) -> np.ndarray:
    """Whether the keyed hash skips the merge of a pair at a place."""
    return mix(mix(key + place.astype(U)) ^ pair.view(U)) < U(skip)


def _candidates(v: Vocabulary, left, right, place, key, skip: int) -> np.ndarray:
    """Rank of each merge; ``NONE`` if there is none or the keyed hash skips it."""
    pair = np.where((left >= 0) & (right >= 0), _pair(left, right), -2)
    rank = _rank(v, pair)
    if skip:
        here = rank != NONE
        key = np.broadcast_to(key, rank.shape)[here]
        rank[here] = np.where(_skipped(key, place[here], pair[here], skip), NONE, rank[here])
    return rank


def _together(v: Vocabulary, symbols: np.ndarray, key: np.ndarray, skip: int, made: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Merge the words in the rows of ``symbols`` (padded by the least int32); final symbols and their numbers.

    ``made`` gets row, place and pair of all merges.
    """
    pad = np.iinfo(np.int32).min
    n, width = symbols.shape
    done = np.full((n, width), pad, np.int32)
    row = np.arange(n)
    place = np.broadcast_to(np.arange(width, dtype=np.int32), (n, width)).copy()
    rank = _candidates(v, symbols[:, :-1], symbols[:, 1:], place[:, :-1], key[:, None], skip) if width > 1 else np.empty((n, 0), np.int32)
    cols = np.arange(width)
    while len(row) and width > 1:
        j = rank.argmin(1)
        best = rank[np.arange(len(row)), j]
        live = best != NONE
        if not live.all():
            done[row[~live]] = symbols[~live]
            row, symbols, place, rank, key, j, best = (x[live] for x in (row, symbols, place, rank, key, j, best))
            if not len(row):
                break
        r = np.arange(len(row))
        if made is not None:
            made.append((row, place[r, j], _pair(symbols[r, j], symbols[r, j + 1])))
        symbols[r, j] = v.made[best]
        later = np.minimum(cols + (cols[None, :] > j[:, None]), width - 1)
        symbols = np.take_along_axis(symbols, later, 1)
        place = np.take_along_axis(place, later, 1)
        symbols[:, -1] = pad
        rank = np.take_along_axis(rank, later[:, :-1].clip(max=max(width - 2, 0)), 1)
        rank[:, -1] = NONE
        for side in (j - 1, j):
            ok = (side >= 0) & (side < width - 1)
            rr, cc = r[ok], side[ok]
            rank[rr, cc] = _candidates(v, symbols[rr, cc], symbols[rr, cc + 1], place[rr, cc], key[rr], skip)
    if width == 1:
        done = symbols
    return done, (done != pad).sum(1)


def _agenda(v: Vocabulary, symbols: np.ndarray, key: np.uint64, skip: int) -> np.ndarray:
    """The same for one long word, by a queue of candidate merges."""
    s = symbols.tolist()
    n = len(s)
    after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    first = _candidates(v, symbols[:-1], symbols[1:], np.arange(n - 1), key, skip)
    queue = [(int(r), i, s[i], s[i + 1]) for i, r in enumerate(first) if r != NONE]
    heapq.heapify(queue)

    def add(i: int) -> None:
        if i >= 0 and after[i] < n:
            a, b = np.array([s[i]]), np.array([s[after[i]]])
            rank = _candidates(v, a, b, np.array([i]), key, skip)[0]
            if rank != NONE:
                heapq.heappush(queue, (int(rank), i, s[i], s[after[i]]))

    while queue:
        rank, i, a, b = heapq.heappop(queue)
        j = after[i]
        if not live[i] or s[i] != a or j >= n or s[j] != b:
            continue
        s[i], live[j], after[i] = int(v.made[rank]), False, after[j]
        if after[j] < n:
            before[after[j]] = i
        add(before[i])
        add(i)
    return np.array([x for x, there in zip(s, live, strict=True) if there], np.int32)


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions ``start[k] ... start[k] + size[k] - 1`` of all k, one after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _spelled_out(v: Vocabulary, ids: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols that are no pieces as the pieces of their bytes."""
    odd = np.flatnonzero((ids < 0) | (ids >= len(v.names)))
    if not len(odd):
        return ids, word
    kind, which = np.unique(ids[odd], return_inverse=True)
    made = [v.bytes_[list((v.extra[k] if k >= 0 else chr(-1 - k)).encode())] for k in kind.tolist()]
    size = np.ones(len(ids), np.int64)
    size[odd] = np.array([len(m) for m in made])[which]
    at = np.cumsum(size) - size
    out = np.repeat(ids, size)
    start = np.cumsum([0, *map(len, made)])
    out[_spread(at[odd], size[odd])] = np.concatenate(made)[_spread(start[which], size[odd])]
    return out, np.repeat(word, size)


class Known:
    """Pieces of the words met so far, by key, and the merges that made them; forgets them all beyond ``most``."""

    def __init__(self, most: int = 400_000) -> None:
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.key, self.begin, self.n, self.ids = np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32)
        self.from_, self.merges, self.place, self.pair = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64)

    def missing(self, key: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.key, key)
        return np.flatnonzero(self.key[np.minimum(at, len(self.key) - 1)] != key) if len(self.key) else np.arange(len(key))

    def add(self, key: np.ndarray, ids: np.ndarray, n: np.ndarray, made: tuple) -> None:
        """``key`` in order; ``made``: word, place and pair of each merge, by word."""
        at = np.searchsorted(self.key, key)
        merges = np.bincount(made[0], minlength=len(key))
        self.begin = np.insert(self.begin, at, len(self.ids) + np.cumsum(n) - n)
        self.from_ = np.insert(self.from_, at, len(self.place) + np.cumsum(merges) - merges)
        self.n = np.insert(self.n, at, n)
        self.merges = np.insert(self.merges, at, merges)
        self.key = np.insert(self.key, at, key)
        self.ids = np.concatenate([self.ids, ids])
        self.place, self.pair = np.concatenate([self.place, made[1]]), np.concatenate([self.pair, made[2]])


def _encoded(v: Vocabulary, symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, draw: np.ndarray, skip: int, merges: bool = False) -> tuple:
    """Pieces of the words ``symbols[begin[k] : begin[k] + size[k]]``, how many each has, and word, place and pair of the merges."""
    pad = np.iinfo(np.int32).min
    ids, words, made = [], [], [(np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int64))]
    for low, high in ((0, 4), (4, 8), (8, 16), (16, LONG)):
        pick = np.flatnonzero((size > low) & (size <= high))
        for part in np.array_split(pick, len(pick) // 30_000 + 1):
            if len(part):
                cols = np.arange(high)
                grid = symbols[np.minimum(begin[part][:, None] + cols, len(symbols) - 1)]
                grid = np.where(cols < size[part][:, None], grid, pad).astype(np.int32)
                steps = [] if merges else None
                done, n = _together(v, grid, draw[part], skip, steps)
                ids.append(done[done != pad])
                words.append(np.repeat(part, n))
                made += [(part[row], place, pair) for row, place, pair in steps or []]
    for k in np.flatnonzero(size > LONG):
        found = _agenda(v, symbols[begin[k] : begin[k] + size[k]], draw[k], skip)
        ids.append(found)
        words.append(np.full(len(found), k))
    ids, words = _spelled_out(v, np.concatenate([*ids, np.empty(0, np.int32)]), np.concatenate([*words, np.empty(0, np.int64)]))
    order = np.argsort(words, kind="stable")
    made = [np.concatenate([m[k] for m in made]) for k in range(3)]
    by = np.argsort(made[0], kind="stable")
    return ids[order], np.bincount(words, minlength=len(size)), tuple(m[by] for m in made)


def encode_block(v: Vocabulary, data: np.ndarray, at: np.ndarray, named: np.ndarray, dropout: float, seed: int, known: Known | None = None, apart: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of all texts of a block, and where each text's begin; ``named`` is a hash of each text.

    ``apart`` takes no two words for equal; every occurrence draws for itself anyway.
    """
    if not len(data):
        return np.empty(0, np.int32), np.zeros(len(at), np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int64)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    at = lead[at]
    full = np.diff(at) > 0
    points = np.insert(points, at[:-1][full], 32)  # the word mark before each text
    at = at + np.r_[0, np.cumsum(full)]
    begins = np.r_[True, (points[1:] == 32) & (points[:-1] != 32)]
    begins[at[:-1][full]] = True
    start = np.flatnonzero(begins)
    size = np.diff(np.r_[start, len(points)])
    first = np.searchsorted(start, at)

    power, inverse = _power(len(points) + 1)
    sums = np.zeros(len(points) + 1, U)
    np.cumsum(mix(points.astype(U) + U(1)) * power[: len(points)], out=sums[1:])
    word = mix((sums[start + size] - sums[start]) * inverse[start] + size.astype(U))
    skip = int(dropout * 2**64) if dropout < 1 else 2**64 - 1
    count = np.diff(first)
    nth = np.arange(len(word)) - np.repeat(first[:-1], count)
    draw = mix(mix(np.repeat(named, count) + salt(seed) + nth.astype(U)) + salt(seed, 1))
    symbols = v.chars[points]
    if apart:
        ids, n, _ = _encoded(v, symbols, start, size, draw, skip)
        return ids, np.r_[0, np.cumsum(n)][first]
    known = Known() if known is None else known
    key, where, which = np.unique(word, return_index=True, return_inverse=True)
    if len(known.key) + len(key) > known.most:
        known.forget()
    new = known.missing(key)
    known.add(key[new], *_encoded(v, symbols, start[where[new]], size[where[new]], draw[where[new]], 0, merges=skip > 0))
    at_key = np.searchsorted(known.key, key)[which]
    n, begin, from_ = known.n[at_key], known.begin[at_key], known.ids
    if skip:
        merges = known.merges[at_key]
        of, step = np.repeat(np.arange(len(word)), merges), _spread(known.from_[at_key], merges)
        other = size > LONG  # their merges are not kept
        other[of[_skipped(draw[of], known.place[step], known.pair[step], skip)]] = True
        other = np.flatnonzero(other)
        own, n_own, _ = _encoded(v, symbols, start[other], size[other], draw[other], skip)
        n[other], begin[other] = n_own, len(from_) + np.cumsum(n_own) - n_own
        from_ = np.concatenate([from_, own])
    return from_[_spread(begin, n)], np.r_[0, np.cumsum(n)][first]


def decode_block(v: Vocabulary, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes that the pieces spell, and where each text begins, without the word mark before each text."""
    size = np.diff(v.spell_at)[ids]
    data = v.spelled[_spread(v.spell_at[ids], size)]
    at = np.r_[0, np.cumsum(size)][at]
    mark = (np.diff(at) > 0) & (data[np.minimum(at[:-1], max(len(data) - 1, 0))] == 32) if len(data) else np.zeros(len(at) - 1, bool)
    keep = np.ones(len(data), bool)
    keep[at[:-1][mark]] = False
    return data[keep], at - np.r_[0, np.cumsum(mark)]


def _model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, text: str = "text", model: str = MODEL, dropout: float = 0.1, seed: int = 1, spelled: bool = False) -> DataFrame:
    """``(row, ids)``: each row of ``docs`` as a struct without its text, and the pieces of the whole text.

    ``dropout`` is the share of candidate merges that are skipped: 0 gives the vocabulary's usual
    segmentation, 1 single characters. The same seed and text give the same pieces wherever the
    text stands, so repeated rows get equal results. An empty text has no pieces, a null text
    null. ``model`` is read on the driver and sent to the tasks (a vocabulary is of fixed size).
    With ``spelled`` a column ``text`` holds what the pieces decode to, made in the same pass.
    Texts are valid UTF-8, as Spark's strings are. Other columns may be null and have any name.
    """
    proto = _model(model)

    def run(batches):
        v, known = vocabulary(proto), Known()
        for rows, data, at in pieces(batches, "text"):
            power, inverse = _power(len(data) + 1)
            sums = np.r_[np.zeros(1, U), np.cumsum(mix(data.astype(U) + U(1)) * power[: len(data)])]
            named = mix((sums[at[1:]] - sums[at[:-1]]) * inverse[at[:-1]])
            ids, cuts = encode_block(v, data, at, named, dropout, seed, known=known)
            again, at_again = decode_block(v, ids, cuts)
            if not (np.array_equal(again, data) and np.array_equal(at_again, at)):
                ids, cuts = encode_block(v, data, at, named, dropout, seed, apart=True)
                known.forget()
                again, at_again = decode_block(v, ids, cuts)
            missing = rows.column("text").is_null()
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32()), mask=missing if missing.true_count else None)
            more = [_texts(again, at_again, missing)] if spelled else []
            yield pa.RecordBatch.from_arrays([rows.column("row"), lists, *more], names=["row", "ids", "text"][: 2 + spelled])

    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    bare = docs.select(F.struct(*(rest or [F.lit(None).alias("none")])).alias("row"), F.col(text).alias("text"))
    return bare.mapInArrow(run, f"row {bare.schema['row'].dataType.simpleString()}, ids array<int>" + ", text string" * spelled)


def _texts(data: np.ndarray, at: np.ndarray, missing: pa.Array) -> pa.Array:
    """Texts from their bytes; null where ``missing``."""
    texts = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes())])
    return pc.if_else(missing, pa.scalar(None, pa.string()), texts.cast(pa.large_string()).cast(pa.string()))


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """``(row, ids, text)`` of the result of :func:`encode`: the text that the pieces spell, null for null."""
    proto = _model(model)

    def run(batches):
        v = vocabulary(proto)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                rows = batch.slice(low, 512)
                column = rows.column("ids")
                size = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
                values = column.flatten().to_numpy(zero_copy_only=False)
                texts = _texts(*decode_block(v, values, np.r_[0, np.cumsum(size)]), column.is_null())
                yield pa.RecordBatch.from_arrays([rows.column("row"), column, texts], names=["row", "ids", "text"])

    return encoded.mapInArrow(run, f"row {encoded.schema['row'].dataType.simpleString()}, ids array<int>, text string")
