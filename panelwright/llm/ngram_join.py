"""Near-duplicate documents: an exact Jaccard join on word shingles by universe partition.

Two shingle sets of sizes a and b with Jaccard similarity of t % or more differ in at most
H = (100 - t)(a + b) / (100 + t) shingles. Sizes fall into bands [2^k, 2^(k+1)). In each band a
hash deals the universe of shingles into m segments. By the pigeonhole principle two similar sets agree
wholly in m - H segments or more, so a set need be indexed under H + 1 of its segment subsets
only, if both choose by one order of subsets. The order is by cost: subsets of many shingles are
rare and come first, small ones and empty ones last, where shingles that a thousandth of all texts
share do not count. A set is also indexed in the band below its own if a partner can be there.

Texts that meet under keys are tested against two of the keys' least texts, exactly, on the shingle sets; only
pairs whose numbers of shingles in each of some finer segments differ by H at most in all need that.
Where that leaves a key with several components, its texts meet again under the rarest of their shingles (a prefix
filter): shingles are ordered by the number of components that have them, and a set that is similar to one of another component has
t % of its shingles or more from the first they share on. A text with too many shingles that its component has alone
has no key then, as one that shares just a passage with many; a sample of the shingles shows most of those. Pairs between
components under one shingle are tested by size, place and counts, block by block within a task, and in full if these leave them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.linked import components
from panelwright.llm.scratch import drop, held_by, looked_up, shuffle_width, written
from panelwright.llm.tokens import mix, pieces, salt, shingles, word_hashes, words

U = np.uint64
#: Texts under one key, up to which equal lists of texts come once for all their keys.
WIDE = 256
#: Texts of a key that are compared in one task with those of one more block.
BLOCK = 2048
#: Entries of a key up to which neighbours are compared side by side for all keys at once, and bytes of entries a task holds, about.
FEW, HELD = 48, 8 << 20
#: Texts for each task, at least, where Python works on keys and pairs.
TEXTS = 2000
#: A key with more texts than this in one task is led by one of them elsewhere.
LOCAL = 256
#: Bytes of text for each part of the shingles that open texts share, about.
PART = 8 << 20
#: Share of the shingles that is looked at first, to see which open texts can be similar to others at all; and the mark of those that come last.
SAMPLE, LAST = 0.4, 0xFFFFFFFF
#: Entries of one list, so that no row grows with a key.
CHUNK = 4096
#: Ids and keys up to this number (16 bytes each) go to all executors to pick texts and segments; more are joined.
SMALL = 500_000
BANDS = 40
#: Share of texts that makes a shingle common, and how many are kept (their average size over the share bounds
#: their number; they steer costs, not results).
COMMON, MOST_COMMON = 0.001, 1_000_000


class Scheme:
    """Bands, segments and allocations for shingle sets at a similarity of ``percent``."""

    def __init__(self, percent: int, deletions: bool = False, common: np.ndarray | None = None, shut: np.ndarray | None = None) -> None:
        self.common = np.empty(0, U) if common is None else common
        self.shut = np.empty(0, U) if shut is None else shut
        if not 50 <= percent <= 100:
            raise ValueError("the similarity must be 50 to 100 percent")
        self.percent, self.deletions = percent, deletions
        high = 2 ** np.arange(1, BANDS + 1, dtype=np.int64) - 1
        need = self.differences(high, 100 * high // percent) + 1
        self.segments = (need + 1) // 2 if deletions else need + np.maximum(1, 35 * need // 100)

    def differences(self, a, b):
        return (100 - self.percent) * (a + b) // (100 + self.percent)

    def keys(self, hashes: np.ndarray, of: np.ndarray, size: np.ndarray, costly: np.ndarray, parts: int, every: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Keys, their text numbers, and texts that costly keys may hide.

        ``hashes`` are distinct shingles ``of`` the texts with set sizes ``size``. Texts are not indexed under
        keys in ``shut`` and, :func:`tagged` with their text, in ``costly``; ``every`` gives the keys of all segments.
        """
        own = np.frexp(np.maximum(size, 1).astype(float))[1].astype(np.int64) - 1
        low = np.left_shift(1, own)
        least = -(-self.percent * size // 100)
        for below in (0, 1):
            there = (size > 0) & (own >= below) & ((below == 0) | (least < low))
            if not there.any():
                continue
            band = np.maximum(own - below, 0)
            partner = np.where(below, low - 1, 100 * size // self.percent)
            need = self.differences(size, partner) + 1
            count = np.where(there, self.segments[band], 0)
            base = np.cumsum(count) - count
            taken = there[of]
            h, t = hashes[taken], of[taken]
            dealt = mix(h + salt(7) * (band[t].astype(U) + U(1)))
            at = base[t] + (((dealt >> U(32)) * count[t].astype(U)) >> U(32)).astype(np.int64)
            element = mix(h ^ salt(11))
            sums = np.zeros(count.sum(), U)
            np.add.at(sums, at, element)
            text = np.repeat(np.arange(len(size)), count)
            segment = (np.arange(len(sums)) - base[text]).astype(U)
            named = mix(segment * salt(13) + band[text].astype(U) * salt(17) + U(self.deletions))
            key = _placed(mix(sums + named), parts)
            if self.deletions:
                yield key, text, np.empty(0, np.int64)
                yield _placed(mix(sums[at] - element + named[at]), parts), t, np.empty(0, np.int64)
                continue
            if every:
                yield key, text, np.empty(0, np.int64)
                continue
            held = np.bincount(at[~np.isin(h, self.common)], minlength=len(sums))
            order = (U(255) - np.minimum(held, 255).astype(U) << U(56)) | (key >> U(8))
            left, hidden = np.arange(len(sums)), np.empty(0, np.int64)
            if len(costly) or len(self.shut):
                shut = np.isin(tagged(key, text), costly) | np.isin(key, self.shut)
                left = np.flatnonzero(~shut)
                hidden = np.flatnonzero(there & (np.bincount(text[shut], minlength=len(size)) > count - need))
            left = left[np.lexsort((order[left], text[left]))]
            first = np.searchsorted(text[left], np.arange(len(size)))
            rank = np.arange(len(left)) - first[text[left]]
            left = left[rank < need[text[left]]]
            yield key[left], text[left], hidden


def tagged(keys: np.ndarray, texts: np.ndarray) -> np.ndarray:
    return mix(keys + mix(texts.astype(U)))


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, with their text numbers; and the set sizes."""
    start, end, first = words(data, at)
    hashes, of = shingles(word_hashes(data, start, end), first, width)
    cuts = np.searchsorted(of, np.arange(len(at)))
    out = [np.unique(hashes[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    size = np.fromiter(map(len, out), np.int64, len(out))
    return np.concatenate([*out, np.empty(0, U)]), np.repeat(np.arange(len(out)), size), size


def _digests(hashes: np.ndarray, of: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for k in (19, 23):
        total = np.zeros(len(size), U)
        np.add.at(total, of, mix(hashes ^ salt(k)))
        out.append(mix(total + size.astype(U)).view(np.int64))
    return out[0], out[1]


def _ids(rows: pa.RecordBatch) -> np.ndarray:
    return rows.column("id").to_numpy(zero_copy_only=False).astype(np.int64)


def _spread_counts(hashes: np.ndarray, of: np.ndarray, size: np.ndarray) -> list[bytes]:
    """How many shingles of each set fall into each of 2^k segments, k by the set's size; a byte each, up to 255."""
    bits = np.maximum(np.frexp(np.maximum(size, 1).astype(float))[1].astype(np.int64) - 1, 3)
    segments = np.left_shift(1, bits)
    base = np.cumsum(segments) - segments
    place = mix(hashes ^ salt(43)) >> (64 - bits).astype(U)[of]
    counts = np.minimum(np.bincount(base[of] + place.astype(np.int64), minlength=segments.sum()), 255).astype(np.uint8)
    return [counts[a : a + n].tobytes() for a, n in zip(base.tolist(), segments.tolist(), strict=True)]


def _may_agree(percent: int):
    """Pairs that the counts do not rule out: two sets differ by no less than their counts do."""

    def run(batches):
        for rows in batches:
            keep = []
            for a, b, x, y in zip(*(rows.column(c).to_pylist() for c in ("n_u", "n_v", "counts_u", "counts_v")), strict=True):
                x, y = (np.frombuffer(z, np.uint8).astype(np.int64) for z in (x, y))
                while len(x) != len(y):  # neighbouring segments are one at half the number
                    x, y = (x, np.minimum(y.reshape(-1, 2).sum(1), 255)) if len(x) < len(y) else (np.minimum(x.reshape(-1, 2).sum(1), 255), y)
                keep.append(int(np.abs(x - y).sum()) * (100 + percent) <= (100 - percent) * (a + b))
            yield rows.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


class _Entries:
    """Sets under keys, row by row: group, side, id, component, n, rest (shingles from the key on), and counts by segment."""

    def __init__(self, batches: list[pa.RecordBatch]) -> None:
        rows = pa.Table.from_batches(batches).combine_chunks()
        name = [rows.column(c).to_numpy() for c in ("bucket", "low", "high")]
        new = np.r_[True, np.any([x[1:] != x[:-1] for x in name], axis=0)]
        self.group = np.cumsum(new)
        self.start = np.r_[np.flatnonzero(new), len(new)]
        self.single = name[1] == name[2]
        self.side, self.ids, self.component, self.n, self.rest = (rows.column(c).to_numpy() for c in ("side", "id", "component", "n", "rest"))
        counts = rows.column("counts").cast(pa.large_binary()).combine_chunks()
        counts = counts.chunk(0) if isinstance(counts, pa.ChunkedArray) else counts
        at = np.frombuffer(counts.buffers()[1], np.int64)[counts.offset : counts.offset + len(counts) + 1]
        data = np.frombuffer(counts.buffers()[2], np.uint8)
        self.wide = np.diff(at)
        self.place = np.zeros(len(at) - 1, np.int64)
        self.grids = {}
        for w in np.unique(self.wide).tolist():
            here = np.flatnonzero(self.wide == w)
            self.place[here] = np.arange(len(here))
            self.grids[w] = data[at[here][:, None] + np.arange(w)]

    def counts(self, x: np.ndarray, wide: int) -> np.ndarray:
        """Counts of the rows ``x``, all of one width, in ``wide`` segments: neighbouring ones are one at half the number."""
        own = self.grids[int(self.wide[x[0]])][self.place[x]]
        return own if own.shape[1] == wide else np.minimum(own.reshape(len(x), wide, -1).sum(2, dtype=np.int32), 255)

    def may_agree(self, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        """Whether counts leave pairs of rows a chance: two sets differ by no less than their counts do."""
        out = np.zeros(len(x), bool)
        for a in np.unique(self.wide[x]).tolist():
            for b in np.unique(self.wide[y]).tolist():
                here = np.flatnonzero((self.wide[x] == a) & (self.wide[y] == b))
                wide = min(a, b)
                step = max(1, (4 << 20) // wide)
                for low in range(0, len(here), step):
                    k = here[low : low + step]
                    gap = np.abs(self.counts(x[k], wide).astype(np.int16) - self.counts(y[k], wide)).sum(1, dtype=np.int64)
                    out[k] = gap * (100 + percent) <= (100 - percent) * (self.n[x[k]] + self.n[y[k]])
        return out

    def near(self, x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
        """Whether rows of one key are in different components, on different sides, near enough in size, and could be similar if it is the first they share."""
        apart = (self.component[x] != self.component[y]) & (self.single[x] | (self.side[x] != self.side[y]))
        apart &= 100 * np.minimum(self.n[x], self.n[y]) >= percent * np.maximum(self.n[x], self.n[y])
        return apart & ((100 + percent) * np.minimum(self.rest[x], self.rest[y]) >= percent * (self.n[x] + self.n[y]))

    def odd(self, x: np.ndarray, wide: int) -> np.ndarray | None:
        """Which counts of the rows are odd, packed into words; None where a count is held at 255, which may be either."""
        grid = self.counts(x, wide)
        if (grid >= 255).any():
            return None
        bits = np.packbits((grid & 1).astype(bool), axis=1)
        return np.ascontiguousarray(np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))).view(U)

    def of_large(self, low: int, high: int, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a key with many rows. Sets differ by no less than the number of counts of which just one is odd, which a few words tell."""
        rows = np.arange(low, high)
        kinds = [rows[self.wide[rows] == w] for w in np.unique(self.wide[rows])]
        parts = [k[i : i + 512] for k in kinds for i in range(0, len(k), 512)]
        for i, p in enumerate(parts):
            for q in parts[i:]:
                wide = int(min(self.wide[p[0]], self.wide[q[0]]))
                x, y = np.repeat(p, len(q)), np.tile(q, len(p))
                fits = self.near(x, y, percent)
                one, two = self.odd(p, wide), self.odd(q, wide)
                if one is not None and two is not None and fits.any():
                    least = np.zeros((len(p), len(q)), np.int64)
                    for k in range(one.shape[1]):
                        least += np.bitwise_count(one[:, k][:, None] ^ two[:, k][None, :])
                    fits &= least.ravel() * (100 + percent) <= (100 - percent) * (self.n[x] + self.n[y])
                yield x[fits], y[fits]

    def pairs(self, percent: int, few: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of pairs that sizes and counts do not rule out, each once; of two components ``few`` at most, if given, and whether there are more."""
        found = []
        size = np.diff(self.start)
        here = np.flatnonzero(np.repeat(size <= FEW, size))
        for step in range(1, FEW):
            here = here[here + step < len(self.group)]
            here = here[self.group[here + step] == self.group[here]]
            if not len(here):
                break
            fits = self.near(here, here + step, percent)
            found.append((here[fits], here[fits] + step))
        for k in np.flatnonzero(size > FEW):
            found += self.of_large(self.start[k], self.start[k + 1], percent)
        x, y = (np.concatenate([f[k] for f in found] + [np.empty(0, np.int64)]) for k in (0, 1))
        u, v = np.minimum(self.ids[x], self.ids[y]), np.maximum(self.ids[x], self.ids[y])
        _, once = np.unique(np.stack([u, v], 1), axis=0, return_index=True)
        fits = once[self.may_agree(x[once], y[once], percent)]
        if few is not None:
            c = np.sort(np.stack([self.component[x[fits]], self.component[y[fits]]], 1), axis=1)
            order = np.lexsort((c[:, 1], c[:, 0]))
            new = np.r_[True, np.any(c[order][1:] != c[order][:-1], axis=1)][: len(order)]
            rank = np.arange(len(order)) - np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
            # The last pair of two components that have more says so.
            more = (rank == few - 1) & np.r_[(rank[1:] == few), False][: len(order)]
            fits, more = fits[order[rank < few]], more[rank < few]
        else:
            more = np.zeros(len(fits), bool)
        return u[fits], v[fits], more


def _apart(percent: int, few: int | None):
    """Pairs of a key's sets in different components that sizes and counts do not rule out; with ``few``, some of two components.

    Rows ``(bucket, low, high, side, id, component, n, rest, counts)`` come pair of blocks by pair of blocks; of two blocks
    only texts of different sides are compared. No pair leaves the task but those found.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _Entries(held).pairs(percent, few)], names=["u", "v", "more"])

        held, size = [], 0
        for rows in batches:
            if not rows.num_rows:
                continue
            held.append(rows)
            size += rows.nbytes
            if size > HELD:
                # The last key may go on in the next batch.
                rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                name = [rows.column(c).to_numpy() for c in ("bucket", "low", "high")]
                cut = int(np.flatnonzero(np.r_[True, np.any([x[1:] != x[:-1] for x in name], axis=0)])[-1])
                if cut:
                    yield out([rows.slice(0, cut)])
                held, size = [rows.slice(cut)], rows.slice(cut).nbytes
        if held:
            yield out(held)

    return run


_SIZES = "id long, n long, d1 long, d2 long, counts binary, texts long, common array<struct<shingle:long,texts:long>>"


def _sizes(width: int, block: int = 3_000_000):
    """A row for each text; and one for each block of shingles with the common ones among them."""

    def row(ids, n, one, two, counts, texts, common):
        kind = pa.list_(pa.struct([("shingle", pa.int64()), ("texts", pa.int64())]))
        arrays = [ids, pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(counts, pa.binary()), pa.array(texts, pa.int64()), pa.array(common, kind)]
        return pa.RecordBatch.from_arrays(arrays, names=["id", "n", "d1", "d2", "counts", "texts", "common"])

    def block_row(held, texts):
        name, count = np.unique(np.concatenate(held), return_counts=True)
        often = count >= max(3, COMMON * texts)
        common = [{"shingle": a, "texts": b} for a, b in zip(name[often].view(np.int64).tolist(), count[often].tolist(), strict=True)]
        return row(pa.array([None], pa.int64()), [-1], [0], [0], [None], [texts], [common])

    def run(batches):
        held, texts, n = [], 0, 0
        for rows, data, at in pieces(batches, "text"):
            hashes, of, size = shingle_sets(data, at, width)
            one, two = _digests(hashes, of, size)
            blank = [None] * len(size)
            yield row(rows.column("id"), size, one, two, _spread_counts(hashes, of, size), blank, blank)
            held.append(hashes)
            texts += len(size)
            n += len(hashes)
            if n > block:
                yield block_row(held, texts)
                held, texts, n = [], 0, 0
        if n:
            yield block_row(held, texts)

    return run


def _common(sizes: DataFrame) -> np.ndarray:
    """Shingles that about a thousandth of all texts share."""
    block = sizes.where("n = -1")
    texts = block.agg(F.sum("texts")).first()[0] or 0
    found = block.select(F.inline("common")).groupBy("shingle").agg(F.sum("texts").alias("texts"))
    found = found.where(F.col("texts") >= max(3, COMMON * texts)).orderBy(F.desc("texts"), "shingle").limit(MOST_COMMON)
    return np.sort(found.select("shingle").toPandas()["shingle"].to_numpy(np.int64).view(U))


def _sets(width: int):
    def run(batches):
        for rows, data, at in pieces(batches, "text"):
            hashes, _, size = shingle_sets(data, at, width)
            cuts = np.cumsum(size) - size
            sets = [hashes[a : a + n].tobytes() for a, n in zip(cuts, size, strict=True)]
            yield pa.RecordBatch.from_arrays([rows.column("id"), pa.array(sets, pa.large_binary())], names=["id", "set"])

    return run


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins, and the end of the last."""
    return np.r_[np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]), len(keys)] if len(keys) else np.zeros(1, np.int64)


def _lists(keys: np.ndarray, ids: np.ndarray, named: np.ndarray, wide: int) -> Iterator[pa.RecordBatch]:
    """Texts under one key, for every key with two or more.

    Lists of more than ``wide`` texts are named by their key, and so are those whose key is in ``named``;
    others by their texts, and equal ones come once. ``keys`` and ``ids`` are sorted and distinct pairs.
    """
    cuts = _runs(keys)
    size = np.diff(cuts)
    many = np.flatnonzero(size > 1)
    if not len(many):
        return
    total = np.add.reduceat(mix(ids.view(U) + salt(29)), cuts[:-1])[many]
    own = np.isin(keys[cuts[many]], named) | (size[many] > wide)
    bucket = np.where(own, keys[cuts[many]], mix(total + size[many].astype(U)) | U(1 << 63))
    once = np.unique(bucket, return_index=True)[1]
    out = []
    for b, k in zip(bucket[once].view(np.int64).tolist(), many[once].tolist(), strict=True):
        low, high = cuts[k], cuts[k + 1]
        out += [(b, ids[low], ids[i : min(i + CHUNK, high)]) for i in range(low, high, CHUNK)]
    for i in range(0, len(out), 2000):
        part = out[i : i + 2000]
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.int64()), pa.array([x[2] for x in part], pa.list_(pa.int64()))],
            names=["bucket", "leader", "members"],
        )


def _sorted(keys: list[np.ndarray], ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, i = np.concatenate([*keys, np.empty(0, U)]), np.concatenate([*ids, np.empty(0, np.int64)])
    order = np.argsort(k, kind="stable")
    k, i = k[order], i[order]
    near = np.r_[False, k[1:] == k[:-1]]
    near[:-1] |= near[1:]  # only these need an order by id, and can repeat
    sub = np.flatnonzero(near)
    i[sub] = i[sub][np.lexsort((i[sub], k[sub]))]
    keep = np.r_[True, (k[1:] != k[:-1]) | (i[1:] != i[:-1])][: len(k)]
    return k[keep], i[keep]


def _placed(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of the key space in the high bits, which grow with the data, and 40 bits within it."""
    part = ((keys >> U(32)) * U(parts)) >> U(32)
    return part << U(40) | (keys & U((1 << 40) - 1))


def _packed(keys: np.ndarray, ids: np.ndarray) -> bytes:
    """Sorted keys of one part and their ids: differences of four bytes if that is enough, ids by number."""
    known, at = np.unique(ids, return_inverse=True)
    step = np.diff(keys, prepend=keys[:1])
    steps = step.astype(np.uint32) if step.max() < 1 << 32 else step
    at = at.astype(np.uint16 if len(known) <= 1 << 16 else np.uint32)
    head = np.array([len(keys), len(known), steps.itemsize, at.itemsize], np.int64)
    return b"".join(x.tobytes() for x in (head, keys[:1], known, steps, at))


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, m, wide, far = np.frombuffer(data, np.int64, 4).tolist()
    first = np.frombuffer(data, U, 1, 32)
    known = np.frombuffer(data, np.int64, m, 40)
    steps = np.frombuffer(data, f"u{wide}", n, 40 + 8 * m)
    at = np.frombuffer(data, f"u{far}", n, 40 + 8 * m + wide * n)
    return first + np.cumsum(steps, dtype=U), known[at]


def _index(scheme: Scheme, width: int, parts: int, flush: int = 2_000_000):
    """Keys of every text, packed for each part of the key space.

    Of texts with equal sets in a task only the first is indexed. A key that many texts of a task
    share goes out under its least text, with the rest as a list of its own.
    """

    def packed(keys, ids):
        k, i = _sorted(keys, ids)
        size = np.diff(_runs(k))
        hot = np.repeat(size > LOCAL, size)
        yield from _as_rows(_lists(k[hot], i[hot], np.empty(0, U), 0))
        lead = ~hot | np.r_[True, k[1:] != k[:-1]][: len(k)]
        k, i = k[lead], i[lead]
        part = (k >> U(40)).astype(np.int64)
        cuts = _runs(part)
        for low in range(0, len(cuts) - 1, 64):
            here = range(low, min(low + 64, len(cuts) - 1))
            data = [_packed(k[cuts[x] : cuts[x + 1]], i[cuts[x] : cuts[x + 1]]) for x in here]
            yield _row([part[cuts[x]] for x in here], data, [None] * len(data))

    def run(batches):
        seen, keys, ids, n = set(), [], [], 0
        for rows, data, at in pieces(batches, "text"):
            hashes, of, size = shingle_sets(data, at, width)
            one, two = _digests(hashes, of, size)
            new = np.zeros(len(size), bool)
            for x, d in enumerate(zip(one.tolist(), two.tolist(), strict=True)):
                if size[x] and d not in seen:
                    seen.add(d)
                    new[x] = True
            id_ = _ids(rows)
            here = new[of]
            for k, t, _ in scheme.keys(hashes[here], of[here], np.where(new, size, 0), np.empty(0, U), parts):
                keys.append(k)
                ids.append(id_[t])
                n += len(k)
            if n > flush:
                yield from packed(keys, ids)
                keys, ids, n = [], [], 0
        if n:
            yield from packed(keys, ids)

    return run


def _row(part: list, data: list, lists: list) -> pa.RecordBatch:
    kind = pa.struct([("bucket", pa.int64()), ("leader", pa.int64()), ("members", pa.list_(pa.int64()))])
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(data, pa.large_binary()), pa.array(lists, kind)], names=["part", "data", "list"])


def _as_rows(lists: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for x in lists:
        rows = x.to_pylist()
        yield _row([r["bucket"] >> 40 for r in rows], [None] * len(rows), rows)


def _meet(wide: int):
    """Lists of texts under one key, from all entries of some parts of the key space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, named = [], [], []
        for rows in batches:
            for data in rows.column("data").drop_null().to_pylist():
                k, i = _unpacked(data)
                keys.append(k)
                ids.append(i)
            if rows.column("list").null_count < rows.num_rows:
                lists = pa.RecordBatch.from_struct_array(rows.column("list").drop_null())
                named.append(lists.column("bucket").to_numpy().view(U))
                yield lists
        k, i = _sorted(keys, ids)
        yield from _lists(k, i, np.concatenate([*named, np.empty(0, U)]), wide)

    return run


class _Held:
    """Shingles with their texts, block by block; a text is ``(number, id, component, n, common)``."""

    def __init__(self) -> None:
        self.keys, self.at, self.often, self.texts, self.n = [], [], [], [], 0

    def add(self, keys: np.ndarray, at: np.ndarray, often: np.ndarray, texts: np.ndarray) -> None:
        self.keys.append(keys)
        self.at.append(at + self.n)
        self.often.append(often)
        self.texts.append(texts)
        self.n += texts.shape[1]

    def all(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if not self.texts:
            return np.empty(0, U), np.empty(0, np.int64), np.empty(0, np.uint32), np.empty((5, 0), np.int64)
        return np.concatenate(self.keys), np.concatenate(self.at), np.concatenate(self.often), np.concatenate(self.texts, axis=1)


def _block(keys: np.ndarray, at: np.ndarray, often: np.ndarray, texts: np.ndarray) -> bytes:
    """Shingles, the texts they are of and in how many components they are; texts as differences, which compress."""
    known, at = np.unique(at, return_inverse=True)
    texts = texts[:, known]
    texts[2] -= texts[1]
    texts[:2] = np.diff(texts[:2], axis=1, prepend=0)
    at = at.astype(np.uint16 if len(known) <= 1 << 16 else np.uint32)
    head = np.array([len(keys), len(known), at.itemsize, keys.itemsize], np.int64)
    return b"".join(np.ascontiguousarray(x).tobytes() for x in (head, texts, keys, often.astype(np.uint32), at))


def _unblock(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, m, far, wide = np.frombuffer(data, np.int64, 4).tolist()
    texts = np.frombuffer(data, np.int64, 5 * m, 32).reshape(5, m).copy()
    texts[:2] = np.cumsum(texts[:2], axis=1)
    texts[2] += texts[1]
    low = 32 + 40 * m
    at = np.frombuffer(data, f"u{far}", n, low + (wide + 4) * n).astype(np.int64)
    return np.frombuffer(data, f"u{wide}", n, low), at, np.frombuffer(data, np.uint32, n, low + wide * n), texts


def _blocks(part: np.ndarray, keys: np.ndarray, at: np.ndarray, often: np.ndarray, texts: np.ndarray) -> Iterator[pa.RecordBatch]:
    order = np.argsort(part, kind="stable")
    cuts = _runs(part[order])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        k = order[a:b]
        yield pa.RecordBatch.from_arrays([pa.array([part[k[0]]], pa.int64()), pa.array([_block(keys[k], at[k], often[k], texts)], pa.large_binary())], names=["part", "data"])


def _parted(x: np.ndarray, parts: int) -> np.ndarray:
    return (((mix(x.astype(U)) >> U(32)) * U(parts)) >> U(32)).astype(np.int64)


def _dealt(percent: int, width: int, parts: int, common: np.ndarray, flush: int = 2_000_000):
    """The shingles of every text, dealt by shingle. Common ones come last in every text: they go, dealt by text under a
    negative part, only if a text may need them."""

    def run(batches):
        held, n = _Held(), 0
        for rows, data, at in pieces(batches, "text"):
            hashes, of, size = shingle_sets(data, at, width)
            last = np.isin(hashes, common)
            many = np.bincount(of[last], minlength=len(size))
            number, id_, component = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("number", "id", "component"))
            texts = np.stack([number, id_, component, size, many])
            held.add(hashes[~last], of[~last], np.zeros(np.count_nonzero(~last), np.uint32), texts)
            needed = last & (many >= -(-percent * size // 100))[of]
            if needed.any():
                # Sorted by text and shingle: the first are the prefix's.
                place = np.cumsum(needed) - 1
                base = np.searchsorted(of[needed], np.arange(len(size)))
                k, t = hashes[needed], of[needed]
                rank = place[needed] - base[t]
                first = rank < (many - -(-percent * size // 100) + 1)[t]
                k, t = k[first], t[first]
                yield from _blocks(-1 - _parted(number[t], parts), k, t, np.full(len(k), LAST), texts)
            n += len(hashes)
            if n > flush:
                k, t, often, texts = held.all()
                yield from _blocks(_parted(k, parts), k, t, often, texts)
                held, n = _Held(), 0
        k, t, often, texts = held.all()
        yield from _blocks(_parted(k, parts), k, t, often, texts)

    return run


def _sampled(percent: int, width: int, parts: int, common: np.ndarray, flush: int = 2_000_000):
    """A share of every text's uncommon shingles, dealt by shingle in four bytes within a part, where some may coincide.

    ``common`` of a text is how many go out. A text that those cannot rule out goes out by itself under a negative part.
    """

    def run(batches):
        held, n = _Held(), 0
        for rows, data, at in pieces(batches, "text"):
            hashes, of, size = shingle_sets(data, at, width)
            taken = (mix(hashes ^ salt(47)) < U(int(SAMPLE * 2**64))) & ~np.isin(hashes, common)
            hashes, of = hashes[taken], of[taken]
            sent = np.bincount(of, minlength=len(size))
            number, id_, component = (rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("number", "id", "component"))
            texts = np.stack([number, id_, component, size, sent])
            open_ = sent <= size - -(-percent * size // 100)
            at = np.flatnonzero(open_)
            yield from _blocks(-1 - _parted(number[at], parts), np.zeros(len(at), np.uint32), at, np.full(len(at), LAST), texts)
            held.add(hashes, of, np.zeros(len(of), np.uint32), texts)
            n += len(hashes)
            if n > flush:
                k, t, often, texts = held.all()
                yield from _blocks(_parted(k, parts), k.astype(np.uint32), t, often, texts)
                held, n = _Held(), 0
        k, t, often, texts = held.all()
        yield from _blocks(_parted(k, parts), k.astype(np.uint32), t, often, texts)

    return run


def _screened(percent: int):
    """The ids of texts of which the sample leaves enough that other components may share."""

    def run(batches):
        held = _Held()
        for rows in batches:
            for data in rows.column("data").to_pylist():
                held.add(*_unblock(data))
        _, t, often, texts = held.all()
        order = np.argsort(texts[0][t], kind="stable")
        t, often = t[order], often[order].astype(np.int64)
        cuts = _runs(texts[0][t])[:-1]
        shared = np.add.reduceat(often, cuts) if len(t) else often
        _, id_, _, n, sent = texts[:, t[cuts] if len(t) else t]
        keep = sent - shared <= n - -(-percent * n // 100)
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(id_[keep]))], names=["id"])

    return run


def _shared(parts: int, counted: bool = False):
    """The shingles that several components have, dealt by text; with ``counted`` how many they are."""

    def run(batches):
        held = _Held()
        for rows in batches:
            for part, data in zip(rows.column("part").to_pylist(), rows.column("data").to_pylist(), strict=True):
                if part < 0:  # for the next step
                    yield pa.RecordBatch.from_arrays([pa.array([-1 - part], pa.int64()), pa.array([data], pa.large_binary())], names=["part", "data"])
                else:
                    held.add(*_unblock(data))
        k, t, _, texts = held.all()
        del held
        order = np.argsort(k, kind="stable")
        near = np.r_[False, k[order][1:] == k[order][:-1]][: len(k)]
        near[:-1] |= near[1:]
        k, t = k[order[near]], t[order[near]]
        component = texts[2][t]
        order = np.lexsort((component, k))
        k, t, component = k[order], t[order], component[order]
        cuts = _runs(k)
        new = np.r_[True, (k[1:] != k[:-1]) | (component[1:] != component[:-1])][: len(k)]
        often = np.add.reduceat(new, cuts[:-1], dtype=np.int64) if len(k) else np.empty(0, np.int64)
        often = np.repeat(often, np.diff(cuts))
        k, t, often = k[often > 1], t[often > 1], np.minimum(often[often > 1], LAST - 1)
        if counted:
            t, often = np.unique(t, return_counts=True)
            k = np.zeros(len(t), np.uint32)
        yield from _blocks(_parted(texts[0][t], parts), k, t, often, texts)

    return run


def _prefixes(percent: int):
    """The rarest shingles of each text, as many as leave too few for a similar one; those of one component are no keys."""

    def run(batches):
        held = _Held()
        for rows in batches:
            for data in rows.column("data").to_pylist():
                held.add(*_unblock(data))
        k, t, often, texts = held.all()
        del held
        number = texts[0][t]
        order = np.lexsort((k, often, number))
        k, t, often = k[order], t[order], often[order]
        cuts = _runs(number[order])
        place = np.arange(len(k)) - np.repeat(cuts[:-1], np.diff(cuts))
        last = often == LAST
        few = np.add.reduceat(~last, cuts[:-1], dtype=np.int64) if len(k) else np.empty(0, np.int64)
        # Of those that other components share the uncommon come first and the common last.
        n, many = texts[3][t], texts[4][t]
        rest = np.repeat(few, np.diff(cuts)) + many - place
        # A similar set has ``percent`` of this one's shingles, from the first they share on.
        take = 100 * rest >= percent * n
        for low in range(0, len(at := np.flatnonzero(take)), 50_000):
            x = at[low : low + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(k[x].view(np.int64)), pa.array(texts[1][t[x]]), pa.array(texts[2][t[x]]), pa.array(n[x]), pa.array(rest[x])],
                names=["bucket", "id", "component", "n", "rest"],
            )

    return run


def _parts(texts: DataFrame) -> int:
    return max(8, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART))


def _sharing(texts: DataFrame, percent: int, width: int, common: np.ndarray) -> DataFrame:
    """``id`` of the ``texts`` that can be similar to one of another component: of all others the sample alone has too many
    shingles that no other component has. Texts as in :func:`_rare`."""
    parts = _parts(texts)
    dealt = texts.mapInArrow(_sampled(percent, width, 4 * parts, common), "part long, data binary").repartition(parts, "part")
    shared = dealt.mapInArrow(_shared(4 * parts, True), "part long, data binary").repartition(parts, "part")
    return shared.mapInArrow(_screened(percent), "id long").distinct()


def _rare(texts: DataFrame, percent: int, width: int, common: np.ndarray) -> DataFrame:
    """``(bucket, id, component, n, rest)``: the shingles by which a text can be similar to one of another component.

    ``texts`` are ``(id, component, text, number)``, numbers distinct. Shingles have one order: by the number of components
    that have them, common ones last. The first shingle that two similar sets share has at least ``percent`` % of
    either set's shingles in the ``rest`` from it on; those of a single component come before and are shared with no other.
    """
    parts = _parts(texts)
    dealt = texts.mapInArrow(_dealt(percent, width, 4 * parts, common), "part long, data binary").repartition(parts, "part")
    shared = dealt.mapInArrow(_shared(4 * parts), "part long, data binary").repartition(parts, "part")
    return shared.mapInArrow(_prefixes(percent), "bucket long, id long, component long, n long, rest long")


LIST = "bucket long, leader long, members array<long>"


def _candidates(docs: DataFrame, scheme: Scheme, width: int, parts: int, tasks: int) -> DataFrame:
    """``(bucket, leader, members)`` of every key that two or more texts share."""
    packed = docs.mapInArrow(_index(scheme, width, 8 * parts), "part long, data binary, list struct<bucket:long,leader:long,members:array<long>>")
    lists = packed.repartition(parts, "part").coalesce(tasks).mapInArrow(_meet(WIDE), LIST)
    return written(lists.dropDuplicates(["bucket", "leader", "members"]), "lists", tasks)


def _only(docs: DataFrame, ids: DataFrame, tasks: int) -> DataFrame:
    """The rows of ``docs`` with an ``id`` of ``ids``, without moving texts where the ids are few; holds a table of the ids."""
    ids = written(ids, "ids", tasks)
    return held_by(docs.join(F.broadcast(ids) if ids.count() <= SMALL else ids, "id"), ids)


def _agree(percent: int):
    def run(batches):
        for rows in batches:
            keep = []
            for a, b in zip(rows.column("set_a").to_pylist(), rows.column("set_b").to_pylist(), strict=True):
                x, y = np.frombuffer(a, U), np.frombuffer(b, U)
                both = np.concatenate([x, y])
                both.sort()
                inner = int((both[1:] == both[:-1]).sum())
                keep.append(100 * inner >= percent * (len(x) + len(y) - inner))
            yield rows.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int, tasks: int) -> DataFrame:
    """The pairs ``(u, v)`` whose shingle sets are similar enough, tested on the whole sets."""
    if pairs.isEmpty():
        return pairs.select("u", "v")
    ids = pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct()
    texts = _only(docs, ids, tasks)
    sets = written(texts.mapInArrow(_sets(width), "id long, set binary"), "sets")
    a = sets.select(F.col("id").alias("u"), F.col("set").alias("set_a"))
    b = sets.select(F.col("id").alias("v"), F.col("set").alias("set_b"))
    links = written(pairs.join(a, "u").join(b, "v").coalesce(tasks).mapInArrow(_agree(percent), "u long, v long"), "links")
    drop(texts, sets)
    return links


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """``(doc_id, n_shingles, set_id, component_id)`` of each row, all long; ids are whole numbers.

    ``n_shingles`` counts the distinct shingles of ``width`` words of the whole text, A-Z taken as
    a-z. A text with fewer words is one shingle; a text without words (null, empty or white
    space) has none and links to nothing. ``set_id`` is the least id with the same set,
    ``component_id`` the least id that links reach; a link is a Jaccard similarity of ``percent`` or
    more between two sets, with equality counted in. Rows that share an id are one node, and
    its links are those of any of its rows. A row with a null id is returned with its count,
    and null for the rest. Other columns of ``docs``, whatever their names, are not read. An empty
    table gives an empty result.
    """
    docs = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    parts = shuffle_width(spark, docs, "text", 16)
    sizes = written(docs.mapInArrow(_sizes(width), _SIZES), "sizes")
    common = _common(sizes)
    rows = sizes.where("n >= 0")
    n_rows = rows.count()
    tasks = max(8, n_rows // TEXTS)  # fewer would hold too much, more would be idle
    digest = ["d1", "d2", "n"]
    first = written(rows.where("n > 0 and id is not null").groupBy(*digest).agg(F.min("id").alias("set_id"), F.count("*").alias("copies")), "first", tasks)
    sets = looked_up(rows.select("id", *digest), first, digest, n_rows)
    sets = written(sets.select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("set_id", "id")).alias("set_id")), "ids", tasks)
    leaders = first.select(F.col("set_id").alias("id"), *digest)
    held = rows.join(F.broadcast(leaders) if leaders.count() <= SMALL else leaders, ["id", *digest])
    counts = written(held.groupBy("id", *digest).agg(F.first("counts").alias("counts")).select("id", "n", "counts"), "counts", tasks)
    drop(sizes)
    named = docs.where("id is not null")
    # Links are between sets, each by its least id; an id with several sets ties them.
    known = sets.where("id is not null")
    tied = known.groupBy("id").agg(F.min("set_id").alias("u"), F.max("set_id").alias("low")).where("u != low").select("id", "u")
    linked = written(known.join(tied, "id").where("u != set_id").select("u", F.col("set_id").alias("v")).distinct(), "links", tasks)
    to = written(known.where("n > 0").select("id", "set_id", "n").distinct(), "to", tasks)

    def possible(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "met", tasks)
        wanted = _only(counts, pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct(), tasks)
        there = written(wanted, "counts", tasks)
        for side in ("u", "v"):
            pairs = held_by(pairs.join(there.withColumnsRenamed({"id": side, "n": f"n_{side}", "counts": f"counts_{side}"}), side), pairs)
        out = written(pairs.coalesce(tasks).mapInArrow(_may_agree(percent), "u long, v long").distinct(), "pairs", tasks)
        drop(pairs, wanted, there)
        return out

    def untested(pairs: DataFrame) -> DataFrame:
        return pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti")

    lists = _candidates(named, Scheme(percent, common=common), width, parts, tasks)
    met = possible(_led(lists, to, percent))
    fresh = _verified(met, named, width, percent, tasks)
    stars = _stars(tasks, None, linked, fresh)
    linked = None
    ids = written(_unresolved(lists, stars, to).select("id", "component").distinct(), "open", tasks)
    drop(lists)
    if not ids.isEmpty():
        # Texts that keys leave in several components meet again under the rarest of their shingles.
        texts = written(_only(named, ids, tasks).withColumn("number", F.monotonically_increasing_id()), "texts")
        sharing = _only(texts, _sharing(texts, percent, width, common), tasks)
        rare = written(_rare(sharing, percent, width, common), "rare", tasks)
        near = written(_still_apart(rare, stars), "open", tasks)
        drop(texts, sharing, rare)
        tested = met
        # First some pairs of every two components, which join what is one cluster; then all pairs of those still apart.
        for few in (3, None):
            held = _only(counts, near.select("id").distinct(), tasks)
            across = _in_blocks(near).join(held, ["id", "n"]).repartition(parts, "bucket", "low", "high").coalesce(tasks)
            across = across.sortWithinPartitions("bucket", "low", "high").mapInArrow(_apart(percent, few), "u long, v long, more boolean")
            across = written(across.groupBy("u", "v").agg(F.max("more").alias("more")), "pairs", tasks)
            drop(held)
            untested = written(across.select("u", "v").join(tested, ["u", "v"], "left_anti"), "pairs", tasks)
            tested = tested.unionByName(untested)
            linked = _verified(untested, named, width, percent, tasks)
            if few is not None:
                more = across.where("more").select(F.explode(F.array("u", "v")).alias("id")).distinct()
                more = near.join(more, "id").select("component").distinct()
                near = written(near.join(more, "component", "left_semi"), "open", tasks)
                stars = _stars(tasks, stars, linked)
                linked = None
                near = written(_still_apart(near, stars), "open", tasks)
        drop(near)
    stars = _stars(tasks, stars, linked)
    found = stars.select(F.col("u").alias("set_id"), F.col("v").alias("component"))
    size = first.groupBy("set_id").agg(F.sum("copies").alias("copies"))
    of_set = size.join(found, "set_id", "full")
    return looked_up(sets, of_set, ["set_id"], n_rows).select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        "set_id",
        F.coalesce("component", "set_id").alias("component_id"),
    )


def _stars(tasks: int, stars: DataFrame | None, *links: DataFrame | None) -> DataFrame:
    """What was linked before and ``links``, as links of each set to the least one it reaches."""
    links = [x for x in links if x is not None]
    more = [x for x in links if not x.isEmpty()]
    if stars is not None and not more:
        return stars
    edges = [x.select("u", "v") for x in ([stars] if stars is not None else []) + (more or links)]
    found = components(reduce(DataFrame.unionByName, edges))
    out = written(found.where("node != component").select(F.col("node").alias("u"), F.col("component").alias("v")), "links", tasks)
    drop(found, *links, *([stars] if stars is not None else []))
    return out


def _still_apart(entries: DataFrame, stars: DataFrame) -> DataFrame:
    """The entries of keys that are still in several components, with the components of ``stars`` and the number of ``texts``."""
    now = entries.drop("component", "texts").join(stars.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left")
    now = now.withColumn("component", F.coalesce("component", "id"))
    several = now.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("texts"))
    return now.join(several.where("low != high").select("bucket", "texts"), "bucket").select("bucket", "id", "n", "rest", "component", "texts")


def _in_blocks(entries: DataFrame) -> DataFrame:
    """The texts of a key for each pair of its blocks; ``side`` tells the blocks of a pair apart.

    A key of up to ``BLOCK`` texts is one block. Every two texts of a key meet in one pair of blocks, so that very
    many are compared by many tasks, none of which holds more than two blocks.
    """
    blocks = F.ceil(F.col("texts") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    out = entries.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    cells = [F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).cast("int").alias("side")]
    return out.select("bucket", *cells, *[c for c in entries.columns if c not in ("bucket", "texts")])


def _led(lists: DataFrame, to: DataFrame, percent: int) -> DataFrame:
    """For each set, by its least text, two of the sets that lead its keys and are near enough in size: the first, and the one
    that shares most keys with it. What these pairs leave apart under a key is compared there."""
    led = lists.join(to.select(F.col("id").alias("leader"), F.col("set_id").alias("u"), F.col("n").alias("u_n")), "leader")
    led = led.select(F.explode("members").alias("id"), "u", "u_n").groupBy("id", "u", "u_n").agg(F.count("*").alias("shared"))
    # A text has one leader a key at most; they are a row of it, so that no join returns more rows than there are texts.
    led = led.groupBy("id").agg(F.collect_list(F.struct("u", "u_n", "shared")).alias("led")).join(to, "id").select("set_id", "n", F.inline("led"))
    pairs = led.where((F.col("u") != F.col("set_id")) & (100 * F.least("u_n", "n") >= percent * F.greatest("u_n", "n")))
    pairs = pairs.groupBy(F.least("u", "set_id").alias("u"), F.greatest("u", "set_id").alias("v")).agg(F.sum("shared").alias("shared"))
    most = F.max_by("u", F.struct("shared", (-F.col("u")).alias("less")))
    return pairs.groupBy("v").agg(F.min("u").alias("first"), most.alias("most")).select(F.explode(F.array_distinct(F.array("first", "most"))).alias("u"), "v")


def _unresolved(lists: DataFrame, stars: DataFrame, to: DataFrame) -> DataFrame:
    """``(bucket, id, component, texts)`` of the keys whose texts are not all in one component, one text a set."""
    entry = lists.select("bucket", F.explode("members").alias("id")).join(to, "id").select("bucket", F.col("set_id").alias("id")).distinct()
    entry = entry.join(stars.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left")
    entry = entry.withColumn("component", F.coalesce("component", "id"))
    several = entry.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("texts"))
    return entry.join(several.where("low != high").select("bucket", "texts"), "bucket")


def drop_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """The rows of ``docs`` whose id names their component, all columns kept.

    Rows without words and rows with a null id stay; of rows that share an id all stay or none.
    """
    found = near_duplicates(docs, id, text, width, percent).where("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(found, docs[id].cast("long") == F.col("__gone"), "left_anti")
