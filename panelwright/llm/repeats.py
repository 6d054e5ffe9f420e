"""Long passages that occur more than once in a corpus, found with run-length compressed suffix indexes.

A passage of ``length`` bytes is repeated if the same bytes start anywhere else. Every window of that
length has an anchor, the least hash of the 128-byte strings in it, which is the same wherever the window
stands. Stretches of windows with one anchor are the unit of work: anchors in one place only are done with, and
equal stretches are collapsed to one (they repeat as a whole). What is left, different
stretches under one anchor and those that hold theirs in several places, is dealt by anchor; each share becomes a run-length compressed Burrows-Wheeler
transform with text positions sampled at the ends of its runs. From these samples alone the matching
statistics of the share are streamed: how far the text from each position agrees with some
other position. Windows that agree over the whole length are marked.

Only hashes of stretches and the bytes of doubtful ones are moved. Positions are bytes of UTF-8; matches do not
cross texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.scratch import drop, written
from panelwright.llm.tokens import _power, flat, mix, pieces, salt

LENGTH = 400
U = np.uint64
#: Bytes of one index, and of one anchor's stretches above which its windows are compared by 128-bit hashes instead.
SHARE, HEAVY = 2 << 20, 16 << 20


def _sums(data: np.ndarray, key: int) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(mix(data.astype(U) + salt(key)) * power[: len(data)], out=sums[1:])
    return sums, inverse


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if have < width else x


def stretches(data: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of each stretch of windows with one anchor: first and last window start, anchor, hash of the bytes, whether the anchor is there more than once, and text number."""
    none = np.empty(0, np.int64)
    if len(data) < length:
        return none, none, none.view(U), none.view(U), none.view(bool), none
    sums, inverse = _sums(data, 31)
    grams = mix((sums[gram:] - sums[:-gram]) * inverse[: len(data) - gram + 1])
    places = length - gram + 1
    anchor = _sliding_least(grams, places)
    stop = np.repeat(at[1:], np.diff(at))[: len(anchor)]
    whole = np.arange(len(anchor)) + length <= stop
    change = np.r_[True, (anchor[1:] != anchor[:-1]) | (stop[1:] != stop[:-1])]
    first = np.flatnonzero(whole & (change | ~np.r_[False, whole[:-1]]))
    last = np.flatnonzero(whole & np.r_[change[1:] | ~whole[1:], True])
    held = mix((sums[last + length] - sums[first]) * inverse[first] + (last - first).astype(U))
    # A place of an anchor is a string that is the least of some window: no less than the greatest of its windows' anchors.
    edge = np.zeros(places - 1, U)
    place = np.flatnonzero(grams == ~_sliding_least(~np.concatenate([edge, anchor, edge]), places))
    low, high = np.searchsorted(place, first), np.searchsorted(place, last + places)
    size = high - low
    stretch = np.repeat(np.arange(len(first)), size)
    near = place[np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - low, size)]
    many = np.bincount(stretch[grams[near] == anchor[first][stretch]], minlength=len(first)) > 1
    of = np.searchsorted(at, first, "right") - 1
    return first - at[of], last - at[of], anchor[first], held, many, of


def _stretched(length: int, gram: int):
    def run(batches):
        for rows, data, at in pieces(batches, "text"):
            first, last, anchor, held, many, of = stretches(data, at, length, gram)
            of = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [rows.column("id").take(of), rows.column("t").take(of), pa.array(first), pa.array(last), pa.array(anchor.view(np.int64)), pa.array(held.view(np.int64)), pa.array(many.astype(np.int32))],
                names=["id", "t", "first", "last", "anchor", "held", "many"],
            )

    return run


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of the sorted suffixes of small integers below 512, by doubling, over groups not yet told apart."""
    n = len(text)
    padded = np.r_[text.astype(U), np.zeros(7, U)]
    key = np.zeros(n, U)
    for k in range(7):
        key = key << U(9) | padded[k : n + k]
    order = np.argsort(key)
    key = key[order]
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    new = np.r_[True, key[1:] != key[:-1]]
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    alone = new & np.r_[new[1:], True]
    left = np.flatnonzero(~alone)
    step = 7
    while len(left):
        i = order[left]
        key = rank[i].astype(U) << U(32) | (rank[np.minimum(i + step, n)] + 1).astype(U)
        by = np.argsort(key)
        i, key = i[by], key[by]
        order[left] = i
        new = np.r_[True, key[1:] != key[:-1]]
        rank[i] = left[np.maximum.accumulate(np.where(new, np.arange(len(left)), 0))]
        left = left[~(new & np.r_[new[1:], True])]
        step *= 2
    return order


@dataclass
class RunIndex:
    """A run-length compressed Burrows-Wheeler transform with text positions sampled at its run ends."""

    symbols: np.ndarray  # of each run
    starts: np.ndarray  # of each run in the transform
    heads: np.ndarray  # text position of the suffix at the start of each run
    ends: np.ndarray  # text position of the suffix at the end of the run before (-1 for the first)

    @classmethod
    def of(cls, text: np.ndarray) -> RunIndex:
        order = suffix_array(text)
        symbol = np.where(order > 0, text[order - 1], -1)  # nothing comes before the first position
        starts = np.flatnonzero(np.r_[True, symbol[1:] != symbol[:-1]])
        return cls(symbol[starts], starts, order[starts], np.r_[-1, order[starts[1:] - 1]])

    def matches(self, text: np.ndarray) -> np.ndarray:
        """How many symbols the text from each position shares with the text from some other position, at most.

        Where two neighbouring suffixes stand in one run, they are preceded by the same symbol, and
        their agreement is one less than that of the suffixes a symbol earlier. So only
        suffixes at run heads are compared with their sampled neighbour; a stream over text positions
        gives the neighbour and agreement of all others, and from both sides the longest match.
        """
        n = len(text)
        by = np.argsort(self.heads)
        head, near = self.heads[by], self.ends[by]
        agree = _common(text, head, near)
        where = np.zeros(n, np.int64)
        where[head] = np.arange(len(head))
        nth = np.maximum.accumulate(where)  # the last run head at or before each position; 0 is one
        since = np.arange(n) - head[nth]
        before = np.where(since >= 0, np.maximum(agree[nth] - since, 0), 0)
        neighbour = near[nth] + since
        out = before.copy()
        known = (before > 0) & (neighbour >= 0)
        out_of = neighbour[known]
        np.maximum.at(out, out_of, before[known])
        return out


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many symbols agree from positions ``a`` and ``b`` on; none from -1."""
    n = len(text)
    padded = np.r_[text.astype(U), np.zeros(8, U)]
    word = np.zeros(n + 1, U)
    for k in range(7):
        word = word << U(9) | padded[k : n + 1 + k]
    out = np.zeros(len(a), np.int64)
    live = np.flatnonzero(b >= 0)
    while len(live):
        i, j = a[live] + out[live], b[live] + out[live]
        fits = (i + 7 <= n) & (j + 7 <= n)
        same = fits & (word[np.minimum(i, n)] == word[np.minimum(j, n)])
        out[live[same]] += 7
        done = live[~same]
        for _ in range(7):
            i, j = a[done] + out[done], b[done] + out[done]
            ok = (i < n) & (j < n)
            ok &= text[np.minimum(i, n - 1)] == text[np.minimum(j, n - 1)]
            done = done[ok]
            out[done] += 1
        live = live[same]
    return out


def repeated_windows(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each part, whether the ``length`` bytes from each window start stand anywhere else in the parts."""
    size = np.array([len(p) for p in parts])
    text = np.zeros(size.sum() + len(parts), np.int16)
    start = np.cumsum(size + 1) - size - 1
    for s, p in zip(start.tolist(), parts, strict=True):
        text[s : s + len(p)] = np.frombuffer(p, np.uint8).astype(np.int16) + 1
    match = RunIndex.of(text).matches(text)
    return [match[s : s + n - length + 1] >= length for s, n in zip(start.tolist(), size.tolist(), strict=True)]


def _runs_of(flag: np.ndarray) -> Iterator[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.r_[0, flag.astype(np.int8), 0]))
    yield from zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True)


_MARK = "id long, t long, first long, last long"


def _indexed(length: int):
    """Windows of single stretches that stand elsewhere, from all stretches of the anchors dealt here, by anchor."""

    def solve(share: list[dict]) -> list[tuple]:
        once = list({(x["anchor"], x["held"]): x for x in share}.values())  # repeated rows send a stretch again
        flags = repeated_windows([x["data"] for x in once], length)
        return [(x["id"], x["t"], x["first"] + a, x["first"] + b) for x, f in zip(once, flags, strict=True) if x["n"] == 1 for a, b in _runs_of(f)]

    def run(batches):
        share, size, last = [], 0, None
        for rows in batches:
            for x in rows.to_pylist():
                if x["anchor"] != last and size > SHARE:
                    yield _marks(solve(share))
                    share, size = [], 0
                share.append(x)
                size += len(x["data"])
                last = x["anchor"]
        if share:
            yield _marks(solve(share))

    return run


def _marks(found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "t", "first", "last"])


def _cut(length: int):
    """The bytes of the wanted stretches of each text."""

    def run(batches):
        for rows in batches:
            data, at = flat(rows.column("text"))
            wanted = rows.column("wanted").to_pylist()
            for low in range(0, len(wanted), 256):
                out = [(w["anchor"], w["held"], w["n"], i, w["first"], data[at[i] + w["first"] : at[i] + w["last"] + length].tobytes()) for i in range(low, min(low + 256, len(wanted))) for w in wanted[i]]
                if out:
                    c = list(zip(*out, strict=True))
                    of = pa.array(c[3])
                    yield pa.RecordBatch.from_arrays(
                        [*[pa.array(c[k], pa.int64()) for k in range(3)], rows.column("id").take(of), rows.column("t").take(of), pa.array(c[4], pa.int64()), pa.array(c[5], pa.binary())],
                        names=["anchor", "held", "n", "id", "t", "first", "data"],
                    )

    return run


def _hashed(length: int):
    """Two hashes of every window of the stretches of heavy anchors."""

    def run(batches):
        for rows in batches:
            for x in rows.to_pylist():
                data = np.frombuffer(x["data"], np.uint8)
                n = len(data) - length + 1
                made = []
                for key in (37, 41):
                    sums, inverse = _sums(data, key)
                    made.append(pa.array(mix((sums[length:] - sums[:n]) * inverse[:n]).view(np.int64)))
                first = np.arange(n) + x["first"]
                yield pa.RecordBatch.from_arrays([*made, *[pa.array([x[c]] * n, pa.int64()) for c in ("id", "t", "n")], pa.array(first)], names=["h1", "h2", "id", "t", "n", "first"])

    return run


def _with(docs: DataFrame, known: DataFrame, how: str) -> DataFrame:
    """``docs`` joined with what is known of texts by ``id`` (null matching null) and hash."""
    renamed = known.withColumnsRenamed({"id": "known_id", "t": "known_t"})
    same = docs["id"].eqNullSafe(renamed["known_id"]) & (docs["t"] == renamed["known_t"])
    return docs.join(renamed, same, how).drop("known_id", "known_t")


def repeated_stretches(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(id, t, first, last)``: stretches of window starts of repeated windows; ``docs`` has id, t (a hash of the text) and text."""
    spark = docs.sparkSession
    gram = max(1, length * 128 // 400)
    every = written(docs.mapInArrow(_stretched(length, gram), "id long, t long, first long, last long, anchor long, held long, many int"), "stretches")
    often = every.groupBy("anchor").agg((F.count("*") + F.max("many")).alias("places")).where("places > 1").select("anchor")
    found = written(every.join(often, "anchor"), "stretches")
    drop(every)
    kinds = found.groupBy("anchor", "held").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("id", "t", "first", "last", "many")])
    kinds = written(kinds, "kinds")
    whole = found.join(kinds.where("n > 1").select("anchor", "held"), ["anchor", "held"]).select("id", "t", "first", "last")

    doubtful = kinds.groupBy("anchor").agg((F.count("*") + F.max("many")).alias("kinds"), F.sum(F.col("last") - F.col("first") + length).alias("bytes")).where("kinds > 1")
    doubtful = kinds.join(doubtful.select("anchor", "bytes"), "anchor")
    wanted = written(doubtful.groupBy("id", "t").agg(F.collect_list(F.struct("anchor", "held", "n", "first", "last", "bytes")).alias("wanted")), "wanted")
    total = wanted.select(F.explode("wanted").alias("w")).agg(F.sum(F.when(F.col("w.bytes") <= HEAVY, F.col("w.last") - F.col("w.first") + length)), F.max("w.bytes")).first()
    marks, done = whole, []
    for heavy in (False, True):
        if total[1] is None or (total[1] <= HEAVY if heavy else total[0] is None):
            continue
        part = wanted.withColumn("wanted", F.filter("wanted", lambda w: (w["bytes"] > HEAVY) if heavy else (w["bytes"] <= HEAVY))).where(F.size("wanted") > 0)
        cut = _with(docs, part, "inner").mapInArrow(_cut(length), "anchor long, held long, n long, id long, t long, first long, data binary")
        if heavy:
            windows = written(cut.dropDuplicates(["anchor", "held"]).mapInArrow(_hashed(length), "h1 long, h2 long, id long, t long, n long, first long"), "windows")
            done.append(windows)
            twice = windows.groupBy("h1", "h2").count().where("count > 1").select("h1", "h2")
            hit = windows.where("n = 1").join(twice, ["h1", "h2"]).select("id", "t", "first", F.col("first").alias("last"))
        else:
            shares = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total[0] // (4 * SHARE)))
            hit = cut.repartition(shares, "anchor").sortWithinPartitions("anchor").mapInArrow(_indexed(length), _MARK)
        marks = marks.unionByName(hit)
    marks = written(marks, "marks")
    drop(found, kinds, wanted, *done)
    return marks


def _removed(length: int):
    def run(batches):
        for rows in batches:
            data, at = flat(rows.column("text"))
            spans, kept = [], []
            for i, marks in enumerate(rows.column("marks").to_pylist()):
                own = data[at[i] : at[i + 1]]
                joined: list[list[int]] = []
                for m in sorted((m["first"], m["last"] + length) for m in marks or ()):
                    if joined and m[0] <= joined[-1][1]:
                        joined[-1][1] = max(joined[-1][1], m[1])
                    else:
                        joined.append(list(m))
                spans.append([{"start": a, "end": b} for a, b in joined])
                edge = [0, *[x for m in joined for x in m], len(own)]
                kept.append(b"".join(own[a:b].tobytes() for a, b in zip(edge[::2], edge[1::2], strict=True)))
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([rows.column("row"), pa.array(np.diff(at)), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["row", "n_bytes", "spans", "kept"])

    return run


def drop_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """``(row, n_bytes, spans, kept)``: each row without its text as a struct, and what repeated passages leave of it.

    ``spans`` are the maximal runs of bytes (start, end exclusive) covered by strings of ``length`` bytes that
    start anywhere else too, in the same text or another one; overlaps count, and all strings
    are judged on the input. ``kept`` are the other bytes, joined. A null text counts as empty; texts
    shorter than ``length`` keep everything. Repeated rows are copies of each other, whatever
    their ids; null ids and other columns of any name do no harm.
    """
    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    rows = docs.select(F.struct(*rest).alias("row"), F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("t", F.xxhash64("text"))
    found = repeated_stretches(rows.select("id", "t", "text"), length)
    marks = written(found.groupBy("id", "t").agg(F.collect_set(F.struct("first", "last")).alias("marks")), "marks")
    drop(found)
    marked = _with(rows, marks, "left").select("row", "text", "marks")
    return marked.mapInArrow(_removed(length), f"row {rows.schema['row'].dataType.simpleString()}, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")
