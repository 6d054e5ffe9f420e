"""Toxic spans and documents by a linear-chain conditional random field.

Only documents carry labels, so tokens are labelled first: in toxic documents, those whose word or word beginning
is significantly commoner there than in clean ones (every sight of it in a new surrounding counts
once, so copies prove nothing); all others, and all tokens of clean documents, are
not toxic. A field of two states with hashed features of the token's letters, its beginnings and end is
fitted to these labels. Forward-backward passes give every token its marginal probability;
the marginals give toxic spans, and a logistic function of the strongest ones the document's score.

The field is fitted on the driver to a bounded sample of labelled documents. Scoring is one pass over
all texts. Long texts are scored in windows that overlap by so many tokens that what lies beyond cannot
change a marginal (see :func:`overlap`).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.tokens import _power, flat, mix, pieces, salt

#: Bound of the sample: documents of each label, and bytes of all of them together, in whole texts.
DOCUMENTS, BYTES = 1500, 4 << 20
#: Steps of the fit, unless it settles before: when a step moves the marginals by less than this share of the toxic tokens.
ROUNDS, SETTLED = 200, 1e-2
BITS = 20
WINDOW = 384
STARTS = (4, 5, 6, 8)
U = np.uint64

LETTER = np.zeros(256, bool)
LETTER[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = True
LETTER[128:] = True


def _folded(data: np.ndarray) -> np.ndarray:
    """Lower case of A-Z and of the two-byte capitals U+00C0 to U+00DE."""
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    two = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    out[two] += 32
    return out


def tokens(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte and end of every run of letters and digits, and the number of the first of each text."""
    inside = LETTER[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    left = np.r_[False, inside[:-1]][: len(data)] & ~edge[: len(data)]
    right = np.r_[inside[1:], False][: len(data)] & ~edge[1:][: len(data)]
    start = np.flatnonzero(inside & ~left)
    return start, np.flatnonzero(inside & ~right) + 1, np.searchsorted(start, at)


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Feature hashes of each token: the word, its beginnings (0 where it is no longer than them), its last four bytes."""
    power, inverse = _power(len(data) + 1)
    sums = np.zeros(len(data) + 1, U)
    np.cumsum(mix(_folded(data).astype(U) + U(1)) * power[: len(data)], out=sums[1:])
    size = end - start
    out = np.zeros((len(start), len(STARTS) + 2), U)
    out[:, 0] = mix((sums[end] - sums[start]) * inverse[start] + salt(1))
    for k, n in enumerate(STARTS, 1):
        part = mix((sums[np.minimum(start + n, end)] - sums[start]) * inverse[start] + salt(2, n))
        out[:, k] = np.where(size > n, part, U(0))
    low = np.maximum(end - 4, start)
    out[:, -1] = np.where(size > 4, mix((sums[end] - sums[low]) * inverse[low] + salt(3)), U(0))
    return out


def _slots(hashes: np.ndarray) -> np.ndarray:
    return np.where(hashes == 0, 0, (hashes >> U(64 - BITS)).astype(np.int64) | 1)


@dataclass
class Field:
    """Weights of hashed features for the toxic state, log transition weights, and the score's logistic function."""

    weights: np.ndarray
    bias: float
    steps: np.ndarray  # [from, to]
    score: np.ndarray  # intercept, strongest marginal's log odds, log count of toxic tokens
    settled: bool = True

    def emissions(self, hashes: np.ndarray) -> np.ndarray:
        return self.weights[_slots(hashes)].sum(1) + self.bias


def overlap(steps: np.ndarray) -> int:
    """Tokens after which a chain's start no longer shows in double precision.

    Each transition shrinks the projective distance of two messages by tanh(D / 4), where D is the
    matrix's log cross-ratio; emissions leave it as it is (Birkhoff).
    """
    cross = abs(steps[0, 0] + steps[1, 1] - steps[0, 1] - steps[1, 0])
    shrink = math.tanh(cross / 4)
    return 2 if shrink < 1e-8 else max(2, math.ceil(math.log(1e-16) / math.log(shrink)))


def _forward_backward(emit: np.ndarray, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log odds of prefix and suffix messages, and log partition functions, of chains in rows (``emit``: odds of state 1).

    Padding has an emission of nan and passes messages on.
    """
    n, width = emit.shape
    there = ~np.isnan(emit)
    t = np.exp(steps)
    e = np.exp(np.minimum(np.where(there, emit, 0.0), 500))
    ahead, back = np.zeros((n, width)), np.ones((n, width))
    norm = np.zeros(n)
    a = np.ones(n)  # odds before the first token, uniform
    started = np.zeros(n, bool)
    for k in range(width):
        to0 = np.where(started, t[0, 0] + a * t[1, 0], 1.0)
        to1 = np.where(started, t[0, 1] + a * t[1, 1], 1.0) * e[:, k]
        live = there[:, k]
        a = np.where(live, to1 / to0, a)
        norm += np.where(live, np.log(to0), 0.0)
        started |= live
        ahead[:, k] = a
    b = np.ones(n)
    for k in range(width - 1, -1, -1):
        back[:, k] = b
        low = t[0, 0] + t[0, 1] * e[:, k] * b
        high = t[1, 0] + t[1, 1] * e[:, k] * b
        b = np.where(there[:, k], high / low, b)
    return ahead, back, norm + np.log1p(a)


def _windows(count: np.ndarray, first: np.ndarray, burn: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, end, and the part to keep, of windows over texts of ``count`` tokens."""
    begin, low, high, end = [], [], [], []
    for f, n in zip(first.tolist(), count.tolist(), strict=True):
        for k in range(0, n, WINDOW):
            low.append(f + k)
            high.append(f + min(k + WINDOW, n))
            begin.append(max(f, f + k - burn))
            end.append(min(f + n, f + k + WINDOW + burn))
    return np.array([begin, end], np.int64).reshape(2, -1), np.array(low, np.int64), np.array(high, np.int64)


def marginals(emit: np.ndarray, first: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Each token's probability of being toxic; ``first`` numbers the first token of each text."""
    out = np.zeros(len(emit))
    burn = overlap(steps)
    (begin, end), low, high = _windows(np.diff(first), first[:-1], burn)
    order = np.argsort(end - begin)
    for part in np.array_split(order, max(1, len(order) // 256)):
        if not len(part):
            continue
        width = int((end - begin)[part].max())
        at = begin[part][:, None] + np.arange(width)
        inside = at < end[part][:, None]
        grid = np.where(inside, emit[np.minimum(at, len(emit) - 1)], np.nan)
        ahead, back, _ = _forward_backward(grid, steps)
        odds = ahead * back
        keep = inside & (at >= low[part][:, None]) & (at < high[part][:, None])
        out[at[keep]] = (odds / (1 + odds))[keep]
    return out


def _evidence(prob: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Rows of 1, the strongest token's log odds, and the log of the expected number of toxic tokens, for each text."""
    n = len(first) - 1
    top, many = np.zeros(n), np.zeros(n)
    full = np.flatnonzero(np.diff(first) > 0)
    if len(full):
        top[full] = np.maximum.reduceat(prob, first[:-1][full])
        many[full] = np.add.reduceat(np.where(prob >= 0.5, prob, 0.0), first[:-1][full])
    top = np.clip(top, 1e-6, 1 - 1e-6)
    return np.stack([np.ones(n), np.log(top / (1 - top)) / 5, np.log1p(many)], 1)


def label_tokens(hashes: np.ndarray, first: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which tokens are toxic: in toxic texts, those with a feature that is significantly commoner there.

    A feature's sights are counted by distinct neighbours. It must be ten times as common in toxic texts, at a
    likelihood ratio that no feature of as many would reach by chance in a hundred trials.
    """
    of = np.repeat(toxic.astype(bool), np.diff(first))
    word = hashes[:, 0]
    around = mix(np.r_[U(0), word[:-1]] + mix(np.r_[word[1:], U(0)] + salt(5))) if len(word) else word
    marked = np.zeros(len(word), bool)
    for k in range(hashes.shape[1] - 1):  # an end alone says too little
        there = hashes[:, k] != 0
        found = []
        for kind in (True, False):
            here = there & (of == kind)
            once = np.unique(mix(hashes[here, k] + around[here]), return_index=True)[1]
            found.append(np.unique(hashes[here, k][once], return_counts=True))
        name = np.unique(np.concatenate([found[0][0], found[1][0]]))
        if not len(name):
            continue
        bad, good = np.zeros(len(name)), np.zeros(len(name))
        for into, (which, count) in zip((bad, good), found, strict=True):
            into[np.searchsorted(name, which)] = count
        all_bad, all_good = max(bad.sum(), 1.0), max(good.sum(), 1.0)
        share = all_bad / (all_bad + all_good)
        n = bad + good
        ratio = 2 * (bad * np.log(np.maximum(bad, 1e-9) / (n * share)) + good * np.log(np.maximum(good, 1e-9) / (n * (1 - share))))
        commoner = ((bad + 0.5) / all_bad) / ((good + 0.5) / all_good)
        strong = name[(commoner >= 10) & (ratio >= 2 * math.log(100 * len(name)))]
        marked |= np.isin(hashes[:, k], strong) & there
    return marked & of


def fit(texts: list[str], toxic: np.ndarray, rounds: int = ROUNDS) -> Field:
    """A field for labelled texts, by full-batch gradient steps of its penalised likelihood until the marginals stand still.

    Every token of every text counts. ``settled`` of the field is false if they still moved after ``rounds`` steps.
    """
    parts, count = [], []
    for low in range(0, len(texts), 100):  # few texts at a time: bytes take far more room than features
        data, at = flat(pa.array(texts[low : low + 100], pa.large_string()))
        start, end, first = tokens(data, at)
        whole = features(data, start, end)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            parts.append(whole[a:b].copy())
            count.append(len(parts[-1]))
    hashes = np.concatenate([*parts, np.empty((0, len(STARTS) + 2), U)])
    del parts
    first = np.r_[0, np.cumsum(count)].astype(np.int64)
    y = label_tokens(hashes, first, toxic).astype(float)

    slots = np.empty(hashes.shape, np.int32)
    for k in range(hashes.shape[1]):
        slots[:, k] = _slots(hashes[:, k])
    del hashes
    w = np.zeros(1 << BITS)

    def emissions():
        return sum((w[slots[:, k]] for k in range(slots.shape[1])), np.full(len(slots), bias))

    bias, steps = -4.0, np.zeros((2, 2))
    width = 64
    (begin, stop), _, _ = _windows(np.diff(first), first[:-1], 0)
    cuts = [(a, min(a + width, b)) for a, b in zip(begin.tolist(), stop.tolist(), strict=True) for a in range(a, b, width)]
    grid_at = np.array([c[0] for c in cuts], np.int64)[:, None] + np.arange(width)
    inside = grid_at < np.array([c[1] for c in cuts], np.int64)[:, None]
    grid_at = np.minimum(grid_at, max(len(y) - 1, 0))
    pair = inside[:, 1:]
    gold = np.zeros((2, 2))
    if len(y):
        label = y[grid_at].astype(int)
        np.add.at(gold, (label[:, :-1][pair], label[:, 1:][pair]), 1)
    sq_w, sq_b, sq_t = np.zeros(1 << BITS), 0.0, np.zeros((2, 2))
    before, settled = np.zeros(len(y)), not len(y)
    for _ in range(rounds if len(y) else 0):
        emit = emissions()
        grid = np.where(inside, emit[grid_at], np.nan)
        ahead, back, _ = _forward_backward(grid, steps)
        odds = ahead * back
        p = np.zeros(len(y))
        p[grid_at[inside]] = (odds / (1 + odds))[inside]
        settled = np.abs(p - before).sum() <= SETTLED * max(y.sum(), 1.0)
        if settled:
            break
        before = p
        gap = y - p
        grad_w = -0.05 * w
        for k in range(slots.shape[1]):
            grad_w += np.bincount(slots[:, k], weights=gap, minlength=1 << BITS)
        grad_w[0] = 0  # what a short token lacks
        # expected transitions
        e = np.exp(np.minimum(np.nan_to_num(grid), 500))
        t = np.exp(steps)
        a, b, e1 = ahead[:, :-1][pair], back[:, 1:][pair], e[:, 1:][pair]
        joint = np.stack([np.full(len(a), t[0, 0]), t[0, 1] * e1 * b, a * t[1, 0], a * t[1, 1] * e1 * b])
        expected = (joint / joint.sum(0)).sum(1).reshape(2, 2)
        grad_t = gold - expected - 0.05 * steps
        grad_b = gap.sum()
        sq_w += grad_w**2
        sq_b += grad_b**2
        sq_t += grad_t**2
        w += 0.8 * grad_w / np.sqrt(sq_w + 1e-8)
        bias += 0.5 * grad_b / math.sqrt(sq_b + 1e-8)
        steps = steps + 0.2 * grad_t / np.sqrt(sq_t + 1e-8)
    prob = marginals(emissions(), first, steps) if len(y) else y
    field = Field(w, bias, steps, np.zeros(3), bool(settled))
    field.score = _logistic(_evidence(prob, first), toxic.astype(float))
    return field


def _logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Newton's method for a penalised logistic regression."""
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w)), x.T @ (y - p) - penalty * w)
        w = w + move
        if np.abs(move).max() < 1e-8:
            break
    return w


def learned(docs: DataFrame, labels: DataFrame, use: Column, id: str = "doc_id", text: str = "text", label: str = "toxic", documents: int = DOCUMENTS, size: int = BYTES) -> Field:
    """A field fitted to labelled documents where ``use`` (of the id) holds.

    Of each label, the ``documents`` with the least hash of their id are taken, all if there are fewer, as far as their whole
    texts have ``size`` bytes together (but one at least). Null ids, labels and texts are left out. Without any toxic and
    any clean document, all scores are 0.5.
    """
    known = labels.select(F.col(id).alias("known_id"), F.col(label).cast("int").alias("known")).where(use & F.col("known").isin(0, 1))
    order = F.xxhash64(F.lit(7), "known_id"), F.col("known_id")
    taken = [known.where(F.col("known") == k).orderBy(*order).limit(documents) for k in (0, 1)]
    rows = docs.select(F.col(id).alias("known_id"), F.col(text).alias("text")).where("text is not null")
    taken = F.broadcast(taken[0].unionByName(taken[1]))
    upto = Window.partitionBy("known").orderBy(*order, "bytes").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # Two times a bounded number of narrow rows: the texts are not moved for this.
    sizes = rows.join(taken, "known_id").select("known_id", "known", F.octet_length("text").alias("bytes"))
    sizes = sizes.withColumn("sum", F.sum("bytes").over(upto)).groupBy("known_id", "known").agg(F.max("sum").alias("sum"))
    first = F.row_number().over(Window.partitionBy("known").orderBy("sum")) == 1
    taken = sizes.withColumn("first", first).where((F.col("sum") <= size) | F.col("first")).select("known_id", "known")
    rows = rows.join(F.broadcast(taken), "known_id").select("known_id", "text", "known").orderBy("known_id", "text").toPandas()
    toxic = rows["known"].to_numpy()
    if not len(rows) or toxic.min() == toxic.max():
        return Field(np.zeros(1 << BITS), -20.0, np.zeros((2, 2)), np.zeros(3))
    return fit(rows["text"].tolist(), toxic)


def toxicity(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """``(row, score, spans)``: each row without its text as a struct, its score, and its toxic spans.

    The whole text is scored. ``score`` is from 0 to 1; ``spans`` are runs of tokens with a marginal of
    a half or more, as start and end (exclusive) in code points with the strongest marginal. Null and empty texts
    have no spans and the score of a text without toxic tokens. Nothing but the text is read, so
    other columns may be null, repeat or have any name.
    """
    used = np.flatnonzero(field.weights)
    few, values = used.astype(np.int32), field.weights[used].astype(np.float32)
    bias, steps, score = field.bias, field.steps, field.score

    def run(batches):
        weights = np.zeros(1 << BITS)
        weights[few] = values
        here = Field(weights, bias, steps, score)
        for rows, data, at in pieces(batches, "text", 2 << 20):
            start, end, first = tokens(data, at)
            prob = marginals(here.emissions(features(data, start, end)), first, steps)
            found = 1 / (1 + np.exp(-_evidence(prob, first) @ score))
            hit = np.flatnonzero(prob >= 0.5)
            of = np.searchsorted(first, hit, "right") - 1
            join = np.r_[True, (hit[1:] != hit[:-1] + 1) | (of[1:] != of[:-1])][: len(hit)]
            head = np.flatnonzero(join)
            tail = np.r_[head[1:], len(hit)][: len(head)] - 1
            lead = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
            begin = lead[start[hit[head]]] - lead[at[of[head]]]
            stop = lead[end[hit[tail]]] - lead[at[of[head]]]
            top = np.maximum.reduceat(prob[hit], head) if len(head) else np.empty(0)
            cuts = np.searchsorted(of[head], np.arange(len(at)))
            spans = pa.StructArray.from_arrays([pa.array(begin.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(top)], names=["start", "end", "marginal"])
            lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), spans)
            yield pa.RecordBatch.from_arrays([rows.column("row"), pa.array(found), lists], names=["row", "score", "spans"])

    rest = [F.col(f"`{c}`") for c in docs.columns if c != text]
    bare = docs.select(F.struct(*(rest or [F.lit(None).alias("none")])).alias("row"), F.col(text).alias("text"))
    return bare.mapInArrow(run, f"row {bare.schema['row'].dataType.simpleString()}, score double, spans array<struct<start:int,end:int,marginal:double>>")
