"""Quality scores by positive-unlabelled learning.

A logistic model over hashed words and a few shape features minimises the non-negative unbiased risk

    prior * R(positives as 1) + max(0, R(unlabelled as 0) - prior * R(positives as 0))

with trusted positives and unlabelled web text; where the second part falls below zero its gradient step is
undone, so the model can't fit unlabelled positives away. The positives are a bounded sample of labelled rows, known
to every worker; the unlabelled rows are all training documents, dealt to shares by a hash. Shares descend on their
own rows and their weights are averaged after each round; the number of rounds grows with the rows.

The class prior is estimated from the same features: two cross-fitted models order positives and all unlabelled
rows, and the least ratio of the two tails bounds the share of positives among the unlabelled.

Each text is read once: its features are written as a table of a few hundred bytes a document.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stable, whole

#: Hashed word features, and shape features after them.
WORDS, SHAPE = 1 << 10, 12
#: Positives from which the model is fitted, at most: the bound on labelled rows.
SAMPLE = 6_000
#: Unlabelled rows of a share in a round; rows of a batch: many, as the negative risk must not fall below zero by chance; steps of a round in all at least.
SHARE, BATCH, STEPS = 16_384, 1024, 200
#: Deviations from the mean at which a shape feature is cut off; bins of a histogram of margins, within MARGIN.
REACH, BINS, MARGIN = 6.0, 4_000, 30.0
_MARK = re.compile(rb"[^\w\s\x80-\xff]")
_DOUBLED = re.compile(rb"[^\w\s\x80-\xff]{2}")


class Features:
    """A text's hashed words with their counts, in order, and its shape features; a word's number is cached."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
        words = text.lower().split()
        n = len(words)
        out = np.zeros(SHAPE, np.float32)
        if not n:
            out[0] = 1.0
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0, out
        count = Counter(words)
        if len(self.known) > 500_000:
            self.known.clear()
        known, idx = self.known, []
        for w in count:
            i = known.get(w)
            if i is None:
                i = known[w] = zlib.crc32(w) % WORDS
            idx.append(i)
        tf = np.fromiter(count.values(), float, len(count))
        total = np.bincount(idx, tf, WORDS).astype(np.int64)
        at = np.flatnonzero(total)
        size = len(text)
        follows = sum(map(bytes.__eq__, words, words[1:])) / n
        lines = text.count(b"\n") + 1
        ends = sum(text.count(c) for c in (b". ", b".\n", b"! ", b"? ")) + 1
        out[1:] = [
            math.log1p(n) / 10, min(1.0, (size - n) / n / 10), len(count) / n, float(tf.max()) / n, follows, min(1.0, lines / n * 5), min(1.0, ends / n * 5),
            min(1.0, len(_MARK.findall(text)) / n), min(1.0, 4 * len(_DOUBLED.findall(text)) / n), min(1.0, sum(map(bytes.isdigit, words)) / n * 4), min(1.0, text.count(b"|") / n * 4),
        ]
        return at, total[at], n, out


#: What ``features`` adds: gaps between word numbers and their counts as bytes (four bytes each where one won't do).
ADDED = "__h long, __wide boolean, __gaps binary, __counts binary, __n long, __shape binary"
_NAMES = [c.split()[0] for c in ADDED.split(", ")]


def features(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` but its text, and the features of every row's whole text; null text is empty."""
    keep = [c for c in docs.columns if c != text_col]
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns if docs.schema[c].dataType.simpleString() in ("bigint", "int", "string")]).alias("__h"), whole(text_col).alias("__text"))
    schema = T.StructType([*src.schema.fields[:-2], *T._parse_datatype_string(ADDED).fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features()
        for b in batches:
            wide, gaps, counts, size, shape = [], [], [], [], []
            for x in b.column(b.num_columns - 1).cast(pa.binary()):
                at, tf, n, sh = make(x.as_buffer().to_pybytes())
                gap = np.diff(at, prepend=0)
                big = bool(len(at)) and bool(gap.max() > 255 or tf.max() > 255)
                kind = "<u4" if big else "u1"
                wide.append(big), gaps.append(gap.astype(kind).tobytes()), counts.append(tf.astype(kind).tobytes()), size.append(n), shape.append(sh.astype("<f4").tobytes())
            cols = [b.column(b.num_columns - 2), pa.array(wide, pa.bool_()), pa.array(gaps, pa.binary()), pa.array(counts, pa.binary()), pa.array(size, pa.int64()), pa.array(shape, pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], *cols], names=schema.names)

    return src.mapInArrow(work, schema)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    prior: float
    mean: np.ndarray
    spread: np.ndarray


def no_model() -> Model:
    return Model(np.zeros(WORDS + SHAPE), -MARGIN, 0.0, np.zeros(SHAPE), np.ones(SHAPE))


class _Rows:
    """Sparse rows of features, one after the other; shape features in deviations from the mean, within bounds."""

    def __init__(self, idx: np.ndarray, val: np.ndarray, size: np.ndarray):
        self.idx, self.val, self.size = idx, val, size
        self.start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)

    @classmethod
    def read(cls, t: pa.Table | pa.RecordBatch, mean: np.ndarray, spread: np.ndarray) -> _Rows:
        idx, val, size = [], [], []
        for wide, gaps, counts, n, shape in zip(*(t.column(c).to_pylist() for c in _NAMES[1:]), strict=True):
            kind = "<u4" if wide else "u1"
            at = np.cumsum(np.frombuffer(gaps, kind), dtype=np.int64)
            tf = np.frombuffer(counts, kind)
            idx += [at, _SHAPES]
            val += [np.sqrt(tf / max(1, n)), np.clip((np.frombuffer(shape, "<f4") - mean) / spread, -REACH, REACH)]  # words: of unit length
            size.append(len(at) + SHAPE)
        return cls(np.concatenate(idx) if idx else np.zeros(0, np.int64), np.concatenate(val) if val else np.zeros(0), np.array(size, np.int64))

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]]) -> _Rows:
        return cls(np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), np.array([len(i) for i, _ in rows], np.int64))

    def __len__(self) -> int:
        return len(self.size)

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        size = self.size[rows]
        first = np.concatenate([[0], np.cumsum(size)[:-1]]) if len(rows) else np.zeros(0, np.int64)
        at = np.arange(int(size.sum())) + np.repeat(self.start[rows] - first, size)
        return np.repeat(np.arange(len(rows)), size), self.idx[at], self.val[at]

    def margin(self, w: np.ndarray, b: float, rows: np.ndarray | None = None) -> np.ndarray:
        rows = np.arange(len(self)) if rows is None else rows
        r, i, v = self.take(rows)
        return np.bincount(r, w[i] * v, len(rows)) + b


_SHAPES = np.arange(WORDS, WORDS + SHAPE)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -MARGIN, MARGIN)))


def first_state() -> np.ndarray:
    """Weights and bias, then the sums of squares by which Adagrad scales their steps."""
    k = WORDS + SHAPE + 1
    return np.concatenate([np.zeros(k), np.full(k, 1e-8)])


def risk_gradient(w: np.ndarray, b: float, pos: tuple, n_pos: int, unl: tuple, n_unl: int, prior: float) -> tuple[float, np.ndarray, float]:
    """The non-negative risk of a batch with the logistic loss, and the direction of the step, of weights and of bias.

    Losses: log(1 + exp(-z)) for class 1, log(1 + exp(z)) for class 0. Where the negative part is below zero the
    step goes up its gradient.
    """
    (rp, ip, vp), (ru, iu, vu) = pos, unl
    zp = np.bincount(rp, w[ip] * vp, n_pos) + b
    zu = np.bincount(ru, w[iu] * vu, n_unl) + b
    negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
    risk = prior * np.logaddexp(0, -zp).mean() + max(0.0, negative)
    sp, su = _sigmoid(zp), _sigmoid(zu)
    if negative >= 0:
        gp, gu = prior * (sp - 1) / n_pos - prior * sp / n_pos, su / n_unl
    else:
        gp, gu = prior * sp / n_pos, -su / n_unl
    g = np.bincount(np.concatenate([ip, iu]), np.concatenate([gp[rp] * vp, gu[ru] * vu]), len(w))
    return float(risk), g, float(gp.sum() + gu.sum())


def descend(state: np.ndarray, pos: _Rows, unl: _Rows, prior: float, epochs: int = STEPS, rate: float = 0.5, decay: float = 1e-3, seed: int = 11) -> np.ndarray:
    """Adagrad over batches of ``unl``, so many times over its rows; positives go round beside."""
    rng = np.random.default_rng(seed)
    state = state.copy()
    k = WORDS + SHAPE + 1
    theta, squares = state[:k], state[k:]
    p_order, p_at = rng.permutation(len(pos)), 0
    for _ in range(epochs):
        for u in np.array_split(rng.permutation(len(unl)), max(1, len(unl) // BATCH)):
            if p_at + BATCH > len(p_order):
                p_order, p_at = np.concatenate([p_order[p_at:], rng.permutation(len(pos))]), 0
            p = p_order[p_at : p_at + BATCH]
            p_at += BATCH
            _, g, g0 = risk_gradient(theta[:-1], theta[-1], pos.take(p), len(p), unl.take(u), len(u), prior)
            grad = np.append(g + decay * theta[:-1], g0)
            squares += grad * grad
            theta -= rate * grad / np.sqrt(squares)
    return state


def tail_prior(sp: np.ndarray, above: np.ndarray, edges: np.ndarray, n_unl: int) -> float:
    """The ratio of the tails of unlabelled and positive rows where it is surely least, less the room for chance.

    sp: the positives' margins; above: of each edge, the unlabelled rows at or above it. Were a tail of the unlabelled
    free of negatives, its share over the positives' share in it would be the prior. The low end is taken: with a prior
    above the true one the negative part of the risk vanishes and every row would be called good.
    """
    best = (1.0, 1.0)
    for c in np.quantile(sp, np.linspace(0.02, 0.8, 79)):
        k = min(len(edges) - 1, int(np.searchsorted(edges, c)))
        p, u = max((sp >= edges[k]).mean(), 1e-9), above[k] / n_unl
        room = math.sqrt(max(u * (1 - u), 1e-9) / n_unl) + math.sqrt(max(p * (1 - p), 1e-9) / len(sp))
        best = min(best, ((u + room) / p, (u - room) / p))
    return float(min(0.98, max(0.02, best[1])))


EDGES = np.linspace(-MARGIN, MARGIN, BINS + 1)


class _Training:
    """All unlabelled rows' features as a table, and the sampled positives' as rows."""

    def __init__(self, unlabelled: DataFrame, pos: pa.Table):
        self.unl, self.spark = unlabelled.select(*_NAMES), unlabelled.sparkSession

        def shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = np.array([np.frombuffer(v, "<f4") for v in b.column("__shape").to_pylist()], float).reshape(-1, SHAPE)
                sums = np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], names=["k", "s"])

        sums = {r["k"]: r["s"] for r in self.unl.mapInArrow(shapes, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()}  # 2 * SHAPE + 1 rows
        self.n = int(sums.get(0, 0))
        if self.n:
            s = np.array([sums[k] for k in range(1 + 2 * SHAPE)])
            self.mean = s[1 : 1 + SHAPE] / self.n
            self.spread = np.sqrt(np.maximum(0, s[1 + SHAPE :] / self.n - self.mean**2)) + 1e-3
            self.pos = _Rows.read(pos, self.mean, self.spread)
            self.half = np.array(pos.column("__h").to_pylist(), np.int64) & 1

    def _states(self, rows: DataFrame, shares: int, sides: list[tuple[int | None, np.ndarray]], prior: float, n: int) -> list[np.ndarray]:
        """New states after a round of ``n`` rows: each share descends from the old ones, on rows of its side; means by rows."""
        epochs = max(1, min(STEPS, -(-STEPS * BATCH // max(1, n))))
        known = self.spark.sparkContext.broadcast((self.pos, self.half, self.mean, self.spread, sides))
        width = len(sides[0][1])

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pos, half, mean, spread, sides = known.value
            now, seen = [state for _, state in sides], [0] * len(sides)
            ours = [pos if side is None else _Rows.of([pos.take(np.array([r]))[1:] for r in np.flatnonzero(half == side)] or [pos.take(np.array([0]))[1:]]) for side, _ in sides]
            held: list[pa.RecordBatch] = []

            def go_on() -> None:
                t = pa.Table.from_batches(held).sort_by([("__h", "ascending"), ("__gaps", "ascending")])
                own = t.column("__h").to_numpy() & 1
                for k, (side, _) in enumerate(sides):
                    mine = t if side is None else t.filter(pa.array(own == side))
                    if mine.num_rows:
                        now[k] = descend(now[k], ours[k], _Rows.read(mine, mean, spread), prior, epochs)
                        seen[k] += mine.num_rows
                held.clear()

            for b in batches:
                if b.num_rows:
                    held.append(b)
                if sum(x.num_rows for x in held) > 4 * SHARE:  # however many rows a share has, so many are held
                    go_on()
            if held:
                go_on()
            for k, n in enumerate(seen):
                if n:
                    new = np.append(now[k] * n, n)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(new), k)), pa.array(np.arange(len(new))), pa.array(new)], names=["side", "k", "s"])

        got = rows.repartition(shares, "__h").mapInArrow(work, "side long, k long, s double").groupBy("side", "k").agg(F.sum("s").alias("s")).collect()  # a few thousand rows
        out = []
        for k, (_, state) in enumerate(sides):
            new = {r["k"]: r["s"] for r in got if r["side"] == k}
            out.append(np.array([new[i] for i in range(width)]) / new[width] if new else state)
        return out

    def prior(self) -> float:
        """Each half of the rows is ordered by a model fitted on the other half."""
        shares = max(1, self.n // (2 * SHARE))
        states = self._states(self.unl, shares, [(0, first_state()), (1, first_state())], 0.5, self.n // 2)
        known = self.spark.sparkContext.broadcast((states, self.mean, self.spread))
        last = WORDS + SHAPE

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            states, mean, spread = known.value
            sums = np.zeros(BINS, np.int64)
            for b in batches:
                rows, own = _Rows.read(b, mean, spread), b.column("__h").to_numpy() & 1
                for side in (0, 1):
                    z = rows.margin(states[1 - side][:last], states[1 - side][last], np.flatnonzero(own == side))
                    sums += np.histogram(np.clip(z, -MARGIN, MARGIN), EDGES)[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(sums)], names=["bin", "n"])

        n = np.zeros(BINS)
        for r in self.unl.mapInArrow(count, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():  # BINS rows
            n[r["bin"]] = r["n"]
        sp = np.zeros(len(self.pos))
        for side in (0, 1):
            mine = np.flatnonzero(self.half == side)
            sp[mine] = self.pos.margin(states[1 - side][:last], states[1 - side][last], mine)
        return tail_prior(np.clip(sp, -MARGIN, MARGIN), np.append(n[::-1].cumsum()[::-1], 0), EDGES, self.n)

    def fit(self, prior: float) -> Model:
        """Rounds over disjoint parts of the rows, so each row is dealt once; more rows give more rounds and shares."""
        total = max(1, self.n // SHARE)
        rounds = min(total, 3 + total.bit_length() // 2)
        state = first_state()
        for r in range(rounds):
            part = self.unl.filter(F.pmod(F.shiftright("__h", 1), F.lit(rounds)) == r)
            state = self._states(part, max(1, total // rounds), [(None, state)], prior, self.n // rounds)[0]
        return Model(state[: WORDS + SHAPE], float(state[WORDS + SHAPE]), prior, self.mean, self.spread)


def learn_from(table: DataFrame, positive_ids: DataFrame, prior: float | None = None, sample: int = SAMPLE, id_col: str = "doc_id") -> Model:
    """Fit on at most ``sample`` trusted positives and on every row of ``table`` (of ``features``), as unlabelled text.

    positive_ids: ids of rows that are known to be good; nulls among them are ignored. Only the sampled positives'
    features, averaged weights and histograms come to the driver. Without positives or rows all scores are about 0.
    prior: the share of good rows among all, where it is known; else it is estimated.
    """
    ids = positive_ids.select(id_col).filter(F.col(id_col).isNotNull()).distinct()
    n = ids.count()
    picked = ids if n <= sample else ids.filter(F.pmod(F.xxhash64(id_col), F.lit(10**9)) < int(1e9 * sample / n))
    picked = picked.limit(2 * sample)  # the bound of what is broadcast; hashing alone would make it likely only
    pos = table.join(F.broadcast(picked), id_col, "left_semi").select(*_NAMES).orderBy("__h").limit(sample).toArrow()
    if not pos.num_rows:
        return no_model()
    t = _Training(table, pos)
    return t.fit(t.prior() if prior is None else min(0.98, max(0.02, prior))) if t.n else no_model()


def learn_quality(docs: DataFrame, positive_ids: DataFrame, prior: float | None = None, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """``learn_from`` over the texts of ``docs``, all of which are the unlabelled web text."""
    return learn_from(stable(features(docs.select(id_col, text_col), text_col), "features"), positive_ids, prior, sample, id_col)


def score_from(table: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The columns of ``table`` (of ``features``) without the features, and score and predicted."""
    keep = [c for c in table.columns if c not in (*_NAMES, "score", "predicted")]
    src = table.select(*[F.col(f"`{c}`") for c in keep], *_NAMES)
    schema = T.StructType([*src.schema.fields[: len(keep)], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _sigmoid(_Rows.read(b, model.mean, model.spread).margin(model.weights, model.bias))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=schema.names)

    return src.mapInArrow(work, schema)


def score_quality(docs: DataFrame, model: Model, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` but its text, and score and predicted, for every row's whole text.

    Null text counts as empty and is scored as such. Columns that clash with the results are replaced.
    """
    return score_from(features(docs.drop("score", "predicted"), text_col), model, threshold)
