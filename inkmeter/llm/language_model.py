"""Log-likelihoods of whole documents under a gated recurrent language model.

Words are counted over the whole training part of the corpus. The most frequent ones are the model's own
tokens; every other word is a bucket token (by its ending) times its smoothed share of the bucket, so the model
gives every possible word a probability. Tokens fall into frequency classes, and the output is a softmax over
classes times one within the class. The model starts as the unigram model and is trained by truncated
backpropagation in numpy: streams of documents are cut into windows, gradients stop at a window's start and the
state goes on. Workers train on their own documents; their weights and step sizes are averaged after each round and go on from
there. In scoring,
many documents advance together, and each one's state is carried from window to window to its end.

Counts of words beyond the ``HEAD`` most frequent ones are joined, not broadcast.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stable, whole

#: Words whose counts every worker holds, at most; words and buckets that are tokens of the model.
HEAD, WORDS, BUCKETS = 200_000, 2048, 64
HIDDEN = 16
#: Documents that make a worker's share of a round, rounds after which the workers' weights are averaged, at least, and
#: shares of a round from which on more documents give more rounds too.
SHARE, ROUNDS, WIDE = 1024, 3, 16
#: Parallel streams, steps of a window, and Adagrad's rate.
STREAMS, WINDOW, RATE = 512, 20, 0.2
#: In scoring: documents that advance together, and steps of a window.
TOGETHER, SCORE_WINDOW = 512, 32
#: Distinct words that a task counts before it hands them on.
HELD = 400_000
#: Tokens of a share that are trained on together, and pieces in which weights are added up.
HELD_TOKENS, PIECES = 8_000_000, 64


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()  # of bytes: A-Z only, and ASCII white space only


def bucket_of(word: bytes) -> int:
    return zlib.crc32(word[-2:]) % BUCKETS


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """word, n: how often each word occurs in all whole texts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for x in b.column("text").cast(pa.binary()):
                held.update(words_of(x.as_buffer().to_pybytes()))
                if len(held) > HELD:
                    yield _batch(word=pa.array(list(held), pa.binary()), n=pa.array(list(held.values()), pa.int64()))
                    held.clear()
        yield _batch(word=pa.array(list(held), pa.binary()), n=pa.array(list(held.values()), pa.int64()))

    return docs.select(whole(text_col).alias("text")).mapInArrow(work, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _batch(**cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


@dataclass
class Vocabulary:
    """Counts, and the numbering of the model's tokens from the most frequent on."""

    head: list[bytes]
    head_counts: np.ndarray
    train_tokens: int  # N, ends included
    distinct: int  # V, the end included
    docs: int
    bucket_mass: np.ndarray  # of each bucket: (count + 1) of its words that are no tokens, and 1
    token_of_word: np.ndarray = field(init=False)  # of the first words of head
    token_of_bucket: np.ndarray = field(init=False)
    end: int = field(init=False)
    mass: np.ndarray = field(init=False)
    starts: np.ndarray = field(init=False)  # of each class, and the end

    def __post_init__(self):
        n = min(WORDS, len(self.head))
        mass = np.concatenate([self.head_counts[:n] + 1.0, self.bucket_mass, [self.docs + 1.0]])
        order = np.argsort(-mass, kind="stable")
        place = np.empty(len(mass), np.int64)
        place[order] = np.arange(len(mass))
        self.token_of_word, self.token_of_bucket, self.end, self.mass = place[:n], place[n:-1], int(place[-1]), mass[order]
        share = np.cumsum(np.sqrt(self.mass))
        cls = np.floor(share / share[-1] * np.sqrt(len(mass)) * 0.999).astype(np.int64)
        self.starts = np.concatenate([[0], np.flatnonzero(np.diff(cls)) + 1, [len(mass)]])

    @property
    def size(self) -> int:
        return len(self.mass)


def learn_vocabulary(docs: DataFrame, text_col: str = "text") -> tuple[Vocabulary, DataFrame]:
    """The vocabulary of the training documents, and the written table of all counts."""
    counts = stable(count_words(docs, text_col), "word-counts")
    n_docs = docs.count()
    level = F.floor(F.log2("n") * 16).cast("int")
    by_level = sorted(((r["l"], r["k"], r["s"]) for r in counts.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s")).collect()), reverse=True)  # 16 a doubling
    held, first = 0, None  # the levels that are head words as a whole
    chosen = F.lit(False)
    for lev, k, _ in by_level:
        if held + k > HEAD:  # of the next level, as many as there is room for, by a hash of the word
            chosen = (level == lev) & (F.pmod(F.xxhash64("word"), F.lit(10**9)) < int(0.95e9 * (HEAD - held) / k))
            break
        held, first = held + k, lev
    picked = counts.filter(chosen if first is None else chosen | (level >= first))
    t = picked.limit(HEAD).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    head, sizes = t.column("word").to_pylist(), t.column("n").to_numpy().astype(float)
    tokens, distinct = sum(s for _, _, s in by_level), sum(k for _, k, _ in by_level)

    own = frozenset(head[:WORDS])

    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(BUCKETS)
        for b in batches:
            for w, n in zip(b.column("word").to_pylist(), b.column("n").to_pylist(), strict=True):
                if w not in own:
                    sums[bucket_of(w)] += n + 1
        yield _batch(bucket=pa.array(np.arange(BUCKETS)), mass=pa.array(sums))

    mass = np.ones(BUCKETS)
    for r in counts.mapInArrow(rest, "bucket long, mass double").groupBy("bucket").agg(F.sum("mass").alias("mass")).collect():
        mass[r["bucket"]] += r["mass"]
    return Vocabulary(head, sizes, tokens + n_docs, distinct + (n_docs > 0), n_docs, mass), counts


NAMES = ("gates", "rec", "rec_b", "cls", "cls_b", "out", "out_b")


class Weights:
    """The model's parameters as views into one flat vector."""

    def __init__(self, vocab_size: int, classes: int, hidden: int = HIDDEN, flat: np.ndarray | None = None):
        shapes = {"gates": (vocab_size, 3 * hidden), "rec": (hidden, 3 * hidden), "rec_b": (3 * hidden,), "cls": (classes, hidden), "cls_b": (classes,), "out": (vocab_size, hidden), "out_b": (vocab_size,)}
        total = sum(int(np.prod(s)) for s in shapes.values())
        self.flat = np.zeros(total, np.float32) if flat is None else flat
        at = 0
        for name, s in shapes.items():
            n = int(np.prod(s))
            setattr(self, name, self.flat[at : at + n].reshape(s))
            at += n
        self.hidden, self.vocab_size, self.classes = hidden, vocab_size, classes

    def like(self, flat: np.ndarray | None = None) -> Weights:
        return Weights(self.vocab_size, self.classes, self.hidden, flat)


def first_weights(v: Vocabulary, seed: int = 3) -> Weights:
    """Small random weights, and biases that give the unigram model."""
    w = Weights(v.size, len(v.starts) - 1)
    rng = np.random.default_rng(seed)
    for name, scale in (("gates", 0.3), ("rec", 0.25), ("cls", 0.02), ("out", 0.02)):
        a = getattr(w, name)
        a[:] = rng.normal(0, scale, a.shape)
    w.rec_b[: w.hidden] = 1.0  # a state lasts at first
    sums = np.add.reduceat(v.mass, v.starts[:-1])
    w.cls_b[:] = np.log(sums / sums.sum())
    w.out_b[:] = np.log(v.mass / np.repeat(sums, np.diff(v.starts)))
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1.0)


def step(w: Weights, x: np.ndarray, h: np.ndarray):
    """One step of the recurrent unit: keep gate, reset gate, candidate."""
    d = w.hidden
    g, a = w.gates[x], h @ w.rec + w.rec_b
    s = _sigmoid(g[:, : 2 * d] + a[:, : 2 * d])
    keep, reset = s[:, :d], s[:, d:]
    new = np.tanh(g[:, 2 * d :] + reset * a[:, 2 * d :])
    return new + keep * (h - new), (keep, reset, new, a[:, 2 * d :])


def bounded(weight: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no exponential of logits can overflow: states lie in [-1, 1], so the rows' sums bound them."""
    return bool((np.abs(weight).sum(1) + np.abs(bias)).max(initial=0.0) < 80.0)


def _exponentials(z: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray | float]:
    """exp of each row of logits in place, and what was taken off before."""
    top: np.ndarray | float = 0.0
    if not safe:
        top = z.max(1)
        z -= top[:, None]
    return np.exp(z, out=z), top


def log_probs(w: Weights, starts: np.ndarray, cls_of: np.ndarray, states: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log-probability of each target: of its class, and of it within the class."""
    c = cls_of[target]
    order = by_number(c)
    # by class from here on, so that a class's rows stand together
    s, y, c, rows = states[order], target[order], c[order], np.arange(len(target))
    z = s @ w.cls.T
    z += w.cls_b
    said = z[rows, c]
    e, top = _exponentials(z, bounded(w.cls, w.cls_b))
    p = said - top - np.log(e @ np.ones(e.shape[1], e.dtype))
    safe = bounded(w.out, w.out_b)
    cut = np.searchsorted(c, np.arange(len(starts)))
    for k in np.flatnonzero(np.diff(cut)).tolist():
        a, b = starts[k], starts[k + 1]
        if b - a == 1:
            continue
        i, j = cut[k], cut[k + 1]
        z = s[i:j] @ w.out[a:b].T
        z += w.out_b[a:b]
        said = z[rows[: j - i], y[i:j] - a]
        e, top = _exponentials(z, safe)
        p[i:j] += said - top - np.log(e @ np.ones(b - a, e.dtype))
    out = np.empty_like(p)
    out[order] = p
    return out


def by_number(x: np.ndarray) -> np.ndarray:
    """The stable order of small numbers; 16 bits are sorted by radix."""
    return np.argsort(x.astype(np.uint16) if x.max(initial=0) < 1 << 16 else x, kind="stable")


def gradients(w: Weights, starts: np.ndarray, cls_of: np.ndarray, xs: np.ndarray, ys: np.ndarray, h0: np.ndarray, end: int) -> tuple[Weights, np.ndarray, float]:
    """Of the mean negative log-probability over a window (time by stream), the last state and the mean."""
    steps, b = xs.shape
    d, n = w.hidden, xs.size
    h, seen = h0, []
    states = np.empty((steps, b, d), np.float32)
    befores = np.empty((steps, b, d), np.float32)
    for t in range(steps):
        fresh = (xs[t] != end)[:, None]  # a new document starts from nothing
        before = np.multiply(h, fresh, out=befores[t])
        h, parts = step(w, xs[t], before)
        states[t] = h
        seen.append((fresh, parts))
    g = w.like()
    y = ys.ravel()
    c = cls_of[y]
    order = by_number(c)
    # by class from here on, so that a class's rows stand together
    s, y, c = states.reshape(n, d)[order], y[order], c[order]
    rows = np.arange(n)
    z = s @ w.cls.T
    z += w.cls_b
    p, _ = _exponentials(z, bounded(w.cls, w.cls_b))
    p *= (1 / (n * (p @ np.ones(p.shape[1], p.dtype))))[:, None]
    loss = -np.log(n * p[rows, c]).sum()
    p[rows, c] -= 1 / n
    g.cls[:], g.cls_b[:] = p.T @ s, np.ones(n, p.dtype) @ p
    ds = p @ w.cls
    cut = np.searchsorted(c, np.arange(len(starts)))
    safe = bounded(w.out, w.out_b)
    for k in np.flatnonzero(np.diff(cut)).tolist():
        a, e = starts[k], starts[k + 1]
        if e - a == 1:
            continue
        i, j = cut[k], cut[k + 1]
        own, out = s[i:j], w.out[a:e]
        z = own @ out.T
        z += w.out_b[a:e]
        q, _ = _exponentials(z, safe)
        q *= (1 / (n * (q @ np.ones(e - a, q.dtype))))[:, None]
        at = (rows[: j - i], y[i:j] - a)
        loss -= np.log(n * q[at]).sum()
        q[at] -= 1 / n
        g.out[a:e], g.out_b[a:e] = q.T @ own, np.ones(j - i, q.dtype) @ q
        ds[i:j] += q @ out
    back = np.empty_like(ds)
    back[order] = ds
    ds = back.reshape(steps, b, d)
    dh = np.zeros((b, d), np.float32)
    dx = np.empty((steps, b, 3 * d), np.float32)
    da = np.empty((steps, b, 3 * d), np.float32)
    rec = np.ascontiguousarray(w.rec.T)
    for t in range(steps - 1, -1, -1):
        fresh, (keep, reset, new, inner) = seen[t]
        dh += ds[t]
        gone = 1 - keep
        dnew = dh * gone
        dx[t, :, :d] = dnew * (befores[t] - new) * keep
        dnew *= 1 - new * new
        dx[t, :, d : 2 * d] = dnew * inner * reset * (1 - reset)
        dx[t, :, 2 * d :] = dnew
        da[t, :, : 2 * d] = dx[t, :, : 2 * d]
        np.multiply(dnew, reset, out=da[t, :, 2 * d :])
        dh = (dh * keep + da[t] @ rec) * fresh
    flat = da.reshape(n, 3 * d)
    g.rec[:], g.rec_b[:] = befores.reshape(n, d).T @ flat, np.ones(n, np.float32) @ flat
    x = xs.ravel()
    by = by_number(x)
    first = np.concatenate([[0], np.flatnonzero(np.diff(x[by])) + 1])
    g.gates[x[by[first]]] = np.add.reduceat(dx.reshape(n, 3 * d)[by], first, axis=0)
    return g, h, float(loss / n)


def first_squares(w: Weights) -> np.ndarray:
    return np.full(w.flat.shape, 1e-6, np.float32)


def by_rows(w: Weights, square: np.ndarray) -> np.ndarray:
    """The mean of the squares of each row of each parameter: what a share tells of its step sizes."""
    v = w.like(square)
    return np.concatenate([getattr(v, n).reshape(len(getattr(v, n)), -1).mean(1) for n in NAMES]).astype(np.float32)


def from_rows(w: Weights, rows: np.ndarray) -> np.ndarray:
    """Sums of squares that are alike within a row."""
    v = w.like(np.empty_like(w.flat))
    at = 0
    for n in NAMES:
        a = getattr(v, n)
        a.reshape(len(a), -1)[:] = rows[at : at + len(a), None]
        at += len(a)
    return v.flat


def rounds_and_shares(docs: int) -> tuple[int, int]:
    """More documents give more shares, and by their logarithm more rounds: training deepens with the corpus."""
    total = max(1, docs // SHARE)
    rounds = max(ROUNDS, min(total // WIDE, ROUNDS + total.bit_length()))
    return rounds, max(1, total // rounds)


def train(w: Weights, v: Vocabulary, docs: list[np.ndarray], rate: float = RATE, square: np.ndarray | None = None) -> int:
    """Adagrad over the documents in place, as parallel streams in windows; returns the tokens seen.

    square: the sums of squares so far, changed in place too. Streams are of one length: the last one goes on with the first tokens, so none is left out.
    """
    if not docs:
        return 0
    flat = np.concatenate([x for d in docs for x in ([v.end], d)] + [[v.end]]).astype(np.int64)
    streams = max(1, min(STREAMS, (len(flat) - 1) // WINDOW))
    length = -(-(len(flat) - 1) // streams)
    at = (np.arange(streams * length) % (len(flat) - 1)).reshape(streams, length).T
    xs, ys = flat[at], flat[at + 1]
    cls_of = np.repeat(np.arange(len(v.starts) - 1), np.diff(v.starts))
    h = np.zeros((streams, w.hidden), np.float32)
    square = first_squares(w) if square is None else square
    for t in range(0, length, WINDOW):
        g, h, _ = gradients(w, v.starts, cls_of, xs[t : t + WINDOW], ys[t : t + WINDOW], h, v.end)
        norm = float(np.linalg.norm(g.flat))
        if norm > 1.0:
            g.flat /= norm
        square += g.flat * g.flat
        w.flat -= rate * g.flat / np.sqrt(square)
    return xs.size


_loaded: dict = {}


def _lookup(shared: Broadcast) -> tuple[Vocabulary, dict[bytes, int], np.ndarray]:
    """The head as a dictionary, and the token of each head word; one for each worker process."""
    if _loaded.get("id") != shared.value["id"]:
        v: Vocabulary = shared.value["vocabulary"]
        token = np.array([*v.token_of_word, *v.token_of_bucket[[bucket_of(w) for w in v.head[len(v.token_of_word) :]]]], np.int64)
        _loaded.update(id=shared.value["id"], got=(v, {w: k for k, w in enumerate(v.head)}, token))
    return _loaded["got"]


def _tokens(v: Vocabulary, head: dict[bytes, int], token: np.ndarray, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Tokens, places in the head (-1: not there) and the words that aren't there."""
    get = head.get
    at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
    out = token[at] if len(token) else np.zeros(len(at), np.int64)
    gone = np.flatnonzero(at < 0)
    rare = [words[i] for i in gone]
    if rare:
        out[gone] = v.token_of_bucket[[bucket_of(w) for w in rare]]
    return out, at, rare


def tokenised(docs: DataFrame, v: Vocabulary, shared: Broadcast, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """The written table of every document's tokens (16 bits each, its end left out) and of all that its text alone tells.

    Texts are read and cut into words once, for learning and scoring. uid names a row, h deals it to a round and a share.
    """
    from pyspark.sql import types as T

    src = docs.select(F.col(id_col).alias("id"), *carry, F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), whole(text_col).alias("text"))
    schema = T.StructType([*src.schema.fields[:-1], *T._parse_datatype_string("uid long, n_tokens long, known long, base double, extra double, rare array<binary>, times array<int>, toks binary").fields])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, head, token = _lookup(shared)
        log_c = np.log10(v.head_counts + 1)
        log_mass = np.log10(v.bucket_mass)
        place = np.full(v.size, -1)
        place[v.token_of_bucket] = np.arange(BUCKETS)  # bucket of a token
        uid = TaskContext.get().partitionId() << 40
        log_end = np.log10(v.docs + 1)
        for b in batches:
            toks, base, known, extra, n_tok, rare_words, times = [], [], [], [], [], [], []
            for text in b.column("text").cast(pa.binary()):
                t, at, rare = _tokens(v, head, token, words_of(text.as_buffer().to_pybytes()))
                there = log_c[at[at >= 0]].sum()
                k = place[t]
                k = k[k >= 0]
                # a bucket word's share of its bucket: head words' counts here, rare words' after the join
                extra.append(log_c[at[at >= len(v.token_of_word)]].sum() - log_mass[k].sum())
                base.append(there + log_end)
                known.append(len(at) - len(rare) + (v.docs > 0))
                n_tok.append(len(at) + 1)
                c = Counter(rare)
                rare_words.append(list(c))
                times.append(list(c.values()))
                toks.append(t.astype("<u2").tobytes())
            cols = [pa.array(np.arange(uid, uid + len(toks))), pa.array(n_tok, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(extra, pa.float64()), pa.array(rare_words, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int32())), pa.array(toks, pa.binary())]
            uid += len(toks)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=schema.names)

    return stable(src.mapInArrow(work, schema), "tokens")


def learn_weights(docs: DataFrame, v: Vocabulary, shared: Broadcast, id_col: str = "doc_id", text_col: str = "text") -> Weights:
    """Train on every document; see ``learn_from``."""
    return learn_from(tokenised(docs, v, shared, id_col, text_col), v) if v.docs else first_weights(v)


def learn_from(table: DataFrame, v: Vocabulary) -> Weights:
    """Train on every row of ``tokenised``, dealt to rounds and shares by a hash; weights and Adagrad's sums are averaged by tokens."""
    spark = table.sparkSession
    w = first_weights(v)
    square = first_squares(w)
    part = table.select("h", "toks")
    if not v.docs:
        return w
    shared = spark.sparkContext.broadcast(replace(v, head=v.head[:WORDS], head_counts=v.head_counts[:WORDS]))  # what training reads of it
    rounds, shares = rounds_and_shares(v.docs)
    for r in range(rounds):
        now = spark.sparkContext.broadcast((w.flat, square))

        def work(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            v = shared.value
            flat, square = (x.copy() for x in now.value)
            own = Weights(v.size, len(v.starts) - 1, HIDDEN, flat)
            seen, held, size = 0, [], 0

            def go_on() -> int:
                texts = sorted(held, key=lambda x: x[0])
                held.clear()
                return train(own, v, [t for _, t in texts], square=square)

            for b in batches:
                for h, x in zip(b.column("h").to_pylist(), b.column("toks").to_pylist(), strict=True):
                    t = np.frombuffer(x, "<u2").astype(np.int32)
                    held.append(((h, t.tobytes()), t))
                    size += len(t)
                if size > HELD_TOKENS:  # however long the texts of a share are, so many tokens are held
                    seen, size = seen + go_on(), 0
            if held:
                seen += go_on()
            if seen:
                cut = np.array_split(np.concatenate([flat, by_rows(own, square)]), PIECES)
                yield _batch(piece=pa.array(np.arange(PIECES)), means=pa.array(cut, pa.list_(pa.float32())), seen=pa.array(np.full(PIECES, seen)))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            seen: Counter = Counter()
            for b in batches:
                for p, x, k in zip(b.column("piece").to_pylist(), b.column("means"), b.column("seen").to_pylist(), strict=True):
                    x = x.values.to_numpy().astype(np.float64) * k
                    sums[p] = sums[p] + x if p in sums else x
                    seen[p] += k
            if sums:
                yield _batch(piece=pa.array(list(sums), pa.int64()), sums=pa.array(list(sums.values()), pa.list_(pa.float64())), seen=pa.array([seen[p] for p in sums], pa.int64()))

        mine = part.filter(F.pmod(F.col("h"), F.lit(rounds)) == r).repartition(shares, "h").mapInArrow(work, "piece long, means array<float>, seen long")
        got = mine.repartition("piece").mapInArrow(add, "piece long, sums array<double>, seen long").toArrow().sort_by("piece")  # PIECES rows
        total = got.column("seen")[0].as_py() if got.num_rows else 0
        if total:
            both = (np.concatenate([np.asarray(x.values) for x in got.column("sums")]) / total).astype(np.float32)
            w = w.like(both[: len(w.flat)].copy())
            square = from_rows(w, both[len(w.flat) :])
    return w


def score_group(w: Weights, v: Vocabulary, cls_of: np.ndarray, docs: list[np.ndarray]) -> np.ndarray:
    """Natural log-probability of each document with its end, all advancing together."""
    size = np.array([len(d) for d in docs])
    order = np.argsort(-size, kind="stable")
    lens = size[order]
    start = np.concatenate([[0], np.cumsum(lens + 1)[:-1]])
    flat = np.concatenate([x for k in order for x in (docs[k], [v.end])]).astype(np.int64)
    total = np.zeros(len(docs))
    h = np.zeros((len(docs), w.hidden), np.float32)
    x = np.full(len(docs), v.end)
    t, live = 0, len(docs)
    while live:
        states, target, owner = [], [], []
        for _ in range(SCORE_WINDOW):
            live = int(np.searchsorted(-lens, -t, side="right"))  # a document of n words has n + 1 targets
            if not live:
                break
            h, _parts = step(w, x[:live], h[:live])
            x = flat[start[:live] + t]
            states.append(h)
            target.append(x)
            owner.append(live)
            t += 1
        if states:
            p = log_probs(w, v.starts, cls_of, np.concatenate(states), np.concatenate(target))
            total += np.bincount(np.concatenate([np.arange(k) for k in owner]), p, len(docs))
    out = np.empty(len(docs))
    out[order] = total
    return out


def score_documents(docs: DataFrame, v: Vocabulary, counts: DataFrame, w: Weights, shared: Broadcast, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """id, ``carry``, n_tokens, n_known, train_tokens, base_score, score of every whole document."""
    return score_from(tokenised(docs, v, shared, id_col, text_col, carry), v, counts, w, id_col, carry)


def score_from(table: DataFrame, v: Vocabulary, counts: DataFrame, w: Weights, id_col: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """``score_documents`` of a table of tokens."""
    weights = table.sparkSession.sparkContext.broadcast((w.flat, w.vocab_size, w.classes, w.hidden))
    small = table.sparkSession.sparkContext.broadcast(replace(v, head=v.head[:WORDS], head_counts=v.head_counts[:WORDS]))
    from pyspark.sql import types as T

    src = table.select("id", *carry, "uid", "n_tokens", "known", "base", "extra", "toks")
    schema = T.StructType([*src.schema.fields[:-2], T.StructField("model", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = small.value
        flat, *shape = weights.value
        own = Weights(*shape, flat=flat)
        cls_of = np.repeat(np.arange(len(v.starts) - 1), np.diff(v.starts))
        for b in batches:
            toks = [np.frombuffer(x, "<u2").astype(np.int32) for x in b.column("toks").to_pylist()]
            size = np.array([len(t) for t in toks])
            order = np.argsort(-size, kind="stable")
            model = np.zeros(len(toks))
            for g in range(0, len(order), TOGETHER):
                rows = order[g : g + TOGETHER]
                model[rows] = score_group(own, v, cls_of, [toks[k] for k in rows]) / np.log(10)
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(model + b.column("extra").to_numpy())], names=schema.names)

    scored = stable(src.mapInArrow(work, schema), "scores")
    tail = table.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("uid", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    found = tail.join(counts, "word").groupBy("uid").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_log"), F.sum("times").alias("rare_known"))
    total = float(np.log10(v.train_tokens + v.distinct + 1))
    rare = F.coalesce("rare_log", F.lit(0.0))
    return (
        scored.join(found, "uid", "left")
        .select(
            F.col("id").alias(id_col), *carry, "n_tokens", (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(v.train_tokens).cast("long").alias("train_tokens"),
            (F.col("base") + rare - F.col("n_tokens") * total).alias("base_score"), (F.col("model") + rare).alias("score"),
        )
    )


def language_model_scores(docs: DataFrame, training: DataFrame | str, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Learn from ``training`` and score ``docs``: one row per row of ``docs``, repeated rows too.

    training: a table, or a condition on the columns ``carry`` of ``docs``; the latter spares a second reading.
    Null text is empty and has one token, its end. base_score: sum over tokens of log10((c + 1) / (N + V + 1));
    score: the model's log10 probability of the words and the end. Without training documents every count is 0.
    """
    import uuid

    within = isinstance(training, str)
    v, counts = learn_vocabulary(docs.filter(training) if within else training, text_col)
    shared = docs.sparkSession.sparkContext.broadcast({"id": uuid.uuid4().hex, "vocabulary": v})
    table = tokenised(docs, v, shared, id_col, text_col, carry)
    w = learn_from(table.filter(training), v) if within else learn_weights(training, v, shared, id_col, text_col)
    return score_from(table, v, counts, w, id_col, carry)
