import math
import zlib
from collections import Counter

import numpy as np

from inkmeter.llm import language_model as LM
from inkmeter.llm.common import read_table
from inkmeter.llm.queries import op3_language_model

from .helpers import ODD, clashing, docs

SF = "/root/testdata/sf0.001"


def words(text):
    return (text or "").encode().lower().split()


def base(rows, training):
    c = Counter()
    for t in training:
        c.update([*words(t), None])
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        w = [*words(t), None]
        out.append((i, len(w), sum(c[x] > 0 for x in w), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w)))
    return out


def same(got, want):
    key = lambda x: (str(x[0]), round(x[4], 5))
    a = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key)
    b = sorted(want, key=key)
    return len(a) == len(b) and all(x[:4] == y[:4] and abs(x[4] - y[4]) < 1e-6 * max(1, abs(y[4])) for x, y in zip(a, b))


def test_counts_equal_brute_force_and_rare_words_are_joined(spark, monkeypatch):
    monkeypatch.setattr(LM, "HEAD", 300)
    monkeypatch.setattr(LM, "WORDS", 100)
    rows = [(r.doc_id, r.text) for r in read_table(spark, SF, "documents").collect()]
    got = op3_language_model(spark, SF).collect()
    assert same(got, base(rows, [t for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]))


def test_model_beats_the_base(spark):
    got = op3_language_model(spark, "/root/testdata/sf0.01").filter("held_out").collect()
    n = sum(r.n_tokens for r in got)
    assert sum(r.score for r in got) / n > sum(r.base_score for r in got) / n + 0.05


def test_odd_rows_and_empty_tables(spark):
    d = docs(spark, ODD)
    got = LM.language_model_scores(clashing(d, "score", "n_tokens", "uid"), d).collect()
    assert same(got, base([(i, t) for i, t, *_ in ODD], [t for _, t, *_ in ODD])) and all(r.score < 0 for r in got)
    assert LM.language_model_scores(d.limit(0), d).collect() == []
    got = LM.language_model_scores(d, d.limit(0)).collect()
    assert same(got, base([(i, t) for i, t, *_ in ODD], []))


def small(n_words=30, docs_=20):
    head = [f"w{k}".encode() for k in range(n_words)]
    return LM.Vocabulary(head, np.arange(n_words, 0, -1) * 10.0, 5000, n_words + 1, docs_, np.ones(LM.BUCKETS))


def test_probabilities_sum_to_one_and_state_is_carried():
    v = small()
    w = LM.first_weights(v)
    rng = np.random.default_rng(1)
    w.flat += rng.normal(0, 0.3, w.flat.shape).astype(np.float32)
    cls = np.repeat(np.arange(len(v.starts) - 1), np.diff(v.starts))
    h = rng.normal(0, 1, (1, LM.HIDDEN)).astype(np.float32)
    p = LM.log_probs(w, v.starts, cls, np.repeat(h, v.size, 0), np.arange(v.size))
    assert abs(np.exp(p).sum() - 1) < 1e-4
    docs_ = [rng.integers(0, v.size, n) for n in (0, 1, 5, 40, 131, 77)]
    got = LM.score_group(w, v, cls, docs_)
    for d, s in zip(docs_, got):
        h, x, total = np.zeros((1, LM.HIDDEN), np.float32), v.end, 0.0
        for y in [*d.tolist(), v.end]:
            h, _ = LM.step(w, np.array([x]), h)
            total += LM.log_probs(w, v.starts, cls, h, np.array([y]))[0]
            x = y
        assert abs(total - s) < 1e-3 * max(1, abs(total))


def test_gradients_equal_differences():
    v = small()
    w = LM.first_weights(v)
    rng = np.random.default_rng(2)
    w = w.like((w.flat + rng.normal(0, 0.3, w.flat.shape)).astype(np.float64))
    cls = np.repeat(np.arange(len(v.starts) - 1), np.diff(v.starts))
    xs, ys = rng.integers(0, v.size, (6, 3)), rng.integers(0, v.size, (6, 3))
    xs[3, 1] = v.end
    h0 = np.zeros((3, LM.HIDDEN))
    loss = lambda: LM.gradients(w, v.starts, cls, xs, ys, h0, v.end)[2]
    g = LM.gradients(w, v.starts, cls, xs, ys, h0, v.end)[0].flat.copy()
    for k in [*np.argsort(-np.abs(g))[:15], *rng.integers(0, len(g), 10)]:
        old = w.flat[k]
        w.flat[k] = old + 1e-3
        up = loss()
        w.flat[k] = old - 1e-3
        down = loss()
        w.flat[k] = old
        assert abs((up - down) / 2e-3 - g[k]) < 2e-3 * max(0.05, abs(g[k]))


def test_every_token_of_a_share_is_trained_on():
    v = small()
    rng = np.random.default_rng(4)
    docs_ = [rng.integers(0, v.size, n) for n in (97, 0, 1211, 56)]
    last = next(k for k in range(v.size) if k != v.end)
    docs_ = [np.where(d == last, v.end, d) for d in docs_]
    docs_[-1][-3:] = last  # only in the tail after equal streams
    w = LM.first_weights(v)
    first = w.gates[last].copy()
    assert LM.train(w, v, docs_) >= sum(len(d) + 1 for d in docs_)
    assert (w.gates[last] != first).any()


def test_every_training_document_reaches_the_weights(spark):
    rows = [(n, f"only{n} " * 40, "en", "a") for n in range(40)]
    d = docs(spark, rows)
    v, _ = LM.learn_vocabulary(d)
    w = LM.learn_weights(d, v, spark.sparkContext.broadcast({"id": "every", "vocabulary": v}))
    moved = (w.gates != LM.first_weights(v).gates).any(1)
    assert moved[v.token_of_word].all()


def slow_score(text, v, w, counts):
    """log10 of the model's probability, word by word in plain Python."""
    exp = lambda xs: [math.exp(x) for x in xs]
    dot = lambda a, b: sum(float(x) * float(y) for x, y in zip(a, b))
    sig = lambda x: 1 / (1 + math.exp(-x))
    d = w.hidden
    own = {x: int(t) for x, t in zip(v.head, v.token_of_word)}
    cls_of = [k for k in range(len(v.starts) - 1) for _ in range(v.starts[k], v.starts[k + 1])]
    h, x, total = [0.0] * d, v.end, 0.0
    for word in [*words(text), None]:
        y, share = v.end, 0.0
        if word is not None:
            b = LM.bucket_of(word)
            y = own.get(word, int(v.token_of_bucket[b]))
            share = 0.0 if word in own else math.log((counts.get(word, 0) + 1) / v.bucket_mass[b])
        a = [dot(h, w.rec[:, j]) + float(w.rec_b[j]) for j in range(3 * d)]
        g = [float(z) for z in w.gates[x]]
        keep, reset = [sig(g[j] + a[j]) for j in range(d)], [sig(g[d + j] + a[d + j]) for j in range(d)]
        new = [math.tanh(g[2 * d + j] + reset[j] * a[2 * d + j]) for j in range(d)]
        h = [new[j] + keep[j] * (h[j] - new[j]) for j in range(d)]
        c = cls_of[y]
        e = exp([dot(row, h) + float(b0) for row, b0 in zip(w.cls, w.cls_b)])
        total += math.log(e[c] / sum(e)) + share
        at, z = v.starts[c], v.starts[c + 1]
        e = exp([dot(row, h) + float(b0) for row, b0 in zip(w.out[at:z], w.out_b[at:z])])
        total += math.log(e[y - at] / sum(e))
        x = y
    return total / math.log(10)


def test_scores_equal_a_slow_version(spark, monkeypatch):
    monkeypatch.setattr(LM, "HEAD", 60)
    monkeypatch.setattr(LM, "WORDS", 25)
    texts = [r.text for r in read_table(spark, SF, "documents").limit(40).collect()]
    rows = [(k, t[:400], "en", "a") for k, t in enumerate(texts)] + [(100, None, "en", "a"), (101, "never seen words", "en", "a"), (102, "The the THE \n the", "en", "a")]
    d = docs(spark, rows)
    training = d.filter("doc_id < 100")
    v, table = LM.learn_vocabulary(training)
    shared = spark.sparkContext.broadcast({"id": "slow", "vocabulary": v})
    w = LM.learn_weights(training, v, shared)
    assert 0 < len(v.head) <= 60
    counts = {bytes(r.word): r.n for r in table.collect()}
    for r in LM.score_documents(d, v, table, w, shared).collect():
        want = slow_score(rows[[x[0] for x in rows].index(r.doc_id)][1], v, w, counts)
        assert abs(r.score - want) < 1e-3 * max(1, abs(want))


def test_more_documents_give_more_rounds():
    got = [LM.rounds_and_shares(n) for n in (0, 10, 8_000, 44_000, 220_000, 10**9)]
    assert got[0] == (3, 1) and [r for r, _ in got] == sorted(r for r, _ in got) and got[-1][0] > 20 and got[-1][1] > 10_000


def test_a_head_wider_than_its_bound_is_not_empty(spark, monkeypatch):
    monkeypatch.setattr(LM, "HEAD", 50)
    d = docs(spark, [(k, f"w{k} v{k}", "en", "a") for k in range(300)])
    v, _ = LM.learn_vocabulary(d)
    assert 10 < len(v.head) <= 50


def test_step_sizes_by_rows():
    w = LM.first_weights(small())
    square = np.arange(len(w.flat), dtype=np.float32)
    back = w.like(LM.from_rows(w, LM.by_rows(w, square)))
    mine = w.like(square)
    assert np.allclose(back.gates, mine.gates.mean(1, keepdims=True)) and np.allclose(back.rec_b, mine.rec_b) and np.allclose(back.out_b, mine.out_b)


def test_texts_are_cut_into_words_once_for_learning_and_scoring(spark):
    """A condition on the scored rows gives what a table of training rows gives; learning needs no text."""
    rows = [(n, " ".join(f"w{(n * k) % 23}" for k in range(n % 40)), "en", "a") for n in range(300)] + [(None, None, "en", "a"), (7, "w1 w2", "en", "a")]
    d = docs(spark, rows).selectExpr("*", "coalesce(doc_id % 7 = 2, false) held_out")
    one = LM.language_model_scores(d, "NOT held_out", carry=("held_out",)).collect()
    two = LM.language_model_scores(d, d.filter("NOT held_out"), carry=("held_out",)).collect()
    key = lambda r: (str(r.doc_id), r.n_tokens)
    assert len(one) == len(two) == len(rows)
    for a, b in zip(sorted(one, key=key), sorted(two, key=key)):
        assert a[:5] == b[:5] and abs(a.base_score - b.base_score) < 1e-9 and abs(a.score - b.score) < 1e-3
    v, _ = LM.learn_vocabulary(d)
    shared = spark.sparkContext.broadcast({"id": "once", "vocabulary": v})
    table = LM.tokenised(d, v, shared).select("h", "toks")
    assert np.abs(LM.learn_from(table, v).flat - LM.learn_weights(d, v, shared).flat).max() < 1e-3


def test_numbers_are_ordered_stably():
    rng = np.random.default_rng(14)
    for top in (3, 2113, 1 << 16, 1 << 20):
        x = rng.integers(0, top, 5000)
        assert (LM.by_number(x) == np.argsort(x, kind="stable")).all()
    assert len(LM.by_number(np.zeros(0, np.int64))) == 0
