import math
import zlib

import numpy as np

from inkmeter.llm import quality as Q
from inkmeter.llm.common import read_table
from inkmeter.llm.queries import op6_quality

from .helpers import ODD, clashing, docs

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = op6_quality(spark, SF).join(read_table(spark, SF, "labels"), "doc_id").filter("held_out").collect()
    good, bad = [r for r in got if r.quality == 1], [r for r in got if r.quality == 0]
    assert sum(r.predicted for r in good) >= 0.97 * len(good) > 30
    assert sum(1 - r.predicted for r in bad) >= 0.7 * len(bad) > 3
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


def test_odd_rows(spark):
    d = docs(spark, ODD)
    m = Q.learn_quality(d, spark.createDataFrame([(4,), (7,), (None,), (4,), (99,)], "doc_id long"))
    got = Q.score_quality(clashing(d.select("doc_id", "text"), "score", "predicted"), m).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)


def test_without_positives_or_rows(spark):
    d = docs(spark, ODD)
    m = Q.learn_quality(d, d.select("doc_id").limit(0))
    assert {r.predicted for r in Q.score_quality(d.select("doc_id", "text"), m).collect()} == {0}
    assert Q.score_quality(d.select("doc_id", "text").limit(0), m).collect() == []


def rows(rng, good, n):
    return [(Q._SHAPES, rng.normal(1.0 if good else -1.0, 0.7, Q.SHAPE)) for _ in range(n)]


def test_prior_of_separable_tails():
    rng = np.random.default_rng(8)
    sp = rng.normal(1, 0.7, 1500)
    su = np.concatenate([rng.normal(1, 0.7, 9000), rng.normal(-1, 0.7, 6000)])
    above = np.array([(su >= e).sum() for e in Q.EDGES])
    assert abs(Q.tail_prior(sp, above, Q.EDGES, len(su)) - 0.6) < 0.05


def slow_risk(w, b, pos, unl, prior):
    """The non-negative risk, row by row."""
    z = lambda r: sum(w[i] * v for i, v in zip(*r)) + b
    loss = lambda z, y: math.log1p(math.exp(-z if y else z))
    mean = lambda xs: sum(xs) / len(xs)
    negative = mean([loss(z(r), 0) for r in unl]) - prior * mean([loss(z(r), 0) for r in pos])
    return prior * mean([loss(z(r), 1) for r in pos]) + max(0.0, negative), negative


def test_risk_and_gradient_equal_a_slow_version():
    rng = np.random.default_rng(3)
    pos, unl = rows(rng, True, 7), rows(rng, True, 5) + rows(rng, False, 6)
    P, U = Q._Rows.of(pos), Q._Rows.of(unl)
    every = lambda r: r.take(np.arange(len(r)))
    signs = set()
    for prior, shift in ((0.4, 0.0), (0.95, 2.0), (0.98, 5.0)):
        w, b = np.zeros(Q.WORDS + Q.SHAPE), shift
        w[Q.WORDS :] = rng.normal(0, 0.3, Q.SHAPE) + (1.0 if shift == 5.0 else 0.0)
        risk, g, g0 = Q.risk_gradient(w, b, every(P), len(P), every(U), len(U), prior)
        want, negative = slow_risk(w, b, pos, unl, prior)
        assert abs(risk - want) < 1e-9
        signs.add(negative >= 0)
        for k in [*range(Q.WORDS, Q.WORDS + Q.SHAPE), None]:
            def at(d):
                w2 = w.copy()
                if k is not None:
                    w2[k] += d
                r, n = slow_risk(w2, b + (d if k is None else 0), pos, unl, prior)
                return r if negative >= 0 else -n  # below zero the step undoes the negative part
            assert abs((at(1e-5) - at(-1e-5)) / 2e-5 - (g0 if k is None else g[k])) < 1e-6
    assert signs == {True, False}


def test_scores_equal_a_slow_version(spark):
    texts = ["one two two, Three\n| 4 4", "", None, "x " * 3000 + "yy", "é É ee. Ok! done? !! ..", " ".join(f"w{k}" for k in range(4000))]
    rng = np.random.default_rng(4)
    m = Q.Model(rng.normal(0, 1, Q.WORDS + Q.SHAPE), 0.2, 0.5, rng.normal(0, 0.1, Q.SHAPE), np.full(Q.SHAPE, 0.5))
    got = {r.doc_id: r.score for r in Q.score_quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), m).collect()}
    for k, t in enumerate(texts):
        words = (t or "").encode().lower().split()
        sums = {}
        for w in words:
            sums[zlib.crc32(w) % Q.WORDS] = sums.get(zlib.crc32(w) % Q.WORDS, 0) + 1
        z = m.bias + sum(m.weights[i] * math.sqrt(n / len(words)) for i, n in sums.items())
        shape = Q.Features()((t or "").encode())[3]
        z += sum(m.weights[Q.WORDS + j] * max(-Q.REACH, min(Q.REACH, (float(shape[j]) - m.mean[j]) / m.spread[j])) for j in range(Q.SHAPE))
        assert abs(got[k] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9


def test_every_unlabelled_row_is_dealt_once_whatever_its_id(spark, monkeypatch):
    monkeypatch.setattr(Q, "SHARE", 500)
    seen = []
    real = Q._Training._states
    monkeypatch.setattr(Q._Training, "_states", lambda self, rows, shares, sides, prior, n: (seen.append((rows.count(), shares, sides[0][0])), real(self, rows, shares, sides, prior, n))[1])
    d = spark.createDataFrame([(None if k % 2 else k, f"word{k} and word{k % 7}") for k in range(3000)], "doc_id long, text string")
    Q.learn_quality(d, d.select("doc_id").limit(40))
    assert seen[0][0] == 3000 and sum(n for n, _, side in seen if side is None) == 3000 and len(seen) > 3


def test_positives_are_bounded_whatever_repeats(spark):
    d = spark.createDataFrame([(1, f"same id {k % 3}") for k in range(900)] + [(2, "b")], "doc_id long, text string")
    m = Q.learn_quality(d, spark.createDataFrame([(1,), (2,), (None,)], "doc_id long"), sample=50)
    assert 0 < m.prior <= 0.98
