import random

import pytest
from inkmeter.llm import mixing
from inkmeter.llm.mixing import mix_sources

from .helpers import ODD, clashing, docs


def test_targets_and_copies(spark):
    rows = [(k, "w " * (k % 17 + 1), "en", s) for k, s in enumerate(["a"] * 400 + ["b"] * 60 + [None] * 300)]
    got = mix_sources(docs(spark, rows)).collect()
    again = mix_sources(docs(spark, rows[::-1])).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    by = {}
    for r in got:
        s = rows[r.doc_id][3]
        x = by.setdefault(s, [0, 0, r.target])
        x[0] += r.size
        x[1] += r.taken
        assert r.copies in (0, 1, 2) and r.taken == r.copies * r.size and r.target == x[2]
    total = sum(x[0] for x in by.values())
    assert abs(sum(x[2] for x in by.values()) - 1.5 * total) < 1e-6 * total
    for size, taken, target in by.values():
        assert target <= 2 * size and abs(taken - target) <= 20
    assert by["b"][2] == 2 * by["b"][0]  # capped, its excess reshared


def test_odd_rows_and_empty_table(spark):
    got = mix_sources(clashing(docs(spark, ODD), "size", "target")).collect()
    assert len(got) == len(ODD) and {r.size for r in got if r.doc_id in (1, 2, 3)} == {0}
    assert mix_sources(docs(spark, [])).collect() == []


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2):
    """Shared out round by round: sources above their cap stop there, the rest is shared again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    out, open_, rest = {}, set(sizes), share * sum(sizes.values())
    while open_:
        level = rest / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > cap * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in open_}
        out |= {s: cap * sizes[s] for s in over}
        rest -= sum(cap * sizes[s] for s in over)
        open_ -= over
    return out


@pytest.mark.parametrize("few", [10_000, 3])
@pytest.mark.parametrize("seed", range(3))
def test_targets_equal_sharing_round_by_round(spark, monkeypatch, few, seed):
    monkeypatch.setattr(mixing, "FEW", few)
    rng = random.Random(seed)
    sizes = {f"s{rng.randrange(10**6)}": int(rng.paretovariate(0.6)) for _ in range(300)} | {None: 17, "é": 0, "twin a": 40, "twin b": 40}
    if seed == 2:
        sizes = {f"{k:03}": 8 for k in range(200)}  # one value fills the bracket
    t = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(t, (5, 2, 1), 1.5, 2).collect()}
    want = plain_targets(sizes)
    assert got.keys() == want.keys() and all(abs(got[s] - want[s]) <= 1e-9 * max(1, want[s]) for s in want)
