import math

import numpy as np

from inkmeter.llm import embedding_dedup as ED

from .helpers import clashing


def brute(rows, cosine):
    """id: (links, component) by comparing all rows."""
    good = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or not v or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        a = np.array(v, float)
        good[i] = (label, a / np.linalg.norm(a))
    ids = sorted(good)
    comp = {i: i for i, *_ in rows if i is not None}
    links = dict.fromkeys(comp, 0)

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and good[a][0] == good[b][0] and len(good[a][1]) == len(good[b][1]) and good[a][1] @ good[b][1] >= cosine:
                links[a] += 1
                links[b] += 1
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {i: (links[i], find(i), find(i) == i) for i in comp}


def near(rng, v, angle):
    o = rng.standard_normal(len(v))
    o -= o @ v * v
    return math.cos(angle) * v + math.sin(angle) * o / np.linalg.norm(o)


def make(rng, n, dim=32):
    rows = []
    for k in range(n):
        v = rng.standard_normal(dim)
        rows.append((10 * k, v / np.linalg.norm(v), int(k % 3)))
    for k in range(0, n, 4):
        for j in range(1, 4):
            rows.append((10 * k + j, near(rng, rows[k][1], 0.02 + 0.16 * rng.random()) * 3, rows[k][2]))
    return [(i, [float(x) for x in v], label) for i, v, label in rows]


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def as_float32(rows):
    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


def test_recall_and_precision_against_brute_force(spark):
    rows = make(np.random.default_rng(5), 240)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ED.embedding_components(table(spark, rows)).collect()}
    want = brute(as_float32(rows), 0.98)
    assert got.keys() == want.keys()
    assert all(got[i][0] <= want[i][0] for i in got)
    assert sum(g[0] for g in got.values()) >= 0.99 * sum(w[0] for w in want.values()) > 100


def test_tiles_of_a_large_bucket(spark):
    rng = np.random.default_rng(6)
    c = rng.standard_normal(16)
    c /= np.linalg.norm(c)
    rows = [(k, [float(x) for x in near(rng, c, 0.01 + 0.1 * rng.random())], 1) for k in range(150)] + [(1000 + k, [float(x) for x in rng.standard_normal(16)], 1) for k in range(60)]
    want = brute(as_float32(rows), 0.98)
    for tile in (4096, 16):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ED.embedding_components(table(spark, rows), tile=tile).collect()}
        assert {i: g[1:] for i, g in got.items()} == {i: w[1:] for i, w in want.items()}
        assert sum(g[0] for g in got.values()) >= 0.995 * sum(w[0] for w in want.values())
        assert all(got[i][0] <= want[i][0] for i in got)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1), (2, v, 1), (3, v, 2), (4, v, None), (5, None, 1), (6, [0.0, 0.0, 0.0], 1), (7, [nan, 1.0, 2.0], 1), (8, [inf, 1.0, 2.0], 1), (9, [None, 1.0, 2.0], 1), (10, [], 1), (11, [1e-30, 2e-30, 3e-30], 1), (12, [1.0, 2.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ED.embedding_components(table(spark, rows)).collect()}
    assert got == {i: (2, 1, i == 1) if i in (1, 2, 11) else (0, i, True) for i, *_ in rows}
    assert ED.embedding_components(table(spark, [])).collect() == []
    assert [tuple(r) for r in ED.embedding_components(table(spark, [(3, None, 1)])).collect()] == [(3, 0, 3, True)]


def test_every_row_is_a_vector(spark):
    """Rows that repeat an id or have none keep their links, and no row hides another."""
    v, w = [1.0, 2.0, 3.0], [-1.0, 2.0, 0.5]
    rows = [(1, v, 1), (1, v, 1), (None, v, 1), (7, w, None), (7, w, 2), (5, w, 2), (None, [3.0, -1.0, 0.0], 3), (9, None, None)]
    got = sorted((tuple(r) for r in ED.embedding_components(table(spark, rows)).collect()), key=str)
    want = [(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, False), (7, 0, 7, True), (7, 1, 5, False), (5, 1, 5, True), (None, 0, None, True), (9, 0, 9, True)]
    assert got == sorted(want, key=str)


def test_lengths_link_within_themselves(spark):
    rng = np.random.default_rng(9)
    rows = []
    for dim, start in ((3, 0), (2, 100), (24, 1000)):
        for k in range(30):
            c = rng.standard_normal(dim)
            rows += [(start + 2 * k, [float(x) for x in c], 1), (start + 2 * k + 1, [float(x) for x in c * 2], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in ED.embedding_components(table(spark, rows)).collect()}
    assert got == brute(as_float32(rows), 0.98)


def test_copies_are_counted_without_being_compared(spark):
    rows = [(k, [1.0, 0.0, 0.0, 0.0], 1) for k in range(5000)] + [(9000, [1.0, 0.05, 0.0, 0.0], 1), (9001, [0.0, 1.0, 0.0, 0.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id) for r in ED.embedding_components(table(spark, rows), tile=16).collect()}
    assert got == {k: (5000, 0) for k in range(5000)} | {9000: (5000, 0), 9001: (0, 9001)}


def test_clashing_columns(spark):
    rows = [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)]
    d = clashing(table(spark, rows), "cid", "v", "dim", "n", "known", "digest", "n_links", "component_id", "kept", "bucket")
    assert sorted(tuple(r) for r in ED.embedding_components(d).collect()) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_runs_that_are_too_long_come_in_parts():
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"bucket": x}) for x in ([1, 1, 2], [2, 2, 2], [2, 3], [3, 4])]
    got = [(t.column("bucket").to_pylist(), more) for t, more in ED._whole_runs(iter(batches), ("bucket",), 3)]
    assert got == [([1, 1], False), ([2, 2, 2, 2], True), ([2], False), ([3, 3], False), ([4], False)]


def test_codes_are_balanced():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((2000, 24)) * np.linspace(3, 0.3, 24)
    r = ED.learn_rotation(x - x.mean(0), 24, rng)
    assert np.allclose(r.T @ r, np.eye(24), atol=1e-8)
    assert np.abs(((x - x.mean(0)) @ r > 0).mean(0) - 0.5).max() < 0.1


def test_a_dense_bucket_takes_little_memory():
    """A bucket whose vectors all link: the links' substrings in every table were held at once, which grows with its square."""
    import tracemalloc

    import pyarrow as pa

    rng = np.random.default_rng(11)
    index = ED.build_index(rng.standard_normal((2000, 32)), 2_000_000, 0.98)
    c = rng.standard_normal(32)
    for s in (1000, 1600):
        raw = pa.array([(c + 1e-9 * rng.standard_normal(32)).tobytes() for _ in range(s)], pa.binary())
        unit = ED.units_of(raw, 32)
        bucket = index.buckets(index.codes(unit)[0], np.ones(s, np.int64))[0, 0]
        cols = {"bucket": np.full(s, bucket), "tile": np.zeros(s, np.int64), "label": np.ones(s, np.int64), "dim": np.full(s, 32), "role": np.zeros(s, np.int64), "cid": np.arange(s), "n": np.ones(s, np.int64)}
        b = pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in cols.items()} | {"v": raw})
        tracemalloc.start()
        try:
            out = pa.Table.from_batches(ED._buckets({32: index}, 0.98)(iter([b]))).to_pydict()
            assert tracemalloc.get_traced_memory()[1] < 200e6
        finally:
            tracemalloc.stop()
        n = np.bincount(out["cid"], out["n"], s)
        assert (n == s - 1).all() and set(out["least"]) == {0}


def test_every_bit_of_a_sketch_counts_once():
    import pyarrow as pa

    sketch = np.array([5, 5 | 1 << 63, 9, 9 | 1 << 63 | 2, 0, (1 << 63) - 1], np.uint64).view(np.int64)
    b = pa.RecordBatch.from_pydict({"bucket": [1, 1, 2, 2, 3, 3], "cid": [0, 1, 2, 3, 4, 5], "sketch": sketch, "dim": np.full(6, 8, np.int32)})
    got = [c for x in ED._members({8: 2}, 4)(iter([b])) for c in x.column("cid").to_pylist()]
    assert got == [0, 1, 2, 3]
