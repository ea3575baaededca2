import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from inkmeter.llm import simhash as S
from inkmeter.llm.queries import op10_simhash, read_table

from .helpers import ODD, clashing, docs

SF = "/root/testdata/sf0.001"


def slow_fingerprint(text, size):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode().split()
    runs = [b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
    hs = [xxhash.xxh64(r, seed=42).intdigest() for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(rows, size, radius):
    fps = [slow_fingerprint(t, size) for _, t in rows]
    comp = list(range(len(rows)))

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                comp[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return sorted(repr((i, f"{fps[k]:016x}", least.get(find(k)))) for k, (i, _) in enumerate(rows))


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in read_table(spark, SF, "documents").collect()]
    got = op10_simhash(spark, SF).collect()
    assert sorted(repr((r.doc_id, r.fingerprint, r.component_id)) for r in got) == slow_components(rows, 3, 2)


def test_odd_rows(spark):
    got = S.simhash_components(clashing(docs(spark, ODD), "fp", "fingerprint")).collect()
    assert sorted(repr(tuple(r)) for r in got) == slow_components([(i, t) for i, t, *_ in ODD], 3, 2)
    assert S.simhash_components(docs(spark, [])).collect() == []


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**12 - 1), min_size=1, max_size=60, unique=True), st.integers(0, 4))
def test_tree_finds_every_link(values, radius):
    v = np.array(values, np.uint64)[:, None]
    pairs = {(p, int(q)) for p, close in S.BKTree(v).near(radius) for q in close}
    want = {(i, j) for i in range(len(v)) for j in range(len(v)) if i != j and (values[i] ^ values[j]).bit_count() <= radius}
    assert pairs == want
    links = S.shard_links(v, radius)
    assert len(links) < len(v) and all((values[i] ^ values[j]).bit_count() <= radius for i, j in links)


def test_near_texts_meet_in_a_shard(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 40)
    rows = [(k, int(x)) for k, x in enumerate(base)] + [(100 + k, int(x) ^ (1 << int(rng.integers(63))) ^ (1 << int(rng.integers(63)))) for k, x in enumerate(base)]
    got = {r.fp: r.component_id for r in S.near_groups(spark.createDataFrame(rows, "id long, fp long"), 2, 6).collect()}
    for k in range(40):
        assert got[rows[k][1]] == got[rows[40 + k][1]] == k


def test_similar_texts(spark):
    words = [f"w{k}" for k in range(400)]
    edited = words[:200] + ["other"] + words[201:]
    rows = [(1, " ".join(words), "en", "a"), (2, " ".join(edited), "en", "a"), (3, " ".join(words[::-1]), "en", "a"), (4, None, "en", "a"), (5, "", "en", "a"), (5, "", "en", "a"), (None, " ".join(words), "en", "a")]
    got = {r.doc_id: r.component_id for r in S.similar_components(docs(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4}
    assert S.similar_components(docs(spark, [])).collect() == []


def jaccard_components(rows, similarity=0.8, size=5):
    """id -> least id of its class, over all pairs of (id, text) by exact similarity of distinct shingles."""
    up = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = (t or "").translate(up).encode().split()
        sets.append({b" ".join(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    comp = {i: i for i, _ in rows}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for k, (i, _) in enumerate(rows):
        for m in range(k):
            both = len(sets[k] & sets[m])
            union = len(sets[k]) + len(sets[m]) - both
            if not union or both / union >= similarity:
                a, b = find(i), find(rows[m][0])
                comp[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in rows}


def test_a_repeated_line_makes_no_near_copy(spark):
    line = " ".join(f"x{k}" for k in range(20))
    rows = [(n, " ".join([*(f"{n}-{k}" for k in range(300)), *[line] * 20]), "en", "a") for n in range(1, 9)]
    got = {r.doc_id: r.component_id for r in S.similar_components(docs(spark, rows)).collect()}
    assert got == {n: n for n in range(1, 9)}


def test_every_pair_at_the_similarity_links_and_none_below_it(spark):
    rng = np.random.default_rng(5)
    rows = []
    for n in range(150):  # pairs between 0.7 and 0.9 alike, and just about 0.8
        w = [f"{n}-{k}" for k in range(204)]
        e = [*w[: 204 - (cut := int(rng.integers(10, 36)))], *(f"{n}-new{k}" for k in range(cut))]
        rows += [(2 * n, " ".join(w), "en", "a"), (2 * n + 1, " ".join(e), "en", "a")]
    want = jaccard_components([r[:2] for r in rows])
    assert 30 < sum(i != c for i, c in want.items()) < 120
    assert {r.doc_id: r.component_id for r in S.similar_components(docs(spark, rows)).collect()} == want


def test_large_buckets_are_compared_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE", 4)
    rng = np.random.default_rng(6)
    base = [f"w{k}" for k in range(150)]
    rows = [(n, " ".join([*base[: (at := int(rng.integers(140)))], f"new{n}", *base[at + 1 + int(rng.integers(9)) :]]), "en", "a") for n in range(40)]
    assert {r.doc_id: r.component_id for r in S.similar_components(docs(spark, rows)).collect()} == jaccard_components([r[:2] for r in rows])


def test_large_buckets_of_several_groups(spark, monkeypatch):
    """Groups that meet in buckets without linking: the second pass must find links of what stands apart."""
    monkeypatch.setattr(S, "TILE", 3)
    rng = np.random.default_rng(8)
    rows = []
    for g in range(4):
        own = [f"w{k}" for k in range(100)] + [f"g{g}-{k}" for k in range(25)]
        for n in range(12):
            w = list(own)
            for at in rng.integers(0, len(w), int(rng.integers(0, 4))):
                w[int(at)] = f"new{g}-{n}-{at}"
            rows.append((100 * g + n, " ".join(w), "en", "a"))
    want = jaccard_components([r[:2] for r in rows])
    assert len(set(want.values())) > 3
    assert {r.doc_id: r.component_id for r in S.similar_components(docs(spark, rows)).collect()} == want


def test_dense_shards_are_searched_in_tiles(spark, monkeypatch):
    monkeypatch.setattr(S, "TILE", 8)
    rng = np.random.default_rng(9)
    values = sorted({int(x) << 3 | 5 << 40 for x in rng.integers(0, 1 << 12, 90)})
    rows = [(k, v) for k, v in enumerate(values)]
    comp = list(range(len(values)))
    for _ in values:  # the least place reachable
        for i, a in enumerate(values):
            comp[i] = min(comp[j] for j, b in enumerate(values) if (a ^ b).bit_count() <= 2)
        comp = [comp[c] for c in comp]
    got = {r.fp: r.component_id for r in S.near_groups(spark.createDataFrame(rows, "id long, fp long"), 2, 6).collect()}
    assert got == dict(zip(values, comp)) and 1 < len(set(comp)) < len(values)


def test_grouped_runs_equal_a_plain_loop():
    import pyarrow as pa

    rng = np.random.default_rng(10)
    for size in (1, 2, 7, 1000):
        rows = sorted((int(k), int(v)) for k, v in zip(rng.integers(0, 25, 90) ** 2 // 20, rng.integers(0, 12, 90)))
        batches = [pa.RecordBatch.from_pydict({"key": [k for k, _ in rows[s : s + size]], "a": [v for _, v in rows[s : s + size]]}) for s in range(0, len(rows), size)]
        got, whole = {}, {}
        for key, values, place, is_whole in S.grouped_runs(iter(batches), "key", "a", 4):
            assert place == len(got.get(key, []))
            got.setdefault(key, []).extend(values.tolist())
            whole[key] = is_whole
        want = {}
        for k, v in rows:
            want.setdefault(k, set()).add(v)
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if len(v) > 1}
        assert all(len(want[k]) <= 4 or not w for k, w in whole.items()) and all(w or len(want[k]) > 4 for k, w in whole.items())


def test_very_long_text(spark):
    long = "Words of a very long text that goes on. " * 60_000
    rows = [(1, long, "en", "a"), (2, long.upper(), "en", "a"), (3, "x" * 2_000_000, "en", "a")]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.simhash_components(docs(spark, rows)).collect()}
    assert got[1] == got[2] and got[1][1] == 1 and got[3][1] == 3
    assert {r.doc_id: r.component_id for r in S.similar_components(docs(spark, rows)).collect()} == {1: 1, 2: 1, 3: 3}


def test_trees_of_fingerprints_choose_what_is_compared():
    """Sets that fingerprints hold apart aren't compared, all that are near are, and only exact similarity links."""
    rng = np.random.default_rng(12)
    sets = [np.unique(rng.integers(0, 1 << 63, 200, np.uint64))]
    for cut in (5, 15, 30, 60, 120):
        sets.append(np.unique(np.concatenate([sets[0][cut:], rng.integers(0, 1 << 63, cut, np.uint64)])))
    starts = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
    prints = np.stack([S.wide_print(x) for x in sets])
    radius = S.similar_radius(0.8)
    links = S.set_links(prints, radius, np.concatenate(sets), starts, 0.8)
    alike = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
    assert all(alike(i, j) >= 0.8 for i, j in links)
    joined = {x for link in links for x in link}
    assert joined == {i for i in range(6) if any(i != j and alike(i, j) >= 0.8 for j in range(6))} == {0, 1, 2}
    far = np.stack([S.wide_print(x ^ np.uint64(k)) for k, x in enumerate(sets)])  # fingerprints that tell of no nearness
    assert S.set_links(far, radius, np.concatenate(sets), starts, 0.8) == []


def test_radius_holds_pairs_at_the_similarity():
    """Also of the smallest sets: four shingles of five."""
    rng = np.random.default_rng(13)
    for shared, one, two in ((4, 0, 1), (8, 1, 1), (16, 0, 4), (80, 10, 10), (800, 0, 200)):
        away = []
        for _ in range(300):
            h = rng.integers(0, 1 << 63, shared + one + two, np.uint64) * np.uint64(2) + rng.integers(0, 2, shared + one + two, np.uint64)
            x, y = S.wide_print(h[: shared + one]), S.wide_print(np.concatenate([h[:shared], h[shared + one :]]))
            away.append(int(np.bitwise_count(x ^ y).sum()))
        assert max(away) <= S.similar_radius(0.8) < S.WIDE * S.BITS // 2 - 6 * 8


def test_near_copies_search_trees(spark, monkeypatch):
    """The stage's links come through the search of fingerprints: with a radius that admits none, there are none."""
    words = [f"w{k}" for k in range(400)]
    rows = [(1, " ".join(words), "en", "a"), (2, " ".join([*words[:200], "other", *words[201:]]), "en", "a")]
    assert {r.doc_id: r.component_id for r in S.similar_components(docs(spark, rows)).collect()} == {1: 1, 2: 1}
    monkeypatch.setattr(S, "similar_radius", lambda similarity: -1)
    assert {r.doc_id: r.component_id for r in S.similar_components(docs(spark, rows)).collect()} == {1: 1, 2: 2}
