"""SimHash near-duplicates through BK-trees.

A document's fingerprint takes, bit by bit, the majority of its shingles' hashes. Distinct fingerprints are
dealt to shards: their 64 bits are cut into ``blocks`` blocks, and two fingerprints that differ in at most
``radius`` bits agree on at least ``blocks - radius`` of them, so they meet in the shard of some choice of as
many blocks. A shard with two or more fingerprints builds a BK-tree, children keyed by their distance to the
parent, and searches it for each of its members, following only edges within the radius. A shard of more than
``TILE`` fingerprints is cut into tiles: a tree for each, searched for its own members and for those of the tiles
after it, on different tasks. Links leave a tree as a spanning forest, so a large group of near copies never
becomes all of its pairs.

A tree of all fingerprints grows with the corpus and is not broadcast; each tree goes where its shard is.

Near copies by similarity (``similar_components``) go the same way with wider fingerprints of shingle sets; what their
trees find is then compared exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stable, whole
from .components import UnionFind, connected_components

BITS = 64
#: Hashes whose bits are summed up at once.
CHUNK = 1 << 16


def shingle_hashes(text: bytes, size: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of ``size`` words, repeats included; of all words where there are fewer."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    h = xxhash.xxh64_intdigest
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([h(b" ".join(words), seed)], np.uint64)
    join = b" ".join
    return np.fromiter((h(join(s), seed) for s in zip(*(words[k:] for k in range(size)), strict=False)), np.uint64, len(words) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is set if it is in more than half of the hashes; none: zero."""
    n = len(hashes)
    if not n:
        return 0
    count = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        part = np.ascontiguousarray(hashes[at : at + CHUNK], "<u8").view(np.uint8).reshape(-1, 8)
        count += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp (the 64 bits as a signed long) of every row; null text has fingerprint zero."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(shingle_hashes(x.as_buffer().to_pybytes(), shingle)) for x in b.column("text").cast(pa.binary())], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return src.mapInArrow(work, "id long, fp long")


def distance(rows: np.ndarray, pivot: np.ndarray) -> np.ndarray:
    """Differing bits between rows of 64-bit words and one such row."""
    return np.bitwise_count(rows ^ pivot).sum(1, dtype=np.int32)


class BKTree:
    """A BK-tree over distinct fingerprints (rows of 64-bit words), built and searched in numpy.

    ``near`` yields (pivot, members) for every node: the fingerprints within the radius of the node's pivot.
    Each search descends only through children whose key, the distance to the parent, is within the radius of
    the searched one's own distance; all searches that reach a node are compared with it at once.
    """

    def __init__(self, values: np.ndarray):
        self.values = values
        self.children: list[dict[int, int]] = []
        self.pivots: list[int] = []
        stack: list[tuple[int, int, np.ndarray]] = [(-1, -1, np.arange(len(values)))] if len(values) else []
        while stack:
            parent, key, below = stack.pop()
            node = len(self.pivots)
            self.pivots.append(int(below[0]))
            self.children.append({})
            if parent >= 0:
                self.children[parent][key] = node
            rest = below[1:]
            if len(rest):
                d = distance(values[rest], values[below[0]])
                for k in np.unique(d):
                    stack.append((node, int(k), rest[d == k]))

    def near(self, radius: int, searched: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """searched: other fingerprints than the tree's own; the members yielded are then rows of it."""
        own = searched is None
        values = self.values if own else searched
        stack = [(0, np.arange(len(values)))] if len(self.values) and len(values) else []
        while stack:
            node, queries = stack.pop()
            pivot = self.pivots[node]
            d = distance(values[queries], self.values[pivot])
            close = queries[(d <= radius) & (queries != pivot)] if own else queries[d <= radius]
            if len(close):
                yield pivot, close
            for key, child in self.children[node].items():
                go = queries[np.abs(d - key) <= radius]
                if len(go):
                    stack.append((child, go))


def shard_links(values: np.ndarray, radius: int, others: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among the fingerprints of a shard, as indices of their rows.

    others: of the links between them and ``others`` instead, whose rows are counted on.
    """
    uf = UnionFind()
    out = []
    shift = 0 if others is None else len(values)
    for pivot, close in BKTree(values).near(radius, others):
        for q in (close + shift).tolist():
            if uf.find(q) != uf.find(pivot):
                uf.union(q, pivot)
                out.append((q, pivot))
    return out


def _shard_keys(fp: Column, radius: int, blocks: int) -> Column:
    """An array of (choice of blocks, their bits)."""
    cuts = [round(k * BITS / blocks) for k in range(blocks + 1)]
    masks = [((1 << cuts[k + 1]) - 1) ^ ((1 << cuts[k]) - 1) for k in range(blocks)]
    keys = []
    for n, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        mask = sum(masks[k] for k in chosen)
        signed = mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask
        keys.append(F.xxhash64(F.lit(n), fp.bitwiseAND(F.lit(signed))))
    return F.array(*keys)


def grouped_runs(batches: Iterator[pa.RecordBatch], key: str, value: str, tile: int) -> Iterator[tuple[int, np.ndarray, int, bool]]:
    """Of rows sorted by key and value: (key, distinct values, place of the first, whole) of every run of two or more.

    A run of more than ``tile`` values comes in parts that aren't whole; no more than a batch and a tile are held.
    """
    now: int | None = None
    held: list[np.ndarray] = []
    size = place = 0
    last = None  # the value before, as equal ones stand together

    def close(more: bool) -> Iterator[tuple[int, np.ndarray, int, bool]]:
        if size > 1 or size and place:
            yield now, np.concatenate(held), place, not place and not more

    for b in batches:
        k, v = b.column(key).to_numpy(), b.column(value).to_numpy()
        if not len(k):
            continue
        cuts = np.concatenate([[0], np.flatnonzero(k[1:] != k[:-1]) + 1, [len(k)]])
        lone = np.diff(cuts) == 1
        for n, (s, e) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if lone[n] and 0 < n < len(lone) - 1:  # most: a value that meets none
                continue
            if k[s] != now:
                yield from close(False)
                now, held, size, place, last = int(k[s]), [], 0, 0, None
            part = v[s:e]
            fresh = part[np.concatenate([[last is None or part[0] != last], part[1:] != part[:-1]])]
            last = part[-1]
            if len(fresh):
                held.append(fresh)
                size += len(fresh)
            if size > tile:
                yield from close(True)
                held, place, size = [], place + size, 0
    yield from close(False)


#: Members of a shard or bucket that are searched or compared as one; larger ones are cut into tiles.
TILE = 512
_SLOT = "key long, a long, b long, pos long"


def _found(key: int, a: np.ndarray | list, b: np.ndarray | list | None, pos: np.ndarray | None) -> pa.RecordBatch:
    """Links a, b; or members a of a large run with their places."""
    n = len(a)
    none = pa.nulls(n, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, key)), pa.array(a, pa.int64()), none if b is None else pa.array(b, pa.int64()), none if pos is None else pa.array(pos, pa.int64())], names=["key", "a", "b", "pos"])


def tile_units(members: DataFrame, tile: int) -> DataFrame:
    """key, unit, role, a: each pair of tiles of a large run's members (key, a, pos), and each tile with itself.

    Role 1 is the unit's first tile, role 2 its second.
    """
    sizes = members.groupBy("key").agg(F.ceil((F.max("pos") + 1) / tile).cast("long").alias("k"))
    own = F.floor(F.col("pos") / tile).cast("long")
    first = F.transform(F.sequence(own, F.col("k") - 1), lambda j: F.struct((own * F.col("k") + j).alias("unit"), F.lit(1).cast("long").alias("role")))
    second = F.transform(F.sequence(F.lit(0).cast("long"), own), lambda i: F.struct((i * F.col("k") + own).alias("unit"), F.lit(2).cast("long").alias("role")))
    dealt = members.join(sizes, "key").select("key", "a", F.explode(F.concat(first, second)).alias("u"))
    return dealt.select("key", "u.unit", "u.role", "a")


def units_of(batches: Iterator[pa.RecordBatch], value: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of rows sorted by key, unit and role: (key, unit, values of the first tile, values of the second)."""
    now: tuple[int, int] | None = None
    held: tuple[list, list] = ([], [])
    done = lambda: (*now, *(np.concatenate(x) if x else np.zeros(0, np.int64) for x in held))
    for b in batches:
        rows = [b.column(c).to_numpy() for c in ("key", "unit", "role", value)]
        k = np.stack(rows[:3], 1)
        cuts = np.concatenate([[0], np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1, [len(k)]]) if len(k) else np.zeros(1, int)
        for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            at = (int(k[s, 0]), int(k[s, 1]))
            if at != now:
                if now is not None:
                    yield done()
                now, held = at, ([], [])
            held[int(k[s, 2]) - 1].append(rows[3][s:e])
    if now is not None:
        yield done()


def near_groups(prints: DataFrame, radius: int, blocks: int) -> DataFrame:
    """fp, component_id, members of every distinct fingerprint of ``prints`` (id, fp).

    component_id: the least id of all rows whose fingerprints are reachable over links.
    """
    distinct = stable(prints.groupBy("fp").agg(F.min("id").alias("least_id")), "fingerprints")
    slots = distinct.select(F.explode(_shard_keys(F.col("fp"), radius, blocks)).alias("key"), F.col("fp").alias("a"))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, values, place, is_whole in grouped_runs(batches, "key", "a", TILE):
            if not is_whole:
                yield _found(key, values, None, np.arange(place, place + len(values)))
            elif found := shard_links(values.view(np.uint64)[:, None], radius):
                yield _found(key, values[[i for i, _ in found]], values[[j for _, j in found]], None)

    def search_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key, unit and role."""
        for key, _, one, two in units_of(batches, "a"):
            x, y = one.view(np.uint64)[:, None], two.view(np.uint64)[:, None]
            if found := shard_links(x, radius, y):
                both = np.concatenate([one, two])
                yield _found(key, both[[i for i, _ in found]], both[[j for _, j in found]], None)

    first = stable(slots.repartition("key").sortWithinPartitions("key", "a").mapInArrow(search, _SLOT), "shard-links")
    units = tile_units(first.filter("b IS NULL"), TILE)
    more = units.repartition("key", "unit").sortWithinPartitions("key", "unit", "role").mapInArrow(search_tiles, _SLOT)
    links = first.filter("b IS NOT NULL").select("a", "b").unionByName(more.select("a", "b"))
    classes = connected_components(links)
    named = stable(distinct.join(classes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp")), "labels")
    least = stable(named.groupBy("label").agg(F.min("least_id").alias("component_id")), "least-ids")
    return named.join(least, "label").select("fp", "component_id")


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 2, blocks: int = 6, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fingerprint (16 hex digits), component_id for every row.

    Texts are lower-cased A-Z and cut at ASCII white space; fewer words than a shingle are one shingle, none
    give fingerprint zero, which links like any other. Null text counts as empty. Repeated rows get the same
    result each. An empty table gives an empty result. ``blocks`` must be larger than ``radius``; it decides
    how many shards a fingerprint goes to and how large they are, never which links are found.
    """
    prints = stable(fingerprints(docs, shingle, id_col, text_col), "simhash")
    groups = stable(near_groups(prints, radius, blocks), "groups")
    return prints.join(groups, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Wide fingerprints, an estimate of similarity: 64-bit words of each, and deviations beyond the mean at the similarity up to
#: which trees are searched; so many also cover sets of a few shingles, whose bits differ more often than the angle says.
WIDE, REACH = 4, 6
#: Near copies: minima that make a bucket's key, and the chance that a pair at the similarity meets in no bucket.
BAND, MISS = 6, 1e-4

def mixed_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """The k-th family of hashes, from the first by a multiply-and-shift mix."""
    if k == 0:
        return h
    with np.errstate(over="ignore"):
        x = h + np.uint64((0x9E3779B97F4A7C15 * k) % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def similar_radius(similarity: float) -> int:
    """Bits in which wide fingerprints of sets of that similarity differ at most."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    n = WIDE * BITS
    return min(n, math.ceil(n * share + REACH * math.sqrt(n * share * (1 - share))))


def wide_print(hashes: np.ndarray) -> np.ndarray:
    """The fingerprint of a set of shingles: ``WIDE`` words, each from a family of hashes of its own."""
    return np.array([fingerprint(mixed_hashes(hashes, k)) for k in range(WIDE)], np.uint64)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """The distinct shingles' hashes, sorted."""
    return np.unique(shingle_hashes(text, size))


class Bands:
    """Keys of the buckets in which sets of a similarity meet: each from the least values of ``BAND`` hash families."""

    def __init__(self, similarity: float):
        self.count = math.ceil(math.log(MISS) / math.log(1 - similarity**BAND)) if similarity < 1 else 1
        rng = np.random.default_rng(17)
        wide = lambda: rng.integers(0, 1 << 64, self.count * BAND, np.uint64)
        self.flip, self.times, self.weight = wide()[:, None], wide()[:, None] | np.uint64(1), wide() | np.uint64(1)

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """One key for each bucket of a set; none for an empty set."""
        if not len(hashes):
            return np.zeros(0, np.int64)
        least = np.full(self.count * BAND, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(hashes), 2048):
            least = np.minimum(least, ((hashes[None, at : at + 2048] ^ self.flip) * self.times).min(1))
        return (least * self.weight).reshape(self.count, BAND).sum(1, dtype=np.uint64).view(np.int64)


def set_links(prints: np.ndarray, radius: int, values: np.ndarray, starts: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets that a BK-tree finds within the radius and whose Jaccard similarity is that or more.

    prints: the sets' wide fingerprints; set k is values[starts[k]:starts[k + 1]]. Pairs that links already join aren't
    compared; all others that the tree finds are, exactly.
    """
    sizes = np.diff(starts)
    codes = np.unique(values, return_inverse=True)[1]
    label = np.arange(len(sizes))
    has = np.zeros(len(values), bool)
    out = []
    for p, close in BKTree(prints).near(radius):
        close = close[(close > p) & (label[close] != label[p])]  # each pair is found from both sides
        if not len(close):
            continue
        own = codes[starts[p] : starts[p + 1]]
        has[own] = True
        for q in close.tolist():
            if label[q] == label[p]:
                continue
            both = int(np.count_nonzero(has[codes[starts[q] : starts[q + 1]]]))
            if both / (sizes[p] + sizes[q] - both) >= similarity:
                label[label == label[q]] = label[p]
                out.append((p, q))
        has[own] = False
    return out


def similar_components(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, component_id of every row with an id, for near copies of ``similarity`` or more.

    Two documents link where the Jaccard similarity of their whole texts' sets of shingles is ``similarity`` or
    more; equal sets, empty ones too, are one. Shards are keyed by least hashes: a pair at the similarity meets in
    none with a chance of ``MISS``, a nearer pair still less. Documents that share a shard get a wide fingerprint of
    their set; each shard's BK-tree over these is searched for its members, and pairs within the radius have their sets
    compared, so nothing links on an estimate. Rows that repeat an id are in one class; null text counts as empty.
    """
    src = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("text"))
    bands, radius = Bands(similarity), similar_radius(similarity)

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, keys = [], []
            for x in b.column("text").cast(pa.binary()):
                s = shingle_set(x.as_buffer().to_pybytes(), shingle)
                fp.append(xxhash.xxh3_128_digest(s.astype("<u8").tobytes()))
                keys.append(bands.keys(s))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["id", "fp", "keys"])

    rows = stable(src.mapInArrow(sketches, "id long, fp binary, keys array<long>"), "sketches")
    distinct = stable(rows.groupBy("fp").agg(F.min("id").alias("node"), F.first("keys").alias("keys")), "distinct-sets")
    slots = distinct.select(F.explode("keys").alias("key"), F.col("node").alias("a"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Small buckets as lists of nodes, members of large ones a row each."""
        keys, nodes, first = [], [], []
        for key, values, place, is_whole in grouped_runs(batches, "key", "a", TILE):
            keys.append(key), nodes.append(values), first.append(None if is_whole else place)
            if len(keys) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(nodes, pa.list_(pa.int64())), pa.array(first, pa.int64())], names=["key", "nodes", "first"])
                keys, nodes, first = [], [], []
        if keys:
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(nodes, pa.list_(pa.int64())), pa.array(first, pa.int64())], names=["key", "nodes", "first"])

    met = stable(slots.repartition("key").sortWithinPartitions("key", "a").mapInArrow(meet, "key long, nodes array<long>, first long"), "buckets")
    # the same few documents meet in many buckets: their list is compared once
    small = met.filter("first IS NULL").select(F.array_sort("nodes").alias("nodes")).distinct().withColumn("key", F.xxhash64("nodes"))
    lists = small.select("key", F.lit(-1).cast("long").alias("unit"), F.lit(1).cast("long").alias("role"), F.explode("nodes").alias("a"))
    large = met.filter("first IS NOT NULL").select("key", "first", F.posexplode("nodes").alias("at", "a")).select("key", "a", (F.col("first") + F.col("at")).alias("pos"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = [shingle_set(x.as_buffer().to_pybytes(), shingle) for x in b.column("text").cast(pa.binary())]
            fp = [xxhash.xxh3_128_digest(x.astype("<u8").tobytes()) for x in s]
            prints = [wide_print(x).astype("<u8").tobytes() for x in s]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp, pa.binary()), pa.array([x.view(np.int64) for x in s], pa.list_(pa.int64())), pa.array(prints, pa.binary())], names=["node", "fp", "hashes", "print"])

    wanted = stable(met.select(F.explode("nodes").alias("id")).distinct(), "candidates")
    held = src.join(wanted, "id", "left_semi").mapInArrow(sets, "node long, fp binary, hashes array<long>, print binary").filter(F.size("hashes") > 0)
    held = stable(held.groupBy("node", "fp").agg(F.first("hashes").alias("hashes"), F.first("print").alias("print")).drop("fp"), "shingle-sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key, unit and role."""
        node: list[int] = []
        parts: list[np.ndarray] = []
        prints: list[bytes] = []
        last = None

        def closed() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
            tree = np.frombuffer(b"".join(prints), "<u8").reshape(-1, WIDE)
            found = set_links(tree, radius, np.concatenate(parts), starts, similarity)
            return pa.RecordBatch.from_arrays([pa.array([node[i] for i, _ in found], pa.int64()), pa.array([node[j] for _, j in found], pa.int64())], names=["a", "b"])

        for b in batches:
            col = b.column("hashes")
            flat, at = col.values.to_numpy(), col.offsets.to_numpy()
            for k, (*key, own, wide) in enumerate(zip(*(b.column(c).to_pylist() for c in ("key", "unit", "a", "print")), strict=True)):
                if key != last:
                    if len(node) > 1:
                        yield closed()
                    node, parts, prints, last = [], [], [], key
                if own not in node[-1:]:  # a tile with itself comes in both roles
                    node.append(own)
                    parts.append(flat[at[k] : at[k + 1]].copy())
                    prints.append(wide)
        if len(node) > 1:
            yield closed()

    def linked(units: DataFrame) -> DataFrame:
        dealt = units.join(held, units["a"] == held["node"]).select("key", "unit", "role", "a", "hashes", "print")
        return dealt.repartition("key", "unit").sortWithinPartitions("key", "unit", "a").mapInArrow(compare, "a long, b long")

    links = linked(lists)
    if large.limit(1).count():
        # a large bucket is mostly one group: its members are held against its first one, and only members that no
        # link joins to the bucket's largest class are held against all tiles
        first = stable(links.unionByName(linked(_stars(large))), "similar-links")
        label = connected_components(first).withColumnRenamed("node", "a")
        classed = large.join(label, "a", "left").withColumn("label", F.coalesce("label", "a"))
        sizes = classed.groupBy("key", "label").count()
        main = sizes.groupBy("key").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
        apart = stable(classed.join(main, "key").select("key", "a", "pos", (F.col("label") != F.col("main")).alias("apart")), "apart")
        links = first.unionByName(linked(_cross(apart)))
    classes = connected_components(links)
    named = stable(distinct.select("node", "fp").join(classes, "node", "left").select("fp", F.coalesce("label", "node").alias("component_id")), "similar-classes")
    return rows.select("id", "fp").join(named, "fp").select(F.col("id").alias(id_col), "component_id")


def _stars(large: DataFrame) -> DataFrame:
    """Each tile of a large bucket's members, and the bucket's first member with each."""
    tile = F.floor(F.col("pos") / TILE).cast("long")
    sizes = large.groupBy("key").agg(F.max(tile).alias("last"))
    hub = large.filter("pos = 0").join(sizes, "key").select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))).alias("unit"), "a")
    return hub.unionByName(large.filter("pos > 0").select("key", tile.alias("unit"), "a")).withColumn("role", F.lit(1).cast("long"))


def _cross(members: DataFrame) -> DataFrame:
    """Tiles of the members that stand apart, each with every tile of the bucket."""
    order = F.floor(F.col("pos") / TILE).cast("long")
    sizes = members.groupBy("key").agg(F.max(order).alias("last"), F.max(F.when(F.col("apart"), order)).alias("odd")).filter("odd IS NOT NULL")
    wide = F.col("last") + 1
    all_tiles = members.join(sizes, "key").select("key", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("odd")), lambda i: i * wide + order)).alias("unit"), "a")
    odd = members.filter("apart").join(sizes, "key").select("key", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), lambda j: order * wide + j)).alias("unit"), "a")
    # units without a member that stands apart have nothing to compare
    some = odd.select("key", "unit").distinct()
    return all_tiles.join(some, ["key", "unit"], "left_semi").unionByName(odd).distinct().withColumn("role", F.lit(1).cast("long"))

