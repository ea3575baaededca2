"""Near-duplicate embeddings by iterative quantisation.

Rows with one label and one direction are a class: copies are counted, never compared. Rotations for balanced binary
codes are learned on a bounded sample; every class is then indexed. Its codes are cut into substrings, one Hamming
table each, and classes that agree on a substring meet in a bucket. What goes to the tables is a class's number and a
sketch of 64 further bits; only classes with a partner near them by sketch are sent their original vectors, and these
give the cosine in double precision. A pair that meets in several tables counts in the first one. A bucket gives each
class's number of linked rows and its least linked class, never the pairs; one of more than ``tile`` classes is cut
into tiles that are compared on different tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stable
from .components import connected_components

#: Rows of the sample on which rotations are learned, at most, for each length of vectors.
SAMPLE = 20_000
#: Classes in a bucket beyond which it is cut into tiles.
TILE = 4096
#: Wanted bound of the share of pairs at the threshold that meet in no table.
MISS = 1e-4
#: Bits of the sketch, and deviations beyond the mean at the threshold up to which sketches are near.
SKETCH, REACH = 64, 7
#: Vectors whose bits are held at once.
CODED = 2048


def mixed(*parts: np.ndarray) -> np.ndarray:
    """One 64-bit number for each row of numbers, spread by multiplying and shifting."""
    out = np.zeros(np.broadcast(*parts).shape, np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            out = (out ^ np.asarray(p).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
    return (out ^ (out >> np.uint64(32))).view(np.int64)


@dataclass(frozen=True)
class Index:
    mean: np.ndarray
    rotations: tuple[np.ndarray, ...]  # each: dimension by bits
    width: int
    tables: int
    near: int  # differing bits of sketches up to which pairs are compared

    def codes(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The substring of each vector in each table, and its sketch."""
        n = self.width * self.tables
        power = 1 << np.arange(self.width, dtype=np.int64)
        keys, sketch = np.empty((len(unit), self.tables), np.int64), np.empty(len(unit), np.uint64)
        for at in range(0, len(unit), CODED):
            x = unit[at : at + CODED] - self.mean
            bits = np.concatenate([x @ r > 0 for r in self.rotations], axis=1)
            keys[at : at + CODED] = bits[:, :n].reshape(len(x), self.tables, self.width) @ power
            sketch[at : at + CODED] = np.packbits(bits[:, n : n + SKETCH], axis=1, bitorder="little").view("<u8")[:, 0]
        return keys, sketch

    def buckets(self, keys: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The bucket of each vector in each table."""
        return mixed(np.int64(len(self.mean)), label[:, None], np.arange(self.tables)[None, :], keys)


def learn_rotation(x: np.ndarray, bits: int, rng: np.random.Generator, rounds: int = 30) -> np.ndarray:
    """Principal directions, rotated so that signs lose least: alternate between codes and the best rotation."""
    values, vectors = np.linalg.eigh(x.T @ x / max(1, len(x)))
    p = vectors[:, np.argsort(-values)[:bits]]
    v = x @ p
    r = np.linalg.qr(rng.standard_normal((p.shape[1], p.shape[1])))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
        r = w.T @ u.T
    return p @ r


def build_index(sample: np.ndarray, rows: int, cosine: float, seed: int = 7) -> Index:
    """Substrings as wide as the number of rows that can meet asks for, and tables enough for ``MISS``.

    Near the threshold a bit differs about as often as the angle over pi; rotations are added until their bits
    fill the tables and the sketch.
    """
    dim = sample.shape[1]
    width = int(min(max(8, math.ceil(math.log2(max(2, rows)))), 48))
    differs = math.acos(cosine) / math.pi
    meets = (1 - differs) ** width
    tables = max(1, math.ceil(math.log(MISS) / math.log(1 - meets))) if meets < 1 else 1
    near = min(SKETCH, math.ceil(SKETCH * differs + REACH * math.sqrt(SKETCH * differs * (1 - differs))))
    rng = np.random.default_rng(seed)
    mean = sample.mean(0) if len(sample) else np.zeros(dim)
    need, rotations = width * tables + SKETCH, []
    while need > 0:
        r = learn_rotation(sample - mean, min(dim, need), rng) if len(sample) else np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        rotations.append(r)
        need -= r.shape[1]
    return Index(mean, tuple(rotations), width, tables, near)


def units_of(raw: pa.Array, dim: int) -> np.ndarray:
    """Stored vectors (their doubles as bytes) as unit rows; squares can neither overflow nor vanish."""
    x = np.frombuffer(b"".join(raw.to_pylist()), "<f8").reshape(-1, dim)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _classed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, dim, digest of the direction, and the vector; digest null where a vector links with nothing."""
    for b in batches:
        label = b.column("label")
        dim, digest, raw = [], [], []
        for known, v in zip(label.is_valid().to_pylist(), b.column("v"), strict=True):
            x = v.values.to_numpy(zero_copy_only=False).astype("<f8") if known and v.is_valid else np.zeros(0)  # null components: nan
            top = np.abs(x).max(initial=0.0)
            ok = bool(len(x)) and bool(np.isfinite(top)) and top > 0
            if ok:
                scaled = x / top
                unit = scaled / np.sqrt((scaled * scaled).sum()) + 0.0
            dim.append(len(x) if ok else None)
            digest.append(xxhash.xxh3_128_digest(unit.tobytes()) if ok else None)
            raw.append(x.tobytes() if ok else None)
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), label, pa.array(dim, pa.int32()), pa.array(digest, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "label", "dim", "digest", "v"])


def _runs(key: np.ndarray) -> np.ndarray:
    """Where runs of equal rows start, and the end."""
    return np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1, [len(key)]])


def _whole_runs(batches: Iterator[pa.RecordBatch], cols: tuple[str, ...], most: int | None = None) -> Iterator[tuple[pa.Table, bool]]:
    """Sorted batches as tables that end where a run of equal ``cols`` ends; True: the run goes on in the next one.

    A run of more than ``most`` rows comes in several tables.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        key = np.stack([b.column(c).to_numpy() for c in cols], 1)
        cut = np.flatnonzero((key != key[-1]).any(1))
        cut = int(cut[-1]) + 1 if len(cut) else 0  # rows of the last, open run start here
        if cut or held and (last != key[-1]).any():
            held.append(b.slice(0, cut))
            yield pa.Table.from_batches(held), False
            held = []
        held.append(b.slice(cut))
        last = key[-1]
        if most is not None and sum(x.num_rows for x in held) > most:
            yield pa.Table.from_batches(held), True
            held = []
    if held:
        yield pa.Table.from_batches(held), False


#: Compared cells at once, and linked pairs whose substrings are compared at once.
ROOM, PAIRS = 1 << 21, 1 << 16


def _members(near: dict[int, int], tile: int):
    """Of slots sorted by bucket: those that have a partner near by sketch, with their place in the bucket.

    Buckets of more than ``tile`` slots pass whole; no more than about two tiles of slots are held.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passing, place = None, 0  # the bucket that is passed whole, and its slots so far
        for t, more in _whole_runs(batches, ("bucket",), tile):
            bucket, cid, sketch, dim = (t.column(c).to_numpy() for c in ("bucket", "cid", "sketch", "dim"))
            sketch = sketch.view(np.uint64)  # bits of a signed difference would be counted of its absolute value
            starts = _runs(bucket[:, None])
            pos = np.arange(len(bucket)) - np.repeat(starts[:-1], np.diff(starts))
            keep = np.zeros(len(bucket), bool)
            if passing is not None and bucket[0] == passing:
                pos[: starts[1]] += place
                keep[: starts[1]] = True
            if more:
                keep[starts[-2] :] = True
                place = int(pos[-1]) + 1
            passing = int(bucket[-1]) if more else None
            sizes = np.diff(starts)
            fresh = ~keep[starts[:-1]]
            for s in np.unique(sizes[fresh & (sizes > 1)]):
                at = starts[:-1][fresh & (sizes == s)]
                rows = max(1, min(int(s), ROOM // int(s)))
                for c in range(0, len(at), max(1, ROOM // int(s * s))):
                    part = at[c : c + max(1, ROOM // int(s * s))][:, None] + np.arange(s)
                    x, d = sketch[part], dim[part]
                    limit = np.array([near[int(k)] for k in d[:, 0]])[:, None, None]
                    for r in range(0, int(s), rows):
                        away = np.bitwise_count(x[:, r : r + rows, None] ^ x[:, None, :])
                        away[:, np.arange(away.shape[1]), np.arange(r, r + away.shape[1])] = SKETCH + 1
                        keep[part[:, r : r + rows]] = (away <= limit).any(-1)
            k = np.flatnonzero(keep)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[k]), pa.array(cid[k]), pa.array(pos[k])], names=["bucket", "cid", "pos"])

    return work


def _least_labels(link: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least id reachable over the links between left and right rows; the last two axes of ``link`` are theirs."""
    top = np.iinfo(np.int64).max
    while True:
        new_left = np.minimum(left, np.where(link, right[..., None, :], top).min(-1, initial=top))
        new_right = np.minimum(right, np.where(link, new_left[..., :, None], top).min(-2, initial=top))
        if (new_left == left).all() and (new_right == right).all():
            return left, right
        left, right = new_left, new_right


def _compare(index: Index, left: tuple, right: tuple, bucket: np.ndarray, cosine: float, same: bool):
    """Rows that each left class links with, and (class, least reachable class) of classes that have a link.

    A side: (classes, numbers of rows, unit vectors, substrings, buckets by table), each with the group as first axis. A pair
    counts in the bucket of the first table in which it agrees.
    """
    ids, _, x, k, homes = left
    ids2, rows2, y, k2, _ = right
    link = np.einsum("gid,gjd->gij", x, y) >= cosine
    link &= ids[:, :, None] != ids2[:, None, :]
    cells = link.reshape(-1)
    pairs = np.flatnonzero(cells)
    for at in range(0, len(pairs), PAIRS):
        some = pairs[at : at + PAIRS]
        g, i, j = np.unravel_index(some, link.shape)
        first = (k[g, i] == k2[g, j]).argmax(1)  # sharing a bucket, they agree somewhere
        cells[some] = homes[g, i, first] == bucket[g]
    n = (link * rows2[:, None, :]).sum(-1)
    a, b = _least_labels(link, ids, ids2)
    out = [(ids[m], n[m], a[m]) for m in [n > 0]]
    if not same:
        m = link.any(-2)
        out.append((ids2[m], np.zeros(int(m.sum()), np.int64), b[m]))
    return out


GROUP = ("bucket", "tile", "label", "dim")


def _buckets(indexes: dict[int, Index], cosine: float):
    """Rows come sorted by bucket and tile; buckets of one size are compared together."""

    def side(t: pa.Table, rows: np.ndarray, dim: int, shape: tuple[int, int]) -> tuple:
        index = indexes[dim]
        unit = units_of(t.column("v").take(pa.array(rows)), dim)
        keys, _ = index.codes(unit)
        homes = index.buckets(keys, t.column("label").to_numpy()[rows])
        return tuple(v.reshape(*shape, *v.shape[1:]) for v in (t.column("cid").to_numpy()[rows], t.column("n").to_numpy()[rows], unit, keys, homes))

    def crossed(t: pa.Table, dim: int, left: np.ndarray, right: np.ndarray, bucket: np.ndarray) -> list:
        """Of one large bucket: left rows against right ones, as many at once as there is room for."""
        y = side(t, right, dim, (1, len(right)))
        per = max(1, ROOM // len(right))
        found = []
        for c in range(0, len(left), per):
            part = left[c : c + per]
            found += _compare(indexes[dim], side(t, part, dim, (1, len(part))), y, bucket, cosine, False)
        return found

    def closed(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key = np.stack([t.column(c).to_numpy() for c in GROUP], 1)
        role = t.column("role").to_numpy()
        starts = _runs(key)
        sizes = np.diff(starts)
        found = []
        both = role[starts[:-1]] == 0
        for dim in np.unique(key[:, 3]).tolist():
            mine = key[starts[:-1], 3] == dim
            for s in np.unique(sizes[both & mine & (sizes > 1)]).tolist():
                at = starts[:-1][both & mine & (sizes == s)]
                if s * s > ROOM:
                    for a in at.tolist():
                        rows = np.arange(a, a + s)
                        found += crossed(t, dim, rows, rows, key[a : a + 1, 0])
                    continue
                per = max(1, ROOM // (s * max(s, dim)))
                for c in range(0, len(at), per):
                    part = at[c : c + per]
                    one = side(t, (part[:, None] + np.arange(s)).ravel(), dim, (len(part), s))
                    found += _compare(indexes[dim], one, one, key[part, 0], cosine, True)
        for a, z in zip(starts[:-1][~both], starts[1:][~both], strict=True):
            dim = int(key[a, 3])
            rows = np.arange(a, z)
            l, r = rows[role[a:z] == 1], rows[role[a:z] == 2]
            if not len(r):
                continue
            found += crossed(t, dim, l, r, key[a : a + 1, 0])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*found, strict=True)], names=["cid", "n", "least"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in _whole_runs(batches, GROUP):
            yield from closed(t.combine_chunks())

    return work


def embedding_components(vectors: DataFrame, cosine: float = 0.98, sample: int = SAMPLE, tile: int = TILE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, n_links, component_id, kept: one row per row of ``vectors``.

    Every row is a vector of its own, one that repeats an id or has none too. Only vectors with equal labels and of
    one length link. A null label, and a vector that is null, empty, zero or holds null or non-finite components,
    links with nothing. component_id is the least id that is reached, null where no vector reached has one; kept is
    true where it is the row's own id. Lengths have an index each. An empty table gives an empty result.
    """
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
    kinds = "vec_id long, label long, dim int, digest binary, v binary"
    rows = src.mapInArrow(_classed, kinds)
    good = rows.filter(F.col("digest").isNotNull())
    grouped = good.groupBy("label", "dim", "digest").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("least_id"), F.min("v").alias("v"))
    classes = stable(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    narrow = stable(rows.drop("v"), "directions")

    # of each length: its classes, and the most that can meet
    sizes = classes.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count").alias("meet"), F.sum("count").alias("all")).collect()  # a row a length
    indexes: dict[int, Index] = {}
    for r in sizes:
        share = min(1.0, 1.1 * sample / r["all"])
        some = classes.filter((F.col("dim") == r["dim"]) & (F.pmod(F.xxhash64("cid"), F.lit(1 << 40)) <= int(share * (1 << 40)))).select("v").limit(sample).toArrow()
        indexes[r["dim"]] = build_index(units_of(some.column("v"), r["dim"]), r["meet"], cosine)
    if not indexes:
        return narrow.select(F.col("vec_id").alias(id_col), F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            all_dims, cid, label = b.column("dim").to_numpy(), b.column("cid").to_numpy(), b.column("label").to_numpy()
            for dim in np.unique(all_dims).tolist():
                m = np.flatnonzero(all_dims == dim)
                index = indexes[dim]
                keys, sketch = index.codes(units_of(b.column("v").take(pa.array(m)), dim))
                k = index.tables
                yield pa.RecordBatch.from_arrays(
                    [pa.array(index.buckets(keys, label[m]).ravel()), pa.array(np.repeat(cid[m], k)), pa.array(np.repeat(sketch.view(np.int64), k)), pa.array(np.full(len(m) * k, dim, np.int32))], names=["bucket", "cid", "sketch", "dim"]
                )

    dealt = classes.select("cid", "label", "dim", "v").mapInArrow(slots, "bucket long, cid long, sketch long, dim int")
    near = {dim: x.near for dim, x in indexes.items()}
    members = stable(dealt.repartition("bucket").sortWithinPartitions("bucket", "cid").mapInArrow(_members(near, tile), "bucket long, cid long, pos long"), "members")
    large = members.groupBy("bucket").agg(F.max("pos").alias("last")).filter(F.col("last") >= tile).select("bucket", F.ceil((F.col("last") + 1) / tile).cast("int").alias("k"))
    placed = members.join(large, "bucket", "left")
    own = F.pmod(F.xxhash64("cid"), F.col("k")).cast("int")
    span = F.sequence(F.lit(0), F.col("k") - 1)
    tiles = F.when(F.col("k").isNull(), F.array(F.struct(F.lit(0).alias("tile"), F.lit(0).alias("role")))).otherwise(
        F.concat(
            F.transform(span, lambda j: F.struct((own * F.col("k") + j).alias("tile"), F.lit(1).alias("role"))),
            F.transform(span, lambda i: F.struct((i * F.col("k") + own).alias("tile"), F.lit(2).alias("role"))),
        )
    )
    units = placed.select("bucket", "cid", F.explode(tiles).alias("t")).select("bucket", "cid", F.col("t.tile").cast("long").alias("tile"), F.col("t.role").cast("long").alias("role"))
    held = units.join(classes.select("cid", "label", "dim", "n", "v"), "cid")
    met = held.repartition("bucket", "tile").sortWithinPartitions(*GROUP).mapInArrow(_buckets(indexes, cosine), "cid long, n long, least long")
    met = stable(met, "bucket-links")
    links = met.groupBy("cid").agg(F.sum("n").alias("more"))
    linked = connected_components(met.select("cid", "least"), "cid", "least").withColumnRenamed("node", "cid")
    return _result(narrow, classes, links, linked, id_col)


def _result(narrow: DataFrame, classes: DataFrame, links: DataFrame, linked: DataFrame, id_col: str) -> DataFrame:
    """Rows with what their class knows; classes of one row and no link have nothing to tell."""
    named = classes.select("cid", "label", "dim", "digest", "n", "least_id").join(links, "cid", "left").join(linked.withColumnRenamed("label", "root"), "cid", "left")
    told = stable(named.filter((F.col("n") > 1) | F.col("root").isNotNull()).withColumn("root", F.coalesce("root", "cid")), "linked-classes")
    least = told.groupBy("root").agg(F.min("least_id").alias("component_id"))
    info = told.join(least, "root").select("label", "dim", "digest", (F.col("n") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id", F.lit(True).alias("known"))
    out = narrow.join(info, ["label", "dim", "digest"], "left")
    component = F.when(F.col("known"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select(F.col("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("vec_id")).alias("kept"))
