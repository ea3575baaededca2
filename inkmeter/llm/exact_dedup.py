"""Exact duplicates by a content sort.

Rows are range-partitioned by splitters sampled from (first bytes, SHA-256, id) of the normalised text: small however
long the texts are, and a large group of copies is cut between tasks like any other run of rows. Within a partition
Spark's external sort orders rows by the normalised bytes themselves, so equal texts are adjacent, and neighbours are
compared in full. Equal texts share the first bytes and the digest, so only the runs with a partition's least and
greatest of both can go on in another partition: these two come out with their texts and are compared there too.

A text goes through the shuffle once: as normalised bytes, with a bit a byte for what was a capital.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stable

#: Bytes of a text that splitters hold.
PREFIX = 64
_LEAST = np.iinfo(np.int64).min


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and where each string starts, and the end."""
    raw = texts.cast(pa.large_binary())
    at = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    return np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] is not None else np.zeros(0, np.uint8), at


def capitals(text: pa.Array, low: pa.Array) -> list[bytes | None]:
    """For each text, a bit for every byte that lower-casing changed; empty for none, None for a null text."""
    a, at = _bytes_of(text.fill_null(""))
    b, bt = _bytes_of(low)
    out: list[bytes | None] = []
    for known, s, e, t in zip(text.is_valid().to_pylist(), at[:-1], at[1:], bt[:-1], strict=True):
        changed = a[s:e] != b[t : t + e - s]
        out.append(None if not known else np.packbits(changed).tobytes() if changed.any() else b"")
    return out


def restored(low: str, mask: bytes | None) -> str | None:
    """The text of which ``low`` and ``mask`` were made."""
    if not mask:
        return None if mask is None else low
    raw = np.frombuffer(low.encode("utf-8", "surrogatepass"), np.uint8)
    return (raw - 32 * np.unpackbits(np.frombuffer(mask, np.uint8), count=len(raw))).astype(np.uint8).tobytes().decode("utf-8", "surrogatepass")


def _with_keys(carry: bool):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            low = pc.ascii_lower(b.column("text").fill_null(""))
            raw = low.cast(pa.binary())
            digest = pa.array([hashlib.sha256(x.as_buffer()).digest() for x in raw], pa.binary())
            head = pc.binary_slice(raw, 0, PREFIX)
            mask = pa.array(capitals(b.column("text"), low) if carry else [b""] * b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([head, digest, b.column("id"), low, mask, b.column("row")], names=["head", "digest", "id", "low", "mask", "row"])

    return work


def _runs(schema: pa.Schema, text_col: str | None):
    """Compare sorted neighbours; the first row of a run has its largest id. The last rows tell of the border runs."""
    row_type = schema.field("row").type

    def whole_rows(rows: pa.Array, low: list[str], mask: list[bytes | None]) -> pa.Array:
        """Rows with their text put back."""
        if text_col is None:
            return rows
        texts = pa.array([restored(x, m) for x, m in zip(low, mask, strict=True)], pa.string())
        fields = {rows.type.field(k).name: rows.field(k) for k in range(rows.type.num_fields)} | {text_col: texts}
        return pa.StructArray.from_arrays([fields[f.name].cast(f.type) for f in row_type], fields=list(row_type))

    def emit(ids, valid, digests, sizes, first_rows):
        """One chunk of whole runs. sizes: of each run; ids: of all rows; first_rows: one a run."""
        sizes = np.asarray(sizes, np.int64)
        start = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
        run = np.repeat(np.arange(len(sizes)), sizes)
        first = np.zeros(len(ids), bool)
        first[start] = True
        at = pa.array(np.where(first, run, 0), mask=~first)
        hexed = pa.array([d.hex() for d in digests], pa.string())
        none = pa.nulls(len(ids), pa.string())
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64(), mask=~valid), pa.array(ids[start][run], pa.int64(), mask=~valid[start][run]), pa.array(sizes[run]), pa.array(first), hexed.take(pa.array(run)), none, first_rows.take(at)], schema=schema
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, valid, digest, text, head, row = [], [], None, None, None, None  # of the run that is still open
        ends: dict[str, tuple] = {}  # the runs of the least and the greatest (head, digest): key, text, keep_id, size

        def tell(key: tuple, text: str, keep: int | None, size: int) -> None:
            if "least" not in ends or key < ends["least"][0]:
                ends["least"] = (key, text, keep, size)
            if "greatest" not in ends or key > ends["greatest"][0]:
                ends["greatest"] = (key, text, keep, size)

        def close() -> pa.RecordBatch:
            a, v = np.concatenate(ids), np.concatenate(valid)
            tell((head, digest), text, int(a[0]) if v[0] else None, len(a))
            return emit(a, v, [digest], [len(a)], row)

        for b in batches:
            n = b.num_rows
            if not n:
                continue
            low, dig, heads, rows, id_col = (b.column(c) for c in ("low", "digest", "head", "row", "id"))
            i, v = id_col.fill_null(int(_LEAST)).to_numpy(zero_copy_only=False), pc.is_valid(id_col).to_numpy(zero_copy_only=False)
            same = np.zeros(n, bool)
            if n > 1:
                same[1:] = pc.and_(pc.equal(dig[1:], dig[:-1]), pc.equal(low[1:], low[:-1])).to_numpy(zero_copy_only=False)
            same[0] = digest is not None and dig[0].as_py() == digest and low[0].as_py() == text
            starts = np.flatnonzero(~same)
            if not len(starts):
                ids.append(i), valid.append(v)
                continue
            if starts[0]:
                ids.append(i[: starts[0]]), valid.append(v[: starts[0]])
            if digest is not None:
                yield close()
            last = int(starts[-1])
            at = pa.array(starts)
            first_rows = whole_rows(rows.take(at), low.take(at).to_pylist() if text_col else [], b.column("mask").take(at).to_pylist() if text_col else [])
            if len(starts) > 1:
                sizes = np.diff(starts)
                keys = [(heads[int(s)].as_py(), dig[int(s)].as_py()) for s in starts[:-1]]
                for k in {min(range(len(keys)), key=keys.__getitem__), max(range(len(keys)), key=keys.__getitem__)}:
                    s = int(starts[k])
                    tell(keys[k], low[s].as_py(), int(i[s]) if v[s] else None, int(sizes[k]))
                yield emit(i[starts[0] : last], v[starts[0] : last], [d for _, d in keys], sizes, first_rows[: len(sizes)])
            ids, valid, digest, text, head = [i[last:]], [v[last:]], dig[last].as_py(), low[last].as_py(), heads[last].as_py()
            row = first_rows[len(starts) - 1 :]
        if digest is None:
            return
        yield close()
        borders = {x[0]: x for x in ends.values()}.values()  # one, where all rows are one run
        cols = [pa.nulls(len(borders), pa.int64()), pa.array([x[2] for x in borders], pa.int64()), pa.array([x[3] for x in borders], pa.int64()), pa.nulls(len(borders), pa.bool_())]
        more = [pa.array([x[0][1].hex() for x in borders], pa.string()), pa.array([x[1] for x in borders], pa.string()), pa.nulls(len(borders), row_type)]
        yield pa.RecordBatch.from_arrays([*cols, *more], schema=schema)

    return work


def content_sort_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 and, with ``carry``, row.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. The row with the largest
    id stays; of rows that repeat both id and text just one stays; a null id stays only where all ids of the
    group are null. ``row`` is the whole input row as a struct, present for kept rows only, so that input
    columns of any name can't clash with the results. An empty table gives an empty result.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = [c for c in docs.columns if c != text_col] if carry else [id_col]
    packed = F.struct(*[F.col(f"`{c}`") for c in fields])
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), packed.alias("row"))
    row_type = docs.schema if carry else src.schema["row"].dataType
    types = {"head": T.BinaryType(), "digest": T.BinaryType(), "id": T.LongType(), "low": T.StringType(), "mask": T.BinaryType(), "row": src.schema["row"].dataType}
    out = T.StructType([T.StructField(n, t) for n, t in (("id", T.LongType()), ("keep_id", T.LongType()), ("group_size", T.LongType()), ("kept", T.BooleanType()), ("text_sha256", T.StringType()), ("border", T.StringType()), ("row", T.StructType([T.StructField(f.name, f.dataType) for f in row_type])))])
    keyed = src.mapInArrow(_with_keys(carry), T.StructType([T.StructField(n, t) for n, t in types.items()]))
    newest = F.col("id").desc_nulls_last()
    ranged = keyed.repartitionByRange("head", "digest", newest).sortWithinPartitions("low", newest)
    runs = ranged.mapInArrow(_runs(to_arrow_schema(out), text_col if carry else None), out)
    both = stable(runs if carry else runs.drop("row"), "content-sort")
    # two rows a partition at most, compared by their whole texts
    told = both.filter(F.col("border").isNotNull())
    border = told.groupBy("text_sha256", "border").agg(F.max("keep_id").alias("all_keep"), F.sum("group_size").alias("all_size"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").drop("border")
    joined = both.filter(F.col("border").isNull()).drop("border").join(F.broadcast(border), "text_sha256", "left")
    keep, size = F.when(F.col("parts").isNotNull(), F.col("all_keep")).otherwise(F.col("keep_id")), F.coalesce("all_size", "group_size")
    kept = F.col("kept") & F.col("keep_id").eqNullSafe(keep)
    cols = [F.col("id").alias(id_col), keep.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), "text_sha256"]
    if carry:
        cols.append(F.when(kept, F.col("row")).alias("row"))
    return joined.select(*cols)
