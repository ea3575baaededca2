"""Best-fit packing of token sequences by patterns.

The histogram of piece lengths (at most ``width`` entries, however large the corpus) goes to the driver. Patterns
of two and three lengths that fill a sequence exactly or nearly are enumerated, their repeat counts fitted to
the histogram by non-negative least squares, rounded down, and what is left is packed best-fit-decreasing, whole
runs of equal lengths at a time. The outcome is a table of intervals: of the pieces of one length, those with
ranks in an interval go to certain slots of consecutive sequences. Each piece finds its place by its rank.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import stable, whole

#: Blocks into which the pieces of one length are dealt for ranking.
BLOCKS = 128
#: Rows of a table that may be broadcast.
MOST = 1_000_000


# Fixed value: the splitting pattern of the byte-level pre-tokenizer.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A run of white space longer than this goes to the tokenizer itself: the faster splitter's pattern backtracks.
LONG_RUN = 20_000
_long_run = re.compile(rf"\s{{{LONG_RUN}}}")
_loaded: dict = {}


class TextIds:
    """Token ids of whole texts as little-endian 32-bit bytes.

    Where the vocabulary is a byte-level one whose ids are its merge ranks, a faster merge loop over the same
    vocabulary gives the same ids; else, in texts where an added token or a very long run of white space occurs, and
    where the faster splitter gives up on a text, the tokenizer itself does.
    """

    def __init__(self, tokenizer_path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        spec = json.loads(self.tokenizer.to_str())
        self.added = [t["content"] for t in spec["added_tokens"]]
        self.core = self._core(spec)

    def _core(self, spec: dict):
        import tiktoken

        model, before, added = spec["model"], spec["pre_tokenizer"] or {}, set(self.added)
        if before.get("type") != "ByteLevel" or before["add_prefix_space"] or not before.get("use_regex", True) or spec["normalizer"] is not None or spec["truncation"] is not None:
            return None
        if model["type"] != "BPE" or any(model.get(k) for k in ("continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "dropout", "ignore_merges")):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in shown)}
        vocab = {bytes(byte_of[c] for c in w): i for w, i in model["vocab"].items() if w not in added}
        made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if made != sorted(made) or len(vocab) != len(made) + 256:
            return None
        return tiktoken.Encoding("text-ids", pat_str=SPLIT, mergeable_ranks=vocab, special_tokens={})

    @classmethod
    def load(cls, path: str) -> TextIds:
        """One for each worker process."""
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def encode(self, text: str) -> bytes:
        if self.core is not None and not any(t in text for t in self.added) and not _long_run.search(text):
            try:
                return np.asarray(self.core.encode_ordinary(text), "<u4").tobytes()
            except BaseException as e:  # the splitter's stack overflow arrives as a panic, which is no Exception
                if type(e).__name__ != "PanicException":
                    raise
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def cut(docs: DataFrame, tokenizer_path: str, end_id: int, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32, ids (little-endian 32-bit) of every piece of every document."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = TextIds.load(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            held = 0
            for i, text in zip(b.column("id").to_pylist(), b.column("text"), strict=True):
                ids = words.encode(text.as_py()) + end
                n = len(ids) // 4
                a = n % width or width
                cuts = [0, *range(a, n, width), n]
                for k, (s, e) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    part = ids[4 * s : 4 * e]
                    for col, x in zip(rows, (i, k, s, e - s, zlib.crc32(part), part), strict=True):
                        col.append(x)
                held += len(ids)
                if held > 8 << 20:
                    yield _pieces(rows)
                    rows, held = ([], [], [], [], [], []), 0
            if rows[0]:
                yield _pieces(rows)

    return src.mapInArrow(work, "id long, piece int, start long, length long, ids_crc32 long, ids binary")


def _pieces(rows: tuple[list, ...]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names=["id", "piece", "start", "length", "ids_crc32", "ids"])


def patterns_for(lengths: np.ndarray, width: int, slack: int) -> np.ndarray:
    """Index triples into ``lengths`` (-1: unused) of one to three pieces that leave at most ``slack`` free."""
    at = np.full(width + 1, -1)
    at[lengths] = np.arange(len(lengths))
    found = []
    for free in range(slack + 1):
        fill = width - free
        if fill <= width and fill > 0 and at[fill] >= 0:
            found.append(np.array([[at[fill], -1, -1]]))
        a = lengths[2 * lengths <= fill]
        b = fill - a
        ok = at[b] >= 0
        found.append(np.stack([at[a[ok]], at[b[ok]], np.full(ok.sum(), -1)], 1))
        x, y = np.meshgrid(lengths, lengths, indexing="ij")
        m = (x <= y) & (fill - x - y >= y)
        x, y = x[m], y[m]
        z = fill - x - y
        ok = at[z] >= 0
        found.append(np.stack([at[x[ok]], at[y[ok]], at[z[ok]]], 1))
    return np.concatenate(found) if found else np.zeros((0, 3), int)


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 that minimise |A x - counts|^2, by accelerated projected gradients."""
    n = len(counts)
    used = patterns >= 0
    idx = np.where(used, patterns, n)

    def forward(x: np.ndarray) -> np.ndarray:
        return np.bincount(idx.ravel(), np.repeat(x, 3), n + 1)[:n]

    def back(r: np.ndarray) -> np.ndarray:
        return np.append(r, 0.0)[idx].sum(1)

    v = np.ones(len(patterns))
    for _ in range(20):  # largest eigenvalue of A'A
        v = back(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    step = 1.0 / (1.05 * norm)
    x = np.zeros(len(patterns))
    y, t = x, 1.0
    for _ in range(rounds):
        new = np.maximum(0.0, y - step * back(forward(y) - counts))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x


def plan(hist: dict[int, int], width: int, slack: int = 0) -> list[tuple[tuple[int, ...], int]]:
    """(lengths in a sequence, number of such sequences); every piece of the histogram is placed once."""
    lengths = np.array(sorted(hist), np.int64)
    left = np.array([hist[int(v)] for v in lengths], np.int64)
    out: list[tuple[tuple[int, ...], int]] = []
    if len(lengths):
        pats = patterns_for(lengths, width, slack)
        if len(pats):
            x = fit(pats, left.astype(float))
            for p in np.argsort(-x, kind="stable"):
                idx = pats[p][pats[p] >= 0]
                want = int(x[p] + 1e-6)
                if want < 1:
                    break
                kinds, mult = np.unique(idx, return_counts=True)
                n = int(min(want, (left[kinds] // mult).min()))
                if n:
                    left[kinds] -= n * mult
                    out.append((tuple(int(v) for v in lengths[idx]), n))
    bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # free room: kinds of open sequences
    rooms: list[int] = []

    def put(free: int, kind: tuple[int, ...], n: int) -> None:
        if free not in bins:
            bins[free] = []
            bisect.insort(rooms, free)
        bins[free].append((kind, n))

    for v, n in zip(lengths[::-1].tolist(), left[::-1].tolist(), strict=True):
        while n:
            k = bisect.bisect_left(rooms, v)
            if k == len(rooms):
                per = min(width // v, n)
                full, rest = divmod(n, per)
                put(width - per * v, (v,) * per, full)
                if rest:
                    put(width - rest * v, (v,) * rest, 1)
                n = 0
                continue
            free = rooms[k]
            kind, m = bins[free].pop()
            if not bins[free]:
                del bins[free]
                rooms.pop(k)
            fits = free // v  # of this length in each
            take = min(m, max(1, n // fits)) if n >= fits else 1
            per = fits if n >= fits else n
            put(free - per * v, kind + (v,) * per, take)
            if m > take:
                put(free, kind, m - take)
            n -= take * per
    out += [x for kinds in bins.values() for x in kinds]
    return out


def intervals(packed: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces of it in each, offset of the first of them)."""
    used: dict[int, int] = {}
    out, seq = [], 0
    for kind, n in packed:
        at = 0
        for v in sorted(set(kind), reverse=True):
            m = kind.count(v)
            a = used.get(v, 0)
            out.append((v, a, a + n * m, seq, m, at))
            used[v] = a + n * m
            at += m * v
        seq += n
    return out


def pack(docs: DataFrame, tokenizer_path: str, end_id: int, width: int = 1024, slack: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset (and ids, if asked for) of every piece.

    A document is its text's ids and then ``end_id``; null text is empty. One longer than ``width`` is cut into
    pieces of ``width``, of which the first may be shorter. Sequences have no gaps. Repeated rows are packed
    each; pieces of the same length and id are interchangeable. An empty table gives an empty result.
    """
    pieces = stable(cut(docs, tokenizer_path, end_id, width, id_col, text_col) if with_ids else cut(docs, tokenizer_path, end_id, width, id_col, text_col).drop("ids"), "pieces")
    block = F.pmod(F.xxhash64("id", "piece"), F.lit(BLOCKS)).cast("int")
    pieces = pieces.withColumn("block", block)
    counts = pieces.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n")).collect()  # width * BLOCKS at most
    hist: dict[int, int] = {}
    base = []
    for r in sorted(counts, key=lambda r: (r["length"], r["block"])):
        base.append((r["length"], r["block"], hist.get(r["length"], 0)))
        hist[r["length"]] = hist.get(r["length"], 0) + r["n"]
    spark = docs.sparkSession
    # bounded whatever the corpus: width * BLOCKS rows, and three intervals a pattern or kind of open sequence; checked all the same
    few = lambda df, rows: F.broadcast(df) if rows <= MOST else df
    bases = few(spark.createDataFrame(base, "length long, block int, base long"), len(base))
    found = intervals(plan(hist, width, slack))
    places = spark.createDataFrame(found, "length long, a long, z long, seq long, m int, at long")
    narrow = pieces.drop("ids")
    rank = F.row_number().over(W.partitionBy("length", "block").orderBy(F.col("id").asc_nulls_first(), "piece", "ids_crc32")) - 1
    ranked = narrow.withColumn("r", rank).join(bases, ["length", "block"]).withColumn("r", F.col("r") + F.col("base"))
    # of each length the intervals' starts in order; a search in the array finds the one of a rank
    lists = places.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("a", "seq", "m", "at"))).alias("list"))
    placed = ranked.join(few(lists, len(found)), "length").withColumn("slot", _last_at_most())
    k = F.col("r") - F.col("slot.a")
    out = placed.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", (F.col("slot.seq") + F.floor(k / F.col("slot.m"))).cast("long").alias("sequence_id"), (F.col("slot.at") + F.pmod(k, F.col("slot.m")) * F.col("length")).cast("long").alias("offset")
    )
    if with_ids:
        out = out.join(pieces.select(F.col("id").alias(id_col), "piece", "ids_crc32", "ids").dropDuplicates([id_col, "piece", "ids_crc32"]), [id_col, "piece", "ids_crc32"])
    return out


def _last_at_most():
    """Of the sorted ``list``, the last element whose start is at most ``r``."""
    return F.element_at(F.filter("list", lambda x: x["a"] <= F.col("r")), -1)
