"""Mixing sources to target weights by systematic sampling.

Within a source, documents stand in order of size and id. Each one's expected copies are the source's target
over its size; their prefix sum plus one random offset of the source is cut at the integers, and a document is
taken once per integer it crosses. Sorting by size makes the sample a stratified one, so the taken words stay
near the target. Ranks come from a range partitioning by (source, size, id): a source with a third of all rows
is cut between tasks, and only one row per source and partition is summed up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import stable


#: Sources that may come to the driver, a size and a weight each.
FEW = 10_000


def word_count(col: str) -> Column:
    """Number of runs without ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(F.col(col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _numbered(by_source: DataFrame) -> DataFrame:
    """source, source_size, nth: sources by code point from 1, null last; ranked within ranges, not in one task."""
    dealt = stable(by_source.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources-by-range")
    at, base = 0, []
    for r in sorted(dealt.groupBy("part").count().collect()):  # a row a partition
        base.append((r["part"], at))
        at += r["count"]
    bases = dealt.sparkSession.createDataFrame(base, "part int, base long")
    local = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    return dealt.withColumn("local", local).join(F.broadcast(bases), "part").select("source", "source_size", (F.col("base") + F.col("local")).alias("nth"))


def _level(sources: DataFrame, share: float, cap: int) -> float | None:
    """The target per weight of sources that aren't capped; None where all are.

    In order of size per weight the capped sources come first, so the first one that its level fits decides. Sums
    between quantiles narrow the place down until ``FEW`` sources are left, and these come to the driver.
    """
    total = sources.agg(F.sum("source_size").alias("s"), F.sum("w").alias("w")).head()
    if total["w"] is None:
        return None
    level = lambda s, w: (total["s"] * share - s * cap) / (total["w"] - w) if total["w"] > w else None
    left, size, weight = sources.withColumn("fill", F.col("source_size") / F.col("w")), 0, 0  # sums of those known to be capped
    top = None  # (size, weight) of all before the bracket's upper end, where one is known to fit beyond it
    n = left.count()
    while n > FEW:
        cuts = sorted(set(left.agg(F.percentile_approx("fill", [k / 64 for k in range(1, 64)], 10_000)).head()[0]))
        slot = sum(((F.col("fill") >= c).cast("int") for c in cuts), F.lit(0))
        sums = {r["slot"]: r for r in left.groupBy(slot.alias("slot")).agg(F.sum("source_size").alias("s"), F.sum("w").alias("w")).collect()}  # 64 rows
        lo = None
        for k, c in enumerate(cuts):
            below = sums.get(k)
            s, w = (size + below["s"], weight + below["w"]) if below else (size, weight)
            x = level(s, w)
            if x is not None and x <= cap * c:
                top = (s, w)
                left = left.filter(F.col("fill") < c)
                break
            size, weight, lo = s, w, c
        if lo is not None:
            left = left.filter(F.col("fill") >= lo)
        before, n = n, left.count()
        if n == before:  # one value fills the bracket's lower end: decide it, and go on above it
            least = left.agg(F.min("fill")).head()[0]
            x = level(size, weight)
            if x <= cap * least:
                return x
            here = left.filter(F.col("fill") == least).agg(F.sum("source_size").alias("s"), F.sum("w").alias("w")).head()
            size, weight, left = size + here["s"], weight + here["w"], left.filter(F.col("fill") > least)
            n = left.count()
    for r in left.groupBy("fill").agg(F.sum("source_size").alias("s"), F.sum("w").alias("w")).orderBy("fill").collect():  # FEW rows at most
        x = level(size, weight)
        if x <= cap * r["fill"]:
            return x
        size, weight = size + r["s"], weight + r["w"]
    return level(*top) if top else None


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, cap: int) -> DataFrame:
    """source, source_size, target: one row a source.

    Sources by code point, null last, take ``weights`` in turn. Where a target would pass ``cap`` times the
    source's size it stops there and the excess is shared among the others by weight, until none is above.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(int(x)) for x in weights]), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    named = stable(_numbered(by_source).withColumn("w", w.cast("long")), "sources")
    level = _level(named, share, cap)
    top = F.col("source_size") * F.lit(float(cap))
    return named.select("source", "source_size", (top if level is None else F.least(F.lit(level) * F.col("w"), top)).alias("target"))


def offset_of(source: Column, seed: str) -> Column:
    """In [0, 1), from the MD5 of seed and source: the same on every run and in every engine."""
    head = F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(source, F.lit(""))).cast("binary")), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(4294967296.0)


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: int = 2, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """id, size, source_size, target, copies, taken for every row.

    copies: how often the mix takes the document, ``cap`` at most; taken = copies * size. Null text has size 0;
    a null source is a source of its own, the last one. Documents of size 0 are copied like others and take no
    words; a source without words has target 0 and gives no copies. Rows that tie in source, size and id are
    interchangeable. An empty table gives an empty result.
    """
    sized = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"))
    keys = [F.col("source").asc_nulls_last(), F.col("size").asc(), F.col("id").asc_nulls_first()]
    # the text is read once; what is dealt by range is three narrow columns
    narrow = stable(sized, "sizes")
    dealt = stable(narrow.repartitionByRange(*keys).withColumn("part", F.spark_partition_id()), "sizes-by-range")
    sums = stable(dealt.groupBy("source", "part").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("size")), "sums")
    targets = source_targets(sums, weights, share, cap)
    before = F.coalesce(F.sum("rows").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = sums.select("source", "part", before.alias("base"))
    same = F.col("b.source").eqNullSafe(F.col("t.source"))
    per_part = base.alias("b").join(targets.alias("t"), same).select("b.source", "b.part", "b.base", "t.source_size", "t.target")
    per_part = stable(per_part, "bases")
    local = F.row_number().over(W.partitionBy("source", "part").orderBy("size", F.col("id").asc_nulls_first()))
    ranked = dealt.withColumn("local", local)
    match = F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r.part") == F.col("p.part"))
    full = ranked.alias("r").join(per_part.alias("p"), match).select("r.*", "p.base", "p.source_size", "p.target")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rank = F.col("base") + F.col("local")
    u = offset_of(F.col("source"), seed)
    copies = F.least(F.lit(cap), F.floor(u + rank * rate) - F.floor(u + (rank - 1) * rate)).cast("long")
    return full.withColumn("copies", copies).select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
