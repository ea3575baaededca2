"""The lint report: findings with places, merged and grouped, and the files at or above a tier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import fixed as V
from .audit import tier_rank

SEVERITIES = ("critical", "high", "medium", "low")


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity) - 1


def register_for(path: Column, override: str | None = None) -> Column:
    """A given register, else docs for Markdown files, else none."""
    return F.lit(override) if override else F.when(path.rlike(r"(?i)\.mdx?\z"), F.lit("docs"))


def merge_duplicate_spans(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Findings of the same term at the same spans become one.

    The most severe one, the first of equals, gives the row; subcategories are joined, hint and note taken from
    the first that has them. Findings without matches stay as they are.
    """
    key = F.array_join(F.transform("matches", lambda m: F.concat_ws("-", m["start"].cast("string"), m["end"].cast("string"))), ",")
    spans = F.when(F.size("matches") > 0, key).otherwise(F.concat(F.lit("#"), F.col("ord").cast("string")))
    d = found.withColumn("_key", spans).withColumn("_term", F.lower("term")).withColumn("_sev", severity_rank(F.col("severity")))
    g = d.groupBy(id_col, "_term", "_key").agg(
        F.min_by(F.struct(*[c for c in found.columns if c != id_col]), F.struct("_sev", "ord")).alias("p"),
        F.sort_array(F.collect_list(F.struct("ord", "subcategory", "hint", "note"))).alias("all"),
        F.min("ord").alias("first_ord"),
    )
    each = lambda c: F.transform("all", lambda x: x[c])
    joined = F.array_join(F.array_distinct(each("subcategory")), ", ")
    kept = [c for c in found.columns if c not in (id_col, "ord", "subcategory", "hint", "note")]
    return g.select(
        id_col, F.col("first_ord").alias("ord"), joined.alias("subcategory"), F.coalesce("p.hint", F.get(F.array_compact(each("hint")), F.lit(0))).alias("hint"),
        F.coalesce("p.note", F.get(F.array_compact(each("note")), F.lit(0))).alias("note"), *[F.col(f"p.{c}").alias(c) for c in kept],
    )


def finding_order(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Scored first, then by count, then in the lexicon's order; ``nth`` from 1."""
    return found.withColumn("nth", F.row_number().over(W.partitionBy(id_col).orderBy(F.col("scored").desc(), F.col("count").desc(), "ord")))


def grouped(found: DataFrame, id_col: str = "doc_id", cap: int | None = V.LEXICAL_CAP) -> DataFrame:
    """Scored findings with group, group_nth, nth and omitted: as the report shows them.

    Lexical findings form one group by count and term, the first ``cap`` of them shown (None: all); others stand by category,
    severity and count. Rhythm and structure come first, then the groups with most matches.
    """
    lexical = F.col("category").isin(*V.LEXICAL_CATEGORIES)
    d = found.filter("scored").withColumn("grp", F.when(lexical, F.lit(V.LEXICAL_GROUP)).otherwise(F.col("category")))
    by_group = W.partitionBy(id_col, "grp")
    d = d.withColumn("_total", F.sum("count").over(by_group)).withColumn("_size", F.count(F.lit(1)).over(by_group)).withColumn("_first", F.min("ord").over(by_group))
    inner = by_group.orderBy(
        F.when(lexical, F.lit(0)).otherwise(severity_rank(F.col("severity"))), F.col("count").desc(), F.when(lexical, F.lower("term")), "ord"
    )
    outer = W.partitionBy(id_col).orderBy((~F.col("grp").rlike("(?i)rhythm|structural")).cast("int"), F.col("_total").desc(), "_first")
    d = d.withColumn("nth", F.row_number().over(inner)).withColumn("group_nth", F.dense_rank().over(outer))
    if cap is None:
        return d.withColumn("omitted", F.lit(0)).drop("_total", "_size", "_first")
    shown = ~lexical | (F.col("nth") <= cap)
    omitted = F.when(F.col("grp") == V.LEXICAL_GROUP, F.greatest(F.lit(0), F.col("_size") - cap)).otherwise(F.lit(0))
    return d.filter(shown).withColumn("omitted", omitted).drop("_total", "_size", "_first")


def failing(results: DataFrame, threshold: str = "orange") -> DataFrame:
    """Rows whose tier is at or above the threshold."""
    return results.filter(tier_rank(F.col("tier")) >= V.TIERS.index(threshold))
