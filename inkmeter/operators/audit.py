"""The audit: findings, score and tier of every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import text as X
from . import facts as facts_ops
from . import lexicon as L
from . import rhythm


def pick(key: Column, table: dict, default: Column) -> Column:
    for k, v in table.items():
        default = F.when(key == k, F.lit(v)).otherwise(default)
    return default


def repetition_weight(count: Column) -> Column:
    return F.lit(1.0) + F.least(count - 1, F.lit(4)) * 0.5


def finding_weight() -> Column:
    """What one scored finding adds."""
    return F.col("strength") * repetition_weight(F.col("count")) * pick(F.col("lifecycle"), V.LIFECYCLE_WEIGHT, F.lit(1.0))


def density_score(weighted: Column, words: Column) -> Column:
    density = weighted / ((words + V.SMOOTHING_WORDS) / 1000)
    return F.when(weighted > 0, X.nearest(100 * density / (density + V.DENSITY_MIDPOINT))).otherwise(F.lit(0)).cast("int")


def tier_of(score: Column) -> Column:
    a, b, c = V.TIER_BOUNDS
    return F.when(score < a, F.lit("green")).when(score < b, F.lit("yellow")).when(score < c, F.lit("orange")).otherwise(F.lit("red"))


def tier_rank(tier: Column) -> Column:
    return F.array_position(F.array(*[F.lit(t) for t in V.TIERS]), tier) - 1


def capped_tier(tier: Column, strong: Column, hard_evidence: Column) -> Column:
    """Two strong signals hold the tier at yellow, unless hard evidence was found."""
    return F.when((strong >= 2) & ~hard_evidence & (tier_rank(tier) > 1), F.lit("yellow")).otherwise(tier)


def _sums(found: DataFrame, id_col: str) -> DataFrame:
    return found.filter("scored").groupBy(id_col).agg(F.sum(finding_weight()).alias("weighted_sum"), F.max(F.col("lifecycle") == "hard_evidence").alias("hard_evidence"))


def lexical_scores(docs: DataFrame, lexicon: L.Lexicon, id_col: str = "doc_id", text_col: str = "text", register_col: str | None = None) -> DataFrame:
    """id, word_count, weighted_sum, score, tier from entries alone; every document has a row."""
    sums = _sums(L.findings(docs, lexicon, id_col, text_col, register_col), id_col)
    words = docs.select(F.col(id_col), X.ws_word_count(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("word_count"))
    d = words.join(sums, id_col, "left").na.fill({"weighted_sum": 0.0, "hard_evidence": False})
    return d.withColumn("score", density_score(F.col("weighted_sum"), F.col("word_count"))).withColumn("tier", tier_of(F.col("score")))


def audit(
    docs: DataFrame, lexicon: L.Lexicon, id_col: str = "doc_id", text_col: str = "text", register_col: str = "register", facts: DataFrame | None = None, paragraph: str = r"\n\s*\n"
) -> tuple[DataFrame, DataFrame]:
    """(results, findings). ``docs`` needs id, text and register (null: none); ``facts``: id, fact.

    results: id, score, tier, word_count, strengths, summary, one row per document; code is blanked first and an
    empty document is green. findings: entries, rhythm and unused facts, scored or not.
    """
    clean = docs.withColumn(text_col, X.strip_code(F.coalesce(F.col(text_col), F.lit(""))))
    entry_rows = L.findings(clean, lexicon, id_col, text_col, register_col)
    sums = _sums(entry_rows, id_col)
    # what depends on the row alone is computed in one pass over the texts, and joined once with the sums
    row = rhythm.rhythm_flags(rhythm.strengths(clean.select(id_col, text_col, register_col), text_col, paragraph, keep_metrics=True), text_col, register_col, paragraph)
    # sentences and paragraphs break at white space only, so their words add up to the text's
    row = row.withColumn("word_count", F.col("total_words")).withColumn("beats", sum((F.col(c).cast("int") for c in rhythm.FLAGS), F.lit(0)))
    row = row.select(id_col, register_col, "word_count", "beats", "specificity", "concrete_abstract", "burstiness", "strong_signals", "notes")
    d = row.join(sums, id_col, "left").na.fill({"weighted_sum": 0.0, "hard_evidence": False})
    d = d.withColumn("score", density_score(F.col("weighted_sum"), F.col("word_count")))
    beat = rhythm.rhythm_findings(clean, id_col, text_col, register_col, paragraph)
    weight = pick(F.col(register_col), V.RHYTHM_WEIGHT, F.lit(V.DEFAULT_RHYTHM_WEIGHT))
    unused = None
    if facts is not None:
        usage = facts_ops.fact_usage(clean, facts, id_col, text_col, paragraph)
        unused = usage.filter("NOT meets_quota")
        d = d.join(unused.select(id_col, F.lit(V.ELICITED_BONUS).alias("bonus")), id_col, "left").na.fill({"bonus": 0})
    else:
        d = d.withColumn("bonus", F.lit(0))
    some = F.col("word_count") > 0
    score = F.when(some, F.least(F.lit(100), F.col("score") + F.col("beats") * weight + F.col("bonus"))).otherwise(F.lit(0)).cast("int")
    d = d.withColumn("score", score)
    d = d.withColumn("tier", capped_tier(tier_of(F.col("score")), F.col("strong_signals"), F.col("hard_evidence")))
    zero = lambda c: F.when(some, F.col(c)).otherwise(F.lit(0.0)).alias(c)
    reliable = F.when((F.col("word_count") > 0) & (F.col("word_count") < V.RELIABLE_WORDS), F.array(
        F.format_string(V.LITTLE_TEXT, F.col("word_count"), F.when(F.col("word_count") == 1, F.lit("")).otherwise(F.lit("s")))
    )).otherwise(F.col("notes"))
    results = d.select(
        id_col, F.coalesce(F.col(register_col), F.lit("general")).alias("register"), "score", "tier", "word_count", zero("specificity"), zero("concrete_abstract"), zero("burstiness"),
        F.when(some, reliable).otherwise(F.array().cast("array<string>")).alias("notes"),
        F.when(some, pick(F.col("tier"), V.TIER_SUMMARY, F.lit(""))).otherwise(F.lit("Empty input.")).alias("summary"),
    )
    cols = [id_col, "ord", "term", "category", "subcategory", "confidence", "severity", "count", "scored", "hint", "note"]
    whole = beat.select(
        id_col, F.lit(100_000).alias("ord"), F.col("name").alias("term"), F.lit("Whole-piece rhythm").alias("category"), F.col("finding_id").alias("subcategory"), "confidence", "severity",
        F.lit(1).cast("long").alias("count"), F.lit(True).alias("scored"), F.lit(None).cast("string").alias("hint"), "note",
    )
    found = entry_rows.select(cols).unionByName(whole)
    if unused is not None:
        found = found.unionByName(
            unused.select(
                id_col, F.lit(200_000).alias("ord"), F.lit("Elicited material unused").alias("term"), F.lit("Elicited material").alias("category"), F.lit("elicited-material-unused").alias("subcategory"),
                F.lit("orange").alias("confidence"), F.lit("medium").alias("severity"), F.lit(1).cast("long").alias("count"), F.lit(True).alias("scored"), F.lit(None).cast("string").alias("hint"), "note",
            )
        )
    return results, found


def category_breakdown(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, category, total over all findings, scored or not."""
    return found.groupBy(id_col, "category").agg(F.sum("count").alias("total"))
