"""How well a score separates two classes, and whether it got worse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import fixed as V


#: Ranges of scores that are summed and ranked apart, in each group.
RANGES = 64


def auc(scored: DataFrame, group: str, label: str, score: str = "score") -> DataFrame:
    """group, positives, negatives, auc by rank sums, ties at their mean rank; null where a class is missing.

    Equal scores are counted before anything is ranked, and scores are ranked within ranges between quantiles, so no
    task sees all scores of a group.
    """
    by = scored.groupBy(group, score).agg(F.sum(F.when(F.col(label) == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col(label) == 0, 1).otherwise(0)).alias("neg"))
    cuts = by.groupBy(F.col(group).alias("_group")).agg(F.percentile_approx(score, [k / RANGES for k in range(1, RANGES)], 10_000).alias("_cuts"))
    d = by.join(cuts, F.col(group).eqNullSafe(F.col("_group")))
    d = d.withColumn("_range", F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col(score))), F.lit(0))).drop("_cuts", "_group")
    sums = d.groupBy(F.col(group).alias("_group"), F.col("_range").alias("_at")).agg(F.sum("neg").alias("_neg"))
    before = F.coalesce(F.sum("_neg").over(W.partitionBy("_group").orderBy("_at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = sums.select("_group", "_at", before.alias("_base"))  # RANGES rows a group
    d = d.join(base, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_at")))
    below = F.col("_base") + F.coalesce(F.sum("neg").over(W.partitionBy(group, "_range").orderBy(score).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    u = d.withColumn("wins2", F.col("pos") * (2 * below + F.col("neg")))
    g = u.groupBy(group).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.sum("wins2").alias("wins2"))
    pairs = F.col("positives") * F.col("negatives")
    return g.select(group, "positives", "negatives", F.when(pairs > 0, F.col("wins2") / (2.0 * pairs)).alias("auc"))


def compare(measured: DataFrame, baseline: DataFrame, group: str, epsilon: float = V.AUC_EPSILON) -> DataFrame:
    """group, auc, stored, status: REGRESSION, improved or unchanged."""
    j = measured.select(group, "auc").join(baseline.select(group, F.col("auc").alias("stored")), group)
    d = F.col("auc") - F.col("stored")
    return j.withColumn("status", F.when(d < -epsilon, F.lit("REGRESSION")).when(d > epsilon, F.lit("improved")).otherwise(F.lit("unchanged")))
