"""The audit over a stream: scoring is per document, voice profiles grow by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import audit as A
from ..operators import lexicon as L
from ..operators import voices as VO


def stream_scores(docs: DataFrame, lexicon: L.Lexicon, text_col: str = "text") -> DataFrame:
    """``docs``, a stream or not, with word_count, weighted_sum, score and tier; no state and no shuffle.

    Every entry is counted by its own expression, so the plan fits append mode.
    """
    entries = lexicon.resolved()
    t = F.coalesce(F.col(text_col), F.lit(""))
    weighted = F.lit(0.0)
    for e in entries:
        found = X.spans(t, X.rx(lexicon.pattern(e))) if e.may_be_name else None
        if found is None:
            count = F.regexp_count(t, X.rx(lexicon.pattern(e)))
        else:
            count = F.size(F.filter(found, lambda m: ~(F.substring(t, m["start"] + 1, F.lit(1)).rlike("[A-Z]") & ~X.sentence_start(t, m["start"]))))
        scored = count >= (1 if e.confidence == "red" else A.V.OVERUSE)
        weighted = weighted + F.when(scored, F.lit(float(e.strength)) * A.repetition_weight(count) * A.V.LIFECYCLE_WEIGHT[e.lifecycle]).otherwise(F.lit(0.0))
    d = docs.withColumn("word_count", X.ws_word_count(t).cast("long")).withColumn("weighted_sum", weighted)
    return d.withColumn("score", A.density_score(F.col("weighted_sum"), F.col("word_count"))).withColumn("tier", A.tier_of(F.col("score")))


def grow_voices(samples: DataFrame, path: str, checkpoint: str):
    """Start a query that merges each batch of (voice, doc_id, text) into the voices written below ``path``.

    Each batch writes a new folder from the one before it; a batch that is repeated writes the same folder again.
    """

    def merge(batch: DataFrame, n: int) -> None:
        before = batch.sparkSession.read.parquet(f"{path}/{n - 1}") if n else None
        VO.train_voices(batch, existing=before).write.mode("overwrite").parquet(f"{path}/{n}")

    return samples.writeStream.option("checkpointLocation", checkpoint).foreachBatch(merge).start()

