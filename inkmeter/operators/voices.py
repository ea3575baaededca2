"""Voices: dials, training from samples, matching a draft, repetition of a voice's own habits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import fixed as V
from ..functions import text as X
from . import stats as S


def _clamp(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), x))


def dial(value: Column, name: str) -> Column:
    """A statistic on its dial, 0 to 100; missing: the neutral setting."""
    _, lo, hi, neutral = V.DIALS[name]
    set_at = X.nearest(_clamp((value - lo) / F.lit(hi - lo), 0, 1) * 100).cast("int")
    return F.when(value.isNull() | F.isnan(value), F.lit(neutral)).otherwise(set_at)


def stats_to_dials(stats: DataFrame) -> list[Column]:
    return [dial(F.col(c), name).alias(name) for name, (c, _, _, _) in V.DIALS.items()]


def dials_to_stats() -> list[Column]:
    """The statistic that each dial column stands for."""
    return [X.fixed(F.lit(lo) + _clamp(F.col(name).cast("double"), 0, 100) / 100 * F.lit(hi - lo), 3).alias(c) for name, (c, lo, hi, _) in V.DIALS.items()]


def persona_dials() -> list[Column]:
    """formality, warmth, directness from measured statistics, 0 to 10."""
    ten = lambda x: X.nearest(_clamp(x, 0, 10)).cast("int")
    contractions = _clamp(10 - F.col("contraction_rate") * 4, 0, 10)
    letters = _clamp((F.col("avg_word_length") - 4) * 5, 0, 10)
    sentences = _clamp(10 - (F.col("avg_sentence_length") - 8) / 22 * 10, 0, 10)
    fragments = _clamp(F.col("fragment_rate") / 0.15 * 10, 0, 10)
    return [ten((contractions + letters) / 2).alias("formality"), ten(F.col("relational_pronoun_rate") / 40 * 10).alias("warmth"), ten(sentences * 0.7 + fragments * 0.3).alias("directness")]


def persona_guide() -> Column:
    line = lambda c, low, mid, high: F.when(F.col(c) <= 3, F.lit(low)).when(F.col(c) <= 6, F.lit(mid)).otherwise(F.lit(high))
    return F.concat_ws(" ", *[line(c, *texts) for c, texts in V.PERSONA_LINES.items()])


def entropy_guide(value: Column, low: float, high: float, neutral: float) -> Column:
    v = F.when(value.isNull() | F.isnan(value), F.lit(float(neutral))).otherwise(value.cast("double"))
    return F.when(v < low, F.lit(V.ENTROPY_LINES[0])).when(v < high, F.lit(V.ENTROPY_LINES[1])).otherwise(F.lit(V.ENTROPY_LINES[2]))


def dial_entropy_guide(value: Column) -> Column:
    return entropy_guide(_clamp(value.cast("double"), 0, 100), 30, 65, 40)


def stats_guide(samples: Column, bigrams: Column | None = None, words: Column | None = None) -> Column:
    """A voice's statistics as drafting advice."""
    t = {k: F.lit(v) for k, v in V.STATS_LINES.items()}
    c = F.col
    lines = [
        F.when(c("avg_sentence_length") >= 20, t["long"]).when(c("avg_sentence_length") <= 12, t["short"]).otherwise(t["middle"]),
        F.when(c("sentence_length_sd") >= 8, t["varied"]).otherwise(t["steady"]),
        F.when(c("paragraph_length_cv") >= 0.5, t["uneven"]).otherwise(t["even"]),
        F.when(c("contraction_rate") >= 1.5, t["contractions"]).when(c("contraction_rate") <= 0.3, t["no contractions"]).otherwise(t["some contractions"]),
        F.when(c("em_dash_per_1000") >= 3, t["dashes"]).otherwise(t["no dashes"]),
        F.when(c("fragment_rate") >= 0.08, t["fragments"]),
        F.when(c("question_rate") >= 0.05, t["questions"]),
    ]
    five = lambda a: F.array_join(F.slice(a, 1, 5), ", ")
    if bigrams is not None:
        lines.append(F.when(F.size(bigrams) > 0, F.concat(F.lit("Recurring phrasing across samples: "), five(bigrams), F.lit("."))))
    if words is not None:
        lines.append(F.when((F.size(words) > 0) & (samples >= 3), F.concat(F.lit("Distinctive word choices, reached for more than a generic baseline would predict: "), five(words), F.lit("."))))
    lines.append(entropy_guide(c("structural_entropy"), 0.33, 0.54, 0.39))
    return F.concat_ws(" ", *lines)


def train_voices(samples: DataFrame, voice_col: str = "voice", id_col: str = "doc_id", text_col: str = "text", existing: DataFrame | None = None) -> DataFrame:
    """One row per voice: merged statistics, sample_count, persona dials inferred where there are none.

    ``existing``: earlier voices with the same columns; each enters the merge as one unit of its word count and
    keeps its persona.
    """
    measured = S.text_stats(samples.select(voice_col, text_col), text_col).drop(text_col).withColumn("units", F.lit(1).cast("long"))
    persona = None
    if existing is not None:
        cols = [voice_col, "word_count", "sentence_count", *S.NUMERIC]
        measured = measured.select(*cols, "units").unionByName(existing.select(*cols, F.col("sample_count").alias("units")))
        persona = existing.select(voice_col, *[F.col(c).alias(f"_{c}") for c in V.PERSONA_LINES])
    merged = S.merge_stats(measured, voice_col).drop("sample_count").join(measured.groupBy(voice_col).agg(F.sum("units").alias("sample_count")), voice_col)
    out = merged.select("*", *persona_dials())
    if persona is not None:
        out = out.join(persona, voice_col, "left")
        for c in V.PERSONA_LINES:
            out = out.withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    return out


#: Voices whose cuts may be broadcast; beyond it the join is left to the planner.
BROADCAST_VOICES = 200_000


def fingerprints(samples: DataFrame, voice_col: str = "voice", id_col: str = "doc_id", text_col: str = "text", cap: int = V.HISTORY_CAP) -> DataFrame:
    """voice, id, opener, top_bigrams, nth of each voice's latest ``cap`` samples, nth 1 the latest by id."""
    latest = F.row_number().over(W.partitionBy(voice_col).orderBy(F.col(id_col).desc()))
    # each voice's oldest id to keep is found without texts; null: all of its samples can be among the latest
    kept = samples.select(F.col(voice_col).alias("_voice"), F.col(id_col).alias("_id"))
    kept = kept.withColumn("nth", F.row_number().over(W.partitionBy("_voice").orderBy(F.col("_id").desc()))).filter(F.col("nth") <= cap)
    cuts = kept.groupBy("_voice").agg(F.when(F.count("_id") >= cap, F.min("_id")).alias("_cut"))
    if samples.select(voice_col).distinct().limit(BROADCAST_VOICES + 1).count() <= BROADCAST_VOICES:
        cuts = F.broadcast(cuts)
    recent = samples.join(cuts, F.col(voice_col).eqNullSafe(F.col("_voice")) & (F.col("_cut").isNull() | (F.col(id_col) >= F.col("_cut")))).select(*samples.columns)
    last = recent.withColumn("nth", latest).filter(F.col("nth") <= cap)
    pairs = S.as_list(S.top_bigrams(last, id_col, text_col), id_col, "top_bigrams")
    d = last.select(voice_col, id_col, "nth", X.opener(F.coalesce(F.col(text_col), F.lit(""))).alias("opener")).join(pairs, id_col, "left")
    return d.withColumn("top_bigrams", F.coalesce("top_bigrams", F.array().cast("array<string>")))


def dial_deltas(drafts: DataFrame, voices: DataFrame, voice_col: str = "voice", id_col: str = "draft_id", text_col: str = "text") -> DataFrame:
    """id, voice, dial, target, actual, delta: ``drafts`` name the voice they are held against."""
    a = S.text_stats(drafts.select(id_col, voice_col, text_col), text_col).select(id_col, voice_col, "word_count", F.struct(*stats_to_dials(drafts)).alias("actual"))
    t = voices.select(voice_col, F.struct(*stats_to_dials(voices)).alias("target"))
    each = F.array(*[F.struct(F.lit(k).alias("dial"), F.col(f"target.{k}").alias("target"), F.col(f"actual.{k}").alias("actual"), F.lit(n).alias("nth")) for n, k in enumerate(V.DIALS)])
    j = a.join(t, voice_col).select(id_col, voice_col, "word_count", F.explode(each).alias("x")).select(id_col, voice_col, "word_count", "x.*")
    return j.withColumn("delta", F.abs(F.col("actual") - F.col("target")))


def drift_findings(deltas: DataFrame) -> DataFrame:
    """The dials that are off, with what to say of each."""
    note = F.lit(None).cast("string")
    for k, (high, low) in V.DIAL_NOTES.items():
        note = F.when(F.col("dial") == k, F.when(F.col("actual") > F.col("target"), F.lit(high)).otherwise(F.lit(low))).otherwise(note)
    return deltas.filter(F.col("delta") >= V.DRIFT_DELTA).withColumn("note", note)


def voice_match(deltas: DataFrame, voice_col: str = "voice", id_col: str = "draft_id") -> DataFrame:
    """id, voice, match_score, verdict, confidence, off_dials."""
    g = deltas.groupBy(id_col, voice_col).agg(
        F.avg("delta").alias("avg_delta"), F.max("delta").alias("max_delta"), F.first("word_count").alias("words"), F.sum((F.col("delta") >= V.DRIFT_DELTA).cast("int")).alias("off_dials")
    )
    a, m = F.col("avg_delta"), F.col("max_delta")
    verdict = F.when((a >= V.OFF_AVERAGE) | (m >= V.OFF_DELTA), F.lit("off rhythm")).when((a >= V.SOME_AVERAGE) | (m >= V.DRIFT_DELTA), F.lit("some drift")).otherwise(F.lit("on rhythm"))
    return g.select(
        id_col, voice_col, F.greatest(F.lit(0), X.nearest(100 - a)).cast("int").alias("match_score"), verdict.alias("verdict"), F.when(F.col("words") < V.CONFIDENT_WORDS, F.lit("low")).otherwise(F.lit("normal")).alias("confidence"), F.col("off_dials").cast("long").alias("off_dials")
    )


def self_repetition(drafts: DataFrame, history: DataFrame, voice_col: str = "voice", id_col: str = "draft_id", text_col: str = "text") -> DataFrame:
    """id, voice, kind, term, matches, total: openers and phrases of a draft that its voice's history shares."""
    sizes = history.groupBy(voice_col).agg(F.count(F.lit(1)).alias("total")).filter(F.col("total") >= V.HISTORY_MIN)
    d = drafts.select(id_col, voice_col, X.opener(F.coalesce(F.col(text_col), F.lit(""))).alias("opener"))
    openers = d.filter("opener <> ''").join(history.groupBy(voice_col, "opener").agg(F.count(F.lit(1)).alias("matches")), [voice_col, "opener"])
    openers = openers.select(id_col, voice_col, F.lit("opener").alias("kind"), F.col("opener").alias("term"), "matches")
    own = S.top_bigrams(drafts.select(id_col, text_col), id_col, text_col).select(id_col, "token").join(d.select(id_col, voice_col), id_col)
    past = history.select(voice_col, F.explode("top_bigrams").alias("token")).groupBy(voice_col, "token").agg(F.count(F.lit(1)).alias("matches"))
    phrases = own.join(past, [voice_col, "token"]).select(id_col, voice_col, F.lit("phrase").alias("kind"), F.col("token").alias("term"), "matches")
    both = openers.unionByName(phrases).join(sizes, voice_col)
    share = F.when(F.col("kind") == "opener", F.lit(V.OPENER_SHARE)).otherwise(F.lit(V.PHRASE_SHARE))
    return both.filter(F.col("matches") / F.col("total") >= share).select(id_col, voice_col, "kind", "term", "matches", "total")
