"""Whole-piece rhythm: metrics, detectors against register baselines, and strength signals. Per row, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import text as X
from .stats import text_stats


def metrics(docs: DataFrame, text_col: str = "text", paragraph: str = r"\n\s*\n") -> DataFrame:
    """``docs`` with paragraph_count, sentence_count, total_words, paragraph_cv, sentence_cv, avg_sentence_words and the lengths."""
    d = docs.withColumn("_pars", X.paragraphs(F.coalesce(F.col(text_col), F.lit("")), paragraph))
    d = d.withColumn("_ps", F.transform("_pars", X.sentences_boundary))
    d = d.withColumn("paragraph_lengths", F.transform("_ps", F.size)).withColumn("sentence_lengths", F.transform(F.flatten("_ps"), X.even_word_count))
    d = d.withColumn("_p", X.moments(F.col("paragraph_lengths"))).withColumn("_s", X.moments(F.col("sentence_lengths")))
    p, s = F.col("_p"), F.col("_s")
    return d.select(
        *docs.columns, p["n"].alias("paragraph_count"), s["n"].alias("piece_sentences"), s["s"].alias("total_words"),
        X.variation(p["n"], p["s"], p["s2"]).alias("paragraph_cv"), X.variation(s["n"], s["s"], s["s2"]).alias("sentence_cv"),
        F.when(s["n"] > 0, s["s"] / s["n"]).otherwise(F.lit(0.0)).alias("avg_sentence_words"), "paragraph_lengths", "sentence_lengths", F.col("_ps").alias("paragraph_sentences"), F.col("_pars").alias("paragraphs"),
    )


def baseline(register: Column, which: int, part: int) -> Column:
    """A register's mean (part 0) or deviation (1); null where it has none."""
    out = F.lit(None).cast("double")
    for name, rows in V.BASELINES.items():
        out = F.when(register == name, F.lit(rows[which][part])).otherwise(out)
    return out


def _threshold(register: Column, which: int) -> Column:
    return F.coalesce(baseline(register, which, 0) - V.DRIFT_Z * baseline(register, which, 1), F.lit(V.GENERIC_CV))


def z_score(value: Column, register: Column, which: int) -> Column:
    return (value - baseline(register, which, 0)) / baseline(register, which, 1)


def rhythm_flags(docs: DataFrame, text_col: str = "text", register_col: str = "register", paragraph: str = r"\n\s*\n") -> DataFrame:
    """``docs`` with the metrics, fragment_z, entropy_z, ordinal_paragraphs and one boolean per detector."""
    reg = F.col(register_col)
    stats = text_stats(docs, text_col, paragraph)
    d = stats.select(*docs.columns, "fragment_rate", "structural_entropy")
    if "paragraph_sentences" not in docs.columns:
        d = metrics(d, text_col, paragraph)
    base = baseline(reg, 0, 0).isNotNull()
    d = d.withColumn("fragment_z", z_score(F.col("fragment_rate"), reg, 2)).withColumn("entropy_z", z_score(F.col("structural_entropy"), reg, 3))
    announced = F.exists(
        "paragraph_sentences",
        lambda p: (F.size(p) == 1) & (X.even_word_count(F.get(p, F.lit(0))) <= V.ENUMERATION_WORDS) & F.get(p, F.lit(0)).rlike(X.java(V.ENUMERATION)) & F.get(p, F.lit(0)).rlike(X.java(V.SELF_REFERENCE)),
    )
    scaffold = F.zip_with("paragraphs", "paragraph_sentences", lambda p, s: p.rlike(X.java(V.ORDINAL_OPENER)) | F.coalesce(F.get(s, F.lit(0)).rlike(X.java(V.LABEL_FRAGMENT)), F.lit(False)))
    d = d.withColumn("ordinal_paragraphs", F.size(F.filter(scaffold, lambda x: x)))
    long = F.col("total_words") >= V.STRUCTURE_WORDS
    return d.select(
        *[c for c in docs.columns if c not in METRICS], "paragraph_count", "piece_sentences", "total_words", "paragraph_cv", "sentence_cv", "avg_sentence_words", "fragment_z", "entropy_z", "ordinal_paragraphs",
        ((F.col("paragraph_count") >= 4) & (F.col("paragraph_cv") < _threshold(reg, 1))).alias("uniform_paragraphs"),
        ((F.col("piece_sentences") >= 8) & (F.col("sentence_cv") < _threshold(reg, 0))).alias("low_burstiness"),
        F.coalesce(base & (F.col("piece_sentences") >= 8) & ((F.col("fragment_z") <= -V.DRIFT_Z) | (F.col("entropy_z") >= V.DRIFT_Z)), F.lit(False)).alias("register_drift"),
        (long & announced).alias("announced_enumeration"),
        (long & ~F.coalesce(reg.isin(*V.ORDINAL_SUPPRESSED), F.lit(False)) & (F.col("ordinal_paragraphs") >= V.SCAFFOLD_PARAGRAPHS)).alias("ordinal_scaffold"),
    )


#: What ``metrics`` adds.
METRICS = ("paragraph_count", "piece_sentences", "total_words", "paragraph_cv", "sentence_cv", "avg_sentence_words", "paragraph_lengths", "sentence_lengths", "paragraph_sentences", "paragraphs")
FLAGS = ("uniform_paragraphs", "low_burstiness", "register_drift", "announced_enumeration", "ordinal_scaffold")
def rhythm_details(register_col: str = "register") -> dict[str, Column]:
    """The sentence that explains each finding."""
    values = {
        "uniform_paragraphs": ("paragraph_count",), "low_burstiness": ("piece_sentences", X.nearest(F.col("avg_sentence_words"))), "register_drift": (register_col,), "announced_enumeration": (), "ordinal_scaffold": ("ordinal_paragraphs",),
    }
    return {k: X.filled(V.RHYTHM_DETAILS[k], *v) for k, v in values.items()}


def rhythm_findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", register_col: str = "register", paragraph: str = r"\n\s*\n") -> DataFrame:
    """id, finding_id, name, confidence, severity, note: one row per finding."""
    flags, notes = rhythm_flags(docs, text_col, register_col, paragraph), rhythm_details(register_col)
    rows = [
        F.when(F.col(k), F.struct(F.lit(i).alias("finding_id"), F.lit(n).alias("name"), F.lit(c).alias("confidence"), F.lit(s).alias("severity"), notes[k].alias("note"))) for k, (i, n, c, s) in V.RHYTHM_FINDINGS.items()
    ]
    return flags.select(id_col, F.explode(F.array_compact(F.array(*rows))).alias("f")).select(id_col, "f.*")


#: Characters that are no part of a word or a line, as far as a table of them is worth it.
DROPPED = "".join(c for c in map(chr, [*range(128), *range(0xA0, 0x180), *range(0x2010, 0x2027), 0x20AC]) if c not in "'\n -" and not (c.isascii() and c.isalpha()))


def strengths(docs: DataFrame, text_col: str = "text", paragraph: str = r"\n\s*\n", keep_metrics: bool = False) -> DataFrame:
    """``docs`` with specificity, concrete_abstract, burstiness, strong_signals and notes, and the metrics if asked for.

    Words are runs between spaces without all but letters, apostrophes and hyphens, read off one string that has a
    sentence a line: a name is a capital after a space, an abstract noun a word's end after three letters or more.
    """
    d = metrics(docs, text_col, paragraph)
    t = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.concat(F.array_join(F.flatten("paragraph_sentences"), "\n"), F.lit("\n"))
    # marks, digits and common letters beyond ASCII go by a table; only texts with others need the pattern
    d = d.withColumn("_c", F.translate(lines, DROPPED, ""))
    d = d.withColumn("_c", F.when(F.octet_length("_c") == F.length("_c"), F.col("_c")).otherwise(F.regexp_replace("_c", r"[^A-Za-z'\n -]+", "")))
    names = F.regexp_count(F.col("_c"), F.lit(" [A-Z]"))
    ends = "(?:" + "|".join(V.ABSTRACT_SUFFIXES) + ")"
    abstract = F.regexp_count(F.lower("_c"), F.lit(rf"[ \n](?<=[a-z'-]{{3}}{ends}[ \n])"))
    d = d.withColumn("_hits", names + F.regexp_count(t, X.rx(V.NUMERAL))).withColumn("_abs", abstract)
    d = d.withColumn("specificity", X.fixed(F.col("_hits") / X.alnum_count(t) * 1000, 1)).withColumn("concrete_abstract", X.fixed(F.col("_hits") / F.greatest(F.lit(1), F.col("_abs")), 2))
    strong = [F.col("specificity") >= V.STRONG_SPECIFICITY, F.col("concrete_abstract") >= V.STRONG_RATIO, F.col("sentence_cv") >= V.STRONG_BURSTINESS]
    notes = F.array_compact(F.array(*[F.when(s, F.lit(x)) for s, x in zip(strong, V.STRENGTH_NOTES, strict=True)]))
    more = METRICS if keep_metrics else ()
    return d.select(*docs.columns, *more, "specificity", "concrete_abstract", F.col("sentence_cv").alias("burstiness"), sum(s.cast("int") for s in strong).alias("strong_signals"), notes.alias("notes"))
