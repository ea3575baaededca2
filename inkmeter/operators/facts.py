"""Elicited material: whether a draft uses the facts it was given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import text as X

def evidentiary(sentence: Column) -> Column:
    """A number, sum or percentage, a name within the sentence, or an achievement verb."""
    clean = F.transform(X.ws_words(sentence), lambda w: F.regexp_replace(w, "[^A-Za-z'-]", ""))
    named = F.exists(F.transform(clean, lambda w, i: (i > 0) & w.rlike(r"^[A-Z][A-Za-z'-]*\z")), lambda x: x)
    return sentence.rlike("[0-9$£€%]") | named | F.exists(clean, lambda w: F.lower(w).isin(*V.ACHIEVEMENT_VERBS))


def fact_usage(docs: DataFrame, facts: DataFrame, id_col: str = "doc_id", text_col: str = "text", paragraph: str = r"\n\s*\n") -> DataFrame:
    """id, total_facts, used_facts, plain_use, meets_quota, note for documents that have facts (id, fact).

    A fact is used if half of its content words, repeats counted, stand in the draft as whole words.
    """
    given = facts.select(F.col(id_col), X.trim(F.col("fact")).alias("fact")).filter(F.col("fact") != "").withColumn("words", X.content_words(F.col("fact")))
    sents = F.flatten(F.transform(X.paragraphs(F.coalesce(F.col(text_col), F.lit("")), paragraph), X.sentences_boundary))
    d = docs.select(F.col(id_col), F.lower(F.coalesce(F.col(text_col), F.lit(""))).alias("low"), F.filter(sents, lambda s: ~evidentiary(s)).alias("plain"))
    j = given.join(d, id_col)
    # a content word has letters and apostrophes only, so it is its own pattern
    bound = lambda w: F.concat(F.lit(X.BOUNDARY), w, F.lit(X.BOUNDARY))
    within = lambda text, w: F.rlike(text, bound(w))
    hits = F.size(F.filter("words", lambda w: within(F.col("low"), w)))
    used = (F.size("words") > 0) & (hits / F.size("words") >= V.USED_SHARE)
    plain = F.exists("plain", lambda s: F.exists(F.col("words"), lambda w: within(F.lower(s), w)))
    g = j.withColumn("used", used).withColumn("plain_use", F.col("used") & plain).groupBy(id_col).agg(
        F.count(F.lit(1)).alias("total_facts"), F.sum(F.col("used").cast("int")).alias("used_facts"), F.max("plain_use").alias("plain_use")
    )
    g = g.withColumn("meets_quota", (F.col("used_facts") >= V.USED_FACTS) & F.col("plain_use"))
    only = F.when((F.col("used_facts") > 0) & ~F.col("plain_use"), F.lit(V.ONLY_PROVING)).otherwise(F.lit(""))
    note = X.filled(V.FACTS_NOTE, "used_facts", "total_facts", only)
    return g.withColumn("note", note)
