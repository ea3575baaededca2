"""Text statistics, characteristic words and bigrams, and their merging over samples."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import fixed as V
from ..functions import text as X

#: statistic: decimals
NUMERIC = {
    "avg_sentence_length": 2, "sentence_length_sd": 2, "avg_paragraph_sentences": 2, "paragraph_length_cv": 3, "contraction_rate": 3, "em_dash_per_1000": 2, "semicolon_per_1000": 2,
    "question_rate": 3, "avg_word_length": 2, "fragment_rate": 3, "structural_entropy": 3, "relational_pronoun_rate": 2,
}


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def sentence_openers(sentences: Column) -> Column:
    """The first word of each sentence that has one, in lower case."""
    return F.array_remove(F.transform(sentences, lambda s: F.lower(F.regexp_extract(s, V.WORD, 0))), "")


def diversity(openers: Column) -> Column:
    """Different openers by all; 0 for fewer than two."""
    return F.when(F.size(openers) < 2, F.lit(0.0)).otherwise(F.size(F.array_distinct(openers)) / F.size(openers))


def variety(text: Column) -> Column:
    """The share of the marks that a text has at all."""
    return sum((F.contains(text, F.lit(m)).cast("int") for m in V.VARIETY_MARKS), F.lit(0)) / F.lit(len(V.VARIETY_MARKS))


def text_stats(docs: DataFrame, text_col: str = "text", paragraph: str = r"\n\s*\n") -> DataFrame:
    """``docs`` with word_count, sentence_count and the numeric statistics; per row, without a shuffle.

    Null text is empty. word_count is 1 at least.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.withColumn("_t", t).withColumn("_w", X.alpha_words(F.col("_t"))).withColumn("_s", X.sentences_scan(F.col("_t")))
    d = d.withColumn("_l", F.transform("_s", lambda s: F.regexp_count(s, F.lit(V.WORD))))
    d = d.withColumn("_p", F.transform(X.paragraphs(F.col("_t"), paragraph), lambda p: F.greatest(F.lit(1), X.sentence_count(p))))
    d = d.withColumn("_o", sentence_openers(F.col("_s")))
    d = d.withColumn("_lm", X.moments(F.col("_l"))).withColumn("_pm", X.moments(F.col("_p")))
    d = d.withColumn("_n", F.greatest(F.lit(1), F.size("_w")))
    lengths, pars = F.col("_lm"), F.col("_pm")
    per = lambda count, scale: count / F.col("_n") * scale
    apostrophe = F.contains(F.col("_t"), F.lit("'")) | F.contains(F.col("_t"), F.lit("’"))
    contractions = F.when(apostrophe, F.regexp_count(F.col("_t"), X.rx(V.CONTRACTION))).otherwise(F.lit(0))
    sentences = F.size("_s")
    values = {
        "avg_sentence_length": _share(lengths["s"], lengths["n"]),
        "sentence_length_sd": X.deviation(lengths["n"], lengths["s"], lengths["s2"]),
        "avg_paragraph_sentences": _share(pars["s"], pars["n"]),
        "paragraph_length_cv": F.when(pars["s"] > 0, X.deviation(pars["n"], pars["s"], pars["s2"]) / (pars["s"] / pars["n"])).otherwise(F.lit(0.0)),
        "contraction_rate": per(contractions, 100),
        "em_dash_per_1000": per(X.occurrences(F.col("_t"), "—"), 1000),
        "semicolon_per_1000": per(X.occurrences(F.col("_t"), ";"), 1000),
        "question_rate": _share(F.size(F.filter("_s", lambda s: s.endswith("?"))), sentences),
        "avg_word_length": F.length(F.array_join("_w", "")) / F.col("_n"),
        "fragment_rate": _share(F.size(F.filter("_l", lambda k: (k > 0) & (k <= 3))), sentences),
        "structural_entropy": (diversity(F.col("_o")) + variety(F.col("_t"))) / 2,
        "relational_pronoun_rate": per(F.regexp_count(F.col("_t"), X.rx(V.RELATIONAL)), 1000),
    }
    return d.select(*docs.columns, F.col("_n").cast("long").alias("word_count"), sentences.cast("long").alias("sentence_count"), *[X.fixed(v, NUMERIC[k]).alias(k) for k, v in values.items()])


def _inner_words(text: Column) -> Column:
    """The words that don't open a sentence."""
    return F.flatten(F.transform(X.sentences_scan(text), lambda s: F.slice(X.alpha_words(s), 2, 1 << 30)))


def _counted(docs: DataFrame, keys: Column, *by: str, more: dict | None = None, least: int = 1) -> DataFrame:
    """``docs`` with runs, an array of structs ``by``, first and count: groups of equal keys, counted within the row.

    keys: an array of structs of ``by`` and pos, or without ``by`` of texts, which are called key then. It is sorted,
    so a text of n words takes n log n steps and no row leaves its task. more: further fields, each from the array of a
    group's keys. Groups of fewer than ``least`` keys are left out.
    """
    d = docs.withColumn("_k", F.sort_array(keys))
    k, at = F.col("_k"), F.col("_at")
    differs = lambda x, y: functools.reduce(lambda a, b: a | b, [x[c] != y[c] for c in by]) if by else x != y
    d = d.withColumn("_at", F.filter(F.sequence(F.lit(0), F.size(k)), lambda i: (i == 0) | (i == F.size(k)) | differs(F.get(k, i), F.get(k, i - 1))))
    of = lambda x: [*[x[c].alias(c) for c in by], x["pos"].alias("first")] if by else [x.alias("key")]
    size = lambda i, nth: F.get(at, nth + 1) - i
    extra = lambda i, nth: [f(F.slice(k, i + 1, size(i, nth))).alias(c) for c, f in (more or {}).items()]
    run = lambda i, nth: F.struct(*of(F.get(k, i)), size(i, nth).cast("long").alias("count"), *extra(i, nth))
    runs = F.transform(F.slice(at, 1, F.size(at) - 1), run if least == 1 else lambda i, nth: F.when(size(i, nth) >= least, run(i, nth)))
    return d.withColumn("runs", runs if least == 1 else F.array_compact(runs)).drop("_k", "_at")


def _rows(d: DataFrame, id_col: str, array: Column, *keep: str) -> DataFrame:
    """id, keep, nth from 0 and the fields of each struct of an array.

    As an outer explode, whose empty rows are dropped after it: for an inner one the optimizer tests the array's size
    first, which would repeat all that makes it, within its lambdas.
    """
    return d.select(id_col, *keep, F.posexplode_outer(array).alias("nth", "x")).filter("nth IS NOT NULL").select(id_col, *keep, "nth", "x.*")


def _repeats(docs: DataFrame, id_col: str) -> bool:
    """Whether rows share an id; reads the ids alone."""
    return not docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()


def capitalization_rates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, word, total, capitalized, rate over words that don't open a sentence; counted within the row.

    Rows that share an id are summed.
    """
    d = docs.select(F.col(id_col), _inner_words(F.coalesce(F.col(text_col), F.lit(""))).alias("s"))
    # a space marks a capitalised form: it sorts right after the plain one
    d = _counted(d, F.transform("s", lambda x: F.when(_capital(x), F.concat(F.lower(x), F.lit(" "))).otherwise(F.lower(x)))).drop("s")
    r = F.col("runs")

    def word(x: Column, nth: Column) -> Column:
        plain = F.rtrim(x["key"])
        up, after, before = plain != x["key"], F.get(r, nth + 1), F.get(r, nth - 1)
        capitals = F.when(up, x["count"]).when(after["key"] == F.concat(x["key"], F.lit(" ")), after["count"]).otherwise(F.lit(0).cast("long"))
        second = up & (nth > 0) & F.coalesce(before["key"] == plain, F.lit(False))
        return F.when(~second, F.struct(plain.alias("word"), F.when(up, x["count"]).otherwise(x["count"] + capitals).alias("total"), capitals.alias("capitalized")))

    g = _rows(d, id_col, F.array_compact(F.transform(r, word))).drop("nth")
    if _repeats(docs, id_col):
        g = g.groupBy(id_col, "word").agg(F.sum("total").alias("total"), F.sum("capitalized").alias("capitalized"))
    return g.withColumn("rate", F.col("capitalized") / F.col("total"))


def _capital(word: Column) -> Column:
    """Whether a word, which begins with a letter, begins with a capital: ``[`` follows Z."""
    return word < F.lit("[")


def _weight(word: Column) -> Column:
    return F.when(word.isin(*V.COMMON_WORDS), F.lit(float(V.COMMON_WEIGHT))).otherwise(F.lit(float(V.OTHER_WEIGHT)))


def _lift(count: Column, n: Column, weight: Column) -> Column:
    return (count / n) * 1000 / weight


def _by_lift(counts: DataFrame, id_col: str, weight, limit: int) -> DataFrame:
    """Of tokens that occur twice or more, the first ``limit`` by lift, ties by first occurrence."""
    order = W.partitionBy(id_col).orderBy(F.col("lift").desc(), F.col("first"))
    d = counts.filter("count >= 2").withColumn("lift", _lift(F.col("count"), F.col("n"), weight(F.col("token"))))
    return d.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select(id_col, "token", "count", "lift", "rank")


def _by_lift_within(counted: DataFrame, id_col: str, weight, limit: int) -> DataFrame:
    """The same of rows with n and runs (token, count, first, ...), each ranked by itself."""
    d = counted.select(id_col, F.transform("runs", lambda x: F.struct((-_lift(x["count"], F.col("n"), weight(x["token"]))).alias("order"), x["first"].alias("first"), x["token"].alias("token"), x["count"].alias("count"))).alias("runs"))
    d = _rows(d, id_col, F.slice(F.sort_array("runs"), 1, limit))
    return d.select(id_col, "token", "count", (-F.col("order")).alias("lift"), (F.col("nth") + 1).alias("rank"))


def top_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 8) -> DataFrame:
    """id, token, count, lift, rank; names, mostly capitalised where they don't open a sentence, are left out.

    Words are counted and ranked within the row; only rows that share an id are summed over a shuffle. Words that don't
    open a sentence are all words less those that do and those in stretches that close no sentence, which are few.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col), X.alpha_words(t).alias("w"), F.regexp_extract_all(t, F.lit(X.SCAN), F.lit(0)).alias("s"))
    # the scan's stretches hold every word; one that ends in a mark, but isn't the last, closes no sentence
    lost = lambda s, i: F.substring(s, -1, 1).isin(".", "!", "?") & (i + 1 < F.size("s"))
    first_word = lambda s: F.array(F.regexp_extract(s, V.WORD, 0))
    outer = F.flatten(F.transform("s", lambda s, i: F.when(lost(s, i), X.alpha_words(s)).otherwise(first_word(s))))
    entry = lambda x, out, pos: F.struct(F.lower(x).alias("token"), F.lit(out).alias("out"), pos.alias("pos"), _capital(x).alias("up"))
    keys = F.concat(F.transform("w", lambda x, i: entry(x, False, i)), F.transform(outer, lambda x: entry(x, True, F.lit(0))))
    meant = lambda k: (F.length(k["token"]) >= 3) & ~k["token"].isin(*V.STOPWORDS)
    d = d.select(id_col, F.greatest(F.lit(1), F.size("w")).alias("n"), F.filter(keys, meant).alias("k"))
    number = lambda group, test: F.size(F.filter(group, test)).cast("long")
    more = {
        "outer": lambda g: number(g, lambda x: x["out"]), "capitals": lambda g: number(g, lambda x: x["up"] & ~x["out"]) - number(g, lambda x: x["up"] & x["out"]),
    }
    repeats = _repeats(docs, id_col)
    d = _counted(d, F.col("k"), "token", more=more, least=1 if repeats else 2).drop("k")
    # a run holds a token's own entries, count less outer, and its outer ones
    own = lambda x: x["count"] - x["outer"]
    token = lambda x: F.struct(x["token"].alias("token"), own(x).alias("count"), x["first"].alias("first"), (own(x) - x["outer"]).alias("inner"), x["capitals"].alias("capitals"))
    d = d.withColumn("runs", F.transform("runs", token))
    name = lambda inner, capitals: (inner > 0) & (capitals / inner >= V.PROPER_NOUN_RATE)
    if not repeats:
        return _by_lift_within(d.withColumn("runs", F.filter("runs", lambda x: (x["count"] >= 2) & ~name(x["inner"], x["capitals"]))), id_col, _weight, limit)
    rows = _rows(d, id_col, F.col("runs"), "n")
    sums = [F.sum(c).alias(c) for c in ("count", "inner", "capitals")]
    counts = rows.groupBy(id_col, "token").agg(*sums, F.min("first").alias("first"), F.first("n").alias("n"))
    return _by_lift(counts.filter(~name(F.col("inner"), F.col("capitals"))), id_col, _weight, limit)


def _pair_weight(pair: Column) -> Column:
    return (_weight(F.substring_index(pair, " ", 1)) + _weight(F.substring_index(pair, " ", -1))) / 2


def top_bigrams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 8) -> DataFrame:
    """id, token, count, lift, rank of adjacent pairs that aren't both stop words; pairs cross sentences.

    Counted and ranked as ``top_words`` are.
    """
    words = F.transform(X.alpha_words(F.coalesce(F.col(text_col), F.lit(""))), lambda x: F.struct(F.lower(x).alias("w"), F.lower(x).isin(*V.STOPWORDS).alias("stop")))
    d = docs.select(F.col(id_col), words.alias("w"))
    w = F.col("w")
    pair = lambda x, i: F.when((i + 1 < F.size(w)) & ~(x["stop"] & F.get(w, i + 1)["stop"]), F.struct(F.concat_ws(" ", x["w"], F.get(w, i + 1)["w"]).alias("token"), i.alias("pos")))
    repeats = _repeats(docs, id_col)
    d = _counted(d.select(id_col, F.greatest(F.lit(1), F.size("w")).alias("n"), F.array_compact(F.transform("w", pair)).alias("k")), F.col("k"), "token", least=1 if repeats else 2).drop("k")
    if not repeats:
        return _by_lift_within(d, id_col, _pair_weight, limit)
    rows = _rows(d, id_col, F.col("runs"), "n")
    counts = rows.groupBy(id_col, "token").agg(F.sum("count").alias("count"), F.min("first").alias("first"), F.first("n").alias("n"))
    return _by_lift(counts, id_col, _pair_weight, limit)


def as_list(ranked: DataFrame, id_col: str, name: str) -> DataFrame:
    """The tokens of a ranked table as one array per id, in order."""
    return ranked.groupBy(id_col).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "token"))), lambda x: x["token"]).alias(name))


def merge_stats(samples: DataFrame, key: str) -> DataFrame:
    """One row per ``key``: counts summed, the other statistics averaged by word count and rounded again."""
    w = F.col("word_count").cast("double")
    one = F.count(F.lit(1)) == 1
    mean = lambda c: F.when(one, F.max(c)).otherwise(X.fixed(F.sum(F.col(c) * w) / F.sum(w), NUMERIC[c]))
    return samples.groupBy(key).agg(
        F.count(F.lit(1)).alias("sample_count"), F.sum("word_count").alias("word_count"), F.sum("sentence_count").alias("sentence_count"), *[mean(c).alias(c) for c in NUMERIC]
    )


def merge_by_presence(ranked: DataFrame, key: str, sample_col: str, limit: int = 10) -> DataFrame:
    """key, token, samples, rank: tokens by the number of samples that have them, ties by first appearance."""
    first = F.min(F.struct(sample_col, "rank"))
    g = ranked.groupBy(key, "token").agg(F.count(F.lit(1)).alias("samples"), first.alias("first"))
    order = W.partitionBy(key).orderBy(F.col("samples").desc(), F.col("first"))
    return g.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit).select(key, "token", "samples", "rank")
