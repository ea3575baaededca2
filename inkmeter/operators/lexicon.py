"""Lexicons: entries, inflection, dictionaries, and matching them against documents.

Single words meet the text in a broadcast hash join on the lower-cased token: a word's forms are at most nine
rows of a table of a few thousand. Phrases and patterns are foldable regular expressions, unrolled side by side.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions import fixed as V
from ..functions import text as X

#: Lower-case literals one of which stands in every match of a pattern: texts without one need no pattern.
GATES = {
    "all-none": ("none of the",), "negative-listing": ("not", "wasn"), "elevation-echo": ("just", "only", "none of"), "stop-start": ("stop",), "not-only-but-also": ("not only",), "at-its-core": ("at its core",),
    "more-you-less-you": ("the more you",), "thats-where-comes-in": ("comes in",), "not-all-created-equal": ("created equal",), "most-people-believe-wrong": ("most people",), "studies-show-percent": ("studies show that",),
    "vague-authority-attribution": ("experts", "research", "studies", "report", "observers"),
    "participial-tail-abstract": ("underscoring", "highlighting", "emphasizing", "emphasising", "reinforcing", "reflecting", "signaling", "signalling", "showcasing", "illustrating", "demonstrating"),
    "em-dash-rate": ("—", "--"), "ai-utm-source": ("utm_source=", "referrer="), "ai-citation-markup": ("cite", "contentreference", "oai_citation", "attached_file", "grok_card"), "ai-placeholder": ("[", "xx", "<!--"),
    "formulaic-opener": ("world", "landscape", "realm", "space", "field", "domain", "era", "age", "evolve", "forward", "into", "through", "emerged", "increasingly"), "to-name-a-few": ("to name",),
    "hedge-stack": ("potentially", "eventually", "ultimately", "possibly", "conceivably"), "bulleted-bold-term": ("**",), "markdown-heading-leak": ("#",), "markdown-bold-in-prose": ("**",),
    "category-contrast-positioning": ("most", "many"), "narrated-intent-scaffold": ("let me", "i'll", "i will"), "parenthetical-hedge": ("(",),
}


def pattern_counts(text: Column, low: Column, rows: Sequence[tuple]) -> Column:
    """An array of (key, count) of the patterns that match. rows: (key, pattern, literals or None).

    Every pattern is a literal, compiled once a task. One with literals is tried only where ``low``, the text in
    lower case, has one of them.
    """
    def count(pattern: str, needs: Sequence[str] | None) -> Column:
        n = F.regexp_count(text, X.rx(pattern)).cast("long")
        return F.when(functools.reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in needs]), n).otherwise(F.lit(0).cast("long")) if needs else n

    found = F.array(*[F.struct(F.lit(k).alias("key"), count(p, needs).alias("count")) for k, p, needs in rows])
    return F.filter(found, lambda c: c["count"] > 0)


_INFLECTABLE = re.compile(r"[A-Za-z]{3,}")
#: Forms that may be broadcast; beyond it the join is left to the planner.
BROADCAST_FORMS = 200_000


@dataclass(frozen=True)
class Entry:
    ord: int
    term: str
    category: str
    subcategory: str
    confidence: str
    strength: int
    lifecycle: str = "live"
    pattern: str | None = None  # of a structural entry
    id: str | None = None
    hint: str | None = None
    note: str | None = None

    @property
    def key(self) -> str:
        return self.term.strip().lower()

    @property
    def is_word(self) -> bool:
        return self.pattern is None and re.fullmatch(r"[A-Za-z0-9_]+", self.term) is not None

    @property
    def may_be_name(self) -> bool:
        return _INFLECTABLE.fullmatch(self.term) is not None

    @property
    def severity(self) -> str:
        return {"red": "high", "orange": "medium", "yellow": "low"}[self.confidence]

    @property
    def custom(self) -> bool:
        return self.category == "custom"


def inflections(term: str) -> list[str]:
    """Regular forms of an alphabetic word: plural, past, -ing, -ly; approximate on purpose."""
    t = term.lower()
    forms = [next(t[: len(t) - cut] + added for ending, cut, added in rules if re.search(ending, t)) for rules in V.INFLECTIONS]
    return [f for f in dict.fromkeys(forms) if f != t]


def inflected(terms: DataFrame, term_col: str = "term") -> DataFrame:
    """term, form: the same rules over a lexicon that is a table; forms that are terms go."""
    t = F.lower(F.col(term_col))

    def form(rules) -> Column:
        out = F.lit(None).cast("string")
        for ending, cut, added in reversed(rules):
            out = F.when(t.rlike(ending), F.concat(F.substring(t, F.lit(1), F.length(t) - cut), F.lit(added))).otherwise(out)
        return out

    forms = F.array(*map(form, V.INFLECTIONS))
    words = terms.filter(F.col(term_col).rlike(r"^[A-Za-z]{3,}\z")).select(F.col(term_col).alias("term"), F.explode(F.array_distinct(forms)).alias("form"))
    explicit = terms.select(F.lower(term_col).alias("form")).distinct()
    return words.join(explicit, "form", "left_anti").select("term", "form")


def builtin_entries(hard: Sequence[tuple] = V.HARD_TERMS, soft: Sequence[tuple] = V.SOFT_TERMS) -> list[Entry]:
    """Hard terms, soft terms and structural patterns, in the order that ties follow. ``hard`` is an input table."""
    out: list[Entry] = []
    for term, category, subcategory, hint in hard:
        out.append(Entry(len(out), term, category, subcategory, "red", V.HARD_STRENGTH, hint=hint))
    for term, category, subcategory, note in soft:
        out.append(Entry(len(out), term, category, subcategory, "orange", V.SOFT_STRENGTH, note=note))
    for p in V.PATTERNS:
        out.append(Entry(len(out), p.term, p.category, p.subcategory, p.confidence, p.strength, p.lifecycle, p.regex, p.id))
    return out


def dedupe_words(words: Iterable[str]) -> list[str]:
    """Trimmed, blanks dropped, the first casing of each word kept."""
    seen: dict[str, str] = {}
    for w in words:
        w = w.strip()
        if w:
            seen.setdefault(w.lower(), w)
    return list(seen.values())


def remove_word(words: Iterable[str], word: str) -> list[str]:
    return [w for w in words if w.lower() != word.strip().lower()]


def merged_scopes(words: DataFrame, shared: str = "global") -> DataFrame:
    """style, nth, word: of a table (scope, ord, word) each style's words, shared ones first, the first casing of each kept."""
    clean = words.withColumn("word", X.trim(F.col("word"))).filter("word <> ''")
    styles = words.filter(F.col("scope") != shared).select(F.col("scope").alias("style")).distinct()
    sources = styles.select("style", F.explode(F.array(F.lit(shared), F.col("style"))).alias("scope"))
    mine = sources.join(clean, "scope")
    order = [F.col("scope") != shared, F.col("ord")]
    once = mine.withColumn("k", F.row_number().over(W.partitionBy("style", F.lower("word")).orderBy(*order))).filter("k = 1")
    return once.select("style", F.row_number().over(W.partitionBy("style").orderBy(*order)).alias("nth"), "word")


def phrase_pattern(term: str) -> str:
    """A literal, any case, with a boundary on a side that is a word character."""
    return "(?i)" + (r"\b" if re.match(r"[A-Za-z0-9_]", term) else "") + X.quote(term) + (r"\b" if re.search(r"[A-Za-z0-9_]$", term) else "")


@dataclass(frozen=True)
class Lexicon:
    """The entries of an audit: built-in ones without allowed words, then a user's own."""

    entries: tuple[Entry, ...]
    explicit: frozenset[str]

    @staticmethod
    def of(base: Sequence[Entry], banned: Iterable[str] = (), allowed: Iterable[str] = ()) -> Lexicon:
        off = {w.strip().lower() for w in allowed if w.strip()}
        kept = [e for e in base if e.key not in off]
        n = len(base)
        own = [Entry(n + k, w, "custom", "user-banned", "red", V.HARD_STRENGTH) for k, w in enumerate(x for x in dedupe_words(banned) if x.lower() not in off)]
        return Lexicon((*kept, *own), frozenset(e.term.lower() for e in base if e.pattern is None))

    def resolved(self) -> list[Entry]:
        """Strength and lifecycle of entries that share a term are the first one's."""
        first: dict[str, Entry] = {}
        for e in self.entries:
            first.setdefault(e.term, e)
        return [replace(e, strength=first[e.term].strength, lifecycle=first[e.term].lifecycle) if not e.custom else e for e in self.entries]

    def twins(self) -> dict[str, Entry]:
        """The built-in entry, the last one, that has a user's word as its term."""
        return {e.key: e for e in self.entries if not e.custom}

    def forms(self, e: Entry) -> list[str]:
        own = [e.term.lower()]
        return own if e.custom or not e.may_be_name else own + [f for f in inflections(e.term) if f not in self.explicit]

    def pattern(self, e: Entry) -> str:
        if e.pattern is not None:
            return e.pattern
        if e.is_word:
            return r"(?i)\b(?:" + "|".join(X.quote(f) for f in self.forms(e)) + r")\b"
        return phrase_pattern(e.term)


def suppressed_in(e: Entry) -> list[str]:
    """The registers that don't count an entry."""
    by_id = [r for r, ids in V.DETECTOR_SUPPRESSIONS.items() if e.id in ids]
    return list(dict.fromkeys(by_id + [r for r, terms in V.TERM_SUPPRESSIONS.items() if e.key in terms]))


def entry_table(spark: SparkSession, lexicon: Lexicon) -> DataFrame:
    """The lexicon as a dimension table."""
    rows = [(e.ord, e.id, e.term, e.category, e.subcategory, e.confidence, e.severity, int(e.strength), e.lifecycle, e.hint, e.note, e.may_be_name, lexicon.pattern(e), X.java(lexicon.pattern(e))) for e in lexicon.resolved()]
    return spark.createDataFrame(
        rows, "ord int, id string, term string, category string, subcategory string, confidence string, severity string, strength int, lifecycle string, hint string, note string, may_be_name boolean, pattern string, java string"
    )


def token_rows(docs: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """id, keep, raw, token, gap, pos: maximal runs of word characters, and what stands before each."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    pieces = F.arrays_zip(F.regexp_extract_all(t, F.lit(r"\w+"), F.lit(0)).alias("raw"), F.slice(F.split(t, r"\w+", -1), 1, 1 << 30).alias("gap"))
    rows = docs.select(id_col, *keep, F.posexplode(pieces).alias("pos", "x")).filter(F.col("x.raw").isNotNull())
    return rows.select(id_col, *keep, F.col("x.raw").alias("raw"), F.lower("x.raw").alias("token"), F.col("x.gap").alias("gap"), "pos")


def opens_sentence(gap: Column, pos: Column) -> Column:
    """Whether a token stands at a sentence's start, by the gap before it; worked out for hits only."""
    rest = F.rtrim(gap, F.lit(X.WS_CHARS))
    return F.when(rest == "", pos == 0).otherwise(F.substring(rest, -1, 1).isin(".", "!", "?"))


def _small(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A dimension table from the driver; broadcast up to ``BROADCAST_FORMS`` rows, else the planner decides."""
    table = spark.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= BROADCAST_FORMS else table


def match_counts(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", register_col: str | None = None) -> DataFrame:
    """id, ord, count: matches of every entry that is in force for the document's register.

    A single word that stands capitalised within a sentence is taken as a name and doesn't count.
    """
    spark = docs.sparkSession
    off = _not_in_force(lexicon, lexicon.resolved())
    never = {n for r, n in off if r == "*"}
    entries = [e for e in lexicon.resolved() if e.ord not in never]
    reg = F.when(F.col(register_col).isin(*V.REGISTERS), F.col(register_col)).otherwise(F.lit("")) if register_col else F.lit("")
    d = docs.select(F.col(id_col), F.col(text_col), reg.alias("_register"))
    words, others = [e for e in entries if e.is_word], [e for e in entries if not e.is_word]
    out = None
    if words:
        forms = [(f, e.ord, e.may_be_name) for e in words for f in lexicon.forms(e)]
        hits = token_rows(d, id_col, text_col, "_register").join(_small(spark, forms, "token string, ord int, may_be_name boolean"), "token")
        name = F.col("may_be_name") & F.col("raw").rlike("^[A-Z]") & ~opens_sentence(F.col("gap"), F.col("pos"))
        out = hits.filter(~name).groupBy(id_col, "_register", "ord").agg(F.count(F.lit(1)).alias("count"))
    if others:
        gate = lambda e: GATES.get(e.id) if e.pattern is not None else (e.term.lower(),)
        t = d.select(id_col, "_register", F.coalesce(F.col(text_col), F.lit("")).alias("_t")).withColumn("_low", F.lower("_t"))
        found = pattern_counts(F.col("_t"), F.col("_low"), [(e.ord, lexicon.pattern(e), gate(e)) for e in others])
        p = t.select(id_col, "_register", F.explode(found).alias("x")).select(id_col, "_register", F.col("x.key").alias("ord"), F.col("x.count").alias("count"))
        out = p if out is None else out.unionByName(p)
    if out is None:
        return d.select(id_col, F.lit(0).alias("ord"), F.lit(0).cast("long").alias("count")).limit(0)
    rules = [x for x in off if x[0] != "*" and (register_col or x[0] == "")]
    if rules:
        r = _small(spark, rules, "_in string, _off int")
        out = out.join(r, (F.col("_register") == F.col("_in")) & (F.col("ord") == F.col("_off")), "left_anti")
    return out.select(id_col, "ord", "count")


def _not_in_force(lexicon: Lexicon, entries: list[Entry]) -> list[tuple[str, int]]:
    """(register, or * for any, and ord) of entries that are suppressed or give way to another with the same term."""
    twins, custom = lexicon.twins(), {e.key for e in entries if e.custom}
    every = (*V.REGISTERS, "")  # the empty one: a document without a register
    out: list[tuple[str, int]] = []
    for e in entries:
        if e.custom:
            twin = twins.get(e.key)
            if twin is not None and twin.confidence == "red":  # the built-in entry says it, where it is in force
                hidden = suppressed_in(twin)
                out += [("*", e.ord)] if not hidden else [(r, e.ord) for r in every if r not in hidden]
        elif e.key in custom and twins[e.key].confidence != "red":
            out.append(("*", e.ord))
        else:
            out += [(r, e.ord) for r in suppressed_in(e)]
    return out


def findings(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text", register_col: str | None = None) -> DataFrame:
    """One row per document and entry that matched, with the entry's columns, count and scored."""
    counts = match_counts(docs, lexicon, id_col, text_col, register_col)
    table = entry_table(docs.sparkSession, lexicon)
    f = counts.join(F.broadcast(table) if len(lexicon.entries) <= BROADCAST_FORMS else table, "ord")
    return f.withColumn("scored", (F.col("confidence") == "red") | (F.col("count") >= V.OVERUSE))


def with_spans(found: DataFrame, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``found`` with matches: start, end, line and col (from 1) of each match, names left out."""
    d = found.join(docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_t")), id_col)
    t = F.col("_t")
    all_spans = X.spans(t, F.col("java"))
    name = lambda m: F.col("may_be_name") & F.substring(t, m["start"] + 1, F.lit(1)).rlike("[A-Z]") & ~X.sentence_start(t, m["start"])
    d = d.withColumn("_m", F.filter(all_spans, lambda m: ~name(m)))
    placed = F.transform("_m", lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), X.line_of(t, m["start"]).alias("line"), X.column_of(t, m["start"]).alias("col")))
    return d.withColumn("matches", placed).drop("_t", "_m")
