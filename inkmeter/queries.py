"""The library's queries, one per operator or a few, with equivalent SQL where SQL can express them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fixed as V
from .functions import text as X
from .operators import audit as A
from .operators import evaluate as E
from .operators import facts as FA
from .operators import lexicon as L
from .operators import lint as LI
from .operators import rhythm as R
from .operators import stats as S
from .operators import voices as VO
from .sources import files as FI

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: A user's dictionary, drawn from the data: banned and allowed words.
BANNED = ("thanedble", "ertion", "rely", "with", "Ertion", " the ")
ALLOWED = ("The",)
LINES = r"\n"  # the tables have no blank lines, so a line is a paragraph


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return FI.spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def register_of(source: Column) -> Column:
    """Sources stand in for registers: every fifth has none."""
    k = F.regexp_extract(source, r"\d+", 0).cast("int") % 5
    return F.when(k == 0, "docs").when(k == 1, "blog").when(k == 2, "memo").when(k == 3, "essay")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", "source", register_of(F.col("source")).alias("register"))


def user_lexicon() -> L.Lexicon:
    return L.Lexicon.of([], BANNED, ALLOWED)


# --- SQL pieces ---
def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def values(name: str, cols: tuple[str, ...], rows: list[tuple]) -> str:
    show = lambda v: "NULL" if v is None else lit(v) if isinstance(v, str) else str(v)
    return f"{name}({', '.join(cols)}) AS (VALUES " + ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows) + ")"


DOCS = "d AS (SELECT doc_id, text, source, CASE regexp_extract(source, '\\d+')::INT % 5 WHEN 0 THEN 'docs' WHEN 1 THEN 'blog' WHEN 2 THEN 'memo' WHEN 3 THEN 'essay' END AS register FROM documents)"
WORDS = f"regexp_extract_all({{}}, {lit(V.WORD)})"
SCAN = f"list_filter(list_transform(regexp_extract_all({{}}, {lit(V.SENTENCE_SCAN)}), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
EDGE = (
    "list_filter(list_transform(string_split(regexp_replace(regexp_replace({}, '\\s+', ' ', 'g'), '([.!?]) ([A-Z0-9\"''])', '\\1' || chr(30) || '\\2', 'g'), chr(30)), "
    "lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
)
PARS = "list_filter(list_transform(regexp_split_to_array({}, '\\n'), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')"
WS = "len(regexp_extract_all({}, '\\S+'))"


def rounded(x: str, n: int) -> str:
    return f"floor(({x}) * 1e{n} + 0.5) / 1e{n}"


def sd(n: str, s: str, s2: str) -> str:
    return f"CASE WHEN {n} < 2 THEN 0.0::DOUBLE ELSE sqrt(({n} * {s2} - {s} * {s})::DOUBLE) / {n} END"


def cv(n: str, s: str, s2: str) -> str:
    return f"CASE WHEN {n} < 2 THEN 1.0::DOUBLE WHEN {s} = 0 THEN 0.0::DOUBLE ELSE sqrt(({n} * {s2} - {s} * {s})::DOUBLE) / {s} END"


def moments(a: str, p: str) -> str:
    return f"len({a})::BIGINT AS {p}n, coalesce(list_sum({a}), 0)::BIGINT AS {p}1, coalesce(list_sum(list_transform({a}, lambda x: x * x)), 0)::BIGINT AS {p}2"


def in_list(words) -> str:
    return "(" + ", ".join(lit(w) for w in words) + ")"


# --- lexicon matching ---
TOKENS = "t AS (SELECT doc_id, lower(w) AS token FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) AS w FROM documents))"
#: tokens that stand capitalised within a sentence, found by what comes before them
NAMES = (
    "n AS (SELECT doc_id, lower(w) AS token FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '([.!?]\\s+)([A-Z])', '\\1' || chr(30) || '\\2', 'g'), "
    "'[A-Za-z0-9_]+|' || chr(30) || '[A-Za-z0-9_]+')) AS w, generate_subscripts(regexp_extract_all(regexp_replace(text, '([.!?]\\s+)([A-Z])', '\\1' || chr(30) || '\\2', 'g'), "
    "'[A-Za-z0-9_]+|' || chr(30) || '[A-Za-z0-9_]+'), 1) AS k FROM documents) WHERE k > 1 AND w SIMILAR TO '[A-Z].*')"
)


def user_sums(words: tuple[str, ...]) -> str:
    return f"""
        {TOKENS}, {NAMES},
        c AS (SELECT doc_id, token, count(*) AS k FROM t WHERE token IN {in_list(words)} GROUP BY ALL),
        m AS (SELECT doc_id, token, count(*) AS k FROM n WHERE token IN {in_list(words)} GROUP BY ALL),
        e AS (SELECT c.doc_id, c.token, c.k - coalesce(m.k, 0) AS k FROM c LEFT JOIN m USING (doc_id, token) WHERE c.k > coalesce(m.k, 0)),
        s AS (SELECT doc_id, sum(80 * (1 + least(k - 1, 4) * 0.5::DOUBLE)) AS weighted_sum FROM e GROUP BY doc_id),
        w AS (SELECT doc_id, len(regexp_extract_all(text, '\\S+')) AS word_count, coalesce(weighted_sum, 0)::DOUBLE AS weighted_sum FROM documents LEFT JOIN s USING (doc_id)),
        q AS (SELECT *, weighted_sum / ((word_count + 1500) / 1000.0::DOUBLE) AS density FROM w),
        r AS (SELECT *, CASE WHEN weighted_sum > 0 THEN floor(100 * density / (density + 100) + 0.5)::INT ELSE 0 END AS score FROM q)"""


BANNED_KEYS = ("thanedble", "ertion", "rely", "with")
TIER = "CASE WHEN score < 15 THEN 'green' WHEN score < 35 THEN 'yellow' WHEN score < 55 THEN 'orange' ELSE 'red' END"


@query(f"WITH {user_sums(BANNED_KEYS)} SELECT doc_id, word_count, weighted_sum, score, {TIER} AS tier FROM r")
def audit_user_dictionary(spark, sf_dir):
    return A.lexical_scores(documents(spark, sf_dir), user_lexicon()).select("doc_id", "word_count", "weighted_sum", "score", "tier")


@query(f"WITH {user_sums(BANNED_KEYS)}, z AS (SELECT {TIER} AS tier FROM r) SELECT tier, count(*) AS n FROM z GROUP BY tier")
def tier_histogram(spark, sf_dir):
    return A.lexical_scores(documents(spark, sf_dir), user_lexicon()).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {user_sums(BANNED_KEYS)} SELECT doc_id, token AS term, k AS matches, k >= 1 AS scored FROM e")
def proper_noun_exclusion(spark, sf_dir):
    found = L.findings(documents(spark, sf_dir), user_lexicon())
    return found.select("doc_id", F.lower("term").alias("term"), F.col("count").alias("matches"), "scored")


@query(f"WITH {user_sums(('thanedble', 'with'))} SELECT doc_id, token AS term, k AS matches FROM e")
def allow_list_anti_join(spark, sf_dir):
    found = L.findings(documents(spark, sf_dir), L.Lexicon.of([], BANNED, ("The", "rely ", "ERTION")))
    return found.select("doc_id", "term", F.col("count").alias("matches"))


# --- tokenizers and splitters ---
@query(f"""
    SELECT doc_id, {WS.format('text')} AS ws_words, len({WORDS.format('text')}) AS alpha_words, greatest(1, len(regexp_extract_all(text, {lit(V.ALNUM)}))) AS alnum_words,
           array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z'']+')[1:6], lambda x: lower(x)), ' ') AS opener,
           len(list_filter(regexp_extract_all(lower(text), '[a-z'']+'), lambda x: len(x) > 2 AND x NOT IN {in_list(V.FACT_STOPWORDS)})) AS content_words
    FROM documents
""")
def word_counts(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id", X.ws_word_count(t).alias("ws_words"), F.size(X.alpha_words(t)).alias("alpha_words"), X.alnum_count(t).alias("alnum_words"), X.opener(t).alias("opener"), F.size(X.content_words(t)).alias("content_words")
    )


def _split_sql(split: str) -> str:
    return f"WITH s AS (SELECT doc_id, {split.format('text')} AS s FROM documents) SELECT doc_id, len(s) AS sentences, coalesce(list_sum(list_transform(s, lambda x: len(x))), 0)::BIGINT AS characters, s[1] AS first FROM s"


def _split(docs: DataFrame, split) -> DataFrame:
    d = docs.select("doc_id", split(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").alias("sentences"), X.total(F.transform("s", F.length)).alias("characters"), F.get("s", F.lit(0)).alias("first"))


@query(_split_sql(SCAN))
def sentence_split_scan(spark, sf_dir):
    return _split(table(spark, sf_dir, "documents"), X.sentences_scan)


@query(_split_sql(EDGE))
def sentence_split_boundary(spark, sf_dir):
    return _split(table(spark, sf_dir, "documents"), X.sentences_boundary)


@query(f"SELECT doc_id, list_transform({PARS.format('text')}, lambda p: len({EDGE.format('p')})) AS lengths FROM documents")
def paragraph_lengths(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.transform(X.paragraphs(F.col("text"), LINES), lambda p: F.size(X.sentences_boundary(p))).alias("lengths"))


# --- statistics ---
def stats_sql(rows: str, keep: str, text: str = "text") -> str:
    """CTEs a, b and st over the CTE or table ``rows``; st has keep and the statistics."""
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END"
    marks = " + ".join(f"contains({text}, {lit(m)})::INT" for m in V.VARIETY_MARKS)
    found = lambda pattern: f"len(regexp_extract_all(text, {lit(pattern)}))"
    cols = {
        "avg_sentence_length": share("l1::DOUBLE", "ln"), "sentence_length_sd": sd("ln", "l1", "l2"), "avg_paragraph_sentences": share("p1::DOUBLE", "pn"),
        "paragraph_length_cv": f"CASE WHEN p1 > 0 THEN ({sd('pn', 'p1', 'p2')}) / (p1::DOUBLE / pn) ELSE 0 END", "contraction_rate": f"{found(V.CONTRACTION)} / n::DOUBLE * 100",
        "em_dash_per_1000": f"{found('—')} / n::DOUBLE * 1000", "semicolon_per_1000": f"{found(';')} / n::DOUBLE * 1000",
        "question_rate": share("len(list_filter(s, lambda x: ends_with(x, '?')))::DOUBLE", "len(s)"), "avg_word_length": "coalesce(list_sum(list_transform(w, lambda x: len(x))), 0)::DOUBLE / n",
        "fragment_rate": share("len(list_filter(l, lambda x: x > 0 AND x <= 3))::DOUBLE", "len(s)"),
        "structural_entropy": f"((CASE WHEN len(o) < 2 THEN 0 ELSE len(list_distinct(o))::DOUBLE / len(o) END) + ({marks}) / 5.0::DOUBLE) / 2",
        "relational_pronoun_rate": f"{found(V.RELATIONAL)} / n::DOUBLE * 1000",
    }
    return f"""
        a AS (SELECT {keep}, {text} AS text, {WORDS.format(text)} AS w, {SCAN.format(text)} AS s, {PARS.format(text)} AS p FROM {rows}),
        b AS (SELECT *, greatest(1, len(w)) AS n, list_transform(s, lambda x: len({WORDS.format('x')})) AS l,
                     list_filter(list_transform(s, lambda x: lower(regexp_extract(x, {lit(V.WORD)}))), lambda x: x <> '') AS o,
                     list_transform(p, lambda x: greatest(1, len({SCAN.format('x')}))) AS pl FROM a),
        c AS (SELECT *, {moments('l', 'l')}, {moments('pl', 'p')} FROM b),
        st AS (SELECT {re.sub(r"[a-z_]+ AS ", "", keep)}, n::BIGINT AS word_count, len(s)::BIGINT AS sentence_count, {', '.join(f'{rounded(v, S.NUMERIC[k])} AS {k}' for k, v in cols.items())} FROM c)"""


@query(f"WITH {stats_sql('documents', 'doc_id')} SELECT * FROM st")
def text_stats(spark, sf_dir):
    return S.text_stats(table(spark, sf_dir, "documents").select("doc_id", "text"), paragraph=LINES).drop("text")


@query(f"WITH s AS (SELECT doc_id, text, list_filter(list_transform({SCAN.format('text')}, lambda x: lower(regexp_extract(x, {lit(V.WORD)}))), lambda x: x <> '') AS o FROM documents) SELECT doc_id, CASE WHEN len(o) < 2 THEN 0 ELSE len(list_distinct(o))::DOUBLE / len(o) END AS diversity FROM s")
def opener_diversity(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", S.diversity(S.sentence_openers(X.sentences_scan(t))).alias("diversity"))


@query(f"SELECT doc_id, ({' + '.join(f'contains(text, {lit(m)})::INT' for m in V.VARIETY_MARKS)}) / 5.0::DOUBLE AS variety FROM documents")
def punctuation_variety(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.variety(F.col("text")).alias("variety"))


CAPS = f"""
    cs AS (SELECT doc_id, unnest({SCAN.format('text')}) AS s FROM documents),
    cw AS (SELECT doc_id, unnest(({WORDS.format('s')})[2:]) AS w FROM cs),
    caps AS (SELECT doc_id, lower(w) AS word, count(*) AS total, count(*) FILTER (regexp_matches(w, '^[A-Z]')) AS capitalized FROM cw GROUP BY ALL)"""


@query(f"WITH {CAPS} SELECT *, capitalized::DOUBLE / total AS rate FROM caps")
def capitalization_rates(spark, sf_dir):
    return S.capitalization_rates(table(spark, sf_dir, "documents"))


def _weight_sql(w: str) -> str:
    return f"CASE WHEN {w} IN {in_list(dict.fromkeys(V.COMMON_WORDS))} THEN 40.0::DOUBLE ELSE 2.0::DOUBLE END"


POS = f"pos AS (SELECT doc_id, greatest(1, len(w)) AS n, lower(unnest(w)) AS word, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, {WORDS.format('text')} AS w FROM documents))"
TOP_WORDS = f"""
    {POS}, {CAPS},
    k AS (SELECT doc_id, word AS token, count(*) AS count, min(pos) AS first, any_value(n) AS n FROM pos WHERE word NOT IN {in_list(V.STOPWORDS)} AND len(word) >= 3 GROUP BY ALL HAVING count(*) >= 2),
    f AS (SELECT k.* FROM k LEFT JOIN caps ON caps.doc_id = k.doc_id AND caps.word = k.token AND capitalized::DOUBLE / total >= 0.6 WHERE caps.word IS NULL),
    lw AS (SELECT doc_id, token, count, (count::DOUBLE / n) * 1000 / ({_weight_sql('token')}) AS lift, first FROM f),
    top_words AS (SELECT doc_id, token, count, lift, row_number() OVER (PARTITION BY doc_id ORDER BY lift DESC, first) AS rank FROM lw)"""
BIGRAMS = f"""
    bp AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
    bq AS (SELECT doc_id, greatest(1, len(w)) AS n, lower(unnest(w[:-2])) AS a, lower(unnest(w[2:])) AS b, unnest(range(len(w) - 1)) AS pos FROM bp WHERE len(w) > 1),
    bk AS (SELECT doc_id, a, b, count(*) AS count, min(pos) AS first, any_value(n) AS n FROM bq WHERE NOT (a IN {in_list(V.STOPWORDS)} AND b IN {in_list(V.STOPWORDS)}) GROUP BY ALL HAVING count(*) >= 2),
    bl AS (SELECT doc_id, a || ' ' || b AS token, count, (count::DOUBLE / n) * 1000 / ((({_weight_sql('a')}) + ({_weight_sql('b')})) / 2) AS lift, first FROM bk),
    top_bigrams AS (SELECT doc_id, token, count, lift, row_number() OVER (PARTITION BY doc_id ORDER BY lift DESC, first) AS rank FROM bl)"""


@query(f"WITH {TOP_WORDS} SELECT * FROM top_words WHERE rank <= 8")
def top_words_lift(spark, sf_dir):
    return S.top_words(table(spark, sf_dir, "documents"))


@query(f"WITH {BIGRAMS} SELECT * FROM top_bigrams WHERE rank <= 8")
def top_bigrams_lift(spark, sf_dir):
    return S.top_bigrams(table(spark, sf_dir, "documents"))


# --- rhythm and strengths ---
PIECE = f"""
    ma AS (SELECT doc_id, register, text, list_transform({PARS.format('text')}, lambda p: {EDGE.format('p')}) AS ps FROM d),
    mb AS (SELECT *, list_transform(ps, lambda x: len(x)) AS pl, list_transform(flatten(ps), lambda x: {WS.format('x')}) AS sl FROM ma),
    mc AS (SELECT *, {moments('pl', 'p')}, {moments('sl', 's')} FROM mb),
    piece AS (SELECT doc_id, register, text, ps, pn AS paragraph_count, sn AS piece_sentences, s1 AS total_words, {cv('pn', 'p1', 'p2')} AS paragraph_cv, {cv('sn', 's1', 's2')} AS sentence_cv,
                     CASE WHEN sn > 0 THEN s1::DOUBLE / sn ELSE 0 END AS avg_sentence_words FROM mc)"""
_BASE = values("base", ("register", "sm", "sd", "pm", "pd", "fm", "fd", "em", "ed"), [(k, *[x for pair in v for x in pair]) for k, v in V.BASELINES.items()]).replace("AS (VALUES", "AS (SELECT register, sm::DOUBLE, sd::DOUBLE, pm::DOUBLE, pd::DOUBLE, fm::DOUBLE, fd::DOUBLE, em::DOUBLE, ed::DOUBLE FROM (VALUES")[:-1] + ") v(register, sm, sd, pm, pd, fm, fd, em, ed))"
FLAGS_SQL = f"""
    {DOCS}, {PIECE}, {_BASE}, {stats_sql('d', 'doc_id')},
    z AS (SELECT piece.*, (fragment_rate - fm) / fd AS fragment_z, (structural_entropy - em) / ed AS entropy_z,
                 paragraph_count >= 4 AND paragraph_cv < coalesce(pm - 0.6::DOUBLE * pd, 0.35::DOUBLE) AS uniform_paragraphs,
                 piece_sentences >= 8 AND sentence_cv < coalesce(sm - 0.6::DOUBLE * sd, 0.35::DOUBLE) AS low_burstiness
          FROM piece JOIN st USING (doc_id) LEFT JOIN base USING (register)),
    flags AS (SELECT *, coalesce(piece_sentences >= 8 AND (fragment_z <= -0.6::DOUBLE OR entropy_z >= 0.6::DOUBLE), false) AS register_drift FROM z)"""


@query(f"WITH {DOCS}, {PIECE} SELECT doc_id, paragraph_count, piece_sentences, total_words, paragraph_cv, sentence_cv, avg_sentence_words FROM piece")
def whole_piece_metrics(spark, sf_dir):
    m = R.metrics(documents(spark, sf_dir), paragraph=LINES)
    return m.select("doc_id", "paragraph_count", "piece_sentences", "total_words", "paragraph_cv", "sentence_cv", "avg_sentence_words")


@query(f"WITH {FLAGS_SQL} SELECT doc_id, uniform_paragraphs, low_burstiness, register_drift FROM flags")
def rhythm_findings(spark, sf_dir):
    return R.rhythm_flags(documents(spark, sf_dir), paragraph=LINES).select("doc_id", "uniform_paragraphs", "low_burstiness", "register_drift")


@query(f"WITH {FLAGS_SQL} SELECT doc_id, register, {rounded('fragment_z', 6)} AS fragment_z, {rounded('entropy_z', 6)} AS entropy_z FROM flags WHERE register IS NOT NULL")
def register_drift(spark, sf_dir):
    d = R.rhythm_flags(documents(spark, sf_dir).filter("register IS NOT NULL"), paragraph=LINES)
    return d.select("doc_id", "register", X.fixed(F.col("fragment_z"), 6).alias("fragment_z"), X.fixed(F.col("entropy_z"), 6).alias("entropy_z"))


_PAD = " ".join(["Harbour crews count crates by hand before dawn."] * 32)
STRUCTURE_TEXTS = [
    (1, None, f"There are three reasons below.\n\n{_PAD}"),
    (2, None, f"There are three reasons for it. They matter.\n\n{_PAD}"),
    (3, None, "There are three reasons below."),
    (4, None, f"First, the boats came in.\n\n{_PAD}\n\nSecond, they left.\n\nThird: they came back."),
    (5, "memo", f"First, the boats came in.\n\n{_PAD}\n\nSecond, they left."),
    (6, None, f"Cargo lists, first.\n\n{_PAD}\n\nDock fees, finally."),
]


@query("WITH " + values("v", ("doc_id", "e", "o"), [(1, "y", "n"), (2, "n", "n"), (3, "n", "n"), (4, "n", "y"), (5, "n", "n"), (6, "n", "y")]) + " SELECT doc_id::BIGINT AS doc_id, e = 'y' AS announced_enumeration, o = 'y' AS ordinal_scaffold FROM v")
def self_describing_structure(spark, sf_dir):
    docs = spark.createDataFrame(STRUCTURE_TEXTS, "doc_id long, register string, text string")
    return R.rhythm_flags(docs).select("doc_id", "announced_enumeration", "ordinal_scaffold")


STRENGTHS_SQL = f"""
    sw AS (SELECT *, list_transform(flatten(ps), lambda x: list_transform(regexp_extract_all(x, '\\S+'), lambda w: regexp_replace(w, '[^A-Za-z''-]', '', 'g'))) AS cw FROM piece),
    sx AS (SELECT *, len(list_filter(flatten(list_transform(cw, lambda x: x[2:])), lambda w: regexp_matches(w, '^[A-Z][A-Za-z''-]*$'))) + len(regexp_extract_all(text, {lit(V.NUMERAL)})) AS hits,
                  len(list_filter(flatten(cw), lambda w: regexp_matches(lower(w), '^[a-z''-]{{3,}}(tion|sion|ment|ness|ity|ance|ence)$'))) AS abstract,
                  greatest(1, len(regexp_extract_all(text, {lit(V.ALNUM)}))) AS words FROM sw),
    strengths AS (SELECT doc_id, {rounded('hits::DOUBLE / words * 1000', 1)} AS specificity, {rounded('hits::DOUBLE / greatest(1, abstract)', 2)} AS concrete_abstract, sentence_cv AS burstiness FROM sx),
    strong AS (SELECT *, (specificity >= 15)::INT + (concrete_abstract >= 2)::INT + (burstiness >= 0.5::DOUBLE)::INT AS strong_signals FROM strengths)"""


@query(f"WITH {DOCS}, {PIECE}, {STRENGTHS_SQL} SELECT * FROM strong")
def strength_signals(spark, sf_dir):
    return R.strengths(documents(spark, sf_dir), paragraph=LINES).select("doc_id", "specificity", "concrete_abstract", "burstiness", "strong_signals")


@query(f"""
    WITH {DOCS}, {PIECE}, {STRENGTHS_SQL}, {user_sums(BANNED_KEYS)}, z AS (SELECT doc_id, score, strong_signals, {TIER} AS tier FROM r JOIN strong USING (doc_id))
    SELECT doc_id, tier, CASE WHEN strong_signals >= 2 AND tier IN ('orange', 'red') THEN 'yellow' ELSE tier END AS capped FROM z
""")
def strength_tier_cap(spark, sf_dir):
    d = documents(spark, sf_dir)
    s = R.strengths(d, paragraph=LINES).select("doc_id", "strong_signals")
    return A.lexical_scores(d, user_lexicon()).join(s, "doc_id").select("doc_id", "tier", A.capped_tier(F.col("tier"), F.col("strong_signals"), F.col("hard_evidence")).alias("capped"))


# --- patterns ---
PATTERN_TEXTS = [
    "No wind. No waves. No boats.", "All the nets. None of the fish.", "Not a harbour. Not a dock. A promise.", "It's not just a boat, it's a home. This isn't only rope.", "Stop mending. Start sailing.",
    "It was not only wet but also cold.", "The trade is at its core a gamble.", "The more you row, the less you drift.", "That's where the tide comes in.", "Not all knots are created equal.",
    "Most people think tar is cheap. They're wrong.", "Studies show that 40% of crews sleep late.", "Industry experts say so, and research shows it. Observers note it.", "The pier fell, underscoring the need for paint.",
    "A storm — a real one — came -- and went --", "Mending The Long Nets\nThen we slept.\nAll About Tar and Rope\n", "See https://a.example/?utm_source=chatgpt.com and /?x=1&referrer=claude.ai now.",
    "citeturn0search3 and oai_citation, [attached_file:2]", "As of my last update, boats float. I don't have access to real-time data.", "Dear [Your Name], due 2024-XX-XX. <!-- todo: ropes -->",
    "In the rapidly evolving landscape of tar, rope has become increasingly important.", "Eels, cod and crabs, to name a few.", "It could potentially rain, and eventually may snow.", "- **Rope:** a long thing\n* **Tar** sticky",
    "# Heading here\ntext\n### Another", "Some **bold words** in prose.", "\U0001f680 Launch it\n✅ Done\n", "Most tools leak. This one never does.", "Let me walk you through it; I'll break this down.",
    "It works (perhaps, one day soon) (or more precisely, never at all).", "Café no. Nothing to see — here.", "", "Plain words about a quiet harbour.",
]
_TEXT_ROWS = list(enumerate(PATTERN_TEXTS))
_PATTERN_SQL = "WITH " + values("x", ("text_id", "text"), _TEXT_ROWS) + ", b AS (SELECT 'text' AS kind, text_id::BIGINT AS id, text FROM x UNION ALL SELECT 'document', doc_id, text FROM documents) "
_LOOKAROUND = ("em-dash-rate",)


def _pattern_rows(spark, sf_dir, ids) -> DataFrame:
    own = spark.createDataFrame(_TEXT_ROWS, "id long, text string").select(F.lit("text").alias("kind"), "id", "text")
    both = own.unionByName(table(spark, sf_dir, "documents").select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text"))
    both = both.withColumn("low", F.lower("text"))
    found = L.pattern_counts(F.col("text"), F.col("low"), [(p.id, p.regex, L.GATES.get(p.id)) for p in V.PATTERNS if p.id in ids])
    return both.select("kind", "id", F.explode(found).alias("x")).select("kind", "id", F.col("x.key").alias("pattern"), F.col("x.count").alias("matches"))


@query(_PATTERN_SQL + " UNION ALL ".join(f"SELECT kind, id, {lit(p.id)} AS pattern, len(regexp_extract_all(text, {lit(X.re2(p.regex))})) AS matches FROM b WHERE matches > 0" for p in V.PATTERNS if p.id not in _LOOKAROUND))
def pattern_matches(spark, sf_dir):
    return _pattern_rows(spark, sf_dir, [p.id for p in V.PATTERNS if p.id not in _LOOKAROUND])


@query(_PATTERN_SQL + r"SELECT kind, id, 'em-dash-rate' AS pattern, len(regexp_extract_all(regexp_replace(regexp_replace(text, '\s', '  ', 'g'), '^|$', ' ', 'g'), '—|\s--\s')) AS matches FROM b WHERE matches > 0")
def pattern_matches_lookaround(spark, sf_dir):
    return _pattern_rows(spark, sf_dir, _LOOKAROUND)


CODE_TEXTS = [(1, "Use `robust` here.\n```\nlet x = 1;\n```\nDone `a b`."), (2, "~~~py\nleverage\n~~~ and ``` open"), (3, "no code"), (4, "")]


@query("WITH " + values("x", ("text_id", "text"), [(1, "Use          here.\n   \n          \n   \nDone      ."), (2, "     \n        \n    and ``` open"), (3, "no code"), (4, "")]) + " SELECT text_id::BIGINT AS text_id, text AS cleaned FROM x")
def code_blanking(spark, sf_dir):
    return spark.createDataFrame(CODE_TEXTS, "text_id long, text string").select("text_id", X.strip_code(F.col("text")).alias("cleaned"))


# --- lexicon ---
@query(f"""
    WITH {DOCS}, p AS (SELECT doc_id, text, string_split(text, 'with') AS s FROM documents),
    q AS (SELECT doc_id, text, s, unnest(range(1, len(s))) AS k FROM p),
    r AS (SELECT doc_id, text, list_sum(list_transform(s[1:k], lambda x: len(x)))::BIGINT + 4 * (k - 1) AS a FROM q)
    SELECT doc_id, a::INT AS match_start, (a + 4)::INT AS match_end, (1 + len(substr(text, 1, a::INT)) - len(replace(substr(text, 1, a::INT), chr(10), '')))::INT AS line,
           (len(string_split(substr(text, 1, a::INT), chr(10))[-1]) + 1)::INT AS col
    FROM r WHERE NOT regexp_matches(substr(text, a::INT, CASE WHEN a > 0 THEN 1 ELSE 0 END), '[A-Za-z0-9_]') AND NOT regexp_matches(substr(text, a::INT + 5, 1), '[A-Za-z0-9_]')
""")
def match_line_col(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = L.Lexicon.of([L.Entry(0, "with", "custom", "user-banned", "red", 80, pattern=r"\bwith\b")])
    spans = L.with_spans(L.findings(d, lexicon), d).select("doc_id", F.explode("matches").alias("m"))
    return spans.select("doc_id", F.col("m.start").alias("match_start"), F.col("m.end").alias("match_end"), "m.line", "m.col")


_TERMS = sorted({t[0] for t in (*V.SOFT_TERMS, *V.HARD_TERMS)})


@query(
    "WITH " + values("x", ("term",), [(t,) for t in _TERMS])
    + r""", w AS (SELECT term, lower(term) AS t FROM x WHERE regexp_matches(term, '^[A-Za-z]{3,}$')),
    y AS (SELECT term, t, substr(t, 1, len(t) - 1) AS stem, regexp_matches(t, '[^e]e$') AS e, regexp_matches(t, '[^aeiou]y$') AS y FROM w),
    f AS (SELECT term, unnest(list_distinct([
            CASE WHEN regexp_matches(t, '([sxz]|[cs]h)$') THEN t || 'es' WHEN y THEN stem || 'ies' ELSE t || 's' END,
            CASE WHEN e THEN t || 'd' WHEN y THEN stem || 'ied' ELSE t || 'ed' END,
            CASE WHEN e THEN stem || 'ing' ELSE t || 'ing' END,
            CASE WHEN ends_with(t, 'le') THEN substr(t, 1, len(t) - 2) || 'ly' WHEN y THEN stem || 'ily' ELSE t || 'ly' END])) AS form FROM y)
    SELECT term, form FROM f WHERE form NOT IN (SELECT lower(term) FROM x)"""
)
def lexicon_inflection(spark, sf_dir):
    return L.inflected(spark.createDataFrame([(t,) for t in _TERMS], "term string"))


# --- the whole audit in SQL ---
def blanked(x: str, pattern: str) -> str:
    """Every match replaced by as many spaces, line breaks kept."""
    parts, found = f"regexp_split_to_array({x}, {lit(pattern)})", f"regexp_extract_all({x}, {lit(pattern)})"
    return f"array_to_string(list_transform(range(1, len({parts}) + 1), lambda i: ({parts})[i] || coalesce(regexp_replace(({found})[i], '[^\\n]', ' ', 'g'), '')), '')"


def counts_sql(lexicon: L.Lexicon, rows: str = "d") -> str:
    """CTEs over ``rows`` (doc_id, register, text): entry, and found with the counts of what is in force, scored or not."""
    entries = lexicon.resolved()
    kept = [(e.ord, e.id, e.term, e.key, e.category, e.subcategory, e.confidence, e.severity, e.strength, V.LIFECYCLE_WEIGHT[e.lifecycle], int(e.lifecycle == "hard_evidence"), e.hint, e.note, int(e.custom)) for e in entries]
    forms = [(f, e.ord, int(e.may_be_name)) for e in entries if e.is_word for f in lexicon.forms(e)]
    off = [(r, t) for table in (V.DETECTOR_SUPPRESSIONS, V.TERM_SUPPRESSIONS) for r, keys in table.items() for t in keys]
    per = [
        f"SELECT doc_id, register, {e.ord} AS ord, len(regexp_extract_all(regexp_replace(regexp_replace(text, '\\s', '  ', 'g'), '^|$', ' ', 'g'), '—|\\s--\\s')) AS k FROM {rows}" if e.id == "em-dash-rate"
        else f"SELECT doc_id, register, {e.ord} AS ord, len(regexp_extract_all(text, {lit(X.re2(lexicon.pattern(e)))})) AS k FROM {rows}"
        for e in entries if not e.is_word
    ]
    words = "[A-Za-z0-9_]+"
    marked = "regexp_replace(text, '([.!?]\\s*)([A-Z])', '\\1' || chr(30) || '\\2', 'g')"
    return f"""
        {values('entry', ('ord', 'id', 'term', 'key', 'category', 'subcategory', 'confidence', 'severity', 'strength', 'life', 'hard', 'hint', 'note', 'custom'), kept)},
        {values('form', ('token', 'ord', 'may_be_name'), forms)}, {values('quiet', ('register', 'what'), off)},
        tk AS (SELECT doc_id, register, unnest(regexp_extract_all({marked}, '{words}|' || chr(30) || '{words}')) AS w, generate_subscripts(regexp_extract_all({marked}, '{words}|' || chr(30) || '{words}'), 1) AS nth FROM {rows}),
        hit AS (SELECT doc_id, register, ord, count(*) AS k FROM tk JOIN form ON lower(replace(w, chr(30), '')) = token
                WHERE NOT (may_be_name = 1 AND nth > 1 AND regexp_matches(w, '^[A-Z]')) GROUP BY ALL
                UNION ALL {' UNION ALL '.join(per)}),
        found AS (
            SELECT doc_id, hit.register, hit.ord, entry.* EXCLUDE (ord), k AS count, confidence = 'red' OR k >= 2 AS scored
            FROM hit JOIN entry USING (ord) LEFT JOIN (SELECT key AS own FROM entry WHERE custom = 1) c ON own = key AND custom = 0
            LEFT JOIN (SELECT key AS red, term AS rterm, id AS rid FROM entry WHERE custom = 0 AND confidence = 'red') b ON red = key AND custom = 1
            WHERE k > 0 AND NOT EXISTS (SELECT 1 FROM quiet WHERE quiet.register = hit.register AND custom = 0 AND (what = key OR what = id))
              AND (own IS NULL OR confidence = 'red')
              AND (red IS NULL OR EXISTS (SELECT 1 FROM quiet WHERE quiet.register = hit.register AND (what = red OR what = rid))))"""


def audit_sql(lexicon: L.Lexicon, source: str, paragraph: str = r"\n\s*\n") -> str:
    """The audit of ``source`` (doc_id, register, text), a result row a document, from the rules alone."""
    pars = PARS.replace(r"'\n'", lit(paragraph))
    piece, flags = PIECE.replace(PARS.format("text"), pars.format("text")), FLAGS_SQL.replace(DOCS, "").replace(PARS.format("text"), pars.format("text"))
    text = blanked(blanked("coalesce(text, '')", r"(?s)```.*?```|~~~.*?~~~"), r"`[^`\n]+`")
    weight = " ".join(f"WHEN {lit(k)} THEN {v}" for k, v in V.RHYTHM_WEIGHT.items())
    long = f"total_words >= {V.STRUCTURE_WORDS}"
    announced = f"len(list_filter(ps, lambda p: len(p) = 1 AND {WS.format('p[1]')} <= {V.ENUMERATION_WORDS} AND regexp_matches(p[1], {lit(V.ENUMERATION)}) AND regexp_matches(p[1], {lit(V.SELF_REFERENCE)}))) > 0"
    ordinal = f"len(list_filter(range(1, len(ps) + 1), lambda i: regexp_matches(({pars.format('text')})[i], {lit(V.ORDINAL_OPENER)}) OR coalesce(regexp_matches(ps[i][1], {lit(V.LABEL_FRAGMENT)}), false)))"
    summary = " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in V.TIER_SUMMARY.items())
    strong = [f"specificity >= {V.STRONG_SPECIFICITY}", f"concrete_abstract >= {V.STRONG_RATIO}", f"burstiness >= {V.STRONG_BURSTINESS}::DOUBLE"]
    notes = ", ".join(f"CASE WHEN {c} THEN {lit(t)} END" for c, t in zip(strong, V.STRENGTH_NOTES, strict=True))
    little = lit(V.LITTLE_TEXT).replace("%d", "' || word_count || '").replace("%s", "' || CASE WHEN word_count = 1 THEN '' ELSE 's' END || '")
    return f"""
        d AS (SELECT doc_id, register, {text} AS text FROM ({source})), {flags.strip().lstrip(',')},
        {STRENGTHS_SQL}, {counts_sql(lexicon)},
        s AS (SELECT doc_id, sum(strength * (1 + least(count - 1, 4) * 0.5::DOUBLE) * life::DOUBLE) AS weighted_sum, max(hard) = 1 AS evidence FROM found WHERE scored GROUP BY doc_id),
        beat AS (SELECT *, {long} AND {announced} AS announced_enumeration, {ordinal} AS ordinal_paragraphs,
                        {long} AND coalesce(register NOT IN {in_list(V.ORDINAL_SUPPRESSED)}, true) AND {ordinal} >= {V.SCAFFOLD_PARAGRAPHS} AS ordinal_scaffold FROM flags),
        j AS (SELECT beat.doc_id, beat.register, {WS.format('beat.text')} AS word_count, specificity, concrete_abstract, burstiness, strong_signals, coalesce(weighted_sum, 0)::DOUBLE AS ws, coalesce(evidence, false) AS evidence,
                     uniform_paragraphs::INT + low_burstiness::INT + register_drift::INT + announced_enumeration::INT + ordinal_scaffold::INT AS beats
              FROM beat JOIN strong USING (doc_id) LEFT JOIN s USING (doc_id)),
        e AS (SELECT *, ws / ((word_count + 1500) / 1000.0::DOUBLE) AS density FROM j),
        f AS (SELECT *, CASE WHEN word_count = 0 THEN 0 ELSE least(100, CASE WHEN ws > 0 THEN floor(100 * density / (density + 100) + 0.5)::INT ELSE 0 END + beats * CASE register {weight} ELSE {V.DEFAULT_RHYTHM_WEIGHT} END) END::INT AS score FROM e),
        g AS (SELECT *, CASE WHEN strong_signals >= 2 AND NOT evidence AND score >= {V.TIER_BOUNDS[1]} THEN 'yellow' ELSE {TIER} END AS tier FROM f),
        audited AS (SELECT doc_id, coalesce(register, 'general') AS register, score, tier, word_count::BIGINT AS word_count, CASE WHEN word_count > 0 THEN specificity ELSE 0 END::DOUBLE AS specificity,
               CASE WHEN word_count > 0 THEN concrete_abstract ELSE 0 END::DOUBLE AS concrete_abstract, CASE WHEN word_count > 0 THEN burstiness ELSE 0 END::DOUBLE AS burstiness,
               CASE WHEN word_count = 0 THEN []::VARCHAR[] WHEN word_count < {V.RELIABLE_WORDS} THEN [{little}] ELSE list_filter([{notes}], lambda x: x IS NOT NULL) END AS notes,
               CASE WHEN word_count = 0 THEN 'Empty input.' ELSE CASE tier {summary} END END AS summary FROM g)"""


def builtin(banned=(), allowed=()) -> L.Lexicon:
    return L.Lexicon.of(L.builtin_entries(), banned, allowed)


AUDIT_TEXTS = [
    (1, None, "We leverage robust, robust tools. Nothing else here."), (2, "docs", "In order to build a framework, a framework must validate its framework."), (3, None, "In order to build a framework, a framework must validate its framework."),
    (4, "essay", "We evaluate and evaluate, and the matrix propagates. The matrix stays."), (5, None, "We met at Neon. The neon glow and the neon sign."), (6, None, "It is worth noting that ropes fray. It is worth noting twice."),
    (7, "docs", "# Title\n\nSome **bold words** here and `leverage` there."), (8, None, "# Title\n\nSome **bold words** and **more bold**."), (9, None, "Diving is fun; we dive and dived."), (10, None, "   "),
]


def audit_texts(spark) -> DataFrame:
    return spark.createDataFrame(AUDIT_TEXTS, "doc_id long, register string, text string")


def _texts_sql(ids: str) -> str:
    return f"SELECT doc_id::BIGINT AS doc_id, register, text FROM tx WHERE doc_id IN ({ids})"


def _found_sql(lexicon: L.Lexicon, ids: str) -> str:
    return "WITH " + values("tx", ("doc_id", "register", "text"), AUDIT_TEXTS) + f", d AS ({_texts_sql(ids)}), {counts_sql(lexicon)}"


CUSTOM = (["Robust", "LEVERAGE", "tools"], ["Tools"])


@query(_found_sql(builtin(), "2, 3, 4") + " SELECT doc_id, term, count AS matches FROM found")
def register_suppression(spark, sf_dir):
    found = L.findings(audit_texts(spark).filter("doc_id IN (2, 3, 4)"), builtin(), register_col="register")
    return found.select("doc_id", "term", F.col("count").alias("matches"))


@query(_found_sql(builtin(*CUSTOM), "1, 3") + " SELECT doc_id, term, confidence, category, count AS matches FROM found")
def custom_upgrade(spark, sf_dir):
    found = L.findings(audit_texts(spark).filter("doc_id IN (1, 3)"), builtin(*CUSTOM))
    return found.select("doc_id", "term", "confidence", "category", F.col("count").alias("matches"))


@query(_found_sql(builtin(), "6") + ", m AS (SELECT doc_id, lower(term) AS term, string_agg(DISTINCT subcategory, ', ' ORDER BY subcategory) AS subcategory, min(count) AS findings FROM found GROUP BY ALL) SELECT doc_id, term, subcategory, findings FROM m")
def duplicate_span_merge(spark, sf_dir):
    d = audit_texts(spark).filter("doc_id = 6")
    found = L.with_spans(L.findings(d, builtin()), d)
    return LI.merge_duplicate_spans(found).select("doc_id", "term", "subcategory", F.size("matches").cast("long").alias("findings"))


SCOPE_WORDS = [("global", 0, "Rope"), ("global", 1, " tar "), ("global", 2, "ROPE"), ("style-a", 0, "rope"), ("style-a", 1, "Eel"), ("style-a", 2, "  "), ("style-b", 0, "cod"), ("style-b", 1, "TAR")]


@query(
    "WITH " + values("w", ("scope", "ord", "word"), SCOPE_WORDS)
    + """, m AS (SELECT s.scope AS style, w.scope <> 'global' AS own, ord, trim(word) AS word FROM (SELECT DISTINCT scope FROM w WHERE scope <> 'global') s JOIN w ON w.scope IN ('global', s.scope) WHERE trim(word) <> ''),
    k AS (SELECT *, row_number() OVER (PARTITION BY style, lower(word) ORDER BY own, ord) AS k FROM m)
    SELECT style, row_number() OVER (PARTITION BY style ORDER BY own, ord)::INT AS nth, word FROM k WHERE k = 1"""
)
def dictionary_scope_merge(spark, sf_dir):
    return L.merged_scopes(spark.createDataFrame(SCOPE_WORDS, "scope string, ord int, word string"))


MIXED = f"""
    {TOKENS}, {NAMES},
    x(ord, term, category, confidence) AS (VALUES (0, 'ertion', 'noun', 'orange'), (1, 'rely', 'verb', 'red'), (2, 'with', 'filler', 'orange'), (3, 'the', 'filler', 'yellow'), (4, 'that', 'phrase', 'orange')),
    c AS (SELECT doc_id, token, count(*) AS k FROM t SEMI JOIN x ON term = token GROUP BY ALL), m AS (SELECT doc_id, token, count(*) AS k FROM n SEMI JOIN x ON term = token GROUP BY ALL),
    found AS (SELECT c.doc_id, ord, term, category, confidence, c.k - coalesce(m.k, 0) AS count, confidence = 'red' OR c.k - coalesce(m.k, 0) >= 2 AS scored
              FROM c LEFT JOIN m USING (doc_id, token) JOIN x ON term = c.token WHERE c.k > coalesce(m.k, 0))"""
MIXED_ENTRIES = [
    L.Entry(0, "ertion", "noun", "own", "orange", 45, pattern=None), L.Entry(1, "rely", "verb", "own", "red", 80), L.Entry(2, "with", "filler", "own", "orange", 45), L.Entry(3, "the", "filler", "own", "yellow", 30), L.Entry(4, "that", "phrase", "own", "orange", 45),
]


def mixed_findings(spark, sf_dir) -> DataFrame:
    """Without inflection: every form that the rules make is a term of its own that is never looked for."""
    lexicon = L.Lexicon(tuple(MIXED_ENTRIES), frozenset(f for e in MIXED_ENTRIES for f in L.inflections(e.term)))
    return L.findings(documents(spark, sf_dir), lexicon)


@query(f"WITH {MIXED} SELECT doc_id, category, sum(count)::BIGINT AS total FROM found GROUP BY ALL")
def category_breakdown(spark, sf_dir):
    return A.category_breakdown(mixed_findings(spark, sf_dir))


@query(f"WITH {MIXED}, o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY scored DESC, count DESC, ord) AS nth FROM found) SELECT doc_id, term, count, nth FROM o WHERE nth <= 3")
def finding_order_topk(spark, sf_dir):
    return LI.finding_order(mixed_findings(spark, sf_dir)).filter("nth <= 3").select("doc_id", "term", "count", "nth")


@query(f"""
    WITH {MIXED}, g AS (SELECT *, 'Vocabulary and phrasing' AS grp FROM found WHERE scored),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY count DESC, term) AS nth, count(*) OVER (PARTITION BY doc_id) AS k FROM g)
    SELECT doc_id, grp, term, nth, greatest(0, k - 2)::BIGINT AS omitted FROM r WHERE nth <= 2
""")
def lint_groups(spark, sf_dir):
    return LI.grouped(mixed_findings(spark, sf_dir), cap=2).select("doc_id", "grp", "term", "nth", F.col("omitted").cast("long").alias("omitted"))


GROUPED_ENTRIES = [
    L.Entry(0, "ertion", "Formatting tells", "a", "orange", 45), L.Entry(1, "rely", "verb", "b", "red", 80), L.Entry(2, "with", "Whole-piece rhythm", "c", "orange", 45), L.Entry(3, "the", "filler", "d", "red", 30), L.Entry(4, "that", "Formatting tells", "e", "red", 45),
]


@query(f"""
    WITH {TOKENS}, {NAMES}, {values('x', ('ord', 'term', 'category', 'confidence', 'sev'), [(e.ord, e.term, e.category, e.confidence, {'red': 1, 'orange': 2}[e.confidence]) for e in GROUPED_ENTRIES])},
    c AS (SELECT doc_id, token, count(*) AS k FROM t SEMI JOIN x ON term = token GROUP BY ALL), m AS (SELECT doc_id, token, count(*) AS k FROM n SEMI JOIN x ON term = token GROUP BY ALL),
    f AS (SELECT c.doc_id, x.*, c.k - coalesce(m.k, 0) AS count, category IN {in_list(V.LEXICAL_CATEGORIES)} AS lexical FROM c LEFT JOIN m USING (doc_id, token) JOIN x ON term = c.token
          WHERE c.k > coalesce(m.k, 0) AND (confidence = 'red' OR c.k - coalesce(m.k, 0) >= 2)),
    g AS (SELECT *, CASE WHEN lexical THEN {lit(V.LEXICAL_GROUP)} ELSE category END AS grp FROM f),
    h AS (SELECT doc_id, grp, sum(count) AS total, min(ord) AS first FROM g GROUP BY ALL),
    o AS (SELECT doc_id, grp, row_number() OVER (PARTITION BY doc_id ORDER BY NOT regexp_matches(grp, '(?i)rhythm|structural'), total DESC, first) AS group_nth FROM h)
    SELECT doc_id, grp, group_nth::INT AS group_nth, term, CASE sev WHEN 1 THEN 'high' ELSE 'medium' END AS severity,
           row_number() OVER (PARTITION BY doc_id, grp ORDER BY CASE WHEN lexical THEN 0 ELSE sev END, count DESC, CASE WHEN lexical THEN term END, ord)::INT AS nth
    FROM g JOIN o USING (doc_id, grp)
""")
def lint_group_order(spark, sf_dir):
    lexicon = L.Lexicon(tuple(GROUPED_ENTRIES), frozenset(f for e in GROUPED_ENTRIES for f in L.inflections(e.term)))
    return LI.grouped(L.findings(documents(spark, sf_dir), lexicon), cap=None).select("doc_id", "grp", "group_nth", "term", "severity", "nth")


@query(f"""
    WITH {user_sums(BANNED_KEYS)}, z AS (SELECT *, {TIER} AS tier FROM r)
    SELECT regexp_extract(source, 'src.*') AS source, count(*) AS files, count(*) FILTER (tier IN ('orange', 'red')) AS failing, max(score) AS worst FROM z JOIN documents USING (doc_id) GROUP BY ALL
""")
def lint_threshold_report(spark, sf_dir):
    d = documents(spark, sf_dir)
    scored = A.lexical_scores(d, user_lexicon()).join(d.select("doc_id", "source"), "doc_id")
    bad = (A.tier_rank(F.col("tier")) >= V.TIERS.index("orange")).cast("long")
    return scored.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum(bad).alias("failing"), F.max("score").alias("worst"))


FACT_TEXTS = [(1, "The crew mended seven nets. Nobody slept through the storm."), (2, "The crew mended seven nets in 1999."), (3, "Quiet day.")]
FACTS = [(1, "crew mended nets"), (1, "storm kept nobody asleep"), (2, "crew mended nets"), (2, "  "), (3, "crew mended nets")]


@query(
    "WITH " + values("x", ("doc_id", "total_facts", "used_facts", "plain", "quota"), [(1, 2, 2, 1, 1), (2, 1, 1, 0, 0), (3, 1, 0, 0, 0)])
    + " SELECT doc_id::BIGINT AS doc_id, total_facts::BIGINT AS total_facts, used_facts::BIGINT AS used_facts, plain = 1 AS plain_use, quota = 1 AS meets_quota FROM x"
)
def elicited_material(spark, sf_dir):
    docs, facts = spark.createDataFrame(FACT_TEXTS, "doc_id long, text string"), spark.createDataFrame(FACTS, "doc_id long, fact string")
    return FA.fact_usage(docs, facts).select("doc_id", "total_facts", "used_facts", "plain_use", "meets_quota")


AUDIT_COLUMNS = "doc_id, register, score, tier, word_count, specificity, concrete_abstract, burstiness, notes, summary"


@query(f"WITH {DOCS.replace('d AS', 'src AS', 1)}, {audit_sql(builtin(BANNED, ALLOWED), 'SELECT doc_id, register, text FROM src', LINES)} SELECT {AUDIT_COLUMNS} FROM audited")
def full_audit(spark, sf_dir):
    """Score, tier, strengths and what is said of them, with the built-in lexicon and a user's dictionary."""
    results, _ = A.audit(documents(spark, sf_dir), builtin(BANNED, ALLOWED), paragraph=LINES)
    return results


_LONG = "Harbour crews count crates by hand before dawn, and nobody asks why. The tide turns. Ropes, nets, tar and eels wait on the quay while the clerk writes 17 names in 3 ledgers for Anna Berg of Bergen. "
#: Texts for the rules that prose rarely meets: hard evidence, caps, bonuses of rhythm and enumerations, code, little text.
RULE_TEXTS = [
    *AUDIT_TEXTS, (11, None, _LONG * 9 + "See https://a.example/?utm_source=chatgpt.com now, and leverage it."), (12, None, _LONG * 9 + "We leverage, leverage and leverage it. It is worth noting. Let me walk you through it."),
    (13, "blog", "\n\n".join([_PAD] * 5)), (14, "essay", "\n\n".join(["There are three reasons below.", _PAD, "First, the boats left.", _PAD, "Second, they came.", _PAD])), (15, "docs", "One word" ), (16, "memo", "First, a.\n\n" + _PAD + "\n\nSecond, b."),
    (17, None, "First, a.\n\n" + _PAD + "\n\nSecond, b.\n\nFinally, leverage and streamline; dive, dive, dive. As an AI language model I cannot provide legal advice. [Your Name] oai_citation"),
    (18, "general", "~~~\nleverage\n~~~ It's not just a boat, it's a home. No wind. No waves. No boats. `dive` in\n```\nNeon\n"), (19, "email", "x"),
]


def rule_texts(spark) -> DataFrame:
    return spark.createDataFrame(RULE_TEXTS, "doc_id long, register string, text string")


@query("WITH " + values("src", ("doc_id", "register", "text"), RULE_TEXTS) + f", {audit_sql(builtin(), 'SELECT doc_id::BIGINT AS doc_id, register, text FROM src')} SELECT {AUDIT_COLUMNS} FROM audited")
def audit_fixtures(spark, sf_dir):
    results, _ = A.audit(rule_texts(spark), builtin())
    return results


@query(
    "WITH " + values("src", ("doc_id", "register", "text"), RULE_TEXTS) + f", {audit_sql(builtin(), 'SELECT doc_id::BIGINT AS doc_id, register, text FROM src')} "
    "SELECT doc_id, ord, term, category, subcategory, confidence, severity, count, scored, hint, note FROM found"
)
def audit_findings(spark, sf_dir):
    _, found = A.audit(rule_texts(spark), builtin())
    return found.filter("ord < 100000")


def _detail_sql(flag: str, *cols: str) -> str:
    out = lit(V.RHYTHM_DETAILS[flag])
    for c in cols:
        out = out.replace("{}", f"' || {c} || '", 1)
    return out


_DETAILS = {
    "uniform_paragraphs": ("paragraph_count",), "low_burstiness": ("piece_sentences", "floor(avg_sentence_words + 0.5)::BIGINT"), "register_drift": ("register",), "announced_enumeration": (), "ordinal_scaffold": ("ordinal_paragraphs",),
}


def rhythm_rows_sql(source: str, paragraph: str) -> str:
    rows = [f"SELECT doc_id, {lit(i)} AS finding_id, {lit(n)} AS name, {lit(c)} AS confidence, {lit(v)} AS severity, {_detail_sql(k, *_DETAILS[k])} AS note FROM beat WHERE {k}" for k, (i, n, c, v) in V.RHYTHM_FINDINGS.items()]
    return f"{audit_sql(builtin(), source, paragraph)} {' UNION ALL '.join(rows)}"


@query("WITH " + values("src", ("doc_id", "register", "text"), RULE_TEXTS) + ", " + rhythm_rows_sql("SELECT doc_id::BIGINT AS doc_id, register, text FROM src", r"\n\s*\n"))
def rhythm_finding_fixtures(spark, sf_dir):
    return R.rhythm_findings(rule_texts(spark).withColumn("text", X.strip_code(F.col("text"))))


@query(f"WITH {DOCS.replace('d AS', 'src AS', 1)}, " + rhythm_rows_sql("SELECT doc_id, register, text FROM src", LINES))
def rhythm_finding_rows(spark, sf_dir):
    return R.rhythm_findings(documents(spark, sf_dir), paragraph=LINES)


# --- voices ---
def voice_samples(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("voice"), "doc_id", "text")


MERGED = (
    f"{stats_sql('documents', 'doc_id, source AS voice')}, merged AS (SELECT voice, count(*) AS sample_count, sum(word_count)::BIGINT AS word_count, sum(sentence_count)::BIGINT AS sentence_count, "
    + ", ".join(f"{rounded(f'sum({c} * word_count::DOUBLE) / sum(word_count)', n)} AS {c}" for c, n in S.NUMERIC.items())
    + " FROM st GROUP BY voice)"
).replace("regexp_split_to_array(text, '\\n')", "regexp_split_to_array(text, '\\n\\s*\\n')")


def merged_voices(spark, sf_dir) -> DataFrame:
    return VO.train_voices(voice_samples(spark, sf_dir))


def _clamp_sql(x: str, lo: float, hi: float) -> str:
    return f"greatest({lo}::DOUBLE, least({hi}::DOUBLE, {x}))"


def _dial_sql(name: str) -> str:
    c, lo, hi, _ = V.DIALS[name]
    t = _clamp_sql(f"({c} - {lo}::DOUBLE) / ({hi}::DOUBLE - {lo}::DOUBLE)", 0, 1)
    return f"floor({t} * 100 + 0.5)::INT"


PERSONA_SQL = ", ".join(
    f"floor({_clamp_sql(x, 0, 10)} + 0.5)::INT AS {k}"
    for k, x in {
        "formality": f"(({_clamp_sql('10 - contraction_rate * 4', 0, 10)}) + ({_clamp_sql('(avg_word_length - 4) * 5', 0, 10)})) / 2", "warmth": "relational_pronoun_rate / 40 * 10",
        "directness": f"({_clamp_sql('10 - (avg_sentence_length - 8) / 22 * 10', 0, 10)}) * 0.7::DOUBLE + ({_clamp_sql('fragment_rate / 0.15::DOUBLE * 10', 0, 10)}) * 0.3::DOUBLE",
    }.items()
)


@query(f"WITH {MERGED} SELECT * FROM merged")
def train_voices(spark, sf_dir):
    return merged_voices(spark, sf_dir).drop("formality", "warmth", "directness")


@query(f"WITH {MERGED} SELECT voice, {PERSONA_SQL} FROM merged")
def persona_dials(spark, sf_dir):
    return merged_voices(spark, sf_dir).select("voice", "formality", "warmth", "directness")


@query(f"WITH {MERGED} SELECT voice, {', '.join(f'{_dial_sql(k)} AS {k}' for k in V.DIALS)} FROM merged")
def stats_to_dials(spark, sf_dir):
    m = merged_voices(spark, sf_dir)
    return m.select("voice", *VO.stats_to_dials(m))


DIAL_ROWS = [(1, 0, 0, 0, 0, 0, 0, 0, 0), (2, 100, 100, 100, 100, 100, 100, 100, 100), (3, 50, 25, 75, 60, 10, 20, 30, 40), (4, -5, 120, 33, 66, 1, 99, 12, 55)]


@query(
    "WITH " + values("x", ("dial_id", *V.DIALS), DIAL_ROWS) + " SELECT dial_id::BIGINT AS dial_id, "
    + ", ".join(f"{rounded(f'{lo}::DOUBLE + greatest(0, least(100, {k}))::DOUBLE / 100 * ({hi}::DOUBLE - {lo}::DOUBLE)', 3)} AS {c}" for k, (c, lo, hi, _) in V.DIALS.items()) + " FROM x"
)
def dials_to_stats(spark, sf_dir):
    return spark.createDataFrame(DIAL_ROWS, "dial_id long, " + ", ".join(f"{k} int" for k in V.DIALS)).select("dial_id", *VO.dials_to_stats())


def _guide_sql() -> str:
    t = {k: lit(v) for k, v in V.STATS_LINES.items()}
    return f"""concat_ws(' ',
        CASE WHEN avg_sentence_length >= 20 THEN {t['long']} WHEN avg_sentence_length <= 12 THEN {t['short']} ELSE {t['middle']} END, CASE WHEN sentence_length_sd >= 8 THEN {t['varied']} ELSE {t['steady']} END,
        CASE WHEN paragraph_length_cv >= 0.5::DOUBLE THEN {t['uneven']} ELSE {t['even']} END,
        CASE WHEN contraction_rate >= 1.5::DOUBLE THEN {t['contractions']} WHEN contraction_rate <= 0.3::DOUBLE THEN {t['no contractions']} ELSE {t['some contractions']} END,
        CASE WHEN em_dash_per_1000 >= 3 THEN {t['dashes']} ELSE {t['no dashes']} END, CASE WHEN fragment_rate >= 0.08::DOUBLE THEN {t['fragments']} END, CASE WHEN question_rate >= 0.05::DOUBLE THEN {t['questions']} END,
        CASE WHEN structural_entropy < 0.33::DOUBLE THEN {lit(V.ENTROPY_LINES[0])} WHEN structural_entropy < 0.54::DOUBLE THEN {lit(V.ENTROPY_LINES[1])} ELSE {lit(V.ENTROPY_LINES[2])} END)"""


def _persona_guide_sql() -> str:
    return "concat_ws(' ', " + ", ".join(f"CASE WHEN {k} <= 3 THEN {lit(a)} WHEN {k} <= 6 THEN {lit(b)} ELSE {lit(c)} END" for k, (a, b, c) in V.PERSONA_LINES.items()) + ")"


@query(f"WITH {MERGED}, p AS (SELECT *, {PERSONA_SQL} FROM merged) SELECT voice, {_guide_sql()} AS stats_guide, {_persona_guide_sql()} AS persona_guide FROM p")
def style_guide_text(spark, sf_dir):
    return merged_voices(spark, sf_dir).select("voice", VO.stats_guide(F.col("sample_count")).alias("stats_guide"), VO.persona_guide().alias("persona_guide"))


@query(f"""
    WITH {TOP_WORDS}, top AS (SELECT source AS voice, doc_id, token, rank FROM top_words JOIN documents USING (doc_id) WHERE rank <= 8),
    g AS (SELECT voice, token, count(*) AS samples, min({{'a': doc_id, 'b': rank}}) AS first FROM top GROUP BY ALL),
    r AS (SELECT voice, token, samples, row_number() OVER (PARTITION BY voice ORDER BY samples DESC, first) AS rank FROM g)
    SELECT * FROM r WHERE rank <= 10
""")
def merge_presence(spark, sf_dir):
    d = voice_samples(spark, sf_dir)
    ranked = S.top_words(d).join(d.select("doc_id", "voice"), "doc_id")
    return S.merge_by_presence(ranked, "voice", "doc_id")


def _merged_tops(name: str, top: str) -> str:
    """CTEs that end in ``name`` (voice, tokens): the first tokens of each voice by the samples that have them."""
    return (
        f"{name}_g AS (SELECT source AS voice, token, count(*) AS samples, min({{'a': doc_id, 'b': rank}}) AS first FROM {top} JOIN documents USING (doc_id) WHERE rank <= 8 GROUP BY ALL), "
        f"{name}_r AS (SELECT *, row_number() OVER (PARTITION BY voice ORDER BY samples DESC, first) AS rank FROM {name}_g), {name} AS (SELECT voice, list(token ORDER BY rank) AS tokens FROM {name}_r WHERE rank <= 10 GROUP BY voice)"
    )


@query(
    f"WITH {MERGED}, {TOP_WORDS}, {BIGRAMS}, {_merged_tops('tw', 'top_words')}, {_merged_tops('tb', 'top_bigrams')}, "
    "q AS (SELECT merged.*, coalesce(tw.tokens, []) AS words, coalesce(tb.tokens, []) AS bigrams FROM merged LEFT JOIN tw USING (voice) LEFT JOIN tb USING (voice)) SELECT voice, "
    + _guide_sql().replace(
        "CASE WHEN structural_entropy < 0.33",
        "CASE WHEN len(bigrams) > 0 THEN 'Recurring phrasing across samples: ' || array_to_string(bigrams[1:5], ', ') || '.' END, "
        "CASE WHEN len(words) > 0 AND sample_count >= 3 THEN 'Distinctive word choices, reached for more than a generic baseline would predict: ' || array_to_string(words[1:5], ', ') || '.' END, CASE WHEN structural_entropy < 0.33",
    )
    + " AS guide FROM q"
)
def style_guide_words(spark, sf_dir):
    d = voice_samples(spark, sf_dir)
    out = merged_voices(spark, sf_dir)
    for name, top in (("words", S.top_words(d)), ("bigrams", S.top_bigrams(d))):
        merged = S.merge_by_presence(top.join(d.select("doc_id", "voice"), "doc_id"), "voice", "doc_id")
        out = out.join(S.as_list(merged, "voice", name), "voice", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out.select("voice", VO.stats_guide(F.col("sample_count"), F.col("bigrams"), F.col("words")).alias("guide"))


DRAFTS = "drafts AS (SELECT item_id AS draft_id, 'src' || (item_id % 20) AS voice, text FROM benchmark)"


def drafts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("draft_id"), F.concat(F.lit("src"), F.col("item_id") % 20).alias("voice"), "text")


def _delta_sql() -> str:
    draft = stats_sql("drafts", "draft_id, voice").replace("'\\n')", "'\\n\\s*\\n')")
    for cte in ("a", "b", "c", "st"):
        draft = re.sub(rf"\b{cte} AS \(", f"x{cte} AS (", draft)
    draft = draft.replace("FROM a)", "FROM xa)").replace("FROM b)", "FROM xb)").replace("FROM c)", "FROM xc)")
    dials = ", ".join(f"{_dial_sql(k)} AS {k}" for k in V.DIALS)
    names = ", ".join(lit(k) for k in V.DIALS)
    listed = ", ".join(f"{k}" for k in V.DIALS)
    return f"""{MERGED}, {DRAFTS}, {draft}, target AS (SELECT voice, {dials} FROM merged), actual AS (SELECT draft_id, voice, word_count, {dials} FROM xst),
        tl AS (SELECT voice, unnest([{names}]) AS dial, unnest([{listed}]) AS target FROM target), al AS (SELECT draft_id, voice, word_count, unnest([{names}]) AS dial, unnest([{listed}]) AS actual FROM actual),
        deltas AS (SELECT draft_id, voice, word_count, dial, target, actual, abs(actual - target) AS delta FROM al JOIN tl USING (voice, dial))"""


@query(f"""
    WITH {_delta_sql()}, g AS (SELECT draft_id, voice, avg(delta)::DOUBLE AS a, max(delta) AS m, any_value(word_count) AS w, count(*) FILTER (delta >= 25) AS off_dials FROM deltas GROUP BY ALL)
    SELECT draft_id, voice, greatest(0, floor(100 - a + 0.5))::INT AS match_score, CASE WHEN a >= 35 OR m >= 50 THEN 'off rhythm' WHEN a >= 15 OR m >= 25 THEN 'some drift' ELSE 'on rhythm' END AS verdict,
           CASE WHEN w < 50 THEN 'low' ELSE 'normal' END AS confidence, off_dials FROM g
""")
def voice_match(spark, sf_dir):
    return VO.voice_match(VO.dial_deltas(drafts(spark, sf_dir), merged_voices(spark, sf_dir)))


@query(f"WITH {_delta_sql()} SELECT draft_id, voice, dial, target, actual, delta FROM deltas WHERE delta >= 25")
def voice_drift(spark, sf_dir):
    return VO.drift_findings(VO.dial_deltas(drafts(spark, sf_dir), merged_voices(spark, sf_dir))).select("draft_id", "voice", "dial", "target", "actual", "delta")


HISTORY = """hist AS (SELECT source AS voice, doc_id, text, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS nth FROM documents),
    h AS (SELECT voice, doc_id, nth, array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z'']+')[1:6], lambda x: lower(x)), ' ') AS opener FROM hist WHERE nth <= 20)"""


@query(f"WITH {HISTORY} SELECT * FROM h")
def history_cap(spark, sf_dir):
    return VO.fingerprints(voice_samples(spark, sf_dir)).select("voice", "doc_id", "nth", "opener")


#: Samples of voices that repeat themselves, beside the documents, whose voices hardly do.
PLANTED = [
    (10_000_001 + k, "planted", f"{opener} and {'red rope ' * 3}holds {'tar barrel ' * (2 if k % 2 else 0)}today, as number {k} says.")
    for k, opener in enumerate(["The crew mended the nets"] * 3 + ["Nobody saw the boats leave", "A quiet day at sea", "The crew mended the nets", "Rain fell on the quay"])
] + [(10_000_101 + k, "short", f"One red rope red rope {k}.") for k in range(2)]


def _planted_sql(sql: str) -> str:
    return values("planted", ("doc_id", "source", "text"), PLANTED) + ", docs2 AS (SELECT doc_id, source, text FROM documents UNION ALL SELECT doc_id, source, text FROM planted), " + sql.replace("FROM documents", "FROM docs2")


@query("WITH " + _planted_sql(f"""
    {BIGRAMS}, {HISTORY}, total AS (SELECT voice, count(*) AS total FROM h GROUP BY voice HAVING count(*) >= 3),
    dr AS (SELECT doc_id AS draft_id, source AS voice,
                  array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z'']+')[1:6], lambda x: lower(x)), ' ') AS opener FROM documents),
    oh AS (SELECT voice, opener, count(*) AS matches FROM h GROUP BY ALL),
    ph AS (SELECT voice, token, count(*) AS matches FROM h JOIN (SELECT * FROM top_bigrams WHERE rank <= 8) USING (doc_id) GROUP BY ALL),
    f AS (SELECT draft_id, voice, 'opener' AS kind, opener AS term, matches, 0.4::DOUBLE AS bar FROM dr JOIN oh USING (voice, opener) WHERE opener <> ''
          UNION ALL SELECT draft_id, voice, 'phrase', token, matches, 0.3::DOUBLE FROM dr JOIN (SELECT doc_id AS draft_id, token FROM top_bigrams WHERE rank <= 8) USING (draft_id) JOIN ph USING (voice, token))
    SELECT draft_id, voice, kind, term, matches, total FROM f JOIN total USING (voice) WHERE matches::DOUBLE / total >= bar
"""))
def self_repetition(spark, sf_dir):
    planted = spark.createDataFrame(PLANTED, "doc_id long, voice string, text string")
    d = voice_samples(spark, sf_dir).select("doc_id", "voice", "text").unionByName(planted)
    return VO.self_repetition(d.withColumnRenamed("doc_id", "draft_id"), VO.fingerprints(d))


# --- the rest ---
RAW_TEXTS = [(1, "\x1b[31mred\x1b[0m rope"), (2, "\x1b]0;title\x07tar\ttab\nline\r"), (3, "bell\x07 nul\x7f \x85end é"), (4, "plain")]


@query("WITH " + values("x", ("text_id", "clean"), [(1, "red rope"), (2, "tar\ttab\nline\r"), (3, "bell nul end é"), (4, "plain")]) + " SELECT text_id::BIGINT AS text_id, clean FROM x")
def sanitize_text(spark, sf_dir):
    return spark.createDataFrame(RAW_TEXTS, "text_id long, raw string").select("text_id", X.sanitize(F.col("raw")).alias("clean"))


AUC = f"""
    {DOCS}, {user_sums(BANNED_KEYS)}, sc AS (SELECT coalesce(register, 'general') AS register, quality, weighted_sum AS score FROM r JOIN d USING (doc_id) JOIN labels USING (doc_id)),
    bs AS (SELECT register, score, count(*) FILTER (quality = 1) AS pos, count(*) FILTER (quality = 0) AS neg FROM sc GROUP BY ALL),
    u AS (SELECT *, pos * (2 * coalesce(sum(neg) OVER (PARTITION BY register ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + neg) AS wins2 FROM bs),
    auc AS (SELECT register, sum(pos)::BIGINT AS positives, sum(neg)::BIGINT AS negatives, CASE WHEN sum(pos) * sum(neg) > 0 THEN sum(wins2)::DOUBLE / (2 * sum(pos) * sum(neg))::DOUBLE END AS auc FROM u GROUP BY register)"""


def _auc(spark, sf_dir) -> DataFrame:
    d = documents(spark, sf_dir)
    scored = A.lexical_scores(d, user_lexicon()).join(d.select("doc_id", F.coalesce("register", F.lit("general")).alias("register")), "doc_id").join(table(spark, sf_dir, "labels"), "doc_id")
    return E.auc(scored, "register", "quality", "weighted_sum")


@query(f"WITH {AUC} SELECT * FROM auc")
def auc_by_label(spark, sf_dir):
    return _auc(spark, sf_dir)


@query(f"""
    WITH {AUC}, {values('bl', ('register', 'stored'), list(V.AUC_BASELINE.items()))}
    SELECT register, auc, stored::DOUBLE AS stored, CASE WHEN auc - stored::DOUBLE < -0.0005 THEN 'REGRESSION' WHEN auc - stored::DOUBLE > 0.0005 THEN 'improved' WHEN auc IS NOT NULL THEN 'unchanged' ELSE 'unchanged' END AS status FROM auc JOIN bl USING (register)
""")
def efficacy_regression(spark, sf_dir):
    base = spark.createDataFrame(list(V.AUC_BASELINE.items()), "register string, auc double")
    return E.compare(_auc(spark, sf_dir), base, "register")


@query(r"""
    WITH p AS (SELECT page_id, regexp_replace(url, '^https?://', '') AS path FROM pages)
    SELECT page_id, path, CASE WHEN regexp_matches(path, '(?i)\.mdx?$') THEN 'docs' END AS register FROM p WHERE regexp_matches(path, '^[^/]*\.example\.com/(en|fr)/.*$') OR regexp_matches(path, '^(.*/)?[^/]*\.html$')
""")
def path_globs(spark, sf_dir):
    paths = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("path"))
    hit = FI.match_paths(paths, ["*.example.com/en/**", "*.example.com/fr/**", "**/*.html"])
    return hit.select("page_id", "path", LI.register_for(F.col("path")).alias("register"))
