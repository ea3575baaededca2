"""Each structural pattern on one text that it must match and one that it must not."""

import pytest

from inkmeter.functions import fixed as V
from inkmeter.functions import text as X

CASES = {
    "no-triple": ("No rope. No tar. No nets.", "No rope, no tar. No nets."), "all-none": ("All the rope. None of the tar.", "All the rope and tar."),
    "negative-listing": ("Not a boat. Not an oar. A raft.", "Not a boat, a raft."), "elevation-echo": ("That's not just rope, it's trust.", "It is rope, and it's good."),
    "stop-start": ("Stop rowing. Start sailing.", "Stop rowing and start sailing."), "not-only-but-also": ("not only wet but also cold", "not only wet. but also cold"),
    "at-its-core": ("The craft is at its core slow.", "at the core"), "more-you-less-you": ("The more you haul, the less you drift.", "The more you haul the better."),
    "thats-where-comes-in": ("That's where tar comes in.", "That is where tar comes from."), "not-all-created-equal": ("Not all ropes are created equal.", "All ropes are created equal."),
    "most-people-believe-wrong": ("Most people think so. They're wrong", "Most people think so. They know."), "studies-show-percent": ("studies show that 12% sank", "studies show that some sank"),
    "vague-authority-attribution": ("Reports indicate a leak.", "The report was long."), "participial-tail-abstract": ("It sank, highlighting the leak.", "It sank, and highlighting was gone."),
    "em-dash-rate": ("a — b", "a-b --c"), "title-case-header": ("Mending The Old Nets\n", "Mending the old nets"), "ai-utm-source": ("x?utm_source=openai", "x?utm_source=mail"),
    "ai-citation-markup": ("oai_citation", "citation"), "cutoff-disclaimer": ("As of my last update it floats", "At the last update it floats"), "ai-placeholder": ("[Insert name]", "[sic]"),
    "formulaic-opener": ("in the ever-changing world of rope", "in the world of rope"), "to-name-a-few": ("to name just two", "to name them"), "hedge-stack": ("might well eventually sink", "might sink"),
    "bulleted-bold-term": ("* **Rope** holds", "* rope"), "markdown-heading-leak": ("## Ropes", "no # heading"), "markdown-bold-in-prose": ("a **bold one** b", "a * b * c"),
    "emoji-bullet-scaffolding": ("✨ Shine", "Shine ✨ on"), "category-contrast-positioning": ("Many boats leak. This one floats.", "Many boats leak. That one floats."),
    "narrated-intent-scaffold": ("I will outline it", "I will row it"), "parenthetical-hedge": ("(or more precisely, never so)", "(never so)"),
}


def test_every_pattern_has_a_case():
    assert sorted(CASES) == sorted(p.id for p in V.PATTERNS) and len(V.PATTERNS) == 30


def test_cases(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(k, *v) for k, v in CASES.items()], "id string, yes string, no string")
    cols = [F.struct(F.regexp_count("yes", X.rx(p.regex)).alias("yes"), F.regexp_count("no", X.rx(p.regex)).alias("no")).alias(p.id) for p in V.PATTERNS]
    got = {r["id"]: r[r["id"]] for r in rows.select("id", *cols).collect()}
    wrong = [k for k, v in got.items() if v["yes"] < 1 or v["no"] != 0]
    assert wrong == []


@pytest.mark.parametrize(("pattern", "text", "n"), [(r"\bcaf\b", "café caf", 2), (r"a\sb", "a b", 1), (r"x$", "x\n", 0), (r"(?m)^x$", "x\nx", 2), (r"[\s,]+", "a, b", 1)])
def test_dialect(spark, pattern, text, n):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(text,)], "t string").select(F.regexp_count("t", X.rx(pattern))).head()[0] == n


def test_cases_through_their_literals(spark):
    from pyspark.sql import functions as F

    from inkmeter.operators import lexicon as L

    rows = spark.createDataFrame([(k, *v) for k, v in CASES.items()], "id string, yes string, no string")
    found = lambda c: L.pattern_counts(F.col(c), F.lower(c), [(p.id, p.regex, L.GATES.get(p.id)) for p in V.PATTERNS])
    got = {r["id"]: r for r in rows.select("id", found("yes").key.alias("yes"), found("no").key.alias("no")).collect()}
    assert [k for k, r in got.items() if k not in r["yes"] or k in r["no"]] == []


@pytest.mark.parametrize("text", ["oai_citation", "OAI_Citation", "contentReference[oaicite:1]", "turn0search1", "a citeturn0search2 b"])
def test_citation_markup_needs_no_other_literal(spark, text):
    from pyspark.sql import functions as F

    from inkmeter.operators import lexicon as L

    p = next(p for p in V.PATTERNS if p.id == "ai-citation-markup")
    row = spark.createDataFrame([(text,)], "t string").select(F.regexp_count("t", X.rx(p.regex)).alias("n"), L.pattern_counts(F.col("t"), F.lower("t"), [(p.id, p.regex, L.GATES[p.id])]).alias("found")).head()
    assert sum(f["count"] for f in row["found"]) == row["n"]


def test_long_runs_of_title_words(spark):
    """Java's loops that can be undone recurse: a run of this many words overflowed the stack and took the process with it."""
    from pyspark.sql import functions as F

    texts = ["Nets " * 20_000, "Nets and " * 10_000 + "\nTar", "The of\n" * 5_000 + "Mending The Old Nets"]
    title = next(p.regex for p in V.PATTERNS if p.id == "title-case-header")
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
    assert [r.n for r in rows.select("k", F.regexp_count("t", X.rx(title)).alias("n")).orderBy("k").collect()] == [1, 1, 1]


def test_flat_patterns_match_the_same():
    import random
    import re

    deal = random.Random(7)
    for pattern, flat in X._FLAT.items():
        plain, same, n = re.compile(pattern), re.compile(flat), 0
        for _ in range(20_000):
            text = "".join(deal.choice(["Foo", "Ab", "and", "the", "an", "a", "FooBar", "foo", "X", "of.", "Foo-"]) + deal.choice([" ", " ", "\n", "\n", " \n ", "\n\n", "\t", ""]) for _ in range(deal.randint(1, 12)))
            found = [m.span() for m in plain.finditer(text)]
            assert [m.span() for m in same.finditer(text)] == found
            n += len(found)
        assert n > 100
