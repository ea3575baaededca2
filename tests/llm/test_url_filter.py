import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from inkmeter.llm.queries import RULES
from inkmeter.llm.url_filter import Automaton, filter_urls, globs_of


def as_regex(glob):
    return re.compile("".join({"**": "(?s:.*)", "*": "[^/]*", "?": "(?s:.)"}.get(t, re.escape(t)) for t in re.findall(r"\*\*|.", glob, re.S)) + r"\Z")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab/*?é", min_size=1, max_size=12).filter(lambda g: "***" not in g), min_size=1, max_size=14), st.lists(st.text("ab/éz", max_size=14), max_size=8))
def test_automaton_equals_regular_expressions(globs, texts):
    got = Automaton(globs).match(texts)
    assert got.tolist() == [[as_regex(g).match(t) is not None for g in globs] for t in texts]


def test_many_words_carry_bits():
    random.seed(2)
    globs = ["".join(random.choices("ab", k=random.randint(1, 90))) for _ in range(20)]
    texts = globs + [g[:-1] for g in globs]
    got = Automaton(globs).match(texts)
    assert [[bool(x) for x in row] for row in got] == [[t == g for g in globs] for t in texts]


def test_rules_and_odd_urls(spark):
    urls = {
        1: "http://Blog.Example.com/en/5?x", 2: "https://www.example.com/en/#t", 3: "http://a.net/es/1", 4: "http://net/fr/", 5: "http://a.example.com", 6: None, 7: "no scheme", 8: "ftp://spam-farm.org/x",
        9: "http://notexample.com/en/1", 10: "http://x.y/" + "a" * 50_000, 11: "http://a.example.org/q.com/en/", 12: "", 13: "http://www.example.com/EN/",
    }
    rows = spark.createDataFrame([(k, u, "h") for k, u in urls.items()] + [(1, urls[1], "h")], "page_id long, url string, rule string")
    out = filter_urls(rows, RULES).collect()
    got = {r.page_id: (r.host, r.rule, r.verdict) for r in out}
    assert len(out) == len(urls) + 1
    assert got[1] == ("blog.example.com", "example.com/en/", "block") and got[2] == ("www.example.com", "www.example.com/en/", "allow")
    assert got[3] == ("a.net", "net/es/", "block") and got[4] == ("net", "net/fr/", "block") and got[5] == ("a.example.com", None, "allow")
    assert got[6] == ("", None, "allow") == got[7] == got[12] and got[8] == ("spam-farm.org", None, "block")
    assert got[9] == ("notexample.com", "com/", "allow") and got[10][1:] == (None, "allow") and got[11] == ("a.example.org", None, "allow") and got[13][1] == "com/"
    assert filter_urls(rows.limit(0), RULES).collect() == []


def test_globs_from_a_table(spark):
    table = spark.createDataFrame([(2, "block", "*.org/**"), (1, "allow", "good.org/**"), (3, "deny", "x"), (4, "block", None)], "priority int, verdict string, glob string")
    globs = globs_of(table)
    assert globs == [("allow", "good.org/**"), ("block", "*.org/**")]
    rows = spark.createDataFrame([(1, "http://good.org/a"), (2, "http://bad.org/a"), (3, "http://spam.tv/"), (None, "http://bad.org/")], "page_id long, url string")
    assert {r.page_id: (r.verdict, r.glob) for r in filter_urls(rows, RULES, globs).collect()} == {1: ("allow", "good.org/**"), 2: ("block", "*.org/**"), 3: ("allow", None), None: ("block", "*.org/**")}
