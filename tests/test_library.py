"""Rules that the queries don't reach: empty inputs, stores, configuration, reports, styles, streams."""

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkmeter.api import Prose, parse_public_ref
from inkmeter.functions import fixed as V
from inkmeter.functions import text as X
from inkmeter.operators import audit as A
from inkmeter.operators import lexicon as L
from inkmeter.operators import rhythm as R
from inkmeter.operators import stats as S
from inkmeter.operators import voices as VO
from inkmeter.plans import cli as CLI
from inkmeter.plans import report
from inkmeter.sources import files as FI
from inkmeter.sources import stores as ST
from inkmeter.streaming import grow_voices, stream_scores

DOCS = "doc_id long, text string, register string"


def test_empty_and_null_texts(spark):
    d = spark.createDataFrame([(1, None, None), (2, "", "docs"), (3, " \n ", "blog"), (4, "```\ncode only\n```", None)], DOCS)
    results, found = A.audit(d, L.Lexicon.of(L.builtin_entries(), ["code"]))
    assert {(r.score, r.tier, r.word_count, r.summary) for r in results.collect()} == {(0, "green", 0, "Empty input.")}
    assert found.count() == 0
    s = S.text_stats(d).collect()
    assert {r.word_count for r in s if r.doc_id < 4} == {1} and {r.avg_sentence_length for r in s if r.doc_id < 4} == {0.0}
    m = R.metrics(d).filter("doc_id < 4").collect()
    assert {(r.paragraph_count, r.paragraph_cv) for r in m} == {(0, 1.0)}
    empty = d.limit(0)
    assert A.audit(empty, L.Lexicon.of(L.builtin_entries()))[0].count() == 0 and S.top_words(empty).count() == 0 and S.top_bigrams(empty).count() == 0


def test_audit_of_a_long_run_of_title_words(spark):
    d = spark.createDataFrame([(1, "Nets " * 20_000, None)], DOCS)
    results, found = A.audit(d, L.Lexicon.of(L.builtin_entries()))
    assert results.head().word_count == 20_000
    assert [(r.term, r["count"]) for r in found.filter("ord < 100000").collect()] == [("Title Case In Every Section Heading", 1)]


def test_neutral_registers_equal_none(spark):
    text = "We leverage robust, robust tools. " * 12
    d = spark.createDataFrame([(k, text, r) for k, r in enumerate([None, "general", "email", "social", "personal"])], DOCS)
    results, _ = A.audit(d, L.Lexicon.of(L.builtin_entries()))
    assert len({(r.score, r.tier) for r in results.collect()}) == 1


@given(st.lists(st.text(" abAB", max_size=4), max_size=12))
def test_dedupe_words_keeps_the_first_casing(words):
    out = L.dedupe_words(words)
    assert len({w.lower() for w in out}) == len(out) and all(w.strip() == w and w for w in out)
    assert {w.lower() for w in out} == {w.strip().lower() for w in words if w.strip()}


@pytest.mark.parametrize(("word", "forms"), [("robust", ["robusts", "robusted", "robusting", "robustly"]), ("curate", ["curates", "curated", "curating", "curately"]), ("ally", ["allies", "allied", "allying", "allily"]), ("simple", ["simples", "simpled", "simpling", "simply"]), ("box", ["boxes", "boxed", "boxing", "boxly"]), ("tree", ["trees", "treeed", "treeing", "treely"])])
def test_inflections(word, forms):
    assert L.inflections(word) == forms


def test_globs(spark):
    paths = ["a.md", "src/a.md", "src/x/b.txt", "src/x/a1.md", "node_modules/a.md", "x/.git/a.md", "A.MD"]
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    hit = lambda *g: sorted(r.path for r in FI.match_paths(df, g).collect())
    assert hit("*.md") == ["a.md"] and hit("**/*.md") == ["a.md", "src/a.md", "src/x/a1.md"] and hit("src/?/a?.md") == ["src/x/a1.md"] and hit("src/**") == ["src/a.md", "src/x/a1.md", "src/x/b.txt"]
    assert FI.static_root("/a/b/*.md") == "/a/b" and FI.static_root("a/b.md") == "a/b.md" and FI.static_root("*.md") == "."


def test_lint_report(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "one.md").write_text("# Title\n\nPlain words about a harbour.\n")
    (tmp_path / "two.txt").write_text("We leverage tools.\nWe leverage ropes, it is worth noting.\n")
    lexicon = L.Lexicon.of(L.builtin_entries())
    text, code = report.run(spark, [f"{tmp_path}/**"], lexicon, "orange")
    assert code == 1 and "2 files audited, 1 at or above orange." in text and "register: docs" in text
    assert "leverage ×2" in text and "L1:C4" in text and "→ use" in text and "didactic-hedge, editorializing-marker" in text
    data, code = report.run(spark, [f"{tmp_path}/docs/*.md"], lexicon, as_json=True)
    assert code == 0 and json.loads(data)["failingCount"] == 0 and json.loads(data)["files"][0]["register"] == "docs"
    assert report.wrap("a bb ccc", "  ", 6) == ["  a bb", "  ccc"]


TEAM_DIALS = {"formality": 3, "warmth": 8, "directness": 9} | {k: 50 for k in V.DIALS} | {"entropy": 80}


def test_hidden_names_and_ignored_folders(spark, tmp_path):
    for name in ("_posts/a.md", "docs/_c.md", "docs/b.md", ".github/d.md", "docs/.e.md", "node_modules/x/f.md", "docs/dist/g.md", "docs/h i+j%20.md", "docs/k[1].md", "docs/l.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(f"text of {name}\n")
    want = sorted(str(tmp_path / n) for n in ("_posts/a.md", "docs/_c.md", "docs/b.md", ".github/d.md", "docs/.e.md", "docs/h i+j%20.md", "docs/k[1].md"))
    assert FI.list_files(spark, ["**/*.md", "docs/*.md"], str(tmp_path)) == want
    got = {r.path: r.text for r in FI.read_files(spark, ["**/*.md"], str(tmp_path)).collect()}
    assert got == {p: f"text of {p.removeprefix(str(tmp_path) + '/')}\n" for p in want}
    assert [r.path for r in FI.read_files(spark, ["docs/_c.md", "docs/none.md", "docs"], str(tmp_path)).collect()] == [f"{tmp_path}/docs/_c.md"]
    assert FI.read_files(spark, ["none/**/*.md"], str(tmp_path)).count() == 0


def test_command_line(spark, tmp_path, capsys):
    for bad in (["--threshold", "pink", "a"], ["--register"], ["--loud", "a"], [], ["--json"]):
        with pytest.raises(ValueError):
            CLI.parse_lint_args(bad)
    a = CLI.parse_lint_args(["a.md", "--json", "--register", "memo", "b/**", "--threshold", "red"])
    assert (a.patterns, a.register, a.threshold, a.as_json) == (["a.md", "b/**"], "memo", "red", True)
    assert CLI.main(["lint", "--help"]) == 0 and "Usage" in capsys.readouterr().out and CLI.main(["sing"]) == 2 and CLI.main(["lint", "--pink"]) == 2
    (tmp_path / ".git").mkdir()
    (tmp_path / "a.md").write_text("A quiet harbour rope, plain and short.\n")
    assert CLI.main(["lint", "a.md"], spark, str(tmp_path)) == 0
    (tmp_path / ST.CONFIG_NAMES[0]).write_text(json.dumps({"bannedWords": ["rope", "quiet"], "allowedWords": ["quiet"], "register": "memo", "threshold": "yellow"}))
    capsys.readouterr()
    assert CLI.main(["lint", "*.md"], spark, str(tmp_path)) == 1
    out = capsys.readouterr().out
    assert "Using config:" in out and "register: memo" in out and "at or above yellow" in out and "rope" in out and "quiet " not in out.split("strengths")[0].split("rope")[1]
    assert CLI.main(["lint", "*.md", "--threshold", "red"], spark, str(tmp_path)) == 0
    (tmp_path / ST.CONFIG_NAMES[0]).write_text("{")
    assert CLI.main(["lint", "*.md"], spark, str(tmp_path)) == 2


def test_repository_configuration_in_the_tools(spark, tmp_path):
    (tmp_path / "repo" / ".git").mkdir(parents=True)
    p = Prose(spark, tmp_path / "home", cwd=str(tmp_path / "repo"))
    with pytest.raises(ValueError):
        p.get_style_guide("team")
    before = p.audit_text("The rope and the rope hold.")
    (tmp_path / "repo" / ST.CONFIG_NAMES[1]).write_text(json.dumps({"bannedWords": ["rope"], "register": "docs", "instructions": "No puns.", "style": {"name": "House", "dials": TEAM_DIALS}}))
    after = p.audit_text("The rope and the rope hold.")
    assert before["score"] == 0 and before["register"] == "general" and after["score"] > 0 and after["register"] == "docs"
    assert p.audit_text("The rope and the rope hold.", register="memo")["register"] == "memo"
    assert [s for s in p.list_styles()["styles"] if s["id"] == "team"][0]["name"] == "House"
    p.set_style_instructions("Be brief.")
    g = p.get_style_guide("team")
    assert g["instructions"] == "No puns.\n\nBe brief." and g["guide"].startswith(V.PERSONA_LINES["formality"][0]) and g["dials"]["entropy"] == 80
    assert p.get_style_guide("code-comment")["instructions"].startswith("No puns.")


def test_retraining_merges_by_presence_and_forks_keep_words(spark, tmp_path):
    seed = {"guide": "Write plainly.", "formality": 2, "warmth": 3, "directness": 4, "dials": {"entropy": 0}, "banned": ["tar"], "custom": ["eel"], "instructions": "Short."}
    p = Prose(spark, tmp_path, published=lambda handle, slug: seed if (handle, slug) == ("ann", "calm-one") else None)
    v = p.train_style("Harbour", ["red rope red rope holds. crew boats crew boats drift.", "red rope red rope again."])
    assert v["topBigrams"][0] == "red rope"
    w = p.train_style("harbour", ["crew boats crew boats wait.", "crew boats crew boats go."])
    assert w["topBigrams"][0] == "crew boats" and "red rope" in w["topBigrams"]  # three samples, the old voice one of them
    f = p.fork_style("ann/calm-one", "Mine")
    assert (f["guide"], f["persona"]["directness"], f["forkedFrom"]) == ("Write plainly.", 4, "ann/calm-one")
    assert p.list_dictionary(f["id"])["banned"] == ["tar"] and p.list_dictionary(f["id"])["custom"] == ["eel"] and p.get_style_instructions(f["id"]) == "Short."
    with pytest.raises(ValueError):
        p.fork_style("bob/none", "x")


def test_orders_of_reports(spark, tmp_path):
    """Categories by matches, ties in the lexicon's order; drift by distance; repetition by share."""
    p = Prose(spark, tmp_path)
    got = p.audit_text("We curate and we ponder. The landscape, the landscape! Robust therefore robust; thus on the other hand.")
    assert [c for c, _ in got["categoryBreakdown"]] == ["verb", "adjective", "noun", "transition", "phrase"] and [n for _, n in got["categoryBreakdown"]] == [2, 2, 2, 2, 1]
    assert [f["term"] for f in got["findings"]] == ["robust", "landscape"] and "metaphorically" in got["findings"][1]["note"]
    v = p.create_style_from_dials("Odd", {"sentenceLength": 100, "contractionUse": 100, "questionUse": 50})
    drift = p.check_voice_match(v["id"], "Short one. Very short. So short. No more. Not one.")["findings"]
    assert [d["delta"] for d in drift] == sorted((d["delta"] for d in drift), reverse=True) and len(drift) > 2
    w = p.train_style("Habit", ["The crew mended the nets: red rope red rope, tar barrel tar barrel.", "The crew mended the nets: red rope red rope.", "The crew mended the nets: red rope red rope."])
    rep = p.check_self_repetition(w["id"], "The crew mended the nets: red rope red rope and tar barrel tar barrel.")
    shares = [r["matches"] / r["total"] for r in rep]
    assert shares == sorted(shares, reverse=True) and {r["kind"] for r in rep} == {"opener", "phrase"}
    again = p.create_style_from_dials(" odd ", {"sentenceLength": 0})
    assert (again["id"], again["shortId"], again["stats"]["avg_sentence_length"]) == (v["id"], v["shortId"], 8.0)


def test_configuration(tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / "a" / "b").mkdir(parents=True)
    name = ST.CONFIG_NAMES[0]
    assert ST.find_config(f"{tmp_path}/a/b") is None
    (tmp_path / name).write_text(json.dumps({"bannedWords": ["rope"], "register": "memo", "threshold": "red", "style": {"name": " Team ", "dials": TEAM_DIALS}}))
    c = ST.find_config(f"{tmp_path}/a/b")
    assert (c.banned, c.register, c.threshold) == (["rope"], "memo", "red")
    for bad in ({"bannedWords": "x"}, {"register": "song"}, {"threshold": 3}, {"instructions": 1}, {"style": {"name": "x", "dials": TEAM_DIALS | {"formality": 11}}}, {"style": {"name": "x", "dials": {"formality": 1}}}, {"style": {"name": " ", "dials": TEAM_DIALS}}, {"style": 1}, []):
        with pytest.raises(ValueError):
            ST.parse_config(bad)
    (tmp_path / name).write_text("{")
    with pytest.raises(ValueError):
        ST.find_config(str(tmp_path))


def test_styles_and_dictionaries(spark, tmp_path):
    p = Prose(spark, tmp_path)
    a = p.create_style_from_dials("Calm", {"formality": 2, "sentenceLength": 0})
    assert a["stats"]["avg_sentence_length"] == 8.0 and a["guide"].startswith(V.PERSONA_LINES["formality"][0]) and len(a["shortId"]) == 5
    texts = ["The crew mended the nets. Crew boats drift, and crew boats wait. Who knows?", "The crew mended the nets. It rained; crew boats stayed.", "The crew mended the nets again."]
    v = p.train_style("Harbour", texts)
    assert v["sampleCount"] == 3 and len(v["history"]) == 3 and "crew boats" in v["topBigrams"]
    w = p.train_style("harbour", ["Short. Very short."])
    assert w["id"] == v["id"] and w["sampleCount"] == 4 and w["persona"] == v["persona"]
    assert p.get_style_guide(w["shortId"].lower())["name"] == "harbour"
    m = p.check_voice_match(w["id"], "The crew mended the nets. Who knows?")
    assert m["confidence"] == "low" and 0 <= m["match_score"] <= 100
    rep = p.check_self_repetition(w["id"], "The crew mended the nets again today")
    assert rep == [] or {r["kind"] for r in rep} <= {"opener", "phrase"}
    f = p.fork_style("founder-memo", "Ours")
    assert f["persona"]["directness"] == 9 and p.set_default_style(f["id"])["defaultStyleId"] == f["id"]
    assert p.update_style(a["id"], "Calmer", {"sentenceLength": 100})["stats"]["avg_sentence_length"] == 30.0
    assert {s["kind"] for s in p.list_styles()["styles"]} == {"preset", "trained"} and p.delete_style(a["id"])["deleted"]
    with pytest.raises(ValueError):
        p.get_style_guide(a["id"])
    p.add_banned_word(" Harbour ")
    p.add_banned_word("HARBOUR")
    assert p.list_dictionary()["banned"] == ["Harbour"]
    got = p.audit_text("A harbour, a harbour.", facts=["seven boats sank", "nobody slept"])
    assert got["findings"][0]["term"] in ("Harbour", "Elicited material unused") and got["score"] > 14
    p.remove_banned_word("harbour")
    assert p.audit_text("A harbour.")["score"] == 0
    p.set_style_instructions(" \x1b[1mBe brief.\x07 ")
    assert p.get_style_guide("code-comment")["instructions"] == "Be brief."
    for bad in (lambda: p.audit_text(" "), lambda: p.add_custom_word(" "), lambda: p.fork_style("nope", "x"), lambda: p.train_style("x", [" "])):
        with pytest.raises(ValueError):
            bad()
    assert parse_public_ref("https://x.example/styles/Ann/calm-one") == ("ann", "calm-one") and parse_public_ref("nothing") is None


def test_spans_and_places(spark):
    d = spark.createDataFrame([(1, "one two\ntwo\n\n two", None)], DOCS)
    got = d.select(F.explode(X.spans(F.col("text"), X.rx(r"\btwo\b"))).alias("m"), "text").select("m.start", "m.end", X.line_of(F.col("text"), F.col("m.start")).alias("line"), X.column_of(F.col("text"), F.col("m.start")).alias("col"))
    assert [tuple(r) for r in got.collect()] == [(4, 7, 1, 5), (8, 11, 2, 1), (14, 17, 4, 2)]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(k, "a", "We leverage Neon and robust, robust ropes." * (k + 1)) for k in range(6)], "doc_id long, voice string, text string")
    rows.write.parquet(f"{tmp_path}/in")
    lexicon = L.Lexicon.of(L.builtin_entries())
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = stream_scores(stream, lexicon).writeStream.format("memory").queryName("scores").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {r.doc_id: (r.score, r.tier) for r in A.lexical_scores(rows, lexicon).collect()}
    assert {r.doc_id: (r.score, r.tier) for r in spark.table("scores").collect()} == want
    q = grow_voices(stream, f"{tmp_path}/voices", f"{tmp_path}/cp")
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(f"{tmp_path}/voices/0").head().sample_count == 6


def test_json_report_has_every_lexical_finding(spark, tmp_path):
    terms = [f"{a}{b}rope" for a in "bdfgk" for b in "aeiou"]
    (tmp_path / "many.md").write_text(". ".join(f"The {t} holds" for t in terms) + ".\n")
    lexicon = L.Lexicon.of(L.builtin_entries(), terms)
    found = json.loads(report.run(spark, [f"{tmp_path}/*.md"], lexicon, as_json=True)[0])["files"][0]
    lexical = [f for f in found["findings"] if f["grp"] == V.LEXICAL_GROUP]
    assert len(found["findings"]) == found["finding_count"] and len(lexical) > V.LEXICAL_CAP
    text = report.run(spark, [f"{tmp_path}/*.md"], lexicon)[0]
    assert f"…and {len(lexical) - V.LEXICAL_CAP} more (use --json for the full list)" in text
    assert sum(f"  {f['term']} " in text for f in lexical) <= V.LEXICAL_CAP


def _plan(d):
    return d._jdf.queryExecution().executedPlan().toString()


def test_words_are_counted_within_the_row(spark):
    d = spark.createDataFrame([(1, "Tar holds. Red rope and red rope, said Tar; tar holds red rope"), (2, None)], "doc_id long, text string")
    for count in (S.top_words, S.top_bigrams, S.capitalization_rates):
        assert "Exchange" not in _plan(count(d)), count.__name__
    assert {r.token: r["count"] for r in S.top_words(d).collect()} == {"tar": 3, "red": 3, "rope": 3, "holds": 2}
    caps = {r.word: (r.total, r.capitalized) for r in S.capitalization_rates(d).collect()}
    assert caps["tar"] == (2, 1) and caps["red"] == (2, 0)


def test_rows_that_share_an_id_are_counted_together(spark):
    d = spark.createDataFrame([(1, "red rope"), (1, "Red rope. The Tar"), (2, "red rope")], "doc_id long, text string")
    assert {(r.doc_id, r.token, r["count"]) for r in S.top_words(d).collect()} == {(1, "red", 2), (1, "rope", 2)}
    assert [(r.doc_id, r.token, r["count"]) for r in S.top_bigrams(d).collect()] == [(1, "red rope", 2)]
    assert {(r.doc_id, r.word, r.total, r.capitalized) for r in S.capitalization_rates(d).collect()} == {(1, "rope", 2, 0), (1, "tar", 1, 1), (2, "rope", 1, 0)}


def test_latest_samples_are_chosen_without_their_texts(spark):
    rows = [(i % 3, i // 3, f"red rope red rope {i}") for i in range(90)] + [(None, 1, "a b"), (None, None, "c d"), (4, None, "e f"), (4, 2, "g h")]
    d = spark.createDataFrame(rows, "voice long, doc_id long, text string")
    got = [(r.voice, r.doc_id, r.nth) for r in VO.fingerprints(d, cap=4).collect()]
    want = [(v, 29 - k, k + 1) for v in range(3) for k in range(4)] + [(None, 1, 1), (None, None, 2), (4, 2, 1), (4, None, 2)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_strengths_keep_letters_alone(spark):
    text = "We saw Br\u00fcnn, \u0416Bergen \u4e2d and caf\u00e9-Statio\u0301n 12\tnot\u200bion. The na\u0103tion of \u201cAnna\u201d"
    d = spark.createDataFrame([(1, text, None), (2, "The nation saw Anna.", None)], DOCS)
    plain = X.re.sub(r"[^A-Za-z'\n -]+", "", text)
    table = str.maketrans("", "", R.DROPPED)
    assert X.re.sub(r"[^A-Za-z'\n -]+", "", text.translate(table)) == plain
    assert {r.doc_id: r.strong_signals for r in R.strengths(d).collect()}.keys() == {1, 2}
