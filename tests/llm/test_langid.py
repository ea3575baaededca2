import zlib
from pyspark.sql import functions as F

from inkmeter.llm import langid as L
from inkmeter.llm.common import held_out, read_table
from inkmeter.llm.queries import language_profiles, op2_language_id

from .helpers import ODD, clashing, docs

SF = "/root/testdata/sf0.01"


def slow_grams(text):
    out, word = [], ""
    for c in (text or "").lower() + " ":
        if c.isalpha():
            word += c
        elif word:
            p = f"_{word}_"
            out += [p[k : k + n] for n in (1, 2, 3) for k in range(len(p) - n + 1) if p[k : k + n] != "_"]
            word = ""
    return out


def test_grams_equal_a_plain_loop():
    for t in ("", "a", "Der Hund, der a b.  läuft!", "x1y -- É_z", "!!", "日本 語"):
        assert sorted(map(L.gram_text, L.grams(t).tolist())) == sorted(slow_grams(t))


def slow_ranks(grams, size):
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    return sorted(count, key=lambda g: (-count[g], g.ljust(3, "\0")))[:size]


def slow_prediction(text, ranks, size):
    """Out-of-place distances by plain lists."""
    own = slow_ranks(slow_grams(text), size)
    if not own:
        return "und", 0.0
    d = {lang: sum(abs(r.index(g) - k) if g in r else size for k, g in enumerate(own)) for lang, r in ranks.items()}
    best = min(sorted(d), key=d.get)
    rest = min(x for lang, x in d.items() if lang != best)
    return best, 1 - d[best] / rest


def test_predictions_equal_a_slow_version(spark):
    rows = read_table(spark, "/root/testdata/sf0.001", "documents").collect()
    d = read_table(spark, "/root/testdata/sf0.001", "documents")
    learned = [(r.text, r.lang) for r in rows if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    ranks = {lang: slow_ranks([g for t, x in learned if x == lang for g in slow_grams(t)], L.SIZE) for lang in {x for _, x in learned}}
    p = language_profiles(d)
    assert {k: p.texts(k) for k in p.ranks} == ranks
    got = {r.doc_id: (r.lang_pred, r.score) for r in op2_language_id(spark, "/root/testdata/sf0.001").collect()}
    for r in rows:
        lang, score = slow_prediction(r.text, ranks, L.SIZE)
        assert got[r.doc_id][0] == lang and abs(got[r.doc_id][1] - score) < 1e-9


def test_slices_change_nothing(monkeypatch):
    text = "Der Hund läuft. " * 30 + "unbroken" * 40 + " 12 -- " * 9 + "ende"
    whole = L.gram_counts(text)
    for size in (1, 7, 100):
        monkeypatch.setattr(L, "SLICE", size)
        assert "".join(L.slices(text)) == text
        assert [x.tolist() for x in L.gram_counts(text)] == [x.tolist() for x in whole]


def test_very_long_texts(spark):
    rows = [(1, "Der lange Text hört nicht auf. " * 100_000, "de", "a"), (2, "wort" * 500_000, "de", "a"), (3, "An English text that goes on and on. " * 300, "en", "a"), (4, " \n" * 1_000_000, None, "a")]
    d = docs(spark, rows)
    got = {r.doc_id: r.lang_pred for r in L.predict_languages(d.select("doc_id", "text"), L.learn_profiles(d)).collect()}
    assert got[1] == "de" and got[3] == "en" and got[4] == "und"


def test_held_out_accuracy(spark):
    d = read_table(spark, SF, "documents")
    got = op2_language_id(spark, SF).join(d.select("doc_id", "lang"), "doc_id").filter("held_out")
    right = got.filter("lang = lang_pred").count()
    assert right >= 0.98 * got.count() > 100


def test_odd_rows(spark):
    d = docs(spark, ODD)
    p = L.learn_profiles(d)
    assert set(p.ranks) == {"en", "de"} and p.texts("de")[0] in ("t", "e", "_d")
    got = L.predict_languages(clashing(d.select("doc_id", "text"), "score"), p).collect()
    assert len(got) == len(ODD)
    for r in got:
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (r.doc_id in (1, 2, 3, 9))
    assert {r.lang_pred for r in got if r.doc_id == 7} == {"de"}


def test_empty_tables_and_no_labels(spark):
    none = docs(spark, [])
    p = L.learn_profiles(none)
    assert p.ranks == {} and L.predict_languages(none.select("doc_id", "text"), p).collect() == []
    got = L.predict_languages(docs(spark, ODD).select("doc_id", "text"), p).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}


def test_labels_of_held_out_rows_do_not_matter(spark):
    d = read_table(spark, "/root/testdata/sf0.001", "documents")
    other = d.withColumn("lang", F.when(held_out("doc_id", 4, 2), F.lit("xx")).otherwise(F.col("lang")))
    a, b = language_profiles(d), language_profiles(other)
    assert {k: v.tolist() for k, v in a.ranks.items()} == {k: v.tolist() for k, v in b.ranks.items()}
