import hashlib
import random

from inkmeter.llm.exact_dedup import content_sort_dedup

from .helpers import ODD, clashing, docs

UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows):
    groups = {}
    for k, (i, t, *_) in enumerate(rows):
        groups.setdefault((t or "").translate(UP), []).append((i is not None, i or 0, k))
    out = []
    for t, g in groups.items():
        best = max(g)
        for has, i, k in g:
            out.append((i if has else None, best[1] if best[0] else None, len(g), k == best[2], hashlib.sha256(t.encode()).hexdigest()))
    return sorted(map(repr, out))


def test_matches_brute_force_on_odd_rows(spark):
    got = content_sort_dedup(clashing(docs(spark, ODD), "keep_id", "kept", "row")).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(ODD)


def test_large_group_over_many_partitions(spark):
    random.seed(1)
    rows = [(k, random.choice(["Same text", "same TEXT", f"own {k % 40}"]), "en", "s") for k in range(3000)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = content_sort_dedup(docs(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(repr(tuple(r)) for r in got) == brute(rows)


def test_carry_returns_whole_rows_of_kept_ones(spark):
    kept = content_sort_dedup(clashing(docs(spark, ODD), "kept"), carry=True).filter("kept").select("row.*")
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"]
    assert kept.count() == len({(t or "").translate(UP) for _, t, *_ in ODD})


def test_empty_table(spark):
    assert content_sort_dedup(docs(spark, [])).collect() == []


def test_texts_come_back_as_they_were(spark):
    rows = [(k, t, "en", "s") for k, t in enumerate([None, "", "Ab C", "ab c", "ÉÀ Éé \U0001f600 Z", "a" * 9 + "B", "x" * 70 + "Y" * 9, "x" * 70 + "y" * 9])]
    kept = content_sort_dedup(docs(spark, rows), carry=True).filter("kept").select("row.*").collect()
    assert sorted((r.doc_id, r.text, r.lang) for r in kept) == [(k, t, "en") for k, t, *_ in rows if k not in (0, 2, 6)]


def test_long_shared_beginnings_over_many_partitions(spark):
    random.seed(2)
    same = "The same beginning of every text, longer than what splitters hold of it. " * 3
    rows = [(k, same + random.choice("abcdefAB") * random.choice((1, 1, 5000)), "en", "s") for k in range(600)]
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = content_sort_dedup(docs(spark, rows)).collect()
        kept = content_sort_dedup(docs(spark, rows), carry=True).filter("kept").select("row.*").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(repr(tuple(r)) for r in got) == brute(rows)
    assert sorted((r.doc_id, r.text) for r in kept) == sorted((i, t) for i, t, *_ in rows if i in {r.doc_id for r in got if r.kept})
