import zlib

import numpy as np

import corpus_pipeline as P
from inkmeter.llm import langid
from inkmeter.llm.common import read_table
from inkmeter.llm.queries import END_ID, WIDTH, language_profiles, tokenizer_path

from .helpers import ODD, clashing, docs
from .test_simhash import jaccard_components

SF = "/root/testdata/sf0.001"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NUMBERS = [2, 4, 10, 7, 9]


def plain(rows, profiles):
    """The stages over (doc_id, text, source) rows, one after the other, in plain Python."""
    say = langid.Identifier(profiles)
    rows = [r for r in rows if say(r[1] or "")[0] != "und"]
    last = {}
    for i, t, s in rows:
        last[t.translate(UP)] = max(last.get(t.translate(UP), (i, t, s)), (i, t, s), key=lambda r: r[0])
    rows = sorted(last.values())
    group = jaccard_components([(i, t) for i, t, _ in rows], P.NEAR_SIMILARITY, P.NEAR_SHINGLE)
    rows = [r for r in rows if group[r[0]] == r[0]]
    return rows


def test_stages_are_named_as_asked():
    assert len(P.STAGES) == len(NUMBERS) and P.ORACLE_SQL is None


def test_against_plain_python(spark):
    all_docs = read_table(spark, SF, "documents")
    rows = [(r.doc_id, r.text, r.source) for r in all_docs.collect()]
    kept = plain(rows, language_profiles(all_docs))
    d = all_docs
    for _, stage in P.STAGES[:3]:
        d = stage(spark, d, SF)
        assert d.columns == all_docs.columns
    got = sorted((r.doc_id, r.text, r.source) for r in d.collect())
    assert kept == got
    mixed = P.mixed(spark, d, SF)
    assert mixed.columns == all_docs.columns
    copies = {}
    for r in mixed.collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    size = {i: len(t.encode().split()) for i, t, _ in kept}
    assert set(copies) <= set(size) and max(copies.values()) <= 2
    assert abs(sum(size[i] * n for i, n in copies.items()) / sum(size.values()) - 1.5) < 0.1
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    want = []
    text = {i: t for i, t, _ in kept}
    for i, n in copies.items():
        ids = [*tok.encode(text[i], add_special_tokens=False).ids, END_ID]
        first = len(ids) % WIDTH or WIDTH
        cuts = [0, *range(first, len(ids), WIDTH), len(ids)]
        want += [(i, k, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))] * n
    got = P.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got) == sorted(want)
    used = len({r.sequence_id for r in got})
    assert used <= -(-sum(r.length for r in got) // WIDTH) * 1.05 + 2


def test_odd_rows_through_all_stages(spark):
    d = clashing(docs(spark, ODD), "copies", "mix_id", "gone", "gone_id", "a.b", "row", "score", "kept", "component_id", "lang_pred")
    cols = d.columns
    ids = []
    for _, stage in P.STAGES[:4]:
        d = stage(spark, d, SF)
        assert d.columns == cols
        ids.append(sorted((r.doc_id for r in d.collect()), key=str))
    assert 7 in ids[0] and 1 not in ids[0] and 9 not in ids[0]
    assert P.packed(spark, d, SF).count() >= len(set(ids[-1]))


def test_empty_table(spark):
    d = docs(spark, [])
    for _, stage in P.STAGES:
        d = stage(spark, d, SF)
    assert d.collect() == []


def test_near_copies_equal_exact_similarity(spark):
    d = P.exact_copies(spark, P.language_id(spark, read_table(spark, "/root/testdata/sf0.01", "documents"), SF), SF)
    rows = [(r.doc_id, r.text) for r in d.collect()]
    want = jaccard_components(rows, P.NEAR_SIMILARITY, P.NEAR_SHINGLE)
    assert any(i != c for i, c in want.items())
    assert sorted(r.doc_id for r in P.near_copies(spark, d, SF).collect()) == sorted(i for i, c in want.items() if i == c)
