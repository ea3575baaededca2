import random
import zlib

import numpy as np
import pytest

from inkmeter.llm import packing
from inkmeter.llm.queries import END_ID, WIDTH, tokenizer_path

from .helpers import LONG, ODD, clashing, docs


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, END_ID]


def test_fast_ids_equal_the_tokenizer(ids):
    enc = packing.TextIds(tokenizer_path())
    assert enc.core is not None
    texts = ["", " ", "a  b", " a", "a ", "a\n b", "x<|endoftext|> y", "it's we'll  \t\n ok", "日本 語　 a b  c", "\x1c a \x85b", "a\U0001f600 b", "​ a", "é́ ñ", LONG[:3000], "0123 45,6%"]
    for t in texts:
        assert np.frombuffer(enc.encode(t), "<u4").tolist() == ids(t)[:-1], t


RUNS = {"spaces": " " * 2_000_000, "lines": "\n" * 2_000_000, "word": "ab" * 1_000_000, "short of the bound": " \n" * (packing.LONG_RUN // 2 - 1) + "x", "over it": "y" + "\t" * (packing.LONG_RUN + 1) + "x  z"}


@pytest.mark.parametrize("name", RUNS)
def test_long_runs_have_the_tokenizers_ids(ids, name):
    assert np.frombuffer(packing.TextIds.load(tokenizer_path()).encode(RUNS[name]), "<u4").tolist() == ids(RUNS[name])[:-1]


def test_a_splitter_that_gives_up_is_replaced(ids):
    enc, text = packing.TextIds(tokenizer_path()), "a " * 10

    class PanicException(BaseException):
        pass

    class Broken:
        def encode_ordinary(self, text):
            raise PanicException

    enc.core = Broken()
    assert np.frombuffer(enc.encode(text), "<u4").tolist() == ids(text)[:-1]


def test_packs_very_long_texts(spark, ids):
    rows = [(k, t, "en", "s") for k, t in enumerate(RUNS.values())]
    check(packing.pack(docs(spark, rows), tokenizer_path(), END_ID, WIDTH).collect(), rows, ids)


def check(got, rows, ids):
    """Every id once, in order; sequences without gaps or overlaps, none too long."""
    want = {}
    for i, t, *_ in rows:
        want.setdefault(i, []).append(ids(t))
    seqs, pieces = {}, {}
    for r in got:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces.setdefault(r.doc_id, []).append(r)
    for s in seqs.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= WIDTH
    for i, docs_ids in want.items():
        expected = []
        for x in docs_ids:
            first = len(x) % WIDTH or WIDTH
            cuts = [0, *range(first, len(x), WIDTH), len(x)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                expected.append((k, a, b - a, zlib.crc32(np.array(x[a:b], "<u4").tobytes())))
        assert sorted(expected) == sorted((r.piece, r.start, r.length, r.ids_crc32) for r in pieces[i])
    return len(seqs)


def test_packs_odd_rows(spark, ids):
    got = packing.pack(clashing(docs(spark, ODD), "length", "offset"), tokenizer_path(), END_ID, WIDTH).collect()
    check(got, ODD, ids)
    assert packing.pack(docs(spark, []), tokenizer_path(), END_ID, WIDTH).collect() == []


def test_packs_tightly(spark, ids):
    random.seed(3)
    rows = [(k, "word " * random.randint(0, 1500), "en", "s") for k in range(1500)]
    got = packing.pack(docs(spark, rows), tokenizer_path(), END_ID, WIDTH).collect()
    used = check(got, rows, ids)
    least = -(-sum(r.length for r in got) // WIDTH)
    assert used <= least * 1.02 + 1


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    random.seed(seed)
    hist = {random.randint(1, 64): random.randint(1, 500) for _ in range(random.randint(1, 40))}
    placed = {}
    for kind, n in packing.plan(hist, 64):
        assert sum(kind) <= 64 and n > 0
        for v in kind:
            placed[v] = placed.get(v, 0) + n
    assert placed == hist


def test_fit_is_not_negative_and_fits():
    lengths = np.array([1, 2, 3, 4, 6])
    pats = packing.patterns_for(lengths, 6, 0)
    x = packing.fit(pats, np.array([30.0, 20, 10, 20, 7]))
    assert (x >= 0).all()
    got = np.zeros(5)
    for p, k in zip(pats, x):
        for i in p[p >= 0]:
            got[i] += k
    assert np.abs(got - [30, 20, 10, 20, 7]).max() < 6
