"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent n-grams (one to three characters, words padded), by rank.
A document's own most frequent n-grams are compared to each profile: the out-of-place distance sums how far
each is from its rank there, and ``size`` for one that the profile lacks. The nearest profile names the language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import whole

SIZE, ORDER = 400, 3
#: n-grams that a task gathers of a language before it sums them up.
HELD = 2_000_000
#: Characters of a text whose n-grams are held at once.
SLICE = 1 << 18
PAD, BITS = ord("_"), 21
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """Whether each code point is a letter; made once for each process."""
    if not _letters:
        _letters.append(np.array([chr(c).isalpha() for c in range(0x110000)]))
    return _letters[0]


def grams(text: str, order: int = ORDER) -> np.ndarray:
    """All n-grams of the text's words, as numbers that sort like their strings.

    A word is a run of letters in lower case with a pad on both sides; a pad alone is none.
    """
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = _is_letter()[code]
    before = np.concatenate([[True], letter[:-1]]) if len(code) else letter
    kept = letter | before  # of a run of other characters, the first is the pad
    c = np.concatenate([[PAD], np.where(letter, code, PAD)[kept], [PAD]])
    is_word = np.concatenate([[False], letter[kept], [False]])
    out = [c[is_word] << 2 * BITS]
    if order >= 2:
        out.append((c[:-1] << 2 * BITS | c[1:] << BITS)[is_word[:-1] | is_word[1:]])
    if order >= 3:
        out.append((c[:-2] << 2 * BITS | c[1:-1] << BITS | c[2:])[is_word[1:-1]])
    return np.concatenate(out)


def slices(text: str) -> Iterator[str]:
    """The text in pieces of about ``SLICE`` characters that end between words, so their n-grams add up to the text's.

    A word of several slices is kept whole.
    """
    at = 0
    while len(text) - at > SLICE:
        end = at + SLICE
        while end < len(text) and text[end - 1].isalpha():
            end += 1
        yield text[at:end]
        at = end
    yield text[at:]


def gram_counts(text: str, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The text's distinct n-grams and how often each occurs, slice by slice."""
    u, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for part in slices(text):
        v, m = np.unique(grams(part, order), return_counts=True)
        if not len(u):
            u, n = v, m
        elif len(v):
            u, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, m]), len(u)).astype(np.int64)
    return u, n


def gram_text(code: int) -> str:
    return "".join(chr(x) for x in (code >> 2 * BITS, code >> BITS & (1 << BITS) - 1, code & (1 << BITS) - 1) if x)


def ranked(u: np.ndarray, n: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent of distinct n-grams, ties by their characters."""
    return u[np.argsort(-n, kind="stable")[:size]]


@dataclass(frozen=True)
class Profiles:
    size: int
    order: int
    ranks: dict[str, np.ndarray]  # language: its n-grams from the most frequent on

    def texts(self, lang: str) -> list[str]:
        return [gram_text(int(c)) for c in self.ranks[lang]]


def learn_profiles(docs: DataFrame, size: int = SIZE, order: int = ORDER, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Count the n-grams of every labelled row's whole text, and keep the ``size`` first of each language.

    What comes to the driver is ``size`` rows a language. Ties in count go by the n-gram's characters.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        held: dict[str, list[np.ndarray]] = {}
        room = 0

        def add_up() -> None:
            for lang, parts in held.items():
                u, n = np.unique(np.concatenate(parts), return_counts=True)
                if lang in sums:
                    all_u, at = np.unique(np.concatenate([sums[lang][0], u]), return_inverse=True)
                    u, n = all_u, np.bincount(at, np.concatenate([sums[lang][1], n]), len(all_u)).astype(np.int64)
                sums[lang] = u, n
            held.clear()

        def rows() -> pa.RecordBatch:
            langs = [x for lang, (u, _) in sums.items() for x in [lang] * len(u)]
            u = np.concatenate([u for u, _ in sums.values()]) if sums else np.zeros(0, np.int64)
            n = np.concatenate([n for _, n in sums.values()]) if sums else np.zeros(0, np.int64)
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(u, pa.int64()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                for part in slices(text.as_py()):
                    g = grams(part, order)
                    held.setdefault(lang, []).append(g)
                    room += len(g)
                    if room > HELD:
                        add_up()
                        room = 0
                        if sum(len(u) for u, _ in sums.values()) > HELD:
                            yield rows()
        add_up()
        yield rows()

    labelled = docs.filter(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), whole(text_col).alias("text"))
    counts = labelled.mapInArrow(work, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    first = W.partitionBy("lang").orderBy(F.col("n").desc(), F.col("gram"))
    top = counts.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= size).select("lang", "gram", "rank").collect()
    ranks: dict[str, list[int]] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["rank"])):
        ranks.setdefault(r["lang"], []).append(r["gram"])
    return Profiles(size, order, {k: np.array(v, np.int64) for k, v in ranks.items()})


class Identifier:
    def __init__(self, p: Profiles):
        self.p, self.langs = p, sorted(p.ranks)
        self.known = np.unique(np.concatenate([*p.ranks.values(), np.zeros(1, np.int64)]))
        self.place = np.full((len(self.known), len(self.langs)), -1)
        for k, lang in enumerate(self.langs):
            self.place[np.searchsorted(self.known, p.ranks[lang]), k] = np.arange(len(p.ranks[lang]))

    def __call__(self, text: str) -> tuple[str, float]:
        """Language and confidence, from 0 (two languages are as near) to 1; ``und``, 0 without a letter."""
        codes, n = gram_counts(text, self.p.order)
        if not len(codes) or not self.langs:
            return "und", 0.0
        own = ranked(codes, n, self.p.size)
        at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        there = np.where((self.known[at] == own)[:, None], self.place[at], -1)
        d = np.where(there < 0, self.p.size, np.abs(there - np.arange(len(own))[:, None])).sum(0)
        best = int(d.argmin())
        rest = np.delete(d, best)
        score = float(1 - d[best] / rest.min()) if len(rest) and rest.min() > 0 else float(not len(rest))
        return self.langs[best], min(1.0, max(0.0, score))


def predict_languages(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` but its text, and lang_pred and score.

    lang_pred is ``und`` with score 0 where the text is null or has no letter, or no language was learned. Equal
    distances go to the language that is first by code point. Columns that clash with the results are replaced.
    """
    from pyspark.sql import types as T

    keep = [c for c in docs.columns if c not in (text_col, "lang_pred", "score")]
    src = docs.select(*[F.col(f"`{c}`") for c in keep], whole(text_col).alias("__text"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        say = Identifier(profiles)
        for b in batches:
            got = [say(x.as_py()) for x in b.column(b.num_columns - 1)]
            cols = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *cols], names=[*keep, "lang_pred", "score"])

    return src.mapInArrow(work, schema)
