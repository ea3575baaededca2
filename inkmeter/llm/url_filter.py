"""URL rules as a bit-parallel wildcard automaton.

All glob rules are packed side by side into the bits of a few 64-bit words. Bit j of a rule says that its
first j literals are matched; a step shifts every rule at once and masks by the character, and wildcards are
self-loops. A batch of URLs is stepped together, one character position at a time.

Globs: ``?`` one character, ``*`` any run without ``/``, ``**`` any run; everything else is itself.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A sample of (verdict, glob) for URLs that no listed rule covers: the first match decides, else the URL is allowed. A
#: real list is a table, see ``globs_of``.
DEFAULT_GLOBS = (
    ("block", "spam*"), ("block", "*spam-**"), ("block", "*-spam*"), ("block", "*.spam*"), ("block", "*casino**"),
    ("block", "*porn**"), ("block", "*.xxx"), ("block", "*.xxx/**"), ("block", "**/wp-login.php"),
)


@dataclass(frozen=True)
class Rule:
    """``host/path``: fits the host and all its subdomains where the path starts with the rule's."""

    verdict: str
    prefix: str

    def globs(self) -> tuple[str, str]:
        return f"{self.prefix}**", f"*.{self.prefix}**"


class Automaton:
    """Multiword Shift-And over code points; code points of no rule share one column of the masks."""

    def __init__(self, globs: Sequence[str]):
        parsed = [self._parse(g) for g in globs]
        self.n = sum(len(p) + 1 for p in parsed)
        self.words = max(1, -(-self.n // 64))
        known = sorted({c for p in parsed for c, _ in p[1:] if c is not None} | {"/"})
        self.codes = np.array([ord(c) for c in known], np.int64)
        width = len(known) + 1  # the last: any other character
        self.step, self.loop = np.zeros((width, self.words), np.uint64), np.zeros((width, self.words), np.uint64)
        self.init, self.final = np.zeros(self.words, np.uint64), []
        at = 0
        for p in parsed:
            for j, (c, star) in enumerate(p):
                w, bit = divmod(at + j, 64)
                bit = np.uint64(1) << np.uint64(bit)
                if j == 0:
                    self.init[w] |= bit
                else:
                    cols = range(width) if c is None else [known.index(c)]
                    for k in cols:
                        self.step[k, w] |= bit
                for k in range(width):
                    if star == 2 or star == 1 and not (k < len(known) and known[k] == "/"):
                        self.loop[k, w] |= bit
            at += len(p)
            self.final.append(at - 1)

    @staticmethod
    def _parse(glob: str) -> list[tuple[str | None, int]]:
        """(literal, wildcard after it), the first literal empty. None: any character."""
        out: list[tuple[str | None, int]] = [("", 0)]
        i = 0
        while i < len(glob):
            if glob[i] == "*":
                star = 2 if glob[i : i + 2] == "**" else 1
                out[-1] = (out[-1][0], max(out[-1][1], star))
                i += star
            else:
                out.append((None if glob[i] == "?" else glob[i], 0))
                i += 1
        return out

    def match(self, texts: Sequence[str]) -> np.ndarray:
        """Boolean matrix: text by glob."""
        n = len(texts)
        final = np.zeros((n, self.words), np.uint64)
        if not n:
            return np.zeros((0, len(self.final)), bool)
        size = np.array([len(t) for t in texts])
        order = np.argsort(-size, kind="stable")
        flat = np.frombuffer("".join([texts[i] for i in order]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        col = np.searchsorted(self.codes, flat)
        col[(col == len(self.codes)) | (self.codes[np.minimum(col, len(self.codes) - 1)] != flat)] = len(self.codes)
        lens = size[order]
        start = np.concatenate([[0], np.cumsum(lens)[:-1]])
        state = np.repeat(self.init[None, :], n, axis=0)
        one, top = np.uint64(1), np.uint64(63)
        live = n
        for pos in range(int(lens[0]) + 1):
            ended = int(np.searchsorted(-lens[:live], -pos, side="left"))  # rows with no character left
            final[ended:live] = state[ended:live]
            live = ended
            if not live:
                break
            s, c = state[:live], col[start[:live] + pos]
            shifted = s << one
            shifted[:, 1:] |= s[:, :-1] >> top
            state[:live] = (shifted & self.step[c]) | (s & self.loop[c])
        out = np.empty((n, len(self.final)), bool)
        for k, bit in enumerate(self.final):
            w, b = divmod(bit, 64)
            out[order, k] = (final[:, w] >> np.uint64(b)) & one != 0
        return out


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


#: Globs that a list may have: all of them are packed into the masks of every worker.
MOST_GLOBS = 20_000


def globs_of(table: DataFrame, order: str = "priority", verdict: str = "verdict", glob: str = "glob") -> list[tuple[str, str]]:
    """The rows of a glob list by ``order``, ties by glob; null globs and those of another verdict than allow or block go.

    A list of more than ``MOST_GLOBS`` raises ``ValueError``.
    """
    rows = table.filter(F.col(glob).isNotNull() & F.col(verdict).isin("allow", "block")).orderBy(order, glob).select(verdict, glob).limit(MOST_GLOBS + 1).collect()
    if len(rows) > MOST_GLOBS:
        raise ValueError(f"more than {MOST_GLOBS} globs")
    return [(r[0], r[1]) for r in rows]


#: Characters of canonical URLs that are stepped together.
SLICE = 4_000_000


def filter_urls(pages: DataFrame, rules: Sequence[Rule], globs: Sequence[tuple[str, str]] = DEFAULT_GLOBS, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, glob for every row.

    The longest rule that fits decides. Where none fits, rule is null and the first of ``globs`` that matches
    the canonical URL (host and path) decides; glob names it. Else the verdict is allow. A null URL, or one
    without ``://``, has an empty host and path. Equal rows give equal rows; an empty table gives none.
    """
    order = sorted(rules, key=lambda r: (len(r.prefix), r.prefix))
    patterns = [g for r in order for g in r.globs()] + [g for _, g in globs]
    machine = Automaton(patterns)
    url = F.col(url_col).cast("string")
    src = pages.select(F.col(id_col), host_of(url).alias("host"), path_of(url).alias("path"))
    schema = T.StructType([*src.schema.fields, *(T.StructField(c, T.StringType()) for c in ("rule", "verdict", "glob"))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([r.prefix for r in order] + [None], object)
        says = np.array([r.verdict for r in order] + [None], object)
        for b in batches:
            canon = [h + p for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True)]
            hit = np.empty((len(canon), len(patterns)), bool)
            a = 0
            while a < len(canon):  # slices of bounded size, whatever the URLs' lengths
                z, room = a, SLICE
                while z < len(canon) and (z == a or room >= len(canon[z])):
                    room -= len(canon[z])
                    z += 1
                hit[a:z] = machine.match(canon[a:z])
                a = z
            rule = np.full(len(canon), len(order))
            for k in range(len(order)):  # from short to long: the longest stays
                rule[hit[:, 2 * k] | hit[:, 2 * k + 1]] = k
            verdict, glob = says[rule], np.full(len(canon), None, object)
            for k in range(len(globs) - 1, -1, -1):
                m = hit[:, 2 * len(order) + k] & (rule == len(order))
                verdict[m], glob[m] = globs[k]
            verdict[(rule == len(order)) & np.equal(glob, None)] = "allow"
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.string()) for x in (names[rule], verdict, glob))], names=[*b.schema.names, "rule", "verdict", "glob"])

    return src.mapInArrow(work, schema)
