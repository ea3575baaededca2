"""Text primitives as native columns: regex dialect, rounding, tokenizers, splitters, spans.

Everything here stays in the JVM. Patterns are written once, in a neutral dialect with inline flags, and turned
into Java's by ``java``; ``re2`` gives the form for an engine without lookaround.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed as V

#: White space as the reference dialect has it, as members of a character class.
WS_MEMBERS = r"\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS, NOT_WS = f"[{WS_MEMBERS}]", f"[^{WS_MEMBERS}]"
#: The same characters, for native trimming.
WS_CHARS = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
BOUNDARY = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"  # ASCII word characters only
#: A run of anything else; visible ASCII characters, nearly all there are, are told by one look-up.
WORD_RUN = f"(?:[!-~]++|{NOT_WS}++)++"


def _atom_end(body: str, i: int) -> int:
    """Where the atom of a pattern that starts at ``i`` ends: a character, an escape, a class or a group."""
    if body[i] == "\\":
        return i + 2
    if body[i] == "[":
        i += 1 + (body[i + 1] == "^")
        while body[i] != "]":
            i += 1 + (body[i] == "\\")
        return i + 1
    if body[i] != "(":
        return i + 1
    i += 1
    while body[i] != ")":
        i = _atom_end(body, i)
    return i + 1


def _alternatives(body: str) -> list[str]:
    """The alternatives of a pattern's outermost level, up to its end or an unmatched bracket."""
    parts, start, at = [], 0, 0
    while at < len(body) and body[at] != ")":
        if body[at] == "|":
            parts.append(body[start:at])
            at = start = at + 1
        else:
            at = _atom_end(body, at)
    return [*parts, body[start:at]]


def first_words(body: str) -> set[str] | None:
    """The word characters (or classes of them) with which a match can begin; None where it may begin otherwise."""
    if not body:
        return None
    end = _atom_end(body, 0)
    if body[end : end + 1] in ("?", "*") or body[end : end + 2] == "{0":
        return None
    if body[0] == "\\":
        return {body[:2]} if body[1] in "wd" else None
    if body[0] != "(":
        return {body[0]} if re.fullmatch(r"\w", body[0], re.A) else None
    if body[1] == "?" and body[2] != ":":
        return None
    firsts = [first_words(x) for x in _alternatives(body[3 if body[1] == "?" else 1 :])]
    return None if None in firsts else set().union(*firsts)


def _lead(body: str) -> tuple[str, str]:
    """What a match surely begins with, as a cheap test, and the rest of the pattern.

    Where every alternative begins at a boundary before a word character, the boundary is one look back, tried only
    before the characters that can follow.
    """
    parts = _alternatives(body)
    if sum(map(len, parts)) + len(parts) - 1 != len(body):
        return "", body
    firsts = [first_words(x[2:]) if x.startswith("\\b") else None for x in parts]
    if None in firsts:
        return "", body
    return f"(?=[{''.join(sorted(set().union(*firsts)))}])(?<!\\w)", "(?:" + "|".join(x[2:] for x in parts) + ")"


_CAPITAL, _TITLE_WORD = "[A-Z][a-z]+", "(?:[A-Z][a-z]+|and|or|of|the|in|for|to|a|an)"
#: Patterns that repeat a group of alternatives, and forms with the same matches whose loops give nothing back: Java
#: recurses for every round that it may have to undo, so a run of some thousand title words overflowed the stack.
#: A title is its first two words, then stretches that each end in a capitalised word before a line's end.
_FLAT = {
    rf"(?m)^({_CAPITAL}(?:\s+{_TITLE_WORD})+\s+{_CAPITAL})\s*$": (
        rf"(?m)^({_CAPITAL}\s++{_TITLE_WORD}(?!\S)(?:(?:\s++(?!{_CAPITAL}\s*$){_TITLE_WORD}(?!\S))*+\s++{_CAPITAL}(?=\s*$))++)\s*$"
    ),
}


def java(pattern: str) -> str:
    """A neutral pattern in Java's dialect: ASCII boundaries, Unicode white space, strict end of text."""
    pattern = _FLAT.get(pattern, pattern)
    m = re.match(r"\(\?([a-z]+)\)", pattern)
    flags = m.group(1) if m else ""
    lead, body = _lead(pattern[m.end() :] if m else pattern)
    out, i, in_class = [lead], 0, False
    while i < len(body):
        c = body[i]
        if c == "\\":
            two = body[i : i + 2]
            i += 2
            if two == r"\s":
                out.append(WS_MEMBERS if in_class else WS)
            elif two == r"\S":
                out.append(NOT_WS)
            elif two == r"\b":
                out.append(BOUNDARY)
            else:
                out.append(two)
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "]" and in_class:
            in_class = False
        elif c == "$" and not in_class and "m" not in flags:
            c = r"\z"
        out.append(c)
        i += 1
    flags = flags.replace("m", "md")
    return (f"(?{flags})" if flags else "") + "".join(out)


def re2(pattern: str) -> str:
    """The same where lookaround is missing; the lookahead of the one pattern that has one is redundant."""
    return pattern.replace("(?!,)", "")


def rx(pattern: str) -> Column:
    return F.lit(java(pattern))


def fixed(x: Column, digits: int) -> Column:
    """Rounded to so many decimals, ties up."""
    return F.floor(x * F.lit(10.0**digits) + F.lit(0.5)) / F.lit(10.0**digits)


def nearest(x: Column) -> Column:
    """To an integer, ties toward plus infinity."""
    return F.floor(x + F.lit(0.5))


def trim(x: Column) -> Column:
    return F.btrim(x, F.lit(WS_CHARS))


def occurrences(text: Column, character: str) -> Column:
    """How often one character occurs."""
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def blank(m: Column) -> Column:
    return F.regexp_replace(m, r"[^\n]", " ")


def replace_each(text: Column, pattern: str, change) -> Column:
    """Every match replaced by ``change`` of it; what is between matches stays."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    return F.array_join(F.zip_with(between, F.transform(found, change), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")


def strip_code(text: Column) -> Column:
    """Fenced blocks, then inline spans, blanked in place; line breaks and the length stay."""
    has = lambda t, *marks: functools.reduce(lambda a, b: a | b, [F.contains(t, F.lit(m)) for m in marks])
    fenced = F.when(has(text, "```", "~~~"), replace_each(text, r"(?s)```.*?```|~~~.*?~~~", blank)).otherwise(text)
    return F.when(has(text, "`"), replace_each(fenced, r"`[^`\n]+`", blank)).otherwise(fenced)


def sanitize(text: Column) -> Column:
    """Terminal escapes go, then control characters but tab and line ends."""
    for pattern in V.UNPRINTABLE:
        text = F.regexp_replace(text, pattern, "")
    return text


def sanitize_plain(text: str) -> str:
    """The same for one text on the driver."""
    for pattern in V.UNPRINTABLE:
        text = re.sub(pattern, "", text)
    return text


# tokenizers, each with its own use
def ws_words(text: Column) -> Column:
    t = trim(text)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, f"{WS}+", -1))


def ws_word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD_RUN))


def even_word_count(line: Column) -> Column:
    """Words of a trimmed line whose white space is single spaces."""
    return F.when(line == "", F.lit(0)).otherwise(occurrences(line, " ") + 1)


def alpha_words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(V.WORD), F.lit(0))


def alnum_count(text: Column) -> Column:
    return F.greatest(F.lit(1), F.regexp_count(text, F.lit(V.ALNUM)))


def content_words(text: Column) -> Column:
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*V.FACT_STOPWORDS))


def opener(text: Column, n: int = V.OPENER_WORDS) -> Column:
    words = F.regexp_extract_all(text, F.lit("[A-Za-z']+"), F.lit(0))
    return F.array_join(F.transform(F.slice(words, 1, n), F.lower), " ")


# splitters
#: The scan's matches in linear time: what closes no sentence is passed over as a whole, with an empty group.
SCAN = f"([^.!?]++(?:[.!?]++(?:{WS}++|\\z)|\\z))|[^.!?]++[.!?]++"
#: White space that isn't a lone space already.
UNEVEN_SPACE = f"(?![!-~])(?: {WS}++|[{WS_MEMBERS.replace(' ', '')}]{WS}*+)"


def sentences_scan(text: Column) -> Column:
    """By a scan for closed sentences; text between a lone mark and what follows it is lost, as defined."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(SCAN), F.lit(1)), trim)
    return F.filter(parts, lambda s: s != "")


def sentence_count(trimmed: Column) -> Column:
    """How many sentences the scan finds in a trimmed text: a lone mark's stretch, the third kind of match, is none."""
    return F.size(F.array_remove(F.regexp_extract_all(trimmed, F.lit(SCAN), F.lit(1)), ""))


def sentences_boundary(text: Column) -> Column:
    """By white space after a closing mark and before a capital, digit or quote; white space within is one space."""
    one_line = trim(F.regexp_replace(text, UNEVEN_SPACE, " "))
    return F.when(one_line == "", F.array().cast("array<string>")).otherwise(F.split(one_line, r" (?<=[.!?] )(?=[A-Z0-9\"'])", -1))


def paragraphs(text: Column, delimiter: str = r"\n\s*\n") -> Column:
    parts = F.transform(F.split(text, java(delimiter), -1), trim)
    return F.filter(parts, lambda p: p != "")


# arithmetic over arrays of integers, from exact moments
def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


def moments(a: Column) -> Column:
    """n, s, s2: number, sum and sum of squares, in one pass."""
    long = lambda x: x.cast("long")
    zero = F.struct(long(F.lit(0)).alias("s"), long(F.lit(0)).alias("s2"))
    add = lambda m, x: F.struct((m["s"] + x).alias("s"), (m["s2"] + long(x) * x).alias("s2"))
    return F.aggregate(a, zero, add, lambda m: F.struct(long(F.size(a)).alias("n"), m["s"].alias("s"), m["s2"].alias("s2")))


def deviation(n: Column, s: Column, s2: Column) -> Column:
    """Population deviation; 0 for fewer than two."""
    return F.when(n < 2, F.lit(0.0)).otherwise(F.sqrt((n * s2 - s * s).cast("double")) / n)


def variation(n: Column, s: Column, s2: Column) -> Column:
    """Coefficient of variation; 1 for fewer than two, 0 for a mean of zero."""
    return F.when(n < 2, F.lit(1.0)).when(s == 0, F.lit(0.0)).otherwise(F.sqrt((n * s2 - s * s).cast("double")) / s)


# spans
def spans(text: Column, pattern: Column) -> Column:
    """start and end, in code points from 0, of every match; one pass over the matches."""
    found = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    between = F.transform(F.split(text, pattern, -1), F.length)
    steps = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("gap"), found.alias("size"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    begun = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def add(a, x):
        at = a["at"] + x["gap"]
        return F.struct((at + x["size"]).alias("at"), F.array_append(a["out"], F.struct(at.alias("start"), (at + x["size"]).alias("end"))).alias("out"))

    return F.aggregate(steps, begun, add, lambda a: a["out"])


def sentence_start(text: Column, at: Column) -> Column:
    """Whether only white space lies between ``at`` and a closing mark or the start."""
    before = F.regexp_replace(F.substring(text, F.lit(1), at), f"{WS}+\\z", "")
    return (before == "") | F.substring(before, -1, 1).isin(".", "!", "?")


def line_of(text: Column, at: Column) -> Column:
    return (F.lit(1) + occurrences(F.substring(text, F.lit(1), at), "\n")).cast("int")


def column_of(text: Column, at: Column) -> Column:
    return (F.length(F.substring_index(F.substring(text, F.lit(1), at), "\n", -1)) + 1).cast("int")


def filled(template: str, *values) -> Column:
    """A text with its ``{}`` replaced by columns, in order; a null value makes it null."""
    parts = template.split("{}")
    cols = [F.lit(parts[0])]
    for v, after in zip(values, parts[1:], strict=True):
        cols += [(F.col(v) if isinstance(v, str) else v).cast("string"), F.lit(after)]
    return F.concat(*cols)


def quote(term: str) -> str:
    """A term as a pattern that matches just itself."""
    return re.sub(r"[.*+?^${}()|\[\]\\]", lambda m: "\\" + m.group(0), term)
