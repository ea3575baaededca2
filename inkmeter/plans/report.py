"""The lint run over files, and its report as text or JSON."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions import text as X
from ..operators import audit as A
from ..operators import lexicon as L
from ..operators import lint as LI
from ..sources.files import read_files
from ..sources.stores import find_config


def lint(files: DataFrame, lexicon: L.Lexicon, register: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, findings) of ``files`` (path, text): one Spark plan for all files.

    Findings are the scored ones, with line and column of each match, equal spans merged, in groups: all of
    them; only the text report leaves some out.
    """
    docs = files.select(F.col("path").alias("doc_id"), "text", LI.register_for(F.col("path"), register).alias("register"))
    results, found = A.audit(docs, lexicon)
    clean = docs.withColumn("text", X.strip_code(F.coalesce("text", F.lit(""))))
    entries = L.with_spans(L.findings(clean, lexicon, register_col="register"), clean).filter("scored")
    cols = ["doc_id", "ord", "term", "category", "subcategory", "confidence", "severity", "count", "scored", "hint", "note", "matches"]
    merged = LI.merge_duplicate_spans(entries.select(cols)).select(cols)
    whole = found.filter("ord >= 100000").withColumn("matches", F.lit(None).cast(dict(merged.dtypes)["matches"])).select(cols)
    shown = LI.grouped(merged.unionByName(whole), cap=None)
    sizes = merged.unionByName(whole).groupBy("doc_id").agg(F.count(F.lit(1)).alias("finding_count"))
    return results.join(sizes, "doc_id", "left").na.fill({"finding_count": 0}), shown


def wrap(text: str, indent: str, width: int = 76) -> list[str]:
    """Words filled greedily into lines of a width, indent included."""
    lines: list[str] = []
    for word in text.split():
        if lines and len(lines[-1]) + 1 + len(word) <= width:
            lines[-1] += f" {word}"
        else:
            lines.append(indent + word)
    return lines


def _count(n: int, what: str) -> str:
    return f"{n} {what}{'' if n == 1 else 's'}"


def _rows(group: list, lexical: bool) -> list[str]:
    def label(f) -> str:
        base = f"{f['term']} ({f['subcategory']})" if "," in f["subcategory"] else f["term"]
        return base + (f" ×{f['count']}" if f["count"] > 1 else "")

    place = lambda f: f"L{f['matches'][0]['line']}:C{f['matches'][0]['col']}" if f["matches"] else ""
    wide, far = (max(map(len, map(label, group))), max(map(len, map(place, group)))) if lexical else (0, 0)
    out = []
    for f in group:
        if lexical:
            line = f"    {f['severity']:<8}{label(f):<{wide}}  {place(f):<{far}}" + (f"  → {f['hint']}" if f["hint"] else "")
        else:
            line = f"    {f['severity']:<8}{f['subcategory']}" + (f" ×{f['count']}" if f["count"] > 1 else "")
        out += [line.rstrip(), *(wrap(f["note"], " " * 12) if f["note"] else [])]
    return out


def by_file(findings: Sequence[dict]) -> dict[str, list[dict]]:
    """The findings of each file, in the order of the report."""
    out: dict[str, list[dict]] = {}
    for f in sorted(findings, key=lambda f: (f["doc_id"], f["group_nth"], f["nth"])):
        out.setdefault(f["doc_id"], []).append(f)
    return out


def format_text(results: Sequence[dict], findings: Sequence[dict], threshold: str = "orange", config: str | None = None) -> str:
    """The report of collected rows, file by file."""
    bad = {r["doc_id"] for r in results if V.TIERS.index(r["tier"]) >= V.TIERS.index(threshold)}
    found = by_file(findings)
    out = [f"Using config: {config}", ""] if config else []
    for r in sorted(results, key=lambda r: r["doc_id"]):
        note = f", register: {r['register']}" if r["register"] != "general" else ""
        out.append(f"{'✗' if r['doc_id'] in bad else '✓'} {r['doc_id']}  {r['tier'].upper()} {r['score']}/100  ({_count(r['finding_count'], 'finding')}, {_count(r['word_count'], 'word')}{note})")
        out += wrap(r["summary"], "  ")
        body: list[str] = []
        own = found.get(r["doc_id"], [])
        for name in dict.fromkeys(f["grp"] for f in own):
            group = [f for f in own if f["grp"] == name]
            shown = group[: V.LEXICAL_CAP] if name == V.LEXICAL_GROUP else group
            body += [f"  {name}", *_rows(shown, name == V.LEXICAL_GROUP)]
            if len(group) > len(shown):
                body.append(f"    …and {len(group) - len(shown)} more (use --json for the full list)")
            body.append("")
        if r["word_count"] >= V.RELIABLE_WORDS:
            body.append(f"  strengths  specificity {r['specificity']:.1f}/1k · concrete:abstract {r['concrete_abstract']:.2f} · burstiness {r['burstiness']:.2f}")
            for n in r["notes"]:
                body += wrap(n, " " * 13)
        elif r["word_count"]:
            body.append(f"  strengths  not enough text to measure ({_count(r['word_count'], 'word')})")
        out += ([""] if body else []) + body + [""]
    out.append(f"{_count(len(results), 'file')} audited, {len(bad)} at or above {threshold}.")
    return "\n".join(out)


def format_json(results: Sequence[dict], findings: Sequence[dict], threshold: str = "orange", config: str | None = None) -> str:
    bad = sum(V.TIERS.index(r["tier"]) >= V.TIERS.index(threshold) for r in results)
    found = by_file(findings)
    files = [dict(r) | {"findings": found.get(r["doc_id"], [])} for r in sorted(results, key=lambda r: r["doc_id"])]
    return json.dumps({"threshold": threshold, "configPath": config, "failingCount": bad, "files": files}, indent=2, ensure_ascii=False)


#: Files whose report is made on the driver; beyond it the report is written by ``write_json``.
CONSOLE_FILES = 50_000


def run(
    spark: SparkSession, globs: Sequence[str], lexicon: L.Lexicon | None = None, threshold: str | None = None, register: str | None = None, as_json: bool = False, config: str | None = None, cwd: str = ".",
    hard_terms: Sequence[tuple] = V.HARD_TERMS,
) -> tuple[str, int]:
    """(report, exit code): 0 fine, 1 with a file at or above the threshold, 2 without a file.

    A repository's configuration at or above ``cwd`` gives words, register and threshold where no argument does; a
    malformed one raises ``ValueError``. ``lexicon``: in place of the built-in one with the configured words. More than
    ``CONSOLE_FILES`` files raise ``ValueError``: their report belongs in a table.
    """
    repo = find_config(cwd)
    if repo is not None:
        threshold, register, config = threshold or repo.threshold, register or repo.register, config or repo.path
    if lexicon is None:
        lexicon = L.Lexicon.of(L.builtin_entries(hard_terms), repo.banned if repo else (), repo.allowed if repo else ())
    files = read_files(spark, globs, cwd)
    results, found = lint(files, lexicon, register)
    rows = [r.asDict(True) for r in results.limit(CONSOLE_FILES + 1).collect()]  # one small row a linted file
    if not rows:
        return f"No files matched: {', '.join(globs)}", 2
    if len(rows) > CONSOLE_FILES:
        raise ValueError(f"more than {CONSOLE_FILES} files: use lint and write_json")
    threshold = threshold or "orange"
    text = (format_json if as_json else format_text)(rows, [f.asDict(True) for f in found.collect()], threshold, config)
    return text, int(any(V.TIERS.index(r["tier"]) >= V.TIERS.index(threshold) for r in rows))


def write_json(results: DataFrame, findings: DataFrame, path: str) -> None:
    """One JSON object a file, with its findings in order, written by the executors."""
    cols = [c for c in findings.columns if c != "doc_id"]
    listed = findings.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("group_nth", "nth", *[c for c in cols if c not in ("group_nth", "nth")]))).alias("findings"))
    results.join(listed, "doc_id", "left").write.json(path)
