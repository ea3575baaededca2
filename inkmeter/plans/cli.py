"""The command line: ``python -m inkmeter.plans.cli lint PATTERN...``"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass, field

from ..functions import fixed as V
from . import report

USAGE = "\n".join(
    [
        "Usage: lint <pattern...> [options]",
        "",
        "Audits each matched file. Exits with 1 if a file's tier is at or above the threshold, 2 if nothing matched.",
        "",
        f"  --threshold <tier>    {' | '.join(V.TIERS)} (default: the repository's configuration, else orange)",
        f"  --register <register> {' | '.join(V.REGISTERS)}",
        "                        (default: the repository's configuration, else docs for .md and .mdx files)",
        "  --json                one JSON report instead of text",
        "  --help, -h            this message",
    ]
)


@dataclass
class LintArgs:
    patterns: list[str] = field(default_factory=list)
    threshold: str | None = None
    register: str | None = None
    as_json: bool = False
    help: bool = False


def parse_lint_args(argv: Sequence[str]) -> LintArgs:
    """What stands after ``lint``; anything wrong raises ``ValueError``."""
    out, rest = LintArgs(), list(argv)
    named = {"--threshold": ("threshold", V.TIERS), "--register": ("register", V.REGISTERS)}
    while rest:
        arg = rest.pop(0)
        if arg in ("--help", "-h"):
            return LintArgs(help=True)
        if arg in named:
            key, allowed = named[arg]
            value = rest.pop(0) if rest else None
            if value not in allowed:
                raise ValueError(f'Invalid {arg} "{value}". Expected one of: {", ".join(allowed)}.')
            setattr(out, key, value)
        elif arg == "--json":
            out.as_json = True
        elif arg.startswith("--"):
            raise ValueError(f'Unknown flag "{arg}".')
        else:
            out.patterns.append(arg)
    if not out.patterns:
        raise ValueError("Nothing to lint: pass at least one file or glob pattern.")
    return out


def main(argv: Sequence[str], spark=None, cwd: str = ".") -> int:
    if not argv or argv[0] != "lint":
        print(USAGE, file=sys.stderr)
        return 2
    try:
        args = parse_lint_args(argv[1:])
        if args.help:
            print(USAGE)
            return 0
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("lint").getOrCreate()
        text, code = report.run(spark, args.patterns, None, args.threshold, args.register, args.as_json, cwd=cwd)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    print(text, file=sys.stderr if code == 2 else sys.stdout)
    return code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
