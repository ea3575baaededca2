"""Dictionaries, instructions, voices and presets kept as JSON files, and a repository's own configuration.

Small control tables: written by the driver, read back as DataFrames where they are joined.
"""

from __future__ import annotations

import json
import os
import random
from dataclasses import dataclass, field
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as V
from ..functions.text import sanitize_plain
from ..operators.lexicon import dedupe_words, remove_word

# fixed values: file names of a repository's configuration, in order, and the alphabet of short ids
CONFIG_NAMES = ("prose.config.json", ".proserc.json", ".proserc")
SHORT_ALPHABET = "ABCDEFGHJKMNPQRSTUVWXYZ23456789"
GLOBAL, TEAM = "global", "team"


def home(env: str = "INKMETER_HOME") -> Path:
    return Path(os.environ.get(env) or Path.home() / ".inkmeter")


def short_id(n: int = 5) -> str:
    return "".join(random.choice(SHORT_ALPHABET) for _ in range(n))


def _now() -> str:
    return datetime.now(UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")


class JsonMap:
    """A JSON object on disk; a missing or damaged file is empty."""

    def __init__(self, path: Path):
        self.path = Path(path)

    def load(self) -> dict:
        try:
            got = json.loads(self.path.read_text())
        except (OSError, ValueError):
            return {}
        return got if isinstance(got, dict) else {}

    def save(self, data: dict) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.path.write_text(json.dumps(data, indent=2, ensure_ascii=False))


class Dictionaries:
    """Banned and allowed words by scope: global, or a style's id."""

    def __init__(self, folder: Path):
        self.file = JsonMap(Path(folder) / "dictionaries.json")

    def get(self, scope: str = GLOBAL) -> dict:
        return self.file.load().get(scope) or {"banned": [], "custom": [], "updatedAt": "1970-01-01T00:00:00.000Z"}

    def _change(self, scope: str, kind: str, change) -> dict:
        data = self.file.load()
        d = self.get(scope)
        d[kind] = change(d[kind])
        d["updatedAt"] = _now()
        data[scope] = d
        self.file.save(data)
        return d

    def add(self, word: str, kind: str = "banned", scope: str = GLOBAL) -> dict:
        if not word.strip():
            raise ValueError("a word must not be blank")
        return self._change(scope, kind, lambda words: dedupe_words([*words, word]))

    def remove(self, word: str, kind: str = "banned", scope: str = GLOBAL) -> dict:
        return self._change(scope, kind, lambda words: remove_word(words, word))

    def merged(self, style: str | None = None) -> tuple[list[str], list[str]]:
        """Banned and allowed words, global ones first."""
        scopes = [self.get(GLOBAL), *([self.get(style)] if style and style != GLOBAL else [])]
        return dedupe_words(w for d in scopes for w in d["banned"]), dedupe_words(w for d in scopes for w in d["custom"])

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(scope, kind, n, w) for scope, d in self.file.load().items() for kind in ("banned", "custom") for n, w in enumerate(d.get(kind, []))]
        return spark.createDataFrame(rows, "scope string, kind string, ord int, word string")


class Instructions:
    def __init__(self, folder: Path):
        self.file = JsonMap(Path(folder) / "instructions.json")

    def get(self, scope: str = GLOBAL) -> str:
        return (self.file.load().get(scope) or {}).get("instructions", "")

    def set(self, text: str, scope: str = GLOBAL) -> str:
        clean = sanitize_plain(text.strip())
        data = self.file.load()
        data[scope] = {"instructions": clean, "updatedAt": _now()}
        self.file.save(data)
        return clean

    def clear(self, scope: str = GLOBAL) -> None:
        data = self.file.load()
        data.pop(scope, None)
        self.file.save(data)


def merge_instructions(*texts: str | None) -> str:
    return "\n\n".join(t.strip() for t in texts if t and t.strip())


class Voices:
    """One JSON file per voice."""

    def __init__(self, folder: Path):
        self.folder = Path(folder) / "voices"

    def save(self, voice: dict) -> dict:
        self.folder.mkdir(parents=True, exist_ok=True)
        voice = voice | {"updatedAt": _now(), "shortId": voice.get("shortId") or self._free_id()}
        (self.folder / f"{voice['id']}.json").write_text(json.dumps(voice, indent=2, ensure_ascii=False))
        return voice

    def _free_id(self) -> str:
        taken = {v.get("shortId") for v in self.list()}
        while (s := short_id()) in taken:
            pass
        return s

    def list(self) -> list[dict]:
        got = [json.loads(p.read_text()) for p in sorted(self.folder.glob("*.json"))] if self.folder.is_dir() else []
        return sorted(got, key=lambda v: v.get("updatedAt", ""), reverse=True)

    def get(self, ref: str) -> dict | None:
        """By id, then by short id in any case, then by name."""
        voices = self.list()
        for test in (lambda v: v["id"] == ref, lambda v: v.get("shortId") == ref.upper(), lambda v: v.get("name", "").strip().lower() == ref.strip().lower()):
            if hit := next((v for v in voices if test(v)), None):
                return hit
        return None

    def delete(self, voice_id: str) -> bool:
        p = self.folder / f"{voice_id}.json"
        if found := p.exists():
            p.unlink()
        return found


def voices_table(spark: SparkSession, folder: str) -> DataFrame:
    """Stored voices as rows, the latest first; fields that older files lack are null."""
    schema = "id string, shortId string, name string, sampleCount long, updatedAt string, stats map<string,double>"
    return spark.read.schema(schema).option("multiLine", "true").json(folder).orderBy(F.col("updatedAt").desc())


@dataclass
class RepoConfig:
    banned: list[str] = field(default_factory=list)
    allowed: list[str] = field(default_factory=list)
    register: str | None = None
    threshold: str | None = None
    instructions: str | None = None
    style: dict | None = None
    path: str | None = None


def parse_config(raw: dict, path: str | None = None) -> RepoConfig:
    """Validate a repository's configuration; anything malformed raises ``ValueError``."""
    if not isinstance(raw, dict):
        raise ValueError("the configuration must be an object")

    def words(key: str) -> list[str]:
        got = raw.get(key, [])
        if not isinstance(got, list) or not all(isinstance(w, str) for w in got):
            raise ValueError(f"{key} must be a list of strings")
        return got

    def one_of(key: str, of: tuple[str, ...]) -> str | None:
        got = raw.get(key)
        if got is not None and got not in of:
            raise ValueError(f"{key} must be one of {', '.join(of)}")
        return got

    if not isinstance(raw.get("instructions", ""), str):
        raise ValueError("instructions must be a string")
    style = raw.get("style")
    if style is not None:
        if not isinstance(style, dict) or not isinstance(style.get("name"), str) or not style["name"].strip():
            raise ValueError("style.name must be a string that isn't empty")
        if not isinstance(style.get("dials"), dict):
            raise ValueError("style.dials must be an object")
        dials = {}
        for k in (*V.PERSONA_LINES, *V.DIALS):
            v, top = style["dials"].get(k), 10 if k in V.PERSONA_LINES else 100
            if isinstance(v, bool) or not isinstance(v, int | float) or not 0 <= v <= top:
                raise ValueError(f"style.dials.{k} must be a number from 0 to {top}")
            dials[k] = v
        style = {"name": style["name"].strip(), "dials": dials}
    return RepoConfig(words("bannedWords"), words("allowedWords"), one_of("register", V.REGISTERS), one_of("threshold", V.TIERS), raw.get("instructions"), style, path)


def find_config(folder: str, names: tuple[str, ...] = CONFIG_NAMES) -> RepoConfig | None:
    """The nearest configuration from ``folder`` upward, not beyond the folder that holds .git."""
    here = Path(folder).resolve()
    for d in (here, *here.parents):
        for n in names:
            if (p := d / n).is_file():
                try:
                    return parse_config(json.loads(p.read_text()), str(p))
                except ValueError as e:
                    raise ValueError(f"{p}: {e}") from e
        if (d / ".git").exists():
            break
    return None
