"""Settings, exclusions and charsets of a run: small values on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# Bounds and defaults of the settings.
BOUNDS = {"llm_failure_limit": (1, 20), "max_llm_per_file": (0, 20), "llm_min_sim": (0.0, 100.0), "content_sim_threshold": (10.0, 100.0)}
MOST_PATTERNS, LONGEST_PATTERN = 200, 300
# Thresholds of the phases.
HIGH, UNCERTAIN, ARBITER_MATCH, NAME_SIMILARITY, ARBITER_NAME = 85.0, 40.0, 70, 0.70, 0.80
# Charset names and their other spellings.
CHARSETS = (
    "auto", "utf-8", "utf-8-sig", "utf-16", "utf-16-le", "utf-16-be", "utf-32", "utf-32-le", "utf-32-be",
    "cp1252", "latin-1", "ascii", "shift_jis", "gb18030", "big5", "euc-kr",
)
SPELLINGS = {
    "automatic": "auto", "utf8": "utf-8", "utf8-sig": "utf-8-sig", "utf16": "utf-16", "utf16le": "utf-16-le", "utf16be": "utf-16-be",
    "utf32": "utf-32", "utf32le": "utf-32-le", "utf32be": "utf-32-be", "windows-1252": "cp1252", "windows1252": "cp1252",
    "latin1": "latin-1", "iso-8859-1": "latin-1", "sjis": "shift_jis", "shift-jis": "shift_jis",
}


@dataclass(frozen=True)
class Settings:
    llm_failure_limit: int = 3
    max_llm_per_file: int = 3
    llm_min_sim: float = 15.0
    content_sim_threshold: float = 60.0

    @classmethod
    def of(cls, given: dict | None) -> Settings:
        """Defaults with the known, readable values of ``given``, within their bounds."""
        changes = {}
        for name, (low, high) in BOUNDS.items():
            try:
                value = min(high, max(low, float((given or {})[name])))
            except (KeyError, TypeError, ValueError):
                continue
            changes[name] = round(value) if type(low) is int else value
        return replace(cls(), **changes)


@dataclass(frozen=True)
class Exclusions:
    files: tuple[str, ...] = ()
    dirs: tuple[str, ...] = ()

    @classmethod
    def of(cls, given: dict | None) -> Exclusions:
        """The usable patterns: trimmed, with forward slashes, of bounded number and length."""

        def patterns(name: str) -> tuple[str, ...]:
            raw = given.get(name) if isinstance(given, dict) else None
            texts = [p for p in (raw[:MOST_PATTERNS] if isinstance(raw, (list, tuple)) else ()) if isinstance(p, str)]
            texts = [p.strip().replace("\\", "/")[:LONGEST_PATTERN] for p in texts]
            return tuple(p for p in (t.rstrip("/") if name == "dirs" else t for t in texts) if p)

        return cls(patterns("files"), patterns("dirs"))


def charset(value: object) -> str:
    """The charset's usual name; ``auto`` for anything unknown."""
    name = value.strip().lower().replace("_", "-")[:40] if isinstance(value, str) else "auto"
    name = SPELLINGS.get(name, name)
    return name if name in CHARSETS else "auto"


@dataclass(frozen=True)
class Charsets:
    left: str = "auto"
    right: str = "auto"

    @classmethod
    def of(cls, given: dict | None) -> Charsets:
        given = given if isinstance(given, dict) else {}
        return cls(charset(given.get("left", "auto")), charset(given.get("right", "auto")))


@dataclass(frozen=True)
class Request:
    """What a comparison is asked for."""

    left: str
    right: str
    settings: Settings = field(default_factory=Settings)
    exclusions: Exclusions = field(default_factory=Exclusions)
    charsets: Charsets = field(default_factory=Charsets)

    @classmethod
    def of(cls, body: dict) -> Request:
        """Validate a request; a missing folder is a ValueError."""
        if not isinstance(body, dict):
            raise ValueError("the request must be an object")
        left, right = (str(body.get(k) or "").strip() for k in ("left_dir", "right_dir"))
        if not left or not right:
            raise ValueError("left_dir and right_dir are required")
        return cls(left, right, Settings.of(body.get("settings") if isinstance(body.get("settings"), dict) else None), Exclusions.of(body.get("exclusions")), Charsets.of(body.get("charsets")))
