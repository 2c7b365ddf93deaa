"""Pairwise scores: matching-blocks ratios, blends, and their upper bounds.

Ratios are those of matching blocks found longest first (``difflib``), which no native
function gives; everything that a pair does not need is a feature of one file, made
once.  ``ratio <= quick <= length`` bounds hold for any pair, so they prune exactly.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrow, text
from .profile import language_of

# Blends, caps and cost limits.
TOKEN_SHARE, IDENTIFIER_SHARE, NAME_WEIGHT, CONTENT_WEIGHT = 0.60, 0.40, 30.0, 0.70
CHUNK, BINARY_CAP, COST_LIMIT = 16, 65_536, 8_000_000
HIGH, MEDIUM = 85, 40

# Declarations of each language.
TYPES = r"\b(?:class|interface|enum|record)\s+(\w+)"
METHODS = r"(?:public|private|protected|static|final|abstract|synchronized|native|\s)+[\w<>\[\],\s]+\s+(\w+)\s*\("
DECLARED = {
    ("Java", "C#", "Kotlin", "Scala"): (TYPES, METHODS),
    ("C", "C++", "CUDA", "OpenCL", "Objective-C"): (TYPES, r"\b(\w+)\s*\([^)]*\)\s*\{"),
    ("Rust",): (r"\bfn\s+(\w+)", r"\b(?:struct|enum|trait)\s+(\w+)", r"\bimpl(?:<[^>]+>)?\s+(\w+)"),
    ("Go",): (r"\bfunc\s+(?:\(\w+\s+\*?\w+\)\s+)?(\w+)",),
    ("Python",): (r"\bclass\s+(\w+)", r"\bdef\s+(\w+)"),
    ("JavaScript", "TypeScript"): (r"\bfunction\s+(\w+)", r"\bclass\s+(\w+)", r"(?:const|let|var)\s+(\w+)\s*=\s*(?:function|\([^)]*\)\s*=>|\w+\s*=>)"),
    ("HTML", "XML"): (r"<([A-Za-z_][\w:.-]*)\b",),
    ("JSON", "YAML", "TOML", "INI/config"): (r"[\"']([A-Za-z_][\w.-]*)[\"']\s*[:=]",),
}
ANYWHERE = r"\b(?:class|interface|record|struct|enum|trait|module|namespace|function|func|fn|def|sub)\s+([A-Za-z_]\w*)"
# Names that say nothing.
NOISE = frozenset((
    "main", "this", "self", "new", "return", "if", "else", "for", "while", "do", "switch", "case", "break", "continue", "try", "catch",
    "finally", "throw", "throws", "public", "private", "protected", "static", "void", "int", "string", "bool", "true", "false", "null",
    "None", "undefined", "var", "let", "const", "get", "set", "toString", "hashCode", "equals",
))
_PYTHON = {p: re.compile(p.replace("(?md)", "(?m)")) for p in (text.BLOCK, text.SLASHES, text.QUOTED, text.HASH, text.MARKUP, text.DASHES, text.SEMICOLON)}
_LITERAL = re.compile(r'"(?:[^"\\]|\\.)*"|\'(?:[^\'\\]|\\.)*\'')
_TOKEN = re.compile(r"\w+|[^\w\s]")


def ratio(a: Sequence, b: Sequence, junk: bool = True) -> float:
    return SequenceMatcher(None, a, b, autojunk=junk).ratio()


def quick(a: Counter, b: Counter, total: int) -> float:
    """The ratio's bound by common elements."""
    return 2 * sum((a & b).values()) / total if total else 1.0


def without_comments(content: str, language: str, ext: str) -> str:
    """The same rules as ``text.without_comments``, for one text."""
    python = language == "Python" or ext == ".py"
    styles = (
        (language in text.C_STYLE or ext in text.C_EXTENSIONS, (text.BLOCK, text.SLASHES)), (python, (text.QUOTED, text.HASH)), (language in text.HASH_STYLE, (text.HASH,)),
        (language in ("HTML", "XML", "Markdown"), (text.MARKUP,)), (language == "SQL", (text.BLOCK, text.DASHES)), (language in ("Assembly", "Lisp"), (text.SEMICOLON,)),
    )
    for p in next((patterns for fits, patterns in styles if fits), ()):
        content = _PYTHON[p].sub("", content)
    return content


def identifiers(content: str, language: str) -> set[str]:
    """The names that a text declares, from its raw content."""
    found = set(re.findall(ANYWHERE, content))
    for languages, patterns in DECLARED.items():
        if language in languages:
            # a method's name stands before a parenthesis: without one, its slow pattern finds nothing
            found.update(*(re.findall(p, content) for p in patterns if p is not METHODS or "(" in content))
    return found - NOISE


def features(content: str, ext: str) -> tuple[str, list[str], list[str], str]:
    """(compared form, its tokens, identifiers, language) of one text."""
    content = content.replace("\r\n", "\n").replace("\r", "\n")
    language = language_of(content, ext)[0]
    lines = (" ".join(line.split()) for line in _LITERAL.sub('""', without_comments(content, language, ext)).split("\n"))
    form = "\n".join(line for line in lines if line)
    return form, _TOKEN.findall(form), sorted(identifiers(content, language)), language


def score(a: dict, b: dict) -> float:
    """The similarity in percent of two texts by their features."""
    if not a["filled"] or not b["filled"]:
        return 100.0 if a["filled"] == b["filled"] else 0.0
    if a["form"] == b["form"]:
        return 100.0
    x, y = list(a["tokens"]), list(b["tokens"])
    if not x or not y:
        return 100.0 if len(x) == len(y) else 0.0
    one, two = set(a["ids"]), set(b["ids"])
    return blended(ratio(x, y) * 100, len(one & two) / len(one | two) * 100 if one and two else None)


def blended(percent: float, declared: float | None) -> float:
    """A ratio in percent with the likeness of the declared names, if both declare any."""
    if declared is not None:
        percent = TOKEN_SHARE * percent + IDENTIFIER_SHARE * declared
    return round(min(percent, 100.0), 2)


def bound(a: dict, b: dict) -> float:
    """At least ``score``, at the cost of counting tokens."""
    if a["form"] == b["form"] or not a["filled"] or not b["filled"]:
        return 100.0
    x, y = Counter(a["tokens"]), Counter(b["tokens"])
    percent = 100 * quick(x, y, len(a["tokens"]) + len(b["tokens"]))
    one, two = set(a["ids"]), set(b["ids"])
    if one and two:
        percent = TOKEN_SHARE * percent + IDENTIFIER_SHARE * (len(one & two) / len(one | two) * 100)
    return percent + 0.01


FEATURES = "form string, tokens array<string>, ids array<string>, language string, filled boolean"


@arrow(FEATURES)
def featurise(content: pd.Series, ext: pd.Series) -> pd.DataFrame:
    rows = [(*features(c or "", e or ""), bool((c or "").strip())) for c, e in zip(content, ext)]
    return pd.DataFrame(rows, columns=["form", "tokens", "ids", "language", "filled"])


@arrow("double")
def name_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The ratio of two stems, 0 to 1; left and right matter."""
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype=float)


@arrow("double")
def folder_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([1.0 if x == y else ratio(x.lower(), y.lower()) for x, y in zip(a, b)], dtype=float)


def content_similarity(least: float):
    """An Arrow function of two feature structs: the score, or null if it is below ``least``."""

    @arrow("double")
    def scored(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
        out = []
        for x, y in zip(a.to_dict("records"), b.to_dict("records")):
            got = score(x, y) if bound(x, y) >= least else None
            out.append(got if got is not None and got >= least else None)
        return pd.Series(out, dtype=float)

    return scored


def chunks(data: bytes) -> list[bytes]:
    return [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]


def match_cost(a: list[bytes], b: list[bytes]) -> int:
    """Pairs of equal elements: what aligning the two lists can cost."""
    other = Counter(b)
    return sum(n * other[v] for v, n in Counter(a).items())


@arrow("double")
def binary_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """An estimate in percent for two files' bytes, from their first 64 KiB."""

    def one(x: bytes | None, y: bytes | None) -> float:
        x, y = (x or b"")[:BINARY_CAP], (y or b"")[:BINARY_CAP]
        if x == y or not x or not y:
            return 100.0 if x == y else 0.0
        x, y = chunks(x), chunks(y)
        if match_cost(x, y) > COST_LIMIT:
            return round(200.0 * sum(map(bytes.__eq__, x, y)) / (len(x) + len(y)), 2)
        return round(100 * ratio(x, y, junk=False), 2)

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=float)


def confidence(percent: Column) -> Column:
    return F.when(percent > HIGH, "high").when(percent > MEDIUM, "medium").otherwise("low")


def length_bound(a: Column, b: Column) -> Column:
    """200 min / sum of two lengths."""
    return F.lit(200.0) * F.least(a, b) / (a + b)


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def chunked(data: Column) -> Column:
    """16-byte chunks of binary content."""
    n = F.ceil(F.octet_length(data) / CHUNK).cast("int")
    return F.when(n == 0, F.array().cast("array<binary>")).otherwise(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(data, i * CHUNK + 1, F.lit(CHUNK))))
