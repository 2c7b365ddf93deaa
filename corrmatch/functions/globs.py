"""Exclusion patterns as predicates of Spark's regex engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def regex(pattern: str) -> str:
    """A shell pattern (``*``, ``?``, ``[seq]``, ``[!seq]``) as an anchored Java regex."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + (2 if pattern[i : i + 1] == "!" else 1))) > 0:
            body = pattern[i:end]
            i = end + 1
            negated = body.startswith("!")
            body = "".join("\\" + x if x in "\\[]&^~|" else x for x in body[negated:])
            out.append(f"[{'^' if negated else ''}{body}]")
        else:
            out.append("\\" + c if not c.isalnum() and c != "_" and c.isascii() else c)
    return "".join(out)


def _any(target: Column, patterns: list[str], ignore_case: bool) -> Column:
    if not patterns:
        return F.lit(False)
    flags = "(?si)" if ignore_case else "(?s)"
    return target.rlike(flags + "\\A(?:" + "|".join(map(regex, patterns)) + ")\\z")


def excluded(name: Column, path: Column, patterns: tuple[str, ...], ignore_case: bool = False) -> Column:
    """Whether a pattern matches: with a slash the relative path, otherwise the name."""
    return _any(name, [p for p in patterns if "/" not in p], ignore_case) | _any(path, [p for p in patterns if "/" in p], ignore_case)


def ancestors(folder: Column) -> Column:
    """The folder and all folders above it, from the top: a/b gives a, a/b."""
    parts = F.split(folder, "/")
    paths = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return F.when(folder == "", F.array().cast("array<string>")).otherwise(paths)


def folder_excluded(folder: Column, patterns: tuple[str, ...], ignore_case: bool = False) -> Column:
    """Whether a pattern matches the folder or one above it."""
    if not patterns:
        return F.lit(False)
    return F.exists(ancestors(folder), lambda p: excluded(F.element_at(F.split(p, "/"), -1), p, patterns, ignore_case))


def reasons(name: Column, folder: Column, files: tuple[str, ...], dirs: tuple[str, ...], ignore_case: bool = False) -> Column:
    """Why a file is ignored, '' if it is not."""
    path = F.when(folder == "", name).otherwise(F.concat_ws("/", folder, name))
    # The reasons' texts.
    return F.concat_ws("; ", F.when(folder_excluded(folder, dirs, ignore_case), "Excluded directory pattern"), F.when(excluded(name, path, files, ignore_case), "Excluded file pattern"))
