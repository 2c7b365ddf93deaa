"""Text rules as native column expressions, safe in Java's regex engine.

Classes are Unicode-aware (``(?U)``), only a line feed ends a line (``(?d)``), and
string literals use possessive loops, which neither overflow the stack nor backtrack.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import arrow

# Patterns of comments and string literals.
BLOCK, SLASHES, QUOTED, HASH = r"(?s)/\*.*?\*/", r"(?md)//.*?$", "(?s)('''.*?'''|\"\"\".*?\"\"\")", r"(?md)#.*?$"
MARKUP, DASHES, SEMICOLON = r"(?s)<!--.*?-->", r"(?md)--.*?$", r"(?md);.*?$"
LITERAL = r'''(?s)"[^"\\]*+(?:\\[^\n][^"\\]*+)*+"|'[^'\\]*+(?:\\[^\n][^'\\]*+)*+\''''
# Languages and extensions of each comment style.
C_STYLE = (
    "C", "C++", "CUDA", "OpenCL", "Java", "C#", "Objective-C", "Rust", "Go", "JavaScript", "TypeScript", "Kotlin", "Scala",
    "Swift", "Dart", "Groovy", "PHP", "WGSL shader", "GLSL shader", "HLSL shader",
)
HASH_STYLE = ("Python", "Perl", "Ruby", "Shell", "PowerShell", "R", "Julia", "YAML", "TOML", "INI/config", "Make/build")
C_EXTENSIONS = (
    ".c", ".h", ".cpp", ".hpp", ".cc", ".hh", ".cxx", ".hxx", ".java", ".cs", ".go", ".js", ".jsx", ".ts", ".tsx",
    ".kt", ".kts", ".scala", ".swift", ".m", ".mm", ".rs", ".gradle",
)
SPACE = " \t\n\x0b\f\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def newlines(text: Column) -> Column:
    """CRLF and CR as LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def normalised(text: Column) -> Column:
    """Lines trimmed, inner white space as one space, blank lines dropped."""
    inner = SPACE.replace("\n", "")
    text = F.regexp_replace(text, f"[{inner}]+", " ")
    return F.regexp_replace(F.regexp_replace(text, " ?\n[ \n]*", "\n"), "\\A[ \n]+|[ \n]+\\z", "")


def tokens(text: Column) -> Column:
    """Words and single marks, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?U)(\w+|[^\w\s])"), F.lit(1))


def extension(name: Column) -> Column:
    """The lower-case extension with its dot; '' for none and for dot files."""
    return F.lower(F.regexp_extract(name, r"(?s)^\.*[^.].*?(\.[^.]*)$", 1))


def stem(name: Column) -> Column:
    """The lower-case name before its last dot."""
    return F.lower(F.regexp_replace(name, r"(?s)\.[^.]*\z", ""))


def relative_path(folder: Column, name: Column) -> Column:
    return F.when(folder == "", name).otherwise(F.concat_ws("/", folder, name))


def without_comments(text: Column, language: Column, ext: Column) -> Column:
    """``text`` without the comments of its language; the first style that fits counts."""

    def cut(x: Column, *patterns: str) -> Column:
        for p in patterns:
            x = F.regexp_replace(x, p, "")
        return x

    python = (language == "Python") | (ext == ".py")
    return (
        F.when(language.isin(*C_STYLE) | ext.isin(*C_EXTENSIONS), cut(text, BLOCK, SLASHES))
        .when(python, cut(text, QUOTED, HASH)).when(language.isin(*HASH_STYLE), cut(text, HASH))
        .when(language.isin("HTML", "XML", "Markdown"), cut(text, MARKUP)).when(language == "SQL", cut(text, BLOCK, DASHES))
        .when(language.isin("Assembly", "Lisp"), cut(text, SEMICOLON)).otherwise(text)
    )


def without_literals(text: Column) -> Column:
    """String literals as ""."""
    return F.regexp_replace(text, LITERAL, '""')


def cleaned(text: Column, language: Column, ext: Column) -> Column:
    """The form in which two texts are compared."""
    return normalised(without_literals(without_comments(newlines(text), language, ext)))


def blank(text: Column) -> Column:
    return ~text.rlike(f"[^{SPACE}]")


def same_but_space(a: Column, b: Column) -> Column:
    """Whether two lines differ in white space only."""
    return F.regexp_replace(a, f"[{SPACE}]+", "") == F.regexp_replace(b, f"[{SPACE}]+", "")


def middle_out(text: Column, limit: int = 6000) -> Column:
    """A long text's head (40 %), middle (35 %) and tail, with marks between."""
    # Shares, mark and room for the marks.
    head, middle, mark = int(limit * 0.40), int(limit * 0.35), "\n/* ... truncated ... */\n"
    tail, n = limit - head - middle - 40, F.length(text)
    start = F.floor(n / 2).cast("int") - middle // 2 + 1
    parts = F.concat(F.substring(text, 1, head), F.lit(mark), F.substring(text, start, F.lit(middle)), F.lit(mark), F.substring(text, n - tail + 1, F.lit(tail)))
    return F.when(n <= limit, text).otherwise(parts)


def middle_out_of(text: str, limit: int = 6000) -> str:
    """``middle_out`` of one text, for an arbiter's request."""
    if len(text) <= limit:
        return text
    head, middle = int(limit * 0.40), int(limit * 0.35)
    start = len(text) // 2 - middle // 2
    return "\n/* ... truncated ... */\n".join((text[:head], text[start : start + middle], text[-(limit - head - middle - 40) :]))


def score_of(answer: str, thinking: str = "") -> int | None:
    """``score`` of one answer."""
    said = re.sub(r"(?s)<think>.*?(?:</think>|\Z)", "", answer or "").strip() or (thinking or "").strip()
    if not re.fullmatch(r"\d+", said):
        said = re.sub(r"(?i)\s*(?:/|out\s+of)\s*100\b", "", said)
    found = re.findall(r"\d+", said)
    return min(100, int(found[-1])) if found else None


def score(answer: Column, thinking: Column) -> Column:
    """The percentage that an arbiter's answer ends with; null if it has none."""
    said = F.trim(F.regexp_replace(F.coalesce(answer, F.lit("")), r"(?s)<think>.*?(?:</think>|\z)", ""))
    said = F.when(said == "", F.trim(F.coalesce(thinking, F.lit("")))).otherwise(said)
    said = F.when(said.rlike(r"\A\d+\z"), said).otherwise(F.regexp_replace(said, r"(?i)\s*(?:/|out\s+of)\s*100\b", ""))
    found = F.regexp_extract_all(said, F.lit(r"(\d+)"), F.lit(1))
    last = F.try_element_at(found, F.lit(-1))
    return F.when(F.length(F.regexp_replace(last, "^0+", "")) > 3, 100).when(last.isNotNull(), F.least(F.lit(100), last.cast("int")))


def without_accents(text: str) -> str:
    """Lower case without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))


@arrow("string")
def folded(text: pd.Series) -> pd.Series:
    """Lower case without the accents of letters, whatever their script."""
    return text.map(without_accents, na_action="ignore")
