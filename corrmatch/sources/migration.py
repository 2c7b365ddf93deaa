"""Two versions of a code base, made from the supplier table by fixed formulas.

Each supplier k is a file on either side.  ``k % 10`` says what happened to it: 0 nothing,
1 its comments, literals and white space changed, 2 some words and a line changed, 3 it moved
and its comments changed, 4 it moved and some words changed, 5 it moved under a similar name,
6 and 7 it moved under another name (7 with many words changed), 8 it is binary and moved
(every second one with other bytes), 9 it is gone and another file is new (every second one
in an excluded folder).  ``k % 7`` is the language.  SQL can tell from k what a comparison
must find: words are hashes, so files share none unless they are versions of one file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Exclusions
from ..functions import charsets, globs

EXTENSIONS = (".java", ".py", ".sql", ".html", ".lisp", ".yaml", ".txt")
LANGUAGES = ("Java", "Python", "SQL", "HTML", "Lisp", "YAML", "Generic text")
EXCLUDED = Exclusions.of({"dirs": ["skip"]})

# The lines of a language: {v} is the version, {k} the supplier, {b} stands for the body's lines.
_LINES = (
    ("package p{k};", "// note {v}", "public class C{k} {{", "{b};", '  String s = "lit {v}"; /* tail {v}', " end */", "}}"),
    ("import m{k}", "# note {v}", "def f{k}(x):", "'''doc {v}'''", "{b}", 's = "lit {v}"'),
    ("select a{k}", "-- note {v}", "{b}", "from t{k} /* tail {v} */ where b = 'lit {v}'"),
    ("<!doctype html>", "<!-- note {v}", " end -->", "<p>{b}</p>", '<x{k} id="lit {v}">'),
    ("; note {v}", "(f{k}", "{b}", '"lit {v}")'),
    ("# note {v}", 'k{k}: "lit {v}"', "{b}"),
    ("{b}", '"lit {v}"'),
)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _concat(line: str, mark: str, join: str) -> str:
    """SQL for a line, in which columns k and v (and ``mark`` for a body line) are filled in."""
    parts = [line]
    for name, column in (("{k}", "CAST(k AS STRING)" if join else "k::VARCHAR"), ("{v}", "v"), ("{b}", mark)):
        parts = [x for p in parts for x in (_cut(p, name, column) if isinstance(p, str) else [p])]
    shown = [p[0] if isinstance(p, tuple) else _quoted(p.replace("{{", "{").replace("}}", "}")) for p in parts if p]
    return f"concat({', '.join(shown)})"


def _cut(text: str, name: str, column: str) -> list:
    out = []
    for i, piece in enumerate(text.split(name)):
        out += ([(column,)] if i else []) + ([piece] if piece else [])
    return out


def _spark_lines() -> str:
    cases = []
    for style, lines in enumerate(_LINES):
        parts = [f"transform(body, b -> {_concat(x, 'b', 'x')})" if "{b}" in x else f"array({_concat(x, '', 'x')})" for x in lines]
        cases.append(f"WHEN {style} THEN concat({', '.join(parts)})")
    return f"CASE k % 7 {' '.join(cases)} END"


def _duck_lines() -> str:
    cases = []
    for style, lines in enumerate(_LINES):
        parts = [f"list_transform(body, lambda b: {_concat(x, 'b', '')})" if "{b}" in x else f"[{_concat(x, '', '')}]" for x in lines]
        cases.append(f"WHEN {style} THEN {' || '.join(parts)}")
    return f"CASE k % 7 {' '.join(cases)} END"


_EXT_SPARK = f"element_at(array({', '.join(map(repr, EXTENSIONS))}), CAST(k % 7 + 1 AS INT))"
_EXT_DUCK = f"([{', '.join(map(repr, EXTENSIONS))}])[k % 7 + 1]"

#: Views in DuckDB: m (k, c and what each file is), ml and mr (its two versions, for those that are text), with lines and text.
SQL = f"""WITH m0 AS (
  SELECT s_suppkey AS k, s_suppkey % 10 AS c, s_suppkey // 10 % 2 AS odd, side, side = 'right' AS new FROM supplier, (VALUES ('left'), ('right')) s(side)),
m1 AS (SELECT *, CASE WHEN new AND c IN (1, 3, 5, 6) OR new AND c = 8 AND odd = 1 THEN 'b' ELSE 'a' END AS v,
  CASE WHEN NOT new THEN 0 WHEN c = 2 THEN 3 WHEN c = 4 THEN 12 WHEN c = 7 THEN 40 ELSE 0 END AS t FROM m0),
m2 AS (SELECT *, list_transform(range(6), lambda j: list_aggregate(list_transform(range(20), lambda i:
  'w' || substr(md5(CASE WHEN j * 20 + i < t THEN 'x' WHEN new AND c = 9 THEN 'r' ELSE 'l' END || k || ':' || (j * 20 + i)), 1, 7)), 'string_agg', ' ')) AS body FROM m1),
m3 AS (SELECT *, {_duck_lines()} AS plain FROM m2),
m4 AS (SELECT *, CASE WHEN c = 1 AND new THEN plain[:-2] || [plain[-1] || '  '] WHEN c = 2 AND new = (odd = 0) THEN plain || ['extra' || k || ' line here'] ELSE plain END AS lines FROM m3),
m AS (SELECT k, c, odd, v, t, side, new, 2 * k + new::INT AS ord, c = 8 AS is_binary, lines, CASE WHEN c <> 8 THEN list_aggregate(lines, 'string_agg', chr(10)) END AS text,
  CASE WHEN c = 8 THEN '.bin' ELSE {_EXT_DUCK} END AS extension,
  CASE WHEN new AND c = 5 THEN 'n' || substr(md5('n' || k), 1, 8) || 'x' WHEN new AND c IN (6, 7) THEN 'q' || substr(md5('q' || k), 1, 8)
    WHEN new AND c = 9 THEN 'r' || substr(md5('r' || k), 1, 8) ELSE 'n' || substr(md5('n' || k), 1, 8) END || CASE WHEN c = 8 THEN '.bin' ELSE {_EXT_DUCK} END AS filename,
  CASE WHEN c = 9 THEN CASE WHEN odd = 1 THEN 'skip/s' ELSE 'c' END WHEN new AND c >= 3 THEN 'b/e' || (k % 3) ELSE 'a/d' || (k % 5) END AS relative_dir FROM m4),
ml AS (SELECT * FROM m WHERE NOT new), mr AS (SELECT * FROM m WHERE new)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of both sides, with the columns of a scan."""
    keys = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey")
    keys = keys.repartition(max(keys.rdd.getNumPartitions(), 4 * spark.sparkContext.defaultParallelism))  # a small table makes many files
    rows = keys.selectExpr("s_suppkey AS k", "s_suppkey % 10 AS c", "s_suppkey div 10 % 2 AS odd", "explode(array('left', 'right')) AS side")
    rows = rows.withColumn("new", F.expr("side = 'right'"))
    rows = rows.withColumn("v", F.expr("CASE WHEN new AND (c IN (1, 3, 5, 6) OR c = 8 AND odd = 1) THEN 'b' ELSE 'a' END"))
    rows = rows.withColumn("t", F.expr("CASE WHEN NOT new THEN 0 WHEN c = 2 THEN 3 WHEN c = 4 THEN 12 WHEN c = 7 THEN 40 ELSE 0 END"))
    word = "concat('w', substr(md5(concat(CASE WHEN i < t THEN 'x' WHEN new AND c = 9 THEN 'r' ELSE 'l' END, k, ':', i)), 1, 7))"
    rows = rows.withColumn("words", F.expr(f"transform(sequence(0, 119), i -> {word})"))
    rows = rows.withColumn("body", F.expr("transform(sequence(0, 5), j -> array_join(slice(words, j * 20 + 1, 20), ' '))"))
    rows = rows.withColumn("lines", F.expr(_spark_lines()))
    last = "concat(slice(lines, 1, size(lines) - 1), array(concat(element_at(lines, -1), '  ')))"
    rows = rows.withColumn("lines", F.expr(f"CASE WHEN c = 1 AND new THEN {last} WHEN c = 2 AND new = (odd = 0) THEN concat(lines, array(concat('extra', k, ' line here'))) ELSE lines END"))
    data = "CASE WHEN c = 8 THEN concat(unhex(md5(CAST(k AS STRING))), unhex(repeat('00', 16)), unhex(md5(concat(v, k)))) ELSE CAST(array_join(lines, '\\n') AS BINARY) END"
    stem = "CASE WHEN new AND c = 5 THEN concat('n', substr(md5(concat('n', k)), 1, 8), 'x') WHEN new AND c IN (6, 7) THEN concat('q', substr(md5(concat('q', k)), 1, 8)) WHEN new AND c = 9 THEN concat('r', substr(md5(concat('r', k)), 1, 8)) ELSE concat('n', substr(md5(concat('n', k)), 1, 8)) END"
    folder = "CASE WHEN c = 9 THEN if(odd = 1, 'skip/s', 'c') WHEN new AND c >= 3 THEN concat('b/e', k % 3) ELSE concat('a/d', k % 5) END"
    rows = rows.selectExpr("2 * k + CAST(new AS INT) AS ord", "side", f"CASE WHEN c = 8 THEN '.bin' ELSE {_EXT_SPARK} END AS extension", f"{stem} AS stem", f"{folder} AS relative_dir", f"{data} AS content")
    rows = rows.withColumn("filename", F.concat("stem", "extension")).withColumn("sniff", charsets.inspect("content", F.lit("auto")))
    reason = globs.reasons(F.col("filename"), F.col("relative_dir"), EXCLUDED.files, EXCLUDED.dirs)
    return rows.select(
        "ord", "side", "filename", "relative_dir", F.concat_ws("/", "side", "relative_dir", "filename").alias("full_path"), "extension", F.octet_length("content").cast("long").alias("size"),
        F.col("sniff.is_binary").alias("is_binary"), F.col("sniff.text_encoding").alias("text_encoding"), (reason != "").alias("ignored"), reason.alias("ignored_reason"), "content",
        F.when(~F.col("sniff.is_binary"), charsets.decode("content", F.lit("auto"))).alias("text"),
    )


def sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    all_ = files(spark, sf_dir)
    return all_.where("side = 'left'"), all_.where("side = 'right'")
