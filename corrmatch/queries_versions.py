"""Whole comparisons as queries: two versions of a code base, of which SQL can tell the result.

The formulas of ``sources.migration`` say what happened to each file, so the SQL gives phase,
type, similarity, status and every row of a difference without any matching.
"""

from __future__ import annotations

import uuid
from functools import reduce
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .config import Settings
from .functions import charsets, profile, similarity, text
from .operators import candidates, diff, report, resolve
from .operators.lineage import cut, shared_folder
from .plans import correspond
from .queries import NORMAL, TOKENS, W, query
from .sources import migration, workspace
from .sources.migration import SQL as M
from .sources.virtual import files as documents
from .sources.virtual import sides as document_sides

# the compared form of a text, by k % 7
_BARE = (
    "CASE k % 7 WHEN 0 THEN regexp_replace(regexp_replace(text, '/\\*.*?\\*/', '', 'gs'), '//[^\\n]*', '', 'g') WHEN 1 THEN regexp_replace(regexp_replace(text, '''''''.*?''''''', '', 'gs'), '#[^\\n]*', '', 'g') "
    "WHEN 2 THEN regexp_replace(regexp_replace(text, '/\\*.*?\\*/', '', 'gs'), '--[^\\n]*', '', 'g') WHEN 3 THEN regexp_replace(text, '<!--.*?-->', '', 'gs') WHEN 4 THEN regexp_replace(text, ';[^\\n]*', '', 'g') "
    "WHEN 5 THEN regexp_replace(text, '#[^\\n]*', '', 'g') ELSE text END"
)
FORM = NORMAL.replace("text", f"""regexp_replace({_BARE}, '"[^"]*"|''[^'']*''', '""', 'g')""")
# tokens of both versions, and the score where t of them changed
_SCORES = (
    f"tl AS (SELECT k, len({TOKENS.format(FORM)}) AS n FROM ml), tr AS (SELECT k, t, len({TOKENS.format(FORM)}) AS n FROM mr), "
    "sc AS (SELECT k, CASE WHEN t = 0 THEN 100.0::DOUBLE ELSE round(CASE WHEN k % 7 IN (0, 1, 3) THEN 0.6::DOUBLE * (2.0::DOUBLE * (least(tl.n, tr.n) - t) / (tl.n + tr.n) * 100) + 0.4::DOUBLE * 100 "
    "ELSE 2.0::DOUBLE * (least(tl.n, tr.n) - t) / (tl.n + tr.n) * 100 END, 2) END AS sim FROM tl JOIN tr USING (k))"
)
_PHASE = "CASE WHEN c <= 2 THEN '1' WHEN c IN (3, 4) THEN '2' WHEN c = 5 THEN '3' WHEN c IN (6, 7) THEN '3b' ELSE '2-BIN' END"
_TYPE = "CASE WHEN c <= 2 THEN 'exact_path' WHEN c <= 5 THEN 'deterministic' WHEN c <= 7 THEN 'content' ELSE 'binary' END"
_STATUS = "CASE WHEN c = 0 OR c = 8 AND odd = 0 THEN 'identical' WHEN c IN (1, 3, 5, 6) THEN 'minor' ELSE 'different' END"
_SIM = "CASE WHEN c <= 2 THEN 100.0::DOUBLE WHEN c = 8 THEN CASE WHEN odd = 1 THEN 66.67::DOUBLE ELSE 100.0::DOUBLE END ELSE sim END"
MATCHED = f"SELECT 2 * k AS l_ord, 2 * k + 1 AS r_ord, {_PHASE} AS phase, {_TYPE} AS match_type, round({_SIM}, 2) AS similarity, {_STATUS} AS content_status, c = 8 AS binary FROM ml LEFT JOIN sc USING (k) WHERE c <> 9"


def _compared(spark, sf_dir, **how) -> correspond.Comparison:
    return correspond.compare(*migration.sides(spark, sf_dir), **how)


@query(f"{M}, {_SCORES} {MATCHED}")
def compare_all_phases(spark, sf_dir):
    """Every phase of a comparison: paths, binaries, names, similar names, contents."""
    return _compared(spark, sf_dir).matches.withColumn("similarity", F.round("similarity", 2))


@query(f"""{M}, {_SCORES} SELECT * REPLACE (CASE WHEN l_ord // 2 % 10 = 7 THEN 'llm_verified' ELSE match_type END AS match_type,
  CASE WHEN l_ord // 2 % 10 = 7 THEN 80.0::DOUBLE + l_ord // 2 % 20 ELSE similarity END AS similarity) FROM ({MATCHED})""")
def compare_with_arbiter(spark, sf_dir):
    """The same behind an arbiter, which must decide where content alone is below 95 percent."""
    judge = lambda e: 80 + e["l_ord"] // 2 % 20 if e["r_ord"] == e["l_ord"] + 1 and e["l_ord"] // 2 % 10 != 9 else 10
    result = _compared(spark, sf_dir, settings=Settings(content_sim_threshold=95.0), judge=judge)
    return result.matches.withColumn("similarity", F.round("similarity", 2))


@query(f"""{M} SELECT 'matched' AS section, 2 * k AS l_ord, 2 * k + 1 AS r_ord FROM ml WHERE c <> 9 UNION ALL
  SELECT CASE WHEN odd = 1 THEN 'ignored_' ELSE 'unmatched_' END || side, CASE WHEN NOT new THEN ord END, CASE WHEN new THEN ord END FROM m WHERE c = 9""")
def compare_sections(spark, sf_dir):
    return _compared(spark, sf_dir).sections().select("section", "l_ord", "r_ord")


@query(f"""{M} SELECT count(*) FILTER (c <= 2) AS exact_path_matches, count(*) FILTER (c BETWEEN 3 AND 7) AS deterministic_matches, count(*) FILTER (c = 8) AS binary_matches, 0::BIGINT AS llm_matches,
  count(*) AS total_left, count(*) FILTER (c <> 9 OR odd = 0) AS comparable_left, count(*) FILTER (c = 9 AND odd = 1) AS ignored_left FROM ml""")
def compare_counters(spark, sf_dir):
    result = _compared(spark, sf_dir)
    total = report.totals(result.left).select(*[F.col(c).alias(f"{c}_left") for c in ("total", "comparable", "ignored")])
    one = F.lit(1).alias("one")  # a row each
    return report.counters(result.matches).select("*", one).join(total.select("*", one), "one").drop("one")


@query(f"{M}, {_SCORES} SELECT 2 * k AS l_ord, 2 * k + 1 AS r_ord, round(sim, 2) AS sim FROM ml JOIN sc USING (k) WHERE c <= 4")
def same_name_similarity(spark, sf_dir):
    """Scores of text files of one name."""
    l, r = (f.where("not is_binary") for f in migration.sides(spark, sf_dir))  # noqa: E741
    return candidates.scored(candidates.same_name(l, r).select("l_ord", "r_ord"), l, r, 40.0).select("l_ord", "r_ord", F.round("sim", 2).alias("sim"))


@query(f"{M}, {_SCORES} SELECT 2 * k AS l_ord, 2 * k + 1 AS r_ord, {_PHASE} AS phase, round({_SIM}, 2) AS similarity FROM ml LEFT JOIN sc USING (k) WHERE c <= 4")
def match_by_name(spark, sf_dir):
    """Phases 1 and 2 of the versions end to end."""
    l, r = (f.where("not is_binary and not ignored") for f in migration.sides(spark, sf_dir))  # noqa: E741
    matches = cut(correspond.phase_one(l, r))
    found, rank = correspond.edges("2", report.leftovers(l, matches, "l"), report.leftovers(r, matches, "r"), Settings(), False)
    taken = resolve.greedy(correspond.accepted("2", found, Settings()), rank, group="filename")
    rows = matches.unionByName(taken.select("l_ord", "r_ord", F.lit("2").alias("phase"), F.lit("deterministic").alias("match_type"), F.col("sim").alias("similarity")))
    return rows.select("l_ord", "r_ord", "phase", F.round("similarity", 2).alias("similarity"))


@query(f"{M} SELECT 2 * k AS l_ord, 2 * k + 1 AS r_ord, CASE WHEN odd = 1 THEN 66.67::DOUBLE ELSE 100.0::DOUBLE END AS similarity FROM ml WHERE c = 8")
def match_binaries(spark, sf_dir):
    return correspond.phase_binary(*migration.sides(spark, sf_dir)).select("l_ord", "r_ord", F.round("similarity", 2).alias("similarity"))


def _texts(spark, sf_dir) -> DataFrame:
    return migration.files(spark, sf_dir).where("not is_binary")


_LANGUAGE = f"([{', '.join(map(repr, migration.LANGUAGES))}])[k % 7 + 1]"


@query(f"""{M} SELECT ord, {_LANGUAGE} AS language, CASE WHEN k % 7 <= 3 THEN 'content' WHEN k % 7 <= 5 THEN 'extension hint' ELSE 'content-generic fallback' END AS source,
  CASE WHEN k % 7 IN (0, 3) THEN 'high' WHEN k % 7 <= 5 THEN 'medium' ELSE 'low' END AS confidence FROM m WHERE c <> 8""")
def language_profiles(spark, sf_dir):
    return _texts(spark, sf_dir).select("ord", profile.profile(F.col("text"), F.col("extension")).alias("p")).select("ord", "p.*")


@query(f"{M} SELECT ord, md5({FORM}) AS form FROM m WHERE c <> 8")
def comment_styles(spark, sf_dir):
    """The compared forms of texts in all comment styles."""
    rows = _texts(spark, sf_dir).withColumn("language", profile.profile(F.col("text"), F.col("extension"))["language"])
    return rows.select("ord", F.md5(text.cleaned(F.col("text"), F.col("language"), F.col("extension")).cast("binary")).alias("form"))


@query(f"{M} SELECT ord, md5({FORM}) AS form, len({TOKENS.format(FORM)})::INT AS n_tokens FROM m WHERE c <> 8")
def compared_features(spark, sf_dir):
    """The same forms and their tokens as the similarity sees them."""
    rows = _texts(spark, sf_dir).select("ord", similarity.featurise("text", "extension").alias("f"))
    return rows.select("ord", F.md5(F.col("f.form").cast("binary")).alias("form"), F.size("f.tokens").alias("n_tokens"))


_ANY = r"regexp_extract_all(text, '\b(?:class|interface|record|struct|enum|trait|module|namespace|function|func|fn|def|sub)\s+([A-Za-z_]\w*)', 1)"
_OWN = (
    r"CASE k % 7 WHEN 0 THEN regexp_extract_all(text, '\b(?:class|interface|enum|record)\s+(\w+)', 1) || regexp_extract_all(text, '(?:public|private|protected|static|final|abstract|synchronized|native|\s)+[\w<>\[\],\s]+\s+(\w+)\s*\(', 1) "
    r"WHEN 1 THEN regexp_extract_all(text, '\bclass\s+(\w+)', 1) || regexp_extract_all(text, '\bdef\s+(\w+)', 1) WHEN 3 THEN regexp_extract_all(text, '<([A-Za-z_][\w:.-]*)\b', 1) "
    r"WHEN 5 THEN regexp_extract_all(text, '[" + "''" + r"]([A-Za-z_][\w.-]*)[" + "''" + r'"]\s*[:=]' + r"', 1) ELSE [] END"
)
_IDS = f"ids AS (SELECT ord, k, side, list_sort(list_distinct({_ANY} || {_OWN})) AS ids FROM m WHERE c <> 8)"


@query(f"{M}, {_IDS} SELECT ord, array_to_string(ids, ' ') AS ids FROM ids")
def identifiers(spark, sf_dir):
    rows = _texts(spark, sf_dir).select("ord", similarity.featurise("text", "extension")["ids"].alias("ids"))
    return rows.select("ord", F.array_join("ids", " ").alias("ids"))


@query(f"""{M}, {_IDS} SELECT a.ord AS l_ord, b.ord AS r_ord, round(len(list_intersect(a.ids, b.ids))::DOUBLE / len(list_distinct(a.ids || b.ids)), 6) AS jaccard
  FROM ids a JOIN ids b ON a.k % 7 = b.k % 7 AND a.side = 'left' AND b.side = 'right' WHERE len(a.ids) > 0 AND len(b.ids) > 0""")
def id_jaccard(spark, sf_dir):
    """Likeness of the declared names of files of one kind."""
    rows = _texts(spark, sf_dir).select("ord", "side", "extension", similarity.featurise("text", "extension")["ids"].alias("ids")).where("size(ids) > 0")
    one, two = (rows.where(F.col("side") == s).select(F.col("ord").alias(f"{p}_ord"), "extension", F.col("ids").alias(f"{p}_ids")) for s, p in (("left", "l"), ("right", "r")))
    return one.join(two, "extension").select("l_ord", "r_ord", F.round(similarity.jaccard(F.col("l_ids"), F.col("r_ids")), 6).alias("jaccard"))


def _diffed(spark, sf_dir) -> DataFrame:
    l, r = (f.where("not is_binary") for f in migration.sides(spark, sf_dir))  # noqa: E741
    pairs = candidates.exact_path(l, r).join(l.select(F.col("ord").alias("l_ord"), F.col("text").alias("l_text")), "l_ord").join(r.select(F.col("ord").alias("r_ord"), F.col("text").alias("r_text")), "r_ord")
    return diff.diff_rows(pairs.select(F.col("l_ord").alias("pair_id"), "l_text", "r_text"))


_ROWS = r"""b AS (SELECT ml.k, ml.c, ml.ord AS pair_id, ml.lines AS x, mr.lines AS y, least(len(ml.lines), len(mr.lines)) AS n FROM ml JOIN mr USING (k) WHERE ml.c <= 2),
e AS (SELECT pair_id, k, c, i, x[i] AS a, y[i] AS z FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM b)),
d AS (SELECT pair_id, (i - 1)::INT AS seq, CASE WHEN a = z THEN 'eq' ELSE 'mod' END AS t, i::INT AS l, i::INT AS r, a <> z AND regexp_replace(a, '\s+', '', 'g') = regexp_replace(z, '\s+', '', 'g') AS m, a, z, k, c FROM e
  UNION ALL SELECT pair_id, n::INT, 'del', (n + 1)::INT, NULL, false, x[n + 1], NULL, k, c FROM b WHERE len(x) > n
  UNION ALL SELECT pair_id, n::INT, 'add', NULL, (n + 1)::INT, false, NULL, y[n + 1], k, c FROM b WHERE len(y) > n),
w AS (SELECT *, max((t <> 'eq' AND NOT m)::INT) OVER (PARTITION BY pair_id ORDER BY seq ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) = 1 AS shown FROM d)"""


@query(f"{M}, {_ROWS} SELECT pair_id, seq, t, l, r, m FROM d")
def version_diff(spark, sf_dir):
    """Every row of the differences of files that kept their path."""
    return _diffed(spark, sf_dir).select("pair_id", "seq", "t", "l", "r", "m")


@query(rf"""{M}, {_ROWS} SELECT pair_id, seq, md5(a) AS l_line, md5(z) AS r_line,
  CASE WHEN c = 2 THEN array_to_string(regexp_extract_all(a, 'w[0-9a-f]{{7}}')[1:3], '') ELSE repeat('a', len(regexp_extract_all(a, '(?:note|lit|doc|tail) a'))::INT) END AS l_changed,
  CASE WHEN c = 2 THEN array_to_string(regexp_extract_all(z, 'w[0-9a-f]{{7}}')[1:3], '') ELSE repeat('b', len(regexp_extract_all(z, '(?:note|lit|doc|tail) b'))::INT) || regexp_extract(z, ' *$') END AS r_changed
  FROM d WHERE t = 'mod' AND NOT m""")
def changed_words(spark, sf_dir):
    """The segments of changed lines: their words, and those that differ."""
    rows = _diffed(spark, sf_dir).where("t = 'mod' and not m")
    whole = lambda c: F.md5(F.array_join(F.transform(c, lambda s: s["text"]), "").cast("binary"))
    part = lambda c: F.array_join(F.transform(F.filter(c, lambda s: s["changed"]), lambda s: s["text"]), "")
    return rows.select("pair_id", "seq", whole("ls").alias("l_line"), whole("rs").alias("r_line"), part("ls").alias("l_changed"), part("rs").alias("r_changed"))


@query(f"""{M}, {_ROWS} SELECT 'diffs' AS mode, pair_id, seq FROM w WHERE t <> 'eq' AND NOT m UNION ALL SELECT 'same', pair_id, seq FROM w WHERE t = 'eq' OR m
  UNION ALL SELECT 'context', pair_id, seq FROM w WHERE shown UNION ALL SELECT 'all', pair_id, seq FROM w""")
def row_filters(spark, sf_dir):
    rows = cut(_diffed(spark, sf_dir))
    shown = [diff.filtered(rows, m).select(F.lit(m).alias("mode"), "pair_id", "seq") for m in ("all", "diffs", "same", "context")]
    return reduce(DataFrame.unionByName, shown)


@query(f"""{M}, {_ROWS}, h AS (SELECT pair_id, seq, seq - row_number() OVER (PARTITION BY pair_id ORDER BY seq) AS run FROM w WHERE NOT shown)
  SELECT pair_id, min(seq) AS first, max(seq) AS last, count(*) AS n FROM h GROUP BY pair_id, run""")
def folded_rows(spark, sf_dir):
    return diff.folded(_diffed(spark, sf_dir))


@query(f"{M} SELECT 2 * k AS l_ord, 2 * k + 1 AS r_ord, CASE WHEN l.c = 8 THEN 48 ELSE strlen(l.text) END AS l_size, CASE WHEN r.c = 8 THEN 48 ELSE strlen(r.text) END AS r_size, l.c = 8 AS bytes FROM ml l JOIN mr r USING (k) WHERE l.c <= 4 OR l.c = 8")
def pair_meta(spark, sf_dir):
    """Sizes of both files of a pair, and whether it is shown as bytes."""
    l, r = migration.sides(spark, sf_dir)  # noqa: E741
    pairs = candidates.same_name(l, r).select("l_ord", "r_ord")
    binary = lambda f, s: f.select(F.col("ord").alias(f"{s}_ord"), F.col("is_binary").alias(f"{s}_bin"))
    rows = diff.with_meta(pairs, l, r).join(binary(l, "l"), "l_ord").join(binary(r, "r"), "r_ord").where("l_bin = r_bin")
    return rows.select("l_ord", "r_ord", "l_size", "r_size", diff.byte_view(F.col("l_bin"), F.col("r_bin"), F.lit(False)).alias("bytes"))


_BYTES = "from_hex(md5(k::VARCHAR)) || from_hex(repeat('00', 16)) || from_hex(md5(v || k))"


@query(f"""{M} SELECT l.ord AS pair_id, to_base64({_BYTES.replace('v ||', 'l.v ||').replace('(k', '(l.k').replace('|| k', '|| l.k')}) AS left_b64, l.v = r.v AS identical, 48 AS left_total,
  false AS left_truncated, CASE WHEN l.v = r.v THEN 'eq,eq,eq' ELSE 'eq,eq,mod' END AS rows FROM ml l JOIN mr r USING (k) WHERE l.c = 8""")
def binary_view(spark, sf_dir):
    """The byte views of moved binaries with their rows."""
    l, r = (f.where("is_binary") for f in migration.sides(spark, sf_dir))  # noqa: E741
    pairs = candidates.same_name(l, r).join(l.select(F.col("ord").alias("l_ord"), F.col("content").alias("l_bytes")), "l_ord").join(r.select(F.col("ord").alias("r_ord"), F.col("content").alias("r_bytes")), "r_ord")
    pairs = pairs.select(F.col("l_ord").alias("pair_id"), "l_bytes", "r_bytes")
    rows = diff.hex_rows(pairs).groupBy("pair_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "t"))), lambda x: x["t"]), ",").alias("rows"))
    return diff.hex_summary(pairs).select("pair_id", "left_b64", "identical", "left_total", "left_truncated").join(rows, "pair_id")


@query(f"{M} SELECT k * 2 AS ord, 48 AS total, false AS truncated, to_base64({_BYTES}) AS b64 FROM ml WHERE c = 8")
def one_sided_bytes(spark, sf_dir):
    return diff.single(migration.sides(spark, sf_dir)[0].where("is_binary"))


_DOC_LINES = r"len(string_split_regex(text, '\n')) - (text LIKE '%' || chr(10))::INT"


@query(f"""{W}, n AS (SELECT l.ord AS pair_id, {_DOC_LINES.replace('text', 'l.text')} AS x, {_DOC_LINES.replace('text', 'r.text')} AS y FROM l JOIN r USING (filename, relative_dir))
  SELECT pair_id, x AS n_left, y AS n_right, (x * (x + 1) // 2)::BIGINT AS sum_left, (y * (y + 1) // 2)::BIGINT AS sum_right, 0::BIGINT AS wrong FROM n""")
def diff_rows(spark, sf_dir):
    """What must hold of the differences of all documents of one path.

    Each line of either side is in one row, rows that are equal have equal lines, and the
    segments of changed lines make up the lines; ``wrong`` counts rows where this fails.
    """
    l, r = document_sides(spark, sf_dir)  # noqa: E741
    pairs = candidates.exact_path(l, r).join(l.select(F.col("ord").alias("l_ord"), F.col("text").alias("l_text")), "l_ord").join(r.select(F.col("ord").alias("r_ord"), F.col("text").alias("r_text")), "r_ord")
    pairs = pairs.select(F.col("l_ord").alias("pair_id"), "l_text", "r_text")
    rows = diff.diff_rows(pairs)
    for side in "lr":
        lines = diff.lines(pairs.select(F.col("pair_id").alias("ord"), F.col(f"{side}_text").alias("text"))).toDF("pair_id", side, f"{side}_line")
        rows = rows.join(lines, ["pair_id", side], "left")
    whole = lambda c: F.array_join(F.transform(c, lambda s: s["text"]), "")
    wrong = (F.col("t") == "eq") & (F.col("l_line") != F.col("r_line")) | F.col("ls").isNotNull() & ((whole("ls") != F.col("l_line")) | (whole("rs") != F.col("r_line")))
    return rows.groupBy("pair_id").agg(F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.sum("l").alias("sum_left"), F.sum("r").alias("sum_right"), F.count_if(wrong).alias("wrong"))


@query(f"""{W}, n AS (SELECT l.ord AS pair_id, (least(strlen(l.text), 131072) + 15) // 16 AS x, (least(strlen(r.text), 131072) + 15) // 16 AS y FROM l JOIN r USING (filename, relative_dir))
  SELECT pair_id, x AS n_left, y AS n_right, (x * (x + 1) // 2)::BIGINT AS sum_left, (y * (y + 1) // 2)::BIGINT AS sum_right, 0::BIGINT AS wrong FROM n""")
def hex_rows(spark, sf_dir):
    """The same of the byte rows of all documents of one path."""
    l, r = document_sides(spark, sf_dir)  # noqa: E741
    pairs = candidates.exact_path(l, r).join(l.select(F.col("ord").alias("l_ord"), F.col("content").alias("l_bytes")), "l_ord").join(r.select(F.col("ord").alias("r_ord"), F.col("content").alias("r_bytes")), "r_ord")
    pairs = pairs.select(F.col("l_ord").alias("pair_id"), "l_bytes", "r_bytes")
    chunk = lambda side: pairs.select("pair_id", F.posexplode(similarity.chunked(F.substring(f"{side}_bytes", 1, diff.WINDOW))).alias("n", f"{side}_chunk")).withColumn(side, F.col("n") + 1).drop("n")
    rows = diff.hex_rows(pairs).join(chunk("l"), ["pair_id", "l"], "left").join(chunk("r"), ["pair_id", "r"], "left")
    wrong = (F.col("t") == "eq") != F.coalesce(F.col("l_chunk") == F.col("r_chunk"), F.lit(False))
    return rows.groupBy("pair_id").agg(F.count("l").alias("n_left"), F.count("r").alias("n_right"), F.sum("l").alias("sum_left"), F.sum("r").alias("sum_right"), F.count_if(wrong).alias("wrong"))


@query(rf"""{W}, x AS (SELECT ord, text FROM f UNION ALL SELECT -1 - page_id, replace(replace(html, chr(10), chr(11)), '><', '>' || chr(8232) || '<') || chr(13) || chr(10) FROM pages),
  s AS (SELECT ord, string_split_regex(text, '\r\n|[\n\x0b\f\r\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS p FROM x)
  SELECT ord, md5(array_to_string(CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END, chr(1))) AS form, len(CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END) AS n FROM s""")
def line_view(spark, sf_dir):
    """One-sided texts by lines, with all kinds of line ends."""
    html = F.concat(F.replace(F.replace("html", F.lit("\n"), F.lit("\x0b")), F.lit("><"), F.lit("> <")), F.lit("\r\n"))
    rows = documents(spark, sf_dir).select("ord", "text").unionByName(spark.read.parquet(f"{sf_dir}/pages.parquet").select((F.lit(-1) - F.col("page_id")).alias("ord"), html.alias("text")))
    lines = diff.lines(rows).groupBy("ord").agg(F.sort_array(F.collect_list(F.struct("line", "text"))).alias("x"))
    return lines.select("ord", F.md5(F.array_join(F.transform("x", lambda s: s["text"]), "\x01").cast("binary")).alias("form"), F.size("x").cast("long").alias("n"))


#: How the bytes of a text are written, and the charset that they must be found to have.
_WRITTEN = {
    "utf-8": lambda t: t.cast("binary"), "utf-8-sig": lambda t: F.concat(F.lit(b"\xef\xbb\xbf"), t.cast("binary")), "utf-16-le": lambda t: F.encode(t, "UTF-16LE"), "utf-16-be": lambda t: F.encode(t, "UTF-16BE"),
    "utf-16": lambda t: F.concat(F.lit(b"\xff\xfe"), F.encode(t, "UTF-16LE")), "utf-32-be": lambda t: F.encode(t, "UTF-32"), "utf-32": lambda t: F.concat(F.lit(b"\x00\x00\xfe\xff"), F.encode(t, "UTF-32")),
    "cp1252": lambda t: F.encode(t, "ISO-8859-1"), "bytes": lambda t: F.concat(F.unhex(F.md5(t.cast("binary"))), F.lit(bytes(16))),
}
_UNSURE = "(v = 'bytes' OR v IN ('utf-16-le', 'utf-16-be') AND length(text) < 4 OR v = 'utf-32-be' AND length(text) < 2)"


@query(rf"""{W} SELECT ord, v AS written, {_UNSURE} AS is_binary, CASE WHEN {_UNSURE} THEN '' WHEN v <> 'cp1252' THEN v WHEN regexp_matches(substr(text, 1, least(8191, length(text) - 1)), '[^\x00-\x7F]') THEN 'cp1252' ELSE 'utf-8' END AS text_encoding,
  CASE WHEN NOT {_UNSURE} THEN md5(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) END AS form FROM f, (VALUES {', '.join(f"('{v}')" for v in _WRITTEN)}) t(v)""")
def charset_classes(spark, sf_dir):
    """Texts written in nine ways: what is found, and what is read back."""
    written = F.explode(F.array(*[F.struct(F.lit(v).alias("written"), fn(F.col("text")).alias("content")) for v, fn in _WRITTEN.items()])).alias("w")
    rows = documents(spark, sf_dir).select("ord", written).select("ord", "w.*").withColumn("s", charsets.inspect("content", F.lit("auto")))
    form = F.when(~F.col("s.is_binary"), charsets.decoded_md5("content", F.lit("auto")))
    return rows.select("ord", "written", "s.is_binary", "s.text_encoding", form.alias("form"))


@query(f"""{M}, x AS (SELECT *, relative_dir || '/' || filename AS path FROM ml)
  SELECT row_number() OVER (ORDER BY path) - 1 AS ord, filename, relative_dir, extension, CASE WHEN c = 8 THEN 48 ELSE strlen(text) END AS size, is_binary, CASE WHEN c = 8 THEN '' ELSE 'utf-8' END AS text_encoding,
    relative_dir = 'skip/s' AS ignored, CASE WHEN relative_dir = 'skip/s' THEN 'Excluded directory pattern' ELSE '' END AS ignored_reason, md5(text) AS form FROM x
  UNION ALL SELECT -2, '.', '', '', NULL, false, '', true, 'Directory alias (not a file)', NULL UNION ALL SELECT -1, '..', '', '', NULL, false, '', true, 'Directory alias (not a file)', NULL""")
def scan_workspace(spark, sf_dir):
    """The older version written as files and scanned."""
    root = Path(urlparse(shared_folder(spark)).path) / f"workspace-{uuid.uuid4().hex}"

    def write(batches):
        for batch in batches:
            for folder, name, content in zip(*(batch.column(i).to_pylist() for i in range(3))):
                (root / folder).mkdir(parents=True, exist_ok=True)
                (root / folder / name).write_bytes(content)
            yield batch.select(["filename"])

    rows = migration.sides(spark, sf_dir)[0].select("relative_dir", "filename", "content").mapInArrow(write, "filename string")
    rows.write.format("noop").mode("overwrite").save()
    root.mkdir(parents=True, exist_ok=True)
    found = workspace.scan(spark, str(root), "left", migration.EXCLUDED)
    return found.select("ord", "filename", "relative_dir", "extension", "size", "is_binary", "text_encoding", "ignored", "ignored_reason", F.md5(F.col("text").cast("binary")).alias("form"))
