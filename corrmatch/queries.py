"""The engine's operators as queries over a workspace of documents, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Exclusions
from .functions import charsets, globs, profile, similarity, text
from .operators import blocks, candidates, diff, report, resolve
from .plans import correspond
from .sources.virtual import SQL as W
from .sources.virtual import files, sides

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
PATHS = "p AS (SELECT l.ord AS l_ord, r.ord AS r_ord, l.text AS lt, r.text AS rt FROM l JOIN r USING (filename, relative_dir))"
NAMES = "s AS (SELECT l.ord AS l_ord, r.ord AS r_ord, length(l.text) AS ln, length(r.text) AS rn FROM l JOIN r USING (filename))"
TOKENS = r"regexp_extract_all({}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_ \t\n\f\r\x0b]')"


def query(sql: str | None = None):
    """Register a query under its name, with its SQL over the views f, l and r."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _matched(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    l, r = sides(spark, sf_dir)  # noqa: E741
    return l, r, correspond.phase_one(l, r)


@query(f"{W}, {PATHS} SELECT l_ord, r_ord FROM p")
def p1_exact_path(spark, sf_dir):
    return candidates.exact_path(*sides(spark, sf_dir))


@query(f"{W}, {PATHS} SELECT count(*) AS pairs, count(*) FILTER (lt = rt) AS identical FROM p")
def p1_status_counts(spark, sf_dir):
    l, r, matches = _matched(spark, sf_dir)
    return candidates.status(matches, l, r).agg(F.count("*").alias("pairs"), F.count_if(F.col("content_status") == "identical").alias("identical"))


@query(f"{W}, {PATHS} SELECT ord, filename, relative_dir FROM l WHERE ord NOT IN (SELECT l_ord FROM p)")
def leftovers_left(spark, sf_dir):
    l, _, matches = _matched(spark, sf_dir)
    return report.leftovers(l, matches, "l").select("ord", "filename", "relative_dir")


@query(f"{W}, {PATHS} SELECT ord, filename, relative_dir FROM r WHERE ord NOT IN (SELECT r_ord FROM p)")
def leftovers_right(spark, sf_dir):
    _, r, matches = _matched(spark, sf_dir)
    return report.leftovers(r, matches, "r").select("ord", "filename", "relative_dir")


@query(f"{W}, {PATHS} SELECT (SELECT count(*) FROM p) AS exact_path_matches, 0::BIGINT AS deterministic_matches, 0::BIGINT AS binary_matches, 0::BIGINT AS llm_matches, (SELECT count(*) FROM l) AS total_left, (SELECT count(*) FROM r) AS total_right")
def stats_row(spark, sf_dir):
    l, r, matches = _matched(spark, sf_dir)
    totals = report.totals(files(spark, sf_dir)).groupBy().pivot("side", ["left", "right"]).agg(F.first("total"))
    counted = report.counters(matches.withColumn("binary", F.lit(False)))
    one = F.lit(1).alias("one")  # a row each
    return counted.select("*", one).join(totals.toDF("total_left", "total_right").select("*", one), "one").drop("one")


@query(f"{W}, {NAMES} SELECT l_ord, r_ord FROM s")
def same_name_candidates(spark, sf_dir):
    return candidates.same_name(*sides(spark, sf_dir)).select("l_ord", "r_ord")


@query(f"{W}, {NAMES} SELECT l_ord, r_ord, round(200.0 * least(ln, rn) / (ln + rn), 4) AS bound, CASE WHEN 200.0 * least(ln, rn) / (ln + rn) < 70 THEN 'low' WHEN 200.0 * least(ln, rn) / (ln + rn) < 90 THEN 'medium' ELSE 'high' END AS badge FROM s")
def length_bound(spark, sf_dir):
    l, r = sides(spark, sf_dir)  # noqa: E741
    pairs = candidates.same_name(l, r).join(l.select(F.col("ord").alias("l_ord"), F.length("text").alias("a")), "l_ord").join(r.select(F.col("ord").alias("r_ord"), F.length("text").alias("b")), "r_ord")
    bound = similarity.length_bound(F.col("a"), F.col("b"))
    return pairs.select("l_ord", "r_ord", F.round(bound, 4).alias("bound"), report.badge(bound).alias("badge"))


@query(f"{W} SELECT ord, len({TOKENS.format('text')})::INT AS n_tokens, len(list_distinct({TOKENS.format('text')}))::INT AS n_distinct FROM f")
def token_counts(spark, sf_dir):
    return files(spark, sf_dir).select("ord", text.tokens(F.col("text")).alias("t")).select("ord", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_distinct"))


def _tokenised(side: DataFrame) -> DataFrame:
    return side.select("ord", text.tokens(F.col("text")).alias("tokens"))


BAGS = (
    f"a AS (SELECT l_ord, r_ord, t, count(*) AS c FROM (SELECT l_ord, r_ord, unnest({TOKENS.format('lt')}) AS t FROM p) GROUP BY ALL), "
    f"b AS (SELECT l_ord, r_ord, t, count(*) AS c FROM (SELECT l_ord, r_ord, unnest({TOKENS.format('rt')}) AS t FROM p) GROUP BY ALL)"
)


@query(f"{W}, {PATHS}, {BAGS} SELECT l_ord, r_ord, round(2.0 * coalesce(sum(CASE WHEN b.c IS NULL THEN 0 ELSE least(a.c, b.c) END), 0) / any_value(len({TOKENS.format('lt')}) + len({TOKENS.format('rt')})), 6) AS quick FROM p LEFT JOIN a USING (l_ord, r_ord) LEFT JOIN b USING (l_ord, r_ord, t) GROUP BY l_ord, r_ord")
def quick_ratio(spark, sf_dir):
    l, r = sides(spark, sf_dir)  # noqa: E741
    return candidates.quick_ratio(candidates.exact_path(l, r), _tokenised(l), _tokenised(r)).select("l_ord", "r_ord", F.round("quick", 6).alias("quick"))


@query(f"{W}, {PATHS}, {BAGS} SELECT l_ord, r_ord, coalesce(sum(a.c * b.c), 0)::BIGINT AS cost FROM p LEFT JOIN a USING (l_ord, r_ord) LEFT JOIN b USING (l_ord, r_ord, t) GROUP BY l_ord, r_ord")
def match_cost(spark, sf_dir):
    """Pairs of equal tokens, the cost of aligning two files."""
    l, r = sides(spark, sf_dir)  # noqa: E741
    pairs = candidates.exact_path(l, r)
    bag = lambda f, s: pairs.join(_tokenised(f).toDF(f"{s}_ord", "t"), f"{s}_ord").select("l_ord", "r_ord", F.explode("t").alias("t")).groupBy("l_ord", "r_ord", "t").agg(F.count("*").alias(f"{s}_n"))
    costs = bag(l, "l").join(bag(r, "r"), ["l_ord", "r_ord", "t"]).groupBy("l_ord", "r_ord").agg(F.sum(F.col("l_n") * F.col("r_n")).alias("cost"))
    return pairs.join(costs, ["l_ord", "r_ord"], "left").select("l_ord", "r_ord", F.coalesce("cost", F.lit(0)).alias("cost"))


@query(f"{W}, {PATHS} SELECT l_ord, r_ord, round(len(list_intersect({TOKENS.format('lt')}, {TOKENS.format('rt')})) / len(list_distinct(list_concat({TOKENS.format('lt')}, {TOKENS.format('rt')}))), 6) AS jaccard FROM p")
def token_jaccard(spark, sf_dir):
    l, r = sides(spark, sf_dir)  # noqa: E741
    pairs = candidates.exact_path(l, r).join(_tokenised(l).toDF("l_ord", "a"), "l_ord").join(_tokenised(r).toDF("r_ord", "b"), "r_ord")
    return pairs.select("l_ord", "r_ord", F.round(similarity.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"))


@query(f"""WITH RECURSIVE {W.removeprefix('WITH ')}, {NAMES},
c AS (SELECT *, row_number() OVER (ORDER BY l_ord, 200.0 * least(ln, rn) / (ln + rn) DESC, r_ord) AS n FROM s),
g AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS used_l, []::BIGINT[] AS used_r, NULL::BIGINT AS l_ord, NULL::BIGINT AS r_ord
  UNION ALL SELECT c.n, CASE WHEN list_contains(used_l, c.l_ord) OR list_contains(used_r, c.r_ord) THEN used_l ELSE list_append(used_l, c.l_ord) END,
    CASE WHEN list_contains(used_l, c.l_ord) OR list_contains(used_r, c.r_ord) THEN used_r ELSE list_append(used_r, c.r_ord) END,
    CASE WHEN list_contains(used_l, c.l_ord) OR list_contains(used_r, c.r_ord) THEN NULL ELSE c.l_ord END, c.r_ord FROM g JOIN c ON c.n = g.n + 1)
SELECT l_ord, r_ord FROM g WHERE l_ord IS NOT NULL""")
def greedy_same_name(spark, sf_dir):
    """One-to-one choice among files of one name, by likeness of length."""
    l, r = sides(spark, sf_dir)  # noqa: E741
    pairs = candidates.same_name(l, r).join(l.select(F.col("ord").alias("l_ord"), F.length("text").alias("a")), "l_ord").join(r.select(F.col("ord").alias("r_ord"), F.length("text").alias("b")), "r_ord")
    return resolve.greedy(pairs.select("l_ord", "r_ord", "filename", similarity.length_bound(F.col("a"), F.col("b")).alias("score")), "score", group="filename").select("l_ord", "r_ord")


BAND = "x AS (SELECT l.ord AS l_ord, r.ord AS r_ord, 200.0 * least(length(l.text), length(r.text)) / (length(l.text) + length(r.text)) AS bound FROM l JOIN r ON 200.0 * least(length(l.text), length(r.text)) / (length(l.text) + length(r.text)) >= 60)"


@query(f"{W}, {BAND} SELECT l_ord, count(*) AS n, sum(r_ord)::BIGINT AS total FROM x GROUP BY l_ord")
def band_join_3b(spark, sf_dir):
    """Partners by length, counted: the join itself is what is checked."""
    pairs = candidates.length_band(*sides(spark, sf_dir), 60.0)
    return pairs.groupBy("l_ord").agg(F.count("*").alias("n"), F.sum("r_ord").alias("total"))


@query(f"{W}, {BAND} SELECT l_ord, r_ord, rn FROM (SELECT *, row_number() OVER (PARTITION BY l_ord ORDER BY bound DESC, r_ord)::INT AS rn FROM x) WHERE rn <= 3")
def band_topk_per_left(spark, sf_dir):
    return candidates.nearest_lengths(*sides(spark, sf_dir), 60.0, 3)


@query(f"{W} SELECT l.ord AS l_ord, r.ord AS r_ord, l.extension AS l_ext, r.extension AS r_ext FROM l JOIN r USING (text)")
def exact_text_pairs(spark, sf_dir):
    l, r = sides(spark, sf_dir)  # noqa: E741
    hashed = lambda f, s: f.select(F.col("ord").alias(f"{s}_ord"), F.col("extension").alias(f"{s}_ext"), F.sha2("text", 256).alias("sha"))
    return hashed(l, "l").join(hashed(r, "r"), "sha").drop("sha")


NORMAL = r"trim(regexp_replace(regexp_replace(text, '[ \t\x0b\f\r]+', ' ', 'g'), ' ?\n[ \n]*', chr(10), 'g'), ' ' || chr(10))"


@query(f"{W} SELECT ord, length({NORMAL}) AS n, md5({NORMAL}) AS form FROM f")
def normalised_text(spark, sf_dir):
    form = text.normalised(F.col("text"))
    return files(spark, sf_dir).select("ord", F.length(form).cast("long").alias("n"), F.md5(form.cast("binary")).alias("form"))


@query(f"{W}, q AS (SELECT ord, side, md5({NORMAL}) AS form FROM f) SELECT a.ord AS l_ord, b.ord AS r_ord FROM q a JOIN q b USING (form) WHERE a.side = 'left' AND b.side = 'right'")
def norm_equal_pairs(spark, sf_dir):
    l, r = sides(spark, sf_dir)  # noqa: E741
    form = F.md5(text.normalised(F.col("text")).cast("binary")).alias("form")
    return l.select(F.col("ord").alias("l_ord"), form).join(r.select(F.col("ord").alias("r_ord"), form), "form").drop("form")


@query("SELECT page_id, md5(replace(replace(html, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS form FROM pages")
def newline_norm(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.md5(text.newlines(F.col("html")).cast("binary")).alias("form"))


@query("SELECT page_id, md5(regexp_replace(html, '<!--.*?-->', '', 'gs')) AS form FROM pages")
def comment_strip(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.md5(text.without_comments(F.col("html"), F.lit("HTML"), F.lit(".html")).cast("binary")).alias("form"))


@query(r"""SELECT page_id, md5(regexp_replace(html, '"(?:[^"\\]|\\.)*"|''(?:[^''\\]|\\.)*''', '""', 'g')) AS form FROM pages""")
def literal_mask(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.md5(text.without_literals(F.col("html")).cast("binary")).alias("form"))


EXCLUDED = Exclusions.of({"files": ["n1?.de", "main/*/*7.en", "*[23].fr"], "dirs": ["d3", "main/d1*"]})
_FILE_RULE = r"(regexp_full_match(filename, 'n1.\.de|.*[23]\.fr', 's') OR regexp_full_match(relative_dir || '/' || filename, 'main/.*/.*7\.en', 's'))"
_DIR_RULE = r"(regexp_matches(relative_dir, '(^|/)d3(/|$)') OR regexp_matches(relative_dir, '^main/d1'))"


@query(f"{W} SELECT ord, concat_ws('; ', CASE WHEN {_DIR_RULE} THEN 'Excluded directory pattern' END, CASE WHEN {_FILE_RULE} THEN 'Excluded file pattern' END) AS reason FROM f")
def exclusion_flags(spark, sf_dir):
    return files(spark, sf_dir).select("ord", globs.reasons(F.col("filename"), F.col("relative_dir"), EXCLUDED.files, EXCLUDED.dirs).alias("reason"))


@query(f"{W} SELECT ord, {_DIR_RULE} AS excluded FROM f")
def dir_ancestors_excluded(spark, sf_dir):
    return files(spark, sf_dir).select("ord", globs.folder_excluded(F.col("relative_dir"), EXCLUDED.dirs).alias("excluded"))


@query(f"{W} SELECT extension, count(*) AS n FROM f GROUP BY extension")
def extension_options(spark, sf_dir):
    return report.extensions(files(spark, sf_dir))


def _sections(spark, sf_dir) -> DataFrame:
    l, r, matches = _matched(spark, sf_dir)
    return report.sections(l, r, matches.withColumns({"binary": F.lit(False), "content_status": F.lit("different")}))


SECTIONS = (
    f"{PATHS}, z AS (SELECT 'matched' AS section, l_ord, r_ord FROM p UNION ALL SELECT 'unmatched_left', ord, NULL FROM l WHERE ord NOT IN (SELECT l_ord FROM p) "
    "UNION ALL SELECT 'unmatched_right', NULL, ord FROM r WHERE ord NOT IN (SELECT r_ord FROM p))"
)


@query(f"{W}, {SECTIONS} SELECT * FROM z")
def section_union(spark, sf_dir):
    return _sections(spark, sf_dir).select("section", "l_ord", "r_ord")


@query(f"{W}, {SECTIONS} SELECT section, l_ord, r_ord FROM z LEFT JOIN f a ON a.ord = l_ord LEFT JOIN f b ON b.ord = r_ord WHERE a.extension = '.de' OR b.extension = '.de'")
def extension_filter_or(spark, sf_dir):
    return report.with_extension(_sections(spark, sf_dir), ".DE").select("section", "l_ord", "r_ord")


@query(f"""{W}, {SECTIONS}, h AS (SELECT section, l_ord, r_ord, concat_ws(' ', coalesce(a.filename, ''), coalesce(a.relative_dir, ''), coalesce(b.filename, ''), coalesce(b.relative_dir, '')) AS t
  FROM z LEFT JOIN f a ON a.ord = l_ord LEFT JOIN f b ON b.ord = r_ord)
SELECT section, l_ord, r_ord FROM h WHERE contains(t, 'd1 en') OR (contains(t, 'd1') AND contains(t, 'en')) OR regexp_matches(t, 'd.{{0,3}}?1.{{0,3}}?e.{{0,3}}?n')""")
def search_tokens(spark, sf_dir):
    return report.search(_sections(spark, sf_dir), "D1  en", "l_filename", "l_relative_dir", "r_filename", "r_relative_dir").select("section", "l_ord", "r_ord")


@query(f"{W}, {SECTIONS} SELECT section, coalesce(l_ord, -1) AS l_ord, coalesce(r_ord, -1) AS r_ord FROM z LEFT JOIN f a ON a.ord = l_ord LEFT JOIN f b ON b.ord = r_ord ORDER BY lower(coalesce(a.filename, b.filename)), lower(coalesce(a.relative_dir, b.relative_dir)), coalesce(l_ord, r_ord)")
def sort_left_anchored(spark, sf_dir):
    return report.by_left_name(_sections(spark, sf_dir)).select("section", F.coalesce("l_ord", F.lit(-1)).alias("l_ord"), F.coalesce("r_ord", F.lit(-1)).alias("r_ord"))


@query(f"{W}, {PATHS} SELECT l_ord, r_ord, CASE WHEN lt = rt THEN 'identical' ELSE 'different' END AS status FROM p ORDER BY CASE WHEN lt = rt THEN 2 ELSE 0 END, l_ord")
def status_sort(spark, sf_dir):
    l, r, matches = _matched(spark, sf_dir)
    rows = report.by_status(candidates.status(matches, l, r))
    return rows.select("l_ord", "r_ord", F.when(F.col("content_status") == "identical", "identical").otherwise("different").alias("status"))


@query(f"{W} SELECT ord, ceil(strlen(text) / 16)::INT AS n_chunks FROM f")
def chunk16(spark, sf_dir):
    return files(spark, sf_dir).select("ord", F.size(similarity.chunked(F.col("content"))).alias("n_chunks"))


TRUNCATED = "CASE WHEN length(text) <= 6000 THEN text ELSE substr(text, 1, 2400) || {m} || substr(text, length(text) // 2 - 1050 + 1, 2100) || {m} || substr(text, length(text) - 1460 + 1, 1460) END".format(m="chr(10) || '/* ... truncated ... */' || chr(10)")


@query(f"{W} SELECT ord, md5({TRUNCATED}) AS form FROM f")
def smart_truncate(spark, sf_dir):
    return files(spark, sf_dir).select("ord", F.md5(text.middle_out(F.col("text")).cast("binary")).alias("form"))


@query(r"SELECT conv_id, turn, CASE WHEN m IS NULL THEN NULL WHEN length(ltrim(m, '0')) > 3 THEN 100 ELSE least(100, m::INT) END AS score FROM (SELECT conv_id, turn, regexp_extract_all(regexp_replace(text, '(?i)\s*(?:/|out\s+of)\s*100\b', '', 'g'), '[0-9]+')[-1] AS m FROM conversations)")
def parse_score(spark, sf_dir):
    """The number that a turn ends with, read as an arbiter's answer."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return turns.select("conv_id", "turn", text.score(F.col("text"), F.lit("")).alias("score"))


@query("SELECT page_id, n, count(*) AS c FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([A-Za-z_][A-Za-z0-9_:.-]*)', 1)) AS n FROM pages) GROUP BY ALL")
def page_element_names(spark, sf_dir):
    names = F.explode(F.regexp_extract_all("html", F.lit(r"<([A-Za-z_][\w:.-]*)\b"), F.lit(1))).alias("n")
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", names).groupBy("page_id", "n").agg(F.count("*").alias("c"))


@query("SELECT false AS is_binary, 'utf-8' AS text_encoding, count(*) AS n FROM documents")
def sniffed(spark, sf_dir):
    found = files(spark, sf_dir).select(charsets.inspect("content", F.lit("auto")).alias("s")).select("s.*")
    return found.groupBy("is_binary", "text_encoding").agg(F.count("*").alias("n"))


@query(f"{W}, {SECTIONS} SELECT section, count(*) AS n FROM z GROUP BY section")
def section_counts(spark, sf_dir):
    return _sections(spark, sf_dir).groupBy("section").agg(F.count("*").alias("n"))


_STEM = r"lower(regexp_replace({}filename, '\.[^.]*$', ''))"
#: Matching-block ratios of all stems: a window's longest common run, the first of them, splits it in two.
RATIOS = f"""sl AS (SELECT DISTINCT {_STEM.format('')} AS a FROM l), sr AS (SELECT DISTINCT {_STEM.format('')} AS b FROM r),
run AS (SELECT a, b, i, j, len(list_filter(range(1, least(length(a) - i, length(b) - j) + 1), lambda n: substr(a, i + 1, n) = substr(b, j + 1, n))) AS n
  FROM (SELECT a, b, i, unnest(range(length(b))) AS j FROM (SELECT a, b, unnest(range(length(a))) AS i FROM sl, sr))),
win AS (SELECT a, b, 0 AS al, length(a) AS ah, 0 AS bl, length(b) AS bh, 0::BIGINT AS n FROM sl, sr
  UNION ALL SELECT a, b, c.al, c.ah, c.bl, c.bh, c.n FROM (
    SELECT a, b, unnest([{{'al': al, 'ah': -best[2], 'bl': bl, 'bh': -best[3], 'n': best[1]}}, {{'al': best[1] - best[2], 'ah': ah, 'bl': best[1] - best[3], 'bh': bh, 'n': 0}}]) AS c FROM (
      SELECT w.a, w.b, al, ah, bl, bh, max([least(run.n, ah - i, bh - j), -i, -j]) AS best
      FROM win w JOIN run ON run.a = w.a AND run.b = w.b AND run.n > 0 AND i >= al AND i < ah AND j >= bl AND j < bh GROUP BY ALL))),
ratio AS (SELECT a, b, CASE WHEN length(a) + length(b) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * sum(n) / (length(a) + length(b)) END AS s FROM win GROUP BY a, b)"""


@query(f"""WITH RECURSIVE {W.removeprefix('WITH ')}, {RATIOS}
  SELECT round(s, 6) AS name_sim, count(*) AS n FROM l JOIN r ON l.filename <> r.filename JOIN ratio ON a = {_STEM.format('l.')} AND b = {_STEM.format('r.')} WHERE s >= 0.7 GROUP BY round(s, 6)""")
def name_similarity(spark, sf_dir):
    return candidates.similar_name(*sides(spark, sf_dir)).groupBy(F.round("name_sim", 6).alias("name_sim")).agg(F.count("*").alias("n"))


def _re2(pattern: str) -> str:
    """A pattern whose words have letters of any script, for an engine whose classes are ASCII."""
    out, within = "", False
    for i, c in enumerate(pattern):
        if c == "w" and pattern[i - 1 : i] == "\\" and pattern[i - 2 : i - 1] != "\\":
            out = out[:-1] + ("\\p{L}\\p{N}_" if within else "[\\p{L}\\p{N}_]")
            continue
        if c in "[]" and pattern[i - 1 : i] != "\\":
            within = c == "["
        out += c
    return out.replace("'", "''")


def _language_sql() -> str:
    scores = [
        f"{{'s': {' + '.join(f'(CASE WHEN regexp_matches(h, {chr(39)}{_re2(p)}{chr(39)}) THEN {w} ELSE 0 END)' for p, w in own)}, 'n': '{name}'}}" for name, own in profile.SIGNALS.items()
    ]
    known = " ".join(f"WHEN '{e}' THEN '{name}'" for e, name in profile.by_extension().items())
    return f"""x AS (SELECT substr(text, 1, {profile.SAMPLE}) AS h, extension FROM f UNION ALL SELECT substr(html, 1, {profile.SAMPLE}), '.html' FROM pages),
  y AS (SELECT list_max([{', '.join(scores)}]) AS best, CASE lower(extension) {known} END AS known FROM x)
  SELECT CASE WHEN best.s >= {profile.ENOUGH} THEN best.n ELSE coalesce(known, '{profile.GENERIC}') END AS language, CASE WHEN best.s >= {profile.ENOUGH} THEN 'content' WHEN known IS NOT NULL THEN 'extension hint' ELSE 'content-generic fallback' END AS source,
    CASE WHEN best.s >= {profile.SURE} THEN 'high' WHEN best.s >= {profile.ENOUGH} OR known IS NOT NULL THEN 'medium' ELSE 'low' END AS confidence, count(*) AS n FROM y GROUP BY 1, 2, 3"""


@query(f"{W}, {_language_sql()}")
def profile_counts(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("html").alias("text"), F.lit(".html").alias("extension"))
    rows = files(spark, sf_dir).select("text", "extension").unionByName(pages).select(profile.profile(F.col("text"), F.col("extension")).alias("p"))
    return rows.groupBy("p.language", "p.source", "p.confidence").agg(F.count("*").alias("n"))


# what SQL cannot express follows; tests hold it against plain versions


@query()
def similarity_phase2(spark, sf_dir):
    l, r = sides(spark, sf_dir)  # noqa: E741
    return blocks.scored(l, r, 40.0, by="filename").drop("filename")


@query()
def correspond_by_name(spark, sf_dir):
    """Phases 1 and 2 end to end."""
    l, r, matches = _matched(spark, sf_dir)
    free_l, free_r = report.leftovers(l, matches, "l"), report.leftovers(r, matches, "r")
    found, rank = correspond.edges("2", free_l, free_r, correspond.Settings(), False)
    taken = resolve.greedy(correspond.accepted("2", found, correspond.Settings()), rank, group="filename")
    return matches.unionByName(taken.select("l_ord", "r_ord", F.lit("2").alias("phase"), F.lit("deterministic").alias("match_type"), F.col("sim").alias("similarity")))


from . import queries_versions  # noqa: E402, F401  (registers its own queries here)
