"""Sections, counters, sorts and filters of a comparison's result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Stands for "no extension" and "all" in the extension selector.
NO_EXTENSION, ALL = "__no_extension__", "*.*"
FILE = ("filename", "relative_dir", "full_path", "extension", "is_binary", "text_encoding", "ignored", "ignored_reason")


def exported(prefix: str = "") -> Column:
    """A file as it is exported: extension left out, names shortened."""
    names = {"name": "filename", "directory": "relative_dir", "full_path": "full_path", "binary": "is_binary", "encoding": "text_encoding", "ignored": "ignored", "ignored_reason": "ignored_reason"}
    return F.struct(*[F.col(prefix + c).alias(n) for n, c in names.items()])


def leftovers(files: DataFrame, matches: DataFrame, side: str) -> DataFrame:
    """The comparable files of a side that no match holds."""
    return files.join(matches.select(F.col(f"{side}_ord").alias("ord")), "ord", "left_anti")


def sections(left: DataFrame, right: DataFrame, matches: DataFrame) -> DataFrame:
    """All rows of a result: matched, unmatched_left, unmatched_right, ignored_left, ignored_right."""
    keep = ("ord", *FILE)
    none = {f"{s}_{c}": F.lit(None) for s in "lr" for c in keep}
    l, r = (f.select(*[F.col(c).alias(f"{s}_{c}") for c in keep]) for f, s in ((left, "l"), (right, "r")))  # noqa: E741
    rows = matches.join(l, "l_ord").join(r, "r_ord").withColumn("section", F.lit("matched"))
    for own, files, side in ((l, left, "l"), (r, right, "r")):
        name = "left" if side == "l" else "right"
        free = leftovers(files.where("not ignored"), matches, side).select(F.col("ord").alias(f"{side}_ord"))
        rows = rows.unionByName(own.join(free, f"{side}_ord").withColumn("section", F.lit(f"unmatched_{name}")), allowMissingColumns=True)
        rows = rows.unionByName(own.where(f"{side}_ignored").withColumn("section", F.lit(f"ignored_{name}")), allowMissingColumns=True)
    return rows.select("section", *none, "phase", "match_type", "similarity", "content_status", "binary")


def totals(files: DataFrame) -> DataFrame:
    """side, total, comparable, ignored."""
    return files.groupBy("side").agg(F.count("*").alias("total"), F.count_if(~F.col("ignored")).alias("comparable"), F.count_if("ignored").alias("ignored"))


def counters(matches: DataFrame) -> DataFrame:
    """Matches by type; a binary pair of one path counts as exact and as binary."""
    kind = F.col("match_type")
    return matches.agg(
        F.count_if(kind == "exact_path").alias("exact_path_matches"), F.count_if(kind.isin("deterministic", "content")).alias("deterministic_matches"),
        F.count_if((kind == "binary") | (kind == "exact_path") & F.col("binary")).alias("binary_matches"), F.count_if(kind == "llm_verified").alias("llm_matches"),
    )


def by_left_name(rows: DataFrame) -> DataFrame:
    """Sections in order of the left file, or of the only file there is."""
    name, folder = (F.lower(F.coalesce(f"l_{c}", f"r_{c}")) for c in ("filename", "relative_dir"))
    return rows.orderBy(name, folder, F.coalesce("l_ord", "r_ord"))


def by_status(rows: DataFrame, descending: bool = False) -> DataFrame:
    """Different, then minor, then identical; or the other way round."""
    rank = F.when(F.col("content_status") == "different", 0).when(F.col("content_status") == "minor", 1).otherwise(2)
    return rows.orderBy(rank.desc() if descending else rank, "l_ord")


def extensions(files: DataFrame) -> DataFrame:
    """The extensions of both sides with their counts."""
    return files.groupBy("extension").agg(F.count("*").alias("n"))


def with_extension(rows: DataFrame, wanted: str) -> DataFrame:
    """Rows of which either side has the extension."""
    if wanted == ALL:
        return rows
    wanted = "" if wanted == NO_EXTENSION else wanted.lower()
    return rows.where((F.coalesce("l_extension", F.lit("\0")) == wanted) | (F.coalesce("r_extension", F.lit("\0")) == wanted))


def search(rows: DataFrame, query: str, *cols: str) -> DataFrame:
    """Rows whose columns hold the query: literally, all its words, or its letters in order."""
    query = query.strip()
    if not query:
        return rows
    # names in plain letters need no Python
    whole = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]))
    plain = whole.rlike("^\\p{ASCII}*$")
    hay = F.when(plain, whole).otherwise(text.folded(F.when(~plain, whole)))
    query = text.without_accents(query)
    found = rows.withColumn("_hay", hay)
    hay = F.col("_hay")
    words = reduce(Column.__and__, [F.contains(hay, F.lit(w)) for w in query.split()])
    letters = "".join(c for c in query if not c.isspace())
    close = F.lit(False) if len(letters) < 3 else hay.rlike("".join(f"{_quoted(c)}.{{0,3}}?" for c in letters))
    return found.where(F.contains(hay, F.lit(query)) | words | close).drop("_hay")


def _quoted(c: str) -> str:
    return c if c.isalnum() else "\\" + c


def shown(rows: DataFrame, with_excluded: bool) -> DataFrame:
    return rows if with_excluded else rows.where(~F.col("section").startswith("ignored"))


def badge(percent: Column) -> Column:
    """low, medium or high, as a result's colour shows it."""
    return F.when(percent < 70, "low").when(percent < 90, "medium").otherwise("high")


def folder_label(folder: Column) -> Column:
    return F.coalesce(F.nullif(folder, F.lit("")), F.lit("."))


def to_json(rows: DataFrame) -> DataFrame:
    """One JSON text for each row of ``sections``."""
    side = lambda s: F.when(F.col(f"{s}_ord").isNotNull(), exported(f"{s}_"))
    return rows.select("section", F.to_json(F.struct(side("l").alias("left"), side("r").alias("right"), "match_type", "similarity", "content_status", "binary")).alias("json"))
