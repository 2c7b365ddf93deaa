"""Candidate joins of the phases.  Each yields l_ord, r_ord and what it compared.

Inputs are the free files of a side: ord, filename, relative_dir, extension, is_binary,
text, and for text the features of ``functions.similarity``.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import NAME_SIMILARITY
from ..functions import similarity, text
from . import blocks
from .lineage import cut


def sided(files: DataFrame, side: str, *cols: str) -> DataFrame:
    return files.select(*[F.col(c).alias(f"{side}_{c}") for c in ("ord", *cols)])


def exact_path(left: DataFrame, right: DataFrame) -> DataFrame:
    """Same name in the same folder: at most one partner each."""
    one = left.select(F.col("ord").alias("l_ord"), "filename", "relative_dir")
    two = right.select(F.col("ord").alias("r_ord"), "filename", "relative_dir")
    return one.join(two, ["filename", "relative_dir"]).select("l_ord", "r_ord")


def same_name(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of files with one name."""
    one = left.select(F.col("ord").alias("l_ord"), "filename", F.col("relative_dir").alias("l_dir"))
    two = right.select(F.col("ord").alias("r_ord"), "filename", F.col("relative_dir").alias("r_dir"))
    return one.join(two, "filename")


def _stems(files: DataFrame) -> DataFrame:
    stem = text.stem(F.col("filename"))
    return files.select(stem.alias("stem")).distinct().withColumn("n", F.length("stem"))


def similar_name(left: DataFrame, right: DataFrame, least: float = NAME_SIMILARITY) -> DataFrame:
    """l_ord, r_ord, name_sim of files whose names differ and whose stems are alike.

    Only distinct stems meet.  Stems of n and m letters have at most 2 min / (n + m) in
    common, so they meet by length, in blocks; their common letters and the longest common
    subsequence drop most of the rest; the bounds lose no pair.  The ratio decides.
    """
    low, high = least / (2 - least), (2 - least) / least
    lengths = F.sequence(F.ceil(F.col("n") * low - 1e-9).cast("int"), F.floor(F.col("n") * high + 1e-9).cast("int"))
    one, two = _stems(left).select(F.col("n").alias("l_n"), F.col("stem").alias("ord")), _stems(right).select(F.explode(lengths).alias("l_n"), F.col("stem").alias("ord"))

    def fn(l: pa.Table, r: pa.Table) -> pa.Table:  # noqa: E741
        got = blocks.name_scores(l.column("ord").to_pylist(), r.column("ord").to_pylist(), least) if l.num_rows and r.num_rows else []
        return pa.table([pa.array([x[k] for x in got], t) for k, t in enumerate((pa.string(), pa.string(), pa.float64()))], names=["l_stem", "r_stem", "name_sim"])

    near = blocks.meet(one, two, ["l_n"], fn, "l_stem string, r_stem string, name_sim double")
    l = left.select(F.col("ord").alias("l_ord"), F.col("filename").alias("l_name"), text.stem(F.col("filename")).alias("l_stem"))  # noqa: E741
    r = right.select(F.col("ord").alias("r_ord"), F.col("filename").alias("r_name"), text.stem(F.col("filename")).alias("r_stem"))
    return near.join(l, "l_stem").join(r, "r_stem").where("l_name <> r_name").select("l_ord", "r_ord", "name_sim")


def length_band(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """l_ord, r_ord of non-empty texts whose lengths allow ``threshold`` percent.

    Lengths n and m do if 200 min / (n + m) reaches it, that is, if they differ by a
    factor of (200 - T) / T at most: files meet in neighbouring logarithmic bands.
    """
    factor = (200.0 - threshold) / threshold
    # a factor of 1 leaves equal lengths only; bands are then the lengths themselves
    band = (lambda n: n) if factor <= 1.0 else lambda n: F.floor(F.ln(n.cast("double")) / math.log(factor) + 1e-9).cast("int")
    one = left.select(F.col("ord").alias("l_ord"), F.length("text").alias("l_n")).where("l_n > 0").withColumn("band", band(F.col("l_n")))
    two = right.select(F.col("ord").alias("r_ord"), F.length("text").alias("r_n")).where("r_n > 0").withColumn("band", band(F.col("r_n")))
    if factor > 1.0:
        two = two.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    return one.join(two, "band").where(similarity.length_bound(F.col("l_n"), F.col("r_n")) >= threshold).select("l_ord", "r_ord")


def nearest_lengths(left: DataFrame, right: DataFrame, threshold: float, most: int) -> DataFrame:
    """l_ord, r_ord, rn: the ``most`` pairs of ``length_band`` of each left file, nearest lengths first.

    Ties go to the smaller r_ord.  What a file gets depends on its length alone, and no more
    than ``most`` files of one length and ``most`` lengths on either side of its own can be
    among them: lengths are numbered within a band, and only numbers next to its own are met.
    """
    factor = (200.0 - threshold) / threshold
    band = (lambda n: n) if factor <= 1.0 else lambda n: F.floor(F.ln(n.cast("double")) / math.log(factor) + 1e-9).cast("int")
    one = left.select(F.col("ord").alias("l_ord"), F.length("text").alias("l_n")).where("l_n > 0")
    two = right.select(F.col("ord").alias("r_ord"), F.length("text").alias("r_n")).where("r_n > 0")
    two = two.withColumn("k", F.row_number().over(Window.partitionBy("r_n").orderBy("r_ord"))).where(F.col("k") <= most).drop("k")
    met = two.select(F.col("r_n").alias("n"), F.lit(1).alias("own")).distinct().withColumn("band", band(F.col("n")))
    if factor > 1.0:
        met = met.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    asked = one.select(F.col("l_n").alias("n"), F.lit(0).alias("own")).distinct().withColumn("band", band(F.col("n")))
    # at: how many of the right side's lengths a band has up to n
    rows = met.unionByName(asked).withColumn("at", F.sum("own").over(Window.partitionBy("band").orderBy("n", F.desc("own")).rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    near = rows.where("own = 0").select("band", F.col("n").alias("l_n"), F.explode(F.sequence(F.col("at") - (most - 1), F.col("at") + most)).alias("at"))
    near = near.join(rows.where("own = 1").select("band", F.col("n").alias("r_n"), "at"), ["band", "at"]).withColumn("bound", similarity.length_bound(F.col("l_n"), F.col("r_n")))
    near = near.where(F.col("bound") >= threshold).join(two, "r_n")
    near = near.withColumn("rn", F.row_number().over(Window.partitionBy("l_n").orderBy(F.desc("bound"), "r_ord"))).where(F.col("rn") <= most)
    return one.join(near.select("l_n", "r_ord", "rn"), "l_n").select("l_ord", "r_ord", "rn")


def marks(files: DataFrame) -> DataFrame:
    """ord, marks: a bag of tokens as a set, the k-th of a token as an element of its own."""
    bag = files.select("ord", F.explode("tokens").alias("t")).groupBy("ord", "t").agg(F.count("*").cast("int").alias("c"))
    each = bag.select("ord", "t", F.explode(F.sequence(F.lit(1), F.col("c"))).alias("k"))
    found = each.groupBy("ord").agg(F.collect_list(F.xxhash64("t", "k")).alias("marks"))
    return files.select("ord").join(found, "ord", "left").select("ord", F.coalesce("marks", F.array().cast("array<bigint>")).alias("marks"))


def quick_ratio(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``pairs`` with ``quick``: twice the tokens in common over all tokens.

    Marks are made once for each file; a pair then takes one hash intersection.
    """
    total = F.size("l_marks") + F.size("r_marks")
    quick = F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect("l_marks", "r_marks")) / total)
    both = pairs.join(marks(left).toDF("l_ord", "l_marks"), "l_ord").join(marks(right).toDF("r_ord", "r_marks"), "r_ord")
    return both.withColumn("quick", quick).drop("l_marks", "r_marks")


def scored(pairs: DataFrame, left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """``pairs`` with ``sim``, those below ``least`` left out.

    The right file is seen with the left file's extension, so its features are made for
    each extension that it meets.
    """
    ext = left.select(F.col("ord").alias("l_ord"), F.col("extension").alias("ext"), F.col("text").alias("l_text"))
    pairs = cut(pairs.join(ext.select("l_ord", "ext"), "l_ord"))
    one = cut(ext.join(pairs.select("l_ord").distinct(), "l_ord", "left_semi").select("l_ord", similarity.featurise("l_text", "ext").alias("a")))
    met = pairs.select("r_ord", "ext").distinct().join(right.select(F.col("ord").alias("r_ord"), F.col("text").alias("r_text")), "r_ord")
    two = cut(met.select("r_ord", "ext", similarity.featurise("r_text", "ext").alias("b")))

    def short(s: str):
        return [F.xxhash64(f"{s}.form").alias(f"{s}_form"), F.size(f"{s}.tokens").alias(f"{s}_n"), F.size(f"{s}.ids").alias(f"{s}_k"), F.col(f"{s}.filled").alias(f"{s}_filled")]

    # counts are short; whole features travel only for pairs that counts allow
    near = pairs.join(one.select("l_ord", *short("a")), "l_ord").join(two.select("r_ord", "ext", *short("b")), ["r_ord", "ext"])
    tokens = similarity.length_bound(F.col("a_n"), F.greatest(F.col("b_n"), F.lit(1)))
    names = 100.0 * F.least("a_k", "b_k") / F.greatest("a_k", "b_k")
    blend = F.when((F.col("a_k") > 0) & (F.col("b_k") > 0), similarity.TOKEN_SHARE * tokens + similarity.IDENTIFIER_SHARE * names).otherwise(tokens)
    near = near.where((F.col("a_form") == F.col("b_form")) | ~F.col("a_filled") | ~F.col("b_filled") | (blend + 0.01 >= least)).select(*pairs.columns)
    both = near.join(one, "l_ord").join(two, ["r_ord", "ext"])
    return both.withColumn("sim", similarity.content_similarity(least)("a", "b")).where("sim is not null").drop("a", "b", "ext")


def status(matches: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``matches`` with content_status (identical, minor or different) and binary.

    Hashes decide what is equal; only the texts of pairs that differ travel, for their forms.
    """

    def sums(files: DataFrame, side: str) -> DataFrame:
        kept = {"bin": F.col("is_binary"), "bytes": F.sha2("content", 256), "lines": F.sha2(text.newlines(F.col("text")).cast("binary"), 256)}
        return files.select(F.col("ord").alias(f"{side}_ord"), *[c.alias(f"{side}_{n}") for n, c in kept.items()])

    rows = matches.join(sums(left, "l"), "l_ord").join(sums(right, "r"), "r_ord").withColumn("binary", F.col("l_bin") | F.col("r_bin"))
    same = F.when(F.col("binary"), F.col("l_bytes") == F.col("r_bytes")).otherwise(F.col("l_lines") == F.col("r_lines"))
    rows = cut(rows.withColumn("same", F.coalesce(same, F.lit(False))).select(*matches.columns, "binary", "same"))
    texts = rows.where("not same and not binary").select("l_ord", "r_ord")
    texts = texts.join(left.select(F.col("ord").alias("l_ord"), F.col("extension").alias("ext"), F.col("text").alias("l_text")), "l_ord").join(right.select(F.col("ord").alias("r_ord"), F.col("text").alias("r_text")), "r_ord")
    form = lambda c: similarity.featurise(text.newlines(F.col(c)), F.col("ext"))["form"]
    minor = texts.select("l_ord", "r_ord", F.coalesce(form("l_text") == form("r_text"), F.lit(False)).alias("minor"))
    state = F.when(F.col("same"), "identical").when(F.coalesce("minor", F.lit(False)), "minor").otherwise("different")
    return rows.join(minor, ["l_ord", "r_ord"], "left").withColumn("content_status", state).drop("same", "minor")
