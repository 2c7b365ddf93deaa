"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A document is a bag of lower-case words with their counts w.  Sample i of a term
draws r and c from Gamma(2, 1) and b from U(0, 1), all from hashes of the term and
i; t = floor(ln w / r + b), and the term with the least
ln a = ln c - r (t - b) - r is the document's sample.  As ln a depends on the term, t
and i alone, two documents share a sample if and only if they chose the same term at
the same t, which happens with the probability of their generalised Jaccard
similarity, sum(min w) / sum(max w).  Each sample is one 64-bit number, ln a in fixed
point with 40 binary places, so a minimum of numbers finds it; the fingerprint keeps its
low 32 bits, which is what likeness compares.

Scale.  Texts are shuffled once, by ranges of doc_id, with the first document of
each range as a guest of the range before it: a document then has its successor at
hand.  The ranges come from approximate quantiles, of some ``RANGE`` documents each: up to
``RANGES`` by one list, beyond that by another of up to ``WITHIN`` within each of those.  A
doc_id that fills more than one range (null, say) is divided by the hashes of its texts.
Term counts and minima need no further exchange; only finished fingerprints are joined.
Both sides of that join read the same columns, so that Spark runs the exchange of the
texts once.

Defined cases: null texts are empty; a text without words has one empty term, so such
texts are alike; the documents follow each other by descending doc_id (null last),
rows with a repeated doc_id by descending hash of the text; a single document is its own
successor; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import uuid
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, groups_for, partitions, shared_folder

SAMPLES = 32
#: Documents of a range, about; ranges of one list of quantiles, and lists within each, at most.
RANGE, RANGES, WITHIN = 128, 4096, 512
_STEP = 64
#: Stands for a null doc_id, below all others.
_NULL = -(1 << 63)


def _uniform(bits: str, n: int) -> str:
    return f"(({bits} + 0.5D) * {2.0**-n!r}D)"


def _sample(i: int) -> Column:
    """Sample i of the term with hash ``h`` and log count ``lw``."""
    x, y = f"xxhash64(h, {2 * i})", f"xxhash64(h, {2 * i + 1})"
    r = f"(-ln({_uniform(f'shiftrightunsigned({x}, 32)', 32)} * {_uniform(f'({x} & 4294967295)', 32)}))"
    c = f"(-ln({_uniform(f'shiftrightunsigned({y}, 40)', 24)} * {_uniform(f'(shiftrightunsigned({y}, 16) & 16777215)', 24)}))"
    b = _uniform(f"({y} & 65535)", 16)
    a = f"(ln({c}) - {r} * (floor(lw / {r} + {b}) - {b} + 1D))"
    return F.expr(f"min(cast({a} * 1099511627776D as bigint))")


def _range_of(bounds: list[int]) -> Column:
    """The number of bounds below ``key``, found in two steps."""
    if not bounds:
        return F.lit(0)
    parts = [bounds[i : i + _STEP] for i in range(0, len(bounds), _STEP)]
    heads = F.lit([p[0] for p in parts])
    part = F.size(F.filter(heads, lambda b: b < F.col("key")))
    parts = F.array(*[F.lit(p) for p in parts])
    within = F.size(F.filter(F.element_at(parts, F.greatest(part, F.lit(1))), lambda b: b < F.col("key")))
    return F.when(part == 0, 0).otherwise((part - 1) * _STEP + within)


def _cuts(n: int) -> list[float]:
    return [i / n for i in range(1, n)]


def _ranged(docs: DataFrame, each: int, ranges: int, within: int) -> DataFrame:
    """``docs`` (key, h and others) with ``range``, which grows with key and, within a hot key, with h."""
    wanted = max(1, -(-docs.count() // each))
    first = min(ranges, wanted)
    bounds = docs.select(F.percentile_approx("key", _cuts(first), 20_000)).first()[0] or [] if first > 1 else []
    docs = docs.withColumn("range", _range_of(sorted(set(bounds))).cast("long"))
    # a bound that occurs m times has the rows of m ranges
    hot = {k: m for k, m in Counter(bounds).items() if m > 1}
    times = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair]), F.col("key")), F.lit(1)) if hot else F.lit(1)
    times, step = times.cast("long"), F.lit(0)
    if wanted > first:
        deep = min(within, -(-wanted // first))
        own = docs.groupBy("range").agg(F.percentile_approx("key", _cuts(deep), 10_000).alias("bounds"))
        docs = docs.join(F.broadcast(own), "range")
        step = F.size(F.filter(F.array_distinct("bounds"), lambda b: b < F.col("key")))
        times = times * F.greatest(F.lit(1), F.size(F.filter("bounds", lambda b: b == F.col("key"))))
    # h is even over 63 bits
    part = F.when(times > 1, F.floor(F.col("h") / F.lit(2.0**63) * times) + 1).otherwise(0)
    return docs.withColumn("range", (F.col("range") * within + step) * (1 << 24) + F.least(part, F.lit((1 << 24) - 1))).drop("bounds")


def _with_next(docs: DataFrame, each: int, ranges: int, within: int) -> DataFrame:
    """Rows by range, numbered, each with its successor's text; and guest rows."""
    spark = docs.sparkSession
    parts = 4 * groups_for(docs, partitions(spark))
    text = F.coalesce("text", F.lit(""))
    docs = docs.select(text.alias("text"), F.coalesce("doc_id", F.lit(_NULL)).alias("key"), F.xxhash64(text).bitwiseAND(F.lit((1 << 63) - 1)).alias("h"))
    docs = _ranged(docs, each, ranges, within)
    # the first rows of the ranges, one for each
    heads = docs.groupBy("range").agg(F.max(F.struct("key", "h")).alias("head")).select("head.key", "head.h", F.col("range").alias("own"))
    above = F.coalesce(F.lead("own").over(Window.orderBy("own")), F.min("own").over(Window.orderBy("own").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = heads.select("key", "h", above.alias("range"))
    guests = docs.drop("range").join(F.broadcast(heads), ["key", "h"]).dropDuplicates(["key", "h", "range"])
    # a written table: both uses of the rows below are then one plan, whose exchange Spark runs once
    kept = f"{shared_folder(spark)}/guests-{uuid.uuid4().hex}"
    guests.select("text", "key", "h", "range").write.parquet(kept)
    guests = spark.read.schema("text string, key long, h long, range long").parquet(kept)
    docs = docs.withColumn("guest", F.lit(False)).unionByName(guests.withColumn("guest", F.lit(True)))
    order = Window.partitionBy("range").orderBy("guest", F.desc("key"), F.desc("h"), F.desc("text"))
    placed = docs.repartition(parts, "range")
    return placed.select("range", "guest", "key", "text", F.row_number().over(order).alias("at"), F.lead("text").over(order).alias("next"))


def fingerprint(docs: DataFrame, samples: int = SAMPLES, each: int = RANGE, ranges: int = RANGES, within: int = WITHIN) -> DataFrame:
    """The fingerprint of each text and of its edited text; see the module."""
    rows = _with_next(docs.select("doc_id", "text"), each, ranges, within)
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring(F.coalesce("next", F.lit("")), F.lit(1), third)))
    variants = F.array(F.col("text"), F.when(~F.col("guest"), F.col("edited")))
    texts = rows.select("range", "at", F.posexplode(variants).alias("edit", "text")).where("text is not null")
    terms = texts.select("range", "at", "edit", F.explode_outer(F.array_remove(F.split(F.lower("text"), "[ \t\n\x0b\f\r]+"), "")).alias("term"))
    counts = terms.select("range", "at", "edit", F.xxhash64("term").alias("h")).groupBy("range", "at", "edit", "h").agg(F.ln(F.count("*").cast("double")).alias("lw"))
    least = counts.groupBy("range", "at", "edit").agg(*[_sample(i).alias(f"s{i}") for i in range(samples)])
    least = least.select("range", "at", "edit", F.array(*[F.col(f"s{i}").bitwiseAND(F.lit(0xFFFFFFFF)) for i in range(samples)]).alias("s"))
    prints = least.groupBy("range", "at").agg(F.max(F.when(F.col("edit") == 0, F.col("s"))).alias("own"), F.max(F.when(F.col("edit") == 1, F.col("s"))).alias("new"))
    prints = prints.withColumn("next", F.lead("own").over(Window.partitionBy("range").orderBy("at"))).where("new is not null")

    def alike(x: str, y: str) -> Column:
        return F.size(F.filter(F.zip_with(x, y, lambda a, b: a == b), lambda e: e)) / F.lit(float(samples))

    def shown(x: str) -> Column:
        return F.array_join(F.transform(x, lambda s: F.lpad(F.lower(F.hex(s)), 8, "0")), "")

    described = rows.where("not guest").select("range", "at", F.nullif("key", F.lit(_NULL)).alias("doc_id"), n.cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"))
    return described.join(
        prints.select("range", "at", shown("own").alias("fingerprint"), shown("new").alias("edited_fingerprint"), alike("own", "new").alias("near_edited"), alike("own", "next").alias("near_next")),
        ["range", "at"],
    ).drop("range", "at")


def op8_weighted_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(documents(spark, sf_dir))
