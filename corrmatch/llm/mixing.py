"""Mixing sources to target weights by iterative proportional fitting, in SQL functions.

Documents are weighed in words.  Their totals by source, language and topic form the
cells of a table, which is raked: in turn, each dimension's cells are scaled so that
their sums meet its target shares, until no factor differs from 1 by ``EPSILON``.  Targets
that contradict each other have no such end: when that difference no longer changes, or after
``ROUNDS`` rounds, the shares stand as they are, and ``_gap`` says by how much a factor of the
last round still differed from 1 (``converged`` in the query: whether it is below ``EPSILON``).  A cell's weight is its
raked share over its own share; a document is kept with probability weight / largest
weight, so that the kept words meet the targets in expectation and no probability
exceeds 1.  The draw is a hash of doc_id, so it can be repeated.

Targets are shares by value, or an exponent: the value's own share to that power, made
to sum to 1 (1 leaves a dimension as it is, 0 makes its values equal).  Shares by value
name all that is wanted: documents of a value that they do not name have probability 0.

Topics here are the form of a text, from counts over the whole of it: tables (bars),
figures (digits), symbols, lists (short lines), prose.  Another column can be given.

Scale.  Texts are not shuffled: words are summed before a shuffle, raking works on cells
only, and factors are joined back, not collected.  At most ``BROADCAST`` cells are raked
in one partition, without an exchange, and broadcast to the documents; more take the same
steps with exchanges, and Spark's join deals them and splits the hot ones.

Defined cases: a null source or language is a value of its own, ''; a null or empty text
weighs nothing and has probability 0, so it is not kept, unless all weigh nothing; rows
with one doc_id share their draw; a target for a value that no document has is left out;
an empty table gives no rows; extra columns pass unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read

DIMENSIONS = ("source", "lang", "topic")
#: Default targets: exponents.
TARGETS: dict[str, float | dict[str, float]] = {"source": 0.8, "lang": 0.8, "topic": 0.9}
ROUNDS = 200
EPSILON = 1e-9
BROADCAST = 50_000
SEED = "mix"
_SPACE = "[ \t\n\x0b\f\r]+"


def words(text: str = "text") -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(F.col(text), F.lit("")), _SPACE), "")).cast("long")


def topic(text: str = "text", n_words: str = "_words") -> Column:
    """The form of a text; the rules are tried in order."""
    t = F.coalesce(F.col(text), F.lit(""))
    n = F.length(t)

    def count(chars: str) -> Column:
        rest = t
        for c in chars:  # a character that is absent costs a search of bytes only
            rest = F.replace(rest, F.lit(c), F.lit(""))
        return n - F.length(rest)

    def share(chars: str) -> Column:
        return count(chars) / F.greatest(n, F.lit(1))

    lines = count("\n") + 1
    return (
        F.when(count("|") * 10 >= F.greatest(F.col(n_words), F.lit(1)), "table").when(share("0123456789") >= 0.05, "figures")
        .when(share("%$#&*!") >= 0.02, "symbols").when(lines * 8 >= F.greatest(F.col(n_words), F.lit(8)), "list").otherwise("prose")
    )


def draw(key: str, seed: str = SEED) -> Column:
    """A number of [0, 1) from a hash of the column."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _targets(cells: DataFrame, dimension: str, target: float | dict[str, float]) -> DataFrame:
    """value, share of the words that each value is to have."""
    total = F.when(F.sum("w") > 0, F.pow(F.sum("w"), F.lit(0.0 if isinstance(target, dict) else float(target)))).otherwise(0.0)
    values = cells.groupBy(F.col(dimension).alias("value")).agg(total.alias("t"))
    if isinstance(target, dict):
        named = F.create_map(*[F.lit(x) for k, v in target.items() for x in (k, float(v))]) if target else F.lit(None).cast("map<string,double>")
        values = values.select("value", F.coalesce(F.try_element_at(named, F.col("value")), F.lit(0.0)).alias("t"))
    values = cut(values)
    all_ = values.agg(F.sum("t")).first()[0] or 0.0
    return values.select("value", (F.col("t") / F.lit(all_) if all_ > 0 else F.lit(0.0)).alias("t"))


def rake(cells: DataFrame, targets: dict[str, float | dict[str, float]], rounds: int = ROUNDS, alone: bool = False) -> DataFrame:
    """``cells`` (dimensions and words w) with ``share``, the raked share of each cell, and ``gap``.

    ``alone`` says that the cells are in one partition.
    """
    state = cells.withColumn("share", F.col("w").cast("double"))

    def joined(left: DataFrame, right: DataFrame, *on) -> DataFrame:
        return left.join(right.hint("merge") if alone else right, *on)

    for d, target in targets.items():
        state = joined(state, _targets(cells, d, target).toDF(d, f"t_{d}"), d)
    state, gap = cut(state), 0.0
    for _ in range(rounds):
        before = gap
        off = F.lit(0.0)
        for d in targets:
            now = state.groupBy(F.col(d).alias("v")).agg(F.sum("share").alias("now"), F.first(f"t_{d}").alias("t"))
            factor = now.select("v", F.when(F.col("now") > 0, F.col("t") / F.col("now")).otherwise(0.0).alias(f"f_{d}"))
            state = joined(state, factor, state[d] == factor["v"]).drop("v").withColumn("share", F.col("share") * F.col(f"f_{d}"))
            if d != next(iter(targets)):
                off = F.greatest(off, F.when(F.col("share") > 0, F.abs(F.col(f"f_{d}") - 1)).otherwise(0.0))
        state = cut(state.withColumn("off", off).drop(*[f"f_{d}" for d in targets]))
        gap = state.agg(F.max("off")).first()[0] or 0.0
        if gap < EPSILON or abs(gap - before) < EPSILON:  # as near as it gets
            break
    return state.select(*cells.columns, "share", F.lit(gap).alias("gap"))


def mix(docs: DataFrame, targets: dict[str, float | dict[str, float]] | None = None, topics: Column | None = None, seed: str = SEED) -> DataFrame:
    """``docs`` with _topic, _words, _weight, _gap, _probability and _kept."""
    targets = targets or TARGETS
    rows = docs.withColumn("_words", words()).withColumn("_topic", topics if topics is not None else topic())
    keys = {"source": F.coalesce(F.col("source"), F.lit("")), "lang": F.coalesce(F.col("lang"), F.lit("")), "topic": F.col("_topic")}
    cells = cut(rows.groupBy(*[keys[d].alias(d) for d in DIMENSIONS]).agg(F.sum("_words").alias("w")))
    small = cells.count() <= BROADCAST
    raked = rake(cells.coalesce(1) if small else cells, targets, alone=small)
    all_, shares = raked.agg(F.sum("w"), F.sum("share")).first()
    weight = F.when(F.col("w") > 0, F.col("share") * F.lit(float(all_)) / F.col("w") / F.lit(shares)).otherwise(0.0) if all_ and shares else F.lit(0.0)
    raked = cut(raked.select(*[F.col(d).alias(f"_c_{d}") for d in DIMENSIONS], weight.alias("_weight"), F.col("gap").alias("_gap")))
    most = raked.agg(F.max("_weight")).first()
    p = F.col("_weight") / F.lit(most[0]) if most[0] else F.lit(1.0)
    same = [keys[d] == F.col(f"_c_{d}") for d in DIMENSIONS]
    out = rows.join(F.broadcast(raked) if small else raked, same).drop(*[f"_c_{d}" for d in DIMENSIONS])
    p = F.when(F.col("_words") > 0, p).otherwise(F.lit(0.0 if most[0] else 1.0))
    return out.withColumn("_probability", p).withColumn("_kept", draw("doc_id", seed) < F.col("_probability"))


OWN = ("_topic", "_words", "_weight", "_gap", "_probability", "_kept", *[f"_c_{d}" for d in DIMENSIONS])


def sample(docs: DataFrame, **how) -> DataFrame:
    """The kept rows of ``docs``, with its columns, whatever their names."""
    names = {c: f"__{i}" if c in OWN else c for i, c in enumerate(docs.columns)}
    rows = mix(docs.select(*[F.col(c).alias(n) for c, n in names.items()]), **how).where("_kept")
    return rows.select(*[F.col(n).alias(c) for c, n in names.items()])


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(read(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return rows.select(
        "doc_id", "source", "lang", F.col("_topic").alias("topic"), F.col("_words").alias("n_words"),
        F.round("_weight", 6).alias("weight"), F.round("_probability", 6).alias("probability"), F.col("_kept").alias("kept"), (F.col("_gap") < EPSILON).alias("converged"),
    )


def _sql() -> str:
    chars = lambda s: f"(length(t) - length(translate(t, '{s}', '')))"
    lines = "(length(t) - length(replace(t, chr(10), '')) + 1)"
    parts = [f"""WITH d0 AS (
  SELECT doc_id, source, lang, coalesce(text, '') AS t,
    len(list_filter(string_split_regex(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '')) AS n_words FROM documents),
d AS (SELECT *, CASE WHEN {chars('|')} * 10 >= greatest(n_words, 1) THEN 'table' WHEN {chars('0123456789')}::DOUBLE / greatest(length(t), 1) >= 0.05 THEN 'figures'
  WHEN {chars('%$#&*!')}::DOUBLE / greatest(length(t), 1) >= 0.02 THEN 'symbols' WHEN {lines} * 8 >= greatest(n_words, 8) THEN 'list' ELSE 'prose' END AS topic FROM d0),
c0 AS (SELECT coalesce(source, '') AS source, coalesce(lang, '') AS lang, topic, sum(n_words)::DOUBLE AS w FROM d GROUP BY ALL)"""]
    for d in DIMENSIONS:
        parts.append(f"t_{d} AS (SELECT {d}, pow(sum(w), {TARGETS[d]}) / sum(pow(sum(w), {TARGETS[d]})) OVER () AS t FROM c0 GROUP BY {d})")
    parts.append("s0 AS MATERIALIZED (SELECT c0.*, w AS s, a.t AS ta, b.t AS tb, c.t AS tc FROM c0 JOIN t_source a USING (source) JOIN t_lang b USING (lang) JOIN t_topic c USING (topic))")
    last = "s0"
    for i in range(20):
        for d, t in zip(DIMENSIONS, ("ta", "tb", "tc")):
            now = f"s{i}_{d}"
            parts.append(f"{now} AS MATERIALIZED (SELECT * REPLACE (s * {t} / sum(s) OVER (PARTITION BY {d}) AS s) FROM {last})")
            last = now
    gaps = " UNION ALL ".join(f"SELECT abs(sum(s) / any_value({t}) - 1) AS off FROM {last} GROUP BY {d}" for d, t in zip(DIMENSIONS, ("ta", "tb", "tc")))
    parts.append(f"g AS (SELECT max(off) AS gap FROM ({gaps}))")
    parts.append(f"f AS (SELECT source, lang, topic, CASE WHEN w > 0 THEN s * (sum(w) OVER ()) / w / (sum(s) OVER ()) ELSE 0 END AS weight FROM {last})")
    return ",\n".join(parts) + f"""
SELECT doc_id, d.source, d.lang, d.topic, n_words::BIGINT AS n_words, round(weight, 6) AS weight, round(p, 6) AS probability,
  ('0x' || substr(md5('{SEED}:' || doc_id), 1, 8))::BIGINT / 4294967296.0 < p AS kept, (SELECT gap FROM g) < {EPSILON!r} AS converged
FROM (SELECT d.*, weight, CASE WHEN n_words > 0 THEN weight / (SELECT max(weight) FROM f) ELSE 0 END AS p
  FROM d JOIN f ON coalesce(d.source, '') = f.source AND coalesce(d.lang, '') = f.lang AND d.topic = f.topic) d"""  # fmt: skip


SQL = _sql()
