"""Substring deduplication by paragraph MinHash banding.

Two kinds of unit are compared.  Paragraphs are the lines of ``PARAGRAPH`` words or
more, and the blocks of lines between blank ones that hold shorter lines too (text may
be wrapped) and as many words in all: MinHash signatures over their five-word shingles are banded, paragraphs that
collide in a band are joined, and the exact Jaccard similarity of their shingles (0.8
or more) decides.  ``bands`` tunes rows and bands so that a pair at the threshold is
missed with a probability of 1/1,000 at most.  Passages also begin and end within
lines, so texts are cut, regardless of lines, at words whose hash is the largest
within three words on either side; two neighbouring cuts form a unit that must match
exactly.  Cuts depend on nearby words only, so all but the edges of a passage is cut
alike wherever it stands.

Units of one class (equal, or connected by links: a component) repeat if they stand
in two documents.  The document with the smallest doc_id keeps them.  What repeats in a
document is merged into runs; runs of ``RUN`` words or more and those with a whole
paragraph count, and those that the document does not keep are removed.  Short common phrases and lines are left alone.

Scale.  Units and band keys travel as packed arrays and meet in buckets.  Only keys
that repeat come out; their places are found by another pass with a bitmap of at most
16 MiB and an exact join.  Equal units are one class, so copies give no pairs; a band
that many classes share gives the pairs with its smallest member first.  What is then
still apart within such bands of one smallest member meets in blocks of whole sets.
A slice of texts sends two documents of a unit at most, so a line that all share stays small.

Defined cases: null and empty texts have no units; rows with one doc_id are one
document (a null doc_id is below all others) and are cut each by its own text; a passage that repeats within one
document only is kept; an empty table gives no rows; extra columns pass unchanged.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, cut, documents, groups_for, partitions, per_batch, texts_of
from .components import components
from .jaccard import BLOCK, _bitmap, _passes, _rest, _verified
from .shingles import SIZE, hashed, joined, mix

PARAGRAPH = 20
RUN = 30
#: Words between two spans of one run.
GAP = 4
REACH = 3
SLICE = 1_000
SMALL = 16
_U = np.uint64
_A = _U(0x9E3779B97F4A7C15)
_NULL = -(1 << 63)


def bands(threshold: float = 0.8, miss: float = 0.001, most: int = 40) -> tuple[int, int]:
    """(bands, rows): the most selective banding that misses few pairs at the threshold."""
    best = (most, 1)
    for rows in range(1, 9):
        for n in range(1, most // rows + 1):
            if (1 - threshold**rows) ** n <= miss:
                best = (n, rows)
                break
    return best


BANDS, ROWS = bands()
_RNG = np.random.default_rng(20)
_MULTIPLY = _RNG.integers(1 << 62, 1 << 63, BANDS * ROWS, np.uint64) | _U(1)
_ADD = _RNG.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


class Units:
    """Units of some texts: paragraphs with signatures, and pairs of cuts."""

    def __init__(self, texts: list[str]):
        h, doc, line = hashed(texts)
        sizes = np.bincount(doc, minlength=len(texts))
        doc_at = np.concatenate(([0], np.cumsum(sizes)))
        # paragraphs
        at = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1], [True]))) if len(h) else np.zeros(1, np.int64)
        short = np.diff(at) < PARAGRAPH
        new = np.concatenate(([True], (doc[at[1:-1]] != doc[at[1:-1] - 1]) | (line[at[1:-1]] != line[at[1:-1] - 1] + 1)))[: len(short)]
        block = np.flatnonzero(np.append(new, True))
        wrapped = (np.diff(block) > 1) & (np.add.reduceat(short, block[:-1]) > 0) if len(short) else np.zeros(0, bool)
        begin, end = at[block[:-1]][wrapped], at[block[1:]][wrapped]
        enough = end - begin >= PARAGRAPH
        first, last = np.concatenate((at[:-1][~short], begin[enough])), np.concatenate((at[1:][~short], end[enough]))
        if len(first):
            all_ = joined(h)
            counts = last - first - SIZE + 1
            self.set_at = np.concatenate(([0], np.cumsum(counts)))
            self.sets = all_[np.repeat(first - self.set_at[:-1], counts) + np.arange(self.set_at[-1])]
            start = self.set_at[:-1]
            minima = np.stack([np.minimum.reduceat(self.sets * m + a, start) for m, a in zip(_MULTIPLY, _ADD)], 1)
            sig = np.zeros((len(first), BANDS), _U)
            for r in range(ROWS):
                sig = mix(sig + minima[:, r::ROWS])
            self.signatures = mix(sig + np.arange(1, BANDS + 1, dtype=_U) * _A)
            key = mix(np.add.reduceat(mix(self.sets), start) + counts.astype(_U))
        else:
            key = np.zeros(0, _U)
        self.paragraphs = len(first)
        # cuts: words whose hash exceeds those of the words nearby
        top = mix(h + _U(77))
        peak = np.ones(len(h), bool)
        for d in range(1, REACH + 1):
            near = doc[d:] == doc[:-d]
            peak[d:] &= ~near | (top[d:] > top[:-d])
            peak[:-d] &= ~near | (top[:-d] >= top[d:])
        at = np.flatnonzero(peak)
        a, b = at[:-2], at[2:]
        ok = doc[a] == doc[b] if len(a) else np.zeros(0, bool)
        a, b = a[ok], b[ok]
        two = joined(h, 2) if len(h) > 1 else np.zeros(0, _U)
        total = np.concatenate((np.zeros(1, _U), np.cumsum(two, dtype=_U)))
        cuts = mix(total[b - 1] - total[a] + mix(h[a] + _U(5)) + (b - a).astype(_U) * _A) if len(a) else np.zeros(0, _U)
        self.keys = np.concatenate((key, cuts)).view(np.int64)
        self.doc = np.concatenate((doc[first], doc[a])).astype(np.int64)
        begin, end = np.concatenate((first, a)), np.concatenate((last, b))
        self.begin, self.end = begin - doc_at[self.doc], end - doc_at[self.doc]


def _slices(batch: pa.RecordBatch):
    ids = column(batch, "doc_id").fill_null(_NULL).to_numpy()
    texts = texts_of(batch)
    for at in range(0, len(texts), SLICE):
        yield ids[at : at + SLICE], Units(texts[at : at + SLICE])


def _pairs(key: np.ndarray, value: np.ndarray, ends: bool) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (key, value); with ``ends`` only the least and the greatest value of a key."""
    order = np.lexsort((value, key))
    key, value = key[order], value[order]
    first = np.concatenate(([True], key[1:] != key[:-1]))[: len(key)]
    fresh = first.copy()
    fresh[1:] |= value[1:] != value[:-1]
    if ends:  # of a key's equal greatest values the first one is fresh
        key, value, first = key[fresh], value[fresh], first[fresh]
        fresh = first | np.append(first[1:], True)[: len(first)]
    return key[fresh], value[fresh]


def _dealt(docs: DataFrame, buckets: int) -> DataFrame:
    """Keys by bucket: of units with doc_ids, of bands with classes.

    Two documents make a unit repeat, so a slice sends two doc_ids of a unit at most,
    however many of its texts hold it.
    """

    def rows(batch):
        for ids, u in _slices(batch):
            out = {"bucket": [], "band": [], "keys": [], "values": []}
            classes = np.repeat(u.keys[: u.paragraphs], BANDS)
            for band, key, value in ((False, u.keys.view(_U), ids[u.doc]), (True, u.signatures.ravel(), classes)):
                key, value = _pairs(key, value, not band)
                bucket = (key % _U(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                key, value = key[order], value[order]
                cuts = np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=buckets))))
                for b in np.flatnonzero(np.diff(cuts)):
                    for col, v in zip(out.values(), (b, band, key[cuts[b] : cuts[b + 1]].tobytes(), value[cuts[b] : cuts[b + 1]].tobytes())):
                        col.append(v)
            yield out

    return per_batch(docs.select("doc_id", "text"), rows, "bucket int, band boolean, keys binary, values binary")


def _shared(table: pa.Table, band: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, value) of keys with two values or more, and where keys begin."""
    mine = table.filter(table.column("band") if band else pc.invert(table.column("band")))
    key, value = (np.frombuffer(b"".join(mine.column(n).to_pylist()), np.int64) for n in ("keys", "values"))
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    same = np.concatenate(([False], key[1:] == key[:-1], [False])) if len(key) else np.zeros(1, bool)
    often = same[1:] | same[:-1]
    key, value = key[often], value[often]
    order = np.lexsort((value, key))
    key, value = key[order], value[order]
    fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (value[1:] != value[:-1])))[: len(key)]
    key, value = key[fresh], value[fresh]
    starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True]))) if len(key) else np.zeros(1, np.int64)
    return key, value, starts


def _meet(table: pa.Table) -> pa.Table:
    """Keys in two documents or more (key, null), and candidate classes (a, b).

    ``large`` marks the pairs of a large band's smallest member with the others.
    """
    key, _, starts = _shared(table, False)
    repeated = key[starts[:-1]][np.diff(starts) > 1]
    _, value, starts = _shared(table, True)
    sizes, pairs, stars = np.diff(starts), [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
    for g in np.unique(sizes[(sizes > 1) & (sizes <= SMALL)]):
        rows = value[starts[:-1][sizes == g][:, None] + np.arange(g)]
        i, j = np.triu_indices(g, 1)
        pairs.append(np.stack((rows[:, i].ravel(), rows[:, j].ravel()), 1))
    for a, n in zip(starts[:-1][sizes > SMALL], sizes[sizes > SMALL]):
        stars.append(np.stack((np.full(n - 1, value[a]), value[a + 1 : a + n]), 1))
    two, star = np.unique(np.concatenate(pairs), axis=0), np.unique(np.concatenate(stars), axis=0)
    both = np.concatenate((two, star))
    return pa.table({
        "a": pa.array(np.concatenate((repeated, both[:, 0])), pa.int64()),
        "b": pa.concat_arrays([pa.nulls(len(repeated), pa.int64()), pa.array(both[:, 1], pa.int64())]),
        "large": pa.array(np.arange(len(repeated) + len(both)) >= len(repeated) + len(two)),
    })


def _sets_of_classes(batch: pa.RecordBatch, wanted):
    for _, u in _slices(batch):
        keys = u.keys[: u.paragraphs]
        yield {int(keys[i]): np.unique(u.sets[u.set_at[i] : u.set_at[i + 1]]) for i in np.flatnonzero(wanted(keys))}


def _runs(spans: list[dict]) -> list[tuple[int, int, bool, int]]:
    """Runs (begin, end, removed, keeper) of one document, of RUN words or with a whole paragraph."""
    out = []
    for removed in (False, True):
        begin = end = covered = keeper = whole = None
        for s in [*(x for x in spans if x["removed"] == removed), None]:
            if s is not None and begin is not None and s["begin"] <= end + GAP:
                covered += max(0, s["end"] - max(s["begin"], end))
                end = max(end, s["end"])
                keeper, whole = min(keeper, s["keeper"]), whole or s["whole"]
                continue
            if begin is not None and (covered >= RUN or whole):
                out.append((begin, end, removed, keeper))
            if s is not None:
                begin, end, covered, keeper, whole = s["begin"], s["end"], s["end"] - s["begin"], s["keeper"], s["whole"]
    return sorted(out)


def _passages(docs: DataFrame, block: int) -> DataFrame:
    """doc_id, row (a hash of the text), and the columns of ``repeats``."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("row"))
    met = cut(_dealt(docs, 3 * groups_for(docs, partitions(spark))).groupBy("bucket").applyInArrow(_meet, "a long, b long, large boolean"))
    pairs, stars = (met.where(w).select("a", "b").distinct() for w in ("b is not null", "large"))
    links = _verified(docs, cut(pairs), None, _sets_of_classes)
    groups = stars.select(F.col("a").alias("grp"), F.inline(F.array(F.struct(F.col("a").alias("id")), F.struct(F.col("b").alias("id"))))).distinct()
    names = cut(components(_rest(docs, cut(groups), links, None, _sets_of_classes, block)))
    keys = met.where("b is null").select(F.col("a").alias("id")).unionByName(names.select("id")).distinct()
    keys = cut(keys.join(names, "id", "left").select(F.col("id").alias("key"), F.coalesce("component", "id").alias("component")))
    shared = spark.sparkContext.broadcast(_bitmap(keys.select("key")))

    def places(batch):
        texts = column(batch, "row").to_numpy()
        for at, (ids, u) in zip(range(0, len(texts), SLICE), _slices(batch)):
            ok = _passes(shared.value, u.keys)
            doc = u.doc[ok]
            yield {"key": u.keys[ok], "doc_id": ids[doc], "row": texts[at + doc], "begin": u.begin[ok], "end": u.end[ok], "whole": np.flatnonzero(ok) < u.paragraphs}

    found = cut(per_batch(docs, places, "key long, doc_id long, row long, begin long, end long, whole boolean").join(keys, "key").drop("key"))
    shared.destroy()
    kept = found.groupBy("component").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("other")).where("keeper < other").drop("other")
    spans = found.join(kept, "component").select("doc_id", "row", F.struct("begin", "end", F.expr("doc_id <> keeper").alias("removed"), "keeper", "whole").alias("span"))
    spans = spans.groupBy("doc_id", "row").agg(F.sort_array(F.collect_set("span")).alias("spans"))

    def runs(batch):
        out = {"doc_id": [], "row": [], "begin": [], "end": [], "n_words": [], "removed": [], "keeper": []}
        for doc_id, row, spans in zip(*(column(batch, c).to_pylist() for c in ("doc_id", "row", "spans"))):
            for begin, end, removed, keeper in _runs(spans):
                for col, v in zip(out.values(), (None if doc_id == _NULL else doc_id, row, begin, end, end - begin, removed, None if keeper == _NULL else keeper)):
                    col.append(v)
        return out

    return per_batch(spans, runs, "doc_id long, row long, begin long, end long, n_words long, removed boolean, keeper long")


def repeats(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """doc_id, begin, end (words), n_words, removed, keeper of each repeated passage.

    Rows exist for documents with repeated passages only.  ``keeper`` is the smallest
    doc_id in which a part of the passage stands.
    """
    return _passages(docs, block).drop("row")


_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans (begin, end); the rest stays as it is."""
    data = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(data)]
    out, last = [], 0
    for begin, end in sorted(spans):
        out.append(data[last : max(last, at[begin][0])])
        last = at[end][0] if end < len(at) else len(data)
    return b"".join([*out, data[last:]]).decode("utf-8", "surrogatepass")


def deduplicate(docs: DataFrame) -> DataFrame:
    """``docs`` with the removed passages cut out of ``text`` (and ``n_chars`` anew).

    Columns and rows stay; a text may become empty.
    """
    spans = _passages(docs, BLOCK).where("removed").groupBy("doc_id", "row").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    own = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns are called, none clashes
    doc_id, text, n_chars = (own[docs.columns.index(c)] if c in docs.columns else None for c in ("doc_id", "text", "n_chars"))
    rows = docs.toDF(*own)
    rows = rows.join(spans, rows[doc_id].eqNullSafe(spans["doc_id"]) & (F.xxhash64(text) == spans["row"]), "left")

    @F.pandas_udf("string")
    def clean(text, spans):
        return text.combine(spans, lambda t, s: without(t, [(x["begin"], x["end"]) for x in s]) if s is not None and len(s) and t is not None else t)

    cut_out = F.col("spans").isNotNull()
    rows = rows.withColumn("new", F.when(cut_out, clean(F.when(cut_out, F.col(text)), "spans")).otherwise(F.col(text)))
    out = {c: F.col(c) for c in own} | {text: F.col("new")}
    if n_chars:
        kind = docs.schema["n_chars"].dataType
        out[n_chars] = F.when(cut_out, F.length("new").cast(kind)).otherwise(F.col(n_chars))
    return rows.select(*[out[c].alias(name) for c, name in zip(own, docs.columns)])


def op3_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeats(documents(spark, sf_dir))
