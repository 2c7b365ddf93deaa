"""N-gram Jaccard join by PartEnum signatures.

Two sets with Jaccard similarity of at least 0.8 differ in at most
floor((|r| + |s|) / 9) elements.  Set sizes are cut into bands.  A band of sizes
lo..hi has k = floor(2 hi / 9); its signatures divide the feature domain (the
64-bit hashes of the shingles) into n1 groups of n2 parts.  At most
floor(k / (k2 + 1)) groups hold more than k2 differences, so in one of the others
n2 - k2 parts agree: a signature is the content of such a subset of parts.  Bands
of short sets enumerate the three pairs of n2 = 3 parts (k2 = 1), where common
passages weigh most; bands of long sets, whose many groups select enough, use
n2 = 1.  A set signs in its own band and in that of 5/4 of its size.

A subset without elements says nothing, so it is left out, unless a set has too
few filled groups for the argument above to hold without it: then all its subsets
are kept.  No link is lost, whatever the sizes.

Scale.  Signatures travel as packed arrays, one row for a batch and a bucket, and
equal sets of a batch only once.  In a bucket, sets that share a signature become
candidates: all pairs of a small group, but of a large one only the pairs with its
smallest member.  These are verified on the whole sets.  What is then still apart
within the large groups of one smallest member meets in blocks, first by sizes and counts
in cells, which leave few; then their whole sets, for the exact test.  As soon as a block
has linked two sets, it takes their links as one.  Copies meet as one class, so a group of copies never
multiplies.

Defined cases: null and empty texts and texts without words have the empty set,
``n_shingles`` 0, and are linked with nothing; a text of fewer than five words is
one shingle; repeated doc_ids are rows of their own with the same component; extra
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, cut, documents, groups_for, partitions, per_batch, texts_of
from .components import both_ways, components
from .shingles import intersection, mix, shingle_sets

#: Documents of which the signatures are made at a time.
SLICE = 2_000
#: Larger groups give pairs with their smallest member first.
SMALL = 16
#: Sets, and elements of sets, on each side of a block of a large group, about.
BLOCK, ELEMENTS = 2_048, 2_000_000
#: Cells of the counts by which sets are first compared: about a quarter of the size of a large set.
FEWEST, MOST = 128, 8_192
#: Bits of the broadcast bitmap at most (16 MiB); beyond it more sets pass in vain.
BITMAP = 1 << 27
#: Sets of one neighbourhood that are verified in one group, about.
TOGETHER = 2_000
_U = np.uint64


def _bands() -> list[tuple[int, int, int, int, int, int]]:
    """(lo, hi, k, n1, k2, n2) of each band of set sizes."""
    out, lo = [], 1
    while lo < 1 << 31:
        hi = max(lo, int(lo * 1.4))
        k = 2 * hi // 9
        k2, n2 = (1, 3) if 0 < k < 64 else (0, 1)
        bad = k // (k2 + 1)
        out.append((lo, hi, k, bad + 1 + -(-bad * 15 // 100), k2, n2))
        lo = hi + 1
    return out


BANDS = _bands()
_HI = np.array([b[1] for b in BANDS])


def _signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(signature, index of the set) of all sets, none of which is empty."""
    sizes = np.array([len(s) for s in sets])
    own, next_ = np.searchsorted(_HI, sizes), np.searchsorted(_HI, sizes * 5 // 4)
    sigs, who = [], []
    for band in np.unique(np.concatenate((own, next_))):
        _, _, k, n1, k2, n2 = BANDS[band]
        mine = np.flatnonzero((own <= band) & (band <= next_))
        p = n1 * n2
        h = np.concatenate([sets[i] for i in mine])
        # sorted hashes: the parts of a set ascend, and so do these numbers
        cell = np.repeat(np.arange(len(mine)) * p, sizes[mine]) + ((h >> _U(32)) * _U(p) >> _U(32)).astype(np.int64)
        start = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        content = np.zeros(len(mine) * p, _U)
        content[cell[start]] = np.add.reduceat(mix(h + _U(band + 1)), start)
        filled = np.zeros(len(mine) * p, bool)
        filled[cell[start]] = True
        content, filled = content.reshape(-1, n1, n2), filled.reshape(-1, n1, n2)
        solid = (filled.sum(2) > k2).sum(1) > k // (k2 + 1)
        group = mix(np.arange(n1, dtype=_U) + _U(int(band) << 32))
        for out in range(n2) if k2 else [-1]:
            kept = [i for i in range(n2) if i != out]
            sig = group + _U(out + 2)
            for i in kept:
                sig = mix(sig + content[:, :, i])
            give = filled[:, :, kept].any(2) | ~solid[:, None]
            sig = np.broadcast_to(sig, give.shape)
            sigs.append(sig[give])
            who.append(mine[np.nonzero(give)[0]])
    return np.concatenate(sigs), np.concatenate(who)


def _key(s: np.ndarray, salt: int) -> int:
    return int(mix(np.array([np.add.reduce(mix(s ^ _U(salt))) + _U(len(s))], _U)).view(np.int64)[0])


def _cells(s: np.ndarray) -> bytes:
    """How many elements fall in each of 2^k cells (255 at most), by their low bits."""
    n = min(MOST, max(FEWEST, 1 << (len(s) // 4).bit_length()))
    return np.minimum(np.bincount((s & _U(n - 1)).astype(np.int64), minlength=n), 255).astype(np.uint8).tobytes()


def _folded(cells: bytes, n: int) -> np.ndarray:
    """Counts in ``n`` cells from counts in as many or more."""
    return np.frombuffer(cells, np.uint8).astype(np.int32).reshape(-1, n).sum(0)


def _apart(a: bytes, b: bytes) -> int:
    """At most the number of elements that two sets do not share."""
    n = min(len(a), len(b))
    x, y = _folded(a, n), _folded(b, n)
    # a full cell may hold more than it says: it is left out
    sure = (x < 255) & (y < 255)
    return int(np.abs(x - y)[sure].sum())


def _sets(texts: list[str]):
    for at in range(0, len(texts), SLICE):
        yield from shingle_sets(texts[at : at + SLICE])


def sets_of(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash (k1, k2) and the cell counts of each set."""

    def rows(batch):
        out = {"n_shingles": [], "k1": [], "k2": [], "cells": []}
        for s in _sets(texts_of(batch)):
            for col, v in zip(out.values(), (len(s), _key(s, 0), _key(s, 12345), _cells(s))):
                col.append(v)
        return {"doc_id": column(batch, "doc_id"), **out}

    return per_batch(docs.select("doc_id", "text"), rows, "doc_id long, n_shingles long, k1 long, k2 long, cells binary")


def _signed(docs: DataFrame, buckets: int) -> DataFrame:
    def rows(batch):
        texts = texts_of(batch)
        for at in range(0, len(texts), SLICE):
            own = {_key(s, 0): s for s in shingle_sets(texts[at : at + SLICE]) if len(s)}
            if not own:
                continue
            keys = np.fromiter(own, np.int64, len(own))
            sig, who = _signatures(list(own.values()))
            bucket = (sig % _U(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            bucket, sig, key = bucket[order], (sig[order] >> _U(32)).astype(np.uint32), keys[who[order]]
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
            yield {
                "bucket": bucket[cuts[:-1]],
                "sigs": [sig[a:b].tobytes() for a, b in zip(cuts, cuts[1:])],
                "keys": [key[a:b].tobytes() for a, b in zip(cuts, cuts[1:])],
            }

    return per_batch(docs.select("text"), rows, "bucket int, sigs binary, keys binary")


def _meet(table: pa.Table, small: int) -> pa.Table:
    """Candidates of a bucket: (a, b, whether of a large group, a its smallest member)."""
    sig = np.frombuffer(b"".join(table.column("sigs").to_pylist()), np.uint32)
    key = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.int64)
    order = np.argsort(sig, kind="stable")
    sig, key = sig[order], key[order]
    same = np.concatenate(([False], sig[1:] == sig[:-1], [False]))
    often = same[1:] | same[:-1]  # signatures of one set only are most; they go first
    sig, key = sig[often], key[often]
    order = np.lexsort((key, sig))
    sig, key = sig[order], key[order]
    fresh = np.concatenate(([True], (sig[1:] != sig[:-1]) | (key[1:] != key[:-1])))[: len(sig)]
    sig, key = sig[fresh], key[fresh]
    starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1], [True]))) if len(sig) else np.zeros(1, int)
    sizes, pairs, stars = np.diff(starts), [np.zeros((0, 2), np.int64)], [np.zeros((0, 2), np.int64)]
    for g in np.unique(sizes[(sizes > 1) & (sizes <= small)]):
        rows = key[starts[:-1][sizes == g][:, None] + np.arange(g)]
        i, j = np.triu_indices(g, 1)
        pairs.append(np.stack((rows[:, i].ravel(), rows[:, j].ravel()), 1))
    for a, n in zip(starts[:-1][sizes > small], sizes[sizes > small]):
        stars.append(np.stack((np.full(n - 1, key[a]), key[a + 1 : a + n]), 1))
    two, star = np.unique(np.concatenate(pairs), axis=0), np.unique(np.concatenate(stars), axis=0)
    both = np.concatenate((two, star))
    return pa.table({"a": pa.array(both[:, 0]), "b": pa.array(both[:, 1]), "large": pa.array(np.arange(len(both)) >= len(two))})


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap of the keys' (column key, repeated or not) residues; never more than ``BITMAP`` bits."""
    n = keys.count()
    bits = min(BITMAP, 1 << max(10, (32 * n).bit_length()))
    at = keys.select(F.expr(f"pmod(key, {bits})").alias("at"))
    words = at.groupBy(F.expr("shiftright(at, 6)").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("x")).toArrow()
    out = np.zeros(bits >> 6, np.int64)
    out[words.column("w").to_numpy()] = words.column("x").to_numpy()
    return out.view(_U)


def _passes(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    place = keys & np.int64((len(bitmap) << 6) - 1)
    return (bitmap[place >> 6] >> (place & 63).astype(_U) & _U(1)).astype(bool)


def _held(docs: DataFrame, sets, bitmap) -> DataFrame:
    """key, hashes of the sets of ``docs`` that a broadcast bitmap of keys lets through.

    ``sets(batch, wanted)`` yields {key: set} of a batch's rows that ``wanted`` (keys to a
    mask) lets through.
    """

    def rows(batch):
        for found in sets(batch, lambda keys: _passes(bitmap.value, keys)):
            yield {"key": list(found), "hashes": [s.tobytes() for s in found.values()]}

    return per_batch(docs, rows, "key long, hashes binary")


def _verified(docs: DataFrame, pairs: DataFrame, named: DataFrame | None, sets) -> DataFrame:
    """Those of the pairs (a < b) whose whole sets have a similarity of 0.8 or more.

    ``named`` has the key of each id; without it ids are keys.  Texts are not
    shuffled: each task passes on the few sets that a bitmap of the keys lets through.
    Pairs meet their sets in groups.  Those of one neighbourhood (two steps toward the
    smallest id) go to one group, so that a set travels once for many pairs; a
    neighbourhood of more than ``TOGETHER`` sets is divided.
    """
    spark = docs.sparkSession
    both = both_ways(pairs)
    label = both.groupBy("u").agg(F.min("v").alias("near")).select(F.col("u").alias("v"), F.least("u", "near").alias("near"))
    label = both.join(label, "v").groupBy("u").agg(F.min("near").alias("near"))
    pairs = cut(pairs.join(label.select(F.col("u").alias("a"), "near"), "a"))
    crowd = pairs.groupBy("near").agg(F.ceil(F.greatest(F.approx_count_distinct("b") / TOGETHER, F.count("*") / (10 * TOGETHER))).alias("parts"))
    place = F.expr(f"cast(pmod(xxhash64(near, pmod(xxhash64(b), parts)), {4 * groups_for(docs, partitions(spark))}) as int)")
    pairs = cut(pairs.join(crowd, "near").select("a", "b", place.alias("grp")))
    members = pairs.select("grp", F.explode(F.array("a", "b")).alias("id")).distinct()
    members = cut(members.withColumn("key", F.col("id")) if named is None else members.join(named.select("key", "id"), "id"))
    bitmap = spark.sparkContext.broadcast(_bitmap(members.select("key")))

    def exact(own: pa.Table, held: pa.Table) -> pa.Table:
        known = {i: np.frombuffer(h, _U) for i, h in zip(held.column("id").to_pylist(), held.column("hashes").to_pylist())}
        ok = []
        for x, y in zip(own.column("a").to_pylist(), own.column("b").to_pylist()):
            x, y = known[x], known[y]
            shared = intersection(x, y)
            ok.append(100 * shared >= 80 * (len(x) + len(y) - shared))
        return own.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    held = _held(docs, sets, bitmap).join(members, "key").select(F.col("grp").alias("place"), "id", "hashes")
    links = cut(pairs.groupBy("grp").cogroup(held.groupBy("place")).applyInArrow(exact, "a long, b long"))
    bitmap.destroy()
    return links


def _sets_of_keys(batch: pa.RecordBatch, wanted):
    texts = texts_of(batch)
    for at in range(0, len(texts), SLICE):
        own = {_key(s, 0): s for s in shingle_sets(texts[at : at + SLICE]) if len(s)}
        ok = wanted(np.fromiter(own, np.int64, len(own))).tolist()
        yield {k: s for (k, s), keep in zip(own.items(), ok) if keep}


def _possible(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose sizes and cell counts (na, ca, nb, cb) allow a link."""

    def rows(batch):
        n = (column(batch, "na").to_numpy() + column(batch, "nb").to_numpy()).tolist()
        keep = pa.array([9 * _apart(a, b) <= m for a, b, m in zip(column(batch, "ca").to_pylist(), column(batch, "cb").to_pylist(), n)], pa.bool_())
        return {"a": column(batch, "a").filter(keep), "b": column(batch, "b").filter(keep)}

    near = pairs.where("100 * least(na, nb) >= 80 * greatest(na, nb)")
    return per_batch(near.select("a", "b", "na", "nb", "ca", "cb"), rows, "a long, b long")


class _Block:
    """The columns of a block of a large group; only pairs of a left and a right row count."""

    def __init__(self, table: pa.Table, n: np.ndarray):
        self.ids, side = (table.column(c).combine_chunks().to_numpy() for c in ("id", "side"))
        self.label = np.unique(table.column("label").combine_chunks().to_numpy(), return_inverse=True)[1]
        self.diagonal = bool(table.column("diagonal")[0].as_py())
        rows = np.arange(len(side))
        self.left, right = (rows, rows) if self.diagonal else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
        self.n, self.order = n, right[np.argsort(n[right], kind="stable")]
        self.sizes = n[self.order]

    def near(self, i: int) -> np.ndarray:
        """Right rows of another label whose size allows a link with row i."""
        lo, hi = np.searchsorted(self.sizes, (80 * self.n[i] + 99) // 100), np.searchsorted(self.sizes, 100 * self.n[i] // 80, "right")
        near = self.order[lo:hi]
        near = near[self.label[near] != self.label[i]]
        return near[near > i] if self.diagonal else near


def _block_near(table: pa.Table) -> pa.Table:
    """(grp, id) of the sets that sizes and cell counts allow a link with another label."""
    block = _Block(table, table.column("n").combine_chunks().to_numpy())
    cells = table.column("cells").combine_chunks().to_pylist()
    width, found = np.array([len(c) for c in cells]), np.zeros(len(cells), bool)
    for w in np.unique(width).tolist():  # similar sizes have the same width or the next one
        mine = np.flatnonzero((width == w) | (width == 2 * w))
        place = np.zeros(len(cells), np.int64)
        place[mine] = np.arange(len(mine))
        counts = np.stack([np.minimum(_folded(cells[i], w), 255) for i in mine.tolist()]).astype(np.int16)
        sure = counts < 255  # a full cell may hold more than it says: it is left out
        for i in block.left[(width[block.left] == w) | (width[block.left] == 2 * w)].tolist():
            near = block.near(i)
            near = near[np.minimum(width[near], width[i]) == w]
            x, at = counts[place[i]], place[near]
            near = near[9 * (np.abs(counts[at] - x) * (sure[at] & sure[place[i]])).sum(1) <= block.n[near] + block.n[i]]
            if len(near):
                found[near] = found[i] = True
    return pa.table({"grp": table.column("grp").filter(pa.array(found)), "id": table.column("id").filter(pa.array(found))})


def _block_links(table: pa.Table) -> pa.Table:
    """Links (a, b) between sets of a block that carry different labels.

    Two labels that a link of the block joins are one from then on, so there are fewer
    links than labels.
    """
    sets = [np.frombuffer(h, _U) for h in table.column("hashes").combine_chunks().to_pylist()]
    n = np.array([len(x) for x in sets])
    block = _Block(table, n)
    ids, label, start = block.ids, block.label, np.cumsum(n) - n
    element = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own, out = np.zeros(int(element.max()) + 1, bool), []
    for i in block.left.tolist():
        near = block.near(i)
        if not len(near):
            continue
        own[element[start[i] : start[i] + n[i]]] = True
        ends = np.cumsum(n[near])
        shared = np.add.reduceat(own[element[np.repeat(start[near] - ends + n[near], n[near]) + np.arange(ends[-1])]], ends - n[near], dtype=np.int64)
        own[element[start[i] : start[i] + n[i]]] = False
        linked = near[100 * shared >= 80 * (n[near] + n[i] - shared)]
        for j in linked[np.unique(label[linked], return_index=True)[1]].tolist():
            out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
            label[label == label[j]] = label[i]
    two = np.array(out, np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(two[:, 0], pa.int64()), "b": pa.array(two[:, 1], pa.int64())})


def _dealt(rows: DataFrame, held: DataFrame, block: int, elements: int) -> DataFrame:
    """``rows`` (grp, id, label) by the blocks (grp, x, y) they meet in, with the columns of ``held`` (id, size and others).

    A block holds some ``block`` rows, or ``elements`` of their sizes, on each side.
    """
    rows = rows.join(held, "id")
    sizes = rows.groupBy("grp").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("size") / elements)).cast("int").alias("nb"))
    rows = rows.join(sizes, "grp").withColumn("i", F.expr("cast(pmod(xxhash64(id), nb) as int)")).withColumn("j", F.explode(F.expr("sequence(0, nb - 1)")))
    place = {"x": F.least("i", "j"), "y": F.greatest("i", "j"), "side": F.expr("if(i <= j, 0, 1)"), "diagonal": F.expr("i = j")}
    return rows.withColumns(place).drop("i", "j", "nb", "size").groupBy("grp", "x", "y")


def _rest(docs: DataFrame, groups: DataFrame, links: DataFrame, named: DataFrame | None, sets, block: int) -> DataFrame:
    """``links`` and those between members of large groups (grp, id) that they leave apart.

    ``named`` has key, n and cells of each id.  Without it ids are keys, and the sets are
    short: their cells would not be shorter.
    """
    spark = docs.sparkSession
    rows = groups.join(components(links), "id", "left").select("grp", "id", F.coalesce("component", "id").alias("label"))
    open_ = rows.groupBy("grp").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi")
    rows = cut(rows.join(open_.select("grp"), "grp"))
    if not rows.isEmpty() and named is not None:
        near = _dealt(rows, named.select("id", "n", "cells", F.octet_length("cells").alias("size")), block, 8 * ELEMENTS).applyInArrow(_block_near, "grp long, id long")
        rows = cut(rows.join(near.distinct(), ["grp", "id"]))
    if rows.isEmpty():
        return links
    keys = rows.select("id").distinct()
    keys = cut(keys.withColumn("key", F.col("id")) if named is None else keys.join(named.select("key", "id"), "id"))
    bitmap = spark.sparkContext.broadcast(_bitmap(keys))
    held = _held(docs, sets, bitmap).join(keys, "key").groupBy("id").agg(F.first("hashes").alias("hashes"))
    held = cut(held.withColumn("size", F.octet_length("hashes") / 8))
    bitmap.destroy()
    return links.unionByName(cut(_dealt(rows, held, block, ELEMENTS).applyInArrow(_block_links, "a long, b long")))


def join(docs: DataFrame, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id of every row of ``docs``.

    ``class_id`` is the smallest doc_id with the same set, ``component_id`` the
    smallest that links reach.  See the module for the method and the cases.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    table = cut(sets_of(docs))
    classes = cut(table.where("n_shingles > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("class_id"), F.first("n_shingles").alias("n"), F.first("cells").alias("cells")))
    table, named = table.drop("cells"), classes.select(F.col("k1").alias("key"), F.col("class_id").alias("id"), "n", "cells")
    met = cut(_signed(docs, 3 * groups_for(docs, partitions(spark))).groupBy("bucket").applyInArrow(lambda t: _meet(t, small), "a long, b long, large boolean"))
    pairs, stars = met.select("a", "b").distinct(), met.where("large").select("a", "b").distinct()
    # members of large groups, by the key of their smallest member
    groups = stars.select(F.col("a").alias("grp"), F.col("b").alias("key")).unionByName(stars.select(F.col("a").alias("grp"), F.col("a").alias("key")).distinct())
    groups = cut(groups.join(named.select("key", "id"), "key").select("grp", "id"))
    pairs = pairs.join(named.toDF("a", "ia", "na", "ca"), "a").join(named.toDF("b", "ib", "nb", "cb"), "b")
    pairs = pairs.drop("a", "b").where("ia <> ib").withColumns({"a": F.least("ia", "ib"), "b": F.greatest("ia", "ib")})
    texts = docs.select("text")
    links = _verified(texts, cut(_possible(pairs).distinct()), named, _sets_of_keys)
    links = _rest(texts, groups, links, named, _sets_of_keys, block)
    names = components(links).select(F.col("id").alias("class_id"), "component")
    rows = table.join(classes.select("k1", "k2", "class_id"), ["k1", "k2"], "left").join(names, "class_id", "left")
    return rows.select("doc_id", "n_shingles", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component", "class_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` without those that links connect to a smaller doc_id.

    Rows of one doc_id are one document; null doc_ids stay.
    """
    gone = join(docs).where("component_id < doc_id").select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(documents(spark, sf_dir))


#: The same rows by comparing all documents that share a shingle, for small tables.
SQL = r"""WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\v\f\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
k AS (SELECT x, y, c = a.n AND c = b.n AS same FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM k UNION ALL SELECT y, x FROM k),
r AS (SELECT x AS id, y AS r FROM e UNION SELECT r.id, e.y FROM r JOIN e ON r.r = e.x),
c AS (SELECT id, min(r) AS least FROM r GROUP BY id),
q AS (SELECT y AS id, min(x) AS least FROM k WHERE same GROUP BY y)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(q.least, d.doc_id) AS class_id, coalesce(c.least, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = d.doc_id LEFT JOIN q ON q.id = d.doc_id"""
