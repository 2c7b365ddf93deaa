"""Best-fit packing with certified bin counts.

Documents become pieces of at most ``capacity`` tokens, and pieces become
sequences.  Pieces are dealt into partitions of about ``TARGET`` pieces by a hash,
so that each partition holds a fair mix of lengths.  Each is packed by best-fit
decreasing, and dual-feasible functions give a lower bound on its bins: a partition
that meets its bound is certified.  Partitions with a gap exchange all their
pieces, certified ones those of their least filled bin: they are dealt anew with
another hash and packed again, until no piece is left to exchange or ``ROUNDS``
have passed.

Scale.  Only the ids' lengths and checksums leave the tokeniser, and a partition's
size does not depend on the table's.  A hot source, very many copies or null doc_ids are
dealt like all other rows, as the hash takes a number that each piece has of its own.

Defined cases: a null or empty text is one piece that holds the end id alone; only
texts of more than ``capacity`` ids (with the end) are cut; rows with a repeated
doc_id are packed each; null doc_ids are kept; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import column, cut, documents, per_batch, texts_of

CAPACITY = 2048
#: Pieces that a partition holds about.
TARGET = 1_000
ROUNDS = 4
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"own long, {PIECES}, sequence_id long, offset long, round int, gap int, exchange boolean"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each text: its ids, then the end id, cut at ``capacity``."""

    def rows(batch):
        doc_ids = column(batch, "doc_id").to_pylist()
        texts = texts_of(batch)
        for at in range(0, len(texts), 1024):
            out = {n.split()[0]: [] for n in PIECES.split(", ")}
            for doc_id, ids in zip(doc_ids[at:], tokens.encoder(path).ids(texts[at : at + 1024])):
                ids = np.append(ids, np.uint32(tokens.END)).astype("<u4")
                for i, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    for col, v in zip(out.values(), (doc_id, i, start, len(part), zlib.crc32(part.tobytes()))):
                        col.append(v)
            yield out

    return per_batch(docs.select("doc_id", "text"), rows, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """The most bins that dual-feasible functions prove necessary.

    The families are f_a (sizes over C - a count as C, those under a as 0) for all
    a up to C / 2, and u_k (sizes to multiples of 1 / k, where k + 1 of a size do
    not fill a bin exactly) for k up to 50.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1)
    number, total = np.cumsum(count), np.cumsum(count * size)
    a = np.arange(capacity // 2 + 1)
    large = number[-1] - number[capacity - a]
    middle = number[capacity - a] - number[capacity // 2]
    room = capacity * middle - (total[capacity - a] - total[capacity // 2])
    small = total[capacity // 2] - np.where(a > 0, total[np.maximum(a - 1, 0)], 0)
    best = int((large + middle + np.maximum(0, -(-(small - room) // capacity))).max())
    for k in range(1, 51):
        # in units of C / k: x (k + 1) / C if whole, scaled, else its floor
        whole = size * (k + 1) % capacity == 0
        units = int((count * np.where(whole, size * k, size * (k + 1) // capacity * capacity)).sum())
        best = max(best, -(-units // (k * capacity)))
    return best


def best_fit(lengths: list[int], capacity: int = CAPACITY) -> tuple[list[int], list[int], list[int]]:
    """(bin, offset) of each of the descending lengths, and the bins' free room.

    Bins are found by their free room: one bit of ``open_`` says whether any has it.
    """
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_, room, bins, offsets = 0, [], [], []
    for n in lengths:
        fit = open_ >> n
        if fit:
            free = n + (fit & -fit).bit_length() - 1
            b = stacks[free].pop()
            if not stacks[free]:
                open_ ^= 1 << free
        else:
            free, b = capacity, len(room)
            room.append(capacity)
        bins.append(b)
        offsets.append(capacity - free)
        room[b] = free = free - n
        if free:
            stacks[free].append(b)
            open_ |= 1 << free
    return bins, offsets, room


def _packer(turn: int, capacity: int):
    def pack(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        table = table.take(pc.sort_indices(table, sort_keys=[("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")]))
        lengths = table.column("length").to_numpy()
        bins, offsets, room = best_fit(lengths.tolist(), capacity)
        gap = len(room) - lower_bound(lengths, capacity)
        least = max(range(len(room)), key=room.__getitem__)
        again = np.array(bins) == least if room[least] else np.zeros(len(bins), bool)
        cols = {n: table.column(n) for n in ("own", "doc_id", "piece", "start", "length", "ids_crc32")}
        cols |= {
            "sequence_id": pa.array((turn << 56 | bucket << 24) + np.array(bins, np.int64)),
            "offset": pa.array(offsets, pa.int64()),
            "round": pa.array(np.full(len(bins), turn, np.int32)),
            "gap": pa.array(np.full(len(bins), gap, np.int32)),
            "exchange": pa.array(again | (gap > 0)),
        }
        return pa.table(cols)

    return pack


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """The pieces of ``docs`` with their sequence and their place in it.

    ``round`` is the exchange after which the piece found its place, ``gap`` the
    bins of its partition beyond the certified bound.
    """
    todo, done = cut(pieces(docs, path or tokens.default_path(), capacity).withColumn("own", F.monotonically_increasing_id())), None
    before = None
    for turn in range(rounds + 1):
        n = todo.count()
        if not n or n == before and turn > 2:
            break
        before, buckets = n, max(1, math.ceil(n / TARGET))
        dealt = todo.withColumn("bucket", F.expr(f"pmod(xxhash64(own, {turn}), {buckets})"))
        packed = cut(dealt.groupBy("bucket").applyInArrow(_packer(turn, capacity), PACKED))
        last = turn == rounds or buckets == 1
        kept = packed if last else packed.where("not exchange")
        done = kept if done is None else done.unionByName(kept)
        if last:
            return done.drop("own", "exchange")
        todo = packed.where("exchange").select("own", *[c.split()[0] for c in PIECES.split(", ")])
    if done is None:
        done = todo.selectExpr("*", "0L AS sequence_id", "0L AS offset", "0 AS round", "0 AS gap", "false AS exchange")
    elif n:
        done = done.unionByName(packed.where("exchange"))
    return done.drop("own", "exchange")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
