"""Training-order materialisation: a keyed permutation and fixed-stride shards.

Texts become token ids (with the end id) and are cut into sequences of ``LENGTH`` ids.
Sequences are numbered 0..n-1 in the order of doc_id (null first), a hash of the text, and
their place in it, so the numbers depend on the rows and not on how the table is split.  A
Feistel network over the least even number of bits that holds n, walked along its cycle
until the value is below n, permutes these numbers: a sequence's global slot.  Shard s holds
the slots from s * SHARD on, one record of fixed size each, so that the record of any
slot is found by arithmetic, and a reader resumes from a slot number alone.

A record is: doc_id (int64; the least number for null), piece (int32), length (int32),
then ``LENGTH`` little-endian ids of 16 bits (32 for larger vocabularies), with zeros
beyond the length.

Scale.  Tokens are written once, to the shared folder.  Only doc_ids, hashes and counts
are sorted, by ranges with running sums (one number a range goes through the driver, and
there are as many ranges as shuffle partitions); the numbers then go to the files of tokens
they belong to, one task a file.  One shuffle of tokens follows, by ranges of shards, which
are ranges of slots: the records of a batch travel as one compressed block for each shard,
and a task writes its shards one after the other and holds one at a time.  Shards are
written whole under a temporary name and renamed, so a task that is repeated after a lost
executor writes the same file again.  The folder is opened by ``pyarrow.fs``: a file, HDFS
or object-store address.

Defined cases: a null or empty text is one sequence that holds the end id; copies and
rows with a repeated or null doc_id have sequences of their own; an empty table gives
no rows and no shards; extra columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import column, cut, documents, groups_for, partitions, release, shared_folder, texts_of

LENGTH = 256
SHARD = 8_192
ROUNDS = 6
#: Documents whose records are made at a time.
SLICE = 2_500
#: Tokens, blocks and shards are on disk together, so the first two are packed tightly: ids repeat over long ways.
LEVEL = 6
TOKEN_FILES = {"compression": "zstd", "parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(8 << 20)}
KEY = 0x5EED
_U = np.uint64
_NULL = -(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def permute(x: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """Slots of the numbers ``x`` (all below ``n``), or numbers of slots."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask, shift = _U((1 << half) - 1), _U(half)
    turns = [_U(int(k)) for k in _mix(np.arange(1, ROUNDS + 1, dtype=_U) + _U(key % (1 << 64) ^ 0x9E3779B97F4A7C15))]
    out = x.astype(_U)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for k in reversed(turns) if inverse else turns:
            if inverse:
                left, right = right ^ (_mix(left + k) & mask), left
            else:
                left, right = right, left ^ (_mix(right + k) & mask)
        out[todo] = left << shift | right
        todo = todo[out[todo] >= _U(n)]
    return out.astype(np.int64)


def _tokenised(docs: DataFrame, path: str, kind: str) -> DataFrame:
    """part, at (place in it), doc_id, hash, n_ids, ids of each document."""

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        names = ["part", "at", "doc_id", "hash", "n_ids", "ids"]
        for batch in (whole.slice(i, 512) for whole in batches for i in range(0, whole.num_rows, 512)):
            ids = [np.append(x, np.uint32(tokens.END)).astype(kind) for x in tokens.encoder(path).ids(texts_of(batch))]
            numbers = pa.array(np.arange(at, at + len(ids)))
            at += len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part] * len(ids), pa.int32()), numbers, column(batch, "doc_id"), column(batch, "hash"), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], names
            )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("hash")).mapInArrow(run, "part int, at long, doc_id long, hash long, n_ids long, ids binary")


def _numbered(kept: DataFrame, length: int) -> tuple[DataFrame, int, int]:
    """part, file, at, number (of the document's first sequence); sequences; parts."""
    spark = kept.sparkSession
    keys = ["doc_id", "hash", "part", "at"]  # the last two split rows that are alike in all else
    rows = kept.select("doc_id", "hash", "part", "at", F.expr(f"(n_ids + {length - 1}) div {length}").alias("n"), F.col("_metadata.file_path").alias("file"))
    rows = rows.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)

    def run(batches):
        reach, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = total + np.cumsum(column(batch, "n").to_numpy())
            start = ends - column(batch, "n").to_numpy()
            total = int(ends[-1]) if len(ends) else total
            cols = [column(batch, "part"), column(batch, "file"), column(batch, "at"), column(batch, "n"), pa.array(start), pa.array(np.full(len(start), reach, np.int32))]
            yield pa.RecordBatch.from_arrays(cols, ["part", "file", "at", "n", "start", "reach"])

    rows = cut(rows.mapInArrow(run, "part int, file string, at long, n long, start long, reach int"))
    counts = sorted(tuple(r) for r in rows.groupBy("reach").agg(F.sum("n")).collect())
    parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
    n = sum(c for _, c in counts)
    offsets = dict(zip([r for r, _ in counts], np.cumsum([0, *(c for _, c in counts)]).tolist()))
    base = F.try_element_at(F.create_map(*[F.lit(x).cast("long") for pair in offsets.items() for x in pair]), F.col("reach").cast("long")) if offsets else F.lit(0).cast("long")
    return rows.select("part", F.element_at(F.split("file", "/"), -1).alias("file"), "at", (F.col("start") + base).alias("number")), n, parts


PLACED = "doc_id long, piece int, start long, length int, ids_crc32 long, number long, slot long, shard long, byte_offset long, record_crc32 long"


def record(length: int, kind: str) -> np.dtype:
    return np.dtype([("doc_id", "<i8"), ("piece", "<i4"), ("length", "<i4"), ("ids", kind, (length,))])


def shard_name(shard: int) -> str:
    return f"shard-{shard:09d}.bin"


def _writer(folder: str, n: int, length: int, rows: int, kind: str, key: int):
    form = record(length, kind)

    def put(shard: int, out: np.ndarray) -> pa.RecordBatch:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        name, part = f"{base}/{shard_name(shard)}", f"{base}/.{shard_name(shard)}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as f:
            f.write(out.tobytes())
        store.move(part, name)
        with store.open_input_stream(name) as f:  # the rest describes what is stored
            raw = memoryview(f.read())
        back = np.frombuffer(raw, form)
        slot, size, wide = np.arange(len(back)) + shard * rows, form.itemsize, memoryview(back["ids"].astype("<u4").tobytes())
        cols = {
            "doc_id": pa.array(back["doc_id"], mask=back["doc_id"] == _NULL), "piece": pa.array(back["piece"]), "start": pa.array(back["piece"].astype(np.int64) * length), "length": pa.array(back["length"]),
            "ids_crc32": pa.array([zlib.crc32(wide[i : i + 4 * k]) for i, k in zip(range(0, len(wide), 4 * length), back["length"].tolist())], pa.int64()), "number": pa.array(permute(slot, n, key, inverse=True)),
            "slot": pa.array(slot), "shard": pa.array(np.full(len(back), shard)), "byte_offset": pa.array(np.arange(len(back)) * form.itemsize),
            "record_crc32": pa.array([zlib.crc32(raw[i : i + size]) for i in range(0, len(raw), size)], pa.int64()),
        }
        return pa.RecordBatch.from_pydict(cols)

    def write(batches):
        unpack, shard, out = zstandard.ZstdDecompressor().decompress, None, None
        for batch in batches:  # sorted by shard
            for now, slots, records in zip(*(column(batch, c).to_pylist() for c in ("shard", "slots", "records"))):
                if now != shard:
                    if shard is not None:
                        yield put(shard, out)
                    shard, out = now, np.zeros(min(rows, n - now * rows), form)
                out[np.frombuffer(slots, np.int64) - shard * rows] = np.frombuffer(unpack(records), form)
        if shard is not None:
            yield put(shard, out)

    return write


def materialise(docs: DataFrame, folder: str, path: str | None = None, length: int = LENGTH, rows: int = SHARD, key: int = KEY) -> DataFrame:
    """Write the shards to ``folder`` when the result is computed; a row for each sequence."""
    spark = docs.sparkSession
    path = path or tokens.default_path()
    kind = "<u2" if tokens.encoder(path).model.get_vocab_size() <= 1 << 16 else "<u4"
    kept = f"{folder}/tokens"
    _tokenised(docs, path, kind).write.options(**TOKEN_FILES).parquet(kept)
    numbered, n, parts = _numbered(spark.read.parquet(kept), length)
    if not n:
        return spark.createDataFrame([], PLACED)
    form = record(length, kind)

    def placed(doc_ids: np.ndarray, ids: list[bytes], number: np.ndarray) -> dict:
        count = np.array([-(-len(x) // (length * np.dtype(kind).itemsize)) for x in ids])
        owner = np.repeat(np.arange(len(count)), count)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        slot = permute(number[owner] + piece, n, key)
        # each document's ids, then zeros up to a whole number of sequences
        flat, ends = bytearray(len(slot) * length * np.dtype(kind).itemsize), np.cumsum(count)
        for x, at in zip(ids, ((ends - count) * length * np.dtype(kind).itemsize).tolist()):
            flat[at : at + len(x)] = x
        order = np.argsort(slot, kind="stable")
        slot, out = slot[order], np.zeros(len(slot), form)
        out["doc_id"], out["piece"] = doc_ids[owner[order]], piece[order]
        out["ids"] = np.frombuffer(flat, kind).reshape(-1, length)[order]
        lengths = np.full(len(slot), length)
        lengths[ends - 1] = np.array([len(x) for x in ids]) // np.dtype(kind).itemsize - (count - 1) * length
        out["length"] = lengths[order]
        cuts = np.flatnonzero(np.concatenate(([True], slot[1:] // rows != slot[:-1] // rows, [True])))
        pack = zstandard.ZstdCompressor(LEVEL).compress
        return {
            "shard": slot[cuts[:-1]] // rows, "slots": [slot[a:b].tobytes() for a, b in zip(cuts, cuts[1:])],
            "records": [pack(out[a:b].tobytes()) for a, b in zip(cuts, cuts[1:])],
        }

    def blocks(batches):
        """The records of one file of tokens, by shard."""
        batches = list(batches)
        if not sum(b.num_rows for b in batches):
            return
        held = pa.Table.from_batches(batches)
        number = held.column("number").to_numpy()[np.argsort(held.column("at").to_numpy())]
        store, base = fs.FileSystem.from_uri(kept)
        with store.open_input_file(f"{base}/{held.column('file')[0].as_py()}") as f:
            at = 0
            for batch in pq.ParquetFile(f).iter_batches(SLICE, columns=["doc_id", "ids"]):
                got = placed(column(batch, "doc_id").fill_null(_NULL).to_numpy(), column(batch, "ids").to_pylist(), number[at : at + batch.num_rows])
                at += batch.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(got["shard"], pa.int64()), pa.array(got["slots"], pa.binary()), pa.array(got["records"], pa.binary())], ["shard", "slots", "records"])
                release()

    found = numbered.repartitionById(parts, F.col("part")).mapInArrow(blocks, "shard long, slots binary, records binary")
    shards = -(-n // rows)
    ranges = min(shards, groups_for(docs, partitions(spark)))
    found = found.repartitionById(ranges, F.expr(f"cast(shard * {ranges} div {shards} as int)")).sortWithinPartitions("shard")
    return found.mapInArrow(_writer(folder, n, length, rows, kind, key), PLACED)


def read(folder: str, slot: int, count: int, length: int = LENGTH, rows: int = SHARD, kind: str = "<u2") -> np.ndarray:
    """The records of ``count`` slots from ``slot`` on, as a resumed reader takes them."""
    store, base = fs.FileSystem.from_uri(folder)
    form, out = record(length, kind), []
    while count > 0:
        shard, at = divmod(slot, rows)
        if store.get_file_info(f"{base}/{shard_name(shard)}").type == fs.FileType.NotFound:
            break
        with store.open_input_file(f"{base}/{shard_name(shard)}") as f:
            f.seek(at * form.itemsize)
            got = np.frombuffer(f.read(min(count, rows - at) * form.itemsize), form)
        if not len(got):
            break
        out.append(got)
        slot, count = slot + len(got), count - len(got)
    return np.concatenate(out) if out else np.zeros(0, form)


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(documents(spark, sf_dir), f"{shared_folder(spark)}/training-order-{uuid.uuid4().hex}")
