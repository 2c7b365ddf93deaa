"""Language-model scores from a log-frequency Bloom filter of bigram counts.

Each bigram of the training texts, with its count c quantised to
q = 1 + floor(log2 c), is put into a Bloom filter once for each level 1..q.  A
reader finds its level by probing 1, 2, ... until a probe fails, so counts are never
too low, and seldom too high.  Scoring smooths the quantised counts with the add-one
unigram model: P(w | h) = (c~(h w) + mu P(w)) / (c(h) + mu), where c~ = 2^(q - 1) is the
least count of the level, so the probabilities of a history sum to 1 at most (but for
the filter's errors).  The history of the first word is the end of a text.

Scale.  Counts of all training texts meet in buckets as packed arrays of 64-bit
hashes; a bucket yields its share of the vocabulary and a filter of its own, of
``BITS`` bits an entry.  Filters of ``PART`` bytes at most in all are broadcast.  Larger
ones stay where they are, and the texts of a slot ask the buckets for the levels of their
own distinct bigrams, as they ask for the counts of their distinct words: the vocabulary
is never broadcast.  Both ways probe the same filters and give the same scores, and each
reads the texts as often.  Texts travel to their slots as compressed blocks; buckets and
slots grow with the input's bytes.

Defined cases: a null or empty text is one token, the end; without training texts
all counts are 0; a null doc_id counts as the text ''; repeated rows are scored each;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, cut, documents, groups_for, partitions, per_batch, texts_of
from .shingles import hashed, mix

BITS = 7
PROBES = 4
PART = 96 << 20
MU = 500.0
SLICE = 8_000
LEVELS = 40
END = np.uint64(0xE2D0E2D0E2D0E2D1)
_U = np.uint64
_H = np.uint64(0x9E3779B97F4A7C15)


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The token hashes of all texts, each with its end, and the texts' lengths."""
    h, text, _ = hashed(texts)
    out = np.full(len(h) + len(texts), END, _U)
    out[np.arange(len(h)) + text] = h
    return out, np.bincount(text, minlength=len(texts)) + 1


def _bigrams(tokens: np.ndarray) -> np.ndarray:
    """A 48-bit hash of each token after the one before it; texts follow an end."""
    before = np.concatenate(([END], tokens[:-1])).astype(_U)
    return mix(before * _H + tokens) >> _U(16)


def _sent(h: np.ndarray, bigram: bool) -> bytes:
    """Hashes as they travel: those of bigrams in six bytes."""
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes() if bigram else h.tobytes()


def _received(data: bytes, bigram: bool) -> np.ndarray:
    if not bigram:
        return np.frombuffer(data, _U)
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _dealt(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of ``h`` by bucket, and where each bucket begins."""
    bucket = (h % _U(buckets)).astype(np.int64)
    return np.argsort(bucket, kind="stable"), np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=buckets))))


def _counted(docs: DataFrame, buckets: int) -> DataFrame:
    def rows(batch):
        texts = texts_of(batch)
        for at in range(0, len(texts), SLICE):
            tokens, _ = _tokens(texts[at : at + SLICE])
            out = {"bucket": [], "bigram": [], "hashes": [], "counts": []}
            for bigram, h in ((False, tokens), (True, _bigrams(tokens))):
                h, c = np.unique(h, return_counts=True)
                order, cuts = _dealt(h, buckets)
                h, c = h[order], c[order].astype(np.int64)
                for b in np.flatnonzero(np.diff(cuts)):
                    part = slice(cuts[b], cuts[b + 1])
                    for col, v in zip(out.values(), (b, bigram, _sent(h[part], bigram), c[part].tobytes())):
                        col.append(v)
            yield out

    return per_batch(docs.select("text"), rows, "bucket int, bigram boolean, hashes binary, counts binary", rows=SLICE)


def _summed(table: pa.Table, bigram: bool) -> tuple[np.ndarray, np.ndarray]:
    mine = table.filter(table.column("bigram") if bigram else pc.invert(table.column("bigram")))
    h, c = _received(b"".join(mine.column("hashes").to_pylist()), bigram), np.frombuffer(b"".join(mine.column("counts").to_pylist()), np.int64)
    order = np.argsort(h, kind="stable")
    h, c = h[order], c[order]
    start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, int)
    return h[start], np.add.reduceat(c, start) if len(h) else c


def _places(h: np.ndarray, level: int, bits: np.ndarray | int) -> list[np.ndarray]:
    x = mix(h + _U(level * int(_H) % (1 << 64)))
    step = mix(x) | _U(1)
    return [(x + _U(i) * step) % bits for i in range(PROBES)]


def _shard(table: pa.Table, bits_each: int = BITS) -> pa.Table:
    """A bucket's vocabulary, sorted by hash, and the filter of its bigrams."""
    h, c = _summed(table, False)
    b, n = _summed(table, True)
    level = np.floor(np.log2(n)).astype(np.int64) + 1
    bits = max(64, -(-int(level.sum()) * bits_each // 64) * 64)
    filter_ = np.zeros(bits, bool)
    for q in range(1, int(level.max(initial=0)) + 1):
        for at in _places(b[level >= q], q, _U(bits)):
            filter_[at] = True
    return pa.table({
        "bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()),
        "hashes": pa.array([h.tobytes()], pa.binary()), "counts": pa.array([c.tobytes()], pa.binary()),
        "filter": pa.array([np.packbits(filter_, bitorder="little").tobytes()], pa.binary()),
        "bits": pa.array([bits], pa.int64()), "tokens": pa.array([int(c.sum())], pa.int64()), "types": pa.array([len(h)], pa.int64()),
    })


class Filter:
    """The filters of some buckets, one after the other."""

    def __init__(self, buckets: int, parts: list[tuple[int, bytes]]):
        self.bits, self.start = np.zeros(buckets, _U), np.zeros(buckets, _U)
        self.data = np.frombuffer(b"".join(x for _, x in parts), np.uint8)
        at = 0
        for b, x in parts:
            self.bits[b], self.start[b] = 8 * len(x), at
            at += 8 * len(x)

    def levels(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the bigrams belong to these buckets, and those bigrams' levels."""
        bucket = (h % _U(len(self.bits))).astype(np.int64)
        mine = np.flatnonzero(self.bits[bucket] > 0)
        found = np.zeros(len(mine), np.int64)
        left, h, bucket = np.arange(len(mine)), h[mine], bucket[mine]
        for level in range(1, LEVELS):
            if not len(left):
                break
            start, bits = self.start[bucket], self.bits[bucket]
            ok = np.ones(len(left), bool)
            for at in _places(h, level, bits):
                at += start
                ok &= (self.data[(at >> _U(3)).astype(np.int64)] >> (at & _U(7)).astype(np.uint8) & 1).astype(bool)
            left, h, bucket = left[ok], h[ok], bucket[ok]
            found[left] = level
        return mine, found


def _blocks(docs: DataFrame) -> DataFrame:
    """slot, block: the texts of a batch that belong to a slot, compressed."""

    def rows(batch):
        batch = batch.take(pc.sort_indices(batch.column(batch.schema.get_field_index("slot"))))
        slot = column(batch, "slot").to_numpy()
        cuts = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1], [True]))) if len(slot) else np.zeros(1, int)
        texts, out = batch.select(["doc_id", "held_out", "text"]), []
        for a, b in zip(cuts, cuts[1:]):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, texts.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_batch(texts.slice(a, b - a))
            out.append(sink.getvalue().to_pybytes())
        return {"slot": slot[cuts[:-1]], "block": out}

    return per_batch(docs.select("slot", "doc_id", "held_out", "text"), rows, "slot long, block binary", rows=SLICE)


def _opened(blocks: pa.Table) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(b).read_all() for b in blocks.column("block").to_pylist()])


def _asked(blocks: DataFrame, buckets: int, bigrams: bool) -> DataFrame:
    """The distinct words of each slot, and its bigrams, by the bucket that knows them."""

    def ask(table: pa.Table) -> pa.Table:
        words, pairs = [np.array([END])], [np.zeros(0, _U)]
        for b in table.column("block").to_pylist():
            texts = [t or "" for t in pa.ipc.open_stream(b).read_all().column("text").to_pylist()]
            if bigrams:
                tokens, _ = _tokens(texts)
                pairs.append(np.unique(_bigrams(tokens)))
            else:
                tokens = hashed(texts)[0]
            words.append(np.unique(tokens))
        out = {"bucket": [], "bigram": [], "hashes": []}
        for bigram, parts in ((False, words), (True, pairs)):
            h = np.unique(np.concatenate(parts))
            order, cuts = _dealt(h, buckets)
            h = h[order]
            for b in np.flatnonzero(np.diff(cuts)):
                for col, v in zip(out.values(), (b, bigram, _sent(h[cuts[b] : cuts[b + 1]], bigram))):
                    col.append(v)
        kinds = {"bucket": pa.int32(), "bigram": pa.bool_(), "hashes": pa.binary()}
        slot = pa.array([table.column("slot")[0].as_py()] * len(out["bucket"]), pa.int64())
        return pa.table({"slot": slot} | {k: pa.array(v, kinds[k]) for k, v in out.items()})

    return blocks.groupBy("slot").applyInArrow(ask, "slot long, bucket int, bigram boolean, hashes binary")


def _answer(buckets: int):
    """What a bucket knows of the hashes it is asked for: counts of words, levels of bigrams."""

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        h, c = (np.frombuffer(known.column(n)[0].as_py() if len(known) else b"", t) for n, t in (("hashes", _U), ("counts", np.int64)))
        filter_ = Filter(buckets, list(zip(known.column("bucket").to_pylist(), known.column("filter").to_pylist())))
        out = []
        for bigram, x in zip(asked.column("bigram").to_pylist(), asked.column("hashes").to_pylist()):
            x = _received(x, bigram)
            if bigram:
                levels = np.zeros(len(x), np.uint8)
                mine, found = filter_.levels(x)
                levels[mine] = found
                out.append(levels.tobytes())
                continue
            at = np.minimum(np.searchsorted(h, x), max(0, len(h) - 1))
            out.append((np.where(h[at] == x, c[at], 0) if len(h) else np.zeros(len(x), np.int64)).tobytes())
        return pa.table({"slot": asked.column("slot"), "bigram": asked.column("bigram"), "hashes": asked.column("hashes"), "found": pa.array(out, pa.binary())})

    return answer


ANSWERED = "slot long, bigram boolean, hashes binary, found binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double"


def _table(answers: pa.Table, bigram: bool) -> tuple[np.ndarray, np.ndarray]:
    """The answers on words or on bigrams, by hash."""
    mine = answers.filter(answers.column("bigram") if bigram else pc.invert(answers.column("bigram")))
    h = _received(b"".join(mine.column("hashes").to_pylist()), bigram)
    found = np.frombuffer(b"".join(mine.column("found").to_pylist()), np.uint8 if bigram else np.int64)
    order = np.argsort(h)
    return h[order], found[order]


def _scorer(shared, n: int, v: int, mu: float):
    """Score the texts of a slot, by a broadcast filter or by the levels it has asked for."""

    def score(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        texts = _opened(blocks)
        h, c = _table(answers, False)
        pairs, levels = _table(answers, True)
        out = {x.split()[0]: [] for x in SCORED.split(", ")}
        ids, held, all_texts = (texts.column(x).to_pylist() for x in ("doc_id", "held_out", "text"))
        for at in range(0, len(ids), SLICE // 8):
            tokens, sizes = _tokens([t or "" for t in all_texts[at : at + SLICE // 8]])
            count = c[np.searchsorted(h, tokens)]
            owner = np.repeat(np.arange(len(sizes)), sizes)
            p = (count + 1.0) / (n + v + 1.0)
            level = np.zeros(len(tokens))
            if shared is None:
                level[:] = levels[np.searchsorted(pairs, _bigrams(tokens))]
            else:
                mine, found = shared.value.levels(_bigrams(tokens))
                level[mine] = found
            before = np.concatenate((count[-1:], count[:-1]))  # texts follow an end
            seen = np.minimum(np.where(level > 0, np.exp2(level - 1.0), 0.0), before)
            smooth = np.log10((seen + mu * p) / (before + mu))
            of = lambda x: np.bincount(owner, x, len(sizes))
            out["doc_id"] += ids[at : at + SLICE // 8]
            out["held_out"] += held[at : at + SLICE // 8]
            out["n_tokens"] += sizes.tolist()
            out["n_known"] += of(count > 0).astype(np.int64).tolist()
            out["base"] += of(np.log10(p)).tolist()
            out["model"] += of(smooth).tolist()
        kinds = {"doc_id": pa.int64(), "held_out": pa.bool_(), "n_tokens": pa.int64(), "n_known": pa.int64()}
        return pa.table({k: pa.array(x, kinds.get(k, pa.float64())) for k, x in out.items()})

    return score


def score(docs: DataFrame, folds: int = 7, held: int = 2, mu: float = MU, bits: int = BITS, part_bytes: int = PART) -> DataFrame:
    """Learn from the rows whose fold is not ``held`` and score all rows."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    buckets = groups_for(docs, partitions(spark))
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(folds))
    docs = docs.select("doc_id", "text", (fold == held).alias("held_out"), F.expr(f"pmod(xxhash64(doc_id, text), {2 * buckets})").alias("slot"))
    shards = cut(_counted(docs.where("not held_out"), buckets).groupBy("bucket").applyInArrow(lambda t: _shard(t, bits), "bucket int, hashes binary, counts binary, filter binary, bits long, tokens long, types long"))
    n, v, size = (x or 0 for x in shards.agg(F.sum("tokens"), F.sum("types"), F.sum(F.octet_length("filter"))).first())
    shared = None
    if size <= part_bytes:
        found = shards.select("bucket", "filter").toArrow()
        shared = spark.sparkContext.broadcast(Filter(buckets, list(zip(found.column("bucket").to_pylist(), found.column("filter").to_pylist()))))
        del found
    # the same columns in both uses of the slots, so that Spark deals the texts once
    slotted = _blocks(docs)
    known = shards.select("bucket", "hashes", "counts", (F.lit(b"") if shared else F.col("filter")).alias("filter"))
    answers = _asked(slotted, buckets, shared is None).groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(_answer(buckets), ANSWERED)
    scored = slotted.groupBy("slot").cogroup(answers.groupBy("slot")).applyInArrow(_scorer(shared, n, v, mu), SCORED)
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.col("model").alias("score"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir))
