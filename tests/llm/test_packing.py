import collections
import itertools
import random
import zlib

import numpy as np
import pytest

from corrmatch.llm import packing, tokens


def least_bins(sizes, capacity):
    """The fewest bins, by trying every way."""
    best = [len(sizes)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(sizes):
            best[0] = len(bins)
            return
        for b in sorted(set(bins)):
            if b + sizes[i] <= capacity:
                rest = list(bins)
                rest[rest.index(b)] += sizes[i]
                place(i + 1, rest)
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(12))
def test_bound_never_exceeds_the_least(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 16, 31])
    sizes = sorted((rng.randint(1, capacity) for _ in range(9)), reverse=True)
    bins, offsets, room = packing.best_fit(sizes, capacity)
    least = least_bins(sizes, capacity)
    assert packing.lower_bound(np.array(sizes), capacity) <= least <= len(room)
    for b in range(len(room)):
        at = 0
        for n, own, off in zip(sizes, bins, offsets):
            if own == b:
                assert off == at
                at += n
        assert room[b] == capacity - at


def test_bound_is_tight_where_halves_do_not_fit():
    assert packing.lower_bound(np.array([1025] * 7)) == 7
    assert packing.lower_bound(np.array([683] * 9)) == 5
    assert packing.lower_bound(np.array([700] * 7)) == 4


ODD = ["", "  ", "Don't can't I'LL we've 's'm x's", "a\x85b\xa0c", "ÀÉ²¼ª º µ ß", "<|endoftext|> hi", "日本 ÀÉ x́", "1234 5a6 a5,6!!..'s", "\x00\x1cA B", "İI Σ ΑΣ", " x­b", "foo\xa0bar's l'eau d'or '  'd", "'''s", "a<|b"]


def test_ids_are_the_library_s():
    e = tokens.Encoder(tokens.default_path())
    rng = random.Random(1)
    chars = [chr(c) for c in range(9, 256)] + list("'''     sstdmlvre")
    texts = ODD + ["".join(rng.choices(chars, k=200)) for _ in range(300)]
    assert [x.tolist() for x in e.ids(texts)] == [x.ids for x in e.model.encode_batch(texts, add_special_tokens=False)]


def test_query(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "TARGET", 40)
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["the", "of", "and", "thanedble", "zwölf", "x1"], k=rng.choice([1, 5, 50, 300, 900, 3000]))), "z") for i in range(300)]
    rows += [(301, None, "z"), (302, "", "z"), (5, rows[5][1], "again"), (None, "no id", "z")]
    spark.createDataFrame(rows, "doc_id long, text string, round string").write.parquet(f"{tmp_path}/documents.parquet")
    got = packing.op2_best_fit_packing(spark, str(tmp_path)).collect()
    model = tokens.Encoder(tokens.default_path()).model
    expected = []
    for doc_id, text, _ in rows:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 0]
        for i, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            expected.append((doc_id, i, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    none = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(none((r.doc_id, r.piece, r.start, r.length, r.ids_crc32)) for r in got) == sorted(map(none, expected))
    bins = sorted((r.sequence_id, r.offset, r.length) for r in got)
    for _, own in itertools.groupby(bins, lambda x: x[0]):
        at = 0
        for _, offset, length in own:
            assert offset == at
            at += length
        assert at <= 2048
    bound = packing.lower_bound(np.array([r.length for r in got]))
    assert len({b[0] for b in bins}) <= bound + 1


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = packing.op2_best_fit_packing(spark, str(tmp_path))
    assert got.count() == 0 and "sequence_id" in got.columns


def test_null_ids_are_dealt_like_others(spark, monkeypatch):
    monkeypatch.setattr(packing, "TARGET", 100)
    docs = spark.createDataFrame([(None, "the same words")] * 1500, "doc_id long, text string")
    rows = packing.pack(docs, capacity=64).where("round = 0").collect()
    buckets = collections.Counter(r.sequence_id >> 24 for r in rows)
    assert len(buckets) >= 10 and max(buckets.values()) < 300
