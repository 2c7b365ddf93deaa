import os
import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from corrmatch.llm import order, tokens
from corrmatch.llm.common import shared_folder


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_permutation_and_its_inverse(n):
    x = np.arange(n)
    slots = order.permute(x, n)
    assert sorted(slots.tolist()) == x.tolist()
    assert (order.permute(slots, n, inverse=True) == x).all()
    if n > 1000:
        assert (order.permute(x, n, key=7) != slots).any()
        assert abs(np.corrcoef(x, slots)[0, 1]) < 0.1 and (slots == x).mean() < 0.01


def test_shards(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(["the", "of", "thanedble", "zwölf"], k=rng.choice([0, 3, 40, 400]))), 0) for i in range(150)] + [(151, None, 0), (None, "no id", 0), (3, "again", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, slot int").repartition(3)
    folder = f"file://{tmp_path}/out"
    got = sorted(order.materialise(docs, folder, length=16, rows=64).collect(), key=lambda r: r.slot)
    assert [r.slot for r in got] == list(range(len(got))) == sorted(r.number for r in got)
    assert all((r.shard, r.byte_offset) == (r.slot // 64, r.slot % 64 * 48) for r in got)
    back = order.read(folder, 0, 10**6, length=16, rows=64)
    model, expected = tokens.Encoder(tokens.default_path()).model, []
    for doc_id, text, _ in rows:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 0]
        expected += [(-(1 << 63) if doc_id is None else doc_id, i, tuple(ids[16 * i : 16 * i + 16])) for i in range(-(-len(ids) // 16))]
    assert sorted((int(r["doc_id"]), int(r["piece"]), tuple(r["ids"][: r["length"]].tolist())) for r in back) == sorted(expected)
    resumed = order.read(folder, 70, 100, length=16, rows=64)
    assert (resumed == back[70:170]).all()


def test_slots_do_not_depend_on_the_split(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.choice([None, 5, *range(40)]), " ".join(rng.choices(["the", "of", "and"], k=rng.choice([0, 9, 90])))) for _ in range(200)]
    docs, got = spark.createDataFrame(rows, "doc_id long, text string"), []
    for k in (1, 5):
        order.materialise(docs.repartition(k), f"file://{tmp_path}/{k}", length=16, rows=64).collect()
        got.append(order.read(f"file://{tmp_path}/{k}", 0, 10**6, length=16, rows=64))
    assert len(got[0]) > 400 and (got[0] == got[1]).all()


def test_tokens_are_packed_tightly(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").coalesce(1)
    order.materialise(docs, f"file://{tmp_path}/out").count()
    files = list((tmp_path / "out" / "tokens").glob("*.parquet"))
    ids = pq.read_table(files[0]).select(["ids"])
    pq.write_table(ids, tmp_path / "usual", compression="zstd", compression_level=3, use_dictionary=False)
    assert len(files) == 1 and os.path.getsize(files[0]) < 0.95 * os.path.getsize(tmp_path / "usual")


def test_query_and_empty_table(spark, tmp_path):
    got = order.op4_training_order(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert order.op4_training_order(spark, str(tmp_path)).count() == 0
    assert shared_folder(spark)
