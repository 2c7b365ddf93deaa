import collections
import hashlib
import random

import pytest
import xxhash

from corrmatch.llm import fingerprints
from corrmatch.llm.common import documents

NONE = -(1 << 63)


def bag(text):
    return collections.Counter(text.lower().split()) or collections.Counter([""])


def likeness(a, b):
    a, b = bag(a), bag(b)
    return sum((a & b).values()) / sum((a | b).values())


def check(spark, rows, path, **sizes):
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, next string").repartition(3).write.parquet(f"{path}/documents.parquet")
    got = fingerprints.fingerprint(documents(spark, str(path)), **sizes) if sizes else fingerprints.op8_weighted_sampling(spark, str(path))
    assert not any(k in got._jdf.queryExecution().toString() for k in ("Python", "Pandas", "ArrowEval"))
    got = got.collect()
    order = sorted(((NONE if i is None else i, xxhash.xxh64((t or "").encode(), 42).intdigest() & (1 << 63) - 1, t or "") for i, t in rows), reverse=True)
    order = [(i, t) for i, _, t in order]
    texts = {}
    expected = []
    for (i, t), (_, follow) in zip(order, order[1:] + order[:1]):
        k = len(t) // 3
        edited = t[: len(t) - k] + follow[:k]
        expected.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest()))
        texts[i, expected[-1][2]] = (t, edited, follow)
    assert sorted((NONE if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256) for r in got) == sorted(expected)
    errors = []
    prints = {}
    for r in got:
        own, edited, follow = texts[NONE if r.doc_id is None else r.doc_id, r.edited_sha256]
        assert prints.setdefault(" ".join(sorted(bag(own).elements())), r.fingerprint) == r.fingerprint
        assert prints.setdefault(" ".join(sorted(bag(edited).elements())), r.edited_fingerprint) == r.edited_fingerprint
        errors += [r.near_edited - likeness(own, edited), r.near_next - likeness(own, follow)]
    return errors


@pytest.mark.parametrize("sizes", [{}, {"each": 8, "ranges": 4, "within": 8}])
def test_likeness_estimates_the_generalised_jaccard_similarity(spark, tmp_path, sizes):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = [(i * 3, " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 30, 200])))) for i in range(300)]
    rows += [(5000 + i, rows[7][1]) for i in range(40)] + [(10000, None), (10001, ""), (10002, "  "), (3, "again é日本"), (3, "again"), (20000, "word " * 30000)]
    rows += [(rng.choice([None, 66]), f"{i} " + " ".join(rng.choices(vocabulary, k=rng.choice([3, 30, 200])))) for i in range(200)]
    rows += [rows[-1]] * 3
    errors = check(spark, rows, tmp_path, **sizes)
    assert abs(sum(errors) / len(errors)) < 0.02
    assert (sum(e * e for e in errors) / len(errors)) ** 0.5 < 0.1


def test_hot_ids_are_divided(spark):
    docs = spark.range(4000).selectExpr("if(id < 2500, -7, id) AS key", "xxhash64(id) & 9223372036854775807 AS h")
    got = fingerprints._ranged(docs, each=20, ranges=16, within=32)
    assert max(r["count"] for r in got.groupBy("range").count().collect()) <= 80
    rows = [(r.key, r.h, r.range) for r in got.collect()]
    assert [r for _, _, r in sorted(rows)] == sorted(r for _, _, r in rows)


def test_likeness_is_that_of_the_fingerprints(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = fingerprints.fingerprint(docs).collect()
    parts = lambda x: [x[i : i + 8] for i in range(0, len(x), 8)]
    for r in got:
        assert r.near_edited == sum(a == b for a, b in zip(parts(r.fingerprint), parts(r.edited_fingerprint))) / 32
    assert {tuple(r) for r in got} == {tuple(r) for r in fingerprints.fingerprint(docs, each=2).collect()}


def test_single_document_and_none(spark, tmp_path):
    assert check(spark, [(4, "one document here")], f"{tmp_path}/a")
    assert check(spark, [], f"{tmp_path}/b") == []
