import random

import pytest

from corrmatch.llm import jaccard
from corrmatch.llm.common import documents
from corrmatch.llm.components import components


def brute(rows):
    """doc_id -> (set size, component) by comparing all sets that share a shingle."""
    sets = {}
    for doc_id, text in rows:
        w = (text or "").encode().lower().split()
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    tried = set()
    for ids in holders.values():
        for i in ids:
            for j in ids:
                if i < j and (i, j) not in tried:
                    tried.add((i, j))
                    both = len(sets[i] & sets[j])
                    if 100 * both >= 80 * len(sets[i] | sets[j]):
                        a, b = sorted((find(i), find(j)))
                        root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def run(spark, rows, tmp_path, **sizes):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(documents(spark, str(tmp_path)), **sizes).collect()}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(800)]
    passage = rng.choices(vocabulary, k=30)
    texts = [rng.choices(vocabulary, k=rng.choice([1, 2, 4, 5, 6, 7, 8, 9, 10, 12, 20, 40, 80, 200, 500])) for _ in range(60)]
    for _ in range(240):
        w = list(rng.choice(texts))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            w += rng.choices(vocabulary, k=rng.randrange(1, 1 + max(1, len(w) // 5)))
        texts.append(w)
    texts += [rng.choices(vocabulary, k=20) + passage + rng.choices(vocabulary, k=rng.randrange(20)) for _ in range(60)]
    base = rng.choices(vocabulary, k=90)
    for _ in range(60):  # a large group of near copies
        w = list(base)
        for _ in range(rng.randrange(1, 5)):
            w[rng.randrange(90)] = rng.choice(vocabulary)
        texts.append(w)
    rng.shuffle(texts)
    return [(7 * i, " ".join(w)) for i, w in enumerate(texts)] + [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "ONE  TWO"), (6, "ÉtÉ")]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_agree_with_all_pairs(spark, tmp_path, seed):
    rows = corpus(seed)
    assert run(spark, rows, tmp_path, small=4, block=16) == brute(rows)


def test_clashing_columns_and_no_rows(spark, tmp_path):
    df = spark.createDataFrame([(1, "a b c d e f", 5, "x")], "doc_id long, text string, component_id int, k1 string")
    assert [tuple(r) for r in jaccard.join(df).select("doc_id", "n_shingles", "component_id").collect()] == [(1, 2, 1)]
    assert run(spark, spark.createDataFrame([], "doc_id long, text string").collect(), tmp_path) == {}


def test_long_chain_and_star(spark):
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7), (5000, 4999)]
    rng.shuffle(links)
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, **{1000 + i: 1000 for i in range(300)}, 4999: 4999, 5000: 4999}


def test_cells_never_exceed_the_difference():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, m in ((5, 6), (60, 66), (300, 333), (5000, 5600), (70, 900)):
        a = rng.integers(0, 1 << 62, n, np.uint64)
        b = np.concatenate((a[: n * 9 // 10], rng.integers(0, 1 << 62, m - n * 9 // 10, np.uint64)))
        assert jaccard._apart(jaccard._cells(a), jaccard._cells(b)) <= len(np.setxor1d(a, b))
    crowd = np.arange(9000, dtype=np.uint64) << np.uint64(20)  # all in one cell
    assert jaccard._apart(jaccard._cells(crowd), jaccard._cells(crowd[:8000])) <= 1000
