import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corrmatch.llm import substrings as sub
from corrmatch.llm.common import documents


def words(rng, n):
    return ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 7))) for _ in range(n)]


def run(spark, rows, path):
    spark.createDataFrame([(*r, len(r[1] or ""), "x") for r in rows], "doc_id long, text string, n_chars long, removed string").withColumn("spans", F.lit(1)).withColumn("own", F.lit(2)).repartition(3).write.parquet(f"{path}/documents.parquet")
    return sub.op3_substring_dedup(spark, str(path)).collect()


def test_banding_meets_its_promise():
    n, rows = sub.BANDS, sub.ROWS
    assert (1 - 0.8**rows) ** n <= 0.001
    rng = random.Random(1)
    met = 0
    for _ in range(100):
        a = words(rng, 60)
        b = list(a)
        b[rng.randrange(5, 55)] = "changed"
        u = sub.Units([" ".join(a), " ".join(b)])
        met += bool((u.signatures[0] == u.signatures[1]).any())
    assert met >= 99


def test_passages_are_found_wherever_they_stand(spark, tmp_path):
    rng = random.Random(2)
    filler = lambda: " ".join(words(rng, rng.randrange(5, 120)))
    rows, planted = [], {}
    for p in range(40):
        passage = words(rng, rng.randrange(51, 90))
        if p % 3 == 0:
            passage[20] += "\n" + passage.pop()
        passage = " ".join(passage)
        for _ in range(rng.choice([2, 2, 3, 8])):
            i = len(rows)
            glue = rng.choice([" ", "\n"])
            rows.append((i, filler() + glue + passage + glue + filler()))
            planted.setdefault(p, []).append(i)
    near = words(rng, 80)
    for k in range(4):
        w = list(near)
        w[30 + k] = "edited"
        planted.setdefault("near", []).append(len(rows))
        rows.append((len(rows), filler() + "\n" + " ".join(w) + "\n" + filler()))
    clean = range(len(rows), len(rows) + 150)
    rows += [(i, "\n".join([filler(), "Licensed under the terms of the public licence, as it stands.", filler()])) for i in clean]
    got = run(spark, rows, tmp_path)
    found = {r.doc_id for r in got}
    caught = [i for ids in planted.values() for i in ids]
    assert sum(i in found for i in caught) >= 0.97 * len(caught)
    assert not found & set(clean)
    first = {min(ids) for ids in planted.values()}
    assert not any(r.removed for r in got if r.doc_id in first)
    gone = {r.doc_id for r in got if r.removed}
    assert sum(i in gone for i in caught if i not in first) >= 0.97 * (len(caught) - len(first))
    cleaned = {r.doc_id: r for r in sub.deduplicate(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect()}
    assert len(cleaned) == len(rows)
    for i, text in rows:
        r = cleaned[i]
        assert r.n_chars == len(r.text) and r.removed == "x"
        if i not in gone:
            assert r.text == text
        else:
            left = len(text.split()) - sum(x.n_words for x in got if x.doc_id == i and x.removed)
            assert len(r.text.split()) == left


def test_copies_and_odd_rows(spark, tmp_path):
    rng = random.Random(3)
    text = " ".join(words(rng, 200))
    twice = " ".join(words(rng, 60))
    rows = [(i, text) for i in range(1, 30)] + [(50, None), (51, ""), (52, "x"), (53, f"{twice}\n{twice}"), (54, "same " * 500), (55, "same " * 400), (60, text[:5] * 3), (60, text[:5] * 3)]
    got = run(spark, rows, tmp_path)
    assert {r.doc_id for r in got if r.removed} == {*range(2, 30), 55}
    assert all(r.keeper == 1 for r in got if r.doc_id < 30)  # 55 has the shingles of 54
    assert not {r.doc_id for r in got} & {50, 51, 52, 53, 60}


@pytest.mark.parametrize("empty", [True])
def test_empty_table(spark, tmp_path, empty):
    assert run(spark, spark.createDataFrame([], "doc_id long, text string").collect(), tmp_path) == []
    assert sub.deduplicate(spark.read.parquet(f"{tmp_path}/documents.parquet")).count() == 0


def test_without():
    assert sub.without("a b  c\nd e", [(1, 3)]) == "a d e"
    assert sub.without("a b", [(0, 2)]) == "" and sub.without(" é ü ", [(1, 2)]) == " é "


def test_cuts_depend_on_nearby_words_only():
    rng = random.Random(4)
    passage = words(rng, 60)
    a, b = (sub.Units([" ".join(words(rng, n) + passage + words(rng, 30))]) for n in (11, 50))
    assert len(np.intersect1d(a.keys[a.paragraphs :], b.keys[b.paragraphs :])) >= 3


def test_a_family_around_one_paragraph_stays_together(spark, tmp_path):
    rng = random.Random(6)
    hub = words(rng, 50)
    rows = [(0, " ".join(hub))]
    for i in range(1, 401):
        w = list(hub)
        w[22 + i % 7] = f"variant{i}"
        rows.append((i, " ".join(w)))
    sets = [{tuple(t.split()[k : k + 5]) for k in range(46)} for _, t in rows]
    assert all(len(sets[0] & s) >= 0.8 * len(sets[0] | s) for s in sets)  # one component, by the hub
    u = sub.Units([t for _, t in rows])
    apart = [i for i in range(1, 401) if not (u.signatures[0] == u.signatures[i]).any()]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sub.repeats(documents(spark, str(tmp_path)), block=64).collect()
    assert not [i for i in apart if i]  # MinHash itself loses none here
    whole = {r.doc_id for r in got if r.begin == 0 and r.n_words == 50 and r.keeper == 0}
    assert whole == set(range(401))


def test_wrapped_and_short_paragraphs_count(spark, tmp_path):
    rng = random.Random(8)
    filler = lambda: " ".join(words(rng, 40))
    wrapped = lambda w, n: "\n".join(" ".join(w[i : i + n]) for i in range(0, len(w), n))
    long_, short = words(rng, 96), words(rng, 24)
    edited = [f"edit{i}" if i in (20, 70) else w for i, w in enumerate(long_)]  # 82 of 102 shingles alike
    rows = [(k, f"{filler()}\n\n{wrapped(w, n)}\n\n{filler()}") for k, (w, n) in enumerate([(long_, 12), (edited, 12), (long_, 15)])]
    rows += [(10 + k, f"{filler()}\n{' '.join(short)}\n{filler()}") for k in range(3)]
    got = {r.doc_id: (r.begin, r.n_words, r.removed, r.keeper) for r in run(spark, rows, tmp_path)}
    assert got == {**{k: (40, 96, k > 0, 0) for k in range(3)}, **{10 + k: (40, 24, k > 0, 10) for k in range(3)}}


def test_paragraphs_agree_with_all_pairs(spark, tmp_path):
    rng = random.Random(12)
    base = [words(rng, rng.randrange(56, 90)) for _ in range(40)]
    docs = []
    for i in range(70):
        parts = []
        for p in rng.sample(base, 3) if i % 2 else [words(rng, 60), rng.choice(base), words(rng, 30)]:
            p = list(p)
            if rng.random() < 0.4:
                p[len(p) // 2] = f"edit{i}"
            parts.append(p)
        docs.append((3 * i, parts))
    paragraphs = [(d, k, tuple(p)) for d, parts in docs for k, p in enumerate(parts)]
    sets = [{p[i : i + 5] for i in range(len(p) - 4)} for _, _, p in paragraphs]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    holders = {}
    for i, (d, _, _) in enumerate(paragraphs):
        holders.setdefault(find(i), set()).add(d)
    at = {(d, k): sum(map(len, parts[:k])) for d, parts in docs for k in range(3)}
    expected = {}
    for i, (d, k, p) in enumerate(paragraphs):
        if len(holders[find(i)]) > 1:
            for w in range(at[d, k], at[d, k] + len(p)):
                expected[d, w] = min(holders[find(i)]) != d
    rows = [(d, "\n".join(" ".join(p) for p in parts)) for d, parts in docs]
    got = {}
    for r in run(spark, rows, tmp_path):
        for w in range(r.begin, r.end):
            got[r.doc_id, w] = got.get((r.doc_id, w), False) or r.removed
    assert got == expected


def test_rows_of_one_id_are_cut_by_their_own_text(spark):
    rng = random.Random(13)
    passage, other, third = (" ".join(words(rng, 60)) for _ in range(3))
    rows = [(1, passage, 0, "a"), (2, f"{third}\n{passage}", 1, "b"), (2, f"{passage}\n{other}", 2, "c"), (2, f"{passage}\n{other}", 3, "d"), (None, other, 4, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `__own` int, row string")
    got = {r["__own"]: r.text.strip() for r in sub.deduplicate(docs).collect()}
    assert got == {0: passage, 1: third, 2: "", 3: "", 4: other}
    assert sub.deduplicate(docs).columns == docs.columns


def test_a_line_of_all_documents_sends_two_ids_a_slice():
    key, value = np.array([7, 7, 7, 7, 9, 5, 5], np.uint64), np.array([4, 2, 9, 2, 1, 3, 3], np.int64)
    assert [x.tolist() for x in sub._pairs(key, value, True)] == [[5, 7, 7, 9], [3, 2, 9, 1]]
    assert [x.tolist() for x in sub._pairs(key, value, False)] == [[5, 7, 7, 7, 9], [3, 2, 4, 9, 1]]
    assert [len(x) for x in sub._pairs(key[:0], value[:0], True)] == [0, 0]
