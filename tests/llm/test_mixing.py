import random

import duckdb
import pytest
from pyspark.sql import functions as F

from corrmatch.llm import mixing

SF = "/root/testdata/sf0.001"


def test_query_agrees_with_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    cur = con.execute(mixing.SQL)
    names = [c[0] for c in cur.description]
    expected = {r[names.index("doc_id")]: dict(zip(names, r)) for r in cur.fetchall()}
    got = mixing.op5_source_mixing(spark, SF)
    assert sorted(got.columns) == sorted(names)
    rows = {r.doc_id: r.asDict() for r in got.collect()}
    assert rows.keys() == expected.keys()
    for k, r in rows.items():
        for c, v in r.items():
            assert v == pytest.approx(expected[k][c], abs=2e-6), (k, c)


def test_raked_shares_meet_the_targets(spark):
    rng = random.Random(1)
    cells = spark.createDataFrame([(f"s{i}", f"l{j}", f"t{k}", rng.randrange(1, 10_000)) for i in range(9) for j in range(4) for k in range(3)], "source string, lang string, topic string, w long")
    targets = {"source": {f"s{i}": (i + 1) / 45 for i in range(9)}, "lang": 0.0, "topic": 0.5}
    raked = mixing.rake(cells, targets).toPandas()
    assert raked["share"].sum() == pytest.approx(1)
    for i in range(9):
        assert raked.share[raked.source == f"s{i}"].sum() == pytest.approx((i + 1) / 45)
    assert raked.groupby("lang")["share"].sum().tolist() == pytest.approx([0.25] * 4)


def test_kept_words_meet_the_targets_and_nothing_runs_python(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randrange(1, 60), rng.choice(["en", "en", "en", "de"]), rng.choice(["a", "a", "a", "a", "b"]), "old", 5) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _kept string, share int")
    assert mixing.sample(docs, targets={"source": 1.0, "lang": 1.0, "topic": 1.0}).where("_kept = 'old'").count() == 6000
    docs = docs.withColumnRenamed("_kept", "_t")
    got = mixing.mix(docs, {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.6, "de": 0.4}, "topic": 1.0})
    plan = got._jdf.queryExecution().toString()
    assert not any(k in plan for k in ("Python", "Pandas", "ArrowEval"))
    sums = {(r.source, r.lang): r.n for r in got.where("_kept").groupBy("source", "lang").agg(F.sum("_words").alias("n")).collect()}
    total = sum(sums.values())
    assert sum(n for (s, _), n in sums.items() if s == "a") / total == pytest.approx(0.5, abs=0.03)
    assert sum(n for (_, lang), n in sums.items() if lang == "en") / total == pytest.approx(0.6, abs=0.03)
    kept = mixing.sample(docs, targets={"source": 0.5, "lang": 1.0, "topic": 1.0})
    assert kept.columns == docs.columns and 0 < kept.count() < 6000


def test_odd_rows(spark, tmp_path, monkeypatch):
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, "a b", None, "a"), (3, "a b", None, "a"), (None, "1234 567", "de", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    one = sorted(map(str, mixing.mix(docs).collect()))
    assert len(one) == 5
    monkeypatch.setattr(mixing, "BROADCAST", 0)
    assert sorted(map(str, mixing.mix(docs).collect())) == one
    assert all(r._kept == (r._words > 0) or r._words > 0 for r in mixing.mix(docs).collect())
    assert mixing.sample(docs.where("doc_id < 3")).count() == 2  # nothing weighs anything
    docs.where("false").write.parquet(f"{tmp_path}/documents.parquet")
    assert mixing.op5_source_mixing(spark, str(tmp_path)).count() == 0


def test_targets_that_contradict_each_other_leave_a_gap(spark):
    cells = spark.createDataFrame([("a", "en", "t", 70), ("b", "de", "t", 30)], "source string, lang string, topic string, w long")
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"en": 0.9, "de": 0.1}, "topic": 1.0}
    for alone in (False, True):
        got = mixing.rake(cells.coalesce(1) if alone else cells, targets, rounds=6, alone=alone).collect()
        assert all(r.gap > 0.1 for r in got) and sum(r.share for r in got) == pytest.approx(1)
    slow = spark.createDataFrame([("a", "en", "t", 10_000), ("a", "de", "t", 1), ("b", "en", "t", 1), ("b", "de", "t", 1_000)], cells.schema)
    got = mixing.rake(slow.coalesce(1), {"source": 1.0, "lang": {"en": 0.5, "de": 0.5}, "topic": 1.0}, alone=True).collect()
    assert got[0].gap < mixing.EPSILON and sum(r.share for r in got if r.lang == "en") == pytest.approx(0.5)


def test_values_that_a_target_does_not_name_are_not_wanted(spark):
    docs = spark.createDataFrame([(i, "a b c", "en", "ab"[i % 2]) for i in range(50)], "doc_id long, text string, lang string, source string")
    assert {r.source for r in mixing.sample(docs, targets={"source": {"a": 1.0}, "lang": 1.0, "topic": 1.0}).collect()} == {"a"}
