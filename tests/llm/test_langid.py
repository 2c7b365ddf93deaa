import collections
import math
import random
import zlib

import numpy as np

from corrmatch.llm import langid

SF = "/root/testdata/sf0.001"


def test_grams_agree_with_a_plain_count(monkeypatch):
    text = "Été, l'été 12 ñandú — 日本 x" * 40
    whole = langid.grams(text)
    for chunk in (7, 64):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        part = langid.grams(text)
        assert (whole[0] == part[0]).all() and (whole[1] == part[1]).all()
    n = len(text.lower()) + 2
    assert whole[1].sum() == n + (n - 1) + (n - 2)


def test_held_out_accuracy(spark):
    got = langid.op10_language_id(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    out = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.95 * len(out)
    assert all(0 <= r.score <= 1 for r in got)


def test_temperature_lowers_the_loss():
    model = langid.Model(["a", "b"], np.ones(4))
    model.weights = np.array([[9.0, 0], [0, 9], [0, 0], [0, 0]])
    x = np.array([1.0])
    model.calibrate([(int(i % 5 == 0), np.array([0]), x) for i in range(100)])
    p = langid._softmax(x @ model.weights[[0]] / model.temperature)
    assert abs(p[0] - 0.8) < 0.01


def test_odd_rows(spark, tmp_path):
    rows = [(i, t * 9, lang, 1.0) for i, (t, lang) in enumerate([("the cat and the hat ", "en"), ("der und die katze ", "de")] * 30)]
    rows += [(900, None, "en", 1.0), (901, "12 34 !", "en", 1.0), (902, "", None, 1.0), (903, "the the and", None, 1.0), (None, "und die", "xx", 1.0), (1, rows[1][1], "de", 1.0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, score double").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.held_out, r.lang_pred, r.score) for r in langid.op10_language_id(spark, str(tmp_path)).collect()}
    assert [got[i][1:] for i in (900, 901, 902)] == [("und", 0.0)] * 3
    assert got[903][1] == "en" and got[None][0] and got[None][1] == "de"


def test_nothing_to_learn(spark, tmp_path):
    spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/a/documents.parquet")
    assert [r.lang_pred for r in langid.op10_language_id(spark, f"{tmp_path}/a").collect()] == ["und"]
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert langid.op10_language_id(spark, f"{tmp_path}/b").count() == 0


def test_every_label_is_learned(spark, monkeypatch):
    rng = random.Random(7)
    rows, labels = [], [f"l{k:03}" for k in range(240)]
    for lang in labels:
        words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5)) for _ in range(4)]
        rows += [(len(rows) + i, " ".join(rng.choices(words, k=12)), lang) for i in range(6 if lang < "l200" else 5)]
    docs = langid._fold(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), 5).cache()
    monkeypatch.setattr(langid, "PART", 64 * 8 * langid.DIM)  # four parts
    model = langid.train(docs)
    assert model.labels == labels
    truth = {i: lang for i, _, lang in rows}
    got = langid.predict(docs, model).collect()
    right = [r.doc_id for r in got if r.lang_pred == truth[r.doc_id]]
    assert len(got) == len(rows) and len(right) >= 0.95 * len(rows)
    assert sum(truth[i] >= "l200" for i in right) >= 0.9 * sum(lang >= "l200" for lang in truth.values())


def test_nothing_learned_keeps_texts_with_letters(spark):
    docs = spark.createDataFrame([(1, "abc def", None), (2, "12 !", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r.doc_id for r in langid.accept(docs, langid.trained(docs)).collect()] == [1]


def plain_fit(rows, dim, labels, epochs):
    """FTRL-proximal by the book, one weight at a time."""
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(f, c):
        if abs(z[f, c]) <= langid.L1:
            return 0.0
        return -(z[f, c] - math.copysign(langid.L1, z[f, c])) / ((langid.BETA + math.sqrt(n[f, c])) / langid.ALPHA + langid.L2)

    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            label, features, x = rows[i]
            w = {(f, c): weight(f, c) for f in features.tolist() for c in range(labels)}
            scores = [sum(v * w[f, c] for f, v in zip(features.tolist(), x.tolist())) for c in range(labels)]
            top = [math.exp(s - max(scores)) for s in scores]
            for f, v in zip(features.tolist(), x.tolist()):
                for c in range(labels):
                    g = v * (top[c] / sum(top) - (c == label))
                    sigma = (math.sqrt(n[f, c] + g * g) - math.sqrt(n[f, c])) / langid.ALPHA
                    z[f, c] += g - sigma * w[f, c]
                    n[f, c] += g * g
    return np.array([[weight(f, c) for c in range(labels)] for f in range(dim)])


def test_fit_and_prediction_agree_with_a_plain_version(spark):
    rng = np.random.default_rng(3)
    idf = rng.uniform(1, 4, 30)
    model = langid.Model(["a", "b", "c"], np.append(idf, np.ones(5)))
    rows = []
    for _ in range(80):
        f = np.sort(rng.choice(30, rng.integers(1, 9), replace=False))
        c = rng.integers(1, 6, len(f))
        x = np.array([(1 + math.log(k)) * idf[i] for i, k in zip(f, c)])
        x /= math.sqrt((x * x).sum())
        assert np.allclose(model.values(f, c), x)
        rows.append((int(f[0] % 3), f, x))
    model.fit(rows)
    expected = plain_fit(rows, 35, 3, langid.EPOCHS)
    assert np.allclose(model.weights, expected, atol=1e-9) and not expected[30:].any()
    part = langid._Part(model.weights)
    for _, f, x in rows:
        assert np.allclose(part.logits(f, x), x @ expected[f], atol=1e-5)


def test_ties_and_very_long_texts(spark):
    model = langid.Model(["a", "b"], np.ones(langid.DIM, np.float32))
    model.weights = np.zeros((langid.DIM, 2))
    docs = spark.createDataFrame([(1, "x", False), (2, "word " * 900_000, True), (3, "word", True)], "doc_id long, text string, held_out boolean")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(docs, model).collect()}
    assert got == {i: ("a", 0.5) for i in (1, 2, 3)}  # of equal scores the first label
