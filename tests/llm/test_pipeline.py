import collections
import hashlib
import random

import pytest

import corpus_pipeline
from corrmatch.llm import mixing, tokens
from tests.llm.test_jaccard import brute


def corpus(seed):
    rng = random.Random(seed)
    langs = {"en": "the of and to in is that was for it".split(), "de": "der die und zu mit nicht ist auch sich ein".split()}
    vocabulary = {k: v + [f"{v[i % 10]}{v[j]}" for i in range(10) for j in range(10)] for k, v in langs.items()}
    rows = []
    for i in range(260):
        lang = rng.choice(["en", "en", "de"])
        rows.append([i, " ".join(rng.choices(vocabulary[lang], k=rng.randrange(8, 150))), lang, rng.choice(["a", "a", "a", "b", "c"])])
    for i in range(40):  # near copies and copies
        base = rows[rng.randrange(100)]
        w = base[1].split()
        if i % 2 and len(w) > 60:
            w[rng.randrange(len(w))] = "changed"
        rows.append([300 + i, " ".join(w), base[2], base[3]])
    passage = " ".join(f"{rng.choice(vocabulary['en'])}{k}" for k in range(70))
    for i in (20, 90, 150):
        rows[i][1] += "\n" + passage
        rows[i][2] = "en"
    return rows + [[900, None, "en", "a"], [901, "12 $$ 34", "en", "a"], [902, "", None, None]], passage


@pytest.mark.parametrize("seed", [1])
def test_stages_against_plain_versions(spark, tmp_path, seed):
    rows, passage = corpus(seed)
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], schema).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if name != "best_fit_packing":
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r.doc_id: r for r in docs.collect()} if name != "best_fit_packing" else docs.collect())
    language, near, passages, mixed, packed = kept
    texts = {r[0]: r[1] for r in rows}
    assert set(language) == {i for i, t in texts.items() if t and any(map(str.isalpha, t))}
    groups = brute([(i, r.text) for i, r in language.items()])
    assert set(near) == {i for i, (_, first) in groups.items() if first == i}
    assert set(passages) == set(near)
    holders = [i for i in sorted(near) if passage in near[i].text]
    words = passage.split()
    for i in holders:
        left = sum(w in passages[i].text.split() for w in words)
        assert left == 70 if i == holders[0] else left < 20
    assert all(passages[i].text == near[i].text for i in near if i not in holders)
    assert set(mixed) == plain_mixture(passages.values())
    model, expected = tokens.Encoder(tokens.default_path()).model, collections.Counter()
    for i, r in mixed.items():
        n = len(model.encode(r.text, add_special_tokens=False).ids) + 1
        expected.update((i, at, min(2048, n - at)) for at in range(0, n, 2048))
    assert collections.Counter((r.doc_id, r.start, r.length) for r in packed) == expected
    assert {tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "length").collect()} == {(r.doc_id, r.piece, r.length) for r in packed}


def plain_mixture(rows):
    """The doc_ids kept, by the same formulas over plain dictionaries."""

    def topic(t, n):
        share = lambda chars: sum(t.count(c) for c in chars) / max(1, len(t))
        if t.count("|") * 10 >= max(n, 1):
            return "table"
        return "figures" if share("0123456789") >= 0.05 else "symbols" if share("%$#&*!") >= 0.02 else "list" if (t.count("\n") + 1) * 8 >= max(n, 8) else "prose"

    cell = {r.doc_id: (r.source or "", r.lang or "", topic(r.text, len(r.text.split()))) for r in rows}
    size = {r.doc_id: len(r.text.split()) for r in rows}
    base = collections.Counter()
    for i, c in cell.items():
        base[c] += size[i]
    share = dict(base)
    targets = []
    for d, e in enumerate(mixing.TARGETS.values()):
        sums = collections.Counter()
        for c, w in base.items():
            sums[c[d]] += w
        targets.append({v: w**e / sum(x**e for x in sums.values()) for v, w in sums.items()})
    for _ in range(200):
        for d in range(3):
            now = collections.Counter()
            for c, w in share.items():
                now[c[d]] += w
            share = {c: w * targets[d][c[d]] / now[c[d]] for c, w in share.items()}
    weight = {c: share[c] / base[c] for c in base}
    most = max(weight.values())
    draw = lambda i: int(hashlib.md5(f"{mixing.SEED}:{i}".encode()).hexdigest()[:8], 16) / 2**32
    return {i for i, c in cell.items() if draw(i) < weight[c] / most}


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows_pass_all_stages(spark, tmp_path):
    rows, _ = corpus(7)
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans int, component_id string, own double"
    long = " ".join(f"the{i % 977}of{i % 31}" for i in range(150_000))
    rows = [*rows[:80], *[[None, f"{t} again", la, s] for _, t, la, s in rows[80:90]], *[rows[3]] * 4, [3, "the other text of one id", "en", None], [950, long, "en", "a"], [951, None, None, None]]
    docs = spark.createDataFrame([(*r, len(r[1] or ""), 1, "x", 0.5) for r in rows], schema)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(got[0].asDict())
    docs.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
