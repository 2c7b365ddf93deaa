import codecs
import fnmatch
import random
import re
from collections import Counter
from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corrmatch.config import Charsets, Exclusions, Settings, charset
from corrmatch.functions import charsets, globs, profile, similarity, text
from corrmatch.operators import blocks, candidates, diff, resolve


def column(spark, rows, *exprs):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + ", ".join(f"c{k} string" for k in range(len(rows[0]) if isinstance(rows[0], tuple) else 1)))
    return [tuple(r)[1:] for r in df.select("i", *exprs).orderBy("i").collect()]


def test_settings_exclusions_and_charsets():
    assert Settings.of({"llm_failure_limit": 99, "max_llm_per_file": "2.6", "llm_min_sim": "x", "content_sim_threshold": 1, "other": 3}) == Settings(20, 3, 15.0, 10.0)
    assert Settings.of(None) == Settings.of({"llm_min_sim": None}) == Settings()
    got = Exclusions.of({"files": [" *.a ", 3, "", "x\\y" + "z" * 400] + ["p"] * 300, "dirs": ["d/", "/"]})
    assert got.files[0] == "*.a" and len(got.files[1]) == 300 and len(got.files) == 198 and got.dirs == ("d",)
    assert Exclusions.of("no") == Exclusions()
    assert [charset(x) for x in ("UTF8", " Shift_JIS ", "nope", None, "utf_16_le", "windows-1252")] == ["utf-8", "shift_jis", "auto", "auto", "utf-16-le", "cp1252"]
    assert Charsets.of({"left": "latin1"}) == Charsets("latin-1", "auto")


def test_extensions_and_stems(spark):
    names = [".env", "a.tar.gz", "..x", "a.", "a.b.c", "NAME.TXT", "plain", ".a.b"]
    got = column(spark, names, text.extension(F.col("c0")), text.stem(F.col("c0")))
    import os

    assert got == [(os.path.splitext(n)[1].lower(), n.rsplit(".", 1)[0].lower()) for n in names]


PATTERNS = ["*.java", "a?c", "[ab]*.py", "[!x]y", "d/*/f.*", "x[", "a.b", "*", "né*", "[]a]b", "a+b", "[a-c]?"]


def test_globs_agree_with_the_shell_rules(spark):
    names = ["Main.java", "abc", "ac", "a.py", "by.py", "xy", "zy", "x[", "a.b", "aXb", "née", "]b", "a+b", "aab", "b1", "line\n"]
    for p in PATTERNS:
        got = column(spark, names, globs.excluded(F.col("c0"), F.concat(F.lit("d/e/"), F.col("c0")), (p,)))
        assert [r[0] for r in got] == [fnmatch.fnmatchcase("d/e/" + n if "/" in p else n, p) for n in names], p
    got = column(spark, ["", "d", "a/d/b", "ad", "a/ad"], globs.folder_excluded(F.col("c0"), ("d",)))
    assert [r[0] for r in got] == [False, True, True, False, False]


CODE = [
    ('/* x\n y */ int a; // tail\nchar *s = "http://x"; \'q\'', "Java", ".java"), ("'''doc'''\nx = 1 # c\n\"\"\"m\nn\"\"\" y", "Python", ".py"), ("a # b\nc", "Ruby", ".rb"),
    ("<p><!-- a\nb --></p>", "HTML", ".html"), ("select 1 -- c\n/* d */ from t", "SQL", ".sql"), ("mov a ; b\nret", "Assembly", ".s"), ("a { /* kept */ }", "CSS", ".css"),
    ("  a \t b\n\n\n c\x0b d  \n", "Generic text", ""), ("naïve Größe_1 + ü\xa0x\x85y", "Generic text", ".txt"), ("", "Generic text", ""), ('"a\\"b" "c\nd" \'', "Generic text", ""),
]


def plain_form(content, language, ext):
    content = similarity._LITERAL.sub('""', similarity.without_comments(content.replace("\r\n", "\n").replace("\r", "\n"), language, ext))
    lines = (re.sub(r"\s+", " ", line.strip()) for line in content.split("\n"))
    return "\n".join(line for line in lines if line)


def test_native_text_rules_agree_with_plain_ones(spark):
    got = column(spark, CODE, text.cleaned(F.col("c0"), F.col("c1"), F.col("c2")), text.tokens(F.col("c0")), text.blank(F.col("c0")))
    for (content, language, ext), (form, tokens, blank) in zip(CODE, got):
        assert form == plain_form(content, language, ext)
        assert tokens == re.findall(r"\w+|[^\w\s]", content)
        assert blank == (not content.strip())


def test_long_literals_do_not_break_the_engine(spark):
    long = '"' + "x" * 200_000 + '" ' + '"' + "\\n" * 100_000 + '"'
    assert column(spark, [long], text.without_literals(F.col("c0"))) == [('"" ""',)]


SAMPLES = [
    "package a.b;\nimport java.util.List;\npublic class X {}", "def f(x):\n    return x\nif __name__ == '__main__':\n    f(1)", "#include <stdio.h>\nint main() { printf(1); }", "<!DOCTYPE html><html>",
    "<?xml version='1'?><a/>", '{"a": 1}', "# Title\n```py\n```\n", "SELECT a FROM t", "hello there", "fn main() {}\nuse std::io;", "#!/bin/bash\necho ${x}", "",
]


def test_native_profile_agrees_with_the_plain_one(spark):
    rows = [(s, e) for s in SAMPLES for e in ("", ".inc", ".CL", ".zzz")]
    got = column(spark, rows, profile.profile(F.col("c0"), F.col("c1")))
    assert [tuple(r[0]) for r in got] == [profile.language_of(s, e) for s, e in rows]
    assert profile.by_extension()[".inc"] == "Pascal" and profile.by_extension()[".cl"] == "Lisp"


def test_prompts():
    line = profile.prompt_line("A", "Java", "content", "high", "", "utf-8")
    assert "(none)" in line and "JVM" in line and line in profile.system_prompt(line, line)


def test_scores_of_answers(spark):
    rows = [("85", ""), ("<think>12</think> 70/100", ""), ("I say 90 out of 100", ""), ("", "so 40"), ("none", ""), ("<think>5", "9"), ("123456789012", ""), ("007", ""), ("rule 3 gives 55.", "")]
    assert [r[0] for r in column(spark, rows, text.score(F.col("c0"), F.col("c1")))] == [85, 70, 90, 40, None, 9, 100, 7, 55]


def test_middle_out(spark):
    long = "".join(chr(97 + i % 26) for i in range(9001))
    (got,), (short,) = column(spark, [long, "x" * 6000], text.middle_out(F.col("c0")))
    mark = "\n/* ... truncated ... */\n"
    assert got == long[:2400] + mark + long[4500 - 1050 : 4500 + 1050] + mark + long[-1460:] and short == "x" * 6000


@pytest.mark.parametrize(
    ("data", "binary", "name"),
    [
        (b"", False, "utf-8"), (b"plain", False, "utf-8"), ("é".encode()[:1] + b"abc", False, "cp1252"), ("aé".encode()[:2], False, "utf-8"), (b"\x81\x8d x", False, "latin-1"),
        (b"a\0b", True, ""), (bytes(range(1, 7)) * 10, True, ""), ("text here".encode("utf-16"), False, "utf-16"), ("text here".encode("utf-16-be"), False, "utf-16-be"),
        ("text here".encode("utf-32-le"), False, "utf-32-le"), (codecs.BOM_UTF8 + b"x", False, "utf-8-sig"), (b"\0" * 40, True, ""),
    ],
)
def test_charset_detection(data, binary, name):
    assert charsets.is_binary(data) == binary
    if not binary:
        assert charsets.detected(data) == name


def test_decoding(spark):
    assert charsets.decoded("a\r\nb\rc".encode("utf-16")) == "a\nb\nc"
    assert charsets.decoded(b"\xff\xfe\xfa", "ascii") == "�" * 3 and charsets.decoded("日本".encode("shift_jis"), "sjis") == "日本"
    df = spark.createDataFrame([(1, b"x\0", "auto"), (2, None, "utf8"), (3, b"caf\xe9 x", "auto")], "i int, c binary, n string")
    got = df.select("i", charsets.inspect("c", "n").alias("s"), charsets.decode("c", "n").alias("t")).orderBy("i").collect()
    assert [(r.s.is_binary, r.s.text_encoding, r.t) for r in got] == [(True, "", "x\0"), (False, "utf-8", ""), (False, "cp1252", "café x")]


def test_letters_after_a_plain_sample_are_read():
    plain = b"abc\n" * 3000
    for text in ("é", "Größe é", "é" * 9000 + "x"):
        for name in ("cp1252", "latin-1", "utf-8"):
            assert charsets.decoded(plain + text.encode(name)) == (plain.decode() + text)
    assert charsets.detected_whole(plain + b"\x81\xe9 x") == "latin-1" and charsets.detected_whole(plain) == "utf-8"
    # letters of a sample that are UTF-8 stay so, and a charset that is asked for is kept
    assert charsets.decoded("é".encode() + plain + b"\xe9 x") == "é" + plain.decode() + "\ufffd x"
    assert charsets.decoded(plain + b"\xe9 x", "utf-8") == plain.decode() + "\ufffd x"


def test_a_letter_that_ends_a_sample_is_read():
    for letter in "éßñöüÉ":
        for at in (0, 3, 8188, 8189, 8190, 8191, 8192):
            for rest in ("", "x", " plain" * 2000, " naïve Größe" * 900):
                text = "a" * at + letter + rest
                for name in ("cp1252", "utf-8"):
                    data = text.encode(name)
                    # of the sample, the last byte alone does not tell
                    expected = "utf-8" if name == "utf-8" or text[: min(8191, len(text) - 1)].isascii() else "cp1252"
                    assert charsets.detected(data[: charsets.SAMPLE]) == expected and charsets.decoded(data) == text
    assert charsets.decoded("é".encode() + b"a\xe9") == "éa\ufffd"


@settings(max_examples=60, deadline=None)
@given(st.text("ab c\n1_", max_size=60), st.text("ab c\n1_", max_size=60))
def test_bounds_hold(a, b):
    x, y = ({"form": f, "tokens": t, "ids": i, "filled": bool(s.strip())} for s in (a, b) for f, t, i, _ in [similarity.features(s, ".py")])
    assert similarity.bound(x, y) >= similarity.score(x, y)
    tokens = x["tokens"], y["tokens"]
    total = len(tokens[0]) + len(tokens[1])
    assert similarity.quick(Counter(tokens[0]), Counter(tokens[1]), total) >= SequenceMatcher(None, *tokens).ratio()


def test_score_cases():
    f = lambda s, e=".py": dict(zip(("form", "tokens", "ids"), similarity.features(s, e))) | {"filled": bool(s.strip())}
    assert similarity.score(f(""), f(" \n")) == 100.0 and similarity.score(f(""), f("x")) == 0.0
    assert similarity.score(f("a = 1 # x"), f("a   =  1")) == 100.0
    assert similarity.score(f("def one():\n    return 1"), f("def two():\n    return 1")) == round(0.6 * 100 * 2 * 6 / 14, 2)
    assert similarity.ratio("tide", "diet") == 0.25 and similarity.ratio("diet", "tide") == 0.5
    assert similarity.ratio("q" + "x" * 300, "x" * 300) == 0.0


def test_identifiers_and_languages():
    form = similarity.features("class Foo:\n    def bar(self): pass\n# def ghost\n", ".py")
    assert form[2] == ["Foo", "bar", "ghost"] and form[3] == "Python"
    assert "x" in similarity.identifiers('{"x": 1}', "JSON") and "div" in similarity.identifiers("<div>", "HTML")


def greedy(edges):
    taken, used = {}, set()
    for left in sorted({e[0] for e in edges}):
        free = [e for e in edges if e[0] == left and e[1] not in used]
        if free:
            best = max(free, key=lambda e: (e[2], -e[1]))
            taken[left] = best[1]
            used.add(best[1])
    return taken


@pytest.mark.parametrize("seed", range(4))
def test_rounds_give_the_greedy_choice(spark, seed):
    rng = random.Random(seed)
    edges = list({(rng.randrange(30), rng.randrange(30)): rng.randrange(4) / 4 for _ in range(250)}.items())
    edges = [(a, b, s) for (a, b), s in edges] + [(100 + i, 100 + i, 1.0) for i in range(20)] + [(100 + i, 101 + i, 2.0) for i in range(20)]
    got = resolve.greedy(spark.createDataFrame(edges, "l_ord long, r_ord long, sim double"), "sim")
    assert {r.l_ord: r.r_ord for r in got.collect()} == greedy(edges) and resolve.one_to_one(got)


def test_name_join_loses_no_pair(spark):
    rng = random.Random(3)
    names = ["".join(rng.choices("abé-_.1", k=rng.randrange(1, 9))) + rng.choice([".py", "", ".x"]) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(names)), "ord long, filename string")
    l, r = df.where("ord % 2 = 0"), df.where("ord % 2 = 1")  # noqa: E741
    got = {(x.l_ord, x.r_ord): x.name_sim for x in candidates.similar_name(l, r).collect()}
    stem = lambda n: n.rsplit(".", 1)[0].lower()
    expected = {(i, j): SequenceMatcher(None, stem(a), stem(b)).ratio() for i, a in enumerate(names) for j, b in enumerate(names) if i % 2 == 0 and j % 2 and a != b}
    assert got == pytest.approx({k: v for k, v in expected.items() if v >= 0.7})


@pytest.mark.parametrize("threshold", [10.0, 60.0, 97.0, 100.0])
def test_length_bands_lose_no_pair(spark, threshold):
    df = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([0, 1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 97, 98, 99, 100, 100, 101, 250, 0, 400])], "ord long, text string")
    got = {(r.l_ord, r.r_ord) for r in candidates.length_band(df, df, threshold).collect()}
    n = {r.ord: len(r.text) for r in df.collect()}
    assert got == {(a, b) for a in n for b in n if n[a] and n[b] and 200.0 * min(n[a], n[b]) / (n[a] + n[b]) >= threshold}


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab \t", max_size=6), max_size=12), st.lists(st.text("ab \t", max_size=6), max_size=12))
def test_diff_rows_hold_both_files(a, b):
    rows = diff.Aligner(a, b).align()
    assert [r[1] for r in rows if r[1]] == list(range(1, len(a) + 1))
    assert [r[2] for r in rows if r[2]] == list(range(1, len(b) + 1))
    for t, i, j, minor, left, right in rows:
        assert (t in ("eq", "mod")) == bool(i and j) and (t == "eq") == bool(i and j and a[i - 1] == b[j - 1])
        if left is not None:
            assert "".join(x for x, _ in left) == a[i - 1] and "".join(x for x, _ in right) == b[j - 1]
        elif t == "mod":
            assert minor and a[i - 1].split() != b[j - 1].split() or "".join(a[i - 1].split()) == "".join(b[j - 1].split())


def test_diff_of_similar_lines():
    rows = diff.Aligner(["int a = 1;", "gone", "same"], ["int a = 2;", "same", ""]).align()
    assert [(r[0], r[1], r[2], r[3]) for r in rows] == [("mod", 1, 1, False), ("del", 2, None, False), ("eq", 3, 2, False), ("add", None, 3, True)]
    assert rows[0][4] == [("int a = ", False), ("1", True), (";", False)]


def test_hex_views(spark):
    a = bytes(range(64))
    assert [r[0] for r in diff.hex_alignment(a, a[:16] + b"x" * 16 + a[16:])] == ["eq", "add", "eq", "eq", "eq"]
    zeros = diff.hex_alignment(bytes(diff.WINDOW), bytes(diff.WINDOW))
    assert len(zeros) == diff.WINDOW // 16 and {r[0] for r in zeros} == {"eq"}
    df = spark.createDataFrame([(1, a, a), (2, a * 9000, None)], "pair_id int, l_bytes binary, r_bytes binary")
    one, two = diff.hex_summary(df).orderBy("pair_id").collect()
    assert (one.identical, one.left_total, one.left_truncated) == (True, 64, False) and (two.identical, two.left_truncated, two.right_total) == (False, True, 0)
    assert diff.hex_rows(df).where("pair_id = 1 and t = 'eq'").count() == 4
    assert similarity.binary_similarity.__wrapped__(*map(__import__("pandas").Series, ([a, b"", bytes(80_000)], [a, b"x", bytes(80_000)]))).tolist() == [100.0, 0.0, 100.0]


def test_diff_function_and_context(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\nd\ne\nf\ng", "a\nb\nc\nd\ne\nf\nG"), (2, None, "x")], "pair_id int, l_text string, r_text string")
    rows = diff.context(diff.diff_rows(df), 2)
    assert [r.shown for r in rows.where("pair_id = 1").orderBy("seq").collect()][:5] == [False, False, False, False, True]
    assert rows.where("pair_id = 2 and t = 'add'").count() == 1


def test_nearest_lengths_meet_few_pairs(spark):
    rng = random.Random(6)
    for threshold, sizes in ((60.0, [0, 1, 2, 3, 4, 9, 10, 11, 20, 23, 24, 40, 90, 100, 210, 233, 234]), (100.0, [0, 1, 2, 3])):
        sides_ = [[(i, "x" * rng.choice(sizes)) for i in range(90)] for _ in range(2)]
        left, right = (spark.createDataFrame(rows, "ord long, text string") for rows in sides_)
        expected = set()
        for i, a in sides_[0]:
            pairs = [(-200.0 * min(len(a), len(b)) / (len(a) + len(b)), j) for j, b in sides_[1] if a and b]
            expected |= {(i, j, n + 1) for n, (_, j) in enumerate(sorted(p for p in pairs if -p[0] >= threshold)[:3])}
        assert {tuple(r) for r in candidates.nearest_lengths(left, right, threshold, 3).collect()} == expected
    # as many files of one length on either side: every pair has the length that it needs
    many = spark.range(60_000).selectExpr("id AS ord", "'same' AS text")
    assert candidates.nearest_lengths(many, many, 60.0, 3).count() == 180_000


def test_blocks_keep_every_pair_that_scores(spark):
    rng = random.Random(8)
    word = lambda: rng.choice(["class", "def", "if", "x", "y", "(", ")", "a1", "b2", "é", '"s"', "# c\n", "\n"])
    texts = [None, "", " \n", "# only\n", "class A", "# other"] + [" ".join(word() for _ in range(rng.choice([3, 8, 60, 300]))) for _ in range(34)]
    rows = [[(i, f"f{i % 2}", rng.choice([".py", ".txt", None]) if side == "left" else ".sql", t) for i, t in enumerate(rng.sample(texts, len(texts)))] for side in ("left", "right")]
    left, right = (spark.createDataFrame(r, "ord long, filename string, extension string, text string") for r in rows)
    feature = lambda t, e: dict(zip(("form", "tokens", "ids"), similarity.features(t or "", e or ""))) | {"filled": bool((t or "").strip())}
    score = {(a[0], b[0]): similarity.score(feature(a[3], a[2]), feature(b[3], a[2])) for a in rows[0] for b in rows[1]}
    text = [dict((r[0], r[3] or "") for r in side) for side in rows]
    for least, block in ((40.0, 7), (0.0, 4000), (15.0, 4000)):
        expected = {(i, j, s) for (i, j), s in score.items() if s >= least and i % 2 == j % 2}
        assert {(r.l_ord, r.r_ord, r.sim) for r in blocks.scored(left, right, least, by="filename", block=block).collect()} == expected
    for least, threshold in ((60.0, 60.0), (15.0, 95.0)):
        long = lambda i, j: text[0][i] and text[1][j] and 200.0 * min(len(text[0][i]), len(text[1][j])) / (len(text[0][i]) + len(text[1][j])) >= threshold  # noqa: B023, E731
        expected = {(i, j, s) for (i, j), s in score.items() if s >= least and long(i, j)}
        assert {(r.l_ord, r.r_ord, r.sim) for r in blocks.scored(left, right, least, threshold=threshold).collect()} == expected


def test_names_meet_in_blocks_and_none_is_lost():
    rng = random.Random(9)
    for least in (0.7, 0.4):
        for letters in ("abc", "abcdef0123é_", "".join(map(chr, range(0x100, 0x180)))):
            left, right = (["", *{"".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(120)}] for _ in range(2))
            expected = {(x, y, SequenceMatcher(None, x, y).ratio()) for x in left for y in right}
            assert set(blocks.name_scores(left, right, least)) == {p for p in expected if p[2] >= least}


def test_pairs_of_one_pattern_are_compared_once(monkeypatch):
    rng = random.Random(9)
    page = lambda k: "<!doctype html>\n" + "\n".join(f"<p>{' '.join(f'w{rng.getrandbits(40)}' for _ in range(8))}</p>" for _ in range(4)) + f'\n<x{k} id="">'
    left, right = [page(k) for k in range(60)], [page(k + 100) for k in range(60)]
    right[7] = left[9] + "<p>new</p>"
    feature = lambda t: dict(zip(("form", "tokens", "ids"), similarity.features(t, ".html"))) | {"filled": True}
    expected = {(i, j, similarity.score(feature(a), feature(b))) for i, a in enumerate(left) for j, b in enumerate(right)}
    calls, plain = [], similarity.ratio
    monkeypatch.setattr(similarity, "ratio", lambda *args: calls.append(1) or plain(*args))
    assert set(zip(*blocks.text_scores(left, right, ".html", 15.0))) == {e for e in expected if e[2] >= 15.0} and len(expected) == 3600
    assert len(calls) < 200
    monkeypatch.setattr(blocks, "HELD", 500)  # what is held may be dropped at any time
    assert set(zip(*blocks.text_scores(left, right, ".html", 15.0))) == {e for e in expected if e[2] >= 15.0}


def test_an_arbiter_is_asked_the_same_edges_in_order(spark):
    rng = random.Random(10)
    edges = [{"l_ord": i, "r_ord": j, "sim": float(rng.choice([10, 20, 50, 50, 90, 99])), "name_sim": rng.choice([0.7, 0.9]), "nul": rng.random() < 0.1} for i in range(40) for j in rng.sample(range(30), 12)]
    edges = [e | {"combined": 30 * e["name_sim"] + 0.7 * e["sim"]} for e in edges]
    df = spark.createDataFrame([tuple(e.values()) for e in edges], "l_ord long, r_ord long, sim double, name_sim double, nul boolean, combined double")
    for phase, rank in (("2", "sim"), ("3", "combined"), ("3b", "sim")):
        for cfg in (Settings(content_sim_threshold=95.0), Settings(max_llm_per_file=0), Settings(llm_failure_limit=1)):
            asked = []

            def judge(e):
                asked.append(e)
                return None if (e["l_ord"] + e["r_ord"]) % 9 == 0 else (e["l_ord"] * 7 + e["r_ord"] * 3) % 100

            gate, used, expected = resolve.Gate(judge, cfg.llm_failure_limit), set(), []
            for i in range(40):
                free = [e for e in sorted(edges, key=lambda e: (-e[rank], e["r_ord"])) if e["l_ord"] == i and e["r_ord"] not in used]  # noqa: B023
                if free and (got := resolve.choose(phase, free, gate, cfg)):
                    used.add(got["r_ord"])
                    expected.append(got)
            first, calls = list(asked), gate.calls
            for prepare in (None, lambda df: df.withColumn("more", F.lit(1))):
                asked.clear()
                judge.prepare = prepare
                taken, gate = resolve.with_arbiter(df, phase, rank, judge, cfg)
                plain = lambda rows: [{k: v for k, v in e.items() if k != "more"} for e in rows]
                assert plain(taken) == expected and plain(asked) == first and gate.calls == calls
                assert all(("more" in e) == bool(prepare) for e in taken)


def test_edges_of_a_file_come_to_the_driver_in_one_row(spark, monkeypatch):
    df = spark.range(20).crossJoin(spark.range(50).toDF("r_ord")).selectExpr("id AS l_ord", "r_ord", "50.0D AS sim", "false AS nul")
    seen, cut = [], resolve.cut
    monkeypatch.setattr(resolve, "cut", lambda x: seen.append(x) or cut(x))
    taken, gate = resolve.with_arbiter(df, "3b", "sim", lambda e: 90, Settings())
    assert [(e["l_ord"], e["r_ord"]) for e in taken] == [(i, i) for i in range(20)] and gate.calls == 20
    assert [x.count() for x in seen] == [20]


def test_sums_of_decoded_texts():
    import hashlib

    import pandas as pd

    data = pd.Series(["a\r\nb".encode("utf-16"), "a" * 8191 + "é", None, b"\xff\xfe\x00\xd8"], dtype=object).map(lambda x: x.encode("cp1252") if isinstance(x, str) else x)
    name = pd.Series(["auto"] * 4)
    texts = charsets.decode.__wrapped__(data, name)
    assert charsets.decoded_md5.__wrapped__(data, name).tolist() == [hashlib.md5(t.encode()).hexdigest() for t in texts]
