"""Whole comparisons of folders."""

import os
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corrmatch.config import Settings
from corrmatch.functions import similarity
from corrmatch.operators import diff, lineage, report, resolve
from corrmatch.plans.correspond import compare_folders


def put(root, name, data):
    path = Path(root) / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data if isinstance(data, bytes) else data.encode())


def named(result):
    rows = report.by_left_name(result.sections()).collect()
    return rows, {r.section: [x for x in rows if x.section == r.section] for r in rows}


SHOP = """package old.shop;
/** Sells things. */
public class Basket {
    private int items;
    public void add(int n) { items += n; } // more
    public int count() { return items; }
    public String label() { return "basket"; }
}
"""
CLOCK = "package old.time;\npublic class Clock {\n    public long now() { return System.nanoTime(); }\n    public long since(long t) { return now() - t; }\n}\n"
MAIL = "package old.mail;\npublic class Mailer {\n    public void send(String to) { connect(to); write(to); close(); }\n    private void connect(String h) { open(h); }\n}\n"


def test_a_migration_without_an_arbiter(spark, tmp_path):
    left, right = f"{tmp_path}/l", f"{tmp_path}/r"
    put(left, "shop/Basket.java", SHOP)
    put(right, "src/main/shop/Basket.java", SHOP.replace("/** Sells things. */", "// sells many things"))
    put(left, "time/Clock.java", CLOCK)
    put(right, "src/main/time/Clock.java", CLOCK)
    put(left, "mail/Mailer.java", MAIL)
    edited = MAIL.replace("write(to); ", "log(to); write(to); ").replace("Mailer", "MailSender")
    put(right, "src/main/net/Outgoing.java", edited)
    put(left, "util/Strings.java", CLOCK.replace("Clock", "Strings") * 4)
    put(right, "src/main/util/TextTools.java", CLOCK.replace("Clock", "Strings") * 4)
    put(left, "legacy/Printer.txt", "nothing like the others, in words")
    put(right, "api/Board.html", "<p>" + "<b>altogether</b> other things " * 30 + "</p>")
    result = compare_folders(spark, {"left_dir": left, "right_dir": right})
    _, by = named(result)
    f = lambda t: dict(zip(("form", "tokens", "ids"), similarity.features(t, ".java"))) | {"filled": True}
    got = [(r.l_filename, r.r_filename, r.phase, r.match_type, r.similarity, r.content_status) for r in by["matched"]]
    assert got == [
        ("Basket.java", "Basket.java", "2", "deterministic", 100.0, "minor"),
        ("Clock.java", "Clock.java", "2", "deterministic", 100.0, "identical"),
        ("Mailer.java", "Outgoing.java", "3b", "content", similarity.score(f(MAIL), f(edited)), "different"),
        ("Strings.java", "TextTools.java", "3b", "content", 100.0, "identical"),
    ]
    assert [r.l_filename for r in by["unmatched_left"]] == ["Printer.txt"]
    assert [r.r_filename for r in by["unmatched_right"]] == ["Board.html"]
    assert [r.l_filename for r in by["ignored_left"]] == [".", ".."]
    stats = result.stats()
    assert (stats["total_left"], stats["comparable_left"], stats["ignored_left"], stats["deterministic_matches"], stats["exact_path_matches"]) == (7, 5, 2, 4, 0)


SUFFIXES = ["dat", "bin", "dll", "xyz", "jar", "o", "lib", "pak", "img", "rom"]
TEXTS = ["cfg", "ini", "md", "txt", "csv", "json", "yaml", "toml", "sh", "sql", "html", "xml", "css", "lua", "weird"]


def synthetic(left, right):
    """118 files on either side, in the groups of the acceptance data set."""
    for i in range(20):
        both(left, right, f"src/exact{i}.py", f"def exact_{i}():\n    return {i}\n")
    for i in range(5):
        both(left, right, f"img/p{i}.png", b"\x89PNG\r\n\x1a\n\0\0" + bytes([i]))
    for i, s in enumerate(SUFFIXES):
        both(left, right, f"art/a{i}.{s}", b"\0\1\2\3" * 9 + bytes([i]))
    for i in range(10):
        put(left, f"only/left_{i}.py", f"class Left{i}:\n    def alpha_{i}(self):\n        return 'l{i}'\n")
        put(right, f"other/right_{i}.rs", "\n".join(f"pub fn beta_{i}_{k}() -> u64 {{ {k} * {i} + 7 }}" for k in range(12)))
    for s in TEXTS:
        for k in range(2):
            text = f"kind {s} number {k}\nsecond line of {s}\n"
            put(left, f"text/f{k}.{s}", text.replace("\n", "\r\n"))
            put(right, f"text/f{k}.{s}", text)
    put(left, "enc/u.txt", "Größe über Straße\n".encode("utf-16"))
    put(right, "enc/u.txt", "Größe über Straße\n")
    put(left, "enc/c.txt", "naïve café\n".encode("cp1252"))
    put(right, "enc/c.txt", "naïve café\n")
    body = "package a.b;\npublic class Moved {\n  int count;\n  void run() { count++; }\n}\n" * 3
    put(left, "x/Moved.java", body)
    put(right, "y/Renamed_completely.kt", body)
    for i in range(15):
        both(left, right, f"b/f{i}.blocked.java", f"class B{i} {{}}")
    for i in range(10):
        both(left, right, f"excluded_dir/deep/e{i}.txt", f"e{i}")
    for i in range(8):
        both(left, right, f".ghost/g{i}.txt", f"g{i}")
    for i in range(7):
        put(left, f"plain/N{i}", f"no extension {i}\r\nend\r\n")
        put(right, f"plain/N{i}", f"no extension {i}\nend\n")


def both(left, right, name, data):
    put(left, name, data)
    put(right, name, data)


def test_acceptance_counts(spark, tmp_path):
    left, right = f"{tmp_path}/l", f"{tmp_path}/r"
    synthetic(left, right)
    result = compare_folders(
        spark, {"left_dir": left, "right_dir": right, "settings": {"max_llm_per_file": 0}, "exclusions": {"files": ["*.blocked.java"], "dirs": ["excluded_dir", ".ghost"] + [f"scroll_{i}" for i in range(35)]}}
    )
    rows, by = named(result)
    assert {k: len(v) for k, v in by.items()} == {"matched": 75, "unmatched_left": 10, "unmatched_right": 10, "ignored_left": 35, "ignored_right": 35}
    stats = result.stats()
    assert stats["total_left"] == stats["total_right"] == 120
    assert (stats["exact_path_matches"], stats["binary_matches"], stats["deterministic_matches"]) == (74, 15, 1)
    assert all(r.content_status == "identical" for r in by["matched"])
    moved = [(r.l_filename, r.r_filename) for r in by["matched"] if r.match_type == "content"]
    assert moved == [("Moved.java", "Renamed_completely.kt")]
    assert {r.l_ignored_reason for r in by["ignored_left"]} == {"Directory alias (not a file)", "Excluded directory pattern", "Excluded file pattern"}
    assert resolve.one_to_one(result.matches)
    assert report.with_extension(result.sections(), ".kt").count() == 1
    assert report.with_extension(result.sections(), report.NO_EXTENSION).count() >= 7
    assert report.shown(result.sections(), False).count() == 95
    assert report.to_json(result.sections()).where("json like '%\"name\":\"Moved.java\"%'").count() == 1


def test_binaries_take_equal_bytes_first_then_the_nearer_folder(spark, tmp_path):
    left, right = f"{tmp_path}/l", f"{tmp_path}/r"
    put(left, "a/b/x.bin", b"\0\1" * 50)
    put(right, "z/x.bin", b"\0\1" * 50)
    put(right, "a/c/x.bin", b"\0\2" * 50)
    put(left, "q/y.bin", b"\0y")
    put(right, "far/away/y.bin", b"\0z1")
    put(right, "q/r/y.bin", b"\0z2")
    rows = {r.l_filename: r for r in compare_folders(spark, {"left_dir": left, "right_dir": right}).sections().where("section = 'matched'").collect()}
    assert (rows["x.bin"].r_relative_dir, rows["x.bin"].similarity, rows["x.bin"].content_status) == ("z", 100.0, "identical")
    assert (rows["y.bin"].r_relative_dir, rows["y.bin"].content_status) == ("q/r", "different")


def test_zero_budget_drops_the_fallback_but_a_missing_arbiter_keeps_it(spark, tmp_path):
    left, right = f"{tmp_path}/l", f"{tmp_path}/r"
    words = [f"w{i}" for i in range(40)]
    put(left, "a/f.txt", " ".join(words))
    put(right, "b/f.txt", " ".join(words[:20] + [f"v{i}" for i in range(20)]))
    ask = {"left_dir": left, "right_dir": right}
    (match,) = compare_folders(spark, ask).matches.collect()
    assert (match.phase, match.similarity) == ("2", 50.0)
    assert compare_folders(spark, ask | {"settings": {"max_llm_per_file": 0}}).matches.count() == 0


def test_arbiter_budget_and_breaker(spark, tmp_path):
    left, right = f"{tmp_path}/l", f"{tmp_path}/r"
    for i in range(6):
        put(left, f"a/f{i}.txt", " ".join(f"w{k}_{i}" for k in range(40)))
        put(right, f"b/f{i}.txt", " ".join([f"w{k}_{i}" for k in range(14)] + [f"v{k}_{i}" for k in range(26)]))
    ask = {"left_dir": left, "right_dir": right}
    calls = []

    def judge(edge):
        calls.append(edge)
        return 90 if len(calls) < 3 else None

    result = compare_folders(spark, ask, judge=judge)
    assert result.matches.where("match_type = 'llm_verified'").count() == 2
    assert len(calls) == 2 + Settings().llm_failure_limit == result.calls


def test_unreadable_requests(spark, tmp_path):
    for body in ({}, {"left_dir": str(tmp_path)}, [], {"left_dir": f"{tmp_path}/no", "right_dir": str(tmp_path)}):
        with pytest.raises(Exception, match="required|must be|not found"):
            compare_folders(spark, body)


def test_empty_folders(spark, tmp_path):
    os.makedirs(tmp_path / "l")
    os.makedirs(tmp_path / "r")
    result = compare_folders(spark, {"left_dir": str(tmp_path / "l"), "right_dir": str(tmp_path / "r")})
    assert result.sections().count() == 4 and result.sections().where(F.col("section").startswith("ignored")).count() == 4


def test_tied_files_of_one_name_need_no_rounds(spark):
    n = 400
    edges = spark.range(n).selectExpr("id AS l_ord").crossJoin(spark.range(n).selectExpr("id AS r_ord")).selectExpr("l_ord", "r_ord", "1.0D AS score", "'f' AS filename")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("tied", "tied")
    got = resolve.greedy(edges, "score", group="filename").collect()
    assert sorted((r.l_ord, r.r_ord) for r in got) == [(i, i) for i in range(n)]
    assert len(tracker.getJobIdsForGroup("tied")) <= 6
    spark.sparkContext.setJobGroup("other", "other")


def test_greedy_agrees_with_a_plain_loop(spark):
    rng = random.Random(4)
    rows = [(left, right, rng.choice([1.0, 2.0, 3.0])) for left in range(60) for right in rng.sample(range(60), rng.randrange(0, 5))]
    used, expected = set(), set()
    for left in range(60):
        for _, right in sorted((-s, r) for x, r, s in rows if x == left):
            if right not in used:
                used.add(right)
                expected.add((left, right))
                break
    edges = spark.createDataFrame(rows, "l_ord long, r_ord long, score double").repartition(5)
    assert {(r.l_ord, r.r_ord) for r in resolve.greedy(edges, "score").collect()} == expected
    assert resolve.greedy(edges.where("false"), "score").collect() == []


def test_search_folds_accents_on_both_sides(spark):
    rows = spark.createDataFrame([(1, "Straße Über Řeka"), (2, "strasse uber"), (3, None), (4, "ŠKODA çelik")], "id int, name string")
    found = lambda q: {r.id for r in report.search(rows, q, "name").collect()}
    assert found("über reka") == {1} and found("UBER") == {1, 2} and found("škoda") == found("skoda") == {4} and found("Çelik") == {4}
    assert found(" ") == {1, 2, 3, 4}


def test_lines_end_as_they_do_in_python(spark):
    texts = ["a\x0bb\nc\n", "", "\n", "x", "a\r\nb\rc\x85d e f\x1cg\x1dh\x1ei\x0cj", "\r\n\r\n"]
    rows = diff.lines(spark.createDataFrame(list(enumerate(texts)), "ord int, text string")).collect()
    assert {i: [r.text for r in sorted(rows, key=lambda r: r.line) if r.ord == i] for i in range(len(texts))} == {i: t.splitlines() for i, t in enumerate(texts)}


def test_filters_reject_unknown_modes(spark):
    with pytest.raises(ValueError, match="unknown filter"):
        diff.filtered(spark.range(1), "some")


def test_numbers_follow_the_keys(spark):
    names = [f"{a}/{b}" for a in "xyz" for b in range(30)]
    rows = lineage.numbered(spark.createDataFrame([(n,) for n in reversed(names)], "path string").repartition(7), "ord", "path").collect()
    assert [r.path for r in sorted(rows, key=lambda r: r.ord)] == sorted(names) and {r.ord for r in rows} == set(range(90))
    assert lineage.numbered(spark.createDataFrame([], "path string"), "ord", "path").collect() == []


def test_a_shared_folder_must_be_named_on_a_cluster():
    class Unset:
        def __getattr__(self, name):
            return lambda *a: self

        def isEmpty(self):
            return True

        def get(self, name=None):
            return None

    context = Unset()
    context.master, session = "spark://host:7077", Unset()
    session.sparkContext = context
    context._jsc = Unset()
    with pytest.raises(ValueError, match="checkpoint.dir"):
        lineage.shared_folder(session)
