import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from corrmatch.plans.arbiter import HttpArbiter, middle_out, score
from corrmatch.plans.correspond import compare, compare_folders
from corrmatch.sources.workspace import scan
from tests.core.test_engine import put


@pytest.fixture
def server():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append(body)
            self.send_response(400 if "think" in body else 200)
            self.end_headers()
            if "think" not in body:
                self.wfile.write(json.dumps({"response": "<think>3</think>88/100"}).encode())

        def log_message(self, *args):
            pass

    http = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", asked
    http.shutdown()


def test_answers_and_texts():
    assert [score(*x) for x in (("85", ""), ("<think>1", "7"), ("no", ""), ("", ""), ("9 of 10, so 400", ""))] == [85, 7, None, None, 100]
    assert middle_out("x" * 6000) == "x" * 6000 and len(middle_out("y" * 9000)) == 2400 + 2100 + 1460 + 50


def test_judge_over_http(spark, tmp_path, server):
    url, asked = server
    left, right = f"{tmp_path}/l", f"{tmp_path}/r"
    put(left, "a/f.txt", " ".join(f"w{k}" for k in range(40)))
    put(right, "b/f.txt", " ".join([f"w{k}" for k in range(14)] + [f"v{k}" for k in range(26)]))
    arbiter = HttpArbiter(url, "any")
    assert arbiter.available() and not HttpArbiter("http://127.0.0.1:9", "any").available()
    files = [{"filename": "f.txt", "text": t, "extension": ".txt", "text_encoding": "utf-8"} for t in ("one", "two")]
    result = compare_folders(spark, {"left_dir": left, "right_dir": right}, judge=lambda e: arbiter.ask(*files))
    (match,) = result.matches.collect()
    assert (match.match_type, match.similarity, result.calls) == ("llm_verified", 88.0, 1)
    assert [("think" in a) for a in asked] == [True, False] and "FILE A" in asked[0]["system"]
    assert HttpArbiter("http://127.0.0.1:9", "any").ask(*files) is None


def test_judge_of_files_reads_them_with_the_edges(spark, tmp_path, server):
    url, asked = server
    texts = [" ".join(f"w{k}" for k in range(40)), " ".join([f"w{k}" for k in range(14)] + [f"v{k}" for k in range(26)])]
    for i in range(3):
        put(f"{tmp_path}/l", f"a/f{i}.txt", texts[0].replace("w", f"w{i}x"))
        put(f"{tmp_path}/r", f"b/f{i}.txt", texts[1].replace("w", f"w{i}x").replace("v", f"v{i}x"))
    left, right = (scan(spark, f"{tmp_path}/{s}", s) for s in "lr")
    judge = HttpArbiter(url, "any").for_files(left, right)
    result = compare(left, right, judge=judge)
    assert sorted(r.match_type for r in result.matches.collect()) == ["llm_verified"] * 3 and result.calls == 3
    assert all(f"f{i}.txt" in "".join(a["prompt"] for a in asked) for i in range(3))
    assert HttpArbiter("http://127.0.0.1:9", "any").for_files(left, right) is None
