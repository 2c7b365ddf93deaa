"""An arbiter behind HTTP: a text model that answers with a percentage.

``HttpArbiter`` posts a prompt for a pair of texts and reads the score from the answer;
``for_files`` makes it a judge of edges.  Every failure is None, which the breaker counts.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import profile
from ..functions.text import middle_out_of as middle_out
from ..functions.text import score_of as score

# Limits of a request.
PROBE_SECONDS, SECONDS, TEMPERATURE, TOKENS, LIMIT = 3, 120, 0.05, 256, 6000
PROMPT = """Two files come from two versions of a project, which may have been renamed, moved or migrated.
Say how likely they are the same logical component: purpose, logic, interface, names and role count;
packages, imports, build files, white space, comments and logging do not.
90-100: the same with small edits. 70-89: the same, much modified. 40-69: related. 0-39: different.

FILE A: {a}
{left}

FILE B: {b}
{right}

Answer with a single integer from 0 to 100."""


@dataclass
class HttpArbiter:
    base: str
    model: str
    path: str = "/api/generate"
    think: bool = field(default=True)  # whether the server is told not to think

    def available(self) -> bool:
        try:
            with urllib.request.urlopen(self.base, timeout=PROBE_SECONDS) as r:
                return r.status == 200
        except (OSError, ValueError):
            return False

    def _post(self, body: dict) -> dict:
        request = urllib.request.Request(self.base + self.path, json.dumps(body).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=SECONDS) as r:
            return json.load(r)

    def ask(self, a: dict, b: dict) -> int | None:
        """The percentage for two files (filename, text, text_encoding, extension)."""
        lines = [profile.prompt_line(s, *profile.language_of(f["text"], f["extension"]), f["extension"], f["text_encoding"]) for s, f in (("A", a), ("B", b))]
        body = {
            "model": self.model, "system": profile.system_prompt(*lines), "stream": False, "options": {"temperature": TEMPERATURE, "num_predict": TOKENS},
            "prompt": PROMPT.format(a=a["filename"], b=b["filename"], left=middle_out(a["text"], LIMIT), right=middle_out(b["text"], LIMIT)),
        }
        try:
            try:
                got = self._post(body | ({"think": False} if self.think else {}))
            except urllib.error.HTTPError as e:
                if e.code != 400 or not self.think:
                    return None
                self.think = False  # an older server: it does not know the option
                got = self._post(body)
            return score(got.get("response", ""), got.get("thinking", ""))
        except (OSError, ValueError, AttributeError):
            return None

    def for_files(self, left: DataFrame, right: DataFrame):
        """A judge of edges between two tables of files, or None if nobody answers.

        What it reads of the files is joined to the edges, by ``prepare``, before they come
        to the driver.
        """
        if not self.available():
            return None

        about = ("filename", "text", "text_encoding", "extension")

        def with_files(edges: DataFrame) -> DataFrame:
            for side, files in (("l", left), ("r", right)):
                edges = edges.join(files.select(F.col("ord").alias(f"{side}_ord"), F.struct(*about).alias(f"{side}_file")), f"{side}_ord")
            return edges

        def judge(edge: dict) -> int | None:
            return self.ask(edge["l_file"].asDict(), edge["r_file"].asDict())

        judge.prepare = with_files
        return judge
