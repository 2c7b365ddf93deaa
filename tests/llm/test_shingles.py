import random

from corrmatch.llm import shingles


def test_words_of_blocks_are_the_words_of_texts(monkeypatch):
    rng = random.Random(1)
    chars = "aAbBzZ[@é日 \t\n\x0b\x0c\r\x1f\xa0\x85 "
    texts = ["".join(rng.choices(chars, k=rng.choice([0, 1, 5, 40, 400, 3000]))) for _ in range(120)] + ["x" * 5000, " ", ""]
    first = None
    for block in (1 << 20, 1000, 64):
        monkeypatch.setattr(shingles, "BLOCK", block)
        monkeypatch.setattr(shingles._Powers, "up", shingles._Powers.up[:0])
        h, text, line = shingles.hashed(texts)
        first = h if first is None else first
        assert (first == h).all()
        words = [(i, w) for i, t in enumerate(texts) for w in t.encode().lower().split()]
        assert text.tolist() == [i for i, _ in words]
        names = {}
        for (_, w), x in zip(words, h.tolist()):
            assert names.setdefault(x, w) == w
        assert len(names) == len({w for _, w in words})
        lines = [(i, j) for i, t in enumerate(texts) for j, x in enumerate(t.encode().split(b"\n")) for _ in x.split()]
        assert [a == b for a, b in zip(lines, lines[1:])] == [a == b for a, b in zip(line.tolist(), line.tolist()[1:])]
    sets = shingles.shingle_sets(texts)
    for t, s in zip(texts, sets):
        w = t.encode().lower().split()
        assert len(s) == len({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}) if w else len(s) == 0
        assert (s[1:] > s[:-1]).all()
