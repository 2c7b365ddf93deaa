"""Token ids of whole texts by the public word-level BPE file.

``Encoder.ids`` gives the ids that the ``tokenizers`` library gives, several times
faster: the pieces that it cuts texts into repeat, and the ids of a piece do not depend
on its neighbours, so a bounded table keeps them and only new pieces go to the library.
The table has two halves: when the newer one is full it becomes the older one, from
which pieces that are met again come back.
Texts with characters outside printable Latin-1 or with a special token's string go
to the library whole, as its normaliser looks across words there.
"""

from __future__ import annotations

import codecs
import os
import re

import numpy as np

#: Pieces whose ids a worker keeps in either half of its table.
KEEP = 600_000
END = 0
_PLAIN = bytes([*range(9, 14), *range(32, 127), *range(160, 256)])
# the file's own way of cutting words, for lower-case Latin-1
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+")


def _byte_level() -> str:
    """The byte-level form of each byte, white space aside.

    Bytes that print stand for themselves, the others for U+0100 and up in order.
    """
    shown = {32, *range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter([*range(256, 288), *range(289, 512)])
    return "".join(chr(b if b in shown else next(rest)) for b in range(256))


_FORM = _byte_level()


def _odd(text: str) -> bool:
    try:
        return bool(text.encode("latin-1").translate(None, _PLAIN)) or "<|" in text
    except UnicodeEncodeError:
        return True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.model = Tokenizer.from_file(path)
        # pieces are cut and in byte-level form already: only the merges are left to do
        self.merges = Tokenizer.from_file(path)
        self.merges.normalizer = None
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> None:
        """Add the ids of new pieces to the table."""
        for at in range(0, len(pieces), 256):
            part = pieces[at : at + 256]
            got = self.merges.encode(codecs.charmap_decode(" ".join(part).encode(), "strict", _FORM)[0], add_special_tokens=False)
            raw, ends = np.array(got.ids, "<u4").tobytes(), (np.cumsum(np.bincount(np.array(got.word_ids), minlength=len(part))) * 4).tolist()
            self.known.update(zip(part, map(raw.__getitem__, map(slice, [0, *ends], ends))))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        out = []
        for at in range(0, len(texts), 256):
            part = texts[at : at + 256]
            if len(self.known) > KEEP:
                self.known, self.older = {}, self.known
            known, older = self.known, self.older
            whole = {i: np.array(self.model.encode(t, add_special_tokens=False).ids, "<u4") for i, t in enumerate(part) if _odd(t)}
            split = [() if i in whole else _PIECE.findall(t.lower()) for i, t in enumerate(part)]
            new = set().union(*split).difference(known)
            if again := [p for p in new if p in older]:
                known.update((p, older[p]) for p in again)
                new.difference_update(again)
            if new:
                self._learn(list(new))
            out += [whole[i] if i in whole else np.frombuffer(b"".join(map(known.__getitem__, cut)), "<u4") for i, cut in enumerate(split)]
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
