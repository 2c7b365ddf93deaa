"""Words and word shingles of whole texts as 64-bit hashes, many texts at a time.

Words are ``[^\\x20\\x09-\\x0D]+`` of the UTF-8 text with A-Z in lower case.  The hash of a
word is a polynomial of its bytes modulo 2^64: terms of all bytes of a block are made
at once and summed word by word, so no word becomes a Python object.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SIZE = 5
#: Bytes of a block; longer texts are cut at white space.
BLOCK = 1 << 20
_U = np.uint64
_A = _U(0x9E3779B97F4A7C15)
_P = 0x2545F4914F6CDD1D  # odd, so it has an inverse
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_VALUE = mix(np.arange(1, 257, dtype=_U) * _A)
_VALUE[65:91] = _VALUE[97:123]
_VALUE[_SPACE] = 0


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


class _Powers:
    """Powers of the base and of its inverse, made once in each worker."""

    up = down = np.zeros(0, _U)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) >= n:
            return cls.up, cls.down
        size = max(n, BLOCK + (BLOCK >> 2))
        up, down = _powers(_P, size), _powers(pow(_P, -1, 1 << 64), size)
        if size <= 8 * BLOCK:
            cls.up, cls.down = up, down
        return up, down


def _block(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, lines before) of each word of a block."""
    raw = np.frombuffer(data, np.uint8)
    space = _SPACE[raw]
    start = np.flatnonzero(np.concatenate(([True], space[:-1])) & ~space) if len(raw) else np.zeros(0, np.int64)
    if not len(start):
        return np.zeros(0, _U), start, start
    up, down = _Powers.of(len(raw))
    h = np.add.reduceat(_VALUE[raw] * up[: len(raw)], start) * down[start]
    return mix(h), start, np.searchsorted(np.flatnonzero(raw == 10), start)


def _cuts(data: bytes) -> Iterator[bytes]:
    """Pieces of at most about a block, cut at white space."""
    at = 0
    while len(data) - at > BLOCK:
        raw = _SPACE[np.frombuffer(data, np.uint8, min(BLOCK, len(data) - at), at)]
        cut = np.flatnonzero(raw)
        if len(cut):
            end = at + int(cut[-1]) + 1
        else:  # a word of more than a block
            end = at + BLOCK
            while end < len(data) and not _SPACE[data[end]]:
                end += 1
        yield data[at:end]
        at = end
    yield data[at:]


def hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text, line) of each word; line numbers grow and differ between texts."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    part: list[bytes] = []
    state = [0, 0, 0]  # bytes waiting, text of the first of them, lines so far

    def flush(next_text: int) -> None:
        if part:
            data = b"\n".join(part) + b"\n"
            h, start, line = _block(data)
            ends = np.cumsum([len(x) + 1 for x in part])
            out.append((h, state[1] + np.searchsorted(ends, start, "right"), state[2] + line))
            state[2] += data.count(b"\n")
        part.clear()
        state[:2] = 0, next_text

    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass")
        if state[0] + len(data) > BLOCK:
            flush(i)
        if len(data) > BLOCK:
            for piece in _cuts(data):
                h, start, line = _block(piece)
                out.append((h, np.full(len(h), i), state[2] + line))
                state[2] += piece.count(b"\n")
            state[1], state[2] = i + 1, state[2] + 1
            continue
        part.append(data)
        state[0] += len(data) + 1
    flush(len(texts))
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate([np.zeros(0, k), *x]) for k, x in zip((_U, np.int64, np.int64), zip(*out) if out else (none,) * 3)) if out else (np.zeros(0, _U), none, none)


def joined(h: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Hashes of all runs of ``size`` words, in order."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    out = h[:n].copy()
    for i in range(1, size):
        out *= _A
        out += h[i : n + i]
    return mix(out)


def shingle_sets(texts: list[str], size: int = SIZE) -> list[np.ndarray]:
    """The sorted distinct shingles of each text.

    A text of fewer words is one shingle, a text without words the empty set.
    """
    h, text, _ = hashed(texts)
    words = np.bincount(text, minlength=len(texts))
    all_ = joined(h, size)
    mine = text[: len(all_)]
    all_ = all_[mine == text[len(text) - len(all_) :]] if len(all_) else all_
    ends = np.cumsum(np.maximum(0, words - size + 1))
    first = np.cumsum(words) - words
    out = []
    at = 0
    for i, end in enumerate(ends.tolist()):
        if end > at:
            s = all_[at:end]
            s.sort()
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        else:
            out.append(joined(h[first[i] : first[i] + words[i]], max(1, int(words[i]))))
        at = end
    return out


def intersection(a: np.ndarray, b: np.ndarray) -> int:
    both = np.concatenate((a, b))
    both.sort()
    return int(np.count_nonzero(both[1:] == both[:-1]))
