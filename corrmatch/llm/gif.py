"""GIF media columns: LZW decoding, palettes, disposal, transparency, frames.

``play`` reads any GIF87a/89a stream, frame by frame.  ``frames`` is the operator: one
row for each frame of a binary GIF column, with its timing, its composed picture and
its colour histogram.  ``encode_samples`` stores bytes losslessly as the 8-bit samples
of a GIF with 256 colours, the form in which ``op1_gif_media`` keeps each text; the
same reader takes it back: samples are the payload, pictures give the histogram.

Defined cases: a null GIF has no frames; a stream that is not a GIF, that ends early,
or whose screen has more than ``PIXELS`` pixels, gives one row with a null ``frame`` and
the reason in ``error``; an empty text is stored as one row of 64 zero samples; equal texts give equal rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import column, documents, per_batch, texts_of

WIDTH = 64
#: Rows of a frame: a longer payload becomes several timed frames.
FRAME_ROWS = 4096
DELAY_CS = 10
#: Largest screen that is composed (256 MiB): a header of a few bytes can ask for 17 GB.
PIXELS = 1 << 26


class GifError(ValueError):
    """A stream that cannot be decoded."""


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_cs: int
    disposal: int
    transparent: int | None
    indices: np.ndarray  # rows x columns, as stored
    picture: np.ndarray  # screen rows x columns x RGBA, as shown


def _offsets(bits: int, n: int) -> np.ndarray:
    """Bit offsets of the first n + 1 codes after a clear code.

    A reader's table has grown by one entry for each code but the first, so the
    width of the j-th code depends on j alone; 12 bits is the most.
    """
    size = (1 << bits) + 1 + np.maximum(np.arange(n), 1)
    width = np.minimum(np.floor(np.log2(size)).astype(np.int64) + 1, 12)
    return np.concatenate(([0], np.cumsum(width)))


_OFFSETS = {bits: _offsets(bits, 4097 - (1 << bits)) for bits in range(2, 9)}


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """LZW code stream of ``data``; the table is cleared whenever it is full."""
    clear = 1 << bits
    segments, codes, table, free = [], [], {}, clear + 2
    emit, find = codes.append, table.get
    rest = iter(data)
    prefix = next(rest, None)
    for c in rest:
        key = prefix << 8 | c
        known = find(key)
        if known is not None:
            prefix = known
            continue
        emit(prefix)
        table[key] = free
        free += 1
        prefix = c
        if free == 4096:
            emit(clear)
            segments.append(codes)
            codes, table, free = [], {}, clear + 2
            emit, find = codes.append, table.get
    if prefix is not None:
        emit(prefix)
    emit(clear + 1)
    segments.append(codes)
    # the stream starts with a clear code of the first width
    at, where, values = bits + 1, [np.zeros(1, np.int64)], [np.array([clear])]
    for codes in segments:
        off = _OFFSETS[bits]
        where.append(off[: len(codes)] + at)
        values.append(np.array(codes))
        at += int(off[len(codes)])
    pos, val = np.concatenate(where), np.concatenate(values)
    val <<= pos & 7
    pos >>= 3
    n = at + 7 >> 3
    out = sum(np.bincount(pos + k, val >> 8 * k & 255, n + 3) for k in range(3))
    return out.astype(np.uint8)[:n].tobytes()


def lzw_decode(data: bytes, bits: int, n_pixels: int) -> bytes:
    """Decode an LZW code stream, deferred clear codes included."""
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.int64)
    total = 8 * len(data)
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    first = _OFFSETS[bits]
    out, done, at = [], 0, 0
    while done < n_pixels:
        off = first + at
        if int(off[-1]) < total:  # a full table keeps 12-bit codes until a clear code
            off = np.concatenate((off, np.arange(off[-1] + 12, total + 1, 12)))
        off = off[: np.searchsorted(off, total, "right")]
        if len(off) < 2:
            raise GifError("the code stream ends early")
        start, wide = off[:-1], np.diff(off)
        byte = start >> 3
        codes = (raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16) >> (start & 7) & (1 << wide) - 1
        stop = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stop[0]) if len(stop) else len(codes)
        table = base.copy()
        grow, put, old = table.append, out.append, None
        size = len(table)
        for code in codes[:n].tolist():
            if code < size:
                new = table[code]
            elif code == size and old is not None:
                new = old + old[:1]
            else:
                raise GifError("a code is not in the table")
            put(new)
            done += len(new)
            if old is not None and size < 4096:
                grow(old + new[:1])
                size += 1
            old = new
        if not len(stop):
            break
        if int(codes[n]) == end:
            break
        at = int(off[n + 1])
    if done < n_pixels:
        raise GifError("the code stream ends early")
    return b"".join(out)[:n_pixels]


def _blocks(data: bytes) -> bytes:
    out = [bytes([len(x)]) + x for x in (data[i : i + 255] for i in range(0, len(data), 255))]
    return b"".join(out) + b"\0"


def _unblock(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise GifError("a block ends early")
        n = data[at]
        at += 1
        if not n:
            return b"".join(parts), at
        parts.append(data[at : at + n])
        at += n


#: Colours of the stored samples: three bits of red and of green, two of blue.
_COLOURS = bytes(x for i in range(256) for x in (i >> 5 << 5, (i >> 2 & 7) << 5, (i & 3) << 6))


def encode_samples(payload: bytes, width: int = WIDTH, rows: int = FRAME_ROWS) -> bytes:
    """A GIF whose samples are the bytes of ``payload``; each frame clears the one before.

    The length of ``payload`` is a positive multiple of ``width``.  At most
    ``rows`` rows make a frame, so the screen never exceeds GIF's 65,535 rows.
    """
    if not payload or len(payload) % width:
        raise ValueError("the payload must be a positive multiple of the width")
    step = width * rows
    height = min(rows, len(payload) // width)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), _COLOURS]
    for i in range(0, len(payload), step):
        part = payload[i : i + step]
        out += [
            b"\x21\xf9\x04", struct.pack("<BHBB", 2 << 2, DELAY_CS, 0, 0),
            b"\x2c", struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0),
            b"\x08", _blocks(lzw_encode(part)),
        ]
    return b"".join(out) + b"\x3b"


def _rows_of(indices: np.ndarray, interlaced: bool) -> np.ndarray:
    if not interlaced:
        return indices
    h = len(indices)
    order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, h, step)]
    out = np.empty_like(indices)
    out[order] = indices
    return out


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    """The colours of a palette as RGBA in one number each, and where it ends."""
    n = 2 << (flags & 7)
    if at + 3 * n > len(data):
        raise GifError("a palette ends early")
    rgba = np.full((n, 4), 255, np.uint8)
    rgba[:, :3] = np.frombuffer(data, np.uint8, 3 * n, at).reshape(-1, 3)
    return rgba.view(np.uint32).ravel(), at + 3 * n


def play(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF, each with the picture it shows, one at a time."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise GifError("not a GIF")
    sw, sh, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    if sw * sh > PIXELS:
        raise GifError("the screen is too large")
    palette, at = _palette(data, 13, flags) if flags & 0x80 else (None, 13)
    canvas = np.zeros((sh, sw), np.uint32)
    delay, disposal, clear_index = 0, 0, None
    while at < len(data):
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at] if at < len(data) else 0
            body, at = _unblock(data, at + 1)
            if label == 0xF9 and len(body) >= 4:
                packed, delay, index = struct.unpack_from("<BHB", body)
                disposal, clear_index = packed >> 2 & 7, index if packed & 1 else None
            continue
        if kind != 0x2C or at + 9 > len(data):
            raise GifError("an unknown block")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at)
        colours, at = _palette(data, at + 9, packed) if packed & 0x80 else (palette, at + 9)
        if at >= len(data) or not 2 <= data[at] <= 8:
            raise GifError("a code size out of range")
        bits = data[at]
        body, at = _unblock(data, at + 1)
        indices = np.frombuffer(lzw_decode(body, bits, w * h), np.uint8).reshape(h, w)
        indices = _rows_of(indices, bool(packed & 0x40))
        if colours is None:
            raise GifError("no palette")
        if indices.size and int(indices.max()) >= len(colours):
            raise GifError("a sample outside the palette")
        before = canvas.copy() if disposal == 3 else None
        seen = indices[: max(0, sh - top), : max(0, sw - left)]
        area = canvas[top : top + h, left : left + w]
        if clear_index is None:
            area[:] = colours[seen]
        else:
            np.copyto(area, colours[seen], where=seen != clear_index)
        picture = canvas.copy().view(np.uint8).reshape(sh, sw, 4)
        if disposal == 2:
            area[:] = 0
        elif disposal == 3:
            canvas = before
        yield Frame(left, top, w, h, delay, disposal, clear_index, indices, picture)
        delay, disposal, clear_index = 0, 0, None
    raise GifError("no trailer")


def decode(data: bytes) -> list[Frame]:
    """All frames of a GIF."""
    return list(play(data))


def histogram(picture: np.ndarray) -> np.ndarray:
    """Counts of the visible pixels in 4 x 4 x 4 colour cells (red, green, blue)."""
    red, green, blue, shown = (picture[..., i] for i in range(4))
    cell = (red >> 2 & 48) | (green >> 4 & 12) | blue >> 6
    return np.bincount(cell[shown > 0], minlength=64)


FRAMES = "key long, frame int, at_ms long, delay_ms long, width int, height int, disposal int, transparent int, rgba binary, histogram string, error string"


def frames(df: DataFrame, key: str, media: str) -> DataFrame:
    """One row for each frame of the GIF in column ``media``; see the module."""

    def rows(batch: pa.RecordBatch) -> dict:
        out = {n.split()[0]: [] for n in FRAMES.split(", ")}

        def add(*values):
            for col, v in zip(out.values(), values):
                col.append(v)

        for k, data in zip(column(batch, key).to_pylist(), column(batch, media).to_pylist()):
            if data is None:
                continue
            try:
                at = 0
                for i, f in enumerate(decode(data)):
                    h, w = f.picture.shape[:2]
                    add(k, i, at, 10 * f.delay_cs, w, h, f.disposal, f.transparent, f.picture.tobytes(), ",".join(map(str, histogram(f.picture))), None)
                    at += 10 * f.delay_cs
            except GifError as e:
                add(k, *[None] * 9, str(e))
        return out

    return per_batch(df.select(key, media), rows, FRAMES)


def payload_of(text: str) -> bytes:
    """UTF-8 with zero bytes appended up to a positive multiple of 64."""
    data = text.encode()
    return data + bytes(-len(data) % WIDTH or (0 if data else WIDTH))


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, duration_ms long"


def store(docs: DataFrame) -> DataFrame:
    """Keep each text as a GIF, read the stored bytes back and describe them.

    ``feature`` is the colour histogram of all the frames as shown, in shares of 1/10,000.
    """

    def rows(batch: pa.RecordBatch) -> dict:
        out = {n.split()[0]: [] for n in STORED.split(", ")}
        for doc_id, text in zip(column(batch, "doc_id").to_pylist(), texts_of(batch)):
            media = encode_samples(payload_of(text))
            digest, tail, n, at, count, colours = hashlib.sha256(), b"", 0, 0, 0, np.zeros(64, np.int64)
            for f in play(media):
                part = f.indices.tobytes()
                digest.update(part)
                tail, n, at, count = (tail + part)[-64:], n + len(part), at + 10 * f.delay_cs, count + 1
                colours += histogram(f.picture)
            values = (
                doc_id, len(text.encode()), n, digest.hexdigest(), zlib.crc32(tail),
                len(media), hashlib.sha256(media).hexdigest(), ".".join(f"{x:x}" for x in (colours * 10_000 // colours.sum()).tolist()), count, at,
            )
            for col, v in zip(out.values(), values):
                col.append(v)
        return out

    return per_batch(docs.select("doc_id", "text"), rows, STORED)


def op1_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(documents(spark, sf_dir))
