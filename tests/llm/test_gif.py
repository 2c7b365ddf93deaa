import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from corrmatch.llm import gif


@pytest.mark.parametrize("data", [bytes(64), bytes(range(256)) * 64, b"ab" * 32 * 4000, random.Random(3).randbytes(64 * 9000)])
def test_samples_come_back(data):
    media = gif.encode_samples(data)
    assert b"".join(f.indices.tobytes() for f in gif.decode(media)) == data


def slow_codes(data, bits):
    """A plain reader of one code at a time, the table of the LZW papers."""
    value, at, clear = int.from_bytes(data, "little"), 0, 1 << bits
    wide, table, old, out = bits + 1, None, None, b""
    while True:
        code = value >> at & (1 << wide) - 1
        at += wide
        if code == clear:
            wide, table, old = bits + 1, {i: bytes([i]) for i in range(clear)}, None
            free = clear + 2
            continue
        if code == clear + 1:
            return out
        new = table[code] if code in table else old + old[:1]
        out += new
        if old is not None and free < 4096:
            table[free] = old + new[:1]
            free += 1
            if free == 1 << wide and wide < 12:
                wide += 1
        old = new


@pytest.mark.parametrize("bits", [2, 4, 8])
def test_codes_agree_with_a_plain_reader(bits):
    data = bytes(random.Random(bits).choices(range(1 << bits), k=30_000))
    code = gif.lzw_encode(data, bits)
    assert slow_codes(code, bits) == data == gif.lzw_decode(code, bits, len(data))


def two_frames(disposal):
    def image(left, top, w, h, pixels, palette=b""):
        flags = 0x81 if palette else 0
        return b"\x2c" + struct.pack("<HHHHB", left, top, w, h, flags) + palette + b"\x02" + gif._blocks(gif.lzw_encode(pixels, 2))

    def control(delay, disposal, index=None):
        return b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (index is not None), delay, index or 0, 0)

    colours = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    return (
        b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x81, 0, 0) + colours + b"\x21\xfe\x02hi\0" + control(5, 1) + image(0, 0, 2, 2, b"\1\1\1\1")
        + control(7, disposal, 0) + image(0, 0, 2, 1, b"\0\2") + control(9, 0) + image(1, 1, 1, 1, b"\3", colours) + b"\x3b"
    )


@pytest.mark.parametrize(("disposal", "corner"), [(1, [0, 255, 0, 255]), (2, [0, 0, 0, 0]), (3, [255, 0, 0, 255])])
def test_palette_disposal_and_transparency(disposal, corner):
    a, b, c = gif.decode(two_frames(disposal))
    assert [f.delay_cs for f in (a, b, c)] == [5, 7, 9] and b.transparent == 0
    assert b.picture[0].tolist() == [[255, 0, 0, 255], [0, 255, 0, 255]]
    assert c.picture[0, 1].tolist() == corner and c.picture[1, 1].tolist() == [0, 0, 255, 255]


def test_interlace():
    rows = np.arange(16, dtype=np.uint8).reshape(16, 1)
    order = [*range(0, 16, 8), *range(4, 16, 8), *range(2, 16, 4), *range(1, 16, 2)]
    assert (gif._rows_of(rows[order], True) == rows).all()


def test_frames_of_a_column(spark):
    rows = [(1, two_frames(1)), (2, None), (3, b"no gif"), (4, two_frames(1)[:-30])]
    got = gif.frames(spark.createDataFrame(rows, "id long, media binary"), "id", "media").collect()
    assert [(r.key, r.frame, r.at_ms, r.delay_ms) for r in got if r.error is None] == [(1, 0, 0, 50), (1, 1, 50, 70), (1, 2, 120, 90)]
    assert sorted(r.key for r in got if r.error) == [3, 4]
    assert sum(map(int, got[0].histogram.split(","))) == 4


def test_broken_streams_are_errors():
    whole = two_frames(2)
    rng = random.Random(9)
    for n in range(len(whole)):  # cut anywhere, palettes and codes included
        with pytest.raises(gif.GifError):
            gif.decode(whole[:n])
    for _ in range(2000):
        data = bytearray(whole)
        for _ in range(rng.randrange(1, 4)):
            data[rng.randrange(6, len(data))] = rng.randrange(256)
        try:
            gif.decode(bytes(data))
        except gif.GifError:
            pass
    with pytest.raises(gif.GifError, match="too large"):
        gif.decode(whole[:6] + struct.pack("<HH", 65535, 65535) + whole[10:])


def test_feature_is_the_histogram_of_the_pictures(spark, tmp_path):
    spark.createDataFrame([(1, "aAz ~"), (2, "x" * 300_000)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in gif.op1_gif_media(spark, str(tmp_path)).collect():
        payload = gif.payload_of("aAz ~" if r.doc_id == 1 else "x" * 300_000)
        counts = [0] * 64
        for b in payload:
            counts[(b >> 6) * 16 + (b >> 3 & 3) * 4 + (b & 3)] += 1
        assert r.feature == ".".join(f"{x * 10_000 // len(payload):x}" for x in counts)


def test_query(spark, tmp_path):
    long = "wörd " * 60_000
    rows = [(1, "a", 1), (2, None, 2), (3, "", 3), (4, long, 4), (5, "a", 5), (5, "a", 5), (6, "x" * 64, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, media int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in gif.op1_gif_media(spark, str(tmp_path)).collect()}
    for doc_id, text, _ in rows:
        data = (text or "").encode()
        payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        r = got[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert got[4].n_frames > 1 and got[2][1:] == got[3][1:] and got[1][1:] == got[5][1:]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert gif.op1_gif_media(spark, str(tmp_path)).count() == 0
