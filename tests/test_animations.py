"""Animation files: the dictionary coder, disposal, sequence chunks, hostile files."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from framequarry.sources import animations as A
from framequarry.sources import codecs as K

R, G, B, Y = (np.int32(x - (1 << 32)) for x in (0xFFFF0000, 0xFF00FF00, 0xFF0000FF, 0xFFFFFF00))


@pytest.mark.parametrize("colours", [1, 2, 7, 256])
@pytest.mark.parametrize("n", [1, 2, 3, 255, 5000, 70001])
def test_codes_round_trip(n, colours):
    x = np.random.default_rng(n).integers(0, colours, n).astype(np.uint8).tobytes()
    assert A.lzw_unpacked(A.lzw_packed(x), n, 8) == x


def test_narrow_codes_by_hand():
    """0 1 1 1 with codes of 3 bits: clear, 0, 1, 6 (= 1 1), end; known once 1 has been read twice."""
    codes = [(4, 3), (0, 3), (1, 3), (7, 3), (5, 4)]
    bits = "".join(f"{c:0{w}b}"[::-1] for c, w in codes)
    data = bytes(int(bits[i : i + 8].ljust(8, "0")[::-1], 2) for i in range(0, len(bits), 8))
    assert A.lzw_unpacked(data, 4, 2) == bytes([0, 1, 1, 1])


def gif(*images: bytes, w: int = 4, h: int = 2, colours=(R, G, B, Y)) -> bytes:
    return struct.pack("<6sHHBBB", b"GIF89a", w, h, 0xF7, 0, 0) + A._table(np.array(colours)) + b"".join(images) + b"\x3b"


def whole(v) -> np.ndarray:
    return np.full((2, 4), v, np.int32)


def test_disposal():
    table = np.array([R, G, B, Y])
    files = gif(A.gif_image(whole(R), table, 100, disposal=1), A.gif_image(whole(G), table, 0, (1, 0, 2, 1), 3), A.gif_image(whole(B), table, 30, (0, 1, 4, 1), 2), A.gif_image(whole(Y), table, 40, (0, 0, 1, 1), 0))
    found = list(A.gif_frames(files))
    assert [d for _, d in found] == [100, 20, 30, 40]
    px = [p.tolist() for p, _ in found]
    assert px[0] == [[R] * 4] * 2
    assert px[1] == [[R, G, G, R], [R] * 4]
    assert px[2] == [[R] * 4, [B] * 4]
    assert px[3] == [[Y, R, R, R], [0] * 4]


def test_interlaced_rows_and_clipping():
    indices = bytes(i // 2 % 4 + 1 for i in range(20))  # ten rows of two
    image = struct.pack("<BHHHHBB", 0x2C, 3, 1, 2, 10, 0x40, 8) + A._sub_blocks(A.lzw_packed(indices))
    px = next(A.gif_frames(gif(image, w=4, h=12)))[0]
    order = [0, 8, 4, 2, 6, 1, 3, 5, 7, 9]
    table = [R, G, B, Y]
    for k, y in enumerate(order):
        assert px[y + 1].tolist() == [0, 0, 0, table[k % 4]]


@pytest.mark.parametrize(
    "data",
    [
        b"", b"GIF89a", b"GIF89a" + bytes(7), struct.pack("<6sHHBBB", b"GIF89a", 65535, 65535, 0, 0, 0) + b"\x3b", gif(),
        gif(A.gif_image(whole(R), np.array([R]), 0))[:-5], gif(A.gif_image(whole(R), np.array([R]), 0)) + b"x", gif(b"\x99"),
        gif(struct.pack("<BHHHHBB", 0x2C, 0, 0, 60000, 60000, 0, 8) + b"\0"),
        gif(struct.pack("<BHHHHBB", 0x2C, 0, 0, 4, 2, 0, 9) + b"\1\0\0"),
        gif(struct.pack("<BHHHHBB", 0x2C, 0, 0, 4, 2, 0, 2) + A._sub_blocks(b"\xff\xff\xff\xff")),
        gif(b"\x21\xf9\x03\0\0\0\0"), struct.pack("<6sHHBBB", b"GIF89a", 4, 2, 0, 0, 0) + A.gif_image(whole(R), np.array([R]), 0) + b"\x3b",
    ],
)
def test_hostile_gifs_are_refused(data):
    with pytest.raises((ValueError, struct.error, IndexError)):
        list(A.gif_frames(data))


def test_total_of_pixels_is_bounded(monkeypatch):
    monkeypatch.setattr(A, "MOST_TOTAL", 20)
    with pytest.raises(ValueError, match="20 pixels"):
        list(A.gif_frames(gif(*[A.gif_image(whole(R), np.array([R]), 0)] * 3)))


def rows(px: np.ndarray) -> bytes:
    return K.packed_rows(px)


def apng(controls: list[tuple], bodies: list[bytes], w: int = 4, h: int = 2, many: int | None = None, still: bytes | None = None) -> bytes:
    out = [K.PNG, K.chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)), K.chunk(b"acTL", struct.pack(">II", len(controls) if many is None else many, 0))]
    serial = 0
    if still:
        out.append(K.chunk(b"IDAT", still))
    for k, (c, b) in enumerate(zip(controls, bodies, strict=True)):
        out.append(K.chunk(b"fcTL", struct.pack(">IIIIIHHBB", serial, *c)))
        serial += 1
        if k or still:
            out.append(K.chunk(b"fdAT", struct.pack(">I", serial) + b))
            serial += 1
        else:
            out.append(K.chunk(b"IDAT", b))
    return b"".join(out) + K.chunk(b"IEND", b"")


def test_apng_disposal_and_blending():
    half = np.full((1, 2), 0x80FF0000 - (1 << 32), np.int32)
    controls = [(4, 2, 0, 0, 1, 10, 0, 0), (2, 1, 1, 0, 30, 0, 2, 1), (2, 1, 0, 1, 5, 1000, 1, 0), (1, 1, 3, 1, 0, 1, 0, 0)]
    bodies = [rows(whole(B)), rows(half), rows(half), rows(np.full((1, 1), G))]
    for still in (None, rows(whole(Y))):
        found = list(A.apng_frames(apng(controls, bodies, still=still)))
        assert [d for _, d in found] == [100, 300, 5, 0]
        mixed = 0xFF80007F - (1 << 32)
        assert found[0][0].tolist() == [[B] * 4] * 2
        assert found[1][0].tolist() == [[B, mixed, mixed, B], [B] * 4]
        assert found[2][0].tolist() == [[B] * 4, [half[0, 0]] * 2 + [B] * 2]
        assert found[3][0].tolist() == [[B] * 4, [0, 0, B, G]]
    for bad in (apng(controls, bodies, many=3), apng([(5, 2, 0, 0, 1, 1, 0, 0)], bodies[:1]), apng(controls, bodies).replace(b"fdAT", b"fdAU")):
        with pytest.raises(ValueError):
            list(A.apng_frames(bad))


def test_interlaced_png_of_all_kinds():
    rng = np.random.default_rng(5)
    for h, w in ((1, 1), (2, 3), (5, 9), (16, 17)):
        px = rng.integers(-(2**31), 2**31, (h, w)).astype(np.int32)
        assert (K.png_decode(K.png_encode_interlaced(px)) == px).all()
    # two bits a pixel, by palette, in passes
    v = rng.integers(0, 4, (9, 11))
    raw = b""
    for x, y, dx, dy in K._PASSES:
        for line in v[y::dy, x::dx]:
            bits = "".join(f"{i:02b}" for i in line)
            raw += b"\0" + bytes(int(bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(bits), 8)) if len(line) else b""
    head = struct.pack(">IIBBBBB", 11, 9, 2, 3, 0, 0, 1)
    data = K.PNG + K.chunk(b"IHDR", head) + K.chunk(b"PLTE", bytes([255, 0, 0, 0, 255, 0, 0, 0, 255, 255, 255, 0])) + K.chunk(b"IDAT", zlib.compress(raw)) + K.chunk(b"IEND", b"")
    assert (K.png_decode(data) == np.array([R, G, B, Y])[v]).all()


def test_transparent_colour_of_grey_and_rgb():
    head = struct.pack(">IIBBBBB", 2, 1, 16, 0, 0, 0, 0)
    raw = b"\0" + struct.pack(">HH", 0x1234, 0x1235)
    data = K.PNG + K.chunk(b"IHDR", head) + K.chunk(b"tRNS", struct.pack(">H", 0x1234)) + K.chunk(b"IDAT", zlib.compress(raw)) + K.chunk(b"IEND", b"")
    assert (K.png_decode(data).view(np.uint32) >> 24).tolist() == [[0, 255]]


SHAPE = "anim_id long, place int, w int, h int, pixels array<int>, delay int"


def test_many_colours_and_odd_animations(spark):
    rng = np.random.default_rng(3)
    px = (rng.integers(0, 1 << 24, 64 * 64) | 0xFF000000).astype(np.uint32).view(np.int32)
    clips = [(1, 0, 64, 64, px.tolist(), 70), (1, 5, 64, 64, px[::-1].tolist(), 1), (2, 0, 2, 1, [0, 0], 0), (3, 0, 2, 1, [0, 0], 0), (3, 1, 1, 1, [0], 0), (4, 0, 20000, 1, [0] * 20000, 0)]
    df = spark.createDataFrame([(a, p, w, h, v, d) for a, p, w, h, v, d in clips], SHAPE)
    files = {r.anim_id: r for r in A.encoded(df, "gif").collect()}
    assert {k for k, r in files.items() if r.error} == {3, 4} and files[3].error == "frames differ in size"
    colours = {r.anim_id: r.colours for r in A.palettes(df.where("anim_id = 1")).collect()}[1]
    assert len(colours) == 255 and len(set(colours)) > 200
    first, second = list(A.gif_frames(files[1].content))
    assert (first[1], second[1]) == (70, 20)
    c = np.array(colours)
    part = lambda v: np.stack([v >> 16 & 255, v >> 8 & 255, v & 255], -1).astype(int)
    nearest = c[((part(px)[:, None] - part(c)[None]) ** 2).sum(2).argmin(1)]
    assert (first[0].ravel() & 0xFFFFFF == nearest).all() and (second[0].ravel()[::-1] & 0xFFFFFF == nearest).all()
    assert np.abs(part(px) - part(nearest)).mean() < 20
    out = A.decoded(spark.createDataFrame([(7, b"junk"), (8, None), (9, files[2].content)], "anim_id long, content binary")).collect()
    assert {r.anim_id: r.error is None for r in out} == {7: False, 8: False, 9: True}
    stills = A.encoded(df, "apng").where("anim_id = 1").first().content
    assert [p.ravel().tolist() for p, _ in A.apng_frames(bytes(stills))] == [px.tolist(), px[::-1].tolist()]
