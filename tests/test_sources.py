"""Files, texts and streams."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pytest

from framequarry.sources import codecs, generate, text
from framequarry.streaming import edits


@pytest.mark.parametrize("kind", sorted(codecs.ENCODERS))
def test_files_come_back(kind):
    rng = np.random.default_rng(1)
    for h, w in ((1, 1), (5, 7), (16, 3)):
        few = rng.choice(np.array([0, -1, -65536, 0x40112233], np.int32), (h, w))
        many = rng.integers(-(1 << 31), 1 << 31, (h, w)).astype(np.int32)
        for px in (few, many, np.zeros((h, w), np.int32)):
            data = codecs.ENCODERS[kind](px)
            assert codecs.sniffed(data) == kind and (codecs.DECODERS[kind](data) == px).all()


def png(w, h, depth, kind, rows, extra=b""):
    def chunk(name, body):
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return codecs._PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_png_filters_and_depths():
    rng = np.random.default_rng(2)
    w, h = 6, 5
    want = rng.integers(0, 256, (h, w * 3)).astype(np.uint8)
    rows, before = b"", np.zeros(w * 3, int)
    for y in range(h):
        line, left, slant = want[y].astype(int), np.concatenate([[0] * 3, want[y][:-3]]).astype(int), np.concatenate([[0] * 3, before[:-3]])
        p = left + before - slant
        paeth = np.where((abs(p - left) <= abs(p - before)) & (abs(p - left) <= abs(p - slant)), left, np.where(abs(p - before) <= abs(p - slant), before, slant))
        guess = [0 * line, left, before, (left + before) // 2, paeth][y]
        rows += bytes([y]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        before = line
    px = codecs.png_decode(png(w, h, 8, 2, rows))
    assert (np.stack([px >> 16 & 255, px >> 8 & 255, px & 255], -1).reshape(h, -1) == want).all()
    assert codecs.png_decode(png(9, 1, 1, 0, bytes([0, 0b10110000, 0b10000000]))).tolist() == [[-1 if b else -16777216 for b in (1, 0, 1, 1, 0, 0, 0, 0, 1)]]


def test_hostile_files_are_refused(spark):
    huge = codecs._PNG + struct.pack(">I", 13) + b"IHDR" + struct.pack(">IIBBBBB", 1 << 30, 1 << 30, 8, 6, 0, 0, 0)
    huge += struct.pack(">I", zlib.crc32(huge[12:29]))
    files = [b"", b"BM" + b"\xff" * 60, huge, b"qoif" + struct.pack(">II", 60000, 60000) + b"\4\0" + b"\0" * 7 + b"\1", codecs.png_encode(np.zeros((2, 2), np.int32))[:-20], b"GIF89a"]
    rows = spark.createDataFrame([(str(i), bytearray(f)) for i, f in enumerate(files)], "path string, content binary")
    assert all(r.error and r.pixels is None for r in codecs.decoded(rows).collect())


def test_sketch_and_palettes(spark):
    sketch = spark.createDataFrame([(1, "R=#ff0000\nlegend: g=#00ff00 green\n---\nR.g\n.?."), (2, "nothing")], "id int, text string")
    got = {(r.x, r.y): r.argb for r in text.sketches(sketch, "id").collect()}
    assert got == {(0, 0): -65536, (2, 0): -16711936, (1, 1): None}
    texts = [(1, "JASC-PAL\n0100\n2\n255 0 0\n0 0 255\n"), (2, "GIMP Palette\nName: x\n#\n255 255 255 white\n"), (3, "#ff0000\n80ffffff\nzz")]
    got = {(r.id, r.idx): (r.format, r.argb) for r in text.palettes(spark.createDataFrame(texts, "id int, text string"), "id").collect()}
    assert got == {(1, 0): ("jasc", -65536), (1, 1): ("jasc", -16776961), (2, 0): ("gpl", -1), (3, 0): ("hex", -65536), (3, 1): ("hex", 0x80FFFFFF - (1 << 32))}


def test_generators(spark):
    assert generate.checker(spark, 4, 2, 2, 1, 2).first().pixels == [1, 1, 2, 2] * 2
    assert generate.blank(spark, 2, 2).first().pixels == [0] * 4


def test_stream_of_edits(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", 1, k, '{"k": 1}') for i, k in enumerate("aaabba")]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, props string").selectExpr("event_id", "cast(ts as timestamp_ntz) ts", "user_id", "event_type", "props").coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    query = edits.coalesced(edits.edits(source)).writeStream.format("memory").queryName("runs").option("checkpointLocation", f"{tmp_path}/c").start()
    query.processAllAvailable()
    query.stop()
    assert [(r.kind, r.first, r.last, r.edits) for r in spark.table("runs").orderBy("first").collect()] == [("a", 0, 2, 3), ("b", 3, 4, 2)]
