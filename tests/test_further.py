"""Edge cases of schemes, names, palettes as text, effects, shapes and tiles."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequarry.functions import harmony, names
from framequarry.operators import effects, measures, seams, shapes, vector
from framequarry.sources import animations, codecs, palettes, sprites
from framequarry.sources.frames import pixels

RED, WHITE, BLACK = -65536, -1, -16777216


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()[0]


def raster(spark, rows):
    h, w = len(rows), len(rows[0])
    return spark.createDataFrame([(1, w, h, [int(v) for r in rows for v in r], 0)], "frame_id long, w int, h int, pixels array<int>, tag int")


def test_names(spark):
    assert one(spark, names.nearest(F.lit(RED))).name == "red"
    assert one(spark, names.nearest(F.lit(0xFF0000))).name == "transparent"
    assert one(spark, names.exact(F.lit(-16711681))) == ["aqua", "cyan"]
    assert one(spark, names.exact(F.lit(-16711680))) == []


def test_schemes_keep_lightness_and_ends(spark):
    ramp = one(spark, harmony.luminance_ramp(F.lit(RED), 5))
    assert ramp[0] == BLACK and ramp[2] == RED and ramp[4] == WHITE
    assert one(spark, harmony.luminance_ramp(F.lit(RED), 2)) == [RED, WHITE]
    assert one(spark, harmony.gradient(F.lit(BLACK), F.lit(WHITE), 2)) == [BLACK, WHITE]
    assert one(spark, harmony.gradient(F.lit(RED), F.lit(WHITE), 1)) == [RED]
    turned = spark.createDataFrame([(c,) for c in (RED, -8355712, -16744448, -12345678)], "c int")
    from framequarry.functions import colour as C

    gap = F.abs(C.lab(F.col("c"))["l"] - C.lab(harmony.rotated(F.col("c"), 120.0))["l"])
    assert turned.select(F.max(gap)).first()[0] < 1.5
    assert one(spark, harmony.rotated(F.lit(RED), 720.0)) == RED


def test_palette_texts_are_read(spark):
    texts = [
        (1, "JASC-PAL\r\n0100\r\n2\r\n255 0 0\r\n0 0 0\r\n"),
        (2, "GIMP Palette\nName: x\n# note\n255 0 0\tred\n300 0 0\nnothing\n"),
        (3, "#ff0000\n\n 000000 \nzz\n"),
        (4, ""),
        (5, None),
        (6, "﻿\n  gimp palette\n1 2 3"),
    ]
    got = {tuple(r) for r in palettes.read(spark.createDataFrame(texts, "palette_id int, text string")).collect()}
    assert got == {(1, 0, RED), (1, 1, BLACK), (2, 0, RED), (3, 0, RED), (3, 1, BLACK), (6, 0, BLACK + 0x010203)}
    with pytest.raises(Exception, match="count differs"):
        palettes.read(spark.createDataFrame([(1, "JASC-PAL\n0100\n3\n1 2 3\n")], "palette_id int, text string")).collect()


def test_sniffing_short_and_unknown_files(spark):
    files = [(b"",), (b"B",), (b"BM",), (b"GIF89a",), (b"\0\0\1\0",), (b"1234\xe0\xa5\1\0",), (b"1234\xe0\xa5\0\0",), (None,)]
    got = [r[0] for r in spark.createDataFrame(files, "content binary").select(palettes.sniffed(F.col("content"))).collect()]
    assert got == ["unknown", "unknown", "bmp", "gif", "ico", "aseprite", "unknown", "unknown"]


def test_rotation_by_quarters_is_exact(spark):
    fr = raster(spark, [[1, 2, 3], [4, 5, 6]])
    assert effects.rotated(fr, 90).first().pixels == [4, 1, 5, 2, 6, 3]
    assert effects.rotated(fr, -90).first().pixels == [3, 6, 2, 5, 1, 4]
    assert effects.rotated(fr, 720).first().pixels == [1, 2, 3, 4, 5, 6]
    kept = effects.rotated(fr, 20, expand=False).first()
    assert (kept.w, kept.h) == (3, 2)


def test_svg_of_an_empty_raster_and_of_faint_pixels(spark):
    empty = vector.svg(raster(spark, [[0, 0]])).first().svg
    assert empty.endswith('crispEdges">\n</svg>\n')
    assert 'fill="#FF0000" fill-opacity="0.50" d="M0 0h2v1h-2z"' in vector.svg(raster(spark, [[0x80FF0000 - (1 << 32)] * 2])).first().svg


def test_polygons_are_closed(spark):
    own = shapes.polygon(10, 10, 8, 6)
    assert len(own) == len(set(own)) and all(sum(abs(x - i) <= 1 and abs(y - j) <= 1 for i, j in own) >= 3 for x, y in own)
    assert shapes.polygon(5, 5, 0, 3) == [(5, 5)]
    for wrong in (lambda: shapes.polygon(0, 0, 5, 2), lambda: shapes.star(0, 0, -1, 2)):
        with pytest.raises(ValueError):
            wrong()


def _areas(on):
    """Sorted areas of 4-connected parts, by flooding."""
    todo, out = {tuple(p) for p in np.argwhere(on)}, []
    while todo:
        front, n = [todo.pop()], 0
        while front:
            y, x = front.pop()
            n += 1
            for p in ((y, x + 1), (y, x - 1), (y + 1, x), (y - 1, x)):
                if p in todo:
                    todo.remove(p)
                    front.append(p)
        out.append(n)
    return sorted(out)


@pytest.mark.parametrize("kind", ["noise", "snake", "full", "empty"])
def test_components_cross_tiles(spark, kind):
    h, w = 21, 26
    on = {"noise": np.random.default_rng(3).random((h, w)) < 0.6, "full": np.ones((h, w), bool), "empty": np.zeros((h, w), bool)}.get(kind)
    if kind == "snake":
        on = np.zeros((h, w), bool)
        on[::2] = True
        on[1::4, -1], on[3::4, 0] = True, True
    fr = raster(spark, np.where(on, RED, 0))
    got = seams.components(seams.tiled(pixels(fr), 5), 5).collect()
    assert sorted(r.area for r in got) == _areas(on)
    if kind in ("snake", "full"):
        assert [(r.frame_id, r.x, r.y, r.width, r.height) for r in got] == [(1, 0, 0, w, h)]


def test_interlaced_pngs_are_told_from_plain_ones(spark):
    px = np.arange(12, dtype=np.int32).reshape(3, 4)
    plain, woven = codecs.png_encode(px), codecs.png_encode_interlaced(px)
    files = [(0, bytearray(plain)), (1, bytearray(woven)), (2, bytearray(woven[:20])), (3, bytearray(codecs.PNG)), (4, None)]
    frame = spark.createDataFrame(files, "frame_id int, content binary")
    found = palettes.sniffed(F.col("content"))
    got = frame.select("frame_id", found.alias("kind"), palettes.format_name(found).alias("name")).orderBy("frame_id").collect()
    assert [r.kind for r in got] == ["png", "png-interlaced", "png", "png", "unknown"]
    assert [r.name[:3] for r in got] == ["PNG"] * 4 + ["unk"]
    assert [codecs.sniffed(bytes(f or b"")) for _, f in files] == ["png", "png-interlaced", "png", "png", None]
    back = {r.frame_id: r for r in codecs.decoded(frame, "frame_id").collect()}
    assert back[0].pixels == back[1].pixels == px.ravel().tolist()
    assert [r.error for r in animations.decoded(frame.where("frame_id < 2").withColumnRenamed("frame_id", "anim_id")).collect()] == [None, None]
    assert [r["kind"] for r in sprites.records(woven, "x")] == [r["kind"] for r in sprites.records(plain, "x")] != ["error"]


def _limits_over_all_bins(counts, levels):
    n, s = (np.concatenate([[0], np.cumsum(c)]).astype(float) for c in (counts, counts * np.arange(256)))
    size = n[None, :] - n[:, None]
    score = np.where(size > 0, (s[None, :] - s[:, None]) ** 2 / np.where(size > 0, size, 1), 0.0)
    best, cuts, out, at = score[0].copy(), [], [], 256
    best[0] = -np.inf
    for _ in range(levels - 1):
        total = np.where(np.arange(257)[:, None] < np.arange(257)[None, :], best[:, None] + score, -np.inf)
        cuts.append(total.argmax(0))
        best = total.max(0)
    for cut in reversed(cuts):
        at = int(cut[at])
        out.append(at - 1)
    return sorted(out)


def test_class_limits_of_histograms_in_one_partition(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(60):
        bins = rng.choice(256, 1 + i % 30, replace=False)
        rows += [(i, "luma", int(b), int(rng.integers(1, 9))) for b in bins]
    out = measures.otsu_levels(spark.createDataFrame(rows, "frame_id long, channel string, bin int, cnt long"), 4)
    assert "ArrowInPandas" not in out._jdf.queryExecution().optimizedPlan().toString().replace("FlatMapGroupsIn", "ArrowInPandas")
    got = {r.frame_id: r.thresholds for r in out.collect()}
    for i in range(60):
        counts = np.zeros(256, np.int64)
        for _, _, b, c in (r for r in rows if r[0] == i):
            counts[b] = c
        assert got[i] == (_limits_over_all_bins(counts, 4) if counts.sum() > 1 else [0] * 3)
