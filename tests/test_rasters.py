"""Small rasters with known results."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequarry.functions import colour as C
from framequarry.operators import measures, pairs, raster, sequential
from framequarry.plans import recipe
from framequarry.sources import frames as S

LETTERS = {".": 0, "r": -65536, "g": -16711936, "b": -16776961, "k": -16777216, "w": -1, "a": -8355712}


def drawn(spark, *pictures: str):
    """A raster for each picture of letters, rows parted by spaces."""
    rows = []
    for i, p in enumerate(pictures):
        lines = p.split()
        rows.append((i, len(lines[0]), len(lines), [LETTERS[c] for line in lines for c in line], 0))
    return spark.createDataFrame(rows, "frame_id long, w int, h int, pixels array<int>, tag int")


def shown(frames) -> list[str]:
    back = {v: k for k, v in LETTERS.items()}
    return [" ".join("".join(back.get(p, "?") for p in r.pixels[y * r.w : (y + 1) * r.w]) for y in range(r.h)) for r in frames.orderBy("frame_id").collect()]


def test_geometry(spark):
    fr = drawn(spark, "rg. b.w")
    assert shown(raster.flip_h(fr)) == [".gr w.b"]
    assert shown(raster.flip_v(fr)) == ["b.w rg."]
    assert shown(raster.rot90(fr)) == ["br .g w."]
    assert shown(raster.rot90(raster.rot90(fr), False)) == ["rg. b.w"]
    assert shown(raster.rot180(fr)) == ["w.b .gr"]
    assert shown(raster.shifted(fr, 1, 0)) == [".rg .b."]
    assert shown(raster.region(fr, 1, 1, 3, 2)) == [".w. ..."]
    assert shown(raster.padded(fr, 1, 0, 0, 1)) == [".rg. .b.w ...."]
    assert shown(raster.scaled(drawn(spark, "rg"), 2)) == ["rrgg rrgg"]
    assert shown(raster.resampled(drawn(spark, "rgbw"), 2, 1)) == ["gw"]
    assert shown(raster.resampled(drawn(spark, "rgbw"), 2, 1, centred=False)) == ["rb"]


def test_morphology(spark):
    fr = drawn(spark, "..... .rrr. .rrr. .rrr. .....", "r.... ..... ..gg. ..... ....b")
    assert shown(raster.erode(fr)) == ["..... ..... ..r.. ..... .....", "..... ..... ..... ..... ....."]
    assert shown(raster.outline_mask(fr))[0] == "..... .rrr. .r.r. .rrr. ....."
    assert shown(raster.without_isolated(fr))[1] == "..... ..... ..gg. ..... ....."
    assert shown(raster.dilate(drawn(spark, "... .r. ..."))) == ["rrr rrr rrr"]
    assert shown(raster.outlined(drawn(spark, "... .r. ..."), -1, eight=False)) == [".w. wrw .w."]


def test_components(spark):
    fr = drawn(spark, "rr.. ..g. .... b..b")
    four = sequential.components(fr).first().pixels
    assert four == [1, 1, 0, 0, 0, 0, 2, 0, 0, 0, 0, 0, 3, 0, 0, 4]
    assert max(sequential.components(fr, eight=True).first().pixels) == 3
    assert shown(sequential.without_small(fr, 2)) == ["rr.. .... .... ...."]
    assert shown(sequential.largest(fr, 2)) == ["rr.. ..g. .... ...."]
    assert shown(sequential.flooded(fr, 3, 0, -1)) == ["rrww wwgw wwww bwwb"]
    near = drawn(spark, "ww. awr")
    assert shown(sequential.flooded(near, 0, 0, -1)) == ["ww. awr"]
    assert shown(sequential.flooded(near, 0, 0, -1, 130)) == ["ww. wwr"]  # the seed has the fill colour
    assert shown(sequential.flooded(near, 9, 0, -1, 130)) == ["ww. awr"]
    assert shown(sequential.holes_filled(drawn(spark, "rrrr r..r rrrr"))) == ["rrrr rrrr rrrr"]


@pytest.mark.parametrize("eight", [False, True])
@pytest.mark.parametrize("same", [False, True])
def test_components_of_noise(eight, same):
    rng = np.random.default_rng(1)
    for _ in range(20):
        px = rng.choice([0, -65536, -1], (7, 9)).astype(np.int32)
        label = sequential.component_labels(px, same, eight)
        want, n = np.zeros(px.shape, int), 0
        for y in range(7):
            for x in range(9):
                if px[y, x] and not want[y, x]:
                    n += 1
                    todo = [(y, x)]
                    while todo:
                        a, b = todo.pop()
                        if not want[a, b]:
                            want[a, b] = n
                            todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (eight or not (i and j)) and 0 <= a + i < 7 and 0 <= b + j < 9 and px[a + i, b + j] and (not same or px[a + i, b + j] == px[a, b])]
        assert (label == want).all()


def test_measures(spark):
    fr = drawn(spark, "rrg ...", "... ...")
    top = measures.census(fr).orderBy("rank").collect()
    assert [(r.hex, r.family, r.cnt) for r in top] == [("#ff0000", "red", 2), ("#00ff00", "green", 1)]
    box = measures.content_box(fr).collect()
    assert len(box) == 1 and (box[0].x, box[0].y, box[0].width, box[0].height) == (0, 0, 3, 1)


def test_metrics_where_nothing_is_compared(spark):
    found = pairs.metrics(pairs.consecutive(drawn(spark, "r.", ".r", ".r"))).orderBy("frame_id").collect()
    assert found[0].compared == 0 and np.isnan(found[0].mae) and np.isnan(found[0].psnr) and found[0].opacity_mismatches == 2
    assert found[1].compared == 1 and found[1].mae == 0 and found[1].psnr == float("inf")


def test_composite_truncates_opacity(spark):
    cels = drawn(spark, "w", "k").selectExpr("cast(0 as long) frame_idx", "cast(frame_id as int) layer_id", "w", "h", "pixels")
    layers = spark.createDataFrame([(0, 0, 1.0, True), (1, 1, 0.5, True)], "layer_id int, place int, opacity float, visible boolean")
    out = pairs.composited(cels, layers).first().pixels[0] & 0xFFFFFFFF
    assert out == 0xFF808080


def test_last_write_wins(spark):
    log = spark.createDataFrame([(1, 0, 0, 5, 1, 1), (1, 0, 0, 7, 1, 2), (1, 9, 9, 3, 1, 3)], "frame_id long, x int, y int, argb int, order1 long, order2 int")
    fr = S.gathered(S.last_writes(log), 2, 1).first()
    assert fr.pixels == [7, 0]


def test_recipe(spark):
    fr = drawn(spark, "r. ..")
    assert shown(recipe.run(fr, '{"steps": [{"type": "scale", "factor": 2}, {"type": "trim"}]}')) == ["rr rr"]
    for bad in ('{"steps": [{"type": "spin"}]}', '{"steps": [{"type": "scale"}]}', '{"steps": [{"type": "scale", "factor": 17}]}', '{"steps": [{"type": "trim", "x": 1}]}', '{"name": " ", "steps": []}', "[]"):
        with pytest.raises(ValueError):
            recipe.parse(bad)
    assert recipe.colour("#ff0000") == -65536 and recipe.colour("#80ff0000") == 0x80FF0000 - (1 << 32)


def test_colour_functions(spark):
    row = spark.createDataFrame([(-65536, -1)], "a int, b int").select(
        C.hex_colour(F.col("a")).alias("hex"), C.luma8(F.col("a")).alias("luma"), F.round(C.contrast(F.col("a"), F.col("b")), 3).alias("ratio"), C.lab(F.col("b"))["l"].alias("l"), C.conformance(F.col("a"), F.col("b")).alias("level")
    ).first()
    assert (row.hex, row.luma, row.ratio, row.level) == ("#ff0000", 54, 3.998, None) and abs(row.l - 100) < 0.01


def test_a_chain_of_stencils_works_each_out_once(spark):
    fr = drawn(spark, "rrrr r..r rrrr")
    once = raster.dilate(fr)._jdf.queryExecution().optimizedPlan().toString()
    many = S.pixels(raster.dilate(raster.dilate(raster.dilate(raster.dilate(fr)))))._jdf.queryExecution().optimizedPlan().toString()
    assert many.count("transform(sequence") <= 5 * max(1, once.count("transform(sequence"))
