"""Edge cases of effects, shears, halvings, noise, ways of seeing and shapes."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequarry.functions import colour as C
from framequarry.operators import motion, shapes
from framequarry.sources import noise
from framequarry.sources.frames import pixels

RED, BLUE = -65536, -16776961
KIND = "frame_id long, w int, h int, pixels array<int>, tag int"


def raster(spark, rows, frame_id=1):
    h, w = len(rows), len(rows[0])
    return spark.createDataFrame([(frame_id, w, h, [int(v) for r in rows for v in r], 0)], KIND)


def grid(frames):
    r = frames.first()
    return np.array(r.pixels).reshape(r.h, r.w).tolist()


def test_content_keeps_its_ground_line(spark):
    fr = raster(spark, [[0, 0, 0, 0], [0, RED, BLUE, 0], [0, RED, BLUE, 0], [0, 0, 0, 0]])
    squashed = motion.squashed(fr).where("phase = 1")
    assert grid(squashed) == [[0] * 4, [0] * 4, [RED, RED, BLUE, BLUE], [0] * 4]
    assert motion.squashed(fr, 1, 1).where("phase = 1").first().pixels == fr.first().pixels
    grown = motion.pulsed(fr).where("phase = 1")
    assert grid(grown) == [[RED, RED, BLUE, BLUE]] * 4


def test_effects_on_empty_rasters_and_tables(spark):
    bare = raster(spark, [[0, 0], [0, 0]])
    none = bare.limit(0)
    for name in motion.EFFECTS:
        options = {"glow": [0xFFFFFF], "scanline": [RED]}.get(name, [])
        out = motion.applied(bare, f" {name.upper()} ", *options)
        if name != "scanline":
            assert all(p == 0 for r in out.collect() for p in r.pixels)
        assert motion.applied(none, name, *options).count() == 0
    assert motion.halved_chain(none).count() == 0
    assert motion.rotated_by_shears(none, 30).count() == 0
    with pytest.raises(ValueError):
        motion.applied(bare, "melt")
    with pytest.raises(ValueError):
        motion.squashed(bare, 0, 1)
    with pytest.raises(ValueError):
        motion.glowing(bare, 0, 1)


def test_glow_touches_sides_only_and_ends_dark(spark):
    fr = raster(spark, [[0, 0, 0], [0, RED, 0], [0, 0, 0]])
    steps = {r.phase: np.array(r.pixels).reshape(3, 3) for r in motion.glowing(fr, 0xFF0000, 3).collect()}
    assert (steps[2] == np.array(fr.first().pixels).reshape(3, 3)).all()
    assert steps[1][0, 1] == (0x40 << 24) + 0xFF0000 and steps[1][0, 0] == 0


def test_rainbow_starts_as_it_is(spark):
    fr = raster(spark, [[RED, 0]], 1).union(raster(spark, [[RED, 0]], 5))
    first, second = (r.pixels for r in motion.rainbow(fr).orderBy("frame_id").collect())
    assert first == [RED, 0] and second[0] != RED and second[1] == 0


def test_shears_move_pixels_and_quarters_turn(spark):
    rows = [[1 + y * 5 + x for x in range(5)] for y in range(3)]
    fr = raster(spark, rows)
    for degrees in (17.0, 45.0, -30.0, 200.0):
        assert sorted(p for p in motion.rotated_by_shears(fr, degrees).first().pixels if p) == list(range(1, 16))
        assert motion.rotated_by_shears(fr, degrees, crop=True).select("w", "h").first()[:] == (5, 3)
    assert grid(motion.rotated_by_shears(fr, 90)) == np.rot90(rows, -1).tolist()
    assert grid(motion.rotated_by_shears(fr, 540)) == np.rot90(rows, 2).tolist()
    assert grid(motion.rotated_by_shears(fr, -90)) == np.rot90(rows).tolist()
    assert motion.quarters(-180) == (2, 0) and motion.quarters(350) == (0, -10)
    with pytest.raises(ValueError):
        motion.rotated_by_shears(fr, math.inf)


def test_halvings_end_at_one(spark):
    fr = raster(spark, [[RED] * 5] * 4)
    assert [(r.level, r.w, r.h, set(r.pixels)) for r in motion.halved_chain(fr).orderBy("level").collect()] == [(0, 5, 4, {RED}), (1, 2, 2, {RED}), (2, 1, 1, {RED})]
    assert motion.halved_chain(fr, 1).count() == 1


def test_noise_repeats_and_stays_within(spark):
    y, x = np.mgrid[:9, :9].astype(np.float32) / 4  # quarters are exact in single precision
    v = noise.fbm(x, y, 7, tile=4)
    assert v.min() >= 0 and v.max() < 1 and (v == noise.fbm(x + 4, y, 7, tile=4)).all()
    assert noise.ridged(np.array([0, 0.5, 1], np.float32)).tolist() == [0, 1, 0]
    near, second = noise.cellular(x, y, 3), noise.cellular(x, y, 3, "second")
    assert (near <= second).all() and near.max() < math.sqrt(2) and np.allclose(noise.cellular(x, y, 3, "border"), second - near)
    assert (noise.cellular(x, y, 0) == noise.cellular(x, y, 0)).all() and (noise.cellular(x, y, 1) != noise.cellular(x, y, 2)).any()
    with pytest.raises(ValueError):
        noise.fbm(x, y, 1, octaves=9)
    with pytest.raises(ValueError):
        noise.cellular_frames(spark, 4, 4, feature="third")
    with pytest.raises(KeyError):
        noise.texture_frames(spark, "felt", 4, 4, [0])


def test_accessible_colours_reach_the_contrast(spark):
    rows = spark.createDataFrame([(a, b) for a in (RED, BLUE, -8355712, -1) for b in (-1, -16777216, -8355712)], "a int, b int")
    for r in rows.select("a", "b", C.contrast(F.col("a"), F.col("b")).alias("old"), C.accessible(F.col("a"), F.col("b")).alias("c")).withColumn("new", C.contrast(F.col("c"), F.col("b"))).collect():
        assert (r.c == r.a) if r.old >= 4.5 else (r.c is None or r.new >= 4.5)
        assert r.c is not None or r.b == -8355712  # grey is too near to both ends


def test_strip_shows_the_raster_first(spark):
    out = motion.seen_by_all(raster(spark, [[RED, BLUE], [BLUE, RED]]), 2, 2).first()
    assert (out.w, out.h) == (10, 2) and out.pixels[:4] == [RED, BLUE, BLUE, RED] and len(set(out.pixels[16:])) == 2


@pytest.mark.parametrize("w,h", [(1, 5), (6, 1), (2, 2), (7, 4), (20, 31), (64, 3)])
def test_ellipses_fit_their_box(w, h):
    edge, full = set(shapes.ellipse(3, 2, w, h, False)), set(shapes.ellipse(3, 2, w, h, True))
    assert edge <= full
    for j in {y for _, y in edge}:
        row = [x for x, y in edge if y == j]
        assert {x for x, y in full if y == j} == set(range(min(row), max(row) + 1))
    assert all(3 <= x <= 3 + w and 2 <= y <= 2 + h for x, y in full)


def test_lines_arcs_and_round_corners():
    assert shapes.thick_line(0, 0, 4, 0, 3) == [(x, y) for y in (-1, 0, 1) for x in range(5)]
    assert sorted(shapes.thick_line(5, 5, 5, 5, 2)) == [(5, 5), (5, 6), (6, 5), (6, 6)]
    assert shapes.arc(5, 5, 3, 0, 0) == [] and shapes.arc(5, 5, 0, 0, 90) == [(5, 5)]
    ring = shapes.arc(0, 0, 9, 0, 360)
    assert all(abs(math.hypot(*p) - 9) < 1.2 for p in ring) and len(ring) == len(set(ring))
    assert shapes.rounded_rect(1, 1, 6, 4, 0) == shapes.rect(1, 1, 6, 4, False)
    round_ = shapes.rounded_rect(0, 0, 10, 8, 3)
    assert (0, 0) not in round_ and (3, 0) in round_ and (0, 3) in round_ and (9, 4) in round_
    for bad in (lambda: shapes.thick_line(0, 0, 1, 1, 0), lambda: shapes.arc(0, 0, -1, 0, 9), lambda: shapes.rounded_rect(0, 0, 4, 4, 3), lambda: shapes.ellipse(0, 0, 0, 4, False)):
        with pytest.raises(ValueError):
            bad()


def test_shapes_with_five_numbers(spark):
    table = spark.createDataFrame([(1, 0, "thick_line", 0, 0, 2, 0, 2, RED), (1, 1, "arc", 0, 0, 2, 0, 90, BLUE)], "frame_id long, ord long, kind string, a int, b int, c int, d int, e int, argb int")
    out = {(r.x, r.y): r.argb for r in pixels(shapes.drawn(raster(spark, [[0] * 4] * 4), table)).collect()}
    assert out[0, 0] == RED and out[0, 2] == BLUE and out[3, 3] == 0


def test_points_of_one_partition_are_dealt_out(spark):
    kinds = [("line", 9, 2, 0, 7, 0), ("arc", 20, 5, 12, 30, -200), ("ellipse_filled", 1, 1, 9, 6, 0), ("star", 3, 3, 8, 2, None)]
    rows = [(i, i % 5, *kinds[i % 4], -i) for i in range(40)]
    table = spark.createDataFrame(rows, "frame_id long, ord long, kind string, a int, b int, c int, d int, e int, argb int").coalesce(1)
    out = shapes.points(table)
    assert out.rdd.getNumPartitions() > 1
    want = {(i, o, x, y, argb) for i, o, *s, argb in rows for x, y in shapes._points(*s[:5], s[5] or 0) if x >= 0 and y >= 0}
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert shapes.points(table.limit(0)).count() == 0
    away = spark.createDataFrame([(1, 0, "line", -5, -5, -1, -1, 7)], "frame_id long, ord long, kind string, a int, b int, c int, d int, argb int")
    assert shapes.points(away).count() == 0


def test_curves_that_share_their_keys_and_points(spark):
    """Equal curves, curves of one key, null keys: each point once, and a curve alone
    under its key is told apart in its row, not in a shuffle of points."""
    own = [(1, 0, 3, 4, 9, 1, 20, 6, -1), (1, 0, 3, 4, 9, 1, 20, 6, -1), (1, 0, 3, 4, 9, 9, 20, 6, -1), (2, 0, 3, 4, 9, 1, 20, 6, -1), (None, 0, 0, -9, 5, 5, 7, 7, -1)]
    table = spark.createDataFrame(own, "frame_id long, ord long, x0 int, y0 int, x1 int, y1 int, x2 int, y2 int, argb int")
    want = set()
    for f, o, x0, y0, x1, y1, x2, y2, argb in own:
        for k in range(33):
            t = k / 32
            x, y = (math.floor((1 - t) * (1 - t) * a + 2 * (1 - t) * t * b + t * t * c + 0.5) for a, b, c in ((x0, x1, x2), (y0, y1, y2)))
            want |= {(f, o, x, y, argb)} if x >= 0 and y >= 0 else set()
    out = shapes.curves(table)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    alone = shapes.curves(table.where("frame_id = 2")).where("frame_id = 2").agg(F.count("*")).first()[0]
    assert alone == sum(r[0] == 2 for r in want)
    assert "array_distinct" in out._jdf.queryExecution().optimizedPlan().toString()
