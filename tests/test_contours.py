"""Rings of rasters: shapes whose outlines are known, and a plain walk on random ones."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from framequarry.operators import contours, seams
from framequarry.sources.frames import pixels

INK = -15720400
KIND = "frame_id long, w int, h int, pixels array<int>"


def rasters(spark, *drawings):
    return spark.createDataFrame([(k, len(d[0]), len(d), [0 if c == "." else INK for r in d for c in r]) for k, d in enumerate(drawings)], KIND)


def by_ring(points):
    out = {}
    for r in points.collect():
        out.setdefault((r.frame_id, r.x0, r.y0, r.hole), []).append((-r.left, r.x, r.y, r.dir))
    return {k: [(x, y) for _, x, y, _ in sorted(v)] for k, v in out.items()}


def plain(drawing):
    """Rings by walking from edge to edge, each edge once."""
    on = {(x, y) for y, r in enumerate(drawing) for x, c in enumerate(r) if c != "."}
    steps = [(1, 0), (0, 1), (-1, 0), (0, -1)]
    edges = set()
    for x, y in on:
        edges |= {e for e, o in (((y, x, 0), (x, y - 1)), ((y, x + 1, 1), (x + 1, y)), ((y + 1, x + 1, 2), (x, y + 1)), ((y + 1, x, 3), (x - 1, y))) if o not in on}
    rings = {}
    while edges:
        first = at = min(edges)
        ring = []
        while True:
            edges.discard(at)
            ring.append(at)
            y, x, d = at[0] + steps[at[2]][1], at[1] + steps[at[2]][0], at[2]
            ahead = [(y, x, (d + t) % 4) for t in (1, 0, 3) if (y, x, (d + t) % 4) in edges or (y, x, (d + t) % 4) == first]
            at = ahead[0]
            if at == first:
                break
        kept = [(x, y) for (y, x, d), before in zip(ring, ring[-1:] + ring[:-1], strict=True) if d != before[2]]
        rings[first[1], first[0], first[2] == 1] = kept
    return rings


def test_known_shapes(spark):
    block, frame_, two = ["....", ".rr.", ".rr.", "...."], ["rrrr", "r..r", "rrrr"], ["r.r", "r.r"]
    found = by_ring(contours.traced(rasters(spark, block, frame_, two, ["...."], ["r.", ".r"])))
    assert found == {
        (0, 1, 1, False): [(1, 1), (3, 1), (3, 3), (1, 3)],
        (1, 0, 0, False): [(0, 0), (4, 0), (4, 3), (0, 3)],
        (1, 1, 1, True): [(1, 1), (1, 2), (3, 2), (3, 1)],
        (2, 0, 0, False): [(0, 0), (1, 0), (1, 2), (0, 2)],
        (2, 2, 0, False): [(2, 0), (3, 0), (3, 2), (2, 2)],
        (4, 0, 0, False): [(0, 0), (1, 0), (1, 1), (0, 1)],
        (4, 1, 1, False): [(1, 1), (2, 1), (2, 2), (1, 2)],
    }
    every = contours.traced(rasters(spark, ["rr", "rr"]), corners_only=False)
    assert sorted(r.left for r in every.collect()) == list(range(1, 9))


def test_sizes_and_closed_rings(spark):
    points = contours.traced(rasters(spark, ["rrrr", "r..r", "rrrr"]))
    assert sorted(map(tuple, contours.sizes(points).collect())) == [(0, 0, 0, False, 14, 4, 12), (0, 1, 1, True, 6, 4, -2)]
    ring = contours.rings(points).where("hole").first().ring
    assert [tuple(p) for p in ring] == [(1, 1), (1, 2), (3, 2), (3, 1), (1, 1)]


def test_one_colour(spark):
    red, green = -65536, -16711936
    fr = spark.createDataFrame([(1, 3, 2, [red, green, red, 0, 0, 0]), (2, 1, 1, [red + 9])], KIND)
    assert contours.traced(fr, contours.of_colour(red)).select("frame_id", "x0").distinct().count() == 2
    assert contours.traced(fr, contours.of_colour(green)).count() == 4
    assert contours.traced(fr, contours.of_colour(red, 9)).where("frame_id = 2").count() == 4
    with pytest.raises(ValueError):
        contours.of_colour(red, 256)


@pytest.mark.parametrize("size", [1, 3, 5])
def test_random_rasters_whole_and_in_tiles(spark, size):
    rng = random.Random(size)
    drawings = [["".join("#." [rng.random() < p] for _ in range(w)) for _ in range(h)] for p in (0.3, 0.5, 0.7) for w, h in ((11, 7), (7, 7), (1, 9), (11, 7))]
    drawings.append(["#" * 12] + ["#..........#"] * 6 + ["#" * 12])  # rings through many tiles
    drawings.append(["#" * 9] * 9)
    want = {(k, *ring): points for k, d in enumerate(drawings) for ring, points in plain(d).items()}
    fr = rasters(spark, *drawings)
    whole = contours.traced(fr)
    assert by_ring(whole) == want
    tiled = contours.traced_tiles(seams.tiled(pixels(fr), size), size)
    assert by_ring(tiled) == want
    columns = ["frame_id", "x0", "y0", "left", "x", "y", "dir"]
    assert tiled.select(columns).exceptAll(whole.select(columns)).isEmpty()


def test_nothing_to_trace(spark):
    none = rasters(spark, ["r"]).limit(0)
    assert contours.traced(none).isEmpty()
    assert contours.traced_tiles(seams.tiled(pixels(none), 4), 4).isEmpty()
    odd = spark.createDataFrame([(1, 0, 0, []), (2, 2, 1, None), (3, 2, 1, [None, INK])], KIND)
    assert {r.frame_id for r in contours.traced(odd).collect()} == {3}
    assert contours.traced(odd.withColumn("x0", F.lit("clash"))).count() == 4
