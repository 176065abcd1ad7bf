"""Packing against plain loops, drawn sheets against their regions, and descriptions."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequarry.operators import atlas

KIND = "tag int, frame_id long, w int, h int, pixels array<int>"


def frames(spark, sizes, tag=0):
    return spark.createDataFrame([(tag, k, w, h, [-1 - k * 100 - i for i in range(w * h)]) for k, (w, h) in enumerate(sizes)], KIND)


def plain(boxes, turn):
    """The same rules over lists of tuples."""
    free, placed = [(0, 0, sum(w for w, _ in boxes), sum(h for _, h in boxes))], []
    for w, h in boxes:
        options = []
        for k, (fx, fy, fw, fh) in enumerate(free):
            for turned in (False, True) if turn else (False,):
                a, b = (h, w) if turned else (w, h)
                if a <= fw and b <= fh:
                    over = sorted((fw - a, fh - b))
                    options.append((over[0], -over[1], k, turned, fx, fy, a, b))
        *_, turned, x, y, a, b = min(options)
        placed.append((x, y, a, b, turned))
        new = []
        for f in free:
            fx, fy, fw, fh = f
            if x >= fx + fw or x + a <= fx or y >= fy + fh or y + b <= fy:
                new.append(f)
                continue
            parts = [(fx, y + b, fw, fy + fh - y - b), (fx, fy, fw, y - fy), (x + a, fy, fx + fw - x - a, fh), (fx, fy, x - fx, fh)]
            new += [q for q in parts if q[2] > 0 and q[3] > 0]

        def covers(p, q):
            return p[0] <= q[0] and p[1] <= q[1] and p[0] + p[2] >= q[0] + q[2] and p[1] + p[3] >= q[1] + q[3]

        free = [q for k, q in enumerate(new) if not any(covers(p, q) and (p != q or j > k) for j, p in enumerate(new) if j != k)]
    return placed


@pytest.mark.parametrize("turn", [False, True])
def test_packing_by_plain_loops(spark, turn):
    rng = random.Random(7)
    groups = [[(rng.randint(1, 9), rng.randint(1, 9)) for _ in range(n)] for n in (1, 2, 12, 40)] + [[(4, 4)] * 9, [(1, 9), (9, 1), (3, 3), (9, 2)]]
    for padding in (0, 2):
        for tag, sizes in enumerate(groups):
            laid = atlas.packed(atlas.sheeted(frames(spark, sizes, tag), 40), padding, turn).orderBy("place").collect()
            want = plain([(w + 2 * padding, h + 2 * padding) for w, h in sizes], turn)
            assert [(r.x - padding, r.y - padding, r.w + 2 * padding, r.h + 2 * padding, r.rotated) for r in laid] == want
            assert (laid[0].sheet_w, laid[0].sheet_h) == (max(x + w for x, _, w, _, _ in want), max(y + h for _, y, _, h, _ in want))
            taken = np.zeros((laid[0].sheet_h, laid[0].sheet_w), int)
            for x, y, w, h, _ in want:
                taken[y : y + h, x : x + w] += 1
            assert taken.max() == 1


def test_sheets_are_bounded_and_drawn(spark):
    rng = random.Random(3)
    fr = frames(spark, [(rng.randint(1, 6), rng.randint(1, 6)) for _ in range(23)])
    sprites = atlas.sheeted(fr, 5)
    laid = atlas.regions(sprites, 1, 2, turn=True, powers=True)
    assert [r.n for r in laid.groupBy("sheet").agg(F.count("*").alias("n")).orderBy("sheet").collect()] == [5, 5, 5, 5, 3]
    sheets = {r.frame_id.no: np.array(r.pixels).reshape(r.h, r.w) for r in atlas.drawn(sprites, laid, 2).collect()}
    own = {r.frame_id: np.array(r.pixels).reshape(r.h, r.w) for r in fr.collect()}
    for r in laid.collect():
        part = np.rot90(own[r.frame_id], -1) if r.rotated else own[r.frame_id]
        canvas = sheets[r.sheet.no]
        assert canvas.shape == (r.sheet_h, r.sheet_w) and all(v & (v - 1) == 0 for v in canvas.shape)
        assert (canvas[r.y - 2 : r.y + r.h + 2, r.x - 2 : r.x + r.w + 2] == np.pad(part, 2, "edge")).all()
    assert sum((s != 0).sum() for s in sheets.values()) == sum((h + 4) * (w + 4) for h, w in (p.shape for p in own.values()))


def test_trimmed_sprites_know_what_they_were(spark):
    fr = spark.createDataFrame([(0, 1, 3, 3, [0, 0, 0, 0, -1, -2, 0, 0, 0]), (0, 2, 2, 1, [0, 0])], KIND)
    sprites = atlas.trimmed(atlas.sheeted(fr))
    rows = {r.frame_id: r for r in atlas.regions(sprites, 0).collect()}
    assert (rows[1].w, rows[1].h, tuple(rows[1].original)) == (2, 1, (3, 3, 1, 1))
    assert (rows[2].w, rows[2].h, rows[2].original) == (2, 1, None)
    phaser = json.loads(atlas.metadata(atlas.regions(sprites, 0), "phaser").first().json)["frames"]
    assert phaser["1"]["trimmed"] and phaser["1"]["spriteSourceSize"] == {"x": 1, "y": 1, "w": 2, "h": 1} and phaser["1"]["sourceSize"] == {"w": 3, "h": 3}
    assert not phaser["2"]["trimmed"]


def test_descriptions(spark):
    grid = atlas.regions(atlas.sheeted(frames(spark, [(4, 4)] * 3)), 1, shelf=True)
    told = {f: atlas.metadata(grid, f).first().json for f in atlas.FORMATS}
    assert told["godot3"] == '{"texture":"atlas.png","regions":[{"name":"0","region":[1,1,4,4]},{"name":"1","region":[7,1,4,4]},{"name":"2","region":[13,1,4,4]}]}'
    assert told["godot4"].endswith('"region":[13,1,4,4],"rotated":false}],"size":{"w":18,"h":6}}')
    assert json.loads(told["tiled"]) == {"columns": 3, "image": "atlas.png", "imageheight": 6, "imagewidth": 18, "margin": 1, "spacing": 2, "tilecount": 3, "tileheight": 4, "tilewidth": 4, "type": "tileset"}
    uneven = atlas.regions(atlas.sheeted(frames(spark, [(4, 4), (4, 3)])), 1, shelf=True)
    assert atlas.metadata(uneven, "tiled").first().json is None
    with pytest.raises(ValueError):
        atlas.metadata(grid, "nonsense")


def test_bounds_and_empty_tables(spark):
    none = atlas.sheeted(frames(spark, [(1, 1)])).limit(0)
    assert atlas.packed(none).isEmpty() and atlas.drawn(none, atlas.regions(none)).isEmpty() and atlas.metadata(atlas.regions(none)).isEmpty()
    for wrong in (lambda: atlas.sheeted(none, 0), lambda: atlas.packed(none, -1), lambda: atlas.regions(none, 0, -1)):
        with pytest.raises(ValueError):
            wrong()
