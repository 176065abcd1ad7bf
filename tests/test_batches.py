"""Batched edits against a plain fold."""

from __future__ import annotations

import random

from framequarry.operators import batches, shapes
from framequarry.plans import batched

FOLDER = "/root/testdata/sf0.001"
CANVAS = "batch_id long, w int, h int, pixels array<int>, locked boolean"
FIELDS = [f.split()[0] for f in batches.OPS.split(", ")]
FIELDS[-1] = "points"


def op(batch: int, idx: int, kind: str | None, **values) -> tuple:
    given = {"batch_id": batch, "idx": idx, "kind": kind} | values
    return tuple(given.get(c) for c in FIELDS)


def signed(v: int) -> int:
    return v - (1 << 32) if v >> 31 else v


def channels(v: int) -> list[int]:
    return [v >> s & 255 for s in (0, 8, 16, 24)]


def flood(px: list[int], w: int, h: int, x: int, y: int, tolerance: int) -> set[int]:
    near = lambda i: all(abs(a - b) <= tolerance for a, b in zip(channels(px[i]), channels(px[y * w + x]), strict=True))
    seen, todo = {y * w + x}, [(x, y)]
    while todo:
        a, b = todo.pop()
        for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
            if 0 <= c < w and 0 <= d < h and d * w + c not in seen and near(d * w + c):
                seen.add(d * w + c)
                todo.append((c, d))
    return seen


def touched(px: list[int], w: int, h: int, o) -> tuple[set[int], int]:
    points = [(p["x"], p["y"]) for p in o["points"] or []]
    thickness, tolerance = o["thickness"] or 1, o["tolerance"] or 0
    if o["kind"] == "fill":
        return flood(px, w, h, o["x"], o["y"], tolerance), o["argb"]
    if o["kind"] == "replace":
        alike = lambda p: all(abs(a - b) <= tolerance for a, b in zip(channels(p), channels(o["argb"]), strict=True))
        return {i for i, p in enumerate(px) if alike(p)}, o["to"]
    if o["kind"] == "pixel":
        put = [(o["x"], o["y"])]
    elif o["kind"] == "line":
        put = shapes.thick_line(o["x"], o["y"], o["x1"], o["y1"], thickness)
    elif o["kind"] == "rect":
        sides = lambda i, j: o["filled"] or i in (0, o["w"] - 1) or j in (0, o["h"] - 1)
        put = [(o["x"] + i, o["y"] + j) for i in range(o["w"]) for j in range(o["h"]) if sides(i, j)]
    elif o["kind"] == "circle":
        put = shapes.circle(o["x"], o["y"], o["radius"], bool(o["filled"]))
    elif o["kind"] == "stroke":
        ends = list(zip(points, points[1:], strict=False)) or [(points[0], points[0])]
        put = [p for a, b in ends for p in shapes.thick_line(*a, *b, thickness)]
    else:
        put = points
    return {y * w + x for x, y in put if 0 <= x < w and 0 <= y < h}, 0 if o["kind"] == "erase" else o["argb"]


def folded(ops, rasters, bad: set[int]) -> tuple[dict[int, list[int]], dict[int, list[tuple]]]:
    """Rasters after their batches, and each operation's flag."""
    by, pixels, flags = {}, {}, {}
    for o in ops:
        by.setdefault(o["batch_id"], []).append(o)
    for r in rasters:
        if r["batch_id"] in by and r["batch_id"] not in bad:
            px, done = list(r["pixels"]), []
            for o in sorted(by[r["batch_id"]], key=lambda o: o["idx"]):
                at, colour = touched(px, r["w"], r["h"], o)
                done.append((o["idx"], "batch:" + o["kind"], any(px[i] != colour for i in at)))
                for i in at:
                    px[i] = colour
            pixels[r["batch_id"]], flags[r["batch_id"]] = px, done
    return pixels, flags


def test_whole_tables_against_a_plain_fold(spark):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    ops, rasters = batched.operations(events).collect(), batched.canvases(spark, FOLDER).collect()
    bad = {r.batch_id for r in batched.batch_errors(spark, FOLDER).collect()}
    pixels, flags = folded(ops, rasters, bad)
    assert pixels and bad and {o["kind"] for o in ops if o["batch_id"] in pixels} == set(batches.KINDS)
    got: dict[int, list[int]] = {k: [0] * 64 for k in pixels}
    rows = batched.batch_pixels(spark, FOLDER).collect()
    assert len(rows) == 64 * len(pixels)
    for r in rows:
        got[r.frame_id][r.y * 8 + r.x] = r.argb
    assert got == pixels
    out: dict[int, list[tuple]] = {}
    for r in batched.batch_outcomes(spark, FOLDER).collect():
        out.setdefault(r.batch_id, []).append((r.idx, r.label, r.changed))
    assert {k: sorted(v) for k, v in out.items()} == flags


def test_random_batches_of_uneven_rasters(spark):
    rng, rows, rasters = random.Random(5), [], []
    for b in range(12):
        w, h = 3 + b, 14 - b
        rasters.append((b, w, h, [signed(rng.choice([0, 0xFF000000, 0xFF0A0A0A, 0xFFFF0000])) for _ in range(w * h)], False))
        for i in rng.sample(range(100), 5 + b):
            at = lambda w=w, h=h: {"x": rng.randrange(w), "y": rng.randrange(h)}
            own = at() | {"x1": rng.randrange(w), "y1": rng.randrange(h), "w": rng.randint(1, 9), "h": rng.randint(1, 9), "radius": rng.randint(0, 6), "filled": rng.random() < 0.5}
            own |= {"argb": signed(rng.choice([0, 0xFF000000, 0xFF00FF00])), "to": signed(0xFF123456), "tolerance": rng.choice([None, 0, 12]), "thickness": rng.choice([None, 1, 4])}
            rows.append(op(b, i, rng.choice(batches.KINDS), **own, points=[at() for _ in range(rng.randint(1, 4))]))
    ops, canvas = spark.createDataFrame(rows, batches.OPS), spark.createDataFrame(rasters, CANVAS)
    assert batches.errors(ops, canvas).isEmpty()
    pixels, _ = folded(ops.collect(), canvas.collect(), set())
    assert {r.batch_id: r.pixels for r in batches.applied(ops, canvas).collect()} == pixels


def test_checks(spark):
    """All or none: the first error by place is told, and nothing of its batch is drawn."""
    fine = {"x": 1, "y": 1, "argb": -1}
    long = [{"x": 0, "y": 0}] * 513
    rows = [
        op(0, 0, "pixel", **fine), op(0, 5, "pixel", x=4, y=0, argb=-1), op(0, 2, None),
        op(1, 0, "pixel", x=None, y=1, argb=-1),
        op(2, 0, "rect", **fine, w=70_000, h=70_000),
        op(3, 0, "circle", **fine, radius=2_000, filled=True),
        op(4, 0, "circle", **fine, radius=70_000),
        op(5, 0, "line", x=0, y=0, x1=300_000, y1=0, argb=-1),
        op(6, 0, "stroke", argb=-1, points=long),
        op(7, 0, "erase", points=[]),
        *[op(8, i, "pixel", **fine) for i in range(65)],
        *[op(9, i, "pixel", **fine) for i in range(64)],
        op(10, 0, "pixel", **fine),
        op(11, 0, "pixel", **fine),
        op(12, 0, "circle", x=2, y=2, radius=2_000, argb=-1),
        op(13, 0, "erase", points=[{"x": 1, "y": None}]),
    ]
    ops = spark.createDataFrame(rows, batches.OPS)
    canvas = spark.createDataFrame([(b, 4, 4, [0] * 16, b == 10) for b in range(20) if b != 11], CANVAS)
    told = {r.batch_id: (r.idx, r.error) for r in batches.errors(ops, canvas).collect()}
    assert told == {
        0: (2, "?: unknown kind"),
        1: (0, "pixel: a value is missing"),
        2: (0, "rect: too large"),
        3: (0, "circle: too large"),
        4: (0, "circle: radius out of bounds"),
        5: (0, "line: too long"),
        6: (0, "stroke: too many points"),
        7: (0, "erase: no points"),
        8: (-1, "more than 64 operations"),
        10: (-1, "the layer is locked"),
        11: (-1, "no canvas"),
        13: (0, "erase: a value is missing"),
    }
    done = batches.applied(ops, canvas)
    assert {r.batch_id: sum(p != 0 for p in r.pixels) for r in done.collect()} == {9: 1, 12: 0}
    assert [r.changed for r in batches.outcomes(done).where("batch_id = 9").orderBy("idx").collect()] == [True] + [False] * 63


def test_empty_tables(spark):
    ops, canvas = spark.createDataFrame([], batches.OPS), spark.createDataFrame([], CANVAS)
    assert batches.errors(ops, canvas).isEmpty() and batches.applied(ops, canvas).isEmpty()
