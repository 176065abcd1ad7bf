"""Shapes as tables of points, and their writing into rasters.

A shape is a row; its points come from a table function, and the last shape that
covers a pixel wins, by partial aggregation over (frame, pixel).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.frames import dealt

MOST_POINTS = 4_194_304
_POINTS_A_BATCH = 65_536
SHAPES = "frame_id long, ord long, kind string, a int, b int, c int, d int, argb int"


def line(x0: int, y0: int, x1: int, y1: int) -> list[tuple[int, int]]:
    """Bresenham's line, both ends included."""
    dx, dy = abs(x1 - x0), -abs(y1 - y0)
    if max(dx, -dy) > 262_144:
        raise ValueError("the line is too long")
    step_x, step_y, error, out = 1 if x0 < x1 else -1, 1 if y0 < y1 else -1, dx + dy, [(x0, y0)]
    while (x0, y0) != (x1, y1):
        twice = 2 * error
        if twice >= dy:
            error, x0 = error + dy, x0 + step_x
        if twice <= dx:
            error, y0 = error + dx, y0 + step_y
        out.append((x0, y0))
    return out


def rect(x: int, y: int, w: int, h: int, filled: bool) -> list[tuple[int, int]]:
    if w < 1 or h < 1 or (w * h if filled else 2 * (w + h)) > MOST_POINTS:
        raise ValueError("the rectangle's size is out of bounds")
    if filled:
        return [(i, j) for j in range(y, y + h) for i in range(x, x + w)]
    edge = {(i, j) for i in range(x, x + w) for j in (y, y + h - 1)} | {(i, j) for j in range(y, y + h) for i in (x, x + w - 1)}
    return sorted(edge)


def circle(cx: int, cy: int, r: int, filled: bool) -> list[tuple[int, int]]:
    """The midpoint circle; filled: each row from its first to its last point."""
    if not 0 <= r <= 65_536 or filled and (2 * r + 1) ** 2 > MOST_POINTS:
        raise ValueError("the radius is out of bounds")
    x, y, decision, edge = 0, r, 1 - r, set()
    while x <= y:
        edge |= {(cx + sx * i, cy + sy * j) for i, j in ((x, y), (y, x)) for sx in (1, -1) for sy in (1, -1)}
        if decision < 0:
            decision += 2 * x + 3
        else:
            decision += 2 * (x - y) + 5
            y -= 1
        x += 1
    if not filled:
        return sorted(edge)
    rows: dict[int, list[int]] = {}
    for i, j in edge:
        rows.setdefault(j, []).append(i)
    return [(i, j) for j, own in rows.items() for i in range(min(own), max(own) + 1)]


def closed_path(corners: list[tuple[float, float]]) -> list[tuple[int, int]]:
    """Lines from corner to corner and back to the first, each point once."""
    own = [(int(np.floor(x + 0.5)), int(np.floor(y + 0.5))) for x, y in corners]
    return list(dict.fromkeys(p for a, b in zip(own, own[1:] + own[:1], strict=True) for p in line(*a, *b)))


def polygon(cx: int, cy: int, radius: int, sides: int) -> list[tuple[int, int]]:
    if not 3 <= sides <= 4096 or radius < 0:
        raise ValueError("a polygon has 3 to 4096 sides and a radius of 0 or more")
    return closed_path([(cx + radius * np.cos(2 * np.pi * k / sides), cy + radius * np.sin(2 * np.pi * k / sides)) for k in range(sides)])


def star(cx: int, cy: int, outer: int, inner: int, tips: int = 5) -> list[tuple[int, int]]:
    if not 2 <= tips <= 4096 or min(outer, inner) < 0:
        raise ValueError("a star has 2 to 4096 tips and radii of 0 or more")
    radii = [outer, inner] * tips
    return closed_path([(cx + r * np.cos(np.pi * k / tips), cy + r * np.sin(np.pi * k / tips)) for k, r in enumerate(radii)])


def ellipse(x: int, y: int, w: int, h: int, filled: bool) -> list[tuple[int, int]]:
    """The midpoint ellipse in a box; filled: each row from its first to its last
    point. A box one pixel wide or high is a line."""
    if not (1 <= w <= 65_536 and 1 <= h <= 65_536) or filled and w * h > MOST_POINTS:
        raise ValueError("the ellipse's size is out of bounds")
    if 1 in (w, h):
        return rect(x, y, w, h, True)
    rx, ry = w // 2, h // 2
    i, j, whole, quarter = 0, ry, 4 * rx * rx * ry * ry, []
    while ry * ry * i < rx * rx * j:  # flatter than 45 degrees: a point a column
        quarter.append((i, j))
        i, j = i + 1, j - (4 * ry * ry * (i + 1) ** 2 + rx * rx * (2 * j - 1) ** 2 >= whole)
    while j > 0:  # steeper: a point a row
        quarter.append((i, j))
        i, j = i + (ry * ry * (2 * i + 1) ** 2 + 4 * rx * rx * (j - 1) ** 2 <= whole), j - 1
    quarter.append((i, 0))
    edge = {(x + rx + sx * i, y + ry + sy * j) for i, j in quarter for sx in (1, -1) for sy in (1, -1)}
    if not filled:
        return sorted(edge)
    reach: dict[int, int] = {}
    for i, j in quarter:
        reach[j] = max(i, reach.get(j, 0))
    return sorted({(x + rx + k, y + ry + sy * j) for j, i in reach.items() for k in range(-i, i + 1) for sy in (1, -1)})


def thick_line(x0: int, y0: int, x1: int, y1: int, thickness: int) -> list[tuple[int, int]]:
    """Lines side by side, each moved across by a whole step; a line of no length
    is a square."""
    if not 1 <= thickness <= 256:
        raise ValueError("the thickness is 1 to 256")
    half, length = (thickness - 1) // 2, float(np.hypot(x1 - x0, y1 - y0))
    if not length:
        return rect(x0 - half, y0 - half, thickness, thickness, True)
    nearest = lambda v: int(np.floor(v + 0.5))
    moves = [(nearest((k - half) * (y0 - y1) / length), nearest((k - half) * (x1 - x0) / length)) for k in range(thickness)]
    return list(dict.fromkeys(p for dx, dy in moves for p in line(x0 + dx, y0 + dy, x1 + dx, y1 + dy)))


def arc(cx: int, cy: int, radius: int, start: float, sweep: float) -> list[tuple[int, int]]:
    """Part of a circle from an angle over a sweep, in degrees, as short lines
    between points a pixel or four degrees apart at most."""
    if radius < 0:
        raise ValueError("the radius is 0 or more")
    if not sweep:
        return []
    steps = min(65_536, max(1, int(np.ceil(abs(sweep) / min(4.0, 57.29577951308232 / max(radius, 1))))))
    turn = np.radians(start + sweep * np.arange(steps + 1) / steps)
    at = [(int(x), int(y)) for x, y in zip(np.floor(cx + radius * np.cos(turn) + 0.5), np.floor(cy + radius * np.sin(turn) + 0.5), strict=True)]
    return list(dict.fromkeys([at[0], *(p for a, b in zip(at, at[1:], strict=False) for p in line(*a, *b))]))


def rounded_rect(x: int, y: int, w: int, h: int, radius: int) -> list[tuple[int, int]]:
    """The edge of a rectangle whose corners are quarters of midpoint circles."""
    if w < 1 or h < 1 or 2 * (w + h) > MOST_POINTS or not 0 <= radius <= min(w, h) // 2:
        raise ValueError("the rectangle's size or radius is out of bounds")
    if not radius:
        return rect(x, y, w, h, False)
    right, low, r = x + w - 1, y + h - 1, radius
    sides = {(i, j) for i in range(x + r, right - r + 1) for j in (y, low)} | {(i, j) for j in range(y + r + 1, low - r) for i in (x, right)}
    quarter = [(i, j) for i, j in circle(0, 0, r, False) if i >= 0 and j >= 0]
    corners = {(cx + sx * i, cy + sy * j) for cx, sx in ((right - r, 1), (x + r, -1)) for cy, sy in ((low - r, 1), (y + r, -1)) for i, j in quarter}
    return sorted(sides | corners)


def _each_once(shapes: DataFrame, keys: list[str], at: Callable[[Column], Column], steps: int) -> DataFrame:
    """The distinct points (keys, x, y) of curves: at makes a point of a curve's row
    out of a step. Equal curves are one. A curve that is alone under its keys has its
    points told apart within its row, so no point is shuffled; only those of curves
    that share their keys meet in a shuffle."""
    own = dealt(shapes, *keys).distinct().withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    flat = own.select(*keys, "__n", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(steps)), at))).alias("p"))
    flat = flat.select(*keys, "__n", "p.x", "p.y").where("x >= 0 and y >= 0")
    return flat.where("__n = 1").drop("__n").union(flat.where("__n > 1").drop("__n").distinct())


def curves(table: DataFrame, steps: int = 32) -> DataFrame:
    """(frame_id, ord, x, y, argb): samples of quadratic curves x0, y0 to x2, y2
    with the control point x1, y1; each point once, negative ones dropped."""
    def at(k: Column) -> Column:
        t = k / steps
        u = 1.0 - t
        return F.struct(*[F.floor(u * u * F.col(f"{c}0") + 2.0 * u * t * F.col(f"{c}1") + t * t * F.col(f"{c}2") + 0.5).cast("int").alias(c) for c in "xy"])

    own = table.select("frame_id", "ord", *[f"{c}{i}" for c in "xy" for i in range(3)], "argb")
    return _each_once(own, ["frame_id", "ord", "argb"], at, steps).select("frame_id", "ord", "x", "y", "argb")


def _points(kind: str, a: int, b: int, c: int, d: int, e: int) -> list[tuple[int, int]]:
    if kind == "line":
        return line(a, b, c, d)
    if kind in ("rect", "rect_filled"):
        return rect(a, b, c, d, kind == "rect_filled")
    if kind in ("circle", "circle_filled"):
        return circle(a, b, c, kind == "circle_filled")
    if kind == "polygon":
        return polygon(a, b, c, d)
    if kind == "star":
        return star(a, b, c, d)
    if kind in ("ellipse", "ellipse_filled"):
        return ellipse(a, b, c, d, kind == "ellipse_filled")
    if kind == "thick_line":
        return thick_line(a, b, c, d, e)
    if kind == "arc":
        return arc(a, b, c, d, e)
    if kind == "rounded_rect":
        return rounded_rect(a, b, c, d, e)
    raise ValueError(f"no shape {kind!r}")


def points(shapes: DataFrame) -> DataFrame:
    """(frame_id, ord, x, y, argb) of a table of shapes: line a, b to c, d; rect
    and rect_filled at a, b of the size c, d; circle and circle_filled round a, b
    of the radius c; polygon round a, b of the radius c with d sides; star of five
    tips round a, b of the radii c and d; ellipse and ellipse_filled in the box at
    a, b of the size c, d; with a column e: thick_line a, b to c, d of the thickness
    e, arc round a, b of the radius c from d over e degrees, rounded_rect at a, b of
    the size c, d and the radius e. Points of negative coordinates are dropped."""
    if "e" not in shapes.columns:
        shapes = shapes.withColumn("e", F.lit(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, found = 0, []
            for *of, kind, a, b, c, d, e, argb in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                own = np.array(_points(kind, a, b, c, d, e), np.int32).reshape(-1, 2)
                own = own[(own >= 0).all(axis=1)]
                found.append((*of, argb, own))
                held += len(own)
                if held >= _POINTS_A_BATCH:
                    yield _batch(found)
                    held, found = 0, []
            if found:
                yield _batch(found)

    columns = ["frame_id", "ord", "kind", *[F.col(c).cast("int") for c in ("a", "b", "c", "d", "e", "argb")]]
    return dealt(shapes.na.fill(0, ["d", "e"]).select(*columns)).mapInArrow(run, "frame_id long, ord long, x int, y int, argb int")


def _batch(found: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
    """Rows of the points of some shapes: frame_id, ord, argb and points of each."""
    frame, order, argb, own = zip(*found, strict=True)
    at = np.repeat(np.arange(len(own)), [len(p) for p in own])
    flat = np.concatenate(own)
    columns = [pa.array(frame, pa.int64()).take(at), pa.array(order, pa.int64()).take(at), pa.array(flat[:, 0]), pa.array(flat[:, 1]), pa.array(argb, pa.int32()).take(at)]
    return pa.RecordBatch.from_arrays(columns, ["frame_id", "ord", "x", "y", "argb"])


def drawn(frames: DataFrame, shapes: DataFrame) -> DataFrame:
    """frames with shapes written over them in their order; what lies outside is
    dropped. A raster's own writes meet it in one join on the key."""
    last = points(shapes).groupBy("frame_id", "x", "y").agg(F.max_by("argb", "ord").alias("argb"))
    writes = last.groupBy("frame_id").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("x", "y"), "argb"))).alias("__w"))
    joined = frames.join(writes, "frame_id", "left").withColumn("__s", F.struct("w", "pixels", "__w"))

    def made(s):
        def pixel(p, i):
            at = F.struct((i % s["w"]).cast("int").alias("x"), (i / s["w"]).cast("int").alias("y"))
            return F.coalesce(F.element_at(s["__w"], at), p)

        return F.when(s["__w"].isNull(), s["pixels"]).otherwise(F.transform(s["pixels"], pixel))

    from ..functions.colour import let

    return joined.withColumn("pixels", let(F.col("__s"), made)).select(*frames.columns)


def span_filled(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y): each row from its first to its last point."""
    rows = points.groupBy(*keys, "y").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return rows.select(*keys, F.explode(F.sequence("lo", "hi")).alias("x"), "y")


def cubic(curves_: DataFrame, steps: int = 48) -> DataFrame:
    """curves_: keys and x0..x3, y0..y3. The distinct points (keys, x, y) of cubic
    curves, those below 0 left out."""
    keys = [c for c in curves_.columns if c not in {f"{a}{i}" for a in "xy" for i in range(4)}]

    def at(k: Column) -> Column:
        t = k / float(steps)
        u = 1.0 - t
        weights = [u * u * u, 3.0 * u * u * t, 3.0 * u * t * t, t * t * t]
        return F.struct(*[F.floor(sum((w * F.col(f"{a}{i}") for i, w in enumerate(weights[1:], 1)), weights[0] * F.col(f"{a}0")) + 0.5).cast("int").alias(a) for a in "xy"])

    return _each_once(curves_, keys, at, steps)


def polygons_filled(corners: DataFrame, keys: list[str], w: int, h: int) -> DataFrame:
    """corners: keys, ord, x, y. The points (keys, x, y) inside polygons, by
    crossings of each row's middle; the corners of a polygon meet in one window,
    the rows of a crossing in another."""
    order = Window.partitionBy(*keys).orderBy("ord")
    whole = Window.partitionBy(*keys)
    nxt = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    edges = corners.select(*keys, "x", "y", nxt("x").alias("x2"), nxt("y").alias("y2"), F.count("*").over(whole).alias("n")).where("n >= 3 and y <> y2")
    down = F.col("y") < F.col("y2")
    pick = lambda a, b: F.when(down, F.col(a)).otherwise(F.col(b))
    edges = edges.select(*keys, pick("x", "x2").alias("xa"), pick("y", "y2").alias("ya"), pick("x2", "x").alias("xb"), pick("y2", "y").alias("yb"))
    rows = edges.withColumn("row", F.explode(F.sequence(F.greatest(F.lit(0), F.col("ya")), F.col("yb") - 1))).where(F.col("row") < h)
    rows = rows.where((F.col("row") >= F.col("ya")) & (F.col("row") < F.col("yb")))
    slope = (F.col("xb") - F.col("xa")) / (F.col("yb") - F.col("ya")).cast("double")
    met = rows.select(*keys, "row", (F.col("xa") + (F.col("row") + 0.5 - F.col("ya")) * slope).alias("cross"))
    met = met.groupBy(*keys, "row").agg(F.sort_array(F.collect_list("cross")).alias("xs"))
    spans = met.select(*keys, "row", F.explode(F.filter(F.transform("xs", lambda v, i: F.when(i % 2 == 0, F.struct(v.alias("a"), F.get("xs", i + 1).alias("b")))), lambda s: s["b"].isNotNull())).alias("s"))
    first, last = F.greatest(F.lit(0), F.ceil(F.col("s.a") - 0.5).cast("int")), F.least(F.lit(w - 1), F.ceil(F.col("s.b") - 0.5).cast("int") - 1)
    return spans.select(*keys, "row", first.alias("a"), last.alias("b")).where("a <= b").select(*keys, F.explode(F.sequence("a", "b")).alias("x"), F.col("row").alias("y"))
