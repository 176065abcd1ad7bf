"""Batched edits: a batch is checked as a whole, then its operations are folded in
order over one raster, all or none.

Operations are rows (batch_id, idx, kind and the kind's values, see OPS). The checks
are expressions on those rows, and a batch's first error is an aggregate. Batches
without an error have MOST_OPS operations at most, so only then do they meet in a row,
beside their raster; the fold runs in that row's task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sequential, shapes

OPS = (
    "batch_id long, idx int, kind string, x int, y int, x1 int, y1 int, w int, h int, radius int, filled boolean,"
    " argb int, to int, tolerance int, thickness int, points array<struct<x:int,y:int>>"
)
#: Limits of a batch.
MOST_OPS, MOST_AREA, MOST_RADIUS, MOST_SPAN, MOST_THICKNESS = 64, 4_194_304, 65_536, 262_144, 16
KINDS = ("pixel", "line", "rect", "circle", "stroke", "fill", "replace", "erase")
#: The values that an operation can't do without, besides points.
NEEDED = {
    "pixel": ("x", "y", "argb"),
    "line": ("x", "y", "x1", "y1", "argb"),
    "rect": ("x", "y", "w", "h", "argb"),
    "circle": ("x", "y", "radius", "argb"),
    "stroke": ("argb",),
    "fill": ("x", "y", "argb"),
    "replace": ("argb", "to"),
    "erase": (),
}
_FIELDS = ["idx", "kind", "x", "y", "x1", "y1", "w", "h", "radius", "filled", "argb", "to", "tolerance", "thickness", "points"]


def label(kind: Column) -> Column:
    """What an operation is called in a history."""
    return F.concat(F.lit("batch:"), kind)


def _reason(cw: Column, ch: Column) -> Column:
    """What is wrong with an operation on a canvas of cw x ch; null: nothing."""
    x, y, x1, y1, w, h, r = (F.col(c).cast("long") for c in ("x", "y", "x1", "y1", "w", "h", "radius"))
    kind, count = F.col("kind"), F.coalesce(F.size("points"), F.lit(0))
    off = lambda a, b: (a < 0) | (b < 0) | (a >= cw) | (b >= ch)
    points = F.coalesce("points", F.array().cast("array<struct<x:int,y:int>>"))
    some = F.exists(points, lambda p: off(p["x"], p["y"]))
    needed = [F.when(kind == k, reduce(or_, [F.col(c).isNull() for c in own], F.lit(False))) for k, own in NEEDED.items()]
    missing = F.coalesce(*needed, F.lit(False)) | F.exists(points, lambda p: p.isNull() | p["x"].isNull() | p["y"].isNull())
    away = lambda a, b, c, d: (c < 0) | (a >= cw) | (d < 0) | (b >= ch)
    thickness = ~F.coalesce("thickness", F.lit(1)).between(1, MOST_THICKNESS)
    tolerance = F.coalesce("tolerance", F.lit(0)) < 0
    filled = F.coalesce("filled", F.lit(False))
    rules = [
        (~kind.isin(*KINDS) | kind.isNull(), "unknown kind"),
        (missing, "a value is missing"),
        ((kind == "pixel") & off(x, y), "outside the canvas"),
        ((kind == "line") & thickness, "thickness out of bounds"),
        ((kind == "line") & (F.greatest(F.abs(x1 - x), F.abs(y1 - y)) > MOST_SPAN), "too long"),
        ((kind == "line") & away(x, y, x1, y1), "beside the canvas"),
        ((kind == "rect") & (F.least(w, h) < 1), "an edge below 1"),
        ((kind == "rect") & (w * h > MOST_AREA), "too large"),
        ((kind == "rect") & away(x, y, x + w - 1, y + h - 1), "beside the canvas"),
        ((kind == "circle") & ((r < 0) | (r > MOST_RADIUS)), "radius out of bounds"),
        ((kind == "circle") & filled & ((2 * r + 1) * (2 * r + 1) > MOST_AREA), "too large"),
        ((kind == "circle") & away(x - r - 1, y - r - 1, x + r + 1, y + r + 1), "beside the canvas"),
        (kind.isin("stroke", "erase") & (count < 1), "no points"),
        (kind.isin("stroke", "erase") & (count > 8 * MOST_OPS), "too many points"),
        ((kind == "stroke") & thickness, "thickness out of bounds"),
        (kind.isin("stroke", "erase") & some, "a point outside the canvas"),
        (kind.isin("fill", "replace") & tolerance, "tolerance below 0"),
        ((kind == "fill") & off(x, y), "outside the canvas"),
    ]
    found = F.lit(None).cast("string")
    for wrong, text in reversed(rules):
        found = F.when(wrong, F.lit(text)).otherwise(found)
    return found


def errors(ops: DataFrame, canvases: DataFrame) -> DataFrame:
    """canvases: batch_id, w, h, locked. (batch_id, idx, error): the first error of
    each batch that has one; idx -1: of the batch as a whole. A line is looked at
    as its ends are given: with the second end left of or above the canvas it counts
    as beside it."""
    whole = ops.groupBy("batch_id").agg(F.count("*").alias("many")).join(canvases, "batch_id", "left")
    wrong = F.when(F.col("w").isNull(), "no canvas").when(F.col("many") > MOST_OPS, f"more than {MOST_OPS} operations").when(F.col("locked"), "the layer is locked")
    found = whole.select("batch_id", F.lit(-1).alias("idx"), wrong.alias("error"))
    sized = canvases.select("batch_id", F.col("w").alias("cw"), F.col("h").alias("ch"))
    each = ops.join(sized, "batch_id").select("batch_id", "idx", _reason(F.col("cw"), F.col("ch")).alias("reason"), "kind")
    each = each.select("batch_id", "idx", F.concat(F.coalesce("kind", F.lit("?")), F.lit(": "), "reason").alias("error"))
    first = F.min(F.struct("idx", "error")).alias("m")
    return found.union(each).where("error is not null").groupBy("batch_id").agg(first).select("batch_id", "m.idx", "m.error")


def _put(px: np.ndarray, points: list[tuple[int, int]], colour: int) -> np.ndarray:
    out = px.copy()
    at = np.array(points, np.int64).reshape(-1, 2)
    at = at[(at >= 0).all(1) & (at[:, 0] < px.shape[1]) & (at[:, 1] < px.shape[0])]
    out[at[:, 1], at[:, 0]] = colour
    return out


def _same(px: np.ndarray, colour: int, tolerance: int) -> np.ndarray:
    """Pixels within tolerance of a colour in all four channels."""
    parts = np.ascontiguousarray(px, np.int32).view(np.uint8).reshape(*px.shape, 4).astype(int)
    own = np.array([colour], np.int64).astype(np.int32).view(np.uint8).astype(int)
    return (np.abs(parts - own) <= tolerance).all(axis=2)


def stroke(points: list[tuple[int, int]], thickness: int) -> list[tuple[int, int]]:
    """Thick lines from point to point; one point alone is a square."""
    ends = list(zip(points, points[1:], strict=False)) or [(points[0], points[0])]
    return list(dict.fromkeys(p for a, b in ends for p in shapes.thick_line(*a, *b, thickness)))


def _drawn(px: np.ndarray, op: dict) -> np.ndarray:
    kind, x, y, colour = op["kind"], op["x"], op["y"], op["argb"]
    points = [(p["x"], p["y"]) for p in op["points"] or []]
    thickness, tolerance = op["thickness"] or 1, op["tolerance"] or 0
    if kind == "pixel":
        return _put(px, [(x, y)], colour)
    if kind == "line":
        return _put(px, shapes.thick_line(x, y, op["x1"], op["y1"], thickness), colour)
    if kind == "rect":
        return _put(px, shapes.rect(x, y, op["w"], op["h"], bool(op["filled"])), colour)
    if kind == "circle":
        return _put(px, shapes.circle(x, y, op["radius"], bool(op["filled"])), colour)
    if kind == "stroke":
        return _put(px, stroke(points, thickness), colour)
    if kind == "fill":
        return np.where(sequential._area(px, x, y, tolerance), np.int32(colour), px)
    if kind == "replace":
        return np.where(_same(px, colour, tolerance), np.int32(op["to"]), px)
    return _put(px, points, 0)


def applied(ops: DataFrame, rasters: DataFrame) -> DataFrame:
    """rasters: batch_id, w, h, pixels, locked. (batch_id, w, h, pixels, changed) of
    the batches without an error; changed: for each operation its idx, kind and whether it
    changed a pixel. Batches with an error, and rasters without a batch, are left out."""
    canvases = rasters.select("batch_id", "w", "h", "locked")
    good = ops.join(errors(ops, canvases).select("batch_id"), "batch_id", "left_anti")
    folded = good.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.struct(*_FIELDS))).alias("ops"))  # MOST_OPS at most
    base = rasters.select("batch_id", "w", "h", "pixels").join(folded, "batch_id")
    flag = pa.list_(pa.struct([("idx", pa.int32()), ("kind", pa.string()), ("changed", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made, changed = [], []
            for w, h, pixels, own in zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True):
                px, flags = np.array(pixels, np.int32).reshape(h, w), []
                for op in own:
                    new = _drawn(px, op)
                    flags.append({"idx": op["idx"], "kind": op["kind"], "changed": bool((new != px).any())})
                    px = new
                made.append(px.ravel())
                changed.append(flags)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(made, pa.list_(pa.int32())), pa.array(changed, flag)], ["batch_id", "w", "h", "pixels", "changed"])

    kind = base.schema["batch_id"].dataType.simpleString()
    return base.mapInArrow(run, f"batch_id {kind}, w int, h int, pixels array<int>, changed array<struct<idx:int,kind:string,changed:boolean>>")


def outcomes(done: DataFrame) -> DataFrame:
    """(batch_id, idx, label, changed) of each operation that was carried out."""
    flat = done.select("batch_id", F.explode("changed").alias("c"))
    return flat.select("batch_id", "c.idx", label(F.col("c.kind")).alias("label"), "c.changed")
