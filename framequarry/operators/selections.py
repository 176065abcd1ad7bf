"""Rectangular selections as columns (x, y, w, h), and selections by colour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colour as C
from .sequential import flood_area


def box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"), w.cast("int").alias("w"), h.cast("int").alias("h"))


def is_empty(s: Column) -> Column:
    return (s["w"] <= 0) | (s["h"] <= 0)


def inset(s: Column, d: int) -> Column:
    """Smaller by d on each side, but never less than its middle."""

    def side(at: Column, size: Column) -> tuple[Column, Column]:
        low = F.least(at + d, at + C.idiv(size, 2))
        high = F.greatest(at + size - d, at + C.idiv(size + 1, 2))
        return low, F.greatest(F.lit(1), high - low)

    (x, w), (y, h) = side(s["x"], s["w"]), side(s["y"], s["h"])
    return F.when(is_empty(s), s).otherwise(box(x, y, w, h)) if d else s


def expanded(s: Column, d: int) -> Column:
    return box(s["x"] - d, s["y"] - d, s["w"] + 2 * d, s["h"] + 2 * d)


def translated(s: Column, dx: int, dy: int) -> Column:
    return box(s["x"] + dx, s["y"] + dy, s["w"], s["h"])


def _spanned(s: Column, t: Column, low, high) -> tuple[Column, Column, Column, Column]:
    x, y = low(s["x"], t["x"]), low(s["y"], t["y"])
    return x, y, high(s["x"] + s["w"], t["x"] + t["w"]) - x, high(s["y"] + s["h"], t["y"] + t["h"]) - y


def united(s: Column, t: Column) -> Column:
    """The least rectangle round both; an empty one adds nothing."""
    return F.when(is_empty(s), t).when(is_empty(t), s).otherwise(box(*_spanned(s, t, F.least, F.greatest)))


def met(s: Column, t: Column) -> Column:
    """What both have in common, perhaps empty."""
    x, y, w, h = _spanned(s, t, F.greatest, F.least)
    return box(x, y, F.greatest(F.lit(0), w), F.greatest(F.lit(0), h))


def meets(s: Column, t: Column) -> Column:
    return ~is_empty(met(s, t))


def contains(s: Column, x: Column, y: Column) -> Column:
    return (x >= s["x"]) & (x < s["x"] + s["w"]) & (y >= s["y"]) & (y < s["y"] + s["h"])


def clipped(s: Column, w: int, h: int) -> Column:
    return met(s, box(F.lit(0), F.lit(0), F.lit(w), F.lit(h)))


def outline(selections: DataFrame, column: str = "box") -> DataFrame:
    """The points (x, y) on the edge of each selection, once each."""
    s = F.col(column)
    rest = [c for c in selections.columns if c != column]
    some = selections.where(~is_empty(s))
    x = F.explode(F.sequence(s["x"], s["x"] + s["w"] - 1)).alias("x")
    points = some.select(*rest, column, x).select(*rest, column, "x", F.explode(F.sequence(s["y"], s["y"] + s["h"] - 1)).alias("y"))
    edge = (F.col("x") == s["x"]) | (F.col("x") == s["x"] + s["w"] - 1) | (F.col("y") == s["y"]) | (F.col("y") == s["y"] + s["h"] - 1)
    return points.where(edge).select(*rest, "x", "y")


def by_colour(frames: DataFrame, x: int, y: int, tolerance: int = 0) -> DataFrame:
    """(frame_id, x, y, width, height): the box of the area round a place within
    tolerance of its colour (4 neighbours)."""
    area = flood_area(frames, x, y, tolerance)
    flat = area.select("frame_id", "w", F.posexplode_outer("pixels").alias("i", "hit")).where("hit = 1")
    px, py = (F.col("i") % F.col("w")).cast("int"), C.idiv(F.col("i"), F.col("w"))
    out = flat.select("frame_id", px.alias("x"), py.alias("y")).groupBy("frame_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return out.select("frame_id", F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0") + 1).alias("width"), (F.col("y1") - F.col("y0") + 1).alias("height"))
