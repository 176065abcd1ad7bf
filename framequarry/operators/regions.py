"""Rectangles of rasters: paste, move, mirror; and effects that shift frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import colour as C
from ..sources.frames import numbered
from .raster import Raster, on_grid, regridded, same_h, same_w


def _within(x: Column, y: Column, box: tuple[int, int, int, int]) -> Column:
    x0, y0, w, h = box
    return (x >= x0) & (x < x0 + w) & (y >= y0) & (y < y0 + h)


def flipped(frames: DataFrame, box: tuple[int, int, int, int], vertical: bool = False) -> DataFrame:
    """A rectangle (x, y, w, h) mirrored in place."""
    x0, y0, w, h = box

    def source(r: Raster, x: Column, y: Column) -> tuple[Column, Column]:
        mx, my = (x, 2 * y0 + h - 1 - y) if vertical else (2 * x0 + w - 1 - x, y)
        inside = _within(x, y, box) & r.inside(mx, my)
        return F.when(inside, mx).otherwise(x), F.when(inside, my).otherwise(y)

    return regridded(frames, same_w, same_h, source)


def moved(frames: DataFrame, box: tuple[int, int, int, int], dx: int, dy: int) -> DataFrame:
    """A rectangle cut out and put down elsewhere, transparent pixels included."""
    x0, y0, w, h = box

    def pixel(r: Raster, x: Column, y: Column) -> Column:
        put = _within(x, y, (x0 + dx, y0 + dy, w, h)) & r.inside(x - dx, y - dy)
        return F.when(put, r.at(x - dx, y - dy)).when(_within(x, y, box), F.lit(0)).otherwise(r.at(x, y))

    return on_grid(frames, same_w, same_h, pixel)


def pasted(pairs: DataFrame, x0: int, y0: int) -> DataFrame:
    """`after` put over `before` with its corner at (x0, y0); both have the size
    of the pair."""

    def made(s: Column) -> Column:
        def pixel(p: Column, i: Column) -> Column:
            x, y = (i % s["w"]).cast("int") - x0, C.idiv(i, s["w"]) - y0
            inside = (x >= 0) & (y >= 0) & (x < s["w"]) & (y < s["h"])
            return F.when(inside, F.get(s["after"], (y * s["w"] + x).cast("int"))).otherwise(p)

        return F.transform(s["before"], pixel)

    return pairs.select("frame_id", "w", "h", C.let(F.struct("w", "h", "before", "after"), made).alias("pixels"))


def _shifted(frames: DataFrame, dx: Column, dy: Column) -> DataFrame:
    with_shift = frames.withColumns({"dx": dx.cast("int"), "dy": dy.cast("int")})
    out = with_shift.select("*", F.struct("w", "h", "pixels", "dx", "dy").alias("__s"))

    def made(s: Column) -> Column:
        r = Raster(s)

        def pixel(i: Column) -> Column:
            x, y = (i % r.w).cast("int") - s["dx"], C.idiv(i, r.w) - s["dy"]
            return F.when(r.inside(x, y), r.at(x, y)).otherwise(F.lit(0))

        return F.transform(F.sequence(F.lit(0), r.w * r.h - 1), pixel)

    return out.withColumn("pixels", C.let(F.col("__s"), made)).select(*frames.columns)


def shaken(frames: DataFrame, amplitude: int = 1, speed: int = 2) -> DataFrame:
    """Each frame `speed` times, shifted right and left by turns: with `step`."""
    steps = frames.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(speed - 1))))
    return _shifted(steps, F.when(F.col("step") % 2 == 0, amplitude).otherwise(-amplitude), F.lit(0))


def swayed(frames: DataFrame, amplitude: int = 1, wavelength: int = 4, vertical: bool = False) -> DataFrame:
    """Frames shifted by a sine of their place in the timeline, rounded half up."""
    offset = F.floor(amplitude * F.sin(F.lit(6.283185307179586) * F.col("place") / wavelength) + 0.5)
    rows = numbered(frames)
    return _shifted(rows, F.lit(0) if vertical else offset, offset if vertical else F.lit(0)).select(*frames.columns)


def scanned(frames: DataFrame, colour: int) -> DataFrame:
    """A row of colour over each frame, at the row of its place in the timeline."""
    rows = numbered(frames).select("*", F.struct("w", "h", "pixels", "place").alias("__s"))

    def made(s: Column) -> Column:
        return F.transform(s["pixels"], lambda p, i: F.when(C.idiv(i, s["w"]) == s["place"] % s["h"], C.blended(F.lit(colour), p)).otherwise(p))

    return rows.withColumn("pixels", C.let(F.col("__s"), made)).select(*frames.columns)


def shelved(boxes: DataFrame, width: int, key: str = "tag") -> DataFrame:
    """boxes: key, name, w, h. Rows of a sheet of the given width, highest boxes
    first; a box goes on the shelf that the width before it has reached."""
    order = Window.partitionBy(key).orderBy(F.desc("h"), "name").rowsBetween(Window.unboundedPreceding, -1)
    before = boxes.withColumn("before", F.coalesce(F.sum("w").over(order), F.lit(0)))
    return before.select(key, "name", "w", "h", C.idiv(F.col("before"), width).alias("shelf"), (F.col("before") % width).cast("int").alias("x"))
