"""Effects and clean-ups of whole rasters: rotation, overlays, strays, motion.

Within a raster all is one expression on its array; an effect over time adds a
row for each step and needs no shuffle. Those that depend on a frame's place in
its timeline take that from `sources.frames.numbered`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colour as C
from ..sources.frames import numbered
from . import raster

SOLID = 128


def rotated(frames: DataFrame, degrees: float, expand: bool = True) -> DataFrame:
    """Turned clockwise by any angle: quarter turns first, the rest by looking up
    each new pixel's centre in the old raster."""
    turn = degrees % 360
    turn -= 360 if turn > 180 else 0
    quarter = math.floor(turn / 90 + 0.5)
    rest = turn - 90 * quarter
    now = {0: lambda f: f, 1: raster.rot90, 2: raster.rot180, 3: lambda f: raster.rot90(f, False)}[quarter % 4](frames)
    if abs(rest) < 1e-9:
        return now
    cos, sin = math.cos(math.radians(rest)), math.sin(math.radians(rest))

    def grown(across: float, down: float) -> raster.Size:
        def size(r: raster.Raster) -> Column:
            u, v = r.w / 2.0 * across, r.h / 2.0 * down
            return F.greatest(F.lit(1), (2.0 * F.greatest(F.abs(u + v), F.abs(u - v)) + 0.5).cast("int"))

        return size

    w, h = (grown(cos, sin), grown(sin, cos)) if expand else (raster.same_w, raster.same_h)

    def source(r: raster.Raster, x: Column, y: Column) -> tuple[Column, Column]:
        dx, dy = x + 0.5 - w(r) / 2.0, y + 0.5 - h(r) / 2.0
        return F.floor(dx * cos + dy * sin + r.w / 2.0).cast("int"), F.floor(-dx * sin + dy * cos + r.h / 2.0).cast("int")

    return raster.regridded(now, w, h, source)


def silhouette(frames: DataFrame, colour: int) -> DataFrame:
    """Visible pixels take a colour and keep their alpha."""
    return raster.mapped(frames, lambda p: F.when(C.alpha(p) == 0, p).otherwise(p.bitwiseAND(F.lit(C.BLACK)).bitwiseOR(F.lit(colour & 0xFFFFFF))))


def mirrored(frames: DataFrame) -> DataFrame:
    """The left half, reflected over the right one."""
    return raster.regridded(frames, raster.same_w, raster.same_h, lambda r, x, y: (F.least(x, r.w - 1 - x), y))


def scanlines(frames: DataFrame, dark: int = 0x30000000) -> DataFrame:
    """A colour laid over each second row, on what is solid."""
    return raster.stencil(frames, lambda p, n, x, y: F.when((y % 2 == 1) & (C.alpha(p) >= SOLID), C.blended(F.lit(dark), p)).otherwise(p))


def vignette(frames: DataFrame, strength: float = 0.5) -> DataFrame:
    """Black laid over what is solid, the more the farther from the middle."""

    def pixel(r: raster.Raster, x: Column, y: Column) -> Column:
        cx, cy = (r.w - 1) / 2.0, (r.h - 1) / 2.0
        corner = F.greatest(F.sqrt(cx * cx + cy * cy), F.lit(1.0))
        far = F.least(F.lit(1.0), F.sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy)) / corner)
        alpha = C.clamp8((strength * (1.0 - F.cos(far * (math.pi / 2))) * 255.0 + 0.5).cast("int"))
        p = r.at(x, y)
        return F.when(C.alpha(p) < SOLID, p).otherwise(C.let(alpha, lambda a: F.when(a == 0, p).otherwise(C.blended(F.lit(0), p, "normal", a))))

    return raster.on_grid(frames, raster.same_w, raster.same_h, pixel)


def outlined_where(frames: DataFrame, mask: int, colour: int, inner: bool = False, eight: bool = True) -> DataFrame:
    """An outline round pixels of one exact colour only. Outer: transparent
    pixels beside them; inner: those of them beside transparency or the border."""
    taps = raster.SQUARE3 if eight else raster.CROSS3

    def rule(p: Column, n: raster.Neighbour, x: Column, y: Column) -> Column:
        beside, gap = F.lit(False), F.lit(False)
        for dx, dy in taps:
            beside |= F.coalesce(n(dx, dy) == mask, F.lit(False))
            gap |= F.coalesce(C.alpha(n(dx, dy)), F.lit(0)) < SOLID
        hit = (p == mask) & gap if inner else (C.alpha(p) < SOLID) & beside
        return F.when(hit, F.lit(colour)).otherwise(p)

    return raster.stencil(frames, rule)


def without_strays(frames: DataFrame) -> DataFrame:
    """A solid pixel equal to none of its four neighbours takes the commonest of
    them (outside: transparent), of equals the first of up, down, left, right."""

    def rule(p: Column, n: raster.Neighbour, x: Column, y: Column) -> Column:
        votes = F.array(*[F.coalesce(n(dx, dy), F.lit(0)) for dx, dy in ((0, -1), (0, 1), (-1, 0), (1, 0))])

        def voted(v: Column) -> Column:
            ranked = F.transform(v, lambda c, k: F.struct(F.size(F.filter(v, lambda o: o == c)).alias("n"), (-k).alias("k"), c.alias("c")))
            return F.when(F.array_contains(v, p) | (C.alpha(p) < SOLID), p).otherwise(F.array_max(ranked)["c"])

        return C.let(votes, voted)

    return raster.stencil(frames, rule)


def without_faint(frames: DataFrame) -> DataFrame:
    """Alpha below one half becomes none."""
    return raster.mapped(frames, lambda p: F.when(C.alpha(p) < SOLID, F.lit(0)).otherwise(p))


def selection_turned(frames: DataFrame, x0: int, y0: int, side: int) -> DataFrame:
    """A square of the raster turned clockwise in place."""

    def source(r: raster.Raster, x: Column, y: Column) -> tuple[Column, Column]:
        inside = (x >= x0) & (x < x0 + side) & (y >= y0) & (y < y0 + side)
        return F.when(inside, y - y0 + x0).otherwise(x), F.when(inside, x0 + side - 1 - x + y0).otherwise(y)

    return raster.regridded(frames, raster.same_w, raster.same_h, source)


def _swing(turns: Column, amplitude: int) -> Column:
    return F.round((F.sin(turns * (2 * math.pi)) * amplitude).cast("float")).cast("int")


def floated(frames: DataFrame, amplitude: int = 1, wavelength: int = 8) -> DataFrame:
    """Frames of a timeline bob up and down along a sine."""
    return _shifted_by(numbered(frames), F.lit(0), _swing(F.col("place") / wavelength, amplitude)).select(*frames.columns)


def rippled(frames: DataFrame, amplitude: int = 1, wavelength: int = 4) -> DataFrame:
    """Each row shifted along a sine that runs down the raster and over time."""
    placed = numbered(frames).withColumn("__row", F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda y: _swing((F.col("place") + y) / wavelength, amplitude)))

    def row_shifted(p: Column, i: Column) -> Column:
        x, y = (i % F.col("w")).cast("int"), C.idiv(i, F.col("w"))
        return C.let(x - F.get("__row", y), lambda sx: F.when((sx >= 0) & (sx < F.col("w")), F.get("pixels", (y * F.col("w") + sx).cast("int"))).otherwise(F.lit(0)))

    return placed.withColumn("pixels", F.transform("pixels", row_shifted)).select(*frames.columns)


def orbited(frames: DataFrame, radius: int = 2, steps: int = 8) -> DataFrame:
    """A row for each step on a circle: the column step is added."""
    each = frames.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    return _shifted_by(each, _swing(F.col("step") / steps + 0.25, radius), _swing(F.col("step") / steps, radius))


def blinked(frames: DataFrame, closed: int = 1) -> DataFrame:
    """Each frame followed by blank ones: the column step is 0 for the frame."""
    each = frames.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(closed))))
    return each.withColumn("pixels", F.when(F.col("step") == 0, F.col("pixels")).otherwise(F.transform("pixels", lambda p: F.lit(0))))


def _shifted_by(frames: DataFrame, dx: Column, dy: Column) -> DataFrame:
    """Every raster by its own offset."""
    both = frames.withColumn("__dx", dx).withColumn("__dy", dy)

    def moved(p: Column, i: Column) -> Column:
        x, y = (i % F.col("w")).cast("int") - F.col("__dx"), C.idiv(i, F.col("w")) - F.col("__dy")
        ok = (x >= 0) & (x < F.col("w")) & (y >= 0) & (y < F.col("h"))
        return F.when(ok, F.get("pixels", (y * F.col("w") + x).cast("int"))).otherwise(F.lit(0))

    return both.withColumn("pixels", F.transform("pixels", moved)).drop("__dx", "__dy")
