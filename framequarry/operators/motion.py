"""Effects that stretch, light up or turn the colours of frames, rotation by
shears, chains of halved sizes, and strips that compare ways of seeing.

All but the turning of colours, which needs a frame's place in its tag's
timeline, are expressions on the row: no shuffle, no Python.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colour as C
from ..functions import harmony
from ..sources.frames import numbered
from . import effects, filters, raster, regions, timeline
from .raster import Raster

GLOW = 0x80  # fixed value: alpha of the first step of a glow


def _half_up(v: Column) -> Column:
    """Rounded to the nearest in single precision, halves away from zero."""
    v = v.cast("float")
    half = F.lit(0.5).cast("float")
    return F.when(v >= 0, (v + half).cast("int")).otherwise(-((-v + half).cast("int")))


Box = Callable[[Column, Column], tuple[Column, Column]]


def rescaled_content(frames: DataFrame, size: Box, grounded: bool) -> DataFrame:
    """What is visible in each raster, brought to size(width, height) of its box
    on the same canvas: on the box's ground line, or round its centre. A raster
    without anything visible stays as it is."""

    def source(at: Column, start: Column, span: Column, old_start: Column, old_span: Column) -> Column:
        t = ((at - start) / (span - 1)).cast("float")
        return old_start + F.when(span <= 1, C.idiv(old_span - 1, 2)).otherwise(_half_up(t * (old_span - 1).cast("float")))

    def made(s: Column) -> Column:
        r = Raster(s)

        def placed(b: Column) -> Column:
            bw, bh = b["x1"] - b["x0"] + 1, b["y1"] - b["y0"] + 1
            tw, th = (F.greatest(F.lit(1), v.cast("int")) for v in size(bw, bh))
            top = b["y1"] - th + 1 if grounded else b["y0"] + C.idiv(bh - th, 2)
            return F.struct(b["x0"].alias("x0"), b["y0"].alias("y0"), bw.alias("bw"), bh.alias("bh"), tw.alias("tw"), th.alias("th"), (b["x0"] + C.idiv(bw - tw, 2)).alias("tx"), top.alias("ty"))

        def drawn(t: Column) -> Column:
            def pixel(i: Column) -> Column:
                x, y = (i % r.w).cast("int"), C.idiv(i, r.w)
                inside = (x >= t["tx"]) & (x < t["tx"] + t["tw"]) & (y >= t["ty"]) & (y < t["ty"] + t["th"])
                return F.when(inside, r.at(source(x, t["tx"], t["tw"], t["x0"], t["bw"]), source(y, t["ty"], t["th"], t["y0"], t["bh"]))).otherwise(F.lit(0))

            same = (t["tw"] == t["bw"]) & (t["th"] == t["bh"])
            return F.when(same | t["bw"].isNull(), s["pixels"]).otherwise(F.transform(F.sequence(F.lit(0), r.w * r.h - 1), pixel))

        return C.let(raster.content(s), lambda b: C.let(placed(b), drawn))

    return frames.withColumn("pixels", C.let(F.struct("w", "h", "pixels"), made))


def _phases(first: DataFrame, *rest: DataFrame) -> DataFrame:
    out = first.withColumn("phase", F.lit(0))
    for k, part in enumerate(rest, 1):
        out = out.unionByName(part.withColumn("phase", F.lit(k)))
    return out


def squashed(frames: DataFrame, up: int = 1, down: int = 2) -> DataFrame:
    """Each frame (phase 0), then (phase 1) its content up/down as high and
    down/up as wide, standing on the same line. More than 1 stretches."""
    if not (1 <= up <= 1024 and 1 <= down <= 1024):
        raise ValueError("a factor's parts are 1 to 1024")
    return _phases(frames, rescaled_content(frames, lambda w, h: (_half_up(w * down / up), _half_up(h * up / down)), grounded=True))


def pulsed(frames: DataFrame, amplitude: int = 1) -> DataFrame:
    """Each frame (phase 0), its content larger (1) and smaller (2) on all sides."""
    if amplitude < 1:
        raise ValueError("the amplitude is 1 or more")
    grown = [rescaled_content(frames, lambda w, h, g=g: (w + 2 * g, h + 2 * g), grounded=False) for g in (amplitude, -amplitude)]
    return _phases(frames, *grown)


def glowing(frames: DataFrame, colour: int, steps: int = 4) -> DataFrame:
    """Steps of a glow in the transparent pixels that touch content at a side,
    its alpha halved from one to the next; the last step has none."""
    if not 2 <= steps <= 1024:
        raise ValueError("steps are 2 to 1024")
    levels = F.array(*[F.lit(0 if k == steps - 1 else GLOW >> k) for k in range(steps)])
    phased = frames.withColumn("phase", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("level", F.get(levels, F.col("phase")))

    def rule(p: Column, n: raster.Neighbour, x: Column, y: Column) -> Column:
        touches = F.lit(False)
        for dx, dy in raster.CROSS3:
            touches |= raster.visible(n(dx, dy))
        return F.when((C.alpha(p) == 0) & touches & (F.col("level") > 0), F.shiftleft(F.col("level"), 24).bitwiseOR(F.lit(colour & 0xFFFFFF))).otherwise(p)

    return raster.stencil(phased, rule).drop("level")


def rainbow(frames: DataFrame) -> DataFrame:
    """Frame k of the n in a tag's timeline (by frame_id) with all hues turned by
    k/n of a circle in CIELAB; what sRGB lacks is clipped."""
    counts = frames.groupBy("tag").agg(F.count("*").alias("__n"))
    placed = numbered(frames).join(counts, "tag")
    angle = F.lit(2 * math.pi) * F.col("place") / F.col("__n")

    def turned(t: Column) -> Column:
        def pixel(p: Column) -> Column:
            moved = C.let(C.lab(p), lambda s: harmony.from_lab(harmony.lab_of(s["l"], s["a"] * t["c"] - s["b"] * t["s"], s["a"] * t["s"] + s["b"] * t["c"])))
            return F.when(C.alpha(p) == 0, F.lit(0)).otherwise(p.bitwiseAND(F.lit(C.BLACK)).bitwiseOR(moved.bitwiseAND(F.lit(0xFFFFFF))))

        return F.when(t["k"] == 0, F.col("pixels")).otherwise(F.transform("pixels", pixel))

    return placed.withColumn("pixels", C.let(F.struct(F.col("place").alias("k"), F.cos(angle).alias("c"), F.sin(angle).alias("s")), turned)).drop("place", "__n")


def _low(v: Column) -> Column:
    return F.least(F.lit(0), F.floor(v).cast("int"))


def _shear(span: Column, factor: float) -> tuple[Column, Column]:
    """How far a shear over a span reaches before 0, and by how much it widens."""
    far = (span - 1) * F.lit(factor)
    return _low(far), F.greatest(F.lit(0), F.ceil(far).cast("int")) - _low(far)


def sheared_x(frames: DataFrame, factor: float) -> DataFrame:
    """Row y moved by y * factor, rounded half up, on a canvas that holds it all."""
    if abs(factor) < 1e-12:
        return frames
    return raster.regridded(frames, lambda r: r.w + _shear(r.h, factor)[1], raster.same_h, lambda r, x, y: (x - F.floor(y * F.lit(factor) + 0.5).cast("int") + _shear(r.h, factor)[0], y))


def sheared_y(frames: DataFrame, factor: float) -> DataFrame:
    """Column x moved by x * factor, as in `sheared_x`."""
    if abs(factor) < 1e-12:
        return frames
    return raster.regridded(frames, raster.same_w, lambda r: r.h + _shear(r.w, factor)[1], lambda r, x, y: (x, y - F.floor(x * F.lit(factor) + 0.5).cast("int") + _shear(r.w, factor)[0]))


def quarters(degrees: float) -> tuple[int, float]:
    """An angle as quarter turns (0 to 3) and the degrees that are left."""
    theta = math.fmod(degrees, 360)
    theta += 360 if theta <= -180 else -360 if theta > 180 else 0
    turns = math.floor(theta / 90 + 0.5)
    return turns % 4, theta - turns * 90


def rotated_by_shears(frames: DataFrame, degrees: float, crop: bool = False) -> DataFrame:
    """Rotation that only moves pixels: quarter turns, then three shears. With
    crop the middle is cut out at the old size."""
    if not math.isfinite(degrees):
        raise ValueError("the angle must be finite")
    turns, rest = quarters(degrees)
    out = frames.withColumn("__w", F.col("w")).withColumn("__h", F.col("h"))
    out = {0: lambda f: f, 1: raster.rot90, 2: raster.rot180, 3: lambda f: raster.rot90(f, clockwise=False)}[turns](out)
    if abs(rest) >= 1e-9:
        k, s = -math.tan(math.radians(rest) / 2), math.sin(math.radians(rest))
        out = sheared_x(sheared_y(sheared_x(out, k), s), k)
    if crop:
        out = raster.regridded(out, lambda r: F.col("__w"), lambda r: F.col("__h"), lambda r, x, y: (x + C.idiv(r.w - F.col("__w"), 2), y + C.idiv(r.h - F.col("__h"), 2)))
    return out.drop("__w", "__h")


def halved_chain(frames: DataFrame, most: int = 9) -> DataFrame:
    """Each raster and its halvings by area, down to a side of 1 or `most` levels,
    as rows with `level`. One expression: a level is worked out from the last."""
    if most < 1:
        raise ValueError("there is one level at least")

    def longer(levels: Column) -> Column:
        def with_half(last: Column) -> Column:
            w, h = C.idiv(last["w"], 2), C.idiv(last["h"], 2)
            return F.when((w < 1) | (h < 1), levels).otherwise(F.concat(levels, F.array(filters.area_means(Raster(last), w, h))))

        return C.let(F.element_at(levels, -1), with_half)

    own = F.array(F.struct("w", "h", "pixels"))
    chain = F.aggregate(F.sequence(F.lit(1), F.lit(most - 1)), own, lambda acc, _: longer(acc)) if most > 1 else own
    rest = [c for c in frames.columns if c not in ("w", "h", "pixels")]
    return frames.select(*rest, F.posexplode(chain).alias("level", "__r")).select(*rest, "level", "__r.w", "__r.h", "__r.pixels")


def seen_by_all(frames: DataFrame, w: int = 24, h: int = 24, severity: float = 1.0) -> DataFrame:
    """Five cells of w x h one after the other in row order of a canvas five
    cells wide: the raster as it is, then as seen with each deficiency."""
    kinds = ("protan", "deutan", "tritan", "achromat")

    def pixel(r: Raster, x: Column, y: Column) -> Column:
        i = y * (5 * w) + x
        cell, j = C.idiv(i, w * h), (i % (w * h)).cast("int")
        p = r.at(F.least(r.w - 1, C.idiv((j % w) * r.w, w)), F.least(r.h - 1, C.idiv(C.idiv(j, w) * r.h, h)))

        def seen(c: Column) -> Column:
            out = F.when(cell == 0, c)
            for k, kind in enumerate(kinds, 1):
                out = out.when(cell == k, C.simulated(c, kind, severity))
            return out

        return C.let(p, seen)

    return raster.on_grid(frames, lambda r: F.lit(5 * w), lambda r: F.lit(h), pixel)


EFFECTS: dict[str, Callable[..., DataFrame]] = {
    "bounce": timeline.bounced, "shake": regions.shaken, "wave": regions.swayed, "fade": timeline.fade, "squash": squashed,
    "stretch": lambda frames, up=2, down=1: squashed(frames, up, down), "pulse": pulsed, "orbit": effects.orbited, "float": effects.floated,
    "glow": glowing, "scanline": regions.scanned, "typewriter": timeline.typewriter, "blink": effects.blinked, "rainbow": rainbow,
}


def applied(frames: DataFrame, name: str, *options: object, **named: object) -> DataFrame:
    """An effect by its name, in any case, with its options in order or by name."""
    key = name.strip().lower()
    if key not in EFFECTS:
        raise ValueError(f"no effect {name!r}; there are {', '.join(EFFECTS)}")
    return EFFECTS[key](frames, *options, **named)
