"""Operators on rasters at rest: pointwise maps, geometry and stencils.

All of them are expressions on the pixel array of a row: no shuffle, no Python,
and a chain of them is one stage however long it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colour as C

Neighbour = Callable[[int, int], Column]
SQUARE3 = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dx, dy) != (0, 0)]
CROSS3 = [(-1, 0), (0, -1), (1, 0), (0, 1)]
SQUARE5 = [(dx, dy) for dy in range(-2, 3) for dx in range(-2, 3) if (dx, dy) != (0, 0)]


def mapped(frames: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    return frames.withColumn("pixels", F.transform("pixels", lambda p: f(p)))


def on_grid(frames: DataFrame, w: Size, h: Size, pixel: Callable[[Raster, Column, Column], Column]) -> DataFrame:
    """Rasters of the size w x h (functions of the old raster) whose pixels are
    pixel(raster, x, y). The old raster is bound once for all of them."""

    def made(s: Column) -> Column:
        old = Raster(s)
        new_w, new_h = w(old).cast("int"), h(old).cast("int")
        cells = F.transform(F.sequence(F.lit(0), new_w * new_h - 1), lambda i: pixel(old, (i % new_w).cast("int"), C.idiv(i, new_w)))
        return F.struct(new_w.alias("w"), new_h.alias("h"), cells.alias("pixels"))

    rest = [c for c in frames.columns if c not in ("w", "h", "pixels")]
    out = frames.select(*rest, C.let(F.struct("w", "h", "pixels"), made).alias("__r"))
    return out.select(*rest, "__r.w", "__r.h", "__r.pixels")


class Raster:
    """A raster within an expression."""

    def __init__(self, s: Column):
        self.w, self.h, self._pixels = s["w"], s["h"], s["pixels"]

    def inside(self, x: Column, y: Column) -> Column:
        return (x >= 0) & (x < self.w) & (y >= 0) & (y < self.h)

    def at(self, x: Column, y: Column) -> Column:
        return F.get(self._pixels, (y * self.w + x).cast("int"))


Size = Callable[[Raster], Column]


def same_w(r: Raster) -> Column:
    return r.w


def same_h(r: Raster) -> Column:
    return r.h


def regridded(frames: DataFrame, w: Size, h: Size, source: Callable[[Raster, Column, Column], tuple[Column, Column]]) -> DataFrame:
    """Rasters whose pixel (x, y) is what source(raster, x, y) points at (outside
    the old raster: transparent)."""

    def pixel(r: Raster, x: Column, y: Column) -> Column:
        sx, sy = source(r, x, y)
        return F.when(r.inside(sx, sy), r.at(sx, sy)).otherwise(F.lit(0))

    return on_grid(frames, w, h, pixel)


def flip_h(frames: DataFrame) -> DataFrame:
    return regridded(frames, same_w, same_h, lambda r, x, y: (r.w - 1 - x, y))


def flip_v(frames: DataFrame) -> DataFrame:
    return regridded(frames, same_w, same_h, lambda r, x, y: (x, r.h - 1 - y))


def rot180(frames: DataFrame) -> DataFrame:
    return regridded(frames, same_w, same_h, lambda r, x, y: (r.w - 1 - x, r.h - 1 - y))


def rot90(frames: DataFrame, clockwise: bool = True) -> DataFrame:
    if clockwise:
        return regridded(frames, same_h, same_w, lambda r, x, y: (y, r.h - 1 - x))
    return regridded(frames, same_h, same_w, lambda r, x, y: (r.w - 1 - y, x))


def shifted(frames: DataFrame, dx: int, dy: int) -> DataFrame:
    return regridded(frames, same_w, same_h, lambda r, x, y: (x - dx, y - dy))


def region(frames: DataFrame, x0: int, y0: int, w: int, h: int) -> DataFrame:
    """A rectangle, padded with transparent pixels where it leaves the raster."""
    return regridded(frames, lambda r: F.lit(w), lambda r: F.lit(h), lambda r, x, y: (x + x0, y + y0))


def padded(frames: DataFrame, left: int, top: int, right: int, bottom: int) -> DataFrame:
    return regridded(frames, lambda r: r.w + left + right, lambda r: r.h + top + bottom, lambda r, x, y: (x - left, y - top))


def scaled(frames: DataFrame, factor: int) -> DataFrame:
    return regridded(frames, lambda r: r.w * factor, lambda r: r.h * factor, lambda r, x, y: (C.idiv(x, factor), C.idiv(y, factor)))


def resampled(frames: DataFrame, w: int, h: int, centred: bool = True) -> DataFrame:
    """Nearest neighbour, by pixel centres or by corners."""

    def source(r: Raster, x: Column, y: Column) -> tuple[Column, Column]:
        if centred:
            sx, sy = F.floor((x + 0.5) * r.w / w), F.floor((y + 0.5) * r.h / h)
        else:
            sx, sy = C.idiv(x * r.w, w), C.idiv(y * r.h, h)
        return F.least(r.w - 1, sx.cast("int")), F.least(r.h - 1, sy.cast("int"))

    return regridded(frames, lambda r: F.lit(w), lambda r: F.lit(h), source)


def pixel_at(frames: DataFrame, x: int, y: int) -> DataFrame:
    """(frame_id, argb) at a place; outside a raster 0."""
    inside = (F.lit(x) >= 0) & (F.lit(x) < F.col("w")) & (F.lit(y) >= 0) & (F.lit(y) < F.col("h"))
    return frames.select("frame_id", F.when(inside, F.get("pixels", (F.lit(y) * F.col("w") + x).cast("int"))).otherwise(F.lit(0)).alias("argb"))


def content(r: Column) -> Column:
    """Struct x0, y0, x1, y1: the box of what is visible in a raster (a struct w,
    h, pixels); nulls if nothing is."""
    on = F.filter(F.transform(r["pixels"], lambda p, i: F.when(C.alpha(p) > 0, i)), lambda i: i.isNotNull())

    def box(s: Column) -> Column:
        xs = F.transform(s, lambda i: (i % r["w"]).cast("int"))
        return F.struct(F.array_min(xs).alias("x0"), F.array_max(xs).alias("x1"), C.idiv(F.array_min(s), r["w"]).alias("y0"), C.idiv(F.array_max(s), r["w"]).alias("y1"))

    return C.let(on, box)


def trimmed(frames: DataFrame) -> DataFrame:
    """Each raster cut to the box of what is visible in it; a raster without
    anything visible stays as it is."""
    rest = [c for c in frames.columns if c not in ("w", "h", "pixels")]

    def cut(r: Column) -> Column:
        def within(b: Column) -> Column:
            w, h = b["x1"] - b["x0"] + 1, b["y1"] - b["y0"] + 1
            cells = F.transform(F.sequence(F.lit(0), w * h - 1), lambda i: F.get(r["pixels"], ((b["y0"] + C.idiv(i, w)) * r["w"] + b["x0"] + (i % w).cast("int")).cast("int")))
            return F.when(b["x0"].isNull(), r).otherwise(F.struct(w.cast("int").alias("w"), h.cast("int").alias("h"), cells.alias("pixels")))

        return C.let(content(r), within)

    out = frames.select(*rest, C.let(F.struct("w", "h", "pixels"), cut).alias("__r"))
    return out.select(*rest, "__r.w", "__r.h", "__r.pixels")


def stencil(frames: DataFrame, f: Callable[[Column, Neighbour, Column, Column], Column]) -> DataFrame:
    """f(pixel, neighbour, x, y): neighbour(dx, dy) is null outside the raster."""

    def pixel(r: Raster, x: Column, y: Column) -> Column:
        def neighbour(dx: int, dy: int) -> Column:
            return F.when(r.inside(x + dx, y + dy), r.at(x + dx, y + dy))

        return C.let(r.at(x, y), lambda p: f(p, neighbour, x, y))

    return on_grid(frames, same_w, same_h, pixel)


def visible(c: Column) -> Column:
    return F.coalesce(C.alpha(c), F.lit(0)) > 0


def dilate(frames: DataFrame, taps: list[tuple[int, int]] = SQUARE3) -> DataFrame:
    """A transparent pixel takes the neighbour of most alpha, the first in the
    order of the taps."""

    def rule(p: Column, n: Neighbour, x: Column, y: Column) -> Column:
        best = F.array_max(F.array(*[F.struct(F.coalesce(C.alpha(n(dx, dy)), F.lit(0)).alias("a"), F.lit(-k).alias("k"), F.coalesce(n(dx, dy), F.lit(0)).alias("c")) for k, (dx, dy) in enumerate(taps)]))
        return F.when(visible(p), p).otherwise(F.when(best["a"] > 0, best["c"]).otherwise(p))

    return stencil(frames, rule)


def erode(frames: DataFrame, taps: list[tuple[int, int]] = SQUARE3) -> DataFrame:
    """A pixel stays if all taps lie inside and are opaque to some degree."""

    def rule(p: Column, n: Neighbour, x: Column, y: Column) -> Column:
        keep = visible(p)
        for dx, dy in taps:
            keep &= visible(n(dx, dy))
        return F.when(keep, p).otherwise(F.lit(0))

    return stencil(frames, rule)


def opened(frames: DataFrame, taps: list[tuple[int, int]] = SQUARE3) -> DataFrame:
    return dilate(erode(frames, taps), taps)


def closed(frames: DataFrame, taps: list[tuple[int, int]] = SQUARE3) -> DataFrame:
    return erode(dilate(frames, taps), taps)


def without_isolated(frames: DataFrame, only_orthogonal: bool = False) -> DataFrame:
    """Pixels without any neighbour go; with only_orthogonal also those that
    have diagonal neighbours only."""
    taps = CROSS3 if only_orthogonal else SQUARE3

    def rule(p: Column, n: Neighbour, x: Column, y: Column) -> Column:
        some = F.lit(False)
        for dx, dy in taps:
            some |= visible(n(dx, dy))
        return F.when(visible(p) & ~some, F.lit(0)).otherwise(p)

    return stencil(frames, rule)


def cleaned(frames: DataFrame) -> DataFrame:
    return opened(closed(without_isolated(frames)), CROSS3)


def outline_mask(frames: DataFrame, taps: list[tuple[int, int]] = SQUARE3) -> DataFrame:
    """What an erosion takes away."""

    def rule(p: Column, n: Neighbour, x: Column, y: Column) -> Column:
        keep = visible(p)
        for dx, dy in taps:
            keep &= visible(n(dx, dy))
        return F.when(visible(p) & ~keep, p).otherwise(F.lit(0))

    return stencil(frames, rule)


def outlined(frames: DataFrame, colour: int, inner: bool = False, eight: bool = True) -> DataFrame:
    """A ring of colour round what is opaque (alpha 0x80 or more), or on its edge;
    what lies outside the raster counts as transparent."""
    taps = SQUARE3 if eight else CROSS3

    def solid(c: Column) -> Column:
        return F.coalesce(C.alpha(c), F.lit(0)) >= 128

    def rule(p: Column, n: Neighbour, x: Column, y: Column) -> Column:
        some, every = F.lit(False), F.lit(True)
        for dx, dy in taps:
            some |= solid(n(dx, dy))
            every &= solid(n(dx, dy))
        hit = solid(p) & ~every if inner else ~solid(p) & some
        return F.when(hit, F.lit(colour)).otherwise(p)

    return stencil(frames, rule)


def scale2x(frames: DataFrame) -> DataFrame:
    """Twice the size: a corner takes the colour that two adjacent neighbours
    share, unless opposite neighbours are equal. Borders repeat."""

    def pixel(r: Raster, ox: Column, oy: Column) -> Column:
        x, y = C.idiv(ox, 2), C.idiv(oy, 2)

        def at(dx: int, dy: int) -> Column:
            return r.at(F.least(r.w - 1, F.greatest(F.lit(0), x + dx)), F.least(r.h - 1, F.greatest(F.lit(0), y + dy)))

        up, left, right, down = at(0, -1), at(-1, 0), at(1, 0), at(0, 1)
        around = F.struct(up.alias("u"), left.alias("l"), right.alias("r"), down.alias("d"))

        def rule(n: Column) -> Column:
            near_x, near_y = F.when(ox % 2 == 0, n["l"]).otherwise(n["r"]), F.when(oy % 2 == 0, n["u"]).otherwise(n["d"])
            return F.when((n["u"] != n["d"]) & (n["l"] != n["r"]) & (near_x == near_y), near_x).otherwise(r.at(x, y))

        return C.let(around, rule)

    return on_grid(frames, lambda r: r.w * 2, lambda r: r.h * 2, pixel)


def scale3x(frames: DataFrame) -> DataFrame:
    """Three times the size: a corner of the block takes the colour that its two
    adjacent neighbours share unless opposite ones are equal, and where the
    diagonal neighbour differs from both, the diagonal's. Borders repeat."""

    def pixel(r: Raster, ox: Column, oy: Column) -> Column:
        x, y = C.idiv(ox, 3), C.idiv(oy, 3)
        dx, dy = (ox % 3).cast("int") - 1, (oy % 3).cast("int") - 1

        def at(i: Column | int, j: Column | int) -> Column:
            return r.at(F.least(r.w - 1, F.greatest(F.lit(0), x + i)), F.least(r.h - 1, F.greatest(F.lit(0), y + j)))

        around = F.struct(at(dx, 0).alias("side"), at(0, dy).alias("end"), at(-dx, 0).alias("far_side"), at(0, -dy).alias("far_end"), at(dx, dy).alias("slant"), r.at(x, y).alias("own"))

        def rule(n: Column) -> Column:
            shared = (dx != 0) & (dy != 0) & (n["side"] == n["end"]) & (n["side"] != n["far_end"]) & (n["end"] != n["far_side"])
            return F.when(~shared, n["own"]).when(n["slant"] != n["side"], n["slant"]).otherwise(n["side"])

        return C.let(around, rule)

    return on_grid(frames, lambda r: r.w * 3, lambda r: r.h * 3, pixel)


def extruded(frames: DataFrame, amount: int) -> DataFrame:
    """A border of a width that repeats the edge pixels."""

    def source(r: Raster, x: Column, y: Column) -> tuple[Column, Column]:
        return F.least(r.w - 1, F.greatest(F.lit(0), x - amount)), F.least(r.h - 1, F.greatest(F.lit(0), y - amount))

    return regridded(frames, lambda r: r.w + 2 * amount, lambda r: r.h + 2 * amount, source)


#: Ordered-dither matrices.
BAYER = {
    2: [0, 2, 3, 1],
    4: [0, 8, 2, 10, 12, 4, 14, 6, 3, 11, 1, 9, 15, 7, 13, 5],
}
BAYER[8] = [4 * BAYER[4][y % 4 * 4 + x % 4] + BAYER[2][y // 4 * 2 + x // 4] for y in range(8) for x in range(8)]


def snapped(p: Column, rgb: Column, palette: list[int]) -> Column:
    """The palette colour nearest to rgb in CIELAB (the first of equals) with the
    upper alpha of p."""
    entries = [(k, q, *lab_of(q)) for k, q in enumerate(palette)]

    def nearest(c: Column) -> Column:
        options = [F.struct(((c["l"] - x) * (c["l"] - x) + (c["a"] - y) * (c["a"] - y) + (c["b"] - z) * (c["b"] - z)).alias("d"), F.lit(k).alias("k"), F.lit(q & 0xFFFFFF).alias("q")) for k, q, x, y, z in entries]
        return F.array_min(F.array(*options))["q"]

    found = F.get(F.transform(F.array(C.lab(rgb)), nearest), F.lit(0))
    return p.bitwiseAND(F.lit(C.BLACK)).bitwiseOR(found)


def lab_of(c: int) -> tuple[float, float, float]:
    """CIELAB of a constant."""

    def linear(v: int) -> float:
        s = v / 255
        return s / 12.92 if s <= 0.04045 else ((s + 0.055) / 1.055) ** 2.4

    r, g, b = linear(c >> 16 & 255), linear(c >> 8 & 255), linear(c & 255)
    x = (0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047
    y = 0.2126729 * r + 0.7151522 * g + 0.0721750 * b
    z = (0.0193339 * r + 0.1191920 * g + 0.9503041 * b) / 1.08883
    f = [t ** (1 / 3) if t > 0.008856 else (903.3 * t + 16) / 116 for t in (x, y, z)]
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def _perturbed(frames: DataFrame, palette: list[int], amount: Callable[[Column, Column], Column]) -> DataFrame:
    def rule(p: Column, n: Neighbour, x: Column, y: Column) -> Column:
        moved = [C.clamp8((c(p) + amount(x, y)).cast("int")) for c in (C.red, C.green, C.blue)]
        return F.when(C.alpha(p) < 128, p).otherwise(snapped(p, C.pack(F.lit(255), *moved), palette))

    return stencil(frames, rule)


def bayer(frames: DataFrame, palette: list[int], size: int = 4, strength: float = 1.0) -> DataFrame:
    """Ordered dither by a threshold matrix; pixels below alpha 0x80 stay."""
    matrix = F.array(*[F.lit(v) for v in BAYER[size]])
    return _perturbed(frames, palette, lambda x, y: ((F.get(matrix, ((y % size) * size + x % size).cast("int")) + 0.5) / (size * size) - 0.5) * 63.75 * strength)


def checkered(frames: DataFrame, palette: list[int], strength: float = 1.0) -> DataFrame:
    """Dither that lightens and darkens alternate pixels by 32."""
    return _perturbed(frames, palette, lambda x, y: F.when((x + y) % 2 == 0, F.lit(32.0 * strength)).otherwise(F.lit(-32.0 * strength)))


def palette_mapped(frames: DataFrame, palette: list[int]) -> DataFrame:
    """Pixels of alpha 0x80 or more become the nearest palette colour in CIELAB;
    the palette is a literal of bounded size."""
    return mapped(frames, lambda p: F.when(C.alpha(p) < 128, p).otherwise(snapped(p, p, palette)))


def audited(frames: DataFrame, tolerance: int = 0) -> DataFrame:
    """A row for each finding of the rules that look at a pixel's surroundings:
    frame_id, rule, x, y, argb."""

    def same(a: Column, b: Column) -> Column:
        return F.coalesce((C.alpha(a) > 0) & (C.alpha(b) > 0) & (C.chebyshev(a, b) <= tolerance), F.lit(False))

    def isolated(p: Column, n: Neighbour, x: Column, y: Column) -> Column:
        some = F.lit(False)
        for dx, dy in SQUARE3:
            some |= same(p, n(dx, dy))
        return visible(p) & ~some

    def corner(p: Column, n: Neighbour, x: Column, y: Column) -> Column:
        tr, bl, br = n(1, 0), n(0, 1), n(1, 1)
        bridged = same(tr, p) | same(bl, p) | same(tr, br) | same(bl, br)
        return same(p, br) & ~bridged

    def checker(p: Column, n: Neighbour, x: Column, y: Column) -> Column:
        tr, bl, br = n(1, 0), n(0, 1), n(1, 1)
        return F.coalesce(visible(p) & (p == br) & ~(visible(tr) & (tr == p)) & ~(visible(bl) & (bl == p)) & ~(visible(tr) & visible(bl) & (tr == bl)), F.lit(False))

    def zigzag(p: Column, n: Neighbour, x: Column, y: Column) -> Column:
        straight, slant = F.lit(False), F.lit(False)
        for dx, dy in SQUARE3:
            if dx and dy:
                slant |= visible(n(dx, dy))
            else:
                straight |= visible(n(dx, dy))
        return visible(p) & ~straight & slant

    found = {"isolated_pixel": isolated, "broken_corner": corner, "accidental_checker": checker, "stair_zigzag": zigzag}
    flags = stencil(frames, lambda p, n, x, y: F.struct(p.alias("argb"), *[f(p, n, x, y).alias(k) for k, f in found.items()]))
    flat = flags.select("frame_id", "w", F.posexplode_outer("pixels").alias("i", "f"))
    rules = F.filter(F.array(*[F.when(F.col(f"f.{k}"), F.lit(k)) for k in found]), lambda r: r.isNotNull())
    flat = flat.select("frame_id", F.explode(rules).alias("rule"), (F.col("i") % F.col("w")).cast("int").alias("x"), C.idiv(F.col("i"), F.col("w")).alias("y"), F.col("f.argb").alias("argb"))
    return flat


def grown(frames: DataFrame, colour: int, iterations: int = 1) -> DataFrame:
    """Transparent pixels next to others (4 neighbours) take a colour, again and
    again."""

    def rule(p: Column, n: Neighbour, x: Column, y: Column) -> Column:
        some = F.lit(False)
        for dx, dy in CROSS3:
            some |= visible(n(dx, dy))
        return F.when(~visible(p) & some, F.lit(colour)).otherwise(p)

    for _ in range(iterations):
        frames = stencil(frames, rule)
    return frames


def shrunk(frames: DataFrame, iterations: int = 1) -> DataFrame:
    """Pixels next to transparency or the border (4 neighbours) go."""
    for _ in range(iterations):
        frames = erode(frames, CROSS3)
    return frames


def block_means(frames: DataFrame, factor: int) -> DataFrame:
    """Rasters smaller by a whole factor: the mean of each block with colours
    weighted by alpha; what is left over at the edges is dropped."""
    nothing = F.struct(*[F.lit(0).alias(c) for c in "argb"])

    def pixel(r: Raster, x: Column, y: Column) -> Column:
        def add(acc: Column, k: Column) -> Column:
            p = r.at(x * factor + k % factor, y * factor + C.idiv(k, factor))
            return F.struct((acc["a"] + C.alpha(p)).alias("a"), *[(acc[n] + C.idiv(f(p) * C.alpha(p), 255)).alias(n) for n, f in (("r", C.red), ("g", C.green), ("b", C.blue))])

        def packed(s: Column) -> Column:
            mean = C.clamp8(C.idiv(s["a"] + factor * factor // 2, factor * factor))
            return F.when(mean == 0, F.lit(0)).otherwise(C.pack(mean, *[C.clamp8((s[n] / F.greatest(s["a"], F.lit(1)) * 255.0).cast("int")) for n in "rgb"]))

        return F.aggregate(F.sequence(F.lit(0), F.lit(factor * factor - 1)), nothing, add, packed)

    return on_grid(frames, lambda r: C.idiv(r.w, factor), lambda r: C.idiv(r.h, factor), pixel)
