"""Colour schemes in CIELAB as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import colour as C

#: How far a colour may move on its way to sRGB and back, and steps of the search for one that stays.
GAMUT_TOLERANCE, GAMUT_STEPS = 1.0, 24
SCHEMES = {"complementary": (0, 180), "triadic": (0, 120, 240), "split_complementary": (0, 150, 210), "tetradic": (0, 90, 180, 270)}


def lab_of(light: Column, a: Column, b: Column) -> Column:
    return F.struct(light.alias("l"), a.alias("a"), b.alias("b"))


def from_lab(lab: Column) -> Column:
    """An opaque colour; channels outside sRGB are clipped."""

    def root(t: Column) -> Column:
        cube = t * t * t
        return F.when(cube > 0.008856, cube).otherwise((116.0 * t - 16.0) / 903.3)

    def byte(v: Column) -> Column:
        s = F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) - 0.055)
        return C.clamp8((s * 255.0 + 0.5).cast("int"))

    def of(v: Column) -> Column:
        x, y, z = v["x"], v["y"], v["z"]
        return C.pack(F.lit(255), byte(x * 3.2404542 + y * -1.5371385 + z * -0.4985314), byte(x * -0.9692660 + y * 1.8760108 + z * 0.0415560), byte(x * 0.0556434 + y * -0.2040259 + z * 1.0572252))

    def light(s: Column) -> Column:
        fy = (s["l"] + 16.0) / 116.0
        return F.struct((root(fy + s["a"] / 500.0) * 0.95047).alias("x"), root(fy).alias("y"), (root(fy - s["b"] / 200.0) * 1.08883).alias("z"))

    return C.let(lab, lambda s: C.let(light(s), of))


def distance(p: Column, q: Column) -> Column:
    """Euclidean distance of two CIELAB structs."""
    return F.sqrt(sum(((p[k] - q[k]) * (p[k] - q[k]) for k in "ab"), (p["l"] - q["l"]) * (p["l"] - q["l"])))


def within_gamut(lab: Column) -> Column:
    """The colour of a CIELAB struct; where sRGB lacks it, chroma shrinks by
    bisection and lightness stays."""

    def scaled(s: Column, k: Column) -> Column:
        return lab_of(s["l"], s["a"] * k, s["b"] * k)

    def fits(s: Column) -> Column:
        return distance(s, C.lab(from_lab(s))) <= GAMUT_TOLERANCE

    def halved(s: Column) -> Column:
        def step(at: Column, k: Column) -> Column:
            mid = at + F.pow(F.lit(0.5), k)
            return F.when(fits(scaled(s, mid)), mid).otherwise(at)

        return F.aggregate(F.sequence(F.lit(1), F.lit(GAMUT_STEPS)), F.lit(0.0), step)

    return C.let(lab, lambda s: F.when(fits(s), from_lab(s)).otherwise(C.let(halved(s), lambda k: from_lab(scaled(s, k)))))


def rotated(c: Column, degrees: float) -> Column:
    """The hue turned in the a-b plane; whole turns give the colour back."""
    if degrees % 360 == 0:
        return c
    cos, sin = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return C.let(C.lab(c), lambda s: within_gamut(lab_of(s["l"], s["a"] * cos - s["b"] * sin, s["a"] * sin + s["b"] * cos)))


def scheme(c: Column, name: str) -> Column:
    return F.array(*[rotated(c, d) for d in SCHEMES[name]])


def analogous(c: Column, count: int = 2, spread: float = 60.0) -> Column:
    """count + 1 colours over a spread of degrees, the colour in the middle."""
    return F.array(*[rotated(c, (i - count / 2) * spread / count) for i in range(count + 1)])


def gradient(a: Column, b: Column, steps: int) -> Column:
    """Colours on the straight line between two in CIELAB."""
    if steps == 1:
        return F.array(a)

    def between(s: Column) -> Column:
        at = lambda k, t: s["p"][k] + (s["q"][k] - s["p"][k]) * t
        return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: from_lab(lab_of(*[at(k, i / (steps - 1)) for k in "lab"])))

    return C.let(F.struct(C.lab(a).alias("p"), C.lab(b).alias("q")), between)


def monochromatic(c: Column, count: int) -> Column:
    """Hue and chroma of a colour at even steps of lightness from 0 to 100."""
    if count == 1:
        return F.array(c)
    return C.let(C.lab(c), lambda s: F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: from_lab(lab_of(100.0 * i / (count - 1), s["a"], s["b"]))))


def luminance_ramp(c: Column, steps: int) -> Column:
    """From black through the colour to white; the odd one out is light."""
    low = (steps - 1) // 2
    high = steps - 1 - low

    def rungs(s: Column) -> Column:
        dark = [from_lab(lab_of(*[s[k] * (1 - j / low) for k in "lab"])) for j in range(low, 0, -1)]
        bright = [from_lab(lab_of(s["l"] + (100.0 - s["l"]) * (j / high), s["a"] * (1 - j / high), s["b"] * (1 - j / high))) for j in range(1, high + 1)]
        return F.array(*dark, c, *bright)

    return C.let(C.lab(c), rungs)


def by_lightness(colours: Column) -> Column:
    """Colours from dark to light; equal ones stay in order."""
    keyed = F.transform(colours, lambda c, i: F.struct(C.lab(c)["l"].alias("l"), i.alias("i"), c.alias("c")))
    return F.transform(F.array_sort(keyed), lambda s: s["c"])


def with_colour(colours: Column, c: Column) -> Column:
    """A palette with a colour more, at its end."""
    return F.concat(colours, F.array(c))


def without_place(colours: Column, place: int) -> Column:
    """A palette without the colour at a place; the last one stays."""
    return F.when(F.size(colours) > 1, F.filter(colours, lambda c, i: i != place)).otherwise(colours)
