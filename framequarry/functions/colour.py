"""Scalar colour functions as Column expressions.

A colour is a packed 0xAARRGGBB held in a signed INT, so colours of alpha 0x80
and more are negative and sort before the others; ties are broken in that order
throughout. Integer formulas divide with `//` (idiv), which truncates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE, BLACK = -1, -16777216


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once. Without it, an expression that a
    lambda mentions may be worked out again for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def idiv(a: Column, b: Column | int) -> Column:
    """Integer division that truncates, for values far below 2**53."""
    q = a / (F.lit(b) if isinstance(b, int) else b)
    return q.cast("int")


def alpha(c: Column) -> Column:
    return F.shiftrightunsigned(c, 24)


def red(c: Column) -> Column:
    return F.shiftright(c, 16).bitwiseAND(255)


def green(c: Column) -> Column:
    return F.shiftright(c, 8).bitwiseAND(255)


def blue(c: Column) -> Column:
    return c.bitwiseAND(255)


def pack(a: Column, r: Column, g: Column, b: Column) -> Column:
    a, r, g, b = (x.cast("int") for x in (a, r, g, b))
    return F.shiftleft(a, 24).bitwiseOR(F.shiftleft(r, 16)).bitwiseOR(F.shiftleft(g, 8)).bitwiseOR(b)


def channels(c: Column, f: Callable[[Column], Column]) -> Column:
    """f on red, green and blue; alpha stays."""
    return pack(alpha(c), f(red(c)), f(green(c)), f(blue(c)))


def clamp8(v: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), v))


def luma8(c: Column) -> Column:
    """Rec. 709 luma, rounded half up."""
    return clamp8(F.floor(0.2126 * red(c) + 0.7152 * green(c) + 0.0722 * blue(c) + 0.5).cast("int"))


def luma601(c: Column) -> Column:
    """Rec. 601 luma in thousandths, truncated."""
    return idiv(299 * red(c) + 587 * green(c) + 114 * blue(c), 1000)


def chebyshev(a: Column, b: Column) -> Column:
    """Largest difference of red, green and blue."""
    return F.greatest(F.abs(red(a) - red(b)), F.abs(green(a) - green(b)), F.abs(blue(a) - blue(b)))


def within(a: Column, b: Column, tolerance: int) -> Column:
    """All four channels are within tolerance."""
    return (F.abs(alpha(a) - alpha(b)) <= tolerance) & (chebyshev(a, b) <= tolerance)


def hex_colour(c: Column) -> Column:
    """#rrggbb, or #aarrggbb unless opaque."""
    wide = c.cast("long").bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))
    full = F.lower(F.lpad(F.hex(wide), 8, "0"))
    return F.when(alpha(c) == 255, F.concat(F.lit("#"), F.substring(full, 3, 6))).otherwise(F.concat(F.lit("#"), full))


def hue(c: Column) -> Column:
    """Degrees in [0, 360), 0 for greys."""
    r, g, b = red(c), green(c), blue(c)
    top, span = F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
    sector = (
        F.when(span == 0, F.lit(0.0))
        .when(top == r, (g - b) / span)
        .when(top == g, (b - r) / span + 2.0)
        .otherwise((r - g) / span + 4.0)
    )
    return F.when(sector < 0, sector * 60.0 + 360.0).otherwise(sector * 60.0)


def family(c: Column) -> Column:
    """One of thirteen names of hue families."""
    r, g, b = red(c), green(c), blue(c)
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    light, span = (top + low) / 2.0, top - low
    saturation = span / F.greatest(top, F.lit(1))
    reds = F.when((light < 110) & (saturation < 0.75), "brown").otherwise("red")
    named = lambda h: (
        F.when(alpha(c) == 0, "transparent")
        .when((span <= 16) & (light < 48), "black")
        .when((span <= 16) & (light >= 216), "white")
        .when(span <= 16, "gray")
        .when(h < 12, reds)
        .when(h < 46, F.when(light < 110, "brown").otherwise("orange"))
        .when(h < 66, "yellow")
        .when(h < 160, "green")
        .when(h < 200, "cyan")
        .when(h < 258, "blue")
        .when(h < 300, F.when((light >= 170) & (saturation < 0.6), "pink").otherwise("purple"))
        .when(h < 348, F.when(light >= 170, "pink").otherwise("magenta"))
        .otherwise(reds)
    )
    return let(hue(c), named)


def posterize(c: Column, levels: int) -> Column:
    """Each channel to one of `levels` steps; transparent colours stay."""
    span = levels - 1
    return F.when(alpha(c) == 0, c).otherwise(channels(c, lambda v: idiv(idiv(v * span + 127, 255) * 255, span)))


def binarize(c: Column, threshold: int) -> Column:
    return F.when(alpha(c) == 0, c).when(luma8(c) > threshold, F.lit(WHITE)).otherwise(F.lit(BLACK))


def alpha_snap(c: Column, threshold: int = 128) -> Column:
    """Transparent below the threshold, else opaque."""
    return F.when(alpha(c) < threshold, F.lit(0)).otherwise(c.bitwiseOR(F.lit(BLACK)))


def drop_faint(c: Column, tolerance: int) -> Column:
    return F.when(alpha(c) < tolerance, F.lit(0)).otherwise(c)


def scaled_alpha(c: Column, k: Column | int) -> Column:
    k = F.lit(k) if isinstance(k, int) else k
    return F.shiftleft(idiv(alpha(c) * k, 255), 24).bitwiseOR(c.bitwiseAND(0xFFFFFF))


def linear(v: Column) -> Column:
    """sRGB byte to linear light."""
    s = v / 255.0
    return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))


def luminance(c: Column) -> Column:
    return 0.2126 * linear(red(c)) + 0.7152 * linear(green(c)) + 0.0722 * linear(blue(c))


def contrast(a: Column, b: Column) -> Column:
    """WCAG contrast ratio, 1 to 21."""
    la, lb = luminance(a), luminance(b)
    return (F.greatest(la, lb) + 0.05) / (F.least(la, lb) + 0.05)


def conformance(a: Column, b: Column, large: bool = False) -> Column:
    ratio = contrast(a, b)
    return F.when(ratio >= (4.5 if large else 7.0), "AAA").when(ratio >= (3.0 if large else 4.5), "AA")


def lab(c: Column) -> Column:
    """CIELAB under D65 as struct l, a, b."""

    def f(t: Column) -> Column:
        return F.when(t > 0.008856, F.pow(t, F.lit(1 / 3))).otherwise((903.3 * t + 16.0) / 116.0)

    def of_light(s: Column) -> Column:
        r, g, b = s["r"], s["g"], s["b"]
        x = (0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047
        y = 0.2126729 * r + 0.7151522 * g + 0.0721750 * b
        z = (0.0193339 * r + 0.1191920 * g + 0.9503041 * b) / 1.08883
        return let(F.struct(x.alias("x"), y.alias("y"), z.alias("z")), lambda v: let(F.struct(f(v["x"]).alias("x"), f(v["y"]).alias("y"), f(v["z"]).alias("z")), of_roots))

    def of_roots(v: Column) -> Column:
        return F.struct((116.0 * v["y"] - 16.0).alias("l"), (500.0 * (v["x"] - v["y"])).alias("a"), (200.0 * (v["y"] - v["z"])).alias("b"))

    return let(c, lambda p: let(F.struct(linear(red(p)).alias("r"), linear(green(p)).alias("g"), linear(blue(p)).alias("b")), of_light))


def squared_rgb(a: Column, b: Column) -> Column:
    dr, dg, db = red(a) - red(b), green(a) - green(b), blue(a) - blue(b)
    return dr * dr + dg * dg + db * db


def achromat(c: Column, severity: float = 1.0) -> Column:
    """Colour vision without hue: channels go to the truncated luma."""
    y = clamp8(F.floor(0.2126 * red(c) + 0.7152 * green(c) + 0.0722 * blue(c)).cast("int"))
    return channels(c, lambda v: clamp8((v + (y - v) * F.lit(severity)).cast("int")))


#: Full-severity matrices of the published Machado model.
MACHADO = {
    "protan": (0.152286, 1.052583, -0.204868, 0.114503, 0.786281, 0.099216, -0.003882, -0.048116, 1.051998),
    "deutan": (0.367322, 0.860646, -0.227968, 0.280085, 0.672501, 0.047413, -0.011820, 0.042940, 0.968881),
    "tritan": (1.255528, -0.076749, -0.178779, -0.078411, 0.930809, 0.147602, 0.004733, 0.691367, 0.303900),
}


def simulated(c: Column, deficiency: str, severity: float = 1.0) -> Column:
    """A colour as seen with a deficiency, by a matrix in linear light."""
    if deficiency == "achromat":
        return achromat(c, severity)
    return _through(c, [x * severity + (1 - severity) * (i % 4 == 0) for i, x in enumerate(MACHADO[deficiency])])


#: An older pair of matrices for the same, at full strength.
VIENOT = {
    "protan": [0.11238, 0.88762, 0.0, 0.11238, 0.88762, 0.0, 0.00401, -0.00401, 1.0],
    "deutan": [0.29275, 0.70725, 0.0, 0.29275, 0.70725, 0.0, -0.02234, 0.02234, 1.0],
}


def simulated_plainly(c: Column, deficiency: str) -> Column:
    """As `simulated` at full strength, by the older matrices where there are some."""
    return _through(c, VIENOT[deficiency]) if deficiency in VIENOT else simulated(c, deficiency)


def encoded(v: Column) -> Column:
    """Linear light to an sRGB byte."""
    v = F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    s = F.when(v <= 0.0031308, v * 12.92).otherwise(1.055 * F.pow(v, F.lit(1 / 2.4)) - 0.055)
    return clamp8(F.floor(s * 255.0 + 0.5).cast("int"))


def _through(c: Column, m: list[float]) -> Column:
    light = [linear(red(c)), linear(green(c)), linear(blue(c))]
    return pack(alpha(c), *[encoded(sum((F.lit(m[3 * row + k]) * light[k] for k in range(1, 3)), F.lit(m[3 * row]) * light[0])) for row in range(3)])


def accessible(c: Column, against: Column, ratio: float = 4.5, steps: int = 24) -> Column:
    """The colour, moved in linear light towards white (over what is darker than
    half) or black as little as the contrast asks, by bisection; null if even
    white or black falls short."""

    def found(s: Column) -> Column:
        lighter = luminance(s["q"]) < 0.5

        def shifted(t: Column) -> Column:
            mixed = lambda v: F.when(lighter, v + (1.0 - v) * t).otherwise(v * (1.0 - t))
            return pack(alpha(s["c"]), *[encoded(mixed(linear(f(s["c"])))) for f in (red, green, blue)])

        def halved(acc: Column, _: Column) -> Column:
            mid = (acc["lo"] + acc["hi"]) / 2.0

            def judged(p: Column) -> Column:
                enough = contrast(p, s["q"]) >= ratio
                return F.struct(F.when(enough, acc["lo"]).otherwise(mid).alias("lo"), F.when(enough, mid).otherwise(acc["hi"]).alias("hi"), F.when(enough, p).otherwise(acc["best"]).alias("best"))

            return let(shifted(mid), judged)

        start = F.struct(F.lit(0.0).alias("lo"), F.lit(1.0).alias("hi"), F.lit(None).cast("int").alias("best"))
        best = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halved)["best"]
        end = F.when(lighter, F.lit(WHITE)).otherwise(F.lit(BLACK))
        return F.when(contrast(s["c"], s["q"]) >= ratio, s["c"]).otherwise(F.coalesce(best, F.when(contrast(end, s["q"]) >= ratio, end)))

    return let(F.struct(c.alias("c"), against.alias("q")), found)


#: Temperatures by name, in kelvin.
TEMPERATURES = {"candle": 1800.0, "tungsten": 2700.0, "sunset": 3200.0, "fluorescent": 4200.0, "daylight": 5600.0, "noon": 6500.0, "overcast": 7000.0, "shade": 9000.0, "blue_sky": 15000.0}


def black_body(kelvin: Column) -> Column:
    """The opaque colour of a black body from 1000 to 40000 kelvin, by the usual
    piecewise fit, whose numbers are fixed values."""
    t = F.least(F.lit(40000.0), F.greatest(F.lit(1000.0), kelvin)) / 100.0
    cool = t <= 66
    r = F.when(cool, F.lit(255.0)).otherwise(329.698727446 * F.pow(t - 60.0, F.lit(-0.1332047592)))
    g = F.when(cool, 99.4708025861 * F.log(t) - 161.1195681661).otherwise(288.1221695283 * F.pow(t - 60.0, F.lit(-0.0755148492)))
    b = F.when(t >= 66, F.lit(255.0)).when(t <= 19, F.lit(0.0)).otherwise(138.5177312231 * F.log(t - 10.0) - 305.0447927307)
    return pack(F.lit(255), *[(F.least(F.lit(255.0), F.greatest(F.lit(0.0), v)) + 0.5).cast("int") for v in (r, g, b)])


def preset_temperature(name: Column) -> Column:
    """The colour of a temperature by its name in any case; null for others."""
    known = F.create_map(*[F.lit(v) for pair in TEMPERATURES.items() for v in pair])
    return let(F.try_element_at(known, F.lower(name)), lambda k: F.when(k.isNotNull(), black_body(k)))


BLENDS: dict[str, Callable[[Column, Column], Column]] = {
    "normal": lambda s, d: s,
    "multiply": lambda s, d: idiv(s * d + 127, 255),
    "screen": lambda s, d: 255 - idiv((255 - s) * (255 - d) + 127, 255),
    "add": lambda s, d: F.least(F.lit(255), s + d),
    "subtract": lambda s, d: F.greatest(F.lit(0), d - s),
    "difference": lambda s, d: F.abs(s - d),
    "lighten": lambda s, d: F.greatest(s, d),
    "darken": lambda s, d: F.least(s, d),
    "overlay": lambda s, d: F.when(d < 128, idiv(2 * s * d + 127, 255)).otherwise(255 - idiv(2 * (255 - s) * (255 - d) + 127, 255)),
}


def blended(src: Column, dst: Column, mode: str = "normal", src_alpha: Column | None = None) -> Column:
    """src over dst in integers: the blended channel weighs in with the source's
    alpha, the destination with what is left."""
    sa, da = alpha(src) if src_alpha is None else src_alpha, alpha(dst)
    rest = 255 - sa
    out = sa + idiv(da * rest, 255)

    def mixed(part: Callable[[Column], Column]) -> Column:
        s, d = part(src), part(dst)
        return idiv(clamp8(BLENDS[mode](s, d)) * sa + idiv(d * da * rest, 255), F.greatest(out, F.lit(1)))

    return F.when(out == 0, F.lit(0)).otherwise(pack(out, mixed(red), mixed(green), mixed(blue)))
