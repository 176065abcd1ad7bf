"""Convolution, resampling by area, and masks of neighbours."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colour as C
from .raster import Raster, on_grid, same_h, same_w


@dataclass(frozen=True)
class Kernel:
    """Weights by rows, and what their sums are divided by."""

    width: int
    weights: tuple[float, ...]
    divisor: float = 1.0

    def taps(self) -> list[tuple[int, int, float]]:
        height = len(self.weights) // self.width
        return [(k % self.width - self.width // 2, k // self.width - height // 2, v / self.divisor) for k, v in enumerate(self.weights)]


#: The usual kernels.
KERNELS = {
    "identity": Kernel(1, (1,)),
    "box3": Kernel(3, (1,) * 9, 9),
    "box5": Kernel(5, (1,) * 25, 25),
    "gaussian3": Kernel(3, (1, 2, 1, 2, 4, 2, 1, 2, 1), 16),
    "gaussian5": Kernel(5, tuple(a * b for a in (1, 4, 6, 4, 1) for b in (1, 4, 6, 4, 1)), 256),
    "sharpen": Kernel(3, (0, -1, 0, -1, 5, -1, 0, -1, 0)),
    "sharpen_mild": Kernel(3, (0, -1, 0, -1, 9, -1, 0, -1, 0), 5),
    "emboss": Kernel(3, (-2, -1, 0, -1, 1, 1, 0, 1, 2)),
    "laplacian": Kernel(3, (0, 1, 0, 1, -4, 1, 0, 1, 0)),
    "laplacian_full": Kernel(3, (1, 1, 1, 1, -8, 1, 1, 1, 1)),
    "sobel_x": Kernel(3, (-1, 0, 1, -2, 0, 2, -1, 0, 1)),
    "sobel_y": Kernel(3, (-1, -2, -1, 0, 0, 0, 1, 2, 1)),
    "prewitt_x": Kernel(3, (-1, 0, 1, -1, 0, 1, -1, 0, 1)),
    "prewitt_y": Kernel(3, (-1, -1, -1, 0, 0, 0, 1, 1, 1)),
}


def _sampled(r: Raster, x: Column, y: Column, edge: str) -> Column:
    """A pixel beyond the border: the nearest one, the one on the other side, or
    transparent."""
    if edge == "clamp":
        return r.at(F.least(r.w - 1, F.greatest(F.lit(0), x)), F.least(r.h - 1, F.greatest(F.lit(0), y)))
    if edge == "wrap":
        return r.at(F.pmod(x, r.w), F.pmod(y, r.h))
    return F.when(r.inside(x, y), r.at(x, y)).otherwise(F.lit(0))


def _sums(r: Raster, x: Column, y: Column, kernel: Kernel, edge: str, premultiplied: bool) -> Column:
    """Struct a, r, g, b of weighted sums; a pixel that is 0 adds nothing."""
    taps = F.array(*[F.struct(F.lit(v).alias("k"), _sampled(r, x + dx, y + dy, edge).alias("p")) for dx, dy, v in kernel.taps() if v])
    zero = F.struct(*[F.lit(0.0).alias(c) for c in "argb"])

    def add(acc: Column, t: Column) -> Column:
        a = C.alpha(t["p"]) / 255.0
        k = F.when(t["p"] == 0, F.lit(0.0)).otherwise(t["k"] * (a if premultiplied else F.lit(1.0)))
        return F.struct((acc["a"] + a * t["k"]).alias("a"), *[(acc[n] + f(t["p"]) * k).alias(n) for n, f in (("r", C.red), ("g", C.green), ("b", C.blue))])

    return F.aggregate(taps, zero, add)


def _byte(v: Column) -> Column:
    return C.clamp8((v + 0.5).cast("int"))


def convolved(frames: DataFrame, kernel: Kernel, edge: str = "clamp", alpha: str = "premultiplied") -> DataFrame:
    """premultiplied: colours weigh in with their alpha, which is filtered too;
    straight: colours are filtered as they are and a pixel keeps its alpha."""

    def pixel(r: Raster, x: Column, y: Column) -> Column:
        own = r.at(x, y)

        def packed(s: Column) -> Column:
            a = _byte(s["a"] * 255.0)
            over = F.when(s["a"] == 0, F.lit(1.0)).otherwise(s["a"])
            soft = F.when(a == 0, F.lit(0)).otherwise(C.pack(a, *[_byte(s[c] / over) for c in "rgb"]))
            hard = F.when(C.alpha(own) == 0, F.lit(0)).otherwise(C.pack(C.alpha(own), *[_byte(s[c]) for c in "rgb"]))
            return soft if alpha == "premultiplied" else hard

        return C.let(_sums(r, x, y, kernel, edge, alpha == "premultiplied"), packed)

    return on_grid(frames, same_w, same_h, pixel)


def sobel(frames: DataFrame, edge: str = "clamp") -> DataFrame:
    """Grey magnitude of both gradients' lumas; each gradient is first cut to
    0..255, so falling edges count for nothing."""

    def pixel(r: Raster, x: Column, y: Column) -> Column:
        own = r.at(x, y)

        def grey(s: Column) -> Column:
            return C.luma8(C.pack(F.lit(255), *[_byte(s[c]) for c in "rgb"])).cast("double")

        def packed(v: Column) -> Column:
            m = _byte(F.sqrt(v["x"] * v["x"] + v["y"] * v["y"]))
            return F.when(C.alpha(own) == 0, F.lit(0)).otherwise(C.pack(C.alpha(own), m, m, m))

        lumas = [C.let(_sums(r, x, y, KERNELS[f"sobel_{n}"], edge, False), grey).alias(n) for n in "xy"]
        return C.let(F.struct(*lumas), packed)

    return on_grid(frames, same_w, same_h, pixel)


def box_blurred(frames: DataFrame, size: int = 3, passes: int = 1, edge: str = "clamp") -> DataFrame:
    if not (1 <= size <= 15 and size % 2 and 1 <= passes <= 16):
        raise ValueError("size is odd, 1 to 15; passes are 1 to 16")
    for _ in range(passes):
        frames = convolved(frames, Kernel(size, (1.0,) * (size * size), size * size), edge)
    return frames


def _area_mean(r: Raster, x: Column, y: Column, w: Column, h: Column) -> Column:
    kx, ky = r.w / w, r.h / h
    x0, x1, y0, y1 = x * kx, (x + 1) * kx, y * ky, (y + 1) * ky

    def places(lo: Column, hi: Column, most: Column) -> Column:
        cells = F.sequence(F.floor(lo).cast("int"), F.least(most, F.ceil(hi).cast("int")) - 1)
        return F.filter(F.transform(cells, lambda i: F.struct(i.alias("i"), (F.least(hi, (i + 1).cast("double")) - F.greatest(lo, i.cast("double"))).alias("k"))), lambda s: s["k"] > 0)

    zero = F.struct(*[F.lit(0.0).alias(c) for c in "wargb"])

    def add(acc: Column, t: Column) -> Column:
        a = C.alpha(t["p"]).cast("double")
        return F.struct((acc["w"] + t["k"]).alias("w"), (acc["a"] + a * t["k"]).alias("a"), *[(acc[n] + f(t["p"]) * (a / 255.0) * t["k"]).alias(n) for n, f in (("r", C.red), ("g", C.green), ("b", C.blue))])

    def packed(s: Column) -> Column:
        a = _byte(s["a"] / s["w"])
        over = F.when(s["a"] <= 0, F.lit(1.0)).otherwise(s["a"])
        return F.when((s["w"] <= 0) | (a == 0) | (s["a"] <= 0), F.lit(0)).otherwise(C.pack(a, *[C.clamp8((s[c] / over * 255.0).cast("int")) for c in "rgb"]))

    def cells(v: Column) -> Column:
        return F.flatten(F.transform(v["ys"], lambda b: F.transform(v["xs"], lambda a: F.struct((a["k"] * b["k"]).alias("k"), r.at(a["i"], b["i"]).alias("p")))))

    taps = C.let(F.struct(places(x0, x1, r.w).alias("xs"), places(y0, y1, r.h).alias("ys")), cells)
    return C.let(F.aggregate(taps, zero, add), packed)


def box_resampled(frames: DataFrame, w: int, h: int) -> DataFrame:
    """Each new pixel is the mean of the area that it covers, colours weighted by
    alpha."""
    return on_grid(frames, lambda r: F.lit(w), lambda r: F.lit(h), lambda r, x, y: _area_mean(r, x, y, F.lit(w), F.lit(h)))


def area_means(r: Raster, w: Column, h: Column) -> Column:
    """A raster resampled by area to w x h, as a struct w, h, pixels."""
    cells = F.transform(F.sequence(F.lit(0), w * h - 1), lambda i: _area_mean(r, (i % w).cast("int"), C.idiv(i, w), w, h))
    return F.struct(w.alias("w"), h.alias("h"), cells.alias("pixels"))


#: The eight neighbours in the order of their bits, from the north clockwise.
BITS = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]


def blob_mask(mask: int) -> int:
    """A corner counts only between two edges that do."""
    for corner in (1, 3, 5, 7):
        if not (mask >> corner - 1 & 1 and mask >> (corner + 1) % 8 & 1):
            mask &= ~(1 << corner)
    return mask


#: The 47 masks that are left, in the order of their tiles.
BLOBS = [
    0, 1, 4, 16, 64, 5, 7, 17,
    65, 193, 20, 28, 68, 80, 112, 21,
    23, 29, 31, 69, 71, 197, 199, 81,
    209, 113, 241, 84, 92, 116, 124, 85,
    87, 93, 95, 117, 119, 125, 127, 213,
    215, 221, 223, 245, 247, 253, 255,
]


def autotiled(frames: DataFrame, edges_only: bool = False) -> DataFrame:
    """Visible pixels as terrain: each becomes the tile for its neighbours (47
    blobs, or 16 by edges), others -1."""
    index = F.array(*[F.lit(BLOBS.index(blob_mask(m))) for m in range(256)])

    def pixel(r: Raster, x: Column, y: Column) -> Column:
        def solid(dx: int, dy: int) -> Column:
            return F.when(r.inside(x + dx, y + dy) & (C.alpha(r.at(x + dx, y + dy)) > 0), 1).otherwise(0)

        if edges_only:
            tile = sum((solid(*BITS[2 * k]) * (1 << k) for k in range(1, 4)), solid(*BITS[0]))
        else:
            tile = F.get(index, sum((solid(*d) * (1 << k) for k, d in enumerate(BITS) if k), solid(*BITS[0])))
        return F.when(C.alpha(r.at(x, y)) > 0, tile).otherwise(F.lit(-1))

    return on_grid(frames, same_w, same_h, pixel)


def cave_step(frames: DataFrame, wall: int = C.BLACK, walls: int = 5) -> DataFrame:
    """One round of smoothing of a cave: a cell with enough walls among its eight
    neighbours (beyond the border all are walls) is wall, others are open."""

    def pixel(r: Raster, x: Column, y: Column) -> Column:
        count = F.lit(0)
        for dx, dy in BITS:
            count += F.when(r.inside(x + dx, y + dy) & (r.at(x + dx, y + dy) != wall), 0).otherwise(1)
        return F.when(count >= walls, F.lit(wall)).otherwise(F.lit(0))

    return on_grid(frames, same_w, same_h, pixel)


def kelvin(k: float) -> tuple[int, int, int]:
    """The colour of a black body, by the usual piecewise fit."""
    from math import log

    t = min(40000.0, max(1000.0, k)) / 100
    r = 255.0 if t <= 66 else 329.698727446 * (t - 60) ** -0.1332047592
    g = 99.4708025861 * log(t) - 161.1195681661 if t <= 66 else 288.1221695283 * (t - 60) ** -0.0755148492
    b = 255.0 if t >= 66 else 0.0 if t <= 19 else 138.5177312231 * log(t - 10) - 305.0447927307
    return tuple(int(min(255.0, max(0.0, v)) + 0.5) for v in (r, g, b))


def warmed(frames: DataFrame, k: float, strength: float = 1.0) -> DataFrame:
    """Channels scaled to the tint of a temperature, with gains of mean 1."""
    tint = [v / 255.0 for v in kelvin(k)]
    gains = [v / (sum(tint) / 3) for v in tint]

    def rule(p: Column) -> Column:
        parts = [C.clamp8((f(p) + (f(p) * F.lit(gain) - f(p)) * F.lit(strength)).cast("int")) for f, gain in zip((C.red, C.green, C.blue), gains, strict=True)]
        return F.when(C.alpha(p) == 0, p).otherwise(C.pack(C.alpha(p), *parts))

    return frames.withColumn("pixels", F.transform("pixels", rule))
