"""Operators on two rasters or on stacks of rasters.

Rasters meet in one equi-join on their key; pixels then meet by place within the
row (zip_with), so no pixel is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import colour as C
from .raster import Raster, on_grid, same_h, same_w


def consecutive(frames: DataFrame) -> DataFrame:
    """(frame_id, w, h, before, after): each raster with the one of the next id."""
    nxt = frames.select((F.col("frame_id") - 1).alias("frame_id"), F.col("pixels").alias("after"))
    return frames.select("frame_id", "w", "h", F.col("pixels").alias("before")).join(nxt, "frame_id")


def pair_pixels(pairs: DataFrame) -> DataFrame:
    both = F.zip_with("before", "after", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    flat = pairs.select("frame_id", "w", F.posexplode_outer(both).alias("i", "p"))
    return flat.select("frame_id", (F.col("i") % F.col("w")).cast("int").alias("x"), C.idiv(F.col("i"), F.col("w")).alias("y"), "p.a", "p.b")


def _seen(c: str) -> Column:
    return C.alpha(F.col(c)) > 0


def metrics(pairs: DataFrame) -> DataFrame:
    """compared, changed, mean absolute errors (NaN where nothing is compared),
    largest difference, opacity mismatches and PSNR of each pair."""
    a, b = F.col("a"), F.col("b")
    both = _seen("a") & _seen("b")
    diff = {n: F.when(both, F.abs(f(a) - f(b))) for n, f in (("r", C.red), ("g", C.green), ("b", C.blue))}
    sums = pair_pixels(pairs).groupBy("frame_id").agg(
        F.count_if(both).alias("compared"),
        F.count_if(a != b).alias("changed"),
        F.count("*").alias("total"),
        *[F.sum(F.coalesce(d, F.lit(0))).alias(f"s{n}") for n, d in diff.items()],
        F.sum(F.coalesce(F.when(both, C.squared_rgb(a, b)), F.lit(0))).alias("sq"),
        F.max(F.coalesce(F.when(both, C.chebyshev(a, b)), F.lit(0))).alias("max_delta"),
        F.count_if(_seen("a") != _seen("b")).alias("opacity_mismatches"),
    )
    n = F.col("compared")

    def mean(total: Column, k: int) -> Column:
        return F.when(n == 0, F.lit(float("nan"))).otherwise(total / (F.greatest(n, F.lit(1)) * k))

    mse = F.col("sq") / (F.greatest(n, F.lit(1)) * 3.0)
    psnr = F.when(n == 0, F.lit(float("nan"))).when(F.col("sq") == 0, F.lit(float("inf"))).otherwise(10.0 * F.log10(65025.0 / F.when(F.col("sq") == 0, F.lit(1.0)).otherwise(mse)))
    return sums.select("frame_id", "compared", "changed", "total", *[mean(F.col(f"s{c}"), 1).alias(f"mae_{c}") for c in "rgb"], mean(F.col("sr") + F.col("sg") + F.col("sb"), 3).alias("mae"), "max_delta", "opacity_mismatches", psnr.alias("psnr"))


def diff_kind() -> Column:
    a, b = F.col("a"), F.col("b")
    return (
        F.when(~_seen("a") & ~_seen("b"), "unchanged")
        .when(~_seen("a"), "added")
        .when(~_seen("b"), "removed")
        .when(a != b, "changed")
        .otherwise("unchanged")
    )


def diff(pairs: DataFrame) -> DataFrame:
    """For each pair and kind of change: pixels and their box (x, y, width,
    height)."""
    px = pair_pixels(pairs).withColumn("kind", diff_kind())
    found = px.groupBy("frame_id", "kind").agg(F.count("*").alias("cnt"), *[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("x", "y")])
    return found.select("frame_id", "kind", "cnt", F.col("min_x").alias("x"), F.col("min_y").alias("y"), (F.col("max_x") - F.col("min_x") + 1).alias("width"), (F.col("max_y") - F.col("min_y") + 1).alias("height"))


def transitions(pairs: DataFrame, most: int = 16) -> DataFrame:
    """The commonest changes of colour of each pair."""
    px = pair_pixels(pairs).where(diff_kind() == "changed").groupBy("frame_id", F.col("a").alias("from_argb"), F.col("b").alias("to_argb")).agg(F.count("*").alias("cnt"))
    rank = F.row_number().over(Window.partitionBy("frame_id").orderBy(F.desc("cnt"), "from_argb", "to_argb"))
    return px.withColumn("rank", rank).where(F.col("rank") <= most)


def diff_mask(pairs: DataFrame, tolerance: int = 0, different: int = -65536, same: int = -16711936) -> DataFrame:
    def rule(a: Column, b: Column) -> Column:
        x, y = C.alpha(a) > 0, C.alpha(b) > 0
        return F.when(~x & ~y, F.lit(0)).when(x & y & (C.chebyshev(a, b) <= tolerance), F.lit(same)).otherwise(F.lit(different))

    return pairs.select("frame_id", "w", "h", F.zip_with("before", "after", rule).alias("pixels"))


def blend(pairs: DataFrame, mode: str, opacity: float = 1.0) -> DataFrame:
    """after over before in a blend mode; the opacity is rounded to a byte."""
    k = min(255, max(0, int(opacity * 255 + 0.5)))

    def rule(a: Column, b: Column) -> Column:
        return C.blended(b if k == 255 else C.scaled_alpha(b, k), a, mode)

    return pairs.select("frame_id", "w", "h", F.zip_with("before", "after", rule).alias("pixels"))


def masked(pairs: DataFrame) -> DataFrame:
    """before where after is visible."""
    return pairs.select("frame_id", "w", "h", F.zip_with("before", "after", lambda a, b: F.when(C.alpha(b) > 0, a).otherwise(F.lit(0))).alias("pixels"))


def symmetry(frames: DataFrame, kind: str, tolerance: int = 0) -> DataFrame:
    """compared and mismatched pairs of mirrored pixels: kind is horizontal,
    vertical, rot180, diagonal or anti_diagonal (both diagonals: square rasters)."""
    maps = {
        "horizontal": lambda r, x, y: (r.w - 1 - x, y),
        "vertical": lambda r, x, y: (x, r.h - 1 - y),
        "rot180": lambda r, x, y: (r.w - 1 - x, r.h - 1 - y),
        "diagonal": lambda r, x, y: (y, x),
        "anti_diagonal": lambda r, x, y: (r.h - 1 - y, r.w - 1 - x),
    }

    def state(r: Raster, x: Column, y: Column) -> Column:
        mx, my = maps[kind](r, x, y)

        def judged(n: Column) -> Column:
            a, b = C.alpha(n["p"]) > 0, C.alpha(n["q"]) > 0
            return F.when(~a & ~b, F.lit(0)).when((a != b) | (C.chebyshev(n["p"], n["q"]) > tolerance), F.lit(2)).otherwise(F.lit(1))

        twice = (mx < x) | ((mx == x) & (my <= y))
        return F.when(twice, F.lit(0)).otherwise(C.let(F.struct(r.at(x, y).alias("p"), r.at(mx, my).alias("q")), judged))

    states = on_grid(frames, same_w, same_h, state)
    return states.select("frame_id", F.lit(kind).alias("kind"), F.size(F.filter("pixels", lambda s: s > 0)).alias("compared"), F.size(F.filter("pixels", lambda s: s == 2)).alias("mismatched"))


def composited(cels: DataFrame, layers: DataFrame) -> DataFrame:
    """cels: frame_idx, layer_id, w, h, pixels. layers: layer_id, place, opacity,
    visible (a project's layers are few and are broadcast). Visible layers over
    one another, bottom first; a layer's opacity is truncated to a byte."""
    shown = layers.where("visible and opacity > 0").select("layer_id", "place", F.least(F.lit(255), (F.col("opacity").cast("float") * F.lit(255.0).cast("float")).cast("int")).alias("op"))
    return stacked(cels.join(F.broadcast(shown), "layer_id"), ["frame_idx"])


def stacked(cels: DataFrame, keys: list[str]) -> DataFrame:
    """cels: keys, w, h, pixels, place, op (opacity as a byte). The cels of a key
    over one another, least place first."""
    stack = cels.groupBy(*keys, "w", "h").agg(F.sort_array(F.collect_list(F.struct("place", "op", "pixels"))).alias("stack"))
    blank = F.transform(F.sequence(F.lit(0), F.col("w") * F.col("h") - 1), lambda i: F.lit(0))

    def over(below: Column, layer: Column) -> Column:
        def one(d: Column, s: Column) -> Column:
            sa = C.idiv(C.alpha(s) * layer["op"], 255)
            return F.when(sa == 0, d).otherwise(C.blended(s, d, "normal", sa))

        return F.zip_with(below, layer["pixels"], one)

    return stack.select(*keys, "w", "h", F.aggregate("stack", blank, over).alias("pixels"))
