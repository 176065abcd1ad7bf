"""Aggregates over the pixels of rasters: histograms, censuses, boxes.

A raster's pixels lie in one row, so partial aggregation sums them up before
anything is shuffled; what is shuffled is a row for each bin, colour or cell
that a raster has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import colour as C
from ..sources.frames import dealt, pixels


def visible(px: DataFrame) -> DataFrame:
    return px.where(C.alpha(F.col("argb")) > 0)


def histogram(frames: DataFrame) -> DataFrame:
    """(frame_id, channel, bin, cnt) for r, g, b, luma of visible pixels and for
    alpha of all; empty bins have no row."""
    px = pixels(frames)
    c = F.col("argb")
    seen = C.alpha(c) > 0
    values = F.array(
        F.struct(F.lit("a").alias("channel"), C.alpha(c).alias("bin")),
        *[F.struct(F.lit(n).alias("channel"), F.when(seen, f(c)).alias("bin")) for n, f in (("r", C.red), ("g", C.green), ("b", C.blue), ("luma", C.luma8))],
    )
    flat = px.select("frame_id", F.explode(values).alias("v")).select("frame_id", "v.channel", "v.bin").where("bin is not null")
    return flat.groupBy("frame_id", "channel", "bin").agg(F.count("*").alias("cnt"))


def histogram_stats(hist: DataFrame) -> DataFrame:
    """Count, mean, population variance, entropy in bits and mode of each
    histogram (of equal counts the lowest bin)."""
    total = F.sum("cnt").over(Window.partitionBy("frame_id", "channel"))
    p = F.col("cnt") / F.col("total")
    moments = hist.withColumn("total", total).groupBy("frame_id", "channel").agg(
        F.sum("cnt").alias("n"),
        (F.sum(F.col("bin") * F.col("cnt")) / F.sum("cnt")).alias("mean"),
        F.sum(F.col("bin") * F.col("bin") * F.col("cnt")).alias("square"),
        F.sum(-p * F.log2(p)).alias("entropy"),
        F.max(F.struct("cnt", (-F.col("bin")).alias("k"))).alias("top"),
    )
    return moments.select("frame_id", "channel", "n", "mean", (F.col("square") / F.col("n") - F.col("mean") * F.col("mean")).alias("variance"), "entropy", (-F.col("top.k")).alias("mode"))


def cumulative(hist: DataFrame) -> DataFrame:
    w = Window.partitionBy("frame_id", "channel")
    upto = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return hist.withColumn("upto", F.sum("cnt").over(upto)).withColumn("total", F.sum("cnt").over(w))


def percentiles(hist: DataFrame, fractions: list[float]) -> DataFrame:
    """The first bin whose cumulative count reaches ceil(fraction * total), at
    least 1."""
    rows = cumulative(hist)
    out = [F.min(F.when(F.col("upto") >= F.greatest(F.lit(1), F.ceil(F.lit(f) * F.col("total"))), F.col("bin"))).alias(f"p{round(f * 100)}") for f in fractions]
    return rows.groupBy("frame_id", "channel").agg(*out)


def otsu(hist: DataFrame, channel: str = "luma") -> DataFrame:
    """(frame_id, threshold) of the largest variance between two classes, the
    lowest of equals. Only bins that hold something can begin a new maximum."""
    w = Window.partitionBy("frame_id")
    upto = w.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = hist.where(F.col("channel") == channel)
    rows = own.select("frame_id", "bin", F.sum("cnt").over(upto).cast("double").alias("w0"), F.sum(F.col("bin") * F.col("cnt")).over(upto).cast("double").alias("s0"), F.sum("cnt").over(w).cast("double").alias("n"), F.sum(F.col("bin") * F.col("cnt")).over(w).cast("double").alias("s"))
    w1 = F.col("n") - F.col("w0")
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / w1
    scored = rows.withColumn("score", F.when((w1 > 0) & (F.col("bin") < 255), F.col("w0") * w1 * gap * gap))
    best = scored.groupBy("frame_id").agg(F.max(F.when(F.col("score").isNotNull(), F.struct("score", (-F.col("bin")).alias("k")))).alias("m"))
    return best.select("frame_id", F.coalesce(-F.col("m.k"), F.lit(0)).alias("threshold"))


def census(frames: DataFrame, most: int = 64) -> DataFrame:
    """Visible colours of each raster by count, then by signed value, the first
    `most`: frame_id, rank, argb, hex, family, cnt."""
    tallies = visible(pixels(frames)).groupBy("frame_id", "argb").agg(F.count("*").alias("cnt"))
    rank = F.row_number().over(Window.partitionBy("frame_id").orderBy(F.desc("cnt"), "argb"))
    c = F.col("argb")
    return tallies.withColumn("rank", rank).where(F.col("rank") <= most).select("frame_id", "rank", "argb", C.hex_colour(c).alias("hex"), C.family(c).alias("family"), "cnt")


def families(frames: DataFrame) -> DataFrame:
    """Shades and pixels of each hue family in a raster."""
    tallies = visible(pixels(frames)).groupBy("frame_id", "argb").agg(F.count("*").alias("cnt"))
    return tallies.groupBy("frame_id", C.family(F.col("argb")).alias("family")).agg(F.count("*").alias("shades"), F.sum("cnt").alias("cnt"))


def content_box(frames: DataFrame) -> DataFrame:
    """x, y, width and height of what is visible; rasters without have no row."""
    found = visible(pixels(frames)).groupBy("frame_id").agg(*[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("x", "y")])
    return found.select("frame_id", F.col("min_x").alias("x"), F.col("min_y").alias("y"), (F.col("max_x") - F.col("min_x") + 1).alias("width"), (F.col("max_y") - F.col("min_y") + 1).alias("height"))


def occupancy(frames: DataFrame, target: int = 12) -> DataFrame:
    """A grid of at most target cells a side; level 0 to 4 by the share of
    visible pixels."""
    px = pixels(frames).join(frames.select("frame_id", "w", "h"), "frame_id")
    w, h = F.col("w"), F.col("h")
    cells = F.least(F.lit(target), F.greatest(w, h))
    cols = F.when(w >= h, cells).otherwise(F.greatest(F.lit(1), C.idiv(w * cells, h)))
    rows = F.when(w >= h, F.greatest(F.lit(1), C.idiv(h * cells, w))).otherwise(cells)
    gx, gy = C.idiv(F.col("x"), C.idiv(w + cols - 1, cols)), C.idiv(F.col("y"), C.idiv(h + rows - 1, rows))
    grid = px.groupBy("frame_id", gx.alias("gx"), gy.alias("gy")).agg(F.count_if(C.alpha(F.col("argb")) > 0).alias("seen"), F.count("*").alias("total"))
    share = F.col("seen") / F.col("total")
    level = F.when(F.col("seen") == 0, 0).when(share <= 0.25, 1).when(share <= 0.5, 2).when(share <= 0.75, 3).otherwise(4)
    return grid.select("frame_id", "gx", "gy", level.alias("level"))


def runs(frames: DataFrame) -> DataFrame:
    """Runs of one colour along each row: frame_id, y, x, length, argb."""
    px = pixels(frames)
    row = Window.partitionBy("frame_id", "y").orderBy("x")
    change = px.withColumn("new", (F.col("argb") != F.lag("argb", 1).over(row)) | F.lag("argb", 1).over(row).isNull())
    numbered = change.withColumn("run", F.sum(F.col("new").cast("int")).over(row.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy("frame_id", "y", "run").agg(F.min("x").alias("x"), F.count("*").alias("length"), F.first("argb").alias("argb")).drop("run")


def _mapped_luma(frames: DataFrame, table: DataFrame) -> DataFrame:
    """Pixels scaled so that their luma becomes lut[luma]."""

    def rule(p: Column) -> Column:
        now, want = C.luma8(p), F.get("lut", C.luma8(p))
        gain = want / F.greatest(now, F.lit(1))
        lit_ = F.when(now == 0, C.pack(C.alpha(p), want, want, want)).otherwise(C.channels(p, lambda v: C.clamp8(F.floor(v * gain + 0.5).cast("int"))))
        return F.when((C.alpha(p) == 0) | (now == want), p).otherwise(lit_)

    joined = frames.join(table, "frame_id", "left")
    return joined.withColumn("pixels", F.when(F.col("lut").isNull(), F.col("pixels")).otherwise(F.transform("pixels", rule))).select(*frames.columns)


def stretched(frames: DataFrame, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Automatic levels: luma between two percentiles spreads over the range."""
    limits = percentiles(histogram(frames).where("channel = 'luma'"), [low, high])
    a, b = (F.col(f"p{round(x * 100)}") for x in (low, high))

    def level(v: Column) -> Column:
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - a) / (b - a)))
        return C.clamp8(F.floor(t * 255.0 + 0.5).cast("int"))

    lut = limits.where(b > a).select("frame_id", F.transform(F.sequence(F.lit(0), F.lit(255)), level).alias("lut"))
    return _mapped_luma(frames, lut)


def white_balanced(frames: DataFrame, strength: float = 1.0) -> DataFrame:
    """Grey world: channel means of a raster are brought to their mean."""
    c = F.col("argb")
    sums = visible(pixels(frames)).groupBy("frame_id").agg(*[F.avg(f(c)).alias(n) for n, f in (("mr", C.red), ("mg", C.green), ("mb", C.blue))])
    target = (F.col("mr") + F.col("mg") + F.col("mb")) / 3.0
    gains = sums.where(target > 0).select("frame_id", *[(target / F.greatest(F.col(n), F.lit(1.0))).alias(f"g{n[1]}") for n in ("mr", "mg", "mb")])

    def rule(p: Column) -> Column:
        def one(v: Column, g: str) -> Column:
            return C.clamp8((v + (v * F.col(g) - v) * F.lit(strength)).cast("int"))

        return F.when(C.alpha(p) == 0, p).otherwise(C.pack(C.alpha(p), one(C.red(p), "gr"), one(C.green(p), "gg"), one(C.blue(p), "gb")))

    joined = frames.join(gains, "frame_id", "left")
    return joined.withColumn("pixels", F.when(F.col("gr").isNull(), F.col("pixels")).otherwise(F.transform("pixels", rule))).select(*frames.columns)


def equalized(frames: DataFrame) -> DataFrame:
    """Luma spread by its cumulative histogram."""
    rows = cumulative(histogram(frames).where("channel = 'luma'"))
    spread = F.least(F.lit(255), F.greatest(F.lit(0), F.floor((F.col("upto") - 1) / F.greatest(F.lit(1), F.col("total") - 1) * 255.0 + 0.5))).cast("int")
    table = rows.select("frame_id", "bin", spread.alias("level")).groupBy("frame_id").agg(F.map_from_entries(F.collect_list(F.struct("bin", "level"))).alias("m"))
    lut = table.select("frame_id", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: F.element_at("m", v)).alias("lut"))
    return _mapped_luma(frames, lut)


def class_limits(counts: np.ndarray, levels: int) -> list[int]:
    """Upper bins of all classes but the last that make the sum of n * mean**2
    largest, over 256 bins, by dynamic programming over the bins that hold something:
    a limit in a gap is as good at its lower end."""
    if not 2 <= levels <= 8:
        raise ValueError("levels are 2 to 8")
    if counts.sum() <= 1:
        return [0] * (levels - 1)
    n = np.concatenate([[0], np.cumsum(counts)]).astype(float)
    s = np.concatenate([[0], np.cumsum(counts * np.arange(256))]).astype(float)
    ends = np.concatenate([[0], np.flatnonzero(np.diff(n)) + 1])
    if len(ends) <= levels:  # fewer bins that hold something than classes: some class is empty
        ends = np.arange(257)
    n, s, k = n[ends], s[ends], len(ends)
    size = n[None, :] - n[:, None]  # [from, until)
    score = np.where(size > 0, (s[None, :] - s[:, None]) ** 2 / np.where(size > 0, size, 1), 0.0)
    best, cuts = score[0].copy(), []
    best[0] = -np.inf
    for _ in range(levels - 1):
        total = np.where(np.arange(k)[:, None] < np.arange(k)[None, :], best[:, None] + score, -np.inf)
        cuts.append(total.argmax(0))
        best = total.max(0)
    out, at = [], k - 1
    for cut in reversed(cuts):
        at = int(cut[at])
        out.append(int(ends[at]) - 1)
    return sorted(out)


def otsu_levels(hist: DataFrame, levels: int, channel: str = "luma") -> DataFrame:
    """(frame_id, thresholds) of more than two classes; a raster's histogram has
    256 rows at most, which meet in one row, and rows go through in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for bins, cnt in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                counts = np.zeros(256, np.int64)
                counts[bins] = cnt
                found.append(class_limits(counts, levels))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["frame_id", "thresholds"])

    own = hist.where(F.col("channel") == channel)
    kind = own.schema["frame_id"].dataType.simpleString()
    rows = own.groupBy("frame_id").agg(F.collect_list(F.struct("bin", "cnt")).alias("h"))
    return dealt(rows.select("frame_id", "h.bin", "h.cnt")).mapInArrow(run, f"frame_id {kind}, thresholds array<int>")
