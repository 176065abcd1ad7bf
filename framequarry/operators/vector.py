"""Rasters as SVG text and colours as named tallies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import colour as C
from ..functions import names
from . import measures


def svg(frames: DataFrame) -> DataFrame:
    """(frame_id, svg): a path of horizontal runs for each visible colour, in the
    order in which colours are first seen. Runs are summed up by colour and then
    by raster; rasters without a visible pixel give an empty drawing."""
    runs = measures.runs(frames).where(C.alpha(F.col("argb")) > 0)
    piece = F.concat(F.lit("M"), F.col("x"), F.lit(" "), F.col("y"), F.lit("h"), F.col("length"), F.lit("v1h-"), F.col("length"), F.lit("z"))
    paths = runs.groupBy("frame_id", "argb").agg(F.array_sort(F.collect_list(F.struct("y", "x", piece.alias("d")))).alias("r"))
    opacity = F.when(C.alpha(F.col("argb")) == 255, F.lit("")).otherwise(F.concat(F.lit(' fill-opacity="'), F.format_number(C.alpha(F.col("argb")) / 255.0, 2), F.lit('"')))
    text = F.concat(F.lit('  <path fill="#'), F.lpad(F.hex(F.col("argb").bitwiseAND(0xFFFFFF)), 6, "0"), F.lit('"'), opacity, F.lit(' d="'), F.array_join(F.transform("r", lambda s: s["d"]), ""), F.lit('"/>\n'))
    first = F.struct(F.get("r", F.lit(0))["y"].alias("y"), F.get("r", F.lit(0))["x"].alias("x"), text.alias("t"))
    drawn = paths.select("frame_id", first.alias("p")).groupBy("frame_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    head = F.format_string('<?xml version="1.0" encoding="UTF-8"?>\n<svg xmlns="http://www.w3.org/2000/svg" width="%d" height="%d" viewBox="0 0 %d %d" shape-rendering="crispEdges">\n', "w", "h", "w", "h")
    joined = frames.select("frame_id", "w", "h").join(drawn, "frame_id", "left")
    return joined.select("frame_id", F.concat(head, F.coalesce(F.array_join(F.transform("p", lambda s: s["t"]), ""), F.lit("")), F.lit("</svg>\n")).alias("svg"))


def named_colours(frames: DataFrame) -> DataFrame:
    """(frame_id, argb, name, distance, cnt) of the visible colours of a raster.
    Names are looked up once a colour, of which there are far fewer than pixels."""
    px = measures.visible(measures.pixels(frames)).groupBy("frame_id", "argb").agg(F.count("*").alias("cnt"))
    named = px.select("argb").distinct().withColumn("n", names.nearest(F.col("argb")))
    return px.join(named, "argb").select("frame_id", "argb", "n.name", "n.distance", "cnt")


def analysed(frames: DataFrame, solid: int = 128) -> DataFrame:
    """What a conversion of each raster should aim at: size, number of colours,
    palette, brightness, and whether anything is not opaque."""
    own = measures.pixels(frames).withColumn("solid", C.alpha(F.col("argb")) >= solid).withColumn("lab", F.when(F.col("solid"), C.lab(F.col("argb"))))
    own = own.withColumn("chroma", F.sqrt(F.col("lab.a") * F.col("lab.a") + F.col("lab.b") * F.col("lab.b")))
    hue = F.pmod(F.degrees(F.atan2("lab.b", "lab.a")), F.lit(360.0))
    coloured = F.col("chroma") >= 6.0
    tally = own.groupBy("frame_id", "argb").agg(
        F.count_if("solid").alias("n"),
        F.count("*").alias("total"),
        F.first("lab.l").alias("l"),
        F.first("chroma").alias("chroma"),
        F.first(F.coalesce(coloured & (hue >= 200) & (hue < 310), F.lit(False))).alias("blue"),
        F.first(F.coalesce(coloured & (hue >= 50) & (hue < 95), F.lit(False))).alias("orange"),
    )
    n = F.sum("n")
    rgb = F.when(F.col("n") > 0, F.col("argb").bitwiseAND(0xFFFFFF))
    found = tally.groupBy("frame_id").agg(
        n.alias("n"),
        F.countDistinct(rgb).alias("colours"),
        F.max(C.alpha(F.col("argb")) != 255).alias("has_alpha"),
        *[(F.coalesce(F.sum(F.col(c) * F.col("n")), F.lit(0.0)) / F.greatest(n, F.lit(1))).alias(c) for c in ("l", "chroma")],
        *[(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)) / F.greatest(n, F.lit(1))).alias(c) for c in ("blue", "orange")],
    )
    palette = F.when(F.col("chroma") < 12, "gameboy").when(F.col("blue") > 0.5, "kimi").when(F.col("orange") > 0.35, "clawd").when((F.col("chroma") > 30) & (F.col("colours") >= 12), "pico-8").otherwise("endesga-32")
    both = found.withColumn("palette", palette).join(frames.select("frame_id", "w", "h"), "frame_id")
    long_, short = F.greatest("w", "h"), F.least("w", "h")
    snapped = F.when(long_ <= 24, 16).when(long_ <= 48, 32).otherwise(64)
    scaled = F.greatest(F.lit(1), C.idiv(short * snapped + C.idiv(long_, 2), long_))
    wide = F.col("w") >= F.col("h")
    count = F.when(F.col("colours") <= 16, F.col("colours").cast("int")).when(F.col("palette") == "endesga-32", 32).otherwise(16)
    return both.select("frame_id", F.when(wide, snapped).otherwise(scaled).alias("width"), F.when(wide, scaled).otherwise(snapped).alias("height"), count.alias("colour_count"), "palette", (F.col("l") / 100).alias("brightness"), "has_alpha")
