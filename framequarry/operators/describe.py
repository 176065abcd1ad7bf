"""What rasters look like: samples as text, coverage of a palette, findings that
need components, and the score of an audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colour as C
from ..sources.frames import pixels
from . import measures, raster, sequential

#: Shades from empty to full.
RAMP = " .:-=+*#%@"
#: What a finding of each rule takes from the score.
PENALTIES = {"isolated_pixel": 1.0, "broken_corner": 1.0, "accidental_checker": 3.0, "enclosed_hole": 3.0, "tiny_cluster": 1.0, "stair_zigzag": 1.0}
DARK, LIGHT = -15856110, -658968  # fixed values: 0xFF0E0E12 and 0xFFF5F1E8


def _cells(frames: DataFrame, stride: int) -> DataFrame:
    px = pixels(frames)
    return px.select("frame_id", C.idiv(F.col("x"), stride).alias("cx"), C.idiv(F.col("y"), stride).alias("cy"), "argb")


def majorities(frames: DataFrame, stride: int) -> DataFrame:
    """(frame_id, cx, cy, argb): the commonest visible colour of each square, of
    equals the larger; 0 where nothing is visible."""
    tally = _cells(frames, stride).groupBy("frame_id", "cx", "cy", "argb").agg(F.count_if(C.alpha(F.col("argb")) > 0).alias("n"))
    best = F.max(F.when(F.col("n") > 0, F.struct("n", "argb")))
    return tally.groupBy("frame_id", "cx", "cy").agg(best.alias("m")).select("frame_id", "cx", "cy", F.coalesce("m.argb", F.lit(0)).alias("argb"))


def _lines(cells: DataFrame, glyph: Column) -> DataFrame:
    """(frame_id, cy, line) of (frame_id, cx, cy, ...)."""
    rows = cells.groupBy("frame_id", "cy").agg(F.sort_array(F.collect_list(F.struct("cx", glyph.alias("g")))).alias("row"))
    return rows.select("frame_id", "cy", F.array_join("row.g", "").alias("line"))


def shades(frames: DataFrame, stride: int = 1, invert: bool = False) -> DataFrame:
    """Lines of text, a sign a square by the mean luma of what is visible."""
    on = C.alpha(F.col("argb")) > 0
    mean = _cells(frames, stride).groupBy("frame_id", "cx", "cy").agg(F.avg(F.when(on, C.luma601(F.col("argb")))).alias("v"))
    t = F.col("v") / 255.0
    t = 1.0 - t if invert else t
    at = F.least(F.lit(len(RAMP) - 1), F.greatest(F.lit(1), F.floor(1 + t * (len(RAMP) - 2) + 0.5))).cast("int")
    return _lines(mean, F.when(F.col("v").isNull(), F.lit(" ")).otherwise(F.get(F.array(*[F.lit(c) for c in RAMP]), at)))


def blocks(frames: DataFrame, stride: int = 1, ascii_only: bool = False) -> DataFrame:
    """Lines of half blocks: a square counts as on if half of it is visible."""
    seen = _cells(frames, stride).groupBy("frame_id", "cx", "cy").agg((F.count_if(C.alpha(F.col("argb")) > 0) * 2 >= F.count("*")).alias("on"))
    halves = seen.groupBy("frame_id", "cx", C.idiv(F.col("cy"), 2).alias("row")).agg(*[F.coalesce(F.bool_or(F.when(F.col("cy") % 2 == k, F.col("on"))), F.lit(False)).alias(n) for k, n in ((0, "top"), (1, "bottom"))])
    both, top, bottom = ("#", "^", "_") if ascii_only else ("█", "▀", "▄")
    glyph = F.when(F.col("top") & F.col("bottom"), both).when(F.col("top"), top).when(F.col("bottom"), bottom).otherwise(" ")
    return _lines(halves.withColumnRenamed("row", "cy"), glyph)


def distance(c: Column, l: float, a: float, b: float) -> Column:
    """Distance in CIELAB of a lab struct and a constant."""
    return F.sqrt((c["l"] - l) * (c["l"] - l) + (c["a"] - a) * (c["a"] - a) + (c["b"] - b) * (c["b"] - b))


def nearest_entry(c: Column, palette: list[int]) -> Column:
    """(d, idx) of the palette's nearest colour, the first of equals."""
    known = [(k, *raster.lab_of(q)) for k, q in enumerate(palette)]
    return C.let(C.lab(c), lambda v: F.array_min(F.array(*[F.struct(distance(v, x, y, z).alias("d"), F.lit(k).alias("idx")) for k, x, y, z in known])))


def coverage(frames: DataFrame, palette: list[int], tolerance: float = 10.0) -> DataFrame:
    """(frame_id, idx, shades, pixels): how many of a raster's tallied colours
    each palette entry stands for; idx -1: none does."""
    near = nearest_entry(F.col("argb"), palette)
    shade = measures.census(frames).select("frame_id", "cnt", near.alias("m"))
    idx = F.when(F.col("m.d") <= tolerance, F.col("m.idx")).otherwise(-1)
    return shade.groupBy("frame_id", idx.alias("idx")).agg(F.count("*").alias("shades"), F.sum("cnt").alias("pixels"))


def palette_rows(frames: DataFrame, palette: list[int], most: float = 24.0) -> DataFrame:
    """(frame_id, y, text): rows of palette places; -1 where no entry is near, a
    dot where nothing is visible. Each colour is looked up once."""
    px = pixels(frames)
    shade = px.select("argb").distinct().select("argb", nearest_entry(F.col("argb"), palette).alias("m"))
    word = F.when(C.alpha(F.col("argb")) == 0, ".").when(F.col("m.d") <= most, F.col("m.idx").cast("string")).otherwise("-1")
    rows = px.join(shade, "argb").groupBy("frame_id", "y").agg(F.sort_array(F.collect_list(F.struct("x", word.alias("t")))).alias("row"))
    return rows.select("frame_id", "y", F.array_join("row.t", " ").alias("text"))


def outline_for(fill: Column) -> Column:
    """A dark outline for light colours, a light one for dark ones."""
    return F.when(C.lab(fill)["l"] >= 50.0, F.lit(DARK)).otherwise(F.lit(LIGHT))


def blob_findings(frames: DataFrame, tiny: int = 3) -> DataFrame:
    """(frame_id, rule, x, y, argb, area): clusters of one colour below an area,
    and enclosed holes, each at the first of its pixels."""
    def heads(labelled: DataFrame) -> DataFrame:
        flat = labelled.select("frame_id", "w", F.posexplode_outer("pixels").alias("i", "label")).where("label > 0")
        return flat.groupBy("frame_id", "label").agg(F.count("*").alias("area"), F.min("i").alias("i"), F.first("w").alias("w"))

    def place(found: DataFrame, rule: str) -> DataFrame:
        return found.select("frame_id", F.lit(rule).alias("rule"), (F.col("i") % F.col("w")).cast("int").alias("x"), C.idiv(F.col("i"), F.col("w")).alias("y"), "argb", "area")

    clusters = heads(sequential.components(frames, same_colour=True)).where(F.col("area") < tiny)
    clusters = clusters.join(frames.select("frame_id", "pixels"), "frame_id").withColumn("argb", F.get("pixels", F.col("i")))
    holes = heads(sequential.holes(frames)).withColumn("argb", F.lit(0))
    return place(clusters, "tiny_cluster").unionByName(place(holes, "enclosed_hole"))


def scores(frames: DataFrame, tiny: int = 3, tolerance: int = 0) -> DataFrame:
    """(frame_id, findings, score): 100 less the findings' penalties, in relation
    to the side of a square of as many visible pixels."""
    found = raster.audited(frames, tolerance).select("frame_id", "rule").unionByName(blob_findings(frames, tiny).select("frame_id", "rule"))
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in PENALTIES.items() for x in pair]), F.col("rule"))
    sums = found.groupBy("frame_id").agg(F.count("*").alias("findings"), F.sum(weight).alias("penalty"))
    seen = F.size(F.filter("pixels", lambda p: C.alpha(p) > 0))
    out = frames.select("frame_id", seen.alias("seen")).join(sums, "frame_id", "left")
    lost = F.coalesce("penalty", F.lit(0.0)) / F.greatest(F.lit(8.0), F.sqrt("seen")) * 10.0
    score = F.when(F.col("seen") == 0, 100).otherwise(F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100.0 - lost)).cast("int"))
    return out.select("frame_id", F.coalesce("findings", F.lit(0)).alias("findings"), score.alias("score"))
