"""Components of rasters too large for one row: tiles are labelled by themselves,
and labels that touch across a seam are joined.

Only pixels on the edges of tiles are shuffled for that. The graph has a node for
each label at a seam; it stays a distributed table and is contracted until it no
longer changes, each round cut off by a checkpoint. Nodes meet their neighbours, but
roots are looked up by a join on the root: a raster that is one single component has
one root for all its tiles, which only adaptive skew handling spreads.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colour as C
from ..sources.frames import TILE, gathered
from . import sequential


def tiled(px: DataFrame, size: int = TILE) -> DataFrame:
    """Rasters of size x size whose frame_id is the struct frame_id, tile_x,
    tile_y; absent pixels are transparent."""
    key = F.struct("frame_id", C.idiv(F.col("x"), size).alias("tile_x"), C.idiv(F.col("y"), size).alias("tile_y"))
    return gathered(px.select(key.alias("frame_id"), (F.col("x") % size).alias("x"), (F.col("y") % size).alias("y"), "argb"), size, size)


def _cut(df: DataFrame) -> DataFrame:
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(found or tempfile.mkdtemp(prefix="framequarry-"))
    return df.checkpoint()


def _roots(edges: DataFrame) -> DataFrame:
    """(node, root) with root the least node that node reaches. Each round a node
    takes the least root among its neighbours', then its root's root."""
    both = _cut(edges.union(edges.select("v", "u")).distinct())
    now = _cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("root")))
    while True:
        near = both.join(now.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        better = now.join(near, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("old"))
        above = better.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = _cut(better.join(above, "root", "left").select("node", F.least("root", F.coalesce("up", "root")).alias("root"), "old"))
        if new.where("root <> old").isEmpty():
            return new.select("node", "root")
        now = new.select("node", "root")


def components(tiles: DataFrame, size: int = TILE) -> DataFrame:
    """(frame_id, area, x, y, width, height) of each component (4 neighbours) of
    visible pixels, for what `tiled` returns. Rasters without any have no row."""
    labelled = _cut(sequential.components(tiles))
    tile = F.col("frame_id")
    node = F.struct(tile["frame_id"].alias("frame_id"), tile["tile_x"].alias("tile_x"), tile["tile_y"].alias("tile_y"), F.col("label").alias("label"))
    flat = labelled.select("frame_id", F.posexplode("pixels").alias("i", "label")).where("label > 0")
    lx, ly = (F.col("i") % size).cast("int"), C.idiv(F.col("i"), size)
    here = flat.select(node.alias("node"), tile["frame_id"].alias("f"), (tile["tile_x"] * size + lx).alias("x"), (tile["tile_y"] * size + ly).alias("y"), lx.alias("lx"), ly.alias("ly"))

    def seam(last: Column, first: Column, dx: int, dy: int) -> DataFrame:
        a = here.where(last).select("f", (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), F.col("node").alias("u"))
        return a.join(here.where(first).select("f", "x", "y", F.col("node").alias("v")), ["f", "x", "y"]).select("u", "v")

    x, y = F.col("lx"), F.col("ly")
    edges = seam(x == size - 1, x == 0, 1, 0).union(seam(y == size - 1, y == 0, 0, 1)).distinct()
    parts = here.groupBy("node").agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for k, f in (("lo", F.min), ("hi", F.max)) for c in "xy"])
    whole = parts.join(_roots(edges), "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
    found = whole.agg(F.sum("n").alias("area"), *[f(f"{k}_{c}").alias(f"{k}_{c}") for k, f in (("lo", F.min), ("hi", F.max)) for c in "xy"])
    return found.select("root.frame_id", "area", F.col("lo_x").alias("x"), F.col("lo_y").alias("y"), (F.col("hi_x") - F.col("lo_x") + 1).alias("width"), (F.col("hi_y") - F.col("lo_y") + 1).alias("height"))
