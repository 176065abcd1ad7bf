"""Tile maps as relations: cells of layers, and tiles.

cells: map_id, layer (place, bottom first), x, y, tile (below 0: empty), flip
(1: mirrored across, 2: down, 3: both). tiles: tile, pixels of a square raster,
terrain. An empty cell may be absent. Tiles are few and of fixed size, so they are
sent to the cells; a join by tile would bring all cells of a tile into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour as C
from .pairs import stacked

EMPTY = -1
FLIPS = ("none", "horizontal", "vertical", "both")


def flip_name(bits: Column) -> Column:
    """The name of flip bits; null outside 0 to 3."""
    return F.get(F.array(*[F.lit(n) for n in FLIPS]), bits.cast("int"))


def empty(spark: SparkSession, map_id: int, layer: int, w: int, h: int) -> DataFrame:
    """Cells of an empty layer."""
    i = F.col("id")
    return spark.range(w * h).select(F.lit(map_id).cast("long").alias("map_id"), F.lit(layer).alias("layer"), (i % w).cast("int").alias("x"), C.idiv(i, w).alias("y"), F.lit(EMPTY).alias("tile"), F.lit(0).alias("flip"))


def filled(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("tile") >= 0)


def cell_at(cells: DataFrame, layer: int, x: int, y: int) -> DataFrame:
    """(map_id, tile, flip) of one place in each map, empty where there is none."""
    here = (F.col("layer") == layer) & (F.col("x") == x) & (F.col("y") == y)
    found = F.max(F.when(here, F.struct("tile", "flip")))
    return cells.groupBy("map_id").agg(found.alias("c")).select("map_id", F.coalesce("c.tile", F.lit(EMPTY)).alias("tile"), F.coalesce("c.flip", F.lit(0)).alias("flip"))


def with_cells(cells: DataFrame, new: DataFrame) -> DataFrame:
    """New cells in place of old ones: one join on the cell."""
    key = ["map_id", "layer", "x", "y"]
    return cells.join(new, key, "left_anti").unionByName(new)


def layer_inserted(cells: DataFrame, at: int, layer: DataFrame) -> DataFrame:
    """layer: map_id, x, y, tile, flip. A layer at a place of the stack; those
    above move up. Past the top it goes on top."""
    top = cells.groupBy("map_id").agg((F.max("layer") + 1).alias("top"))
    moved = cells.withColumn("layer", F.when(F.col("layer") >= at, F.col("layer") + 1).otherwise(F.col("layer")))
    new = layer.join(top, "map_id", "left").withColumn("layer", F.least(F.lit(at), F.coalesce("top", F.lit(0)))).drop("top")
    return moved.unionByName(new)


def layer_dropped(cells: DataFrame, layer: int) -> DataFrame:
    return cells.where(F.col("layer") != layer).withColumn("layer", F.when(F.col("layer") > layer, F.col("layer") - 1).otherwise(F.col("layer")))


def tile_added(tiles: DataFrame, pixels: list[int], terrain: int = 0) -> DataFrame:
    """A tileset with one tile more; a tileset is small and of fixed size."""
    new = tiles.agg((F.max("tile") + 1).cast("int").alias("tile")).select("tile", F.array(*[F.lit(p) for p in pixels]).alias("pixels"), F.lit(terrain).alias("terrain"))
    return tiles.unionByName(new)


def terrain_of(cells: DataFrame, tiles: DataFrame) -> DataFrame:
    """Cells with the terrain of their tile; empty and unknown ones have 0."""
    return cells.join(F.broadcast(tiles.select("tile", "terrain")), "tile", "left").withColumn("terrain", F.coalesce("terrain", F.lit(0)))


def _flipped(size: int) -> Column:
    def source(p: Column, i: Column) -> Column:
        x, y = (i % size).cast("int"), C.idiv(i, size)
        sx = F.when(F.col("flip").bitwiseAND(1) != 0, size - 1 - x).otherwise(x)
        sy = F.when(F.col("flip").bitwiseAND(2) != 0, size - 1 - y).otherwise(y)
        return F.get("pixels", (sy * size + sx).cast("int"))

    return F.when(F.col("flip") == 0, F.col("pixels")).otherwise(F.transform("pixels", source))


def rendered(cells: DataFrame, tiles: DataFrame, size: int) -> DataFrame:
    """(map_id, x, y, argb): the pixels of the cells that have tiles. The tiles
    of a cell lie over one another within a row; maps are not gathered."""
    met = filled(cells).join(F.broadcast(tiles.select("tile", "pixels")), "tile")
    layers = met.select("map_id", F.col("x").alias("cx"), F.col("y").alias("cy"), F.lit(size).alias("w"), F.lit(size).alias("h"), F.col("layer").alias("place"), F.lit(255).alias("op"), _flipped(size).alias("pixels"))
    flat = stacked(layers, ["map_id", "cx", "cy"]).select("map_id", "cx", "cy", F.posexplode_outer("pixels").alias("i", "argb"))
    return flat.select("map_id", (F.col("cx") * size + F.col("i") % size).cast("int").alias("x"), (F.col("cy") * size + C.idiv(F.col("i"), size)).cast("int").alias("y"), "argb")


def rendered_region(cells: DataFrame, tiles: DataFrame, size: int, x0: int, y0: int, w: int, h: int) -> DataFrame:
    """A window of cells, whose corner is at (0, 0) of the result."""
    own = cells.where((F.col("x") >= x0) & (F.col("x") < x0 + w) & (F.col("y") >= y0) & (F.col("y") < y0 + h))
    return rendered(own.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0}), tiles, size)


def to_screen(x: Column, y: Column, tile_w: int, tile_h: int) -> Column:
    """Where a cell lies on an isometric screen."""
    return F.struct(((x - y) * (tile_w // 2)).cast("int").alias("x"), ((x + y) * (tile_h // 2)).cast("int").alias("y"))


def to_cell(x: Column, y: Column, tile_w: int, tile_h: int) -> Column:
    """The cell at a place of an isometric screen, rounded half up, none below 0."""
    a, b = x / float(tile_w // 2), y / float(tile_h // 2)
    return F.struct(*[F.greatest(F.lit(0), F.floor(v / 2 + 0.5).cast("int")).alias(n) for n, v in (("x", a + b), ("y", b - a))])
