"""Sheets: many rasters packed onto one, with a table of where each lies.

A timeline of any length is dealt into sheets of a bounded number of rasters, in its
order (`sheeted`); all that follows is by sheet. Only sizes travel for the packing;
pixels meet once, in the group of the sheet that they are drawn on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import colour as C
from ..sources.frames import numbered
from . import raster

IMAGE = "atlas.png"
FORMATS = ("generic", "godot3", "godot4", "phaser", "tiled")
_PLACED = "array<struct<x:int,y:int,w:int,h:int,rotated:boolean>>"


def sheeted(frames: DataFrame, most: int = 256) -> DataFrame:
    """frames with sheet, a struct (tag, no), and their place in it: `most` of a
    tag's rasters in the order of their keys to a sheet."""
    if most < 1:
        raise ValueError("a sheet takes 1 raster or more")
    rows = numbered(frames)
    sheet = F.struct("tag", C.idiv(F.col("place"), most).alias("no"))
    return rows.withColumn("sheet", sheet).withColumn("place", F.col("place") % most)


def _fitting(free: np.ndarray, w: int, h: int, turn: bool) -> tuple[int, int, bool] | None:
    """Where a box leaves the least over along one side of a free rectangle; of
    equals most along the other, then the earlier one, then the box as it stands."""
    found = None
    for turned, (a, b) in enumerate([(w, h), (h, w)] if turn else [(w, h)]):
        over = free[:, 2:] - (a, b)
        fits = np.flatnonzero((over >= 0).all(1))
        if len(fits):
            short, long = over[fits].min(1), over[fits].max(1)
            k = np.lexsort((fits, -long, short))[0]
            score = (short[k], -long[k], fits[k], turned)
            if found is None or score < found[0]:
                found = score, int(free[fits[k], 0]), int(free[fits[k], 1]), bool(turned)
    return found and found[1:]


def _without(free: np.ndarray, x: int, y: int, w: int, h: int) -> np.ndarray:
    """The largest free rectangles once a box is taken. One that the box cuts gives
    way, at its place in the list, to what is left below, above, right and left of
    the box; then those inside another go, of equals all but the last."""
    x0, y0, x1, y1 = free[:, 0], free[:, 1], free[:, 0] + free[:, 2], free[:, 1] + free[:, 3]
    cut = (x < x1) & (x + w > x0) & (y < y1) & (y + h > y0)
    wide, high, none = x1 - x0, y1 - y0, np.zeros_like(x0)
    below = np.stack([x0, none + y + h, wide, y1 - (y + h)], 1)
    above = np.stack([x0, y0, wide, y - y0], 1)
    right = np.stack([none + x + w, y0, x1 - (x + w), high], 1)
    left = np.stack([x0, y0, x - x0, high], 1)
    parts = np.stack([np.where(cut[:, None], below, free), above, right, left], 1)
    there = (parts[:, :, 2:] > 0).all(2) & (cut[:, None] | (np.arange(4) == 0))
    rest = parts[there]
    low, far = rest[:, :2], rest[:, :2] + rest[:, 2:]
    inside = (low[None] <= low[:, None]).all(2) & (far[None] >= far[:, None]).all(2)
    same = inside & inside.T
    k = np.arange(len(rest))
    return rest[~((inside & ~same) | (same & (k[None] > k[:, None]))).any(1)]


def _boxed(ws: np.ndarray, hs: np.ndarray, turn: bool) -> list[dict]:
    """Boxes placed one by one, each where it fits best into the largest free
    rectangles; one that fits nowhere goes to the right of all."""
    free, out, edge = np.array([[0, 0, ws.sum(), hs.sum()]], np.int64), [], 0
    for w, h in zip(ws.tolist(), hs.tolist(), strict=True):
        x, y, turned = _fitting(free, w, h, turn) or (edge, 0, False)
        if turned:
            w, h = h, w
        free, edge = _without(free, x, y, w, h), max(edge, x + w)
        out.append({"x": x, "y": y, "w": w, "h": h, "rotated": turned})
    return out


def _up(v: Column) -> Column:
    """The next power of two."""
    return F.when(v <= 1, 1).otherwise(F.pow(F.lit(2.0), F.length(F.bin(v - 1))).cast("int"))


def packed(sprites: DataFrame, padding: int = 0, turn: bool = False, powers: bool = False, shelf: bool = False) -> DataFrame:
    """(sheet, frame_id, place, x, y, w, h, rotated, sheet_w, sheet_h) of sprites
    (sheet, frame_id, place, w, h). A sprite keeps `padding` pixels clear on each
    side; a turned one has its height for its width. Sprites go by their place into
    the largest free rectangles, with `shelf` in one row, the highest first. powers:
    the sheet's sides are powers of two."""
    if padding < 0:
        raise ValueError("the padding is 0 or more")
    p, all_of = 2 * padding, Window.partitionBy("sheet")
    own = sprites.select("sheet", "frame_id", "place", "w", "h")
    if shelf:
        before = F.coalesce(F.sum(F.col("w") + p).over(all_of.orderBy(F.desc("h"), "frame_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        laid = own.select("sheet", "frame_id", "place", before.cast("int").alias("x"), F.lit(0).alias("y"), F.col("w") + p, F.col("h") + p, F.lit(False).alias("rotated"))
        laid = laid.toDF("sheet", "frame_id", "place", "x", "y", "w", "h", "rotated")
    else:

        @F.pandas_udf(_PLACED)
        def boxed(ws: pd.Series, hs: pd.Series) -> pd.Series:
            return pd.Series([_boxed(np.asarray(w, np.int64), np.asarray(h, np.int64), turn) for w, h in zip(ws, hs, strict=True)])

        rows = own.groupBy("sheet").agg(F.array_sort(F.collect_list(F.struct("place", "frame_id", "w", "h"))).alias("b"))
        side = lambda c: F.transform("b", lambda s: s[c] + p)
        each = rows.select("sheet", F.explode(F.arrays_zip("b", boxed(side("w"), side("h")).alias("at"))).alias("r"))
        laid = each.select("sheet", "r.b.frame_id", "r.b.place", "r.at.*")
    size = lambda at, side: (_up if powers else lambda v: v)(F.max(F.col(at) + F.col(side)).over(all_of)).cast("int")
    whole = laid.withColumns({"sheet_w": size("x", "w"), "sheet_h": size("y", "h")})
    return whole.withColumns({"x": F.col("x") + padding, "y": F.col("y") + padding, "w": F.col("w") - p, "h": F.col("h") - p})


def trimmed(sprites: DataFrame) -> DataFrame:
    """sprites cut to what is visible, with original (w, h, x, y): their size before
    and where the cut begins; null where nothing is visible, and nothing cut."""
    known = sprites.withColumn("__b", raster.content(F.struct("w", "h", "pixels")))
    was = F.when(F.col("__b.x0").isNotNull(), F.struct("w", "h", F.col("__b.x0").alias("x"), F.col("__b.y0").alias("y")))
    return raster.trimmed(known.withColumn("original", was).drop("__b"))


def regions(sprites: DataFrame, padding: int = 1, extrude: int = 0, **options: bool) -> DataFrame:
    """What `packed` gives, with room for edges drawn `extrude` times over, and the
    original of trimmed sprites."""
    if min(padding, extrude) < 0:
        raise ValueError("padding and extrusion are 0 or more")
    laid = packed(sprites, padding + extrude, **options)
    if "original" not in sprites.columns:
        return laid.withColumn("original", F.lit(None).cast("struct<w:int,h:int,x:int,y:int>"))
    return laid.join(sprites.select("sheet", "frame_id", "original"), ["sheet", "frame_id"])


def drawn(sprites: DataFrame, laid: DataFrame, extrude: int = 0) -> DataFrame:
    """Sheets as rasters (frame_id, w, h, pixels), frame_id being the sheet. Pixels
    of a sheet, bounded by what was dealt to it, meet in one group."""
    places = laid.select("sheet", "frame_id", "x", "y", "rotated", "sheet_w", "sheet_h")
    met = sprites.select("sheet", "frame_id", "w", "h", "pixels").join(places, ["sheet", "frame_id"])
    rows = met.groupBy("sheet").agg(F.first("sheet_w").alias("w"), F.first("sheet_h").alias("h"), F.collect_list(F.struct("x", "y", F.col("w").alias("sw"), F.col("h").alias("sh"), "rotated", "pixels")).alias("s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a sheet at a time, for its size
                w, h = batch.column(1)[k].as_py(), batch.column(2)[k].as_py()
                canvas, own = np.zeros((h, w), np.int32), batch.column(3)[k].values
                x, y, sw, sh, turned = (own.field(c).to_numpy(zero_copy_only=False) for c in range(5))
                for i in range(len(own)):
                    part = own.field(5)[i].values.fill_null(0).to_numpy().reshape(sh[i], sw[i])
                    part = np.pad(np.rot90(part, -1) if turned[i] else part, extrude, "edge")
                    canvas[y[i] - extrude : y[i] - extrude + part.shape[0], x[i] - extrude : x[i] - extrude + part.shape[1]] = part
                pixels = pa.ListArray.from_arrays(pa.array([0, w * h], pa.int32()), pa.array(canvas.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), batch.column(2).slice(k, 1), pixels], ["frame_id", "w", "h", "pixels"])

    return rows.mapInArrow(run, f"frame_id {rows.schema['sheet'].dataType.simpleString()}, w int, h int, pixels array<int>")


def _tiled(r: Column, w: Column, h: Column) -> Column:
    """A sheet as a grid of equal tiles; null where its regions are none."""

    def axis(c: str, side: Column) -> tuple[Column, Column, Column]:
        at = F.array_sort(F.array_distinct(F.transform(r, lambda s: s[c])))
        gaps = F.array_distinct(F.transform(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), lambda v, i: v - F.get(at, i) - side))
        return F.size(at), gaps, F.get(at, F.lit(0))

    tile_w, tile_h = F.get(r, F.lit(0))["w"], F.get(r, F.lit(0))["h"]
    across, gaps_x, x0 = axis("x", tile_w)
    down, gaps_y, y0 = axis("y", tile_h)
    gaps = F.array_distinct(F.concat(gaps_x, gaps_y))
    even = F.forall(r, lambda s: (s["w"] == tile_w) & (s["h"] == tile_h) & ~s["rotated"])
    grid = even & (across * down == F.size(r)) & (F.size(gaps) <= 1) & F.coalesce(F.get(gaps, F.lit(0)) >= 0, F.lit(True))
    fields = {"columns": across, "image": F.lit(IMAGE), "imageheight": h, "imagewidth": w, "margin": F.least(x0, y0), "spacing": F.coalesce(F.get(gaps, F.lit(0)), F.lit(0)), "tilecount": F.size(r), "tileheight": tile_h, "tilewidth": tile_w, "type": F.lit("tileset")}
    return F.when(grid, F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])))


def metadata(laid: DataFrame, format: str = "generic") -> DataFrame:
    """(sheet, json) of regions, in the order of their places; names are their keys.
    `tiled` is null for sheets that are no grid of equal tiles."""
    if format not in FORMATS:
        raise ValueError(f"no format {format!r}; there are {', '.join(FORMATS)}")
    one = F.struct("place", F.col("frame_id").cast("string").alias("name"), "x", "y", "w", "h", "rotated", "original")
    rows = laid.groupBy("sheet").agg(F.array_sort(F.collect_list(one), lambda a, b: a["place"] - b["place"]).alias("r"), F.first("sheet_w").alias("sw"), F.first("sheet_h").alias("sh"))
    r, sw, sh = F.col("r"), F.col("sw"), F.col("sh")
    named = lambda s, *c: [s[k].alias(k) for k in c]
    box = lambda s: F.array(s["x"], s["y"], s["w"], s["h"])
    size = F.struct(sw.alias("w"), sh.alias("h"))

    def phaser(s: Column) -> Column:
        was = s["original"]
        source = F.struct(*[F.coalesce(was[k], F.lit(0)).alias(k) for k in "xy"], s["w"].alias("w"), s["h"].alias("h"))
        before = F.struct(*[F.coalesce(was[k], s[k]).alias(k) for k in "wh"])
        return F.struct(F.struct(*named(s, "x", "y", "w", "h")).alias("frame"), s["rotated"].alias("rotated"), was.isNotNull().alias("trimmed"), source.alias("spriteSourceSize"), before.alias("sourceSize"))

    forms = {
        "generic": lambda: F.to_json(F.struct(F.transform(r, lambda s: F.struct(*named(s, "name", "x", "y", "w", "h", "rotated"))).alias("frames"), F.lit(IMAGE).alias("image"), F.struct(size.alias("size"), F.size(r).alias("count")).alias("meta"))),
        "godot3": lambda: F.to_json(F.struct(F.lit(IMAGE).alias("texture"), F.transform(r, lambda s: F.struct(*named(s, "name"), box(s).alias("region"))).alias("regions"))),
        "godot4": lambda: F.to_json(F.struct(F.lit(IMAGE).alias("path"), F.transform(r, lambda s: F.struct(*named(s, "name"), box(s).alias("region"), *named(s, "rotated"))).alias("atlas_regions"), size.alias("size"))),
        "phaser": lambda: F.to_json(F.struct(F.map_from_entries(F.transform(r, lambda s: F.struct(s["name"], phaser(s)))).alias("frames"))),
        "tiled": lambda: _tiled(r, sw, sh),
    }
    return rows.select("sheet", forms[format]().alias("json"))
