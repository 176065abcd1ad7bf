"""Outlines of what lies inside a raster, as closed rings of corners.

An edge lies between a pixel inside and one outside, and runs so that the inside is
on its right. Where two pixels touch by a corner only, the walk turns right, so
they stay apart. Which edge follows is seen at the edge's end alone: the edges of a
raster are a permutation, and rings come from doubling pointers over it, each edge
learning the least edge ahead and the steps to there.

All forms give points (frame_id, x0, y0, hole, left, x, y, dir): x0, y0 is the top
left corner of the ring (the topmost, of those the leftmost), which no other ring
of the raster begins at; left the steps on to there, at x0, y0 itself the length of
the ring; dir the way on (0 right, 1 down, 2 left, 3 up). A ring that passes a
corner twice is one ring. Rasters without anything inside give no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colour as C
from .seams import _cut

POINT = "x0 int, y0 int, hole boolean, left long, x int, y int, dir int"
_AT_ONCE = 1 << 22  # pixels whose edges are held together; a larger raster goes alone


def visible(argb: Column) -> Column:
    return C.alpha(argb) > 0


def of_colour(colour: int, tolerance: int = 0) -> Callable[[Column], Column]:
    """Visible, and no channel further from the colour than the tolerance."""
    if not 0 <= tolerance <= 255:
        raise ValueError("the tolerance is 0 to 255")
    far = lambda c, part: F.abs(part(c) - part(F.lit(colour)))
    return lambda c: visible(c) & (F.greatest(far(c, C.red), far(c, C.green), far(c, C.blue)) <= tolerance)


def _starts(inside: np.ndarray) -> np.ndarray:
    """Which edges begin at each corner: (raster, y, x, dir) of masks (raster, y, x)."""
    n, h, w = inside.shape
    wide = np.pad(inside, ((0, 0), (1, 1), (1, 1)))
    out = np.zeros((n, h + 1, w + 1, 4), bool)
    out[:, :-1, :-1, 0] = inside & ~wide[:, :-2, 1:-1]
    out[:, :-1, 1:, 1] = inside & ~wide[:, 1:-1, 2:]
    out[:, 1:, 1:, 2] = inside & ~wide[:, 2:, 1:-1]
    out[:, 1:, :-1, 3] = inside & ~wide[:, 1:-1, :-2]
    return out


class _Walk:
    """The edges of rasters of one size. With `cut`, walks end at corners on a
    raster's border, which other tiles share."""

    def __init__(self, inside: np.ndarray, cut: bool = False) -> None:
        n, h, w = inside.shape
        flat = _starts(inside).ravel()
        self.ids = np.flatnonzero(flat)
        self.dir = self.ids & 3
        self.raster, self.y, self.x = np.unravel_index(self.ids >> 2, (n, h + 1, w + 1))
        end = (self.ids >> 2) + np.array([1, w + 1, -1, -w - 1])[self.dir]
        right, on = (self.dir + 1) & 3, self.dir
        turn = np.where(flat[end * 4 + right], right, np.where(flat[end * 4 + on], on, (on + 3) & 3))
        own = np.arange(len(self.ids))
        hop, low = np.searchsorted(self.ids, end * 4 + turn), own.copy()
        if cut:
            y, x = np.divmod(end % ((h + 1) * (w + 1)), w + 1)
            last = (y == 0) | (y == h) | (x == 0) | (x == w)
            hop, low = np.where(last, own, hop), np.where(last, own - len(own), own)
        before = np.full(len(own), -1)
        before[hop[hop != own]] = self.dir[hop != own]
        self.corner = before != self.dir
        off, span = np.zeros(len(own), np.int64), 1
        while len(own):
            better = low[hop] < low
            if not better.any():
                break
            off, low, hop, span = np.where(better, off[hop] + span, off), np.where(better, low[hop], low), hop[hop], span * 2
        self.chain, self.key = low < 0, np.where(low < 0, low + len(own), low)
        length = np.bincount(self.key, minlength=len(own))
        #: Steps to the ring's start, at the start itself the length; in a cut walk, to its last edge.
        self.left = np.where(~self.chain & (off == 0), length[self.key], off)


def _masks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, masks) of the rasters of one size; a row's columns end in w, h, inside."""
    w, h = (batch.column(batch.num_columns - k).to_numpy() for k in (3, 2))
    inside, at = batch.column(batch.num_columns - 1), np.concatenate([[0], np.cumsum(w.astype(np.int64) * h)])
    values = inside.flatten().fill_null(False).to_numpy(zero_copy_only=False)
    for width, height in {(int(a), int(b)) for a, b in zip(w, h, strict=True)}:
        rows = np.flatnonzero((w == width) & (h == height))
        size = width * height
        some = max(1, _AT_ONCE // max(size, 1))
        for k in range(0, len(rows) if size else 0, some):
            own = rows[k : k + some]
            yield own, np.stack([values[at[r] : at[r] + size] for r in own]).reshape(len(own), height, width)


def _ready(frames: DataFrame, inside: Callable[[Column], Column]) -> DataFrame:
    return frames.where("pixels is not null").select("frame_id", "w", "h", F.transform("pixels", inside).alias("inside"))


def traced(frames: DataFrame, inside: Callable[[Column], Column] = visible, corners_only: bool = True) -> DataFrame:
    """The points of all rings of each raster, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, masks in _masks(batch):
                e = _Walk(masks)
                kept = np.flatnonzero(e.corner) if corners_only else np.arange(len(e.ids))
                first = e.key[kept]
                made = [e.x[first], e.y[first], e.dir[first] == 1, e.left[kept], e.x[kept], e.y[kept], e.dir[kept]]
                types = [pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
                frame = batch.column(0).take(pa.array(rows[e.raster[kept]]))
                yield pa.RecordBatch.from_arrays([frame, *(pa.array(v, t) for v, t in zip(made, types, strict=True))], names)

    names = ["frame_id", *(f.split()[0] for f in POINT.split(", "))]
    ready = _ready(frames, inside)
    return ready.mapInArrow(run, f"frame_id {ready.schema['frame_id'].dataType.simpleString()}, {POINT}")


def sizes(points: DataFrame) -> DataFrame:
    """(frame_id, x0, y0, hole, length, corners, area) of each ring, of its corners;
    the area of a hole is negative. Corners turn at right angles, so each adds x * y
    where the way on is level and takes it off where not."""
    flat = F.col("x").cast("long") * F.col("y")
    area = F.sum(F.when(F.col("dir") % 2 == 0, flat).otherwise(-flat))
    return points.groupBy("frame_id", "x0", "y0", "hole").agg(F.max("left").alias("length"), F.count("*").alias("corners"), area.alias("area"))


def rings(points: DataFrame) -> DataFrame:
    """(frame_id, x0, y0, hole, ring): a ring's points (x, y) from its start back to
    it. For rasters whose rings fit into a row."""
    own = F.array_sort(F.collect_list(F.struct((-F.col("left")).alias("at"), "x", "y")))
    drawn = points.groupBy("frame_id", "x0", "y0", "hole").agg(own.alias("r"))
    plain = F.transform("r", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return drawn.select("frame_id", "x0", "y0", "hole", F.concat(plain, F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")))).alias("ring"))


_EDGE = "struct<y:int,x:int,dir:int>"
_PIECE = f"closed boolean, s {_EDGE}, e {_EDGE}, n long, low struct<y:int,x:int,dir:int,k:long>, corners array<struct<k:long,x:int,y:int,dir:int>>"


def _pieces(tiles: DataFrame, size: int, inside: Callable[[Column], Column]) -> DataFrame:
    """Walks within a tile from border to border, and its closed rings: first and last
    edge, number of edges, the least edge with its place, and the first edge and corners."""

    def struct(*columns: np.ndarray) -> pa.StructArray:
        names, types = ["y", "x", "dir", "k"], [pa.int32()] * 3 + [pa.int64()]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names[: len(columns)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tx, ty = (batch.column(k).to_numpy().astype(np.int64) * size for k in (1, 2))
            for rows, masks in _masks(batch):
                e = _Walk(masks, cut=True)
                if not len(e.ids):
                    continue
                order = np.lexsort([-e.left, e.key])
                new = np.concatenate([[True], np.diff(e.key[order]) != 0])
                first, group = np.flatnonzero(new), np.cumsum(new) - 1
                final = np.concatenate([first[1:], [len(order)]]) - 1
                k = np.arange(len(order)) - first[group]
                least = np.minimum.reduceat(e.ids[order], first)
                at = np.flatnonzero(e.ids[order] == least[group])
                row = rows[e.raster[order]]
                x, y, d = e.x[order] + tx[row], e.y[order] + ty[row], e.dir[order]
                kept = np.flatnonzero(new | e.corner[order])
                ends = np.concatenate([[0], np.cumsum(np.bincount(group[kept], minlength=len(first)))]).astype(np.int32)
                columns = [pa.array(k[kept], pa.int64()), *(pa.array(v[kept], pa.int32()) for v in (x, y, d))]
                corners = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(columns, ["k", "x", "y", "dir"]))
                whole = [pa.array(~e.chain[order][first]), struct(y[first], x[first], d[first]), struct(y[final], x[final], d[final])]
                more = [pa.array(final - first + 1, pa.int64()), struct(y[at], x[at], d[at], k[at]), corners]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row[first])), *whole, *more], names)

    names = ["frame_id", "closed", "s", "e", "n", "low", "corners"]
    ready = _ready(tiles, inside)
    key = ready.select("frame_id.frame_id", "frame_id.tile_x", "frame_id.tile_y", "w", "h", "inside")
    return key.mapInArrow(run, f"frame_id {key.schema['frame_id'].dataType.simpleString()}, {_PIECE}")


def traced_tiles(tiles: DataFrame, size: int, inside: Callable[[Column], Column] = visible) -> DataFrame:
    """The corners of all rings of rasters that lie as tiles (`seams.tiled`), those
    that cross tiles included. Only walks that touch a tile's border are shuffled, a
    row each. What joins them is a permutation too, so no key is hot however long a
    ring is, and no ring ever meets in one task; rounds grow with the logarithm of
    the walks of the longest ring."""
    pieces = _cut(_pieces(tiles, size, inside))
    open_ = pieces.where("not closed")
    # an edge between pixels inside on both sides of a seam is met by its opposite
    away = open_.where("n = 1").select("frame_id", _ended(F.col("e"), (F.col("e.dir") + 2) % 4).alias("s"))
    real = _cut(open_.join(away, ["frame_id", "s"], "left_anti"))
    begins = real.select("frame_id", F.col("s").alias("hop"), F.struct("s.y", "s.x").alias("corner"))
    ends = real.select("frame_id", "s", F.col("e.dir").alias("was"), _ended(F.col("e")).alias("corner"))
    turn = (F.col("hop.dir") - F.col("was") + 4) % 4  # 1 is right, 0 on, 3 left
    met = ends.join(begins, ["frame_id", "corner"]).groupBy("frame_id", "s")
    links = _cut(met.agg(F.min_by("hop", F.when(turn == 1, 0).when(turn == 0, 1).otherwise(2)).alias("hop"), F.first("was").alias("was")))
    now = _cut(real.select("frame_id", "s", "low", "n").join(links, ["frame_id", "s"]).select("frame_id", "s", "hop", "low", F.lit(0).cast("long").alias("off"), F.col("n").alias("span")))
    while True:
        ahead = now.select("frame_id", F.col("s").alias("hop"), F.col("hop").alias("hop2"), F.col("low").alias("low2"), F.col("off").alias("off2"), F.col("span").alias("span2"))
        better = F.col("low2") < F.col("low")
        new = now.join(ahead, ["frame_id", "hop"]).select(
            "frame_id",
            "s",
            F.col("hop2").alias("hop"),
            F.least("low", "low2").alias("low"),
            F.when(better, F.col("span") + F.col("off2")).otherwise(F.col("off")).alias("off"),
            (F.col("span") + F.col("span2")).alias("span"),
            better.alias("better"),
        )
        new = _cut(new)
        if new.where("better").isEmpty():
            break
        now = new.drop("better")
    found = now.select("frame_id", "s", F.col("low").alias("start"), "off")
    came = links.select("frame_id", F.col("hop").alias("s"), "was")
    after = found.select("frame_id", F.col("s").alias("hop"), F.col("off").alias("rest"))
    known = real.join(found, ["frame_id", "s"]).join(came, ["frame_id", "s"]).join(links.select("frame_id", "s", "hop"), ["frame_id", "s"]).join(after, ["frame_id", "hop"])
    # the length of a ring is known at the piece that holds its start: its edges and those from the next piece on
    known = known.select("frame_id", "start", "off", "was", (F.col("n") + F.col("rest")).alias("length"), (F.col("low") == F.col("start")).alias("head"), "corners")
    alone = pieces.where("closed").select("frame_id", F.col("low").alias("start"), F.lit(0).cast("long").alias("off"), F.lit(-1).alias("was"), F.col("n").alias("length"), F.lit(True).alias("head"), "corners")
    each = known.union(alone).withColumn("c", F.explode("corners")).where((F.col("c.k") > 0) | (F.col("c.dir") != F.col("was")))
    left = F.col("off") + F.col("start.k") - F.col("c.k") + F.when(F.col("head") & (F.col("c.k") >= F.col("start.k")), F.col("length")).otherwise(0)
    return each.select("frame_id", F.col("start.x").alias("x0"), F.col("start.y").alias("y0"), (F.col("start.dir") == 1).alias("hole"), left.alias("left"), "c.x", "c.y", "c.dir")


def _ended(edge: Column, way: Column | None = None) -> Column:
    """The corner that an edge ends at, or the edge that begins there in a direction."""
    d = edge["dir"]
    y, x = (edge[c] + F.when(d == more, 1).when(d == less, -1).otherwise(0) for c, more, less in (("y", 1, 3), ("x", 0, 2)))
    return F.struct(y.alias("y"), x.alias("x"), *([] if way is None else [way.cast("int").alias("dir")]))
