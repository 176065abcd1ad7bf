"""Work within one raster that built-in expressions can't express: components,
floods, error diffusion, fingerprints.

Each runs over whole rows (mapInArrow), so no raster is shuffled; rasters of
over a million pixels come as tiles. Components that cross tiles are joined by
`framequarry.operators.seams`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .raster import lab_of


def per_raster(frames: DataFrame, f: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """f maps the pixels (h x w, signed) of each raster to pixels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, h = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            values, at = np.asarray(batch.column(3).flatten()), np.concatenate([[0], np.cumsum(w.astype(np.int64) * h)])
            out = [f(values[a:b].reshape(y, x)) for a, b, x, y in zip(at[:-1], at[1:], w, h, strict=True)]
            size = np.concatenate([[0], np.cumsum([o.size for o in out])])
            flat = pa.array(np.concatenate([o.ravel() for o in out]).astype(np.int32) if out else np.empty(0, np.int32))
            shape = [pa.array(np.array([o.shape[k] for o in out], np.int32)) for k in (1, 0)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *shape, pa.ListArray.from_arrays(pa.array(size.astype(np.int32)), flat)], ["frame_id", "w", "h", "pixels"])

    base = frames.select("frame_id", "w", "h", "pixels")
    return base.mapInArrow(run, base.schema)


def _alpha(px: np.ndarray) -> np.ndarray:
    return px.view(np.uint32) >> 24 if px.dtype == np.int32 else px.astype(np.int32).view(np.uint32) >> 24


def labels(joined_right: np.ndarray, joined_down: np.ndarray, joined_slant: list[tuple[int, np.ndarray]] = ()) -> np.ndarray:
    """Least place (row-major) of each pixel's component; the arrays say whether
    a pixel is joined to the one to its right, below, and (dx, below)."""
    h, w = joined_right.shape
    label = np.arange(h * w).reshape(h, w)
    while True:
        new = label.copy()
        pairs = [(np.s_[:, :-1], np.s_[:, 1:], joined_right[:, :-1]), (np.s_[:-1], np.s_[1:], joined_down[:-1])]
        for dx, on in joined_slant:
            a = np.s_[:-1, max(0, -dx) : w - max(0, dx)]
            b = np.s_[1:, max(0, dx) : w - max(0, -dx)]
            pairs.append((a, b, on[a]))
        for a, b, on in pairs:
            low = np.where(on, np.minimum(new[a], new[b]), 0)
            new[a] = np.where(on, low, new[a])
            new[b] = np.where(on, np.minimum(low, new[b]), new[b])
        new = new.ravel()[new]  # a label points at a pixel, which has a label
        if (new == label).all():
            return label
        label = new


def component_labels(px: np.ndarray, same_colour: bool = False, eight: bool = False) -> np.ndarray:
    """Labels of visible pixels from 1 in the order of first sight, 0 elsewhere."""
    h, w = px.shape
    on = _alpha(px) > 0

    def joined(dy: int, dx: int) -> np.ndarray:
        out = np.zeros((h, w), bool)
        a = np.s_[: h - dy, max(0, -dx) : w - max(0, dx)]
        b = np.s_[dy:, max(0, dx) : w - max(0, -dx)]
        out[a] = on[a] & on[b] & ((px[a] == px[b]) if same_colour else True)
        return out

    slant = [(1, joined(1, 1)), (-1, joined(1, -1))] if eight else []
    label = np.where(on, labels(joined(0, 1), joined(1, 0), slant), -1)
    heads = np.unique(label[label >= 0])
    return np.where(on, np.searchsorted(heads, label) + 1, 0)


def components(frames: DataFrame, same_colour: bool = False, eight: bool = False) -> DataFrame:
    """frames with labels in place of pixels."""
    return per_raster(frames, lambda px: component_labels(px, same_colour, eight))


def without_small(frames: DataFrame, least: int, eight: bool = False) -> DataFrame:
    def f(px: np.ndarray) -> np.ndarray:
        label = component_labels(px, eight=eight)
        return np.where((label > 0) & (np.bincount(label.ravel())[label] < least), 0, px)

    return per_raster(frames, f)


def largest(frames: DataFrame, count: int = 1, eight: bool = False) -> DataFrame:
    """The components of most pixels stay, of equals those that are seen first."""

    def f(px: np.ndarray) -> np.ndarray:
        label = component_labels(px, eight=eight)
        area = np.bincount(label.ravel())[1:]
        keep = 1 + np.lexsort([np.arange(len(area)), -area])[:count]
        return np.where(np.isin(label, keep), px, 0)

    return per_raster(frames, f)


def _area(px: np.ndarray, x: int, y: int, tolerance: int) -> np.ndarray:
    """Which pixels a flood from (x, y) reaches; none from outside."""
    if not (0 <= y < px.shape[0] and 0 <= x < px.shape[1]):
        return np.zeros(px.shape, bool)
    parts = np.ascontiguousarray(px, np.int32).view(np.uint8).reshape(*px.shape, 4).astype(int)
    near = (np.abs(parts - parts[y, x]) <= tolerance).all(axis=2)
    right, down = np.zeros(px.shape, bool), np.zeros(px.shape, bool)
    right[:, :-1], down[:-1] = near[:, :-1] & near[:, 1:], near[:-1] & near[1:]
    label = labels(right, down)
    return near & (label == label[y, x])


def flooded(frames: DataFrame, x: int, y: int, colour: int, tolerance: int = 0) -> DataFrame:
    """The area round (x, y) within tolerance of its colour, in all four channels,
    takes a colour (4 neighbours)."""
    return per_raster(frames, lambda px: np.where(_area(px, x, y, tolerance), colour, px))


def flood_area(frames: DataFrame, x: int, y: int, tolerance: int = 0) -> DataFrame:
    """frames with 1 for each pixel that a flood would reach and 0 elsewhere."""
    return per_raster(frames, lambda px: _area(px, x, y, tolerance).astype(np.int32))


def _holes(px: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels of transparent areas (4 neighbours), and which pixels lie in one
    that doesn't reach the border."""
    h, w = px.shape
    off = _alpha(px) == 0
    right, down = np.zeros((h, w), bool), np.zeros((h, w), bool)
    right[:, :-1], down[:-1] = off[:, :-1] & off[:, 1:], off[:-1] & off[1:]
    label = labels(right, down)
    edge = np.concatenate([label[0], label[-1], label[:, 0], label[:, -1]])
    outside = edge[np.concatenate([off[0], off[-1], off[:, 0], off[:, -1]])]
    return label, off & ~np.isin(label, outside)


def holes(frames: DataFrame) -> DataFrame:
    """frames with labels of enclosed transparent areas in place of pixels."""

    def f(px: np.ndarray) -> np.ndarray:
        label, inside = _holes(px)
        return np.where(inside, np.searchsorted(np.unique(label[inside]), label) + 1, 0)

    return per_raster(frames, f)


def holes_filled(frames: DataFrame) -> DataFrame:
    """Transparent areas that don't reach the border are filled from outside in:
    each pixel takes the commonest colour of its visible 4 neighbours (of equals
    the larger), ring by ring."""

    def f(px: np.ndarray) -> np.ndarray:
        h, w = px.shape
        _, todo = _holes(px)
        out = px.copy()
        while todo.any():
            votes = np.zeros((h, w, 4), np.int64)
            known = np.zeros((h, w, 4), bool)
            on = _alpha(out) > 0
            for k, (dy, dx) in enumerate([(-1, 0), (1, 0), (0, -1), (0, 1)]):
                a = np.s_[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)]
                b = np.s_[max(0, dy) : h - max(0, -dy), max(0, dx) : w - max(0, -dx)]
                votes[a + (k,)], known[a + (k,)] = out[b], on[b]
            count = ((votes[..., None, :] == votes[..., :, None]) & known[..., None, :]).sum(-1) * known
            best = np.where(count == count.max(-1, keepdims=True), votes, -(1 << 40)).max(-1)
            now = todo & known.any(-1)
            out = np.where(now, best, out)
            todo &= ~now
        return out

    return per_raster(frames, f)


#: Where and in what shares an error goes (dx, dy, share).
DIFFUSIONS = {
    "floyd_steinberg": [(1, 0, 7 / 16), (-1, 1, 3 / 16), (0, 1, 5 / 16), (1, 1, 1 / 16)],
    "atkinson": [(1, 0, 1 / 8), (2, 0, 1 / 8), (-1, 1, 1 / 8), (0, 1, 1 / 8), (1, 1, 1 / 8), (0, 2, 1 / 8)],
}


def diffused(frames: DataFrame, palette: list[int], kind: str = "floyd_steinberg", strength: float = 1.0) -> DataFrame:
    """Error diffusion to the nearest palette colour in CIELAB, in reading order;
    pixels below alpha 0x80 neither change nor take part."""
    lab = np.array([lab_of(c) for c in palette])
    rgb = np.array([[c >> 16 & 255, c >> 8 & 255, c & 255] for c in palette], np.float32)

    def f(px: np.ndarray) -> np.ndarray:
        h, w = px.shape
        solid = _alpha(px) >= 128
        work = np.stack([px >> 16 & 255, px >> 8 & 255, px & 255], 2).astype(np.float32)
        out = px.astype(np.int64).copy()
        for y in range(h):
            for x in range(w):
                if not solid[y, x]:
                    continue
                c = np.clip(work[y, x], 0, 255)
                r, g, b = np.minimum(255, (c + np.float32(0.5)).astype(int)).tolist()
                k = int(((lab - lab_of(r << 16 | g << 8 | b)) ** 2).sum(1).argmin())
                out[y, x] = (int(px[y, x]) & -16777216) | (palette[k] & 0xFFFFFF)
                error = (c - rgb[k]) * np.float32(strength)
                for dx, dy, share in DIFFUSIONS[kind]:
                    if 0 <= x + dx < w and y + dy < h and solid[y + dy, x + dx]:
                        work[y + dy, x + dx] += error * np.float32(share)
        return out

    return per_raster(frames, f)


def fingerprints(frames: DataFrame) -> DataFrame:
    """(frame_id, digest, visible): an order-dependent 64-bit hash of the pixels
    (transparent ones as 0), the size and the number of visible pixels."""
    prime, basis, mask = 0x100000001B3, 0x9E3779B97F4A7C15, (1 << 64) - 1  # fixed values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, w, h, px in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = np.array(px, np.int32).view(np.uint32)
                own = np.where(own >> 24 == 0, 0, own)
                seen = int((own >> 24 > 0).sum())
                digest = basis
                for v in [*own.tolist(), w, h, seen]:
                    digest = (digest ^ v) * prime & mask
                rows.append((f"{digest:016x}", seen))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32())], ["frame_id", "digest", "visible"])

    base = frames.select("frame_id", "w", "h", "pixels")
    kind = base.schema["frame_id"].dataType.simpleString()
    return base.mapInArrow(run, f"frame_id {kind}, digest string, visible int")


def quantized(frames: DataFrame, colours: int) -> DataFrame:
    """Median cut over each raster: the box of widest range is split at its
    weighted median until there are enough; a box's colour is its mean. Pixels
    below alpha 0x80 stay."""

    def f(px: np.ndarray) -> np.ndarray:
        solid = _alpha(px) >= 128
        shades, inverse, count = np.unique(px[solid] & 0xFFFFFF, return_inverse=True, return_counts=True)
        if len(shades) <= colours:
            return px
        rgb = np.stack([shades >> 16 & 255, shades >> 8 & 255, shades & 255], 1).astype(int)
        boxes = [np.arange(len(shades))]
        while len(boxes) < colours:
            spans = [np.ptp(rgb[b], axis=0).max() if len(b) > 1 else -1 for b in boxes]
            k = int(np.argmax(spans))
            if spans[k] < 0:
                break
            own = boxes[k]
            axis = int(np.ptp(rgb[own], axis=0).argmax())
            own = own[np.lexsort([own, rgb[own, axis]])]
            half = np.cumsum(count[own])
            cut = min(len(own) - 1, max(1, int(np.searchsorted(half, half[-1] / 2)) + 1))
            boxes[k : k + 1] = [own[:cut], own[cut:]]
        to = np.empty(len(shades), np.int64)
        for b in boxes:
            mean = (rgb[b] * count[b, None]).sum(0) * 2 // count[b].sum() + 1 >> 1
            to[b] = mean[0] << 16 | mean[1] << 8 | mean[2]
        out = px.astype(np.int64).copy()
        out[solid] = (out[solid] & -16777216) | to[inverse]
        return out

    return per_raster(frames, f)


def exploded_labels(labelled: DataFrame) -> DataFrame:
    """(frame_id, label, area, x, y, width, height) of each component."""
    flat = labelled.select("frame_id", "w", F.posexplode_outer("pixels").alias("i", "label")).where("label > 0")
    x, y = (F.col("i") % F.col("w")).cast("int"), (F.col("i") / F.col("w")).cast("int")
    found = flat.select("frame_id", "label", x.alias("x"), y.alias("y")).groupBy("frame_id", "label")
    out = found.agg(F.count("*").alias("area"), F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return out.select("frame_id", "label", "area", F.col("x0").alias("x"), F.col("y0").alias("y"), (F.col("x1") - F.col("x0") + 1).alias("width"), (F.col("y1") - F.col("y0") + 1).alias("height"))
