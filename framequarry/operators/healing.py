"""Repairs of what an audit finds in rasters, with the scores before and after.

Repairs of one raster follow each other, so they run over its whole row, without a
shuffle; the scores are those of `describe.scores`, and meet the rasters by key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.frames import dealt
from . import describe
from .sequential import _alpha, _holes, component_labels

REPAIRS = ("isolated_pixel", "tiny_cluster", "enclosed_hole", "broken_corner", "accidental_checker")
_ROUND = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
_SIDES = [(dy, dx) for dy, dx in _ROUND if not (dy and dx)]
_SLANTS = [(dy, dx) for dy, dx in _ROUND if dy and dx]


def _near(a: np.ndarray, b: np.ndarray, tolerance: int) -> np.ndarray:
    """Both visible, and no colour channel further apart than the tolerance."""
    far = np.zeros(a.shape, np.int64)
    for k in (0, 8, 16):
        far = np.maximum(far, np.abs((a >> k & 255).astype(np.int64) - (b >> k & 255)))
    return (_alpha(a) > 0) & (_alpha(b) > 0) & (far <= tolerance)


def _found(px: np.ndarray, tolerance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Masks of isolated pixels, and of the upper left pixels of broken corners and
    of accidental checkers."""
    h, w = px.shape
    wide = np.pad(px, 1)
    alike = np.zeros((h, w), bool)
    for dy, dx in _ROUND:
        alike |= _near(px, wide[1 + dy : 1 + dy + h, 1 + dx : 1 + dx + w], tolerance)
    right, low, slant = wide[1:-1, 2:], wide[2:, 1:-1], wide[2:, 2:]
    bridged = np.zeros((h, w), bool)
    for side in (right, low):
        bridged |= _near(side, px, tolerance) | _near(side, slant, tolerance)
    corner = _near(px, slant, tolerance) & ~bridged
    on, seen_right, seen_low = _alpha(px) > 0, _alpha(right) > 0, _alpha(low) > 0
    checker = on & (px == slant) & ~(seen_right & (right == px)) & ~(seen_low & (low == px)) & ~(seen_right & seen_low & (right == low))
    return on & ~alike, corner, checker


def _around(px: np.ndarray, y: int, x: int, ways: list[tuple[int, int]]) -> list[int]:
    """The visible ones of a pixel's neighbours."""
    h, w = px.shape
    own = [int(px[y + dy, x + dx]) for dy, dx in ways if 0 <= y + dy < h and 0 <= x + dx < w]
    return [c for c in own if c >> 24 & 255]


def _bridge(px: np.ndarray, y: int, x: int, tolerance: int) -> tuple[int, int] | None:
    """Where a pixel would join one to its partner across a corner, the first alike:
    of the two places those that are free, the one of most visible neighbours, of
    equals the first."""
    h, w = px.shape
    for dy, dx in _SLANTS:
        if 0 <= y + dy < h and 0 <= x + dx < w and _near(px[y : y + 1, x], px[y + dy : y + dy + 1, x + dx], tolerance)[0]:
            free = sorted(p for p in ((y, x + dx), (y + dy, x)) if not px[p] >> 24 & 255)
            return max(free, key=lambda p: len(_around(px, *p, _ROUND)), default=None)
    return None


def _mended(px: np.ndarray, tolerance: int, tiny: int, repairs: tuple[str, ...]) -> tuple[np.ndarray, list[int]]:
    """Pixels after the repairs in their order, and how many there were of each."""
    out, done = px.copy(), dict.fromkeys(REPAIRS, 0)
    dust, corner, checker = _found(px, tolerance)
    if "isolated_pixel" in repairs:
        out[dust] = 0
        done["isolated_pixel"] = int(dust.sum())
    if "tiny_cluster" in repairs:
        label = component_labels(out, same_colour=True)
        small = np.bincount(label.ravel()) < tiny
        small[0] = False
        done["tiny_cluster"] = int((small & (np.bincount(label.ravel()) > 0)).sum())
        out[small[label]] = 0
    if "enclosed_hole" in repairs:
        before, was = _holes(px)
        label, enclosed = _holes(out)
        for head in np.unique(before[was]):  # a hole's first pixel
            if not enclosed.flat[head] or _alpha(out).flat[head]:
                continue
            cells = np.argwhere(label == label.flat[head])
            colours, n = np.unique([c for y, x in cells for c in _around(out, y, x, _SIDES)], return_counts=True)
            out[cells[:, 0], cells[:, 1]] = colours[n == n.max()].max()
            done["enclosed_hole"] += 1
    open_ = [(y, x, rule) for rule, mask in enumerate((corner, checker)) if REPAIRS[3 + rule] in repairs for y, x in np.argwhere(mask)]
    for y, x, rule in sorted(open_):
        at = _bridge(out, y, x, tolerance)
        if at:
            out[at] = out[y, x]
            done[REPAIRS[3 + rule]] += 1
    return out, list(done.values())


def mended(frames: DataFrame, tolerance: int = 24, tiny: int = 2, repairs: tuple[str, ...] = REPAIRS) -> DataFrame:
    """(frame_id, w, h, pixels, and a count of each of REPAIRS): dust and clusters
    below an area go, enclosed holes take the commonest colour round them (of equals
    the largest number), and pixels that meet by a corner only get one between them.
    Chains of such pixels are left, as which to straighten is a matter of taste."""
    if set(repairs) - set(REPAIRS):
        raise ValueError(f"the repairs are {', '.join(REPAIRS)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, h = batch.column(1).to_numpy(), batch.column(2).to_numpy()
            values, at = batch.column(3).flatten().fill_null(0).to_numpy(), np.concatenate([[0], np.cumsum(w.astype(np.int64) * h)])
            made = [_mended(values[a:b].reshape(y, x), tolerance, tiny, repairs) if b > a else (values[a:b], [0] * len(REPAIRS)) for a, b, x, y in zip(at[:-1], at[1:], w, h, strict=True)]
            if made:
                flat = pa.array(np.concatenate([px.ravel() for px, _ in made]).astype(np.int32))
                counts = [pa.array(c, pa.int32()) for c in np.array([c for _, c in made]).T]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), flat), *counts], ["frame_id", "w", "h", "pixels", *REPAIRS])

    base = frames.where("pixels is not null").select("frame_id", "w", "h", "pixels")
    key = base.schema["frame_id"].dataType.simpleString()
    return base.mapInArrow(run, f"frame_id {key}, w int, h int, pixels array<int>, " + ", ".join(f"{r} int" for r in REPAIRS))


def healed(frames: DataFrame, tolerance: int = 24, tiny: int = 2, repairs: tuple[str, ...] = REPAIRS, guarded: bool = True) -> DataFrame:
    """What `mended` gives with findings and score before and after, and `applied`:
    guarded, a raster whose score would fall stays as it was, without repairs."""
    made = mended(dealt(frames), tolerance, tiny, repairs).persist()  # six steps below read it
    was = describe.scores(frames, tiny, tolerance).select("frame_id", F.col("findings").alias("findings_before"), F.col("score").alias("score_before"))
    now = describe.scores(made.select("frame_id", "w", "h", "pixels"), tiny, tolerance).select("frame_id", F.col("findings").alias("findings_after"), F.col("score").alias("score_after"))
    first = frames.select("frame_id", F.col("pixels").alias("__was"))
    met = made.join(first, "frame_id").join(was, "frame_id").join(now, "frame_id")
    met = met.withColumn("applied", (F.col("score_after") >= F.col("score_before")) | F.lit(not guarded))
    kept = {c: F.when(F.col("applied"), F.col(c)).otherwise(F.lit(0)) for c in REPAIRS}
    kept |= {f"{c}_after": F.when(F.col("applied"), F.col(f"{c}_after")).otherwise(F.col(f"{c}_before")) for c in ("findings", "score")}
    return met.withColumns({"pixels": F.when(F.col("applied"), F.col("pixels")).otherwise(F.col("__was")), **kept}).drop("__was")
