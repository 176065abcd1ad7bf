"""Seeded random numbers, value and cellular noise and textures, on 64-bit arithmetic that wraps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_U = np.uint64
_MIX = (_U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB))  # fixed values
_GOLDEN, _GOLDEN2 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)


def splitmix(v: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    z = v.astype(_U) + _GOLDEN
    for shift, k in ((30, _MIX[0]), (27, _MIX[1])):
        z = (z ^ z >> _U(shift)) * k
    return z ^ z >> _U(31)


def _lattice(seed: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    h = _U(seed % (1 << 64)) + x.astype(np.int64).view(_U) * _GOLDEN + y.astype(np.int64).view(_U) * _GOLDEN2
    for shift, k in ((30, _MIX[0]), (27, _MIX[1])):
        h = (h ^ h >> _U(shift)) * k
    return ((h ^ h >> _U(31)) >> _U(40)).astype(np.float32) / np.float32(1 << 24)


def value_noise(x: np.ndarray, y: np.ndarray, seed: int, tile: int = 0) -> np.ndarray:
    """Smooth noise in [0, 1) between hashed lattice points, in single precision;
    with tile it repeats."""
    x, y = np.asarray(x, np.float32), np.asarray(y, np.float32)
    ix, iy = np.floor(x), np.floor(y)
    fx, fy = x - ix, y - iy
    cells = [(ix.astype(np.int64) + i, iy.astype(np.int64) + j) for j in (0, 1) for i in (0, 1)]
    a, b, c, d = (_lattice(seed, *(p % tile if tile else p for p in cell)) for cell in cells)
    sx, sy = (f * f * (np.float32(3) - np.float32(2) * f) for f in (fx, fy))
    top, bottom = a + (b - a) * sx, c + (d - c) * sx
    return top + (bottom - top) * sy


def fbm(x: np.ndarray, y: np.ndarray, seed: int, octaves: int = 4, persistence: float = 0.5, lacunarity: float = 2.0, tile: int = 0) -> np.ndarray:
    """Layers of value noise of rising frequency and falling weight, in [0, 1)."""
    if not (1 <= octaves <= 8 and persistence > 0 and lacunarity >= 1):
        raise ValueError("octaves are 1 to 8, persistence above 0, lacunarity 1 or more")
    x, y = np.asarray(x, np.float32), np.asarray(y, np.float32)
    total, weights, weight, step = np.zeros(x.shape, np.float32), np.float32(0), np.float32(1), np.float32(1)
    for _ in range(octaves):
        total = total + value_noise(x * step, y * step, seed, tile) * weight
        weights, weight, step = weights + weight, weight * np.float32(persistence), step * np.float32(lacunarity)
    return total / weights


def ridged(v: np.ndarray) -> np.ndarray:
    """Both ends of [0, 1] as crests, the middle as a valley's floor."""
    return np.float32(1) - np.abs(np.float32(2) * v - np.float32(1))


def _clouds(x: np.ndarray, y: np.ndarray, seed: int, octaves: int = 4) -> np.ndarray:
    return fbm(x * np.float32(0.25), y * np.float32(0.25), seed, octaves)


def _wood(x: np.ndarray, y: np.ndarray, seed: int, rings: int = 6) -> np.ndarray:
    mid = [np.float32(v.shape[k] - 1) / np.float32(2) for v, k in ((x, 1), (y, 0))]
    nx, ny = ((v - m) / np.maximum(m, np.float32(1)) for v, m in zip((x, y), mid, strict=True))
    r = np.sqrt(nx * nx + ny * ny) + (fbm(x * np.float32(0.3), y * np.float32(0.3), seed) - np.float32(0.5)) * np.float32(0.25)
    return (0.5 + 0.5 * np.sin(np.pi * rings * r.astype(float))).astype(np.float32)


def _stone(x: np.ndarray, y: np.ndarray, seed: int) -> np.ndarray:
    return ridged(fbm(x * np.float32(0.35), y * np.float32(0.35), seed))


def _marble(x: np.ndarray, y: np.ndarray, seed: int, veins: int = 5) -> np.ndarray:
    t = (fbm(x * np.float32(0.12), y * np.float32(0.12), seed) - np.float32(0.5)) * np.float32(2)
    return (0.5 + 0.5 * np.sin(2 * np.pi * veins * x.astype(float) / x.shape[1] + t.astype(float) * 3)).astype(np.float32)


TEXTURES = {"clouds": _clouds, "wood": _wood, "stone": _stone, "marble": _marble}


def texture_frames(spark: SparkSession, kind: str, w: int, h: int, palette: list[int], frames: int = 1, seed: int = 1, **options: int) -> DataFrame:
    """Rasters of a texture, its values rounded to places in a palette; frame k
    has seed + k. Options: octaves of clouds, rings of wood, veins of marble."""
    field, colours = TEXTURES[kind], np.array(palette, np.int32)

    def made(k: int) -> np.ndarray:
        y, x = np.mgrid[:h, :w].astype(np.float32)
        v = np.clip(field(x, y, seed + k, **options), np.float32(0), np.float32(1))
        return colours[np.minimum(len(colours) - 1, (v * np.float32(len(colours) - 1) + np.float32(0.5)).astype(int))]

    return _rasters(spark, frames, w, h, made)


_JITTER = (  # fixed values: factors of the bits of x and y, what the seed is mixed with, shift, factor, shift
    (_U(0x1D8E4A1B0F9E5), _U(0x8ACE2C55115D9), _U(0), _U(29), _U(0xBF58476D1C4EE5B9), _U(32)),
    (_U(0x2F1E36D6A0C4), _U(0x71B5EC1A7F3D8), _U((1 << 64) - 0x5A5A5A5A5A5A5A5B), _U(31), _U(0x9E3779B97F4A7C1), _U(27)),
)
FEATURES = ("nearest", "second", "border", "cell")


def jitter(x: np.ndarray, y: np.ndarray, seed: int, axis: int) -> np.ndarray:
    """Where the point of cell (x, y) lies in it along an axis, in [0, 1)."""
    fx, fy, mask, first, factor, second = _JITTER[axis]
    bits = lambda v: np.ascontiguousarray(v, np.float64).view(_U)
    h = bits(x) * fx ^ bits(y) * fy ^ _U((seed or int(_GOLDEN)) % (1 << 64)) ^ mask
    h = (h ^ h >> first) * factor
    return (((h ^ h >> second) >> _U(11)).astype(float) / float(1 << 53)).clip(0, 0.9999999999)


def cellular(x: np.ndarray, y: np.ndarray, seed: int, feature: str = "nearest") -> np.ndarray:
    """Distances to the nearest points of a grid with one point a cell: the
    nearest, the second, their difference, or 1 less the nearest cut to [0, 1]."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    off = []
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            cx, cy = np.floor(x) + dx, np.floor(y) + dy
            px, py = cx + jitter(cx, cy, seed, 0), cy + jitter(cx, cy, seed, 1)
            off.append(np.sqrt((px - x) ** 2 + (py - y) ** 2))
    first, second = np.sort(np.stack(off), axis=0)[:2]
    return {"nearest": first, "second": second, "border": second - first, "cell": np.clip(1 - first, 0, 1)}[feature]


def cellular_frames(spark: SparkSession, w: int, h: int, cell: float = 8.0, feature: str = "nearest", contrast: float = 1.0, frames: int = 1, seed: int = 1) -> DataFrame:
    """Grey rasters of `cellular` noise, scaled to the largest value in each and
    raised to the power of contrast; frame k has seed + k."""
    if feature not in FEATURES or cell <= 0 or contrast <= 0:
        raise ValueError(f"features are {', '.join(FEATURES)}; cell and contrast are above 0")

    def made(k: int) -> np.ndarray:
        y, x = (np.mgrid[:h, :w] + 0.5) / cell
        raw = cellular(x, y, seed + k, feature)
        t = np.clip(raw * (1 / raw.max() if raw.max() > 0 else 1.0), 0, 1) ** contrast
        grey = np.clip((t * 255 + 0.5).astype(np.int64), 0, 255)
        return (grey * 0x10101 - 0x1000000).astype(np.int32)

    return _rasters(spark, frames, w, h, made)


def _rasters(spark: SparkSession, frames: int, w: int, h: int, made: Callable[[int], np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                pixels = pa.ListArray.from_arrays(pa.array([0, w * h], pa.int32()), pa.array(made(k).ravel(), pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([w], pa.int32()), pa.array([h], pa.int32()), pixels], ["frame_id", "w", "h", "pixels"])

    return spark.range(frames).select(F.col("id")).mapInArrow(run, "frame_id long, w int, h int, pixels array<int>")


def noise_frames(spark: SparkSession, w: int, h: int, palette: list[int], scale: float = 0.1, frames: int = 1, seed: int = 1) -> DataFrame:
    """Rasters of noise, its values dealt over a palette; frame k has seed + k."""
    colours = np.array(palette, np.int32)

    def made(k: int) -> np.ndarray:
        y, x = np.mgrid[:h, :w].astype(np.float32) * np.float32(scale)
        return colours[np.minimum(len(colours) - 1, (value_noise(x, y, seed + k) * len(colours)).astype(int))]

    return _rasters(spark, frames, w, h, made)
