"""Quantisation of many rasters to one palette.

All three algorithms start from the histogram of the opaque colours of all rasters:
an aggregate with a row per colour, 2**24 at most however many rasters there are.

* Median cut and octree work on the histogram in one task: a task with the pixels
  would grow with the input, the histogram can't. The octree's counts and sums are
  aggregates themselves, a row per node and level.
* k-means chooses its first centres in such a task and then runs Lloyd's rounds as
  aggregations: each colour to its nearest centre, each centre to the weighted mean.
  Only centres reach the driver.

The palette then stands for the colours: as sorted arrays in each task up to 65536
colours, by a join on the colour beyond. Pixels below alpha 0x80 neither count nor
change; alpha stays. Rasters have distinct keys.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colour as C
from ..functions import harmony
from ..sources.frames import pixels
from . import sequential
from .seams import _cut

#: Fixed values of k-means: the seed, the most rounds, and the move of a centre that ends them.
SEED, ROUNDS, STILL = 0x504958, 16, 0.1
_IN_TASK = 1 << 16  # colours of a mapping that tasks hold


def histogram(frames: DataFrame) -> DataFrame:
    """(rgb, n) over all rasters."""
    seen = pixels(frames).where(C.alpha(F.col("argb")) >= 128)
    return seen.groupBy(F.col("argb").bitwiseAND(F.lit(0xFFFFFF)).alias("rgb")).agg(F.count("*").alias("n"))


def _channels(rgb: np.ndarray) -> np.ndarray:
    return np.stack([rgb >> 16 & 255, rgb >> 8 & 255, rgb & 255], 1).astype(np.int64)


def _mean(parts: np.ndarray, n: np.ndarray) -> int:
    r, g, b = ((parts * n[:, None]).sum(0) / n.sum() + 0.5).astype(int).tolist()
    return r << 16 | g << 8 | b


def median_cut(rgb: np.ndarray, n: np.ndarray, target: int) -> np.ndarray:
    """What each colour (ascending) becomes. The box of the widest channel (then
    of most pixels, then of the least colour) is split at half of its pixels."""
    if len(rgb) <= target:
        return rgb.copy()
    parts = _channels(rgb)

    def ranked(members: np.ndarray) -> tuple:
        return -int(np.ptp(parts[members], axis=0).max()), -int(n[members].sum()), int(rgb[members].min()), members

    boxes = [ranked(np.arange(len(rgb)))]
    while len(boxes) < target and boxes[0][0] < 0:
        members = heapq.heappop(boxes)[3]
        axis = int(np.ptp(parts[members], axis=0).argmax())
        members = members[np.lexsort([rgb[members], parts[members, axis]])]
        sums = np.cumsum(n[members])
        cut = min(len(members) - 1, int(np.searchsorted(2 * sums, sums[-1])) + 1)
        for half in (members[:cut], members[cut:]):
            heapq.heappush(boxes, ranked(half))
    out = np.empty(len(rgb), np.int64)
    for *_, members in boxes:
        out[members] = _mean(parts[members], n[members])
    return out


def octree(rgb: np.ndarray, n: np.ndarray, target: int) -> np.ndarray:
    """What each colour (ascending) becomes. The leaf of fewest pixels (then the
    one met first) goes with its siblings into its parent until there are few
    enough; leaves below the root are joined two by two, the smallest first."""
    parts = _channels(rgb)
    spread = np.zeros(len(rgb), np.int64)
    for bit in range(8):  # three bits a level, the upper ones first
        for c, place in ((0, 2), (1, 1), (2, 0)):
            spread |= (parts[:, c] >> bit & 1) << 3 * bit + place
    levels = []  # for each level: node of each colour, counts, first colours, parents
    for level in range(1, 9):
        keys, first, node = np.unique(spread >> 3 * (8 - level), return_index=True, return_inverse=True)
        levels.append((node, np.bincount(node, n, len(keys)).astype(np.int64), first))
    order = [np.asarray(first) * 8 + k for k, (_, _, first) in enumerate(levels)]  # in which nodes are met
    up = [levels[k - 1][0][levels[k][2]] if k else np.zeros(len(levels[0][2]), int) for k in range(8)]
    below = [np.zeros(len(levels[k][1]), np.int64) for k in range(8)]  # live leaves below a node
    below[7][:] = 1
    for k in range(7, 0, -1):
        np.add.at(below[k - 1], up[k], below[k])
    leaves = [(int(c), int(o), 7, i) for i, (c, o) in enumerate(zip(levels[7][1], order[7], strict=True))]
    heapq.heapify(leaves)
    gone = [np.zeros(len(levels[k][1]), bool) for k in range(8)]  # collapsed into a node above
    kids: list[dict[int, list[int]]] = []
    for k in range(1, 8):
        own: dict[int, list[int]] = {}
        for i, p in enumerate(up[k].tolist()):
            own.setdefault(p, []).append(i)
        kids.append(own)
    live = len(leaves)
    tops: list[tuple[int, int, int, int]] = []  # leaves right below the root
    while live > target and leaves:
        leaf = heapq.heappop(leaves)
        _, _, k, i = leaf
        if gone[k][i]:
            continue
        if k == 0:
            tops.append(leaf)
            continue
        parent = int(up[k][i])
        stack = [(k, x) for x in kids[k - 1][parent]]
        while stack:
            level, x = stack.pop()
            gone[level][x] = True
            if level < 7:
                stack += [(level + 1, y) for y in kids[level][x] if not gone[level + 1][y]]
        lost = int(below[k - 1][parent])
        node, at = parent, k - 1
        while at >= 0:
            below[at][node] -= lost - 1
            node, at = int(up[at][node]), at - 1
        live -= lost - 1
        heapq.heappush(leaves, (int(levels[k - 1][1][parent]), int(order[k - 1][parent]), k - 1, parent))
    group = np.full(len(rgb), -1, np.int64)
    made = 0
    for k in range(8):  # the highest node that is a leaf now
        node = levels[k][0]
        is_leaf = ~gone[k] & (below[k] == 1)
        if k < 7:
            is_leaf &= np.array([all(gone[k + 1][y] for y in kids[k][x]) for x in range(len(is_leaf))], bool)
        fresh = is_leaf[node] & (group < 0)
        _, number = np.unique(node[fresh], return_inverse=True)
        group[fresh] = made + number
        made += int(number.max(initial=-1)) + 1
    if made > target:  # only leaves below the root are left
        sizes = np.bincount(group, n)
        firsts = np.full(made, len(rgb))
        np.minimum.at(firsts, group, np.arange(len(rgb)))
        heap = [(int(s), int(f), g) for g, (s, f) in enumerate(zip(sizes, firsts, strict=True))]
        heapq.heapify(heap)
        while len(heap) > max(target, 1):
            (a, _, x), (b, f, y) = heapq.heappop(heap), heapq.heappop(heap)
            group[group == x] = y
            heapq.heappush(heap, (a + b, f, y))
    out = np.empty(len(rgb), np.int64)
    for g in np.unique(group):
        own = group == g
        out[own] = _mean(parts[own], n[own])
    return out


_KERNELS: dict[str, Callable[[np.ndarray, np.ndarray, int], np.ndarray]] = {"mediancut": median_cut, "octree": octree}


class _Random:
    """A xorwow generator as 32-bit words, seeded from a 64-bit number."""

    def __init__(self, seed: int):
        low, high = seed & 0xFFFFFFFF, seed >> 32 & 0xFFFFFFFF
        self.words = [low, high, 0, 0, ~low & 0xFFFFFFFF]
        self.add = (low << 10 ^ high >> 4) & 0xFFFFFFFF
        for _ in range(64):
            self.word()

    def word(self) -> int:
        x, y, z, w, v = self.words
        t = x ^ x >> 2
        new = (t ^ t << 1 ^ v ^ v << 4) & 0xFFFFFFFF
        self.words = [y, z, w, v, new]
        self.add = self.add + 362437 & 0xFFFFFFFF
        return new + self.add & 0xFFFFFFFF

    def below(self, n: int) -> int:
        if n & n - 1 == 0:
            return self.word() >> 32 - (n.bit_length() - 1) if n > 1 else 0
        while True:
            bits = self.word() >> 1
            value = bits % n
            if bits - value + n - 1 < 1 << 31:
                return value

    def unit(self) -> float:
        return ((self.word() >> 6 << 27) + (self.word() >> 5)) / (1 << 53)


def first_centres(lab: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Rows of lab: one at random, then each with a chance that grows with its
    pixels times its squared distance from those chosen."""
    rng = _Random(SEED)
    chosen = [rng.below(len(lab))]
    far = ((lab - lab[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(k, len(lab)):
        sums = np.cumsum(n * far)
        if sums[-1] <= 0:
            break
        i = int(np.searchsorted(sums, rng.unit() * sums[-1], side="right"))
        if i == len(lab) or far[i] <= 0:
            i = int(np.flatnonzero(far > 0)[0])
        chosen.append(i)
        far = np.minimum(far, ((lab - lab[i]) ** 2).sum(1))
    return lab[chosen]


def _in_one(found: DataFrame, f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """f on a histogram, in one task: its rows are bounded by the number of colours."""
    return found.groupBy((F.col("rgb") < 0).alias("none")).applyInArrow(lambda key, table: f(table.sort_by("rgb")), schema)


Centres = list[tuple[float, float, float]]


def nearest_centre(lab: Column, centres: Centres) -> Column:
    """The number of the nearest centre, the first of equals."""
    listed = F.array(*[F.struct(*[F.lit(float(v)).alias(c) for v, c in zip(x, "lab", strict=True)], F.lit(k).alias("k")) for k, x in enumerate(centres)])
    squared = lambda e, v: (v["l"] - e["l"]) * (v["l"] - e["l"]) + (v["a"] - e["a"]) * (v["a"] - e["a"]) + (v["b"] - e["b"]) * (v["b"] - e["b"])
    return C.let(lab, lambda v: F.array_min(F.transform(listed, lambda e: F.struct(squared(e, v).alias("d"), e["k"].alias("k"))))["k"])


def lloyd(shades: DataFrame, centres: Centres, rounds: int = ROUNDS, still: float = STILL) -> Centres:
    """shades: lab, n. Centres after some rounds, fewer if none moves by `still`;
    one that no colour is nearest to is dropped."""
    for _ in range(rounds):
        sums = shades.groupBy(nearest_centre(F.col("lab"), centres).alias("k")).agg(F.sum("n").alias("n"), *[F.sum(F.col(f"lab.{c}") * F.col("n")).alias(c) for c in "lab"])
        rows = sorted(sums.collect())  # a row a centre
        moved = [(r.l / r.n, r.a / r.n, r.b / r.n) for r in rows]
        step = max(sum((x - y) ** 2 for x, y in zip(m, centres[r.k], strict=True)) ** 0.5 for m, r in zip(moved, rows, strict=True)) if rows else 0
        centres = moved or centres
        if step < still:
            break
    return centres


def _k_means(found: DataFrame, k: int) -> DataFrame:
    shades = _cut(found.select("rgb", "n", C.lab(F.col("rgb")).alias("lab")))

    def first(table: pa.Table) -> pa.Table:
        lab = np.stack([np.asarray(x) for x in table.column("lab").combine_chunks().flatten()], 1)
        chosen = first_centres(lab, np.asarray(table.column("n"), np.float64), k)
        return pa.table([pa.array(np.arange(len(chosen), dtype=np.int32)), *[pa.array(chosen[:, i]) for i in range(3)]], names=["k", "l", "a", "b"])

    centres = [(r.l, r.a, r.b) for r in _in_one(shades, first, "k int, l double, a double, b double").orderBy("k").collect()]
    if not centres:
        return found.select("rgb", F.col("rgb").alias("to"))
    centres = lloyd(shades, centres)
    listed = F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(x, "lab", strict=True)]) for x in centres])
    colours = F.transform(listed, lambda c: harmony.from_lab(c).bitwiseAND(F.lit(0xFFFFFF)))
    return shades.select("rgb", F.get(colours, nearest_centre(F.col("lab"), centres)).alias("to"))


def mapping(frames: DataFrame, colours: int, algorithm: str = "mediancut") -> DataFrame:
    """(rgb, to) of every opaque colour of the rasters. algorithm: mediancut,
    octree or kmeans; colours is taken to be 2 at least and 256 at most."""
    if algorithm not in (*_KERNELS, "kmeans"):
        raise ValueError(f"unknown algorithm {algorithm!r}")
    colours = min(256, max(2, colours))
    found = histogram(frames)
    if algorithm == "kmeans":
        return _k_means(found, colours)

    def cut(table: pa.Table) -> pa.Table:
        rgb, n = (np.asarray(table.column(c)).astype(np.int64) for c in ("rgb", "n"))
        return pa.table([pa.array(rgb.astype(np.int32)), pa.array(_KERNELS[algorithm](rgb, n, colours).astype(np.int32))], names=["rgb", "to"])

    return _in_one(found, cut, "rgb int, to int")


def recoloured(frames: DataFrame, to: DataFrame) -> DataFrame:
    """frames with the colours of a mapping (rgb, to)."""
    to = _cut(to)
    if to.count() <= _IN_TASK:
        table = to.toArrow().sort_by("rgb")
        rgb, new = (np.asarray(table.column(c)).astype(np.int64) for c in ("rgb", "to"))

        def f(px: np.ndarray) -> np.ndarray:
            out = px.astype(np.int64).copy()
            solid = (px >> 24 & 255) >= 128
            out[solid] = (out[solid] & -16777216) | new[np.searchsorted(rgb, out[solid] & 0xFFFFFF)]
            return out

        return sequential.per_raster(frames, f)
    flat = frames.select("frame_id", "w", "h", F.posexplode_outer("pixels").alias("i", "argb"))
    key = F.when(C.alpha(F.col("argb")) >= 128, F.col("argb").bitwiseAND(F.lit(0xFFFFFF)))
    met = flat.withColumn("rgb", key).join(to, "rgb", "left")
    new_ = F.when(F.col("to").isNull(), F.col("argb")).otherwise(F.col("argb").bitwiseAND(F.lit(-16777216)).bitwiseOR(F.col("to")))
    cells = F.array_sort(F.collect_list(F.struct("i", new_.alias("argb"))))
    return met.groupBy("frame_id", "w", "h").agg(cells.alias("s")).select("frame_id", "w", "h", F.col("s.argb").alias("pixels"))


def quantised(frames: DataFrame, colours: int, algorithm: str = "mediancut") -> DataFrame:
    """Rasters with one palette of some colours for all of them."""
    return recoloured(frames, mapping(frames, colours, algorithm))


def own_colours(frames: DataFrame) -> list[int]:
    """The opaque colours of all rasters, ascending: 2**24 numbers at most."""
    return sorted(int(r) - (1 << 24) for r in np.asarray(histogram(frames).select("rgb").toArrow().column("rgb")))
