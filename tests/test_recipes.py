"""Recipes and shared palettes against plain Python."""

from __future__ import annotations

import json
import random
from collections import Counter
from itertools import product

import numpy as np
import pytest

from framequarry.functions import library
from framequarry.operators import raster, sequential, shared
from framequarry.plans import recipe


def rasters(spark, seed: int = 1, n: int = 4, size: int = 6, sizes: bool = False):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        w, h = (size, size - 1) if not sizes else (size - k, size)
        px = [0 if rng.random() < 0.2 else ((0x40 if rng.random() < 0.1 else 0xFF) << 24 | rng.choice([0, 8, 90, 200, 255]) << 16 | rng.randrange(0, 256, 17) << 8 | rng.randrange(40)) for _ in range(w * h)]
        px[0] = 0
        rows.append((k, w, h, [p - (1 << 32) if p >= 1 << 31 else p for p in px]))
    return spark.createDataFrame(rows, "frame_id long, w int, h int, pixels array<int>"), {r[0]: r for r in rows}


def ran(frames, *steps: dict) -> dict[int, tuple[int, int, list[int]]]:
    return {r.frame_id: (r.w, r.h, r.pixels) for r in recipe.run(frames, json.dumps({"steps": list(steps)})).collect()}


def parts(c: int) -> tuple[int, int, int]:
    return c >> 16 & 255, c >> 8 & 255, c & 255


def opaque(p: int) -> bool:
    return (p >> 24 & 255) >= 128


def tally(rows: dict) -> Counter:
    return Counter(p & 0xFFFFFF for r in rows.values() for p in r[3] if opaque(p))


def mean(box: list[int], n: Counter) -> int:
    total = sum(n[c] for c in box)
    r, g, b = (int(sum(parts(c)[k] * n[c] for c in box) / total + 0.5) for k in range(3))
    return r << 16 | g << 8 | b


def plain_median_cut(n: Counter, target: int) -> dict[int, int]:
    if len(n) <= target:
        return {c: c for c in n}
    spans = lambda b: [max(parts(c)[k] for c in b) - min(parts(c)[k] for c in b) for k in range(3)]
    boxes = [sorted(n)]
    while len(boxes) < target:
        best = min(boxes, key=lambda b: (-max(spans(b)), -sum(n[c] for c in b), min(b)))
        if max(spans(best)) == 0:
            break
        axis = spans(best).index(max(spans(best)))
        order = sorted(best, key=lambda c: (parts(c)[axis], c))
        total, seen, cut = sum(n[c] for c in best), 0, len(order) - 1
        for i, c in enumerate(order):
            seen += n[c]
            if 2 * seen >= total:
                cut = i + 1
                break
        cut = len(order) - 1 if cut >= len(order) else cut
        boxes.remove(best)
        boxes += [order[:cut], order[cut:]]
    return {c: mean(b, n) for b in boxes for c in b}


def plain_octree(n: Counter, target: int) -> dict[int, int]:
    """A tree of dicts; nodes are paths of octants, numbered as they are met."""
    octants = lambda c: tuple((c >> 16 + s & 1) << 2 | (c >> 8 + s & 1) << 1 | c >> s & 1 for s in range(7, -1, -1))
    number, weight = {}, Counter()
    for c in sorted(n):
        for k in range(1, 9):
            number.setdefault(octants(c)[:k], len(number))
            weight[octants(c)[:k]] += n[c]
    leaves = {octants(c) for c in n}
    while len(leaves) > target:
        inner = [x for x in leaves if len(x) > 1]
        if not inner:
            break
        least = min(inner, key=lambda x: (weight[x], number[x]))
        leaves = {x for x in leaves if x[: len(least) - 1] != least[:-1]} | {least[:-1]}
    groups = {x: [c for c in n if octants(c)[: len(x)] == x] for x in leaves}
    joined = [(weight[x], number[x], groups[x]) for x in leaves]
    while len(joined) > max(target, 1):
        joined.sort(key=lambda j: j[:2])
        a, b = joined[:2]
        joined[:2] = [(a[0] + b[0], b[1], a[2] + b[2])]
    return {c: mean(own, n) for _, _, own in joined for c in own}


@pytest.mark.parametrize(("algorithm", "plain"), [("median-cut", plain_median_cut), ("octree", plain_octree)])
@pytest.mark.parametrize("target", [2, 5, 16, 256])
def test_one_palette_for_all(spark, algorithm, plain, target):
    frames, rows = rasters(spark)
    to = plain(tally(rows), target)
    got = ran(frames, {"type": "quantize", "algorithm": algorithm, "maxColors": target})
    for k, (_, _, _, px) in rows.items():
        assert got[k][2] == [p & -16777216 | to[p & 0xFFFFFF] if opaque(p) else p for p in px]
    assert len({p & 0xFFFFFF for _, _, px in got.values() for p in px if opaque(p)}) <= target


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("kind", ["mediancut", "octree"])
def test_kernels_at_random(seed, kind):
    rng = random.Random(seed)
    n = Counter({rng.choice([0, 1, 2, 128, 129, 255]) << 16 | rng.choice([0, 3, 255]) << 8 | rng.randrange(256): rng.choice([1, 1, 2, 50]) for _ in range(rng.choice([3, 40, 200]))})
    rgb = np.array(sorted(n))
    plain = plain_octree if kind == "octree" else plain_median_cut
    for target in (2, 3, 8, 20):
        got = shared._KERNELS[kind](rgb, np.array([n[c] for c in rgb.tolist()]), target)
        assert dict(zip(rgb.tolist(), got.tolist(), strict=True)) == plain(n, target)


def plain_k_means(n: Counter, k: int) -> dict[int, int]:
    shades = sorted(n)
    lab = [raster.lab_of(c) for c in shades]
    d2 = lambda p, q: sum((x - y) ** 2 for x, y in zip(p, q, strict=True))
    centres = [tuple(c) for c in shared.first_centres(np.array(lab), np.array([n[c] for c in shades], float), k)]
    for _ in range(16):
        of = [min(range(len(centres)), key=lambda j, p=p: (d2(p, centres[j]), j)) for p in lab]
        new, move = [], 0.0
        for j in range(len(centres)):
            own = [i for i, x in enumerate(of) if x == j]
            if own:
                total = sum(n[shades[i]] for i in own)
                new.append(tuple(sum(lab[i][c] * n[shades[i]] for i in own) / total for c in range(3)))
                move = max(move, d2(new[-1], centres[j]) ** 0.5)
        centres = new
        if move < 0.1:
            break
    return {c: min(range(len(centres)), key=lambda j, p=p: (d2(p, centres[j]), j)) for c, p in zip(shades, lab, strict=True)}


def test_k_means(spark):
    frames, rows = rasters(spark, 3)
    of = plain_k_means(tally(rows), 6)
    got = ran(frames, {"type": "quantize", "algorithm": "K_Means", "maxColors": 6})
    colours: dict[int, set[int]] = {}
    for k, (_, _, _, px) in rows.items():
        for p, q in zip(px, got[k][2], strict=True):
            assert (p & -16777216) == (q & -16777216) and (opaque(p) or p == q)
            if opaque(p):
                colours.setdefault(of[p & 0xFFFFFF], set()).add(q & 0xFFFFFF)
    assert all(len(c) == 1 for c in colours.values()) and len(colours) == 6


def test_generator_is_as_published():
    """The first words for seed 1 by the published recurrence, written out."""
    x, y, z, w, v, add = 1, 0, 0, 0, ~1 & 0xFFFFFFFF, 1 << 10
    words = []
    for _ in range(70):
        t = (x ^ x >> 2) & 0xFFFFFFFF
        x, y, z, w = y, z, w, v
        v = (v ^ v << 4 ^ (t ^ t << 1)) & 0xFFFFFFFF
        add = (add + 362437) & 0xFFFFFFFF
        words.append((v + add) & 0xFFFFFFFF)
    rng = shared._Random(1)
    assert [rng.word() for _ in range(6)] == words[64:]
    assert all(0 <= rng.below(7) < 7 for _ in range(50)) and all(0 <= rng.unit() < 1 for _ in range(50))


def test_many_colours_by_a_join(spark, monkeypatch):
    frames, rows = rasters(spark)
    few = {r.frame_id: r.pixels for r in shared.quantised(frames, 5).collect()}
    monkeypatch.setattr(shared, "_IN_TASK", 3)
    assert {r.frame_id: r.pixels for r in shared.quantised(frames, 5).collect()} == few
    blank = spark.createDataFrame([(1, 1, 1, [0])], "frame_id long, w int, h int, pixels array<int>")
    for name in ("mediancut", "octree", "kmeans"):
        assert shared.quantised(blank, 4, name).first().pixels == [0]


def nearest(c: int, palette: list[int]) -> int:
    d = lambda q: sum((a - b) ** 2 for a, b in zip(raster.lab_of(c), raster.lab_of(q), strict=True))
    return min(range(len(palette)), key=lambda k: (d(palette[k]), k))


def test_palette_map_and_dithers(spark):
    frames, rows = rasters(spark)
    palette = library.palette("pico-8")
    mapped = {k: [p & -16777216 | palette[nearest(p, palette)] & 0xFFFFFF if opaque(p) else p for p in r[3]] for k, r in rows.items()}
    for step in ({"type": "palette-map", "palette": "pico-8"}, {"type": "dither", "algorithm": "none", "palette": "pico-8"}, {"type": "dither", "algorithm": "floyd-steinberg", "palette": "pico-8", "strength": 0}):
        assert {k: v[2] for k, v in ran(frames, step).items()} == mapped
    same = {k: r[3] for k, r in rows.items()}
    for step in ({"type": "palette-map", "palette": None}, {"type": "palette-map"}, *[{"type": "dither", "algorithm": a} for a in ("none", "floydsteinberg", "Atkinson")]):
        assert {k: v[2] for k, v in ran(frames, step).items()} == same
    own = sorted(c - (1 << 24) for c in tally(rows))
    amount = {"checker": lambda x, y: 32 if (x + y) % 2 == 0 else -32, "bayer2x2": lambda x, y: ([0, 2, 3, 1][y % 2 * 2 + x % 2] + 0.5) / 4 * 63.75 - 31.875, "Bayer 8": None}
    for name, f in amount.items():
        got = ran(frames, {"type": "dither", "algorithm": name})
        for k, r in rows.items():
            assert {p & 0xFFFFFF for p in got[k][2] if opaque(p)} <= {c & 0xFFFFFF for c in own}
            for i, p in enumerate(r[3]):
                if f and opaque(p):
                    moved = [min(255, max(0, int(v + f(i % r[1], i // r[1])))) for v in parts(p)]
                    assert got[k][2][i] & 0xFFFFFF == own[nearest(moved[0] << 16 | moved[1] << 8 | moved[2], own)] & 0xFFFFFF
    assert raster.BAYER[8][:8] == [0, 32, 8, 40, 2, 34, 10, 42] and raster.BAYER[8][-4:] == [61, 29, 53, 21] and sorted(raster.BAYER[8]) == list(range(64))


@pytest.mark.parametrize("kind", ["floyd_steinberg", "atkinson"])
def test_diffusion_against_plain_loops(spark, kind):
    """The queries dither_fs and dither_atkinson, in single precision."""
    frames, rows = rasters(spark, 5)
    palette = library.palette("gameboy")
    got = {r.frame_id: r.pixels for r in sequential.diffused(frames, palette, kind).collect()}
    f32 = np.float32
    for k, (_, w, h, px) in rows.items():
        work = [[f32(v) for v in parts(p)] for p in px]
        for i, p in enumerate(px):
            if not opaque(p):
                assert got[k][i] == p
                continue
            c = [min(f32(255), max(f32(0), v)) for v in work[i]]
            r, g, b = (min(255, int(v + f32(0.5))) for v in c)
            q = palette[nearest(r << 16 | g << 8 | b, palette)]
            assert got[k][i] == p & -16777216 | q & 0xFFFFFF
            for dx, dy, share in sequential.DIFFUSIONS[kind]:
                x, y = i % w + dx, i // w + dy
                if 0 <= x < w and y < h and opaque(px[y * w + x]):
                    for j in range(3):
                        work[y * w + x][j] += (c[j] - f32(parts(q)[j])) * f32(share)


def test_trim(spark):
    frames, rows = rasters(spark)
    shown = [(x, y) for _, w, h, px in rows.values() for y, x in product(range(h), range(w)) if px[y * w + x]]
    x0, y0 = min(x for x, _ in shown), min(y for _, y in shown)
    w1, h1 = max(x for x, _ in shown) - x0 + 1, max(y for _, y in shown) - y0 + 1
    assert {v[:2] for v in ran(frames, {"type": "trim"}).values()} == {(w1, h1)}
    frames, rows = rasters(spark, sizes=True)
    got = ran(frames, {"type": "trim"})
    for k, (_, w, h, px) in rows.items():
        on = [(x, y) for y, x in product(range(h), range(w)) if px[y * w + x] >> 24 & 255]
        xs, ys = [x for x, _ in on], [y for _, y in on]
        assert got[k][:2] == (max(xs) - min(xs) + 1, max(ys) - min(ys) + 1)
    blank = spark.createDataFrame([(1, 2, 1, [0, 0])], "frame_id long, w int, h int, pixels array<int>")
    assert ran(blank, {"type": "trim"})[1][:2] == (2, 1)


@pytest.mark.parametrize(
    "step",
    [
        {"type": "quantize", "algorithm": "nonsense"}, {"type": "quantize"}, {"type": "quantize", "algorithm": 3}, {"type": "quantize", "algorithm": "octree", "maxColors": 1},
        {"type": "dither", "algorithm": "sierra"}, {"type": "dither", "algorithm": "none", "palette": "no such"}, {"type": "palette-map", "palette": 7},
        {"type": "outline", "color": "red"}, {"type": "outline", "color": "#12345"}, {"type": "outline", "color": "#112233", "mode": "both"}, {"type": "outline", "color": "#112233", "connectivity": "six"},
        {"type": "scale", "factor": 1.5}, {"type": "scale", "factor": "2"}, {"type": "scale", "factor": True}, {"type": "posterize", "levels": 256}, {"type": "dither", "algorithm": "none", "strength": 2},
    ],
)
def test_refused(step):
    with pytest.raises(ValueError):
        recipe.parse(json.dumps({"steps": [step]}))


def test_accepted():
    assert recipe.colour("#80FF0000") == 0x80FF0000 - (1 << 32) and recipe.colour(-5) == -5
    steps = recipe.parse('{"steps": [{"type": "scale", "factor": 2.0}, {"type": "dither", "algorithm": "BAYER-4x4", "strength": null}, {"type": "outline", "color": 255, "mode": "Inner", "connectivity": "4"}]}')
    assert len(steps) == 3


def test_library():
    assert library.search(" GAME ") == ["gameboy"] and library.search("") == list(library.PALETTES) and library.search("32") == ["endesga-32"]
    assert library.of_size(5) == ["gameboy", "clawd", "kimi"] and [len(v) for v in library.PALETTES.values()] == [16, 4, 54, 32, 6, 5]
    with pytest.raises(ValueError):
        library.of_size(0)
