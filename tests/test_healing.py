"""Repairs: known rasters, and random ones against plain loops over pixels."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from framequarry.operators import healing

RED, BLUE = -65536, -16776961
KIND = "frame_id long, w int, h int, pixels array<int>"
ROUND = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dx or dy]


def plain(grid, tiny=3):
    """Rasters as dicts from (y, x) to a colour, 0 where nothing is."""
    at = lambda g, y, x: g.get((y, x), 0)
    out = dict(grid)
    sides = ((0, 1), (1, 0), (0, -1), (-1, 0))

    def area(g, start):
        todo, own = [start], {start}
        while todo:
            y, x = todo.pop()
            for dy, dx in sides:
                p = y + dy, x + dx
                if p in g and p not in own and g[p] == g[start]:
                    own.add(p)
                    todo.append(p)
        return own

    def closed(g):
        """Holes by their pixels."""
        h, w = max(y for y, _ in g), max(x for _, x in g)
        areas = {frozenset(area(g, p)) for p in g if not g[p]}
        return [a for a in areas if not any(y in (0, h) or x in (0, w) for y, x in a)]

    dust = [p for p, c in grid.items() if c and not any(at(grid, p[0] + dy, p[1] + dx) == c for dx, dy in ROUND)]
    out.update(dict.fromkeys(dust, 0))
    small = [a for a in {frozenset(area(out, p)) for p in out if out[p]} if len(a) < tiny]
    for a in small:
        out.update(dict.fromkeys(a, 0))
    now, filled = closed(out), 0
    for first in sorted(min(a) for a in closed(grid)):
        for a in now:
            if first in a and not out[first]:
                n = Counter(at(out, y + dy, x + dx) for y, x in a for dy, dx in sides if at(out, y + dy, x + dx))
                out.update(dict.fromkeys(a, max((k, c) for c, k in n.items())[1]))
                filled += 1
    pairs, bridged = [], [0, 0]
    for y, x in sorted(grid):
        c, right, low = at(grid, y, x), at(grid, y, x + 1), at(grid, y + 1, x)
        if c and at(grid, y + 1, x + 1) == c and c not in (right, low):
            pairs.append((y, x, 0))
            if not right or right != low:
                pairs.append((y, x, 1))
    for y, x, rule in pairs:
        mate = next(((dy, dx) for dx, dy in ((-1, -1), (1, -1), (-1, 1), (1, 1)) if out[y, x] and at(out, y + dy, x + dx) == out[y, x]), None)
        free = sorted(p for p in ((y, x + mate[1]), (y + mate[0], x)) if not out[p]) if mate else []
        if free:
            seen = [sum(bool(at(out, p[0] + dy, p[1] + dx)) for dx, dy in ROUND) for p in free]
            out[free[seen.index(max(seen))]] = out[y, x]
            bridged[rule] += 1
    return out, [len(dust), len(small), filled, *bridged]


def test_random_rasters_by_plain_loops(spark):
    rng = random.Random(11)
    rows = []
    for k in range(120):
        w, h = rng.randint(1, 9), rng.randint(1, 9)
        full = rng.choice([0.35, 0.6, 0.85])
        rows.append((k, w, h, [rng.choice([RED, RED, BLUE]) if rng.random() < full else 0 for _ in range(w * h)]))
    got = {r.frame_id: r for r in healing.mended(spark.createDataFrame(rows, KIND), tiny=3).collect()}
    total = [0] * 5
    for k, w, h, px in rows:
        out, counts = plain({(i // w, i % w): c for i, c in enumerate(px)})
        assert list(got[k].pixels) == [out[i // w, i % w] for i in range(w * h)]
        assert [got[k][r] for r in healing.REPAIRS] == counts
        total = [a + b for a, b in zip(total, counts, strict=True)]
    assert min(total) > 0  # each repair was put to use


def test_scores_and_guard(spark):
    ring = [RED] * 9
    ring[4] = 0
    dusty = [RED] * 16 + [0] * 8 + [0] * 7 + [BLUE]
    rows = [(1, 3, 3, ring), (2, 8, 4, dusty), (3, 4, 4, [RED] * 16), (4, 2, 1, [0, 0])]
    fr = spark.createDataFrame(rows, KIND)
    found = {r.frame_id: r for r in healing.healed(fr).collect()}
    assert found[1].pixels == [RED] * 9 and found[1].enclosed_hole == 1 and found[1].score_after == 100 > found[1].score_before
    assert found[2].pixels[31] == 0 and found[2].isolated_pixel == 1 and found[2].findings_after == 0
    assert found[3].pixels == [RED] * 16 and found[3].applied and found[4].score_after == 100
    assert all(r.score_after >= r.score_before for r in found.values())
    kept = {r.frame_id: r for r in healing.healed(fr, repairs=("isolated_pixel",)).collect()}
    assert kept[1].pixels == ring and kept[1].enclosed_hole == 0
    assert healing.healed(fr.limit(0)).isEmpty()
    with pytest.raises(ValueError):
        healing.mended(fr, repairs=("gloss",))


def test_mended_rasters_are_made_once(spark):
    fr = spark.createDataFrame([(1, 2, 2, [-1, 0, 0, -1])], "frame_id long, w int, h int, pixels array<int>")
    plan = healing.healed(fr)._jdf.queryExecution().withCachedData().toString()
    assert "InMemoryRelation" in plan
