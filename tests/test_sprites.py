"""Sprite files: links, groups, opacity, palettes, files that break off."""

from __future__ import annotations

import struct

import numpy as np
import pytest

from framequarry.sources import sprites as S

R, G = -65536, -16711936


def solid(c: int, w: int = 2, h: int = 2) -> np.ndarray:
    return np.full((h, w), c, np.int32)


def read(*frames: bytes, w: int = 4, h: int = 2, **options) -> dict[str, list[dict]]:
    out: dict[str, list[dict]] = {}
    for r in S.records(S.file_of(list(frames), w, h, **options), "n"):
        out.setdefault(str(r["kind"]), []).append(r)
    return out


def test_layers_links_and_places():
    layers = [S.layer_chunk("group", 1, True, 1), S.layer_chunk(" ", 0.2, False), S.layer_chunk("é", 1, True)]
    first = S.frame_block([*layers, S.cel_chunk(1, solid(R), at=(-1, 1)), S.cel_chunk(2, solid(G), at=(3, 0), opacity=128), S.cel_chunk(0, solid(R)), S.tag_chunk([("t", 0, 9)])], 50)
    second = S.frame_block([S.cel_chunk(1, None, 0, (2, 0)), S.cel_chunk(2, solid(G), at=(9, 9))], 0)
    third = S.frame_block([S.cel_chunk(1, None, 1, packed=False)], 60001)
    found = read(first, second, third)
    assert [(x["id"], x["name"], x["visible"], round(x["opacity"], 2)) for x in found["layer"]] == [(0, "Layer 1", False, 0.2), (1, "é", True, 1.0)]
    assert [x["low"] for x in found["frame"]] == [50, None, None]
    cels = {(x["id"], x["layer"]): np.array(x["pixels"]).reshape(2, 4).tolist() for x in found["cel"]}
    faint = 128 << 24 | 0xFF00
    faint -= 1 << 32
    assert cels == {(0, 0): [[0] * 4, [R, 0, 0, 0]], (0, 1): [[0, 0, 0, faint], [0, 0, 0, faint]], (1, 0): [[0, 0, R, R]] * 2, (2, 0): [[R, R, 0, 0]] * 2}
    assert [x["argb"] for x in found["colour"]] == [R, G]
    assert found["head"][0]["low"] == 20 and found["tag"][0]["high"] == 9
    assert [x["opacity"] for x in read(first, faint=False)["layer"]] == [1.0, 1.0]


def test_palettes_grey_and_raw():
    grey = struct.pack("<HhhBH", 0, 0, 0, 255, 0) + struct.pack("<HH", 2, 1) + bytes([7, 255, 9, 0])
    old = struct.pack("<HBB", 3, 1, 1) + bytes([1, 2, 3, 4, 5, 6])
    found = read(S.frame_block([S._chunk(S._CEL, grey), S._chunk(S._OLD3, old)], 10), w=2, h=1, depth=16)
    assert found["cel"][0]["pixels"].tolist() == [0xFF070707 - (1 << 32), 0] and found["layer"][0]["name"] == "Layer 1"
    assert [x["argb"] for x in found["colour"]] == [0, 0xFF010203 - (1 << 32), 0xFF040506 - (1 << 32)]
    new = read(S.frame_block([S.palette_chunk([R, 5])], 100))
    assert [x["argb"] for x in new["colour"]] == [R, 5] and new["head"][0]["low"] == 10 and "cel" not in new


LAYER = S.layer_chunk("a", 1, True)


@pytest.mark.parametrize(
    "frames",
    [
        [], [S.frame_block([LAYER, S.cel_chunk(1, solid(R))], 1)], [S.frame_block([LAYER, S.cel_chunk(0, None, 0)], 1)], [S.frame_block([LAYER, S.cel_chunk(0, None, 7)], 1)],
        [S.frame_block([LAYER, S.cel_chunk(0, solid(R))[:-3]], 1)], [S.frame_block([S._chunk(S._CEL, struct.pack("<HhhBHHH", 0, 0, 0, 255, 2, 60000, 60000))], 1)],
        [S.frame_block([S._chunk(S._CEL, struct.pack("<HhhBH", 0, 0, 0, 255, 3))], 1)], [S.frame_block([S.tag_chunk([(" ", 0, 0)])], 1)],
        [S.frame_block([S._chunk(S._PALETTE, struct.pack("<III", 3, 0, 3))], 1)], [b"\0" * 16],
        [S.frame_block([LAYER], 1), *[S.frame_block([S.cel_chunk(0, None, k)], 1) for k in (2, 1)]],
    ],
)
def test_broken_files_have_one_error(frames):
    assert [r["kind"] for r in S.records(S.file_of(frames, 4, 2), "n")] == ["error"]


def test_length_depth_and_canvas():
    good = S.file_of([S.frame_block([LAYER], 1)], 4, 2)
    assert S.records(good, "n")[0]["kind"] == "layer"
    for bad in (good + b"x", good[:-1], S.file_of([S.frame_block([LAYER], 1)], 4, 2, depth=8), S.file_of([S.frame_block([LAYER], 1)], 0, 2), b"", good[:4]):
        assert [r["kind"] for r in S.records(bad, "n")] == ["error"]


def test_links_of_equal_cels(spark):
    from framequarry.operators.project import Projects

    make = spark.createDataFrame
    heads = make([(1, "one", 2, 1, 5, 0, 0), (2, "two", 2, 1, 5, 0, 0)], "project_id long, name string, w int, h int, fps int, active_frame int, active_layer int")
    layers = make([(1, 9, 0, "a", 1.0, True, False), (1, 4, 1, "b", 0.4, True, True), (2, 0, 0, "c", 1.0, True, False)], "project_id long, layer_id int, place int, name string, opacity double, visible boolean, locked boolean")
    frames = make([(1, 7, 0, 30), (1, 8, 1, None), (1, 9, 2, 40), (1, 5, 3, 40), (2, 0, 0, 10)], "project_id long, frame_id int, place int, duration_ms int")
    cels = make([(1, f, 9, [R, 0]) for f in (7, 8, 5)] + [(1, f, 4, [G, G]) for f in (8, 9, 5)], "project_id long, frame_id int, layer_id int, pixels array<int>")
    tags = make([(1, 0, "t", 1, 2)], "project_id long, place int, name string, start_frame int, end_frame int")
    files = S.aseprite(Projects(heads, layers, frames, cels, tags)).collect()
    linked = {}
    for f in files:
        parts = [r for r in S.records(f.content, "n") if r["kind"] == "cel"]
        linked[f.project_id] = {(r["id"], r["layer"]): r["pixels"].tolist() for r in parts}
    assert linked == {1: {(0, 0): [R, 0], (1, 0): [R, 0], (3, 0): [R, 0], (1, 1): [G, G], (2, 1): [G, G], (3, 1): [G, G]}, 2: {}}
    one = next(f.content for f in files if f.project_id == 1)
    assert one.count(struct.pack("<H", S._CEL)) >= 6 and len(one) < 128 + 900
    found = S.imported(make([(1, "x", one), (2, None, b"no"), (3, "y", None)], "project_id int, name string, content binary"))
    assert [r.duration_ms for r in found.projects.frames.orderBy("place").collect()] == [30, 200, 40, 40]
    assert {r.project_id for r in found.errors.collect()} == {2, 3}
    assert found.projects.heads.first().fps == 24 and found.projects.tags.first().end_frame == 2
