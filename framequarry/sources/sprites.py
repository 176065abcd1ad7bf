"""Sprite files to projects and back.

`imported` reads any image file that the library knows (Aseprite, GIF, PNG and APNG,
QOI, BMP) into the relations of `operators.project`: heads, layers, frames, cels and
tags, with the files' palettes and errors as two more. A file is one row, read in one
task; its records leave that task as rows of their own, so a file's frames and layers
never meet in one row. The records are written once and then told apart.

`aseprite` writes projects as Aseprite files: cels are compressed where they lie, one
that equals the one before it on its layer becomes a link, and only the compressed
parts of a file meet.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import colour as C
from ..operators.project import ID, Projects
from ..operators.seams import _cut
from . import animations, codecs

#: Fixed values of the format.
_FILE, _FRAME = 0xA5E0, 0xF1F0
_LAYER, _CEL, _TAGS, _PALETTE, _OLD3, _OLD4 = 0x2022, 0x2005, 0x2018, 0x2019, 0x0004, 0x0011
MOST_LINKS, MOST_COLOURS, MOST_HINTS, LONGEST = 256, 65_536, 256, 60_000
_RECORD = "kind string, place int, id int, layer int, name string, w int, h int, opacity double, visible boolean, low int, high int, argb int, pixels array<int>"
_NAMES = [part.strip().split()[0] for part in _RECORD.split(",")]

Record = dict[str, object]


class _Reader(animations._Bytes):
    def numbers(self, form: str) -> tuple:
        return struct.unpack("<" + form, self.take(struct.calcsize("<" + form)))

    def number(self, form: str) -> int:
        return self.numbers(form)[0]

    def text(self) -> str:
        return self.take(self.number("H")).decode("utf-8", "replace")

    def left(self) -> bytes:
        return self.take(len(self.data) - self.at)


@dataclass
class _Cel:
    layer: int
    x: int
    y: int
    opacity: int
    link: int | None = None
    pixels: np.ndarray | None = None


def _raw(data: bytes, w: int, h: int, depth: int) -> np.ndarray:
    v = np.frombuffer(data, np.uint8).reshape(h, w, depth // 8)
    return codecs._argb(v if depth == 32 else v[..., [0, 0, 0, 1]])


def _cel(r: _Reader, depth: int) -> _Cel:
    layer, x, y, opacity, kind = r.numbers("HhhBH")
    if kind == 1:
        return _Cel(layer, x, y, opacity, link=r.number("H"))
    if kind not in (0, 2):
        raise ValueError(f"a cel of layer {layer} has the unknown type {kind}")
    w, h = r.numbers("HH")
    codecs._checked(w, h)
    size = w * h * depth // 8
    if kind == 0:
        return _Cel(layer, x, y, opacity, pixels=_raw(r.take(size), w, h, depth))
    engine = zlib.decompressobj()
    data = engine.decompress(r.left(), size + 1)
    if len(data) != size or not engine.eof:
        raise ValueError(f"a cel of layer {layer} has another size than {size}")
    return _Cel(layer, x, y, opacity, pixels=_raw(data, w, h, depth))


def _new_palette(r: _Reader) -> list[int]:
    size, first, last = r.numbers("III")
    size = size or 256
    if size > MOST_COLOURS or last >= size:
        raise ValueError(f"a palette of {size} with colours {first} to {last}")
    out = [0] * size
    for k in range(first, last + 1):
        flags, *rgba = r.numbers("HBBBB")
        if flags & 1:
            r.text()
        out[k] = int(codecs._argb(np.array([rgba], np.uint8))[0])
    return out


def _old_palette(r: _Reader, width: int) -> list[int]:
    size = r.number("H")
    if size > MOST_COLOURS:
        raise ValueError(f"a palette of {size}")
    out, at = [0] * (size or 256), 0
    while at < size and r.at < len(r.data):
        skip, more = r.numbers("BB")
        at += skip
        for _ in range(more + 1):
            if at >= size:
                break
            rgba = [*r.take(width), 255][:4]
            out[at] = int(codecs._argb(np.array([rgba], np.uint8))[0])
            at += 1
    return out


def _tags(r: _Reader) -> list[Record]:
    found = []
    for place in range(r.number("H")):
        low, high, *_ = r.numbers("HHB8s")
        name = r.text()
        if not name.strip():
            raise ValueError(f"tag {place} has no name")
        found.append({"kind": "tag", "place": place, "name": name, "low": low, "high": high})
    return found


def _chunks(r: _Reader, end: int, many: int) -> Iterator[tuple[int, _Reader]]:
    for _ in range(many):
        start = r.at
        if start + 6 > end:
            raise ValueError(f"a chunk at {start} lies past its frame's end")
        size, kind = r.numbers("IH")
        if size < 6 or start + size > end:
            raise ValueError(f"a chunk at {start} has the size {size}")
        yield kind, _Reader(r.take(size - 6))


def _placed(cel: _Cel, source: np.ndarray, w: int, h: int) -> np.ndarray | None:
    """A cel's pixels on the canvas, by its opacity; None where nothing shows."""
    out = np.zeros((h, w), np.int64)
    x0, y0 = max(0, cel.x), max(0, cel.y)
    part = source[y0 - cel.y : max(0, h - cel.y), x0 - cel.x : max(0, w - cel.x)].astype(np.int64)
    alpha = (part >> 24 & 255) * cel.opacity // 255
    shown = np.where(alpha > 0, alpha << 24 | part & 0xFFFFFF, 0)
    if not shown.any():
        return None
    out[y0 : y0 + part.shape[0], x0 : x0 + part.shape[1]] = shown
    return (out & 0xFFFFFFFF).astype(np.uint32).view(np.int32)


def aseprite_records(data: bytes, name: str) -> Iterator[Record]:
    """The head, layers, frames, cels, tags and palette of a file as records."""
    r = _Reader(data)
    size, magic, frames, w, h, depth, flags = r.numbers("IHHHHHI")
    if size != len(data) or magic != _FILE or not frames:
        raise ValueError("not an Aseprite file, or one of another length")
    codecs._checked(w, h)
    if depth not in (16, 32):
        raise ValueError(f"a colour depth of {depth}")
    r.take(128 - r.at)
    layers: list[tuple[int, int, int, str]] = []
    tags: list[Record] = []
    palette: list[int] = []
    cels: list[list[_Cel]] = []
    times: list[int] = []
    for _ in range(frames):
        start = r.at
        size, magic, old, ms, _, new = r.numbers("IHHHHI")
        if size < 16 or start + size > len(data) or magic != _FRAME:
            raise ValueError(f"no frame at {start}")
        own: list[_Cel] = []
        for kind, c in _chunks(r, start + size, new if old == 0xFFFF else old):
            if kind == _LAYER:
                shown, sort, _, _, _, _, opacity, _ = c.numbers("HHHHHHB3s")
                layers.append((shown, sort, opacity, c.text()))
            elif kind == _CEL:
                own.append(_cel(c, depth))
            elif kind == _TAGS:
                tags += _tags(c)
            elif kind == _PALETTE:
                palette = _new_palette(c)
            elif kind in (_OLD3, _OLD4):
                palette = _old_palette(c, 3 if kind == _OLD3 else 4)
        r.at = start + size
        cels.append(own)
        times.append(ms)
    yield from _project(name, w, h, flags & 1, layers, tags, palette, cels, times)


def _project(name: str, w: int, h: int, faint: int, layers: list, tags: list[Record], palette: list[int], cels: list[list[_Cel]], times: list[int]) -> Iterator[Record]:
    ids: dict[int, int] = {}
    for k, (shown, sort, opacity, title) in enumerate(layers):
        if sort != 0:
            continue  # groups have no pixels of their own
        ids[k] = len(ids)
        yield {"kind": "layer", "id": ids[k], "place": ids[k], "name": title if title.strip() else f"Layer {ids[k] + 1}", "opacity": opacity / 255 if faint else 1.0, "visible": bool(shown & 1)}
    if not ids:
        ids[0] = 0
        yield {"kind": "layer", "id": 0, "place": 0, "name": "Layer 1", "opacity": 1.0, "visible": True}
    of = [{c.layer: c for c in reversed(own)} for own in cels]  # the first of a layer's cels counts for links

    def source(frame: int, layer: int) -> np.ndarray:
        for _ in range(MOST_LINKS + 1):
            cel = of[frame].get(layer) if frame < len(of) else None
            if cel is None:
                raise ValueError(f"a link of layer {layer} leads to frame {frame}, which has no cel there")
            if cel.pixels is not None:
                return cel.pixels
            frame = cel.link or 0
        raise ValueError(f"links of layer {layer} go in a circle or too far")

    total, seen = 0, {}
    for frame, own in enumerate(cels):
        ms = times[frame]
        yield {"kind": "frame", "id": frame, "place": frame, "low": ms if 1 <= ms <= LONGEST else None}
        last = {}
        for cel in own:
            if cel.layer >= max(len(layers), 1):
                raise ValueError(f"a cel names layer {cel.layer} of {len(layers)}")
            pixels = source(frame, cel.layer)
            placed = _placed(cel, pixels, w, h) if cel.layer in ids else None
            if placed is not None:
                last[ids[cel.layer]] = placed
        for layer, px in sorted(last.items()):
            total += px.size
            animations._budget(total)
            if not palette and len(seen) < MOST_HINTS:
                seen |= dict.fromkeys((px[(px >> 24 & 255) >= 128] | -16777216).ravel().tolist())
            yield {"kind": "cel", "id": frame, "layer": layer, "w": w, "h": h, "pixels": px.ravel()}
    yield from tags
    for k, c in enumerate(palette or list(seen)[:MOST_HINTS] or [-16777216]):
        yield {"kind": "colour", "place": k, "argb": c}
    fps = min(24, max(1, 1000 // times[0])) if 1 <= times[0] <= LONGEST else 12
    yield {"kind": "head", "name": name, "w": w, "h": h, "low": fps, "id": max(ids.values())}


def picture_records(data: bytes, name: str) -> Iterator[Record]:
    """A still or an animation as a project of one layer; its colours are the
    palette if they are 256 at most, otherwise 256 greys are."""
    kind = codecs.sniffed(data)
    if kind in animations.READERS:
        shown = list(animations.READERS[kind](data))
    elif kind in codecs.DECODERS:
        shown = [(codecs.DECODERS[kind](data), 0)]
    else:
        raise ValueError(f"no reader for {kind or 'this file'}")
    h, w = shown[0][0].shape
    yield {"kind": "head", "name": name, "w": w, "h": h, "low": 12, "id": 0}
    yield {"kind": "layer", "id": 0, "place": 0, "name": "Layer 1", "opacity": 1.0, "visible": True}
    colours: dict[int, None] = {}
    for k, (px, ms) in enumerate(shown):
        yield {"kind": "frame", "id": k, "place": k, "low": ms if 1 <= ms <= LONGEST else None}
        yield {"kind": "cel", "id": k, "layer": 0, "w": w, "h": h, "pixels": px.ravel()}
        if len(colours) <= MOST_HINTS:
            colours |= dict.fromkeys((px[(px >> 24 & 255) >= 128] | -16777216).ravel().tolist())
    greys = [0x10101 * k - (1 << 24) for k in range(256)]
    for k, c in enumerate(colours if 0 < len(colours) <= MOST_HINTS else greys):
        yield {"kind": "colour", "place": k, "argb": c}


def records(data: bytes, name: str) -> list[Record]:
    """All records of a file, or one error; a file that breaks off has no others."""
    try:
        return list(aseprite_records(data, name) if codecs.sniffed(data) == "aseprite" else picture_records(data, name))
    except (ValueError, zlib.error, struct.error, IndexError) as e:
        return [{"kind": "error", "name": str(e)}]


@dataclass(frozen=True)
class Imported:
    projects: Projects
    palettes: DataFrame  # project_id, idx, argb
    errors: DataFrame  # project_id, error


_TYPES = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
_KINDS = [_TYPES[part.strip().split()[1]] for part in _RECORD.split(",")]


def imported(files: DataFrame) -> Imported:
    """files: project_id, name, content. A file that can't be read is no project
    but a row of errors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (name, data) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                found = records(data.as_py() or b"", name if name and name.strip() else "import")
                key = batch.column(0).slice(i, 1)
                for a in range(0, len(found), 64):
                    part = found[a : a + 64]
                    keys = pa.concat_arrays([key] * len(part))
                    yield pa.RecordBatch.from_arrays([keys, *[pa.array([x.get(n) for x in part], t) for n, t in zip(_NAMES, _KINDS, strict=True)]], [ID, *_NAMES])

    base = files.select(ID, "name", "content")
    all_ = _cut(base.mapInArrow(run, f"{ID} {base.schema[ID].dataType.simpleString()}, {_RECORD}"))

    def of(kind: str, *columns) -> DataFrame:
        return all_.where(F.col("kind") == kind).select(ID, *columns)

    named = lambda a, b: F.col(a).alias(b)
    heads = of("head", "name", "w", "h", named("low", "fps"), F.lit(0).alias("active_frame"), named("id", "active_layer"))
    layers = of("layer", named("id", "layer_id"), "place", "name", "opacity", "visible", F.lit(False).alias("locked"))
    frames = of("frame", named("id", "frame_id"), "place", named("low", "duration_ms"))
    cels = of("cel", named("id", "frame_id"), named("layer", "layer_id"), "pixels")
    tags = of("tag", "place", "name", named("low", "start_frame"), named("high", "end_frame"))
    return Imported(Projects(heads, layers, frames, cels, tags), of("colour", named("place", "idx"), "argb"), of("error", named("name", "error")))


# writing
def _chunk(kind: int, body: bytes) -> bytes:
    return struct.pack("<IH", len(body) + 6, kind) + body


def _text(value: str) -> bytes:
    data = value.encode()[:0xFFFF]
    return struct.pack("<H", len(data)) + data


def layer_chunk(name: str, opacity: float, visible: bool, kind: int = 0) -> bytes:
    return _chunk(_LAYER, struct.pack("<HHHHHHB3x", int(visible), kind, 0, 0, 0, 0, round(opacity * 255)) + _text(name))


def tag_chunk(tags: list[tuple[str, int, int]]) -> bytes:
    return _chunk(_TAGS, struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHB8x", low, high, 0) + _text(name) for name, low, high in tags))


def palette_chunk(colours: list[int]) -> bytes:
    rgba = codecs._rgba(np.array(colours, np.int64).astype(np.uint32).view(np.int32).reshape(1, -1))[0]
    return _chunk(_PALETTE, struct.pack("<III8x", len(colours), 0, len(colours) - 1)[:12] + b"".join(b"\0\0" + c.tobytes() for c in rgba))


def cel_chunk(layer: int, px: np.ndarray | None, link: int = 0, at: tuple[int, int] = (0, 0), opacity: int = 255, packed: bool = True) -> bytes:
    """A cel with pixels, or with those of an earlier frame."""
    head = struct.pack("<HhhBH", layer, *at, opacity, 1 if px is None else 2 if packed else 0)
    if px is None:
        return _chunk(_CEL, head + struct.pack("<H", link))
    data = codecs._rgba(px).tobytes()
    return _chunk(_CEL, head + struct.pack("<HH", px.shape[1], px.shape[0]) + (zlib.compress(data, 9) if packed else data))


def frame_block(chunks: list[bytes], ms: int) -> bytes:
    body = b"".join(chunks)
    return struct.pack("<IHHHHI", 16 + len(body), _FRAME, min(len(chunks), 0xFFFE), ms, 0, len(chunks)) + body


def file_of(frames: list[bytes], w: int, h: int, depth: int = 32, faint: bool = True) -> bytes:
    body = b"".join(frames)
    head = struct.pack("<IHHHHHI", 128 + len(body), _FILE, len(frames), w, h, depth, int(faint))
    return head.ljust(128, b"\0") + body


def aseprite(p: Projects) -> DataFrame:
    """(project_id, content): each project as a file. Layers are written in the
    order of their places; opacities in steps of 1/255."""
    ranked = p.layers.withColumn("number", F.row_number().over(Window.partitionBy(ID).orderBy("place")) - 1)
    cels = p.cels.join(ranked.select(ID, "layer_id", "number"), [ID, "layer_id"]).join(p.frames.select(ID, "frame_id", "place"), [ID, "frame_id"])
    print_ = F.xxhash64("pixels")
    before = Window.partitionBy(ID, "number").orderBy("place")
    first = F.when((F.lag("h").over(before) == F.col("h")) & (F.lag("place").over(before) == F.col("place") - 1), None).otherwise(F.col("place"))
    keyed = cels.select(ID, "number", "place", "pixels", print_.alias("h")).withColumn("own", first)
    keyed = keyed.withColumn("source", F.last("own", True).over(before))
    sized = keyed.join(p.heads.select(ID, "w", F.col("h").alias("rows")), ID)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for number, px, own, source, w, h in zip(*[batch.column(k).to_pylist() for k in (1, 3, 5, 6, 7, 8)], strict=True):
                out.append(cel_chunk(number, None if own is None else np.array(px, np.int32).reshape(h, w), source))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.binary())], [ID, "number", "place", "chunk"])

    kind = sized.schema[ID].dataType.simpleString()
    parts = sized.select(ID, "number", "place", "pixels", "h", "own", "source", "w", "rows").mapInArrow(packed, f"{ID} {kind}, number int, place int, chunk binary")
    by_frame = parts.groupBy(ID, "place").agg(F.array_sort(F.collect_list(F.struct("number", "chunk"))).alias("cels"))
    frames = p.frames.join(by_frame, [ID, "place"], "left").groupBy(ID).agg(F.array_sort(F.collect_list(F.struct("place", "duration_ms", F.col("cels.chunk").alias("chunks")))).alias("frames"))
    layers = ranked.groupBy(ID).agg(F.array_sort(F.collect_list(F.struct("number", "name", "opacity", "visible"))).alias("layers"))
    tags = p.tags.groupBy(ID).agg(F.array_sort(F.collect_list(F.struct("place", "name", "start_frame", "end_frame"))).alias("tags"))
    whole = p.heads.select(ID, "w", "h", "fps").join(frames, ID).join(layers, ID).join(tags, ID, "left")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                blocks = []
                for k, f in zip(count(), x["frames"], strict=False):
                    head = [layer_chunk(v["name"], v["opacity"], v["visible"]) for v in x["layers"]] if k == 0 else []
                    head += [tag_chunk([(t["name"], t["start_frame"], t["end_frame"]) for t in x["tags"]])] if k == 0 and x["tags"] else []
                    blocks.append(frame_block([*head, *(f["chunks"] or [])], f["duration_ms"] or 1000 // x["fps"]))
                out.append(file_of(blocks, x["w"], x["h"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [ID, "content"])

    return whole.mapInArrow(written, f"{ID} {kind}, content binary")


def palette_of(p: Projects) -> DataFrame:
    """(project_id, argb, n): the opaque colours of a project's cels."""
    flat = p.cels.select(ID, F.explode_outer("pixels").alias("argb")).where(C.alpha(F.col("argb")) >= 128)
    return flat.groupBy(ID, F.col("argb").bitwiseOR(F.lit(-16777216)).alias("argb")).agg(F.count("*").alias("n"))
