"""Animations: GIF and APNG files to rasters and back.

An animation is rows (anim_id, place, w, h, pixels, delay), its frames; delay is in
milliseconds. Encoding is relational as far as it goes: a file's colours are an
aggregate over the pixels of its frames (one row per colour and task is shuffled),
frames are compressed each by itself, wherever they lie, and only the compressed
parts of a file meet, in the order of their places. Decoding gives a row per frame,
and works on one file at a time, as each frame of a GIF is drawn over the one before.

Limits hold before anything is allocated: those of a still image for a frame's size,
and 33554432 pixels for all frames of a file. A file that can't be decoded gives one
row with an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import colour as C
from . import codecs
from .frames import pixels

MOST_TOTAL = 33_554_432
_SLOTS = 255  # colours of a GIF besides the transparent one
_FULL = 4096  # codes of a GIF's dictionary


# the dictionary coder


def lzw_packed(indices: bytes, width: int = 8) -> bytes:
    """Codes of growing width, as GIF has them, for indices below 2**width."""
    clear, codes, widths = 1 << width, [], []
    known: dict[tuple[int, int], int] = {}
    size, free = width + 1, clear + 2
    codes.append(clear)
    widths.append(size)
    at = -1
    for v in indices:
        if at < 0:
            at = v
            continue
        longer = known.get((at, v))
        if longer is not None:
            at = longer
            continue
        codes.append(at)
        widths.append(size)
        known[at, v] = free
        free += 1
        if free > 1 << size and size < 12:
            size += 1
        if free == _FULL:
            codes.append(clear)
            widths.append(size)
            known.clear()
            size, free = width + 1, clear + 2
        at = v
    codes += [at, clear + 1]
    widths += [size, size]
    if free == 1 << size and size < 12:
        widths[-1] += 1  # the reader has one entry more by then
    bits = np.arange(12)
    rows = np.array(codes)[:, None] >> bits & 1
    return np.packbits(rows[bits < np.array(widths)[:, None]].astype(np.uint8), bitorder="little").tobytes()


def lzw_unpacked(data: bytes, many: int, width: int) -> bytes:
    """The first `many` indices of a stream of codes."""
    if not 2 <= width <= 8:
        raise ValueError(f"a code size of {width} is out of bounds")
    clear = 1 << width
    table: list[bytes] = []
    out = bytearray()
    size, at, last = width + 1, 0, None
    data += b"\0\0"
    end = 8 * (len(data) - 2)
    while len(out) < many:
        if at + size > end:
            raise ValueError("the codes end too early")
        k = at >> 3
        code = (data[k] | data[k + 1] << 8 | data[k + 2] << 16) >> (at & 7) & (1 << size) - 1
        at += size
        if code == clear:
            table = [bytes([i]) for i in range(clear)] + [b"", b""]
            size, last = width + 1, None
            continue
        if not table:
            table = [bytes([i]) for i in range(clear)] + [b"", b""]
        if code == clear + 1:
            raise ValueError("the picture ends too early")
        if last is None:
            if code > clear:
                raise ValueError("the first code is no colour")
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table) < _FULL:
                entry = last + last[:1]
            else:
                raise ValueError(f"code {code} is not known yet")
            if len(table) < _FULL:
                table.append(last + entry[:1])
                if len(table) == 1 << size and size < 12:
                    size += 1
        out += entry
        last = entry
    if len(out) > many:
        raise ValueError("more pixels than the picture has")
    return bytes(out)


# reading


class _Bytes:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        part = self.data[self.at : self.at + n]
        if len(part) < n:
            raise ValueError(f"the file ends at {len(self.data)}, before {self.at + n}")
        self.at += n
        return part

    def blocks(self) -> list[bytes]:
        found = []
        while n := self.take(1)[0]:
            found.append(self.take(n))
        return found


def _budget(total: int) -> None:
    if total > MOST_TOTAL:
        raise ValueError(f"the frames have more than {MOST_TOTAL} pixels")


def _colours(data: bytes) -> np.ndarray:
    v = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.uint32)
    return (0xFF000000 | v[:, 0] << 16 | v[:, 1] << 8 | v[:, 2]).view(np.int32)


def _interlaced(rows: np.ndarray) -> np.ndarray:
    """Rows that come in four passes (each eighth, the eighths between, the
    quarters between, the odd ones), in their places."""
    h = len(rows)
    order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
    out = np.empty_like(rows)
    out[order] = rows
    return out


def gif_frames(data: bytes) -> Iterator[tuple[np.ndarray, int]]:
    """(pixels, delay in ms) of each frame as it is shown. What a frame leaves
    behind is as its disposal says: all, a hole in its place, or what was there."""
    r = _Bytes(data)
    if r.take(6) not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    w, h, flags, _, _ = struct.unpack("<HHBBB", r.take(7))
    codecs._checked(w, h)
    common = _colours(r.take(3 * (2 << (flags & 7)))) if flags & 0x80 else None
    canvas = np.zeros((h, w), np.int32)
    disposal, delay, clear, shown = 0, 0, None, 0
    while (kind := r.take(1)[0]) != 0x3B:
        if kind == 0x21:
            label = r.take(1)[0]
            parts = r.blocks()
            if label == 0xF9:
                if len(parts) != 1 or len(parts[0]) != 4:
                    raise ValueError("a control block has another size than 4")
                packed, delay, slot = struct.unpack("<BHB", parts[0])
                disposal, clear = packed >> 2 & 7, slot if packed & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError(f"unknown block {kind:#x} at {r.at - 1}")
        left, top, fw, fh, flags = struct.unpack("<HHHHB", r.take(9))
        codecs._checked(fw, fh)
        shown += 1
        _budget(shown * w * h)
        table = _colours(r.take(3 * (2 << (flags & 7)))) if flags & 0x80 else common
        if table is None:
            raise ValueError("a picture without colours")
        width = r.take(1)[0]
        own = np.frombuffer(lzw_unpacked(b"".join(r.blocks()), fw * fh, width), np.uint8).reshape(fh, fw)
        own = _interlaced(own) if flags & 0x40 else own
        own = own[: max(0, h - top), : max(0, w - left)]
        solid = own != clear if clear is not None else np.ones(own.shape, bool)
        if own[solid].max(initial=0) >= len(table):
            raise ValueError("a palette index is out of bounds")
        before = canvas.copy() if disposal == 3 else None
        box = canvas[top : top + fh, left : left + fw]
        box[solid] = table[own[solid]]
        yield canvas.copy(), delay * 10
        if disposal == 2:
            box[:] = 0
        elif disposal == 3:
            canvas = before
        disposal, delay, clear = 0, 0, None
    if not shown:
        raise ValueError("no pictures")
    if r.at < len(data):
        raise ValueError(f"{len(data) - r.at} bytes after the end")


def apng_frames(data: bytes) -> Iterator[tuple[np.ndarray, int]]:
    """(pixels, delay in ms) of each frame as it is shown; a still PNG has one."""
    chunks = list(codecs.chunks(data))
    kinds = [k for k, _ in chunks]
    if b"acTL" not in kinds:
        yield codecs.png_decode(data), 0
        return
    head = next((p for k, p in chunks if k == b"IHDR"), b"")
    w, h = struct.unpack(">II", head[:8])
    codecs._checked(w, h)
    extra = [(k, p) for k, p in chunks if k in (b"PLTE", b"tRNS")]
    shown: list[tuple[tuple, bytes]] = []  # control and compressed rows of each frame
    serial, control, still = 0, None, False
    for kind, part in chunks:
        if kind in (b"fcTL", b"fdAT"):
            if int.from_bytes(part[:4], "big") != serial:
                raise ValueError(f"frame chunks are out of order at {serial}")
            serial += 1
        if kind == b"fcTL":
            control = struct.unpack(">IIIIHHBB", part[4:26])
            if control[2] + control[0] > w or control[3] + control[1] > h or not control[0] or not control[1]:
                raise ValueError("a frame lies out of bounds")
            _budget((len(shown) + 1) * w * h)
            shown.append((control, b""))
        elif kind in (b"IDAT", b"fdAT"):
            if not shown:
                still = still or kind == b"IDAT"  # a picture for readers of stills only
                continue
            shown[-1] = (shown[-1][0], shown[-1][1] + (part if kind == b"IDAT" else part[4:]))
    if not shown or len(shown) != int.from_bytes(next(p for k, p in chunks if k == b"acTL")[:4], "big"):
        raise ValueError("the number of frames is another than the header says")
    canvas = np.zeros((h, w), np.int32)
    for (fw, fh, left, top, num, den, dispose, blend), body in shown:
        own = codecs.png_image(struct.pack(">II", fw, fh) + head[8:], body, extra)
        before = canvas.copy() if dispose == 2 else None
        box = canvas[top : top + fh, left : left + fw]
        box[:] = _over(own, box) if blend else own
        yield canvas.copy(), 1000 * num // (den or 100)
        if dispose == 1:
            box[:] = 0
        elif dispose == 2:
            canvas = before


def _over(top: np.ndarray, below: np.ndarray) -> np.ndarray:
    """top over below, both with straight alpha."""
    a, b = (codecs._rgba(x).astype(np.int64) for x in (top, below))
    rest = b[..., 3:] * (255 - a[..., 3:])
    alpha = a[..., 3:] * 255 + rest
    rgb = (a[..., :3] * a[..., 3:] * 255 + b[..., :3] * rest + alpha // 2) // np.maximum(alpha, 1)
    out = codecs._argb(np.dstack([rgb, (alpha + 127) // 255]))
    return np.where(alpha[..., 0] > 0, out, 0)


READERS = {"gif": gif_frames, "png": apng_frames, "png-interlaced": apng_frames}


def decoded(files: DataFrame, id_col: str = "anim_id", content_col: str = "content") -> DataFrame:
    """(id, place, w, h, pixels, delay, error) of each frame of each file."""
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.int32(), pa.string()]
    names = ["place", "w", "h", "pixels", "delay", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column(1)):
                own = batch.column(0).slice(i, 1)

                def row(*values, own=own) -> pa.RecordBatch:
                    return pa.RecordBatch.from_arrays([own, *[pa.array([v], t) for v, t in zip(values, kinds, strict=True)]], [id_col, *names])

                data = data.as_py() or b""
                kind = codecs.sniffed(data)
                found = []
                try:
                    if kind not in READERS:
                        raise ValueError(f"no animation: {kind or 'unknown'}")
                    found = list(READERS[kind](data))
                except (ValueError, zlib.error, struct.error, IndexError) as e:
                    yield row(None, None, None, None, None, str(e))
                    continue
                for k, (px, delay) in enumerate(found):
                    yield row(k, px.shape[1], px.shape[0], px.ravel(), delay, None)

    base = files.select(F.col(id_col), F.col(content_col))
    kind = base.schema[id_col].dataType.simpleString()
    return base.mapInArrow(run, f"{id_col} {kind}, place int, w int, h int, pixels array<int>, delay int, error string")


# writing


def colour_bins(animations: DataFrame) -> DataFrame:
    """(anim_id, bin, n, rgb): the opaque pixels of each animation by the upper
    6, 6 and 5 bits of their channels, with the commonest colour of each bin (ties:
    the smallest)."""
    seen = pixels(animations.select(F.struct("anim_id", "place").alias("frame_id"), "w", "h", "pixels")).where(C.alpha(F.col("argb")) >= 128)
    rgb = F.col("argb").bitwiseAND(F.lit(0xFFFFFF))
    bin_ = C.red(rgb).bitwiseAND(F.lit(252)) * 512 + C.green(rgb).bitwiseAND(F.lit(252)) * 8 + C.idiv(C.blue(rgb), 8)
    counted = seen.groupBy(F.col("frame_id.anim_id").alias("anim_id"), bin_.cast("int").alias("bin"), rgb.alias("rgb")).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("minus"), "rgb"))["rgb"].alias("rgb")
    return counted.groupBy("anim_id", "bin").agg(F.sum("n").alias("n"), best)


def _halved(boxes: list[np.ndarray], rgb: np.ndarray, n: np.ndarray, bins: np.ndarray) -> list[np.ndarray]:
    """Median cut: the fullest box that can be split is, at half of its pixels
    along its widest channel, until there are enough."""
    weight = [int(n[b].sum()) for b in boxes]
    while len(boxes) < _SLOTS:
        k = max((i for i, b in enumerate(boxes) if len(b) > 1), key=weight.__getitem__, default=-1)
        if k < 0:
            break
        own = boxes.pop(k)
        weight.pop(k)
        axis = int(np.ptp(rgb[own], axis=0).argmax())
        others = [c for c in range(3) if c != axis]
        own = own[np.lexsort([bins[own], rgb[own, others[1]], rgb[own, others[0]], rgb[own, axis]])]
        sums = np.cumsum(n[own])
        cut = int(np.abs(2 * sums[:-1] - sums[-1]).argmin()) + 1
        for part in (own[:cut], own[cut:]):
            boxes.append(part)
            weight.append(int(n[part].sum()))
    return boxes


def _reduced(key: tuple, table: pa.Table) -> pa.Table:
    """The colours of one animation; its bins are 131072 at most."""
    bins, n, rgb = (np.asarray(table.column(c)).astype(np.int64) for c in ("bin", "n", "rgb"))
    parts = np.stack([rgb >> 16 & 255, rgb >> 8 & 255, rgb & 255], 1)
    order = np.argsort(bins, kind="stable")
    found = []
    for b in _halved([order], parts, n, bins):
        mean = (parts[b] * n[b, None] + 0).sum(0) + n[b].sum() // 2
        mean //= n[b].sum()
        found.append((-int(n[b].sum()), int(mean[0] << 16 | mean[1] << 8 | mean[2])))
    return pa.table([table.column("anim_id").slice(0, 1), pa.array([[c for _, c in sorted(found)]], pa.list_(pa.int32()))], names=["anim_id", "colours"])


def palettes(animations: DataFrame) -> DataFrame:
    """(anim_id, colours): up to 255 opaque colours of each animation, the
    commonest first; those of the bins where they are few enough, otherwise median
    cut over the bins. Animations without an opaque pixel have no row."""
    bins = colour_bins(animations)
    many = bins.groupBy("anim_id").agg(F.count("*").alias("many"))
    few = bins.join(many.where(F.col("many") <= _SLOTS), "anim_id").groupBy("anim_id")  # 255 rows a group at most
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "bin", "rgb")))
    few = few.agg(listed.alias("s")).select("anim_id", F.col("s.rgb").alias("colours"))
    kind = bins.schema["anim_id"].dataType.simpleString()
    more = bins.join(many.where(F.col("many") > _SLOTS), "anim_id").groupBy("anim_id").applyInArrow(lambda key, table: _reduced(key, table), f"anim_id {kind}, colours array<int>")
    return few.unionByName(more)


def _slots(px: np.ndarray, colours: np.ndarray) -> bytes:
    """The slot of each pixel: 0 where it is transparent, else 1 and up, that of
    its own colour or of the nearest (squared distance in RGB; ties: the first)."""
    shades, inverse = np.unique(px, return_inverse=True)
    parts = lambda v: np.stack([v >> 16 & 255, v >> 8 & 255, v & 255], -1).astype(np.int64)
    out = np.zeros(len(shades), np.uint8)
    solid = np.flatnonzero((shades >> 24 & 255) >= 128)
    for part in np.array_split(solid, max(1, len(solid) // 4096)):
        if len(part):
            d = ((parts(shades[part])[:, None] - parts(colours)[None]) ** 2).sum(2)
            out[part] = d.argmin(1) + 1
    return out[inverse.ravel()].tobytes()


def _sub_blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(p)]) + p for p in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def gif_image(px: np.ndarray, colours: np.ndarray, delay: int, box: tuple[int, int, int, int] | None = None, disposal: int = 2) -> bytes:
    """Control block and picture of one frame, with slot 0 transparent. box: x, y,
    w, h of the part that is written."""
    h, w = px.shape
    x, y, w, h = box or (0, 0, w, h)
    control = struct.pack("<BBBBHBB", 0x21, 0xF9, 4, disposal << 2 | 1, min(0xFFFF, max(2, delay // 10)), 0, 0)
    own = np.ascontiguousarray(px[y : y + h, x : x + w]).ravel()
    return control + struct.pack("<BHHHHBB", 0x2C, x, y, w, h, 0, 8) + _sub_blocks(lzw_packed(_slots(own, colours)))


def _table(colours: np.ndarray) -> bytes:
    """256 entries: none, the colours, and black for the rest."""
    v = np.zeros((256, 3), np.uint8)
    own = np.asarray(colours, np.int64)
    v[1 : len(own) + 1] = np.stack([own >> 16 & 255, own >> 8 & 255, own & 255], 1)
    return v.tobytes()


def _images(kind: str):
    """The part of a file that a frame makes, and for place 0 the file's head."""

    def gif(px: np.ndarray, delay: int, place: int, colours: list[int] | None, w: int, h: int) -> tuple[bytes, bytes]:
        own = np.array(colours or [], np.int64)
        head = struct.pack("<6sHHBBB", b"GIF89a", w, h, 0xF7, 0, 0) + _table(own) if place == 0 else b""
        return head, gif_image(px, own if len(own) else np.zeros(1, np.int64), delay)

    def apng(px: np.ndarray, delay: int, place: int, colours: None, w: int, h: int) -> tuple[bytes, bytes]:
        head = codecs.PNG + codecs.chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) if place == 0 else b""
        serial = 2 * place - 1 if place else 0
        control = struct.pack(">IIIIIHHBB", serial, w, h, 0, 0, min(0xFFFF, max(0, delay)), 1000, 0, 0)
        rows = codecs.packed_rows(px)
        body = codecs.chunk(b"fdAT", struct.pack(">I", serial + 1) + rows) if place else codecs.chunk(b"IDAT", rows)
        return head, codecs.chunk(b"fcTL", control) + body

    one = gif if kind == "gif" else apng

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True)
            made = [one(np.array(px, np.int32).reshape(h, w), delay, place, colours, w, h) for place, w, h, px, delay, colours in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.binary())], ["anim_id", "place", "head", "body"])

    return run


def _bytes(value: Column | bytes) -> Column:
    return F.unhex(F.lit(value.hex())) if isinstance(value, bytes) else value


def encoded(animations: DataFrame, kind: str, loop: int = 0) -> DataFrame:
    """(anim_id, content, error): a GIF or APNG of each animation, `loop` times
    (0: for ever). Frames of one animation have one size; places are 0 and up
    without gaps, and are dealt anew if they are not. An animation whose frames differ
    in size, or have more pixels than a reader takes, has an error instead."""
    if kind not in ("gif", "apng"):
        raise ValueError(f"unknown kind {kind!r}")
    whole = animations.groupBy("anim_id").agg(*[f(c).alias(f"{n}_{c}") for c in "wh" for n, f in (("lo", F.min), ("hi", F.max))], F.count("*").alias("many"))
    area = F.col("hi_w").cast("long") * F.col("hi_h")
    wrong = (
        F.when((F.col("lo_w") != F.col("hi_w")) | (F.col("lo_h") != F.col("hi_h")), "frames differ in size")
        .when((F.greatest("hi_w", "hi_h") > codecs.MOST_EDGE) | (area > codecs.MOST_PIXELS) | (F.least("lo_w", "lo_h") < 1), "a size out of bounds")
        .when(area * F.col("many") > MOST_TOTAL, "too many pixels")
    )
    whole = whole.select("anim_id", wrong.alias("error"))
    place = F.row_number().over(Window.partitionBy("anim_id").orderBy("place")) - 1  # a file's frames are bounded, see MOST_TOTAL
    good = animations.join(whole.where("error is null").select("anim_id"), "anim_id").withColumn("place", place)
    if kind == "gif":
        good = good.join(palettes(good), "anim_id", "left")
    else:
        good = good.withColumn("colours", F.lit(None).cast("array<int>"))
    base = good.select("anim_id", "place", "w", "h", "pixels", "delay", "colours")
    parts = base.mapInArrow(_images(kind), f"anim_id {base.schema['anim_id'].dataType.simpleString()}, place int, head binary, body binary")
    # bytes as hexadecimal text: array_join takes no binary
    files = parts.groupBy("anim_id").agg(F.max("head").alias("head"), F.count("*").alias("many"), F.array_sort(F.collect_list(F.struct("place", F.hex("body").alias("body")))).alias("s"))
    body = F.unhex(F.array_join(F.col("s.body"), ""))
    if kind == "gif":
        looped = b"\x21\xff\x0bNETSCAPE2.0\x03\x01" + struct.pack("<H", min(max(loop, 0), 0xFFFF)) + b"\0"
        content = F.concat("head", _bytes(looped), body, _bytes(b"\x3b"))
    else:
        control = F.concat(_bytes(b"acTL"), F.unhex(F.lpad(F.hex("many"), 8, "0")), _bytes(struct.pack(">I", max(loop, 0))))
        control = F.concat(_bytes(struct.pack(">I", 8)), control, F.unhex(F.lpad(F.hex(F.crc32(control)), 8, "0")))
        content = F.concat("head", control, body, _bytes(codecs.chunk(b"IEND", b"")))
    return whole.join(files.select("anim_id", content.alias("content")), "anim_id", "left").select("anim_id", "content", "error")


def patched(frames: DataFrame, patches: list[tuple[int, int, int, int, int, int, int]]) -> DataFrame:
    """(anim_id, content): each raster as a GIF that shows it and then parts of it
    at other places. patches: x, y, w, h, from_x, from_y, disposal (1: stays, 2:
    leaves a hole, 3: what was there comes back)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = []
            for w, h, px, colours in zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True):
                own, table = np.array(px, np.int32).reshape(h, w), np.array(colours or [0], np.int64)
                out = [struct.pack("<6sHHBBB", b"GIF89a", w, h, 0xF7, 0, 0), _table(table), gif_image(own, table, 0, disposal=1)]
                for x, y, pw, ph, fx, fy, disposal in patches:
                    moved = np.zeros((h, w), np.int32)
                    moved[y : y + ph, x : x + pw] = own[fy : fy + ph, fx : fx + pw]
                    out.append(gif_image(moved, table, 50, (x, y, pw, ph), disposal))
                files.append(b"".join(out) + b"\x3b")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], ["anim_id", "content"])

    base = frames.select(F.col("frame_id").alias("anim_id"), F.lit(0).alias("place"), "w", "h", "pixels")
    base = base.join(palettes(base), "anim_id", "left").select("anim_id", "w", "h", "pixels", "colours")
    return base.mapInArrow(run, f"anim_id {base.schema['anim_id'].dataType.simpleString()}, content binary")
