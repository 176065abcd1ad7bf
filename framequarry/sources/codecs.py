"""Image files: PNG, QOI and BMP to rasters and back.

Bytes come in with Spark's binaryFile source or any binary column and go out as
a binary column; each file is one row, so decoding runs in parallel over files.
Limits hold before anything is allocated: 16384 pixels an edge, 16777216 a
frame. A file that can't be decoded gives a row with an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_EDGE, MOST_PIXELS = 16_384, 16_777_216
PNG = _PNG = b"\x89PNG\r\n\x1a\n"


def sniffed(data: bytes) -> str | None:
    """The format by the first bytes; a PNG is `png-interlaced` by its header."""
    if data.startswith(PNG) and data[12:16] == b"IHDR" and data[28:29] == b"\1":
        return "png-interlaced"
    for name, magic in (("png", PNG), ("gif", b"GIF87a"), ("gif", b"GIF89a"), ("qoi", b"qoif"), ("bmp", b"BM"), ("ico", b"\0\0\1\0")):
        if data.startswith(magic):
            return name
    return "aseprite" if data[4:6] == b"\xe0\xa5" else None


def _checked(w: int, h: int) -> None:
    if not (0 < w <= MOST_EDGE and 0 < h <= MOST_EDGE and w * h <= MOST_PIXELS):
        raise ValueError(f"a size of {w} x {h} is out of bounds")


def _rgba(px: np.ndarray) -> np.ndarray:
    v = px.astype(np.int32).view(np.uint32)
    return np.stack([v >> 16 & 255, v >> 8 & 255, v & 255, v >> 24], -1).astype(np.uint8)


def _argb(rgba: np.ndarray) -> np.ndarray:
    v = rgba.astype(np.uint32)
    return (v[..., 3] << 24 | v[..., 0] << 16 | v[..., 1] << 8 | v[..., 2]).view(np.int32)


def chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def packed_rows(px: np.ndarray) -> bytes:
    """Rows of 8-bit RGBA, compressed."""
    h = len(px)
    return zlib.compress(np.concatenate([np.zeros((h, 1), np.uint8), _rgba(px).reshape(h, -1)], axis=1).tobytes(), 9)


def png_encode(px: np.ndarray) -> bytes:
    h, w = px.shape
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", packed_rows(px)) + chunk(b"IEND", b"")


#: The seven passes of an interlaced PNG: first column and row, steps of both.
_PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def png_encode_interlaced(px: np.ndarray) -> bytes:
    h, w = px.shape
    parts = [px[y::dy, x::dx] for x, y, dx, dy in _PASSES]
    rows = b"".join(b"\0" + line.tobytes() for p in parts if p.size for line in _rgba(p).reshape(len(p), -1))
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 1)) + chunk(b"IDAT", zlib.compress(rows, 9)) + chunk(b"IEND", b"")


def _unfiltered(raw: bytes, h: int, stride: int, step: int) -> np.ndarray:
    out = np.zeros((h + 1, stride + step), np.uint8)
    for y in range(h):
        kind, line = raw[y * (stride + 1)], np.frombuffer(raw, np.uint8, stride, y * (stride + 1) + 1)
        above, now = out[y], out[y + 1]
        if kind == 0:
            now[step:] = line
        elif kind == 2:
            now[step:] = line + above[step:]
        elif kind == 1:
            for k in range(step):
                now[step + k :: step] = np.cumsum(line[k::step], dtype=np.uint64).astype(np.uint8)
        elif kind in (3, 4):
            a, b = now.tolist(), above.tolist()
            for i, v in enumerate(line.tolist()):
                left, up, slant = a[i], b[i + step], b[i]
                if kind == 3:
                    guess = left + up >> 1
                else:
                    p = left + up - slant
                    dl, du, ds = abs(p - left), abs(p - up), abs(p - slant)
                    guess = left if dl <= du and dl <= ds else up if du <= ds else slant
                a[i + step] = v + guess & 255
            now[:] = a
        else:
            raise ValueError(f"unknown filter {kind}")
    return out[1:, step:]


def chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Kind and body of each chunk of a PNG, checked."""
    if not data.startswith(PNG):
        raise ValueError("not a PNG")
    at = 8
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + n]
        if len(part) < n or zlib.crc32(kind + part) != int.from_bytes(data[at + 8 + n : at + 12 + n], "big"):
            raise ValueError(f"chunk {kind!r} is damaged")
        yield kind, part
        if kind == b"IEND":
            return
        at += 12 + n


def png_decode(data: bytes) -> np.ndarray:
    """Still images of all colour types, 8 and 16 bits or packed, interlaced too."""
    found = list(chunks(data))
    head = next((p for k, p in found if k == b"IHDR"), None)
    if head is None:
        raise ValueError("no header")
    return png_image(head, b"".join(p for k, p in found if k == b"IDAT"), [x for x in found if x[0] in (b"PLTE", b"tRNS")])


def png_image(header: bytes, body: bytes, extra: list[tuple[bytes, bytes]]) -> np.ndarray:
    """Pixels of a header's body, palette and transparency."""
    w, h, depth, kind, _, _, laced = struct.unpack(">IIBBBBB", header)
    _checked(w, h)
    palette = clear = None
    for name, part in extra:
        if name == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        else:
            clear = part
    parts = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(kind)
    if parts is None or depth not in (1, 2, 4, 8, 16):
        raise ValueError("unknown colour type")
    if laced > 1:
        raise ValueError("unknown interlacing")
    boxes = [(slice(y, None, dy), slice(x, None, dx)) for x, y, dx, dy in _PASSES] if laced else [(slice(None), slice(None))]
    whole = np.zeros((h, w), np.uint8)
    sizes = [whole[b].shape for b in boxes]
    bytes_of = lambda n: (n * parts * depth + 7) // 8
    total = sum((bytes_of(n) + 1) * m for m, n in sizes if n)
    raw = zlib.decompressobj().decompress(body, total)
    if len(raw) != total:
        raise ValueError("too few rows")
    v, at = np.zeros((h, w, parts), np.uint8), 0
    deep = np.zeros((h, w, parts), np.uint16)
    for box, (m, n) in zip(boxes, sizes, strict=True):
        if not m or not n:
            continue
        stride = bytes_of(n)
        rows = _unfiltered(raw[at : at + (stride + 1) * m], m, stride, max(1, parts * depth // 8))
        at += (stride + 1) * m
        if depth == 16:
            deep[box] = rows.view(">u2").reshape(m, n, parts)
            rows = rows[:, ::2]
        elif depth < 8:
            bits = np.unpackbits(rows, axis=1).reshape(m, -1, depth)[:, : n * parts]
            rows = (bits << np.arange(depth)[::-1]).sum(2).astype(np.uint8)
        v[box] = rows.reshape(m, n, parts)
    full = np.full((h, w), 255, np.uint8)
    if kind == 3:
        if palette is None or v.max(initial=0) >= len(palette):
            raise ValueError("a palette index is out of bounds")
        alpha = np.full(256, 255, np.uint8)
        if clear:
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)[:256]
        return _argb(np.dstack([palette[v[..., 0]], alpha[v[..., 0]]]))
    if clear and kind in (0, 2):  # one colour is transparent, by its full depth
        key = np.frombuffer(clear, ">u2")[: 1 if kind == 0 else 3]
        full = np.where(((deep if depth == 16 else v)[..., : len(key)] == key).all(2), 0, 255).astype(np.uint8)
    if kind == 0 and depth < 8:
        v = v * np.uint8(255 // ((1 << depth) - 1))
    grey = {0: [v[..., 0]] * 3 + [full], 4: [v[..., 0]] * 3 + [v[..., -1]]}
    planes = grey.get(kind) or [*np.moveaxis(v[..., :3], 2, 0), v[..., 3] if kind == 6 else full]
    return _argb(np.dstack(planes))


def bmp_encode(px: np.ndarray) -> bytes:
    """32 bits a pixel, rows from the bottom."""
    h, w = px.shape
    head = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + 4 * w * h, 0, 0, 54, 40, w, h, 1, 32, 0, 4 * w * h, 0, 0, 0, 0)
    return head + px[::-1].astype("<i4").tobytes()


def bmp_decode(data: bytes) -> np.ndarray:
    """24 or 32 bits a pixel without compression, rows from either end."""
    if len(data) < 54 or data[:2] != b"BM":
        raise ValueError("not a BMP")
    at, size, w, h, planes, bits, kind = struct.unpack("<IIiiHHI", data[10:34])
    down, h = h < 0, abs(h)
    _checked(w, h)
    if planes != 1 or bits not in (24, 32) or kind not in (0, 3) or size < 40:
        raise ValueError("unsupported kind of BMP")
    stride = (w * bits // 8 + 3) // 4 * 4
    if len(data) < at + stride * h:
        raise ValueError("too few rows")
    rows = np.frombuffer(data, np.uint8, stride * h, at).reshape(h, stride)[:, : w * bits // 8].reshape(h, w, bits // 8)
    alpha = rows[..., 3] if bits == 32 else np.full((h, w), 255, np.uint8)
    out = _argb(np.dstack([rows[..., 2], rows[..., 1], rows[..., 0], alpha]))
    return out if down else out[::-1]


def qoi_encode(px: np.ndarray) -> bytes:
    h, w = px.shape
    out = bytearray(struct.pack(">4sIIBB", b"qoif", w, h, 4, 0))
    seen = [(0, 0, 0, 0)] * 64
    last, run = (0, 0, 0, 255), 0
    flat = [tuple(p) for p in _rgba(px).reshape(-1, 4).tolist()]
    for k, p in enumerate(flat):
        if p == last:
            run += 1
            if run == 62 or k == len(flat) - 1:
                out.append(0xC0 | run - 1)
                run = 0
            continue
        if run:
            out.append(0xC0 | run - 1)
            run = 0
        r, g, b, a = p
        slot = (3 * r + 5 * g + 7 * b + 11 * a) % 64
        if seen[slot] == p:
            out.append(slot)
        else:
            seen[slot] = p
            dr, dg, db = ((x - y + 128 & 255) - 128 for x, y in zip(p[:3], last[:3], strict=True))
            if a != last[3]:
                out += bytes([0xFF, r, g, b, a])
            elif all(-2 <= d <= 1 for d in (dr, dg, db)):
                out.append(0x40 | dr + 2 << 4 | dg + 2 << 2 | db + 2)
            elif -32 <= dg <= 31 and -8 <= dr - dg <= 7 and -8 <= db - dg <= 7:
                out += bytes([0x80 | dg + 32, dr - dg + 8 << 4 | db - dg + 8])
            else:
                out += bytes([0xFE, r, g, b])
        last = p
    return bytes(out) + b"\0\0\0\0\0\0\0\1"


def qoi_decode(data: bytes) -> np.ndarray:
    if len(data) < 22 or data[:4] != b"qoif" or data[-8:] != b"\0\0\0\0\0\0\0\1":
        raise ValueError("not a QOI")
    w, h = struct.unpack(">II", data[4:12])
    _checked(w, h)
    seen = [(0, 0, 0, 0)] * 64
    p, at, end, out = (0, 0, 0, 255), 14, len(data) - 8, []
    while len(out) < w * h:
        if at >= end:
            raise ValueError("too few pixels")
        c = data[at]
        at += 1
        if c == 0xFE:
            p, at = (*data[at : at + 3], p[3]), at + 3
        elif c == 0xFF:
            p, at = tuple(data[at : at + 4]), at + 4
        elif c >> 6 == 0:
            p = seen[c]
        elif c >> 6 == 1:
            p = (p[0] + (c >> 4 & 3) - 2 & 255, p[1] + (c >> 2 & 3) - 2 & 255, p[2] + (c & 3) - 2 & 255, p[3])
        elif c >> 6 == 2:
            dg, more = (c & 63) - 32, data[at]
            at += 1
            p = (p[0] + dg + (more >> 4) - 8 & 255, p[1] + dg & 255, p[2] + dg + (more & 15) - 8 & 255, p[3])
        else:
            out += [p] * ((c & 63) + 1)
            continue
        seen[(3 * p[0] + 5 * p[1] + 7 * p[2] + 11 * p[3]) % 64] = p
        out.append(p)
    if len(out) != w * h or at != end:
        raise ValueError("more pixels than the header says")
    return _argb(np.array(out, np.uint8).reshape(h, w, 4))


ENCODERS: dict[str, Callable[[np.ndarray], bytes]] = {"png": png_encode, "png-interlaced": png_encode_interlaced, "bmp": bmp_encode, "qoi": qoi_encode}
DECODERS: dict[str, Callable[[bytes], np.ndarray]] = {"png": png_decode, "png-interlaced": png_decode, "bmp": bmp_decode, "qoi": qoi_decode}


def encoded(frames: DataFrame, kind: str) -> DataFrame:
    """(frame_id, content): a file for each raster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True)
            files = [ENCODERS[kind](np.array(px, np.int32).reshape(h, w)) for w, h, px in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], ["frame_id", "content"])

    base = frames.select("frame_id", "w", "h", "pixels")
    return base.mapInArrow(run, f"frame_id {base.schema['frame_id'].dataType.simpleString()}, content binary")


def decoded(files: DataFrame, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """(id, format, w, h, pixels, error) of each file, the format by its first
    bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for data in batch.column(1).to_pylist():
                kind = sniffed(data or b"")
                try:
                    if kind not in DECODERS:
                        raise ValueError(f"no decoder for {kind or 'this file'}")
                    px = DECODERS[kind](data)
                    rows.append((kind, px.shape[1], px.shape[0], px.ravel().tolist(), None))
                except (ValueError, zlib.error, struct.error, IndexError) as e:
                    rows.append((kind, None, None, None, str(e)))
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], [id_col, "format", "w", "h", "pixels", "error"])

    base = files.select(F.col(id_col), F.col(content_col))
    kind = base.schema[id_col].dataType.simpleString()
    return base.mapInArrow(run, f"{id_col} {kind}, format string, w int, h int, pixels array<int>, error string")
