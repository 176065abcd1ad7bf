"""Named queries of effects, shears, halvings, textures and cellular noise, and
SQL for schemes and filters of the other modules. They join those of `catalogue`."""

from __future__ import annotations

import math
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour as C
from ..operators import motion, shapes
from ..sources import frames as S
from ..sources import noise, palettes
from . import sql as Q
from .catalogue import PALETTE, SQL, A, B, G, R, _lab, add, as_pixels, on_frames, per_pixel
from .further import _LABS, _SHADES, _from_lab, shades


# content stretched within its box
def _phased(fr: DataFrame, of: int) -> DataFrame:
    return S.pixels(fr.withColumn("frame_id", F.col("frame_id") * of + F.col("phase")))


def _half_up(v: str) -> str:
    return f"CAST(trunc(CAST({v} AS FLOAT) + 0.5::FLOAT) AS INTEGER)"


def _from(v: str, start: str, span: str, old: str, old_span: str) -> str:
    return f"({old} + CASE WHEN {span} <= 1 THEN ({old_span} - 1) // 2 ELSE {_half_up(f'(CAST({v} - {start} AS FLOAT) / CAST({span} - 1 AS FLOAT)) * CAST({old_span} - 1 AS FLOAT)')} END)"


def _rescaled(of: int, sizes: list[tuple[str, str]], grounded: bool) -> str:
    """Phase 0: the raster; phase k: its box brought to sizes[k - 1]."""
    cases = ["CASE k " + " ".join(f"WHEN {k} THEN {s[i]}" for k, s in enumerate(sizes, 1)) + " END" for i in (0, 1)]
    top = "y1 - th + 1" if grounded else "y0 + CAST(trunc((bh - th) / 2.0::DOUBLE) AS INTEGER)"
    return (
        Q.PX
        + f""", bx AS (SELECT frame_id, min(x) AS x0, min(y) AS y0, max(y) AS y1, max(x) - min(x) + 1 AS bw, max(y) - min(y) + 1 AS bh FROM px WHERE {A} > 0 GROUP BY ALL),
 tg AS (SELECT *, greatest(1, {cases[0]}) AS tw, greatest(1, {cases[1]}) AS th FROM bx, (SELECT unnest(range(1, {of})) AS k)), pl AS (SELECT *, x0 + CAST(trunc((bw - tw) / 2.0::DOUBLE) AS INTEGER) AS tx, {top} AS ty FROM tg),
 ot AS (SELECT o.frame_id, p.k, o.x, o.y, o.argb, p.tw IS NULL AS bare, {_from('o.x', 'tx', 'tw', 'x0', 'bw')} AS sx, {_from('o.y', 'ty', 'th', 'y0', 'bh')} AS sy, o.x >= tx AND o.x < tx + tw AND o.y >= ty AND o.y < ty + th AS inside FROM px o LEFT JOIN pl p USING (frame_id))
 SELECT frame_id * {of} AS frame_id, x, y, argb FROM px
 UNION ALL SELECT ot.frame_id * {of} + k, ot.x, ot.y, CASE WHEN inside THEN p.argb ELSE 0 END FROM ot LEFT JOIN px p ON p.frame_id = ot.frame_id AND p.x = sx AND p.y = sy WHERE NOT bare
 UNION ALL SELECT ot.frame_id * {of} + j, x, y, argb FROM ot, (SELECT unnest(range(1, {of})) AS j) WHERE bare"""
    )


on_frames("squash", lambda fr: _phased(motion.squashed(fr), 2), _rescaled(2, [("bw * 2", _half_up("bh / 2.0::FLOAT"))], True))
on_frames("stretch", lambda fr: _phased(motion.squashed(fr, 2, 1), 2), _rescaled(2, [(_half_up("bw / 2.0::FLOAT"), "bh * 2")], True))
on_frames("pulse", lambda fr: _phased(motion.pulsed(fr), 3), _rescaled(3, [("bw + 2", "bh + 2"), ("bw - 2", "bh - 2")], False))
on_frames(
    "glow",
    lambda fr: _phased(motion.glowing(fr, 0xFFD040), 4),
    Q.PX
    + f""", tc AS (SELECT p.frame_id, p.x, p.y, p.argb, count(n.x) FILTER ({Q.a('n.argb')} > 0) AS t FROM px p LEFT JOIN px n ON n.frame_id = p.frame_id AND abs(n.x - p.x) + abs(n.y - p.y) = 1 GROUP BY ALL)
 SELECT frame_id * 4 + k AS frame_id, x, y, CASE WHEN {A} = 0 AND t > 0 AND lv > 0 THEN {Q.pack('lv', '255', '208', '64')} ELSE argb END AS argb FROM tc, (VALUES (0, 128), (1, 64), (2, 32), (3, 0)) s(k, lv)""",
)
_L, _M, _N = _lab("argb")
on_frames(
    "rainbow",
    lambda fr: S.pixels(motion.rainbow(fr)),
    Q.PX
    + f""", pl AS (SELECT frame_id, row_number() OVER (PARTITION BY tag ORDER BY frame_id) - 1 AS k, count(*) OVER (PARTITION BY tag) AS n FROM (SELECT DISTINCT frame_id, tag FROM px)),
 lb AS (SELECT frame_id * 64 + y * 8 + x AS key, argb AS own, {2 * math.pi!r}::DOUBLE * k / n AS th, {_L} AS l, {_M} AS a, {_N} AS b FROM px JOIN pl USING (frame_id) WHERE k > 0 AND {A} > 0),
 g AS (SELECT key AS argb, own AS step, l, a * cos(th) - b * sin(th) AS a, a * sin(th) + b * cos(th) AS b FROM lb), tu AS (SELECT * FROM ({_from_lab('g').replace(', f1 AS', 'WITH f1 AS', 1)}))
 SELECT frame_id, x, y, coalesce(tu.colour, px.argb) AS argb FROM px LEFT JOIN tu ON tu.argb = frame_id * 64 + y * 8 + x""",
)


# shears
def _sheared_sql(degrees: float, crop: bool) -> str:
    """The source of each pixel of the turned 8 x 8 raster, step by step back."""
    turns, rest = motion.quarters(degrees)
    k, s = -math.tan(math.radians(rest) / 2), math.sin(math.radians(rest))
    w = h = 8
    steps = []
    for axis, f in (("x", k), ("y", s), ("x", k)):
        far = ((h if axis == "x" else w) - 1) * f
        low, high = min(0, math.floor(far)), max(0, math.ceil(far))
        w, h = (w + high - low, h) if axis == "x" else (w, h + high - low)
        steps.append((axis, f, low))
    x, y = "o.x", "o.y"
    if crop:
        x, y, w, h = f"(o.x + {int((w - 8) / 2)})", f"(o.y + {int((h - 8) / 2)})", 8, 8
    for axis, f, low in reversed(steps):
        if axis == "x":
            x = f"({x} - CAST(floor({y} * ({f!r}::DOUBLE) + 0.5::DOUBLE) AS INTEGER) + ({low}))"
        else:
            y = f"({y} - CAST(floor({x} * ({f!r}::DOUBLE) + 0.5::DOUBLE) AS INTEGER) + ({low}))"
    x, y = {0: (x, y), 1: (y, f"7 - {x}"), 2: (f"7 - {x}", f"7 - {y}"), 3: (f"7 - {y}", x)}[turns]
    return Q.moved(x, y, str(w), str(h))


as_pixels("rotate_shears", lambda fr: motion.rotated_by_shears(fr, 30), _sheared_sql(30, False))
as_pixels("rotate_shears_cropped", lambda fr: motion.rotated_by_shears(fr, 200, crop=True), _sheared_sql(200, True))
as_pixels("shear_x", lambda fr: motion.sheared_x(fr, 0.5), Q.moved("o.x - CAST(floor(o.y * 0.5::DOUBLE + 0.5::DOUBLE) AS INTEGER)", "o.y", "12", "8"))
as_pixels("shear_y", lambda fr: motion.sheared_y(fr, -0.3), Q.moved("o.x", "o.y - CAST(floor(o.x * -0.3::DOUBLE + 0.5::DOUBLE) AS INTEGER) - 3", "8", "11"))


# halvings
def _half_of(name: str, of: str) -> str:
    p = [f"p{k}" for k in range(4)]
    sa = " + ".join(Q.a(q) + "::DOUBLE" for q in p)
    mean = lambda f: Q.clamp("CAST(trunc((" + " + ".join(f"{f(q)} * ({Q.a(q)} / 255.0::DOUBLE)" for q in p) + f") / ({sa}) * 255.0::DOUBLE) AS BIGINT)")
    al = Q.clamp(f"CAST(trunc(({sa}) / 4 + 0.5::DOUBLE) AS BIGINT)")
    corners = ", ".join(f"max(argb) FILTER (x % 2 = {k % 2} AND y % 2 = {k // 2}) AS p{k}" for k in range(4))
    return f""", {name} AS MATERIALIZED (SELECT frame_id, x, y, CAST(CASE WHEN {sa} <= 0 OR {al} = 0 THEN 0 ELSE {Q.pack(al, mean(Q.r), mean(Q.g), mean(Q.b))} END AS INTEGER) AS argb FROM (SELECT frame_id, x // 2 AS x, y // 2 AS y, {corners} FROM {of} GROUP BY ALL))"""


on_frames(
    "halved_chain",
    lambda fr: S.pixels(motion.halved_chain(fr).withColumn("frame_id", F.col("frame_id") * 10 + F.col("level"))),
    Q.PX + _half_of("m1", "px") + _half_of("m2", "m1") + _half_of("m3", "m2") + " SELECT frame_id * 10 AS frame_id, x, y, argb FROM px" + "".join(f" UNION ALL SELECT frame_id * 10 + {k}, x, y, argb FROM m{k}" for k in (1, 2, 3)),
)


# filters by area
def _weighted(taps: str, k: str) -> str:
    """Sums over (frame_id, x, y, o, p, k) in the order o, and the pixel they give."""
    total = lambda e: f"list_sum(list({e} ORDER BY o))"
    parts = ", ".join(f"{total(f'CASE WHEN p = 0 THEN 0.0::DOUBLE ELSE {f('p')} * (k * ({Q.a('p')} / 255.0::DOUBLE)) END')} AS s{c}" for c, f in (("r", Q.r), ("g", Q.g), ("b", Q.b)))
    return f"SELECT frame_id, x, y, {total(k)} AS sa, {parts} FROM ({taps}) GROUP BY ALL"


_NINE = ", ".join(f"({dx}, {dy}, {(dy + 1) * 3 + dx + 1})" for dy in (-1, 0, 1) for dx in (-1, 0, 1))
_BLURRED = f"SELECT p.frame_id, p.x, p.y, t.o, n.argb AS p, {1 / 9!r}::DOUBLE AS k FROM px p, (VALUES {_NINE}) t(dx, dy, o), px n WHERE n.frame_id = p.frame_id AND n.x = least(7, greatest(0, p.x + t.dx)) AND n.y = least(7, greatest(0, p.y + t.dy))"
SQL["box_blur"] = (
    Q.PX
    + f""", c AS ({_weighted(_BLURRED, f"{Q.a('p')} / 255.0::DOUBLE * k")}), o AS (SELECT *, {Q.clamp("CAST(trunc(sa * 255 + 0.5::DOUBLE) AS BIGINT)")} AS al FROM c)
 SELECT frame_id, x, y, CASE WHEN al = 0 THEN 0 ELSE {Q.pack('al', *[Q.clamp(f"CAST(trunc(s{c} / (CASE WHEN sa = 0 THEN 1.0::DOUBLE ELSE sa END) + 0.5::DOUBLE) AS BIGINT)") for c in 'rgb'])} END AS argb FROM o"""
)

# schemes
_STEP = "CAST(step AS INTEGER) AS step"
_DOWN, _UP = "CASE step WHEN 0 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END", "CASE step WHEN 3 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END"
SQL["harmony_ramp"] = (
    _LABS
    + f""", g AS (SELECT argb, step, CASE WHEN step < 2 THEN l * ({_DOWN}) ELSE l + (100.0::DOUBLE - l) * (1 - ({_UP})) END AS l, a * (CASE WHEN step < 2 THEN {_DOWN} ELSE {_UP} END) AS a, b * (CASE WHEN step < 2 THEN {_DOWN} ELSE {_UP} END) AS b FROM lb WHERE step <> 2)"""
    + _from_lab("g")
    + " UNION ALL SELECT argb, 2, argb FROM t"
)


def _coloured(table: str) -> str:
    """A query: all columns of table, which has l, a, b, with their colour."""
    root = lambda t: f"(CASE WHEN {t} * {t} * {t} > 0.008856::DOUBLE THEN {t} * {t} * {t} ELSE (116 * {t} - 16) / 903.3::DOUBLE END)"
    byte = lambda v: Q.clamp(f"CAST(trunc((CASE WHEN {v} <= 0.0031308::DOUBLE THEN {v} * 12.92::DOUBLE ELSE 1.055::DOUBLE * pow(greatest({v}, 0.0::DOUBLE), {1 / 2.4!r}::DOUBLE) - 0.055::DOUBLE END) * 255 + 0.5::DOUBLE) AS BIGINT)")
    rows = [("3.2404542", "-1.5371385", "-0.4985314"), ("-0.9692660", "1.8760108", "0.0415560"), ("0.0556434", "-0.2040259", "1.0572252")]
    light = ", ".join(f"vx * {p}::DOUBLE + vy * {q}::DOUBLE + vz * {r}::DOUBLE AS c{k}" for k, (p, q, r) in enumerate(rows))
    one = f"SELECT *, (l + 16) / 116 AS fy, (l + 16) / 116 + a / 500 AS fx, (l + 16) / 116 - b / 200 AS fz FROM {table}"
    two = f"SELECT * EXCLUDE (fx, fy, fz), {root('fx')} * 0.95047::DOUBLE AS vx, {root('fy')} AS vy, {root('fz')} * 1.08883::DOUBLE AS vz FROM ({one})"
    return f"SELECT * EXCLUDE (c0, c1, c2), {Q.pack('255', byte('c0'), byte('c1'), byte('c2'))} AS colour FROM (SELECT * EXCLUDE (vx, vy, vz), {light} FROM ({two}))"


def _turned(degrees: list[float]) -> str:
    """Each shade with its hue turned; chroma shrinks by bisection to what sRGB has."""
    rows = ", ".join(f"({k}, {math.cos(math.radians(d))!r}::DOUBLE, {math.sin(math.radians(d))!r}::DOUBLE)" for k, d in enumerate(degrees) if d % 360)
    own = "".join(f" UNION ALL SELECT argb, {k}, argb FROM t" for k, d in enumerate(degrees) if not d % 360)
    p, q, r = _lab("colour")
    fits = f"SELECT * EXCLUDE (cl, ca, cb), sqrt((l - cl) * (l - cl) + (a - ca) * (a - ca) + (b - cb) * (b - cb)) <= 1.0::DOUBLE AS fits FROM (SELECT *, {p} AS cl, {q} AS ca, {r} AS cb FROM ({{}}))"
    middle = "SELECT argb, step, l, a0 * mid AS a, b0 * mid AS b, a0, b0, kept, mid, k FROM (SELECT *, kept + pow(0.5::DOUBLE, k) AS mid FROM se WHERE k <= 24)"
    return (
        _SHADES
        + f""", lb AS (SELECT argb, {_L} AS l, {_M} AS m, {_N} AS n FROM t), g AS (SELECT argb, step, l, m * co - n * si AS a, m * si + n * co AS b FROM lb, (VALUES {rows}) d(step, co, si)),
 gf AS MATERIALIZED ({fits.format(_coloured('g'))}),
 se(argb, step, l, a0, b0, kept, k) AS (SELECT argb, step, l, a, b, 0.0::DOUBLE, 1 FROM gf WHERE NOT fits UNION ALL SELECT argb, step, l, a0, b0, CASE WHEN fits THEN mid ELSE kept END, k + 1 FROM ({fits.format(_coloured(f'({middle})'))})),
 en AS (SELECT argb, step, l, a0 * kept AS a, b0 * kept AS b FROM se WHERE k = 25)
 SELECT argb, {_STEP}, colour FROM gf WHERE fits UNION ALL SELECT argb, {_STEP}, colour FROM ({_coloured('en')}){own}"""
    )


SQL["harmony_analogous"] = _turned([-30, 0, 30])
SQL["harmony_complementary"] = _turned([0, 180])
SQL["harmony_triadic"] = _turned([0, 120, 240])
SQL["harmony_split_complementary"] = _turned([0, 150, 210])
SQL["harmony_tetradic"] = _turned([0, 90, 180, 270])


# ways of seeing, contrast
def _encoded(v: str) -> str:
    cut = f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {v}))"
    return Q.clamp(f"CAST(floor((CASE WHEN {cut} <= 0.0031308::DOUBLE THEN {cut} * 12.92::DOUBLE ELSE 1.055::DOUBLE * pow({cut}, {1 / 2.4!r}::DOUBLE) - 0.055::DOUBLE END) * 255 + 0.5::DOUBLE) AS BIGINT)")


def _through(m: list[float]) -> str:
    light = [Q.linear(v) for v in (R, G, B)]
    return Q.pack(A, *[_encoded("(" + " + ".join(f"({m[3 * row + k]!r}::DOUBLE) * {light[k]}" for k in range(3)) + ")") for row in range(3)])


for _kind, _m in C.VIENOT.items():
    per_pixel(f"cvd_{_kind}_plain", lambda p, k=_kind: C.simulated_plainly(p, k), _through(_m))
_GREY = "CAST(floor(0.2126::DOUBLE * {0} + 0.7152::DOUBLE * {1} + 0.0722::DOUBLE * {2}) AS BIGINT)".format(R, G, B)
_SEEN = [_through(C.MACHADO[k]) for k in ("protan", "deutan", "tritan")] + [Q.pack(A, _GREY, _GREY, _GREY)]
as_pixels(
    "seen_by_all",
    lambda fr: motion.seen_by_all(fr, 6, 4),
    Q.PX
    + f""", ce AS (SELECT i, i // 24 AS cell, i % 24 % 6 * 8 // 6 AS sx, i % 24 // 6 * 8 // 4 AS sy FROM (SELECT unnest(range(0, 120)) AS i))
 SELECT frame_id, CAST(i % 30 AS INTEGER) AS x, CAST(i // 30 AS INTEGER) AS y, CAST(CASE cell WHEN 0 THEN argb {' '.join(f'WHEN {k} THEN {e}' for k, e in enumerate(_SEEN, 1))} END AS INTEGER) AS argb FROM ce JOIN px ON px.x = sx AND px.y = sy""",
)
_ON = "(VALUES (-1), (-16777216), (-8355712)) w(other)"
_RATIO = "((greatest(la, lo_) + 0.05::DOUBLE) / (least(la, lo_) + 0.05::DOUBLE))"
_MIX = [f"(CASE WHEN lo_ < 0.5 THEN {e} + (1.0::DOUBLE - {e}) * mid ELSE {e} * (1.0::DOUBLE - mid) END)" for e in (Q.linear(v) for v in (R, G, B))]
add(
    "accessible_colours",
    lambda s, d: shades(s, d).select("argb", F.explode(F.array(F.lit(-1), F.lit(-16777216), F.lit(-8355712))).alias("other")).select("argb", "other", F.coalesce(C.accessible(F.col("argb"), F.col("other")), F.lit(0)).alias("colour")),
    _SHADES
    + f""", st AS (SELECT *, {_RATIO} >= 4.5::DOUBLE AS good FROM (SELECT argb, other, {Q.luminance('argb')} AS la, {Q.luminance('other')} AS lo_ FROM t, {_ON})),
 se(argb, other, lo_, lo, hi, best, k) AS (SELECT argb, other, lo_, 0.0::DOUBLE, 1.0::DOUBLE, CAST(NULL AS INTEGER), 0 FROM st WHERE NOT good
 UNION ALL SELECT argb, other, lo_, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END, CASE WHEN ok THEN cand ELSE best END, k + 1 FROM (SELECT *, {_RATIO} >= 4.5::DOUBLE AS ok FROM (SELECT *, {Q.luminance('cand')} AS la FROM (SELECT *, {Q.pack(A, *map(_encoded, _MIX))} AS cand FROM (SELECT *, (lo + hi) / 2 AS mid FROM se WHERE k < 24)))))
 SELECT argb, other, argb AS colour FROM st WHERE good UNION ALL SELECT argb, other, coalesce(best, CASE WHEN lo_ < 0.5 AND 1.05::DOUBLE / (lo_ + 0.05::DOUBLE) >= 4.5 THEN -1 WHEN lo_ >= 0.5 AND (lo_ + 0.05::DOUBLE) / 0.05::DOUBLE >= 4.5 THEN -16777216 END, 0) FROM se WHERE k = 24""",
)

# noise
_WRAP = "18446744073709551616::UHUGEINT"


def _big(v: int) -> str:
    return f"{v}::UHUGEINT"


def _layers(w: int, h: int, n: int, scale: str, octaves: int) -> str:
    """fb(k, x, y, v): layers of value noise of seeds 1 to n at (x, y) * scale."""
    lattice = f"""SELECT *, ((1 + k)::UHUGEINT + ix * {_big(0x9E3779B97F4A7C15)} + iy * {_big(0xC2B2AE3D27D4EB4F)}) % {_WRAP} AS h FROM (SELECT *, (floor(px)::INTEGER + c % 2)::UHUGEINT AS ix, (floor(py)::INTEGER + c // 2)::UHUGEINT AS iy FROM (
 SELECT k.v AS k, a.v AS x, b.v AS y, o.v AS o, c.v AS c, (a.v::FLOAT * {scale}::FLOAT) * (2 ** o.v)::FLOAT AS px, (b.v::FLOAT * {scale}::FLOAT) * (2 ** o.v)::FLOAT AS py
 FROM (SELECT unnest(range(0, {n})) AS v) k, (SELECT unnest(range(0, {w})) AS v) a, (SELECT unnest(range(0, {h})) AS v) b, (SELECT unnest(range(0, {octaves})) AS v) o, (SELECT unnest(range(0, 4)) AS v) c))"""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        lattice = f"SELECT * REPLACE (xor(h, h >> {_big(shift)}) * {_big(factor)} % {_WRAP} AS h) FROM ({lattice})"
    corner = lambda c: f"max(g) FILTER (c = {c})"
    smooth = lambda f: f"{f} * {f} * (3::FLOAT - 2::FLOAT * {f})"
    return f"""WITH la AS (SELECT *, (xor(h, h >> {_big(31)}) >> {_big(40)})::FLOAT / 16777216::FLOAT AS g FROM ({lattice})),
 co AS (SELECT k, x, y, o, px - floor(px) AS fx, py - floor(py) AS fy, {', '.join(f'{corner(c)} AS g{c}' for c in range(4))} FROM la GROUP BY ALL), sm AS (SELECT *, {smooth('fx')} AS sx, {smooth('fy')} AS sy FROM co),
 rw AS (SELECT k, x, y, o, g0 + (g1 - g0) * sx AS top, g2 + (g3 - g2) * sx AS low, sy FROM sm), va AS (SELECT k, x, y, o, top + (low - top) * sy AS v FROM rw),
 fb AS (SELECT k, x, y, ({' + '.join(f'max(v) FILTER (o = {o}) * {0.5**o!r}::FLOAT' for o in range(octaves))}) / {sum(0.5**o for o in range(octaves))!r}::FLOAT AS v FROM va GROUP BY ALL)"""


_DEALT = f"list_value({', '.join(map(str, PALETTE))})"
SQL["value_noise"] = _layers(24, 16, 3, "0.2", 1) + f" SELECT k AS frame_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, {_DEALT}[least({len(PALETTE)}, CAST(trunc(v * {len(PALETTE)}::FLOAT) AS INTEGER) + 1)] AS argb FROM fb"


def _texture(kind: str, scale: str, field: str) -> None:
    add(
        f"texture_{kind}",
        lambda s, d: S.pixels(noise.texture_frames(s, kind, 20, 12, PALETTE, 3)),
        _layers(20, 12, 3, scale, 4) + f" SELECT k AS frame_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, {_DEALT}[CAST(trunc(least(1::FLOAT, greatest(0::FLOAT, {field})) * {len(PALETTE) - 1}::FLOAT + 0.5::FLOAT) AS INTEGER) + 1] AS argb FROM fb",
    )


_NX, _NY = "((x::FLOAT - 9.5::FLOAT) / 9.5::FLOAT)", "((y::FLOAT - 5.5::FLOAT) / 5.5::FLOAT)"
_texture("clouds", "0.25", "v")
_texture("wood", "0.3", f"CAST(0.5::DOUBLE + 0.5::DOUBLE * sin({math.pi * 6!r}::DOUBLE * CAST(sqrt({_NX} * {_NX} + {_NY} * {_NY})::FLOAT + (v - 0.5::FLOAT) * 0.25::FLOAT AS DOUBLE)) AS FLOAT)")
_texture("stone", "0.35", "1::FLOAT - abs(2::FLOAT * v - 1::FLOAT)")
_texture("marble", "0.12", f"CAST(0.5::DOUBLE + 0.5::DOUBLE * sin({2 * math.pi * 5!r}::DOUBLE * x / 20 + CAST((v - 0.5::FLOAT) * 2::FLOAT AS DOUBLE) * 3) AS FLOAT)")


def _jittered(axis: int) -> str:
    fx, fy, mask, first, factor, second = map(int, noise._JITTER[axis])
    h = f"xor(xor(xor(bx * {_big(fx)} % {_WRAP}, yb * {_big(fy)} % {_WRAP}), k.v::UHUGEINT), {_big(mask)})"
    h = f"(SELECT xor(z, z >> {_big(first)}) * {_big(factor)} % {_WRAP} AS z FROM (SELECT {h} AS z))"
    return f"(SELECT least(0.9999999999::DOUBLE, (xor(z, z >> {_big(second)}) >> {_big(11)})::DOUBLE / {float(1 << 53)!r}::DOUBLE) FROM {h})"


_CELLS = ", ".join(f"({c}, {struct.unpack('<Q', struct.pack('<d', float(c)))[0]}::UHUGEINT)" for c in range(-1, 6))
_POINTS = f"""WITH ce(c, bits) AS (VALUES {_CELLS}), pt AS (SELECT k.v AS k, p.c AS cx, q.c AS cy, p.c + {_jittered(0)} AS qx, q.c + {_jittered(1)} AS qy FROM (SELECT unnest(range(1, 4)) AS v) k, (SELECT c, bits AS bx FROM ce) p, (SELECT c, bits AS yb FROM ce) q),
 sp AS (SELECT a.v AS x, b.v AS y, (a.v + 0.5::DOUBLE) / 6 AS ux, (b.v + 0.5::DOUBLE) / 6 AS uy FROM (SELECT unnest(range(0, 24)) AS v) a, (SELECT unnest(range(0, 18)) AS v) b),
 di AS (SELECT k, x, y, list(sqrt((qx - ux) * (qx - ux) + (qy - uy) * (qy - uy)) ORDER BY sqrt((qx - ux) * (qx - ux) + (qy - uy) * (qy - uy))) AS d FROM sp JOIN pt ON abs(cx - floor(ux)) <= 1 AND abs(cy - floor(uy)) <= 1 GROUP BY ALL)"""
for _feature, _rule in (("nearest", "d[1]"), ("second", "d[2]"), ("border", "d[2] - d[1]"), ("cell", "greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1 - d[1]))")):
    add(
        f"cellular_{_feature}",
        lambda s, d, f=_feature: S.pixels(noise.cellular_frames(s, 24, 18, 6.0, f, frames=3)),
        _POINTS + f", va AS (SELECT k, x, y, {_rule} AS v FROM di), gr AS (SELECT k, x, y, CAST(trunc(least(1.0::DOUBLE, v * (1 / max(v) OVER (PARTITION BY k))) * 255 + 0.5::DOUBLE) AS BIGINT) AS g FROM va) SELECT k - 1 AS frame_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, {Q.pack('255', 'g', 'g', 'g')} AS argb FROM gr",
    )


# compositing, fingerprints, holes, resampling: SQL for queries of the catalogue
_OPS = [int(np.float32(0.1 * (k + 1)) * np.float32(255)) if k != 4 else 0 for k in range(10)]
_ENDS = ", ".join(f"({k}, {op})" for k, op in enumerate(_OPS) if op)
SQL["composite"] = (
    Q.PX
    + f""", ce AS MATERIALIZED (SELECT f, place, x, y, s, {Q.a('s')} * op // 255 AS sa FROM (SELECT frame_id // 10 AS f, tag AS layer, x, y, arg_min(argb, frame_id) AS s FROM px GROUP BY ALL) JOIN (VALUES {_ENDS}) o(place, op) ON layer = place),
 st(f, x, y, place, d) AS (SELECT DISTINCT frame_id // 10, x, y, 0, 0 FROM px UNION ALL SELECT st.f, st.x, st.y, st.place + 1, CAST(CASE WHEN sa IS NULL OR sa = 0 THEN d ELSE {Q.over('s', 'd', '{s}', 'sa')} END AS INTEGER) FROM st LEFT JOIN ce ON ce.f = st.f AND ce.x = st.x AND ce.y = st.y AND ce.place = st.place WHERE st.place < 10)
 SELECT f AS frame_id, x, y, d AS argb FROM st WHERE place = 10"""
)
SQL["fingerprint"] = (
    Q.PX
    + f""", li AS (SELECT frame_id, list(CAST(CASE WHEN {A} = 0 THEN 0 ELSE CAST(argb AS BIGINT) & 4294967295 END AS UHUGEINT) ORDER BY y, x) AS v, count(*) FILTER ({A} > 0) AS visible FROM px GROUP BY ALL)
 SELECT frame_id, lower(lpad(hex(CAST(list_reduce(list_concat([{_big(0x9E3779B97F4A7C15)}], v, [8::UHUGEINT, 8::UHUGEINT, visible::UHUGEINT]), lambda h, e: xor(h, e) * {_big(0x100000001B3)} % {_WRAP}) AS UBIGINT)), 16, '0')) AS digest, CAST(visible AS INTEGER) AS visible FROM li"""
)


def _ring(k: int) -> str:
    """Holes that touch something visible take its commonest colour."""
    return f""", v{k} AS (SELECT p.frame_id, p.x, p.y, n.argb, count(*) AS c FROM f{k} p JOIN f{k} n ON n.frame_id = p.frame_id AND abs(n.x - p.x) + abs(n.y - p.y) = 1 WHERE p.hole AND {Q.a('n.argb')} > 0 GROUP BY ALL),
 b{k} AS (SELECT frame_id, x, y, arg_max(argb, (c, argb)) AS best FROM v{k} GROUP BY ALL), f{k + 1} AS MATERIALIZED (SELECT frame_id, x, y, coalesce(best, argb) AS argb, hole AND best IS NULL AS hole FROM f{k} LEFT JOIN b{k} USING (frame_id, x, y))"""


SQL["fill_holes"] = (
    Q.PX
    + f""", ou(frame_id, x, y) AS (SELECT frame_id, x, y FROM px WHERE {A} = 0 AND (x IN (0, 7) OR y IN (0, 7)) UNION SELECT n.frame_id, n.x, n.y FROM ou o JOIN px n ON n.frame_id = o.frame_id AND abs(n.x - o.x) + abs(n.y - o.y) = 1 AND {Q.a('n.argb')} = 0),
 f0 AS MATERIALIZED (SELECT px.frame_id, px.x, px.y, argb, {A} = 0 AND ou.x IS NULL AS hole FROM px LEFT JOIN ou USING (frame_id, x, y))"""
    + "".join(map(_ring, range(4)))
    + " SELECT frame_id, x, y, argb FROM f4"
)


def _covered(name: str, n: int) -> str:
    """Which of 8 cells each of n new ones covers, and how much of them."""
    step = f"{8 / n!r}::DOUBLE"
    return f"{name} AS (SELECT t.v AS t, c.v AS c, least((t.v + 1) * {step}, c.v + 1.0::DOUBLE) - greatest(t.v * {step}, c.v::DOUBLE) AS k FROM (SELECT unnest(range(0, {n})) AS v) t, (SELECT unnest(range(0, 8)) AS v) c WHERE least((t.v + 1) * {step}, c.v + 1.0::DOUBLE) - greatest(t.v * {step}, c.v::DOUBLE) > 0)"


_FOLD = "list_reduce(list_prepend(0.0::DOUBLE, list({e} ORDER BY y, x)), lambda p, q: p + q)"
_PARTS = ", ".join(f"{_FOLD.format(e=f'{v} * ({A} / 255.0::DOUBLE) * k')} AS s{c}" for c, v in (("r", R), ("g", G), ("b", B)))
_MEANS = [Q.clamp(f"CAST(trunc(s{c} / sa * 255.0::DOUBLE) AS BIGINT)") for c in "rgb"]
SQL["box_resample"] = (
    Q.PX
    + f""", {_covered('cx', 5)}, {_covered('cy', 3)}, tp AS (SELECT frame_id, cx.t AS tx, cy.t AS ty, x, y, argb, cx.k * cy.k AS k FROM px JOIN cx ON cx.c = x JOIN cy ON cy.c = y),
 su AS (SELECT frame_id, tx, ty, {_FOLD.format(e='k')} AS sw, {_FOLD.format(e=f'{A} * k')} AS sa, {_PARTS} FROM tp GROUP BY ALL), al AS (SELECT *, {Q.clamp('CAST(trunc(sa / sw + 0.5::DOUBLE) AS BIGINT)')} AS av FROM su)
 SELECT frame_id, CAST(tx AS INTEGER) AS x, CAST(ty AS INTEGER) AS y, CASE WHEN sa <= 0 OR av = 0 THEN 0 ELSE {Q.pack('av', *_MEANS)} END AS argb FROM al"""
)


# lines and what is made of them
def _lines(table: str, key: str) -> str:
    """ln(key, x, y): the points of the lines of table(key, x0, y0, x1, y1), by
    Bresenham's rule; negative ones dropped."""
    return f""", wk({key}, x, y, err, x1, y1, dx, dy, sx, sy) AS (SELECT {key}, x0, y0, abs(x1 - x0) - abs(y1 - y0), x1, y1, abs(x1 - x0), -abs(y1 - y0), CASE WHEN x0 < x1 THEN 1 ELSE -1 END, CASE WHEN y0 < y1 THEN 1 ELSE -1 END FROM {table}
 UNION ALL SELECT {key}, CASE WHEN 2 * err >= dy THEN x + sx ELSE x END, CASE WHEN 2 * err <= dx THEN y + sy ELSE y END, err + CASE WHEN 2 * err >= dy THEN dy ELSE 0 END + CASE WHEN 2 * err <= dx THEN dx ELSE 0 END, x1, y1, dx, dy, sx, sy FROM wk WHERE x <> x1 OR y <> y1),
 ln AS (SELECT DISTINCT {key}, x, y FROM wk WHERE x >= 0 AND y >= 0)"""


def _whole(v: str) -> str:
    return f"CAST(floor({v} + 0.5::DOUBLE) AS INTEGER)"


_SIDES = "CASE WHEN p_partkey % 2 = 0 THEN 3 + p_partkey % 9 ELSE 10 END"
_REACH = "CASE WHEN p_partkey % 2 = 0 OR k % 2 = 0 THEN p_size ELSE 3 + p_partkey % 9 END"
_TURN = f"{2 * math.pi!r}::DOUBLE * k / sides"
SQL["polygon_points"] = (
    f"""WITH RECURSIVE co AS (SELECT frame_id, k, sides, {_whole(f'(60 + reach * cos({_TURN}))')} AS x, {_whole(f'(60 + reach * sin({_TURN}))')} AS y FROM (SELECT p_partkey AS frame_id, k, {_SIDES} AS sides, {_REACH} AS reach FROM part, (SELECT unnest(range(0, 12)) AS k)) WHERE k < sides),
 sg AS (SELECT a.frame_id, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM co a JOIN co b ON b.frame_id = a.frame_id AND b.k = (a.k + 1) % a.sides)"""
    + _lines("sg", "frame_id")
    + " SELECT frame_id, 0 AS ord, x, y, -1 AS argb FROM ln"
)


def _shape(name: str, kind: str, columns: list[str], sql: str) -> None:
    """A shape for each part: its columns a to e as expressions over the part."""

    def made(s: SparkSession, d: str) -> DataFrame:
        own = [F.expr(f"CAST({e} AS INT)").alias(c) for c, e in zip("abcde", columns, strict=False)]
        table = S.table(s, d, "part").select(F.col("p_partkey").alias("frame_id"), F.lit(0).cast("long").alias("ord"), F.lit(kind).alias("kind"), *own, F.lit(-1).alias("argb"))
        return shapes.points(table).select("frame_id", "x", "y")

    add(name, made, sql)


_K = "p_partkey % 9"
_MOVE = "(t - (th - 1) // 2)"
_shape(
    "thick_lines",
    "thick_line",
    ["10", "p_partkey % 40", "p_size", "20", "1 + p_partkey % 9"],
    f"""WITH RECURSIVE pa AS (SELECT p_partkey AS frame_id, 10 AS a, CAST(p_partkey % 40 AS INTEGER) AS b, p_size AS c, 20 AS d, CAST(1 + {_K} AS INTEGER) AS th FROM part), of AS (SELECT *, sqrt(CAST((c - a) * (c - a) + (d - b) * (d - b) AS DOUBLE)) AS len FROM pa, (SELECT CAST(unnest(range(0, 9)) AS INTEGER) AS t) WHERE t < th),
 mv AS (SELECT *, CASE WHEN len = 0 THEN 0 ELSE {_whole(f'({_MOVE} * (b - d) / len)')} END AS mx, CASE WHEN len = 0 THEN 0 ELSE {_whole(f'({_MOVE} * (c - a) / len)')} END AS my FROM of), sg AS (SELECT frame_id, a + mx AS x0, b + my AS y0, c + mx AS x1, d + my AS y1 FROM mv WHERE len > 0
 UNION ALL SELECT frame_id, a - (th - 1) // 2, b + t - (th - 1) // 2, a - (th - 1) // 2 + th - 1, b + t - (th - 1) // 2 FROM mv WHERE len = 0)"""
    + _lines("sg", "frame_id")
    + " SELECT frame_id, x, y FROM ln",
)
_shape(
    "arcs",
    "arc",
    ["40", "30", "p_size", "p_partkey % 360", "p_partkey % 300 - 100"],
    f"""WITH RECURSIVE pa AS (SELECT p_partkey AS frame_id, p_size AS r, p_partkey % 360 AS st, p_partkey % 300 - 100 AS sw FROM part), ns AS (SELECT *, greatest(1, CAST(ceil(abs(sw) / least(4.0::DOUBLE, 57.29577951308232::DOUBLE / greatest(r, 1))) AS INTEGER)) AS n FROM pa WHERE sw <> 0),
 co AS (SELECT *, {_whole(f'(40 + r * cos((st + sw * k / n::DOUBLE) * ({math.pi!r}::DOUBLE / 180)))')} AS x, {_whole(f'(30 + r * sin((st + sw * k / n::DOUBLE) * ({math.pi!r}::DOUBLE / 180)))')} AS y FROM ns, (SELECT unnest(range(0, 400)) AS k) WHERE k <= n),
 sg AS (SELECT a.frame_id, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM co a JOIN co b ON b.frame_id = a.frame_id AND b.k = a.k + 1)"""
    + _lines("sg", "frame_id")
    + " SELECT frame_id, x, y FROM ln",
)
_ELLIPSE = """WITH RECURSIVE el AS (SELECT p_partkey AS frame_id, 5 AS x, 4 AS y, p_size AS w, CAST(2 + p_partkey % 31 AS INTEGER) AS h FROM part), r AS (SELECT *, CAST(w // 2 AS BIGINT) AS rx, CAST(h // 2 AS BIGINT) AS ry FROM el WHERE w > 1),
 wk(frame_id, cx, cy, rx, ry, i, j) AS (SELECT frame_id, x + rx, y + ry, rx, ry, 0::BIGINT, ry FROM r
 UNION ALL SELECT frame_id, cx, cy, rx, ry, CASE WHEN ry * ry * i < rx * rx * j THEN i + 1 WHEN ry * ry * (2 * i + 1) * (2 * i + 1) + 4 * rx * rx * (j - 1) * (j - 1) <= 4 * rx * rx * ry * ry THEN i + 1 ELSE i END,
 CASE WHEN ry * ry * i >= rx * rx * j THEN j - 1 WHEN 4 * ry * ry * (i + 1) * (i + 1) + rx * rx * (2 * j - 1) * (2 * j - 1) >= 4 * rx * rx * ry * ry THEN j - 1 ELSE j END FROM wk WHERE j > 0 OR ry * ry * i < rx * rx * j),
 ed AS (SELECT DISTINCT frame_id, cx + s.v * i AS x, cy + t.v * j AS y FROM wk, (VALUES (1), (-1)) s(v), (VALUES (1), (-1)) t(v) UNION SELECT frame_id, x, y + k FROM el, (SELECT unnest(range(0, 40)) AS k) WHERE w = 1 AND k < h)"""
_BOX = ["5", "4", "p_size", "2 + p_partkey % 31"]
_shape("ellipses", "ellipse", _BOX, _ELLIPSE + " SELECT frame_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM ed WHERE x >= 0 AND y >= 0")
_shape("ellipses_filled", "ellipse_filled", _BOX, _ELLIPSE + ", sp AS (SELECT frame_id, y, min(x) AS lo, max(x) AS hi FROM ed GROUP BY ALL) SELECT frame_id, CAST(v AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM sp, (SELECT unnest(range(0, 80)) AS v) WHERE v BETWEEN lo AND hi AND y >= 0")
_QUARTER = """, wk(r, i, j, e) AS (SELECT v, 0, v, 1 - v FROM (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS v) UNION ALL SELECT r, i + 1, CASE WHEN e < 0 THEN j ELSE j - 1 END, CASE WHEN e < 0 THEN e + 2 * i + 3 ELSE e + 2 * (i - j) + 5 END FROM wk WHERE i <= j),
 qu AS (SELECT r, i, j FROM wk WHERE i <= j UNION SELECT r, j, i FROM wk WHERE i <= j)"""
_shape(
    "rounded_rects",
    "rounded_rect",
    ["3", "2", "12 + p_size", "11 + p_partkey % 20", "1 + p_partkey % 5"],
    "WITH RECURSIVE pa AS (SELECT p_partkey AS frame_id, 3 AS x, 2 AS y, CAST(14 + p_size AS INTEGER) AS rt, CAST(12 + p_partkey % 20 AS INTEGER) AS lo, CAST(1 + p_partkey % 5 AS INTEGER) AS r FROM part)"
    + _QUARTER
    + """, al AS (SELECT frame_id, CAST(v AS INTEGER) AS px, q AS py FROM pa, (SELECT unnest(range(0, 90)) AS v), (SELECT unnest([0, 1]) AS z), LATERAL (SELECT CASE z WHEN 0 THEN y ELSE lo END AS q) WHERE v BETWEEN x + r AND rt - r
 UNION SELECT frame_id, CASE z WHEN 0 THEN x ELSE rt END, CAST(v AS INTEGER) FROM pa, (SELECT unnest(range(0, 90)) AS v), (SELECT unnest([0, 1]) AS z) WHERE v BETWEEN y + r + 1 AND lo - r - 1
 UNION SELECT frame_id, CASE z WHEN 0 THEN x + pa.r - i ELSE rt - pa.r + i END, CASE u WHEN 0 THEN y + pa.r - j ELSE lo - pa.r + j END FROM pa JOIN qu USING (r), (SELECT unnest([0, 1]) AS z), (SELECT unnest([0, 1]) AS u))
 SELECT frame_id, px AS x, py AS y FROM al""",
)


# temperatures and names of formats
_T = "(least(40000.0::DOUBLE, greatest(1000.0::DOUBLE, k)) / 100)"
_BODY = [
    f"CASE WHEN {_T} <= 66 THEN 255.0::DOUBLE ELSE 329.698727446::DOUBLE * pow({_T} - 60, -0.1332047592::DOUBLE) END",
    f"CASE WHEN {_T} <= 66 THEN 99.4708025861::DOUBLE * ln({_T}) - 161.1195681661::DOUBLE ELSE 288.1221695283::DOUBLE * pow({_T} - 60, -0.0755148492::DOUBLE) END",
    f"CASE WHEN {_T} >= 66 THEN 255.0::DOUBLE WHEN {_T} <= 19 THEN 0.0::DOUBLE ELSE 138.5177312231::DOUBLE * ln({_T} - 10) - 305.0447927307::DOUBLE END",
]
_BODY_COLOUR = Q.pack("255", *[f"trunc(least(255.0::DOUBLE, greatest(0.0::DOUBLE, {v})) + 0.5::DOUBLE)" for v in _BODY])
add("black_body", lambda s, d: s.range(420).select((F.col("id") * 100).alias("kelvin"), C.black_body(F.col("id") * 100.0).alias("colour")), f"SELECT kelvin, {_BODY_COLOUR} AS colour FROM (SELECT v * 100 AS kelvin, v * 100.0::DOUBLE AS k FROM (SELECT unnest(range(0, 420)) AS v))")
_NAMED = ", ".join(f"('{n}', {k!r}::DOUBLE)" for n, k in C.TEMPERATURES.items())
add(
    "temperature_presets",
    lambda s, d: s.createDataFrame([(n.upper(),) for n in [*C.TEMPERATURES, "moon"]], "name string").select("name", F.coalesce(C.preset_temperature(F.col("name")), F.lit(0)).alias("colour")),
    f"SELECT upper(name) AS name, {_BODY_COLOUR} AS colour FROM (VALUES {_NAMED}) n(name, k) UNION ALL SELECT 'MOON', 0",
)
_HEADS = {"png": "89504E470D0A1A0A", "gif": "474946383961", "qoi": "716F6966", "bmp": "424D", "ico": "00000100", "aseprite": "00000000E0A50100", "unknown": "4D5A"}
add(
    "format_names",
    lambda s, d: s.createDataFrame(list(_HEADS.items()), "made string, head string").select("made", palettes.format_name(palettes.sniffed(F.unhex("head"))).alias("name")),
    "SELECT made, name FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in palettes.FORMAT_NAMES.items()) + ") n(made, name)",
)
