"""More named queries with their SQL: schemes, names, effects, palettes as text,
vectors, curves and components across tiles. They join those of `catalogue`."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour as C
from ..functions import harmony, names
from ..operators import effects, measures, seams, shapes, vector
from ..sources import codecs, palettes
from ..sources import frames as S
from . import sql as Q
from .catalogue import _PLACED, _SAME_GRID, A, B, G, R, _components, _lab, add, as_pixels, frames, on_frames

_TALLIES = Q.PX + f", t AS (SELECT frame_id, argb, count(*) AS cnt FROM px WHERE {A} > 0 GROUP BY ALL)"
_SHADES = Q.PX + f", t AS (SELECT DISTINCT argb FROM px WHERE {A} > 0)"


def shades(s: SparkSession, d: str) -> DataFrame:
    """The visible colours of all rasters."""
    return measures.visible(S.pixels(frames(s, d))).select("argb").distinct()


# names
_CSS = "(VALUES " + ", ".join(f"({k}, '{n}', {c})" for k, n, c in names.NAMED) + ") n(k, name, colour)"
_MEAN = f"(({R} + {Q.r('colour')}) / 2.0::DOUBLE)"
_NAMING = f"sqrt((2.0::DOUBLE + {_MEAN} / 256) * ({R} - {Q.r('colour')}) * ({R} - {Q.r('colour')}) + 4.0::DOUBLE * ({G} - {Q.g('colour')}) * ({G} - {Q.g('colour')}) + (2.0::DOUBLE + (255 - {_MEAN}) / 256) * ({B} - {Q.b('colour')}) * ({B} - {Q.b('colour')}))"
on_frames(
    "nearest_names",
    lambda fr: vector.named_colours(fr).withColumn("distance", F.round("distance", 6)),
    _TALLIES + f", k AS (SELECT argb, name, d, row_number() OVER (PARTITION BY argb ORDER BY d, k) AS rn FROM (SELECT argb, name, k, {_NAMING} AS d FROM (SELECT DISTINCT argb FROM t), {_CSS})) SELECT frame_id, argb, name, round(d, 6) AS distance, cnt FROM t JOIN k USING (argb) WHERE rn = 1",
)
add("exact_names", lambda s, d: shades(s, d).select("argb", F.array_join(names.exact(F.col("argb")), ",").alias("names")), _SHADES + f" SELECT argb, coalesce(string_agg(name, ',' ORDER BY k), '') AS names FROM t LEFT JOIN {_CSS} ON colour = argb GROUP BY argb")

# schemes
_STEPS = 5
def _from_lab(table: str) -> str:
    """SQL that turns table(argb, step, l, a, b) into colours."""
    root = lambda t: f"(CASE WHEN {t} * {t} * {t} > 0.008856::DOUBLE THEN {t} * {t} * {t} ELSE (116 * {t} - 16) / 903.3::DOUBLE END)"
    byte = lambda v: Q.clamp(f"CAST(trunc((CASE WHEN {v} <= 0.0031308::DOUBLE THEN {v} * 12.92::DOUBLE ELSE 1.055::DOUBLE * pow(greatest({v}, 0.0::DOUBLE), {1 / 2.4!r}::DOUBLE) - 0.055::DOUBLE END) * 255 + 0.5::DOUBLE) AS BIGINT)")
    rows = [("3.2404542", "-1.5371385", "-0.4985314"), ("-0.9692660", "1.8760108", "0.0415560"), ("0.0556434", "-0.2040259", "1.0572252")]
    light = ", ".join(f"x * {p}::DOUBLE + y * {q}::DOUBLE + z * {r}::DOUBLE AS c{k}" for k, (p, q, r) in enumerate(rows))
    return f""", f1 AS (SELECT argb, step, (l + 16) / 116 AS fy, (l + 16) / 116 + a / 500 AS fx, (l + 16) / 116 - b / 200 AS fz FROM {table}),
 f2 AS (SELECT argb, step, {root('fx')} * 0.95047::DOUBLE AS x, {root('fy')} AS y, {root('fz')} * 1.08883::DOUBLE AS z FROM f1), f3 AS (SELECT argb, step, {light} FROM f2)
 SELECT argb, CAST(step AS INTEGER) AS step, {Q.pack('255', byte('c0'), byte('c1'), byte('c2'))} AS colour FROM f3"""


_L, _M, _N = _lab("argb")
_STEP = f"(SELECT unnest(range(0, {_STEPS})) AS step)"
_LABS = _SHADES + f", lb AS (SELECT argb, step, {_L} AS l, {_M} AS a, {_N} AS b FROM t, {_STEP})"
_TO = [f"({e})" for e in _lab("(-1)")]
_T = f"(step / {_STEPS - 1}.0::DOUBLE)"
_GRADIENT = _LABS + f", g AS (SELECT argb, step, l + ({_TO[0]} - l) * {_T} AS l, a + ({_TO[1]} - a) * {_T} AS a, b + ({_TO[2]} - b) * {_T} AS b FROM lb)" + _from_lab("g")
_MONOCHROMATIC = _LABS + f", g AS (SELECT argb, step, 100.0::DOUBLE * step / {_STEPS - 1} AS l, a, b FROM lb)" + _from_lab("g")


def _each_shade(name: str, f, sql: str | None = None) -> None:
    add(name, lambda s, d: shades(s, d).select("argb", F.posexplode(f(F.col("argb"))).alias("step", "colour")), sql)


_each_shade("harmony_gradient", lambda c: harmony.gradient(c, F.lit(C.WHITE), _STEPS), _GRADIENT)
_each_shade("harmony_monochromatic", lambda c: harmony.monochromatic(c, _STEPS), _MONOCHROMATIC)
_each_shade("harmony_ramp", lambda c: harmony.luminance_ramp(c, _STEPS))
_each_shade("harmony_analogous", harmony.analogous)
for _name in harmony.SCHEMES:
    _each_shade(f"harmony_{_name}", lambda c, k=_name: harmony.scheme(c, k))

# effects
_COS, _SIN = repr(math.cos(math.radians(30))) + "::DOUBLE", repr(math.sin(math.radians(30))) + "::DOUBLE"
_DX, _DY = "(o.x + 0.5::DOUBLE - 5.5)", "(o.y + 0.5::DOUBLE - 5.5)"
as_pixels("rotate_nearest", lambda fr: effects.rotated(fr, 30), Q.moved(f"CAST(floor({_DX} * {_COS} + {_DY} * {_SIN} + 4) AS INTEGER)", f"CAST(floor(-{_DX} * {_SIN} + {_DY} * {_COS} + 4) AS INTEGER)", "11", "11"))
as_pixels("silhouette", lambda fr: effects.silhouette(fr, 0x123456), Q.mapped(f"CASE WHEN {A} = 0 THEN argb ELSE {Q.pack(A, '18', '52', '86')} END"))
as_pixels("mirror_half", effects.mirrored, Q.moved("least(o.x, 7 - o.x)", "o.y"))
as_pixels("scanlines", effects.scanlines, Q.mapped(f"CASE WHEN y % 2 = 1 AND {A} >= 128 THEN {Q.over(str(0x30000000), 'argb', '{s}')} ELSE argb END"))
as_pixels(
    "vignette",
    effects.vignette,
    Q.PX
    + f""", v AS (SELECT *, {Q.clamp("CAST(trunc(0.5::DOUBLE * (1 - cos(least(1.0::DOUBLE, sqrt((x - 3.5::DOUBLE) * (x - 3.5::DOUBLE) + (y - 3.5::DOUBLE) * (y - 3.5::DOUBLE)) / sqrt(24.5::DOUBLE)) * 1.5707963267948966::DOUBLE)) * 255 + 0.5::DOUBLE) AS BIGINT)")} AS sa FROM px)
 SELECT frame_id, x, y, CAST(CASE WHEN {A} < 128 OR sa = 0 THEN argb ELSE {Q.over('0', 'argb', '{s}', 'sa')} END AS INTEGER) AS argb FROM v""",
)
_MASK, _LINE = -5592406, -65281
_PA = Q.a("p.argb")
as_pixels("selective_outline", lambda fr: effects.outlined_where(fr, _MASK, _LINE), Q.around(f"CAST(CASE WHEN {_PA} < 128 AND count(n.x) FILTER (n.argb = {_MASK}) > 0 THEN {_LINE} ELSE p.argb END AS INTEGER) AS argb"))
as_pixels("selective_outline_inner", lambda fr: effects.outlined_where(fr, _MASK, _LINE, inner=True), Q.around(f"CAST(CASE WHEN p.argb = {_MASK} AND count(n.x) FILTER ({Q.a('n.argb')} >= 128) < 8 THEN {_LINE} ELSE p.argb END AS INTEGER) AS argb"))
_FOUR = [("u", 0, -1), ("d", 0, 1), ("l", -1, 0), ("r", 1, 0)]
_VOTES = {n: " + ".join(f"CAST({n} = {m} AS INTEGER)" for m, _, _ in _FOUR) for n, _, _ in _FOUR}
as_pixels(
    "stray_pixels",
    effects.without_strays,
    Q.PX
    + ", v AS (SELECT p.frame_id, p.x, p.y, p.argb, "
    + ", ".join(f"coalesce({n}.argb, 0) AS {n}" for n, _, _ in _FOUR)
    + " FROM px p "
    + " ".join(f"LEFT JOIN px {n} ON {n}.frame_id = p.frame_id AND {n}.x = p.x + ({dx}) AND {n}.y = p.y + ({dy})" for n, dx, dy in _FOUR)
    + "), c AS (SELECT *, "
    + ", ".join(f"{e} AS n{n}" for n, e in _VOTES.items())
    + f" FROM v) SELECT frame_id, x, y, CASE WHEN {A} < 128 OR argb IN (u, d, l, r) THEN argb WHEN nu >= nd AND nu >= nl AND nu >= nr THEN u WHEN nd >= nl AND nd >= nr THEN d WHEN nl >= nr THEN l ELSE r END AS argb FROM c",
)
as_pixels("drop_faint_half", effects.without_faint, Q.mapped(f"CASE WHEN {A} < 128 THEN 0 ELSE argb END"))
_SQUARE = "o.x BETWEEN 1 AND 5 AND o.y BETWEEN 2 AND 6"
as_pixels("rotate_selection", lambda fr: effects.selection_turned(fr, 1, 2, 5), _SAME_GRID.format(value="p.argb", x=f"CASE WHEN {_SQUARE} THEN o.y - 1 ELSE o.x END", y=f"CASE WHEN {_SQUARE} THEN 7 - o.x ELSE o.y END"))


def _swing(turns: str, amplitude: int) -> str:
    return f"CAST(round(CAST(sin({turns} * 6.283185307179586::DOUBLE) * {amplitude} AS FLOAT)) AS INTEGER)"


as_pixels("float_effect", effects.floated, _PLACED + f" SELECT o.frame_id, o.x, o.y, coalesce(p.argb, 0) AS argb FROM px o JOIN pl USING (frame_id) LEFT JOIN px p ON p.frame_id = o.frame_id AND p.x = o.x AND p.y = o.y - {_swing('(place / 8.0::DOUBLE)', 1)}")
as_pixels("ripple_effect", lambda fr: effects.rippled(fr, 2), _PLACED + f" SELECT o.frame_id, o.x, o.y, coalesce(p.argb, 0) AS argb FROM px o JOIN pl USING (frame_id) LEFT JOIN px p ON p.frame_id = o.frame_id AND p.y = o.y AND p.x = o.x - {_swing('((place + o.y) / 4.0::DOUBLE)', 2)}")
_TIMES = "(SELECT unnest(range(0, {n})) AS k) s"
on_frames(
    "orbit_effect",
    lambda fr: S.pixels(effects.orbited(fr).withColumn("frame_id", F.col("frame_id") * 8 + F.col("step"))),
    Q.PX + f"SELECT o.frame_id * 8 + s.k AS frame_id, o.x, o.y, coalesce(p.argb, 0) AS argb FROM px o CROSS JOIN {_TIMES.format(n=8)} LEFT JOIN px p ON p.frame_id = o.frame_id AND p.x = o.x - {_swing('(s.k / 8.0::DOUBLE + 0.25::DOUBLE)', 2)} AND p.y = o.y - {_swing('(s.k / 8.0::DOUBLE)', 2)}",
)
on_frames("blink_effect", lambda fr: S.pixels(effects.blinked(fr).withColumn("frame_id", F.col("frame_id") * 2 + F.col("step"))), Q.PX + f"SELECT frame_id * 2 + s.k AS frame_id, x, y, CASE WHEN s.k = 0 THEN argb ELSE 0 END AS argb FROM px, {_TIMES.format(n=2)}")


# palettes as text
def _palettes(s: SparkSession, d: str) -> DataFrame:
    """The visible colours of each tag's rasters."""
    px = frames(s, d).select("tag", F.explode("pixels").alias("argb")).where(C.alpha(F.col("argb")) > 0).distinct()
    return px.groupBy(F.col("tag").alias("palette_id")).agg(F.array_sort(F.collect_list("argb")).alias("colours"))


_TEXTS = {"jasc": palettes.to_jasc, "gpl": lambda c: palettes.to_gpl(c, F.lit("tag")), "hex": palettes.to_hex}
_OWN = Q.PX + f", t AS (SELECT DISTINCT tag, argb FROM px WHERE {A} > 0)"
_TRIPLE = f"{R} || ' ' || {G} || ' ' || {B}"
_CRLF, _LF, _TAB = "chr(13) || chr(10)", "chr(10)", "chr(9)"
add(
    "palette_texts",
    lambda s, d: _palettes(s, d).select("palette_id", *[f(F.col("colours")).alias(k) for k, f in _TEXTS.items()]),
    _OWN
    + f""" SELECT tag AS palette_id, 'JASC-PAL' || {_CRLF} || '0100' || {_CRLF} || count(*) || {_CRLF} || string_agg({_TRIPLE} || {_CRLF}, '' ORDER BY argb) AS jasc,
 'GIMP Palette' || {_LF} || 'Name: tag' || {_LF} || 'Columns: ' || least(count(*), 8) || {_LF} || '#' || {_LF} || {_LF} || string_agg({_TRIPLE} || {_TAB} || {Q.hex_colour('argb')} || {_LF}, '' ORDER BY argb) AS gpl,
 string_agg({Q.hex_colour('argb')}, {_LF} ORDER BY argb) AS hex FROM t GROUP BY tag""",
)


def _read_back(s: SparkSession, d: str) -> DataFrame:
    texts = F.array(*[F.struct((F.col("palette_id") * 3 + k).alias("palette_id"), f(F.col("colours")).alias("text")) for k, f in enumerate(_TEXTS.values())])
    return palettes.read(_palettes(s, d).select(F.explode(texts).alias("t")).select("t.*"))


add("palette_read", _read_back, _OWN + f" SELECT CAST(tag * 3 + s.k AS INTEGER) AS palette_id, CAST(row_number() OVER (PARTITION BY tag, s.k ORDER BY argb) - 1 AS INTEGER) AS idx, argb FROM t, {_TIMES.format(n=3)}")


def _sniffed(s: SparkSession, d: str) -> DataFrame:
    found = None
    for kind in codecs.ENCODERS:
        own = codecs.encoded(frames(s, d), kind).select("frame_id", F.lit(kind).alias("made"), palettes.sniffed(F.col("content")).alias("found"))
        found = own if found is None else found.union(own)
    return found


add("sniff", _sniffed, f"SELECT vec_id AS frame_id, k AS made, k AS found FROM embeddings, (SELECT unnest({list(codecs.ENCODERS)}) AS k)")

# vectors
on_frames(
    "svg_runs",
    vector.svg,
    Q.PX
    + f""", f AS (SELECT *, CASE WHEN argb IS DISTINCT FROM lag(argb) OVER w THEN 1 ELSE 0 END AS fresh FROM px WINDOW w AS (PARTITION BY frame_id, y ORDER BY x)), n AS (SELECT *, sum(fresh) OVER (PARTITION BY frame_id, y ORDER BY x) AS run FROM f),
 r AS (SELECT frame_id, argb, y, min(x) AS x, count(*) AS len FROM n WHERE {A} > 0 GROUP BY frame_id, argb, y, run),
 p AS (SELECT frame_id, min(y * 8 + x) AS place, '  <path fill="#' || printf('%06X', CAST(argb AS BIGINT) & 16777215) || '" d="' || string_agg('M' || x || ' ' || y || 'h' || len || 'v1h-' || len || 'z', '' ORDER BY y, x) || '"/>' || chr(10) AS t FROM r GROUP BY frame_id, argb),
 g AS (SELECT frame_id, string_agg(t, '' ORDER BY place) AS t FROM p GROUP BY frame_id)
 SELECT vec_id AS frame_id, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<svg xmlns="http://www.w3.org/2000/svg" width="8" height="8" viewBox="0 0 8 8" shape-rendering="crispEdges">' || chr(10) || coalesce(t, '') || '</svg>' || chr(10) AS svg FROM embeddings LEFT JOIN g ON g.frame_id = vec_id""",
)
_HUE = "(CASE WHEN degrees(atan2(b, a)) < 0 THEN degrees(atan2(b, a)) + 360 ELSE degrees(atan2(b, a)) END)"
on_frames(
    "image_analysis",
    lambda fr: vector.analysed(fr).withColumn("brightness", F.round("brightness", 5)),
    Q.PX
    + f""", q AS (SELECT frame_id, argb, {A} AS al, {_L} AS l, {_M} AS a, {_N} AS b FROM px), c AS (SELECT *, sqrt(a * a + b * b) AS ch FROM q),
 s AS (SELECT frame_id, count(DISTINCT argb & 16777215) FILTER (al >= 128) AS n, max(al <> 255) AS has_alpha, coalesce(avg(l) FILTER (al >= 128), 0) AS l, coalesce(avg(ch) FILTER (al >= 128), 0) AS ch,
 count(*) FILTER (al >= 128 AND ch >= 6 AND {_HUE} >= 200 AND {_HUE} < 310) / greatest(1, count(*) FILTER (al >= 128)) AS blue, count(*) FILTER (al >= 128 AND ch >= 6 AND {_HUE} >= 50 AND {_HUE} < 95) / greatest(1, count(*) FILTER (al >= 128)) AS orange FROM c GROUP BY frame_id),
 k AS (SELECT *, CASE WHEN ch < 12 THEN 'gameboy' WHEN blue > 0.5 THEN 'kimi' WHEN orange > 0.35 THEN 'clawd' WHEN ch > 30 AND n >= 12 THEN 'pico-8' ELSE 'endesga-32' END AS palette FROM s)
 SELECT frame_id, 16 AS width, 16 AS height, CAST(CASE WHEN n <= 16 THEN n WHEN palette = 'endesga-32' THEN 32 ELSE 16 END AS INTEGER) AS colour_count, palette, round(l / 100, 5) AS brightness, has_alpha FROM k""",
)


# curves and polygons
def _curves(s: SparkSession, d: str) -> DataFrame:
    own = S.table(s, d, "part").select(F.col("p_partkey").alias("frame_id"), F.lit(0).cast("long").alias("ord"), F.col("p_size").alias("x0"), F.lit(3).alias("y0"), F.lit(20).alias("x1"), (F.col("p_partkey") % 40).cast("int").alias("y1"), F.lit(45).alias("x2"), F.col("p_size").alias("y2"), F.lit(-1).alias("argb"))
    return shapes.curves(own).select("frame_id", "x", "y")


_U = "(1 - k / 32.0::DOUBLE)"
_AT = "CAST(floor({u} * {u} * {p} + 2.0::DOUBLE * {u} * (k / 32.0::DOUBLE) * {q} + (k / 32.0::DOUBLE) * (k / 32.0::DOUBLE) * {r} + 0.5::DOUBLE) AS INTEGER)"
add("bezier_points", _curves, f"SELECT DISTINCT p_partkey AS frame_id, {_AT.format(u=_U, p='p_size', q=20, r=45)} AS x, {_AT.format(u=_U, p=3, q='CAST(p_partkey % 40 AS INTEGER)', r='p_size')} AS y FROM part, {_TIMES.format(n=33)}")


def _polygons(s: SparkSession, d: str) -> DataFrame:
    own = S.table(s, d, "part").select(F.col("p_partkey").alias("frame_id"), F.lit(0).cast("long").alias("ord"), F.when(F.col("p_partkey") % 2 == 0, "polygon").otherwise("star").alias("kind"), F.lit(60).alias("a"), F.lit(60).alias("b"), F.col("p_size").alias("c"), (3 + F.col("p_partkey") % 9).cast("int").alias("d"), F.lit(-1).alias("argb"))
    return shapes.points(own)


add("polygon_points", _polygons)

# components across tiles
on_frames("components_tiled", lambda fr: seams.components(seams.tiled(S.pixels(fr), 4), 4), _components("true") + "SELECT frame_id, count(*) AS area, CAST(min(x) AS INTEGER) AS x, CAST(min(y) AS INTEGER) AS y, CAST(max(x) - min(x) + 1 AS INTEGER) AS width, CAST(max(y) - min(y) + 1 AS INTEGER) AS height FROM lab GROUP BY frame_id, head")
