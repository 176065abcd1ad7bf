"""Named queries of chained stencils, palettes, shapes and measures, with their
SQL. They join those of `catalogue`."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour as C
from ..functions import easing, harmony
from ..operators import describe, filters, measures, pairs, raster, shapes, timeline
from ..sources import frames as S
from ..sources import generate, text
from . import sql as Q
from .catalogue import _EASE_STEPS, _GRID, PALETTE, SQL, A, B, G, R, _lab, add, as_pixels, frames, on_frames, on_pairs
from .further import _GRADIENT, _OWN, _STEPS, _palettes, shades
from .projects import _ENTRIES, _LAB, _SHADES

# chains of stencils
_ON = f"count(n.x) FILTER ({Q.a('n.argb')} > 0)"
_ON4 = f"count(n.x) FILTER ({Q.a('n.argb')} > 0 AND (n.x = p.x OR n.y = p.y))"
_SEEN = Q.a("p.argb") + " > 0"
_SQUARE = "(n.y - p.y) * 3 + (n.x - p.x)"
_CROSS = "CASE WHEN n.x < p.x THEN 0 WHEN n.y < p.y THEN 1 WHEN n.x > p.x THEN 2 ELSE 3 END"
_RULES = {
    "erode": f"CASE WHEN {_SEEN} AND {_ON} = 8 THEN p.argb ELSE 0 END",
    "erode4": f"CASE WHEN {_SEEN} AND {_ON4} = 4 THEN p.argb ELSE 0 END",
    "dilate": f"CASE WHEN {_SEEN} THEN p.argb ELSE coalesce(arg_min(n.argb, {_SQUARE}) FILTER ({Q.a('n.argb')} > 0), 0) END",
    "dilate4": f"CASE WHEN {_SEEN} THEN p.argb ELSE coalesce(arg_min(n.argb, {_CROSS}) FILTER ({Q.a('n.argb')} > 0 AND (n.x = p.x OR n.y = p.y)), 0) END",
    "lonely": f"CASE WHEN {_SEEN} AND {_ON} = 0 THEN 0 ELSE p.argb END",
}


def _chain(*steps: str) -> str:
    out, before = Q.PX, "px"
    for k, step in enumerate(steps):
        out += f", s{k} AS MATERIALIZED (SELECT p.frame_id, p.x, p.y, CAST({_RULES[step]} AS INTEGER) AS argb FROM {before} p LEFT JOIN {before} n ON n.frame_id = p.frame_id AND abs(n.x - p.x) <= 1 AND abs(n.y - p.y) <= 1 AND (n.x <> p.x OR n.y <> p.y) GROUP BY p.frame_id, p.x, p.y, p.argb)"
        before = f"s{k}"
    return out + f" SELECT frame_id, x, y, argb FROM {before}"


SQL["open"] = _chain("erode", "dilate")
SQL["close"] = _chain("dilate", "erode")
SQL["cleanup"] = _chain("lonely", "dilate", "erode", "erode4", "dilate4")
as_pixels("shrink_region", lambda fr: raster.shrunk(fr, 2), _chain("erode4", "erode4"))
as_pixels("erode_square5", lambda fr: raster.erode(fr, raster.SQUARE5), Q.PX + f"SELECT p.frame_id, p.x, p.y, CASE WHEN {_SEEN} AND {_ON} = 24 THEN p.argb ELSE 0 END AS argb FROM px p LEFT JOIN px n ON n.frame_id = p.frame_id AND abs(n.x - p.x) <= 2 AND abs(n.y - p.y) <= 2 AND (n.x <> p.x OR n.y <> p.y) GROUP BY p.frame_id, p.x, p.y, p.argb")


# the nearest palette colour
def _snapped(moved: str) -> str:
    """Pixels with the palette colour nearest to the colour `moved`."""
    d = "(l - el) * (l - el) + (a - ea) * (a - ea) + (b - eb) * (b - eb)"
    colours = f"(SELECT unnest(range(0, {len(PALETTE)})) AS idx, unnest({PALETTE}) AS entry)"
    return (
        Q.PX
        + f""", mv AS (SELECT frame_id, x, y, argb AS old, {moved} AS argb FROM px), sh AS (SELECT argb, {_LAB[0]} AS l, {_LAB[1]} AS a, {_LAB[2]} AS b FROM (SELECT DISTINCT argb FROM mv)), ne AS (SELECT argb, arg_min(idx, {d}) AS idx FROM sh, {_ENTRIES} GROUP BY argb)
 SELECT frame_id, x, y, CAST(CASE WHEN {Q.a('old')} < 128 THEN old ELSE {Q.pack(Q.a('old'), Q.r('entry'), Q.g('entry'), Q.b('entry'))} END AS INTEGER) AS argb FROM mv JOIN ne USING (argb) JOIN {colours} USING (idx)"""
    )


def _moved(amount: str) -> str:
    return Q.pack("255", *[Q.clamp(f"CAST(trunc({v} + {amount}) AS BIGINT)") for v in (R, G, B)])


SQL["palette_map"] = _snapped("argb")
SQL["ordered_dither_bayer4"] = _snapped(_moved(f"(({raster.BAYER[4]}[y % 4 * 4 + x % 4 + 1] + 0.5::DOUBLE) / 16 - 0.5::DOUBLE) * 63.75::DOUBLE"))
SQL["checker_dither"] = _snapped(_moved("CASE WHEN (x + y) % 2 = 0 THEN 32.0::DOUBLE ELSE -32.0::DOUBLE END"))
_SOFT = ", ".join(f"({dx}, {dy}, {v!r}::DOUBLE)" for dx, dy, v in filters.KERNELS["gaussian3"].taps())
SQL["gaussian3"] = (
    Q.PX
    + f""", c AS (SELECT p.frame_id, p.x, p.y, sum({Q.a('n.argb')} / 255.0::DOUBLE * t.k) AS sa, {', '.join(f"sum(CASE WHEN n.argb = 0 THEN 0 ELSE {f('n.argb')} * t.k * ({Q.a('n.argb')} / 255.0::DOUBLE) END) AS s{c}" for c, f in (('r', Q.r), ('g', Q.g), ('b', Q.b)))}
 FROM px p, (VALUES {_SOFT}) t(dx, dy, k), px n WHERE n.frame_id = p.frame_id AND n.x = least(7, greatest(0, p.x + t.dx)) AND n.y = least(7, greatest(0, p.y + t.dy)) GROUP BY ALL), o AS (SELECT *, {Q.clamp("CAST(trunc(sa * 255 + 0.5::DOUBLE) AS BIGINT)")} AS al FROM c)
 SELECT frame_id, x, y, CASE WHEN al = 0 THEN 0 ELSE {Q.pack('al', *[Q.clamp(f"CAST(trunc(s{c} / (CASE WHEN sa = 0 THEN 1.0::DOUBLE ELSE sa END) + 0.5::DOUBLE) AS BIGINT)") for c in 'rgb'])} END AS argb FROM o"""
)
add(
    "dithered_gradient",
    lambda s, d: shades(s, d).select("argb", F.posexplode(harmony.gradient(F.col("argb"), F.lit(C.WHITE), _STEPS)).alias("step", "c")).select("argb", "step", describe.nearest_entry(F.col("c"), PALETTE)["idx"].alias("idx")),
    _GRADIENT.replace(" SELECT argb, CAST(step AS INTEGER)", ", gr AS (SELECT argb AS of, CAST(step AS INTEGER)", 1)
    + f"), sh AS (SELECT argb, {_LAB[0]} AS l, {_LAB[1]} AS a, {_LAB[2]} AS b FROM (SELECT DISTINCT colour AS argb FROM gr)), ne AS (SELECT argb, arg_min(idx, sqrt((l - el) * (l - el) + (a - ea) * (a - ea) + (b - eb) * (b - eb))) AS idx FROM sh, {_ENTRIES} GROUP BY argb) SELECT of AS argb, step, CAST(idx AS INTEGER) AS idx FROM gr JOIN ne ON ne.argb = colour",
)

# pixels, grids, boxes
add("blank_grid", lambda s, d: S.pixels(generate.blank(s, 9, 6)), _GRID.format(w=9, h=6, rule="0"))
on_frames("pixel_get", lambda fr: raster.pixel_at(fr, 2, 6).union(raster.pixel_at(fr, 8, 0)), Q.PX + "SELECT frame_id, argb FROM px WHERE x = 2 AND y = 6 UNION ALL SELECT DISTINCT frame_id, 0 FROM px")
_TRIM = f", bb AS (SELECT frame_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM px WHERE {A} > 0 GROUP BY frame_id)"
as_pixels("trim_transparent", raster.trimmed, Q.PX + _TRIM + " SELECT px.frame_id, CAST(x - coalesce(x0, 0) AS INTEGER) AS x, CAST(y - coalesce(y0, 0) AS INTEGER) AS y, argb FROM px LEFT JOIN bb USING (frame_id) WHERE x0 IS NULL OR (x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1)")
as_pixels("epx2x", lambda fr: raster.scaled(fr, 2), Q.moved("o.x // 2", "o.y // 2", "16", "16"))
on_frames("bounce", lambda fr: S.pixels(timeline.bounced(fr).withColumn("frame_id", F.col("frame_id") * 7 + F.col("phase"))), Q.PX + "SELECT o.frame_id * 7 + s.k AS frame_id, o.x, o.y, coalesce(p.argb, 0) AS argb FROM px o CROSS JOIN (SELECT unnest(range(0, 7)) AS k, unnest([0, 2, 0, 1, 0, 1, 0]) AS drop) s LEFT JOIN px p ON p.frame_id = o.frame_id AND p.x = o.x AND p.y = o.y - s.drop")
on_frames("hist_cumulative", lambda fr: measures.cumulative(measures.histogram(fr)), Q.HIST + "SELECT frame_id, channel, CAST(bin AS INTEGER) AS bin, cnt, CAST(sum(cnt) OVER (PARTITION BY frame_id, channel ORDER BY bin) AS BIGINT) AS upto, CAST(sum(cnt) OVER (PARTITION BY frame_id, channel) AS BIGINT) AS total FROM hist")
_LA, _LB = [f"({e})" for e in _lab("a")], [f"({e})" for e in _lab("b")]


def _distances(p: DataFrame) -> DataFrame:
    """The mean distance in CIELAB of consecutive rasters."""
    off = harmony.distance(C.lab(F.col("a")), C.lab(F.col("b")))
    return pairs.pair_pixels(p).groupBy("frame_id").agg(F.round(F.avg(off), 4).alias("distance"))


on_pairs("lab_distance", _distances, Q.PAIRS + f"SELECT frame_id, round(avg(sqrt({' + '.join(f'({p} - {q}) * ({p} - {q})' for p, q in zip(_LA, _LB, strict=True))})), 4) AS distance FROM pr GROUP BY frame_id")
_RATIO = f"((greatest({Q.luminance('argb')}, {Q.luminance('(-8355712)')}) + 0.05::DOUBLE) / (least({Q.luminance('argb')}, {Q.luminance('(-8355712)')}) + 0.05::DOUBLE))"
add(
    "contrast_conformance",
    lambda s, d: shades(s, d).select("argb", *[F.coalesce(C.conformance(F.col("argb"), F.lit(-8355712), large), F.lit("fails")).alias(n) for n, large in (("normal", False), ("large", True))]),
    _SHADES + f" SELECT argb, CASE WHEN {_RATIO} >= 7 THEN 'AAA' WHEN {_RATIO} >= 4.5 THEN 'AA' ELSE 'fails' END AS normal, CASE WHEN {_RATIO} >= 4.5 THEN 'AAA' WHEN {_RATIO} >= 3 THEN 'AA' ELSE 'fails' END AS large FROM t",
)
add("luminance_order", lambda s, d: _palettes(s, d).select("palette_id", F.posexplode(harmony.by_lightness(F.col("colours"))).alias("place", "argb")), _OWN + f" SELECT tag AS palette_id, CAST(row_number() OVER (PARTITION BY tag ORDER BY {_LAB[0]}, argb) - 1 AS INTEGER) AS place, argb FROM t")


# palettes
def _edited(s: SparkSession, d: str) -> DataFrame:
    """A colour more, a colour less, and one by place."""
    c = F.col("colours")
    return _palettes(s, d).select("palette_id", F.array_join(harmony.with_colour(c, F.lit(1)), ",").alias("more"), F.array_join(harmony.without_place(c, 1), ",").alias("fewer"), F.get(c, F.lit(2)).alias("third"))


add("palette_edits", _edited, _OWN + ", li AS (SELECT tag AS palette_id, list(argb ORDER BY argb) AS c FROM t GROUP BY tag) SELECT palette_id, array_to_string(list_append(c, 1), ',') AS more, array_to_string(CASE WHEN len(c) > 1 THEN c[1:1] || c[3:] ELSE c END, ',') AS fewer, c[3] AS third FROM li")

# curves of motion
_ELASTIC = f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, pow(2.0::DOUBLE, -10 * u) * sin((u * 10 - 0.75::DOUBLE) * {2 * math.pi / 3!r}::DOUBLE) + 1))"
add("easing_elastic", lambda s, d: s.range(21).select(F.col("id").cast("int").alias("step"), F.round(easing.eased(F.col("id") / 20.0, "elastic_out"), 6).alias("elastic_out")), f"SELECT step, round({_ELASTIC}, 6) AS elastic_out FROM ({_EASE_STEPS})")
add("easing_samples", lambda s, d: s.range(1).select(F.posexplode(easing.sampled("ease_in", 9)).alias("k", "v")), "SELECT CAST(k AS INTEGER) AS k, k / 8.0::DOUBLE * (k / 8.0::DOUBLE) AS v FROM (SELECT unnest(range(0, 9)) AS k)")


# shapes
def _cubics(s: SparkSession, d: str) -> DataFrame:
    part, z = S.table(s, d, "part"), F.col("p_size")
    points = [F.lit(0), z, z % 17, F.lit(20), (F.col("p_partkey") % 40).cast("int"), F.lit(45), F.lit(60), z]
    return shapes.cubic(part.select(F.col("p_partkey").alias("shape"), *[p.alias(f"{a}{i}") for p, (i, a) in zip(points, [(i, a) for i in range(4) for a in "xy"], strict=True)]))


_W = ["(1 - u) * (1 - u) * (1 - u)", "3.0::DOUBLE * (1 - u) * (1 - u) * u", "3.0::DOUBLE * (1 - u) * u * u", "u * u * u"]


def _cubic_sql(*p: str) -> str:
    return "CAST(floor(" + " + ".join(f"{w} * ({v})" for w, v in zip(_W, p, strict=True)) + " + 0.5::DOUBLE) AS INTEGER)"


add("cubic_points", _cubics, f"SELECT DISTINCT p_partkey AS shape, {_cubic_sql('0', 'p_size % 17', 'CAST(p_partkey % 40 AS INTEGER)', '60')} AS x, {_cubic_sql('p_size', '20', '45', 'p_size')} AS y FROM part, (SELECT k / 48.0::DOUBLE AS u FROM (SELECT unnest(range(0, 49)) AS k))")


def _corners(s: SparkSession, d: str) -> DataFrame:
    part = S.dealt(S.table(s, d, "part").select(F.col("p_partkey").alias("shape"), F.col("p_size").alias("z")))
    k = (F.col("shape") % 13).cast("int")
    corners = F.array(*[F.struct(F.lit(i).alias("ord"), x.cast("int").alias("x"), y.cast("int").alias("y")) for i, (x, y) in enumerate(((F.lit(2), k - 4), (F.col("z"), F.lit(3)), (F.lit(30), F.col("z")), (k, F.lit(25)), (F.lit(12), F.lit(9))))])
    return part.select("shape", F.explode(corners).alias("c")).select("shape", "c.*")


_CORNERS = "co AS (SELECT p_partkey AS shape, i AS ord, CAST(CASE i WHEN 0 THEN 2 WHEN 1 THEN p_size WHEN 2 THEN 30 WHEN 3 THEN p_partkey % 13 ELSE 12 END AS INTEGER) AS x, CAST(CASE i WHEN 0 THEN p_partkey % 13 - 4 WHEN 1 THEN 3 WHEN 2 THEN p_size WHEN 3 THEN 25 ELSE 9 END AS INTEGER) AS y FROM part, (SELECT unnest(range(0, 5)) AS i))"
add(
    "polygon_fill",
    lambda s, d: shapes.polygons_filled(_corners(s, d), ["shape"], 40, 32),
    f"""WITH {_CORNERS}, ed AS (SELECT a.shape, a.ord, CASE WHEN a.y < b.y THEN a.x ELSE b.x END AS xa, least(a.y, b.y) AS ya, CASE WHEN a.y < b.y THEN b.x ELSE a.x END AS xb, greatest(a.y, b.y) AS yb FROM co a JOIN co b ON a.shape = b.shape AND b.ord = (a.ord + 1) % 5 WHERE a.y <> b.y),
 cr AS (SELECT shape, r AS y, xa + (r + 0.5::DOUBLE - ya) * ((xb - xa) / CAST(yb - ya AS DOUBLE)) AS c, row_number() OVER (PARTITION BY shape, r ORDER BY xa + (r + 0.5::DOUBLE - ya) * ((xb - xa) / CAST(yb - ya AS DOUBLE)), ord) AS rn FROM ed, (SELECT unnest(range(0, 32)) AS r) WHERE r >= ya AND r < yb),
 sp AS (SELECT p.shape, p.y, ceil(p.c - 0.5::DOUBLE) AS a, ceil(q.c - 0.5::DOUBLE) - 1 AS b FROM cr p JOIN cr q ON p.shape = q.shape AND p.y = q.y AND q.rn = p.rn + 1 WHERE p.rn % 2 = 1)
 SELECT shape, CAST(v AS INTEGER) AS x, CAST(y AS INTEGER) AS y FROM sp, (SELECT unnest(range(0, 40)) AS v) WHERE v >= a AND v <= b""",
)
add("span_fill", lambda s, d: shapes.span_filled(_corners(s, d), ["shape"]), f"WITH {_CORNERS}, r AS (SELECT shape, y, min(x) AS a, max(x) AS b FROM co GROUP BY ALL) SELECT shape, CAST(v AS INTEGER) AS x, y FROM r, (SELECT unnest(range(0, 60)) AS v) WHERE v >= a AND v <= b")


# sketches
def _sketched(s: SparkSession, d: str) -> DataFrame:
    """Each raster written as a sketch of two signs and read again."""
    rows = S.pixels(frames(s, d)).groupBy("frame_id", "y").agg(F.sort_array(F.collect_list(F.struct("x", F.when(C.alpha(F.col("argb")) == 0, ".").when(C.red(F.col("argb")) > 100, "r").otherwise("k").alias("g")))).alias("r"))
    grid = rows.groupBy("frame_id").agg(F.sort_array(F.collect_list(F.struct("y", F.array_join("r.g", "").alias("t")))).alias("l"))
    return text.sketches(grid.select("frame_id", F.concat(F.lit("r=#ff0000\nk=#000000\n---\n"), F.array_join("l.t", "\n")).alias("text")), "frame_id")


add("sketch_read", _sketched, Q.PX + f"SELECT frame_id, x, y, CASE WHEN {R} > 100 THEN -65536 ELSE -16777216 END AS argb FROM px WHERE {A} > 0")
