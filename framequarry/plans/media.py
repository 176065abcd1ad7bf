"""Named queries of animation files, shared palettes and recipes, with their SQL.
They join those of `catalogue`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour as C
from ..functions import library
from ..operators import project, raster, shared
from ..sources import animations, codecs
from ..sources import sprites as sprites_io
from . import recipe
from . import sql as Q
from .catalogue import PALETTE, SQL, A, B, G, R, _lab, add, as_pixels, frames, on_frames


def clips(fr: DataFrame) -> DataFrame:
    """Eight rasters in the order of their keys as one animation."""
    key = F.col("frame_id")
    return fr.select(F.floor(key / 8).alias("anim_id"), (key % 8).cast("int").alias("place"), "w", "h", "pixels", (key % 50 * 10).cast("int").alias("delay"))


def _shown(found: DataFrame) -> DataFrame:
    flat = found.select("anim_id", "place", "delay", "error", "w", F.posexplode_outer("pixels").alias("i", "argb"))
    return flat.select("anim_id", "place", "delay", "error", (F.col("i") % F.col("w")).cast("int").alias("x"), F.floor(F.col("i") / F.col("w")).cast("int").alias("y"), "argb")


def _roundtrip(kind: str):
    return lambda fr: _shown(animations.decoded(animations.encoded(clips(fr), kind)))


_CLIP = Q.PX + "SELECT frame_id // 8 AS anim_id, CAST(row_number() OVER (PARTITION BY frame_id // 8, x, y ORDER BY frame_id) - 1 AS INTEGER) AS place, {delay} AS delay, CAST(NULL AS VARCHAR) AS error, x, y, argb FROM px"
on_frames("gif_roundtrip", _roundtrip("gif"), _CLIP.format(delay="CAST(greatest(2, frame_id % 50) * 10 AS INTEGER)"))
on_frames("apng_roundtrip", _roundtrip("apng"), _CLIP.format(delay="CAST(frame_id % 50 * 10 AS INTEGER)"))
on_frames(
    "gif_palette",
    lambda fr: animations.palettes(clips(fr)).select("anim_id", F.posexplode("colours").alias("slot", "rgb")),
    Q.PX
    + f""", c AS (SELECT frame_id // 8 AS anim_id, CAST(argb AS BIGINT) & 16777215 AS rgb, count(*) AS n FROM px WHERE {A} >= 128 GROUP BY ALL),
 b AS (SELECT anim_id, (rgb >> 18 & 63) * 2048 + (rgb >> 10 & 63) * 32 + (rgb >> 3 & 31) AS bin, sum(n) AS n, first(rgb ORDER BY n DESC, rgb) AS rgb FROM c GROUP BY ALL)
 SELECT anim_id, CAST(row_number() OVER (PARTITION BY anim_id ORDER BY n DESC, bin) - 1 AS INTEGER) AS slot, CAST(rgb AS INTEGER) AS rgb FROM b""",
)

#: Parts of a raster that are shown on it: two that stay, one that comes off, one that leaves a hole.
PATCHES = [(2, 2, 3, 3, 0, 0, 1), (4, 0, 4, 5, 1, 3, 3), (0, 5, 8, 2, 0, 0, 2), (1, 1, 2, 7, 6, 1, 1)]


def _patched_sql() -> str:
    """The raster of each place by laying the patches one by one."""
    out = [Q.PX + ", s0 AS MATERIALIZED (SELECT frame_id, x, y, argb FROM px)"]
    left = "s0"  # what a frame leaves behind
    shown = ["SELECT frame_id AS anim_id, 0 AS place, 20 AS delay, x, y, argb FROM s0"]
    for k, (x, y, w, h, fx, fy, disposal) in enumerate(PATCHES, 1):
        inside = f"c.x BETWEEN {x} AND {x + w - 1} AND c.y BETWEEN {y} AND {y + h - 1}"
        out.append(f"s{k} AS MATERIALIZED (SELECT c.frame_id, c.x, c.y, CASE WHEN {inside} AND {Q.a('o.argb')} > 0 THEN o.argb ELSE c.argb END AS argb FROM {left} c LEFT JOIN px o ON o.frame_id = c.frame_id AND o.x = c.x + {fx - x} AND o.y = c.y + {fy - y})")
        shown.append(f"SELECT frame_id, {k}, 50, x, y, argb FROM s{k}")
        if disposal == 2:
            out.append(f"h{k} AS MATERIALIZED (SELECT frame_id, x, y, CASE WHEN {inside} THEN 0 ELSE argb END AS argb FROM s{k} c)")
        left = {1: f"s{k}", 2: f"h{k}", 3: left}[disposal]
    return ", ".join(out) + " " + " UNION ALL ".join(shown)


on_frames("gif_disposal", lambda fr: _shown(animations.decoded(animations.patched(fr, PATCHES))).drop("error"), _patched_sql())
as_pixels("png_interlaced", lambda fr: codecs.decoded(codecs.encoded(fr, "png-interlaced"), "frame_id"), SQL["px_scan"])


# palettes of all rasters
def _centres(spark: SparkSession, folder: str) -> DataFrame:
    """Three of Lloyd's rounds from the fixed palette."""
    shades = shared.histogram(frames(spark, folder)).select(C.lab(F.col("rgb")).alias("lab"), "n")
    found = shared.lloyd(shades, [raster.lab_of(c) for c in PALETTE], 3, 0.0)
    rows = [(k, *[round(v, 5) + 0.0 for v in x]) for k, x in enumerate(found)]
    return spark.createDataFrame(rows, "k int, l double, a double, b double")


def _rounds(n: int) -> str:
    shade = _lab("rgb")
    out = Q.PX + f", h AS (SELECT CAST(argb AS BIGINT) & 16777215 AS rgb, count(*) AS n FROM px WHERE {A} >= 128 GROUP BY ALL), sh AS MATERIALIZED (SELECT n, {shade[0]} AS l, {shade[1]} AS a, {shade[2]} AS b FROM h)"
    out += ", c0 AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {x!r}::DOUBLE, {y!r}::DOUBLE, {z!r}::DOUBLE)" for k, (x, y, z) in enumerate(map(raster.lab_of, PALETTE))) + ") v(k, l, a, b))"
    for i in range(n):
        d = "(s.l - c.l) * (s.l - c.l) + (s.a - c.a) * (s.a - c.a) + (s.b - c.b) * (s.b - c.b)"
        out += f", m{i} AS (SELECT s.n, s.l, s.a, s.b, first(c.k ORDER BY {d}, c.k) AS k FROM sh s, c{i} c GROUP BY ALL)"
        out += f", c{i + 1} AS MATERIALIZED (SELECT row_number() OVER (ORDER BY k) - 1 AS k, sum(l * n) / sum(n) AS l, sum(a * n) / sum(n) AS a, sum(b * n) / sum(n) AS b FROM m{i} GROUP BY k)"
    return out + f" SELECT CAST(k AS INTEGER) AS k, round(l, 5) + 0.0 AS l, round(a, 5) + 0.0 AS a, round(b, 5) + 0.0 AS b FROM c{n}"


add("kmeans_centres", _centres, _rounds(3))
on_frames("shade_histogram", shared.histogram, Q.PX + f"SELECT CAST(CAST(argb AS BIGINT) & 16777215 AS INTEGER) AS rgb, count(*) AS n FROM px WHERE {A} >= 128 GROUP BY ALL")
for _name in ("mediancut", "octree", "kmeans"):
    as_pixels(f"shared_{_name}", lambda fr, name=_name: shared.quantised(fr, 12, name))


def _named(palette: list[int]) -> str:
    """Pixels with the nearest colour of a palette."""
    entries = ", ".join(f"({k}, {c & 0xFFFFFF}, {x!r}::DOUBLE, {y!r}::DOUBLE, {z!r}::DOUBLE)" for k, (c, (x, y, z)) in enumerate((c, raster.lab_of(c)) for c in palette))
    shade = _lab("argb")
    return (
        Q.PX
        + f""", sh AS (SELECT argb, {shade[0]} AS l, {shade[1]} AS a, {shade[2]} AS b FROM (SELECT DISTINCT argb FROM px)),
 ne AS (SELECT argb, first(q ORDER BY (l - el) * (l - el) + (a - ea) * (a - ea) + (b - eb) * (b - eb), k) AS q FROM sh, (VALUES {entries}) e(k, q, el, ea, eb) GROUP BY argb)
 SELECT frame_id, x, y, CAST(CASE WHEN {A} < 128 THEN argb ELSE {Q.pack(A, Q.r('q'), Q.g('q'), Q.b('q'))} END AS INTEGER) AS argb FROM px JOIN ne USING (argb)"""
    )


as_pixels("palette_named", lambda fr: recipe.run(fr, '{"steps": [{"type": "palette-map", "palette": "pico-8"}]}'), _named(library.PALETTES["pico-8"]))

# recipes
_POSTER = f"CASE WHEN {A} < 16 THEN 0 ELSE {Q.pack(A, *[f'({v} * 2 + 127) // 255 * 255 // 2' for v in (R, G, B)])} END"
SQL["recipe_run"] = (
    Q.PX
    + f""", s AS MATERIALIZED (SELECT frame_id, x, y, CAST({_POSTER} AS INTEGER) AS argb FROM px),
 o AS MATERIALIZED (SELECT p.frame_id, p.x, p.y, CASE WHEN {Q.a('p.argb')} = 0 AND count(n.x) > 0 THEN -65536 ELSE p.argb END AS argb FROM s p LEFT JOIN s n ON n.frame_id = p.frame_id AND abs(n.x - p.x) <= 1 AND abs(n.y - p.y) <= 1 AND {Q.a('n.argb')} > 0 GROUP BY p.frame_id, p.x, p.y, p.argb)
 SELECT frame_id, CAST(x * 2 + dx AS INTEGER) AS x, CAST(y * 2 + dy AS INTEGER) AS y, argb FROM o, (VALUES (0), (1)) a(dx), (VALUES (0), (1)) b(dy)"""
)
_TRIMMED = '{"name": "cut", "steps": [{"type": "posterize", "levels": 2}, {"type": "trim"}]}'
as_pixels(
    "recipe_trim",
    lambda fr: recipe.run(fr, _TRIMMED),
    Q.PX
    + f""", p3 AS (SELECT frame_id, x, y, CAST(CASE WHEN {A} = 0 THEN argb ELSE {Q.pack(A, *[f'({v} + 127) // 255 * 255' for v in (R, G, B)])} END AS INTEGER) AS argb FROM px),
 bb AS (SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM p3 WHERE {Q.a('argb')} > 0)
 SELECT frame_id, CAST(x - x0 AS INTEGER) AS x, CAST(y - y0 AS INTEGER) AS y, argb FROM p3, bb WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1""",
)


# sprite files
def sprites(fr: DataFrame) -> project.Projects:
    """Four rasters as a project of two layers; the upper one shows each second
    raster twice."""
    own = fr.select(F.floor(F.col("frame_id") / 4).alias("project_id"), (F.col("frame_id") % 4).cast("int").alias("place"), "pixels")
    ids = own.select("project_id").distinct()
    heads = ids.select("project_id", F.concat(F.lit("sprite "), "project_id").alias("name"), F.lit(8).alias("w"), F.lit(8).alias("h"), F.lit(12).alias("fps"), F.lit(0).alias("active_frame"), F.lit(0).alias("active_layer"))
    layers = ids.select("project_id", F.explode(F.array(*[F.struct(F.lit(k).alias("layer_id"), F.lit(k).alias("place"), F.lit(n).alias("name"), F.lit(o).alias("opacity"), F.lit(k == 0).alias("visible"), F.lit(False).alias("locked")) for k, n, o in ((0, "base", 1.0), (1, "top", 0.4))])).alias("v")).select("project_id", "v.*")
    frames_ = own.select("project_id", F.col("place").alias("frame_id"), "place", (F.col("place") * 10 + 40).alias("duration_ms"))
    base = own.select("project_id", F.col("place").alias("frame_id"), F.lit(0).alias("layer_id"), "pixels")
    twice = own.where("place % 2 = 0").select("project_id", F.explode(F.array("place", F.col("place") + 1)).alias("frame_id"), F.lit(1).alias("layer_id"), "pixels")
    cels = base.union(twice.join(frames_.select("project_id", "frame_id"), ["project_id", "frame_id"], "left_semi").select(base.columns))
    tags = ids.select("project_id", F.lit(0).alias("place"), F.lit("walk é").alias("name"), F.lit(0).alias("start_frame"), F.lit(1).alias("end_frame"))
    return project.Projects(heads, layers, frames_, cels, tags)


def _reread(fr: DataFrame) -> sprites_io.Imported:
    return sprites_io.imported(sprites_io.aseprite(sprites(fr)).withColumn("name", F.concat(F.lit("sprite "), "project_id")))


def _cels(p: project.Projects) -> DataFrame:
    flat = p.cels.select("project_id", "frame_id", "layer_id", F.posexplode("pixels").alias("i", "argb"))
    return flat.select("project_id", "frame_id", "layer_id", (F.col("i") % 8).cast("int").alias("x"), F.floor(F.col("i") / 8).cast("int").alias("y"), "argb")


def _described(found: sprites_io.Imported) -> DataFrame:
    """Heads, layers, frames and tags as texts."""
    p = found.projects
    parts = [
        p.heads.select("project_id", F.concat_ws("|", F.lit("head"), "name", "w", "h", "fps", "active_layer").alias("line")),
        p.layers.select("project_id", F.concat_ws("|", F.lit("layer"), "layer_id", "place", "name", F.round(F.col("opacity") * 1000).cast("int"), "visible").alias("line")),
        p.frames.select("project_id", F.concat_ws("|", F.lit("frame"), "frame_id", "place", "duration_ms").alias("line")),
        p.tags.select("project_id", F.concat_ws("|", F.lit("tag"), "place", "name", "start_frame", "end_frame").alias("line")),
        found.errors.select("project_id", F.concat_ws("|", F.lit("error"), "error").alias("line")),
    ]
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3]).union(parts[4])


_SPRITE = Q.PX + ", s AS (SELECT DISTINCT frame_id // 4 AS project_id, CAST(frame_id % 4 AS INTEGER) AS place FROM px)"
on_frames(
    "sprite_cels",
    lambda fr: _cels(_reread(fr).projects),
    _SPRITE
    + """ SELECT frame_id // 4 AS project_id, CAST(frame_id % 4 AS INTEGER) AS frame_id, 0 AS layer_id, x, y, argb FROM px
 UNION ALL SELECT project_id, s.place, 1, x, y, argb FROM px JOIN s ON s.project_id = px.frame_id // 4 AND s.place // 2 * 2 = px.frame_id % 4""",
)
on_frames(
    "sprite_relations",
    lambda fr: _described(_reread(fr)),
    _SPRITE
    + """, p AS (SELECT DISTINCT project_id FROM s) SELECT project_id, 'head|sprite ' || project_id || '|8|8|' || 24 || '|1' AS line FROM p
 UNION ALL SELECT project_id, unnest(['layer|0|0|base|1000|true', 'layer|1|1|top|400|false', 'tag|0|walk é|0|1']) FROM p
 UNION ALL SELECT project_id, 'frame|' || place || '|' || place || '|' || (place * 10 + 40) FROM s""",
)


def _pictures(fr: DataFrame) -> sprites_io.Imported:
    """Rasters as files of three formats by their key, and texts that are none."""
    kinds = ["png", "qoi", "bmp"]
    files = [codecs.encoded(fr.where(F.col("frame_id") % 3 == k), kind) for k, kind in enumerate(kinds)]
    all_ = files[0].union(files[1]).union(files[2])
    broken = all_.select(-F.col("frame_id") - 1, F.substring("content", 1, 5))
    return sprites_io.imported(all_.union(broken).select(F.col("frame_id").alias("project_id"), F.lit("").alias("name"), "content"))


on_frames(
    "picture_palettes",
    lambda fr: _pictures(fr).palettes,
    Q.PX
    + f""", c AS (SELECT frame_id, argb, min(y * 8 + x) AS met FROM px WHERE {A} >= 128 GROUP BY ALL), n AS (SELECT DISTINCT frame_id FROM px),
 g AS (SELECT frame_id, k, 65793 * k - 16777216 AS argb FROM n, (SELECT unnest(range(0, 256)) AS k) WHERE frame_id NOT IN (SELECT frame_id FROM c))
 SELECT frame_id AS project_id, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY met) - 1 AS INTEGER) AS idx, argb FROM c UNION ALL SELECT frame_id, CAST(k AS INTEGER), CAST(argb AS INTEGER) FROM g""",
)
on_frames("picture_cels", lambda fr: _cels(_pictures(fr).projects), Q.PX + "SELECT frame_id AS project_id, 0 AS frame_id, 0 AS layer_id, x, y, argb FROM px")
on_frames(
    "picture_errors",
    lambda fr: _pictures(fr).errors.select("project_id", F.col("error").isNotNull().alias("failed")),
    Q.PX + "SELECT DISTINCT -frame_id - 1 AS project_id, true AS failed FROM px",
)
