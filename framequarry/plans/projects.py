"""Named queries over projects, selections, tile maps and descriptions, with
their SQL. They join those of `catalogue`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour as C
from ..operators import describe, log, measures, pairs, project, raster, selections, tilemap
from ..sources import frames as S
from . import catalogue
from . import sql as Q
from .catalogue import PALETTE, A, B, G, R, _components, _lab, add, as_pixels, frames, on_frames, on_pairs

# projects: ten rasters each, two layers (and an empty one) by five frames
_NAMES = [(0, 0, "base", 1.0, True, False), (1, 1, "ink", 0.5, True, False), (2, 2, "notes", 0.25, False, False)]
_TAGS = [(0, "idle", 0, 1), (1, "walk", 1, 3)]


def projects(s: SparkSession, d: str) -> project.Projects:
    fr = frames(s, d).select(F.floor(F.col("frame_id") / 10).alias("project_id"), (F.col("frame_id") % 10).cast("int").alias("k"), "w", "h", "pixels")
    ids = fr.select("project_id").distinct()
    number = F.col("project_id")
    heads = ids.select("project_id", F.concat(F.lit("project "), number.cast("string")).alias("name"), F.lit(8).alias("w"), F.lit(8).alias("h"), (number % 30 + 1).cast("int").alias("fps"), F.lit(0).alias("active_frame"), (number % 2).cast("int").alias("active_layer"))
    layers = ids.crossJoin(F.broadcast(s.createDataFrame(_NAMES, "layer_id int, place int, name string, opacity double, visible boolean, locked boolean")))
    place = C.idiv(F.col("k"), 2)
    flat = fr.select("project_id", place.alias("place"), (F.col("k") % 2).alias("layer_id"), "pixels")
    timed = flat.select("project_id", "place").distinct()
    own = timed.select("project_id", (F.col("place") + 100).alias("frame_id"), "place", F.when(F.col("place") % 2 == 1, F.col("place") * 40 + 40).alias("duration_ms"))
    tags = ids.crossJoin(F.broadcast(s.createDataFrame(_TAGS, "place int, name string, start_frame int, end_frame int")))
    return project.Projects(heads, layers, own, flat.select("project_id", (F.col("place") + 100).alias("frame_id"), "layer_id", "pixels"), tags)


_P = (
    Q.PX
    + f""", ids AS (SELECT DISTINCT CAST(vec_id // 10 AS BIGINT) AS project_id FROM embeddings),
 heads AS (SELECT project_id, 'project ' || project_id AS name, 8 AS w, 8 AS h, CAST(project_id % 30 + 1 AS INTEGER) AS fps, 0 AS active_frame, CAST(project_id % 2 AS INTEGER) AS active_layer FROM ids),
 layers AS (SELECT project_id, n.* FROM ids, (VALUES {", ".join(str(n) for n in _NAMES)}) n(layer_id, place, name, opacity, visible, locked)),
 fr AS (SELECT DISTINCT CAST(vec_id // 10 AS BIGINT) AS project_id, CAST(vec_id % 10 // 2 AS INTEGER) AS place FROM embeddings),
 frames AS (SELECT project_id, place + 100 AS frame_id, place, CASE WHEN place % 2 = 1 THEN place * 40 + 40 END AS duration_ms FROM fr),
 cels AS (SELECT CAST(frame_id // 10 AS BIGINT) AS project_id, CAST(frame_id % 10 // 2 AS INTEGER) AS place, CAST(frame_id % 2 AS INTEGER) AS layer_id, x, y, argb FROM px),
 tags AS (SELECT project_id, t.* FROM ids, (VALUES {", ".join(str(t) for t in _TAGS)}) t(place, name, start_frame, end_frame))
 """
)
_LAYER = "project_id, layer_id, place, name, opacity, visible, locked"
_HEAD = "project_id, name, w, h, fps, active_frame, active_layer"


def _on(name: str, f, sql: str) -> None:
    add(name, lambda s, d: f(projects(s, d)), _P + sql)


def _cel_pixels(p: project.Projects) -> DataFrame:
    """Cels as pixels: project_id, frame_id, layer_id, x, y, argb."""
    flat = p.cels.select("project_id", "frame_id", "layer_id", F.posexplode("pixels").alias("i", "argb"))
    return flat.select("project_id", "frame_id", "layer_id", (F.col("i") % 8).cast("int").alias("x"), C.idiv(F.col("i"), 8).alias("y"), "argb")


_on("project_heads", lambda p: project.with_active(project.with_fps(project.with_name(p, F.concat(F.lit("the "), F.col("name"))), F.col("fps")), frame=3, layer=2).heads.select(*_HEAD.split(", ")), "SELECT project_id, 'the ' || name AS name, w, h, CAST(least(24, greatest(1, fps)) AS INTEGER) AS fps, coalesce((SELECT place FROM fr WHERE fr.project_id = heads.project_id AND place = 3), active_frame) AS active_frame, 2 AS active_layer FROM heads")


def _blank(p: project.Projects) -> DataFrame:
    new = project.created(p.heads.select("project_id", "name"), 4, 3)
    return project.composites(new).select("project_id", "frame_id", "w", "h", F.array_max("pixels").alias("top"), F.size("pixels").alias("n"))


_on("project_created", _blank, "SELECT project_id, 0 AS frame_id, 4 AS w, 3 AS h, 0 AS top, 12 AS n FROM ids")
_on(
    "layer_edits",
    lambda p: project.layer_edited(project.layer_edited(p, 1, opacity=1.7, name="line"), 2, visible=True, locked=True).layers.select(*_LAYER.split(", ")),
    "SELECT project_id, layer_id, place, CASE layer_id WHEN 1 THEN 'line' ELSE name END AS name, CAST(CASE layer_id WHEN 1 THEN 1.0 ELSE opacity END AS DOUBLE) AS opacity, visible OR layer_id = 2 AS visible, locked OR layer_id = 2 AS locked FROM layers",
)


def _layers_and_heads(p: project.Projects) -> DataFrame:
    """Layers with the project's active one and the number of its cels."""
    cels = p.cels.groupBy("project_id", "layer_id").agg(F.count("*").alias("cels"))
    out = p.layers.join(cels, ["project_id", "layer_id"], "left").join(p.heads.select("project_id", "active_layer"), "project_id")
    return out.select("project_id", "layer_id", "place", "name", "active_layer", F.coalesce("cels", F.lit(0)).alias("cels"))


_CELS = "(SELECT count(*) FROM cels c WHERE c.project_id = l.project_id AND c.layer_id = l.layer_id AND x = 0 AND y = 0)"
_on("layer_add", lambda p: _layers_and_heads(project.layer_added(p, "top")), f"SELECT project_id, layer_id, place, name, 3 AS active_layer, {_CELS} AS cels FROM (SELECT project_id, layer_id, place, name FROM layers UNION ALL SELECT project_id, 3, 3, 'top' FROM ids) l")
_on("layer_remove", lambda p: _layers_and_heads(project.layer_removed(p, 1)), f"SELECT project_id, layer_id, CASE layer_id WHEN 2 THEN 1 ELSE place END AS place, name, 0 AS active_layer, {_CELS} AS cels FROM layers l WHERE layer_id <> 1")
_on("layer_move", lambda p: _layers_and_heads(project.layer_moved(p, 0, 2)), f"SELECT project_id, layer_id, CAST((place + 2) % 3 AS INTEGER) AS place, name, active_layer, {_CELS} AS cels FROM layers l JOIN heads h USING (project_id)".replace(" name,", " l.name,"))
_on("layer_clear", lambda p: _layers_and_heads(project.layer_cleared(p, 0)), f"SELECT project_id, layer_id, place, l.name, active_layer, CASE layer_id WHEN 0 THEN 0 ELSE {_CELS} END AS cels FROM layers l JOIN heads h USING (project_id)")


def _timeline(p: project.Projects) -> DataFrame:
    """Frames with the project's active one, and the sum of each one's cels."""
    total = F.aggregate("pixels", F.lit(0).cast("long"), lambda a, x: a + x)
    cels = p.cels.groupBy("project_id", "frame_id").agg(F.count("*").alias("cels"), F.sum(total).alias("ink"))
    out = p.frames.join(cels, ["project_id", "frame_id"], "left").join(p.heads.select("project_id", "active_frame"), "project_id")
    return out.select("project_id", "frame_id", "place", F.coalesce("duration_ms", F.lit(0)).alias("duration_ms"), "active_frame", F.coalesce("cels", F.lit(0)).alias("cels"), F.coalesce("ink", F.lit(0)).alias("ink"))


_INK = ", k AS (SELECT project_id, place, count(DISTINCT layer_id) AS cels, CAST(sum(argb) AS BIGINT) AS ink FROM cels GROUP BY ALL), t AS (SELECT f.project_id, f.frame_id, f.place, coalesce(f.duration_ms, 0) AS duration_ms, k.cels, k.ink, max(f.place) OVER (PARTITION BY f.project_id) AS top FROM frames f JOIN k USING (project_id, place))"
_LONG = "SELECT project_id, frame_id, {place} AS place, duration_ms, {active} AS active_frame, cels, ink FROM t"
for _name, _clone in (("frame_add", False), ("frame_clone", True)):
    _on(
        _name,
        lambda p, c=_clone: _timeline(project.frame_added(p, 1, c)),
        _INK + " " + _LONG.format(place="CASE WHEN place > 1 THEN place + 1 ELSE place END", active="CASE WHEN top >= 1 THEN 2 ELSE 0 END") + f" UNION ALL SELECT project_id, top + 101, 2, {'duration_ms' if _clone else '0'}, 2, cels, ink FROM t WHERE place = 1",
    )
_on("frame_delete", lambda p: _timeline(project.frame_deleted(project.with_active(p, frame=3), 2)), _INK + " " + _LONG.format(place="CASE WHEN top >= 2 AND place > 2 THEN place - 1 ELSE place END", active="CASE WHEN top >= 3 THEN 2 ELSE 0 END") + " WHERE top < 2 OR place <> 2")
_on("frame_move", lambda p: _timeline(project.frame_moved(p, 0, 2)), _INK + " " + _LONG.format(place="CASE WHEN top < 2 OR place > 2 THEN place WHEN place = 0 THEN 2 ELSE place - 1 END", active="CASE WHEN top < 2 THEN 0 ELSE 2 END"))
_on(
    "frame_durations",
    lambda p: project.durations(project.with_fps(project.frame_timed(project.frame_timed(p, 0, 77), 3, None), F.col("fps"))),
    "SELECT project_id, frame_id, place, CAST(CASE WHEN place = 0 THEN 77 WHEN place = 1 THEN duration_ms ELSE 1000 // least(24, fps) END AS INTEGER) AS effective_ms FROM frames JOIN heads USING (project_id)",
)
_on("tag_set", lambda p: project.tag_removed(project.tag_set(project.tag_set(p, "idle", 2, 4), "run", 0, 0), "walk").tags, ", top AS (SELECT project_id, max(place) AS top FROM fr GROUP BY project_id) SELECT project_id, CASE WHEN top >= 4 THEN 2 ELSE 0 END AS place, 'idle' AS name, CASE WHEN top >= 4 THEN 2 ELSE 0 END AS start_frame, CASE WHEN top >= 4 THEN 4 ELSE 1 END AS end_frame FROM top UNION ALL SELECT project_id, CASE WHEN top >= 4 THEN 3 ELSE 2 END, 'run', 0, 0 FROM top")
_CEL = "SELECT project_id, place + 100 AS frame_id, layer_id, x, y, {v} AS argb FROM cels"


def _put(p: project.Projects) -> DataFrame:
    """Layer 0 of the first frame gets what layer 1 has there; layer 1 of the second is taken away."""
    first = p.frames.where("place = 0").select("project_id", "frame_id")
    other = p.cels.where("layer_id = 1").join(first, ["project_id", "frame_id"]).select("project_id", "pixels")
    return _cel_pixels(project.cel_put(project.cel_put(p, 0, 0, other), 1, 1, None))


_on("cel_put", _put, _CEL.format(v="argb") + " WHERE NOT (place = 0 AND layer_id = 0) AND NOT (place = 1 AND layer_id = 1) UNION ALL SELECT project_id, 100, 0, x, y, argb FROM cels WHERE place = 0 AND layer_id = 1")
_on("active_cel", lambda p: _cel_pixels(project.Projects(p.heads, p.layers, p.frames, project.active_cels(p), p.tags)), _CEL.format(v="argb") + " WHERE place = 0 AND layer_id = project_id % 2")
_FROM = -16777216 + 85 * 65536
_NEAR = f"({A} = 255 AND abs({R} - 85) <= 90 AND {G} <= 90 AND {B} <= 90)"
_on("replace_colour", lambda p: _cel_pixels(project.recoloured(p, _FROM, -1, 90)), _CEL.format(v=f"CAST(CASE WHEN place = 0 AND layer_id = project_id % 2 AND {_NEAR} THEN -1 ELSE argb END AS INTEGER)"))
_HALF = f"CAST({Q.over('i.argb', 'b.argb', '{s}', '(' + Q.a('i.argb') + ' * 127 // 255)')} AS INTEGER)"
_STACK = f", st AS (SELECT b.project_id, b.place, b.x, b.y, CASE WHEN i.argb IS NULL OR {Q.a('i.argb')} = 0 THEN b.argb ELSE {_HALF} END AS argb FROM cels b LEFT JOIN cels i ON i.project_id = b.project_id AND i.place = b.place AND i.x = b.x AND i.y = b.y AND i.layer_id = 1 WHERE b.layer_id = 0)"


def _flat(found: DataFrame) -> DataFrame:
    rows = found.select("project_id", "frame_id", F.posexplode("pixels").alias("i", "argb"))
    return rows.select("project_id", "frame_id", (F.col("i") % 8).cast("int").alias("x"), C.idiv(F.col("i"), 8).alias("y"), "argb")


_on("composite_frames", lambda p: _flat(project.composites(p)), _STACK + " SELECT project_id, place + 100 AS frame_id, x, y, argb FROM st")
_on("composite_active", lambda p: _flat(project.composites(p, active=True)), _STACK + " SELECT project_id, place + 100 AS frame_id, x, y, argb FROM st WHERE place = 0")
_on("pick_colour", lambda p: project.picked(p, 3, 5), _STACK + " SELECT project_id, argb FROM st WHERE place = 0 AND x = 3 AND y = 5")


def _read_back(p: project.Projects) -> DataFrame:
    """What comes back out of the documents, broken texts left out."""
    texts = project.saved(p).union(p.heads.select((-F.col("project_id") - 1).alias("project_id"), F.lit("{oops")))
    back = project.loaded(texts, strict=False)
    counts = back.tags.groupBy("project_id").agg(F.count("*").alias("tags"))
    return _timeline(back).join(back.heads.select("project_id", "name", "fps"), "project_id").join(counts, "project_id")


_on("project_documents", _read_back, _INK + " SELECT t.project_id, frame_id, t.place, duration_ms, active_frame, cels, ink, name, fps, CAST(2 AS BIGINT) AS tags FROM t JOIN heads USING (project_id)")


# selections
def _boxes(s: SparkSession, d: str) -> DataFrame:
    part = S.table(s, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("z"))
    k, z = F.col("k"), F.col("z")
    return part.select("k", selections.box(k % 13 - 3, z % 11 - 2, z % 9, k % 7).alias("s"), selections.box(z % 8, k % 9, k % 6 + 1, z % 5).alias("t"))


_BOX = "bx AS (SELECT p_partkey AS k, CAST(p_partkey % 13 - 3 AS INTEGER) AS sx, CAST(p_size % 11 - 2 AS INTEGER) AS sy, CAST(p_size % 9 AS INTEGER) AS sw, CAST(p_partkey % 7 AS INTEGER) AS sh, CAST(p_size % 8 AS INTEGER) AS tx, CAST(p_partkey % 9 AS INTEGER) AS ty, CAST(p_partkey % 6 + 1 AS INTEGER) AS tw, CAST(p_size % 5 AS INTEGER) AS th FROM part)"


def _box_query(name: str, f, x: str, y: str, w: str, h: str) -> None:
    add(name, lambda s, d: _boxes(s, d).select("k", f(F.col("s"), F.col("t")).alias("b")).select("k", "b.*"), f"WITH {_BOX} SELECT k, CAST({x} AS INTEGER) AS x, CAST({y} AS INTEGER) AS y, CAST({w} AS INTEGER) AS w, CAST({h} AS INTEGER) AS h FROM bx")


def _inset_sql(at: str, size: str) -> tuple[str, str]:
    low, high = f"least({at} + 2, {at} + {size} // 2)", f"greatest({at} + {size} - 2, {at} + ({size} + 1) // 2)"
    no = "sw = 0 OR sh = 0"
    return f"CASE WHEN {no} THEN {at} ELSE {low} END", f"CASE WHEN {no} THEN {size} ELSE greatest(1, {high} - {low}) END"


(_IX, _IW), (_IY, _IH) = _inset_sql("sx", "sw"), _inset_sql("sy", "sh")
_box_query("selection_inset", lambda s, t: selections.inset(s, 2), _IX, _IY, _IW, _IH)
_box_query("selection_expand", lambda s, t: selections.expanded(s, 3), "sx - 3", "sy - 3", "sw + 6", "sh + 6")
_box_query("selection_translate", lambda s, t: selections.translated(s, 2, -5), "sx + 2", "sy - 5", "sw", "sh")


def _union_sql(at: str, size: str) -> tuple[str, str]:
    pick = f"CASE WHEN sw = 0 OR sh = 0 THEN {{t}} WHEN tw = 0 OR th = 0 THEN {{s}} ELSE {{both}} END"
    low = f"least(s{at}, t{at})"
    return pick.format(s=f"s{at}", t=f"t{at}", both=low), pick.format(s=f"s{size}", t=f"t{size}", both=f"greatest(s{at} + s{size}, t{at} + t{size}) - {low}")


(_UX, _UW), (_UY, _UH) = _union_sql("x", "w"), _union_sql("y", "h")
_box_query("selection_union", selections.united, _UX, _UY, _UW, _UH)
_MW, _MH = "greatest(0, least(sx + sw, tx + tw) - greatest(sx, tx))", "greatest(0, least(sy + sh, ty + th) - greatest(sy, ty))"
_box_query("selection_intersect", selections.met, "greatest(sx, tx)", "greatest(sy, ty)", _MW, _MH)
_box_query("selection_clip", lambda s, t: selections.clipped(s, 6, 5), "greatest(sx, 0)", "greatest(sy, 0)", "greatest(0, least(sx + sw, 6) - greatest(sx, 0))", "greatest(0, least(sy + sh, 5) - greatest(sy, 0))")
add(
    "selection_predicates",
    lambda s, d: _boxes(s, d).select("k", selections.meets(F.col("s"), F.col("t")).alias("meets"), selections.contains(F.col("s"), F.lit(2), F.lit(3)).alias("holds")),
    f"WITH {_BOX} SELECT k, {_MW} > 0 AND {_MH} > 0 AS meets, 2 >= sx AND 2 < sx + sw AND 3 >= sy AND 3 < sy + sh AS holds FROM bx",
)
add("selection_outline", lambda s, d: selections.outline(_boxes(s, d).select("k", "s"), "s"), f"WITH {_BOX}, g AS (SELECT bx.*, CAST(a.v AS INTEGER) AS x, CAST(b.v AS INTEGER) AS y FROM bx, (SELECT unnest(range(-3, 20)) AS v) a, (SELECT unnest(range(-3, 20)) AS v) b) SELECT k, x, y FROM g WHERE x >= sx AND x < sx + sw AND y >= sy AND y < sy + sh AND (x = sx OR x = sx + sw - 1 OR y = sy OR y = sy + sh - 1)")
on_frames(
    "magic_select",
    lambda fr: selections.by_colour(fr, 3, 3, 85),
    Q.PX
    + f""", seed AS (SELECT frame_id, argb AS s FROM px WHERE x = 3 AND y = 3), ok AS (SELECT px.* FROM px JOIN seed USING (frame_id) WHERE abs({A} - {Q.a('s')}) <= 85 AND {Q.chebyshev('argb', 's')} <= 85),
 area(frame_id, x, y) AS (SELECT frame_id, x, y FROM ok WHERE x = 3 AND y = 3 UNION SELECT n.frame_id, n.x, n.y FROM area r JOIN ok n ON n.frame_id = r.frame_id AND abs(n.x - r.x) + abs(n.y - r.y) = 1)
 SELECT frame_id, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height FROM area GROUP BY frame_id""",
)

# tile maps: a map of two layers for each raster
_TILES = [(0, [-1, 0, -65536, -16777216], 0), (1, [1082130432, -16711936, -16711936, 0], 1), (2, [0, 0, 2130706560, -16776961], 1), (3, [-256, -8355712, -256, 1619034240], 2)]


def cells(s: SparkSession, d: str) -> DataFrame:
    px = S.pixels(S.from_embeddings(S.dealt(S.table(s, d, "embeddings"))))  # a vector becomes 128 cells
    c = F.col("argb")
    layers = F.array(F.struct(F.lit(0).alias("layer"), C.blue(c).bitwiseAND(3).alias("tile")), F.struct(F.lit(1).alias("layer"), (C.green(c).bitwiseAND(3) - 1).alias("tile")))
    return px.select(F.col("frame_id").alias("map_id"), F.explode(layers).alias("l"), "x", "y", C.red(c).bitwiseAND(3).alias("flip")).select("map_id", "l.layer", "x", "y", "l.tile", "flip")


def tiles(s: SparkSession) -> DataFrame:
    return s.createDataFrame(_TILES, "tile int, pixels array<int>, terrain int")


_MAP = Q.PX + f", cl AS (SELECT frame_id AS map_id, CAST(l.v AS INTEGER) AS layer, x, y, CAST(CASE l.v WHEN 0 THEN {B} & 3 ELSE ({G} & 3) - 1 END AS INTEGER) AS tile, CAST({R} & 3 AS INTEGER) AS flip FROM px, (SELECT unnest([0, 1]) AS v) l)"
_PIECES = ", ".join(f"({t}, {k % 2}, {k // 2}, {p}, {g})" for t, px, g in _TILES for k, p in enumerate(px))


def _rendered(where: str, dx: int, dy: int) -> str:
    return (
        _MAP
        + f""", tp AS (SELECT * FROM (VALUES {_PIECES}) v(tile, u, v, argb, terrain)),
 d AS (SELECT map_id, layer, (x - {dx}) * 2 + CASE WHEN flip & 1 <> 0 THEN 1 - u ELSE u END AS px, (y - {dy}) * 2 + CASE WHEN flip & 2 <> 0 THEN 1 - v ELSE v END AS py, argb FROM cl JOIN tp USING (tile) WHERE {where}),
 lo AS (SELECT map_id, px, py, argb FROM d WHERE layer = 0), hi AS (SELECT map_id, px, py, argb FROM d WHERE layer = 1)
 SELECT map_id, CAST(px AS INTEGER) AS x, CAST(py AS INTEGER) AS y, CAST(CASE WHEN hi.argb IS NULL OR {Q.a('hi.argb')} = 0 THEN coalesce(lo.argb, 0) WHEN lo.argb IS NULL THEN hi.argb ELSE {Q.over('hi.argb', 'lo.argb', '{s}')} END AS INTEGER) AS argb FROM lo FULL JOIN hi USING (map_id, px, py)"""
    )


add("map_render", lambda s, d: tilemap.rendered(cells(s, d), tiles(s), 2), _rendered("true", 0, 0))
add("map_region", lambda s, d: tilemap.rendered_region(cells(s, d), tiles(s), 2, 2, 1, 4, 3), _rendered("x >= 2 AND x < 6 AND y >= 1 AND y < 4", 2, 1))
add("map_cells", lambda s, d: tilemap.filled(cells(s, d)).withColumn("turn", tilemap.flip_name(F.col("flip"))), _MAP + " SELECT *, CASE flip WHEN 0 THEN 'none' WHEN 1 THEN 'horizontal' WHEN 2 THEN 'vertical' ELSE 'both' END AS turn FROM cl WHERE tile >= 0")
add("map_cell_at", lambda s, d: tilemap.cell_at(cells(s, d), 1, 4, 4).union(tilemap.cell_at(cells(s, d), 0, 9, 9)), _MAP + " SELECT map_id, tile, flip FROM cl WHERE layer = 1 AND x = 4 AND y = 4 UNION ALL SELECT DISTINCT map_id, -1, 0 FROM cl")


def _with_cells(s: SparkSession, d: str) -> DataFrame:
    own = cells(s, d)
    new = own.where("layer = 0 and x = 2").select("map_id", "layer", "x", "y", F.lit(3).alias("tile"), F.lit(0).alias("flip"))
    return tilemap.with_cells(own, new)


add("map_with_cells", _with_cells, _MAP + " SELECT map_id, layer, x, y, CASE WHEN layer = 0 AND x = 2 THEN 3 ELSE tile END AS tile, CASE WHEN layer = 0 AND x = 2 THEN 0 ELSE flip END AS flip FROM cl")


def _layer_in(s: SparkSession, d: str) -> DataFrame:
    own = cells(s, d)
    new = own.select("map_id").distinct().join(F.broadcast(tilemap.empty(s, 0, 0, 3, 2).drop("map_id", "layer")))
    return tilemap.layer_dropped(tilemap.layer_inserted(own, 1, new), 0)


add("map_layers", _layer_in, _MAP + " SELECT map_id, 1 AS layer, x, y, tile, flip FROM cl WHERE layer = 1 UNION ALL SELECT m.map_id, 0, CAST(a.v AS INTEGER), CAST(b.v AS INTEGER), -1, 0 FROM (SELECT DISTINCT map_id FROM cl) m, (SELECT unnest(range(0, 3)) AS v) a, (SELECT unnest(range(0, 2)) AS v) b")
add("map_terrain", lambda s, d: tilemap.terrain_of(cells(s, d), tilemap.tile_added(tiles(s).where("tile < 3"), [0, 0, 0, 0], 7)).groupBy("map_id", "terrain").agg(F.count("*").alias("cells")), _MAP + " SELECT map_id, CASE tile WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 7 ELSE 0 END AS terrain, count(*) AS cells FROM cl GROUP BY ALL")


def _isometric(s: SparkSession, d: str) -> DataFrame:
    part = S.table(s, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") % 37).cast("int").alias("x"), F.col("p_size").alias("y"))
    at = part.select("k", tilemap.to_screen(F.col("x"), F.col("y"), 15, 8).alias("p"))
    return at.select("k", F.col("p.x").alias("sx"), F.col("p.y").alias("sy"), tilemap.to_cell(F.col("p.x") + 5, F.col("p.y") - 3, 15, 8).alias("c")).select("k", "sx", "sy", F.col("c.x").alias("cx"), F.col("c.y").alias("cy"))


add("isometric_cells", _isometric, "WITH p AS (SELECT p_partkey AS k, CAST((p_partkey % 37 - p_size) * 7 AS INTEGER) AS sx, CAST((p_partkey % 37 + p_size) * 4 AS INTEGER) AS sy FROM part) SELECT k, sx, sy, CAST(greatest(0, floor(((sx + 5) / 7.0::DOUBLE + (sy - 3) / 4.0::DOUBLE) / 2 + 0.5::DOUBLE)) AS INTEGER) AS cx, CAST(greatest(0, floor(((sy - 3) / 4.0::DOUBLE - (sx + 5) / 7.0::DOUBLE) / 2 + 0.5::DOUBLE)) AS INTEGER) AS cy FROM p")

# scalers
_AROUND = ", ".join(f"max(n.argb) FILTER (t.i = {i} AND t.j = {j}) AS n{i + 1}{j + 1}" for i in (-1, 0, 1) for j in (-1, 0, 1))
_NB = Q.PX + f", nb AS (SELECT p.frame_id, p.x, p.y, {_AROUND} FROM px p, (SELECT a.v AS i, b.v AS j FROM (SELECT unnest([-1, 0, 1]) AS v) a, (SELECT unnest([-1, 0, 1]) AS v) b) t JOIN px n ON n.frame_id = p.frame_id AND n.x = least(7, greatest(0, p.x + t.i)) AND n.y = least(7, greatest(0, p.y + t.j)) GROUP BY ALL)"


def _third(i: int, j: int) -> str:
    side, end, far_side, far_end, slant = f"n{i}1", f"n1{j}", f"n{2 - i}1", f"n1{2 - j}", f"n{i}{j}"
    value = "n11" if 1 in (i, j) else f"CASE WHEN {side} = {end} AND {side} <> {far_end} AND {end} <> {far_side} THEN CASE WHEN {slant} <> {side} THEN {slant} ELSE {side} END ELSE n11 END"
    return f"SELECT frame_id, 3 * x + {i} AS x, 3 * y + {j} AS y, {value} AS argb FROM nb"


as_pixels("scale3x", raster.scale3x, _NB + " " + " UNION ALL ".join(_third(i, j) for i in range(3) for j in range(3)))
as_pixels("extrude_edges", lambda fr: raster.extruded(fr, 2), Q.moved("least(7, greatest(0, o.x - 2))", "least(7, greatest(0, o.y - 2))", "12", "12"))

# descriptions
_SAMPLE = Q.PX + ", ce AS (SELECT frame_id, CAST(x // 3 AS INTEGER) AS cx, CAST(y // 3 AS INTEGER) AS cy, argb FROM px)"
on_frames("sample_majority", lambda fr: describe.majorities(fr, 3), _SAMPLE + f", t AS (SELECT frame_id, cx, cy, argb, count(*) FILTER ({A} > 0) AS n FROM ce GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY frame_id, cx, cy ORDER BY n DESC, argb DESC) AS rn FROM t) SELECT frame_id, cx, cy, CASE WHEN n = 0 THEN 0 ELSE argb END AS argb FROM k WHERE rn = 1")
_MEAN = f", m AS (SELECT frame_id, cx, cy, avg((299 * {R} + 587 * {G} + 114 * {B}) // 1000) FILTER ({A} > 0) AS v FROM ce GROUP BY ALL)"
on_frames("ascii_shades", lambda fr: describe.shades(fr, 3), _SAMPLE + _MEAN + f" SELECT frame_id, cy, string_agg(CASE WHEN v IS NULL THEN ' ' ELSE substr('{describe.RAMP}', 1 + CAST(least(9, greatest(1, floor(1 + v / 255.0::DOUBLE * 8 + 0.5::DOUBLE))) AS INTEGER), 1) END, '' ORDER BY cx) AS line FROM m GROUP BY frame_id, cy")
_ON = f", s AS (SELECT frame_id, cx, cy, count(*) FILTER ({A} > 0) * 2 >= count(*) AS seen FROM ce GROUP BY ALL), hb AS (SELECT frame_id, cx, CAST(cy // 2 AS INTEGER) AS cy, coalesce(bool_or(seen) FILTER (cy % 2 = 0), false) AS t, coalesce(bool_or(seen) FILTER (cy % 2 = 1), false) AS b FROM s GROUP BY frame_id, cx, CAST(cy // 2 AS INTEGER))"
for _name, _plain, (_b, _t, _l) in (("ascii_blocks", False, "█▀▄"), ("ascii_blocks_plain", True, "#^_")):
    on_frames(_name, lambda fr, a=_plain: describe.blocks(fr, 3, a), _SAMPLE + _ON + f" SELECT frame_id, cy, string_agg(CASE WHEN t AND b THEN '{_b}' WHEN t THEN '{_t}' WHEN b THEN '{_l}' ELSE ' ' END, '' ORDER BY cx) AS line FROM hb GROUP BY frame_id, cy")
_LAB = [f"({e})" for e in _lab("argb")]
_ENTRIES = "(VALUES " + ", ".join(f"({k}, {l!r}::DOUBLE, {a!r}::DOUBLE, {b!r}::DOUBLE)" for k, (l, a, b) in enumerate(map(raster.lab_of, PALETTE))) + ") e(idx, el, ea, eb)"
_TALLY = Q.PX + f", t AS (SELECT frame_id, argb, count(*) AS cnt FROM px WHERE {A} > 0 GROUP BY ALL), sh AS (SELECT argb, {_LAB[0]} AS l, {_LAB[1]} AS a, {_LAB[2]} AS b FROM (SELECT DISTINCT argb FROM px)), ne AS (SELECT argb, min(sqrt((l - el) * (l - el) + (a - ea) * (a - ea) + (b - eb) * (b - eb))) AS d, arg_min(idx, sqrt((l - el) * (l - el) + (a - ea) * (a - ea) + (b - eb) * (b - eb))) AS idx FROM sh, {_ENTRIES} GROUP BY argb)"
on_frames("palette_coverage", lambda fr: describe.coverage(fr, PALETTE, 30.0), _TALLY + " SELECT frame_id, CASE WHEN d <= 30 THEN idx ELSE -1 END AS idx, count(*) AS shades, CAST(sum(cnt) AS BIGINT) AS pixels FROM t JOIN ne USING (argb) GROUP BY ALL")
on_frames("palette_rows", lambda fr: describe.palette_rows(fr, PALETTE, 40.0), _TALLY + f" SELECT frame_id, y, string_agg(CASE WHEN {A} = 0 THEN '.' WHEN d <= 40 THEN CAST(idx AS VARCHAR) ELSE '-1' END, ' ' ORDER BY x) AS text FROM px JOIN ne USING (argb) GROUP BY frame_id, y")
_SHADES = Q.PX + f", t AS (SELECT DISTINCT argb FROM px WHERE {A} > 0)"


def _shades(s: SparkSession, d: str) -> DataFrame:
    return measures.visible(S.pixels(frames(s, d))).select("argb").distinct()


add("outline_colour", lambda s, d: _shades(s, d).select("argb", describe.outline_for(F.col("argb")).alias("outline")), _SHADES + f" SELECT argb, CASE WHEN {_LAB[0]} >= 50 THEN {describe.DARK} ELSE {describe.LIGHT} END AS outline FROM t")


def _alike(pr: DataFrame) -> DataFrame:
    """Which pixels of consecutive rasters have one colour, or nearly."""
    a, b = F.col("a"), F.col("b")
    px = pairs.pair_pixels(pr)
    la, lb = C.lab(a), C.lab(b)
    off = F.sqrt((la["l"] - lb["l"]) ** 2 + (la["a"] - lb["a"]) ** 2 + (la["b"] - lb["b"]) ** 2)
    return px.groupBy("frame_id").agg(F.count_if(off <= 40.0).alias("near"), F.count_if(a.bitwiseAND(0xFFFFFF) == b.bitwiseAND(0xFFFFFF)).alias("same"))


_LA, _LB = [f"({e})" for e in _lab("a")], [f"({e})" for e in _lab("b")]
on_pairs("near_colours", _alike, Q.PAIRS + f", q AS (SELECT frame_id, a, b, sqrt({' + '.join(f'({p} - {q}) * ({p} - {q})' for p, q in zip(_LA, _LB, strict=True))}) AS d FROM pr) SELECT frame_id, count(*) FILTER (d <= 40) AS near, count(*) FILTER (a & 16777215 = b & 16777215) AS same FROM q GROUP BY frame_id")

# findings that need components
_CLUSTER = _components("n.argb = o.argb")
_HOLE = Q.PX + f""", oreach(frame_id, src, x, y) AS (SELECT frame_id, y * 8 + x, x, y FROM px WHERE {A} = 0
 UNION SELECT r.frame_id, r.src, n.x, n.y FROM oreach r JOIN px n ON n.frame_id = r.frame_id AND abs(n.x - r.x) + abs(n.y - r.y) = 1 AND {Q.a('n.argb')} = 0)"""
_HOLES = "hl AS (SELECT frame_id, x, y, min(src) AS head FROM oreach GROUP BY ALL), ho AS (SELECT frame_id, head, count(*) AS area FROM hl GROUP BY ALL HAVING min(x) > 0 AND min(y) > 0 AND max(x) < 7 AND max(y) < 7)"
_TINY = "ti AS (SELECT l.frame_id, l.head, count(*) AS area FROM lab l GROUP BY ALL HAVING count(*) < 3)"
_BOTH = _CLUSTER + _HOLE.removeprefix(Q.PX) + ", " + _HOLES + ", " + _TINY
_FOUND = "SELECT ti.frame_id, 'tiny_cluster' AS rule, CAST(head % 8 AS INTEGER) AS x, CAST(head // 8 AS INTEGER) AS y, argb, area FROM ti JOIN px ON px.frame_id = ti.frame_id AND px.y * 8 + px.x = head UNION ALL SELECT frame_id, 'enclosed_hole', CAST(head % 8 AS INTEGER), CAST(head // 8 AS INTEGER), 0, area FROM ho"
on_frames("blob_findings", describe.blob_findings, _BOTH + " " + _FOUND)
_AUDIT = catalogue.SQL["audit"].removeprefix(Q.PX).replace(" SELECT frame_id, 'isolated_pixel'", ", fi AS (SELECT frame_id, 'isolated_pixel'", 1).lstrip()
_WEIGHT = "CASE WHEN rule IN ('accidental_checker', 'enclosed_hole') THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END"
on_frames(
    "audit_score",
    describe.scores,
    _BOTH
    + _AUDIT
    + f"""), al AS (SELECT frame_id, rule FROM fi UNION ALL SELECT frame_id, rule FROM ({_FOUND})), su AS (SELECT frame_id, count(*) AS findings, sum({_WEIGHT}) AS penalty FROM al GROUP BY frame_id),
 se AS (SELECT frame_id, count(*) FILTER ({A} > 0) AS seen FROM px GROUP BY frame_id)
 SELECT frame_id, coalesce(findings, 0) AS findings, CAST(CASE WHEN seen = 0 THEN 100 ELSE trunc(least(100.0::DOUBLE, greatest(0.0::DOUBLE, 100 - coalesce(penalty, 0) / greatest(8.0::DOUBLE, sqrt(seen)) * 10.0::DOUBLE))) END AS INTEGER) AS score FROM se LEFT JOIN su USING (frame_id)""",
)


# checkpoints
def _kept(s: SparkSession, d: str) -> DataFrame:
    """Anchors without those of one session and one serial."""
    anchors = log.checkpoints(log.from_events(S.table(s, d, "events"))).drop("ts")
    return log.without_checkpoint(log.without_session(anchors, 3), 20)


add("checkpoints_kept", _kept, Q.OPLOG + ", c AS (SELECT session, CAST(serial AS INTEGER) AS serial, CAST(serial - coalesce(lag(serial) OVER (PARTITION BY session ORDER BY serial), 0) AS INTEGER) AS since FROM log WHERE serial % 10 = 0) SELECT * FROM c WHERE session <> 3 AND serial <> 20")
add("checkpoint_found", lambda s, d: log.checkpoint(log.checkpoints(log.from_events(S.table(s, d, "events"))).drop("ts"), 10), Q.OPLOG + "SELECT session, 10 AS serial, 10 AS since FROM log WHERE serial = 10")
