"""Named queries of outlines, sheets and repairs, with their SQL. They join those of
`catalogue`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import atlas, contours, healing, seams
from ..sources import frames as S
from . import sql as Q
from .catalogue import A, B, G, R, on_frames


def _walked(inside: str) -> str:
    """Every edge walked forward until it meets a lesser one, or itself: then it
    begins a ring. An edge's number is its corner's, row by row, and its direction."""
    return (
        Q.PX
        + f""", m AS MATERIALIZED (SELECT frame_id, x, y FROM px WHERE {inside}),
 s AS (SELECT m.frame_id, m.x, m.y, d.d, d.fx, d.fy, o.x IS NULL AS edge FROM m, (VALUES (0, 0, -1, 0, 0), (1, 1, 0, 1, 0), (2, 0, 1, 1, 1), (3, -1, 0, 0, 1)) d(d, ox, oy, fx, fy) LEFT JOIN m o ON o.frame_id = m.frame_id AND o.x = m.x + ox AND o.y = m.y + oy),
 ed AS MATERIALIZED (SELECT frame_id, x + fx AS x, y + fy AS y, d, ((y + fy) * 9 + x + fx) * 4 + d AS id FROM s WHERE edge),
 nx AS MATERIALIZED (SELECT a.frame_id, a.id, min_by(b.id, CASE (b.d - a.d + 4) % 4 WHEN 1 THEN 0 WHEN 0 THEN 1 ELSE 2 END) AS nxt FROM ed a JOIN ed b ON b.frame_id = a.frame_id
  AND b.x = a.x + CASE a.d WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AND b.y = a.y + CASE a.d WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END GROUP BY a.frame_id, a.id),
 wk AS (SELECT frame_id, id AS head, id AS cur, 0 AS step FROM nx UNION ALL SELECT wk.frame_id, head, nxt, step + 1 FROM wk JOIN nx ON nx.frame_id = wk.frame_id AND nx.id = wk.cur WHERE nxt >= head AND (step = 0 OR cur <> head)),
 fin AS (SELECT frame_id, head, step AS length FROM wk WHERE step > 0 AND cur = head),
 pt AS (SELECT frame_id, head, length, step, cur, lag(cur) OVER (PARTITION BY frame_id, head ORDER BY step) AS prev FROM wk JOIN fin USING (frame_id, head)),
 co AS (SELECT frame_id, CAST(head // 4 % 9 AS INTEGER) AS x0, CAST(head // 36 AS INTEGER) AS y0, head % 4 = 1 AS hole, CAST(length - step AS BIGINT) AS "left", CAST(cur // 4 % 9 AS INTEGER) AS x, CAST(cur // 36 AS INTEGER) AS y, CAST(cur % 4 AS INTEGER) AS dir FROM pt WHERE step < length AND (step = 0 OR cur % 4 <> prev % 4))
"""
    )


_POINTS = ' SELECT frame_id, x0, y0, hole, "left", x, y, dir FROM co'
_RED = 0xFFAA5500
_NEAR = f"{A} > 0 AND greatest(abs({R} - 170), abs({G} - 85), abs({B} - 0)) <= 90"
on_frames("contours", contours.traced, _walked(f"{A} > 0") + _POINTS)
on_frames("contours_of_colour", lambda fr: contours.traced(fr, contours.of_colour(_RED - (1 << 32), 90)), _walked(_NEAR) + _POINTS)
on_frames("contours_tiled", lambda fr: contours.traced_tiles(seams.tiled(S.pixels(fr), 4), 4), _walked(f"{A} > 0") + _POINTS)
on_frames(
    "contour_sizes",
    lambda fr: contours.sizes(contours.traced(fr)),
    # the area by the shoelace over the corners, each with the one that follows
    _walked(f"{A} > 0")
    + """, sh AS (SELECT frame_id, x0, y0, hole, "left", x, y, coalesce(lead(x) OVER w, x0) AS x2, coalesce(lead(y) OVER w, y0) AS y2 FROM co WINDOW w AS (PARTITION BY frame_id, x0, y0 ORDER BY "left" DESC))
 SELECT frame_id, x0, y0, hole, max("left") AS length, count(*) AS corners, CAST(sum(x * y2 - x2 * y) // 2 AS BIGINT) AS area FROM sh GROUP BY ALL""",
)


# sheets: sixteen rasters of a tag to one, cut to what is visible
def _sprites(fr: DataFrame) -> DataFrame:
    return atlas.trimmed(atlas.sheeted(fr, 16))


def _flat(found: DataFrame) -> DataFrame:
    rest = [c for c in found.columns if c not in ("sheet", "original")]
    return found.select("sheet.tag", F.col("sheet.no").alias("sheet"), *rest)


def _on_sheets(fr: DataFrame, **options: bool) -> DataFrame:
    sprites = _sprites(fr)
    own = atlas.drawn(sprites, atlas.regions(sprites, 1, 1, **options), 1)
    return S.pixels(own).select(F.col("frame_id.tag").alias("tag"), F.col("frame_id.no").alias("sheet"), "x", "y", "argb")


def _meta(fr: DataFrame, format: str, trim: bool = True) -> DataFrame:
    sprites = _sprites(fr) if trim else atlas.sheeted(fr, 16)
    found = atlas.metadata(atlas.regions(sprites, 1, shelf=True), format)
    return found.select("sheet.tag", F.col("sheet.no").alias("sheet"), "json")


def _shelf(padding: int) -> str:
    return (
        Q.PX
        + f""", pl AS (SELECT frame_id, tag, (row_number() OVER (PARTITION BY tag ORDER BY frame_id) - 1) AS k FROM (SELECT DISTINCT frame_id, tag FROM px)),
 bb AS (SELECT frame_id, min(x) AS bx, min(y) AS by_, max(x) - min(x) + 1 AS bw, max(y) - min(y) + 1 AS bh FROM px WHERE {A} > 0 GROUP BY ALL),
 sp AS (SELECT pl.frame_id, tag, k // 16 AS sheet, k % 16 AS place, coalesce(bx, 0) AS bx, coalesce(by_, 0) AS by_, coalesce(bw, 8) AS w, coalesce(bh, 8) AS h, bx IS NOT NULL AS trimmed FROM pl LEFT JOIN bb USING (frame_id)),
 la AS (SELECT *, {padding} + coalesce(sum(w + {2 * padding}) OVER (PARTITION BY tag, sheet ORDER BY h DESC, frame_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x, {padding} AS y, sum(w + {2 * padding}) OVER (PARTITION BY tag, sheet) AS sheet_w, max(h + {2 * padding}) OVER (PARTITION BY tag, sheet) AS sheet_h FROM sp)
"""
    )


_CASTS = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in ("place", "x", "y", "w", "h", "sheet_w", "sheet_h"))
on_frames("atlas_shelf", lambda fr: _flat(atlas.packed(_sprites(fr), 1, shelf=True)), _shelf(1) + f" SELECT tag, CAST(sheet AS INTEGER) AS sheet, frame_id, {_CASTS}, false AS rotated FROM la")
on_frames(
    "atlas_shelf_sheets",
    lambda fr: _on_sheets(fr, shelf=True),
    _shelf(2)
    + """, cv AS (SELECT DISTINCT tag, sheet, sheet_w, sheet_h FROM la), gd AS (SELECT tag, sheet, px_, py_ FROM cv, (SELECT unnest(range(0, 200)) AS px_), (SELECT unnest(range(0, 12)) AS py_) WHERE px_ < sheet_w AND py_ < sheet_h)
 SELECT gd.tag, CAST(gd.sheet AS INTEGER) AS sheet, CAST(px_ AS INTEGER) AS x, CAST(py_ AS INTEGER) AS y, coalesce(p.argb, 0) AS argb FROM gd
 LEFT JOIN la ON la.tag = gd.tag AND la.sheet = gd.sheet AND px_ BETWEEN la.x - 1 AND la.x + w AND py_ BETWEEN la.y - 1 AND la.y + h
 LEFT JOIN px p ON p.frame_id = la.frame_id AND p.x = bx + least(w - 1, greatest(0, px_ - la.x)) AND p.y = by_ + least(h - 1, greatest(0, py_ - la.y))""",
)
on_frames(
    "atlas_meta",
    lambda fr: _meta(fr, "generic"),
    _shelf(1)
    + """ SELECT tag, CAST(sheet AS INTEGER) AS sheet, '{"frames":[' || string_agg('{"name":"' || frame_id || '","x":' || x || ',"y":' || y || ',"w":' || w || ',"h":' || h || ',"rotated":false}', ',' ORDER BY place) || '],"image":"atlas.png","meta":{"size":{"w":' || any_value(sheet_w) || ',"h":' || any_value(sheet_h) || '},"count":' || count(*) || '}}' AS json FROM la GROUP BY tag, sheet""",
)
on_frames(
    "atlas_meta_phaser",
    lambda fr: _meta(fr, "phaser"),
    _shelf(1)
    + """ SELECT tag, CAST(sheet AS INTEGER) AS sheet, '{"frames":{' || string_agg('"' || frame_id || '":{"frame":{"x":' || x || ',"y":' || y || ',"w":' || w || ',"h":' || h || '},"rotated":false,"trimmed":' || trimmed || ',"spriteSourceSize":{"x":' || bx || ',"y":' || by_ || ',"w":' || w || ',"h":' || h
 || '},"sourceSize":{"w":8,"h":8}}', ',' ORDER BY place) || '}}' AS json FROM la GROUP BY tag, sheet""",
)
on_frames(
    "atlas_meta_tiled",
    lambda fr: _meta(fr, "tiled", False),
    Q.PX
    + """ SELECT tag, CAST(k // 16 AS INTEGER) AS sheet, '{"columns":' || count(*) || ',"image":"atlas.png","imageheight":10,"imagewidth":' || count(*) * 10 || ',"margin":1,"spacing":' || CASE WHEN count(*) = 1 THEN 0 ELSE 2 END || ',"tilecount":' || count(*) || ',"tileheight":8,"tilewidth":8,"type":"tileset"}' AS json
 FROM (SELECT tag, row_number() OVER (PARTITION BY tag ORDER BY frame_id) - 1 AS k FROM (SELECT DISTINCT frame_id, tag FROM px)) GROUP BY ALL""",
)
#: Greedy packing is not for SQL: tests/test_atlas.py compares it with plain loops.
on_frames("atlas_packed", lambda fr: _flat(atlas.packed(_sprites(fr), 1, turn=True, powers=True)))
on_frames("atlas_sheets", lambda fr: _on_sheets(fr, turn=True))

#: Repairs follow each other, which is not for SQL: tests/test_healing.py holds them against plain loops.
on_frames("healed", lambda fr: healing.healed(fr).drop("w", "h", "pixels"))
on_frames("healed_pixels", lambda fr: S.pixels(healing.healed(fr)))
