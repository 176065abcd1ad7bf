"""SQL text for the oracle: the same rules as the operators, written a second
time over the pixel relation, for an engine that knows nothing of rasters."""

from __future__ import annotations


def _level(i: str) -> str:
    return f"least(255, greatest(0, CAST(floor(CAST(embedding[({i}) + 1] AS DOUBLE) * 512 + 128) AS INTEGER)))"


#: The pixel relation px(frame_id, tag, x, y, argb) of the 8 x 8 rasters.
PX = f"""WITH RECURSIVE e AS (SELECT vec_id, label, embedding, unnest(range(0, 64)) AS i FROM embeddings),
l AS (SELECT vec_id AS frame_id, label AS tag, CAST(i % 8 AS INTEGER) AS x, CAST(i // 8 AS INTEGER) AS y,
 {_level('i')} AS l0, {_level('(i * 7 + 3) % 64')} AS l1, {_level('(i * 11 + 5) % 64')} AS l2 FROM e),
px AS MATERIALIZED (SELECT frame_id, tag, x, y, CAST(CASE WHEN l0 < 96 THEN 0 ELSE -16777216 + (l0 // 64 * 85) * 65536 + (l1 // 64 * 85) * 256 + l2 // 64 * 85 END AS INTEGER) AS argb FROM l)
"""


def a(c: str) -> str:
    return f"((CAST({c} AS BIGINT) & 4294967295) >> 24)"


def r(c: str) -> str:
    return f"((CAST({c} AS BIGINT) & 16777215) >> 16)"


def g(c: str) -> str:
    return f"((CAST({c} AS BIGINT) & 65535) >> 8)"


def b(c: str) -> str:
    return f"(CAST({c} AS BIGINT) & 255)"


def pack(alpha: str, red: str, green: str, blue: str) -> str:
    """Channels joined bit by bit, as a signed number: one of 256 reaches into the next."""
    whole = " | ".join(f"(CAST({v} AS BIGINT) << {k})" for v, k in ((alpha, 24), (red, 16), (green, 8), (blue, 0)))
    return f"CAST(xor({whole}, 2147483648) - 2147483648 AS INTEGER)"


def clamp(v: str) -> str:
    return f"least(255, greatest(0, {v}))"


def luma(c: str) -> str:
    return clamp(f"CAST(floor(0.2126::DOUBLE * {r(c)} + 0.7152::DOUBLE * {g(c)} + 0.0722::DOUBLE * {b(c)} + 0.5::DOUBLE) AS BIGINT)")


def chebyshev(p: str, q: str) -> str:
    return f"greatest(abs({r(p)} - {r(q)}), abs({g(p)} - {g(q)}), abs({b(p)} - {b(q)}))"


def linear(v: str) -> str:
    return f"(CASE WHEN {v} / 255.0::DOUBLE <= 0.04045::DOUBLE THEN {v} / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow(({v} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4::DOUBLE) END)"


def luminance(c: str) -> str:
    return f"(0.2126::DOUBLE * {linear(r(c))} + 0.7152::DOUBLE * {linear(g(c))} + 0.0722::DOUBLE * {linear(b(c))})"


def mapped(expr: str) -> str:
    """Pixels with a new colour."""
    return PX + f"SELECT frame_id, x, y, CAST({expr} AS INTEGER) AS argb FROM px"


def moved(x: str, y: str, w: str = "8", h: str = "8") -> str:
    """A raster of w x h whose pixel (x, y) is that of px at (x, y) given."""
    return PX + f"""SELECT o.frame_id, o.x, o.y, coalesce(p.argb, 0) AS argb FROM
 (SELECT f.frame_id, CAST(gx.v AS INTEGER) AS x, CAST(gy.v AS INTEGER) AS y FROM (SELECT DISTINCT frame_id FROM px) f, (SELECT unnest(range(0, {w})) AS v) gx, (SELECT unnest(range(0, {h})) AS v) gy) o
 LEFT JOIN px p ON p.frame_id = o.frame_id AND p.x = {x} AND p.y = {y}"""


def around(select: str, on: str = "true", where: str = "") -> str:
    """p: pixels, n: those within one step (8 neighbours)."""
    return PX + f"SELECT p.frame_id, p.x, p.y, {select} FROM px p LEFT JOIN px n ON n.frame_id = p.frame_id AND abs(n.x - p.x) <= 1 AND abs(n.y - p.y) <= 1 AND (n.x <> p.x OR n.y <> p.y) AND {on} {where} GROUP BY p.frame_id, p.x, p.y, p.argb"


PAIRS = PX + ", pr AS (SELECT p.frame_id, p.x, p.y, p.argb AS a, q.argb AS b FROM px p JOIN px q ON q.frame_id = p.frame_id + 1 AND q.x = p.x AND q.y = p.y)\n"


def over(s: str, d: str, channel: str, sa: str | None = None) -> str:
    """s over d; channel mentions {s} and {d}."""
    sa = sa or a(s)
    out = f"({sa} + {a(d)} * (255 - {sa}) // 255)"

    def mix(f) -> str:
        return f"(({clamp(channel.format(s=f(s), d=f(d)))}) * {sa} + {f(d)} * {a(d)} * (255 - {sa}) // 255) // greatest(1, {out})"

    return f"(CASE WHEN {out} = 0 THEN 0 ELSE {pack(out, mix(r), mix(g), mix(b))} END)"


BLENDS = {
    "normal": "{s}",
    "multiply": "({s} * {d} + 127) // 255",
    "screen": "255 - ((255 - {s}) * (255 - {d}) + 127) // 255",
    "add": "least(255, {s} + {d})",
    "subtract": "greatest(0, {d} - {s})",
    "difference": "abs({s} - {d})",
    "lighten": "greatest({s}, {d})",
    "darken": "least({s}, {d})",
    "overlay": "CASE WHEN {d} < 128 THEN (2 * {s} * {d} + 127) // 255 ELSE 255 - (2 * (255 - {s}) * (255 - {d}) + 127) // 255 END",
}


def hue(c: str) -> str:
    top, span = f"greatest({r(c)}, {g(c)}, {b(c)})", f"(greatest({r(c)}, {g(c)}, {b(c)}) - least({r(c)}, {g(c)}, {b(c)}))"
    s = f"(CASE WHEN {span} = 0 THEN 0.0::DOUBLE WHEN {top} = {r(c)} THEN ({g(c)} - {b(c)}) / {span}::DOUBLE WHEN {top} = {g(c)} THEN ({b(c)} - {r(c)}) / {span}::DOUBLE + 2 ELSE ({r(c)} - {g(c)}) / {span}::DOUBLE + 4 END)"
    return f"(CASE WHEN {s} < 0 THEN {s} * 60 + 360 ELSE {s} * 60 END)"


def family(c: str) -> str:
    top, low = f"greatest({r(c)}, {g(c)}, {b(c)})", f"least({r(c)}, {g(c)}, {b(c)})"
    light, span, h = f"(({top} + {low}) / 2.0::DOUBLE)", f"({top} - {low})", hue(c)
    sat = f"({span} / greatest({top}, 1)::DOUBLE)"
    reds = f"CASE WHEN {light} < 110 AND {sat} < 0.75 THEN 'brown' ELSE 'red' END"
    return (
        f"CASE WHEN {a(c)} = 0 THEN 'transparent' WHEN {span} <= 16 AND {light} < 48 THEN 'black' WHEN {span} <= 16 AND {light} >= 216 THEN 'white' WHEN {span} <= 16 THEN 'gray'"
        f" WHEN {h} < 12 THEN {reds} WHEN {h} < 46 THEN CASE WHEN {light} < 110 THEN 'brown' ELSE 'orange' END WHEN {h} < 66 THEN 'yellow' WHEN {h} < 160 THEN 'green'"
        f" WHEN {h} < 200 THEN 'cyan' WHEN {h} < 258 THEN 'blue' WHEN {h} < 300 THEN CASE WHEN {light} >= 170 AND {sat} < 0.6 THEN 'pink' ELSE 'purple' END"
        f" WHEN {h} < 348 THEN CASE WHEN {light} >= 170 THEN 'pink' ELSE 'magenta' END ELSE {reds} END"
    )


def hex_colour(c: str) -> str:
    return f"CASE WHEN {a(c)} = 255 THEN printf('#%06x', CAST({c} AS BIGINT) & 16777215) ELSE printf('#%08x', CAST({c} AS BIGINT) & 4294967295) END"


HIST = PX + f""", hist AS (
 SELECT frame_id, 'a' AS channel, {a('argb')} AS bin, count(*) AS cnt FROM px GROUP BY ALL
 UNION ALL SELECT frame_id, 'r', {r('argb')}, count(*) FROM px WHERE {a('argb')} > 0 GROUP BY ALL
 UNION ALL SELECT frame_id, 'g', {g('argb')}, count(*) FROM px WHERE {a('argb')} > 0 GROUP BY ALL
 UNION ALL SELECT frame_id, 'b', {b('argb')}, count(*) FROM px WHERE {a('argb')} > 0 GROUP BY ALL
 UNION ALL SELECT frame_id, 'luma', {luma('argb')}, count(*) FROM px WHERE {a('argb')} > 0 GROUP BY ALL)
"""

LWRITES = """WITH log AS (SELECT l_suppkey AS frame_id, CAST(l_partkey % 32 AS INTEGER) AS x, CAST(l_orderkey % 32 AS INTEGER) AS y,
 CAST(-16777216 + CAST(floor(l_quantity * 5 + 0.5) AS INTEGER) * 65536 + CAST(floor(l_discount * 1000 + 0.5) AS INTEGER) * 256 + CAST(floor(l_tax * 1000 + 0.5) AS INTEGER) AS INTEGER) AS argb,
 l_orderkey AS o1, l_linenumber AS o2 FROM lineitem)
"""

OPLOG = """WITH log AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS serial, ts, event_type AS kind, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events)
"""
