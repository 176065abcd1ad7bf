"""The named queries of the library and the SQL that each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour as C
from ..functions import easing
from ..operators import filters, log, measures, pairs, raster, regions, sequential, shapes, timeline
from ..sources import codecs, generate, noise, text
from ..sources import frames as S
from . import recipe
from . import sql as Q

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
PALETTE = [-16777216, -1, -65536, -16711936, -16776961, -256, -8355712]  # black, white, red, green, blue, yellow, grey
A, R, G, B = (f("argb") for f in (Q.a, Q.r, Q.g, Q.b))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.from_embeddings(S.table(spark, sf_dir, "embeddings"))


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


def on_frames(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    add(name, lambda s, d: f(frames(s, d)), sql)


def as_pixels(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """A query whose result is rasters, given out as pixels."""
    on_frames(name, lambda fr: S.pixels(f(fr)), sql)


def per_pixel(name: str, f, sql: str) -> None:
    as_pixels(name, lambda fr: raster.mapped(fr, f), Q.mapped(sql))


def on_pairs(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    on_frames(name, lambda fr: f(pairs.consecutive(fr)), sql)


# scans
on_frames("px_scan", S.pixels, Q.mapped("argb"))
on_frames(
    "channel_unpack",
    lambda fr: S.pixels(fr).select("frame_id", "x", "y", *[f(F.col("argb")).alias(n) for n, f in (("a", C.alpha), ("r", C.red), ("g", C.green), ("b", C.blue))]),
    Q.PX + f"SELECT frame_id, x, y, CAST({A} AS INTEGER) AS a, CAST({R} AS INTEGER) AS r, CAST({G} AS INTEGER) AS g, CAST({B} AS INTEGER) AS b FROM px",
)
on_frames(
    "region_rle",
    measures.runs,
    Q.PX
    + """, f AS (SELECT *, CASE WHEN argb IS DISTINCT FROM lag(argb) OVER w OR lag(argb) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM px WINDOW w AS (PARTITION BY frame_id, y ORDER BY x)),
 n AS (SELECT *, sum(fresh) OVER (PARTITION BY frame_id, y ORDER BY x) AS run FROM f)
 SELECT frame_id, y, CAST(min(x) AS INTEGER) AS x, count(*) AS length, any_value(argb) AS argb FROM n GROUP BY frame_id, y, run""",
)

# pointwise
per_pixel("posterize", lambda p: C.posterize(p, 4), f"CASE WHEN {A} = 0 THEN argb ELSE {Q.pack(A, *[f'({v} * 3 + 127) // 255 * 255 // 3' for v in (R, G, B)])} END")
per_pixel("binarize", lambda p: C.binarize(p, 90), f"CASE WHEN {A} = 0 THEN argb WHEN {Q.luma('argb')} > 90 THEN -1 ELSE -16777216 END")
per_pixel("bg_remove", lambda p: C.drop_faint(p, 16), f"CASE WHEN {A} < 16 THEN 0 ELSE argb END")
per_pixel("alpha_snap", lambda p: C.alpha_snap(p), f"CASE WHEN {A} < 128 THEN 0 ELSE {Q.pack('255', R, G, B)} END")
per_pixel("cvd_achromat", lambda p: C.achromat(p), Q.pack(A, *["CAST(floor(0.2126::DOUBLE * {0} + 0.7152::DOUBLE * {1} + 0.0722::DOUBLE * {2}) AS BIGINT)".format(R, G, B)] * 3))


def _machado(kind: str) -> str:
    m = [repr(x) + "::DOUBLE" for x in C.MACHADO[kind]]
    light = [Q.linear(v) for v in (R, G, B)]
    out = []
    for k in range(3):
        v = f"least(1.0::DOUBLE, greatest(0.0::DOUBLE, {m[3 * k]} * {light[0]} + {m[3 * k + 1]} * {light[1]} + {m[3 * k + 2]} * {light[2]}))"
        s = f"(CASE WHEN {v} <= 0.0031308::DOUBLE THEN {v} * 12.92::DOUBLE ELSE 1.055::DOUBLE * pow({v}, {1 / 2.4!r}::DOUBLE) - 0.055::DOUBLE END)"
        out.append(Q.clamp(f"CAST(floor({s} * 255 + 0.5::DOUBLE) AS BIGINT)"))
    return Q.pack(A, *out)


for _kind in C.MACHADO:
    per_pixel(f"cvd_{_kind}", lambda p, k=_kind: C.simulated(p, k), _machado(_kind))

on_frames(
    "luma",
    lambda fr: S.pixels(fr).select("frame_id", "x", "y", C.luma8(F.col("argb")).alias("luma8"), C.luma601(F.col("argb")).alias("luma601")),
    Q.PX + f"SELECT frame_id, x, y, CAST({Q.luma('argb')} AS INTEGER) AS luma8, CAST((299 * {R} + 587 * {G} + 114 * {B}) // 1000 AS INTEGER) AS luma601 FROM px",
)
on_frames(
    "family_of",
    lambda fr: S.pixels(fr).select("frame_id", "x", "y", C.family(F.col("argb")).alias("family"), C.hex_colour(F.col("argb")).alias("hex")),
    Q.PX + f"SELECT frame_id, x, y, {Q.family('argb')} AS family, {Q.hex_colour('argb')} AS hex FROM px",
)
on_frames(
    "luminance",
    lambda fr: measures.visible(S.pixels(fr)).select("frame_id", "x", "y", F.round(C.luminance(F.col("argb")), 6).alias("luminance")),
    Q.PX + f"SELECT frame_id, x, y, round({Q.luminance('argb')}, 6) AS luminance FROM px WHERE {A} > 0",
)


def _lab(c: str) -> tuple[str, str, str]:
    rl, gl, bl = Q.linear(Q.r(c)), Q.linear(Q.g(c)), Q.linear(Q.b(c))
    x = f"((0.4124564::DOUBLE * {rl} + 0.3575761::DOUBLE * {gl} + 0.1804375::DOUBLE * {bl}) / 0.95047::DOUBLE)"
    y = f"(0.2126729::DOUBLE * {rl} + 0.7151522::DOUBLE * {gl} + 0.0721750::DOUBLE * {bl})"
    z = f"((0.0193339::DOUBLE * {rl} + 0.1191920::DOUBLE * {gl} + 0.9503041::DOUBLE * {bl}) / 1.08883::DOUBLE)"
    f = [f"(CASE WHEN {t} > 0.008856::DOUBLE THEN pow({t}, {1 / 3!r}::DOUBLE) ELSE (903.3::DOUBLE * {t} + 16) / 116 END)" for t in (x, y, z)]
    return f"(116 * {f[1]} - 16)", f"(500 * ({f[0]} - {f[1]}))", f"(200 * ({f[1]} - {f[2]}))"


on_frames(
    "lab_convert",
    lambda fr: measures.visible(S.pixels(fr)).withColumn("lab", C.lab(F.col("argb"))).select("frame_id", "x", "y", *[(F.round(F.col(f"lab.{c}"), 3) + 0.0).alias(f"lab_{c}") for c in "lab"]),
    Q.PX + "SELECT frame_id, x, y, " + ", ".join(f"round({e}, 3) + 0.0::DOUBLE AS lab_{n}" for e, n in zip(_lab("argb"), "lab", strict=True)) + f" FROM px WHERE {A} > 0",
)

# geometry
as_pixels("flip_h", raster.flip_h, Q.moved("7 - o.x", "o.y"))
as_pixels("flip_v", raster.flip_v, Q.moved("o.x", "7 - o.y"))
as_pixels("rot90", raster.rot90, Q.moved("o.y", "7 - o.x"))
as_pixels("rot90_ccw", lambda fr: raster.rot90(fr, False), Q.moved("7 - o.y", "o.x"))
as_pixels("rot180", raster.rot180, Q.moved("7 - o.x", "7 - o.y"))
as_pixels("shift", lambda fr: raster.shifted(fr, 2, -1), Q.moved("o.x - 2", "o.y + 1"))
as_pixels("crop", lambda fr: raster.region(fr, 2, 3, 5, 7), Q.moved("o.x + 2", "o.y + 3", "5", "7"))
as_pixels("pad", lambda fr: raster.padded(fr, 1, 2, 3, 0), Q.moved("o.x - 1", "o.y - 2", "12", "10"))
as_pixels("scale_nearest", lambda fr: raster.scaled(fr, 3), Q.moved("o.x // 3", "o.y // 3", "24", "24"))
as_pixels("resample_nearest", lambda fr: raster.resampled(fr, 5, 11), Q.moved("CAST(floor((o.x + 0.5::DOUBLE) * 8 / 5) AS INTEGER)", "CAST(floor((o.y + 0.5::DOUBLE) * 8 / 11) AS INTEGER)", "5", "11"))
as_pixels("resample_corners", lambda fr: raster.resampled(fr, 5, 11, centred=False), Q.moved("o.x * 8 // 5", "o.y * 8 // 11", "5", "11"))
as_pixels(
    "downscale_int",
    lambda fr: raster.block_means(fr, 2),
    Q.PX
    + f""", m AS (SELECT frame_id, x // 2 AS x, y // 2 AS y, sum({A}) AS sa, sum({R} * {A} // 255) AS sr, sum({G} * {A} // 255) AS sg, sum({B} * {A} // 255) AS sb FROM px GROUP BY ALL)
 SELECT frame_id, CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, CASE WHEN (sa + 2) // 4 = 0 THEN 0 ELSE {Q.pack('(sa + 2) // 4', *[Q.clamp(f'CAST(trunc({s} / sa::DOUBLE * 255.0::DOUBLE) AS BIGINT)') for s in ('sr', 'sg', 'sb')])} END AS argb FROM m""",
)
as_pixels(
    "scale2x",
    raster.scale2x,
    Q.PX
    + """, n AS (SELECT p.frame_id, p.x, p.y, p.argb AS e, coalesce(u.argb, p.argb) AS b, coalesce(l.argb, p.argb) AS d, coalesce(r.argb, p.argb) AS f, coalesce(w.argb, p.argb) AS h FROM px p
 LEFT JOIN px u ON u.frame_id = p.frame_id AND u.x = p.x AND u.y = p.y - 1 LEFT JOIN px w ON w.frame_id = p.frame_id AND w.x = p.x AND w.y = p.y + 1
 LEFT JOIN px l ON l.frame_id = p.frame_id AND l.y = p.y AND l.x = p.x - 1 LEFT JOIN px r ON r.frame_id = p.frame_id AND r.y = p.y AND r.x = p.x + 1)
 SELECT frame_id, 2 * x AS x, 2 * y AS y, CASE WHEN d = b AND d <> h AND b <> f THEN d ELSE e END AS argb FROM n
 UNION ALL SELECT frame_id, 2 * x + 1, 2 * y, CASE WHEN b = f AND b <> d AND f <> h THEN b ELSE e END FROM n
 UNION ALL SELECT frame_id, 2 * x, 2 * y + 1, CASE WHEN d = h AND d <> b AND h <> f THEN d ELSE e END FROM n
 UNION ALL SELECT frame_id, 2 * x + 1, 2 * y + 1, CASE WHEN h = f AND d <> h AND b <> f THEN h ELSE e END FROM n""",
)

# aggregates
on_frames("histogram", lambda fr: measures.histogram(fr), Q.HIST + "SELECT frame_id, channel, CAST(bin AS INTEGER) AS bin, cnt FROM hist")
on_frames(
    "hist_stats",
    lambda fr: measures.histogram_stats(measures.histogram(fr)).select("frame_id", "channel", "n", *[F.round(c, 6).alias(c) for c in ("mean", "variance", "entropy")], "mode"),
    Q.HIST
    + """, t AS (SELECT *, sum(cnt) OVER (PARTITION BY frame_id, channel) AS total FROM hist)
 SELECT frame_id, channel, CAST(sum(cnt) AS BIGINT) AS n, round(sum(bin * cnt) / sum(cnt)::DOUBLE, 6) AS mean,
 round(sum(bin * bin * cnt) / sum(cnt)::DOUBLE - (sum(bin * cnt) / sum(cnt)::DOUBLE) * (sum(bin * cnt) / sum(cnt)::DOUBLE), 6) AS variance,
 round(sum(-(cnt / total::DOUBLE) * log2(cnt / total::DOUBLE)), 6) AS entropy, CAST(arg_max(bin, cnt * 1000 - bin) AS INTEGER) AS mode FROM t GROUP BY frame_id, channel""",
)
on_frames(
    "hist_percentile",
    lambda fr: measures.percentiles(measures.histogram(fr), [0.05, 0.5, 0.95]),
    Q.HIST
    + """, c AS (SELECT *, sum(cnt) OVER (PARTITION BY frame_id, channel ORDER BY bin) AS upto, sum(cnt) OVER (PARTITION BY frame_id, channel) AS total FROM hist)
 SELECT frame_id, channel, """
    + ", ".join(f"CAST(min(bin) FILTER (upto >= greatest(1, ceil({f}::DOUBLE * total))) AS INTEGER) AS p{round(f * 100)}" for f in (0.05, 0.5, 0.95))
    + " FROM c GROUP BY frame_id, channel",
)
on_frames(
    "otsu",
    lambda fr: measures.otsu(measures.histogram(fr)),
    Q.HIST
    + """, c AS (SELECT frame_id, bin, sum(cnt) OVER u::DOUBLE AS w0, sum(bin * cnt) OVER u::DOUBLE AS s0, sum(cnt) OVER w::DOUBLE AS n, sum(bin * cnt) OVER w::DOUBLE AS s FROM hist WHERE channel = 'luma' WINDOW u AS (PARTITION BY frame_id ORDER BY bin), w AS (PARTITION BY frame_id)),
 v AS (SELECT frame_id, bin, CASE WHEN n > w0 AND bin < 255 THEN w0 * (n - w0) * (s0 / w0 - (s - s0) / (n - w0)) * (s0 / w0 - (s - s0) / (n - w0)) END AS score FROM c),
 k AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY score DESC NULLS LAST, bin) AS rn FROM v)
 SELECT frame_id, CAST(CASE WHEN score IS NULL THEN 0 ELSE bin END AS INTEGER) AS threshold FROM k WHERE rn = 1""",
)
_TALLY = Q.PX + f", t AS (SELECT frame_id, argb, count(*) AS cnt FROM px WHERE {A} > 0 GROUP BY ALL)\n"
on_frames(
    "census",
    measures.census,
    _TALLY + f", k AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY cnt DESC, argb) AS rank FROM t) SELECT frame_id, CAST(rank AS INTEGER) AS rank, argb, {Q.hex_colour('argb')} AS hex, {Q.family('argb')} AS family, cnt FROM k WHERE rank <= 64",
)
on_frames("family_rollup", measures.families, _TALLY + f"SELECT frame_id, {Q.family('argb')} AS family, count(*) AS shades, CAST(sum(cnt) AS BIGINT) AS cnt FROM t GROUP BY ALL")
on_frames("content_box", measures.content_box, Q.PX + f"SELECT frame_id, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height FROM px WHERE {A} > 0 GROUP BY frame_id")
on_frames(
    "occupancy_grid",
    lambda fr: measures.occupancy(fr, 4),
    Q.PX
    + f""", o AS (SELECT frame_id, x // 2 AS gx, y // 2 AS gy, count(*) FILTER ({A} > 0) AS seen, count(*) AS total FROM px GROUP BY ALL)
 SELECT frame_id, CAST(gx AS INTEGER) AS gx, CAST(gy AS INTEGER) AS gy, CAST(CASE WHEN seen = 0 THEN 0 WHEN seen * 4 <= total THEN 1 WHEN seen * 2 <= total THEN 2 WHEN seen * 4 <= total * 3 THEN 3 ELSE 4 END AS INTEGER) AS level FROM o""",
)
_BALANCE = ", ".join(f"avg({v}) AS m{n}" for v, n in ((R, "r"), (G, "g"), (B, "b")))
as_pixels(
    "white_balance",
    measures.white_balanced,
    Q.PX
    + f""", m AS (SELECT frame_id, {_BALANCE} FROM px WHERE {A} > 0 GROUP BY frame_id), k AS (SELECT *, (mr + mg + mb) / 3.0::DOUBLE AS t FROM m)
 SELECT px.frame_id, x, y, CASE WHEN {A} = 0 OR t IS NULL OR t <= 0 THEN argb ELSE {Q.pack(A, *[Q.clamp(f'CAST(trunc({v} + ({v} * (t / greatest({m}, 1.0::DOUBLE)) - {v}) * 1.0::DOUBLE) AS BIGINT)') for v, m in ((R, 'mr'), (G, 'mg'), (B, 'mb'))])} END AS argb FROM px LEFT JOIN k USING (frame_id)""",
)
_LUT = f"({Q.luma('argb')})"
_WANT = Q.clamp(f"CAST(floor(least(1.0::DOUBLE, greatest(0.0::DOUBLE, ({_LUT} - lo) / (hi - lo)::DOUBLE)) * 255 + 0.5::DOUBLE) AS BIGINT)")
as_pixels(
    "autolevels",
    measures.stretched,
    Q.HIST
    + f""", c AS (SELECT *, sum(cnt) OVER (PARTITION BY frame_id, channel ORDER BY bin) AS upto, sum(cnt) OVER (PARTITION BY frame_id, channel) AS total FROM hist WHERE channel = 'luma'),
 q AS (SELECT frame_id, min(bin) FILTER (upto >= greatest(1, ceil(0.01::DOUBLE * total))) AS lo, min(bin) FILTER (upto >= greatest(1, ceil(0.99::DOUBLE * total))) AS hi FROM c GROUP BY frame_id),
 w AS (SELECT px.frame_id, x, y, argb, {_LUT} AS now, CASE WHEN hi > lo THEN {_WANT} END AS want FROM px LEFT JOIN q USING (frame_id))
 SELECT frame_id, x, y, CASE WHEN {A} = 0 OR want IS NULL OR want = now THEN argb WHEN now = 0 THEN {Q.pack(A, 'want', 'want', 'want')} ELSE {Q.pack(A, *[Q.clamp(f'CAST(floor({v} * (want / now::DOUBLE) + 0.5::DOUBLE) AS BIGINT)') for v in (R, G, B)])} END AS argb FROM w""",
)

# pairs
_BOTH = f"({Q.a('a')} > 0 AND {Q.a('b')} > 0)"
_SUMS = ", ".join(f"sum(CASE WHEN {_BOTH} THEN abs({f('a')} - {f('b')}) ELSE 0 END) AS s{n}" for n, f in (("r", Q.r), ("g", Q.g), ("b", Q.b)))
_SQ = " + ".join(f"({f('a')} - {f('b')}) * ({f('a')} - {f('b')})" for f in (Q.r, Q.g, Q.b))


def _mean(total: str, k: int) -> str:
    return f"round(CASE WHEN compared = 0 THEN NULL ELSE ({total}) / (compared * {k})::DOUBLE END, 6)"


def _metrics(p: DataFrame) -> DataFrame:
    """Metrics with NaN and infinity as nulls, for the comparison."""
    found = pairs.metrics(p)
    finite = lambda c: F.when(F.isnan(c) | (F.col(c) == float("inf")), F.lit(None)).otherwise(F.round(c, 6)).alias(c)
    return found.select("frame_id", "compared", "changed", "total", *[finite(c) for c in ("mae_r", "mae_g", "mae_b", "mae")], "max_delta", "opacity_mismatches", finite("psnr"))


on_pairs(
    "frame_metrics",
    _metrics,
    Q.PAIRS
    + f""", s AS (SELECT frame_id, count(*) FILTER ({_BOTH}) AS compared, count(*) FILTER (a <> b) AS changed, count(*) AS total, {_SUMS}, sum(CASE WHEN {_BOTH} THEN {_SQ} ELSE 0 END) AS sq,
 max(CASE WHEN {_BOTH} THEN {Q.chebyshev('a', 'b')} ELSE 0 END) AS max_delta, count(*) FILTER (({Q.a('a')} > 0) <> ({Q.a('b')} > 0)) AS opacity_mismatches FROM pr GROUP BY frame_id)
 SELECT frame_id, compared, changed, total, {_mean('sr', 1)} AS mae_r, {_mean('sg', 1)} AS mae_g, {_mean('sb', 1)} AS mae_b, {_mean('sr + sg + sb', 3)} AS mae, CAST(max_delta AS INTEGER) AS max_delta, opacity_mismatches,
 round(CASE WHEN compared = 0 OR sq = 0 THEN NULL ELSE 10 * log10(65025.0::DOUBLE / (sq / (compared * 3)::DOUBLE)) END, 6) AS psnr FROM s""",
)
_KIND = f"CASE WHEN {Q.a('a')} = 0 AND {Q.a('b')} = 0 THEN 'unchanged' WHEN {Q.a('a')} = 0 THEN 'added' WHEN {Q.a('b')} = 0 THEN 'removed' WHEN a <> b THEN 'changed' ELSE 'unchanged' END"
on_pairs("diff_boxes", pairs.diff, Q.PAIRS + f"SELECT frame_id, {_KIND} AS kind, count(*) AS cnt, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height FROM pr GROUP BY ALL")
on_pairs(
    "transitions_topk",
    pairs.transitions,
    Q.PAIRS + f", t AS (SELECT frame_id, a AS from_argb, b AS to_argb, count(*) AS cnt FROM pr WHERE {_KIND} = 'changed' GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY cnt DESC, from_argb, to_argb) AS rank FROM t) SELECT frame_id, from_argb, to_argb, cnt, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 16",
)
on_pairs(
    "diff_mask",
    lambda p: S.pixels(pairs.diff_mask(p, 40)),
    Q.PAIRS + f"SELECT frame_id, x, y, CAST(CASE WHEN {Q.a('a')} = 0 AND {Q.a('b')} = 0 THEN 0 WHEN {_BOTH} AND {Q.chebyshev('a', 'b')} <= 40 THEN -16711936 ELSE -65536 END AS INTEGER) AS argb FROM pr",
)
on_pairs("mask_by", lambda p: S.pixels(pairs.masked(p)), Q.PAIRS + f"SELECT frame_id, x, y, CASE WHEN {Q.a('b')} > 0 THEN a ELSE 0 END AS argb FROM pr")
_FADED = Q.pack(f"({Q.a('b')} * 153 // 255)", Q.r("b"), Q.g("b"), Q.b("b"))
for _mode, _channel in Q.BLENDS.items():
    on_pairs(
        f"blend_{_mode}",
        lambda p, m=_mode: S.pixels(pairs.blend(p, m, 0.6)),
        Q.PAIRS + f", fd AS (SELECT frame_id, x, y, a, {_FADED} AS f FROM pr) SELECT frame_id, x, y, CAST({Q.over('f', 'a', _channel)} AS INTEGER) AS argb FROM fd",
    )
_MIRRORS = {"horizontal": ("7 - p.x", "p.y"), "vertical": ("p.x", "7 - p.y"), "rot180": ("7 - p.x", "7 - p.y"), "diagonal": ("p.y", "p.x"), "anti_diagonal": ("7 - p.y", "7 - p.x")}
for _kind, (_mx, _my) in _MIRRORS.items():
    on_frames(
        f"symmetry_{_kind}",
        lambda fr, k=_kind: pairs.symmetry(fr, k, 10),
        Q.PX
        + f""", m AS (SELECT p.frame_id, {Q.a('p.argb')} > 0 AS s, {Q.a('q.argb')} > 0 AS t, {Q.chebyshev('p.argb', 'q.argb')} AS d FROM px p JOIN px q ON q.frame_id = p.frame_id AND q.x = {_mx} AND q.y = {_my} WHERE q.x > p.x OR (q.x = p.x AND q.y > p.y))
 SELECT f.frame_id, '{_kind}' AS kind, CAST(count(*) FILTER (s OR t) AS INTEGER) AS compared, CAST(count(*) FILTER (s <> t OR (s AND t AND d > 10)) AS INTEGER) AS mismatched FROM (SELECT DISTINCT frame_id FROM px) f LEFT JOIN m USING (frame_id) GROUP BY f.frame_id""",
    )

# stencils
_ON_N = f"count(n.x) FILTER ({Q.a('n.argb')} > 0)"
_ON_4 = f"count(n.x) FILTER ({Q.a('n.argb')} > 0 AND (n.x = p.x OR n.y = p.y))"
_PA = Q.a("p.argb")
_TAP = "(n.y - p.y) * 3 + (n.x - p.x)"
as_pixels("dilate", raster.dilate, Q.around(f"CAST(CASE WHEN {_PA} > 0 THEN p.argb ELSE coalesce(arg_min(n.argb, {_TAP}) FILTER ({Q.a('n.argb')} > 0), 0) END AS INTEGER) AS argb"))
as_pixels("erode", raster.erode, Q.around(f"CASE WHEN {_PA} > 0 AND {_ON_N} = 8 THEN p.argb ELSE 0 END AS argb"))
as_pixels("erode_cross", lambda fr: raster.erode(fr, raster.CROSS3), Q.around(f"CASE WHEN {_PA} > 0 AND {_ON_4} = 4 THEN p.argb ELSE 0 END AS argb"))
as_pixels("despeckle", raster.without_isolated, Q.around(f"CASE WHEN {_PA} > 0 AND {_ON_N} = 0 THEN 0 ELSE p.argb END AS argb"))
as_pixels("despeckle_orthogonal", lambda fr: raster.without_isolated(fr, True), Q.around(f"CASE WHEN {_PA} > 0 AND {_ON_4} = 0 THEN 0 ELSE p.argb END AS argb"))
as_pixels("outline_mask", raster.outline_mask, Q.around(f"CASE WHEN {_PA} > 0 AND {_ON_N} < 8 THEN p.argb ELSE 0 END AS argb"))
as_pixels("outline_outer", lambda fr: raster.outlined(fr, -65536), Q.around(f"CAST(CASE WHEN {_PA} < 128 AND count(n.x) FILTER ({Q.a('n.argb')} >= 128) > 0 THEN -65536 ELSE p.argb END AS INTEGER) AS argb"))
as_pixels("outline_inner", lambda fr: raster.outlined(fr, -65536, inner=True), Q.around(f"CAST(CASE WHEN {_PA} >= 128 AND count(n.x) FILTER ({Q.a('n.argb')} >= 128) < 8 THEN -65536 ELSE p.argb END AS INTEGER) AS argb"))
as_pixels("open", raster.opened)
as_pixels("close", raster.closed)
as_pixels("cleanup", raster.cleaned)
as_pixels("grow_region", lambda fr: raster.grown(fr, -256), Q.around(f"CAST(CASE WHEN {_PA} = 0 AND {_ON_4} > 0 THEN -256 ELSE p.argb END AS INTEGER) AS argb"))
_SAME = lambda p, q: f"coalesce({Q.a(p)} > 0 AND {Q.a(q)} > 0 AND {Q.chebyshev(p, q)} <= 0, false)"
on_frames(
    "audit",
    raster.audited,
    Q.PX
    + f""", k AS (SELECT p.*, tr.argb AS tr, bl.argb AS bl, br.argb AS br FROM px p LEFT JOIN px tr ON tr.frame_id = p.frame_id AND tr.x = p.x + 1 AND tr.y = p.y LEFT JOIN px bl ON bl.frame_id = p.frame_id AND bl.x = p.x AND bl.y = p.y + 1 LEFT JOIN px br ON br.frame_id = p.frame_id AND br.x = p.x + 1 AND br.y = p.y + 1),
 c AS (SELECT p.frame_id, p.x, p.y, p.argb, count(n.x) FILTER ({Q.a('n.argb')} > 0 AND {Q.chebyshev('p.argb', 'n.argb')} <= 0) AS alike, {_ON_4} AS straight, {_ON_N} AS near FROM px p LEFT JOIN px n ON n.frame_id = p.frame_id AND abs(n.x - p.x) <= 1 AND abs(n.y - p.y) <= 1 AND (n.x <> p.x OR n.y <> p.y) WHERE {_PA} > 0 GROUP BY ALL)
 SELECT frame_id, 'isolated_pixel' AS rule, x, y, argb FROM c WHERE alike = 0
 UNION ALL SELECT frame_id, 'stair_zigzag', x, y, argb FROM c WHERE straight = 0 AND near > 0
 UNION ALL SELECT frame_id, 'broken_corner', x, y, argb FROM k WHERE {_SAME('argb', 'br')} AND NOT ({_SAME('tr', 'argb')} OR {_SAME('bl', 'argb')} OR {_SAME('tr', 'br')} OR {_SAME('bl', 'br')})
 UNION ALL SELECT frame_id, 'accidental_checker', x, y, argb FROM k WHERE {A} > 0 AND argb = br AND NOT ({Q.a('tr')} > 0 AND tr = argb) AND NOT ({Q.a('bl')} > 0 AND bl = argb) AND NOT ({Q.a('tr')} > 0 AND {Q.a('bl')} > 0 AND tr = bl)""",
)
as_pixels("palette_map", lambda fr: raster.palette_mapped(fr, PALETTE))
as_pixels("ordered_dither_bayer4", lambda fr: raster.bayer(fr, PALETTE, 4))
as_pixels("checker_dither", lambda fr: raster.checkered(fr, PALETTE))

# graphs
_REACH = """, reach(frame_id, src, x, y) AS (SELECT frame_id, y * 8 + x, x, y FROM px WHERE {on}
 UNION SELECT r.frame_id, r.src, n.x, n.y FROM reach r JOIN px o ON o.frame_id = r.frame_id AND o.x = r.x AND o.y = r.y JOIN px n ON n.frame_id = r.frame_id AND abs(n.x - r.x) + abs(n.y - r.y) = 1 AND {n_on} AND {same}),
 lab AS (SELECT frame_id, x, y, min(src) AS head FROM reach GROUP BY ALL)"""


def _components(same: str) -> str:
    return Q.PX + _REACH.format(on=f"{A} > 0", n_on=f"{Q.a('n.argb')} > 0", same=same)


for _name, _same, _flag in (("components", "true", False), ("same_colour_components", "n.argb = o.argb", True)):
    on_frames(
        _name,
        lambda fr, s=_flag: sequential.exploded_labels(sequential.components(fr, same_colour=s)),
        _components(_same) + "SELECT frame_id, CAST(dense_rank() OVER (PARTITION BY frame_id ORDER BY head) AS INTEGER) AS label, count(*) AS area, CAST(min(x) AS INTEGER) AS x, CAST(min(y) AS INTEGER) AS y, CAST(max(x) - min(x) + 1 AS INTEGER) AS width, CAST(max(y) - min(y) + 1 AS INTEGER) AS height FROM lab GROUP BY frame_id, head",
    )
_AREAS = _components("true") + ", ar AS (SELECT frame_id, head, count(*) AS area FROM lab GROUP BY ALL)"
as_pixels("remove_small", lambda fr: sequential.without_small(fr, 4), _AREAS + " SELECT px.frame_id, px.x, px.y, CASE WHEN area < 4 THEN 0 ELSE argb END AS argb FROM px LEFT JOIN lab USING (frame_id, x, y) LEFT JOIN ar USING (frame_id, head)")
as_pixels("keep_largest", sequential.largest, _AREAS + ", top AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY area DESC, head) AS rn FROM ar) SELECT px.frame_id, px.x, px.y, CASE WHEN rn = 1 THEN argb ELSE 0 END AS argb FROM px LEFT JOIN lab USING (frame_id, x, y) LEFT JOIN top USING (frame_id, head)")
as_pixels(
    "flood_fill",
    lambda fr: sequential.flooded(fr, 3, 3, -65281, 85),
    Q.PX
    + f""", seed AS (SELECT frame_id, argb AS s FROM px WHERE x = 3 AND y = 3), ok AS (SELECT px.* FROM px JOIN seed USING (frame_id) WHERE abs({A} - {Q.a('s')}) <= 85 AND {Q.chebyshev('argb', 's')} <= 85),
 area(frame_id, x, y) AS (SELECT frame_id, x, y FROM ok WHERE x = 3 AND y = 3 UNION SELECT n.frame_id, n.x, n.y FROM area r JOIN ok n ON n.frame_id = r.frame_id AND abs(n.x - r.x) + abs(n.y - r.y) = 1)
 SELECT px.frame_id, px.x, px.y, CAST(CASE WHEN area.x IS NOT NULL THEN -65281 ELSE argb END AS INTEGER) AS argb FROM px LEFT JOIN area USING (frame_id, x, y)""",
)
as_pixels("fill_holes", sequential.holes_filled)

# timelines
on_frames("breathe", lambda fr: S.pixels(timeline.breathe(fr).withColumn("frame_id", F.col("frame_id") * 3 + F.col("phase"))), Q.PX + ", " + "g AS (SELECT DISTINCT frame_id FROM px), c AS (SELECT g.frame_id, CAST(a.v AS INTEGER) AS x, CAST(b.v AS INTEGER) AS y, k.v AS k FROM g, (SELECT unnest(range(0, 8)) AS v) a, (SELECT unnest(range(0, 8)) AS v) b, (SELECT unnest(range(0, 3)) AS v) k) SELECT c.frame_id * 3 + c.k AS frame_id, c.x, c.y, coalesce(p.argb, 0) AS argb FROM c LEFT JOIN px p ON p.frame_id = c.frame_id AND p.x = c.x AND p.y = c.y - (CASE c.k WHEN 1 THEN 1 WHEN 2 THEN -1 ELSE 0 END)")
on_frames(
    "fade",
    lambda fr: timeline.fade(fr).select("frame_id", "step", "w", F.posexplode_outer("pixels").alias("i", "argb")).select("frame_id", "step", (F.col("i") % F.col("w")).cast("int").alias("x"), C.idiv(F.col("i"), F.col("w")).alias("y"), "argb"),
    Q.PX + f"SELECT frame_id, CAST(s.v AS INTEGER) AS step, x, y, {Q.pack(f'({A} * ((3 - s.v) * 255 // 3) // 255)', R, G, B)} AS argb FROM px, (SELECT unnest(range(0, 4)) AS v) s",
)
on_frames(
    "typewriter",
    lambda fr: timeline.typewriter(fr).select("frame_id", "step", "w", F.posexplode_outer("pixels").alias("i", "argb")).select("frame_id", "step", (F.col("i") % F.col("w")).cast("int").alias("x"), C.idiv(F.col("i"), F.col("w")).alias("y"), "argb"),
    Q.PX + "SELECT frame_id, CAST(s.v AS INTEGER) AS step, x, y, CASE WHEN y <= s.v THEN argb ELSE 0 END AS argb FROM px, (SELECT unnest(range(0, 8)) AS v) s",
)
on_frames(
    "onion_skin",
    lambda fr: timeline.onion_skin(fr).select("frame_id", "side", "w", F.posexplode_outer("pixels").alias("i", "argb")).select("frame_id", "side", (F.col("i") % F.col("w")).cast("int").alias("x"), C.idiv(F.col("i"), F.col("w")).alias("y"), "argb"),
    Q.PX
    + f""", o AS (SELECT frame_id, lag(frame_id) OVER w AS p, lead(frame_id) OVER w AS n FROM (SELECT DISTINCT frame_id, tag FROM px) WINDOW w AS (PARTITION BY tag ORDER BY frame_id))
 SELECT o.frame_id, 'previous' AS side, x, y, {Q.pack(f'({A} * 102 // 255)', R, G, B)} AS argb FROM o JOIN px ON px.frame_id = o.p
 UNION ALL SELECT o.frame_id, 'next', x, y, {Q.pack(f'({A} * 51 // 255)', R, G, B)} FROM o JOIN px ON px.frame_id = o.n""",
)
on_frames("sheet_layout", lambda fr: timeline.sheet(fr, 8, 1), Q.PX + ", f AS (SELECT DISTINCT frame_id, tag FROM px), k AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY frame_id) - 1 AS place FROM f) SELECT frame_id, tag, CAST(place % 8 * 9 + 1 AS INTEGER) AS x, CAST(place // 8 * 9 + 1 AS INTEGER) AS y, 8 AS w, 8 AS h FROM k")


def _composite(s: SparkSession, d: str) -> DataFrame:
    """Ten layers by tag, a project frame for each ten vectors; the first vector
    of a tag among them is the cel."""
    fr = frames(s, d)
    cels = fr.withColumn("frame_idx", F.floor(F.col("frame_id") / 10)).groupBy("frame_idx", F.col("tag").alias("layer_id"), "w", "h").agg(F.min_by("pixels", "frame_id").alias("pixels"))
    layers = s.createDataFrame([(i, i, 0.1 * (i + 1), i != 4) for i in range(10)], "layer_id int, place int, opacity float, visible boolean")
    out = pairs.composited(cels, layers).withColumnRenamed("frame_idx", "frame_id")
    return S.pixels(out)


add("composite", _composite)

# the log
add("oplog_last_writer", lambda s, d: S.last_writes(S.writes_from_lineitem(S.table(s, d, "lineitem"))), Q.LWRITES + "SELECT frame_id, x, y, arg_max(argb, (o1, o2, argb)) AS argb FROM log GROUP BY frame_id, x, y")
add("oplog_as_of", lambda s, d: log.as_of(log.from_events(S.table(s, d, "events")), 50), Q.OPLOG + ", k AS (SELECT *, row_number() OVER (PARTITION BY session, kind ORDER BY serial DESC) AS rn FROM log WHERE serial <= 50) SELECT session, kind, CAST(serial AS INTEGER) AS serial, k FROM k WHERE rn = 1")
add(
    "coalesce_runs",
    lambda s, d: log.coalesced(log.from_events(S.table(s, d, "events"))),
    Q.OPLOG
    + """, f AS (SELECT *, CASE WHEN kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY session ORDER BY serial) THEN 1 ELSE 0 END AS fresh FROM log),
 n AS (SELECT *, sum(fresh) OVER (PARTITION BY session ORDER BY serial) AS entry FROM f)
 SELECT session, CAST(entry AS BIGINT) AS entry, kind, CAST(min(serial) AS INTEGER) AS first, CAST(max(serial) AS INTEGER) AS last, count(*) AS edits FROM n GROUP BY session, entry, kind""",
)
add("checkpoints", lambda s, d: log.checkpoints(log.from_events(S.table(s, d, "events"))).drop("ts"), Q.OPLOG + "SELECT session, CAST(serial AS INTEGER) AS serial, CAST(serial - coalesce(lag(serial) OVER (PARTITION BY session ORDER BY serial), 0) AS INTEGER) AS since FROM log WHERE serial % 10 = 0")
add(
    "layer_histogram",
    lambda s, d: S.last_writes(S.writes_from_lineitem(S.table(s, d, "lineitem"))).groupBy("frame_id", C.family(F.col("argb")).alias("family")).agg(F.count("*").alias("cnt")),
    Q.LWRITES + f", px AS (SELECT frame_id, x, y, arg_max(argb, (o1, o2, argb)) AS argb FROM log GROUP BY frame_id, x, y) SELECT frame_id, {Q.family('argb')} AS family, count(*) AS cnt FROM px GROUP BY ALL",
)

# sequential kernels
on_frames("fingerprint", sequential.fingerprints)
as_pixels("dither_fs", lambda fr: sequential.diffused(fr, PALETTE))
as_pixels("dither_atkinson", lambda fr: sequential.diffused(fr, PALETTE, "atkinson"))
as_pixels("median_cut", lambda fr: sequential.quantized(fr, 6))
as_pixels("recipe_run", lambda fr: recipe.run(fr, recipe.EXAMPLE))


# filters
def _clamped(kernel: filters.Kernel, name: str) -> str:
    """c(frame_id, x, y, p, v): the taps of a kernel with borders repeated."""
    taps = ", ".join(f"({dx}, {dy}, {v!r}::DOUBLE)" for dx, dy, v in kernel.taps() if v)
    return f""", {name} AS (SELECT p.frame_id, p.x, p.y, p.argb, {', '.join(f'sum(CASE WHEN n.argb = 0 THEN 0 ELSE {f("n.argb")} END * t.k) AS s{c}' for c, f in (('r', Q.r), ('g', Q.g), ('b', Q.b)))}
 FROM px p, (VALUES {taps}) t(dx, dy, k), px n WHERE n.frame_id = p.frame_id AND n.x = least(7, greatest(0, p.x + t.dx)) AND n.y = least(7, greatest(0, p.y + t.dy)) GROUP BY ALL)"""


def _half_up(v: str) -> str:
    return Q.clamp(f"CAST(trunc({v} + 0.5::DOUBLE) AS BIGINT)")


for _name in ("sharpen", "laplacian", "emboss", "prewitt_x"):
    as_pixels(
        f"convolve_{_name}",
        lambda fr, k=_name: filters.convolved(fr, filters.KERNELS[k], alpha="straight"),
        Q.PX + _clamped(filters.KERNELS[_name], "c") + f" SELECT frame_id, x, y, CASE WHEN {A} = 0 THEN 0 ELSE {Q.pack(A, *[_half_up(f's{c}') for c in 'rgb'])} END AS argb FROM c",
    )
_GREY = {n: Q.clamp(f"CAST(floor(0.2126::DOUBLE * {_half_up(n + '.sr')} + 0.7152::DOUBLE * {_half_up(n + '.sg')} + 0.0722::DOUBLE * {_half_up(n + '.sb')} + 0.5::DOUBLE) AS BIGINT)") for n in ("gx", "gy")}
as_pixels(
    "sobel",
    filters.sobel,
    Q.PX
    + _clamped(filters.KERNELS["sobel_x"], "gx")
    + _clamped(filters.KERNELS["sobel_y"], "gy")
    + f", m AS (SELECT gx.frame_id, gx.x, gx.y, gx.argb, {_half_up(f'sqrt(({_GREY["gx"]} * {_GREY["gx"]} + {_GREY["gy"]} * {_GREY["gy"]})::DOUBLE)')} AS m FROM gx JOIN gy USING (frame_id, x, y)) SELECT frame_id, x, y, CASE WHEN {A} = 0 THEN 0 ELSE {Q.pack(A, 'm', 'm', 'm')} END AS argb FROM m",
)
as_pixels("gaussian3", lambda fr: filters.convolved(fr, filters.KERNELS["gaussian3"]))
as_pixels("box_blur", filters.box_blurred)
as_pixels("box_resample", lambda fr: filters.box_resampled(fr, 5, 3))
_SOLID = ", ".join(f"max(CASE WHEN n.x = p.x + ({dx}) AND n.y = p.y + ({dy}) AND {Q.a('n.argb')} > 0 THEN 1 ELSE 0 END) AS b{k}" for k, (dx, dy) in enumerate(filters.BITS))
_MASKS = Q.PX + f", nb AS (SELECT p.frame_id, p.x, p.y, p.argb, {_SOLID} FROM px p LEFT JOIN px n ON n.frame_id = p.frame_id AND abs(n.x - p.x) <= 1 AND abs(n.y - p.y) <= 1 AND (n.x <> p.x OR n.y <> p.y) GROUP BY ALL)"
_BLOB = "b0 + b1 * b0 * b2 * 2 + b2 * 4 + b3 * b2 * b4 * 8 + b4 * 16 + b5 * b4 * b6 * 32 + b6 * 64 + b7 * b6 * b0 * 128"
as_pixels("autotile47", filters.autotiled, _MASKS + f" SELECT frame_id, x, y, CAST(CASE WHEN {A} = 0 THEN -1 ELSE list_position({filters.BLOBS}, {_BLOB}) - 1 END AS INTEGER) AS argb FROM nb")
as_pixels("autotile16", lambda fr: filters.autotiled(fr, edges_only=True), _MASKS + f" SELECT frame_id, x, y, CAST(CASE WHEN {A} = 0 THEN -1 ELSE b0 + b2 * 2 + b4 * 4 + b6 * 8 END AS INTEGER) AS argb FROM nb")
as_pixels("cave_smooth", lambda fr: filters.cave_step(raster.mapped(fr, lambda p: F.when(C.alpha(p) == 0, F.lit(C.BLACK)).otherwise(F.lit(0)))), Q.around(f"CAST(CASE WHEN 8 - count(n.x) + count(n.x) FILTER ({Q.a('n.argb')} = 0) >= 5 THEN -16777216 ELSE 0 END AS INTEGER) AS argb"))
_TINT = [v / 255.0 for v in filters.kelvin(3200.0)]
_GAINS = [repr(v / (sum(_TINT) / 3)) + "::DOUBLE" for v in _TINT]
as_pixels("temperature", lambda fr: filters.warmed(fr, 3200.0, 0.8), Q.mapped(f"CASE WHEN {A} = 0 THEN argb ELSE {Q.pack(A, *[Q.clamp(f'CAST(trunc({v} + ({v} * {k} - {v}) * 0.8::DOUBLE) AS BIGINT)') for v, k in zip((R, G, B), _GAINS, strict=True)])} END"))

# generators
_GRID = "SELECT CAST(0 AS BIGINT) AS frame_id, CAST(a.v AS INTEGER) AS x, CAST(b.v AS INTEGER) AS y, CAST({rule} AS INTEGER) AS argb FROM (SELECT unnest(range(0, {w})) AS v) a, (SELECT unnest(range(0, {h})) AS v) b"
add("checker_tex", lambda s, d: S.pixels(generate.checker(s, 40, 30, 4, -1, -65536)), _GRID.format(w=40, h=30, rule="CASE WHEN (a.v // 4 + b.v // 4) % 2 = 0 THEN -1 ELSE -65536 END"))
add("bricks_mask", lambda s, d: S.pixels(generate.bricks(s, 50, 40)), _GRID.format(w=50, h=40, rule="CASE WHEN b.v % 5 >= 4 OR (a.v + b.v // 5 % 2 * 4) % 9 >= 8 THEN -16777216 ELSE -65536 END"))
add("iso_mask", lambda s, d: S.pixels(generate.diamond(s, 16, 8)), _GRID.format(w=16, h=8, rule="CASE WHEN abs(b.v - 4) * 8 + abs(a.v - 8) * 4 <= 32 THEN -1 ELSE 0 END"))

# palettes and spans
_PALETTE = f"(SELECT unnest(range(0, {len(PALETTE)})) AS idx, unnest({PALETTE}) AS colour)"


def _closest(s: SparkSession, d: str) -> DataFrame:
    """Shades of all rasters with the nearest palette entry, the first of equals;
    the palette is of fixed size and is broadcast."""
    shades = measures.visible(S.pixels(frames(s, d))).groupBy("argb").agg(F.count("*").alias("cnt"))
    palette = s.createDataFrame(list(enumerate(PALETTE)), "idx int, colour int")
    best = F.min(F.struct(C.squared_rgb(F.col("argb"), F.col("colour")).alias("distance"), "idx")).alias("m")
    return shades.crossJoin(F.broadcast(palette)).groupBy("argb", "cnt").agg(best).select("argb", "cnt", "m.idx", "m.distance")


_DIST = " + ".join(f"({f('argb')} - {f('colour')}) * ({f('argb')} - {f('colour')})" for f in (Q.r, Q.g, Q.b))
add("palette_closest_rgb", _closest, Q.PX + f", t AS (SELECT argb, count(*) AS cnt FROM px WHERE {A} > 0 GROUP BY argb), k AS (SELECT argb, cnt, idx, {_DIST} AS distance FROM t, {_PALETTE}), o AS (SELECT *, row_number() OVER (PARTITION BY argb ORDER BY distance, idx) AS rn FROM k) SELECT argb, cnt, CAST(idx AS INTEGER) AS idx, CAST(distance AS INTEGER) AS distance FROM o WHERE rn = 1")


def _contrasts(s: SparkSession, d: str) -> DataFrame:
    """Contrast of every two entries of a palette."""
    p = s.createDataFrame(list(enumerate(PALETTE)), "idx int, colour int")
    a, b = p.toDF("i", "a"), p.toDF("j", "b")
    pairs_ = a.join(F.broadcast(b), F.col("i") < F.col("j"))
    ratio = C.contrast(F.col("a"), F.col("b"))
    return pairs_.select("i", "j", F.round(ratio, 4).alias("ratio"), (ratio >= 4.5).alias("passes"))


_RATIO = f"(greatest({Q.luminance('a')}, {Q.luminance('b')}) + 0.05::DOUBLE) / (least({Q.luminance('a')}, {Q.luminance('b')}) + 0.05::DOUBLE)"
add("palette_contrast_pairs", _contrasts, f"SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round({_RATIO}, 4) AS ratio, {_RATIO} >= 4.5 AS passes FROM (SELECT idx AS i, colour AS a FROM {_PALETTE}), (SELECT idx AS j, colour AS b FROM {_PALETTE}) WHERE i < j")


def _tagged(s: SparkSession, d: str) -> DataFrame:
    """Frames of the timeline under the tags whose span holds them."""
    spans = s.createDataFrame([("idle", 0, 9), ("walk", 5, 24), ("all", 0, 100000)], "name string, start_frame long, end_frame long")
    own = frames(s, d).select(F.col("frame_id").alias("frame_idx"), "tag")
    return timeline.tagged(own, spans).groupBy("name").agg(F.count("*").alias("frames"), F.countDistinct("tag").alias("tags"))


add("tag_range_join", _tagged, "SELECT name, count(*) AS frames, count(DISTINCT label) AS tags FROM embeddings JOIN (VALUES ('idle', 0, 9), ('walk', 5, 24), ('all', 0, 100000)) t(name, a, b) ON vec_id BETWEEN a AND b GROUP BY name")


# files
def _round_trip(kind: str) -> Query:
    def query(s: SparkSession, d: str) -> DataFrame:
        back = codecs.decoded(codecs.encoded(frames(s, d), kind), "frame_id")
        return S.pixels(back.select("frame_id", "w", "h", "pixels"))

    return query


for _kind in codecs.ENCODERS:
    add(f"{_kind}_roundtrip", _round_trip(_kind), Q.mapped("argb"))

# rectangles and effects
_SAME_GRID = Q.PX + "SELECT o.frame_id, o.x, o.y, {value} AS argb FROM px o LEFT JOIN px p ON p.frame_id = o.frame_id AND p.x = {x} AND p.y = {y}"
_BOX = "o.x BETWEEN 1 AND 5 AND o.y BETWEEN 2 AND 6"
as_pixels("flip_selection_h", lambda fr: regions.flipped(fr, (1, 2, 5, 5)), _SAME_GRID.format(value="p.argb", x=f"CASE WHEN {_BOX} THEN 6 - o.x ELSE o.x END", y="o.y"))
as_pixels("flip_selection_v", lambda fr: regions.flipped(fr, (1, 2, 5, 5), vertical=True), _SAME_GRID.format(value="p.argb", x="o.x", y=f"CASE WHEN {_BOX} THEN 8 - o.y ELSE o.y END"))
as_pixels("move_selection", lambda fr: regions.moved(fr, (1, 2, 3, 3), 2, 1), _SAME_GRID.format(value="CASE WHEN o.x BETWEEN 3 AND 5 AND o.y BETWEEN 3 AND 5 THEN p.argb WHEN o.x BETWEEN 1 AND 3 AND o.y BETWEEN 2 AND 4 THEN 0 ELSE o.argb END", x="o.x - 2", y="o.y - 1"))
on_pairs("paste", lambda p: S.pixels(regions.pasted(p, 3, 2)), Q.PX + ", k AS (SELECT DISTINCT q.frame_id - 1 AS frame_id FROM px q) SELECT o.frame_id, o.x, o.y, coalesce(p.argb, o.argb) AS argb FROM px o JOIN k USING (frame_id) LEFT JOIN px p ON p.frame_id = o.frame_id + 1 AND p.x = o.x - 3 AND p.y = o.y - 2")
_PLACED = Q.PX + ", pl AS (SELECT frame_id, tag, row_number() OVER (PARTITION BY tag ORDER BY frame_id) - 1 AS place FROM (SELECT DISTINCT frame_id, tag FROM px))"
as_pixels("sway", lambda fr: regions.swayed(fr, 2, 5), _PLACED + " SELECT o.frame_id, o.x, o.y, coalesce(p.argb, 0) AS argb FROM px o JOIN pl USING (frame_id) LEFT JOIN px p ON p.frame_id = o.frame_id AND p.y = o.y AND p.x = o.x - CAST(floor(2 * sin(6.283185307179586::DOUBLE * place / 5) + 0.5::DOUBLE) AS INTEGER)")
on_frames("shake", lambda fr: S.pixels(regions.shaken(fr).withColumn("frame_id", F.col("frame_id") * 2 + F.col("step"))), Q.PX + "SELECT o.frame_id * 2 + s.v AS frame_id, o.x, o.y, coalesce(p.argb, 0) AS argb FROM px o CROSS JOIN (VALUES (0), (1)) s(v) LEFT JOIN px p ON p.frame_id = o.frame_id AND p.y = o.y AND p.x = o.x - (CASE s.v WHEN 0 THEN 1 ELSE -1 END)")
as_pixels("scanline", lambda fr: regions.scanned(fr, 0x40FFFFFF), _PLACED + f" SELECT px.frame_id, px.x, px.y, CASE WHEN px.y = place % 8 THEN {Q.over(str(0x40FFFFFF), 'argb', '{s}')} ELSE argb END AS argb FROM px JOIN pl USING (frame_id)")
as_pixels(
    "equalize",
    measures.equalized,
    Q.HIST
    + f""", c AS (SELECT frame_id, bin, sum(cnt) OVER (PARTITION BY frame_id ORDER BY bin) AS upto, sum(cnt) OVER (PARTITION BY frame_id) AS total FROM hist WHERE channel = 'luma'),
 w AS (SELECT px.frame_id, x, y, argb, {_LUT} AS now, {Q.clamp("CAST(floor((upto - 1) / greatest(1, total - 1)::DOUBLE * 255.0::DOUBLE + 0.5::DOUBLE) AS BIGINT)")} AS want FROM px LEFT JOIN c ON c.frame_id = px.frame_id AND c.bin = {_LUT})
 SELECT frame_id, x, y, CASE WHEN {A} = 0 OR want IS NULL OR want = now THEN argb WHEN now = 0 THEN {Q.pack(A, 'want', 'want', 'want')} ELSE {Q.pack(A, *[Q.clamp(f'CAST(floor({v} * (want / now::DOUBLE) + 0.5::DOUBLE) AS BIGINT)') for v in (R, G, B)])} END AS argb FROM w""",
)
on_frames("rows_text", lambda fr: text.hex_rows(S.pixels(fr)), Q.PX + f"SELECT frame_id, y, string_agg(CASE WHEN {A} = 0 THEN '.' ELSE {Q.hex_colour('argb')} END, ' ' ORDER BY x) AS text FROM px GROUP BY frame_id, y")
add(
    "shelf_pack",
    lambda s, d: regions.shelved(S.table(s, d, "part").select((F.col("p_size") % 10).alias("tag"), F.col("p_partkey").alias("name"), F.col("p_size").alias("w"), (F.col("p_partkey") % 17).cast("int").alias("h")), 100),
    "WITH b AS (SELECT p_size % 10 AS tag, p_partkey AS name, p_size AS w, CAST(p_partkey % 17 AS INTEGER) AS h FROM part), s AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY tag ORDER BY h DESC, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b) SELECT tag, name, w, h, CAST(before // 100 AS INTEGER) AS shelf, CAST(before % 100 AS INTEGER) AS x FROM s",
)

on_frames("otsu_multi", lambda fr: measures.otsu_levels(measures.histogram(fr), 4))
add("value_noise", lambda s, d: S.pixels(noise.noise_frames(s, 24, 16, PALETTE, 0.2, 3)))
_EASE_STEPS = "SELECT CAST(v AS INTEGER) AS step, v / 20.0::DOUBLE AS u FROM (SELECT unnest(range(0, 21)) AS v)"
add(
    "easing",
    lambda s, d: s.range(21).select(F.col("id").cast("int").alias("step"), *[F.round(easing.eased(F.col("id") / 20.0, n), 6).alias("step_" if n == "step" else n) for n in easing.NAMES if n != "elastic_out"]),
    f"""SELECT step, round(u, 6) AS linear, round(u * u, 6) AS ease_in, round(1 - (1 - u) * (1 - u), 6) AS ease_out, round(CASE WHEN u < 0.5 THEN 2 * u * u ELSE 1 - 2 * (1 - u) * (1 - u) END, 6) AS ease_in_out,
 round(CASE WHEN u < 1 / 2.75::DOUBLE THEN 7.5625::DOUBLE * u * u WHEN u < 2 / 2.75::DOUBLE THEN 7.5625::DOUBLE * pow(u - 1.5::DOUBLE / 2.75, 2) + 0.75 WHEN u < 2.5::DOUBLE / 2.75 THEN 7.5625::DOUBLE * pow(u - 2.25::DOUBLE / 2.75, 2) + 0.9375 ELSE 7.5625::DOUBLE * pow(u - 2.625::DOUBLE / 2.75, 2) + 0.984375 END, 6) AS bounce_out,
 CASE WHEN u < 0.5 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS step_ FROM ({_EASE_STEPS})""",
)


def _shapes(s: SparkSession, d: str) -> DataFrame:
    """A cross and a box over each raster."""
    lines = [("line", 0, 0, 7, 7, -65536), ("line", 7, 0, 0, 7, -16711936), ("rect", 2, 2, 4, 4, -16776961)]
    table = s.createDataFrame([(k, *row) for k, row in enumerate(lines)], "ord long, kind string, a int, b int, c int, d int, argb int")
    fr = frames(s, d)
    each = fr.select("frame_id").crossJoin(F.broadcast(table)).select("frame_id", *table.columns)
    return S.pixels(shapes.drawn(fr, each))


add("draw_shapes", _shapes, Q.PX + "SELECT frame_id, x, y, CAST(CASE WHEN (x IN (2, 5) AND y BETWEEN 2 AND 5) OR (y IN (2, 5) AND x BETWEEN 2 AND 5) THEN -16776961 WHEN x + y = 7 THEN -16711936 WHEN x = y THEN -65536 ELSE argb END AS INTEGER) AS argb FROM px")
