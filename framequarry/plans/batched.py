"""Named queries of batched edits, with the SQL of their checks. They join those of
`catalogue`. Six events in a row are a batch; the raster of the batch's number is
its canvas, and batches beyond the rasters have none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import batches
from ..sources import frames as S
from .catalogue import add, frames

_SIZE = 6
#: The values of an operation, from an event's value in hundredths (v); the same text in both dialects.
_VALUES = {
    "x": "v % 8 + CASE WHEN v % 23 = 0 THEN 8 ELSE 0 END",
    "y": "v {div} 8 % 8",
    "x1": "v {div} 64 % 8",
    "y1": "v {div} 512 % 8",
    "w": "CASE WHEN v % 29 = 0 THEN 0 ELSE 1 + v {div} 7 % 4 END",
    "h": "1 + v {div} 5 % 4",
    "radius": "v {div} 11 % 4 - CASE WHEN v % 31 = 0 THEN 4 ELSE 0 END",
    "argb": "CASE WHEN v % 43 = 0 THEN NULL ELSE -1 - v * 977 % 16777216 END",
    "to": "-1 - v * 331 % 16777216",
    "tolerance": "v % 200 - CASE WHEN v % 19 = 0 THEN 200 ELSE 0 END",
    "thickness": "1 + v {div} 3 % 3 + CASE WHEN v % 37 = 0 THEN 16 ELSE 0 END",
}
_KINDS = ("pixel", "line", "rect", "circle", "stroke", "fill", "replace", "erase", "spray")


def operations(events: DataFrame) -> DataFrame:
    """Rows as `batches.OPS`. One kind in some forty is unknown, and some have no points."""
    v = F.round(F.abs("value") * 100).cast("long")
    rows = events.select("event_id", F.coalesce(v, F.lit(0).cast("long")).alias("v"))
    rows = rows.withColumn("k", F.when(F.col("v") % 41 == 0, 8).otherwise((F.col("event_id") * 5 + F.col("v")) % 8))
    made = [F.expr(t.format(div="div")).cast("int").alias(c) for c, t in _VALUES.items()]
    kind = F.get(F.array(*map(F.lit, _KINDS)), F.col("k").cast("int")).alias("kind")
    own = [F.floor(F.col("event_id") / _SIZE).alias("batch_id"), (F.col("event_id") % _SIZE).cast("int").alias("idx"), kind]
    pair = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    some = F.when(F.col("v") % 47 != 0, F.array(pair("x", "y"), pair("x1", "y1"), pair("y", "x1")))
    return rows.select("v", *own, *made, (F.col("v") % 2 == 0).alias("filled")).withColumn("points", some).drop("v")


def canvases(spark: SparkSession, folder: str) -> DataFrame:
    own = frames(spark, folder).withColumnRenamed("frame_id", "batch_id")
    return own.select("batch_id", "w", "h", "pixels", (F.col("batch_id") % 17 == 3).alias("locked"))


def _given(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return operations(S.table(spark, folder, "events")), canvases(spark, folder)


def batch_errors(spark: SparkSession, folder: str) -> DataFrame:
    return batches.errors(*_given(spark, folder))


def batch_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    return batches.outcomes(batches.applied(*_given(spark, folder)))


def batch_pixels(spark: SparkSession, folder: str) -> DataFrame:
    done = batches.applied(*_given(spark, folder)).withColumnRenamed("batch_id", "frame_id")
    return S.pixels(done.select("frame_id", "w", "h", "pixels"))


_made = ", ".join(f"CAST({t.format(div='//')} AS BIGINT) AS {c}_" for c, t in _VALUES.items())
_off = "({0} < 0 OR {1} < 0 OR {0} > 7 OR {1} > 7)".format
_away = "({2} < 0 OR {0} > 7 OR {3} < 0 OR {1} > 7)".format
_points = " OR ".join((_off("x_", "y_"), _off("x1_", "y1_"), _off("y_", "x1_")))
_ERRORS_SQL = f"""WITH e AS (SELECT event_id, coalesce(CAST(round(abs(value) * 100) AS BIGINT), 0) AS v FROM events),
 o AS (SELECT event_id // {_SIZE} AS batch_id, event_id % {_SIZE} AS idx, v, {list(_KINDS)}[1 + CASE WHEN v % 41 = 0 THEN 8 ELSE (event_id * 5 + v) % 8 END] AS kind, {_made} FROM e),
 r AS (SELECT *, CASE WHEN kind = 'spray' THEN 'unknown kind'
  WHEN argb_ IS NULL AND kind <> 'erase' THEN 'a value is missing'
  WHEN kind = 'pixel' AND {_off("x_", "y_")} THEN 'outside the canvas'
  WHEN kind = 'line' AND thickness_ > 16 THEN 'thickness out of bounds'
  WHEN kind = 'line' AND {_away("x_", "y_", "x1_", "y1_")} THEN 'beside the canvas'
  WHEN kind = 'rect' AND w_ < 1 THEN 'an edge below 1'
  WHEN kind = 'rect' AND {_away("x_", "y_", "x_ + w_ - 1", "y_ + h_ - 1")} THEN 'beside the canvas'
  WHEN kind = 'circle' AND radius_ < 0 THEN 'radius out of bounds'
  WHEN kind = 'circle' AND {_away("x_ - radius_ - 1", "y_ - radius_ - 1", "x_ + radius_ + 1", "y_ + radius_ + 1")} THEN 'beside the canvas'
  WHEN kind IN ('stroke', 'erase') AND v % 47 = 0 THEN 'no points'
  WHEN kind = 'stroke' AND thickness_ > 16 THEN 'thickness out of bounds'
  WHEN kind IN ('stroke', 'erase') AND ({_points}) THEN 'a point outside the canvas'
  WHEN kind IN ('fill', 'replace') AND tolerance_ < 0 THEN 'tolerance below 0'
  WHEN kind = 'fill' AND {_off("x_", "y_")} THEN 'outside the canvas' END AS reason FROM o),
 c AS (SELECT b.batch_id, -1 AS idx, CASE WHEN vec_id IS NULL THEN 'no canvas' ELSE 'the layer is locked' END AS error
  FROM (SELECT DISTINCT batch_id FROM o) b LEFT JOIN embeddings ON vec_id = b.batch_id WHERE vec_id IS NULL OR b.batch_id % 17 = 3),
 a AS (SELECT * FROM c UNION ALL SELECT batch_id, idx, kind || ': ' || reason FROM r WHERE reason IS NOT NULL)
 SELECT batch_id, CAST(min(idx) AS INTEGER) AS idx, arg_min(error, idx) AS error FROM a GROUP BY batch_id"""

add("batch_errors", batch_errors, _ERRORS_SQL)
#: The fold is not for SQL: tests/test_batches.py compares both with a plain fold.
add("batch_outcomes", batch_outcomes)
add("batch_pixels", batch_pixels)
