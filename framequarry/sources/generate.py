"""Rasters out of rules: each is an expression over a grid of places, so frames
of any number are made where they are used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colour as C


def made(spark: SparkSession, w: int, h: int, pixel: Callable[[Column, Column], Column], frames: int = 1) -> DataFrame:
    cells = F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), lambda i: pixel((i % w).cast("int"), C.idiv(i, w)))
    return spark.range(frames).select(F.col("id").alias("frame_id"), F.lit(w).alias("w"), F.lit(h).alias("h"), cells.alias("pixels"))


def blank(spark: SparkSession, w: int, h: int) -> DataFrame:
    return made(spark, w, h, lambda x, y: F.lit(0))


def checker(spark: SparkSession, w: int, h: int, cell: int, a: int, b: int) -> DataFrame:
    return made(spark, w, h, lambda x, y: F.when((C.idiv(x, cell) + C.idiv(y, cell)) % 2 == 0, F.lit(a)).otherwise(F.lit(b)))


def bricks(spark: SparkSession, w: int, h: int, brick_w: int = 8, brick_h: int = 4, mortar: int = 1, body: int = -65536, joint: int = C.BLACK) -> DataFrame:
    """Courses of bricks, every other one shifted by half a brick."""

    def pixel(x: Column, y: Column) -> Column:
        shifted = x + (C.idiv(y, brick_h + mortar) % 2) * (brick_w // 2)
        return F.when((y % (brick_h + mortar) >= brick_h) | (shifted % (brick_w + mortar) >= brick_w), F.lit(joint)).otherwise(F.lit(body))

    return made(spark, w, h, pixel)


def diamond(spark: SparkSession, w: int, h: int) -> DataFrame:
    """The mask of an isometric tile."""
    return made(spark, w, h, lambda x, y: F.when(F.abs(y - h // 2) * (w // 2) + F.abs(x - w // 2) * (h // 2) <= (w // 2) * (h // 2), F.lit(-1)).otherwise(F.lit(0)))


def scanlines(frames: DataFrame, dark: int = 0x30000000) -> DataFrame:
    """Every other row under a dark veil."""

    def rule(p: Column, i: Column) -> Column:
        return F.when((C.alpha(p) > 0) & (C.idiv(i, F.col("w")) % 2 == 1), C.blended(F.lit(dark), p)).otherwise(p)

    return frames.withColumn("pixels", F.transform("pixels", rule))
