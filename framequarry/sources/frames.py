"""Rasters at rest and in flight.

At rest a raster is one row: frame_id, w, h and its pixels in row-major order.
Everything within a raster then needs no shuffle. `pixels` gives the relation
(frame_id, x, y, argb) for grouping and joining; `gathered` goes back.
Rasters of over a million pixels are cut into tiles first (`tiles`), so that no
row exceeds some megabytes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import colour as C

TILE = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """The same rows over as many tasks as a shuffle has, whatever files they lie in:
    for rows of some bytes of which each becomes hundreds, as one small file is one
    task. A number is given, as else tasks are put together by the bytes they read,
    which is little for what packs well. With keys, rows of one key come together."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def from_embeddings(vectors: DataFrame) -> DataFrame:
    """8 x 8 rasters out of vectors of 64 numbers: (frame_id, w, h, pixels, tag)."""

    def level(i: Column) -> Column:
        v = F.get("embedding", i.cast("int")).cast("double")
        return C.clamp8(F.floor(v * 512 + 128).cast("int"))

    def step(i: Column) -> Column:
        return C.idiv(level(i), 64) * 85

    def pixel(i: Column) -> Column:
        return F.when(level(i) < 96, F.lit(0)).otherwise(C.pack(F.lit(255), step(i), step((i * 7 + 3) % 64), step((i * 11 + 5) % 64)))

    return vectors.select(
        F.col("vec_id").alias("frame_id"),
        F.lit(8).alias("w"),
        F.lit(8).alias("h"),
        F.transform(F.sequence(F.lit(0), F.lit(63)), pixel).alias("pixels"),
        F.col("label").alias("tag"),
    )


def writes_from_lineitem(lines: DataFrame) -> DataFrame:
    """A log of pixel writes, 32 x 32 rasters by supplier: (frame_id, x, y,
    argb, order1, order2)."""

    def byte(c: str, k: int) -> Column:
        return F.floor(F.col(c) * k + 0.5).cast("int")

    return lines.select(
        F.col("l_suppkey").alias("frame_id"),
        (F.col("l_partkey") % 32).cast("int").alias("x"),
        (F.col("l_orderkey") % 32).cast("int").alias("y"),
        C.pack(F.lit(255), byte("l_quantity", 5), byte("l_discount", 1000), byte("l_tax", 1000)).alias("argb"),
        F.col("l_orderkey").alias("order1"),
        F.col("l_linenumber").alias("order2"),
    )


def last_writes(log: DataFrame) -> DataFrame:
    """The last write of each pixel; partial aggregation keeps one row a pixel
    and task, so a much-written pixel is no hot key."""
    latest = F.max(F.struct("order1", "order2", "argb")).alias("m")
    return log.groupBy("frame_id", "x", "y").agg(latest).select("frame_id", "x", "y", "m.argb")


def pixels(frames: DataFrame) -> DataFrame:
    """(frame_id, x, y, argb) of every pixel. The outer form, as the plain one
    brings a filter on the array, which is then worked out a second time below
    all that it depends on."""
    flat = frames.select("frame_id", "w", F.posexplode_outer("pixels").alias("i", "argb")).where("i is not null")
    return flat.select("frame_id", (F.col("i") % F.col("w")).cast("int").alias("x"), C.idiv(F.col("i"), F.col("w")).alias("y"), "argb")


def gathered(px: DataFrame, w: int, h: int) -> DataFrame:
    """Rasters of one size out of pixels, absent ones transparent."""
    own = px.where((F.col("x") >= 0) & (F.col("x") < w) & (F.col("y") >= 0) & (F.col("y") < h))
    rows = own.groupBy("frame_id").agg(F.map_from_entries(F.collect_list(F.struct((F.col("y") * w + F.col("x")).alias("i"), "argb"))).alias("m"))
    cells = F.transform(F.sequence(F.lit(0), F.lit(w * h - 1)), lambda i: F.coalesce(F.element_at("m", i), F.lit(0)))
    return rows.select("frame_id", F.lit(w).alias("w"), F.lit(h).alias("h"), cells.alias("pixels"))


def tiles(px: DataFrame) -> DataFrame:
    """Pixels with the tile that they lie in and their place there."""
    return px.select(
        "frame_id",
        C.idiv(F.col("x"), TILE).alias("tile_x"),
        C.idiv(F.col("y"), TILE).alias("tile_y"),
        (F.col("x") % TILE).alias("x"),
        (F.col("y") % TILE).alias("y"),
        "argb",
    )


def ranked(rows: DataFrame, group: str, bucket: Column, order: list[str], name: str) -> DataFrame:
    """rows with their number (from 0) in a group, in the order of some columns.
    bucket doesn't fall along that order: rows are ranked within (group, bucket)
    and moved up by the sizes of the buckets before, so a group with a third of
    all rows is no task of its own."""
    dealt = rows.withColumn("__bucket", bucket)
    sizes = dealt.groupBy(group, "__bucket").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(group).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select(F.col(group).alias("__group"), F.col("__bucket").alias("__of"), F.coalesce(before, F.lit(0)).alias("__before"))
    within = dealt.withColumn("__within", F.row_number().over(Window.partitionBy(group, "__bucket").orderBy(*order)) - 1)
    same = F.col(group).eqNullSafe(F.col("__group")) & F.col("__bucket").eqNullSafe(F.col("__of"))
    return within.join(sizes, same).select(*rows.columns, (F.col("__within") + F.col("__before")).cast("int").alias(name))


def numbered(frames: DataFrame, key: str = "frame_id") -> DataFrame:
    """frames with their place in the order of key, a number, within each tag."""
    return ranked(frames, "tag", F.floor(F.col(key) / 4096), [key], "place")
