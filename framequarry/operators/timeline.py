"""Timelines: frames in order, with durations, tags and effects on pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colour as C
from ..sources.frames import numbered
from . import raster


def duration(frames: DataFrame, fps: int) -> DataFrame:
    """A frame's own duration, or that of the rate, in milliseconds."""
    rate = min(24, max(1, fps))
    return frames.withColumn("effective_ms", F.coalesce("duration_ms", F.lit(max(1, 1000 // rate))))


def tagged(frames: DataFrame, tags: DataFrame) -> DataFrame:
    """Frames with the tags whose span holds them; tags are few."""
    return frames.join(F.broadcast(tags), (F.col("frame_idx") >= F.col("start_frame")) & (F.col("frame_idx") <= F.col("end_frame")))


def onion_skin(frames: DataFrame, range_: int = 1) -> DataFrame:
    """For each frame of a tag's timeline (by frame_id) the frames before and
    after it, faded to 0x66 and 0x33: frame_id, side, pixels."""
    places = numbered(frames)
    last = places.groupBy("tag").agg(F.max("place").alias("last"))
    place = F.col("place")
    asked = places.select("frame_id", "w", "h", "tag", "place").join(last, "tag")
    at = F.array(F.struct(F.lit("previous").alias("side"), F.when(place > 0, F.greatest(F.lit(0), place - range_)).alias("at")), F.struct(F.lit("next").alias("side"), F.when(place < F.col("last"), F.least(F.col("last"), place + range_)).alias("at")))
    asked = asked.select("frame_id", "w", "h", "tag", F.explode(at).alias("s")).select("frame_id", "w", "h", "tag", "s.side", "s.at").where("at is not null")
    shown = places.select("tag", F.col("place").alias("at"), "pixels")
    strength = F.when(F.col("side") == "previous", 0x66).otherwise(0x33)
    return asked.join(shown, ["tag", "at"]).select("frame_id", "w", "h", "side", F.transform("pixels", lambda p: C.scaled_alpha(p, strength)).alias("pixels"))


def breathe(frames: DataFrame, amplitude: int = 1) -> DataFrame:
    """Three phases: as it is, shifted down, shifted up."""
    parts = [raster.shifted(frames, 0, d).withColumn("phase", F.lit(k)) for k, d in enumerate((0, amplitude, -amplitude))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def fade(frames: DataFrame, steps: int = 4, out: bool = True) -> DataFrame:
    """Steps of falling (or rising) alpha, from 255 to 0."""
    steps_ = frames.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    k = C.idiv((F.lit(steps - 1) - F.col("step") if out else F.col("step")) * 255, max(1, steps - 1))
    return steps_.withColumn("pixels", F.transform("pixels", lambda p: C.scaled_alpha(p, k)))


def typewriter(frames: DataFrame) -> DataFrame:
    """A raster for each row, which shows the rows up to it."""
    steps = frames.withColumn("step", F.explode(F.sequence(F.lit(0), F.col("h") - 1)))
    return steps.withColumn("pixels", F.transform("pixels", lambda p, i: F.when(C.idiv(i, F.col("w")) <= F.col("step"), p).otherwise(F.lit(0))))


def sheet(frames: DataFrame, columns: int = 8, margin: int = 0) -> DataFrame:
    """Where each frame of a tag goes on a sheet: frame_id, x, y, w, h."""
    laid = numbered(frames.select("frame_id", "tag", "w", "h"))
    return laid.select("frame_id", "tag", ((F.col("place") % columns) * (F.col("w") + margin) + margin).cast("int").alias("x"), (C.idiv(F.col("place"), columns) * (F.col("h") + margin) + margin).cast("int").alias("y"), "w", "h")


def bounced(frames: DataFrame, amplitude: int = 2, bounces: int = 2) -> DataFrame:
    """Each frame (bounces + 1) * 2 + 1 times, with `phase`: at odd phases lower
    by the amplitude, halved from one to the next and rounded half up."""
    drops = [int(amplitude / (1 << p // 2) + 0.5) if p % 2 else 0 for p in range((bounces + 1) * 2 + 1)]
    phased = frames.withColumn("phase", F.explode(F.sequence(F.lit(0), F.lit(len(drops) - 1))))
    drop = F.get(F.array(*[F.lit(d) for d in drops]), F.col("phase"))

    def lowered(p: Column, i: Column) -> Column:
        at = i - drop * F.col("w")
        return F.when(at >= 0, F.get("pixels", at.cast("int"))).otherwise(F.lit(0))

    return phased.withColumn("pixels", F.transform("pixels", lowered))
