"""Projects as relations, and edits of them.

Any number of projects lie in five tables; an edit is a projection, a filter or a
join on the project's key, and applies to all projects (or those of `only`) at
once. Nothing is gathered by project but frames' and layers' counts.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colour as C
from . import pairs

ID = "project_id"


@dataclass(frozen=True)
class Projects:
    heads: DataFrame  # project_id, name, w, h, fps, active_frame (place), active_layer (id)
    layers: DataFrame  # project_id, layer_id, place, name, opacity, visible, locked
    frames: DataFrame  # project_id, frame_id, place, duration_ms
    cels: DataFrame  # project_id, frame_id, layer_id, pixels; absent where empty
    tags: DataFrame  # project_id, place, name, start_frame, end_frame

    def only(self, ids: DataFrame) -> Projects:
        """The projects whose ids are in a table."""
        keep = ids.select(ID)
        return Projects(*[t.join(keep, ID, "left_semi") for t in (self.heads, self.layers, self.frames, self.cels, self.tags)])


def created(names: DataFrame, w: int, h: int) -> Projects:
    """names: project_id, name. Projects of one layer and one blank frame."""
    heads = names.select(ID, "name", F.lit(w).alias("w"), F.lit(h).alias("h"), F.lit(12).alias("fps"), F.lit(0).alias("active_frame"), F.lit(0).alias("active_layer"))
    layers = names.select(ID, F.lit(0).alias("layer_id"), F.lit(0).alias("place"), F.lit("Layer 1").alias("name"), F.lit(1.0).alias("opacity"), F.lit(True).alias("visible"), F.lit(False).alias("locked"))
    frames = names.select(ID, F.lit(0).alias("frame_id"), F.lit(0).alias("place"), F.lit(None).cast("int").alias("duration_ms"))
    none = names.where("false")
    cels = none.select(ID, F.lit(0).alias("frame_id"), F.lit(0).alias("layer_id"), F.array().cast("array<int>").alias("pixels"))
    tags = none.select(ID, F.lit(0).alias("place"), "name", F.lit(0).alias("start_frame"), F.lit(0).alias("end_frame"))
    return Projects(heads, layers, frames, cels, tags)


# heads
def with_name(p: Projects, name: Column) -> Projects:
    return replace(p, heads=p.heads.withColumn("name", name))


def with_fps(p: Projects, fps: Column) -> Projects:
    """1 to 24 frames a second; more and fewer are brought into that range."""
    return replace(p, heads=p.heads.withColumn("fps", F.least(F.lit(24), F.greatest(F.lit(1), fps)).cast("int")))


def with_active(p: Projects, frame: int | None = None, layer: int | None = None) -> Projects:
    """Another active frame (by place) or layer (by id), where the project has it."""
    heads = p.heads
    for column, table, key, value in (("active_frame", p.frames, "place", frame), ("active_layer", p.layers, "layer_id", layer)):
        if value is not None:
            have = table.where(F.col(key) == value).select(ID, F.lit(value).alias("__to"))
            heads = heads.join(have, ID, "left").withColumn(column, F.coalesce("__to", column)).drop("__to")
    return replace(p, heads=heads)


# layers
def layer_edited(p: Projects, layer: int, **values: object) -> Projects:
    """Name, opacity (0 to 1), visible or locked of one layer."""
    layers = p.layers
    for name, value in values.items():
        value = min(1.0, max(0.0, value)) if name == "opacity" else value
        layers = layers.withColumn(name, F.when(F.col("layer_id") == layer, F.lit(value)).otherwise(F.col(name)))
    return replace(p, layers=layers)


def layer_added(p: Projects, name: str) -> Projects:
    """A layer on top, which becomes the active one."""
    new = p.layers.groupBy(ID).agg((F.max("layer_id") + 1).cast("int").alias("layer_id"), F.count("*").cast("int").alias("place"))
    heads = p.heads.join(new.select(ID, F.col("layer_id").alias("__new")), ID).withColumn("active_layer", F.col("__new")).drop("__new")
    new = new.select(ID, "layer_id", "place", F.lit(name).alias("name"), F.lit(1.0).alias("opacity"), F.lit(True).alias("visible"), F.lit(False).alias("locked"))
    return replace(p, heads=heads, layers=p.layers.unionByName(new))


def layer_removed(p: Projects, layer: int) -> Projects:
    """A layer and its cels go; a project's last layer stays. If it was active,
    the layer below is, or the new bottom one."""
    own = F.max(F.when(F.col("layer_id") == layer, F.col("place")))
    known = p.layers.groupBy(ID).agg(F.count("*").alias("__n"), own.alias("__at"))
    known = known.where("__n > 1 and __at is not null").select(ID, "__at")
    near = p.layers.join(known, ID).where(F.col("place") == F.when(F.col("__at") > 0, F.col("__at") - 1).otherwise(1)).select(ID, F.col("layer_id").alias("__next"))
    heads = p.heads.join(near, ID, "left").withColumn("active_layer", F.when(F.col("__next").isNotNull() & (F.col("active_layer") == layer), F.col("__next")).otherwise(F.col("active_layer"))).drop("__next")
    layers = p.layers.join(known, ID, "left").where(F.col("__at").isNull() | (F.col("layer_id") != layer))
    layers = layers.withColumn("place", F.when(F.col("place") > F.col("__at"), F.col("place") - 1).otherwise(F.col("place"))).drop("__at")
    cels = p.cels.join(known, ID, "left").where(F.col("__at").isNull() | (F.col("layer_id") != layer)).drop("__at")
    return replace(p, heads=heads, layers=layers, cels=cels)


def _moved(table: DataFrame, at: Column, to: int) -> DataFrame:
    """Rows of `table` with one moved from place `__at` to another; the rows
    between close up. Projects without such places are left alone."""
    place = F.col("place")
    new = F.when(place == at, to).when((place > at) & (place <= to), place - 1).when((place < at) & (place >= to), place + 1).otherwise(place)
    return table.withColumn("place", F.coalesce(new, place).cast("int"))


def layer_moved(p: Projects, layer: int, to: int) -> Projects:
    known = p.layers.groupBy(ID).agg(F.max(F.when(F.col("layer_id") == layer, F.col("place"))).alias("__at"), F.max("place").alias("__top"))
    known = known.where(F.col("__top") >= to).select(ID, "__at")
    return replace(p, layers=_moved(p.layers.join(known, ID, "left"), F.col("__at"), to).drop("__at"))


def layer_cleared(p: Projects, layer: int) -> Projects:
    return replace(p, cels=p.cels.where(F.col("layer_id") != layer))


# frames
def frame_added(p: Projects, after: int, clone: bool = False) -> Projects:
    """A frame after a place, with that frame's cels (and, as a clone, its
    duration); it becomes the active one."""
    source = p.frames.where(F.col("place") == after).select(ID, F.col("frame_id").alias("__from"), F.col("duration_ms").alias("__ms"))
    new = p.frames.groupBy(ID).agg((F.max("frame_id") + 1).cast("int").alias("__new")).join(source, ID)
    frames = p.frames.join(new.select(ID, "__new"), ID, "left")
    frames = frames.withColumn("place", F.when(F.col("__new").isNotNull() & (F.col("place") > after), F.col("place") + 1).otherwise(F.col("place"))).drop("__new")
    own = new.select(ID, F.col("__new").alias("frame_id"), F.lit(after + 1).alias("place"), (F.col("__ms") if clone else F.lit(None).cast("int")).alias("duration_ms"))
    copies = p.cels.join(new, [p.cels[ID] == new[ID], F.col("frame_id") == F.col("__from")]).select(p.cels[ID], F.col("__new").alias("frame_id"), "layer_id", "pixels")
    heads = p.heads.join(new.select(ID, "__new"), ID, "left").withColumn("active_frame", F.when(F.col("__new").isNotNull(), after + 1).otherwise(F.col("active_frame"))).drop("__new")
    return replace(p, heads=heads, frames=frames.unionByName(own), cels=p.cels.unionByName(copies))


def frame_deleted(p: Projects, place: int) -> Projects:
    """The frame at a place goes, unless it is the only one. The active frame
    stays active; if it is the one that goes, the next one is, or the last."""
    known = p.frames.groupBy(ID).agg(F.count("*").cast("int").alias("__n"), F.max(F.when(F.col("place") == place, F.col("frame_id"))).alias("__gone"))
    known = known.where("__n > 1 and __gone is not null")
    frames = p.frames.join(known, ID, "left").where(F.col("__gone").isNull() | (F.col("place") != place))
    frames = frames.withColumn("place", F.when(F.col("__gone").isNotNull() & (F.col("place") > place), F.col("place") - 1).otherwise(F.col("place"))).drop("__n", "__gone")
    cels = p.cels.join(known, ID, "left").where(F.col("__gone").isNull() | (F.col("frame_id") != F.col("__gone"))).drop("__n", "__gone")
    now = F.col("active_frame") - F.when(F.col("active_frame") > place, 1).otherwise(0)
    heads = p.heads.join(known, ID, "left").withColumn("active_frame", F.when(F.col("__gone").isNotNull(), F.least(now, F.col("__n") - 2)).otherwise(F.col("active_frame")).cast("int")).drop("__n", "__gone")
    return replace(p, heads=heads, frames=frames, cels=cels)


def frame_moved(p: Projects, at: int, to: int) -> Projects:
    """A frame from one place to another; the active frame stays active."""
    known = p.frames.groupBy(ID).agg(F.max("place").alias("__top")).where(F.col("__top") >= max(at, to)).select(ID, F.lit(at).alias("__at"))
    frames = _moved(p.frames.join(known, ID, "left"), F.col("__at"), to).drop("__at")
    heads = p.heads.withColumnRenamed("active_frame", "place").join(known, ID, "left")
    return replace(p, heads=_moved(heads, F.col("__at"), to).withColumnRenamed("place", "active_frame").drop("__at"), frames=frames)


def frame_timed(p: Projects, place: int, ms: int | None) -> Projects:
    """A frame's own duration, 1 to 60000 ms, or none."""
    if ms is not None and not 1 <= ms <= 60_000:
        raise ValueError("a duration lies between 1 and 60000 ms")
    return replace(p, frames=p.frames.withColumn("duration_ms", F.when(F.col("place") == place, F.lit(ms).cast("int")).otherwise(F.col("duration_ms"))))


def durations(p: Projects) -> DataFrame:
    """(project_id, frame_id, place, effective_ms): a frame's own, or the rate's."""
    rate = F.greatest(F.lit(1), C.idiv(F.lit(1000), F.col("fps")))
    return p.frames.join(p.heads.select(ID, "fps"), ID).select(ID, "frame_id", "place", F.coalesce("duration_ms", rate).cast("int").alias("effective_ms"))


# tags
def tag_set(p: Projects, name: str, start: int, end: int) -> Projects:
    """A tag over a span of frames, last in order; one of that name is replaced.
    Projects with fewer frames are left alone."""
    if not 0 <= start <= end:
        raise ValueError("a span starts at 0 or later and ends at its start or later")
    fits = p.frames.groupBy(ID).agg(F.max("place").alias("__top")).where(F.col("__top") >= end).select(ID, F.lit(True).alias("__fits"))
    kept = p.tags.join(fits, ID, "left").where(F.col("__fits").isNull() | (F.col("name") != name)).drop("__fits")
    last = p.tags.groupBy(ID).agg(F.max("place").alias("__last"))
    new = fits.join(last, ID, "left").select(ID, (F.coalesce("__last", F.lit(-1)) + 1).cast("int").alias("place"), F.lit(name).alias("name"), F.lit(start).alias("start_frame"), F.lit(end).alias("end_frame"))
    return replace(p, tags=kept.unionByName(new))


def tag_removed(p: Projects, name: str) -> Projects:
    return replace(p, tags=p.tags.where(F.col("name") != name))


# cels
def cel_put(p: Projects, layer: int, place: int, pixels: DataFrame | None) -> Projects:
    """The cel of a layer in the frame at a place: replaced by (project_id,
    pixels), or taken away where pixels is None."""
    at = p.frames.where(F.col("place") == place).select(ID, F.col("frame_id").alias("__at"))
    kept = p.cels.join(at, [p.cels[ID] == at[ID], F.col("frame_id") == F.col("__at"), F.col("layer_id") == layer], "left_anti")
    if pixels is not None:
        new = pixels.join(at, ID).join(p.layers.where(F.col("layer_id") == layer).select(ID), ID, "left_semi")
        kept = kept.unionByName(new.select(ID, F.col("__at").alias("frame_id"), F.lit(layer).alias("layer_id"), "pixels"))
    return replace(p, cels=kept)


def active_cels(p: Projects) -> DataFrame:
    """(project_id, frame_id, layer_id, w, h, pixels) of the active layer in the
    active frame, where there is a cel."""
    at = p.heads.join(p.frames, [p.heads[ID] == p.frames[ID], F.col("place") == F.col("active_frame")]).select(p.heads[ID], "frame_id", F.col("active_layer").alias("layer_id"), "w", "h")
    return at.join(p.cels, [ID, "frame_id", "layer_id"])


def recoloured(p: Projects, from_: int, to: int, tolerance: int = 0) -> Projects:
    """In active cels, colours within tolerance of one (in all four channels)
    become another; locked layers are left alone."""

    def near(c: Column) -> Column:
        if not tolerance:
            return c == from_
        parts = [F.abs(f(c) - f(F.lit(from_))) <= tolerance for f in (C.alpha, C.red, C.green, C.blue)]
        return parts[0] & parts[1] & parts[2] & parts[3]

    free = p.layers.where("not locked").select(ID, "layer_id")
    hit = active_cels(p).select(ID, "frame_id", "layer_id").join(free, [ID, "layer_id"], "left_semi").withColumn("__hit", F.lit(True))
    new = F.when(F.col("__hit"), F.transform("pixels", lambda c: F.when(near(c), F.lit(to)).otherwise(c))).otherwise(F.col("pixels"))
    return replace(p, cels=p.cels.join(hit, [ID, "frame_id", "layer_id"], "left").withColumn("pixels", new).drop("__hit"))


def composites(p: Projects, active: bool = False) -> DataFrame:
    """(project_id, frame_id, w, h, pixels): visible layers over one another, of
    all frames or of the active ones. Frames without visible cels are blank."""
    op = F.least(F.lit(255), (F.col("opacity").cast("float") * F.lit(255.0).cast("float")).cast("int"))
    shown = p.layers.where("visible and opacity > 0").select(ID, "layer_id", "place", op.alias("op"))
    wanted = p.frames.select(ID, "frame_id", F.col("place").alias("at")).join(p.heads.select(ID, "w", "h", "active_frame"), ID)
    wanted = wanted.where("at = active_frame") if active else wanted
    found = pairs.stacked(p.cels.join(shown, [ID, "layer_id"]).join(wanted.select(ID, "frame_id", "w", "h"), [ID, "frame_id"]), [ID, "frame_id"])
    blank = F.transform(F.sequence(F.lit(0), F.col("w") * F.col("h") - 1), lambda i: F.lit(0))
    return wanted.select(ID, "frame_id", "w", "h").join(found.drop("w", "h"), [ID, "frame_id"], "left").withColumn("pixels", F.coalesce("pixels", blank))


def picked(p: Projects, x: int, y: int) -> DataFrame:
    """(project_id, argb): the composited colour of the active frames at a place
    (null outside)."""
    inside = (F.lit(x) >= 0) & (F.lit(x) < F.col("w")) & (F.lit(y) >= 0) & (F.lit(y) < F.col("h"))
    return composites(p, active=True).select(ID, F.when(inside, F.get("pixels", (F.lit(y) * F.col("w") + x).cast("int"))).alias("argb"))


# documents
_SCHEMA = (
    "version int, name string, w int, h int, fps int, active_frame int, active_layer int,"
    " layers array<struct<place:int,layer_id:int,name:string,opacity:double,visible:boolean,locked:boolean>>,"
    " frames array<struct<place:int,frame_id:int,duration_ms:int,cels:array<struct<layer_id:int,pixels:array<int>>>>>,"
    " tags array<struct<place:int,name:string,start_frame:int,end_frame:int>>"
)


def saved(p: Projects) -> DataFrame:
    """(project_id, document): each project as one JSON text. A project's rows
    meet in one row, as its document must."""

    def listed(table: DataFrame, name: str, *columns: str) -> DataFrame:
        return table.groupBy(ID).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))

    cels = p.cels.groupBy(ID, "frame_id").agg(F.sort_array(F.collect_list(F.struct("layer_id", "pixels"))).alias("cels"))
    out = p.heads.join(listed(p.layers, "layers", "place", "layer_id", "name", "opacity", "visible", "locked"), ID)
    out = out.join(listed(p.frames.join(cels, [ID, "frame_id"], "left"), "frames", "place", "frame_id", "duration_ms", "cels"), ID)
    out = out.join(listed(p.tags, "tags", "place", "name", "start_frame", "end_frame"), ID, "left").withColumn("version", F.lit(2))
    fields = ["version", "name", "w", "h", "fps", "active_frame", "active_layer", "layers", "frames", "tags"]
    return out.select(ID, F.to_json(F.struct(*fields)).alias("document"))


def loaded(documents: DataFrame, strict: bool = True) -> Projects:
    """documents: project_id, document. Texts that aren't such documents are an
    error, or, if not strict, no project at all."""
    read = documents.select(ID, F.from_json("document", _SCHEMA, {"mode": "PERMISSIVE"}).alias("d"))
    good = F.col("d.version").isNotNull() & (F.size("d.layers") > 0) & (F.size("d.frames") > 0)
    if strict:
        read = read.withColumn("d", F.when(good, F.col("d")).otherwise(F.raise_error(F.lit("not a project document"))))
    read = read.where(good)
    heads = read.select(ID, "d.name", "d.w", "d.h", "d.fps", "d.active_frame", "d.active_layer")
    frames = read.select(ID, F.explode("d.frames").alias("f"))
    cels = frames.select(ID, "f.frame_id", F.explode("f.cels").alias("c")).select(ID, "frame_id", "c.layer_id", "c.pixels")
    layers = read.select(ID, F.explode("d.layers").alias("l")).select(ID, "l.layer_id", "l.place", "l.name", "l.opacity", "l.visible", "l.locked")
    tags = read.select(ID, F.explode("d.tags").alias("t")).select(ID, "t.*")
    return Projects(heads, layers, frames.select(ID, "f.frame_id", "f.place", "f.duration_ms"), cels, tags)
