"""Rasters and palettes written as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import colour as C


def hex_value(text: Column) -> Column:
    """#rrggbb (opaque) or #aarrggbb as a signed colour, null if it is neither."""
    digits = F.regexp_extract(text, "^#?([0-9A-Fa-f]{6}|[0-9A-Fa-f]{8})$", 1)
    full = F.when(F.length(digits) == 6, F.concat(F.lit("ff"), digits)).when(F.length(digits) == 8, digits)
    wide = F.conv(full, 16, 10).cast("long")
    return F.when(wide >= 1 << 31, wide - (1 << 32)).otherwise(wide).cast("int")


def sketches(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, x, y, argb) of sketches: lines `C=#rrggbb`, a line `---`, then rows of
    a grid; `.` and blanks are transparent and signs without a colour are null."""
    parts = F.split(F.regexp_replace(text_col, "\r\n?", "\n"), "(?m)^\\s*---\\s*$", 2)
    base = texts.select(id_col, F.get(parts, F.lit(0)).alias("head"), F.get(parts, F.lit(1)).alias("grid")).where("grid is not null")
    entry = F.filter(F.transform(F.split("head", "\n"), lambda s: F.regexp_replace(F.trim(s), "(?i)^legend:\\s*", "")), lambda s: s != "")
    legend = base.select(id_col, F.explode(entry).alias("e")).select(id_col, F.substring("e", 1, 1).alias("sign"), hex_value(F.regexp_extract("e", "^.=\\s*(\\S+)", 1)).alias("argb"))
    rows = base.select(id_col, F.posexplode(F.split(F.regexp_replace("grid", "^\n", ""), "\n")).alias("y", "row"))
    cells = rows.select(id_col, "y", F.posexplode(F.split("row", "")).alias("x", "sign")).where("sign not in ('.', ' ', '')")
    return cells.join(legend.where("sign <> '.'"), [id_col, "sign"], "left").select(id_col, "x", "y", "argb")


def hex_rows(px: DataFrame) -> DataFrame:
    """(frame_id, y, text): the colours of each row, `.` for transparent ones."""
    cell = F.when(C.alpha(F.col("argb")) == 0, F.lit(".")).otherwise(C.hex_colour(F.col("argb")))
    row = px.select("frame_id", "y", F.struct("x", cell.alias("c")).alias("s")).groupBy("frame_id", "y").agg(F.sort_array(F.collect_list("s")).alias("r"))
    return row.select("frame_id", "y", F.array_join(F.transform("r", lambda s: s["c"]), " ").alias("text"))


def palettes(texts: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, format, idx, argb) of palettes as JASC, GIMP or lists of hex colours;
    the format is told by the first line."""
    t = F.trim(text_col)
    kind = F.when(t.startswith("JASC-PAL"), "jasc").when(t.startswith("GIMP Palette"), "gpl").otherwise("hex")
    lines = texts.select(id_col, kind.alias("format"), F.posexplode(F.split(text_col, "\r\n?|\n")).alias("line", "s"))
    triple = F.split(F.trim("s"), "\\s+")
    byte = [F.try_element_at(triple, F.lit(k)).try_cast("int") for k in (1, 2, 3)]
    number = F.when(byte[0].between(0, 255) & byte[1].between(0, 255) & byte[2].between(0, 255), C.pack(F.lit(255), *byte))
    colour = F.when((F.col("format") == "jasc") & (F.col("line") > 2), number).when((F.col("format") == "gpl") & (F.col("line") > 0), number).when(F.col("format") == "hex", hex_value(F.trim("s")))
    found = lines.withColumn("argb", colour).where("argb is not null")
    listed = found.groupBy(id_col, "format").agg(F.sort_array(F.collect_list(F.struct("line", "argb"))).alias("c"))
    return listed.select(id_col, "format", F.posexplode("c").alias("idx", "e")).select(id_col, "format", "idx", "e.argb")
