"""Recipes: JSON lists of steps that become one chain of operators.

Steps that depend on all rasters do so: one palette is made for all of them, and
rasters of one size are trimmed to one box. Names are read without regard to case,
hyphens, underscores and blanks; unknown ones are refused when a recipe is read,
unknown palettes too.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import colour as C
from ..functions import library
from ..operators import measures, raster, sequential, shared
from ..sources.frames import pixels

MOST_STEPS = 32
#: Parameters of each kind of step: name, whether it is required.
STEPS = {
    "scale": {"factor": True},
    "quantize": {"algorithm": True, "maxColors": False},
    "dither": {"algorithm": True, "strength": False, "palette": False},
    "palette-map": {"palette": False},
    "outline": {"color": True, "mode": False, "connectivity": False},
    "trim": {},
    "posterize": {"levels": True},
    "bg-remove": {"tolerance": True},
}
LIMITS = {"factor": (1, 16), "maxColors": (2, 256), "levels": (2, 255), "tolerance": (0, 255), "strength": (0, 1)}
#: What a parameter may be, by kind of step where that matters.
_QUANTIZE = {"mediancut": "mediancut", "kmeans": "kmeans", "octree": "octree"}
_DITHER = {"none": "none", "floydsteinberg": "floyd_steinberg", "atkinson": "atkinson", "bayer2": "bayer2", "bayer2x2": "bayer2", "bayer4": "bayer4", "bayer4x4": "bayer4", "bayer8": "bayer8", "bayer8x8": "bayer8", "checkerboard": "checker", "checker": "checker"}
_MODE = {"outer": "outer", "inner": "inner"}
_CONNECTIVITY = {"four": "four", "4": "four", "eight": "eight", "8": "eight"}
_NAMES = {("quantize", "algorithm"): _QUANTIZE, ("dither", "algorithm"): _DITHER, ("outline", "mode"): _MODE, ("outline", "connectivity"): _CONNECTIVITY}
EXAMPLE = '{"name": "example", "steps": [{"type": "bg-remove", "tolerance": 16}, {"type": "posterize", "levels": 3}, {"type": "outline", "color": "#ff0000"}, {"type": "scale", "factor": 2}]}'


def _plain(name: str) -> str:
    return re.sub("[-_ ]", "", name.lower())


def _number(value: object, whole: bool) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool) and (not whole or float(value).is_integer())


def parse(text: str) -> list[dict]:
    """The steps of a recipe; a ValueError names what is wrong and where."""
    recipe = json.loads(text)
    if not isinstance(recipe, dict) or not isinstance(recipe.get("steps"), list):
        raise ValueError("a recipe is an object with a list of steps")
    if not str(recipe.get("name", "recipe")).strip():
        raise ValueError("name: must not be blank")
    if len(recipe["steps"]) > MOST_STEPS:
        raise ValueError(f"steps: more than {MOST_STEPS}")
    for i, step in enumerate(recipe["steps"]):
        kind = step.get("type") if isinstance(step, dict) else None
        if kind not in STEPS:
            raise ValueError(f"steps[{i}]: unknown type {kind!r}")
        for k in step:
            if k != "type" and k not in STEPS[kind]:
                raise ValueError(f"steps[{i}]: unknown parameter {k!r}")
        for k, required in STEPS[kind].items():
            if required and k not in step:
                raise ValueError(f"steps[{i}]: {k!r} is missing")
        for k, value in step.items():
            if k in LIMITS and not (value is None and k == "strength"):
                low, high = LIMITS[k]
                if not _number(value, k != "strength") or not low <= value <= high:
                    raise ValueError(f"steps[{i}]: {k} must be a number in [{low}, {high}]")
            if (kind, k) in _NAMES and (not isinstance(value, str) or _plain(value) not in _NAMES[kind, k]):
                raise ValueError(f"steps[{i}]: unknown {k} {value!r}")
            if k == "palette" and value is not None:
                if not isinstance(value, str):
                    raise ValueError(f"steps[{i}]: palette must be a name or null")
                library.palette(value)
            if k == "color":
                colour(value)
    return recipe["steps"]


def colour(value: str | int) -> int:
    """#rrggbb (opaque), # and eight digits, which are read as alpha first, or a
    32-bit number."""
    if isinstance(value, str) and re.fullmatch("#([0-9a-fA-F]{6}|[0-9a-fA-F]{8})", value):
        return library.argb(value[1:])
    if _number(value, True) and -(1 << 31) <= value < 1 << 31:
        return int(value)
    raise ValueError(f"colour {value!r}")


def trimmed(frames: DataFrame) -> DataFrame:
    """Rasters of one size cut to the box of what is visible in any of them;
    rasters of several sizes each to its own."""
    box = measures.visible(pixels(frames)).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    sizes = frames.agg(*[f(c).alias(f"{n}_{c}") for c in "wh" for n, f in (("lo", F.min), ("hi", F.max))]).first()
    if (sizes.lo_w, sizes.lo_h) != (sizes.hi_w, sizes.hi_h):
        return raster.trimmed(frames)
    found = box.first()  # four numbers
    return frames if found.x is None else raster.region(frames, found.x, found.y, found.x1 - found.x + 1, found.y1 - found.y + 1)


def dithered(frames: DataFrame, algorithm: str, palette: list[int] | None, strength: float = 1.0) -> DataFrame:
    """palette None: the rasters' own opaque colours, onto which nothing is
    diffused, as every pixel is one of them; ordered dithers still move pixels."""
    if palette is None:
        if algorithm in ("none", "floyd_steinberg", "atkinson"):
            return frames
        palette = shared.own_colours(frames)
    if not palette:
        return frames
    if algorithm.startswith("bayer"):
        return raster.bayer(frames, palette, int(algorithm[-1]), strength)
    if algorithm == "checker":
        return raster.checkered(frames, palette, strength)
    return raster.palette_mapped(frames, palette) if algorithm == "none" else sequential.diffused(frames, palette, algorithm, strength)


def _dither(frames: DataFrame, step: dict) -> DataFrame:
    named = step.get("palette")
    strength = step.get("strength")
    return dithered(frames, _DITHER[_plain(step["algorithm"])], library.palette(named) if named is not None else None, 1.0 if strength is None else float(strength))


def _palette_map(frames: DataFrame, step: dict) -> DataFrame:
    named = step.get("palette")
    return frames if named is None else raster.palette_mapped(frames, library.palette(named))


def _outline(frames: DataFrame, step: dict) -> DataFrame:
    mode, links = _MODE[_plain(step.get("mode", "outer"))], _CONNECTIVITY[_plain(step.get("connectivity", "eight"))]
    return raster.outlined(frames, colour(step["color"]), mode == "inner", links == "eight")


_APPLY: dict[str, Callable[[DataFrame, dict], DataFrame]] = {
    "scale": lambda fr, s: raster.scaled(fr, int(s["factor"])),
    "quantize": lambda fr, s: shared.quantised(fr, int(s.get("maxColors", 16)), _QUANTIZE[_plain(s["algorithm"])]),
    "dither": _dither,
    "palette-map": _palette_map,
    "outline": _outline,
    "trim": lambda fr, s: trimmed(fr),
    "posterize": lambda fr, s: raster.mapped(fr, lambda p: C.posterize(p, int(s["levels"]))),
    "bg-remove": lambda fr, s: raster.mapped(fr, lambda p: C.drop_faint(p, int(s["tolerance"]))),
}


def apply(frames: DataFrame, step: dict) -> DataFrame:
    return _APPLY[step["type"]](frames, step)


def run(frames: DataFrame, text: str) -> DataFrame:
    for step in parse(text):
        frames = apply(frames, step)
    return frames
