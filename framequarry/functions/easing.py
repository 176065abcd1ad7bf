"""Easing curves as Column expressions of a time that is cut to [0, 1]."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

NAMES = ("linear", "ease_in", "ease_out", "ease_in_out", "elastic_out", "bounce_out", "step")


def eased(t: Column, name: str) -> Column:
    u = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t.cast("double")))
    rest = 1.0 - u
    hops = [(1.0, 0.0, 0.0), (2.0, 1.5, 0.75), (2.5, 2.25, 0.9375), (float("inf"), 2.625, 0.984375)]  # fixed values: until, centre, floor
    bounce = None
    for until, centre, floor in hops:
        v = u - centre / 2.75
        arc = 7.5625 * v * v + floor
        bounce = F.when(u < until / 2.75, arc) if bounce is None else bounce.otherwise(arc) if until == float("inf") else bounce.when(u < until / 2.75, arc)
    curves = {
        "linear": u,
        "ease_in": u * u,
        "ease_out": 1.0 - rest * rest,
        "ease_in_out": F.when(u < 0.5, 2.0 * u * u).otherwise(1.0 - 2.0 * rest * rest),
        "elastic_out": F.pow(F.lit(2.0), -10.0 * u) * F.sin((u * 10.0 - 0.75) * (2 * pi / 3)) + 1.0,
        "bounce_out": bounce,
        "step": F.when(u < 0.5, 0.0).otherwise(1.0),
    }
    if name not in curves:
        raise ValueError(f"no curve {name!r}; there are {', '.join(NAMES)}")
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), curves[name]))


def sampled(name: str, steps: int) -> Column:
    """An array of values at evenly spaced times, both ends included."""
    if steps < 2:
        raise ValueError("steps must be 2 or more")
    return F.transform(F.sequence(F.lit(0), F.lit(steps - 1)), lambda i: eased(i / (steps - 1), name))
