"""Column functions over colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack(r: Column, g: Column, b: Column) -> Column:
    """24-bit number r << 16 | g << 8 | b."""
    return F.shiftleft(r.cast("int"), 16) + F.shiftleft(g.cast("int"), 8) + b.cast("int")


def unpack(rgb: Column) -> list[Column]:
    return [F.shiftright(rgb, s).bitwiseAND(F.lit(255)) for s in (16, 8, 0)]


def heat(v: Column, lo: Column | float, hi: Column | float) -> list[Column]:
    """(r, g, b) in [0, 1] of v between lo and hi: green rises over the first quarter, blue falls over the second, red rises over
    the third and green falls over the last; the other two are 0."""
    lo, hi = (F.lit(x) if isinstance(x, float) else x for x in (lo, hi))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(v - lo, hi - lo), F.lit(0.0))))
    zero = F.lit(0.0)
    r = F.when((t >= 0.5) & (t < 0.75), 4 * (t - 0.5)).otherwise(zero)
    g = F.when(t < 0.25, 4 * t).when(t >= 0.75, 1 + 4 * (0.75 - t)).otherwise(zero)
    b = F.when((t >= 0.25) & (t < 0.5), 1 + 4 * (0.25 - t)).otherwise(zero)
    return [r, g, b]


def channels(pixel: Column, n: Column) -> list[Column]:
    """(r, g, b, a) of a pixel array of n channels: 1 grey, 2 grey and alpha, 3 BGR, 4 BGRA."""
    at = lambda i: F.get(pixel, F.lit(i))
    colour = n >= 3
    return [
        F.when(colour, at(2)).otherwise(at(0)),
        F.when(colour, at(1)).otherwise(at(0)),
        at(0),
        F.when(n == 4, at(3)).when(n == 2, at(1)).otherwise(F.lit(255)),
    ]
