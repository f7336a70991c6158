"""Colours as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rgb(r: Column, g: Column, b: Column) -> Column:
    return F.struct(r.cast("int").alias("r"), g.cast("int").alias("g"), b.cast("int").alias("b"))


def hsl_to_rgb(h: Column, s: Column, light: Column) -> Column:
    """[M31] h in degrees, s and l in [0, 1]; channels 0 to 255, rounded."""
    c = (1 - F.abs(2 * light - 1)) * s

    def channel(n: int) -> Column:
        k = F.pmod(F.lit(float(n)) + h / 30.0, F.lit(12.0))
        return F.round((light - c / 2 * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))) * 255)

    return rgb(channel(0), channel(8), channel(4))


def rgb_to_hsl(r: Column, g: Column, b: Column) -> Column:
    """[M31] Channels 0 to 255; h in degrees."""
    r, g, b = r / 255.0, g / 255.0, b / 255.0
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d, light = top - low, (top + low) / 2
    h = F.when(d == 0, 0.0).when(top == r, F.pmod(F.try_divide(g - b, d), F.lit(6.0))).when(top == g, F.try_divide(b - r, d) + 2).otherwise(F.try_divide(r - g, d) + 4) * 60
    s = F.when(d == 0, 0.0).otherwise(F.try_divide(d, 1 - F.abs(2 * light - 1)))
    return F.struct(h.alias("h"), s.alias("s"), light.alias("l"))


def lerp(a: Column, b: Column, t: Column) -> Column:
    """[M32]"""
    return a + (b - a) * t


def mix_rgb(a: Column, b: Column, t: Column) -> Column:
    """[M32] Channel by channel, rounded."""
    return rgb(*[F.round(lerp(a[c], b[c], t)) for c in ("r", "g", "b")])


def hues(n: Column, start: int = 310) -> Column:
    """[M33] n hues, a whole number of degrees apart, from ``start`` on."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.pmod(F.lit(start) + i * F.floor(F.lit(360) / n).cast("int"), F.lit(360)))


def pack(r: Column, g: Column, b: Column, a: Column) -> Column:
    """[M34] ARGB in one number."""
    return F.shiftleft(a.cast("long"), 24) + F.shiftleft(r.cast("long"), 16) + F.shiftleft(g.cast("long"), 8) + b.cast("long")


def unpack(v: Column) -> Column:
    """[M34]"""
    part = lambda n: F.shiftright(v.cast("long"), n).bitwiseAND(F.lit(255)).cast("int")
    return F.struct(part(24).alias("a"), part(16).alias("r"), part(8).alias("g"), part(0).alias("b"))


def lean_colour(lean: Column) -> Column:
    """[M35] -1 blue, 0 purple, 1 red; channels truncated."""
    t = F.greatest(F.least(lean, F.lit(1.0)), F.lit(-1.0))
    return rgb(255 * F.least(F.lit(1.0), 1 + t), F.lit(0), 255 * F.least(F.lit(1.0), 1 - t))


def wheel_colour(i: Column, n: Column) -> Column:
    """[M36] Colour i of n on a wheel of five arms of 255 steps: red, yellow, green, cyan, blue, magenta."""
    at = F.floor(1275 * i / n).cast("int")
    arm, step = F.floor(at / 255).cast("int"), at % 255
    return F.when(arm == 0, rgb(F.lit(255), step, F.lit(0))).when(arm == 1, rgb(255 - step, F.lit(255), F.lit(0))).when(arm == 2, rgb(F.lit(0), F.lit(255), step)).when(arm == 3, rgb(F.lit(0), 255 - step, F.lit(255))).otherwise(rgb(step, F.lit(0), F.lit(255)))


def svg_path(ring: Column) -> Column:
    """[R4] An SVG path of a ring."""
    steps = F.transform(ring, lambda p: F.concat_ws(" ", p.x.cast("string"), p.y.cast("string")))
    return F.concat(F.lit("M "), F.array_join(steps, " L "), F.lit(" Z"))
