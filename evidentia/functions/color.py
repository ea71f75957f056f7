"""Colours (#RRGGBB strings) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def channels(c: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue from 0 to 255."""
    return tuple(F.conv(F.substring(c, k, 2), 16, 10).cast("int") for k in (2, 4, 6))


def bgr(c: Column) -> Column:
    """Struct b, g, r; black for anything that isn't a colour."""
    ok = c.rlike("^#[0-9A-Fa-f]{6}$")
    r, g, b = channels(c)
    return F.struct(*(F.when(ok, x).otherwise(0).alias(k) for x, k in ((b, "b"), (g, "g"), (r, "r"))))


def saturation(c: Column) -> Column:
    """Saturation of the hue-saturation-value form, 0 to 1."""
    top, low = F.greatest(*channels(c)), F.least(*channels(c))
    return F.when(top == 0, 0.0).otherwise((top - low) / top)


def luma(c: Column) -> Column:
    """0.299 red, 0.587 green, 0.114 blue, 0 to 255."""
    r, g, b = channels(c)
    return 0.299 * r + 0.587 * g + 0.114 * b


def linear_luminance(c: Column) -> Column:
    """0.2126 red, 0.7152 green, 0.0722 blue of channels from 0 to 1, without gamma."""
    r, g, b = channels(c)
    return 0.2126 * (r / 255) + 0.7152 * (g / 255) + 0.0722 * (b / 255)


def contrast(a: Column, b: Column) -> Column:
    la, lb = linear_luminance(a), linear_luminance(b)
    return (F.greatest(la, lb) + 0.05) / (F.least(la, lb) + 0.05)


def is_light(c: Column) -> Column:
    r, g, b = channels(c)
    return 0.2126 * r + 0.7152 * g + 0.0722 * b > 128


def distance(a: Column, b: Column) -> Column:
    """Mean absolute difference of the channels."""
    return sum((F.abs(x - y) for x, y in zip(channels(a), channels(b), strict=True)), F.lit(0)) / 3.0
