"""Geometry of rotated text boxes as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TARGET_SIZE, STRIDE = 640, 32
BOX_THRESHOLD, UNCLIP_RATIO, MIN_SIDE = 0.6, 1.5, 3.0
PATCH_HEIGHT = 48
VERTICAL_ASPECT = 2.7


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value computed once."""
    return F.transform(F.array(value), body)[0]


def scaled_size(width: Column, height: Column, target: int = TARGET_SIZE) -> Column:
    """struct(width, height, scale): shrunk so that the longer side is ``target``, never enlarged."""
    long = F.greatest(width, height)
    scale = F.when(long > target, F.lit(float(target)) / long).otherwise(F.lit(1.0))
    other = lambda side: F.greatest(F.floor(side * scale), F.lit(1)).cast("int")
    new_width = F.when(long <= target, width).when(width > height, F.lit(target)).otherwise(other(width))
    new_height = F.when(long <= target, height).when(width > height, other(height)).otherwise(F.lit(target))
    return F.struct(new_width.cast("int").alias("width"), new_height.cast("int").alias("height"), scale.alias("scale"))


def padding(side: Column, stride: int = STRIDE) -> Column:
    """struct(before, after) that bring a side to a multiple of ``stride``."""
    missing = F.pmod(-side, F.lit(stride))
    before = F.floor(missing / 2).cast("int")
    return F.struct(before.alias("before"), (missing - before).cast("int").alias("after"))


def unclip_offset(short: Column, long: Column, ratio: float = UNCLIP_RATIO) -> Column:
    around = 2.0 * (short + long)
    return F.when(around > 0, short * long * ratio / around).otherwise(F.lit(0.0))


def oriented(side_a: Column, side_b: Column, angle: Column) -> Column:
    """struct(thickness, length, angle, vertical): the shorter side first, whatever the angle's convention.

    The rules apply one after another; each sees what the one before left.
    """
    tall = angle.between(-30, 30) & (side_b > side_a * VERTICAL_ASPECT)
    wide = ((angle <= -60) | (angle >= 60)) & (side_a > side_b * VERTICAL_ASPECT)
    state = F.struct(side_a.cast("double").alias("a"), side_b.cast("double").alias("b"), F.when(angle < -30, angle + 180).otherwise(angle).cast("double").alias("angle"), (tall | wide).alias("vertical"))

    def turned(s: Column, when: Column, by: int) -> Column:
        swap = F.struct(s["b"].alias("a"), s["a"].alias("b"), (s["angle"] + by).alias("angle"), s["vertical"].alias("vertical"))
        return F.when(when, swap).otherwise(s)

    first = lambda s: turned(s, ~s["vertical"] & (s["angle"] < 30), 90)
    second = lambda s: turned(s, s["vertical"] & (s["angle"] >= 60), -90)
    third = lambda s: turned(s, ~s["vertical"] & (s["a"] > s["b"]), -90)
    done = let(let(let(state, first), second), third)
    return let(done, lambda s: F.struct(s["a"].alias("thickness"), s["b"].alias("length"), s["angle"].alias("angle"), s["vertical"].alias("vertical")))


def bounding_box(center_x: Column, center_y: Column, width: Column, height: Column, angle: Column) -> Column:
    """struct(x0, y0, x1, y1): the axis-aligned box around a rotated rectangle."""
    c, s = F.abs(F.cos(F.radians(angle))), F.abs(F.sin(F.radians(angle)))
    half_x, half_y = (width * c + height * s) / 2, (width * s + height * c) / 2
    return F.struct((center_x - half_x).alias("x0"), (center_y - half_y).alias("y0"), (center_x + half_x).alias("x1"), (center_y + half_y).alias("y1"))


def crop_width(short: Column, long: Column, height: int = PATCH_HEIGHT) -> Column:
    return F.greatest(F.floor(long * height / F.greatest(short, F.lit(1e-6))), F.lit(1)).cast("int")


def original_point(x: Column, scale: Column, pad: Column) -> Column:
    """A coordinate of the padded map in the original image."""
    return (x - F.floor(pad / 2)) / scale


def line_axis(angle: Column, vertical: Column) -> Column:
    """struct(x, y): the unit vector along a line, down for vertical text and to the right for other."""
    x, y = F.sin(F.radians(angle)), -F.cos(F.radians(angle))
    sign = F.when(F.when(vertical, y < 0).otherwise(x < 0), -1.0).otherwise(1.0)
    return F.struct((x * sign).alias("x"), (y * sign).alias("y"))


def axis_angle(x: Column, y: Column) -> Column:
    """Degrees in (-90, 90]."""
    angle = F.degrees(F.atan2(x, -y))
    return F.when(angle > 90, angle - 180).when(angle <= -90, angle + 180).otherwise(angle)


def dot(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * bx + ay * by


MIN_AXIS_DOT = math.cos(math.radians(12.0))
