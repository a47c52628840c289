"""Sizes, angles and thresholds as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BLUR_BELOW, DETECT_SIDE, IMAGE_SIDE, RECOGNISE_HEIGHT, RECOGNISE_MAX, RECOGNISE_MIN, RECOGNISE_STEP, TILT_HIGH, TILT_LOW


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(c, F.lit(high)))


def round_half_up(c: Column) -> Column:
    return F.floor(c + 0.5)


def is_blurred(score: Column) -> Column:
    return score < BLUR_BELOW


def is_tilted(roll: Column) -> Column:
    off = F.abs(roll % 90)
    return (off > TILT_LOW) & (off < TILT_HIGH)


def recognition_width(w: Column, h: Column) -> Column:
    """Width of a crop scaled to the recogniser's height, within its limits, up to a whole number of steps."""
    x = clamp(F.ceil(w * RECOGNISE_HEIGHT / h), RECOGNISE_MIN, RECOGNISE_MAX)
    return (F.ceil(x / RECOGNISE_STEP) * RECOGNISE_STEP).cast("long")


def letterbox(w: Column, h: Column, side: int = DETECT_SIDE) -> dict[str, Column]:
    """Scale, scaled sizes and paddings that fit an image into a square."""
    scale = F.least(side / w, side / h)
    sw, sh = round_half_up(w * scale), round_half_up(h * scale)
    half = lambda x: F.floor((side - x) / 2)
    return {"scale": scale, "new_w": sw, "new_h": sh, "pad_x": half(sw), "pad_y": half(sh)}


def resized(w: Column, h: Column, side: int = IMAGE_SIDE) -> tuple[Column, Column]:
    """Sizes with the longer side brought down to ``side``; fractions are cut off."""
    long = F.greatest(w, h)
    f = F.when(long > side, side / long).otherwise(1.0)
    return (w * f).cast("long"), (h * f).cast("long")


def right_angle(degrees: Column) -> Column:
    """Degrees between 0 and 360, as a turn of the other way may leave them below 0."""
    return F.pmod(degrees, F.lit(360))


def unaccounted(total: Column, *phases: Column) -> Column:
    """What of a run's time no phase accounts for; never below 0."""
    spent = phases[0]
    for p in phases[1:]:
        spent = spent + p
    return F.greatest(F.lit(0), total - spent)
