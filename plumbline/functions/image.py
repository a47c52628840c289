"""Colour, contrast and recognition scores as Column expressions. Single precision where thresholds are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import (
    COLORS, CONTRAST_LIFT, CROP_BRIGHT, CROP_BRIGHT_SHARE, CROP_COLORED_LEAST, CROP_DARK, CROP_EDGE, CROP_EDGE_LEAST, CROP_EDGE_SHARE, CROP_FEW, CROP_FLAT, CROP_PLAIN, CROP_SATURATION, CROP_VALUE,
    CONTRAST_MAX_SCALE, CONTRAST_MIN_RANGE, CONTRAST_SPAN, ERROR_TOKENS, KEEP_RATIO, KEEP_SHORT, KEEP_SHORT_CONFIDENCE, LUMINANCE,
    RECOGNISED_CONFIDENCE, RECOGNISED_RATIO, RECOGNISED_USEFUL, SCORE_CONFIDENCE, SCORE_LENGTH, SCORE_LENGTH_MAX, SCORE_RATIO,
)
from .text import trimmed, useful_count


def f32(x: float) -> Column:
    return F.lit(x).cast("float")


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * LUMINANCE[0] + g * LUMINANCE[1] + b * LUMINANCE[2]


def saturation(r: Column, g: Column, b: Column) -> Column:
    top = F.greatest(r, g, b)
    return F.when(top == 0, 0.0).otherwise((top - F.least(r, g, b)) / top)


def crop_counts(r: Column, g: Column, b: Column) -> list[Column]:
    """Sums over a crop's pixels that tell whether there is anything to read."""
    lum, value = luminance(r, g, b), F.greatest(r, g, b) / 255
    n = lambda on, name: F.count_if(on).alias(name)
    return [
        n(lum > CROP_BRIGHT, "bright"), n(lum < CROP_DARK, "dark"), n((saturation(r, g, b) > CROP_SATURATION) & (value > CROP_VALUE), "colored"), n(lum < CROP_EDGE, "edge"),
        (F.max(lum) - F.min(lum)).alias("contrast"), F.count("*").alias("n"),
    ]


def is_useful_crop() -> Column:
    """Over ``crop_counts``: neither bright all over, nor without colour and edges, nor flat."""
    c, share = F.col, lambda k: F.col(k) / F.col("n")
    pale = share("colored") < CROP_FEW
    blank = (share("bright") > CROP_BRIGHT_SHARE) & (share("dark") < CROP_FEW) & pale & (c("contrast") < CROP_FLAT)
    plain = pale & (share("edge") < CROP_EDGE_SHARE) & (c("contrast") < CROP_PLAIN)
    flat = (c("colored") < CROP_COLORED_LEAST) & (c("edge") < CROP_EDGE_LEAST) & (c("contrast") < CROP_FLAT)
    return ~(blank | plain | flat)


def color_class(h: Column, s: Column, v: Column) -> Column:
    """Marking colour of hue (0 to 360), saturation and value (0 to 1)."""
    return (
        F.when(v < 0.25, "UNKNOWN")
        .when((s < 0.16) & (v > 0.72), "WHITE")
        .when(v < 0.28, "BLACK")
        .when(s < 0.18, "UNKNOWN")
        .when(h.between(0, 22) | (h >= 338), "RED")
        .when(h.between(35, 78), "YELLOW")
        .when(h.between(80, 155), "GREEN")
        .when(h.between(156, 210), "CYAN")
        .when(h.between(211, 260), "BLUE")
        .otherwise("UNKNOWN")
    )


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue (0 to 360), saturation and value (0 to 1) of a pixel (0 to 255)."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    span = (top - low).cast("double")
    h = F.when(span == 0, 0.0).when(top == r, F.pmod((g - b) / F.nullif(span, F.lit(0.0)), F.lit(6.0))).when(top == g, (b - r) / F.nullif(span, F.lit(0.0)) + 2).otherwise((r - g) / F.nullif(span, F.lit(0.0)) + 4)
    return h * 60, saturation(r, g, b), top / 255


def dominant(pixels: DataFrame, key: str, box: tuple[int, int, int, int], least: float = 0.01) -> DataFrame:
    """(key, color): the commonest marking colour of each image's pixels (x, y, color) in a box (left, top, right, bottom), the right and bottom edges outside.

    Every step-th pixel counts, a step being a 64th of the longer side; UNKNOWN where fewer than ``least`` of them show a colour.
    """
    left, top, right, bottom = box
    step = max(1, max(right - left, bottom - top) // 64)
    inside = (F.col("x") >= left) & (F.col("x") < right) & (F.col("y") >= top) & (F.col("y") < bottom) & ((F.col("x") - left) % step == 0) & ((F.col("y") - top) % step == 0)
    order = F.array_position(F.array(*(F.lit(c) for c in COLORS)), F.col("color"))
    by = pixels.where(inside).groupBy(key, "color").agg(F.count("*").alias("n"))
    known = F.col("color") != "UNKNOWN"
    best = by.groupBy(key).agg(F.max_by(F.when(known, F.col("color")), F.when(known, F.struct(F.col("n"), -order))).alias("best"), F.sum(F.when(known, F.col("n"))).alias("valid"), F.sum("n").alias("all"))
    return best.select(key, F.coalesce(F.when(F.col("valid") / F.col("all") >= least, F.col("best")), F.lit("UNKNOWN")).alias("color"))


def laplacian(grid: Column, width, height, times: int = 255) -> Column:
    """``times`` the four-neighbour Laplacian of a grid given row by row; 0 at its edges."""
    at = lambda i: F.get(grid, i)
    width, height = (v if isinstance(v, Column) else F.lit(v) for v in (width, height))

    def one(i: Column) -> Column:
        y, x = F.floor(i / width), i % width
        edge = (y == 0) | (y == height - 1) | (x == 0) | (x == width - 1)
        return F.when(edge, 0.0).otherwise(times * (at(i - 1) + at(i + 1) + at(i - width) + at(i + width) - 4 * at(i)))

    return F.transform(F.sequence(F.lit(0), (width * height - 1).cast("int")), one)


def stretched(v: Column, scale: Column, bias: Column) -> Column:
    """A channel after ``contrast``, held between 0 and 255."""
    return F.greatest(F.lit(0.0), F.least(F.lit(255.0), v * scale + bias))


def detection_input(v: Column) -> Column:
    """A channel value (0 to 255) as the detector takes it."""
    return (v / 255 - 0.485) / 0.229


def recognition_input(v: Column) -> Column:
    """A channel value (0 to 255) as the recogniser takes it."""
    return v / 127.5 - 1


def planes(pixels: Column) -> Column:
    """Pixels [[r, g, b], ...] as all reds, then all greens, then all blues."""
    channel = lambda c: F.transform(pixels, lambda p: F.get(p, F.lit(c)))
    return F.flatten(F.array(*(channel(c) for c in range(3))))


def colors_fit(a: Column, b: Column) -> Column:
    """Unknown goes with anything."""
    return (a == "UNKNOWN") | (b == "UNKNOWN") | (a == b)


def contrast(low: Column, high: Column) -> tuple[Column, Column]:
    """(scale, bias) that stretch a range of luminance; a narrow range stays as it is."""
    span = high - low
    scale = F.when(span < CONTRAST_MIN_RANGE, 1.0).otherwise(F.least(CONTRAST_SPAN / span, F.lit(CONTRAST_MAX_SCALE)))
    return scale, F.when(span < CONTRAST_MIN_RANGE, 0.0).otherwise(-low * scale + CONTRAST_LIFT)


def useful_ratio(text: Column) -> Column:
    t = trimmed(text)
    return F.when(F.length(t) == 0, 0.0).otherwise(useful_count(t) / F.length(t)).cast("float")


def is_error(text: Column) -> Column:
    return F.upper(trimmed(text)).isin(*ERROR_TOKENS)


def is_confident(text: Column, confidence: Column) -> Column:
    """Good enough not to try the other way up."""
    return (confidence >= f32(RECOGNISED_CONFIDENCE)) & (useful_ratio(text) >= f32(RECOGNISED_RATIO)) & (useful_count(trimmed(text)) >= RECOGNISED_USEFUL) & ~is_error(text)


def recognition_score(text: Column, confidence: Column) -> Column:
    t = trimmed(text)
    s = confidence * f32(SCORE_CONFIDENCE) + useful_ratio(text) * f32(SCORE_RATIO) + F.least(F.length(t), F.lit(SCORE_LENGTH_MAX)).cast("float") * f32(SCORE_LENGTH)
    return F.when(t == "", f32(0)).otherwise(s)


def is_kept(text: Column, confidence: Column) -> Column:
    n = useful_count(trimmed(text))
    return (trimmed(text) != "") & ~is_error(text) & (n > 0) & (useful_ratio(text) >= f32(KEEP_RATIO)) & ~((n <= KEEP_SHORT) & (confidence < f32(KEEP_SHORT_CONFIDENCE)))
