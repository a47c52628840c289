"""Images as flat arrays, row by row: sampling, scaling and colours of boxes as Column expressions, and warping over whole arrays.

Width and height may be numbers or columns, so one expression serves images of any size.
A value that is used more than once inside a lambda is bound first, as lambdas are not
searched for common parts.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import (
    BLUR_WIDTH, COLOR_SAMPLES, COLOR_SHARE, COLORS, CROP_BRIGHT, CROP_DARK, CROP_EDGE, CROP_SATURATION, CROP_VALUE, LUMINANCE, WHITE,
)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def _cells(w: Column, h: Column) -> Column:
    return F.sequence(F.lit(0), (w * h - 1).cast("int"))


def _whole(v: Column) -> Column:
    return F.floor(v).cast("int")


def mixed(grid: Column, w: Column, h: Column, at: Column) -> Column:
    """The bilinear value at ``at`` (u, v), in pixels from the centre of the first; held at the edges."""
    u, v = (F.greatest(F.lit(0.0), F.least((s - 1).cast("double"), c)) for s, c in ((w, at["u"]), (h, at["v"])))
    corner = F.struct(_whole(u).alias("x"), _whole(v).alias("y"), (u - F.floor(u)).alias("fx"), (v - F.floor(v)).alias("fy"))

    def between(c: Column) -> Column:
        x, y = F.least(c["x"] + 1, w - 1), F.least(c["y"] + 1, h - 1)
        g = lambda i, j: F.get(grid, (j * w + i).cast("int"))
        top = g(c["x"], c["y"]) * (1 - c["fx"]) + g(x, c["y"]) * c["fx"]
        low = g(c["x"], y) * (1 - c["fx"]) + g(x, y) * c["fx"]
        return top * (1 - c["fy"]) + low * c["fy"]

    return bound(corner, between)


def resampled(grid: Column, w, h, new_w, new_h) -> Column:
    """The image scaled bilinearly, centres of pixels on centres."""
    w, h, new_w, new_h = map(_lit, (w, h, new_w, new_h))
    spot = lambda k: F.struct((((k % new_w) + 0.5) * w / new_w - 0.5).alias("u"), ((F.floor(k / new_w) + 0.5) * h / new_h - 0.5).alias("v"))
    return F.transform(_cells(new_w, new_h), lambda k: bound(spot(k), lambda at: mixed(grid, w, h, at)))


def scaled(grid: Column, w, h, new_w, new_h) -> Column:
    """The image scaled without mixing: each pixel is the one under its centre."""
    w, h, new_w, new_h = map(_lit, (w, h, new_w, new_h))
    under = lambda k: F.floor((F.floor(k / new_w) + 0.5) * h / new_h) * w + F.floor(((k % new_w) + 0.5) * w / new_w)
    return F.transform(_cells(new_w, new_h), lambda k: F.get(grid, under(k).cast("int")))


def spread(lists: pa.Array, size: np.ndarray) -> np.ndarray:
    """The numbers of all lists in a row, each list cut or filled up to its size; NaN for nulls and where a list is filled up."""
    n = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if np.array_equal(n, size):
        return flat
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
    inside = place < size[row]
    out = np.full(int(size.sum()), np.nan)
    out[(np.cumsum(size) - size)[row[inside]] + place[inside]] = flat[inside]
    return out


def homography(p: np.ndarray) -> np.ndarray | None:
    """The eight numbers a to h that take the unit square to the quad p (x0, y0, ...): x = (a s + b t + c) / (g s + h t + 1), y with d, e, f. None for a quad without such a map."""
    x, y = p[0::2], p[1::2]
    (x1, x2, x3), (y1, y2, y3) = ((c[1] - c[2], c[3] - c[2], c[0] - c[1] + c[2] - c[3]) for c in (x, y))
    det = x1 * y2 - x2 * y1
    if not abs(det) > 1e-9:
        return None
    g, h = (x3 * y2 - x2 * y3) / det, (x1 * y3 - x3 * y1) / det
    return np.array([x[1] - x[0] + g * x[1], x[3] - x[0] + h * x[3], x[0], y[1] - y[0] + g * y[1], y[3] - y[0] + h * y[3], y[0], g, h])


def upright(channels: np.ndarray, m: np.ndarray, new_w: int, new_h: int) -> np.ndarray:
    """The upright image of a quad, by inverse sampling: channels (c, h, w) to (c, new_h * new_w), whole values; white where the quad leaves the image."""
    _, h, w = channels.shape
    s, t = (np.arange(new_w) + 0.5) / new_w, ((np.arange(new_h) + 0.5) / new_h)[:, None]
    under = m[6] * s + m[7] * t + 1
    u, v = (m[0] * s + m[1] * t + m[2]) / under - 0.5, (m[3] * s + m[4] * t + m[5]) / under - 0.5
    outside = ~((u >= -0.5) & (u <= w - 0.5) & (v >= -0.5) & (v <= h - 0.5))
    u, v = np.clip(np.nan_to_num(u), 0, w - 1), np.clip(np.nan_to_num(v), 0, h - 1)
    x, y = u.astype(np.int64), v.astype(np.int64)
    fx, fy, x2, y2 = u - x, v - y, np.minimum(x + 1, w - 1), np.minimum(y + 1, h - 1)
    top = channels[:, y, x] * (1 - fx) + channels[:, y, x2] * fx
    low = channels[:, y2, x] * (1 - fx) + channels[:, y2, x2] * fx
    return np.where(outside, float(WHITE), np.floor(top * (1 - fy) + low * fy + 0.5)).reshape(len(channels), -1)


def dominant_in(classes: Column, w, h, box: dict[str, Column]) -> Column:
    """The commonest marking colour in a box of an image given as colour names; UNKNOWN where too few pixels show any.

    The box is widened to whole pixels and held inside the image; every step-th pixel counts, a
    step being a 64th of the longer side. Of equals the first in the order of COLORS.
    """
    w, h = _lit(w), _lit(h)
    held = lambda v, low, high: F.greatest(low, F.least(high, v)).cast("int")
    left, top = held(F.floor(box["left"]), F.lit(0), w - 1), held(F.floor(box["top"]), F.lit(0), h - 1)
    right, bottom = held(F.ceil(box["right"]), left + 1, w), held(F.ceil(box["bottom"]), top + 1, h)
    frame = F.struct(left.alias("l"), top.alias("t"), right.alias("r"), bottom.alias("b"))

    def seen(f: Column) -> Column:
        step = F.greatest(F.lit(1), F.floor(F.greatest(f["r"] - f["l"], f["b"] - f["t"]) / COLOR_SAMPLES)).cast("int")
        rows, cols = F.sequence(f["t"], f["b"] - 1, step), F.sequence(f["l"], f["r"] - 1, step)
        picked = F.flatten(F.transform(rows, lambda y: F.transform(cols, lambda x: F.get(classes, (y * w + x).cast("int")))))
        # without a step, rows are taken whole, which needs no lambda for each pixel
        cut = F.flatten(F.transform(rows, lambda y: F.slice(classes, (y * w + f["l"] + 1).cast("int"), f["r"] - f["l"])))
        return F.when((step == 1) & (F.size(classes) >= w * h), cut).otherwise(picked)

    names = F.array(*(F.lit(c) for c in COLORS[:-1]))

    def best(got: Column) -> Column:
        counts = F.transform(names, lambda c: F.size(got) - F.size(F.array_remove(got, c)))
        shown = lambda n: F.aggregate(n, F.lit(0), lambda a, v: a + v)
        most = lambda n: F.get(names, (F.array_position(n, F.array_max(n)) - 1).cast("int"))
        return bound(counts, lambda n: F.when((shown(n) > 0) & (shown(n) / F.size(got) >= COLOR_SHARE), most(n)).otherwise(COLORS[-1]))

    return bound(bound(frame, seen), best)


def color_codes(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places in COLORS of pixels (0 to 255), by the rules of ``image.hsv`` and ``image.color_class``; NaN stands for null."""
    top, low = np.fmax(np.fmax(r, g), b), np.fmin(np.fmin(r, g), b)
    span = top - low
    with np.errstate(divide="ignore", invalid="ignore"):
        red = (g - b) / span
        red = np.where(red < 0, np.fmod(red + 6, 6), red)
        h = np.where(span == 0, 0.0, np.where(top == r, red, np.where(top == g, (b - r) / span + 2, (r - g) / span + 4))) * 60
        s, v = np.where(top == 0, 0.0, span / top), top / 255
    within = lambda x, y: (h >= x) & (h <= y)
    rules = [
        (v < 0.25, "UNKNOWN"), ((s < 0.16) & (v > 0.72), "WHITE"), (v < 0.28, "BLACK"), (s < 0.18, "UNKNOWN"), (within(0, 22) | (h >= 338), "RED"),
        (within(35, 78), "YELLOW"), (within(80, 155), "GREEN"), (within(156, 210), "CYAN"), (within(211, 260), "BLUE"),
    ]
    return np.select([on for on, _ in rules], [COLORS.index(name) for _, name in rules], COLORS.index("UNKNOWN"))


def code_grid(channels: list[pa.Array], w: int | None, h: int | None) -> np.ndarray:
    """Places in COLORS of one picture's pixels, h by w, from its channels or else its colour names; what is missing is UNKNOWN."""
    w, h = w or 0, h or 0
    if len(channels) == 1:
        codes = pc.index_in(channels[0].flatten(), pa.array(COLORS)).fill_null(len(COLORS) - 1).to_numpy(zero_copy_only=False)
    else:
        size = np.array([max(pc.list_value_length(c).fill_null(0)[0].as_py() for c in channels)])
        codes = color_codes(*(spread(c, size) for c in channels))
    out = np.full(w * h, len(COLORS) - 1)
    out[: len(codes)] = codes[: w * h]
    return out.reshape(h, w)


def dominant_code(grid: np.ndarray, box: tuple) -> int:
    """``dominant_in`` of a grid of places in COLORS and a box (left, top, right, bottom): the place of the colour."""
    h, w = grid.shape
    if not grid.size:
        return len(COLORS) - 1
    left, top = (max(0, min(n - 1, math.floor(v))) for n, v in ((w, box[0]), (h, box[1])))
    right, bottom = (max(low + 1, min(n, math.ceil(v))) for n, low, v in ((w, left, box[2]), (h, top, box[3])))
    step = max(1, max(right - left, bottom - top) // COLOR_SAMPLES)
    seen = grid[top:bottom:step, left:right:step]
    n = np.bincount(seen.ravel(), minlength=len(COLORS))[:-1]
    shown = int(n.sum())
    return int(n.argmax()) if shown and shown / seen.size >= COLOR_SHARE else len(COLORS) - 1


#: Pixels of pictures of one size that are worked on at once, so that they stay in a core's cache.
_PIXELS = 32768


def _each(size: list[pa.Array], more: list[pa.Array], channels: list[pa.Array], some: Callable) -> list:
    """``some`` (three channels as arrays of n images, sizes) of pictures of equal sizes, a few at a time: a result for each; None where a size or a channel is missing or the picture has no pixel."""
    out, alike = [None] * len(size[0]), defaultdict(list)
    given = np.logical_and.reduce([c.is_valid().to_numpy(zero_copy_only=False) for c in channels])
    for i, of in enumerate(zip(*(a.to_pylist() for a in (*size, *more)), strict=True)):
        if None not in of and min(of[:2]) >= 1 and given[i]:
            alike[of].append(i)
    for (w, h, *rest), rows in alike.items():
        n = max(1, _PIXELS // (w * h))
        for at in range(0, len(rows), n):
            few = rows[at : at + n]
            near = few[-1] - few[0] + 1 == len(few)
            lists = [c.slice(few[0], len(few)) if near else c.take(pa.array(few)) for c in channels]
            grids = [spread(c, np.full(len(few), w * h)).reshape(-1, h, w) for c in lists]
            for i, v in zip(few, some(*grids, *rest), strict=True):
                out[i] = v
    return out


def _luminance(r: np.ndarray, g: np.ndarray, b: np.ndarray) -> np.ndarray:
    return r * LUMINANCE[0] + g * LUMINANCE[1] + b * LUMINANCE[2]


@lru_cache(64)
def _threes(old: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A length brought to ``n`` without mixing: what its inner places have before, under and after them, every different three once, and how often it comes."""
    under = np.floor((np.arange(n) + 0.5) * old / n).astype(np.int64)
    three, times = np.unique(np.stack([under[:-2], under[1:-1], under[2:]]), axis=1, return_counts=True)
    return three, times.astype(float)


def blur_score(w: pa.Array, h: pa.Array, new_h: pa.Array, r: pa.Array, g: pa.Array, b: pa.Array) -> pa.Array:
    """The variance of the Laplacian of pictures brought to a width of 320 and a height of ``new_h`` as ``scaled`` does; 0 at the edges, which count.

    A pixel that is repeated has few different neighbours, so values are worked out once and counted.
    """

    def some(r: np.ndarray, g: np.ndarray, b: np.ndarray, nh: int) -> np.ndarray:
        n, h, w = r.shape
        if nh < 3:
            return np.zeros(n)
        (left, x, right), nx = _threes(w, BLUR_WIDTH)
        (above, y, below), ny = _threes(h, nh)
        lum, times = _luminance(r, g, b), np.outer(ny, nx).ravel()
        edge = BLUR_WIDTH * nh - times.sum()
        # take, as indices in brackets would turn the axes around in memory
        lap = (lum.take(left, 2) + lum.take(right, 2) - 4 * lum.take(x, 2)).take(y, 1)
        lap += (lum.take(above, 1) + lum.take(below, 1)).take(x, 2)
        lap = lap.reshape(n, -1)
        gone, total = np.isnan(lap), BLUR_WIDTH * nh
        if gone.any():
            total = total - gone @ times
        lap[gone] = 0.0
        mean = lap @ times / total
        lap -= mean[:, None]
        lap[gone] = 0.0
        lap *= lap
        return (lap @ times + edge * mean * mean) / total

    return pa.array(_each([w, h], [new_h], [r, g, b], some), pa.float64())


def _brought_down(grid: np.ndarray, nw: int, nh: int) -> np.ndarray:
    """Images scaled bilinearly as ``resampled`` does, whole values."""
    _, h, w = grid.shape
    u, v = (np.maximum(0.0, np.minimum(old - 1.0, (np.arange(n) + 0.5) * old / n - 0.5)) for n, old in ((nw, w), (nh, h)))
    x, y = u.astype(np.int64), v.astype(np.int64)
    fx, fy, x2, y2 = u - x, (v - y)[:, None], np.minimum(x + 1, w - 1), np.minimum(y + 1, h - 1)
    along = grid.take(x, 2) * (1 - fx) + grid.take(x2, 2) * fx
    return np.floor(along.take(y, 1) * (1 - fy) + along.take(y2, 1) * fy + 0.5)


def crop_counts(w: pa.Array, h: pa.Array, new_w: pa.Array, new_h: pa.Array, r: pa.Array, g: pa.Array, b: pa.Array) -> pa.Array:
    """The sums of ``image.crop_counts`` over the pixels of each crop, brought down to ``new_w`` by ``new_h`` first where that is smaller."""

    def some(r: np.ndarray, g: np.ndarray, b: np.ndarray, nw: int, nh: int) -> Iterator[dict]:
        if nw * nh < r[0].size:
            r, g, b = (_brought_down(c, nw, nh) for c in (r, g, b))
        r, g, b = (c.reshape(len(c), -1) for c in (r, g, b))
        lum, top, low = _luminance(r, g, b), np.fmax(np.fmax(r, g), b), np.fmin(np.fmin(r, g), b)
        with np.errstate(divide="ignore", invalid="ignore"):
            # without a top there is no value either
            colored = ((top - low) / top > CROP_SATURATION) & (top / 255 > CROP_VALUE)
        on = {"bright": lum > CROP_BRIGHT, "dark": lum < CROP_DARK, "colored": colored, "edge": lum < CROP_EDGE}
        contrast = np.fmax.reduce(lum, 1) - np.fmin.reduce(lum, 1)
        for i in range(len(lum)):
            yield {k: int(np.count_nonzero(v[i])) for k, v in on.items()} | {"contrast": float(contrast[i]), "n": lum[i].size}

    kinds = pa.struct([(k, pa.float64() if k == "contrast" else pa.int64()) for k in ("bright", "dark", "colored", "edge", "contrast", "n")])
    return pa.array(_each([w, h], [new_w, new_h], [r, g, b], some), kinds)
