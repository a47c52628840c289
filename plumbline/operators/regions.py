"""Regions of an image: connected components, greedy line merging, decoding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..constants import (
    AREA_MIN, COLORS, HEAT_MIN_SIZE, HEAT_THRESHOLD, MERGE_CENTER, MERGE_GAP_HEIGHT, MERGE_GAP_IMAGE, MERGE_HEIGHT_RATIO, MERGE_OVERLAP, MERGE_PADDING, MERGE_UNION_HEIGHT, MERGE_WIDTH_OVERLAP,
)
from ..functions import geometry as G
from ..functions import image as I
from ..functions import raster as R

#: Images of a batch that are worked on at once.
_IMAGES = 16


def argmax(scores: Column) -> Column:
    """Place (from 0) of the largest number, the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def emitted(classes: Column) -> Column:
    """Places of a best path that emit a symbol: not blank (0) and not the class before."""
    return F.filter(F.sequence(F.lit(0), F.size(classes) - 1), lambda t: (F.get(classes, t) > 0) & ((t == 0) | (F.get(classes, t) != F.get(classes, t - 1))))


def decoded(classes: Column, symbols: Column) -> Column:
    """Text of a best path; classes beyond the dictionary (array of symbols, 0 the blank) emit nothing."""
    return F.array_join(F.transform(F.filter(emitted(classes), lambda t: F.get(classes, t) < F.size(symbols)), lambda t: F.get(symbols, F.get(classes, t))), "")


def _joined_runs(image: np.ndarray, y: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For runs of lit pixels in reading order, image by image: the first run of each run's component.

    Runs of neighbouring rows that overlap are linked; links go to the smaller number and are
    then followed to their ends, for all images of a batch at once, until no link joins two components.
    """
    top = np.arange(len(y))
    if not len(y):
        return top
    # one number line for all: a spare column parts rows, a spare row parts images
    wide, tall = int(high.max()) + 2, int(y.max()) + 2
    base = (image * tall + y) * wide
    start, end = base + low, base + high
    first = np.searchsorted(end, start - wide)
    n = np.maximum(np.searchsorted(start, end - wide, "right") - first, 0)
    lower = np.repeat(top, n)
    upper = np.repeat(first, n) + np.arange(len(lower)) - np.repeat(np.cumsum(n) - n, n)
    while True:
        a, b = top[lower], top[upper]
        apart = a != b
        if not apart.any():
            return top
        np.minimum.at(top, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (top[top] != top).any():
            top = top[top]


def _numbered_runs(ids: np.ndarray, image: np.ndarray, y: np.ndarray, low: np.ndarray, high: np.ndarray, min_size: int) -> pa.RecordBatch:
    """The runs of components of ``min_size`` pixels and more, components numbered from 0 in each image by their first pixel."""
    top = _joined_runs(image, y, low, high)
    keep = np.bincount(top, weights=high - low + 1, minlength=len(y)) >= min_size
    heads = np.flatnonzero(keep & (top == np.arange(len(y))))
    number = np.zeros(len(y), np.int64)
    number[heads] = np.arange(len(heads)) - np.searchsorted(image[heads], image[heads])
    kept = np.flatnonzero(keep[top])
    return pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in (ids[image[kept]], number[top[kept]], y[kept], low[kept], high[kept])], ["image", "component", "y", "x0", "x1"])


_RUNS = "image long, component long, y long, x0 long, x1 long"


def _from_maps(maps: DataFrame, threshold: float, min_size: int, use: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``use`` of the numbered runs of some whole images at a time."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _IMAGES):
                b = whole.slice(at, _IMAGES)
                heat = b.column(2)
                size = pc.list_value_length(heat).fill_null(0).to_numpy(zero_copy_only=False)
                lit = heat.flatten().fill_null(0).to_numpy(zero_copy_only=False) > threshold
                image = np.repeat(np.arange(b.num_rows), size)
                width = np.maximum(b.column(1).fill_null(1).to_numpy(zero_copy_only=False), 1).astype(np.int64)[image]
                place = np.arange(len(lit)) - np.repeat(np.cumsum(size) - size, size)
                x = place % width
                edge = np.empty(len(lit), bool)
                edge[:1], edge[1:] = True, ~lit[:-1]
                starts = np.flatnonzero(lit & (edge | (x == 0)))
                edge[-1:], edge[:-1] = True, ~lit[1:]
                ends = np.flatnonzero(lit & (edge | (x == width - 1)))
                ids = b.column(0).to_numpy(zero_copy_only=False)
                yield use(_numbered_runs(ids, image[starts], (place // width)[starts], x[starts], x[ends], min_size))

    return maps.select("image", "width", "heat").mapInArrow(task, schema)


def component_runs(maps: DataFrame, threshold: float = HEAT_THRESHOLD, min_size: int = HEAT_MIN_SIZE) -> DataFrame:
    """4-neighbour components of the values above ``threshold`` in maps (image, width, heat row by row): image, component, y, x0, x1, a row for each run of pixels.

    An image is a row of ``maps`` and never leaves its task; no shuffle.
    """
    return _from_maps(maps, threshold, min_size, lambda runs: runs, _RUNS)


def _rects(runs: pa.RecordBatch) -> pa.RecordBatch:
    """Principal-axis rectangles, as ``geometry.pca_rect`` gives them, of the components of 3 pixels and more: sums over runs in closed form, extents from their ends."""
    image, component, y, x0, x1 = (c.to_numpy() for c in runs.columns)
    order = np.lexsort((component, image))
    image, component, y, x0, x1 = (v[order] for v in (image, component, y, x0, x1))
    new = np.ones(len(y), bool)
    new[1:] = (image[1:] != image[:-1]) | (component[1:] != component[:-1])
    heads = np.flatnonzero(new)
    of = np.cumsum(new) - 1
    total = lambda v: np.add.reduceat(v, heads) if len(heads) else v
    squares = lambda x: x * (x + 1) * (2 * x + 1)
    n, twice = x1 - x0 + 1, (x0 + x1) * (x1 - x0 + 1)
    k, sx, sy, sxx, syy, sxy = (total(v).astype(float) for v in (n, twice, n * y, squares(x1) - squares(x0 - 1), n * y * y, twice * y))
    sx, sxx, sxy = sx / 2, sxx / 6, sxy / 2
    cx, cy, cxx, cyy, cxy = sx / k, sy / k, (k * sxx - sx * sx) / (k * k), (k * syy - sy * sy) / (k * k), (k * sxy - sx * sy) / (k * k)
    half = (cxx + cyy) / 2
    disc = np.sqrt(np.maximum(0.0, half * half - (cxx * cyy - cxy * cxy)))
    angle = np.where(np.abs(cxy) > 1e-10, np.arctan2(cxy, half + disc - cyy), np.where(cxx >= cyy, 0.0, np.pi / 2))
    co, si, dy = np.cos(angle)[of], np.sin(angle)[of], y - cy[of]
    ends = [x - cx[of] for x in (x0, x1)]

    def extent(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if not len(heads):
            return a
        return np.maximum(1.0, np.maximum.reduceat(np.maximum(a, b), heads) - np.minimum.reduceat(np.minimum(a, b), heads))

    w, h = extent(*(dx * co + dy * si for dx in ends)), extent(*(dy * co - dx * si for dx in ends))
    kept = np.flatnonzero(k >= 3)
    out = [image[heads], component[heads], k.astype(np.int64), cx, cy, angle, w, h]
    return pa.RecordBatch.from_arrays([pa.array(v[kept]) for v in out], ["image", "component", "n", "cx", "cy", "angle", "w", "h"])


def component_rects(maps: DataFrame, threshold: float = HEAT_THRESHOLD, min_size: int = HEAT_MIN_SIZE) -> DataFrame:
    """The principal-axis rectangle of each of the components of ``component_runs``: image, component, n, cx, cy, angle, w, h; no shuffle."""
    return _from_maps(maps, threshold, min_size, _rects, "image long, component long, n long, cx double, cy double, angle double, w double, h double")


def run_pixels(runs: DataFrame) -> DataFrame:
    """The pixels (image, component, x, y) of runs."""
    return runs.select("image", "component", F.explode(F.sequence("x0", "x1")).alias("x"), "y")


def components(pixels: DataFrame, min_size: int) -> DataFrame:
    """4-neighbour components of lit pixels (image, x, y): image, component, x, y; smaller ones are left out.

    ``component`` numbers an image's components by their first pixel in reading order. An
    image, whose size is fixed, is the unit of work.
    """
    places = pixels.groupBy("image").agg(F.sort_array(F.collect_set(F.struct("y", "x"))).alias("p")).select("image", F.col("p.y").alias("y"), F.col("p.x").alias("x"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _IMAGES):
                b = whole.slice(at, _IMAGES)
                image = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column(1)).to_numpy(zero_copy_only=False))
                y, x = (b.column(k).flatten().to_numpy(zero_copy_only=False) for k in (1, 2))
                new = np.ones(len(x), bool)
                new[1:] = (x[1:] != x[:-1] + 1) | (y[1:] != y[:-1]) | (image[1:] != image[:-1])
                starts = np.flatnonzero(new)
                ends = np.append(starts[1:], len(x)) - 1 if len(x) else starts
                yield _numbered_runs(b.column(0).to_numpy(zero_copy_only=False), image[starts], y[starts], x[starts], x[ends], min_size)

    return run_pixels(places.mapInArrow(task, _RUNS))


def largest(regions: DataFrame, key: str, n: int, least_area: float = AREA_MIN) -> DataFrame:
    """Of each image's regions (ord, area) the ``n`` largest above ``least_area``, ties as they stand, with their rank."""
    w = Window.partitionBy(key).orderBy(F.desc("area"), "ord")
    return regions.where(F.col("area") > least_area).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


_BOX = "struct<left:double,top:double,right:double,bottom:double,color:string>"
_SIDES = ("left", "top", "right", "bottom")


def merged_boxes(boxes: Column, image_w: Column, color_of: Callable[[dict[str, Column]], Column] | None = None) -> Column:
    """Greedy merging of an array of boxes (left, top, right, bottom) that share a line.

    The first pair that fits, in order, merges into its first box, and the search begins anew.
    This is a fold: its state is the boxes that are left and whether the last search found a
    pair. ``color_of`` gives the colour of a box; boxes of different known colours stay apart.
    """
    sides = lambda b: {k: b[k] for k in _SIDES}
    color = color_of or (lambda b: F.lit(COLORS[-1]))
    whole = lambda b: F.struct(*(b[k].cast("double").alias(k) for k in _SIDES), color(b).alias("color")).cast(_BOX)

    def first_pair(x: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(x) - 1)
        fits = lambda i, j: G.same_line(sides(F.get(x, i)), sides(F.get(x, j)), image_w, I.colors_fit(F.get(x, i)["color"], F.get(x, j)["color"]))
        partner = lambda i: F.array_min(F.filter(places, lambda j: (j > i) & fits(i, j)))
        return F.get(F.filter(F.transform(places, lambda i: F.struct(i.alias("i"), partner(i).alias("j"))), lambda p: p["j"].isNotNull()), F.lit(0))

    def step(state: Column) -> Column:
        x = state["x"]

        def next_of(p: Column) -> Column:
            put = lambda m: F.filter(F.transform(x, lambda b, k: F.when(k == p["i"], m).otherwise(b)), lambda b, k: k != p["j"])
            both = F.struct(*(v.alias(k) for k, v in G.line_box(sides(F.get(x, p["i"])), sides(F.get(x, p["j"]))).items()))
            return F.when(p.isNull(), F.struct(x.alias("x"), F.lit(False).alias("open"))).otherwise(F.struct(R.bound(R.bound(both, lambda b: whole(sides(b))), put).alias("x"), F.lit(True).alias("open")))

        return F.when(state["open"], R.bound(first_pair(x), next_of)).otherwise(state)

    start = F.struct(F.transform(boxes, lambda b: whole(sides(b))).alias("x"), F.lit(True).alias("open"))
    return F.when(F.size(boxes) > 1, F.aggregate(F.sequence(F.lit(1), F.size(boxes)), start, lambda s, _: step(s), lambda s: s["x"])).otherwise(F.transform(boxes, lambda b: whole(sides(b))))


def _listed(boxes: DataFrame, *more: str) -> DataFrame:
    """Each image's boxes (ord, left, top, right, bottom) in order, an array; an image has few."""
    return boxes.groupBy("image").agg(F.sort_array(F.collect_list(F.struct("ord", *_SIDES, *more))).alias("boxes"))


def badges(shown: DataFrame, key: str, order: str) -> DataFrame:
    """Regions that are shown with their badge: they are counted from 1, while their own number (order) keeps the gaps of those that are not."""
    return shown.withColumn("badge", F.row_number().over(Window.partitionBy(key).orderBy(order)))


def merge_lines(boxes: DataFrame, image_w: float) -> DataFrame:
    """Boxes (image, ord, left, top, right, bottom) of unknown colour, merged: image, line, left, top, right, bottom."""
    out = _listed(boxes).select("image", F.posexplode(merged_boxes(F.col("boxes"), F.lit(image_w))).alias("line", "b"))
    return out.select("image", F.col("line").cast("long").alias("line"), *(F.col(f"b.{k}") for k in _SIDES))


def _on_line(a: tuple, b: tuple, image_w: int | None) -> bool:
    """``geometry.same_line`` and ``image.colors_fit`` of two boxes (left, top, right, bottom, place of the colour in COLORS)."""
    high, low = max(a[3] - a[1], 1.0), max(b[3] - b[1], 1.0)
    high, low = max(high, low), min(high, low)
    gap = max(max(a[0], b[0]) - min(a[2], b[2]), 0.0)
    return (
        high / low <= MERGE_HEIGHT_RATIO
        and max(min(a[3], b[3]) - max(a[1], b[1]), 0.0) / low >= MERGE_OVERLAP
        and abs((a[1] + a[3]) / 2 - (b[1] + b[3]) / 2) <= high * MERGE_CENTER
        and max(min(a[2], b[2]) - max(a[0], b[0]), 0.0) <= min(max(a[2] - a[0], 1.0), max(b[2] - b[0], 1.0)) * MERGE_WIDTH_OVERLAP
        and gap <= (high * MERGE_GAP_HEIGHT if image_w is None else min(high * MERGE_GAP_HEIGHT, image_w * MERGE_GAP_IMAGE))
        and max(a[3], b[3]) - min(a[1], b[1]) <= high * MERGE_UNION_HEIGHT
        and (a[4] == b[4] or COLORS[a[4]] == "UNKNOWN" or COLORS[b[4]] == "UNKNOWN")
    )


def _both(a: tuple, b: tuple) -> tuple[float, ...]:
    """``geometry.line_box`` of two boxes."""
    wide, other = max(a[2] - a[0], 1.0), max(b[2] - b[0], 1.0)
    ha, hb = a[3] - a[1], b[3] - b[1]
    at = ((a[1] + a[3]) / 2 * wide + (b[1] + b[3]) / 2 * other) / (wide + other)
    half = max(ha, hb, (ha + hb) / 2 * MERGE_PADDING) / 2
    return min(a[0], b[0]), at - half, max(a[2], b[2]), at + half


def _merged(boxes: list[tuple], image_w: int | None, color: Callable[[tuple], int]) -> list[tuple]:
    """The boxes of one picture merged as ``merged_boxes`` does."""
    x = [(*b, color(b)) for b in boxes]
    while pair := next(((i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if _on_line(x[i], x[j], image_w)), None):
        i, j = pair
        both = _both(x[i], x[j])
        x[i] = (*both, color(both))
        del x[j]
    return x


def merge_polygons(polygons: DataFrame, pictures: DataFrame) -> DataFrame:
    """Polygons (image, ord, p) merged by line and colour: image, line, p. A single polygon of an image stays as it is, rotated or not.

    ``pictures`` has image, w, h and classes, the colour names of its pixels row by row, or else
    the channels r, g and b to name; an image is one row of it. The boxes are the side of the
    join that is held: pictures are never broadcast, and stay where they are if dealt out by image.
    A picture goes to its task once, with its boxes, and only polygons come back.
    """
    boxed = polygons.select("image", "ord", "p", *(v.alias(k) for k, v in G.bbox(F.col("p")).items()))
    named = "classes" in pictures.columns
    pixels = [F.col("classes")] if named else [F.col(k).cast("array<double>").alias(k) for k in "rgb"]
    met = _listed(boxed, "p").hint("shuffle_hash").join(pictures.select("image", "w", "h", *pixels), "image")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # pixels of pictures with a single polygon are not looked at
            found, out = b.column(1).to_pylist(), []
            for i, (w, h, boxes) in enumerate(zip(b.column(2).to_pylist(), b.column(3).to_pylist(), found, strict=True)):
                if len(boxes) > 1:
                    grid = R.code_grid([c.slice(i, 1) for c in b.columns[4:]], w, h)
                    lines = _merged([tuple(x[k] for k in _SIDES) for x in boxes], w, lambda box: R.dominant_code(grid, box))  # noqa: B023
                    out.append([[x[k] for k in (0, 1, 2, 1, 2, 3, 0, 3)] for x in lines])
                else:
                    out.append([x["p"] for x in boxes])
            size = [len(x) for x in out]
            columns = [b.column(0).take(pa.array(np.repeat(np.arange(b.num_rows), size))), pa.array([k for n in size for k in range(n)], pa.int32()), pa.array([p for x in out for p in x], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["image", "line", "p"])

    given = met.select("image", "boxes", "w", "h", *(["classes"] if named else "rgb"))
    return given.mapInArrow(task, StructType([given.schema["image"], StructField("line", IntegerType()), StructField("p", ArrayType(DoubleType()))]))
