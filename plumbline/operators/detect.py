"""From heat maps to recognised regions, as one chain.

Each step is a DataFrame of regions keyed by image and, once the largest are chosen, by
``index`` (from 1). Steps that leave regions out keep the index of those that stay, so that
gaps show what was dropped. Only steps that need pixels meet the pictures, by image. The
models' outputs, heat maps and read texts, come as tables.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..constants import AREA_MIN, BLUR_WIDTH, CROP_CHECK, CROP_MIN, EXPAND_X, EXPAND_Y, MAX_REGIONS, TALL, WHITE
from ..functions import geometry as G
from ..functions import image as I
from ..functions import numeric as N
from ..functions import raster as R
from . import match, regions
from .keep import saved

_ID = ["image", "index"]
_SUMS = ["bright", "dark", "colored", "edge", "contrast", "n"]


class Phases:
    """How long each step took, where a clock (seconds) is given; steps are then worked out one by one and kept. Without one nothing is run."""

    def __init__(self, clock: Callable[[], float] | None = None):
        self.clock, self.seconds, self.start = clock, {}, clock() if clock else 0.0

    def __call__(self, name: str, df: DataFrame) -> DataFrame:
        if self.clock is None:
            return df
        before = self.clock()
        out = saved(df)
        self.seconds[name] = self.seconds.get(name, 0.0) + self.clock() - before
        return out

    def milliseconds(self) -> dict[str, int]:
        """Every step's time, the total, and what no step accounts for."""
        total = self.clock() - self.start if self.clock else 0.0
        spent = {k: int(round(1000 * v)) for k, v in self.seconds.items()}
        return spent | {"total": int(round(1000 * total)), "other": max(0, int(round(1000 * (total - sum(self.seconds.values())))))}


def polygons(maps: DataFrame, frames: DataFrame) -> DataFrame:
    """Polygons (image, ord, p) in the image's own pixels, of the heat map's components in order; specks are left out before any merging.

    ``frames`` (image, w, h, scale, pad_x, pad_y) tells how an image was fitted into the map.
    """
    rects = regions.component_rects(maps)
    quad = G.unclipped(*(F.col(c) for c in ("cx", "cy", "rw", "rh", "angle")))
    c = F.col
    placed = rects.withColumnsRenamed({"w": "rw", "h": "rh"}).join(frames.select("image", "w", "h", "scale", "pad_x", "pad_y"), "image")
    back = G.inverse_letterbox(quad, c("scale"), c("pad_x"), c("pad_y"), c("w"), c("h"))
    # bound, as the filter is pushed below and would else hold the polygon's expression at each use
    out = placed.select("image", c("component").alias("ord"), R.bound(back, lambda p: F.struct(p.alias("p"), G.area(p).alias("area"))).alias("s"))
    return out.where(c("s.area") > AREA_MIN).select("image", "ord", "s.p")


def chosen(lines: DataFrame, n: int = MAX_REGIONS) -> DataFrame:
    """The ``n`` largest polygons (image, line, p) of each image with their index; equals as they stand."""
    sized = lines.select("image", F.col("line").alias("ord"), "p", G.area(F.col("p")).alias("area"))
    return regions.largest(sized, "image", n, -1.0).select("image", F.col("rank").alias("index"), "p")


def cropped(found: DataFrame, pictures: DataFrame) -> DataFrame:
    """Regions (image, index, p) widened, with the box around them and the upright crop: p, left, top, right, bottom, cw, ch, r, g, b.

    ``pictures`` (image, w, h, r, g, b) holds the channels row by row. A quad without a
    perspective map gives the crop of the box around it.
    """
    pic = pictures.select("image", "w", "h", "r", "g", "b")
    # the regions are the side that is held: pictures are never broadcast, and stay where they are if dealt out by image
    wide = found.hint("shuffle_hash").join(pic, "image").withColumn("p", G.expanded(F.col("p"), EXPAND_X, F.col("w"), F.col("h"), EXPAND_Y))
    wide = wide.withColumns({k: v.cast("int") for k, v in G.int_bbox(F.col("p")).items()})
    quad = G.corner_order(F.col("p"))
    box = G.as_polygon({k: F.col(k).cast("double") for k in ("left", "top", "right", "bottom")})
    wide = wide.select(*_ID, "p", "left", "top", "right", "bottom", "w", "h", quad.alias("quad"), box.alias("box"), "r", "g", "b")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                one = b.slice(i, 1)
                w, h, quad, box = (one.column(k)[0].as_py() for k in range(7, 11))
                m = R.homography(np.array(quad))
                if m is None:
                    quad, m = box, R.homography(np.array(box))
                cw, ch = _crop_size(quad)
                grid = np.stack([one.column(k).flatten().to_numpy() for k in (11, 12, 13)]).reshape(3, h, w)
                # a box without area has no map either
                out = R.upright(grid, m, cw, ch) if m is not None else np.full((3, cw * ch), float(WHITE))
                lists = [pa.array([v], pa.list_(pa.float64())) for v in out]
                yield pa.RecordBatch.from_arrays([*one.columns[:7], pa.array([cw], pa.int32()), pa.array([ch], pa.int32()), *lists], [*one.schema.names[:7], "cw", "ch", "r", "g", "b"])

    return wide.mapInArrow(task, "image long, index int, p array<double>, left int, top int, right int, bottom int, cw int, ch int, r array<double>, g array<double>, b array<double>")


def _crop_size(q: list[float]) -> tuple[int, int]:
    """Means of opposite sides, cut to whole numbers between 1 and 2000."""
    side = lambda a, b: math.hypot(q[2 * a] - q[2 * b], q[2 * a + 1] - q[2 * b + 1])
    return tuple(max(1, min(2000, int(v))) for v in ((side(0, 1) + side(3, 2)) / 2, (side(0, 3) + side(1, 2)) / 2))


def _measured(pictures: DataFrame, keep: list[str], sizes: list[Column], use: Callable[..., pa.Array], more: list[StructField]) -> DataFrame:
    """The columns ``keep`` and what ``use`` makes of sizes and channels, row by row: no pixel leaves its picture. Rows of which it makes nothing are left out."""
    n = len(keep)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = use(*b.columns[n:])
            columns = got.flatten() if pa.types.is_struct(got.type) else [got]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *columns], [*b.schema.names[:n], *(f.name for f in more)]).filter(got.is_valid())

    given = pictures.select(*keep, *(s.alias(f"_s{i}") for i, s in enumerate(sizes)), *(F.col(k).cast("array<double>").alias(f"_{k}") for k in "rgb"))
    return given.mapInArrow(task, StructType([*given.schema.fields[:n], *more]))


def _counted(crops: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of crops of 8 pixels each way and more, with their pixel counts. Crops over 128 pixels are brought down to that first."""
    c, long = F.col, F.greatest("cw", "ch")
    fit = lambda v: F.when(long > CROP_CHECK, F.greatest(F.lit(1), (v * (CROP_CHECK / long)).cast("int"))).otherwise(v)
    small = crops.where((c("cw") >= CROP_MIN) & (c("ch") >= CROP_MIN))
    sums = [StructField(k, DoubleType() if k == "contrast" else LongType()) for k in _SUMS]
    return _measured(small, keep, [c("cw"), c("ch"), fit(c("cw")), fit(c("ch"))], R.crop_counts, sums)


def crop_sums(crops: DataFrame, *key: str) -> DataFrame:
    """Counts over the pixels of the crops (key, cw, ch, r, g, b) of 8 pixels each way and more, a row for each crop."""
    return _counted(crops, list(key))


def useful(crops: DataFrame, *key: str) -> DataFrame:
    """The keys of the crops worth reading: 8 pixels each way at least, and neither blank nor flat."""
    return crop_sums(crops, *key).where(I.is_useful_crop()).select(*key)


def read(crops: DataFrame, reads: DataFrame) -> DataFrame:
    """Crops with the better of their two readings, and how many of each kind were made.

    ``reads`` (image, index, text, confidence, text_r, confidence_r) holds the readings of a crop
    turned level, as it is and upside down; the second is only made where the first is not sure.
    """
    c = F.col
    better = I.recognition_score(c("text_r"), c("confidence_r")) > I.recognition_score(c("text"), c("confidence"))
    judged = crops.join(reads, _ID).withColumn("_sure", I.is_confident(c("text"), c("confidence"))).withColumn("_turned", ~c("_sure") & better)
    sure, turned = c("_sure"), c("_turned")
    return judged.select(
        *crops.columns,
        (c("ch") > c("cw") * TALL).alias("turned"),
        F.when(turned, "rotated").otherwise("normal").alias("side"),
        F.when(turned, c("text_r")).otherwise(c("text")).alias("text"),
        F.when(turned, c("confidence_r")).otherwise(c("confidence")).alias("confidence"),
        F.lit(1).alias("normal_count"),
        F.when(sure, 0).otherwise(1).alias("rotated_count"),
    )


def run(maps: DataFrame, frames: DataFrame, pictures: DataFrame, reads: DataFrame, n: int = MAX_REGIONS, phases: Phases | None = None) -> tuple[DataFrame, DataFrame]:
    """(items, counts): what is read in each image, and how many readings each image took, those that were thrown away included.

    Items have image, index, the box, p, turned, side, text and confidence.
    """
    phase = phases or Phases()
    found = phase("detection", chosen(regions.merge_polygons(polygons(maps, frames), pictures), n))
    crops = phase("crop", cropped(found, pictures))
    good = phase("crop_check", _counted(crops, [k for k in crops.columns if k not in ("r", "g", "b")]).where(I.is_useful_crop()).drop(*_SUMS))
    # kept, without pixels, as both the items and the counts are made of them
    all_read = phase("recognition", saved(read(good, reads)))
    items = phase("result_filter", all_read.where(I.is_kept(F.col("text"), F.col("confidence"))).drop("normal_count", "rotated_count", "cw", "ch"))
    return items, all_read.groupBy("image").agg(F.sum("normal_count").alias("normal_count"), F.sum("rotated_count").alias("rotated_count"))


def codes(items: DataFrame, labels: DataFrame) -> DataFrame:
    """Items as product codes: cleaned, validated and matched to ``labels`` (as ``match.indexed`` gives them), under their image and index."""
    return match.resolved(items.withColumnRenamed("text", "raw"), labels)


def outlined(maps: DataFrame, frames: DataFrame, pictures: DataFrame, n: int = MAX_REGIONS) -> DataFrame:
    """Regions alone, to be followed on screen: image, index, box and p, with an empty text of confidence 0."""
    found = chosen(regions.merge_polygons(polygons(maps, frames), pictures), n)
    return found.select(*_ID, *(v.cast("int").alias(k) for k, v in G.int_bbox(F.col("p")).items()), "p", F.lit("").alias("text"), F.lit(0.0).cast("float").alias("confidence"))


def blur_scores(pictures: DataFrame, *key: str) -> DataFrame:
    """(key, score, blurred): the variance of the Laplacian of each picture (w, h, r, g, b), brought to a width of 320 without mixing pixels.

    A picture is a row and is scored where it is; no shuffle.
    """
    c = F.col
    nh = (c("h") * (F.lit(float(BLUR_WIDTH)).cast("float") / c("w"))).cast("int")
    scored = _measured(pictures, list(key), [c("w"), c("h"), nh], R.blur_score, [StructField("score", DoubleType())])
    return scored.withColumn("blurred", N.is_blurred(c("score")))
