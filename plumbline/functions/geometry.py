"""Polygons as arrays x0, y0, x1, y1, ... and rectangles as columns, in Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import MERGE_CENTER, MERGE_GAP_HEIGHT, MERGE_GAP_IMAGE, MERGE_HEIGHT_RATIO, MERGE_OVERLAP, MERGE_PADDING, MERGE_UNION_HEIGHT, MERGE_WIDTH_OVERLAP, UNCLIP


def xs(p: Column) -> Column:
    return F.filter(p, lambda v, i: i % 2 == 0)


def ys(p: Column) -> Column:
    return F.filter(p, lambda v, i: i % 2 == 1)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def area(p: Column) -> Column:
    """Shoelace area, each corner with the next."""
    x, y, n = xs(p), ys(p), F.size(p) / 2
    return F.abs(_sum(F.transform(x, lambda v, i: v * F.get(y, ((i + 1) % n).cast("int")) - F.get(x, ((i + 1) % n).cast("int")) * F.get(y, i)))) / 2


def bbox(p: Column) -> dict[str, Column]:
    """The box around a polygon."""
    return {"left": F.array_min(xs(p)), "top": F.array_min(ys(p)), "right": F.array_max(xs(p)), "bottom": F.array_max(ys(p))}


def int_bbox(p: Column) -> dict[str, Column]:
    b = bbox(p)
    return {k: (F.floor(v) if k in ("left", "top") else F.ceil(v)) for k, v in b.items()}


def expanded(p: Column, factor: float, w, h, factor_y: float | None = None) -> Column:
    """Scaled about the mean of the corners, in y by ``factor_y`` if given, and held inside the image."""
    w, h = (v.cast("double") if isinstance(v, Column) else F.lit(v) for v in (w, h))
    in_y = factor if factor_y is None else factor_y
    cx, cy = _sum(xs(p)) / (F.size(p) / 2), _sum(ys(p)) / (F.size(p) / 2)

    def one(v: Column, i: Column) -> Column:
        c, top, by = F.when(i % 2 == 0, cx).otherwise(cy), F.when(i % 2 == 0, w).otherwise(h), F.when(i % 2 == 0, F.lit(factor)).otherwise(in_y)
        return F.greatest(F.lit(0.0), F.least(top, c + (v - c) * by))

    return F.transform(p, one)


def inverse_letterbox(p: Column, scale: Column, pad_x: Column, pad_y: Column, w: Column, h: Column) -> Column:
    """From the padded square back to the image, held inside it."""

    def one(v: Column, i: Column) -> Column:
        pad, top = F.when(i % 2 == 0, pad_x).otherwise(pad_y), F.when(i % 2 == 0, w).otherwise(h)
        return F.greatest(F.lit(0.0), F.least(top.cast("double"), (v - pad) / scale))

    return F.transform(p, one)


def _angle() -> Column:
    """The direction of the larger principal axis, over cxx, cyy and cxy."""
    half = (F.col("cxx") + F.col("cyy")) / 2
    disc = F.sqrt(F.greatest(F.lit(0.0), half * half - (F.col("cxx") * F.col("cyy") - F.col("cxy") * F.col("cxy"))))
    return F.when(F.abs("cxy") > 1e-10, F.atan2(F.col("cxy"), half + disc - F.col("cyy"))).when(F.col("cxx") >= F.col("cyy"), 0.0).otherwise(F.pi() / 2)


def pca_rect(points: DataFrame, *key: str) -> DataFrame:
    """Principal-axis rectangle of each key's points (x, y): key, n, cx, cy, w, h, angle. Fewer than three points give none.

    Two aggregations: moments, then extents along the axes; nothing is gathered.
    """
    m = points.groupBy(*key).agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.var_pop("x").alias("cxx"), F.var_pop("y").alias("cyy"), F.covar_pop("x", "y").alias("cxy")).where("n >= 3")
    m = m.withColumn("angle", _angle())
    dx, dy, a = F.col("x") - F.col("cx"), F.col("y") - F.col("cy"), F.col("angle")
    along, across = dx * F.cos(a) + dy * F.sin(a), dy * F.cos(a) - dx * F.sin(a)
    at = points.join(m, list(key)).withColumns({"_u": along, "_v": across})
    extent = lambda c: F.greatest(F.lit(1.0), F.max(c) - F.min(c))
    return at.groupBy(*key, "n", "cx", "cy", "angle").agg(extent("_u").alias("w"), extent("_v").alias("h"))


def unclipped(cx: Column, cy: Column, w: Column, h: Column, angle: Column, ratio: float = UNCLIP) -> Column:
    """The rectangle grown to ``ratio`` times its area, as four corners."""
    k = ratio**0.5
    hw, hh, c, s = w / 2 * k, h / 2 * k, F.cos(angle), F.sin(angle)
    corners = ((-hw, -hh), (hw, -hh), (hw, hh), (-hw, hh))
    return F.array(*(v for u, t in corners for v in (cx + u * c - t * s, cy + u * s + t * c)))


def corner_order(p: Column) -> Column:
    """A quad's corners as top-left, top-right, bottom-right, bottom-left: the two highest by x, then the two lowest by falling x; ties as they stand."""
    points = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct(F.get(p, i * 2 + 1).alias("y"), i.alias("i"), F.get(p, i * 2).alias("x")))
    by_y = F.array_sort(points)
    # within a half, order by x and then by the place in the order by y
    half = lambda at: F.array_sort(F.transform(F.slice(by_y, at, 2), lambda q, k: F.struct(q.x.alias("x"), k.alias("k"), q.y.alias("y"))))
    top, low = half(1), half(3)
    corners = (F.get(top, F.lit(0)), F.get(top, F.lit(1)), F.get(low, F.lit(1)), F.get(low, F.lit(0)))
    return F.array(*(c[k] for c in corners for k in ("x", "y")))


def crop_size(p: Column) -> tuple[Column, Column]:
    """Width and height of the upright crop of an ordered quad: means of opposite sides, cut to whole numbers between 1 and 2000."""
    side = lambda a, b: F.sqrt(F.pow(F.get(p, F.lit(2 * a)) - F.get(p, F.lit(2 * b)), F.lit(2)) + F.pow(F.get(p, F.lit(2 * a + 1)) - F.get(p, F.lit(2 * b + 1)), F.lit(2)))
    whole = lambda v: F.greatest(F.lit(1), F.least(F.lit(2000), v.cast("int")))
    return whole((side(0, 1) + side(3, 2)) / 2), whole((side(0, 3) + side(1, 2)) / 2)


def on_view(p: Column, image_w: Column, image_h: Column, view_w: Column, view_h: Column, shrink: float = 0.7) -> Column:
    """A polygon as drawn over a view that the image fills, centred: shrunk about the mean of its corners, scaled and shifted."""
    scale = F.greatest(view_w / image_w, view_h / image_h)
    dx, dy = (view_w - image_w * scale) / 2, (view_h - image_h * scale) / 2
    cx, cy = _sum(xs(p)) / (F.size(p) / 2), _sum(ys(p)) / (F.size(p) / 2)

    def one(v: Column, i: Column) -> Column:
        c, d = F.when(i % 2 == 0, cx).otherwise(cy), F.when(i % 2 == 0, dx).otherwise(dy)
        return (c + (v - c) * shrink) * scale + d

    return F.transform(p, one)


def box_of(prefix: str) -> dict[str, Column]:
    """The box in the columns left, top, right and bottom behind a prefix."""
    return {k: F.col(prefix + k) for k in ("left", "top", "right", "bottom")}


def same_line(a: dict[str, Column], b: dict[str, Column], image_w: Column, colors_fit: Column) -> Column:
    """Whether the boxes a and b belong to one line of text."""
    g = lambda p, n: p[n]
    h = lambda p: F.greatest(g(p, "bottom") - g(p, "top"), F.lit(1.0))
    w = lambda p: F.greatest(g(p, "right") - g(p, "left"), F.lit(1.0))
    high, low = F.greatest(h(a), h(b)), F.least(h(a), h(b))
    over_y = F.greatest(F.least(g(a, "bottom"), g(b, "bottom")) - F.greatest(g(a, "top"), g(b, "top")), F.lit(0.0))
    over_x = F.greatest(F.least(g(a, "right"), g(b, "right")) - F.greatest(g(a, "left"), g(b, "left")), F.lit(0.0))
    gap = F.greatest(F.greatest(g(a, "left"), g(b, "left")) - F.least(g(a, "right"), g(b, "right")), F.lit(0.0))
    apart = F.abs((g(a, "top") + g(a, "bottom")) / 2 - (g(b, "top") + g(b, "bottom")) / 2)
    union = F.greatest(g(a, "bottom"), g(b, "bottom")) - F.least(g(a, "top"), g(b, "top"))
    return (
        (high / low <= MERGE_HEIGHT_RATIO)
        & (over_y / low >= MERGE_OVERLAP)
        & (apart <= high * MERGE_CENTER)
        & (over_x <= F.least(w(a), w(b)) * MERGE_WIDTH_OVERLAP)
        & (gap <= F.least(high * MERGE_GAP_HEIGHT, image_w * MERGE_GAP_IMAGE))
        & (union <= high * MERGE_UNION_HEIGHT)
        & colors_fit
    )


def line_box(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    """One box for two on a line: as wide as both, no higher than the higher one, its middle their middles' mean by width."""
    wide = lambda p: F.greatest(p["right"] - p["left"], F.lit(1.0))
    middle = lambda p: (p["top"] + p["bottom"]) / 2
    ha, hb = (p["bottom"] - p["top"] for p in (a, b))
    at = (middle(a) * wide(a) + middle(b) * wide(b)) / (wide(a) + wide(b))
    half = F.greatest(ha, hb, (ha + hb) / 2 * MERGE_PADDING) / 2
    return {"left": F.least(a["left"], b["left"]), "top": at - half, "right": F.greatest(a["right"], b["right"]), "bottom": at + half}


def as_polygon(b: dict[str, Column]) -> Column:
    return F.array(b["left"], b["top"], b["right"], b["top"], b["right"], b["bottom"], b["left"], b["bottom"])
