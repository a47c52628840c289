"""Queries on the detection chain and on pictures of real sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import COLORS
from ..functions import geometry as G
from ..functions import image as I
from ..functions import numeric as N
from ..functions import raster as R
from ..operators import detect as D
from ..operators import regions
from ..sources import standins as T
from .registry import query
from .vision import _A, _B, _FITS, _HALF, _MIDDLE


def _frames(pictures):
    """How a picture was fitted into the detector's map of 64 by 64."""
    box = N.letterbox(F.col("w"), F.col("h"), 64)
    return pictures.select("image", "w", "h", *(box[k].alias(k) for k in ("scale", "pad_x", "pad_y")))


def _with_classes(pictures):
    pixel = F.arrays_zip("r", "g", "b")
    named = lambda p: R.bound(F.struct(*(v.alias(k) for k, v in zip("hsv", I.hsv(p["r"], p["g"], p["b"]), strict=True))), lambda c: I.color_class(c["h"], c["s"], c["v"]))
    return pictures.withColumn("classes", F.transform(pixel, named))


_COMPONENTS = f"""{T.with_('heat').replace('WITH ', 'WITH RECURSIVE ', 1)}, px AS (SELECT image, x, y FROM heat WHERE v > 0.18::DOUBLE),
    st AS (SELECT *, x - row_number() OVER (PARTITION BY image, y ORDER BY x) AS grp FROM px), runs AS (SELECT image, y, min(x) AS x0, max(x) AS x1, min(y * 64 + x) AS id FROM st GROUP BY image, y, grp),
    reach(image, id, other) AS (SELECT image, id, id FROM runs UNION SELECT r.image, r.id, b.id FROM reach r JOIN runs a ON a.image = r.image AND a.id = r.other JOIN runs b ON b.image = a.image AND abs(b.y - a.y) = 1 AND b.x0 <= a.x1 AND a.x0 <= b.x1),
    c AS (SELECT image, id, min(other) AS first FROM reach GROUP BY ALL)"""


@query(
    f"""{_COMPONENTS},
    s AS (SELECT image, first, sum(x1 - x0 + 1)::BIGINT AS pixels, min(x0)::BIGINT AS "left", min(y)::BIGINT AS top, max(x1)::BIGINT AS "right", max(y)::BIGINT AS bottom, sum((x1 - x0 + 1) * (64 * y) + (x0 + x1) * (x1 - x0 + 1) // 2)::BIGINT AS places FROM c JOIN runs USING (image, id) GROUP BY ALL HAVING sum(x1 - x0 + 1) >= 15)
    SELECT image, row_number() OVER (PARTITION BY image ORDER BY first) - 1 AS component, pixels, "left", top, "right", bottom, places FROM s"""
)
def text_regions(spark, d):
    """Components of heat maps of 64 by 64 at the detector's own limits, with their sizes, boxes and the sum of their places."""
    n = F.col("x1") - F.col("x0") + 1
    places = n * 64 * F.col("y") + F.expr("(x0 + x1) * (x1 - x0 + 1) div 2")
    return regions.component_runs(T.heat_maps(spark, d)).groupBy("image", "component").agg(
        F.sum(n).alias("pixels"), F.min("x0").alias("left"), F.min("y").alias("top"), F.max("x1").alias("right"), F.max("y").alias("bottom"), F.sum(places).alias("places")
    )


@query()
def detection_chain(spark, d):
    """What is read in each picture, by index; tested against a model in plain Python."""
    p = T.pictures(spark, d)
    items, counts = D.run(T.heat_maps(spark, d), _frames(p), p, T.readings(spark, d))
    shown = items.select("image", "index", "left", "top", "right", "bottom", "turned", "side", "text", F.round(F.col("confidence").cast("double"), 5).alias("confidence"))
    return shown.join(counts, "image")


_SIZES = ((64, 30), (80, 12))
_CHANNEL = lambda c, w, h: f"list_transform(range({w * h}), lambda k: round(least(255, greatest(0, (e[((k // {w}) * 8 // {h} * 8 + (k % {w}) * 8 // {w} + {7 * c}) % 64 + 1] * 3 + 0.5::DOUBLE) * 255))))"
_PICTURES = lambda sizes: " UNION ALL ".join(f"SELECT vec_id AS image, {w} AS w, {h} AS h, {', '.join(f'{_CHANNEL(c, w, h)} AS {k}' for c, k in enumerate('rgb'))} FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)" for w, h in sizes)


_XY = lambda i: f"greatest(0, least(CASE WHEN {i} % 2 = 1 THEN 96 ELSE 72 END, (v - CASE WHEN {i} % 2 = 1 THEN 0 ELSE 8 END) / (64 / 96::DOUBLE)))"
_AREA = "abs((p[1] * p[4] - p[3] * p[2]) + (p[3] * p[6] - p[5] * p[4]) + (p[5] * p[8] - p[7] * p[6]) + (p[7] * p[2] - p[1] * p[8])) / 2"
_SEEN = lambda b: (
    f"flatten(list_transform(range(greatest(0, least(71, floor({b}.t)))::INT, greatest(greatest(0, least(71, floor({b}.t))) + 1, least(72, ceil({b}.b)))::INT), lambda y: list_transform(range(greatest(0, least(95, floor({b}.l)))::INT, greatest(greatest(0, least(95, floor({b}.l))) + 1, least(96, ceil({b}.r)))::INT), lambda x: cls[y * 96 + x + 1])))"
)
_NAMES = ", ".join(f"'{c}'" for c in COLORS[:-1])
#: The colour of a list of names ``seen``.
_BEST = lambda seen: f"(SELECT CASE WHEN list_max(n) > 0 AND list_sum(n) / len({seen}) >= 0.01::DOUBLE THEN [{_NAMES}][list_position(n, list_max(n))] ELSE 'UNKNOWN' END FROM (SELECT list_transform([{_NAMES}], lambda c: len(list_filter({seen}, lambda v: v = c))) AS n))"
_HUE = "CASE WHEN s.hi = s.lo THEN 0 WHEN s.hi = s.r THEN (s.g - s.b) / (s.hi - s.lo) + CASE WHEN s.g < s.b THEN 6 ELSE 0 END WHEN s.hi = s.g THEN (s.b - s.r) / (s.hi - s.lo) + 2 ELSE (s.r - s.g) / (s.hi - s.lo) + 4 END * 60::DOUBLE"
_NAMED = """CASE WHEN s.v < 0.25::DOUBLE THEN 'UNKNOWN' WHEN s.s < 0.16::DOUBLE AND s.v > 0.72::DOUBLE THEN 'WHITE' WHEN s.v < 0.28::DOUBLE THEN 'BLACK' WHEN s.s < 0.18::DOUBLE THEN 'UNKNOWN' WHEN s.h BETWEEN 0 AND 22 OR s.h >= 338 THEN 'RED'
    WHEN s.h BETWEEN 35 AND 78 THEN 'YELLOW' WHEN s.h BETWEEN 80 AND 155 THEN 'GREEN' WHEN s.h BETWEEN 156 AND 210 THEN 'CYAN' WHEN s.h BETWEEN 211 AND 260 THEN 'BLUE' ELSE 'UNKNOWN' END"""
_LINES = f"""{_COMPONENTS},
    big AS (SELECT image, first FROM c JOIN runs USING (image, id) GROUP BY ALL HAVING sum(x1 - x0 + 1) >= 15),
    pt AS (SELECT image, first, unnest(range(x0, x1 + 1))::DOUBLE AS x, y::DOUBLE AS y FROM c JOIN big USING (image, first) JOIN runs USING (image, id)),
    mo AS (SELECT image, first, avg(x) AS cx, avg(y) AS cy, var_pop(x) AS cxx, var_pop(y) AS cyy, covar_pop(x, y) AS cxy FROM pt GROUP BY ALL),
    an AS (SELECT *, CASE WHEN abs(cxy) > 1e-10 THEN atan2(cxy, (cxx + cyy) / 2 + sqrt(greatest(0, (cxx + cyy) * (cxx + cyy) / 4 - (cxx * cyy - cxy * cxy))) - cyy) WHEN cxx >= cyy THEN 0 ELSE pi() / 2 END AS angle FROM mo),
    uv AS (SELECT image, first, cx, cy, angle, (x - cx) * cos(angle) + (y - cy) * sin(angle) AS u, (y - cy) * cos(angle) - (x - cx) * sin(angle) AS v FROM pt JOIN an USING (image, first)),
    rect AS (SELECT image, first, cx, cy, cos(angle) AS co, sin(angle) AS si, greatest(1, max(u) - min(u)) / 2 * sqrt(1.5::DOUBLE) AS hw, greatest(1, max(v) - min(v)) / 2 * sqrt(1.5::DOUBLE) AS hh FROM uv GROUP BY image, first, cx, cy, angle),
    raw AS (SELECT image, first, [cx - hw * co + hh * si, cy - hw * si - hh * co, cx + hw * co + hh * si, cy + hw * si - hh * co, cx + hw * co - hh * si, cy + hw * si + hh * co, cx - hw * co - hh * si, cy - hw * si + hh * co] AS p FROM rect),
    back AS (SELECT image, first, list_transform(p, lambda v, i: {_XY('i')}) AS p FROM raw),
    poly AS (SELECT *, count(*) OVER (PARTITION BY image) AS many, {{'l': least(p[1], p[3], p[5], p[7]), 't': least(p[2], p[4], p[6], p[8]), 'r': greatest(p[1], p[3], p[5], p[7]), 'b': greatest(p[2], p[4], p[6], p[8])}} AS bx FROM back WHERE {_AREA} > 120),
    pic AS (SELECT image, list_transform(list_transform(list_transform(range(6912), lambda k: {{'r': r[k + 1], 'g': g[k + 1], 'b': b[k + 1], 'hi': greatest(r[k + 1], g[k + 1], b[k + 1]), 'lo': least(r[k + 1], g[k + 1], b[k + 1])}}),
      lambda s: {{'h': ({_HUE.replace(" END * 60::DOUBLE", " END) * 60::DOUBLE")}, 's': CASE WHEN s.hi = 0 THEN 0 ELSE (s.hi - s.lo) / s.hi END, 'v': s.hi / 255}}), lambda s: {_NAMED}) AS cls FROM ({_PICTURES(((96, 72),))})),
    st0 AS (SELECT image, first, bx, {_SEEN('bx')} AS seen FROM poly JOIN pic USING (image) WHERE many > 1), st1 AS (SELECT image, list({{'l': bx.l, 't': bx.t, 'r': bx.r, 'b': bx.b, 'c': {_BEST('seen')}}} ORDER BY first) AS x FROM st0 GROUP BY image),
    mm(image, x, step) AS (SELECT image, x, 0 FROM st1 UNION ALL
      SELECT image, list_transform(list_filter(range(1, n + 1), lambda k: k <> q % n + 1), lambda k: CASE WHEN k = q // n + 1 THEN {{'l': z.l, 't': z.t, 'r': z.r, 'b': z.b, 'c': col}} ELSE x[k] END), step + 1
      FROM (SELECT *, {_BEST('seen')} AS col FROM (SELECT d.*, {_SEEN('z')} AS seen FROM (SELECT *, {{'l': least(a.l, b.l), 't': {_MIDDLE} - {_HALF}, 'r': greatest(a.r, b.r), 'b': {_MIDDLE} + {_HALF}}} AS z
      FROM (SELECT *, {_A} AS a, {_B} AS b FROM (SELECT image, x, step, n, list_filter(range(n * n), lambda q: {_FITS.replace('1600', '96')} AND ({_A}.c = 'UNKNOWN' OR {_B}.c = 'UNKNOWN' OR {_A}.c = {_B}.c))[1] AS q FROM (SELECT *, len(x) AS n FROM mm))) WHERE q IS NOT NULL) d JOIN pic USING (image)))),
    done AS (SELECT image, arg_max(x, step) AS x FROM mm GROUP BY 1), li AS (SELECT image, unnest(range(len(x))) AS line, unnest(x) AS v FROM done),
    al AS (SELECT image, 0 AS line, p FROM poly WHERE many = 1 UNION ALL SELECT image, line, [v.l, v.t, v.r, v.t, v.r, v.b, v.l, v.b] FROM li),
    ra AS (SELECT image, row_number() OVER (PARTITION BY image ORDER BY {_AREA} DESC, line)::INT AS index, p FROM al)"""


@query(
    f"""{_LINES} SELECT image, index, floor(least(p[1], p[3], p[5], p[7]))::INT AS "left", floor(least(p[2], p[4], p[6], p[8]))::INT AS top, ceil(greatest(p[1], p[3], p[5], p[7]))::INT AS "right", ceil(greatest(p[2], p[4], p[6], p[8]))::INT AS bottom,
    round(p[1], 4) AS x0, round(p[2], 4) AS y0, round(p[5], 4) AS x2, round(p[6], 4) AS y2, round({_AREA}, 3) AS area FROM ra WHERE index <= 24"""
)
def detected_lines(spark, d):
    """Regions merged by line and colour, the largest first: box, two corners and area."""
    p = T.pictures(spark, d)
    found = D.outlined(T.heat_maps(spark, d), _frames(p), p)
    at = lambda i: F.round(F.get("p", F.lit(i)), 4)
    return found.select("image", "index", "left", "top", "right", "bottom", at(0).alias("x0"), at(1).alias("y0"), at(4).alias("x2"), at(5).alias("y2"), F.round(G.area(F.col("p")), 3).alias("area"))


def _all(spark, d, sizes):
    out = T.pictures(spark, d, *sizes[0])
    for s in sizes[1:]:
        out = out.unionByName(T.pictures(spark, d, *s))
    return out


_NEAR = lambda dx, dy: f"g[((k // 320 + {dy} + 0.5::DOUBLE) * h / nh)::DOUBLE.floor()::BIGINT * w + ((k % 320 + {dx} + 0.5::DOUBLE) * w / 320).floor()::BIGINT + 1]"


@query(
    f"""WITH p AS ({_PICTURES(_SIZES)}), y AS (SELECT image, w, h, trunc(h * (320::FLOAT / w::FLOAT))::INT AS nh, list_transform(range(w * h), lambda i: r[i + 1] * 0.299::DOUBLE + g[i + 1] * 0.587::DOUBLE + b[i + 1] * 0.114::DOUBLE) AS g FROM p),
    l AS (SELECT image, w, h, list_transform(range(320 * nh), lambda k: CASE WHEN k % 320 IN (0, 319) OR k // 320 IN (0, nh - 1) THEN 0.0::DOUBLE ELSE {_NEAR(0, -1)} + {_NEAR(-1, 0)} - 4 * {_NEAR(0, 0)} + {_NEAR(1, 0)} + {_NEAR(0, 1)} END) AS l FROM y)
    SELECT image, w, h, round(list_aggregate(l, 'var_pop'), 3) AS score, list_aggregate(l, 'var_pop') < 100 AS blurred FROM l""".replace("::DOUBLE.floor()", ".floor()")
)
def picture_blur(spark, d):
    """Blur of pictures of two sizes, at a width of 320."""
    s = D.blur_scores(_all(spark, d, _SIZES), "image", "w", "h")
    return s.select("image", "w", "h", F.round("score", 3).alias("score"), "blurred")


_CROPS = ((132, 48), (40, 20), (7, 30))
_MIX = lambda g: f"floor(({g}[s.y * cw + s.x + 1] * (1 - s.fx) + {g}[s.y * cw + s.x2 + 1] * s.fx) * (1 - s.fy) + ({g}[s.y2 * cw + s.x + 1] * (1 - s.fx) + {g}[s.y2 * cw + s.x2 + 1] * s.fx) * s.fy + 0.5::DOUBLE)"


@query(
    f"""WITH p AS (SELECT image, w AS cw, h AS ch, r, g, b FROM ({_PICTURES(_CROPS)})),
    n AS (SELECT *, CASE WHEN greatest(cw, ch) > 128 THEN greatest(1, trunc(cw * (128::DOUBLE / greatest(cw, ch))))::INT ELSE cw END AS nw, CASE WHEN greatest(cw, ch) > 128 THEN greatest(1, trunc(ch * (128::DOUBLE / greatest(cw, ch))))::INT ELSE ch END AS nh FROM p),
    loc AS (SELECT *, list_transform(range(nw * nh), lambda k: {{'u': greatest(0, least(cw - 1, (k % nw + 0.5::DOUBLE) * cw / nw - 0.5::DOUBLE)), 'v': greatest(0, least(ch - 1, (k // nw + 0.5::DOUBLE) * ch / nh - 0.5::DOUBLE))}}) AS uv FROM n WHERE cw >= 8 AND ch >= 8),
    sp AS (SELECT * EXCLUDE (uv), list_transform(uv, lambda q: {{'x': floor(q.u)::INT, 'y': floor(q.v)::INT, 'x2': least(floor(q.u)::INT + 1, cw - 1), 'y2': least(floor(q.v)::INT + 1, ch - 1), 'fx': q.u - floor(q.u), 'fy': q.v - floor(q.v)}}) AS sp FROM loc),
    px AS (SELECT image, cw, ch, list_transform(sp, lambda s: {{'r': {_MIX('r')}, 'g': {_MIX('g')}, 'b': {_MIX('b')}}}) AS px FROM sp),
    q AS (SELECT image, cw, ch, list_transform(px, lambda s: {{'lum': s.r * 0.299::DOUBLE + s.g * 0.587::DOUBLE + s.b * 0.114::DOUBLE, 'colored': greatest(s.r, s.g, s.b) > 0 AND (greatest(s.r, s.g, s.b) - least(s.r, s.g, s.b)) / greatest(s.r, s.g, s.b) > 0.18::DOUBLE AND greatest(s.r, s.g, s.b) / 255 > 0.16::DOUBLE}}) AS px FROM px),
    a AS (SELECT image, cw, ch, len(px) AS n, len(list_filter(px, lambda s: s.lum > 175)) AS bright, len(list_filter(px, lambda s: s.lum < 80)) AS dark, len(list_filter(px, lambda s: s.colored)) AS colored, len(list_filter(px, lambda s: s.lum < 110)) AS edge,
      list_max(list_transform(px, lambda s: s.lum)) - list_min(list_transform(px, lambda s: s.lum)) AS contrast FROM q)
    SELECT p.image, p.cw, p.ch, bright, dark, colored, edge, round(contrast, 6) AS contrast, coalesce(NOT ((bright / n > 0.96::DOUBLE AND dark / n < 0.002::DOUBLE AND colored / n < 0.002::DOUBLE AND contrast < 35) OR (colored / n < 0.002::DOUBLE AND edge / n < 0.003::DOUBLE AND contrast < 45) OR (colored < 2 AND edge < 3 AND contrast < 35)), false) AS useful
    FROM p LEFT JOIN a USING (image, cw, ch)"""
)
def crop_sizes_useful(spark, d):
    """The crop rule on crops that are brought down, kept as they are, and too narrow; with its counts."""
    crops = _all(spark, d, _CROPS).withColumnsRenamed({"w": "cw", "h": "ch"})
    key = ("image", "cw", "ch")
    return crops.select(*key).join(D.crop_sums(crops, *key), list(key), "left").select(
        *key, "bright", "dark", "colored", "edge", F.round("contrast", 6).alias("contrast"), F.coalesce(I.is_useful_crop(), F.lit(False)).alias("useful")
    )


@query()
def upright_crops(spark, d):
    """Sizes and mean colours of the upright crops of each picture's regions; tested against a model in plain Python."""
    p = T.pictures(spark, d)
    found = D.chosen(regions.merge_polygons(D.polygons(T.heat_maps(spark, d), _frames(p)), p))
    mean = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, v: a + v) / F.size(c), 4)
    return D.cropped(found, p).select("image", "index", "cw", "ch", *(mean(k).alias(k) for k in ("r", "g", "b")))
