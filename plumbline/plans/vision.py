"""Queries on recognition output, images and geometry, over embeddings as stand-in grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import image as I
from ..functions import numeric as N
from ..operators import regions as R
from ..operators.masters import with_ordinal
from ..sources import standins as T
from .registry import query

_SYMBOLS = ["blank", "A", "B", "C", "D", "E"]
_E = "e AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"


def _e(spark, d):
    return T.read(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))


# ---- decoding: eight time steps of eight classes ----
_STEPS = f"WITH {_E}, s AS (SELECT vec_id, list_transform(range(8), lambda t: e[t * 8 + 1 : t * 8 + 8]) AS m FROM e), c AS (SELECT vec_id, m, list_transform(m, lambda x: list_position(x, list_max(x)) - 1) AS c FROM s), o AS (SELECT vec_id, m, c, list_filter(range(1, 9), lambda t: c[t] > 0 AND (t = 1 OR c[t] <> c[t - 1])) AS o FROM c)"


def _classes(spark, d):
    m = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda t: F.slice("e", t * 8 + 1, 8))
    return _e(spark, d).select("vec_id", m.alias("m")).withColumn("c", F.transform("m", R.argmax))


@query(f"{_STEPS} SELECT vec_id, array_to_string(list_transform(list_filter(o, lambda t: c[t] < 6), lambda t: ['blank', 'A', 'B', 'C', 'D', 'E'][c[t] + 1]), '') AS text FROM o")
def ctc_greedy_decode(spark, d):
    return _classes(spark, d).select("vec_id", R.decoded(F.col("c"), F.array(*(F.lit(s) for s in _SYMBOLS))).alias("text"))


@query(f"{_STEPS}, p AS (SELECT vec_id, list_transform(o, lambda t: list_max(m[t])) AS p FROM o) SELECT vec_id, round(coalesce(list_avg(p), 0), 6) AS avg, coalesce(list_max(p), 0) AS max, coalesce(list_min(p), 0) AS min FROM p")
def ctc_confidence_stats(spark, d):
    p = _classes(spark, d).select("vec_id", F.transform(R.emitted(F.col("c")), lambda t: F.array_max(F.get("m", t))).alias("p"))
    mean = F.aggregate("p", F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size("p"), F.lit(0))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return p.select("vec_id", F.round(zero(mean), 6).alias("avg"), zero(F.array_max("p")).alias("max"), zero(F.array_min("p")).alias("min"))


# ---- recognised text with confidences of both ways up ----
_TRIM = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
_USEFUL = f"length(regexp_replace({_TRIM}, '[^\\p{{L}}\\p{{Nd}}\\-/]', '', 'g'))"
_SEEN = f"""{T.with_('recognised_texts')}, x AS (SELECT text_id, CASE text_id % 8 WHEN 0 THEN 'EMPTY' WHEN 1 THEN '@#%!' WHEN 2 THEN left(text, 2) ELSE text END AS text, abs(embedding[1]) * 2::FLOAT AS conf, abs(embedding[2]) * 2::FLOAT AS conf_r
  FROM recognised_texts JOIN (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS slot, count(*) OVER () AS many FROM embeddings) ON slot = text_id % many),
y AS (SELECT *, {_USEFUL} AS useful, CASE WHEN length({_TRIM}) = 0 THEN 0 ELSE {_USEFUL} / length({_TRIM}) END::FLOAT AS ratio, upper({_TRIM}) IN ('EMPTY', 'FORMATERR', 'ERROR') AS bad, length({_TRIM}) AS n FROM x)"""
_SCORE = lambda c: f"CASE WHEN n = 0 THEN 0::FLOAT ELSE {c} * 0.80::FLOAT + ratio * 0.15::FLOAT + least(n, 24)::FLOAT * 0.002::FLOAT END"


def _seen(spark, d):
    vectors = with_ordinal(T.read(spark, d, "embeddings"), ["vec_id"], "at", 0)
    many = vectors.agg(F.count("*").alias("many"))
    t = T.recognised_texts(spark, d).join(F.broadcast(many)).withColumn("at", F.col("text_id") % F.col("many"))
    k = F.col("text_id") % 8
    text = F.when(k == 0, "EMPTY").when(k == 1, "@#%!").when(k == 2, F.substring("text", 1, 2)).otherwise(F.col("text"))
    conf = lambda i: F.abs(F.get("embedding", F.lit(i))) * I.f32(2.0)
    return t.join(vectors, "at").select("text_id", text.alias("text"), conf(0).alias("conf"), conf(1).alias("conf_r"))


@query(f"{_SEEN} SELECT text_id, NOT bad AND useful > 0 AND ratio >= 0.45::FLOAT AND NOT (useful <= 2 AND conf < 0.60::FLOAT) AND n > 0 AS kept FROM y")
def ocr_result_filter(spark, d):
    return _seen(spark, d).select("text_id", I.is_kept(F.col("text"), F.col("conf")).alias("kept"))


@query(f"{_SEEN} SELECT text_id, round(({_SCORE('conf')})::DOUBLE, 5) AS score FROM y")
def recognition_score(spark, d):
    return _seen(spark, d).select("text_id", F.round(I.recognition_score(F.col("text"), F.col("conf")).cast("double"), 5).alias("score"))


@query(f"{_SEEN} SELECT text_id, CASE WHEN conf >= 0.62::FLOAT AND ratio >= 0.75::FLOAT AND useful >= 4 AND NOT bad THEN 'normal' WHEN {_SCORE('conf_r')} > {_SCORE('conf')} THEN 'rotated' ELSE 'normal' END AS side FROM y")
def orientation_choice(spark, d):
    t = F.col("text")
    better = I.recognition_score(t, F.col("conf_r")) > I.recognition_score(t, F.col("conf"))
    return _seen(spark, d).select("text_id", F.when(I.is_confident(t, F.col("conf")), "normal").when(better, "rotated").otherwise("normal").alias("side"))


# ---- pixels ----
@query(
    f"WITH {_E}, r AS (SELECT vec_id, (list_min(e) + 0.6) * (vec_id % 7) * 30 AS lo, (list_max(e) + 0.6) * (vec_id % 7) * 30 AS hi FROM e), s AS (SELECT *, CASE WHEN hi - lo < 12 THEN 1.0 ELSE least(220 / (hi - lo), 2.2) END AS scale FROM r) SELECT vec_id, round(scale, 6) AS scale, round(CASE WHEN hi - lo < 12 THEN 0.0 ELSE -lo * scale + 8 END, 6) AS bias FROM s"
)
def contrast_params(spark, d):
    lum = lambda c: (c + 0.6) * (F.col("vec_id") % 7) * 30
    scale, bias = I.contrast(lum(F.array_min("e")), lum(F.array_max("e")))
    return _e(spark, d).select("vec_id", F.round(scale, 6).alias("scale"), F.round(bias, 6).alias("bias"))


@query(f"WITH {_E}, l AS (SELECT vec_id, unnest(list_transform(range(1, 65), lambda i: CASE WHEN (i - 1) // 8 IN (0, 7) OR (i - 1) % 8 IN (0, 7) THEN 0 ELSE 255 * (e[i - 1] + e[i + 1] + e[i - 8] + e[i + 8] - 4 * e[i]) END)) AS v FROM e) SELECT vec_id, round(var_pop(v), 3) AS score, var_pop(v) < 100 AS blurred FROM l GROUP BY 1")
def blur_score(spark, d):
    v = _e(spark, d).select("vec_id", F.explode(I.laplacian(F.col("e"), 8, 8)).alias("v"))
    s = v.groupBy("vec_id").agg(F.var_pop("v").alias("s"))
    return s.select("vec_id", F.round("s", 3).alias("score"), N.is_blurred(F.col("s")).alias("blurred"))


_PIXELS = f"{_E}, px AS (SELECT vec_id, k, round(least(255, greatest(0, (e[3 * k + 1] + 0.6) * 230))) AS r, round(least(255, greatest(0, (e[3 * k + 2] + 0.6) * 230))) AS g, round(least(255, greatest(0, (e[3 * k + 3] + 0.6) * 230))) AS b FROM e, range(21) t(k))"


def _pixels(spark, d):
    v = lambda j: F.round(F.least(F.lit(255.0), F.greatest(F.lit(0.0), (F.get("e", F.col("k") * 3 + j) + 0.6) * 230)))
    return _e(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(20)))).select("vec_id", "k", v(0).alias("r"), v(1).alias("g"), v(2).alias("b"))


@query(
    f"""WITH {_PIXELS}, q AS (SELECT vec_id, r * 0.299::DOUBLE + g * 0.587::DOUBLE + b * 0.114::DOUBLE AS lum, CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b) END AS sat, greatest(r, g, b) / 255 AS val FROM px),
    a AS (SELECT vec_id, avg((lum > 175)::INT) AS bright, avg((lum < 80)::INT) AS dark, avg((sat > 0.18 AND val > 0.16)::INT) AS colored, avg((lum < 110)::INT) AS edge, max(lum) - min(lum) AS contrast, count(*) AS n FROM q GROUP BY 1)
    SELECT vec_id, NOT ((bright > 0.96 AND dark < 0.002 AND colored < 0.002 AND contrast < 35) OR (colored < 0.002 AND edge < 0.003 AND contrast < 45) OR (colored * n < 2 AND edge * n < 3 AND contrast < 35)) AS useful FROM a"""
)
def crop_filter(spark, d):
    a = _pixels(spark, d).groupBy("vec_id").agg(*I.crop_counts(F.col("r"), F.col("g"), F.col("b")))
    return a.select("vec_id", I.is_useful_crop().alias("useful"))


_HSV = f"{_E}, hsv AS (SELECT vec_id, k, (e[3 * k + 1] + 0.5) * 360 AS h, abs(e[3 * k + 2]) * 3 AS s, abs(e[3 * k + 3]) * 4 AS v FROM e, range(21) t(k)), cls AS (SELECT vec_id, k, CASE WHEN v < 0.25 THEN 'UNKNOWN' WHEN s < 0.16 AND v > 0.72 THEN 'WHITE' WHEN v < 0.28 THEN 'BLACK' WHEN s < 0.18 THEN 'UNKNOWN' WHEN h BETWEEN 0 AND 22 OR h >= 338 THEN 'RED' WHEN h BETWEEN 35 AND 78 THEN 'YELLOW' WHEN h BETWEEN 80 AND 155 THEN 'GREEN' WHEN h BETWEEN 156 AND 210 THEN 'CYAN' WHEN h BETWEEN 211 AND 260 THEN 'BLUE' ELSE 'UNKNOWN' END AS color FROM hsv)"


def _colors(spark, d):
    v = lambda j: F.get("e", F.col("k") * 3 + j)
    return _e(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(20)))).select("vec_id", F.col("k").cast("long").alias("k"), I.color_class((v(0) + 0.5) * 360, F.abs(v(1)) * 3, F.abs(v(2)) * 4).alias("color"))


@query(f"WITH {_HSV} SELECT * FROM cls")
def color_category(spark, d):
    return _colors(spark, d)


@query(f"WITH {_HSV}, o AS (SELECT vec_id, color, count(*) AS n, list_position(['RED', 'YELLOW', 'GREEN', 'CYAN', 'BLUE', 'WHITE', 'BLACK'], color) AS o FROM cls WHERE color <> 'UNKNOWN' GROUP BY ALL), b AS (SELECT vec_id, arg_max(color, n * 10 - o) AS color, sum(n) AS valid FROM o GROUP BY 1) SELECT vec_id, coalesce(CASE WHEN valid / 21.0 >= 0.01 THEN b.color END, 'UNKNOWN') AS color FROM e LEFT JOIN b USING (vec_id)")
def dominant_color(spark, d):
    px = _colors(spark, d).select("vec_id", F.col("k").alias("x"), F.lit(0).alias("y"), "color")
    return I.dominant(px, "vec_id", (0, 0, 21, 1))


# ---- sizes ----
_SIZES = "(SELECT p_partkey AS id, p_size * 40 + 17 AS w, (p_partkey % 700 + 50)::INT AS h FROM part)"


def _sizes(spark, d):
    return T.read(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") * 40 + 17).alias("w"), (F.col("p_partkey") % 700 + 50).cast("int").alias("h"))


@query(f"SELECT id, round(s, 9) AS scale, floor(w * s + 0.5)::BIGINT AS new_w, floor(h * s + 0.5)::BIGINT AS new_h, floor((512 - floor(w * s + 0.5)) / 2)::BIGINT AS pad_x, floor((512 - floor(h * s + 0.5)) / 2)::BIGINT AS pad_y FROM (SELECT *, least(512 / w, 512 / h) AS s FROM {_SIZES})")
def letterbox_params(spark, d):
    out = N.letterbox(F.col("w"), F.col("h"))
    return _sizes(spark, d).select("id", *((F.round(v, 9) if k == "scale" else v.cast("long")).alias(k) for k, v in out.items()))


@query(f"SELECT id, (ceil(greatest(32, least(ceil(w * 48 / h), 1920)) / 32) * 32)::BIGINT AS width FROM {_SIZES}")
def rec_target_width(spark, d):
    return _sizes(spark, d).select("id", N.recognition_width(F.col("w"), F.col("h")).alias("width"))


@query("SELECT event_id, abs((value * 3) % 90) > 15 AND abs((value * 3) % 90) < 75 AS tilted FROM events")
def tilt_flag(spark, d):
    return T.read(spark, d, "events").select("event_id", N.is_tilted(F.col("value") * 3).alias("tilted"))


@query(f"SELECT id, trunc(w * f)::BIGINT AS new_w, trunc(h * f)::BIGINT AS new_h FROM (SELECT id, w, h, CASE WHEN greatest(w, h) > 1600 THEN 1600 / greatest(w, h) ELSE 1.0::DOUBLE END AS f FROM {_SIZES})")
def resize_dims(spark, d):
    w, h = N.resized(F.col("w"), F.col("h"))
    return _sizes(spark, d).select("id", w.alias("new_w"), h.alias("new_h"))


# ---- polygons: eight quads a vector, about 60 in each direction ----
_QUADS = f"{_E}, quads AS (SELECT vec_id, k, list_transform(e[8 * k + 1 : 8 * k + 8], lambda v: v * 100 + 60) AS p FROM e, range(8) t(k)), pts AS (SELECT *, [p[1], p[3], p[5], p[7]] AS x, [p[2], p[4], p[6], p[8]] AS y FROM quads)"


def _quads(spark, d):
    return _e(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")))).select("vec_id", "k", F.transform(F.slice("e", (F.col("k") * 8 + 1).cast("int"), 8), lambda v: v * 100 + 60).alias("p"))


def _spread(name, decimals=6):
    """Array elements as columns p0, p1, ..., rounded."""
    return [F.round(F.get(name, F.lit(i)), decimals).alias(f"p{i}") for i in range(8)]


_PS = lambda expr: ", ".join(f"round(({expr})[{i + 1}], 6) AS p{i}" for i in range(8))


@query(f"WITH {_QUADS} SELECT vec_id, k, round(abs((x[1] * y[2] - x[2] * y[1]) + (x[2] * y[3] - x[3] * y[2]) + (x[3] * y[4] - x[4] * y[3]) + (x[4] * y[1] - x[1] * y[4])) / 2, 6) AS area FROM pts")
def polygon_area(spark, d):
    return _quads(spark, d).select("vec_id", "k", F.round(G.area(F.col("p")), 6).alias("area"))


@query(f"WITH {_QUADS} SELECT vec_id, k, floor(list_min(x))::BIGINT AS \"left\", floor(list_min(y))::BIGINT AS top, ceil(list_max(x))::BIGINT AS \"right\", ceil(list_max(y))::BIGINT AS bottom FROM pts")
def polygon_bbox(spark, d):
    return _quads(spark, d).select("vec_id", "k", *(v.cast("long").alias(n) for n, v in G.int_bbox(F.col("p")).items()))


@query(f"WITH {_QUADS}, c AS (SELECT vec_id, k, list_transform(p, lambda v, i: greatest(0, least(CASE WHEN i % 2 = 1 THEN 100 ELSE 90 END, CASE WHEN i % 2 = 1 THEN list_avg(x) + (v - list_avg(x)) * 1.3::DOUBLE ELSE list_avg(y) + (v - list_avg(y)) * 1.3::DOUBLE END))) AS p FROM pts) SELECT vec_id, k, {_PS('p')} FROM c")
def polygon_expand(spark, d):
    return _quads(spark, d).withColumn("p", G.expanded(F.col("p"), 1.3, 100.0, 90.0)).select("vec_id", "k", *_spread("p"))


@query(f"WITH {_QUADS}, c AS (SELECT vec_id, k, list_transform(p, lambda v, i: greatest(0, least(200, (v - CASE WHEN i % 2 = 1 THEN 0 ELSE 30 END) / 0.32::DOUBLE))) AS p FROM quads) SELECT vec_id, k, {_PS('p')} FROM c")
def polygon_inverse_letterbox(spark, d):
    return _quads(spark, d).withColumn("p", G.inverse_letterbox(F.col("p"), F.lit(0.32), F.lit(0), F.lit(30), F.lit(200), F.lit(200))).select("vec_id", "k", *_spread("p"))


_PCA = f"""{_E}, pt AS (SELECT vec_id, e[2 * k + 1] * 100 AS x, e[2 * k + 2] * 100 AS y FROM e, range(32) t(k)),
m AS (SELECT vec_id, avg(x) AS cx, avg(y) AS cy, var_pop(x) AS cxx, var_pop(y) AS cyy, covar_pop(x, y) AS cxy FROM pt GROUP BY 1),
a AS (SELECT *, CASE WHEN abs(cxy) > 1e-10 THEN atan2(cxy, (cxx + cyy) / 2 + sqrt(greatest(0, (cxx + cyy) * (cxx + cyy) / 4 - (cxx * cyy - cxy * cxy))) - cyy) WHEN cxx >= cyy THEN 0 ELSE pi() / 2 END AS angle FROM m),
u AS (SELECT vec_id, cx, cy, angle, (x - cx) * cos(angle) + (y - cy) * sin(angle) AS u, (y - cy) * cos(angle) - (x - cx) * sin(angle) AS v FROM pt JOIN a USING (vec_id)),
rect AS (SELECT vec_id, cx, cy, angle, greatest(1, max(u) - min(u)) AS w, greatest(1, max(v) - min(v)) AS h FROM u GROUP BY ALL)"""


def _rects(spark, d):
    e = lambda j: F.get("e", F.col("k") * 2 + j) * 100
    points = _e(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(31)))).select("vec_id", e(0).alias("x"), e(1).alias("y"))
    return G.pca_rect(points, "vec_id")


@query(f"WITH {_PCA} SELECT vec_id, round(cx, 5) AS cx, round(cy, 5) AS cy, round(w, 5) AS w, round(h, 5) AS h, round(angle, 5) AS angle FROM rect")
def pca_rect(spark, d):
    return _rects(spark, d).select("vec_id", *(F.round(c, 5).alias(c) for c in ("cx", "cy", "w", "h", "angle")))


@query(
    f"""WITH {_PCA}, k AS (SELECT *, w / 2 * sqrt(1.5) AS hw, h / 2 * sqrt(1.5) AS hh, cos(angle) AS c, sin(angle) AS s FROM rect),
    q AS (SELECT vec_id, [cx - hw * c + hh * s, cy - hw * s - hh * c, cx + hw * c + hh * s, cy + hw * s - hh * c, cx + hw * c - hh * s, cy + hw * s + hh * c, cx - hw * c - hh * s, cy - hw * s + hh * c] AS p FROM k) SELECT vec_id, {_PS('p').replace(', 6)', ', 4)')} FROM q"""
)
def unclip_rect(spark, d):
    r = _rects(spark, d)
    return r.withColumn("p", G.unclipped(*(F.col(c) for c in ("cx", "cy", "w", "h", "angle")))).select("vec_id", *_spread("p", 4))


_BOX = f"{_QUADS}, box AS (SELECT vec_id, k, list_min(x) AS l, list_min(y) / 3 AS t, list_max(x) AS r, list_max(y) / 3 AS b FROM pts)"


def _boxes(spark, d):
    b = G.bbox(F.col("p"))
    return _quads(spark, d).select("vec_id", "k", b["left"].alias("left"), (b["top"] / 3).alias("top"), b["right"].alias("right"), (b["bottom"] / 3).alias("bottom"))


@query(
    f"""WITH {_BOX}, pr AS (SELECT a.vec_id, a.k, a.l AS al, a.t AS a_t, a.r AS ar, a.b AS ab, b.l + 60 AS bl, b.t AS bt, b.r + 60 AS br, b.b AS bb, greatest(a.b - a.t, 1) AS ah, greatest(b.b - b.t, 1) AS bh FROM box a JOIN box b ON a.vec_id = b.vec_id AND b.k = a.k + 1)
    SELECT vec_id, k, greatest(ah, bh) / least(ah, bh) <= 2.0::DOUBLE AND greatest(least(ab, bb) - greatest(a_t, bt), 0) / least(ah, bh) >= 0.45::DOUBLE AND abs((a_t + ab) / 2 - (bt + bb) / 2) <= greatest(ah, bh) * 0.55::DOUBLE
      AND greatest(least(ar, br) - greatest(al, bl), 0) <= least(greatest(ar - al, 1), greatest(br - bl, 1)) * 0.35::DOUBLE AND greatest(greatest(al, bl) - least(ar, br), 0) <= least(greatest(ah, bh) * 1.8::DOUBLE, 1600 * 0.04::DOUBLE)
      AND greatest(ab, bb) - least(a_t, bt) <= greatest(ah, bh) * 1.45::DOUBLE AND (k % 3 = 0 OR k % 2 = 0) AS merges FROM pr"""
)
def line_merge_predicate(spark, d):
    b = _boxes(spark, d)
    sides = ("left", "top", "right", "bottom")
    one = b.select("vec_id", "k", *(F.col(c).alias("a_" + c) for c in sides))
    two = b.select("vec_id", (F.col("k") - 1).alias("k"), *((F.col(c) + (60 if c in ("left", "right") else 0)).alias("b_" + c) for c in sides))
    color = lambda on, name: F.when(on, "UNKNOWN").otherwise(name)
    fit = I.colors_fit(color(F.col("k") % 3 == 0, "RED"), F.when(F.col("k") % 2 == 0, "RED").otherwise("BLUE"))
    return one.join(two, ["vec_id", "k"]).select("vec_id", "k", G.same_line(G.box_of("a_"), G.box_of("b_"), F.lit(1600), fit).alias("merges"))


@query(
    """WITH RECURSIVE px AS (SELECT vec_id AS image, i - 1 AS pos FROM embeddings, range(1, 65) t(i) WHERE embedding[i] > 0.05::FLOAT),
    reach(image, start, pos) AS (SELECT image, pos, pos FROM px UNION SELECT r.image, r.start, p.pos FROM reach r JOIN px p ON p.image = r.image AND (abs(p.pos - r.pos) = 8 OR (abs(p.pos - r.pos) = 1 AND p.pos // 8 = r.pos // 8))),
    c AS (SELECT image, pos, min(start) AS first FROM reach GROUP BY ALL), s AS (SELECT *, count(*) OVER (PARTITION BY image, first) AS n FROM c)
    SELECT image, dense_rank() OVER (PARTITION BY image ORDER BY first) - 1 AS component, pos % 8 AS x, pos // 8 AS y FROM s WHERE n >= 3"""
)
def connected_components(spark, d):
    e = T.read(spark, d, "embeddings").select(F.col("vec_id").alias("image"), F.posexplode("embedding").alias("pos", "v")).where(F.col("v") > I.f32(0.05))
    return R.components(e.select("image", (F.col("pos") % 8).cast("long").alias("x"), F.floor(F.col("pos") / 8).cast("long").alias("y")), 3)


_A, _B = "x[q // n + 1]", "x[q % n + 1]"
_TALL = lambda v: f"greatest({v}.b - {v}.t, 1)"
_BROAD = lambda v: f"greatest({v}.r - {v}.l, 1)"
_HIGH, _LOW = f"greatest({_TALL(_A)}, {_TALL(_B)})", f"least({_TALL(_A)}, {_TALL(_B)})"
_FITS = f"""(q % n) > (q // n) AND {_HIGH} / {_LOW} <= 2.0::DOUBLE AND greatest(least({_A}.b, {_B}.b) - greatest({_A}.t, {_B}.t), 0) / {_LOW} >= 0.45::DOUBLE AND abs(({_A}.t + {_A}.b) / 2 - ({_B}.t + {_B}.b) / 2) <= {_HIGH} * 0.55::DOUBLE
    AND greatest(least({_A}.r, {_B}.r) - greatest({_A}.l, {_B}.l), 0) <= least({_BROAD(_A)}, {_BROAD(_B)}) * 0.35::DOUBLE AND greatest(greatest({_A}.l, {_B}.l) - least({_A}.r, {_B}.r), 0) <= least({_HIGH} * 1.8::DOUBLE, 1600 * 0.04::DOUBLE)
    AND greatest({_A}.b, {_B}.b) - least({_A}.t, {_B}.t) <= {_HIGH} * 1.45::DOUBLE"""
_MIDDLE = f"((a.t + a.b) / 2 * {_BROAD('a')} + (b.t + b.b) / 2 * {_BROAD('b')}) / ({_BROAD('a')} + {_BROAD('b')})"
_HALF = "greatest(a.b - a.t, b.b - b.t, ((a.b - a.t) + (b.b - b.t)) / 2) / 2"


@query(
    f"""{_BOX.replace('e AS', 'WITH RECURSIVE e AS', 1)}, start AS (SELECT vec_id AS image, list({{'l': l + k * 40, 't': t, 'r': r + k * 40, 'b': b}} ORDER BY k) AS x FROM box GROUP BY 1),
    m(image, x, step) AS (SELECT image, x, 0 FROM start UNION ALL
      SELECT image, list_transform(list_filter(range(1, n + 1), lambda k: k <> q % n + 1), lambda k: CASE WHEN k = q // n + 1 THEN {{'l': least(a.l, b.l), 't': {_MIDDLE} - {_HALF}, 'r': greatest(a.r, b.r), 'b': {_MIDDLE} + {_HALF}}} ELSE x[k] END), step + 1
      FROM (SELECT *, {_A} AS a, {_B} AS b FROM (SELECT image, x, step, n, list_filter(range(n * n), lambda q: {_FITS})[1] AS q FROM (SELECT *, len(x) AS n FROM m))) WHERE q IS NOT NULL),
    f AS (SELECT image, arg_max(x, step) AS x FROM m GROUP BY 1), o AS (SELECT image, unnest(range(len(x))) AS line, unnest(x) AS v FROM f)
    SELECT image, line, round(v.l, 6) AS "left", round(v.t, 6) AS top, round(v.r, 6) AS "right", round(v.b, 6) AS bottom FROM o"""
)
def greedy_line_merge(spark, d):
    """Which lines come out depends on the order of merging: the first pair that fits, again and again."""
    b = _boxes(spark, d)
    boxes = b.select(F.col("vec_id").alias("image"), F.col("k").alias("ord"), (F.col("left") + F.col("k") * 40).alias("left"), "top", (F.col("right") + F.col("k") * 40).alias("right"), "bottom")
    return R.merge_lines(boxes, 1600.0).select("image", "line", *(F.round(c, 6).alias(c) for c in ("left", "top", "right", "bottom")))
