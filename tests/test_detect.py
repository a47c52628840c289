"""The detection chain against a model in plain Python, and its parts on images of several sizes."""

import colorsys
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import raster as R
from plumbline.operators import detect as D
from plumbline.operators import match, regions
from plumbline.plans import detect as P
from plumbline.sources import standins as T

DATA = "/root/testdata/sf0.001"


def components_model(lit, w, h, least):
    seen, out = set(), []
    for start in ((x, y) for y in range(h) for x in range(w)):
        if start not in lit or start in seen:
            continue
        seen.add(start)
        todo, cells = [start], []
        while todo:
            x, y = todo.pop()
            cells.append((x, y))
            for n in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if n in lit and n not in seen:
                    seen.add(n)
                    todo.append(n)
        if len(cells) >= least:
            out.append(cells)
    return out


@pytest.mark.parametrize("share", [0.2, 0.55, 0.9])
def test_component_runs(spark, share):
    rnd = random.Random(int(share * 100))
    maps = [(i, w, [float(rnd.random() < share) for _ in range(w * h)]) for i, (w, h) in enumerate([(64, 64), (1, 30), (30, 1), (17, 9)] * 5)] + [(99, 5, [])]
    spiral = [[1.0] * 9 if y % 2 == 0 else [0.0] * 9 for y in range(9)]
    for y in range(1, 9, 2):
        spiral[y][8 if y % 4 == 1 else 0] = 1.0
    maps.append((50, 9, [v for row in spiral for v in row]))
    frame = spark.createDataFrame(maps, "image long, width int, heat array<double>")
    got = {}
    for r in regions.run_pixels(regions.component_runs(frame, 0.5, 3)).collect():
        got.setdefault((r.image, r.component), set()).add((r.x, r.y))
    want = {}
    for i, w, v in maps:
        lit = {(k % w, k // w) for k, x in enumerate(v) if x > 0.5}
        want |= {(i, k): set(c) for k, c in enumerate(components_model(lit, w, len(v) // w, 3))}
    assert got == want
    px = spark.createDataFrame([(i, k % w, k // w) for i, w, v in maps for k, x in enumerate(v) if x > 0.5], "image long, x long, y long")
    again = {}
    for r in regions.components(px, 3).collect():
        again.setdefault((r.image, r.component), set()).add((r.x, r.y))
    assert again == want


def fits_model(a, b, image_w, ca="UNKNOWN", cb="UNKNOWN"):
    ha, hb = max(a[3] - a[1], 1), max(b[3] - b[1], 1)
    gap = b[0] - a[2] if a[2] < b[0] else a[0] - b[2] if b[2] < a[0] else 0
    return (
        max(ha, hb) / min(ha, hb) <= 2 and max(min(a[3], b[3]) - max(a[1], b[1]), 0) / min(ha, hb) >= 0.45 and abs((a[1] + a[3]) / 2 - (b[1] + b[3]) / 2) <= max(ha, hb) * 0.55
        and max(min(a[2], b[2]) - max(a[0], b[0]), 0) <= max(min(a[2] - a[0], b[2] - b[0]), 1) * 0.35 and gap <= min(max(ha, hb) * 1.8, image_w * 0.04)
        and max(a[3], b[3]) - min(a[1], b[1]) <= max(ha, hb) * 1.45 and ("UNKNOWN" in (ca, cb) or ca == cb)
    )


def merge_model(boxes, image_w, color=lambda b: "UNKNOWN"):
    boxes = [list(b) for b in boxes]
    if len(boxes) <= 1:
        return boxes
    while True:
        pair = next(((i, j) for i in range(len(boxes)) for j in range(i + 1, len(boxes)) if fits_model(boxes[i], boxes[j], image_w, color(boxes[i]), color(boxes[j]))), None)
        if pair is None:
            return boxes
        a, b = boxes[pair[0]], boxes.pop(pair[1])
        wa, wb = max(a[2] - a[0], 1), max(b[2] - b[0], 1)
        middle, tall = ((a[1] + a[3]) / 2 * wa + (b[1] + b[3]) / 2 * wb) / (wa + wb), max(a[3] - a[1], b[3] - b[1])
        boxes[pair[0]] = [min(a[0], b[0]), middle - tall / 2, max(a[2], b[2]), middle + tall / 2]


NAMES = ("RED", "YELLOW", "GREEN", "CYAN", "BLUE", "WHITE", "BLACK")


def class_model(r, g, b):
    h, s, v = colorsys.rgb_to_hsv(r / 255, g / 255, b / 255)
    h *= 360
    if v < 0.25:
        return "UNKNOWN"
    if s < 0.16 and v > 0.72:
        return "WHITE"
    if v < 0.28:
        return "BLACK"
    if s < 0.18:
        return "UNKNOWN"
    return "RED" if h >= 338 else next((n for n, (lo, hi) in zip(NAMES, ((0, 22), (35, 78), (80, 155), (156, 210), (211, 260)), strict=False) if lo <= h <= hi), "UNKNOWN")


def dominant_model(classes, w, h, box):
    left, top = max(0, min(w - 1, math.floor(box[0]))), max(0, min(h - 1, math.floor(box[1])))
    right, bottom = max(left + 1, min(w, math.ceil(box[2]))), max(top + 1, min(h, math.ceil(box[3])))
    step = max(1, max(right - left, bottom - top) // 64)
    got = [classes[y * w + x] for y in range(top, bottom, step) for x in range(left, right, step)]
    counts = [got.count(n) for n in NAMES]
    return "UNKNOWN" if sum(counts) / len(got) < 0.01 or not max(counts) else NAMES[counts.index(max(counts))]


def test_merging_random_boxes_with_colours(spark):
    rnd = random.Random(3)
    w, h = 200, 90
    classes = {i: [rnd.choice([*NAMES[:2], "UNKNOWN"]) if i % 2 else NAMES[(x // 60) % 3] for y in range(h) for x in range(w)] for i in range(30)}
    polygons, want, apart = [], {}, 0
    for i in range(30):
        boxes = []
        for k in range(rnd.randrange(1, 12)):
            x, y, bw, bh = rnd.uniform(0, 170), rnd.choice([10, 40]) + rnd.uniform(-3, 3), rnd.uniform(5, 30), rnd.uniform(8, 14)
            boxes.append([x, y, x + bw, y + bh])
            polygons.append((i, k, [x, y, x + bw, y, x + bw, y + bh, x, y + bh]))
        want[i] = merge_model(boxes, w, lambda b, i=i: dominant_model(classes[i], w, h, b))
        apart += want[i] != merge_model(boxes, w)
    polygons.append((77, 0, [5.0, 0.0, 10.0, 5.0, 5.0, 10.0, 0.0, 5.0]))  # alone and rotated: stays as it is
    classes[77] = ["RED"] * (w * h)
    pictures = spark.createDataFrame([(i, w, h, c) for i, c in classes.items()], "image long, w int, h int, classes array<string>")
    got = {}
    for r in regions.merge_polygons(spark.createDataFrame(polygons, "image long, ord int, p array<double>"), pictures).orderBy("line").collect():
        got.setdefault(r.image, []).append(list(r.p))
    assert got.pop(77) == [[5.0, 0.0, 10.0, 5.0, 5.0, 10.0, 0.0, 5.0]]
    assert {i: [[p[0], p[1], p[4], p[5]] for p in lines] for i, lines in got.items()} == {i: [pytest.approx(b) for b in lines] for i, lines in want.items()}
    assert apart  # colours kept some apart
    boxes = spark.createDataFrame([(i, k, *p[:2], *p[4:6]) for i, k, p in polygons], "image long, ord int, left double, top double, right double, bottom double")
    assert regions.merge_lines(boxes, 200.0).where("image = 77").count() == 1


def test_dominant_with_a_step(spark):
    rnd = random.Random(4)
    w, h = 300, 160
    classes = [rnd.choice([*NAMES, "UNKNOWN", "UNKNOWN"]) for _ in range(w * h)]
    boxes = [(0.0, 0.0, 300.0, 160.0), (10.5, 3.2, 200.1, 50.0), (-9.0, -9.0, 0.0, 0.0), (299.5, 159.5, 400.0, 400.0), (5.0, 5.0, 5.0, 5.0)]
    df = spark.createDataFrame([(classes,)], "c array<string>")
    got = df.select(*(R.dominant_in(F.col("c"), w, h, {k: F.lit(v) for k, v in zip(("left", "top", "right", "bottom"), b, strict=True)}).alias(f"b{i}") for i, b in enumerate(boxes))).first()
    assert list(got) == [dominant_model(classes, w, h, b) for b in boxes]


def mixed_model(grid, w, h, u, v):
    u, v = max(0, min(w - 1, u)), max(0, min(h - 1, v))
    x, y = int(u), int(v)
    fx, fy, x2, y2 = u - x, v - y, min(x + 1, w - 1), min(y + 1, h - 1)
    return (grid[y * w + x] * (1 - fx) + grid[y * w + x2] * fx) * (1 - fy) + (grid[y2 * w + x] * (1 - fx) + grid[y2 * w + x2] * fx) * fy


def test_scaling(spark):
    rnd = random.Random(5)
    for w, h, nw, nh in ((7, 5, 14, 10), (8, 6, 3, 2), (5, 4, 5, 4), (1, 1, 3, 2)):
        grid = [rnd.uniform(0, 255) for _ in range(w * h)]
        df = spark.createDataFrame([(grid,)], "g array<double>")
        fine, rough = df.select(R.resampled(F.col("g"), w, h, nw, nh), R.scaled(F.col("g"), w, h, nw, nh)).first()
        assert fine == pytest.approx([mixed_model(grid, w, h, (x + 0.5) * w / nw - 0.5, (y + 0.5) * h / nh - 0.5) for y in range(nh) for x in range(nw)])
        assert rough == [grid[int((y + 0.5) * h / nh) * w + int((x + 0.5) * w / nw)] for y in range(nh) for x in range(nw)]


def test_warp_of_a_known_quad():
    rnd = np.random.default_rng(6)
    grid = rnd.integers(0, 256, (3, 20, 30)).astype(float)
    # an upright box gives its pixels as they are
    m = R.homography(np.array([4.0, 3.0, 14.0, 3.0, 14.0, 9.0, 4.0, 9.0]))
    assert (R.upright(grid, m, 10, 6).reshape(3, 6, 10) == grid[:, 3:9, 4:14]).all()
    # a quarter turn
    m = R.homography(np.array([14.0, 3.0, 14.0, 9.0, 4.0, 9.0, 4.0, 3.0]))
    assert (R.upright(grid, m, 6, 10).reshape(3, 10, 6) == grid[:, 3:9, 4:14][:, :, ::-1].transpose(0, 2, 1)).all()
    # corners of any quad are met, and what lies in between is a plane in perspective
    p = np.array([3.0, 2.0, 25.0, 5.0, 22.0, 17.0, 6.0, 14.0])
    a, b, c, d, e, f, g, h = R.homography(p)
    at = lambda s, t: ((a * s + b * t + c) / (g * s + h * t + 1), (d * s + e * t + f) / (g * s + h * t + 1))
    assert [v for q in ((0, 0), (1, 0), (1, 1), (0, 1)) for v in at(*q)] == pytest.approx(list(p))
    middle = np.linalg.solve(np.array([[p[4] - p[0], p[2] - p[6]], [p[5] - p[1], p[3] - p[7]]]), np.array([p[2] - p[0], p[3] - p[1]]))
    assert at(0.5, 0.5) == pytest.approx((p[0] + middle[0] * (p[4] - p[0]), p[1] + middle[0] * (p[5] - p[1])))  # where the diagonals cross
    assert (R.upright(grid, R.homography(np.array([40.0, 40, 50, 40, 50, 50, 40, 50])), 4, 4) == 255).all()
    assert R.homography(np.array([1.0, 1, 2, 2, 3, 3, 4, 4])) is None


def area_model(p):
    return abs(sum(p[2 * i] * p[(2 * i + 3) % 8] - p[(2 * i + 2) % 8] * p[2 * i + 1] for i in range(4))) / 2


def useful_model(rgb, w, h):
    if w < 8 or h < 8:
        return False
    if max(w, h) > 128:
        k = 128 / max(w, h)
        nw, nh = max(1, int(w * k)), max(1, int(h * k))
        rgb = [[math.floor(mixed_model(g, w, h, (x + 0.5) * w / nw - 0.5, (y + 0.5) * h / nh - 0.5) + 0.5) for y in range(nh) for x in range(nw)] for g in rgb]
    px = list(zip(*rgb, strict=True))
    lum = [0.299 * r + 0.587 * g + 0.114 * b for r, g, b in px]
    n, colored = len(px), sum(max(p) > 0 and (max(p) - min(p)) / max(p) > 0.18 and max(p) / 255 > 0.16 for p in px)
    bright, dark, edge, contrast = sum(v > 175 for v in lum), sum(v < 80 for v in lum), sum(v < 110 for v in lum), max(lum) - min(lum)
    return not ((bright / n > 0.96 and dark / n < 0.002 and colored / n < 0.002 and contrast < 35) or (colored / n < 0.002 and edge / n < 0.003 and contrast < 45) or (colored < 2 and edge < 3 and contrast < 35))


def chain_model(heat, rgb, w, h, readings):
    """Regions of one picture by index: polygon, crop, and what is read, None where nothing is kept."""
    scale = min(64 / w, 64 / h)
    pad_x, pad_y = (64 - math.floor(w * scale + 0.5)) // 2, (64 - math.floor(h * scale + 0.5)) // 2
    polygons = []
    for cells in components_model({(k % 64, k // 64) for k, v in enumerate(heat) if v > 0.18}, 64, 64, 15):
        x, y = (np.array([c[k] for c in cells], float) for k in (0, 1))
        cx, cy, cxx, cyy = x.mean(), y.mean(), x.var(), y.var()
        cxy = ((x - cx) * (y - cy)).mean()
        disc = math.sqrt(max(0, (cxx + cyy) ** 2 / 4 - (cxx * cyy - cxy * cxy)))
        angle = math.atan2(cxy, (cxx + cyy) / 2 + disc - cyy) if abs(cxy) > 1e-10 else 0 if cxx >= cyy else math.pi / 2
        u, v = (x - cx) * math.cos(angle) + (y - cy) * math.sin(angle), (y - cy) * math.cos(angle) - (x - cx) * math.sin(angle)
        hw, hh = max(1, np.ptp(u)) / 2 * math.sqrt(1.5), max(1, np.ptp(v)) / 2 * math.sqrt(1.5)
        p = [f for a, b in ((-hw, -hh), (hw, -hh), (hw, hh), (-hw, hh)) for f in (cx + a * math.cos(angle) - b * math.sin(angle), cy + a * math.sin(angle) + b * math.cos(angle))]
        p = [max(0, min(w if i % 2 == 0 else h, (f - (pad_x if i % 2 == 0 else pad_y)) / scale)) for i, f in enumerate(p)]
        if area_model(p) > 120:
            polygons.append(p)
    classes = [class_model(*c) for c in zip(*rgb, strict=True)]
    if len(polygons) > 1:
        boxes = merge_model([[min(p[0::2]), min(p[1::2]), max(p[0::2]), max(p[1::2])] for p in polygons], w, lambda b: dominant_model(classes, w, h, b))
        polygons = [[b[0], b[1], b[2], b[1], b[2], b[3], b[0], b[3]] for b in boxes]
    out = []
    for index, p in enumerate(sorted(polygons, key=lambda p: -round(area_model(p), 9))[:24], 1):
        cx, cy = sum(p[0::2]) / 4, sum(p[1::2]) / 4
        p = [max(0, min(w, cx + (f - cx) * 1.1)) if i % 2 == 0 else max(0, min(h, cy + (f - cy) * 1.3)) for i, f in enumerate(p)]
        pts = sorted(zip(p[0::2], p[1::2], strict=True), key=lambda q: q[1])
        (a, b), (d, c) = sorted(pts[:2], key=lambda q: q[0]), sorted(pts[2:], key=lambda q: q[0])
        q = [*a, *b, *c, *d]
        dist = lambda i, j: math.hypot(q[2 * i] - q[2 * j], q[2 * i + 1] - q[2 * j + 1])
        cw, ch = max(1, int((dist(0, 1) + dist(3, 2)) / 2)), max(1, int((dist(0, 3) + dist(1, 2)) / 2))
        crop = R.upright(np.array(rgb, float).reshape(3, h, w), R.homography(np.array(q)), cw, ch)
        item = None
        if useful_model(crop.tolist(), cw, ch):
            text, conf, text_r, conf_r = readings[index]
            n = lambda t: sum(x.isalnum() or x in "-/" for x in t)
            score = lambda t, c: c * 0.8 + n(t) / len(t) * 0.15 + min(len(t), 24) * 0.002 if t else 0
            sure = conf >= 0.62 and n(text) / len(text) >= 0.75 and n(text) >= 4 and text not in ("EMPTY", "ERROR", "FORMATERR")
            turned = not sure and score(text_r, conf_r) > score(text, conf)
            t, k = (text_r, conf_r) if turned else (text, conf)
            kept = t and t not in ("EMPTY", "ERROR", "FORMATERR") and n(t) and n(t) / len(t) >= 0.45 and not (n(t) <= 2 and k < 0.6)
            item = (t, "rotated" if turned else "normal", ch > cw * 1.2, not sure, bool(kept))
        out.append((index, [math.floor(min(p[0::2])), math.floor(min(p[1::2])), math.ceil(max(p[0::2])), math.ceil(max(p[1::2]))], item))
    return out


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_chain(spark):
    some = F.col("image") < 40
    maps, pictures, readings = (f(spark, DATA).where(some) for f in (T.heat_maps, T.pictures, T.readings))
    named = P._with_classes(pictures)
    now = iter(range(1000))
    phases = D.Phases(lambda: float(next(now)))
    items, counts = D.run(maps, P._frames(named), named, readings, phases=phases)
    got = {(r.image, r["index"]): ([r.left, r.top, r.right, r.bottom], r.text, r.side, r.turned) for r in items.collect()}
    spent = {r.image: (r.normal_count, r.rotated_count) for r in counts.collect()}
    read = {}
    for r in readings.collect():
        read.setdefault(r.image, {})[r["index"]] = (r.text, r.confidence, r.text_r, r.confidence_r)
    rgb = {r.image: [list(r.r), list(r.g), list(r.b)] for r in pictures.collect()}
    want, runs, gaps, outlines = {}, {}, 0, 0
    for r in maps.collect():
        chain = chain_model(list(r.heat), rgb[r.image], 96, 72, read[r.image])
        outlines += len(chain)
        made = [x[2] for x in chain if x[2]]
        if made:
            runs[r.image] = (len(made), sum(x[3] for x in made))
        kept = {(r.image, i): (box, x[0], x[1], x[2]) for i, box, x in chain if x and x[4]}
        gaps += bool(kept) and max(i for _, i in kept) > len(kept)
        want |= kept
    assert got == want and spent == runs
    assert gaps  # some regions were left out, and the others kept their index
    assert D.outlined(maps, P._frames(named), named).count() == outlines
    # a clock that ticks a second a look: five steps of one second each, and what lies between them
    ms = phases.milliseconds()
    assert {k: ms[k] for k in ("detection", "crop", "crop_check", "recognition", "result_filter")} == dict.fromkeys(("detection", "crop", "crop_check", "recognition", "result_filter"), 1000)
    assert ms["total"] == 11_000 and ms["other"] == 6_000


def test_codes_of_items(spark):
    items = spark.createDataFrame([(1, 1, " Xa1 AB-10O ", 0.9), (1, 3, "  ", 0.8), (1, 4, "QQQQQQQQQ", 0.7), (2, 1, "AB-200!", 0.6)], "image long, index int, text string, confidence double")
    labels = match.indexed(spark.createDataFrame([("AB-100",), ("AB-200",)], "code string"))
    got = {(r.image, r["index"]): (r.raw_text, r.cleaned_code, r.is_valid, r.matched_label, r.match_distance, r.is_exact, r.candidates, r.display_code, r.confidence) for r in D.codes(items, labels).collect()}
    assert got == {
        (1, 1): ("Xa1 AB-10O", "AB-10O", True, "AB-100", 0, True, "AB-100|AB-200", "AB-100", 0.9),
        (1, 4): ("QQQQQQQQQ", "QQQQQQQQQ", True, None, 2147483647, False, "", "QQQQQQQQQ", 0.7),
        (2, 1): ("AB-200!", "AB-200!", False, "AB-200", 1, False, "AB-200|AB-100", "AB-200", 0.6),
    }


def test_blur_and_crops_of_two_sizes(spark):
    rnd = random.Random(9)
    rows, want_blur, want_use = [], {}, {}
    for i, (w, h) in enumerate([(64, 30), (400, 260), (7, 40), (40, 8), (200, 150)]):
        base = rnd.choice([20, 200, 250])
        rgb = [[float(max(0, min(255, base + (rnd.randrange(-90, 90) if i % 2 else 0)))) for _ in range(w * h)] for _ in range(3)]
        rows.append((i, w, h, *rgb))
        want_use[i] = useful_model(rgb, w, h)
        nh = int(h * (np.float32(320) / np.float32(w)))
        gray = np.array([0.299 * r + 0.587 * g + 0.114 * b for r, g, b in zip(*rgb, strict=True)]).reshape(h, w)
        s = gray[((np.arange(nh) + 0.5) * h / nh).astype(int)][:, ((np.arange(320) + 0.5) * w / 320).astype(int)]
        lap = np.zeros_like(s)
        lap[1:-1, 1:-1] = s[:-2, 1:-1] + s[2:, 1:-1] + s[1:-1, :-2] + s[1:-1, 2:] - 4 * s[1:-1, 1:-1]
        want_blur[i] = lap.var()
    pics = spark.createDataFrame(rows, "image long, w int, h int, r array<double>, g array<double>, b array<double>")
    assert {r.image: r.score for r in D.blur_scores(pics, "image").collect()} == {i: pytest.approx(v, rel=1e-6, abs=1e-6) for i, v in want_blur.items()}
    crops = pics.withColumnsRenamed({"w": "cw", "h": "ch"})
    assert {r.image for r in D.useful(crops, "image").collect()} == {i for i, v in want_use.items() if v}
