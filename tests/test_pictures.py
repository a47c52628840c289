"""What pictures must not do on the way: be broadcast, be saved, or be taken apart into rows of pixels."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.constants import COLORS
from plumbline.functions import raster as R
from plumbline.operators import detect as D
from plumbline.plans import detect as P
from plumbline.sources import standins as T

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_detected_lines_holds_boxes_and_not_pictures(spark):
    got = plan(P.detected_lines(spark, DATA))
    assert "ShuffledHashJoin [image" in got and "BuildLeft" in got
    assert len(got) < 100_000


def test_detection_chain_saves_no_pixels(spark, monkeypatch):
    kept, saved = [], D.saved
    monkeypatch.setattr(D, "saved", lambda df: kept.append(set(df.columns)) or saved(df))
    some = F.col("image") < 20
    p = T.pictures(spark, DATA).where(some)
    D.run(T.heat_maps(spark, DATA).where(some), P._frames(p), p, T.readings(spark, DATA))
    assert len(kept) == 1 and not kept[0] & {"r", "g", "b"}


def test_upright_crops_hold_regions_and_not_pictures(spark):
    got = plan(P.upright_crops(spark, DATA))
    assert got.count("ShuffledHashJoin [image") == 2 and len(got) < 100_000


def test_picture_blur_scores_pictures_where_they_are(spark):
    got = plan(P.picture_blur(spark, DATA))
    assert "Generate" not in got and "Aggregate" not in got


def test_pictures_of_odd_vectors(spark, tmp_path):
    odd = [(1, [float("nan")] + [0.0] * 63), (2, None), (3, [0.1, None]), (4, [0.2] * 70)]
    spark.createDataFrame(odd, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    for w, h in ((16, 8), (7, 30)):
        for row in T.pictures(spark, str(tmp_path), w, h).collect():
            e = (dict(odd)[row.image] or [])[:64]
            e = e + [None] * (64 - len(e))
            for c, got in enumerate((row.r, row.g, row.b)):
                field = [(k // w * 8 // h * 8 + k % w * 8 // w + 7 * c) % 64 for k in range(w * h)]
                assert got == [0.0 if e[f] is None else 255.0 if e[f] != e[f] else float(int(min(255.0, (float(np.float32(e[f])) * 3 + 0.5) * 255) + 0.5)) for f in field]


def test_crop_sums_count_crops_where_they_are(spark):
    got = plan(D.crop_sums(spark.createDataFrame([(1, 8, 8, [9.0] * 64, [9.0] * 64, [200.0] * 64)], "image long, cw int, ch int, r array<double>, g array<double>, b array<double>"), "image"))
    assert "Generate" not in got and "Aggregate" not in got


def test_text_regions_sum_up_runs(spark):
    got = plan(P.text_regions(spark, DATA))
    assert "Generate" not in got


def test_merging_sends_no_pixels_back(spark):
    for query in (P.upright_crops, P.detected_lines):
        got = plan(query(spark, DATA))
        assert "ArrowEvalPython" not in got and "ArrowUDF" not in got


def test_colours_are_those_of_the_expressions(spark):
    rnd = np.random.default_rng(5)
    for w, h in ((300, 160), (40, 20)):
        few = [[[float(v) for v in x] for x in rnd.choice([0, 40, 120, 200, 255], (3, w * h - short))] for short in (0, 7)]
        boxes = [[0.0, 0.0, w, h], [10.5, 3.2, 39.1, 19.0], [-9.0, -9.0, 0.0, 0.0], [w - 0.5, h - 0.5, 400.0, 400.0], [5.0, 5.0, 5.0, 5.0]]
        for rgb in few:
            codes = R.color_codes(*map(np.array, rgb))
            frame = spark.createDataFrame([([COLORS[c] for c in codes],)], "c array<string>")
            want = frame.select(*(R.dominant_in(F.col("c"), w, h, {k: F.lit(float(v)) for k, v in zip(("left", "top", "right", "bottom"), b, strict=True)}).alias(f"b{i}") for i, b in enumerate(boxes))).first()
            for channels in (rgb, [[COLORS[c] for c in codes]]):
                grid = R.code_grid([pa.array([c]) for c in channels], w, h)
                assert [COLORS[R.dominant_code(grid, b)] for b in boxes] == list(want)


def few_at_a_time(monkeypatch):
    """How many pictures each call that works on pixels gets."""
    calls, plain = [], R._luminance
    monkeypatch.setattr(R, "_luminance", lambda *rgb: calls.append(len(rgb[0])) or plain(*rgb))
    return calls


def odd_pictures(sizes):
    rnd = np.random.default_rng(7)
    out = [(w, h, *([float(v) for v in rnd.choice([0, 80, 110, 175, 255], w * h)] for _ in range(3))) for w, h in sizes]
    out[1][2][:] = out[1][3][:] = out[1][4][:] = [9.0] * len(out[1][2])
    out[2][3][5] = None
    del out[3][4][-2:]
    out[4][2].append(5.0)
    out[5] = (*out[5][:4], None)
    out[6] = (None, *out[6][1:])
    out[7] = (0, *out[7][1:])
    return out


def columns(rows, more):
    kinds = [pa.int32()] * (2 + len(more[0])) + [pa.list_(pa.float64())] * 3
    return [pa.array(c, k) for c, k in zip(zip(*((*r[:2], *m, *r[2:]) for r, m in zip(rows, more, strict=True)), strict=True), kinds, strict=True)]


SIZES = ((64, 30), (80, 12), (700, 20), (33, 77), (320, 5), (64, 30), (80, 12), (80, 12), (64, 30), (80, 12), (1, 1), (9, 2)) * 3


def test_blur_of_equal_sizes_is_scored_together(monkeypatch):
    calls, rows = few_at_a_time(monkeypatch), odd_pictures(SIZES)
    heights = [(h * 320 // w,) if w else (3,) for w, h in ((r[0] or 0, r[1]) for r in rows)]
    got = R.blur_score(*columns(rows, heights)).to_pylist()
    assert len(calls) < sum(v is not None for v in got) / 2
    for (w, h, *rgb), (nh,), score in zip(rows, heights, got, strict=True):
        if not w or None in rgb:
            assert score is None
            continue
        full = [(np.array([np.nan if v is None else v for v in c] + [np.nan] * (w * h - len(c)))[: w * h]).reshape(h, w) for c in rgb]
        y, x = (np.floor((np.arange(n) + 0.5) * old / n).astype(int) for n, old in ((nh, h), (320, w)))
        s = (full[0] * 0.299 + full[1] * 0.587 + full[2] * 0.114)[y][:, x]
        lap = np.zeros((nh, 320))
        if nh > 2:
            lap[1:-1, 1:-1] = s[1:-1, :-2] + s[1:-1, 2:] + s[:-2, 1:-1] + s[2:, 1:-1] - 4 * s[1:-1, 1:-1]
        assert score == pytest.approx(np.nanvar(lap) if lap.size else 0.0, rel=1e-9, abs=1e-9)


def test_crops_of_equal_sizes_are_counted_together(monkeypatch):
    rows = odd_pictures(SIZES)
    fits = [(max(1, r[0] * 128 // max(r[:2])), max(1, r[1] * 128 // max(r[:2]))) if r[0] and max(r[:2]) > 128 else (r[0], r[1]) for r in rows]
    alone = [R.crop_counts(*columns([r], [f])).to_pylist()[0] for r, f in zip(rows, fits, strict=True)]
    calls = few_at_a_time(monkeypatch)
    assert R.crop_counts(*columns(rows, fits)).to_pylist() == alone
    assert len(calls) < sum(v is not None for v in alone) / 2
    w, h, r, g, b = rows[0]
    lum = [x * 0.299 + y * 0.587 + z * 0.114 for x, y, z in zip(r, g, b, strict=True)]
    colored = sum(max(p) / 255 > 0.16 and (max(p) - min(p)) / max(p) > 0.18 for p in zip(r, g, b, strict=True))
    assert alone[0] == {"bright": sum(v > 175 for v in lum), "dark": sum(v < 80 for v in lum), "colored": colored, "edge": sum(v < 110 for v in lum), "contrast": max(lum) - min(lum), "n": w * h}
