"""Cases of known outcome."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import image, numeric, text
from plumbline.operators import history, masters, match, regions, sessions, sync
from plumbline.sources import readers, sinks


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r.y for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


# Codes, sizes and scores in this file are what the store has to give.
VALID = ["1C-X1Y1", "2C-X3Y3", "1ELP75-1", "2EP175-5", "3SB40-8", "3SCB35-1", "B1SCB100-30", "B2SCB40-10", "PHRHV", "RV11", "ABC-123/DEF.456_GHI+JKL", "abc-123", "ABC 123"]


def test_validation(spark):
    assert column(spark, VALID, text.validation_error) == [None] * len(VALID)
    assert column(spark, ["", "   ", "A", None], text.validation_error) == ["blank", "blank", "short", "blank"]
    assert column(spark, [f"ABC{c}123" for c in "!?#$%&*@=;:,"], text.validation_error) == ["charset"] * 12
    assert column(spark, ["A" * 51], text.validation_error) == ["long"]


def test_cleaning(spark):
    raw = ["Xa1 1C-X1Y1", "Ya1 2EP175-5", "1C-X1Y1", "  1C-X1Y1  ", "  Xa1 1C-X1Y1  ", "Xa1Ya1ABC"]
    assert column(spark, raw, text.clean_code) == ["1C-X1Y1", "2EP175-5", "1C-X1Y1", "1C-X1Y1", "1C-X1Y1", "Ya1ABC"]
    kept = column(spark, ["1C-X1Y1", "A", "", "2EP175-5", "###", "3SB40-8"], text.is_extractable)
    assert sum(kept) == 3


def test_server_form(spark):
    raw = ["ｂ1ｓｂ30Ｎ－7Ａ", " ab é", "鉄骨", "H150×150", "①A"]
    assert column(spark, raw, text.server_normalized) == ["B1SB30N-7A", "AB ", "", "H150150", "1A"]


def test_variants(spark):
    assert column(spark, ["", "6G"], lambda c: F.sort_array(text.variants(c))) == [[""], sorted(["6G", "BG", "66"])]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_matching(spark):
    labels = match.indexed(spark.createDataFrame([(f"NEW-STEEL-{x}",) for x in ("A1", "B2", "C3")], "code string"))
    texts = spark.createDataFrame([(t,) for t in ("NEW-STEEL-A2", "NEW-STEEL-A1", "N E W-5TEEL A1", "NEW", "QQQQQQQQ")], "text string")
    got = {}
    for r in match.top(texts, labels).collect():
        got.setdefault(r.text, {})[r["rank"]] = (r.code[-2:], r.distance, r.is_exact, r.is_ambiguous)
    assert got == {
        "NEW-STEEL-A2": {1: ("A1", 1, False, True), 2: ("B2", 1, False, True), 3: ("C3", 2, False, True)},
        "NEW-STEEL-A1": {1: ("A1", 0, True, False), 2: ("B2", 2, False, False), 3: ("C3", 2, False, False)},
        "N E W-5TEEL A1": {1: ("A1", 0, True, False), 2: ("B2", 2, False, False), 3: ("C3", 2, False, False)},
    }


def test_matching_against_a_model(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("01OISB58-A ") for _ in range(rnd.randrange(3, 9)))
    codes, texts = sorted({word() for _ in range(60)}), sorted({word() for _ in range(60)})
    form = lambda s: s.upper().strip().replace(" ", "").replace("-", "")
    swap = dict(zip("0O1I5S8B6G2Z7T4A", "O0I1S5B8B6Z2T7A4", strict=True))
    want = {}
    for t in (t for t in texts if len(t) >= 4):
        f = form(t)
        vs = {f} | {f[:i] + swap.get(c, c) + f[i + 1 :] for i, c in enumerate(f)}
        found = []
        for i, c in enumerate(codes):
            d = min(levenshtein(v, form(c)) for v in vs)
            pre = any(len(v) >= 2 and len(form(c)) >= 2 and v[:2] == form(c)[:2] for v in vs)
            if d <= 3:
                found.append((d, not pre, abs(len(f) - len(form(c))), i))
        found = [x for x in found if not x[1]] or found
        for rank, x in enumerate(sorted(found)[:3], 1):
            want[t, rank] = (codes[x[3]], x[0])
    rows = match.top(spark.createDataFrame([(t,) for t in texts], "text string"), match.indexed(spark.createDataFrame([(c,) for c in codes], "code string"))).collect()
    assert {(r.text, r["rank"]): (r.code, r.distance) for r in rows} == want


def test_label_import(spark):
    old = spark.createDataFrame([("A1",)], "code string")
    new = spark.createDataFrame([(0, "code"), (1, "A1"), (2, " B2 "), (3, "B2"), (4, "製品番号"), (5, " ")], "ord long, cell string")
    lines = masters.label_lines(new)
    after, counts = masters.import_labels(old, lines, "diff")
    assert sorted(r.code for r in after.collect()) == ["A1", "B2"] and tuple(counts.first()) == (1, 2)
    after, counts = masters.import_labels(old, lines.where("code = 'B2'"), "replace")
    assert [r.code for r in after.collect()] == ["B2"] and tuple(counts.first()) == (1, 0)


def test_construction_import_keeps_repeats(spark):
    old = spark.createDataFrame([(1, "x", "c001")], "id long, name string, code string")
    new = spark.createDataFrame([(1, "n1", "c002"), (2, "n2", "c002"), (3, "n3", "c001")], "id long, name string, code string")
    assert sorted(tuple(r) for r in masters.import_diff(old, new, ["code"]).collect()) == [(1, "n1", "c002"), (1, "x", "c001"), (2, "n2", "c002")]


def test_csv_readers(spark, tmp_path):
    (tmp_path / "c.csv").write_text("﻿name,code\na,\nb,B1\n", encoding="utf-8")
    assert [tuple(r) for r in readers.construction_csv(spark, f"{tmp_path}/c.csv").collect()] == [(2, "b", "B1")]
    (tmp_path / "p.csv").write_text('h,h,h\nabc,Name,P9\n 7 ,"Two, words",P8\n', encoding="utf-8")
    assert sorted(tuple(r) for r in readers.process_csv(spark, f"{tmp_path}/p.csv").collect()) == [(1, 1, "Name", "P9"), (2, 7, "Two, words", "P8")]
    (tmp_path / "l.csv").write_text("﻿製品番号\nA1\nCode\n\nB2\n", encoding="utf-8")
    assert sorted(r.code for r in readers.label_csv(spark, f"{tmp_path}/l.csv").collect()) == ["A1", "B2"]
    (tmp_path / "a.txt").write_text("B1\n xxxxxxxxxx \nA1\n鉄\nB1\n", encoding="utf-8")
    assert [r.code for r in readers.label_asset(spark, f"{tmp_path}/a.txt").orderBy("label_index").collect()] == ["B1", "A1"]
    (tmp_path / "d.txt").write_text("x\n\ny\n", encoding="utf-8")
    assert sorted(tuple(r) for r in readers.dictionary(spark, f"{tmp_path}/d.txt").collect()) == [(0, "blank"), (1, "x"), (2, "y")]


def test_json_readers(spark, tmp_path):
    assert readers.json_array(spark, f"{tmp_path}/none.json", "id long").count() == 0
    assert [r.code for r in readers.json_strings(spark, f"{tmp_path}/none.json", ["A"]).collect()] == ["A"]
    (tmp_path / "bad.json").write_text("[1, ")
    assert [r.code for r in readers.json_strings(spark, f"{tmp_path}/bad.json", ["A"]).collect()] == ["A"]
    (tmp_path / "ok.json").write_text('["x", "y"]')
    assert sorted(r.code for r in readers.json_strings(spark, f"{tmp_path}/ok.json", ["A"]).collect()) == ["x", "y"]
    (tmp_path / "rows.json").write_text('[{"id": 1}, {"id": 2}]')
    assert readers.json_array(spark, f"{tmp_path}/rows.json", "id long").count() == 2
    with pytest.raises(Exception):
        readers.json_array(spark, f"{tmp_path}/bad.json", "id long").collect()
    sinks.write_json(spark.range(3), f"{tmp_path}/out")
    assert readers.json_array(spark, f"{tmp_path}/out", "id long").count() == 3


def test_sync(spark):
    parents = spark.createDataFrame(
        [(1, "PENDING", None, 0, None), (2, "FAILED", None, 2, "x"), (3, "SYNCING", None, 0, None), (4, "PENDING", None, 0, None), (5, "FAILED", None, 3, "x")],
        "id long, syncStatus string, syncedAt long, retryCount int, errorMessage string",
    )
    items = spark.createDataFrame([(1,), (1,), (2,), (3,), (5,)], "registrationId long")
    outcomes = spark.createDataFrame([(1, True, None), (2, False, "HTTP 503")], "id long, ok boolean, message string")
    got = {r.id: (r.syncStatus, r.retryCount, r.sent) for r in sync.step(parents, items, outcomes, 9).collect()}
    assert got == {1: ("SYNCED", 0, 2), 2: ("FAILED", 3, 0), 3: ("SYNCING", 0, 0), 4: ("SYNCED", 0, 0), 5: ("FAILED", 3, 0)}
    again = parents.where("id IN (2, 3, 5)").withColumn("retryCount", F.when(F.col("id") == 2, 3).otherwise(F.col("retryCount")))
    assert again.where(history.eligible(F.col("syncStatus"), F.col("retryCount"))).count() == 0
    assert again.where(history.unsynced(F.col("syncStatus"))).count() == 3


def test_cascade_and_workers(spark):
    items = spark.createDataFrame([(1, "a"), (2, "b")], "registrationId long, code string")
    assert masters.cascade(items, spark.createDataFrame([], "id long"), "registrationId").count() == 0
    assert column(spark, ["user01", "42", "+5", " 7 "], text.worker_number) == [1, 42, 5, 1]
    assert column(spark, ["1C-X1Y1", "other"], lambda c: text.contains_like(c, " c-x1 ")) == [True, False]


def test_sessions(spark):
    rows = [(1, "2024-01-01 00:00:00", 1), (1, "2024-01-01 03:00:00", 2), (1, "2024-01-01 06:00:01", 3)]
    e = spark.createDataFrame(rows, "user_id long, ts string, event_id long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert [r.session for r in sessions.sessions(e).orderBy("event_id").collect()] == [1, 1, 2]
    f = spark.createDataFrame([(1, t, t) for t in (0, 100, 149, 150, 260, 300)], "stream long, ts_ms long, frame_id long")
    assert sorted(r.ts_ms for r in sessions.throttled(f).collect()) == [0, 150, 300]


def test_recognition(spark):
    d = spark.createDataFrame([([5, 5, 0, 5, 0, 0, 7],)], "c array<int>")
    symbols = F.array(*(F.lit(str(i)) for i in range(8)))
    assert d.select(regions.decoded(F.col("c"), symbols)).first()[0] == "557"
    t = spark.createDataFrame([("EMPTY", 0.9), ("@#%!", 0.9), ("AB", 0.59), ("AB", 0.60), ("AB-12", 0.62), ("A-1", 0.99)], "t string, c float")
    assert [r[0] for r in t.select(image.is_kept(F.col("t"), F.col("c"))).collect()] == [False, False, False, True, True, True]
    assert [r[0] for r in t.select(image.is_confident(F.col("t"), F.col("c"))).collect()][4:] == [True, False]
    s = spark.createDataFrame([("AB-12", 0.5)], "t string, c float").select(image.recognition_score(F.col("t"), F.col("c"))).first()[0]
    assert abs(s - 0.56) < 1e-6


def test_sizes_and_colors(spark):
    d = spark.createDataFrame([(300, 40), (10000, 40), (10, 48), (64, 48)], "w int, h int")
    assert [r[0] for r in d.select(numeric.recognition_width(F.col("w"), F.col("h"))).collect()] == [384, 1920, 32, 64]
    d = spark.createDataFrame([(1600, 1200), (1000, 333)], "w int, h int")
    out = [tuple(r) for r in d.select(*numeric.letterbox(F.col("w"), F.col("h")).values()).collect()]
    assert out == [(0.32, 512, 384, 0, 64), (0.512, 512, 170, 0, 171)]
    d = spark.createDataFrame([(50.0, 0.5, 0.5), (30.0, 0.5, 0.5), (0.0, 0.1, 0.8), (0.0, 0.5, 0.26), (0.0, 0.5, 0.2)], "h double, s double, v double")
    assert [r[0] for r in d.select(image.color_class(F.col("h"), F.col("s"), F.col("v"))).collect()] == ["YELLOW", "UNKNOWN", "WHITE", "BLACK", "UNKNOWN"]
    d = spark.createDataFrame([(0.0, 11.0), (0.0, 200.0), (0.0, 50.0)], "a double, b double")
    assert [round(r[0], 6) for r in d.select(image.contrast(F.col("a"), F.col("b"))[0]).collect()] == [1.0, 1.1, 2.2]


def test_merging_lines(spark):
    rows = [(1, 0, 0.0, 0.0, 50.0, 10.0), (1, 1, 60.0, 1.0, 100.0, 11.0), (1, 2, 0.0, 40.0, 50.0, 50.0), (2, 0, 0.0, 0.0, 5.0, 5.0)]
    boxes = spark.createDataFrame(rows, "image long, ord int, left double, top double, right double, bottom double")
    got = sorted(tuple(r) for r in regions.merge_lines(boxes, 1600.0).collect())
    assert [g[:3] + g[4:5] for g in got] == [(1, 0, 0.0, 100.0), (1, 1, 0.0, 50.0), (2, 0, 0.0, 5.0)]
    middle = (5.0 * 50 + 6.0 * 40) / 90
    assert abs(got[0][3] - (middle - 5)) < 1e-9 and abs(got[0][5] - (middle + 5)) < 1e-9


def test_components(spark):
    px = spark.createDataFrame([(1, x, y) for x, y in ((0, 0), (1, 0), (1, 1), (3, 3), (5, 5), (5, 6), (5, 7))], "image long, x long, y long")
    got = regions.components(px, 3).groupBy("component").count().orderBy("component").collect()
    assert [tuple(r) for r in got] == [(0, 3), (1, 3)]
